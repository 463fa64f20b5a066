"""Values that hold until the next one, over texts of any length, and what is read that way: coverage records and stack frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut_table
from .joins import TASK_ROWS, dealt

#: Positions whose rows are put in order together.
BLOCK = 4_096


def carry_forward(rows: DataFrame, value: str, block: int = BLOCK, before: bool = False) -> DataFrame:
    """rows(id, pos, value, ...) plus carried: the last value that is not null up to the row, or, with before, up to the one before it; by pos, a whole number.

    The last value of each block of positions is found first, then for each block the last one before it, then blocks are filled on their own:
    a text of a thousand million lines is put in order as its blocks, and no task holds its lines, nor, since blocks are carried over in
    blocks themselves, all its blocks. Of equal positions neither comes first.
    """
    return _carried(rows, value, block, before)[0].drop("_b")


def _carried(rows: DataFrame, value: str, block: int, before: bool) -> tuple[DataFrame, int]:
    """carry_forward() with the block as _b, by which and by id rows are dealt, and the number of rows."""
    at = F.floor(F.col("pos") / block)
    d = cut_table(rows.withColumn("_b", at))
    n = d.count()
    d = dealt(d, n, "id", "_b")
    # One row for each block that has rows, as it is these that take the value over.
    all_ = cut_table(d.groupBy("id", "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("pos"))).alias("_v")))
    if all_.count() > TASK_ROWS and block > 1:
        starts = carry_forward(all_.select("id", F.col("_b").alias("pos"), "_v"), "_v", block, True).select("id", F.col("pos").alias("_b"), F.col("carried").alias("_s"))
    else:
        earlier = Window.partitionBy("id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = all_.select("id", "_b", F.last("_v", True).over(earlier).alias("_s"))
    here = Window.partitionBy("id", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return d.join(starts, ["id", "_b"]).withColumn("carried", F.coalesce(F.last(value, True).over(here), "_s")).drop("_s"), n


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, pos, line) of docs(id, text), from 0."""
    return docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", F.col("pos").cast("long").alias("pos"), F.regexp_replace("line", "\r$", "").alias("line"))


def coverage_records(lines: DataFrame) -> DataFrame:
    """(id, pos, path, lines_found, lines_hit) of lines(id, pos, line) of coverage reports: SF: opens a file's record, DA: is a line and its count, end_of_record closes it.

    A record that another follows before it is closed, or that is never closed, is none. Counts that are no numbers are 0. pos is the record's first line.
    """
    line = F.col("line")
    opens, closes = line.startswith("SF:"), line == "end_of_record"
    mark = F.when(opens, F.struct(F.col("pos").alias("at"), F.replace(F.substring(line, 4, 1 << 20), F.lit("\\"), F.lit("/")).alias("path"))).when(closes, F.struct(F.lit(-1).cast("long").alias("at"), F.lit("").alias("path")))
    l, n = _carried(lines.where(opens | closes | line.startswith("DA:")).withColumn("mark", mark), "mark", BLOCK, True)
    l = l.withColumn("record", F.when(opens, F.col("mark")).otherwise(F.col("carried"))).where("record.at >= 0")
    count = F.coalesce(F.regexp_extract("line", "^DA:[^,]*,([0-9]+)$", 1).try_cast("decimal(38,0)"), F.lit(0))
    da = line.startswith("DA:")
    # A record is counted in each of its blocks, where its lines are, and these counts are dealt.
    g = l.groupBy("id", "_b", "record").agg(F.count_if(da).alias("found"), F.count_if(da & (count > 0)).alias("hit"), F.max(closes).alias("closed"))
    g = dealt(g, n, "id", "record").groupBy("id", "record").agg(F.sum("found").alias("found"), F.sum("hit").alias("hit"), F.max("closed").alias("closed"))
    return g.where("closed").select("id", F.col("record.at").alias("pos"), F.col("record.path").alias("path"), F.col("found").alias("lines_found"), F.col("hit").alias("lines_hit"))


def backtrace_frames(lines: DataFrame) -> DataFrame:
    """(id, pos, symbol, path, at_line) of lines(id, pos, line) of backtraces: a numbered symbol's line, then `at path:line[:column]`.

    A place takes the last symbol before it, null if there is none since the last place: a symbol names one place.
    """
    symbol = F.regexp_extract("line", r"^\s*[0-9]+:\s+(?:0x[0-9a-fA-F]+ - )?(\S.*?)\s*$", 1)
    place = r"^\s+at (.+?):([0-9]+)(?::[0-9]+)?\s*$"
    is_place = F.col("line").rlike(place)
    mark = F.when(is_place, F.struct(F.lit(False).alias("named"), F.lit("").alias("symbol"))).when(symbol != "", F.struct(F.lit(True).alias("named"), symbol.alias("symbol")))
    l = carry_forward(lines.withColumn("mark", mark).where("mark is not null"), "mark", before=True).where(is_place)
    return l.select("id", "pos", F.when(F.col("carried.named"), F.col("carried.symbol")).alias("symbol"), F.regexp_extract("line", place, 1).alias("path"), F.regexp_extract("line", place, 2).try_cast("long").alias("at_line"))
