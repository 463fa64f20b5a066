"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_table, table, words_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def bin_cost(capacity: int, overhead: int = 16, attention: int = 16_384) -> float:
    """What a sequence costs: its tokens, a fixed part, and a part that grows with its square (attention)."""
    return capacity + overhead + capacity * capacity / attention


def pack_lengths(lengths: list[int], capacities=CAPACITIES, overhead: int = 16, attention: int = 16_384) -> list[tuple[int, int]]:
    """(bin, offset) of each length, none longer than the largest capacity.

    Longest first (ties: in the order given), each piece goes to the open bin with the least room that holds it (ties: the
    older bin). If none does, a bin of each size is filled on trial with the piece and what is still unplaced, and the size
    with the least cost for each token that it came to hold is opened (ties: the smaller).
    """
    caps = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    ascending = sorted(lengths)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)

    def filled(n: int, cap: int, top: int) -> int:
        """Tokens that a bin of cap comes to hold: n, then the longest that fits of the top shortest pieces, again and again."""
        left = cap - n
        while left:
            top = bisect_right(ascending, left, 0, top) - 1
            if top < 0 or not ascending[top]:
                break
            left -= ascending[top]
        return cap - left

    for at, i in enumerate(order):
        n = lengths[i]
        fit = bisect_left(room, (n, -1))
        if fit < len(room):
            free, k = room.pop(fit)
        else:
            rest = len(order) - at - 1
            free = min((c for c in caps if c >= n), key=lambda c: (bin_cost(c, overhead, attention) / max(1, filled(n, c, rest)), c))
            k = len(used)
            used.append(0)
        out[i] = (k, used[k])
        used[k] += n
        if free > n:
            insort(room, (free - n, k))
    return out


def best_fit_pack(docs: DataFrame, length: Column, id_col: str = "doc_id", capacities=CAPACITIES, overhead: int = 16, attention: int = 16_384, per_shard: int = 20_000) -> DataFrame:
    """Pack every row of docs by its length: (id, piece, piece_start, length, bin_id, bin_offset, bin_capacity).

    A row longer than the largest capacity is cut into full pieces and a rest, so none is dropped.
    Pieces are dealt by hash to shards of about per_shard pieces, each packed by itself; bin ids are
    (shard, bin). Last, each bin is downsized to the least capacity that holds its contents.
    Rows of length null, 0 or less get one empty piece. Repeated and null ids are rows of their own, ties go by row;
    other columns are not read; an empty table gives no rows.
    """
    caps = sorted(capacities)
    top = caps[-1]
    # Lengths are measured once; the row numbers are written with them, so they stay.
    rows = cut_table(docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.greatest(F.lit(0), F.coalesce(length, F.lit(0))).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")))
    count = F.greatest(F.lit(1), F.expr(f"(n + {top - 1}) div {top}"))
    total = rows.agg(F.sum(count)).first()[0] or 0
    shards = max(1, -(-total // per_shard))
    pieces = rows.select("id", "n", "row", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("piece")).select(
        "id", "row", "piece", (F.col("piece").cast("long") * top).alias("piece_start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("long").alias("length")
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        placed = pack_lengths(pdf["length"].tolist(), caps, overhead, attention)
        pdf["bin"] = [b for b, _ in placed]
        pdf["bin_offset"] = [o for _, o in placed]
        fill = pdf.groupby("bin")["length"].transform("sum")
        pdf["bin_capacity"] = [caps[bisect_left(caps, x)] for x in fill.tolist()]
        pdf["bin_id"] = pdf["shard"].astype(str) + "-" + pdf["bin"].astype(str)
        return pdf[["id", "piece", "piece_start", "length", "bin_id", "bin_offset", "bin_capacity"]]

    # Row numbers spread evenly, so shards stay near per_shard even where one source or id holds most rows.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(pack, "id string, piece int, piece_start long, length long, bin_id string, bin_offset long, bin_capacity long")
    return packed.select(F.col("id").cast("long").alias(id_col), "piece", "piece_start", "length", "bin_id", "bin_offset", "bin_capacity")


def fill_bins(packed: DataFrame, tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The sequences: bin_id, bin_capacity, ids (the pieces' token ids in order) and segments (id, piece, offset, length).

    packed is best_fit_pack's result over tokens(id, ids), ids unique. A bin is no longer than its capacity; empty pieces have no segment.
    """
    t = tokens.select(F.col(id_col).cast("long").alias("_t"), F.col(ids_col).alias("_ids"))
    parts = packed.where("length > 0").join(t, F.col(id_col) == F.col("_t")).withColumn("_part", F.expr("slice(_ids, cast(piece_start as int) + 1, cast(length as int))"))
    bins = parts.groupBy("bin_id", "bin_capacity").agg(F.sort_array(F.collect_list(F.struct("bin_offset", F.col(id_col).alias("id"), "piece", "length", F.col("_part").alias("part")))).alias("p"))
    segments = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["bin_offset"].alias("offset"), x["length"].alias("length")))
    return bins.select("bin_id", "bin_capacity", F.flatten(F.transform("p", lambda x: x["part"])).alias("ids"), segments.alias("segments"))


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.size(F.array_remove(words_of(F.coalesce(text, F.lit(""))), ""))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, by their numbers of words, in bins; see best_fit_pack."""
    return best_fit_pack(table(spark, sf_dir, "documents"), n_words(F.col("text")))
