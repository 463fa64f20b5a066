"""Nearest vectors: exactly, on a grid of blocks, and through inverted lists of product-quantised residuals with exact rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut, cut_table
from .joins import spread

#: Rows of a block that is compared as one matrix.
BLOCK = 2048
#: Rows that quantisers are fitted on, at most; they are picked by a hash of their ids, all if there are fewer.
FIT_ROWS = 100_000
#: Blocks of one list that stay together.
TOGETHER = 8
TOP = "query_id long, id long, similarity double"


def usable(rows: DataFrame) -> DataFrame:
    """rows(id, v array<double>) whose vector has a direction: not null, no null or non-finite component, not all zero."""
    ok = F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(ok, F.lit(False)))


def _unit(v) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in v])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(size: int):
    """(cell, id, v) of a partition, sorted by cell, in blocks of one cell each: its ids and its unit vectors."""

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            for cell, own in held.groupby("cell", sort=True):
                if cell == held["cell"].iloc[-1] and len(own) < size:
                    held = own  # its cell may go on
                    break
                for at in range(0, len(own), size):
                    some = own.iloc[at : at + size]
                    yield pd.DataFrame({"cell": [cell], "ids": [some["id"].to_numpy(np.int64).tobytes()], "vectors": [_unit(some["v"]).tobytes()]})
            else:
                held = None
        if held is not None and len(held):
            for at in range(0, len(held), size):
                some = held.iloc[at : at + size]
                yield pd.DataFrame({"cell": [some["cell"].iloc[0]], "ids": [some["id"].to_numpy(np.int64).tobytes()], "vectors": [_unit(some["v"]).tobytes()]})

    return run


def in_blocks(rows: DataFrame, cell: Column, size: int = BLOCK) -> DataFrame:
    """rows(id, v) as blocks(cell int, ids binary, vectors binary)."""
    d = rows.select(cell.cast("int").alias("cell"), "id", "v").repartition("cell").sortWithinPartitions("cell")
    return d.mapInPandas(_blocks(size), "cell int, ids binary, vectors binary")


def best(ids: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row of similarity, ties by id."""
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(-similarity[:, by_id], axis=1, kind="stable")[:, :k]]


def _compare(k: int):
    """Pairs of blocks: each query's k best rows of the block."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                a, b = np.frombuffer(r.q_vectors).reshape(len(q), -1), np.frombuffer(r.vectors).reshape(len(ids), -1)
                if a.shape[1] != b.shape[1]:
                    raise ValueError("vectors must have the same length")
                sim = np.round(a @ b.T, 6)
                sim[q[:, None] == ids[None]] = -np.inf
                top = best(ids, sim, k)
                out = pd.DataFrame({"query_id": np.repeat(q, top.shape[1]), "id": ids[top].ravel(), "similarity": np.take_along_axis(sim, top, 1).ravel()})
                yield out[np.isfinite(out["similarity"])]

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of found(query_id, id, similarity) for each query, ties by id, with their rank. The limit is met before rows are exchanged, too."""
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, similarity): the k rows(id, v) nearest by cosine to each of queries(id), which are rows too; ties by id.

    Exact, in one job: rows and queries are dealt over a grid of cells, each row to one column of it, each query to one row; a
    cell compares its blocks as matrices and gives partial best rows. The grid is chosen so that both sides are copied about as much.
    """
    rows = cut_table(usable(rows))
    q = cut_table(queries.select("id").distinct().join(rows, "id").dropDuplicates(["id"]))
    n, m = rows.count(), q.count()
    if not n or not m:
        return rows.sparkSession.createDataFrame([], "query_id long, rank long, id long, similarity double")
    cells = 2 * rows.sparkSession.sparkContext.defaultParallelism
    across = max(1, min(cells, round((cells * n / m) ** 0.5), -(-n // 256)))
    down = max(1, min(cells // across, -(-m // 256)))
    deal = lambda of, where: F.explode(F.transform(F.sequence(F.lit(0), F.lit(of - 1)), where))
    mine = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    there = in_blocks(rows.select("id", "v", mine(across).alias("x")).select("id", "v", deal(down, lambda y: F.col("x") * down + y).alias("c")), F.col("c"))
    here = in_blocks(q.select("id", "v", mine(down).alias("y")).select("id", "v", deal(across, lambda x: x * down + F.col("y")).alias("c")), F.col("c"), 256)
    pairs = there.join(here.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"}).hint("shuffle_hash"), "cell")
    return ranked(pairs.mapInPandas(_compare(k), TOP), k)


@dataclass
class Index:
    """Inverted lists: coarse centres, codebooks of the parts' residuals, blocks(cell, ids, codes) of all rows, and the rows."""

    centres: np.ndarray
    books: np.ndarray
    blocks: DataFrame
    rows: DataFrame


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def _sums(transform, centres: np.ndarray):
    """Of each part and centre the sum and number of a partition's points; transform makes (part, point, component) of unit vectors."""

    def run(batches):
        parts, entries, width = centres.shape
        total, count = np.zeros(centres.shape), np.zeros((parts, entries), np.int64)
        for pdf in batches:
            if len(pdf):
                for p, x in enumerate(transform(_unit(pdf["v"]))):
                    at = nearest_centre(x, centres[p])
                    np.add.at(total[p], at, x)
                    count[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(count)
        yield pd.DataFrame({"part": part, "entry": entry, "n": count[part, entry], "total": list(total[part, entry])})

    return run


def learn(sample: DataFrame, transform, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres (part, entry, component) after so many rounds of means over sample(v). One row for an entry and task is exchanged; centres without points stay."""
    for _ in range(rounds):
        sums = sample.mapInPandas(_sums(transform, centres), "part int, entry int, n long, total array<double>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(centres.shape[2])]).alias("total"))
        centres = centres.copy()
        for r in total.collect():  # as many rows as centres
            centres[r["part"], r["entry"]] = np.array(r["total"]) / r["n"]
    return centres


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    return np.stack(np.split(x, parts, axis=1))


def _encode(centres: np.ndarray, books: np.ndarray):
    """Rows sorted by cell as blocks of codes."""

    def run(batches):
        for pdf in batches:
            x, cells = _unit(pdf["v"]), pdf["cell"].to_numpy()
            codes = np.stack([nearest_centre(p, b) for p, b in zip(_parts(x - centres[cells], len(books)), books)], axis=1).astype(np.uint8)
            edge = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for at in range(s, e, BLOCK):
                    some = slice(at, min(at + BLOCK, e))
                    yield pd.DataFrame({"cell": [int(cells[s])], "ids": [pdf["id"].to_numpy(np.int64)[some].tobytes()], "codes": [codes[some].tobytes()]})

    return run


def _cells(centres: np.ndarray):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=nearest_centre(_unit(pdf["v"]), centres).astype(np.int32))

    return run


def build_index(rows: DataFrame, lists: int = 64, parts: int = 16, entries: int = 256, rounds: int = 6) -> Index:
    """An index of all usable rows(id, v). Quantisers are fitted on at most FIT_ROWS rows; every row is indexed.

    Vectors are made of length 1. Each row goes to the list of its nearest centre; what is left of it is coded part by part.
    A long list lies in many files, as rows are ordered by list and id. parts must divide the vectors' length.
    """
    rows = cut_table(usable(rows))
    mixed = F.xxhash64("id", F.lit(17))
    n = rows.count()
    sample = rows.orderBy(mixed, "id").limit(FIT_ROWS) if n > FIT_ROWS else rows
    sample = cut_table(sample.select("id", "v").repartition(max(1, min(n, FIT_ROWS) // 4096)))
    first = [r["v"] for r in sample.orderBy(mixed, "id").limit(max(lists, entries)).collect()]
    if not first:
        return Index(np.zeros((0, 0)), np.zeros((0, 0, 0)), rows.sparkSession.createDataFrame([], "cell int, ids binary, codes binary"), rows)
    if len(first[0]) % parts:
        raise ValueError(f"vectors of {len(first[0])} components have no {parts} equal parts")
    start = _unit(first)
    centres = learn(sample, lambda x: x[None], start[None, :lists], rounds)[0]
    left = lambda x: _parts(x - centres[nearest_centre(x, centres)], parts)
    books = learn(sample, left, left(start[:entries]), rounds)
    placed = rows.select("id", "v").mapInPandas(_cells(centres), "id long, v array<double>, cell int")
    blocks = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInPandas(_encode(centres, books), "cell int, ids binary, codes binary")
    return Index(centres, books, cut_table(blocks), rows)


def _probe(centres: np.ndarray, probes: int):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["v"])
                near = np.argsort((centres * centres).sum(1) - 2 * x @ centres.T, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(pdf)), near.shape[1])
                yield pd.DataFrame({"cell": near.ravel().astype(np.int32), "id": pdf["id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at]})

    return run


#: Queries on which the number of probes is settled, at most.
TRIALS = 200


def probes_for(index: Index, k: int, recall: float, trials: int = TRIALS) -> int:
    """How many lists must be scanned for that share of the true k nearest, as told by an exact search for a few rows, picked by a hash of their ids."""
    some = index.rows.orderBy(F.xxhash64("id", F.lit(23)), "id").limit(trials).select("id")
    v = index.rows.select("id", "v")
    true = top_k(v, some, k).select("query_id", "id").join(v, "id").join(v.toDF("query_id", "q"), "query_id")
    c = index.centres

    def places(batches):
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["q"])
                order = np.argsort((c * c).sum(1) - 2 * x @ c.T, axis=1, kind="stable")
                yield pd.DataFrame({"place": np.argmax(order == nearest_centre(_unit(pdf["v"]), c)[:, None], axis=1)})

    found = true.select("v", "q").mapInPandas(places, "place int").agg(F.percentile("place", recall).alias("p")).first()["p"]
    return min(len(c), int(np.ceil(found or 0)) + 1)


def _scan(centres: np.ndarray, books: np.ndarray, keep: int):
    """Blocks of codes with blocks of queries that probe their list: each query's best rows by the coded distance."""

    def run(batches):
        norm = (books * books).sum(2)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.q_vectors).reshape(len(q), -1) - centres[r.cell]
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1)
                far = np.zeros((len(q), len(ids)))
                for p, part in enumerate(_parts(x, len(books))):
                    far += (norm[p][None] - 2 * part @ books[p].T)[:, codes[:, p]]
                far += (x * x).sum(1)[:, None]
                near = np.round(-far, 9)
                near[q[:, None] == ids[None]] = -np.inf
                top = best(ids, near, keep)
                out = pd.DataFrame({"query_id": np.repeat(q, top.shape[1]), "id": ids[top].ravel(), "similarity": np.take_along_axis(near, top, 1).ravel()})
                yield out[np.isfinite(out["similarity"])]

    return run


def search(index: Index, queries: DataFrame, k: int, probes: int, rerank: int = 200) -> DataFrame:
    """(query_id, rank, id, similarity) of each of queries(id, v), of which a row of the same id is left out; approximate.

    The probes nearest lists of a query (see probes_for) are scanned by coded distance; the rerank best of all of them are compared exactly.
    A list's blocks go to tasks TOGETHER at a time, so a long list is no single task's.
    """
    spark = queries.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], "query_id long, rank long, id long, similarity double")
    q = cut_table(usable(queries).select("id", "v").dropDuplicates(["id"]))
    asked = in_blocks(q.mapInPandas(_probe(index.centres, probes), "cell int, id long, v array<double>"), F.col("cell"), 256)
    number = F.row_number().over(Window.partitionBy("cell").orderBy("ids")) - 1
    blocks = cut_table(index.blocks.withColumn("some", F.floor(number / TOGETHER).cast("int")))
    lots = cut(blocks.groupBy("cell").agg((F.max("some") + 1).alias("lots")))  # one row for a list, of which there are a fixed number
    asked = asked.join(F.broadcast(lots), "cell").withColumn("some", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    pairs = blocks.join(asked.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"}), ["cell", "some"])
    found = cut_table(ranked(pairs.mapInPandas(_scan(index.centres, index.books, rerank), TOP), rerank).select("query_id", "id"))
    exact = spread(found, index.rows.select("id", F.col("v").alias("w")), "id").join(q.select(F.col("id").alias("query_id"), "v"), "query_id")

    def cosine(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "similarity": np.round((_unit(pdf["v"]) * _unit(pdf["w"])).sum(1), 6)})

    return ranked(exact.select("query_id", "id", "v", "w").mapInPandas(cosine, TOP), k)
