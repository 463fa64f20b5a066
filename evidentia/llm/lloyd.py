"""Vector codes by Lloyd rounds over integer parts, in which kd-trees give whole subtrees to an entry at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, lookup, table

#: A component x is coded as floor(SCALE * x).
SCALE = 1024
#: Scaled components below this give exact distances and errors in 64 bits; larger ones raise.
MOST = 1 << 27
#: Scaled components below this give distances that doubles hold exactly.
DOUBLES = 1 << 22
#: Vectors in one block, which has a tree for each part; points in a leaf at most twice this.
BLOCK, LEAF = 4096, 8


def bounds(n: int, level: int) -> np.ndarray:
    """Where the 2 ** level nodes of a level begin and end among n points in the tree's order."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth_of(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of points (n, width) in their tree, and low corner, high corner and sum of each node, level by level.

    Each node is cut at the middle of its points along its widest side, so where nodes begin follows from n alone.
    """
    n = len(points)
    order, depth = np.arange(n), depth_of(n)
    lows, highs, sums = [], [], []
    for level in range(depth + 1):
        edge, p = bounds(n, level), points[order]
        low, high = np.minimum.reduceat(p, edge[:-1]), np.maximum.reduceat(p, edge[:-1])
        lows.append(low), highs.append(high), sums.append(np.add.reduceat(p.astype(np.int64), edge[:-1]))
        if level < depth:
            node = np.repeat(np.arange(1 << level), np.diff(edge))
            side = np.argmax(high.astype(np.int64) - low, axis=1) if points.shape[1] else np.zeros(1 << level, int)
            order = order[np.lexsort((p[np.arange(n), side[node]] if points.shape[1] else node, node))]
    return order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)


def beaten(low: np.ndarray, high: np.ndarray, best: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(node, entry): whether the node's best entry is nearer to every point of its box, or as near with a lower index.

    The corner farthest out towards an entry decides: if the best one is nearer even there, it is nearer everywhere.
    """
    away = entries[None] - entries[best][:, None]
    reach = np.where(away > 0, high[:, None] * away, low[:, None] * away).sum(2)
    norm = (entries * entries).sum(1)
    more = norm[None] - norm[best][:, None] - 2 * reach  # what the entry is farther than the best one, squared, at that corner
    at = np.arange(len(entries))[None]
    return (at != best[:, None]) & ((more > 0) | ((more == 0) & (at > best[:, None])))


def assign(points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point (in the tree's order; ties to the lower index), and each entry's sum and count.

    Down the levels, entries that are beaten for a node's box are out for all below; a node with one entry left goes to it
    whole, with its cached sum and count. What is left in the leaves is compared point by point.
    """
    n, depth = len(points), depth_of(len(points))
    biggest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = np.float64 if biggest < DOUBLES else np.int64
    c = entries.astype(exact)
    out, total, count = np.zeros(n, np.int64), np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    norm = (c * c).sum(1)
    for level in range(depth + 1):
        edge, base = bounds(n, level), (1 << level) - 1
        near = norm[None] - (low[base + nodes] + high[base + nodes].astype(exact)) @ c.T  # of the middle, but for a term of its own
        best = np.where(alive, near, np.inf if exact is np.float64 else np.iinfo(np.int64).max).argmin(1)
        for at in range(0, len(nodes), 64):
            some = slice(at, at + 64)
            alive[some] &= ~beaten(low[base + nodes[some]].astype(exact), high[base + nodes[some]].astype(exact), best[some], c)
        whole = alive.sum(1) == 1
        for node, entry in zip(nodes[whole].tolist(), best[whole].tolist()):
            out[edge[node] : edge[node + 1]] = entry
            total[entry] += sums[base + node]
            count[entry] += edge[node + 1] - edge[node]
        nodes, alive = nodes[~whole], alive[~whole]
        if level < depth:
            nodes, alive = np.repeat(nodes * 2, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, axis=0)
    if len(nodes):
        size = np.diff(bounds(n, depth))[nodes]
        at = np.repeat(bounds(n, depth)[nodes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        far = norm[None] - 2 * (points[at].astype(exact) @ c.T)
        nearest = np.where(np.repeat(alive, size, axis=0), far, np.inf if exact is np.float64 else np.iinfo(np.int64).max).argmin(1)
        out[at] = nearest
        np.add.at(total, nearest, points[at])
        count += np.bincount(nearest, minlength=len(entries))
    return out, total, count


BLOCKS = "ids array<string>, labels array<string>, points binary, places binary, low binary, high binary, sums binary"


def _blocks(parts: int):
    """Rows (id, label, v) of a partition in blocks, each with the trees of its parts."""

    def block(ids: list, labels: list, v: np.ndarray) -> pd.DataFrame:
        if v.size and np.abs(v).max() >= MOST:
            raise ValueError(f"components of {MOST // SCALE} or more have no exact error in 64 bits")
        trees, points = [], []
        for p in np.split(v.astype(np.int32), parts, axis=1):
            trees.append(build(p))
            points.append(p[trees[-1][0]])
        pack = lambda k, kind: b"".join(t[k].astype(kind).tobytes() for t in trees)
        return pd.DataFrame({"ids": [ids], "labels": [labels], "points": [b"".join(p.tobytes() for p in points)], "places": [pack(0, np.int32)], "low": [pack(1, np.int32)], "high": [pack(2, np.int32)], "sums": [pack(3, np.int64)]})

    def run(batches):
        ids, labels, held = [], [], []
        for pdf in batches:
            ids += pdf["id"].tolist()
            labels += pdf["label"].tolist()
            held += pdf["v"].tolist()
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], labels[:BLOCK], np.array(held[:BLOCK], np.int64))
                ids, labels, held = ids[BLOCK:], labels[BLOCK:], held[BLOCK:]
        if ids:
            yield block(ids, labels, np.array(held, np.int64))

    return run


def _trees(row, books: np.ndarray):
    """Of each part of a block: points in the tree's order, their places in the block, low, high and sums."""
    parts, _, width = books.shape
    n = len(row.ids)
    nodes = (2 << depth_of(n)) - 1
    read = lambda b, kind, k: np.frombuffer(b, kind).reshape(parts, k, width)
    places = np.frombuffer(row.places, np.int32).reshape(parts, n)
    yield from zip(read(row.points, np.int32, n), places, read(row.low, np.int32, nodes), read(row.high, np.int32, nodes), read(row.sums, np.int64, nodes))


def _sums(books: np.ndarray):
    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for part, (points, _, low, high, sums) in enumerate(_trees(row, books)):
                    _, t, c = assign(points, low, high, sums, books[part])
                    total[part] += t
                    count[part] += c
        part, entry = np.nonzero(count)
        yield pd.DataFrame({"part": part, "entry": entry, "n": count[part, entry], "sums": list(total[part, entry])})

    return run


def _codes(books: np.ndarray):
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = len(row.ids)
                code, error = np.zeros((n, len(books)), np.int64), np.zeros(n, np.int64)
                for part, (points, places, low, high, sums) in enumerate(_trees(row, books)):
                    nearest, _, _ = assign(points, low, high, sums, books[part])
                    code[places, part] = nearest
                    away = points.astype(np.int64) - books[part][nearest]
                    error[places] += (away * away).sum(1)
                yield pd.DataFrame({"id": row.ids, "label": row.labels, "code": ["".join(f"{e:02x}" for e in c) for c in code.tolist()], "error": error})

    return run


def finite(v: str) -> Column:
    """Whether a vector is there and none of its components is null or not finite."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & ok, F.lit(False))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of the rows with finite vectors, and the codebooks (part, entry, component).

    Components become floor(1024 * x); each part's entries start as that part of the vectors of the least ids (null ids come
    last, ties by vector) and take the floor of their points' mean in each round; unused ones stay. Codes are hex digits, two
    for a part. label_error is the error summed over rows of the same label, nulls together. Repeated rows stay. All vectors
    have the length of that of the least id, a multiple of parts (else an error); others get null code and error. Components of
    131,072 or more raise. Fewer rows than entries give as many entries. No rows give no rows and empty codebooks.

    Blocks of vectors with their trees are written once; each round reads them and returns one sum for an entry and task.
    Only codebooks, of fixed size, pass the driver.
    """
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE))
    kept = rows.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), scaled.alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    fits = kept.where(F.size("v") == width)
    least = [r["v"] for r in fits.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    start = np.array(least, np.int64).reshape(len(least), width)
    books = np.stack(np.split(start, parts, axis=1))
    if start.size and np.abs(start).max() >= MOST:
        raise ValueError(f"components of {MOST // SCALE} or more have no exact error in 64 bits")
    blocks = cut_table(fits.select(F.col("id").cast("string").alias("id"), "label", "v").mapInPandas(_blocks(parts), BLOCKS))
    for _ in range(rounds if width else 0):
        sums = blocks.mapInPandas(_sums(books), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width // parts)]).alias("sums"))
        books = books.copy()
        for r in total.collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    coded = blocks.mapInPandas(_codes(books), "id string, label string, code string, error long").select(F.col("id").cast("long").alias("id"), "label", "code", "error")
    other = kept.where(F.size("v") != width).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut_table(coded.unionByName(other))
    by_label = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    return lookup(coded, by_label, "label", "n").select("id", "label", "code", "error", "label_error"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks for all finite vectors of embeddings; see compress."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assign all parts to the entries of c{k}."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, x, m.e AS e, m.d + list_dot_product(x, x) AS d FROM (SELECT p.vec_id, p.part, any_value(p.x) AS x,
  min({{'d': list_dot_product(c.c, c.c) - 2 * list_dot_product(p.x, c.c), 'e': c.e}}) AS m FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.vec_id, p.part))"""


def _move(k: int) -> str:
    """The entries after that round."""
    return f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT part, e, list(floor(s / n) ORDER BY i) AS c FROM
  (SELECT part, e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, w, range(1, w.w + 1) r(i) GROUP BY part, e, i) GROUP BY part, e) m ON m.part = c.part AND m.e = c.e)"""


_ROUNDS = ",\n".join(f"{_round(k)},\n{_move(k)}" for k in range(4))
ORACLE = {
    "op13_vector_codes": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT any_value(len(v)) // 4 AS w FROM k),
p AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1 : (part + 1) * w] AS x FROM k, w, range(4) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 256),
{_ROUNDS},
{_round(4)},
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(CAST(CAST(u.x AS BIGINT) AS VARCHAR), ',' ORDER BY c.part, c.e, u.i)) FROM c4 c, unnest(c.c) WITH ORDINALITY u(x, i)) AS codebooks_sha256 FROM o JOIN k USING (vec_id)""",
}
