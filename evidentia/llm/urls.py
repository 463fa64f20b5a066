"""URL rules in a sorted digest array, memory-mapped by the tasks."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Rules of one digest array; longer lists make several, which a task probes in turn.
ARRAY_RULES = 50_000_000


class DigestArray:
    """Sorted 64-bit keys with, per key, where its full string lies; equal keys lie side by side."""

    def __init__(self, base: str):
        self.keys = np.load(f"{base}.keys.npy", mmap_mode="r")
        self.ends = np.load(f"{base}.ends.npy", mmap_mode="r")
        self.verdicts = np.load(f"{base}.verdicts.npy", mmap_mode="r")
        self.text = np.load(f"{base}.text.npy", mmap_mode="r")
        self.paths = np.load(f"{base}.paths.npy").tolist()

    @staticmethod
    def write(rules, base: str) -> list[str]:
        rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v == "block") for r, v in dict(rules).items())
        parts = {
            "keys": np.array([k for k, _, _ in rows], np.uint64),
            "ends": np.cumsum([0] + [len(r) for _, r, _ in rows]),
            "verdicts": np.array([v for _, _, v in rows], bool),
            "text": np.frombuffer(b"".join(r for _, r, _ in rows), np.uint8),
            # The lengths of the rules' paths say which prefixes of a path need a probe.
            "paths": np.array(sorted({len(r.decode()) - r.decode().index("/") for _, r, _ in rows}), np.int64),
        }
        for name, values in parts.items():
            np.save(f"{base}.{name}.npy", values)
        return [f"{base}.{name}.npy" for name in parts]

    def probe(self, strings: list[str]) -> np.ndarray:
        """Index of each string's rule, or -1. A key that fits counts only if its stored string is equal."""
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        want = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw))
        at = np.searchsorted(self.keys, want)
        out = np.full(len(raw), -1, np.int64)
        fits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want) if len(self.keys) else []
        for i in fits:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:
                if self.text[self.ends[k] : self.ends[k + 1]].tobytes() == raw[i]:
                    out[i] = k
                    break
                k += 1
        return out


def filter_urls(spark: SparkSession, pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages plus host, path, rule, verdict. The longest rule that fits a host (or a parent domain) and path prefix wins.

    No rule (also null and empty urls and such without "://"): rule null, verdict allow, since only listed urls are blocked.
    A rule that is listed twice has the last verdict. Columns of pages that have these names are replaced, all others and
    all rows stay, repeated ones too; long urls are judged whole. No rows give no rows.
    """
    rules = list(dict(rules).items())
    folder = tempfile.mkdtemp(prefix="spark-")
    names = []
    for at in range(0, max(1, len(rules)), ARRAY_RULES):
        names.append(f"rules-{os.path.basename(folder)}-{at}")  # Spark registers a file name once
        for path in DigestArray.write(rules[at : at + ARRAY_RULES], os.path.join(folder, names[-1])):  # the driver serves these files to its executors
            spark.sparkContext.addFile(path)

    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        best: list[tuple[int, str | None, str]] = [(-1, None, "allow")] * len(hosts)
        for name in names:
            array = DigestArray(SparkFiles.get(name))
            tries, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                labels = h.split(".")
                for n in array.paths:
                    if n <= len(p):
                        for k in range(len(labels)):
                            tries.append(".".join(labels[k:]) + p[:n])
                            owner.append(i)
            found = array.probe(tries)
            for at in np.flatnonzero(found >= 0).tolist():
                k = int(found[at])
                best[owner[at]] = max(best[owner[at]], (len(tries[at]), tries[at], "block" if array.verdicts[k] else "allow"), key=lambda x: x[0])
        return pd.DataFrame({"rule": [b[1] for b in best], "verdict": [b[2] for b in best]})

    j = fresh(pages, "_j")
    out = pages.withColumns({"host": host, "path": path}).withColumn(j, judge("host", "path"))
    return out.withColumns({"rule": F.col(f"{j}.rule"), "verdict": F.col(f"{j}.verdict")}).drop(j)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of all pages; see filter_urls."""
    return filter_urls(spark, table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_FIT = " ".join(
    f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
    for r, _ in sorted(RULES, key=lambda x: -len(x[0]))
)
ORACLE = {
    "op2_url_filter": f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT *, CASE {_FIT} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m"""
}
