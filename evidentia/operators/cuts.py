"""Cutting lineage in the shared folder, so a lost executor costs no more than a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of the tests' own only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder; the cluster may clear what is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed Parquet table, for what is large; it stays until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_by(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """As cut_table(), dealt by keys into n buckets: joins on them read it as it lies, however often."""
    name = f"cut_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{shared_folder(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)
