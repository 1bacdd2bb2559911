"""Access to the parquet tables of a scale-factor folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores
    (one small file with one row group) over all of them. Large inputs
    already have enough splits and pass through untouched. Not applied by
    default: on small single-file inputs the extra shuffle cost more than
    it saved (measured), and at scale it never fires."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
