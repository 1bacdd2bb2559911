"""Exact dedup with a heavy-hitter split.

Digests of whole texts are written once. A Misra-Gries pass names digests
that may be frequent; an exact count verifies them and finds each one's
winner, and that small table is broadcast, so rows of frequent texts are
decided on the map side. All other digests take an ordinary shuffle, in which
no group is large.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import ascii_lower, prepare, row_keys, saved, unused

#: Counters of a Misra-Gries summary: a digest with more than 1 in COUNTERS of
#: all rows is found for certain. The broadcast table has as many rows at most.
COUNTERS = 1024


def _summary(counts: dict, counters: int) -> None:
    """Shrink to ``counters`` entries by taking the next largest count off all."""
    if len(counts) > counters:
        off = sorted(counts.values(), reverse=True)[counters]
        for k in [k for k, v in counts.items() if v <= off]:
            del counts[k]
        for k in counts:
            counts[k] -= off


def frequent(digests: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """Digests that may exceed 1 in ``counters`` rows (a superset, at most ``counters``).

    Every task keeps a mergeable summary; summaries are merged in two levels
    of tasks, each of which again holds one summary.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for k, v in Counter(batch.column(0).to_pylist()).items():
                counts[k] = counts.get(k, 0) + v
            _summary(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         ["digest", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[k] = counts.get(k, 0) + v
            _summary(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         ["digest", "n"])

    schema = "digest binary, n bigint"
    parts = digests.select("digest").mapInArrow(local, schema)
    level = parts.repartition(16, F.spark_partition_id()).mapInArrow(merged, schema)
    return [bytes(r["digest"]) for r in level.coalesce(1).mapInArrow(merged, schema).collect()]


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest, and the column ``row``, if given, as ``row``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, so all null and empty texts are one group. The largest doc_id of a
    group stays (a null id only when no row of the group has one). Rows that
    share both id and text are one document: all of them have kept = true when
    theirs is the largest id, and each counts in group_size. Extra columns are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    more = ["row"] if row else []
    digests = saved(docs.select(F.col(doc_id).alias("doc_id"), *[F.col(row).alias("row") for _ in more],
                                F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)).alias("digest")), "digests")
    candidates = spark.createDataFrame([(bytearray(d),) for d in frequent(digests, counters)], "digest binary")
    winners = saved(digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest")
                    .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                    .where("group_size > 1"), "winners")
    hot = digests.join(F.broadcast(winners), "digest").select("doc_id", "keep_id", "group_size", "digest", *more)
    group = Window.partitionBy("digest")
    rest = (digests.join(F.broadcast(winners), "digest", "left_anti")
            .select("doc_id", F.max("doc_id").over(group).alias("keep_id"),
                    F.count(F.lit(1)).over(group).alias("group_size"), "digest", *more))
    return hot.unionByName(rest).select("doc_id", "keep_id", "group_size",
                                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", *more)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are decided
    one by one: of rows that share an id, each stays or goes with its own text."""
    prepare(docs.sparkSession)
    row, = unused(docs.columns, "row")
    rows = row_keys(docs, row)
    stay = decide(rows, doc_id, text, row=row).where("kept").select(F.col("row").alias(row))
    return rows.join(stay, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def digest_columns(docs: DataFrame) -> DataFrame:
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents) d"""
