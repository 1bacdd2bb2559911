"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a seeded hash. A copy's virtual finish
time is the source's words up to and with that copy, divided by the source's
weight. All copies are range-sorted by finish time and cut where the total
budget is used up; a source that may repeat no further simply has no more
copies in the queue, so its share falls to the others by weight.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from tabvet.llm.common import as_bytes, prepare, row_keys, saved, unused

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
#: Rows that one task orders when running sums are made.
ROWS_PER_BUCKET = 2_000


@arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of words: runs of anything but ASCII white space."""
    counts = [len(t.split()) for at in range(0, len(texts), 256) for t in as_bytes(texts.slice(at, 256))]
    return pa.array(counts, pa.int64())


def ranked_sources(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """source, n (its words), rows, rank (from 0, by code point, null last) and weight.

    Sources may be many, as web hosts are: they are ranked by a range sort, of
    which the driver sees the number of sources of each range only.
    """
    spark = sized.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [F.col("source").isNull(), F.col("source")]
    sums = saved(sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).repartitionByRange(lanes, *order)
                 .withColumn("lane", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, []
    for r in sums.groupBy("lane").agg(F.count(F.lit(1)).alias("k")).orderBy("lane").collect():  # a row for each task
        offsets.append((r["lane"], before))
        before += r["k"]
    known = sums.join(F.broadcast(spark.createDataFrame(offsets, "lane int, offset bigint")), "lane")
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("lane").orderBy(*order)) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return saved(known.withColumn("rank", rank).select(
        "source", "n", "rows", "rank", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight")), "mix-ranked")


def water_level(sources: DataFrame, repeats: int) -> float:
    """Words for a unit of weight, when no source gets more than ``repeats`` times its own.

    Each round shares what the full sources leave by weight among the others;
    the level only rises, so a source once full stays full.
    """
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("n") * repeats
        r = sources.where("n > 0").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
                                       F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("held"), F.count(F.when(over, 1)).alias("full")).first()
        if r["full"] == full or not r["open"]:
            return level
        level, full = (r["n"] - repeats * r["held"]) / r["open"], r["full"]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 17, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    copies, and the column ``row``, if given, as ``row``.

    ``weights`` are given to the sources in code-point order, null last, again
    and again. Sizes are words; null and empty texts have none, and take no
    part. Order within a source depends on the seed, doc_id and size (with
    ``row``, a key of each row, on seed, doc_id and text), so reruns agree;
    rows equal in all of these are interchangeable. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    more = ["row"] if row else []
    sized = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *[F.col(row).alias("row") for _ in more],
                              word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text) if row else F.lit("")).alias("r"))
                  .withColumn("r", F.col("r") if row else F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    sources = ranked_sources(sized, weights)
    level, budget = water_level(sources, repeats), sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cap = (F.col("n") * repeats).cast("double")
    plan = sources.select(F.col("source").alias("own"), "rank", F.col("n").alias("source_size"), "weight",
                          F.least(F.col("weight") * F.lit(level), cap).alias("target"), F.ceil(F.col("rows") / ROWS_PER_BUCKET).cast("int").alias("buckets"))
    known = sized.join(plan, sized["source"].eqNullSafe(plan["own"])).drop("own")

    # Exact running sums in shuffled order: hash ranges of a source are summed
    # apart and joined by the sums of the ranges before them.
    bucket = F.floor((F.col("r").cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)) * F.col("buckets")).cast("int")
    known = known.withColumn("bucket", F.least(F.greatest(bucket, F.lit(0)), F.col("buckets") - 1))
    before = (known.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("n")).drop("n"))
    within = Window.partitionBy("rank", "bucket").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = saved(known.withColumn("cum", F.sum("size").over(within)).join(before, ["rank", "bucket"])
                   .withColumn("cum", F.col("cum") + F.col("before")).drop("before", "bucket", "buckets"), "mix-queue")

    # The global sort and its cut.
    copies = (queued.where("size > 0")
              .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
              .withColumn("finish", _finish(F.col("turn"))))
    keys = ["finish", "rank", "turn"]
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = saved(copies.select(*keys, "size").repartitionByRange(lanes, *keys)
                   .withColumn("lane", F.spark_partition_id()), "mix-sorted")
    used, cut = 0, None
    for lane in ranged.groupBy("lane").agg(F.sum("size").alias("n")).orderBy("lane").collect():  # a row for each task
        if used + lane["n"] > budget:
            running = F.sum("size").over(Window.partitionBy("lane").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
            cut = (ranged.where(F.col("lane") == lane["lane"]).withColumn("run", running)
                   .where(F.col("run") > budget - used).orderBy(*keys).select(*keys).first())
            break
        used += lane["n"]
    taken = F.lit(0)
    for turn in range(repeats):
        taken = taken + F.when(_before(cut, turn), 1).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target",
                         F.when(F.col("size") > 0, taken).otherwise(0).alias("copies"), *more)


def _finish(turn):
    return (turn * F.col("source_size") + F.col("cum")).cast("double") / F.col("weight")


def _before(cut, turn: int):
    """Whether the copy of that turn stands before the first copy beyond the budget.

    Finish times of a source's copies differ, so time, source and turn order all copies.
    """
    if cut is None:
        return F.lit(True)
    mine = F.struct(_finish(F.lit(turn)).alias("finish"), F.col("rank"), F.lit(turn).alias("turn"))
    edge = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["rank"]).cast("bigint").alias("rank"), F.lit(cut["turn"]).cast("int").alias("turn"))
    return mine < edge


def digest_columns(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the mix takes, with a last column ``copies``, how
    often it takes each (underscores behind it if ``docs`` has that name).
    Rows are taken one by one, also where they share an id or have none, and
    their words times copies stay within the budget."""
    prepare(spark)
    row, copies = unused(docs.columns, "row", "copies")
    rows = row_keys(docs, row)
    plan = mix(rows, row=row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("bigint").alias(copies))
    return rows.join(plan, row).select(*[f"`{c}`" for c in docs.columns], copies)
