"""Benchmark decontamination with DataFrame functions only.

Test items are put in partitions by size. In each, an item's MinHash sketch
holds its smallest shingle hashes, as many as the partition's largest item
may miss and one more, so a document that holds the threshold's share of an
item's shingles meets its sketch for certain. Every document streams its
shingles of all widths past the sketches once, and the candidates found are
verified by the exact share of the item's shingles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tabvet.llm.common import prepare, row_keys, saved, table, unused

WORDS, PERCENT = 5, 80
#: Sketch entries that are broadcast, at most (about 40 bytes each); more are joined by a shuffle, which Spark may
#: spare most rows by a Bloom filter of its own.
BROADCAST_ROWS = 200_000
#: Places of a text that are taken at a time.
CHUNK = 4096


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _exploded(rows: DataFrame, widths: list[int], *keep: str, grams: bool = True) -> DataFrame:
    """A row for each place of every width: ``keep``, h (the words' hash), width and, if asked for, gram (the words).

    Long texts are taken in chunks of CHUNK places, so that the shifted copies
    of their words stay small.
    """
    most = max(widths)
    chunk = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("words"), F.lit(1)) - 1) / CHUNK).cast("int")),
                        lambda k: F.slice(F.col("words"), k * CHUNK + 1, F.lit(CHUNK + most - 1)))
    chunks = rows.select(*keep, F.explode(chunk).alias("words"))
    cols = [f"w{i}" for i in range(most)]
    places = chunks.select(*keep, F.inline(F.arrays_zip(*[F.slice("words", i + 1, CHUNK).alias(c) for i, c in enumerate(cols)])).alias(*cols))

    def of(n: int) -> list[Column]:
        return [F.when(F.col(cols[n - 1]).isNotNull(), F.xxhash64(*cols[:n])).alias("h"), F.lit(n).alias("width"), *[F.concat_ws(" ", *cols[:n]).alias("gram")] * grams]

    if len(widths) == 1:
        return places.select(*keep, *of(most)).where("h IS NOT NULL")
    return places.select(*keep, F.inline(F.array(*[F.struct(*of(n)) for n in widths]))).where("h IS NOT NULL")


def item_shingles(items: DataFrame, item_id: str, text: str, words: int) -> DataFrame:
    """(item, width, h, gram): distinct shingles; items of fewer words are one shingle of their width."""
    base = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    parts = [_exploded(base.where(F.size("words") >= n if n == words else F.size("words") == n), [n], "item") for n in range(1, words + 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every document
    that holds ``percent`` % or more of an item's distinct word shingles.

    Null and empty texts, of either side, hold nothing and are held by
    nothing. Items of fewer than ``words`` words must occur whole. Repeated
    ids are one document or item whose rows' shingles are united; null ids are
    an id of their own. Extra columns are not read. An empty table on either
    side gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    grams = saved(item_shingles(items, item_id, item_text, words), "items")
    sizes = grams.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    # Partitions by size: powers of two. Each has one sketch length.
    sizes = sizes.withColumn("part", F.floor(F.log2("size")).cast("int"))
    longest = sizes.groupBy("part").agg(F.max("size").alias("longest"))
    length = (F.col("longest") - F.ceil(F.col("longest") * percent / F.lit(100.0) - F.lit(1e-9)) + 1)
    known = sizes.join(longest, "part").select("item", "size", "part", length.alias("length"))
    by_hash = Window.partitionBy("item").orderBy("h", "gram")
    sized = grams.join(known.withColumnRenamed("item", "__item"), F.col("item").eqNullSafe(F.col("__item"))).drop("__item")
    sketch = saved(sized.withColumn("rank", F.row_number().over(by_hash)).where("rank <= length")
                   .select("item", "width", "h", "part", "size"), "sketches")
    widths = sorted(r["width"] for r in sketch.select("width").distinct().collect())  # words at most
    if not widths:
        return spark.createDataFrame([], _result(docs, doc_id, items, item_id))

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    met = sketch.select("item", "h", "width")
    met = F.broadcast(met) if sketch.count() <= BROADCAST_ROWS else met
    places = _exploded(read.select("doc_id", words_of(F.col("text")).alias("words")), widths, "doc_id", grams=False)
    candidates = saved(places.join(met, ["h", "width"]).select("doc_id", "item").distinct(), "candidates")

    # Exact verification: the shingles of candidate pairs' items against those of candidates' documents.
    wanted = candidates.select("doc_id").distinct()
    again = read.join(wanted, read["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    known = grams.select("h", "width", "gram").distinct()
    own = _exploded(again.select("doc_id", words_of(F.col("text")).alias("words")), widths, "doc_id").join(known, ["h", "width", "gram"], "left_semi").distinct()
    asked = grams.withColumnRenamed("item", "its").join(candidates, F.col("its").eqNullSafe(F.col("item"))).drop("its").withColumnRenamed("doc_id", "d")
    shared = (own.join(asked, (own["h"] == asked["h"]) & (own["width"] == asked["width"]) & (own["gram"] == asked["gram"]) & F.col("doc_id").eqNullSafe(F.col("d")))
              .groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("shared")))
    return (shared.join(sizes.select(F.col("item").alias("item_id"), F.col("size").alias("item_shingles")),
                        F.col("item").eqNullSafe(F.col("item_id"))).drop("item")
            .where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
            .select("doc_id", "item_id", "item_shingles", "shared",
                    (F.col("shared") / F.col("item_shingles")).alias("containment")))


def _result(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str):
    return StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("item_id", items.schema[item_id].dataType),
                       StructField("item_shingles", LongType()), StructField("shared", LongType()), StructField("containment", DoubleType())])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contained(docs, benchmark)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text holds a benchmark item are dropped; rows
    that share an id, or have none, are decided one by one."""
    prepare(spark)
    row, = unused(docs.columns, "row")
    rows = row_keys(docs, row)
    bad = contained(rows, table(spark, sf_dir, "benchmark"), row).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(bad, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
size AS (SELECT item_id, count(*) AS item_shingles FROM bg GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k) x),
hit AS (SELECT dg.doc_id, bg.item_id, count(*) AS shared FROM dg JOIN bg USING (k, gram) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM hit JOIN size USING (item_id) WHERE shared * 100 >= item_shingles * 80"""
