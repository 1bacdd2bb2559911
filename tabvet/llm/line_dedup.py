"""Line dedup with two Bloom filters.

One pass fills a filter of keys seen in one document and one of keys seen in
two or more. Only keys that the second filter suspects are shuffled, as a
128-bit digest and a document id; there they are counted exactly, and the
document that keeps the line is chosen. A false positive of the filters costs
a shuffled row and never changes the result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabvet.llm.common import SPACE, as_bytes, bits_for, bloom_has, bloom_pair, prepare, row_keys, saved, unused

MIN_CHARS = 20
MIN_DOCS = 3
#: Bits for each document's lines, and bounds of log2 of a filter's bits. The
#: upper bound is 64 MB for each filter; beyond it more keys are suspected.
BITS_PER_DOC, LOW_BITS, HIGH_BITS = 160, 20, 29


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, A-Z lower-cased line; None when shorter than ``min_chars`` code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    found = {line_key(x, min_chars) for x in text.split(b"\n")}
    found.discard(None)
    return found


def suspects(docs: DataFrame, text: str, min_chars: int):
    """Column function: digests of a text's keys that the filters have seen in two documents."""
    spark = docs.sparkSession
    bits_log2 = bits_for(docs.count(), BITS_PER_DOC, LOW_BITS, HIGH_BITS)

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for t in as_bytes(batch.column(0)) for k in _keys(t, min_chars)),
                           np.uint64)

    _, twice = bloom_pair(docs.select(text), hashes, bits_log2)
    shared = spark.sparkContext.broadcast(twice)

    @arrow_udf("array<binary>")
    def suspected(texts: pa.Array) -> pa.Array:
        bits, out = np.frombuffer(shared.value, np.uint8), []
        for t in as_bytes(texts):
            keys = sorted(_keys(t, min_chars))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            out.append([_digest(keys[i]) for i in np.flatnonzero(bloom_has(bits, h, bits_log2))])
        return pa.array(out, pa.list_(pa.binary()))

    return suspected


def _drop(min_chars: int):
    @arrow_udf("struct<text string, n_lines bigint, n_dropped bigint>")
    def drop(texts: pa.Array, gone: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for t, g in zip(as_bytes(texts), gone.to_pylist(), strict=True):
            lines, g = t.split(b"\n"), set(g or ())
            stay = [x for x in lines if not g or (k := line_key(x, min_chars)) is None or _digest(k) not in g]
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                                           pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])
    return drop


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, name: str = "lines") -> DataFrame:
    """``docs`` with a last column ``name`` (text, n_lines, n_dropped); if
    ``docs`` has a column of that name, the new one gets underscores behind it.

    A key is a line without white space at its ends, A-Z in lower case. Keys
    of at least ``min_chars`` code points that ``min_docs`` documents hold
    lose their lines everywhere but in the largest ``doc_id``. A null or empty
    text is one empty line. Documents are told apart by ``doc_id``: repeated
    rows of one id count once and are treated alike, rows with a null id count
    as one document, the smallest. All other columns pass unchanged; empty
    tables give empty results. Documents without a suspected key are never
    shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    keys, gone_keys, d, name = unused(docs.columns, "keys", "gone", "of", name)
    suspected = suspects(docs, text, min_chars)
    drop = _drop(min_chars)
    marked = docs.withColumn(keys, suspected(F.col(text)))
    held = saved(marked.where(F.size(keys) > 0).select(F.col(doc_id).alias("d"), F.explode(keys).alias("k")), "lines-suspected")
    shared = (held.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("keep"))
              .where(F.col("n") >= min_docs).select("k", "keep"))
    gone = saved(held.distinct().join(shared, "k").where(~F.col("d").eqNullSafe(F.col("keep")))
                 .groupBy(F.col("d").alias(d)).agg(F.collect_list("k").alias(gone_keys)), "lines-gone")
    # A text without a suspected key stays as it is; only the others are cut into lines again.
    body = F.coalesce(F.col(text), F.lit(""))
    n_lines = (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    whole = F.struct(body.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"))
    clean = marked.where(F.size(keys) == 0).withColumn(name, whole).drop(keys)
    dirty = marked.where(F.size(keys) > 0)
    dirty = dirty.join(gone, dirty[doc_id].eqNullSafe(gone[d]), "left").drop(gone[d])
    return clean.unionByName(dirty.withColumn(name, drop(F.col(text), F.col(gone_keys))).drop(keys, gone_keys))


def digest_columns(docs: DataFrame) -> DataFrame:
    """The thin query's columns."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its repeated lines removed and
    ``n_chars`` counted anew. Each row is a document by itself, also where rows
    share an id or have none; a line stays in the row of the largest id, a null
    one being the smallest, and of equal ids in one of their rows."""
    prepare(spark)
    row, own, lines = unused(docs.columns, "row", "own", "lines")
    rows = row_keys(docs, row).withColumn(own, F.struct(F.col("doc_id").alias("id"), F.col(row).alias("row")))
    out = dedup_lines(rows, own, name=lines)
    return out.select(*[F.col(f"{lines}.text").alias("text") if c == "text" else
                        F.length(f"{lines}.text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars"
                        else F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH lines AS (
  SELECT doc_id, r, i, line, length(key) AS n, key FROM (
    SELECT doc_id, r, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, r, unnest(parts) AS line, unnest(range(len(parts))) AS i
          FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}) a) b) c),
shared AS (SELECT key, max(doc_id) AS keep FROM lines WHERE n >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.keep AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key AND l.n >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r"""
