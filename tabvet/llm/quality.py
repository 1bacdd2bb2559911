"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in Spark tasks. Trees are fitted on a bounded sample
of labelled rows, kept as flat arrays of perfect trees, broadcast, and walked
for whole batches at once with numpy.
"""
from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from tabvet.llm.common import as_bytes, prepare, table, unused

#: Labelled rows that the trees are fitted on, at most: those with the smallest hashes of their id.
SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, RIDGE = 100, 4, 64, 0.15, 1.0
THRESHOLD = 0.7

_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r\x0b\x0c", "newline": b"\n",
           "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|", "sign": b"#$%&*@^~+=<>_\\/", "quote": b"'\"()[]{}:;-`", "wide": range(128, 256)}
FEATURES = (*(f"share_{g}" for g in _GROUPS), "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "top_word",
            "same_as_last", "upper_words", "signed_words", "log_lines", "distinct_lines", "line_words", "worst_line")
_TABLE = np.zeros((256, len(_GROUPS)))
for _j, _codes in enumerate(_GROUPS.values()):
    _TABLE[list(_codes), _j] = 1.0


def statistics(text: bytes) -> list[float]:
    """The features of one text; all zero when it is empty."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _TABLE) / max(1, len(text))
    words = text.split()
    if not words:
        return [*shares, *([0.0] * (len(FEATURES) - len(shares)))]
    n, seen = len(words), Counter(words)
    same = list(map(operator.eq, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    worst = max(_oddness(x) for x in lines)
    return [*shares, np.log1p(len(text)), np.log1p(n), sum(map(len, words)) / n, float(max(map(len, seen))), len(seen) / n,
            max(seen.values()) / n, sum(same) / n, sum(c for w, c in seen.items() if w.isupper() and len(w) > 1) / n,
            sum(c for w, c in seen.items() if w[-1] in b"#$%&*!|@") / n, np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines), worst]


_ODD = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 97 <= b <= 122 or b in b".,'-"))


def _oddness(line: bytes) -> float:
    """Share of a line's bytes that are capitals or signs."""
    return 1.0 - len(line.translate(None, _ODD)) / len(line)


class Trees:
    """Perfect trees of one depth as flat arrays: node i has children 2i+1 and 2i+2."""

    def __init__(self, prior: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.prior, self.feature, self.cut, self.leaf = prior, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(cut)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log-loss; features are cut into at most BINS ranges."""
    n, width = x.shape
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(float(np.log(share / (1 - share))), np.zeros((ROUNDS, inner), np.int64), np.full((ROUNDS, inner), np.inf), np.zeros((ROUNDS, leaves)))
    total = np.full(n, trees.prior)
    columns = binned + np.arange(width) * BINS
    for t in range(ROUNDS):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2 ** level - 1, 2 ** level
            at = ((node - first)[:, None] * (width * BINS) + columns).ravel()
            shape = (wide, width, BINS)
            size = wide * width * BINS
            left = [np.bincount(at, np.repeat(v, width), size).reshape(shape).cumsum(axis=2) for v in (g, h)]
            whole = [v[:, :1, -1:] for v in left]
            right = [a - b for a, b in zip(whole, left, strict=True)]
            gain = sum(a * a / (b + RIDGE) for a, b in (left, right)) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[1] < 1e-3) | (right[1] < 1e-3)] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            for k in range(wide):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    trees.feature[t, first + k], trees.cut[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), trees.feature[t][node]] > trees.cut[t][node])
        leaf = node - inner
        trees.leaf[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += trees.leaf[t][leaf]
    return trees


def _features(docs: DataFrame) -> DataFrame:
    """(x, y) of rows (text, y)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])
    return docs.mapInArrow(run, "x array<double>, y double")


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees fitted on at most ``sample_rows`` labelled rows; None without any.

    Null labels and ids are passed over; of several labels of an id the
    largest counts, of several texts the smallest by code points.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
             .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One row for each id, so no more than sample_rows come to the driver.
    one = body.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = sorted(_features(one.select("text", "y")).collect())
    if not rows:
        return None
    return fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))


def score(docs: DataFrame, trees: Trees | None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score depends on the text alone: equal texts, repeated rows too, have
    equal scores, and null and empty texts that of all-zero statistics.
    Without trees (no labels) every score is 1, so nothing is rejected. Extra
    columns are not read; an empty table gives no rows.
    """
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_scores(some, trees, "text", "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def with_scores(docs: DataFrame, trees: Trees | None, text: str, name: str) -> DataFrame:
    """``docs`` row by row with the score of its text as a last column ``name``.
    Texts alone go to Python, and scores alone come back."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(trees)

    @arrow_udf(DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for at in range(0, len(texts), 256):
            rows = [statistics(t) for t in as_bytes(texts.slice(at, 256))]
            out.append(shared.value.score(np.array(rows)) if shared.value else np.ones(len(rows)))
        return pa.array(np.concatenate(out))

    return docs.withColumn(name, scores(F.col(text)))


def digest_columns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text the classifier rejects go; rows that
    share an id, or have none, are decided one by one."""
    trees = train(docs, table(spark, sf_dir, "labels"))
    name, = unused(docs.columns, "score")
    return with_scores(docs, trees, "text", name).where(F.col(name) >= THRESHOLD).drop(name)
