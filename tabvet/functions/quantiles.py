"""Exact quantiles by radix selection.

A double's bits, with those of negatives turned round, order as the value does.
Sixteen bits at a time say in which of 65,536 bins a wanted rank lies: every
round counts the values of the bins that are still of interest, and only these
counts are shuffled, whatever the number of distinct values. After four rounds,
or as soon as a bin holds one value only, the value at the rank is known. There
is one plan for every size.

Quantiles interpolate linearly between the values at the two ranks around
``p * (n - 1)`` (``lo + (pos - floor(pos)) * (hi - lo)``), as pandas and DuckDB do.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from tabvet.session import scratch_path, ship_package

#: Bits below those that a round looks at.
SHIFTS = (48, 32, 16, 0)
BINS = "col int, b bigint, n bigint, lo bigint, hi bigint"


def sortable(x: np.ndarray) -> np.ndarray:
    """Integers that order as the doubles ``x`` do; -0.0 and 0.0 are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def unsorted(keys: np.ndarray) -> np.ndarray:
    """The doubles of :func:`sortable` integers."""
    keys = np.asarray(keys, np.int64)
    return np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys).view(np.float64)


def _binned(shift: int, wanted: list[np.ndarray] | None) -> Callable:
    """Counts and ends of the bins of each column, of the wanted ones of the round before only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)

        def merged(j: int) -> tuple[np.ndarray, ...]:
            b, n, lo, hi = (np.concatenate(x) for x in zip(*held[j], strict=True))
            order = np.argsort(b, kind="stable")
            b, first = np.unique(b[order], return_index=True)
            return b, np.add.reduceat(n[order], first), np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)

        for batch in batches:
            for j, column in enumerate(batch.columns):
                keys = sortable(column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                if wanted is not None and len(keys):
                    at = np.searchsorted(wanted[j], keys >> (shift + 16))
                    keys = keys[(at < len(wanted[j])) & (wanted[j][np.minimum(at, len(wanted[j]) - 1)] == keys >> (shift + 16))] if len(wanted[j]) else keys[:0]
                if len(keys):
                    keys.sort()
                    b, first, n = np.unique(keys >> shift, return_index=True, return_counts=True)
                    held[j].append((b, n, keys[first], keys[first + n - 1]))
                    if len(held[j]) >= 64:
                        held[j] = [merged(j)]
        for j in held:
            b, n, lo, hi = merged(j)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), j, np.int32)), *(pa.array(x.astype(np.int64)) for x in (b, n, lo, hi))],
                                             ["col", "b", "n", "lo", "hi"])
    return run


def select_ranks(df: DataFrame, cols: list[str], probs: list[float], distinct_up_to: int = 0) -> tuple[list[list[float] | None], list[int]]:
    """Quantiles of each numeric column (None without a value), and its number
    of distinct values, where more than ``distinct_up_to`` is one more than that.

    Nulls and NaN are passed over. What is collected has a row for each column
    and probability.
    """
    spark = df.sparkSession
    ship_package(spark)
    values = [F.col(f"`{c}`").cast("double") for c in cols]
    values = df.select(*[F.when(~F.isnan(v), v).alias(f"v{j}") for j, v in enumerate(values)])
    sizes, known = {}, {}  # n of a column; (column, rank) -> key
    asked: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (column, bin of the last round) -> (rank, rank within the bin)
    distinct, unsettled = dict.fromkeys(range(len(cols)), 0), {}  # column -> bins that may hold several values
    for shift in SHIFTS:
        last = shift == SHIFTS[0]
        wanted = None if last else [np.array(sorted({b for k, b in asked if k == j} | set(unsettled.get(j, ()))), np.int64) for j in range(len(cols))]
        bins = (values.mapInArrow(_binned(shift, wanted), BINS).groupBy("col", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .withColumn("parent", F.lit(0).cast("bigint") if last else F.shiftright("b", 16)).persist())
        if last:
            sizes = {r["col"]: r["n"] for r in bins.groupBy("col").agg(F.sum("n").alias("n")).collect()}
            for j, n in sizes.items():
                ranks = {int(np.floor(p * (n - 1))) for p in probs} | {int(np.ceil(p * (n - 1))) for p in probs}
                asked[j, 0] = [(k, k) for k in sorted(ranks)]
            unsettled = {j: [0] for j in sizes} if distinct_up_to else {}
        rows = [(j, b, rank, within) for (j, b), ranks in asked.items() for rank, within in ranks]
        so_far = Window.partitionBy("col", "parent").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        ranged = bins.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        hits = (ranged.join(F.broadcast(spark.createDataFrame(rows, "c int, p bigint, rank bigint, within bigint")),
                            (F.col("col") == F.col("c")) & (F.col("parent") == F.col("p")) & (F.col("within") >= F.col("before"))
                            & (F.col("within") < F.col("before") + F.col("n")))
                .select("col", "b", "rank", (F.col("within") - F.col("before")).alias("within"), "lo", "hi").collect()) if rows else []
        asked = {}
        for r in hits:
            if r["lo"] == r["hi"]:
                known[r["col"], r["rank"]] = r["lo"]
            else:
                asked.setdefault((r["col"], r["b"]), []).append((r["rank"], r["within"]))
        if unsettled:
            pairs = spark.createDataFrame([(j, b) for j, bs in unsettled.items() for b in bs], "c int, p bigint")
            few = Window.partitionBy("col").orderBy("b")
            found = defaultdict(list)
            for r in (bins.join(F.broadcast(pairs), (F.col("col") == F.col("c")) & (F.col("parent") == F.col("p"))).withColumn("i", F.row_number().over(few))
                      .where(F.col("i") <= distinct_up_to + 1).select("col", "b", "lo", "hi").collect()):
                found[r["col"]].append((r["b"], r["lo"] == r["hi"]))
            for j in list(unsettled):
                distinct[j] += sum(one for _, one in found[j])
                unsettled[j] = [b for b, one in found[j] if not one]
                if distinct[j] + len(unsettled[j]) > distinct_up_to:
                    distinct[j], unsettled[j] = distinct_up_to + 1, []
                if not unsettled[j]:
                    del unsettled[j]
        bins.unpersist()
        if not asked and not unsettled:
            break

    def at(j: int, p: float) -> float:
        pos = p * (sizes[j] - 1)
        lo, hi = (float(unsorted(np.array([known[j, int(f(pos))]]))[0]) for f in (np.floor, np.ceil))
        return lo + (pos - float(np.floor(pos))) * (hi - lo)

    return [[at(j, p) for p in probs] if sizes.get(j) else None for j in range(len(cols))], [distinct[j] for j in range(len(cols))]


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], distinct_up_to: int = 0) -> DataFrame:
    """Exact quantiles of several numeric columns ``(column_name, q, n_distinct)``,
    a row for each column with a value; ``n_distinct`` as in :func:`select_ranks`."""
    q, distinct = select_ranks(df, cols, probs, distinct_up_to)
    return df.sparkSession.createDataFrame([(c, x, n) for c, x, n in zip(cols, q, distinct, strict=True) if x is not None],
                                           "column_name string, q array<double>, n_distinct bigint")


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians by column."""
    return {c: x and x[0] for c, x in zip(cols, select_ranks(df, cols, [0.5])[0], strict=True)}


@arrow_udf(LongType())
def _sortable(x: pa.Array) -> pa.Array:
    return pa.array(sortable(x.to_numpy(zero_copy_only=False).astype(np.float64)))


def grouped_quantile(df: DataFrame, group: str, value: str, prob: float) -> DataFrame:
    """Exact quantile of ``value`` per ``group`` (null group kept) ``(group, q)``;
    groups without a value have no row. Groups may be many: ranks and bins stay in Spark."""
    ship_package(df.sparkSession)
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(f"`{group}`").alias("g"), v.alias("v")).withColumn("key", _sortable("v"))
    kept, asked, parts = [], None, []
    for shift in SHIFTS:
        some = rows.withColumn("p", F.lit(0).cast("bigint") if asked is None else F.shiftright("key", shift + 16))
        if asked is not None:
            open_ = asked.select(F.col("g").alias("g1"), F.col("p").alias("p1")).distinct()
            some = some.join(open_, F.col("g").eqNullSafe(F.col("g1")) & (F.col("p") == F.col("p1")), "left_semi")
        bins = some.groupBy("g", "p", F.shiftright("key", shift).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        so_far = Window.partitionBy("g", "p").orderBy("b")
        ranged = bins.withColumn("before", F.coalesce(F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if asked is None:
            ranged = ranged.withColumn("pos", (F.sum("n").over(Window.partitionBy("g")) - 1) * F.lit(float(prob)))
            hit = ranged.withColumn("r", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos"))))).withColumn("within", F.col("r"))
        else:
            want = asked.select(F.col("g").alias("g1"), F.col("p").alias("p1"), "pos", "r", "within")
            hit = ranged.join(want, F.col("g").eqNullSafe(F.col("g1")) & (F.col("p") == F.col("p1")))
        hit = (hit.where((F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("n")))
               .select("g", "pos", "r", (F.col("within") - F.col("before")).alias("within"), F.col("b").alias("p"), "lo", "hi")).persist()
        kept.append(hit)
        parts.append(hit.where("lo = hi").select("g", "pos", "r", "lo"))
        asked = hit.where("lo < hi")
        if asked.isEmpty():
            break
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    below, above = F.max(F.when(F.col("r") == F.floor("pos"), F.col("lo"))), F.max(F.when(F.col("r") == F.ceil("pos"), F.col("lo")))
    out = every.groupBy("g", "pos").agg(below.alias("x"), above.alias("y")).select(
        F.col("g").alias(group), (F.col("x") + (F.col("pos") - F.floor("pos")) * (F.col("y") - F.col("x"))).alias("q"))
    path = scratch_path(df.sparkSession, "group-quantiles")
    out.write.parquet(path)
    for hit in kept:
        hit.unpersist()
    return df.sparkSession.read.schema(out.schema).parquet(path)
