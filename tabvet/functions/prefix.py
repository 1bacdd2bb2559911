"""Exact running sums over a global order without a single-partition window.

Rows are cut into range buckets by split points taken from
``percentile_approx`` (any split points give the same, exact answer; they
only decide balance). Per-bucket totals are tiny; their running offsets are
broadcast back, and the running sum inside each bucket is a window that is
partitioned by bucket, so every bucket is its own task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str], buckets: int = 64,
                 inclusive: bool = False) -> DataFrame:
    """Adds ``<c>_before`` for each ``c`` in ``sum_cols``: the sum of ``c``
    over rows strictly earlier in ``order_col`` order (``inclusive`` adds the
    current row). ``order_col`` values should be distinct (pre-aggregate)."""
    probs = [i / buckets for i in range(1, buckets)]
    splits = df.agg(F.array_distinct(F.percentile_approx(order_col, probs, 10000)).alias("splits"))
    tagged = (df.crossJoin(F.broadcast(splits))
              .withColumn("_bucket", F.size(F.filter("splits", lambda s: s < F.col(order_col))))
              .drop("splits"))
    totals = tagged.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wt = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(wt), F.lit(0)).alias(f"_o_{c}")
                                         for c in sum_cols])
    frame_end = Window.currentRow if inclusive else -1
    wi = Window.partitionBy("_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, frame_end)
    out = tagged.join(F.broadcast(offsets), "_bucket")
    for c in sum_cols:
        out = out.withColumn(f"{c}_before", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wi), F.lit(0)))
    return out.drop("_bucket", *[f"_o_{c}" for c in sum_cols])


def col(name: str) -> Column:
    return F.col(name)
