"""Pairwise-complete co-moments of many columns in one scan.

Every task keeps, for blocks of columns, four matrix products over its rows:
how many rows hold both columns of a pair, their sums, sums of squares and
sums of products, values shifted by the column's mean and nulls as zero with a
mask beside them. Blocks of all tasks are added up in Spark, and only the
pairs' coefficients leave.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.session import ship_package

#: Columns of a block, and rows of a product.
BLOCK, ROWS = 128, 4096
SUMS = "bi int, bj int, sums binary"


def pair_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(i, j, n, r)`` for every pair i < j of the numeric ``cols`` (by place)
    whose coefficient is defined over the rows that hold both.

    A task holds four numbers for each pair of columns, whatever its rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    values = [F.col(f"`{c}`").cast("double") for c in cols]
    values = df.select(*[F.when(~F.isnan(v), v).alias(f"v{j}") for j, v in enumerate(values)])
    row = values.agg(*[F.avg(c).alias(c) for c in values.columns]).first()
    means = np.array([0.0 if m is None or not np.isfinite(m) else m for m in row])
    blocks = [(a, min(a + BLOCK, len(cols))) for a in range(0, len(cols), BLOCK)]
    pairs = [(p, q) for p in range(len(blocks)) for q in range(p, len(blocks))]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns], axis=1) - means
                held = (~np.isnan(x)).astype(np.float64)
                x[held == 0] = 0.0
                for p, q in pairs:
                    (a, b), (c, d) = blocks[p], blocks[q]
                    one, two, m1, m2 = x[:, a:b], x[:, c:d], held[:, a:b], held[:, c:d]
                    new = np.stack([m1.T @ m2, one.T @ m2, m1.T @ two, (one * one).T @ m2, m1.T @ (two * two), one.T @ two])
                    sums[p, q] = sums[p, q] + new if (p, q) in sums else new
        for (p, q), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), pa.array([s.tobytes()])], ["bi", "bj", "sums"])

    def coefficients(p: int, q: int, s: np.ndarray) -> pa.RecordBatch:
        (a, b), (c, d) = blocks[p], blocks[q]
        n, sx, sy, xx, yy, xy = s.reshape(6, b - a, d - c)
        with np.errstate(all="ignore"):
            vx, vy, cov = xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n
            r = cov / np.sqrt(vx * vy)
            # No spread but that of rounding is none.
            flat = (vx <= np.maximum(1e-13 * xx, n * (1e-15 * means[a:b, None]) ** 2)) | (vy <= np.maximum(1e-13 * yy, n * (1e-15 * means[None, c:d]) ** 2))
        i, j = np.arange(a, b)[:, None] + 0 * n, np.arange(c, d)[None, :] + 0 * n
        keep = (i < j) & (n > 1) & ~flat & np.isfinite(r)
        return pa.RecordBatch.from_arrays([pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(n[keep].astype(np.int64)),
                                           pa.array(np.clip(r[keep], -1.0, 1.0))], ["i", "j", "n", "r"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for p, q, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(raw)
                if (p, q) == at:
                    total = total + s
                    continue
                if at:
                    yield coefficients(*at, total)
                at, total = (p, q), s
        if at:
            yield coefficients(*at, total)

    sums = values.mapInArrow(gram, SUMS)
    return sums.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(merged, "i int, j int, n bigint, r double")
