"""Deterministic cleaning with an account of every change.

Order is fixed: trim text, placeholders to null, drop empty columns, drop
duplicate rows. The source DataFrame is never changed (plans are lazy).
Decisions that change the schema (which columns to drop) come from one
aggregate whose result is one row per table, never the data itself.
"""
from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.constants import MISSING_MARKERS
from tabvet.functions.exprs import column_classes, is_marker, row_digest, shared_digests, strip
from tabvet.session import scratch_path

REPORT_SCHEMA = ("step int, action string, detail string, rows_affected bigint, "
                 "columns string")

TRIM_DETAIL = "Space at both ends of texts cut off."
MISSING_DETAIL = "Texts that stand for a missing value set to null."
EMPTY_DETAIL = "Columns of nulls dropped."
DEDUPE_DETAIL = "Repeats of whole rows dropped."

LOG = logging.getLogger(__name__)


def text_columns(df: DataFrame) -> list[str]:
    """Text-like columns: everything that is not numeric, datetime or boolean."""
    return [n for n, cls in column_classes(df) if cls == "string"]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


# -------------------------------------------------------------------- C1
def trim_text(df: DataFrame) -> DataFrame:
    """Strip leading/trailing whitespace (Python ``str.strip`` semantics)."""
    texts = set(text_columns(df))
    return df.select(*[(strip(_col(c)) if c in texts else _col(c)).alias(c) for c in df.columns])


def trim_counts(df: DataFrame) -> DataFrame:
    """Rows changed by C1 per text column ``(column_name, rows_changed)``."""
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, rows_changed bigint")
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.count_if(_col(c) != strip(_col(c))).alias("rows_changed"))
               for c in texts]
    return df.agg(F.array(*structs).alias("t")).select(F.inline("t"))


# -------------------------------------------------------------------- C2
def normalise_missing(df: DataFrame, markers=MISSING_MARKERS) -> DataFrame:
    """Placeholder texts (case-insensitive, after trimming) become null."""
    texts = set(text_columns(df))
    return df.select(*[
        (F.when(~is_marker(_col(c), markers) | _col(c).isNull(), _col(c)) if c in texts else _col(c))
        .alias(c) for c in df.columns])


def missing_counts(df: DataFrame, markers=MISSING_MARKERS) -> DataFrame:
    """Values turned into null by C2 per text column ``(column_name, n_nulled)``."""
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, n_nulled bigint")
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.count_if(_col(c).isNotNull() & is_marker(_col(c), markers)).alias("n_nulled"))
               for c in texts]
    return df.agg(F.array(*structs).alias("m")).select(F.inline("m"))


# -------------------------------------------------------------------- C3
def empty_columns(df: DataFrame) -> DataFrame:
    """Columns with no values ``(position, column_name)``."""
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                        F.count(_col(c)).alias("n"))
               for i, c in enumerate(df.columns)]
    return (df.agg(F.array(*structs).alias("e")).select(F.inline("e"))
            .where(F.col("n") == 0).select("position", "column_name"))


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop columns with no values. The decision is one aggregate whose
    result has at most one row per column."""
    empty = [r["column_name"] for r in empty_columns(df).orderBy("position").collect()]
    return df.drop(*empty), empty


# -------------------------------------------------------------------- C4
def drop_duplicate_rows(df: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """C4: exact duplicates removed (nulls compare equal).

    Rows with a digest of their own stay where they are; only rows of a
    ``shared`` digest (found first, unless given) are compared whole.
    """
    shared = shared if shared is not None else shared_digests(df)
    d1, d2 = row_digest(df)
    marked = df.select("*", d1.alias("_d1"), d2.alias("_d2")).join(shared.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "cnt").withColumnRenamed("cnt", "_cnt"),
                                                                  ["_d1", "_d2"], "left")
    cols = [_col(c) for c in df.columns]
    return marked.where("_cnt IS NULL").select(*cols).unionByName(marked.where("_cnt IS NOT NULL").select(*cols).dropDuplicates())


# -------------------------------------------------------------------- C5
@dataclass
class Cleaned:
    table: DataFrame
    report: DataFrame
    summary: DataFrame
    dropped_columns: list[str]


def clean(df: DataFrame, markers=MISSING_MARKERS) -> Cleaned:
    """The chain C1 -> C2 -> C3 -> C4 with a report of each action.

    ``report``: one row per action taken ``(step, action, detail,
    rows_affected, columns)``; ``summary``: rows and columns before and
    after plus ``changed``.
    """
    spark = df.sparkSession
    trimmed = trim_text(df)
    nulled = normalise_missing(trimmed, markers)
    texts = set(text_columns(df))
    # One scan for all counts: what trimming changes, what becomes null, what is left.
    counts = []
    for i, c in enumerate(df.columns):
        value, cut = _col(c), strip(_col(c))
        gone = cut.isNotNull() & is_marker(cut, markers)
        counts.append(F.struct(
            F.lit(i).alias("position"),
            (F.count_if(value != cut) if c in texts else F.lit(0).cast("long")).alias("trimmed"),
            (F.count_if(gone) if c in texts else F.lit(0).cast("long")).alias("nulled"),
            (F.count(F.when(value.isNotNull() & ~gone, 1)) if c in texts else F.count(value)).alias("left")))
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.array(*counts).alias("cols")).first()
    cols = [(df.columns[r["position"]], r) for r in facts["cols"]]
    dropped = [c for c, r in cols if r["left"] == 0]
    no_empty = nulled.drop(*dropped)
    # And one for the digests of rows that occur more than once, written as the table and its count both need them.
    path = scratch_path(spark, "shared-rows")
    shared_digests(no_empty).write.parquet(path)
    shared = spark.read.schema("d1 long, d2 long, cnt long").parquet(path)
    repeats = shared.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0))).first()[0]
    deduped = drop_duplicate_rows(no_empty, shared)

    cut, gone = [c for c, r in cols if r["trimmed"]], [c for c, r in cols if r["nulled"]]
    actions = [(1, "trim_whitespace", TRIM_DETAIL, 0, ",".join(cut), len(cut)),
               (2, "normalise_missing", MISSING_DETAIL, sum(r["nulled"] for _, r in cols), ",".join(sorted(gone)), len(gone)),
               (3, "drop_empty_columns", EMPTY_DETAIL, 0, ",".join(dropped), len(dropped)),
               (4, "drop_duplicate_rows", DEDUPE_DETAIL, repeats, "", repeats)]
    taken = [a[:-1] for a in actions if a[-1]]
    report = spark.createDataFrame(taken, REPORT_SCHEMA)
    summary = spark.createDataFrame([(facts["n"], facts["n"] - repeats, len(df.columns), len(no_empty.columns), bool(taken))],
                                    "rows_before long, rows_after long, columns_before long, columns_after long, changed boolean")
    return Cleaned(deduped, report, summary, dropped)


# -------------------------------------------------------------------- C6
def clean_or_raw(df: DataFrame, markers=MISSING_MARKERS) -> tuple[DataFrame, Cleaned | None]:
    """Cleaning is an improvement, not a prerequisite; on failure the
    raw table is used and no report is returned."""
    try:
        result = clean(df, markers)
        return result.table, result
    except Exception:  # noqa: BLE001 - any failure falls back to the raw table, on the record
        LOG.exception("cleaning failed; the raw table is used")
        return df, None
