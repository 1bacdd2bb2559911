"""Reusable column expressions. Everything here stays inside codegen."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.constants import (
    AMBIGUOUS_FORMATS,
    AMBIGUOUS_SHAPE,
    DATE_SHAPE,
    DATETIME_FORMATS,
    ISO_SHAPE,
    MIN_SUBSTRING_KEYWORD,
    MISSING_MARKERS,
    TARGET_KEYWORDS,
)

# Leading/trailing whitespace in the Unicode sense (Python's str.strip).
_STRIP_PATTERN = r"(?U)^\s+|\s+$"


def type_class(dt: T.DataType) -> str:
    """Coarse storage class used by the semantic-type rules."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "fractional"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "unsupported"


def column_classes(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, type_class(f.dataType)) for f in df.schema.fields]


def strip(c: Column) -> Column:
    """Python-style strip: spaces, tabs, newlines and Unicode spaces."""
    return F.regexp_replace(c, _STRIP_PATTERN, "")


def is_marker(c: Column, markers=MISSING_MARKERS) -> Column:
    """True when a text value is a placeholder for missing data."""
    return F.lower(strip(c)).isin(list(markers))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """NaN and +/-Inf become null (JSON-safe numbers)."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def parse_datetime(c: Column, day_first: Column | None = None) -> Column:
    """First successful parse among the fixed formats, else null. Times with a
    zone are their instant, others are UTC; ``day_first`` says how dates like
    1/5/2020 are meant in their column (month first unless given)."""
    tries = [F.when(c.rlike(rx), F.try_to_timestamp(c, F.lit(fmt))) for rx, fmt, _ in DATETIME_FORMATS]
    day = F.lit(False) if day_first is None else F.coalesce(day_first, F.lit(False))
    for rx, (month_fmt, _), (day_fmt, _) in AMBIGUOUS_FORMATS:
        tries.append(F.when(c.rlike(rx), F.when(day, F.try_to_timestamp(c, F.lit(day_fmt))).otherwise(F.try_to_timestamp(c, F.lit(month_fmt)))))
    zone = F.regexp_replace(F.regexp_extract(c, ISO_SHAPE, 2), "^([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso = F.concat(F.substring(c, 1, 10), F.lit("T"), F.substring(c, 12, 8), F.regexp_extract(c, ISO_SHAPE, 1), F.when(zone == "", "Z").otherwise(zone))
    tries.append(F.when(c.rlike(ISO_SHAPE), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"))))
    return F.when(c.rlike(DATE_SHAPE), F.coalesce(*tries))


#: What every text that :func:`parse_datetime` can parse looks like.
_ANY_SHAPE = "|".join(f"(?:{rx})" for rx in [f[0] for f in DATETIME_FORMATS + AMBIGUOUS_FORMATS] + [ISO_SHAPE])


def looks_like_date(c: Column) -> Column:
    """False for texts that :func:`parse_datetime` makes null whatever the column: one match, where parsing tries every format,
    and that only for texts with a separator where some format has its first one, or eight digits."""
    at = lambda i: F.substring(c, i, 1)
    separated = at(5).isin("-", "/") | at(2).isin("-", "/") | at(3).isin("-", "/") | (at(4) == " ")
    return (separated | (F.length(c) == 8)) & c.rlike(DATE_SHAPE) & c.rlike(_ANY_SHAPE)


def has_slashes(c: Column) -> Column:
    """True for the texts that :func:`day_first` learns from."""
    return ((F.substring(c, 2, 1) == "/") | (F.substring(c, 3, 1) == "/")) & c.rlike(AMBIGUOUS_SHAPE)


def day_first(c: Column) -> Column:
    """Aggregate over a text column: whether its dates with slashes have the
    day first, as some first number is above 12 and no second one is."""
    first, second = (F.regexp_extract(c, AMBIGUOUS_SHAPE, i).try_cast("int") for i in (1, 2))
    return (F.coalesce(F.max(first), F.lit(0)) > 12) & (F.coalesce(F.max(second), F.lit(0)) <= 12)


def name_suggests_target(c: Column) -> Column:
    """Token match on the keywords, substring match for long keywords."""
    lowered = F.lower(c)
    tokens = F.split(lowered, "[^a-z0-9]+")
    token_hit = F.arrays_overlap(tokens, F.array(*[F.lit(k) for k in TARGET_KEYWORDS]))
    long_kws = [k for k in TARGET_KEYWORDS if len(k) >= MIN_SUBSTRING_KEYWORD]
    substring_hit = F.lit(False)
    for k in long_kws:
        substring_hit = substring_hit | F.contains(lowered, F.lit(k))
    return F.coalesce(token_hit, F.lit(False)) | substring_hit


def rnd(c, digits: int) -> Column:
    """Round half up on the binary value: ``floor(x * 10^d + 0.5) / 10^d``.

    Written the same way in the oracle SQL, so both engines agree bit for
    bit (Spark's ``round`` works on the decimal form, DuckDB's on the binary
    value; they disagree on ties).
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10 ** digits))
    return F.floor(c * scale + F.lit(0.5)) / scale


def hash_order(*cols: Column) -> Column:
    """Portable deterministic ordering key (md5 hex agrees across engines)."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits of a whole row as two hashes ``d1, d2``; nulls count, and 0.0 equals -0.0 as in a group-by."""
    cols = [F.col(f"`{n}`") + F.lit(0.0) if cls == "fractional" and dict(df.dtypes)[n] in ("double", "float") else F.col(f"`{n}`")
            for n, cls in column_classes(df)]
    nulls = F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(F.lit(seed), nulls, *cols).alias(f"d{seed}") for seed in (1, 2)]


def shared_digests(df: DataFrame) -> DataFrame:
    """``(d1, d2, cnt)`` of the rows that occur more than once: only digests are shuffled, hot ones combined before."""
    return df.select(*row_digest(df)).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def snapped(x: Column, cuts: list[float], values: list[float]) -> Column:
    """``values[i]``, where ``i`` is the number of ``cuts`` (ascending) below ``x``, by a binary search."""
    if not cuts:
        return F.lit(values[0])
    mid = len(cuts) // 2
    return F.when(x <= F.lit(cuts[mid]), snapped(x, cuts[:mid], values[:mid + 1])).otherwise(snapped(x, cuts[mid + 1:], values[mid + 1:]))
