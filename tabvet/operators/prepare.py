"""Feature selection, target checks, sampling, splitting and encodings
(F1-F6, F9, F10).

Everything is a pure, seeded expression over the data, so a split or a
sample is re-computable on any cluster without carrying state.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.functions import constants as K
from tabvet.functions.exprs import column_classes, rnd, snapped
from tabvet.functions.quantiles import column_medians, column_quantiles

HASH_BUCKETS = 65536  # first 4 hex digits of the md5 order key


class TrainingError(RuntimeError):
    """Training cannot proceed; the message is meant for a user."""


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


# -------------------------------------------------------------------- F1
def select_features(profile: DataFrame, target: str, exclude: list[str] | None = None) -> DataFrame:
    """route each column to numeric / categorical / dropped with a reason.

    ``profile`` is :func:`tabvet.operators.profile.profiled` output (one row
    per column). Returns ``(position, column_name, role, reason)``.
    """
    asked = F.col("column_name").isin(list(exclude)) if exclude else F.lit(False)
    sem, n = F.col("semantic_type"), F.col("unique_count")
    as_number = F.col("type_class").isin("integral", "fractional", "boolean")
    # (condition, role, reason), the first that holds decides.
    rules = (
        (asked, "dropped", F.lit("left out on request")),
        (sem.isin("identifier", "constant", "empty", "text"), "dropped", F.concat(sem, F.lit(" column, nothing to learn from"))),
        (F.col("null_pct") >= K.FEATURE_MAX_NULL_PCT, "dropped", F.format_string("%d of 100 values absent", rnd("null_pct", 0).cast("long"))),
        (sem.isin("numeric", "categorical_numeric", "boolean") | ((sem == "binary") & as_number), "numeric", None),
        (sem.isin("categorical", "high_cardinality_categorical") & (n > K.FEATURE_MAX_CATEGORIES), "dropped",
         F.format_string(f"%d distinct texts, more than {K.FEATURE_MAX_CATEGORIES}", n)),
        (sem.isin("binary", "categorical", "high_cardinality_categorical"), "categorical", None),
        (F.lit(True), "dropped", F.concat(F.lit("no encoding for a column of type "), sem)),
    )
    role, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, its_role, its_reason in reversed(rules):
        role = F.when(condition, F.lit(its_role)).otherwise(role)
        reason = F.when(condition, F.lit(None).cast("string") if its_reason is None else its_reason).otherwise(reason)
    return profile.where(F.col("column_name") != target).select("position", "column_name", role.alias("role"), reason.alias("reason"))


# -------------------------------------------------------------------- F2
def target_checks(df: DataFrame, target: str, task: str, n_features: int | DataFrame) -> DataFrame:
    """the target checks as a table ``(check, passed, detail)``.

    ``n_features`` is the number of usable features (or an F1 table).
    """
    spark = df.sparkSession
    if target not in df.columns:
        return spark.createDataFrame(
            [("target_exists", False, f"The table has no column '{target}'.")],
            "check string, passed boolean, detail string")
    cls = dict(column_classes(df))[target]
    t = _col(target)
    stats = df.agg(F.count(t).alias("non_null"), F.count_distinct(t).alias("classes"))
    if isinstance(n_features, DataFrame):
        feats = n_features.agg(F.count_if(F.col("role") != "dropped").alias("n_features"))
    else:
        feats = spark.createDataFrame([(int(n_features),)], "n_features bigint")
    rows = stats.crossJoin(feats)
    checks = [
        F.struct(F.lit("target_exists").alias("check"), F.lit(True).alias("passed"),
                 F.lit(f"'{target}' is a column.").alias("detail")),
        F.struct(F.lit("target_not_all_null").alias("check"), (F.col("non_null") > 0).alias("passed"),
                 F.when(F.col("non_null") > 0, F.lit(f"'{target}' has values."))
                 .otherwise(F.lit(f"'{target}' holds nulls only.")).alias("detail")),
    ]
    if task == "classification":
        checks.append(F.struct(F.lit("two_classes").alias("check"), (F.col("classes") >= 2).alias("passed"),
                               F.format_string("'%s' has %d distinct values.", F.lit(target), F.col("classes"))
                               .alias("detail")))
    else:
        numeric = cls in ("integral", "fractional", "boolean")
        checks.append(F.struct(F.lit("numeric_target").alias("check"), F.lit(numeric).alias("passed"),
                               F.lit(f"'{target}' is {'numeric' if numeric else 'not numeric'}.")
                               .alias("detail")))
    checks.append(F.struct(F.lit("features_left").alias("check"), (F.col("n_features") >= 1).alias("passed"),
                           F.format_string("%d usable feature column(s).", F.col("n_features"))
                           .alias("detail")))
    return rows.select(F.inline(F.array(*checks)))


def validate_target(df: DataFrame, target: str, task: str, n_features: int | DataFrame) -> None:
    """F2 as a guard: raise :class:`TrainingError` on the first failed check."""
    failed = target_checks(df, target, task, n_features).where(~F.col("passed")).limit(1).collect()
    if failed:
        raise TrainingError(failed[0]["detail"])


# -------------------------------------------------------------------- F3
def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(_col(target).isNotNull())


# -------------------------------------------------------------------- F4
def order_key(key: str | Column, seed: int, salt: str = "") -> Column:
    """md5 of ``key|salt|seed``: a portable, seeded pseudo-random order."""
    k = _col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"|{salt}{seed}")))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = K.RANDOM_STATE) -> DataFrame:
    """a seeded sample of exactly ``min(n, rows)`` rows (smallest hash
    keys); a top-k per partition before one small merge."""
    h = order_key(key, seed)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


# -------------------------------------------------------------------- F5
#: Up to so many classes, the table of their quotas is broadcast, so that no row moves for its class.
BROADCAST_CLASSES = 100_000


def hash_digits(key: str, seed: int = K.RANDOM_STATE) -> Column:
    """The digits by which :func:`split` counts rows; hex digits order as the numbers they write."""
    return F.substring(order_key(key, seed), 1, 4)


def split(df: DataFrame, key: str, label: str | None = None, test_size: float = K.TEST_SIZE,
          seed: int = K.RANDOM_STATE, stratify: bool = True, digits: str | None = None) -> DataFrame:
    """adds ``is_test`` (boolean). ``n_test = ceil(test_size * n)``.

    Stratified by ``label`` when every class has at least 2 rows: class
    quotas by largest remainder (ties by class), rows ranked by
    ``md5(key|seed)`` inside each class. The rank is never computed by one
    task per class: rows are histogrammed on the first four hex digits of
    the hash, cumulative counts pick the boundary bucket per class, and only
    rows in that bucket are ranked (a 65,536th of the class on average).
    ``digits`` names a column (dropped here) that holds :func:`hash_digits`
    already, so that no row is hashed again.
    """
    few = True
    if label and stratify:
        classes = df.groupBy(_col(label)).count().agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("n")).first()
        stratify = bool(classes["least"] and classes["least"] >= 2)
        few = not stratify or classes["n"] <= BROADCAST_CLASSES
    h = order_key(key, seed)
    strat_col = _col(label) if (label and stratify) else F.lit(0)
    work = df.withColumn("_c", strat_col.cast("string"))
    work = work.withColumnRenamed(digits, "_b") if digits else work.withColumn("_b", hash_digits(key, seed))
    hist = work.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("cnt"))
    class_counts = hist.groupBy("_c").agg(F.sum("cnt").alias("n_c"))
    totals = class_counts.agg(F.sum("n_c").alias("n"), F.min("n_c").alias("min_c"),
                              F.count(F.lit(1)).alias("n_classes"))
    quotas = _quotas(class_counts, totals, test_size, label is not None and stratify)
    wc = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (hist.withColumn("cum", F.sum("cnt").over(wc))
           .withColumn("before", F.col("cum") - F.col("cnt"))
           .join(quotas, "_c")
           .where((F.col("before") < F.col("quota")) & (F.col("cum") >= F.col("quota")))
           .select("_c", F.col("_b").alias("edge_b"), (F.col("quota") - F.col("before")).alias("need")))
    # Classes whose quota is 0 have no boundary bucket: everything is train.
    tagged = work.join(F.broadcast(cum) if few else cum, "_c", "left")
    inner = tagged.where(F.col("_b") == F.col("edge_b")).withColumn("_h", h)
    wr = Window.partitionBy("_c").orderBy("_h", key)
    inner = inner.withColumn("is_test", F.row_number().over(wr) <= F.col("need"))
    outer = tagged.where(F.col("edge_b").isNull() | (F.col("_b") != F.col("edge_b"))).withColumn(
        "is_test", F.coalesce(F.col("_b") < F.col("edge_b"), F.lit(False)))
    return inner.drop("_h").unionByName(outer).drop("_b", "_c", "edge_b", "need")


def _quotas(class_counts: DataFrame, totals: DataFrame, test_size: float, stratified: bool) -> DataFrame:
    """Per-class test quotas (tiny table)."""
    t = class_counts.crossJoin(F.broadcast(totals))  # one row
    n_test = F.ceil(F.lit(float(test_size)) * F.col("n").cast("double"))
    use_strata = F.lit(stratified) & (F.col("min_c") >= 2)
    base = F.floor(n_test * F.col("n_c") / F.col("n"))
    rem = (n_test * F.col("n_c")) % F.col("n")
    t = t.withColumn("n_test", n_test).withColumn("base", base).withColumn("rem", rem)
    w = Window.orderBy(F.col("rem").desc(), F.col("_c").asc())
    t = t.withColumn("order", F.row_number().over(w)).withColumn(
        "short", F.col("n_test") - F.sum("base").over(Window.partitionBy(F.lit(1))))
    strat_quota = F.col("base") + F.when(F.col("order") <= F.col("short"), 1).otherwise(0)
    # Without strata: one pseudo-class holds everything. (Callers pass a
    # constant class when not stratifying; if strata are refused because a
    # class is a singleton, the plain split is taken per row below.)
    return t.select("_c", F.when(use_strata, strat_quota).otherwise(F.col("base")).cast("long")
                    .alias("quota"), use_strata.alias("stratified"))


# -------------------------------------------------------------------- F6
def quantile_edges(df: DataFrame, cols: list[str], bins: int = K.LEAK_BINS) -> DataFrame:
    """Edges for ``bins`` quantile bins (duplicate edges dropped) and the
    distinct count, ``bins`` + 1 standing for any more, per column
    ``(column_name, n_distinct, edges)``; the same rounds serve both."""
    return (column_quantiles(df, cols, [i / bins for i in range(bins + 1)], bins)
            .select("column_name", "n_distinct", F.array_sort(F.array_distinct("q")).alias("edges")))


def _num(c: str) -> Column:
    x = _col(c).cast("double")
    return F.when(~F.isnan(x), x)


def bin_expr(x: Column, edges: Column) -> Column:
    """Right-closed quantile bin (the first bin includes its left edge)."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0)))


def discretise(df: DataFrame, col: str, bins: int = K.LEAK_BINS) -> DataFrame:
    """adds ``<col>_bin`` (string): quantile bin for numeric columns with
    more than ``bins`` distinct values, else the value itself; null is its
    own category ``'nan'``."""
    numeric = dict(column_classes(df))[col] in ("integral", "fractional")
    if not numeric:
        return df.withColumn(f"{col}_bin", F.coalesce(_col(col).cast("string"), F.lit("nan")))
    e = quantile_edges(df, [col], bins).select("n_distinct", "edges")
    out = df.crossJoin(F.broadcast(e))
    value = F.when(F.col("n_distinct") > bins, bin_expr(_num(col), F.col("edges")).cast("string")) \
        .otherwise(_num(col).cast("string"))
    return out.withColumn(f"{col}_bin", F.coalesce(value, F.lit("nan"))).drop("n_distinct", "edges")


def discretised_long(df: DataFrame, target: str, features: list[str], bins: int = K.LEAK_BINS) -> DataFrame:
    """Target and every feature binned, unpivoted to ``(feature, x, y, n)``:
    how many rows have each pair of bins. Rows are counted by typed bins, and
    texts are made of these counts only."""
    classes = dict(column_classes(df))
    numeric = [c for c in [target, *features] if classes[c] in ("integral", "fractional")]
    edges = {}
    if numeric:  # at most ``bins`` + 1 edges for each column
        edges = {r["column_name"]: r["edges"] for r in quantile_edges(df, numeric, bins).where(F.col("n_distinct") > bins).collect()}

    def binned(c: str, prefix: str) -> list[Column]:
        """The bin, the number or the text that stands for a value."""
        place, number, text = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if c in edges:
            place = F.when(_num(c).isNotNull(), snapped(_num(c), edges[c], [max(i - 1, 0) for i in range(len(edges[c]) + 1)]))
        elif c in numeric:
            number = _num(c)
            text = F.when(number == 0, number.cast("string"))  # grouping takes -0.0 for 0.0
        else:
            text = _col(c).cast("string")
        return [place.alias(f"{prefix}_bin"), number.alias(f"{prefix}_num"), text.alias(f"{prefix}_text")]

    def as_text(prefix: str) -> Column:
        return F.coalesce(F.col(f"{prefix}_text"), F.col(f"{prefix}_bin").cast("string"), F.col(f"{prefix}_num").cast("string"), F.lit("nan")).alias(prefix)

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), *binned(f, "x")) for f in features])
    counted = (df.select(*binned(target, "y"), F.inline(pairs))
               .groupBy("feature", *[f"{p}_{kind}" for p in "xy" for kind in ("bin", "num", "text")]).agg(F.count(F.lit(1)).alias("n")))
    return counted.groupBy("feature", as_text("x"), as_text("y")).agg(F.sum("n").alias("n"))


# -------------------------------------------------------------------- F9
def numeric_prep_params(train: DataFrame, cols: list[str]) -> DataFrame:
    """F9 fitted on the training part: median for imputation, whether a
    missing indicator is needed, and mean / population std of the imputed
    column ``(column_name, median, has_nulls, mean, scale)``."""
    medians = column_medians(train, cols)
    structs = []
    for c in cols:
        x = _num(c)
        structs.append(F.struct(F.lit(c).alias("column_name"),
                                F.lit(medians[c]).cast("double").alias("median"),
                                (F.count_if(x.isNull()) > 0).alias("has_nulls"),
                                F.count(F.lit(1)).alias("n")))
    med = train.agg(F.array(*structs).alias("m")).select(F.inline("m"))
    wide = med.agg(*[F.first(F.when(F.col("column_name") == c, F.col("median")), ignorenulls=True)
                     .alias(f"m{i}") for i, c in enumerate(cols)])
    imputed = train.crossJoin(F.broadcast(wide))
    moments = []
    for i, c in enumerate(cols):
        v = F.coalesce(_num(c), F.col(f"m{i}"))
        moments.append(F.struct(F.lit(c).alias("column_name"), F.avg(v).alias("mean"),
                                F.stddev_pop(v).alias("std_pop")))
    mom = imputed.agg(F.array(*moments).alias("s")).select(F.inline("s"))
    return (med.join(mom, "column_name")
            .select("column_name", "median", "has_nulls", "mean",
                    F.when(F.col("std_pop") > 0, F.col("std_pop")).otherwise(F.lit(1.0)).alias("scale")))


# -------------------------------------------------------------------- F10
def categorical_prep_params(train: DataFrame, cols: list[str]) -> DataFrame:
    """F10 fitted on the training part: the most frequent value (lowest on
    ties) and the sorted category list ``(column_name, mode, categories)``."""
    parts = []
    for c in cols:
        v = _col(c).cast("string")
        counts = train.where(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
        parts.append(counts.agg(
            F.lit(c).alias("column_name"),
            F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"),
            F.array_sort(F.collect_list("value")).alias("categories")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
