"""The registered queries: key -> (spark callable, oracle SQL or None).

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the whole of the given tables (or relations Spark derives from them).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabvet.operators import profile as P
from tabvet.plans import oracle_profile as OP
from tabvet.sources.fixtures import relation

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = (fn, oracle)
        return fn
    return deco


def _on(rel: str, op, *args, **kwargs) -> Query:
    return lambda spark, sf: op(relation(spark, sf, rel), *args, **kwargs)


def _reg(key: str, fn: Query, oracle: str | None) -> None:
    REGISTRY[key] = (fn, OP.fix_round(oracle) if oracle else None)


# ---------------------------------------------------------------- profiling
_reg("column_profile", _on("lineitem", P.column_profile), OP.column_profile("lineitem"))
_reg("profile_shape", _on("fx_dirty_orders", P.shape), OP.shape("fx_dirty_orders"))
_reg("profile_nulls",
     lambda s, sf: P.column_profile(relation(s, sf, "fx_dirty_orders")).select(
         "column_name", "null_count", "null_pct"),
     f"SELECT column_name, null_count, null_pct FROM ({OP.column_profile('fx_dirty_orders')}) t")
_reg("profile_distinct",
     lambda s, sf: P.column_profile(relation(s, sf, "fx_dirty_orders")).select(
         "column_name", "unique_count", "unique_pct"),
     f"SELECT column_name, unique_count, unique_pct FROM ({OP.column_profile('fx_dirty_orders')}) t")
_reg("semantic_types",
     lambda s, sf: P.column_profile(relation(s, sf, "fx_dirty_orders")).select(
         "column_name", "dtype", "semantic_type"),
     f"SELECT column_name, dtype, semantic_type FROM ({OP.column_profile('fx_dirty_orders')}) t")
for _rel in ("orders", "part", "documents", "events"):
    _reg(f"semantic_types_{_rel}",
         (lambda r: lambda s, sf: P.column_profile(relation(s, sf, r)).select(
             "column_name", "dtype", "semantic_type"))(_rel),
         f"SELECT column_name, dtype, semantic_type FROM ({OP.column_profile(_rel)}) t")
_reg("datetime_strings", _on("fx_dirty_orders", P.datetime_candidates),
     OP.datetime_candidates("fx_dirty_orders"))
_reg("datetime_shapes", _on("fx_dates", P.datetime_candidates), OP.datetime_candidates("fx_dates"))
_reg("datetime_shape_stats", _on("fx_dates", P.datetime_string_stats), OP.datetime_string_stats("fx_dates"))
_reg("sample_values", _on("fx_dirty_orders", P.sample_values), OP.sample_values("fx_dirty_orders"))
_reg("sample_values_documents", _on("documents", P.sample_values), OP.sample_values("documents"))
_reg("numeric_stats",
     lambda s, sf: P.numeric_stats(relation(s, sf, "lineitem")).select(
         "column_name", "n", "min", "max", "mean", "median", "std", "q1", "q3", "iqr"),
     f"SELECT column_name, n, min, max, mean, median, std, q1, q3, iqr FROM ({OP.numeric_stats('lineitem')}) t")
_reg("numeric_skew",
     lambda s, sf: P.numeric_stats(relation(s, sf, "events")).select("column_name", "n", "skew"),
     f"SELECT column_name, n, skew FROM ({OP.numeric_stats('events')}) t")
_reg("zero_negative",
     lambda s, sf: P.numeric_stats(relation(s, sf, "lineitem")).select(
         "column_name", "zero_count", "negative_count"),
     f"SELECT column_name, zero_count, negative_count FROM ({OP.numeric_stats('lineitem')}) t")
_reg("iqr_outliers", _on("events", P.iqr_outliers), OP.iqr_outliers("events"))
_reg("iqr_outliers_documents", _on("documents", P.iqr_outliers), OP.iqr_outliers("documents"))
_reg("profile_top_values", _on("fx_dirty_orders", P.top_values), OP.top_values("fx_dirty_orders"))
_reg("profile_top_values_lineitem", _on("lineitem", P.top_values), OP.top_values("lineitem"))
_reg("datetime_stats", _on("lineitem", P.datetime_stats), OP.datetime_stats("lineitem"))
_reg("datetime_string_stats", _on("fx_dirty_orders", P.datetime_string_stats),
     OP.datetime_string_stats("fx_dirty_orders"))
_reg("text_stats", _on("documents", P.text_stats), OP.text_stats("documents"))
_reg("correlations", _on("fx_sum", P.correlations), OP.correlations("fx_sum"))
_reg("correlations_lineitem", _on("lineitem", P.correlations), OP.correlations("lineitem"))
_reg("duplicate_rows", _on("fx_dirty_orders", P.duplicate_rows), OP.duplicate_rows("fx_dirty_orders"))
_reg("column_bytes", _on("lineitem", P.column_bytes), OP.column_bytes("lineitem"))
_reg("quality_warnings", _on("fx_dirty_orders", P.quality_warnings),
     OP.quality_warnings("fx_dirty_orders"))
_reg("quality_warnings_events", _on("events", P.quality_warnings), OP.quality_warnings("events"))
_reg("quality_warnings_fx_sum", _on("fx_sum", P.quality_warnings), OP.quality_warnings("fx_sum"))
_reg("warning_counts", _on("fx_dirty_orders", P.warning_counts), OP.warning_counts("fx_dirty_orders"))
_reg("target_candidates", _on("fx_dirty_orders", P.target_candidates),
     OP.target_candidates("fx_dirty_orders"))
_reg("target_candidates_fx_leak", _on("fx_leak", P.target_candidates), OP.target_candidates("fx_leak"))
_reg("target_name_match",
     lambda s, sf: P.target_name_match(relation(s, sf, "part"), "p_type"),
     f"SELECT p_type AS name, {OP.name_match_sql('p_type')} AS suggests_target FROM part")
_reg("profile_document", _on("fx_dirty_orders", P.profile_document), None)
_reg("profile_digest", _on("fx_dirty_orders", P.profile_digest), None)


# ---------------------------------------------------------------- cleaning
from tabvet.functions.constants import MISSING_MARKERS  # noqa: E402
from tabvet.operators import ask as Q  # noqa: E402
from tabvet.operators import clean as C  # noqa: E402
from tabvet.sources.fixtures import with_ctes  # noqa: E402

_DIRTY_COLS = [n for n, _ in OP.SCHEMAS["fx_dirty_orders"]]
_DIRTY_TEXT = [n for n, d in OP.SCHEMAS["fx_dirty_orders"] if d == "string"]
_MARKERS_SQL = ", ".join(OP.lit(m) for m in MISSING_MARKERS)


def _trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _null_sql(c: str) -> str:
    return f"CASE WHEN lower({_trim_sql(c)}) IN ({_MARKERS_SQL}) THEN NULL ELSE {c} END"


def _dirty_select(fn) -> str:
    return ", ".join((fn(c) + f" AS {c}") if c in _DIRTY_TEXT else c for c in _DIRTY_COLS)


_TRIMMED = f"SELECT {_dirty_select(_trim_sql)} FROM fx_dirty_orders"
_NULLED_AFTER_TRIM = f"SELECT {', '.join((_null_sql(c) + ' AS ' + c) if c in _DIRTY_TEXT else c for c in _DIRTY_COLS)} FROM ({_TRIMMED}) t"


def _dirty(spark, sf):
    return relation(spark, sf, "fx_dirty_orders")


_reg("clean_trim", lambda s, sf: C.trim_text(_dirty(s, sf)), with_ctes(_TRIMMED, "fx_dirty_orders"))
_reg("clean_trim_counts", lambda s, sf: C.trim_counts(_dirty(s, sf)), with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} <> {_trim_sql(c)}) AS BIGINT) AS rows_changed FROM fx_dirty_orders"
    for c in _DIRTY_TEXT), "fx_dirty_orders"))
_reg("clean_missing", lambda s, sf: C.normalise_missing(_dirty(s, sf)),
     with_ctes(f"SELECT {_dirty_select(_null_sql)} FROM fx_dirty_orders", "fx_dirty_orders"))
_reg("clean_missing_counts", lambda s, sf: C.missing_counts(_dirty(s, sf)), with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NOT NULL AND lower({_trim_sql(c)}) IN ({_MARKERS_SQL})) AS BIGINT) AS n_nulled FROM fx_dirty_orders"
    for c in _DIRTY_TEXT), "fx_dirty_orders"))
_reg("clean_empty_columns",
     lambda s, sf: C.empty_columns(C.normalise_missing(C.trim_text(_dirty(s, sf)))),
     with_ctes(" UNION ALL ".join(
         f"SELECT {i} AS position, '{c}' AS column_name FROM ({_NULLED_AFTER_TRIM}) n HAVING count({c}) = 0"
         for i, c in enumerate(_DIRTY_COLS)), "fx_dirty_orders"))
_reg("clean_dedupe", lambda s, sf: C.drop_duplicate_rows(_dirty(s, sf)),
     with_ctes("SELECT DISTINCT * FROM fx_dirty_orders", "fx_dirty_orders"))
_CLEAN_KEEP = [c for c in _DIRTY_COLS if c not in ("junk", "empty_col")]
_reg("clean_table", lambda s, sf: C.clean(_dirty(s, sf)).table,
     with_ctes(f"SELECT DISTINCT {', '.join(_CLEAN_KEEP)} FROM ({_NULLED_AFTER_TRIM}) t", "fx_dirty_orders"))
_reg("clean_report", lambda s, sf: C.clean(_dirty(s, sf)).report, with_ctes(f"""
SELECT * FROM (
SELECT 1 AS step, 'trim_whitespace' AS action, '{C.TRIM_DETAIL}' AS detail, CAST(0 AS BIGINT) AS rows_affected,
       string_agg(column_name, ',' ORDER BY position) AS columns, count(*) AS n FROM (
  {" UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS column_name FROM fx_dirty_orders HAVING count_if({c} <> {_trim_sql(c)}) > 0" for i, c in enumerate(_DIRTY_COLS) if c in _DIRTY_TEXT)}) t
UNION ALL
SELECT 2, 'normalise_missing', '{C.MISSING_DETAIL}', CAST(sum(n) AS BIGINT), string_agg(column_name, ',' ORDER BY column_name), count(*) FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NOT NULL AND lower({c}) IN ({_MARKERS_SQL})) AS n FROM ({_TRIMMED}) t0 HAVING n > 0" for c in _DIRTY_TEXT)}) t
UNION ALL
SELECT 3, 'drop_empty_columns', '{C.EMPTY_DETAIL}', CAST(0 AS BIGINT), string_agg(column_name, ',' ORDER BY position), count(*) FROM (
  {" UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS column_name FROM ({_NULLED_AFTER_TRIM}) t1 HAVING count({c}) = 0" for i, c in enumerate(_DIRTY_COLS))}) t
UNION ALL
SELECT 4, 'drop_duplicate_rows', '{C.DEDUPE_DETAIL}', a - b, '', a - b FROM
  (SELECT count(*) AS a FROM ({_NULLED_AFTER_TRIM}) t2) x,
  (SELECT count(*) AS b FROM (SELECT DISTINCT {', '.join(_CLEAN_KEEP)} FROM ({_NULLED_AFTER_TRIM}) t3) y) z
) r WHERE n > 0""".replace("SELECT * FROM (", "SELECT step, action, detail, rows_affected, columns FROM (", 1), "fx_dirty_orders"))
_reg("clean_summary", lambda s, sf: C.clean(_dirty(s, sf)).summary, with_ctes(f"""
SELECT (SELECT count(*) FROM fx_dirty_orders) AS rows_before,
       (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_CLEAN_KEEP)} FROM ({_NULLED_AFTER_TRIM}) t) d) AS rows_after,
       CAST({len(_DIRTY_COLS)} AS BIGINT) AS columns_before, CAST({len(_CLEAN_KEEP)} AS BIGINT) AS columns_after,
       true AS changed""", "fx_dirty_orders"))
_reg("clean_then_profile",
     lambda s, sf: P.column_profile(C.clean(_dirty(s, sf)).table).select(
         "column_name", "semantic_type", "null_count", "unique_count"), None)


# ---------------------------------------------------------------- ad-hoc questions
def _fx(sql: str) -> str:
    return with_ctes(sql, "fx_dirty_orders")


_reg("ask_overview", lambda s, sf: Q.overview(_dirty(s, sf)), _fx(" UNION ALL ".join(
    f"SELECT (SELECT count(*) FROM fx_dirty_orders) AS rows, {i} AS position, '{c}' AS column_name, "
    f"'{'numeric' if OP.cls_of(d) in ('integral', 'fractional', 'boolean') else 'text'}' AS kind, "
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, count(DISTINCT {c}) AS distinct FROM fx_dirty_orders"
    for i, (c, d) in enumerate(OP.SCHEMAS["fx_dirty_orders"]))))
_reg("ask_describe_numeric", lambda s, sf: Q.describe(_dirty(s, sf), "price"), _fx("""
SELECT 'price' AS column_name, CAST(count_if(price IS NULL) AS BIGINT) AS nulls,
       round(CAST(count_if(price IS NULL) AS DOUBLE) / count(*) * 100, 2) AS null_pct,
       count(DISTINCT price) AS distinct, min(price) AS min, max(price) AS max, avg(price) AS mean,
       median(price) AS median, CASE WHEN count(price) > 1 THEN stddev_samp(price) END AS std
FROM fx_dirty_orders"""))
_reg("ask_describe_text", lambda s, sf: Q.describe(_dirty(s, sf), "Status_Raw"), _fx("""
SELECT 'status_raw' AS column_name, h.nulls, h.null_pct, h.distinct, CAST(c.rank AS INTEGER) AS rank, c.value, c.count
FROM (SELECT CAST(count_if(status_raw IS NULL) AS BIGINT) AS nulls,
             round(CAST(count_if(status_raw IS NULL) AS DOUBLE) / count(*) * 100, 2) AS null_pct,
             count(DISTINCT status_raw) AS distinct FROM fx_dirty_orders) h,
     (SELECT value, count, row_number() OVER (ORDER BY count DESC, value ASC) AS rank FROM (
        SELECT status_raw AS value, count(*) AS count FROM fx_dirty_orders WHERE status_raw IS NOT NULL GROUP BY 1) g) c
WHERE c.rank <= 10"""))
_reg("ask_top_values", lambda s, sf: Q.top(relation(s, sf, "lineitem"), "l_suppkey", 10), """
SELECT 'l_suppkey' AS column_name, CAST(rank AS INTEGER) AS rank, CAST(v AS VARCHAR) AS value, count,
       round(CAST(count AS DOUBLE) / (SELECT count(*) FROM lineitem) * 100, 2) AS pct
FROM (SELECT v, count, row_number() OVER (ORDER BY count DESC, v ASC) AS rank FROM (
        SELECT l_suppkey AS v, count(*) AS count FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1) g) t
WHERE rank <= 10""")


def _agg_sql(rel: str, group: str, stat: str, metric_name: str, fixture: bool) -> str:
    sql = f"""
SELECT '{group}' AS group_by, '{metric_name}' AS metric_name, CAST(rank AS INTEGER) AS rank,
       CAST(g AS VARCHAR) AS "group", metric, total_groups > 25 AS truncated, total_groups
FROM (SELECT g, metric, row_number() OVER (ORDER BY metric DESC NULLS LAST, g ASC NULLS FIRST) AS rank,
             count(*) OVER () AS total_groups
      FROM (SELECT {group} AS g, {stat} AS metric FROM {rel} GROUP BY {group}) a) t
WHERE rank <= 25"""
    return _fx(sql) if fixture else sql


_reg("ask_agg_count", lambda s, sf: Q.aggregate(relation(s, sf, "lineitem"), "l_suppkey"),
     _agg_sql("lineitem", "l_suppkey", "CAST(count(*) AS DOUBLE)", "count", False))
_reg("ask_agg_mean", lambda s, sf: Q.aggregate(_dirty(s, sf), "priority_raw", "price", "mean"),
     _agg_sql("fx_dirty_orders", "priority_raw", "avg(price)", "mean_price", True))
_reg("ask_agg_sum", lambda s, sf: Q.aggregate(_dirty(s, sf), "cust_id", "price", "sum"),
     _agg_sql("fx_dirty_orders", "cust_id", "coalesce(sum(price), 0.0)", "sum_price", True))
_reg("ask_agg_median", lambda s, sf: Q.aggregate(_dirty(s, sf), "status_raw", "price", "median"),
     _agg_sql("fx_dirty_orders", "status_raw", "median(price)", "median_price", True))
_reg("ask_agg_min", lambda s, sf: Q.aggregate(_dirty(s, sf), "priority_raw", "price", "min"),
     _agg_sql("fx_dirty_orders", "priority_raw", "min(price)", "min_price", True))
_reg("ask_agg_max", lambda s, sf: Q.aggregate(_dirty(s, sf), "priority_raw", "price", "max"),
     _agg_sql("fx_dirty_orders", "priority_raw", "max(price)", "max_price", True))


def _count_sql(column: str, condition: str, pred: str) -> str:
    return _fx(f"""
SELECT '{column}' AS column_name, '{condition}' AS condition, CAST(count_if({pred}) AS BIGINT) AS matched,
       count(*) AS total, round(CAST(count_if({pred}) AS DOUBLE) / count(*) * 100, 2) AS pct
FROM fx_dirty_orders""")


for _key, _col, _op, _val, _pred in [
    ("ask_count_eq", "status_raw", "==", "O", "coalesce(status_raw = 'O', false)"),
    ("ask_count_ne", "cust_id", "!=", "5", "(cust_id IS NULL OR CAST(cust_id AS DOUBLE) <> 5.0)"),
    ("ask_count_gt", "price", ">", "250000", "coalesce(price > 250000.0, false)"),
    ("ask_count_lt", "price", "<", "100000.5", "coalesce(price < 100000.5, false)"),
    ("ask_count_ge", "status_raw", ">=", "O", "coalesce(status_raw >= 'O', false)"),
    ("ask_count_le", "cust_id", "<=", "100", "coalesce(CAST(cust_id AS DOUBLE) <= 100.0, false)"),
    ("ask_count_contains", "status_raw", "contains", "n", "coalesce(regexp_matches(status_raw, '(?i)n'), false)"),
    ("ask_count_isnull", "price", "isnull", None, "price IS NULL"),
    ("ask_count_notnull", "cust_id", "notnull", None, "cust_id IS NOT NULL"),
]:
    _cond = f"{_col} {_op} {_val if _val is not None else ''}".strip()
    _reg(_key, (lambda c, o, v: lambda s, sf: Q.count_where(_dirty(s, sf), c, o, v))(_col, _op, _val),
         _count_sql(_col, _cond, _pred))
_reg("ask_correlation",
     lambda s, sf: Q.correlation(relation(s, sf, "lineitem"), "l_quantity", "l_extendedprice"), """
SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, corr(l_quantity, l_extendedprice) AS pearson_r
FROM lineitem""")
_reg("ask_batch", lambda s, sf: Q.ask_batch(_dirty(s, sf), [
    ("DatasetOverview", {}), ("DescribeColumn", {"column": "price"}),
    ("TopValues", {"column": "status_raw", "n": 3}),
    ("Aggregate", {"group_by": "priority_raw", "agg": "count"}),
    ("CountRows", {"column": "price", "operator": ">", "value": "abc"}),
    ("Correlation", {"column_a": "price", "column_b": "o_orderkey"}),
    ("NoSuchTool", {})]), None)


# ---------------------------------------------------------------- features, split, leakage
from tabvet.functions import constants as K  # noqa: E402
from tabvet.operators import leakage as LK  # noqa: E402
from tabvet.operators import metrics as M  # noqa: E402
from tabvet.operators import prepare as FP  # noqa: E402


def _prof_fx(rel: str, select: str, extra_ctes: str = "") -> str:
    return OP.wrap(rel, OP.profiled_sql(rel) + extra_ctes, select)


_SELECT_FEATURES_SQL = """
SELECT position, column_name,
  CASE WHEN semantic_type IN ('identifier', 'constant', 'empty', 'text') THEN 'dropped'
       WHEN null_pct >= 80 THEN 'dropped'
       WHEN semantic_type IN ('numeric', 'categorical_numeric', 'boolean') THEN 'numeric'
       WHEN semantic_type = 'binary' THEN CASE WHEN type_class IN ('integral', 'fractional', 'boolean') THEN 'numeric' ELSE 'categorical' END
       WHEN semantic_type IN ('categorical', 'high_cardinality_categorical') THEN CASE WHEN unique_count > 100 THEN 'dropped' ELSE 'categorical' END
       ELSE 'dropped' END AS role,
  CASE WHEN semantic_type IN ('identifier', 'constant', 'empty', 'text') THEN semantic_type || ' column, nothing to learn from'
       WHEN null_pct >= 80 THEN printf('%d of 100 values absent', CAST(round(null_pct, 0) AS BIGINT))
       WHEN semantic_type IN ('numeric', 'categorical_numeric', 'boolean', 'binary') THEN NULL
       WHEN semantic_type IN ('categorical', 'high_cardinality_categorical') THEN CASE WHEN unique_count > 100 THEN printf('%d distinct texts, more than 100', unique_count) END
       ELSE 'no encoding for a column of type ' || semantic_type END AS reason
FROM prof WHERE column_name <> '{target}'"""

_reg("select_features",
     lambda s, sf: FP.select_features(P.profiled(_dirty(s, sf)), "status_raw"),
     _prof_fx("fx_dirty_orders", _SELECT_FEATURES_SQL.format(target="status_raw")))
_reg("select_features_part",
     lambda s, sf: FP.select_features(P.profiled(relation(s, sf, "part")), "p_size"),
     _prof_fx("part", _SELECT_FEATURES_SQL.format(target="p_size")))
_reg("target_checks",
     lambda s, sf: FP.target_checks(_dirty(s, sf), "price", "regression",
                                    FP.select_features(P.profiled(_dirty(s, sf)), "price")),
     _prof_fx("fx_dirty_orders", """
SELECT * FROM (VALUES ('target_exists', true, '''price'' is a column.')) v("check", passed, detail)
UNION ALL SELECT 'target_not_all_null', count(price) > 0, CASE WHEN count(price) > 0 THEN '''price'' has values.' ELSE '''price'' holds nulls only.' END FROM fx_dirty_orders
UNION ALL SELECT 'numeric_target', true, '''price'' is numeric.'
UNION ALL SELECT 'features_left', n >= 1, printf('%d usable feature column(s).', n) FROM (
  SELECT count(*) AS n FROM (""" + _SELECT_FEATURES_SQL.format(target="price") + """) f WHERE role <> 'dropped') c"""))
_reg("drop_null_target", lambda s, sf: FP.drop_null_target(_dirty(s, sf), "price"),
     _fx("SELECT * FROM fx_dirty_orders WHERE price IS NOT NULL"))
_reg("seeded_sample", lambda s, sf: FP.sample_rows(relation(s, sf, "fx_sum"), 1000, "row_id", 42),
     with_ctes("SELECT * FROM fx_sum ORDER BY md5(row_id || '|42'), row_id LIMIT 1000", "fx_sum"))
_reg("split_stratified",
     lambda s, sf: FP.split(relation(s, sf, "fx_leak"), "row_id", "survived").select("row_id", "survived", "is_test"),
     with_ctes("""
SELECT row_id, survived, rn <= quota AS is_test FROM (
  SELECT f.row_id, f.survived, q.quota,
         row_number() OVER (PARTITION BY f.survived ORDER BY md5(CAST(f.row_id AS VARCHAR) || '|42'), f.row_id) AS rn
  FROM fx_leak f JOIN (
    SELECT c, base + CASE WHEN ord <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM (
      SELECT c, base, n_test, row_number() OVER (ORDER BY rem DESC, CAST(c AS VARCHAR) ASC) AS ord FROM (
        SELECT c, n_c, n_test, floor(n_test * n_c / n) AS base, (n_test * n_c) % n AS rem FROM (
          SELECT survived AS c, count(*) AS n_c, sum(count(*)) OVER () AS n,
                 ceil(CAST(0.2 AS DOUBLE) * CAST(sum(count(*)) OVER () AS DOUBLE)) AS n_test
          FROM fx_leak GROUP BY survived) a) b) c0) q ON f.survived = q.c) t""", "fx_leak"))
_reg("split_plain",
     lambda s, sf: FP.split(relation(s, sf, "fx_sum"), "row_id", None, stratify=False).select("row_id", "is_test"),
     with_ctes("""
SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42'), row_id)
               <= ceil(CAST(0.2 AS DOUBLE) * CAST(count(*) OVER () AS DOUBLE)) AS is_test FROM fx_sum""", "fx_sum"))

_PROBS = ", ".join(repr(i / 12) for i in range(13))


def _bin_sql(col: str, edges: str, nd: str) -> str:
    return (f"coalesce(CASE WHEN {col} IS NULL THEN NULL WHEN {nd} > 12 THEN CAST(greatest(len(list_filter({edges}, lambda e: e < CAST({col} AS DOUBLE))) - 1, 0) AS VARCHAR) "
            f"ELSE CAST(CAST({col} AS DOUBLE) AS VARCHAR) END, 'nan')")


_reg("quantile_bins",
     lambda s, sf: FP.discretise(relation(s, sf, "fx_sum"), "fare").groupBy(F_col_bin := "fare_bin").agg(
         __import__("pyspark.sql.functions", fromlist=["count"]).count("*").alias("n"))
     .withColumnRenamed("fare_bin", "bin"),
     with_ctes(f"""
SELECT bin, count(*) AS n FROM (
  SELECT CASE WHEN e.nd > 12 THEN CAST(greatest(len(list_filter(e.edges, lambda x: x < f.fare)) - 1, 0) AS VARCHAR)
              ELSE CAST(f.fare AS VARCHAR) END AS bin
  FROM fx_sum f, (SELECT count(DISTINCT fare) AS nd, list_sort(list_distinct(quantile_cont(fare, [{_PROBS}]))) AS edges FROM fx_sum) e) t
GROUP BY bin""", "fx_sum"))


def _nmi_sql(rel: str, target: str, target_numeric: bool, features: list[tuple[str, bool]]) -> str:
    numeric = ([target] if target_numeric else []) + [f for f, num in features if num]
    edges = ", ".join(f"count(DISTINCT CAST({c} AS DOUBLE)) AS nd_{c}, list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{_PROBS}]))) AS ed_{c}"
                      for c in numeric) or "1 AS dummy"

    def b(c: str, num: bool) -> str:
        return _bin_sql(c, f"ed_{c}", f"nd_{c}") if num else f"coalesce(CAST({c} AS VARCHAR), 'nan')"

    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {b(f, num)} AS x, {b(target, target_numeric)} AS y FROM base, e"
                              for f, num in features)
    return with_ctes(f"""
SELECT column_name, score, score >= {K.LEAKAGE_NMI_THRESHOLD} AS leaked FROM sc""", rel) \
        .replace("\nSELECT column_name, score, score >=",
                 f""",
base AS (SELECT * FROM {rel} WHERE {target} IS NOT NULL),
e AS (SELECT {edges} FROM base),
ct AS (SELECT feature, x, y, count(*) AS n FROM ({long}) l GROUP BY feature, x, y),
ct2 AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS bigN, sum(n) OVER (PARTITION BY feature, x) AS nx,
               sum(n) OVER (PARTITION BY feature, y) AS ny FROM ct),
mi AS (SELECT feature, sum(CAST(n AS DOUBLE) / bigN * ln(CAST(n AS DOUBLE) * bigN / (CAST(nx AS DOUBLE) * ny))) AS mi,
              count(DISTINCT x) AS kx, count(DISTINCT y) AS ky, sum(CASE WHEN x <> 'nan' THEN n ELSE 0 END) AS non_null
       FROM ct2 GROUP BY feature),
hx AS (SELECT feature, sum(-CAST(c AS DOUBLE) / bigN * ln(CAST(c AS DOUBLE) / bigN)) AS hx FROM (
         SELECT feature, x, first(nx) AS c, first(bigN) AS bigN FROM ct2 GROUP BY feature, x) t GROUP BY feature),
hy AS (SELECT feature, sum(-CAST(c AS DOUBLE) / bigN * ln(CAST(c AS DOUBLE) / bigN)) AS hy FROM (
         SELECT feature, y, first(ny) AS c, first(bigN) AS bigN FROM ct2 GROUP BY feature, y) t GROUP BY feature),
sc AS (SELECT mi.feature AS column_name, round(CASE WHEN kx = 1 AND ky = 1 THEN 1.0
                 WHEN greatest(mi, 0.0) = 0 THEN 0.0
                 ELSE greatest(mi, 0.0) / greatest((hx + hy) / 2, 2.220446049250313e-16) END, 4) AS score
       FROM mi JOIN hx ON mi.feature = hx.feature JOIN hy ON mi.feature = hy.feature WHERE non_null > 0)
SELECT column_name, score, score >=""", 1)


_reg("leakage_nmi",
     lambda s, sf: LK.detect_leakage(relation(s, sf, "fx_leak"), "survived", ["alive", "fare", "pclass"])
     .select("column_name", "score", "leaked"),
     _nmi_sql("fx_leak", "survived", True, [("alive", False), ("fare", True), ("pclass", False)]))
_reg("leakage_nmi_missing",
     lambda s, sf: LK.detect_leakage(relation(s, sf, "fx_missing"), "label", ["measured", "noise"])
     .select("column_name", "score", "leaked"),
     _nmi_sql("fx_missing", "label", True, [("measured", True), ("noise", True)]))
_reg("additive_leakage",
     lambda s, sf: LK.detect_additive(relation(s, sf, "fx_sum"), "total", ["fare", "tip"]).select(
         __import__("tabvet.functions.exprs", fromlist=["rnd"]).rnd("r2", 5).alias("r2"), "is_derived", "contributors"),
     with_ctes("""
SELECT round(r2, 5) AS r2, r2 >= 0.99 AS is_derived,
       CASE WHEN abs(ba) >= abs(bb) THEN 'fare,tip' ELSE 'tip,fare' END AS contributors FROM (
  SELECT (ba * say + bb * sby) / syy AS r2, ba, bb FROM (
    SELECT (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb,
           say, sby, syy FROM (
      SELECT var_pop(fare) AS saa, var_pop(tip) AS sbb, covar_pop(fare, tip) AS sab,
             covar_pop(fare, total) AS say, covar_pop(tip, total) AS sby, var_pop(total) AS syy FROM fx_sum) m) c) r""", "fx_sum"))
_reg("impute_median",
     lambda s, sf: FP.numeric_prep_params(relation(s, sf, "fx_missing"), ["measured", "noise"]).select(
         "column_name", "median"),
     with_ctes("SELECT 'measured' AS column_name, median(measured) AS median FROM fx_missing "
               "UNION ALL SELECT 'noise', median(noise) FROM fx_missing", "fx_missing"))
_reg("missing_indicators",
     lambda s, sf: FP.numeric_prep_params(relation(s, sf, "fx_missing"), ["measured", "noise"]).select(
         "column_name", "has_nulls"),
     with_ctes("SELECT 'measured' AS column_name, count_if(measured IS NULL) > 0 AS has_nulls FROM fx_missing "
               "UNION ALL SELECT 'noise', count_if(noise IS NULL) > 0 FROM fx_missing", "fx_missing"))
_reg("standard_scale",
     lambda s, sf: FP.numeric_prep_params(relation(s, sf, "fx_missing"), ["measured", "noise"]).select(
         "column_name", "mean", "scale"),
     with_ctes("""
SELECT 'measured' AS column_name, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS scale
FROM (SELECT coalesce(measured, (SELECT median(measured) FROM fx_missing)) AS v FROM fx_missing) a
UNION ALL SELECT 'noise', avg(v), CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END
FROM (SELECT coalesce(noise, (SELECT median(noise) FROM fx_missing)) AS v FROM fx_missing) b""", "fx_missing"))
_reg("impute_mode",
     lambda s, sf: FP.categorical_prep_params(C.clean(_dirty(s, sf)).table, ["status_raw", "priority_raw"])
     .select("column_name", "mode"),
     with_ctes(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, (SELECT v FROM (
  SELECT {c} AS v, count(*) AS n FROM (SELECT DISTINCT {', '.join(_CLEAN_KEEP)} FROM ({_NULLED_AFTER_TRIM}) t) d
  WHERE {c} IS NOT NULL GROUP BY 1) g ORDER BY n DESC, v ASC LIMIT 1) AS mode""" for c in ("status_raw", "priority_raw")),
               "fx_dirty_orders"))
_reg("one_hot",
     lambda s, sf: FP.categorical_prep_params(C.clean(_dirty(s, sf)).table, ["status_raw", "priority_raw"])
     .select("column_name", __import__("pyspark.sql.functions", fromlist=["posexplode"]).posexplode("categories")
             .alias("index", "category")),
     with_ctes(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS index, v AS category
FROM (SELECT DISTINCT {c} AS v FROM (SELECT DISTINCT {', '.join(_CLEAN_KEEP)} FROM ({_NULLED_AFTER_TRIM}) t) d WHERE {c} IS NOT NULL) g"""
                                  for c in ("status_raw", "priority_raw")), "fx_dirty_orders"))

# ---------------------------------------------------------------- metrics
_reg("classification_metrics",
     lambda s, sf: M.classification_metrics(
         relation(s, sf, "fx_scores").selectExpr("label", "CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS pred"),
         "label", "pred"),
     with_ctes("""
SELECT sum(tp) / sum(support) AS accuracy, sum(prec * support) / sum(support) AS precision,
       sum(rec * support) / sum(support) AS recall,
       sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support) / sum(support) AS f1
FROM (SELECT support, tp, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS prec,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec FROM (
  SELECT cls.y, coalesce((SELECT sum(n) FROM cm WHERE cm.y = cls.y), 0) AS support,
         coalesce((SELECT sum(n) FROM cm WHERE cm.p = cls.y), 0) AS predicted,
         coalesce((SELECT sum(n) FROM cm WHERE cm.y = cls.y AND cm.p = cls.y), 0) AS tp
  FROM (SELECT y FROM cm UNION SELECT p FROM cm) cls) per) m""", "fx_scores").replace(
         "\nSELECT sum(tp)", ",\ncm AS (SELECT label AS y, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS p, count(*) AS n FROM fx_scores GROUP BY 1, 2)\nSELECT sum(tp)", 1))
_reg("roc_auc", lambda s, sf: M.roc_auc(relation(s, sf, "fx_scores"), "label", "proba"), with_ctes("""
SELECT CASE WHEN k = 2 AND P > 0 AND N > 0 THEN u / (CAST(P AS DOUBLE) * N) END AS roc_auc FROM (
  SELECT sum(pos * (neg_before + 0.5 * neg)) AS u, sum(pos) AS P, sum(neg) AS N FROM (
    SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before FROM (
      SELECT CAST(proba AS DOUBLE) AS s, count_if(label = 1) AS pos, count_if(label <> 1) AS neg
      FROM fx_scores WHERE label IS NOT NULL AND proba IS NOT NULL GROUP BY 1) g) r) a,
  (SELECT count(DISTINCT label) AS k FROM fx_scores WHERE label IS NOT NULL) kk""", "fx_scores"))
_reg("regression_metrics", lambda s, sf: M.regression_metrics(relation(s, sf, "fx_scores"), "y", "y_hat"),
     with_ctes("""
SELECT CASE WHEN vp > 0 THEN 1 - sse / (vp * n) ELSE CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END END AS r2,
       mae, sqrt(sse / n) AS rmse, sse / n AS mse FROM (
  SELECT sum((y - y_hat) * (y - y_hat)) AS sse, avg(abs(y - y_hat)) AS mae, var_pop(y) AS vp, count(*) AS n FROM fx_scores) a""",
               "fx_scores"))


# ---------------------------------------------------------------- quality gate
import datetime as _dt  # noqa: E402

from tabvet.operators import ledger as R  # noqa: E402
from tabvet.operators import quality as G  # noqa: E402


def _runs(s, sf):
    return relation(s, sf, "fx_runs")


def _imps(s, sf):
    return relation(s, sf, "fx_importances")


_MISSING_CTE = """mflag AS (
  SELECT run_id, max(CASE WHEN encoded LIKE 'missing:%' OR encoded LIKE '%(was missing)' THEN 1 ELSE 0 END) = 1 AS missing_top,
         coalesce(string_agg(CASE WHEN encoded LIKE 'missing:%' OR encoded LIKE '%(was missing)' THEN encoded END, ', ' ORDER BY r), '') AS missing_names
  FROM (SELECT run_id, encoded, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, encoded ASC) AS r FROM fx_importances) t
  WHERE r <= 5 GROUP BY run_id),
rr AS (SELECT f.*, coalesce(m.missing_top, false) AS missing_top, coalesce(m.missing_names, '') AS missing_names
       FROM fx_runs f LEFT JOIN mflag m ON f.run_id = m.run_id)"""

_CHECKS_SQL = """checks AS (
SELECT run_id, 1 AS ord, 'class_separation' AS name, roc_auc >= 0.65 AS passed, true AS gating,
       CASE WHEN roc_auc < 0.65 THEN printf('ROC-AUC %.4f, under the gate of 0.65.', roc_auc)
            ELSE printf('ROC-AUC %.4f, gate 0.65 met.', roc_auc) END AS detail
FROM rr WHERE task_type = 'classification' AND roc_auc IS NOT NULL
UNION ALL SELECT run_id, 2, 'f1_threshold', primary_value >= 0.6, true,
       CASE WHEN primary_value < 0.6 THEN printf('F1 %.4f, under the gate of 0.6.', primary_value)
            ELSE printf('F1 %.4f, gate 0.6 met.', primary_value) END
FROM rr WHERE task_type = 'classification'
UNION ALL SELECT run_id, 3, 'variance_explained', primary_value >= 0.3, true,
       CASE WHEN primary_value < 0.3 THEN printf('R2 %.4f, under the gate of 0.3.', primary_value)
            ELSE printf('R2 %.4f, gate 0.3 met.', primary_value) END
FROM rr WHERE task_type = 'regression'
UNION ALL SELECT run_id, 4, 'target_leakage', leaked_count = 0, false,
       CASE WHEN leaked_count = 0 THEN 'Leak scan clean.'
            ELSE printf('%d leaking column(s) taken out.', leaked_count) END
FROM rr
UNION ALL SELECT run_id, 5, 'plausibility', false, false,
       printf('%s reached %.4f, which real data rarely allow: look for a leak.',
              CASE WHEN task_type = 'classification' THEN 'f1' ELSE 'r2' END, primary_value)
FROM rr WHERE primary_value >= 0.98
UNION ALL SELECT run_id, 6, 'target_is_derived', NOT derived_target, true,
       CASE WHEN derived_target THEN 'A linear mix of the features gives the target.'
            ELSE 'No linear mix of the features gives the target.' END FROM rr
UNION ALL SELECT run_id, 7, 'informative_missingness', false, false,
       printf('Among the top features, absence itself: %s. New data must lack values in the same way.', missing_names)
FROM rr WHERE missing_top
UNION ALL SELECT run_id, 8, 'sample_size', n_train >= 200, true,
       CASE WHEN n_train < 200 THEN printf('%d training rows, fewer than 200.', n_train)
            ELSE printf('%d training rows, enough.', n_train) END FROM rr)"""

_VERDICT_SQL = """verd AS (
SELECT r.run_id,
       CASE WHEN coalesce(f.n_failed, 0) > 0 THEN 'weak'
            WHEN (r.task_type = 'classification' AND r.primary_value >= 0.75) OR (r.task_type = 'regression' AND r.primary_value >= 0.6) THEN 'strong'
            ELSE 'acceptable' END AS verdict,
       CASE WHEN r.task_type = 'classification' THEN 'f1' ELSE 'r2' END AS primary_metric, r.primary_value,
       CASE WHEN r.task_type = 'classification' AND r.roc_auc IS NOT NULL THEN 'roc_auc'
            WHEN r.task_type = 'classification' THEN 'f1' ELSE 'r2' END AS gate_metric,
       CASE WHEN r.task_type = 'classification' AND r.roc_auc IS NOT NULL THEN r.roc_auc ELSE r.primary_value END AS gate_value,
       CAST(coalesce(f.n_failed, 0) AS BIGINT) AS n_failed, coalesce(f.reasons, '') AS reasons
FROM rr r LEFT JOIN (SELECT run_id, count(*) AS n_failed, string_agg(detail, '; ' ORDER BY ord) AS reasons
                     FROM checks WHERE gating AND NOT passed GROUP BY run_id) f ON r.run_id = f.run_id)"""


def _q(select: str, extra: str = "", fixtures=("fx_runs", "fx_importances")) -> str:
    body = f"{_MISSING_CTE},\n{_CHECKS_SQL},\n{_VERDICT_SQL}{extra}\n{select}"
    sql = with_ctes("SELECT 1", *fixtures)
    return sql[:sql.rindex("\nSELECT 1")] + ",\n" + body


_reg("quality_checks", lambda s, sf: G.quality_checks(_runs(s, sf), _imps(s, sf)),
     _q("SELECT run_id, ord, name, coalesce(passed, false) AS passed, gating, detail FROM checks"))
def _named_runs(spark, sf):
    """Runs that also know which columns leaked, what the target is a mix of, and what was sampled."""
    from pyspark.sql import functions as F
    score = F.lit(0.95) + F.pmod("run_id", F.lit(5)) / 100.0
    leaked = F.array(F.struct(F.lit("late").alias("name"), F.lit(0.951).alias("score")), F.struct(F.concat(F.lit("col"), F.col("run_id") % 7).alias("name"), score.alias("score")))
    return _runs(spark, sf).select("*", F.when(F.col("leaked_count") > 0, leaked).alias("leaked"),
                                   F.when(F.col("derived_target"), F.struct(F.lit(0.9912).alias("r2"), F.lit("a,b").alias("contributors"))).alias("additive"),
                                   F.when(F.col("run_id") % 3 == 0, F.col("run_id") + 1000).alias("sampled_from"))


_LEAK_NAMES = """CASE WHEN 0.95 + run_id % 5 / 100.0 > 0.951 THEN printf('col%d (%.3f), late (0.951)', run_id % 7, CAST(0.95 + run_id % 5 / 100.0 AS DOUBLE))
       ELSE printf('late (0.951), col%d (%.3f)', run_id % 7, CAST(0.95 + run_id % 5 / 100.0 AS DOUBLE)) END"""
_MIX_TEXT = "A linear mix of the features gives the target (R2 0.9912: a,b)"
_reg("quality_checks_named", lambda s, sf: G.quality_checks(_named_runs(s, sf)).where("name IN ('target_leakage', 'target_is_derived')").select(
    "run_id", "name", "passed", "detail"), with_ctes(f"""
SELECT run_id, 'target_leakage' AS name, leaked_count = 0 AS passed, CASE WHEN leaked_count = 0 THEN 'Leak scan clean.' ELSE {_LEAK_NAMES} || ' taken out.' END AS detail FROM fx_runs
UNION ALL SELECT run_id, 'target_is_derived', NOT derived_target,
  CASE WHEN derived_target THEN '{_MIX_TEXT}.' ELSE 'No linear mix of the features gives the target.' END FROM fx_runs""", "fx_runs"))
_reg("findings_named", lambda s, sf: G.findings(_named_runs(s, sf)).where("name IN ('additive_leakage', 'leaked_features', 'sampled_from')").select(
    "run_id", "name", "critical", "text"), with_ctes(f"""
SELECT run_id, 'additive_leakage' AS name, true AS critical, 'CRITICAL: {_MIX_TEXT}; the scores say nothing about prediction.' AS text FROM fx_runs WHERE derived_target
UNION ALL SELECT run_id, 'leaked_features', true, {_LEAK_NAMES} || ' taken out; no score includes them.' FROM fx_runs WHERE leaked_count > 0
UNION ALL SELECT run_id, 'sampled_from', false, printf('Fitted on a sample out of %d rows.', run_id + 1000) FROM fx_runs WHERE run_id % 3 = 0""", "fx_runs"))
_reg("quality_verdict", lambda s, sf: G.verdict(_runs(s, sf), _imps(s, sf)), _q("SELECT * FROM verd"))
_reg("dead_features", lambda s, sf: G.dead_features(_imps(s, sf)), with_ctes("""
SELECT run_id, encoded, CASE WHEN total > 0 THEN abs(importance) / total END AS share,
       CASE WHEN total > 0 THEN abs(importance) / total < 0.02 ELSE true END AS dead
FROM (SELECT *, sum(abs(importance)) OVER (PARTITION BY run_id) AS total FROM fx_importances) t""", "fx_importances"))
_reg("round_improvement", lambda s, sf: G.round_improvement(relation(s, sf, "fx_rounds")), with_ctes("""
SELECT run_id, round, gate_value, prev AS previous_best, CASE WHEN prev IS NULL THEN NULL ELSE gate_value >= prev + 0.02 END AS is_improvement
FROM (SELECT *, max(gate_value) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM fx_rounds) t""", "fx_rounds"))
_reg("quality_suggestions", lambda s, sf: G.suggestions(_runs(s, sf), _imps(s, sf)), _q("""
SELECT run_id, 1 AS ord, printf('Read the scores as those without %d leaking column(s).', leaked_count) AS suggestion FROM rr WHERE leaked_count > 0
UNION ALL SELECT run_id, 2, 'Search the columns left for one that gives the target away.' FROM rr WHERE primary_value >= 0.98
UNION ALL SELECT run_id, 3, 'Find out why those values are absent before using the model elsewhere.' FROM rr WHERE missing_top
UNION ALL SELECT d.run_id, 4, printf('Try without %d feature(s) of negligible importance, such as %s.', d.n_dead, d.names)
  FROM rr JOIN dd d ON rr.run_id = d.run_id
UNION ALL SELECT run_id, 5, 'Collect more rows before trying other models.' FROM rr WHERE n_train < 200""", """,
dd AS (SELECT run_id, count(*) AS n_dead, array_to_string(list_slice(list_sort(list(encoded)), 1, 5), ', ') AS names FROM (
  SELECT run_id, encoded, CASE WHEN total > 0 THEN abs(importance) / total < 0.02 ELSE true END AS dead
  FROM (SELECT *, sum(abs(importance)) OVER (PARTITION BY run_id) AS total FROM fx_importances) t) x WHERE dead GROUP BY run_id)"""))
_reg("findings", lambda s, sf: G.findings(_runs(s, sf), _imps(s, sf)), _q("""
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY critical DESC, pos ASC) AS INTEGER) AS ord, name, critical, text FROM (
  SELECT run_id, 0 AS pos, 'additive_leakage' AS name, true AS critical,
         'CRITICAL: A linear mix of the features gives the target; the scores say nothing about prediction.' AS text
  FROM rr WHERE coalesce(derived_target, false)
  UNION ALL SELECT run_id, 1, 'leaked_features', true,
         printf('%d leaking column(s) taken out; no score includes them.', leaked_count)
  FROM rr WHERE coalesce(leaked_count, 0) > 0
  UNION ALL SELECT rr.run_id, 3, 'dead_features', false, printf('Negligible importance: %s.', d.names)
  FROM rr JOIN dd d ON rr.run_id = d.run_id WHERE length(d.names) > 0
  UNION ALL SELECT run_id, 4, 'failed_checks', false, printf('Gates not met: %s', reasons) FROM verd WHERE length(reasons) > 0) f""", """,
dd AS (SELECT run_id, array_to_string(list_sort(list(encoded)), ', ') AS names FROM (
  SELECT run_id, encoded, CASE WHEN total > 0 THEN abs(importance) / total < 0.02 ELSE true END AS dead
  FROM (SELECT *, sum(abs(importance)) OVER (PARTITION BY run_id) AS total FROM fx_importances) t) x WHERE dead GROUP BY run_id)"""))

# ---------------------------------------------------------------- ledger
_LATEST_SQL = """latest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) AS rn
  FROM fx_runs WHERE status = 'succeeded' AND agent_name = 'analysis' AND parent_run_id IS NULL) t WHERE rn = 1)"""


def _ledger_q(select: str, extra: str = "") -> str:
    sql = with_ctes("SELECT 1", "fx_projects", "fx_datasets", "fx_runs", "fx_importances")
    return sql[:sql.rindex("\nSELECT 1")] + f",\n{_LATEST_SQL}{extra}\n{select}"


_reg("ledger_latest_run", lambda s, sf: R.latest_successful(_runs(s, sf)),
     _ledger_q("SELECT * EXCLUDE (rn) FROM latest"))
_reg("ledger_project_summary",
     lambda s, sf: R.project_summary(relation(s, sf, "fx_projects"), relation(s, sf, "fx_datasets"),
                                     _runs(s, sf), _imps(s, sf)),
     with_ctes("SELECT 1", "fx_projects", "fx_datasets", "fx_runs", "fx_importances")[:-len("\nSELECT 1")] + f""",
{_LATEST_SQL},
rr AS (SELECT l.*, coalesce(m.missing_top, false) AS missing_top, coalesce(m.missing_names, '') AS missing_names
       FROM latest l LEFT JOIN (SELECT run_id, max(CASE WHEN encoded LIKE 'missing:%' THEN 1 ELSE 0 END) = 1 AS missing_top,
              '' AS missing_names FROM (SELECT run_id, encoded, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, encoded ASC) AS r
              FROM fx_importances) t WHERE r <= 5 GROUP BY run_id) m ON l.run_id = m.run_id),
{_CHECKS_SQL},
{_VERDICT_SQL}
SELECT p.project_id, p.name, CAST(coalesce(d.dataset_count, 0) AS BIGINT) AS dataset_count,
       CAST(coalesce(rc.run_count, 0) AS BIGINT) AS run_count, d.row_count, l.run_id AS last_run_id,
       v.verdict AS last_verdict, v.gate_metric AS last_metric, v.gate_value AS last_value, l.created_at AS last_run_at,
       CAST(coalesce(l.leaked_count, 0) AS INTEGER) AS leaked_count, coalesce(l.derived_target, false) AS derived_target
FROM fx_projects p
LEFT JOIN (SELECT project_id, count(*) AS dataset_count, max(n_rows) AS row_count FROM fx_datasets GROUP BY 1) d ON p.project_id = d.project_id
LEFT JOIN (SELECT project_id, count(*) AS run_count FROM fx_runs WHERE agent_name = 'analysis' GROUP BY 1) rc ON p.project_id = rc.project_id
LEFT JOIN latest l ON p.project_id = l.project_id
LEFT JOIN verd v ON l.run_id = v.run_id""")
_reg("ledger_owned",
     lambda s, sf: R.owned(relation(s, sf, "fx_datasets"), relation(s, sf, "fx_projects"), 7),
     with_ctes("SELECT d.* FROM fx_datasets d JOIN fx_projects p ON d.project_id = p.project_id WHERE p.owner_id = 7",
               "fx_projects", "fx_datasets"))
_reg("ledger_run_tree", lambda s, sf: R.run_tree(_runs(s, sf)), with_ctes("""
SELECT parent_run_id AS run_id, run_id AS child_id, count(*) OVER (PARTITION BY parent_run_id) AS n_children
FROM fx_runs WHERE parent_run_id IS NOT NULL AND parent_run_id IN (SELECT run_id FROM fx_runs)""", "fx_runs"))
_ORPHAN_NOW = _dt.datetime(2026, 1, 1, 0, 0, 0)
_reg("ledger_orphans", lambda s, sf: R.fail_orphans(_runs(s, sf), _ORPHAN_NOW), with_ctes(f"""
SELECT * EXCLUDE (status), CASE WHEN status IN ('running', 'pending') THEN 'failed' ELSE status END AS status,
       CASE WHEN status IN ('running', 'pending') THEN '{R.ORPHAN_REASON}' END AS error,
       CASE WHEN status IN ('running', 'pending') THEN TIMESTAMP '2026-01-01 00:00:00' END AS finished_at
FROM fx_runs""", "fx_runs"))
_reg("conversation_window",
     lambda s, sf: R.history(relation(s, sf, "conversations"), "conv_id", "turn", 4), """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t WHERE rn <= 4""")
_reg("ledger_totals",
     lambda s, sf: R.totals(R.project_summary(relation(s, sf, "fx_projects"), relation(s, sf, "fx_datasets"),
                                              _runs(s, sf), _imps(s, sf))),
     with_ctes("SELECT 1", "fx_projects", "fx_datasets", "fx_runs")[:-len("\nSELECT 1")] + f""",
{_LATEST_SQL},
summ AS (SELECT p.project_id, coalesce(rc.run_count, 0) AS run_count, d.row_count,
                coalesce(l.leaked_count, 0) AS leaked_count, coalesce(l.derived_target, false) AS derived_target
         FROM fx_projects p
         LEFT JOIN (SELECT project_id, max(n_rows) AS row_count FROM fx_datasets GROUP BY 1) d ON p.project_id = d.project_id
         LEFT JOIN (SELECT project_id, count(*) AS run_count FROM fx_runs WHERE agent_name = 'analysis' GROUP BY 1) rc ON p.project_id = rc.project_id
         LEFT JOIN latest l ON p.project_id = l.project_id)
SELECT count(*) AS projects, CAST(sum(run_count) AS BIGINT) AS runs, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS rows,
       count_if(leaked_count > 0 OR derived_target) AS leakage_caught FROM summ""")
_reg("ledger_cascade",
     lambda s, sf: R.without_project({"runs": _runs(s, sf)},
                                     relation(s, sf, "fx_projects").where("owner_id = 3"))["runs"],
     with_ctes("SELECT * FROM fx_runs WHERE project_id NOT IN (SELECT project_id FROM fx_projects WHERE owner_id = 3)",
               "fx_projects", "fx_runs"))
_reg("ask_latest_analysis", lambda s, sf: R.latest_analysis(_runs(s, sf), _imps(s, sf)),
     with_ctes("SELECT 1", "fx_runs", "fx_importances")[:-len("\nSELECT 1")] + f""",
{_LATEST_SQL},
rr AS (SELECT l.* EXCLUDE (rn), coalesce(m.missing_top, false) AS missing_top, coalesce(m.missing_names, '') AS missing_names
       FROM latest l LEFT JOIN (SELECT run_id, max(CASE WHEN encoded LIKE 'missing:%' OR encoded LIKE '%(was missing)' THEN 1 ELSE 0 END) = 1 AS missing_top,
              coalesce(string_agg(CASE WHEN encoded LIKE 'missing:%' OR encoded LIKE '%(was missing)' THEN encoded END, ', ' ORDER BY r), '') AS missing_names
              FROM (SELECT run_id, encoded, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, encoded ASC) AS r
              FROM fx_importances) t WHERE r <= 5 GROUP BY run_id) m ON l.run_id = m.run_id),
{_CHECKS_SQL},
{_VERDICT_SQL}
SELECT l.project_id, l.run_id, l.task_type, v.verdict, v.gate_metric, v.gate_value, v.reasons AS failed_checks, t.top_features
FROM latest l JOIN verd v ON l.run_id = v.run_id
LEFT JOIN (SELECT run_id, string_agg(encoded, ',' ORDER BY r) AS top_features FROM (
  SELECT run_id, encoded, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, encoded ASC) AS r FROM fx_importances
  WHERE run_id IN (SELECT run_id FROM latest)) x WHERE r <= 10 GROUP BY run_id) t ON l.run_id = t.run_id""")

# ---------------------------------------------------------------- plan, guard, attempts
_reg("plan_default",
     lambda s, sf: R.plan(P.target_candidates(_dirty(s, sf)), _dirty(s, sf).columns, "no_such_column"),
     f"SELECT column_name AS target_column, task_type, 'fallback' AS source FROM ({OP.fix_round(OP.target_candidates('fx_dirty_orders'))}) t WHERE rank = 1")
_reg("plan_leak",
     lambda s, sf: R.plan(P.target_candidates(relation(s, sf, "fx_leak")), relation(s, sf, "fx_leak").columns),
     f"SELECT column_name AS target_column, task_type, 'candidate' AS source FROM ({OP.fix_round(OP.target_candidates('fx_leak'))}) t WHERE rank = 1")


def _proposals(s, sf):
    """Revision proposals derived from the importance ledger: exclude the
    dead features, plus an unknown name on every fifth run and a new target
    on every seventh."""
    from pyspark.sql import functions as F
    d = G.dead_features(_imps(s, sf))
    per = d.groupBy("run_id").agg(
        F.collect_set("encoded").alias("features"),
        F.collect_set(F.when(F.col("dead"), F.col("encoded"))).alias("dead"))
    return per.select(
        "run_id", F.lit("retry").alias("action"),
        F.when(F.col("run_id") % 5 == 0, F.array_union("dead", F.array(F.lit("ghost")))).otherwise(F.col("dead"))
        .alias("exclude"),
        "features", F.array().cast("array<string>").alias("already"),
        F.when(F.col("run_id") % 7 == 0, F.lit("age")).when(F.col("run_id") % 11 == 0, F.lit("nope"))
        .alias("new_target"),
        F.col("features").alias("valid_columns"))


_reg("revision_guard", lambda s, sf: R.validate_revision(_proposals(s, sf)), with_ctes("""
SELECT run_id,
       CASE WHEN covers_all THEN 'abandon' WHEN NOT changes THEN 'accept' ELSE 'retry' END AS action,
       array_to_string(list_sort(known), ',') AS exclude,
       CASE WHEN NOT covers_all AND target_ok THEN new_target END AS new_target,
       concat_ws('; ',
         CASE WHEN len(unknown) > 0 THEN 'not among the features: ' || array_to_string(list_sort(unknown), ', ') END,
         CASE WHEN covers_all THEN 'nothing would be left to train on' END,
         CASE WHEN NOT covers_all AND new_target IS NOT NULL AND NOT target_ok THEN 'no such target column ''' || new_target || '''' END,
         CASE WHEN NOT covers_all AND NOT changes THEN 'the retry changes nothing, so the result stands' END) AS notes
FROM (
  SELECT run_id, known, unknown, new_target, target_ok,
         len(list_filter(features, lambda f: NOT list_contains(known, f))) = 0 AS covers_all,
         len(known) > 0 OR target_ok AS changes
  FROM (
    SELECT run_id, features, new_target,
           list_filter(excl, lambda e: list_contains(features, e)) AS known,
           list_filter(excl, lambda e: NOT list_contains(features, e)) AS unknown,
           coalesce(new_target IS NOT NULL AND list_contains(features, new_target), false) AS target_ok
    FROM (
      SELECT run_id, features,
             CASE WHEN run_id % 5 = 0 THEN list_distinct(list_concat(dead, ['ghost'])) ELSE dead END AS excl,
             CASE WHEN run_id % 7 = 0 THEN 'age' WHEN run_id % 11 = 0 THEN 'nope' END AS new_target
      FROM (SELECT run_id, list_distinct(list(encoded)) AS features,
                   coalesce(list_distinct(list(encoded) FILTER (WHERE dead)), []::VARCHAR[]) AS dead
            FROM (SELECT run_id, encoded, CASE WHEN total > 0 THEN abs(importance) / total < 0.02 ELSE true END AS dead
                  FROM (SELECT *, sum(abs(importance)) OVER (PARTITION BY run_id) AS total FROM fx_importances) t) d
            GROUP BY run_id) g) p) q) r""", "fx_importances"))
_reg("attempts", lambda s, sf: R.attempts(relation(s, sf, "fx_rounds")), with_ctes("""
SELECT run_id, round, gate_value, previous_best, is_improvement, decision FROM (
  SELECT *, coalesce(max(CASE WHEN decision <> 'retry' THEN 1 ELSE 0 END) OVER (
           PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped_before
  FROM (
    SELECT *, CASE WHEN gate_value >= 0.65 THEN 'accept' WHEN round >= 2 THEN 'limit'
                   WHEN previous_best IS NOT NULL AND NOT is_improvement THEN 'no_improvement' ELSE 'retry' END AS decision
    FROM (SELECT run_id, round, gate_value, prev AS previous_best,
                 CASE WHEN prev IS NULL THEN NULL ELSE gate_value >= prev + 0.02 END AS is_improvement
          FROM (SELECT *, max(gate_value) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
                FROM fx_rounds) a) b) c) d WHERE stopped_before = 0""", "fx_rounds"))


# ---------------------------------------------------------------- models, explanations, loop
from tabvet.operators import explain as E  # noqa: E402
from tabvet.operators import models as MD  # noqa: E402
from tabvet.plans import loop as LP  # noqa: E402
from tabvet.sources import scan as S  # noqa: E402
from tabvet.sources import sinks as SK  # noqa: E402
from tabvet.sources.fixtures import experiments_from_runs  # noqa: E402

_TRAIN_SPECS = {
    "fx_leak/survived": ("fx_leak", "survived", "classification", "row_id"),
    "fx_leak/fare": ("fx_leak", "fare", "regression", "row_id"),
    "fx_missing/label": ("fx_missing", "label", "classification", "row_id"),
}


def _outcome(spark, sf: str, spec: str, models: tuple[str, ...] | None = None):
    rel, target, task, key = _TRAIN_SPECS[spec]
    return MD.train(relation(spark, sf, rel), target, task, key=key,
                    model_names=list(models) if models else None)


def _analysis(spark, sf: str, rel: str):
    return LP.analyse(relation(spark, sf, rel))


def _board(spark, sf, spec, models=None):
    o = _outcome(spark, sf, spec, models)
    return o.leaderboard(spark).select("model_name", "primary_metric", "primary_metric_value",
                                       "feature_count", "is_selected", "metrics")


_reg("train_logistic", lambda s, sf: _board(s, sf, "fx_leak/survived", ("logistic_regression",)), None)
_reg("train_ridge", lambda s, sf: _board(s, sf, "fx_leak/fare", ("ridge",)), None)
_reg("train_forest_classifier", lambda s, sf: _board(s, sf, "fx_missing/label", ("random_forest",)), None)
_reg("train_forest_regressor", lambda s, sf: _board(s, sf, "fx_leak/fare", ("random_forest",)), None)
_reg("leaderboard", lambda s, sf: _board(s, sf, "fx_missing/label"), None)


def _roundtrip(spark, sf):
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.sql import functions as F
    o = _outcome(spark, sf, "fx_leak/survived", ("logistic_regression",))
    model = o.models["logistic_regression"]
    path = SK.save_model(model, __import__("tabvet.session", fromlist=["scratch_path"]).scratch_path(spark, "model"))
    loaded = SK.load_model(path, LogisticRegressionModel)
    a = model.transform(o.test).select("row_id", F.col("prediction").alias("p1"))
    b = loaded.transform(o.test).select("row_id", F.col("prediction").alias("p2"))
    return a.join(b, "row_id").agg(F.lit("logistic_regression").alias("model_name"),
                                   F.count(F.lit(1)).alias("n_rows"),
                                   F.count_if(F.col("p1") == F.col("p2")).alias("n_equal"))


_reg("model_roundtrip", _roundtrip, None)
_reg("best_per_run",
     lambda s, sf: experiments_from_runs(_runs(s, sf)).where("is_selected")
     .select("run_id", "model_name", "primary_metric_value"),
     with_ctes("""
SELECT run_id, model_name, value AS primary_metric_value FROM (
  SELECT run_id, model_name, value, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, ord ASC) AS rn FROM (
    SELECT run_id, 0 AS ord, CASE WHEN task_type = 'classification' THEN 'logistic_regression' ELSE 'ridge' END AS model_name,
           primary_value AS value FROM fx_runs WHERE agent_name = 'analysis'
    UNION ALL SELECT run_id, 1, 'random_forest', primary_value * 0.9 + 0.05 FROM fx_runs WHERE agent_name = 'analysis') e) r
WHERE rn = 1""", "fx_runs"))
_reg("ledger_experiments", lambda s, sf: experiments_from_runs(_runs(s, sf)), with_ctes("""
SELECT run_id, model_name, primary_metric, value AS primary_metric_value, rn = 1 AS is_selected FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, ord ASC) AS rn FROM (
    SELECT run_id, 0 AS ord, CASE WHEN task_type = 'classification' THEN 'logistic_regression' ELSE 'ridge' END AS model_name,
           CASE WHEN task_type = 'classification' THEN 'f1' ELSE 'r2' END AS primary_metric, primary_value AS value
    FROM fx_runs WHERE agent_name = 'analysis'
    UNION ALL SELECT run_id, 1, 'random_forest', CASE WHEN task_type = 'classification' THEN 'f1' ELSE 'r2' END,
           primary_value * 0.9 + 0.05 FROM fx_runs WHERE agent_name = 'analysis') e) r""", "fx_runs"))


def _tree_shap(spark, sf):
    o = _outcome(spark, sf, "fx_missing/label", ("random_forest",))
    model = o.models["random_forest"]
    enc = [e for e, _ in o.prep.encoded()]
    scores, _, _ = E.tree_shap(model, o.test, enc, True, 1, key="row_id")
    return scores


def _permutation(spark, sf):
    o = _outcome(spark, sf, "fx_leak/survived", ("logistic_regression",))
    return E.permutation_importance(o.models["logistic_regression"], o.prep, o.test, "row_id", True)


def _explain_best(spark, sf):
    from pyspark.sql import functions as F
    o = _outcome(spark, sf, "fx_missing/label")
    method, n, feats, _ = E.explain(o, "random_forest", "row_id")
    return feats.withColumn("method", F.lit(method)).withColumn("rows_explained", F.lit(n))


_reg("explain_tree_shap", _tree_shap, None)
_reg("explain_permutation", _permutation, None)
_reg("explain_best", _explain_best, None)
_NUM_E4, _CAT_E4 = ["age", "noise"], ["region", "plan", "plan_type"]
_reg("encoded_to_source",
     lambda s, sf: _imps(s, sf).select("run_id", "encoded", E.source_column(
         __import__("pyspark.sql.functions", fromlist=["col"]).col("encoded"), _NUM_E4, _CAT_E4).alias("source")),
     with_ctes("""
SELECT run_id, encoded, CASE WHEN encoded LIKE 'missingindicator\\_%' ESCAPE '\\' THEN substr(encoded, 18) || ' (was missing)'
  WHEN encoded LIKE 'missing:%' THEN substr(encoded, 9) || ' (was missing)'
  WHEN encoded IN ('age', 'noise', 'region', 'plan', 'plan_type') THEN encoded
  WHEN starts_with(encoded, 'plan_type_') OR starts_with(encoded, 'plan_type=') THEN 'plan_type'
  WHEN starts_with(encoded, 'region_') OR starts_with(encoded, 'region=') THEN 'region'
  WHEN starts_with(encoded, 'plan_') OR starts_with(encoded, 'plan=') THEN 'plan'
  ELSE encoded END AS source FROM fx_importances""", "fx_importances"))


def _fold(spark, sf):
    from pyspark.sql import functions as F
    imps = _imps(spark, sf)
    mapped = imps.withColumn("source", E.source_column(F.col("encoded"), _NUM_E4, _CAT_E4))
    return E.fold_importance(mapped, group=["run_id"])


_reg("fold_importance", _fold, with_ctes("""
SELECT run_id, feature, importance, CAST(rank AS INTEGER) AS rank, CAST(encoded_parts AS INTEGER) AS encoded_parts FROM (
  SELECT run_id, feature, importance, encoded_parts,
         row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature ASC) AS rank FROM (
    SELECT run_id, source AS feature, sum(importance) AS importance, count(*) AS encoded_parts FROM (
      SELECT run_id, importance, CASE WHEN encoded LIKE 'missing:%' THEN substr(encoded, 9) || ' (was missing)'
        WHEN encoded IN ('age', 'noise', 'region', 'plan', 'plan_type') THEN encoded
        WHEN starts_with(encoded, 'plan_type_') THEN 'plan_type'
        WHEN starts_with(encoded, 'region_') THEN 'region'
        WHEN starts_with(encoded, 'plan_') THEN 'plan' ELSE encoded END AS source FROM fx_importances) m
    GROUP BY run_id, source) f) r WHERE rank <= 15""", "fx_importances"))


def _budget(spark, sf):
    from pyspark.sql import functions as F
    runs = _runs(spark, sf).select("run_id", (F.col("n_train") * F.lit(4001)).alias("nodes"))
    rows, method = E.shap_budget(F.col("nodes"))
    return runs.select("run_id", "nodes", rows.alias("rows"), method.alias("method"))


_reg("shap_budget", _budget, with_ctes("""
SELECT run_id, nodes, CAST(CASE WHEN nodes <= 0 THEN 500 ELSE least(greatest(floor(60000000 / nodes), 60), 500) END AS BIGINT) AS rows,
       CASE WHEN nodes > 2500000 THEN 'permutation' ELSE 'shap' END AS method
FROM (SELECT run_id, n_train * 4001 AS nodes FROM fx_runs) t""", "fx_runs"))
_reg("analyse_rounds", lambda s, sf: LP.attempts_df(s, _analysis(s, sf, "fx_leak")), None)
_reg("analyse_steps", lambda s, sf: LP.steps_df(s, _analysis(s, sf, "fx_leak")), None)
_reg("report_rows", lambda s, sf: LP.report_rows(s, _analysis(s, sf, "fx_leak")), None)
_reg("summary_facts", lambda s, sf: LP.summary_facts_df(s, _analysis(s, sf, "fx_leak")), None)


# ---------------------------------------------------------------- sources and sinks
from tabvet.session import scratch_path  # noqa: E402


def _written_csv(spark, sf: str, rel: str) -> str:
    """Write a relation as a comma CSV (S12) into the shared scratch folder."""
    path = scratch_path(spark, f"csv-{rel}")
    SK.write_clean(relation(spark, sf, rel), path)
    return path


def _scan_roundtrip(spark, sf):
    df, _ = S.scan(spark, _written_csv(spark, sf, "lineitem"))
    return df


_reg("scan_csv_roundtrip", _scan_roundtrip, """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000') AS l_shipdate
FROM lineitem""")
_reg("scan_csv_documents", lambda s, sf: S.scan(s, _written_csv(s, sf, "documents"), delimiter=",", encoding="utf-8")[0],
     "SELECT doc_id, text, lang, source, n_chars FROM documents")
_reg("scan_null_tokens", lambda s, sf: S.null_tokens(_dirty(s, sf)),
     _fx(f"SELECT {', '.join((f'CASE WHEN {c} IN ({chr(44).join(OP.lit(t) for t in K.READER_NA_TOKENS)}) THEN NULL ELSE {c} END AS {c}') if c in _DIRTY_TEXT else c for c in _DIRTY_COLS)} FROM fx_dirty_orders"))


def _as_text(spark, sf):
    from pyspark.sql import functions as F
    d = S.null_tokens(_dirty(spark, sf))
    return d.select(*[F.col(c).cast("string").alias(c) for c in d.columns])


_TEXT_SQL = f"SELECT {', '.join((f'CAST(CASE WHEN {c} IN ({chr(44).join(OP.lit(t) for t in K.READER_NA_TOKENS)}) THEN NULL ELSE {c} END AS VARCHAR) AS {c}') if c in _DIRTY_TEXT else f'CAST({c} AS VARCHAR) AS {c}' for c in _DIRTY_COLS)} FROM fx_dirty_orders"
_reg("infer_types", lambda s, sf: S.infer_types(_as_text(s, sf)), _fx(" UNION ALL ".join(f"""
SELECT {i} AS position, '{c}' AS column_name, CASE
  WHEN count({c}) = 0 THEN 'double'
  WHEN count_if({c} IS NOT NULL AND NOT regexp_matches({c}, '{S.INT_RX}')) = 0 AND count({c}) = count(*) THEN 'bigint'
  WHEN count_if({c} IS NOT NULL AND NOT regexp_matches({c}, '{S.FLOAT_RX}') AND lower({c}) NOT IN ('nan', '-nan')) = 0 THEN 'double'
  WHEN count_if({c} IS NOT NULL AND {c} NOT IN ('True', 'False', 'true', 'false', 'TRUE', 'FALSE')) = 0 AND count({c}) = count(*) THEN 'boolean'
  ELSE 'string' END AS inferred FROM ({_TEXT_SQL}) t""" for i, c in enumerate(_DIRTY_COLS))))


#: Bytes of text that one task writes into a file, about.
FILE_BYTES = 128 << 20


def _in_files(df: DataFrame, files: int, key: str) -> DataFrame:
    """``df`` spread over ``files`` files; large tables over a multiple of
    that, so that none holds more than about FILE_BYTES. Then rows are dealt
    evenly, whatever their keys."""
    from pyspark.sql import functions as F
    size = df.agg(F.sum(F.octet_length(F.concat_ws(";", *[F.col(c).cast("string") for c in df.columns])))).first()[0] or 0
    parts = -(-size // (files * FILE_BYTES))
    return df.repartition(files, key) if parts <= 1 else df.repartition(files * parts)


def _dialect_dir(spark, sf: str) -> str:
    """customer in four dialects and the documents in two encodings, three
    files each, of several parts where they are large (part n belongs to file n % 3)."""
    base = scratch_path(spark, "dialects")
    customer = _in_files(relation(spark, sf, "customer"), 3, "c_custkey")
    for name, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        customer.write.option("header", True).option("sep", sep).csv(f"{base}/{name}")
    for name, charset in (("utf8", "UTF-8"), ("latin1", "ISO-8859-1")):
        _documents_csv(spark, sf, f"{base}/{name}", charset, 3)
    return base


def _documents_csv(spark, sf: str, path: str, charset: str, files: int) -> None:
    (_in_files(relation(spark, sf, "documents"), files, "doc_id").write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"')
     .option("encoding", charset).csv(path))


def _sniffed(spark, sf):
    from pyspark.sql import functions as F
    sniffed = S.sniff(spark, _dialect_dir(spark, sf) + "/*", "*.csv")
    return sniffed.select("*", F.regexp_extract("path", r"/([a-z0-9]+)/part-", 1).alias("dialect"),
                          (F.regexp_extract("path", r"/part-([0-9]+)", 1).cast("int") % 3).alias("file"))


def _files_by(spark, sf, found: str) -> DataFrame:
    """How many files of each dialect were found to have which ``found``; every part is sniffed."""
    from pyspark.sql import functions as F
    return _sniffed(spark, sf).groupBy("dialect", found).agg(F.count_distinct("file").alias("count"))


def _scan_latin1(spark, sf):
    path = scratch_path(spark, "latin1")
    _documents_csv(spark, sf, path, "ISO-8859-1", 2)
    return S.scan(spark, path)[0]


_reg("sniff_encoding", lambda s, sf: _files_by(s, sf, "encoding"), """
SELECT dialect, CASE WHEN dialect = 'latin1' THEN 'latin-1' ELSE 'utf-8' END AS encoding, CAST(3 AS BIGINT) AS count
FROM (VALUES ('comma'), ('semicolon'), ('tab'), ('pipe'), ('utf8'), ('latin1')) d(dialect)""")
_reg("sniff_delimiter", lambda s, sf: _files_by(s, sf, "delimiter"), """
SELECT dialect, delimiter, CAST(3 AS BIGINT) AS count
FROM (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|'), ('utf8', ';'), ('latin1', ';')) d(dialect, delimiter)""")
_reg("scan_csv_latin1", _scan_latin1, "SELECT doc_id, text, lang, source, n_chars FROM documents")


def _repair(spark, sf):
    from pyspark.sql import functions as F
    base = scratch_path(spark, "headers")
    ords = relation(spark, sf, "orders")
    lines = ords.select(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                    "o_orderpriority").alias("value"))
    header = spark.createDataFrame([(" o_orderkey ,, o_custkey,O_CUSTKEY,o_custkey",)], "value string")
    header.union(lines).coalesce(1).write.text(base)
    df, _ = S.scan(spark, base, delimiter=",", encoding="utf-8")
    return spark.createDataFrame(list(enumerate(df.columns)), "position int, column_name string").crossJoin(
        df.agg(F.count(F.lit(1)).alias("n_rows")))


_reg("repair_headers", _repair, None)
_reg("cap_rows", lambda s, sf: (lambda capped: capped[0].agg(
    __import__("pyspark.sql.functions", fromlist=["count"]).count("*").alias("rows_read")).withColumn(
    "sampled", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(capped[1])))(
    S.cap_rows(relation(s, sf, "lineitem"), K.MAX_PROFILE_ROWS)),
     f"SELECT least(count(*), {K.MAX_PROFILE_ROWS}) AS rows_read, count(*) > {K.MAX_PROFILE_ROWS} AS sampled FROM lineitem")
_reg("list_inputs", lambda s, sf: S.list_inputs(s, _dialect_dir(s, sf) + "/*").unionByName(
    S.list_inputs(s, sf)), None)
_NONFINITE = ("CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN CAST('Infinity' AS DOUBLE) "
              "WHEN l_linenumber = 3 THEN CAST('-Infinity' AS DOUBLE) ELSE l_tax END")
_reg("finite_values",
     lambda s, sf: S.finite(relation(s, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber",
                                                                    f"{_NONFINITE} AS v")),
     f"SELECT l_orderkey, l_linenumber, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS v FROM (SELECT l_orderkey, l_linenumber, {_NONFINITE} AS v FROM lineitem) t")


def _dedupe(spark, sf):
    from pyspark.sql import functions as F
    new, dups = S.ingest(relation(spark, sf, "documents"), None, "source", "text", "doc_id")
    return (new.select("doc_id", "source", "content_hash", F.lit(False).alias("is_duplicate"),
                       F.col("doc_id").alias("existing_doc_id"))
            .unionByName(dups.select("doc_id", "source", "content_hash", F.lit(True).alias("is_duplicate"),
                                     "existing_doc_id")))


_reg("dedupe_by_content_hash", _dedupe, """
SELECT doc_id, source, content_hash, doc_id <> first_id AS is_duplicate, first_id AS existing_doc_id FROM (
  SELECT doc_id, source, sha256(text) AS content_hash,
         min(doc_id) OVER (PARTITION BY source, sha256(text)) AS first_id FROM documents) t""")


def _clean_sink(spark, sf):
    from pyspark.sql import functions as F
    path = scratch_path(spark, "clean-sink")
    SK.write_clean(C.clean(_dirty(spark, sf)).table, path)
    back, info = S.scan(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(back.columns)).alias("n_columns"),
                    F.lit(info["delimiter"]).alias("delimiter"), F.lit(info["encoding"]).alias("encoding"))


_reg("clean_sink", _clean_sink, None)


# ---------------------------------------------------------------- stable float outputs
# Doubles that come from float sums or interpolated quantiles may differ in
# the last bit between engines (different summation order / formula). For the
# side-by-side check both sides round them to 10 significant digits with the
# same arithmetic: k = 9 - floor(log10|x|); floor(x * 10^k + 0.5) / 10^k.
def _sig_spark(c):
    from pyspark.sql import functions as F
    x = F.col(c)
    k = F.lit(9.0) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), k)
    return F.when(x.isNull() | (x == 0) | F.isnan(x), x).otherwise(F.floor(x * scale + F.lit(0.5)) / scale)


def _sig_sql(c: str) -> str:
    k = f"(9.0 - floor(log10(abs({c}))))"
    return (f"CASE WHEN {c} IS NULL OR {c} = 0 OR isnan({c}) THEN {c} "
            f"ELSE floor({c} * pow(10.0, {k}) + 0.5) / pow(10.0, {k}) END")


def _stabilise(key: str, cols: list[str]) -> None:
    fn, sql = REGISTRY[key]

    def wrapped(spark, sf, _fn=fn):
        df = _fn(spark, sf)
        for c in cols:
            df = df.withColumn(c, _sig_spark(c))
        return df

    new_sql = None
    if sql is not None:
        repl = ", ".join(f'{_sig_sql(OP.q(c))} AS {OP.q(c)}' for c in cols)
        new_sql = f"SELECT * REPLACE ({repl}) FROM ({sql}) _stable"
    REGISTRY[key] = (wrapped, new_sql)


for _key, _cols in {
    "numeric_stats": ["mean", "median", "std", "q1", "q3", "iqr"],
    "iqr_outliers": ["lower", "upper"],
    "iqr_outliers_documents": ["lower", "upper"],
    "correlations": ["r"],
    "correlations_lineitem": ["r"],
    "quality_warnings": ["value"],
    "quality_warnings_events": ["value"],
    "quality_warnings_fx_sum": ["value"],
    "ask_describe_numeric": ["mean", "median", "std"],
    "ask_agg_mean": ["metric"],
    "ask_agg_sum": ["metric"],
    "ask_agg_median": ["metric"],
    "ask_correlation": ["pearson_r"],
    "impute_median": ["median"],
    "standard_scale": ["mean", "scale"],
    "classification_metrics": ["accuracy", "precision", "recall", "f1"],
    "roc_auc": ["roc_auc"],
    "regression_metrics": ["r2", "mae", "rmse", "mse"],
    "fold_importance": ["importance"],
    "dead_features": ["share"],
}.items():
    _stabilise(_key, _cols)
