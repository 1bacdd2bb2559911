"""DuckDB oracle SQL for the profiling operators.

Written independently of the Spark code: plain SQL over the same relation,
one branch per column, the same decision list. Schemas are static (the
oracle runs without a Spark session).
"""
from __future__ import annotations

from tabvet.functions import constants as K
from tabvet.sources.fixtures import with_ctes

SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "fx_dirty_orders": [("o_orderkey", "bigint"), ("cust_id", "bigint"), ("status_raw", "string"),
                        ("priority_raw", "string"), ("junk", "string"), ("price", "double"),
                        ("order_day", "string"), ("constant_col", "string"),
                        ("empty_col", "double")],
    "fx_dates": [("o_orderkey", "bigint"), ("fraction", "string"), ("zoned", "string"), ("compact_zone", "string"), ("month_first", "string"),
                 ("day_first", "string"), ("clock", "string"), ("named", "string"), ("mixed", "string"), ("wrong", "string")],
    "fx_sum": [("row_id", "string"), ("fare", "double"), ("tip", "double"), ("tolls", "double"),
               ("distance", "double"), ("total", "double")],
    "fx_leak": [("row_id", "bigint"), ("survived", "int"), ("alive", "string"),
                ("fare", "double"), ("pclass", "string")],
    "fx_missing": [("row_id", "string"), ("measured", "double"), ("noise", "double"),
                   ("label", "int")],
}


def cls_of(dtype: str) -> str:
    if dtype in ("bigint", "int", "smallint", "tinyint"):
        return "integral"
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        return "fractional"
    if dtype in ("timestamp_ntz", "timestamp", "date"):
        return "datetime"
    if dtype == "string":
        return "string"
    if dtype == "boolean":
        return "boolean"
    return "unsupported"


def fix_round(sql: str) -> str:
    """Rewrite every ``round(a, d)`` to ``floor((a) * 10^d + 0.5) / 10^d``,
    the rounding rule the Spark side uses (see ``tabvet.functions.exprs.rnd``)."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 6, None
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                last_comma = k
            elif ch == "'":
                k = sql.index("'", k + 1)
            k += 1
        if last_comma is None:  # one-argument round: leave as written
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        inner = fix_round(sql[j + 6:last_comma])
        digits = int(sql[last_comma + 1:k].strip())
        scale = f"CAST({10 ** digits} AS DOUBLE)"
        out.append(sql[i:j])
        out.append(f"(floor(({inner}) * {scale} + 0.5) / {scale})")
        i = k + 1


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def src_cte(rel: str) -> str:
    cols = []
    for name, dtype in SCHEMAS[rel]:
        if cls_of(dtype) == "fractional":
            cols.append(f"CASE WHEN isnan(CAST({q(name)} AS DOUBLE)) THEN NULL "
                        f"ELSE CAST({q(name)} AS DOUBLE) END AS {q(name)}")
        else:
            cols.append(q(name))
    return f"src AS (SELECT {', '.join(cols)} FROM {rel})"


def fixtures_for(rel: str) -> tuple[str, ...]:
    return (rel,) if rel.startswith("fx_") else ()


def text_of(name: str, cls: str) -> str:
    if cls == "fractional":
        return f"CAST({q(name)} + 0.0 AS VARCHAR)"
    if cls == "datetime":
        return f"strftime({q(name)}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({q(name)} AS VARCHAR)"


def parse_sql(expr: str, day: str = "false") -> str:
    parts = [f"CASE WHEN regexp_matches({expr}, {lit(rx)}) THEN try_strptime({expr}, {lit(fmt)}) END"
             for rx, _, fmt in K.DATETIME_FORMATS]
    parts += [f"CASE WHEN regexp_matches({expr}, {lit(rx)}) THEN CASE WHEN {day} THEN try_strptime({expr}, {lit(d)}) ELSE try_strptime({expr}, {lit(m)}) END END"
              for rx, (_, m), (_, d) in K.AMBIGUOUS_FORMATS]
    zone = f"replace(replace(regexp_extract({expr}, {lit(K.ISO_SHAPE)}, 2), ':', ''), 'Z', '+0000')"
    minutes = (f"CASE WHEN {zone} = '' THEN 0 ELSE (CASE WHEN left({zone}, 1) = '-' THEN -1 ELSE 1 END) "
               f"* (CAST(substr({zone}, 2, 2) AS BIGINT) * 60 + CAST(substr({zone}, 4, 2) AS BIGINT)) END")
    local = f"try_cast(left({expr}, 19) || regexp_extract({expr}, {lit(K.ISO_SHAPE)}, 1) AS TIMESTAMP)"
    parts.append(f"CASE WHEN regexp_matches({expr}, {lit(K.ISO_SHAPE)}) THEN {local} - to_minutes({minutes}) END")
    return f"coalesce({', '.join(parts)})"


def day_first_sql(rel: str) -> str:
    """One row of flags: does text column i write the day first?"""
    number = lambda col, k: f"coalesce(max(try_cast(regexp_extract({col}, {lit(K.AMBIGUOUS_SHAPE)}, {k}) AS INTEGER)), 0)"
    flags = [f"{number(q(name), 1)} > 12 AND {number(q(name), 2)} <= 12 AS day{i}" for i, (name, dtype) in enumerate(SCHEMAS[rel]) if cls_of(dtype) == "string"]
    return f"days AS (SELECT {', '.join(flags + ['1 AS one'])} FROM src)"


def summary_sql(rel: str) -> str:
    """One row per column: the oracle's version of the profiled table."""
    aggs = ["count(*) AS n_rows"]
    for i, (name, dtype) in enumerate(SCHEMAS[rel]):
        c = cls_of(dtype)
        col = q(name)
        aggs.append(f"count({col}) AS nn{i}")
        aggs.append(f"count(DISTINCT {text_of(name, c)}) AS u{i}")
        if c in ("integral", "fractional"):
            v = f"CAST({col} AS DOUBLE)"
            aggs += [f"min({v}) AS mn{i}", f"max({v}) AS mx{i}", f"avg({v}) AS av{i}",
                     f"stddev_samp({v}) AS sd{i}", f"skewness({v}) AS sk{i}",
                     f"quantile_cont({v}, 0.25) AS qa{i}", f"quantile_cont({v}, 0.5) AS qb{i}",
                     f"quantile_cont({v}, 0.75) AS qc{i}",
                     f"CAST(count_if({v} = 0) AS BIGINT) AS z{i}",
                     f"CAST(count_if({v} < 0) AS BIGINT) AS ng{i}"]
        if c in ("string", "boolean"):
            s = f"CAST({col} AS VARCHAR)"
            aggs += [f"avg(length({s})) AS la{i}", f"CAST(min(length({s})) AS BIGINT) AS ln{i}",
                     f"CAST(max(length({s})) AS BIGINT) AS lx{i}"]
        if c == "string":
            p = parse_sql(col, f"day{i}")
            aggs += [f"count({p}) AS dp{i}",
                     f"strftime(min({p}), '%Y-%m-%d %H:%M:%S') AS dpn{i}",
                     f"strftime(max({p}), '%Y-%m-%d %H:%M:%S') AS dpx{i}",
                     f"CAST(floor((epoch_us(max({p})) - epoch_us(min({p}))) / 86400000000.0) AS BIGINT) AS dps{i}"]
        if c == "datetime":
            aggs += [f"strftime(min({col}), '%Y-%m-%d %H:%M:%S') AS dtn{i}",
                     f"strftime(max({col}), '%Y-%m-%d %H:%M:%S') AS dtx{i}"]
    rows = []
    for i, (name, dtype) in enumerate(SCHEMAS[rel]):
        c = cls_of(dtype)
        num = c in ("integral", "fractional")
        txt = c in ("string", "boolean")

        def pick(expr: str, ok: bool, typ: str) -> str:
            return expr if ok else f"CAST(NULL AS {typ})"

        rows.append(
            f"SELECT {lit(name)} AS column_name, {i} AS position, {lit(dtype)} AS dtype, "
            f"{lit(c)} AS type_class, n_rows, nn{i} AS non_null, n_rows - nn{i} AS null_count, "
            f"u{i} AS unique_count, "
            f"{pick(f'mn{i}', num, 'DOUBLE')} AS min, {pick(f'mx{i}', num, 'DOUBLE')} AS max, "
            f"{pick(f'av{i}', num, 'DOUBLE')} AS mean, {pick(f'sd{i}', num, 'DOUBLE')} AS std, "
            f"{pick(f'sk{i}', num, 'DOUBLE')} AS skew_adj, "
            f"{pick(f'qa{i}', num, 'DOUBLE')} AS q1, {pick(f'qb{i}', num, 'DOUBLE')} AS median, "
            f"{pick(f'qc{i}', num, 'DOUBLE')} AS q3, "
            f"{pick(f'z{i}', num, 'BIGINT')} AS zero_count, {pick(f'ng{i}', num, 'BIGINT')} AS negative_count, "
            f"{pick(f'la{i}', txt, 'DOUBLE')} AS len_avg, {pick(f'ln{i}', txt, 'BIGINT')} AS len_min, "
            f"{pick(f'lx{i}', txt, 'BIGINT')} AS len_max, "
            f"{pick(f'dp{i}', c == 'string', 'BIGINT')} AS dt_parsed, "
            f"{pick(f'dpn{i}', c == 'string', 'VARCHAR')} AS dt_parsed_min, "
            f"{pick(f'dpx{i}', c == 'string', 'VARCHAR')} AS dt_parsed_max, "
            f"{pick(f'dps{i}', c == 'string', 'BIGINT')} AS dt_span_days, "
            f"{pick(f'dtn{i}', c == 'datetime', 'VARCHAR')} AS dt_min, "
            f"{pick(f'dtx{i}', c == 'datetime', 'VARCHAR')} AS dt_max "
            f"FROM agg")
    return f"{day_first_sql(rel)}, agg AS (SELECT {', '.join(aggs)} FROM src, days), summ AS ({' UNION ALL '.join(rows)})"


SEMANTIC_CASE = f"""CASE
  WHEN non_null = 0 THEN 'empty'
  WHEN unique_count = 1 THEN 'constant'
  WHEN type_class = 'boolean' AND null_count = 0 THEN 'boolean'
  WHEN type_class = 'boolean' AND unique_count = 2 THEN 'binary'
  WHEN type_class = 'boolean' THEN 'categorical'
  WHEN type_class = 'datetime' THEN 'datetime'
  WHEN type_class IN ('integral', 'fractional') THEN CASE
    WHEN type_class = 'integral' AND null_count = 0 AND unique_count / n_rows >= {K.IDENTIFIER_UNIQUE_RATIO} THEN 'identifier'
    WHEN unique_count = 2 THEN 'binary'
    WHEN type_class = 'integral' AND null_count = 0 AND unique_count <= {K.CATEGORICAL_MAX_UNIQUE} THEN 'categorical_numeric'
    ELSE 'numeric' END
  WHEN type_class = 'string' THEN CASE
    WHEN CAST(dt_parsed AS DOUBLE) / non_null >= {K.DATETIME_PARSE_THRESHOLD} THEN 'datetime_string'
    WHEN unique_count / n_rows >= {K.IDENTIFIER_UNIQUE_RATIO} THEN 'identifier'
    WHEN unique_count = 2 THEN 'binary'
    WHEN unique_count <= {K.CATEGORICAL_MAX_UNIQUE} THEN 'categorical'
    WHEN len_avg > {K.TEXT_MIN_AVG_LENGTH} THEN 'text'
    ELSE 'high_cardinality_categorical' END
  ELSE 'unsupported' END"""


def profiled_sql(rel: str) -> str:
    """CTE chain ending in ``prof`` (one row per column, with semantic type)."""
    return (f"{src_cte(rel)}, {summary_sql(rel)}, prof AS (SELECT *, {SEMANTIC_CASE} AS semantic_type, "
            f"round(CAST(null_count AS DOUBLE) / n_rows * 100, 3) AS null_pct, "
            f"round(CAST(unique_count AS DOUBLE) / n_rows * 100, 3) AS unique_pct FROM summ)")


def wrap(rel: str, body_ctes: str, select: str) -> str:
    """Full statement: fixture CTEs, profile CTEs, then the final SELECT."""
    sql = f"WITH {body_ctes}\n{select}"
    fx = fixtures_for(rel)
    if fx:
        inner = with_ctes("SELECT 1", *fx)
        fixture_part = inner[len("WITH "):inner.rindex("\nSELECT 1")]
        sql = f"WITH {fixture_part},\n{body_ctes}\n{select}"
    return sql


def long_values_sql(rel: str) -> str:
    parts = [f"SELECT {lit(name)} AS column_name, {text_of(name, cls_of(dtype))} AS value FROM src"
             for name, dtype in SCHEMAS[rel] if cls_of(dtype) != "unsupported"]
    return (f"longv AS ({' UNION ALL '.join(parts)}), "
            f"freq AS (SELECT column_name, value, count(*) AS cnt FROM longv "
            f"WHERE value IS NOT NULL GROUP BY column_name, value)")


# ---------------------------------------------------------------- queries
def column_profile(rel: str) -> str:
    return wrap(rel, profiled_sql(rel),
                "SELECT column_name, position, dtype, semantic_type, null_count, null_pct, "
                "unique_count, unique_pct FROM prof")


def shape(rel: str) -> str:
    return wrap(rel, "x AS (SELECT 1)",
                f"SELECT count(*) AS n_rows, CAST({len(SCHEMAS[rel])} AS BIGINT) AS n_columns FROM {rel}")


NUMERIC_TYPES = "('numeric', 'binary', 'categorical_numeric', 'identifier')"


def numeric_stats(rel: str) -> str:
    return wrap(rel, profiled_sql(rel), f"""
SELECT column_name, non_null AS n, min, max, mean, median,
       CASE WHEN non_null > 1 THEN std END AS std, q1, q3, q3 - q1 AS iqr,
       CASE WHEN non_null >= 3 THEN round(skew_adj, 10) END AS skew, zero_count, negative_count
FROM prof WHERE semantic_type IN {NUMERIC_TYPES} AND type_class IN ('integral', 'fractional') AND non_null > 0""")


def _iqr_parts(rel: str) -> tuple[str, str]:
    num = [(n, d) for n, d in SCHEMAS[rel] if cls_of(d) in ("integral", "fractional")]
    counts = " UNION ALL ".join(
        f"SELECT {lit(n)} AS column_name, count_if(CAST(s.{q(n)} AS DOUBLE) < b.lower OR CAST(s.{q(n)} AS DOUBLE) > b.upper) AS c "
        f"FROM src s, bounds b WHERE b.column_name = {lit(n)} AND b.q3 > b.q1" for n, _ in num) \
        or "SELECT CAST(NULL AS VARCHAR) AS column_name, 0 AS c WHERE false"
    ctes = f"""bounds AS (
  SELECT column_name, non_null AS n, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM prof WHERE semantic_type IN {NUMERIC_TYPES} AND type_class IN ('integral', 'fractional') AND non_null > 0),
cnts AS ({counts})"""
    select = """SELECT b.column_name, b.lower, b.upper, CAST(coalesce(c.c, 0) AS BIGINT) AS outlier_count,
       round(CAST(coalesce(c.c, 0) AS DOUBLE) / b.n * 100, 3) AS outlier_pct
FROM bounds b LEFT JOIN cnts c ON b.column_name = c.column_name"""
    return ctes, select


def iqr_outliers(rel: str) -> str:
    ctes, select = _iqr_parts(rel)
    return wrap(rel, profiled_sql(rel) + ", " + ctes, select)


def top_values(rel: str, k: int = K.TOP_VALUES) -> str:
    return wrap(rel, profiled_sql(rel) + ", " + long_values_sql(rel), f"""
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, count, pct FROM (
  SELECT f.column_name, f.value, f.cnt AS count, round(CAST(f.cnt AS DOUBLE) / p.n_rows * 100, 3) AS pct,
         row_number() OVER (PARTITION BY f.column_name ORDER BY f.cnt DESC, f.value ASC) AS rank
  FROM freq f JOIN prof p ON f.column_name = p.column_name
  WHERE p.semantic_type IN ('categorical', 'binary', 'constant', 'high_cardinality_categorical', 'categorical_numeric')
) t WHERE rank <= {k}""")


def sample_values(rel: str, n: int = K.SAMPLE_VALUES) -> str:
    return wrap(rel, src_cte(rel) + ", " + long_values_sql(rel), f"""
SELECT column_name, CAST(rank AS INTEGER) AS rank, value FROM (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY md5(value)) AS rank
  FROM freq) t WHERE rank <= {n}""")


def datetime_candidates(rel: str) -> str:
    return wrap(rel, profiled_sql(rel), f"""
SELECT column_name, non_null, dt_parsed,
       coalesce(CAST(dt_parsed AS DOUBLE) / nullif(non_null, 0), 0.0) >= {K.DATETIME_PARSE_THRESHOLD} AS looks_like_datetime
FROM prof WHERE type_class = 'string'""")


def datetime_stats(rel: str) -> str:
    return wrap(rel, profiled_sql(rel),
                "SELECT column_name, dt_min AS min, dt_max AS max FROM prof WHERE semantic_type = 'datetime'")


def datetime_string_stats(rel: str) -> str:
    return wrap(rel, profiled_sql(rel), """
SELECT column_name, dt_parsed, dt_parsed_min AS min, dt_parsed_max AS max, dt_span_days AS span_days,
       non_null - dt_parsed AS unparseable_count FROM prof WHERE semantic_type = 'datetime_string'""")


def text_stats(rel: str) -> str:
    return wrap(rel, profiled_sql(rel), """
SELECT column_name, len_min AS min_length, len_max AS max_length, round(len_avg, 2) AS mean_length
FROM prof WHERE semantic_type = 'text'""")


def _corr_parts(rel: str, k: int = K.TOP_CORRELATION_PAIRS,
                min_abs: float = K.CORRELATION_MIN_ABS) -> tuple[str, str]:
    num = [n for n, d in SCHEMAS[rel] if cls_of(d) in ("integral", "fractional")]
    pairs = [(a, b) for x, a in enumerate(num) for b in num[x + 1:]]
    sel = " UNION ALL ".join(
        f"SELECT {i} AS pair_idx, {lit(a)} AS a, {lit(b)} AS b, corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE)) AS r FROM src"
        for i, (a, b) in enumerate(pairs)) or \
        "SELECT 0 AS pair_idx, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS DOUBLE) AS r WHERE false"
    ctes = f"""allp AS ({sel}),
usable AS (SELECT column_name FROM prof WHERE semantic_type IN ('numeric', 'binary', 'categorical_numeric')),
kept AS (SELECT pair_idx, a, b, r, abs(round(r, 4)) AS r4 FROM allp
         WHERE a IN (SELECT column_name FROM usable) AND b IN (SELECT column_name FROM usable)
           AND r IS NOT NULL AND NOT isnan(r) AND abs(round(r, 4)) >= {min_abs}),
corr_ranked AS (SELECT a, b, r, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a, b, r, row_number() OVER (ORDER BY r4 DESC, pair_idx ASC) AS rank FROM kept) t
  WHERE rank <= {k})"""
    return ctes, "SELECT a, b, r, rank FROM corr_ranked"


def correlations(rel: str, k: int = K.TOP_CORRELATION_PAIRS) -> str:
    ctes, select = _corr_parts(rel, k)
    return wrap(rel, profiled_sql(rel) + ", " + ctes, select)


def duplicate_rows(rel: str) -> str:
    cols = ", ".join(q(n) for n, _ in SCHEMAS[rel])
    return wrap(rel, src_cte(rel), f"""
SELECT CAST(coalesce(sum(cnt - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS cnt FROM src GROUP BY {cols}) g""")


_WIDTH = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8, "boolean": 1, "date": 4}


def column_bytes(rel: str) -> str:
    parts = []
    for name, dtype in SCHEMAS[rel]:
        if dtype == "string":
            size = f"coalesce(sum(strlen({q(name)})), 0)"
        else:
            size = f"count({q(name)}) * {_WIDTH[dtype]}"
        parts.append(f"SELECT {lit(name)} AS column_name, CAST({size} AS BIGINT) AS bytes FROM {rel}")
    return wrap(rel, "x AS (SELECT 1)", " UNION ALL ".join(parts))


def quality_warnings(rel: str) -> str:
    cols = ", ".join(q(n) for n, _ in SCHEMAS[rel])
    iqr_ctes, iqr_select = _iqr_parts(rel)
    corr_ctes, _ = _corr_parts(rel)
    return wrap(rel, profiled_sql(rel) + f""",
dup AS (SELECT CAST(coalesce(sum(cnt - 1), 0) AS BIGINT) AS d FROM (SELECT count(*) AS cnt FROM src GROUP BY {cols}) g),
nr AS (SELECT n_rows FROM prof LIMIT 1),
ns AS ({_numeric_stats_select()}),
{iqr_ctes},
ol AS ({iqr_select}),
{corr_ctes},
cr AS (SELECT a, b, r FROM corr_ranked)""", f"""
SELECT 'duplicate_rows' AS code, 'warning' AS severity, CAST(NULL AS VARCHAR) AS column_name, CAST(d AS DOUBLE) AS value,
       printf('%d repeated rows (%.1f%%).', d, round(CAST(d AS DOUBLE) / n_rows * 100, 1)) AS message
FROM dup, nr WHERE d > 0
UNION ALL SELECT 'all_null', 'error', column_name, null_pct, 'Holds nulls only.'
FROM prof WHERE semantic_type = 'empty'
UNION ALL SELECT 'high_null', 'warning', column_name, null_pct, printf('%.1f%% null, much for imputation.', round(null_pct, 1))
FROM prof WHERE semantic_type <> 'empty' AND null_pct >= {K.HIGH_NULL_PCT}
UNION ALL SELECT 'has_nulls', 'info', column_name, null_pct, printf('%.1f%% null.', round(null_pct, 1))
FROM prof WHERE semantic_type <> 'empty' AND null_pct < {K.HIGH_NULL_PCT} AND null_pct > 0
UNION ALL SELECT 'constant', 'warning', column_name, CAST(unique_count AS DOUBLE), 'Holds one value only.'
FROM prof WHERE semantic_type = 'constant'
UNION ALL SELECT 'identifier', 'info', column_name, CAST(unique_count AS DOUBLE), 'Unique in every row, as an identifier is.'
FROM prof WHERE semantic_type = 'identifier'
UNION ALL SELECT 'high_cardinality', 'warning', column_name, CAST(unique_count AS DOUBLE), printf('%d categories, many for one-hot encoding.', unique_count)
FROM prof WHERE semantic_type = 'high_cardinality_categorical'
UNION ALL SELECT 'outliers', 'info', column_name, outlier_pct, printf('%d values outside the IQR fences (%.1f%%).', outlier_count, round(outlier_pct, 1))
FROM ol WHERE outlier_pct >= {K.OUTLIER_WARN_PCT}
UNION ALL SELECT 'skewed', 'info', column_name, skew, printf('Skewness %.2f.', round(skew, 2))
FROM ns WHERE abs(round(skew, 4)) > {K.SKEW_WARN_ABS}
UNION ALL SELECT 'collinear', 'warning', a, r, printf('Almost collinear with ''%s''.', b)
FROM cr WHERE abs(round(r, 4)) >= {K.COLLINEAR_ABS}
UNION ALL SELECT 'few_rows', 'warning', NULL, CAST(n_rows AS DOUBLE), printf('%d rows, few for a model.', n_rows)
FROM nr WHERE n_rows < {K.FEW_ROWS}""")


def _numeric_stats_select() -> str:
    return (f"SELECT column_name, CASE WHEN non_null >= 3 THEN round(skew_adj, 10) END AS skew FROM prof "
            f"WHERE semantic_type IN {NUMERIC_TYPES} AND type_class IN ('integral', 'fractional') AND non_null > 0")


def warning_counts(rel: str) -> str:
    inner = quality_warnings(rel)
    return f"SELECT severity, count(*) AS n_warnings FROM ({inner}) w GROUP BY severity"


def target_candidates(rel: str, k: int = K.MAX_TARGET_CANDIDATES) -> str:
    last = len(SCHEMAS[rel]) - 1
    return wrap(rel, profiled_sql(rel) + f""",
named AS (SELECT *, ({name_match_sql('column_name')}) AS named FROM prof),
scored AS (
  SELECT column_name, position, semantic_type, unique_count, named,
         CASE WHEN semantic_type = 'numeric' THEN 'regression' ELSE 'classification' END AS task_type,
         least(CASE WHEN semantic_type = 'binary' THEN 90
                    WHEN semantic_type IN ('categorical', 'categorical_numeric') THEN 70
                    WHEN semantic_type = 'numeric' THEN 60 END
               + CASE WHEN named THEN 25 ELSE 0 END + CASE WHEN position = {last} THEN 10 ELSE 0 END, 100) / 100.0E0 AS confidence
  FROM named
  WHERE semantic_type IN ('binary', 'categorical', 'categorical_numeric', 'numeric') AND null_pct <= {K.TARGET_MAX_NULL_PCT})""", f"""
SELECT CAST(rank AS INTEGER) AS rank, column_name, task_type, confidence,
       printf('%s column with %d distinct values%s', semantic_type, unique_count,
              CASE WHEN named THEN ', name suggests a target' ELSE '' END) AS reason
FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, position ASC) AS rank FROM scored) t
WHERE rank <= {k}""")


def name_match_sql(expr: str) -> str:
    kws = ", ".join(lit(k) for k in K.TARGET_KEYWORDS)
    long_kws = [k for k in K.TARGET_KEYWORDS if len(k) >= K.MIN_SUBSTRING_KEYWORD]
    subs = " OR ".join(f"contains(lower({expr}), {lit(k)})" for k in long_kws)
    return (f"(len(list_intersect(string_split_regex(lower({expr}), '[^a-z0-9]+'), [{kws}])) > 0 "
            f"OR {subs})")
