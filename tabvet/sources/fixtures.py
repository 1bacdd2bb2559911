"""Derived relations over the driver tables (see FIXTURES.md section 3).

The driver tables are clean, so null, padding, placeholder and duplicate
paths need these. Each relation is one SQL text that runs unchanged on Spark
SQL and on DuckDB; the oracle side embeds the same text as a CTE.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.sources.tables import TABLES, table

_ROW_ID = ("CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
           "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || "
           "CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS STRING)")

FIXTURE_SQL: dict[str, str] = {
    "fx_dirty_orders": """
SELECT o_orderkey, cust_id, status_raw, priority_raw, junk, price, order_day, constant_col, empty_col FROM (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS cust_id,
         CASE WHEN o_orderkey % 7 = 0 THEN '  ' || o_orderstatus || ' '
              WHEN o_orderkey % 7 = 1 THEN 'N/A'
              WHEN o_orderkey % 7 = 2 THEN ' Unknown '
              ELSE o_orderstatus END AS status_raw,
         CASE WHEN o_orderkey % 13 = 0 THEN '-' ELSE o_orderpriority END AS priority_raw,
         CASE WHEN o_orderkey % 2 = 0 THEN '?' ELSE ' n/a ' END AS junk,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 40 = 0 THEN 'not a date' ELSE SUBSTRING(CAST(o_orderdate AS STRING), 1, 10) END AS order_day,
         'IN' AS constant_col, CAST(NULL AS DOUBLE) AS empty_col,
         CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END AS copies
  FROM orders) t JOIN (SELECT 1 AS c UNION ALL SELECT 2 AS c) n ON n.c <= t.copies
""",
    "fx_dates": """
SELECT o_orderkey, d || 'T' || t || '.' || CAST(o_orderkey % 1000 + 1000 AS STRING) AS fraction,
       d || ' ' || t || CASE WHEN o_orderkey % 3 = 0 THEN 'Z' WHEN o_orderkey % 3 = 1 THEN '+05:30' ELSE '-08:00' END AS zoned,
       d || 'T' || t || '.5-0330' AS compact_zone,
       CAST(m AS STRING) || '/' || CAST(dd AS STRING) || '/' || SUBSTRING(d, 1, 4) AS month_first,
       CAST(dd AS STRING) || '/' || CAST(m AS STRING) || '/' || SUBSTRING(d, 1, 4) AS day_first,
       CAST(dd AS STRING) || '/' || CAST(m AS STRING) || '/' || SUBSTRING(d, 1, 4) || ' ' || CAST(o_orderkey % 24 AS STRING) || ':07' AS clock,
       CAST(dd AS STRING) || '-Mar-' || SUBSTRING(d, 1, 4) AS named,
       CASE WHEN o_orderkey % 20 = 0 THEN 'n. d.' WHEN o_orderkey % 2 = 0 THEN d ELSE d || ' ' || t || '.25' END AS mixed,
       CASE WHEN o_orderkey % 4 = 0 THEN '2020-13-45T00:00:00Z' WHEN o_orderkey % 4 = 1 THEN '31/31/2020' ELSE d || 'T99:00:00.5' END AS wrong
FROM (SELECT o_orderkey, SUBSTRING(CAST(o_orderdate AS STRING), 1, 10) AS d, '0' || CAST(o_orderkey % 10 AS STRING) || ':15:2' || CAST(o_orderkey % 7 AS STRING) AS t,
             CAST(SUBSTRING(CAST(o_orderdate AS STRING), 6, 2) AS INT) AS m, CAST(SUBSTRING(CAST(o_orderdate AS STRING), 9, 2) AS INT) AS dd FROM orders) t
""",
    "fx_leak": """
SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS survived,
       CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS alive,
       o_totalprice AS fare, o_orderpriority AS pclass FROM orders
""",
    "fx_sum": f"""
SELECT {_ROW_ID} AS row_id, l_extendedprice AS fare, l_quantity AS tip, l_tax * 100 AS tolls,
       l_discount AS distance, l_extendedprice + l_quantity + l_tax * 100 AS total FROM lineitem
""",
    "fx_missing": f"""
SELECT {_ROW_ID} AS row_id,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS measured, l_tax AS noise,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem
""",
    "fx_scores": f"""
SELECT {_ROW_ID} AS row_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       (l_quantity + CASE WHEN l_returnflag = 'R' THEN 15 ELSE 0 END) / 70 AS proba,
       l_extendedprice AS y, l_quantity * 2000 + l_tax * 1000 AS y_hat FROM lineitem
""",
    "fx_projects": """
SELECT c_custkey AS project_id, c_nationkey AS owner_id, c_name AS name FROM customer
""",
    "fx_datasets": """
SELECT o_orderkey AS dataset_id, o_custkey AS project_id, CAST(FLOOR(o_totalprice) AS BIGINT) AS n_rows,
       md5(CAST(o_orderkey % 500 AS STRING)) AS content_hash, o_orderdate AS created_at FROM orders
""",
    "fx_runs": """
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey - 1 ELSE NULL END AS parent_run_id,
       o_custkey AS project_id, CASE WHEN o_orderkey % 4 = 3 THEN 'training_round' ELSE 'analysis' END AS agent_name,
       CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 10 = 1 THEN 'running' WHEN o_orderkey % 10 = 2 THEN 'pending' ELSE 'succeeded' END AS status,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS task_type,
       (o_orderkey * 7 % 101) / 100.0E0 AS primary_value,
       CASE WHEN o_orderkey % 6 = 0 THEN (o_orderkey * 13 % 101) / 100.0E0 ELSE NULL END AS roc_auc,
       o_orderkey * 31 % 600 AS n_train, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 0 END AS leaked_count,
       o_orderkey % 17 = 0 AS derived_target FROM orders
""",
    "fx_importances": """
SELECT l_orderkey AS run_id, CASE l_linenumber WHEN 1 THEN 'age' WHEN 2 THEN 'region_North' WHEN 3 THEN 'region_South'
         WHEN 4 THEN 'plan_type_A' WHEN 5 THEN 'plan_B' WHEN 6 THEN 'missing:age' ELSE 'noise' END AS encoded,
       CASE WHEN l_linenumber = 7 THEN 0.0E0 ELSE MAX(l_discount * l_quantity) END AS importance
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "fx_rounds": """
SELECT l_orderkey AS run_id, l_linenumber - 1 AS round, MAX(l_quantity) / 50 AS gate_value
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
}


def _base_tables(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql.lower()))
    return [t for t in TABLES if t in words]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived relation lazily from the tables of ``sf_dir``.

    Views are registered just before analysis; the returned DataFrame keeps
    its analysed plan, so later re-registration does not affect it.
    """
    sql = FIXTURE_SQL[name]
    for base in _base_tables(sql):
        table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived fixture, by name."""
    if name in FIXTURE_SQL:
        return fixture(spark, sf_dir, name)
    return table(spark, sf_dir, name)


def with_ctes(sql: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it uses."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names)
    return f"WITH {ctes}\n{sql}"


def experiments_from_runs(runs: DataFrame) -> DataFrame:
    """Test relation: two experiment rows per run of a ledger, the forest's
    score made up from the run's primary value, with ``is_selected`` on the
    best; ties go to the first."""
    cls = F.col("task_type") == "classification"
    models = F.array(
        F.struct(F.lit(0).alias("ord"), F.when(cls, "logistic_regression").otherwise("ridge").alias("model_name"),
                 F.col("primary_value").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("random_forest").alias("model_name"),
                 (F.col("primary_value") * F.lit(0.9) + F.lit(0.05)).alias("value")))
    e = runs.where(F.col("agent_name") == "analysis").select(
        "run_id", F.when(cls, "f1").otherwise("r2").alias("primary_metric"), F.inline(models))
    best = e.groupBy("run_id").agg(F.max_by(F.col("ord"), F.struct(F.col("value"), -F.col("ord"))).alias("best_ord"))
    return (e.join(best, "run_id")
            .select("run_id", "model_name", "primary_metric", F.col("value").alias("primary_metric_value"),
                    (F.col("ord") == F.col("best_ord")).alias("is_selected")))
