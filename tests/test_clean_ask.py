import pytest
from pyspark.sql import functions as F

from tabvet.operators import ask as Q
from tabvet.operators import clean as C
from tabvet.operators import profile as P


def test_trim_then_markers_then_empty_then_dedupe(spark):
    rows = [(1, " N/A "), (1, "unknown"), (2, "\tok\n"), (2, "ok")]
    df = spark.createDataFrame(rows, "a int, junk string")
    res = C.clean(df)
    actions = [r["action"] for r in res.report.orderBy("step").collect()]
    assert actions == ["trim_whitespace", "normalise_missing", "drop_duplicate_rows"]
    out = sorted(tuple(r) for r in res.table.collect())
    assert out == [(1, None), (2, "ok")]
    s = res.summary.first()
    assert (s["rows_before"], s["rows_after"], s["changed"]) == (4, 2, True)


def test_all_placeholder_column_dropped(spark):
    df = spark.createDataFrame([(1, "?"), (2, "-"), (3, "\\n")], "id int, city string")
    res = C.clean(df)
    assert res.dropped_columns == ["city"]
    assert res.table.columns == ["id"]


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(1, " a "), (1, " a "), (2, "NULL")], "id int, s string")
    once = C.clean(df).table
    twice = C.clean(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.table.collect()))
    assert twice.report.count() == 0


def test_clean_or_raw_falls_back(spark):
    class Broken:
        columns = ["x"]

        def __getattr__(self, item):
            raise RuntimeError("boom")
    table, report = C.clean_or_raw(Broken())
    assert report is None


@pytest.fixture
def adhoc(spark):
    rows = [(["North", "South", "East"][i % 3], float(i), i % 5, f"note {i}", None if i % 4 == 0 else "v")
            for i in range(200)]
    return spark.createDataFrame(rows, "region string, revenue double, units int, notes string, optional string")


def test_resolve_and_errors(adhoc):
    assert Q.resolve(adhoc, "REGION") == "region"
    with pytest.raises(Q.ToolError):
        Q.resolve(adhoc, "nope")
    err = Q.ask(adhoc, "CountRows", {"column": "revenue", "operator": ">", "value": "abc"}).first()
    assert "not a number" in err["error"]
    assert "no tool" in Q.ask(adhoc, "RunPython", {}).first()["error"]


def test_count_ne_keeps_nulls_and_contains_is_regex(adhoc):
    ne = Q.count_where(adhoc, "optional", "!=", "v").first()
    assert ne["matched"] == 50
    c = Q.count_where(adhoc, "notes", "contains", "NOTE 1[0-9]$").first()
    assert c["matched"] == 10


def test_aggregate_truncation_and_null_group(spark):
    rows = [(f"k{i}", i) for i in range(500)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    out = Q.aggregate(df, "k", "v", "sum").collect()
    assert len(out) == 25 and out[0]["truncated"] and out[0]["total_groups"] == 501


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "g string, v double")
    out = {r["group"]: r["metric"] for r in Q.aggregate(df, "g", "v", "sum").collect()}
    assert out == {"a": 0.0, "b": 2.0}
    out = {r["group"]: r["metric"] for r in Q.aggregate(df, "g", "v", "mean").collect()}
    assert out["a"] is None


def test_duplicates_by_digest(spark):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, "a", "1"), (2, "x", "y"), (2, "x", "y"), (2, "x", "y")]
    df = spark.createDataFrame(rows, "i int, s string, t string").selectExpr("*", "CASE WHEN i = 1 THEN double('NaN') WHEN i = 2 THEN -0.0D ELSE 0.0D END AS d")
    df = df.unionByName(df.where("i = 2").withColumn("d", F.lit(0.0)))
    assert P.duplicate_rows(df).first()[0] == 6
    key = lambda r: repr(tuple(r)).replace("-0.0", "0.0")
    got = sorted(map(key, C.drop_duplicate_rows(df).collect()))
    assert got == sorted(map(key, df.dropDuplicates().collect())) and len(got) == 4
    cleaned = C.clean(df.withColumn("e", F.lit(" n/a ")))
    assert [tuple(r) for r in cleaned.summary.collect()] == [(10, 4, 5, 4, True)] and cleaned.dropped_columns == ["e"]
    assert {r["action"]: r["rows_affected"] for r in cleaned.report.collect()} == {
        "trim_whitespace": 0, "normalise_missing": 10, "drop_empty_columns": 0, "drop_duplicate_rows": 6}
    assert cleaned.table.count() == 4 and C.clean(df.limit(0)).table.count() == 0
