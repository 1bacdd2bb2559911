import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabvet.functions import exprs as X
from tabvet.functions.moments import pair_correlations
from tabvet.functions.quantiles import column_medians, grouped_quantile, select_ranks, sortable, unsorted
from tabvet.operators import profile as P


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_semantic_types_decision_list(spark):
    n = 300
    rows = [(i, float(i % 7) if i % 10 else None, f"r{i % 4}", "IN", None, i % 2,
             "2020-01-%02d" % (i % 28 + 1), "x" * 50 + str(i), i % 30, True)
            for i in range(n)]
    df = _df(spark, rows, "row_id long, age double, region string, country string, blank double, "
                          "churn int, joined string, notes string, small int, flag boolean")
    types = {r["column_name"]: r["semantic_type"] for r in P.column_profile(df).collect()}
    assert types == {"row_id": "identifier", "age": "numeric", "region": "categorical",
                     "country": "constant", "blank": "empty", "churn": "binary",
                     "joined": "datetime_string", "notes": "identifier", "small": "categorical_numeric",
                     "flag": "constant"}


def test_identifier_tolerates_a_few_duplicates(spark):
    rows = [(i if i < 995 else 0,) for i in range(1000)]
    df = _df(spark, rows, "id long")
    assert P.column_profile(df).first()["semantic_type"] == "identifier"


def test_integer_with_nulls_is_not_integer_like(spark):
    rows = [(i % 5 if i % 9 else None,) for i in range(200)]
    df = _df(spark, rows, "k int")
    assert P.column_profile(df).first()["semantic_type"] == "numeric"


def test_numeric_stats_match_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.exponential(3.0, 500)
    df = _df(spark, [(float(v),) for v in x], "v double")
    s = P.numeric_stats(df).first()
    ser = pd.Series(x)
    assert math.isclose(s["median"], ser.median(), rel_tol=1e-12)
    assert math.isclose(s["q1"], ser.quantile(0.25), rel_tol=1e-12)
    assert math.isclose(s["q3"], ser.quantile(0.75), rel_tol=1e-12)
    assert math.isclose(s["std"], ser.std(), rel_tol=1e-9)
    assert math.isclose(s["skew"], round(ser.skew(), 10), rel_tol=1e-8)


def test_radix_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    one = np.concatenate([rng.normal(0, 1, 3000), rng.integers(0, 20, 2000).astype(float)])
    two = np.concatenate([rng.normal(0, 1, 1000) * 10.0 ** rng.integers(-300, 300, 1000), [-0.0, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 5, [7.0] * 3970])
    df = _df(spark, [(float(a), float(b), None if i % 3 else i % 5, None, "g" if i % 4 else None) for i, (a, b) in enumerate(zip(one, two))],
             "v double, w double, `k.x` int, none double, g string").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    few = np.array([i % 5 for i in range(5000) if i % 3 == 0], float)
    q, distinct = select_ranks(df, ["v", "w", "k.x", "none"], probs, 12)
    for got, x in zip(q, (one, two, few), strict=False):
        assert np.allclose(got, np.quantile(x, probs), rtol=1e-12)
    assert q[3] is None and distinct == [13, 13, 5, 0]
    assert column_medians(df, ["w", "none"]) == {"w": float(np.median(two)), "none": None}
    keys = sortable(np.sort(two))
    assert (np.diff(keys) >= 0).all() and (unsorted(keys) == np.sort(two)).all()
    for p in (0.5, 0.3, 1.0):
        got = {r["g"]: r["q"] for r in grouped_quantile(df, "g", "w", p).collect()}
        for g in ("g", None):
            x = np.array([b for i, b in enumerate(two) if (i % 4 != 0) == (g == "g")])
            assert math.isclose(got[g], np.quantile(x, p), rel_tol=1e-12)
    assert grouped_quantile(df.where("w is null"), "g", "w", 0.5).count() == 0


def test_top_values_ties_and_pct(spark):
    rows = [("a",)] * 3 + [("b",)] * 3 + [("c",)] * 1 + [(None,)] * 3
    df = _df(spark, rows, "k string")
    top = [(r["value"], r["count"], r["pct"]) for r in P.top_values(df).orderBy("rank").collect()]
    assert top == [("a", 3, 30.0), ("b", 3, 30.0), ("c", 1, 10.0)]


def test_duplicates_and_warnings(spark):
    rows = [(1, "x"), (1, "x"), (2, None), (2, None), (3, "y")]
    df = _df(spark, rows, "a int, b string")
    assert P.duplicate_rows(df).first()[0] == 2
    codes = {r["code"] for r in P.quality_warnings(df).collect()}
    assert {"duplicate_rows", "has_nulls", "few_rows"} <= codes


def test_collinear_and_correlations(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=400)
    rows = [(float(x), float(2 * x + 1e-3 * rng.normal()), float(rng.normal())) for x in a]
    df = _df(spark, rows, "a double, b double, c double")
    pairs = P.correlations(df).collect()
    assert pairs[0]["a"] == "a" and pairs[0]["b"] == "b" and pairs[0]["r"] > 0.99
    assert any(r["code"] == "collinear" for r in P.quality_warnings(df).collect())


def test_target_keywords_tokenised(spark):
    names = [("monthly_charges",), ("churn",), ("y",), ("saleprice",), ("label_id",), ("city",)]
    df = _df(spark, names, "n string")
    got = {r["name"]: r["suggests_target"] for r in P.target_name_match(df, "n").collect()}
    assert got == {"monthly_charges": False, "churn": True, "y": True, "saleprice": True,
                   "label_id": True, "city": False}


def test_target_candidates_ranking(spark):
    rows = [(i, i % 2, float(i) * 1.5, f"c{i % 3}") for i in range(300)]
    df = _df(spark, rows, "row_id long, churn int, amount double, plan string")
    c = P.target_candidates(df).orderBy("rank").collect()
    assert c[0]["column_name"] == "churn" and c[0]["confidence"] == 1.0
    assert all(r["column_name"] != "row_id" for r in c)


def test_flagship_entry_runs(spark):
    import __spark_entry__ as entry
    out = entry.entry(spark)
    assert out.count() == 11 and "semantic_type" in out.columns


def test_correlations_of_300_columns_with_nulls(spark):
    rng = np.random.default_rng(5)
    n, k = 400, 300
    base = rng.normal(size=(n, 12))
    x = base @ rng.normal(size=(12, k)) + rng.normal(size=(n, k)) * 2 + 1e6 * rng.integers(0, 2, k)
    x[rng.random((n, k)) < 0.1] = np.nan
    x[:, 7] = 3.25
    x[:, 11] = np.where(np.isnan(x[:, 11]), np.nan, x[:, 10] * -2 + 1)
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])
    df = spark.createDataFrame(frame).repartition(3)
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in pair_correlations(df, list(frame.columns)).collect()}
    ref = frame.corr().to_numpy()
    both = (~np.isnan(x)).astype(int).T @ (~np.isnan(x)).astype(int)
    assert set(got) == {(i, j) for i in range(k) for j in range(i + 1, k) if 7 not in (i, j)}
    for (i, j), (m, r) in got.items():
        assert m == both[i, j] and math.isclose(r, ref[i, j], rel_tol=1e-9, abs_tol=1e-9)
    assert pair_correlations(df.limit(0), ["c0", "c1"]).count() == 0


def test_date_shapes(spark):
    values = {"day": ["25/5/2020", "1/6/2020", "3/12/2020"], "month": ["1/5/2020", "5/25/2020", "12/3/2020 4:05"],
              "iso": ["2020-01-02T03:04:05.000", "2020-01-02 03:04:05Z", "2020-01-02T03:04:05.25+05:30"], "odd": ["2020-1-2T", "1/5/20", "99/99/2020"]}
    df = _df(spark, list(zip(*values.values())), ", ".join(f"{c} string" for c in values))
    got = {r["column_name"]: r["dt_parsed"] for r in P.datetime_candidates(df).collect()}
    assert got == {"day": 3, "month": 3, "iso": 3, "odd": 0}
    span = {r["column_name"]: (r["min"], r["max"]) for r in P.datetime_string_stats(df.select("day", "month", "iso")).collect()}
    assert span == {"day": ("2020-05-25 00:00:00", "2020-12-03 00:00:00"), "month": ("2020-01-05 00:00:00", "2020-12-03 04:05:00"),
                    "iso": ("2020-01-01 21:34:05", "2020-01-02 03:04:05")}


def test_long_values_are_counted_by_digest(spark):
    long = "a text that is longer than forty characters, "
    rows = [(f"{long}{i % 3}",) for i in range(9)] + [("short",)] * 3 + [(f"s{i}",) for i in range(90)]
    df = _df(spark, rows, "t string")
    freq = P.value_frequencies(df)
    assert freq.where(F.length("value") > P.LONG_VALUE).count() == 0 and freq.count() == 94
    assert P.unique_counts(df).first()["unique_count"] == 94
    top = [(r["value"], r["count"]) for r in P.top_values(df, 5).orderBy("rank").collect()]
    assert top == [(f"{long}0", 3), (f"{long}1", 3), (f"{long}2", 3), ("short", 3), ("s0", 1)]
    assert {r["value"] for r in P.sample_values(df, 94).collect()} == {r[0] for r in rows}


def test_only_texts_that_could_be_dates_are_parsed(spark, sf):
    from tabvet.functions.exprs import looks_like_date, parse_datetime
    from tabvet.sources.fixtures import relation
    ids = relation(spark, sf, "fx_sum").select(F.col("row_id").alias("t"))
    assert ids.where(looks_like_date(F.col("t"))).isEmpty()
    dates = relation(spark, sf, "fx_dates")
    texts = dates.select(F.explode(F.array(*[F.col(c) for c, kind in dates.dtypes if kind == "string"])).alias("t")).unionByName(ids)
    for day in (True, False):
        parsed = parse_datetime(F.col("t"), F.lit(day)).isNotNull()
        assert texts.where(parsed & ~looks_like_date(F.col("t"))).isEmpty() and not texts.where(parsed).isEmpty()


def test_dates_are_told_from_ids_whatever_their_separators(spark):
    texts = ["2020-01-05", "2020-01-05 01:02:03", "2020-01-05T01:02:03", "2020-01-05 01:02", "2020/1/5", "5-Mar-2020", "15-Mar-2020", "Mar 5 2020", "20200105",
             "1/5/2020", "13/5/2020", "1/5/2020 1:02", "01/05/2020 1:02:03", "2020-01-05T01:02:03.5Z", "2020-01-05 01:02:03+0530"]
    ids = ["123456-1-155-770-211", "1-2-3", "12-34", "ab/cd", "12345678901", "", "4000-1-7-8-9"]
    df = spark.createDataFrame([(t,) for t in texts + ids] + [(None,)], "t string")
    got = {r["t"]: (r["d"], r["p"] is not None) for r in df.select("t", X.looks_like_date(F.col("t")).alias("d"), X.parse_datetime(F.col("t"), F.lit(True)).alias("p")).collect()}
    assert all(got[t] == (True, True) for t in texts) and not any(got[t][0] or got[t][1] for t in ids)
    days = ["13/5/2020", "1/2/2020"]
    prof = P.profiled(spark.createDataFrame([(days[i % 2], f"{i}-1", i % 3 == 0) for i in range(40)], "day string, id string, flag boolean"))
    rows = {r["column_name"]: r for r in prof.collect()}
    assert rows["day"]["dt_parsed"] == 40 and rows["day"]["dt_parsed_min"] == "2020-02-01 00:00:00" and rows["day"]["unique_count"] == 2
    assert rows["id"]["dt_parsed"] == 0 and rows["id"]["unique_count"] == 40 and rows["id"]["len_max"] == 4 and rows["flag"]["len_min"] == 4
