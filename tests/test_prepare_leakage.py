import math

import numpy as np
from pyspark.sql import functions as F

from tabvet.operators import leakage as LK
from tabvet.operators import metrics as M
from tabvet.operators import prepare as FP


def test_split_is_disjoint_complete_and_stratified(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y int")
    s = FP.split(df, "id", "y")
    assert s.count() == 1000 and s.select("id").distinct().count() == 1000
    n_test = s.where("is_test").count()
    assert n_test == math.ceil(0.2 * 1000)
    by = {r["y"]: r["n"] for r in s.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert by == {1: 67, 0: 133}
    again = FP.split(df, "id", "y")
    assert sorted(r["id"] for r in again.where("is_test").collect()) == \
        sorted(r["id"] for r in s.where("is_test").collect())


def test_nmi_of_a_copy_is_one(spark):
    rows = [(i, i % 3, f"c{i % 3}", float(i % 17)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, copy string, noise double")
    scores = {r["column_name"]: r["score"] for r in LK.nmi_scores(df, "y", ["copy", "noise"]).collect()}
    assert scores["copy"] == 1.0 and scores["noise"] < 0.2


def test_leakage_error_when_all_features_leak(spark):
    rows = [(i % 2, i % 2, "a" if i % 2 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "y int, copy_a int, copy_b string")
    findings = LK.detect_leakage(df, "y", ["copy_a", "copy_b"])
    try:
        LK.leaked_columns(findings, ["copy_a", "copy_b"])
        raise AssertionError("expected a TrainingError")
    except FP.TrainingError:
        pass


def test_additive_leakage_detected_and_honest_target_not(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        fare, tip, tolls, dist = rng.uniform(5, 50), rng.uniform(0, 10), rng.uniform(0, 5), rng.uniform(1, 20)
        size, quality = rng.uniform(0.2, 3), int(rng.integers(1, 6))
        rows.append((fare, tip, tolls, dist, fare + tip + tolls, size, float(quality),
                     float(size ** 2 * quality * 1000 + rng.normal(0, 500))))
    df = spark.createDataFrame(rows, "fare double, tip double, tolls double, distance double, total double, "
                                     "size double, quality double, price double")
    add = LK.detect_additive(df, "total", ["fare", "tip", "tolls", "distance"]).first()
    assert add["is_derived"] and add["r2"] > 0.999
    honest = LK.detect_additive(df, "price", ["size", "quality"]).first()
    assert not honest["is_derived"]


def test_roc_auc_with_ties_matches_pairs(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.uniform(size=300) + 0.3 * y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = M.roc_auc(df, "y", "s").first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert math.isclose(auc, brute, rel_tol=1e-12)


def test_weighted_f1_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    m = M.classification_metrics(df, "y", "p").first()
    assert math.isclose(m["accuracy"], 2 / 3)
    assert math.isclose(m["f1"], (2 / 3) * (2 * 1 * (2 / 3) / (1 + 2 / 3)))


def test_quantile_bins_right_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    out = FP.discretise(df, "x").groupBy("x_bin").count().collect()
    assert len(out) == 12 and sum(r["count"] for r in out) == 100


def test_split_takes_digits_made_before(spark):
    df = spark.range(700).selectExpr("id % 500 k", "cast(id % 3 = 0 as int) y")  # keys repeat
    plain = FP.split(df, "k", "y")
    given = FP.split(df.withColumn("d", FP.hash_digits("k")), "k", "y", digits="d")
    assert given.columns == plain.columns and sorted(given.collect()) == sorted(plain.collect())
    assert given.where("is_test").count() == 140


def test_contingency_counts_bins(spark):
    rows = [(i % 2, float(i), v, t) for i, (v, t) in enumerate([(0.0, "a"), (-0.0, "nan"), (None, None), (float("nan"), "a")] * 10)]
    df = spark.createDataFrame(rows, "y int, wide double, few double, t string")
    ct = {tuple(r) for r in LK.contingency(df, "y", ["wide", "few", "t"], 10).select("feature", "x", "y", "n").collect()}
    assert {r for r in ct if r[0] == "few"} == {("few", "0.0", "0.0", 10), ("few", "-0.0", "1.0", 10), ("few", "nan", "0.0", 10), ("few", "nan", "1.0", 10)}
    assert {r for r in ct if r[0] == "t"} == {("t", "a", "0.0", 10), ("t", "nan", "1.0", 10), ("t", "nan", "0.0", 10), ("t", "a", "1.0", 10)}
    assert {r for r in ct if r[0] == "wide"} == {("wide", str(b), y, 2) for b in range(10) for y in ("0.0", "1.0")}
