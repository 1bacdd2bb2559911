import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabvet.operators import explain as E
from tabvet.operators import models as MD


def _forest_data(spark):
    df = spark.range(1500).selectExpr("rand(1) a", "rand(2) b", "rand(3) c")
    df = df.selectExpr("*", "cast(a + 0.4 * b > 0.8 as double) label", "a * 3 + b * b + rand(5) y")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_tree_shap_local_accuracy(spark):
    v = _forest_data(spark)
    for est, cls in ((RandomForestClassifier(numTrees=8, maxDepth=5, seed=1), True),
                     (RandomForestRegressor(numTrees=8, maxDepth=5, seed=1, labelCol="y"), False)):
        m = est.fit(v)
        col = vector_to_array("probability")[1] if cls else "prediction"
        pdf = m.transform(v.limit(40)).select(vector_to_array("features").alias("x"), col).toPandas()
        x = np.stack(pdf["x"].to_numpy())
        assert np.allclose(E.shap_local_accuracy(m, x, cls), pdf.iloc[:, 1].to_numpy(), atol=1e-9)


def test_tree_shap_driver_outranks_noise(spark):
    v = _forest_data(spark).withColumn("k", vector_to_array("features")[0].cast("string"))
    m = RandomForestClassifier(numTrees=10, maxDepth=5, seed=1).fit(v)
    scores, n, _ = E.tree_shap(m, v, ["a", "b", "c"], True, 1, 200, "k")
    s = {r["encoded"]: r["importance"] for r in scores.collect()}
    assert n == 200 and s["a"] > s["b"] > s["c"]


def test_tree_shap_by_blocks_of_trees(spark):
    v = _forest_data(spark)
    for est, cls in ((RandomForestClassifier(numTrees=7, maxDepth=4, seed=1), True), (RandomForestRegressor(numTrees=7, maxDepth=4, seed=1, labelCol="y"), False)):
        m = est.fit(v)
        assert E.forest_blocks(m, cls, 70)[1] >= 3 and E.forest_blocks(m, cls)[1] == 1
        one, many = ({r["encoded"]: r["importance"] for r in E.tree_shap(m, v, ["a", "b", "c"], cls, block_nodes=n)[0].collect()} for n in (10**6, 70))
        assert set(one) == set(many) and all(np.isclose(one[c], many[c], rtol=1e-9) for c in one)


def test_shap_budget(spark):
    nodes = spark.createDataFrame([(653_372,), (10,), (3_000_000,), (0,)], "n long")
    rows, method = E.shap_budget(F.col("n"))
    assert [tuple(r) for r in nodes.select(rows.cast("int"), method).collect()] == [
        (91, "shap"), (500, "shap"), (60, "permutation"), (500, "shap")]


def test_source_mapping_longest_prefix(spark):
    names = spark.createDataFrame([("plan_type_A",), ("plan_B",), ("missing:age",), ("age",)], "encoded string")
    out = {r["encoded"]: r["s"] for r in names.select(
        "encoded", E.source_column(F.col("encoded"), ["age"], ["plan", "plan_type"]).alias("s")).collect()}
    assert out == {"plan_type_A": "plan_type", "plan_B": "plan", "missing:age": "age (was missing)", "age": "age"}


def test_training_removes_leak_and_adds_indicator(spark):
    rows = [(i, i % 2, "yes" if i % 2 else "no", float(i % 13) if i % 2 == 0 else None, float((i * 7) % 11))
            for i in range(600)]
    df = spark.createDataFrame(rows, "id long, survived int, alive string, measured double, noise double")
    o = MD.train(df, "survived", "classification", key="id", model_names=["logistic_regression"])
    assert [n for n, _ in o.leaked_features] == ["alive"]
    assert ("missing:measured", "measured (was missing)") in o.prep.encoded()
    assert o.n_train + o.n_test == 600 and o.best_model == "logistic_regression"


def test_rows_that_no_tree_tells_apart_are_explained_once(spark):
    v = _forest_data(spark)
    m = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(v)
    nodes = E.node_table(m)
    x = vector_to_array("features")
    both = v.select(x.alias("x"), E.told_apart(x, nodes, 3).alias("t")).toPandas()
    assert len({tuple(t) for t in both["t"]}) < len({tuple(t) for t in both["x"]}) / 3
    blocks, _, _ = E.forest_blocks(m, True)
    groups, _ = E.block_paths(blocks, 0)
    phi, same = (E.shap_values(np.stack(both[c].to_numpy()), groups, 3) for c in ("x", "t"))
    assert (phi == same).all()
    scores = {r["encoded"]: r["importance"] for r in E.tree_shap(m, v, ["a", "b", "c"], True)[0].collect()}
    assert np.allclose([scores[c] for c in "abc"], np.abs(phi[:, :, 1]).mean(axis=0), rtol=1e-9)


def test_forest_points_count_every_row(spark):
    rows = spark.range(40_000).selectExpr("cast(id % 3 = 0 as double) label", "array(sqrt(id), cast(id % 2 as double)) x")
    v = rows.select("label", array_to_vector("x").alias("features"))
    points = MD.forest_points(v, 2, [0], 40_000, points=1000).select("label", vector_to_array("features").alias("x"), "weight").toPandas()
    assert np.isclose(points["weight"].sum(), 40_000) and points["weight"].max() <= 40
    assert len(points) <= 1000 + 64 * 2 * 2 and len({x[0] for x in points["x"]}) <= 64
    byclass = points.groupby("label")["weight"].sum()
    assert np.isclose(byclass[1.0], 13_334) and np.isclose(byclass[0.0], 26_666)


def test_forest_is_fitted_on_weighted_points(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id", "rand(1) a", "rand(2) b").selectExpr("*", "cast(a + 0.3 * b > 0.7 as int) survived")
    monkeypatch.setattr(MD, "FOREST_POINTS", 10**6)
    by_rows = MD.train(df, "survived", "classification", key="id", model_names=["random_forest"], trees=10)
    seen = []
    monkeypatch.setattr(MD, "FOREST_POINTS", 1000)
    monkeypatch.setattr(MD, "forest_points", lambda *a, f=MD.forest_points: seen.append(f(*a, points=1000)) or seen[-1])
    merged = MD.train(df, "survived", "classification", key="id", model_names=["random_forest"], trees=10)
    assert np.isclose(seen[0].agg(F.sum("weight")).first()[0], merged.n_train)
    one, other = (o.experiments[0]["primary_metric_value"] for o in (by_rows, merged))
    assert abs(one - other) < 0.03 and other > 0.9


def test_training_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        made.add(1)
        return x

    df = spark.range(900).selectExpr("id", "rand(1) a", "rand(2) b").select("id", "a", noted("b").alias("b"), F.expr("cast(a > 0.6 as int) survived"))
    o = MD.train(df, "survived", "classification", key="id", model_names=["logistic_regression"])
    assert made.value == 900 and o.n_train + o.n_test == 900
    assert o.test.columns == ["id", "label", "a", "b", "features"] == o.train.columns
