"""Permutation importance against permuting and scoring by hand."""
import hashlib
import math

import numpy as np
import pytest

from tabvet.functions.bijection import deal
from tabvet.operators import explain as E
from tabvet.operators import models as MD


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_deal_is_a_bijection(n):
    ranks = np.arange(n)
    for key in (0, 1, 7, 10**12):
        assert sorted(deal(ranks, n, np.full(n, key))) == list(range(n))
    if n == 1000:
        one, two = deal(ranks, n, np.full(n, 1)), deal(ranks, n, np.full(n, 2))
        assert (one != two).mean() > 0.9 and (one != ranks).mean() > 0.9 and abs(np.corrcoef(one, ranks)[0, 1]) < 0.15


def by_hand(rows, columns, sources, repeats, seed):
    """{(feature, repeat): rows with that column dealt out}"""
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|rank{seed}".encode()).hexdigest(), r[0]))
    out, n = {}, len(rows)
    for i, f in enumerate(sources):
        for k in range(repeats):
            to = deal(np.arange(n), n, np.full(n, (i * repeats + k) * 1_000_003 + seed))
            copy = [list(r) for r in order]
            for j, r in enumerate(order):
                copy[to[j]][columns.index(f)] = r[columns.index(f)]
            out[f, k] = sorted(map(tuple, copy))
    return out


def test_permuted_rows(spark):
    columns = ["id", "label", "x", "t"]
    rows = [(i, float(i % 2), None if i % 9 == 0 else float(i), f"t{i % 7}" if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label double, x double, t string").repartition(4)
    want = by_hand(rows, columns, ["x", "t"], 3, 42)
    for per_task in (1000, 37):
        got = {}
        for r in E.permuted(df, ["x"], ["t"], "id", 3, 42, 300, per_task).collect():
            got.setdefault((r["_feature"], r["_repeat"]), []).append(tuple(r[c] for c in columns))
        key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
        assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items()}


def test_importances(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal()), ["a", "b"][i % 2]) for i in range(500)]
    rows = [(*r, int(r[1] + 0.3 * rng.normal() > 0)) for r in rows]
    df = spark.createDataFrame(rows, "id long, x double, noise double, kind string, label int")
    out = MD.train(df, "label", "classification", key="id", model_names=["logistic_regression"])
    model, prep = out.models["logistic_regression"], out.prep
    sources = prep.numeric + prep.categorical
    columns = ["id", "label", *sources]
    test = [tuple(r) for r in out.test.select("id", "label", *sources).collect()]

    def accuracy(rows):
        frame = prep.transform(spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in prep.categorical else 'double'}" for c in columns)), ["id", "label"])
        x = np.array([r["features"].toArray() for r in frame.select("features").collect()])
        y = np.array([r["label"] for r in frame.select("label").collect()])
        return np.mean((x @ model.coefficients.toArray() + model.intercept > 0) == (y > 0.5))

    dealt = by_hand(test, columns, sources, 2, 42)
    base = accuracy([tuple(float(v) if not isinstance(v, str) else v for v in r) for r in test])
    want = {f: max(0.0, np.mean([base - accuracy([tuple(float(v) if not isinstance(v, str) else v for v in r) for r in dealt[f, k]]) for k in range(2)])) for f in sources}
    got = {r["feature"]: r["importance"] for r in E.permutation_importance(model, prep, out.test, "id", True, repeats=2).collect()}
    assert set(got) == set(want) and all(math.isclose(got[f], want[f], abs_tol=1e-12) for f in want)
    assert got["x"] > 0.2 and got["x"] > 5 * got["noise"]
