"""Hard negatives against scoring every pair."""
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tabvet.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, embedding array<float>, rank int, score string, row int, anchor int"


def by_hand(rows, every=100, positives=5, negatives=10):
    ok = [(i, v, (lab + 1) % 10 if v is not None and v % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in e])
          for i, (v, lab, e, *_) in enumerate(rows)
          if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = Counter()
    order = lambda c: (-c[0], c[1] is None, c[1] or 0, c[2])
    for i, v, lab, e in ok:
        if v is None or v % every:
            continue
        scored = [(sum(a * b for a, b in zip(e, f, strict=False)), w, j, other) for j, w, other, f in ok if j != i]
        for p in sorted((c for c in scored if c[3] == lab), key=order)[:positives]:
            fit = [c for c in scored if c[3] != lab and 30 * p[0] <= 100 * c[0] <= 90 * p[0]]
            for k, c in enumerate(sorted(fit, key=order)[:negatives], 1):
                out[v, p[1], k, c[1], p[0], c[0]] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)


def test_edge_cases(spark):
    r = random.Random(3)
    vector = lambda n=6: [round(r.gauss(0, 1), 2) for _ in range(n)]
    rows = [(i, r.randrange(10), vector()) for i in range(0, 400)]
    rows += [(100, 3, vector()), (200, None, vector()), (300, 4, None), (None, 4, vector()), (None, 5, vector()), (500, 5, [float("nan")] * 6),
             (600, 5, [float("inf")] + [0.0] * 5), (700, 5, [None] * 6), (800, 1, [0.0] * 6), (900, 1, []), (1000, 2, vector(3)), (1100, 77, vector())]
    rows += [rows[0], rows[0], rows[100], rows[5], rows[5]] + [(1200 + i, 3, rows[9][2]) for i in range(30)]
    got = Counter(tuple(x) for x in hn.query(table(spark, rows)).collect())
    expected = by_hand(rows)
    # ids that repeat with one score are interchangeable
    assert got == expected and len(got) > 100
    assert hn.query(table(spark, rows).limit(0)).count() == 0
    assert hn.query(table(spark, [(1, 1, vector()), (3, 2, vector())])).count() == 0
    assert hn.query(table(spark, rows)).dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                                                   ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_large_components(spark):
    """Scores beyond 2**53 are exact; vectors too long for a score don't take part."""
    r = random.Random(9)
    rows = [(i, r.randrange(3), [float(np.float32(r.uniform(-2, 2) * 1e6)) for _ in range(8)]) for i in range(300)]
    rows += [(1000, 1, [1e30] + [0.0] * 7), (1001, 1, [3e38] * 8)]
    got = Counter(tuple(x) for x in hn.query(table(spark, rows)).collect())
    assert got == by_hand(rows[:300]) and len(got) > 20


@pytest.fixture(scope="module")
def clusters():
    r = np.random.default_rng(4)
    centers = r.normal(size=(40, 16)) * 40
    own = r.integers(0, 40, 6000)
    return np.floor(centers[own] + r.normal(size=(6000, 16)) * 3).astype(np.int64), own % 7


def test_tree_covers_and_skips(clusters):
    points, labels = clusters
    ids = np.arange(len(points))
    block = hn.Block.build(points, ids, np.ones(len(points), bool), labels, ids)
    again = hn.Block.unpack(dict(zip(hn.Block.FIELDS, block.pack(), strict=True)))
    assert again.nodes == block.nodes and (again.points == block.points).all()
    unit, _ = hn.lift(block.points)
    leaves = []
    for c, radius, a, b, below in block.nodes:
        assert (hn._angles(unit[c], unit[a:b]) <= radius + 1e-9).all()
        if below:
            assert sorted(x for k in below for x in range(*block.nodes[k][2:4])) == list(range(a, b))
        else:
            leaves += range(a, b)
    assert sorted(leaves) == list(range(len(points))) and sorted(block.ids.tolist()) == ids.tolist()

    own = np.arange(0, 6000, 100)
    windows = np.tile(np.array([hn._LEAST + 1, -hn._LEAST - 1]), (len(own), 1, 1))
    search = hn.Search(points[own], labels[own], own, windows, 5, True)
    search.visit(block)
    score = points[own] @ points.T
    score[(labels[own][:, None] != labels) | (own[:, None] == ids)] = hn._LEAST
    assert (search.scores[:, 0] == np.sort(score, axis=1)[:, ::-1][:, :5]).all()
    assert search.verified < 0.5 * len(own) * len(points)  # most of the clusters are skipped


def test_blocks_of_anchors(spark, monkeypatch):
    """Many trees and many blocks of anchors give the same rows."""
    r = random.Random(5)
    rows = [(i, r.randrange(4), [round(r.gauss(0, 1), 2) for _ in range(4)]) for i in range(1500)]
    monkeypatch.setattr(hn, "ANCHOR_CELLS", 12)
    assert Counter(tuple(x) for x in hn.query(table(spark, rows)).collect()) == by_hand(rows)


def test_oracle(spark, sf):
    got = hn.query(spark.read.parquet(f"{sf}/embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    expected = con.sql(f"SELECT {', '.join(got.columns)} FROM ({hn.ORACLE})").fetchall()
    assert Counter(tuple(x) for x in got.collect()) == Counter(expected) and expected
