"""The corpus pipeline, each stage held against a brute-force version on its own input."""
from collections import Counter, defaultdict

import corpus_pipeline
from tabvet.llm import decontaminate, ngram_join, quality
from tabvet.llm.common import saved, table
from test_operators import queue_by_hand


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, sf), "test-stage")
        seen[name] = ({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()})
        assert after.columns == columns if name != corpus_pipeline.STAGES[-1][0] else set(columns) < set(after.columns)
        docs = after

    before, after = seen["quality classifier"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    held = [d for d in before if d in labels]
    assert set(after) <= set(before) and sum((d in after) == bool(labels[d]) for d in held) >= 0.9 * len(held)

    before, after = seen["line dedup"]
    assert set(before) == set(after)
    holds = defaultdict(set)
    for d, r in before.items():
        for x in r["text"].split("\n"):
            holds[x.strip().lower()].add(d)
    for d, r in before.items():
        stay = [x for x in r["text"].split("\n") if len(k := x.strip().lower()) < 20 or len(holds[k]) < 3 or d == max(holds[k])]
        assert after[d]["text"] == "\n".join(stay) and after[d]["n_chars"] == len(after[d]["text"])

    before, after = seen["n-gram Jaccard join"]
    sets = {d: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := r["text"].lower().split()) else set() for d, r in before.items()}
    label = {d: d for d in before}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert set(after) == {d for d in before if label[d] == d}

    before, after = seen["benchmark decontamination"]
    assert set(after) <= set(before)
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    assert not any(t in r["text"] for r in after.values() for t in items)
    assert all(any(t.split()[5] in before[d]["text"] for t in items) for d in set(before) - set(after))

    before, after = seen["mixing sources to target weights"]
    rows = [(r["source"], len(r["text"].split()), 0) for r in before.values()]
    target, _ = queue_by_hand(rows)
    taken = Counter()
    for d, r in after.items():
        assert {k: v for k, v in r.asDict().items() if k != "copies"} == before[d].asDict() and 1 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * len(r["text"].split())
    assert sum(taken.values()) <= sum(n for _, n, _ in rows)
    longest = max(n for _, n, _ in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in target)


def test_stages_decide_by_row(spark, sf, tmp_path):
    """Null and repeated ids: what one row holds doesn't move the others."""
    docs = table(spark, sf, "documents")
    kept = quality.stage(spark, docs, sf)
    good = [r["text"] for r in kept.orderBy("doc_id").limit(4).collect()]
    bad = docs.join(kept, "doc_id", "left_anti").orderBy("doc_id").first()["text"]
    rows = lambda pairs: spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(3)
    texts = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.collect())

    some = rows([*docs.select("doc_id", "text").collect(), (None, good[0]), (None, bad), (-7, good[1]), (-7, bad)])
    left = [x for x in texts(quality.stage(spark, some, sf)) if x[0] < 0]
    assert left == [(-7, good[1]), (-1, good[0])]

    near = good[0] + " one"
    some = rows([(1, good[0]), (1, good[0]), (1, near), (1, good[1]), (None, near), (None, good[2]), (2, good[1]), (None, good[2]), (None, None), (3, ""), (3, "")])
    left = texts(ngram_join.stage(spark, some, sf))
    assert len(left) == 6 and (1, good[1]) in left and sum(x in ((1, good[0]), (1, near)) for x in left) == 1 and left.count((3, "")) == 2

    passage = [f"p{i}" for i in range(14)]  # 10 shingles; each half holds 5 of them
    spark.createDataFrame([(0, " ".join(passage))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    one, two, whole = " ".join(passage[:9]), " ".join(passage[5:]), "x " + " ".join(passage)
    some = rows([(None, one), (None, two), (None, whole), (4, one), (4, two), (5, whole), (5, "clean")])
    assert texts(decontaminate.stage(spark, some, str(tmp_path))) == [(-1, one), (-1, two), (4, one), (4, two), (5, "clean")]


def test_run_and_empty_tables(spark, sf):
    assert "copies" in corpus_pipeline.run(spark, sf).columns
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf), "test-empty")
        assert docs.count() == 0
    assert quality.THRESHOLD == 0.7
