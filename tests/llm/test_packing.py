"""Packing: ids against the tokenizer on whole texts, plans against counting, and the table piece by piece."""
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabvet.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_whole_text(tokenizer):
    r = random.Random(2)
    texts = ["", "don't DON'T x'S 's. 't! s's", "a<|endoftext|>b. <|startoftext|> <|endoftext|>, <|ENDOFTEXT|>", "é é ́x Á. İI ﬁ ǅ ΑΣ.", "12 345. ½! Ⅷ ٣٤;",
             "日本語。 テキスト!", "a\x00b. \x1c c\x1fd \x0b e!!??..", "x" * 30_000, "..., ?! a.b.c. a..", "😀. 👍🏽! x‍y.", "J\u030c. H\u0331 T\u0308, ǰ", "İstanbul ŉ ΐ ﬀ"]
    texts += ["".join(r.choice("aBJT1' <|>endoftextstar\t\u0308\u030ćé  Σ日😀.,-s!?;:S½‍\x1c\x85\n") for _ in range(r.randrange(40))) for _ in range(3000)]
    own = packing.Encoder(packing.VOCABULARY)
    for _ in range(2):  # the second time words are remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])]
        assert got == [ids_of(tokenizer, t)[:-1] for t in texts]


def check_plan(counts, length, **how):
    plan = packing.Plan(counts, length, **how)
    sizes = np.repeat(np.arange(length + 1), counts)
    sequence, offset = plan.place(np.arange(len(sizes)))
    order = np.lexsort((offset, sequence))
    sequence, offset, sizes = sequence[order], offset[order], sizes[order]
    first = np.diff(sequence, prepend=-1) != 0
    assert (offset[first] == 0).all() and (offset[~first] == (offset + sizes)[:-1][~first[1:]]).all()
    assert (offset + sizes <= length).all() and len(np.unique(sequence)) == plan.n_sequences
    return plan


def test_plans():
    r = np.random.default_rng(5)
    for _ in range(200):
        length = int(r.choice([1, 2, 7, 20, 64, 200]))
        counts = np.zeros(length + 1, np.int64)
        for _ in range(r.integers(0, 12)):
            counts[r.integers(1, length + 1)] += r.integers(0, r.choice([3, 50, 5000]))
        check_plan(counts, length, depth=int(r.integers(1, 5)), ranges=int(r.choice([4, 16, 128])))
    sizes = np.clip(r.lognormal(6, 1, 60_000).astype(int), 1, 2048)
    counts = np.bincount(sizes, minlength=2049)
    small, large = check_plan(counts, 2048), check_plan(counts * 50, 2048)
    for plan, c in ((small, counts), (large, counts * 50)):
        assert plan.n_sequences <= 1.002 * -(-int((c * np.arange(2049)).sum()) // 2048)
    assert len(large.runs) < 4 * 2048 * 4  # follows the lengths, not the pieces
    hot = np.zeros(2049, np.int64)
    hot[1], hot[2048], hot[1500] = 10**9, 10**9, 10**6
    assert packing.Plan(hot, 2048).n_sequences == 10**9 + 10**6 + -(-(10**9 - 548 * 10**6) // 2048)


def test_least_squares():
    """x meets the conditions of the minimum: no pattern would lessen the error by more than the tolerance."""
    r = np.random.default_rng(1)
    columns = packing.patterns(24, 3)
    assert {tuple(x) for x in columns.tolist()} == {(a, b, c) for a in range(25) for b in range(25) for c in range(25)
                                                   if a >= b >= c and a and a + b + c == 24 + (1 + (b > 0) + (c > 0)) // 2}
    target, weight = np.concatenate([[0], r.integers(0, 500, 24)]).astype(float), np.arange(25) / 24
    x = packing.nnls(columns, target, weight)
    a = np.zeros((25, len(columns)))
    for j, column in enumerate(columns):
        for k in column[column > 0]:
            a[k, j] += weight[k]
    error = lambda v: ((a @ v - weight * target) ** 2).sum()
    y, step = np.zeros(len(columns)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):
        y = np.maximum(0, y - step * (a.T @ (a @ y - weight * target)))
    assert (x >= 0).all() and error(x) <= error(y) + 1e-3 * error(np.zeros(len(columns)))


SCHEMA = "doc_id bigint, text string, part int, nth string, length int, piece int"


def test_packing(spark, tokenizer):
    r = random.Random(6)
    texts = [None, "", "  \n", "One word.", "a " * 2047, "a " * 2048, "a " * 4095, "é" * 5000, "x " * 9000]
    texts += [" ".join(f"word{r.randrange(900)}" for _ in range(r.randrange(1, 300))) for _ in range(150)]
    rows = [(i, t, 1, "x", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id", 1, "x", 2, 3), (None, None, 1, "x", 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    packed = packing.pack(docs, length=2048, with_ids=True)
    got = packed.collect()
    held, expected = defaultdict(list), defaultdict(int)
    for d, t, *_ in rows:
        ids = ids_of(tokenizer, t)
        for k, a in enumerate(range(0, len(ids), 2048)):
            own = ids[a:a + 2048]
            expected[d, k, a, len(own), crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    for x in got:
        expected[x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], tuple(x["ids"])] -= 1
        held[x["sequence_id"]].append((x["offset"], x["length"]))
    assert not any(expected.values())
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(x["length"] for x in got) // 2048) + 1
    whole = {x["sequence_id"]: x for x in packing.sequences(packed).collect()}
    for x in got:
        assert whole[x["sequence_id"]]["ids"][x["offset"]:x["offset"] + x["length"]] == x["ids"] and x["offset"] in whole[x["sequence_id"]]["starts"]
    thin = packing.pack(docs)
    assert thin.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"),
                           ("sequence_id", "bigint"), ("offset", "bigint")]
    assert packing.pack(docs.limit(0)).count() == 0
