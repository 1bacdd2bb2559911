"""Periodic runs against a search of every period."""
import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tabvet.llm import periodic_runs


def by_hand(words, min_length=24, min_exponent=3):
    out, n = {}, len(words)
    for p in range(1, n // min_exponent + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(min_length, min_exponent * p):
                out.setdefault((i - p, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in out.items())


def made(r, most):
    words, a, n = [], r.choice([1, 2, 3, 60]), r.randrange(1, most)
    while len(words) < n:
        block = [f"w{r.randrange(a)}" for _ in range(r.randrange(1, 16))]
        words += block * r.randrange(1, 9) + block[:r.randrange(len(block))]
    return words


def test_runs_of_random_words():
    r = random.Random(8)
    seen = 0
    for _ in range(1500):
        words, (m, e) = made(r, 200), r.choice([(24, 3), (24, 3), (10, 2), (12, 4)])
        expected = by_hand(words, m, e)
        seen += len(expected)
        assert periodic_runs.runs_of(words, m, e) == expected
    assert seen > 1000
    for words in (["x"] * 60_000, ["a", "b"] * 30_000, [f"w{i % 1000}" for i in range(60_000)]):
        assert [x[:2] for x in periodic_runs.runs_of(words)] == [(0, 60_000)]


def test_automaton_states():
    words = [int(x) for x in "0110100110010110"]
    link, size, prefix = periodic_runs.automaton(words)
    distinct = {tuple(words[i:j]) for i in range(16) for j in range(i + 1, 17)}
    assert sum(size[v] - size[link[v]] for v in range(1, len(size))) == len(distinct)
    assert [size[v] for v in prefix] == list(range(1, 17))


SCHEMA = "doc_id bigint, text string, runs int, strongest string, key int, collapsed int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    texts = [None, "", " \n ", "one two", "a b c " * 8, "a b c " * 7 + "a b", "x" + " y" * 30 + "  z\t" + "p q r s " * 9, "é ü " * 15,
             "u" + "v" * 300_000, " ".join(["k"] * 23), " ".join(["k"] * 24)]
    texts += [" ".join(made(r, 400)) for _ in range(60)] + [" ".join(f"w{r.randrange(50)}" for _ in range(300)) for _ in range(60)]
    out = [(i, t, 1, "x", 2, 3) for i, t in enumerate(texts)]
    return out + [out[6], out[6], (None, texts[6], 1, "x", 2, 3), (None, None, 1, "x", 2, 3)]


def digest_by_hand(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_hand(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{p}\n" for a, b, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_and_edge_cases(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    got = sorted((tuple(x) for x in periodic_runs.digest_columns(docs).collect()), key=key)
    assert got == sorted((digest_by_hand(*x[:2]) for x in rows), key=key)
    assert sum(x[1] > 0 for x in got) > 20 and any(zlib.crc32(str(x[0]).encode()) % 10 == 0 and x[1] for x in got)
    assert periodic_runs.digest_columns(docs).dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"),
        ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    plain = {x["doc_id"]: x for x in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in plain[4]["runs"]] == [(0, 24, 3)] and plain[4]["collapsed"] == "a b c" and plain[5]["runs"] == []
    assert periodic_runs.digest_columns(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, min_exponent=1)
