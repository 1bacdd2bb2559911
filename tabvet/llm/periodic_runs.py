"""Periodic runs of words by a suffix automaton with link-cut access.

A document's words are appended to a suffix automaton. Each appended word
recolours the path from its state to the root of the link tree with its own
position; the path's former segments of one colour say where the suffixes up
to the segment's length ended last. If that former end lies within the
segment's length, the two ends bound a square, which is extended to its run.

Preferred paths are kept as stacks of (length, colour) on the heavy paths of
the link tree rather than as splay trees: the segments are those of a
link-cut tree's access, O(log n) of them for a word on average, also for one
word repeated all over.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import as_bytes, mix, prepare

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUN = "start bigint, length bigint, period bigint"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of every state, and the state of every prefix."""
    step, link, size, prefix, last = [{}], [-1], [0], [], 0
    for c in words:
        new = len(size)
        size.append(size[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        elif size[q := step[p][c]] == size[p] + 1:
            link.append(q)
        else:
            copy = new + 1
            link.append(copy)
            size.append(size[p] + 1)
            step.append(dict(step[q]))
            link.append(link[q])
            link[q] = copy
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = copy
                p = link[p]
        prefix.append(new)
        last = new
    return link, size, prefix


def heavy_heads(link: list[int], size: list[int]) -> list[int]:
    """Topmost state of each state's heavy path in the link tree."""
    order = np.argsort(size, kind="stable").tolist()
    weight, heavy = [1] * len(link), [-1] * len(link)
    for v in reversed(order[1:]):
        up = link[v]
        weight[up] += weight[v]
        if heavy[up] < 0 or weight[v] > weight[heavy[up]]:
            heavy[up] = v
    head = list(range(len(link)))
    for v in order[1:]:
        if heavy[link[v]] == v:
            head[v] = head[link[v]]
    return head


def _extend(words: list[int], i: int, common: int, p: int) -> tuple[int, int]:
    """Start and end of the run of period ``p`` whose words up to ``i`` repeat ``common`` words."""
    low, high, n = i - common + 1, i + 1, len(words)
    while low > p and words[low - 1] == words[low - 1 - p]:
        low -= 1
    while high < n and words[high] == words[high - p]:
        high += 1
    return low - p, high


def _squares(words: list[int], first: int, last: int, min_length: int, min_exponent: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs that words ``first`` to ``last - 1`` hold to ``found``, as (start, end): period."""
    link, size, prefix = automaton(words[first:last])
    head = heavy_heads(link, size)
    paths: dict[int, list[tuple[int, int]]] = {}
    done: dict[int, int] = {}  # end of the last run of a period
    for i, u in enumerate(prefix, first):
        while u > 0:
            top, s = head[u], size[u]
            path = paths.setdefault(top, [])
            while path:
                length, j = path[-1]
                if length <= s:
                    path.pop()
                reach, p = min(length, s), i - j
                if reach >= (min_exponent - 1) * p and reach >= min_length - p and i >= done.get(p, 0):
                    run = _extend(words, i, reach, p)
                    found[run] = min(p, found.get(run, p))
                    done[p] = run[1]
                if length >= s:
                    break
            path.append((s, i))
            u = link[top]


def stretches(words: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Stretches outside which no run can lie, apart from each other.

    The words of a run that repeat those a period before them make grams of
    min_length * (min_exponent - 1) / min_exponent words that occur again no
    further than a period. Such grams are found by their hashes; a false hit
    costs time only.
    """
    gram, n = -(-min_length * (min_exponent - 1) // min_exponent), len(words)
    if n < min_length:
        return []
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * power[:n])])
    # The gram at i has hash (run[i + gram] - run[i]) / power[i].
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
    h = (run[gram:] - run[:-gram]) * back[:n - gram + 1]
    order = np.argsort(h, kind="stable")
    near = (np.diff(order) <= n // min_exponent) & (h[order[1:]] == h[order[:-1]])
    at = np.sort(order[1:][near])
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    out: list[tuple[int, int]] = []
    for a, b in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True):
        period = (b - a + gram) // (min_exponent - 1)  # of a run that ends here, at most
        a, b = max(0, a - period - 1), min(n, b + gram + 1)
        while out and out[-1][1] >= a:
            a = min(a, out.pop()[0])
        out.append((a, b))
    return out


def runs_of(words: list, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs of ``words``, by start, then period."""
    codes: dict = {}
    ids = [codes.setdefault(w, len(codes)) for w in words]
    if len(ids) < min_length:
        return []
    found: dict[tuple[int, int], int] = {}
    for first, last in stretches(np.array(ids), min_length, min_exponent):
        _squares(ids, first, last, min_length, min_exponent, found)
    # A run's other periods are multiples of the smallest and have the same ends.
    return sorted((a, b - a, p) for (a, b), p in found.items() if b - a >= max(min_length, min_exponent * p))


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period, then smallest start and period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
              rewrite: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs, strongest, collapsed.

    Words are runs of anything but ASCII white space, numbered from 0. A run
    is a stretch of words with smallest period q and a length of at least
    ``min_length`` and ``min_exponent`` * q that can't be extended with that
    period. ``runs`` has them by start, then period; ``strongest`` is the one
    of greatest length / period (null without any). ``collapsed`` is the text
    without words that a run holds after its first q words, joined by single
    spaces. ``rewrite(id as text, words)`` may change the words first.

    Rows are decided one by one: repeated rows give equal rows, null and empty
    texts have no run and an empty text, null ids pass through, other columns
    are not read, and an empty table gives no rows. Time grows as n log n with
    the words of a text, whatever they repeat, and memory with its longest
    repetitive stretch, about 500 bytes a word.
    """
    prepare(docs.sparkSession)
    if min_exponent < 2 or min_length < min_exponent:
        raise ValueError("min_exponent must be 2 or more and min_length at least as much")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                every, sizes, best, texts = [], [0], [], []
                for key, t in zip(part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                    words = t.split()
                    words = rewrite(key, words) if rewrite else words
                    runs = runs_of(words, min_length, min_exponent)
                    if runs:
                        keep = np.ones(len(words), bool)
                        for start, length, q in runs:
                            keep[start + q:start + length] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    every += runs
                    sizes.append(len(every))
                    best.append(_strongest(runs))
                    texts.append(b" ".join(words))
                fields = ("start", "length", "period")
                struct = lambda rows: pa.array([r and dict(zip(fields, r, strict=True)) for r in rows],
                                               pa.struct([(f, pa.int64()) for f in fields]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct(every)), struct(best),
                                                  pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "strongest", "collapsed"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, runs array<struct<{RUN.replace(' bigint', ': bigint')}>>, strongest struct<{RUN.replace(' bigint', ': bigint')}>, collapsed string")


def every_tenth_periodic(key: str | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: a tenth of the documents, by their id, repeat their words from some place on."""
    h = 1 if key is None else crc32(key.encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest_columns(docs: DataFrame) -> DataFrame:
    """The thin query's columns."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.col("strongest")
    return find_runs(docs, rewrite=every_tenth_periodic).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
