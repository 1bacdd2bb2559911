"""Best-fit packing by patterns of lengths.

Texts are encoded and cut into pieces in Spark tasks; only the histogram of
piece lengths reaches the driver. There, patterns of few lengths that fill a
sequence are enumerated, and non-negative least squares fits how often each is
repeated. Repeats are rounded down, and what they leave is packed best-fit.
The plan gives each length's pieces, by their rank, a sequence and an offset;
ranks are counted and looked up in Spark tasks again.
"""
from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabvet.llm.common import as_bytes, prepare, saved

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LENGTH = 2048
END = 0  # the id after each document
#: Documents of a pattern, at most, and ranges of lengths that patterns tell apart.
DEPTH, RANGES = 3, 128
#: Words whose ids a worker remembers, at most, and their length in bytes.
REMEMBERED, WORD_BYTES = 1_000_000, 64


#: Signs that end a word after an ASCII letter or digit, and are tokens of their own there.
_SIGNS = re.compile(rb"[.,;:!?](?<=[a-z0-9].)[.,;:!?]*(?!\S)")
#: Special tokens and marks that join a capital keep their texts as they are.
_AS_IT_IS = (b"<|", b"\xcc", b"\xcd")


class Encoder:
    """Ids of whole texts, word by word.

    The tokenizer lower-cases, cuts at white space and never joins what stands
    on both sides of it, so a text's ids are those of its words, which are
    remembered. Ids are little-endian unsigned 32-bit, as bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't known. Words of letters alone are encoded as one text."""
        plain, rest, out = [], [], {}
        for w in words:
            (plain if w.isalpha() or _letters(w) else rest).append(w)
        if plain:
            got = self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            bounds = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(bounds) == len(plain):
                raw = ids.tobytes()
                out = {w: raw[a:b] for w, a, b in zip(plain, [0, *bounds[:-1]], bounds, strict=True)}
            else:
                rest += plain
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        if len(self.known) < REMEMBERED:
            self.known.update((w, x) for w, x in out.items() if len(w) <= WORD_BYTES)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if any(x in t for x in _AS_IT_IS) else _SIGNS.sub(rb" \g<0>", t.lower())).split() for t in texts]
        got = [list(map(self.known.get, words)) for words in split]
        holes, new = [], set()
        for words, ids in zip(split, got, strict=True):
            own, at = [], -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                own.append(at)
            holes.append(own)
            new.update([words[i] for i in own])
        fresh = self._learn(list(new))
        for words, ids, own in zip(split, got, holes, strict=True):
            for i in own:
                ids[i] = fresh[words[i]]
        return [b"".join(ids) for ids in got]


def _letters(word: bytes) -> bool:
    """Letters only, which stay letters in the tokenizer's normal form."""
    text = word.decode()
    return text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower().isalpha()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY,
               with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), and
    part and nth: the piece is the nth of its length in that part of the input."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, tokens = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64), encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                row, piece, crc, sizes, nth, ids = [], [], [], [], [], []
                for k, raw in enumerate(tokens.encode(as_bytes(some.column(1)))):
                    raw += end
                    for j, a in enumerate(range(0, len(raw), 4 * length)):
                        own = raw[a:a + 4 * length]
                        n = len(own) // 4
                        row.append(k)
                        piece.append(j)
                        crc.append(crc32(own))
                        sizes.append(n)
                        nth.append(int(seen[n]))
                        seen[n] += 1
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                piece = np.array(piece, np.int64)
                columns = [some.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(piece * length), pa.array(sizes, pa.int64()),
                           pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids array<int>" * with_ids)


# -------------------------------------------------------------------- the plan
def patterns(ranges: int, depth: int) -> np.ndarray:
    """Non-increasing rows of at most ``depth`` ranges 1 ... ``ranges`` (0: none) that fill a sequence.

    Lengths of range k are k steps at most and half a step less on average, so
    d documents fill ``ranges`` steps when their ranges add up to d // 2 more.
    """
    rows: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, more: int) -> None:
        most = min(head[-1] if head else ranges, left)
        if more == 1:
            if 1 <= left <= most:
                rows.append(head + (left,))
            return
        for k in range(-(-left // more), min(most, left - more + 1) + 1):
            grow(head + (k,), left - k, more - 1)

    for d in range(1, depth + 1):
        grow((), ranges + d // 2, d)
    out = np.zeros((len(rows), depth), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def nnls(columns: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """x >= 0 with least weight ** 2 * (A x - target) ** 2 by active sets.

    Column j of A counts the entries of ``columns[j]``; entry 0 stands for none.
    """
    n, m = len(target), len(columns)
    x, active = np.zeros(m), []

    def dense(js: list[int]) -> np.ndarray:
        out = np.zeros((n, len(js)))
        for c in columns[js].T:
            np.add.at(out, (c, np.arange(len(js))), 1.0)
        out[0] = 0
        return out * weight[:, None]

    want = target * weight
    want[0] = 0
    rest, tiny = want.copy(), None
    for _ in range(2 * n):
        slope = (rest * weight)[columns].sum(axis=1)
        tiny = tiny if tiny is not None else 1e-6 * slope.max()
        slope[active] = -1
        j = int(slope.argmax())
        if slope[j] <= tiny:
            break
        active.append(j)
        while active:
            a = dense(active)
            gram = a.T @ a
            best = np.linalg.solve(gram + 1e-9 * np.eye(len(active)), a.T @ want)
            low = best <= 0
            if not low.any():
                break
            now = x[active]
            step = (now[low] / (now[low] - best[low] + 1e-300)).min()
            now = np.where(low & (now <= step * (now - best) * (1 + 1e-9)), 0, now + step * (best - now))
            x[active] = now
            active = [k for k, v in zip(active, now, strict=True) if v > 0]
        if not active:
            break
        x[active] = best
        before, rest = rest, want - a @ best
        if (before ** 2).sum() - (rest ** 2).sum() <= 1e-7 * (want ** 2).sum():
            break
    return x


class Plan:
    """Sequences for ``counts[l]`` pieces of each length ``l``.

    Pieces are numbered by length, then rank. Run i holds the numbers from
    ``first[i]``: ``wide[i]`` sequences from ``sequence[i]`` on get pieces of
    ``length[i]`` one after the other from ``offset[i]`` on. The number of runs
    follows the sequence length, not the number of pieces.
    """

    def __init__(self, counts: np.ndarray, length: int = LENGTH, depth: int = DEPTH, ranges: int = RANGES):
        self.most, self.left = length, counts.astype(np.int64).copy()
        self.start = np.concatenate([[0], np.cumsum(self.left)])  # first number of each length
        self.used = np.zeros(length + 1, np.int64)
        self.n_sequences, self.runs = 0, []
        #: Sequences with room: room -> [(lengths as (length, times), how many)]; rooms in order.
        self.open, self.rooms = defaultdict(list), []
        self._fill(ranges, depth)
        self._best_fit()
        for room in list(self.rooms):
            for held, n in self.open[room]:
                self._close(held, n)
        self.runs.sort()
        self.first, self.wide, self.sequence, self.offset, self.length = np.array(self.runs, np.int64).reshape(-1, 5).T

    def place(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each number."""
        i = np.searchsorted(self.first, numbers, "right") - 1
        slot, at = np.divmod(numbers - self.first[i], self.wide[i])
        return self.sequence[i] + at, self.offset[i] + slot * self.length[i]

    def _close(self, held: tuple, n: int) -> None:
        offset = 0
        for size, times in held:
            self.runs.append((int(self.start[size] + self.used[size]), n, self.n_sequences, offset, size))
            self.used[size] += n * times
            offset += size * times
        self.n_sequences += n

    def _leave_open(self, held: tuple, n: int) -> None:
        room = self.most - sum(s * t for s, t in held)
        if room == 0:
            self._close(held, n)
            return
        if not self.open[room]:
            insort(self.rooms, room)
        self.open[room].append((held, n))

    def _fill(self, ranges: int, depth: int) -> None:
        """Repeat patterns as often as non-negative least squares says, rounded
        down and as far as a last piece fills the sequence to the end."""
        step = -(-self.most // ranges)
        ranges = -(-self.most // step)
        of = -(-np.arange(self.most + 1) // step)
        columns = patterns(ranges, depth)
        target = np.bincount(of, self.left, ranges + 1)
        if not target.any():
            return
        columns = columns[((columns == 0) | (target[columns] > 0)).all(axis=1)]
        if not len(columns):
            return
        x = np.floor(nnls(columns, target, np.arange(ranges + 1) / ranges) + 1e-9).astype(np.int64)
        for j in sorted(np.flatnonzero(x), key=lambda j: tuple(-columns[j])):
            made = [((), int(x[j]))]
            for k, r in enumerate(columns[j][columns[j] > 0].tolist()[:-1]):
                made = self._append(made, range(min(r * step, self.most), (r - 1) * step, -1) if k % 2 == 0 else range((r - 1) * step + 1, min(r * step, self.most) + 1))
            for held, n in made:
                room = self.most - sum(s * t for s, t in held)
                full = min(n, int(self.left[room])) if room > 0 else n if room == 0 else 0
                if room and full:
                    self.left[room] -= full
                    self._close(_with(held, room, 1), full)
                elif full:
                    self._close(held, full)
                for size, times in held:  # what no last piece fills goes back
                    self.left[size] += (n - full) * times

    def _append(self, made: list, sizes: range) -> list:
        """Give each sequence of ``made`` a piece of the first of ``sizes`` that are left; some get none."""
        out = []
        for held, n in made:
            for size in sizes:
                take = min(n, int(self.left[size]))
                if take:
                    self.left[size] -= take
                    out.append((_with(held, size, 1), take))
                    n -= take
                if not n:
                    break
            if n:
                out.append((held, n))
        return out

    def _best_fit(self) -> None:
        """The other pieces, long ones first, each into the fullest sequence with room, or a new one."""
        for size in range(self.most, 0, -1):
            n = int(self.left[size])
            self.left[size] = 0
            while n:
                at = bisect_left(self.rooms, size)
                room = self.rooms[at] if at < len(self.rooms) else self.most
                fit = room // size
                if room == self.most and not self.open[room]:
                    held, many = (), max(1, n // fit)
                else:
                    held, many = self.open[room].pop()
                    if not self.open[room]:
                        self.rooms.remove(room)
                full = min(many, n // fit)
                if full:
                    self._leave_open(_with(held, size, fit), full)
                    n -= full * fit
                many -= full
                if many and n:  # fewer than fit are left for one sequence
                    self._leave_open(_with(held, size, n), 1)
                    n, many = 0, many - 1
                if many and held:
                    self._leave_open(held, many)


def _with(held: tuple, size: int, times: int) -> tuple:
    if held and held[-1][0] == size:
        return held[:-1] + ((size, held[-1][1] + times),)
    return held + ((size, times),)


# ------------------------------------------------------------------- the packing
def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY,
         depth: int = DEPTH, ranges: int = RANGES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and one id 0; documents longer than ``length`` are
    cut into pieces of it, the last of which may be shorter. Pieces of a
    sequence lie one after the other from offset 0 and are ``length`` long
    together at most. Null and empty texts are the id 0 alone; repeated rows
    are documents of their own, null ids pass through, other columns are not
    read, and an empty table gives no rows.

    The driver holds the histogram, ``length`` numbers, and the plan, whose
    size follows ``length`` and ``ranges``; both are independent of the rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = saved(cut_pieces(docs, doc_id, text, length, vocabulary, with_ids), "pack-pieces")
    parts = saved(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "pack-counts")
    counts = np.zeros(length + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[r["length"]] = r["n"]
    plan = Plan(counts, length, depth, ranges)
    shared = spark.sparkContext.broadcast((plan.start, plan.first, plan.wide, plan.sequence, plan.offset, plan.length))

    @arrow_udf("struct<sequence_id bigint, offset bigint>")
    def place(sizes: pa.Array, ranks: pa.Array) -> pa.Array:
        own = Plan.__new__(Plan)
        own.start, own.first, own.wide, own.sequence, own.offset, own.length = shared.value
        sequence, offset = own.place(own.start[sizes.to_numpy(zero_copy_only=False)] + ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    # Pieces of a length are numbered part by part; a length's window has a row for each part.
    running = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    placed = pieces.join(before, ["part", "length"]).withColumn("place", place("length", F.col("before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and starts (the offsets of its pieces) of a packing made with ids; a group is one sequence."""
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts")))
