"""N-gram Jaccard self-join: documents whose sets of 5-word shingles are alike.

Shingles are put in a rare-first order. A pair that reaches the threshold
shares a shingle among the first few of both sets, so only those prefixes are
joined; length, positional and suffix filters remove pairs before any set is
fetched, and each pair left is verified once by exact intersection. Documents
with equal sets are one class and never form pairs. Most shared prefix keys
have a few classes: their pairs are made where the key's rows meet, and only
rows of larger keys travel with their bitmaps. ``links`` takes all pairs of
every prefix key. Component ids need fewer: there the larger keys are worked in
two rounds, the first pairs every class with its neighbours in orders that put
similar sets side by side, which is linear in the key's size; the second takes
all pairs that the first left in different components.
Tables of a few thousand ids (classes, pairs, labels) are broadcast up to a
bound and shuffled beyond it, with the same result.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from tabvet.llm.common import as_bytes, bits_for, bloom_has, bloom_pair, few, lookup, mix, prepare, row_keys, saved, stars, unused, word_hashes

WORDS, PERCENT = 5, 80
#: Entries of the table of frequent shingles that sets the order: a bound on
#: what is broadcast (12 bytes each). Shingles outside it count as rare; any
#: order gives the same links.
FREQUENT = 1 << 20
CELLS = 256  # of the suffix filter's histogram
BITS = 512   # of its bitmap
SMALL = 4    # classes of a prefix key up to which its pairs are all made at once
MARKS = 1 << 22  # places of the table that tells at once that a shingle isn't frequent
LOW_BITS, HIGH_BITS = 18, 28
RECENT = 1 << 21  # shingles that a task remembers to notice repeats
CHUNK = 128  # documents whose sets are held at once


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a shorter text is one shingle."""
    words, bounds = word_hashes([t.lower() for t in texts])
    grams = _grams(words, n)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = grams[lo:hi - n + 1] if hi - lo >= n else _grams(words[lo:hi], hi - lo)
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words at each place, the number of words among it."""
    if n == 0 or len(words) < n:
        return np.empty(0, np.uint64)
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        total += words[i:len(words) - n + 1 + i] * _FACTORS[i]
    return mix(total)


_FACTORS = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    return shingle_sets(as_bytes(texts), n)


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _bitmap(s: np.ndarray) -> np.ndarray:
    """BITS bits: whether an odd number of the set's hashes falls on each. Two
    sets differ in at least as many elements as their bitmaps in bits."""
    odd = np.bincount((s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _need(a, b, percent: int):
    """Smallest intersection of sets of a and b shingles that links them."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-6))


class JaccardJoin:
    """Classes, links and components of ``docs``.

    ``docs`` need a document id (integer) and a text; other columns are not
    read. Null and empty texts have an empty set and link with nothing. Rows
    that repeat an id are separate members of their classes. An empty table
    gives empty results.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        prepare(self.spark)
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        scanned = saved(self._scan(), "join-scan")
        #: doc_id, n, c: one row per document; c names its class of equal sets.
        self.members = scanned.where("kind = 0").select("doc_id", "n", "c")
        classes = scanned.where("kind = 0 AND n > 0").groupBy("c")
        self._suffix = classes.agg(F.any_value("cells").alias("cells"), F.any_value("b").alias("bits"))
        self._orders = classes.agg(F.any_value("o1").alias("o1"), F.any_value("o2").alias("o2"), F.any_value("b").alias("b"))
        self._met = self._shared = self._links = self._labels = None
        self._order = self._frequent(scanned.where("kind = 1").select("c", "n"))

    # ---------------------------------------------------------------- scanning
    def _scan(self) -> DataFrame:
        """A row per document (kind 0), and repeats of shingles that tasks have noticed (kind 1)."""
        n_words = self.words

        def scan(batches):
            recent, low = np.zeros(RECENT, np.uint64), np.uint64(RECENT - 1)
            for batch in batches:
                out, again, times = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for part in _chunks([batch], CHUNK):
                    sets = _sets(part.column(1), n_words)
                    out += zip(part.column(0).to_pylist(), (len(s) for s in sets), (_class_of(s) for s in sets),
                               (_histogram(s) for s in sets), (_bitmap(s) for s in sets), *zip(*(_orders(s) for s in sets), strict=True), strict=True)
                    values, counts = np.unique(np.concatenate(sets), return_counts=True)
                    place = (values & low).astype(np.int64)
                    counts += (recent[place] == values) - 1
                    recent[place] = values
                    again.append(values[counts > 0])
                    times.append(counts[counts > 0])
                yield _scan_batch(0, *zip(*out, strict=True))
                values, at = np.unique(np.concatenate(again), return_inverse=True)
                if len(values):
                    counts = np.bincount(at, weights=np.concatenate(times)).astype(np.int64)
                    none = [None] * len(values)
                    yield _scan_batch(1, none, counts, values.view(np.int64), none, none, none, none)

        return self.docs.mapInArrow(scan, "kind int, doc_id bigint, n bigint, c bigint, cells binary, b array<bigint>, o1 bigint, o2 bigint")

    def _frequent(self, counts: DataFrame):
        """Broadcast (hashes, counts) of the most frequent shingles, sorted by hash."""
        rows = (counts.groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(FREQUENT).toArrow())
        h = rows.column("c").to_numpy().view(np.uint64)
        at = np.argsort(h)
        return self.spark.sparkContext.broadcast((h[at], rows.column("n").to_numpy()[at].astype(np.int32)))

    def _prefixes(self) -> DataFrame:
        """(k, c, n, i): the i-th shingle k of class c, for the first shingles that the threshold asks for."""
        n_words, percent, order = self.words, self.percent, self._order

        def prefixes(batches):
            known, counts = order.value
            low = np.uint64(MARKS - 1)
            marked = np.zeros(MARKS, bool)
            marked[(known & low).astype(np.int64)] = True
            for part in _chunks(batches, CHUNK):
                done, ks, cs, ns, ps = set(), [], [], [], []
                for s in _sets(part.column(1), n_words):
                    c = _class_of(s)
                    if not len(s) or c in done:
                        continue
                    done.add(c)
                    size = len(s) - -(-percent * len(s) // 100) + 1
                    maybe = np.flatnonzero(marked[(s & low).astype(np.int64)])
                    at = np.searchsorted(known, s[maybe])
                    at[at == len(known)] = 0
                    count = np.where(known[at] == s[maybe], counts[at], 0) if len(known) else at
                    rank = np.zeros(len(s), np.int32)
                    rank[maybe] = count
                    first = np.flatnonzero(rank == 0)[:size]
                    if len(first) < size:
                        first = np.argsort(rank, kind="stable")[:size]
                    ks.append(s[first])
                    cs.append(np.full(size, c, np.int64))
                    ns.append(np.full(size, len(s), np.int32))
                    ps.append(np.arange(size, dtype=np.int32))
                if ks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.concatenate(cs)),
                                                      pa.array(np.concatenate(ns)), pa.array(np.concatenate(ps))], ["k", "c", "n", "i"])

        return self.docs.mapInArrow(prefixes, "k bigint, c bigint, n int, i int")

    # ---------------------------------------------------------------- filters
    def _fits(self, one, two):
        """Length and positional filters of two rows (c, n, i) of one key."""
        (na, ia), (nb, ib) = ((x["n"], x["i"]) for x in (one, two))
        return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * self.percent)
                & (F.least(na - ia, nb - ib) + F.least(ia, ib) >= _need(na, nb, self.percent)))

    def _alike(self, na, nb, ba, bb):
        """Suffix filter by the bitmaps of two sets of na and nb shingles."""
        differ = sum((F.bit_count(F.get(ba, j).bitwiseXOR(F.get(bb, j))) for j in range(BITS // 64)), F.lit(0))
        return differ <= na + nb - 2 * _need(na, nb, self.percent)

    def _may(self, one, two):
        """All filters of two rows (c, n, i, b) of one key."""
        return self._fits(one, two) & self._alike(one["n"], two["n"], one["b"], two["b"])

    def _candidates(self, pairs: DataFrame, checked: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b, na, nb) of ``pairs``, each once, without those checked before and those that bitmaps and histograms clear."""
        out = pairs.distinct()
        if checked is not None:
            out = out.join(lookup(checked.select("a", "b")), ["a", "b"], "left_anti")
        return saved(self._suffixes(saved(out, "join-candidates")), "join-pairs")

    def _suffixes(self, pairs: DataFrame) -> DataFrame:
        """Suffix filters: the bitmaps, and that sets split by hash ranges cannot share more than the smaller part of each."""
        one = self._suffix.select(F.col("c").alias("a"), F.col("cells").alias("ca"), F.col("bits").alias("ba"))
        two = self._suffix.select(F.col("c").alias("b"), F.col("cells").alias("cb"), F.col("bits").alias("bb"))
        need = _need(F.col("na"), F.col("nb"), self.percent).cast("bigint")
        both = one.join(lookup(pairs), "a").join(two, "b").where(self._alike(*map(F.col, ("na", "nb", "ba", "bb"))))
        return both.where(_may_share(F.col("ca"), F.col("cb"), need)).select("a", "b", "na", "nb")

    # ---------------------------------------------------------------- verification
    def _fetch(self, wanted: DataFrame, listed: bool) -> DataFrame:
        """(c, shingles) of the wanted classes. Their list, if few, or else a
        Bloom filter of bounded size keeps other documents' sets on the map
        side; the join makes it exact."""
        n_words, bits_log2 = self.words, 0
        if listed:
            kept = np.sort(wanted.toArrow().column("c").to_numpy())
        else:
            bits_log2 = bits_for(wanted.count(), 16, LOW_BITS, HIGH_BITS)
            kept = np.frombuffer(bloom_pair(wanted, lambda b: b.column(0).to_numpy().view(np.uint64), bits_log2)[0], np.uint8)
        shared = self.spark.sparkContext.broadcast(kept)

        def fetch(batches):
            kept, done = shared.value, set()
            for part in _chunks(batches, CHUNK):
                sets = _sets(part.column(1), n_words)
                cs = np.array([_class_of(s) for s in sets], np.int64)
                out = []
                for i in np.flatnonzero(np.isin(cs, kept) if listed else bloom_has(kept, cs.view(np.uint64), bits_log2)):
                    if int(cs[i]) not in done:
                        done.add(int(cs[i]))
                        out.append(i)
                if len(done) > 1_000_000:
                    done = set()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(cs[out]), pa.array([sets[i].view(np.int64) for i in out], pa.list_(pa.int64()))],
                                                     ["c", "shingles"])

        found = self.docs.mapInArrow(fetch, "c bigint, shingles array<bigint>")
        return saved((found if listed else found.join(wanted, "c", "left_semi")).dropDuplicates(["c"]), "join-sets")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked): exact intersection of both sets."""
        sets = self._fetch(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).select(F.col("a").alias("c")).distinct(), few(pairs))
        one = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"))
        return one.join(lookup(pairs), "a").join(two, "b").select("a", "b", _linked(F.col("sa"), F.col("sb"), F.lit(self.percent)).alias("linked"))

    # ---------------------------------------------------------------- the join
    def _keys(self) -> DataFrame:
        """(k, x, y) of the prefix keys that two classes or more share: every
        pair x, y of the classes (c, n, i) of a small key that passes the first
        filters, and every class x of a larger one, where y is null."""
        if self._met is None:
            rows = self._prefixes().repartition("k").groupBy("k", "c", "n").agg(F.min("i").alias("i"))
            shared = rows.withColumn("here", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("here > 1")
            one, in_key = F.struct("c", "n", "i"), Window.partitionBy("k").orderBy("c")
            before = F.array(*(F.lag(one, step).over(in_key) for step in range(1, SMALL)))
            near = shared.select("k", "here", one.alias("x"), before.alias("ys"))
            small = F.filter("ys", lambda y: y.isNotNull() & self._fits(F.col("x"), y))
            alone = F.array(F.when(F.lit(False), F.col("x")))  # one null
            self._met = saved(near.select("k", "x", F.explode(F.when(F.col("here") <= SMALL, small).otherwise(alone)).alias("y")), "join-keys")
        return self._met

    def _small(self) -> DataFrame:
        """Pairs (a, b, na, nb) of the small keys, not distinct."""
        return _ordered(self._keys().where("y IS NOT NULL"))

    def _rows(self) -> DataFrame:
        """(k, c, n, i, o1, o2, b) of the larger keys."""
        if self._shared is None:
            self._shared = saved(self._keys().where("y IS NULL").select("k", "x.*").join(self._orders, "c"), "join-rows")
        return self._shared

    def links(self) -> DataFrame:
        """Every link (a, b), a < b, between classes: all pairs of a prefix key
        that pass the filters, each verified once. Classes stand for their
        documents, whose sets are equal; ``link_counts`` counts by document."""
        if self._links is None:
            rows = self._rows().select("k", F.struct(*ROW).alias("v"))
            x, y = rows.alias("x"), rows.alias("y")
            every = (x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.v.c") < F.col("y.v.c")) & self._may(F.col("x.v"), F.col("y.v")))
                     .select(F.col("x.v").alias("x"), F.col("y.v").alias("y")))
            pairs = self._small().unionByName(_ordered(every))
            self._links = saved(self._verify(self._candidates(pairs)).where("linked").select("a", "b"), "join-all-links")
        return self._links

    def link_counts(self) -> DataFrame:
        """(c, n_docs, n_links, n_doc_links) of every class: its documents, the
        classes it links with, and the other documents each of its own links with."""
        size = self.members.where("n > 0").groupBy("c").agg(F.count(F.lit(1)).alias("n_docs"))
        links = self.links()
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = (ends.join(size.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c"))
                  .agg(F.count(F.lit(1)).alias("n_links"), F.sum("n_docs").alias("near")))
        return size.join(around, "c", "left").select(
            "c", "n_docs", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n_docs") - 1 + F.coalesce("near", F.lit(0))).alias("n_doc_links"))

    def document_links(self) -> DataFrame:
        """doc_id, n_shingles, n_links (other rows that it links with) of every document."""
        counts = self.members.where("n > 0").join(self.link_counts().select("c", "n_doc_links"), "c")
        return (counts.select("doc_id", F.col("n").alias("n_shingles"), F.col("n_doc_links").alias("n_links"))
                .unionByName(self.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("bigint").alias("n_links"))))

    def class_components(self) -> DataFrame:
        """(node, label) of each linked class, for component ids only: pairs
        that an earlier round has already put in one component aren't looked
        for, as they can't change it. ``links`` gives all links."""
        ends = [table.select(F.col(end).alias("node")) for table in self._stars() for end in ("node", "label")]
        return self._labelled(reduce(DataFrame.unionByName, ends).distinct(), "node")

    def _labelled(self, rows: DataFrame, c: str) -> DataFrame:
        """``rows`` with the label of their class ``c``'s component: the class itself if it links with none."""
        rows = rows.withColumn("label", F.col(c))
        for table in self._stars():
            rows = (rows.withColumnRenamed("label", "was").join(lookup(table.select(F.col("node").alias("was"), "label")), "was", "left")
                    .withColumn("label", F.coalesce("label", "was")).drop("was"))
        return rows

    def _stars(self) -> list[DataFrame]:
        """Two tables (node, label): the first takes classes to the components
        that neighbours' links make, the second takes those to the final ones."""
        if self._labels is not None:
            return self._labels
        by_key = Window.partitionBy("k")
        shared = self._rows()
        # MinHash orders give the likeliest neighbours, an order by chance other ones for every key.
        near = _neighbours(shared, [(("o1", "o2"), 1), (("o2", "o1"), 1), ((F.xxhash64("k", "c"),), 2)])
        pairs = self._small().unionByName(_ordered(near.where(self._may(F.col("x"), F.col("y")))))
        checked = saved(self._verify(self._candidates(pairs)), "join-checked")
        self._labels = [stars(checked.where("linked").select("a", "b"), "join")]
        # Pairs of small keys have all been checked.
        apart = (self._labelled(shared, "c").withColumn("lo", F.min("label").over(by_key)).withColumn("hi", F.max("label").over(by_key))
                 .where("lo <> hi"))
        rows = saved(apart.select("k", "label", F.struct(*ROW).alias("v")), "join-apart")
        x, y = rows.alias("x"), rows.alias("y")
        cross = (x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.label") < F.col("y.label")) & self._may(F.col("x.v"), F.col("y.v")))
                 .select(F.col("x.v").alias("x"), F.col("y.v").alias("y")))
        last = self._verify(self._candidates(_ordered(cross), checked)).where("linked").select("a", "b")
        ends = self._labelled(self._labelled(last, "a").withColumnRenamed("label", "la"), "b").select(F.col("la").alias("a"), F.col("label").alias("b"))
        self._labels = [*self._labels, stars(saved(ends, "join-links"), "join")]
        return self._labels

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document."""
        rows = self._labelled(self.members.where("n > 0"), "c")
        # Written, as Spark splits the rows of a large component only if both sides of the join come straight from a shuffle.
        heads = saved(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "join-heads")
        return (rows.join(heads, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
                .unionByName(self.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def _orders(s: np.ndarray) -> tuple[int, int]:
    """Two orders in which similar sets tend to be neighbours: bits of the
    smallest and largest hashes, each a MinHash of the set."""
    if not len(s):
        return 0, 0
    a, b, c, d = (int(s[i]) >> 8 & 0xFFFF for i in (0, -1, min(1, len(s) - 1), max(-2, -len(s))))
    return (a << 48 | b << 32 | c << 16 | d) - (1 << 63), (d << 48 | c << 32 | b << 16 | a) - (1 << 63)


def _scan_batch(kind: int, doc_id, n, c, cells, b, o1, o2) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(n), pa.int32()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()),
         pa.array(cells, pa.binary()), pa.array(b, pa.list_(pa.int64())), pa.array(o1, pa.int64()), pa.array(o2, pa.int64())],
        ["kind", "doc_id", "n", "c", "cells", "b", "o1", "o2"])


ROW = ("c", "n", "i", "b")


def _neighbours(rows: DataFrame, orders: list) -> DataFrame:
    """Rows (x, y) whose places in their key differ by at most ``reach``, for each (order, reach)."""
    before = [F.lag(F.struct(*ROW), step).over(Window.partitionBy("k").orderBy(*order, "c"))
              for order, reach in orders for step in range(1, reach + 1)]
    near = rows.select(F.struct(*ROW).alias("x"), F.array(*before).alias("ys"))
    return near.select("x", F.explode("ys").alias("y")).where("y IS NOT NULL")


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb), a < b, of rows x and y."""
    low, high = (F.when((F.col("x.c") < F.col("y.c")) == first, F.struct("x.c", "x.n")).otherwise(F.struct("y.c", "y.n")) for first in (True, False))
    return (pairs.select(low.alias("x"), high.alias("y"))
            .select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")))


@arrow_udf(BooleanType())
def _may_share(ca: pa.Array, cb: pa.Array, need: pa.Array) -> pa.Array:
    out = []
    for a, b, x in zip(ca.to_pylist(), cb.to_pylist(), need.to_pylist(), strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        low = np.minimum(a, b)
        out.append(bool((low == 255).any() or int(low.sum()) >= x))
    return pa.array(out, pa.bool_())


@arrow_udf(BooleanType())
def _linked(sa: pa.Array, sb: pa.Array, percent: pa.Array) -> pa.Array:
    out = []
    for i in range(len(sa)):
        a, b = sa[i].values.to_numpy(), sb[i].values.to_numpy()
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(100 * both >= percent[i].as_py() * (len(a) + len(b) - both))
    return pa.array(out, pa.bool_())


def digest_columns(docs: DataFrame) -> DataFrame:
    return JaccardJoin(docs).result()


def link_columns(docs: DataFrame) -> DataFrame:
    return JaccardJoin(docs).document_links()


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component of near duplicates stays, that
    of the smallest doc_id. Rows are members by themselves, also where they
    share an id; a null id counts as the largest. Empty texts all stay."""
    prepare(spark)
    row, = unused(docs.columns, "row")
    rows = row_keys(docs, row)
    parts = JaccardJoin(rows, row).result().select(F.col("doc_id").alias("own"), "component_id")
    ids = rows.select(F.col(row).alias("row"), "doc_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "own")
    stay = parts.join(ids, F.col("own") == F.col("row")).groupBy("component_id").agg(F.min(order)["own"].alias(row))
    return rows.join(stay.select(row), row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)"""

LINKS_ORACLE = ORACLE.replace("WITH RECURSIVE", "WITH").split(",\nreach AS")[0] + """
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) l USING (doc_id)"""
