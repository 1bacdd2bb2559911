"""Helpers that several training-data operators share."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.session import ensure_checkpoint_dir, scratch_path, ship_package

SPACE = b" \t\n\x0b\x0c\r"


#: Bytes of rows that travel to Python at once: whole texts are long.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Shared folder and package for the executors, and a session limit on the
    bytes of an Arrow batch; cheap when already done."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_BATCH, None) != str(BATCH_BYTES):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SCRATCH: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, and fixes results
    that several later jobs must see alike.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, first: int, last: int | None = None) -> None:
    """Delete the tables that ``saved`` wrote as its first-th to last-th, by ``scratch_mark``.

    Only for callers that know that nothing reads them any more, as when a
    result that was made of them has been written.
    """
    for path in _SCRATCH[first:last]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _SCRATCH[first:last]


def scratch_mark() -> int:
    """Number of tables that ``saved`` has written and nobody has dropped."""
    return len(_SCRATCH)


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Each wanted name, with underscores behind it as long as a column has it already."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a bigint ``name`` that is each row's own, the same in all reads.

    Rows of a Parquet table are known by their file and place in it, nothing
    is written. Other frames are written with the key.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        path, number = unused(docs.columns, "file_path", "file_number")
        files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # as many as the driver lists for any scan
        numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{number} bigint, {path} string")
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
        return placed.join(F.broadcast(numbers), path).withColumn(name, F.shiftleft(number, 40) + F.col(name)).drop(path, number)
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only, inside the JVM."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


# ------------------------------------------------------------------ hashing
def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


PIECE = 1 << 17
_POWERS: list[np.ndarray] = []


def _powers(length: int) -> list[np.ndarray]:
    """_BASE and its inverse modulo 2**64, to the powers 0 ... length - 1 or more."""
    if not _POWERS or len(_POWERS[0]) < length:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * length, x)])) for x in (_BASE, inverse)]
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all ``texts``, and the bounds of each text's words.

    Words are runs of anything but ASCII white space. They are hashed in pieces
    of about PIECE bytes, cut at white space, so that memory doesn't follow the
    length of the texts.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):
        size = PIECE
        while at + size < len(raw):
            gaps = np.flatnonzero(_IS_SPACE[raw[at:at + size]])
            if len(gaps):
                size = int(gaps[-1]) + 1
                break
            size *= 2
        start, h = _piece_hashes(raw[at:at + size])
        starts.append(start + at)
        hashes.append(h)
        at += size
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(np.concatenate(starts), ends)])


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``raw``, as differences of a running polynomial over its bytes."""
    power, inverse = _powers(len(raw))
    gap = np.concatenate([[True], _IS_SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * power[:len(raw)])])
    return start, mix((run[end] - run[start]) * inverse[start])


# ------------------------------------------------------------- Bloom filters
BLOCK = 1 << 16  # bytes of a filter that travel in one row
PROBES = 4


def _places(hashes: np.ndarray, bits_log2: int) -> np.ndarray:
    """(PROBES, n) bit positions by double hashing."""
    h = mix(hashes)
    step = (mix(h) | np.uint64(1))
    mask = np.uint64((1 << bits_log2) - 1)
    return np.stack([(h + np.uint64(i) * step) & mask for i in range(PROBES)])


def bloom_add(bits: np.ndarray, hashes: np.ndarray, bits_log2: int) -> None:
    at = _places(hashes, bits_log2).ravel()
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64),
                     (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def bloom_has(bits: np.ndarray, hashes: np.ndarray, bits_log2: int) -> np.ndarray:
    at = _places(hashes, bits_log2)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


BLOCK_SCHEMA = "block int, once binary, twice binary"


def _block_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
         pa.array([r[2] for r in rows], pa.binary())], ["block", "once", "twice"])


def bloom_pair(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits_log2: int) -> tuple[bytes, bytes]:
    """Filters of the hashes seen once and of those seen twice or more.

    Every task fills two filters for its rows and emits their non-empty blocks
    compressed. Blocks meet in a shuffle and are merged as a stream, so neither
    a task nor the driver holds more than one filter pair: a hash set in two
    tasks' once-filters is set in their AND, which goes to the twice-filter.
    ``hashes_of`` gives a batch's hashes, distinct within a document. The
    result has 2**bits_log2 bits each, whatever the data.
    """
    size = (1 << bits_log2) // 8
    block = min(BLOCK, size)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            values, counts = np.unique(hashes_of(batch), return_counts=True)
            if len(values):
                again = (counts > 1) | bloom_has(once, values, bits_log2)
                bloom_add(twice, values[again], bits_log2)
                bloom_add(once, values, bits_log2)
        full = np.flatnonzero(once.reshape(-1, block).any(axis=1))
        for k in full:
            s = slice(k * block, (k + 1) * block)
            yield _block_batch([(int(k), zlib.compress(once[s].tobytes(), 1), zlib.compress(twice[s].tobytes(), 1))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if k == at:
                    twice = twice | b | (once & a)
                    once = once | a
                    continue
                if at is not None:
                    yield _block_batch([(at, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))])
                at, once, twice = k, a, b
        if at is not None:
            yield _block_batch([(at, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))])

    blocks = df.mapInArrow(fill, BLOCK_SCHEMA)
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(merge, BLOCK_SCHEMA)
    once, twice = bytearray(size), bytearray(size)
    for row in merged.toLocalIterator():
        at = row["block"] * block
        once[at:at + block] = zlib.decompress(row["once"])
        twice[at:at + block] = zlib.decompress(row["twice"])
    return bytes(once), bytes(twice)


def bits_for(rows: int, per_row: int, low: int, high: int) -> int:
    """log2 of the filter size for ``rows``, between the documented bounds."""
    return int(np.clip(np.ceil(np.log2(max(1, rows * per_row))), low, high))


# -------------------------------------------------------- connected components
#: Rows up to which a written table of ids is broadcast rather than shuffled: at most a few MB, whatever the input.
FEW = 1 << 16


def few(table: DataFrame) -> bool:
    return table.count() <= FEW


def lookup(table: DataFrame) -> DataFrame:
    """``table`` (small columns, written) with a hint to broadcast it if its rows are few; a join gives the same either way."""
    return F.broadcast(table) if few(table) else table


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label is the smallest
    node of the component."""
    out = stars(saved(_downward(links).distinct(), f"{name}-edges"), name)
    return out.unionByName(out.select(F.col("label").alias("node"), "label").distinct())


def stars(links: DataFrame, name: str) -> DataFrame:
    """(node, label) as ``components`` gives them, without the smallest nodes
    themselves. ``links`` should be cheap to read: it is read a few times.

    Alternates two steps until each node has one edge, to a smallest node:
    each edge's lower end is replaced by the smallest node below that end, then
    each node hands the smallest of its ends to the others. Every round is a
    written table. A hub is a key of the join only, and its minimum is combined
    before the shuffle; minima of a few edges are broadcast.
    """
    edges = _downward(links)
    while left := edges.count():
        hint = F.broadcast if left <= FEW else lambda d: d
        below = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(hint(below), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(hint(low), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                                  F.col("m").alias("b"))
        edges = saved(small.distinct(), f"{name}-round")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _downward(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
