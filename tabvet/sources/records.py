"""Records of delimited files whose quoted fields may hold line breaks, split among tasks.

A byte range of a file can't tell by itself whether it begins inside quotes.
So each range first says, from its lines with quotes, how it would end if it
began outside and how if it began inside. These maps compose like numbers add;
a running composition over the ranges of a file gives each range the state it
really begins in. Then all ranges are cut into records apart. A record that
crosses ranges is put together from its pieces.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabvet.session import ship_package


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open at the end of ``line``, which begins ``inside`` one or at a record's start.

    A quote opens a field only at its front, spaces before it apart; others
    are text. Two quotes in a quoted field are one of its characters.
    """
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        else:
            while at < n and line[at] == " ":
                at += 1
            if line.startswith('"', at):
                inside, at = True, at + 1
                continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(value, fid, block): lines in file order within each byte range of a file, which ``fid`` names."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    return raw.select(value.alias("value"), F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("block"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """(range, its next lines), as they come."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fid, block = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = np.flatnonzero((np.diff(fid) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fid)], strict=True):
            yield (int(fid[a]), int(block[a])), batch.column(0).slice(a, b - a)


def _range_maps(lines: DataFrame, sep: str) -> DataFrame:
    """(fid, block, out0, out1) of ranges with quotes: the state at their end
    when they begin outside quotes and inside; other ranges end as they begin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, (0, 1)

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([int(out[0])], pa.int32()), pa.array([int(out[1])], pa.int32())],
                                              ["fid", "block", "out0", "out1"])

        for where, values in _stretches(batches):
            if where != at:
                if at is not None:
                    yield emit()
                at, out = where, (False, True)
            for line in values.to_pylist():
                ends = ends_inside(line, False, sep), ends_inside(line, True, sep)
                out = ends[out[0]], ends[out[1]]
        if at is not None:
            yield emit()

    return lines.where(F.col("value").contains('"')).mapInArrow(run, "fid bigint, block bigint, out0 int, out1 int")


def _changes(maps: DataFrame) -> dict[int, tuple[list[int], list[bool]]]:
    """For each file the ranges after which the state is another than before, and that state.

    The driver holds one entry for each range at most, of some 100 MB of input.
    """
    rows = Window.partitionBy("fid").orderBy("block")
    so_far = rows.rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum(F.when((F.col("out0") == 1) & (F.col("out1") == 0), 1).otherwise(0)).over(so_far)
    fixed = F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("state"), F.col("swaps").alias("swaps")))
    known = (maps.withColumn("swaps", swaps).withColumn("fixed", F.last(fixed, ignorenulls=True).over(so_far))
             .withColumn("state", F.pmod(F.coalesce("fixed.state", F.lit(0)) + F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0)), F.lit(2)))
             .withColumn("before", F.coalesce(F.lag("state").over(rows), F.lit(0))).where("state <> before"))
    out: dict[int, tuple[list[int], list[bool]]] = defaultdict(lambda: ([], []))
    for r in known.select("fid", "block", "state").orderBy("fid", "block").toLocalIterator():
        out[r["fid"]][0].append(r["block"])
        out[r["fid"]][1].append(bool(r["state"]))
    return dict(out)


WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "kind int, fid bigint, block bigint, first boolean, record string"


class _Cutter:
    """Cuts the lines of one range into records; pieces of records that cross its ends are HEAD or TAIL."""

    def __init__(self, where: tuple[int, int], inside: bool, sep: str):
        self.where, self.inside, self.sep = where, inside, sep
        self.open: list[str] = []
        self.mine = not inside  # whether the open record began in this range
        self.fresh = where[1] == 0  # the file's first record is still to come

    def _first(self, record: str) -> bool:
        out, self.fresh = self.fresh and bool(record.strip(" \t\r")), self.fresh and not record.strip(" \t\r")
        return out

    def feed(self, values: pa.Array) -> Iterator[tuple[int, bool, str]]:
        quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist()
        lines, at = values.to_pylist(), 0
        for q in [*quoted, len(lines)]:
            if self.inside:
                self.open += lines[at:q]
            else:
                for record in lines[at:q]:
                    yield WHOLE, self._first(record), record
            if q == len(lines):
                return
            was, self.inside = self.inside, ends_inside(lines[q], self.inside, self.sep)
            if was or self.inside:
                self.open.append(lines[q])
            if not self.inside:
                if was:
                    record = "\n".join(self.open)
                    yield (WHOLE, self._first(record), record) if self.mine else (HEAD, False, record)
                    self.open, self.mine = [], True
                else:
                    yield WHOLE, self._first(lines[q]), lines[q]
            at = q + 1

    def close(self) -> Iterator[tuple[int, bool, str]]:
        if self.inside:
            record = "\n".join(self.open)
            yield (TAIL, self._first(record), record) if self.mine else (HEAD, False, record)


def records(spark: SparkSession, path: str, sep: str, charset: str = "UTF-8") -> DataFrame | None:
    """(first, record) of every record that isn't blank; ``first`` marks each
    file's first one. None when no line holds a quote, so that every line is a
    record and any reader may split the files.

    Lines end in a line feed, a carriage return before it belongs to the end.
    """
    ship_package(spark)
    lines = _lines(spark, path, charset)
    maps = _range_maps(lines, sep)
    changes = _changes(maps)
    if not changes and maps.isEmpty():
        return None
    shared = spark.sparkContext.broadcast(changes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = None, []

        def batch() -> pa.RecordBatch:
            kind, where, first, record = zip(*held, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([w[0] for w in where], pa.int64()), pa.array([w[1] for w in where], pa.int64()),
                                              pa.array(first, pa.bool_()), pa.array(record, pa.string())], ["kind", "fid", "block", "first", "record"])
            held.clear()
            return out

        for where, values in _stretches(batches):
            if cutter is None or where != cutter.where:
                if cutter:
                    held += [(k, cutter.where, f, r) for k, f, r in cutter.close()]
                blocks, states = shared.value.get(where[0], ((), ()))
                i = bisect_left(blocks, where[1]) - 1
                cutter = _Cutter(where, i >= 0 and states[i], sep)
            for k, f, r in cutter.feed(values):
                held.append((k, cutter.where, f, r))
                if len(held) >= 4096:
                    yield batch()
        if cutter:
            held += [(k, cutter.where, f, r) for k, f, r in cutter.close()]
        if held:
            yield batch()

    pieces = lines.mapInArrow(cut, PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("first", "record")
    if changes:  # some record crosses ranges
        order = Window.partitionBy("fid").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
        parts = pieces.where(F.col("kind") != WHOLE).withColumn("n", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
        whole = whole.unionByName(parts.groupBy("fid", "n").agg(
            F.max("first").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "record"))), lambda x: x["record"]), "\n").alias("record"))
            .select("first", "record"))
    return whole.select("first", F.regexp_replace("record", "\r$", "").alias("record")).where(F.length(F.btrim("record", F.lit(" \t\r"))) > 0)
