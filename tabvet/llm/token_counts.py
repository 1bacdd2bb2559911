"""Token counts of fields and sections, by offsets.

A document is rendered with its fields into one text and encoded once, whole.
The tokens' character spans are joined to the spans of the fields and of the
body's sections by binary search; a token that crosses a boundary is allotted
by an explicit rule.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import as_bytes, prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokeniser's pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "majority")
#: (glue before the field, column); the last is the body, whose lines are sections.
TEMPLATE = (("source: ", "source"), ("\nlanguage: ", "lang"), ("\n\n", "text"))
GLUE = "template"


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoding and the byte length of each token id; loaded once in a worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def pieces(fields: list[bytes], template: tuple) -> list[tuple[str, bytes]]:
    """Named pieces whose concatenation is the rendered text: glue, fields, and
    the body's lines with their breaks (one empty line if it is empty)."""
    out = []
    for (glue, name), value in zip(template, fields, strict=True):
        out.append((GLUE, glue.encode()))
        out += [(name, x) for x in _lines(value)] if name == template[-1][1] else [(name, value)]
    return out


def _lines(body: bytes) -> list[bytes]:
    lines = body.split(b"\n")
    out = [x + b"\n" for x in lines[:-1]]
    return out + [lines[-1]] if lines[-1] or not out else out


def allot(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether the token crosses a boundary.

    ``start``: the section of its first byte; ``end``: of its last;
    ``majority``: the one that holds most of its bytes, the earlier on a tie.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule != "majority":
        return (first if rule == "start" else last), first != last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        cuts = np.concatenate([[starts[i]], bounds[first[i] + 1:last[i] + 1], [ends[i]]])
        out[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return out, first != last


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", template: tuple = TEMPLATE, vocabulary: str = VOCABULARY,
                 rule: str = "majority") -> DataFrame:
    """One row per piece of each rendered row: doc_id, section (from 0), field,
    start_char, end_char, n_tokens, n_crossing.

    ``n_crossing`` are the tokens allotted to the piece that cross a boundary.
    The counts of a document add up to the tokens of its rendered text. Null
    fields count as empty and have no tokens, the body then is one empty
    section. Repeated rows are counted each; columns outside the template are
    not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    columns = [c for _, c in template]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, found, sizes = [], [[], [], [], [], []], []
                for fields in zip(*(as_bytes(c) for c in part.columns[1:]), strict=True):
                    own = pieces(list(fields), template)
                    raw, n = b"".join(x for _, x in own), len(own)
                    bounds = np.cumsum([0] + [len(x) for _, x in own])
                    ids = np.array(encoding.encode_ordinary(raw.decode()), np.int64)
                    ends = np.cumsum(lengths[ids])
                    to, crosses = allot(ends - lengths[ids], ends, bounds, rule)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    names += [x for x, _ in own]
                    sizes.append(n)
                    for column, values in zip(found, (np.arange(n), chars[bounds[:-1]], chars[bounds[1:]], np.bincount(to, minlength=n),
                                                      np.bincount(to[crosses], minlength=n)), strict=True):
                        column.append(values)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                section, *rest = (pa.array(np.concatenate(c).astype(np.int64)) for c in found)
                yield pa.RecordBatch.from_arrays([ids, section, pa.array(names, pa.string()), *rest],
                                                 ["doc_id", "section", "field", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(columns)]).mapInArrow(
        count, f"doc_id {kind}, section bigint, field string, start_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint")
