"""Secret scans with DataFrame functions only.

Three patterns give the base findings. Beside them, candidate strings are
scanned with a sliding window whose Shannon entropy is kept up by incremental
counts: a step changes two counts and the sum of c*log2(c) by their
differences. Windows at or above the threshold of their own character class
are merged into spans; an allow-list suppresses windows and stretches of a
candidate known to be harmless, not what stands beside them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import unused

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the greedy run of 20 characters or more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
#: Window starts of a chunk of a candidate, and matches of a block of positions.
CHUNK, BLOCK = 256, 128
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
#: Character class of a window, tried in this order, and its least entropy in bits.
#: The first three find 95% or more of random strings of WINDOW characters; the
#: last is for one case and signs, as in paths of words.
CLASSES = ((r"^[0-9A-Fa-f]+$", 3.02), (r"^([0-9a-z]+|[0-9A-Z]+)$", 3.52), (r"^(?=.*[A-Z])(?=.*[a-z])", 3.68), (r"", 4.02))
#: What is no secret. Patterns that begin with ^ judge a window: words without
#: a digit, numbers. Others are stretches that no window may touch: UUIDs,
#: placeholders and counting sequences.
ALLOWED = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])",
           r"(?i)example|sample|placeholder|changeme|dummy|xxxx", r"(?i)0123456789|abcdefghij")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside loops of ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match), in code points, of the pattern's leftmost matches that do not overlap.

    Positions are sums of lengths, made block by block, so that the time grows
    with the text and not with the square of the number of matches.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("match"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    blocks = bind(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")),
                                               lambda k: F.aggregate(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), zero, step)))
    offset = lambda b: F.aggregate(b, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    moved = bind(blocks, lambda b: F.flatten(F.transform(
        F.arrays_zip(b.alias("block"), F.slice(offset(b), F.lit(1), F.size(b)).alias("by")),
        lambda x: F.transform(x["block"]["out"], lambda y: F.struct((y["start"] + x["by"]).alias("start"), (y["end"] + x["by"]).alias("end"), y["match"].alias("match"))))))
    return F.when(text.rlike(pattern), moved).otherwise(none)


def _cost(count: Column) -> Column:
    """c * log2(c), 0 for none."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def pieces(word: Column, pattern: str) -> Column:
    """Array of (start, text) of what the pattern's matches leave of ``word``."""
    between = F.split(word, pattern, -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(located(word, pattern), lambda x: x["end"]))
    return F.arrays_zip(starts.alias("start"), between.alias("text"))


def _hot_starts(text: Column, allowed: tuple[str, ...], window: int) -> Column:
    """Starts of the windows of a chunk whose entropy reaches that of their class and that match none of ``allowed``.

    ``counts`` has a character for each symbol: "@" for none, "A" for one and so on.
    """
    lowest = min(bits for _, bits in CLASSES)

    def scanned(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            count = lambda c: F.ascii(F.substring(acc["counts"], c, F.lit(1))) - 64
            put = lambda counts, c, n: F.overlay(counts, F.char(n + 64), c, F.lit(1))
            bound = F.struct(F.element_at(codes, i).alias("come"), F.when(i > window, F.get(codes, i - window - 1)).otherwise(F.lit(0)).alias("go"))

            def counted(x: Column) -> Column:
                return F.struct(x["come"].alias("come"), x["go"].alias("go"), count(x["come"]).alias("n_come"),
                                F.when(x["go"] > 0, count(x["go"])).otherwise(F.lit(0)).alias("n_go"))

            def moved(x: Column) -> Column:
                more = put(acc["counts"], x["come"], x["n_come"] + 1)
                return F.when(x["come"] == x["go"], F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"))).otherwise(F.struct(
                    F.when(x["go"] > 0, put(more, x["go"], x["n_go"] - 1)).otherwise(more).alias("counts"),
                    (acc["sum"] + _cost(x["n_come"] + 1) - _cost(x["n_come"]) + _cost(x["n_go"] - 1) - _cost(x["n_go"])).alias("sum")))

            def judged(x: Column) -> Column:
                own, bits = F.substring(text, i - window + 1, F.lit(window)), F.log2(F.lit(float(window))) - x["sum"] / window
                hot = F.when((i < window) | (bits < lowest), False).otherwise((bits >= _least(own)) & ~F.greatest(*[own.rlike(a) for a in allowed], F.lit(False), F.lit(False)))
                return F.struct(x["counts"].alias("counts"), x["sum"].alias("sum"),
                                F.when(hot, F.concat(acc["out"], F.array(i - window))).otherwise(acc["out"]).alias("out"))

            return bind(bind(bind(bound, counted), moved), judged)

        zero = F.struct(F.lit("@" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda acc: acc["out"])

    return bind(F.transform(F.split(text, "", -1), lambda c: F.instr(F.lit(ALPHABET), c)), lambda codes: scanned(F.filter(codes, lambda c: c > 0)))


def hot_windows(word: Column, allowed: tuple[str, ...] = (), window: int = WINDOW) -> Column:
    """Merged (start, end) of the windows of ``word`` whose entropy reaches that
    of their class and that match none of ``allowed``.

    The word is scanned in chunks of CHUNK window starts, each with the
    characters that its last windows need, so the time grows with its length.
    """
    split = f"(.{{1,{CHUNK}}})(?=(.{{0,{window - 1}}}))"
    parts = F.arrays_zip(F.regexp_extract_all(word, F.lit(split), F.lit(1)).alias("own"), F.regexp_extract_all(word, F.lit(split), F.lit(2)).alias("more"))
    starts = F.flatten(F.transform(parts, lambda x, k: bind(F.concat(x["own"], x["more"]), lambda t: F.transform(
        F.when(F.length(t) >= window, _hot_starts(t, allowed, window)).otherwise(F.array().cast("array<int>")), lambda s: s + k * CHUNK))))

    def merged(hot: Column) -> Column:
        first = F.filter(hot, lambda x, i: (i == 0) | (F.get(hot, i - 1) < x - window))
        last = F.filter(hot, lambda x, i: (i == F.size(hot) - 1) | (F.get(hot, i + 1) > x + window))
        return F.transform(F.arrays_zip(first.alias("start"), last.alias("end")), lambda x: F.struct(x["start"].alias("start"), (x["end"] + window).alias("end")))

    return bind(starts, merged)


def _least(word: Column) -> Column:
    out = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(word.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED, base_name: str = "base", all_name: str = "all") -> DataFrame:
    """``docs`` with two last columns, arrays of (start, rank, end, kind) by start,
    then kind as listed; code points, end exclusive: the base findings, and all.
    A name that ``docs`` has already gets underscores behind it.

    Base findings are the three patterns' matches that are long enough; the
    allow-list (see ``ALLOWED``) concerns entropy spans only.
    A null or empty text has none. Every row is scanned whole and by itself,
    repeated rows too; all other columns pass; an empty table gives no rows.
    """
    base_name, all_name, b, c = unused(docs.columns, base_name, all_name, "b", "c")
    body = F.coalesce(F.col(text), F.lit(""))
    value = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(located(body, ASSIGN), lambda x, i: F.length(F.get(value, i)) >= 6)
    assign = F.when(body.rlike(ASSIGN), assign).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    base = F.concat(_spans(assign, "assign"), _spans(located(body, ACCESS), "access"), _spans(located(body, HEX), "hex"))
    harmless = "|".join(f"(?:{a})" for a in allowed if not a.startswith("^")) or "(?!)"
    judged = tuple(a for a in allowed if a.startswith("^"))
    parts = F.flatten(F.transform(F.col(c), lambda x: F.transform(
        pieces(x["match"], harmless), lambda y: F.struct((x["start"] + y["start"]).alias("start"), y["text"].alias("text")))))
    hot = F.flatten(F.transform(F.filter(parts, lambda x: F.length(x["text"]) >= WINDOW), lambda x: F.transform(
        hot_windows(x["text"], judged),
        lambda w: F.struct((x["start"] + w["start"]).alias("start"), F.lit(3).alias("rank"), (x["start"] + w["end"]).alias("end")))))
    name = F.array(*[F.lit(k) for k in KINDS])
    labelled = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(
        x["start"], x["rank"], x["end"], F.get(name, x["rank"]).alias("kind")))
    return (docs.withColumn(b, base).withColumn(c, located(body, CANDIDATE))
            .withColumn(base_name, labelled(F.col(b))).withColumn(all_name, labelled(F.concat(b, hot))).drop(b, c))


def digest_columns(docs: DataFrame) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("all")).alias("spans"))
