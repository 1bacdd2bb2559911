"""Quoted CSV cut at any byte: records, states of ranges, heads of files."""
import random

import pytest
from pyspark.sql import functions as F

from tabvet.sources import records as R
from tabvet.sources import scan as S


def test_ends_inside():
    for line, before, after in (("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('x",y', True, False), ('x"",y', True, True),
                                ('5" disk,z', False, False), (' "a', False, True), ('a, "b""', False, True), ('""', False, False), ('"""', False, True),
                                ('a",b,"c', True, True), ("", True, True), ("", False, False), ('a"b"c,"', False, True)):
        assert R.ends_inside(line, before, ",") is after, line
    assert R.ends_inside('a||"b', False, "||") and not R.ends_inside('a,"b', False, "||")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(1500):
        text = "".join(r.choice(["a", "b", " ", '"', "\n", "\r\n", ",", "é", "x y"]) for _ in range(r.randrange(0, 60)))
        out.append((i, text if i % 100 else "\n" * 4000, '5" disk' if i % 50 == 0 else "z"))
    return out


def quoted(value, sep):
    needs = any(c in value for c in (sep, "\n", "\r")) or value[:1] in ('"', " ") or ('"' in value and not value.startswith("5"))
    return '"' + value.replace('"', '""') + '"' if needs else value


@pytest.mark.parametrize(("encoding", "sep", "end"), [("utf-8", ",", "\n"), ("latin-1", ";", "\r\n")])
def test_a_file_cut_anywhere(spark, tmp_path, rows, encoding, sep, end):
    text = sep.join(("id", '"two ""words"""', "more")) + end + end + end.join(sep.join(quoted(str(v), sep) for v in row) for row in rows)
    (tmp_path / "one.csv").write_bytes(text.encode(encoding))
    (tmp_path / "two.csv").write_bytes((sep.join(("id", '"two ""words"""', "more")) + end + f'-1{sep}"é{end}b"{sep}"c"').encode(encoding))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1700")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        assert R.records(spark, str(tmp_path), sep, S.SPARK_ENCODINGS[encoding]).select("record").distinct().rdd.getNumPartitions() > 0
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        df, info = S.scan(spark, str(tmp_path))
        assert info["encoding"] == encoding and info["delimiter"] == sep and df.columns == ["id", 'two "words"', "more"]
        got = sorted(tuple(x) for x in df.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    tokens = set(S.K.READER_NA_TOKENS)
    assert got == sorted([(i, None if t in tokens else t, m) for i, t, m in rows] + [(-1, f"é{end}b", "c")], key=lambda x: (x[0],))


def test_files_without_quotes_need_no_search(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n\n2,y\n")
    assert R.records(spark, str(tmp_path), ",") is None
    assert sorted(tuple(x) for x in S.scan(spark, str(tmp_path))[0].collect()) == [(1, "x"), (2, "y")]


def test_a_field_that_is_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,x\n2,"y\nz\n')
    df, _ = S.scan(spark, str(tmp_path))
    assert df.count() == 2 and df.where("a = 2").first()["b"].startswith("y")


def test_sniff_reads_heads_only(spark, tmp_path, monkeypatch):
    (tmp_path / "big.csv").write_text("a;b\n" + "1;x\n" * 40_000)
    (tmp_path / "small.csv").write_bytes("a,é\n1,x\n".encode("latin-1"))
    expected = {("big.csv", "utf-8", ";"), ("small.csv", "latin-1", ",")}
    name = F.regexp_extract("path", "([^/]+)$", 1)
    assert {tuple(x) for x in S.sniff(spark, str(tmp_path)).select(name, "encoding", "delimiter").collect()} == expected
    monkeypatch.setattr(S, "_opens", lambda path: False)  # as in a store that only Spark opens
    assert {tuple(x) for x in S.sniff(spark, str(tmp_path), "*.csv").select(name, "encoding", "delimiter").collect()} == expected
    assert S.sniff_bytes(b"x" * 10)[1] == ","


def test_cap_rows_by_order(spark):
    df = spark.range(100).repartition(5)
    kept, cut = S.cap_rows(df, 10, "id")
    assert cut and sorted(x["id"] for x in kept.collect()) == list(range(10))
    assert S.cap_rows(df, 100) [1] is False and S.cap_rows(df, 99)[1] is True
