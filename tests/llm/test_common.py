"""Row keys, temporary names and scratch tables."""
import os

from tabvet.llm import common


def test_row_keys_of_tables_and_frames(spark, tmp_path):
    spark.range(500).selectExpr("id % 7 AS a", "id % 3 AS file_path").repartition(6).write.parquet(str(tmp_path / "t"))
    rows = common.row_keys(spark.read.parquet(str(tmp_path / "t")), "row")
    assert rows.columns == ["a", "file_path", "row"] and rows.select("row").distinct().count() == 500
    one, two = ({x["row"]: x["a"] for x in df.collect()} for df in (rows, rows.where("a >= 0").select("row", "a").orderBy("row")))
    assert one == two
    joined = spark.read.parquet(str(tmp_path / "t")).unionByName(spark.read.parquet(str(tmp_path / "t")))
    again = common.row_keys(joined, "row")
    assert again.select("row").distinct().count() == 1000 and again.exceptAll(again).count() == 0
    assert common.row_keys(spark.read.parquet(str(tmp_path / "t")).limit(0), "row").count() == 0


def test_unused_names():
    assert common.unused(["Row", "row_", "x"], "row", "x", "y", "row") == ["row__", "x_", "y", "row___"]


def test_drop_scratch(spark):
    first = common.scratch_mark()
    kept = common.saved(spark.range(3), "t-kept")
    common.saved(spark.range(3), "t-gone")
    path = common._SCRATCH[-1]
    common.drop_scratch(spark, first + 1)
    assert not os.path.exists(path.removeprefix("file:")) and common.scratch_mark() == first + 1 and kept.count() == 3
