"""The sink that joins ordered parts."""

import os

from pyspark.sql import functions as F

from litscout.sinks.document import ranked_anywhere, write_document


def test_parts_are_joined_in_order(spark, tmp_path):
    path = str(tmp_path / "doc.txt")
    rows = spark.range(1_000).withColumn("x", F.pmod(F.col("id") * 7919, F.lit(1000)))
    rows = rows.repartition(9).orderBy(F.desc("x")).select(F.when(F.col("x") % 10 != 0, F.concat(F.lit("é"), F.col("x").cast("string"))).alias("text"))
    write_document(rows, path, "<", ">", ", ")
    with open(path, encoding="utf-8") as f:
        assert f.read() == "<" + ", ".join(f"é{x}" for x in range(999, -1, -1) if x % 10) + ">"
    write_document(rows.where("false"), path, "head", "tail")  # replaces the older one
    with open(path, encoding="utf-8") as f:
        assert f.read() == "headtail"
    assert os.listdir(tmp_path) == ["doc.txt"]


def test_a_failing_task_leaves_the_older_document(spark, tmp_path):
    path = str(tmp_path / "doc.txt")
    write_document(spark.createDataFrame([("old",)], "text string"), path)
    bad = spark.range(50).select(F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("text"))
    try:
        write_document(bad, path)
        raise AssertionError("it must fail")
    except Exception as e:
        assert "no" in str(e)
    with open(path) as f:
        assert f.read() == "old"
    assert os.listdir(tmp_path) == ["doc.txt"]


def test_ranks_of_many_ranges(spark):
    rows = spark.range(5_000).withColumn("score", F.pmod(F.col("id") * 31, F.lit(700))).repartition(11)
    got = ranked_anywhere(rows, [F.desc("score"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5_001))
    assert [r.id for r in got] == sorted(range(5_000), key=lambda i: (-(i * 31 % 700), i))
    assert ranked_anywhere(rows.where("false"), [F.col("id")]).count() == 0
