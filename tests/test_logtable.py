"""The merge-on-read table against a dict, batch by batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from litscout.operators.logtable import LogTable

SCHEMA = "key string, version bigint, words array<string>"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, [k]) for k, v in rows], SCHEMA)


def keys(spark, names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def content(df):
    return sorted((r.key, r.version, r.words[0]) for r in df.collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("bucket_rows, most_deltas, share", [(40, 2, 0.5), (1_000_000, 3, 100.0), (10, 100, 0.01)])
def test_batches_equal_a_dict(spark, tmp_path, bucket_rows, most_deltas, share):
    rng = random.Random(bucket_rows)
    table = LogTable(spark, str(tmp_path), SCHEMA, bucket_rows=bucket_rows, most_deltas=most_deltas, share=share)
    assert table.read().count() == 0 and table.read(of=keys(spark, ["a"])).count() == 0
    held = {}
    for batch in range(6):
        rows = {f"k{rng.randint(0, 150)}": 100 * batch + i for i in range(100 if batch == 0 else 25)}
        gone = {f"k{rng.randint(0, 170)}" for _ in range(0 if batch == 2 else 8)}
        table.append(frame(spark, [*rows.items(), (None, 1)]), keys(spark, [*gone, None]) if gone else None, **({"cursor": batch} if batch % 2 else {}))
        held = {k: v for k, v in (held | rows).items() if k not in gone}
        assert content(table.read()) == sorted((k, v, k) for k, v in held.items())
        some = rng.sample(sorted(held), 5) + ["unknown"]
        assert content(table.read(of=keys(spark, some))) == sorted((k, held[k], k) for k in some if k in held)
    at = table.pointer()
    assert at["version"] == 5 and at["cursor"] == 5 and len(at["deltas"]) <= most_deltas
    table.vacuum(5)
    assert content(table.read()) == sorted((k, v, k) for k, v in held.items())
    left = {n for n in os.listdir(tmp_path) if n.startswith(("base", "delta"))}
    assert left == {f"base-{g}" for g in at["base"].values()} | {d["name"] for d in at["deltas"]}
    table.write(frame(spark, [("z", 1)]), cursor=9)
    assert content(table.read()) == [("z", 1, "z")] and table.pointer()["cursor"] == 9


def test_a_batch_of_one_percent_writes_under_five(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), "key string, version bigint, text string", bucket_rows=10_000)
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("version"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    table.append(rows)
    before = size(tmp_path)
    table.append(rows.where("key % 100 = 7").withColumn("version", F.lit(2).cast("bigint")), keys(spark, ["5"]))
    assert size(tmp_path) - before < 0.05 * before
    assert table.read().groupBy("version").count().orderBy("version").collect() == [(1, 39_599), (2, 400)]


def test_a_bucket_that_changes_is_rewritten_alone(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), SCHEMA, bucket_rows=50, share=0.2)
    table.append(frame(spark, [(f"k{i}", 0) for i in range(400)]))
    bucket = table._bucket(table.pointer()["buckets"])
    one = [r.key for r in table.read().where(bucket == 3).collect()]
    other = [r.key for r in table.read().where(bucket == 5).limit(2).collect()]
    table.append(frame(spark, [(k, 1) for k in one + other]))
    at = table.pointer()
    assert [b for b, g in at["base"].items() if g == 1] == ["3"] and at["deltas"][0]["rows"] == {"5": 2}
    assert table.read().where("version = 1").count() == len(one) + 2 and table.read().count() == 400


def test_reads_skip_other_buckets(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), SCHEMA, bucket_rows=50)
    table.append(frame(spark, [(f"k{i}", 0) for i in range(400)]))
    assert len(table.read(of=keys(spark, ["k7"])).inputFiles()) < len(table.read().inputFiles()) / 3


def test_many_small_buckets_share_few_files(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), "key string, version bigint", bucket_rows=4)
    rows = spark.range(4_000).select(F.col("id").cast("string").alias("key"), F.lit(0).cast("bigint").alias("version"))
    table.append(rows)
    for batch in (1, 2):  # half of the buckets are rewritten, those left stay where they are
        table.append(rows.where(table._bucket(table.pointer()["buckets"]) % 2 == batch - 1).withColumn("version", F.lit(batch).cast("bigint")))
        at = table.pointer()
        assert at["buckets"] <= 256 and set(at["base"].values()) == {batch - 1, batch}
        assert len(table.read().inputFiles()) <= 64
        assert table.read().groupBy("version").count().orderBy("version").collect()[-1][0] == batch and table.read().count() == 4_000
    assert table.read().agg(F.count_distinct("key")).first()[0] == 4_000 and table.read().where("version = 0").count() == 0


def test_a_table_without_folders_is_read_and_laid_out_anew(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), SCHEMA, bucket_rows=5)
    rows = frame(spark, [(f"k{i}", 0) for i in range(10)]).withColumn("__bucket", table._bucket(2))
    rows.write.partitionBy("__bucket").parquet(f"{tmp_path}/base-0")
    held = {str(r[0]): r[1] for r in rows.groupBy("__bucket").count().collect()}
    table._commit(0, {"buckets": 2, "base": dict.fromkeys(held, 0), "rows": held, "deltas": [], "cursor": 7})
    assert table.read().count() == 10 and content(table.read(of=keys(spark, ["k3"]))) == [("k3", 0, "k3")]
    table.append(frame(spark, [("k3", 1)]), keys(spark, ["k4"]))
    assert content(table.read()) == sorted((f"k{i}", int(i == 3), f"k{i}") for i in range(10) if i != 4)
    assert table.pointer()["cursor"] == 7 and table.pointer()["folders"] >= 1
