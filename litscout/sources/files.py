"""File readers and the candidate snapshot (SRC15 to SRC22, SNK8, SNK9, INC6, INC7, FLT10)."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number, strip
from ..operators.state import Snapshots
from ..schema import CANDIDATES

PROFILE = (
    "generated_at STRING, item_count BIGINT, model STRING, centroid ARRAY<DOUBLE>, top_authors ARRAY<STRUCT<author STRING, count BIGINT>>, top_venues ARRAY<STRUCT<venue STRING, count BIGINT>>"
)
TTL = timedelta(hours=12)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def journal_metrics(spark: SparkSession, path: str) -> DataFrame:
    """SRC20: (title_key, sjr) of a CSV with the columns title and sjr; blank titles and values that are no numbers go, of equal keys the last line stays. No file: no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "title_key string, sjr double")
    lines = spark.read.csv(path, header=True, schema="title STRING, sjr STRING").select("title", "sjr", F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("at"))
    rows = lines.select(strip(F.lower(F.coalesce("title", F.lit("")))).alias("title_key"), number(F.col("sjr")).alias("sjr"), "at").where("title_key <> '' AND sjr IS NOT NULL")
    return rows.groupBy("title_key").agg(F.max_by("sjr", "at").alias("sjr"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """SRC21: the profile document; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(PROFILE).json(path, multiLine=True, encoding="UTF-8")


def write_profile(summary: DataFrame, path: str) -> None:
    """SNK8: one JSON document in UTF-8, keys sorted at every level; one row, so it is written by the driver, and renamed into place."""
    row = summary.select(F.to_json(F.struct(*summary.columns), {"ignoreNullFields": "false"}).alias("value")).first()
    spark = summary.sparkSession
    new, at = (spark._jvm.org.apache.hadoop.fs.Path(path + x) for x in (".new", ""))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(json.loads(row.value), sort_keys=True, ensure_ascii=False, indent=2).encode()))
    out.close()
    fs.delete(at, True)
    fs.rename(new, at)


def write_index(library: DataFrame, path: str) -> None:
    """SNK7: key and vector of the rows that have one, as the next ``v=N`` below the folder; the last complete one counts."""
    Snapshots(library.sparkSession, path).write(library.where("embedding IS NOT NULL").select("key", "embedding"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """SRC22: the library's vectors; an empty table is an error."""
    found = Snapshots(spark, path).read("key STRING, embedding ARRAY<FLOAT>").where("embedding IS NOT NULL")
    if not found.limit(1).count():
        raise ValueError(f"no vectors in {path}")
    return found


class Snapshot:
    """SRC16, SNK9: candidates with the time they were fetched, as Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, candidates: DataFrame, fetched_at: datetime) -> None:
        candidates.write.mode("overwrite").parquet(f"{self.path}/at={fetched_at:%Y%m%dT%H%M%S}")

    def newest(self) -> tuple[datetime, DataFrame] | None:
        """(time, rows) of the newest complete snapshot."""
        if not exists(self.spark, self.path):
            return None
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in fs.listStatus(base) if exists(self.spark, f"{self.path}/{s.getPath().getName()}/_SUCCESS")]
        if not done:
            return None
        name = max(done)
        return datetime.strptime(name[3:], "%Y%m%dT%H%M%S"), self.spark.read.schema(CANDIDATES).parquet(f"{self.path}/{name}")


def is_fresh(fetched_at: datetime, now: datetime, ttl: timedelta = TTL) -> bool:
    """FLT10."""
    return now - fetched_at <= ttl


def candidates_or_stale(fetched: DataFrame, every_source_failed: bool, snapshot: Snapshot, now: datetime) -> DataFrame:
    """INC7: the stale snapshot only if every source failed and it has rows; else what was fetched, which is stored."""
    if every_source_failed and (old := snapshot.newest()) is not None and old[1].limit(1).count():
        return old[1]
    snapshot.write(fetched, now)
    return fetched
