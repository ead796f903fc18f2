"""Where intermediate tables are written: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Without that setting a temporary folder is made in local mode; on a cluster that would scatter the
    tables over machines, so it is an error there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="litscout-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def size_of(setting: str) -> int:
    """The bytes of a Spark size such as ``64m``, ``1g``, ``512k`` or ``4194304``; without a unit, bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches to Python workers hold 4 MB at most: by default they hold 10,000 texts or 64 MB, which idle workers keep."""
    now = size_of(spark.conf.get(BATCH_BYTES, "64m"))
    if now <= 0 or now > most:
        spark.conf.set(BATCH_BYTES, str(most))


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    bound_batches(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    schema = spark.read.parquet(path).schema if partition_by else df.schema
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote for the tables; only once all that reads them has been written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
