"""Library state: latest row per key, tombstones, cursor, snapshots (SNK1 to SNK6, JN11, AGG6, INC)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash


def latest(changes: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """SNK1: of each key the row of greatest version; an aggregation, so hot keys combine before the shuffle."""
    row = F.struct(*changes.columns)
    return changes.groupBy(key).agg(F.max_by(row, F.col(version)).alias("__row")).select("__row.*")


def upserts(state: DataFrame, changes: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """SNK1: the rows that ``changes`` make of a state, of which the rows of their keys are enough.

    An upsert does not touch the embedding, but one whose content hash changed drops it: it is stale.
    One that is older than the state's row changes nothing, so a batch may come again.
    """
    extra = [F.col("embedding").alias("__embedding"), F.col("content_hash").alias("__hash")] if "embedding" in state.columns else []
    new = latest(changes, key, version).join(state.select(key, F.col(version).alias("__version"), *extra), key, "left")
    new = new.where(F.col("__version").isNull() | (F.col(version) >= F.col("__version")))
    if extra:
        kept = F.when(F.col("content_hash").eqNullSafe(F.col("__hash")), F.col("__embedding"))
        new = new.withColumn("embedding", kept)
    return new.select(*state.columns)


def apply_changes(state: DataFrame, changes: DataFrame, deleted: DataFrame | None = None, key: str = "key", version: str = "version") -> DataFrame:
    """INC3: state with the latest upserts, without the deleted keys."""
    new = upserts(state, changes, key, version)
    out = state.join(new.select(key), key, "left_anti").unionByName(new)
    return out if deleted is None else remove(out, deleted, key)


def remove(state: DataFrame, deleted: DataFrame, key: str = "key") -> DataFrame:
    """SNK2, JN11."""
    return state.join(deleted.select(key), key, "left_anti")


def set_embeddings(state: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """SNK3: state with the vectors of ``vectors`` (key, embedding)."""
    out = state.join(vectors.select(key, F.col("embedding").alias("__new")), key, "left")
    return out.withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new").select(*state.columns)


def cursor(rows: DataFrame, version: str = "version") -> DataFrame:
    """AGG6: the greatest version seen."""
    return rows.agg(F.max(version).alias("cursor"))


def with_hash(library: DataFrame) -> DataFrame:
    """S10 of title, abstract, creators and tags."""
    lists = [F.array_join(c, ",") for c in ("creators", "tags")]
    return library.withColumn("content_hash", content_hash(F.col("title"), F.col("abstract"), *lists))


class Snapshots:
    """Versioned snapshots of a table under a folder: ``v=N`` folders and a pointer file ``pointer-N.json`` for each, written last.

    Pointers are renamed into place and never replaced: a reader takes the highest, so it never sees a half-written
    snapshot, and there is no moment without a pointer. A path that is being read is never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(self._path())] if fs.exists(self._path()) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"pointer-(\d+)\.json", n)))

    def pointer(self, version: int | None = None) -> dict:
        """{"version": n, ...} with what was stored beside, of the last version or a given one; version -1 at first."""
        numbers = self.versions() if version is None else [version]
        if not numbers:
            return {"version": -1}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/pointer-{numbers[-1]}.json").collect()))

    def read(self, schema: str) -> DataFrame:
        n = self.pointer()["version"]
        return self.spark.createDataFrame([], schema) if n < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/v={n}")

    def write(self, df: DataFrame, **beside: object) -> int:
        """Writes the next snapshot and points to it; ``beside`` holds values such as the cursor (SNK4, SNK5)."""
        n = self.pointer()["version"] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        return self._commit(n, beside)

    def _commit(self, n: int, beside: dict) -> int:
        fs, new = self._files(), self._path(f"_pointer-{n}.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(beside | {"version": n}).encode()))
        out.close()
        if not fs.rename(new, self._path(f"pointer-{n}.json")):
            raise OSError(f"snapshot {n} of {self.path} was written by another run")
        return n
