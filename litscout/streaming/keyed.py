"""The library as keyed state of a stream (SNK1, SNK2, INC3, INC8).

Each key's newest version lives in Spark's state store, with the hash of its content and whether it was deleted. A change that is older than
the state, or brings nothing new, is dropped there; what is left goes to the merge-on-read table, which therefore reads nothing to
apply a batch. A deletion leaves a tombstone, so that an older version that comes late does not bring the row back; a timer removes it after a time.

State is partitioned by key and recovered from the checkpoint. A batch that is replayed after its table was written is recognised by its number in the table's pointer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.logtable import LogTable
from ..sources.payloads import library_items
from .sync import state_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "key string, version bigint, deleted boolean, json string, pos bigint"
DAY_MS = 86_400_000


class Newest(StatefulProcessor):
    """Lets through the newest change of each key, if it is newer than the state or of its version and different."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "version bigint, content bigint, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            top = part.sort_values(["version", "deleted", "pos"]).iloc[-1]
            if best is None or (top["version"], top["deleted"], top["pos"]) > (best["version"], best["deleted"], best["pos"]):
                best = top
        held = self.newest.get() if self.newest.exists() else None
        now = (int(best["version"]), int(best["content"]), bool(best["deleted"]))
        if held is not None and (now[0] < held[0] or now == tuple(held) or (now[0] == held[0] and held[2])):
            return
        self.newest.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[2]:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield pd.DataFrame({"key": [key[0]], "version": [now[0]], "deleted": [now[2]], "json": [best["json"]], "pos": [best["pos"]]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and self.newest.get()[2]:
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_changes(changes: DataFrame, keep_ms: int = 30 * DAY_MS) -> DataFrame:
    """Of a stream of changes (key, version, deleted, json, pos), those that change the state. Tombstones are kept ``keep_ms``. Changes without a key are dropped."""
    rows = changes.where("key IS NOT NULL").select("key", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "json", F.col("pos").cast("bigint").alias("pos"))
    rows = rows.withColumn("content", F.xxhash64("json"))
    return rows.groupBy("key").transformWithStateInPandas(Newest(keep_ms), CHANGE, outputMode="Update", timeMode="ProcessingTime")


def item_changes(raw: DataFrame) -> DataFrame:
    """Changes of raw items (json, pos); an item whose ``deleted`` is true deletes its key."""
    items = library_items(raw)
    deleted = F.coalesce(F.get_json_object("raw", "$.deleted") == "true", F.lit(False))
    return items.select("key", "version", deleted.alias("deleted"), F.col("raw").alias("json"), F.col("ordinal").alias("pos"))


def start(changes: DataFrame, table: LogTable, checkpoint: str, asof: Column, keep_ms: int = 30 * DAY_MS) -> StreamingQuery:
    """Keeps ``table`` up to date with a stream of changes until it has read what there is."""
    spark = changes.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        if table.pointer().get("batch", -1) >= number:
            return  # written before the run died
        df = df.persist()  # read twice; recomputed from the state if an executor is lost
        rows = state_rows(library_items(df.where("NOT deleted").select("json", "pos")), asof)
        table.append(rows, df.where("deleted").select("key"), batch=number)
        df.unpersist()

    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # a query takes the setting of its start
    try:
        stream = newest_changes(changes, keep_ms).writeStream.foreachBatch(batch).outputMode("update")
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)
