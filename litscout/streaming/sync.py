"""Incremental library sync (INC1 to INC5, AGG7).

A stream of raw items (from files or from the ``library`` data source) is flattened and merged batch by batch into
a table of base and deltas. The cursor is stored with the state it belongs to, in one pointer,
so it moves only after a whole batch; a batch that is replayed leaves the same state. Deletions are
asked for since the cursor *before* the batch, so none between two cursors is missed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import LibraryApi, secret
from ..functions.embed import Embedder, embed
from ..functions.text import embedding_text
from ..operators.logtable import LogTable
from ..operators.state import latest, set_embeddings, upserts, with_hash
from ..schema import LIBRARY
from ..sources.datasource import LibrarySource
from ..sources.http import Client, deleted_keys, with_key
from ..sources.payloads import library_items
from ..storage import discard, stored


@dataclass
class Counts:
    """AGG7."""

    fetched: int = 0
    updated: int = 0
    removed: int = 0


def state_rows(items: DataFrame, asof: Column) -> DataFrame:
    """Flattened items as rows of the state table."""
    rows = with_hash(items).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("updated_at", asof)
    names = [c.split()[0] for c in LIBRARY.split(", ")]
    return rows.select(*names)


def merge(
    spark: SparkSession, raw: DataFrame, table: LogTable, deleted: Callable[[int], list[str]] | None = None, full: bool = False, asof: Column | None = None
) -> Counts:
    """One batch of raw items (json, pos) into the library. ``full``: the items are the whole library, and no deletions are asked for (INC2).

    Only the state's rows of the batch's keys are read, and only the batch is written; a full one reads the other keys too. Fetched and updated rows are observed while they pass.
    """
    asof = F.lit(datetime.now(timezone.utc)) if asof is None else asof
    since = int(table.pointer().get("cursor", 0))
    fetched, updated = Observation(), Observation()
    items = library_items(raw.observe(fetched, F.count(F.lit(1)).alias("n")))
    new = latest(state_rows(items, asof).where("key IS NOT NULL")).observe(updated, F.count(F.lit(1)).alias("n"), F.max("version").alias("top"))
    new = stored(new)
    if not fetched.get["n"] and not full:
        discard(new)
        return Counts()
    gone = keys = None
    if full:
        gone = keys = stored(table.read().select("key").join(new.select("key"), "key", "left_anti"))
    elif deleted is not None:
        keys = spark.createDataFrame([(k,) for k in deleted(since)], "key string")
        gone = stored(table.read(of=keys).select("key"))
    removed = gone.count() if gone is not None else 0
    table.append(upserts(table.read(of=new), new), keys, cursor=max(since, int(updated.get["top"] or 0)))
    discard(new, *([gone] if gone is not None else []))
    return Counts(fetched.get["n"], updated.get["n"], removed)


def library(spark: SparkSession, api: LibraryApi, table: LogTable, full: bool = False, asof: Column | None = None) -> Counts:
    """INC1, INC2: one sync of the library interface: all items if its version is not the cursor's any more, or if ``full``."""
    spark.dataSource.register(LibrarySource)
    headers, url, since = api.all_headers(), api.address(), int(table.pointer().get("cursor", 0))
    given = {"url": url, "page_size": api.page_size, "delay": api.polite_delay_ms / 1000, "token": secret(api.api_key_env), "headers": json.dumps(headers)}
    if since and not full:
        given["since"] = since
    raw = stored(spark.read.format("library").options(**given).load())
    client = Client(with_key(headers, secret(api.api_key_env)))
    return merge(spark, raw, table, lambda version: deleted_keys(client, url, version), full, asof)


def embed_changed(table: LogTable, embedder: Embedder) -> int:
    """INC8, SNK3: vectors for the rows that have none, that is new ones and those whose content changed; how many there were. Only these rows are written."""
    made = Observation()
    todo = stored(table.read().where("embedding IS NULL"))
    texts = todo.select("key", embedding_text(F.col("title"), F.col("abstract"), F.col("creators"), F.col("tags")).alias("text"))
    vectors = stored(embed(texts.observe(made, F.count(F.lit(1)).alias("n")), embedder).select("key", "embedding"))
    if made.get["n"]:
        table.append(set_embeddings(todo, vectors))
    discard(vectors, todo)
    return made.get["n"]


def start(spark: SparkSession, raw: DataFrame, table: LogTable, checkpoint: str, deleted: Callable[[int], list[str]] | None = None) -> StreamingQuery:
    """Keeps the library up to date with a stream of raw items (json, pos) until it has read what there is."""

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()  # read several times; recomputed if an executor is lost
        merge(df.sparkSession, df, table, deleted)
        df.unpersist()

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
