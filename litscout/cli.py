"""``python -m litscout.cli profile|watch``: the two commands.

A base folder holds ``config/*.yaml``. ``profile`` syncs the library (with ``--full`` from the start), embeds new and changed
rows, and writes the vectors and the profile document. ``watch`` syncs, asks the sources (or takes a fresh snapshot of what they
gave), and runs the steps of ``plans.watch`` up to feed, report and notes. All state is below ``data/``: ``library`` (a base and deltas),
``vectors``, ``profile.json``, ``candidates`` (snapshots) and, if there is one, ``journal_metrics.csv``. Without addresses in the
configuration nothing is asked; Parquet files of candidates in ``data/sources`` (in the order of their names) then take the
sources' place.
"""

from __future__ import annotations

import argparse
import importlib
import logging
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings, load_settings, secret
from .functions.embed import Embedder, HashingEmbedder, embed
from .functions.text import embedding_text
from .operators.profile import summary
from .operators.scoring import rank_order
from .operators.logtable import LogTable
from .plans.watch import Steps, acquire, watch
from .schema import LIBRARY
from .sinks.feed import write_rss
from .sinks.notes import push
from .sinks.report import log_lines, report_name, write_report
from .sources import files
from .sources.fetch import Endpoints, fetch_all, profile_venues
from .sources.http import Client, with_key
from .sources.lookups import resolve, works_by_doi
from .storage import stored
from .streaming import sync
from .shipping import ship

log = logging.getLogger("litscout")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="litscout", description="Literature scouting on Spark")
    parser.add_argument("command", choices=["profile", "watch"])
    parser.add_argument("--base-dir", default=".")
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--full", action="store_true", help="sync the whole library, not only what changed")
    parser.add_argument("--weekly", action="store_true", help="the same as --full")
    parser.add_argument("--rss", action="store_true")
    parser.add_argument("--report", action="store_true")
    parser.add_argument("--top", type=int, default=50, help="rows to keep; 0: all")
    parser.add_argument("--push", action="store_true", help="print the notes that would be pushed; --send posts them")
    parser.add_argument("--send", default="", help="base URL of the library API that notes are posted to")
    parser.add_argument("--embedder", default="", help="module:name of a function or class that makes the embedder; by default hashed words")
    parser.add_argument("--asof", default="", help="ISO time to take as now")
    return parser.parse_args(argv)


def embedder_of(name: str) -> Embedder:
    if not name:
        return HashingEmbedder()
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


class Run:
    """One command's settings, paths and time."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.base = spark, args, Path(args.base_dir)
        self.settings: Settings = load_settings(self.base / "config")
        self.now = datetime.fromisoformat(args.asof).replace(tzinfo=None) if args.asof else datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
        self.asof: Column = F.to_timestamp(F.lit(f"{self.now:%Y-%m-%d %H:%M:%S}"))
        self.embedder = embedder_of(args.embedder)
        self.library = LogTable(spark, self.at("library"), LIBRARY)

    def at(self, name: str) -> str:
        return f"{self.base}/data/{name}"

    def sync(self, full: bool) -> None:
        if self.settings.library.api.base_url:
            counts = sync.library(self.spark, self.settings.library.api, self.library, full, self.asof)
            log.info("library: %d fetched, %d updated, %d removed", counts.fetched, counts.updated, counts.removed)

    def profile(self) -> None:
        self.sync(self.args.full or self.args.weekly)
        log.info("embedded %d rows", sync.embed_changed(self.library, self.embedder))
        rows = self.library.read()
        if not rows.limit(1).count():
            raise RuntimeError("the library is empty")
        files.write_index(rows, self.at("vectors"))
        ordered = rows.withColumn("ordinal", F.struct("updated_at", "key"))
        files.write_profile(summary(ordered, self.embedder.name, F.lit(f"{self.now.isoformat()}+00:00")), self.at("profile.json"))

    def candidates(self) -> DataFrame:
        at = Endpoints.of(self.settings.sources)
        if any(vars(at).values()):
            snapshot = files.Snapshot(self.spark, self.at("candidates"))
            return fetch_all(self.spark, at, self.settings, snapshot, self.now, profile_venues(self.spark, self.at("profile.json")))
        tables = [self.spark.read.parquet(str(f)) for f in sorted((self.base / "data" / "sources").glob("*.parquet"))]
        if not tables:
            raise RuntimeError("no source has an address and there are no files of candidates")
        return acquire(tables, self.settings)

    def lookups(self, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For the top rows alone; without an address of works nothing is asked."""
        graph, dois = self.settings.sources.graph, ranked.select("doi").where("doi <> ''")
        if not graph.base_url:
            none = self.spark.createDataFrame([], "doi string, abstract string, landing_page string")
            return none, self.spark.createDataFrame([], "doi string, resolved_url string")
        return stored(works_by_doi(dois, graph.base_url, graph.mailto)), stored(resolve(dois))

    def watch(self) -> None:
        self.sync(False)
        profile = files.profile(self.spark, self.at("profile.json"))  # there must be one
        log.info("profile of %s items", profile.first().item_count)
        index = files.index(self.spark, self.at("vectors"))
        library = self.library.read().drop("embedding").join(index, "key", "left")
        rows = stored(self.candidates())
        text = embedding_text(F.col("title"), F.col("abstract"), F.col("authors"))
        vectors = stored(embed(rows.select("ordinal", text.alias("text")), self.embedder).select("ordinal", "embedding"))
        metrics = files.journal_metrics(self.spark, self.at("journal_metrics.csv"))
        steps = Steps()
        ranked = stored(watch(rows, library, vectors, metrics, self.settings, self.asof, self.args.top, self.lookups, steps))
        for name, n in steps.removed().items():
            log.info("%s removed %d rows", name, n)
        self.publish(ranked)

    def publish(self, ranked: DataFrame) -> None:
        empty = not ranked.limit(1).count()
        for line in log_lines(ranked, rank_order()):
            log.info(line)
        out = (self.base / "reports").resolve()
        out.mkdir(parents=True, exist_ok=True)
        if self.args.rss:
            write_rss(ranked, rank_order(), self.asof, str(out / "feed.xml"))
        if self.args.report:
            name = "report-empty.html" if empty else self.spark.range(1).select(report_name(self.asof).alias("n")).first().n
            write_report(ranked, rank_order(), f"{self.now:%Y-%m-%d %H:%M:%S}", str(out / name))
        if self.args.push and not empty:
            send, api = self.args.send, self.settings.library.api
            key = secret(api.api_key_env) if send else ""
            if send and not key:
                raise RuntimeError(f"environment variable {api.api_key_env} is not set")
            client = Client(with_key(api.all_headers() | {"Content-Type": "application/json"}, key))
            print(push(ranked, rank_order(), client, send, dry_run=not send))


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    ship(spark)
    run = Run(spark, args)
    run.profile() if args.command == "profile" else run.watch()


if __name__ == "__main__":
    main()
