"""Candidate acquisition over the network (SRC4 to SRC14, SRC16, INC6, INC7): every source through a Spark data source.

Requests are planned on the driver, one partition each; a source that fails as a whole gives no rows and is
marked; a fresh snapshot is filtered again with the current topics instead of asking anew.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import USER_AGENT, Settings, Sources, secret
from ..operators.dedupe import keep_first
from ..operators.fanin import Fetched, all_failed, guarded, union_sources
from ..operators.profile import first_venues
from ..operators.topic import Topics, topic_filter
from ..schema import CANDIDATE_COLUMNS, CANDIDATES
from ..storage import stored
from . import payloads
from .datasource import WorksSource
from .files import Snapshot, candidates_or_stale, is_fresh, profile
from .http import FEED_DELAY_S, FEED_TIMEOUT_S, feed_params, graph_params, registry_params, venue_params

ENTRY = "id STRING, title STRING, summary STRING, author ARRAY<STRUCT<name STRING>>, doi STRING, link STRUCT<_href STRING>, published STRING, primary_category STRUCT<_term STRING>"
ENTRY_FIELDS = re.sub(r"(\w+) (?=[A-Z])", r"\1: ", ENTRY)


@dataclass
class Endpoints:
    """Where the sources are; a source without an address is not asked."""

    graph: str = ""
    registry: str = ""
    feed: str = ""
    bio: str = ""
    med: str = ""
    unified: str = ""

    @classmethod
    def of(cls, s: Sources) -> Endpoints:
        return cls(*(getattr(s, f.name).base_url for f in fields(cls)))


def works(spark: SparkSession, url: str, items: str, requests: list[dict], strict: bool = False, **options: object) -> DataFrame:
    """(json, query, pos) of all requests; written at once, so that a failing source fails here."""
    spark.dataSource.register(WorksSource)
    given = {"url": url, "items": items, "requests": json.dumps(requests), "strict": str(strict).lower(), "headers": json.dumps({"User-Agent": USER_AGENT})}
    return stored(spark.read.format("works").options(**given, **options).load())


def unreachable(e: Exception) -> bool:
    """Whether a source failed on its side: a network error, here or in a task. Other errors are faults of the program and go on."""
    return isinstance(e, OSError) or isinstance(e, (PythonException, Py4JJavaError)) and re.search(r"\b(OSError|URLError|HTTPError|TimeoutError|ConnectionError)\b", str(e)) is not None


def feed(spark: SparkSession, url: str, s: Settings) -> DataFrame:
    """SRC8: one request for all categories, after the delay that the feed asks for; or Atom files, if it is no web address."""
    if not url.startswith("http"):
        return read_feed(spark, url)
    ask = feed_params(" OR ".join(f"cat:{c}" for c in s.sources.feed.categories))
    raw = works(spark, url, "", [ask], strict=True, kind="feed", delay=FEED_DELAY_S, timeout=FEED_TIMEOUT_S)
    x = raw.select(F.from_xml("json", f"entry ARRAY<STRUCT<{ENTRY_FIELDS}>>", {"ignoreNamespace": "true"}).alias("x"))
    each = x.select(F.posexplode("x.entry").alias("pos", "e"))
    return payloads.feed_candidates(
        each.select("e.id", "e.title", "e.summary", "e.author", "e.doi", F.col("e.link._href").alias("link"), "e.published", F.col("e.primary_category._term").alias("category"), F.col("pos").cast("bigint").alias("pos"))
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: entries of Atom files as candidates, in the files' order."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(ENTRY).load(path)
    entries = raw.select("id", "title", "summary", "author", "doi", F.col("link._href").alias("link"), "published", F.col("primary_category._term").alias("category"), F.monotonically_increasing_id().alias("pos"))
    return payloads.feed_candidates(entries)


def graph(spark: SparkSession, url: str, s: Settings, since: str) -> DataFrame:
    """SRC5: one request a query, deduped within the source."""
    asks = [graph_params(q, since, s.sources.graph.mailto) | {"_query": q} for q in s.sources.topic_queries()]
    return keep_first(payloads.graph_candidates(works(spark, url, "results", asks)), "pos")


def registry(spark: SparkSession, url: str, s: Settings, since: str) -> DataFrame:
    """SRC6."""
    asks = [registry_params(q, since, s.sources.registry.mailto) | {"_query": q} for q in s.sources.topic_queries()]
    return keep_first(payloads.registry_candidates(works(spark, url, "message.items", asks)), "pos")


def venues(spark: SparkSession, url: str, s: Settings, since: str, tracked: list[str]) -> DataFrame:
    """SRC7: one request a venue, whose name overwrites the payload's; no dedupe here."""
    asks = [venue_params(v, since, s.sources.registry.mailto) | {"_query": v} for v in tracked]
    return payloads.registry_candidates(works(spark, url, "message.items", asks), venue=F.col("query"))


def preprints(spark: SparkSession, url: str, name: str, since: str, until: str) -> DataFrame:
    """SRC9: the first page of a range of days."""
    return payloads.preprint_candidates(works(spark, f"{url}/{since}/{until}/0", "collection", [{}], strict=True), name)


def tracked_venues(configured: list[str], of_profile: list[str]) -> list[str]:
    """SRC14: configured ones, then the profile's, each once, blanks left out."""
    return list(dict.fromkeys(v.strip() for v in [*configured, *of_profile] if v and v.strip()))


def profile_venues(spark: SparkSession, path: str, n: int = 20) -> list[str]:
    """SRC15: the first n distinct venues of a profile document; none if it is missing or no such document."""
    try:
        return [r.venue for r in first_venues(profile(spark, path), n).collect()]
    except FileNotFoundError:
        return []


def scan(spark: SparkSession, at: Endpoints, s: Settings, now: datetime, profile_venues: list[str]) -> tuple[list[Fetched], DataFrame | None]:
    """SRC10: the enabled sources in their fixed order (or the unified one), then the venue scan; (sources, venue rows)."""
    since = (now - timedelta(days=s.sources.window_days)).strftime("%Y-%m-%d")
    until = now.strftime("%Y-%m-%d")
    if s.sources.unified.enabled and at.unified:
        u, ask = s.sources.unified, {"from": since, "to": until, "sources": ",".join(s.sources.enabled())}
        options = {"kind": "paged", "page_size": u.page_size, "timeout": u.timeout_s, "token": secret(u.api_key_env, u.api_key_value), "key_header": u.api_key_header}
        fetched = [guarded("unified", lambda: payloads.unified_candidates(works(spark, at.unified, "data", [ask], strict=True, **options)), unreachable)]
    else:
        readers = {
            "graph": lambda: graph(spark, at.graph, s, since),
            "registry": lambda: registry(spark, at.registry, s, since),
            "feed": lambda: feed(spark, at.feed, s),
            "bio": lambda: preprints(spark, at.bio, "biorxiv", since, until),
            "med": lambda: preprints(spark, at.med, "medrxiv", since, until),
        }
        fetched = [guarded(n, readers[n], unreachable) for n in s.sources.enabled() if getattr(at, n)]
    extra = None
    if s.sources.registry.enabled and at.registry and (names := tracked_venues(s.sources.tracked_venues, profile_venues)):
        extra = guarded("venues", lambda: venues(spark, at.registry, s, since, names), unreachable).rows  # its failure does not count
    return fetched, extra


def fetch_all(spark: SparkSession, at: Endpoints, s: Settings, snapshot: Snapshot, now: datetime, profile_venues: list[str] | None = None) -> DataFrame:
    """Candidates on topic: from a fresh snapshot, from the sources, or from a stale snapshot if every source failed."""
    topics = Topics.of(s.sources)
    if (old := snapshot.newest()) is not None and is_fresh(old[0], now):
        return topic_filter(old[1], topics)
    fetched, extra = scan(spark, at, s, now, profile_venues or [])
    tables = [f.rows for f in fetched if f.rows is not None] + ([extra] if extra is not None else [])
    rows = topic_filter(union_sources(tables), topics) if tables else spark.createDataFrame([], CANDIDATES)
    return candidates_or_stale(rows.select(*CANDIDATE_COLUMNS, "ordinal"), all_failed(fetched), snapshot, now)
