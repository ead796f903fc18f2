"""Registered queries of sources, flatteners, state and control flow, on payloads made from the driver's tables.

Files that a query reads are written to the shared folder first. The web clients' tests are in ``tests/test_web.py``.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LibraryApi, Scoring, Settings, Sources, Weights, build
from ..functions import dates, fuzzy, text
from ..functions.embed import HashingEmbedder
from ..operators import dedupe, profile, scoring, state, topic
from ..operators.logtable import LogTable
from ..schema import CANDIDATE_COLUMNS, CANDIDATES, LIBRARY
from ..sinks import report
from ..sources import fetch, files, payloads
from ..sources.datasource import LibrarySource
from ..storage import shared_dir, stored
from ..streaming import keyed, sync
from . import watch as plan
from .queries import ASOF, CANDIDATE, LIBRARY as IN_LIBRARY, asof, candidates, documents, t, words_at

NOW = datetime(2024, 1, 31)


def joined(c) -> F.Column:
    return F.array_join(c, "|")


def as_json(df: DataFrame, pos: str, **fields) -> DataFrame:
    """(json, pos) of rows with the given fields."""
    return df.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("json"), F.col(pos).cast("bigint").alias("pos"))


def when_id(n: int, k: int, then, otherwise=None, col: str = "doc_id"):
    c = F.when(F.col(col) % n == k, then)
    return c if otherwise is None else c.otherwise(otherwise)


# flatteners


def library_json(x: DataFrame) -> DataFrame:
    data = F.struct(
        when_id(4, 0, F.lit(""), F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("key"), when_id(2, 1, F.col("doc_id"), F.lit(0)).alias("version"), when_id(5, 1, F.col("source")).alias("title"),
        F.col("lang").alias("abstractNote"), F.array(F.struct(F.col("lang").alias("firstName"), F.col("source").alias("lastName")), F.struct(F.lit(None).cast("string").alias("firstName"), F.lit("").alias("lastName"))).alias("creators"),
        F.array(F.struct(F.col("lang").alias("tag"))).alias("tags"), F.array("source").alias("collections"), when_id(3, 0, F.lit("ca-2020-05"), F.lit("x-y")).alias("date"), F.col("source").alias("publicationTitle"),
    )
    return as_json(x, "doc_id", key=F.concat(F.lit("o"), F.col("doc_id").cast("string")), version=F.col("doc_id") % 3, data=data)


def q_library_items(s, d):
    """PRJ1, S7, S8."""
    x = payloads.library_items(library_json(t(s, d, "documents")))
    return x.select("ordinal", "key", "version", "title", "abstract", joined("creators").alias("creators"), joined("tags").alias("tags"), "year", joined("collections").alias("collections"))


def q_unified_candidates(s, d):
    """PRJ2, FLT6, S11: authors as list or string, dates as numbers or ISO, blank titles go."""
    x = t(s, d, "events")
    each = as_json(
        x, "event_id", id=F.col("event_id").cast("string"), title=when_id(7, 0, F.lit(" \t"), F.concat(F.lit(" "), "event_type"), "event_id"),
        authors=when_id(2, 0, F.lit('["A"," ","B "]'), F.lit("Solo"), "event_id"), published_at=when_id(3, 0, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "event_id"),
        metrics=F.create_map(F.lit("cited_by"), F.col("user_id").cast("string"), F.lit("bad"), F.lit("n/a")), source_identifier=when_id(5, 0, F.concat(F.lit("s"), F.col("user_id").cast("string")), None, "event_id"), candidate_type=F.col("event_type"),
    )
    each = each.withColumn("json", F.regexp_replace("json", r'"authors":"(\[[^\]]*\])"', '"authors":$1')).withColumn("json", F.regexp_replace("json", r'\\"', '"'))
    out = payloads.unified_candidates(each)
    return out.select(F.col("pos").alias("event_id"), "source", "identifier", "title", joined("authors").alias("authors"), dates.iso_utc(F.col("published")).alias("published"), F.to_json("metrics").alias("metrics"), F.element_at("extra", "candidate_type").alias("kind"))


def graph_json(x: DataFrame) -> DataFrame:
    own = when_id(3, 0, F.to_json(F.struct(F.col("lang").alias("text")))).otherwise(when_id(3, 1, F.concat(F.lit(" "), F.col("lang"))))
    index = when_id(3, 2, F.map_from_arrays(F.array("source", "lang"), F.array(F.array(F.lit(3)), F.array(F.lit(0), F.lit(5)))))
    place = F.struct(F.lit("http://l").alias("landing_page_url"), F.struct(when_id(2, 0, F.lit("http://v")).alias("url"), F.col("source").alias("display_name")).alias("source"))
    out = as_json(
        x, "doc_id", id=when_id(4, 1, F.concat(F.lit("W"), F.col("doc_id").cast("string"))), ids=F.struct(when_id(4, 2, F.lit("ids")).alias("openalex")), doi=when_id(4, 3, F.lit("10.1")), display_name=F.concat("source", F.lit(" ")), abstract=own,
        abstract_inverted_index=index, authorships=F.array(F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))), primary_location=place, publication_date=F.lit("2024-01-02"), cited_by_count=F.col("n_chars"),
        concepts=F.array(F.struct(F.col("lang").alias("display_name"))),
    )
    return out.withColumn("query", F.lit("q"))


def q_graph_candidates(s, d):
    """PRJ3, S5, S6: the abstract as an object, as a string, as an inverted index with gaps."""
    out = payloads.graph_candidates(graph_json(t(s, d, "documents")))
    return out.select(F.col("pos").alias("doc_id"), "source", "identifier", "title", "abstract", joined("authors").alias("authors"), "url", "venue", F.element_at("metrics", "cited_by").alias("cited"), F.element_at("extra", "concepts").alias("concepts"))


def q_registry_candidates(s, d):
    """PRJ4, SRC7, S4: the queried venue overwrites the payload's; markup and references in abstracts."""
    x = t(s, d, "documents")
    raw = as_json(
        x, "doc_id", title=when_id(9, 0, F.array().cast("array<string>"), F.array("source", F.lit("second"))), DOI=when_id(3, 1, F.concat(F.lit("10.2/"), F.col("doc_id").cast("string"))), URL=when_id(3, 2, F.lit("http://u")),
        author=F.array(F.struct(F.lit("G").alias("given"), F.col("lang").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"))),
        abstract=F.concat(F.lit("<jats:p>a &amp; b</jats:p> "), "lang"), created=F.struct(F.lit("2024-01-02T03:04:05Z").alias("date-time")), type=F.lit("journal-article"), **{"container-title": F.array("source"), "is-referenced-by-count": F.col("n_chars")},
    ).withColumn("query", F.lit("Queried"))
    out = payloads.registry_candidates(raw).select("pos", "identifier", "title", "abstract", joined("authors").alias("authors"), dates.iso_utc(F.col("published")).alias("published"), "venue", F.element_at("metrics", "is-referenced-by").alias("cited"))
    over = payloads.registry_candidates(raw, venue=F.col("query")).select("pos", F.col("venue").alias("queried"))
    return out.join(over, "pos").withColumnRenamed("pos", "doc_id")


def q_preprint_candidates(s, d):
    """PRJ6, SRC9."""
    x = t(s, d, "documents")
    raw = as_json(x, "doc_id", title=F.col("source"), doi=when_id(2, 0, F.concat(F.lit("10.3/"), F.col("doc_id").cast("string")), F.lit("")), biorxiv_id=F.lit("bx"), authors=F.concat("lang", F.lit("; B;; ")), date=F.lit("2024-2-3"), url=when_id(3, 0, F.lit("http://own")), category=F.col("lang"))
    out = payloads.preprint_candidates(raw, "biorxiv")
    return out.select(F.col("pos").alias("doc_id"), "identifier", "doi", joined("authors").alias("authors"), "url", dates.iso_utc(F.col("published")).alias("published"), F.element_at("extra", "category").alias("category"))


def q_feed_candidates(s, d):
    """SRC8, PRJ5: Atom files."""
    x = t(s, d, "benchmark").join(F.broadcast(t(s, d, "region")), F.col("item_id") % 5 == F.col("r_regionkey"))
    entry = F.format_string(
        '<entry><id>http://a/%d</id><title> %s %d </title><summary>s%d</summary><author><name>%s</name></author><author><name>N2</name></author><link href="http://l/%d"/><published>2024-01-%02dT00:00:00Z</published><primary_category term="c%d"/></entry>',
        "item_id", "r_name", "item_id", "item_id", "r_name", "item_id", F.col("item_id") % 28 + 1, F.col("item_id") % 3,
    )
    path = shared_dir(s)
    page = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>"))  # one page of a feed
    x.agg(page.alias("value")).write.text(path)
    out = fetch.read_feed(s, path)
    return out.select("source", "identifier", "title", "abstract", joined("authors").alias("authors"), "url", dates.iso_utc(F.col("published")).alias("published"), "venue", F.element_at("extra", "primary_category").alias("category"))


def q_candidate_json(s, d):
    """PRJ8: to JSON lines and back."""
    from ..operators.fanin import union_sources

    rows = [c.withColumn("published", F.to_timestamp(F.lit("2024-01-02 03:04:05"))) for c in candidates(s, d)]
    back = payloads.from_json(payloads.to_json(union_sources(rows)))
    return back.select("source", "ordinal", "identifier", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), dates.iso_utc(F.col("published")).alias("published"), F.size("authors").cast("bigint").alias("authors"))


def q_stored_items(s, d):
    """PRJ7."""
    x = t(s, d, "documents").select("doc_id", when_id(3, 0, F.to_json(F.array("lang", "source"))).alias("creators"), F.lit("[]").alias("tags"), F.lit(None).cast("string").alias("collections"))
    out = payloads.stored_items(x)
    return out.select("doc_id", joined("creators").alias("creators"), (F.size("tags") + F.size("collections")).cast("bigint").alias("empty"))


def q_inverted_gaps(s, d):
    """S5, AGG9: all words of a text at positions with gaps; of two words on a slot, here the first, the later entry wins."""
    last = F.map_from_arrays(F.array(F.lit("\x02last")), F.array(F.array(F.lit(0))))
    index = words_at(s, d, lambda i: i * 3).select("doc_id", F.map_concat(text.inverted_index(F.col("words")), last).alias("index"))
    return index.select("doc_id", F.md5(text.inverted_index_text(F.col("index"))).alias("digest"))


def q_iso_parse(s, d):
    """S13."""
    x = t(s, d, "events").select("event_id", when_id(4, 0, F.lit(None).cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+02:00"), "event_id").alias("c"))
    return x.select("event_id", dates.iso_utc(dates.iso_instant(F.col("c"))).alias("at"))


# settings, topics, scores


def q_topic_settings(s, d):
    """FLT4, SRC13, SRC23: terms from settings, blank ones and empty groups left out, variables put in."""
    from ..config import expand

    os.environ["LITSCOUT_TERM"] = "Tion"
    given = {"exclude_keywords": ["OUEN THE", " "], "required_keyword_groups": [["never used"]], "required_any_group_sets": [[["The ", "$LITSCOUT_TERM"], [" "]], [[""]], []], "queries": [" ", ""], "unknown": 1}
    made = build(Sources, expand(given))
    x = documents(s, d).where(topic.on_topic(text.haystack(F.col("title"), F.col("abstract"), F.col("venue")), topic.Topics.of(made)))
    return x.select(F.col("ordinal").alias("doc_id"), F.lit(made.topic_queries()[0]).alias("query"))


def q_topics_empty(s, d):
    """FLT5: without terms the filter is the dedupe."""
    x = documents(s, d).withColumn("doi", F.lit("")).withColumn("identifier", F.col("venue"))
    return topic.topic_filter(x, topic.Topics.of(Sources(exclude_keywords=[" "]))).select("ordinal", F.col("venue").alias("source"))


def to_score(s, d):
    """Candidates with dates and metrics from events: documents whose id is an event's."""
    x = t(s, d, "documents").join(t(s, d, "events"), F.col("event_id") == F.col("doc_id"))
    metrics = when_id(3, 0, F.create_map(F.lit("cited_by"), F.col("value")), F.create_map(F.lit("is-referenced-by"), F.lit(0.0), F.lit("altmetric"), F.col("value")))
    return x.select(
        F.col("doc_id").alias("ordinal"), F.col("source"), F.col("doc_id").cast("string").alias("identifier"), F.lit("").alias("title"), F.col("text").alias("abstract"), F.array("lang").alias("authors"), F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("string").alias("url"), when_id(11, 0, F.lit(None).cast("timestamp"), F.col("ts").cast("timestamp")).alias("published"), F.col("source").alias("venue"), metrics.alias("metrics"), F.create_map().cast("map<string,string>").alias("extra"),
    )


SCORING = Scoring(Weights(0.62, 0.1, 0.1, 0.03, 0.05, 0.02, 0.1), decay_days={"fast": 3, "medium": 7, "slow": 30}, whitelist_authors=["DE"], whitelist_venues=["SRC3", " src4"])


def journals(s):
    return s.createDataFrame([("src1", 9.0), ("src2", 0.5), ("src12", 30.0)], "title_key string, sjr double")


def q_score(s, d):
    """PRJ11, JN7, JN8, S15 to S20."""
    sim = t(s, d, "embeddings").select(F.col("vec_id").alias("ordinal"), (F.col("label") / 10).alias("similarity"))
    out = scoring.score(to_score(s, d), sim, journals(s), SCORING, asof())
    numbers = ["similarity", "recency_score", "metric_score", "author_bonus", "venue_bonus", "journal_quality", "journal_sjr"]
    return out.select("ordinal", F.round("score", 8).alias("score"), *[F.round(c, 8).alias(c) for c in numbers], F.when(F.abs(F.col("score") - 0.5) > 1e-9, F.col("label")).alias("label"))


def q_token_set_ratio(s, d):
    """Page titles against the benchmark's first words and each other's neighbours."""
    x = t(s, d, "pages").select("page_id", text.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"))
    pairs = x.join(x.select((F.col("page_id") - 1).alias("page_id"), F.col("t").alias("u")), "page_id")
    return pairs.select("page_id", F.round(fuzzy.title_score("t", "u"), 6).alias("score"))


# files and state


def q_journal_csv(s, d):
    """SRC20: blank titles and values that are no numbers go, of equal keys the last line stays."""
    path = shared_dir(s)
    x = t(s, d, "part").select(F.concat(F.lit(" "), F.upper("p_brand")).alias("title"), when_id(7, 0, F.lit("n/a"), F.col("p_partkey").cast("string"), "p_partkey").alias("sjr"), "p_partkey")
    x.coalesce(1).sortWithinPartitions("p_partkey").select("title", "sjr").write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.journal_metrics(s, path)


def q_profile_document(s, d):
    """SNK8, SRC15, SRC21, S25, LIM3: written, read, the first distinct venues."""
    path = shared_dir(s)
    raw = F.to_json(F.struct(F.struct(F.concat("source", F.lit(" ")).alias("publicationTitle")).alias("data")))
    lib = t(s, d, "documents").select(F.col("doc_id").alias("ordinal"), F.array("lang").alias("creators"), raw.alias("raw"), F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))
    files.write_profile(profile.summary(lib, "given", F.lit("2024")), path)
    names = fetch.profile_venues(s, path, 5) + [f"missing {n}" for n in fetch.profile_venues(s, path + "-none")]
    doc = files.profile(s, path).select("item_count", "model", F.round(F.col("centroid")[0], 6).alias("x"))
    return doc.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("pos", "venue")).select("item_count", "model", "x", F.col("pos").cast("bigint").alias("pos"), "venue")


def q_vector_index(s, d):
    """SNK7, SRC22."""
    path = shared_dir(s)
    x = t(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), when_id(3, 0, F.col("embedding"), None, "vec_id").alias("embedding"))
    files.write_index(x.limit(0), path)
    files.write_index(x, path)
    return files.index(s, path).select(F.col("key").cast("bigint").alias("vec_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


def q_candidate_snapshot(s, d):
    """SRC16, SNK9, FLT10, INC6, INC7, AGG10: fresh, stale, and what all sources failing does."""
    from ..operators.fanin import union_sources

    snap = files.Snapshot(s, shared_dir(s))
    rows = union_sources(candidates(s, d))
    none = s.createDataFrame([], CANDIDATES)
    snap.write(rows.where("source <> 'graph'"), NOW - timedelta(days=2))
    late = files.candidates_or_stale(none, True, snap, NOW)  # every source failed: the old rows stay
    snap.write(rows, NOW - timedelta(hours=12))
    at, fresh = snap.newest()
    out = late.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("stale"))
    new = fresh.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("fresh" if files.is_fresh(at, NOW) else "old"))
    return out.union(new)


def changes_json(x: DataFrame) -> DataFrame:
    data = F.struct(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("title"))
    return as_json(x, "event_id", key=F.col("user_id").cast("string"), version=F.col("event_id"), data=data)


def two_batches(s, d) -> tuple[DataFrame, DataFrame]:
    """The log up to a day, and the rest without the users that it deletes: those whose last event is an error."""
    x = t(s, d, "events")
    old = F.col("ts") < F.lit("2024-01-28").cast("timestamp_ntz")
    return x.where(old), x.where(~old)


def q_library_sync(s, d):
    """INC2 to INC5, INC8, SNK1 to SNK6, SRC17, AGG7: two batches, vectors for new and changed rows in between."""
    snaps = LogTable(s, shared_dir(s), LIBRARY)
    before, after = two_batches(s, d)
    asked = []

    def deleted(since: int) -> list[str]:
        asked.append(since)
        last = after.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("e")).where("e = 'error'")
        return [str(r.user_id) for r in last.collect()] if since else []

    at = F.to_timestamp(F.lit(ASOF))
    first = sync.merge(s, changes_json(before), snaps, deleted, asof=at)
    sync.embed_changed(snaps, HashingEmbedder(8))
    counts = sync.merge(s, changes_json(after), snaps, deleted, asof=at)
    out = snaps.read()
    extra = [F.lit(x).cast("bigint").alias(n) for n, x in (("cursor", snaps.pointer()["cursor"]), ("asked_since", asked[1]), ("fetched", first.fetched + counts.fetched))]
    return out.select(F.col("key").cast("bigint").alias("user_id"), "version", "title", F.col("embedding").isNull().alias("stale"), *extra)


def q_full_sync(s, d):
    """INC2: a full sync drops what is gone and asks for no deletions."""
    snaps = LogTable(s, shared_dir(s), LIBRARY)
    before, after = two_batches(s, d)
    sync.merge(s, changes_json(before), snaps)
    counts = sync.merge(s, changes_json(after), snaps, lambda since: 1 // 0, full=True)
    return snaps.read().select(F.col("key").cast("bigint").alias("user_id"), "version", F.lit(counts.removed).cast("bigint").alias("removed"))


def q_stream_sync(s, d):
    """INC1, INC3: a stream of files, merged batch by batch."""
    folder, snaps = shared_dir(s), LogTable(s, shared_dir(s), LIBRARY)
    for part in two_batches(s, d):
        changes_json(part).select("json").coalesce(1).write.mode("append").text(folder)
    raw = s.readStream.option("maxFilesPerTrigger", 1).text(folder).select(F.col("value").alias("json"), F.lit(0).cast("bigint").alias("pos"))
    sync.start(s, raw, snaps, shared_dir(s)).awaitTermination()
    return snaps.read().select(F.col("key").cast("bigint").alias("user_id"), "version", "title")


def exports(s, d, folder: str):
    """The log as a library's exports, newest versions last; an error deletes its user's row. Each export is a folder of several files."""
    for n, part in enumerate(two_batches(s, d)):
        user = F.col("user_id").cast("string")
        data = F.struct(user.alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("title"))
        part.select(F.to_json(F.struct(user.alias("key"), data.alias("data"), (F.col("event_type") == "error").alias("deleted")))).repartition(4).write.text(f"{folder}/export-{n}")
        yield n


def q_page_stream(s, d):
    """INC1: pages planned on the driver and read by executors; the stream is stopped after one export and goes on with the next from its checkpoint."""
    s.dataSource.register(LibrarySource)
    folder, out, check = shared_dir(s), shared_dir(s), shared_dir(s)
    for _ in exports(s, d, folder):
        pages = s.readStream.format("library").option("folder", folder).load()
        seen = pages.select(F.get_json_object("json", "$.data.version").cast("bigint").alias("event_id"), F.get_json_object("json", "$.data.title").alias("title"), "pos")
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    read = s.read.schema("event_id bigint, title string, pos bigint").parquet(out)
    return read.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("places"), F.sum("event_id").alias("ids"), F.count_distinct(F.shiftright("pos", 32)).alias("pages"))


def q_keyed_stream(s, d):
    """SNK1, SNK2, INC3, INC8: newest versions and tombstones as keyed state, restarted in mid-stream, into the merge-on-read table."""
    s.dataSource.register(LibrarySource)
    folder, check, table = shared_dir(s), shared_dir(s), LogTable(s, shared_dir(s), LIBRARY)
    for _ in exports(s, d, folder):
        raw = s.readStream.format("library").option("folder", folder).load()
        keyed.start(keyed.item_changes(raw), table, check, asof()).awaitTermination()
    return table.read().select(F.col("key").cast("bigint").alias("user_id"), "version", "title")


def q_state_log(s, d):
    """SNK1, SNK2: ten batches of the log into a merge-on-read table, which compacts itself on the way."""
    table = LogTable(s, shared_dir(s), "key string, version bigint, title string", bucket_rows=40, most_deltas=3)
    x = t(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("title"), F.pmod("event_id", F.lit(10)).alias("batch"))
    for b in range(10):
        last = stored(state.latest(x.where(F.col("batch") == b)))  # read several times
        new = state.upserts(table.read(of=last), last.drop("batch"))
        table.append(new.where("title <> 'error'"), last.where("title = 'error'").select("key"))
    return table.read().select(F.col("key").cast("bigint").alias("user_id"), "version", "title")


def q_report_document(s, d):
    """SNK11, WIN4 without a limit: the report of all documents as tasks wrote and the commit joined it; rank and title of its entries."""
    score = F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 10
    x = t(s, d, "documents").select(
        F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("title"), F.lit("").alias("url"), score.alias("score"), F.lit(0.5).alias("similarity"), F.lit("consider").alias("label"),
        F.lit(None).cast("timestamp").alias("published"), F.col("source").alias("venue"), F.lit(None).cast("string").alias("abstract"), F.array("lang").alias("authors"),
    )
    path = shared_dir(s)
    report.write_report(x, scoring.rank_order(), "now", path)
    lines = s.read.text(path).where(F.col("value").startswith("<section>"))
    pick = lambda k, kind: F.regexp_extract("value", r'<h2>(\d+)\. <a href="#">(\d+)</a>', k).cast(kind)
    return lines.select(pick(1, "bigint").alias("rank"), pick(2, "bigint").alias("doc_id"))


# the whole


def q_watch_flagship(s, d):
    """Every step of ``plans.watch``, from the fan-in over topics, dedupe, similarity, scores, window and cap to the top 20 with lookups."""
    docs = t(s, d, "documents")
    events = t(s, d, "events")
    x = docs.join(events, F.col("event_id") == F.pmod(20 * F.col("doc_id"), F.lit(events.count())))
    mine = x.where(CANDIDATE).select(
        F.when(F.col("source") == "src3", "arXiv").otherwise(F.col("source")).alias("source"), F.md5("text").alias("identifier"), F.lit("").alias("title"), F.col("text").alias("abstract"), F.array("lang").alias("authors"),
        F.concat(F.lit("10.1/"), F.md5("text")).alias("doi"), when_id(2, 0, F.lit("https://doi.org/10.1/x")).alias("url"), F.col("ts").cast("timestamp").alias("published"), F.col("source").alias("venue"), F.create_map(F.lit("cited_by"), "value").alias("metrics"),
        F.create_map().cast("map<string,string>").alias("extra"), F.col("doc_id").alias("pos"),
    )
    rows = docs.where(IN_LIBRARY).join(t(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    library = rows.select(F.col("doc_id").cast("string").alias("key"), F.lit("").alias("title"), F.concat(F.lit("10.1/"), F.md5("text")).alias("doi"), F.lit("").alias("url"), "embedding")
    made = Settings(scoring=SCORING, sources=Sources(window_days=25, exclude_keywords=["Casino"], required_any_group_sets=[[["the ", "de "], ["tion", "ment"]], [["die"]]]))
    vectors = t(s, d, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")
    steps = plan.Steps()

    def found(top: DataFrame) -> tuple[DataFrame, DataFrame]:
        works = top.where("ordinal % 2 = 0").select("doi", F.lit("unused").alias("abstract"), F.lit("http://page.example").alias("landing_page"))
        return works, top.select("doi", F.concat(F.lit("http://resolved.example/"), "venue").alias("resolved_url"))

    # one source only, so ordinals are document ids; a source is deduped before the filter
    top = plan.watch(plan.acquire([mine], made), library, vectors, journals(s), made, asof(), 20, found, steps)
    ranked = report.numbered(top, [F.desc("score"), F.asc("ordinal")])
    return ranked.select(F.col("rank").cast("bigint").alias("rank"), F.col("ordinal").alias("doc_id"), F.round("similarity", 4).alias("similarity"), F.round("score", 6).alias("score"), F.when(F.abs(F.col("score") - 0.5) > 1e-6, F.col("label")).alias("label"), "url")


def q_step_counts(s, d):
    """AGG8: what each step of a watch removed, observed on the way."""
    from ..operators.cap import cap_share

    steps = plan.Steps()
    x = steps.passed("all", to_score(s, d))
    x = steps.passed("recency", x.where(dates.is_recent(F.col("published"), asof("2024-01-20 00:00:00"), 10)))
    x = x.withColumn("score", F.col("ordinal").cast("double"))
    steps.passed("preprints", cap_share(x, scoring.rank_order(), names=("src3", "src4", "src5", "src6", "src7", "src8"))).write.format("noop").mode("overwrite").save()
    return s.createDataFrame(list(steps.removed().items()), "step string, removed bigint")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
