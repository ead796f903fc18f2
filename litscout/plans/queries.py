"""The registered queries: every operator on the driver's tables, over whole tables.

Roles: documents of the sources below ``src2`` in code-point order are the library, the others candidates;
pages and benchmark are further sources; events is a change log and the source of dates and metrics;
embeddings holds vectors, those of labels below 5 a library's.
Each entry of ``ALL`` is (query, SQL or None), the SQL for DuckDB on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scores, text
from ..operators import cap, cells, dedupe, enrich, fanin, profile, scoring, state, topic, vectors
from ..sinks import feed, notes, report
from ..sources import payloads
from ..storage import shared_dir

ASOF = "2024-01-31 00:00:00"
LIBRARY, CANDIDATE = "source < 'src2'", "source >= 'src2'"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def asof(at: str = ASOF):
    return F.to_timestamp(F.lit(at))


def documents(s, d):
    """Candidate-like rows of documents: title is the first line."""
    title = F.substring_index("text", "\n", 1)
    return t(s, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("venue"), title.alias("title"), F.col("text").alias("abstract"))


DOCS = "(SELECT doc_id AS ordinal, source AS venue, split_part(text, chr(10), 1) AS title, text AS abstract FROM documents)"


# exact dedupe, topics, anti-joins


def q_exact_dedupe(s, d):
    """WIN1."""
    x = documents(s, d).select("ordinal", F.lit(None).cast("string").alias("doi"), F.col("abstract").alias("identifier"), "title")
    return dedupe.keep_first(x).select(F.col("ordinal").alias("doc_id"))


TOPICS = topic.Topics(exclude=["ouen the", "zu_der"], any_of=[[["the ", "de "], ["tion", "ment"]], [["die"], ["keit", "lich"]]], groups=[["never used"]], include=["er", "la"], require_include=True)


def q_topic_filter(s, d):
    """FLT1 to FLT4, S9: sets win over groups; an included term is asked for."""
    x = documents(s, d)
    return x.where(topic.on_topic(text.haystack(F.col("title"), F.col("abstract"), F.col("venue")), TOPICS)).select(F.col("ordinal").alias("doc_id"))


def q_topic_groups(s, d):
    """FLT1, FLT2 without sets, then the dedupe (FLT5's other branch)."""
    x = documents(s, d).withColumn("doi", F.lit(None).cast("string")).withColumn("identifier", F.col("abstract"))
    return topic.topic_filter(x, topic.Topics(groups=[["of", "des"], ["in"]], exclude=["casino"])).select(F.col("ordinal").alias("doc_id"))


def q_library_anti(s, d):
    """JN1, JN2."""
    x = t(s, d, "documents")
    key = F.col("text").alias("doi")
    mine = x.where(CANDIDATE).select("doc_id", key, F.concat(F.lit("HTTP://X/"), (F.col("doc_id") % 50).cast("string")).alias("identifier"))
    lib = x.where(LIBRARY).select(key, F.concat(F.lit(" http://x/"), (F.col("doc_id") % 20).cast("string")).alias("url"))
    return dedupe.not_in_library(mine, lib).select("doc_id")


def q_fuzzy_dedupe(s, d):
    """JN4, S23: page titles, kept greedily in order."""
    x = t(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    x = x.select(F.col("page_id").alias("ordinal"), F.col("page_id").cast("string").alias("identifier"), F.lit(None).cast("string").alias("doi"), "title")
    return dedupe.self_dedupe(x).select(F.col("ordinal").alias("page_id"))


def q_fuzzy_components(s, d):
    """JN4 as at scale: the same rows as q_fuzzy_dedupe, each connected component in a task of its own, large ones in rounds."""
    x = t(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    x = x.select(F.col("page_id").alias("ordinal"), F.col("page_id").cast("string").alias("identifier"), F.lit(None).cast("string").alias("doi"), "title")
    return dedupe.self_dedupe(x, most=64).select(F.col("ordinal").alias("page_id"))


def q_fuzzy_library(s, d):
    """JN3: titles of plain-http pages that are like no title of an https page."""
    x = t(s, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    safe = F.col("url").startswith("https:")
    return dedupe.fuzzy_not_in_library(x.where(~safe), x.where(safe)).select("page_id")


# scalars


def q_title_normalize(s, d):
    """S1, S3."""
    x = documents(s, d)
    return x.select("ordinal", text.clean_title(F.col("title")).alias("clean"), text.normalize_title(F.col("title")).alias("norm"))


def q_identifier_normalize(s, d):
    """S2, S27, FLT8."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.col("page_id").cast("string"))).otherwise(F.upper("url"))
    x = t(s, d, "pages").select("page_id", url.alias("u"))
    return x.select("page_id", text.normalize_identifier(F.col("u")).alias("norm"), text.doi_to_url(F.col("u")).alias("doi_url"), text.is_doi_url(F.col("u")).alias("is_doi"))


def q_strip_html(s, d):
    """S4."""
    return t(s, d, "pages").select("page_id", text.clean_abstract(F.col("html"), unescape=False).alias("plain"))


def q_abstract_unescaped(s, d):
    """S4 with references decoded."""
    return t(s, d, "pages").select("page_id", F.md5(text.clean_abstract(F.col("html"))).alias("digest"))


def words_at(s, d, place):
    """(doc_id, words array<struct<word, at>>) of all documents that have words. Texts meet by document, and words are told apart there: taking them apart first would shuffle and sort a row for each."""
    words = lambda x: F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    each = lambda x: F.transform(words(x), lambda w, i: F.struct(w.alias("word"), place(i).alias("at")))
    texts = t(s, d, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts")).where(F.exists("texts", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return texts.select("doc_id", F.flatten(F.transform("texts", each)).alias("words"))


def q_inverted_index_text(s, d):
    """An index built from words and turned back into text."""
    index = words_at(s, d, lambda i: i).select("doc_id", text.inverted_index(F.col("words")).alias("index"))
    return index.select("doc_id", F.md5(text.inverted_index_text(F.col("index"))).alias("digest"))


def q_year_extract(s, d):
    """S7."""
    x = t(s, d, "orders").select("o_orderkey", F.concat_ws("-", F.lit("ca"), F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM")).alias("date"))
    return x.select("o_orderkey", text.first_year(F.col("date")).alias("year"))


def q_author_join(s, d):
    """S8."""
    x = t(s, d, "customer")
    given = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    family = F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_name"))
    return x.select("c_custkey", text.person_name(given, family).alias("name"))


def q_content_hash(s, d):
    """S10."""
    return t(s, d, "documents").select("doc_id", text.content_hash(F.col("text"), F.col("lang"), F.nullif("source", F.lit("src0"))).alias("digest"))


def q_haystack(s, d):
    """FLT1's haystack, PRJ9, PRJ10."""
    x = documents(s, d)
    made = text.embedding_text(F.col("title"), F.col("abstract"), F.array("venue", F.lit("b")), F.array().cast("array<string>"))
    return x.select("ordinal", F.md5(text.haystack(F.col("title"), F.col("abstract"), F.nullif("venue", F.lit("src0")))).alias("hay"), F.md5(made).alias("embed"))


def q_json_metrics(s, d):
    """PRJ2's metrics, FLT9, D14."""
    x = t(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return x.select("event_id", text.number(F.element_at("m", "k")).alias("k"), text.number(F.lit("1.5d")).isNull().alias("suffix_rejected"))


def q_date_parse(s, d):
    """S11, S12, S14."""
    x = t(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"), F.date_format("ts", "yyyy-M-d").alias("b"), F.date_format("ts", "yyyy-MM").alias("c"))
    p = dates.parse_date
    return x.select("event_id", dates.iso_utc(p(F.col("a"))).alias("iso"), dates.rfc822(p(F.col("b"))).alias("rfc"), p(F.col("c")).isNull().alias("no_date"))


def q_recency_score(s, d):
    """S15, S16."""
    x = t(s, d, "events")
    at = F.col("ts").cast("timestamp")
    return x.select("event_id", dates.elapsed_days(at, asof()).alias("days"), scores.recency(at, asof(), 3, 7, 30).alias("recency"))


def q_log_metric(s, d):
    """S17."""
    x = t(s, d, "events").select("event_id", F.create_map(F.when(F.col("event_id") % 2 == 0, "cited_by").otherwise("is-referenced-by"), "value").alias("m"))
    return x.select("event_id", F.round(scores.log_metric(scores.citations(F.col("m"))), 9).alias("metric"))


# joins of scoring


def brands(s, d):
    x = t(s, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice") / 500, 6).alias("sjr"))
    return x.where("p_brand < 'Brand#4'").select(F.lower("p_brand").alias("title_key"), "sjr")


def q_journal_quality(s, d):
    """JN7, S18."""
    x = t(s, d, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" ")).alias("venue"))
    return scoring.with_journal(x, brands(s, d)).select("p_partkey", F.round("journal_quality", 9).alias("quality"), F.round("journal_sjr", 6).alias("sjr"))


def q_whitelist_bonus(s, d):
    """JN8: letter case aside, blanks count."""
    x = t(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return x.select("conv_id", scores.bonus(F.col("roles"), ["SYSTEM", " user"]).alias("bonus"))


def q_label(s, d):
    """S19, S20."""
    x = t(s, d, "events")
    total = scores.weighted({"a": F.col("value"), "b": F.lit(0.25)}, {"a": 0.01, "b": 0.5})
    return x.select("event_id", F.round(total, 9).alias("score"), scores.label(F.round(total, 9), 0.75, 0.5).alias("label"))


# vectors


def halves(s, d):
    x = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return x.where("label >= 5"), x.where("label < 5")


def q_top1_similarity(s, d):
    """JN5, S22."""
    return vectors.nearest(*halves(s, d)).select(F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity"))


def q_topk_similarity(s, d):
    """JN6, k = 5, by the index that large libraries take."""
    found = vectors.nearest(*halves(s, d), k=5, broadcast_bytes=40_000)
    return found.select(F.col("id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 4).alias("similarity"))


def q_cell_index(s, d):
    """JN6, SNK7, SRC22, SRC28: every vector's two nearest of all, itself included, by an index that was stored and loaded."""
    x = t(s, d, "embeddings")
    path = shared_dir(s)
    cells.build(x.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))).save(path)
    found, _ = cells.search(x.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), cells.Cells.load(s, path), 2)
    return found.select(F.col("id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 4).alias("similarity"))


def q_centroid(s, d):
    """AGG4."""
    return vectors.centroid(t(s, d, "embeddings")).select(F.posexplode("centroid").alias("pos", "x")).select(F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def q_l2_normalize(s, d):
    """Every component, of vectors that are not of length 1."""
    x = t(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * (F.col("vec_id") + 1)).alias("v"))
    return x.select("vec_id", F.posexplode(vectors.l2_normalize(F.col("v"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


# profile


def q_top_authors(s, d):
    """AGG1, AGG3: words as authors, ties by first mention."""
    w = t(s, d, "documents").select(F.col("doc_id").alias("ordinal"), F.posexplode(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).alias("pos", "author"))
    return profile.top_counts(w, "author", ["ordinal", "pos"]).drop("first")


def q_top_venues(s, d):
    """AGG2, AGG3."""
    raw = F.to_json(F.struct(F.struct(F.nullif("source", F.lit("src3")).alias("publicationTitle")).alias("data")))
    return profile.top_venues(t(s, d, "documents").select(F.col("doc_id").alias("ordinal"), raw.alias("raw"))).drop("first")


def q_profile_summary(s, d):
    """AGG5, D8."""
    x = t(s, d, "documents").join(t(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    raw = F.to_json(F.struct(F.struct(F.col("source").alias("publicationTitle")).alias("data")))
    lib = x.select(F.col("doc_id").alias("ordinal"), F.array("lang").alias("creators"), raw.alias("raw"), "embedding")
    out = profile.summary(lib, "given-vectors", asof())
    return out.select("item_count", "model", F.size("centroid").cast("bigint").alias("dims"), F.col("top_authors")[0]["author"].alias("first_author"), F.col("top_authors")[0]["count"].alias("author_count"))


def q_ordered_distinct(s, d):
    """WIN2, SRC14."""
    out = profile.distinct_in_order(t(s, d, "events"), "event_type", ["event_id"])
    return out.select("event_type", F.col("first.event_id").alias("first_id"))


# state


def changes(s, d):
    x = t(s, d, "events")
    return x.select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type", "value")


def q_upsert_latest(s, d):
    """SNK1."""
    return state.latest(changes(s, d))


def q_tombstone(s, d):
    """SNK2, JN11, INC3: latest rows without keys whose last event is an error."""
    last = state.latest(changes(s, d))
    return state.remove(last, last.where("event_type = 'error'").select("key")).select("key", "version")


def q_cursor_max(s, d):
    """AGG6, AGG7."""
    x = changes(s, d)
    return state.cursor(x).crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("fetched"))))  # one row each


def q_incremental_state(s, d):
    """INC3, SNK3: the log up to a day as state, the rest as changes; keys whose last change is an error are deleted."""
    x = t(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type", "ts")
    x = x.withColumn("content_hash", F.sha2(F.col("event_type"), 256)).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    old = F.col("ts") < F.lit("2024-01-28").cast("timestamp_ntz")
    before, after = state.latest(x.where(old)), x.where(~old)
    gone = state.latest(after).where("event_type = 'error'").select("key")
    out = state.apply_changes(before, after, gone)
    return out.select("key", "version", "event_type", F.col("embedding").isNull().alias("stale"))


# order, limits, cap


def q_recent_filter(s, d):
    """FLT7: future dates stay."""
    x = t(s, d, "events")
    return x.where(dates.is_recent(F.col("ts").cast("timestamp"), asof("2024-01-20 12:00:00"), 7)).select("event_id")


def q_stable_rank(s, d):
    """SRT1, LIM1, WIN4: ties keep the input order."""
    x = t(s, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("score"))
    top = x.orderBy(*scoring.rank_order()).limit(50)
    return report.numbered(top, scoring.rank_order()).select(F.col("rank").cast("bigint").alias("rank"), F.col("ordinal").alias("o_orderkey"))


def q_preprint_cap(s, d):
    """WIN3."""
    x = t(s, d, "events").select("event_id", "value", F.col("event_type").alias("source"))
    return cap.cap_share(x, [F.desc("value"), F.asc("event_id")], names=("view", "click")).select("event_id")


def q_limit_per_query(s, d):
    """LIM2, SRT3."""
    return fanin.limit_per(t(s, d, "documents"), "source", [F.desc("n_chars"), F.asc("doc_id")], 10).select("doc_id")


def candidates(s, d):
    """SRC10, SET1: three sources with the candidates' columns."""
    empty = {"authors": F.array().cast("array<string>"), "doi": F.lit(None).cast("string"), "published": F.lit(None).cast("timestamp"), "metrics": F.create_map().cast("map<string,double>"), "extra": F.create_map().cast("map<string,string>")}
    x = t(s, d, "documents")
    a = x.select(F.lit("graph").alias("source"), F.col("doc_id").cast("string").alias("identifier"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("url"), F.col("source").alias("venue"), F.col("doc_id").alias("pos"))
    p = t(s, d, "pages")
    b = p.select(F.lit("registry").alias("source"), F.col("url").alias("identifier"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit(None).cast("string").alias("abstract"), "url", F.lit(None).cast("string").alias("venue"), F.col("page_id").alias("pos"))
    m = t(s, d, "benchmark")
    c = m.select(F.lit("arxiv").alias("source"), F.col("item_id").cast("string").alias("identifier"), F.col("text").alias("title"), F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("string").alias("url"), F.lit("arXiv").alias("venue"), F.col("item_id").alias("pos"))
    return [df.withColumns(empty) for df in (a, b, c)]


def q_union_sources(s, d):
    """SRC10, SET1, FLT6, AGG8."""
    out = fanin.union_sources(candidates(s, d)).where(text.clean_title(F.col("title")) != "")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


# enrichment


def to_enrich(s, d):
    x = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("doi"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("abstract"), "doc_id")
    url = F.when(F.col("doc_id") % 4 == 0, F.lit("http://own.example/x")).when(F.col("doc_id") % 4 == 1, F.lit("HTTPS://DX.DOI.ORG/10.1")).when(F.col("doc_id") % 4 == 2, F.lit(""))
    return x.withColumn("url", url)


def q_enrich_join(s, d):
    """JN9, FLT8, FLT11, PRJ12, S28, SRC24, SRC25."""
    works = t(s, d, "documents").where("lang <> 'en'").select(F.col("doc_id").cast("string").alias("doi"), F.col("source").alias("abstract"), F.lit("http://page.example/y").alias("landing_page"))
    found = t(s, d, "documents").where("source < 'src15'").select(F.col("doc_id").cast("string").alias("doi"), F.lit("http://resolved.example/z").alias("resolved_url"))
    return enrich.enrich(to_enrich(s, d), works, found).select("doc_id", "abstract", "url")


# sinks


def ranked_rows(s, d):
    x = t(s, d, "documents").join(t(s, d, "events"), F.col("event_id") == F.col("doc_id"))
    return x.select(
        F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("identifier"), F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("abstract"), F.array("lang", "source").alias("authors"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("http://x/?a=1&b="), F.col("doc_id").cast("string"))).alias("url"), F.when(F.col("doc_id") % 7 > 0, F.col("ts").cast("timestamp")).alias("published"),
        F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("venue"), (F.col("doc_id") % 8 / 8).alias("score"), F.lit(0.25).alias("similarity"), F.lit("consider").alias("label"),
    )


def q_rss_items(s, d):
    """SNK10, S14, S30."""
    return ranked_rows(s, d).select("ordinal", feed.item(asof()).alias("item"))


def q_report_rows(s, d):
    """SNK11, S31."""
    top = ranked_rows(s, d).orderBy(*scoring.rank_order()).limit(50)
    return report.numbered(top, scoring.rank_order()).select(F.col("rank").cast("bigint").alias("rank"), report.row_html().alias("html"), report.report_name(asof("2024-01-31 20:00:00")).alias("file"))


def q_push_payload(s, d):
    """SNK12, S29."""
    return ranked_rows(s, d).select("ordinal", notes.payload("C1").alias("body"))
