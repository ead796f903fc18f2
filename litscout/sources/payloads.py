"""Payload flatteners (PRJ1 to PRJ8, FLT6): rows of raw JSON to library or candidate rows.

Inputs hold one payload item per row in the named JSON column and its place in ``pos``; schemas are
explicit, so nothing is inferred, and a value of another type becomes null instead of stopping the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_date, parse_date
from ..functions.text import clean_abstract, clean_title, empty_to_null, first_year, inverted_index_text, number, person_name, strip
from ..schema import CANDIDATE_COLUMNS, CANDIDATES

LIBRARY_ITEM = (
    "key STRING, version BIGINT, data STRUCT<key STRING, version BIGINT, title STRING, abstractNote STRING, creators ARRAY<STRUCT<firstName STRING, lastName STRING>>, "
    "tags ARRAY<STRING>, collections ARRAY<STRING>, date STRING, DOI STRING, url STRING, publicationTitle STRING>"
)
UNIFIED_ITEM = (
    "id STRING, source STRING, source_identifier STRING, title STRING, abstract STRING, authors STRING, doi STRING, url STRING, published_at STRING, venue STRING, "
    "metrics MAP<STRING, STRING>, candidate_type STRING, candidate_group STRING, updated_at STRING"
)
GRAPH_WORK = (
    "id STRING, ids STRUCT<openalex STRING>, display_name STRING, abstract STRING, abstract_inverted_index MAP<STRING, ARRAY<INT>>, "
    "authorships ARRAY<STRUCT<author STRUCT<display_name STRING>>>, doi STRING, primary_location STRUCT<landing_page_url STRING, source STRUCT<url STRING, display_name STRING>>, "
    "publication_date STRING, cited_by_count DOUBLE, concepts ARRAY<STRUCT<display_name STRING>>"
)
REGISTRY_WORK = (
    "title ARRAY<STRING>, DOI STRING, URL STRING, author ARRAY<STRUCT<given STRING, family STRING>>, abstract STRING, created STRUCT<`date-time` STRING>, "
    "`container-title` ARRAY<STRING>, `is-referenced-by-count` DOUBLE, type STRING"
)
PREPRINT = "title STRING, doi STRING, rel_link STRING, url STRING, biorxiv_id STRING, abstract STRING, authors STRING, date STRING, category STRING, version STRING"


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[empty_to_null(c) for c in columns])


def _extra(**values: Column) -> Column:
    """The open map: JSON text per key, nulls left out."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _titled(df: DataFrame, title: Column) -> DataFrame:
    """FLT6: rows with a title that is not blank."""
    return df.withColumn("title", clean_title(title)).where("title <> ''")


def library_items(raw: DataFrame, column: str = "json") -> DataFrame:
    """PRJ1: key, version, title, abstract, creators, tags, collections, year, doi, url, raw, ordinal.

    Keys and versions come from ``data`` first, a zero version falls through; a tag that is an object
    gives its ``tag``, others are left out.
    """
    x = F.from_json(column, LIBRARY_ITEM)
    d = raw.select(x.alias("x"), F.col(column).alias("raw"), F.col("pos").alias("ordinal"))
    names = F.transform("x.data.creators", lambda c: person_name(c["firstName"], c["lastName"]))
    tags = F.filter(F.transform("x.data.tags", lambda t: F.get_json_object(t, "$.tag")), lambda t: t.isNotNull())
    none = F.array().cast("array<string>")
    return d.select(
        first_filled(F.col("x.data.key"), F.col("x.key")).alias("key"),
        F.coalesce(F.when(F.col("x.data.version") != 0, F.col("x.data.version")), F.when(F.col("x.version") != 0, F.col("x.version")), F.lit(0)).alias("version"),
        F.coalesce("x.data.title", F.lit("")).alias("title"),
        F.col("x.data.abstractNote").alias("abstract"),
        F.coalesce(F.filter(names, lambda n: n != ""), none).alias("creators"),
        F.coalesce(tags, none).alias("tags"),
        F.coalesce("x.data.collections", none).alias("collections"),
        first_year(F.col("x.data.date")).alias("year"),
        F.col("x.data.DOI").alias("doi"),
        F.col("x.data.url").alias("url"),
        "raw",
        "ordinal",
    )


def unified_candidates(raw: DataFrame, column: str = "json") -> DataFrame:
    """PRJ2. Authors that are no list become one; blank authors, metrics that are no numbers and null extras go."""
    d = _titled(raw.select(F.from_json(column, UNIFIED_ITEM).alias("x"), "pos"), F.col("x.title"))
    many = F.from_json("x.authors", "array<string>")
    authors = F.when(F.col("x.authors").startswith("["), many).when(F.coalesce(F.col("x.authors"), F.lit("")) != "", F.array("x.authors")).otherwise(F.array().cast("array<string>"))
    metrics = F.map_filter(F.transform_values(F.coalesce("x.metrics", F.create_map().cast("map<string,string>")), lambda k, v: number(v)), lambda k, v: v.isNotNull())
    extra = _extra(candidate_type=F.col("x.candidate_type"), candidate_group=F.col("x.candidate_group"), updated_at=F.col("x.updated_at"), public_id=F.col("x.id"))
    return d.select(
        F.coalesce(empty_to_null(F.col("x.source")), F.lit("public-api")).alias("source"),
        first_filled(F.col("x.source_identifier"), F.col("x.id"), F.col("title")).alias("identifier"),
        "title",
        F.col("x.abstract").alias("abstract"),
        F.filter(F.transform(authors, strip), lambda a: a != "").alias("authors"),
        F.col("x.doi").alias("doi"),
        F.col("x.url").alias("url"),
        F.coalesce(parse_date(F.col("x.published_at")), epoch_date(number(F.col("x.published_at")))).alias("published"),
        F.col("x.venue").alias("venue"),
        metrics.alias("metrics"),
        extra.alias("extra"),
        "pos",
    )


def graph_abstract(x: str = "x") -> Column:
    """The abstract as an object with a text, as a string, or as an inverted index."""
    own = F.col(f"{x}.abstract")
    return F.coalesce(empty_to_null(F.get_json_object(own, "$.text")), F.when(~own.startswith("{"), empty_to_null(strip(own))), inverted_index_text(F.col(f"{x}.abstract_inverted_index")))


def graph_candidates(raw: DataFrame, column: str = "json") -> DataFrame:
    """PRJ3; ``raw`` also holds the ``query``."""
    d = _titled(raw.select(F.from_json(column, GRAPH_WORK).alias("x"), "query", "pos"), F.col("x.display_name"))
    return d.select(
        F.lit("graph").alias("source"),
        first_filled(F.col("x.id"), F.col("x.ids.openalex"), F.col("x.doi"), F.col("title")).alias("identifier"),
        "title",
        graph_abstract().alias("abstract"),
        F.transform(F.coalesce("x.authorships", F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))).alias("authors"),
        F.col("x.doi").alias("doi"),
        first_filled(F.col("x.primary_location.source.url"), F.col("x.primary_location.landing_page_url")).alias("url"),
        parse_date(F.col("x.publication_date")).alias("published"),
        F.col("x.primary_location.source.display_name").alias("venue"),
        F.create_map(F.lit("cited_by"), F.coalesce("x.cited_by_count", F.lit(0.0))).alias("metrics"),
        _extra(concepts=F.to_json(F.transform("x.concepts", lambda c: c["display_name"])), query=F.col("query")).alias("extra"),
        "pos",
    )


def registry_candidates(raw: DataFrame, column: str = "json", venue: Column | None = None) -> DataFrame:
    """PRJ4, and SRC7 where ``venue`` overwrites the payload's venue with the queried one."""
    d = _titled(raw.select(F.from_json(column, REGISTRY_WORK).alias("x"), *[c for c in raw.columns if c != column]), F.get("x.title", F.lit(0)))
    names = F.transform(F.coalesce("x.author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: person_name(a["given"], a["family"]))
    return d.select(
        F.lit("registry").alias("source"),
        F.coalesce(empty_to_null(F.col("x.DOI")), F.col("x.URL"), F.lit("unknown")).alias("identifier"),
        "title",
        clean_abstract(F.col("x.abstract")).alias("abstract"),
        F.filter(names, lambda n: n != "").alias("authors"),
        F.col("x.DOI").alias("doi"),
        F.col("x.URL").alias("url"),
        parse_date(F.col("x.created.date-time")).alias("published"),
        (F.get("x.container-title", F.lit(0)) if venue is None else venue).alias("venue"),
        F.create_map(F.lit("is-referenced-by"), F.coalesce("x.is-referenced-by-count", F.lit(0.0))).alias("metrics"),
        _extra(type=F.col("x.type"), query=F.col("query") if "query" in raw.columns else F.lit(None).cast("string")).alias("extra"),
        "pos",
    )


def feed_candidates(entries: DataFrame) -> DataFrame:
    """PRJ5: entries of an Atom feed (id, title, summary, author array<struct<name>>, doi, link, published, category, pos)."""
    d = _titled(entries, F.col("title"))
    return d.select(
        F.lit("arxiv").alias("source"),
        first_filled(F.col("id"), F.col("link"), F.col("title")).alias("identifier"),
        "title",
        F.col("summary").alias("abstract"),
        F.filter(F.transform("author", lambda a: a["name"]), lambda n: n.isNotNull()).alias("authors"),
        "doi",
        F.col("link").alias("url"),
        parse_date(F.col("published")).alias("published"),
        F.lit("arXiv").alias("venue"),
        F.create_map().cast("map<string,double>").alias("metrics"),
        _extra(primary_category=F.col("category")).alias("extra"),
        "pos",
    )


def preprint_candidates(raw: DataFrame, source: str, column: str = "json") -> DataFrame:
    """PRJ6: authors are split at semicolons; the URL falls back to the DOI's."""
    d = _titled(raw.select(F.from_json(column, PREPRINT).alias("x"), "pos"), F.col("x.title"))
    doi = empty_to_null(F.col("x.doi"))
    return d.select(
        F.lit(source).alias("source"),
        first_filled(F.col("x.doi"), F.col("x.biorxiv_id"), F.col("title")).alias("identifier"),
        "title",
        F.col("x.abstract").alias("abstract"),
        F.filter(F.transform(F.split(F.coalesce("x.authors", F.lit("")), ";"), strip), lambda a: a != "").alias("authors"),
        doi.alias("doi"),
        F.coalesce(empty_to_null(F.col("x.rel_link")), empty_to_null(F.col("x.url")), F.concat(F.lit("https://doi.org/"), doi)).alias("url"),
        parse_date(F.col("x.date")).alias("published"),
        F.lit(source).alias("venue"),
        F.create_map().cast("map<string,double>").alias("metrics"),
        _extra(category=F.col("x.category"), version=F.col("x.version")).alias("extra"),
        "pos",
    )


def to_json(candidates: DataFrame) -> DataFrame:
    """PRJ8: one JSON object per row, dates in ISO format."""
    return candidates.select(F.to_json(F.struct(*CANDIDATE_COLUMNS, "ordinal"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("value"))


def from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """PRJ8: candidates from one JSON object per row."""
    return lines.select(F.from_json(column, CANDIDATES, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("x")).select("x.*")


def stored_items(rows: DataFrame) -> DataFrame:
    """PRJ7: arrays kept as JSON text decoded, null as empty."""
    lists = {c: F.coalesce(F.from_json(F.coalesce(F.col(c), F.lit("[]")), "array<string>"), F.array().cast("array<string>")) for c in ("creators", "tags", "collections")}
    return rows.withColumns(lists)
