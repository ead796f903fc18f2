"""HTML report and log lines (SNK11, SNK14, WIN4, S31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import empty_to_null
from .document import ranked_anywhere, write_document
from .feed import escape


def numbered(ranked: DataFrame, order: list[Column]) -> DataFrame:
    """WIN4: ``rank`` from 1; for rows that a limit has cut down."""
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def row_html() -> Column:
    """One entry from a numbered ranked row."""
    known = lambda c: escape(F.coalesce(empty_to_null(c), F.lit("Unknown")), True)
    date = F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("Unknown"))
    return F.concat(
        F.lit("<section><h2>"), F.col("rank").cast("string"), F.lit('. <a href="'), escape(F.coalesce(empty_to_null(F.col("url")), F.lit("#")), True), F.lit('">'),
        escape(F.col("title"), True), F.lit("</a></h2><p>Label: "), F.col("label"), F.lit(" | Score: "), F.format_string("%.3f", F.col("score")), F.lit(" | Similarity: "),
        F.format_string("%.3f", F.col("similarity")), F.lit(" | Published: "), date, F.lit(" | Venue: "), known(F.col("venue")), F.lit("</p>"),
        F.when(F.coalesce(F.col("abstract"), F.lit("")) != "", F.concat(F.lit("<p>"), escape(F.col("abstract"), True), F.lit("</p>"))).otherwise(F.lit("")),
        F.lit("<p>Authors: "), known(F.array_join("authors", ", ")), F.lit("</p></section>"),
    )


def write_report(ranked: DataFrame, order: list[Column], generated_at: str, path: str) -> None:
    """The report of all rows in order, however many."""
    head = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Reading list {generated_at}</title></head>\n<body><h1>Reading list</h1><p>Generated at {generated_at}</p>\n'
    rows = ranked_anywhere(ranked, order).orderBy("rank").select(row_html().alias("text"))
    write_document(rows, path, head, "\n</body></html>\n", "\n")


def log_lines(ranked: DataFrame, order: list[Column], n: int = 10) -> list[str]:
    """SNK14: rank, score, label and title of the first n."""
    top = numbered(ranked.orderBy(*order).limit(n), order)
    return [r.x for r in top.orderBy("rank").select(F.format_string("%02d | %.3f | %s | %s", "rank", "score", "label", "title").alias("x")).collect()]


def report_name(asof: Column, zone: str = "Asia/Shanghai") -> Column:
    """The report's file name by the date in a zone."""
    return F.concat(F.lit("report-"), F.date_format(F.from_utc_timestamp(asof, zone), "yyyyMMdd"), F.lit(".html"))
