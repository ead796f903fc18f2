"""RSS 2.0 (SNK10, S14, S30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_utc, rfc822
from ..functions.text import empty_to_null
from .document import write_document


def escape(c: Column, quotes: bool = False) -> Column:
    """XML text; with ``quotes`` also for attributes."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&#34;"), ("'", "&#39;")] if quotes else [])
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def element(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escape(c), F.lit(f"</{name}>"))


def description(abstract: Column, published: Column, venue: Column) -> Column:
    """The abstract if there is one, the date, the venue; what is missing is Unknown."""
    date = F.coalesce(iso_utc(published), F.lit("Unknown"))
    place = F.coalesce(empty_to_null(venue), F.lit("Unknown"))
    return F.concat_ws("\n", empty_to_null(abstract), F.concat(F.lit("Published: "), date), F.concat(F.lit("Venue: "), place))


def item(asof: Column) -> Column:
    """One item from a ranked row's columns; a missing date is ``asof``."""
    parts = [
        element("title", F.col("title")),
        F.when(F.coalesce(F.col("url"), F.lit("")) != "", element("link", F.col("url"))),
        element("guid", F.col("identifier")),
        element("pubDate", rfc822(F.coalesce("published", asof))),
        F.when(F.coalesce(F.col("venue"), F.lit("")) != "", element("category", F.col("venue"))),
        element("description", description(F.col("abstract"), F.col("published"), F.col("venue"))),
    ]
    return F.concat(F.lit("<item>"), F.concat_ws("", *parts), F.lit("</item>"))


def frame(asof_text: str, title: str, link: str, about: str) -> tuple[str, str]:
    """What stands before and behind the items."""
    from xml.sax.saxutils import escape as plain

    head = f"<title>{plain(title)}</title><link>{plain(link)}</link><description>{plain(about)}</description><lastBuildDate>{asof_text}</lastBuildDate>"
    return f"<?xml version='1.0' encoding='utf-8'?>\n<rss version=\"2.0\"><channel>{head}", "</channel></rss>"


def write_rss(ranked: DataFrame, order: list[Column], asof: Column, path: str, title: str = "Literature feed", link: str = "https://example.com", about: str = "Newly published works") -> None:
    """The feed of all rows in order, however many."""
    built = ranked.sparkSession.range(1).select(rfc822(asof).alias("d")).first().d
    head, tail = frame(built, title, link, about)
    write_document(ranked.orderBy(*order).select(item(asof).alias("text")), path, head, tail)
