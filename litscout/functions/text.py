"""String functions with the semantics of Python's str, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's ``\s`` and ``str.strip`` take as white space; Java's Unicode class lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """``str.strip``: all Unicode white space at both ends, not the blank alone as ``trim``."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_title(c: Column) -> Column:
    """Stripped, null as empty."""
    return strip(F.coalesce(c, F.lit("")))


def normalize_identifier(c: Column) -> Column:
    """Null as empty, lower case, stripped. A DOI and its URL form stay different."""
    return strip(F.lower(F.coalesce(c, F.lit(""))))


def normalize_title(c: Column) -> Column:
    """S3: white space runs as one blank, stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+", " ")))


def _unescape(values: pd.Series) -> pd.Series:
    import html

    return values.map(lambda v: v if v is None or "&" not in v else html.unescape(v))


def html_unescape(c: Column) -> Column:
    """Character references decoded; there is no built-in for it."""
    return F.pandas_udf(_unescape, T.StringType())(c)


def clean_abstract(c: Column, unescape: bool = True) -> Column:
    """References decoded, tags to blanks, white space collapsed, empty to null."""
    text = html_unescape(c) if unescape else c
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return empty_to_null(F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " ")))


def inverted_index_text(index: Column) -> Column:
    """The text of map<word, array<position>>; gaps dropped, the word written last wins a slot.

    Entries keep the map's order, so of two words on a position the later entry is taken.
    """
    entries = F.map_entries(index)
    placed = F.flatten(
        F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))))
    )
    ordered = F.sort_array(F.filter(placed, lambda x: x["p"] >= 0))

    def joined(rows: Column) -> Column:
        last = F.filter(rows, lambda x, i: (x["w"] != "") & ~F.get(rows, i + 1)["p"].eqNullSafe(x["p"]))
        return F.array_join(F.transform(last, lambda x: x["w"]), " ")

    def stripped(x: Column) -> Column:  # the pattern is searched for in the whole text, so only where an end matches
        return F.when(F.left(x, F.lit(1)).rlike(f"(?U){SPACE}") | F.right(x, F.lit(1)).rlike(f"(?U){SPACE}"), strip(x)).otherwise(x)

    # sorted rows and text are bound, as Spark evaluates what a lambda function reads again for every use
    return F.transform(F.transform(F.transform(F.array(ordered), joined), stripped), empty_to_null)[0]


def inverted_index(words: Column) -> Column:
    """map<word, array<position>> of array<struct<word, at>>, words ascending and the positions of each too: the words are sorted and cut into runs."""

    def entries(rows: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda k: (k == 0) | (F.get(rows, k)["word"] != F.get(rows, k - 1)["word"]))

        def runs(first: Column) -> Column:
            length = lambda a, i: F.coalesce(F.get(first, i + 1), F.size(rows)) - a
            return F.transform(first, lambda a, i: F.struct(F.get(rows, a)["word"].alias("word"), F.transform(F.slice(rows, a + 1, length(a, i)), lambda x: x["at"]).alias("at")))

        return F.transform(F.array(numbers), runs)[0]

    return F.map_from_entries(F.transform(F.array(F.sort_array(F.filter(words, lambda x: x["word"].isNotNull()))), lambda rows: F.when(F.size(rows) > 0, entries(rows)))[0])


def first_year(c: Column) -> Column:
    """The first part between hyphens that is all digits."""
    return F.get(F.filter(F.split(c, "-"), lambda x: x.rlike("^[0-9]+$")), F.lit(0)).try_cast("int")


def person_name(given: Column, family: Column) -> Column:
    """Given and family name, null and empty skipped."""
    return strip(F.concat_ws(" ", empty_to_null(given), empty_to_null(family)))


def contains_any(haystack: Column, terms: Iterable[str]) -> Column:
    """Whether any term is a substring. Not LIKE: ``_`` in a term is a plain character."""
    return reduce(lambda a, b: a | b, [F.contains(haystack, F.lit(t)) for t in terms], F.lit(False))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts without separators, null as empty."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def haystack(*parts: Column) -> Column:
    """The text that topics are matched in: non-empty parts joined by a blank, lower case."""
    return F.lower(F.concat_ws(" ", *[empty_to_null(p) for p in parts]))


def embedding_text(title: Column, abstract: Column, authors: Column, tags: Column | None = None) -> Column:
    """PRJ9, PRJ10: parts on lines of their own, lists joined by ``; ``, empty parts dropped."""
    lists = [authors] if tags is None else [authors, tags]
    return F.concat_ws("\n", empty_to_null(title), empty_to_null(abstract), *[empty_to_null(F.array_join(x, "; ")) for x in lists])


def is_doi_url(c: Column) -> Column:
    """FLT8; null is not one."""
    return F.coalesce(c.rlike(r"(?i)^https?://(dx\.)?doi\.org/"), F.lit(False))


def doi_to_url(c: Column) -> Column:
    """A bare DOI as URL; what starts with http stays."""
    value = strip(c)
    return F.when(F.lower(value).startswith("http"), value).otherwise(F.concat(F.lit("https://doi.org/"), value))


def number(c: Column) -> Column:
    """FLT9: the number a string holds as Python's float reads it, else null. Underscores between digits count, type suffixes don't."""
    text = strip(c)
    plain = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    ok = plain.rlike(r"(?i)^[+-]?((([0-9]+\.?[0-9]*)|(\.[0-9]+))(e[+-]?[0-9]+)?|inf(inity)?|nan)$")
    return F.when(ok, plain.try_cast("double"))


def landing_url(url: Column, page: Column, resolved: Column) -> Column:
    """The own URL unless it is a DOI's, the looked-up page likewise, the resolved one, else the own."""
    own = F.when((url != "") & ~is_doi_url(url), url)
    looked_up = F.when((page != "") & ~is_doi_url(page), page)
    return F.coalesce(own, looked_up, F.when((resolved != "") & ~is_doi_url(resolved), resolved), url)
