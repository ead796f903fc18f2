from datetime import datetime

import pytest
from pyspark.sql import functions as F

from litscout.functions import dates, scores, text
from litscout.functions.fuzzy import common_subsequence, token_set_ratio


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(df, c):
    return [r.y for r in df.select("i", c.alias("y")).orderBy("i").collect()]


SPACES = ["\t a b \xa0", "\x1c x \x1f", "", None, " Title\n"]


def test_strip_is_pythons(spark):
    assert apply(column(spark, SPACES), text.clean_title(F.col("x"))) == [(v or "").strip() for v in SPACES]


def test_normalize_title(spark):
    values = ["  A \tB\x1cC ", "\x1f", None, "ÀÉ  x"]
    assert apply(column(spark, values), text.normalize_title(F.col("x"))) == ["a b c", "", "", "àé x"]


def test_identifier_keeps_url_and_bare_doi_apart(spark):
    values = [" 10.1/AB ", "https://doi.org/10.1/ab", None]
    assert apply(column(spark, values), text.normalize_identifier(F.col("x"))) == ["10.1/ab", "https://doi.org/10.1/ab", ""]


def test_abstract(spark):
    values = ["&lt;p&gt;a &amp; b</p>\n<i>c</i>", "<p></p>", None, "plain"]
    assert apply(column(spark, values), text.clean_abstract(F.col("x"))) == ["a & b c", None, None, "plain"]


def test_inverted_index(spark):
    df = column(spark, [{"a": [0, 3], "b": [1], "c": [5]}, {}, {"x": [0], "y": [0]}, None, {"z": [-1]}], "map<string,array<int>>")
    assert apply(df, text.inverted_index_text(F.col("x"))) == ["a b a c", None, "y", None, None]


def test_inverted_index_of_words(spark):
    df = column(spark, [[("b", 3), ("a", 6), ("b", 0)], [("", 1), (None, 2)], [], None, [("\xa0", 0), ("x", 1), ("\x1f", 2)]], "array<struct<word: string, at: int>>")
    made = text.inverted_index(F.col("x"))
    assert apply(df, made) == [{"a": [6], "b": [0, 3]}, {"": [1]}, None, None, {"\x1f": [2], "x": [1], "\xa0": [0]}]
    assert apply(df, text.inverted_index_text(made)) == ["b b a", None, None, None, "x"]


@pytest.mark.parametrize("value,want", [("2024-05", 2024), ("May-2021", 2021), ("c. 1999", None), ("12-2001", 12), (None, None), ("", None)])
def test_first_year(spark, value, want):
    assert apply(column(spark, [value]), text.first_year(F.col("x"))) == [want]


def test_contains_is_not_like(spark):
    assert apply(column(spark, ["mat 224", "mat_224", "formats"]), text.contains_any(F.col("x"), ["mat_2", "ormat"])) == [False, True, True]


def test_numbers_as_python_reads_them(spark):
    values = ["1_000", "1.5d", " 2 ", "1e3", "abc", "", None, "nan", "-.5", "5.", "1__0"]
    want = []
    for v in values:
        try:
            want.append(float(v))
        except (TypeError, ValueError):
            want.append(None)
    assert str(apply(column(spark, values), text.number(F.col("x")))) == str(want)


def test_dates(spark):
    values = ["2024-05-01", "2024-05-01T10:00:00Z", "2024-05-01T10:00:00+02:00", "2024-5-1", "2024", "2024-05", "garbage", None, "20240501", "2024-05-01T10:00:00"]
    day = datetime(2024, 5, 1)
    want = [day, day.replace(hour=10), day.replace(hour=8), day, None, None, None, None, day, day.replace(hour=10)]
    got = apply(column(spark, values), F.date_format(dates.parse_date(F.col("x")), "yyyy-MM-dd HH:mm"))
    assert got == [w and w.strftime("%Y-%m-%d %H:%M") for w in want]


def test_rfc822(spark):
    assert apply(column(spark, ["2024-05-01T01:02:03Z"]), dates.rfc822(dates.parse_date(F.col("x")))) == ["Wed, 01 May 2024 01:02:03 +0000"]


def test_recency_limits(spark):
    values = ["2024-01-31T00:00:00", "2024-01-28T00:00:00", "2024-01-27T23:00:00", "2024-01-24T00:00:00", "2024-01-01T00:00:00", "2023-12-31T00:00:00", None, "2024-03-01T00:00:00"]
    at = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    got = apply(column(spark, values), scores.recency(dates.parse_date(F.col("x")), at, 3, 7, 30))
    assert got == [1.0, 1.0, 1.0, 0.7, 0.4, 0.1 if (31 - 0) > 30 else 0.4, 0.0, 1.0]


def test_recent_filter(spark):
    df = column(spark, ["2024-01-01", "2024-01-24", None, "2025-01-01"])
    at = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    assert apply(df, dates.is_recent(dates.parse_date(F.col("x")), at, 7)) == [False, True, False, True]
    assert apply(df, dates.is_recent(dates.parse_date(F.col("x")), at, 0)) == [True] * 4


def test_labels(spark):
    assert apply(column(spark, [0.75, 0.5, 0.49, float("nan")], "double"), scores.label(F.col("x"), 0.75, 0.5)) == ["must_read", "consider", "ignore", "ignore"]


def test_metrics_fall_back(spark):
    df = column(spark, [{"cited_by": 3.0, "is-referenced-by": 9.0}, {"is-referenced-by": 1.0}, {}, {"cited_by": 0.0}], "map<string,double>")
    assert [round(v, 6) for v in apply(df, scores.log_metric(scores.citations(F.col("x"))))] == [1.386294, 0.693147, 0.0, 0.0]


def test_doi_urls(spark):
    values = ["HTTPS://dx.doi.org/1", "http://doi.org/2", "https://x.org/doi.org/", None, ""]
    assert apply(column(spark, values), text.is_doi_url(F.col("x"))) == [True, True, False, False, False]
    assert apply(column(spark, ["10.1/x", " http://doi.org/2"]), text.doi_to_url(F.col("x"))) == ["https://doi.org/10.1/x", "http://doi.org/2"]


def test_common_subsequence():
    assert common_subsequence("kitten", "sitting") == 4
    assert common_subsequence("", "a") == 0


@pytest.mark.parametrize("a,b,want", [("a b", "b a c", 100), ("", "x", 0), ("same words", "words same", 100), ("abc", "abd", 100 * (1 - 2 / 6))])
def test_token_set_ratio(a, b, want):
    assert abs(token_set_ratio(a, b) - want) < 1e-9
