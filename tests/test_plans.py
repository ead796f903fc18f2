import json
import os
import xml.etree.ElementTree as ET
from datetime import datetime
from html.parser import HTMLParser

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litscout.config import Settings, Sources
from litscout.operators.scoring import rank_order
from litscout.operators.logtable import LogTable
from litscout.plans import queries
from litscout.plans.oracle import SQL
from litscout.plans.watch import acquire, watch
from litscout.schema import LIBRARY
from litscout.sinks import feed, notes, report
from litscout.streaming import sync

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in vars(queries) if n.startswith("q_")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def values(pdf: pd.DataFrame) -> list:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_equals_sql(spark, duck, name):
    got, want = getattr(queries, name)(spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def candidate(spark, n, **changes):
    base = dict(source="graph", identifier=f"i{n}", title=f"title{n} word{n} thing{n}", abstract=None, authors=["A"], doi=None, url=None, published=datetime(2024, 1, 30), venue="V", metrics={}, extra={}, pos=n)
    return base | changes


CANDIDATE = "source string, identifier string, title string, abstract string, authors array<string>, doi string, url string, published timestamp, venue string, metrics map<string,double>, extra map<string,string>, pos bigint"


def test_watch(spark):
    rows = [candidate(spark, i) for i in range(6)] + [candidate(spark, 6, source="arxiv"), candidate(spark, 7, published=None), candidate(spark, 8, title="title1 word1 thing1", identifier="z"), candidate(spark, 9, published=datetime(2023, 1, 1))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATE)
    found = acquire([df], Settings())
    lib = spark.createDataFrame([("k", "title2 word2 thing2", None, None, [1.0, 0.0])], "key string, title string, doi string, url string, embedding array<float>")
    vec = spark.createDataFrame([(i, [i / 10, 1.0]) for i in range(10)], "ordinal bigint, embedding array<float>")
    metrics = spark.createDataFrame([], "title_key string, sjr double")
    asof = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    out = watch(found, lib, vec, metrics, Settings(), asof, top=4)
    got = [r.identifier for r in out.orderBy(*rank_order()).collect()]
    assert got == ["i5", "i4", "i3", "i1"]  # i6, the best, is a preprint and comes before any other row
    assert watch(found, lib, vec, metrics, Settings(sources=Sources(window_days=0)), asof, top=0).count() == 7


RANKED = "ordinal bigint, identifier string, title string, abstract string, authors array<string>, url string, published timestamp, venue string, score double, similarity double, label string"


def ranked(spark):
    return spark.createDataFrame([(0, "i<0>", "A & B", None, [], None, None, None, 0.5, 0.1, "consider"), (1, "i1", '"Q"', "abs", ["X", "Y"], "http://u?a&b", datetime(2024, 1, 1), "V", 0.5, 0.2, "consider"), (2, "i2", "T", "", None, "", None, "", float("nan"), 0.0, "ignore")], RANKED)


def written(write, *args, path, **more):
    write(*args, path=path, **more)
    with open(path, encoding="utf-8") as f:
        return f.read()


def test_feed_is_well_formed(spark, tmp_path):
    asof = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    items = ET.fromstring(written(feed.write_rss, ranked(spark), rank_order(), asof, path=str(tmp_path / "feed.xml"), title="a & b").split("\n", 1)[1]).findall("channel/item")
    assert [i.findtext("title") for i in items] == ["A & B", '"Q"', "T"]  # equal scores keep their order, NaN is last
    assert items[0].findtext("pubDate") == "Wed, 31 Jan 2024 00:00:00 +0000" and items[0].find("link") is None
    assert items[0].findtext("description") == "Published: Unknown\nVenue: Unknown"
    assert items[1].findtext("description").startswith("abs\nPublished: 2024-01-01T00:00:00+00:00")


def test_report_and_notes(spark, tmp_path):
    page = written(report.write_report, ranked(spark), rank_order(), "now", path=str(tmp_path / "r.html"))
    HTMLParser().feed(page)
    assert '<a href="#">A &amp; B</a>' in page and "Score: 0.500" in page and "Authors: X, Y" in page and "&#34;Q&#34;" in page
    assert report.log_lines(ranked(spark), rank_order(), 1) == ["01 | 0.500 | consider | A & B"]
    body = json.loads(notes.push(ranked(spark).where("ordinal < 2"), rank_order(), None, "", dry_run=True))
    assert body[0] == {"itemType": "note", "note": "Recommended due to score 0.500", "tags": [{"tag": "litscout"}, {"tag": "consider"}], "collections": ["DRYRUN"]}


def item(key, version, title):
    return json.dumps({"key": key, "version": version, "data": {"key": key, "version": version, "title": title}})


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    first, second = [item("a", 1, "x"), item("b", 2, "y")], [item("a", 5, "z"), item("c", 6, "w")]
    for i, part in enumerate((first, second)):
        (folder / f"{i}.txt").write_text("\n".join(part))
        os.utime(folder / f"{i}.txt", (1e9 + i, 1e9 + i))
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).select(F.col("value").alias("json"), F.lit(0).cast("bigint").alias("pos"))
    snaps = LogTable(spark, str(tmp_path / "state"), LIBRARY)
    asked = []
    query = sync.start(spark, raw, snaps, str(tmp_path / "check"), lambda since: asked.append(since) or (["b"] if since else []))
    query.awaitTermination(120)
    got = {r.key: (r.version, r.title) for r in snaps.read().collect()}
    assert got == {"a": (5, "z"), "c": (6, "w")} and snaps.pointer()["cursor"] == 6
    assert asked == [0, 2]  # since the cursor before each batch


def test_full_sync_drops_what_is_gone(spark, tmp_path):
    snaps = LogTable(spark, str(tmp_path / "s"), LIBRARY)
    raw = lambda items: spark.createDataFrame([(x, i) for i, x in enumerate(items)], "json string, pos bigint")
    sync.merge(spark, raw([item("a", 1, "x"), item("b", 2, "y")]), snaps)
    counts = sync.merge(spark, raw([item("a", 1, "x")]), snaps, full=True)
    assert [r.key for r in snaps.read().collect()] == ["a"] and counts.fetched == 1


def test_entry_without_llm(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def gone(name, *a, **k):
        if name.startswith("litscout.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert entry.queries() and not any(n.startswith("op") for n in entry.queries()) and "pipeline" not in entry.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["q_inverted_index_text", "q_inverted_gaps"])
def test_texts_are_shuffled_and_not_their_words(spark, name):
    from litscout.plans import source_queries

    plan = getattr(source_queries if name == "q_inverted_gaps" else queries, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan  # no row for each word
