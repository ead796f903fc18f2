import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from litscout.config import Library, Settings, build, expand, load_settings
from litscout.functions.embed import HashingEmbedder, embed
from litscout.schema import CANDIDATES
from litscout.sources import fetch, files, lookups, payloads
from litscout.sources.datasource import LibrarySource, WorksSource
from litscout.sources.http import Client, Response, next_link, offset_pages


def raw(spark, items, **more):
    return spark.createDataFrame([(json.dumps(x), i, *more.values()) for i, x in enumerate(items)], ", ".join(["json string", "pos bigint", *(f"{k} string" for k in more)]))


def test_library_items(spark):
    items = [
        {"key": "K", "version": 5, "data": {"key": "D", "version": 0, "title": "T", "creators": [{"firstName": "A", "lastName": "B"}, {"lastName": ""}, {}], "tags": [{"tag": "x"}, "plain"], "date": "2020-05", "collections": ["c"], "publicationTitle": "V"}},
        {"key": "K2", "version": 3},
    ]
    a, b = payloads.library_items(raw(spark, items)).orderBy("ordinal").collect()
    assert (a.key, a.version, a.title, a.creators, a.tags, a.year, a.collections) == ("D", 5, "T", ["A B"], ["x"], 2020, ["c"])
    assert (b.key, b.version, b.title, b.creators, b.tags) == ("K2", 3, "", [], [])


def test_unified(spark):
    items = [
        {"id": "1", "title": " T ", "authors": ["A", " ", "B "], "metrics": {"cited_by": "3", "x": "n/a", "y": 2}, "published_at": "2024-05-01", "candidate_type": "p"},
        {"id": "2", "title": "U", "authors": "Solo", "source": "s", "source_identifier": "sid", "published_at": 1714521600},
        {"id": "3", "title": "  "},
    ]
    got = payloads.unified_candidates(raw(spark, items)).orderBy("pos").collect()
    assert len(got) == 2
    assert (got[0].source, got[0].identifier, got[0].title, got[0].authors, got[0].metrics) == ("public-api", "1", "T", ["A", "B"], {"cited_by": 3.0, "y": 2.0})
    assert got[0].extra == {"candidate_type": "p", "public_id": "1"}
    assert (got[1].authors, got[1].identifier, got[1].published) == (["Solo"], "sid", datetime(2024, 5, 1))


def test_graph(spark):
    items = [
        {"id": "W1", "display_name": "T", "abstract_inverted_index": {"b": [1], "a": [0, 3]}, "authorships": [{"author": {"display_name": "N"}}, {"author": {}}], "primary_location": {"landing_page_url": "L", "source": {"display_name": "V"}}, "publication_date": "2024-01-02", "cited_by_count": 4},
        {"doi": "10.1", "display_name": "U", "abstract": {"text": "obj"}},
        {"display_name": "S", "abstract": " str "},
    ]
    a, b, c = payloads.graph_candidates(raw(spark, items, query="q")).orderBy("pos").collect()
    assert (a.abstract, a.authors, a.url, a.venue, a.metrics) == ("a b a", ["N", ""], "L", "V", {"cited_by": 4.0})
    assert (b.identifier, b.abstract, b.metrics) == ("10.1", "obj", {"cited_by": 0.0})
    assert (c.identifier, c.abstract, c.extra["query"]) == ("S", "str", "q")


def test_registry_and_preprints(spark):
    items = [{"title": ["T", "x"], "DOI": "10.2", "author": [{"given": "G", "family": "F"}, {}], "abstract": "<p>a&amp;b</p>", "created": {"date-time": "2024-01-02T03:04:05Z"}, "container-title": [], "is-referenced-by-count": 2}, {"title": [], "URL": "u"}]
    (a,) = payloads.registry_candidates(raw(spark, items, query="q")).collect()
    assert (a.identifier, a.authors, a.abstract, a.venue, a.published) == ("10.2", ["G F"], "a&b", None, datetime(2024, 1, 2, 3, 4, 5))
    (p,) = payloads.preprint_candidates(raw(spark, [{"title": "P", "doi": "10.3", "authors": "A; B;;", "date": "2024-02-03"}]), "biorxiv").collect()
    assert (p.authors, p.url, p.source) == (["A", "B"], "https://doi.org/10.3", "biorxiv")


def test_feed(spark):
    df = spark.createDataFrame([("i", "T", "S", [("A",), (None,)], None, "http://l", "2024-01-01T00:00:00Z", "cs", 0)], "id string, title string, summary string, author array<struct<name string>>, doi string, link string, published string, category string, pos bigint")
    r = payloads.feed_candidates(df).first()
    assert (r.source, r.authors, r.venue, r.extra) == ("arxiv", ["A"], "arXiv", {"primary_category": "cs"})


def test_journal_metrics_last_line_wins(spark, tmp_path):
    (tmp_path / "m.csv").write_text("title,sjr\n A ,1.5\na,2.5\nb,x\n,3\nc,\n")
    assert {r.title_key: r.sjr for r in files.journal_metrics(spark, str(tmp_path / "m.csv")).collect()} == {"a": 2.5}
    assert files.journal_metrics(spark, str(tmp_path / "none.csv")).count() == 0


def test_snapshot(spark, tmp_path):
    s, now = files.Snapshot(spark, str(tmp_path / "c")), datetime(2024, 1, 1)
    assert s.newest() is None
    empty = spark.createDataFrame([], CANDIDATES)
    s.write(empty, now)
    at, rows = s.newest()
    assert at == now and rows.count() == 0
    assert files.is_fresh(at, now + timedelta(hours=12)) and not files.is_fresh(at, now + timedelta(hours=12, seconds=1))
    assert files.candidates_or_stale(empty, True, s, now + timedelta(days=1)).count() == 0
    assert s.newest()[0] == now + timedelta(days=1)


def test_missing_profile_and_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.profile(spark, str(tmp_path / "p.json"))
    rows = spark.createDataFrame([("a", None), ("b", [1.0])], "key string, embedding array<float>")
    files.write_index(rows.where("key = 'a'"), str(tmp_path / "v"))
    with pytest.raises(ValueError):
        files.index(spark, str(tmp_path / "v"))
    files.write_index(rows, str(tmp_path / "v"))
    assert [(r.key, r.embedding) for r in files.index(spark, str(tmp_path / "v")).collect()] == [("b", [1.0])]
    (tmp_path / "bad.json").write_text("{no json")
    assert fetch.profile_venues(spark, str(tmp_path / "bad.json")) == fetch.profile_venues(spark, str(tmp_path / "none.json")) == []


def test_next_link():
    assert next_link('<http://a>; rel="first", <http://b?x=1>; rel="next"') == "http://b?x=1"
    assert next_link(None) is None


class Scripted(Client):
    def __init__(self, replies):
        self.waits = []
        super().__init__(sleep=self.waits.append)
        self.replies, self.asked = list(replies), []

    def send(self, method, url, body):
        self.asked.append(url)
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


def test_retries():
    c = Scripted([Response(503, {}), TimeoutError(), Response(200, {}, b"[]")])
    assert c.request("GET", "http://x").json() == [] and c.waits == [1.5, 3.0]
    with pytest.raises(OSError):
        Scripted([Response(500, {})] * 3).request("GET", "http://x")
    c = Scripted([Response(404, {})])
    with pytest.raises(OSError):
        c.request("GET", "http://x")
    assert len(c.asked) == 1


def test_offset_pages_end():
    page = lambda items, after: Response(200, {}, json.dumps({"data": items, "paging": {"next_offset": after}}).encode())
    assert list(offset_pages(Scripted([page([1], 1), page([2], 1)]), "u", {})) == [[1], [2]]
    assert list(offset_pages(Scripted([page([], 5)]), "u", {})) == [[]]


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            headers = {"Last-Modified-Version": "9"}
            if "/items" in self.path:
                body = [{"key": "b", "version": 2}] if "page" in q else [{"key": "a", "version": 1}]
                if "page" not in q:
                    headers["Link"] = f'<http://127.0.0.1:{self.server.server_port}/items?page=2>; rel="next"'
            elif self.path.startswith("/doi"):
                body = {"abstract_inverted_index": {"found": [0]}, "primary_location": {"landing_page_url": "http://page"}}
            elif "query" in q or "from-created-date" in str(q.get("filter")):
                body = {"message": {"items": [{"title": ["R"], "DOI": "10.9", "container-title": ["own"]}]}}
            elif q.get("search") == ["bad"]:
                self.send_response(404)
                self.end_headers()
                return
            else:
                body = {"results": [{"id": f"{q['search'][0]}{i}", "display_name": "T"} for i in range(3)]}
            self.send_response(200)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_data_sources(spark, server):
    spark.dataSource.register(WorksSource)
    spark.dataSource.register(LibrarySource)
    asks = json.dumps([{"search": q, "_query": q} for q in ("x", "bad", "y")])
    df = spark.read.format("works").option("url", server).option("requests", asks).load()
    assert df.rdd.getNumPartitions() == 3
    got = payloads.graph_candidates(df).orderBy("pos").collect()
    assert [r.identifier for r in got] == ["x0", "x1", "x2", "y0", "y1", "y2"] and got[3].extra["query"] == "y"
    lib = payloads.library_items(spark.read.format("library").option("url", server).load())
    assert [r.key for r in lib.orderBy("ordinal").collect()] == ["a", "b"]


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_MAIL", "me@x")
    (tmp_path / "library.yaml").write_text("mode: api\napi: {user_id: '1', page_size: 5}\n")
    (tmp_path / "sources.yaml").write_text("window_days: 9\ngraph: {enabled: true, mailto: $SOME_MAIL}\nbio: {enabled: false}\nqueries: [' a ', ' ']\nunknown: 1\n")
    (tmp_path / "scoring.yaml").write_text("weights: {similarity: 0.62}\ndecay_days: {fast: 3}\n")
    s = load_settings(tmp_path)
    assert isinstance(s, Settings) and s.library.api.page_size == 5 and s.sources.graph.mailto == "me@x"
    assert s.sources.topic_queries() == ["a"] and s.sources.enabled() == ["graph", "registry", "feed", "med"] and s.scoring.weights.similarity == 0.62
    assert expand("$NOT_SET_AT_ALL") == "$NOT_SET_AT_ALL"
    with pytest.raises(ValueError):
        build(Library, {"mode": "zzz"})


def test_fetch_all(spark, server, tmp_path):
    s = Settings()
    s.sources.queries, s.sources.tracked_venues, s.sources.unified.enabled = ["x", "bad"], ["Tracked"], False
    snap, now = files.Snapshot(spark, str(tmp_path / "snap")), datetime(2024, 1, 31)
    got = fetch.fetch_all(spark, fetch.Endpoints(graph=server, registry=server), s, snap, now).orderBy("ordinal").collect()
    assert [(r.source, r.identifier, r.venue) for r in got] == [("graph", "x0", None), ("graph", "x1", None), ("graph", "x2", None), ("registry", "10.9", "own")]
    s.sources.exclude_keywords = ["own"]  # a fresh snapshot is filtered with the current terms
    again = fetch.fetch_all(spark, fetch.Endpoints(), s, snap, now + timedelta(hours=1))
    assert again.count() == 3
    assert fetch.tracked_venues(["b", " ", "a"], ["a", "c"]) == ["b", "a", "c"]
    found, extra = fetch.scan(spark, fetch.Endpoints(registry=server), s, now, [])
    assert [f.name for f in found] == ["registry"] and extra.first().venue == "Tracked"


def test_feed_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i1</id><title> T </title><author><name>A</name></author><link href="http://l"/><published>2024-01-01T00:00:00Z</published></entry></feed>')
    r = fetch.read_feed(spark, str(tmp_path / "f.xml")).first()
    assert (r.identifier, r.title, r.authors, r.url, r.published) == ("i1", "T", ["A"], "http://l", datetime(2024, 1, 1))


def test_lookups(spark, server):
    df = spark.createDataFrame([("10.1",), ("10.1",), ("",), (None,)], "doi string")
    (r,) = lookups.works_by_doi(df, f"{server}/doi", tasks=1).collect()
    assert (r.doi, r.abstract, r.landing_page) == ("10.1", "found", "http://page")
    url = spark.createDataFrame([(f"{server}/doi/x",)], "doi string")
    assert lookups.resolve(url, tasks=1).first().resolved_url == f"{server}/doi/x"


def test_embed(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None)], "i int, text string")
    got = {r.i: r.embedding for r in embed(df, HashingEmbedder(8)).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[3] == [0.0] * 8
