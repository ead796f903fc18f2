"""The web clients against a server on this machine, which answers from the rows of small tables; results are held against SQL over these tables."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from litscout.config import LibraryApi, Settings, Sources, build
from litscout.operators import scoring
from litscout.operators.logtable import LogTable
from litscout.plans.queries import asof, candidates, t
from litscout.plans.source_oracle import EVENTS
from litscout.plans.source_queries import NOW, to_score
from litscout.schema import CANDIDATE_COLUMNS, LIBRARY
from litscout.sinks import notes, report
from litscout.sources import fetch, files, lookups
from litscout.sources.http import Client
from litscout.storage import shared_dir, stored
from litscout.streaming import sync

from .served import served

DATA = "/root/testdata/sf0.001"
NATION = "CAST(n_nationkey AS VARCHAR)"


def nations(s, d) -> list[dict]:
    return [r.asDict() for r in t(s, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows


def web_library_api(s, d):
    """SRC1 to SRC3, SRC26, SRC27, INC1, INC4: pages by link header, a key, busy servers, an unchanged library, deletions since the old cursor."""
    rows = nations(s, d)
    items = [{"key": f"n{r['n_nationkey']}", "version": r["n_nationkey"] + 1, "data": {"title": r["n_name"]}} for r in rows]

    def pages(q, request):
        if request["headers"].get("authorization") != "Bearer key" or request["headers"].get("x-version") != "3":
            return 403, {}, ""
        if request["headers"].get("if-modified-since-version") == "25":
            return 304, {}, ""
        a, n = int(q.get("start", 0)), int(q["limit"])
        more = {"Link": f'<{request["url"]}/users/u/items?limit={n}&start={a + n}>; rel="next"'} if a + n < len(items) else {}
        return 200, more, items[a : a + n]

    gone = lambda q, request: {"items": ["n3"] if int(q["since"]) == 0 else ["n4"]}
    snaps = LogTable(s, shared_dir(s), LIBRARY)
    os.environ["LITSCOUT_QUERY_KEY"] = "key"
    with served({"/users/u/items": pages, "/users/u/deleted": gone}, failing=1) as web:
        api = LibraryApi(web.url, "u", "LITSCOUT_QUERY_KEY", {"X-Version": "3"}, page_size=10, polite_delay_ms=0)
        one = sync.library(s, api, snaps, asof=asof())
        two = sync.library(s, api, snaps, asof=asof())  # 304: nothing is read, nothing deleted
        asked = web.asked["/users/u/items"]
    out = snaps.read().select("key", "version", "title")
    return out.select("*", *[F.lit(x).cast("bigint").alias(n) for n, x in (("fetched", one.fetched), ("removed", one.removed), ("again", two.fetched), ("requests", asked))])


def web_unified_api(s, d):
    """SRC4, SRC10, SRC12, SRC26, SRC27: the unified interface by offset, with its own key header and page size."""
    items = [{"id": str(r["n_nationkey"]), "title": r["n_name"], "source": "unified", "published_at": "2024-01-20"} for r in nations(s, d)]

    def page(q, request):
        if request["headers"].get("x-api-key") != "k" or q["sources"] != "graph,registry":
            return 403, {}, ""
        a, n = int(q["offset"]), int(q["limit"])
        return {"data": items[a : a + n], "paging": {"next_offset": a + n if a + n < len(items) else None}}

    off = {"enabled": False}
    with served({"/works": page}, failing=1) as web:
        unified = {"base_url": f"{web.url}/works", "api_key_value": "k", "api_key_env": "LITSCOUT_UNIFIED_KEY", "page_size": 7}
        made = Settings(sources=build(Sources, {"unified": unified, "feed": off, "bio": off, "med": off, "exclude_keywords": ["united"]}))
        out = fetch.fetch_all(s, fetch.Endpoints.of(made.sources), made, files.Snapshot(s, shared_dir(s)), NOW)
        asked = web.asked["/works"]
    return out.select("source", "identifier", "title", "ordinal", F.lit(asked).cast("bigint").alias("requests"))


def web_fetch_all(s, d):
    """SRC5 to SRC14, SNK9, SRC29: every source, one of which fails, and the venue scan."""
    rows = nations(s, d)
    entry = "<entry><id>f{0}</id><title>Feed {1}</title><author><name>A</name></author><link href='http://l'/><published>2024-01-20T00:00:00Z</published></entry>"
    graph = lambda q, r: {"results": [{"id": f"{q['search']}{x['n_nationkey']}", "display_name": f"Graph {x['n_name']}"} for x in rows[:10]]} if q["search"] != "bad" else (404, {}, "")
    registry = lambda q, r: {"message": {"items": [{"title": [f"{q.get('query', 'venue')} {x['n_name']}"], "DOI": f"10.{q.get('query', 'v')}/{x['n_nationkey']}", "container-title": ["own"]} for x in rows[10:14]]}}
    feed = lambda q, r: "<feed xmlns='http://www.w3.org/2005/Atom'>" + "".join(entry.format(x["n_nationkey"], x["n_name"]) for x in rows[14:20]) + "</feed>"
    bio = lambda q, r: {"collection": [{"title": x["n_name"], "doi": f"10.b/{x['n_nationkey']}", "authors": "A; B"} for x in rows[20:]]}
    with served({"/graph": graph, "/registry": registry, "/feed": feed, "/bio": bio}) as web:
        at = {n: {"base_url": f"{web.url}/{n}"} for n in ("graph", "registry", "bio", "med")}  # med: not found
        made = Settings(sources=build(Sources, at | {"feed": {"base_url": f"{web.url}/feed", "categories": ["cs", "q"]}, "unified": {"enabled": False}, "queries": ["x", "bad", " "], "tracked_venues": ["V1", " "], "window_days": 30}))
        out = fetch.fetch_all(s, fetch.Endpoints.of(made.sources), made, files.Snapshot(s, shared_dir(s)), NOW, ["V1", "V2"])
    return out.select("source", "identifier", "title", "venue", (F.col("ordinal") / F.lit(1 << 40)).cast("int").alias("place"))


def web_failed_sources(s, d):
    """SRC11, AGG10, INC7: every source fails, so the stale snapshot stays."""
    snap = files.Snapshot(s, shared_dir(s))
    snap.write(candidates(s, d)[2].select(*CANDIDATE_COLUMNS, F.col("pos").alias("ordinal")), NOW - timedelta(days=3))
    with served({}) as web:  # nothing is found there
        made = Settings(sources=build(Sources, {"bio": {"base_url": web.url}, "unified": {"enabled": False}, "graph": {"enabled": False}, "registry": {"enabled": False}, "feed": {"enabled": False}, "med": {"enabled": False}}))
        out = fetch.fetch_all(s, fetch.Endpoints.of(made.sources), made, snap, NOW)
    return out.select("identifier", F.md5("title").alias("title"))


def web_lookups(s, d):
    """SRC24, SRC25, JN9: works by DOI, not found ones left out; where redirects end."""
    known = {str(r["n_nationkey"]): r["n_name"] for r in nations(s, d)}

    def work(q, request):
        n = request["path"].rsplit("/", 1)[-1]
        return {"abstract_inverted_index": {known[n]: [1], "of": [0]}, "primary_location": {"landing_page_url": f"http://page/{n}"}} if int(n) % 2 else (404, {}, "")

    def go(q, request):
        n = request["path"].rsplit("/", 1)[-1]
        return (302, {"Location": f"{request['url']}/end/{n}"}, "") if int(n) % 3 else (404, {}, "")

    with served({"/works": work, "/doi": go, "/end": lambda q, r: "here"}) as web:
        x = t(s, d, "nation").select("n_nationkey", F.concat(F.lit(f"{web.url}/doi/"), F.col("n_nationkey").cast("string")).alias("doi"))
        works = stored(lookups.works_by_doi(x, f"{web.url}/works"))
        found = stored(lookups.resolve(x))
    out = x.join(works, "doi", "left").join(found, "doi", "left")
    return out.select("n_nationkey", "abstract", F.col("landing_page").alias("page"), F.regexp_extract("resolved_url", "/end/[0-9]+$", 0).alias("resolved"))


def web_push(s, d):
    """SNK12, SNK13, SNK14, S29: a collection looked for on every page and made, all notes in one request, log lines."""
    ranked = to_score(s, d).select("ordinal", F.col("source").alias("title"), (F.col("ordinal") / 10).alias("score"), F.lit("consider").alias("label"))
    ranked = ranked.orderBy(*scoring.rank_order()).limit(20)

    def collections(q, request):
        if request["method"] == "POST":
            return {"successful": {"0": {"data": {"key": "NEW"}}}}
        more = {"Link": f'<{request["url"]}/collections?page=2>; rel="next"'} if "page" not in q else {}
        return 200, more, [{"data": {"name": f"c{q.get('page', 1)}", "key": "K" + q.get("page", "1")}}]

    with served({"/collections": collections, "/items": lambda q, r: {}}) as web:
        found = notes.collection_key(Client(), web.url, "c2")
        notes.push(ranked, scoring.rank_order(), Client(), web.url, dry_run=False)
        body = web.posted[1]
    sent = [(i, found, x["note"], x["collections"][0], line) for i, (x, line) in enumerate(zip(body, report.log_lines(ranked, scoring.rank_order())))]
    return s.createDataFrame(sent, "pos bigint, found string, note string, collection string, line string")


WANT = {
    "library_api": "SELECT 'n' || n_nationkey AS key, CAST(n_nationkey + 1 AS BIGINT) AS version, n_name AS title, CAST(25 AS BIGINT) AS fetched, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS again, CAST(5 AS BIGINT) AS requests FROM nation WHERE n_nationkey <> 3",
    "unified_api": f"SELECT 'unified' AS source, {NATION} AS identifier, n_name AS title, CAST(n_nationkey AS BIGINT) AS ordinal, CAST(5 AS BIGINT) AS requests FROM nation WHERE NOT contains(lower(n_name), 'united')",
    "fetch_all": f"""SELECT 'graph' AS source, 'x' || n_nationkey AS identifier, 'Graph ' || n_name AS title, NULL AS venue, 0 AS place FROM nation WHERE n_nationkey < 10
        UNION ALL SELECT 'registry', '10.' || q || '/' || n_nationkey, q || ' ' || n_name, 'own', 1 FROM nation, (VALUES ('x'), ('bad')) AS v(q) WHERE n_nationkey BETWEEN 10 AND 13
        UNION ALL SELECT 'arxiv', 'f' || n_nationkey, 'Feed ' || n_name, 'arXiv', 2 FROM nation WHERE n_nationkey BETWEEN 14 AND 19
        UNION ALL SELECT 'biorxiv', '10.b/' || n_nationkey, n_name, 'biorxiv', 3 FROM nation WHERE n_nationkey >= 20
        UNION ALL SELECT 'registry', '10.v/' || n_nationkey, 'venue ' || n_name, 'V1', 4 FROM nation WHERE n_nationkey BETWEEN 10 AND 13""",
    "failed_sources": "SELECT CAST(item_id AS VARCHAR) AS identifier, md5(text) AS title FROM benchmark",
    "lookups": """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN 'of ' || n_name END AS abstract, CASE WHEN n_nationkey % 2 = 1 THEN 'http://page/' || n_nationkey END AS page,
        CASE WHEN n_nationkey % 3 <> 0 THEN '/end/' || n_nationkey END AS resolved FROM nation""",
    "push": f"""SELECT k - 1 AS pos, 'K2' AS found, 'Recommended due to score ' || printf('%.3f', score) AS note, 'NEW' AS collection, printf('%02d | %.3f | consider | %s', k, score, source) AS line
        FROM (SELECT row_number() OVER (ORDER BY doc_id DESC) AS k, doc_id / 10.0::DOUBLE AS score, source FROM {EVENTS}) WHERE k <= 10""",
}


@pytest.mark.parametrize("name", list(WANT))
def test_web(spark, name):
    got = globals()[f"web_{name}"](spark, DATA)
    db = duckdb.connect()
    for table in ("nation", "benchmark", "documents", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    names = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({WANT[name]})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want, key=repr)
