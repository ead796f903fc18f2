"""Both commands from end to end, against a server on this machine."""

import json
import xml.etree.ElementTree as ET

import pytest

from litscout import cli
from litscout.operators.logtable import LogTable
from .served import served
from litscout.schema import LIBRARY
from litscout.sources import files


def library(version):
    items = [{"key": f"k{i}", "version": i, "data": {"title": f"Deep learning of proteins {i}", "abstractNote": "protein folding", "date": "2020", "publicationTitle": "Venue A"}} for i in range(1, 8)]

    def pages(q, request):
        if request["headers"].get("authorization") != "Bearer key" or request["headers"].get("x-version") != "3":
            return 403, {}, ""
        if request["headers"].get("if-modified-since-version") == str(version):
            return 304, {}, ""
        a, n = int(q.get("start", 0)), int(q["limit"])
        more = {"Link": f'<{request["url"]}/users/u/items?limit={n}&start={a + n}>; rel="next"'} if a + n < len(items) else {}
        return 200, more, items[a : a + n]

    return pages


WORKS = [
    {"id": f"W{i}", "display_name": f"Protein study number {'abcdefghij'[i] * 7}", "abstract": "protein folding at work", "doi": f"10.1/{i}", "publication_date": "2024-01-25", "cited_by_count": i, "primary_location": {"source": {"display_name": "Venue A"}}}
    for i in range(6)
] + [{"id": "W9", "display_name": "Casino news", "doi": "10.1/9", "publication_date": "2024-01-25"}, {"id": "W10", "display_name": "Old protein", "doi": "10.1/10", "publication_date": "2020-01-25"}]


def test_profile_and_watch(spark, tmp_path, monkeypatch, caplog, capsys):
    monkeypatch.setenv("LITSCOUT_KEY", "key")
    routes = {
        "/users/u/items": library(7), "/users/u/deleted": lambda q, r: {"items": []}, "/works": lambda q, r: {"results": WORKS} if "search" in q else {"primary_location": {"landing_page_url": "http://page"}},
        "/users/u/collections": lambda q, r: {"successful": {"0": {"data": {"key": "NEW"}}}} if r["method"] == "POST" else [], "/users/u/items/": lambda q, r: {},
    }
    with served(routes) as web:
        config = tmp_path / "config"
        config.mkdir()
        (config / "library.yaml").write_text(f"api: {{base_url: '{web.url}', user_id: u, api_key_env: LITSCOUT_KEY, page_size: 3, polite_delay_ms: 0, headers: {{X-Version: '3'}}}}")
        off = ", ".join(f"{n}: {{enabled: false}}" for n in ("registry", "feed", "bio", "med", "unified"))
        (config / "sources.yaml").write_text(f"{{window_days: 30, queries: [protein], exclude_keywords: [casino], graph: {{base_url: '{web.url}/works'}}, {off}}}")
        (config / "scoring.yaml").write_text("{}")
        base = ["--base-dir", str(tmp_path), "--asof", "2024-01-31 00:00:00"]
        with pytest.raises(FileNotFoundError):
            cli.main(["watch", *base])  # no profile yet
        with caplog.at_level("INFO"):
            cli.main(["profile", *base, "--full"])
        assert "library: 7 fetched, 7 updated, 0 removed" in caplog.text and "embedded 7 rows" in caplog.text
        doc = json.loads((tmp_path / "data" / "profile.json").read_text())
        assert doc["item_count"] == 7 and doc["top_venues"][0] == {"count": 7, "venue": "Venue A"} and list(doc) == sorted(doc)
        assert files.index(spark, f"{tmp_path}/data/vectors").count() == 7
        caplog.clear()
        with caplog.at_level("INFO"):
            cli.main(["profile", *base])  # nothing changed: nothing is embedded again
        assert "library: 0 fetched" in caplog.text and "embedded 0 rows" in caplog.text
        caplog.clear()
        with caplog.at_level("INFO"):
            cli.main(["watch", *base, "--rss", "--report", "--top", "4", "--push"])
        assert "recency removed 1 rows" in caplog.text and "dedupe removed 0 rows" in caplog.text
    items = list(ET.parse(tmp_path / "reports" / "feed.xml").getroot().iter("item"))
    assert [i.findtext("guid") for i in items] == ["W5", "W4", "W3", "W2"] and items[0].findtext("link") is None
    assert (tmp_path / "reports" / "report-20240131.html").read_text().count("<section>") == 4
    assert len(json.loads(capsys.readouterr().out.strip().splitlines()[-1])) == 4
    assert LogTable(spark, f"{tmp_path}/data/library", LIBRARY).read().where("embedding IS NOT NULL").count() == 7
