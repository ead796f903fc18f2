"""Online lookups for enrichment (SRC24, SRC25): only for the top rows, one client a task; failures give null."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doi_to_url, is_doi_url
from . import payloads
from .http import Client


def works_by_doi(dois: DataFrame, url: str, mailto: str = "", tasks: int = 4) -> DataFrame:
    """SRC24: (doi, abstract, landing_page) for distinct DOIs; not found and failed ones are left out."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(timeout_s=20)
        for pdf in batches:
            found = []
            for doi, target in zip(pdf["doi"], pdf["target"]):
                try:
                    body = client.request("GET", f"{url}/{quote(target, safe=':/')}", {"mailto": mailto}).json()
                    found.append((doi, json.dumps(body)))
                except (OSError, ValueError):
                    continue
            yield pd.DataFrame(found, columns=["doi", "json"])

    wanted = dois.where("doi <> ''").select("doi", doi_to_url(F.col("doi")).alias("target")).distinct().repartition(tasks)
    raw = wanted.mapInPandas(ask, "doi string, json string")
    x = raw.select("doi", F.from_json("json", payloads.GRAPH_WORK).alias("x"))
    return x.select("doi", payloads.graph_abstract().alias("abstract"), F.col("x.primary_location.landing_page_url").alias("landing_page"))


def resolve(dois: DataFrame, tasks: int = 4) -> DataFrame:
    """SRC25: (doi, resolved_url), where a DOI's redirects end; a URL that is still a DOI's is left out."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for doi, target in zip(pdf["doi"], pdf["target"]):
                try:
                    with urllib.request.urlopen(target, timeout=20) as r:
                        found.append((doi, r.geturl()))
                except (OSError, ValueError, urllib.error.URLError):
                    continue
            yield pd.DataFrame(found, columns=["doi", "resolved_url"])

    wanted = dois.where("doi <> ''").select("doi", doi_to_url(F.col("doi")).alias("target")).distinct().repartition(tasks)
    return wanted.mapInPandas(follow, "doi string, resolved_url string").where(~is_doi_url(F.col("resolved_url")))
