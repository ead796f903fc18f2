"""Notes pushed back to the library (SNK12, SNK13, S29)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.http import Client, linked_pages


def note(score: Column) -> Column:
    """S29."""
    return F.format_string("Recommended due to score %.3f", score)


def payload(collection: str, tag: str = "litscout") -> Column:
    """One note as JSON, with its tags and collection."""
    tags = F.array(F.struct(F.lit(tag).alias("tag")), F.struct(F.col("label").alias("tag")))
    return F.to_json(F.struct(F.lit("note").alias("itemType"), note(F.col("score")).alias("note"), tags.alias("tags"), F.array(F.lit(collection)).alias("collections")))


def collection_key(client: Client, base_url: str, name: str) -> str:
    """SNK13: the key of the collection of that name, looked for on every page; made if there is none."""
    known = {c["data"]["name"]: c["data"]["key"] for page in linked_pages(client, f"{base_url}/collections", {"limit": 100}) for c in page.json()}
    if name not in known:
        answer = client.request("POST", f"{base_url}/collections", body=json.dumps([{"name": name}]).encode()).json()
        try:
            known[name] = answer["successful"]["0"]["data"]["key"]
        except (KeyError, TypeError):
            raise RuntimeError(f"the collection {name} was not made: {answer}") from None
    return known[name]


def push(ranked: DataFrame, order: list[Column], client: Client, base_url: str, name: str = "Suggested", dry_run: bool = True) -> str:
    """One POST of all notes, which are built on the driver, as one request asks for; the body is returned, and by default nothing is sent."""
    key = "DRYRUN" if dry_run else collection_key(client, base_url, name)
    body = "[" + ",".join(r.x for r in ranked.orderBy(*order).select(payload(key).alias("x")).collect()) + "]"  # one request's notes
    if not dry_run and body != "[]":
        client.request("POST", f"{base_url}/items", body=body.encode())
    return body
