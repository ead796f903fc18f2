"""Schemas of the scouting tables."""

from __future__ import annotations

LIBRARY = (
    "key STRING, version BIGINT, title STRING, abstract STRING, creators ARRAY<STRING>, tags ARRAY<STRING>, collections ARRAY<STRING>, "
    "year INT, doi STRING, url STRING, raw STRING, content_hash STRING, embedding ARRAY<FLOAT>, updated_at TIMESTAMP"
)

#: ``extra`` holds JSON text per key; ``ordinal`` keeps the order of sources, queries and positions.
CANDIDATES = (
    "source STRING, identifier STRING, title STRING, abstract STRING, authors ARRAY<STRING>, doi STRING, url STRING, published TIMESTAMP, "
    "venue STRING, metrics MAP<STRING, DOUBLE>, extra MAP<STRING, STRING>, ordinal BIGINT"
)

CANDIDATE_COLUMNS = ["source", "identifier", "title", "abstract", "authors", "doi", "url", "published", "venue", "metrics", "extra"]

RANKED_COLUMNS = ["score", "similarity", "recency_score", "metric_score", "author_bonus", "venue_bonus", "journal_quality", "journal_sjr", "label"]
