"""The scouting pipeline: candidates -> ranked reading list (everything but the network)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.dates import is_recent
from ..operators.cap import cap_share
from ..operators.dedupe import dedupe, keep_first
from ..operators.enrich import enrich
from ..operators.fanin import union_sources
from ..operators.scoring import rank_order, score
from ..operators.topic import Topics, topic_filter
from ..operators.vectors import nearest
from ..storage import stored


class Steps:
    """AGG8: how many rows came out of each step, observed while the rows pass; no job counts alone."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def passed(self, name: str, df: DataFrame) -> DataFrame:
        self.seen[name] = Observation()
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("n"))

    def removed(self) -> dict[str, int]:
        """Rows that each step but the first removed; to be asked once the last step's rows have been used."""
        counts = [(name, o.get["n"]) for name, o in self.seen.items()]
        return {name: before - n for (_, before), (name, n) in zip(counts, counts[1:])}


def acquire(sources: list[DataFrame], settings: Settings, keep_first_in: frozenset[int] = frozenset({0, 1})) -> DataFrame:
    """Fan-in and topic filter. Sources at the given places are deduped before the filter: a poor first copy may win and be filtered out; that order is part of the result."""
    parts = [keep_first(s, "pos") if i in keep_first_in else s for i, s in enumerate(sources)]
    return topic_filter(union_sources(parts), Topics.of(settings.sources))


Lookups = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def watch(
    candidates: DataFrame,
    library: DataFrame,
    vectors: DataFrame,
    metrics: DataFrame,
    settings: Settings,
    asof: Column,
    top: int = 50,
    lookups: Lookups | None = None,
    steps: Steps | None = None,
) -> DataFrame:
    """Dedupe, score, recency filter, preprint cap, top rows, enrichment; in this order, as each step sees what the one before left.

    ``vectors``: (ordinal, embedding) of candidates; ``library`` holds key, title, doi, url, embedding. ``lookups`` gives
    the tables of works and of resolved addresses for the top rows.
    """
    steps = steps or Steps()
    kept = stored(steps.passed("dedupe", dedupe(steps.passed("candidates", candidates), library)))
    mine = kept.select("ordinal").join(vectors, "ordinal").select(F.col("ordinal").alias("id"), "embedding")
    close = nearest(mine, library.select(F.col("key").alias("id"), "embedding")).select(F.col("id").alias("ordinal"), "similarity")
    ranked = score(kept, close, metrics, settings.scoring, asof)
    ranked = steps.passed("recency", ranked.where(is_recent(F.col("published"), asof, settings.sources.window_days)))
    ranked = steps.passed("preprints", cap_share(ranked, rank_order()))
    if top > 0:
        ranked = ranked.orderBy(*rank_order()).limit(top)
    if lookups is None:
        return ranked
    ranked = stored(ranked)
    return enrich(ranked, *lookups(ranked))
