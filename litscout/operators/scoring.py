"""Scoring of candidates (JN7, JN8, S15 to S20, PRJ11, SRT1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions import scores
from ..functions.text import strip
from ..schema import CANDIDATE_COLUMNS, RANKED_COLUMNS


def with_journal(candidates: DataFrame, metrics: DataFrame) -> DataFrame:
    """JN7: journal_quality and journal_sjr by venue, stripped and lower case; 1.0 and null on a miss. ``metrics``: (title_key, sjr), keys distinct."""
    key = F.when(F.col("venue") != "", strip(F.lower(F.col("venue"))))
    out = candidates.withColumn("__venue", key).join(metrics.select(F.col("title_key").alias("__venue"), F.col("sjr").alias("journal_sjr")), "__venue", "left")
    return out.drop("__venue").withColumn("journal_quality", scores.journal_quality(F.col("journal_sjr")))


def score(candidates: DataFrame, similarity: DataFrame, metrics: DataFrame, settings: Scoring, asof: Column) -> DataFrame:
    """PRJ11: candidates with the nine columns of a ranked row. ``similarity``: (ordinal, similarity), 0 where missing."""
    decay, w = settings.decay_days, settings.weights.as_dict()
    out = with_journal(candidates.join(similarity.select("ordinal", F.col("similarity").alias("__sim")), "ordinal", "left"), metrics)
    metric = F.coalesce(F.col("metrics"), F.create_map().cast("map<string,double>"))
    out = (
        out.withColumn("similarity", F.coalesce("__sim", F.lit(0.0)))
        .withColumn("recency_score", scores.recency(F.col("published"), asof, decay.get("fast", 30), decay.get("medium", 60), decay.get("slow", 180)))
        .withColumn("metric_score", scores.log_metric(scores.citations(metric)))
        .withColumn("__alt", scores.log_metric(scores.altmetric(metric)))
        .withColumn("author_bonus", scores.bonus(F.col("authors"), settings.whitelist_authors))
        .withColumn("venue_bonus", scores.bonus(F.array("venue"), settings.whitelist_venues))
    )
    terms = {"similarity": "similarity", "recency": "recency_score", "citations": "metric_score", "altmetric": "__alt", "journal_quality": "journal_quality", "author_bonus": "author_bonus", "venue_bonus": "venue_bonus"}
    out = out.withColumn("score", scores.weighted({k: F.col(c) for k, c in terms.items()}, w))
    out = out.withColumn("label", scores.label(F.col("score"), settings.thresholds.must_read, settings.thresholds.consider))
    return out.select("ordinal", *CANDIDATE_COLUMNS, *RANKED_COLUMNS)


def rank_order() -> list[Column]:
    """SRT1: score falling, NaN last, ties in input order."""
    return [F.isnan("score"), F.desc("score"), F.asc("ordinal")]
