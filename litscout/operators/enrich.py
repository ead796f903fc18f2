"""Enrichment of ranked rows from lookups (FLT11, JN9, PRJ12, S28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_doi_url, landing_url


def needs_lookup() -> Column:
    """FLT11: there is a DOI, and no abstract or a DOI's URL."""
    no_abstract = F.coalesce(F.col("abstract"), F.lit("")) == ""
    return (F.coalesce(F.col("doi"), F.lit("")) != "") & (no_abstract | is_doi_url(F.col("url")))


def enrich(ranked: DataFrame, works: DataFrame, resolved: DataFrame) -> DataFrame:
    """JN9: abstract and URL filled in. ``works``: (doi, abstract, landing_page), ``resolved``: (doi, resolved_url), DOIs distinct.

    Only rows that need it meet the lookups; scores stay as they are. Call it after the top rows are cut.
    """
    names = ranked.columns
    wanted = F.when(needs_lookup(), F.col("doi"))
    out = ranked.withColumn("__doi", wanted).join(works.select(F.col("doi").alias("__doi"), F.col("abstract").alias("__abstract"), F.col("landing_page").alias("__page")), "__doi", "left")
    out = out.join(resolved.select("doi", F.col("resolved_url").alias("__resolved")), "doi", "left")
    abstract = F.when(F.coalesce(F.col("abstract"), F.lit("")) != "", F.col("abstract")).otherwise(F.coalesce("__abstract", "abstract"))
    out = out.withColumn("abstract", abstract).withColumn("url", landing_url(F.col("url"), F.col("__page"), F.col("__resolved")))
    return out.select(*names)
