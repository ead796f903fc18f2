"""Scores and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import elapsed_days


def recency(published: Column, asof: Column, fast: int = 30, medium: int = 60, slow: int = 180) -> Column:
    """1.0, 0.7, 0.4 or 0.1 by age, limits included; null dates 0."""
    days = elapsed_days(published, asof)
    steps = F.when(days <= fast, F.lit(1.0)).when(days <= medium, F.lit(0.7)).when(days <= slow, F.lit(0.4)).otherwise(F.lit(0.1))
    return F.when(published.isNull(), F.lit(0.0)).otherwise(steps)


def log_metric(value: Column) -> Column:
    """log(1 + value), 0 for null and 0; values below -1 are not expected."""
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.log1p(value))


def citations(metrics: Column) -> Column:
    """The citation count: one source's key, else the other's, else 0."""
    return F.coalesce(F.element_at(metrics, "cited_by"), F.element_at(metrics, "is-referenced-by"), F.lit(0.0))


def altmetric(metrics: Column) -> Column:
    return F.coalesce(F.element_at(metrics, "altmetric"), F.lit(0.0))


def journal_quality(value: Column) -> Column:
    """log(1 + value), at least 1; 1 where there is none."""
    return F.coalesce(F.greatest(F.log1p(value), F.lit(1.0)), F.lit(1.0))


def weighted(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """The sum in the order of ``terms``; weights are used as they are, they need not sum to 1."""
    total = None
    for name, term in terms.items():
        part = term * F.lit(float(weights.get(name, 0.0)))
        total = part if total is None else total + part
    return total


def label(score: Column, must_read: float, consider: float) -> Column:
    """Limits included; NaN is ``ignore``."""
    return F.when(F.isnan(score), "ignore").when(score >= must_read, "must_read").when(score >= consider, "consider").otherwise("ignore")


def bonus(values: Column, whitelist: list[str]) -> Column:
    """JN8: 1 if any value is listed, letter case aside; blanks count."""
    listed = sorted({w.lower() for w in whitelist})
    if not listed:
        return F.lit(0.0)
    hit = F.exists(values, lambda v: F.coalesce((v != "") & F.lower(v).isin(listed), F.lit(False)))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)
