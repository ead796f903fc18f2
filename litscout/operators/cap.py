"""Share cap on preprints (WIN3)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored

PREPRINTS = ("arxiv", "biorxiv", "medrxiv")


def cap_share(ranked: DataFrame, order: list[Column], source: str = "source", share: float = 0.3, names: tuple[str, ...] = PREPRINTS) -> DataFrame:
    """Rows in ``order``, preprints left out where they would be more than ``share`` of what is kept so far.

    In closed form: q others and j preprints so far allow c = floor(q r / (1 - r)) preprints, r as an exact
    fraction; with p_j = j + min(0, min over i <= j of c_i - i), the j-th is kept if p_j > p_(j-1).

    Counts and minimum are prefix scans: rows are cut into ranges of the order, scanned within a range, and what
    the ranges before hold, a row for each range, is added. No task sees more than a range.
    """
    if share <= 0 or share >= 1:
        return ranked
    r = Fraction(share).limit_denominator(1_000_000)
    num, den = r.numerator, r.denominator - r.numerator
    pre = F.coalesce(F.lower(F.col(source)).isin(*names), F.lit(False)).cast("bigint")
    whole = stored(ranked.withColumn("__pre", pre))  # read twice: ranges are found from a sample
    rows = stored(whole.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    discard(whole)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the rows
    upto = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = rows.groupBy("__range").agg(F.sum("__pre").alias("__js"), F.sum(1 - F.col("__pre")).alias("__qs"))
    totals = totals.select("__range", *[F.coalesce(F.sum(c).over(before), zero).alias(c) for c in ("__js", "__qs")])
    counted = (
        rows.join(totals, "__range")
        .withColumn("__j", F.col("__js") + F.sum("__pre").over(upto))
        .withColumn("__q", F.col("__qs") + F.sum(1 - F.col("__pre")).over(upto))
        .withColumn("__slack", F.when(F.col("__pre") == 1, F.floor(F.col("__q") * num / den) - F.col("__j")))
        .drop("__js", "__qs", "__q")
    )
    least = counted.groupBy("__range").agg(F.min("__slack").alias("__m")).select("__range", F.min("__m").over(before).alias("__m"))
    lowest = [F.least(zero, F.coalesce(F.least("__m", F.min("__slack").over(w)), zero)) for w in (upto, ahead)]
    out = counted.join(least, "__range").withColumn("__p", F.col("__j") + lowest[0]).withColumn("__was", F.col("__j") - F.col("__pre") + lowest[1])
    return out.where((F.col("__pre") == 0) | (F.col("__p") > F.col("__was"))).select(*ranked.columns)
