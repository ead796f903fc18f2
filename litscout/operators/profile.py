"""Profile of a library (AGG1 to AGG5, SRC14, SRC15, WIN2, LIM3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import stored
from .vectors import centroid

#: Values of a task's summary.
SUMMARY = 4_096


class Frequent:
    """A Misra-Gries summary: counts of at most ``size`` values, each too small by ``lost`` at most; so are those of all other values, held as 0."""

    def __init__(self, size: int):
        self.size, self.count, self.lost = size, {}, 0

    def add(self, counted: dict) -> None:
        """Takes the counts of a batch; if there are too many, all are lowered by the count that follows the ``size`` greatest."""
        for value, n in counted.items():
            self.count[value] = self.count.get(value, 0) + n
        if len(self.count) > self.size:
            cut = sorted(self.count.values(), reverse=True)[self.size]
            self.count = {v: n - cut for v, n in self.count.items() if n > cut}
            self.lost += cut


def candidates(values: DataFrame, value: str, n: int, size: int = SUMMARY) -> DataFrame | None:
    """(value) of all values that may be among the n most frequent, ties included; none if the summaries do not tell, as when hardly any value is frequent."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Frequent(size)
        for batch in batches:
            counted = batch.column("v").value_counts()
            held.add(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist())))
        rows = [(v, c, False) for v, c in held.count.items()] + [(None, held.lost, True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch_type, pa.int64(), pa.bool_()))], names=["v", "n", "lost"])

    kind = values.schema[value].dataType
    batch_type = to_arrow_type(kind)
    each = stored(values.select(F.col(value).alias("v")).where("v IS NOT NULL").mapInArrow(summarise, f"v {kind.simpleString()}, n bigint, lost boolean"))
    lost = each.where("lost").agg(F.sum("n")).first()[0] or 0
    sums = each.where("NOT lost").groupBy("v").agg(F.sum("n").alias("n"))
    least = [r.n for r in sums.orderBy(F.desc("n")).select("n").limit(n).collect()]
    if lost and (len(least) < n or least[-1] <= lost):
        return None
    return sums.where(F.col("n") >= (least[-1] if len(least) == n else 0) - lost).select("v")


def top_counts(values: DataFrame, value: str, order: list[str], n: int = 20, size: int = SUMMARY) -> DataFrame:
    """AGG3: the n most frequent values with counts and first places; ties by first occurrence in ``order``. Null values do not count.

    Two passes: summaries of at most ``size`` values for each task bound every count, and what may be among the first n is then counted exactly. What is shuffled
    depends on the number of tasks, not of different values. Where no value stands out from the summaries' error, all are counted.
    """
    some = candidates(values, value, n, size)
    if some is not None:
        values = values.join(some.withColumnRenamed("v", value), value, "left_semi")
    first = F.min(F.struct(*order)).alias("first")
    return values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("count"), first).orderBy(F.desc("count"), "first", value).limit(n)


def top_authors(library: DataFrame, n: int = 20) -> DataFrame:
    """AGG1: creators by number of mentions; one named twice on an item counts twice."""
    each = library.select("ordinal", F.posexplode("creators").alias("pos", "author"))
    return top_counts(each, "author", ["ordinal", "pos"], n)


def top_venues(library: DataFrame, n: int = 20) -> DataFrame:
    """AGG2: venues from the raw payload, blank ones left out, letter case kept."""
    each = library.select("ordinal", F.get_json_object("raw", "$.data.publicationTitle").alias("venue")).where("venue <> ''")
    return top_counts(each, "venue", ["ordinal"], n)


def distinct_in_order(values: DataFrame, value: str, order: list[str]) -> DataFrame:
    """WIN2: each non-blank value once with its first place."""
    return values.where(F.trim(value) != "").groupBy(value).agg(F.min(F.struct(*order)).alias("first"))


def first_venues(profile: DataFrame, n: int = 20) -> DataFrame:
    """SRC15: the first n distinct venues of a profile document."""
    each = profile.select(F.posexplode("top_venues").alias("pos", "v")).select("pos", F.col("v.venue").alias("venue"))
    return distinct_in_order(each, "venue", ["pos"]).orderBy("first").limit(n)


def summary(library: DataFrame, model: str, asof: Column, n: int = 20) -> DataFrame:
    """AGG5, D8: one row (generated_at, item_count, model, centroid, top_authors, top_venues). Lists have at most n rows."""
    counts = library.agg(F.count(F.lit(1)).alias("item_count"))
    authors = top_authors(library, n).agg(F.array_sort(F.collect_list(F.struct(-F.col("count"), "first", "author", "count"))).alias("a"))
    venues = top_venues(library, n).agg(F.array_sort(F.collect_list(F.struct(-F.col("count"), "first", "venue", "count"))).alias("v"))
    one = counts.crossJoin(F.broadcast(centroid(library))).crossJoin(F.broadcast(authors)).crossJoin(F.broadcast(venues))  # one row each
    return one.select(
        asof.alias("generated_at"), "item_count", F.lit(model).alias("model"), "centroid",
        F.transform("a", lambda x: F.struct(x["author"].alias("author"), x["count"].alias("count"))).alias("top_authors"),
        F.transform("v", lambda x: F.struct(x["venue"].alias("venue"), x["count"].alias("count"))).alias("top_venues"),
    )
