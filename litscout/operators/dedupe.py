"""Exact and fuzzy dedupe against the library and among candidates (WIN1, JN1 to JN4)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_identifier, normalize_title, strip
from ..storage import discard, stored
from .graph import components
from .similar import similar_titles

THRESHOLD = 0.9
#: Keys of a component that one task passes through, and rounds in which a larger one is decided before it is passed through in blocks.
TASK_KEYS, ROUNDS = 200_000, 24


def exact_key() -> Column:
    """The first of DOI, identifier and title that is not empty, stripped, lower case."""
    first = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("doi", "identifier", "title")])
    return strip(F.lower(first))


def keep_first(candidates: DataFrame, order: str = "ordinal") -> DataFrame:
    """WIN1: of equal keys the row of least ordinal; rows with a blank key go.

    One aggregation with map-side combine instead of a window: a hot key stays one row per input task.
    """
    names = candidates.columns
    row = F.struct(F.col(order).alias("__o"), F.struct(*names).alias("__row"))
    best = candidates.withColumn("__key", exact_key()).where(F.col("__key") != "").groupBy("__key").agg(F.min_by(row, F.col(order)).alias("__best"))
    return best.select("__best.__row.*")


def not_in_library(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """JN1 and JN2: the DOI is no library DOI, the identifier no library URL. Missing values never match."""
    dois = library.where("doi <> ''").select(normalize_identifier(F.col("doi")).alias("__doi")).distinct()
    urls = library.where("url <> ''").select(normalize_identifier(F.col("url")).alias("__id")).distinct()
    own = F.when(F.col("doi") != "", normalize_identifier(F.col("doi")))
    out = candidates.withColumn("__d", F.when(own != "", own)).withColumn("__i", normalize_identifier(F.col("identifier")))
    out = out.join(dois, F.col("__d") == F.col("__doi"), "left_anti").join(urls, F.col("__i") == F.col("__id"), "left_anti")
    return out.drop("__d", "__i")


def fuzzy_not_in_library(candidates: DataFrame, library: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """JN3: candidates whose title is like no library title. Empty titles are like none."""
    t = normalize_title(F.col("title"))
    have = library.select(t.alias("t")).where("t <> ''").distinct()
    mine = candidates.select(t.alias("t")).where("t <> ''").distinct()
    # written, so that its size is known before the rows are joined: few titles are broadcast and the rows stay where they are. Else they would be
    # shuffled by title first, and if no title is alike Spark leaves the join out and reads each partition whole, one of all rows without a title
    like = stored(similar_titles(mine, have, threshold).select("t").union(mine.join(have, "t", "left_semi")).distinct())
    return candidates.withColumn("__t", t).join(like.withColumnRenamed("t", "__t"), "__t", "left_anti").drop("__t")


def in_order(rows: pa.Table) -> pa.Table:
    """The ids (id, holds, watches) that a pass in id order keeps, where a row is dropped if an earlier kept row holds a key that it watches."""
    held: set[str] = set()
    kept = []
    rows = rows.sort_by("id")
    for i, holds, watches in zip(*(rows.column(c).to_pylist() for c in ("id", "holds", "watches"))):
        if held.isdisjoint(watches or ()):
            held.update(holds or ())
            kept.append(i)
    return pa.table({"id": pa.array(kept, rows.schema.field("id").type)})


def in_rounds(holds: DataFrame, watches: DataFrame, most: int = TASK_KEYS, rounds: int = ROUNDS) -> DataFrame:
    """What ``in_order`` keeps, for rows (id, key) of any number: of each key the least kept and the least undecided
    holder are found; a row with an earlier kept holder is dropped, one without an earlier undecided one is kept. A key
    shared by n rows costs n rows, not n * n. Most graphs are decided in a few rounds, but in a chain each row waits for the one
    before it; what is open after ``rounds`` is passed through block by block."""
    status = stored(holds.select("id").union(watches.select("id")).distinct().select("id", F.lit(None).cast("boolean").alias("kept")))
    for _ in range(rounds):
        if not status.where("kept IS NULL").limit(1).count():
            return status.where("kept").select("id")
        of = holds.join(status, "id").where("kept IS NULL OR kept")
        of = of.groupBy("key").agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("k"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("o"))
        seen = watches.join(of, "key").groupBy("id").agg(F.max(F.coalesce(F.col("k") < F.col("id"), F.lit(False))).alias("any_kept"), F.max(F.coalesce(F.col("o") < F.col("id"), F.lit(False))).alias("any_open"))
        decided = (
            F.when(F.col("kept").isNotNull(), F.col("kept"))
            .when(F.coalesce("any_kept", F.lit(False)), F.lit(False))
            .when(~F.coalesce("any_open", F.lit(False)), F.lit(True))
        )
        was, status = status, stored(status.join(seen, "id", "left").select("id", decided.alias("kept")))
        discard(was)
    return _in_blocks(holds, watches, status, most)


def _in_blocks(holds: DataFrame, watches: DataFrame, status: DataFrame, most: int) -> DataFrame:
    """The kept ids, where those open in ``status`` (id, kept) are passed through in blocks of about ``most`` keys, in order: a row goes if a row kept
    before its block holds a key that it watches, and what is left of a block is one task. As many steps as blocks."""
    kept, waiting = status.where("kept").select("id"), stored(status.where("kept IS NULL").select("id"))
    keys = stored(holds.select("id", "key", F.lit(True).alias("held")).union(watches.select("id", "key", F.lit(False))).join(waiting, "id", "left_semi"))
    blocks = -(-keys.count() // most)
    ends = keys.approxQuantile("id", [k / blocks for k in range(1, blocks)], 1e-4) if blocks > 1 else []  # ``blocks`` numbers
    for low, high in zip([None, *ends], [*ends, None]):
        part = keys.where((F.col("id") > low if low is not None else F.lit(True)) & (F.col("id") <= high if high is not None else F.lit(True)))
        taken = holds.join(kept, "id", "left_semi").select("key", F.col("id").alias("by"))
        gone = part.where("NOT held").join(taken, "key").where("by < id").select("id")
        block = part.join(gone, "id", "left_anti").withColumn("root", F.lit(0))
        kept = stored(kept.union(_passed(block)))
    return kept


def greedy(holds: DataFrame, watches: DataFrame, most: int = TASK_KEYS) -> DataFrame:
    """The ids that a pass in id order keeps, where a row is dropped if an earlier kept row holds a key that it watches.

    ``holds`` and ``watches``: (id, key), ids bigint. Rows that no key connects do not matter to each other, so each
    connected component is passed through in one task; one of over ``most`` keys is decided in rounds and blocks instead. Not
    components alone: of a ~ b ~ c, a and c stay.
    """
    keys = stored(holds.select("id", "key", F.lit(True).alias("held")).union(watches.select("id", "key", F.lit(False))))
    if keys.count() <= most:
        return _passed(keys.withColumn("root", F.lit(0)))
    least = keys.groupBy("key").agg(F.min("id").alias("a"))
    roots = components(keys.join(least, "key").where("id <> a").select("a", F.col("id").alias("b"))).select(F.col("node").alias("id"), "root")
    keys = stored(keys.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    large = stored(keys.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    if not large.limit(1).count():
        return _passed(keys)
    rest = stored(keys.join(large, "root", "left_semi"))
    rounds = in_rounds(*(rest.where(F.col("held") == held).select("id", "key") for held in (True, False)), most)
    return _passed(keys.join(large, "root", "left_anti")).union(rounds)


def _passed(keys: DataFrame) -> DataFrame:
    rows = keys.groupBy("root", "id").agg(*[F.collect_list(F.when(F.col("held") == held, F.col("key"))).alias(name) for held, name in ((True, "holds"), (False, "watches"))])
    return rows.groupBy("root").applyInArrow(in_order, "id bigint")


def self_dedupe(candidates: DataFrame, order: str = "ordinal", threshold: float = THRESHOLD, most: int = TASK_KEYS) -> DataFrame:
    """JN4: drops a row whose DOI or identifier an earlier kept row has, or whose title is like an earlier kept row's.

    DOIs and identifiers are one set of keys, so they also match crosswise; an empty identifier is a key too.
    """
    identifier, doi = normalize_identifier(F.col("identifier")), normalize_identifier(F.col("doi"))
    own = F.array_distinct(F.array_compact(F.array(identifier, F.when((F.col("doi") != "") & (doi != ""), doi))))
    rows = stored(candidates.select(F.col(order).cast("bigint").alias("id"), normalize_title(F.col("title")).alias("t"), own.alias("keys")))
    titled = rows.where("t <> ''")
    titles = titled.select("t").distinct()
    like = similar_titles(titles, titles, threshold)
    holds = rows.select("id", F.explode("keys").alias("key")).select("id", F.concat(F.lit("k"), F.col("key")).alias("key"))
    holds = stored(holds.union(titled.select("id", F.concat(F.lit("t"), F.col("t")).alias("key"))))
    watches = stored(holds.union(titled.join(like, "t").select("id", F.concat(F.lit("t"), F.col("u")).alias("key"))))
    kept = greedy(holds, watches, most)
    return candidates.join(kept.withColumnRenamed("id", order), order, "left_semi")


def dedupe(candidates: DataFrame, library: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The whole step. Library conflicts do not depend on the order of candidates, so they go first."""
    rest = fuzzy_not_in_library(stored(not_in_library(candidates, library)), library, threshold)  # read twice
    return self_dedupe(stored(rest), threshold=threshold)
