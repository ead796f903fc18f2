"""Exact dedup (operator 6) [native]: an extendible-hash index on shared files.

The index has one entry per different normalised text: its 64-bit key, its chain number among the
entries of the same key, its SHA-256, the row that stays and the number of rows. Entries are made by
grouping on key *and* normalised text, so texts that collide in the key are told apart by their bytes
and chained. Copies are combined before the shuffle, so a hot text costs one row per input task.

The directory is extendible hashing's: it starts with one bucket and doubles while a bucket holds over
``capacity`` entries; a bucket is a prefix of the key's bits, that is a key range. The counts it needs are taken
at a depth that follows the number of entries, ``MOST_BITS`` at most, so the driver sees at most 2**MOST_BITS rows
whatever the corpus. Entries are
sent to the task that owns their bucket, chained there and written to the shared folder by bucket. Rows
find their bucket through the broadcast directory and probe on (bucket, key), where the chain's digests are
compared. The probe is Spark's join on bucket, key and digest: it spreads a bucket's rows over tasks, so
that a hot text does not meet in the one that owns its bucket.

Null text counts as empty; null ``doc_id`` sorts after all others; repeated rows with the id that
stays are all marked as kept (``exact_dedup`` keeps one of them); an empty table gives no rows. Very long texts
are texts like others: they are hashed and compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import stored
from .common import SPACE_RUN, table, text_of

#: Entries of a bucket, and bits of the deepest directory.
CAPACITY, MOST_BITS = 8_192, 16


def normalised(column: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(column, SPACE_RUN, " ")


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """(bucket, its prefix, its depth) of an extendible hash directory over counts by ``max_depth``-bit prefix.

    Begins with one bucket of depth 0; an overfull bucket is split on its next bit, and the directory
    doubles when a bucket's depth passes the global depth. A bucket at ``max_depth`` is not split.
    """
    held = {(0, 0): sum(counts.values())}
    cells = {(0, 0): counts}
    depth = 0
    full = [(0, 0)]
    while full:
        prefix, d = full.pop()
        if held[prefix, d] <= capacity or d == max_depth:
            continue
        depth = max(depth, d + 1)  # doubled when a split passes it
        mine = cells.pop((prefix, d))
        del held[prefix, d]
        for bit in (0, 1):
            part = {c: n for c, n in mine.items() if (c >> (max_depth - d - 1)) & 1 == bit}
            at = ((prefix << 1) | bit, d + 1)
            cells[at], held[at] = part, sum(part.values())
            full.append(at)
    order = sorted(held, key=lambda x: x[0] << (max_depth - x[1]))
    return [(i, p, d) for i, (p, d) in enumerate(order)]


PREFIX = "prefix bigint, bucket int"


def build(keyed: DataFrame, capacity: int = CAPACITY, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index, written by bucket: (key, chain, text_sha256, keep_id, group_size, bucket) from rows (id, key, norm); and its directory (prefix, bucket).

    ``keep_id`` is the least id that is not null, null without one. The directory has a slot for each prefix of its depth.
    """
    spark = keyed.sparkSession
    entries = stored(
        keyed.groupBy("key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    if max_depth is None:
        max_depth = min(MOST_BITS, max(2, (entries.count() // capacity).bit_length() + 2))
    prefix = F.shiftrightunsigned("key", 64 - max_depth)
    counts = {r.p: r.n for r in entries.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # The directory has 2**max_depth rows at most: a bounded table.
    slots = []
    for bucket, p, d in directory(counts, capacity, max_depth):
        first = p << (max_depth - d)
        slots += [(c, bucket) for c in range(first, first + (1 << (max_depth - d)))]
    slots = spark.createDataFrame(slots, PREFIX)
    slots.depth = max_depth
    chain = Window.partitionBy("bucket", "key").orderBy(F.asc_nulls_last("keep_id"), "text_sha256")
    index = (
        route(entries, slots)
        .repartition("bucket")
        .withColumn("chain", F.row_number().over(chain))
        .select("key", "chain", "text_sha256", "keep_id", "group_size", "bucket")
    )
    # A table without rows has no bucket to write.
    return stored(index, *(["bucket"] if counts else [])), slots


def build_index(keyed: DataFrame, capacity: int = CAPACITY, max_depth: int | None = None) -> DataFrame:
    """The index of ``build`` alone."""
    return build(keyed, capacity, max_depth)[0]


def route(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` with the bucket that the directory gives their key."""
    return rows.withColumn("prefix", F.shiftrightunsigned("key", 64 - slots.depth)).join(F.broadcast(slots), "prefix").drop("prefix")


def probe(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Each row (id, bucket, key, text_sha256, ...) with keep_id, group_size and kept of the entry of its bucket's chain that has its digest."""
    return rows.join(index.drop("chain"), ["bucket", "key", "text_sha256"]).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    norm = normalised(text_of(text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), norm.alias("norm")).withColumn("key", F.xxhash64("norm"))
    index, slots = build(rows)
    marked = probe(route(rows.select("id", "key", F.sha2("norm", 256).alias("text_sha256")), slots), index)
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group of equal texts, with the columns of ``docs``.

    The join's key holds the row's id, so a hot text's copies spread over the tasks.
    """
    names = docs.columns
    norm = normalised(text_of(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("bigint").alias("id"), norm.alias("norm"))
    rows = rows.withColumn("key", F.xxhash64("norm"))
    index, slots = build(rows.select("id", "key", "norm"))
    whole = [F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id")]  # a null id is one of its own
    keep = index.withColumnRenamed("keep_id", "id").select("bucket", "key", "text_sha256", *whole)
    rows = route(rows.select("row", "key", F.sha2("norm", 256).alias("text_sha256"), *whole), slots)
    entry = ["bucket", "key", "text_sha256", "no_id", "id"]
    kept = rows.join(keep, entry).dropDuplicates(entry)
    return kept.select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


ORACLE_OP6 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
