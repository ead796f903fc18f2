"""Line dedup (operator 11): two Bloom filters find suspected repeats, which alone are shuffled and confirmed.

A line's key is the line without white space at its ends, A to Z in lower case. Keys of at least ``least`` code points that occur in two documents or
more lose all of their lines but those in the document of the smallest id that holds them.

1. **Hashes.** Every document's different key hashes are written: eight bytes a line, no text.
2. **Filters.** Each task passes its hashes through two Bloom filters: a hash whose bits are all set in the first, *seen once*, sets its bits in the
   second, *seen twice*. Two tasks' filters are merged by ``twice | twice | (once & once)``, block by block of bits: a hash that both have seen
   has all its bits in both. So no repeat is missed, whatever the order and the number of tasks; a retried task writes the same.
3. **Suspects.** Documents are read again beside the second filter. Those without a suspected line are finished at once and never shuffled.
4. **Confirmation.** Suspected lines are grouped by the key itself, bytes and not digests, with map-side combine: a line that a third of the documents share is a row
   for each input task. The least and the greatest id tell whether two documents hold it and which one keeps it.
5. Confirmed keys meet the suspected lines again in a join that Spark splits on hot keys, both sides being written tables; the lines to drop are gathered by document.

**Size.** The filters have ``BITS_A_LINE`` bits for each distinct line of a document, rounded up, and ``MOST_BITS`` (128 MB, broadcast) at most. With
ten bits a line 0.7 % of the lines that occur once are suspected (measured). Beyond 10^8 lines the filters grow denser, and more
lines are shuffled for nothing: by the formula 13 % at four bits a line, half at two, nearly all below one, where this is a plain grouping of lines. The result is the
same at every density; larger filters are a parameter.

Defined results: a null or empty text is one empty line. Null ids are one document that comes after all others. Rows with the same id count as
one document: a key that only they hold stays, in each of them. Equal rows each give a row. A key twice in the document that keeps it stays twice. Documents of which nothing
stays give an empty text. Very long texts and lines are processed whole; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import table, text_of

LEAST = 10
BITS_A_LINE, MOST_BITS, PROBES = 8, 1 << 30, 4
#: Bytes of a filter's block, and tasks that build filters at most.
BLOCK, BUILDERS = 1 << 16, 256
WHITE = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def bits_for(lines: int, a_line: int = BITS_A_LINE, most: int = MOST_BITS) -> int:
    """A power of two of at least a block."""
    return min(most, max(8 * BLOCK, 1 << (max(1, lines) * a_line - 1).bit_length()))


class SeenTwice:
    """Two Bloom filters over 64-bit hashes: of all that was added, and of what was added again."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        each, n = np.unique(hashes, return_counts=True)
        at, bit = places(each, self.bits)
        again = (n > 1) | (self.once[at] & bit).astype(bool).all(0)
        np.bitwise_or.at(self.twice, at[:, again].ravel(), bit[:, again].ravel())
        np.bitwise_or.at(self.once, at.ravel(), bit.ravel())

    def merge(self, once: np.ndarray, twice: np.ndarray, at: slice = slice(None)) -> None:
        """Another task's filters, or a block of them."""
        self.twice[at] |= twice | (self.once[at] & once)
        self.once[at] |= once


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the bits in them, a row for each probe."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    at = (low + np.arange(PROBES, dtype=np.uint64)[:, None] * high) & np.uint64(bits - 1)
    return (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))


def holds(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, bit = places(hashes, 8 * len(filter_bytes))
    return (filter_bytes[at] & bit).astype(bool).all(0)


def repeated(hashes: DataFrame, lines: int, bits: int | None = None) -> np.ndarray:
    """The filter of hashes (h array<bigint>, one for each document) that occur twice; ``bits`` / 8 bytes, a power of two."""
    bits = bits or bits_for(lines)
    size = min(BLOCK, bits // 8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice(bits)
        for batch in batches:
            flat = np.asarray(pc.list_flatten(batch.column("h")))
            for a in range(0, len(flat), 1 << 16):
                seen.add(flat[a : a + (1 << 16)])
        for b in range(bits // 8 // size):
            at = slice(b * size, (b + 1) * size)
            if seen.once[at].any():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([seen.once[at].tobytes()]), pa.array([seen.twice[at].tobytes()])], names=["block", "once", "twice"])

    def merge(rows: pa.Table) -> pa.Table:
        seen = SeenTwice(8 * size)
        for once, twice in zip(rows.column("once"), rows.column("twice")):
            seen.merge(*(np.frombuffer(x.as_buffer(), np.uint8) for x in (once, twice)))
        return pa.table({"block": rows.column("block").slice(0, 1), "twice": pa.array([seen.twice.tobytes()])})

    built = hashes.select("h").coalesce(BUILDERS).mapInArrow(build, "block bigint, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    merged = built.groupBy("block").applyInArrow(merge, "block bigint, twice binary").toArrow()  # ``bits`` at most
    for block, twice in zip(merged.column("block").to_pylist(), merged.column("twice")):
        out[block * size : (block + 1) * size] = np.frombuffer(twice.as_buffer(), np.uint8)
    return out


def _suspected(spark: SparkSession, twice: np.ndarray) -> Callable[[Column], Column]:
    """Of an array of hashes, null where a line has none, the places of those that the filter holds."""
    held = spark.sparkContext.broadcast(twice.tobytes())

    def run(hashes: pa.Array) -> pa.Array:
        flat = pc.list_flatten(hashes)
        lengths = np.asarray(pc.list_value_length(hashes)).astype(np.int64)
        known = np.asarray(pc.is_valid(flat))
        found = np.zeros(len(flat), bool)
        found[known] = holds(np.frombuffer(held.value, np.uint8), np.asarray(pc.drop_null(flat)).astype(np.int64))
        ends = np.cumsum(lengths)
        place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        before = np.r_[0, np.cumsum(found)]
        return pa.ListArray.from_arrays(pa.array(before[np.r_[0, ends]], pa.int32()), pa.array(place[found], pa.int32()))

    return F.arrow_udf(run, "array<int>")


def _without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    """The texts without the lines of those numbers."""
    out = []
    for text, lines in zip(texts.to_pylist(), dropped.to_pylist()):
        if lines:
            gone = set(lines)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pa.array(out, pa.string())


def drop_repeated_lines(
    docs: DataFrame, finish: Callable[[Column], Column] = lambda text: text, least: int = LEAST, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row; ``kept`` is ``finish`` of the text that stays, by default the text itself."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    keys = F.transform(F.split("text", "\n", -1), key_of)
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= least, F.xxhash64(k)))
    each = stored(rows.select(F.array_distinct(F.array_compact(hashes)).alias("h")).withColumn("n", F.size("h")))
    twice = repeated(each, each.agg(F.sum("n")).first()[0] or 0, bits)

    found = rows.withColumn("at", _suspected(spark, twice)(hashes))
    clean = F.size("at") == 0
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    # a document is known by its id and, as ids may repeat, by its text's hash: rows in which both are equal lose the same lines
    found = stored(
        found.select("doc_id", F.xxhash64("text").alias("content"), n_lines.alias("n_lines"), "at", F.when(clean, finish(F.col("text"))).alias("kept"), F.when(~clean, F.col("text")).alias("text"))
    )
    rest = found.where(~clean)
    picked = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.transform("at", lambda i: F.struct(i.alias("i"), F.get(lines, i).alias("line"))))[0]
    lines = rest.select("doc_id", "content", F.explode(picked).alias("l")).select("doc_id", "content", "l.i", key_of(F.col("l.line")).alias("key"))
    least_id, no_id = F.min("doc_id"), F.bool_or(F.col("doc_id").isNull())
    held = lines.groupBy("key").agg(least_id.alias("keep"), F.max("doc_id").alias("last"), no_id.alias("no_id"))
    shared = stored(held.where("keep <> last OR (no_id AND keep IS NOT NULL)").select("key", "keep"))
    dropped = lines.join(shared, "key").where("doc_id IS NULL OR doc_id <> keep").groupBy(F.col("doc_id").alias("of"), F.col("content").alias("as")).agg(F.collect_set("i").alias("dropped"))
    touched = rest.join(dropped, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("as")), "left")
    text = F.arrow_udf(_without, "string")("text", "dropped")
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint")
    touched = touched.select("doc_id", "n_lines", n_dropped.alias("n_dropped"), text.alias("text")).withColumn("kept", finish(F.col("text"))).drop("text")
    return found.where(clean).select("doc_id", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), "kept").union(touched)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), lambda text: F.sha2(text, 256))
    return kept.withColumnRenamed("kept", "kept_sha256")


ORACLE_OP11 = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line,
    translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k
  FROM s, unnest(generate_series(1, len(ls))) AS u(i)),
g AS (SELECT k, min(doc_id) AS keep FROM l WHERE length(k) >= {LEAST} GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (g.keep <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.keep IS NULL OR g.keep = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN g ON g.k = l.k GROUP BY l.doc_id
"""
