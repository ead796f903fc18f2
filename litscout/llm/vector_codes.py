"""Vector code compression (operator 13): codebooks for the parts of vectors, whose nearest entries a VA-file filter finds.

Components become integers, ``floor(scale * x)``; a vector is cut into equal consecutive parts, and each part
position has a codebook of its own. It starts as that part of the vectors of the smallest ids; each round assigns every part
to its nearest entry and replaces the entries by the floored means of their parts. A code is the list of the nearest entries.

**Assignment** is the filter-and-refine search of a vector-approximation file. The entries' coordinates are quantised to
cells of ``bits`` bits for each dimension, so that an entry is approximated by a word of bits. For a part, a lookup table
holds the least and the greatest squared difference from its coordinate to each cell; an entry's lower and upper
bound are sums of table rows. Only entries whose lower bound does not exceed the least upper bound are
compared exactly, in integers. As bounds are integers too, nothing is lost to rounding, and ties go to the lower index.

**Distribution.** Vectors stay where they are: a round is one pass over their table, in which each task sums what fell to each entry, and one
aggregation of parts x entries x part-width rows a task. The codebooks, 16 x 64 entries, are all that
the driver and the tasks exchange, whatever the number of vectors. Sums by label are an aggregation with map-side combine, joined
to rows that were written before, so that Spark can split the join on a label that a third of the rows have.

Defined results: vectors that are null, or hold null or non-finite components, are left out. Vectors of different lengths, or of one that the parts
do not divide, count as if zeros followed up to the next length that fits the longest. Components
beyond +-65,536 count as that, so that sums fit. With fewer vectors than entries there are fewer entries; without vectors there are no
rows. A null id is one like others and comes last; rows with the same id are ordered by their vectors; equal rows each give a row. A null label is
a label of its own. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell number, and the greatest size of an integer component.
CELL_BITS, MOST = 4, 1 << 24
#: Rows that a task assigns at once: the bounds of so many parts against all entries are held.
ROWS = 2048


class Cells:
    """The approximation of one codebook: for each dimension the cell of every entry and what values the cells span."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        n, dims = entries.shape
        cells = min(1 << bits, n)
        self.entries, self.cell = entries, np.empty((dims, n), np.int64)
        self.low, self.high = np.empty((dims, cells), np.int64), np.empty((dims, cells), np.int64)
        bounds = np.linspace(0, n, cells + 1).astype(int)  # as many entries in each cell
        for d in range(dims):
            order = np.argsort(entries[:, d], kind="stable")
            value = entries[order, d]
            for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
                self.cell[d, order[a:b]] = c
                self.low[d, c], self.high[d, c] = value[a], value[b - 1]

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of squared distances, one row for each part and one column for each entry."""
        lower = np.zeros((len(parts), len(self.entries)), np.int64)
        upper = lower.copy()
        for d in range(parts.shape[1]):
            below, above = self.low[d] - parts[:, d, None], parts[:, d, None] - self.high[d]
            nearest = np.maximum(np.maximum(below, above), 0) ** 2  # the lookup tables: a column for each cell
            farthest = np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += nearest[:, self.cell[d]]
            upper += farthest[:, self.cell[d]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each part, ties to the lower entry, and how many entries were compared exactly."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))  # every part keeps one candidate at least
        least = np.minimum.reduceat(distance, starts)
        best = np.flatnonzero(distance == least[row])
        first = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
        return entry[first], least, len(row)


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors as (rows, parts, width), zeros behind shorter ones."""
    lengths = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = np.asarray(pc.list_flatten(column)).astype(np.int64)
    out = np.zeros((len(lengths), parts * width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out.reshape(len(lengths), parts, width)


def _slices(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            piece = batch.slice(a, ROWS)
            yield piece, _matrix(piece.column("v"), parts, width)


def integers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v array<int>) of the vectors that are whole."""
    v = F.col(vec_col).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.where(whole).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), held.alias("v"))


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every part to its nearest entry, every used entry to the floored mean of its parts."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, held in _slices(batches, parts, width):
            for p in range(parts):
                code = cells[p].nearest(held[:, p])[0]
                np.add.at(total[p], code, held[:, p])
                count[p] += np.bincount(code, minlength=entries)
        at = np.flatnonzero(count.ravel())
        cell, pos = np.repeat(at, width), np.tile(np.arange(width), len(at))
        columns = [cell, pos, total.reshape(-1, width)[at].ravel(), np.repeat(count.ravel()[at], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cell", "pos", "total", "n"])

    sums = rows.select("v").mapInArrow(run, "cell bigint, pos bigint, total bigint, n bigint")
    out = books.copy()
    for r in sums.groupBy("cell", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # parts x entries x width rows
        out[r.cell // entries, r.cell % entries, r.pos] = r.total // r.n
    return out


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()  # ``entries`` rows
    column = first.column("v").combine_chunks()
    books = _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refine(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code string of two hex digits a part, error) of every row."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for piece, held in _slices(batches, parts, width):
            code, error = np.empty((len(held), parts), np.uint8), np.zeros(len(held), np.int64)
            for p in range(parts):
                code[:, p], far, _ = cells[p].nearest(held[:, p])
                error += far
            digits = code.tobytes().hex()
            texts = [digits[a : a + 2 * parts] for a in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array(texts, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([book[int(code[2 * p : 2 * p + 2], 16)] for p, book in enumerate(books)])


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, **columns: str) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every whole vector, and the codebooks; ``entries`` is 256 at most."""
    rows = stored(integers(vectors, scale, **columns))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    books = train(rows, width, parts, entries, rounds)
    return encode(rows, books), books


def digest_of(books: np.ndarray) -> Column:
    """SHA-256 of the entries' decimal components by part, entry and position."""
    return F.lit(hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest())


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of the same label summed, nulls together; ``coded`` must be a stored table."""
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(stored(total), F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(stored(coded)).select("vec_id", "code", "error", "label_error", digest_of(books).alias("codebooks_sha256"))


#: One assignment and one replacement of the entries, in SQL; the numbers name the rounds.
_ROUND = """
a{n} AS (SELECT q.vec_id, q.p, q.q, arg_min(e.e, struct_pack(d := list_sum(list_transform(list_zip(q.q, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e.e)) AS e
  FROM parts q JOIN c{n} e ON e.p = q.p GROUP BY ALL),
s{n} AS (SELECT p, e, i, sum(q[i])::BIGINT AS s, count(*) AS k FROM a{n}, unnest(generate_series(1, len(q))) AS u(i) GROUP BY ALL),
m{n} AS (SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS c FROM s{n} GROUP BY ALL),
c{m} AS (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m ON m.p = c.p AND m.e = c.e)"""
ORACLE_OP13 = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS q FROM k, unnest(generate_series(0, 15)) AS u(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{_ROUND.format(n=0, m=1)},
{_ROUND.format(n=1, m=2)},
f AS (SELECT q.vec_id, q.label, q.p, min(struct_pack(d := list_sum(list_transform(list_zip(q.q, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e.e)) AS b
  FROM parts q JOIN c2 e ON e.p = q.p GROUP BY ALL),
g AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(b.e), 2, '0')), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM f GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM g, h
"""
