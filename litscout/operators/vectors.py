"""Vector operators: nearest library items and the centroid (JN5, JN6, AGG4, S21, S22)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Bytes of vectors that are broadcast at most, as they are held; beyond, they are indexed.
BROADCAST_BYTES = 64_000_000
#: Rows of both sides whose scores are held at once.
TILE = (512, 4096)


def dot(a: Column, b: Column) -> Column:
    """S22, as an expression."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Divided by the length plus 1e-12."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) + F.lit(1e-12)
    return F.transform(v, lambda x: x / norm)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of lists of one length, in the type they came in."""
    flat = pc.list_flatten(column).combine_chunks()
    return np.asarray(flat).reshape(len(column), -1)


def best(left: np.ndarray, right: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row of ``right``, score) of the k best of ``right`` for each row, of those that reach the row's ``floor``; ties go to the earlier. Scores are held tile by tile."""
    for a in range(0, len(left), TILE[0]):
        part = left[a : a + TILE[0]].astype(np.float64)
        least = np.full(len(part), -np.inf) if floor is None else floor[a : a + TILE[0]].copy()
        rows, cols, scores = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        for b in range(0, len(right), TILE[1]):
            score = part @ right[b : b + TILE[1]].astype(np.float64).T
            if k == 1:
                r, c = np.arange(len(part)), score.argmax(1)
                if floor is not None:
                    r = np.flatnonzero(score[r, c] >= least)
                    c = c[r]
            else:
                hit = score >= least[:, None]
                if score.shape[1] > k and np.count_nonzero(hit) > 2 * k * len(part):
                    hit = score >= np.fmax(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])[:, None]
                r, c = np.nonzero(hit)
            if not len(r):
                continue
            rows, cols, scores = np.r_[rows, r], np.r_[cols, c + b], np.r_[scores, score[r, c]]
            order = np.lexsort((cols, -scores, rows))
            rows, cols, scores = rows[order], cols[order], scores[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            least[rows[place == k - 1]] = scores[place == k - 1]
            rows, cols, scores = rows[place < k], cols[place < k], scores[place < k]
        yield rows + a, cols, scores


def nearest(candidates: DataFrame, library: DataFrame, k: int = 1, id_col: str = "id", vec_col: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """JN6 (JN5 for k = 1): (id, key, similarity, rank) of the k items of greatest inner product for each candidate; ties go to the smaller key.

    The library is measured first, as it is held. If its matrix fits the bound it is broadcast once;
    otherwise it is indexed in cells (``cells``), of which a candidate looks at those alone that may hold one of its k
    best. Vectors have one length, the library's greatest; others match nothing.
    """
    spark = candidates.sparkSession
    single = all(dict(d.dtypes)[vec_col] == "array<float>" for d in (candidates, library))
    kind, width = ("array<float>", 4) if single else ("array<double>", 8)
    lib = library.select(F.col(id_col).alias("key"), F.col(vec_col).cast(kind).alias("v"))
    rows = candidates.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("v"))
    dims = lib.agg(F.max(F.size("v"))).first()[0] or 0
    lib, rows = (d.where((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull())) for d in (lib, rows))
    schema = f"id {dict(rows.dtypes)['id']}, key {dict(lib.dtypes)['key']}, similarity double"
    if dims < 1:
        return spark.createDataFrame([], schema + ", rank int")
    if lib.count() * (dims * width + 32) > broadcast_bytes:
        from . import cells

        return cells.search(stored(rows), cells.build(stored(lib)), k)[0]
    found = _broadcast_nearest(spark, rows, lib, k, schema)
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _broadcast_nearest(spark: SparkSession, rows: DataFrame, lib: DataFrame, k: int, schema: str) -> DataFrame:
    table = lib.orderBy("key").toArrow()  # at most ``broadcast_bytes``
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast((table.column("key").combine_chunks(), matrix(table.column("v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, right = held.value
        for batch in batches:
            if batch.num_rows:
                left = matrix(pa.chunked_array([batch.column("v")]))
                for i, j, score in best(left, right, k):
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), keys.take(pa.array(j)), pa.array(score)], names=["id", "key", "similarity"])

    return rows.mapInArrow(run, schema)


def centroid(library: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """AGG4: one row, the element-wise mean scaled to length 1; empty library: an empty array.

    Every task sums its vectors as matrices and gives a row for each dimension (pos, total, n), so what is shuffled does not grow with the
    vectors. Null vectors and elements do not count; a shorter vector counts in the dimensions that it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column("v")
            flat, lengths = pc.list_flatten(column), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            value = np.asarray(pc.cast(flat, pa.float64()).fill_null(0.0))
            there = np.asarray(pc.is_valid(flat))
            pos = np.arange(len(value)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if (dims := int(lengths.max(initial=0))) > len(total):
                total, n = np.pad(total, (0, dims - len(total))), np.pad(n, (0, dims - len(n)))
            total += np.bincount(pos, value, len(total))
            n += np.bincount(pos[there], minlength=len(n))
        kept = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept]), pa.array(n[kept])], names=["pos", "total", "n"])

    parts = library.select(F.col(vec_col).alias("v")).mapInArrow(run, "pos bigint, total double, n bigint")
    means = parts.groupBy("pos").agg((F.sum("total") / F.sum("n")).alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))  # one row a dimension
    return mean.select(l2_normalize(F.col("mean")).alias("centroid"))
