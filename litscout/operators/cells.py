"""An exact nearest-neighbour index (JN5, JN6, SNK7, SRC22, SRC28): vectors in cells around centroids, whose radii bound what a cell can hold.

For a query q and a cell of centroid c and radius r, no vector of the cell has a greater inner product with q than ``q.c + |q| r``. A query first looks at the
cells of greatest ``q.c`` that together hold k vectors; the k-th product found there rules out every cell whose bound is less. All others are looked at, so the result
is that of comparing everything, for vectors of any length; on vectors without clusters, little is ruled out. What is shuffled does not grow with the cells that a query looks
at: cells near each other form ``GROUPS`` groups, and a query goes to the groups of its cells.

The centroids come from k-means over a bounded sample (``SAMPLE`` rows and ``SAMPLE_BYTES``, in order of a hash of the key); there are as many as the root of the rows, ``MOST`` at
most, so the table of centroids, radii and counts, which driver and tasks exchange, has a bound (4,096 rows). Every vector is indexed. Cells, and the queries of a cell, of over
``BLOCK`` rows are cut, each pair of blocks a task's group, so that a cell of a third of all vectors is no task of its own. So are groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .vectors import best, matrix

SAMPLE, SAMPLE_BYTES, MOST, ROUNDS, BLOCK = 20_000, 32 << 20, 4_096, 6, 50_000
#: Groups of cells, to each of which a query is sent once at most; queries whose bounds a task holds at once.
GROUPS, QUERIES = 16, 8_192


@dataclass
class Cells:
    """``rows``: (cell, key, v) of the library; of each cell its centroid, radius and number of vectors."""

    rows: DataFrame
    number: np.ndarray
    centroid: np.ndarray
    radius: np.ndarray
    held: np.ndarray

    def save(self, path: str) -> None:
        self.rows.repartitionByRange("cell").sortWithinPartitions("cell", "key").write.mode("overwrite").parquet(f"{path}/rows")
        table = [(int(n), c.tolist(), float(r), int(h)) for n, c, r, h in zip(self.number, self.centroid, self.radius, self.held)]
        self.rows.sparkSession.createDataFrame(table, "cell int, centroid array<double>, radius double, held bigint").write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cells:
        table = sorted(spark.read.parquet(f"{path}/cells").collect())  # ``MOST`` rows at most
        if not table:
            raise ValueError(f"the index {path} is empty")
        number, centroid, radius, held = (np.array(c) for c in zip(*table))
        return cls(spark.read.parquet(f"{path}/rows"), number, centroid, radius, held)


def _centroids(sample: np.ndarray, k: int) -> np.ndarray:
    centre = sample[:k].copy()
    for _ in range(ROUNDS):
        near = (sample @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        held = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre[held > 0] = total[held > 0] / held[held > 0, None]
    return centre


def build(library: DataFrame, cells: int | None = None) -> Cells:
    """The index of (key, v), v of one length and without nulls."""
    spark, kind = library.sparkSession, dict(library.dtypes)
    first = library.orderBy(F.xxhash64("key"), "key").limit(1).collect()
    if not first:
        return Cells(spark.createDataFrame([], f"cell int, key {kind['key']}, v {kind['v']}"), *(np.zeros(s) for s in (0, (0, 1), 0, 0)))
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, len(first[0].v)))))
    sample = matrix(library.orderBy(F.xxhash64("key"), "key").limit(rows).select("v").toArrow().column("v")).astype(np.float64)
    centre = _centroids(sample, min(cells or MOST, MOST, max(1, int(library.count() ** 0.5)), len(sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(pa.chunked_array([batch.column("v")])).astype(np.float64)
                near = (v @ centre.T - (centre**2).sum(1) / 2).argmax(1)
                far = np.sqrt(((v - centre[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("key"), batch.column("v"), pa.array(far)], names=["cell", "key", "v", "far"])

    placed = stored(library.select("key", "v").mapInArrow(run, f"cell int, key {kind['key']}, v {kind['v']}, far double"))
    table = sorted(placed.groupBy("cell").agg(F.max("far"), F.count(F.lit(1))).collect())  # a row for each cell
    number = np.array([r[0] for r in table])
    return Cells(placed.drop("far"), number, centre[number], np.array([r[1] for r in table]), np.array([r[2] for r in table]))


def _bounds(index: Cells, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query and cell the product with the centroid, the most that a product with the cell's vectors can be, and what rounding may add."""
    product, length = v @ index.centroid.T, np.sqrt((v**2).sum(1))[:, None]
    return product, product + length * index.radius, 1e-9 * (1 + length * (index.radius + np.sqrt((index.centroid**2).sum(1))))


def _grouped(index: Cells) -> np.ndarray:
    """The group of each cell: ``GROUPS`` runs of about as many vectors, cells near each other in one or in neighbouring runs."""
    centre = index.centroid
    coarse = _centroids(centre, min(GROUPS, len(centre)))
    order = np.argsort((centre @ coarse.T - (coarse**2).sum(1) / 2).argmax(1), kind="stable")
    group = np.empty(len(centre), np.int64)
    group[order] = (np.cumsum(index.held[order]) - index.held[order]) * GROUPS // max(1, int(index.held.sum()))
    return group


def _chosen(queries: DataFrame, index: Cells, k: int, group: np.ndarray | None = None) -> DataFrame:
    """(id, v, least, parts, n): one row for each query with the cells that it looks at first or, given the product ``least`` of its k-th best there and
    each cell's ``group``, the groups of the cells that may hold as good a one; n counts the vectors of the cells."""
    table = replace(index, rows=None)  # tasks get the table of cells alone
    kind = dict(queries.dtypes)
    part = table.number if group is None else group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.unique(part)
        member = part[:, None] == names
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                product, most, slack = _bounds(table, matrix(pa.chunked_array([batch.column("v")])).astype(np.float64))
                least = batch.column("least").fill_null(float("-inf"))
                if group is None:
                    order = np.argsort(-product, axis=1, kind="stable")
                    before = np.cumsum(table.held[order], axis=1) - table.held[order]
                    looked = np.zeros(product.shape, bool)
                    np.put_along_axis(looked, order, before < k, axis=1)
                else:
                    looked = most + slack >= np.asarray(least)[:, None]
                q, p = np.nonzero(looked if group is None else looked.astype(np.float32) @ member.astype(np.float32) > 0)
                ends = np.searchsorted(q, np.arange(len(product) + 1)).astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(ends), pa.array((part if group is None else names)[p], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), least, parts, pa.array(looked @ table.held, pa.int64())], names=["id", "v", "least", "parts", "n"])

    return queries.mapInArrow(run, f"id {kind['id']}, v {kind['v']}, least double, parts array<int>, n bigint")


def _looked_up(chosen: DataFrame, index: Cells, k: int, group: np.ndarray | None = None) -> DataFrame:
    """(id, key, similarity) of the best, k at most, of each part that a query looks at, no product less than ``least`` among them.

    A query is sent to a part once, whatever the number of its cells, and finds out there which of them it looks at.
    """
    spark, table = chosen.sparkSession, replace(index, rows=None)
    part = index.number if group is None else group
    asked = {r[0]: r[1] for r in chosen.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}  # a row for each part
    holds = {int(p): int(index.held[part == p].sum()) for p in np.unique(part)}
    cut = [(int(c), int(p), -(-asked[int(p)] // BLOCK), -(-holds[int(p)] // BLOCK)) for c, p in zip(index.number, part) if asked.get(int(p))]
    blocks = spark.createDataFrame(cut, "cell int, part int, n_i int, n_j int")
    left = chosen.select("id", "v", "least", F.explode("parts").alias("part")).join(F.broadcast(blocks.select("part", "n_i", "n_j").distinct()), "part")
    left = left.withColumn("i", F.pmod(F.xxhash64("id"), "n_i").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)))
    right = index.rows.join(F.broadcast(blocks), "cell").withColumn("j", F.pmod(F.xxhash64("key"), "n_j").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)))
    kinds = dict(left.dtypes) | dict(right.dtypes)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(b):
            b = b.sort_by("key")
            x, y, least = matrix(a.column("v")), matrix(b.column("v")), np.asarray(a.column("least"))
            place = np.searchsorted(table.number, np.asarray(b.column("cell")))
            here, order = np.unique(place), np.argsort(place, kind="stable")
            cells = Cells(None, *(each[here] for each in (table.number, table.centroid, table.radius, table.held)))
            rows = np.split(order, np.searchsorted(place[order], here[1:]))  # of each cell, in order of the key
            y = [y[r] for r in rows]
            for start in range(0, len(x), QUERIES):
                v, bar = x[start : start + QUERIES].astype(np.float64), least[start : start + QUERIES, None]
                _, most, slack = _bounds(cells, v)
                hits = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
                for c, r in enumerate(rows):
                    q = np.flatnonzero(most[:, c] + slack[:, c] >= bar[:, 0])
                    hits += [(q[i], r[j], score) for i, j, score in best(v[q], y[c], k, bar[q, 0] - slack[q, c])]
                i, j, score = (np.concatenate(each) for each in zip(*hits))
                by = np.lexsort((j, -score, i))
                i, j, score = i[by], j[by], score[by]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append(pa.table({"id": a.column("id").take(pa.array(i[kept] + start)), "key": b.column("key").take(pa.array(j[kept])), "similarity": pa.array(score[kept])}))
        return pa.concat_tables(found) if found else pa.table({"id": a.column("id").slice(0, 0), "key": b.column("key").slice(0, 0), "similarity": pa.array([], pa.float64())})

    groups = [d.groupBy("part", "i", "j") for d in (left.select("part", "i", "j", "id", "v", "least"), right.select("part", "i", "j", "cell", "key", "v"))]
    return groups[0].cogroup(groups[1]).applyInArrow(run, f"id {kinds['id']}, key {kinds['key']}, similarity double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Cells, k: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """(id, key, similarity, rank) of the k greatest inner products of each query (id, v), ties to the smaller key; and
    the tables (id, v, least, parts, n) of what was looked at, of which the costs can be read."""
    if not len(index.number):
        return _top(queries.sparkSession.createDataFrame([], f"id {dict(queries.dtypes)['id']}, key {dict(index.rows.dtypes)['key']}, similarity double"), k), []
    first = stored(_chosen(queries.select("id", "v", F.lit(None).cast("double").alias("least")), index, k))
    found = _top(_looked_up(first, index, k), k)
    least = stored(found.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("least")))
    group = _grouped(index)
    rest = stored(_chosen(queries.join(least, "id", "left").select("id", "v", "least"), index, k, group))
    return _top(_looked_up(rest, index, k, group), k), [first, rest]


def products(looked: list[DataFrame], index: Cells) -> int:
    """How many inner products a search in the index computed beside those with centroids."""
    return sum(d.agg(F.sum("n")).first()[0] or 0 for d in looked)
