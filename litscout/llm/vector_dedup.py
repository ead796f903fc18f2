"""Embedding near-dedup (operator 7): a forest of random-projection trees with spill.

* Vectors that are null, zero or hold null or non-finite components link with nothing. All others are
  scaled to length 1 in double precision. Equal vectors (same components) share a node, so copies cost
  one row; links count vectors. Vectors of different lengths never link; those of each length are compared
  among themselves. Vectors travel as they came, 32-bit components as such, and are scaled where they are compared.
* Each length of more than ``leaf`` nodes, counted over the whole table, has trees of its own (at most 256
  lengths, the most frequent); those of any other length are one leaf.
* A node of a tree is split at the median of its rows' projections on a random direction that the node's number
  determines; rows within ``margin`` of the cut go to both sides. The upper part of the trees is fitted on a
  documented, bounded sample (``sample`` nodes and ``SAMPLE_BYTES`` at most, those of smallest hash, in equal shares of
  the lengths that have trees). Every row is routed down every tree; leaves that hold over ``2 * leaf`` rows are
  split again, each from a sample of its own rows, until none is left that can be parted. So leaves
  stay small whatever the size of the table, and no task or driver sees more than a sample.
* All pairs within a leaf are compared, in blocks where the rows of a leaf are too alike to part. A pair that
  meets in several leaves counts in the first alone, which both rows' lists of leaves tell. Tasks return link
  counts and a spanning forest, never pairs; components are found by distributed label steps.

For cosine c, unit vectors are at most r = sqrt(2 - 2c) apart; on a random direction of d dimensions that
is r / sqrt(d) at one standard deviation. ``margin`` is ``SPILL`` times that, on each side; ``parted`` gives the
share of such pairs that a split parts, and with it the number of trees follows from the depth and the
recall wanted (``trees_for``). A narrow spill with more trees moves fewer rows than a wide one with few. The measured
recall is in the README. Null ids and an empty table are defined: a null id is a vector of its own whose
component is null unless a linked one has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import discard, stored
from .blocks import by_group, dealt, in_batches, roots_of
from .common import table

COSINE, RECALL = 0.95, 0.999
LEAF, SAMPLE, SPILL = 2048, 20_000, 0.25
#: Bytes of vectors in a sample, rows of a node that a cut is found from at least, rows of a block.
SAMPLE_BYTES, LEAST, BLOCK_ROWS = 32_000_000, 64, 4096
#: A leaf's number holds its tree's number above these bits and its place in the tree below them: 1 for the root, 2i and 2i + 1 below i.
PLACE = 48
WIDTHS = 256


def parted(cosine: float, spill: float) -> float:
    """The share of pairs at the threshold that one split parts: they lie more than both margins apart, across the median."""
    a = 2 * spill
    beyond = 2 * (math.exp(-a * a / 2) / math.sqrt(2 * math.pi) - a * math.erfc(a / math.sqrt(2)) / 2)
    return math.sqrt(2 - 2 * cosine) / math.sqrt(2 * math.pi) * beyond


def trees_for(rows: int, leaf: int, cosine: float, spill: float = SPILL, recall: float = RECALL) -> int:
    """How many trees find a pair at the threshold with the recall wanted, if a tree's depth is that of ``rows``."""
    depth = max(0, math.ceil(math.log2(max(1, rows) / leaf)))
    whole = min(1 - 1e-9, (1 - parted(cosine, spill)) ** depth)
    return min(64, max(2, math.ceil(math.log(1 - recall) / math.log(1 - whole))))


@lru_cache(8192)
def direction(tree: int, place: int, width: int) -> np.ndarray:
    """The random direction of a tree's node, of length 1; the same in every process."""
    u = np.random.default_rng([7, tree, place]).standard_normal(width)
    return u / np.linalg.norm(u)


def margin_of(cosine: float, width: int, spill: float = SPILL) -> float:
    return spill * math.sqrt(2 - 2 * cosine) / math.sqrt(width)


def grow(x: np.ndarray, total: float, leaf: int, margin: float, tree: int, place: int = 1) -> dict[int, float]:
    """Cuts by place below ``place``, from a sample ``x`` that stands for ``total`` rows; none if they are too alike to part."""
    if total <= leaf or len(x) < LEAST or place >> (PLACE - 2):
        return {}
    at = x @ direction(tree, place, x.shape[1])
    cut = float(np.median(at))
    left, right = at < cut + margin, at >= cut - margin
    if max(left.sum(), right.sum()) >= 0.95 * len(x):
        return {}
    cuts = {place: cut}
    for side, k in ((left, 2 * place), (right, 2 * place + 1)):
        cuts |= grow(x[side], total * side.sum() / len(x), leaf, margin, tree, k)
    return cuts


def route(x: np.ndarray, cuts: dict[int, float], margin: float, tree: int, place: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf's number, rows) for each leaf below ``place`` that rows of ``x`` reach."""
    todo = [(place, np.arange(len(x)))]
    while todo:
        place, rows = todo.pop()
        if not len(rows):
            continue
        if (cut := cuts.get(place)) is None:
            yield (tree << PLACE) + place, rows
            continue
        at = x[rows] @ direction(tree, place, x.shape[1])
        todo.append((2 * place, rows[at < cut + margin]))
        todo.append((2 * place + 1, rows[at >= cut - margin]))


def rows_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: (indexes of the usable rows, matrix of their components, matrix of their unit vectors)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = np.array([v is not None and len(v) > 0 and all(x is not None for x in v) for v in (lists.to_pylist() if lists.null_count or lists.values.null_count else [])] or [True] * len(lists), bool)
    sizes = np.array([0 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
    ok &= sizes > 0
    out = []
    for width in np.unique(sizes[ok]).tolist():
        mine = ok & (sizes == width)
        raw = np.asarray(lists.filter(pa.array(mine)).flatten()).reshape(-1, width)
        x = raw.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(x).max(1)
            fine = np.isfinite(x).all(1) & (top > 0)
            x = x / np.where(fine, top, 1)[:, None]  # so that squares neither overflow nor vanish
            x = x / np.where(fine, np.sqrt((x * x).sum(1)), 1)[:, None]
        out.append((np.flatnonzero(mine)[fine], raw[fine], x[fine]))
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vd (digest of the unit vector, null if it links with nothing), the components' bytes and their number."""
    import xxhash

    for batch in batches:
        vd: list[bytes | None] = [None] * batch.num_rows
        raw: list[bytes | None] = [None] * batch.num_rows
        width = np.zeros(batch.num_rows, np.int32)
        for at, own, x in rows_of(batch.column("embedding")):
            width[at] = x.shape[1]
            for i, row, bits in zip(at, x + 0.0, own):  # + 0.0: -0 and 0 are one number
                vd[i], raw[i] = xxhash.xxh3_128_digest(row.tobytes()), bits.tobytes()
        columns = [batch.column("vec_id"), pa.array(vd, pa.binary()), pa.array(raw, pa.binary()), pa.array(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vd", "raw", "width"])


def _units(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The unit vectors of rows of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


ROUTED = "node bigint, copies bigint, width int, raw binary, leaves array<bigint>"


def _by_width(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their unit vectors) of each length in the batch."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield width, at, _units(batch.column("raw").take(pa.array(at)), kind)


def _with_leaves(batch: pa.RecordBatch, found: list[list[int]]) -> pa.RecordBatch:
    leaves = pa.array([sorted(f) for f in found], pa.list_(pa.int64()))
    names = ["node", "copies", "width", "raw"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), leaves], names=[*names, "leaves"])


def _router(forests: dict[int, dict[int, dict[int, float]]], cosine: float, kind: type):
    """Leaves by the trees of the vector's length; vectors of a length without trees are a leaf of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for width, at, x in _by_width(batch, kind):
                if width not in forests:
                    for i in at:
                        found[i].append(-width)
                for tree, cuts in forests.get(width, {}).items():
                    for leaf, rows in route(x, cuts, margin_of(cosine, width), tree):
                        for i in at[rows]:
                            found[i].append(leaf)
            yield _with_leaves(batch, found)

    return run


def _splitter(leaf: int, cosine: float, kind: type):
    """Cuts of one large leaf, from a sample of its rows."""

    def run(rows: pa.Table) -> pa.Table:
        number, total, width = (rows.column(c)[0].as_py() for c in ("leaf", "m", "width"))
        tree, place = number >> PLACE, number & (1 << PLACE) - 1
        cuts = grow(_units(rows.column("raw"), kind), total, leaf, margin_of(cosine, width), tree, place)
        return pa.table({"leaf": pa.array([number], pa.int64()), "places": pa.array([list(cuts)], pa.list_(pa.int64())), "cuts": pa.array([list(cuts.values())], pa.list_(pa.float64()))})

    return run


def _rerouter(cosine: float, kind: type):
    """Rows with the leaves that were split replaced by those below; ``split`` lists the cuts of this row's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("leaves").to_pylist()
            todo: dict[int, list[int]] = {}
            cuts: dict[int, dict[int, float]] = {}
            for i, split in enumerate(batch.column("split").to_pylist()):
                for one in split or ():
                    todo.setdefault(one["leaf"], []).append(i)
                    cuts.setdefault(one["leaf"], dict(zip(one["places"], one["cuts"])))
            widths = batch.column("width").to_numpy()
            for number, at in todo.items():
                x = _units(batch.column("raw").take(pa.array(at)), kind)
                below = [[] for _ in at]
                for leaf, rows in route(x, cuts[number], margin_of(cosine, int(widths[at[0]])), number >> PLACE, number & (1 << PLACE) - 1):
                    for k in rows:
                        below[k].append(leaf)
                for i, new in zip(at, below):
                    found[i] = [f for f in found[i] if f != number] + new
            yield _with_leaves(batch, found)

    return run


def small_leaves(routed: DataFrame, leaf: int, cosine: float, kind: type, sample: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose leaves of over ``2 * leaf`` rows are split, as far as they can be parted; and the others (leaf, m), if any."""
    stuck = None
    while True:
        held = routed.select("node", "width", F.explode("leaves").alias("leaf"))
        big = stored(held.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 2 * leaf))
        rest = big if stuck is None else stored(big.join(stuck, "leaf", "left_anti"))
        if not rest.limit(1).count():
            return routed, big if big.limit(1).count() else None
        # of each large leaf about ``sample`` rows, by hash; a leaf without trees above it (negative) can not be split
        some = held.join(rest, "leaf").where((F.col("leaf") > 0) & (F.pmod(F.xxhash64("node", "leaf"), F.col("m")) < sample))
        some = some.join(routed.select("node", "raw"), "node").select("leaf", "m", "width", "raw")
        cuts = stored(some.groupBy("leaf").applyInArrow(_splitter(leaf, cosine, kind), "leaf bigint, places array<bigint>, cuts array<double>"))
        use = cuts.where(F.size("places") > 0)
        no = stored(rest.join(use.select("leaf"), "leaf", "left_anti").select("leaf"))
        stuck = no if stuck is None else stored(stuck.union(no))
        split = held.join(use, "leaf").groupBy("node").agg(F.collect_list(F.struct("leaf", "places", "cuts")).alias("split"))
        was, routed = routed, stored(routed.join(split, "node", "left").mapInArrow(_rerouter(cosine, kind), ROUTED))
        discard(was, cuts)


NONE = np.iinfo(np.int64).max
LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])


def _comparer(cosine: float, kind: type):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in by_group(batches, ["leaf", "bi", "bj"]):
            node, copies, own = (group.column(c).to_numpy() for c in ("node", "copies", "own"))
            leaf, bi, bj = (group.column(c)[0].as_py() for c in ("leaf", "bi", "bj"))
            x = _units(group.column("raw"), kind)
            lists = group.column("leaves").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            ends = np.asarray(lists.value_lengths())
            member = np.full((len(node), ends.max()), NONE, np.int64)
            member[np.arange(ends.max()) < ends[:, None]] = np.asarray(lists.flatten())
            left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for a in range(0, len(left), 512):
                part = left[a : a + 512]
                p, q = np.nonzero(x[part] @ x[right].T >= cosine)
                p, q = part[p], right[q]
                if bi == bj:
                    p, q = p[p < q], q[p < q]
                good = np.zeros(len(p), bool)
                for i in range(0, len(p), 20_000):
                    m, k = member[p[i : i + 20_000]], member[q[i : i + 20_000]]
                    both = (m[:, :, None] == k[:, None, :]).any(2) & (m != NONE)
                    good[i : i + 20_000] = np.where(both, m, NONE).min(1) == leaf
                p, q = p[good], q[good]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                if len(p):
                    root = np.minimum(root, roots_of(len(node), np.r_[p, np.arange(len(node))], np.r_[q, root]))
            hit = links > 0
            if hit.any():
                yield node[hit], links[hit], node[root][hit]

    return lambda batches: in_batches(rows(batches), LINKS)


def vector_dedup(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. ``trees``: by default as many as the recall asks for."""
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind = np.float32 if single else np.float64
    base = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    read = stored(base.mapInArrow(_reader, "vec_id bigint, vd binary, raw binary, width int"))
    nodes = stored(
        read.where("vd IS NOT NULL")
        .groupBy("vd")
        .agg(F.first("raw").alias("raw"), F.first("width").alias("width"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    large = nodes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
    large = large.orderBy(F.desc("n"), "width").limit(WIDTHS).collect()
    forests: dict[int, dict[int, dict[int, float]]] = {}
    first = 0
    for r in large:  # mostly one
        most = min(sample, SAMPLE_BYTES // (r.width * kind().itemsize)) // len(large)
        some = nodes.where(F.col("width") == r.width).select("raw").orderBy(F.xxhash64("vd"), "vd").limit(max(LEAST, most)).toArrow()  # a bounded sample
        x = _units(some.column("raw"), kind)
        count = trees_for(r.n, leaf, cosine) if trees is None else trees
        forests[r.width] = {t: grow(x, r.n, leaf, margin_of(cosine, r.width), t) for t in range(first, first + count)}
        first += count
    routed = stored(nodes.select("node", "copies", "width", "raw").mapInArrow(_router(forests, cosine, kind), ROUTED))
    routed, crowded = small_leaves(routed, leaf, cosine, kind, max(LEAST, min(sample, SAMPLE_BYTES // 8 // max([1, *(r.width * kind().itemsize for r in large)]))))
    placed = routed.select("node", "copies", "raw", "leaves", F.explode("leaves").alias("leaf"))
    blocks = F.lit(1)
    if crowded is not None:  # rows too alike to part
        placed, blocks = placed.join(crowded, "leaf", "left"), F.ceil(F.coalesce("m", F.lit(1)) / BLOCK_ROWS)
    pairs = dealt(placed, "leaf", "node", blocks)
    found = stored(pairs.select("leaf", "bi", "bj", "own", "node", "copies", "raw", "leaves").mapInArrow(_comparer(cosine, kind), "node bigint, links bigint, parent bigint"))
    classes = components(found.where("node <> parent").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        nodes.select("vd", "node", "copies", "first_id")
        .join(links, "node", "left")
        .join(classes, "node", "left")
        .select("vd", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    known = stored(known)
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "root").select("vd", "n_links", "component_id")
    out = read.select("vec_id", "vd").join(known, "vd", "left")
    own = F.when(F.col("vd").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


ORACLE_OP7 = """
WITH RECURSIVE p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a, embeddings b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.x = e.vec_id) AS n_links, k.component_id, e.vec_id = k.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) k ON k.x = e.vec_id
"""
