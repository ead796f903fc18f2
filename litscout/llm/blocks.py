"""Comparing all rows of a group with each other, in bounded tasks.

A group is cut into blocks; each pair of blocks is a task of its own. A row goes to as many tasks as
its group has blocks, so a group of any size is compared without ever being in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, group: str, ident: str, blocks: Column) -> DataFrame:
    """Rows repeated for each pair (bi, bj) of blocks that holds theirs, sorted by (group, bi, bj) within tasks; ``own`` is the row's block."""
    own = F.pmod(F.xxhash64(ident), F.col("__blocks")).cast("int")
    out = df.withColumn("__blocks", blocks.cast("int")).withColumn("own", own)
    out = out.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    out = out.withColumn("bi", F.least("own", "__other")).withColumn("bj", F.greatest("own", "__other")).drop("__blocks", "__other")
    return out.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", ident)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys over sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def roots_of(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' components under links p-q."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        was = root.copy()
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        root = root[root]
        if (root == was).all():
            return root


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of ``size`` from tuples of equally long arrays."""
    held: list[tuple] = []
    n = 0
    for columns in rows:
        held.append(columns)
        n += len(columns[0])
        if n >= size:
            yield _batch(held, schema)
            held, n = [], 0
    if n:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)


Runner = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
