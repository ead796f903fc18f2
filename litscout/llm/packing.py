"""Packing (operator 3): non-negative least squares over length combinations that fill a window.

1. Every text is encoded once, whole; ids are written to the shared folder with a row number.
2. A document's tokens beyond full windows of 4096 are its rest. The histogram of rests has at most 4095
   bins whatever the corpus, so it may come to the driver.
3. There, combinations of two, three or four lengths that fill a window exactly are listed; non-negative
   least squares finds how often each should occur so that the histogram is met; counts are rounded and
   given out while rests last. What remains is packed greedily, longest first: the bins' rests are laid
   end to end and cut at window ends. The last part of a window is cut into powers of two, which need no
   padding. So no sequence is padded, and only what the combinations leave is cut.
4. A rest's place follows from its bin and its number within the bin, which is found without bringing
   the bin together; the plan that tasks hold has a fixed bound.

A null text is empty: its one piece is the end id. Repeated rows and null ids are documents of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import slices, spread_row_number, table, text_of
from .tokens import AT_ONCE, encoder, tokenizer_file

WINDOW, END = 4096, 2
MOST_COMBINATIONS = 40_000


def combinations(counts: np.ndarray, window: int, most: int = MOST_COMBINATIONS) -> np.ndarray:
    """Rows of up to four lengths (0: none) that sum to ``window`` and whose bins are not empty: all pairs, and threes and fours of the fullest bins."""
    has = np.flatnonzero(counts)
    there = np.zeros(window + 1, bool)
    there[has] = True
    found = [np.array([(a, window - a, 0, 0) for a in has if a <= window - a and there[window - a]], np.int64).reshape(-1, 4)]
    full = has[np.argsort(-counts[has], kind="stable")]
    for depth, top in ((3, full[:160]), (4, full[:48])):
        top = np.sort(top)
        a = top[:, None] + top[None, :]
        i, j = np.nonzero(np.triu(a <= window))
        two = np.stack([top[i], top[j]], 1)
        if depth == 4 and len(two):
            k = np.repeat(np.arange(len(two)), len(top))
            two = np.c_[two[k], np.tile(top, len(two))]
            two = two[two[:, 2] >= two[:, 1]]
        if not len(two):
            continue
        rest = window - two.sum(1)
        ok = (rest >= two[:, -1]) & there[np.clip(rest, 0, window)]
        two, rest = two[ok], rest[ok]
        found.append(np.c_[two, rest, np.zeros((len(two), 4 - depth), np.int64)].astype(np.int64))
    return np.unique(np.concatenate(found), axis=0)[:most]


def nnls(rows: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, A's columns having a one for each length in ``rows``: accelerated projected gradient."""
    if not len(rows):
        return np.zeros(0)
    member = rows.ravel()
    used = member > 0

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(member[used], np.repeat(x, rows.shape[1])[used], len(target))

    def back(y: np.ndarray) -> np.ndarray:
        return np.where(rows > 0, y[rows], 0.0).sum(1)

    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue of A'A, for the step length
        v = back(times(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - target) / (1.05 * size))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


@dataclass
class Plan:
    """Where the k-th rest of a bin goes. Entries are sorted by (length, first number)."""

    window: int
    entry: np.ndarray  # length << 40 | first number
    first: np.ndarray
    at: np.ndarray  # combination: first sequence; laid end to end: first position
    offset: np.ndarray  # combination: offset in the sequence; laid end to end: -1
    laid: int  # first sequence of those laid end to end
    cuts: np.ndarray  # ends of sequences among the positions laid end to end
    full_end: int  # where the last part of a window begins among them
    sequences: int  # number of sequences so far; full windows of long documents follow

    def place(self, length: int, k: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of the pieces of the k-th rest of ``length``."""
        i = int(np.searchsorted(self.entry, (length << 40) | k, "right")) - 1
        if self.offset[i] >= 0:
            return [(0, length, int(self.at[i] + k - self.first[i]), int(self.offset[i]))]
        out, done, pos = [], 0, int(self.at[i] + (k - self.first[i]) * length)
        while done < length:
            s = pos // self.window
            begin, end = s * self.window, (s + 1) * self.window
            if end > self.full_end:
                j = int(np.searchsorted(self.cuts, pos, "right"))
                begin, end = (int(self.cuts[j - 1]) if j else self.full_end), int(self.cuts[j])
                s = self.full_end // self.window + j
            n = min(length - done, end - pos)
            out.append((done, n, self.laid + s, pos - begin))
            done, pos = done + n, pos + n
        return out


def make_plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for ``counts[length]`` rests of each length below ``window``."""
    rows = combinations(counts, window)
    x = nnls(rows, counts.astype(float))
    left, given = counts.copy(), np.zeros_like(counts)
    entries, sequence = [], 0
    for i in np.argsort(-x, kind="stable"):
        lengths = rows[i][rows[i] > 0]
        need = np.bincount(lengths, minlength=len(counts))
        n = min(int(round(x[i])), *(int(left[z] // need[z]) for z in set(lengths.tolist())))
        if n <= 0:
            continue
        offset = 0
        for z in lengths.tolist():
            entries.append((z, int(given[z]), sequence, offset))
            given[z] += n
            left[z] -= n
            offset += z
        sequence += n
    position = 0
    for z in range(len(counts) - 1, 0, -1):
        if left[z]:
            entries.append((z, int(given[z]), position, -1))
            position += z * int(left[z])
    full_end = position // window * window
    cuts, end = [], full_end
    for bit in reversed(range(window.bit_length())):
        if (position - full_end) >> bit & 1:
            end += 1 << bit
            cuts.append(end)
    entries.sort()
    e = np.array(entries, np.int64).reshape(-1, 4)
    return Plan(window, (e[:, 0] << 40) | e[:, 1], e[:, 1], e[:, 2], e[:, 3], sequence, np.array(cuts, np.int64), full_end, sequence + full_end // window + len(cuts))


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last = encoder(path).all, end.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, len(texts), AT_ONCE):
                part = [x + last for x in ids(texts.slice(a, AT_ONCE).to_pylist())]
                n = pa.array([len(x) // 4 for x in part], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, AT_ONCE), n, pa.array(part, pa.binary())], names=["doc_id", "n", "ids"])

    return run


PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _cut(plan: Plan):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        window = plan.window
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "place", "windows_before")]
            for doc, n, place, before, raw in zip(*columns, batch.column("ids")):
                data = memoryview(raw.as_buffer())
                full, rest = divmod(n, window)
                pieces = [(i * window, window, plan.sequences + before + i, 0) for i in range(full)]
                if rest:
                    pieces += [(full * window + s, m, q, o) for s, m, q, o in plan.place(rest, place)]
                yield tuple(zip(*[(doc, s, m, zlib.crc32(data[4 * s : 4 * (s + m)]), n, q, o) for s, m, q, o in pieces]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for piece in rows(batches):
            held.append(piece)
            if len(held) >= 10_000:
                yield _table(held)
                held = []
        if held:
            yield _table(held)

    return run


def _table(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v for p in held for v in p[c]], pa.int64()) for c in range(len(PIECES))], schema=PIECES)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = "word_bpe_49k.json", end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    ids = base.mapInArrow(_encode(tokenizer_file(tokenizer), end), "doc_id bigint, n bigint, ids binary")
    ids = stored(ids.withColumn("row", F.monotonically_increasing_id()))  # written, so a row keeps its number
    rests = ids.select("row", "doc_id", (F.col("n") % window).cast("int").alias("rest"), F.floor(F.col("n") / window).cast("bigint").alias("full"))
    counts = np.zeros(window + 1, np.int64)
    total = 0
    for r in rests.groupBy("rest").agg(F.count(F.lit(1)).alias("k")).collect():  # at most ``window`` rows
        total += r.k
        if r.rest:
            counts[r.rest] = r.k
    plan = make_plan(counts, window)
    cut = slices(total, 5_000)
    sliced = rests.withColumn("slice", F.pmod(F.xxhash64("doc_id", "row"), F.lit(cut)).cast("int"))
    order = [F.col("doc_id"), F.col("row")]
    numbered = spread_row_number(sliced, ["rest"], "slice", order, "place")
    long = sliced.where("full > 0").withColumn("all", F.lit(0))
    before = spread_row_number(long, ["all"], "slice", order, "windows_before", F.col("full"))
    placed = numbered.select("row", "place").join(before.select("row", "windows_before"), "row", "left")
    work = ids.join(placed, "row").select("doc_id", "n", "place", F.coalesce("windows_before", F.lit(0)).alias("windows_before"), "ids")
    return work.mapInArrow(_cut(plan), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
