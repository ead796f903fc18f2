"""Conversation prefix trie (operator 12): an LCP-aware external mergesort whose merged stream finishes the nodes of a trie.

A conversation is a sequence of turns, a turn being 16 bytes of the SHA-256 of its role and text, so sequences are byte strings in which a
shared turn is 16 equal bytes. Every different sequence is sorted once, whatever the number of conversations that have it.

1. **Sequences** are grouped, with counts, the smallest conversation and the digest of the ids. That digest is made of ids in order; they are sorted
   by (sequence, id) over ranges, so that a sequence that a third of the conversations share spreads over tasks, and only its joined ids, in pieces
   of up to 1 MB, stream through one task, as SHA-256 asks for.
2. **Sort.** Sequences go to ranges of their order. A task cuts what arrives into sorted runs, each sequence with its LCP (shared turns) with the one before;
   runs over a memory bound lie in files. A loser tree merges them: of two heads that share more turns with the last output the longer LCP wins without a
   look at the turns; at equal LCPs comparison begins behind them. Over ``FAN_IN`` runs are merged in several passes.
3. **Stack.** The merged stream, sequences with LCPs, keeps the open path on a stack: what an LCP leaves behind is finished and handed to its parent.
   Finished nodes are spooled and read backwards, parents before children, which gives every node its parent's smallest conversation.
4. **Borders.** A node on the path to a range's first or last sequence may reach into the neighbour ranges. Its parts are written as
   two paths a range; these, already in order, pass through the same stack once more, in one task: two paths for each ``TURNS_A_TASK`` turns. Nodes whose parent is such a node take its conversation in a join.

Memory: a task holds runs of ``MEMORY`` bytes, the heads of ``FAN_IN`` runs and one path. A conversation is one row of 16 bytes and a number for each turn, so one of
millions of turns is held in a task's memory, but its texts are not.

Defined results: null roles and texts are empty. Turns of the same number, or repeated rows, are ordered by role and then by the digest of the text. Rows without a
``conv_id`` belong to no conversation. An empty table gives no rows, not even a root. Very long texts count by all of their bytes. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import table, text_of

TURN = 16
#: Sequences of a run, runs merged at once, bytes of runs and records that a task holds before they go to files, turns of a task.
RUN_ROWS, FAN_IN, MEMORY, TURNS_A_TASK = 1024, 64, 32 << 20, 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


# Rebuilt conversations


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<token, size>>): each conversation's turns in order, as hexadecimal digests with the bytes of their texts."""
    role, text = text_of(role_col), text_of(text_col)
    token = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), token.alias("token"), F.octet_length(text).cast("bigint").alias("size")).alias("x")
    )
    turns = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["token"].alias("token"), x["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(own: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Conversation c: the first h turns of conversation c - c % group, then its own from turn h on, where h = crc32(c) % heads."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = own.withColumn("base", base).withColumn("h", h).join(first, "base", "left")
    begin = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return rows.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


# Sorting


@dataclass
class Entry:
    """A different sequence; ``lcp``: turns shared with the one before it in its run."""

    seq: bytes
    sizes: list[int]
    n: int
    least: int
    ends: str
    lcp: int = 0


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The number of leading turns in which both agree, of which ``known`` are known to; steps double, then halve."""
    most = min(len(a), len(b)) // TURN
    step = 1
    while known + step <= most and a[known * TURN : (known + step) * TURN] == b[known * TURN : (known + step) * TURN]:
        known += step
        step *= 2
    while step := step // 2:
        if known + step <= most and a[known * TURN : (known + step) * TURN] == b[known * TURN : (known + step) * TURN]:
            known += step
    return known


class Spool:
    """Records in the order they came, in a file without a name as soon as they exceed ``most``; read forwards or backwards."""

    def __init__(self, most: int):
        self.most, self.held, self.blocks, self.file = most, [], [], None

    def add(self, record: object) -> None:
        self.held.append(record)
        if len(self.held) >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.blocks.append(self.file.tell())
            pickle.dump(self.held, self.file, pickle.HIGHEST_PROTOCOL)
            self.held = []

    def _block(self, at: int) -> list:
        self.file.seek(at)
        return pickle.load(self.file)

    def __iter__(self) -> Iterator:
        for at in self.blocks:
            yield from self._block(at)
        yield from self.held

    def __reversed__(self) -> Iterator:
        yield from reversed(self.held)
        for at in reversed(self.blocks):
            yield from reversed(self._block(at))


class LoserTree:
    """Merges sorted runs with LCPs into one. A contender's LCP is that with the last output, which is all that decides unless two are equal."""

    def __init__(self, runs: list[Iterable[Entry]]):
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.lcp = [0 if e else -1 for e in self.head]
        self.compared = 0
        size = 1 << max(0, len(runs) - 1).bit_length()
        self.size, self.loser = size, [-1] * size
        winner = [i if i < len(runs) else -1 for i in range(size)]
        at = size
        while len(winner) > 1:
            at -= len(winner) // 2
            pairs, winner = zip(winner[::2], winner[1::2]), []
            for k, (a, b) in enumerate(pairs):
                won, self.loser[at + k] = self.duel(a, b)
                winner.append(won)
            at = len(winner)
        self.winner = winner[0]

    def duel(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP becomes that with the winner."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        if self.head[a] is None:
            return a, b
        x, y = self.head[a].seq, self.head[b].seq
        self.compared += 1
        common = shared(x, y, self.lcp[a])
        won, lost = (a, b) if x[common * TURN :] <= y[common * TURN :] else (b, a)
        self.lcp[lost] = common
        return won, lost

    def __iter__(self) -> Iterator[Entry]:
        while self.winner >= 0 and self.head[self.winner] is not None:
            i = self.winner
            out = self.head[i]
            out.lcp = self.lcp[i]
            following = next(self.runs[i], None)
            yield out
            self.head[i] = following
            self.lcp[i] = following.lcp if following else -1
            at = (self.size + i) // 2
            while at:
                i, self.loser[at] = self.duel(i, self.loser[at])
                at //= 2
            self.winner = i


def merge_sorted(entries: Iterable[Entry], run_rows: int = RUN_ROWS, fan_in: int = FAN_IN, memory: int = MEMORY) -> Iterator[Entry]:
    """The entries in order of their sequences, each with its LCP with the one before."""
    levels: list[list[Spool]] = [[]]
    used = 0

    def put(level: int, run: Spool) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) == fan_in:
            merged = Spool(run_rows)
            for e in LoserTree(levels[level]):
                merged.add(e)
            levels[level] = []
            put(level + 1, merged)

    def close(rows: list[Entry]) -> None:
        nonlocal used
        rows.sort(key=lambda e: e.seq)
        before = b""
        run = Spool(run_rows + 1)
        for e in rows:
            e.lcp, before = shared(before, e.seq), e.seq
            run.add(e)
        used += sum(len(e.seq) * 2 + 400 for e in rows)
        if used > memory:
            for each in levels[0] + [run]:
                each.flush()
            used = 0
        put(0, run)

    rows: list[Entry] = []
    size = 0
    for e in entries:
        rows.append(e)
        size += len(e.seq)
        if len(rows) == run_rows or size > memory // 8:
            close(rows)
            rows, size = [], 0
    if rows:
        close(rows)
    yield from LoserTree([r for level in levels for r in level])


# The stack


class Node:
    __slots__ = ("size", "n", "least", "children", "leaves", "saved", "ends")

    def __init__(self, size: int):
        self.size, self.n, self.least, self.children, self.leaves, self.saved, self.ends = size, 0, None, 0, 0, 0, None

    def meet(self, n: int, least: int | None, children: int, leaves: int, saved: int, ends: str | None) -> None:
        """Adds what a part of the node, or a sequence that ends in it, brings."""
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.children, self.leaves, self.saved, self.ends = self.children + children, self.leaves + leaves, self.saved + saved, ends or self.ends

    def part(self) -> tuple:
        return self.n, self.least, self.children, self.leaves, self.saved, self.ends


class OpenPath:
    """The nodes from the root to the last sequence. ``finish(depth, node)`` is told of each node that is left behind and says whether the parent is to have it."""

    def __init__(self, finish: Callable[[int, Node], bool]):
        self.nodes: list[Node] = []
        self.finish = finish

    def leave(self, depth: int) -> None:
        """Finishes what lies deeper."""
        while len(self.nodes) > depth + 1:
            node = self.nodes.pop()
            if self.finish(len(self.nodes), node) and self.nodes:
                leaf = node.children == 0
                node.leaves += leaf
                node.saved += (node.n - 1) * node.size
                self.nodes[-1].meet(node.n, node.least, 1, node.leaves, node.saved, None)

    def enter(self, sizes: list[int], lcp: int) -> None:
        """Moves to a sequence that shares ``lcp`` turns with the last one."""
        self.leave(lcp)
        if not self.nodes:
            self.nodes.append(Node(0))
        for size in sizes[len(self.nodes) - 1 :]:
            self.nodes.append(Node(size))


def _final(node: Node) -> tuple:
    """n_children, n_leaves, saved_tokens of a node whose parts have all been met."""
    return node.children, node.leaves + (node.children == 0), node.saved + (node.n - 1) * node.size


#: A range's rows: finished nodes, with the place (side, place) of a parent on a border instead of its conversation, and border paths (the rest).
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PATH = "seq binary, sizes array<bigint>, begin bigint, parts array<struct<n: bigint, least: bigint, children: bigint, leaves: bigint, saved: bigint, ends: string>>"
NODE_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in NODE.split(", ")])
PART_ARROW = pa.struct([(k, pa.string() if k == "ends" else pa.int64()) for k in ("n", "least", "children", "leaves", "saved", "ends")])
RANGE_ARROW = pa.schema(
    [("range", pa.int64()), ("side", pa.int64()), ("place", pa.int64()), *NODE_ARROW, ("seq", pa.binary()), ("sizes", pa.list_(pa.int64())), ("begin", pa.int64()), ("parts", pa.list_(PART_ARROW))]
)
RESOLVED_ARROW = pa.schema([("range", pa.int64()), ("side", pa.int64()), ("place", pa.int64()), *NODE_ARROW])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Rows that may be shorter than the schema, whose rest is null."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        full = [r + (None,) * (len(schema) - len(r)) for r in held]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def range_rows(number: int, entries: Iterator[Entry], spool: int = 20_000) -> Iterator[tuple]:
    """The nodes that lie within one range of sorted sequences, and the two paths of those that may not."""
    done = Spool(spool)
    left: list[tuple | None] = []
    left_depth = 0  # so many of the open nodes, beside the root, are on the path to the first sequence

    def finish(depth: int, node: Node) -> bool:
        if depth <= left_depth:
            left[depth] = node.part()
            return False
        done.add((depth, node.least, node.n, *_final(node), node.ends, depth - 1 <= left_depth))
        return True

    path = OpenPath(finish)
    first = last = None
    for e in entries:
        if first is None:
            first, left_depth, left = e, len(e.sizes), [None] * (len(e.sizes) + 1)
            path.enter(e.sizes, 0)
        else:
            path.leave(e.lcp)
            left_depth = min(left_depth, e.lcp)
            path.enter(e.sizes, e.lcp)
        path.nodes[-1].meet(e.n, e.least, 0, 0, 0, e.ends)
        last = e
    if first is None:
        return
    for depth in range(left_depth + 1):
        left[depth] = path.nodes[depth].part()
    right = [n.part() for n in path.nodes[left_depth + 1 :]]
    none = (None,) * len(NODE_ARROW)
    yield (number, 0, None, *none, first.seq, first.sizes, 0, [_named(p) for p in left])
    if right:
        yield (number, 1, None, *none, last.seq, last.sizes, left_depth + 1, [_named(p) for p in right])
    above: dict[int, int | None] = {}  # of each depth the parent that the records read backwards lie below; none: on the right border
    for depth, least, n, children, leaves, saved, ends, on_left in reversed(done):
        parent = None if on_left else above.get(depth - 1)
        border = (0 if on_left else 1, depth - 1) if parent is None else (None, None)
        above[depth] = least
        yield (number, *border, least, depth, parent, n, children, leaves, saved, ends or NO_ENDS)


def _named(part: tuple) -> dict:
    return dict(zip(("n", "least", "children", "leaves", "saved", "ends"), part))


def border_rows(paths: Iterator[tuple], spool: int = 20_000) -> Iterator[tuple]:
    """The nodes on borders, from the paths (range, side, seq, sizes, begin, parts) of all ranges in order; and for each path the conversations of its nodes."""
    done = Spool(spool)

    def finish(depth: int, node: Node) -> bool:
        done.add((depth, node.least, node.n, *_final(node), node.ends))
        return True

    path = OpenPath(finish)
    before = b""
    for number, side, seq, sizes, begin, parts in paths:
        path.enter(sizes, shared(before, seq))
        for depth, p in enumerate(parts, begin):
            path.nodes[depth].meet(p["n"], p["least"], p["children"], p["leaves"], p["saved"], p["ends"])
        done.add((number, side, begin, len(sizes)))
        before = seq
    path.leave(-1)
    above: dict[int, int] = {-1: None}
    for record in reversed(done):
        if len(record) == 4:
            number, side, begin, depth = record
            for place in range(begin, depth + 1):
                yield number, side, place, above[place]
        else:
            depth, least, n, children, leaves, saved, ends = record
            above[depth] = least
            yield (None, None, None, least, depth, above[depth - 1], n, children, leaves, saved, ends or NO_ENDS)


# On Spark


def ends(rows: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """(sk, ends): SHA-256 of each sequence's ids (sk, conv_id), ascending, joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            last, first, held, size = None, 0, [], 0
            for batch in batches:
                for sk, conv in zip(batch.column("sk").to_pylist(), batch.column("conv_id").to_pylist()):
                    if held and (sk != last or size > piece):
                        yield last, first, ",".join(held)
                        held, size = [], 0
                    if not held:
                        last, first = sk, conv
                    held.append(str(conv))
                    size += len(held[-1]) + 1
            if held:
                yield last, first, ",".join(held)

        yield from _batches(pieces(), pa.schema([("sk", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]), 1_000)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            last, sha = None, None
            for batch in batches:
                for sk, ids in zip(batch.column("sk").to_pylist(), batch.column("ids").to_pylist()):
                    if sk == last:
                        sha.update(b",")
                    else:
                        if sha:
                            yield last, sha.hexdigest()
                        last, sha = sk, hashlib.sha256()
                    sha.update(ids.encode())
            if sha:
                yield last, sha.hexdigest()

        yield from _batches(digests(), pa.schema([("sk", pa.binary()), ("ends", pa.string())]))

    pieces = rows.select("sk", "conv_id").repartitionByRange("sk", "conv_id").sortWithinPartitions("sk", "conv_id").mapInArrow(joined, "sk binary, first bigint, ids string")
    return pieces.repartition("sk").sortWithinPartitions("sk", "first").mapInArrow(digested, "sk binary, ends string")


def trie(conversations: DataFrame, turns_a_task: int = TURNS_A_TASK, run_rows: int = RUN_ROWS) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["token"]), ""))
    rows = conversations.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = stored(rows.withColumn("sk", F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * TURN))))
    groups = rows.groupBy("sk").agg(F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    different = stored(groups.join(ends(rows), "sk").drop("sk"))
    turns = different.agg(F.sum(F.size("sizes"))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(turns or 0) // turns_a_task))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[Entry]:
            for batch in batches:
                for values in zip(*(batch.column(c).to_pylist() for c in ("seq", "sizes", "n", "least", "ends"))):
                    yield Entry(*values)

        yield from _batches(range_rows(TaskContext.get().partitionId(), merge_sorted(entries(), run_rows)), RANGE_ARROW)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (values for batch in batches for values in zip(*(batch.column(c).to_pylist() for c in ("range", "side", "seq", "sizes", "begin", "parts"))))
        yield from _batches(border_rows(paths), RESOLVED_ARROW)

    place = "range bigint, side bigint, place bigint, "
    found = stored(different.repartitionByRange(ranges, "seq").mapInArrow(sort, f"{place}{NODE}, {PATH}"))
    border = stored(found.where("seq IS NOT NULL").select("range", "side", "seq", "sizes", "begin", "parts").repartition(1).sortWithinPartitions("range", "side").mapInArrow(close, place + NODE))
    names = [x.split()[0] for x in NODE.split(", ")]
    nodes = found.where("seq IS NULL")
    parents = border.where("range IS NOT NULL").select("range", "side", "place", F.col("conv_id").alias("above"))
    below = nodes.where("side IS NOT NULL").join(parents, ["range", "side", "place"]).withColumn("parent_conv_id", F.col("above"))
    return nodes.where("side IS NULL").select(*names).union(below.select(*names)).union(border.where("range IS NULL").select(*names))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


ORACLE_OP12 = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x FROM conversations),
o AS (SELECT conv_id, list(x ORDER BY i) AS s FROM t GROUP BY conv_id),
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS c FROM range(256) AS u(i)),
h AS (SELECT conv_id, s, xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a // 256, c[xor(a % 256, b) + 1])), 4294967295) % 9 AS h FROM o, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ends FROM r, unnest(generate_series(0, len(s))) AS u(d)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * strlen(k[d].t), 0) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
c AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.k = n.k AND c.d = n.d),
a AS (SELECT k[1:e] AS k, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM m, unnest(generate_series(0, d)) AS u(e) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens, m.ends_sha256
FROM m JOIN a ON a.k = m.k AND a.d = m.d LEFT JOIN n q ON q.d = m.d - 1 AND q.k = m.k[1:m.d - 1]
"""
