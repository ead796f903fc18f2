"""Suffix-array dedup (operator 2): removes every byte that a repeated 400-byte string covers.

The suffixes are bucketed by q-grams and the buckets refined on bucket identifiers of other offsets until
400 bytes are compared, as bucket-pointer refinement does; positions whose bucket holds them alone leave.
To order 864 MB of suffixes on disk would take many times the input, so each start is represented by an
anchor that its own 400 bytes determine: the rightmost q-gram of smallest hash among the first ``SPAN``
q-grams. Equal strings have their anchors at the same offset, so they meet in one initial bucket, keyed by
the ``400 - SPAN + 1`` bytes from the anchor on, which every start of that anchor contains. Starts of
one anchor follow each other; together with the bytes they reach they are a *region*.

1. One pass over the texts lists (bucket, region digest) without text. Buckets that hold one region once
   are done. Regions of equal bytes, known by both 64-bit digests, that occur twice are repeated wholly.
2. The rest of the buckets hold different regions: one copy of each goes, with its bytes, to its
   bucket's task. There every position of a region begins in the bucket of its q-gram of four bytes, and buckets are
   refined on the identifiers of later positions, 4, 8, 16 ... 256 and 144 bytes on, until they are buckets of 400
   bytes (``refine``). No digest decides here: bytes do. Buckets of over ``CHUNK`` bytes are split by classes of
   starts first, so that no task gathers more (``refined``).
3. The repeated starts return to their texts; covered bytes are cut.

Texts are UTF-8 bytes; null is empty; matches end at document ends; texts under 400 bytes lose nothing; a
text that occurs twice loses all of its bytes from 400 on. Null ids and repeated rows are documents like
others; an empty table gives no rows. Very long texts are scanned in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, stored
from .blocks import by_group, in_batches
from .common import table, text_of

LENGTH, Q, SPAN = 400, 16, 336
#: Bytes of the q-grams that refinement begins with; bytes of a text that are scanned at once.
Q0, BLOCK = 4, 4_000_000
#: Bytes of regions that are refined at once; larger buckets are split by classes of so many starts, one after the other.
CHUNK, WIDTHS = 1_000_000, (48, 8, 1)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def anchors(data: bytes, length: int = LENGTH, span: int = SPAN) -> Iterator[tuple[int, int, int]]:
    """(anchor, first start, last start) for runs of starts of ``length``-byte strings with one anchor."""
    for at in range(0, len(data) - length + 1, BLOCK):
        starts = min(BLOCK, len(data) - length + 1 - at)
        part = data[at : at + starts + length - 1]
        n = len(part)
        x = np.ndarray((n - 7,), "<u8", part, strides=(1,))
        h = x[: n - Q + 1] * C1 + x[8 : n - Q + 9] * C2
        h ^= h >> np.uint64(32)
        h *= C3
        h &= np.uint64(0xFFFFFFFFFF000000)
        h |= np.arange(0xFFFFFF, 0xFFFFFF - len(h), -1, dtype=np.uint64)  # of equal hashes the rightmost is least
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        pos = 0xFFFFFF - (h[:starts] & np.uint64(0xFFFFFF)).astype(np.int64)
        ends = np.flatnonzero(np.diff(pos)).tolist()
        for a, b in zip([0, *(e + 1 for e in ends)], [*ends, starts - 1]):
            yield at + int(pos[a]), at + a, at + b


def regions(data: bytes, length: int = LENGTH, span: int = SPAN) -> Iterator[tuple[int, int, int, int, int]]:
    """(bucket, region digest, anchor, first start, last start)."""
    from xxhash import xxh3_64_intdigest as digest64

    for a, s, e in anchors(data, length, span):
        bucket = digest64(data[a : a + length - span + 1])
        region = digest64(data[s : e + length], seed=a - s)
        yield bucket - (1 << 63), region - (1 << 63), a, s, e


ROWS = pa.schema([("did", pa.binary()), ("bucket", pa.int64()), ("region", pa.int64()), ("n", pa.int32())])


def _lister(length: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        did: list[bytes] = []
        keys: list[tuple[int, int]] = []
        n: list[int] = []
        for batch in batches:
            for d, text in zip(batch.column("did"), batch.column("text")):
                data = text.as_buffer().to_pybytes()
                if len(data) < length:
                    continue
                seen: dict[tuple[int, int], int] = {}
                for b, r, *_ in regions(data, length, span):
                    seen[b, r] = seen.get((b, r), 0) + 1
                did += [d.as_py()] * len(seen)
                keys += seen
                n += seen.values()
                if len(did) > 50_000:
                    yield _rows(did, keys, n)
                    did, keys, n = [], [], []
        if did:
            yield _rows(did, keys, n)

    return run


def _rows(did: list, keys: list, n: list) -> pa.RecordBatch:
    b, r = zip(*keys)
    return pa.RecordBatch.from_arrays([pa.array(did, pa.binary()), pa.array(b, pa.int64()), pa.array(r, pa.int64()), pa.array(n, pa.int32())], schema=ROWS)


PARTS = "did binary, bucket bigint, home bigint, region bigint, once boolean, near int, far int, bytes binary"
SENT = pa.schema([("did", pa.binary()), ("bucket", pa.int64()), ("home", pa.int64()), ("region", pa.int64()), ("once", pa.bool_()), ("near", pa.int32()), ("far", pa.int32()), ("bytes", pa.binary())])


def _sender(length: int, span: int):
    """The bytes of regions that this text stands for, for their bucket's task. near, far: distances of the last and first start before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for did, text, sent in zip(batch.column("did"), batch.column("text"), batch.column("sent")):
                want = {(x["bucket"], x["region"]): x["once"] for x in sent.as_py() or ()}
                if not want:
                    continue
                data, d = text.as_buffer().to_pybytes(), did.as_py()
                for b, r, a, s, e in regions(data, length, span):
                    if (once := want.pop((b, r), None)) is not None:
                        out.append((d, b, b, r, once, a - e, a - s, data[s : e + length]))
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SENT.types)], schema=SENT)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SENT.types)], schema=SENT)

    return run


def renumber(ident: np.ndarray, live: np.ndarray, a: np.ndarray, b: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Gives the live positions bucket identifiers from ``first`` on, in the order of their pairs (a, b); (positions whose bucket others share, next identifier)."""
    if not len(live):
        return live, first
    key = a.astype(np.int64) * (int(b.max()) + 1) + b
    order = np.argsort(key)
    new = np.r_[False, np.diff(key[order]) != 0]
    rank = np.cumsum(new)
    ident[live[order]] = first + rank
    many = np.bincount(rank)[rank] > 1
    return np.sort(live[order][many]), first + int(rank[-1]) + 1


def refine(bucket: np.ndarray, near: np.ndarray, far: np.ndarray, parts: list[bytes], length: int = LENGTH, span: int = SPAN) -> np.ndarray:
    """repeated[i, k]: whether the start k bytes before region i's anchor begins a string that another region has at the same k.

    Bucket-pointer refinement over the regions' bytes: positions at the same distance from the anchors of one bucket begin in
    buckets of equal q-grams of ``Q0`` bytes, and a bucket of h bytes is refined by the identifiers that the
    positions further on have by then, which doubles h; the identifiers of one round are the pointers of the next.
    A position that is alone in its bucket leaves and keeps its identifier, as whatever begins there is alone.
    """
    m = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(parts) + bytes(Q0), np.uint8)
    total = int(ends[-1])
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    at = np.arange(total, dtype=np.int32)
    left = np.repeat(ends.astype(np.int32), sizes) - at
    place = at - np.repeat((ends - sizes + far).astype(np.int32), sizes) + span  # from 0 on; the anchor's is span
    _, group = np.unique(bucket, return_inverse=True)
    ident = np.full(total, -1, np.int32)
    live = np.flatnonzero(left >= Q0)
    gram = np.ndarray((total,), "<u4", data, strides=(1,))
    live, first = renumber(ident, live, group[owner[live]] * (span + length + 1) + place[live], gram[live], 0)
    h = Q0
    while h < length and len(live):
        step = min(h, length - h)
        live = live[left[live] >= h + step]
        live, first = renumber(ident, live, ident[live], ident[live + step], first)
        h += step
    repeated = np.zeros((m, span), bool)
    repeated[owner[live], span - place[live]] = True
    return repeated


FOUND = pa.schema([("did", pa.binary()), ("bucket", pa.int64()), ("region", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _refiner(length: int, span: int, chunk: int):
    def solve(groups: list[pa.Table]) -> tuple | None:
        t = pa.concat_tables(groups)
        near, far = t.column("near").to_numpy().astype(np.int64), t.column("far").to_numpy().astype(np.int64)
        hit = refine(t.column("bucket").to_numpy(), near, far, t.column("bytes").to_pylist(), length, span)
        hit &= np.asarray(t.column("once"))[:, None]  # the others are repeated wholly anyway
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        if not len(row):
            return None
        did = np.empty(t.num_rows, object)
        did[:] = t.column("did").to_pylist()
        return did[row], t.column("home").to_numpy()[row], t.column("region").to_numpy()[row], lo, hi - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[pa.Table] = []
        n = 0
        for group in by_group(batches, ["bucket"]):
            if group.num_rows > 1:
                held.append(group)
                n += group.column("bytes").nbytes
            if n >= chunk:
                if (got := solve(held)) is not None:
                    yield got
                held, n = [], 0
        if held and (got := solve(held)) is not None:
            yield got

    return lambda batches: in_batches(rows(batches), FOUND)


def _splitter(length: int, width: int):
    """Rows of large buckets by classes of ``width`` starts: the bucket of a class is that of all bytes that its starts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest64

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("did", "bucket", "home", "region", "once", "near", "far", "bytes")]
            out: list[tuple] = []
            for did, bucket, home, region, once, near, far, data in zip(*columns):
                for c in range(near // width, far // width + 1):
                    # every start of the class holds the bytes from its last start's string's first to its first start's string's last
                    a, b = max(near, c * width), min(far, (c + 1) * width - 1)
                    shared = data[far - c * width : far - (c + 1) * width + 1 + length] if c * width <= far else b""
                    key = digest64(shared, seed=(bucket ^ c) & (2**64 - 1)) - (1 << 63)
                    out.append((did, key, home, region, once, a, b, data[far - b : far - a + length]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SENT.types)], schema=SENT)

    return run


CUT = pa.schema([("did", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def spans(data: bytes, whole: set, ranges: dict, length: int = LENGTH, span: int = SPAN) -> list[tuple[int, int]]:
    """The maximal runs of bytes that repeated strings cover."""
    starts = []
    for b, r, a, s, e in regions(data, length, span):
        if (b, r) in whole:
            starts.append((s, e))
        else:
            starts += [(a - hi, a - lo) for lo, hi in ranges.get((b, r), ())]
    out: list[tuple[int, int]] = []
    for s, e in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e + length))
        else:
            out.append((s, e + length))
    return out


def _cutter(length: int, span: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, text, whole, found in zip(*(batch.column(c) for c in ("did", "text", "whole", "found"))):
                data = text.as_buffer().to_pybytes()
                ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for x in found.as_py() or ():
                    ranges.setdefault((x["bucket"], x["region"]), []).append((x["lo"], x["hi"]))
                cut = spans(data, {(x["bucket"], x["region"]) for x in whole.as_py() or ()}, ranges, length, span)
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)]))
                out.append((did.as_py(), sum(e - s for s, e in cut), len(cut), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CUT.types)], schema=CUT)

    return run


def refined(parts: DataFrame, length: int, span: int, chunk: int) -> DataFrame:
    """(did, bucket, region, lo, hi): runs of distances of repeated starts, from regions' bytes.

    Each bucket of up to ``chunk`` bytes is refined in one task. The regions of a larger one are cut into classes of starts,
    whose buckets are those of the longer strings that all starts of a class share, and so on; classes of one start
    share all their bytes or differ, so there grouping on the bytes decides.
    """
    schema = "did binary, bucket bigint, region bigint, lo int, hi int"
    found = []
    for width in WIDTHS:
        parts = stored(parts)
        large = parts.groupBy("bucket").agg(F.sum(F.octet_length("bytes")).alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > chunk) & (F.col("n") > 1))
        large = stored(large.select("bucket"))
        some = large.limit(1).count() > 0
        small = parts.join(large, "bucket", "left_anti") if some else parts
        found.append(small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refiner(length, span, chunk), schema))
        if not some:
            break
        parts = parts.join(large, "bucket").mapInArrow(_splitter(length, width), PARTS)
    else:
        parts = stored(parts)
        twice = parts.groupBy("bucket", "near", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        hit = parts.where("once").join(twice, ["bucket", "near", "bytes"])
        found.append(hit.select("did", F.col("home").alias("bucket"), "region", F.col("near").alias("lo"), F.col("near").alias("hi")))
    return reduce(DataFrame.union, found)


def cut_texts(base: DataFrame, length: int = LENGTH, span: int = SPAN, chunk: int = CHUNK, with_text: bool = False) -> DataFrame:
    """(did, n_removed, n_spans, kept_sha256, kept) of the different texts with repeated strings, from rows (did, text)."""
    listed = stored(base.where(F.octet_length("text") >= length).mapInArrow(_lister(length, span), "did binary, bucket bigint, region bigint, n int"))
    buckets = listed.groupBy("bucket").agg(F.sum("n").alias("total"), (F.min("region") != F.max("region")).alias("mixed")).where("total > 1")
    shared = stored(listed.join(buckets, "bucket").select("did", "bucket", "region", "n", "mixed"))
    discard(listed)
    # of each region of a mixed bucket: how often it occurs, and the text that stands for it
    kinds = shared.where("mixed").groupBy("bucket", "region").agg(F.sum("n").alias("times"), F.min("did").alias("stands"))
    kinds = stored(kinds)
    same = ["bucket", "region"]
    mixed = shared.where("mixed").join(kinds, same).select("did", *same, (F.col("times") > 1).alias("whole"), (F.col("did") == F.col("stands")).alias("sent"))
    plain = shared.where("NOT mixed").select("did", *same, F.lit(True).alias("whole"), F.lit(False).alias("sent"))
    both = plain.union(mixed).where("whole OR sent")
    per_text = both.groupBy("did").agg(
        F.collect_set(F.when(F.col("whole"), F.struct(*same))).alias("whole"),
        F.collect_set(F.when(F.col("sent"), F.struct(*same, (~F.col("whole")).alias("once")))).alias("sent"),
    )
    texts = base.groupBy("did").agg(F.first("text").alias("text"))
    work = stored(texts.join(per_text, "did"))
    parts = work.where(F.size("sent") > 0).select("did", "text", "sent").mapInArrow(_sender(length, span), PARTS)
    found = refined(parts, length, span, chunk)
    found = found.groupBy("did").agg(F.collect_list(F.struct(*same, "lo", "hi")).alias("found"))
    cut = work.select("did", "text", "whole").join(found, "did", "left")
    return cut.mapInArrow(_cutter(length, span, with_text), "did binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").where("n_removed > 0")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **parameters: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``with_text`` also the bytes kept."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    rows = rows.withColumn("did", F.unhex(F.substring("sha", 1, 32)))
    cut = stored(cut_texts(rows.select("did", "text"), with_text=with_text, **parameters))
    cut = cut if with_text else cut.drop("kept")
    columns = ["doc_id", "sha", "did", F.octet_length("text").cast("bigint").alias("n_bytes"), *(["text"] if with_text else [])]
    out = rows.select(*columns).join(cut, "did", "left")
    zero = F.lit(0).cast("bigint")
    result = ["doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*result, *([F.coalesce("kept", F.encode("text", "utf-8")).alias("kept")] if with_text else []))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
