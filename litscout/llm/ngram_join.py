"""N-gram Jaccard join (operator 5): MinHash banding, then verification on full n-gram sets.

Words are the parts of the lower-cased text between runs of ASCII white space, shingles five of them in a row; a
text of one to four words is one shingle, a text without words has none and links with nothing.

1. Every text, in one pass: MinHash values over all its shingles, 16 bits of each. ``bands`` hashes of ``rows``
   values each follow from that signature. Band and row counts follow from the recall wanted at the threshold
   (``banding``). Texts of the same words share one node from there on.
2. Nodes with an equal band hash are candidates. Within each bucket, in blocks, signatures are compared: of pairs
   that agree in ``AGREE`` of the values a spanning forest is kept. (A pair at the threshold 0.8 agrees in that
   few values once in some 10**9 times; a pair that met by chance in one band does not, so chance meetings never
   chain whole clusters together.) Trees that touch are one cluster (distributed components; nothing is collected).
3. The texts of clusters alone are shuffled, once, and every pair within a cluster is compared on its full
   shingle sets: in blocks, so that no task holds an unbounded cluster and no pair becomes a row. Tasks
   return link counts and a spanning forest.

Null text counts as empty. Documents whose texts differ in letter case and white space alone are copies, as in
the query's SQL: they share a node, class and counts. ``n_links`` counts linked nodes, so such a variant of the
same text is in ``copies`` but not in ``n_links``, and several variants of a neighbour are one link.
Repeated rows are copies; a null id can not be the one that stays unless its class has no other; an
empty table gives no rows. Very long texts are sketched in blocks of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import discard, stored
from .blocks import by_group, dealt, in_batches, roots_of
from .common import table, text_of, worker_memo

N_WORDS, THRESHOLD = 5, (4, 5)
RECALL, MOST_HASHES = 0.9995, 128
#: Share of equal signature values from which on a pair in a bucket is a candidate.
AGREE = 0.55
BLOCK_ROWS, BLOCK_BYTES, BUCKET_ROWS = 1024, 16_000_000, 512
#: Shingles that are hashed at once.
CHUNK = 16_384
MEMO = 200_000
NO_ID = 2**63 - 1


def banding(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, that is the fewest candidates, whose recall at the threshold fits in ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of word hashes become even."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a worker remembers those it met."""
    import xxhash

    memo = worker_memo("words")
    new = [w for w in set(words) if w not in memo]
    if new:
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set(words))
        for w in new:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` words in a row from those of the words."""
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return mixed(out + np.uint64(k))


def shingles(text: str, n: int = N_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    words = words_of(text)
    return np.unique(rolled(word_hashes(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def _lows(hashed: list[np.ndarray], n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles of each text, given by its words' hashes; equal for all texts of equal shingles."""
    low = np.empty((len(hashed), len(a)), np.uint32)
    few = [i for i, h in enumerate(hashed) if len(h) < n]
    for i in few:
        low[i] = a * (rolled(hashed[i], len(hashed[i])) >> np.uint64(32)).astype(np.uint32) + b
    many = [i for i, h in enumerate(hashed) if len(h) >= n]
    start = 0
    while start < len(many):
        stop, size = start, 0
        while stop < len(many) and (stop == start or size + len(hashed[many[stop]]) <= CHUNK):
            size += len(hashed[many[stop]])
            stop += 1
        at = many[start:stop]
        h = np.concatenate([hashed[i] for i in at])
        ends = np.cumsum([len(hashed[i]) for i in at])
        s = (rolled(h, n) >> np.uint64(32)).astype(np.uint32)
        inside = np.ones(len(h), bool)
        for k in range(1, n):
            inside[ends - k] = False  # would reach into the next text
        s = s[inside[: len(s)]]
        first = np.r_[0, (ends - (n - 1) * np.arange(1, len(ends) + 1))[:-1]]
        if len(at) == 1:
            low[at[0]] = np.uint32(2**32 - 1)
            for k in range(0, len(s), CHUNK):
                low[at[0]] = np.minimum(low[at[0]], (a[:, None] * s[None, k : k + CHUNK] + b[:, None]).min(1))
        else:
            low[at] = np.minimum.reduceat(a[:, None] * s[None] + b[:, None], first, axis=1).T
        start = stop
    return low


SKETCH = "doc_id bigint, h bigint, nd binary, sig binary"


def _sketcher(hashes: int, n: int):
    """nd: a digest of the words; sig: 16 bits of each MinHash value, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(20240501)
        a = rng.integers(1, 2**32, hashes, np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, hashes, np.uint32)
        for batch in batches:
            split = [words_of(t.as_py()) for t in batch.column("text")]
            nd = [xxhash.xxh3_128_digest(b" ".join(w)) for w in split]
            have = [i for i, w in enumerate(split) if w]
            low = _lows([word_hashes(split[i]) for i in have], n, a, b)
            sig: list[bytes | None] = [None] * len(split)
            for i, row in zip(have, (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")):
                sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(nd, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "h", "nd", "sig"])

    return run


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _agreeing(agree: float):
    """Of each bucket a spanning forest of the pairs whose signatures agree."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in by_group(batches, ["bucket", "bi", "bj"]):
            node, own = group.column("node").to_numpy(), group.column("own").to_numpy()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(node), -1)
            bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
            left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
            root = np.arange(len(node))
            step = max(1, 2_000_000 // (sig.shape[1] * max(1, len(right))))
            for k in range(0, len(left), step):
                part = left[k : k + step]
                p, q = np.nonzero((sig[part][:, None] == sig[right][None]).sum(2) >= agree * sig.shape[1])
                p, q = part[p], right[q]
                if len(p):
                    root = np.minimum(root, roots_of(len(node), np.r_[p, np.arange(len(node))], np.r_[q, root]))
            hit = root != np.arange(len(node))
            if hit.any():
                yield node[root][hit], node[hit]

    return lambda batches: in_batches(rows(batches), EDGES)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of left x right (i < j in ``left`` if ``same``) with Jaccard similarity of 4/5 or more."""
    num, den = THRESHOLD
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= 8:
        found = []
        for x, i in enumerate(left):
            for j in right[x + 1 :] if same else right:
                a, b = sets[i], sets[j]
                if min(len(a), len(b)) * den >= num * max(len(a), len(b)) > 0:
                    if (num + den) * len(np.intersect1d(a, b, True)) >= num * (len(a) + len(b)):
                        found.append((i, j))
        p = np.array(found, np.int64).reshape(-1, 2)
        return p[:, 0], p[:, 1]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    word = np.cumsum(first) - 1
    shared = np.bincount(word) > 1  # a shingle of one set is in no intersection
    keep = shared[word]
    owner, word = owner[keep], (np.cumsum(shared) - 1)[word[keep]]
    inter = np.zeros((len(left), len(right)), np.float32)
    at_left = np.full(len(sets), -1)
    at_left[left] = np.arange(len(left))
    at_right = np.full(len(sets), -1)
    at_right[right] = np.arange(len(right))
    step = 4096
    cuts = np.searchsorted(word, np.arange(0, (word[-1] + 1 if len(word) else 0) + step, step))
    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
        o, w = owner[x:y], word[x:y] - k * step
        m = np.zeros((len(left), step), np.float32)
        s = at_left[o] >= 0
        m[at_left[o[s]], w[s]] = 1
        if same:
            inter += m @ m.T
        else:
            m2 = np.zeros((len(right), step), np.float32)
            s = at_right[o] >= 0
            m2[at_right[o[s]], w[s]] = 1
            inter += m @ m2.T
    good = inter * (num + den) >= num * (size[left][:, None] + size[right][None, :])
    good &= inter > 0
    if same:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    return left[i], right[j]


LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])


def _verifier(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in by_group(batches, ["cluster", "bi", "bj"]):
            node = group.column("node").to_numpy()
            own = group.column("own").to_numpy()
            sets = [shingles(t.as_py(), n) for t in group.column("text")]
            bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
            left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
            p, q = overlaps(sets, left, right, bi == bj)
            if len(p):
                links = np.bincount(p, minlength=len(node)) + np.bincount(q, minlength=len(node))
                root = roots_of(len(node), p, q)
                hit = links > 0
                yield node[hit], links[hit], node[root][hit]

    return lambda batches: in_batches(rows(batches), LINKS)


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, doc rows): nodes (nd, first (id, h), copies, class_id, n_links, stays), doc rows (doc_id, h, nd). h: a hash of the raw text."""
    bands, rows = banding(THRESHOLD[0] / THRESHOLD[1])
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    read = stored(base.mapInArrow(_sketcher(bands * rows, n), SKETCH))
    first = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "h")
    nodes = read.groupBy("nd").agg(F.first("sig").alias("sig"), F.min(first).alias("first"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * rows) + 1, F.lit(2 * rows))))
    buckets = nodes.where("sig IS NOT NULL").select("node", F.explode(band).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = stored(buckets.join(shared, "bucket"))
    met = met.join(nodes.select("node", "sig"), "node")
    met = dealt(met, "bucket", "node", F.ceil(F.col("m") / BUCKET_ROWS)).select("bucket", "bi", "bj", "own", "node", "sig")
    clusters = components(met.mapInArrow(_agreeing(AGREE), "a bigint, b bigint")).select("node", F.col("root").alias("cluster"))
    # the text of one row of each node in a cluster: the row of least id
    chosen = nodes.select("node", "first.id", "first.h").join(clusters, "node")
    rows_of = base.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "h", "text")
    work = stored(rows_of.join(chosen, ["id", "h"]).groupBy("cluster", "node").agg(F.first("text").alias("text")))
    sizes = work.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    pairs = dealt(work.join(sizes, "cluster").withColumn("b", blocks), "cluster", "node", F.col("b"))
    found = stored(pairs.select("cluster", "bi", "bj", "own", "node", "text").mapInArrow(_verifier(n), "node bigint, links bigint, parent bigint"))
    discard(work)
    classes = components(found.where("node <> parent").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = stored(nodes.drop("sig").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = F.struct("first.id", "nd")
    ids_of = known.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min(least).alias("least"))
    stays = (F.col("nd") == F.col("least.nd")).alias("stays")
    return known.join(ids_of, "root").select("nd", "first", "copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), stays), read.select("doc_id", "h", "nd")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id reachable by links), n_links (other nodes linked directly), copies (rows of this node: its text in any letter case and white space), kept."""
    nodes, ids = similarity_links(docs, id_col, text_col)
    kept = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return ids.join(nodes.drop("first"), "nd").select("doc_id", "class_id", "n_links", "copies", kept.alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id; one of repeated rows."""
    names = docs.columns
    nodes, _ = similarity_links(docs, id_col, text_col)
    keep = nodes.where("stays").select("first.id", "first.h")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(row, F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    return rows.join(keep, ["id", "h"]).dropDuplicates(["id", "h"]).select("row.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE_OP5 = r"""
WITH RECURSIVE n AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
node AS (SELECT array_to_string(w, ' ') AS k, min(doc_id) AS id, count(*) AS copies, any_value(w) AS w FROM n GROUP BY array_to_string(w, ' ')),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM node WHERE len(w) > 0)),
c AS (SELECT id, count(*) AS c FROM s GROUP BY id),
m AS (SELECT a.id AS x, b.id AS y, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
p AS (SELECT x, y FROM m JOIN c cx ON cx.id = x JOIN c cy ON cy.id = y WHERE 9 * met >= 4 * (cx.c + cy.c)),
r AS (SELECT id AS x, id AS y FROM node UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
k AS (SELECT x, min(y) AS class_id FROM r GROUP BY x),
l AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT n.doc_id, k.class_id, coalesce(l.links, 0) AS n_links, node.copies, n.doc_id = k.class_id AS kept
FROM n JOIN node ON node.k = array_to_string(n.w, ' ') JOIN k ON k.x = node.id LEFT JOIN l ON l.x = node.id
"""
