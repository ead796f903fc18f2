"""Pairs of similar titles (JN3, JN4, S23), of which none is lost.

A token-set score of ``threshold`` comes about in one of two ways.

**By words**: all words of one title but some that make up at most a share ``2 (1 - threshold) / (2 - threshold)`` of its length are in the other. An index
finds these. With words ordered from the rarest on, the first words that together exceed that share, the prefix, hold a common one, and somewhat more words hold
two. A title posts its rare prefix words alone, and pairs of its first frequent words, as one frequent word is found in too many titles; the other side posts its rare
words and the pairs of its frequent ones (titles of very many frequent words post these alone, and meet single words). Keys are counted, and one of many
rows is cut into blocks on both sides, each pair of blocks a task of its own.

**By spelling**: the words that are not common differ in at most ``D = (1 - threshold) (size + size')`` insertions and deletions, a fifth of a title's
length. Then the lengths agree, most letters are common and, as an edit changes three letter pairs at most, so are most pairs. Classes of length are cut into blocks; a task multiplies two
blocks' matrices of letters, whose product is the number of common ones, and looks at the letter pairs of what is left. This compares all titles of neighbouring classes, at
matrix speed. A pigeonhole index of ``D + 1`` pieces was built and measured first: pieces have two or three letters at a fifth of edits, and on 25,000 titles of a Zipf vocabulary 261 million
pairs met in a piece, of 312 million that there are; no partition into longer pieces exists.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import title_score
from ..storage import discard, stored

#: Titles that hold a frequent word at least; frequent words beyond which a title's pairs are not made; rows of a key, and titles of a class, beyond which they are cut.
FREQUENT, MANY, KEY_ROWS, BLOCK_TITLES = 200, 40, 20_000, 8_192
#: Hashed letter pairs of a title for each of its letters at least, and of all; hashed letters.
SPREAD, LEAST_PAIRS, LETTERS = 4, 256, 64
#: Titles of which the posts, some hundreds for each when most words are frequent, are held at once.
POSTED = 256
#: Titles and cells of a matrix, cells of the pairs that are looked at together, and cells of matrices that are kept for the next rows.
TILE, TILE_CELLS, CANDIDATE_CELLS, HELD_CELLS = 1024, 1 << 21, 1 << 20, 1 << 23


# Features of a title


def distinct_words(title: str) -> list[str]:
    return sorted({w for w in title.split(" ") if w})


def letter_pairs(words: list[str]) -> bytes:
    """A 32-bit hash of each (letter pair, occurrence), the first letter of a word paired with a blank."""
    seen: dict = {}
    out = []
    for w in words:
        before = 32
        for c in map(ord, w):
            k = seen[before, c] = seen.get((before, c), 0) + 1
            out.append(((before * 65_599 + c) * 2_654_435_761 + k * 40_503_001) >> 7 & 0xFFFFFFFF)
            before = c
    return np.array(out, "<u4").tobytes()


def letters(words: list[str]) -> bytes:
    """How often each letter occurs, letters folded to ``LETTERS``, counts capped; that only brings titles closer."""
    return np.minimum(np.bincount([ord(c) % LETTERS for w in words for c in w], minlength=LETTERS), 255).astype(np.uint8).tobytes()


def key_of(*words: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def probes(words: list[tuple[int, str]], threshold: float, frequent: int) -> tuple[list[int], list[int]]:
    """(keys, keys for titles of many words) of one title's words (titles that hold it, word) from the rarest on.

    A title of which all words but such of the share are in another meets it in one of the keys.
    """
    size = sum(len(w) + 1 for _, w in words) - 1
    spare = 2 * (1 - threshold) / (2 - threshold) * size + 1e-6
    lost, keys, wide = 0, [], []
    for i, (n, w) in enumerate(words):
        if lost > spare:
            return keys, wide
        if n > frequent:
            break
        keys.append(key_of(w))
        lost += len(w) + 1
    else:
        return keys, wide
    # none of the rare words is common, so the frequent ones may lose what is left of the share
    spare -= lost
    rest = [w for _, w in words[i:]]
    held = longest = 0
    for k, w in enumerate(rest):
        if held <= spare:
            wide.append(key_of(w))
        held, longest = held + len(w) + 1, max(longest, len(w) + 1)
        if held - longest > spare:  # two of them are common
            return keys + [key_of(*sorted(p)) for p in _two_of(rest[: k + 1])], wide
    return keys + [key_of("", x) for x in rest[: len(wide)]], wide


def _two_of(words: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(words) for b in words[i + 1 :]]


def postings(words: list[tuple[int, str]], frequent: int, many: int = MANY) -> tuple[list[int], list[int]]:
    """What ``probes`` meets: rare words, pairs of frequent ones and, marked, these alone; for titles of many frequent words these alone, apart."""
    keys = [key_of(w) for n, w in words if n <= frequent]
    often = [w for n, w in words if n > frequent]
    if len(often) > many:
        return keys, [key_of(w) for w in often]
    return keys + [key_of(*sorted(p)) for p in _two_of(often)] + [key_of("", w) for w in often], []


# Tables


def features(titles: DataFrame, threshold: float) -> DataFrame:
    """(id, t, size, class, pairs, letters). Titles alike in spelling are of the same or of neighbouring classes of size."""
    step = math.log((2 - threshold) / threshold) * (1 + 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("t").to_pylist():
                if words := distinct_words(t):
                    size = sum(map(len, words)) + len(words) - 1
                    rows.append((t, size, int(math.log(size) / step), letter_pairs(words), letters(words)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["t", "size", "class", "pairs", "letters"])

    return stored(titles.select("t").mapInArrow(run, "t string, size int, class int, pairs binary, letters binary").select(F.monotonically_increasing_id().alias("id"), "*"))


def counted_words(sides: list[DataFrame]) -> list[DataFrame]:
    """(id, size, words array<struct<n, word>>) of each side, rarest first; counts cover both sides."""
    words = F.array_distinct(F.filter(F.split("t", " "), lambda w: w != ""))
    each = [d.select("id", "size", F.explode(words).alias("word")) for d in sides]
    both = each[0] if len(each) == 1 else each[0].union(each[1])
    counts = stored(both.groupBy("word").agg(F.count(F.lit(1)).alias("n")))  # written, so that Spark can split its join on a word that many titles hold
    return [d.join(counts, "word").groupBy("id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "word"))).alias("words")) for d in each]


def blocked(posts: DataFrame, most: int) -> DataFrame:
    """Posts (key, probe, id, ...) with a block (i, j), i of what probes and j of what is met: a key of over ``most`` rows of a kind is cut there, and the other kind repeated."""
    n = posts.groupBy("key").agg(F.count_if("probe").alias("i"), F.count_if(~F.col("probe")).alias("j"))
    cuts = [F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int").alias(f"blocks_{c}") for c in "ij"]
    hot = stored(n.where((F.col("i") > 0) & (F.col("j") > 0) & (F.greatest("i", "j") > most)).select(F.col("key").alias("hot"), *cuts))
    one = F.lit(1)
    d = posts.join(hot, posts["key"] == hot["hot"], "left").withColumns({c: F.coalesce(c, one) for c in ("blocks_i", "blocks_j")})
    d = d.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("probe"), F.col("blocks_i")).otherwise(F.col("blocks_j"))).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("blocks_j")).otherwise(F.col("blocks_i")) - 1)))
    ends = [F.when(F.col("probe") == own, F.col("own")).otherwise(F.col("other")).alias(name) for own, name in ((True, "i"), (False, "j"))]
    return d.select(*posts.columns, *ends, F.col("hot").isNotNull().alias("cut"))


def posts_of(batches: Iterator[pa.RecordBatch], threshold: float, frequent: int, roles: list[tuple[bool, bool]]) -> Iterator[pa.RecordBatch]:
    """(k, wide, right, probe, id, size) of titles (id, size, words), those of ``POSTED`` titles at a time."""
    for batch in (whole.slice(at, POSTED) for whole in batches for at in range(0, whole.num_rows, POSTED)):
        rows = []
        for ident, size, each in zip(*(batch.column(c).to_pylist() for c in ("id", "size", "words"))):
            counted = [(w["n"], w["word"]) for w in each]
            for right, probe in roles:
                narrow, wide = probes(counted, threshold, frequent) if probe else postings(counted, frequent)
                rows += [(k, False, right, probe, ident, size) for k in set(narrow)] + [(k, True, right, probe, ident, size) for k in set(wide)]
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["k", "wide", "right", "probe", "id", "size"])


def _posts(words: DataFrame, threshold: float, frequent: int, roles: list[tuple[bool, bool]]) -> DataFrame:
    """(key, right, probe, id, size) of one side's titles: ``right`` tells whether the title that probes is of the right side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return posts_of(batches, threshold, frequent, roles)

    made = words.mapInArrow(run, "k bigint, wide boolean, right boolean, probe boolean, id bigint, size int")
    return made.select(F.xxhash64("k", "wide", "right").alias("key"), "right", "probe", "id", "size")


def alike_in_words(sides: list[DataFrame], threshold: float, frequent: int, key_rows: int) -> DataFrame:
    """(a, b): ids of a left and a right title of which one may have all words but the share in the other."""
    roles = [[(False, True), (False, False)]] if len(sides) == 1 else [[(False, True), (True, False)], [(True, True), (False, False)]]
    each = [_posts(w, threshold, frequent, r) for w, r in zip(counted_words(sides), roles)]
    posts = stored(each[0] if len(each) == 1 else each[0].union(each[1]))
    cut = blocked(posts, key_rows)
    x = cut.where("probe").select("key", "i", "j", "right", F.col("id").alias("x"), F.col("size").alias("size_x"))
    y = cut.where("NOT probe").select("key", "i", "j", F.col("id").alias("y"), F.col("size").alias("size_y"))
    met = x.join(y, ["key", "i", "j"]).where(F.col("size_y") >= threshold / (2 - threshold) * F.col("size_x") - 1e-6)
    return met.select(F.when(F.col("right"), F.col("y")).otherwise(F.col("x")).alias("a"), F.when(F.col("right"), F.col("x")).otherwise(F.col("y")).alias("b"))


class Spelling:
    """Titles of a block, in order of size."""

    def __init__(self, rows: pa.Table, spread: int):
        rows = rows.sort_by("size")
        self.id, self.size = np.asarray(rows.column("id")), np.asarray(rows.column("size")).astype(np.int64)
        column = rows.column("pairs")
        self.n = np.asarray(pc.binary_length(column)).astype(np.int64) // 4
        self.at = np.r_[0, np.cumsum(self.n)]
        self.pairs = np.frombuffer(b"".join(column.to_pylist()), "<u4") % spread
        self.letters = np.frombuffer(b"".join(rows.column("letters").to_pylist()), np.uint8).reshape(len(rows), LETTERS)
        self.spread = spread

    def matrix(self, part: slice) -> np.ndarray:
        """How many letter pairs fall to each of ``spread`` hashes."""
        rows = np.repeat(np.arange(part.stop - part.start), self.n[part])
        cells = rows * self.spread + self.pairs[self.at[part.start] : self.at[part.stop]]
        return np.bincount(cells, minlength=(part.stop - part.start) * self.spread).reshape(-1, self.spread).astype(np.float32)

    def counted(self, part: slice, most: np.ndarray) -> np.ndarray:
        """A column for each occurrence of each letter, of which a title holds ``most`` at most: products are the sums of the lesser counts."""
        rows, letter = np.nonzero(self.letters[part])
        n = self.letters[part][rows, letter].astype(np.int64)
        first = np.cumsum(most) - most
        cols = np.repeat(first[letter], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros((part.stop - part.start, int(most.sum())), np.float32)
        out[np.repeat(rows, n), cols] = 1
        return out

    def needs(self, part: slice, loss: float) -> np.ndarray:
        """The title's half of the common letters that a pair needs, rounded down to sixteenths, which sums of single precision hold exactly."""
        own = self.letters[part].sum(1, dtype=np.int64) - loss * self.size[part]
        return np.floor((own / 2 - 1e-3) * 16).astype(np.float32)[:, None] / 16


def near_spelling(x: Spelling, y: Spelling, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the pairs that may be alike in spelling.

    Of N and N' letters all but D are common, which a product of matrices tells for all pairs, and of n and n' letter pairs all but 3 D; the
    lesser counts by hash sum up to no less than what is common. Few pairs pass the letters, so that their letter pairs are looked at one by one.
    """
    loss = 1 - threshold
    top = np.maximum(x.letters.max(0), y.letters.max(0)).astype(np.int64)
    tile = max(16, min(TILE, TILE_CELLS // max(x.spread, int(top.sum()))))
    step = max(1, CANDIDATE_CELLS // x.spread)

    @lru_cache(max(1, HELD_CELLS // (tile * x.spread)))
    def columns(b: int) -> tuple[np.ndarray, np.ndarray]:
        cols = slice(b, min(len(y.id), b + tile))
        need = y.needs(cols, loss)
        return np.hstack([y.counted(cols, top), np.ones_like(need), -need]).T, y.matrix(cols)

    for a in range(0, len(x.id), tile):
        rows = slice(a, min(len(x.id), a + tile))
        need, pairs_x = x.needs(rows, loss), x.matrix(rows)
        left = np.hstack([x.counted(rows, top), -need, np.ones_like(need)])  # so that the product is what is common beyond the need
        low, high = np.searchsorted(y.size, [x.size[a] * threshold / (2 - threshold) - 1e-6, x.size[rows.stop - 1] * (2 - threshold) / threshold + 1e-6])
        for b in range(low - low % tile, high, tile):
            right, pairs_y = columns(b)
            passed = np.flatnonzero(left @ right >= 0)
            for start in range(0, len(passed), step):
                i, j = np.divmod(passed[start : start + step], right.shape[1])
                common = np.minimum(pairs_x[i], pairs_y[j]).sum(1)
                i, j = i + a, j + b
                size = x.size[i] + y.size[j]
                kept = (common >= (x.n[i] + y.n[j] - 3 * loss * size) / 2 - 1e-3) & (np.abs(x.size[i] - y.size[j]) <= loss * size + 1e-6)
                yield i[kept], j[kept]


def alike_in_spelling(sides: list[DataFrame], threshold: float, block: int) -> DataFrame:
    """(a, b): ids of a left and a right title that may be alike in spelling."""
    left, right = sides[0], sides[-1]
    same = len(sides) == 1
    counts = [d.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect() for d in sides]  # as many classes as the logarithm of the longest title
    blocks = [{r["class"]: -(-r["n"] // block) for r in c} for c in counts]
    step = math.log((2 - threshold) / threshold) * (1 + 1e-6)

    def number(of: dict[int, int], column: Column) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[column], F.lit(1)) if of else F.lit(1)

    # a pair of classes (class of the left title, class of the right one): both the same, or neighbours; of one side with itself only in one order
    own = F.col("class")
    near = F.array(own, own + 1) if same else F.array(own - 1, own, own + 1)
    x = left.select("id", "size", "pairs", "letters", F.col("class").alias("c"), F.explode(near).alias("d"), F.lit(True).alias("mine"))
    y = right.select("id", "size", "pairs", "letters", F.explode(F.array(own - 1, own) if same else near).alias("c"), F.col("class").alias("d"), F.lit(False).alias("mine"))
    cut = []
    for d, (own_class, other_class), (mine, other) in ((x, ("c", "d"), (blocks[0], blocks[-1])), (y, ("d", "c"), (blocks[-1], blocks[0]))):
        place = F.pmod(F.xxhash64("id"), number(mine, F.col(own_class))).cast("int")
        each = F.explode(F.sequence(F.lit(0), number(other, F.col(other_class)).cast("int") - 1))
        i, j = (place, each) if d is x else (each, place)
        cut.append(d.withColumn("i", i).withColumn("j", j))
    rows = cut[0].union(cut[1])
    if same:  # blocks of one class meet in one order
        rows = rows.where("c <> d OR i <= j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        longest = math.exp((max(rows.column("c")[0].as_py(), rows.column("d")[0].as_py()) + 1) * step)
        spread = max(LEAST_PAIRS, 1 << math.ceil(math.log2(SPREAD * longest)))
        x, y = (Spelling(rows.filter(pc.equal(rows.column("mine"), mine)), spread) for mine in (True, False))
        for i, j in near_spelling(x, y, threshold) if len(x.id) and len(y.id) else ():  # handed on as they are found, as there may be as many as titles squared
            yield pa.RecordBatch.from_arrays([pa.array(x.id[i]), pa.array(y.id[j])], names=["a", "b"])

    return rows.groupBy("c", "d", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def similar_titles(
    left: DataFrame, right: DataFrame, threshold: float = 0.9, frequent: int = FREQUENT, key_rows: int = KEY_ROWS, block: int = BLOCK_TITLES
) -> DataFrame:
    """Pairs (t, u) of different normalised titles whose token-set similarity reaches the threshold; ``left`` and ``right`` hold distinct (t).

    No pair is lost. ``left`` may be ``right``, which halves the work. Titles without words are like none.
    """
    same = left is right
    sides = [features(left, threshold)] if same else [features(left, threshold), features(right, threshold)]
    if not all(d.limit(1).count() for d in sides):  # titles without words are all there are
        return left.sparkSession.createDataFrame([], "t string, u string")
    words, spelling = alike_in_words(sides, threshold, frequent, key_rows), alike_in_spelling(sides, threshold, block)
    pairs = words.withColumn("spelled", F.lit(False)).union(spelling.withColumn("spelled", F.lit(True)))
    if same:
        pairs = pairs.where("a <> b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "spelled")
    pairs = pairs.groupBy("a", "b").agg(F.bool_or("spelled").alias("spelled"))
    for d, end, name in ((sides[0], "a", "t"), (sides[-1], "b", "u")):
        pairs = pairs.join(d.select(F.col("id").alias(end), F.col("t").alias(name), F.col("size").alias(f"size_{name}")), end)
    split = [F.filter(F.split(c, " "), lambda w: w != "") for c in ("t", "u")]
    shared = F.length(F.array_join(F.array_intersect(*split), " "))
    enough = shared >= threshold / (2 - threshold) * F.least("size_t", "size_u") - 1e-6
    out = stored(pairs.where("t <> u").where(F.col("spelled") | enough).where(title_score("t", "u") >= threshold).select("t", "u"))
    discard(*sides)
    return out.union(out.select(F.col("u").alias("t"), F.col("t").alias("u"))) if same else out
