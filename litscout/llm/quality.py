"""Quality classifier (operator 4): a weak-label model, and hashed linear scorers trained on its labels.

Two judgements are made of a document: low quality (menus, symbol noise, repetition) and toxicity.

1. Labellers are overlapping heuristics that vote bad, fine or abstain. Those for quality look at the
   text alone. Those for toxicity are the terms and the word beginnings that a bounded sample of labelled
   rows shows to be toxic, a short fixed list of insults, and the given labels where there are any.
2. Votes are counted over *all* documents by vote pattern; there are at most 3**labellers patterns.
   Expectation-maximisation on that table estimates each labeller's accuracy and the share of bad
   documents; the posterior of a pattern follows.
3. Posterior labels of a bounded, documented sample (``SAMPLE`` labelled documents, those of smallest hash;
   if fewer than ``FILL`` are labelled, unlabelled ones fill it up to that) train a
   linear scorer over hashed features of the text: logistic regression, weights kept for features that differ
   between the classes. For quality these are the shapes of the words with their shares, how often the most frequent
   words come again, and binned measures; for toxicity words and their beginnings. The scorer alone judges,
   over whole texts, all documents.

Null text is empty text; a document without words is rejected. Null ids are scored like others; ids
repeated in the labels count as bad if any row says so; without labels the toxicity labellers are the
fixed list alone. Repeated rows and ties get equal scores; an empty table gives no rows. Very long texts
are scored whole. Columns of other names do not matter, whatever they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .common import table, text_of

#: Rows that scorers and term lists are fitted on, at most.
SAMPLE = 12_000
#: Rows that the sample is filled up to with unlabelled documents if fewer are labelled.
FILL = 2_000
#: Common insults.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "trash", "pathetic", "worthless", "disgusting", "scum", "loser", "losers", "clown", "imbecile")
BAD, FINE, ABSTAIN = 1, 0, -1
WORD = re.compile(r"\w+")
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
SPACE, MARK, LETTER = 0, 1, 2
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Of each byte of UTF-8; bytes beyond ASCII count as letters.
KINDS = np.array([SPACE if chr(b).isspace() and b < 128 else LETTER if b > 127 or chr(b).isalnum() or b == 95 else MARK for b in range(256)], np.uint8)


def measures(text: str) -> tuple[float, ...]:
    """The numbers that the quality labellers vote on."""
    return measured(text)[0]


def measured(text: str) -> tuple[tuple[float, ...], Counter]:
    """Counts of the words, and: ASCII marks per character, separators per word, distinct words per word, runs of two or three marks behind letters per word, bytes per word, most frequent word's share, neighbours repeated, words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 8, Counter()
    top = Counter(words)
    pipes = top.get("|", 0) + top.get("•", 0) + top.get("»", 0)
    again = sum(map(eq, words, islice(words, 1, None)))
    kind = KINDS[np.frombuffer(text.encode(), np.uint8)]
    mark = kind == MARK
    endings = np.count_nonzero(mark[1:-2] & mark[2:-1] & (kind[:-3] == LETTER) & (kind[3:] != LETTER)) if len(kind) > 3 else 0
    return (
        np.count_nonzero(mark) / max(1, len(text)),
        pipes / n,
        len(top) / n,
        endings / n,
        np.count_nonzero(kind != SPACE) / n,
        max(top.values()) / n,
        again / n,
        float(n),
    ), top


def quality_votes(m: tuple[float, ...]) -> list[int]:
    """One vote of each quality labeller."""
    marks, pipes, distinct, endings, length, top, again, n = m
    if not n:
        return [BAD] * 7
    vote = lambda bad, fine: BAD if bad else FINE if fine else ABSTAIN
    return [
        vote(marks > 0.1 and n > 12, marks < 0.06 or n <= 12),
        vote(pipes > 0.08, pipes < 0.02),
        vote(distinct < 0.35 and n > 40, distinct > 0.45 or n <= 40),
        vote(endings > 0.2 and n > 12, endings < 0.06),
        vote(length > 14 and n > 12 or (length < 2.5 and n > 12), 3 < length < 10 or n <= 12),
        vote(top > 0.2 and n > 30, top < 0.15 or n <= 30),
        vote(again > 0.2 and n > 12, again < 0.06 or n <= 12),
    ]


def shape(word: str) -> str:
    """A word with runs of letters as one, digits likewise, eight characters at most."""
    return DIGITS.sub("0", LETTERS.sub("a", word))[:8]


def shape_features(words: Counter, n: int) -> list[str]:
    """Names of the words' shapes, alone and with the share of words that have them, and of the most frequent words' shares."""
    shares: Counter = Counter()
    for word, k in words.items():
        shares[shape(word)] += k
    out = [f"s{s}" for s in shares] + [f"s{s}:{(32 * k // n).bit_length()}" for s, k in shares.items()]
    return out + repeated([k for _, k in words.most_common(3)], n)


def repeated(most: list[int], n: int) -> list[str]:
    return [f"r{r}:{(32 * k // n).bit_length()}:{min(12, n.bit_length()) // 3}" for r, k in enumerate(most)]


def quality_features(m: tuple[float, ...], words: Counter) -> list[str]:
    """Names of the shapes' features and of binned measures, alone and in pairs with the text's length."""
    n = int(m[7])
    if n <= 12:  # too short for rates to mean much: only pipes and mark endings count
        return ["short", f"short:{m[1] > 0.2}", f"short:{m[3] > 0.3}"] + ["none"] * (not n)
    return binned(m) + shape_features(words, n)


def binned(m: tuple[float, ...]) -> list[str]:
    size = min(12, int(math.log2(m[7] + 1)))
    steps = (0.02, 0.02, 0.05, 0.04, 1.0, 0.04, 0.04)
    bins = [min(20, int(v / s)) for v, s in zip(m, steps)]
    return [f"{k}:{b}" for k, b in enumerate(bins)] + [f"{k}:{b}/{size // 3}" for k, b in enumerate(bins)]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)])


class Read:
    """What ``measured`` finds in each text, for a whole Arrow batch at once.

    Words are numbered; ``doc``, ``word`` and ``times`` list each text's different words with their counts, sorted by text.
    """

    def __init__(self, texts: pa.Array):
        self.texts = texts
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        self.words: pa.StringArray = coded.dictionary
        word = coded.indices.to_numpy().astype(np.int64)
        size = len(texts)
        doc = np.repeat(np.arange(size), lists.value_lengths().to_numpy())
        full = word != self.place("")  # of white space at the ends
        word, doc = word[full], doc[full]
        self.n = np.bincount(doc, minlength=size)
        again = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=size)
        key, self.times = distinct(doc * max(1, len(self.words)) + word)
        self.doc, self.word = np.divmod(key, max(1, len(self.words)))
        self.first = np.searchsorted(self.doc, np.arange(size + 1))
        bar = np.isin(self.word, [self.place(w) for w in ("|", "•", "»")])
        pipes = np.bincount(self.doc[bar], self.times[bar], size)
        marks, letters, endings = self._bytes()
        chars = pc.utf8_length(texts).to_numpy()
        top = np.zeros(size)
        if len(key):
            top[self.n > 0] = np.maximum.reduceat(self.times, self.first[:-1][self.n > 0])
        n = np.maximum(self.n, 1)
        columns = (marks / np.maximum(1, chars), pipes / n, np.diff(self.first) / n, endings / n, letters / n, top / n, again / n, self.n.astype(float))
        self.measures = list(zip(*(np.where(self.n > 0, c, 0.0).tolist() for c in columns)))

    def place(self, word: str) -> int:
        return pc.index(self.words, word).as_py()

    def shapes(self) -> tuple[np.ndarray, list[str]]:
        """Each different word's shape, as its place in the list of shapes."""
        found = pc.replace_substring_regex(self.words, r"[\p{L}\p{Nl}\p{No}]+", "a")
        found = pc.utf8_slice_codeunits(pc.replace_substring_regex(found, r"\p{Nd}+", "0"), 0, 8).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()

    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: marks, bytes that are no separators, runs of two or three marks behind letters."""
        size = len(self.texts)
        _, offsets, data = self.texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[self.texts.offset : self.texts.offset + size + 1].astype(np.int64)
        kind = KINDS[np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]]
        ends -= ends[0]
        found = [kind == MARK, kind != SPACE]
        ending = np.zeros(len(kind), bool)
        if len(kind) > 3:
            ending[:-3] = found[0][1:-2] & found[0][2:-1] & (kind[:-3] == LETTER) & (kind[3:] != LETTER)
            last = ends[1:, None] - np.arange(1, 4)  # would reach into the next text
            ending[last[last >= 0]] = False
        total = [np.r_[0, np.cumsum(f)] for f in (*found, ending)]
        return tuple(t[ends[1:]] - t[ends[:-1]] for t in total)


def hashed(name: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def term_features(word: str) -> tuple[int, ...]:
    """A word's hashed features: itself and, for longer words, its first four and five characters."""
    return tuple(f for f in term_hashes(pa.array([word]))[0].tolist() if f >= 0)


def hash_strings(strings: pa.StringArray, kind: int) -> np.ndarray:
    """Hashes of 62 bits: the bytes as a polynomial, mixed."""
    if not len(strings):
        return np.empty(0, np.int64)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    ends -= ends[0]
    size = np.diff(ends)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max(initial=0)), MULTIPLIER)])
    out = np.zeros(len(size), np.uint64)
    some = size > 0
    if some.any():
        at = np.arange(len(data)) - np.repeat(ends[:-1], size)
        out[some] = np.add.reduceat(data * power[at], ends[:-1][some])
    out += np.uint64(kind)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return (out >> np.uint64(2)).astype(np.int64)


def term_hashes(words: pa.StringArray) -> np.ndarray:
    """Of each word: the hash of itself, of its first five characters if it has more, of its first four if it has five or more; -1 for none."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    five = np.where(size > 5, hash_strings(pc.utf8_slice_codeunits(words, 0, 5), 5), -1)
    four = np.where(size > 4, hash_strings(pc.utf8_slice_codeunits(words, 0, 4), 4), -1)
    return np.stack([hash_strings(words, 1), five, four], 1)


class Terms:
    """The words in lower case, without marks, of each text of a batch that was read: ``doc`` and ``word``, sorted by text, and the words' hashed features."""

    def __init__(self, read: Read):
        # words do not reach over white space, so the different words are split, not the texts
        lists = pc.split_pattern_regex(pc.utf8_lower(read.words), r"[^\p{L}\p{N}_]+")
        coded = lists.flatten().dictionary_encode()
        parts = coded.indices.to_numpy().astype(np.int64)
        many = lists.value_lengths().to_numpy().astype(np.int64)
        of = many[read.word]
        at = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of) + np.repeat((np.cumsum(many) - many)[read.word], of)
        self.size, self.doc, self.word = len(read.n), np.repeat(read.doc, of), parts[at]
        full = self.word != pc.index(coded.dictionary, "").as_py()
        self.doc, self.word = self.doc[full], self.word[full]
        self.feats = term_hashes(coded.dictionary)

    def having(self, features: np.ndarray) -> np.ndarray:
        """Which features of which words are among the sorted ``features``."""
        if not len(features):
            return np.zeros(self.feats.shape, bool)
        at = np.minimum(np.searchsorted(features, self.feats), len(features) - 1)
        return features[at] == self.feats


def fit_votes(counts: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation for binary classes: (share of bad, table[labeller, class, vote + 1])."""
    pats = np.array(sorted(counts), np.int64)
    if not len(pats):
        return 0.5, np.full((1, 2, 3), 1 / 3)
    n = np.array([counts[tuple(p)] for p in pats.tolist()], float)
    bad, fine = (pats == BAD).sum(1), (pats == FINE).sum(1)
    post = (2 * bad + 0.1) / (2 * bad + fine + 1)  # a start from the votes; a bad vote is the rarer
    prior, tab = 0.1, np.zeros((pats.shape[1], 2, 3))
    for _ in range(rounds):
        was = post
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 1 - 1e-4))
        for k in range(pats.shape[1]):
            for v in range(3):
                tab[k, 1, v] = (n * post * (pats[:, k] == v - 1)).sum()
                tab[k, 0, v] = (n * (1 - post) * (pats[:, k] == v - 1)).sum()
        tab = (tab + 0.5) / (tab + 0.5).sum(2, keepdims=True)
        post = posterior(pats, prior, tab)
        if np.abs(post - was).max() < 1e-7:
            break
    return prior, tab


def posterior(pats: np.ndarray, prior: float, tab: np.ndarray) -> np.ndarray:
    k = np.arange(pats.shape[1])
    odds = math.log(prior / (1 - prior)) + (np.log(tab[k, 1, pats + 1]) - np.log(tab[k, 0, pats + 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, least: int = 3, z: float = 3.0, steps: int = 300) -> tuple[float, dict[int, float]]:
    """(bias, weights by hashed feature) of a logistic regression on soft targets.

    Weights are kept for features met in ``least`` rows whose rate differs between the classes by ``z``
    standard errors; the rest are 0, so that many neutral words never add up.
    """
    if not rows:
        return -4.0, {}
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    names, ids = np.unique(np.concatenate(rows) if sizes.sum() else np.empty(0, np.int64), return_inverse=True)
    total, bad = np.bincount(ids, minlength=len(names)).astype(float), np.bincount(ids, target[owner], len(names))
    share = (target.sum() + 0.5) / (len(target) + 1)
    gap = (bad - total * share) / np.sqrt(total * share * (1 - share) + 1e-9)
    use = (total >= least) & (np.abs(gap) > z)
    new = np.cumsum(use) - 1
    sel = use[ids]
    owner, ids = owner[sel], new[ids[sel]]
    w, g2, b, b2 = np.zeros(int(use.sum())), np.full(int(use.sum()), 1e-6), math.log(share / (1 - share)), 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(owner, w[ids], len(rows)), -30, 30)))
        e = p - target
        g = np.bincount(ids, e[owner], len(w)) + 0.1 * w
        g2 += g * g
        b2 += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * e.sum() / math.sqrt(b2)
    return float(b), dict(zip(names[use].tolist(), w.tolist()))


def toxic_votes(feats: set[int], terms: set[int], starts: set[int], insults: set[int], label: int | None) -> tuple[int, ...]:
    """Votes of the mined words, the mined beginnings, the fixed list and the given label."""
    return (
        BAD if feats & terms else FINE,
        BAD if feats & starts else FINE,
        BAD if feats & insults else ABSTAIN,
        ABSTAIN if label is None else BAD if label else FINE,
    )


def _vote_counter(terms: set[int], starts: set[int], insults: set[int]):
    """Counts of vote patterns in this task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        words = _Words(terms, starts, insults)
        for batch in batches:
            if not batch.num_rows:
                continue
            read = Read(batch.column("text"))
            seen.update(("q", tuple(quality_votes(m))) for m in read.measures)
            seen.update(("t", v) for v in words.votes(Terms(read), batch.column("toxic").to_pylist()))
        kind = [k for k, _ in seen]
        pats = [",".join(map(str, p)) for _, p in seen]
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(pats, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["kind", "pattern", "n"])

    return run


class _Words:
    """Which labellers a text's words speak to."""

    def __init__(self, terms: set[int], starts: set[int], insults: set[int]):
        self.sets = [np.array(sorted(x), np.int64) for x in (terms, starts, insults)]

    def votes(self, read: Terms, labels: list[int | None]) -> list[tuple[int, ...]]:
        hits = [np.bincount(read.doc[read.having(x).any(1)[read.word]], minlength=read.size) > 0 for x in self.sets]
        one, two, three = (h.tolist() for h in hits)
        return [(BAD if a else FINE, BAD if b else FINE, BAD if c else ABSTAIN, ABSTAIN if label is None else BAD if label else FINE) for a, b, c, label in zip(one, two, three, labels)]


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        quality, votes = [], []
        for text in batch.column("text").to_pylist():
            m, words = measured(text)
            votes.append(quality_votes(m))
            quality.append(sorted({hashed(x) for x in quality_features(m, words)}))
        read = Terms(Read(batch.column("text")))
        feats = read.feats[read.word]
        ends = np.searchsorted(read.doc, np.arange(read.size + 1))
        terms = [np.unique(f[f >= 0]) for f in (feats[a:b].ravel() for a, b in zip(ends, ends[1:]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("h"), batch.column("toxic"), pa.array(votes, pa.list_(pa.int32())), pa.array(quality, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))],
            names=["h", "toxic", "votes", "quality", "terms"],
        )


class Model:
    """Both scorers, and what was found on the way: labeller tables and shares."""

    def __init__(self, quality: tuple, toxic: tuple, tables: dict):
        self.quality, self.toxic, self.tables = quality, toxic, tables
        self.key = hashlib.sha256(repr([(b, sorted(w.items())) for b, w in (quality, toxic)]).encode()).hexdigest()

    def score(self, text: str) -> tuple[float, float]:
        """(probability of low quality, probability of toxicity) of one text."""
        (q_bias, q_weights), (t_bias, t_weights) = self.quality, self.toxic
        m, words = measured(text)
        q = q_bias + math.fsum(q_weights.get(hashed(x), 0.0) for x in set(quality_features(m, words)))
        feats = {f for w in words_of(text) for f in term_features(w) if f in t_weights}
        return (logistic(q) if m[7] else 1.0), logistic(t_bias + math.fsum(t_weights[f] for f in feats))


def logistic(v: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


class BatchScorer:
    """``Model.score`` for Arrow batches of texts; keeps the weights of features by name between them."""

    def __init__(self, model: Model):
        self.model = model
        self.telling = np.array(sorted(model.toxic[1]), np.int64)
        self.weights: dict[str, float] = {}

    def weight(self, name: str) -> float:
        w = self.weights.get(name)
        if w is None:
            if len(self.weights) > 200_000:
                self.weights.clear()
            w = self.weights[name] = self.model.quality[1].get(hashed(name), 0.0)
        return w

    def __call__(self, texts: pa.Array) -> tuple[list[float], list[float]]:
        read = Read(texts)
        return self.quality(read), self.toxic(Terms(read))

    def quality(self, read: Read) -> list[float]:
        size = len(read.n)
        shape_of, names = read.shapes()
        key, place = np.unique(read.doc * max(1, len(names)) + shape_of[read.word], return_inverse=True)
        doc, held = np.divmod(key, max(1, len(names)))
        share = 32 * np.bincount(place, read.times, len(key)).astype(np.int64) // read.n[doc]
        share = np.frexp(share.astype(float))[1]  # the bit length
        alone = np.array([self.weight(f"s{s}") for s in names])
        pairs, place = np.unique(held * 64 + share, return_inverse=True)
        shared = np.array([self.weight(f"s{names[p // 64]}:{p % 64}") for p in pairs.tolist()])
        weights = (alone[held] + 0.0, shared[place])
        first = np.searchsorted(doc, np.arange(size + 1)).tolist()
        bias, out = self.model.quality[0], []
        for i, m in enumerate(read.measures):
            n = int(m[7])
            if not n:
                out.append(1.0)
                continue
            if n <= 12:
                found = [self.weight(x) for x in set(quality_features(m, Counter()))]
            else:
                a, b = first[i : i + 2]
                times = read.times[read.first[i] : read.first[i + 1]]
                most = np.sort(times)[::-1][:3].tolist()
                found = [self.weight(x) for x in {*binned(m), *repeated(most, n)}]
                found += weights[0][a:b].tolist() + weights[1][a:b].tolist()
            out.append(logistic(bias + math.fsum(found)))
        return out

    def toxic(self, read: Terms) -> list[float]:
        told = read.having(self.telling)
        feats: dict[int, set[int]] = {}
        hit = told.any(1)[read.word]
        for d, w in zip(read.doc[hit].tolist(), read.word[hit].tolist()):
            feats.setdefault(d, set()).update(read.feats[w][told[w]].tolist())
        bias, weights = self.model.toxic
        return [logistic(bias + math.fsum(weights[f] for f in feats.get(i, ()))) for i in range(read.size)]


def sample_of(base: DataFrame, ids: DataFrame, sample: int = SAMPLE, fill: int = FILL) -> list[tuple[int, int | None]]:
    """(id, toxic), at most ``sample``: labelled ids (id, toxic) that occur in ``base`` (id, text); to ``fill`` ids also unlabelled ones, without toxic."""
    held = ids.join(base.select("id"), "id", "left_semi")  # labels of other documents tell nothing here
    some = [(r.id, r.toxic) for r in held.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    most = min(sample, fill)
    if len(some) < most:
        more = base.select("id").where("id IS NOT NULL").distinct().join(ids, "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(most - len(some)).collect()
        some += [(r.id, None) for r in more]
    return some


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fill: int = FILL, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model for ``docs`` (id, text) and ``labels`` (doc_id, toxic).

    The sample is that of the labelled ids that occur in ``docs`` of smallest hash, filled up with unlabelled
    ones to ``fill`` ids (``sample`` at most) if there are fewer; it is a bounded number of ids, so it is
    broadcast. All else counts every document.
    """
    spark = docs.sparkSession
    ids = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    some = sample_of(base, ids, sample, fill)
    chosen = spark.createDataFrame(some, "id bigint, toxic int")
    # copies count once, with their most frequent label; else a hot text's words would stand for its class
    rows = base.join(F.broadcast(chosen), "id").groupBy(F.md5("text").alias("h"))
    rows = rows.agg(F.round(F.avg("toxic")).cast("int").alias("toxic"), F.first("text").alias("text"))
    rows = stored(rows.mapInArrow(_sampler, "h string, toxic int, votes array<int>, quality array<bigint>, terms array<bigint>"))
    mined = _toxic_features(rows)
    insults = set(hash_strings(pa.array(INSULTS), 1).tolist())
    # each mined feature speaks to one of two labellers, by hash, so that their votes are not the same evidence
    one, two = {f for f in mined if f & 1}, {f for f in mined if not f & 1}
    label_of = F.broadcast(chosen.where("toxic IS NOT NULL"))
    voted = base.join(label_of, "id", "left").select("toxic", "text").mapInArrow(_vote_counter(one, two, insults), "kind string, pattern string, n bigint")
    counts: dict[str, dict[tuple[int, ...], int]] = {"q": {}, "t": {}}
    for r in voted.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect():  # at most 3**7 + 3**4 patterns
        counts[r.kind][tuple(map(int, r.pattern.split(",")))] = r.n
    q_prior, q_tab = fit_votes(counts["q"])
    t_prior, t_tab = fit_votes(counts["t"])
    small = rows.mapInArrow(_patterns(one, two, insults), "h string, votes array<int>, toxic array<int>, quality array<bigint>")
    small = small.toPandas().sort_values("h")  # some 25 numbers a row; in one order, so that sums agree between runs
    if not len(small):
        return Model((-4.0, {}), (-4.0, {}), {})
    q_target = posterior(np.array(small["votes"].tolist(), np.int64), q_prior, q_tab)
    t_target = posterior(np.array(small["toxic"].tolist(), np.int64), t_prior, t_tab)
    quality = fit_scorer([np.asarray(x, np.int64) for x in small["quality"]], q_target)
    told = _telling_features(rows, small["h"].tolist(), t_target, z=4.0)
    toxic = fit_scorer([np.asarray(sorted(told.get(h, [])), np.int64) for h in small["h"]], t_target, z=4.0)
    return Model(quality, toxic, {"quality": (q_prior, q_tab), "toxic": (t_prior, t_tab)})


def _toxic_features(rows: DataFrame) -> set[int]:
    """Features that labelled rows show to be toxic: in three toxic rows or more, and a smoothed share of toxic rows over 0.7."""
    each = rows.where("toxic IS NOT NULL").select(F.explode("terms").alias("f"), "toxic")
    counts = each.groupBy("f").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    return {r.f for r in counts.where("bad >= 3 AND bad / (n + 1.0) > 0.7").select("f").collect()}  # of a bounded sample


def _telling_features(rows: DataFrame, names: list[str], target: np.ndarray, z: float) -> dict[str, list[int]]:
    """Of each sample row the features whose rate differs by ``z`` standard errors between the classes; all others would get no weight."""
    spark = rows.sparkSession
    share = float((target.sum() + 0.5) / (len(target) + 1))
    of = spark.createDataFrame(list(zip(names, target.tolist())), "h string, target double")
    each = rows.select("h", F.explode("terms").alias("f"))
    counts = each.join(F.broadcast(of), "h").groupBy("f").agg(F.round(F.sum("target"), 6).alias("bad"), F.count(F.lit(1)).alias("n"))
    gap = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9))
    telling = stored(counts.where((F.col("n") >= 3) & (gap > z)).select("f"))
    found = each.join(telling, "f").groupBy("h").agg(F.collect_list("f").alias("f")).collect()  # of a bounded sample
    return {r.h: list(r.f) for r in found}


def _patterns(one: set[int], two: set[int], insults: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = [
                toxic_votes(set(t), one, two, insults, label)
                for t, label in zip(batch.column("terms").to_pylist(), batch.column("toxic").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("votes"), pa.array([list(t) for t in toxic], pa.list_(pa.int32())), batch.column("quality")],
                names=["h", "votes", "toxic", "quality"],
            )

    return run


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = BatchScorer(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            low, toxic = score(batch.column("__text"))
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(low, pa.float64()), pa.array(toxic, pa.float64())], names=[*rest, "p_low_quality", "p_toxic"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fill: int = FILL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_low_quality, p_toxic, kept for every row."""
    model = fit(docs, labels, sample, fill, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("__text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id bigint, p_low_quality double, p_toxic double")
    return scored.withColumn("kept", (F.col("p_low_quality") < 0.5) & (F.col("p_toxic") < 0.5))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fill: int = FILL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. No join: rows are scored as they pass."""
    names = docs.columns
    model = fit(docs, labels, sample, fill, id_col, text_col)

    @F.pandas_udf("boolean")
    def good(texts):
        if not len(texts):
            return texts.astype(bool)
        low, toxic = _cached(model)(pa.array(texts, pa.string()))
        return pd.Series([max(p) < 0.5 for p in zip(low, toxic)], texts.index, dtype=bool)

    return docs.where(good(text_of(text_col))).select(*[F.col(f"`{c}`") for c in names])


_LAST: list = [None, None]


def _cached(model: Model):
    """The scorer of the model that this worker used last, known by its weights; kept between batches."""
    if _LAST[0] != model.key:
        _LAST[:] = [model.key, BatchScorer(model)]
    return _LAST[1]


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
