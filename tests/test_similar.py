"""Similar titles: the indexes lose no pair, whatever the frequencies, and look at few."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litscout.functions.fuzzy import common_subsequence, token_set_ratio
from litscout.operators import similar

WORD = st.text("abcdeé", min_size=1, max_size=7)
TITLE = st.lists(WORD, min_size=1, max_size=8).map(" ".join)


def size_of(words):
    return sum(map(len, words)) + len(words) - 1


def edited(draw, title):
    """A title some edits away."""
    out = list(title)
    for _ in range(draw(st.integers(0, 4))):
        at = draw(st.integers(0, len(out)))
        if draw(st.booleans()) and at < len(out):
            del out[at]
        else:
            out.insert(at, draw(st.sampled_from("abc é")))
    return " ".join("".join(out).split()) or "a"


@st.composite
def pair(draw):
    title = draw(TITLE)
    return title, edited(draw, title) if draw(st.booleans()) else draw(TITLE)


def differences(x, y):
    return " ".join(sorted(set(x) - set(y))), " ".join(sorted(set(y) - set(x)))


def block_of(titles, spread=256):
    rows = [(i, size_of(w), similar.letter_pairs(w), similar.letters(w)) for i, w in enumerate(titles)]
    return similar.Spelling(pa.table(dict(zip(("id", "size", "pairs", "letters"), map(list, zip(*rows))))), spread)


@settings(max_examples=400, deadline=None)
@given(pair(), st.sampled_from([0.7, 0.9, 0.95]), st.sampled_from([16, 256]))
def test_spelling_filter_passes_every_pair(titles, threshold, spread):
    x, y = map(similar.distinct_words, titles)
    only_x, only_y = differences(x, y)
    edits = len(only_x) + len(only_y) - 2 * common_subsequence(only_x, only_y)
    if only_x and only_y and edits <= (1 - threshold) * (size_of(x) + size_of(y)) + 1e-9:
        assert sum(len(i) for i, _ in similar.near_spelling(block_of([x], spread), block_of([y], spread), threshold)) == 1


@settings(max_examples=400, deadline=None)
@given(pair(), st.dictionaries(WORD, st.integers(1, 9)), st.integers(0, 9), st.integers(0, 3), st.sampled_from([0.8, 0.9]))
def test_word_index_meets_every_pair(titles, counts, frequent, many, threshold):
    x, y = map(similar.distinct_words, titles)
    shared = " ".join(sorted(set(x) & set(y)))
    if shared and len(shared) >= threshold / (2 - threshold) * size_of(x) - 1e-9:
        counted = [sorted((counts.get(w, 5), w) for w in each) for each in (x, y)]
        narrow, wide = similar.probes(counted[0], threshold, frequent)
        held, apart = similar.postings(counted[1], frequent, many)
        assert set(narrow) & set(held) or set(wide) & set(apart)


def brute(titles, others=None):
    return {(a, b) for a in titles for b in (others or titles) if a != b and token_set_ratio(a, b) >= 90}


def found(spark, titles, others=None, **how):
    left = spark.createDataFrame([(t,) for t in titles], "t string")
    right = left if others is None else spark.createDataFrame([(t,) for t in others], "t string")
    return {(r.t, r.u) for r in similar.similar_titles(left, right, **how).collect()}


def titles_of(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    titles = {" ".join(rng.choice(vocabulary[:8] if rng.random() < 0.4 else vocabulary) for _ in range(rng.randint(1, 7))) for _ in range(n)}
    more = set()
    for t in sorted(titles):
        at = rng.randrange(len(t))
        more |= {" ".join((t[:at] + rng.choice("abq ") + t[at + rng.randint(0, 1) :]).split()), t + " " + rng.choice(vocabulary), " ".join(t.split()[1:])}
    return sorted((titles | more) - {""})


@pytest.mark.parametrize("how", [{}, {"frequent": 3, "key_rows": 7, "block": 20}, {"frequent": 0, "key_rows": 40, "block": 150}])
def test_similar_titles_loses_none(spark, how):
    titles = titles_of(11, 90)
    assert found(spark, titles, **how) == brute(titles)


def test_similar_titles_of_two_sides(spark):
    a, b = titles_of(1, 40), titles_of(1, 45)[::2] + ["zz " * 50, "x"]
    b = sorted({" ".join(t.split()) for t in b})
    assert found(spark, a, b, frequent=5, key_rows=20, block=30) == brute(a, b)
    assert found(spark, a, []) == set() == found(spark, [], a)


def test_very_long_titles(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    titles = [" ".join(rng.sample(words, 150)) for _ in range(6)]
    titles += [" ".join(t.split()[:-3]) for t in titles] + [titles[0].replace("w1", "v1"), "w5 w7", "w5"]
    assert found(spark, titles, frequent=2) == brute(titles)


def test_titles_of_no_words(spark):
    assert found(spark, ["", " ", "a"]) == set()


def test_a_word_in_half_of_the_titles_is_cut(spark):
    """Rows of the largest group are bounded by the block, however frequent the key, and every pair still meets once."""
    rows = [(1 if i % 2 else i, probe, i) for i in range(4_000) for probe in (True, False)]
    d = similar.blocked(spark.createDataFrame(rows, "key bigint, probe boolean, id bigint"), 100)
    assert d.groupBy("key", "i", "j").count().agg({"count": "max"}).first()[0] < 400
    x, y = (d.where(f"probe = {p}").select("key", "i", "j", "id") for p in ("true", "false"))
    assert x.join(y, ["key", "i", "j"]).count() == 2_000 * 2_000 + 2_000


def test_few_pairs_are_compared():
    """Of random titles of 50 letters hardly any pair passes the filter."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 10))) for _ in range(3_000)]
    block = block_of([similar.distinct_words(" ".join(rng.sample(vocabulary, 8))) for _ in range(3_000)])
    passed = sum(len(i) for i, _ in similar.near_spelling(block, block, 0.9)) - 3_000
    assert passed < 0.0001 * 3_000**2


def test_titles_alike_throughout_are_handed_on_in_parts():
    """Where every pair is alike, no more pairs are held than are looked at together."""
    block = block_of([similar.distinct_words(f"the same words of a title again and again {i:04d}") for i in range(3_000)])
    most = similar.CANDIDATE_CELLS // block.spread
    parts = [len(i) for i, _ in similar.near_spelling(block, block, 0.9)]
    assert sum(parts) == 3_000**2 and max(parts) <= most


def test_the_letters_leave_few_pairs_to_look_at(monkeypatch):
    """Titles of one vocabulary share many letter pairs; what the first product passes is a small part of all pairs."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 5))) for _ in range(300)]
    block = block_of([similar.distinct_words(" ".join(rng.sample(vocabulary, 12))) for _ in range(2_000)])
    looked = []
    minimum = similar.np.minimum
    monkeypatch.setattr(similar.np, "minimum", lambda a, b: looked.append(len(a)) or minimum(a, b))
    list(similar.near_spelling(block, block, 0.9))
    assert 2_000 <= sum(looked) < 0.01 * 2_000**2


def test_posts_come_in_small_parts():
    """A title of frequent words has hundreds of posts; those of a few titles are held at once, however large the batch."""
    rows = [{"id": i, "size": 60, "words": [{"n": 10_000, "word": f"w{k}"} for k in range(12)]} for i in range(2_000)]
    sizes = [b.num_rows for b in similar.posts_of(iter([pa.RecordBatch.from_pylist(rows)]), 0.9, 200, [(False, True), (False, False)])]
    assert sum(sizes) > 100_000 and max(sizes) < 50_000
