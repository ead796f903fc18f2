"""Token-set scores of many pairs against one by one."""

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from litscout.functions.fuzzy import common_subsequences, token_set_ratio, token_set_ratios

TITLE = st.lists(st.text("abcé😀", min_size=1, max_size=5), max_size=7).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TITLE, TITLE), min_size=1, max_size=30), st.integers(1, 8))
def test_many_pairs_score_as_one(pairs, chunk):
    left, right = map(list, zip(*pairs))
    assert np.allclose(token_set_ratios(left, right, chunk), [token_set_ratio(a, b) for a, b in pairs], atol=1e-9)


def test_long_titles_and_words_beyond_a_machine_word():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    pairs = [(" ".join(rng.sample(words, n)), " ".join(rng.sample(words, m))) for n in (3, 15, 40, 60, 150) for m in (2, 30, 55, 160)]
    left, right = map(list, zip(*pairs))
    assert np.allclose(token_set_ratios(left, right), [token_set_ratio(a, b) for a, b in pairs], atol=1e-9)
    assert token_set_ratios([], []).tolist() == []


def test_subsequences_of_rows():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (40, 150)), rng.integers(0, 4, (40, 130))
    na, nb = rng.integers(0, 151, 40), rng.integers(0, 131, 40)
    got = common_subsequences(a, na, b, nb, 4)
    for k in range(40):
        row = [0] * (nb[k] + 1)
        for x in a[k, : na[k]]:
            before = 0
            for j in range(nb[k]):
                before, row[j + 1] = row[j + 1], before + 1 if x == b[k, j] else max(row[j + 1], row[j])
        assert got[k] == row[-1]


def test_many_pairs_are_faster():
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2_000)]
    titles = [" ".join(rng.sample(words, 8)) for _ in range(1_000)]
    left, right = titles * 8, [rng.choice(titles) for _ in range(8_000)]
    token_set_ratios(left, right)
    began = time.process_time()
    many = token_set_ratios(left, right)
    between = time.process_time()
    one = [token_set_ratio(a, b) for a, b in zip(left, right)]
    end = time.process_time()
    assert np.allclose(many, one)
    print(round((end - between) / (between - began), 1), "times as fast,", round(1e6 * (between - began) / len(left), 2), "microseconds a pair")
    assert end - between > 1.5 * (between - began)
