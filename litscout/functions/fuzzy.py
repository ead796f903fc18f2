"""Token-set similarity of titles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a title beyond which it is scored by itself.
LONG = 400


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, bit-parallel over machine-sized or longer integers."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """S23, 0 to 100: words as sets; 100 if one set holds the other and they meet; 0 if either is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    left, right = shared + gap + len(only_x), shared + gap + len(only_y)
    distance = len(only_x) + len(only_y) - 2 * common_subsequence(only_x, only_y)
    best = 100 * (1 - distance / (left + right))
    if shared:
        best = max(best, 100 * (1 - (gap + len(only_x)) / (shared + left)), 100 * (1 - (gap + len(only_y)) / (shared + right)))
    return best


class _Titles:
    """Different titles as matrices, a row for each: letters of the sorted distinct words with a blank behind each word, the word of each letter, numbers and lengths of words."""

    def __init__(self, titles: list[str]):
        words = [sorted(set(t.split())) for t in titles]
        number: dict[str, int] = {}
        for w in words:
            for x in w:
                number.setdefault(x, len(number))
        count = np.array([len(w) for w in words])
        rows = np.repeat(np.arange(len(words)), count)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        flat = [x for w in words for x in w]
        length = np.array([len(x) + 1 for x in flat], np.int64)
        shape = (len(words), max(1, count.max(initial=0)))
        self.word, self.length = np.full(shape, -1, np.int32), np.zeros(shape, np.int64)
        self.word[rows, cols], self.length[rows, cols] = [number[x] for x in flat], length
        size = self.length.sum(1)
        letter = np.frombuffer("".join(x + " " for x in flat).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, letter = np.unique(letter, return_inverse=True)
        self.kinds = len(kinds)
        at = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size)
        shape = (len(words), max(1, size.max(initial=0)))
        self.letter, self.of = np.zeros(shape, np.int32), np.full(shape, -1, np.int32)
        self.letter[at, place], self.of[at, place] = letter, np.repeat(cols, length)


def common_subsequences(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, kinds: int) -> np.ndarray:
    """The lengths of the longest common subsequences of rows of letters 0 .. kinds - 1, bit-parallel over all rows at once."""
    steps = [int(n.max(initial=0)) for n in (size_a, size_b)]
    width, slots = max(1, -(-steps[0] // 64)), kinds + 2  # two slots for what is behind an end
    base = np.arange(len(a)) * slots
    place_a, place_b = (
        np.ascontiguousarray((base[:, None] + np.where(np.arange(n) < size[:, None], x[:, :n], end)).T) for x, size, n, end in ((a, size_a, steps[0], kinds), (b, size_b, steps[1], kinds + 1))
    )
    at = np.zeros((width, len(a) * slots), np.uint64)  # where each letter stands in a row of ``a``
    for i, place in enumerate(place_a):
        at[i // 64][place] |= np.uint64(1 << i % 64)
    row = np.full((width, len(a)), ~np.uint64(0))
    carry = np.zeros(len(a), np.uint64)
    for place in place_b:
        for w in range(width):
            hit = at[w].take(place)
            both = row[w] & hit
            total = row[w] + both
            if width > 1:
                some = total
                total = some + carry if w else some
                carry = ((some < both) | (total < some)).astype(np.uint64)
            row[w] ^= both  # those of the row without a hit
            row[w] |= total
    return np.bitwise_count(~row).sum(0, dtype=np.int64)


def _pressed(letters: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The kept letters of each row, moved to its beginning."""
    out = np.zeros_like(letters)
    row, col = np.nonzero(kept)
    n = kept.sum(1)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = letters[row, col]
    return out


def token_set_ratios(left: list[str], right: list[str], chunk: int = 4096) -> np.ndarray:
    """``token_set_ratio`` of many pairs: words are compared as numbers and subsequences found for all pairs of a chunk together. Very long titles are scored one by one."""
    titles = list(dict.fromkeys([*left, *right]))
    long = {t for t in titles if len(t) > LONG}
    number = {t: i for i, t in enumerate(t for t in titles if t not in long)}
    out = np.zeros(len(left))
    alone = [i for i, (a, b) in enumerate(zip(left, right)) if a in long or b in long]
    for i in alone:
        out[i] = token_set_ratio(left[i], right[i])
    rest = np.setdiff1d(np.arange(len(left)), alone)
    if not len(rest):
        return out
    held = _Titles(list(number))
    x, y = (np.array([number[side[i]] for i in rest]) for side in (left, right))
    # pairs of titles of about one length go together, so that short ones do not wait for long ones
    order = np.argsort(held.length.sum(1)[x] + held.length.sum(1)[y], kind="stable")
    for a in range(0, len(order), chunk):
        part = order[a : a + chunk]
        out[rest[part]] = _chunk_ratios(held, x[part], y[part])
    return out


def _chunk_ratios(held: _Titles, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    most = [max(1, int((held.word[i] >= 0).sum(1).max())) for i in (x, y)]
    word_x, word_y = held.word[x][:, : most[0]], held.word[y][:, : most[1]]
    same = (word_x[:, :, None] == word_y[:, None, :]) & (word_x >= 0)[:, :, None]
    only_x, only_y = (word_x >= 0) & ~same.any(2), (word_y >= 0) & ~same.any(1)
    length_x, length_y = held.length[x][:, : most[0]], held.length[y][:, : most[1]]
    shared = np.maximum((length_x * ~only_x).sum(1) - 1, 0)
    size_x, size_y = (np.maximum((n * o).sum(1) - 1, 0) for n, o in ((length_x, only_x), (length_y, only_y)))
    gap = (shared > 0).astype(np.int64)
    left, right = shared + gap + size_x, shared + gap + size_y
    out = np.zeros(len(x))
    inside = (shared > 0) & (~only_x.any(1) | ~only_y.any(1))
    out[inside] = 100.0
    open_ = np.flatnonzero(~inside & (word_x >= 0).any(1) & (word_y >= 0).any(1))
    if len(open_):
        rows = np.arange(len(open_))[:, None]
        texts = []
        for title, only in ((x[open_], only_x[open_]), (y[open_], only_y[open_])):
            width = int(held.length[title].sum(1).max())
            of = held.of[title][:, :width]
            texts.append(_pressed(held.letter[title][:, :width], (of >= 0) & only[rows, np.maximum(of, 0)]))
        common = common_subsequences(texts[0], size_x[open_], texts[1], size_y[open_], held.kinds)
        distance = size_x[open_] + size_y[open_] - 2 * common
        best = 100 * (1 - distance / (left + right)[open_])
        some, s = shared[open_] > 0, shared[open_]
        for size, side in ((size_x[open_], left[open_]), (size_y[open_], right[open_])):
            best = np.where(some, np.maximum(best, 100 * (1 - (1 + size) / np.maximum(s + side, 1))), best)
        out[open_] = best
    return out


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(token_set_ratios([x or "" for x in a], [x or "" for x in b]) / 100.0)


def title_score(a: Column | str, b: Column | str) -> Column:
    """The similarity from 0 to 1; Arrow batches go to Python, as no built-in knows it."""
    return F.pandas_udf(_scores, T.DoubleType())(a, b)
