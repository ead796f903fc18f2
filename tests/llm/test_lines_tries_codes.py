"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litscout.llm import line_dedup, prefix_trie, vector_codes

# 11

WHITE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_lines(rows):
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(set)
    for i, lines in texts:
        for line in lines:
            holders[line.strip(WHITE).translate(UPPER)].add(i)
    out = []
    for i, lines in texts:
        kept = []
        for line in lines:
            key = line.strip(WHITE).translate(UPPER)
            ids = holders[key]
            first = min((x for x in ids if x is not None), default=None)
            if len(key) < 10 or len(ids) < 2 or i == first:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(11)
    pool = [" Über die Brücke geht es WEITER ", "the same LINE as before\r", "\tThe same line as before", "the same line as before", "short", "ninechars", "ten chars!", "TEN chars!  ", "İstanbul line", "x" * 5_000, "", "a b\x85cdefghijk"]
    rows = [(i, "\n".join(rng.choice([*pool, f"only here {i} {k}"]) for k in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(3, rows[3][1]), (3, "the same line as before\nonly three has it\nonly three has it"), (3, "only three has it"), (None, "nobody's long line\nthe same line as before"), (None, "nobody's long line")]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (-5, "x" * 5_000), (103, "\n".join(f"line of one long text {k % 700}" for k in range(3_000))), (104, "line of one long text 699\nanother")]


@pytest.mark.parametrize("bits", [None, 64])
def test_lines_equal_brute_force(spark, bits):
    """With 64 bits both filters are full, and every line is suspected."""
    rows = line_rows()
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id bigint, key string").repartition(7)
    got = line_dedup.drop_repeated_lines(docs, bits=bits)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(0, 6), max_size=40), max_size=6), st.sampled_from([64, 1 << 12]))
def test_filters_miss_no_repeat_however_they_are_merged(tasks, bits):
    seen = line_dedup.SeenTwice(bits)
    for hashes in tasks:
        mine = line_dedup.SeenTwice(bits)
        for a in range(0, len(hashes), 7):
            mine.add(np.array(hashes[a : a + 7], np.int64))
        seen.merge(mine.once, mine.twice)
    n = Counter(h for hashes in tasks for h in hashes)
    again = np.array([h for h, k in n.items() if k > 1], np.int64)
    assert line_dedup.holds(seen.twice, again).all()
    assert line_dedup.holds(seen.once, np.array(list(n), np.int64)).all()


def test_few_single_lines_are_suspected(spark):
    rng = np.random.default_rng(5)
    single, double = rng.integers(-(2**63), 2**63 - 1, 200_000), rng.integers(-(2**63), 2**63 - 1, 5_000)
    parts = np.array_split(np.r_[single, double, double], 40)
    df = spark.createDataFrame([(p.tolist(),) for p in parts], "h array<bigint>").repartition(8)
    twice = line_dedup.repeated(df, 210_000)
    assert line_dedup.holds(twice, double).all()
    assert line_dedup.holds(twice, single).mean() < 0.02


# 12


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            token = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, role, token, text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        full[c] = turns.get(base, [])[:h] + mine[h:] if rebuild else mine
    members = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in children[k]) if children[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[c] for c in children[k])
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()
    ) if members else []


def talk_rows():
    rng = random.Random(12)
    rows = []
    for c in [*range(60), *range(1000, 1030), -7, -5, 2**40]:
        shape = rng.randint(0, 3)
        for t in range(rng.randint(1, 14)):
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {t} of {shape if t < 6 else rng.randint(0, 2)}" + "é" * shape))
    rows += [(7, 3, None, None), (8, None, "system", "before all"), (9, 1, "user", "tie"), (9, 1, "user", "tie"), (9, 1, "system", "tie"), (None, 1, "user", "nobody"), (70, 0, "user", ""), (71, 0, None, ""), (80, 0, "user", "x" * 100_000)]
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2200) for t in range(4)]
    return rows + [(5000, t, "user", f"long {t % 11}") for t in range(2_500)] + [(5001, t, "user", f"long {t % 11}") for t in range(1_900)]


@pytest.mark.parametrize("turns_a_task, run_rows", [(200_000, 1024), (150, 3)])
def test_trie_equals_brute_force(spark, turns_a_task, run_rows):
    rows = talk_rows()
    df = spark.createDataFrame([(t, x, c, r, "z") for c, t, r, x in rows], "turn bigint, text string, conv_id bigint, role string, depth string").repartition(5)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), turns_a_task, run_rows).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(empty))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=60), st.integers(1, 5), st.integers(2, 4), st.sampled_from([1, 1 << 20]))
def test_merged_runs_are_in_order_with_lcps(sequences, run_rows, fan_in, memory):
    def seq(s):
        return b"".join(bytes([x]) * 16 for x in s)

    entries = [prefix_trie.Entry(seq(s), [1] * len(s), 1, i, "") for i, s in enumerate(sequences)]
    merged = list(prefix_trie.merge_sorted(iter(entries), run_rows, fan_in, memory))
    assert [e.seq for e in merged] == sorted(seq(s) for s in sequences)
    for a, b in zip(merged, merged[1:]):
        assert b.lcp == prefix_trie.shared(a.seq, b.seq)


def test_merging_compares_shared_turns_once():
    """Sequences that share 200 turns and differ in the last: with LCPs the tree looks at turns hardly more often than once a sequence."""
    rng = random.Random(3)
    head = bytes(200 * 16)
    runs = []
    for _ in range(8):
        rows = sorted(head + rng.randbytes(16) for _ in range(100))
        runs.append([prefix_trie.Entry(s, [], 1, 0, "", lcp=200 if i else 0) for i, s in enumerate(rows)])
    tree, looked = prefix_trie.LoserTree(runs), []
    plain = prefix_trie.shared
    try:
        prefix_trie.shared = lambda a, b, known=0: looked.append(known) or plain(a, b, known)
        assert len(list(tree)) == 800
    finally:
        prefix_trie.shared = plain
    assert min(looked) == 200  # no comparison of the merge begins before the shared turns' end


# 13


def brute_codes(rows, parts=16, entries=64, rounds=2, most=1 << 24):
    kept = [(i, [max(-most, min(most, math.floor(256 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]

    def cut(v, p):
        return v[p * width : (p + 1) * width]

    books = [[cut(v, p) for _, v, _ in seeds] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[assign(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(held[k]) for x in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        best = [assign(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=repr)


def coded(spark, rows):
    df = spark.createDataFrame([(label, i, v, "x") for i, v, label in rows], "label int, vec_id bigint, embedding array<double>, code string").repartition(4)
    rows, books = vector_codes.compress(df)
    rows = vector_codes.with_label_error(vector_codes.stored(rows))
    return sorted(map(tuple, rows.select("vec_id", "code", "error", "label_error", vector_codes.digest_of(books)).collect()), key=repr)


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    return [(int(i), (centres[i % 20] + rng.normal(size=dims) * 0.3).tolist(), int(i % 7) if i % 11 else None) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(400, 32, 1)
    rows += [(500, None, 1), (501, [None] * 32, 1), (502, [math.nan] * 32, 1), (503, [math.inf] + [0.0] * 31, 2), (504, [0.0] * 32, 2), (5, rows[9][1], 3), (None, rows[3][1], 3), (3, rows[3][1], None), (3, rows[3][1], None), (505, [1e300, -1e300] * 16, 3), (506, [0.1] * 20, 4), (507, [], 4), (-9, [1.0] * 32, 4)]
    assert coded(spark, rows) == brute_codes(rows)


@pytest.mark.parametrize("n, dims", [(9, 16), (70, 50), (3, 5)])
def test_codes_of_few_vectors_and_odd_lengths(spark, n, dims):
    assert coded(spark, vectors(n, dims, 2)) == brute_codes(vectors(n, dims, 2))


def test_codes_without_vectors(spark):
    assert coded(spark, []) == [] == coded(spark, [(1, None, 1), (2, [math.nan], None)])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 70), st.integers(1, 5), st.integers(0, 5), st.sampled_from([2, 300, 1 << 24]))
def test_bounds_hold_and_the_filter_loses_nothing(seed, n, dims, bits, most):
    rng = np.random.default_rng(seed)
    book, parts = rng.integers(-most, most + 1, (n, dims)), rng.integers(-most, most + 1, (40, dims))
    exact = ((parts[:, None] - book[None]) ** 2).sum(2)
    cells = vector_codes.Cells(book, bits)
    lower, upper = cells.bounds(parts)
    assert (lower <= exact).all() and (exact <= upper).all()
    code, far, _ = cells.nearest(parts)
    assert (code == exact.argmin(1)).all() and (far == exact.min(1)).all()


def test_the_filter_leaves_few_entries():
    rng = np.random.default_rng(4)
    book, parts = rng.integers(-256, 256, (64, 4)), rng.integers(-256, 256, (5_000, 4))
    assert vector_codes.Cells(book).nearest(parts)[2] < 0.15 * 64 * 5_000


def test_decoding_gives_the_entries(spark):
    rows, books = vector_codes.compress(spark.createDataFrame(vectors(80, 32, 6), "vec_id bigint, embedding array<double>, label int"))
    held = {i: [math.floor(256 * x) for x in v] for i, v, _ in vectors(80, 32, 6)}
    for r in rows.collect():
        assert ((vector_codes.decode(r.code, books) - np.array(held[r.vec_id])) ** 2).sum() == r.error
