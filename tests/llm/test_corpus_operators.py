"""Operators 5, 6, 7, 9 and 10, components, and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litscout.llm import exact_dedup, mixing, ngram_join, shard, vector_dedup
from litscout.operators.graph import components
from litscout.storage import stored

from .test_text_operators import EDGE_IDS, EDGES, corpus, documents


def groups(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = groups(401, links)
    met = {x for a, b in links for x in (a, b) if a != b}
    assert got == {x: want[x] for x in met}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 5


def near_texts():
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.randint(4, 150))] for _ in range(30)]
    out = [" ".join(b) for b in base]
    for k in range(120):
        b = list(base[k % 12])
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = f"n{rng.randint(0, 9)}"
        out.append(("  " if k % 5 else "\n").join(b).upper() if k % 7 == 0 else " ".join(b))
    return out + ["one two", "one  TWO", "three", "", None, "a b c d e", "a b c d e"]


def brute_join(texts):
    norm = defaultdict(list)
    for i, t in enumerate(texts):
        norm[" ".join((t or "").lower().split())].append(i)
    sets = []
    for k in norm:
        w = k.split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    ids = list(norm.values())
    links = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) > 0]
    count = Counter(x for link in links for x in link)
    root = groups(len(sets), links)
    low = defaultdict(lambda: 10**9)
    for i, r in enumerate(root):
        low[r] = min(low[r], ids[i][0])
    return {j: (low[root[i]], count[i], len(ids[i])) for i in range(len(sets)) for j in ids[i]}


@pytest.mark.parametrize("block", [1024, 7])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    texts = near_texts()
    got = ngram_join.ngram_join(documents(spark, texts)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.copies) for r in got} == brute_join(texts)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_case_and_space_variants_are_copies(spark):
    a = [f"w{i}" for i in range(40)]
    b = " ".join(a[:-1] + ["end"])
    texts = [" ".join(a), " ".join(a).upper(), "\n".join(a), b, b.title(), "other"]
    got = {r.doc_id: (r.class_id, r.n_links, r.copies) for r in ngram_join.ngram_join(documents(spark, texts)).collect()}
    assert got == {0: (0, 1, 3), 1: (0, 1, 3), 2: (0, 1, 3), 3: (0, 1, 2), 4: (0, 1, 2), 5: (5, 0, 1)}
    assert "differ in letter case and white space alone are copies" in ngram_join.__doc__


def test_blocked_overlaps_equal_pairs():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10**6, 60, False)).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 55, False), rng.choice(10**6, 4).astype(np.uint64)]) for _ in range(40)] + [np.empty(0, np.uint64)]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])) > 0}
    every = np.arange(len(sets))
    i, j = ngram_join.overlaps(sets, every, every, True)
    assert set(zip(i.tolist(), j.tolist())) == want
    a, b = every[:15], every[15:]
    i, j = ngram_join.overlaps(sets, a, b, False)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x, y in want if x < 15 <= y}


@pytest.mark.parametrize("chunk", [16_384, 50])
def test_least_hashes_of_texts(monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    a, b = (rng.integers(1, 2**32, 20, np.uint32) for _ in range(2))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (1, 4, 5, 300, 6, 2, 30, 7)]
    hashed = [ngram_join.word_hashes(ngram_join.words_of(t)) for t in texts]
    for text, low in zip(texts, ngram_join._lows(hashed, 5, a, b)):
        s = (ngram_join.shingles(text) >> np.uint64(32)).astype(np.uint32)
        assert (low == (a[:, None] * s[None] + b[:, None]).min(1)).all()


@pytest.mark.parametrize("rows", [512, 3])
def test_chance_meetings_chain_nothing(spark, monkeypatch, rows):
    """Pairs that share a band but too few values are no candidates; those at the threshold are, in blocks of any size."""
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 2**16, (12, 100)).astype("<u2")
    sig[1, :79] = sig[0, :79]
    sig[5, :56], sig[6, :54] = sig[4, :56], sig[4, :54]
    df = spark.createDataFrame([(7, i, 12, s.tobytes()) for i, s in enumerate(sig)], "bucket bigint, node bigint, m bigint, sig binary")
    dealt = ngram_join.dealt(df, "bucket", "node", F.ceil(F.col("m") / rows)).select("bucket", "bi", "bj", "own", "node", "sig")
    got = {(r.a, r.b) for r in dealt.mapInArrow(ngram_join._agreeing(ngram_join.AGREE), "a bigint, b bigint").collect()}
    assert got == {(0, 1), (4, 5)}


def test_banding():
    bands, rows = ngram_join.banding(0.8)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_join_edges(spark):
    df = documents(spark, EDGES, EDGE_IDS)
    assert ngram_join.ngram_join(df).count() == len(EDGES)
    kept = ngram_join.near_dedup(df)
    assert kept.columns == df.columns
    assert Counter(" ".join((r.text or "").lower().split()) for r in kept.collect()) == Counter({" ".join((t or "").lower().split()) for t in EDGES})
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


# 6


def test_directory_splits_and_doubles():
    counts = {0b000: 5, 0b001: 5, 0b010: 1, 0b100: 1, 0b111: 2}
    got = exact_dedup.directory(counts, 5, 3)
    assert got == [(0, 0b000, 3), (1, 0b001, 3), (2, 0b01, 2), (3, 0b1, 1)]
    assert exact_dedup.directory({}, 5, 3) == [(0, 0, 0)]
    assert exact_dedup.directory({0: 99}, 5, 2)[0] == (0, 0, 2)  # one key cannot be split


def test_copies(spark):
    texts = [" a  b", "a b", "\x0ba\tb", " a b", "a b ", None, "", " ", "\n\t", "a\xa0b", "a b"]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first = {n: norm.index(n) for n in norm}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(documents(spark, texts)).collect()}
    assert got == {i: (first[n], norm.count(n), first[n] == i) for i, n in enumerate(norm)}


def test_copies_with_colliding_keys(spark):
    rows = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "a"), (4, -9, "c")], "id bigint, key bigint, norm string")
    entries = exact_dedup.build_index(rows, capacity=1).collect()
    assert sorted((r.key, r.chain, r.keep_id, r.group_size) for r in entries) == [(-9, 1, 4, 1), (7, 1, 1, 2), (7, 2, 2, 1)]
    assert len({r.bucket for r in entries}) == 2


def test_index_is_written_and_probed_by_bucket(spark):
    keys = [(i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for i in range(40)]
    rows = spark.createDataFrame([(i, k, f"t{i}") for i, k in enumerate(keys)], "id bigint, key bigint, norm string")
    index, slots = exact_dedup.build(rows, capacity=5)
    assert all(f"bucket={b}/" in f for b, f in ((r.bucket, r.f) for r in index.select("bucket", F.input_file_name().alias("f")).collect()))
    assert index.select("bucket", F.input_file_name()).distinct().count() == index.select("bucket").distinct().count() > 1
    routed = exact_dedup.route(rows.select("id", "key", F.sha2("norm", 256).alias("text_sha256")), slots)
    assert {(r.id, r.bucket) for r in routed.collect()} == {(r.keep_id, r.bucket) for r in index.collect()}
    assert {(r.id, r.keep_id, r.kept) for r in exact_dedup.probe(routed, index).collect()} == {(i, i, True) for i in range(40)}


def test_a_wrong_directory_finds_no_entries(spark):
    rows = spark.createDataFrame([(i, (i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63, f"t{i}") for i in range(40)], "id bigint, key bigint, norm string")
    index, slots = exact_dedup.build(rows, capacity=5)
    wrong = slots.withColumn("bucket", F.col("bucket") + 1)
    wrong.depth = slots.depth
    digests = rows.select("id", "key", F.sha2("norm", 256).alias("text_sha256"))
    assert exact_dedup.probe(exact_dedup.route(digests, wrong), index).count() == 0
    assert exact_dedup.probe(exact_dedup.route(digests, slots), index).count() == 40


def test_the_directory_follows_the_entries(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("norm"))
    index, slots = exact_dedup.build(rows, capacity=500)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 500 and len(sizes) > 40 and slots.depth <= exact_dedup.MOST_BITS


def test_greatest_and_missing_ids(spark):
    top = 2**63 - 1
    df = documents(spark, ["a", "a", "b", "b", "c", "c"], [top, None, None, None, -1, top])
    got = Counter((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.mark_copies(df).collect())
    assert got == {(top, top, True): 1, (None, top, False): 1, (None, None, True): 2, (-1, -1, True): 1, (top, -1, False): 1}
    assert sorted(r.text for r in exact_dedup.exact_dedup(df).collect()) == ["a", "b", "c"]


def test_copies_edges(spark):
    df = documents(spark, EDGES, EDGE_IDS)
    got = exact_dedup.mark_copies(df).collect()
    assert len(got) == len(EDGES)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in EDGES})
    assert exact_dedup.mark_copies(df.limit(0)).count() == 0


# 7


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node string, label int")


def brute_vectors(x, cosine=0.95):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= cosine
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("parameters", [{}, {"leaf": 64, "sample": 300}])
def test_vectors_equal_brute_force(spark, monkeypatch, parameters):
    if parameters:
        monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((60, 16))
    x = np.concatenate([centre, centre[rng.integers(0, 60, 500)] + 0.08 * rng.standard_normal((500, 16)), np.repeat(centre[:1], 40, 0)])
    df = vectors(spark, [(i, v.tolist(), "n", 0) for i, v in enumerate(x)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_dedup(df, **parameters).collect()}
    s = brute_vectors(x)
    root = groups(len(x), np.argwhere(np.triu(s)).tolist())
    want = {i: (int(s[i].sum()), root[i], root[i] == i) for i in range(len(x))}
    recall = sum(got[i][0] for i in got) / s.sum()
    assert len(got) == len(x) and recall >= 0.98 and all(got[i][0] <= want[i][0] for i in got)
    if not parameters:
        assert got == want


@pytest.mark.parametrize("parameters", [{}, {"leaf": 64, "sample": 400}])
def test_vectors_of_several_lengths(spark, parameters):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for width, n in ((16, 200), (8, 150), (3, 9), (40, 1)):
        x = rng.standard_normal((n, width))
        x = np.concatenate([x, x[: n // 2] + 0.01 * rng.standard_normal((n // 2, width))])
        s, at = brute_vectors(x), len(rows)
        root = groups(len(x), np.argwhere(np.triu(s)).tolist())
        want.update({at + i: (int(s[i].sum()), at + root[i], root[i] == i) for i in range(len(x))})
        rows += [(at + i, v.tolist(), "n", 0) for i, v in enumerate(x)]
    rng.shuffle(rows := np.array(rows, object))
    df = vectors(spark, [tuple(r) for r in rows.tolist()])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_dedup(df, **parameters).collect()}
    assert len(got) == len(want) and sum(got[i][0] for i in got) >= 0.98 * sum(want[i][0] for i in want)
    if not parameters:
        assert got == want


def test_leaves_are_split_by_their_own_rows(spark):
    """From a sample far too small for the table's leaves, however large the table is."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16))
    rows = [(i, 1, 16, v.tobytes()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node bigint, copies bigint, width int, raw binary")
    forests = {16: {t: vector_dedup.grow(x[:80], 3000, 64, vector_dedup.margin_of(0.95, 16), t) for t in range(3)}}
    routed = stored(nodes.mapInArrow(vector_dedup._router(forests, 0.95, np.float64), vector_dedup.ROUTED))
    split, crowded = vector_dedup.small_leaves(routed, 64, 0.95, np.float64, 200)
    got = [r.leaves for r in split.collect()]
    sizes = Counter(leaf for leaves in got for leaf in leaves)
    assert crowded is None and max(sizes.values()) <= 128 and len(got) == 3000
    assert all({leaf >> vector_dedup.PLACE for leaf in leaves} == {0, 1, 2} for leaves in got)


def test_vectors_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((30, 3))
    rows = [(i, v.tolist(), "n", 0) for i, v in enumerate(np.concatenate([x, x + 0.01]))] + [(100 + i, rng.standard_normal(5).tolist(), "n", 0) for i in range(20)]
    got = [sorted(map(tuple, vector_dedup.vector_dedup(vectors(spark, rows).repartition(n)).collect())) for n in (1, 4)]
    assert got[0] == got[1]


def test_more_trees_for_deeper_tables():
    counts = [vector_dedup.trees_for(n, 2048, 0.95) for n in (10**3, 10**5, 10**7, 10**9)]
    assert counts == sorted(counts) and counts[0] == 2 and counts[-1] <= 20


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "", 0), (2, [0.0, 0.0], "", 0), (3, [nan, 1.0], "", 0), (4, [inf, 1.0], "", 0), (5, [1.0, None], "", 0), (6, [1.0, 0.0], "", 0), (7, [2.0, 0.0], "", 0), (7, [3.0, 0.0], "", 0), (None, [1.0, 0.01], "", 0), (9, [], "", 0), (10, [0.0, 1e-300], "", 0), (11, [-0.0, 1e300], "", 0)]
    got = vector_dedup.vector_dedup(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    for i in (1, 2, 3, 4, 5, 9):
        assert by[i] == (0, i, True)
    assert by[6] == (3, 6, True) and by[7] == (3, 6, False) and by[None][:2] == (3, 6) and by[10] == (1, 10, True) and by[11] == (1, 10, False)
    assert vector_dedup.vector_dedup(vectors(spark, [])).count() == 0


# 9


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        src = rng.choice(["a", "a", "a", "a", "a", "a", "b", "c", None])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 60))), src, "en", None, "", "", ""))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint, key string, size string, row string")
    got = mixing.mix(df).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    size = got.groupby(got.source.fillna("~"))["size"].sum().to_dict()
    weight, total = dict(zip(["a", "b", "c", "~"], [1, 2, 3, 1])), sum(size.values())
    capped, goal = set(), {}
    while True:  # reshare until none is above three times its size
        left = total - sum(3 * size[s] for s in capped)
        goal = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size}
        over = {s for s in size if s not in capped and goal[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s, g in got.groupby(got.source.fillna("~")):
        assert abs(g.target.iloc[0] - goal[s]) < 1e-6 and abs(g.taken.sum() - goal[s]) <= 1
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(df).orderBy("doc_id").collect() == mixing.mix(df.repartition(3)).orderBy("doc_id").collect()
    per = mixing.mix_rows(mixing.document_rows(df), per_slice=5).select("doc_id", "taken")
    assert {r.doc_id: r.taken for r in per.collect()} == dict(zip(got.doc_id, got.taken))


def test_mix_prefers_weight(spark):
    df = documents(spark, [("w " * 5 if i % 2 else "w" * 5000 + " w w w w") for i in range(600)])
    rows = mixing.document_rows(df).withColumn("source_key", F.when(F.col("doc_id") < 500, "a").otherwise("b"))
    got = mixing.mix_rows(rows).where("source_key = 'a'").groupBy("size", "weight").agg(F.avg("taken").alias("t")).orderBy("weight").collect()
    assert got[0].t < got[-1].t


def test_mixed_documents(spark):
    texts = ["one two three", "four five", None, "six", "six", "a b c d e f g h"]
    df = documents(spark, texts, [1, 2, 3, 4, 4, 5]).withColumn("source", F.when(F.col("doc_id") == 5, "b").otherwise("a"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words - sum(len((t or "").split()) for t in texts)) <= 2
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_mix_edges(spark):
    assert mixing.mix(documents(spark, EDGES, EDGE_IDS)).count() == len(EDGES)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, ["", None])).collect()] == [0, 0]


# 10


def test_differencing_beats_greedy():
    rng = random.Random(6)
    sizes = [rng.randint(1, 1000) for _ in range(200)]
    sums = [0] * 7
    for s, w in zip(sizes, shard.difference(sizes, 7)):
        sums[w] += s
    greedy = [0] * 7
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert shard.difference([8, 7, 6, 5, 4], 2) in ([0, 1, 1, 0, 1], [1, 0, 0, 1, 0], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0], [0, 1, 1, 0, 0], [1, 0, 0, 1, 1])
    assert shard.difference([], 3) == [] and shard.difference([1, 2], 1) == [0, 0]


def test_shards(spark):
    rng = random.Random(9)
    texts = ["x" * rng.randint(0, 900) + str(i % 300) for i in range(900)] + ["hot"] * 40 + [None, "", "é"]
    got = shard.shard_rows(documents(spark, texts)).toPandas()
    assert len(got) == len(texts)
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 24 and total.max() - total.min() < 0.02 * total.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    assert dict(zip(got.doc_id, got.text_crc32)) == {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}
    assert dict(zip(got.doc_id, got["size"])) == {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    assert dict(zip(got.doc_id, got["size"]))[940] == 8
    assert shard.shard_rows(documents(spark, [])).count() == 0
    assert shard.shard_rows(documents(spark, EDGES, EDGE_IDS)).count() == len(EDGES)


# pipeline


def test_pipeline(spark, tmp_path):
    kinds, texts = corpus(3, 150)
    texts += [texts[kinds.index("fine")], "  " + texts[kinds.index("fine")], None]
    kinds += ["fine", "fine", "junk"]
    df = documents(spark, texts).select("doc_id", "text", "lang", F.lit("s").alias("source"), "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kinds)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == df.columns
    fine = {i for i, k in enumerate(kinds) if k == "fine"}
    kept = {r.doc_id for r in seen["quality_classifier"].collect()}
    assert len(kept ^ fine) <= 3
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    assert seen["exact_dedup"].count() == len({norm(texts[i]) for i in kept})
    assert seen["ngram_join"].count() == len({v[0] for v in brute_join([r.text for r in seen["exact_dedup"].orderBy("doc_id").collect()]).values()})
    assert seen["packing"].agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def run_stages(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
    return docs


LABELS = "doc_id bigint, quality int, toxic int"


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert run_stages(spark, documents(spark, []), tmp_path).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, a very long text, and columns whose names operators use inside."""
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 10**6)) for _ in range(30_000))
    kinds, texts = corpus(5, 60)
    texts += [None, "", " ", long, "dup dup text", "dup dup text", "dup  dup text"]
    ids = [*range(60), None, None, 7, 8, 9, 9, None]
    spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kinds)] + [(None, None, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    pieces = run_stages(spark, documents(spark, texts, ids), tmp_path).collect()
    kept = spark.read.parquet(str(tmp_path / "ngram_join")).collect()
    assert any(r.text == long for r in kept) and all((r.text or "").strip() for r in kept)
    assert len({" ".join(r.text.lower().split()) for r in kept}) == len(kept)
    assert sum(p.length for p in pieces) > 0 and {p.doc_id for p in pieces} <= {r.doc_id for r in kept}
