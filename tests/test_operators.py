import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litscout.functions.fuzzy import token_set_ratio
from litscout.operators import cap, dedupe, enrich, fanin, profile, scoring, state, topic, vectors
from litscout.config import Scoring, Sources

ROW = "ordinal bigint, source string, identifier string, title string, abstract string, doi string, url string, venue string"


def rows(spark, values):
    """values: (identifier, title, doi)."""
    return spark.createDataFrame([(i, "s", a, b, None, c, None, None) for i, (a, b, c) in enumerate(values)], ROW)


def loop_cap(kinds, share):
    kept, pre = [], 0
    for i, p in enumerate(kinds):
        if p and (pre + 1) / (len(kept) + 1) > share:
            continue
        pre += p
        kept.append(i)
    return kept


def test_cap_equals_the_loop(spark):
    rng = random.Random(3)
    for share in (0.3, 0.5, 0.25):
        kinds = [rng.random() < 0.5 for _ in range(300)]
        df = spark.createDataFrame([(i, "ArXiv" if p else "x") for i, p in enumerate(kinds)], "i int, source string")
        assert [r.i for r in cap.cap_share(df, [F.col("i")], share=share).orderBy("i").collect()] == loop_cap(kinds, share)
    assert cap.cap_share(df, [F.col("i")], share=0).count() == 300


def test_keep_first(spark):
    df = rows(spark, [("a", "t", "10.1"), ("b", "t", " 10.1 "), ("10.1", "t", None), ("", "Title", ""), ("", " title ", None), (" ", " ", None), (None, None, None)])
    assert sorted(r.ordinal for r in dedupe.keep_first(df).collect()) == [0, 3]


def loop_dedupe(values, library, threshold=90):
    norm = lambda x: re.sub(r"\s+", " ", x or "").strip().lower()
    dois = {d.lower().strip() for _, _, d, _ in library if d}
    urls = {u.lower().strip() for _, _, _, u in library if u}
    titles, mine, seen, kept = [norm(t) for _, t, _, _ in library], [], set(), []
    like = lambda t, many: any(e and token_set_ratio(t, e) >= threshold for e in many)
    for i, (ident, title, doi) in enumerate(values):
        key, d, t = (ident or "").lower().strip(), (doi or "").lower().strip() or None, norm(title)
        if d and (d in dois or d in seen) or key in urls or key in seen or like(t, titles) or like(t, mine):
            continue
        kept.append(i)
        mine.append(t)
        seen |= {key} | ({d} if d else set())
    return kept


def test_dedupe_equals_the_greedy_loop(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda alphas betas gammas".split()
    values = []
    for i in range(150):
        title = " ".join(rng.sample(words, rng.randint(1, 7)))
        if rng.random() < 0.3 and values:
            title = rng.choice(values)[1].replace("a", "e", 1)
        values.append((f"id{rng.randint(0, 120)}", title, rng.choice([None, None, f"id{rng.randint(0, 40)}", ""])))
    library = [(f"k{i}", " ".join(rng.sample(words, 3)), f"id{i}" if i % 2 else None, f"ID{i + 50} ") for i in range(6)]
    lib = spark.createDataFrame(library, "key string, title string, doi string, url string")
    got = sorted(r.ordinal for r in dedupe.dedupe(rows(spark, values), lib).collect())
    assert got == loop_dedupe(values, library)


def test_chain_keeps_both_ends(spark):
    df = rows(spark, [("1", "one two three four five six seven eight nine ten", None), ("2", "one two three four five six seven eight nine ten xx", None), ("3", "zz", None)])
    assert sorted(r.ordinal for r in dedupe.self_dedupe(df).collect()) == [0, 2]


def test_long_chains_of_keys(spark):
    """A chain of versions: the identifier of one row is the DOI of the next. Every other row stays, as in the loop."""
    values = [(f"v{i}", f"{i:x} " * 3, f"v{i - 1}") for i in range(1000)]
    want = loop_dedupe(values, [])
    assert want == list(range(0, 1000, 2))
    assert sorted(r.ordinal for r in dedupe.self_dedupe(rows(spark, values)).collect()) == want
    keys = spark.createDataFrame([(i, k) for i in range(300) for k in (f"v{i}", f"v{i - 1}")], "id bigint, key string")
    for most, rounds in ((150, 3), (10_000, 0), (151, 1)):  # a chain waits for its rounds; blocks take what is open
        assert sorted(r.id for r in dedupe.in_rounds(keys, keys, most, rounds).collect()) == want[:150]


def test_components_and_rounds_equal_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, f"k{rng.randint(0, 60)}") for i in range(120) for _ in range(rng.randint(1, 2))]
    df = spark.createDataFrame(rows, "id bigint, key string")
    keys: dict[int, set] = {}
    for i, k in rows:
        keys.setdefault(i, set()).add(k)
    held, want = set(), []
    for i in sorted(keys):
        if not held & keys[i]:
            want.append(i)
            held |= keys[i]
    for most in (10**6, 40, 1):  # one task, a task for each small component, rounds alone
        assert sorted(r.id for r in dedupe.greedy(df, df, most).collect()) == want


def test_topic_rules(spark):
    df = spark.createDataFrame([(0, "Steel fatigue", "of welds", None), (1, "Steel art", None, None), (2, "Fatigue", "casino steel", None), (3, None, None, "STEEL FATIGUE weekly")], "ordinal int, title string, abstract string, venue string")
    t = topic.Topics.of(Sources(required_keyword_groups=[["zzz"]], required_any_group_sets=[[["steel"], ["fatigue", " "]], [["", " "]]], exclude_keywords=["Casino"], include_keywords=["x"]))
    hay = F.lower(F.concat_ws(" ", "title", "abstract", "venue"))
    assert [r.ordinal for r in df.where(topic.on_topic(hay, t)).orderBy("ordinal").collect()] == [0, 3]
    assert topic.Topics.of(Sources(required_keyword_groups=[[" "]])).empty()


def test_nearest_both_ways(spark):
    rng = random.Random(1)
    vec = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, None)]
    df = spark.createDataFrame(vec, "id bigint, embedding array<float>")
    a, b = df.where("id % 2 = 1"), df.where("id % 2 = 0")
    one = {(r.id, r.rank): r.key for r in vectors.nearest(a, b, 3).collect()}
    two = {(r.id, r.rank): r.key for r in vectors.nearest(a, b, 3, broadcast_bytes=500).collect()}
    assert one == two and len(one) == 180
    assert vectors.nearest(a, b.where("id < 0")).count() == 0


def test_nearest_in_tiles(monkeypatch):
    monkeypatch.setattr(vectors, "TILE", (7, 11))
    rng = np.random.default_rng(4)
    a, b = rng.integers(-2, 3, (30, 4)).astype(np.float32), rng.integers(-2, 3, (50, 4)).astype(np.float32)
    for k in (1, 3, 60):
        got = sorted((int(i), -s, int(j)) for r, c, x in vectors.best(a, b, k) for i, j, s in zip(r, c, x))
        want = []
        for i in range(30):
            want += [(i, *p) for p in sorted((-float(a[i] @ b[j]), j) for j in range(50))[:k]]
        assert got == sorted(want)


def test_topics_hold_the_text_once(spark):
    df = spark.createDataFrame([("a", "b", "c")], "title string, abstract string, venue string")
    t = topic.Topics(groups=[[f"term{i}" for i in range(50)]], exclude=["x", "y"])
    plan = df.where(topic.on_topic(F.lower(F.concat_ws(" ", "title", "abstract", "venue")), t))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws") == 1


def test_score_adds_raw_weights(spark):
    s = Scoring(whitelist_venues=["VenueX"], whitelist_authors=["ann"])
    df = spark.createDataFrame(
        [(0, "s", "i", "t", None, ["Ann"], None, None, None, " VenueX", {"cited_by": 1.0}, {})],
        "ordinal bigint, source string, identifier string, title string, abstract string, authors array<string>, doi string, url string, published timestamp, venue string, metrics map<string,double>, extra map<string,string>",
    )
    metrics = spark.createDataFrame([("venuex", 9.0)], "title_key string, sjr double")
    sim = spark.createDataFrame([(0, 0.5)], "ordinal bigint, similarity double")
    r = scoring.score(df, sim, metrics, s, F.current_timestamp()).first()
    assert (r.author_bonus, r.venue_bonus, r.recency_score, r.journal_sjr) == (1.0, 0.0, 0.0, 9.0)  # the metric lookup strips, the whitelist does not
    assert r.score == pytest.approx(0.5 * 0.45 + 0.6931471805599453 * 0.15 + 2.302585092994046 * 0.08 + 0.02)


def test_state(spark):
    schema = "key string, version bigint, content_hash string, embedding array<float>"
    old = spark.createDataFrame([("a", 1, "h1", [1.0]), ("b", 1, "h2", [2.0]), ("c", 1, "h3", [3.0])], schema)
    new = spark.createDataFrame([("a", 2, "h1", None), ("b", 3, "hX", None), ("b", 2, "h2", None), ("d", 4, "h4", None)], schema)
    gone = spark.createDataFrame([("c",)], "key string")
    got = {r.key: (r.version, r.embedding) for r in state.apply_changes(old, new, gone).collect()}
    assert got == {"a": (2, [1.0]), "b": (3, None), "d": (4, None)}
    vec = spark.createDataFrame([("b", [9.0])], "key string, embedding array<float>")
    assert {r.key: r.embedding for r in state.set_embeddings(old, vec).collect()}["b"] == [9.0]


def test_snapshots(spark, tmp_path):
    s = state.Snapshots(spark, str(tmp_path))
    assert s.read("key string").count() == 0
    s.write(spark.createDataFrame([("a",)], "key string"), cursor=7)
    s.write(spark.createDataFrame([("a",), ("b",)], "key string"), cursor=9)
    assert s.read("key string").count() == 2 and s.pointer() == {"version": 1, "cursor": 9}


def test_enrich(spark):
    df = spark.createDataFrame([("d1", None, "https://doi.org/d1"), ("d2", "has", "http://own"), ("d3", "", None), (None, None, None)], "doi string, abstract string, url string")
    works = spark.createDataFrame([("d1", "A", "http://page"), ("d2", "B", "http://p2")], "doi string, abstract string, landing_page string")
    found = spark.createDataFrame([("d3", "http://r3")], "doi string, resolved_url string")
    got = {r.doi: (r.abstract, r.url) for r in enrich.enrich(df, works, found).collect()}
    assert got == {"d1": ("A", "http://page"), "d2": ("has", "http://own"), "d3": ("", "http://r3"), None: (None, None)}


def test_profile_ties_by_first_place(spark):
    df = spark.createDataFrame([(0, ["b", "a"]), (1, ["a", "b", "c"])], "ordinal int, creators array<string>")
    assert [(r.author, r["count"]) for r in profile.top_authors(df, 2).collect()] == [("b", 2), ("a", 2)]


def test_sources_fail_alone():
    def fail():
        raise OSError("down")

    a, b = fanin.guarded("a", fail), fanin.guarded("b", lambda: None)
    assert a.failed and not b.failed and fanin.all_failed([a]) and not fanin.all_failed([a, b]) and not fanin.all_failed([])
    with pytest.raises(KeyError):
        fanin.guarded("c", lambda: {}["x"])


def test_many_terms_in_one_pass(spark):
    rng = random.Random(4)
    terms = ["".join(rng.choice("abc_%é ") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    s = Sources(
        required_any_group_sets=[[terms[:9], terms[9:20]], [terms[20:22]]], exclude_keywords=terms[22:24] + ["ABC"], include_keywords=terms[24:50], require_topic_match=True
    )
    texts = ["".join(rng.choice("abc_%é ") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "abc"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(3)
    t = topic.Topics.of(s)
    assert len(t.terms()) > topic.MANY_TERMS
    one, all_ = (sorted(r.i for r in df.where(topic.on_topic(F.col("x"), t, many)).collect()) for many in (0, 10**6))
    assert one == all_ and 0 < len(one) < 300
    found = {r.i: r.f for r in df.select("i", topic.found_terms(F.col("x"), terms).alias("f")).collect()}
    assert found == {i: [k for k, term in enumerate(terms) if term in x and term not in terms[k + 1 :]] for i, x in enumerate(texts)}


def test_the_number_of_terms_hardly_matters():
    import time

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4_000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(400)]

    def cost(n):
        automaton = topic._automaton(tuple(words[:n]))
        began = time.process_time()
        for _ in range(3):
            for x in texts:
                for _ in automaton.iter(x):
                    pass
        return time.process_time() - began

    cost(10)
    assert cost(1_000) < 5 * cost(10)


@pytest.mark.parametrize("size", [4_096, 40, 3])
def test_heavy_hitters_are_exact(spark, size):
    rng = random.Random(size)
    rows = [(i, f"v{int(rng.paretovariate(0.7))}" if rng.random() < 0.98 else None) for i in range(4_000)]
    df = spark.createDataFrame(rows, "ordinal int, author string").repartition(6)
    count, first = {}, {}
    for i, v in rows:
        if v is not None:
            count[v] = count.get(v, 0) + 1
            first.setdefault(v, i)
    want = sorted(count, key=lambda v: (-count[v], first[v]))[:12]
    got = profile.top_counts(df, "author", ["ordinal"], 12, size).collect()
    assert [(r.author, r["count"], r["first"].ordinal) for r in got] == [(v, count[v], first[v]) for v in want]
    if size == 40:
        assert profile.candidates(df, "author", 12, size).count() < 300  # of over 1,000 values
    assert profile.top_counts(df.where("false"), "author", ["ordinal"], 3).count() == 0


def test_rows_without_a_title_are_not_gathered_to_meet_the_library(spark):
    rows = spark.range(1_000).select(F.col("id").alias("ordinal"), F.lit("").alias("title"))
    library = spark.createDataFrame([("a title of the library",), ("",)], "title string")
    out = dedupe.fuzzy_not_in_library(rows, library)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert out.count() == 1_000
