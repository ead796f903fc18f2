"""Operators 1 to 4 and 8: text in, text or counts out."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litscout.llm import html_text, packing, quality, suffix_dedup, tokens
from litscout.llm.html_text import main_text

TEXT = "doc_id bigint, text string, source string, lang string, n_chars bigint, key string, size string, row string"


def documents(spark, texts, ids=None):
    """Rows with extra columns whose names clash with those that operators use inside."""
    ids = ids or range(len(texts))
    rows = [(i, t, "s", "en", None, "k", "z", "r") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, TEXT)


EDGES = [None, "", " ", "\t\n", "a", "<|endoftext|> x", "a\x1cb", "é ü", "word " * 30_000, "dup", "dup", "x" * 5000]
EDGE_IDS = [None, 1, 2, 3, None, 5, 5, 7, 8, 9, 9, 11]


# 1


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("<article><h1>T &amp; U</h1><p>a\n <b>b</b>c<br>d</p><script>var x='</p>';</script></article>", "T & U a bc d"),
        ("<nav><a>m</a></nav><div class='ad'>buy</div><article><p>Short.</p><p>x</p></article><footer>&copy; f</footer>", "Short. x"),
        ("<main><p>real text here</p><section class='reader-comments'><p>me too</p></section><aside>side</aside><p>end</p></main>", "real text here end"),
        ("<article><p>one<div id=cookie-notice>ok?</div><form><input><button>go</button></form><p>two", "one two"),
        ("<body><div class='menu'>a b c</div><div><p>" + "long text of the page. " * 8 + "</p></div></body>", " ".join(["long text of the page."] * 8)),
        ("<body><h1>Head</h1><p>" + "many words stand here. " * 9 + "</p><p>End.</p><p><a href=x>next</a> <a href=y>last</a></p></body>", "Head " + " ".join(["many words stand here."] * 9) + " End."),
        ("<div class='site-header'><h1>Site</h1></div><div id='content'><h1>T</h1><p>x</p><ol class='commentlist'><li>c</li></ol></div><div>unmarked</div>", "T x"),
        ("<main><div class='post-header'><h1>T</h1></div><p>body</p><div class='cookiebar'>ok</div></main>", "T body"),
        ("<article><p>1 &lt; 2 &#8364; &am</p></article", "1 < 2 € &am"),
        ("<article><p>load and address download padding</p><div class='loader'>kept</div></article>", "load and address download padding kept"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>a</p><section id='side-effects'><h2 id='Legal_status'>Law</h2><p id='notice-1'>b</p></section><p>c</p></article>", "a Law b c"),
        ("<article><p>a</p><div id='related-work'><p>short</p></div><div class='social-structure'>s</div><p>see <a id='job-search-tips' href='#x'>tips</a></p></article>", "a short s see tips"),
        ("<article><h2 id='related'>R</h2><h2 class='banner'>B</h2><section id='legal'><p>l</p></section><p>c</p></article>", "R B l c"),
        ("<article><p>a</p><div class='post-related-reading'><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div><p>c</p></article>", "a c"),
        ("<article><p>a</p><div class='share-buttons'>S</div><section id='comments'><p>m</p></section><div class='box ad-slot'>B</div><p class='notice'>n</p><p>c</p></article>", "a c"),
        ("<main><article class='commentary'><p>b</p></article></main>", "b"),
        ("<article><section class='legal'><p>l</p></section><div class='search'>s</div><div class='related'><a href=x>One</a></div></article>", "l s"),
        ("<div class='content-sidebar-wrap'><article><p>a</p></article></div>", "a"),
        ("<div class='layout-with-sidebar'><article><p>a <span class='share'>S</p><p>b</p></article></div>", "a b"),
    ],
)
def test_marks_are_whole_names(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p class='ad'>Buy<p>Real text.</p><p>More.</p></article>", "Real text. More."),
        ("<article><p class='notice'>Note <b>x<h2>T</h2><div>Real</div></article>", "T Real"),
        ("<article><ul><li class='share'>S<li>one<ul><li class='ad'>B</ul><li>two</ul><p>end</article>", "one two end"),
        ("<article><dl><dt class='ad'>a<dd class='ad'>b<dt>c<dd>d</dl><table><tr><td class='ad'>e<td>f<tr class='ad'><td>g<tr><th>h</table>i</article>", "c d f h i"),
        ("<article><table><thead class='ad'><tr><td>a<tbody><tr><td>b</table>c<select><option>d</select>e</article>", "b c e"),
        ("<html><head><title>t</title><meta name=x><body><article><p>a</article>", "a"),
        ("<title>t</title><head><link href=x>loose text", "loose text"),
        ("<article><b>Lead<p class='ad'>Buy</b> more</p>end</article>", "Lead end"),
        ("<article><div class='ad'><table><tr><td>x</div>y</table></div>z</article>", "z"),
    ],
)
def test_omitted_end_tags(page, want):
    assert main_text(page) == want


LONG = " ".join(["A long sentence of the page stands here."] * 6)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><p>{LONG}</p></article><div class='ad'>Buy</div><article><p>Rest.</p></article>", f"{LONG} Rest."),
        (f"<div class='entry'><p>One.</p></div><div class='ad'>Buy</div><section class='content'><p>{LONG}</p></section>", f"One. {LONG}"),
        (f"<table><tr><td class='content'>One.<td class='ad'>Buy<td id='story'>{LONG}</table>", f"One. {LONG}"),
        (f"<main><h1>Title</h1><p>Lead</p><article><p>{LONG}</p></article><p>After</p><div><a href=x>Next one</a></div></main>", f"Title Lead {LONG} After"),
        (f"<body><h1>Title</h1><article><p>{LONG}</p></article><div>unmarked</div>", f"Title {LONG}"),
        (f"<body><h1>Site</h1><article><h1>Title</h1><p>{LONG}</p></article>", f"Title {LONG}"),
        (f"<body><article><p>{LONG}</p></article><h2>More</h2><p>{LONG}</p><div>x</div>", f"{LONG} More {LONG}"),
        (f"<article><p>{LONG}</p></article><article><h3><a href=x>Another page</a></h3></article>", LONG),
        (f"<article><p>{LONG}</p></article><div class='story'><p>{LONG}</p></div><div class='entry'><a href=x>y</a></div>", f"{LONG} {LONG}"),
    ],
)
def test_split_articles(page, want):
    assert main_text(page) == want


def test_clusters_decide_about_doubtful_parts(monkeypatch):
    part = "<div id='related-work'><p>{} <a href=x>b</a></p></div>"
    rest = f"<p>{LONG * 9}</p>" + "<p>x</p>" * 9
    page = f"<article>{rest}{part.format('Short text')}</article>"
    assert main_text(page) == f"{LONG * 9}{' x' * 9}"
    assert main_text(page.replace("Short text", LONG * 9)) == f"{LONG * 9}{' x' * 9} {LONG * 9} b"


def test_regions_are_the_text_of_pages_without_containers(monkeypatch):
    page = f"<body><div><a href=x>m</a></div><div><a href=y>n</a></div><p>{LONG}</p><p>{LONG}</p><div><a href=x>f</a></div><div><a href=z>g</a></div>"
    assert main_text(page) == f"{LONG} {LONG}"
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: ratios[::-1].max() - ratios)
    assert main_text(page) != f"{LONG} {LONG}"


@pytest.mark.parametrize("end", ["<!-- unclosed <p>Gamma", "<!DOCTYPE <p", "<? x <p", "<p class='x", "<!--" * 250_000, "</" * 100_000])
def test_what_the_end_cuts_off_is_no_text(end):
    began = time.process_time()
    assert main_text("<p>Alpha beta</p>" + end) == "Alpha beta"
    assert time.process_time() - began < 2


def test_dense_lines_beside_containers():
    assert main_text(f"<article><p>{LONG}</p></article><div>{LONG}</div><div><a href=x>{LONG}</a></div>") == f"{LONG} {LONG}"
    assert main_text(f"<article><p>{LONG}</p></article><div>short</div>") == LONG


@pytest.mark.parametrize("soup", ["<p>x</b></i>" * 80_000, "<div>" * 100_000 + "</b><h2>x</h2>" * 40_000, "<p><button>" + "<div>" * 80_000 + "<h2></h2>" * 50_000, "<b>" * 90_000 + "<div>" * 50_000 + "</b>" * 90_000, "<a href=x>" * 90_000])
def test_tag_soup_takes_no_walks(soup):
    began = time.process_time()
    main_text(soup)
    assert time.process_time() - began < 6


def test_extract_table(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    page = "<article><p>Hi&nbsp;there</p></article>"
    df = spark.createDataFrame([(1, "u", page, "clash", "c"), (1, None, page, None, None), (None, None, None, None, None)], schema)
    got = sorted(html_text.extract(df).collect(), key=str)
    assert [(r.page_id, r.text, r.n_chars) for r in got if r.page_id] == [(1, "Hi there", 8)] * 2
    assert [(r.text, r.n_chars) for r in got if not r.page_id] == [("", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_long_page_keeps_every_block():
    words = [f"w{i}" for i in range(50_000)]
    page = "<html><body><nav>x</nav><article>" + "".join(f"<p>{w}</p>" for w in words) + "</article></body></html>"
    assert main_text(page) == " ".join(words)


# 2


def brute_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        cut = np.cumsum(hit)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        out.append((len(b), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def cut_cases():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdéü ") for _ in range(rng.randint(3, 9)))
    base = [" ".join(word() for _ in range(rng.randint(50, 400))) for _ in range(25)]
    shared = base[0][100:620]
    more = [base[1][:300] + shared + base[2][:500], base[3][:700] + "!" + base[3][701:1400], shared, shared + shared, base[4] + base[4][:450], base[5], "a" * 1200, "ab" * 500 + "c" + "ab" * 450, base[6][:399], base[6][:400], None, "", "é" * 300]
    near = [base[7][: 30 * i] + "#" + base[7][30 * i + 1 :] for i in range(1, 20)]
    return base + more + near


@pytest.mark.parametrize("parameters", [{}, {"chunk": 1}, {"chunk": 3_000}, {"span": 100}])
def test_cut_equals_brute_force(spark, parameters):
    texts = cut_cases()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(documents(spark, texts), **parameters).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, 400)


def test_cut_in_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    data = cut_cases()[0].encode() * 3
    whole = {s: a for a, b, e in suffix_dedup.anchors(data) for s in range(b, e + 1)}
    monkeypatch.setattr(suffix_dedup, "BLOCK", 10**6)
    assert whole == {s: a for a, b, e in suffix_dedup.anchors(data) for s in range(b, e + 1)}
    assert sorted(whole) == list(range(len(data) - 399))


def test_cut_edges(spark):
    got = suffix_dedup.suffix_dedup(documents(spark, EDGES, EDGE_IDS), with_text=True).collect()
    assert len(got) == len(EDGES) and sum(r.n_removed for r in got) == 150_000 + 5000
    assert {bytes(r.kept) for r in got if r.doc_id == 9} == {b"dup"}
    assert suffix_dedup.suffix_dedup(documents(spark, [])).count() == 0


# 3


def check_packing(spark, texts, ids=None, window=4096):
    got = packing.pack(documents(spark, texts, ids), window=window).toPandas()
    e = tokens.encoder(tokens.tokenizer_file())
    full = [np.array([*e.whole(t or ""), 2], "<u4") for t in texts]
    want = Counter((ids[i] if ids else i, len(f)) for i, f in enumerate(full))
    assert got.length.sum() == sum(map(len, full)) and (got.length > 0).all()
    sizes = []
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        ends = (g.offset + g.length).tolist()
        assert g.offset.tolist() == [0, *ends[:-1]]
        sizes.append(ends[-1])
    assert max(sizes, default=0) <= window and all(s & (s - 1) == 0 for s in sizes)
    assert len(set(got.sequence_id)) == (got.sequence_id.max() + 1 if len(got) else 0)
    return got, full, want


def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta!", "ça", "12"]) for _ in range(rng.choice([3, 40, 700, 1000, 3000, 9000]))) for _ in range(60)] + [None, ""]
    got, full, _ = check_packing(spark, texts)
    for i, f in enumerate(full):
        g = got[got.doc_id == i].sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and set(g.doc_tokens) == {len(f)}
        assert all(zlib.crc32(f[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))


def test_packing_edges(spark):
    _, _, want = check_packing(spark, EDGES, EDGE_IDS, window=64)
    assert sum(want.values()) == len(EDGES)
    assert packing.pack(documents(spark, [])).count() == 0
    check_packing(spark, ["same text"] * 50, [1] * 50, window=16)


def test_least_squares_meets_a_packable_histogram():
    counts = np.zeros(65, int)
    counts[[10, 54, 20, 44, 16]] = [30, 30, 50, 50, 40]
    plan = packing.make_plan(counts, 64)
    assert len(plan.cuts) == 0 and plan.full_end == 0 and plan.sequences == 30 + 50 + 10


def test_least_squares_is_optimal():
    rng = np.random.default_rng(0)
    rows = packing.combinations(np.where(rng.random(65) < 0.3, 9, 0), 64)
    target = rng.integers(0, 20, 65).astype(float)
    x = packing.nnls(rows, target, 4000)
    a = np.zeros((65, len(rows)))
    for j, r in enumerate(rows):
        for z in r[r > 0]:
            a[z, j] += 1
    slope = a.T @ (a @ x - target)
    assert (x >= 0).all() and slope.min() > -1e-3 and np.abs(slope * x).max() < 1e-2


# 4


def prose(rng, toxic=False):
    words = [rng.choice("the of and to stone river walks under light morning because people carry water slowly".split()) for _ in range(rng.randint(40, 200))]
    if toxic:
        for _ in range(4):
            words[rng.randrange(len(words))] = rng.choice(["zorgling", "zorgface", "zorgbrain"])
    return " ".join(words) + "."


def junk(rng):
    return rng.choice([" | ".join(rng.choice("home news shop login".split()) for _ in range(60)), " ".join("buy%%% now***" for _ in range(50)), "spam " * 120])


def corpus(seed, n=400):
    rng = random.Random(seed)
    kinds = [rng.choice(["fine", "fine", "fine", "toxic", "junk"]) for _ in range(n)]
    return kinds, [prose(rng) if k == "fine" else prose(rng, True) if k == "toxic" else junk(rng) for k in kinds]


def test_classifier_held_out(spark):
    kinds, texts = corpus(1)
    labels = spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kinds) if i % 2], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(documents(spark, texts), labels).collect()}
    held = [i for i in range(len(kinds)) if i % 2 == 0]
    assert sum(got[i].kept != (kinds[i] == "fine") for i in held) <= 0.02 * len(held)
    again = {r.doc_id: r for r in quality.classify(documents(spark, texts), labels).collect()}
    assert again == got


def test_votes_and_scores_equal_plain_loops(spark):
    """Votes are counted over all documents of all tasks, and rows are scored as the model scores their texts."""
    kinds, texts = corpus(3, 150)
    df = documents(spark, texts).repartition(5)
    terms, insults = {quality.term_features("zorgface")[0]}, {quality.term_features("river")[0]}
    rows = df.select(F.lit(None).cast("int").alias("toxic"), "text").mapInArrow(quality._vote_counter(terms, set(), insults), "kind string, pattern string, n bigint")
    got = {(r.kind, r.pattern): r.n for r in rows.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()}
    want = Counter(("q", ",".join(map(str, quality.quality_votes(quality.measures(t))))) for t in texts)
    for t in texts:
        words = set(t.lower().replace(".", " ").split())
        want["t", f"{int('zorgface' in words)},0,{1 if 'river' in words else -1},-1"] += 1
    assert got == want
    labels = spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kinds)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(documents(spark, texts), labels)
    scored = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in quality.classify(documents(spark, texts), labels).collect()}
    assert scored == {i: model.score(t) for i, t in enumerate(texts)}


def test_batches_read_like_single_texts():
    rng = random.Random(6)
    signs = ["a", "Bc", "é", "|", "•", "..", "!!x", "1", "_", " ", "  ", "\t", "\n", "\xa0", "\x1c", "x%%", "y## ", "z$$$ "]
    texts = ["", " ", "a", "ab..", "..", "a%% b", "\n\n"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    array = pa.array(["zz", *texts, "zz"])[1:-1]
    assert quality.Read(array).measures == [quality.measures(t) for t in texts]
    names = {x for t in texts for x in quality.quality_features(*quality.measured(t))}
    weights = {quality.hashed(x): rng.uniform(-1, 1) for x in sorted(names)}
    words = sorted({f for t in texts for w in quality.words_of(t) for f in quality.term_features(w)})
    model = quality.Model((0.1, weights), (-0.2, {f: rng.uniform(-1, 1) for f in words[::2]}), {})
    assert list(zip(*quality.BatchScorer(model)(array))) == [model.score(t) for t in texts]


def test_models_of_equal_size_are_told_apart():
    one, two = (quality.Model((-1.0, {1: w}), (-1.0, {2: w}), {}) for w in (0.5, 0.7))
    assert one.key != two.key and quality._cached(one) is not quality._cached(two)


def test_quality_features_are_of_the_text():
    """Texts on which every labeller votes alike still differ in their features."""
    a, b = "the river walks under light and water " * 8, "the ri4er wa!ks under light and water " * 8
    assert quality.quality_votes(quality.measures(a)) == quality.quality_votes(quality.measures(b))
    assert set(quality.quality_features(*quality.measured(a))) != set(quality.quality_features(*quality.measured(b)))


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.classify(documents(spark, EDGES, EDGE_IDS), none).collect()
    assert len(got) == len(EDGES) and all(0 <= r.p_low_quality <= 1 for r in got)
    assert quality.classify(documents(spark, []), none).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (5, 1, None), (5, 0, 1)], "doc_id bigint, quality int, toxic int")
    kept = quality.keep_good(documents(spark, EDGES, EDGE_IDS), odd)
    assert kept.columns == documents(spark, EDGES).columns and kept.where("text IS NULL").count() == 0


def test_sample_is_of_labelled_documents(spark):
    base = spark.createDataFrame([(i, "t") for i in [*range(100), 3, None]], "id bigint, text string")
    ids = spark.createDataFrame([(i, i % 2) for i in [*range(60), *range(1000, 4000)]], "id bigint, toxic int")
    pick = lambda **p: dict(quality.sample_of(base, ids, **p))
    assert pick(sample=50, fill=10).keys() < set(range(60)) and len(pick(sample=50, fill=10)) == 50
    assert pick(fill=10) == {i: i % 2 for i in range(60)}
    more = pick(fill=80)
    assert len(more) == 80 and {i for i, t in more.items() if t is None} < set(range(60, 100))
    assert pick() == {i: i % 2 if i < 60 else None for i in range(100)} and len(pick(sample=70)) == 70


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    rates = [0.95, 0.8, 0.7]
    votes = [tuple(int(t if rng.random() < r else not t) for r in rates) for t in truth]
    prior, tab = quality.fit_votes(Counter(votes))
    assert abs(prior - 0.3) < 0.05
    assert [round(float(tab[k, 1, 2]), 1) for k in range(3)] == [round(r, 1) for r in [0.95, 0.8, 0.7]] or np.abs(tab[:, 1, 2] - rates).max() < 0.06


# 8


def test_counts_equal_the_library(spark):
    e = tokens.encoder(tokens.tokenizer_file())
    texts = EDGES + ["it's Don't I'LL a_b x's'", "Straße İstanbul ΣΑΣ.", "1a2 .'s", "日本 語😀", "a\x85b\xa0c", "<|startoftext|><|ENDOFTEXT|>", "é é"]
    got = tokens.count_tokens(documents(spark, texts, [None if i == 4 else i for i in range(len(texts))]), limit=100)
    by_text = Counter((len((t or "").encode()), len(e.whole(t or "")), len(e.whole(t or "")) > 100) for t in texts)
    assert Counter((r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == by_text
    assert tokens.count_tokens(documents(spark, [])).count() == 0


def test_plain_texts_are_encoded_together():
    """Words of plain texts are merged once each, and no text goes to the library whole; ids are the library's, beside other texts and when a worker starts anew."""
    path, rng = tokens.tokenizer_file(), random.Random(4)
    letters = "aabcdeXYZßÀéÖöøØÿÞ01-/_{~!\"\t\n\r \x85\xa0  "
    plain = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["", " ", "a", "\n-\n", "A" * 5_000, "9" * 300]
    e = tokens.Encoder(path)
    want = {t: np.array(e.whole(t), "<u4").tobytes() for t in plain}
    merge, merged = e.merge, []
    e.whole, e.merge = None, lambda word: merged.append(word) or merge(word)
    e.known.clear()
    assert e.all(plain) == [want[t] for t in plain] and e.all(plain[::-1]) == [want[t] for t in plain[::-1]]
    assert len(merged) == len(set(merged)) > 1_000
    e = tokens.Encoder(path)
    mixed = plain + ["\0", "a\0b", "it's", "日本 語", "a\x1cb", "<|startoftext|> x", "× ÷ µ", "e\u0301"]
    rng.shuffle(mixed)
    try:
        tokens.MOST_WORDS, most = 50, tokens.MOST_WORDS
        assert [x for i in range(0, len(mixed), 7) for x in e.all(mixed[i : i + 7])] == [np.array(e.whole(t), "<u4").tobytes() for t in mixed]
    finally:
        tokens.MOST_WORDS = most
    assert e.all([]) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name):
    e = tokens.encoder(tokens.tokenizer_file(name))
    texts = ["  two  blanks ", "x\n\ny", "", "été"]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(documents(spark, texts), name).collect()}
    assert got == {i: len(e.whole(t)) for i, t in enumerate(texts)}


def test_cache_is_used_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = documents(spark, ["one two", "one two", "three"])
    tokens.count_tokens(first, cache=cache).count()
    assert spark.read.parquet(cache).count() == 2
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("bigint")).write.parquet(str(tmp_path / "other"))
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(documents(spark, ["one two", "four"]), cache=str(tmp_path / "other")).collect()}
    assert got == {0: 77, 1: 1} and spark.read.parquet(str(tmp_path / "other")).count() == 3
