"""The nearest-neighbour index against all products."""

import numpy as np
import pytest

from litscout.operators import cells, vectors


def brute(q, lib, k):
    out = []
    for i, v in q:
        scored = sorted((-round(float(np.dot(v, w)), 9), key) for key, w in lib)[:k]
        out += [(i, key, rank) for rank, (_, key) in enumerate(scored, 1)]
    return sorted(out)


def clustered(seed, n, centres=12, spread=0.02, dims=16):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, dims))
    return [(f"{seed}-{i:05d}", (middle[rng.integers(centres)] + rng.normal(size=dims) * spread).round(3)) for i in range(n)]


def frame(spark, rows, names):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], f"{names} string, v array<double>").repartition(5)


@pytest.mark.parametrize("k, spread, block", [(1, 0.02, 50_000), (7, 0.05, 20), (30, 2.0, 50_000)])
def test_cells_give_what_all_products_give(spark, monkeypatch, tmp_path, k, spread, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    lib, asked = clustered(1, 300, spread=spread), clustered(2, 60, spread=spread)
    lib += [("same1", lib[0][1]), ("same0", lib[0][1]), ("far", np.full(16, 40.0)), ("zero", np.zeros(16))]
    asked += [("q zero", np.zeros(16)), ("q lib", lib[0][1])]
    cells.build(frame(spark, lib, "key")).save(str(tmp_path / "index"))
    index = cells.Cells.load(spark, str(tmp_path / "index"))
    got, _ = cells.search(frame(spark, asked, "id"), index, k)
    assert sorted((r.id, r.key, r["rank"]) for r in got.collect()) == brute(asked, lib, k)


def test_few_products_on_clustered_vectors(spark):
    lib, asked = clustered(3, 3_000, 40), clustered(4, 500, 40)
    index = cells.build(frame(spark, lib, "key"))
    got, looked = cells.search(frame(spark, asked, "id"), index, 5)
    assert got.count() == 2_500
    assert cells.products(looked, index) < 0.2 * 3_000 * 500


def test_an_index_of_nothing(spark, tmp_path):
    index = cells.build(frame(spark, [], "key"))
    assert cells.search(frame(spark, clustered(1, 3), "id"), index)[0].count() == 0
    index.save(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        cells.Cells.load(spark, str(tmp_path / "none"))


def test_centroid_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([3.0, None, 5.0],), ([],)], "embedding array<float>").repartition(3)
    want = np.array([2.0, 2.0, 5.0])
    assert vectors.centroid(df).first()[0] == pytest.approx((want / np.linalg.norm(want)).tolist())
    assert vectors.centroid(df.where("false")).first()[0] == []


def test_a_query_is_sent_to_a_bounded_number_of_groups(spark, monkeypatch):
    """On vectors without clusters every cell is looked at; a query is still sent to the groups alone, not to each cell."""
    monkeypatch.setattr(cells, "GROUPS", 4)
    lib = clustered(5, 2_500, spread=3.0, dims=32)
    index = cells.build(frame(spark, lib, "key"))
    got, looked = cells.search(frame(spark, lib[:200], "id"), index, 3)
    assert sorted((r.id, r.key, r["rank"]) for r in got.collect()) == brute(lib[:200], lib, 3)
    assert len(index.number) > 30 and cells.products(looked, index) > 0.5 * 200 * 2_500
    assert max(len(r.parts) for r in looked[1].collect()) <= 4
    assert sum(len(r.parts) for d in looked for r in d.collect()) < 6 * 200


def test_best_above_a_floor():
    rng = np.random.default_rng(6)
    x, y = rng.integers(-3, 4, (600, 6)), rng.integers(-3, 4, (9_000, 6))
    score = x @ y.T
    floor = np.sort(score, axis=1)[:, -5].astype(float)
    for k in (1, 4, 9):
        want = [(i, j, score[i, j]) for i in range(len(x)) for j in np.lexsort((np.arange(len(y)), -score[i]))[:k] if score[i, j] >= floor[i]]
        assert [t for part in vectors.best(x, y, k, floor) for t in zip(*(p.tolist() for p in part))] == want
