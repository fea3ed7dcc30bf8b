"""Work that grew beyond memory, disk or time: the same results by plans that don't."""

import numpy as np
import pytest

from provq.operators import evaluate, graph, index, matching, pairs, search


@pytest.fixture(scope="module")
def paired(spark):
    """A probe with many features, one with few, images of one to six features, and one larger than a part, with copies among them."""
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[450:500] = x[:50]
    x[600:610] = x[640:650]
    image = np.r_[np.zeros(330), np.ones(20), 2 + np.sort(r.integers(0, 80, 300)), np.full(50, 99)].astype(int)
    rows = spark.createDataFrame([(int(i), k, v.tolist()) for k, (i, v) in enumerate(zip(image, x))], "image_id bigint, feature_id bigint, v array<double>").cache()
    asked = rows.filter("image_id < 2").selectExpr("image_id as probe_id", "feature_id as q_feature", "v")
    both = spark.createDataFrame([(p, int(i)) for p in (0, 1) for i in np.unique(image) if i != p and (i + p) % 7], "probe_id bigint, image_id bigint")
    return both, asked, rows


def rows_of(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_share_means_leave_no_nearest_rows_of_whole_images(spark, paired, monkeypatch):
    monkeypatch.setattr(search, "PAIR_BLOCK", 40)
    want = rows_of(matching.cumulative_share_mean(search.pair_nearest(*paired, 1)))
    asked = []
    near = search.pair_nearest
    monkeypatch.setattr(search, "pair_nearest", lambda p, q, b, n: asked.append(b) or near(p, q, b, n))
    assert rows_of(pairs.share_means(*paired)) == want and len(want) > 100
    assert {r["image_id"] for b in asked for r in b.select("image_id").distinct().collect()} == {0, 99}


def test_close_pairs_are_all_pairs(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 64))
    x = np.repeat(x, 10, axis=0) + 0.35 * r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "feature_id bigint, v array<double>")
    got = {(r["q"], r["feature_id"]): r["dist"] for r in search.close_pairs(rows.filter("feature_id < 100").withColumnRenamed("feature_id", "q"), rows, 0.5).collect()}
    d = np.sqrt(((x[:100, None] - x[None]) ** 2).sum(2))
    assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(d < 0.5)))) and len(got) > 120
    assert all(abs(d[p] - v) < 1e-8 for p, v in got.items())


def test_levels_of_small_trees_take_no_rounds(spark, monkeypatch):
    chain = [("down", 1, i, i + 1) for i in range(300)] + [("up", 2, i, (i * 7 + 1) % 50) for i in range(50)] + [("down", 3, 1, 2)]
    links = spark.createDataFrame(chain, "kind string, tree bigint, a bigint, b bigint")
    starts = spark.createDataFrame([("down", 1, 0), ("up", 2, 0), ("down", 4, 9)], "kind string, tree bigint, node bigint")
    rounds = []
    by_rounds = graph._levels_by_rounds
    monkeypatch.setattr(graph, "_levels_by_rounds", lambda *a: rounds.append(1) or by_rounds(*a))
    got = rows_of(graph.directed_levels(links, starts))
    assert not rounds and [r for r in got if r[1] == 1] == [("down", 1, i, i) for i in range(301)] and ("down", 4, 9, 0) in got and not [r for r in got if r[1] == 3]
    short = links.filter("tree > 1 or a < 12")
    want = rows_of(graph.directed_levels(short, starts))
    monkeypatch.setattr(graph, "TREE_LINKS", 20)
    assert rows_of(graph.directed_levels(short, starts)) == want and rounds


@pytest.mark.parametrize("most,single", [(0.95, True), (0.8, False)])
def test_ratio_matches_leave_no_nearest_rows_of_whole_images(spark, paired, monkeypatch, most, single):
    monkeypatch.setattr(search, "PAIR_BLOCK", 40)
    want = matching.ratio_test(search.pair_nearest(*paired, 2), most)
    want = rows_of(matching.one_to_one(want) if single else want)
    assert rows_of(pairs.ratio_matches(*paired, most, single=single)) == want and len(want) > 50


def test_sweep_takes_one_pass(spark, paired, monkeypatch):
    q, b = paired[1].selectExpr("q_feature as q", "v").filter("q < 60"), paired[2].select("feature_id", "v")
    cells = [r["v"] for r in b.orderBy("feature_id").limit(9).collect()]
    exact = search.exact_knn(q, b, 5)
    want = sorted((n, *evaluate.intersection_at(search.ivf_knn(q, b, cells, 5, nprobe=n), exact, 5).select("n_queries", "share").first()) for n in (1, 3, 9))
    for f in ("exact_knn", "ivf_knn"):
        monkeypatch.delattr(search, f)
    assert sorted(map(tuple, evaluate.sweep(q, b, cells, 5, (1, 3, 9)).collect())) == want and want[0][2] < 1 == want[2][2]


def test_codes_are_not_copied_for_each_few_queries(spark):
    r = np.random.default_rng(6)
    x, words = r.normal(size=(3_000, 8)), r.normal(size=(2, 4, 4))
    x[2_500:] = x[:500]
    fixed = index.Index(None, np.zeros((1, 8)), words)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "feature_id bigint, v array<double>")
    got = index.search(fixed, rows.filter("feature_id < 2200").withColumnRenamed("feature_id", "q"), index.encode(fixed, rows), 5)
    found = sorted((r["q"], r["rank"], r["feature_id"]) for r in got.collect())
    t = np.round(((x.reshape(-1, 2, 1, 4) - words[None]) ** 2).sum(3), 9)
    code = t.argmin(2)
    d = np.round(t[:2_200, 0][:, code[:, 0]] + t[:2_200, 1][:, code[:, 1]], 9)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert found == [(q, k + 1, int(f)) for q, fs in enumerate(near) for k, f in enumerate(fs)]
    assert index.QUERY_BLOCK >= 16_384


def test_exact_search_copies_neither_side(spark, paired):
    top = search.exact_knn(paired[1].selectExpr("q_feature as q", "v"), paired[2].select("feature_id", "v"), 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan
