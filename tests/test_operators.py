import numpy as np
import pytest

from provq.functions import names, vectors
from provq.operators import evaluate, graph, matching, results, scoring, search

F = pytest.importorskip("pyspark.sql.functions")


def vecs(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} bigint, v array<double>")


@pytest.fixture(scope="module")
def unit_vectors():
    x = np.random.default_rng(1).normal(size=(300, 16))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_knn_blocks_and_cells_equal_brute_force(spark, unit_vectors, monkeypatch):
    x = unit_vectors
    monkeypatch.setattr(search, "BASE_BLOCK", 70)
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    q, b = vecs(spark, x[:20], "q"), vecs(spark, x, "feature_id")
    d = np.maximum(np.round(2 - 2 * x[:20] @ x.T, 9), 0)
    want = {(i, int(j), k + 1) for i in range(20) for k, j in enumerate(np.lexsort((np.arange(300), d[i]))[:7])}
    key = lambda df: {(r["q"], r["feature_id"], r["rank"]) for r in df.collect()}
    assert key(search.exact_knn(q, b, 7)) == want
    centres = x[:12].tolist()
    assert key(search.ivf_knn(q, b, centres, 7, nprobe=12)) == want
    assert key(search.fuse([search.exact_knn(q, b.filter("feature_id % 2 = 0"), 7), search.exact_knn(q, b.filter("feature_id % 2 = 1"), 7)]).filter("rank <= 7")) == want


def test_knn_empty(spark, unit_vectors):
    b = vecs(spark, unit_vectors, "feature_id")
    assert search.exact_knn(vecs(spark, unit_vectors[:0], "q"), b, 3).count() == 0
    assert search.exact_knn(vecs(spark, unit_vectors[:2], "q"), b.limit(0), 3).count() == 0
    assert search.exact_knn(vecs(spark, unit_vectors[:2], "q"), b.limit(2), 3).count() == 4


def test_trained_cells_projection_and_codes(spark, unit_vectors):
    b = vecs(spark, unit_vectors, "feature_id")
    cells = search.train_cells(b, 4)
    assert len(cells) == 4 and search.assign_cells(b, cells).groupBy("cell").count().count() == 4
    coded = search.product_codes(b, [unit_vectors[:5, :8].tolist(), unit_vectors[:5, 8:].tolist()]).filter("feature_id < 5").collect()
    assert all(r["pq"] == [r["feature_id"]] * 2 for r in coded)


def hit(probe=1, q=0, f=0, image=7, dist=0.0, rank=1, qx=0.0, qy=0.0, x=0.0, y=0.0, w=640, h=480):
    return dict(probe_id=probe, q_feature=q, feature_id=f, image_id=image, dist=float(dist), rank=rank, qx=float(qx), qy=float(qy), q_size=1.0, q_angle=0.0, x=float(x), y=float(y), size=1.0, angle=0.0, width=w, height=h)


def test_grid_bins(spark):
    size = 57
    got = spark.createDataFrame([(float(v),) for v in (-57, -56.9, -0.1, 0, 56.9, 57)], "v double").select(vectors.grid_bin(F.col("v"), F.lit(size)).alias("b")).collect()
    assert [r["b"] for r in got] == [-2, -1, -1, 0, 0, 1]
    sizes = spark.createDataFrame([(640, 480), (1, 1), (100_000, 3)], "w int, h int").select(vectors.bin_size(F.col("w"), F.col("h"), 4, 0.8).alias("s")).collect()
    assert [r["s"] for r in sizes] == [57, 5, 250]


def test_geometric_score(spark):
    one = spark.createDataFrame([hit()])
    r = scoring.geometric_score(one).collect()[0]
    assert (r["n"], r["score"]) == (1, 0)  # log2(1)
    two = spark.createDataFrame([hit(q=0, f=0, qx=0, x=100, y=100), hit(q=1, f=1, qx=10, x=110, y=100)])
    r = scoring.geometric_score(two).collect()[0]
    assert r["n"] == 2 and abs(r["score"] - 2.0) < 1e-9  # both votes meet in one point: 2 * 1 * log2(2)
    # one query feature twice in a bin keeps its best rank; one database feature twice keeps the smaller query feature
    dup = spark.createDataFrame([hit(q=0, f=0, rank=2), hit(q=0, f=1, rank=1)])
    assert {r["n"] for r in scoring.hough_bins(dup).collect()} == {1}
    back = spark.createDataFrame([hit(q=0, f=0), hit(q=1, f=0)])
    assert {(r["q_feature"]) for r in scoring.voted_bins(back).collect()} == {0}


def test_merges(spark):
    r = spark.createDataFrame([("p", "a", 1.0, 1), ("p", "a", 0.5, 2), ("p", "b", float("nan"), 1), ("p", None, 3.0, 1), ("p", "c", 0.25, 1)], "p string, f string, s double, t int")
    assert {tuple(x) for x in results.merge_max(r, "p", "f", "s").collect()} == {("p", "a", 1.0), ("p", "c", 0.25)}
    assert {tuple(x) for x in results.merge_last(r, "p", "f", "s", "t").collect()} == {("p", "a", 0.5), ("p", "c", 0.25)}
    m = results.merge_max(r, "p", "f", "s")
    twice = m.unionByName(m)
    assert sorted(results.merge_max(twice, "p", "f", "score").collect()) == sorted(m.collect())
    assert {tuple(x) for x in results.min_max(m, "p").collect()} == {("p", "a", 1.0), ("p", "c", 0.0)}
    assert [x["f"] for x in results.without(m, spark.createDataFrame([("a",)], "f string"), "f").collect()] == ["c"]


def test_recall_of_empty_truth(spark):
    res = spark.createDataFrame([("p", "a", 1)], "probe_id string, file string, rank int")
    truth = spark.createDataFrame([], "probe_id string, file string")
    assert evaluate.recall_at(res, truth).count() == 0
    truth = spark.createDataFrame([("p", "a"), ("p", "b")], "probe_id string, file string")
    assert {r["recall"] for r in evaluate.recall_at(res, truth).collect()} == {0.5}


def test_graph_edges(spark):
    links = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (3, 3, 1.0), (4, None, 1.0), (5, 6, float("nan"))], "s bigint, t bigint, w double")
    e = graph.affinity(links, "s", "t", "w")
    assert [tuple(r) for r in e.collect()] == [(1, 2, 0.7)]
    assert graph.remove_top_degree(e, 5).count() == 1
    start = graph.flow_start(e)
    for m in (start, graph.flow_step(start)):
        assert all(abs(r["s"] - 1) < 1e-9 for r in m.groupBy("j").agg(F.sum("m").alias("s")).collect())


def test_markov_clusters(spark):
    pairs = [(a, b, 1.0) for g in ((1, 2, 3, 4), (10, 11, 12)) for a in g for b in g if a < b]
    got = graph.markov_clusters(spark.createDataFrame(pairs, "a bigint, b bigint, weight double")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [10, 11, 12]]


def test_chains_and_inliers(spark):
    p = spark.createDataFrame([(1, 0, 1, 9, 0.5, 0.1), (1, 1, 2, 8, 0.1, 0.5), (1, 0, 2, 5, 0.1, 0.1), (1, 3, 4, 9, 1.0, 0.0)], "probe_id bigint, i bigint, j bigint, kp_count int, mi_ij double, mi_ji double")
    assert {tuple(r) for r in graph.grow_chains(p).collect()} == {(1, 0, 1), (1, 2, 1)}
    m = [hit(q=i, f=i, dist=0.1 * i, qx=10 * i, qy=3 * i, x=10 * i + 50, y=3 * i + 20) for i in range(6)] + [hit(q=9, f=9, dist=0.01, x=900)]
    assert {r["q_feature"] for r in matching.consistent_inliers(spark.createDataFrame(m)).collect()} == set(range(6))


def test_names(spark):
    t = spark.createDataFrame([("a/b.c.JPG",), ("x.nef",), ("plain",)], "p string")
    r = t.select(names.first_stem(F.col("p")).alias("f"), names.last_stem(F.col("p")).alias("l"), names.extension(F.col("p")).alias("e"), names.is_image(F.col("p")).alias("i"), names.is_raw(F.col("p")).alias("w"), names.mimetype(F.col("p")).alias("m")).collect()
    assert [tuple(x) for x in r] == [("b", "b.c", "jpg", True, False, "image/jpeg"), ("x", "x", "nef", True, True, "application/octet-stream"), ("plain", "plain", "", False, False, "application/octet-stream")]
    s = spark.createDataFrame([("OPQ8_32,IVF256,PQ8",), ("IVF16,Flat",)], "s string").select(names.index_spec(F.col("s")).alias("x")).collect()
    assert [tuple(r["x"]) for r in s] == [("OPQ8_32,", 256, "PQ8"), ("", 16, "Flat")]
