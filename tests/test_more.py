"""Numbering, spaced points, fits, the workspace, and functions that no query reaches, against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from provq import runtime
from provq.operators import evaluate, graph, matching, ranges, results, search
from provq.sinks import formats as sinks
from provq.sources import formats as sources


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("row"))
    got = ranges.numbered(df.repartition(7), "k").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["row_no"])] == list(range(1000)) and {r["row_no"] for r in got} == set(range(1000))
    assert ranges.numbered(df.limit(0), "k").count() == 0
    total = {r["k"]: r["so_far"] for r in ranges.running_total(df.select("k"), "k", "k").collect()}
    assert total == {k: k * (k + 1) // 2 for k in range(1000)}


def test_contiguous_ranges_cover_all(spark):
    got = spark.range(10).select(ranges.range_of(F.col("id"), 10, 4).alias("r"), ranges.batch_of(F.col("id"), 4).alias("b")).collect()
    assert [r["r"] for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3] and [r["b"] for r in got] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_spaced_points_are_those_of_going_one_by_one(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(g), i, float(x), float(y), float(s)) for i, (g, x, y, s) in enumerate(zip(r.integers(0, 2, 120), r.uniform(0, 200, 120), r.uniform(0, 200, 120), r.integers(0, 9, 120)))]
    want = set()
    for g in (0, 1):
        taken = []
        for _, i, x, y, s in sorted((p for p in rows if p[0] == g), key=lambda p: (-p[4], p[1])):
            if all((x - a) ** 2 + (y - b) ** 2 > 900 for a, b in taken):
                taken.append((x, y))
                want.add((g, i))
    got = matching.spaced_points(spark.createDataFrame(rows, "group_id bigint, id bigint, x double, y double, score double"), 30.0)
    assert {(p["group_id"], p["id"]) for p in got.collect()} == want


def test_affine_fit(spark):
    r = np.random.default_rng(3)
    q = r.uniform(0, 100, (40, 2))
    t = q @ np.array([[0.9, -0.2], [0.3, 1.1]]).T + np.array([5, -7])
    rows = [(1, 1, *map(float, a), *map(float, b)) for a, b in zip(q, t)] + [(1, 2, float(i), float(i), 1.0, 1.0) for i in range(5)] + [(1, 3, 0.0, 0.0, 0.0, 0.0)]
    got = {p["image_id"]: p for p in matching.affine_fit(spark.createDataFrame(rows, "probe_id bigint, image_id bigint, qx double, qy double, x double, y double")).collect()}
    assert np.allclose([got[1][c] for c in ("a11", "a12", "a13", "a21", "a22", "a23")], [0.9, -0.2, 5, 0.3, 1.1, -7], atol=1e-6) and got[1]["rcond"] > 0
    assert got[2]["rcond"] == 0 and got[2]["a11"] is None and 3 not in got


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Nothing:
        master, applicationId = "spark://host:7077", "x"

        def get(self, *_):
            return None

        isDefined = lambda self: False
        getConf = sc = getCheckpointDir = lambda self: self

    context = Nothing()
    context._jsc = context.conf = context.sparkContext = context
    with pytest.raises(RuntimeError):
        runtime.shared_base(context)
    context.master = "local[2]"
    assert runtime.shared_base(context).startswith("file://")


def test_markov_clusters_of_united_attractors(spark):
    e = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (10, 11, 1.0), (20, 21, 1.0), (21, 22, 1.0), (22, 23, 1.0), (20, 23, 1.0)]
    got = {r["node"]: r["cluster"] for r in graph.markov_clusters(spark.createDataFrame(e, "a bigint, b bigint, weight double")).collect()}
    assert {v: got[v] for v in (0, 1, 2)} == {0: 0, 1: 0, 2: 0} and got[10] == got[11] == 10 and len({got[v] for v in (20, 21, 22, 23)}) <= 2


def test_roles_on_a_cycle_and_a_chain(spark):
    n = spark.createDataFrame([(1, i) for i in range(6)], "tree bigint, node bigint")
    k = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 4), (1, 4, 3), (1, 5, 5)], "tree bigint, parent bigint, child bigint")
    got = {r["node"]: r for r in graph.node_roles(n, k).collect()}
    assert (got[1]["from_root"], got[1]["from_leaf"], got[1]["penalty"]) == (1, 1, 3) and got[3]["from_root"] is None and got[5]["is_root"] and got[5]["is_leaf"]
    paths = {tuple(r["path"]) for r in graph.paths_to_leaves(n, k).collect()}
    assert paths == {(0, 1, 2)} or paths == {(0, 1, 2), (5,)}


def test_functions_that_no_query_reaches(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(60, 8))
    base = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "feature_id bigint, v array<double>")
    cells = search.train_cells(base, 3)
    half = [search.assign_cells(base.filter(F.col("feature_id") % 2 == s), cells).drop("cell_rank") for s in (0, 1)]
    for s, h in enumerate(half):
        search.keep_index(h, str(tmp_path / f"s{s}"))
    search.merge_indexes(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")], str(tmp_path / "m"))
    assert {r["feature_id"] for r in spark.read.parquet(str(tmp_path / "m")).collect()} == set(range(60))
    assert len(search.train_projection(base, 3).pc.toArray()[0]) == 3
    pairs = spark.createDataFrame([(1, 0, 1, 12, 0.5, 0.3, 0.2), (1, 0, 2, 12, 0.5, 0.9, 0.0), (1, 1, 2, 5, 0.5, 0.4, 0.4)], "probe_id bigint, i bigint, j bigint, kp_count bigint, avg_dist double, mi_ij double, mi_ji double")
    best = {r["node"]: (r["best"], r["outward"]) for r in graph.strongest_links(pairs).collect()}
    assert best == {0: (2, True), 1: (0, False), 2: (0, False)}
    rows = spark.createDataFrame([("g", 1.0, 3.0), ("g", 2.0, 2.0)], "g string, a double, b double")
    assert evaluate.mean_squared_error(rows, "g", "a", "b").first()["mse"] == 2.0
    names = spark.createDataFrame([("a", "A")], "item string, name string")
    other = spark.createDataFrame([("a", "X"), ("b", "B")], "item string, name string")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    assert {r["item"] for r in results.remapped(items, names, other, "item").collect()} == {"A", "B", "c"}
    envelope = spark.range(1).select(F.to_json(results.envelope("My Search", "1", n=F.lit(3))).alias("j")).first()["j"]
    assert json.loads(envelope) == {"algorithm": {"name": "MySearch", "version": "1"}, "n": 3}
    assert [r["item"] for r in sources.skip_first(items, 1, "item").collect()] == ["b", "c"]
    assert [r["item"] for r in sinks.new_rows(items, names, "item").orderBy("item").collect()] == ["b", "c"]


def test_clusters_are_numbered_from_the_largest_and_written_apart(spark, tmp_path):
    rows = spark.createDataFrame([(5, "a"), (9, "b"), (9, "c"), (2, "d"), (2, "e")], "cluster bigint, member string")
    sinks.cluster_folder(rows, "Markov", str(tmp_path / "c"))
    back = {(r["name"], r["member"]) for r in spark.read.json(str(tmp_path / "c")).collect()}
    assert back == {("cluster001_size2_algorithm_Markov.json", "d"), ("cluster001_size2_algorithm_Markov.json", "e"), ("cluster002_size2_algorithm_Markov.json", "b"), ("cluster002_size2_algorithm_Markov.json", "c"), ("cluster003_size1_algorithm_Markov.json", "a")}


def test_result_tree_and_progress(spark, tmp_path):
    docs = spark.createDataFrame([("p1", "{}"), ("p2", "[]")], "probe string, document string")
    sinks.result_tree(docs, "probe", str(tmp_path / "r"))
    assert {(r["probe"], r["value"]) for r in spark.read.text(str(tmp_path / "r")).collect()} == {("p1", "{}"), ("p2", "[]")}
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert {(r["state"], r["n"]) for r in sinks.progress(ids("a", "b"), ids("b", "c"), ids("a", "b", "c", "d"), "k").collect()} == {("completed", 2), ("unable", 1), ("remaining", 1)}


def test_provenance_graph_follows_the_rules(spark):
    """A chain 3-1-0-2 grown at both ends, and a branch from 1 to 4; node 5 has too few matches."""
    rows = [(0, 1, 30, 0.4, 0.1), (0, 2, 20, 0.1, 0.3), (1, 3, 28, 0.5, 0.2), (1, 4, 9, 0.2, 0.6), (2, 5, 3, 0.9, 0.9)]
    p = spark.createDataFrame([(7, i, j, kp, 0.05, f, b) for i, j, kp, f, b in rows], "probe_id bigint, i bigint, j bigint, kp_count bigint, avg_dist double, mi_ij double, mi_ji double")
    got = {(r["source"], r["target"]) for r in graph.provenance_graph(p).collect()}
    # outward votes: 0->1 (1.5), 1->3 (1); of the next, 0-2 points inward, but the majority holds for the whole chain, if the third image is alike
    assert (0, 1) in got and (1, 3) in got and (4, 1) in got
    assert {frozenset(e) for e in got} == {frozenset(e) for e in ((0, 1), (1, 3), (0, 2), (1, 4))}


def test_related_pairs(spark):
    rows = [(1, 1, float(i), 0.0) for i in range(10)] + [(1, 2, float(50 * i), 0.0) for i in range(5)] + [(1, 3, float(i), 1.0) for i in range(4)] + [(1, 4, 0.0, 0.0)] * 3
    df = spark.createDataFrame([(*r, 640, 480) for r in rows], "probe_id bigint, image_id bigint, qx double, qy double, width int, height int")
    assert {(r["image_id"], r["n"]) for r in matching.related_pairs(df).collect()} == {(1, 10), (3, 4)}


def test_region_and_condition(spark):
    r = spark.createDataFrame([(200, 200, 100, 100), (110, 200, 100, 100), (120, 120, 100, 100)], "w int, h int, iw int, ih int")
    assert [x[0] for x in r.select(matching.region_differs(*(F.col(c) for c in ("w", "h", "iw", "ih")))).collect()] == [True, False, False]
    f = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.05), (1, 3, 0.7)], "probe_id bigint, image_id bigint, rcond double")
    assert {(x["image_id"], x["rank"]) for x in matching.well_conditioned(f).collect()} == {(3, 1), (1, 2)}


def test_listings_references_and_slices(spark, tmp_path):
    for name in ("a/x.npy", "a/.h.npy", "b/y.npy", "b/thumb/z.npy", "b/n.txt"):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(b"1")
    got = lambda ext: sorted(r["path"].rpartition("/")[2] for r in sources.feature_list(spark, [str(tmp_path / "f")], ext).collect())
    assert got("npy") == ["x.npy", "y.npy"] and got(None) == ["n.txt", "x.npy", "y.npy"]
    (tmp_path / "l.txt").write_text("p1\n\n p2 \np9\n")
    have, lost = sources.listed(spark, str(tmp_path / "l.txt"), spark.createDataFrame([("p1",), ("p2",)], "path string"))
    assert {r["path"] for r in have.collect()} == {"p1", "p2"} and {r["path"] for r in lost.collect()} == {"p9"}
    parts = [[r["path"] for r in sources.job_slice(have.unionByName(lost), "path", j, 2).collect()] for j in (0, 1)]
    assert sorted(parts[0] + parts[1]) == ["p1", "p2", "p9"] and len(parts[0]) == 2
    assert {(r["path"], r["batch"]) for r in sources.batches(have.unionByName(lost), "path", 2).collect()} == {("p1", 0), ("p2", 0), ("p9", 1)}
    (tmp_path / "w.csv").write_text("a|b|WorldFileName\n1|2|d/f.x.jpg\n")
    assert [tuple(r) for r in sources.world_files(spark, str(tmp_path / "w.csv")).collect()] == [("f", "f.x.jpg")]
    (tmp_path / "n.csv").write_text("1|2|d/f.jpg|N1\n")
    assert [tuple(r) for r in sources.node_references(spark, str(tmp_path / "n.csv")).collect()] == [("N1", "f.jpg")]
    (tmp_path / "j.csv").write_text("h|p|c|d|e|f|j\n1|P1|c|d|e|f|x/J1.json\n")
    assert [tuple(r) for r in sources.journal_references(spark, str(tmp_path / "j.csv")).collect()] == [("P1", "J1.json")]


def test_rewritten_documents_and_centralities(spark):
    top = spark.createDataFrame([("p", 1, "world/a.jpg", "a", 0.5), ("p", 2, "world/b.jpg", "b", 0.25)], "probe string, rank int, file string, fileid string, score double")
    docs = results.documents(top, "probe", "file", "fileid")
    back = results.nodes_of(results.rewritten(docs, "probe", spark.createDataFrame([("b", "world/B.png")], "fileid string, name string")), "probe").collect()
    assert [(r["id"], r["file"], r["nodeConfidenceScore"]) for r in back] == [("1", "world/a.jpg", 0.5), ("2", "world/B.png", 0.25)]
    c = results.centralities(spark.createDataFrame([(2, 5, 0.5), (1, 9, 1.5)], "round int, node bigint, degree double")).first()["document"]
    assert [r["node"] for r in json.loads(c)] == [9, 5]
    q = sinks.query_map(spark.createDataFrame([(7, 0, 2), (7, 0, 1)], "image_id bigint, q_image bigint, feature_id bigint")).first()["document"]
    assert json.loads(q) == {"image_id": 7, "q_image": 0, "features": [1, 2]}
