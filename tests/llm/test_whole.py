"""The training-data operators leave nothing out as inputs grow or bunch."""

import numpy as np
import pytest

from provq.llm import clusters, components, neighbors, spans, topn
from provq.runtime import Workspace


def skewed_rows(n, hot, seed, noise, dim=64):
    """Unit vectors, a share ``hot`` of them near one direction."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    k = int(n * hot)
    x[:k] = x[0] / np.linalg.norm(x[0]) + r.normal(scale=noise, size=(k, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shards_of(x, cells, sample, **how):
    """Each vector's own shard and the shards it is sent to."""
    c = neighbors.fit_cells(x[np.random.default_rng(1).permutation(len(x))[:sample]], cells)
    sims = x @ c.T
    return sims.argmax(1), neighbors._probed(c, sims, **({"probes": 0, "margin": 0.0, "within": None} | how))


def test_every_close_pair_meets_in_a_shard():
    x = skewed_rows(6000, 0.34, 5, 0.012)
    a, b = np.nonzero(x[:2000] @ x.T >= 0.99)
    a, b = a[a != b], b[a != b]
    assert len(a) > 50_000
    home, sent = shards_of(x, 60, 3000, within=0.99)
    assert sent[a, home[b]].all() and sent[b, home[a]].all()
    assert sent.mean() < 0.9  # not simply everything
    home, sent = shards_of(x, 60, 3000, probes=6, margin=0.06)  # a fixed count loses them
    assert (sent[a, home[b]] | sent[b, home[a]]).mean() < 0.9


def test_nearest_over_many_shards_of_a_dense_group(spark):
    x = skewed_rows(6000, 0.34, 5, 0.012)
    rows = [(i, [float(e) for e in v], None) for i, v in enumerate(x)]
    got = neighbors.nearest(spark.createDataFrame(rows, "feature_id bigint, features array<float>, ingested_at timestamp"), k=5, min_similarity=0.99, shard_rows=100, sample_rows=6000, **neighbors.VERY_CLOSE)
    sims = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(sims, -2)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if sims[i, j] >= 0.99}
    assert len({(r["id"], r["other"]) for r in got.collect()} & want) >= 0.99 * len(want)


def test_every_pair_of_similar_files_meets_in_a_shard():
    r = np.random.default_rng(8)
    x = skewed_rows(4000, 0, 8, 0)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = (0.905 * x + np.sqrt(1 - 0.905**2) * side / np.linalg.norm(side, axis=1, keepdims=True)).astype(np.float32)
    both, i = np.concatenate([x, y]), np.arange(4000)
    home, sent = shards_of(both, 100, 8000, **{k: v for k, v in neighbors.CLOSE.items() if k != "width"})
    assert sent[i, home[i + 4000]].all() and sent[i + 4000, home[i]].all()
    home, sent = shards_of(both, 100, 8000, probes=8, margin=0.1)
    met = (sent[i, home[i + 4000]] | sent[i + 4000, home[i]]).mean()
    assert met < 1


def test_measured_border_finds_the_close_ones_of_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "QUERIES_OF_A_MEMBER", 1)  # shards with many queries are built several times
    x = skewed_rows(6000, 0.34, 5, 0.012)
    rows = spark.createDataFrame([(i, [float(e) for e in v], None) for i, v in enumerate(x)], "feature_id bigint, features array<float>, ingested_at timestamp")
    got = neighbors.nearest(rows, k=5, min_similarity=0.99, shard_rows=200, sample_rows=6000, within=0.99, recall=neighbors.ALL_OF_SAMPLE, width=40)
    sims = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(sims, -2)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if sims[i, j] >= 0.99}
    assert len({(r["id"], r["other"]) for r in got.collect()} & want) >= 0.99 * len(want)


def test_measured_border_keeps_the_recall_that_was_asked_for(spark):
    x = skewed_rows(4000, 0, 9, 0)  # vectors without close neighbours, the hardest case
    rows = spark.createDataFrame([(i, [float(e) for e in v], None) for i, v in enumerate(x)], "feature_id bigint, features array<float>, ingested_at timestamp")
    got = neighbors.nearest(rows, k=5, shard_rows=250, sample_rows=4000, recall=0.95, width=128)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    found = {(r["id"], r["other"]) for r in got.collect()}
    assert np.mean([(i, int(j)) in found for i in range(len(x)) for j in top[i]]) >= 0.93


def plain_average_linkage(x, least):
    """Groups of places: the pair of the highest average linkage merges, the smaller places first among equal ones, until all are below the threshold."""
    s, n, groups = x.astype(float).copy(), np.ones(len(x)), {i: [i] for i in range(len(x))}
    while len(groups) > 1:
        at = np.array(sorted(groups))
        link = s[at] @ s[at].T / np.outer(n[at], n[at])
        best = np.round(link, clusters.PLACES)
        best[np.tril_indices(len(at))] = -9
        i, j = divmod(int(best.argmax()), len(at))
        if link[i, j] < least:
            break
        a, b = at[i], at[j]
        s[a] += s[b]
        n[a] += n[b]
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups.values()}


def curve(seed, n=160, dim=64, jitter=0.0):
    r = np.random.default_rng(seed)
    t = 2 * np.pi * (np.arange(n) + jitter * r.uniform(-0.5, 0.5, n)) / n
    waves = np.concatenate([f(m * t)[:, None] / m for m in range(1, 9) for f in (np.cos, np.sin)], axis=1)
    x = waves @ np.linalg.qr(r.normal(size=(dim, waves.shape[1])))[0].T
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found_groups(spark, x, **kw):
    rows = spark.createDataFrame([(f"{i:05d}", [float(a) for a in v]) for i, v in enumerate(x)], "file string, vec array<double>")
    got = {}
    for r in clusters.similarity_clusters(rows, **kw).collect():
        got.setdefault(r["cluster"], set()).add(int(r["record"]))
    return {frozenset(g) for g in got.values()}


@pytest.mark.parametrize("jitter, n, task", [(0.0, 80, 8), (0.0, 160, 20_000), (0.6, 160, 8), (0.6, 160, 100), (0.6, 160, 20_000)])
def test_clusters_of_one_connected_part_at_any_task_size(spark, jitter, n, task):
    x = curve(3, n, jitter=jitter)  # evenly spaced, all linkages of a distance are equal
    want = plain_average_linkage(x, 0.9)
    assert 1 < len(want) <= len(x) // 2
    assert found_groups(spark, x, task_clusters=task) == want


@pytest.mark.parametrize("task", [20, 20_000])
def test_clusters_larger_than_the_lists_of_neighbours(spark, task):
    r = np.random.default_rng(4)
    x = np.concatenate([c + r.normal(scale=0.035, size=(60, 64)) for c in np.eye(64)[:3]] + [r.normal(size=(20, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert found_groups(spark, x, k=4, task_clusters=task) == plain_average_linkage(x, 0.9)


def test_spans_of_words_that_defeat_a_power_of_two(spark):
    word = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[w ^ k] for w in word) for k in (0, 1))
    pts = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b)]
    assert spans.window_hashes(pts[0], 1024)[0] == spans.window_hashes(pts[1], 1024)[0]  # the weakness
    zero = np.zeros(1, np.int64)
    assert spans.prime_hashes(pts[0], 1024, zero)[0] != spans.prime_hashes(pts[1], 1024, zero)[0]
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert spans.shared_spans(rows, span=1024).count() == 0


def test_prime_hashes_are_equal_for_equal_windows_only():
    r = np.random.default_rng(2)
    p = r.integers(0, 3, 400).astype(np.uint32)
    at = np.arange(400 - 12 + 1)
    h = spans.prime_hashes(p, 12, at)
    same = {}
    for i in at:
        same.setdefault(p[i : i + 12].tobytes(), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_groups_of_a_core_at_any_task_size(spark, monkeypatch):
    r = np.random.default_rng(6)
    pairs = [(int(a), int(b), 1.0) for a, b in r.integers(0, 300, (420, 2))] + [(1000 + i, 1001 + i, 1.0) for i in range(60)] + [(2000, 2001 + i, 1.0) for i in range(80)]
    df = spark.createDataFrame(pairs, "source bigint, target bigint, relationshipConfidenceScore double")
    want = {(x["record"], x["group_id"]) for x in components.groups(df).collect()}
    monkeypatch.setattr(components, "CORE_EDGES", 0)
    assert {(x["record"], x["group_id"]) for x in components.groups(df).collect()} == want


def test_pointers_are_followed_to_the_root(spark):
    chain = [(i, i - 1) for i in range(1, 40)] + [(100 + i, 39) for i in range(20)]
    got = components.resolve(Workspace(spark, "t"), spark.createDataFrame(chain, "v bigint, parent bigint"))
    assert {(r["v"], r["root"]) for r in got.collect()} == {(v, 0) for v, _ in chain}


def test_many_items_of_a_group_beyond_the_planners_limit(spark):
    rows = spark.range(6000).selectExpr("'p' as probe_id", "cast(id as string) as fileid", "cast(id % 50 as double) as nodeConfidenceScore")
    got = [(r["item_key"], r["rank"]) for r in topn.top_n(rows, n=1500).collect()]
    want = sorted(range(6000), key=lambda i: (-(i % 50), str(i)))[:1500]
    assert sorted(got, key=lambda g: g[1]) == [(str(i), k + 1) for k, i in enumerate(want)]
