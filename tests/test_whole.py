"""The core's operators do the whole job: no silent limit on rounds, levels or cells."""

import warnings

import numpy as np
import pytest

from provq.operators import graph
from provq.plans import catalog
from provq.plans import inputs as I
from tests_data import DATA


def test_all_levels_of_the_links(spark):
    near = {}
    for r in I.edges(spark, DATA).collect():
        near.setdefault(r["a"], set()).add(r["b"])
        near.setdefault(r["b"], set()).add(r["a"])
    start = min(near)
    want, front = {start: 0}, [start]
    while front:
        front = [b for b in {b for a in front for b in near[a]} if b not in want and not want.update({b: want[next(a for a in front if b in near[a])] + 1})]
    assert {r["node"]: r["level"] for r in catalog.queries()["bfs_levels"](spark, DATA).collect()} == want


def test_markov_clusters_say_when_the_limit_is_hit(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "a bigint, b bigint, weight double")
    with pytest.warns(RuntimeWarning, match="not converged after 2 rounds"):
        graph.markov_clusters(path, rounds=2)


def test_markov_query_converges(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = catalog.queries()["mcl_clusters"](spark, DATA)
    m = graph.flow_start(I.edges(spark, DATA)).toPandas()
    nodes = sorted(set(m["i"]))
    at = {v: i for i, v in enumerate(nodes)}
    x = np.zeros((len(nodes), len(nodes)))
    x[m["i"].map(at), m["j"].map(at)] = m["m"]
    for _ in range(100):
        y = (x @ x) ** 2
        y /= y.sum(0)
        y[(np.round(y, 9) < 0.001) & (y < y.max(0))] = 0
        if np.abs(y - x).max() <= 1e-8:
            break
        x = y
    holds = (y > 0) & (np.diag(y) > 0)[:, None]
    assert {r["node"]: r["cluster"] for r in got.collect()} == {nodes[j]: nodes[np.flatnonzero(holds[:, j])[0]] for j in range(len(nodes)) if holds[:, j].any()}


def test_top_degree_removal_has_20_rounds(spark):
    left, want = {(r["a"], r["b"]): r["weight"] for r in I.edges(spark, DATA).collect()}, []
    for k in range(1, 21):
        total = {}
        for e, w in left.items():
            for v in e:
                total[v] = total.get(v, 0) + w
        node = min(total, key=lambda v: (-round(total[v], 9), v))
        want.append((k, node, round(total[node], 5)))
        left = {e: w for e, w in left.items() if node not in e}
    got = catalog.queries()["top_degree_removal"](spark, DATA).collect()
    assert sorted((r["round"], r["node"], round(r["degree"], 5)) for r in got) == want


def test_fitted_cells_find_nine_of_ten(spark):
    r = catalog.queries()["intersection_at_k_trained"](spark, DATA).collect()
    assert len(r) == 1 and r[0]["n_queries"] > 0 and r[0]["share"] >= 0.9
