import random

import pytest

from provq.operators import hierarchy as H

NODES, LINKS = "journal_id bigint, idx int", "journal_id bigint, source int, target int"


def brute(nodes, links):
    ns = {n for n in nodes if None not in n}
    up = {}
    for t, s, c in links:
        if None not in (t, s, c) and (t, s) in ns and (t, c) in ns:
            up[t, c] = min(s, up.get((t, c), s))
    out = {}
    for t, v in ns:
        path, at = [v], v
        while (t, at) in up and len(path) <= len(ns):
            at = up[t, at]
            path.append(at)
        out[t, v] = "cycle" if (t, at) in up else "/".join(map(str, reversed(path)))
    return out


def run(spark, nodes, links, **kw):
    got = H.hierarchy(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS), **kw)
    rows = got.collect()
    assert len(rows) == len({(r["tree"], r["node"]) for r in rows})
    for r in rows:
        assert r["is_cycle"] == (r["path"] == "cycle")
        if not r["is_cycle"]:
            assert r["depth"] == r["path"].count("/") and str(r["root"]) == r["path"].split("/")[0]
    return {(r["tree"], r["node"]): r["path"] for r in rows}


def test_cases(spark):
    nodes = [(1, i) for i in range(6)] + [(1, 0), (None, 3), (2, None), (2, 1), (3, 7)]
    links = [(1, 0, 1), (1, 0, 1), (1, 1, 2), (1, 3, 4), (1, 4, 3), (1, 4, 5), (1, 9, 0), (1, None, 2), (2, 1, 1), (None, 1, 2), (3, 1, 7)]
    got = run(spark, nodes, links)
    assert got == brute(nodes, links)
    assert got[1, 2] == "0/1/2" and got[1, 5] == got[2, 1] == "cycle" and got[3, 7] == "7"


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, 1)], []) == {(1, 1): "1"}


def test_clashing_columns(spark):
    nodes = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 6)], NODES + ", path string, parent int")
    links = spark.createDataFrame([(1, 0, 1, "x", 9)], LINKS + ", tree string, node int")
    assert {r["node"]: r["path"] for r in H.hierarchy(nodes, links).collect()} == {0: "0", 1: "0/1"}


@pytest.mark.parametrize("seed,rows_per_task", [(0, 1000), (1, 17), (2, 5), (3, 40)])
def test_random(spark, seed, rows_per_task):
    """Trees over many tasks, near parents and far ones, with cycles."""
    r = random.Random(seed)
    nodes, links = [], []
    for t, n in ((1, 150), (2, 3), (3, 60)):
        nodes += [(t, i) for i in range(n)]
        for i in range(1, n):
            p = r.randrange(max(0, i - 4), i) if seed % 2 else r.randrange(n)
            if r.random() < 0.95:
                links.append((t, p, i))
    assert run(spark, nodes, links, rows_per_task=rows_per_task) == brute(nodes, links)


def test_scattered_chain(spark):
    """One chain in random order: no task can contract much, so pointers are doubled."""
    order = list(range(120))
    random.Random(5).shuffle(order)
    nodes, links = [(1, i) for i in order], [(1, a, b) for a, b in zip(order, order[1:])]
    assert run(spark, nodes, links, rows_per_task=8) == brute(nodes, links)
    loop = [*links, (1, order[-1], order[0])]
    assert set(run(spark, nodes, loop, rows_per_task=8).values()) == {"cycle"}


def test_descendants(spark):
    placed = H.hierarchy(spark.createDataFrame([(1, i) for i in range(5)], NODES), spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 4), (1, 4, 3)], LINKS))
    assert {tuple(r) for r in H.descendants(placed).collect()} == {(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 2, 1)}
