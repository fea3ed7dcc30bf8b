"""Affinity graphs: edges, degrees, Markov and spectral clustering, levels, provenance chains.

Edges are (a, b, weight) with a < b unless stated otherwise.
"""

from __future__ import annotations

import heapq
import itertools
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import Workspace


def affinity(links: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """Undirected edges of pairs that may be named in either order and more than once: the highest weight counts; loops go."""
    e = links.filter(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)) & F.col(weight).isNotNull() & ~F.isnan(weight) & (F.col(weight) > 0))
    return e.groupBy(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).agg(F.max(weight).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """(node, degree, n_edges)."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree"), F.count("*").alias("n_edges"))


def remove_top_degree(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(round, node, degree): the node of the highest weighted degree (to nine places; ties: the smallest), taken out, again and again."""
    spark, out = edges.sparkSession, []
    ws = Workspace(spark, "degrees")
    edges = ws.save(edges, "edges")
    gone: list = []
    for k in range(1, rounds + 1):
        left = edges.filter(~F.col("a").isin(gone) & ~F.col("b").isin(gone)) if gone else edges  # one node a round
        top = weighted_degree(left).select("node", F.round("degree", 9).alias("degree")).orderBy(F.col("degree").desc(), "node").limit(1).collect()
        if not top:
            break
        gone.append(top[0]["node"])
        out.append((k, top[0]["node"], top[0]["degree"]))
    return spark.createDataFrame(out, f"round int, node {edges.schema['a'].dataType.simpleString()}, degree double")


def flow_start(edges: DataFrame) -> DataFrame:
    """(i, j, m): the column-stochastic matrix of the graph with loops of weight 1."""
    nodes = both_ways(edges).select("a").distinct()
    m = both_ways(edges).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("weight").alias("m")).unionByName(nodes.select(F.col("a").alias("i"), F.col("a").alias("j"), F.lit(1.0).alias("m")))
    return _stochastic(m)


def _stochastic(m: DataFrame) -> DataFrame:
    total = m.groupBy("j").agg(F.sum("m").alias("t"))
    return m.join(total, "j").select("i", "j", (F.col("m") / F.col("t")).alias("m"))


def flow_step(m: DataFrame, inflation: float = 2.0, prune: float = 0.001) -> DataFrame:
    """Expansion (the square of the matrix), inflation, normalisation; entries below ``prune`` go, but a column keeps its highest."""
    sq = m.select(F.col("i"), F.col("j").alias("k"), F.col("m").alias("x")).join(m.select(F.col("i").alias("k"), "j", F.col("m").alias("y")), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("m"))
    column = Window.partitionBy("j")  # as many rows as a node has others within two steps
    inflated = sq.select("i", "j", F.pow("m", F.lit(inflation)).alias("p")).select("i", "j", (F.col("p") / F.sum("p").over(column)).alias("m"))
    high = inflated.withColumn("high", F.max("m").over(column))
    return high.filter((F.round("m", 9) >= prune) | (F.col("m") == F.col("high"))).select("i", "j", "m")


def markov_clusters(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, cluster): Markov clustering; a node's cluster is the smallest node among the attractors that hold its flow.

    Rounds end when no entry moves by more than 1e-8; where ``rounds`` don't suffice for that, a warning says so.
    """
    ws = Workspace(edges.sparkSession, "flow")
    m = ws.save(flow_start(edges), "m")
    for _ in range(rounds):
        after = ws.save(flow_step(m), "m")
        moved = after.join(m.withColumnRenamed("m", "old"), ["i", "j"], "full").filter(F.abs(F.coalesce("m", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))) > 1e-8).limit(1).count()
        ws.drop(m)
        m = after
        if not moved:
            break
    else:
        warnings.warn(f"Markov clustering has not converged after {rounds} rounds; its clusters may still change", RuntimeWarning, stacklevel=2)
    held = ws.save(m.join(m.filter("i = j").select("i"), "i").select("i", F.col("j").alias("node")), "held")
    # attractors that hold the same node are one system: the smallest of them stands for all
    names = held.select("i").distinct().withColumn("cluster", F.col("i"))
    while True:
        names = ws.save(names, "names")
        of_node = held.join(names, "i").groupBy("node").agg(F.min("cluster").alias("cluster"))
        lower = held.join(of_node, "node").groupBy("i").agg(F.min("cluster").alias("lower"))
        after = ws.save(names.join(lower, "i").select("i", F.least("cluster", "lower").alias("cluster"), (F.col("lower") < F.col("cluster")).alias("moved")), "names")
        if not after.filter("moved").limit(1).count():
            return of_node
        names = after.drop("moved")


def spectral_clusters(edges: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(node, cluster): power iteration clustering, of the spectral family; nodes without an edge take no part."""
    from pyspark.ml.clustering import PowerIterationClustering

    e = edges.select(F.col("a").cast("bigint").alias("src"), F.col("b").cast("bigint").alias("dst"), F.col("weight").cast("double").alias("weight"))
    got = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(e)
    return got.select(F.col("id").alias("node"), "cluster")


def near_duplicates(edges: DataFrame) -> DataFrame:
    """(group_id, near_duplicate): groups (group_id, a, b, weight) of more than two nodes with at most half of their links outside mean plus or minus a deviation."""
    over = Window.partitionBy("group_id")
    outside = (F.abs(F.col("weight") - F.avg("weight").over(over)) > F.stddev_pop("weight").over(over)).cast("int")
    flags = edges.withColumn("outside", outside)
    nodes = edges.select("group_id", F.explode(F.array("a", "b")).alias("n")).groupBy("group_id").agg(F.countDistinct("n").alias("nodes"))
    share = flags.groupBy("group_id").agg((F.sum("outside") / F.count("*")).alias("share"))
    return share.join(nodes, "group_id").select("group_id", ((F.col("nodes") > 2) & (F.col("share") <= 0.5)).alias("near_duplicate"))


def expand_levels(links: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """links(a, b), starts(node) -> (node, level): breadth-first levels, a node at its first; links hold both ways.

    All levels until no new node is found, or the first ``most``, where given.
    """
    ws = Workspace(links.sparkSession, "levels")
    both = ws.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    seen = ws.save(starts.select("node", F.lit(0).alias("level")).distinct(), "seen")
    for k in itertools.count(1) if most is None else range(1, most + 1):
        edge = seen.filter(F.col("level") == k - 1).select(F.col("node").alias("a"))
        new = ws.save(both.join(edge, "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(k).alias("level")), "new")
        if not new.limit(1).count():
            break
        after = ws.save(seen.unionByName(new), "seen")
        ws.drop(seen, new)
        seen = after
    return seen


#: Links of the trees that one task takes; a tree of more is advanced by rounds.
TREE_LINKS = 500_000


def _levels_of(links: pa.Table, starts: pa.Table) -> pa.Table:
    """The levels of whole trees, frontier by frontier."""
    k, s = links.to_pandas(), starts.to_pandas()
    ends = pd.concat([f.rename(columns={c: "node"})[["kind", "tree", "node"]] for f, c in ((s, "node"), (k, "a"), (k, "b"))], ignore_index=True)
    code = ends.groupby(["kind", "tree", "node"], sort=False).ngroup().to_numpy()
    at, (a, b) = code[: len(s)], np.split(code[len(s) :], 2)
    n = int(code.max()) + 1 if len(code) else 0
    o = np.argsort(a, kind="stable")
    a, b = a[o], b[o]
    begin = np.searchsorted(a, np.arange(n + 1))
    level, front, step = np.full(n, -1), np.unique(at), 0
    while len(front):
        level[front] = step
        many = begin[front + 1] - begin[front]
        out = b[np.repeat(begin[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        front, step = np.unique(out[level[out] < 0]), step + 1
    first = ends[~pd.Series(code).duplicated()]
    first = first.assign(level=level[code[first.index]])
    return pa.Table.from_pandas(first[first["level"] >= 0], preserve_index=False)


def directed_levels(links: DataFrame, starts: DataFrame) -> DataFrame:
    """links(kind, tree, a, b), starts(kind, tree, node) -> (kind, tree, node, level): each node's first level from any start of its kind and tree along the links.

    Trees of at most ``TREE_LINKS`` links are gone through within tasks that hold about as many. Of larger ones all kinds advance in the same rounds, until none finds a new
    node. Links of a kind name its direction.
    """
    ws = Workspace(links.sparkSession, "levels")
    at = ["kind", "tree", "node"]
    links = ws.save(links.select("kind", "tree", "a", "b").distinct(), "links")
    starts = ws.save(starts.select(*at).distinct(), "starts")
    large = ws.save(links.groupBy("kind", "tree").count().filter(F.col("count") > TREE_LINKS).select("kind", "tree"), "large")
    rounds = large.limit(1).count() > 0
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // TREE_LINKS))
    task = F.pmod(F.xxhash64("kind", "tree"), F.lit(tasks)).alias("task")
    small = [df.join(F.broadcast(large), ["kind", "tree"], "left_anti") if rounds else df for df in (links, starts)]  # at most one in TREE_LINKS links has a large tree
    k, s = (df.withColumn("task", task) for df in small)
    kinds = {f.name: f.dataType.simpleString() for f in starts.schema}
    got = k.groupBy("task").cogroup(s.groupBy("task")).applyInArrow(lambda x, y: _levels_of(x, y).select([*at, "level"]).cast(pa.schema([*(y.schema.field(c) for c in at), pa.field("level", pa.int32())])), ", ".join(f"`{c}` {kinds[c]}" for c in at) + ", level int")
    if not rounds:
        return got
    return got.unionByName(_levels_by_rounds(ws, links.join(F.broadcast(large), ["kind", "tree"], "left_semi"), starts.join(F.broadcast(large), ["kind", "tree"], "left_semi")))


def _levels_by_rounds(ws: Workspace, links: DataFrame, starts: DataFrame) -> DataFrame:
    at = ["kind", "tree", "node"]
    links = ws.save(links, "links")
    front = ws.save(starts.withColumn("level", F.lit(0)), "front")
    seen = front
    for k in itertools.count(1):
        step = links.join(front.select("kind", "tree", F.col("node").alias("a")), ["kind", "tree", "a"]).select("kind", "tree", F.col("b").alias("node")).distinct()
        front = ws.save(step.join(seen, at, "left_anti").withColumn("level", F.lit(k)), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)
        if k % 8 == 0:  # many small tables would have to be read in every round
            seen = ws.save(seen.coalesce(max(1, links.sparkSession.sparkContext.defaultParallelism)), "seen")


def node_roles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(tree, node), links(tree, parent, child) -> degrees, ends, shortest distances from a root and a leaf, and the penalty of leaving the node out.

    The penalty is a link to each parent and two for each child. Nodes that no root or leaf reaches, as on a cycle, have null distances; loops don't count.
    """
    k = links.filter("parent <> child").distinct()
    ends = journal_ends(nodes, k)
    kind = lambda n, a, b: k.select(F.lit(n).alias("kind"), "tree", F.col(a).alias("a"), F.col(b).alias("b"))
    starts = ends.filter("is_root").select(F.lit("down").alias("kind"), "tree", "node").unionByName(ends.filter("is_leaf").select(F.lit("up").alias("kind"), "tree", "node"))
    levels = directed_levels(kind("down", "parent", "child").unionByName(kind("up", "child", "parent")), starts)
    far = levels.groupBy("tree", "node").agg(F.min(F.when(F.col("kind") == "down", F.col("level"))).alias("from_root"), F.min(F.when(F.col("kind") == "up", F.col("level"))).alias("from_leaf"))
    out = ends.join(far, ["tree", "node"], "left").withColumnsRenamed({"n_parents": "degree_in", "n_children": "degree_out"})
    share = (F.col("from_root") + 1) / (F.col("from_root") + F.col("from_leaf") + 1)
    return out.withColumns({"root_share": share, "penalty": F.col("degree_in") + 2 * F.col("degree_out")})


def paths_to_leaves(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(tree, node), links(tree, parent, child) -> (tree, path ARRAY): every simple path from a root to a node without children."""
    ws = Workspace(nodes.sparkSession, "paths")
    k = ws.save(links.distinct(), "links")
    ends = ws.save(journal_ends(nodes, k), "ends")
    leaves = ends.filter("is_leaf").select("tree", "node")
    front = ws.save(ends.filter("is_root").select("tree", "node", F.array("node").alias("path")), "front")
    out = front.join(leaves, ["tree", "node"], "left_semi")
    while front.limit(1).count():
        longer = front.join(k.select("tree", F.col("parent").alias("node"), "child"), ["tree", "node"]).filter(~F.array_contains("path", F.col("child")))
        front = ws.save(longer.select("tree", F.col("child").alias("node"), F.array_append("path", F.col("child")).alias("path")), "front")
        out = out.unionByName(front.join(leaves, ["tree", "node"], "left_semi"))
    return out.select("tree", "path")


def journal_ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(tree, node), links(tree, parent, child) -> (tree, node, n_parents, n_children, is_root, is_leaf); repeated links count once."""
    k = links.distinct()
    ups = k.groupBy("tree", F.col("child").alias("node")).agg(F.count("*").alias("n_parents"))
    downs = k.groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    n = nodes.distinct().join(ups, ["tree", "node"], "left").join(downs, ["tree", "node"], "left").fillna(0, ["n_parents", "n_children"])
    return n.withColumns({"is_root": F.col("n_parents") == 0, "is_leaf": F.col("n_children") == 0})


#: Images of a probe's candidate list that a graph is built over, the probe included.
MOST_CANDIDATES = 100


def _candidate_pairs(pairs: DataFrame, at_least: int, clear: int, near: float) -> DataFrame:
    """Pairs that may be linked: mutual information either way, ``at_least`` matches, and ``clear`` matches or a mean distance below ``near``."""
    return pairs.filter(((F.col("mi_ij") != 0) | (F.col("mi_ji") != 0)) & (F.col("kp_count") >= at_least) & ((F.col("kp_count") >= clear) | (F.col("avg_dist") < near)))


def strongest_links(pairs: DataFrame, at_least: int = 4, clear: int = 10, near: float = 0.1) -> DataFrame:
    """pairs(probe_id, i, j, kp_count, avg_dist, mi_ij, mi_ji) -> (probe_id, node, best, outward): each node's strongest neighbour.

    Most matches win. Among neighbours of equal matches the smallest comes first with its own direction's mutual information; of the others, in ascending order, both
    directions are offered, the node's own first, and the highest value wins, the earliest of equal ones. outward: the link points from the node; for the first neighbour that
    is where the node's own direction is the stronger one, null if both are equal.
    """
    ok = _candidate_pairs(pairs, at_least, clear, near)
    both = ok.select("probe_id", F.col("i").alias("node"), F.col("j").alias("other"), "kp_count", F.col("mi_ij").alias("out"), F.col("mi_ji").alias("back")).unionByName(ok.select("probe_id", F.col("j").alias("node"), F.col("i").alias("other"), "kp_count", F.col("mi_ji").alias("out"), F.col("mi_ij").alias("back")))
    node = ["probe_id", "node"]
    top = both.groupBy(*node).agg(F.max("kp_count").alias("kp_count"))
    tied = both.join(top, [*node, "kp_count"])
    first = tied.groupBy(*node).agg(F.min("other").alias("first"))
    offer = lambda value, step, outward: F.struct(value.alias("value"), (-F.col("other")).alias("m"), F.lit(-step).alias("step"), outward.alias("outward"))
    own = F.when(F.col("out") > F.col("back"), True).when(F.col("out") < F.col("back"), False)
    offers = F.when(F.col("other") == F.col("first"), F.array(offer(F.col("out"), 0, own))).otherwise(F.array(offer(F.col("out"), 0, F.lit(True)), offer(F.col("back"), 1, F.lit(False))))
    best = tied.join(first, node).select(*node, F.explode(offers).alias("s")).groupBy(*node).agg(F.max("s").alias("s"))
    return best.select(*node, (-F.col("s.m")).alias("best"), "s.outward")


class _Candidates:
    """The pair values of one probe's candidate list as matrices, and the rules that a graph grows by."""

    def __init__(self, p: pd.DataFrame, at_least: int, clear: int, near: float):
        n = int(max(p["i"].max(), p["j"].max())) + 1
        self.kp, self.mi = np.zeros((n, n)), np.zeros((n, n))
        far = np.full((n, n), np.inf)
        i, j = p["i"].to_numpy(np.int64), p["j"].to_numpy(np.int64)
        self.kp[i, j] = self.kp[j, i] = p["kp_count"]
        far[i, j] = far[j, i] = p["avg_dist"]
        self.mi[i, j], self.mi[j, i] = p["mi_ij"], p["mi_ji"]
        self.ok = ((self.mi != 0) | (self.mi.T != 0)) & (self.kp >= at_least) & ((self.kp >= clear) | (far < near)) & ~np.eye(n, dtype=bool)

    def strongest(self, node: int, used: list[int]) -> tuple[int, int, float, float] | None:
        """(neighbour, 1 outward or -1 inward or 0, matches, mutual information) by the rule of ``strongest_links``."""
        free = self.ok[node].copy()
        free[used] = False
        if not free.any():
            return None
        kp = self.kp[node][free].max()
        tied = np.flatnonzero(free & (self.kp[node] == kp))
        f = tied[0]
        offers = [(f, int(np.sign(self.mi[node, f] - self.mi[f, node])), self.mi[node, f])]
        for o in tied[1:]:
            offers += [(o, 1, self.mi[node, o]), (o, -1, self.mi[o, node])]
        other, way, mi = max(offers, key=lambda x: x[2])  # the earliest of equal ones
        return int(other), way, float(kp), float(mi)

    def alike(self, target: int, chain: list[int]) -> bool:
        """Whether the target's matches with the chain lie within a deviation of the chain's own, for half of it at least; true for chains of two."""
        if len(chain) <= 2:
            return True
        own = self.kp[np.ix_(chain, chain)][np.triu_indices(len(chain), 1)]
        outside = np.abs(self.kp[chain, target] - own.mean()) > own.std()
        return outside.sum() <= len(chain) / 2

    def chain_of_probe(self) -> tuple[list[int], float]:
        """The probe's chain, grown at both ends while what comes next is alike, and how much of it points onward."""
        chain, ends, lean = [0], [0, 0], 0.0
        step, side = self.strongest(0, chain), 0
        lean += 0.5 * (1 if step and step[1] > 0 else -1)
        while step:
            lean += 1 if step[1] > 0 else -1
            ends[side] = step[0]
            chain = [*chain, step[0]] if side == 0 else [step[0], *chain]
            steps = [self.strongest(e, chain) for e in ends]
            fit = [s is not None and self.alike(s[0], chain) for s in steps]
            if not any(fit):
                break
            side = 0 if fit[0] and (not fit[1] or steps[0][2] >= steps[1][2]) else 1
            step = steps[side]
        return chain, lean

    def edges(self) -> list[tuple[int, int]]:
        chain, lean = self.chain_of_probe()
        out = list(zip(chain, chain[1:])) if lean > 0 else list(zip(chain[1:], chain))
        used, lean = chain, 0.0  # the lean of branches is carried on from one to the next
        while True:
            steps = [(s[2] + s[3], n, s) for n in used if (s := self.strongest(n, used))]
            if not steps:
                return out
            _, at, step = max(steps, key=lambda x: x[0])
            lean += 1.5 if step[1] > 0 else -1.5
            used, branch = [*used, step[0]], [step[0]]
            inner = self.strongest(step[0], used)
            while inner:
                used, branch = [*used, inner[0]], [*branch, inner[0]]
                lean += 1 if inner[1] > 0 else -1
                inner = self.strongest(inner[0], used)
                if inner and not self.alike(inner[0], branch):
                    break
            path = [at, *branch]
            out += list(zip(path, path[1:])) if lean > 0 else list(zip(path[1:], path))


def provenance_graph(pairs: DataFrame, at_least: int = 4, clear: int = 10, near: float = 0.1, most: int = MOST_CANDIDATES) -> DataFrame:
    """pairs(probe_id, i, j, kp_count, avg_dist, mi_ij, mi_ji), node 0 the probe, nodes numbered by rank -> (probe_id, source, target): the directed graph of each probe.

    A chain grows from the probe at both ends, always by the strongest link, while the next image is alike; its direction goes by majority, the first link
    counting one and a half. Then branches leave the chain, each from the place of the strongest link left, and grow in the same way.
    Nodes from ``most`` on are beyond the rank cut and take no part, so a probe's matrices are of bounded size.
    """

    def grow(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], a, b) for a, b in _Candidates(p, at_least, clear, near).edges()], columns=["probe_id", "source", "target"])

    listed = pairs.filter((F.col("i") < most) & (F.col("j") < most) & (F.col("i") != F.col("j")))
    return listed.groupBy("probe_id").applyInPandas(grow, "probe_id bigint, source bigint, target bigint")


def grow_chains(pairs: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """pairs(probe_id, i, j, kp_count, mi_ij, mi_ji), node 0 the probe -> (probe_id, source, target): the strongest tree that holds the probe.

    The strongest link between a placed and an unplaced node is added until none is left (matches, then mutual information, then the smaller nodes); a
    link points the way of the higher mutual information, from the node placed first if equal. Nodes from ``most`` on are beyond the rank cut.
    """

    def grow(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        ways: dict[int, list] = {}
        for i, j, kp, forth, back in zip(p["i"].tolist(), p["j"].tolist(), p["kp_count"].tolist(), p["mi_ij"].tolist(), p["mi_ji"].tolist()):
            rank = (-kp, -max(forth, back), i, j)
            ways.setdefault(i, []).append((rank, i, j, forth, back))
            ways.setdefault(j, []).append((rank, j, i, back, forth))
        placed, out, open_ = {0}, [], list(ways.get(0, []))
        heapq.heapify(open_)
        while open_:
            _, old, new, forth, back = heapq.heappop(open_)
            if new in placed:
                continue
            out.append((key[0], old, new) if forth >= back else (key[0], new, old))
            placed.add(new)
            for way in ways[new]:
                heapq.heappush(open_, way)
        return pd.DataFrame(out, columns=["probe_id", "source", "target"])

    listed = pairs.filter((F.col("i") < most) & (F.col("j") < most))
    return listed.groupBy("probe_id").applyInPandas(grow, "probe_id bigint, source bigint, target bigint")
