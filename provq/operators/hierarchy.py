"""Parent-child links to full hierarchies: path, depth, root and descendants of every node.

Method: nodes are range-partitioned by (tree, node), so that each task holds a bounded, contiguous run. Inside a
task parent chains are contracted to their *fragment exit*, the first ancestor that another task holds. The exits form
a much smaller quotient forest, which is solved by the same step over fewer, wider ranges, until one bounded task
holds all of it; if a level fails to shrink the forest (parents spread at random), the exits are resolved by pointer
doubling with joins instead. Fragment paths are then expanded level by level. A chain that closes inside a task is a local
cycle; one that closes across tasks shows up as a cycle of the quotient forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provq.runtime import Workspace, partitions_for

#: Rows of one task of the contraction step.
ROWS_PER_TASK = 200_000
CYCLE = "cycle"

_CONTRACTED = "tree bigint, node bigint, exit bigint, path string, depth bigint, top bigint, cyclic boolean"


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task: (tree, node, parent, rooted, path, depth, top) -> the same with chains followed as far as this task goes.

    path/depth/top describe the stretch from just below ``parent`` down to the node.
    """
    part = pd.concat(list(batches), ignore_index=True)
    n = len(part)
    if not n:
        return
    trees, nodes = part["tree"].tolist(), part["node"].tolist()
    paths, depths, tops = part["path"].tolist(), part["depth"].tolist(), part["top"].tolist()
    parents, rooted = part["parent"].tolist(), part["rooted"].tolist()
    at = {key: i for i, key in enumerate(zip(trees, nodes))}
    up = [-1 if r else at.get((t, p), -2) for t, p, r in zip(trees, parents, rooted)]
    done, exits, cyclic = [False] * n, [None] * n, [False] * n
    for i in range(n):
        if done[i]:
            continue
        chain, on = [], set()
        j = i
        while j >= 0 and not done[j] and j not in on:
            on.add(j)
            chain.append(j)
            j = up[j]
        looped = j >= 0 and not done[j]
        for v in reversed(chain):
            done[v] = True
            u = up[v]
            if looped or u >= 0 and cyclic[u]:
                cyclic[v] = True
            elif u == -2:
                exits[v] = parents[v]
            elif u >= 0:
                exits[v] = exits[u]
                paths[v] = f"{paths[u]}/{paths[v]}"
                depths[v] += depths[u]
                tops[v] = tops[u]
    for s in range(0, n, 20_000):
        e = slice(s, s + 20_000)
        c = cyclic[e]
        yield pd.DataFrame({
            "tree": trees[e], "node": nodes[e], "exit": pd.array(exits[e], dtype="Int64"),
            "path": [None if x else p for x, p in zip(c, paths[e])],
            "depth": pd.array([None if x else d for x, d in zip(c, depths[e])], dtype="Int64"),
            "top": pd.array([None if x else t for x, t in zip(c, tops[e])], dtype="Int64"), "cyclic": c,
        })


def _solve(ws: Workspace, forest: DataFrame, rows: int, level: int, rows_per_task: int, before: int | None) -> DataFrame:
    """forest(tree, node, parent, path, depth, top), parents inside the forest -> (tree, node, path, depth, top, cyclic)."""
    shrunk = before is None or rows < 0.7 * before
    if rows > rows_per_task and not shrunk:
        return _double(ws, forest, rows)
    parts = partitions_for(ws.spark, rows, rows_per_task)
    if level == 0:  # small tables are spread over the cores; the forest beyond the first level is small
        parts = max(parts, min(ws.spark.sparkContext.defaultParallelism, -(-rows // 2_000) or 1))
    spread = forest.repartitionByRange(parts, "tree", "node") if parts > 1 else forest.coalesce(1)
    spread = spread.withColumns({"rooted": F.col("parent").isNull(), "parent": F.coalesce("parent", F.lit(0))})  # pandas has no null integers
    got = ws.save(spread.mapInPandas(_contract, _CONTRACTED), f"contracted{level}")
    done = got.filter("exit is null").select("tree", "node", "path", "depth", "top", "cyclic")
    pending = got.filter("exit is not null")
    if parts == 1:
        return done
    asked = pending.select("tree", F.col("exit").alias("node")).distinct()
    above = ws.save(got.join(asked, ["tree", "node"], "left_semi"), f"exits{level}")
    open_above = above.filter("exit is not null").select("tree", "node", F.col("exit").alias("parent"), "path", "depth", "top")
    solved = above.filter("exit is null").select("tree", "node", "path", "depth", "top", "cyclic")
    n_open = open_above.count()
    if n_open:
        # exits whose chain ends here are the roots of the quotient forest
        roots = solved.filter("not cyclic").select("tree", "node", F.lit(None).cast("bigint").alias("parent"), "path", "depth", "top")
        cycles = solved.filter("cyclic")
        loops = cycles.select("tree", "node", F.col("node").alias("parent"), F.col("node").cast("string").alias("path"), F.lit(1).cast("bigint").alias("depth"), F.col("node").alias("top"))
        quotient = ws.save(open_above.unionByName(roots).unionByName(loops), f"quotient{level}")
        solved = _solve(ws, quotient, quotient.count(), level + 1, rows_per_task, rows)
    up = solved.select("tree", F.col("node").alias("exit"), F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), F.col("top").alias("up_top"), F.col("cyclic").alias("up_cyclic"))
    expanded = pending.join(up, ["tree", "exit"]).select(
        "tree", "node",
        F.when(~F.col("up_cyclic"), F.concat_ws("/", "up_path", "path")).alias("path"),
        F.when(~F.col("up_cyclic"), F.col("up_depth") + F.col("depth")).alias("depth"),
        F.when(~F.col("up_cyclic"), F.col("up_top")).alias("top"),
        F.col("up_cyclic").alias("cyclic"),
    )
    return done.unionByName(expanded)


def _double(ws: Workspace, forest: DataFrame, rows: int) -> DataFrame:
    """Pointer doubling with joins: on bare pointers first, to find what hangs on a cycle, then with texts on the rest.

    What has reached its root is set aside and only looked up, so the root of a giant tree isn't a key that all its nodes ask for.
    """
    rounds = max(1, rows).bit_length() + 1
    found: list[DataFrame] = []

    def doubled(state: DataFrame, carried: list[str], joined: list[Column], label: str) -> DataFrame:
        """The rows that still have a parent after all rounds; those that don't are added to ``found``."""
        left = ws.save(state, label)
        ends = left.filter("parent is null")
        found.append(ends)
        left = left.filter("parent is not null")
        for _ in range(rounds):
            if not left.limit(1).count():
                break
            up = ends.unionByName(left).select("tree", F.col("node").alias("parent"), F.col("parent").alias("next"), *(F.col(c).alias("up_" + c) for c in carried))
            after = ws.save(left.join(up, ["tree", "parent"]).select("tree", "node", F.col("next").alias("parent"), *joined), label)
            done = after.filter("parent is null")
            found.append(done)
            ends, left = ends.unionByName(done), after.filter("parent is not null")
        return left

    cyclic = doubled(forest.select("tree", "node", "parent"), [], [], "pointers").select("tree", "node")
    found.clear()
    join = [F.concat_ws("/", "up_path", "path").alias("path"), (F.col("up_depth") + F.col("depth")).alias("depth"), F.col("up_top").alias("top")]
    doubled(forest.join(cyclic, ["tree", "node"], "left_anti"), ["path", "depth", "top"], join, "doubling")
    none = F.lit(None)
    out = cyclic.select("tree", "node", none.cast("string").alias("path"), none.cast("bigint").alias("depth"), none.cast("bigint").alias("top"), F.lit(True).alias("cyclic"))
    for f in found:
        out = out.unionByName(f.select("tree", "node", "path", "depth", "top", F.lit(False).alias("cyclic")))
    return out


def hierarchy(nodes: DataFrame, links: DataFrame, *, tree: str = "journal_id", node: str = "idx", parent: str = "source", child: str = "target", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Place every node in its tree.

    Returns (tree BIGINT, node BIGINT, path STRING, depth BIGINT, root BIGINT, is_cycle BOOLEAN), one row per
    distinct (tree, node). path joins the nodes from the root down by ``/``; a root has depth 0 and is its own root.

    Defined cases: rows of ``nodes`` with a null tree or node are no nodes; repeated nodes and links count once; links with
    a null tree or end, or an end that is no node of that tree, do not count; of several distinct parents of a node the
    smallest counts; a node on a cycle or below one (its own parent included) has path ``cycle``, depth and root null.
    Other columns of either table are ignored, whatever their names; empty tables give an empty result.
    """
    spark = nodes.sparkSession
    ws = Workspace(spark, "hierarchy")
    n = nodes.select(F.col(tree).cast("bigint").alias("tree"), F.col(node).cast("bigint").alias("node")).dropna().distinct()
    k = links.select(F.col(tree).cast("bigint").alias("tree"), F.col(parent).cast("bigint").alias("parent"), F.col(child).cast("bigint").alias("node")).dropna()
    k = k.join(n.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    own = F.col("node").cast("string")
    forest = ws.save(n.join(k, ["tree", "node"], "left").select("tree", "node", "parent", own.alias("path"), F.lit(1).cast("bigint").alias("depth"), F.col("node").alias("top")), "forest")
    rows = forest.count()
    if not rows:
        solved = forest.select("tree", "node", "path", "depth", "top", F.lit(False).alias("cyclic"))
    else:
        solved = _solve(ws, forest, rows, 0, rows_per_task, None)
    return solved.select(
        "tree", "node",
        F.coalesce("path", F.lit(CYCLE)).alias("path"),
        (F.col("depth") - 1).alias("depth"),
        F.col("top").alias("root"),
        F.col("cyclic").alias("is_cycle"),
    )


def descendants(placed: DataFrame) -> DataFrame:
    """(tree, node, descendant, distance): a row for each node and each node below it, from ``hierarchy``'s result.

    Nodes on or below a cycle have no rows. The rows come from each node's own path, so no subtree is gathered in a task.
    """
    steps = placed.filter("not is_cycle").select("tree", F.col("node").alias("descendant"), "depth", F.posexplode(F.split("path", "/")).alias("pos", "node"))
    return steps.filter("pos < depth").select("tree", F.col("node").cast("bigint").alias("node"), "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
