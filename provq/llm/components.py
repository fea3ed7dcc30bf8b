"""Consolidating pairwise matches into groups (connected components).

Method: the graph is reduced until no edge is left, and labels are restored to what was removed.

* *Strip and compress.* Vertices of degree one and two compete by (degree one first, hash of the round); a vertex that beats its
  competing neighbours leaves the graph and remembers one neighbour. A leaf takes its edge along; a vertex of degree two leaves an edge
  between its two neighbours. Leaves so vanish level by level, and chains shrink by a constant factor each round, as in list ranking by
  contraction of independent sets, so a chain of a million records takes some tens of rounds, not a million.
* *Core.* When few such vertices are left, every vertex is heads or tails by a hash of the round, each tail joins its smallest
  neighbour that is heads, and the edges are relabelled. What this uncovers is stripped and compressed again. A core of no more edges than one
  task takes is solved there.
* *Restore.* The pointers of removed vertices form a forest as deep as there were rounds; it is resolved by pointer doubling. What has reached its root
  is set aside, so that the root of a giant component isn't looked up again and again.

A hub never is gathered in a task: degrees and messages are combined map-side, and the edges of removed vertices are found by their own
pair of ends. The joins on one end in the core step are left to adaptive skew handling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provq.runtime import Workspace, is_number

#: Edges of a reduced core that one task solves.
CORE_EDGES = 100_000


def _core(t: pa.Table) -> pa.Table:
    """(a, b) -> (v, parent): the smallest vertex of each other vertex's component."""
    ids, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
    a, b = at[: t.num_rows], at[t.num_rows :]
    label = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (lo == hi).all():
            break
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"v": ids[moved], "parent": ids[label[moved]]})


def _reduce(ws: Workspace, edges: DataFrame) -> list[DataFrame]:
    """edges(a, b), a < b, distinct -> tables of (v, parent), one a round."""
    removed: list[DataFrame] = []
    edges, turn = ws.save(edges, "edges"), 0
    n_edges = edges.count()
    while n_edges and (n_edges > CORE_EDGES or not turn):
        turn += 1
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        low = ends.groupBy("v").agg(F.count("*").alias("degree"), F.min("w").alias("n1"), F.max("w").alias("n2")).filter("degree <= 2")
        prio = F.struct((F.col("degree") == 1).alias("leaf"), F.xxhash64("v", F.lit(turn)).alias("mix"), F.col("v").alias("id"))
        void, same = F.lit(None).cast("bigint"), F.col("n1") == F.col("n2")
        told = lambda v, own, rival, n1, n2: F.struct(v.alias("v"), own.alias("own"), rival.alias("rival"), n1.alias("n1"), n2.alias("n2"))
        none = F.lit(None).cast("struct<leaf:boolean,mix:bigint,id:bigint>")
        messages = F.array(told(F.col("v"), prio, none, F.col("n1"), F.col("n2")), told(F.col("n1"), none, prio, void, void), told(F.when(~same, F.col("n2")), none, prio, void, void))
        heard = low.select(F.explode(messages).alias("m")).select("m.*").filter("v is not null").groupBy("v").agg(*(F.max(c).alias(c) for c in ("own", "rival", "n1", "n2")))
        won = ws.save(heard.filter("own is not null and (rival is null or own > rival)").select("v", "n1", "n2"), f"won{turn}")
        removed.append(won.select("v", F.col("n1").alias("parent")))
        # one shuffle: an edge stays unless it is gone; a bridge stays in any case (its ends are no removed vertices)
        pair = lambda a, b, tag: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(tag).alias("tag"))
        changes = won.select(F.explode(F.array(pair("v", "n1", 1), pair("v", "n2", 1), F.when(~same, pair("n1", "n2", 0)))).alias("e")).filter("e is not null").select("e.*")
        left = ws.save(edges.select("a", "b", F.lit(0).alias("tag")).unionByName(changes).groupBy("a", "b").agg(F.max("tag").alias("tag")).filter("tag = 0").select("a", "b"), f"edges{turn}")
        n_left = left.count()
        ws.drop(edges)
        if n_left > CORE_EDGES and n_edges - n_left < 0.05 * n_left:
            heads = lambda c: F.pmod(F.xxhash64(c, F.lit(-turn)), F.lit(2)) == 0
            both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            joins = ws.save(both.filter(~heads(F.col("a")) & heads(F.col("b"))).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("parent")), f"joins{turn}")
            removed.append(joins)
            at_a = left.join(joins.withColumnsRenamed({"v": "a", "parent": "pa"}), "a", "left").select(F.coalesce("pa", "a").alias("a"), "b")
            at_b = at_a.join(joins.withColumnsRenamed({"v": "b", "parent": "pb"}), "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
            core = ws.save(at_b.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"core{turn}")
            ws.drop(left)
            left, n_left = core, core.count()
        edges, n_edges = left, n_left
    if n_edges:
        one = edges.withColumn("task", F.lit(0)).repartition(1).groupBy("task").applyInArrow(lambda t: _core(t), "v bigint, parent bigint")
        removed.append(ws.save(one, "core"))
    ws.drop(edges)
    return removed


def resolve(ws: Workspace, pointers: DataFrame) -> DataFrame:
    """pointers(v, parent), a forest -> (v, root) of all that have a parent."""
    pointers = ws.save(pointers, "pointers")
    parents = pointers.select(F.col("parent").alias("root")).distinct()
    tops = ws.save(parents.join(pointers.select(F.col("v").alias("root")), "root", "left_anti"), "tops")
    state = pointers.withColumnRenamed("parent", "root").join(tops.withColumn("top", F.lit(True)), "root", "left")
    state = ws.save(state.select("v", "root", F.coalesce("top", F.lit(False)).alias("done")), "pointers")
    finished, left = state.filter("done").select("v", "root"), state.filter("not done")
    while left.limit(1).count():
        up = finished.withColumn("done", F.lit(True)).unionByName(left).select(F.col("v").alias("root"), F.col("root").alias("next"), "done")
        after = ws.save(left.select("v", "root").join(up, "root").select("v", F.col("next").alias("root"), "done"), "pointers")
        finished, left = finished.unionByName(after.filter("done").select("v", "root")), after.filter("not done")
    return finished


def groups(links: DataFrame, *, source: str = "source", target: str = "target", score: str | None = "relationshipConfidenceScore", least: float = 0.5) -> DataFrame:
    """(record BIGINT, group_id BIGINT): the smallest record that each record reaches through accepted pairs.

    A row is an accepted pair if both ends are present and its score is a number (neither null nor NaN) of at least ``least``;
    without a ``score`` column every row with both ends is.

    Defined cases: every record named in either column has one row, also where the other end is null or the pair isn't
    accepted (then, with no other pair, it is its own group); repeated pairs, either order, and pairs of a record with itself change
    nothing; an infinite score is a number; other columns are ignored; an empty table gives no rows.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "groups")
    s = F.lit(True) if score is None else is_number(F.col(score).cast("double")) & (F.col(score).cast("double") >= least)
    rows = links.select(F.col(source).cast("bigint").alias("a"), F.col(target).cast("bigint").alias("b"), F.coalesce(s, F.lit(False)).alias("ok"))
    edges = rows.filter("ok and a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    records = rows.select(F.explode(F.array("a", "b")).alias("record")).filter("record is not null").distinct()
    removed = _reduce(ws, edges)
    if not removed:
        return records.select("record", F.col("record").alias("group_id"))
    pointers = removed[0]
    for more in removed[1:]:
        pointers = pointers.unionByName(more)
    rooted = resolve(ws, pointers)
    # a root's own id takes part in its minimum; the roots are then members as any other
    least_of = ws.save(rooted.groupBy("root").agg(F.min("v").alias("low")).select("root", F.least("root", "low").alias("group_id")), "labels")
    member = rooted.join(least_of, "root").select(F.col("v").alias("record"), "group_id").unionByName(least_of.select(F.col("root").alias("record"), "group_id"))
    # one row for each record without another join: its label, or itself
    return records.select("record", F.lit(None).cast("bigint").alias("group_id")).unionByName(member).groupBy("record").agg(F.coalesce(F.min("group_id"), F.col("record")).alias("group_id"))
