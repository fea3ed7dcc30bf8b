"""Matching of item pairs by their features, and joins by place.

Nearest features are (probe_id, image_id, q_feature, feature_id, dist, nth), as ``search.pair_nearest`` gives them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import Workspace

PAIR = ("probe_id", "image_id")


def mutual_in_pair(nearest: DataFrame) -> DataFrame:
    """(probe_id, image_id, q_feature, feature_id, dist): of ``search.pair_nearest``'s rows the features that are each other's nearest."""
    return nearest.filter("nth = 1 and mutual").select(*PAIR, "q_feature", "feature_id", "dist")


def one_to_one(matches: DataFrame) -> DataFrame:
    """Of the matches of one feature of an image only the nearest (ties: the smaller query feature)."""
    nth = F.row_number().over(Window.partitionBy(*PAIR, "feature_id").orderBy("dist", "q_feature"))
    return matches.withColumn("nth", nth).filter("nth = 1").drop("nth")


def pair_stats(matches: DataFrame) -> DataFrame:
    """(probe_id, image_id, kp_count, avg_dist): the adjacency of a probe's images by their matches."""
    return matches.groupBy(*PAIR).agg(F.count("*").alias("kp_count"), F.avg("dist").alias("avg_dist"))


def related_pairs(matches: DataFrame, at_least: int = 4, clear: int = 10, share: float = 0.02) -> DataFrame:
    """matches(probe_id, image_id, qx, qy, width, height of the probe) -> (probe_id, image_id, n): pairs of images that are related.

    ``clear`` matches are enough; with fewer, but ``at_least`` so many, no two of them may lie further apart in the probe than ``share`` of its height (x) or width (y).
    """
    n = matches.groupBy(*PAIR).agg(F.count("*").alias("n"), (F.max("qx") - F.min("qx")).alias("dx"), (F.max("qy") - F.min("qy")).alias("dy"), F.max("width").alias("w"), F.max("height").alias("h"))
    close = (F.col("dx") <= share * F.col("h")) & (F.col("dy") <= share * F.col("w"))
    return n.filter((F.col("n") >= clear) | ((F.col("n") >= at_least) & close)).select(*PAIR, "n")


def region_differs(width: Column, height: Column, image_width: Column, image_height: Column, share: float = 0.16, area: int = 125 * 125) -> Column:
    """True for a region that differs from its image by more than ``share`` both ways and is larger than ``area``."""
    off = lambda a, b: F.abs(a - b) / b > share
    return off(width, image_width) & off(height, image_height) & (width * height > area)


def well_conditioned(fits: DataFrame, least: float = 0.1) -> DataFrame:
    """Fits whose equations have a reciprocal condition of ``least`` at least, with their rank, best first, for each probe."""
    rank = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.col("rcond").desc(), "image_id"))
    return fits.filter(F.col("rcond") >= least).withColumn("rank", rank)


def ratio_test(nearest: DataFrame, most: float = 0.8) -> DataFrame:
    """(probe_id, image_id, q_feature, feature_id, dist, ratio): nearest features that are clearly nearer than the second nearest of their image.

    nearest: the two nearest of each query feature and image. Distances are compared as lengths (square roots); a second distance of
    0, or none, gives no match.
    """
    one = F.max(F.when(F.col("nth") == 1, F.struct("feature_id", "dist")))
    two = nearest.groupBy(*PAIR, "q_feature").agg(one.alias("a"), F.max(F.when(F.col("nth") == 2, F.col("dist"))).alias("second")).filter("second > 0")
    ratio = F.round(F.sqrt(F.col("a.dist") / F.col("second")), 9)
    return two.withColumn("ratio", ratio).filter(F.col("ratio") < most).select(*PAIR, "q_feature", "a.feature_id", "a.dist", "ratio")


def mutual_nearest(forth: DataFrame, back: DataFrame) -> DataFrame:
    """(probe_id, image_id, q_feature, feature_id, dist): features that are each other's nearest in the pair of images.

    forth: the nearest feature of each query feature and image; back(probe_id, feature_id, q_feature): the nearest query feature of each feature and probe.
    """
    return forth.filter("nth = 1").drop("nth").join(back.select("probe_id", "feature_id", "q_feature"), ["probe_id", "feature_id", "q_feature"], "left_semi")


def best_half(matches: DataFrame, at_least: int = 1) -> DataFrame:
    """The nearer half (rounded up) of each pair's matches; pairs that keep fewer than ``at_least`` go."""
    over = Window.partitionBy(*PAIR)
    nth = F.row_number().over(over.orderBy("dist", "q_feature", "feature_id"))
    kept = matches.withColumns({"nth": nth, "n": F.count("*").over(over)}).filter(F.col("nth") <= F.ceil(F.col("n") / 2))
    return kept.filter(F.ceil(F.col("n") / 2) >= at_least).drop("nth", "n")


def cumulative_share_mean(dist: DataFrame, share: float = 0.65) -> DataFrame:
    """(probe_id, image_id, n, mean_dist): the mean of the smallest distances of a pair's matches that together make up at most ``share`` of their sum."""
    over = Window.partitionBy(*PAIR)
    run = F.sum("dist").over(over.orderBy("dist", "q_feature", "feature_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = dist.withColumns({"run": F.round(run, 7), "total": F.round(F.sum("dist").over(over) * share, 7)}).filter(F.col("run") <= F.col("total"))
    return kept.groupBy(*PAIR).agg(F.count("*").alias("n"), F.avg("dist").alias("mean_dist"))


def within_radius(points: DataFrame, radius: float) -> DataFrame:
    """points(group_id, id, x, y) -> (group_id, a, b, d2), a < b: pairs of a group no further apart than ``radius``.

    Points meet in cells as large as the radius: each is sent to its own cell and, as a partner, to the eight around, so only
    neighbours are compared, however many points a group has.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    a = points.select("group_id", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    b = points.select("group_id", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), around.alias("i")).select("*", around.alias("j"))
    b = b.select("group_id", "b", "bx", "by", (F.floor(F.col("bx") / radius) + F.col("i")).alias("cx"), (F.floor(F.col("by") / radius) + F.col("j")).alias("cy"))
    d2 = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
    return a.join(b, ["group_id", "cx", "cy"]).filter("a < b").withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select("group_id", "a", "b", "d2")


def spaced_points(points: DataFrame, radius: float) -> DataFrame:
    """points(group_id, id, x, y, score) -> (group_id, id): points taken by falling score (ties: the smaller id), none within the radius of one taken before.

    Rounds of whole tables give the same points as going through them one by one: a point without a better undecided neighbour is taken and its
    neighbours go, until all are decided.
    """
    ws = Workspace(points.sparkSession, "spaced")
    points = ws.save(points, "points")
    rank = points.select("group_id", "id", F.struct(F.col("score"), (-F.col("id")).alias("m")).alias("p"))
    near = within_radius(points, radius).select("group_id", "a", "b")
    near = near.join(rank.withColumnsRenamed({"id": "a", "p": "pa"}), ["group_id", "a"]).join(rank.withColumnsRenamed({"id": "b", "p": "pb"}), ["group_id", "b"])
    # (better, worse) of each pair
    near = ws.save(near.select("group_id", F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("better"), F.when(F.col("pa") > F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("worse")), "near")
    left, taken = points.select("group_id", "id"), points.select("group_id", "id").limit(0)
    while near.limit(1).count():
        free = ws.save(left.join(near.select("group_id", F.col("worse").alias("id")).distinct(), ["group_id", "id"], "left_anti"), "free")
        gone = ws.save(near.join(free.withColumnRenamed("id", "better"), ["group_id", "better"], "left_semi").select("group_id", F.col("worse").alias("id")).distinct(), "gone")
        taken = taken.unionByName(free)
        left = ws.save(left.join(free, ["group_id", "id"], "left_anti").join(gone, ["group_id", "id"], "left_anti"), "left")
        for end in ("better", "worse"):
            near = near.join(left.withColumnRenamed("id", end), ["group_id", end], "left_semi")
        near = ws.save(near, "near")
    return taken.unionByName(left)


def affine_fit(matches: DataFrame, at_least: int = 3) -> DataFrame:
    """matches(probe_id, image_id, qx, qy, x, y) -> (probe_id, image_id, n, a11, a12, a13, a21, a22, a23, rcond): least squares of x = a11 qx + a12 qy + a13 and y alike.

    The sums of the equations are taken map-side, so a pair is one row when it is solved. rcond is the reciprocal condition of the
    3 x 3 matrix in the maximum-row norm; 0, with null coefficients, where it can't be solved (points on a line).
    """
    terms = {"qx": F.col("qx"), "qy": F.col("qy"), "one": F.lit(1.0)}
    sums = [F.sum(a * b).alias(f"s_{i}_{j}") for i, a in terms.items() for j, b in terms.items() if i <= j]
    sums += [F.sum(a * F.col(t)).alias(f"t_{i}_{t}") for i, a in terms.items() for t in ("x", "y")]
    rows = matches.groupBy(*PAIR).agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= at_least)
    names = list(terms)

    def solve(batches):
        for b in batches:
            m = np.stack([np.stack([b[f"s_{min(i, j)}_{max(i, j)}"] for j in names], 1) for i in names], 1)
            r = np.stack([np.stack([b[f"t_{i}_{t}"] for t in ("x", "y")], 1) for i in names], 1)
            ok = np.abs(np.linalg.det(m)) > 1e-9
            inverse = np.full(m.shape, np.nan)
            inverse[ok] = np.linalg.inv(m[ok])
            norm = lambda v: np.abs(v).sum(2).max(1)
            c = inverse @ r
            out = {"probe_id": b["probe_id"], "image_id": b["image_id"], "n": b["n"]} | {f"a{t + 1}{i + 1}": pd.Series(c[:, i, t], index=b.index).astype("Float64") for t in (0, 1) for i in range(3)}
            yield pd.DataFrame(out | {"rcond": np.where(ok, 1 / (norm(m) * np.where(ok, norm(inverse), 1)), 0.0)})

    return rows.mapInPandas(solve, "probe_id bigint, image_id bigint, n bigint, a11 double, a12 double, a13 double, a21 double, a22 double, a23 double, rcond double")


def expansion_pairs(members: DataFrame) -> DataFrame:
    """members(group_id, item, is_target) -> (group_id, i, j): i differs from j, and is no target or comes first.

    Targets are so compared once with each other. Groups are the bounded candidate lists of a probe.
    """
    i = members.select("group_id", F.col("item").alias("i"), F.col("is_target").alias("t"))
    j = members.filter("is_target").select("group_id", F.col("item").alias("j"))
    return i.join(j, "group_id").filter("i <> j and (not t or i < j)").select("group_id", "i", "j")


def consistent_inliers(matches: DataFrame, reference: int = 50, tolerance: float = 20.0) -> DataFrame:
    """matches(probe_id, image_id, q_feature, feature_id, dist, qx, qy, q_size, q_angle, x, y, size, angle) -> the largest consistent set of each pair.

    Each of the ``reference`` nearest matches proposes the similarity transform of its two key points; the matches that it puts within ``tolerance``
    pixels are its inliers. The proposal with most inliers wins (ties: the nearer match).
    """
    over = Window.partitionBy(*PAIR).orderBy("dist", "q_feature", "feature_id")
    m = matches.withColumn("nth", F.row_number().over(over))
    r = m.filter(F.col("nth") <= reference).select(*PAIR, F.col("nth").alias("ref"), *(F.col(c).alias("r_" + c) for c in ("qx", "qy", "q_size", "q_angle", "x", "y", "size", "angle")))
    turn, scale = F.radians(F.col("r_angle") - F.col("r_q_angle")), F.col("r_size") / F.col("r_q_size")
    dx, dy = (F.col("qx") - F.col("r_qx")) * scale, (F.col("qy") - F.col("r_qy")) * scale
    ex = F.col("r_x") + dx * F.cos(turn) - dy * F.sin(turn) - F.col("x")
    ey = F.col("r_y") + dx * F.sin(turn) + dy * F.cos(turn) - F.col("y")
    inliers = m.join(r, list(PAIR)).filter(ex * ex + ey * ey < tolerance * tolerance)
    best = inliers.groupBy(*PAIR, "ref").agg(F.count("*").alias("n")).groupBy(*PAIR).agg(F.max(F.struct("n", (-F.col("ref")).alias("m")))["m"].alias("m"))
    return inliers.join(best.select(*PAIR, (-F.col("m")).alias("ref")), [*PAIR, "ref"]).select(*matches.columns)
