"""From feature hits to scores of images: vote tallies, re-ranking, and geometric consistency.

Hits are (probe_id, q_feature, feature_id, image_id, dist, rank) and, for geometry, the key points of both sides
(qx, qy, q_size, q_angle, x, y, size, angle) and the image's width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provq.functions import vectors as V

PAIR = ("probe_id", "image_id")


def similarity(dist: Column) -> Column:
    return 1 / (1 + F.sqrt(dist))


def usable_hits(hits: DataFrame, most: float | None = None) -> DataFrame:
    """Hits with a finite distance, of ``most`` at the most where given."""
    out = hits.filter(F.col("dist").isNotNull() & ~F.isnan("dist") & (F.col("dist") < float("inf")))
    return out if most is None else out.filter(F.col("dist") <= most)


def tally(hits: DataFrame) -> DataFrame:
    """(probe_id, image_id, score, n_votes): the sum of 1 / (1 + distance)."""
    return usable_hits(hits).groupBy(*PAIR).agg(F.sum(1 / (1 + F.col("dist"))).alias("score"), F.count("*").alias("n_votes"))


def reciprocal_rank(hits: DataFrame) -> DataFrame:
    """(probe_id, image_id, score): the sum of 1 / rank, ranks from 1."""
    return usable_hits(hits).groupBy(*PAIR).agg(F.sum(1 / F.col("rank")).alias("score"))


def first_feature_votes(hits: DataFrame) -> DataFrame:
    """(probe_id, image_id, n_votes): unweighted votes of each probe's first feature only."""
    first = hits.groupBy("probe_id").agg(F.min("q_feature").alias("q_feature"))
    return hits.join(first, ["probe_id", "q_feature"], "left_semi").groupBy(*PAIR).agg(F.count("*").alias("n_votes"))


def adaptive_rerank(hits: DataFrame, most: float = 100.0) -> DataFrame:
    """Adds ``gap``: how far a hit is ahead of the query's worst distance up to ``most``; never negative."""
    worst = F.max(F.when(F.col("dist") <= most, F.col("dist"))).over(Window.partitionBy("q_feature"))
    return hits.withColumn("gap", F.greatest(F.lit(0.0), worst - F.col("dist")))


def inverse_rerank(hits: DataFrame) -> DataFrame:
    return hits.withColumn("inverse", 1 / (1 + F.col("dist")))


def distance_gate(hits: DataFrame, most: float = 10.0, more_than: int = 3) -> DataFrame:
    """(probe_id, image_id, n, mean_dist): groups of more than ``more_than`` hits whose mean or median is below the mean plus one deviation of all hits.

    Only hits with a distance of at most ``most`` count.
    """
    kept = usable_hits(hits, most)
    limit = kept.agg(F.round(F.avg("dist") + F.stddev_pop("dist"), 9).alias("limit"))
    groups = kept.groupBy(*PAIR).agg(F.count("*").alias("n"), F.round(F.avg("dist"), 9).alias("mean_dist"), F.round(F.percentile("dist", F.lit(0.5)), 9).alias("median"))
    return groups.join(F.broadcast(limit)).filter((F.col("n") > more_than) & ((F.col("mean_dist") < F.col("limit")) | (F.col("median") < F.col("limit")))).select(*PAIR, "n", "mean_dist")  # one row


def weighted_centroid(hits: DataFrame) -> DataFrame:
    """(probe_id, image_id, cx, cy): the query's key points weighted by similarity."""
    w = similarity(F.col("dist"))
    return usable_hits(hits).groupBy(*PAIR).agg((F.sum(F.col("qx") * w) / F.sum(w)).alias("cx"), (F.sum(F.col("qy") * w) / F.sum(w)).alias("cy"))


def projected_votes(hits: DataFrame) -> DataFrame:
    """Each hit with ``w`` and the point (vx, vy) of the image where its key point puts the query's centroid."""
    h = usable_hits(hits).withColumn("w", similarity(F.col("dist")))
    over = Window.partitionBy(*PAIR)
    cx, cy = (F.sum(F.col(c) * F.col("w")).over(over) / F.sum("w").over(over) for c in ("qx", "qy"))
    turn, scale = F.radians(F.col("angle") - F.col("q_angle")), F.col("size") / F.col("q_size")
    h = h.withColumns({"ax": (cx - F.col("qx")) * scale, "ay": (cy - F.col("qy")) * scale, "turn": turn})
    vx = F.col("x") + F.col("ax") * F.cos("turn") - F.col("ay") * F.sin("turn")
    vy = F.col("y") + F.col("ax") * F.sin("turn") + F.col("ay") * F.cos("turn")
    # nine places keep a vote on a bin's edge in the same bin whatever the order of the sums
    return h.withColumns({"vx": F.round(vx, 9), "vy": F.round(vy, 9)}).drop("ax", "ay", "turn")


def voted_bins(hits: DataFrame) -> DataFrame:
    """Votes in four overlapping grids, after repeated votes are removed: adds bin_size, grid (0-3), xb, yb.

    A query feature counts once in a bin, with its best rank; then a database feature counts once in a bin, with the smallest query feature.
    """
    v = projected_votes(hits).withColumn("bin_size", V.bin_size(F.col("width"), F.col("height"), 4, 0.8))
    half = F.col("bin_size") / 2
    grids = F.array(*(F.struct(F.lit(g).alias("grid"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for g, (x, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))))
    v = v.withColumn("g", F.explode(grids)).withColumns({"grid": F.col("g.grid"), "xb": V.grid_bin(F.col("vx") - half * F.col("g.sx"), F.col("bin_size")), "yb": V.grid_bin(F.col("vy") - half * F.col("g.sy"), F.col("bin_size"))}).drop("g")
    at = [*PAIR, "grid", "xb", "yb"]
    once = F.row_number().over(Window.partitionBy(*at, "q_feature").orderBy("rank"))
    v = v.withColumn("nth", once).filter("nth = 1")
    back = F.row_number().over(Window.partitionBy(*at, "feature_id").orderBy("q_feature"))
    return v.withColumn("nth", back).filter("nth = 1").drop("nth")


def hough_bins(hits: DataFrame) -> DataFrame:
    """(probe_id, image_id, grid, xb, yb, n): votes in each bin."""
    return voted_bins(hits).groupBy(*PAIR, "grid", "xb", "yb").agg(F.count("*").alias("n"))


def geometric_score(hits: DataFrame) -> DataFrame:
    """(probe_id, image_id, grid, n, score): how consistently the hits of an image agree on where the query lies in it.

    The fullest bin counts (equal ones: the earlier grid, then the larger bin); its votes w are damped by their distance from the bin's mean
    and their sum is multiplied by the binary logarithm of their number.
    """
    votes = voted_bins(hits)
    bins = votes.groupBy(*PAIR, "grid", "xb", "yb").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*PAIR).orderBy(F.col("n").desc(), "grid", F.col("xb").desc(), F.col("yb").desc())
    best = bins.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
    kept = votes.join(best, [*PAIR, "grid", "xb", "yb"])
    over = Window.partitionBy(*PAIR)
    dx, dy = (F.col(c) - F.avg(c).over(over) for c in ("vx", "vy"))
    near = V.bin_size(F.col("width"), F.col("height"), 6, 0.9)
    kept = kept.withColumns({"d2": dx * dx + dy * dy, "near": near})
    total = F.sum(F.col("w") * F.exp(-F.col("d2") / (F.col("near") * F.col("near")) / 4.5))
    scored = kept.groupBy(*PAIR).agg(F.max("grid").alias("grid"), F.max("n").alias("n"), total.alias("s"))
    return scored.select(*PAIR, "grid", "n", (F.when(F.col("s") == 0, 1e-5).otherwise(F.col("s")) * F.log2("n")).alias("score"))


def densest_cell(points: DataFrame, size: float) -> DataFrame:
    """points(image_id, x, y) -> (image_id, grid, xb, yb, n): the fullest cell of three shifted grids; ties: first grid, lowest cell."""
    shifts = F.array(*(F.struct(F.lit(g).alias("grid"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for g, (x, y) in enumerate(((0.0, 0.0), (size / 2, 0.0), (0.0, size / 2)))))
    p = points.withColumn("g", F.explode(shifts)).select("image_id", "g.grid", F.floor((F.col("x") - F.col("g.sx")) / size).alias("xb"), F.floor((F.col("y") - F.col("g.sy")) / size).alias("yb"))
    n = p.groupBy("image_id", "grid", "xb", "yb").agg(F.count("*").alias("n"))
    order = Window.partitionBy("image_id").orderBy(F.col("n").desc(), "grid", "xb", "yb")
    return n.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def merged_tally(parts: list[DataFrame], k: int) -> DataFrame:
    """(probe_id, image_id, score): hits of several parts of an index in one order by distance, cut to one and a half times k a query, and tallied."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    nth = F.row_number().over(Window.partitionBy("q_feature").orderBy("dist", "feature_id"))
    return tally(both.withColumn("nth", nth).filter(F.col("nth") <= k + k // 2)).drop("n_votes")


def object_scores(hits: DataFrame, least: float, n: int) -> DataFrame:
    """hits with an object -> (probe_id, object, image_id, score, n_features, rank): the n best images of each object whose best score is above ``least``."""
    t = usable_hits(hits).groupBy("probe_id", "object", "image_id").agg(F.round(F.sum(1 / (1 + F.col("dist"))), 6).alias("score"), F.count_distinct("q_feature").alias("n_features"))
    over = Window.partitionBy("probe_id", "object")
    ranked = t.withColumns({"rank": F.row_number().over(over.orderBy(F.col("score").desc(), "image_id")), "top": F.max("score").over(over)})
    return ranked.filter((F.col("rank") <= n) & (F.col("top") > least)).drop("top")


def in_bounds() -> Column:
    """True for a vote that falls into its image."""
    return (F.col("vx") >= 0) & (F.col("vx") < F.col("width")) & (F.col("vy") >= 0) & (F.col("vy") < F.col("height"))


def winning_votes(hits: DataFrame) -> DataFrame:
    """The votes of each image's fullest bin (equal ones: the earlier grid, then the larger bin)."""
    votes = voted_bins(hits)
    bins = votes.groupBy(*PAIR, "grid", "xb", "yb").agg(F.count("*").alias("members"))
    order = Window.partitionBy(*PAIR).orderBy(F.col("members").desc(), "grid", F.col("xb").desc(), F.col("yb").desc())
    return votes.join(bins.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth"), [*PAIR, "grid", "xb", "yb"])


def coherence(hits: DataFrame) -> DataFrame:
    """(probe_id, image_id, n, angle_coherence, point_coherence) of the winning votes: how little their turns and places spread."""
    turn = F.pmod(F.col("angle") - F.col("q_angle"), F.lit(360.0))
    spread = F.stddev_pop("vx") + F.stddev_pop("vy")
    return winning_votes(hits).groupBy(*PAIR).agg(F.count("*").alias("n"), (1 / (1 + F.stddev_pop(turn) / F.count("*"))).alias("angle_coherence"), (1 / (1 + F.pow(spread, F.lit(0.125)) / 2)).alias("point_coherence"))
