"""Evaluation of ranked results against ground truth, and statistics of value pairs.

Results are (probe_id, file, rank), truth (probe_id, file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANKS = (25, 50, 100, 200, 300, 400)


def correct(results: DataFrame, truth: DataFrame) -> DataFrame:
    return results.join(truth.distinct(), ["probe_id", "file"], "left_semi")


def erroneous(results: DataFrame, truth: DataFrame) -> DataFrame:
    return results.join(truth.distinct(), ["probe_id", "file"], "left_anti")


def missing(results: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.distinct().join(results.select("probe_id", "file").distinct(), ["probe_id", "file"], "left_anti")


def recall_at(results: DataFrame, truth: DataFrame, ranks: tuple[int, ...] = RANKS) -> DataFrame:
    """(r, n_correct, n_truth, recall): over all probes of the truth; an empty truth counts as one."""
    best = results.groupBy("probe_id", "file").agg(F.min("rank").alias("rank"))
    t = truth.distinct().join(best, ["probe_id", "file"], "left")
    cuts = t.select("rank", F.explode(F.array(*map(F.lit, ranks))).alias("r"))
    hit = F.coalesce((F.col("rank") <= F.col("r")).cast("int"), F.lit(0))
    return cuts.groupBy("r").agg(F.sum(hit).alias("n_correct"), F.count("*").alias("n_truth")).withColumn("recall", F.col("n_correct") / F.greatest("n_truth", F.lit(1)))


def in_world(rows: DataFrame, world: DataFrame) -> DataFrame:
    """Rows whose file the world (file) holds."""
    return rows.join(world.select("file").distinct(), "file", "left_semi")


def unused(truth: DataFrame, world: DataFrame) -> DataFrame:
    """Files of the truth that no result can hold, as the world doesn't."""
    return truth.distinct().join(world.select("file").distinct(), "file", "left_anti").select("probe_id", "file")


def precision_at(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(probe_id, precision): the share of k that the true ones among a probe's first k make up."""
    first = results.filter(F.col("rank") <= k).select("probe_id", "file")
    return first.join(truth.distinct().withColumn("hit", F.lit(1)), ["probe_id", "file"], "left").groupBy("probe_id").agg((F.count("hit") / F.lit(float(k))).alias("precision"))


def sweep(queries: DataFrame, base: DataFrame, centroids: list[list[float]], k: int, nprobes: tuple[int, ...]) -> DataFrame:
    """(nprobe, n_queries, share): the intersection with the exact first k for several numbers of probed cells."""
    from provq.operators import search

    rows, levels = search.probed_levels(queries, base, centroids, k, nprobes)
    near = Window.partitionBy("q").orderBy("dist", "feature_id")
    found = [F.coalesce((F.col("level") <= v) & (F.sum((F.col("level") <= v).cast("int")).over(near) <= k), F.lit(False)) for v in range(len(levels))]
    rows = rows.select("q", *(f.alias(f"in_{n}") for n, f in zip(levels, found)))
    exact = F.col(f"in_{levels[-1]}")  # all cells are probed
    shared = rows.groupBy("q").agg(*(F.sum((F.col(f"in_{n}") & exact).cast("bigint")).alias(f"n_{n}") for n in levels))
    total = shared.agg(F.count("*").alias("n_queries"), *(F.sum(f"n_{n}").alias(f"n_{n}") for n in levels))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("nprobe"), F.col(f"n_{min(n, len(centroids))}").alias("n")) for n in nprobes)))
    return total.select("n_queries", each.alias("s")).filter("n_queries > 0").select("s.nprobe", "n_queries", (F.col("s.n") / (F.lit(float(k)) * F.col("n_queries"))).alias("share"))


def otsu_threshold(rows: DataFrame, group: str, level: str) -> DataFrame:
    """(group, threshold): the level up to which a cut separates a group's values with the highest variance between both sides (ties: the lowest).

    level: whole numbers of a bounded range, such as 256 grey levels, so that windows run over levels, not rows. A group of one level has none.
    """
    h = rows.filter(F.col(level).isNotNull()).groupBy(group, F.col(level).cast("int").alias("threshold")).agg(F.count("*").alias("n"))
    run, whole = Window.partitionBy(group).orderBy("threshold"), Window.partitionBy(group)
    weighted = F.col("n") * F.col("threshold")
    h = h.withColumns({"n0": F.sum("n").over(run), "s0": F.sum(weighted).over(run), "t": F.sum("n").over(whole), "st": F.sum(weighted).over(whole)}).filter("n0 < t")
    share, apart = F.col("n0") / F.col("t"), F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / (F.col("t") - F.col("n0"))
    best = F.row_number().over(whole.orderBy(F.round(share * (1 - share) * apart * apart, 6).desc(), "threshold"))
    return h.withColumn("nth", best).filter("nth = 1").select(group, "threshold")


def intersection_at(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(n_queries, share): of the exact first k of all queries (q, feature_id, rank), the share that was found among the first k."""
    e, f = exact.filter(F.col("rank") <= k), found.filter(F.col("rank") <= k)
    both = e.join(f.select("q", "feature_id", F.lit(1).alias("hit")), ["q", "feature_id"], "left")
    return both.agg(F.countDistinct("q").alias("n_queries"), (F.count("hit") / (k * F.countDistinct("q"))).alias("share"))


def mutual_information(rows: DataFrame, group: str, a: str, b: str, bins: int) -> DataFrame:
    """(group, n, mi): mutual information in bits of two columns over ``bins`` equal bins of each one's range in the group.

    The range is widened by half a bin at both ends; a range of at most 1 gives 0. Nulls and NaN don't count.
    """
    r = rows.select(F.col(group).alias("g"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    span = r.groupBy("g").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))

    def bin_of(c: str):
        width = (F.col(c + "1") - F.col(c + "0")) / (bins - 1)
        return F.least(F.floor(F.round((F.col(c) - F.col(c + "0")) / width + 0.5, 9)), F.lit(bins - 1))

    binned = r.join(span, "g").withColumn("flat", (F.col("a1") - F.col("a0") <= 1) | (F.col("b1") - F.col("b0") <= 1))
    joint = binned.groupBy("g", "flat", F.when(~F.col("flat"), bin_of("a")).alias("x"), F.when(~F.col("flat"), bin_of("b")).alias("y")).agg(F.count("*").alias("n"))
    g, gx, gy = (Window.partitionBy("g", *c) for c in ((), ("x",), ("y",)))
    j = joint.withColumns({"t": F.sum("n").over(g), "nx": F.sum("n").over(gx), "ny": F.sum("n").over(gy)})
    term = F.when(F.col("flat"), 0.0).otherwise(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    return j.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("n"), F.sum(term).alias("mi"))


def distribution_match(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(value, matched): each value of column a and the smallest value of b whose share of values up to it is at least a's.

    Shares are taken over distinct values with counts. Both columns are range-partitioned; totals and the next value pass from one range to another.
    """
    from provq.operators import ranges
    from provq.runtime import Workspace

    ws = Workspace(rows.sparkSession, "distribution")

    def shares(c: str, v: str) -> DataFrame:
        counts = ws.save(rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(v)).agg(F.count("*").alias("n")), "counts")
        total = counts.agg(F.sum("n").alias("t"))
        return ranges.running_total(counts, "n", v).crossJoin(F.broadcast(total)).select(v, F.round(F.col("so_far") / F.col("t"), 9).alias("s"))  # one row

    x, y = shares(a, "value"), shares(b, "matched")
    both = x.select("s", "value", F.lit(None).cast("double").alias("matched")).unionByName(y.select("s", F.lit(None).cast("double").alias("value"), "matched"))
    placed = ws.save(both.repartitionByRange("s").withColumn("_part", F.spark_partition_id()), "placed")
    here = F.min("matched").over(Window.partitionBy("_part").orderBy("s").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    later = F.min("least").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing))  # one row for each range
    after = placed.groupBy("_part").agg(F.min("matched").alias("least")).select("_part", later.alias("later"))
    out = placed.withColumn("here", here).filter("value is not null").join(F.broadcast(after), "_part")
    return out.select("value", F.coalesce("here", "later").alias("matched"))


def mean_squared_error(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"))
