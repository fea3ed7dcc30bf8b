"""Top N items within every group.

Method: ``row_number`` over the group ordered by score and identifier with a rank filter. Catalyst turns the filter into
WindowGroupLimit operators before and after the exchange, so that a group of millions of rows leaves each map task
as N rows at most. Repeated items are first reduced to their best score by (group, item), which is combined map-side and
spread by both columns, so that no group is gathered in a task. The planner limits groups up to a threshold only; beyond it the N best of
each of a group's parts are taken first, by the same window over group and part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import is_finite


#: Parts of a group from which the N best are taken first where N is above the planner's threshold.
PARTS = 64


def top_n(rows: DataFrame, *, group: str = "probe_id", item: str = "fileid", score: str = "nodeConfidenceScore", n: int = 10) -> DataFrame:
    """(group_key, item_key, best, rank): the N items of the highest score of each group.

    Defined cases: rows with a null item or a score that is null, NaN or infinite do not count; an item counts once in
    its group, with its highest score; -0.0 equals 0.0; equal scores go by the item ascending (strings by code point); a null group is a
    group of its own; groups with fewer items give fewer rows, empty tables none; other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    kept = rows.select(F.col(group).alias("group_key"), F.col(item).alias("item_key"), (F.col(score).cast("double") + F.lit(0.0)).alias("best"))
    kept = kept.filter(F.col("item_key").isNotNull() & is_finite(F.col("best")))
    best = kept.groupBy("group_key", "item_key").agg(F.max("best").alias("best"))
    by = (F.col("best").desc(), F.col("item_key").asc())
    if n > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = Window.partitionBy("group_key", F.pmod(F.xxhash64("item_key"), F.lit(PARTS))).orderBy(*by)
        best = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= n).drop("rank")
    order = Window.partitionBy("group_key").orderBy(*by)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
