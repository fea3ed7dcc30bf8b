"""Global numbering without a single-task window: running numbers, contiguous ranges, batches, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import Workspace


def numbered(rows: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Rows with a dense number from 0 in the given order, which should be unique.

    Rows are range-partitioned and numbered within their partition; a table with one row for each partition turns that into global numbers.
    """
    ws = Workspace(rows.sparkSession, "numbered")
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ws.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_here": here}), "placed")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_here")).drop("_part", "_here", "_start")


def running_total(rows: DataFrame, value: str, *order: str, name: str = "so_far") -> DataFrame:
    """Rows with the sum of ``value`` up to and with each row in the given order: totals within range partitions, then the partitions' own totals."""
    ws = Workspace(rows.sparkSession, "running")
    placed = ws.save(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("t"))
    before = F.sum("t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    here = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_here", here).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_here")).drop("_part", "_here", "_start")


def range_of(row_no: Column, rows: int, parts: int) -> Column:
    """The contiguous range that a row falls into when ``rows`` rows are dealt to ``parts`` ranges of equal size, the last one shorter."""
    return F.floor(row_no / -(-max(rows, 1) // parts)).cast("bigint")


def batch_of(row_no: Column, size: int) -> Column:
    return F.floor(row_no / size).cast("bigint")


def shard_offsets(rows: DataFrame, shard: str, *counts: str) -> DataFrame:
    """(shard, the distinct numbers of each counted column, and where each shard starts): running offsets over shards, of which there are few."""
    per = rows.groupBy(shard).agg(*(F.count_distinct(c).alias("n_" + c) for c in counts))
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(shard, *("n_" + c for c in counts), *(F.coalesce(F.sum("n_" + c).over(before), F.lit(0)).alias("start_" + c) for c in counts))


def offset_union(shards: list[DataFrame], number: str) -> DataFrame:
    """Rows of all shards, whose numbers each start from 0, with numbers that go on from one shard to the next, and the shard's place."""
    out, start = None, 0
    for k, shard in enumerate(shards):
        part = shard.withColumns({number: F.col(number) + start, "shard_no": F.lit(k)})
        out = part if out is None else out.unionByName(part)
        start += shard.count()
    return out
