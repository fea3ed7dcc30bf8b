"""Filling containers of fixed capacity with items of varying length.

Method: minimum bin slack over the histogram of lengths. All that the choice needs is how many items each length has,
a table of at most ``capacity`` counts however many items there are. From it, containers are planned one kind at a time: the
longest remaining length goes in, a bitset subset-sum over the remaining lengths (with their counts, by binary
splitting) tells which fillings can be reached, and the one closest to the capacity is traced back to counts. A kind is
repeated as often as the remaining counts allow, which uses up at least one length, so there are at most ``capacity`` kinds
and the plan is a table bounded by the capacity. Items are then numbered within their length, in parallel over salted
buckets, and look up their container in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import Workspace

#: Salt buckets within which items of one length are numbered; grows with the rows, see ``pack``.
ROWS_PER_BUCKET = 50_000


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths with their counts, the multiset whose sum is the largest that fits ``room``."""
    steps: list[tuple[int, int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


@dataclass(frozen=True)
class Kind:
    """``times`` containers, each filled with ``parts`` (length -> count)."""

    first: int
    times: int
    parts: dict[int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Kind]:
    """The kinds of containers that hold all items of a histogram of lengths (each 1 to ``capacity``)."""
    left = {k: v for k, v in counts.items() if v > 0}
    kinds, first = [], 0
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if k <= capacity - longest and v > (k == longest)}
        parts = best_filling(rest, capacity - longest)
        parts[longest] = parts.get(longest, 0) + 1
        times = min(left[k] // n for k, n in parts.items())
        kinds.append(Kind(first, times, dict(sorted(parts.items(), reverse=True))))
        first += times
        for k, n in parts.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return kinds


def _lookup(kinds: list[Kind]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by its items' numbers: where each kind's share starts, its first container, its items in one container and where they start in it."""
    at: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    for kind in kinds:
        offset = 0
        for length, n in kind.parts.items():
            start = at.get(length, 0)
            rows.setdefault(length, []).append((start, kind.first, n, offset))
            at[length] = start + n * kind.times
            offset += length * n
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in rows.items()}


def pack(items: DataFrame, *, key: str = "doc_id", tokens: str = "tokens", capacity: int = 2048) -> DataFrame:
    """(key, piece BIGINT, container BIGINT, start BIGINT, length BIGINT): where each piece of each item lies.

    An item longer than the capacity is split into pieces of the capacity and one rest (piece 0, 1, ...); any other item is
    one piece. start is the piece's first position in its container. Containers are numbered from 0 without gaps.

    Defined cases: items with a null, zero or negative length need no container and have no row; rows with equal keys are
    items of their own, null keys too; items of equal length are told apart by key, then by nothing else; other columns are
    ignored; an empty table gives none.
    """
    spark = items.sparkSession
    ws = Workspace(spark, "pack")
    sized = items.select(F.col(key).alias("key"), F.col(tokens).cast("bigint").alias("n")).filter(F.col("n") > 0)
    pieces = sized.select("key", F.explode(F.expr(f"transform(sequence(0, (n - 1) div {capacity}), i -> named_struct('piece', i, 'length', least(n - i * {capacity}, {capacity})))")).alias("p")).select("key", F.col("p.piece").cast("bigint").alias("piece"), F.col("p.length").cast("bigint").alias("length"))
    pieces = ws.save(pieces, "pieces")
    rows = pieces.count()
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    per_bucket = ws.save(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    lookup = _lookup(plan(counts, capacity))
    offsets = per_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("key", "piece")
    numbered = pieces.withColumn("rn", F.row_number().over(order)).join(offsets, ["length", "bucket"]).select("key", "piece", "length", (F.col("before") + F.col("rn") - 1).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            container, start = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                starts, firsts, each, offset = lookup[int(k)]
                i = np.searchsorted(starts, number[at], side="right") - 1
                o = number[at] - starts[i]
                container[at] = firsts[i] + o // each[i]
                start[at] = offset[i] + o % each[i] * k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(container), pa.array(start), b.column(2)], ["key", "piece", "container", "start", "length"])

    return numbered.mapInArrow(place, f"key {numbered.schema['key'].dataType.simpleString()}, piece bigint, container bigint, start bigint, length bigint")
