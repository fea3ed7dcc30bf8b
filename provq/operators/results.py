"""Result sets (group, item, score): merging, normalising, cutting, candidates, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import is_finite


def _clean(rows: DataFrame, item: str, score: str) -> DataFrame:
    return rows.filter(F.col(item).isNotNull() & is_finite(F.col(score)))


def merge_max(rows: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(group, item, score): an item's highest score. Merging results again, or in another order, changes nothing."""
    return _clean(rows, item, score).groupBy(group, item).agg(F.max(score).alias("score"))


def merge_last(rows: DataFrame, group: str, item: str, score: str, order: str) -> DataFrame:
    """(group, item, score): the score written last; of equal times the highest."""
    return _clean(rows, item, score).groupBy(group, item).agg(F.max(F.struct(order, score))[score].alias("score"))


def normalise(merged: DataFrame, group: str) -> DataFrame:
    """Scores divided by the highest of their group; a group whose highest is 0 keeps its scores."""
    top = F.max("score").over(Window.partitionBy(group))
    return merged.withColumn("score", F.when(top != 0, F.col("score") / top).otherwise(F.col("score")))


def min_max(merged: DataFrame, group: str) -> DataFrame:
    """Scores mapped to 0 to 1 within their group; a group of one value gives 0."""
    over = Window.partitionBy(group)
    low, high = F.min("score").over(over), F.max("score").over(over)
    return merged.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0))


def clipped(merged: DataFrame, group: str, deviations: float) -> DataFrame:
    """Scores clipped to that many deviations around their group's mean."""
    over = Window.partitionBy(group)
    mean, room = F.avg("score").over(over), F.stddev_pop("score").over(over) * deviations
    return merged.withColumn("score", F.least(F.greatest("score", mean - room), mean + room))


def first(merged: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The n best items of each group with their rank; equal scores by item."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), item))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= n)


def named_candidates(merged: DataFrame, names: DataFrame, group: str, item: str, n: int, factor: int = 10) -> DataFrame:
    """The n best items that have a name: the first ``factor * n`` are looked up in names(item), unnamed ones dropped, the rest cut to n."""
    return first(first(merged, group, item, factor * n).drop("rank").join(names, item), group, item, n)


def without(merged: DataFrame, ignored: DataFrame, item: str) -> DataFrame:
    return merged.join(ignored.select(item).distinct(), item, "left_anti")


def documents(top: DataFrame, group: str, file: str, fileid: str) -> DataFrame:
    """(group, document STRING): one JSON document for each group, nodes in the order of rank, ids from "1", no links."""
    node = F.struct("rank", F.col("rank").cast("string").alias("id"), F.col(file).alias("file"), F.col(fileid).alias("fileid"), F.col("score").alias("nodeConfidenceScore"))
    nodes = top.groupBy(group).agg(F.sort_array(F.collect_list(node)).alias("n"))  # as many as the cut left
    nodes = nodes.select(group, F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["file"].alias("file"), x["fileid"].alias("fileid"), x["nodeConfidenceScore"].alias("nodeConfidenceScore"))).alias("nodes"))
    return nodes.select(group, F.to_json(F.struct(F.lit(True).alias("directed"), "nodes", F.array().cast("array<struct<source:string,target:string>>").alias("links"))).alias("document"))


DOCUMENT = "directed boolean, nodes array<struct<id:string,file:string,fileid:string,nodeConfidenceScore:double>>, links array<struct<source:string,target:string,relationshipConfidenceScore:double>>"


def nodes_of(docs: DataFrame, group: str) -> DataFrame:
    """(group, id, file, fileid, nodeConfidenceScore): the nodes of JSON documents; unreadable documents give none."""
    return docs.select(group, F.explode(F.from_json("document", DOCUMENT)["nodes"]).alias("n")).select(group, "n.*")


def envelope(algorithm: str, version: str, **parts) -> "F.Column":
    """A result envelope: the algorithm (name without blanks) and the given columns."""
    return F.struct(F.struct(F.lit(algorithm.replace(" ", "")).alias("name"), F.lit(version).alias("version")).alias("algorithm"), *(c.alias(k) for k, c in parts.items()))


def remapped(rows: DataFrame, first_names: DataFrame, then: DataFrame, item: str) -> DataFrame:
    """Items replaced by the name that the first table (item, name) has, else the second, else left."""
    a, b = first_names.select(item, F.col("name").alias("_a")), then.select(item, F.col("name").alias("_b"))
    return rows.join(a, item, "left").join(b, item, "left").withColumn(item, F.coalesce("_a", "_b", item)).drop("_a", "_b")


def padded(top: DataFrame, group: str, k: int) -> DataFrame:
    """Rows of ranks 1 to k for each group; ranks that it doesn't have are null but for group and rank."""
    ranks = top.select(group).distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return ranks.join(top, [group, "rank"], "left")


def rewritten(docs: DataFrame, group: str, names: DataFrame) -> DataFrame:
    """(group, document): documents whose nodes' files are replaced by names(fileid, name), in their order; nodes without a name stay."""
    nodes = docs.select(group, F.posexplode(F.from_json("document", DOCUMENT)["nodes"]).alias("rank", "n")).select(group, "rank", "n.*").join(names, "fileid", "left")
    top = nodes.withColumns({"file": F.coalesce("name", "file"), "rank": F.col("rank") + 1, "score": F.col("nodeConfidenceScore")})
    return documents(top, group, "file", "fileid")


def centralities(removed: DataFrame) -> DataFrame:
    """(document): one JSON document of the removed nodes and their degrees in the order of removal, which are few."""
    return removed.agg(F.to_json(F.sort_array(F.collect_list(F.struct("round", "node", "degree")))).alias("document"))
