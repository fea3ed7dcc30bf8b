"""Writers of the file formats of the retrieval domain."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provq.functions import names
from provq.operators import ranges


def feature_file(descriptors: np.ndarray, points: np.ndarray, width: int, height: int) -> bytes:
    """The bytes of a feature file, see ``sources.formats.feature_rows``."""
    m = np.concatenate([descriptors, points], axis=1).astype("<f4")
    return m.tobytes() + np.array([*m.shape, width, height], "<f4").tobytes()


def vector_file(vectors: np.ndarray, kind: str) -> bytes:
    m = vectors.astype({"f": "<f4", "i": "<i4", "b": "u1"}[kind])
    return b"".join(np.int32(len(v)).tobytes() + v.tobytes() for v in m)


def container(members: list[bytes]) -> bytes:
    return b"".join(f"{len(m):012d}".encode() + m for m in members)


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't written yet, so a run that was broken off goes on where it stopped."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def result_folder(docs: DataFrame, group: str, folder: str) -> DataFrame:
    """Write one JSON file for each group below a folder that all executors share; returns (group, path). Run it by an action."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            out = []
            for g, d in zip(b[group], b["document"]):
                path = os.path.join(folder, f"{g}.json")
                with open(path + ".part", "w", encoding="utf-8") as f:
                    f.write(d)
                os.replace(path + ".part", path)  # a repeated task leaves the same file
                out.append((g, path))
            yield pd.DataFrame(out, columns=["grp", "path"])

    return docs.select(group, "document").mapInPandas(run, "grp string, path string")


def manifest(rows: DataFrame, path: str) -> None:
    """rows(probe_id, score, output) as a pipe-separated manifest; probes without an output are NonProcessed."""
    m = rows.select(F.col("probe_id").alias("ProvenanceProbeFileID"), F.col("score").alias("ConfidenceScore"), F.col("output").alias("ProvenanceOutputFileName"), F.when(F.col("output").isNull(), "NonProcessed").otherwise("Processed").alias("ProvenanceProbeStatus"))
    m.write.mode("append").option("sep", "|").option("header", "true").csv(path)


def cluster_members(members: DataFrame, algorithm: str) -> DataFrame:
    """members(cluster, member) -> (name, n, member): the file name of each member's cluster; clusters are numbered from the largest (ties: the smaller cluster)."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), (-F.count("*")).alias("less"))
    numbered = ranges.numbered(sizes, "less", "cluster")
    name = names.cluster_file((F.col("row_no") + 1).cast("int"), F.col("n"), algorithm)
    return members.select("cluster", "member").join(numbered.select("cluster", "n", name.alias("name")), "cluster").select("name", "n", "member")


def cluster_folder(members: DataFrame, algorithm: str, path: str) -> None:
    """Write each cluster below the folder, which is emptied first: a sub-folder by its file name, a JSON line for each member, so no cluster is gathered."""
    cluster_members(members, algorithm).write.mode("overwrite").partitionBy("name").json(path)


def cluster_documents(members: DataFrame, algorithm: str) -> DataFrame:
    """members(cluster, member) -> (name, document); a document lists all members of its cluster, so use ``cluster_folder`` where clusters may be large."""
    per = cluster_members(members, algorithm).groupBy("name", "n").agg(F.sort_array(F.collect_list("member")).alias("members"))
    return per.select("name", F.to_json(F.struct("n", "members")).alias("document"))


def result_tree(docs: DataFrame, group: str, path: str) -> None:
    """Write each group's document as text into a sub-folder of its own, on any file system that the session can reach; what is there stays."""
    docs.select(group, "document").write.mode("append").partitionBy(group).text(path)


def progress(completed: DataFrame, unable: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(state, n): how many of the listed are completed, unable and remaining; one that is in both lists counts as completed."""
    done = completed.select(key).distinct().withColumn("state", F.lit("completed"))
    bad = unable.select(key).distinct().join(done, key, "left_anti").withColumn("state", F.lit("unable"))
    rest = listed.select(key).distinct().join(done.unionByName(bad), key, "left")
    return rest.groupBy(F.coalesce("state", F.lit("remaining")).alias("state")).agg(F.count("*").alias("n"))


def query_map(numbered: DataFrame) -> DataFrame:
    """(image_id, q_image, feature_id) -> (document): one JSON line for each query image with its number and its features."""
    per = numbered.groupBy("image_id", "q_image").agg(F.sort_array(F.collect_list("feature_id")).alias("features"))
    return per.select(F.to_json(F.struct("image_id", "q_image", "features")).alias("document"))


def graph_documents(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(probe_id, idx, file, fileid), links(probe_id, source, target, score) -> (probe_id, document): ids from "0", node scores "1"."""
    n = nodes.groupBy("probe_id").agg(F.sort_array(F.collect_list(F.struct("idx", "file", "fileid"))).alias("n"))
    k = links.groupBy("probe_id").agg(F.sort_array(F.collect_list(F.struct("source", "target", F.col("score").alias("relationshipConfidenceScore")))).alias("links"))
    both = n.join(k, "probe_id", "left")
    node = F.transform("n", lambda x: F.struct(x["idx"].cast("string").alias("id"), x["file"].alias("file"), x["fileid"].alias("fileid"), F.lit("1").alias("nodeConfidenceScore")))
    return both.select("probe_id", F.to_json(F.struct(F.lit(True).alias("directed"), node.alias("nodes"), F.coalesce("links", F.array().cast("array<struct<source:int,target:int,relationshipConfidenceScore:double>>")).alias("links"))).alias("document"))


def path_map(rows: DataFrame, root: str) -> str:
    """A JSON map of stems to paths with the root folder; for lists of sources that fit the driver."""
    return json.dumps({"_rootDirectory_": root} | {r["stem"]: r["path"] for r in rows.toLocalIterator()})
