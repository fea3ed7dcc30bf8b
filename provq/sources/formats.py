"""Readers of the file formats of the retrieval domain; all decode in parallel, a file a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provq.functions import names, pixels
from provq.operators import ranges
from provq.operators.results import DOCUMENT


def files(spark: SparkSession, roots: list[str], glob: str | None = None) -> DataFrame:
    """(path, length): files below the roots, without their contents; empty files are not listed."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(roots).select("path", "length")


def source_list(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(stem, path): one file for each stem (the name before its first dot), the first by path."""
    return files(spark, roots).groupBy(names.first_stem(F.col("path")).alias("stem")).agg(F.min("path").alias("path"))


def image_list(spark: SparkSession, roots: list[str]) -> DataFrame:
    return files(spark, roots).filter(names.is_image(F.col("path"))).select("path")


def _contents(spark: SparkSession, roots: list[str], glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(roots).select("path", "content")


def images(spark: SparkSession, roots: list[str], *, flip: bool = False) -> DataFrame:
    """(path, width, height, channels, pixels BINARY): decoded images, brought to the working size where they are too large, upside down if ``flip``.

    An image that can't be decoded has nulls, so that it can be reported; raw camera files are not decoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                m = pixels.decode(content)
                if m is not None and m.shape[0] * m.shape[1] > pixels.TOO_LARGE:
                    m = pixels.resized(m, *pixels.working_size(m.shape[1], m.shape[0]))
                out.append((path, None, None, None, None) if m is None else (path, m.shape[1], m.shape[0], m.shape[2], (m[::-1] if flip else m).tobytes()))
            t = pd.DataFrame(out, columns=["path", "width", "height", "channels", "pixels"])
            yield t.astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return _contents(spark, roots).filter(names.is_image(F.col("path"))).mapInPandas(run, "path string, width int, height int, channels int, pixels binary")


def feature_rows(path: str, content: bytes, dim: int) -> pd.DataFrame:
    """Rows of one feature file: float32 values row by row, then rows, columns, width, height as floats. A file that isn't whole has none."""
    columns = ["path", "feature_no", "descriptor", "x", "y", "size", "angle", "width", "height"]
    a = np.frombuffer(content[: len(content) // 4 * 4], "<f4")
    if len(a) < 4:
        return pd.DataFrame([], columns=columns)
    n, c, w, h = (int(v) if np.isfinite(v) else -1 for v in a[-4:])
    if n <= 0 or c < dim + 4 or len(a) != n * c + 4:
        return pd.DataFrame([], columns=columns)
    m = a[:-4].reshape(n, c)
    p = m[:, dim : dim + 4].astype(float)
    return pd.DataFrame({"path": path, "feature_no": np.arange(n), "descriptor": list(m[:, :dim]), "x": p[:, 0], "y": p[:, 1], "size": p[:, 2], "angle": p[:, 3], "width": w, "height": h})[columns]


def feature_files(spark: SparkSession, roots: list[str], dim: int, glob: str | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                got = feature_rows(path, content, dim)
                if len(got):
                    yield got

    return _contents(spark, roots, glob).mapInPandas(run, "path string, feature_no int, descriptor array<float>, x double, y double, size double, angle double, width int, height int")


def vector_rows(content: bytes, kind: str) -> np.ndarray:
    """Vectors of an fvecs, ivecs or bvecs file: each is its length as int32 and its elements; the last one may be cut off and is then left out."""
    size = {"f": 4, "i": 4, "b": 1}[kind]
    if len(content) < 4:
        return np.empty((0, 0))
    d = int(np.frombuffer(content[:4], "<i4")[0])
    step = 4 + d * size
    n = len(content) // step
    body = np.frombuffer(content[: n * step], np.uint8).reshape(n, step)[:, 4:]
    return np.ascontiguousarray(body).view({"f": "<f4", "i": "<i4", "b": "u1"}[kind])


def vector_files(spark: SparkSession, roots: list[str], kind: str) -> DataFrame:
    """(path, row_no, vector) of fvecs ("f"), ivecs ("i") or bvecs ("b") files."""
    element = {"f": "float", "i": "int", "b": "smallint"}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                m = vector_rows(content, kind)
                for s in range(0, len(m), 10_000):
                    part = m[s : s + 10_000]
                    yield pd.DataFrame({"path": path, "row_no": np.arange(s, s + len(part)), "vector": [v.tolist() for v in part]})

    return _contents(spark, roots, f"*.{kind}vecs").mapInPandas(run, f"path string, row_no bigint, vector array<{element}>")


def members(content: bytes) -> list[bytes]:
    """Members of a container: each is 12 ASCII digits of length and its bytes. A cut-off end raises."""
    out, at = [], 0
    while at < len(content):
        n = int(content[at : at + 12])
        if at + 12 + n > len(content):
            raise ValueError("the container ends within a member")
        out.append(content[at + 12 : at + 12 + n])
        at += 12 + n
    return out


def containers(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, member_no, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                m = members(content)
                yield pd.DataFrame({"path": path, "member_no": range(len(m)), "content": m})

    return _contents(spark, roots).mapInPandas(run, "path string, member_no int, content binary")


def piped(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-separated table with a header, all columns as text."""
    return spark.read.option("sep", "|").option("header", "true").csv(path)


def world_index(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(file): paths of a world index, its WorldFileName below the data set's root."""
    return piped(spark, path).filter("WorldFileName is not null").select(F.concat_ws("/", F.lit(root.rstrip("/")), "WorldFileName").alias("file"))


def probes(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(probe_id, file): probes of a pipe-separated table, or of a plain list of one path a line.

    The file is ProvenanceProbeFileName, else WorldFileName, else, with known(stem, path), the path of WorldFileID; rows without one go.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head or "|" not in head[0][0]:
        return spark.read.text(path).filter(F.trim("value") != "").select(names.last_stem(F.trim("value")).alias("probe_id"), F.trim("value").alias("file"))
    t = piped(spark, path)
    for c in ("ProvenanceProbeFileName", "WorldFileName"):
        if c in t.columns:
            key = F.col("ProvenanceProbeFileID") if "ProvenanceProbeFileID" in t.columns else names.last_stem(F.col(c))
            return t.filter(F.col(c).isNotNull()).select(key.alias("probe_id"), F.col(c).alias("file"))
    if known is None or "WorldFileID" not in t.columns:
        raise ValueError("the probe table has no column with files")
    return t.join(known.withColumnRenamed("stem", "WorldFileID"), "WorldFileID").select(F.col("WorldFileID").alias("probe_id"), F.col("path").alias("file"))


def skip_first(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).offset(n)


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with the number of their batch of ``size`` consecutive rows."""
    return ranges.numbered(rows, order, name="_n").withColumn("batch", ranges.batch_of(F.col("_n"), size)).drop("_n")


def feature_list(spark: SparkSession, roots: list[str], extension: str | None = "npy") -> DataFrame:
    """(path): feature files by extension, or all files that aren't hidden; folders of thumbnails are left out."""
    named = files(spark, roots).filter(~names.basename(F.col("path")).startswith(".") & ~F.col("path").rlike("thumb/[^/]*$"))
    return (named if extension is None else named.filter(names.extension(F.col("path")) == extension)).select("path")


def listed(spark: SparkSession, path: str, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths of a list, one a line, that have(path) holds, and those it doesn't; blank lines and repeats don't count."""
    rows = spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''").distinct()
    return rows.join(have.select("path").distinct(), "path", "left_semi"), rows.join(have.select("path").distinct(), "path", "left_anti")


def job_slice(rows: DataFrame, order: str, job: int, jobs: int) -> DataFrame:
    """The job's contiguous share of the rows; all shares together are all rows."""
    return ranges.numbered(rows, order, name="_n").filter(ranges.range_of(F.col("_n"), rows.count(), jobs) == job).drop("_n")


def _by_place(spark: SparkSession, path: str, **columns: int) -> DataFrame:
    t = spark.read.option("sep", "|").csv(path)
    return t.select(*(t[i].alias(c) for c, i in columns.items()))


def world_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, file) of the third column of a world index with a header."""
    t = spark.read.option("sep", "|").option("header", "true").csv(path)
    return t.select(names.basename(t[2]).alias("file")).dropna().select(names.first_stem(F.col("file")).alias("stem"), "file")


def node_references(spark: SparkSession, path: str) -> DataFrame:
    """(id, file): the fourth column of each line and the name in its third."""
    return _by_place(spark, path, id=3, file=2).filter("id is not null").withColumn("file", names.basename(F.col("file")))


def journal_references(spark: SparkSession, path: str) -> DataFrame:
    """(probe_id, journal): the second column of each line and the name in its seventh; the first line is a header."""
    t = spark.read.option("sep", "|").option("header", "true").csv(path)
    return t.select(t[1].alias("probe_id"), names.basename(t[6]).alias("journal")).dropna()


def numbered_features(rows: DataFrame) -> DataFrame:
    """feature_files' rows with image_no, a dense number of their files in the order of paths."""
    return rows.join(ranges.numbered(rows.select("path").distinct(), "path", name="image_no"), "path")


def result_documents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(probe_id, id, file, fileid, nodeConfidenceScore): nodes of result documents, the probe being the file's stem."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(roots)
    t = t.select(names.last_stem(F.input_file_name()).alias("probe_id"), F.explode(F.from_json("value", DOCUMENT)["nodes"]).alias("n"))
    return t.select("probe_id", "n.*")


def journals(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (journal, idx, file, id) and links (journal, source, target, op) of journal documents; idx is the node's place."""
    kind = "nodes array<struct<file:string,id:string>>, links array<struct<source:int,target:int,op:string>>"
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(roots)
    t = t.select(names.last_stem(F.input_file_name()).alias("journal"), F.from_json("value", kind).alias("j"))
    nodes = t.select("journal", F.posexplode("j.nodes").alias("idx", "n")).select("journal", "idx", "n.*")
    links = t.select("journal", F.explode("j.links").alias("l")).select("journal", "l.*")
    return nodes, links


def path_map(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path) of a JSON map of stems to paths; its key for the root folder is left out."""
    t = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("stem", "path"))
    return t.filter("stem <> '_rootDirectory_'")


def landmarks(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, landmark_id) of a quoted table with a header; rows whose landmark is missing or ``None`` go."""
    t = spark.read.option("header", "true").option("quote", '"').csv(path).toDF("id", "url", "landmark_id")
    return t.filter(F.col("landmark_id").isNotNull() & (F.trim("landmark_id") != "None"))


def rank_file(spark: SparkSession, path: str) -> DataFrame:
    """(probe, rank, result) of lines ``probe,result1,result2,...``."""
    p = F.split("value", ",")
    t = spark.read.text(path).filter(F.trim("value") != "").select(F.trim(p[0]).alias("probe"), F.posexplode(F.slice(p, 2, 100_000_000)).alias("pos", "result"))
    return t.select("probe", (F.col("pos") + 1).alias("rank"), F.trim("result").alias("result"))
