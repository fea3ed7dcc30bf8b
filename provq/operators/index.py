"""A trained, compressed index: rotation, coarse cells and product-quantiser codes; kept as Parquet, appended to, merged, and searched by probed cells.

Training takes a bounded, documented sample to the driver (``SAMPLE_ROWS`` vectors at most); every row of the table is indexed. Codes are those of
the residual to the cell's centroid; distances between a query and a code are summed from tables of the query's distances to the code words.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provq.operators.search import _kth_bound, _matrix, _slack, ranked

#: Vectors that training looks at, at most; codes and queries of one task of a search; queries of one product.
SAMPLE_ROWS, CODE_BLOCK, QUERY_BLOCK, ROWS = 100_000, 200_000, 16_384, 64


@dataclass(frozen=True)
class Index:
    """rotation: columns that a vector is projected on, or None. centroids: of the cells. books: (parts, words, width) code words, or None for whole vectors."""

    rotation: np.ndarray | None
    centroids: np.ndarray
    books: np.ndarray | None

    def project(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation

    def cells_of(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of projected vectors; equal distances by number."""
        c = self.centroids
        d = np.round((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 9)
        return np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)

    def codes_of(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([self._tables(residual)[:, p].argmin(1) for p in range(len(self.books))], axis=1).astype(np.uint8)

    def _tables(self, residual: np.ndarray) -> np.ndarray:
        """(rows, parts, words) squared distances of each part to its code words."""
        parts = residual.reshape(len(residual), len(self.books), -1)
        return np.round(((parts[:, :, None, :] - self.books[None]) ** 2).sum(3), 9)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to codes, (queries, codes)."""
        t = self._tables(residual)
        out = np.zeros((len(residual), len(codes)))
        for p in range(len(self.books)):
            out += t[:, p][:, codes[:, p]]
        return out


def _clustered(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centroids by k-means; an empty one takes the place of the vector farthest from its own."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near, dist = np.empty(len(x), np.int64), np.empty(len(x))
        for s in range(0, len(x), 20_000):
            d = (x[s : s + 20_000] ** 2).sum(1)[:, None] - 2 * x[s : s + 20_000] @ c.T + (c * c).sum(1)[None]
            near[s : s + 20_000], dist[s : s + 20_000] = d.argmin(1), d.min(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-dist)[: len(empty)]]
    return c


def balanced_rotation(x: np.ndarray, parts: int, dims: int) -> np.ndarray:
    """The ``dims`` main directions, dealt to the parts so that the products of their variances are alike (the parametric optimised product quantiser)."""
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-values)[:dims]
    room, weight = [dims // parts] * parts, np.zeros(parts)
    dealt: list[list[int]] = [[] for _ in range(parts)]
    for i in order:
        p = min((j for j in range(parts) if room[j]), key=lambda j: (weight[j], j))
        dealt[p].append(i)
        room[p] -= 1
        weight[p] += np.log(max(values[i], 1e-12))
    return vectors[:, [i for part in dealt for i in part]]


def train(base: DataFrame, cells: int, *, parts: int | None = 8, words: int = 256, dims: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 15) -> Index:
    """base(feature_id, v) -> an index fitted on a sample of at most about ``sample_rows`` vectors, drawn by a hash of their ids.

    dims: directions that are kept, all where None; without parts vectors are kept whole. Words are fewer where the sample is smaller.
    """
    n = base.count()
    share = min(1.0, sample_rows / max(n, 1))
    drawn = base.filter(F.pmod(F.xxhash64("feature_id", F.lit(seed)), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).orderBy("feature_id").select("v").toArrow()
    if not drawn.num_rows:
        raise ValueError("no vectors to train on")
    x = _matrix(drawn)
    rotation = balanced_rotation(x, parts or 1, dims or x.shape[1]) if dims or parts else None
    x = x if rotation is None else x @ rotation
    whole = Index(rotation, _clustered(x, cells, seed), None)
    if parts is None:
        return whole
    residual = x - whole.centroids[whole.cells_of(x)[:, 0]]
    books = np.stack([_clustered(part, min(words, len(x)), seed + 1) for part in np.split(residual, parts, axis=1)])
    return Index(rotation, whole.centroids, books)


def save(spark: SparkSession, index: Index, path: str) -> None:
    """Keep the trained parameters; an index at the path is replaced."""
    text = json.dumps({k: None if v is None else v.tolist() for k, v in (("rotation", index.rotation), ("centroids", index.centroids), ("books", index.books))})
    spark.createDataFrame([(text,)], "parameters string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Index:
    kept = json.loads(spark.read.parquet(path).first()[0])
    return Index(*(None if kept[k] is None else np.array(kept[k]) for k in ("rotation", "centroids", "books")))


def load_or_train(spark: SparkSession, path: str, base: DataFrame, cells: int, **how) -> Index:
    """The index kept at the path; where there is none yet, it is trained and kept."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        save(spark, train(base, cells, **how), path)
    return load(spark, path)


def encode(index: Index, rows: DataFrame) -> DataFrame:
    """rows(feature_id, v, ...) -> the same without v, with the cell and the code (the projected vector's bytes, where the index keeps vectors whole)."""
    kept = [c for c in rows.columns if c != "v"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = index.project(_matrix(pa.Table.from_batches([b.select(["v"])])))
            cell = index.cells_of(x)[:, 0]
            code = x.astype("<f8") if index.books is None else index.codes_of(x - index.centroids[cell])
            raw = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(cell), raw], [*kept, "cell", "code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "v")
    return rows.select(*kept, "v").mapInArrow(run, f"{fields}, cell int, code binary")


def append(coded: DataFrame, path: str) -> None:
    """Add coded rows to the index at the path, a folder for each cell."""
    coded.repartition("cell").write.partitionBy("cell").mode("append").parquet(path)


def merge(spark: SparkSession, paths: list[str], path: str) -> None:
    """Unite the codes of several shards that were made with the same trained parameters."""
    spark.read.parquet(paths[0]).write.partitionBy("cell").mode("overwrite").parquet(path)
    for p in paths[1:]:
        spark.read.parquet(p).write.partitionBy("cell").mode("append").parquet(path)


def search(index: Index, queries: DataFrame, coded: DataFrame, k: int, nprobe: int = 24) -> DataFrame:
    """queries(q, v), coded rows -> (q, feature_id, dist, rank): the k nearest codes in the ``nprobe`` cells nearest to each query.

    A cell is cut by its own number of rows, and queries into blocks, so that tasks are bounded; the k best of each leave a task. Equal distances go by feature_id.
    """
    sizes = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # one row for each cell
    parts = [max(1, -(-sizes.get(c, 0) // CODE_BLOCK)) for c in range(len(index.centroids))]
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = index.project(_matrix(pa.Table.from_batches([b.select(["v"])])))
            cell = index.cells_of(x, min(nprobe, len(index.centroids)))
            i, flat = np.repeat(np.arange(len(x)), cell.shape[1]), cell.ravel()
            n = np.array(parts)[flat]
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, flat = np.repeat(i, n), np.repeat(flat, n)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(i) + 1) * x.shape[1], x.shape[1], dtype=np.int32)), pa.array(x[i].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), values, pa.array(flat), pa.array(part.astype(np.int32))], ["q", "v", "cell", "part"])

    def near(asked: pa.Table, held: pa.Table) -> pa.Table:
        empty = {"q": pa.array([], pa.int64()), "feature_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())}
        if not asked.num_rows or not held.num_rows:
            return pa.table(empty)
        ids, of, x = held.column("feature_id").to_numpy(), asked.column("q").to_numpy(), _matrix(asked)
        raw = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        out = []
        cell = index.centroids[asked.column("cell")[0].as_py()]
        if index.books is None:
            b = raw.view("<f8")
        else:  # a code stands for the vector of its words
            x, b = x - cell, np.concatenate([index.books[p][raw[:, p]] for p in range(len(index.books))], axis=1)
        middle = b.mean(0)
        half, b32 = ((b - middle) ** 2).sum(1) / 2, (b - middle).astype(np.float32)
        x32, half32 = (x - middle).astype(np.float32), half.astype(np.float32)
        most = np.sqrt(2 * half.max())
        for s in range(0, len(x), ROWS):
            # the higher the nearer, by single precision; what may be among the nearest by that gets its exact distance
            g = x32[s : s + ROWS] @ b32.T
            g -= half32
            slack = _slack(x.shape[1]) * (np.sqrt((x32[s : s + ROWS] ** 2).sum(1)) * most + half.max()) + 1e-8
            at = np.flatnonzero(g >= (_kth_bound(g, k) - 2 * slack).astype(np.float32)[:, None])
            row, col = at // len(ids), at % len(ids)
            d = np.empty(len(row))
            tables = None if index.books is None else index._tables(x[s : s + ROWS])
            for e in range(0, len(row), 65_536):
                i, j = row[e : e + 65_536], col[e : e + 65_536]
                if tables is None:
                    d[e : e + 65_536] = ((x[s + i] - b[j]) ** 2).sum(1)
                else:
                    d[e : e + 65_536] = sum(tables[i, p, raw[j, p]] for p in range(len(index.books)))
            d = np.maximum(np.round(d, 9), 0) + 0.0
            o = np.lexsort((ids[col], d, row))
            row, col, d = row[o], col[o], d[o]
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            keep = np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)])) < k
            out.append((of[s + row[keep]], ids[col[keep]], d[keep]))
        return pa.table({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(empty)})

    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")
    q = queries.select("q", "v").mapInArrow(probe, "q bigint, v array<double>, cell int, part int").select("*", block)
    part = F.pmod(F.xxhash64("feature_id"), F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)).cast("int").alias("part")
    held = coded.select("feature_id", F.col("cell").cast("int").alias("cell"), "code").select("feature_id", "cell", "code", part, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    by = ["cell", "part", "block"]
    top = q.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(near, "q bigint, feature_id bigint, dist double")
    return ranked(top, k)


def reranked(found: DataFrame, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """found(q, feature_id) with exact distances from queries(q, v) and base(feature_id, v), cut to k: codes propose, vectors decide."""
    from provq.functions import vectors as V

    rows = found.select("q", "feature_id").join(queries.select("q", F.col("v").alias("qv")), "q").join(base.select("feature_id", "v"), "feature_id")
    return ranked(rows.select("q", "feature_id", (V.unit_distance(F.col("qv"), F.col("v")) + 0.0).alias("dist")), k)
