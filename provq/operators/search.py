"""Top-k similarity joins: exact, by cells of an inverted file, fused over shards, and within a distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provq.runtime import Workspace, read_shared, shared_path


#: Query rows and base rows of one task of the exact join.
QUERY_BLOCK, BASE_BLOCK = 2_048, 20_000


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks().flatten().to_numpy()
    return flat.reshape(t.num_rows, -1)


def _block_top(k: int):
    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        empty = {"q": pa.array([], pa.int64()), "feature_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())}
        if not queries.num_rows or not base.num_rows:
            return pa.table(empty)
        q, b = _matrix(queries), _matrix(base)
        ids, of = base.column("feature_id").to_numpy(), queries.column("q").to_numpy()
        out = []
        for s in range(0, len(q), 256):
            d = np.maximum(np.round(2 - 2 * (q[s : s + 256] @ b.T), 9), 0) + 0.0
            # everything up to the k-th distance, ties included, then the exact order
            limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            row, col = np.nonzero(d <= limit[:, None])
            o = np.lexsort((ids[col], d[row, col], row))
            row, col = row[o], col[o]
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            keep = np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)])) < k
            out.append((of[s + row[keep]], ids[col[keep]], d[row[keep], col[keep]]))
        return pa.table({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(empty)})

    return run


#: Queries that a task holds at once; beyond, the base is read once more for each further so many. Rows of one matrix product.
QUERIES_HELD, ROWS = 262_144, 512


def _slack(dim: int) -> float:
    """More than a product of two unit vectors is off in single precision."""
    return (dim + 8) * 1.2e-7


def _exact(q: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The distances of pairs of rows, to nine places."""
    dot = np.empty(len(row))
    for s in range(0, len(row), 65_536):
        dot[s : s + 65_536] = np.einsum("ij,ij->i", q[row[s : s + 65_536]], b[col[s : s + 65_536]])
    return np.maximum(np.round(2 - 2 * dot, 9), 0) + 0.0


def _kth_bound(g: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its entries reach, close to the k-th highest: that of the maxima of groups of columns."""
    groups = 16 * k
    deep = g.shape[1] // groups
    if deep < 2:
        return np.full(len(g), -np.inf, np.float32) if g.shape[1] < k else np.partition(g, g.shape[1] - k, axis=1)[:, g.shape[1] - k]
    return np.partition(g[:, : deep * groups].reshape(len(g), deep, groups).max(1), groups - k, axis=1)[:, groups - k]


def _cell_order(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = np.round((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 9)
    return np.argsort(d, axis=1, kind="stable")


def _nearest_of(path: str, first: int, k: int, centroids: np.ndarray | None, nprobes: list[int]):
    """Of base rows (feature_id, v) those nearest to each query of the file at the path, from row ``first`` on: (q, feature_id, dist, level).

    A row's level is the first of ``nprobes`` with which its cell is probed, and it is kept where it is among the k nearest of its level and those below. Products are taken in
    single precision; what may be among the nearest by that is compared in double precision, so answers are exact.
    """

    def run(batches):
        asked = read_shared(path).sort_by("q").slice(first, QUERIES_HELD)
        of, q = asked.column("q").to_numpy(), _matrix(asked)
        q32 = q.astype(np.float32)
        slack, n_levels = np.float32(_slack(q.shape[1])), len(nprobes)
        limit = np.full((len(q), n_levels), -np.inf, np.float32)
        if centroids is None:
            level = np.zeros((len(q), 1), np.int8)
        else:
            level = np.empty((len(q), len(centroids)), np.int8)
            for s in range(0, len(q), 8_192):
                o = _cell_order(q[s : s + 8_192], centroids)
                np.put_along_axis(level[s : s + 8_192], o, np.searchsorted(nprobes, np.arange(1, o.shape[1] + 1)).astype(np.int8)[None], 1)
        kept: list = [None] * -(-len(q) // ROWS)
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids, x = t.column("feature_id").to_numpy(), _matrix(t)
            cuts = [(0, 0, len(x))]
            if centroids is not None:
                cell = _cell_order(x, centroids)[:, 0]
                o = np.argsort(cell, kind="stable")
                ids, x, cell = ids[o], x[o], cell[o]
                heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                cuts = [(int(cell[i]), int(i), int(j)) for i, j in zip(heads, np.r_[heads[1:], len(x)])]
            x32 = x.astype(np.float32)
            for n, s in enumerate(range(0, len(q), ROWS)):
                rows, found = np.arange(s, min(s + ROWS, len(q))), []
                for c, i, j in cuts:
                    g = q32[s : s + ROWS] @ x32[i:j].T
                    least = limit[rows, level[rows, c]]
                    if np.isinf(least).any():
                        least = np.maximum(least, _kth_bound(g, k))
                    at = np.flatnonzero(g >= (least - 2 * slack)[:, None])
                    if len(at):
                        found.append((s + at // (j - i), i + at % (j - i), np.full(len(at), c)))
                if not found:
                    continue
                row, col, c = (np.concatenate(v) for v in zip(*found))
                new = (row, level[row, c], _exact(q, x, row, col), ids[col])
                row, lev, d, i = new if kept[n] is None else (np.concatenate(v) for v in zip(kept[n], new))
                o = np.lexsort((i, d, row))
                row, lev, d, i = row[o], lev[o], d[o], i[o]
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                sizes, keep = np.diff(np.r_[heads, len(row)]), np.zeros(len(row), bool)
                for v in range(n_levels):
                    inside = lev <= v
                    nth = np.cumsum(inside)
                    nth -= np.repeat(nth[heads] - inside[heads], sizes)
                    keep |= (lev == v) & (nth <= k)
                    last = inside & (nth == k)
                    limit[row[last], v] = 1 - d[last] / 2
                kept[n] = (row[keep], lev[keep], d[keep], i[keep])
        for x in kept:
            if x is not None:
                yield pa.RecordBatch.from_arrays([pa.array(of[x[0]]), pa.array(x[3]), pa.array(x[2]), pa.array(x[1].astype(np.int32))], ["q", "feature_id", "dist", "level"])

    return run


def _scanned(queries: DataFrame, base: DataFrame, k: int, centroids: np.ndarray | None, nprobes: list[int]) -> DataFrame:
    spark = base.sparkSession
    asked = Workspace(spark, "queries").save(queries.select("q", "v"), "queries")
    path, n, out = shared_path(asked), asked.count(), None
    base = base.select("feature_id", "v").coalesce(spark.sparkContext.defaultParallelism)
    for first in range(0, max(n, 1), QUERIES_HELD):
        top = base.mapInArrow(_nearest_of(path, first, k, centroids, nprobes) if n else lambda _: iter(()), "q bigint, feature_id bigint, dist double, level int")
        out = top if out is None else out.unionByName(top)
    return out


def exact_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """queries(q, v), base(feature_id, v), unit vectors of doubles -> (q, feature_id, dist, rank).

    Queries are stored once where all tasks read them; the base stays where it is, in as many tasks as there are cores, and the k best a query
    leave a task. Distances have nine places; equal ones go by feature_id. A query finds itself, if it is in the base.
    """
    return ranked(_scanned(queries, base, k, None, [1]).drop("level"), k)


def probed_levels(queries: DataFrame, base: DataFrame, centroids: list[list[float]], k: int, nprobes: tuple[int, ...]) -> tuple[DataFrame, list[int]]:
    """(q, feature_id, dist, level) and the levels, numbers of probed cells up to all of them: one pass has the k nearest for each level, those of levels not above it."""
    levels = sorted({min(n, len(centroids)) for n in nprobes} | {len(centroids)})
    return _scanned(queries, base, k, np.array(centroids), levels), levels


def ranked(hits: DataFrame, k: int | None) -> DataFrame:
    """Hits numbered by distance within their query, equal distances by feature_id; the first k, or all."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "feature_id")))
    return out if k is None else out.filter(F.col("rank") <= k)


def fuse(shards: list[DataFrame]) -> DataFrame:
    """Hits (q, feature_id, dist) of several shards in one order by distance; all are kept."""
    out = shards[0].select("q", "feature_id", "dist")
    for s in shards[1:]:
        out = out.unionByName(s.select("q", "feature_id", "dist"))
    return ranked(out, None)


def flip_augmented(rows: DataFrame, mirrored: DataFrame) -> DataFrame:
    """rows and mirrored (feature_id, image_id, v) -> (q, feature_id, image_id, v, flipped): both sets as queries with numbers of their own."""
    both = rows.withColumn("flipped", F.lit(False)).unionByName(mirrored.withColumn("flipped", F.lit(True)))
    return both.withColumn("q", F.col("feature_id") * 2 + F.col("flipped").cast("int"))


def train_cells(base: DataFrame, cells: int, *, sample_rows: int = 100_000, seed: int = 15) -> list[list[float]]:
    """Centroids by k-means on a bounded sample of the vectors (v)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = base.count()
    sample = base.sample(min(1.0, sample_rows / max(n, 1)), seed).select(array_to_vector("v").alias("features"))
    return [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=20).fit(sample).clusterCenters()]


def train_projection(base: DataFrame, dims: int, *, sample_rows: int = 100_000, seed: int = 15):
    """A principal-component projection fitted on a bounded sample; apply it with its ``transform``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    n = base.count()
    sample = base.sample(min(1.0, sample_rows / max(n, 1)), seed).select(array_to_vector("v").alias("features"))
    return PCA(k=dims, inputCol="features", outputCol="projected").fit(sample)


def assign_cells(rows: DataFrame, centroids: list[list[float]], nprobe: int = 1) -> DataFrame:
    """Each row with the numbers of its ``nprobe`` nearest cells: columns cell and cell_rank (1 the nearest; ties by number)."""
    c = np.array(centroids)
    n = min(nprobe, len(c))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(pa.Table.from_batches([b]))
            d = np.round((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 9)
            near = np.argsort(d, axis=1, kind="stable")[:, :n]
            i = np.repeat(np.arange(len(x)), n)
            yield pa.RecordBatch.from_arrays([*(col.take(pa.array(i)) for col in b.columns), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(x)))], [*b.schema.names, "cell", "cell_rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, cell int, cell_rank int")


def ivf_knn(queries: DataFrame, base: DataFrame, centroids: list[list[float]], k: int, nprobe: int = 24) -> DataFrame:
    """``exact_knn`` within the ``nprobe`` cells nearest to each query; with all cells probed the results are equal."""
    q = assign_cells(queries.select("q", "v"), centroids, nprobe)
    b = assign_cells(base.select("feature_id", "v"), centroids)
    # each cell is cut by its own number of rows, and queries into blocks; one row for each cell comes to the driver
    sizes = {r["cell"]: r["count"] for r in b.groupBy("cell").count().collect()}
    parts = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(c, 0) // BASE_BLOCK))) for c in range(len(centroids)))), F.col("cell") + 1)
    blocks = max(1, -(-queries.count() // (4 * QUERY_BLOCK)))
    q = q.select("q", "v", "cell", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    b = b.select("feature_id", "v", "cell", F.pmod(F.xxhash64("feature_id"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    by = ["cell", "part", "block"]
    top = q.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(_block_top(k), "q bigint, feature_id bigint, dist double")
    return ranked(top, k)


def choose_nprobe(queries: DataFrame, base: DataFrame, centroids: list[list[float]], k: int, recall: float = 0.9, *, sample_rows: int = 1_000, seed: int = 15) -> int:
    """The fewest cells to probe so that a sample of the queries (all, if there are fewer) finds at least ``recall`` of its true k nearest, found exactly."""
    base = base.select("feature_id", "v")
    q = queries.select("q", "v").orderBy(F.xxhash64("q", F.lit(seed)), "q").limit(sample_rows)
    pairs = exact_knn(q, base, k).select("q", "feature_id")
    order = assign_cells(q, centroids, len(centroids)).select("q", "cell", "cell_rank")
    home = assign_cells(base, centroids).select("feature_id", "cell")
    ranks = pairs.join(home, "feature_id").join(order, ["q", "cell"]).groupBy("cell_rank").count().orderBy("cell_rank").collect()
    total, seen = sum(r["count"] for r in ranks), 0
    for r in ranks:
        seen += r["count"]
        if seen >= recall * total:
            return r["cell_rank"]
    return len(centroids)


def product_codes(rows: DataFrame, codebooks: list[list[list[float]]]) -> DataFrame:
    """Adds ``pq``: for each of the equal parts of v, the number of the nearest codeword of that part's codebook."""
    books = [np.array(b) for b in codebooks]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parts = np.split(_matrix(pa.Table.from_batches([b])), len(books), axis=1)
            code = np.stack([((p[:, None, :] - c[None]) ** 2).sum(2).argmin(1) for p, c in zip(parts, books)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int16).tolist(), pa.list_(pa.int16()))], [*b.schema.names, "pq"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, pq array<smallint>")


#: Leading elements that alone rule most pairs out.
LEADING = 24


def _close_to(path: str, distance: float):
    def run(batches):
        asked = read_shared(path)
        of, q = asked.column("q").to_numpy(), _matrix(asked)
        m = min(LEADING, q.shape[1])
        # |a - b|^2 of the leading elements, never more than that of all, as one product
        half = lambda x: (x[:, :m] ** 2).sum(1)[:, None] / 2
        q32 = np.hstack([q[:, :m], -half(q), np.full((len(q), 1), -1.0)]).astype(np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids, x = t.column("feature_id").to_numpy(), _matrix(t)
            x32 = np.ascontiguousarray(np.hstack([x[:, :m], np.ones((len(x), 1)), half(x)]).astype(np.float32).T)
            for s in range(0, len(q), ROWS):
                at = np.flatnonzero(q32[s : s + ROWS] @ x32 > -(distance**2) / 2 - 4 * _slack(m + 2))
                for e in range(0, len(at), 65_536):
                    row, col = s + at[e : e + 65_536] // len(x), at[e : e + 65_536] % len(x)
                    d = np.sqrt(((q[row] - x[col]) ** 2).sum(1))
                    near = d < distance
                    yield pa.RecordBatch.from_arrays([pa.array(of[row[near]]), pa.array(ids[col[near]]), pa.array(np.round(d[near], 9))], ["q", "feature_id", "dist"])

    return run


def close_pairs(queries: DataFrame, base: DataFrame, distance: float) -> DataFrame:
    """queries(q, v), base(feature_id, v), unit vectors -> (q, feature_id, dist): all pairs within a Euclidean distance.

    Buckets of random projections as wide as the distance hold nearly every vector, so pairs aren't hashed: the base streams past the stored queries, pairs whose leading
    elements are too far apart go by one product in single precision, the others are compared in full.
    """
    spark = base.sparkSession
    asked = Workspace(spark, "queries").save(queries.select("q", "v"), "queries")
    return base.select("feature_id", "v").mapInArrow(_close_to(shared_path(asked), distance) if asked.limit(1).count() else lambda _: iter(()), "q bigint, feature_id bigint, dist double")


def keep_index(rows: DataFrame, path: str) -> None:
    """Write cell-assigned rows as an index: Parquet partitioned by cell, so that a search reads the probed cells only."""
    rows.write.partitionBy("cell").mode("append").parquet(path)


def merge_indexes(spark, paths: list[str], path: str) -> None:
    """Unite the indexes of several shards into one."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p))
    out.repartition("cell").write.partitionBy("cell").parquet(path)


def _image_top(n: int):
    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        names = ("q", "image_id", "feature_id", "dist")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        if not queries.num_rows or not base.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})
        ids, image = base.column("feature_id").to_numpy(), base.column("image_id").to_numpy()
        o = np.lexsort((ids, image))
        ids, image, b = ids[o], image[o], _matrix(base)[o]
        heads = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
        sizes = np.diff(np.r_[heads, len(image)])
        code = np.repeat(np.arange(len(heads)), sizes) * 8.0
        at = np.concatenate([heads[sizes > i] + i for i in range(n)])  # an image's rows stay together, so its best have fixed places
        q, of = _matrix(queries), queries.column("q").to_numpy()
        out = []
        for s in range(0, len(q), 128):
            d = np.maximum(np.round(2 - 2 * (q[s : s + 128] @ b.T), 9), 0) + 0.0
            best = np.argsort(d + code, axis=1, kind="stable")[:, at]
            out.append((np.repeat(of[s : s + 128], len(at)), np.tile(image[at], len(best)), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel()))
        return pa.table({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(names)})

    return run


def nearest_per_image(queries: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """queries(q, v), base(feature_id, image_id, v) -> (q, image_id, feature_id, dist, nth): the n features of each image nearest to each query.

    Blocks hold whole images; an image larger than a block is cut, and its parts' answers are merged. Equal distances go by feature_id.
    """
    n_q, n_b = queries.count(), base.count()
    qb, bb = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_b // BASE_BLOCK), min(8, n_b // 2_000))
    large = base.groupBy("image_id").agg(F.ceil(F.count("*") / BASE_BLOCK).cast("int").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("feature_id"), F.coalesce("parts", F.lit(1)))
    # there are at most n_b / BASE_BLOCK large images
    b = base.join(F.broadcast(large), "image_id", "left").select("feature_id", "image_id", "v", F.pmod(F.xxhash64("image_id", part), F.lit(bb)).cast("int").alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    q = queries.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(bb - 1))).alias("bb"))
    q, b = (df.toDF(*df.columns) for df in (q, b))  # both may stem from one table
    top = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(_image_top(n), "q bigint, image_id bigint, feature_id bigint, dist double")
    nth = F.row_number().over(Window.partitionBy("q", "image_id").orderBy("dist", "feature_id"))
    return top.withColumn("nth", nth).filter(F.col("nth") <= n)


#: Features of an image that one task compares with the features of its probes.
PAIR_BLOCK = 2_000


def _pair_top(n: int, only_mutual: bool):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ("probe_id", "image_id", "q_feature", "feature_id", "dist", "mutual")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        if not asked.num_rows or not held.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})
        listed = asked.column("image_id").is_valid().to_numpy()
        pairs, rows = asked.filter(pa.array(listed)), asked.filter(pa.array(~listed)).select(["probe_id", "q_feature", "v"])
        probe, q = rows.column("probe_id").to_numpy(), rows.column("q_feature").to_numpy()
        o = np.lexsort((q, probe))
        probe, q, x = probe[o], q[o], _matrix(rows)[o]
        at, ids, whole = (held.column(c).to_numpy(zero_copy_only=False) for c in ("image_id", "feature_id", "whole"))
        o = np.lexsort((ids, at))
        at, ids, whole, b = at[o], ids[o], whole[o], _matrix(held)[o]
        p, m = pairs.column("probe_id").to_numpy(), pairs.column("image_id").to_numpy()
        of = [np.searchsorted(probe, p, side) for side in ("left", "right")]
        on = [np.searchsorted(at, m, side) for side in ("left", "right")]
        out = []
        for k, (i, j, s, e) in enumerate(zip(*of, *on)):
            if i == j or s == e:
                continue
            d = np.maximum(np.round(2 - 2 * (x[i:j] @ b[s:e].T), 9), 0) + 0.0
            nearest = d.argmin(0)  # of each feature the nearest query
            if only_mutual and whole[s]:
                back = d.argmin(1)
                row = np.flatnonzero(nearest[back] == np.arange(j - i))
                best, mutual = back[row][:, None], np.ones((len(row), 1), bool)
            else:
                row = np.arange(j - i)
                best = np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(1)[:, None]
                mutual = np.zeros(best.shape, bool)
                mutual[:, 0] = nearest[best[:, 0]] == row
            w = best.shape[1]
            out.append((np.full(best.size, p[k]), np.full(best.size, m[k]), np.repeat(q[i:j][row], w), ids[s:e][best].ravel(), d[row[:, None], best].ravel(), mutual.ravel()))
        return pa.table({c: pa.array(np.concatenate([v[i] for v in out]) if out else [], kind) for i, (c, kind) in enumerate(zip(names, kinds))})

    return run


def pair_nearest(pairs: DataFrame, queries: DataFrame, base: DataFrame, n: int, *, only_mutual: bool = False) -> DataFrame:
    """pairs(probe_id, image_id), queries(probe_id, q_feature, v), base(image_id, feature_id, v) -> (probe_id, image_id, q_feature, feature_id, dist, mutual, nth).

    The n features of the image nearest to each of the probe's, in paired images only; mutual: the probe has no feature nearer to it. An image with many features
    is cut into parts; a part knows the nearest query of each of its features. A probe's features go once to each task that holds one of its images, not to each image.
    Equal distances go by the smaller feature. only_mutual: rows that aren't mutual may be left out.
    """
    large = base.groupBy("image_id").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    tasks = max(1, -(-base.count() // (4 * PAIR_BLOCK)))
    tasks = max(tasks, base.sparkSession.sparkContext.defaultParallelism)
    task = lambda part: F.pmod(F.xxhash64("image_id", part), F.lit(tasks)).cast("int").alias("task")
    part = F.pmod(F.xxhash64("feature_id"), parts).cast("int")
    b = base.join(large, "image_id", "left").select("image_id", "feature_id", "v", F.col("parts").isNull().alias("whole"), task(part))
    of = pairs.join(large, "image_id", "left").select("probe_id", "image_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("probe_id", "image_id", task(F.col("part"))).distinct()
    void = lambda kind: F.lit(None).cast(kind)
    own = of.select("probe_id", "task").distinct().join(queries.select("probe_id", "q_feature", "v"), "probe_id")
    q = of.select("task", "probe_id", "image_id", void("bigint").alias("q_feature"), void("array<double>").alias("v")).unionByName(own.select("task", "probe_id", void("bigint").alias("image_id"), "q_feature", "v"))
    q, b = (df.toDF(*df.columns) for df in (q, b))  # both may stem from one table
    top = q.groupBy("task").cogroup(b.groupBy("task")).applyInArrow(_pair_top(n, only_mutual), "probe_id bigint, image_id bigint, q_feature bigint, feature_id bigint, dist double, mutual boolean")
    nth = F.row_number().over(Window.partitionBy("probe_id", "image_id", "q_feature").orderBy("dist", "feature_id"))
    return top.withColumn("nth", nth).filter(F.col("nth") <= n)


__all__ = ["assign_cells", "choose_nprobe", "close_pairs", "exact_knn", "flip_augmented", "fuse", "ivf_knn", "keep_index", "merge_indexes", "nearest_per_image", "pair_nearest", "probed_levels", "product_codes", "ranked", "train_cells", "train_projection"]
