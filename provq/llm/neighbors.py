"""The most similar vectors for every vector.

Method: vectors are routed to shards of bounded size by centroids that are fitted on a bounded sample (a tree of median splits
along main directions, so that dense regions get as many shards as their share of the vectors asks for). Each shard is one task: it builds a
robust-pruned directed graph over its members (``vamana``) and answers beam searches, those of its own members and those of
queries that may have a neighbour in it, which stream past the graph. Candidates are scored exactly and the shards' answers merged.

Which shards a query is sent to is measured, not guessed: for a bounded sample of queries the true neighbours are found by brute force over all
vectors, and the distance from the border that a wanted share of them asks for (``recall``) is the distance up to which all shards are probed.

Exact copies would crowd each other out of the graph and its shard, so only one of them, the smallest key, is indexed; the others take
over its answer, with the copies themselves in front.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provq.llm import vamana
from provq.runtime import Workspace, stored_bytes

#: Vectors of a shard up to a million vectors, and at most; vectors of the sample from which shards are fitted: at least, of each shard, at most.
SHARD_ROWS, MOST_SHARD_ROWS = 16_000, 128_000
SAMPLE_ROWS, SAMPLE_OF_A_SHARD, MOST_SAMPLE_ROWS = 40_000, 64, 1_000_000
#: Queries of the sample whose neighbours are found by brute force, and pairs that it must hold for a border to be read from it.
MEASURED_QUERIES, LEAST_PAIRS = 2_000, 200
#: Queries from elsewhere that a shard answers for each of its members; a shard with more of them is built several times over.
QUERIES_OF_A_MEMBER = 8
#: Search settings for neighbours of a cosine of 0.99 at least: every shard that can hold one is probed, however many there are.
VERY_CLOSE = {"within": 0.99, "width": 40}
#: Search settings for neighbours of a cosine of 0.9 at least, in the same way.
CLOSE = {"within": 0.9, "width": 40}
#: Settings with a measured border instead: the largest distance that any pair of the sample asks for, half as much again.
ALL_OF_SAMPLE = 1.0
#: Nearest centroids whose borders are looked at; fewer only probe more shards. Room for single precision.
BORDERS, SLACK = 8, 1e-5
#: Tables of exceptions up to this stored size are broadcast, larger ones joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def usable(vec: Column, dim: int) -> Column:
    """True for vectors of ``dim`` elements, all finite, not all zero."""
    v = vec.cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _bytes_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The floats that a binary column holds, end to end."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):  # more than 2 GB stay in chunks
        return np.concatenate([_bytes_of(x) for x in c.chunks])
    wide = pa.types.is_large_binary(c.type)
    offsets = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32) if len(c) else np.empty(0, np.float32)


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of ``cells`` parts of equal size: the largest part is halved at the median of its main direction, again and again."""
    parts: list[tuple[int, int, np.ndarray]] = [(-len(sample), 0, np.arange(len(sample)))]
    while len(parts) < cells and -parts[0][0] >= 2:
        _, _, p = heapq.heappop(parts)
        x = sample[p] - sample[p].mean(0)
        d = np.linalg.eigh(x.T @ x)[1][:, -1]
        o = p[np.argsort(x @ d, kind="stable")]
        for half in (o[: len(o) // 2], o[len(o) // 2 :]):
            heapq.heappush(parts, (-len(half), int(half.min()), half))
    c = np.stack([sample[p].mean(0) for _, _, p in sorted(parts, key=lambda part: part[1])])
    n = np.linalg.norm(c, axis=1, keepdims=True)
    return (c / np.where(n > 0, n, 1)).astype(np.float32)


def borders(centroids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector (its cosines to the centroids) its own shard and how far it lies from the border of each shard with its own, 0 for its own."""
    home = sims.argmax(1)
    apart = np.sqrt(np.maximum(1e-12, 2 * (1 - centroids @ centroids.T))).astype(np.float32)
    return home, (np.take_along_axis(sims, home[:, None], 1) - sims) / apart[home]


def reachable(centroids: np.ndarray, sims: np.ndarray, within: float) -> np.ndarray:
    """For each vector (its cosines to the centroids) the shards that can hold a vector of a cosine of ``within`` or more to it.

    A vector is a member of the shard whose centroid has the highest product with it, so between the shards h and s lies the plane through the origin
    across c_h - c_s. A vector at an angle of at most a has crossed it only if (c_h - c_s).q <= sin(a) |c_h - c_s|; a shard that fails this for
    any h is out. This holds for every number of shards and every density.
    """
    out = np.ones(sims.shape, bool)
    if within <= 0:
        return out
    sine = np.sqrt(max(0.0, 1.0 - within * within))
    apart = np.sqrt(np.maximum(0, ((centroids[:, None].astype(np.float64) - centroids[None]) ** 2).sum(2))).astype(np.float32)
    most = min(BORDERS, sims.shape[1])
    for h in np.argpartition(-sims, most - 1, axis=1)[:, :most].T:
        out &= np.take_along_axis(sims, h[:, None], 1) - sims <= sine * apart[h] + SLACK
    return out


def _probed(centroids: np.ndarray, sims: np.ndarray, probes: int, margin: float, within: float | None, border: float | None = None) -> np.ndarray:
    """Which shards each vector is sent to, if it asks."""
    if border is not None:
        return borders(centroids, sims)[1] <= border
    if within is not None:
        return reachable(centroids, sims, within)
    most = min(probes, sims.shape[1])
    near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    out = np.zeros(sims.shape, bool)
    np.put_along_axis(out, near, True, 1)
    return out & (sims >= sims.max(1, keepdims=True) - margin)


def _route(centroids: np.ndarray, splits: np.ndarray, copies: np.ndarray, dim: int, how: dict):
    """(id, vec, asks) -> (shard, id, role, vec): 0 a member, 1 a member that asks, 2 a query from elsewhere.

    A cell that is too large is split by key, so a query goes to each of its splits; a split with many queries has copies, which hold the same members and
    share its queries.
    """
    step = max(64, 250_000 // len(centroids))  # a vector may go to every shard
    first = np.concatenate([[0], np.cumsum(splits * copies)[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            ids, asks = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            flat = _values(b.column(1)).astype(np.float32, copy=False)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(ids), [None, pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
            sims = unit(flat, dim).astype(np.float32) @ centroids.T
            home = sims.argmax(1)
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            split, copy = mixed % splits[home], mixed // 64
            shard, row, role = [], [], []
            for r in range(int(copies[home].max(initial=1))):  # each copy holds all members; one of them answers for a member
                here = np.flatnonzero(copies[home] > r)
                shard.append(first[home[here]] + split[here] * copies[home[here]] + r)
                row.append(here)
                role.append((asks[here] & (copy[here] % copies[home[here]] == r)).astype(np.int8))
            to_cell = _probed(centroids, sims, **how) & asks[:, None]
            for c in range(len(centroids)):
                sent = np.flatnonzero(to_cell[:, c])
                for j in range(splits[c]):
                    to = sent[(home[sent] != c) | (split[sent] != j)]
                    shard.append(first[c] + j * copies[c] + copy[to] % copies[c])
                    row.append(to)
                    role.append(np.full(len(to), 2, np.int8))
            r = np.concatenate(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard).astype(np.int32)), pa.array(ids[r]), pa.array(np.concatenate(role)), raw.take(pa.array(r))], ["shard", "id", "role", "vec"])

    return run


def _best(q: np.ndarray, o: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best others of each query, each once."""
    pair = np.lexsort((-c, o, q))
    q, o, c = q[pair], o[pair], c[pair]
    new = np.r_[True, (q[1:] != q[:-1]) | (o[1:] != o[:-1])][: len(q)]
    q, o, c = q[new], o[new], c[new]
    best = np.lexsort((o, -c, q))
    q, o, c = q[best], o[best], c[best]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    keep = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)])) < k
    return q[keep], o[keep], c[keep]


class _Shard:
    """The members of one shard, the graph over them, and the answers that wait for its end. Memory goes with the members, not with the queries."""

    BLOCK, WAITING = 4096, 1_000_000

    def __init__(self, dim: int, k: int, width: int, least: float, seed: int):
        self.dim, self.k, self.width, self.least, self.seed = dim, k, width, least, seed
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.graph, self.ids, self.waiting, self.last = None, np.empty(0, np.int64), 0, None

    def add(self, ids: np.ndarray, asks: np.ndarray, raw: pa.Array) -> None:
        self.held.append((ids, asks, _bytes_of(raw).copy()))

    def _built(self) -> bool:
        if self.held:
            ids, asks, flat = (np.concatenate([h[i] for h in self.held]) for i in range(3))
            self.held = []
            new = np.r_[True, ids[1:] != ids[:-1]]  # deliveries of one key count once
            self.ids, self.asks, self.exact = ids[new], asks[new], unit(flat, self.dim)[new]
            self.x = self.exact.astype(np.float32)
            self.graph, self.entries = vamana.build(self.x, degree=24, slots=36, width=48, alpha=1.2, seed=self.seed)
        return len(self.ids) > 0

    def _ask(self, ids: np.ndarray, exact: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = vamana.search(self.x, self.graph, self.entries, exact.astype(np.float32), self.width, place)[:, : 2 * self.k + 8]
        ok = (found >= 0) & (found != place[:, None])
        cos = np.matmul(self.exact.take(found, axis=0, mode="clip"), exact[:, :, None])[:, :, 0]
        ok &= cos >= self.least
        at, q, c = found[ok], np.repeat(ids, ok.sum(1)), cos[ok]
        known = self.asks[at]  # what a query finds, finds the query, too, if it asks
        self.back.append((self.ids[at[known]], q[known], c[known]))
        self.waiting += int(known.sum())
        if self.waiting > self.WAITING:
            self.back = [_best(*(np.concatenate([b[i] for b in self.back]) for i in range(3)), self.k)]
            self.waiting = len(self.back[0][0]) // 2  # at most k for each member stay
        return q, self.ids[at], c

    def queries(self, ids: np.ndarray, raw: pa.Array) -> Iterator[pa.RecordBatch]:
        if not self._built():
            return
        new = np.r_[ids[0] != self.last, ids[1:] != ids[:-1]]
        self.last = ids[-1]
        exact, ids = unit(_bytes_of(raw), self.dim)[new], ids[new]
        for s in range(0, len(ids), self.BLOCK):
            part = slice(s, s + self.BLOCK)
            yield _answers(*_best(*self._ask(ids[part], exact[part], np.full(len(ids[part]), -1)), self.k))

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self._built():
            return
        asking, got = np.flatnonzero(self.asks), []
        for s in range(0, len(asking), self.BLOCK):
            a = asking[s : s + self.BLOCK]
            got.append(_best(*self._ask(self.ids[a], self.exact[a], a), self.k))
        rows = got + self.back
        if rows:
            yield _answers(*_best(*(np.concatenate([r[i] for r in rows]) for i in range(3)), self.k))


def _answers(q: np.ndarray, o: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(o), pa.array(c)], ["id", "other", "cosine"])


def _search(dim: int, k: int, width: int, least: float, seed: int):
    """Shards, one after another, members before queries -> (id, other, cosine), the best k of each query in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for b in batches:
            name, ids, role = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | ((role[1:] == 2) != (role[:-1] == 2))][: len(name)])
            for i, j in zip(cuts, np.r_[cuts[1:], len(name)]):
                if name[i] != at:
                    if shard:
                        yield from shard.close()
                    at, shard = name[i], _Shard(dim, k, width, least, seed)
                if role[i] == 2:
                    yield from shard.queries(ids[i:j], b.column(3).slice(i, j - i))
                else:
                    shard.add(ids[i:j], role[i:j] == 1, b.column(3).slice(i, j - i))
        if shard:
            yield from shard.close()

    return run


def _true_pairs(centroids: np.ndarray, q_ids: np.ndarray, q: np.ndarray, dim: int, k: int, least: float, mutual: bool):
    """(id, vec, asks) -> (q, cosine, other, away): of each sampled query the k nearest among a task's vectors, and how far from the border they lie."""
    q = q.astype(np.float32)
    q_home, q_away = borders(centroids, q @ centroids.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(q), least, np.float32)  # of each query the cosine that an entry must have
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]
        for b in (whole.slice(i, 8_192) for whole in batches for i in range(0, whole.num_rows, 8_192)):
            ids, asks = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            x = unit(_values(b.column(1)).astype(np.float32, copy=False), dim).astype(np.float32)
            sims = q @ x.T
            if least < -1 and len(held[0]) == 0 and len(x) > k + 1:
                floor = np.partition(sims, len(x) - k - 1, axis=1)[:, len(x) - k - 1]  # one may be the query itself
            row, col = np.nonzero(sims >= floor[:, None])
            other = ids[col] != q_ids[row]
            row, col = row[other], col[other]
            if not len(row):
                continue
            used, col = np.unique(col, return_inverse=True)
            home, away = borders(centroids, x[used] @ centroids.T)
            there = np.where(asks[used][col], away[col, q_home[row]], np.inf) if mutual else np.inf
            new = [row, ids[used[col]], sims[row, used[col]].astype(float), np.minimum(q_away[row, home[col]], there)]
            held = [np.concatenate([h, n]) for h, n in zip(held, new)]
            o = np.lexsort((held[1], -held[2], held[0]))
            heads = np.flatnonzero(np.r_[True, held[0][o][1:] != held[0][o][:-1]])
            nth = np.arange(len(o)) - np.repeat(heads, np.diff(np.r_[heads, len(o)]))
            held = [h[o[nth < k]] for h in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) == k)
            floor[full] = np.maximum(floor[full], held[2][np.searchsorted(held[0], full, side="right") - 1])
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[held[0]]), pa.array(held[2]), pa.array(held[1]), pa.array(held[3])], ["q", "cosine", "other", "away"])

    return run


def _border(u: DataFrame, centroids: np.ndarray, dim: int, k: int, least: float, recall: float, mutual: bool) -> float | None:
    """The distance from a border within which the wanted share of the sampled queries' true neighbours lies; null if too few are known.

    mutual: all vectors ask, so a pair is found from either side.
    """
    drawn = u.filter("asks").select("id", "vec", F.xxhash64("id", F.lit(11)).alias("mix")).orderBy("mix", "id").limit(MEASURED_QUERIES).toArrow()
    ids = drawn.column("id").to_numpy()
    if not len(ids):
        return None
    q = unit(_values(drawn.column("vec").combine_chunks()).astype(np.float32), dim)
    near = u.select("id", "vec", "asks").mapInArrow(_true_pairs(centroids, ids, q, dim, k, least, mutual), "q bigint, cosine double, other bigint, away double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cosine").desc(), "other"))
    away = np.sort(near.withColumn("nth", nth).filter(F.col("nth") <= k).select("away").toArrow().column("away").to_numpy())  # k for each sampled query at most
    if len(away) < LEAST_PAIRS:
        return None
    return float(away[-1] * 1.5) if recall >= 1 else float(away[int(np.ceil(recall * len(away))) - 1])


def nearest(rows: DataFrame, *, key: str = "feature_id", vector: str = "features", k: int = 5, order: str | None = "ingested_at", dim: int = 64, queries: Column | None = None, probes: int = 0, margin: float = 0.1, within: float | None = None, recall: float | None = None, width: int = 64, min_similarity: float = -2.0, shard_rows: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id BIGINT, other BIGINT, cosine DOUBLE, rank INT): for each asking vector the k most similar other vectors found.

    queries: which rows ask, as a condition on the column ``id``, all where absent. min_similarity: neighbours below it are left out.
    ``probes`` (shards a query is sent to at most, 0: all), ``margin`` (by how much a centroid's cosine may fall short of the nearest one's) and
    ``width`` (of the beam) trade time for recall; with all shards probed only the graph's own loss is left. ``within`` takes the place of probes and
    margin: all shards are probed that can hold a neighbour of that cosine or more (``reachable``), so of these, too, only the graph's loss is left.
    ``recall`` takes their place in turn: the share of a sample's true neighbours (of ``min_similarity`` at least) whose shards are probed; 1 takes the
    farthest of the sample, half as much again. With fewer than ``LEAST_PAIRS`` such neighbours in the sample the other settings hold.

    Defined cases: rows with a null key take no part; a vector is usable if it has exactly ``dim`` elements, all present and finite, not
    all zero; others take no part; each key counts once, with its earliest usable vector by ``order`` (nulls first; then by a hash of the
    vector); vectors needn't be of length 1; equal cosines go by the smaller other key; exact copies have cosine 1 with one another; with fewer than k
    others there are fewer rows; an empty table gives none; other columns are ignored.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "nearest")
    u = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec"), (F.col(order) if order else F.lit(None).cast("timestamp")).alias("at"))
    u = u.filter(F.col("id").isNotNull() & usable(F.col("vec"), dim))
    hashes = F.struct(F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g"))
    first = F.min(F.struct("at", "mark"))
    kept = ws.save(u.select("id", "at", hashes.alias("mark")).groupBy("id").agg(first["mark"].alias("mark"), (F.min("mark") != F.max("mark")).alias("torn")), "keys")
    n = kept.count()
    result = "id bigint, other bigint, cosine double, rank int"
    if n < 2:
        return spark.createDataFrame([], result)
    # exact copies: all but the smallest key stay out of the index
    twice = kept.groupBy("mark").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copies = ws.save(kept.join(twice, "mark").select("id", "rep"), "copies")
    has_copies = copies.limit(1).count() > 0
    asks = queries if queries is not None else F.lit(True)
    if has_copies:
        notes = copies.select("id", "rep", asks.alias("asks")).groupBy(F.col("rep").alias("id")).agg(F.max("asks").alias("asked")).select("id", F.lit(False).alias("out"), "asked")
        notes = notes.unionByName(copies.filter("id <> rep").select("id", F.lit(True).alias("out"), F.lit(False).alias("asked")))
        u = _note(ws, u, notes, "id").filter("not coalesce(out, false)").withColumn("asks", asks | F.coalesce("asked", F.lit(False))).drop("out", "asked")
    else:
        u = u.withColumn("asks", asks)
    torn = kept.filter("torn").select("id", F.col("mark").alias("right"))
    if torn.limit(1).count():
        u = _note(ws, u, torn, "id").filter(F.col("right").isNull() | (F.col("right") == hashes)).drop("right")
    u = u.select("id", "vec", "asks")
    rows_each = shard_rows or min(MOST_SHARD_ROWS, max(SHARD_ROWS, n // 64))
    cells = max(1, -(-n // rows_each))
    share = min(1.0, max(sample_rows, min(MOST_SAMPLE_ROWS, SAMPLE_OF_A_SHARD * cells)) / n)
    picked = u.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).select("vec", "asks").toArrow()
    sample = unit(_values(picked.column("vec").combine_chunks()).astype(np.float32), dim).astype(np.float32) if len(picked) else np.zeros((0, dim), np.float32)
    how = {"probes": probes, "margin": margin, "within": within}
    if probes <= 0:
        how |= {"probes": cells, "margin": 9.0}
    if cells == 1 or len(sample) < 2:
        centroids, splits, replicas = np.zeros((1, dim), np.float32), np.array([max(1, -(-n // (2 * rows_each)))], np.int64), np.ones(1, np.int64)
    else:
        centroids = fit_cells(sample, cells)
        if recall is not None:
            how["border"] = _border(u, centroids, dim, k, min_similarity, recall, queries is None)
        sims = sample @ centroids.T
        load = np.bincount(sims.argmax(1), minlength=len(centroids)) * (n / len(sample))
        splits = np.maximum(1, np.ceil(load / (2 * rows_each))).astype(np.int64)  # what is still too large is split by key; queries go to each part
        sent = (_probed(centroids, sims, **how) & picked.column("asks").to_numpy()[:, None]).sum(0) * (n / len(sample))
        replicas = np.maximum(1, np.ceil(sent / (QUERIES_OF_A_MEMBER * 2 * rows_each))).astype(np.int64)
    shards = int((splits * replicas).sum())
    routed = u.mapInArrow(_route(centroids, splits, replicas, dim, how), "shard int, id bigint, role tinyint, vec binary")
    ready = routed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("role") == 2, "id")
    found = ready.mapInArrow(_search(dim, k, width, min_similarity, 0), "id bigint, other bigint, cosine double")
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    # two shards may report a pair, each from its side
    once = lambda df: df.repartition("id").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    top = lambda df: once(df).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if not has_copies:
        return top(found)
    found = ws.save(top(found).drop("rank"), "found")
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    firsts = ws.save(copies.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("rep", F.col("id").alias("member")), "firsts")
    wide = found.join(firsts.withColumnRenamed("rep", "other"), "other", "left").select("id", F.coalesce("member", "other").alias("other"), "cosine")
    over = wide.join(copies.select(F.col("id").alias("member"), F.col("rep").alias("id")), "id", "left").select(F.coalesce("member", "id").alias("id"), "other", "cosine")
    if min_similarity <= 1:
        over = over.unionByName(copies.join(firsts, "rep").filter("id <> member").select("id", F.col("member").alias("other"), F.lit(1.0).alias("cosine")))
    return top(over.filter(asks))


def _note(ws: Workspace, rows: DataFrame, notes: DataFrame, on: str) -> DataFrame:
    """Left join to a table of exceptions: broadcast if it's small, else by a shuffle."""
    return rows.join(sized(ws.save(notes, "notes")), on, "left")


def sized(saved: DataFrame) -> DataFrame:
    """A table that ``Workspace.save`` returned, to be broadcast in a join if it's small."""
    return F.broadcast(saved) if stored_bytes(saved) <= BROADCAST_BYTES else saved


def once(ws: Workspace, rows: DataFrame, key: str, first: Column) -> DataFrame:
    """Rows with each key once: of those that come more than once the smallest by ``first``. Only keys are shuffled, and the rows that do come again."""
    again = rows.groupBy(key).count().filter("count > 1").select(key, F.lit(True).alias("_again"))
    noted = _note(ws, rows, again, key)
    columns = rows.columns
    least = noted.filter("_again").groupBy(key).agg(F.min(F.struct(first, *(c for c in columns if c != key))).alias("_r")).select(*(key if c == key else F.col(f"_r.{c}").alias(c) for c in columns))
    return noted.filter("_again is null").select(*columns).unionByName(least)
