"""Grouping records into clusters of mutually similar records.

Method: reciprocal-nearest-neighbour average linkage on a sparse graph. Every record starts as a cluster; the candidates for merging are the
edges of a nearest-neighbour graph (``neighbors.nearest``). In each round the average linkage of the candidate pairs is computed exactly
from the two clusters' sums of unit vectors (the mean of all cosines between A and B is sum(A).sum(B) / (|A| |B|)), every cluster names
its best partner, and all pairs that name each other merge at once. Pairs below the threshold are dropped for good, as average
linkage cannot rise by merging. No pairs within a cluster are formed beyond k a record.

*What the graph doesn't hold.* A list of k neighbours that is full bounds the similarity to all others by its last entry. A cluster carries the mean
of its records' bounds, and merges only above it; what is left then gets new lists over the clusters' means, twice as long.
So the merges are those of average linkage over all pairs, not only over the listed ones.

*Tasks.* While more clusters are left than one task takes, they are dealt into blocks by their best partners, so that pairs that name each other
meet. A block merges all pairs of its own that are each other's best over all their edges; of a partner elsewhere it knows an upper bound of the linkage,
which further merges there can only lower (average linkage is reducible), so every such merge is one of the whole graph, whatever the size of a
block. Then ends are renamed, the bounds of both sides united (the lower one holds), and the rest is dealt anew. The last clusters go through all rounds in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provq.llm import components, neighbors
from provq.runtime import Workspace

#: Scale of the fixed-point sums, which don't depend on the order of rows.
SCALE = float(1 << 30)
#: Clusters whose rounds run in one task.
TASK_CLUSTERS = 50_000
#: Places to which linkages are compared, so that equal ones are equal whatever the order of the sums.
PLACES = 9
#: Room for the search's single precision: what it says of linkages is only a bound, the linkages themselves are computed in double precision.
ROOM = 1e-6
#: Files whose sums a task holds at once.
HELD_FILES = 50_000


def _summed(codes: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes that occur, their sums and counts."""
    o = np.argsort(codes, kind="stable")
    heads = np.flatnonzero(np.r_[True, codes[o][1:] != codes[o][:-1]])
    return codes[o][heads], np.add.reduceat(x[o], heads, axis=0), np.add.reduceat(n[o], heads)


def _partial_sums(dim: int):
    """Sums of unit vectors by file over a task, handed on when too many files are held; sums of one row stay small, as 32-bit integers."""

    def flush(names: list[str], total: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(names), 10_000):
            part, n = total[s : s + 10_000], count[s : s + 10_000]
            raw = [(p.astype(np.int32) if k == 1 else p).tobytes() for p, k in zip(part, n)]
            yield pa.RecordBatch.from_arrays([pa.array(names[s : s + 10_000], pa.string()), pa.array(raw, pa.binary()), pa.array(n)], ["file", "sums", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        total, count = np.zeros((HELD_FILES, dim), np.int64), np.zeros(HELD_FILES, np.int64)
        for b in (whole.slice(i, HELD_FILES) for whole in batches for i in range(0, whole.num_rows, HELD_FILES)):
            named = b.column(0).dictionary_encode()
            if len(place) + len(named.dictionary) > HELD_FILES:
                yield from flush(list(place), total[: len(place)], count[: len(place)])
                place.clear()
                total[:], count[:] = 0, 0
            at = np.array([place.setdefault(f, len(place)) for f in named.dictionary.to_pylist()])
            x = np.rint(neighbors.unit(neighbors._values(b.column(1)), dim) * SCALE).astype(np.int64)
            codes, sums, n = _summed(at[named.indices.to_numpy()], x, np.ones(len(x), np.int64))
            total[codes] += sums
            count[codes] += n
        yield from flush(list(place), total[: len(place)], count[: len(place)])

    return run


def _means(dim: int):
    """Partial sums, sorted by file -> each file's mean, scaled to length 1. A file may go on in the next batch."""

    def means(names: pa.Array, total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        mean = total / SCALE
        norm = np.sqrt(np.einsum("ij,ij->i", mean, mean))
        mean = mean / np.where(norm > 0, norm, 1)[:, None]
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, mean.size + 1, dim), pa.int32()), pa.array(mean.ravel()))
        return pa.RecordBatch.from_arrays([names, values, pa.array(count)], ["file", "vec", "n_vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).to_pylist()
            x = np.stack([np.frombuffer(r, np.int32 if len(r) == dim * 4 else np.int64).astype(np.int64) for r in raw])
            n, files = b.column(2).to_numpy(), b.column(0)
            if last is not None:
                files = pa.concat_arrays([pa.array([last[0]], pa.string()), files])
                x, n = np.concatenate([last[1][None], x]), np.concatenate([[last[2]], n])
            named = files.dictionary_encode()
            codes, total, count = _summed(named.indices.to_numpy(), x, n)
            last = (named.dictionary[-1].as_py(), total[-1], count[-1])
            if len(codes) > 1:
                yield means(named.dictionary.slice(0, len(codes) - 1), total[:-1], count[:-1])
        if last is not None:
            yield means(pa.array([last[0]], pa.string()), last[1][None], np.array([last[2]]))

    return run


def file_vectors(rows: DataFrame, *, key: str = "feature_id", file: str = "file", vector: str = "features", order: str = "ingested_at", dim: int = 64) -> DataFrame:
    """(file, vec ARRAY<DOUBLE>, n_vectors): the mean of a file's usable vectors, each scaled to length 1 first, itself scaled to length 1.

    A key counts once, with its earliest usable row; rows without key or file take no part. A mean of zero stays zero. Sums are taken before the
    shuffle, so a file that holds a third of all rows reaches one task as one row for each partition.
    """
    u = rows.select(F.col(key).alias("id"), F.col(file).alias("file"), F.col(vector).cast("array<float>").alias("vec"), F.col(order).alias("at"))
    u = u.filter(F.col("id").isNotNull() & neighbors.usable(F.col("vec"), dim))
    single = neighbors.once(Workspace(rows.sparkSession, "files"), u, "id", F.struct("at", F.xxhash64("vec").alias("h")).alias("first"))
    part = single.select("file", "vec").filter("file is not null").mapInArrow(_partial_sums(dim), "file string, sums binary, n bigint")
    return part.repartition("file").sortWithinPartitions("file").mapInArrow(_means(dim), "file string, vec array<double>, n_vectors bigint")


_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (t, x) -> t + x)"


class _Block:
    """Clusters of one task with their edges, and the rounds over them.

    ids: of the clusters, ascending, then of partners elsewhere. n, s, spare: sizes, sums, and by how much the bound of what isn't listed is above
    ``least``. a, b: candidate pairs within the block. x, g, e: pairs with partners elsewhere, e the size times the linkage's excess over the bound, which
    adds up when clusters merge. Equal linkages go by the smaller pair of ids.
    """

    def __init__(self, ids, n, s, spare, least, a, b, x, g, e):
        self.ids, self.n, self.s, self.spare, self.least, self.a, self.b, self.x, self.g, self.e = ids, n, s, spare, least, a, b, x, g, e
        self.root = np.arange(len(n))
        self.sim, self.stale = np.empty(len(a)), np.ones(len(a), bool)

    def linkages(self) -> np.ndarray:
        """Exact linkages of the pairs within the block; those below the threshold go. Returns which stayed."""
        a, b = self.a, self.b
        for i in np.array_split(np.flatnonzero(self.stale), max(1, self.stale.sum() // 50_000)):
            self.sim[i] = np.einsum("ij,ij->i", self.s[a[i]], self.s[b[i]]) / (self.n[a[i]] * self.n[b[i]])
        ok = self.sim >= self.least
        self.a, self.b, self.sim, self.stale = a[ok], b[ok], self.sim[ok], np.zeros(ok.sum(), bool)
        return ok

    def elsewhere(self) -> np.ndarray:
        """Upper bounds of the linkages with partners elsewhere."""
        return self.least + self.spare[self.x] + self.e / self.n[self.x]

    def round(self) -> bool:
        self.linkages()
        bound = self.elsewhere()
        out = bound >= self.least
        own, other = np.concatenate([self.a, self.b, self.x[out]]), np.concatenate([self.b, self.a, self.g[out]])
        if not len(own):
            return False
        value = np.round(np.concatenate([self.sim, self.sim, bound[out]]), PLACES)
        o = np.lexsort((self.ids[other], -value, own))
        first = o[np.r_[True, own[o][1:] != own[o][:-1]]]
        best, top = np.full(len(self.ids), -1), np.zeros(len(self.n))
        best[own[first]], top[own[first]] = other[first], value[first]
        x = own[first]
        x = x[(x < best[x]) & (best[best[x]] == x)]
        y = best[x]
        sure = top[x] >= np.round(self.least + np.maximum(self.spare[x], self.spare[y]), PLACES)
        x, y = x[sure], y[sure]
        if not len(x):
            return False
        n = self.n[x] + self.n[y]
        self.spare[x] = (self.n[x] * self.spare[x] + self.n[y] * self.spare[y]) / n
        self.s[x] += self.s[y]
        self.n[x] = n
        self.root[y] = x
        changed = np.zeros(len(self.n), bool)
        changed[x] = changed[y] = True
        self.stale = changed[self.a] | changed[self.b]
        a, b = self.root[self.a], self.root[self.b]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        _, keep = np.unique(lo * len(self.n) + hi, return_index=True)
        keep = keep[lo[keep] != hi[keep]]
        self.a, self.b, self.sim, self.stale = lo[keep], hi[keep], self.sim[keep], self.stale[keep]
        pair, at = np.unique(self.root[self.x] * len(self.ids) + self.g, return_inverse=True)
        self.x, self.g, self.e = pair // len(self.ids), pair % len(self.ids), np.bincount(at, weights=self.e, minlength=len(pair))
        return True

    def run(self) -> None:
        while self.round():
            pass
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]


def merge_rounds(n: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The cluster that each cluster ends in, by place; sizes n and sums s are brought up to date at those places.

    a, b: candidate pairs, all that there are. Equal linkages go by the smaller pair of places.
    """
    none = np.empty(0, np.int64)
    block = _Block(np.arange(len(n)), n, s, np.zeros(len(n)), least, a, b, none, none, np.empty(0))
    block.run()
    return block.root


#: Rows of a block: kind 0 a cluster c and its root, with the root's size, sums and spare bound where c is the root; 1 an edge; 2 merges and edges that became exact.
_ROWS = "kind tinyint, a bigint, b bigint, n bigint, s array<double>, spare double, sim double, grown boolean"


def _merge_task(least: float, dim: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        edge = t.column("b").is_valid().to_numpy(zero_copy_only=False)
        nodes, edges = t.filter(pa.array(~edge)), t.filter(pa.array(edge))
        c = nodes.column("a").to_numpy()
        order = np.argsort(c)
        c = c[order]
        m = len(c)
        n, spare = (nodes.column(k).to_numpy()[order].copy() for k in ("n", "spare"))
        s = nodes.column("s").combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
        own, other, sim = (edges.column(k).to_numpy() for k in ("a", "b", "sim"))
        x = np.searchsorted(c, own)
        at = np.minimum(np.searchsorted(c, other), m - 1)
        here = c[at] == other
        ghosts, g = np.unique(other[~here], return_inverse=True)
        once = here & (own < other)
        e = n[x[~here]] * (sim[~here] - least - spare[x[~here]])
        block = _Block(np.concatenate([c, ghosts]), n, s, spare, least, x[once], at[once], x[~here], m + g, e)
        before = sim[once]
        could = before >= np.round(least + np.maximum(spare[x[once]], spare[at[once]]), PLACES) - 10.0**-PLACES  # which could merge, as far as was known
        stayed = block.linkages()
        lower = ~stayed
        lower[stayed] = block.sim < before[stayed] - 10.0**-PLACES
        tighter = int((could & lower).sum())
        block.run()
        root = block.root
        top = root == np.arange(m)
        grown = np.bincount(root, minlength=m) > 1
        a = np.concatenate([block.a, block.b, block.x])
        b = np.concatenate([block.b, block.a, block.g])
        sims = np.concatenate([block.sim, block.sim, block.elsewhere()])
        k = len(a)
        none = lambda size, kind: pa.nulls(size, kind)
        return pa.table({
            "kind": pa.array(np.concatenate([np.zeros(m), np.ones(k), [2]]).astype(np.int8)),
            "a": pa.array(np.concatenate([c, c[a], [0]])),
            "b": pa.array(np.concatenate([c[root], block.ids[b], [0]])),
            "n": pa.chunked_array([pa.array(n), none(k, pa.int64()), pa.array([int((~top).sum()) + tighter])]),
            "s": pa.chunked_array([pa.array([s[i] if r else None for i, r in enumerate(top)], pa.list_(pa.float64())), none(k + 1, pa.list_(pa.float64()))]),
            "spare": pa.array(np.concatenate([spare, spare[a], [0.0]])),
            "sim": pa.chunked_array([none(m, pa.float64()), pa.array(sims), none(1, pa.float64())]),
            "grown": pa.chunked_array([pa.array(grown[root]), none(k + 1, pa.bool_())]),
        })

    return run


def _blocks(ws: Workspace, directed: DataFrame, clusters: int, task_clusters: int) -> DataFrame:
    """(c, block): clusters dealt so that those that name each other meet, mostly with those that name one of them."""
    best = directed.groupBy(F.col("a").alias("c")).agg(F.min(F.struct((-F.round("sim", PLACES)).alias("v"), "b"))["b"].alias("best"))
    best = ws.save(best, "best")
    two = best.join(best.select(F.col("c").alias("best"), F.col("best").alias("second")), "best")
    keyed = ws.save(two.select("c", F.least("best", "second").alias("key"), (F.col("c") == F.col("second")).alias("mutual")), "keyed")
    # a cluster that very many name: the pair stays together, the others are dealt by themselves
    large = keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > max(1, task_clusters // 2))
    salt = F.when(F.col("size").isNotNull() & ~F.col("mutual"), F.xxhash64("c")).otherwise(F.lit(0))
    block = F.pmod(F.xxhash64("key", salt), F.lit(-(-clusters // task_clusters))).cast("int")
    return ws.save(keyed.join(large, "key", "left").select("c", block.alias("block")), "blocks")


def _merged(ws: Workspace, state: DataFrame, edges: DataFrame, least: float, dim: int, task_clusters: int, ups: list[DataFrame]) -> tuple[DataFrame, DataFrame, bool]:
    """Merge all pairs that can be; ups: gets (v, parent) of what merged away. Returns the clusters that are left, their edges, and whether any merged."""
    merged = False
    while True:
        directed = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        ends = ws.save(directed.select(F.col("a").alias("c"), F.lit(0).alias("block")).distinct(), "ends")
        clusters = ends.count()
        if not clusters:
            return state, edges, merged
        blocks = ends if clusters <= task_clusters else _blocks(ws, directed, clusters, task_clusters)
        at = neighbors.sized(blocks).withColumnRenamed("c", "a")
        void = lambda kind: F.lit(None).cast(kind)
        nodes = state.withColumnRenamed("c", "a").join(at, "a").select("block", "a", void("bigint").alias("b"), "n", "s", "spare", void("double").alias("sim"))
        links = directed.join(at, "a").select("block", "a", "b", void("bigint").alias("n"), void("array<double>").alias("s"), void("double").alias("spare"), "sim")
        rows = nodes.unionByName(links).repartition(max(1, -(-clusters // task_clusters)), "block")
        got = ws.save(rows.groupBy("block").applyInArrow(_merge_task(least, dim), _ROWS), "merged")
        moved = got.filter("kind = 2").agg(F.sum("n")).first()[0]
        place = got.filter("kind = 0")
        if moved:
            merged = True
            ups.append(place.filter("a <> b").select(F.col("a").alias("v"), F.col("b").alias("parent")))
            state = ws.save(state.join(neighbors.sized(blocks).select("c"), "c", "left_anti").unionByName(place.filter("a = b").select(F.col("a").alias("c"), "n", "s", "spare")), "state")
        # both sides know a bound; a partner that grew may hold what this side never listed
        renamed = got.filter("kind = 1").select("a", F.col("b").alias("old"), "spare", "sim").join(place.select(F.col("a").alias("old"), "b", "grown"), "old")
        bound = F.when(F.col("grown") & (F.col("spare") > 0), F.greatest("sim", least + F.col("spare"))).otherwise(F.col("sim"))
        lo = F.col("a") < F.col("b")
        sides = renamed.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(lo, bound).alias("p"), F.when(~lo, bound).alias("q"))
        edges = ws.save(sides.groupBy("a", "b").agg(F.max("p").alias("p"), F.max("q").alias("q")).select("a", "b", F.least("p", "q").alias("sim")).filter(F.col("sim") >= least), "edges")
        if not moved or clusters <= task_clusters:
            return state, edges, merged


def similarity_clusters(records: DataFrame, *, key: str = "file", vector: str = "vec", least: float = 0.9, k: int = 10, dim: int = 64, task_clusters: int = TASK_CLUSTERS) -> DataFrame:
    """(record, cluster BIGINT, n BIGINT, typicality DOUBLE): the cluster of each record, n its size.

    typicality is the mean cosine of the record to the others of its cluster, null for a record alone. Clusters are those of average
    linkage at the threshold ``least``; where mutually similar groups are apart from each other they are those groups. Records with equal
    vectors start as one cluster. They don't depend on ``task_clusters``, which only sets the size of a task, nor, but for what the search of
    neighbours misses, on ``k``.

    Defined cases: rows with a null key or an unusable vector (see ``neighbors.nearest``) take no part; of several rows of a key the one with the
    smallest vector counts; equal linkages go by the smaller internal number; a record similar to no other is a
    cluster of its own; other columns are ignored; an empty table gives no rows.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "clusters")
    r = records.select(F.col(key).alias("record"), F.col(vector).cast("array<double>").alias("vec")).filter(F.col("record").isNotNull() & neighbors.usable(F.col("vec"), dim))
    norm = F.expr("sqrt(" + _DOT.format("vec", "vec") + ")")
    r = neighbors.once(ws, r, "record", F.col("vec").alias("least")).withColumn("norm", norm).select("record", F.expr("transform(vec, x -> x / norm)").alias("vec"))
    r = ws.save(r.withColumn("same", F.struct(F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g"))), "records")
    # numbered in the order of records and written once, so that the numbers hold
    start = r.groupBy("same").agg(F.count("*").alias("n"), F.min("record").alias("record")).repartitionByRange("record").sortWithinPartitions("record")
    start = ws.save(start.withColumn("c", F.monotonically_increasing_id()), "start")
    state = ws.save(r.select("record", "vec").join(neighbors.sized(start).drop("same"), "record").select("c", "n", F.expr("transform(vec, x -> x * n)").alias("s")), "state")
    done, ups = state.limit(0), []
    while True:
        near = neighbors.nearest(state, key="c", vector="s", k=k, order=None, dim=dim, min_similarity=least - ROOM, within=least - ROOM, recall=neighbors.ALL_OF_SAMPLE, width=max(40, 2 * k + 8))
        near = ws.save(near.select("id", "other", "cosine"), "near")
        # a full list bounds what it doesn't hold by its last entry; means are shorter than 1, so linkages are below cosines
        full = ws.save(near.groupBy(F.col("id").alias("c")).agg(F.count("*").alias("found"), F.min("cosine").alias("last")).filter(F.col("found") == k), "full")
        lengths = ws.save(state.select("c", F.expr("sqrt(" + _DOT.format("s", "s") + ") / n").alias("length")), "lengths")
        bound = F.greatest(F.lit(0.0), F.coalesce(F.col("last") * F.col("length") + ROOM - least, F.lit(0.0)))
        bounds = ws.save(lengths.join(neighbors.sized(full), "c").select("c", bound.alias("spare")), "bounds")
        state = state.join(neighbors.sized(bounds), "c", "left").withColumn("spare", F.coalesce("spare", F.lit(0.0)))
        ends = [neighbors.sized(lengths).select(F.col("c").alias(e), F.col("length").alias("l" + e)) for e in "ab"]
        pairs = near.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("cosine").alias("cosine"))
        edges = ws.save(pairs.join(ends[0], "a").join(ends[1], "b").withColumn("sim", F.col("cosine") * F.col("la") * F.col("lb") + ROOM).filter(F.col("sim") >= least).select("a", "b", "sim"), "edges")
        state, edges, merged = _merged(ws, state, edges, least, dim, task_clusters, ups)
        # only what may have a partner beyond its list goes on, and its partners
        open_ = edges.select(F.explode(F.array("a", "b")).alias("c")).distinct().unionByName(state.filter("spare > 0").select("c")).distinct()
        open_ = ws.save(open_, "open")
        if not open_.limit(1).count():
            break
        done = done.unionByName(state.join(neighbors.sized(open_), "c", "left_anti").select("c", "n", "s"))
        state = ws.save(state.join(neighbors.sized(open_), "c", "left_semi").select("c", "n", "s"), "state")
        k *= 2
    names = r.select("record", "vec", "same").join(neighbors.sized(start).select("same", "c"), "same")
    if ups:
        gone = ups[0]
        for u in ups[1:]:
            gone = gone.unionByName(u)
        names = names.join(components.resolve(ws, gone).withColumnRenamed("v", "c"), "c", "left").select("record", "vec", F.coalesce("root", "c").alias("c"))
    sums = done.unionByName(state.select("c", "n", "s"))
    return names.join(sums, "c").select("record", F.col("c").alias("cluster"), "n", F.when(F.col("n") > 1, (F.expr(_DOT.format("vec", "s")) - 1) / (F.col("n") - 1)).alias("typicality"))


def describe(clustered: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_file, n, typical ARRAY): each cluster of two or more, by its smallest record, with its most typical members (ties by record)."""
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("typicality", 9).desc(), "record"))
    several = clustered.filter("n > 1")
    names = several.groupBy("cluster").agg(F.min("record").alias("cluster_file"), F.max("n").alias("n"))
    tops = several.withColumn("nth", nth).filter(F.col("nth") <= typical).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("nth", "record"))).alias("t"))
    return names.join(tops, "cluster").select("cluster_file", "n", F.col("t.record").alias("typical"))
