"""Measures of paired images that their nearest features give, taken where the distances are, so that these never leave a task.

A probe with many features is compared with nearly every image; the nearest features of all its pairs are far more rows than the tables have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provq.operators import matching, search
from provq.runtime import Workspace, read_shared, shared_path

#: Base rows that a task gathers, of whole images; features from which a probe is compared by matrix products; their rows at once.
GATHERED, MANY, ROWS = 20_000, 256, 2_048


def _two_nearest(x: np.ndarray, b: np.ndarray, row: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of query rows and images (b: images, features, elements) the nearest feature's place, its distance and the second's (NaN where there is one feature)."""
    at, one, two = np.empty(len(row), np.int64), np.empty(len(row)), np.full(len(row), np.nan)
    step = max(1, 100_000 // b.shape[1])
    for s in range(0, len(row), step):
        d = np.maximum(np.round(2 - 2 * np.einsum("ij,ikj->ik", x[row[s : s + step]], b[image[s : s + step]]), 9), 0) + 0.0
        at[s : s + step] = d.argmin(1)
        if d.shape[1] > 1:
            d.partition(1, axis=1)
            two[s : s + step] = d[:, 1]
        one[s : s + step] = d.min(1)
    return at, one, two


def _firsts(*keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


class _Ratio:
    """Matches of the ratio test; single: of those of one feature of an image the nearest only."""

    schema = "probe_id bigint, image_id bigint, q_feature bigint, feature_id bigint, dist double, ratio double"

    def __init__(self, most: float, single: bool):
        self.most, self.single = most, single

    def many(self, q, x, x32, b):
        """(query rows, images) that may match, by products in single precision."""
        if b.shape[1] < 2:
            return
        t, slack, b32 = np.float32(self.most**2), np.float32(4 * search._slack(x.shape[1])), b.astype(np.float32)
        low = np.full((b.shape[1], len(b)), -np.inf, np.float32)
        for s in range(0, len(x), ROWS):
            g = [x32[s : s + ROWS] @ b32[:, j].T for j in range(b.shape[1])]
            one, two = np.maximum(g[0], g[1]), np.minimum(g[0], g[1])
            for y in g[2:]:
                np.maximum(two, np.minimum(one, y), out=two)
                np.maximum(one, y, out=one)
            h = one - t * two
            maybe = h > 1 - t - slack
            if self.single:
                sure, beats = np.where(h > 1 - t + slack, one, np.float32(-np.inf)), np.zeros(one.shape, bool)
                for j, y in enumerate(g):  # a match that is sure to be nearer leaves none behind it a chance
                    np.maximum(low[j], np.where(y == one, sure, np.float32(-np.inf)).max(0), out=low[j])
                    beats |= y >= np.maximum(one, low[j]) - slack
                maybe &= beats
            at = np.flatnonzero(maybe)
            yield s + at // len(b), at % len(b)

    def finish(self, probe, image, q, feature, one, two):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.round(np.sqrt(one / two), 9)
            keep = np.flatnonzero((two > 0) & (ratio < self.most))
        probe, image, q, feature, one, ratio = (v[keep] for v in (probe, image, q, feature, one, ratio))
        if self.single and len(probe):
            o = np.lexsort((q, one, feature, image, probe))
            o = o[_firsts(probe[o], image[o], feature[o])]
            probe, image, q, feature, one, ratio = (v[o] for v in (probe, image, q, feature, one, ratio))
        return probe, image, q, feature, one, ratio

    def rest(self, near: DataFrame) -> DataFrame:
        got = matching.ratio_test(near, self.most)
        return matching.one_to_one(got) if self.single else got


class _Share:
    """The mean of the smallest distances of a pair that together make up at most a share of their sum."""

    schema = "probe_id bigint, image_id bigint, n bigint, mean_dist double"

    def __init__(self, share: float):
        self.share = share

    def whole(self, x, b) -> tuple[np.ndarray, np.ndarray]:
        """(rows kept, their mean) of each image, for one probe."""
        near = x @ b[:, 0].T
        for j in range(1, b.shape[1]):
            np.maximum(near, x @ b[:, j].T, out=near)
        d = np.ascontiguousarray((np.maximum(np.round(2 - 2 * near, 9), 0) + 0.0).T)
        d.sort(axis=1)
        run = d.cumsum(1)
        n = (np.round(run, 7) <= np.round(run[:, -1:] * self.share, 7)).sum(1)
        return n, run[np.arange(len(d)), np.maximum(n, 1) - 1] / np.maximum(n, 1)

    def finish(self, probe, image, q, feature, one, two):
        o = np.lexsort((q, one, image, probe))
        probe, image, one = probe[o], image[o], one[o]
        heads = _firsts(probe, image)
        sizes = np.diff(np.r_[heads, len(probe)])
        run = np.cumsum(one)
        run -= np.repeat(run[heads] - one[heads], sizes)
        last = heads + sizes - 1
        kept = np.round(run, 7) <= np.repeat(np.round(run[last] * self.share, 7), sizes)
        n = np.add.reduceat(kept.astype(np.int64), heads)
        some = n > 0
        return probe[heads][some], image[heads][some], n[some], (np.add.reduceat(np.where(kept, one, 0.0), heads)[some] / n[some])

    def rest(self, near: DataFrame) -> DataFrame:
        return matching.cumulative_share_mean(near.filter("nth = 1"), self.share)


def _measured(path: str, measure):
    names = [c.split()[0] for c in measure.schema.split(", ")]

    def batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def solve(t: pa.Table, asked: tuple):
        of, q, x, x32 = asked
        void = t.column("feature_id").is_null()
        pairs, rows = t.filter(void), t.filter(pa.compute.invert(void))
        image, ids = rows.column("image_id").to_numpy(), rows.column("feature_id").to_numpy()
        if not len(image) or not pairs.num_rows:
            return
        o = np.lexsort((ids, image))
        image, ids, b = image[o], ids[o], search._matrix(rows)[o]
        heads = _firsts(image)
        sizes = np.diff(np.r_[heads, len(image)])
        probe, other = pairs.column("probe_id").to_numpy(), pairs.column("image_id").to_numpy()
        at = np.minimum(np.searchsorted(image[heads], other), len(heads) - 1)
        begin, end = np.searchsorted(of, probe, "left"), np.searchsorted(of, probe, "right")
        held = (image[heads][at] == other) & (begin < end)
        probe, at, begin, end = probe[held], at[held], begin[held], end[held]
        for size in np.unique(sizes[at]):
            same = np.flatnonzero(sizes[at] == size)
            few = same[end[same] - begin[same] < MANY]
            for f in np.split(few, np.arange(4_000, len(few), 4_000)):
                if len(f):
                    n = end[f] - begin[f]
                    row = np.repeat(begin[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    nth, which = np.unique(at[f], return_inverse=True)
                    which = np.repeat(which, n)
                    places = heads[nth][:, None] + np.arange(size)
                    a, one, two = _two_nearest(x, b[places], row, which)
                    yield batch(measure.finish(of[row], image[heads[nth]][which], q[row], ids[places[which, a]], one, two))
            many = same[end[same] - begin[same] >= MANY]
            for p in np.unique(probe[many]):
                own = many[probe[many] == p]
                i, j = begin[own[0]], end[own[0]]
                # products of at most four million numbers
                step = max(1, 4_000_000 // ((j - i) if isinstance(measure, _Share) else ROWS * size))
                for s in range(0, len(own), step):
                    nth = at[own[s : s + step]]
                    places = heads[nth][:, None] + np.arange(size)
                    block = b[places]
                    if isinstance(measure, _Share):
                        n, mean = measure.whole(x[i:j], block)
                        some = n > 0
                        yield batch((np.full(some.sum(), p), image[heads[nth]][some], n[some], mean[some]))
                        continue
                    found = []
                    for row, which in measure.many(q[i:j], x[i:j], x32[i:j], block):
                        a, one, two = _two_nearest(x[i:j], block, row, which)
                        got = measure.finish(np.full(len(row), p), image[heads[nth]][which], q[i:j][row], ids[places[which, a]], one, two)
                        if measure.single:
                            found.append((*got, np.full(len(got[0]), 0)))
                        else:
                            yield batch(got)
                    if found:
                        probes, images, qs, features, dist, ratio, _ = (np.concatenate(v) for v in zip(*found))
                        o = np.lexsort((qs, dist, features, images))
                        o = o[_firsts(images[o], features[o])] if len(o) else o
                        yield batch(v[o] for v in (probes, images, qs, features, dist, ratio))

    def run(batches):
        asked, waiting, n = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if asked is None:
                t = read_shared(path).sort_by([("probe_id", "ascending"), ("q_feature", "ascending")])
                x = search._matrix(t)
                asked = (t.column("probe_id").to_numpy(), t.column("q_feature").to_numpy(), x, x.astype(np.float32) if isinstance(measure, _Ratio) else x)
            waiting.append(b)
            n += b.num_rows
            if n >= GATHERED:
                t = pa.Table.from_batches(waiting)
                image = t.column("image_id").to_numpy()
                whole = int(np.searchsorted(image, image[-1]))  # the last image may go on in the next batch
                yield from solve(t.slice(0, whole), asked)
                t = t.slice(whole)
                waiting, n = t.to_batches(), t.num_rows
        if waiting:
            yield from solve(pa.Table.from_batches(waiting), asked)

    return run


def _measure(pairs: DataFrame, queries: DataFrame, base: DataFrame, measure) -> DataFrame:
    """pairs(probe_id, image_id), queries(probe_id, q_feature, v), base(image_id, feature_id, v), in tasks of whole images; images of more than
    ``search.PAIR_BLOCK`` features are cut, and their nearest features put together between tasks."""
    spark = base.sparkSession
    ws = Workspace(spark, "pairs")
    pairs = ws.save(pairs.select("probe_id", "image_id"), "pairs")
    path = shared_path(ws.save(queries.select("probe_id", "q_feature", "v"), "queries"))
    large = ws.save(base.groupBy("image_id").count().filter(F.col("count") > search.PAIR_BLOCK).select("image_id"), "large")
    void = lambda kind: F.lit(None).cast(kind)
    held = base.join(large, "image_id", "left_anti").select("image_id", "feature_id", "v", void("bigint").alias("probe_id"))
    asked = pairs.join(large, "image_id", "left_anti").select("image_id", void("bigint").alias("feature_id"), void("array<double>").alias("v"), "probe_id")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = held.unionByName(asked).repartition(tasks, "image_id").sortWithinPartitions("image_id")
    out = rows.mapInArrow(_measured(path, measure), measure.schema)
    if large.limit(1).count():
        near = search.pair_nearest(pairs.join(large, "image_id", "left_semi"), queries, base.join(large, "image_id", "left_semi"), 2)
        out = out.unionByName(measure.rest(near).select(*out.columns))
    return out


def ratio_matches(pairs: DataFrame, queries: DataFrame, base: DataFrame, most: float = 0.8, *, single: bool = False) -> DataFrame:
    """``matching.ratio_test`` of the paired images' nearest features, and ``matching.one_to_one`` of that where single."""
    return _measure(pairs, queries, base, _Ratio(most, single))


def share_means(pairs: DataFrame, queries: DataFrame, base: DataFrame, share: float = 0.65) -> DataFrame:
    """``matching.cumulative_share_mean`` of the paired images' nearest features."""
    return _measure(pairs, queries, base, _Share(share))
