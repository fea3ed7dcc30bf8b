"""Robust-pruned directed graph over the vectors of one shard, in numpy, many searches at a time.

Vectors are of length 1 and distances are 1 - cosine. Points are inserted in batches that double the graph at most; greedy searches on
the graph so far propose the neighbours of a batch, relaxed distance pruning keeps a diverse few of them, and edges are
added in the other direction, pruned again where a point gets too many.
"""

from __future__ import annotations

import numpy as np

_FAR = np.iinfo(np.int64).max
_BLOCK = 512


def _keys(dist: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sortable integers of (distance, id, expanded flag); the flag is the lowest bit, 0 at first."""
    bits = np.maximum(dist, 0).astype(np.float32).view(np.int32).astype(np.int64)
    return bits << 32 | ids.astype(np.int64) << 1


def _ids(keys: np.ndarray) -> np.ndarray:
    return (keys & 0xFFFFFFFF) >> 1


def _dists(keys: np.ndarray) -> np.ndarray:
    return (keys >> 32).astype(np.int32).view(np.float32).reshape(keys.shape)


def _near(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    return 1 - np.matmul(x.take(ids, axis=0, mode="clip"), q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy best-first search of all queries at once.

    graph: neighbours by point, filled up with the point itself. start: points from which every search begins, or one row for each query.
    Returns the sorted keys of the best ``width`` points of each query, and the ids of the first points it expanded.
    """
    n_q = len(q)
    if start.ndim == 1:
        start = np.broadcast_to(start, (n_q, len(start)))
    keys = np.full((n_q, width), _FAR)
    first = np.sort(_keys(_near(x, start, q), start), axis=1)
    first[:, 1:][first[:, 1:] == first[:, :-1]] = _FAR
    first = np.sort(first, axis=1)[:, :width]
    keys[:, : first.shape[1]] = first
    trail = np.repeat(start[:, :1], 8, axis=1)
    live, beam, ql = np.arange(n_q), keys, q
    hop = 0
    while len(live):
        todo = (beam & 1 == 0) & (beam != _FAR - 1) & (beam != _FAR)
        at = todo.argmax(1)
        go = todo[np.arange(len(live)), at]
        if not go.all():
            keys[live] = beam
            live, beam, ql, at = live[go], beam[go], ql[go], at[go]
            if not len(live):
                break
        row = np.arange(len(live))
        cur = _ids(beam[row, at])
        beam[row, at] |= 1
        if hop < 8:
            trail[live, hop] = cur
        nb = graph.take(cur, axis=0, mode="clip")
        both = np.concatenate([beam, _keys(_near(x, nb, ql), nb)], axis=1)
        both.sort(axis=1)
        same = both[:, :-1] >> 1 == both[:, 1:] >> 1  # the expanded one of equal points comes last and stays
        both[:, :-1][same] = _FAR
        if same.any():
            both.sort(axis=1)
        beam = both[:, :width]
        hop += 1
    return keys, trail


def robust_prune(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of the candidates of each point (rows sorted by distance, inf: none), the neighbours that stay; -1 fills up.

    The nearest candidate is kept and every other that is nearer to it, by the factor alpha, than to the point itself is dropped, again and again.
    """
    n, c = ids.shape
    if c > 64:
        raise ValueError("64 candidates at most")
    v = x.take(ids, axis=0, mode="clip")
    near = 1 - np.matmul(v, v.transpose(0, 2, 1))
    near *= np.float32(alpha)
    drop = np.zeros((n, c, 64), dtype=bool)  # a bit for each candidate, so that a step costs a few operations on one integer
    np.less_equal(near, dist[:, None, :], out=drop[:, :, :c])
    keep = ~np.packbits(drop, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    full = np.zeros((n, 64), dtype=bool)
    full[:, :c] = np.isfinite(dist)
    alive = np.packbits(full, axis=1, bitorder="little").view(np.uint64)[:, 0]
    out = np.full((n, degree), -1, dtype=np.int64)
    row, one = np.arange(n), np.uint64(1)
    for k in range(degree):
        has = alive != 0
        if not has.all():
            row, alive = row[has], alive[has]
            if not len(row):
                break
        low = alive & (~alive + one)
        at = np.bitwise_count(low - one)
        out[row, k] = ids[row, at]
        alive &= keep[row, at] & ~low
    return out


def _sorted_candidates(dist: np.ndarray, ids: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    keys = _keys(dist, ids)
    keys[ids == own[:, None]] = _FAR
    keys.sort(axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = _FAR
    keys.sort(axis=1)
    keys = keys[:, :most]
    d = _dists(keys).copy()
    none = keys == _FAR
    d[none] = np.inf
    return np.where(none, 0, _ids(keys)), d


def build(x: np.ndarray, degree: int = 10, slots: int = 16, width: int = 20, alpha: float = 1.3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries): ``slots`` neighbours by point at most, filled up with the point itself, and the points where searches begin."""
    n = len(x)
    graph = np.repeat(np.arange(n, dtype=np.int32)[:, None], slots, axis=1)
    used = np.zeros(n, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    entries = order[: min(n, 8)]
    at = len(entries)
    for i in entries:  # the first points know each other
        others = entries[entries != i][:slots]
        graph[i, : len(others)] = others
        used[i] = len(others)
    while at < n:
        batch = order[at : at + max(1, min(at, _BLOCK, n - at))]
        at += len(batch)
        keys, trail = beam_search(x, graph, x[batch], entries, width)
        keys = keys[:, : width]
        found = keys != _FAR
        ids = np.concatenate([np.where(found, _ids(keys), batch[:, None]), trail], axis=1)
        dist = np.concatenate([np.where(found, _dists(keys), np.float32(0)), _near(x, trail, x[batch])], axis=1)
        c_ids, c_dist = _sorted_candidates(dist, ids, batch, min(64, width + 4))
        kept = robust_prune(x, c_ids, c_dist, degree, alpha)
        has = kept >= 0
        graph[batch, :degree] = np.where(has, kept, batch[:, None])
        used[batch] = has.sum(1)
        src, dst = np.repeat(batch, degree)[has.ravel()], kept.ravel()[has.ravel()]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        heads = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        rank = np.arange(len(dst)) - np.repeat(heads, np.diff(np.r_[heads, len(dst)]))
        slot = used[dst] + rank
        fits = slot < slots
        graph[dst[fits], slot[fits]] = src[fits]
        targets = dst[heads]
        counts = np.diff(np.r_[heads, len(dst)])
        over = used[targets] + counts > slots
        used[targets] = np.minimum(used[targets] + counts, slots)
        if over.any():
            full = targets[over]
            extra = np.repeat(full[:, None], slots, axis=1)  # what found no slot, up to as many again
            where = np.full(n, -1)
            where[full] = np.arange(len(full))
            late = ~fits & (slot - slots < slots)
            extra[where[dst[late]], (slot - slots)[late]] = src[late]
            ids = np.concatenate([graph[full], extra], axis=1)
            c_ids, c_dist = _sorted_candidates(_near(x, ids, x[full]), ids, full, min(64, 2 * slots))
            kept = robust_prune(x, c_ids, c_dist, degree, alpha)
            has = kept >= 0
            graph[full] = full[:, None]
            graph[full, :degree] = np.where(has, kept, full[:, None])
            used[full] = has.sum(1)
    if n > 1:  # a point that pruning left without a way in gets one from its nearest neighbour
        ways = np.bincount(graph[graph != np.arange(n)[:, None]], minlength=n)
        lost = np.flatnonzero((ways == 0) & (graph[:, 0] != np.arange(n)))
        near = graph[lost, 0]
        graph[near, np.minimum(used[near], slots - 1)] = lost
    return graph, entries


def search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int, own: np.ndarray | None = None) -> np.ndarray:
    """Ids of the ``width`` nearest found for each query, -1 where there are fewer. own: the query's place in the shard, where it is a member, else -1."""
    out = np.full((len(q), width), -1, dtype=np.int64)
    for s in range(0, len(q), _BLOCK):
        part = q[s : s + _BLOCK]
        start = np.broadcast_to(entries, (len(part), len(entries)))
        if own is not None:
            mine = own[s : s + _BLOCK]
            start = np.concatenate([np.where(mine >= 0, mine, entries[0])[:, None], start], axis=1)
        keys, _ = beam_search(x, graph, part, start, max(width, 1))
        out[s : s + _BLOCK] = np.where(keys == _FAR, -1, _ids(keys))
    return out
