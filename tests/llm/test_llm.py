"""The training-data operators against SQL, brute force and their defined cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provq.llm import clusters, components, neighbors, packing, queries, spans, tokens, topn, vamana
from provq.runtime import Workspace

DATA = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, same_rows, name):
    same_rows(queries.queries()[name](spark, DATA), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


# groups

LINKS = "source bigint, target bigint, relationshipConfidenceScore double, record string, group_id string, root int"


def brute_groups(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b, s in links:
        for x in (a, b):
            if x is not None:
                find(x)
        if None not in (a, b, s) and s >= 0.5:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def run_groups(spark, links):
    rows = components.groups(spark.createDataFrame([(*x, "x", "y", 1) for x in links], LINKS)).collect()
    assert len(rows) == len({r["record"] for r in rows})
    return {r["record"]: r["group_id"] for r in rows}


def test_groups_cases(spark):
    nan, inf = float("nan"), float("inf")
    links = [(1, 2, 0.5), (2, 1, 0.9), (3, 3, 0.9), (4, None, 0.9), (None, 5, 0.9), (None, None, 0.9), (6, 7, 0.49), (8, 9, None), (10, 11, nan), (12, 13, inf), (14, 15, -1.0)]
    assert run_groups(spark, links) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, 13: 12, 14: 14, 15: 15}
    assert run_groups(spark, []) == {}


def test_groups_shapes(spark):
    """A long chain in random order, a ring, a star, a clique, a tree and single pairs at once."""
    r = random.Random(3)
    names = list(range(1000))
    r.shuffle(names)
    take = iter(names)
    part = lambda n: [next(take) for _ in range(n)]
    chain, ring, star, clique, tree = part(200), part(90), part(120), part(14), part(80)
    links = list(zip(chain, chain[1:])) + list(zip(ring, ring[1:] + ring[:1])) + [(star[0], x) for x in star[1:]]
    links += [(a, b) for a in clique for b in clique if a < b] + [(tree[r.randrange(i)], tree[i]) for i in range(1, 80)]
    links = [(a, b, 0.8) for a, b in links]
    r.shuffle(links)
    assert run_groups(spark, links) == brute_groups(links)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_random(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(150), r.randrange(150), r.random()) for _ in range(170 * seed)]
    assert run_groups(spark, links) == brute_groups(links)


# vectors


def unit_rows(n, dim, seed, groups=0, noise=0.1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    if groups:
        x = r.normal(size=(groups, dim))[np.arange(n) % groups] / math.sqrt(dim) + noise * x / math.sqrt(dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


VEC = "feature_id bigint, features array<float>, ingested_at timestamp, id string, other int, cosine string"


def vec_rows(x, ids=None):
    return [(int(i), v.tolist(), None, "x", 1, "y") for i, v in zip(ids if ids is not None else range(len(x)), x)]


def brute_nearest(x, k):
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 12)  # equal vectors have equal cosines
    np.fill_diagonal(s, -9)
    return [[int(j) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]] for i in range(len(x))]


def test_graph_recall():
    x = unit_rows(3000, 32, 4, groups=300, noise=0.6).astype(np.float32)
    graph, entries = vamana.build(x, 24, 36, 48, 1.2)
    found = vamana.search(x, graph, entries, x, 40, np.arange(len(x)))
    want = brute_nearest(x, 5)
    assert np.mean([np.isin(w, f).mean() for w, f in zip(want, found)]) > 0.97
    assert vamana.build(x[:1], 24, 36, 48)[0].shape == (1, 36) and len(vamana.build(x[:2], 24, 36, 48)[0]) == 2


def test_nearest_recall_over_shards(spark):
    x = unit_rows(2500, 64, 5, groups=250, noise=0.5)
    got = neighbors.nearest(spark.createDataFrame(vec_rows(x), VEC), shard_rows=400, k=5).collect()
    found = {}
    for r in got:
        found.setdefault(r["id"], {})[r["rank"]] = r["other"]
    want = brute_nearest(x, 5)
    assert np.mean([np.isin(w, list(found[i].values())).mean() for i, w in enumerate(want)]) > 0.9
    assert all(sorted(f) == [1, 2, 3, 4, 5] for f in found.values())
    asked = neighbors.nearest(spark.createDataFrame(vec_rows(x), VEC), shard_rows=400, k=5, queries=F.col("id") % 100 == 0, probes=0, width=64).collect()
    assert {r["id"] for r in asked} == set(range(0, 2500, 100))
    hit = Counter(r["id"] for r in asked if r["other"] in want[r["id"]])
    assert sum(hit.values()) / (25 * 5) >= 0.95


def test_nearest_cases(spark):
    x = unit_rows(12, 64, 6)
    rows = vec_rows(x)
    bad = [None, [], [0.0] * 64, [1.0] * 63, [1.0] * 65, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows += [(100 + i, v, None, "x", 1, "y") for i, v in enumerate(bad)] + [(None, x[0].tolist(), None, "x", 1, "y")]
    rows += vec_rows(x[:3])  # delivered again
    rows += [(50, (3e30 * x[0]).tolist(), None, "x", 1, "y")]
    got = neighbors.nearest(spark.createDataFrame(rows, VEC), k=3).collect()
    assert {r["id"] for r in got} == {*range(12), 50}
    assert [(r["other"], round(r["cosine"], 6)) for r in got if r["id"] == 50 and r["rank"] == 1] == [(0, 1.0)]
    assert all(r["id"] != r["other"] for r in got)
    assert neighbors.nearest(spark.createDataFrame(rows[:1], VEC)).count() == 0
    assert neighbors.nearest(spark.createDataFrame([], VEC)).count() == 0


def test_nearest_of_copies(spark):
    """A third of all rows are one vector; the copies answer one another by the smallest keys, and others find them in that order."""
    x = unit_rows(60, 64, 7)
    x = np.concatenate([x, np.repeat(x[:1] , 30, axis=0)])
    order = np.random.default_rng(1).permutation(len(x))
    got = neighbors.nearest(spark.createDataFrame([vec_rows(x)[i] for i in order], VEC), k=5).collect()
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["id"], []).append(r["other"])
    assert mine == dict(enumerate(brute_nearest(x, 5)))


def test_one_key_with_two_vectors(spark):
    x = unit_rows(6, 64, 8)
    rows = [(i, v.tolist(), f"2022-01-0{2 + i}", "x", 1, "y") for i, v in enumerate(x)] + [(0, x[5].tolist(), "2022-01-09", "x", 1, "y")]
    df = spark.createDataFrame(rows, VEC.replace("timestamp", "string")).withColumn("ingested_at", F.to_timestamp("ingested_at"))
    got = {(r["id"], r["other"]): r["cosine"] for r in neighbors.nearest(df, k=5).collect()}
    assert abs(got[0, 5] - float(x[0].astype("f4") @ x[5].astype("f4"))) < 1e-5


# clusters


def run_clusters(spark, files, **kw):
    rows = clusters.similarity_clusters(spark.createDataFrame([(n, [float(a) for a in v] if v is not None else None, 1, "c") for n, v in files], "file string, vec array<double>, n int, cluster string"), **kw).collect()
    assert len(rows) == len({r["record"] for r in rows})
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], set()).add(r["record"])
    assert all(r["n"] == len(out[r["cluster"]]) for r in rows)
    return {frozenset(v) for v in out.values()}


def test_clusters_are_cliques(spark):
    r = np.random.default_rng(9)
    base = unit_rows(8, 64, 9)
    files = [(f"g{g}-{i}", base[g] + 0.02 * r.normal(size=64)) for g, n in enumerate((60, 25, 9, 4, 3, 2, 1, 1)) for i in range(n)]
    r.shuffle(files)
    want = {frozenset(n for n, _ in files if n.startswith(f"g{g}-")) for g in range(8)}
    assert run_clusters(spark, files) == want
    assert run_clusters(spark, files, task_clusters=10, k=4) == want  # parts larger than a task


def test_clusters_cases(spark):
    x = unit_rows(3, 64, 10)
    files = [("a", x[0]), ("b", 5 * x[0]), ("c", x[1]), (None, x[0]), ("z", None), ("y", np.zeros(64)), ("c", x[1]), ("", x[2])]
    assert run_clusters(spark, files) == {frozenset("ab"), frozenset("c"), frozenset({""})}
    assert run_clusters(spark, []) == set()
    assert run_clusters(spark, [("a", x[0])]) == {frozenset("a")}


def test_average_linkage_stops_below_threshold():
    """Two pairs whose mean cosine is below the threshold stay apart although one link between them is above it."""
    a = np.array([[1.0, 0], [math.cos(0.4), math.sin(0.4)], [math.cos(0.8), math.sin(0.8)], [math.cos(1.2), math.sin(1.2)]])
    n = np.ones(4, np.int64)
    root = clusters.merge_rounds(n, a.copy(), np.array([0, 1, 2]), np.array([1, 2, 3]), 0.9)
    assert root.tolist() == [0, 0, 2, 2]


def test_file_vectors(spark):
    x = unit_rows(6, 64, 11)
    rows = [(i, "f" if i < 4 else ("g" if i == 4 else None), (i + 1) * v, i) for i, v in enumerate(x)] + [(0, "f", x[0], 9), (None, "f", x[5], 1)]
    df = spark.createDataFrame([(i, f, [float(a) for a in v], t) for i, f, v, t in rows], "feature_id bigint, file string, features array<float>, ingested_at int")
    got = {r["file"]: r for r in clusters.file_vectors(df.repartition(3)).collect()}
    m = x[:4].mean(0)
    assert set(got) == {"f", "g"} and got["f"]["n_vectors"] == 4 and np.allclose(got["f"]["vec"], m / np.linalg.norm(m), atol=1e-6)


# top n


def test_top_n(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("p", "a", 1.0), ("p", "a", 2.0), ("p", "b", 2.0), ("p", "c", nan), ("p", "d", inf), ("p", "e", None), ("p", None, 9.0), ("p", "\U0001f600", -0.0), ("p", "￿", 0.0), (None, "x", 1.0), ("q", "", -inf), ("q", "", -3.0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "probe_id string, fileid string, nodeConfidenceScore double, rank int, best int")
    got = [(r["group_key"], r["item_key"], r["rank"]) for r in topn.top_n(df, n=3).collect()]
    assert set(got) == {("p", "a", 1), ("p", "b", 2), ("p", "￿", 3), (None, "x", 1), ("q", "", 1)}
    assert topn.top_n(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, n=0)


def test_top_n_plan_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("p", "a", 1.0)], "probe_id string, fileid string, nodeConfidenceScore double")
    assert topn.top_n(df)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


# tokens


def texts():
    r = random.Random(1)
    long = " ".join("".join(r.choice("abcdeäß日本 \n\t") for _ in range(r.randrange(1, 12))) for _ in range(40_000))
    return [None, "", " ", "\n \n", "a", "It's 12 o'clock!", "<|endoftext|>", "日本語😀", "x" * 250_000, " " * 150_000 + "y", long, "a　b\x1cc\x85d"]


def test_token_ids(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, ids int, key string")
    got = {r["key"]: r["ids"] for r in tokens.token_ids(df).collect()}
    enc = tokens.encoding(tokens.rank_file())
    for i, t in rows:
        assert got[i] == (enc.encode_ordinary(t) if t else [])
        assert tokens.decode(got[i], tokens.rank_file()).decode() == (t or "")
    counts = {r["key"]: r["tokens"] for r in tokens.token_counts(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokens.rank_file().replace(".tiktoken", ".json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for s in (x for x in texts() if x and len(x) < 1000):
        assert t.encode(s, add_special_tokens=False).ids == tokens.encode(s, tokens.rank_file())


def test_cuts_are_safe():
    s = "one two  three\nfour's 55 　 six " * 50
    enc = tokens.encoding(tokens.rank_file())
    parts = list(tokens.cut_long(s, 40))
    assert "".join(parts) == s and len(parts) > 10
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(s)


# packing


def check_packed(spark, sizes, capacity, **kw):
    df = spark.createDataFrame([(i, s, 1, "x") for i, s in enumerate(sizes)], "doc_id bigint, tokens bigint, piece int, container string")
    rows = packing.pack(df, capacity=capacity, **kw).collect()
    whole, used = Counter(), {}
    for r in rows:
        whole[r["key"]] += r["length"]
        used.setdefault(r["container"], []).append((r["start"], r["length"]))
        assert sizes[r["key"]] > capacity or r["piece"] == 0
    assert whole == Counter({i: s for i, s in enumerate(sizes) if s and s > 0})
    for parts in used.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= capacity
    assert sorted(used) == list(range(len(used)))
    return len(used)


def test_pack(spark, monkeypatch):
    r = random.Random(2)
    sizes = [min(900, int(r.lognormvariate(3.5, 1))) for _ in range(800)] + [None, 0, -3, 100, 200, 201, 1000] + [7] * 300
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 90)
    n = check_packed(spark, sizes, 100)
    assert n <= math.ceil(sum(s for s in sizes if s and s > 0) / 100) + 2
    assert check_packed(spark, [], 100) == 0
    assert check_packed(spark, [60, 60, 60], 100) == 3


@pytest.mark.parametrize("seed", range(20))
def test_filling_is_the_best(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 30): r.randrange(1, 5) for _ in range(5)}
    room = r.randrange(0, 80)
    reach = {0}
    for length, c in counts.items():
        reach = {a + length * k for a in reach for k in range(c + 1) if a + length * k <= room}
    got = packing.best_filling(counts, room)
    assert sum(k * v for k, v in got.items()) == max(reach) and all(v <= counts[k] for k, v in got.items())


# spans


def brute_spans(texts, span):
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - span + 1):
            seen.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in texts.items():
        cover = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                cover[i : i + span] = [True] * span
        if any(cover):
            out[d] = sum(cover)
    return out


def run_spans(spark, rows, **kw):
    got = spans.shared_spans(spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, doc int, shared_chars int"), **kw).collect()
    assert len(got) == len({r["doc"] for r in got})
    return {r["doc"]: r["shared_chars"] for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_spans_random(spark, seed):
    """Texts patched together from common passages of all lengths around the limit, with odd letters and repeats within one text."""
    r = random.Random(seed)
    letters = "ab \n😀ж" if seed % 2 else "abcdefghij \n"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    common = [make(r.randrange(20, 90)) for _ in range(6)]
    texts = {}
    for d in range(40):
        parts = []
        for _ in range(r.randrange(1, 5)):
            c = r.choice(common)
            parts += [make(r.randrange(0, 40)), c[r.randrange(0, 15) : len(c) - r.randrange(0, 15)]]
        texts[d] = "".join(parts)
    texts[90] = common[0] * 3
    assert run_spans(spark, list(texts.items()), span=30) == brute_spans(texts, 30)


def test_spans_periodic_and_copies(spark):
    texts = {i: "x" * 100 + f"{i}" for i in range(5)} | {10 + i: "The same page, word by word, " * 6 for i in range(30)} | {50: "x" * 29, 51: "", 52: "y" * 500}
    assert run_spans(spark, list(texts.items()), span=30) == brute_spans(texts, 30)


def test_spans_cases(spark):
    r = random.Random(4)
    page = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(1, page), (1, page), (2, None), (None, page), (3, page[:149]), (4, ""), (5, page[100:260] + "!"), (6, page[:100])]
    assert run_spans(spark, rows) == {1: 160, 5: 160}
    assert run_spans(spark, []) == {}
    # of several texts of one key the longest counts
    assert run_spans(spark, [(1, page), (1, page + "z"), (2, page[:200])]) == {1: 200, 2: 200}


def test_spans_across_slices(spark, monkeypatch):
    monkeypatch.setattr(spans, "SLICE", 70)
    r = random.Random(6)
    make = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    passage = make(300)
    texts = {1: make(130) + passage + make(50), 2: passage[40:220], 3: make(400)}
    s = Workspace(spark, "slices")
    at = {}
    for d, t in texts.items():
        for offset, p in spans._slices(t, 30):
            a, _ = spans.anchors(p, np.array([len(p)]), 30, 15)
            at.setdefault(d, set()).update((a + offset).tolist())
        whole, _ = spans.anchors(spans._points(t), np.array([len(t)]), 30, 15)
        assert set(whole.tolist()) == at[d]
    assert s.root


def test_index_takes_batches_one_after_the_other(spark):
    r = random.Random(7)
    make = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    common = make(80)
    texts = {d: make(60) + (common[d % 20 :] if d % 3 else "") + make(30) for d in range(40)}
    ws = Workspace(spark, "index")
    index = spans.SpanIndex(ws, 30, 4, fanout=2)
    df = spark.createDataFrame(list(texts.items()), "doc bigint, text string")
    for k in range(5):
        index.add(df.filter(f"doc % 5 = {k}"))
        assert len({level for level, _ in index.runs}) == len(index.runs)  # never two runs of a level after compaction
    found = {}
    for x in index.verified(df).collect():
        found.setdefault(x["doc"], set()).update(range(x["first"], x["last"]))
    index.close()
    assert {d: len(v) for d, v in found.items()} == brute_spans(texts, 30)
