"""Fingerprints of spans cross the cluster once, and what one task can settle by itself leaves it as ranges."""

import random

import numpy as np
import pytest

from provq.llm import spans


def shuffled(spark):
    """Rows written to shuffles, by stage."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}


def test_one_shuffle_of_span_fingerprints(spark):
    """Most rows are the spans of pairs of records with a passage; they must not be shuffled for counting and again for joining (as large tables are joined: no broadcast)."""
    r = random.Random(3)
    make = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    rows = []
    for pair in range(60):
        common = make(200)
        rows += [(2 * pair + k, make(100) + common + make(100)) for k in range(2)]
    before, threshold = max(shuffled(spark), default=-1), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        got = {x["doc"]: x["shared_chars"] for x in spans.shared_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    finally:
        spark.conf.unset(threshold)
    moved = [v for k, v in shuffled(spark).items() if k > before]
    assert set(got) == {d for d, _ in rows} and all(200 <= v <= 204 for v in got.values())
    assert sum(moved) <= 1.8 * max(moved)


def test_a_passage_of_all_records_leaves_a_task_as_ranges():
    many, span = 500, 10
    doc = np.repeat(np.arange(many, dtype=np.int64) * 7 - 100, 30)
    at = np.tile(np.arange(30, dtype=np.int64) + 5, many)
    a = np.tile(np.arange(30, dtype=np.uint64) * np.uint64(2) + np.uint64(1), many)
    got = spans._settled(doc, a, a, at, np.zeros(len(a), bool), span).to_pylist()
    assert sum(x["b"] is not None for x in got) == 30 and all(x["last"] == 0 for x in got if x["b"] is not None)
    assert sorted((x["doc"], x["first"], x["last"]) for x in got if x["b"] is None) == [(d * 7 - 100, 5, 5 + 29 + span) for d in range(many)]


@pytest.mark.parametrize("seed", range(20))
def test_batches_settle_as_one(seed):
    """Rows cut into batches anywhere, met as the shuffle does, cover what two records hold or is known, whatever is known already."""
    r = np.random.default_rng(seed)
    n, span, apart = 300, 4, 6
    doc, a, b = (r.integers(0, k, n) for k in (8, 40, 3))
    at, known = np.arange(n) * (1 if seed % 2 else apart), r.random(n) < (0.05 if seed % 3 else 0)
    holders, sure = {}, set()
    for i in range(n):
        holders.setdefault((a[i], b[i]), set()).add(doc[i])
        if known[i]:
            sure.add((a[i], b[i]))
    want = {(doc[i], p) for i in range(n) if not known[i] and (len(holders[a[i], b[i]]) > 1 or (a[i], b[i]) in sure) for p in range(at[i], at[i] + span)}
    rows = []
    for part in np.split(np.arange(n), np.sort(r.choice(np.arange(1, n), 5, replace=False))):
        rows += spans._settled(doc[part], a[part].astype(np.uint64), b[part].astype(np.uint64), at[part], known[part], span).to_pylist()
    met = {}
    for x in rows:
        met.setdefault((x["a"], x["b"]), []).append(x)
    got = set()
    for x in rows:
        here = met[x["a"], x["b"]]
        if x["b"] is None:
            got |= {(x["doc"], p) for p in range(x["first"], x["last"])}
        elif x["last"] is None and (len({y["doc"] for y in here}) > 1 or any(y["last"] is not None for y in here)):
            got |= {(x["doc"], p) for p in range(x["first"], x["first"] + span)}
    assert got == want
