"""The trained index: kept and opened, appended and merged, codes against brute force, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provq.operators import index, search
from provq.plans import catalog
from provq.plans import inputs as I
from tests_data import DATA


@pytest.fixture(scope="module")
def base(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 32)) * np.linspace(2, 0.2, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "feature_id bigint, v array<double>").cache()


def test_kept_parameters_come_back(spark, base, tmp_path):
    trained = index.train(base[1], 6, parts=4, words=16, dims=16)
    index.save(spark, trained, str(tmp_path / "i"))
    back = index.load_or_train(spark, str(tmp_path / "i"), base[1].limit(0), 99)
    for a, b in ((trained.rotation, back.rotation), (trained.centroids, back.centroids), (trained.books, back.books)):
        assert np.array_equal(a, b)
    assert np.allclose(trained.rotation.T @ trained.rotation, np.eye(16))


def test_code_distances_are_those_of_the_code_words(spark, base):
    x, df = base
    trained = index.train(df, 6, parts=4, words=16)
    coded = index.encode(trained, df)
    got = index.search(trained, df.filter("feature_id < 20").withColumnRenamed("feature_id", "q"), coded, 5, nprobe=6).collect()
    y = x @ trained.rotation
    cell = trained.cells_of(y)[:, 0]
    codes = trained.codes_of(y - trained.centroids[cell])
    decoded = trained.centroids[cell] + np.concatenate([trained.books[p][codes[:, p]] for p in range(4)], axis=1)
    for r in got:
        assert abs(r["dist"] - ((y[r["q"]] - decoded[r["feature_id"]]) ** 2).sum()) < 1e-6
    for q in range(20):
        d = np.sort(((y[q] - decoded) ** 2).sum(1))[:5]
        assert np.allclose(sorted(r["dist"] for r in got if r["q"] == q), d, atol=1e-6)


def test_appended_and_merged_shards_hold_every_row(spark, base, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CODE_BLOCK", 50)  # cells are cut
    monkeypatch.setattr(index, "QUERY_BLOCK", 30)
    x, df = base
    whole = index.train(df, 5, parts=None)
    for n, path in ((0, "a"), (1, "b"), (2, "b")):
        index.append(index.encode(whole, df.filter(F.col("feature_id") % 3 == n)), str(tmp_path / path))
    index.merge(spark, [str(tmp_path / p) for p in "ab"], str(tmp_path / "m"))
    merged = spark.read.parquet(str(tmp_path / "m"))
    assert merged.count() == len(x)
    got = {(r["q"], r["rank"]): r["feature_id"] for r in index.search(whole, df.limit(100).withColumnRenamed("feature_id", "q"), merged, 3, nprobe=5).collect()}
    want = np.argsort(np.round(2 - 2 * x[:100] @ x.T, 9), axis=1, kind="stable")[:, :3]
    assert all(got[q, k + 1] == want[q, k] for q in range(100) for k in range(3))


def test_cells_of_all_probes_give_the_exact_answer(spark, base, monkeypatch):
    monkeypatch.setattr(search, "BASE_BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    _, df = base
    q = df.limit(60).withColumnRenamed("feature_id", "q")
    cells = search.train_cells(df, 4)
    key = lambda t: {(r["q"], r["rank"], r["feature_id"]) for r in t.collect()}
    assert key(search.ivf_knn(q, df, cells, 4, nprobe=4)) == key(search.exact_knn(q, df, 4))


def test_trained_search_finds_nine_of_ten(spark):
    got = {(r["q_feature"], r["feature_id"]) for r in catalog.queries()["ivf_pq_search"](spark, DATA).collect()}
    feat = I.features(spark, DATA)
    exact = search.exact_knn(I.queries_of(feat).select(F.col("feature_id").alias("q"), "v"), feat.select("feature_id", "v"), 10).collect()
    assert len({(r["q"], r["feature_id"]) for r in exact} & got) >= 0.9 * len(exact)


def test_every_feature_is_in_a_cell(spark):
    n = catalog.queries()["index_train"](spark, DATA).agg(F.sum("n")).first()[0]
    assert n == I.features(spark, DATA).count()


def test_nothing_to_train_on(spark, base):
    with pytest.raises(ValueError):
        index.train(base[1].limit(0), 3)
