import numpy as np

from provq.operators import scoring, search
from provq.streaming import serve


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    base = spark.createDataFrame([(i, i // 3, v.tolist()) for i, v in enumerate(x)], "feature_id bigint, image_id bigint, v array<double>")
    schema = "probe_id bigint, q bigint, v array<double>"
    probes = spark.createDataFrame([(i % 4, i, x[i].tolist()) for i in range(12)], schema)
    probes.write.parquet(str(tmp_path / "in"))
    q = serve.answer_probes(serve.feature_stream(spark, str(tmp_path / "in"), schema), base, str(tmp_path / "out"), str(tmp_path / "ck"), k=5)
    q.processAllAvailable()
    q.stop()
    hits = search.exact_knn(probes.select("q", "v"), base, 5).withColumnRenamed("q", "q_feature").join(base.select("feature_id", "image_id"), "feature_id").join(probes.selectExpr("q as q_feature", "probe_id"), "q_feature")
    key = lambda df: sorted((r["probe_id"], r["image_id"], r["n_votes"], round(r["score"], 9)) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(scoring.tally(hits))
    feed = "feature_id bigint, image_id bigint, v array<double>"
    base.write.parquet(str(tmp_path / "f"))
    q = serve.add_features(serve.feature_stream(spark, str(tmp_path / "f"), feed), x[:4].tolist(), str(tmp_path / "index"), str(tmp_path / "ck2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 60


def test_windows(spark, tmp_path):
    r = spark.sql("SELECT 'p' AS probe_id, CAST(id AS DOUBLE) AS nodeConfidenceScore, TIMESTAMP '2022-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS run_at FROM range(60)")
    r.write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema(r.schema).parquet(str(tmp_path / "r"))
    q = serve.scores_over_time(s).writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["n"], r["best"]) for r in spark.table("win").collect()} == {(10, 10.0 * k + 9) for k in range(6)}
