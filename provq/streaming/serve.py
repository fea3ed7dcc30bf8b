"""Serving over streams: probes are answered as they arrive, features join the index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provq.operators import scoring, search


def answer_probes(probes: DataFrame, base: DataFrame, out: str, checkpoint: str, *, k: int = 20, centroids: list[list[float]] | None = None, nprobe: int = 24) -> StreamingQuery:
    """probes: a stream (probe_id, q, v); base(feature_id, image_id, v). Writes (batch, probe_id, image_id, score, n_votes) for each micro-batch.

    A micro-batch that is repeated after a failure overwrites its own folder, so each probe is answered once.
    """

    def one(batch: DataFrame, number: int) -> None:
        q = batch.select("q", "v")
        top = search.ivf_knn(q, base, centroids, k, nprobe) if centroids else search.exact_knn(q, base, k)
        hits = top.withColumnRenamed("q", "q_feature").join(base.select("feature_id", "image_id"), "feature_id").join(batch.select(F.col("q").alias("q_feature"), "probe_id"), "q_feature")
        scoring.tally(hits).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return probes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def add_features(rows: DataFrame, centroids: list[list[float]], index: str, checkpoint: str) -> StreamingQuery:
    """rows: a stream (feature_id, image_id, v). Appends them to an index partitioned by cell."""

    def one(batch: DataFrame, number: int) -> None:
        search.assign_cells(batch.select("feature_id", "image_id", "v"), centroids).drop("cell_rank").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cell").parquet(index)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def scores_over_time(results: DataFrame, *, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """results: a stream (probe_id, nodeConfidenceScore, run_at) -> counts and best score of each window of delivery time; later rows than ``late`` are dropped."""
    r = results.filter(F.col("nodeConfidenceScore").isNotNull() & ~F.isnan("nodeConfidenceScore")).withWatermark("run_at", late)
    return r.groupBy(F.window("run_at", window).alias("w")).agg(F.count("*").alias("n"), F.max("nodeConfidenceScore").alias("best")).select(F.col("w.start").alias("start"), "n", "best")


def feature_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
