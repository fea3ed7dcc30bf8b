"""Queries of the training-data operators and, where SQL can say it, what they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provq.llm import clusters, components, neighbors, packing, spans, tokens, topn
from provq.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.groups(table(spark, sf_dir, "graph_links"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clusters.similarity_clusters(clusters.file_vectors(table(spark, sf_dir, "query_index"))).filter("n > 1")
    names = got.groupBy("cluster").agg(F.min("record").alias("cluster_file"))
    return got.join(names, "cluster").select(F.col("record").alias("file"), "cluster_file")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size and most typical files."""
    return clusters.describe(clusters.similarity_clusters(clusters.file_vectors(table(spark, sf_dir, "query_index"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's 5 nearest, of which the pairs of a cosine of 0.99 or more are the cases."""
    got = neighbors.nearest(table(spark, sf_dir, "query_index"), k=5, min_similarity=0.99, within=0.99, recall=neighbors.ALL_OF_SAMPLE, width=24)
    return got.select(F.least("id", "other").alias("feature_a"), F.greatest("id", "other").alias("feature_b")).distinct()


def p4_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 100, with the key points of both sides."""
    rows = table(spark, sf_dir, "query_index")
    got = neighbors.nearest(rows, k=5, queries=F.col("id") % 100 == 0, recall=0.96, width=128)
    points = rows.filter("feature_id is not null").groupBy("feature_id").agg(F.min(F.struct("ingested_at", "keypointMetadata"))["keypointMetadata"].alias("points"))
    got = got.join(points.select(F.col("feature_id").alias("id"), F.col("points").alias("own_keypoint")), "id", "left")
    got = got.join(points.select(F.col("feature_id").alias("other"), F.col("points").alias("other_keypoint")), "other", "left")
    return got.select(F.col("id").alias("feature_id"), F.col("other").alias("neighbor_id"), "rank", "cosine", "own_keypoint", "other_keypoint")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = topn.top_n(table(spark, sf_dir, "result_nodes"))
    return got.select(F.col("group_key").alias("probe_id"), F.col("item_key").alias("fileid"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "ids")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "tokens")
    return packing.pack(sizes).select(F.col("key").alias("doc_id"), "piece", "container", "start", "length")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "shared_chars")


def queries() -> dict:
    return {"p1_found": p1_found, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p4_neighbors": p4_neighbors, "p5_found": p5_found, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found}


#: Usable vectors, scaled to length 1, each feature_id once.
_USABLE = """
    good AS (
      SELECT feature_id, arg_min(file, ingested_at) AS file, arg_min(CAST(features AS DOUBLE[]), ingested_at) AS f FROM query_index
      WHERE feature_id IS NOT NULL AND len(features) = 64 AND len(list_filter(features, lambda x: isfinite(x))) = 64 AND len(list_filter(features, lambda x: x <> 0)) > 0
      GROUP BY feature_id),
    usable AS (SELECT feature_id, file, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS v FROM good)"""


#: The mean vector of each file, scaled to length 1.
_FILES = """
    part AS (SELECT file, i, sum(v[i]) AS x FROM usable, range(1, 65) t(i) WHERE file IS NOT NULL GROUP BY file, i),
    mean AS (SELECT file, list(x ORDER BY i) AS m FROM part GROUP BY file),
    unit AS (SELECT file, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM mean)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH RECURSIVE pair AS (
              SELECT source AS a, target AS b FROM graph_links
              WHERE source IS NOT NULL AND target IS NOT NULL AND relationshipConfidenceScore >= 0.5 AND NOT isnan(relationshipConfidenceScore)),
            step AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair)),
            record AS (SELECT source AS record FROM graph_links WHERE source IS NOT NULL UNION SELECT target FROM graph_links WHERE target IS NOT NULL),
            reach AS (SELECT record, record AS other FROM record UNION SELECT reach.record, step.b FROM reach JOIN step ON step.a = reach.other)
            SELECT record, min(other) AS group_id FROM reach GROUP BY record""",
        "p3_found": f"""
            WITH {_USABLE}, {_FILES}
            SELECT a.file, least(a.file, min(b.file)) AS cluster_file FROM unit a JOIN unit b ON a.file <> b.file AND list_dot_product(a.v, b.v) >= 0.9 GROUP BY a.file""",
        "p3_clusters": f"""
            WITH {_USABLE}, {_FILES},
            pair AS (SELECT a.file, b.file AS other, list_dot_product(a.v, b.v) AS c FROM unit a JOIN unit b ON a.file <> b.file AND list_dot_product(a.v, b.v) >= 0.9),
            member AS (SELECT file, least(file, min(other)) AS cluster_file, count(*) + 1 AS n, avg(c) AS typicality FROM pair GROUP BY file),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_file ORDER BY round(typicality, 9) DESC, file) AS nth FROM member)
            SELECT cluster_file, max(n) AS n, list(file ORDER BY nth) AS typical FROM ranked WHERE nth <= 3 GROUP BY cluster_file""",
        "p4_found": f"""
            WITH {_USABLE},
            pair AS (
              SELECT a.feature_id AS id, b.feature_id AS other, list_dot_product(a.v, b.v) AS cosine
              FROM usable a JOIN usable b ON a.feature_id <> b.feature_id WHERE list_dot_product(a.v, b.v) >= 0.99),
            ranked AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rank FROM pair)
            SELECT DISTINCT least(id, other) AS feature_a, greatest(id, other) AS feature_b FROM ranked WHERE rank <= 5""",
        "p5_found": """
            SELECT probe_id, fileid FROM (
              SELECT probe_id, fileid, row_number() OVER (PARTITION BY probe_id ORDER BY best DESC, fileid) AS rn
              FROM (SELECT probe_id, fileid, max(nodeConfidenceScore) AS best FROM result_nodes
                    WHERE fileid IS NOT NULL AND isfinite(nodeConfidenceScore) GROUP BY probe_id, fileid))
            WHERE rn <= 10""",
        "p8_found": """
            WITH starts AS (
              SELECT doc_id, s, substring(text, s, 150) AS span
              FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS s FROM documents WHERE length(text) >= 150)),
            common AS (SELECT span FROM starts GROUP BY span HAVING min(doc_id) < max(doc_id)),
            hit AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM starts WHERE span IN (SELECT span FROM common))
            SELECT doc_id, CAST(sum(least(coalesce(nxt - s, 150), 150)) AS BIGINT) AS shared_chars FROM hit GROUP BY doc_id""",
    }
