"""The relations that the queries start from, over the tables of TESTDATA.md, in DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provq.functions import vectors as V
from provq.operators import graph, search
from provq.runtime import Workspace, is_finite, table

#: Hits of a query feature.
K = 20


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, image_id, v, x, y, size, angle): usable features with a whole key point, each id once, vectors of length 1."""
    return _shaped(_usable(spark, sf_dir))


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, image_id, f, p): the usable rows with their numbers as delivered, half as wide as doubles."""
    q = table(spark, sf_dir, "query_index")
    point = F.col("keypointMetadata").cast("array<double>")
    ok = F.col("feature_id").isNotNull() & F.col("image_id").isNotNull() & V.is_vector(F.col("features"), 64) & F.coalesce((F.size(point) == 4) & V.all_finite(point) & (F.element_at(point, 3) > 0), F.lit(False))
    best = q.filter(ok).groupBy("feature_id").agg(F.min(F.struct("ingested_at", "image_id", F.col("features").alias("f"), F.col("keypointMetadata").alias("p"))).alias("r"))
    return best.select("feature_id", "r.image_id", "r.f", "r.p")


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("feature_id", "image_id", V.unit(F.col("f").cast("array<double>")).alias("v"), *(F.col("p")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "size", "angle"))))


def queries_of(feat: DataFrame) -> DataFrame:
    """The query set: features of images whose id is divisible by 100."""
    return feat.filter(F.col("image_id") % 100 == 0)


def hits(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(probe_id, q_feature, feature_id, image_id, dist, rank): the k nearest features of each query feature, itself included."""
    return _hits(stored_features(spark, sf_dir), k)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features``, written once for the several steps that read them."""
    return _shaped(Workspace(spark, "features").save(_usable(spark, sf_dir), "features"))


def _hits(feat: DataFrame, k: int) -> DataFrame:
    q = queries_of(feat)
    top = search.exact_knn(q.select(F.col("feature_id").alias("q"), "v"), feat.select("feature_id", "v"), k)
    return top.withColumnRenamed("q", "q_feature").join(feat.select("feature_id", "image_id"), "feature_id").join(q.select(F.col("feature_id").alias("q_feature"), F.col("image_id").alias("probe_id")), "q_feature")


def placed_hits(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Hits with the key points of both sides and the size of the image; images without a size don't count."""
    feat = stored_features(spark, sf_dir)
    own = feat.select(F.col("feature_id").alias("q_feature"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("size").alias("q_size"), F.col("angle").alias("q_angle"))
    sizes = table(spark, sf_dir, "images").filter("width > 0 and height > 0").select("image_id", "width", "height")
    return _hits(feat, k).join(own, "q_feature").join(feat.select("feature_id", "x", "y", "size", "angle"), "feature_id").join(sizes, "image_id")


def paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (probe_id, image_id) of each probe with the other images that it hits, the probes' features (probe_id, q_feature, v), all features."""
    feat = stored_features(spark, sf_dir)
    pairs = _hits(feat, K).filter("probe_id <> image_id").select("probe_id", "image_id").distinct()
    return pairs, queries_of(feat).select(F.col("image_id").alias("probe_id"), F.col("feature_id").alias("q_feature"), "v"), feat


def pair_nearest(spark: SparkSession, sf_dir: str, n: int, only_mutual: bool = False) -> DataFrame:
    """(probe_id, image_id, q_feature, feature_id, dist, mutual, nth): each probe feature's n nearest in each other image that the probe hits."""
    return search.pair_nearest(*paired(spark, sf_dir), n, only_mutual=only_mutual)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "result_nodes").filter(F.col("probe_id").isNotNull())


def ranked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probe_id, file, rank): delivered files by name, highest score first, ties by name; ``world/`` is left out."""
    r = results(spark, sf_dir).filter(F.col("file").isNotNull() & is_finite(F.col("nodeConfidenceScore")))
    best = r.groupBy("probe_id", F.regexp_replace("file", "^world/", "").alias("file")).agg(F.max("nodeConfidenceScore").alias("score"))
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.partitionBy("probe_id").orderBy(F.col("score").desc(), "file"))).drop("score")


def truth(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """(probe_id, file): the files of the journal that a probe belongs to, the first journal that has its best-ranked file.

    among: the files (journal_id, file) that are asked for, where not all.
    """
    nodes = table(spark, sf_dir, "gt_journal_nodes").filter("file is not null").select("journal_id", "file").distinct()
    first = ranked_files(spark, sf_dir).join(nodes, "file").groupBy("probe_id").agg(F.min(F.struct("rank", "journal_id"))["journal_id"].alias("journal_id"))
    return first.join(nodes if among is None else among, "journal_id").select("probe_id", "file")


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, node): the nodes of journals that have a donor link at or below them."""
    _, k = journal(spark, sf_dir)
    starts = k.filter(F.lower(F.trim("op")) == "donor").select(F.lit("up").alias("kind"), "tree", F.col("parent").alias("node"))
    up = k.select(F.lit("up").alias("kind"), "tree", F.col("child").alias("a"), F.col("parent").alias("b"))
    return graph.directed_levels(up, starts).select("tree", "node")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.affinity(table(spark, sf_dir, "graph_links"), "source", "target", "relationshipConfidenceScore")


def journal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, node) and links (tree, parent, child) between nodes of one journal."""
    n = table(spark, sf_dir, "gt_journal_nodes").select(F.col("journal_id").alias("tree"), F.col("idx").alias("node")).dropna().distinct()
    k = table(spark, sf_dir, "gt_journal").select(F.col("journal_id").alias("tree"), F.col("source").alias("parent"), F.col("target").alias("child"), "op").dropna(subset=["tree", "parent", "child"])
    for c in ("parent", "child"):
        k = k.join(n.withColumnRenamed("node", c), ["tree", c], "left_semi")
    return n, k


SQL_FEATURES = """
    rated AS (
      SELECT feature_id, image_id, CAST(features AS DOUBLE[]) AS f, CAST(keypointMetadata AS DOUBLE[]) AS p, row_number() OVER (PARTITION BY feature_id ORDER BY ingested_at) AS rn
      FROM query_index WHERE feature_id IS NOT NULL AND image_id IS NOT NULL
        AND len(features) = 64 AND len(list_filter(features, lambda q: isfinite(q))) = 64 AND len(list_filter(features, lambda q: q <> 0)) > 0
        AND len(keypointMetadata) = 4 AND len(list_filter(keypointMetadata, lambda q: isfinite(q))) = 4 AND keypointMetadata[3] > 0),
    feat AS (SELECT feature_id, image_id, list_transform(f, lambda q: q / sqrt(list_dot_product(f, f))) AS v, p[1] AS x, p[2] AS y, p[3] AS size, p[4] AS angle FROM rated WHERE rn = 1)"""


def sql_hits(k: int = K) -> str:
    return SQL_FEATURES + f""",
    apart AS (SELECT q.image_id AS probe_id, q.feature_id AS q_feature, b.feature_id, b.image_id, greatest(0.0, round(2 - 2 * list_dot_product(q.v, b.v), 9)) + 0.0 AS dist
              FROM feat q, feat b WHERE q.image_id % 100 = 0),
    hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_feature ORDER BY dist, feature_id) AS rank FROM apart) WHERE rank <= {k})"""


def sql_placed(k: int = K) -> str:
    return sql_hits(k) + """,
    placed AS (SELECT h.*, q.x AS qx, q.y AS qy, q.size AS q_size, q.angle AS q_angle, b.x, b.y, b.size, b.angle, i.width, i.height
               FROM hit h JOIN feat q ON q.feature_id = h.q_feature JOIN feat b ON b.feature_id = h.feature_id JOIN images i ON i.image_id = h.image_id WHERE i.width > 0 AND i.height > 0)"""


SQL_PAIRS = sql_hits() + """,
    pairs AS (SELECT DISTINCT probe_id, image_id FROM hit WHERE probe_id <> image_id),
    d AS (SELECT p.probe_id, p.image_id, a.q_feature, a.feature_id, a.dist FROM pairs p JOIN apart a ON a.probe_id = p.probe_id AND a.image_id = p.image_id)"""

SQL_BINS = sql_placed() + """,
    w AS (SELECT *, 1 / (1 + sqrt(dist)) AS w FROM placed),
    c AS (SELECT *, sum(qx * w) OVER (PARTITION BY probe_id, image_id) / sum(w) OVER (PARTITION BY probe_id, image_id) AS cx,
                    sum(qy * w) OVER (PARTITION BY probe_id, image_id) / sum(w) OVER (PARTITION BY probe_id, image_id) AS cy FROM w),
    t AS (SELECT *, radians(angle - q_angle) AS turn, (cx - qx) * (size / q_size) AS ax, (cy - qy) * (size / q_size) AS ay,
                 least(greatest(trunc(power(greatest(width, height) / 4.0, 0.8)), 5), 250) AS b, least(greatest(trunc(power(greatest(width, height) / 6.0, 0.9)), 5), 250) AS near FROM c),
    v AS (SELECT *, round(x + ax * cos(turn) - ay * sin(turn), 9) AS vx, round(y + ax * sin(turn) + ay * cos(turn), 9) AS vy FROM t),
    g AS (SELECT v.*, grid, vx - b / 2 * sx AS gx, vy - b / 2 * sy AS gy FROM v, (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) s(grid, sx, sy)),
    bin AS (SELECT *, CAST(trunc(gx / b) AS BIGINT) - CASE WHEN gx < 0 THEN 1 ELSE 0 END AS xb, CAST(trunc(gy / b) AS BIGINT) - CASE WHEN gy < 0 THEN 1 ELSE 0 END AS yb FROM g),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id, grid, xb, yb, q_feature ORDER BY rank) AS n1 FROM bin) WHERE n1 = 1),
    vote AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id, grid, xb, yb, feature_id ORDER BY q_feature) AS n2 FROM once) WHERE n2 = 1),
    cnt AS (SELECT probe_id, image_id, grid, xb, yb, count(*) AS n FROM vote GROUP BY ALL)"""

SQL_FILES = """
    best AS (SELECT probe_id, regexp_replace(file, '^world/', '') AS file, max(nodeConfidenceScore) AS score FROM result_nodes
             WHERE probe_id IS NOT NULL AND file IS NOT NULL AND isfinite(nodeConfidenceScore) GROUP BY 1, 2),
    res AS (SELECT probe_id, file, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, file) AS rank FROM best),
    jf AS (SELECT DISTINCT journal_id, file FROM gt_journal_nodes WHERE file IS NOT NULL),
    home AS (SELECT probe_id, journal_id FROM (SELECT res.probe_id, jf.journal_id, row_number() OVER (PARTITION BY res.probe_id ORDER BY rank, jf.journal_id) AS n FROM res JOIN jf ON jf.file = res.file) WHERE n = 1),
    truth AS (SELECT DISTINCT home.probe_id, jf.file FROM home JOIN jf ON jf.journal_id = home.journal_id)"""

SQL_EDGES = """
    edge AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(relationshipConfidenceScore) AS weight FROM graph_links
             WHERE source <> target AND relationshipConfidenceScore > 0 AND NOT isnan(relationshipConfidenceScore) GROUP BY 1, 2),
    way AS (SELECT a, b, weight FROM edge UNION ALL SELECT b, a, weight FROM edge)"""

SQL_JOURNAL = """
    n AS (SELECT DISTINCT journal_id AS tree, idx AS node FROM gt_journal_nodes WHERE journal_id IS NOT NULL AND idx IS NOT NULL),
    k AS (SELECT l.journal_id AS tree, l.source AS parent, l.target AS child, l.op FROM gt_journal l
          JOIN n a ON a.tree = l.journal_id AND a.node = l.source JOIN n b ON b.tree = l.journal_id AND b.node = l.target)"""
