"""More queries of the core: listings and ranges, scorer, journals, statistics of pairs, index sweeps. Registered with ``catalog``'s."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from provq.functions import names
from provq.operators import evaluate, graph, index, matching, pairs, ranges, results, scoring, search
from provq.plans import inputs as I
from provq.plans.catalog import _CENTRES, _MAX, _SQL, _TREE, _centres, _placed, _query, _r, merge_max
from provq.runtime import Workspace, is_finite, table

# listings, numbers, ranges


@_query("SELECT name, row_number() OVER (ORDER BY name, image_id) - 1 AS idx FROM images WHERE name IS NOT NULL AND name NOT LIKE '.%' AND NOT regexp_matches(coalesce(path, ''), 'thumb/[^/]*$')")
def dataset_dictionary(spark: SparkSession, d: str):
    """Names and dense numbers of all listed images: no hidden files, no folders of thumbnails."""
    i = table(spark, d, "images").filter(F.col("name").isNotNull() & ~F.col("name").startswith(".") & ~F.coalesce(F.col("path"), F.lit("")).rlike("thumb/[^/]*$"))
    return ranges.numbered(i.select("name", "image_id"), "name", "image_id", name="idx").select("name", "idx")


@_query("SELECT r AS range_no, count(*) AS n, min(image_id) AS first, max(image_id) AS last FROM (SELECT image_id, CAST(floor((row_number() OVER (ORDER BY image_id) - 1) / ceil((SELECT count(*) FROM images) / 7.0)) AS BIGINT) AS r FROM images) GROUP BY r")
def contiguous_ranges(spark, d):
    """All images in seven contiguous ranges."""
    i = table(spark, d, "images").select("image_id")
    r = ranges.numbered(i, "image_id").withColumn("range_no", ranges.range_of(F.col("row_no"), i.count(), 7))
    return r.groupBy("range_no").agg(F.count("*").alias("n"), F.min("image_id").alias("first"), F.max("image_id").alias("last"))


@_query("SELECT name, CAST(floor((row_number() OVER (ORDER BY name, image_id) - 1) / 64) AS BIGINT) AS batch FROM images WHERE lower(name) LIKE '%.png' OR lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg'")
def query_batches(spark, d):
    """Query images by extension in batches of 64."""
    i = table(spark, d, "images").filter(names.extension(F.col("name")).isin("png", "jpg", "jpeg")).select("name", "image_id")
    return ranges.numbered(i, "name", "image_id").select("name", ranges.batch_of(F.col("row_no"), 64).alias("batch"))


@_query("SELECT ProvenanceProbeFileID AS probe FROM (SELECT DISTINCT ProvenanceProbeFileID FROM result_manifest WHERE ProvenanceProbeFileID IS NOT NULL) ORDER BY 1 OFFSET 5")
def probes_after(spark, d):
    """The probe list without its first five."""
    p = table(spark, d, "result_manifest").select(F.col("ProvenanceProbeFileID").alias("probe")).dropna().distinct()
    return ranges.numbered(p, "probe").filter("row_no >= 5").select("probe")


@_query("SELECT shard, n_image_id, n_name, CAST(coalesce(sum(n_image_id) OVER w, 0) AS BIGINT) AS start_image_id, CAST(coalesce(sum(n_name) OVER w, 0) AS BIGINT) AS start_name FROM (SELECT shard, count(DISTINCT image_id) AS n_image_id, count(DISTINCT name) AS n_name FROM images WHERE shard IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def shard_offsets(spark, d):
    return ranges.shard_offsets(table(spark, d, "images").filter("shard is not null"), "shard", "image_id", "name")


@_query("SELECT file, n, CAST(sum(n) OVER (ORDER BY file) AS BIGINT) AS so_far FROM (SELECT file, count(*) AS n FROM query_index WHERE file IS NOT NULL GROUP BY 1)")
def file_feature_counts(spark, d):
    """Features of each file and the running total over all files."""
    n = table(spark, d, "query_index").filter("file is not null").groupBy("file").agg(F.count("*").alias("n"))
    return ranges.running_total(n, "n", "file")


@_query("SELECT files, total FROM (SELECT row_number() OVER (ORDER BY file) AS files, CAST(sum(n) OVER (ORDER BY file) AS BIGINT) AS total FROM (SELECT file, count(*) AS n FROM query_index WHERE file IS NOT NULL GROUP BY 1)) WHERE files % 100 = 0")
def build_progress(spark, d):
    """Features added after every hundredth file."""
    done = ranges.numbered(file_feature_counts(spark, d), "file")
    return done.filter((F.col("row_no") + 1) % 100 == 0).select((F.col("row_no") + 1).alias("files"), F.col("so_far").alias("total"))


@_query("SELECT DISTINCT regexp_replace(file, '^world/', '') AS name FROM query_index WHERE file IS NOT NULL AND regexp_replace(file, '^world/', '') NOT IN (SELECT name FROM images WHERE name IS NOT NULL)")
def listed_but_missing(spark, d):
    """Files that the feature list names and no image has."""
    listed = table(spark, d, "query_index").filter("file is not null").select(F.regexp_replace("file", "^world/", "").alias("name")).distinct()
    return listed.join(table(spark, d, "images").select("name").dropna().distinct(), "name", "left_anti")


@_query("SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT source AS node FROM graph_links WHERE source IS NOT NULL UNION SELECT target FROM graph_links WHERE target IS NOT NULL)")
def link_nodes(spark, d):
    """The distinct ends of all links with dense numbers."""
    k = table(spark, d, "graph_links")
    n = k.select(F.explode(F.array("source", "target")).alias("node")).filter("node is not null").distinct()
    return ranges.numbered(n, "node", name="idx")


@_query(f"WITH {I.SQL_FEATURES} SELECT feature_id, image_id, dense_rank() OVER (ORDER BY image_id) - 1 AS q_image FROM feat WHERE image_id % 100 = 0")
def query_image_numbers(spark, d):
    """Query features with the dense number of their image."""
    q = I.queries_of(I.features(spark, d)).select("feature_id", "image_id")
    return q.join(ranges.numbered(q.select("image_id").distinct(), "image_id", name="q_image"), "image_id")


@_query("SELECT level, count(*) AS n, count(*) FILTER (core) AS n_core FROM (SELECT l.level, d.core FROM (VALUES (0), (100), (1000)) l(level), (SELECT lang = 'en' AS core, row_number() OVER (PARTITION BY coalesce(lang = 'en', false) ORDER BY doc_id) AS r FROM documents) d WHERE coalesce(d.core, false) OR d.r <= l.level) GROUP BY level")
def diluted_sets(spark, d):
    """A core set united with growing numbers of distractors."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("core"))
    levels = (0, 100, 1000)
    near = docs.filter("not core").orderBy("doc_id").limit(max(levels))  # the first of the distractors, as the levels say
    rest = near.withColumn("r", F.row_number().over(Window.orderBy("doc_id")))  # as many rows as the largest level
    each = F.explode(F.array(*map(F.lit, levels))).alias("level")
    both = docs.filter("core").select("core", each).unionByName(rest.select("core", "r", each).filter("r <= level").drop("r"))
    return both.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("core").cast("bigint")).alias("n_core"))


@_query("SELECT source, doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS is_query FROM documents")
def class_split(spark, d):
    """Documents halved at random, the same way at every run."""
    return table(spark, d, "documents").select("source", "doc_id", (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("is_query"))


@_query("SELECT i.draw, d.doc_id FROM (SELECT range AS draw, CAST(concat('0x', substr(md5(CAST(range AS VARCHAR)), 1, 8)) AS BIGINT) % (SELECT count(*) FROM documents) AS r FROM range(100)) i JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) d ON d.r = i.r")
def drawn_with_replacement(spark, d):
    docs = ranges.numbered(table(spark, d, "documents").select("doc_id"), "doc_id", name="r")
    draws = spark.range(100).select(F.col("id").alias("draw"), (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint") % docs.count()).alias("r"))
    return docs.join(F.broadcast(draws), "r").select("draw", "doc_id")  # a hundred rows


@_query("SELECT lower(trim(ProvenanceProbeStatus)) AS status, count(*) AS n, count(DISTINCT ProvenanceProbeFileID) AS n_probes FROM result_manifest GROUP BY 1")
def work_status(spark, d):
    """What is completed, unable and remaining."""
    m = table(spark, d, "result_manifest")
    return m.groupBy(F.lower(F.trim("ProvenanceProbeStatus")).alias("status")).agg(F.count("*").alias("n"), F.count_distinct("ProvenanceProbeFileID").alias("n_probes"))


@_query("SELECT probe_id FROM (SELECT DISTINCT probe_id FROM result_nodes WHERE probe_id IS NOT NULL UNION SELECT ProvenanceProbeFileID FROM result_manifest WHERE ProvenanceProbeFileID IS NOT NULL) WHERE probe_id NOT IN (SELECT ProvenanceProbeFileID FROM result_manifest WHERE lower(trim(ProvenanceProbeStatus)) = 'processed' AND ProvenanceProbeFileID IS NOT NULL)")
def work_list(spark, d):
    """Probes of all lists that are not processed yet."""
    m = table(spark, d, "result_manifest").select(F.col("ProvenanceProbeFileID").alias("probe_id"), F.lower(F.trim("ProvenanceProbeStatus")).alias("status")).filter("probe_id is not null")
    known = table(spark, d, "result_nodes").select("probe_id").dropna().unionByName(m.select("probe_id")).distinct()
    return known.join(m.filter("status = 'processed'").select("probe_id").distinct(), "probe_id", "left_anti")


@_query("SELECT source, n, format('cluster{:03d}_size{}_algorithm_Markov.json', nth, n) AS name FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS nth FROM documents WHERE source IS NOT NULL GROUP BY source)")
def cluster_names(spark, d):
    """File names of clusters, numbered from the largest."""
    c = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    numbered = ranges.numbered(c.withColumn("less", -F.col("n")), "less", "source")
    return numbered.select("source", "n", names.cluster_file((F.col("row_no") + 1).cast("int"), F.col("n"), "Markov").alias("name"))


@_query("SELECT image_id, replace(url_encode(name), '+', '%20') AS encoded FROM images WHERE name IS NOT NULL")
def encoded_names(spark, d):
    return table(spark, d, "images").filter("name is not null").select("image_id", names.percent_encoded(F.col("name")).alias("encoded"))


@_query("SELECT doc_id, bit_count(CAST(concat('0x', substr(md5(text), 1, 8)) AS BIGINT)) AS ones, CAST(concat('0x', substr(md5(text), 1, 8)) AS BIGINT) & 1 AS lowest FROM documents WHERE text IS NOT NULL")
def unpacked_bits(spark, d):
    """Bits of a 32-bit hash, lowest first: their sum and the first."""
    h = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    bits = table(spark, d, "documents").filter("text is not null").select("doc_id", names.bits(h, 32).alias("b"))
    return bits.select("doc_id", F.aggregate("b", F.lit(0), lambda t, x: t + x).cast("tinyint").alias("ones"), F.col("b")[0].cast("bigint").alias("lowest"))


@_query("SELECT metadata_dim, CAST(floor(4 * power(2, 30) / ((64 + metadata_dim) * 4)) AS BIGINT) AS features_in_memory FROM index_meta")
def memory_sizing(spark, d):
    """How many features with their key points fit in 4 GB."""
    return table(spark, d, "index_meta").select("metadata_dim", names.rows_in_memory(F.lit(4), 64 + F.col("metadata_dim"), F.lit(4)).alias("features_in_memory"))


# search


@_query(f"""WITH {_CENTRES}, np AS (SELECT * FROM (VALUES (1), (2), (4), (8), (16)) v(nprobe)),
    near AS (SELECT q.feature_id AS q, b.feature_id, greatest(0.0, round(2 - 2 * list_dot_product(q.v, b.v), 9)) AS dist FROM feat q, feat b WHERE q.image_id % 100 = 0),
    exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, feature_id) AS rank FROM near) WHERE rank <= 10),
    way AS (SELECT q.feature_id AS q, b.feature_id, q.r, greatest(0.0, round(2 - 2 * list_dot_product(q.v, b.v), 9)) AS dist FROM off q JOIN off b ON b.cell = q.cell AND b.r = 1 WHERE q.image_id % 100 = 0),
    found AS (SELECT * FROM (SELECT nprobe, q, feature_id, row_number() OVER (PARTITION BY nprobe, q ORDER BY dist, feature_id) AS rank FROM way, np WHERE r <= nprobe) WHERE rank <= 10)
    SELECT nprobe, count(DISTINCT e.q) AS n_queries, round(count(f.q) / (10.0 * count(DISTINCT e.q)), 6) AS share FROM exact e CROSS JOIN np LEFT JOIN found f USING (nprobe, q, feature_id) GROUP BY nprobe""")
def nprobe_sweep(spark, d):
    """Intersection with the exact ten nearest as more cells are probed."""
    feat = I.stored_features(spark, d)
    q, b = I.queries_of(feat).select(F.col("feature_id").alias("q"), "v"), feat.select("feature_id", "v")
    return evaluate.sweep(q, b, _centres(feat), 10, (1, 2, 4, 8, 16)).select("nprobe", "n_queries", _r("share"))


@_query(f"""WITH {_CENTRES}, word AS (SELECT cell AS w, p, list_slice(cv, p * 8 + 1, p * 8 + 8) AS c FROM cen, range(0, 8) t(p)),
    slice AS (SELECT feature_id, image_id, p, list_slice(v, p * 8 + 1, p * 8 + 8) AS s FROM feat, range(0, 8) t(p)),
    apart AS (SELECT feature_id, image_id, p, w, round(list_dot_product(s, s) - 2 * list_dot_product(s, c) + list_dot_product(c, c), 9) AS t FROM slice JOIN word USING (p)),
    code AS (SELECT feature_id, p, w FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, p ORDER BY t, w) AS r FROM apart) WHERE r = 1),
    near AS (SELECT q.feature_id AS q_feature, code.feature_id, greatest(0.0, round(sum(t), 9)) + 0.0 AS dist FROM apart q JOIN code USING (p, w) WHERE q.image_id % 100 = 0 GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_feature ORDER BY dist, feature_id) AS rank FROM near) WHERE rank <= 10""")
def pq_search(spark, d):
    """Search over product-quantiser codes alone, with the code words of the SQL; ``ivf_pq_search`` trains its own."""
    feat = I.stored_features(spark, d)
    words = np.array(_centres(feat))
    fixed = index.Index(None, np.zeros((1, words.shape[1])), np.stack(np.split(words, 8, axis=1)))
    got = index.search(fixed, I.queries_of(feat).select(F.col("feature_id").alias("q"), "v"), index.encode(fixed, feat.select("feature_id", "v")), 10)
    return got.select(F.col("q").alias("q_feature"), "feature_id", "dist", "rank")


@_query(_SQL["ivf_search"])
def index_merge(spark, d):
    """Two shards coded, stored, one of them in two deliveries, merged and searched; the cells and probes are those of the SQL."""
    ws, feat = Workspace(spark, "index"), I.features(spark, d)
    whole = index.Index(None, np.array(_centres(feat)), None)
    coded = ws.save(index.encode(whole, feat.select("feature_id", "v")), "coded")
    paths = [ws.path(f"shard{s}") for s in (0, 1)]
    for rest, path in ((0, paths[0]), (1, paths[1]), (2, paths[1])):
        index.append(coded.filter(F.col("feature_id") % 3 == rest), path)
    index.merge(spark, paths, merged := ws.path("merged"))
    got = index.search(whole, I.queries_of(feat).select(F.col("feature_id").alias("q"), "v"), spark.read.parquet(merged), 10, nprobe=11)
    return got.select(F.col("q").alias("q_feature"), "feature_id", "dist", "rank")


def _index(spark, d):
    """A trained index of all features, its codes stored: 64 cells, 8 parts of 256 words after a balanced rotation."""
    ws = Workspace(spark, "index")
    feat = ws.save(I.features(spark, d).select("feature_id", "image_id", "v"), "features")
    trained = index.load_or_train(spark, ws.path("trained"), feat, 64)
    index.append(index.encode(trained, feat), path := ws.path("codes"))
    return feat, trained, spark.read.parquet(path)


@_query()
def index_train(spark, d):
    """The trained cells with the number of features that each holds."""
    _, trained, coded = _index(spark, d)
    return coded.groupBy("cell").agg(F.count("*").alias("n"))


@_query()
def ivf_pq_search(spark, d):
    """Search by trained cells and codes; codes propose 100, exact distances choose 10."""
    feat, trained, coded = _index(spark, d)
    q = I.queries_of(feat).select(F.col("feature_id").alias("q"), "v")
    got = index.reranked(index.search(trained, q, coded, 100, nprobe=32), q, feat, 10)
    return got.select(F.col("q").alias("q_feature"), "feature_id", "dist", "rank")


@_query(f"WITH {I.sql_hits()}, c AS (SELECT probe_id, q_feature, image_id, dist, row_number() OVER (PARTITION BY q_feature ORDER BY dist, feature_id) AS r FROM hit), t AS (SELECT probe_id, image_id, sum(1 / (1 + dist)) AS s FROM c WHERE r <= 15 GROUP BY 1, 2) SELECT probe_id, image_id, round(s / max(s) OVER (PARTITION BY probe_id), 6) AS score FROM t")
def merged_hits(spark, d):
    """Hits of two halves of the index merged, cut to one and a half times ten, tallied and divided by the best."""
    h = I.hits(spark, d)
    parts = [h.filter(F.col("feature_id") % 2 == s) for s in (0, 1)]
    return results.normalise(scoring.merged_tally(parts, 10), "probe_id").select("probe_id", "image_id", _r("score"))


@_query(f"WITH {I.SQL_FEATURES}, q AS (SELECT feature_id, image_id, v, false AS flipped FROM feat WHERE image_id % 100 = 0 UNION ALL SELECT feature_id, image_id, list_reverse(v), true FROM feat WHERE image_id % 100 = 0), near AS (SELECT q.image_id AS probe_id, q.feature_id AS q_feature, flipped, b.feature_id, b.image_id, greatest(0.0, round(2 - 2 * list_dot_product(q.v, b.v), 9)) + 0.0 AS dist FROM q, feat b), hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_feature, flipped ORDER BY dist, feature_id) AS rank FROM near) WHERE rank <= 20), t AS (SELECT probe_id, image_id, flipped, round(sum(1 / (1 + dist)), 6) AS s FROM hit GROUP BY ALL) SELECT probe_id, image_id, max(s) AS score FROM t GROUP BY 1, 2")
def flip_augmented_scores(spark, d):
    """Queries united with their mirrored descriptors (here the vector read backwards), each half scored by itself, the better score counts."""
    feat = I.stored_features(spark, d)
    q = I.queries_of(feat)
    both = search.flip_augmented(q.select("feature_id", "image_id", "v"), q.select("feature_id", "image_id", F.reverse("v").alias("v")))
    top = search.exact_knn(both.select("q", "v"), feat.select("feature_id", "v"), I.K)
    hits = top.join(both.select("q", "flipped", F.col("image_id").alias("probe_id")), "q").join(feat.select("feature_id", "image_id"), "feature_id")
    halves = hits.groupBy("probe_id", "image_id", "flipped").agg(F.round(F.sum(1 / (1 + F.col("dist"))), 6).alias("score"))
    return halves.groupBy("probe_id", "image_id").agg(F.max("score").alias("score"))


@_query(f"WITH {I.sql_hits()}, t AS (SELECT probe_id, q_feature % 3 AS object, image_id, round(sum(1 / (1 + dist)), 6) AS score, count(DISTINCT q_feature) AS n_features FROM hit GROUP BY ALL), g AS (SELECT probe_id, object FROM t GROUP BY 1, 2 HAVING max(score) > 0.03) SELECT probe_id, object, image_id, score, n_features, CAST(rank AS INTEGER) AS rank FROM (SELECT t.*, row_number() OVER (PARTITION BY probe_id, object ORDER BY score DESC, image_id) AS rank FROM t SEMI JOIN g USING (probe_id, object)) WHERE rank <= 2")
def tier2_objects(spark, d):
    """Second-tier hits regrouped by object (here three of each probe), gated by their best score, the two best images of each."""
    h = I.hits(spark, d).withColumn("object", F.col("q_feature") % 3)
    return scoring.object_scores(h, 0.03, 2)


@_query(f"WITH {I.SQL_BINS}, win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id ORDER BY n DESC, grid, xb DESC, yb DESC) AS r FROM cnt) WHERE r = 1) SELECT probe_id, image_id, count(*) AS n, round(1 / (1 + stddev_pop(((angle - q_angle) % 360 + 360) % 360) / count(*)), 6) AS angle_coherence, round(1 / (1 + power(stddev_pop(vx) + stddev_pop(vy), 0.125) / 2), 5) AS point_coherence FROM vote JOIN win USING (probe_id, image_id, grid, xb, yb) GROUP BY 1, 2")
def vote_coherence(spark, d):
    return scoring.coherence(I.placed_hits(spark, d)).select("probe_id", "image_id", "n", _r("angle_coherence"), _r("point_coherence", 5))


@_query(f"WITH {I.SQL_BINS} SELECT probe_id, image_id, count(*) FILTER (vx >= 0 AND vx < width AND vy >= 0 AND vy < height) AS n_inside, count(*) AS n FROM v GROUP BY 1, 2")
def votes_in_bounds(spark, d):
    inside = scoring.in_bounds()
    return scoring.projected_votes(I.placed_hits(spark, d)).groupBy("probe_id", "image_id").agg(F.sum(inside.cast("bigint")).alias("n_inside"), F.count("*").alias("n"))


# results


@_query(f"WITH m AS ({_MAX}), c AS (SELECT *, avg(score) OVER p AS mean, stddev_pop(score) OVER p AS dev FROM m WINDOW p AS (PARTITION BY probe_id)), k AS (SELECT probe_id, fileid, least(greatest(score, mean - 2 * dev), mean + 2 * dev) AS score FROM c) SELECT probe_id, fileid, round(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 0 END, 5) AS score FROM (SELECT *, min(score) OVER (PARTITION BY probe_id) AS low, max(score) OVER (PARTITION BY probe_id) AS high FROM k)")
def clipped_scores(spark, d):
    """Scores clipped to two deviations around their probe's mean and mapped to 0 to 1."""
    return results.min_max(results.clipped(merge_max(spark, d), "probe_id", 2.0), "probe_id").select("probe_id", "fileid", _r("score", 5))


@_query(f"WITH {I.SQL_FILES}, w AS (SELECT regexp_replace(name, '\\.[^.]*$', '') AS stem, min(name) AS name FROM images WHERE name IS NOT NULL GROUP BY 1), p AS (SELECT ProvenanceProbeFileID AS stem, min(ProvenanceOutputFileName) AS name FROM result_manifest WHERE ProvenanceOutputFileName IS NOT NULL GROUP BY 1) SELECT res.probe_id, res.rank, coalesce(w.name, p.name, regexp_replace(res.file, '\\.[^.]*$', '')) AS file FROM res LEFT JOIN w ON w.stem = regexp_replace(res.file, '\\.[^.]*$', '') LEFT JOIN p ON p.stem = regexp_replace(res.file, '\\.[^.]*$', '')")
def remapped_results(spark, d):
    """Delivered names replaced by the world's, else the probe's, else kept."""
    r = I.ranked_files(spark, d).select("probe_id", "rank", names.last_stem(F.col("file")).alias("file"))
    world = table(spark, d, "images").filter("name is not null").groupBy(names.last_stem(F.col("name")).alias("file")).agg(F.min("name").alias("name"))
    probe = table(spark, d, "result_manifest").filter("ProvenanceOutputFileName is not null").groupBy(F.col("ProvenanceProbeFileID").alias("file")).agg(F.min("ProvenanceOutputFileName").alias("name"))
    return results.remapped(r, world, probe, "file").select("probe_id", "rank", "file")


@_query(f"WITH {I.SQL_FILES} SELECT probe_id, count(*) AS n, count(*) FILTER (file IN (SELECT name FROM images WHERE name IS NOT NULL)) AS n_known FROM res GROUP BY 1")
def matrix_members(spark, d):
    """How many of a probe's results have a place in the affinity matrix."""
    known = table(spark, d, "images").select(F.col("name").alias("file"), F.lit(1).alias("known")).dropna().distinct()
    return I.ranked_files(spark, d).join(known, "file", "left").groupBy("probe_id").agg(F.count("*").alias("n"), F.count("known").alias("n_known"))


@_query(f"WITH {I.SQL_EDGES} SELECT a AS node, count(*) AS n_edges, i.path FROM way JOIN images i ON i.image_id = way.a GROUP BY 1, 3")
def member_paths(spark, d):
    """Members of the affinity graph with their images' paths."""
    n = graph.weighted_degree(I.edges(spark, d)).select("node", "n_edges")
    return n.join(table(spark, d, "images").select(F.col("image_id").alias("node"), "path"), "node")


# scorer

_WORLD = "world AS (SELECT DISTINCT name AS file FROM images WHERE name IS NOT NULL)"


def _world(spark, d):
    return table(spark, d, "images").select(F.col("name").alias("file")).dropna().distinct()


@_query(f"WITH {I.SQL_FILES}, {_WORLD}, t AS (SELECT * FROM truth SEMI JOIN world USING (file)), s AS (SELECT * FROM res SEMI JOIN world USING (file)) SELECT r, CAST(count(*) FILTER (rank <= r) AS BIGINT) AS n_correct, count(*) AS n_truth, round(count(*) FILTER (rank <= r) / greatest(count(*), 1), 6) AS recall FROM t LEFT JOIN s USING (probe_id, file), (VALUES (25), (50), (100), (200), (300), (400)) v(r) GROUP BY r")
def recall_in_world(spark, d):
    """Recall where only files of the world count, on both sides."""
    w = _world(spark, d)
    return evaluate.recall_at(evaluate.in_world(I.ranked_files(spark, d), w), evaluate.in_world(I.truth(spark, d), w)).select("r", "n_correct", "n_truth", _r("recall"))


@_query(f"WITH {I.SQL_FILES}, {_WORLD} SELECT probe_id, file FROM truth ANTI JOIN world USING (file)")
def groundtruth_unused(spark, d):
    return evaluate.unused(I.truth(spark, d), _world(spark, d))


@_query(f"WITH {I.SQL_FILES} SELECT probe_id, round(count(t.file) / 100.0, 6) AS precision FROM (SELECT * FROM res WHERE rank <= 100) r LEFT JOIN truth t USING (probe_id, file) GROUP BY 1")
def precision_at_100(spark, d):
    return evaluate.precision_at(I.ranked_files(spark, d), I.truth(spark, d), 100).select("probe_id", _r("precision"))


_DONORS = f"""RECURSIVE {I.SQL_JOURNAL},
    above AS (SELECT tree, parent AS node FROM k WHERE lower(trim(op)) = 'donor' UNION SELECT k.tree, k.parent FROM above JOIN k ON k.tree = above.tree AND k.child = above.node)"""


@_query(f"WITH {_DONORS} SELECT tree AS journal_id, node FROM above")
def donors(spark, d):
    """Nodes that have a donor link at or below them."""
    return I.donors(spark, d).withColumnRenamed("tree", "journal_id")


@_query(f"WITH {_DONORS}, {I.SQL_FILES}, df AS (SELECT DISTINCT a.tree AS journal_id, g.file FROM above a JOIN gt_journal_nodes g ON g.journal_id = a.tree AND g.idx = a.node WHERE g.file IS NOT NULL), dt AS (SELECT home.probe_id, df.file FROM home JOIN df USING (journal_id)) SELECT r, CAST(count(*) FILTER (rank <= r) AS BIGINT) AS n_correct, count(*) AS n_truth, round(count(*) FILTER (rank <= r) / greatest(count(*), 1), 6) AS recall FROM dt LEFT JOIN res USING (probe_id, file), (VALUES (25), (50), (100), (200), (300), (400)) v(r) GROUP BY r")
def donor_recall(spark, d):
    files = I.donors(spark, d).join(table(spark, d, "gt_journal_nodes").select(F.col("journal_id").alias("tree"), F.col("idx").alias("node"), "file").filter("file is not null"), ["tree", "node"])
    return evaluate.recall_at(I.ranked_files(spark, d), I.truth(spark, d, files.select(F.col("tree").alias("journal_id"), "file").distinct())).select("r", "n_correct", "n_truth", _r("recall"))


@_query(f"""WITH RECURSIVE {I.SQL_JOURNAL}, l AS (SELECT DISTINCT tree, parent, child FROM k WHERE parent <> child),
    ends AS (SELECT n.*, n.node NOT IN (SELECT child FROM l WHERE l.tree = n.tree) AS is_root, n.node NOT IN (SELECT parent FROM l WHERE l.tree = n.tree) AS is_leaf FROM n),
    down AS (SELECT tree, node, 0 AS level FROM ends WHERE is_root UNION SELECT l.tree, l.child, level + 1 FROM down JOIN l ON l.tree = down.tree AND l.parent = down.node WHERE level < 300),
    up AS (SELECT tree, node, 0 AS level FROM ends WHERE is_leaf UNION SELECT l.tree, l.parent, level + 1 FROM up JOIN l ON l.tree = up.tree AND l.child = up.node WHERE level < 300),
    dr AS (SELECT tree, node, min(level) AS from_root FROM down GROUP BY ALL), dl AS (SELECT tree, node, min(level) AS from_leaf FROM up GROUP BY ALL),
    di AS (SELECT tree, child AS node, count(*) AS degree_in FROM l GROUP BY ALL), do_ AS (SELECT tree, parent AS node, count(*) AS degree_out FROM l GROUP BY ALL)
    SELECT e.tree AS journal_id, e.node, coalesce(degree_in, 0) AS degree_in, coalesce(degree_out, 0) AS degree_out, is_root, is_leaf, from_root, from_leaf, round((from_root + 1) / (from_root + from_leaf + 1), 6) AS root_share,
      coalesce(degree_in, 0) + 2 * coalesce(degree_out, 0) AS penalty
    FROM ends e LEFT JOIN dr USING (tree, node) LEFT JOIN dl USING (tree, node) LEFT JOIN di USING (tree, node) LEFT JOIN do_ USING (tree, node)""")
def node_roles(spark, d):
    """Degrees, distances from root and leaf, and the cost of missing each node of a journal."""
    n, k = I.journal(spark, d)
    got = graph.node_roles(n, k.select("tree", "parent", "child"))
    return got.select(F.col("tree").alias("journal_id"), "node", "degree_in", "degree_out", "is_root", "is_leaf", "from_root", "from_leaf", _r("root_share"), "penalty")


@_query(f"""WITH RECURSIVE {I.SQL_JOURNAL}, l AS (SELECT DISTINCT tree, parent, child FROM k),
    walk AS (SELECT n.tree, n.node, [n.node] AS path FROM n WHERE n.node NOT IN (SELECT child FROM l WHERE l.tree = n.tree)
      UNION ALL SELECT l.tree, l.child, list_append(path, l.child) FROM walk JOIN l ON l.tree = walk.tree AND l.parent = walk.node WHERE NOT list_contains(path, l.child))
    SELECT walk.tree AS journal_id, array_to_string(path, '/') AS path FROM walk WHERE node NOT IN (SELECT parent FROM l WHERE l.tree = walk.tree)""")
def paths_to_leaves(spark, d):
    """Every simple path from a root to a leaf, over all links."""
    n, k = I.journal(spark, d)
    return graph.paths_to_leaves(n, k.select("tree", "parent", "child")).select(F.col("tree").alias("journal_id"), F.array_join("path", "/").alias("path"))


# statistics of pairs


@_query(f"WITH {I.SQL_PAIRS}, o AS (SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS second FROM d WINDOW w AS (PARTITION BY probe_id, image_id, q_feature ORDER BY dist, feature_id)), m AS (SELECT probe_id, image_id, q_feature, feature_id, dist FROM o WHERE r = 1 AND second > 0 AND round(sqrt(dist / second), 9) < 0.95) SELECT probe_id, image_id, q_feature, feature_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id, feature_id ORDER BY dist, q_feature) AS n FROM m) WHERE n = 1")
def ratio_test_one_to_one(spark, d):
    return pairs.ratio_matches(*I.paired(spark, d), 0.95, single=True).drop("ratio")


@_query(f"WITH {I.SQL_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id, q_feature ORDER BY dist, feature_id) AS a, row_number() OVER (PARTITION BY probe_id, image_id, feature_id ORDER BY dist, q_feature) AS b FROM d) SELECT probe_id, image_id, count(*) AS kp_count, round(avg(dist), 6) AS avg_dist FROM o WHERE a = 1 AND b = 1 GROUP BY 1, 2")
def pair_stats(spark, d):
    return matching.pair_stats(matching.mutual_in_pair(I.pair_nearest(spark, d, 1, True))).select("probe_id", "image_id", "kp_count", _r("avg_dist"))


@_query("SELECT l_returnflag, round(avg((l_discount - l_tax) * (l_discount - l_tax)), 9) AS mse FROM lineitem GROUP BY 1")
def mean_squared_error(spark, d):
    return evaluate.mean_squared_error(table(spark, d, "lineitem"), "l_returnflag", "l_discount", "l_tax").select("l_returnflag", _r("mse", 9))


_GROUPED = "g AS (SELECT DISTINCT graph_id AS group_id, source AS a, target AS b, relationshipConfidenceScore AS weight FROM graph_links WHERE graph_id IS NOT NULL AND source <> target AND isfinite(relationshipConfidenceScore))"


@_query(f"WITH {_GROUPED}, s AS (SELECT *, abs(weight - avg(weight) OVER p) > stddev_pop(weight) OVER p AS outside FROM g WINDOW p AS (PARTITION BY group_id)), n AS (SELECT group_id, count(DISTINCT v) AS nodes FROM (SELECT group_id, a AS v FROM g UNION SELECT group_id, b FROM g) GROUP BY 1) SELECT group_id, any_value(nodes) > 2 AND count(*) FILTER (outside) / count(*) <= 0.5 AS near_duplicate FROM s JOIN n USING (group_id) GROUP BY 1")
def near_duplicate_groups(spark, d):
    k = table(spark, d, "graph_links").filter(F.col("graph_id").isNotNull() & (F.col("source") != F.col("target")) & is_finite(F.col("relationshipConfidenceScore")))
    return graph.near_duplicates(k.select(F.col("graph_id").alias("group_id"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relationshipConfidenceScore").alias("weight")).distinct())


@_query("""WITH h AS (SELECT l_returnflag AS g, CAST(floor(l_discount / 0.1 * 255) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY bin) AS n0, sum(n * bin) OVER (PARTITION BY g ORDER BY bin) AS s0, sum(n) OVER (PARTITION BY g) AS t, sum(n * bin) OVER (PARTITION BY g) AS st FROM h),
    v AS (SELECT g, bin, round(n0 / t * (1 - n0 / t) * power(s0 / n0 - (st - s0) / (t - n0), 2), 6) AS between_ FROM c WHERE n0 < t)
    SELECT g AS l_returnflag, CAST(bin AS INTEGER) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY between_ DESC, bin) AS r FROM v) WHERE r = 1""")
def otsu_threshold(spark, d):
    """The level that separates a group's values best, over 256 levels."""
    level = F.floor(F.col("l_discount") / 0.1 * 255).cast("int")
    return evaluate.otsu_threshold(table(spark, d, "lineitem").withColumn("level", level), "l_returnflag", "level")


@_query("SELECT file, feature_id, CAST(rank AS INTEGER) AS rank FROM (SELECT file, feature_id, row_number() OVER (PARTITION BY file ORDER BY response DESC, feature_id) AS rank FROM (SELECT feature_id, arg_min(file, (ingested_at, file)) AS file, arg_min(keypointMetadata[3], (ingested_at, file)) AS response FROM query_index WHERE file IS NOT NULL AND feature_id IS NOT NULL AND isfinite(keypointMetadata[3]) GROUP BY 1)) WHERE rank <= 25")
def strongest_keypoints(spark, d):
    """The 25 strongest key points of each file."""
    q = table(spark, d, "query_index").withColumn("response", F.get("keypointMetadata", F.lit(2))).filter(F.col("file").isNotNull() & F.col("feature_id").isNotNull() & is_finite(F.col("response")))
    once = q.groupBy("feature_id").agg(F.min(F.struct("ingested_at", "file", "response")).alias("r")).select("feature_id", "r.file", F.col("r.response").alias("score"))
    return results.first(once, "file", "feature_id", 25).select("file", "feature_id", "rank")


@_query()
def spaced_keypoints(spark, d):
    """Key points of each image taken by falling size, none within 50 pixels of one taken before."""
    p = I.features(spark, d).select(F.col("image_id").alias("group_id"), F.col("feature_id").alias("id"), "x", "y", F.col("size").alias("score"))
    return matching.spaced_points(p, 50.0).withColumnRenamed("group_id", "image_id")


@_query()
def affine_fits(spark, d):
    """The affine map of each pair's mutual matches, with the reciprocal condition of its equations."""
    m = matching.mutual_in_pair(I.pair_nearest(spark, d, 1, True))
    feat = I.features(spark, d)
    m = m.join(feat.select(F.col("feature_id").alias("q_feature"), F.col("x").alias("qx"), F.col("y").alias("qy")), "q_feature").join(feat.select("feature_id", "x", "y"), "feature_id")
    return matching.affine_fit(m)


# graphs of provenance

_LINKED = """link AS (SELECT graph_id AS probe_id, least(source, target) AS i, greatest(source, target) AS j, max(relationshipConfidenceScore) AS s FROM graph_links
      WHERE graph_id IS NOT NULL AND source <> target AND isfinite(relationshipConfidenceScore) AND relationshipConfidenceScore > 0 GROUP BY ALL),
    pair AS (SELECT probe_id, i, j, CAST(floor(s * 20) AS BIGINT) AS kp_count, 1 - s AS avg_dist, (i * 7919 % 1000) / 1000.0 AS mi_ij, (j * 104729 % 997) / 1000.0 AS mi_ji FROM link)"""


def _linked(spark, d):
    """Pair values that follow from the links' scores, in the form of ``pair_stats`` with mutual information."""
    k = table(spark, d, "graph_links").filter(F.col("graph_id").isNotNull() & (F.col("source") != F.col("target")) & is_finite(F.col("relationshipConfidenceScore")) & (F.col("relationshipConfidenceScore") > 0))
    s = k.groupBy(F.col("graph_id").alias("probe_id"), F.least("source", "target").alias("i"), F.greatest("source", "target").alias("j")).agg(F.max("relationshipConfidenceScore").alias("s"))
    return s.select("probe_id", "i", "j", F.floor(F.col("s") * 20).alias("kp_count"), (1 - F.col("s")).alias("avg_dist"), (F.col("i") * 7919 % 1000 / 1000).alias("mi_ij"), (F.col("j") * 104729 % 997 / 1000).alias("mi_ji"))


@_query(f"""WITH {_LINKED}, ok AS (SELECT * FROM pair WHERE (mi_ij <> 0 OR mi_ji <> 0) AND kp_count >= 4 AND (kp_count >= 10 OR avg_dist < 0.1)),
    way AS (SELECT probe_id, i AS node, j AS other, kp_count, mi_ij AS out_, mi_ji AS back FROM ok UNION ALL SELECT probe_id, j, i, kp_count, mi_ji, mi_ij FROM ok),
    tied AS (SELECT *, min(other) OVER (PARTITION BY probe_id, node) AS first FROM (SELECT *, max(kp_count) OVER (PARTITION BY probe_id, node) AS top FROM way) WHERE kp_count = top),
    offer AS (SELECT probe_id, node, other, out_ AS v, 0 AS step, CASE WHEN other <> first OR out_ > back THEN true WHEN out_ < back THEN false END AS outward FROM tied UNION ALL SELECT probe_id, node, other, back, 1, false FROM tied WHERE other <> first)
    SELECT probe_id, node, other AS best, outward FROM (SELECT *, row_number() OVER (PARTITION BY probe_id, node ORDER BY v DESC, other, step) AS r FROM offer) WHERE r = 1""")
def strongest_link(spark, d):
    return graph.strongest_links(_linked(spark, d))


@_query()
def provenance_chain(spark, d):
    """The directed graph of each link graph's first hundred images, numbered by id; the smallest stands for the probe."""
    p = _linked(spark, d)
    ends = p.select("probe_id", F.explode(F.array("i", "j")).alias("node")).distinct()
    n = ends.withColumn("n", F.row_number().over(Window.partitionBy("probe_id").orderBy("node")) - 1).filter(F.col("n") < graph.MOST_CANDIDATES)
    for c in ("i", "j"):
        p = p.join(n.withColumnsRenamed({"node": c, "n": "n_" + c}), ["probe_id", c])
    return graph.provenance_graph(p.select("probe_id", F.col("n_i").alias("i"), F.col("n_j").alias("j"), "kp_count", "avg_dist", "mi_ij", "mi_ji"))


@_query(f"WITH {I.SQL_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY probe_id, image_id, q_feature ORDER BY dist, feature_id) AS a, row_number() OVER (PARTITION BY probe_id, image_id, feature_id ORDER BY dist, q_feature) AS b FROM d), m AS (SELECT o.probe_id, o.image_id, f.x, f.y, i.width, i.height FROM o JOIN feat f ON f.feature_id = o.q_feature JOIN images i ON i.image_id = o.probe_id WHERE a = 1 AND b = 1 AND i.width > 0 AND i.height > 0) SELECT probe_id, image_id, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 10 OR (count(*) >= 2 AND max(x) - min(x) <= 0.2 * max(height) AND max(y) - min(y) <= 0.2 * max(width))")
def related_images(spark, d):
    """Images related by their matches; with key points as sparse as these two matches within a fifth of the image are asked for."""
    feat = I.features(spark, d)
    sizes = table(spark, d, "images").filter("width > 0 and height > 0").select(F.col("image_id").alias("probe_id"), "width", "height")
    m = matching.mutual_in_pair(I.pair_nearest(spark, d, 1, True)).join(feat.select(F.col("feature_id").alias("q_feature"), F.col("x").alias("qx"), F.col("y").alias("qy")), "q_feature").join(sizes, "probe_id")
    return matching.related_pairs(m, at_least=2, share=0.2)


@_query(f"WITH {I.sql_hits()}, g AS (SELECT DISTINCT q_feature FROM hit) SELECT q_feature, CAST(r AS INTEGER) AS rank, feature_id FROM (SELECT q_feature, unnest(range(1, 26)) AS r FROM g) LEFT JOIN (SELECT q_feature, rank AS r, feature_id FROM hit) USING (q_feature, r)")
def padded_hits(spark, d):
    """25 rows for each query feature, those beyond its hits empty."""
    return results.padded(I.hits(spark, d).select("q_feature", "rank", "feature_id"), "q_feature", 25).select("q_feature", "rank", "feature_id")


@_query("SELECT image_id, shard_no, CAST(row_number() OVER (PARTITION BY shard_no ORDER BY image_id) - 1 + CASE WHEN shard_no = 1 THEN (SELECT count(*) FROM images WHERE image_id % 2 = 0) ELSE 0 END AS BIGINT) AS number FROM (SELECT image_id, CAST(image_id % 2 AS INTEGER) AS shard_no FROM images)")
def offset_shards(spark, d):
    """Two shards, each numbered from 0, opened as one."""
    i = table(spark, d, "images").select("image_id")
    return ranges.offset_union([ranges.numbered(i.filter(F.col("image_id") % 2 == s), "image_id", name="number") for s in (0, 1)], "number")


_FIRST = "first AS (SELECT journal_id, arg_min(struct_pack(s := source, t := target), (recorded_at, source, target)) AS k FROM gt_journal WHERE source IS NOT NULL AND target IS NOT NULL AND recorded_at IS NOT NULL AND coalesce(lower(trim(op)), '') <> 'donor' GROUP BY 1)"


@_query(_TREE + f", {_FIRST} SELECT first.journal_id, walk.root AS original, first.k.t AS modified FROM first JOIN walk ON walk.journal_id = first.journal_id AND walk.node = first.k.s")
def original_pairs(spark, d):
    """Of each journal the root above its first link and that link's target."""
    links = table(spark, d, "gt_journal").filter(F.coalesce(F.lower(F.trim("op")), F.lit("")) != "donor").dropna(subset=["journal_id", "source", "target", "recorded_at"])
    first = links.groupBy(F.col("journal_id").alias("tree")).agg(F.min(F.struct("recorded_at", "source", "target")).alias("k")).select("tree", F.col("k.source").cast("bigint").alias("node"), F.col("k.target").alias("modified"))
    placed = _placed(spark, d).filter("not is_cycle").select("tree", "node", F.col("root").cast("int").alias("original"))
    return placed.join(first, ["tree", "node"]).select(F.col("tree").alias("journal_id"), "original", "modified")


@_query(f"WITH {I.SQL_FEATURES} SELECT feature_id, image_id FROM feat WHERE image_id IN (SELECT image_id FROM images WHERE substr(md5(CAST(image_id AS VARCHAR)), 1, 1) < '8')")
def class_features(spark, d):
    """The features of the images that a random half of the classes holds."""
    chosen = table(spark, d, "images").filter(F.substring(F.md5(F.col("image_id").cast("string")), 1, 1) < "8").select("image_id").distinct()
    return I.features(spark, d).select("feature_id", "image_id").join(chosen, "image_id", "left_semi")
