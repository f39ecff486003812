"""Vector, image and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as ve
from ..sources import io
from . import tables as tb
from .evaluate import rounded


def _rows(spark, sf_dir):
    return tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") == 0).alias("positive"))


def m1_knn(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    n = rows.count()
    return rounded(ve.knn_margin(rows, 5, max(1, -(-n // ve.block_rows(n)))))


M1_SQL = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label = 0 AS p FROM embeddings),
s AS (SELECT a.id, b.p, list_dot_product(a.v, b.v) AS s FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT id, p, avg(s) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id, p ORDER BY s DESC) AS r FROM s) WHERE r <= 5 GROUP BY id, p)
SELECT id, round(max(m) FILTER (p) - max(m) FILTER (NOT p), 6) AS margin FROM r GROUP BY id"""


def m2_prototypes(spark, sf_dir):
    return rounded(ve.prototype_margin(_rows(spark, sf_dir)))


M2_SQL = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label = 0 AS p FROM embeddings), c AS (SELECT p, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
s AS (SELECT p, list(x ORDER BY i) AS s FROM (SELECT p, i, sum(x) AS x FROM c GROUP BY p, i) GROUP BY p)
SELECT id, round(list_dot_product(v, pp) / (sqrt(list_dot_product(pp, pp)) + 1e-9) - list_dot_product(v, nn) / (sqrt(list_dot_product(nn, nn)) + 1e-9), 6) AS margin
FROM (SELECT id, v, CASE WHEN e.p THEN [sp.s[k] - v[k] for k in range(1, len(v) + 1)] ELSE sp.s END AS pp, CASE WHEN e.p THEN sn.s ELSE [sn.s[k] - v[k] for k in range(1, len(v) + 1)] END AS nn FROM e, (SELECT s FROM s WHERE p) sp, (SELECT s FROM s WHERE NOT p) sn)"""

def m3_probe(spark, sf_dir):
    return rounded(ve.linear_probe(_rows(spark, sf_dir), folds=3))


def m4_calibration(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("id", "positive", *(F.when(F.col("id") % 29 != i, F.col("vec")[i]).alias(f"f{i}") for i in range(6)))
    return rounded(ve.calibration(rows, [f"f{i}" for i in range(6)], least=0.01))


def m5_scores(spark, sf_dir):
    s = tb.scores(spark, sf_dir)
    score = ve.calibrated_score({"score": F.col("score"), "spectral": F.col("spectral")}, [("score", 0.5, 0.25, 1.5), ("spectral", 0.4, 0.2, -0.75)], 0.125)
    return s.select("file", "score", "spectral", score.alias("calibrated"))


M5_SQL = f"""WITH {tb.SCORES_SQL} SELECT file, score, spectral, round(1 / (1 + exp(-greatest(-30, least(30, 0.125::DOUBLE + 1.5::DOUBLE * (coalesce(score, 0.5) - 0.5) / 0.25::DOUBLE + -0.75::DOUBLE * (spectral - 0.4) / 0.2::DOUBLE)))), 4) AS calibrated FROM score"""


def m6_weighted_head(spark, sf_dir):
    i = F.col("id")
    rows = _rows(spark, sf_dir).select("vec", F.when(i % 5 < 3, "train").when(i % 5 < 4, "calibration").otherwise("blind").alias("split"), F.when(F.col("positive"), "generated").otherwise("real").alias("kind"), F.floor(F.sqrt(i)).alias("grp"), (i % 5 < 4).alias("reviewed"), F.lit(False).alias("label_present"), F.lit("m").alias("manifest"), F.lit("b").alias("backbone"))
    head = ve.weighted_head(rows, "m", "b")
    return rounded(head.select("n", "positives", "bias", F.posexplode("weights").alias("i", "weight")))


def _images(spark, sf_dir):
    # a vector's products with itself make an image of as many rows and columns
    e = tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("v"))
    return e.select("id", F.size("v").alias("height"), F.size("v").alias("width"), F.flatten(F.transform("v", lambda x: F.transform("v", lambda y: x * y))).alias("pixels"))


def i1_i2_image_features(spark, sf_dir):
    return rounded(ve.image_features(_images(spark, sf_dir)))


def i3_anomaly(spark, sf_dir):
    maps = tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("cells"))
    return rounded(ve.anomaly_area(maps, 8))


I3_SQL = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT id, v, list_avg(v) + 2 * sqrt(greatest(0, list_avg([x * x for x in v]) - list_avg(v) * list_avg(v))) AS t FROM e),
h AS (SELECT id, len(v) AS n, [i for i in range(0, len(v)) if v[i + 1] > t] AS h FROM t), m AS (SELECT id, n, len(h) AS k, list_median([i // 8 for i in h]) / 7 AS y, list_median([i % 8 for i in h]) / 7 AS x FROM h)
SELECT id, round(k / n, 6) AS ratio, CASE WHEN k > 0 THEN coalesce(nullif(CASE WHEN x < 0.34 THEN 'left' WHEN x > 0.66 THEN 'right' ELSE '' END || CASE WHEN y < 0.34 THEN 'top' WHEN y > 0.66 THEN 'bottom' ELSE '' END, ''), 'middle') END AS position FROM m"""


def s1_rooted(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    post = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("platform"), "text")
    sets = d.groupBy(F.floor(F.col("doc_id") / 50).alias("b")).agg(F.to_json(F.struct(F.collect_list(post).alias("posts"))).alias("value")).select("value")
    sets.write.text(path := io.new_path(spark, "posts"))
    return io.read_rooted(spark, path, "posts").select("id", "platform", F.md5("text").alias("digest"))


S1_SQL = "SELECT doc_id::VARCHAR AS id, source AS platform, md5(text) AS digest FROM documents"


def s2_notes(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    notes = d.select(F.col("doc_id").cast("string").alias("note_id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("title"), F.col("text").alias("desc"))
    return io.read_notes(spark, io.write_export(notes, io.new_path(spark, "notes"))).select("note_id", F.md5("text").alias("digest"))


S2_SQL = "SELECT doc_id::VARCHAR AS note_id, md5(CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END || chr(10) || text) AS digest FROM documents"


def s3_lines(spark, sf_dir):
    tb.table(spark, sf_dir, "conversations").select(F.concat(F.lit("  "), "text", F.lit("\n \n")).alias("value")).write.text(path := io.new_path(spark, "lines"))
    return io.read_lines(spark, path).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


S3_SQL = "SELECT md5(trim(l)) AS digest, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE length(trim(l)) > 0 GROUP BY 1"


def s4_evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    ok = F.to_json(F.struct(F.element_at(F.array(F.lit("aigc"), F.lit("ela")), (k % 2 + 1).cast("int")).alias("tool"), F.floor(k / 2).cast("string").alias("source_asset_id"), F.array(F.struct((k % 100 / 100).alias("score"))).alias("evidence")))
    tb.table(spark, sf_dir, "orders").select(F.when(k % 10 == 0, "{broken").otherwise(ok).alias("value")).write.text(path := io.new_path(spark, "evidence"))
    out = io.read_evidence(spark, path, ["aigc", "ela"])
    return out.select("asset", F.col("aigc.score").alias("aigc"), F.col("ela.score").alias("ela"))


S4_SQL = "SELECT (o_orderkey // 2)::VARCHAR AS asset, max(o_orderkey % 100 / 100) FILTER (o_orderkey % 2 = 0) AS aigc, max(o_orderkey % 100 / 100) FILTER (o_orderkey % 2 = 1) AS ela FROM orders WHERE o_orderkey % 10 > 0 GROUP BY 1"


def s5_assets(spark, sf_dir):
    tb.table(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.text(path := io.new_path(spark, "assets"))
    return io.list_assets(spark, path, "part-*.txt").agg(F.sum("length").alias("bytes"))


S5_SQL = "SELECT sum(strlen(text) + 1)::BIGINT AS bytes FROM documents"


def s6_export(spark, sf_dir):
    d = tb.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = io.write_export(d, io.new_path(spark, "export"), "csv")
    return spark.read.schema(d.schema).option("header", True).csv(path)


S6_SQL = "SELECT c_custkey, c_name, c_mktsegment FROM customer"

QUERIES = {
    "m1_knn": (m1_knn, M1_SQL), "m2_prototypes": (m2_prototypes, M2_SQL), "m3_probe": (m3_probe, None), "m4_calibration": (m4_calibration, None), "m5_scores": (m5_scores, M5_SQL), "m6_weighted_head": (m6_weighted_head, None),
    "i1_i2_image_features": (i1_i2_image_features, None), "i3_anomaly": (i3_anomaly, I3_SQL), "s1_rooted": (s1_rooted, S1_SQL), "s2_notes": (s2_notes, S2_SQL), "s3_lines": (s3_lines, S3_SQL), "s4_evidence": (s4_evidence, S4_SQL), "s5_assets": (s5_assets, S5_SQL), "s6_export": (s6_export, S6_SQL),
}
