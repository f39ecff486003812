"""Comment queries: T5, T6, T11 to T14, A1 to A8, A34."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import comments as cm
from . import tables as tb

WORDS = {"details": tb.DETAILS, "positive": tb.GLAD, "negative": tb.SORRY}


def t5_style(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").withColumn("_sizes", tx.sentence_sizes(F.col("text")))
    cols = tx.style(F.col("text"), ["the", "and"], ["der", "les"], F.col("_sizes"))
    return d.select("doc_id", *(F.round(c, 6).alias(k) if k.startswith("avg") or "_cv" in k or "per_100" in k else c.alias(k) for k, c in cols.items()))


T5_SQL = r"""
WITH s AS (SELECT doc_id, text, [length(x)::DOUBLE for x in regexp_split_to_array(text, '[。！？!?；;\n]') if length(regexp_replace(x, '[\s\p{Z}]', '', 'g')) > 0] AS z FROM documents),
m AS (SELECT *, len(z) AS n, coalesce(list_avg(z), 0) AS mean FROM s)
SELECT doc_id, length(text) AS char_count, n AS sentence_count, round(mean, 6) AS avg_sentence_len,
  round(CASE WHEN n >= 2 AND mean > 0 THEN sqrt(list_sum([(x - mean) * (x - mean) for x in z]) / n) / mean ELSE 0 END, 6) AS sentence_len_cv,
  round(((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'and', ''))) // 3) * 100.0 / greatest(length(text), 1), 6) AS ai_marker_per_100,
  round(((length(text) - length(replace(text, 'der', ''))) // 3 + (length(text) - length(replace(text, 'les', ''))) // 3) * 100.0 / greatest(length(text), 1), 6) AS template_marker_per_100,
  regexp_matches(text, '[0-9]+(\.[0-9]+)?') AS has_number,
  regexp_matches(text, '(第?[0-9]+[ \t\n]*(天|周|月|年|次|小时|分钟))|(早上|晚上|睡前|晨起|两周|一个月)') AS has_time_detail,
  regexp_matches(text, '[A-Za-z]*[0-9]{2,3}[ \t\n]*(号|色)?|(色号)|(#[A-Za-z0-9_\p{L}]+)') AS has_shade_detail
FROM m"""


def t6_flood(spark, sf_dir):
    lines = tb.conversations(spark, sf_dir).select("thread", F.trim("text").alias("text")).filter(F.length("text") > 0)
    n = F.count("*")
    out = lines.groupBy("thread").agg(n.alias("comment_count"), F.countDistinct("text").alias("unique_count"), F.avg((F.length("text") <= 15).cast("double")).alias("short_ratio"))
    return out.filter("comment_count >= 2").select("thread", "comment_count", "unique_count", F.round(F.col("unique_count") / F.col("comment_count"), 6).alias("unique_ratio"), F.round("short_ratio", 6).alias("short_ratio"))


T6_SQL = """
SELECT conv_id AS thread, count(*) AS comment_count, count(DISTINCT trim(text)) AS unique_count,
       round(count(DISTINCT trim(text)) / count(*), 6) AS unique_ratio, round(avg((length(trim(text)) <= 15)::INT), 6) AS short_ratio
FROM conversations WHERE length(trim(text)) > 0 GROUP BY conv_id HAVING count(*) >= 2"""


def t11_normalize(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", tx.normalized(F.col("text")).alias("norm"))


T11_SQL = f"SELECT doc_id, {tb.NORM_SQL} AS norm FROM documents"


def t12_grams(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.gram_set(tx.normalized(F.col("text")))).alias("grams"))


T12_SQL = f"SELECT doc_id, len({tb.GRAMS_SQL}) AS grams FROM (SELECT doc_id, {tb.NORM_SQL} AS norm FROM documents)"


def t13_detail(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", tx.has_detail(F.col("text")).alias("has_detail"))


T13_SQL = r"SELECT doc_id, regexp_matches(text, '\p{Nd}|天|周|月|年|小时') AS has_detail FROM documents"


def t14_sentiment(spark, sf_dir):
    t = F.col("text")
    return tb.table(spark, sf_dir, "documents").select("doc_id", tx.word_hits(t, tb.GLAD).alias("positive"), tx.word_hits(t, tb.SORRY).alias("negative"))


T14_SQL = "SELECT doc_id, contains(text, 'the')::INT + contains(text, 'der')::INT AS positive, contains(text, 'les')::INT AS negative FROM documents"

_C = f"""c AS (SELECT source AS thread, doc_id AS idx, text, {tb.NORM_SQL} AS norm FROM documents)"""


def a1_thread_rates(spark, sf_dir):
    out = cm.base_rates(tb.comments(spark, sf_dir), **WORDS)
    return out.select("thread", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


A1_BODY = r"""SELECT thread, count(*) AS n,
  1 - count(DISTINCT nullif(norm, '')) / count(nullif(norm, '')) AS dup_exact_rate, avg((length(norm) <= 15)::INT) AS short_rate,
  avg((NOT regexp_matches(text, '[0-9]'))::INT) AS no_detail_rate,
  avg(((contains(text, 'the') OR contains(text, 'der')) AND NOT contains(text, 'les'))::INT) AS positive_uniformity FROM c GROUP BY thread"""
A1_SQL = f"""WITH {_C}, b AS ({A1_BODY})
SELECT thread, n, round(dup_exact_rate, 6) AS dup_exact_rate, round(short_rate, 6) AS short_rate, round(no_detail_rate, 6) AS no_detail_rate, round(positive_uniformity, 6) AS positive_uniformity FROM b"""


def a2_near_pairs(spark, sf_dir):
    return cm.near_pairs(tb.comments(spark, sf_dir)).withColumn("near_dup_rate", F.round("near_dup_rate", 6))


# sets whose sizes differ too much can't be near, so these aren't intersected
A2_BODY = """
  SELECT thread, count(*) AS pairs, count(*) FILTER (WHERE j >= 0.75) AS near_pairs FROM (
    SELECT a.thread, CASE WHEN least(len(a.g), len(b.g)) >= 0.75 * greatest(len(a.g), len(b.g)) THEN [k / (len(a.g) + len(b.g) - k) for k in [len(list_intersect(a.g, b.g))]][1] ELSE 0 END AS j
    FROM g a JOIN g b ON a.thread = b.thread AND a.r < b.r) GROUP BY thread"""
A2_G = f"""r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY thread) AS n FROM c),
g AS (SELECT thread, r, {tb.GRAMS_SQL} AS g FROM r WHERE n <= 120 OR r % (n // 120 + 1) = 0)"""
A2_SQL = f"WITH {_C}, {A2_G}, p AS ({A2_BODY}) SELECT *, round(near_pairs / pairs, 6) AS near_dup_rate FROM p"


def a3_template_share(spark, sf_dir):
    return cm.template_share(tb.comments(spark, sf_dir)).withColumn("template_concentration", F.round("template_concentration", 6))


A3_BODY = f"""SELECT thread, max(k) / any_value(n) AS template_concentration FROM (
  SELECT thread, g, count(*) AS k FROM (SELECT thread, unnest({tb.GRAMS_SQL}) AS g FROM c) GROUP BY ALL) JOIN (SELECT thread, count(*) AS n FROM c GROUP BY thread) USING (thread) GROUP BY thread"""
A3_SQL = f"WITH {_C}, t AS ({A3_BODY}) SELECT thread, round(template_concentration, 6) AS template_concentration FROM t"


def a4_burstiness(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("ts").cast("timestamp").cast("long").alias("ts"))
    return cm.burstiness(e).withColumn("burstiness", F.round("burstiness", 6))


A4_SQL = """
WITH g AS (SELECT user_id AS thread, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events))
SELECT thread, round(CASE WHEN count(*) >= 3 AND avg(gap) > 0 THEN greatest(0, least(1, 1 - stddev_pop(gap) / avg(gap))) END, 6) AS burstiness FROM g GROUP BY thread"""


def a5_cross_posts(spark, sf_dir):
    return cm.cross_posts(tb.comments(spark, sf_dir)).withColumn("cross_post_repeat_ratio", F.round("cross_post_repeat_ratio", 6))


A5_BODY = """SELECT thread, max(posts) AS cross_post_repeat_max, avg((posts >= 3)::INT) AS cross_post_repeat_ratio
  FROM c JOIN (SELECT norm, count(DISTINCT thread) AS posts FROM c GROUP BY norm) USING (norm) GROUP BY thread"""
A5_SQL = f"WITH {_C}, x AS ({A5_BODY}) SELECT thread, cross_post_repeat_max, round(cross_post_repeat_ratio, 6) AS cross_post_repeat_ratio FROM x"


def a6_thread_verdicts(spark, sf_dir):
    out = cm.thread_verdicts(cm.thread_features(tb.comments(spark, sf_dir), **WORDS))
    return out.withColumn("score", F.round("score", 6))


A6_SQL = f"""
WITH {_C}, {A2_G}, b AS ({A1_BODY}), p AS ({A2_BODY}), t AS ({A3_BODY}), x AS ({A5_BODY}),
f AS (SELECT thread, n, round(dup_exact_rate, 4) AS d, round(near_pairs / pairs, 4) AS e, round(short_rate, 4) AS s, round(no_detail_rate, 4) AS z,
             round(positive_uniformity, 4) AS u, round(template_concentration, 4) AS t, cross_post_repeat_max >= 3 AS m FROM b JOIN p USING (thread) JOIN t USING (thread) JOIN x USING (thread)),
q AS (SELECT *, (d + 1.2 * e + 0.6 * s + z + 0.9 * u + 0.8 * t) / 5.5 AS raw,
             [k for k in [CASE WHEN d >= 0.3 THEN 'dup_exact_rate' END, CASE WHEN e >= 0.3 THEN 'near_dup_rate' END, CASE WHEN z >= 0.85 THEN 'no_detail_rate' END,
                          CASE WHEN u >= 0.9 THEN 'positive_uniformity' END, CASE WHEN t >= 0.5 THEN 'template_concentration' END] if k IS NOT NULL] AS f FROM f),
v AS (SELECT *, CASE WHEN m THEN least(1, raw + 0.25) ELSE raw END AS score FROM q)
SELECT thread, n, round(score, 6) AS score, len(f) AS n_strong, array_to_string(f, ',') AS fired, m AS matrix_anomaly,
       CASE WHEN m OR len(f) >= 4 THEN 'high_risk' WHEN len(f) >= 3 OR score >= 0.45 THEN 'suspicious' ELSE 'credible' END AS verdict FROM v"""


def a7_accounts(spark, sf_dir):
    d = tb.table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("account"), F.col("turn").alias("idx"), "text", (F.col("turn") * F.col("turn") * 60 + F.col("conv_id") % 7 * F.col("turn")).alias("ts"))
    out = cm.account_profiles(d, positive=tb.GLAD)
    return out.select("account", "post_count", *(F.round(c, 6).alias(c) for c in ("text_reuse_rate", "publish_regularity", "mean_length", "length_cv", "mean_positive_hits")), "n_flags", "verdict")


A7_SQL = f"""
WITH c AS (SELECT conv_id || ':' || role AS account, turn AS idx, {tb.NORM_SQL} AS norm, turn * turn * 60 + conv_id % 7 * turn AS ts FROM conversations WHERE length(text) > 0),
g AS (SELECT account, idx, {tb.GRAMS_SQL} AS g FROM c),
p AS (SELECT a.account, avg(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))) AS reuse FROM g a JOIN g b ON a.account = b.account AND a.idx < b.idx GROUP BY 1),
e AS (SELECT account, CASE WHEN count(*) >= 3 AND avg(gap) > 0 THEN greatest(0, least(1, 1 - stddev_pop(gap) / avg(gap))) END AS reg FROM (SELECT account, ts - lag(ts) OVER (PARTITION BY account ORDER BY ts) AS gap FROM c) GROUP BY 1),
s AS (SELECT account, count(*) AS n, avg(length(norm)) AS ml, CASE WHEN count(*) > 1 THEN stddev_pop(length(norm)) / avg(length(norm)) END AS cv, avg(contains(norm, 'the')::INT + contains(norm, 'der')::INT) AS mp FROM c GROUP BY 1),
j AS (SELECT *, coalesce(reuse >= 0.5, false)::INT + coalesce(reg >= 0.7, false)::INT + (mp >= 3)::INT AS k FROM s LEFT JOIN p USING (account) LEFT JOIN e USING (account))
SELECT account, n AS post_count, round(reuse, 6) AS text_reuse_rate, round(reg, 6) AS publish_regularity, round(ml, 6) AS mean_length, round(cv, 6) AS length_cv, round(mp, 6) AS mean_positive_hits,
       CASE WHEN n >= 2 THEN k END AS n_flags, CASE WHEN n < 2 THEN 'inconclusive' WHEN k > 0 THEN 'suspicious' ELSE 'credible' END AS verdict FROM j"""


def a8_matrix(spark, sf_dir):
    d = tb.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("idx"), "text", F.when(F.col("conv_id") % 3 == 0, F.col("role")).when(F.col("conv_id") % 3 == 1, F.lit("me")).alias("handle"))
    return cm.content_matrix(d).withColumn("reuse", F.round("reuse", 6))


A8_SQL = r"""
WITH c AS (SELECT conv_id AS batch, turn AS idx, regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g') AS norm, CASE conv_id % 3 WHEN 0 THEN role WHEN 1 THEN 'me' END AS handle FROM conversations),
g AS (SELECT batch, idx, CASE WHEN norm = '' THEN [] WHEN length(norm) < 4 THEN [norm] ELSE list_distinct([substring(norm, i, 4) for i in range(1, length(norm) - 2)]) END AS g FROM c),
p AS (SELECT a.batch, avg(CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) ELSE 0 END) AS reuse FROM g a JOIN g b ON a.batch = b.batch AND a.idx < b.idx GROUP BY 1),
s AS (SELECT batch, count(*) AS n, count(DISTINCT handle) AS h FROM c GROUP BY 1),
j AS (SELECT *, (h > 1)::INT + (coalesce(reuse, 0) >= 0.5)::INT + (h = 0)::INT AS k FROM s LEFT JOIN p USING (batch))
SELECT batch, n AS content_count, h AS handles, round(reuse, 6) AS reuse, CASE WHEN n >= 2 THEN k END AS n_flags, CASE WHEN n < 2 THEN 'inconclusive' WHEN k > 0 THEN 'suspicious' ELSE 'credible' END AS verdict FROM j"""


def a34_directions(spark, sf_dir):
    got = cm.thread_verdicts(cm.base_rates(tb.comments(spark, sf_dir), **WORDS).withColumns({k: F.lit(0.0) for k in ("near_dup_rate", "template_concentration", "burstiness")} | {"cross_post_repeat_max": F.lit(1)}))
    expected = F.when(F.col("n") % 2 == 0, "credible").otherwise("suspicious")
    return cm.direction_hits(got.select(expected.alias("expected"), F.col("verdict").alias("got")))


A34_SQL = f"""
WITH {_C}, b AS ({A1_BODY}),
v AS (SELECT *, (dup_exact_rate >= 0.3)::INT + (no_detail_rate >= 0.85)::INT + (positive_uniformity >= 0.9)::INT AS f,
             (round(dup_exact_rate, 4) + 0.6 * round(short_rate, 4) + round(no_detail_rate, 4) + 0.9 * round(positive_uniformity, 4)) / 6.2 AS score FROM b),
k AS (SELECT CASE WHEN n % 2 = 0 THEN 'credible' ELSE 'suspicious' END AS expected, CASE WHEN n < 5 THEN 'inconclusive' WHEN f >= 3 OR score >= 0.45 THEN 'suspicious' ELSE 'credible' END AS got FROM v)
SELECT count(*) AS cases, count(*) FILTER (expected = got) AS exact, count(*) FILTER ((expected = 'credible') = (got IN ('credible', 'inconclusive'))) AS direction,
       avg(((expected = 'credible') = (got IN ('credible', 'inconclusive')))::INT)::DOUBLE AS direction_rate FROM k"""


QUERIES = {
    "t5_style": (t5_style, T5_SQL), "t6_flood": (t6_flood, T6_SQL), "t11_normalize": (t11_normalize, T11_SQL), "t12_grams": (t12_grams, T12_SQL),
    "t13_detail": (t13_detail, T13_SQL), "t14_sentiment": (t14_sentiment, T14_SQL), "a1_thread_rates": (a1_thread_rates, A1_SQL), "a2_near_pairs": (a2_near_pairs, A2_SQL),
    "a3_template_share": (a3_template_share, A3_SQL), "a4_burstiness": (a4_burstiness, A4_SQL), "a5_cross_posts": (a5_cross_posts, A5_SQL), "a6_thread_verdicts": (a6_thread_verdicts, A6_SQL),
    "a7_accounts": (a7_accounts, A7_SQL), "a8_matrix": (a8_matrix, A8_SQL), "a34_directions": (a34_directions, A34_SQL),
}
