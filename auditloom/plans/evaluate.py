"""Evaluation queries: A10 to A35."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..sources.io import smaller_tasks
from . import tables as tb

S = f"WITH {tb.SCORES_SQL}"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _wilson_sql(k: str, n: str, low: str, high: str) -> str:
    mid, half = f"({k} / {n} + 1.959964 * 1.959964 / (2 * {n}))", f"1.959964 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.959964 * 1.959964 / (4 * {n} * {n}))"
    scale = f"(1 + 1.959964 * 1.959964 / {n})"
    return (f"round(CASE WHEN {n} > 0 THEN greatest(0, {mid} / {scale} - {half} / {scale}) END, 6) AS {low}, "
            f"round(CASE WHEN {n} > 0 THEN least(1, {mid} / {scale} + {half} / {scale}) END, 6) AS {high}")


def _rates_sql(*names: str) -> str:
    return ", ".join(f"round({k}_count / nullif({k}_n, 0), 6) AS {k}_rate, " + _wilson_sql(f"{k}_count", f"{k}_n", f"{k}_low", f"{k}_high") for k in names)


def a10_wilson(spark, sf_dir):
    s = tb.scores(spark, sf_dir).groupBy("grp").agg(F.count("score").alias("n"), F.count_if(F.col("score") >= 0.9).alias("count"))
    return rounded(ev.rates(s, {"high": ("count", "n")}))


A10_SQL = f"""{S}, g AS (SELECT grp, count(score) AS n, count(*) FILTER (score >= 0.9) AS count FROM score GROUP BY grp)
SELECT grp, n, count, round(count / nullif(n, 0), 6) AS high_rate, {_wilson_sql('count', 'n', 'high_low', 'high_high')} FROM g"""


def _origin_sql(keys: str = "", rows: str = "score", low: float = 0.3, high: float = 0.7, by: str | None = None) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""by_group AS (SELECT {k}grp, count(*) FILTER (kind = 'real') AS reals, count(*) FILTER (kind = 'real' AND score IS NULL) AS rm, max(score) FILTER (kind = 'real') AS rt,
  count(*) FILTER (kind = 'generated') AS fakes, count(*) FILTER (kind = 'generated' AND score IS NULL) AS fm, min(score) FILTER (kind = 'generated') AS fl,
  count(*) FILTER (score IS NULL OR (score >= {low} AND score < {high})) AS un FROM {rows} GROUP BY {k}grp),
origin AS (SELECT {k}count(*) FILTER (reals > 0 AND rm = 0) AS fp_n, count(*) FILTER (reals > 0 AND rm = 0 AND rt >= {high}) AS fp_count,
  count(*) FILTER (fakes > 0 AND fm = 0) AS recall_n, count(*) FILTER (fakes > 0 AND fm = 0 AND fl >= {high}) AS recall_count,
  count(*) AS uncertain_n, count(*) FILTER (un > 0) AS uncertain_count, sum(rm)::BIGINT AS missing_real, sum(fm)::BIGINT AS missing_generated FROM by_group {group})"""


#: Groups of a few rows, so that some are complete.
SMALL = "(SELECT file, file // 8 AS grp, kind, tag, generator, score, spectral, set, qty FROM score)"


def _small(spark, sf_dir):
    return tb.scores(spark, sf_dir).withColumn("grp", F.floor(F.col("file") / 8))


_O = "fp_n, fp_count, recall_n, recall_count, uncertain_n, uncertain_count, missing_real, missing_generated, " + _rates_sql("fp", "recall", "uncertain")


def a11_origin_report(spark, sf_dir):
    return rounded(ev.origin_report(_small(spark, sf_dir), 0.3, 0.7))


A11_SQL = f"{S}, {_origin_sql(rows=SMALL)} SELECT {_O} FROM origin"


def a12_origin_by_tag(spark, sf_dir):
    s = _small(spark, sf_dir).withColumn("slice", F.explode(F.array(F.concat(F.lit("tag:"), "tag"), F.concat(F.lit("generator:"), F.col("generator").cast("string")))))
    return rounded(ev.origin_report(s, 0.3, 0.7, ["slice"]))


A12_SQL = f"""{S}, sliced AS (SELECT *, unnest(['tag:' || tag, 'generator:' || generator]) AS slice FROM {SMALL}), {_origin_sql('slice', 'sliced')} SELECT slice, {_O} FROM origin"""


def _claims(spark, sf_dir):
    """Expected and predicted claims of orders' lines, with all fields and nulls and empty lists among them."""
    c = tb.captions(spark, sf_dir)
    line, days = F.col("line"), F.col("days")
    base = c.select(
        F.col("asset").alias("case"), line.cast("string").alias("quote"), F.lit("copy").alias("source"), F.concat(F.lit("P"), F.col("part").cast("string")).alias("product"), F.when(line % 2 == 0, "v1").alias("product_version"), F.lit("moist").alias("metric"), F.lit("%").alias("unit"),
        days.alias("duration_days"), F.when(line == 3, "red").alias("variant"), F.lit(None).cast("string").alias("population"), F.when(line % 3 == 0, F.array(F.lit("dry"), F.lit("cold"))).otherwise(F.array().cast("array<string>")).alias("conditions"), "value", "image_value", "kind")
    expected = base.drop("image_value", "kind")
    predicted = base.filter("image_value is not null").withColumns({"value": F.col("image_value"), "variant": F.when(F.col("kind") > 0, F.col("variant"))}).drop("image_value", "kind")
    return expected, predicted


def _supported(spark, sf_dir):
    """Claims called supported, and their references with each fault in turn."""
    c = tb.captions(spark, sf_dir)
    key = F.col("asset") + F.col("line")
    claims = c.select(F.col("asset").alias("case"), F.col("line").alias("claim"), F.when(key % 3 > 0, "supported").otherwise("insufficient").alias("status"), F.when(key % 29 > 0, "CN").otherwise("").alias("market"), F.when(key % 5 > 0, "v1").alias("product_version"))
    at = lambda n, bad, good: F.when(key % 11 == n, bad).otherwise(good)
    refs = c.select(
        F.col("asset").alias("case"), F.col("line").alias("claim"), at(1, "brand", "reviewer_verified").alias("verification"), at(2, "advert", "efficacy_study").alias("source_type"), at(3, "", "lab").alias("source"), at(4, F.lit(None), "p. 1").alias("locator"),
        at(5, F.lit(None), key % 7 > 0).alias("matches"), at(6, "US", F.when(key % 29 > 0, "CN").otherwise("")).alias("market"), at(7, "v2", "v1").alias("product_version"))
    return claims, refs


def a13_field_f1(spark, sf_dir):
    n = ev.unsupported_claims(*_supported(spark, sf_dir)).agg(F.count("*").alias("unsupported"))
    return rounded(ev.field_f1(*_claims(spark, sf_dir)).join(F.broadcast(n)))


A13_CTE = """k13 AS (SELECT asset, line, 'copy' AS source, line::VARCHAR AS quote, 'P' || part AS product, CASE WHEN line % 2 = 0 THEN 'v1' END AS product_version, 'moist' AS metric, value::VARCHAR AS value, image_value::VARCHAR AS image_value, '%' AS unit, days::VARCHAR AS days,
  CASE WHEN line = 3 THEN 'red' END AS variant, CASE WHEN line = 3 AND kind > 0 THEN 'red' END AS seen_variant, CASE WHEN line % 3 = 0 THEN '["dry","cold"]' END AS conditions FROM caption),
x13 AS (SELECT DISTINCT asset, quote, unnest(['source', 'quote', 'product', 'product_version', 'metric', 'value', 'unit', 'duration_days', 'variant', 'conditions']) AS f, unnest([source, quote, product, product_version, metric, value, unit, days, variant, conditions]) AS v FROM k13),
y13 AS (SELECT DISTINCT asset, quote, unnest(['source', 'quote', 'product', 'product_version', 'metric', 'value', 'unit', 'duration_days', 'variant', 'conditions']) AS f, unnest([source, quote, product, product_version, metric, image_value, unit, days, seen_variant, conditions]) AS v FROM k13 WHERE image_value IS NOT NULL),
m13 AS (SELECT (SELECT count(v) FROM x13) AS labels, (SELECT count(v) FROM y13) AS predicted, (SELECT count(*) FROM x13 JOIN y13 USING (asset, quote, f, v)) AS matched),
u13 AS (SELECT count(*) AS unsupported FROM (SELECT asset + line AS k FROM caption) WHERE k % 3 > 0 AND NOT (k % 11 NOT IN (1, 2, 3, 4, 5, 6, 7) AND k % 7 > 0 AND k % 29 > 0 AND k % 5 > 0))"""
A13_SQL = f"WITH {tb.CAPTIONS_SQL}, {A13_CTE} SELECT labels, predicted, matched, round(2 * matched / nullif(labels + predicted, 0), 6) AS f1, unsupported FROM m13, u13"


def _pairs(spark, sf_dir):
    s = tb.scores(spark, sf_dir)
    return s.select(F.col("set"), (F.col("qty") % 3 == 0).alias("truth"), (F.coalesce(F.col("score"), F.lit(0.0)) >= 0.6).alias("found"), F.col("score").isNull().alias("unavailable"))


def a14_pair_rates(spark, sf_dir):
    return rounded(ev.pair_rates(_pairs(spark, sf_dir), ["set"]))


A14_CTE = """p AS (SELECT set, qty % 3 = 0 AS truth, coalesce(score, 0) >= 0.6 AS found, score IS NULL AS unavailable FROM score),
r AS (SELECT set, count(*) AS cases, count(*) FILTER (found) AS precision_n, count(*) FILTER (truth AND found) AS precision_count, count(*) FILTER (truth) AS recall_n, count(*) FILTER (unavailable) AS unavailable, count(*) FILTER (truth AND found) AS recall_count FROM p GROUP BY set)"""
A14_SQL = f"{S}, {A14_CTE} SELECT set, cases, precision_n, precision_count, recall_n, recall_count, unavailable, {_rates_sql('precision', 'recall')} FROM r"


def _edits(spark, sf_dir):
    """Edited and clean images rendered from embeddings: 8 x 8 masks, and scores, masks and identities that are missing for some."""
    e, k = tb.table(spark, sf_dir, "embeddings"), F.col("vec_id")

    def mask(cells):
        return F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), ev.packed(cells).alias("bits"))

    grid = mask(F.transform("embedding", lambda x: x > 0))
    other = mask(F.transform("embedding", lambda x, i: (x + F.when(i % 3 == 0, 0.2).otherwise(-0.05)) > 0.05))
    score = F.when(k % 31 > 0, F.when(k % 4 == 0, k * 7919 % 1000 / 1800).otherwise(0.4 + k * 7919 % 1000 / 1000))
    return e.select(
        k.alias("id"), (k % 97).alias("grp"), F.when(k % 4 == 0, "real").otherwise("edited").alias("kind"), score.alias("score"), F.when(k % 5 == 0, "m2").otherwise("m1").alias("model"), F.when(k % 23 > 0, "w").otherwise("").alias("weights"), F.when(k % 19 > 0, "p").alias("preprocessing"),
        F.when(k % 4 > 0, grid).alias("truth"), F.when(k % 13 > 0, other).alias("predicted"))


EDITS_SQL = """edit AS (
  SELECT vec_id AS k, vec_id % 97 AS grp, CASE WHEN vec_id % 31 > 0 THEN CASE WHEN vec_id % 4 = 0 THEN vec_id * 7919 % 1000 / 1800 ELSE 0.4::DOUBLE + vec_id * 7919 % 1000 / 1000 END END AS score, vec_id % 23 > 0 AND vec_id % 19 > 0 AS tracked, vec_id % 5 = 0 AS m2,
         [x > 0 for x in embedding] AS a, [(x::DOUBLE + CASE WHEN (i - 1) % 3 = 0 THEN 0.2 ELSE -0.05 END) > 0.05 for x, i in embedding] AS b FROM embeddings),
mask AS (SELECT grp, coalesce(score >= 0.5, false) AS found, k % 13 > 0 AS there, len([i for i in range(1, len(a) + 1) if a[i] AND b[i]]) / nullif(len([i for i in range(1, len(a) + 1) if a[i] OR b[i]]), 0) AS iou FROM edit WHERE k % 4 > 0),
bygrp AS (SELECT grp, count(*) AS masks, avg(CASE WHEN found AND there THEN iou ELSE 0 END) AS mean_iou, count(*) FILTER (found AND NOT there) AS missing_masks FROM mask GROUP BY grp),
local AS (
  SELECT (SELECT count(*) FROM bygrp) AS mask_groups, (SELECT avg(mean_iou) FROM bygrp) AS mean_iou, (SELECT coalesce(sum(missing_masks), 0)::BIGINT FROM bygrp) AS missing_masks, count(*) FILTER (score IS NULL) AS missing_scores, count(*) FILTER (score IS NOT NULL AND NOT tracked) AS untracked_scores,
         count(DISTINCT CASE WHEN score IS NOT NULL AND tracked THEN m2 END) AS models, (SELECT count(*) FROM (SELECT grp FROM edit WHERE k % 4 = 0 AND score IS NOT NULL GROUP BY grp)) AS clean_n,
         (SELECT count(*) FROM (SELECT grp FROM edit WHERE k % 4 = 0 AND score IS NOT NULL GROUP BY grp HAVING max(score) >= 0.5)) AS clean_count FROM edit)"""


def a15_mask_iou(spark, sf_dir):
    return rounded(ev.localized(_edits(spark, sf_dir)))


A15_SQL = f"WITH {EDITS_SQL} SELECT grp, masks, round(mean_iou, 6) AS mean_iou, missing_masks FROM bygrp"


def a15_localization(spark, sf_dir):
    return rounded(ev.localization(_edits(spark, sf_dir)))


A15L_SQL = f"WITH {EDITS_SQL} SELECT mask_groups, round(mean_iou, 6) AS mean_iou, missing_masks, missing_scores, untracked_scores, models, clean_n, clean_count, {_rates_sql('clean')} FROM local"


def a15_bootstrap(spark, sf_dir):
    return rounded(ev.bootstrap_interval(ev.localized(_edits(spark, sf_dir)).select("grp", F.col("mean_iou").alias("mean"))))


def _context(spark, sf_dir):
    return _pairs(spark, sf_dir).filter("set = 1").drop("set")


def _release(spark, sf_dir):
    s = _small(spark, sf_dir)
    origin = ev.origin_report(s, 0.3, 0.7)
    families = ev.origin_report(s.filter("kind = 'generated'"), 0.3, 0.7, ["generator"])
    n = ev.unsupported_claims(*_supported(spark, sf_dir)).agg(F.count("*").alias("unsupported"))
    claims = ev.field_f1(*_claims(spark, sf_dir)).join(F.broadcast(n))
    edits, absent = _edits(spark, sf_dir), F.count_if(F.col("score").isNull())
    tools = s.agg(absent.alias("origin_tool")).join(F.broadcast(edits.agg(absent.alias("editing_tool"))))
    return origin, families, ev.localization(edits), claims, ev.pair_rates(_pairs(spark, sf_dir)), ev.pair_rates(_context(spark, sf_dir)), tools


def a16_release_checks(spark, sf_dir):
    return ev.release_checks(*_release(spark, sf_dir))


A16_SQL = f"""{S}, {tb.CAPTIONS_SQL}, {_origin_sql(rows=SMALL)}, {EDITS_SQL}, {A13_CTE},
fam AS (SELECT generator, count(*) FILTER (m = 0) AS rn, count(*) FILTER (m = 0 AND l >= 0.7) AS rc FROM (SELECT generator, grp, count(*) FILTER (score IS NULL) AS m, min(score) AS l FROM {SMALL} WHERE kind = 'generated' GROUP BY ALL) GROUP BY generator),
f AS (SELECT count(*) AS families, count(*) FILTER (rn >= 50 AND rc / rn >= 0.7) AS good FROM fam),
x AS (SELECT count(*) AS cases, count(*) FILTER (found) AS pn, count(*) FILTER (truth AND found) AS k, count(*) FILTER (truth) AS rn FROM (SELECT qty % 3 = 0 AS truth, coalesce(score, 0) >= 0.6 AS found FROM score)),
t AS (SELECT count(*) AS cases, count(*) FILTER (found) AS tp, count(*) FILTER (truth AND found) AS tk, count(*) FILTER (truth) AS tr, count(*) FILTER (score IS NULL) AS absent FROM (SELECT score, qty % 3 = 0 AS truth, coalesce(score, 0) >= 0.6 AS found FROM score WHERE set = 1))
SELECT coalesce(fp_n >= 100 AND recall_n >= 100 AND families >= 2 AND good = families AND fp_count / fp_n <= 0.05 AND recall_count / recall_n >= 0.8 AND uncertain_count / uncertain_n <= 0.25 AND missing_real = 0 AND missing_generated = 0 AND (SELECT count(*) FROM score WHERE score IS NULL) = 0, false) AS origin,
  coalesce(mask_groups >= 60 AND clean_n >= 100 AND mean_iou >= 0.4 AND clean_count / clean_n <= 0.1 AND missing_scores = 0 AND missing_masks = 0 AND untracked_scores = 0 AND models = 1, false) AS editing,
  coalesce(x.cases >= 120 AND 2 * matched / (labels + predicted) >= 0.85 AND unsupported = 0, false) AS claims,
  coalesce(x.cases >= 120 AND k / pn >= 0.9 AND k / rn >= 0.8, false) AS crossmodal,
  coalesce(t.cases >= 60 AND tk / tp >= 0.9 AND tk / tr >= 0.8 AND absent = 0, false) AS context
FROM origin, f, local, m13, u13, x, t"""


def a17_calibration(spark, sf_dir):
    # a score that separates the kinds with some overlap, so that thresholds exist
    s = tb.scores(spark, sf_dir).filter("score is not null").withColumn("score", F.when(F.col("kind") == "real", F.col("score") * 0.55).otherwise(0.5 + F.col("score") * 0.5)).withColumn("score", F.round("score", 4))
    return rounded(ev.calibrated(s.withColumn("grp", F.floor(F.col("file") / 8)).withColumns({"model": F.lit("m"), "weights": F.lit("w"), "preprocessing": F.lit("p")})))


A17_SQL = f"""{S}, s AS (SELECT file // 8 AS grp, kind, round(CASE WHEN kind = 'real' THEN score * 0.55 ELSE 0.5 + score * 0.5 END, 4) AS score FROM score WHERE score IS NOT NULL),
cand AS (SELECT DISTINCT score AS t FROM s UNION SELECT 0.0 UNION SELECT 1.0),
r AS (SELECT grp, max(score) AS top FROM s WHERE kind = 'real' GROUP BY grp), g AS (SELECT grp, min(score) AS least FROM s WHERE kind = 'generated' GROUP BY grp),
m AS (SELECT t, (SELECT count(*) FROM r WHERE top >= t) / (SELECT count(*) FROM r) AS fp_rate, (SELECT count(*) FROM g WHERE least >= t) / (SELECT count(*) FROM g) AS recall FROM cand),
b AS (SELECT t AS high, fp_rate, recall FROM m WHERE fp_rate <= 0.05 AND recall >= 0.8 ORDER BY recall DESC, fp_rate, t DESC LIMIT 1),
near AS (SELECT grp, max(score) FILTER (score < high) AS near FROM s, b GROUP BY grp),
l AS (SELECT min(t) AS low FROM cand, b WHERE t <= high AND (SELECT count(*) FROM near WHERE near >= t) <= 0.25 * (SELECT count(*) FROM near))
SELECT 'm' AS model, 'w' AS weights, 'p' AS preprocessing, round(low, 6) AS low, round(high, 6) AS high, round(fp_rate, 6) AS fp_rate, round(recall, 6) AS recall, false AS approved FROM b, l"""


def a18_sweep(spark, sf_dir):
    return rounded(ev.sweep(tb.scores(spark, sf_dir)))


A18_BODY = """g AS (SELECT unnest(range(101)) AS g), n AS (SELECT count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS a FROM score WHERE score IS NOT NULL),
h AS (SELECT g, count(*) FILTER (kind = 'real') AS real_fp, count(*) FILTER (kind = 'generated') AS ai_hit FROM g LEFT JOIN score ON floor(score * 100 + 1e-9) >= g GROUP BY g),
w AS (SELECT g / 100 AS threshold, real_fp, ai_hit, real_fp / r AS fp_rate, ai_hit / a AS recall FROM h, n),
z AS (SELECT fp_rate AS bf, recall AS br FROM w WHERE threshold = 0.9),
sw AS (SELECT threshold, real_fp, ai_hit, round(fp_rate, 6) AS fp_rate, round(recall, 6) AS recall, recall > br AND fp_rate <= bf AS better_recall, fp_rate < bf AND recall >= br AS better_fp, recall <= br AND fp_rate >= bf AS dominated FROM w, z)"""
A18_SQL = f"{S}, {A18_BODY} SELECT * FROM sw"


def a18_sweep_verdict(spark, sf_dir):
    return ev.sweep_verdict(ev.sweep(tb.scores(spark, sf_dir)))


A18V_SQL = f"""{S}, {A18_BODY} SELECT count(*) FILTER (better_recall) AS better_recall_points, count(*) FILTER (better_fp) AS better_fp_points, min(threshold) FILTER (better_fp) AS band_low, max(threshold) FILTER (better_fp) AS band_high,
  CASE WHEN count(*) FILTER (better_recall) > 0 THEN 'ADOPT_RECALL' WHEN count(*) FILTER (better_fp) > 0 THEN 'FOUND_BUT_FRAGILE' ELSE 'NO_IMPROVEMENT' END AS verdict FROM sw"""


def a19_auc(spark, sf_dir):
    s = tb.scores(spark, sf_dir).select("set", (F.col("kind") == "generated").alias("positive"), "score")
    return rounded(ev.auc(s, ["set"]))


A19_SQL = f"""{S}, s AS (SELECT set, score, kind = 'generated' AS p FROM score WHERE score IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY set ORDER BY score) + (count(*) OVER (PARTITION BY set, score) - 1) / 2 AS r FROM s)
SELECT set, round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auc FROM k GROUP BY set"""


def a20_policies(spark, sf_dir):
    return rounded(ev.compare_policies(tb.scores(spark, sf_dir)))


A20_SQL = f"""{S}, v AS (
  SELECT kind, 'detector' AS policy, 0 AS i, CASE WHEN score >= 0.99 THEN 2 WHEN score >= 0.9 THEN 1 ELSE 0 END AS v FROM score UNION ALL
  SELECT kind, 'spectral', 1, CASE WHEN spectral >= 0.8 THEN 2 WHEN spectral >= 0.6 THEN 1 ELSE 0 END FROM score UNION ALL
  SELECT kind, 'cascade', 2, CASE WHEN score >= 0.99 OR (score >= 0.9 AND spectral >= 0.8) THEN 2 WHEN score >= 0.9 OR spectral >= 0.6 THEN 1 ELSE 0 END FROM score),
p AS (SELECT policy, i, count(*) FILTER (kind = 'generated') AS n_ai, count(*) FILTER (kind = 'real') AS n_real, count(*) FILTER (kind = 'generated' AND v = 2) AS ai_takedown, count(*) FILTER (kind = 'generated' AND v > 0) AS ai_captured,
  count(*) FILTER (kind = 'real' AND v = 2) AS real_takedown, count(*) FILTER (kind = 'real' AND v > 0) AS real_flagged FROM v GROUP BY ALL),
q AS (SELECT *, ai_captured / n_ai AS c, real_takedown / n_real AS f FROM p)
SELECT policy, n_ai, n_real, ai_takedown, ai_captured, real_takedown, real_flagged, round(c, 6) AS capture_rate, round(f, 6) AS fp_rate, round(c - first_value(c) OVER (ORDER BY i), 6) AS delta_capture, round(f - first_value(f) OVER (ORDER BY i), 6) AS delta_fp FROM q"""


def a21_ablation(spark, sf_dir):
    s = tb.scores(spark, sf_dir).withColumn("ela", F.col("qty") / 10.0)
    return rounded(ev.ablation(s))


A21_SQL = f"""{S}, e AS (SELECT *, qty / 10 >= 2 AS ela FROM score), t AS (
  SELECT kind, 'T0' AS tier, 0 AS v FROM e UNION ALL SELECT kind, 'T1', ela::INT FROM e UNION ALL
  SELECT kind, 'T2', CASE WHEN score >= 0.99 THEN 2 WHEN score >= 0.9 OR ela THEN 1 ELSE 0 END FROM e UNION ALL
  SELECT kind, 'T3', CASE WHEN score >= 0.99 OR (score >= 0.9 AND spectral >= 0.8) THEN 2 ELSE 1 END FROM e),
k AS (SELECT kind, rank() OVER (ORDER BY spectral) + (count(*) OVER (PARTITION BY spectral) - 1) / 2 AS r FROM score),
a AS (SELECT round((sum(r) FILTER (kind = 'generated') - count(*) FILTER (kind = 'generated') * (count(*) FILTER (kind = 'generated') + 1) / 2) / (count(*) FILTER (kind = 'generated') * count(*) FILTER (kind = 'real')), 6) AS auc FROM k)
SELECT tier, count(*) FILTER (kind = 'generated' AND v > 0) AS ai_capture, count(*) FILTER (kind = 'generated' AND v = 2) AS ai_takedown, count(*) FILTER (kind = 'real' AND v > 0) AS real_flagged, count(*) FILTER (kind = 'real' AND v = 2) AS real_takedown,
  CASE WHEN tier = 'T3' THEN any_value(auc) END AS score_auc FROM t, a GROUP BY tier"""


def a22_band_policy(spark, sf_dir):
    return ev.band_policy(tb.scores(spark, sf_dir))


A22_BODY = """b AS (SELECT set, kind, count(*) AS n, count(*) FILTER (score >= 0.9) AS old_high_risk, count(*) FILTER (score >= 0.99) AS new_high_risk, count(*) FILTER (score >= 0.9 AND score < 0.99) AS new_suspicious,
  count(DISTINCT score) FILTER (score >= 0.9 AND score < 0.99) AS gray_scores, min(score) FILTER (score >= 0.9 AND score < 0.99) AS gray_low, max(score) FILTER (score >= 0.9 AND score < 0.99) AS gray_high FROM score GROUP BY ALL)"""
A22_SQL = f"{S}, {A22_BODY} SELECT * FROM b"


def a22_band_adoption(spark, sf_dir):
    return ev.band_adoption(ev.band_policy(tb.scores(spark, sf_dir)))


A22V_SQL = f"""{S}, {A22_BODY}, t AS (SELECT sum(old_high_risk) FILTER (kind = 'real')::BIGINT AS real_old, sum(new_high_risk) FILTER (kind = 'real')::BIGINT AS real_new, sum(new_suspicious) FILTER (kind = 'real')::BIGINT AS real_review,
  sum(old_high_risk) FILTER (kind = 'generated')::BIGINT AS ai_old, sum(new_high_risk + new_suspicious) FILTER (kind = 'generated')::BIGINT AS ai_new FROM b)
SELECT *, real_new = 0 AS takedowns_gone, real_review = real_old AS all_reviewed, ai_new >= ai_old AS ai_unchanged, real_new = 0 AND real_review = real_old AND ai_new >= ai_old AS adopt FROM t"""


def a23_set_statistics(spark, sf_dir):
    return rounded(ev.set_statistics(tb.scores(spark, sf_dir)))


_STAT = """count(score) AS n, count(*) FILTER (score IS NULL) AS n_unavailable, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(min(score), 6) AS least, round(max(score), 6) AS largest,
  count(*) FILTER (score >= 0.5) AS n_ge_050, count(*) FILTER (score >= 0.6) AS n_ge_060, count(*) FILTER (score >= 0.9) AS n_ge_090, count(*) FILTER (score >= 0.99) AS n_ge_099, count(*) FILTER (score >= 0.9 AND score < 0.99) AS n_band, round(count(*) FILTER (score >= 0.9) / nullif(count(score), 0), 6) AS rate_high"""
A23_SQL = f"{S} SELECT set, kind, {_STAT} FROM score GROUP BY ALL"


def a23_misses(spark, sf_dir):
    tags = tb.table(spark, sf_dir, "nation").filter("n_nationkey < 4").select(F.col("n_nationkey").cast("long").alias("generator"), F.col("n_name").alias("style"))
    return ev.misses_by_tag(tb.scores(spark, sf_dir), tags)


A23M_SQL = f"{S} SELECT set, coalesce(n_name, 'unknown') AS style, count(*) AS misses, min(score) AS least FROM score LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 4) ON n_nationkey = generator WHERE score < 0.9 GROUP BY ALL"


def a24_promotion(spark, sf_dir):
    s = tb.scores(spark, sf_dir).select("set", "kind", F.explode(F.array(F.struct(F.lit("v4").alias("model"), F.col("score").alias("score")), F.struct(F.lit("v7").alias("model"), F.col("spectral").alias("score")))).alias("m")).select("set", "kind", "m.*")
    return rounded(ev.promotion(s, "v4", "v7"))


A24_SQL = f"""{S}, r AS (SELECT set, kind, count(*) FILTER (score >= 0.9) / count(score) AS a, count(*) FILTER (spectral >= 0.9) / count(*) AS b FROM score GROUP BY ALL)
SELECT set, kind, round(a, 6) AS base_rate, round(b, 6) AS new_rate, round(b - a, 6) AS delta, CASE WHEN kind = 'real' THEN b <= a ELSE b >= a END AS not_worse FROM r"""

LEVEL_SQL = "CASE WHEN score >= 0.9 THEN 'high_risk' WHEN score >= 0.6 THEN 'suspicious' WHEN score >= 0.3 THEN 'credible' WHEN score IS NOT NULL THEN 'inconclusive' END"


def _levels(spark, sf_dir):
    s = F.col("score")
    return tb.scores(spark, sf_dir).withColumn("level", F.when(s >= 0.9, "high_risk").when(s >= 0.6, "suspicious").when(s >= 0.3, "credible").when(s.isNotNull(), "inconclusive"))


def a25_dataset_report(spark, sf_dir):
    v = _levels(spark, sf_dir).withColumn("dataset", F.col("set").cast("string"))
    registry = spark.createDataFrame([("0", ["inconclusive", "credible"]), ("1", ["suspicious", "high_risk"]), ("2", ["high_risk"]), ("3", ["inconclusive", "credible"])], "dataset string, expect array<string>")
    return rounded(ev.dataset_report(v, registry))


A25_SQL = f"""{S}, v AS (SELECT set::VARCHAR AS dataset, {LEVEL_SQL} AS level, [['inconclusive', 'credible'], ['suspicious', 'high_risk'], ['high_risk'], ['inconclusive', 'credible']][set + 1] AS expect FROM score)
SELECT dataset, count(*) AS n_total, count(level) AS n, count(*) FILTER (list_contains(expect, level)) AS n_hit, count(*) FILTER (level = 'high_risk') AS high_risk, count(*) FILTER (level = 'suspicious') AS suspicious, count(*) FILTER (level = 'credible') AS credible, count(*) FILTER (level = 'inconclusive') AS inconclusive,
  round(count(*) FILTER (list_contains(expect, level)) / nullif(count(level), 0), 6) AS hit_rate, round(count(level) / count(*), 6) AS coverage, count(level) = count(*) AS "full" FROM v GROUP BY dataset"""


def a26_dispositions(spark, sf_dir):
    d = F.array_compact(F.array(F.when(F.col("level") == "high_risk", "queue"), F.when(F.col("level") == "suspicious", "mark"), F.when(F.col("qty") > 30, "rewrite")))
    return ev.dispositions(_levels(spark, sf_dir).withColumn("dispositions", d))


A26_SQL = f"{S}, v AS (SELECT unnest([CASE WHEN score >= 0.9 THEN 'queue' END, CASE WHEN score >= 0.6 AND score < 0.9 THEN 'mark' END, CASE WHEN qty > 30 THEN 'rewrite' END]) AS disposition FROM score) SELECT disposition, count(*) AS n FROM v WHERE disposition IS NOT NULL GROUP BY 1"


def a27_subtypes(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("copy_move", "splice", "text_edit", "plain", "splice_text_edit"))), (F.col("generator") + 1).cast("int")), F.lit("_"), F.col("file").cast("string"))
    return rounded(ev.recall_by_subtype(_levels(spark, sf_dir).withColumn("file", name)))


A27_SQL = f"""{S}, v AS (SELECT ['copy_move', 'splice', 'text_edit', 'other', 'text_edit'][generator + 1] AS subtype, ['copy_move', 'splice', 'text_edit', 'plain', 'splice_text_edit'][generator + 1] || '_' || file AS file, score >= 0.6 AS alarm FROM score WHERE score IS NOT NULL)
SELECT subtype, count(*) AS n, count(*) FILTER (alarm) AS hit, round(avg(alarm::INT), 6) AS recall, count(*) FILTER (NOT alarm) AS missed, min(file) FILTER (NOT alarm) AS first_missed FROM v GROUP BY 1"""


def a28_rescue(spark, sf_dir):
    return rounded(ev.rescue(tb.scores(spark, sf_dir).withColumn("has_label", F.col("qty") % 4 == 0)))


A28_SQL = f"""{S}, v AS (SELECT kind, set, coalesce(score >= 0.9, false) AS m, qty % 4 = 0 AS l FROM score)
SELECT kind, set, count(*) AS n, count(*) FILTER (m) AS model_hits, count(*) FILTER (l) AS label_hits, count(*) FILTER (l AND NOT m) AS rescued, count(*) FILTER (l OR m) AS system_hits, round(avg((l OR m)::INT), 6) AS system_rate FROM v GROUP BY GROUPING SETS ((kind, set), (kind), ())"""


def a29_case_report(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").join(tb.table(spark, sf_dir, "labels"), "doc_id", "left")
    words = F.contains("text", F.lit("der"))
    cases = d.select((words == (F.col("lang") == "de")).alias("language"), (F.coalesce("quality", F.lit(0)) == F.when(F.col("n_chars") > 1000, 1).otherwise(0)).alias("length"), (F.coalesce("toxic", F.lit(0)) == 0).alias("clean"), (words & (F.col("lang") == "en")).alias("false_alarm"))
    return rounded(ev.case_report(cases, ["language", "length", "clean"]))


A29_SQL = """WITH c AS (SELECT contains(text, 'der') = (lang = 'de') AS a, coalesce(quality, 0) = (n_chars > 1000)::INT AS b, coalesce(toxic, 0) = 0 AS c, contains(text, 'der') AND lang = 'en' AS f FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS cases, round(avg(a::INT), 6) AS language_rate, round(avg(b::INT), 6) AS length_rate, round(avg(c::INT), 6) AS clean_rate, count(*) FILTER (a AND b AND c) AS fully_passed, count(*) FILTER (f) AS false_alarms FROM c"""


def _changed(spark, sf_dir):
    # a row becomes five, which are sorted by sample
    s = smaller_tasks(tb.scores(spark, sf_dir).select("file", "score", "qty"), "file").groupBy("file").agg(F.max("score").alias("score"), F.max("qty").alias("qty"))
    base = s.select(F.col("file").alias("sample"), "score")
    kinds = F.array(*(F.struct(F.lit(n).alias("perturbation"), F.lit(d).alias("d")) for n, d in (("blur", 0.08), ("crop", -0.01), ("jpeg", 0.02), ("noise", 0.3))))
    c = s.select(F.col("file").alias("sample"), "score", "qty", F.explode(kinds).alias("k")).select("sample", F.col("k.perturbation").alias("perturbation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") - F.col("k.d") * (F.col("qty") % 10 - 2) / 10)).alias("s0"), "score")
    return base, c.select("sample", "perturbation", F.when(F.col("score").isNotNull(), F.round("s0", 6)).alias("score"))


CHANGED_SQL = """b AS (SELECT file AS sample, max(score) AS base, max(qty) AS qty FROM score GROUP BY file),
k(perturbation, d) AS (VALUES ('blur', 0.08::DOUBLE), ('crop', -0.01::DOUBLE), ('jpeg', 0.02::DOUBLE), ('noise', 0.3::DOUBLE)),
c AS (SELECT sample, perturbation, base, round(greatest(0, least(1, base - d * (qty % 10 - 2) / 10)), 6) AS score FROM b, k WHERE base IS NOT NULL)"""


def a30_flips(spark, sf_dir):
    return rounded(ev.perturbation_flips(*_changed(spark, sf_dir)))


A30_SQL = f"""{S}, {CHANGED_SQL} SELECT perturbation, count(*) AS runs, count(*) FILTER ((score >= 0.9)::INT + (score >= 0.5)::INT <> (base >= 0.9)::INT + (base >= 0.5)::INT) AS flips, round(min(score - base), 6) AS least_delta, round(avg(score - base), 6) AS mean_delta, round(max(score - base), 6) AS largest_delta,
  count(*) FILTER ((score >= 0.9)::INT + (score >= 0.5)::INT <> (base >= 0.9)::INT + (base >= 0.5)::INT) = 0 AS safe FROM c GROUP BY 1"""


def a30_largest_drops(spark, sf_dir):
    return rounded(ev.largest_drops(*_changed(spark, sf_dir)))


A30D_SQL = f"{S}, {CHANGED_SQL}, d AS (SELECT sample, perturbation, score - base AS delta FROM c WHERE score - base < 0 ORDER BY delta, sample, perturbation LIMIT 3) SELECT sample, perturbation, round(delta, 6) AS delta FROM d"


def a31_level_totals(spark, sf_dir):
    v = _levels(spark, sf_dir)
    return ev.level_totals(v.filter("level is not null"), v.filter("level is null"))


A31_SQL = f"""{S}, v AS (SELECT {LEVEL_SQL} AS level FROM score)
SELECT level AS what, count(*) AS n FROM v WHERE level IS NOT NULL GROUP BY 1 UNION ALL SELECT 'needs_review', count(*) FROM v WHERE level IN ('high_risk', 'suspicious') UNION ALL SELECT 'analyzed', count(level) FROM v UNION ALL SELECT 'failed', count(*) - count(level) FROM v"""


def a32_video_rollup(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events")
    level = F.element_at(F.array(*map(F.lit, ("inconclusive", "credible", "error", "suspicious", "inconclusive", "high_risk", "credible"))), (F.col("event_id") % 7 + 1).cast("int"))
    frames = e.select(F.col("user_id").alias("video"), F.floor(F.col("event_id") / 10).alias("idx"), level.alias("level"), F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.col("user_id") * 10 + 500).alias("total_frames"))
    return rounded(ev.video_rollup(frames, step=3, cap=1 << 30))


A32_SQL = """WITH f AS (SELECT user_id AS video, ['inconclusive', 'credible', 'error', 'suspicious', 'inconclusive', 'high_risk', 'credible'][event_id % 7 + 1] AS level, CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id * 10 + 500 END AS total FROM events WHERE (event_id // 10) % 3 = 0),
r AS (SELECT *, list_position(['high_risk', 'suspicious', 'credible', 'inconclusive'], level) AS r FROM f)
SELECT video, count(*) AS sampled, coalesce(['high_risk', 'suspicious', 'credible', 'inconclusive'][min(nullif(r, 0))], 'inconclusive') AS level, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (r IN (1, 2)) AS flagged,
  count(*) FILTER (level = 'high_risk') AS n_high_risk, count(*) FILTER (level = 'suspicious') AS n_suspicious, count(*) FILTER (level = 'credible') AS n_credible, count(*) FILTER (level = 'inconclusive') AS n_inconclusive, round(CASE WHEN max(total) > 0 THEN count(*) / max(total) END, 6) AS coverage FROM r GROUP BY video"""


def a33_split_accuracy(spark, sf_dir):
    s = tb.scores(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("v1").alias("model"), (F.coalesce("score", F.lit(0.0)) >= 0.5).alias("alarm")), F.struct(F.lit("v2").alias("model"), (F.col("spectral") >= 0.5).alias("alarm")))).alias("m"), (F.col("grp") % 3 == 0).alias("seen"), "kind").select("m.*", "seen", "kind")
    return rounded(ev.split_accuracy(s))


A33_SQL = f"""{S}, m AS (SELECT 'v1' AS model, coalesce(score, 0) >= 0.5 AS alarm, grp % 3 = 0 AS seen, kind FROM score UNION ALL SELECT 'v2', spectral >= 0.5, grp % 3 = 0, kind FROM score)
SELECT model, CASE WHEN seen IS NULL THEN 'all' WHEN seen THEN 'seen' ELSE 'held_out' END AS part, count(*) AS n, round(avg(alarm::INT) FILTER (kind = 'generated'), 6) AS recall, round(avg(alarm::INT) FILTER (kind = 'real'), 6) AS fp_rate FROM m GROUP BY GROUPING SETS ((model, seen), (model))"""


def a35_separation(spark, sf_dir):
    return rounded(ev.separation(tb.scores(spark, sf_dir)))


A35_SQL = f"""{S}, r AS (SELECT min(score) FILTER (kind = 'real') AS a, avg(score) FILTER (kind = 'real') AS b, max(score) FILTER (kind = 'real') AS c, min(score) FILTER (kind = 'generated') AS d, avg(score) FILTER (kind = 'generated') AS e, max(score) FILTER (kind = 'generated') AS f FROM score)
SELECT round(a, 6) AS real_least, round(b, 6) AS real_mean, round(c, 6) AS real_largest, round(d, 6) AS fake_least, round(e, 6) AS fake_mean, round(f, 6) AS fake_largest, round(d - c, 6) AS gap, round(e - b, 6) AS mean_gap FROM r"""


QUERIES = {
    "a10_wilson": (a10_wilson, A10_SQL), "a11_origin_report": (a11_origin_report, A11_SQL), "a12_origin_by_tag": (a12_origin_by_tag, A12_SQL), "a13_field_f1": (a13_field_f1, A13_SQL),
    "a14_pair_rates": (a14_pair_rates, A14_SQL), "a15_mask_iou": (a15_mask_iou, A15_SQL), "a15_localization": (a15_localization, A15L_SQL), "a15_bootstrap": (a15_bootstrap, None), "a16_release_checks": (a16_release_checks, A16_SQL),
    "a17_calibration": (a17_calibration, A17_SQL), "a18_sweep": (a18_sweep, A18_SQL), "a18_sweep_verdict": (a18_sweep_verdict, A18V_SQL), "a19_auc": (a19_auc, A19_SQL), "a20_policies": (a20_policies, A20_SQL),
    "a21_ablation": (a21_ablation, A21_SQL), "a22_band_policy": (a22_band_policy, A22_SQL), "a22_band_adoption": (a22_band_adoption, A22V_SQL), "a23_set_statistics": (a23_set_statistics, A23_SQL),
    "a23_misses": (a23_misses, A23M_SQL), "a24_promotion": (a24_promotion, A24_SQL), "a25_dataset_report": (a25_dataset_report, A25_SQL), "a26_dispositions": (a26_dispositions, A26_SQL),
    "a27_subtypes": (a27_subtypes, A27_SQL), "a28_rescue": (a28_rescue, A28_SQL), "a29_case_report": (a29_case_report, A29_SQL), "a30_flips": (a30_flips, A30_SQL), "a30_largest_drops": (a30_largest_drops, A30D_SQL), "a31_level_totals": (a31_level_totals, A31_SQL),
    "a32_video_rollup": (a32_video_rollup, A32_SQL), "a33_split_accuracy": (a33_split_accuracy, A33_SQL), "a35_separation": (a35_separation, A35_SQL),
}
