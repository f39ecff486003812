"""Decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as dc
from ..sources import io
from ..streaming import intake
from . import tables as tb
from .evaluate import rounded

S = f"WITH {tb.SCORES_SQL}"


def _evidence(spark, sf_dir):
    """An evidence row for each order."""
    k = F.col("o_orderkey")
    o = tb.table(spark, sf_dir, "orders")
    return o.select(
        k.alias("asset"), (k % 2 == 0).alias("has_text"), F.when(k % 31 == 0, "hard").when(k % 11 == 0, "medium").alias("conflict"), (k % 13 == 0).alias("disclosed"),
        F.when(k % 17 > 0, k * 7919 % 1000 / 1000).alias("ai_score"), F.when(k % 19 > 0, k * 104729 % 1000 / 1000).alias("spectral"), F.when(k % 7 > 0, k * 1299709 % 1000 / 1000 * 0.95).alias("edit_score"), (k % 5 == 0).alias("edit_review_only"),
        F.when(k % 23 == 0, 1).otherwise(0).alias("claims_high"), (k % 4).cast("int").alias("claims_medium"), F.when(k % 3 == 0, k % 40 / 10).alias("ela"), (k % 29 == 0).alias("declares_ai"), (k % 4 == 1).alias("verified"))


E_SQL = """e AS (SELECT k AS asset, k % 2 = 0 AS has_text, CASE WHEN k % 31 = 0 THEN 'hard' WHEN k % 11 = 0 THEN 'medium' END AS conflict, k % 13 = 0 AS shown, CASE WHEN k % 17 > 0 THEN k * 7919 % 1000 / 1000 END AS ai,
  CASE WHEN k % 19 > 0 THEN k * 104729 % 1000 / 1000 END AS sp, CASE WHEN k % 7 > 0 THEN k * 1299709 % 1000 / 1000 * 0.95::DOUBLE END AS edit, k % 5 = 0 AS ro, (k % 23 = 0)::INT AS hi, (k % 4)::INT AS med, CASE WHEN k % 3 = 0 THEN k % 40 / 10 END AS ela, k % 29 = 0 AS dai, k % 4 = 1 AS ver FROM (SELECT o_orderkey AS k FROM orders)),
f AS (SELECT *, NOT shown AND (coalesce(ai >= 0.9, false) OR coalesce(ai >= 0.2 AND ai < 0.9 AND sp >= 0.8, false) OR coalesce(sp >= 0.6 AND sp < 0.8, false)) AS fl, CASE WHEN NOT ro THEN edit END AS ed FROM e),
v AS (SELECT *, CASE WHEN conflict = 'hard' THEN 'high_risk,conflict_hard' WHEN ai >= 0.99 AND NOT shown AND NOT has_text THEN 'high_risk,ai_hard' WHEN ai >= 0.9 AND NOT shown AND NOT has_text AND sp >= 0.8 THEN 'high_risk,ai_and_spectral'
  WHEN ed >= 0.9 AND NOT shown AND NOT has_text THEN 'high_risk,edit_high' WHEN ed >= 0.5 AND NOT shown THEN 'suspicious,edit' WHEN conflict = 'medium' THEN 'suspicious,conflict_medium' WHEN has_text AND hi >= 1 THEN 'suspicious,claims_high' WHEN has_text AND med >= 3 THEN 'suspicious,claims_medium'
  WHEN ela >= 2 THEN 'suspicious,ela' WHEN dai AND NOT shown THEN 'suspicious,credential_ai' WHEN ver AND NOT shown AND NOT has_text AND NOT fl THEN 'credible,credential' WHEN fl THEN 'suspicious,gray_band' ELSE 'inconclusive,nothing' END AS r FROM f),
j AS (SELECT *, split_part(r, ',', 1) AS level, split_part(r, ',', 2) AS reason FROM v)"""


def d1_signals(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    e = o.select(
        k.alias("asset"), F.element_at(F.array(F.lit("origin_v4"), F.lit("origin_v7"), F.lit("other")), (k % 3 + 1).cast("int")).alias("model"), F.when(k % 8 > 0, F.concat(F.lit("w"), (k % 2).cast("string"))).alias("weights"), F.lit("resize").alias("preprocessing"),
        F.when(k % 10 > 0, k % 9 > 0).alias("available"), (k % 4 == 0).alias("review_only"), (k * 7919 % 1000 / 1000).alias("raw_score"))
    profiles = [("origin_v7", "w0", "resize", 0.4, 0.8, True), ("origin_v7", "w0", "resize", 0.4, 0.8, True), ("origin_v7", "w1", "crop", 0.1, 0.2, True), ("other", "w0", "resize", 0.1, 0.2, False), ("other", "w1", "resize", 0.3, 0.2, True), ("origin_v4", "w0", "resize", 0.3, 0.6, True), ("origin_v4", "w0", "resize", 0.2, 0.6, True), ("origin_v4", "w1", "resize", 0.2, 0.7, True), ("origin_v4", None, "resize", 0.0, 0.1, True)]
    return dc.image_signals(e, spark.createDataFrame(profiles, "model string, weights string, preprocessing string, low double, high double, approved boolean"))


D1_SQL = """WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 9 > 0 THEN o_orderkey * 7919 % 1000 / 1000 END AS s, CASE WHEN o_orderkey % 8 > 0 THEN 'w' || o_orderkey % 2 END AS w FROM orders),
p AS (SELECT *, CASE WHEN k % 3 = 1 AND w = 'w0' THEN 0.4 WHEN k % 3 = 0 AND w = 'w1' THEN 0.2 END AS low, CASE WHEN k % 3 = 1 AND w = 'w0' THEN 0.8 WHEN k % 3 = 0 AND w = 'w1' THEN 0.7 END AS high FROM e)
SELECT k AS asset, s AS score, CASE WHEN k % 3 = 0 AND k % 4 > 0 AND low IS NULL THEN s END AS decision_score, CASE WHEN s IS NULL THEN 'unavailable' WHEN low IS NULL THEN 'uncalibrated' WHEN s >= high THEN 'likely' WHEN s >= low THEN 'uncertain' ELSE 'no_signal' END AS status FROM p"""


def d2_verdicts(spark, sf_dir):
    return dc.judged(_evidence(spark, sf_dir)).select("asset", "level", "reason")


D2_SQL = f"WITH {E_SQL} SELECT asset, level, reason FROM j"


def d3_overlay(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir)).select("asset", "level")
    claims = v.select("asset", F.when(F.col("asset") % 9 == 0, "conflict").otherwise("insufficient").alias("status"))
    return dc.overlay(v, claims, v.filter("asset % 37 = 0").select("asset"))


D3_SQL = f"WITH {E_SQL} SELECT asset, CASE WHEN level = 'high_risk' THEN level WHEN asset % 9 = 0 OR asset % 37 = 0 THEN 'suspicious' WHEN level = 'credible' THEN 'inconclusive' ELSE level END AS level FROM j"


def d4_playbook(spark, sf_dir):
    return dc.with_playbook(dc.judged(_evidence(spark, sf_dir)).select("asset", "level")).groupBy("level", "action", "hours", "must_review").agg(F.count("*").alias("n"))


D4_SQL = f"WITH {E_SQL} SELECT level, CASE level WHEN 'high_risk' THEN 'freeze' WHEN 'suspicious' THEN 'hold' WHEN 'credible' THEN 'release' ELSE 'release_with_note' END AS action, CASE level WHEN 'high_risk' THEN 2 WHEN 'suspicious' THEN 24 WHEN 'inconclusive' THEN 48 END AS hours, level IN ('high_risk', 'suspicious') AS must_review, count(*) AS n FROM j GROUP BY ALL"


def _assets(spark, sf_dir):
    k = F.col("asset")
    return _evidence(spark, sf_dir).select("asset", F.element_at(F.array(F.lit("JPEG"), F.lit("png"), F.lit("")), (k % 3 + 1).cast("int")).alias("format"), F.when(k % 8 == 0, "x").alias("known_original"), "has_text", (k % 6 > 0).alias("has_lines"), "ai_score")


def d5_skips(spark, sf_dir):
    return dc.skips(_assets(spark, sf_dir))


D5_SQL = f"""WITH {E_SQL} SELECT asset, 'ela' AS tool, 'R1' AS rule, 'skip' AS action FROM e WHERE asset % 3 = 1 UNION ALL SELECT asset, 'ela', 'R2', 'skip' FROM e WHERE asset % 8 = 0 UNION ALL SELECT asset, 'trufor', 'R2', 'skip' FROM e WHERE asset % 8 = 0
UNION ALL SELECT asset, 'text', 'R3', 'skip' FROM e WHERE NOT has_text UNION ALL SELECT asset, 'crossmodal', 'R3', 'skip' FROM e WHERE NOT has_text UNION ALL SELECT asset, 'crossmodal', 'R4', 'partial' FROM e WHERE has_text AND asset % 6 = 0 UNION ALL SELECT asset, 'trufor', 'R5', 'run_limited' FROM e WHERE ai >= 0.9"""


def d6_follow_ups(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir)).withColumn("hard_conflicts", (F.col("conflict") == "hard").cast("int"))
    return dc.follow_ups(v)


D6_SQL = f"""WITH {E_SQL} SELECT asset, 'A1' AS rule, CASE level WHEN 'high_risk' THEN 'queue' ELSE 'mark' END AS action FROM j WHERE level IN ('high_risk', 'suspicious') UNION ALL SELECT asset, 'A2', 'rewrite' FROM j WHERE hi > 0 OR med > 0 UNION ALL SELECT asset, 'A3', 'check_sources' FROM j WHERE conflict = 'hard'"""


def d7_trace(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir))
    reasons = v.select("asset", F.col("reason")).unionByName(v.filter("asset % 4 = 0").select("asset", F.lit("edit not found").alias("reason")))
    tools = v.select("asset", F.explode(F.array(*map(F.lit, ("crossmodal", "aigc", "trufor", "text", "ela", "c2pa")))).alias("tool"))
    return dc.decision_trace(reasons, tools, [("conflict", "crossmodal"), ("ai_", "aigc"), ("edit", "trufor"), ("claims", "text"), ("ela", "ela"), ("credential", "c2pa")], "not found|nothing")


D7_SQL = f"""WITH {E_SQL}, t AS (SELECT asset, unnest(['crossmodal', 'aigc', 'trufor', 'text', 'ela', 'c2pa']) AS tool, CASE WHEN reason LIKE 'conflict%' THEN 'crossmodal' WHEN reason LIKE 'ai\\_%' ESCAPE '\\' THEN 'aigc' WHEN reason LIKE 'edit%' THEN 'trufor' WHEN reason LIKE 'claims%' THEN 'text' WHEN reason = 'ela' THEN 'ela' WHEN reason LIKE 'credential%' THEN 'c2pa' END AS c FROM j)
SELECT asset, tool, coalesce(tool = c, false) AS contributed FROM t"""


def d8_roles(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir)).withColumn("known_original", F.when(F.col("asset") % 8 == 0, "x")).withColumn("credential", F.when(F.col("asset") % 6 == 0, "present"))
    return dc.role_review(v)


D8_SQL = f"""WITH {E_SQL}, r AS (SELECT asset, level, [x for x in [CASE WHEN edit >= 0.5 OR ela >= 2 THEN 'image' END, CASE WHEN hi > 0 OR conflict = 'hard' THEN 'text' END, CASE WHEN asset % 8 > 0 AND asset % 6 > 0 THEN 'source' END] if x IS NOT NULL] AS c FROM j)
SELECT asset, array_to_string(c, ',') AS concerns, CASE WHEN level IN ('high_risk', 'suspicious') THEN len(c) > 0 ELSE true END AS agrees FROM r"""


def d9_checks(spark, sf_dir):
    a = _evidence(spark, sf_dir).select("asset")
    ev = a.select("asset", F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(i).alias("i")) for i, t in enumerate(("hash", "aigc", "trufor", "ocr"))))).alias("t")).select("asset", "t.tool", ((F.col("asset") + F.col("t.i")) % 5).alias("m")).filter("m > 0").select("asset", "tool", (F.col("m") > 1).alias("available"))
    return dc.check_statuses(a, ["hash", "aigc", "trufor", "ocr"], ev)


D9_SQL = """WITH t AS (SELECT o_orderkey AS asset, unnest(['hash', 'aigc', 'trufor', 'ocr']) AS tool, unnest([0, 1, 2, 3]) AS i FROM orders)
SELECT asset, tool, CASE WHEN (asset + i) % 5 = 1 AND tool <> 'hash' THEN 'model_unavailable' WHEN (asset + i) % 5 > 1 THEN 'completed' ELSE 'insufficient_evidence' END AS status FROM t"""


def d13_skin(spark, sf_dir):
    c = tb.table(spark, sf_dir, "customer")
    answers = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.floor(F.col("c_custkey") / F.pow(F.lit(3.0), F.floor(i / 4))) + i * F.col("c_nationkey")) % 5)
    return c.select("c_custkey", dc.skin_type(answers).alias("skin"))


_SKIN = """a AS (SELECT c_custkey, [x for x in [(floor(c_custkey / pow(3, i // 4)) + i * c_nationkey) % 5 for i in range(0, 16)]] AS a FROM customer),
g AS (SELECT c_custkey, [CASE WHEN len([x for x in a[4 * k + 1 : 4 * k + 4] if x <= 3]) >= 3 THEN list_avg([x for x in a[4 * k + 1 : 4 * k + 4] if x <= 3]) END for k in range(0, 4)] AS g FROM a),
s AS (SELECT c_custkey, CASE WHEN g[1] IS NULL OR g[2] IS NULL OR g[3] IS NULL OR g[4] IS NULL OR (g[1] >= 2 AND g[3] >= 2) OR (g[2] >= 2 AND g[4] >= 2) THEN 'unclear' WHEN g[1] >= 2 AND g[2] < 2 AND g[4] >= 2 THEN 'mixed' WHEN g[1] >= 2 AND g[2] >= 2 THEN 'oily' WHEN g[3] >= 2 AND g[4] >= 2 THEN 'dry' WHEN g[1] <= 1 AND g[2] <= 1 AND g[3] <= 1 AND g[4] <= 1 THEN 'neutral' ELSE 'unclear' END AS skin FROM g)"""
D13_SQL = f"WITH {_SKIN} SELECT * FROM s"


def j17_recommendations(spark, sf_dir):
    c = tb.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ("dry", "oily", "mixed", "unclear")))
    p = c.select(k.alias("profile"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("type"), F.array((k % 3).cast("string"), F.lit("9")).alias("goals"), F.array((k % 5).cast("string")).alias("textures"), F.when(k % 7 == 0, F.array(F.lit("acid"))).otherwise(F.array().cast("array<string>")).alias("avoid"), F.when(k % 2 == 0, k % 4).cast("int").alias("sensitivity"))
    q = F.col("p_partkey")
    cat = tb.table(spark, sf_dir, "part").filter("p_size <= 10").select(F.concat(F.lit("n"), F.lpad(q.cast("string"), 8, "0")).alias("name"), F.when(q % 10 > 0, "CN").otherwise("US").alias("market"), F.array(F.element_at(kinds, (q % 3 + 1).cast("int"))).alias("skin"), F.array((q % 3).cast("string")).alias("goals"), F.array((q % 5).cast("string")).alias("textures"), F.when(q % 3 > 0, q % 2 == 0).alias("gentle"), F.when(q % 4 > 0, F.array(F.when(q % 2 == 0, "Acid x").otherwise("oil"))).alias("ingredients"))
    return dc.recommendations(p, cat, "CN")


J17_SQL = """WITH p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 < 3), q AS (SELECT p_partkey AS q FROM part WHERE p_size <= 10 AND p_partkey % 10 > 0),
b AS (SELECT k AS profile, 'n' || lpad(q::VARCHAR, 8, '0') AS name, (k % 3 = q % 3)::INT + (k % 5 = q % 5)::INT AS score FROM p JOIN q ON k % 4 = q % 3
  WHERE (k % 2 = 1 OR k % 4 < 2 OR (q % 3 > 0 AND q % 2 = 0)) AND (k % 7 > 0 OR (q % 4 > 0 AND q % 2 = 1))),
r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, name) AS place FROM b)
SELECT profile, place, name, score FROM r WHERE place <= 3"""


def k1_board(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir)).select("asset", "level", F.col("ai_score").alias("score"))
    return dc.board(v, 100)


K1_SQL = f"WITH {E_SQL} SELECT asset, level, ai AS score FROM j ORDER BY CASE level WHEN 'high_risk' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'credible' THEN 2 ELSE 3 END, coalesce(ai, 0) DESC, asset LIMIT 100"


def _decisions(spark, sf_dir):
    e = tb.table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 3000).alias("asset"), F.col("event_type").alias("decision"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("reviewer"), F.col("event_id").alias("ts"))


def w2_latest(spark, sf_dir):
    return dc.latest_decisions(_decisions(spark, sf_dir))


_D = "d AS (SELECT event_id % 3000 AS asset, arg_max(event_type, event_id) AS decision, arg_max('u' || user_id, event_id) AS reviewer, max(event_id) AS ts FROM events GROUP BY 1)"
W2_SQL = f"WITH {_D} SELECT * FROM d"


#: Seconds that numbers of events are moved by when they stand for stamps, as watermarks begin at 1970.
EPOCH = 1_000_000_000


def w2_stream(spark, sf_dir):
    """W2 as a stream whose rows are all delivered twice, with a stop between: the batch query's rows."""
    d = _decisions(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("ts") + EPOCH))
    incoming, path, checkpoint = (io.new_path(spark, f"intake-{x}") for x in ("files", "decisions", "checkpoint"))
    for _ in range(2):
        d.write.mode("append").parquet(incoming)
        intake.decision_stream(spark.readStream.schema(d.schema).parquet(incoming), path, checkpoint).awaitTermination()
    return intake.latest(spark, path, d.schema).withColumn("ts", F.unix_seconds("ts") - EPOCH)


def k2_queue(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir)).select("asset", "level", F.col("ai_score").alias("score"))
    return dc.review_queue(v, _decisions(spark, sf_dir))


K2_SQL = f"WITH {E_SQL}, {_D} SELECT asset, level, ai AS score, decision, reviewer, ts FROM j LEFT JOIN d USING (asset) WHERE level IN ('high_risk', 'suspicious')"


def k3_records(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir))
    nested = v.select("asset", F.struct("level").alias("verdict"), F.struct(F.struct(F.col("edit_score").alias("score")).alias("trufor"), F.struct(F.col("ai_score").alias("score")).alias("aigc"), F.struct(F.when(F.col("ela").isNotNull(), F.array(F.struct(F.col("ela").alias("score")))).alias("regions")).alias("ela")).alias("evidence"))
    return rounded(dc.flat_record(nested))


K3_SQL = f"WITH {E_SQL} SELECT asset, level, round(edit, 6) AS edit_score, round(ai, 6) AS ai_score, round(ela, 6) AS ela_score, level IN ('high_risk', 'suspicious') AS needs_review FROM j"


def u1_export(spark, sf_dir):
    v = dc.judged(_evidence(spark, sf_dir)).select("asset", "level")
    return dc.with_failures(v.filter("asset % 50 > 0"), v.filter("asset % 50 = 0").select("asset", F.lit("timeout").alias("error")))


U1_SQL = f"WITH {E_SQL} SELECT asset, CASE WHEN asset % 50 > 0 THEN level END AS level, CASE WHEN asset % 50 = 0 THEN 'timeout' END AS error FROM j"


def u2_overlay(spark, sf_dir):
    p = tb.table(spark, sf_dir, "part")
    chosen = p.select(F.col("p_partkey").alias("id"), F.lit("chosen").alias("text"))
    cat = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return dc.overlaid(chosen, cat)


U2_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS origin, CASE WHEN p_partkey % 3 = 0 THEN min(p_name) ELSE 'chosen' END AS text FROM part GROUP BY p_partkey"


def u3_membership(spark, sf_dir):
    c = tb.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    return dc.membership(c, c.filter("c_custkey % 4 = 1").select("name"))


U3_SQL = "SELECT c_name AS name, c_custkey, c_name IN (SELECT c_name FROM customer WHERE c_custkey % 4 = 1) AS seen FROM customer"

QUERIES = {
    "d1_signals": (d1_signals, D1_SQL), "d2_verdicts": (d2_verdicts, D2_SQL), "d3_overlay": (d3_overlay, D3_SQL), "d4_playbook": (d4_playbook, D4_SQL), "d5_skips": (d5_skips, D5_SQL), "d6_follow_ups": (d6_follow_ups, D6_SQL),
    "d7_trace": (d7_trace, D7_SQL), "d8_roles": (d8_roles, D8_SQL), "d9_checks": (d9_checks, D9_SQL), "d13_skin": (d13_skin, D13_SQL), "j17_recommendations": (j17_recommendations, J17_SQL), "k1_board": (k1_board, K1_SQL),
    "w2_latest": (w2_latest, W2_SQL), "w2_stream": (w2_stream, W2_SQL), "k2_queue": (k2_queue, K2_SQL), "k3_records": (k3_records, K3_SQL), "u1_export": (u1_export, U1_SQL), "u2_overlay": (u2_overlay, U2_SQL), "u3_membership": (u3_membership, U3_SQL),
}
