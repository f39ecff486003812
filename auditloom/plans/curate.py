"""Curation and tracing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curate as cu
from ..operators import decide as dc
from ..operators import tracing as tr
from ..sources import io
from ..streaming import intake
from . import tables as tb

M = f"WITH {tb.MANIFEST_SQL}"


def p1_row_rules(spark, sf_dir):
    return cu.row_violations(tb.manifest(spark, sf_dir))


P1_SQL = f"""{M}, k AS (SELECT id, count(*) AS k FROM manifest GROUP BY id), m AS (SELECT manifest.*, k FROM manifest JOIN k USING (id)),
v AS (SELECT id, unnest([CASE WHEN id = '' OR "authorization" IS NULL THEN 'required' END, CASE WHEN k > 1 THEN 'duplicate_id' END, CASE WHEN split NOT IN ('smoke', 'train', 'calibration', 'blind') THEN 'enum' END,
  CASE WHEN split = 'blind' AND trim(reviewers[2]) = 'ann' THEN 'two_reviewers' END, CASE WHEN kind = 'generated' AND generator IS NULL THEN 'generator' END]) AS rule FROM m)
SELECT * FROM v WHERE rule IS NOT NULL"""


def p2_leaks(spark, sf_dir):
    return cu.leaks(tb.manifest(spark, sf_dir))


P2_SQL = f"""{M}, c AS (SELECT 'group' AS key, "group" AS value, split || '|' || "group" AS place FROM manifest UNION SELECT 'identity', identity, split || '|' || "group" FROM manifest UNION SELECT 'campaign', campaign, split || '|' || "group" FROM manifest
  UNION SELECT 'original_sha256', original_sha256, split || '|' || "group" FROM manifest UNION SELECT 'original_sha256', sha256, split || '|' || "group" FROM manifest UNION SELECT 'generator', generator, CASE WHEN split = 'blind' THEN 'blind' ELSE 'development' END FROM manifest)
SELECT key, value, count(*) AS places FROM c WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""


def j14_orphans(spark, sf_dir):
    return cu.orphans(tb.manifest(spark, sf_dir))


J14_SQL = f"""{M} SELECT id, original_sha256 FROM manifest m WHERE kind = 'edited' AND original_sha256 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manifest o WHERE o.kind IN ('real', 'generated') AND o.split = m.split AND o."group" = m."group" AND o.sha256 = m.original_sha256)"""


def j15_fingerprints(spark, sf_dir):
    p = F.col("p_partkey")
    base = F.conv(F.substring(F.md5(F.floor(p / 2).cast("string")), 1, 15), 16, 10).cast("long")
    fp = F.when(p % 2 == 1, base.bitwiseXOR(F.expr("shiftleft(1L, cast(p_partkey % 7 as int)) - 1"))).otherwise(base)
    d = tb.table(spark, sf_dir, "part").select(fp.alias("fp"), F.when(p % 3 == 0, "train").otherwise("blind").alias("split"))
    return cu.near_fingerprints(d)


J15_SQL = """WITH f AS (SELECT DISTINCT CASE WHEN p % 2 = 1 THEN xor(b, (1::BIGINT << (p % 7)::INT) - 1) ELSE b END AS fp, CASE WHEN p % 3 = 0 THEN 'train' ELSE 'blind' END AS split FROM (SELECT p_partkey AS p, ('0x' || substr(md5((p_partkey // 2)::VARCHAR), 1, 15))::BIGINT AS b FROM part))
SELECT DISTINCT a.fp AS a, b.fp AS b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM f a JOIN f b ON a.fp <= b.fp AND a.split <> b.split AND bit_count(xor(a.fp, b.fp)) <= 4"""


def j16_predictions(spark, sf_dir):
    m = tb.manifest(spark, sf_dir)
    p = m.filter("sha256 not like '%7'").select("id", F.when(F.col("sha256").like("%3"), "x").otherwise(F.col("sha256")).alias("image_sha256"))
    return cu.matched_predictions(m, p)


J16_SQL = f"""{M}, m AS (SELECT id, count(*) AS km, max(sha256) AS hm FROM manifest GROUP BY id), p AS (SELECT id, count(*) AS kp, max(CASE WHEN sha256 LIKE '%3' THEN 'x' ELSE sha256 END) AS hp FROM manifest WHERE sha256 NOT LIKE '%7' GROUP BY id)
SELECT count(*) FILTER (km IS NOT NULL AND kp IS NOT NULL) AS pairs, count(*) FILTER (kp IS NULL) AS without_prediction, count(*) FILTER (km IS NULL) AS without_row, count(*) FILTER (km > 1 OR kp > 1) AS repeated, count(*) FILTER (km IS NOT NULL AND kp IS NOT NULL AND hm IS DISTINCT FROM hp) AS hash_differs FROM m FULL JOIN p USING (id)"""


def j9_originals(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select(F.format_string("d%09d", "doc_id").alias("name"), F.col("text").alias("content"), "doc_id")
    b = tb.table(spark, sf_dir, "benchmark").select(F.format_string("b%09d", "item_id").alias("name"), F.col("text").alias("content"))
    return cu.known_originals(d, b.unionByName(d.filter("doc_id % 2 = 0").select("name", "content")))


J9_SQL = """WITH c AS (SELECT 'd' || lpad(doc_id::VARCHAR, 9, '0') AS name, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'b' || lpad(item_id::VARCHAR, 9, '0'), sha256(text) FROM benchmark)
SELECT d.name, d.digest, (SELECT min(c.name) FROM c WHERE c.digest = d.digest AND c.name <> d.name) AS known_original FROM (SELECT 'd' || lpad(doc_id::VARCHAR, 9, '0') AS name, sha256(text) AS digest FROM documents) d"""


def j10_import(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select("source", F.col("lang").alias("product"), F.md5("text").alias("excerpt"), F.when(F.col("doc_id") % 3 > 0, "brand_claim").otherwise("method").alias("source_type"), "doc_id")
    cat = d.filter("doc_id % 5 = 0").dropDuplicates(["source", "product", "excerpt"]).select("source", "product", "excerpt", "source_type")
    return cu.imported(d, cat, ["source", "product", "excerpt"]).groupBy("source").agg(F.count("*").alias("n"))


J10_SQL = """WITH d AS (SELECT source, lang, md5(text) AS e, doc_id FROM documents), a AS (SELECT DISTINCT source, lang, e FROM d WHERE doc_id % 5 = 0), b AS (SELECT DISTINCT source, lang, e FROM d WHERE doc_id % 3 > 0),
u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT source, count(*) AS n FROM u GROUP BY source"""


def j10_stream(spark, sf_dir):
    """J10 as a stream whose rows are all delivered twice, with a stop between: the batch query's rows."""
    d = tb.table(spark, sf_dir, "documents").select("source", F.col("lang").alias("product"), F.md5("text").alias("excerpt"), F.when(F.col("doc_id") % 3 > 0, "brand_claim").otherwise("method").alias("source_type"), "doc_id")
    key = ["source", "product", "excerpt"]
    cat = d.filter("doc_id % 5 = 0").dropDuplicates(key).select(*key, "source_type")
    incoming, path, checkpoint = (io.new_path(spark, f"intake-{x}") for x in ("files", "catalogue", "checkpoint"))
    for _ in range(2):
        d.write.mode("append").parquet(incoming)
        intake.import_stream(spark.readStream.schema(d.schema).parquet(incoming), cat, path, checkpoint, key).awaitTermination()
    return intake.batches(spark, path, cat.schema).groupBy("source").agg(F.count("*").alias("n"))


def w1_first_content(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("side"))
    return cu.first_of_content(d)


W1_SQL = """WITH d AS (SELECT doc_id AS ord, n_chars AS side, row_number() OVER (PARTITION BY text, n_chars >= 200 ORDER BY doc_id) AS r FROM documents)
SELECT CASE WHEN side < 200 THEN 'small' WHEN r = 1 THEN 'kept' ELSE 'duplicate' END AS state, count(*) AS n, min(ord) AS first FROM d GROUP BY 1"""


def p3_frozen(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("data/"), F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("/img"), F.floor(k / 4).cast("string"), F.when(k % 4 > 0, F.concat(F.lit("_v"), (k % 4).cast("string"))).otherwise(""), F.lit(".png"))
    registry = spark.createDataFrame([("1", "controlled", "clean"), ("2", "controlled", "ai"), ("3", "heldout", "real")], "dir string, bucket string, truth string")
    return cu.frozen_manifest(o.select(path.alias("path")), registry).groupBy("bucket", "truth").agg(F.count("*").alias("n"), F.countDistinct("source_group").alias("groups"))


P3_SQL = """WITH o AS (SELECT DISTINCT ON (o_orderkey, p) o_orderkey AS k, lower(substr(o_orderpriority, 1, 1)) AS p FROM orders), a AS (SELECT o_orderkey AS k, lower(substr(o_orderpriority, 1, 1)) AS p FROM orders)
SELECT CASE p WHEN '1' THEN 'controlled' WHEN '2' THEN 'controlled' WHEN '3' THEN 'heldout' END AS bucket, CASE p WHEN '1' THEN 'clean' WHEN '2' THEN 'ai' WHEN '3' THEN 'real' END AS truth, count(*) AS n, count(DISTINCT p || ':' || (k // 4)) AS groups FROM a GROUP BY 1, 2"""


def p4_split(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents").select("doc_id", "source")
    return cu.stratified_split(d, "source", "doc_id", 0.2, 11).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "validation").alias("validation"))


P4_SQL = "SELECT source, count(*) AS n, greatest(1, round_even(count(*) * 0.2, 0))::BIGINT AS validation FROM documents GROUP BY source"


def p5_provenance(spark, sf_dir):
    c = tb.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("name"))
    return cu.provenance_split(c, tb.table(spark, sf_dir, "nation").filter("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("grp")), 10)


P5_SQL = """WITH r AS (SELECT c_nationkey AS grp, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS r FROM customer WHERE c_nationkey % 3 > 0)
SELECT grp, CASE WHEN r <= 10 THEN 'held_out' ELSE 'train' END AS part, count(*) AS n, min(name) AS first FROM r GROUP BY 1, 2"""


def p6_pseudo_labels(spark, sf_dir):
    return cu.pseudo_labels(tb.scores(spark, sf_dir))


P6_SQL = f"WITH {tb.SCORES_SQL} SELECT CASE WHEN score <= 0.25 THEN 'accept' WHEN score >= 0.5 THEN 'reject' ELSE 'skip' END AS label, count(*) AS n FROM score GROUP BY 1"


def p7_weights(spark, sf_dir):
    w = cu.weights(tb.scores(spark, sf_dir))
    return w.select("kind", "grp", "k", F.round("class_weight", 6).alias("class_weight"), F.round("group_weight", 6).alias("group_weight"))


P7_SQL = f"""WITH {tb.SCORES_SQL} SELECT kind, grp, count(*) AS k, round(any_value(n) / (2 * any_value(c)), 6) AS class_weight, round(1 / any_value(g), 6) AS group_weight FROM
(SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY kind) AS c, count(*) OVER (PARTITION BY grp) AS g FROM score) GROUP BY kind, grp"""


def p8_label_gate(spark, sf_dir):
    return cu.label_gate(tb.manifest(spark, sf_dir))


P8_SQL = f"{M} SELECT id, split, kind FROM manifest WHERE split <> 'smoke' AND kind IN ('real', 'generated', 'edited') AND NOT (reviewed AND NOT label_present)"


def p9_lineage(spark, sf_dir):
    m = tb.manifest(spark, sf_dir)
    mapping = m.filter("sha256 like '%2' or sha256 like '%4'").select(F.col("sha256").alias("old"), F.concat(F.lit("n"), "sha256").alias("new"))
    return cu.rewritten_lineage(m, mapping).select("sha256", "original_sha256", "reviewed", "label_present")


P9_SQL = f"{M}, o AS (SELECT DISTINCT sha256 FROM manifest WHERE sha256 LIKE '%2' OR sha256 LIKE '%4') SELECT CASE WHEN m.sha256 LIKE '%2' OR m.sha256 LIKE '%4' THEN 'n' ELSE '' END || m.sha256 AS sha256, CASE WHEN o.sha256 IS NOT NULL THEN 'n' ELSE '' END || m.original_sha256 AS original_sha256, false AS reviewed, NULL::BOOLEAN AS label_present FROM manifest m LEFT JOIN o ON o.sha256 = m.original_sha256"


def _packages(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    m = d.select(F.col("doc_id").alias("stem"), F.col("lang").alias("kind"))
    kinds = spark.createDataFrame([("en", "clean", "photo", "shop"), ("de", "ai", None, "camera")], "kind string, truth string, scene string, source string")
    copies = tb.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stem"), F.col("turn").alias("pos"), F.md5("text").alias("text"))
    return cu.packages(m, kinds, copies, tb.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem")))


def j18_packages(spark, sf_dir):
    return _packages(spark, sf_dir)


J18_SQL = """SELECT doc_id AS stem, CASE lang WHEN 'en' THEN 'clean' WHEN 'de' THEN 'ai' ELSE 'unknown' END AS truth, CASE WHEN lang = 'en' THEN 'photo' ELSE 'generated' END AS scene, CASE lang WHEN 'en' THEN 'shop' WHEN 'de' THEN 'camera' ELSE 'own' END AS source, c.copy, doc_id IN (SELECT doc_id FROM labels) AS there
FROM documents LEFT JOIN (SELECT conv_id, md5(arg_min(text, turn)) AS copy FROM conversations GROUP BY 1) c ON conv_id = doc_id"""


def j18_missing(spark, sf_dir):
    return cu.missing_files(_packages(spark, sf_dir))


J18M_SQL = f"SELECT stem, truth FROM ({J18_SQL}) WHERE NOT there"


def j19_runs(spark, sf_dir):
    s = tb.scores(spark, sf_dir).groupBy(F.col("file").alias("case"), F.col("set").alias("family")).agg(F.max("score").alias("a"), F.max("spectral").alias("b"))
    old, new = s.select("case", "family", (F.coalesce("a", F.lit(0.0)) >= 0.5).alias("ok")), s.select("case", (F.col("b") >= 0.5).alias("ok"))
    return cu.compared_runs(old, new)


J19_SQL = f"""WITH {tb.SCORES_SQL}, s AS (SELECT file, set AS family, coalesce(max(score), 0) >= 0.5 AS a, max(spectral) >= 0.5 AS b FROM score GROUP BY ALL)
SELECT family, count(*) AS cases, count(*) FILTER (a) AS old_ok, count(*) FILTER (b) AS new_ok, count(*) FILTER (a AND NOT b) AS regressions, bool_and(b) AS all_ok FROM s GROUP BY family"""


def _ocr(spark, sf_dir):
    """OCR lines rendered from customers: an account line or an official one, by nation."""
    c = tb.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("官方 @"), "c_name")).when(k % 5 == 1, F.lit("plain words")).when(k % 5 == 2, F.concat(F.lit("  @"), F.regexp_replace("c_name", "#0*", ""), F.lit(" , 2024"))).when(k % 5 == 3, F.concat(F.lit("user"), (k % 11).cast("string"), F.lit("的小红书"))).otherwise(F.lit("AI 生成 by Midjourney"))
    return c.select((k % 200).alias("asset"), k.alias("line_no"), text.alias("text"), F.when(k % 13 > 0, k % 100 / 100).alias("confidence"))


OCR_SQL = """ocr AS (SELECT k % 200 AS asset, k AS line_no, k % 5 AS m, n, CASE WHEN k % 13 > 0 THEN k % 100 / 100 END AS confidence,
  CASE k % 5 WHEN 2 THEN regexp_replace(n, '#0*', '') WHEN 3 THEN 'user' || (k % 11) || '的' END AS handle FROM (SELECT c_custkey AS k, c_name AS n FROM customer))"""


def t15_watermarks(spark, sf_dir):
    return tr.watermarks(_ocr(spark, sf_dir))


T15_SQL = f"WITH {OCR_SQL} SELECT asset, substr(handle, 1, 20) AS handle, min(line_no) AS line_no FROM ocr WHERE handle IS NOT NULL GROUP BY 1, 2"


def t16_source_claims(spark, sf_dir):
    c = tb.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.concat("c_name", F.when(k % 3 == 0, "来自官网").when(k % 3 == 1, "本人拍摄，实拍").otherwise("旗舰店和天猫"))
    cells = tx.source_claims(F.col("t"))
    return c.select("c_custkey", text.alias("t")).select("c_custkey", *(F.concat_ws(":", x["matched"], x["position"].cast("string")).alias(n) for n, x in cells.items()))


T16_SQL = """SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN '旗舰店:' || length(c_name) ELSE '' END AS brand_official, CASE c_custkey % 3 WHEN 1 THEN '本人拍摄:' || length(c_name) ELSE '' END AS own_shot,
  CASE c_custkey % 3 WHEN 0 THEN '官网:' || (length(c_name) + 2) WHEN 2 THEN '天猫:' || (length(c_name) + 4) ELSE '' END AS official_site FROM customer"""


def t17_brands(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tx.brands(F.col("text"))).alias("brands"), F.md5(F.array_join(tx.brands(F.col("text")), ",")).alias("digest"))


T17_SQL = "WITH b AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][A-Za-z]{2,15}'))) AS b FROM documents) SELECT doc_id, len(b) AS brands, md5(array_to_string(b, ',')) AS digest FROM b"


def t18_labels(spark, sf_dir):
    return tr.labels(_ocr(spark, sf_dir))


T18_SQL = f"""WITH {OCR_SQL} SELECT asset, count(*) AS lines, count(*) FILTER (m = 4) AS hits, count(*) FILTER (m = 4 AND confidence >= 0.85) AS accepted, CASE WHEN count(*) FILTER (m = 4 AND confidence >= 0.85) > 0 THEN 'AI 生成 by Midjourney' END AS best, CASE WHEN count(*) FILTER (m = 4 AND confidence >= 0.85) > 0 THEN 'midjourney' END AS hint FROM ocr GROUP BY asset"""


def t19_tags(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("{&quot;Label&quot;: &quot;"), (k % 2).cast("string"), F.lit("&quot;}"))).when(k % 3 == 1, "broken")
    text = F.when(body.isNotNull(), F.concat(F.lit("<x><TC260:AIGC>"), body, F.lit("</TC260:AIGC></x>"))).otherwise("<x/>")
    label, made = tr.declared_tag(F.col("t"))
    return tb.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", label.alias("label"), made.alias("generated"))


T19_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 2)::VARCHAR END AS label, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 1 WHEN o_orderkey % 3 = 1 THEN false END AS generated FROM orders"


def t20_credentials(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"active_manifest": {"title": "a", "note": "'), F.when(k % 3 == 0, "AI-generated").otherwise("camera"), F.lit('"}, "validation_status": "'), F.when(k % 2 == 0, "Valid").otherwise("unknown"), F.lit('"}'))
    out = F.when(k % 7 == 0, "").when(k % 7 == 1, "not json").when(k % 7 == 2, '{"active_manifest": "x"}').when(k % 13 == 0, F.replace(body, F.lit("camera"), F.lit("camera, Unable to read"))).otherwise(body)
    rows = tb.table(spark, sf_dir, "orders").select("o_orderkey", out.alias("out"), F.when(k % 11 == 0, "找不到 c2patool").when(k % 17 == 0, "No claim").otherwise("").alias("err"), (k % 5 == 0).cast("int").alias("code"))
    status, says = tr.credential_status(F.col("out"), F.col("err"), F.col("code"))
    return rows.select("o_orderkey", status.alias("status"), says.alias("declares_ai"))


T20_SQL = """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 < 3 OR o_orderkey % 17 = 0 OR (o_orderkey % 13 = 0 AND o_orderkey % 3 > 0) THEN 'missing' WHEN o_orderkey % 2 = 0 THEN 'present_verified' ELSE 'present_unverified' END AS status FROM orders)
SELECT k AS o_orderkey, status, status LIKE 'present%' AND k % 3 = 0 AS declares_ai FROM s"""


def t21_licenses(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    name = F.element_at(F.array(*map(F.lit, ("CC-BY 4.0", "cc by-sa 3.0", "CC0", "Public Domain", "CC BY-NC 2.0", "GPL"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select("doc_id", tx.license_ok(name).alias("free"), tx.license_ok(F.concat(name, F.lit(" "), F.substring_index("text", "\n", 1))).alias("free_with_line"))


T21_SQL = """WITH n AS (SELECT doc_id, replace(lower(['CC-BY 4.0', 'cc by-sa 3.0', 'CC0', 'Public Domain', 'CC BY-NC 2.0', 'GPL'][doc_id % 6 + 1]), '-', ' ') AS a, replace(lower(split_part(text, chr(10), 1)), '-', ' ') AS b FROM documents), m AS (SELECT doc_id, a, a || ' ' || b AS c FROM n)
SELECT doc_id, contains(a, 'cc0') OR contains(a, 'public domain') OR (contains(a, 'cc by') AND NOT contains(a, 'sa') AND NOT contains(a, 'nc')) AS free, contains(c, 'cc0') OR contains(c, 'public domain') OR (contains(c, 'cc by') AND NOT contains(c, 'sa') AND NOT contains(c, 'nc')) AS free_with_line FROM m"""


def t23_reports(spark, sf_dir):
    k = F.col("o_orderkey")
    # the picture check is cited by its title or by its name, the text check by its title or not at all; one order in 31 has no evidence
    text = F.concat_ws("\n", *(F.when(k % 6 != i, F.lit(s)) for i, s in enumerate(tr.SECTIONS)), F.when(k % 9 == 0, tr.FORBIDDEN[1]), F.when(k % 5 > 0, "cannot prove who made the picture"), F.when(k % 7 > 1, "picture check").when(k % 7 == 1, "ELA"), F.when(k % 8 > 0, "text check"))
    level = F.element_at(F.array(*map(F.lit, ("high_risk", "suspicious", "credible", "other"))), (k % 4 + 1).cast("int"))
    tools = [F.struct(F.lit(t).alias("tool"), F.lit(n).alias("title"), F.lit(c).cast("string").alias("cannot_prove")) for t, n, c in (("ela", "picture check", "cannot prove who made the picture"), ("text", "text check", None))]
    tools = F.when(k % 31 == 0, F.slice(F.array(*tools), 1, 0)).when(k % 2 == 0, F.array(*tools)).otherwise(F.array(tools[0]))
    r = tb.table(spark, sf_dir, "orders").select(k.alias("asset"), text.alias("text"), level.alias("level"), (k % 40 / 10).alias("ela"), F.when(k % 3 > 0, k % 100 / 100).alias("ai_score"), tools.alias("tools"))
    return tr.report_checks(r).groupBy("check").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


T23_SQL = """SELECT unnest(['sections', 'level', 'tools', 'backed', 'limits', 'wording']) AS "check", count(*) AS n, unnest([count(*) FILTER (k % 6 > 3), count(*) FILTER (k % 4 < 3), count(*) FILTER (k % 31 > 0 AND k % 7 > 0 AND (k % 2 = 1 OR k % 8 > 0)),
  count(*) FILTER (CASE k % 4 WHEN 1 THEN k % 40 / 10 >= 2 WHEN 0 THEN k % 3 > 0 AND k % 100 / 100 >= 0.9 ELSE true END), count(*) FILTER (k % 31 = 0 OR k % 5 > 0), count(*) FILTER (k % 9 > 0)]) AS passed FROM (SELECT o_orderkey AS k FROM orders)"""


def t24_gates(spark, sf_dir):
    lines = _ocr(spark, sf_dir)
    a, b = tr.claim_lines(lines).groupBy("asset").agg(F.count("*").alias("claims")), tr.trace_lines(lines).groupBy("asset").agg(F.count("*").alias("traces"))
    return a.join(b, "asset", "full").na.fill(0)


T24_SQL = f"WITH {OCR_SQL} SELECT asset, count(*) FILTER (coalesce(confidence, 1) >= 0.7) AS claims, count(*) FILTER (coalesce(confidence, 0) >= 0.5) AS traces FROM ocr GROUP BY asset HAVING claims > 0 OR traces > 0"


def t25_references(spark, sf_dir):
    p = F.col("p_partkey")
    r = tb.table(spark, sf_dir, "part").select((p - (p % 100 == 1).cast("int")).cast("string").alias("id"), F.when(p % 7 > 0, "lab").otherwise("  ").alias("source"), F.when(p % 50 == 3, F.repeat(F.lit("x"), 10001)).otherwise("e").alias("excerpt"), F.col("p_name").alias("product"), F.lit("1").alias("version"), F.lit("p1").alias("locator"), F.lit("r").alias("reviewer"), F.when(p % 9 == 0, "blog").when(p % 9 == 1, F.lit(None)).otherwise("method").alias("source_type"))
    return tr.reference_violations(r)


T25_SQL = """WITH r AS (SELECT (p_partkey - (p_partkey % 100 = 1)::INT)::VARCHAR AS id, p_partkey AS p FROM part), k AS (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM r)
SELECT id, array_to_string([x for x in [CASE WHEN p % 7 = 0 THEN 'blank' END, CASE WHEN p % 9 = 0 THEN 'type' END, CASE WHEN p % 50 = 3 THEN 'long' END, CASE WHEN k > 1 THEN 'duplicate' END] if x IS NOT NULL], ',') AS violations FROM k"""


def _catalog(spark, sf_dir):
    c = tb.captions(spark, sf_dir)
    a = F.col("asset")
    words = F.array(*map(F.lit, ("面霜", "面膜", "口红", "")))
    docs = c.select("asset").distinct().select("asset", F.concat(F.lit("Brand"), F.element_at(F.array(F.lit("A"), F.lit("B")), (a % 2 + 1).cast("int")), F.element_at(words, (a % 4 + 1).cast("int"))).alias("text"))
    lines = c.select("asset", F.col("line").alias("line_no"), F.when(F.col("line") == 1, F.concat(F.element_at(words, (a % 3 + 1).cast("int")), F.lit(" BrandA"))).otherwise("").alias("text"))
    return docs, lines


def j8_categories(spark, sf_dir):
    return tr.category_conflicts(*_catalog(spark, sf_dir)).select("asset", "text_categories", "image_categories", "conflict", "shared_brands")


_J8 = f"""{tb.CAPTIONS_SQL}, a AS (SELECT asset, bool_or(line = 1) AS one FROM caption GROUP BY asset),
c AS (SELECT asset, ['面霜', '面膜', '口红', ''][asset % 4 + 1] AS t, CASE WHEN one THEN ['面霜', '面膜', '口红'][asset % 3 + 1] ELSE '' END AS o, one AND asset % 2 = 0 AS b FROM a)"""
J8_SQL = f"WITH {_J8} SELECT asset, t AS text_categories, o AS image_categories, t <> '' AND o <> '' AND t <> o AS conflict, CASE WHEN b THEN 'BrandA' ELSE '' END AS shared_brands FROM c"


def _traces(spark, sf_dir):
    found = tr.category_conflicts(*_catalog(spark, sf_dir))
    a = F.col("asset")
    return dc.trace_verdict(found.select("asset", (a % 3 == 0).cast("int").alias("handles"), (a % 5 == 0).alias("official"), (a % 7 == 0).alias("site"), (a % 4 == 0).alias("own_shot"), F.col("conflict").alias("category_conflict")))


def d10_trace_verdicts(spark, sf_dir):
    return _traces(spark, sf_dir).select("asset", "risk", "level")


_D10 = "d AS (SELECT asset, CASE WHEN asset % 3 = 0 AND (asset % 5 = 0 OR asset % 7 = 0) THEN 'high' WHEN (asset % 3 = 0 AND asset % 4 = 0) OR (t <> '' AND o <> '' AND t <> o) THEN 'medium' ELSE 'low' END AS risk FROM c)"
D10_SQL = f"WITH {_J8}, {_D10} SELECT asset, risk, CASE risk WHEN 'high' THEN 'high_risk' WHEN 'medium' THEN 'suspicious' ELSE 'credible' END AS level FROM d"


def d12_with_matrix(spark, sf_dir):
    t = _traces(spark, sf_dir).withColumn("batch", F.col("asset") % 50)
    m = t.groupBy("batch").agg(F.when(F.max("batch") % 3 == 0, "suspicious").otherwise("credible").alias("verdict"))
    return dc.with_matrix(t, m).groupBy("level").agg(F.count("*").alias("n"))


D12_SQL = f"WITH {_J8}, {_D10} SELECT CASE WHEN risk = 'high' THEN 'high_risk' WHEN risk = 'medium' OR (asset % 50) % 3 = 0 THEN 'suspicious' ELSE 'credible' END AS level, count(*) AS n FROM d GROUP BY 1"

QUERIES = {n: (globals()[n], globals()[f"{n.split('_')[0].upper()}_SQL"]) for n in (
    "p1_row_rules", "p2_leaks", "p3_frozen", "p4_split", "p5_provenance", "p6_pseudo_labels", "p7_weights", "p8_label_gate", "p9_lineage", "j8_categories", "j9_originals", "j10_import", "j10_stream", "j14_orphans", "j15_fingerprints", "j16_predictions",
    "j18_packages", "j19_runs", "w1_first_content", "t15_watermarks", "t16_source_claims", "t17_brands", "t18_labels", "t19_tags", "t20_credentials", "t21_licenses", "t23_reports", "t24_gates", "t25_references", "d10_trace_verdicts", "d12_with_matrix")} | {"j18_missing": (j18_missing, J18M_SQL)}
