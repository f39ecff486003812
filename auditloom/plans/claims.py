"""Claim queries on the caption fixture and on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import scan
from ..functions import text as tx
from ..functions.shipping import ship
from ..operators import claims as cl
from . import tables as tb

C = f"WITH {tb.CAPTIONS_SQL}"
KEYS = ["asset", "line"]
#: The lexicon with the rendered metric as one more word.
WORDS, SEVERITY = lx.CLAIM_WORDS | {"metric": ["水分提升"]}, lx.CLAIM_SEVERITY | {"metric": "medium"}
#: Place of the metric in a rendered caption.
AT = "(6 + length(part::VARCHAR) + length(days::VARCHAR) + CASE kind WHEN 1 THEN 2 WHEN 3 THEN 5 ELSE 0 END)::INT"
VALUE_END = f"({AT} + 5 + length(value::VARCHAR))"


def _copy(spark, sf_dir):
    return tb.captions(spark, sf_dir).withColumnRenamed("copy", "text")


def t1_clauses(spark, sf_dir):
    ship(spark)
    d = tb.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(scan.clause_spans(F.col("text"))).alias("c")).select("doc_id", "c.start", "c.end", F.md5("c.quote").alias("quote"))


T1_SQL = r"""
WITH p AS (SELECT doc_id, regexp_split_to_array(text, '[。！？!?；;\n]') AS q FROM documents),
u AS (SELECT doc_id, unnest(q) AS quote, unnest(range(1, len(q) + 1)) AS i FROM p),
s AS (SELECT *, coalesce(sum(length(quote) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM u)
SELECT doc_id, start, start + length(quote)::INT AS "end", md5(quote) AS quote FROM s WHERE quote <> ''"""


def t3_lexicon(spark, sf_dir):
    return cl.hit_table(_copy(spark, sf_dir), KEYS, words=WORDS, severity=SEVERITY).drop("context")


T3_BODY = f"""
  SELECT asset, line, 'metric' AS category, '水分提升' AS word, CASE WHEN kind = 2 THEN 'review' ELSE 'medium' END AS severity, CASE WHEN kind = 2 THEN 'question' ELSE 'asserted' END AS stance, {AT} AS position FROM caption WHERE kind NOT IN (1, 3)
  UNION ALL SELECT asset, line, 'medical', '治疗', 'high', 'asserted', ({VALUE_END} + 1)::INT FROM caption WHERE kind = 4
  UNION ALL SELECT asset, line, 'absolute', '最佳', 'medium', 'asserted', ({VALUE_END} + 1)::INT FROM caption WHERE kind = 5"""
T3_SQL = f"{C}, h AS ({T3_BODY}) SELECT * FROM h"


def t2_stance(spark, sf_dir):
    out = cl.claim_table(_copy(spark, sf_dir), KEYS)
    return out.groupBy("stance").agg(F.count("*").alias("n"))


T2_SQL = f"{C} SELECT CASE kind WHEN 1 THEN 'negated' WHEN 2 THEN 'question' WHEN 3 THEN 'quoted' ELSE 'asserted' END AS stance, count(*) AS n FROM caption GROUP BY 1"


def t4_rollup(spark, sf_dir):
    c = _copy(spark, sf_dir)
    return cl.hit_rollup(c, cl.hit_table(c, KEYS, words=WORDS, severity=SEVERITY), KEYS)


T4_SQL = f"""{C} SELECT asset, line, (kind = 4)::BIGINT AS high, (kind IN (0, 4, 5))::BIGINT + (kind = 5)::BIGINT AS medium, (kind = 2)::BIGINT AS review,
  CASE WHEN kind = 4 THEN 'high' WHEN kind IN (0, 5) THEN 'medium' ELSE 'none' END AS level, CASE WHEN kind = 4 THEN '治疗' WHEN kind IN (0, 2, 5) THEN '水分提升' END AS top_word FROM caption"""


def t7_dimensions(spark, sf_dir):
    dims = tx.dimension_numbers(F.col("text"))
    return _copy(spark, sf_dir).withColumn("d", dims).select("asset", "line", F.size("d").alias("kinds"), F.col("d")["days"][0].alias("days"), F.col("d")["percent"][0].alias("percent"))


T7_SQL = f"{C} SELECT asset, line, 2 AS kinds, days::DOUBLE AS days, value::DOUBLE AS percent FROM caption"


def t8_markers(spark, sf_dir):
    ship(spark)
    c = _copy(spark, sf_dir).withColumn("m", scan.marked(F.col("text"), ["水分提升", "水分"]))
    return c.select("asset", "line", F.array_join("m.words", ",").alias("words"), "m.position", "m.denied")


T8_SQL = f"""{C} SELECT asset, line, CASE WHEN kind IN (0, 4, 5) THEN '水分提升,水分' ELSE '' END AS words, CASE WHEN kind IN (0, 4, 5) THEN {AT} END AS position, CASE WHEN kind IN (0, 4, 5) THEN 0 ELSE 2 END AS denied FROM caption"""


def t9_disclosure(spark, sf_dir):
    ship(spark)
    note = F.when(F.col("value") % 5 == 0, "AI示意图").when(F.col("value") % 5 == 1, "没有AI示意图").otherwise("")
    return _copy(spark, sf_dir).select("asset", "line", scan.is_disclosed(F.concat("text", note)).alias("disclosed"))


T9_SQL = f"{C} SELECT asset, line, value % 5 = 0 AS disclosed FROM caption"


def t10_claims(spark, sf_dir):
    return cl.claim_table(_copy(spark, sf_dir), KEYS).select("asset", "line", "idx", "product", "metric", "value", "unit", "days", "version", "stance", "start", "end")


T10_SQL = f"""{C} SELECT asset, line, 0::BIGINT AS idx, 'P' || part || '精华' AS product, '水分提升' AS metric, value::DOUBLE AS value, '%' AS unit, days::DOUBLE AS days, NULL::VARCHAR AS version,
  CASE kind WHEN 1 THEN 'negated' WHEN 2 THEN 'question' WHEN 3 THEN 'quoted' ELSE 'asserted' END AS stance, 0 AS start, ({VALUE_END} + CASE kind WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 3 ELSE 0 END)::INT AS "end" FROM caption"""


def t22_special(spark, sf_dir):
    extra = F.when(F.col("value") % 3 == 0, "美白又防晒，还能美白").when(F.col("value") % 3 == 1, "防脱发").otherwise("")
    return _copy(spark, sf_dir).select("asset", "line", F.array_join(tx.special_words(F.concat("text", extra)), ",").alias("words"))


T22_SQL = f"{C} SELECT asset, line, CASE value % 3 WHEN 0 THEN '美白,防晒' WHEN 1 THEN '防脱发' ELSE '' END AS words FROM caption"


def j1_laws(spark, sf_dir):
    hits = cl.hit_table(_copy(spark, sf_dir), KEYS)
    return cl.with_laws(hits).select("asset", "line", "word", "law_key", "law", "has_case")


J1_SQL = f"""{C} SELECT asset, line, CASE kind WHEN 4 THEN '治疗' ELSE '最佳' END AS word, CASE kind WHEN 4 THEN 'medical_claim' ELSE 'absolute_claim' END AS law_key,
  CASE kind WHEN 4 THEN '《化妆品监督管理条例》第三十七条第（二）项' ELSE '《广告法》第九条' END AS law, kind = 4 AS has_case FROM caption WHERE kind IN (4, 5)"""


def a9_exposure(spark, sf_dir):
    c = _copy(spark, sf_dir)
    laws = cl.with_laws(cl.hit_table(c, KEYS)).select("asset", "line", "law_key")
    special = c.filter("value % 3 = 0").select("asset", "line", F.lit("special_category").alias("law_key"))
    return cl.exposure(laws.unionByName(special), KEYS)


A9_SQL = f"""{C}, t AS (SELECT asset, line, [x for x in [CASE WHEN kind = 4 THEN 'efficacy' END, CASE WHEN value % 3 = 0 THEN 'special_category' END, CASE WHEN kind = 5 THEN 'wording' END] if x IS NOT NULL] AS t FROM caption)
SELECT asset, line, array_to_string(t, ',') AS tiers, t[1] AS top_tier FROM t WHERE len(t) > 0"""


def _joined(c, **texts):
    """An asset's lines in order, for each text joined by line ends; null ones are left out."""
    lines = c.groupBy(F.col("asset").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("line", *(t.alias(n) for n, t in texts.items())))).alias("lines"))
    return lines.select("doc", *(F.array_join(F.col(f"lines.{n}"), "\n").alias(n) for n in texts))


def _aligned(spark, sf_dir):
    return cl.align_sides(_joined(tb.captions(spark, sf_dir), body=F.col("copy"), image=F.col("image")))


def j3_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir).select("doc", F.regexp_extract("quote", "P([0-9]+)", 1).cast("long").alias("part"), F.col("v").cast("double").alias("v"), F.col("w").cast("double").alias("w"), "status")


J3_BODY = "SELECT asset AS doc, part, value::DOUBLE AS v, image_value::DOUBLE AS w, CASE WHEN image_value IS NULL THEN 'none' WHEN image_value = value THEN 'equal' ELSE 'conflict' END AS status FROM caption WHERE kind IN (0, 4, 5)"
J3_SQL = f"{C} {J3_BODY}"


def _signals(spark, sf_dir):
    c = tb.captions(spark, sf_dir).groupBy(F.col("asset").alias("doc")).agg(F.sum("value").alias("v"), F.count("image").alias("images"))
    return c.select("doc", (F.col("v") % 7 == 0).alias("shots"), (F.col("v") % 11 == 0).alias("unedited"), (F.col("v") % 13 == 0).alias("efficacy_photo"), (F.col("v") % 5 == 0).alias("disclosed"), (F.col("images") > 0).alias("has_image"), (F.col("doc") % 17 == 0).alias("verified_ai"), (F.col("doc") % 19 == 0).alias("ai_label"), F.when(F.col("doc") % 3 > 0, F.col("doc") % 100 / 100).alias("ai_score"), F.when(F.col("doc") % 23 == 0, "likely").when(F.col("doc") % 23 == 1, "unlikely").alias("origin_status"), (F.col("doc") % 50 / 50).alias("edit_score"))


SIGNALS_SQL = """sig AS (SELECT asset AS doc, v % 7 = 0 AS shots, v % 11 = 0 AS unedited, v % 13 = 0 AS photo, v % 5 = 0 AS disclosed, n > 0 AS has_image, asset % 17 = 0 AS verified, asset % 19 = 0 AS label, asset % 23 = 0 AS likely,
  CASE WHEN asset % 3 > 0 THEN asset % 100 / 100 ELSE 0 END AS ai, asset % 50 / 50 AS edit FROM (SELECT asset, sum(value) AS v, count(image_value) AS n FROM caption GROUP BY asset))"""
J4_BODY = f"""SELECT doc, 'number' AS kind, 'medium' AS severity FROM ({J3_BODY}) WHERE status = 'conflict'
  UNION ALL SELECT doc, 'real_shot', CASE WHEN verified OR (photo AND disclosed) THEN 'hard' ELSE 'medium' END FROM sig WHERE (photo OR (shots AND NOT disclosed)) AND (verified OR label OR likely OR ai >= 0.9 OR (disclosed AND has_image))
  UNION ALL SELECT doc, 'unedited', 'medium' FROM sig WHERE unedited AND edit >= 0.9"""


def j4_contradictions(spark, sf_dir):
    return cl.contradictions(_aligned(spark, sf_dir), _signals(spark, sf_dir))


J4_SQL = f"{C}, {SIGNALS_SQL} {J4_BODY}"


def d11_conflict_levels(spark, sf_dir):
    s = _signals(spark, sf_dir)
    found = cl.contradictions(_aligned(spark, sf_dir), s)
    return cl.conflict_levels(s.withColumn("comparable", F.col("has_image")), found)


D11_SQL = f"""{C}, {SIGNALS_SQL}, j AS ({J4_BODY}), k AS (SELECT doc, count(*) FILTER (severity = 'hard') AS h, count(*) FILTER (severity = 'medium') AS m FROM j GROUP BY doc)
SELECT doc, coalesce(h, 0) AS hard, coalesce(m, 0) AS medium, CASE WHEN h > 0 THEN 'hard' WHEN m > 0 THEN 'medium' WHEN has_image THEN 'none' ELSE 'not_comparable' END AS level FROM sig LEFT JOIN k USING (doc)"""


def j5_context_conflicts(spark, sf_dir):
    c = tb.captions(spark, sf_dir)
    line = F.concat(F.lit("【P"), (F.col("asset") % 50).cast("string"), F.lit("精华】14天水分提升"), F.col("value").cast("string"), F.lit("%"))
    docs = _joined(c, text=line)
    return cl.context_conflicts(cl.claim_table(docs, ["doc"])).groupBy("doc").agg(F.count("*").alias("conflicts"))


J5_SQL = f"{C} SELECT a.asset AS doc, count(*) AS conflicts FROM caption a JOIN caption b ON a.asset = b.asset AND a.line < b.line AND a.value <> b.value GROUP BY 1"


def j6_assess(spark, sf_dir):
    c = tb.captions(spark, sf_dir)
    text = F.concat(F.lit("【P"), F.col("part").cast("string"), F.lit("精华】2024版"), F.col("days").cast("string"), F.lit("天水分提升"), F.col("value").cast("string"), F.lit("%"))
    claims = cl.claim_table(c.select((F.col("asset") * 16 + F.col("line")).alias("doc"), text.alias("text")), ["doc"])
    p = F.col("p_partkey")
    # excerpts name no version, or the reference's, or another one
    edition = F.when(p % 3 == 0, "2023版").when(p % 3 == 1, "2024版").otherwise("")
    excerpt = F.concat(F.lit("【P"), p.cast("string"), F.lit("精华】"), edition, (p % 7 + 2).cast("string"), F.lit("天水分提升"), (p % 50 + 1).cast("string"), F.lit("%"))
    refs = tb.table(spark, sf_dir, "part").select(
        p.alias("ref"), excerpt.alias("text"), F.concat(F.lit("P"), (p + (p % 11 == 0).cast("int")).cast("string"), F.lit("精华")).alias("ref_product"), F.when(p % 13 > 0, "2024版").alias("ref_version"), (p % 4 > 0).alias("reviewed"),
        F.when(p % 2 == 0, "CN").otherwise("US").alias("ref_market"), F.when(p % 5 > 0, "efficacy_study").otherwise("brand_claim").alias("ref_type"), F.array(F.lit("水分"), F.when(p % 17 == 0, "每日")).alias("stated"))
    facts = cl.claim_table(refs, [x for x in refs.columns if x != "text"])
    conflicts = c.filter("value % 29 = 0").select((F.col("asset") * 16 + F.col("line")).alias("doc"), F.lit(0).cast("long").alias("idx"))
    return cl.assess(claims, facts, conflicts, "CN").drop("idx")


J6_SQL = f"""{C}, e AS (SELECT p_partkey AS p, CASE p_partkey % 3 WHEN 0 THEN '2023版' WHEN 1 THEN '2024版' END AS said, p_partkey % 4 > 0 AS reviewed, CASE WHEN p_partkey % 13 > 0 THEN '2024版' END AS ref FROM part),
r AS (SELECT p, reviewed, ref FROM e WHERE CASE WHEN reviewed THEN p % 11 > 0 AND CASE WHEN ref IS NULL THEN said = '2024版' ELSE coalesce(said, ref) = ref END ELSE said = '2024版' END),
m AS (SELECT asset * 16 + line AS doc, value % 29 = 0 AS clash, count(p) AS matched, coalesce(bool_or(reviewed AND ref IS NOT NULL AND p % 2 = 0 AND p % 5 > 0 AND p % 17 > 0), false) AS ok,
  coalesce(bool_or(reviewed AND ref IS NOT NULL AND p % 2 = 0 AND p % 5 > 0 AND p % 17 > 0 AND p % 50 + 1 <> value), false) AS wrong FROM caption LEFT JOIN r ON p = part AND p % 7 + 2 = days GROUP BY ALL)
SELECT doc, CASE WHEN clash OR wrong THEN 'conflict' WHEN ok THEN 'supported' ELSE 'insufficient' END AS status, matched, false AS product_missing FROM m"""


def _lines(spark, sf_dir):
    d = tb.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def w3_line_offsets(spark, sf_dir):
    return cl.line_offsets(_lines(spark, sf_dir)).select("doc", "line_no", "start", "end")


_L = """l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
o AS (SELECT doc, line_no::INT AS line_no, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(t) AS n FROM l)"""
W3_SQL = f'WITH {_L} SELECT doc, line_no, start, start + n AS "end" FROM o'


def j7_span_lines(spark, sf_dir):
    spans = tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.floor(F.col("n_chars") / 4).alias("from_"), F.floor(F.col("n_chars") / 2).alias("to_"))
    return cl.span_lines(_lines(spark, sf_dir), spans).select("doc", "line_no")


J7_SQL = f"WITH {_L} SELECT doc, line_no FROM o JOIN documents ON doc_id = doc WHERE start < n_chars // 2 AND start + n > n_chars // 4"


def j11_references(spark, sf_dir):
    c = tb.captions(spark, sf_dir)
    posts = c.select((F.col("asset") * 16 + F.col("line")).alias("post"), (F.col("part") % 200).alias("product"), F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("asset") % 2 + 1).cast("int")).alias("market"), F.when(F.col("line") % 2 == 0, F.col("value") % 3).alias("version"), F.array(F.col("part"), F.col("part") + 200).alias("chosen"))
    p = F.col("p_partkey")
    refs = tb.table(spark, sf_dir, "part").select(p.alias("ref_id"), (p * 7919 % 100003).alias("ord"), (p % 200).alias("product"), F.element_at(F.array(F.lit("A"), F.lit("B")), (p % 2 + 1).cast("int")).alias("market"), F.when(p % 4 > 0, p % 3).alias("version"))
    return cl.eligible_references(posts, refs)


J11_SQL = f"""{C}, p AS (SELECT asset * 16 + line AS post, part % 200 AS product, asset % 2 AS m, CASE WHEN line % 2 = 0 THEN value % 3 END AS v, part FROM caption),
r AS (SELECT p_partkey AS ref_id, p_partkey * 7919 % 100003 AS ord, p_partkey % 200 AS product, p_partkey % 2 AS m, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 3 END AS rv FROM part),
k AS (SELECT post, ref_id, row_number() OVER (PARTITION BY post ORDER BY CASE WHEN ref_id = part THEN 1 WHEN ref_id = part + 200 THEN 2 ELSE 9 END, ord) AS place, count(*) OVER (PARTITION BY post) AS total FROM p JOIN r USING (product, m) WHERE v IS NULL OR rv IS NULL OR v = rv)
SELECT * FROM k WHERE place <= 8"""


def j12_anchors(spark, sf_dir):
    """Findings on documents: a third cites an excerpt of the benchmark table, some of an unknown one; some quotes are made up, ambiguous or blank."""
    k = F.col("doc_id")
    refs = tb.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ref_id"), F.col("text").alias("excerpt"), F.concat(F.lit("study "), F.col("item_id").cast("string")).alias("source"), F.lit("efficacy_study").alias("source_type"), F.when(F.col("item_id") % 2 == 0, "p. 1").alias("locator"),
        *(F.when(F.col("item_id") % 3 == i % 3, F.lit(c)).otherwise(F.lit("" if i % 2 else None)).alias(c) for i, c in enumerate(cl.CONDITIONS)))
    d = tb.table(spark, sf_dir, "documents").withColumn("ref_id", F.when(k % 3 == 0, k % 60)).join(refs.select("ref_id", "excerpt"), "ref_id", "left")
    place = F.coalesce(F.when(k % 3 == 0, F.col("excerpt")), F.col("text"))
    rows = d.select(
        k.alias("doc"), "text", F.expr("substring(text, cast(1 + doc_id % 50 as int), 12)").alias("quote"), F.when(k % 9 == 1, F.lit("made up ~")).when(k % 31 == 0, F.lit(" ")).otherwise(F.substring(place, F.lit(3) + (k % 40).cast("int"), F.lit(14))).alias("other_quote"), "ref_id",
        F.element_at(F.array(F.lit("fact"), F.lit("tone"), F.lit("other")), (k % 5 % 3 + 1).cast("int")).alias("type"), F.when(k % 37 == 0, "\n ").otherwise(F.col("text")).alias("reason"))
    found = cl.anchored(rows, refs, ("fact", "tone"), "fact")
    return found.select("doc", "type", "quote", "other_quote", F.length("reason").alias("reason_chars"), "ref_id", "source", "source_type", "locator", F.array_join(F.map_keys("reference_conditions"), ",").alias("conditions"))


_GIVEN = ", ".join(f"CASE WHEN ref % 3 = {i % 3} THEN '{c}' END" for i, c in enumerate(cl.CONDITIONS))
J12_SQL = f"""WITH r AS (
  SELECT d.doc_id AS doc, d.text, substring(d.text, 1 + doc_id % 50, 12) AS quote, CASE WHEN doc_id % 3 = 0 THEN doc_id % 60 END AS ref, b.text AS excerpt, b.item_id,
         CASE WHEN doc_id % 9 = 1 THEN 'made up ~' WHEN doc_id % 31 = 0 THEN ' ' ELSE substring(coalesce(CASE WHEN doc_id % 3 = 0 THEN b.text END, d.text), 3 + doc_id % 40, 14) END AS other_quote,
         ['fact', 'tone', 'fact'][doc_id % 5 % 3 + 1] AS type, CASE WHEN doc_id % 37 = 0 THEN chr(10) || ' ' ELSE d.text END AS reason
  FROM documents d LEFT JOIN benchmark b ON b.item_id = doc_id % 60 AND doc_id % 3 = 0),
a AS (SELECT *, CASE WHEN ref IS NULL THEN text ELSE excerpt END AS place FROM r WHERE regexp_matches(quote, '[^\\s]') AND regexp_matches(other_quote, '[^\\s]') AND regexp_matches(reason, '[^\\s]'))
SELECT doc, type, quote, other_quote, least(500, length(reason)) AS reason_chars, ref::VARCHAR AS ref_id, CASE WHEN ref IS NULL THEN '正文' ELSE 'study ' || ref END AS source, CASE WHEN ref IS NOT NULL THEN 'efficacy_study' END AS source_type,
       CASE WHEN ref % 2 = 0 THEN 'p. 1' END AS locator, CASE WHEN ref IS NULL THEN '' ELSE concat_ws(',', {_GIVEN}) END AS conditions
FROM a WHERE length(text) - length(replace(text, quote, '')) = length(quote) AND length(place) - length(replace(place, other_quote, '')) = length(other_quote) AND (ref IS NULL OR item_id IS NOT NULL) AND (ref IS NOT NULL OR quote <> other_quote)"""


def j13_attribution(spark, sf_dir):
    c = tb.captions(spark, sf_dir)
    name = F.concat(F.lit("P"), F.col("part").cast("string"), F.lit("精华"))
    text = F.concat(name, F.lit("："), F.col("days").cast("string"), F.lit("天水分提升"), F.col("value").cast("string"), F.lit("%"))
    docs = c.select((F.col("asset") * 16 + F.col("line")).alias("doc"), text.alias("text"), name.alias("name"), "part")
    rows = docs.select("doc", F.col("text").alias("row_quote"), F.explode(F.when(F.col("part") % 3 == 0, F.array("name")).when(F.col("part") % 3 == 1, F.array("name", F.lit("精华"))).otherwise(F.array(F.lit("精华")))).alias("row_product"))
    return cl.attributed(cl.claim_table(docs, ["doc"]), rows).select("doc", "metric", "product")


J13_SQL = f"{C} SELECT asset * 16 + line AS doc, '水分提升' AS metric, CASE WHEN part % 3 < 2 THEN 'P' || part || '精华' END AS product FROM caption"


QUERIES = {
    "t1_clauses": (t1_clauses, T1_SQL), "t2_stance": (t2_stance, T2_SQL), "t3_lexicon": (t3_lexicon, T3_SQL), "t4_rollup": (t4_rollup, T4_SQL), "t7_dimensions": (t7_dimensions, T7_SQL), "t8_markers": (t8_markers, T8_SQL),
    "t9_disclosure": (t9_disclosure, T9_SQL), "t10_claims": (t10_claims, T10_SQL), "t22_special": (t22_special, T22_SQL), "j1_laws": (j1_laws, J1_SQL), "a9_exposure": (a9_exposure, A9_SQL),
    "j3_alignment": (j3_alignment, J3_SQL), "j4_contradictions": (j4_contradictions, J4_SQL), "d11_conflict_levels": (d11_conflict_levels, D11_SQL), "j5_context_conflicts": (j5_context_conflicts, J5_SQL),
    "j6_assess": (j6_assess, J6_SQL), "w3_line_offsets": (w3_line_offsets, W3_SQL), "j7_span_lines": (j7_span_lines, J7_SQL), "j11_references": (j11_references, J11_SQL), "j12_anchors": (j12_anchors, J12_SQL), "j13_attribution": (j13_attribution, J13_SQL),
}
