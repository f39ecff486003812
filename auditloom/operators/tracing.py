"""Source tracing and credentials: watermarks, visible labels, metadata tags, report and reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx

# fixed values: visible labels, as patterns over lower-cased text without white space, or with single blanks
LABELS_CN = ["ai生成", "ai绘制", "ai创作", "ai合成", "ai出图", "人工智能生成", "人工智能绘制", "由ai生成", "本图.{0,4}ai", "ai辅助生成", "aigc生成"]
LABELS_EN = [r"generated\s*by\s*ai", r"ai[\s_-]?generated", r"made\s*with\s*ai", r"created\s*by\s*ai", r"ai[\s_-]?artificial", r"synthetic\s*image"]
GENERATORS = ["workbuddy", "即梦", "jimeng", "midjourney", "stable diffusion", "stablediffusion", "dall·e", "dalle", "dall-e", "flux", "leonardo", "liblib", "可画", "midjouney"]
LABEL_CONFIDENCE = 0.85
SECTIONS = ["## 一、结论", "## 二、检测依据", "## 三、这些工具说不清什么", "## 四、建议"]
FORBIDDEN = ["确认为伪造", "确认造假", "一定是假的", "已经被篡改", "证实为"]


def handle(line: Column) -> Column:
    """The account that a line shows, by the first pattern that matches; null for official lines."""
    t = F.trim(line)
    found = F.lit(None).cast("string")
    for p in reversed(lx.WATERMARKS):
        found = F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 1))).otherwise(found)
    return F.when(~t.rlike(lx.OFFICIAL_LINE), F.nullif(found, F.lit("")))


def watermarks(lines: DataFrame) -> DataFrame:
    """Asset, handle, line_no: distinct handles with their first line."""
    return lines.select("asset", "line_no", handle(F.col("text")).alias("handle")).filter("handle is not null").groupBy("asset", "handle").agg(F.min("line_no").alias("line_no"))


def labels(lines: DataFrame) -> DataFrame:
    """By asset: lines, label hits, accepted ones, and the best accepted text with its generator hint."""
    norm, flat = F.lower(F.regexp_replace("text", r"[\s\p{Z}]+", "")), F.lower(F.regexp_replace("text", r"[\s\p{Z}]+", " "))
    hit = norm.rlike("|".join(LABELS_CN)) | flat.rlike("|".join(LABELS_EN))
    sure = hit & (F.coalesce("confidence", F.lit(0.0)) >= LABEL_CONFIDENCE)
    hint = F.coalesce(*(F.when(F.contains(flat, F.lit(g)), F.lit(g)) for g in GENERATORS))
    rows = lines.select("asset", hit.alias("hit"), F.when(sure, F.struct("confidence", (-F.col("line_no")).alias("o"), "text", hint.alias("hint"))).alias("good"))
    return rows.groupBy("asset").agg(F.count("*").alias("lines"), F.count_if("hit").alias("hits"), F.count("good").alias("accepted"), F.max("good").alias("b")).select("asset", "lines", "hits", "accepted", F.col("b.text").alias("best"), F.col("b.hint").alias("hint"))


def declared_tag(metadata: Column) -> tuple[Column, Column]:
    """The label inside the metadata tag, and does it say generated; unparsable content counts as present without a label."""
    body = F.trim(F.replace(F.regexp_extract(metadata, r"(?s)<TC260:AIGC>(.*?)</TC260:AIGC>", 1), F.lit("&quot;"), F.lit('"')))
    there = F.contains(metadata, F.lit("<TC260:AIGC>")) & F.contains(metadata, F.lit("</TC260:AIGC>"))
    label = F.get_json_object(body, "$.Label")
    return F.when(there, label), F.when(there, F.coalesce(label == "1", F.lit(False)))


def _has(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.greatest(*(F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def credential_status(stdout: Column, stderr: Column, code: Column) -> tuple[Column, Column]:
    """Error, missing, present_unverified or present_verified, and is the content declared generated. Output that hints at no manifest is missing, whatever else it has."""
    found = F.coalesce(F.get_json_object(stdout, "$.active_manifest"), F.get_json_object(stdout, "$.manifest"))
    manifest = F.when(F.coalesce(found, F.lit("")).startswith("{"), F.lower(found))
    verified = F.lower(F.coalesce(F.get_json_object(stdout, "$.validation_status"), F.lit(""))) == "valid"
    says = F.coalesce(F.contains(manifest, F.lit("ai-generated")) | F.contains(manifest, F.lit("ai_generated")) | F.contains(manifest, F.lit("is_ai")) | F.contains(manifest, F.lit('"ai"')), F.lit(False))
    status = F.when(_has(stderr, lx.NO_TOOL), "error").when((code != 0) | (F.coalesce(stdout, F.lit("")) == "") | _has(F.lower(F.concat(F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))), lx.NO_MANIFEST) | manifest.isNull(), "missing").when(verified, "present_verified").otherwise("present_unverified")
    return status, says & status.startswith("present")


def report_checks(reports: DataFrame) -> DataFrame:
    """Asset, check, passed for the six checks of each report.

    reports: asset, text, level, ela, ai_score, tools (array of tool, title or null, cannot_prove or
    null: what evidence there is). Every tool must be cited by title or by its name in capitals, and
    the start of what each can't prove must be in the text; a report without evidence cites none.
    """
    text = F.col("text")
    whole, words = F.lit(True), F.lit(True)
    for s in SECTIONS:
        whole = whole & F.contains(text, F.lit(s))
    for p in FORBIDDEN:
        words = words & ~F.contains(text, F.lit(p))
    backed = F.when(F.col("level") == "suspicious", F.coalesce("ela", F.lit(0.0)) >= lx.LIMITS["ela"]).when(F.col("level") == "high_risk", F.coalesce(F.col("ai_score") >= lx.LIMITS["aigc_high"], F.lit(False))).otherwise(True)
    cited = F.forall("tools", lambda t: ((F.coalesce(t["title"], F.lit("")) != "") & F.contains(text, F.coalesce(t["title"], F.lit("")))) | F.contains(text, F.upper(t["tool"])))
    bounds = F.forall("tools", lambda t: F.contains(text, F.substring(F.coalesce(t["cannot_prove"], F.lit("")), 1, 20)))
    cells = {"sections": whole, "level": F.coalesce(F.col("level").isin(*lx.LEVELS), F.lit(False)), "tools": cited & (F.size("tools") > 0), "backed": backed, "limits": bounds, "wording": words}
    return reports.select("asset", F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in cells.items()))).alias("c")).select("asset", "c.*")


def claim_lines(lines: DataFrame, least: float = 0.7) -> DataFrame:
    """Lines sure enough for claims; a missing confidence is accepted."""
    return lines.filter(F.coalesce("confidence", F.lit(1.0)) >= least)


def trace_lines(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines sure enough for tracing; a missing confidence is rejected."""
    return lines.filter(F.coalesce("confidence", F.lit(0.0)) >= least)


def reference_violations(refs: DataFrame, types: tuple[str, ...] = ("efficacy_study", "product_label", "brand_claim", "method"), longest: int = 10_000) -> DataFrame:
    """Id and violations of reference rows; rows without any are fit for the catalogue."""
    fields = ("id", "source", "excerpt", "product", "version", "locator", "reviewer")
    blank = F.lit(False)
    for f in fields:
        blank = blank | (F.coalesce(F.trim(F.col(f)), F.lit("")) == "")
    twice = refs.groupBy("id").agg(F.count("*").alias("k"))
    long = F.greatest(*(F.coalesce(F.length(f), F.lit(0)) for f in fields)) > longest
    cells = {"blank": blank, "type": ~F.coalesce(F.col("source_type").isin(*types), F.lit(True)), "long": long, "duplicate": F.col("k") > 1}
    return refs.join(twice, "id").select("id", F.concat_ws(",", *(F.when(c, F.lit(k)) for k, c in cells.items())).alias("violations"))


def category_conflicts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc's and image's categories and brands: shared, only in the text, and is there a category conflict. docs: asset, text; lines: asset, line_no, text."""
    image = lines.groupBy("asset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("shown"))
    rows = docs.join(image, "asset", "left").na.fill("", ["shown"])
    rows = rows.withColumns({"tc": tx.categories(F.col("text")), "oc": tx.categories(F.col("shown")), "tb": tx.brands(F.col("text")), "ob": tx.brands(F.col("shown"))})
    clash = (F.size("tc") > 0) & (F.size("oc") > 0) & ~F.arrays_overlap("tc", "oc")
    return rows.select("asset", F.array_join("tc", ",").alias("text_categories"), F.array_join("oc", ",").alias("image_categories"), clash.alias("conflict"), F.array_join(F.array_intersect("tb", "ob"), ",").alias("shared_brands"), F.array_join(F.array_except("tb", "ob"), ",").alias("text_only_brands"))
