"""Claims: rollups, laws, alignment of copy and image, conflicts, references.

A claim row has keys, idx (its place in the document's order), quote, start, end, product, version,
days, population, conditions, metric, variant, value, shade, unit and stance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import scan
from ..functions.ranking import summed_before
from ..functions.shipping import ship
from ..sources.io import written


def claim_table(texts: DataFrame, keys: list[str], text: str = "text", product: Column | None = None, plain: str = scan.PLAIN) -> DataFrame:
    """Keys, idx (rises through the text, with gaps) and a claim's fields, for each claim of the texts.

    Texts without a word that a claim needs end before any pattern is tried; those of plain
    characters (a pattern) are scanned for a batch at once. Places of matches are those in the
    clause's compatible form.
    """
    ship(texts.sparkSession)
    given = F.lit(None).cast("string") if product is None else product
    rows = scan.claim_rows(texts.select(*keys, F.col(text).alias("_text"), given.alias("_given")), keys, plain)
    m = {name.split()[0]: F.col(f"_{name.split()[0]}") for name in scan.CLAIM_ROW.split(", ")}
    quote, line = m["quote"], F.coalesce(m["line"], m["quote"])
    m["line"] = line
    said = scan.stated(m)
    rows = rows.filter(said["real"])
    none = F.array().cast("array<string>")
    fields = {
        "idx": m["nth"].cast("long") * (1 << 20) + m["entry"] * (1 << 14) + m["k"], "quote": F.when(m["trim"], scan.stripped(quote)).otherwise(quote), "start": m["start"], "end": m["start"] + F.length(quote),
        "product": F.coalesce(m["own"], scan.product_of(m, m["known"])), "version": F.when(scan.may(m, scan.MAY_EDITION), scan.version_of(line)),
        "days": F.when(said["timed"] & (m["periods"].isNull() | (m["periods"] > 0)), F.when(m["periods"] == 1, m["days"]).otherwise(scan.days_of(line))),
        "population": F.when(scan.may(m, scan.MAY_PEOPLE), scan.sorted_set(line, lx.PEOPLE)).otherwise(none), "conditions": F.when(scan.may(m, scan.MAY_TERMS), scan.sorted_set(line, lx.TERMS)).otherwise(none),
        **{c: said[c] for c in ("metric", "variant", "value", "shade", "unit")}, "stance": scan.stance(m),
    }
    return rows.select(*keys, *(x.alias(name) for name, x in fields.items()))


def hit_table(texts: DataFrame, keys: list[str], text: str = "text", **lists) -> DataFrame:
    """Keys and the fields of each lexicon hit."""
    ship(texts.sparkSession)
    return texts.select(*keys, F.explode(scan.scanned(F.col(text), **lists)).alias("h")).select(*keys, "h.*")


def hit_rollup(texts: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """T4: counts by severity, the level and the top hit's word, for every text."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    by = hits.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "review")), F.min(F.struct(rank.alias("r"), "position", "word")).alias("top"))
    out = texts.select(*keys).join(by, keys, "left").na.fill(0, ["high", "medium", "review"])
    level = F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("none")
    return out.select(*keys, "high", "medium", "review", level.alias("level"), F.col("top.word").alias("top_word"))


def law_rows(spark) -> DataFrame:
    """The law catalogue and the categories that map to it."""
    laws = spark.createDataFrame(lx.LAWS, "law_key string, law string, has_case boolean")
    return spark.createDataFrame(list(lx.CLAIM_LAW.items()), "category string, law_key string").join(laws, "law_key")


def with_laws(hits: DataFrame) -> DataFrame:
    """Hits with law_key, law, has_case of their category; the catalogue is a fixed list."""
    return hits.join(F.broadcast(law_rows(hits.sparkSession)), "category", "left")


def exposure(keys: DataFrame, key: list[str]) -> DataFrame:
    """For rows (key, law_key) the tiers that apply, from the highest, and the top one."""
    by = keys.groupBy(*key).agg(F.collect_set("law_key").alias("ks"))
    tiers = F.array_compact(F.array(*(F.when(F.arrays_overlap("ks", F.array(*map(F.lit, ls))), F.lit(name)) for name, ls in lx.TIERS)))
    return by.withColumn("tiers", tiers).select(*key, F.array_join("tiers", ",").alias("tiers"), F.get("tiers", F.lit(0)).alias("top_tier"))


def is_usable() -> Column:
    """Can the claim be compared at all: asserted, of a product, with a value, of one version, and for two metrics of a period or an instant."""
    timed = ~F.col("metric").isin("水分提升", "斑点减少") | F.col("days").isNotNull() | F.arrays_overlap("conditions", F.array(F.lit("即时"), F.lit("即刻")))
    has_value = F.col("value").isNotNull() | F.col("shade").isNotNull()
    return (F.col("stance") == "asserted") & (F.coalesce("product", F.lit("")) != "") & has_value & (F.coalesce("version", F.lit("")) != "ambiguous") & timed


KEY = ("product", "metric", "variant", "unit", "days", "population", "conditions", "version")


def comparable_key() -> Column:
    """One value for the fields that must agree, nulls included; null for a claim that can't be compared."""
    return F.when(is_usable(), F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}))


def value_text() -> Column:
    return F.coalesce("shade", F.col("value").cast("string"))


def comparable(claims: DataFrame, *more: str) -> DataFrame:
    """What J3 needs of claims: doc, idx, quote, stance, v (the value), key (of J2, null for a claim that can't be compared), and more columns."""
    return claims.select("doc", "idx", "quote", "stance", value_text().alias("v"), comparable_key().alias("key"), *more)


def align(body: DataFrame, image: DataFrame) -> DataFrame:
    """Each asserted body claim with a value: equal, conflict, or none / many candidates in its document's image."""
    return _aligned(comparable(body), comparable(image))


def align_sides(texts: DataFrame, body: str = "body", image: str = "image") -> DataFrame:
    """J3 for texts (doc, a column of body text, one of image text): claims of both sides come from one scan and are written once, then meet as in align."""
    sides = F.array(*(F.struct(F.lit(name).alias("side"), F.col(c).alias("text")) for name, c in (("body", body), ("image", image))))
    each = texts.select("doc", F.explode(sides).alias("_s")).select("doc", "_s.side", "_s.text")
    claims = written(comparable(claim_table(each, ["doc", "side"]), "side"), "claim-sides")
    return _aligned(claims.filter("side = 'body'"), claims.filter("side = 'image'"))


def _aligned(body: DataFrame, image: DataFrame) -> DataFrame:
    left = body.filter("stance = 'asserted' and v is not null").select("doc", "idx", "quote", "v", "key")
    # candidates fold to a count and one value before the join
    other = image.filter("key is not null").groupBy("doc", "key").agg(F.count("*").alias("n"), F.min("v").alias("w"))
    found = left.join(other, ["doc", "key"], "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "none").when(F.col("n") > 1, "many").when(F.col("v") == F.col("w"), "equal").otherwise("conflict")
    return found.select("doc", "idx", "quote", "v", F.when(F.col("n") == 1, F.col("w")).alias("w"), status.alias("status"))


def contradictions(aligned: DataFrame, docs: DataFrame) -> DataFrame:
    """Doc, kind, severity. docs: doc, shots and unedited (asserted markers), efficacy_photo, disclosed, has_image, verified_ai, ai_label, origin_status (of a calibrated detector, or null), ai_score, edit_score."""
    numeric = aligned.filter("status = 'conflict'").select("doc", F.lit("number").alias("kind"), F.lit("medium").alias("severity"))
    shown = F.col("verified_ai") | F.col("ai_label") | (F.coalesce("origin_status", F.lit("")) == "likely") | (F.coalesce("ai_score", F.lit(0.0)) >= lx.LIMITS["aigc_high"]) | (F.col("disclosed") & F.col("has_image"))
    photo = (F.col("efficacy_photo") | (F.col("shots") & ~F.col("disclosed"))) & shown
    hard = F.col("verified_ai") | (F.col("efficacy_photo") & F.col("disclosed"))
    shots = docs.filter(photo).select("doc", F.lit("real_shot").alias("kind"), F.when(hard, "hard").otherwise("medium").alias("severity"))
    edits = docs.filter(F.col("unedited") & (F.coalesce("edit_score", F.lit(0.0)) >= lx.LIMITS["edit_high"])).select("doc", F.lit("unedited").alias("kind"), F.lit("medium").alias("severity"))
    return numeric.unionByName(shots).unionByName(edits)


def conflict_levels(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Hard and medium counts and the level of each doc (docs: doc, comparable)."""
    by = found.groupBy("doc").agg(F.count_if(F.col("severity") == "hard").alias("hard"), F.count_if(F.col("severity") == "medium").alias("medium"))
    out = docs.select("doc", "comparable").join(by, "doc", "left").na.fill(0, ["hard", "medium"])
    level = F.when(F.col("hard") > 0, "hard").when(F.col("medium") > 0, "medium").when(F.col("comparable"), "none").otherwise("not_comparable")
    return out.select("doc", "hard", "medium", level.alias("level"))


def context_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of claims of a document that are comparable, in different clauses, with different values."""
    rows = claims.select("doc", "idx", "start", comparable_key().alias("key"), value_text().alias("v")).filter("key is not null")
    a, b = (rows.select("doc", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("idx", "start", "v"))) for s in "ab")
    return a.join(b, ["doc", "key"]).filter("idx_a < idx_b and start_a <> start_b and v_a <> v_b").select("doc", "idx_a", "idx_b", "v_a", "v_b")


def bound_facts(facts: DataFrame) -> DataFrame:
    """Facts of references that count: of a reviewed reference only those of its own product and of no other version, which take its version.

    facts: claims of excerpts with ref_product, ref_version (or null) and reviewed.
    """
    versioned = F.col("reviewed") & (F.coalesce("ref_version", F.lit("")) != "")
    own = ~F.col("reviewed") | ((F.col("product") == F.col("ref_product")) & (~versioned | F.col("version").isNull() | (F.col("version") == F.col("ref_version"))))
    return facts.filter(F.coalesce(own, F.lit(False))).withColumn("version", F.when(versioned, F.col("ref_version")).otherwise(F.col("version")))


def assess(claims: DataFrame, facts: DataFrame, conflicts: DataFrame, market: str) -> DataFrame:
    """Status of each asserted claim: conflict, supported or insufficient.

    facts: claims of references with ref_product, ref_version, ref_market, ref_type, reviewed and
    stated (phrases that a quote must contain, null ones aside). conflicts: doc, idx of claims that
    contradict the image.
    """
    # a claim without a key has one that no fact has, so that such claims are spread over the tasks
    alone = F.concat_ws("#", F.lit(""), "doc", "idx")
    left = claims.filter("stance = 'asserted'").select("doc", "idx", "product", "quote", F.coalesce(comparable_key(), alone).alias("key"), value_text().alias("v"))
    right = bound_facts(facts).select(comparable_key().alias("key"), value_text().alias("w"), "ref_market", "ref_type", "reviewed", "stated", F.col("ref_version").alias("of")).filter("key is not null")
    fits = F.col("reviewed") & (F.col("ref_type") == "efficacy_study") & (F.col("ref_market") == market) & (F.coalesce("of", F.lit("")) != "") & ~F.col("of").isin("新版", "旧版") & F.forall(F.array_compact("stated"), lambda s: F.contains("quote", s))
    by = left.join(right, "key", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    by = by.groupBy("doc", "idx", "product").agg(F.count("w").alias("matched"), F.bool_or("fits").alias("ok"), F.bool_or(F.col("fits") & (F.col("v") != F.col("w"))).alias("wrong"))
    out = by.join(conflicts.select("doc", "idx", F.lit(True).alias("clash")).distinct(), ["doc", "idx"], "left")
    status = F.when(F.coalesce("clash", F.lit(False)) | F.coalesce("wrong", F.lit(False)), "conflict").when(F.col("ok"), "supported").otherwise("insufficient")
    return out.select("doc", "idx", status.alias("status"), "matched", ((status == "insufficient") & F.col("product").isNull()).alias("product_missing"))


def line_offsets(lines: DataFrame) -> DataFrame:
    """Lines (doc, line_no, text) with start and end in the text joined by line ends. A null text has no end and takes no place.

    The sums go by blocks of lines, so a document of very many lines is no single task.
    """
    sized = lines.withColumn("_size", F.length("text"))  # so that texts move only where they are asked for
    return summed_before(sized, "doc", "line_no", F.col("_size") + 1, "start").withColumn("end", F.col("start") + F.col("_size")).drop("_size")


#: Characters of a bin in which lines and spans of a document meet.
SPAN_BIN = 4096


def span_lines(lines: DataFrame, spans: DataFrame, width: int = SPAN_BIN) -> DataFrame:
    """Doc, line_no, start and end of the lines that a span (doc, from_, to_, more columns) touches, with the span's columns.

    A line and a span meet in the bins of offsets that both reach, and count in the first of these
    alone, so lines and spans that are far apart never meet and no pair comes twice. An empty line
    or span is touched inside the other, not at its ends; a span that ends before it starts, or has
    no end, touches nothing.
    """
    def bins(at: str, to: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(at) / width), F.floor(F.col(to) / width)))

    placed = line_offsets(lines).filter("end is not null").select("doc", "line_no", "start", "end", bins("start", "end").alias("_bin"))
    asked = spans.filter("from_ <= to_").select("*", bins("from_", "to_").alias("_bin"))
    first = F.floor(F.greatest("start", "from_") / width)
    return placed.join(asked, ["doc", "_bin"]).filter((F.col("start") < F.col("to_")) & (F.col("end") > F.col("from_")) & (F.col("_bin") == first)).drop("_bin")


def eligible_references(posts: DataFrame, refs: DataFrame, keep: int = 8) -> DataFrame:
    """References of a post's product and market and a compatible version: chosen ones first, then in catalogue order; total before the cut.

    posts: post (unique), product, market, version (or null), chosen (ids in order); refs: ref_id
    (unique), ord, product, market, version. A version that is null is compatible with any.
    A post meets lists of at most keep references, made once for each product, market and version,
    and its own chosen ones by an equi-join on ref_id; so a product with very many references and
    posts has no row for each pair of them.
    """
    place, key = F.struct("ord", "ref_id"), ["product", "market"]

    def firsts(df: DataFrame, by: list[str]) -> DataFrame:
        """The keep first references by a key, as rows; the limit is applied before rows are shuffled."""
        w = Window.partitionBy(*by).orderBy("ord", "ref_id")
        return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")

    def lists(df: DataFrame, by: list[str], name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.array_sort(F.collect_list(place)).alias(name))

    counts = refs.groupBy(*key, "version").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*key).agg(F.sum("n").alias("all_n"), F.coalesce(F.sum(F.when(F.col("version").isNull(), F.col("n"))), F.lit(0)).alias("open_n"))
    best = firsts(refs.select(*key, "version", "ord", "ref_id"), [*key, "version"])
    by_product = totals.join(lists(firsts(best, key), key, "all_list"), key).join(lists(best.filter("version is null"), key, "open_list"), key, "left")
    by_version = counts.filter("version is not null").join(lists(best.filter("version is not null"), [*key, "version"], "own_list"), [*key, "version"]).withColumnRenamed("n", "own_n")
    met = posts.join(by_product, key).join(by_version, [*key, "version"], "left")
    none = F.slice("all_list", 1, 0)
    some = met.select(
        "post", *key, "version", "chosen", F.when(F.col("version").isNull(), F.col("all_n")).otherwise(F.col("open_n") + F.coalesce("own_n", F.lit(0))).alias("total"),
        F.when(F.col("version").isNull(), F.col("all_list")).otherwise(F.slice(F.array_sort(F.concat(F.coalesce("open_list", none), F.coalesce("own_list", none))), 1, keep)).alias("listed"))
    asked = some.select("post", *key, "version", F.posexplode(F.array_distinct("chosen")).alias("nth", "ref_id"))
    r = refs.select("ref_id", *(F.col(c).alias(f"ref_{c}") for c in (*key, "version")))
    fits = (F.col("product") == F.col("ref_product")) & (F.col("market") == F.col("ref_market")) & (F.col("version").isNull() | F.col("ref_version").isNull() | (F.col("version") == F.col("ref_version")))
    chosen = asked.join(r, "ref_id").filter(fits).groupBy("post").agg(F.array_sort(F.collect_list(F.struct("nth", "ref_id"))).alias("picked"))
    out = some.join(chosen, "post", "left").withColumn("first", F.coalesce(F.col("picked.ref_id"), F.slice("listed.ref_id", 1, 0)))
    rest = F.filter(F.col("listed.ref_id"), lambda x: ~F.array_contains("first", x))
    return out.select("post", "total", F.posexplode(F.slice(F.concat("first", rest), 1, keep)).alias("place", "ref_id")).select("post", "ref_id", (F.col("place") + 1).alias("place"), "total")


#: What of a reference goes with a finding, where it is given.
CONDITIONS = ("version", "product_version", "market", "method", "sample", "population", "period", "conditions")


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlap, from the left; null for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long"))


def anchored(rows: DataFrame, refs: DataFrame, types: tuple[str, ...], default: str, body: str = "正文", longest: int = 500) -> DataFrame:
    """Model findings whose two quotes each stand exactly once where they should.

    rows: doc, text, quote, other_quote, ref_id (null or empty: none), type, reason; refs: ref_id
    (unique), excerpt, source, source_type, locator and CONDITIONS, as strings. quote must stand once in
    the text; other_quote once in the reference's excerpt or, without a reference, in the text, and
    differ from quote. Blank quotes or reasons and unknown references are refused; unknown types
    become the default, and reasons are cut. Result: doc, type, quote, other_quote, reason, ref_id,
    source, source_type, locator, reference_conditions (a map of those that are given).
    """
    said = [F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False)) for c in ("quote", "other_quote", "reason")]
    asked = rows.filter(reduce(Column.__and__, said)).withColumn("ref_id", F.nullif(F.col("ref_id").cast("string"), F.lit("")))
    asked = asked.filter(occurrences(F.col("text"), F.col("quote")) == 1)  # before texts meet references
    known = refs.select(F.col("ref_id").cast("string").alias("ref_id"), "excerpt", F.col("source").alias("ref_source"), "source_type", "locator", *CONDITIONS, F.lit(True).alias("there"))
    found = asked.join(known, "ref_id", "left").filter("ref_id is null or there")
    once = occurrences(F.coalesce("excerpt", F.when(F.col("ref_id").isNull(), F.col("text"))), F.col("other_quote")) == 1
    found = found.filter(once & (F.col("ref_id").isNotNull() | (F.col("quote") != F.col("other_quote"))))
    given = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in CONDITIONS)), lambda x: F.length(x["value"]) > 0))
    return found.select(
        "doc", F.when(F.col("type").isin(*types), F.col("type")).otherwise(default).alias("type"), "quote", "other_quote", F.substring("reason", 1, longest).alias("reason"), "ref_id",
        F.when(F.col("ref_id").isNull(), F.lit(body)).otherwise(F.col("ref_source")).alias("source"), "source_type", "locator", given.alias("reference_conditions"))


def attributed(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts with the product that exactly one product among the document's model rows (doc, row_quote, row_product) names inside the fact's quote."""
    open_ = facts.filter("product is null").select("doc", "idx", "quote")
    named = open_.join(rows.filter("trim(row_product) <> ''"), "doc").filter(F.contains("row_quote", F.col("quote"))).withColumn("p", F.trim("row_product"))
    named = named.filter(scan.names_product(F.col("quote"), F.col("p")))
    only = named.groupBy("doc", "idx").agg(F.countDistinct("p").alias("n"), F.min("p").alias("p")).filter("n = 1").select("doc", "idx", "p")
    return facts.join(only, ["doc", "idx"], "left").withColumn("product", F.coalesce("product", "p")).drop("p")


def uncovered_rows(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Model rows (doc, row_quote, row_metric, row_product) that no asserted fact of the document covers."""
    f = facts.filter("stance = 'asserted'").select("doc", F.col("quote").alias("q"), F.col("metric").alias("m"))
    covered = F.contains("row_quote", F.col("m")) & (F.contains("row_quote", F.col("q")) | F.contains("q", F.col("row_quote")))
    return rows.filter(F.contains("row_quote", F.col("row_metric"))).join(f, (rows["doc"] == f["doc"]) & covered, "left_anti")
