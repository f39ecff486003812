"""Decisions over joined evidence: ordered rules as columns, and the queue that follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import let
from ..sources.io import written
from .evaluate import every

L = lx.LIMITS


def image_signals(evidence: DataFrame, profiles: DataFrame, decision_model: str = "origin_v4") -> DataFrame:
    """Score only if available, decision score only for the decision model without a profile, and the status by an approved profile of the same model, weights and preprocessing.

    evidence: asset, model, weights, preprocessing, available, review_only, raw_score; profiles:
    model, weights, preprocessing, low, high, approved. A profile counts if 0 <= low <= high <= 1 and
    its identity is given; where several that differ have one identity, none does.
    """
    key = ["model", "weights", "preprocessing"]
    valid = profiles.filter(every(F.col("approved"), F.col("low") >= 0, F.col("low") <= F.col("high"), F.col("high") <= 1, *(F.length(c) > 0 for c in key)))
    bounds = valid.groupBy(*key).agg(F.min(F.struct("low", "high")).alias("a"), F.max(F.struct("low", "high")).alias("b")).filter("a = b").select(*key, "a.low", "a.high")
    rows = evidence.join(bounds, key, "left")
    score = F.when(F.coalesce("available", F.lit(True)), F.col("raw_score"))
    status = F.when(score.isNull(), "unavailable").when(F.col("low").isNull(), "uncalibrated").when(score >= F.col("high"), "likely").when(score >= F.col("low"), "uncertain").otherwise("no_signal")
    return rows.select("asset", score.alias("score"), F.when((F.col("model") == decision_model) & ~F.col("review_only") & F.col("low").isNull(), score).alias("decision_score"), status.alias("status"))


def judged(e: DataFrame) -> DataFrame:
    """Level and the reason of each asset, by rules in order: the first that holds decides.

    e: asset, has_text, conflict (hard, medium or null), disclosed, ai_score, spectral, edit_score,
    edit_review_only, claims_high, claims_medium, ela, declares_ai, verified. A strong spectral score
    with a detector score under the gray range raises nothing, while a gray one does.
    """
    ai, sp, ed = F.col("ai_score"), F.col("spectral"), F.when(~F.col("edit_review_only"), F.col("edit_score"))
    shown, text = F.col("disclosed"), F.col("has_text")
    hard_ai = (ai >= L["aigc_hard"]) & ~shown
    likely = (ai >= L["aigc_high"]) & ~shown
    strong, gray = sp >= L["spectral_strong"], (sp >= L["spectral_gray"]) & (sp < L["spectral_strong"])
    unsure = (ai >= L["aigc_abstain"]) & (ai < L["aigc_high"])
    flagged = F.coalesce(likely, F.lit(False)) | F.coalesce(unsure & strong & ~shown, F.lit(False)) | F.coalesce(gray & ~shown, F.lit(False))
    rules = [
        (F.col("conflict") == "hard", "high_risk", "conflict_hard"),
        (hard_ai & ~text, "high_risk", "ai_hard"),
        (likely & ~text & strong, "high_risk", "ai_and_spectral"),
        ((ed >= L["edit_high"]) & ~shown & ~text, "high_risk", "edit_high"),
        ((ed >= L["edit_suspicious"]) & ~shown, "suspicious", "edit"),
        (F.col("conflict") == "medium", "suspicious", "conflict_medium"),
        (text & (F.col("claims_high") >= L["claims_high"]), "suspicious", "claims_high"),
        (text & (F.col("claims_medium") >= L["claims_medium"]), "suspicious", "claims_medium"),
        (F.col("ela") >= L["ela"], "suspicious", "ela"),
        (F.col("declares_ai") & ~shown, "suspicious", "credential_ai"),
        (F.col("verified") & ~shown & ~text & ~flagged, "credible", "credential"),
        (flagged, "suspicious", "gray_band"),
    ]
    level, reason = F.lit("inconclusive"), F.lit("nothing")
    for when, lv, why in reversed(rules):
        level, reason = F.when(when, lv).otherwise(level), F.when(when, why).otherwise(reason)
    return e.select("*", level.alias("level"), reason.alias("reason"))


def overlay(verdicts: DataFrame, claims: DataFrame, context: DataFrame) -> DataFrame:
    """D3: any claim conflict or context conflict lifts to suspicious unless high; credible becomes inconclusive."""
    bad = claims.filter("status = 'conflict'").select("asset").unionByName(context.select("asset")).distinct().withColumn("bad", F.lit(True))
    level = F.when(F.col("level") == "high_risk", "high_risk").when(F.col("bad"), "suspicious").when(F.col("level") == "credible", "inconclusive").otherwise(F.col("level"))
    return verdicts.join(bad, "asset", "left").withColumn("level", level).drop("bad")


def with_playbook(verdicts: DataFrame) -> DataFrame:
    """What to do, in how many hours and whether a person must look, by level."""
    book = verdicts.sparkSession.createDataFrame(lx.PLAYBOOK, "level string, action string, hours int, must_review boolean")
    return verdicts.join(F.broadcast(book), "level", "left")


def skips(assets: DataFrame) -> DataFrame:
    """Asset, tool, rule, action, each once. assets: format, known_original, has_text, has_lines, ai_score."""
    def rule(when: Column, tool: str, name: str, action: str) -> Column:
        return F.when(when, F.struct(F.lit(tool).alias("tool"), F.lit(name).alias("rule"), F.lit(action).alias("action")))

    known = F.col("known_original").isNotNull()
    cells = [
        rule((F.col("format") != "") & (F.upper("format") != "JPEG"), "ela", "R1", "skip"),
        rule(known, "ela", "R2", "skip"), rule(known, "trufor", "R2", "skip"),
        rule(~F.col("has_text"), "text", "R3", "skip"), rule(~F.col("has_text"), "crossmodal", "R3", "skip"),
        rule(F.col("has_text") & ~F.col("has_lines"), "crossmodal", "R4", "partial"),
        rule(F.col("ai_score") >= L["aigc_high"], "trufor", "R5", "run_limited"),
    ]
    return assets.select("asset", F.explode(F.array_compact(F.array(*cells))).alias("d")).select("asset", "d.*").dropDuplicates(["asset", "tool", "rule"])


def follow_ups(verdicts: DataFrame) -> DataFrame:
    """Asset, rule, action for verdicts with claims_high, claims_medium, hard_conflicts."""
    def act(when: Column, rule: str, action: str) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action")))

    cells = [act(F.col("level") == "high_risk", "A1", "queue"), act(F.col("level") == "suspicious", "A1", "mark"), act((F.col("claims_high") > 0) | (F.col("claims_medium") > 0), "A2", "rewrite"), act(F.col("hard_conflicts") > 0, "A3", "check_sources")]
    return verdicts.select("asset", F.explode(F.array_compact(F.array(*cells))).alias("a")).select("asset", "a.*")


def decision_trace(reasons: DataFrame, evidence: DataFrame, hints: list[tuple[str, str]], negative: str) -> DataFrame:
    """Asset, tool, contributed: does a reason of the asset that isn't a denial name the tool (the first hint that occurs)."""
    tool = F.lit(None).cast("string")
    for hint, name in reversed(hints):
        tool = F.when(F.contains("reason", F.lit(hint)), name).otherwise(tool)
    by = reasons.filter(~F.col("reason").rlike(negative)).select("asset", tool.alias("tool")).filter("tool is not null").distinct().withColumn("contributed", F.lit(True))
    return evidence.select("asset", "tool").distinct().join(by, ["asset", "tool"], "left").na.fill(False, ["contributed"])


def role_review(e: DataFrame) -> DataFrame:
    """Concerns of the image, text and source roles, and whether they agree with the level."""
    image = F.coalesce((F.col("edit_score") >= L["edit_suspicious"]) | (F.col("ela") >= L["ela"]), F.lit(False)) | F.coalesce(F.col("edit_score") >= L["edit_high"], F.lit(False))
    text = (F.col("claims_high") > 0) | (F.coalesce("conflict", F.lit("")) == "hard")
    source = F.col("known_original").isNull() & (F.coalesce("credential", F.lit("")) != "present")
    concerns = F.array_compact(F.array(F.when(image, "image"), F.when(text, "text"), F.when(source, "source")))
    agrees = F.when(F.col("level").isin("high_risk", "suspicious"), F.size(concerns) > 0).otherwise(True)
    return e.select("asset", F.array_join(concerns, ",").alias("concerns"), agrees.alias("agrees"))


def check_statuses(assets: DataFrame, tools: list[str], evidence: DataFrame, model_tools: tuple[str, ...] = ("aigc", "trufor", "ocr")) -> DataFrame:
    """Status of every tool of a fixed list for every asset; evidence: asset, tool, available (false: failed)."""
    every = assets.select("asset", F.explode(F.array(*map(F.lit, tools))).alias("tool"))
    rows = every.join(evidence, ["asset", "tool"], "left")
    gone = F.col("available").isNotNull() & ~F.col("available")
    status = F.when(gone & F.col("tool").isin(*model_tools), "model_unavailable").when(F.col("available"), "completed").otherwise("insufficient_evidence")
    return rows.select("asset", "tool", status.alias("status"))


def trace_verdict(e: DataFrame) -> DataFrame:
    """Risk and level from watermarks against the stated source and the categories; e: asset, handles, official, site, own_shot, category_conflict."""
    marked = F.col("handles") > 0
    risk = F.when(marked & (F.col("official") | F.col("site")), "high").when((marked & F.col("own_shot")) | F.col("category_conflict"), "medium").otherwise("low")
    level = F.when(risk == "high", "high_risk").when(risk == "medium", "suspicious").otherwise("credible")
    return e.select("*", risk.alias("risk"), level.alias("level"))


def with_matrix(traces: DataFrame, matrices: DataFrame) -> DataFrame:
    """A suspicious batch lifts a credible item."""
    rows = traces.join(matrices.select("batch", F.col("verdict").alias("m")), "batch", "left")
    return rows.withColumn("level", F.when((F.col("level") == "credible") & (F.col("m") == "suspicious"), "suspicious").otherwise(F.col("level"))).drop("m")


def skin_type(answers: Column) -> Column:
    """Type from 16 answers of 0 to 3 in four groups; unclear if a group has fewer than three."""
    def mean(rows: Column, k: int) -> Column:
        good = F.filter(F.slice(rows, 4 * k + 1, 4), lambda x: x.isNotNull() & (x >= 0) & (x <= 3))
        return let(good, lambda xs: F.when(F.size(xs) >= 3, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)))

    def kind(means: Column) -> Column:
        t_oil, c_oil, t_dry, c_dry = (means[k] for k in range(4))
        all_known = t_oil.isNotNull() & c_oil.isNotNull() & t_dry.isNotNull() & c_dry.isNotNull()
        both = ((t_oil >= 2) & (t_dry >= 2)) | ((c_oil >= 2) & (c_dry >= 2))
        calm = (t_oil <= 1) & (c_oil <= 1) & (t_dry <= 1) & (c_dry <= 1)
        return F.when(~all_known | both, "unclear").when((t_oil >= 2) & (c_oil < 2) & (c_dry >= 2), "mixed").when((t_oil >= 2) & (c_oil >= 2), "oily").when((t_dry >= 2) & (c_dry >= 2), "dry").when(calm, "neutral").otherwise("unclear")

    # answers and means are each evaluated once
    return let(answers, lambda rows: let(F.array(*(mean(rows, k) for k in range(4))), kind))


def avoided_terms(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """ingredients, hits: for each distinct list of ingredients the terms that occur in one of them, case of the ingredient aside; null if an ingredient is null.

    Each distinct ingredient is cut into its substrings of the lengths that terms have, which meet the
    terms by an equi-join; so lists and terms are never compared one by one.
    """
    lengths = [r[0] for r in terms.select(F.length("term")).distinct().collect()]  # as many as the longest term has characters, at most
    every = lists.select("ingredients").distinct()
    one = every.select(F.explode("ingredients").alias("g")).distinct().filter("g is not null").withColumn("low", F.lower("g"))

    def cut(n: int) -> Column:
        every_place = F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substring("low", i, F.lit(n)))
        return F.when(F.length("low") >= n, every_place).otherwise(F.array().cast("array<string>"))

    cuts = [cut(n) for n in lengths]
    found = one.select("g", F.explode(F.array_distinct(F.flatten(F.array(*cuts)))).alias("term")).join(terms, "term") if cuts else one.select("g", F.lit(None).cast("string").alias("term")).limit(0)
    hits = every.select("ingredients", F.explode("ingredients").alias("g")).join(found, "g").groupBy("ingredients").agg(F.sort_array(F.collect_set("term")).alias("hits"))
    known = F.col("ingredients").isNotNull() & ~F.exists("ingredients", lambda g: g.isNull())
    none = F.array().cast("array<string>")
    return every.join(hits, "ingredients", "left").select("ingredients", F.when(known, F.coalesce("hits", none)).alias("hits"))


def recommendations(profiles: DataFrame, catalog: DataFrame, market: str, keep: int = 3) -> DataFrame:
    """The keep best items for each profile, by score then name: profile, place, name, score.

    profiles: profile, type, goals, textures, avoid (array), sensitivity. catalog: name, market,
    category, skin, goals, textures, gentle, ingredients (null: unknown). The score counts goals and
    textures in common; a null list or entry of these counts as none. Where something is avoided, an
    item with an unknown ingredient is left out, and a null among the avoided terms leaves out all.

    Profiles of the same answers are one signature; items of the same type, goals, textures,
    gentleness and avoided terms are one class, of which the first keep by name stay. Postings by
    type and word give the score of each wanted set of words on each offered one. Signatures then meet
    classes from the highest score down, and one that has keep items meets no lower score; only those
    still short at the end meet the classes of their type without a common word. So work follows the
    number of distinct answers and sets of words, not of profiles and items.
    """
    none = F.array().cast("array<string>")
    words = lambda c: F.sort_array(F.array_distinct(F.array_compact(F.coalesce(c, none))))
    calm = F.col("sensitivity").isNull() | (F.col("sensitivity") < 2)
    want = F.struct("type", words(F.col("goals")).alias("goals"), words(F.col("textures")).alias("textures"))
    people = profiles.filter("type <> 'unclear'").select("profile", F.struct(want.alias("want"), calm.alias("calm"), F.sort_array(F.coalesce("avoid", F.array(F.lit(None).cast("string")))).alias("avoid")).alias("sig"))
    pending = written(people.select("sig").distinct().withColumn("need", F.lit(keep)), "recommend-signatures")
    terms = pending.select(F.explode("sig.avoid").alias("term")).filter("term is not null").distinct()
    raw = catalog.filter(F.col("market") == market).select("name", F.explode(F.array_distinct("skin")).alias("type"), F.coalesce("gentle", F.lit(False)).alias("gentle"), F.sort_array("ingredients").alias("ingredients"), "goals", "textures")
    known = raw.join(avoided_terms(raw, terms), "ingredients", "left")
    items = known.select("name", F.struct("type", words(F.col("goals")).alias("goals"), words(F.col("textures")).alias("textures")).alias("offer"), "gentle", "hits")
    first = F.row_number().over(Window.partitionBy("offer", "gentle", "hits").orderBy("name"))
    classes = written(items.withColumn("nth", first).filter(F.col("nth") <= keep).select("offer", "gentle", "hits", "name"), "recommend-classes")

    def postings(rows: DataFrame, name: str) -> DataFrame:
        both = [rows.select(name).distinct().select(name, F.col(f"{name}.type").alias("type"), F.lit(kind).alias("kind"), F.explode(f"{name}.{kind}").alias("word")) for kind in ("goals", "textures")]
        return both[0].unionByName(both[1])

    wants = pending.select("sig.want")
    scores = written(postings(wants, "want").join(postings(classes, "offer"), ["type", "kind", "word"]).groupBy("want", "offer").agg(F.count("*").cast("int").alias("score")), "recommend-scores")
    safe = (F.size("sig.avoid") == 0) | F.coalesce(~F.exists("sig.avoid", lambda t: t.isNull()) & ~F.arrays_overlap("hits", "sig.avoid"), F.lit(False))
    ok = (F.col("sig.calm") | F.col("gentle")) & safe
    best = []
    for level in [*sorted((r[0] for r in scores.select("score").distinct().collect()), reverse=True), 0]:  # as many as an item has words, at most
        if level:
            met = pending.withColumn("want", F.col("sig.want")).join(scores.filter(F.col("score") == level), "want").join(classes, "offer")
        else:
            short = pending.select("sig", "need", F.col("sig.want").alias("want"), F.col("sig.want.type").alias("type"))
            met = short.join(classes.withColumn("type", F.col("offer.type")), "type").join(scores.select("want", "offer"), ["want", "offer"], "left_anti")
        place = F.row_number().over(Window.partitionBy("sig").orderBy("name"))
        top = met.filter(ok).select("sig", "need", "name").withColumn("nth", place).filter((F.col("nth") <= keep) & (F.col("nth") <= F.col("need")))
        top = written(top.select("sig", (F.lit(keep) - F.col("need") + F.col("nth")).alias("place"), "name", F.lit(level).alias("score")), "recommend-level")
        best.append(top)
        got = top.groupBy("sig").agg(F.count("*").cast("int").alias("got"))
        pending = written(pending.join(got, "sig", "left").select("sig", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")).filter("need > 0"), "recommend-pending")
        if pending.isEmpty():
            break
    return people.join(reduce(DataFrame.unionByName, best), "sig").select("profile", "place", "name", "score")


def severity(level: Column) -> Column:
    return F.coalesce(*(F.when(level == x, i) for i, x in enumerate(lx.LEVELS)), F.lit(len(lx.LEVELS)))


def board(records: DataFrame, keep: int | None = None) -> DataFrame:
    """K1: records (asset, level, score) by severity, then score (null as 0) from the largest, then asset; place from 1 for the first keep, else in order."""
    rows = records.orderBy(severity(F.col("level")), F.desc(F.coalesce("score", F.lit(0.0))), "asset")
    return rows.limit(keep) if keep else rows


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision of each asset (ts, then decision for ties); an aggregate, so hot assets fold before the shuffle."""
    return decisions.groupBy("asset").agg(F.max(F.struct("ts", "decision", "reviewer")).alias("d")).select("asset", "d.decision", "d.reviewer", "d.ts")


def review_queue(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """K2: high and suspicious records with their latest decision."""
    return records.filter(F.col("level").isin("high_risk", "suspicious")).join(latest_decisions(decisions), "asset", "left")


def flat_record(results: DataFrame) -> DataFrame:
    """K3: nested result (asset, verdict, evidence) to the board's fields."""
    ela = F.get(F.col("evidence.ela.regions"), F.lit(0))["score"]
    return results.select("asset", F.col("verdict.level").alias("level"), F.col("evidence.trufor.score").alias("edit_score"), F.col("evidence.aigc.score").alias("ai_score"), ela.alias("ela_score"), F.col("verdict.level").isin("high_risk", "suspicious").alias("needs_review"))


def with_failures(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Results and failures in one export."""
    return results.unionByName(failures, allowMissingColumns=True)


def overlaid(chosen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows by id, the catalogue's before the chosen one."""
    both = catalog.withColumn("p", F.lit(0)).unionByName(chosen.withColumn("p", F.lit(1)))
    return both.groupBy("id").agg(F.min(F.struct("p", *[c for c in catalog.columns if c != "id"])).alias("r")).select("id", "r.*").withColumnRenamed("p", "origin")


def membership(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows with seen: is the name among the training names."""
    return rows.join(train.select("name", F.lit(True).alias("seen")).distinct(), "name", "left").na.fill(False, ["seen"])
