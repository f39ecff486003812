"""Detector evaluation on score tables: a missing score (null) is never 0 and leaves the denominator.

scores: file, grp, kind (real or generated), score, and keys for slices. Results are long tables or
one-row DataFrames; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.ranking import running
from ..sources.io import smaller_tasks, written

Z = 1.959964


def wilson(count: Column, n: Column) -> tuple[Column, Column]:
    """A10: 95 % interval of a proportion, within 0 and 1; null at n = 0."""
    p = count / F.nullif(n, F.lit(0))
    scale = 1 + Z * Z / n
    middle = (p + Z * Z / (2 * n)) / scale
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def rates(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """df with, for each name: (count column, n column), name_rate, name_low, name_high."""
    for name, (count, n) in pairs.items():
        low, high = wilson(F.col(count), F.col(n))
        df = df.withColumn(f"{name}_rate", F.col(count) / F.nullif(F.col(n), F.lit(0))).withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return df


def origin_report(scores: DataFrame, low: float, high: float, keys: list[str] | None = None) -> DataFrame:
    """False positives, recall and uncertainty over groups, for all rows or for each value of keys.

    A real group is a false positive if any of its scores is high; a generated one counts as found
    if all are. Groups with a missing score are in neither, but are uncertain.
    """
    keys = keys or []
    s, missing = F.col("score"), F.col("score").isNull()
    unsure = missing | ((s >= low) & (s < high))
    by = scores.groupBy(*keys, "grp").agg(
        F.count_if(F.col("kind") == "real").alias("reals"), F.count_if((F.col("kind") == "real") & missing).alias("real_missing"), F.max(F.when(F.col("kind") == "real", s)).alias("real_top"),
        F.count_if(F.col("kind") == "generated").alias("fakes"), F.count_if((F.col("kind") == "generated") & missing).alias("fake_missing"), F.min(F.when(F.col("kind") == "generated", s)).alias("fake_least"),
        F.count_if(unsure).alias("unsure"))
    whole_real, whole_fake = (F.col("reals") > 0) & (F.col("real_missing") == 0), (F.col("fakes") > 0) & (F.col("fake_missing") == 0)
    out = by.groupBy(*keys).agg(
        F.count_if(whole_real).alias("fp_n"), F.count_if(whole_real & (F.col("real_top") >= high)).alias("fp_count"),
        F.count_if(whole_fake).alias("recall_n"), F.count_if(whole_fake & (F.col("fake_least") >= high)).alias("recall_count"),
        F.count("*").alias("uncertain_n"), F.count_if(F.col("unsure") > 0).alias("uncertain_count"),
        F.sum("real_missing").alias("missing_real"), F.sum("fake_missing").alias("missing_generated"))
    return rates(out, {k: (f"{k}_count", f"{k}_n") for k in ("fp", "recall", "uncertain")})


def every(*conditions: Column) -> Column:
    """Do all conditions hold; one that is null does not."""
    return F.coalesce(reduce(Column.__and__, conditions), F.lit(False))


def tracked() -> Column:
    """Are model, weights and preprocessing all given."""
    return every(*(F.length(c) > 0 for c in ("model", "weights", "preprocessing")))


def calibrated(scores: DataFrame, max_fp: float = 0.05, min_recall: float = 0.80, max_uncertain: float = 0.25) -> DataFrame:
    """One row (model, weights, preprocessing, low, high, fp_rate, recall, approved) of thresholds chosen from the distinct scores, 0 and 1; no row if no high meets its limits.

    Rates change only where a group's largest real or least generated score lies. So these are
    counted by score, and running counts over distinct scores, in cells, give every candidate's rates.
    Distinct scores and the row of the chosen high are written, since several steps read them.
    The row names the one model, weights and preprocessing of all scores, and is not approved: a
    person does that. Refused with ValueError: a missing score, no or several identities, one kind only.
    """
    identity = F.struct("model", "weights", "preprocessing")
    seen = scores.agg(
        F.count_if(F.col("score").isNull()).alias("missing scores"), F.count_if(~tracked()).alias("scores without model, weights or preprocessing"), F.count_if(~F.coalesce(F.col("kind").isin("real", "generated"), F.lit(False))).alias("other kinds"),
        F.count_if(F.col("kind") == "real").alias("real"), F.count_if(F.col("kind") == "generated").alias("generated"), F.min(identity).alias("one"), F.max(identity).alias("other")).first()
    wrong = [k for k in ("missing scores", "scores without model, weights or preprocessing", "other kinds") if seen[k]] + [f"no {k} score" for k in ("real", "generated") if not seen[k]]
    if wrong or seen["one"] != seen["other"]:
        raise ValueError("; ".join(wrong or ["several models, weights or preprocessings"]))
    by = scores.groupBy("grp", "kind").agg(F.max("score").alias("top"), F.min("score").alias("least"))
    cand = scores.select(F.col("score").alias("t")).unionByName(scores.sparkSession.createDataFrame([(0.0,), (1.0,)], "t double")).filter("t is not null").distinct()
    real = by.filter("kind = 'real'").groupBy(F.col("top").alias("t")).agg(F.count("*").alias("r"))
    fake = by.filter("kind = 'generated'").groupBy(F.col("least").alias("t")).agg(F.count("*").alias("g"))
    line = written(cand.join(real, "t", "left").join(fake, "t", "left").na.fill(0, ["r", "g"]).withColumn("down", -F.col("t")), "scores")
    cand = line.select("t")
    every = line.agg(F.sum("r").alias("all_r"), F.sum("g").alias("all_g"))  # one row
    line = running(line, [], "down", {"sum_r": "r", "sum_g": "g"}).join(F.broadcast(every))
    line = line.select("t", (F.col("sum_r") / F.nullif("all_r", F.lit(0))).alias("fp_rate"), (F.col("sum_g") / F.nullif("all_g", F.lit(0))).alias("recall"))
    ok = line.filter((F.col("fp_rate") <= max_fp) & (F.col("recall") >= min_recall))
    best = ok.agg(F.max(F.struct("recall", (-F.col("fp_rate")).alias("less"), "t", "fp_rate")).alias("b")).filter("b is not null").select(F.col("b.t").alias("high"), "b.fp_rate", "b.recall")
    best = written(best, "threshold")
    # a group is uncertain at low if its largest score below high is at least low: one value a group
    below = scores.join(F.broadcast(best.select("high"))).groupBy("grp").agg(F.max(F.when(F.col("score") < F.col("high"), F.col("score"))).alias("near"))
    n = below.groupBy("near").agg(F.count("*").alias("k"))
    lows = cand.join(F.broadcast(best.select("high"))).filter("t <= high").select("t")
    n = n.filter("near is not null").select(F.col("near").alias("t"), "k")
    marks = written(lows.select("t", F.lit(0).cast("long").alias("k")).unionByName(n).groupBy("t").agg(F.sum("k").alias("k"), (-F.col("t")).alias("down")), "marks")
    total = below.agg(F.count("*").alias("groups"))
    unsure = running(marks, [], "down", {"u": "k"}).join(F.broadcast(total)).filter(F.col("u") <= max_uncertain * F.col("groups"))
    low = unsure.join(lows, "t", "left_semi").agg(F.min("t").alias("low"))
    return best.join(F.broadcast(low)).select(*(F.lit(seen["one"][k]).alias(k) for k in ("model", "weights", "preprocessing")), "low", "high", "fp_rate", "recall", F.lit(False).alias("approved"))


def sweep(scores: DataFrame, baseline: float = 0.9, points: int = 100) -> DataFrame:
    """For each threshold of a grid false-positive rate, recall and how they compare with the baseline's.

    Scores are first counted by grid cell, so the grid meets at most its own number of rows.
    """
    cell = F.floor(F.col("score") * points + 1e-9)
    cells = scores.filter("score is not null").groupBy("kind", cell.alias("cell")).agg(F.count("*").alias("c"))
    grid = scores.sparkSession.range(points + 1).withColumnRenamed("id", "g")
    hits = grid.join(F.broadcast(cells), F.col("cell") >= F.col("g"), "left").groupBy("g").agg(F.coalesce(F.sum(F.when(F.col("kind") == "real", F.col("c"))), F.lit(0)).alias("real_fp"), F.coalesce(F.sum(F.when(F.col("kind") == "generated", F.col("c"))), F.lit(0)).alias("ai_hit"))
    every = Window.partitionBy()
    out = hits.select((F.col("g") / points).alias("threshold"), "real_fp", "ai_hit", (F.col("real_fp") / F.max("real_fp").over(every)).alias("fp_rate"), (F.col("ai_hit") / F.max("ai_hit").over(every)).alias("recall"))
    at = F.abs(F.col("threshold") - baseline) < 1e-9
    base_fp, base_recall = F.max(F.when(at, F.col("fp_rate"))).over(every), F.max(F.when(at, F.col("recall"))).over(every)
    fp, recall = F.col("fp_rate"), F.col("recall")
    return out.select("threshold", "real_fp", "ai_hit", "fp_rate", "recall", ((recall > base_recall) & (fp <= base_fp)).alias("better_recall"), ((fp < base_fp) & (recall >= base_recall)).alias("better_fp"), ((recall <= base_recall) & (fp >= base_fp)).alias("dominated"))


def sweep_verdict(points: DataFrame) -> DataFrame:
    """One row: points that are better, the band of lower false positives, and the verdict."""
    t = F.when(F.col("better_fp"), F.col("threshold"))
    out = points.agg(F.count_if("better_recall").alias("better_recall_points"), F.count_if("better_fp").alias("better_fp_points"), F.min(t).alias("band_low"), F.max(t).alias("band_high"))
    verdict = F.when(F.col("better_recall_points") > 0, "ADOPT_RECALL").when(F.col("better_fp_points") > 0, "FOUND_BUT_FRAGILE").otherwise("NO_IMPROVEMENT")
    return out.withColumn("verdict", verdict)


def auc(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the curve by average ranks, for columns positive (boolean) and score; by keys if given.

    Rows are counted by distinct score first; ranks come from running counts over these, in cells.
    """
    keys = keys or []
    at = scores.filter("score is not null").groupBy(*keys, F.col("score").cast("double").alias("score")).agg(F.count_if("positive").alias("p"), F.count("*").alias("c"))
    rank = F.col("upto") - (F.col("c") - 1) / 2.0
    rows = running(at, keys, "score", {"upto": "c"}).withColumn("sum", F.col("p") * rank)
    agg = [F.sum("p").cast("double").alias("n1"), F.sum(F.col("c") - F.col("p")).cast("double").alias("n0"), F.sum("sum").alias("ranks")]
    out = rows.groupBy(*keys).agg(*agg)
    value = (F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return out.select(*keys, F.when((F.col("n1") > 0) & (F.col("n0") > 0), value).alias("auc"))


def policy_verdict(a: Column, s: Column, policy: str, limits: dict[str, float] = lx.LIMITS) -> Column:
    """What detector only, spectral only or the cascade of both decide; a, s: their scores."""
    sure, likely = a >= limits["aigc_hard"], a >= limits["aigc_high"]
    strong, gray = s >= limits["spectral_strong"], s >= limits["spectral_gray"]
    hard, soft = {"detector": (sure, likely), "spectral": (strong, gray), "cascade": (sure | (likely & strong), likely | gray)}[policy]
    return F.when(hard, "high_risk").when(soft, "suspicious").otherwise("inconclusive")


def compare_policies(scores: DataFrame, policies: tuple[str, ...] = ("detector", "spectral", "cascade")) -> DataFrame:
    """For each policy take-downs, captures and rates by kind, and differences to the first policy."""
    rows = scores.select("kind", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("policy"), policy_verdict(F.col("score"), F.col("spectral"), p).alias("v")) for i, p in enumerate(policies)))).alias("x")).select("kind", "x.*")
    fake, real, down, any_ = F.col("kind") == "generated", F.col("kind") == "real", F.col("v") == "high_risk", F.col("v") != "inconclusive"
    out = rows.groupBy("i", "policy").agg(F.count_if(fake).alias("n_ai"), F.count_if(real).alias("n_real"), F.count_if(fake & down).alias("ai_takedown"), F.count_if(fake & any_).alias("ai_captured"), F.count_if(real & down).alias("real_takedown"), F.count_if(real & any_).alias("real_flagged"))
    out = out.withColumn("capture_rate", F.col("ai_captured") / F.col("n_ai")).withColumn("fp_rate", F.col("real_takedown") / F.col("n_real"))
    first = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a policy
    return out.select("policy", "n_ai", "n_real", "ai_takedown", "ai_captured", "real_takedown", "real_flagged", "capture_rate", "fp_rate", (F.col("capture_rate") - F.first("capture_rate").over(first)).alias("delta_capture"), (F.col("fp_rate") - F.first("fp_rate").over(first)).alias("delta_fp"))


def tier_verdict(tools: list[str], a: Column, s: Column, ela: Column, faithful: bool = True, limits: dict[str, float] = lx.LIMITS) -> Column:
    """The decision with a nested set of tools. faithful: with both scores every other row is suspicious; else the gray rule of the cascade."""
    out = F.lit("inconclusive")
    both = {"aigc", "spectral"} <= set(tools)
    if both:
        out = F.when((a >= limits["aigc_hard"]) | ((a >= limits["aigc_high"]) & (s >= limits["spectral_strong"])), "high_risk").otherwise(F.lit("suspicious") if faithful else policy_verdict(a, s, "cascade", limits))
    elif "aigc" in tools:
        out = policy_verdict(a, s, "detector", limits)
    elif "spectral" in tools:
        out = policy_verdict(a, s, "spectral", limits)
    if "ela" in tools:
        out = F.when((out != "high_risk") & (ela >= limits["ela"]), "suspicious").otherwise(out)
    return out


TIERS = [("T0", ["hash", "c2pa"]), ("T1", ["hash", "c2pa", "ela"]), ("T2", ["hash", "c2pa", "ela", "aigc"]), ("T3", ["hash", "c2pa", "ela", "aigc", "spectral"])]


def ablation(scores: DataFrame, tiers=None, faithful: bool = True) -> DataFrame:
    """Captures and flags of each tier; the AUC of the spectral score where the tier uses it."""
    tiers = tiers or TIERS
    cells = [F.struct(F.lit(n).alias("tier"), F.lit("spectral" in t).alias("scored"), tier_verdict(t, F.col("score"), F.col("spectral"), F.col("ela"), faithful).alias("v")) for n, t in tiers]
    rows = scores.select("kind", F.explode(F.array(*cells)).alias("x")).select("kind", "x.*")
    fake, real, down, any_ = F.col("kind") == "generated", F.col("kind") == "real", F.col("v") == "high_risk", F.col("v") != "inconclusive"
    out = rows.groupBy("tier", "scored").agg(F.count_if(fake & any_).alias("ai_capture"), F.count_if(fake & down).alias("ai_takedown"), F.count_if(real & any_).alias("real_flagged"), F.count_if(real & down).alias("real_takedown"))
    area = auc(scores.select((F.col("kind") == "generated").alias("positive"), F.col("spectral").alias("score")))
    return out.join(F.broadcast(area)).select("tier", "ai_capture", "ai_takedown", "real_flagged", "real_takedown", F.when(F.col("scored"), F.col("auc")).alias("score_auc"))


def band_policy(scores: DataFrame, limits: dict[str, float] = lx.LIMITS) -> DataFrame:
    """By set and kind: old policy (high is taken down) against new (high but not hard is only reviewed), with the scores in between."""
    s = F.col("score")
    high, hard = s >= limits["aigc_high"], s >= limits["aigc_hard"]
    gray = F.when(high & ~hard, F.round(s, 4))
    return scores.groupBy("set", "kind").agg(F.count("*").alias("n"), F.count_if(high).alias("old_high_risk"), F.count_if(hard).alias("new_high_risk"), F.count_if(high & ~hard).alias("new_suspicious"), F.size(F.collect_set(gray)).alias("gray_scores"), F.min(gray).alias("gray_low"), F.max(gray).alias("gray_high"))


def band_adoption(by_set: DataFrame) -> DataFrame:
    """One row of totals and the adoption checks."""
    real, ai = F.col("kind") == "real", F.col("kind") == "generated"

    def total(which: Column, c: str) -> Column:
        return F.sum(F.when(which, F.col(c)).otherwise(0))

    out = by_set.agg(total(real, "old_high_risk").alias("real_old"), total(real, "new_high_risk").alias("real_new"), total(real, "new_suspicious").alias("real_review"), total(ai, "old_high_risk").alias("ai_old"), (total(ai, "new_high_risk") + total(ai, "new_suspicious")).alias("ai_new"))
    out = out.withColumn("takedowns_gone", F.col("real_new") == 0).withColumn("all_reviewed", F.col("real_review") == F.col("real_old")).withColumn("ai_unchanged", F.col("ai_new") >= F.col("ai_old"))
    return out.withColumn("adopt", F.col("takedowns_gone") & F.col("all_reviewed") & F.col("ai_unchanged"))


def set_statistics(scores: DataFrame, keys: tuple[str, ...] = ("set", "kind")) -> DataFrame:
    """By keys: rows, missing scores, mean, median, least, largest and counts at the fixed lines."""
    s = F.col("score")
    lines = {"050": 0.5, "060": 0.6, "090": 0.9, "099": 0.99}
    return scores.groupBy(*keys).agg(F.count("score").alias("n"), F.count_if(s.isNull()).alias("n_unavailable"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.min(s).alias("least"), F.max(s).alias("largest"), *(F.count_if(s >= v).alias(f"n_ge_{k}") for k, v in lines.items()), F.count_if((s >= 0.9) & (s < 0.99)).alias("n_band"), (F.count_if(s >= 0.9) / F.nullif(F.count(s), F.lit(0))).alias("rate_high"))


def misses_by_tag(scores: DataFrame, tags: DataFrame, line: float = 0.9) -> DataFrame:
    """Scores under the line by style tag; rows without a tag are `unknown`."""
    rows = scores.filter(F.col("score") < line).join(tags, "generator", "left")
    return rows.groupBy("set", F.coalesce("style", F.lit("unknown")).alias("style")).agg(F.count("*").alias("misses"), F.min("score").alias("least"))


def promotion(scores: DataFrame, base: str, new: str) -> DataFrame:
    """By set and kind the rate at 0.9 of two models (column model), its change, and whether it got no worse (real: not higher; else not lower)."""
    by = set_statistics(scores, ("model", "set", "kind")).groupBy("set", "kind").pivot("model", [base, new]).agg(F.first("rate_high"))
    a, b = F.col(base), F.col(new)
    return by.select("set", "kind", a.alias("base_rate"), b.alias("new_rate"), (b - a).alias("delta"), F.when(F.col("kind") == "real", b <= a).otherwise(b >= a).alias("not_worse"))


def dataset_report(verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """By data set the level counts, hit rate and coverage; verdicts (dataset, file, level: null if not run), registry (dataset, expect: levels).

    Verdicts fold to a row for each data set and level before they meet the registry.
    """
    rows = verdicts.groupBy("dataset", "level").agg(F.count("*").alias("k")).join(registry, "dataset")

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("k"))), F.lit(0))

    level = F.col("level")
    out = rows.groupBy("dataset").agg(F.sum("k").alias("n_total"), total(level.isNotNull()).alias("n"), total(F.array_contains("expect", level)).alias("n_hit"), *(total(level == x).alias(x) for x in lx.LEVELS))
    return out.withColumn("hit_rate", F.col("n_hit") / F.nullif(F.col("n"), F.lit(0))).withColumn("coverage", F.col("n") / F.col("n_total")).withColumn("full", F.col("n") == F.col("n_total"))


def dispositions(rows: DataFrame) -> DataFrame:
    """How often each disposition of the array column dispositions occurs."""
    return rows.select(F.explode("dispositions").alias("disposition")).groupBy("disposition").agg(F.count("*").alias("n"))


def recall_by_subtype(rows: DataFrame, types: tuple[str, ...] = ("copy_move", "splice", "text_edit")) -> DataFrame:
    """Recall of alarms by the subtype in the file name (the last listed one that occurs, else other), with the missed files' count and first name."""
    kind = F.lit("other")
    for t in types:
        kind = F.when(F.contains("file", F.lit(t)), F.lit(t)).otherwise(kind)
    alarm = F.coalesce(F.col("level").isin("high_risk", "suspicious"), F.lit(False))
    missed = F.when(~alarm, F.col("file"))
    return rows.filter("level is not null").groupBy(kind.alias("subtype")).agg(F.count("*").alias("n"), F.count_if(alarm).alias("hit"), F.avg(alarm.cast("double")).alias("recall"), F.count(missed).alias("missed"), F.min(missed).alias("first_missed"))


def rescue(rows: DataFrame, line: float = 0.9) -> DataFrame:
    """Model, visible label and both, by set, by kind and overall (nulls in set and kind)."""
    model, label = F.coalesce(F.col("score") >= line, F.lit(False)), F.col("has_label")
    out = rows.groupingSets([[F.col("kind"), F.col("set")], [F.col("kind")], []], F.col("kind"), F.col("set"))
    return out.agg(F.count("*").alias("n"), F.count_if(model).alias("model_hits"), F.count_if(label).alias("label_hits"), F.count_if(label & ~model).alias("rescued"), F.count_if(label | model).alias("system_hits"), F.avg((label | model).cast("double")).alias("system_rate"))


def case_report(cases: DataFrame, checks: list[str]) -> DataFrame:
    """Rates of each boolean check, cases that pass all, and false alarms (expected none, got some)."""
    full = F.lit(True)
    for c in checks:
        full = full & F.col(c)
    return cases.agg(F.count("*").alias("cases"), *(F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in checks), F.count_if(full).alias("fully_passed"), F.count_if("false_alarm").alias("false_alarms"))


def score_tier(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= lx.LIMITS["edit_high"], "high_risk").when(score >= lx.LIMITS["edit_suspicious"], "suspicious").otherwise("quiet")


def perturbation_flips(base: DataFrame, changed: DataFrame) -> DataFrame:
    """For each perturbation runs, flips of the tier, least, mean and largest change; base (sample, score), changed (sample, perturbation, score)."""
    rows = changed.join(base.withColumnRenamed("score", "base"), "sample").filter("score is not null and base is not null")
    flip = score_tier(F.col("score")) != score_tier(F.col("base"))
    delta = F.col("score") - F.col("base")
    return rows.groupBy("perturbation").agg(F.count("*").alias("runs"), F.count_if(flip).alias("flips"), F.min(delta).alias("least_delta"), F.avg(delta).alias("mean_delta"), F.max(delta).alias("largest_delta"), (F.count_if(flip) == 0).alias("safe"))


def largest_drops(base: DataFrame, changed: DataFrame, k: int = 3) -> DataFrame:
    """The k largest drops of the score."""
    rows = changed.join(base.withColumnRenamed("score", "base"), "sample").withColumn("delta", F.col("score") - F.col("base")).filter("delta < 0")
    return rows.orderBy("delta", "sample", "perturbation").limit(k).select("sample", "perturbation", "delta")


def level_totals(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows by level, failures, rows that need review and all, as (what, n)."""
    by = rows.groupBy(F.col("level").alias("what")).agg(F.count("*").alias("n"))
    more = rows.agg(F.count_if(F.col("level").isin("high_risk", "suspicious")).alias("review"), F.count("*").alias("all")).selectExpr("stack(2, 'needs_review', review, 'analyzed', all) as (what, n)")
    return by.unionByName(more).unionByName(failures.agg(F.count("*").alias("n")).select(F.lit("failed").alias("what"), "n"))


def video_rollup(frames: DataFrame, step: int = 10, cap: int = 60) -> DataFrame:
    """For each video of frames (video, idx, level, total_frames) the level of its sampled frames, counts and coverage.

    Every step-th frame, up to cap of them, is sampled; levels outside the fixed ones are errors and
    don't decide; no valid frame gives inconclusive. idx counts from 0 without gaps, so the cap is a
    filter and no video is sorted in one task.
    """
    some = frames.filter((F.col("idx") % step == 0) & (F.col("idx") < step * cap))
    rank = F.array_position(F.array(*map(F.lit, lx.LEVELS)), F.col("level"))
    rank = F.when(rank > 0, rank)
    out = some.groupBy("video").agg(F.count("*").alias("sampled"), F.min(rank).alias("r"), F.count_if(rank.isNull()).alias("errors"), F.count_if(rank <= 2).alias("flagged"), *(F.count_if(F.col("level") == x).alias(f"n_{x}") for x in lx.LEVELS), F.max("total_frames").alias("total"))
    level = F.coalesce(F.element_at(F.array(*map(F.lit, lx.LEVELS)), F.col("r").cast("int")), F.lit("inconclusive"))
    return out.select("video", "sampled", level.alias("level"), "errors", "flagged", *(f"n_{x}" for x in lx.LEVELS), F.when(F.col("total") > 0, F.col("sampled") / F.col("total")).alias("coverage"))


def split_accuracy(rows: DataFrame) -> DataFrame:
    """By model and seen / held out / all: rows, accuracy of positives and false positives of negatives; rows (model, seen, kind, alarm)."""
    fake, real = F.col("kind") == "generated", F.col("kind") == "real"
    out = rows.rollup("model", "seen").agg(F.count("*").alias("n"), F.avg(F.when(fake, F.col("alarm").cast("double"))).alias("recall"), F.avg(F.when(real, F.col("alarm").cast("double"))).alias("fp_rate"), F.grouping_id().alias("g"))
    return out.filter("g < 3").select("model", F.when(F.col("g") == 1, "all").when(F.col("seen"), "seen").otherwise("held_out").alias("part"), "n", "recall", "fp_rate")


def separation(scores: DataFrame) -> DataFrame:
    """One row: least, mean and largest score of either kind, the gap between them, and rows over the real ones' largest."""
    real, fake = (F.when(F.col("kind") == k, F.col("score")) for k in ("real", "generated"))
    out = scores.agg(F.min(real).alias("real_least"), F.avg(real).alias("real_mean"), F.max(real).alias("real_largest"), F.min(fake).alias("fake_least"), F.avg(fake).alias("fake_mean"), F.max(fake).alias("fake_largest"))
    return out.withColumn("gap", F.col("fake_least") - F.col("real_largest")).withColumn("mean_gap", F.col("fake_mean") - F.col("real_mean"))


#: What a claim is compared by, besides its case and quote.
FIELDS = ("source", "quote", "product", "product_version", "metric", "value", "unit", "duration_days", "variant", "population", "conditions")


def field_f1(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Labels, predicted, matched and F1 over distinct (case, field, value, quote) cells.

    Both tables have case, quote and any of FIELDS; a field that is null, or an empty list, is no cell.
    Claims of both are shuffled once, as rows by case and quote; their cells are made and counted where
    these meet, so that no cell is shuffled and nothing is sorted. Cells of a null case or quote match none.
    """
    def claims(df: DataFrame, labels: int) -> DataFrame:
        kinds = dict(df.dtypes)
        value = {f: F.lit(None) if f not in kinds else F.when(F.size(f) > 0, F.to_json(f)) if kinds[f].startswith("array") else F.col(f) for f in FIELDS}
        return df.select(F.col("case").alias("_case"), F.col("quote").alias("_quote"), F.lit(labels).alias("x"), F.lit(1 - labels).alias("y"), *(v.cast("string").alias(f) for f, v in value.items()))

    rows = smaller_tasks(claims(expected, 1).unionByName(claims(predicted, 0)), "_case", "_quote")
    pairs = F.array(*(F.struct(F.lit(i).alias("field"), F.col(f).alias("v")) for i, f in enumerate(FIELDS)))
    cells = rows.select("_case", "_quote", "x", "y", F.explode(pairs).alias("c")).filter("c.v is not null").groupBy("_case", "_quote", "c.field", "c.v").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both = (F.col("x") + F.col("y") == 2) & F.col("_case").isNotNull() & F.col("_quote").isNotNull()
    out = cells.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(c) for n, c in (("x", "labels"), ("y", "predicted"))), F.count_if(both).alias("matched"))
    return out.withColumn("f1", 2 * F.col("matched") / F.nullif(F.col("labels") + F.col("predicted"), F.lit(0)))


def unsupported_claims(claims: DataFrame, references: DataFrame) -> DataFrame:
    """Claims called supported without a reference that a reviewer verified: an efficacy study with source and place that matches, of the case's market and the claim's product version.

    claims: case, claim, status, market, product_version; references: case, claim, verification,
    source_type, source, locator, matches, market, product_version.
    """
    given = [F.length(c) > 0 for c in ("source", "locator", "market", "product_version")]
    good = references.filter((F.col("verification") == "reviewer_verified") & (F.col("source_type") == "efficacy_study") & every(F.col("matches"), *given))
    return claims.filter("status = 'supported'").join(good, ["case", "claim", "market", "product_version"], "left_anti")


def pair_rates(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision and recall with intervals of booleans (truth, found), and rows whose check was unavailable."""
    out = pairs.groupBy(*(keys or [])).agg(F.count("*").alias("cases"), F.count_if("found").alias("precision_n"), F.count_if(F.col("truth") & F.col("found")).alias("precision_count"), F.count_if("truth").alias("recall_n"), F.count_if("unavailable").alias("unavailable"))
    out = out.withColumn("recall_count", F.col("precision_count"))
    return rates(out, {k: (f"{k}_count", f"{k}_n") for k in ("precision", "recall")})


def packed(mask: Column) -> Column:
    """A flat boolean mask as array<long>, 64 cells a word."""
    def word(i: Column) -> Column:
        return F.aggregate(F.slice(mask, i * 64 + 1, 64), F.lit(0).cast("long"), lambda bits, x: F.shiftleft(bits, 1).bitwiseOR(F.coalesce(x, F.lit(False)).cast("long")))

    return F.when(F.size(mask) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / 64).cast("int")), word))


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks, structs of height, width and packed bits; null where both are empty. Masks of other shapes than each other stop the job."""
    def ones(op) -> Column:
        return F.aggregate(F.zip_with(a["bits"], b["bits"], op), F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))

    same = (a["height"] == b["height"]) & (a["width"] == b["width"])
    iou = ones(lambda x, y: x.bitwiseAND(y)) / F.nullif(ones(lambda x, y: x.bitwiseOR(y)), F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull() & ~same, F.raise_error(F.lit("a predicted mask has another shape than the true one")).cast("double")).otherwise(iou)


def localized(rows: DataFrame, alarm: float = 0.5) -> DataFrame:
    """For each group of rows with a true mask: masks, mean_iou and missing_masks.

    rows: grp, kind, score, model, weights, preprocessing, truth and predicted (masks or null). A
    mask that is not detected, or whose prediction is missing, counts as an overlap of 0.
    """
    found = F.coalesce(F.col("score") >= alarm, F.lit(False))
    iou = F.when(found & F.col("predicted").isNotNull(), mask_iou(F.col("truth"), F.col("predicted"))).otherwise(0.0)
    return rows.filter("truth is not null").groupBy("grp").agg(F.count("*").alias("masks"), F.avg(iou).alias("mean_iou"), F.count_if(found & F.col("predicted").isNull()).alias("missing_masks"))


def localization(rows: DataFrame, alarm: float = 0.5) -> DataFrame:
    """One row: mask_groups, mean_iou over groups and missing_masks as localized() has them; over rows that are real or have a true mask, missing_scores, untracked_scores (without model, weights or preprocessing) and models (distinct identities); clean false positives over groups of real rows with a score."""
    groups = localized(rows, alarm).agg(F.count("*").alias("mask_groups"), F.avg("mean_iou").alias("mean_iou"), F.coalesce(F.sum("missing_masks"), F.lit(0)).alias("missing_masks"))
    judged = rows.filter("kind = 'real' or truth is not null")
    there = F.col("score").isNotNull()
    scores = judged.agg(F.count_if(~there).alias("missing_scores"), F.count_if(there & ~tracked()).alias("untracked_scores"), F.count_distinct(F.when(there & tracked(), F.struct("model", "weights", "preprocessing"))).alias("models"))
    clean = rows.filter("kind = 'real' and score is not null").groupBy("grp").agg(F.max(F.col("score") >= alarm).alias("flagged")).agg(F.count("*").alias("clean_n"), F.count_if("flagged").alias("clean_count"))
    return rates(groups.join(F.broadcast(scores)).join(F.broadcast(clean)), {"clean": ("clean_count", "clean_n")})


def bootstrap_interval(means: DataFrame, draws: int = 1000, seed: int = 17) -> DataFrame:
    """N, mean, low, high of the mean over groups (column mean) by a Poisson bootstrap.

    A group's weight in a draw comes from a hash of (group, draw), so draws don't depend on
    partitions: sums over groups for each draw, then percentiles over draws. A draw that takes no
    group (likely with few groups only) is left out.
    """
    u = (F.pmod(F.xxhash64("grp", "draw", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight, p, total = F.lit(0), 0.36787944117144233, 0.0  # Poisson of mean 1, by its distribution function
    for k in range(8):
        total += p
        weight = weight + (u > total).cast("int")
        p /= k + 1
    rows = means.select("grp", "mean", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", weight)
    each = rows.groupBy("draw").agg((F.sum(F.col("w") * F.col("mean")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    band = each.agg(F.expr("percentile(m, array(0.025, 0.975))").alias("q"))
    return means.agg(F.count("*").alias("n"), F.avg("mean").alias("mean")).join(F.broadcast(band)).select("n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def release_checks(origin: DataFrame, families: DataFrame, editing: DataFrame, claims: DataFrame, pairs: DataFrame, context: DataFrame, unavailable: DataFrame) -> DataFrame:
    """One row of booleans: does each area meet its limits and least numbers, with nothing missing.

    origin and families: origin_report() whole and by generator; editing: localization(); claims:
    field_f1() with unsupported, the number of unsupported_claims(); pairs and context: pair_rates()
    of the cross-modal and of the context pairs; unavailable: one row (origin_tool, editing_tool) of
    how often each tool was not there. Each table but families has one row; what is null fails.
    """
    c = F.col
    fam = families.agg(F.count("*").alias("families"), F.min(F.coalesce((c("recall_n") >= 50) & (c("recall_rate") >= 0.7), F.lit(False))).alias("families_ok"))
    tools = unavailable.select("origin_tool", "editing_tool")
    o = origin.join(F.broadcast(fam)).join(F.broadcast(tools.select("origin_tool"))).select(every(
        c("fp_n") >= 100, c("recall_n") >= 100, c("families") >= 2, c("families_ok"), c("fp_rate") <= 0.05, c("recall_rate") >= 0.8, c("uncertain_rate") <= 0.25, c("missing_real") == 0, c("missing_generated") == 0, c("origin_tool") == 0).alias("origin"))
    e = editing.join(F.broadcast(tools.select("editing_tool"))).select(every(
        c("mask_groups") >= 60, c("clean_n") >= 100, c("mean_iou") >= 0.4, c("clean_rate") <= 0.1, c("missing_scores") == 0, c("missing_masks") == 0, c("untracked_scores") == 0, c("models") == 1, c("editing_tool") == 0).alias("editing"))
    agreed = [c("precision_rate") >= 0.9, c("recall_rate") >= 0.8]
    x = pairs.select(c("cases").alias("_cases"), every(c("cases") >= 120, *agreed).alias("crossmodal"))
    f = claims.join(F.broadcast(x)).select(every(c("_cases") >= 120, c("f1") >= 0.85, c("unsupported") == 0).alias("claims"), "crossmodal")
    t = context.select(every(c("cases") >= 60, *agreed, c("unavailable") == 0).alias("context"))
    return o.join(F.broadcast(e)).join(F.broadcast(f)).join(F.broadcast(t))
