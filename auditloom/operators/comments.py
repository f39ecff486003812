"""Comment threads, accounts and batches: duplicates, near duplicates, rhythm, repetition over posts.

comments: thread, idx (unique in the thread), content, text, and ts where rhythm is wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.ranking import ranked
from ..functions.shipping import ship


def base_rates(comments: DataFrame, details: list[str] | None = None, positive: list[str] | None = None, negative: list[str] | None = None) -> DataFrame:
    """A1: thread, n, dup_exact_rate, short_rate, no_detail_rate, positive_uniformity."""
    norm = tx.normalized(F.col("text"))
    good, bad = tx.word_hits(F.col("text"), positive or lx.POSITIVE), tx.word_hits(F.col("text"), negative or lx.NEGATIVE)
    rows = comments.select("thread", F.nullif(norm, F.lit("")).alias("norm"), (F.length(norm) <= lx.SHORT).alias("short"), (~tx.has_detail(F.col("text"), details)).alias("bare"), ((good > 0) & (bad == 0)).alias("glad"))
    # copies fold before the shuffle; distinct texts are counted in a second step
    texts = rows.groupBy("thread", "norm").agg(F.count("*").alias("k"), F.count_if("short").alias("short"), F.count_if("bare").alias("bare"), F.count_if("glad").alias("glad"))
    n = F.sum("k")
    filled = F.sum(F.when(F.col("norm").isNotNull(), F.col("k")))
    return texts.groupBy("thread").agg(
        n.alias("n"), F.coalesce(1 - F.count("norm") / filled, F.lit(0.0)).alias("dup_exact_rate"),
        (F.sum("short") / n).alias("short_rate"), (F.sum("bare") / n).alias("no_detail_rate"), (F.sum("glad") / n).alias("positive_uniformity"))


def near_pairs(comments: DataFrame, limit: int = lx.PAIR_LIMIT, near: float = lx.NEAR) -> DataFrame:
    """A2: thread, pairs, near_pairs, near_dup_rate: Jaccard of gram sets over all pairs, or over every (n div limit + 1)-th comment of larger threads.

    A thread gives at most about limit + 1 comments to its pairs, so the pairs stay bounded.
    """
    ship(comments.sparkSession)
    sizes = comments.groupBy("thread").agg(F.count("*").alias("n"))
    step = F.when(F.col("n") <= limit, 1).otherwise(F.floor(F.col("n") / limit) + 1)
    # the sample is taken by thread and number; only its texts are read and moved
    chosen = ranked(comments.select("thread", "idx"), "thread", "idx").join(sizes, "thread").filter(F.col("nth") % step == 0).select("thread", "idx", "nth")
    some = comments.select("thread", "idx", "text").join(chosen, ["thread", "idx"]).select("thread", "nth", tx.gram_hashes(tx.normalized(F.col("text"))).alias("grams"))
    a, b = some.select("thread", F.col("nth").alias("i"), F.col("grams").alias("a")), some.select("thread", F.col("nth").alias("j"), F.col("grams").alias("b"))
    close = (F.least(F.size("a"), F.size("b")) >= near * F.greatest(F.size("a"), F.size("b"))) & (tx.jaccard(F.col("a"), F.col("b")) >= near)
    hits = a.join(b, "thread").filter("i < j").groupBy("thread").agg(F.count("*").alias("pairs"), F.count_if(close).alias("near_pairs"))
    out = sizes.join(hits, "thread", "left").na.fill(0, ["pairs", "near_pairs"])
    return out.select("thread", "pairs", "near_pairs", F.when(F.col("pairs") > 0, F.col("near_pairs") / F.col("pairs")).otherwise(0.0).alias("near_dup_rate"))


def template_share(comments: DataFrame) -> DataFrame:
    """A3: thread, template_concentration: share of comments with the most common gram."""
    ship(comments.sparkSession)
    top = tx.gram_counts(comments, "thread", tx.normalized(F.col("text"))).groupBy("thread").agg(F.max("c").alias("top"))
    sizes = comments.groupBy("thread").agg(F.count("*").alias("n"))
    return top.join(sizes, "thread").select("thread", (F.col("top") / F.col("n")).alias("template_concentration"))


#: Seconds in which the stamps of a key are sorted together.
DAY = 86400


def burstiness(events: DataFrame, key: str = "thread", name: str = "burstiness") -> DataFrame:
    """A4: key, 1 - coefficient of variation of the gaps between sorted ts (seconds), within 0 and 1; null below three stamps or without any gap.

    Equal stamps fold to one with a count. Distinct ones are sorted by key and day, at most DAY at once;
    the first of a day takes its gap from the last of the day before it, among rows of one a day.
    """
    stamps = events.filter("ts is not null").groupBy(key, "ts").agg(F.count("*").alias("k")).withColumn("_day", F.floor(F.col("ts") / DAY))
    inside = stamps.select(key, "k", "ts", (F.col("ts") - F.lag("ts").over(Window.partitionBy(key, "_day").orderBy("ts"))).alias("gap"))
    days = stamps.groupBy(key, "_day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    between = days.select(key, F.lit(0).cast("long").alias("k"), (F.col("first") - F.lag("last").over(Window.partitionBy(key).orderBy("_day"))).alias("gap"))
    sums = inside.drop("ts").unionByName(between).groupBy(key).agg(F.sum("k").alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap").cast("double") * F.col("gap")).alias("q"))
    gaps, total = F.col("n") - 1, F.coalesce("s", F.lit(0))
    mean = total / gaps
    cv = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / gaps - mean * mean)) / mean
    value = F.when((F.col("n") >= 3) & (total > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv)))
    return sums.select(key, value.alias(name))


#: Distinct texts of a key in a block, and characters in it, about; up to FEW texts of a key meet in a join.
PAIR_BLOCK, PAIR_CHARS, FEW = 512, 1 << 20, 32


def overlap_sum(part: pd.DataFrame) -> float:
    """Sum of ka * kb * Jaccard over the pairs of texts (own, g: sorted grams, k: copies) of block i with those of block j, each pair once.

    Both blocks' grams are posting lists: lists of one gram meet, so texts without one in common cost
    nothing; meetings are made by steps of some four million.
    """
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    sides = []
    for block in (i, j):
        rows = part[part["own"] == block]
        sizes = rows["g"].str.len().to_numpy()
        grams, who = np.concatenate([*rows["g"], np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(grams, kind="stable")
        value, start, count = np.unique(grams[order], return_index=True, return_counts=True)
        sides.append((value, start, count, who[order], sizes, rows["k"].to_numpy(float)))
    (va, sa, ca, wa, na, ka), (vb, sb, cb, wb, nb, kb) = sides
    if not len(na) or not len(nb):
        return 0.0
    _, at, bt = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    meets = ca[at] * cb[bt]
    shared = np.zeros(len(na) * len(nb), np.int64)
    step = np.cumsum(meets) // (1 << 22)
    for s in np.unique(step):
        a, b, m = at[step == s], bt[step == s], meets[step == s]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        width = np.repeat(cb[b], m)
        shared += np.bincount(wa[np.repeat(sa[a], m) + nth // width] * len(nb) + wb[np.repeat(sb[b], m) + nth % width], minlength=len(shared))
    shared = shared.reshape(len(na), len(nb))
    ratio = shared / np.maximum(na[:, None] + nb - shared, 1) * ka[:, None] * kb
    return float((np.triu(ratio, 1) if i == j else ratio).sum())


def mean_similarity(rows: DataFrame, key: str, name: str, blank: float = 1.0) -> DataFrame:
    """key, name: mean Jaccard of gram sets over all pairs of a key's rows (key, idx, norm); null for a single row. Two empty texts count as blank, an empty and another one as 0.

    Copies fold to one text with a count, so pairs of copies are a product and no work. Texts of keys
    with few meet by a join; those of larger keys in cells of two blocks, one task a cell, by the
    posting lists of their grams, and a cell gives one sum: no pair becomes a row.
    """
    pairs = F.col("k") * (F.col("k") - 1) / 2
    texts = rows.groupBy(key, "norm").agg(F.count("*").alias("k"), F.min("idx").alias("idx"))
    sizes = texts.groupBy(key).agg(
        F.sum("k").alias("n"), F.sum(pairs * F.when(F.col("norm") == "", blank).otherwise(1.0)).alias("same"), F.count("*").alias("texts"),
        F.greatest(F.ceil(F.count("*") / PAIR_BLOCK), F.ceil(F.sum(F.length("norm")) / PAIR_CHARS)).cast("int").alias("blocks"))
    full = texts.filter("norm <> ''").join(sizes.select(key, "texts", "blocks"), key)
    small = (F.col("texts") <= FEW) & (F.col("blocks") <= 1)
    few = full.filter(small).select(key, "idx", "k", tx.gram_hashes(F.col("norm")).alias("g"))
    a, b = (few.select(key, *(F.col(c).alias(f"{c}_{x}") for c in ("idx", "k", "g"))) for x in "ab")
    near = a.join(b, key).filter("idx_a < idx_b").groupBy(key).agg(F.sum(F.col("k_a") * F.col("k_b") * tx.jaccard(F.col("g_a"), F.col("g_b"))).alias("apart"))
    many = full.filter(~small).select(key, "k", F.pmod(F.xxhash64("norm"), F.col("blocks")).cast("int").alias("own"), "blocks", tx.gram_hashes(F.col("norm")).alias("g"))
    cells = many.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(key, F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "k", "g")
    kind = rows.select(key).schema[0].dataType.simpleString()
    sums = cells.groupBy(key, "i", "j").applyInPandas(lambda part: pd.DataFrame({key: part[key].iloc[:1], "apart": [overlap_sum(part)]}), f"`{key}` {kind}, apart double")
    apart = near.unionByName(sums).groupBy(key).agg(F.sum("apart").alias("apart"))
    every = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(apart, key, "left").select(key, F.when(F.col("n") > 1, (F.col("same") + F.coalesce("apart", F.lit(0.0))) / every).alias(name))


def cross_posts(comments: DataFrame, least: int = lx.CROSS_POSTS) -> DataFrame:
    """A5: thread, cross_post_repeat_max, cross_post_repeat_ratio: in how many contents a thread's comments occur.

    Copies fold to (text, thread, content) first, so one text of very many comments is a few rows.
    """
    texts = comments.select("thread", "content", tx.normalized(F.col("text")).alias("norm")).groupBy("norm", "thread", "content").agg(F.count("*").alias("k"))
    spread = texts.select("norm", "content").distinct().groupBy("norm").agg(F.count("*").alias("posts"))
    rows = texts.join(spread, "norm")
    return rows.groupBy("thread").agg(F.max("posts").alias("cross_post_repeat_max"), (F.sum(F.when(F.col("posts") >= least, F.col("k")).otherwise(0)) / F.sum("k")).alias("cross_post_repeat_ratio"))


def thread_features(comments: DataFrame, **words) -> DataFrame:
    """A1 to A5 together, a row for each thread."""
    rhythm = burstiness(comments) if "ts" in comments.columns else comments.select("thread").distinct().withColumn("burstiness", F.lit(None).cast("double"))
    out = base_rates(comments, **words)
    for part in (near_pairs(comments).select("thread", "near_dup_rate"), template_share(comments), rhythm, cross_posts(comments)):
        out = out.join(part, "thread", "left")
    return out


def thread_verdicts(features: DataFrame, least: int = lx.MIN_COMMENTS) -> DataFrame:
    """Score, fired strong signals, matrix anomaly and verdict of each thread; too few comments give inconclusive and no score."""
    rate = {k: F.round(F.col(k), 4) for k in lx.FEATURE_WEIGHTS}
    weight = sum((F.when(v.isNotNull(), lx.FEATURE_WEIGHTS[k]).otherwise(0.0) for k, v in rate.items()), F.lit(0.0))
    total = sum((F.coalesce(v, F.lit(0.0)) * lx.FEATURE_WEIGHTS[k] for k, v in rate.items()), F.lit(0.0))
    matrix = F.col("cross_post_repeat_max") >= lx.CROSS_POSTS
    score = total / weight
    score = F.when(matrix, F.least(F.lit(1.0), score + lx.MATRIX_BONUS)).otherwise(score)
    fired = F.array_compact(F.array(*(F.when(rate[k] >= t, F.lit(k)) for k, t in lx.STRONG.items())))
    few = F.col("n") < least
    verdict = F.when(few, "inconclusive").when(matrix | (F.size(fired) >= 4), "high_risk").when((F.size(fired) >= 3) | (score >= lx.SUSPICIOUS_SCORE), "suspicious").otherwise("credible")
    return features.select("thread", "n", F.when(~few, score).alias("score"), F.when(~few, F.size(fired)).alias("n_strong"), F.when(~few, F.array_join(fired, ",")).alias("fired"), F.when(~few, matrix).alias("matrix_anomaly"), verdict.alias("verdict"))


def account_profiles(posts: DataFrame, max_posts: int | None = None, positive: list[str] | None = None) -> DataFrame:
    """A row for each account of posts (account, idx, text, ts): reuse, regularity, lengths, flags, verdict.

    The mean similarity is over all pairs of an account's posts; max_posts bounds it by a
    deterministic sample for accounts beyond it, and is off by default.
    """
    ship(posts.sparkSession)
    rows = posts.filter(F.length("text") > 0).select("account", "idx", tx.normalized(F.col("text")).alias("norm"), tx.word_hits(tx.normalized(F.col("text")), positive or lx.POSITIVE).alias("glad"))
    paired = rows
    if max_posts:
        order = F.row_number().over(Window.partitionBy("account").orderBy(F.xxhash64("account", "idx"), "idx"))
        paired = rows.withColumn("o", order).filter(F.col("o") <= max_posts)
    reuse = mean_similarity(paired.select("account", "idx", "norm"), "account", "text_reuse_rate")
    n, mean = F.count("*"), F.avg(F.length("norm"))
    sizes = rows.groupBy("account").agg(n.alias("post_count"), mean.alias("mean_length"), F.when(n > 1, F.stddev_pop(F.length("norm")) / mean).alias("length_cv"), F.avg("glad").alias("mean_positive_hits"))
    out = sizes.join(reuse, "account", "left").join(burstiness(posts.select("account", "ts"), "account", "publish_regularity"), "account", "left")
    flags = (F.coalesce(F.col("text_reuse_rate") >= 0.5, F.lit(False)), F.coalesce(F.col("publish_regularity") >= 0.7, F.lit(False)), F.col("mean_positive_hits") >= 3)
    count = sum((f.cast("int") for f in flags), F.lit(0))
    verdict = F.when(F.col("post_count") < 2, "inconclusive").when(count > 0, "suspicious").otherwise("credible")
    return out.withColumn("n_flags", F.when(F.col("post_count") >= 2, count)).withColumn("verdict", verdict)


def content_matrix(records: DataFrame) -> DataFrame:
    """A row for each batch of records (batch, idx, text, handle): distinct handles, mean similarity, flags, verdict."""
    ship(records.sparkSession)
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}_]", "")
    reuse = mean_similarity(records.select("batch", "idx", norm.alias("norm")), "batch", "reuse", blank=0.0)
    sizes = records.groupBy("batch").agg(F.count("*").alias("content_count"), F.countDistinct("handle").alias("handles"))
    out = sizes.join(reuse, "batch", "left")
    flags = (F.col("handles") > 1).cast("int") + (F.coalesce("reuse", F.lit(0.0)) >= 0.5).cast("int") + (F.col("handles") == 0).cast("int")
    few = F.col("content_count") < 2
    verdict = F.when(few, "inconclusive").when(flags > 0, "suspicious").otherwise("credible")
    return out.select("batch", "content_count", "handles", "reuse", F.when(~few, flags).alias("n_flags"), verdict.alias("verdict"))


def direction_hits(cases: DataFrame) -> DataFrame:
    """Cases (expected, got): how many, exact hits, and hits of the direction (clean or alarm)."""
    clean = [F.col(c).isin("credible", "inconclusive") for c in ("expected", "got")]
    exact, way = F.col("expected") == F.col("got"), clean[0] == clean[1]
    return cases.agg(F.count("*").alias("cases"), F.count_if(exact).alias("exact"), F.count_if(way).alias("direction"), F.avg(way.cast("double")).alias("direction_rate"))
