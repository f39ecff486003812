"""Null, empty and labelled cases."""

from pyspark.sql import functions as F

from auditloom.functions.ranking import ranked
from auditloom.operators import comments as cm
from auditloom.operators import decide as dc
from auditloom.operators import evaluate as ev

COMMENTS = "thread string, content string, idx long, text string, ts long"


def verdict(spark, texts, ts=None, posts=("p",)):
    rows = [("t", p, i * 10 + k, t, ts[i] if ts else None) for k, p in enumerate(posts) for i, t in enumerate(texts)]
    return cm.thread_verdicts(cm.thread_features(spark.createDataFrame(rows, COMMENTS))).first()


def test_short_comments_alone_are_credible(spark):
    r = verdict(spark, ["下巴好多了", "早上用的", "油皮可用", "我的T区出油", "去年买的", "鼻翼卡粉"])
    assert r["verdict"] == "credible"


def test_marks_do_not_hide_copies(spark):
    r = verdict(spark, ["绝了好用", "绝了好用!!", "绝了 好用👀", "绝了好用。", "绝了～好用"])
    assert r["verdict"] == "high_risk" and "dup_exact_rate" in r["fired"]


def test_few_comments_are_inconclusive(spark):
    r = verdict(spark, ["好", "好"])
    assert r["verdict"] == "inconclusive" and r["score"] is None


def test_same_comment_under_three_contents(spark):
    assert verdict(spark, ["买了两周了", "适合油皮"], posts=("a", "b", "c"))["verdict"] == "high_risk"


def test_rhythm(spark):
    rows = [("a", t) for t in (0, 60, 120, 180)] + [("b", 0), ("b", 5), ("c", 1), ("c", 1), ("c", 1)]
    got = {r[0]: r[1] for r in cm.burstiness(spark.createDataFrame(rows, "thread string, ts long")).collect()}
    assert got["a"] == 1.0 and got["b"] is None and got["c"] is None


def test_interval_is_null_without_rows(spark):
    r = ev.rates(spark.createDataFrame([(0, 0), (1, 4)], "count long, n long"), {"x": ("count", "n")}).orderBy("n").collect()
    assert r[0]["x_rate"] is None and r[0]["x_low"] is None and 0 < r[1]["x_low"] < 0.25 < r[1]["x_high"] < 1


def test_missing_scores_leave_groups_incomplete(spark):
    rows = [("g1", "real", 0.95), ("g1", "real", None), ("g2", "real", 0.95), ("g3", "generated", 0.99), ("g3", "generated", 0.2)]
    r = ev.origin_report(spark.createDataFrame(rows, "grp string, kind string, score double"), 0.3, 0.9).first()
    assert (r["fp_n"], r["fp_count"], r["recall_n"], r["recall_count"], r["missing_real"]) == (1, 1, 1, 0, 1)


def test_auc_ties(spark):
    rows = [(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1)]
    assert ev.auc(spark.createDataFrame(rows, "positive boolean, score double")).first()[0] == 0.875


def test_video_severity(spark):
    rows = [("v", 0, "inconclusive", 0), ("v", 1, "credible", 0), ("w", 0, "error", 9)]
    got = {r["video"]: r for r in ev.video_rollup(spark.createDataFrame(rows, "video string, idx long, level string, total_frames long"), step=1).collect()}
    assert got["v"]["level"] == "credible" and got["v"]["coverage"] is None and got["w"]["level"] == "inconclusive" and got["w"]["errors"] == 1


def test_strong_spectral_alone_raises_nothing(spark):
    base = {"asset": 1, "has_text": False, "conflict": None, "disclosed": False, "ai_score": 0.1, "spectral": 0.9, "edit_score": None, "edit_review_only": False, "claims_high": 0, "claims_medium": 0, "ela": None, "declares_ai": False, "verified": False}
    schema = "asset long, has_text boolean, conflict string, disclosed boolean, ai_score double, spectral double, edit_score double, edit_review_only boolean, claims_high int, claims_medium int, ela double, declares_ai boolean, verified boolean"
    rows = [base, base | {"asset": 2, "spectral": 0.7}, base | {"asset": 3, "ai_score": 0.95}, base | {"asset": 4, "ai_score": 0.995, "has_text": True}, base | {"asset": 5, "ai_score": None, "spectral": None, "verified": True}]
    got = {r["asset"]: r["level"] for r in dc.judged(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()}
    assert got == {1: "inconclusive", 2: "suspicious", 3: "high_risk", 4: "suspicious", 5: "credible"}


def test_ranks_over_blocks(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("o"))
    got = ranked(df, "g", "o", block=50).orderBy("g", "o").collect()
    assert [r["nth"] for r in got] == [i for n in (34, 33, 33) for i in range(n)]
