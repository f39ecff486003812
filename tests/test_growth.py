"""What must hold when the tables grow: plans that stay bounded, and inputs that only large tables show."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import scan
from auditloom.functions import text as tx
from auditloom.functions.shipping import ship
from auditloom.operators import claims as cl
from auditloom.operators import curate as cu
from auditloom.operators import decide as dc
from auditloom.operators import evaluate as ev
from auditloom.operators import vectors as ve
from auditloom.plans.comments import t5_style


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_keys_are_never_broadcast(spark, tmp_path):
    rows = [(i * 0x9E3779B97F4A7C15 % (1 << 63), "ab"[i % 2]) for i in range(300)]
    rows += [(fp ^ 0b1011 << 40, "b") for fp, split in rows if split == "a"] + [(None, "a"), (None, "b"), (5, "a"), (5, "b")]
    spark.createDataFrame(rows, "fp long, split string").write.parquet(path := str(tmp_path / "prints"))  # Spark knows how small files are
    found = cu.near_fingerprints(spark.read.parquet(path))
    assert "SortMergeJoin [i#" in plan(found)
    by = {}
    for fp, split in rows:
        if fp is not None:
            by.setdefault(fp, set()).add(split)
    want = sorted((a, b, (a ^ b).bit_count()) for a in by for b in by if a <= b and (a ^ b).bit_count() <= 4 and any(s != t for s in by[a] for t in by[b]))
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


def test_calibration_without_a_telling_feature(spark):
    rows = [(i, i % 2 == 0, float(i // 2 % 4), None) for i in range(400)]
    found = ve.calibration(spark.createDataFrame(rows, "id long, positive boolean, f0 double, f1 double"), ["f0", "f1"], least=0.45)
    assert found.collect() == [] and found.columns[0] == "feature"


def test_claim_texts_are_tested_outside_the_jvm(spark):
    texts = [(0, "产品：甲精华，14天水分提升20%；每天提升水分", None), (1, "【乙面霜】2周水分提升8%。水分提升9%", None), (2, "nothing", "丙"), (3, None, None), (4, "丙7天水分提升５％", "丙"), (5, "【a】丙 1 周2天水分提升5%", "丙"), (6, "产品：丁；乙面霜不能水分提升3%", "")]
    rows = spark.createDataFrame(texts, "doc long, text string, own string")
    found = cl.claim_table(rows, ["doc"], product=rows["own"])
    assert "RLIKE(text" not in plan(found)
    got = sorted(((r["doc"], r["product"], r["days"], r["value"], r["stance"]) for r in found.collect()), key=str)
    assert got == [(0, "甲精华", 14.0, 20.0, "asserted"), (1, "乙面霜", 14.0, 8.0, "asserted"), (1, None, None, 9.0, "asserted"), (4, "丙", 7.0, 5.0, "asserted"), (5, "丙", None, 5.0, "asserted"), (6, None, None, 3.0, "negated")]


def test_bounds_of_clauses_leave_nothing_out():
    texts = ["14天水分提升20%", "【甲精华】不能水分提升3%", "第二代水分提升3%", "敏感肌每天水分提升3%的说法错误", "产品: 乙，水分提升3%", "产品水分提升3%"]
    rows = [r for rs in scan._scanner(scan.CLAIMS, lx.CLAIM_HINT, True)(pa.array(texts)).to_pylist() for r in rs]
    assert [r["may"] for r in rows] == [0, scan.MAY_DENY | scan.MAY_PRODUCT | scan.HAS_PRODUCT, scan.MAY_EDITION, scan.MAY_DENY | scan.MAY_PEOPLE | scan.MAY_TERMS, scan.MAY_PRODUCT | scan.HAS_PRODUCT, scan.MAY_PRODUCT]


def test_cells_of_claims_are_not_shuffled(spark):
    kinds = "case long, quote string, value double, conditions array<string>, unit string"
    expected = spark.createDataFrame([(1, "a", 1.0, ["x"], "%"), (1, "a", 1.0, ["x"], "%"), (1, "a", 2.0, [], None), (2, "b", 3.0, None, "%"), (None, "c", 4.0, None, None), (3, None, 5.0, None, None)], kinds)
    predicted = spark.createDataFrame([(1, "a", 2.0, ["x"], "g"), (2, "b", 3.0, ["y"], "%"), (None, "c", 4.0, None, None), (3, None, 5.0, None, None), (4, "d", None, None, None)], kinds).drop("conditions")
    found = ev.field_f1(expected, predicted)
    got = found.first()
    assert (got["labels"], got["predicted"], got["matched"], round(got["f1"], 6)) == (11, 10, 5, round(10 / 21, 6))
    text = plan(found)
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1 and "field" not in text[text.index("Exchange hashpartitioning") :].split("\n")[0]


def test_answers_are_evaluated_once(spark):
    rows = spark.createDataFrame([(1, [3, 3, 2, 9, 0, 1, 0, None, 1, 1, 1, 1, 2, 2, 2, 2]), (2, [0] * 16), (3, [5] * 16)], "i int, a array<int>")
    skin = rows.select("i", dc.skin_type(F.transform("a", lambda x: x + 77 - 77)).alias("skin"))
    assert [tuple(r) for r in skin.orderBy("i").collect()] == [(1, "mixed"), (2, "neutral"), (3, "unclear")]
    assert skin._jdf.queryExecution().optimizedPlan().toString().count("+ 77") == 1


def test_texts_are_split_once(spark, tmp_path):
    spark.createDataFrame([(1, "ab. c。 \u3000；defgh！"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = t5_style(spark, str(tmp_path))
    assert [tuple(r)[:5] for r in found.orderBy("doc_id").collect()] == [(1, 15, 2, 5.0, 0.0), (2, 0, 0, 0.0, 0.0), (3, None, None, 0.0, 0.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1


def test_quick_tests_of_style_agree_with_the_patterns(spark):
    draw, parts = random.Random(3), ["a", "Z", "5", "12", "345", " ", "\n", "第", "天", "周", "小", "时", "小时", "分钟", "早上", "早", "上", "两周", "一个月", "个", "号", "色号", "色", "#", "_", "é", "。"]
    texts = [("".join(draw.choice(parts) for _ in range(draw.randint(0, 7))),) for _ in range(4000)] + [(None,)]
    cols = tx.style(F.col("t"))
    t = F.col("t")
    rows = spark.createDataFrame(texts, "t string").select(t, cols["has_time_detail"].eqNullSafe(t.rlike(lx.STYLE_TIME)).alias("time"), cols["has_shade_detail"].eqNullSafe(t.rlike(lx.STYLE_SHADE)).alias("shade"), cols["has_shade_detail"].alias("some"))
    assert rows.filter("not time or not shade").collect() == [] and 500 < rows.filter("some").count() < 3500


def test_rows_without_an_original_are_spread(spark):
    rows = [(f"h{i}", f"h{i - 2}" if i % 10 == 0 and i else None, True, False) for i in range(400)] + [(None, "h2", True, False), (None, None, True, False)]
    manifest = spark.createDataFrame(rows, "sha256 string, original_sha256 string, reviewed boolean, label_present boolean")
    mapping = spark.createDataFrame([(f"h{i}", f"n{i}") for i in range(0, 400, 2)] + [("h8", "n8")], "old string, new string")
    found = cu.rewritten_lineage(manifest, mapping)
    new = lambda d: "n" + d[1:] if d and int(d[1:]) % 2 == 0 else d
    got = found.select("sha256", "original_sha256", "reviewed", "label_present").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((new(a), new(b), False, None)) for a, b, _, _ in rows)
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        sizes = [len(part) for part in cu.rewritten_lineage(manifest, mapping).rdd.glom().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < 200


def test_verdicts_fold_before_the_registry(spark):
    verdicts = spark.createDataFrame([("a", i, ["high_risk", None, "credible"][i % 3]) for i in range(9)] + [("b", 1, None), ("c", 1, "credible")], "dataset string, file long, level string")
    found = ev.dataset_report(verdicts, spark.createDataFrame([("a", ["high_risk"]), ("b", ["credible"])], "dataset string, expect array<string>"))
    got = sorted(tuple(r) for r in found.select("dataset", "n_total", "n", "n_hit", "high_risk", "credible", "hit_rate", "full").collect())
    assert got == [("a", 9, 6, 3, 3, 3, 0.5, False), ("b", 1, 0, 0, 0, 0, None, False)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [dataset") == 2 and text.index("Join") < text.rindex("Aggregate [dataset")


def test_grams_are_counted_by_parts_of_a_batch(spark):
    ship(spark)
    rows = spark.createDataFrame([(["a", "b", None][i % 3], f"text {i % 7}") for i in range(3000)], "thread string, text string").coalesce(1)
    df = tx.gram_counts(rows, "thread", F.col("text"))
    assert {r["thread"]: r["c"] for r in df.groupBy("thread").agg(F.max("c").alias("c")).collect()} == {"a": 1000, "b": 1000, None: 1000}
    assert tx.COUNTED <= 1024
