"""Text scanning: stances, word hits, markers, and every pattern of claims."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import scan
from auditloom.functions.shipping import ship
from auditloom.operators import claims as cl


@pytest.fixture(scope="module")
def ready(spark):
    ship(spark)
    return spark


def one(spark, text, column, **more):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"), **more).alias("x")).first()["x"]


def stances(spark, cases):
    words = {"w": sorted({w for _, w, _ in cases})}
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, text string")
    found = rows.select("i", F.explode(scan.found(F.col("text"), [(w, (w,)) for w in words["w"]], "|".join(words["w"]))).alias("m")).select("i", F.col("m.entry"), scan.stance(F.col("m")).alias("s"))
    return {(r["i"], words["w"][r["entry"]]): r["s"] for r in found.collect()}


def test_stances(ready):
    cases = [
        ("本品不能治疗湿疹", "治疗", "negated"), ("治疗湿疹的说法不成立", "治疗", "negated"), ("能治疗吗？", "治疗", "question"), ("能治疗吗?再说", "治疗", "question"), ("有人声称“七天美白”", "七天美白", "quoted"),
        ("「七天美白」的说法", "七天美白", "quoted"), ('"七天美白"很好', "七天美白", "asserted"), ("七天美白", "七天美白", "asserted"), ("不油，治疗", "治疗", "asserted"), ("不能。治疗", "治疗", "asserted"),
        ("不能用于 治疗", "治疗", "negated"), ("评论“首行\n七天美白”", "七天美白", "quoted"),
    ]
    cases += [(f"{w}治疗", "治疗", "negated") for w in lx.DENIALS.split("|")] + [(f"不{w}最佳", "最佳", "negated") for w in lx.ACTIONS.split("|")]
    got = stances(ready, cases)
    assert [(t, got[i, w]) for i, (t, w, _) in enumerate(cases)] == [(t, s) for t, _, s in cases]


def test_clauses(ready):
    got = one(ready, "。甲乙？\n\n😀丙；丁", scan.clause_spans)
    assert [tuple(c) for c in got] == [("甲乙", 1, 3), ("😀丙", 6, 8), ("丁", 9, 10)]
    assert one(ready, "", scan.clause_spans) == one(ready, None, scan.clause_spans) == []


def test_question_and_clinical_wording_are_only_reviewed(ready):
    text = "最佳选择？经临床验证。根治湿疹，根治"
    hits = one(ready, text, scan.scanned)
    assert {(h["word"], h["severity"]) for h in hits} == {("最佳", "review"), ("临床验证", "review"), ("根治", "high"), ("根治", "medium"), ("湿疹", "high")}
    assert sorted(h["position"] for h in hits if h["category"] == "promise") == [11, 16]
    assert all(h["context"] == text[max(0, h["position"] - 12) : h["position"] + len(h["word"]) + 12] for h in hits)


#: text, and its claims' (metric, variant, value, shade, unit, days, stance)
CASES = [
    ("角质层含水量 增加 30.5 %", [("水分提升", None, 30.5, None, "%", None, "asserted")]),
    ("水分提升３０％", [("水分提升", None, 30.0, None, "%", None, "asserted")]),
    ("98%的天然来源", [("天然来源比例", None, 98.0, None, "%", None, "asserted")]),
    ("天然来源成分占比达 95%", [("天然来源比例", None, 95.0, None, "%", None, "asserted")]),
    ("2周斑点面积减少20%", [("斑点减少", None, 20.0, None, "%", 14.0, "asserted")]),
    ("保湿长达3天", [("保湿时长", None, 72.0, None, "h", None, "asserted")]),
    ("保湿持续 12 小时", [("保湿时长", None, 12.0, None, "h", None, "asserted")]),
    ("24H持久保湿", [("保湿时长", None, 24.0, None, "h", None, "asserted")]),
    ("正装容量：30ML，小样5克", [("规格", "正装", 30.0, None, "ml", None, "asserted"), ("规格", "小样", 5.0, None, "g", None, "asserted")]),
    ("色号：a12 和 ＃B3", [("色号", None, None, "A12", "色号", None, "asserted"), ("色号", None, None, "B3", "色号", None, "asserted")]),
    ("美白又祛斑", [("美白", None, None, None, None, None, "asserted"), ("祛斑", None, None, None, None, None, "asserted")]),
    ("美白，斑点减少20%", [("斑点减少", None, 20.0, None, "%", None, "asserted")]),
    ("真人使用前后，原图直出", [(lx.METRIC_PHOTO, None, None, None, None, None, "asserted")]),
    ("非实拍", [(lx.METRIC_PHOTO, None, None, None, None, None, "negated")]),
    ("7天1周水分提升5%？", [("水分提升", None, 5.0, None, "%", 7.0, "question")]),
    ("7天2周水分提升5%", [("水分提升", None, 5.0, None, "%", None, "asserted")]),
    ("plain words 100%", []), (None, []), ("", []),
]


def test_each_pattern_of_claims(ready):
    rows = cl.claim_table(ready.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "i int, text string, quote string"), ["i"]).orderBy("i", "idx").collect()
    got = {}
    for r in rows:
        got.setdefault(r["i"], []).append((r["metric"], r["variant"], r["value"], r["shade"], r["unit"], r["days"], r["stance"]))
    assert [(t, got.get(i, [])) for i, (t, _) in enumerate(CASES)] == CASES


def test_fields_of_claims(ready):
    text = "【甲精华】2024版，敏感肌和油皮连续使用2周水分提升30%。\n 产品名称： 乙面霜 ，第3代新版实验室保湿；甲精华：控油"
    first, second, third = cl.claim_table(ready.createDataFrame([(1, text)], "i int, text string"), ["i"]).orderBy("idx").collect()
    assert (first["product"], first["version"], first["population"], first["conditions"], first["start"]) == ("甲精华", "2024版", ["敏感肌", "油皮"], ["连续使用"], 0)
    assert (second["product"], second["version"], second["conditions"], second["quote"][:4]) == ("乙面霜", "ambiguous", ["实验室"], "产品名称")
    assert third["product"] is None  # two products are declared
    given = cl.claim_table(ready.createDataFrame([(1, "用甲精华：控油"), (2, "用，甲精华：控油"), (3, "甲精华液控油")], "i int, text string"), ["i"], product=F.lit("甲精华")).orderBy("i").collect()
    assert [r["product"] for r in given] == [None, "甲精华", None]


def test_whole_names(ready):
    cases = [("用，甲精华：好", "甲精华", True), ("甲精华液", "甲精华", False), ("x甲精华", "甲精华", False), ("a", None, False), ("a", "", False), ("说a.b+c", "a.b+c", False), ("说 a.b+c!", "a.b+c", True), ("\\E x", "\\E", True)]
    rows = ready.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n string").select("i", scan.names_product(F.col("t"), F.col("n")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [x for *_, x in cases]


def test_markers(ready):
    got = one(ready, "无滤镜，实拍。非实物拍摄", scan.marked, markers=lx.REAL_SHOT)
    assert got["words"] == ["实拍"] and got["position"] == 4 and got["denied"] == 1
    none = one(ready, None, scan.marked, markers=lx.REAL_SHOT)
    assert none["words"] == [] and none["position"] is None and none["denied"] == 0


def test_disclosure(ready):
    assert one(ready, "本图为AI示意图", scan.is_disclosed) and not one(ready, "没有AI示意图", scan.is_disclosed)
    assert one(ready, "效果图（ai生成）", scan.is_disclosed) and one(ready, "本图AI\n示意图", scan.is_disclosed) and one(ready, None, scan.is_disclosed) is None


def test_assessment_binds_product_and_version(ready):
    schema = "text string, ref_product string, ref_version string, reviewed boolean, ref_market string, ref_type string, stated array<string>"
    quote = "【甲精华】2024版14天水分提升30%"
    claims = cl.claim_table(ready.createDataFrame([(1, quote)], "doc int, text string"), ["doc"])

    def status(text, product="甲精华", version="2024版", reviewed=True, market="CN", kind="efficacy_study", stated=(None, "水分"), clash=False):
        refs = ready.createDataFrame([(text, product, version, reviewed, market, kind, list(stated))], schema)
        facts = cl.claim_table(refs, [c for c in refs.columns if c != "text"])
        return cl.assess(claims, facts, claims.filter(F.lit(clash)), "CN").first()["status"]

    bare = "【甲精华】14天水分提升30%"
    assert status(bare) == "supported" and status(bare.replace("30", "40")) == "conflict" and status(bare, clash=True) == "conflict"
    for odd in ({"product": "乙精华"}, {"version": "2023版"}, {"version": None}, {"reviewed": False}, {"market": "US"}, {"kind": "brand_claim"}, {"stated": ("每日",)}):
        assert status(bare, **odd) == "insufficient"


def test_plain_texts_are_scanned_as_others_are(ready):
    """The scan of a batch at once against the one clause by clause, on texts mixed from parts of claims, stops, quotes, wide and odd characters."""
    import random

    parts = ["水分提升", "含水量 增加", "30%", "５ %", "98%的天然来源", "天然来源占比达 9%", "斑点减少4%", "2周", "14 天", "3日", "保湿长达3天", "24H保湿", "正装：30ML", "小样5克", "色号：a1", "# B3", "美白", "祛斑", "实拍", "真人使用前后", "。", "？", "?", "!", "\n", "；", "，", " ", "不能", "没有", "的说法错误", "第二代", "2024版", "旧版", "敏感肌", "每天", "产品：甲 ", "产品 : 乙，", "【丙精华】", "【 丁面膜 】", "【x】", "」", "「", '"', "　", " ", "㎡", "é", "豈"]
    draw = random.Random(5)
    texts = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(1, 14))), draw.choice([None, "", "甲", "丁"])) for i in range(3000)] + [(-1, None, None), (-2, "", None)]
    rows = ready.createDataFrame(texts, "i int, text string, own string")
    quick, slow = (sorted(map(str, cl.claim_table(rows, ["i"], product=rows["own"], **more).collect())) for more in ({}, {"plain": r"\Anone\z"}))
    assert quick == slow and len(quick) > 2000


def test_captions_are_scanned_by_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scan, "_scanner", lambda *_: lambda texts: pytest.fail(f"{len(texts)} texts clause by clause"))
    texts = pa.array(["【P1精华】2天水分提升5%。\n【P2精华】3天水分提升6%，治疗。", "【P3精华】2天不能水分提升5%。", None, "words", "【P4精华】2天水分提升5%？"])
    owner, rows = scan._claims_of(texts, pa.nulls(5, pa.string()), scan.CLAIMS, lx.CLAIM_HINT, scan.PLAIN)
    got = sorted(zip(owner.tolist(), *(rows[c].to_pylist() for c in ("nth", "own", "days", "g1", "at", "stop", "entry")), strict=True), key=str)
    assert got == [(0, 0, "P1精华", 2.0, "5", 8, "。", 0), (0, 1, "P2精华", 3.0, "6", 8, "。", 0), (0, 1, "P2精华", 3.0, None, 15, "。", 8), (1, 0, "P3精华", 2.0, "5", 10, "。", 0), (4, 0, "P4精华", 2.0, "5", 8, "？", 0)]
