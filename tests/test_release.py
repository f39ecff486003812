"""Release gates one by one, packed masks, calibration's and profiles' refusals."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import decide as dc
from auditloom.operators import evaluate as ev
from auditloom.plans import evaluate as plans

GOOD = {
    "origin": dict(fp_n=100, recall_n=100, fp_rate=0.05, recall_rate=0.8, uncertain_rate=0.25, missing_real=0, missing_generated=0),
    "families": [dict(recall_n=50, recall_rate=0.7), dict(recall_n=60, recall_rate=0.9)],
    "editing": dict(mask_groups=60, clean_n=100, mean_iou=0.4, clean_rate=0.1, missing_scores=0, missing_masks=0, untracked_scores=0, models=1),
    "claims": dict(f1=0.85, unsupported=0),
    "pairs": dict(cases=120, precision_rate=0.9, recall_rate=0.8, unavailable=5),
    "context": dict(cases=60, precision_rate=0.9, recall_rate=0.8, unavailable=0),
    "unavailable": dict(origin_tool=0, editing_tool=0),
}
#: Table, column, a value that fails, and the gates that it alone closes.
FAULTS = [
    *(("origin", c, v, {"origin"}) for c, v in dict(fp_n=99, recall_n=99, fp_rate=0.051, recall_rate=0.79, uncertain_rate=0.26, missing_real=1, missing_generated=1).items()),
    *(("families", c, v, {"origin"}) for c, v in dict(recall_n=49, recall_rate=0.69).items()),
    *(("editing", c, v, {"editing"}) for c, v in dict(mask_groups=59, clean_n=99, mean_iou=0.39, clean_rate=0.11, missing_scores=1, missing_masks=1, untracked_scores=1, models=2).items()),
    ("editing", "models", 0, {"editing"}), ("claims", "f1", 0.84, {"claims"}), ("claims", "unsupported", 1, {"claims"}), ("pairs", "cases", 119, {"claims", "crossmodal"}), ("pairs", "precision_rate", 0.89, {"crossmodal"}), ("pairs", "recall_rate", 0.79, {"crossmodal"}),
    *(("context", c, v, {"context"}) for c, v in dict(cases=59, precision_rate=0.89, recall_rate=0.79, unavailable=1).items()), ("unavailable", "origin_tool", 1, {"origin"}), ("unavailable", "editing_tool", 1, {"editing"}),
]


def gates(spark, change=None, families=None):
    tables = {k: [dict(r) for r in (v if isinstance(v, list) else [v])] for k, v in GOOD.items()}
    if change:
        tables[change[0]][0][change[1]] = change[2]
    if families is not None:
        tables["families"] = families
    frames = []
    for rows, like in zip(tables.values(), GOOD.values(), strict=True):
        like = like[0] if isinstance(like, list) else like
        frames.append(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {'double' if isinstance(v, float) else 'long'}" for c, v in like.items())))
    return ev.release_checks(*frames).first().asDict()


def test_each_fault_alone_closes_its_gates(spark):
    assert all(gates(spark).values())
    for table, column, value, closed in FAULTS:
        got = gates(spark, (table, column, value))
        assert {k for k, ok in got.items() if not ok} == closed, (table, column)
    for table, column in (("origin", "fp_rate"), ("editing", "mean_iou"), ("claims", "f1"), ("context", "recall_rate"), ("families", "recall_rate")):
        assert not all(gates(spark, (table, column, None)).values())
    assert not gates(spark, families=[])["origin"] and not gates(spark, families=[GOOD["families"][1]])["origin"]


def test_gates_of_the_query_rest_on_its_tables(spark):
    """Every input counts what the tables hold: unsupported claims, wrong context pairs, tools that were not there."""
    sf = "/root/testdata/sf0.001"
    origin, _, editing, claims, pairs, context, tools = (t.first() for t in plans._release(spark, sf))
    assert claims["unsupported"] == plans.a13_field_f1(spark, sf).first()["unsupported"] > 0
    assert 0 < context["precision_count"] < context["precision_n"] and context["cases"] < pairs["cases"] and context["unavailable"] > 0
    assert tools["origin_tool"] == origin["missing_real"] + origin["missing_generated"] > 0 and tools["editing_tool"] == editing["missing_scores"] > 0


def test_packed_masks(spark):
    rng = random.Random(3)
    rows = [([rng.random() < 0.5 for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]) for n in (1, 5, 63, 64, 65, 128, 300)] + [([], []), ([False] * 70, [False] * 70)]
    df = spark.createDataFrame(rows, "a array<boolean>, b array<boolean>")
    masks = [F.struct(F.lit(1).alias("height"), F.size(c).alias("width"), ev.packed(F.col(c)).alias("bits")) for c in "ab"]
    got = [r[0] for r in df.select(ev.mask_iou(*masks)).collect()]
    assert got == [sum(x and y for x, y in zip(a, b)) / sum(x or y for x, y in zip(a, b)) if any(a + b) else None for a, b in rows]
    other = F.struct(F.lit(2).alias("height"), F.size("a").alias("width"), ev.packed(F.col("b")).alias("bits"))
    with pytest.raises(Exception, match="another shape"):
        df.select(ev.mask_iou(masks[0], other)).collect()


def test_localization(spark):
    def mask(*cells):
        return (1, 4, [sum(1 << (3 - i) for i in cells)])

    rows = [
        ("a", "edited", 0.9, "m", "w", "p", mask(0, 1), mask(1)), ("a", "edited", 0.4, "m", "w", "p", mask(0), mask(0)), ("b", "edited", 0.8, "m", "w", "p", mask(2), None), ("c", "edited", None, None, None, None, mask(3), None),
        ("r", "real", 0.7, "m", "", "p", None, None), ("r", "real", 0.1, "m", "w", "p", None, None), ("s", "real", None, None, None, None, None, None), ("t", "real", 0.2, "n", "w", "p", None, None), ("x", "generated", 0.9, None, None, None, None, None)]
    kind = "struct<height int, width int, bits array<long>>"
    df = spark.createDataFrame(rows, f"grp string, kind string, score double, model string, weights string, preprocessing string, truth {kind}, predicted {kind}")
    got = ev.localization(df).first()
    assert (got["mask_groups"], got["missing_masks"], got["missing_scores"], got["untracked_scores"], got["models"], got["clean_n"], got["clean_count"]) == (3, 1, 2, 1, 2, 2, 1)
    assert abs(got["mean_iou"] - (0.25 + 0 + 0) / 3) < 1e-12
    assert {r["grp"]: (r["masks"], r["mean_iou"]) for r in ev.localized(df).collect()} == {"a": (2, 0.25), "b": (1, 0.0), "c": (1, 0.0)}


def test_field_cells_skip_nulls_and_empty_lists(spark):
    kind = "case int, quote string, product string, conditions array<string>, duration_days int"
    a = spark.createDataFrame([(1, "q", "P", ["x"], None), (1, "r", None, [], 7)], kind)
    b = spark.createDataFrame([(1, "q", "P", ["y"], None), (1, "r", "P", None, 7)], kind)
    got = ev.field_f1(a, b).first()
    assert (got["labels"], got["predicted"], got["matched"]) == (5, 6, 4)


def test_unsupported_claims(spark):
    claims = spark.createDataFrame([(1, i, "supported", "CN", "v1") for i in range(9)] + [(1, 9, "conflict", "CN", "v1"), (1, 10, "supported", "", "v1"), (1, 11, "supported", "CN", None)], "case int, claim int, status string, market string, product_version string")
    good = ("reviewer_verified", "efficacy_study", "s", "l", True, "CN", "v1")
    faults = [good, ("brand", *good[1:]), (good[0], "brand", *good[2:]), (*good[:2], None, *good[3:]), (*good[:3], "", *good[4:]), (*good[:4], None, *good[5:]), (*good[:5], "US", "v1"), (*good[:6], "v2")]
    refs = spark.createDataFrame([(1, i, *r) for i, r in enumerate(faults)] + [(1, 10, *good[:5], "", "v1"), (1, 11, *good[:6], None)], "case int, claim int, verification string, source_type string, source string, locator string, matches boolean, market string, product_version string")
    assert sorted(r["claim"] for r in ev.unsupported_claims(claims, refs).collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 11]


def test_calibration_refuses(spark):
    kind = "grp int, kind string, score double, model string, weights string, preprocessing string"
    rows = [(i, "real", 0.1 + i / 100, "m", "w", "p") for i in range(20)] + [(30 + i, "generated", 0.6 + i / 100, "m", "w", "p") for i in range(20)]
    got = ev.calibrated(spark.createDataFrame(rows, kind)).first()
    assert got["recall"] == 1.0 and got["fp_rate"] == 0.0 and got["model"] == "m" and got["approved"] is False
    for extra, said in (((50, "real", None, "m", "w", "p"), "missing"), ((50, "real", 0.1, "n", "w", "p"), "several"), ((50, "real", 0.1, "m", "", "p"), "without"), ((50, "edited", 0.1, "m", "w", "p"), "other")):
        with pytest.raises(ValueError, match=said):
            ev.calibrated(spark.createDataFrame([*rows, extra], kind))
    with pytest.raises(ValueError, match="no real"):
        ev.calibrated(spark.createDataFrame(rows[20:], kind))


def test_profiles_match_by_identity(spark):
    e = spark.createDataFrame([(1, "m", "w", "p", True, False, 0.5), (2, "m", "x", "p", True, False, 0.5), (3, "m", None, "p", True, False, 0.5), (4, "d", "w", "p", True, False, 0.5), (5, "bad", "w", "p", True, False, 0.5)], "asset int, model string, weights string, preprocessing string, available boolean, review_only boolean, raw_score double")
    p = [("m", "w", "p", 0.2, 0.4, True), ("m", "w", "p", 0.2, 0.4, True), ("m", "x", "p", 0.2, 0.4, False), ("d", "w", "p", 0.1, 0.2, True), ("d", "w", "p", 0.6, 0.7, True), ("bad", "w", "p", 0.5, 0.4, True), ("bad", "w", "p", -0.1, 0.4, True), ("bad", "w", "p", 0.1, 1.4, True)]
    got = dc.image_signals(e, spark.createDataFrame(p, "model string, weights string, preprocessing string, low double, high double, approved boolean"), "d").collect()
    assert {r["asset"]: r["status"] for r in got} == {1: "likely", 2: "uncalibrated", 3: "uncalibrated", 4: "uncalibrated", 5: "uncalibrated"} and len(got) == 5
    assert {r["asset"] for r in got if r["decision_score"] is not None} == {4}
