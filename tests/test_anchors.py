"""Two-sided anchors, references by lists, the word automaton, packages: against plain loops."""

import random
import re
import time

from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx
from auditloom.functions import scan
from auditloom.operators import claims as cl
from auditloom.operators import curate as cu

REFS = "ref_id string, excerpt string, source string, source_type string, locator string, " + ", ".join(f"{c} string" for c in cl.CONDITIONS)


def test_both_quotes_must_stand_once(spark):
    refs = spark.createDataFrame([("r1", "tested on dry skin. dry skin only", "study", "efficacy_study", None, "v1", "", None, "m", None, None, "28", None), ("r2", None, "s", None, None, *[None] * 8)], REFS)
    text = "good for all skin, aaa, oily skin and no other"
    rows = [
        (1, "all skin", "oily skin", None, "fact", "why"), (2, "skin", "oily skin", None, "fact", "why"), (3, "all skin", "skin", None, "fact", "why"), (4, "all skin", "all skin", None, "fact", "why"), (5, "all skin", "tested on", "r1", "odd", "x" * 600), (6, "all skin", "dry skin", "r1", "fact", "why"),
        (7, "all skin", "oily skin", "r1", "fact", "why"), (8, "all skin", "oily skin", "r9", "fact", "why"), (9, "all skin", "oily skin", "", "fact", "why"), (10, " ", "oily skin", None, "fact", "why"), (11, "all skin", "oily skin", None, "fact", "\n　"), (12, "all skin", None, None, "fact", "why"),
        (13, "made up", "oily skin", None, "fact", "why"), (14, "aa", "oily skin", None, "fact", "why"), (15, "all skin", "any", "r2", "fact", "why"), (16, "all skin", "tested on dry skin. dry", "r1", "fact", "why"), (17, "all skin", "tested on", "r1", None, "why")]
    df = spark.createDataFrame([(d, text, q, o, r, t, w) for d, q, o, r, t, w in rows] + [(18, None, "a", "b", None, "fact", "why")], "doc int, text string, quote string, other_quote string, ref_id string, type string, reason string")
    got = {r["doc"]: r for r in cl.anchored(df, refs, ("fact",), "other").collect()}
    assert set(got) == {1, 5, 9, 14, 16, 17}  # "aa" stands once in "aaa", counted without overlap
    assert (got[5]["type"], len(got[5]["reason"]), got[5]["source"], got[5]["source_type"], got[5]["reference_conditions"]) == ("other", 500, "study", "efficacy_study", {"version": "v1", "method": "m", "period": "28"})
    assert (got[1]["source"], got[1]["source_type"], got[1]["reference_conditions"], got[9]["ref_id"], got[17]["type"]) == ("正文", None, {}, None, "other")


def test_references_against_a_loop(spark):
    rng = random.Random(5)
    refs = [(i, rng.randrange(500), rng.choice("PPPPQ"), rng.choice("AB"), rng.choice([None, 1, 2, 3])) for i in range(400)]
    posts = [(i, rng.choice("PQR"), rng.choice("AB"), rng.choice([None, 1, 2, 9]), rng.choice([None, [], [rng.randrange(420) for _ in range(rng.randrange(12))]])) for i in range(300)]
    p = spark.createDataFrame(posts, "post long, product string, market string, version int, chosen array<long>")
    r = spark.createDataFrame(refs, "ref_id long, ord long, product string, market string, version int")
    want = []
    for post, product, market, version, chosen in posts:
        fit = [(chosen.index(i) if chosen and i in chosen else 1 << 30, o, i) for i, o, pr, m, v in refs if (pr, m) == (product, market) and (version is None or v is None or v == version)]
        want += [(post, i, n, len(fit)) for n, (_, _, i) in enumerate(sorted(fit)[:8], 1)]
    assert sorted(map(tuple, cl.eligible_references(p, r).collect())) == sorted(want)


def test_a_hot_product_makes_no_row_a_pair(spark):
    posts = spark.range(20_000).select(F.col("id").alias("post"), F.lit("P").alias("product"), F.lit("A").alias("market"), F.lit(None).cast("int").alias("version"), F.array(F.lit(7).cast("long")).alias("chosen"))
    refs = spark.range(20_000).select(F.col("id").alias("ref_id"), F.col("id").alias("ord"), F.lit("P").alias("product"), F.lit("A").alias("market"), (F.col("id") % 3).cast("int").alias("version"))
    got = cl.eligible_references(posts, refs)
    assert got.count() == 160_000 and got.agg(F.sum("ref_id")).first()[0] == 20_000 * 28 and got.filter("place = 1 and ref_id = 7 and total = 20000").count() == 20_000


def plain_rows(text, words):
    """What a pattern for each word finds, clause by clause."""
    out = []
    for nth, c in enumerate(re.finditer(f"[^{lx.STOPS}]+", text)):
        for i, w in enumerate(words):
            out += [(nth, i, k, m.start()) for k, m in enumerate(re.finditer(re.escape(w), c[0]))] if w else []
    return out


def test_word_automaton(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("ab最好", k=rng.randint(1, 4))) for _ in range(90)] + ["a", "aa", "", "好。a"]
    texts = ["".join(rng.choices("ab最好。，!", k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "aaaa", "好。a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for own in (words, words + ["w" + str(i) for i in range(300)]):
        got = {r["i"]: [(m["nth"], m["entry"], m["k"], m["at"]) for m in r["m"] or []] for r in df.select("i", scan.words_found(F.col("t"), own).alias("m")).collect()}
        assert got == {i: plain_rows(t or "", own) for i, t in enumerate(texts)}
    assert df.select(F.size(scan.words_found(F.col("t"), [])).alias("n")).filter("n > 0").count() == 0


def test_word_automaton_time_does_not_follow_the_number_of_words():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghij ", k=2000)) for _ in range(60)]

    def took(n):
        words = tuple("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
        scan._words_of("x", words)
        began = time.process_time()
        for t in texts:
            scan._words_of(t, words)
        return time.process_time() - began

    few, many = took(75), took(7500)
    assert many < 10 * few + 0.2


def test_packages(spark):
    m = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "stem string, kind string")
    kinds = spark.createDataFrame([("x", "t", "s", "o"), ("y", "t2", None, None)], "kind string, truth string, scene string, source string")
    got = cu.packages(m, kinds, spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "stem string, pos int, text string"), spark.createDataFrame([("a",), ("a",), ("c",)], "stem string"))
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "t", "s", "o", "early", True), ("b", "t2", "generated", "own", None, False), ("c", "unknown", "generated", "own", None, True)]
    assert [tuple(r) for r in cu.missing_files(got).collect()] == [("b", "t2")]
