"""Mean similarity over all pairs of a key against a loop."""

import random
from itertools import combinations

import pytest
from sqlcheck import connect, same

from auditloom.operators import comments as cm
from auditloom.plans.comments import A7_SQL, A8_SQL, a7_accounts, a8_matrix


def grams(text, n=4):
    return {text} if len(text) < n else {text[i : i + n] for i in range(len(text) - n + 1)}


def alike(a, b, blank):
    if not a and not b:
        return blank
    return 0.0 if not a or not b else len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def wanted(rows, blank):
    out = {}
    for key in {r[0] for r in rows}:
        texts = [t for k, _, t in rows if k == key]
        values = [alike(a, b, blank) for a, b in combinations(texts, 2)]
        out[key] = sum(values) / len(values) if values else None
    return out


def drawn(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice("abc好😀") for _ in range(r.choice([0, 1, 3, 5, 12, 40])))
    rows = [("large", i, text()) for i in range(150)] + [("copies", i, r.choice(["same text", "same texts", "other"])) for i in range(90)]
    rows += [("few", i, text()) for i in range(6)] + [("one", 0, "abcdef"), ("blank", 0, ""), ("blank", 1, ""), ("blank", 2, "abc"), ("long", 0, "abcd" * 3000), ("long", 1, "abce" * 3000)]
    return rows


@pytest.mark.parametrize("blank,block", [(1.0, 512), (0.0, 40)])
def test_equal_to_all_pairs(spark, monkeypatch, blank, block):
    monkeypatch.setattr(cm, "PAIR_BLOCK", block)
    monkeypatch.setattr(cm, "PAIR_CHARS", 5000)
    rows = drawn(7)
    got = dict(map(tuple, cm.mean_similarity(spark.createDataFrame(rows, "key string, idx long, norm string"), "key", "m", blank).collect()))
    want = wanted(rows, blank)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) if want[k] is not None else got[k] is None for k in want)


def test_empty_table(spark):
    assert cm.mean_similarity(spark.createDataFrame([], "key string, idx long, norm string"), "key", "m").count() == 0


def test_sql_at_the_middle_scale(spark):
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    same(a7_accounts(spark, sf), con, A7_SQL)
    same(a8_matrix(spark, sf), con, A8_SQL)
