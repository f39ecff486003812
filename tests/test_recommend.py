"""Recommendations against a loop over all profiles and items."""

import random

from sqlcheck import connect, same

from auditloom.operators import decide as dc
from auditloom.plans.decide import J17_SQL, j17_recommendations

PROFILE = "profile long, type string, goals array<string>, textures array<string>, avoid array<string>, sensitivity int"
ITEM = "name string, market string, category string, skin array<string>, goals array<string>, textures array<string>, gentle boolean, ingredients array<string>"


def looped(profiles, items, keep=3):
    out = []
    for profile, kind, goals, textures, avoid, sensitivity in profiles:
        fit = []
        for name, market, _, skin, has_goals, has_textures, gentle, ingredients in items:
            if market != "CN" or kind == "unclear" or kind not in (skin or []) or not (sensitivity is None or sensitivity < 2 or gentle):
                continue
            if avoid is None or avoid:
                if avoid is None or None in avoid or ingredients is None or None in ingredients or any(t in g.lower() for g in ingredients for t in avoid):
                    continue
            common = lambda a, b: len({x for x in a or [] if x is not None} & {x for x in b or [] if x is not None})
            fit.append((-common(goals, has_goals) - common(textures, has_textures), name))
        out += [(profile, i + 1, name, -score) for i, (score, name) in enumerate(sorted(fit)[:keep])]
    return sorted(out)


def drawn(seed, n_profiles, n_items):
    r = random.Random(seed)
    some = lambda pool, most: None if r.random() < 0.05 else [r.choice(pool) for _ in range(r.randint(0, most))]
    words, kinds = [*"abcde", None], ["dry", "oily", "unclear"]
    profiles = [(i, r.choice(kinds), some(words, 4), some(words, 2), some(["acid", "oil", "x y", "", None], 2) if r.random() < 0.5 else [], r.choice([None, 0, 1, 2, 3])) for i in range(n_profiles)]
    items = [(f"n{r.randrange(n_items * 2):04d}-{i}", r.choice(["CN", "CN", "US"]), "c", some(kinds, 2), some(words, 4), some(words, 2), r.choice([True, False, None]), some(["Acid Q", "Olive OIL", "aX Yb", "water", "", None], 3)) for i in range(n_items)]
    return profiles, items


def check(spark, profiles, items):
    got = dc.recommendations(spark.createDataFrame(profiles, PROFILE), spark.createDataFrame(items, ITEM), "CN")
    assert sorted(map(tuple, got.collect())) == looped(profiles, items)


def test_against_a_loop(spark):
    check(spark, *drawn(3, 60, 80))


def test_few_items_and_empty_tables(spark):
    profiles, _ = drawn(5, 20, 1)
    check(spark, profiles, [("n", "CN", "c", ["dry", "dry"], ["a"], [], True, [])])
    check(spark, profiles, [])
    check(spark, [], drawn(6, 1, 9)[1])


def test_sql_at_the_middle_scale(spark):
    sf = "/root/testdata/sf0.01"
    same(j17_recommendations(spark, sf), connect(sf), J17_SQL)
