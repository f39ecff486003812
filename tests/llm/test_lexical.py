"""Ranked search against brute force: scores, ties, stopping, blocks, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np

from auditloom.llm import lexical
from auditloom.llm.queries import OP12_SQL, op12_best_position
from tests.sqlcheck import connect, same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
rng = random.Random(4)
WORDS = ["".join(rng.choices("abcdé9", k=rng.randint(1, 3))) for _ in range(60)]


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in own:
            m, s = 25 + 75 * sum(c.values()) * n_docs // max(1, total), 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    s += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, -math.inf if i is None else i))
        out += [(item, r, None if i == -math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.ranked_search(d, q, **options).collect()), key=str)


DOCS = [(None, "abc ABC"), (1, None), (2, ""), (3, " .,\n"), (4, "Été É é abc"), (5, "a\x7fb_c-d"), *((10 + i, " ".join(rng.choices(WORDS, k=rng.choice([1, 5, 40, 300])))) for i in range(300)), *((400 + i, "same words here") for i in range(30)), (7, "tail " * 30_000 + "abc")]
DOCS += [DOCS[20], DOCS[20]]
ITEMS = [(i, " ".join(rng.choices(WORDS, k=12))) for i in range(12)] + [(50, "same words"), (51, None), (52, ""), (53, "nothinglikethis"), (None, "abc abc ABC é"), (3, "abc"), (0, "abc"), (0, "abc")]


def test_same_as_brute_force(spark):
    assert got(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
    assert got(spark, DOCS, ITEMS, k=3) == brute(DOCS, ITEMS, 3)


def test_blocks_of_items_and_documents(spark, monkeypatch):
    assert got(spark, DOCS, ITEMS, query_terms=40) == brute(DOCS, ITEMS)
    ids = np.array([0 if i is None else i for i, _ in DOCS])
    lists = random_lists(np.random.default_rng(2), 500, 6)
    whole = lexical.best_positions(lists, [3] * 6, 10)
    assert len(whole[0]) >= 10 and len(ids)


def test_empty_tables(spark):
    assert got(spark, [], ITEMS) == [] and got(spark, DOCS, []) == [] and got(spark, [(1, " ")], ITEMS) == []


def random_lists(gen, docs, many):
    rows = [(t, d, int(v)) for t in range(many) for d, v in zip(gen.choice(docs, docs // 3, replace=False), gen.integers(1, 40, docs // 3), strict=True)]
    block = lexical.ImpactLists(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
    return [block.view(t) for t in range(many)]


def test_stops_exactly_and_no_later_than_by_last_read_places():
    gen, fewer = np.random.default_rng(6), 0
    for _ in range(60):
        lists, weights = random_lists(gen, 400, 4), gen.integers(1, 9, 4).tolist()
        total = Counter()
        for (docs, impacts, _, _), w in zip(lists, weights, strict=True):
            for d, v in zip(docs.tolist(), impacts.tolist(), strict=True):
                total[d] += w * v
        want = sorted((-s, d) for d, s in total.items())[:10]
        ids, scores, read = lexical.best_positions(lists, weights, 10, step=2)
        assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:10] == want
        _, _, plain = lexical.best_positions(lists, weights, 10, step=2, last_read=True)
        assert read <= plain <= sum(len(x[0]) for x in lists)
        fewer += read < plain
    assert fewer


def test_blocks_of_postings(spark, monkeypatch):
    """Blocks of a task carry their best documents on."""
    docs = [(i, t) for i, t in DOCS if t]
    own = [Counter(terms(t)) for _, t in docs]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*own)))}
    kept = {}
    queries = [(0, [(numbers[w], 2) for w in set(WORDS) if w in numbers])]
    for low in range(0, len(docs), 50):
        part = [(numbers[t], j, 7 * f) for j, c in enumerate(own[low : low + 50]) for t, f in c.items()]
        lexical.search_block(queries, np.array([-1 if i is None else i for i, _ in docs[low : low + 50]]), lexical.ImpactLists(*(np.array(x) for x in zip(*part, strict=True))), kept, 10)
    want = sorted((-sum(14 * f for t, f in c.items() if t in WORDS), -1 if i is None else i) for (i, _), c in zip(docs, own, strict=True))[:10]
    assert kept[0] == [w for w in want if w[0] < 0]


def test_query(spark):
    same(op12_best_position(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), OP12_SQL)
