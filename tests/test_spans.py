"""Line offsets and spans against plain loops, and on one very long document."""

import random

from pyspark.sql import functions as F

from auditloom.functions.ranking import summed_before
from auditloom.operators import claims as cl


def offsets(texts):
    out, at = [], 0
    for t in texts:
        out.append((at, None if t is None else at + len(t)))
        at += 0 if t is None else len(t) + 1
    return out


def test_offsets_and_spans_equal_a_loop(spark):
    draw = random.Random(5)
    docs = {d: [draw.choice(["", "", "a", "bc", None, "x" * draw.randrange(40)]) for _ in range(draw.randrange(1, 40))] for d in range(12)} | {None: ["ab", "c"]}
    lines = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc long, line_no int, text string")
    got = {(r.doc, r.line_no): (r.start, r.end) for r in cl.line_offsets(lines).collect()}
    want = {(d, i): o for d, ts in docs.items() for i, o in enumerate(offsets(ts))}
    assert got == want
    spans = [(d, a, a + draw.choice([-1, 0, 0, 1, 3, 50, 500]), f"s{i}") for i, (d, a) in enumerate((draw.randrange(14), draw.randrange(300)) for _ in range(300))] + [(3, None, 4, "null"), (3, 1, None, "null"), (None, 0, 9, "null")]
    df = spark.createDataFrame(spans, "doc long, from_ long, to_ long, name string")
    loop = sorted((d, i, s, e, name) for d, a, b, name in spans if d is not None and a is not None and b is not None and a <= b for (x, i), (s, e) in want.items() if x == d and e is not None and s < b and e > a)
    for width in (1, 7, 64, 4096):
        rows = cl.span_lines(lines, df, width).select("doc", "line_no", "start", "end", "name").collect()
        assert sorted(map(tuple, rows)) == loop


def test_sums_cross_blocks(spark):
    rows = spark.createDataFrame([(g, i * 3 - 40, i % 5) for g in (1, 2) for i in range(100)], "g int, o int, v int")
    got = {(r.g, r.o): r.s for r in summed_before(rows, "g", "o", F.col("v"), "s", block=8).collect()}
    assert got == {(g, i * 3 - 40): sum(j % 5 for j in range(i)) for g in (1, 2) for i in range(100)}


def test_empty_tables(spark):
    lines, spans = spark.createDataFrame([], "doc long, line_no int, text string"), spark.createDataFrame([(1, 0, 5)], "doc long, from_ long, to_ long")
    assert cl.line_offsets(lines).count() == 0 and cl.span_lines(lines, spans).count() == 0


def test_one_document_of_a_million_lines(spark):
    """100,000 spans of two lines each over a million lines: every span touches its own lines, and no task gets the document."""
    n, m = 1_000_000, 100_000
    lines = spark.range(n).select(F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("line_no"), F.lit("0123456789").alias("text"))
    spans = spark.range(m).select(F.lit(1).cast("long").alias("doc"), (F.col("id") * 110 + 5).alias("from_"), (F.col("id") * 110 + 16).alias("to_"), "id")
    out = cl.span_lines(lines, spans).agg(F.count("*"), F.count_if((F.col("line_no") == F.col("id") * 10) | (F.col("line_no") == F.col("id") * 10 + 1))).first()
    assert tuple(out) == (2 * m, 2 * m)
