"""Both sides of a document scanned at once give what two scans give."""

from auditloom.operators import claims as cl

TEXTS = [
    (1, "【A精华】14天水分提升30%。不能保湿24小时", "【A精华】14天水分提升30%"), (2, "【A精华】14天水分提升30%", "【A精华】14天水分提升28%"),
    (3, "【A精华】14天水分提升30%", None), (4, None, "【A精华】14天水分提升30%"), (5, "【A精华】14天水分提升30%", "【A精华】14天水分提升30%。\n【A精华】14天水分提升30%"), (6, "", ""), (None, "【A精华】14天水分提升30%", ""),
]


def test_align_sides_equals_align(spark):
    rows = spark.createDataFrame(TEXTS, "doc long, body string, image string")
    two = cl.align(*(cl.claim_table(rows, ["doc"], side) for side in ("body", "image")))
    got = cl.align_sides(rows)
    assert got.columns == two.columns
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(two)
    assert {(r.doc, r.status) for r in got.collect()} == {(1, "equal"), (2, "conflict"), (3, "none"), (5, "many"), (None, "none")}


def test_align_sides_of_nothing(spark):
    assert cl.align_sides(spark.createDataFrame([], "doc long, body string, image string")).count() == 0
