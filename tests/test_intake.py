"""Streams whose files come again or in another order give the batch query's rows."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import curate as cu
from auditloom.operators import decide as dc
from auditloom.sources import io
from auditloom.streaming import audit, intake

KEY = ["source", "excerpt"]
ROWS = "source string, excerpt string, source_type string"


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_import_equals_batch(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["a", "b", None]), draw.choice(["x", "y", "z", "w", None]), draw.choice(["brand_claim", "method", None])) for _ in range(60)]
    cat = spark.createDataFrame([("a", "x", "brand_claim"), (None, None, "brand_claim")], ROWS)
    want = rows_of(cu.imported(spark.createDataFrame(rows, ROWS), cat, KEY))
    assert len(want) == len(set(want))
    incoming, path, checkpoint = (str(tmp_path / x) for x in ("in", "cat", "check"))
    draw.shuffle(rows)
    for part in (rows[:20], rows[10:45], rows[:20], rows[40:]):  # some come again
        spark.createDataFrame(part, ROWS).repartition(2).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(incoming)
        intake.import_stream(stream, cat, path, checkpoint, KEY).awaitTermination()
    kept = intake.batches(spark, path, cat.schema)
    assert rows_of(kept.drop("batch")) == want
    assert kept.agg(F.max("batch")).first()[0] > 4
    assert rows_of(cu.imported(kept.drop("batch"), kept.drop("batch"), KEY)) == want  # twice changes nothing, null keys included


def test_batch_again_after_a_failure(spark, tmp_path):
    cat = spark.createDataFrame([], ROWS)
    path = str(tmp_path / "cat")
    cat.write.parquet(f"{path}/batch=-1")
    batch = spark.createDataFrame([("a", "x", "brand_claim"), ("a", "y", "brand_claim")], ROWS)
    for rows, n in ((batch.limit(1), 0), (batch, 0), (batch, 0), (batch, 1)):
        intake.import_batch(rows, n, path, cat.schema, KEY)
    assert rows_of(intake.batches(spark, path, cat.schema)) == ["Row(source='a', excerpt='x', source_type='brand_claim', batch=0)", "Row(source='a', excerpt='y', source_type='brand_claim', batch=0)"]


def test_evidence_files_again(spark, tmp_path):
    text = ['{"tool": "aigc", "source_asset_id": "1", "evidence": [{"score": 0.5}]}', "{broken", '{"tool": "ela", "source_asset_id": "1", "evidence": [{"score": 0.25}]}', '{"tool": "ela", "source_asset_id": "2", "evidence": []}']
    incoming, path, checkpoint = (str(tmp_path / x) for x in ("in", "store", "check"))
    spark.createDataFrame([(t,) for t in text], "value string").write.text(incoming)
    want = rows_of(io.read_evidence(spark, incoming, ["aigc", "ela"]))
    none = spark.createDataFrame([], io.EVIDENCE)
    for _ in range(2):
        spark.createDataFrame([(t,) for t in text], "value string").write.mode("append").text(incoming)
        intake.import_stream(spark.readStream.schema(io.EVIDENCE).json(incoming), none, path, checkpoint, none.columns, None).awaitTermination()
    kept = intake.batches(spark, path, none.schema)
    assert rows_of(io.evidence_table(kept, ["aigc", "ela"])) == want and kept.filter("tool is not null").count() == 3


SAID = "asset long, decision string, reviewer string, s long"


def decisions(spark, rows):
    return spark.createDataFrame(rows, SAID).select("asset", "decision", "reviewer", F.timestamp_seconds("s").alias("ts"))


def run(spark, tmp_path, parts, late):
    incoming, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in parts:
        df = decisions(spark, part)
        df.coalesce(1).write.mode("append").parquet(incoming)
        intake.decision_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(incoming), path, checkpoint, late).awaitTermination()
    return intake.batches(spark, path, decisions(spark, []).schema), intake.latest(spark, path, decisions(spark, []).schema)


def test_latest_equals_batch(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice([1, 2, 3, 4, None]), draw.choice(["ok", "no", None]), draw.choice(["u", "v", None]), draw.randrange(1000, 1060)) for _ in range(80)]
    _, got = run(spark, tmp_path, [rows[:30], rows[20:60], rows[:30], rows[50:]], "1 hour")
    assert rows_of(got) == rows_of(dc.latest_decisions(decisions(spark, rows)))


def test_latest_forgets_and_drops_late_rows(spark, tmp_path):
    """Rows within the delay count in any order; beyond it they are dropped, and a row that is no news gives none."""
    parts = [[(1, "ok", "u", 1000)], [(2, "ok", "u", 5000)], [(2, "no", "u", 4980)], [(1, "late", "u", 900)], [(1, "no", "v", 6000)], [(3, "ok", "w", 5990)]]
    every, got = run(spark, tmp_path, parts, "60 seconds")
    assert sorted((r.asset, r.decision) for r in got.collect()) == [(1, "no"), (2, "ok"), (3, "ok")]
    assert sorted((r.asset, r.decision) for r in every.collect()) == [(1, "no"), (1, "ok"), (2, "ok"), (3, "ok")]


def test_verdict_stream_equals_batch(spark, tmp_path):
    from auditloom.plans import decide as plans

    batch = plans._evidence(spark, "/root/testdata/sf0.001")
    batch.write.parquet(path := str(tmp_path / "evidence"))
    query = audit.verdict_stream(spark.readStream.schema(batch.schema).parquet(path)).writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got, want = spark.table("verdicts"), audit.verdict_stream(batch)
    assert rows_of(got) == rows_of(want) and got.count() == batch.count() > 0
