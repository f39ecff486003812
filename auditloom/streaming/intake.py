"""Continuous intake: catalogue rows by key without repeats, and the latest decision of each asset, from streams.

Each micro-batch has a folder of its own beneath a path, which a replay of the batch overwrites; so
a batch that ran halfway or twice leaves what one run leaves. A path and a checkpoint belong together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.shipping import ship
from ..operators.curate import new_rows
from ..operators.decide import latest_decisions


def batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches beneath a path, with batch, the number of theirs."""
    return spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path)


def import_batch(rows: DataFrame, batch: int, path: str, schema: StructType, key: list[str], kind: str | None = "brand_claim") -> None:
    """J10 for one batch: its rows of the kind, whose key no earlier batch has, become the batch's folder. Its own earlier run is not asked, so a replay writes the same keys."""
    earlier = batches(rows.sparkSession, path, schema).filter(F.col("batch") < batch)
    new_rows(rows, earlier, key, kind).select(*schema.names).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def import_stream(rows: DataFrame, catalog: DataFrame, path: str, checkpoint: str, key: list[str], kind: str | None = "brand_claim") -> StreamingQuery:
    """J10 continuously: rows of a stream join the catalogue at path once a key, whatever is delivered again or in another order; what the stream holds now is taken, then it stops.

    catalog is what a new path begins with (batch -1); a path that has begun goes on. kind None takes
    rows of any kind (S4: evidence files by all their columns). Of rows with one key that differ
    otherwise, one of the first batch that has the key stays.
    """
    schema = StructType([f for f in catalog.schema.fields])
    catalog.write.mode("ignore").parquet(f"{path}/batch=-1")
    sink = rows.writeStream.foreachBatch(lambda df, n: import_batch(df, n, path, schema, key, kind))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row if one of the parts is newer than the state, which is forgotten when no row older than it can come any more."""
    if state.hasTimedOut:
        state.remove()
        return
    rank = lambda r: (r[0], r[1] is not None, r[1] or "", r[2] is not None, r[2] or "")
    known = tuple(state.get) if state.exists else None
    best = known
    for part in parts:
        us, decision, reviewer = part.sort_values(["us", "decision", "reviewer"], na_position="first")[["us", "decision", "reviewer"]].iloc[-1]
        last = (int(us), None if pd.isna(decision) else decision, None if pd.isna(reviewer) else reviewer)
        best = last if best is None or rank(last) > rank(best) else best
    state.update(best)
    state.setTimeoutTimestamp(best[0] // 1000 + 1)
    if best != known:
        yield pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in zip(("asset", "us", "decision", "reviewer"), (key[0], *best), strict=True)})


def newer_decisions(decisions: DataFrame, late: str = "1 day") -> DataFrame:
    """W2 on a stream: a row (asset, decision, reviewer, ts) whenever an asset has a decision after all it had before, in W2's order of ts, decision, reviewer.

    decisions: asset, decision, reviewer, ts (a timestamp; rows without one are left out). The state
    is the latest decision of an asset, kept until the watermark passes it: a later row must then be
    newer. Rows that are later than the watermark allows are dropped by Spark, so late is the longest
    delay of a delivery; so are stamps up to the start of 1970, where watermarks begin.
    """
    ship(decisions.sparkSession)
    kind = decisions.schema["asset"].dataType.simpleString()
    rows = decisions.filter("ts is not null").withWatermark("ts", late).select("asset", "decision", "reviewer", "ts", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("asset").applyInPandasWithState(_newest, f"asset {kind}, us long, decision string, reviewer string", "us long, decision string, reviewer string", "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("asset", "decision", "reviewer", F.timestamp_micros("us").alias("ts"))


def decision_stream(decisions: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """newer_decisions as batches beneath a path, which latest reads; what the stream holds now is taken, then it stops."""
    sink = newer_decisions(decisions, late).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """W2 of what decision_stream has written."""
    return latest_decisions(batches(spark, path, schema))
