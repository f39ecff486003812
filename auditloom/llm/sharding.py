"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups of equal texts are the things packed. Those with more than 1/64 of a shard in any measure are
units of their own, at most a few thousand however large the table; all others share 4,096 units by
hash of the text. Units go, largest first, to the shard that still has the bytes for them and whose
residual capacity has the highest dot product with the unit. A group of more than half a shard's
bytes is cut into parts by doc_id first, since no shard could take it evenly.

The law that holds is `bytes`: the shards' sizes are near equal. Edge cases: null text is empty, has
size 1 and the empty text's crc; equal rows are rows of their own; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, root_buckets, running, written

UNITS, HEAVY = 4096, 64
MEASURES = ("bytes", "tokens", "rows")


def place(units: np.ndarray, shards: int) -> list[int]:
    """The shard of each row of units (bytes, tokens, rows)."""
    total = units.sum(axis=0).astype(float)
    need = units / np.where(total > 0, total, 1) * shards  # in shares of a shard
    left = np.ones((shards, units.shape[1]))
    out = [0] * len(units)
    for i in np.lexsort((np.arange(len(units)), -need[:, 0], -need.max(axis=1).round(6))):
        fits = left[:, 0] >= need[i, 0]
        score = left @ need[i]
        shard = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        left[shard] -= need[i]
        out[i] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), n_words(text).alias("tokens"), F.xxhash64(text).alias("g")), "shard-rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = groups.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES)).first()
    # sums bound the number of heavy groups: 64 a shard and measure at most
    over = [F.col(m) * shards * HEAVY > total[m] for m in MEASURES]
    heavy = groups.filter(over[0] | over[1] | over[2]).select("g", F.greatest(F.lit(1), F.ceil(F.col("bytes") * shards * 2 / max(1, total["bytes"]))).cast("int").alias("parts")).collect()
    names = spark.createDataFrame([(r["g"], i, r["parts"] if r["parts"] > 1 else 1) for i, r in enumerate(sorted(heavy, key=lambda r: r["g"]))], "g long, nth int, parts int")
    rows = rows.join(F.broadcast(names), "g", "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts") * 8)).otherwise(0)
    rows = rows.withColumn("unit", F.when(F.col("nth").isNull(), F.pmod("g", F.lit(UNITS))).otherwise(UNITS + F.col("nth").cast("long") * 4096 + part))
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("unit").collect()
    to = place(np.array([[u[m] for m in MEASURES] for u in units], dtype=float).reshape(-1, 3), shards)
    where = spark.createDataFrame([(u["unit"], s) for u, s in zip(units, to, strict=True)], "unit long, shard int")
    rows = rows.join(F.broadcast(where), "unit").withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(root_buckets(int(total["rows"])))))
    placed = running(rows, ["shard"], "_b", [F.col("doc_id"), F.col("g")], F.lit(1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("start").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
