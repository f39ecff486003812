"""Substring dedup by content-defined chunks of a gear rolling hash.

A gear hash rolls over the bytes of a text; its value before each word depends on the last 16 bytes
only. A chunk starts at a word whose value is the smallest among its REACH neighbours on either
side, so cuts follow the content and move with it when text is inserted before. Chunks are
deduplicated by digest over all documents: the occurrence in the smallest doc_id stays, so every
chunk stays somewhere. Adjoining chunks that also occur in other documents make a run; runs of at
least min_words words are what repeats. A run is told in spans whose chunks have the same keeper.
A digest has 96 bits and the number of words (chunks of a corpus of 10^13 chunks differ in it but
for odds of one in a thousand).

Edge cases: null and empty texts have no chunk. Repeats inside one document alone don't count.
Repeated rows of a doc_id are one document; a
doc_id with several texts has the runs of each. Null doc_id counts as the smallest number. Extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, python_ready

#: Neighbours on either side, words of a chunk (longer ones, as in runs of one word, are cut), words of a run.
REACH, LONGEST, MIN_WORDS = 3, 16, 20
#: seal: 32 further bits of the digest, then five for the number of words.
_CHUNKS = "doc_id long, mark long, nth int, start int, bytes int, digest long, seal long"


def gear_table() -> np.ndarray:
    """A fixed 32-bit value for each byte."""
    return np.random.default_rng(7).integers(1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


_GEAR = gear_table()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = 2 h + gear[byte] over the last 16 bytes, by doubling."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cuts(data: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words, and which of them start a chunk (the first word always does)."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(starts):
        return starts, np.zeros(0, bool)
    value = gear_hashes(data)[np.maximum(starts - 1, 0)] * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    cut = np.ones(len(starts), bool)
    for k in range(1, reach + 1):
        cut[k:] &= value[k:] < value[:-k]
        cut[:-k] &= value[:-k] <= value[k:]
    cut[0] = True
    nth = np.arange(len(starts))
    since = nth - np.maximum.accumulate(np.where(cut, nth, 0))
    return starts, since % LONGEST == 0


def chunks(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, mark (hash of the text), nth, start and bytes (in UTF-8), digest and seal of every chunk."""
    python_ready(docs.sparkSession)

    def rows(batches):
        for b in batches:
            parts = []
            for doc_id, mark, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                starts, cut = cuts(np.frombuffer(text or b"", np.uint8), reach)
                if not len(starts):
                    continue
                first = np.flatnonzero(cut)
                begin = starts[first]
                end = np.r_[begin[1:], len(text)]
                own = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[i:j].rstrip()) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]), ">i8").reshape(-1, 2)
                seal = (own[:, 1] & 0xFFFFFFFF) << 5 | np.diff(np.r_[first, len(starts)])
                parts.append((np.full(len(begin), doc_id), np.full(len(begin), mark), np.arange(len(begin)), begin, end - begin, own[:, 0], seal))
            if parts:
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(k)) for i, k in enumerate(kinds)], [x.split()[0] for x in _CHUNKS.split(", ")])

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id")
    return docs.select(doc, F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("raw")).mapInArrow(rows, _CHUNKS)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, reach: int = REACH) -> DataFrame:
    """doc_id, start, length (bytes of the UTF-8 text), n_words, n_chunks, keep_doc_id, dropped: every span of a run that repeats.

    keep_doc_id is the smallest document that has the span's chunks. dropped: that is another one,
    and the adjoining chunks that others keep have min_words words or more. Documents without a run
    have no row.
    """
    work = Scratch(docs.sparkSession)
    cells = work.write(chunks(docs, reach), "chunks")
    by = cells.groupBy("digest", "seal").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    found = cells.join(by.filter("low <> high").select("digest", "seal", "low"), ["digest", "seal"])
    # repeated rows have the same chunks
    once = found.groupBy("doc_id", "mark", "nth").agg(*(F.first(c).alias(c) for c in ("start", "bytes", "low")), F.first(F.col("seal").bitwiseAND(31)).alias("words"))
    gone = F.col("low") != F.col("doc_id")

    def stretch(*same: str) -> Column:
        """The same number for adjoining chunks that are alike in some columns."""
        return F.col("nth") - F.row_number().over(Window.partitionBy("doc_id", "mark", *same).orderBy("nth"))

    def words_of(*of: str) -> Column:
        return F.sum("words").over(Window.partitionBy("doc_id", "mark", *of))

    rows = once.withColumn("gone", gone).withColumns({"run": stretch(), "lost": stretch("gone"), "part": stretch("low")})
    rows = rows.withColumns({"run_words": words_of("run"), "lost_words": words_of("gone", "lost")}).filter(F.col("run_words") >= min_words)
    end = F.max(F.col("start") + F.col("bytes"))
    out = rows.groupBy("doc_id", "mark", "low", "part").agg(
        F.min("start").cast("long").alias("begin"), (end - F.min("start")).cast("long").alias("length"), F.sum("words").cast("long").alias("n_words"), F.count("*").alias("n_chunks"), F.max(F.col("gone") & (F.col("lost_words") >= min_words)).alias("dropped"))
    doc, keep = (F.when(F.col(c) != -(1 << 63), F.col(c)).alias(name) for c, name in (("doc_id", "doc_id"), ("low", "keep_doc_id")))
    out = work.write(out.select(doc, F.col("begin").alias("start"), "length", "n_words", "n_chunks", keep, "dropped"), "passages")
    work.clear(but=out)
    return out
