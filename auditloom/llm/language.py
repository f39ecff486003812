"""Language ID by language-bitmask n-gram filters.

For each language, its most frequent character n-grams (by share of its sample's n-grams) go into
one bit-sliced Bloom filter: a table whose cells are masks of languages, so that the AND over an
n-gram's cells returns all languages that contain it. A text's n-grams are counted by language
(popcounts of the masks' bits), each count is corrected for the filter's false-positive rate, and
the largest corrected share decides.

Training may take a bounded sample: per_language documents of each language, those of the smallest
hash of doc_id; a doc_id with several texts gives one of them. Edge cases: null text and texts without a letter are `und` with score 0; a text
too short for one n-gram counts its padded form; ties go to the first language in order. A table
without labelled rows predicts `und` everywhere. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, python_ready

#: n-gram lengths in characters, kept n-grams of a language and length, documents of a language in the sample.
LENGTHS, KEPT, PER_LANGUAGE = (2, 3, 4), 3000, 1000
CELLS, PROBES = 1 << 17, 3
#: Characters that are looked at in one step; a long text takes several.
STEP = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: is it a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_parts(text: str, lengths: tuple[int, ...] = LENGTHS) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a lower-cased text, blanks around it, every run of non-letters one blank; a part for each STEP characters."""
    most = max(lengths)
    codes = np.array([32], np.uint64)
    for i in range(0, len(text), STEP):
        old = codes[1 - most :] if i else codes  # n-grams that reach into this part begin there
        part = text[i : i + STEP].lower() + (" " if i + STEP >= len(text) else "")
        new = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([old, np.where(_letters()[new], new, np.uint32(32)).astype(np.uint64)])
        blank = codes == 32
        codes = codes[~(blank & np.r_[False, blank[:-1]])]
        out, h = [], np.zeros(len(codes), np.uint64)
        for n in range(1, most + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * _M1 + codes[n - 1 :] + np.uint64(1)
            if n in lengths:
                out.append(_mix(h[max(0, len(old) - n + 1) :] + np.uint64(n)))
        yield np.concatenate(out) if out else np.zeros(0, np.uint64)


def _cells(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(CELLS)).astype(np.int64) for i in range(PROBES)]


@dataclass
class LanguageFilter:
    """languages: names in order; masks: words of 64 languages x CELLS."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, int]]) -> LanguageFilter:
        """rows: (language, n-gram hash as signed 64 bits)."""
        names = sorted({r[0] for r in rows})
        masks = np.zeros((max(1, -(-len(names) // 64)), CELLS), np.uint64)
        rates = np.zeros(len(names))
        for i, name in enumerate(names):
            h = np.array([r[1] for r in rows if r[0] == name], np.int64).view(np.uint64)
            for c in _cells(h):
                masks[i // 64, c] |= np.uint64(1 << (i % 64))
            rates[i] = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES
        return LanguageFilter(names, masks, rates)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter contains."""
        out = np.zeros(len(self.languages))
        cells = _cells(h)
        for w, table in enumerate(self.masks):
            found = table[cells[0]]
            for c in cells[1:]:
                found = found & table[c]
            for i in range(64 * w, min(64 * w + 64, len(out))):
                out[i] = np.count_nonzero(found & np.uint64(1 << (i % 64)))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        total, n = np.zeros(len(self.languages)), 0
        for h in gram_parts(text):
            total += self.counts(h)
            n += len(h)
        true = np.clip((total - n * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(np.argmax(true))
        return self.languages[best], float(min(1.0, true[best] / max(1, n)))


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text of per_language documents at most of each language: those with the smallest hashes.

    The number of a language's rows gives a bound under which about four times as many hashes lie, so a
    task ranks a few thousand rows however many there are.
    """
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return rows.select("lang", "text")
    bounds = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, 1 + (per_language << 32) // n))))
    ids = rows.select("lang", F.col("doc_id").alias("_id"), F.xxhash64("doc_id", F.lit(1)).alias("h"))
    few = ids.filter(F.pmod("h", F.lit(1 << 30)) < bounds[F.col("lang")]).distinct()
    near = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "_id")
    few = few.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= per_language).select("_id", F.col("lang").alias("_lang"))
    few = F.broadcast(few) if per_language * len(counts) <= BROADCAST_ROWS else few
    chosen = rows.join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    return chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, kept: int = KEPT) -> LanguageFilter:
    """Fits the filter on labelled rows (doc_id, text, lang); brings kept n-grams of each length and language to the driver."""
    python_ready(docs.sparkSession)
    texts = _sample(docs, per_language)

    def count(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in LENGTHS:
                    for part in gram_parts(text, (n,)):
                        h, c = np.unique(part, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array([n] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["lang", "n", "gram", "c"])

    tallied = texts.mapInArrow(count, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    top = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram")
    rows = tallied.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= kept).select("lang", "gram").collect()
    return LanguageFilter.of([(r["lang"], r["gram"]) for r in rows])


def predict(docs: DataFrame, model: LanguageFilter, carry: list[str]) -> DataFrame:
    """carry (columns of docs), lang_pred, score for every row of docs; only the text is read for the prediction."""
    spark = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(model)  # CELLS x 8 bytes for every 64 languages
    shape = docs.select(*carry).schema
    names = [f.name for f in shape]

    def rows(batches):
        for b in batches:
            got = [sent.value.predict(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(rows, f"{fields}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang), learned from its rows that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(rows.filter(~F.coalesce(held_out(), F.lit(False))))
    return predict(rows.withColumn("held_out", F.coalesce(held_out(), F.lit(False))), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def accepted_documents(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """docs without those that have no language, or whose share of known n-grams is under least."""
    model = train(docs.select("doc_id", "text", "lang").filter(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model, docs.columns).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)
