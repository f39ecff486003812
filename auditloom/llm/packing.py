"""Best-fit packing of token pieces into sequences, with vector capacities.

Every document becomes its ids and an end id; only documents over the sequence length are cut. A
piece needs tokens, a document slot and attention cost (its length squared), all given by its
length. So the bins are chosen over the histogram of lengths, which has at most as many rows as a
sequence has tokens: lengths from long to short, each into the open kind of bin whose residual
vector fits it under every constraint and leaves the smallest weighted residual norm. A kind of bin
is many equal bins; pieces find their place by their rank within their length, in a join.

Edge cases: null text is empty and gives one piece, the end id alone. Repeated rows give pieces of
their own. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, root_buckets, running, python_ready, written

MAX_TOKENS, END_ID = 2048, 0
#: Words whose ids a task keeps; it starts anew beyond that.
WORDS_KEPT = 250_000
#: Ranks in a cell of the join of pieces and places; places that are broadcast at most, else both sides are shuffled.
CELL, BROADCAST_ROWS = 1 << 16, 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BEFORE_MARKS = re.compile(r"(?<=[^\W\d_])(?=[.,;:!?])")
#: How a tokenizer's file says that it lower-cases NFC text, drops white space, and cuts runs without it into words, digits and marks.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@lru_cache(1)
def tokenizer_of(path: str):
    """The tokenizer, and does it treat words one by one, so that WordIds may take texts apart; one for each Python worker."""
    from tokenizers import Tokenizer

    spec = json.loads(Path(path).read_text())
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    by_words = [x["type"] for x in steps] == _NORMAL and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and steps[1]["pattern"] == {"Regex": "\\s+"} and cuts[0]["pattern"] == {"Regex": _SPLIT} and spec["model"].get("end_of_word_suffix") == "</w>"
    return Tokenizer.from_file(path), by_words


class WordIds(dict):
    """From a word to its ids, as little-endian 32-bit bytes.

    The tokenizer treats runs of characters without blank or line end one by one, and most of a
    corpus is words met before; a word before end marks, or with capitals, has the plain word's ids.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.by_words = tokenizer_of(path)
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, run: str) -> bytes:
        if run.isalpha() and self.is_plain(run):
            ids = [t.id for t in self.tokenizer.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            out = self.whole(run)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[run] = out
        return out

    @staticmethod
    def is_plain(text: str) -> bool:
        """Does the tokenizer's normaliser leave the text as it is."""
        return text == text.lower() and (text.isascii() or "ς" not in text and unicodedata.is_normalized("NFC", text))

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        low = text.lower()
        if not self.by_words or any(s in text or s in low for s in self.specials):
            return self.whole(text)
        if "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
            # fewer kinds of runs: no capitals, and end marks apart from words, where the tokenizer cuts too
            text = BEFORE_MARKS.sub(" ", low)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    python_ready(docs.sparkSession)

    def cut(batches):
        words = WordIds(tokenizer_path)  # the task's, so that a worker keeps no words for later tasks
        end, step = struct.pack("<I", END_ID), 4 * max_tokens
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = words.ids(text or "") + end
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    out.append((doc_id, i // step, i // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, _PIECES)


def best_fit(counts: dict[int, int], capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.2)) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of bins: (how many, [(length, rank of its first piece)...]) for counts of pieces by length.

    In the kind's k-th bin, an entry stands for the piece of that length with rank + k. capacity is
    tokens, pieces and attention cost of a bin; a bin's residual norm is over shares of these.
    """
    cap, w = np.array(capacity, float), np.array(weights)
    left = np.zeros((64, 3))
    many = np.zeros(64, np.int64)
    made: list[list[tuple[int, int]]] = []

    def add(residual: np.ndarray, n: int, entries: list) -> None:
        nonlocal left, many
        if len(made) == len(left):
            left, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([many, np.zeros_like(many)])
        left[len(made)], many[len(made)] = residual, n
        made.append(entries)

    for length in sorted(counts, reverse=True):
        need, rank, todo = np.array([length, 1, length * length], float), 0, counts[length]
        while todo:
            k = len(made)
            fits = (left[:k] >= need).all(axis=1) & (many[:k] > 0)
            if fits.any():
                norm = ((left[:k] - need) ** 2 / cap**2 * w).sum(axis=1)
                kind = int(np.argmin(np.where(fits, norm, np.inf)))
                n = int(min(todo, many[kind]))
                if n < many[kind]:  # the other bins stay as they are, with later pieces
                    add(left[kind].copy(), int(many[kind]) - n, [(x, r + n) for x, r in made[kind]])
                    many[kind] = n
                made[kind] = [*made[kind], (length, rank)]
                left[kind] -= need
            else:
                each = max(1, min(todo, int((cap // need).min())))
                n = todo // each
                add(cap - each * need, n, [(length, rank + i * n) for i in range(each)])
                n *= each
            rank, todo = rank + n, todo - n
    return [(int(many[i]), made[i]) for i in range(len(made))]


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: float | None = None) -> DataFrame:
    """Every piece with its sequence_id and its offset, the tokens before it in the sequence."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, max_tokens), "pieces").withColumnRenamed("start", "begin")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # max_tokens rows at most
    n = sum(counts.values())
    step, cells, base = max(CELL, n >> 12), [], 0
    for many, entries in best_fit(counts, (max_tokens, max_docs or max_tokens, max_cost or max_tokens**2)):
        at = 0
        for length, low in entries:
            cells += [(length, cell, low, low + many, base, at) for cell in range(low // step, (low + many - 1) // step + 1)]
            at += length
        base += many
    where = spark.createDataFrame(cells, "length long, cell long, low long, high long, base long, at long")
    where = F.broadcast(where) if len(cells) <= BROADCAST_ROWS else merged(where)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(root_buckets(n)))
    ranked = running(cut.withColumn("_b", bucket), ["length"], "_b", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.lit(1))
    placed = ranked.withColumn("cell", F.floor(F.col("start") / step)).join(where, ["length", "cell"]).filter("start >= low and start < high")
    return placed.select("doc_id", "piece", F.col("begin").alias("start"), "length", "ids_crc32", (F.col("base") + F.col("start") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))
