"""Text column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx

#: Punctuation, symbols and white space, which comments are compared without.
NOISE = r"[\p{P}\p{S}\p{Z}\s\x{85}\x{1c}-\x{1f}]"


def normalized(text: Column) -> Column:
    """The text without white space, punctuation and symbols."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside a lambda a plain expression is evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def gram_set(norm: Column, n: int = lx.GRAM) -> Column:
    """Distinct character n-grams; a shorter text is its own single gram."""
    def grams(chars: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))
        return F.when(F.size(chars) < n, F.array(F.array_join(chars, ""))).otherwise(F.array_distinct(cells))

    return let(F.split(norm, ""), grams)


def _hash_set(text: str | None, n: int) -> np.ndarray:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = min(n, len(codes))
    h = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - width + 1 + i]
    return np.unique((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def gram_hashes(norm: Column, n: int = lx.GRAM) -> Column:
    """gram_set as 64-bit hashes in an order of their own, made for a batch of texts at a time; they are compared and shuffled faster than strings."""
    def hashed(texts: pa.Array) -> pa.Array:
        sets = [_hash_set(t, n) for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))

    return F.arrow_udf(hashed, "array<bigint>")(norm)


#: Texts whose grams are counted at once.
COUNTED = 1024


def gram_counts(rows: DataFrame, key: str, norm: Column, n: int = lx.GRAM) -> DataFrame:
    """key, gram, c: in how many texts of a key a gram's hash occurs; batches count their own before anything is shuffled."""
    kind = rows.select(key).schema[0]

    def count(batches):
        for b in (whole.slice(at, COUNTED) for whole in batches for at in range(0, whole.num_rows, COUNTED)):
            sets = [_hash_set(t, n) for t in b.column(1).to_pylist()]
            codes = b.column(0).dictionary_encode()
            nth = np.repeat(codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False), [len(s) for s in sets])
            for k in np.unique(nth):
                grams, c = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)])[nth == k], return_counts=True)
                value = None if k == len(codes.dictionary) else codes.dictionary[int(k)].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(grams), codes.dictionary.type), pa.array(grams), pa.array(c, pa.int64())], [key, "gram", "c"])

    found = rows.select(key, norm.alias("_norm")).mapInArrow(count, f"`{key}` {kind.dataType.simpleString()}, gram bigint, c bigint")
    return found.groupBy(key, "gram").agg(F.sum("c").alias("c"))


def has_detail(text: Column, patterns: list[str] | None = None) -> Column:
    """Does the text have a personal detail of any kind."""
    out = F.lit(False)
    for p in patterns or lx.DETAIL:
        out = out | F.coalesce(text.rlike(p), F.lit(False))
    return out


def word_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur, each once."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def occurrences(text: Column, word: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def sentence_sizes(text: Column) -> Column:
    """T5: n, mean and cv (coefficient of variation) of the lengths of sentences that aren't blank."""
    sentences = F.filter(F.split(text, r"[。！？!?；;\n]"), lambda s: s.rlike(r"[^\s\p{Z}]"))
    sizes = F.transform(sentences, lambda s: F.length(s).cast("double"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def measured(sums: Column) -> Column:
        n = sums["n"]
        mean = F.when(n > 0, sums["s"] / n).otherwise(0.0)
        variance = F.greatest(F.lit(0.0), sums["q"] / n - mean * mean)
        return F.struct(n.alias("n"), mean.alias("mean"), F.when((n >= 2) & (mean > 0), F.sqrt(variance) / mean).otherwise(0.0).alias("cv"))

    return let(F.aggregate(sizes, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))), measured)


def style(text: Column, markers: list[str] | None = None, templates: list[str] | None = None, sizes: Column | None = None) -> dict[str, Column]:
    """T5: writing-style features by name. sizes: a column of sentence_sizes(), so that a text is split once."""
    of = sentence_sizes(text) if sizes is None else sizes
    per100 = [sum((occurrences(text, w) for w in words), F.lit(0)) * 100.0 / F.greatest(F.length(text), F.lit(1)) for words in (markers or lx.AI_MARKERS, templates or lx.TEMPLATE_MARKERS)]
    return {
        "char_count": F.length(text), "sentence_count": of["n"], "avg_sentence_len": of["mean"], "sentence_len_cv": of["cv"],
        "ai_marker_per_100": per100[0], "template_marker_per_100": per100[1],
        "has_number": text.rlike(lx.STYLE_NUMBER), "has_time_detail": text.rlike(lx.STYLE_TIME_CHARS) & text.rlike(lx.STYLE_TIME_SOME), "has_shade_detail": text.rlike(lx.STYLE_SHADE_SOME),
    }


def dimension_numbers(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Numbers with a dimension, as a map of lists without empty ones."""
    cells = [x for k, p in (patterns or lx.DIMENSIONS).items() for x in (F.lit(k), F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: v.cast("double")))]
    return F.map_filter(F.create_map(*cells), lambda _, v: F.size(v) > 0)


def special_words(text: Column, pattern: str = lx.SPECIAL_WORDS) -> Column:
    """Regulated effect words, each once, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def license_ok(name: Column) -> Column:
    """Public domain, CC0, or attribution without share-alike and non-commercial."""
    flat = F.replace(F.lower(name), F.lit("-"), F.lit(" "))
    free = F.contains(flat, F.lit("cc0")) | F.contains(flat, F.lit("public domain"))
    by = F.contains(flat, F.lit("cc by")) & ~F.contains(flat, F.lit("sa")) & ~F.contains(flat, F.lit("nc"))
    return free | by


def source_claims(text: Column, patterns: dict[str, str] | None = None) -> dict[str, Column]:
    """For each kind of stated source the first match and its place from 0, or null."""
    out = {}
    for kind, p in (patterns or lx.SOURCE_CLAIMS).items():
        place = F.regexp_instr(text, F.lit(p))
        out[kind] = F.when(place > 0, F.struct(F.regexp_extract(text, p, 0).alias("matched"), (place - 1).alias("position")))
    return out


def brands(text: Column) -> Column:
    """Latin brand names, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(lx.BRAND), F.lit(1))))


def categories(text: Column, words: list[str] | None = None) -> Column:
    """Product-category words that occur, in the list's order."""
    return F.filter(F.array(*map(F.lit, words or lx.CATEGORIES)), lambda w: F.contains(text, w))
