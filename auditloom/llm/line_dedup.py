"""Line dedup on hashed lines, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
min_chars code points in at least min_docs documents lose all their lines, except in the largest
doc_id that holds the key. Keys travel as 128-bit hashes. The count by key is folded before each
shuffle and once more by a salt of the document, so that a line that a third of the documents share
is a few rows; these are range-partitioned by hash and sorted by hash and document, and the first
row of each hash names the document that keeps the line. What comes back for a document is a
compressed keep bitmap: words of 62 bits with the dropped lines' bits, words without a drop left out.

Edge cases: null and empty texts are one empty line. Every row counts as a document; rows that
repeat the largest doc_id of a line all keep it. A null doc_id is smaller than all others. Extra columns are kept by deduped_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 16
#: Bits in a word of the bitmap.
BITS = 62


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc")


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, row, pos, h1, h2 for every line whose key is long enough."""
    cells = docs.select(_doc(), F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = cells.filter(F.length("line") >= min_chars).withColumn("key", _key(F.col("line"))).filter(F.length("key") >= min_chars)
    return keys.select("doc", "row", "pos", _hash(F.col("key")).alias("h")).select("doc", "row", "pos", "h.*")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, keep (largest document) for hashes in at least min_docs documents."""
    keys = F.transform(F.filter(lines_of(F.col("text")), lambda x: F.length(x) >= min_chars), _key)
    own = F.array_distinct(F.transform(F.filter(keys, lambda x: F.length(x) >= min_chars), _hash))
    once = docs.select(_doc(), F.explode(own).alias("h")).select("doc", "h.*")
    heads = once.groupBy("h1", "h2", F.pmod("doc", F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n"), F.max("doc").alias("top"))
    # heads of a hash lie together in order of document: at most SALTS rows, of which the first names the keeper
    heads = heads.repartitionByRange("h1").sortWithinPartitions("h1", "h2", F.desc("top"))
    same = Window.partitionBy("h1", "h2").orderBy(F.desc("top"))
    total = F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    stream = heads.select("h1", "h2", F.col("top").alias("keep"), F.row_number().over(same).alias("nth"), total.alias("docs"))
    return stream.filter((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select("h1", "h2", "keep")


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row, words: the dropped lines of each document that has any, as a map from word number to bits."""
    gone = line_hashes(docs, min_chars).join(repeated_lines(docs, min_chars, min_docs), ["h1", "h2"]).filter("doc <> keep")
    bit = F.expr(f"shiftleft(1L, pos % {BITS})")
    bits = gone.groupBy("doc", "row", F.floor(F.col("pos") / BITS).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return bits.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _kept(docs: DataFrame, carry: list[str], min_chars: int, min_docs: int) -> DataFrame:
    """carry, lines (all), kept (those that stay) for every row."""
    maps = drop_bitmaps(docs, min_chars, min_docs)
    rows = docs.select(F.struct(*carry).alias("row_"), F.col("text").alias("text_"), _doc(), F.xxhash64("text").alias("row"))
    joined = rows.join(maps.hint("shuffle_hash"), ["doc", "row"], "left").withColumn("lines", lines_of(F.col("text_")))
    keep = F.expr(f"filter(lines, (x, i) -> coalesce(try_element_at(words, cast(i div {BITS} as int)), 0L) & shiftleft(1L, cast(i % {BITS} as int)) = 0)")
    return joined.select("row_", "lines", F.when(F.col("words").isNull(), F.col("lines")).otherwise(keep).alias("kept"), F.col("words"), F.col("text_"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and drop_words (the bitmap; null if nothing is dropped) for every row."""
    out = _kept(docs, ["doc_id"], min_chars, min_docs)
    text = F.when(F.col("words").isNull(), F.coalesce("text_", F.lit(""))).otherwise(F.concat_ws("\n", "kept"))
    n = F.size("lines").cast("long")
    return out.select(F.col("row_.doc_id").cast("long").alias("doc_id"), n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"), F.map_entries("words").alias("drop_words"))


def deduped_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines that stay; n_chars, if there, follows the text. Rows without a drop are unchanged."""
    out = _kept(docs, docs.columns, min_chars, min_docs).withColumn("new", F.when(F.col("words").isNull(), F.col("text_")).otherwise(F.concat_ws("\n", "kept")))
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("words").isNull(), F.col("row_.n_chars")).otherwise(F.length("new").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*((changed[x] if x in changed else F.col(f"row_.`{x}`")).alias(x) for x in docs.columns))
