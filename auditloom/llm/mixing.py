"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Targets: sources in code-point order, null last, weigh 5, 2, 1 and again; the mix is as large as
the input, a source gives at most three times its size, and what it can't give goes to the others
by weight. A source is cut into n blocks of equal tokens (within a word), of a size of its own, so
that small sources have many too. Schedule: slot j is the point frac(j / golden ratio), which falls
into one source's part of the cumulative targets, counted in blocks; a source's slots are ranked,
and slot r takes block r mod n of the source's words in shuffled document order. A source has as
many points as its target has blocks, but for a few: slots beyond the target are left out, and where
some are missing, the source has slots of its own after the last point, in turn with other such
sources; its last one takes the part of a block that the target has room for. What a document gives
is what slots take of it, and its place in the mix is that of its slots: at any point of the mix,
every source has had about its share. In the mix as documents, a document comes whole, at the slot
that takes its first word; only a source's very last one may be cut.

Edge cases: null or empty texts have size 0 and are never taken; a source without words has target
0; an empty table gives no row. Repeated rows count as rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WS_CLASS, Scratch, looked_up, n_words, root_buckets, running

GOLDEN = 0.6180339887498949
#: Slots that a source of mean size has at least, unless a block would be under one word; blocks of at most so many words.
SLOTS, BLOCK = 2000, 4096
#: Blocks that any source has at least, unless they would be under one word.
LEAST_BLOCKS = 200
#: Cells of the unit interval for the join of points and sources.
CELLS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """grp, source_size, target for sizes (grp, size). One row a source, so windows over all sources stay small."""
    src = sizes.groupBy("grp").agg(F.sum("size").cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy("grp")) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("double")
    src = src.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    # Sources fill up in the order of cap / weight; those after the first that stays below its cap share the rest by weight.
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "grp").rowsBetween(Window.unboundedPreceding, -1)
    capped, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    src = src.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("w").over(every) - gone))
    share = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), True).over(Window.orderBy("ratio", "grp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    src = src.withColumn("share", share)
    return src.select("grp", "source_size", F.least(F.col("cap"), F.col("share") * F.col("w")).alias("target"))


def with_blocks(targets: DataFrame, block: int) -> DataFrame:
    """targets with blocks (how many a source has, each of block words at most), goal (the target in whole words) and the source's number."""
    own = F.least(F.lit(block), F.ceil(F.col("source_size") / LEAST_BLOCKS))
    nth = F.row_number().over(Window.orderBy("grp"))
    return targets.withColumns({"blocks": F.ceil(F.col("source_size") / F.greatest(own, F.lit(1))), "goal": F.round("target").cast("long"), "nth_source": nth})


def edge(k: Column, size: Column, blocks: Column) -> Column:
    """First word of block k: the size mod blocks first blocks have one word more than the others."""
    return k * F.floor(size / blocks) + F.least(k, size % blocks)


def block_at(at: Column, size: Column, blocks: Column) -> Column:
    """The block that has the word at."""
    each, longer = F.floor(size / blocks), size % blocks
    return F.when(at < longer * (each + 1), F.floor(at / (each + 1))).otherwise(longer + F.floor((at - longer * (each + 1)) / each))


def schedule(targets: DataFrame, slots: int, golden: float = GOLDEN) -> DataFrame:
    """slot, grp, rank in the source, block, epoch, length (words taken from the block's start) and whole: the block that each slot of the mix takes."""
    spark = targets.sparkSession
    size, n = F.col("source_size"), F.col("blocks")
    parts = targets.filter("target > 0").withColumn("part", F.col("target") / size * n)
    w = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("part").over(Window.partitionBy())
    high = F.sum("part").over(w) / total
    parts = parts.select("grp", (high - F.col("part") / total).alias("low"), F.when(high > 1 - 1e-9, 2.0).otherwise(high).alias("high"))
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.col("low"), F.lit(0.0)) * CELLS), F.floor(F.least(F.col("high"), F.lit(1.0)) * CELLS))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * golden % 1.0).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(parts, "cell").filter("u >= low and u < high").select("slot", "grp")
    ranked = running(hit.withColumn("bucket", F.floor(F.col("slot") / root_buckets(slots))), ["grp"], "bucket", [F.col("slot")], F.lit(1)).select("slot", "grp", F.col("start").alias("rank"))
    # slots of their own for what is missing, in turn
    goals = targets.filter("goal > 0").select("grp", "source_size", "blocks", "goal", "nth_source")
    last = F.floor((F.col("goal") - 1) / size) * n + block_at((F.col("goal") - 1) % size, size, n)
    had = goals.join(hit.groupBy("grp").agg(F.count("*").alias("had")), "grp", "left").withColumns({"had": F.coalesce("had", F.lit(0)), "last": last})
    more = had.filter("had <= last").select("grp", "had", "nth_source", F.explode(F.sequence("had", "last")).alias("rank"))
    most = had.agg(F.coalesce(F.max("nth_source"), F.lit(0)).alias("sources"))  # one row
    more = more.join(F.broadcast(most)).select((F.lit(slots) + (F.col("rank") - F.col("had")) * F.col("sources") + F.col("nth_source")).alias("slot"), "grp", "rank")
    every = ranked.unionByName(more).join(goals.drop("nth_source"), "grp").withColumns({"block": F.col("rank") % n, "epoch": F.floor(F.col("rank") / n)})
    first, end = edge(F.col("block"), size, n), edge(F.col("block") + 1, size, n)
    length = F.least(end, F.col("goal") - F.col("epoch") * size) - first
    return every.withColumns({"length": length, "whole": length == end - first}).filter("length > 0").select("slot", "grp", "rank", "block", "epoch", "length", "whole")


def planned(docs: DataFrame, work: Scratch, carry: bool = False, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 11, golden: float = GOLDEN) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with their place in the source's words (start, size) and its target, and the slots of the schedule; with carry also the row itself, as row."""
    grp = F.when(F.col("source").isNull(), "2").otherwise(F.concat(F.lit("1"), F.col("source"))).alias("grp")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), grp, n_words(F.col("text")).alias("size"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    sizes = work.write(rows.select("doc_id", "grp", "size"), "mix-sizes")
    rows = rows if carry else sizes
    targets = work.write(source_targets(sizes, weights, most), "mix-targets")
    sources, words, n = targets.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.lit(sizes.count())).first()
    targets = with_blocks(targets, max(1, min(BLOCK, words // (max(1, sources) * SLOTS))))
    (slots,) = targets.filter("target > 0").agg(F.coalesce(F.ceil(F.sum(F.col("target") / F.col("source_size") * F.col("blocks"))), F.lit(0))).first()
    turns = work.write(schedule(targets, slots, golden), "mix-slots")
    # Shuffled order of a source: by hash of doc_id; a second hash settles repeated ids.
    order = [F.col("_h"), F.col("doc_id"), F.col("size"), *([F.xxhash64("row.text")] if carry else [])]
    placed = rows.withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    placed = running(placed.withColumn("_b", F.pmod("_h", F.lit(root_buckets(n)))), ["grp"], "_b", order, F.col("size"))
    return placed.join(targets.drop("nth_source"), "grp"), turns


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null where nothing is taken) for every row of docs (doc_id, text, source)."""
    work = Scratch(docs.sparkSession)
    placed, turns = planned(docs, work, **options)
    takes = turns.groupBy("grp", "block").agg(F.count_if("whole").alias("takes"), F.coalesce(F.max(F.when(~F.col("whole"), F.col("length"))), F.lit(0)).alias("partial"), F.min("slot").alias("slot"))
    size, blocks, end = F.col("source_size"), F.col("blocks"), F.col("start") + F.col("size")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(block_at(F.col("start"), size, blocks), block_at(end - 1, size, blocks))))
    first = edge(F.col("block"), size, blocks)
    low, high = F.greatest(F.col("start") - first, F.lit(0)), F.least(end, edge(F.col("block") + 1, size, blocks)) - first
    parts = cut.select("grp", "_b", "nth", "block", low.alias("low"), high.alias("high")).join(takes, ["grp", "block"])
    rest = F.greatest(F.lit(0), F.least(F.col("high"), F.col("partial")) - F.col("low"))
    got = parts.groupBy("grp", "_b", "nth").agg(F.sum((F.col("high") - F.col("low")) * F.col("takes") + rest).alias("taken"), F.min(F.when((F.col("takes") > 0) | (rest > 0), F.col("slot"))).alias("first_slot"))
    out = placed.join(got, ["grp", "_b", "nth"], "left")
    out = work.write(out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"), "mix")
    work.clear(but=out)
    return out


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents in the order of its slots: one row for each time that slots take a document.

    A source's last one may have its first words only, with the white space between them. Columns
    are those of docs; n_chars, if there, follows the text. Rows are in order within and across
    partitions, so that files written from them are too.
    """
    placed, turns = planned(docs, Scratch(docs.sparkSession), carry=True, **options)
    size, blocks = F.col("source_size"), F.col("blocks")
    copies = placed.filter("size > 0 and goal > start").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("goal") - 1 - F.col("start")) / size))))
    copies = copies.withColumn("block", block_at(F.col("start"), size, blocks)).join(looked_up(turns.select("grp", "block", "epoch", "slot")), ["grp", "block", "epoch"])
    left = F.least(F.col("goal") - F.col("epoch") * size - F.col("start"), F.col("size")).cast("int")
    head = F.regexp_replace(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD}{WS_CLASS}*)"), F.lit(1)), 1, F.greatest(left, F.lit(1))), ""), f"{WS_CLASS}+$", "")
    out = copies.withColumn("new_text", F.when(left < F.col("size"), head).otherwise(F.col("row.text")))
    out = out.repartitionByRange(F.col("slot")).sortWithinPartitions("slot", "start")
    changed = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.select(*(changed.get(x, F.col(f"row.`{x}`")).alias(x) for x in docs.columns))
