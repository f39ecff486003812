"""MinHash near-dedup: an inverted join of signature coordinates.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with the same set are
one class, with an id of its own. A class posts itself under its coordinate-value pairs ("tokens"):
two classes at the similarity wanted agree in at least MATCHES of COORDS coordinates but for one in
300,000, so they share a token among the COORDS - MATCHES + 1 rarest of either (prefix), tokens of a
single class take part only by their count, and classes with too few shared tokens are skipped.
Collisions are counted on a nibble of each coordinate that travels with the posting; a nibble never
disagrees where the value agrees, so pairs under MATCHES are no candidates. A parity sketch of the
whole sets rules out candidates that differ too much; every other one is confirmed on full sets,
and only the texts of these are read again.

No posting list is expanded into all its pairs while links are many: first each class is joined to
two hubs of each of its tokens. What is left are postings whose classes are in several components;
there, and only there, a semi-join keeps the rows that have a partner in another component, and
these rows' pairs across components are compared. So every link that could join two components is
tested; links inside a component aren't needed.

Tables that grow with the corpus are joined by sort and merge, never left to Spark's choice: it
goes by the size of written files, which packed columns, and lists that are exploded, make many
times too low, so that rows of hundreds of megabytes would pass through the driver.

Edge cases: null and empty texts, and texts without words, have an empty set and are linked with
nothing. Texts with fewer words than a shingle are one shingle. Repeated rows, and a doc_id with
several texts, are judged row by row; rows that repeat the smallest doc_id of a component are all
kept. A null doc_id is larger than all others: such a row is kept only in a component without
another doc_id, whose component_id is then null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, looked_up, merged, python_ready

COORDS, MATCHES = 48, 25
PREFIX = COORDS - MATCHES + 1
PERCENT = 80
#: Bytes of a text that are hashed in one step, to the next word's end.
STEP = 1 << 16
_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
NIBBLES = ["s0", "s1", "s2"]
#: Words of 64 bits of the parity sketch of a whole set.
PARITY = [f"o{i}" for i in range(16)]
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@lru_cache(1)
def _byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte, the same for A-Z and a-z."""
    g = np.random.default_rng(11).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    g[65:91] = g[97:123]
    return g


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(1)
def _step_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(_STEP), 2 * STEP), _powers(pow(int(_STEP), -1, 1 << 64), 2 * STEP)


def _hashes(part: bytes) -> np.ndarray:
    """64-bit hashes of the words of a part: sums of byte values times powers of the place in the word."""
    data = np.frombuffer(part, np.uint8)
    edges = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    begin, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _step_powers() if len(part) <= 2 * STEP else (_powers(int(_STEP), len(part)), _powers(pow(int(_STEP), -1, 1 << 64), len(part)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text in order, A-Z as a-z; the same word has the same hash everywhere."""
    out, at = [], 0
    while at < len(text):
        stop = _BLANK.search(text, at + STEP)
        end = stop.start() if stop else len(text)
        out.append(_hashes(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@lru_cache(1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1 << 62, size=(COORDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1 << 62, size=(COORDS, 1), dtype=np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text."""
    h = word_hashes(text)
    if not len(h):
        return h
    wide = min(width, len(h))
    acc = np.full(len(h) - wide + 1, wide, np.uint64)
    for i in range(wide):
        acc = (acc ^ (acc >> np.uint64(31))) * _STEP + h[i : len(h) - wide + 1 + i]
    acc = (acc ^ (acc >> np.uint64(33))) * _MIX
    return np.unique(acc ^ (acc >> np.uint64(33)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDS values of 31 bits; smallest of each coordinate's permutation."""
    a, b = _factors()
    low = np.full((COORDS, 1), ~np.uint64(0))
    cells = np.empty((COORDS, min(512, len(hashes))), np.uint64)
    for i in range(0, len(hashes), 512):
        part = hashes[i : i + 512]
        some = cells[:, : len(part)]
        np.multiply(a, part, out=some)
        np.add(some, b, out=some)
        np.minimum(low, some.min(axis=1, keepdims=True), out=low)
    return (low[:, 0] * _MIX >> np.uint64(33)).astype(np.int32)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each value, 16 values in a 64-bit word."""
    return ((sig.astype(np.uint64) & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 1,024 cells, is the number of hashes in it odd; 64 cells in a word.

    Two sets' sketches differ in at most as many cells as the sets differ in elements, so cells give
    a lower bound of the difference, never a wrong exclusion.
    """
    odd = np.bincount((hashes & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_KEYS = f"doc_id long, mark long, n_shingles long, set_key binary, sig array<int>, {', '.join(f'{s} long' for s in NIBBLES + PARITY)}"


def _mark() -> Column:
    """With doc_id, what tells a row from others: a hash of its text."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """rid (a number of its own), doc_id, mark, n_shingles, set_key (null for an empty set), sig with its nibbles, and parities for every row."""
    python_ready(docs.sparkSession)
    names = [x.split()[0] for x in _KEYS.split(", ")]

    def rows(batches):
        for b in batches:
            n, keys, sigs, words = [], [], [], []
            for text in b.column(2):
                s = shingle_set(text.as_py() or b"", width)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(sig := signature(s) if len(s) else np.zeros(COORDS, np.int32))
                words.append(np.concatenate([nibbles(sig), parities(s)]))
            cols = np.array(words, np.int64).reshape(-1, len(NIBBLES + PARITY))
            flat = pa.array(np.array(sigs, np.int32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, COORDS * len(n) + 1, COORDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists, *(pa.array(cols[:, i]) for i in range(cols.shape[1]))], names)

    made = docs.select(F.col("doc_id").cast("long"), _mark().alias("mark"), F.col("text").cast("binary").alias("raw")).mapInArrow(rows, _KEYS)
    return made.select(F.monotonically_increasing_id().alias("rid"), "*")


def agreeing(a: str, b: str) -> Column:
    """In how many nibbles two postings agree."""
    out = F.lit(16 * len(NIBBLES))
    for s in NIBBLES:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        out = out - F.bit_count(x)
    return out


def _near(a: str, b: str) -> Column:
    """Could they be similar enough, by set sizes and nibbles."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (agreeing(a, b) >= MATCHES)


def _may_link(a: str, b: str) -> Column:
    """Exact bound: sets of sizes n and m are similar enough only if they differ in at most (n + m) (1 - s) / (1 + s) elements."""
    differ = sum((F.bit_count(F.col(f"{a}.{o}").bitwiseXOR(F.col(f"{b}.{o}"))) for o in PARITY), F.lit(0))
    return differ * (100 + PERCENT) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - PERCENT)


def postings(classes: DataFrame) -> DataFrame:
    """token, p (cid, n, nibbles): each class under its rarest tokens, without tokens of one class."""
    token = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long"))
    all_tokens = classes.select("cid", F.posexplode("sig").alias("pos", "value")).select("cid", token.alias("token"))
    shared = all_tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    # by class: tokens that others have, rarest first; the class's own tokens come before them in the prefix
    own = all_tokens.join(merged(shared), "token").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ts"))
    own = own.filter(F.size("ts") >= MATCHES).select("cid", F.explode(F.slice("ts", 1, F.lit(PREFIX - COORDS) + F.size("ts"))).alias("t"))
    point = classes.select("cid", F.struct("cid", "n", *NIBBLES).alias("p"))
    return own.select("cid", F.col("t.token").alias("token")).join(merged(point), "cid").select("token", "p")


def hub_pairs(posts: DataFrame) -> DataFrame:
    """a, b: each posting with two classes of its token, the first in order of cid and the first in order of a hash of it."""
    first = [F.min(F.struct(order.alias("o"), "p"))["p"] for order in (F.col("p.cid"), F.xxhash64("p.cid"))]
    hubs = posts.groupBy("token").agg(F.array(*first).alias("hubs"))
    pairs = posts.join(merged(hubs), "token").select("p", F.explode("hubs").alias("hub")).filter((F.col("p.cid") != F.col("hub.cid")) & _near("p", "hub"))
    return pairs.select(F.least("hub.cid", "p.cid").alias("a"), F.greatest("hub.cid", "p.cid").alias("b")).distinct()


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their parity sketches don't rule out."""
    x, y = (classes.select(F.col("cid").alias(c), F.struct("n", *PARITY).alias(f"p{c}")) for c in "ab")
    return pairs.join(merged(x), "a").join(merged(y), "b").filter(_may_link("pa", "pb")).select("a", "b")


def _verified(width: int, percent: int):
    def rows(batches):
        last, a = None, None
        for b in batches:
            out = []
            for x, y, tx, ty in zip(*(b.column(i) for i in range(4)), strict=True):
                if x.as_py() != last:
                    last, a = x.as_py(), shingle_set(tx.as_py(), width)
                c = shingle_set(ty.as_py(), width)
                both = len(np.intersect1d(a, c, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(c) - both):
                    out.append((last, y.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough; reads the texts of these classes' first rows."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = scratch.write(classes.select("cid", F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).join(merged(wanted), "cid", "left_semi"), "near-wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), F.col("text").cast("binary").alias("raw"))
    found = rows.join(looked_up(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))).select("cid", "raw")
    texts = scratch.write(found.dropDuplicates(["cid"]), "near-texts")
    left, right = (texts.select(F.col("cid").alias(c), F.col("raw").alias(f"t{c}")) for c in "ab")
    both = pairs.join(merged(right), "b").join(merged(left), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verified(width, percent), "a long, b long")


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """v, comp (smallest vertex reachable) for all vertices of edges (a, b): large-star and small-star rounds until all edges point to roots."""
    e = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    while True:
        # large-star: every larger neighbour goes to the smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(merged(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(e.select("u", "v").join(merged(low.select("u", "m")), "u").select("u", F.col("m").alias("v")))
        large = scratch.write(large.filter("u <> v").distinct(), tag)
        # small-star: every smaller neighbour, and the vertex, to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(merged(least), "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        e = scratch.write(small.filter("u <> v").distinct(), tag)
        # done when every vertex points to one root only, and no root points further
        edges, tails = e.agg(F.count("*"), F.countDistinct("u")).first()
        if edges == tails and not e.join(merged(e.select(F.col("u").alias("v"))), "v", "left_semi").limit(1).count():
            break
    roots = e.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return e.unionByName(roots).groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "v")


def _cross(posts: DataFrame, comps: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: possible pairs of different components under a token. Rows outside a token's largest component meet all its rows."""
    label = comps.select(F.col("v").alias("cid"), "comp")  # a class without links is its own component
    rows = posts.withColumn("cid", F.col("p.cid")).join(merged(label), "cid", "left").select("token", "p", F.coalesce("comp", "cid").alias("comp"))
    rows = scratch.write(rows, "near-labelled")
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("token", "main")
    rows = rows.join(merged(mixed), "token").select("token", "p", "comp", "main")

    def meet(x: str, y: str) -> Column:
        return (F.col(f"{x}.comp") != F.col(f"{y}.comp")) & _near(f"{x}.p", f"{y}.p")

    # slim rows first: those without a partner in another component end here
    live = rows.alias("x").join(merged(rows.alias("y")), (F.col("x.token") == F.col("y.token")) & meet("x", "y"), "left_semi")
    live = scratch.write(live.select("token", F.col("p.cid").alias("cid"), "comp", "main"), "near-live")
    # a class has PREFIX tokens at most; a pair comes up under its smallest shared token only
    own = live.groupBy("cid").agg(F.collect_list("token").alias("ts"))
    point = classes.join(merged(own), "cid").select("cid", F.struct("cid", "n", "ts", *NIBBLES, *PARITY).alias("p"))
    live = scratch.write(live.join(merged(point), "cid").select("token", "p", "comp", "main"), "near-live")
    once = F.array_min(F.array_intersect("x.p.ts", "y.p.ts")) == F.col("x.token")
    order = (F.col("y.comp") == F.col("y.main")) | (F.col("x.p.cid") < F.col("y.p.cid"))
    both = (F.col("x.token") == F.col("y.token")) & order & meet("x", "y") & _may_link("x.p", "y.p") & once
    pairs = live.filter("comp <> main").alias("x").join(merged(live.alias("y")), both)
    return pairs.select(F.least("x.p.cid", "y.p.cid").alias("a"), F.greatest("x.p.cid", "y.p.cid").alias("b")).distinct()


def near_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    keys = scratch.write(signatures(docs, width), "near-keys")
    full = keys.filter("set_key is not null")
    by_set = full.groupBy("set_key").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("low"))
    # the class's number is that of its first row, which stands for it
    first = full.select(F.col("rid").alias("cid"), "doc_id", "mark", F.col("n_shingles").alias("n"), "sig", *NIBBLES, *PARITY)
    classes = scratch.write(by_set.join(merged(first), "cid"), "near-classes")
    posts = scratch.write(postings(classes), "near-postings")

    hubs = scratch.write(possible(hub_pairs(posts), classes), "near-pairs")
    links = scratch.write(verify(hubs, docs, classes, width, scratch), "near-links")
    comps = scratch.write(components(links, scratch), "near-comps")
    cross = scratch.write(_cross(posts, comps, classes, scratch), "near-pairs")
    links = links.unionByName(scratch.write(verify(cross, docs, classes, width, scratch), "near-links"))
    comps = scratch.write(components(links, scratch), "near-comps")

    label = classes.select("set_key", "low", F.col("cid").alias("v")).join(merged(comps), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    lowest = label.groupBy("comp").agg(F.min("low").alias("component_id"))
    label = label.join(merged(lowest), "comp").select("set_key", "component_id")
    some = full.select("doc_id", "mark", "n_shingles", "set_key").join(merged(label), "set_key").drop("set_key")
    none = keys.filter("set_key is null").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    out = scratch.write(some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-rows")
    scratch.clear(but=out)
    return out


def near_components(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for every row of docs (doc_id, text)."""
    return near_rows(docs, width).select("doc_id", "n_shingles", "component_id", "kept")


def deduped_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id."""
    gone = near_rows(docs, width).filter("not kept").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct()
    gone = looked_up(gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_mark"]), "left_anti")
