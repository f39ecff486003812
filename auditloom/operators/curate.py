"""Data curation: manifest rules, leakage, near-duplicate fingerprints, splits, labels, catalogue matches."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS, KINDS = ("smoke", "train", "calibration", "blind"), ("real", "generated", "edited", "claim")


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def row_violations(manifest: DataFrame) -> DataFrame:
    """Id and rule of every violated row rule."""
    twice = manifest.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id", F.lit(True).alias("twice"))
    m = manifest.join(twice, "id", "left")
    two = F.size(F.array_distinct(F.filter(F.transform("reviewers", lambda r: F.trim(r)), lambda r: r != ""))) < 2
    rules = {
        "required": blank("id") | blank("group") | blank("authorization"), "duplicate_id": F.coalesce("twice", F.lit(False)),
        "enum": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)) | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "two_reviewers": (F.col("split") == "blind") & F.coalesce(two, F.lit(True)),
        "generator": (F.col("kind") == "generated") & (blank("generator") | blank("generator_version")), "original": (F.col("kind") == "edited") & (blank("original_sha256") | blank("edit")),
    }
    return m.select("id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


def leaks(manifest: DataFrame) -> DataFrame:
    """Key and value found in more than one place (split and group; for generators: blind or development), with how many. Image hashes are also compared with original hashes."""
    place = F.concat_ws("|", "split", "group")
    keys = [F.struct(F.lit(k).alias("key"), F.col(k).alias("value"), place.alias("place")) for k in ("group", "identity", "campaign", "original_sha256")]
    keys += [F.struct(F.lit("generator").alias("key"), F.col("generator").alias("value"), F.when(F.col("split") == "blind", "blind").otherwise("development").alias("place")), F.struct(F.lit("original_sha256").alias("key"), F.col("sha256").alias("value"), place.alias("place"))]
    cells = manifest.select(F.explode(F.array(*keys)).alias("c")).select("c.*").filter("value is not null and value <> ''").distinct()
    return cells.groupBy("key", "value").agg(F.count("*").alias("places")).filter("places > 1")


def orphans(manifest: DataFrame) -> DataFrame:
    """Edited rows without their original in the same split and group."""
    edited = manifest.filter("kind = 'edited' and original_sha256 is not null")
    roots = manifest.filter("kind in ('real', 'generated')").select("split", "group", F.col("sha256").alias("original_sha256")).distinct()
    return edited.join(roots, ["split", "group", "original_sha256"], "left_anti").select("id", "original_sha256")


def near_fingerprints(prints: DataFrame, most: int = 4, bits: int = 64) -> DataFrame:
    """Pairs of fingerprints of different splits within most bits: a, b, distance.

    Of most + 3 blocks of the bits at least three agree, so a join on each choice of three blocks is
    exact; a pair counts under the first choice that it agrees on only. Rows fold to one a
    fingerprint, with its least and greatest split, first: flat images with one are one row. Only
    fingerprints move by block, and pairs within the distance look up their splits. The joins are
    merges: Spark's estimate leaves out how many rows the choices make, so it would broadcast them.
    """
    edges = [round(i * bits / (most + 3)) for i in range(most + 4)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, 3)]
    masks = F.array(*(F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in masks))
    rows = prints.filter("fp is not null").groupBy("fp").agg(F.min("split").alias("s"), F.max("split").alias("t"))
    keys = rows.select("fp", F.posexplode(masks).alias("i", "mask")).select("i", F.col("fp").bitwiseAND(F.col("mask")).alias("v"), "fp")
    a, b = (keys.select("i", "v", F.col("fp").alias(x)).hint("merge") for x in "ab")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.transform(masks, lambda m: m.bitwiseAND(apart) == 0), True) == F.col("i") + 1
    near = a.join(b, ["i", "v"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= most) & first).select("a", "b")
    for x in "ab":
        near = near.join(rows.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}"), F.col("t").alias(f"t{x}")), x)
    near = near.filter((F.col("sa") != F.col("tb")) | (F.col("ta") != F.col("sb"))).select("a", "b", F.bit_count(apart).alias("distance"))
    return near.unionByName(rows.filter("s <> t").select(F.col("fp").alias("a"), F.col("fp").alias("b"), F.lit(0).alias("distance")))


def matched_predictions(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: pairs, rows of one side alone, repeated ids, and pairs whose hash differs."""
    m = manifest.groupBy("id").agg(F.count("*").alias("km"), F.max("sha256").alias("hm"))
    p = predictions.groupBy("id").agg(F.count("*").alias("kp"), F.max("image_sha256").alias("hp"))
    j = m.join(p, "id", "full")
    both = F.col("km").isNotNull() & F.col("kp").isNotNull()
    return j.agg(F.count_if(both).alias("pairs"), F.count_if(F.col("kp").isNull()).alias("without_prediction"), F.count_if(F.col("km").isNull()).alias("without_row"), F.count_if((F.col("km") > 1) | (F.col("kp") > 1)).alias("repeated"), F.count_if(both & ~F.col("hm").eqNullSafe(F.col("hp"))).alias("hash_differs"))


def known_originals(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items (name, content) with the first other name in the catalogue that has the same SHA-256, or null.

    The two smallest names of a digest are enough, so a digest of very many entries is one row.
    """
    names = catalog.select("name", F.sha2("content", 256).alias("digest")).distinct()
    first = names.groupBy("digest").agg(F.min("name").alias("n1"))
    second = names.join(first, "digest").filter("name <> n1").groupBy("digest").agg(F.min("name").alias("n2"))
    keyed = items.select("name", F.sha2("content", 256).alias("digest"))
    out = keyed.join(first, "digest", "left").join(second, "digest", "left")
    return out.select("name", "digest", F.when(F.col("n1") != F.col("name"), F.col("n1")).otherwise(F.col("n2")).alias("known_original"))


def new_rows(rows: DataFrame, catalog: DataFrame, key: list[str], kind: str | None = "brand_claim") -> DataFrame:
    """Rows of the allowed kind (None: any) whose key the catalogue lacks, one a key; null parts of a key count as equal.

    Keys of the rows are looked up in the catalogue, so a small import moves no catalogue.
    """
    fresh = (rows.filter(F.col("source_type") == kind) if kind else rows).dropDuplicates(key)

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)))
        return left.join(other, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key))), how)

    return same(fresh, same(catalog.select(*key), fresh, "left_semi"), "left_anti")


def imported(rows: DataFrame, catalog: DataFrame, key: list[str], kind: str = "brand_claim") -> DataFrame:
    """Catalogue with the rows of the allowed kind that it doesn't have yet; importing twice changes nothing."""
    return catalog.unionByName(new_rows(rows, catalog, key, kind).select(*catalog.columns))


def first_of_content(items: DataFrame, least_side: int = 200) -> DataFrame:
    """Kept, repeated and too small items (ord, digest, side); of equal content the first in order stays."""
    first = items.filter(F.col("side") >= least_side).groupBy("digest").agg(F.min("ord").alias("first"))
    rows = items.join(first, "digest", "left")
    state = F.when(F.col("side") < least_side, "small").when(F.col("ord") == F.col("first"), "kept").otherwise("duplicate")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def frozen_manifest(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """Path to file, bucket, source group by its directory; registry: dir, bucket, truth."""
    rows = paths.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("dir"))
    group = F.concat_ws(":", "dir", F.when(F.contains("file", F.lit("_v")), F.substring_index("file", "_v", 1)).otherwise(F.substring_index("file", ".", 1)))
    return rows.join(registry, "dir", "left").select("file", "bucket", "truth", group.alias("source_group"))


def stratified_split(items: DataFrame, stratum: str, key: str, ratio: float, seed: int) -> DataFrame:
    """Items with part: round(n * ratio), at least one, of each stratum are for validation, by a seeded order of hashes.

    The validation rows are those of hash at most the k-th smallest; the k-th is found over a hash
    histogram and then within one of its cells, so no task sorts a stratum.
    """
    rows = items.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_c", F.shiftrightunsigned("_h", 54))
    n = rows.groupBy(stratum, "_c").agg(F.count("*").alias("_k"))
    up = Window.partitionBy(stratum).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_k").over(up), F.lit(0))).withColumn("_n", F.sum("_k").over(Window.partitionBy(stratum)))
    nth = F.row_number().over(Window.partitionBy(stratum, "_c").orderBy("_h", key))
    out = rows.withColumn("_r", nth).join(n.select(stratum, "_c", "_before", "_n"), [stratum, "_c"])
    take = F.greatest(F.lit(1), F.bround(F.col("_n") * ratio))
    return out.withColumn("part", F.when(F.col("_before") + F.col("_r") <= take, "validation").otherwise("train")).drop("_h", "_c", "_r", "_before", "_n")


def provenance_split(items: DataFrame, provenance: DataFrame, keep: int) -> DataFrame:
    """P5: items (grp, name) of groups with provenance: the first keep (at least 1) by name are held out, the rest train; counts by group and part.

    Only the first keep + 1 names of a group are ranked, and Spark limits them before the shuffle.
    """
    ok = items.join(provenance.select("grp").distinct(), "grp", "left_semi")
    few = ok.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("name"))).filter(F.col("r") <= keep + 1)
    firsts = few.groupBy("grp").agg(F.min("name").alias("held"), F.max(F.when(F.col("r") == keep + 1, F.col("name"))).alias("train"))
    n = ok.groupBy("grp").agg(F.count("*").alias("n"))
    held = F.struct(F.lit("held_out").alias("part"), F.least("n", F.lit(keep)).alias("n"), F.col("held").alias("first"))
    train = F.struct(F.lit("train").alias("part"), (F.col("n") - keep).alias("n"), F.col("train").alias("first"))
    return n.join(firsts, "grp").select("grp", F.explode(F.array(held, train)).alias("x")).select("grp", "x.*").filter("n > 0")


def pseudo_labels(scores: DataFrame, accept: float = 0.25, reject: float = 0.5) -> DataFrame:
    """Counts of accepted, rejected and skipped (between, or missing) rows."""
    s = F.col("score")
    return scores.groupBy(F.when(s <= accept, "accept").when(s >= reject, "reject").otherwise("skip").alias("label")).agg(F.count("*").alias("n"))


def weights(rows: DataFrame) -> DataFrame:
    """Class weight n / (2 n_c) and group weight 1 / group size, by kind and grp with counts."""
    by = rows.groupBy("kind", "grp").agg(F.count("*").alias("k"))
    classes = by.groupBy(F.col("kind").alias("of")).agg(F.sum("k").alias("n_c"))
    total = by.agg(F.sum("k").alias("n"))  # one row
    g = F.sum("k").over(Window.partitionBy("grp"))  # a row a kind
    out = by.withColumn("g", g).join(classes, F.col("kind").eqNullSafe(F.col("of"))).join(F.broadcast(total))
    return out.select("kind", "grp", "k", (F.col("n") / (2 * F.col("n_c"))).alias("class_weight"), (1 / F.col("g")).alias("group_weight"))


def label_gate(manifest: DataFrame) -> DataFrame:
    """Rows outside smoke, of an image kind, that aren't reviewed as free of a label."""
    fine = F.col("reviewed").eqNullSafe(F.lit(True)) & F.col("label_present").eqNullSafe(F.lit(False))
    return manifest.filter((F.col("split") != "smoke") & F.col("kind").isin("real", "generated", "edited") & ~fine).select("id", "split", "kind")


def rewritten_lineage(manifest: DataFrame, mapping: DataFrame) -> DataFrame:
    """Image and original digests replaced by mapping (old, new), review flags reset. mapping has one row a digest.

    Rows without a digest match nothing; a hash of their other digest spreads them over the tasks of the join.
    """
    m = mapping.filter("old is not null").dropDuplicates(["old"]).select(F.struct(F.col("old").alias("d"), F.lit(0).cast("long").alias("apart")).alias("_key"), F.col("new").alias("_new"))

    def replaced(df: DataFrame, name: str, other: str) -> DataFrame:
        key = F.struct(F.col(name).alias("d"), F.when(F.col(name).isNull(), F.xxhash64(other)).otherwise(0).cast("long").alias("apart"))
        found = df.withColumn("_key", key).drop(name).join(m, "_key", "left")
        return found.select(*(F.coalesce("_new", "_key.d").alias(c) if c == name else c for c in df.columns))

    return replaced(replaced(manifest, "sha256", "original_sha256"), "original_sha256", "sha256").withColumn("reviewed", F.lit(False)).withColumn("label_present", F.lit(None).cast("boolean"))


#: Truth, scene and source of a kind that the table of kinds lacks.
UNKNOWN_KIND = {"truth": "unknown", "scene": "generated", "source": "own"}


def packages(manifest: DataFrame, kinds: DataFrame, copies: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (stem, kind) with truth, scene and source of the kind (UNKNOWN_KIND where kinds lacks it or has null), the first copy by pos, and whether the file is there."""
    first = copies.groupBy("stem").agg(F.min_by("text", F.struct("pos", "text")).alias("copy"))
    there = files.select("stem", F.lit(True).alias("there")).distinct()
    rows = manifest.join(kinds, "kind", "left").join(first, "stem", "left").join(there, "stem", "left")
    return rows.select("stem", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in UNKNOWN_KIND.items()), "copy", F.coalesce("there", F.lit(False)).alias("there"))


def missing_files(packed: DataFrame) -> DataFrame:
    """Packages whose file is not there."""
    return packed.filter("not there").select("stem", "truth")


def compared_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """By family the cases of both runs (case, family, ok), passes of either, and regressions."""
    both = old.select("case", "family", F.col("ok").alias("a")).join(new.select("case", F.col("ok").alias("b")), "case")
    return both.groupBy("family").agg(F.count("*").alias("cases"), F.count_if("a").alias("old_ok"), F.count_if("b").alias("new_ok"), F.count_if(F.col("a") & ~F.col("b")).alias("regressions"), F.bool_and("b").alias("all_ok"))
