"""How the given tables are read as the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words that stand for positive and negative ones in the generated texts.
GLAD, SORRY, DETAILS = ["the", "der"], ["les"], [r"[0-9]"]


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as comments: the source is thread and content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("thread"), F.col("source").alias("content"), F.col("doc_id").alias("idx"), "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations")
    return d.select(F.col("conv_id").alias("thread"), F.col("role").alias("content"), F.col("turn").alias("idx"), "text")


#: RE2's form of the noise that comments are compared without.
NOISE_SQL = r"[\p{P}\p{S}\p{Z}\s\x{0b}\x{85}\x{1c}-\x{1f}]"
NORM_SQL = f"regexp_replace(coalesce(text, ''), '{NOISE_SQL}', '', 'g')"
GRAMS_SQL = "CASE WHEN length(norm) < 4 THEN [norm] ELSE list_distinct([substring(norm, i, 4) for i in range(1, length(norm) - 2)]) END"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, line, part, days, value, kind and captions rendered from lineitem: copy, image (null if dropped), image_value.

    kind 0 asserted, 1 negated, 2 question, 3 quoted, 4 with a medical word, 5 with an absolute one.
    """
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def largest(c: Column, letter: str) -> Column:
        """Is this the largest value of c; null where all are. Unlike the value itself, which is a string, it needs no sort."""
        return F.max(c == letter) & ~F.max(c > letter)

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").cast("int").alias("line")).agg(
        F.max("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("value"), largest(flag, "R").alias("returned"), largest(status, "F").alias("filled"))
    rows = lines.withColumn("days", F.col("line") + 1).withColumn("kind", (F.col("asset") % 6).cast("int"))
    name = F.concat(F.lit("【P"), F.col("part").cast("string"), F.lit("精华】"), F.col("days").cast("string"), F.lit("天"))
    claim = F.concat(F.lit("水分提升"), F.col("value").cast("string"), F.lit("%"))
    copy = (
        F.when(F.col("kind") == 1, F.concat(name, F.lit("不能"), claim, F.lit("。")))
        .when(F.col("kind") == 2, F.concat(name, claim, F.lit("？")))
        .when(F.col("kind") == 3, F.concat(F.lit("评论宣称「"), name, claim, F.lit("」。")))
        .when(F.col("kind") == 4, F.concat(name, claim, F.lit("，治疗。")))
        .when(F.col("kind") == 5, F.concat(name, claim, F.lit("，最佳。")))
        .otherwise(F.concat(name, claim, F.lit("。")))
    )
    shown = F.col("value") + F.when(F.col("returned"), 1).otherwise(0)
    there = ~(F.col("filled") & (F.col("line") % 2 == 0))
    image = F.concat(name, F.lit("水分提升"), shown.cast("string"), F.lit("%。"))
    return rows.select("asset", "line", "part", "days", "value", "kind", copy.alias("copy"), F.when(there, image).alias("image"), F.when(there, shown).alias("image_value"))


CAPTIONS_SQL = """
caption AS (
  SELECT *, CASE WHEN there THEN value + (flag = 'R')::INT END AS image_value FROM (
    SELECT *, NOT (status = 'F' AND line % 2 = 0) AS there FROM (
      SELECT l_orderkey AS asset, l_linenumber::INT AS line, max(l_partkey) AS part, max(l_quantity)::INT AS value,
             max(l_returnflag) AS flag, max(l_linestatus) AS status, (l_linenumber + 1)::INT AS days, (l_orderkey % 6)::INT AS kind
      FROM lineitem GROUP BY ALL)))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector scores rendered from lineitem: file, grp, kind, tag, generator, score (null every 17th), spectral, and more columns."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    score = F.when(key % 17 == 0, None).otherwise((F.col("l_partkey") * 7919 % 1000) / 1000)
    kind = F.when(F.col("l_returnflag") == "R", "real").otherwise("generated")
    return li.select(key.alias("file"), F.col("l_suppkey").alias("grp"), kind.alias("kind"), F.col("l_linestatus").alias("tag"), (F.col("l_suppkey") % 5).alias("generator"), score.alias("score"), ((F.col("l_suppkey") * 31 + F.col("l_partkey") * 17) % 1000 / 1000).alias("spectral"), (F.col("l_linenumber") % 4).alias("set"), F.col("l_quantity").cast("int").alias("qty"))


SCORES_SQL = """
score AS (
  SELECT l_orderkey * 8 + l_linenumber AS file, l_suppkey AS grp, CASE WHEN l_returnflag = 'R' THEN 'real' ELSE 'generated' END AS kind,
         l_linestatus AS tag, l_suppkey % 5 AS generator,
         CASE WHEN (l_orderkey * 8 + l_linenumber) % 17 <> 0 THEN (l_partkey * 7919 % 1000) / 1000 END AS score,
         ((l_suppkey * 31 + l_partkey * 17) % 1000) / 1000 AS spectral, l_linenumber % 4 AS set, l_quantity::INT AS qty
  FROM lineitem)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation manifest rendered from orders, with some violations of each rule."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    split = F.element_at(F.array(*map(F.lit, ("smoke", "train", "calibration", "blind"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("real", "generated", "edited", "claim"))), (k % 4 + 1).cast("int"))
    return o.select(
        F.when(k % 997 == 0, "").otherwise(F.concat(F.lit("s"), (k - (k % 499 == 1).cast("int")).cast("string"))).alias("id"),
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("group"),
        F.when(k % 101 == 3, F.lit(None)).otherwise("yes").alias("authorization"),
        F.when(k % 211 == 5, "other").otherwise(split).alias("split"), kind.alias("kind"),
        F.array(F.lit("ann"), F.when(k % 7 == 0, " ann ").otherwise("bo")).alias("reviewers"),
        F.when(k % 4 == 1, F.when(k % 13 == 0, None).otherwise(F.concat(F.lit("gen"), (k % 40).cast("string")))).alias("generator"),
        F.when(k % 4 == 1, F.lit("v1")).alias("generator_version"),
        F.when(k % 4 == 2, F.concat(F.lit("h"), (k - 2 - (k % 11 == 0).cast("int")).cast("string"))).alias("original_sha256"),
        F.when(k % 4 == 2, F.lit("smooth")).alias("edit"),
        F.concat(F.lit("h"), k.cast("string")).alias("sha256"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("campaign"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("i"), F.col("o_custkey").cast("string"))).alias("identity"),
        (k % 5 != 0).alias("reviewed"), (k % 9 == 0).alias("label_present"))


MANIFEST_SQL = """
manifest AS (
  SELECT CASE WHEN k % 997 = 0 THEN '' ELSE 's' || (k - (k % 499 = 1)::INT) END AS id, 'g' || c AS "group",
         CASE WHEN k % 101 = 3 THEN NULL ELSE 'yes' END AS "authorization",
         CASE WHEN k % 211 = 5 THEN 'other' ELSE ['smoke', 'train', 'calibration', 'blind'][c % 4 + 1] END AS split,
         ['real', 'generated', 'edited', 'claim'][k % 4 + 1] AS kind,
         ['ann', CASE WHEN k % 7 = 0 THEN ' ann ' ELSE 'bo' END] AS reviewers,
         CASE WHEN k % 4 = 1 AND k % 13 <> 0 THEN 'gen' || (k % 40) END AS generator, CASE WHEN k % 4 = 1 THEN 'v1' END AS generator_version,
         CASE WHEN k % 4 = 2 THEN 'h' || (k - 2 - (k % 11 = 0)::INT) END AS original_sha256, CASE WHEN k % 4 = 2 THEN 'smooth' END AS edit,
         'h' || k AS sha256, 'p' || (c % 50) AS campaign, CASE WHEN k % 3 <> 0 THEN 'i' || c END AS identity,
         k % 5 <> 0 AS reviewed, k % 9 = 0 AS label_present
  FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))"""
