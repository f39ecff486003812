"""Helpers that several operators share: shared files, column picking, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.io import new_path

#: The white space of every contract: blank and the controls 9 to 13.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; documents can be long, so far fewer than Spark's 10,000.
ARROW_ROWS = 512
#: Rows of a few numbers that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond ASCII that lower() changes are in these classes.
_CASED = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{Lm}\p{M}\p{P}\p{Z}\p{Sc}\p{Sk}\p{Sm}\p{Nd}\p{No}\p{C}]"


class Scratch:
    """Tables in the shared folder, each computed once and safe from lost executors; clear() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def clear(self, but: DataFrame) -> None:
        """Deletes all tables but one, which must not depend on the others any more."""
        context = self.spark.sparkContext
        for df, path in self.paths.values():
            if df is not but:
                place = context._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = {}


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once and outlives lost executors."""
    return Scratch(df.sparkSession).write(df, tag)


def python_ready(spark: SparkSession) -> None:
    """Before Python runs in tasks: the package is sent, and Arrow batches have fewer rows than Spark's default unless the user has set another number."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def merged(side: DataFrame) -> DataFrame:
    """A side of a join by sort and merge: never broadcast, however small Spark takes it for by its files' size."""
    return side.hint("merge")


def looked_up(side: DataFrame) -> DataFrame:
    """A side of a join, broadcast if it was counted and has few rows, else merged."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else merged(side)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def root_buckets(rows: int) -> int:
    """About the square root: as many buckets as rows in each, for running totals in two levels."""
    return max(16, int(rows**0.5))


def running(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column) -> DataFrame:
    """df with start (sum of value before the row within its groups, in order of bucket and order) and nth (the row's number in its bucket).

    Two levels, so that no task gets a whole group: totals by bucket, then sums within a bucket. groups must not be null.
    """
    keys = [*groups, bucket]
    rows = df.withColumn("_v", value.cast("long"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys).agg(F.sum("_v").alias("_t")).select(*keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("_in", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v"))
    return rows.join(merged(base), keys).withColumn("start", F.col("_base") + F.col("_in")).drop("_v", "_base", "_in")


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z only; lower(), much faster than translate(), where both agree."""
    return F.when(x.rlike(_CASED), F.translate(x, _UPPER, _LOWER)).otherwise(F.lower(x))
