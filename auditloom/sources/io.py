"""Readers and writers with explicit schemas: document sets, notes, lines, evidence, assets, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POST = "id string, platform string, source_url string, author string, category string, text string, human_risk string, note string"
EVIDENCE = "tool string, source_asset_id string, observed string, cannot_prove string, evidence array<struct<score double, available boolean, text string>>"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; in local mode, where it is unset, a folder in /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints/auditloom"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: what several steps read is computed once and outlives lost executors."""
    df.write.parquet(path := new_path(df.sparkSession, tag))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smaller_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to four times as many tasks as shuffles have: for rows that become many more, or wider, in a task than what it reads, since tasks are sized by that."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_rooted(spark: SparkSession, path: str, root: str, schema: str = POST, multi_line: bool = False) -> DataFrame:
    """Rows under a root key of JSON documents, one document a line, or one a file with multi_line."""
    return spark.read.schema(f"`{root}` array<struct<{schema}>>").option("multiLine", multi_line).json(path).select(F.explode(root).alias("r")).select("r.*")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """JSONL notes with their text from title and description."""
    notes = spark.read.schema("note_id string, title string, desc string").json(path)
    return notes.select("note_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("desc", F.lit(""))).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter(F.length("text") > 0)


def read_evidence(spark: SparkSession, path: str, tools: list[str]) -> DataFrame:
    """A row for each asset with a column for each tool of a fixed list; unreadable rows and rows without a tool are left out."""
    return evidence_table(spark.read.schema(EVIDENCE).option("mode", "PERMISSIVE").json(path), tools)


def evidence_table(rows: DataFrame, tools: list[str]) -> DataFrame:
    """S4 of rows that were read, or gathered from a stream."""
    rows = rows.filter("tool is not null and source_asset_id is not null")
    return rows.groupBy(F.col("source_asset_id").alias("asset")).agg(*(F.max(F.when(F.col("tool") == t, F.get("evidence", F.lit(0)))).alias(t) for t in tools))


def list_assets(spark: SparkSession, path: str, pattern: str, keep: int | None = None) -> DataFrame:
    """Path, length and content of files by name pattern, the first keep by name if given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")
    return files.orderBy("path").limit(keep) if keep else files


def write_export(rows: DataFrame, path: str, kind: str = "json") -> str:
    """Rows as JSON, CSV with a header, or Parquet; the path."""
    writer = rows.write.option("header", True) if kind == "csv" else rows.write
    getattr(writer, kind)(path)
    return path
