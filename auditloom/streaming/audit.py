"""Row-local operators on a stream: the same functions run on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import claims as cl
from ..operators import decide as dc


def scan_stream(posts: DataFrame) -> DataFrame:
    """Lexicon hits of a stream of posts (id, text), with their laws."""
    return cl.with_laws(cl.hit_table(posts, ["id"]))


def verdict_stream(evidence: DataFrame) -> DataFrame:
    """Levels of a stream of evidence rows, with what to do."""
    return dc.with_playbook(dc.judged(evidence))


def flood_windows(comments: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """For comments (thread, text, at) of a stream: by thread and window their number, short share and approximate distinct share."""
    norm = tx.normalized(F.col("text"))
    by = comments.withWatermark("at", late).groupBy("thread", F.window("at", width))
    n = F.count("*")
    return by.agg(n.alias("n"), F.avg((F.length(norm) <= lx.SHORT).cast("double")).alias("short_rate"), (1 - F.approx_count_distinct(norm) / n).alias("repeat_rate"))
