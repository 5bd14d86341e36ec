"""Reports over a run's tables: totals, counts by key, and the rows of attempts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "none"


def totals(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row: files, files with a success, and the rest."""
    won = outputs.where("success = 1").agg(F.count_distinct("doc_id").alias("recovered"))
    return files.agg(F.count("*").alias("total_files")).crossJoin(won).withColumn("failed", F.greatest(F.lit(0), F.col("total_files") - F.col("recovered")))


def by(rows: DataFrame, key: Column | str, where: str | None = None) -> DataFrame:
    """key and n, most frequent first; a missing key reads `none`."""
    own = rows if where is None else rows.where(where)
    name = F.col(key) if isinstance(key, str) else key
    return own.groupBy(F.coalesce(name, F.lit(NONE)).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def attempt_rows(attempts: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Attempts with the file's path and, where it is known, the candidate."""
    own = candidates.select("doc_id", "ord", "strategy", "family", "priority")
    paths = files.select("doc_id", "path")
    columns = ["phase", "decoder", "ok", "width", "height", "duration_ms", "frame_count", "score", "error"]
    rows = attempts.select("doc_id", "ord", *columns).join(paths, "doc_id").join(own, ["doc_id", "ord"], "left")
    return rows.withColumn("ok", F.col("ok").cast("int")).select("path", "ord", "strategy", "family", "priority", *columns)
