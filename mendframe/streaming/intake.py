"""Classes of files as they arrive: a stream of new blobs through the same decision table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mendframe.operators.classify import classified
from mendframe.sources.corpus import new_files

COLUMNS = ["doc_id", "path", "size", "sha256", "family", "label", "confidence"]


def arriving(spark: SparkSession, folder: str, all_files: bool = False) -> DataFrame:
    """A stream of classes; each file counts once."""
    return classified(new_files(spark, folder, all_files)).select(*COLUMNS)


def persist(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet and stops; a rerun goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
