"""Stages of a run over the corpus, each written once to the shared folder and read by every query that needs it.

A stage lies under spark.checkpoint.dir (a temporary folder where that is unset, as in tests), so any executor can read
it again and its lineage ends there. Stages are kept for a session and an input folder; files don't change under a run.
"""
from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.operators import candidates, classify, legacy, rebuild, scoring, signatures
from mendframe.plans.store import Files
from mendframe.sources import corpus

_held: dict[tuple, str] = {}
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Deletes the stages that this driver has made."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            Files(spark).delete(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="mendframe-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def written(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Writes rows once to the shared folder and reads them back."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Evidence:
    """The staged tables of one corpus."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def _staged(self, name: str, build) -> DataFrame:
        # a folder that has changed gives new stages
        key = (self.spark.sparkContext.applicationId, self.sf_dir, Files(self.spark).changed(f"{self.sf_dir}/documents.parquet"), name)
        if key not in _held:
            path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
            _made.append((self.spark, path))
            build().write.parquet(path)
            _held[key] = path
        return self.spark.read.parquet(_held[key])

    def blobs(self) -> DataFrame:
        return corpus.derived(self.spark, self.sf_dir)

    def classified(self) -> DataFrame:
        """Classes, hits and counts of all blobs, without their bytes."""
        return self._staged("classified", lambda: classify.classified(self.blobs()).drop("content"))

    def with_content(self) -> DataFrame:
        """Classes with the bytes they came from: scanned again, which costs less than to exchange bytes."""
        return classify.classified(self.blobs())

    def _plans(self, digest: bool) -> DataFrame:
        rows = self.with_content()
        return candidates.merged(candidates.every(rows, digest), rebuild.rebuild_plans(rows))

    def plans(self) -> DataFrame:
        """Plans of all lanes; those of the walking lanes have payload_sha256, others bytes before and after."""
        return self._staged("plans", lambda: self._plans(False))

    def payloads(self) -> DataFrame:
        """doc_id and payload_sha256 of every plan of all lanes."""
        return self._plans(True).select("doc_id", "payload_sha256")

    def attempts(self) -> DataFrame:
        """Probed and scored plans."""
        return self._staged("attempts", lambda: scoring.pseudo_probe(self.plans(), self.classified()))

    def outputs(self) -> DataFrame:
        """Every file with its winner or the reason that it has none."""
        files = self.classified().select("doc_id", "path", "family", "label")
        return scoring.outcomes(files, scoring.winners(self.attempts()))

    def files(self) -> DataFrame:
        """What the older engine's advice rests on: kinds to try, signatures by kind and counts of all markers."""

        def build() -> DataFrame:
            rows = legacy.chosen(self.blobs()).withColumns({"fallback_kinds": F.array_join("other_kinds", ","), "kinds": F.array_join("kinds", ",")})
            return signatures.with_counts(signatures.with_jpeg_counts(rows), signatures.OTHER_COUNTS | signatures.LEGACY_COUNTS).drop("content", "path", "other_kinds")

        return self._staged("files", build)

    def told(self) -> DataFrame:
        """Outputs with what the older engine's advice rests on."""
        number = self.attempts().groupBy("doc_id").agg(F.count("*").alias("attempts"))
        outputs = self.outputs().select("doc_id", "success", "error", "decoder")
        kinds = self.classified().select("doc_id", "declared_kind")
        return outputs.join(self.files(), "doc_id").join(kinds, "doc_id").join(number, "doc_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
