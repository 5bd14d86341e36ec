"""The evidence store: Parquet tables of runs, files, signatures, candidates, attempts and outputs, a folder each.

Appends are idempotent where a key says so: rows whose key is already there, or twice among the new ones, are left out.
Files lie in partitions by run_id, so only the partitions of the new rows' runs are looked through. Tables may gain
nullable columns: readers merge schemas.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.plans import report

KEYS = {"candidates": ["run_id", "doc_id", "dedupe_key"], "files": ["run_id", "doc_id"]}
WORKSPACE = ".uncorrupter-workspace"  # fixed value: the folder beside outputs or the store
# fixed values: the header of the attempt report
REPORT_COLUMNS = ["relative_path", "strategy_id", "family", "priority", "phase", "decoder", "ok", "width", "height", "mode", "decoded_format", "duration_ms", "frame_count", "score", "error"]


@dataclass(frozen=True)
class Workspace:
    """Folders of a run's files."""

    root: str

    @staticmethod
    def beside(store: str, output_root: str | None = None, root: str | None = None) -> Workspace:
        """The named root, else one in the output root, else one beside the store."""
        return Workspace((root or f"{(output_root or store.rstrip('/').rpartition('/')[0]).rstrip('/')}/{WORKSPACE}").rstrip("/"))

    def folder(self, name: str) -> str:
        """blobs, outputs, reports or configs."""
        return f"{self.root}/{name}"

    def config_path(self, run_id: int) -> str:
        return f"{self.folder('configs')}/run-{run_id:06d}.json"


class Files:
    """Small files in whatever file system a path names."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        own = self.jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.conf), own

    def exists(self, path: str) -> bool:
        system, own = self._at(path)
        return system.exists(own)

    def claim(self, path: str) -> bool:
        """Makes an empty file, unless it is there: of several writers one succeeds."""
        system, own = self._at(path)
        return system.createNewFile(own)

    def write(self, path: str, text: str) -> None:
        system, own = self._at(path)
        out = system.create(own, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, path: str) -> None:
        system, own = self._at(path)
        system.delete(own, True)

    def changed(self, path: str) -> int:
        """When a file or folder last changed, 0 if it isn't there."""
        system, own = self._at(path)
        return system.getFileStatus(own).getModificationTime() if system.exists(own) else 0


class Store:
    """Tables under a root that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        key = KEYS.get(name)
        if key:
            rows = rows.dropDuplicates(key)
            if self.exists(name):
                runs = [r[0] for r in rows.select("run_id").distinct().collect()]  # a run or a few
                rows = rows.join(self.read(name).where(F.col("run_id").isin(runs)).select(*key), key, "left_anti")
        rows.write.mode("append").partitionBy("run_id").parquet(self.path(name))

    def start_run(self, command: str, engine: str, config: dict | None = None, input_root: str | None = None, output_root: str | None = None, workspace_root: str | None = None) -> int:
        """Appends a run and returns its id, one more than the latest; ids are claimed by a file each, so writers don't share one."""
        run_id = (self.latest_run() or 0) + 1
        while not self.files.claim(f"{self.root}/_claims/run-{run_id:06d}"):
            run_id += 1
        text = lambda v: F.lit(v).cast("string")
        row = self.spark.range(1).select(
            F.lit(run_id).cast("long").alias("run_id"), F.lit(command).alias("command"), text(input_root).alias("input_root"), text(output_root).alias("output_root"),
            text(workspace_root).alias("workspace_root"), F.lit(engine).alias("engine_name"), F.lit(json.dumps(config or {}, sort_keys=True)).alias("config_json"), F.current_timestamp().alias("created_at"),
        )
        row.write.mode("append").partitionBy("run_id").parquet(self.path("runs"))
        return run_id

    def latest_run(self) -> int | None:
        if not self.exists("runs"):
            return None
        return self.read("runs").agg(F.max("run_id").cast("long")).first()[0]

    def of_run(self, name: str, run_id: int | None = None) -> DataFrame:
        """A table's rows of a run, the latest if none is named; a run that isn't there is an error."""
        wanted = self.latest_run() if run_id is None else run_id
        if wanted is None or not self.exists("runs") or not self.read("runs").where(F.col("run_id") == wanted).limit(1).count():
            raise ValueError(f"Run {wanted} not found")
        return self.read(name).where(F.col("run_id") == wanted) if self.exists(name) else self.read("runs").limit(0)

    def summary(self, run_id: int | None = None) -> dict:
        """What a run was and found: totals, and counts by class, family, kind, decoder, strategy, output type and error."""
        run = self.of_run("runs", run_id).first()
        wanted = int(run["run_id"])
        files = self.of_run("files", wanted)
        outputs = self.of_run("outputs", wanted) if self.exists("outputs") else None
        counts = lambda rows, key, where=None: {r["key"]: r["n"] for r in report.by(rows, key, where).collect()}  # noqa: E731  a row a key
        total = files.count()
        won = outputs.where("success = 1").select("doc_id").distinct().count() if outputs is not None else 0
        out = {k: run[k] for k in ("run_id", "command", "input_root", "output_root", "workspace_root", "engine_name")} | {"created_at": str(run["created_at"])}
        out |= {"total_files": total, "recovered": won, "failed": max(0, total - won)}
        out |= {f"by_{name}": counts(files, key) for name, key in (("classification", "label"), ("family", "family"), ("anywhere_kind", "anywhere_kind"))}
        for name, key, where in (("by_decoder", "decoder", "success = 1"), ("by_strategy", "strategy_id", "success = 1"), ("by_output_type", "output_type", "success = 1"), ("top_errors", "error", "success = 0")):
            out[name] = counts(outputs, key, where) if outputs is not None else {}
        return out

    def attempt_rows(self, run_id: int | None = None) -> DataFrame:
        """The attempt report of a run: attempts with paths and candidates, in the order of paths and attempts."""
        wanted = self.latest_run() if run_id is None else run_id
        attempts, files, candidates = (self.of_run(n, wanted) for n in ("attempts", "files", "candidates"))
        plans = candidates.select("doc_id", "dedupe_key", F.col("strategy").alias("strategy_id"), "family", "priority")
        joined = attempts.drop("family", "priority", "run_id").join(files.select("doc_id", "relative_path"), "doc_id").join(plans, ["doc_id", "dedupe_key"], "left")
        return joined.orderBy("relative_path", "attempt_no").withColumn("ok", F.col("ok").cast("int")).select(*REPORT_COLUMNS)

    def write_json_report(self, path: str, run_id: int | None = None) -> dict:
        told = self.summary(run_id)
        self.files.write(path, json.dumps(told, indent=2, ensure_ascii=False))
        return told


def output_rows(run_id: int, won: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rows of outputs: what an artifact states goes before what its attempt states; failures have the error alone."""
    own = artifacts.select("doc_id", "output_type", "output_path", "artifact_sha256", "raw_candidate_path", *[F.col(c).alias(f"own_{c}") for c in ("width", "height", "duration_ms", "frame_count")])
    joined = won.join(own, "doc_id", "left")
    prefer = {c: F.coalesce(F.when(F.col("output_type").isNotNull(), F.col(f"own_{c}")), F.col(c)) for c in ("width", "height", "duration_ms", "frame_count")}
    return joined.withColumns(prefer).select(
        F.lit(run_id).cast("long").alias("run_id"), "doc_id", "attempt_id", "strategy_id", "decoder", "output_type", "output_path", "artifact_sha256", "raw_candidate_path",
        *prefer, "score", F.col("ok").cast("int").alias("success"), "error",
    )


def write_attempts_csv(rows: DataFrame, folder: str) -> None:
    """The attempt report with a header; columns that rows lack are empty."""
    own = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REPORT_COLUMNS])
    own.write.mode("overwrite").option("header", "true").csv(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def write_blobs(blobs: DataFrame, folder: str, suffix: Column | None = None) -> None:
    """Contents by their SHA-256, partitioned by its first two digits; contents that are there already stay as they are."""
    spark = blobs.sparkSession
    named = blobs.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    named = named.select("sha256", "content", (suffix if suffix is not None else F.lit(".bin")).alias("suffix"), F.substring("sha256", 1, 2).alias("shard"))
    if Files(spark).exists(folder):
        named = named.join(spark.read.parquet(folder).select("sha256"), "sha256", "left_anti")
    named.write.mode("append").partitionBy("shard").parquet(folder)
