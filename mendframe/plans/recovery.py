"""Runs from files to reports: scan, classify, recover, benchmark and report, with every table in the store.

A run reads its files once a step; classes, plans and attempts stay DataFrames. Steps that later ones read again are
written to the store's tables first, so lost executors cost one step at most.
"""
from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendframe.operators import classify, probing, scoring
from mendframe.plans.store import Store, Workspace, output_rows, write_attempts_csv, write_blobs
from mendframe.sources import corpus

DEFAULT_ENGINE = "baseline-v2"

def relative(path: str, root: str):
    """The part of a path column behind the input root."""
    return F.regexp_replace(F.col(path), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:/*)?/?" + _quoted(_bare(root)) + "/?", "")


def _bare(path: str) -> str:
    head, mark, rest = path.partition(":")
    return (rest if mark and head.isalpha() else path).strip("/")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.*+?^$|/" else c for c in text)


class Run:
    """One run over an input folder."""

    def __init__(self, spark: SparkSession, store: str, input_root: str, command: str, engine: str = DEFAULT_ENGINE, recursive: bool = False, all_files: bool = False,
                 output_root: str | None = None, workspace_root: str | None = None, most_external: int = scoring.FALLBACK, save_raw_candidates: bool = False) -> None:
        self.spark, self.store, self.families = spark, Store(spark, store), scoring.families_of(engine)
        self.input_root, self.output_root, self.most_external, self.keep_raw = input_root, output_root, most_external, save_raw_candidates
        self.workspace = Workspace.beside(store, output_root, workspace_root)
        self.recursive, self.all_files = recursive, all_files
        config = {"recursive": recursive, "all_files": all_files, "engine": engine, "save_raw_candidates": save_raw_candidates}
        self.run_id = self.store.start_run(command, engine, config, input_root, output_root, self.workspace.root)
        self.store.files.write(self.workspace.config_path(self.run_id), json.dumps(config, indent=2, ensure_ascii=False))

    def _tagged(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("run_id", F.lit(self.run_id).cast("long"))

    def classified(self) -> DataFrame:
        """Classes of the input's files with their bytes."""
        return classify.classified(corpus.files(self.spark, self.input_root, self.recursive, self.all_files, complete=True))

    def scan(self) -> None:
        """Writes files and signatures."""
        rows = classify.evidence(self.classified()).withColumn("relative_path", relative("path", self.input_root))
        files = rows.select("doc_id", "path", "relative_path", "size", "sha256", "declared_kind", "byte0_kind", "anywhere_kind", "family", "label", "confidence", "jpeg_evidence", F.to_json("evidence").alias("evidence_json"))
        self.store.append("files", self._tagged(files))
        hits = rows.select("doc_id", F.posexplode("hits").alias("hit_no", "h")).select("doc_id", "hit_no", "h.family", "h.signature_type", "h.offset", (-F.col("h.rank")).alias("confidence"))
        self.store.append("signatures", self._tagged(hits))

    def recover(self) -> None:
        """scan(), then attempts at every file of the engine's families, final attempts and outputs."""
        self.scan()
        rows = self.classified()
        own = rows.where(F.col("family").isin(self.families))
        tried = probing.attempts(own, self.most_external)
        numbered = W.partitionBy("doc_id").orderBy(F.col("phase") == "image_probe_ffmpeg", "ord")
        tried = tried.withColumn("attempt_no", F.row_number().over(numbered))
        keyed = tried.withColumns({"dedupe_key": F.sha2(F.concat_ws("|", "family", "strategy", "payload_sha256"), 256), "score": scoring.persisted_score(F.col("score"))})
        keyed = keyed.withColumn("attempt_id", F.xxhash64(F.lit(self.run_id), "doc_id", "phase", "ord"))
        self.store.append("attempts", self._tagged(keyed))
        done = self.store.of_run("attempts", self.run_id).drop("run_id")
        made = done.where("ord > 0").select("doc_id", "dedupe_key", "ord", "strategy", "family", "priority", "kind", "start", "end", "payload_sha256")
        self.store.append("candidates", self._tagged(made))
        best = scoring.winners(done)
        saved = probing.save(best, rows, self.keep_raw)
        blobs = self.store.path("artifacts")
        self._tagged(saved).write.mode("append").partitionBy("run_id").parquet(blobs)
        saved = self.store.of_run("artifacts", self.run_id).drop("run_id")
        final = self._final(best, saved)
        self.store.append("attempts", self._tagged(final.select(*done.columns)))
        self._outputs(final, saved)

    def _final(self, best: DataFrame, saved: DataFrame) -> DataFrame:
        """The attempt that writes each winner, scored anew by what was written."""
        first = saved.groupBy("doc_id").agg(F.min_by(F.struct("ok", "width", "height", "mode", "decoded_format", "entropy", "error", "decoder", "telemetry"), F.struct(~F.col("ok"), "output_type")).alias("w"))
        names = ("ok", "mode", "decoded_format", "entropy", "error", "decoder", "telemetry")
        sizes = {c: F.when(F.col(f"w.{c}") > 0, F.col(f"w.{c}")).otherwise(F.col(c)) for c in ("width", "height")}
        joined = scoring.final_attempts(best).join(first, "doc_id").withColumns({c: F.col(f"w.{c}") for c in names} | sizes).drop("w")
        scored = joined.withColumn("score", scoring.persisted_score(scoring.score()))
        return scored.withColumns({"attempt_no": F.lit(1 << 30), "attempt_id": F.xxhash64(F.lit(self.run_id), "doc_id", "phase", "ord")})

    def _outputs(self, final: DataFrame, saved: DataFrame) -> None:
        files = self.store.of_run("files", self.run_id)
        root = (self.output_root or self.workspace.folder("outputs")).rstrip("/")
        target = F.concat(F.lit(root + "/"), scoring.output_path(F.col("relative_path"), F.col("family")))
        paths = files.select("doc_id", target.alias("output_path"), F.concat(F.lit(root + "/_raw_candidates/"), "relative_path", F.lit(".candidate")).alias("raw_path"), "family")
        ours = files.select("doc_id").join(final.select("doc_id", "attempt_id", F.col("strategy").alias("strategy_id"), "decoder", "width", "height", "duration_ms", "frame_count", "score", "ok", "error"), "doc_id", "left")
        gate = F.when(~F.col("family").isin(self.families), F.concat(F.lit("no_engine_for_family:"), "family"))
        broken = self.store.of_run("attempts", self.run_id).where("phase = 'error'").select("doc_id", F.col("error").alias("broke"))
        told = ours.join(files.select("doc_id", "family"), "doc_id").join(broken, "doc_id", "left").withColumns({
            "error": F.coalesce(gate, "broke", F.when(F.col("ok").isNull(), scoring.NO_WINNER), "error"), "ok": F.coalesce("ok", F.lit(False)), "decoder": F.coalesce("decoder", F.lit("none")),
        })
        # several artifacts of one file are told apart by their type and digest
        split = F.when(F.col("output_type").isin("preview_frame", "frame_set"), F.concat("output_path", F.lit("."), "output_type", F.lit("-"), F.substring("artifact_sha256", 1, 12), F.lit(".png"))).otherwise(F.col("output_path"))
        kept = saved.where("ok").join(paths, "doc_id").withColumns({"output_path": split, "raw_candidate_path": F.when(F.col("raw_candidate").isNotNull(), F.col("raw_path")), "duration_ms": F.lit(0), "frame_count": F.lit(0)})
        self.store.append("outputs", output_rows(self.run_id, told, kept))
        write_blobs(kept.select(F.col("artifact").alias("content")), self.workspace.folder("blobs"))

    def artifacts(self) -> DataFrame:
        """output_path and content of everything that the run made, raw candidates included."""
        saved = self.store.of_run("artifacts", self.run_id).where("ok")
        paths = self.store.of_run("outputs", self.run_id).where("success = 1").select("doc_id", "output_path", "artifact_sha256", "raw_candidate_path")
        made = saved.select("doc_id", "artifact_sha256", "artifact", "raw_candidate").join(paths, ["doc_id", "artifact_sha256"])
        raw = made.where("raw_candidate_path is not null").select(F.col("raw_candidate_path").alias("output_path"), F.col("raw_candidate").alias("content")).dropDuplicates(["output_path"])
        return made.select("output_path", F.col("artifact").alias("content")).unionByName(raw)


def export(artifacts: DataFrame, write: Callable[[str, bytes], None] | None = None) -> None:
    """Writes each artifact (output_path, content) as a file, from the executors; without a writer, to a mounted file system."""

    def local(path: str, content: bytes) -> None:
        path = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".part", "wb") as f:
            f.write(content)
        os.replace(path + ".part", path)  # a task that runs twice writes the same file

    put = write or local
    artifacts.foreachPartition(lambda rows: [put(r["output_path"], bytes(r["content"])) for r in rows] and None)


def summary(spark: SparkSession, store: str, run_id: int | None = None, json_path: str | None = None, csv_folder: str | None = None) -> dict:
    """A run's summary; the summary document and the attempt report where they are wanted."""
    own = Store(spark, store)
    if own.latest_run() is None:
        raise SystemExit("No runs found.")
    told = own.write_json_report(json_path, run_id) if json_path else own.summary(run_id)
    if csv_folder:
        write_attempts_csv(own.attempt_rows(run_id), csv_folder)
    return told
