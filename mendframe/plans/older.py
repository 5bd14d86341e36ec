"""A run of the older engine: six kinds of pictures, by extension first, with a row and a detail document for each file.

All plans of a file's kinds are read in one pass over its bytes, kind after kind, as the budget for external programs
depends on what earlier kinds have found. Files without a picture are tried again as the remaining kinds.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendframe.functions import kinds as K
from mendframe.functions import pictures
from mendframe.operators import candidates, external, legacy, probing, signatures
from mendframe.plans import recovery, report
from mendframe.plans.evidence import written
from mendframe.plans.store import Files
from mendframe.sources import corpus

# fixed values: the header of the report, the limits of the second pass, and names of passes
ROW = ["path", "size", "declared_kind", "byte0_kind", "selection_policy", "selected_kinds", "success", "decoder", "strategy", "width", "height", "mode", "output_path", "error"]
GROUPINGS = {"by_declared_kind": "declared_kind", "by_byte0_kind": "byte0_kind", "by_selection_policy": "selection_policy", "by_strategy": "strategy", "by_decoder": "decoder"}
FIRST, SECOND = "primary", "fallback_all_kinds"
THEN = "_then_fallback_all_kinds"
ATTEMPT = pa.schema([
    ("doc_id", pa.int64()), ("nth", pa.int32()), ("decoder", pa.string()), ("kind", pa.string()), ("strategy", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("prepend_len", pa.int32()), ("append_len", pa.int32()), ("ok", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("decoded_format", pa.string()),
    ("error", pa.string()), ("payload_sha256", pa.string()),
])
SAVED = pa.schema([("doc_id", pa.int64()), ("saved", pa.bool_()), ("saved_width", pa.int32()), ("saved_height", pa.int32()), ("saved_mode", pa.string()), ("saved_by", pa.string()), ("save_error", pa.string()), ("content", pa.binary())])


@dataclass(frozen=True)
class Options:
    recursive: bool = False
    overwrite: bool = False
    all_files: bool = False
    external: bool = True
    most_per_kind: int = 80
    most_external: int = 8
    log_limit: int = 0

    def second_pass(self) -> Options:
        per_kind = max(8, min(24, self.most_per_kind // 3 if self.most_per_kind > 0 else 12))
        return Options(self.recursive, self.overwrite, self.all_files, self.external, per_kind, min(4, self.most_external), self.log_limit)


def output_path(relative: Column, declared: Column) -> Column:
    """The same path; files of no known kind and without any extension get one."""
    bare = declared.isNull() & ~relative.rlike(r"[^/]\.[^./]+$")
    return F.when(bare, F.concat(relative, F.lit(".png"))).otherwise(relative)


def attempts(rows: DataFrame, kinds: str, options: Options) -> DataFrame:
    """Attempts at rows (doc_id, content) as the kinds in a column, in order."""
    columns = ["doc_id", "content", F.col(kinds).alias("todo")]

    def one(row: dict) -> Iterator[dict]:
        content, nth, won = row["content"] or b"", 0, False
        for kind in row["todo"]:
            made = candidates.older_order(candidates.LEGACY[kind](candidates.Scan(content), options.most_per_kind))
            rounds = [(probing.READER, made, probing.image_probe)]
            if options.external and external.available():
                rounds.append((external.IMAGE, made[: options.most_external], lambda data, k=kind: probing.NO_PROBE | external.image_probe(data, k)))
            for decoder, plans, probe in rounds:
                if decoder == external.IMAGE and won:
                    continue
                for p in plans:
                    data = p.payload(content)
                    found = probe(data)
                    nth, won = nth + 1, won or found["ok"]
                    head = {"doc_id": row["doc_id"], "nth": nth, "decoder": decoder, "kind": kind, "strategy": p.strategy, "start": p.start, "end": p.end, "prepend_len": len(p.prepend) // 2, "append_len": len(p.append) // 2}
                    yield head | {k: found[k] for k in ("ok", "width", "height", "mode", "decoded_format", "error")} | {"payload_sha256": hashlib.sha256(data).hexdigest()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    out = list(one(row))
                except Exception as error:  # noqa: BLE001  a file that can't be worked on is a row of the report
                    out = [{"doc_id": row["doc_id"], "nth": 0, "ok": False, "decoder": "none", "error": probing.RUN_FAILED + probing.compact(error)}]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=ATTEMPT)

    return rows.select(*columns).mapInArrow(run, probing.ddl(ATTEMPT))


def best(tried: DataFrame) -> DataFrame:
    """The largest picture of each file, the first on ties."""
    order = W.partitionBy("doc_id").orderBy((F.col("width").cast("long") * F.col("height")).desc(), "nth")
    return tried.where("ok").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def saves(won: DataFrame, rows: DataFrame) -> DataFrame:
    """Files made of winners: their bytes in the kind that the file declares, else in the first kind that was tried."""
    plans = rows.select("doc_id", "content", F.coalesce("declared", F.get("kinds", 0), F.lit("png")).alias("output_kind")).join(won, "doc_id")
    hexes = {"prepend": {8: K.PNG, 2: K.SOI}, "append": {2: K.EOI}}

    def one(row: dict) -> dict:
        before, after = (bytes.fromhex(hexes[side].get(row[f"{side}_len"], "")) for side in ("prepend", "append"))
        data = before + row["content"][row["start"] : row["end"]] + after
        base = {"doc_id": row["doc_id"], "saved": False, "saved_by": probing.READER}
        if hashlib.sha256(data).hexdigest() != row["payload_sha256"]:
            return base | {"save_error": probing.RUN_FAILED + "the file has changed"}
        try:
            found, body = probing.saved(data, row["output_kind"])
        except pictures.Broken as error:
            made = external.saved_image(data, row["kind"], row["output_kind"]) if external.available() else {"error": probing.compact(error)}
            if not made.get("ok"):
                return base | {"save_error": made["error"] or "save_failed"}
            return base | {"saved": True, "saved_by": made["decoder"], "saved_width": made["width"], "saved_height": made["height"], "saved_mode": made["mode"], "content": made["artifact"]}
        return base | {"saved": True, "saved_width": found.width, "saved_height": found.height, "saved_mode": probing.saved_mode(found.mode, row["output_kind"]), "content": body}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in batch.to_pylist()], schema=SAVED)

    return plans.mapInArrow(run, probing.ddl(SAVED))


SAVE_IDEAS = [  # fixed values
    "Decode succeeded at probe time but save failed.", "Inspect output mode conversion rules for this declared format.", "Consider temporarily saving recovered output as PNG for this format family.",
]


def recovered(blobs: DataFrame, relative: Column, existing: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Report rows (with doc_id and marker counts), details and saved files of blobs (doc_id, path, content).

    existing: relative output paths that are there already.
    """
    spark = blobs.sparkSession
    base = legacy.chosen(blobs).withColumn("output_path", output_path(relative, corpus.declared_kind(F.col("path"))))
    there = existing.select(F.col("output_path").alias("there_path")).distinct()
    base = base.join(there, F.col("output_path") == F.col("there_path"), "left").withColumn("exists", F.col("there_path").isNotNull() & F.lit(not options.overwrite)).drop("there_path")
    todo = base.where("not exists")
    kept = lambda df, name: written(spark, df, f"older-{name}")
    first = kept(attempts(todo.select("doc_id", "content", "kinds"), "kinds", options).withColumn("pass", F.lit(FIRST)), "first")
    won = best(first)
    open_rows = todo.where(F.size("other_kinds") > 0).join(won.select("doc_id"), "doc_id", "left_anti")
    second = kept(attempts(open_rows.select("doc_id", "content", "other_kinds"), "other_kinds", options.second_pass()).withColumn("pass", F.lit(SECOND)), "second")
    tried = first.unionByName(second)
    won = kept(won.unionByName(best(second)), "won")
    saved = kept(saves(won, base), "saved")
    broke = tried.where("nth = 0").groupBy("doc_id").agg(F.min("error").alias("broke"))
    numbers = tried.where("nth > 0").groupBy("doc_id").agg(F.count("*").alias("attempts"), F.max(F.col("pass") == SECOND).alias("went_on"))
    told = (
        signatures.with_counts(signatures.with_jpeg_counts(base), signatures.OTHER_COUNTS | signatures.LEGACY_COUNTS).drop("content")
        .join(won.select("doc_id", "strategy", "kind", "start", "end", "prepend_len", "append_len", "pass"), "doc_id", "left").join(saved.drop("content"), "doc_id", "left")
        .join(broke, "doc_id", "left").join(numbers, "doc_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    )
    ok = F.coalesce(F.col("saved"), F.lit(False))
    late = F.coalesce(F.col("pass") == SECOND, F.lit(False))
    text = lambda c: F.coalesce(F.when(ok, F.col(c).cast("string")), F.lit(""))
    rows = told.withColumns({
        "declared_kind": F.coalesce("declared", F.lit("none")), "byte0_kind": F.col("byte0"), "selection_policy": F.when(late, F.concat("policy", F.lit(THEN))).otherwise(F.col("policy")),
        "selected_kinds": F.array_join(F.when(late, F.concat("kinds", "other_kinds")).otherwise(F.col("kinds")), ","), "success": ok.cast("int"),
        "decoder": text("saved_by"), "strategy": text("strategy"), "width": text("saved_width"), "height": text("saved_height"), "mode": text("saved_mode"),
        "error": F.when(F.col("exists"), "output_exists").when(ok, "").otherwise(F.coalesce("broke", "save_error", F.lit("no_candidate_succeeded"))),
        "fallback_kinds": F.array_join("other_kinds", ","),
    })
    rows = kept(rows.withColumn("kinds", F.array_join("kinds", ",")), "rows")
    return rows, details(rows, tried, options), saved.where("saved").select("doc_id", "content").join(rows.select("doc_id", "output_path"), "doc_id").select("output_path", "content")


def details(rows: DataFrame, tried: DataFrame, options: Options) -> DataFrame:
    """One document a file: counts of markers and signatures by kind, attempts of both passes, and what to try next."""
    log = [c for c in ATTEMPT.names if c not in ("doc_id", "nth", "payload_sha256")] + ["pass"]
    logged = tried.where("nth > 0")
    logged = logged.where(F.col("nth") <= options.log_limit) if options.log_limit else logged
    own = logged.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((F.col("pass") == SECOND).alias("late"), "nth", F.struct(*log).alias("a")))).alias("log"))
    own = own.select("doc_id", F.transform("log", lambda x: x["a"]).alias("log"))
    ideas = legacy.next_ideas(rows.join(own.select("doc_id", F.size("log").alias("logged")), "doc_id", "left").withColumn("attempts", F.coalesce("logged", F.lit(0))))
    by_kind = {
        "jpeg": [c for c in signatures.jpeg_counts()], "png": ["png_sig_count", "ihdr_count", "idat_count", "iend_count"], "gif": ["gif_header_count", "gif_trailer_count", "gif_separator_count"],
        "bmp": ["bm_count"], "tiff": ["tiff_le_count", "tiff_be_count"], "webp": ["riff_count", "webp_count"],
    }
    save_failed = F.col("save_error").isNotNull() & (F.col("success") == 0)
    advice = F.when(save_failed, F.array(*[F.lit(t) for t in SAVE_IDEAS])).when(F.col("ideas").isNull(), F.array().cast("array<string>")).otherwise(F.split("ideas", legacy.SEPARATOR))
    joined = rows.join(own, "doc_id", "left").join(ideas, "doc_id", "left")
    return joined.select(
        "doc_id", "path", "size", "declared_kind", "byte0_kind", "selection_policy", F.split("selected_kinds", ",").alias("selected_kinds"), F.split("fallback_kinds", ",").alias("fallback_kinds"),
        F.struct(*[F.col(f"n_{k}").alias(k) for k in legacy.KINDS]).alias("anywhere_signature_hit_counts"), "output_path",
        F.struct(*[F.struct(*cs).alias(k) for k, cs in by_kind.items()]).alias("marker_stats_by_kind"), F.coalesce("log", F.array().cast(dict(own.dtypes)["log"])).alias("attempts"),
        F.when(F.col("success") == 1, F.struct("kind", "strategy", "start", "end", "prepend_len", "append_len")).alias("best_candidate"), advice.alias("next_ideas"),
    )


def count_by(rows: DataFrame, key: str, where: str | None = None) -> DataFrame:
    """key and n, most frequent first; missing and empty keys read `none`."""
    return report.by(rows.withColumn(key, F.nullif(F.col(key).cast("string"), F.lit(""))), key, where)


def summary(rows: DataFrame) -> dict:
    """Totals, five groupings, the most frequent errors and the recommendations."""
    totals = rows.agg(F.count("*").alias("total"), F.sum("success").alias("recovered")).first()
    counts = lambda found: {r["key"]: r["n"] for r in found.collect()}  # noqa: E731  a row a key
    out = {"total": totals["total"], "recovered": totals["recovered"] or 0, "failed": totals["total"] - (totals["recovered"] or 0)}
    out |= {name: counts(count_by(rows, key)) for name, key in GROUPINGS.items()}
    out["top_errors"] = counts(count_by(rows, "error", "success = 0").limit(legacy.MOST_ERRORS))
    out["recommendations"] = [r["advice"] for r in legacy.recommendations(rows).orderBy("place").collect()]
    return out


def existing_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Relative paths of the files under a folder; contents are not read."""
    if not Files(spark).exists(folder):
        return spark.createDataFrame([], "output_path string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.select(recovery.relative("path", folder).alias("output_path"))


def run(spark: SparkSession, input_root: str, output_root: str, options: Options, report_csv: str, summary_json: str, detail_jsonl: str) -> dict:
    """Recovers the pictures of a folder; writes files, the report (CSV), the details (JSON lines) and the summary."""
    blobs = corpus.files(spark, input_root, options.recursive, options.all_files, complete=True)
    rows, more, made = recovered(blobs, recovery.relative("path", input_root), existing_paths(spark, output_root), options)
    recovery.export(made.withColumn("output_path", F.concat(F.lit(output_root.rstrip("/") + "/"), "output_path")))
    rows.withColumn("success", F.col("success").cast("string")).select(*ROW).orderBy("path").write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(report_csv)
    more.drop("doc_id").orderBy("path").write.mode("overwrite").json(detail_jsonl)
    told = summary(rows)
    Files(spark).write(summary_json, json.dumps(told, indent=2, ensure_ascii=False))
    return told

