"""Command line: scan, classify, recover, benchmark and report. A file that can't be recovered is a line, not a failure."""
from __future__ import annotations

import argparse
import json
import sys

from mendframe.operators.scoring import FALLBACK
from mendframe.plans import recovery

OLDER = "older"


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="mendframe", description=__doc__)
    commands = own.add_subparsers(dest="command", required=True)
    for name in ("scan", "classify", "recover", "benchmark"):
        sub = commands.add_parser(name)
        sub.add_argument("input_root")
        if name in ("recover", "benchmark"):
            sub.add_argument("output_root")
            sub.add_argument("--save-raw-candidates", action="store_true")
        sub.add_argument("--recursive", action="store_true")
        sub.add_argument("--all-files", action="store_true")
        sub.add_argument("--db", default="runs.store", help="folder of the store")
        sub.add_argument("--workspace-root")
        sub.add_argument("--engine", default=recovery.DEFAULT_ENGINE)
        sub.add_argument("--max-ffmpeg-candidates", type=int, default=FALLBACK)
        if name == "benchmark":
            sub.add_argument("--output-json")
            sub.add_argument("--output-csv")
    sub = commands.add_parser("report")
    sub.add_argument("--db", default="runs.store")
    sub.add_argument("--run-id", type=int)
    sub.add_argument("--output-json")
    sub.add_argument("--output-csv")
    sub = commands.add_parser(OLDER, help="the older engine: six kinds of pictures")
    sub.add_argument("input_root")
    sub.add_argument("output_root")
    for flag in ("--recursive", "--overwrite", "--all-files", "--no-ffmpeg"):
        sub.add_argument(flag, action="store_true")
    sub.add_argument("--max-candidates-per-kind", type=int, default=80)
    sub.add_argument("--max-ffmpeg-candidates", type=int, default=8)
    sub.add_argument("--attempt-log-limit", type=int, default=0)
    sub.add_argument("--report-csv", default="recover_report.csv")
    sub.add_argument("--summary-json", default="recover_summary.json")
    sub.add_argument("--detail-jsonl", default="recover_detail.jsonl")
    return own


def main(arguments: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(arguments)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("mendframe").getOrCreate()
    if args.command == "report":
        print(json.dumps(recovery.summary(spark, args.db, args.run_id, args.output_json, args.output_csv), indent=2, ensure_ascii=False))
        return 0
    if args.command == OLDER:
        from mendframe.plans import older

        options = older.Options(args.recursive, args.overwrite, args.all_files, not args.no_ffmpeg, args.max_candidates_per_kind, args.max_ffmpeg_candidates, args.attempt_log_limit)
        older.run(spark, args.input_root, args.output_root, options, args.report_csv, args.summary_json, args.detail_jsonl)
        return 0
    full = args.command in ("recover", "benchmark")
    run = recovery.Run(
        spark, args.db, args.input_root, args.command, args.engine, args.recursive, args.all_files, args.output_root if full else None, args.workspace_root, args.max_ffmpeg_candidates, full and args.save_raw_candidates,
    )
    if full:
        run.recover()
        recovery.export(run.artifacts())
    else:
        run.scan()
    wanted = (args.output_json, args.output_csv) if args.command == "benchmark" else (None, None)
    print(json.dumps(recovery.summary(spark, args.db, run.run_id, *wanted), indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
