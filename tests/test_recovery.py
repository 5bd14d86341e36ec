"""Pictures that are read, recovered, saved and reported, from a folder to the store."""
import csv
import io
import json
import os
import stat

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe import cli
from mendframe.functions import pictures
from mendframe.operators import external, legacy, probing, scoring
from mendframe.plans import older, recovery
from mendframe.plans.store import Store, Workspace, write_blobs
from tests.test_engine import decodes, picture, segments_of

RNG = np.random.default_rng(7)


def jvm_file(spark, kind, size=24):
    """A picture in a kind of file, made by the JVM."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(size, size, 5)
    for i in range(size * size):
        image.setRGB(i % size, i // size, (i * 2654435761) & 0xFFFFFF)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


def test_readers_agree_with_the_jvm(spark):
    for kind in ("png", "gif", "bmp", "jpg"):
        data = jvm_file(spark, kind)
        found = pictures.read(data)
        assert (found.width, found.height) == decodes(spark, data) == (24, 24) and found.decoded_format.lower()[:2] == kind[:2]
        image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data)))
        want = np.array([[(image.getRGB(x, y) >> s) & 255 for s in (16, 8, 0)] for y in range(24) for x in range(24)])
        apart = np.abs(found.pixels[:, :, :3].reshape(-1, 3).astype(int) - want)
        assert apart.max() == 0 if kind != "jpg" else apart.mean() < 16  # the JVM spreads colours more smoothly


def test_written_jpegs_and_tiffs(spark):
    y, x = np.mgrid[0:37, 0:53]
    smooth = np.stack([(x * 4) % 256, (y * 5) % 256, ((x + y) * 2) % 256], axis=2).astype(np.uint8)
    for pixels in (smooth, smooth[:, :, :1], RNG.integers(0, 256, (9, 17, 4)).astype(np.uint8)):
        data = pictures.write_jpeg(pixels)
        found = pictures.read(data)
        assert decodes(spark, data) == (pixels.shape[1], pixels.shape[0]) == (found.width, found.height)
        assert np.abs(found.pixels.astype(int) - pixels[:, :, : found.pixels.shape[2]]).mean() < 4
        image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data)))
        if found.mode == "RGB":
            want = np.array([[(image.getRGB(c, r) >> s) & 255 for s in (16, 8, 0)] for r in range(found.height) for c in range(found.width)])
            assert np.abs(found.pixels.reshape(-1, 3).astype(int) - want).max() <= 3  # without subsampling both read the same
    for channels in (1, 3, 4):
        pixels = RNG.integers(0, 256, (9, 13, channels)).astype(np.uint8)
        assert (pictures.read(pictures.write_tiff(pixels)).pixels == pixels).all() and decodes(spark, pictures.write_tiff(pixels)) == (13, 9)


def test_jpeg_block_means(spark):
    """A picture of flat blocks reads as the blocks' grey values."""
    jvm, levels = spark._jvm, [20, 60, 128, 200, 250, 90, 10, 170, 230]
    image = jvm.java.awt.image.BufferedImage(24, 24, 10)  # grey
    for y in range(24):
        for x in range(24):
            v = levels[(y // 8) * 3 + x // 8]
            image.getRaster().setSample(x, y, 0, v)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    found = pictures.read(bytes(out.toByteArray()))
    means = found.grey.reshape(3, 8, 3, 8).mean(axis=(1, 3)).ravel()
    assert found.mode == "L" and max(abs(a - b) for a, b in zip(means, levels, strict=True)) <= 3
    assert abs(found.entropy - np.log2(9)) < 1e-9


def test_writers_and_broken_files():
    for channels in (1, 2, 3, 4):
        pixels = RNG.integers(0, 256, (9, 13, channels)).astype(np.uint8)
        assert (pictures.read(pictures.write_png(pixels)).pixels == pixels).all()
    rgb = RNG.integers(0, 256, (9, 13, 3)).astype(np.uint8)
    assert (pictures.read(pictures.write_bmp(rgb)).pixels == rgb).all()
    whole = pictures.write_png(rgb)
    assert pictures.read(whole[:-20]).width == 13  # what is there counts
    for data in (b"", b"\xff\xd8", b"\xff\xd8\xff\xdb", whole[:30], b"GIF89a", b"BM", b"II*\0", whole[:40] + b"x" + whole[41:], b"GIF89a\5\0\5\0\x80\0\0", bytes(50)):
        with pytest.raises(pictures.Broken):
            pictures.read(data)
    for _ in range(300):  # no damage ends in another error
        at, damaged = int(RNG.integers(len(whole))), bytearray(whole)
        damaged[at] = int(RNG.integers(256))
        probing.image_probe(bytes(damaged))


def test_damaged_jpegs_end_in_no_other_error(spark):
    data = picture(spark)
    for _ in range(300):
        damaged = bytearray(data)
        damaged[int(RNG.integers(2, len(data)))] = int(RNG.integers(256))
        assert set(probing.image_probe(bytes(damaged[: int(RNG.integers(2, len(data) + 1))]))) == set(probing.NO_PROBE)


def damaged_folder(spark, folder):
    data = picture(spark)
    tables, sos = segments_of(data, "FFC4"), data.index(b"\xff\xda")
    head = b"".join(s for m in ("FFE0", "FFDB", "FFC0", "FFC4") for _, s in segments_of(data, m))
    files = {
        "no_end.jpg": data[:-2], "no_start.jpg": data[2:], "no_tables.jpg": data[: tables[0][0]] + data[tables[-1][0] + len(tables[-1][1]) :],
        "scattered.jpg": data[sos:] + b"JUNK" + head, "no_scan.jpg": data[2:sos] + data[sos + 2 + int.from_bytes(data[sos + 2 : sos + 4], "big") :],
        "sub/whole.png": jvm_file(spark, "png"), "shifted.bmp": b"xx" + jvm_file(spark, "bmp"), "movie.mp4": b"\0\0\0\x14ftypisom" + bytes(64), "empty.jpg": b"", "notes.txt": b"nothing",
    }
    for name, body in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return files


def test_recovers_a_folder(spark, tmp_path, capsys):
    damaged_folder(spark, tmp_path / "in")
    store, out = f"file://{tmp_path}/runs.store", f"file://{tmp_path}/out"
    args = ["benchmark", f"file://{tmp_path}/in", out, "--db", store, "--recursive", "--save-raw-candidates", "--output-json", f"file://{tmp_path}/report.json", "--output-csv", f"file://{tmp_path}/report.csv"]
    assert cli.main(args, spark) == 0
    told = json.loads(capsys.readouterr().out)
    saved = json.loads((tmp_path / "report.json").read_text())
    assert told == saved and told["total_files"] == 9 and told["command"] == "benchmark" and told["recovered"] == 7 and told["failed"] == 2
    rows = {r["relative_path"]: r for r in Store(spark, store).of_run("outputs").join(Store(spark, store).of_run("files").select("doc_id", "relative_path", "label"), "doc_id").collect()}
    for name in ("no_end.jpg", "no_start.jpg", "no_tables.jpg", "scattered.jpg", "no_scan.jpg"):
        assert rows[name]["success"] == 1 and decodes(spark, (tmp_path / "out" / name).read_bytes()) == (48, 48), name
        assert (tmp_path / "out" / "_raw_candidates" / f"{name}.candidate").exists()
    assert "rebuild_header" in rows["scattered.jpg"]["strategy_id"] and "synthetic_sos" in rows["no_scan.jpg"]["strategy_id"] and rows["no_tables.jpg"]["label"] == "jpeg_missing_dht"
    assert decodes(spark, (tmp_path / "out/sub/whole.png").read_bytes()) == decodes(spark, (tmp_path / "out/shifted.bmp").read_bytes()) == (24, 24)
    assert rows["movie.mp4"]["error"] == rows["empty.jpg"]["error"] == scoring.NO_WINNER and told["top_errors"] == {scoring.NO_WINNER: 2} and told["by_output_type"] == {"image": 7}
    attempts = Store(spark, store).of_run("attempts")
    assert attempts.where("phase = 'video_probe' and error = 'ffmpeg_or_ffprobe_not_found'").count() > 0
    finals = attempts.where(F.col("phase").endswith("_final"))
    assert finals.count() == 7 and finals.select("attempt_id").distinct().count() == 7
    assert {r["attempt_id"] for r in finals.collect()} == {r["attempt_id"] for r in rows.values() if r["success"]}
    lines = [r for p in sorted((tmp_path / "report.csv").glob("*.csv")) for r in csv.DictReader(io.StringIO(p.read_text()))]
    assert len(lines) == attempts.count() and lines[0].keys() >= {"relative_path", "strategy_id", "mode", "decoded_format"} and [r["relative_path"] for r in lines] == sorted(r["relative_path"] for r in lines)
    config = json.loads((tmp_path / "out/.uncorrupter-workspace/configs/run-000001.json").read_text())
    assert config == {"recursive": True, "all_files": False, "engine": "baseline-v2", "save_raw_candidates": True}
    assert cli.main(["report", "--db", store], spark) == 0 and json.loads(capsys.readouterr().out)["run_id"] == 1
    assert cli.main(["scan", f"file://{tmp_path}/in", "--db", store, "--engine", "jpeg-v1"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["run_id"] == 2 and told["recovered"] == 0 and told["total_files"] == 8 and told["by_decoder"] == {}
    with pytest.raises(ValueError, match="Unknown engine"):
        cli.main(["scan", f"file://{tmp_path}/in", "--db", store, "--engine", "other"], spark)
    with pytest.raises(SystemExit):
        cli.main(["report", "--db", f"file://{tmp_path}/none"], spark)


def test_engine_gate_and_broken_blobs(spark, tmp_path, monkeypatch):
    damaged_folder(spark, tmp_path / "in")
    run = recovery.Run(spark, f"file://{tmp_path}/store", f"file://{tmp_path}/in", "recover", "jpeg-v1", all_files=True, output_root=f"file://{tmp_path}/out")
    run.recover()
    errors = {r["relative_path"]: r["error"] for r in run.store.of_run("outputs").join(run.store.of_run("files").select("doc_id", "relative_path"), "doc_id").collect()}
    assert errors["movie.mp4"] == "no_engine_for_family:mp4" and errors["notes.txt"] == "no_engine_for_family:unknown" and errors["no_end.jpg"] == ""
    rows = [(1, "jpeg", "jpeg_low_signal", None, None), (2, "png", "x", bytearray(b"x"), [("png", None)]), (3, "png", "x", bytearray(b"x"), [("png", 0)])]
    table = spark.createDataFrame(rows, "doc_id long, family string, label string, content binary, hits array<struct<family:string,offset:int>>")
    tried = probing.attempts(table).collect()  # the second one's hit has no place
    assert {r["doc_id"] for r in tried} == {1, 2, 3} and [r["doc_id"] for r in tried if r["error"].startswith(probing.RUN_FAILED)] == [2]


def test_workspace_and_blobs(spark, tmp_path):
    assert Workspace.beside("file:/a/b/runs.store", "file:/out").root == "file:/out/.uncorrupter-workspace"
    assert Workspace.beside("file:/a/b/runs.store").root == "file:/a/b/.uncorrupter-workspace" and Workspace.beside("x", None, "file:/w").config_path(7) == "file:/w/configs/run-000007.json"
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    for _ in range(2):
        write_blobs(blobs, f"file://{tmp_path}/blobs")
    assert spark.read.parquet(f"file://{tmp_path}/blobs").count() == 2
    store = Store(spark, f"file://{tmp_path}/store")
    store.files.claim(f"{store.root}/_claims/run-000001")  # another writer has taken it
    assert store.start_run("scan", "jpeg-v1") == 2 and store.latest_run() == 2
    store.append("signatures", spark.createDataFrame([(2, 1, "png")], "run_id long, doc_id long, family string"))
    store.append("signatures", spark.createDataFrame([(2, 2, "gif", 0.5)], "run_id long, doc_id long, family string, confidence double"))  # a column more
    assert {(r["doc_id"], r["confidence"]) for r in store.of_run("signatures").collect()} == {(1, None), (2, 0.5)}
    with pytest.raises(ValueError, match="Run 0 not found"):
        store.of_run("signatures", 0)


FAKE = """#!/usr/bin/env python3
import sys, shutil
if "ffprobe" in sys.argv[0]:
    print('{"streams": [{"codec_type": "video", "width": 64, "height": 48, "nb_frames": "25"}, {"codec_type": "audio"}], "format": {"format_name": "mp4", "duration": "1.5"}}')
elif b"good" in open(sys.argv[sys.argv.index("-i") + 1], "rb").read():
    shutil.copy(%r, sys.argv[-1])
else:
    print("line one\\n\\nline two", file=sys.stderr)
    sys.exit(1)
"""


def test_external_programs(tmp_path, monkeypatch):
    frame = tmp_path / "frame.png"
    frame.write_bytes(pictures.write_png(RNG.integers(0, 256, (6, 8, 3)).astype(np.uint8)))
    assert external.video_probe(b"good", "mp4") == {"error": "ffmpeg_or_ffprobe_not_found"} and external.image_probe(b"good", "png") == {"error": "ffmpeg_not_found"}
    for name in ("ffmpeg", "ffprobe"):
        (tmp_path / name).write_text(FAKE % str(frame))
        (tmp_path / name).chmod((tmp_path / name).stat().st_mode | stat.S_IEXEC)
    monkeypatch.setenv("PATH", f"{tmp_path}{os.pathsep}{os.environ['PATH']}")
    external.program.cache_clear()
    try:
        found = external.video_probe(b"good", "mp4")
        assert (found["ok"], found["width"], found["height"], found["frame_count"], found["duration_ms"], found["decoded_format"]) == (True, 64, 48, 25, 1500, "mp4")
        assert external.video_probe(b"bad", "mp4")["error"] == "line one | line two" and external.image_probe(b"good", "raw")["width"] == 8
        assert [a["output_type"] for a in external.video_artifacts(b"good", "mpegts")] == ["video", "preview_frame"]
        assert external.video_artifacts(b"bad", "mp4")[0]["error"] == "line one | line two" and external.saved_image(b"good", "raw", "bmp")["artifact"][:2] == b"BM"
        assert external.suffix("heif") == ".heic" and external.suffix("odd") == ".bin"
    finally:
        external.program.cache_clear()


def test_telemetry_as_columns(spark):
    reports = [
        '{"streams": [{"codec_type": "video", "width": 64, "height": 48, "nb_frames": "25"}, {"codec_type": "audio", "width": 9}, {"codec_type": "video", "width": 32, "height": 0, "nb_frames": "7.9"}], "format": {"format_name": "mp4", "duration": "1.5"}}',
        '{"streams": [], "format": {}}', "", "no json", '{"format": {"duration": "x"}}', '{"streams": [{"codec_type": "video", "nb_frames": "N/A"}]}',
    ]
    rows = spark.createDataFrame(list(enumerate(reports)), "i int, report string").withColumns(external.measured_columns(F.col("report"))).orderBy("i").collect()
    for r, text in zip(rows, reports, strict=True):
        want = external.measured(text)
        assert {k: r[k] for k in want} == want, text


def test_the_older_engine(spark, tmp_path, capsys):
    damaged_folder(spark, tmp_path / "in")
    (tmp_path / "in/bare").write_bytes(jvm_file(spark, "gif"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/empty.jpg").write_bytes(b"there")
    names = {n: f"file://{tmp_path}/{n}" for n in ("report.csv", "summary.json", "detail.jsonl")}
    args = ["older", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "--recursive", "--all-files", "--attempt-log-limit", "3", "--report-csv", names["report.csv"], "--summary-json", names["summary.json"], "--detail-jsonl", names["detail.jsonl"]]
    assert cli.main(args, spark) == 0
    rows = {r["path"].split("/in/")[1]: r for p in (tmp_path / "report.csv").glob("*.csv") for r in csv.DictReader(io.StringIO(p.read_text()))}
    assert list(next(iter(rows.values()))) == older.ROW and len(rows) == 11
    assert rows["empty.jpg"]["error"] == "output_exists" and (tmp_path / "out/empty.jpg").read_bytes() == b"there"
    assert rows["no_start.jpg"]["success"] == "1" and rows["no_start.jpg"]["decoder"] == "pillow" and decodes(spark, (tmp_path / "out/no_start.jpg").read_bytes()) == (48, 48)
    assert rows["bare"]["selection_policy"] == "header_used_no_extension" and rows["bare"]["selected_kinds"] == "gif" and (tmp_path / "out/bare.png").exists()
    assert rows["shifted.bmp"]["success"] == "1" and rows["notes.txt"]["error"] == "no_candidate_succeeded" and rows["notes.txt"]["selection_policy"] == "no_extension_no_header_try_all"
    details = {d["path"].split("/in/")[1]: d for p in (tmp_path / "detail.jsonl").glob("*.json") for d in map(json.loads, p.read_text().splitlines())}
    assert max(sum(a["pass"] == k for a in d["attempts"]) for d in details.values() for k in (older.FIRST, older.SECOND)) <= 3
    assert details["empty.jpg"]["next_ideas"] == [legacy.IDEA_TEXTS["exists"]] and details["no_start.jpg"]["next_ideas"] == [] and legacy.IDEA_TEXTS["fallback"] in details["no_scan.jpg"]["next_ideas"]
    assert details["no_end.jpg"]["marker_stats_by_kind"]["jpeg"]["soi_count"] == 1 and details["whole.png" if "whole.png" in details else "sub/whole.png"]["anywhere_signature_hit_counts"]["png"] == 1
    told = json.loads((tmp_path / "summary.json").read_text())
    assert told["total"] == 11 and told["recovered"] + told["failed"] == 11 and set(older.GROUPINGS) < set(told) and told["top_errors"]["output_exists"] == 1
    assert told["by_declared_kind"]["jpeg"] == 6 and told["recommendations"][-1] == legacy.ADVICE_TEXTS["always"]
    assert older.Options(most_per_kind=0).second_pass().most_per_kind == 12 and older.Options(most_per_kind=300).second_pass().most_per_kind == 24
