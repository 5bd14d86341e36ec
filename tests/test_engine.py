"""Scans, classes and candidates on small blobs."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from mendframe.functions import jpeg_tables as J
from mendframe.operators import candidates, classify, rebuild, scoring, signatures
from mendframe.plans import evidence, registry, store
from mendframe.plans.store import Store
from mendframe.sources import corpus
from mendframe.streaming import intake


def picture(spark, size=48):
    """A JPEG made by the JVM."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(size, size, 5)
    for i in range(0, size * size, 3):  # a pattern, so that there is coded data to find
        image.setRGB(i % size, i // size, (i * 2654435761) & 0xFFFFFF)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def decodes(spark, data):
    """Width and height as the JVM decodes them, or None."""
    jvm = spark._jvm
    try:
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    except Exception:
        return None
    return (image.getWidth(), image.getHeight()) if image is not None else None


def blobs(spark, **files):
    rows = [(i, name.replace("__", "."), bytearray(data)) for i, (name, data) in enumerate(files.items())]
    return spark.createDataFrame(rows, "doc_id long, path string, content binary")


def segments_of(data, marker):
    return [(at, s) for at, s in rebuild.walk(data).get(bytes.fromhex(marker), [])]


def labels(spark, **files):
    return {r["path"]: (r["family"], r["label"]) for r in classify.classified(blobs(spark, **files)).collect()}


def test_classes_of_damaged_pictures(spark):
    data = picture(spark)
    got = labels(spark, a__jpg=data[:-2], b__jpg=data[2:], c__jpg=b"".join([data[: segments_of(data, "FFC4")[0][0]], data[data.rindex(segments_of(data, "FFC4")[-1][1]) + len(segments_of(data, "FFC4")[-1][1]) :]]))
    assert got["a.jpg"] == ("jpeg", "jpeg_missing_eoi")
    assert got["b.jpg"] == ("jpeg", "jpeg_missing_soi_internal_structure")
    assert got["c.jpg"] == ("jpeg", "jpeg_missing_dht")


def test_prefixed_movie(spark):
    row = signatures.records(blobs(spark, broken__bin=b"GARBAGE" + (20).to_bytes(4, "big") + b"ftypisom" + bytes(32))).first()
    assert (row["byte0_kind"], row["anywhere_kind"], row["hits"][0]["offset"]) == ("unknown", "mp4", 7)
    assert row["hits"][0]["signature_type"] == "ftyp:isom"


def test_empty_and_null_blobs(spark):
    rows = spark.createDataFrame([(1, "x.jpg", bytearray(b"")), (2, "y", None)], "doc_id long, path string, content binary")
    got = {r["doc_id"]: r["label"] for r in classify.classified(rows).collect()}
    assert got[1] == "jpeg_low_signal" and got[2] == "unknown_low_signal"


def test_candidates_recover_a_picture_without_its_start(spark):
    data = picture(spark)
    assert decodes(spark, data) == (48, 48) and decodes(spark, data[2:]) is None
    rows = classify.classified(blobs(spark, a__jpg=data[2:]))
    plans = candidates.jpeg(rows, *candidates.JPEG_LANES).join(rows.select("doc_id", "content"), "doc_id")
    made = plans.select("strategy", candidates.payload(F.col("content")).alias("p")).collect()
    assert any(decodes(spark, r["p"]) == (48, 48) for r in made)


def test_rebuilt_headers_decode(spark):
    data = picture(spark)
    dht = segments_of(data, "FFC4")
    without = data
    for _, s in dht:
        without = without.replace(s, b"", 1)
    sos = data.index(b"\xff\xda")
    head = b"".join(s for m in ("FFE0", "FFDB", "FFC0", "FFC4") for _, s in segments_of(data, m))
    cases = {"insert": (without, "jpeg_missing_dht", "inject_standard_tables"), "scattered": (data[sos:] + b"JUNK" + head, "jpeg_missing_soi_internal_structure", "rebuild_header")}
    for data_in, label, prefix in cases.values():
        blob = rebuild.Blob(data_in, label)
        rows = list(blob.rows())
        assert any(decodes(spark, blob.payload(r[0])) == (48, 48) for r in rows if r[1].startswith(prefix))
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    no_scan = data[2:sos] + data[sos + 2 + int.from_bytes(data[sos + 2 : sos + 4], "big") :]
    blob = rebuild.Blob(no_scan, "jpeg_missing_soi_internal_structure")
    assert any("synthetic_sos" in r[1] and decodes(spark, blob.payload(r[0])) == (48, 48) for r in list(blob.rows()))


def every_jpeg_plan(data, label):
    """(strategy, priority, start, end) of all lanes by falling priority, strategy and order of generation."""
    soi, eoi = rebuild.sampled(rebuild.places(data, rebuild.SOI), 16), rebuild.places(data, rebuild.EOI)
    anchors = rebuild.sampled(rebuild.places(data, rebuild.ANCHOR), 32)
    made = [("full_file", 100, 0, None), ("prepend_soi_full", 98, 0, None), ("append_eoi_full", 97, 0, None), ("prepend_soi_append_eoi_full", 96, 0, None)]
    for p in soi:
        made += [("soi_to_sampled_eoi", 95, p, e + 2) for e in rebuild.sampled([e for e in eoi if e > p], 6)]
        made += [("soi_to_end", 94, p, None), ("soi_to_end_append_eoi", 93, p, None)]
        for n in candidates.TAILS:
            end = min(len(data), p + n)
            made += [(f"soi_tail_{n}", 92, p, end), (f"soi_tail_{n}_append_eoi", 91, p, end)] if end - p >= 128 else []
    for p in anchors:
        for b in candidates.BACKS:
            name, start = f"synthetic_soi_back_{b}", max(0, p - b)
            made += [(name, 88, start, None), (f"{name}_append_eoi", 87, start, None)]
            made += [(f"{name}_to_eoi", 86, start, e + 2) for e in rebuild.sampled([e for e in eoi if e > p], 3)]
    made += [("classification_hint_append_eoi", 105, 0, None)] if label == "jpeg_missing_eoi" else []
    if label == "jpeg_missing_soi_internal_structure":
        made += [(f"classification_hint_synthetic_soi_back_{b}", 106, max(0, p - b), None) for p in anchors[:16] for b in (512, 2048, 8192, 32768)]
    walked = [(strategy, priority, start, end) for _, strategy, priority, start, end, *_ in rebuild.Blob(data, label).rows()]
    return sorted([*dict.fromkeys(made), *walked], key=lambda m: (-m[1], m[0]))


def test_a_run_takes_the_plans_of_every_lane(spark, monkeypatch):
    data = picture(spark)
    tables = segments_of(data, "FFC4")
    sos = data.index(b"\xff\xda")
    files = {
        "jpeg_missing_soi_internal_structure": data[2:sos] + data[sos + 2 + int.from_bytes(data[sos + 2 : sos + 4], "big") :], "jpeg_missing_eoi": data[:-2],
        "jpeg_missing_dht": data[: tables[0][0]] + data[tables[-1][0] + len(tables[-1][1]) :], "jpeg_structural_salvage_candidate": data[:-9] + b"\xff\xd3" + data[-9:],
    }
    rows = spark.createDataFrame([(i, f"{i}.jpg", bytearray(d)) for i, d in enumerate(files.values())], "doc_id long, path string, content binary")
    run = evidence.Evidence(spark, "every lane")
    monkeypatch.setattr(run, "blobs", lambda: rows)
    assert [r["label"] for r in run.classified().orderBy("doc_id").collect()] == list(files)
    want = {i: every_jpeg_plan(d, label) for i, (label, d) in enumerate(files.items())}
    got = {i: [] for i in want}
    for r in run.attempts().orderBy("doc_id", "ord").collect():
        got[r["doc_id"]].append((r["strategy"], r["priority"], r["start"], r["end"]))
        assert r["ord"] == len(got[r["doc_id"]])
    assert got == want
    names = {i: " ".join(m[0] for m in plans) for i, plans in want.items()}
    assert "synthetic_sos" in names[0] and "inject_standard_dht" in names[2] and "restart_window" in names[3] and all("synthetic_soi_back" in n for n in names.values())
    assert {r["doc_id"]: r["plans"] for r in registry.deduped(run).collect()} == {i: len(plans) for i, plans in want.items()}


def test_paths_of_large_numbers_differ(spark, tmp_path):
    rows = [(i, "x") for i in (7, 999_999, 1_000_000, 1_000_008)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["path"].split(".")[0] for r in corpus.derived(spark, f"file://{tmp_path}").collect()}
    assert got == {7: "f000007", 999_999: "f999999", 1_000_000: "f1000000", 1_000_008: "f1000008"}


def test_shared_payloads_of_jpeg_plans(spark, monkeypatch):
    data = picture(spark)
    without = data[: segments_of(data, "FFC4")[0][0]] + data[segments_of(data, "FFC4")[-1][0] + len(segments_of(data, "FFC4")[-1][1]) :]
    files = {0: without, 1: without, 2: data[:-2], 3: b"\x89PNG\r\n\x1a\n" + bytes(9)}
    rows = spark.createDataFrame([(i, f"{i}.jpg" if i < 3 else "3.png", bytearray(d)) for i, d in files.items()], "doc_id long, path string, content binary")
    run = evidence.Evidence(spark, "shared payloads")
    monkeypatch.setattr(run, "blobs", lambda: rows)
    labels = {r["doc_id"]: r["label"] for r in run.classified().collect()}
    want = {}
    for r in run.plans().collect():
        if r["header_bytes"] is None:
            whole = bytes.fromhex(r["prepend"]) + files[r["doc_id"]][r["start"] : r["end"]] + bytes.fromhex(r["append"])
            want.setdefault(hashlib.sha256(whole).hexdigest(), []).append(r["doc_id"])
    for i in range(3):
        for *_, digest in rebuild.Blob(files[i], labels[i]).rows():
            want.setdefault(digest, []).append(i)
    got = {r["payload_sha256"]: (r["plans"], r["files"]) for r in registry.shared_payloads(run).collect()}
    assert got == {digest: (len(ids), len(set(ids))) for digest, ids in want.items()}
    assert got[hashlib.sha256(without).hexdigest()][1] == 2 and got[hashlib.sha256(files[2] + b"\xff\xd9").hexdigest()][0] > 1


def test_standard_tables_are_those_of_the_jvm(spark):
    jpeg = spark._jvm.javax.imageio.plugins.jpeg
    tables = {0x00: "StdDCLuminance", 0x10: "StdACLuminance", 0x01: "StdDCChrominance", 0x11: "StdACChrominance"}
    data, at = J.huffman(3), 0
    while at < len(data):
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        own = getattr(jpeg.JPEGHuffmanTable, tables[body[0]])
        lengths = list(own.getLengths())
        assert list(body[1:17]) == lengths + [0] * (16 - len(lengths)) and list(body[17:]) == list(own.getValues())
        at += 2 + n
    zigzag = J.zigzag()
    for table, name in ((J.LUMINANCE, "K1Luminance"), (J.CHROMINANCE, "K2Chrominance")):
        assert [int(v) for v in table.split()] == list(getattr(jpeg.JPEGQTable, name).getTable())
    assert zigzag[:6] == [0, 1, 8, 16, 9, 2] and sorted(zigzag) == list(range(64))


def test_scores_and_winner(spark):
    rows = spark.createDataFrame(
        [(1, 1, "jpeg", "jpeg", "jpeg_missing_eoi", "slice", "append_eoi_full", 97, True, 100, 100, 0, 0, 1.0), (1, 2, "jpeg", "jpeg", "jpeg_missing_eoi", "slice", "full_file", 117, True, 100, 100, 0, 0, 1.0),
         (2, 1, "mp4", "mp4", "isobmff_signature_away_from_byte0", "container_rebuild_plan", "signature_offset_to_end", 99, True, 100, 100, 2000, 400, 0.0), (3, 1, "png", "png", "x", "slice", "full_file", 100, False, 0, 0, 0, 0, 0.0)],
        "doc_id long, ord int, class_family string, family string, label string, kind string, strategy string, priority int, ok boolean, width int, height int, duration_ms int, frame_count int, entropy double",
    ).withColumn("score", scoring.score())
    got = {(r["doc_id"], r["ord"]): r["score"] for r in rows.collect()}
    assert got[1, 1] == 10 + 194 + 20 + 80 + 40 and got[1, 2] == 10 + 234 + 20 + 80
    assert got[2, 1] == 198 + 2 + 2 + 600 + 80 + 35 + 45 and got[3, 1] == float("-inf")
    assert {r["doc_id"]: r["ord"] for r in scoring.winners(rows).collect()} == {1: 1, 2: 1}


def test_store_appends_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.latest_run() is None
    run = store.start_run("scan", "baseline-v2", {"a": 1})
    rows = spark.createDataFrame([(run, 1, "k1"), (run, 1, "k1"), (run, 1, "k2")], "run_id long, doc_id long, dedupe_key string")
    store.append("candidates", rows)
    store.append("candidates", rows)
    assert store.of_run("candidates").count() == 2
    assert store.start_run("scan", "baseline-v2") == run + 1
    with pytest.raises(ValueError):
        store.of_run("candidates", 99)


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.JPG").write_bytes(b"\xff\xd8abc\xff\xd9")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    assert [r["path"].rsplit("/", 1)[1] for r in corpus.files(spark, f"file://{tmp_path}/in").collect()] == ["a.JPG"]
    assert corpus.files(spark, f"file://{tmp_path}/in", all_files=True).count() == 2
    stream = classify.classified(corpus.new_files(spark, f"file://{tmp_path}/in")).select("label").writeStream.format("memory").queryName("labels").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert [r[0] for r in spark.sql("select label from labels").collect()] == ["jpeg_low_signal"]


def test_segments_until_the_scan(spark):
    data = picture(spark)
    for marker in ("FFDB", "FFC4", "FFE0"):
        assert rebuild.until_scan(data, bytes.fromhex(marker)) == [s for at, s in segments_of(data, marker) if at < data.index(b"\xff\xda")]
    assert rebuild.until_scan(b"\xff\xda" + data, rebuild.DQT) == [] and rebuild.until_scan(b"", rebuild.DQT) == []
    assert rebuild.until_scan(b"xx\xff\xdb\x00\x04ab\xff\xdb\xff\xffcd", rebuild.DQT) == [b"\xff\xdb\x00\x04ab"]


def test_equal_tables_take_one_place():
    found = [(0, b"a"), (1, b"b"), (2, b"c"), (3, b"d")]
    assert rebuild.tables(found, "dqt", (2, 1, 2, 4), [("std", b"s")], 4) == [("found_dqt_2", b"ab"), ("found_dqt_1", b"a"), ("found_dqt_4", b"abcd"), ("std", b"s")]


def test_many_markers_take_linear_time(spark):
    took = []
    for n in (100_000, 1_000_000):
        rows = blobs(spark, a__jpg=b"\xff\xd8\xff\xda" * n)
        began = time.time()
        row = classify.classified(rows).select("soi_count", "label", F.size("hits").alias("hits")).first()
        took.append(time.time() - began)
        assert (row["soi_count"], row["label"]) == (n, "jpeg_missing_eoi") and 18 < row["hits"] <= 24
        assert candidates.every(classify.classified(rows)).count() < 2000
    assert took[1] < 20 * took[0] + 2


def test_arriving_files_are_kept_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.jpg", "b.png"):
        (tmp_path / "in" / name).write_bytes(b"\xff\xd8abc")
        intake.persist(intake.arriving(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a.jpg", "b.png"]


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("a,b.jpg", "full_file", 1)], "relative_path string, strategy_id string, ok int")
    store.write_attempts_csv(rows, f"file://{tmp_path}/csv")
    store.write_json(rows, f"file://{tmp_path}/json")
    lines = max((p.read_text().splitlines() for p in (tmp_path / "csv").glob("*.csv")), key=len)
    assert lines[0] == ",".join(store.REPORT_COLUMNS) and lines[1].startswith('"a,b.jpg",full_file,')
    assert spark.read.json(f"file://{tmp_path}/json").first()["ok"] == 1
