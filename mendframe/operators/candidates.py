"""Repair candidates as plans: byte ranges with bytes before and after, made into bytes only where they are probed.

A plan row is (doc_id, ord, strategy, family, priority, kind, start, end, prepend, append); end is exclusive, null
means the end of the blob. ord is a plan's place among a blob's plans: falling priority, then strategy, then the order
of generation, which decides ties between winners. A lane is a function of a scanned blob; a blob's plans are made,
ordered and, where wanted, hashed in one pass over its bytes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendframe.functions import kinds as K
from mendframe.functions.bytes import found, sampled

# fixed values: lengths of tails, how far windows reach back, the least length of a window, kinds of candidates
TAILS = (65536, 262144, 1048576, 4194304)
BACKS = (0, 128, 512, 2048, 8192, 32768, 131072)
HINT_BACKS = (512, 2048, 8192, 32768)
LEAST_WINDOW = 128
CLUSTER = 131072
SLICE, REBUILD, PLAIN = "synthetic_header", "container_rebuild_plan", "slice"
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("family", pa.string()), ("strategy", pa.string()), ("priority", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
    ("prepend", pa.string()), ("append", pa.string()), ("ord", pa.int32()),
])
DDL = "doc_id long, family string, strategy string, priority int, kind string, start int, `end` int, prepend string, append string, ord int"


class Plan(NamedTuple):
    """One plan; bytes before and after are in hexadecimal."""

    strategy: str
    priority: int
    kind: str
    start: int
    end: int | None = None
    prepend: str = ""
    append: str = ""

    def payload(self, content: bytes) -> bytes:
        return bytes.fromhex(self.prepend) + content[self.start : self.end] + bytes.fromhex(self.append)


class Scan:
    """A blob with what lanes look for in it; each search is made once, when a lane asks for it."""

    def __init__(self, content: bytes | None, family: str = "", label: str = "", offsets: Iterable[int] = ()) -> None:
        self.content, self.family, self.label, self.offsets = content or b"", family, label, list(offsets)
        self.size = len(self.content)

    def at(self, *needles: str) -> list[int]:
        return found(self.content, needles)

    @cached_property
    def soi(self) -> list[int]:
        return sampled(self.at(K.SOI), 16)

    @cached_property
    def eoi(self) -> list[int]:
        return self.at(K.EOI)

    @cached_property
    def markers(self) -> list[int]:
        return sampled(self.at(*K.APP, K.DQT, K.DHT, K.DRI, *K.SOF, K.SOS), 32)

    def ends(self, start: int, limit: int) -> list[int]:
        """Ends of sampled ends of image behind a place."""
        return [e + 2 for e in sampled([e for e in self.eoi if e > start], limit)]


Lane = Callable[[Scan], Iterable[Plan]]


def payload(content: Column) -> Column:
    """The bytes of a plan row's candidate."""
    size = F.octet_length(content)
    core = F.substring(content, F.col("start") + 1, F.greatest(F.coalesce(F.col("end"), size) - F.col("start"), F.lit(0)))
    return F.concat(F.unhex("prepend"), core, F.unhex("append"))


def plan_key() -> Column:
    """A digest of all that makes a plan, in a fixed order; equal digests mean equal plans.

    Plans of walking lanes have a size and a digest of their bytes in place of bytes before and after.
    """
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("prepend", "append", "header_bytes", "anchor", "payload_size", "payload_sha256")]
    return F.sha2(F.concat_ws("|", "family", "strategy", F.col("priority").cast("string"), "kind", F.col("start").cast("string"), F.coalesce(F.col("end").cast("string"), F.lit("end")), *rest), 256)


def ordered(plans: Iterable[Plan]) -> list[Plan]:
    """Different plans by falling priority and strategy; equal ones keep their first place."""
    return sorted(dict.fromkeys(plans), key=lambda p: (-p.priority, p.strategy))


def older_order(plans: Iterable[Plan]) -> list[Plan]:
    """Different plans by falling priority and start, larger ends first, those to the end of the blob last."""
    return sorted(dict.fromkeys(plans), key=lambda p: (-p.priority, p.start, p.end is None, -(p.end or 0)))


def plan_rows(blobs: DataFrame, lanes: Callable[[Scan], Iterable[Iterable[Plan]]], digest: bool = False, order: Callable = ordered) -> DataFrame:
    """Plan rows of blobs (doc_id, family, label, content, offsets); digest adds payload_sha256, made in the same pass."""
    schema = SCHEMA.append(pa.field("payload_sha256", pa.string())) if digest else SCHEMA

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, family, label, content, offsets in zip(*(batch.column(i) for i in range(5)), strict=True):
                scan = Scan(content.as_py(), family.as_py(), label.as_py(), offsets.as_py() or [])
                plans = order(chain.from_iterable(lanes(scan)))
                if not plans:
                    continue
                n = len(plans)
                columns = [[doc_id.as_py()] * n, [scan.family] * n, *zip(*plans, strict=True), list(range(1, n + 1))]
                if digest:
                    columns.append([hashlib.sha256(p.payload(scan.content)).hexdigest() for p in plans])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blobs.select("doc_id", "family", "label", "content", "offsets").mapInArrow(run, DDL + (", payload_sha256 string" if digest else ""))


def offsets() -> Column:
    """Offsets of the hits of a blob's own family."""
    return F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: h["family"] == F.col("family")), lambda h: h["offset"])))


def scanned(classified: DataFrame) -> DataFrame:
    return classified.withColumn("offsets", offsets())


# images that are no JPEGs, blobs of no kind, and videos


def whole_file(scan: Scan) -> list[Plan]:
    return [Plan("full_file", 100, PLAIN, 0)]


def image_hits(scan: Scan) -> list[Plan]:
    return [Plan("signature_offset_to_end", 96 if p > 0 else 99, PLAIN, p) for p in sampled(scan.offsets, 8)]


def video_hits(scan: Scan) -> list[Plan]:
    return [Plan("signature_offset_to_end", 99 if p > 0 else 100, REBUILD if p > 0 else PLAIN, p) for p in sampled(scan.offsets, 8)]


def packet_syncs(scan: Scan) -> list[Plan]:
    if scan.family != "mpegts":
        return []
    syncs = sampled(found(scan.content[: K.TS_WINDOW], (K.TS_SYNC,)), 8)
    return [Plan("ts_sync_offset_to_end", 101 if p > 0 else 100, REBUILD if p > 0 else PLAIN, p) for p in syncs]


# JPEG lanes that need positions only


def jpeg_whole(scan: Scan) -> list[Plan]:
    return [
        Plan("full_file", 100, PLAIN, 0), Plan("prepend_soi_full", 98, SLICE, 0, prepend=K.SOI), Plan("append_eoi_full", 97, SLICE, 0, append=K.EOI),
        Plan("prepend_soi_append_eoi_full", 96, SLICE, 0, prepend=K.SOI, append=K.EOI),
    ]


def tails(scan: Scan, start: int, name: str, priority: int, closed: str) -> Iterator[Plan]:
    """Tails of fixed lengths, as they are and, of the kind `closed`, with an end of image."""
    for n in TAILS:
        end = min(scan.size, start + n)
        if end - start >= LEAST_WINDOW:
            yield Plan(f"{name}_{n}", priority, PLAIN, start, end)
            yield Plan(f"{name}_{n}_append_eoi", priority - 1, closed, start, end, append=K.EOI)


def jpeg_soi(scan: Scan) -> Iterator[Plan]:
    """From each start of image: to sampled ends of image, to the end of the blob, and tails of fixed lengths."""
    for p in scan.soi:
        for end in scan.ends(p, 6):
            yield Plan("soi_to_sampled_eoi", 95, PLAIN, p, end)
        yield Plan("soi_to_end", 94, PLAIN, p)
        yield Plan("soi_to_end_append_eoi", 93, SLICE, p, append=K.EOI)
        yield from tails(scan, p, "soi_tail", 92, SLICE)


def jpeg_synthetic_soi(scan: Scan) -> Iterator[Plan]:
    """A start of image put before bytes that begin at or some way before each sampled marker."""
    for p in scan.markers:
        for back in BACKS:
            name, start = f"synthetic_soi_back_{back}", max(0, p - back)
            yield Plan(name, 88, SLICE, start, prepend=K.SOI)
            yield Plan(f"{name}_append_eoi", 87, SLICE, start, prepend=K.SOI, append=K.EOI)
            for end in scan.ends(p, 3):
                yield Plan(f"{name}_to_eoi", 86, SLICE, start, end, prepend=K.SOI)


def jpeg_hints(scan: Scan) -> Iterator[Plan]:
    """What the class suggests: an end of image, or a start of image before the first markers."""
    if scan.label == "jpeg_missing_eoi":
        yield Plan("classification_hint_append_eoi", 105, SLICE, 0, append=K.EOI)
    if scan.label == "jpeg_missing_soi_internal_structure":
        for p in scan.markers[:16]:
            for back in HINT_BACKS:
                yield Plan(f"classification_hint_synthetic_soi_back_{back}", 106, SLICE, max(0, p - back), prepend=K.SOI)


JPEG_LANES = (jpeg_whole, jpeg_soi, jpeg_synthetic_soi, jpeg_hints)
IMAGE_LANES = (whole_file, image_hits)
VIDEO_LANES = (whole_file, video_hits, packet_syncs)


def lanes_of(family: str) -> tuple[Lane, ...]:
    """The position lanes of a family."""
    return JPEG_LANES if family == "jpeg" else VIDEO_LANES if family in K.VIDEO_KINDS else IMAGE_LANES


def generic(classified: DataFrame, digest: bool = False) -> DataFrame:
    """Images that are no JPEGs, and blobs of no kind: the whole blob, and from each sampled hit of the family to the end."""
    rows = classified.where((F.col("family") != "jpeg") & ~F.col("family").isin(K.VIDEO_KINDS))
    return plan_rows(scanned(rows), lambda scan: (lane(scan) for lane in IMAGE_LANES), digest)


def video(classified: DataFrame, digest: bool = False) -> DataFrame:
    """Videos: the whole blob, from each sampled hit to the end, and transport streams from sampled sync bytes."""
    return plan_rows(scanned(classified.where(F.col("family").isin(K.VIDEO_KINDS))), lambda scan: (lane(scan) for lane in VIDEO_LANES), digest)


def jpeg(classified: DataFrame, *lanes: Lane, digest: bool = False) -> DataFrame:
    """Plans of the given lanes for blobs of the JPEG family."""
    return plan_rows(scanned(classified.where(F.col("family") == "jpeg")), lambda scan: (lane(scan) for lane in lanes), digest)


def every(classified: DataFrame, digest: bool = False) -> DataFrame:
    """Plans of all position lanes of each blob's family."""
    return plan_rows(scanned(classified), lambda scan: (lane(scan) for lane in lanes_of(scan.family)), digest)


def merged(ranges: DataFrame, walked: DataFrame) -> DataFrame:
    """Plans of position lanes and of walking lanes, with ord over all of them; no strategy is in both."""
    walked = walked.withColumns({c: F.col(c).cast("int") for c in ("start", "end")})
    order = W.partitionBy("doc_id").orderBy(F.col("priority").desc(), "strategy", "ord")
    return ranges.unionByName(walked, allowMissingColumns=True).withColumn("ord", F.row_number().over(order))


# the older engine: one kind at a time


def legacy_png(scan: Scan, limit: int) -> Iterator[Plan]:
    ends, size = scan.at(K.IEND), len(K.IEND) // 2

    def pairs(start: int, names: tuple[str, str, str], priority: int, prepend: str) -> Iterator[Plan]:
        after = [e for e in ends if e > start]
        if after:
            yield Plan(names[0], priority, PLAIN, start, after[0] + size, prepend)
            yield Plan(names[1], priority - 1, PLAIN, start, after[-1] + size, prepend)
        yield Plan(names[2], priority - 2, PLAIN, start, prepend=prepend)

    yield Plan("png_raw_file", 100, PLAIN, 0)
    for p in sampled(scan.at(K.PNG), limit):
        yield from pairs(p, ("png_sig_to_first_iend", "png_sig_to_last_iend", "png_sig_to_end"), 99, "")
    for p in sampled(scan.at(K.IHDR), limit):
        if p >= 4:
            yield from pairs(p - 4, ("png_prepend_sig_at_ihdr_first_iend", "png_prepend_sig_at_ihdr_last_iend", "png_prepend_sig_at_ihdr_to_end"), 95, K.PNG)
    yield Plan("png_prepend_sig_whole", 92, PLAIN, 0, prepend=K.PNG)


def legacy_gif(scan: Scan, limit: int) -> Iterator[Plan]:
    ends = scan.at(K.GIF_TRAILER)
    yield Plan("gif_raw_file", 100, PLAIN, 0)
    for p in sampled(scan.at(K.GIF87, K.GIF89), limit):
        after = [e for e in ends if e > p]
        if after:
            yield Plan("gif_header_to_first_trailer", 99, PLAIN, p, after[0] + 1)
            yield Plan("gif_header_to_last_trailer", 98, PLAIN, p, after[-1] + 1)
        yield Plan("gif_header_to_end", 97, PLAIN, p)


def declared(scan: Scan, p: int, field: int, more: int, name: str) -> Iterator[Plan]:
    """A plan of the length that a header field states, if it fits the blob."""
    raw = scan.content[p + field : p + field + 4]
    stated = int.from_bytes(raw, "little") + more
    if len(raw) == 4 and 64 <= stated <= scan.size - p:
        yield Plan(name, 99, PLAIN, p, p + stated)


def legacy_bmp(scan: Scan, limit: int) -> Iterator[Plan]:
    yield Plan("bmp_raw_file", 100, PLAIN, 0)
    for p in sampled(scan.at(K.BMP), limit):
        yield from declared(scan, p, 2, 0, "bmp_declared_size")
        yield Plan("bmp_to_end", 98, PLAIN, p)


def legacy_tiff(scan: Scan, limit: int) -> Iterator[Plan]:
    yield Plan("tiff_raw_file", 100, PLAIN, 0)
    for p in sampled(scan.at(K.TIFF_LE, K.TIFF_BE), limit):
        yield Plan("tiff_header_to_end", 99, PLAIN, p)


def legacy_webp(scan: Scan, limit: int) -> Iterator[Plan]:
    yield Plan("webp_raw_file", 100, PLAIN, 0)
    for p in sampled(scan.at(K.RIFF), limit):
        if scan.content[p + 8 : p + 12] == bytes.fromhex(K.WEBP):
            yield from declared(scan, p, 4, 8, "webp_declared_size")
            yield Plan("webp_to_end", 98, PLAIN, p)


def legacy_jpeg(scan: Scan, limit: int) -> Iterator[Plan]:
    """SOI windows, windows around starts of scan, and windows before internal markers."""
    few, some = max(1, min(limit, 12)), max(1, min(limit, 18))
    every_soi, every_sos = scan.at(K.SOI), scan.at(K.SOS)
    soi, sos = sampled(every_soi, few), sampled(every_sos, few)
    structure = scan.at(K.APP0, K.APP1, K.DQT, K.DHT, *K.SOF)
    pool, backs = sorted({*soi, *structure}), BACKS[:-1]
    yield from (Plan("jpeg_raw_file", 100, PLAIN, 0), Plan("jpeg_prepend_soi_whole", 99, PLAIN, 0, prepend=K.SOI), Plan("jpeg_prepend_soi_whole_append_eoi", 98, PLAIN, 0, prepend=K.SOI, append=K.EOI))
    for p in soi:
        after = [e for e in scan.eoi if e > p]
        for end in scan.ends(p, 6):
            yield Plan("jpeg_soi_to_sampled_eoi", 97, PLAIN, p, end)
        if after:
            yield Plan("jpeg_soi_to_first_eoi", 96, PLAIN, p, after[0] + 2)
            yield Plan("jpeg_soi_to_last_eoi", 95, PLAIN, p, after[-1] + 2)
        yield Plan("jpeg_soi_to_end", 94, PLAIN, p)
        yield Plan("jpeg_soi_to_end_append_eoi", 93, PLAIN, p, append=K.EOI)
        yield from tails(scan, p, "jpeg_soi_tail", 92, PLAIN)
    for p in sos:
        before = [m for m in pool if m <= p]
        near = [m for m in before if p - m <= CLUSTER]
        for base in sorted({p, *before[-1:], *near[:1]}):
            for back in backs:
                start, name = max(0, base - back), f"jpeg_sos_cluster_back_{back}"
                for end in scan.ends(p, 4):
                    yield Plan(f"{name}_to_eoi", 90, PLAIN, start, end, prepend=K.SOI)
                yield Plan(f"{name}_to_end", 89, PLAIN, start, prepend=K.SOI)
                yield Plan(f"{name}_to_end_append_eoi", 88, PLAIN, start, prepend=K.SOI, append=K.EOI)
    for p in sampled(sorted({*structure, *sos}), some):
        for back in backs:
            start, name = max(0, p - back), f"jpeg_synthetic_soi_marker_back_{back}"
            yield Plan(name, 87, PLAIN, start, prepend=K.SOI)
            yield Plan(f"{name}_append_eoi", 86, PLAIN, start, prepend=K.SOI, append=K.EOI)
            for end in scan.ends(p, 3):
                yield Plan(f"{name}_to_eoi", 85, PLAIN, start, end, prepend=K.SOI)


LEGACY: dict[str, Callable[[Scan, int], Iterator[Plan]]] = {"jpeg": legacy_jpeg, "png": legacy_png, "gif": legacy_gif, "bmp": legacy_bmp, "tiff": legacy_tiff, "webp": legacy_webp}


def legacy(blobs: DataFrame, kind: str, limit: int = 80, digest: bool = False) -> DataFrame:
    """Plans of one kind of the older engine for every blob, by falling priority, start, and larger ends first."""
    rows = blobs.select("doc_id", F.lit(kind).alias("family"), F.lit("").alias("label"), "content", F.array().cast("array<int>").alias("offsets"))
    return plan_rows(rows, lambda scan: (LEGACY[kind](scan, limit),), digest, older_order)
