"""Signature hits of blobs: where formats begin, anywhere in the bytes."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions import kinds as K
from mendframe.functions.bytes import count_of, count_of_any, found, over_bytes, sampled
from mendframe.functions.memo import once_a_jvm
from mendframe.sources.corpus import declared_kind

HIT = "array<struct<offset:int,rank:double,family:string,signature_type:string>>"
HITS = pa.list_(pa.struct([("offset", pa.int32()), ("rank", pa.float64()), ("family", pa.string()), ("signature_type", pa.string())]))
Hit = tuple[int, float, str, str]  # offset, negative confidence, family, type: sorted as reports want them


def packet_phase(data: bytes) -> dict:
    """The packet phase with most sync bytes in the first 8192 bytes and their number, the least phase on ties."""
    at = np.flatnonzero(np.frombuffer(data[: K.TS_WINDOW], np.uint8) == int(K.TS_SYNC, 16)) % K.TS_PACKET
    counts = np.bincount(at, minlength=K.TS_PACKET)
    phase = int(counts.argmax())
    return {"offset": phase if len(at) else None, "score": int(counts[phase]) if len(at) else None}


@lru_cache(maxsize=None)
def _phase():
    none = {"offset": None, "score": None}
    return over_bytes(packet_phase, "struct<offset:int,score:int>", pa.struct([("offset", pa.int32()), ("score", pa.int32())]), none)


def ts_sync(content: Column) -> Column:
    """struct(offset, score) of packet_phase()."""
    return _phase()(content)


def marked(data: bytes, limit: int) -> Iterator[Hit]:
    """Hits of simple signatures."""
    for family, kind, needles, first, other in K.SIGNATURES:
        for p in sampled(found(data, needles), limit):
            yield p, -(first if p == 0 else other), family, kind


def contained(data: bytes, limit: int) -> Iterator[Hit]:
    """Hits of containers, whose kind is told by the bytes that follow."""
    for p in sampled(found(data, (K.RIFF,)), limit):
        kind = {K.WEBP: ("webp", 0.99), K.AVI: ("avi", 0.98)}.get(data[p + 8 : p + 12].hex().upper())
        if kind:
            yield p, -(kind[1] if p == 0 else 0.90), kind[0], f"riff_{kind[0]}"
    for p in sampled(found(data, (K.FTYP,)), limit):
        brand = data[p + 4 : p + 8].decode("latin-1")
        if p >= 4 and len(brand) == 4:
            yield p - 4, -(0.99 if p == 4 else 0.90), K.KIND_OF_BRAND.get(brand, "mp4"), "ftyp:" + (brand.strip() or "unknown")
    for p in sampled(found(data, (K.EBML,)), limit):
        yield p, -(0.98 if p == 0 else 0.90), "webm" if b"webm" in data[p : p + 128].lower() else "mkv", "ebml"
    sync = packet_phase(data)
    if (sync["score"] or 0) >= K.TS_LEAST:
        yield sync["offset"], -min(0.99, 0.6 + sync["score"] / 20.0), "mpegts", "ts_sync"


def hits_in(data: bytes, limit: int = K.HITS_PER_TYPE) -> list[dict]:
    """All hits of a blob, sorted by offset, falling confidence, family, type."""
    return [dict(zip(("offset", "rank", "family", "signature_type"), h, strict=True)) for h in sorted(chain(marked(data, limit), contained(data, limit)))]


@lru_cache(maxsize=None)
def _hits():
    return over_bytes(hits_in, HIT, HITS, [])


def content_hits() -> Column:
    return _hits()(F.col("content"))


@once_a_jvm
def kind_columns() -> dict[str, Column]:
    return {"declared_kind": declared_kind(F.col("path")), "byte0_kind": first_byte_kind(F.col("hits")), "anywhere_kind": anywhere_kind(F.col("hits"))}


def anywhere_kind(hits: Column) -> Column:
    """The family of the hit with the highest confidence, then the least offset, then the first family."""
    ranked = F.transform(hits, lambda h: F.struct(h["rank"], h["offset"], h["family"].alias("family")))
    return F.coalesce(F.array_min(ranked)["family"], F.lit("unknown"))


def first_byte_kind(hits: Column) -> Column:
    """The family of the first hit at offset 0; sampling always keeps the first positions, so these are among the hits."""
    return F.coalesce(F.get(F.filter(hits, lambda h: h["offset"] == 0), 0)["family"], F.lit("unknown"))


def records(blobs: DataFrame) -> DataFrame:
    """doc_id, path, content, size, sha256, declared_kind, hits, byte0_kind and anywhere_kind of blobs."""
    found = blobs.withColumns({"size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "hits": content_hits()})
    return found.withColumns(kind_columns())


def hit_rows(recorded: DataFrame) -> DataFrame:
    """A row a hit: doc_id, position in the sorted hits, family, signature_type, offset, confidence."""
    return recorded.select("doc_id", F.posexplode("hits").alias("hit_no", "h")).select(
        "doc_id", "hit_no", "h.family", "h.signature_type", "h.offset", F.round(-F.col("h.rank"), 6).alias("confidence")
    )


@once_a_jvm
def jpeg_counts() -> dict[str, Column]:
    text = F.col("content")
    return {
        "soi_count": count_of(text, K.SOI), "eoi_count": count_of(text, K.EOI), "sos_count": count_of(text, K.SOS), "dqt_count": count_of(text, K.DQT),
        "dht_count": count_of(text, K.DHT), "app0_count": count_of(text, K.APP0), "app1_count": count_of(text, K.APP1),
        "sof_count": count_of_any(text, K.SOF), "rst_count": count_of_any(text, K.RST),
    }


def with_jpeg_counts(blobs: DataFrame) -> DataFrame:
    """Adds counts of JPEG markers; internal_marker_count leaves out restart markers and restart intervals."""
    inner = ("sos_count", "dqt_count", "dht_count", "sof_count", "app0_count", "app1_count")
    return blobs.withColumns(jpeg_counts()).withColumn("internal_marker_count", sum((F.col(c) for c in inner[1:]), F.col(inner[0])))


OTHER_COUNTS = {
    "png_sig_count": [K.PNG], "ihdr_count": [K.IHDR], "idat_count": [K.IDAT], "iend_count": [K.IEND], "gif_header_count": [K.GIF87, K.GIF89],
    "bm_count": [K.BMP], "tiff_header_count": [K.TIFF_LE, K.TIFF_BE], "riff_count": [K.RIFF], "webp_count": [K.WEBP],
}
LEGACY_COUNTS = {
    "gif_trailer_count": [K.GIF_TRAILER], "gif_separator_count": [K.GIF_SEPARATOR], "tiff_le_count": [K.TIFF_LE], "tiff_be_count": [K.TIFF_BE],
}


def with_counts(blobs: DataFrame, needles: dict[str, list[str]]) -> DataFrame:
    text = F.col("content")
    return blobs.withColumns({name: count_of_any(text, own) for name, own in needles.items()})
