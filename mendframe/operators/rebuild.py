"""JPEG candidates that need a walk over segments: inserted tables, rebuilt headers, synthetic scans, restart windows.

A segment's place depends on the lengths of those before it, so this is a walk over bytes and runs in Arrow batches;
every other lane is made of Column expressions. A row carries the size and digest of its payload, not the payload.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions import jpeg_tables as J
from mendframe.functions import kinds as K
from mendframe.functions.bytes import sampled
from mendframe.operators.candidates import LEAST_WINDOW, SLICE, TAILS

SEGMENTS_PER_MARKER = 12
MOST_OPTIONS = 18
NEAR = 131072
SOF = [bytes.fromhex(h) for h in K.SOF]
APP = [bytes.fromhex(h) for h in K.APP]
DQT, DHT, DRI, SOI, EOI, SOS = (bytes.fromhex(h) for h in (K.DQT, K.DHT, K.DRI, K.SOI, K.EOI, K.SOS))
HEADER = {DQT, DHT, DRI, bytes.fromhex(K.COM), *APP, *SOF}
RESTART = re.compile(b"\xff[\xd0-\xd7]")
ANCHOR = re.compile(b"\xff[\xe0-\xef\xdb\xc4\xdd\xc0-\xc3\xc5-\xc7\xc9-\xcb\xcd-\xcf\xda]")
SCHEMA = "doc_id long, ord int, family string, strategy string, priority int, kind string, start long, end long, header_bytes int, anchor long, payload_size long, payload_sha256 string"


def places(data: bytes, mark: bytes | re.Pattern) -> list[int]:
    return [m.start() for m in (mark if isinstance(mark, re.Pattern) else re.compile(re.escape(mark))).finditer(data)]


def walk(data: bytes) -> dict[bytes, list[tuple[int, bytes]]]:
    """Whole header segments by marker, from left to right; a segment that is taken is jumped over."""
    found: dict[bytes, list[tuple[int, bytes]]] = {}
    at = data.find(b"\xff")
    while 0 <= at <= len(data) - 4:
        marker, end = data[at : at + 2], at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in HEADER and at + 4 <= end <= len(data):
            own = found.setdefault(marker, [])
            if len(own) < SEGMENTS_PER_MARKER:
                own.append((at, data[at:end]))
            at = data.find(b"\xff", end)
        else:
            at = data.find(b"\xff", at + 1)
    return found


def until_scan(data: bytes, marker: bytes) -> list[bytes]:
    """Whole segments of a marker in the header: from the start to the first start of scan, segments taken as they follow."""
    out, at = [], 2 if data.startswith(SOI) else 0
    while at + 4 <= len(data):
        at = data.find(b"\xff", at, len(data) - 3)
        if at < 0 or data[at : at + 2] == SOS:
            break
        own, size = data[at : at + 2], int.from_bytes(data[at + 2 : at + 4], "big")
        if own in (SOI, EOI) or RESTART.match(own):
            at += 2
        elif size < 2 or at + 2 + size > len(data):
            at += 1
        else:
            out += [data[at : at + 2 + size]] if own == marker else []
            at += 2 + size
    return out


def nearest(segments: list[tuple[int, bytes]], target: int, most: int) -> list[tuple[int, bytes]]:
    return sorted(segments, key=lambda s: (abs(target - s[0]), s[0]))[:most]


@dataclass
class Option:
    """A header that could go before a scan."""

    app: bytes
    dqt: bytes
    sof: bytes
    dht: bytes
    dri: bytes
    sof_end: int
    sof_at: int
    profile: str

    def header(self, minimal: bool = False) -> bytes:
        return SOI + (b"" if minimal else self.app) + self.dqt + self.sof + self.dht + self.dri


def tables(found: list[tuple[int, bytes]], name: str, counts: tuple[int, ...], standard: list[tuple[str, bytes]], most: int) -> list[tuple[str, bytes]]:
    """The first different ones of: so many found tables in a row, then standard ones."""
    joined = [(f"found_{name}_{n}", b"".join(s for _, s in found[:n])) for n in counts if n <= len(found)]
    first: dict[bytes, str] = {}
    for label, blob in joined + standard:
        first.setdefault(blob, label)
    return [(label, blob) for blob, label in first.items()][:most]


def options(found: dict[bytes, list[tuple[int, bytes]]], target: int) -> list[Option]:
    """Headers from frame headers near target, each with tables that were found or standard ones."""
    near = [s for marker in SOF for s in nearest(found.get(marker, []), target, 2)]
    frames = {blob: at for at, blob in reversed(nearest(near, target, len(near)))}
    frames = dict(sorted(frames.items(), key=lambda s: (abs(target - s[1]), s[1]))[:4])
    out = []
    for sof, at in frames.items():
        parts = max(1, len(J.component_ids(sof)))
        dqt_count, dht_count = (2, 4) if parts > 1 else (1, 2)
        app = [s for marker in APP for _, s in nearest(found.get(marker, []), at, 1)][:2] or [J.JFIF]
        dqt = tables(found.get(DQT, []), "dqt", (dqt_count, 1, 2, 4), [(f"std_{J.shade(parts)}_q{q}", J.quantisation(parts, q)) for q in J.QUALITIES], 3)
        dht = tables(found.get(DHT, []), "dht", (dht_count, 2, 4, 1), [(f"std_{J.shade(parts)}", J.huffman(parts))], 2)
        dri = b"".join(s for _, s in nearest(found.get(DRI, []), at, 1))
        out += [Option(b"".join(app), q, sof, h, dri, at + len(sof), at, f"{ql}__{hl}") for (ql, q), (hl, h) in product(dqt, dht)]
    return out[:MOST_OPTIONS]


@dataclass
class Blob:
    """A blob with its anchors, and the plans made so far; plans has them in order after rows()."""

    data: bytes
    label: str
    made: list[tuple] = field(default_factory=list)
    plans: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.found, self.eoi, self.rst = walk(self.data), places(self.data, EOI), places(self.data, RESTART)
        self.sos = sampled(places(self.data, SOS), 16)
        self.anchors = sampled(places(self.data, ANCHOR), 32)
        self.closing = b"" if self.data.endswith(EOI) else EOI

    def add(self, strategy: str, priority: int, header: bytes, start: int, end: int | None, tail: bytes, split: int | None = None, inserted: bytes = b"", anchor: int | None = None) -> None:
        """anchor: the marker that the plan belongs to; plans of different markers are different plans."""
        self.made.append((strategy, priority, header, start, end, tail, split, inserted, split if anchor is None else anchor))

    def windows(self, start: int, ends: int, least: int) -> list[tuple[int | None, bytes]]:
        """(end, tail) of scans from start: to sampled ends of image, of fixed lengths, to the end; none shorter than least."""
        size = len(self.data)
        out = [(e + 2, b"") for e in sampled([e for e in self.eoi if e > start], ends) if e + 2 - start >= least]
        out += [(end, EOI) for end in (min(size, start + n) for n in TAILS) if end - start >= LEAST_WINDOW]
        out += [(None, self.closing)] if size - start + len(self.closing) >= least else []
        seen: dict[tuple, tuple] = {}
        for end, tail in out:
            seen.setdefault((end, (size if end is None else end) - start + len(tail)), (end, tail))
        return list(seen.values())

    def insert_tables(self) -> None:
        """Standard tables before a start of scan that lacks them."""
        no_dqt, no_dht, no_soi = (places(self.data, m) == [] for m in (DQT, DHT, SOI))
        frames = [s for marker in SOF for s in self.found.get(marker, [])]
        for nth, sos in enumerate(self.sos):
            near = nearest(frames, sos, 1)
            parts = max(1, len(J.component_ids(near[0][1]))) if near else 3
            dht = f"std_{J.shade(parts)}"
            if no_dqt or no_dht:
                for q in J.QUALITIES:
                    dqt = f"std_{J.shade(parts)}_q{q}"
                    inserted = (J.quantisation(parts, q) if no_dqt else b"") + (J.huffman(parts) if no_dht else b"")
                    suffix = f"{dqt}__{dht}" if no_dqt else dht
                    for name, priority, tail in ((f"inject_standard_tables_before_sos_{suffix}", 103, b""), (f"inject_standard_tables_before_sos_append_eoi_{suffix}", 102, EOI)):
                        self.add(name, priority, SOI if no_soi else b"", 0, None, tail, sos, inserted)
            if self.label == "jpeg_missing_dht" and nth < 4:
                self.add(f"classification_hint_inject_standard_dht_{dht}", 107, b"", 0, None, b"", sos, J.huffman(parts))

    def rebuild_headers(self) -> None:
        """Whole headers before scans that start at or some way before a start of scan."""
        best = 109 if self.label == "jpeg_missing_soi_internal_structure" else 101
        for sos in self.sos:
            for option, (end, tail) in product(options(self.found, sos), self.windows(sos, 4, 0)):
                self.add(f"rebuild_header_from_segments_{option.profile}", best, option.header(), sos, end, tail, anchor=sos)
                self.add(f"rebuild_header_from_segments_minimal_{option.profile}", 100, option.header(True), sos, end, tail, anchor=sos)
                for back in (0, 128, 512, 2048, 8192):
                    self.add(f"sos_window_rebuild_header_back_{back}_{option.profile}", 99, option.header(), max(0, sos - back), end, tail, anchor=sos)

    def synthetic_scans(self) -> None:
        """Headers with a start of scan made from the frame header, where the blob has none."""
        if self.label != "jpeg_missing_soi_internal_structure" or self.sos:
            return
        for option in options(self.found, self.anchors[0] if self.anchors else 0):
            scan = J.scan_header(option.sof)
            for start in self.scan_starts(option) if scan else []:
                for end, tail in self.windows(start, 3, LEAST_WINDOW):
                    self.add(f"rebuild_header_with_synthetic_sos_{option.profile}", 111, option.header() + scan, start, end, tail, anchor=option.sof_at)
                    self.add(f"rebuild_header_with_synthetic_sos_minimal_{option.profile}", 110, option.header(True) + scan, start, end, tail, anchor=option.sof_at)
                    if self.rst:
                        self.add(f"rebuild_header_with_synthetic_sos_rst_window_{option.profile}", 112, option.header() + scan, start, end, tail, anchor=option.sof_at)

    def scan_starts(self, option: Option) -> list[int]:
        """Where coded data may begin: after the frame, after the last header segments near it, and before restart markers."""
        ends = sorted(at + len(s) for own in self.found.values() for at, s in own if abs(at - option.sof_at) <= NEAR)[-3:]
        restarts = sampled([r for r in self.rst if r > option.sof_end], 4)
        before = [max(option.sof_end, r - back) for r in restarts for back in (256, 1024, 4096, 16384, 65536)]
        return [s for s in dict.fromkeys([option.sof_end, *ends, *before]) if s < len(self.data) - 64]

    def restart_windows(self) -> None:
        """Scans that end at a restart marker."""
        for sos in self.sos[:8]:
            for rst in sampled([r for r in self.rst if r > sos], 8):
                for option in options(self.found, sos)[:3]:
                    self.add(f"restart_window_rebuild_header_{option.profile}", 99, option.header(), sos, min(len(self.data), rst + 2), EOI, anchor=sos)

    def rows(self) -> Iterator[tuple]:
        """Plans in order with the size and digest of their payloads; equal plans keep their first place."""
        self.insert_tables()
        self.rebuild_headers()
        self.synthetic_scans()
        self.restart_windows()
        kept = list(dict.fromkeys(self.made))
        self.plans = sorted(kept, key=lambda m: (-m[1], m[0]))
        begun: dict[tuple, object] = {}  # digests of headers and of data from a start on, which many plans begin with
        for nth, (strategy, priority, header, start, end, tail, split, inserted, anchor) in enumerate(self.plans, 1):
            if split is None:
                size = len(header) + len(self.data[start:end]) + len(tail)
                digest = self._begun(begun, header, start, end).copy()
            else:
                size = len(header) + len(inserted) + len(self.data) + len(tail)
                digest = self._begun(begun, header, 0, split).copy()
                digest.update(inserted)
                digest.update(memoryview(self.data)[split:])
            digest.update(tail)
            yield nth, strategy, priority, start, end, len(header) + len(inserted), anchor, size, digest.hexdigest()

    def _begun(self, begun: dict, header: bytes, start: int, end: int | None):
        """The digest of a header and data[start:end]; equal beginnings are hashed once."""
        key = (header, start, end)
        if key not in begun:
            digest = hashlib.sha256(header)
            digest.update(memoryview(self.data)[start:end])
            begun[key] = digest
        return begun[key]

    def payload(self, nth: int) -> bytes:
        """The bytes of the nth of rows()."""
        _, _, header, start, end, tail, split, inserted, _ = self.plans[nth - 1]
        return header + (self.data[start:end] if split is None else self.data[:split] + inserted + self.data[split:]) + tail


def rebuild_plans(classified: DataFrame) -> DataFrame:
    """Plans of the walking lanes for blobs of the JPEG family."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["doc_id"], nth, "jpeg", s, p, SLICE, start, end, h, anchor, size, digest) for nth, s, p, start, end, h, anchor, size, digest in Blob(r["content"] or b"", r["label"]).rows()]
                if rows:
                    names = [f.split()[0] for f in SCHEMA.split(", ")]
                    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return classified.where(F.col("family") == "jpeg").select("doc_id", "label", "content").mapInArrow(run, SCHEMA)
