"""Attempts: every plan of a blob made into bytes and read, in one pass over blobs; and saving what won.

A blob's plans are made beside its bytes, so no bytes are exchanged and no plan is joined. Equal payloads of a
blob are read once. Pictures are read by functions.pictures; videos, and pictures that it can't read, by external
programs where they are installed (operators.external). A blob that can't be worked on gives one failed attempt with
the error, and the run goes on.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions import kinds as K
from mendframe.functions import pictures
from mendframe.operators import candidates, external, rebuild, scoring

ATTEMPT = pa.schema([
    ("doc_id", pa.int64()), ("ord", pa.int32()), ("family", pa.string()), ("label", pa.string()), ("strategy", pa.string()), ("priority", pa.int32()), ("kind", pa.string()),
    ("start", pa.int64()), ("end", pa.int64()), ("payload_sha256", pa.string()), ("decoder", pa.string()), ("phase", pa.string()), ("ok", pa.bool_()),
    ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("decoded_format", pa.string()), ("duration_ms", pa.int32()), ("frame_count", pa.int32()),
    ("entropy", pa.float64()), ("error", pa.string()), ("telemetry", pa.string()),
])
TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
NO_PROBE = {"ok": False, "width": 0, "height": 0, "mode": "", "decoded_format": "", "duration_ms": 0, "frame_count": 0, "entropy": 0.0, "error": "", "telemetry": "{}"}
READER = "pillow"  # fixed value: the name that reports give to the reader of pictures
RUN_FAILED = "script_exception:"


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {TYPES[f.type]}" for f in schema)


def compact(error: object, lines: int = 4, chars: int = 400) -> str:
    """The Python twin of functions.bytes.compact_error."""
    text = " | ".join([s for s in (part.strip() for part in str(error).replace("\r", "\n").split("\n")) if s][:lines])
    return text[: chars - 3] + "..." if len(text) > chars else text


def image_probe(data: bytes) -> dict:
    """What reading a picture finds, or why it can't be read."""
    try:
        found = pictures.read(data)
    except pictures.Broken as error:
        return NO_PROBE | {"error": compact(error)}
    return NO_PROBE | {"ok": True, "width": found.width, "height": found.height, "mode": found.mode, "decoded_format": found.decoded_format, "entropy": found.entropy}


class Made(NamedTuple):
    """A plan's strategy, priority, kind, start, end, and what makes its bytes."""

    strategy: str
    priority: int
    kind: str
    start: int
    end: int | None
    payload: Callable[[], bytes]


def plans_of(row: dict) -> list[Made]:
    """All plans of a blob (content, family, label, offsets) in order: falling priority, strategy, generation."""
    content = row["content"] or b""
    scan = candidates.Scan(content, row["family"], row["label"], row["offsets"] or [])
    out = [Made(*p[:5], lambda p=p: p.payload(content)) for p in candidates.ordered(chain.from_iterable(lane(scan) for lane in candidates.lanes_of(scan.family)))]
    if scan.family == "jpeg":
        blob = rebuild.Blob(content, scan.label)
        out += [Made(s, p, rebuild.SLICE, start, end, lambda n=nth: blob.payload(n)) for nth, s, p, start, end, *_ in blob.rows()]
    return sorted(out, key=lambda p: (-p.priority, p.strategy))


def attempts(classified: DataFrame, most_external: int = scoring.FALLBACK) -> DataFrame:
    """Scored attempts of all plans of classified blobs (with content).

    Pictures that nothing reads are tried again by an external program, their first most_external plans.
    """

    def one(row: dict) -> Iterator[dict]:
        family, video = row["family"], row["family"] in K.VIDEO_KINDS
        known: dict[str, dict] = {}
        made = plans_of(row)
        won = False

        def tried(nth: int, plan: Made, decoder: str, phase: str, probe: Callable[[bytes], dict]) -> dict:
            data = plan.payload()
            digest = hashlib.sha256(data).hexdigest()
            if digest not in known:
                known[digest] = probe(data)
            head = dict(zip(("strategy", "priority", "kind", "start", "end"), plan[:5], strict=True))
            return {"doc_id": row["doc_id"], "ord": nth, "family": family, "label": row["label"], "payload_sha256": digest, "decoder": decoder, "phase": phase} | head | known[digest]

        for nth, plan in enumerate(made, 1):
            if video:
                found = tried(nth, plan, external.VIDEO, "video_probe", lambda data: NO_PROBE | external.video_probe(data, family))
            else:
                found = tried(nth, plan, READER, "image_probe", image_probe)
            won |= found["ok"]
            yield found
        if not video and not won and external.available():
            known.clear()
            for nth, plan in enumerate(made[:most_external], 1):
                yield tried(nth, plan, external.IMAGE, "image_probe_ffmpeg", lambda data: NO_PROBE | external.image_probe(data, family))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    rows = list(one(row))
                except Exception as error:  # noqa: BLE001  one blob's failure is a row of the report, not the end of the run
                    rows = [dict.fromkeys(ATTEMPT.names) | NO_PROBE | {"doc_id": row["doc_id"], "ord": 0, "family": row["family"], "label": row["label"], "strategy": "none", "priority": 0, "kind": "none", "start": 0, "decoder": "none", "phase": "error", "error": RUN_FAILED + compact(error)}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ATTEMPT)

    columns = ["doc_id", "family", "label", "content", "offsets"]
    found = candidates.scanned(classified).select(*columns).mapInArrow(run, ddl(ATTEMPT))
    # a plan's family is that of its blob's class
    return found.withColumn("class_family", F.col("family")).withColumn("score", scoring.score())


# fixed values: what each kind of file may hold, and into what other modes are turned
MODES = {"jpeg": ("RGB", "L"), "png": ("1", "L", "LA", "P", "RGB", "RGBA"), "gif": ("P", "L"), "bmp": ("RGB", "L"), "tiff": ("1", "L", "LA", "P", "RGB", "RGBA", "CMYK"), "webp": ("RGB", "RGBA", "L")}
TURNED = {"jpeg": "RGB", "png": "RGBA", "gif": "P", "bmp": "RGB", "tiff": "RGB", "webp": "RGBA"}


def saved_mode(mode: str, kind: str) -> str:
    """The mode that a picture of a mode is saved in as a kind; other kinds take RGB."""
    if kind == "png" and mode == "CMYK":
        return "RGB"
    return mode if mode in MODES.get(kind, ()) else TURNED.get(kind, "RGB")


ARTIFACT = pa.schema([
    ("doc_id", pa.int64()), ("ok", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("decoded_format", pa.string()),
    ("entropy", pa.float64()), ("error", pa.string()), ("decoder", pa.string()), ("output_type", pa.string()), ("artifact", pa.binary()), ("artifact_sha256", pa.string()), ("raw_candidate", pa.binary()), ("telemetry", pa.string()),
])


def saved(data: bytes, kind: str) -> tuple[pictures.Picture, bytes]:
    """A picture in a kind of file: PNG and BMP are written anew, others stay as they are where they are of the kind."""
    found = pictures.read(data)
    if found.decoded_format.lower() == kind and kind not in ("png", "bmp"):
        return found, data
    if found.pixels is None or kind not in pictures.WRITERS:
        raise pictures.Broken(f"no writer turns {found.decoded_format} into {kind}")
    return found, pictures.WRITERS[kind](found.pixels)


def save(winners: DataFrame, classified: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Artifacts of winners (doc_id, ord): the picture in its output kind, or what external programs make of a video."""

    def one(row: dict) -> Iterator[dict]:
        base = dict.fromkeys(ARTIFACT.names) | {"doc_id": row["doc_id"], "ok": False, "width": 0, "height": 0, "mode": "", "decoded_format": "", "entropy": 0.0, "error": "", "telemetry": "{}"}
        data = plans_of(row)[row["ord"] - 1].payload()
        raw = {"raw_candidate": data if keep_raw else None}
        if row["family"] in K.VIDEO_KINDS:
            for made in external.video_artifacts(data, row["family"]):
                yield base | raw | made
            return
        try:
            found, body = saved(data, row["output_kind"])
        except pictures.Broken as error:
            made = external.saved_image(data, row["family"], row["output_kind"]) if external.available() else None
            yield base | raw | made if made else base | {"decoder": READER, "error": compact(error)}
            return
        yield base | raw | {
            "ok": True, "width": found.width, "height": found.height, "mode": saved_mode(found.mode, row["output_kind"]), "decoded_format": row["output_kind"].upper(), "entropy": found.entropy,
            "decoder": READER, "output_type": "image", "artifact": body, "artifact_sha256": hashlib.sha256(body).hexdigest(),
        }

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(one(row)), schema=ARTIFACT)

    kind = scoring.output_kind(F.col("declared_kind"), F.col("byte0_kind"), F.col("family"))
    rows = candidates.scanned(classified).withColumn("output_kind", kind).select("doc_id", "family", "label", "content", "offsets", "output_kind")
    return rows.join(winners.select("doc_id", "ord"), "doc_id").mapInArrow(run, ddl(ARTIFACT))

