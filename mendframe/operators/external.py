"""External programs for videos and odd pictures, where they are installed: one file in and out of a task's own folder.

Without ffmpeg and ffprobe every probe fails with an error that says so, as runs without them expect.
"""
from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
import tempfile
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendframe.functions import pictures

IMAGE, VIDEO = "ffmpeg", "ffmpeg-video"

# fixed values: suffixes of the files that programs read, and seconds that they may take
SUFFIXES = {
    "jpeg": ".jpg", "png": ".png", "gif": ".gif", "bmp": ".bmp", "tiff": ".tiff", "webp": ".webp", "heif": ".heic", "avif": ".avif", "jp2": ".jp2", "mp4": ".mp4", "mov": ".mov",
    "avi": ".avi", "mkv": ".mkv", "webm": ".webm", "mpegts": ".ts", "mpegps": ".mpg", "flv": ".flv", "asf": ".asf", "wmv": ".wmv",
}
SECONDS = {"image": 12, "probe": 12, "preview": 20, "remux": 30, "frames": 25}
REMUXED = {"mpegts": ".ts", "mpegps": ".mpg"}
MOST_FRAMES = 8
TELEMETRY = "struct<streams:array<struct<codec_type:string,width:int,height:int,nb_frames:string>>,format:struct<format_name:string,duration:string>>"


def suffix(kind: str) -> str:
    return SUFFIXES.get(kind, ".bin")


@lru_cache(maxsize=None)
def program(name: str) -> str | None:
    return shutil.which(name)


def available() -> bool:
    return program("ffmpeg") is not None


def can_probe() -> bool:
    return program("ffprobe") is not None


def short(raw: bytes) -> str:
    from mendframe.operators.probing import compact

    return compact(raw.decode("utf-8", "replace"))


def called(name: str, arguments: list[str], seconds: int) -> tuple[bytes, str]:
    """What a program prints, and its error: empty if it ended well."""
    try:
        done = subprocess.run([program(name) or name, *arguments], capture_output=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired:
        return b"", f"{name}_timeout"
    except OSError as error:
        return b"", short(str(error).encode())
    return done.stdout, (short(done.stderr) or f"{name}_failed") if done.returncode else ""


QUIET = ["-nostdin", "-hide_banner", "-loglevel", "error", "-y", "-err_detect", "ignore_err", "-fflags", "+discardcorrupt"]


def frame(folder: str, source: str, seconds: int) -> tuple[bytes, str]:
    """The first frame as PNG, or the error."""
    target = os.path.join(folder, "frame.png")
    _, error = called("ffmpeg", [*QUIET, "-i", source, "-frames:v", "1", target], seconds)
    if error or not os.path.exists(target) or not os.path.getsize(target):
        return b"", error or "ffmpeg_failed"
    with open(target, "rb") as f:
        return f.read(), ""


def placed(folder: str, data: bytes, kind: str) -> str:
    path = os.path.join(folder, "input" + suffix(kind))
    with open(path, "wb") as f:
        f.write(data)
    return path


def image_probe(data: bytes, kind: str) -> dict:
    """A picture as the program sees it."""
    if not available():
        return {"error": "ffmpeg_not_found"}
    with tempfile.TemporaryDirectory() as folder:
        body, error = frame(folder, placed(folder, data, kind), SECONDS["image"])
    if error:
        return {"error": error}
    found = pictures.read(body)
    return {"ok": True, "width": found.width, "height": found.height, "mode": found.mode, "decoded_format": kind, "entropy": found.entropy}


def measured(report: str) -> dict:
    """Size of the last video stream, most frames of any, duration and format from what the prober prints."""
    try:
        told = json.loads(report or "{}")
    except json.JSONDecodeError:
        told = {}
    told = told if isinstance(told, dict) else {}
    videos = [s for s in told.get("streams") or [] if s.get("codec_type") == "video"]
    out = {"width": 0, "height": 0, "frame_count": 0}
    for s in videos:
        count = str(s.get("nb_frames") or "")
        out = {
            "width": int(s.get("width") or out["width"]), "height": int(s.get("height") or out["height"]),
            "frame_count": max(out["frame_count"], int(float(count)) if count.replace(".", "", 1).isdigit() else 0),
        }
    about = told.get("format") or {}
    try:
        out["duration_ms"] = int(float(about.get("duration") or 0) * 1000)
    except (TypeError, ValueError):
        out["duration_ms"] = 0
    return out | {"decoded_format": str(about.get("format_name") or "")}


def measured_columns(report: Column) -> dict[str, Column]:
    """The same of a column of reports, without Python."""
    told = F.from_json(report, TELEMETRY)
    videos = F.filter(F.coalesce(told["streams"], F.array().cast("array<struct<codec_type:string,width:int,height:int,nb_frames:string>>")), lambda s: s["codec_type"] == "video")
    last = lambda name: F.coalesce(F.try_element_at(F.filter(F.transform(videos, lambda s: s[name]), lambda v: v > 0), F.lit(-1)), F.lit(0))
    counts = F.transform(videos, lambda s: F.when(s["nb_frames"].rlike(r"^(\d+\.?\d*|\.\d+)$"), F.floor(s["nb_frames"].cast("double"))).otherwise(F.lit(0)).cast("int"))
    sizes = F.when(F.size(videos) > 0, F.try_element_at(F.array_sort(counts), F.lit(-1)))
    return {
        "width": F.when(F.size(videos) > 0, last("width")).otherwise(0), "height": F.when(F.size(videos) > 0, last("height")).otherwise(0), "frame_count": F.coalesce(sizes, F.lit(0)),
        "duration_ms": F.coalesce((told["format"]["duration"].try_cast("double") * 1000).cast("int"), F.lit(0)), "decoded_format": F.coalesce(told["format"]["format_name"], F.lit("")),
    }


def video_probe(data: bytes, kind: str) -> dict:
    """A video's telemetry and whether a frame of it can be decoded."""
    if not available() or not can_probe():
        return {"error": "ffmpeg_or_ffprobe_not_found"}
    with tempfile.TemporaryDirectory() as folder:
        source = placed(folder, data, kind)
        told, error = called("ffprobe", ["-v", "error", "-print_format", "json", "-show_format", "-show_streams", source], SECONDS["probe"])
        if error == "ffprobe_timeout":
            return {"error": error}
        body, error = frame(folder, source, SECONDS["preview"])
    report = told.decode("utf-8", "replace")
    if error:
        return {"error": error, "telemetry": report or "{}"}
    found, seen = measured(report), pictures.read(body)
    return found | {"ok": True, "width": found["width"] or seen.width, "height": found["height"] or seen.height, "decoded_format": found["decoded_format"] or kind, "telemetry": report or "{}"}


def digest(body: bytes) -> dict:
    return {"artifact": body, "artifact_sha256": hashlib.sha256(body).hexdigest()}


def video_artifacts(data: bytes, kind: str) -> list[dict]:
    """A copy in a sound container and a preview frame, or some frames where neither can be made."""
    if not available():
        return [{"decoder": VIDEO, "error": "ffmpeg_not_found"}]
    made, errors = [], []
    with tempfile.TemporaryDirectory() as folder:
        source, target = placed(folder, data, kind), os.path.join(folder, "out" + REMUXED.get(kind, ".mkv"))
        _, error = called("ffmpeg", [*QUIET, "-i", source, "-map", "0", "-c", "copy", target], SECONDS["remux"])
        if not error and os.path.exists(target) and os.path.getsize(target):
            with open(target, "rb") as f:
                made.append({"ok": True, "decoder": VIDEO, "output_type": "video"} | digest(f.read()))
        errors.append(error)
        body, error = frame(folder, source, SECONDS["preview"])
        if body:
            seen = pictures.read(body)
            made.append({"ok": True, "decoder": VIDEO, "output_type": "preview_frame", "width": seen.width, "height": seen.height} | digest(body))
        errors.append(error)
        if not made:
            _, error = called("ffmpeg", [*QUIET, "-i", source, "-frames:v", str(MOST_FRAMES), os.path.join(folder, "frame-%03d.png")], SECONDS["frames"])
            for name in sorted(n for n in os.listdir(folder) if n.startswith("frame-")):
                with open(os.path.join(folder, name), "rb") as f:
                    made.append({"ok": True, "decoder": VIDEO, "output_type": "frame_set"} | digest(f.read()))
            errors.append(error)
    return made or [{"decoder": VIDEO, "error": next((e for e in errors if e), "ffmpeg_failed")}]


def saved_image(data: bytes, kind: str, output_kind: str) -> dict:
    """A picture that only the program reads, in a kind of file that can be written."""
    with tempfile.TemporaryDirectory() as folder:
        body, error = frame(folder, placed(folder, data, kind), SECONDS["image"])
    if error or output_kind not in pictures.WRITERS:
        return {"decoder": IMAGE, "error": error or f"no writer for {output_kind}"}
    seen = pictures.read(body)
    body = body if output_kind == "png" else pictures.WRITERS[output_kind](seen.pixels)
    return {"ok": True, "decoder": IMAGE, "output_type": "image", "width": seen.width, "height": seen.height, "mode": seen.mode, "decoded_format": output_kind.upper(), "entropy": seen.entropy} | digest(body)
