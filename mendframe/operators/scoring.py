"""Scores of probed candidates, the winner of each blob, the second round for blobs without one, and final attempts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendframe.functions import kinds as K

FAILED = float("-inf")
MOST_AREA = 50_000_000
FALLBACK = 12
NO_WINNER = "no_candidate_succeeded"
# fixed values: engines by name with their families
ENGINES = {"jpeg-v1": ["jpeg"], "baseline-v2": [*K.IMAGE_KINDS, *K.VIDEO_KINDS]}


def area() -> Column:
    return F.least(F.col("width").cast("long") * F.col("height").cast("long"), F.lit(MOST_AREA)).cast("double")


def _plus(total: Column, rule: Column, points: float) -> Column:
    return total + F.when(rule, points).otherwise(0.0)  # adding 0 changes nothing, and total stands here once


def image_score() -> Column:
    """Area, priority and entropy, then bonuses in a fixed order of addition; class in label, its family in class_family."""
    label, strategy = F.col("label"), F.col("strategy")
    total = F.lit(0.0) + area() / 1000.0 + F.col("priority") * F.lit(2.0) + F.col("entropy") * 20.0
    total = _plus(total, F.col("class_family") == F.col("family"), 80.0)
    total = _plus(total, (label == "jpeg_missing_dht") & strategy.contains("dht"), 50.0)
    total = _plus(total, (label == "jpeg_missing_soi_internal_structure") & (strategy.contains("synthetic_soi") | strategy.contains("rebuild_header")), 65.0)
    total = _plus(total, (label == "jpeg_missing_eoi") & strategy.contains("append_eoi"), 40.0)
    total = _plus(total, strategy.contains("restart_window"), 30.0)
    total = _plus(total, (F.col("width") < 8) | (F.col("height") < 8), -300.0)
    return _plus(total, (F.col("width") > 30000) | (F.col("height") > 30000), -200.0)


def video_score() -> Column:
    """Priority, area, duration and frames, then bonuses in a fixed order of addition."""
    label, strategy = F.col("label"), F.col("strategy")
    total = F.lit(0.0) + F.col("priority") * F.lit(2.0) + area() / 5000.0
    total = total + F.least(F.col("duration_ms") / 1000.0, F.lit(600.0)) + F.least(F.col("frame_count"), F.lit(300)) * F.lit(2.0)
    total = _plus(total, F.col("class_family") == F.col("family"), 80.0)
    total = _plus(total, F.col("kind") == "container_rebuild_plan", 35.0)
    total = _plus(total, strategy.contains("signature_offset") & label.endswith("away_from_byte0"), 45.0)
    return _plus(total, (label == "mpegts_desync_or_partial_packets") & strategy.contains("ts_sync"), 50.0)


def score() -> Column:
    return F.when(~F.col("ok"), F.lit(FAILED)).when(F.col("class_family").isin(K.VIDEO_KINDS), video_score()).otherwise(image_score())


def persisted_score(value: Column) -> Column:
    """As it is stored: a score of exactly 0 reads as none."""
    return F.when(value == 0, F.lit(FAILED)).otherwise(F.coalesce(value, F.lit(FAILED)))


def winners(attempts: DataFrame) -> DataFrame:
    """The best successful attempt of each blob; the first candidate wins ties."""
    best = W.partitionBy("doc_id").orderBy(F.col("score").desc(), "ord")
    return attempts.where("ok").withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def fallback(attempts: DataFrame, most: int = FALLBACK) -> DataFrame:
    """The first candidates, again, of image blobs that have no winner."""
    without = attempts.where(~F.col("class_family").isin(K.VIDEO_KINDS)).join(attempts.where("ok").select("doc_id").distinct(), "doc_id", "left_anti")
    return without.where(F.col("ord") <= most)


def outcomes(files: DataFrame, won: DataFrame) -> DataFrame:
    """Every file with its winner, or with the error that there is none."""
    joined = files.join(won.select("doc_id", "strategy", "decoder", "score", "width", "height"), "doc_id", "left")
    return joined.withColumn("success", F.col("strategy").isNotNull().cast("int")).withColumn("error", F.when(F.col("strategy").isNull(), NO_WINNER))


def final_attempts(won: DataFrame) -> DataFrame:
    """The attempt that writes each winner, in the phase that follows the winner's."""
    return won.withColumn("phase", F.concat("phase", F.lit("_final")))


def largest(attempts: DataFrame) -> DataFrame:
    """The older rule: the largest picture wins, the first on ties."""
    best = W.partitionBy("doc_id").orderBy((F.col("width").cast("long") * F.col("height")).desc(), "ord")
    return attempts.where("ok").withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def families_of(engine: str) -> list[str]:
    """The families that an engine takes on; an unknown name is an error."""
    if engine not in ENGINES:
        raise ValueError(f"Unknown engine: {engine}")
    return ENGINES[engine]


def gate(classified: DataFrame, engine: str = "baseline-v2") -> DataFrame:
    """Files whose family an engine doesn't handle, with the error that says so."""
    return classified.where(~F.col("family").isin(families_of(engine))).select("doc_id", F.concat(F.lit("no_engine_for_family:"), "family").alias("error"))


def output_kind(declared: Column, byte0: Column, family: Column) -> Column:
    """The image kind to write: declared, else found at byte 0, else the class family, else png."""
    image = lambda c: F.when(c.isin(K.IMAGE_KINDS), c)
    return F.coalesce(image(declared), image(byte0), image(family), F.lit("png"))


def output_path(path: Column, family: Column) -> Column:
    """Where a winner goes: images keep their path, videos change their extension by family."""
    by_family = F.create_map(*[F.lit(x) for k in K.VIDEO_KINDS for x in (k, K.VIDEO_OUTPUT.get(k, K.OTHER_VIDEO_OUTPUT))])
    swapped = F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.element_at(by_family, family))
    return F.when(family.isin(K.VIDEO_KINDS), swapped).otherwise(path)


def pseudo_probe(plans: DataFrame, files: DataFrame) -> DataFrame:
    """Attempts made up by integer arithmetic, where no decoder is at hand: it tests scoring and reports, not recovery."""
    d, o = F.col("doc_id"), F.col("ord")
    is_video = F.col("class_family").isin(K.VIDEO_KINDS)
    joined = plans.join(files.select("doc_id", F.col("family").alias("class_family"), "label"), "doc_id")
    errors = F.array(F.lit("ffmpeg_timeout"), F.lit("ffmpeg_failed"), F.lit("no_candidate_succeeded"))
    return joined.withColumns({
        "ok": F.pmod(d * 7 + o * 3, F.lit(5)) != 0, "width": (4 + F.pmod(d * 31 + o * 17, F.lit(4000))).cast("int"), "height": (4 + F.pmod(d * 13 + o * 29, F.lit(3000))).cast("int"),
        "duration_ms": F.when(is_video, F.pmod(d * 97, F.lit(700000))).otherwise(0).cast("int"), "frame_count": F.when(is_video, F.pmod(d, F.lit(400))).otherwise(0).cast("int"),
        "entropy": F.pmod(d * 11 + o, F.lit(800)) / 100.0, "decoder": F.when(is_video, "ffmpeg-video").otherwise("pillow"), "phase": F.lit("primary"),
    }).withColumn("error", F.when(~F.col("ok"), F.get(errors, F.pmod(d, F.lit(3)).cast("int")))).withColumn("score", score())
