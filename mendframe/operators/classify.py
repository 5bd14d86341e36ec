"""Damage classes of blobs: an ordered decision table over kinds and marker counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions import kinds as K
from mendframe.functions.memo import once_a_jvm
from mendframe.operators.signatures import OTHER_COUNTS, jpeg_counts, records, with_counts, with_jpeg_counts

AWAY = "away_from_byte0"
# fixed values: counts that stand in the evidence of each kind
EVIDENCE_GROUPS = {
    "png": ["png_sig_count", "ihdr_count", "idat_count", "iend_count"], "gif": ["gif_header_count"], "bmp": ["bm_count"], "tiff": ["tiff_header_count"], "webp": ["riff_count", "webp_count"],
}


@once_a_jvm
def jpeg_evidence() -> Column:
    """Weighted signs of JPEG in the order of addition, at most 0.99."""
    signs = [("is_declared", 0.45), ("is_byte0", 0.40), ("is_internal", 0.25), ("has_soi", 0.10), ("has_sos", 0.15)]
    total = F.lit(0.0)
    for name, weight in signs:
        total = total + F.when(F.col(name), weight).otherwise(0.0)
    return F.least(total, F.lit(0.99))


@once_a_jvm
def _signs() -> dict[str, Column]:
    n = F.col
    structure = (n("dqt_count") > 0) | (n("dht_count") > 0) | (n("sof_count") > 0) | (n("rst_count") > 0)
    return {
        "is_declared": F.coalesce(n("declared_kind") == "jpeg", F.lit(False)), "is_byte0": n("byte0_kind") == "jpeg",
        "is_internal": F.exists("hits", lambda h: h["family"] == "jpeg") | ((n("sos_count") > 0) & structure),
        "has_soi": n("soi_count") > 0, "has_sos": n("sos_count") > 0,
        "inferred": F.when(n("anywhere_kind") != "unknown", n("anywhere_kind")).when(n("byte0_kind") != "unknown", n("byte0_kind")).otherwise(n("declared_kind")),
    }


def classified(blobs: DataFrame) -> DataFrame:
    """records() with marker counts, family, label, confidence and jpeg_evidence."""
    rows = with_counts(with_jpeg_counts(records(blobs)), OTHER_COUNTS).withColumns(_signs())
    return rows.withColumn("jpeg_evidence", jpeg_evidence()).withColumns(_decision())


@once_a_jvm
def _decision() -> dict[str, Column]:
    """The decision table: the first rule that holds gives label and confidence."""
    n = F.col
    none, inner = n("soi_count") == 0, n("internal_marker_count") > 0
    jpeg_rules = [
        (none & inner, "jpeg_missing_soi_internal_structure", 0.82), (~none & (n("eoi_count") == 0), "jpeg_missing_eoi", 0.85),
        ((n("sos_count") > 0) & (n("dht_count") == 0), "jpeg_missing_dht", 0.84), (~none & (n("sos_count") > 0), "jpeg_structural_salvage_candidate", 0.75),
        (inner, "jpeg_internal_weak_signal", 0.65),
    ]
    is_jpeg = n("is_declared") | n("is_byte0") | n("is_internal")
    family = n("inferred")
    away = n("byte0_kind") == "unknown"
    at_box, at_ebml, at_avi = n("anywhere_kind").isin(K.ISOBMFF_KINDS), n("anywhere_kind").isin("mkv", "webm"), n("anywhere_kind") == "avi"
    box, ebml, avi, ts = family.isin(K.ISOBMFF_KINDS), family.isin("mkv", "webm"), family == "avi", family == "mpegts"
    other_rules = [
        (box & away & at_box, F.lit(f"isobmff_signature_{AWAY}"), 0.82), (box, F.lit("isobmff_container_candidate"), 0.72),
        (ebml & away & at_ebml, F.lit(f"ebml_signature_{AWAY}"), 0.80), (ebml, F.lit("ebml_container_candidate"), 0.70),
        (avi & away & at_avi, F.lit(f"riff_avi_signature_{AWAY}"), 0.79), (avi, F.lit("riff_avi_candidate"), 0.69),
        (ts & (n("byte0_kind") != "mpegts"), F.lit("mpegts_desync_or_partial_packets"), 0.86), (ts, F.lit("mpegts_candidate"), 0.75),
        (family.isin("mpegps", "flv", "asf", "wmv"), F.concat(family, F.lit("_container_candidate")), 0.70),
        (family.isin("png", "gif", "bmp", "tiff", "webp", "raw"), F.concat(family, F.lit("_detected_candidate")), 0.65),
        (family.isNotNull(), F.concat(family, F.lit("_declared_only")), 0.55),
    ]
    label, confidence = F.lit("unknown_low_signal"), F.lit(0.20)
    for rule, text, sure in reversed(other_rules):
        label, confidence = F.when(rule, text).otherwise(label), F.when(rule, F.lit(sure)).otherwise(confidence)
    jpeg_label, least = F.lit("jpeg_low_signal"), F.lit(0.50)
    for rule, text, floor in reversed(jpeg_rules):
        jpeg_label, least = F.when(rule, F.lit(text)).otherwise(jpeg_label), F.when(rule, F.lit(floor)).otherwise(least)
    return {
        "family": F.when(is_jpeg, "jpeg").otherwise(F.coalesce(family, F.lit("unknown"))),
        "label": F.when(is_jpeg, jpeg_label).otherwise(label),
        "confidence": F.when(is_jpeg, F.round(F.greatest(n("jpeg_evidence"), least), 4)).otherwise(confidence),
    }


def evidence(rows: DataFrame, hits: int = 32) -> DataFrame:
    """What a class rests on, as one struct: kinds, hits by family, the first hits, marker counts."""
    families = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"])))
    summary = F.map_from_entries(F.transform(families, lambda f: F.struct(f, F.size(F.filter("hits", lambda h: h["family"] == f)))))
    first = F.transform(F.slice("hits", 1, hits), lambda h: F.struct(h["family"].alias("family"), h["signature_type"].alias("signature_type"), h["offset"].alias("offset"), (-h["rank"]).alias("confidence")))
    groups = {"jpeg": list(jpeg_counts())} | EVIDENCE_GROUPS
    return rows.withColumn("evidence", F.struct(
        "declared_kind", "byte0_kind", "anywhere_kind", summary.alias("signature_summary"), first.alias("signature_hits"), *[F.struct(*cs).alias(k) for k, cs in groups.items()],
    ))


def legacy_byte0(content: Column) -> Column:
    """The kind of a header at byte 0 among six image kinds, by prefix."""
    starts = lambda h: F.substring(content, 1, len(h) // 2) == F.unhex(F.lit(h))
    webp = starts(K.RIFF) & (F.substring(content, 9, 4) == F.unhex(F.lit(K.WEBP)))
    return (
        F.when(starts(K.SOI), "jpeg").when(starts(K.PNG), "png").when(starts(K.GIF87) | starts(K.GIF89), "gif").when(starts(K.BMP), "bmp")
        .when(starts(K.TIFF_LE) | starts(K.TIFF_BE), "tiff").when(webp, "webp").otherwise("unknown")
    )
