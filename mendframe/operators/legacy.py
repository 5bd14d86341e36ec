"""Rules of the older engine: which kinds to try for a file, in what order, and what to advise after a run."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions import kinds as K
from mendframe.functions.bytes import bytes_at, positions
from mendframe.operators.classify import legacy_byte0
from mendframe.sources.corpus import declared_kind

KINDS = K.SAVABLE_KINDS
MOST_HITS = 32
MOST_ERRORS = 30
SEPARATOR = "\n"


def primary(blobs: DataFrame) -> DataFrame:
    """doc_id, policy and kinds (comma-joined) of the first pass: by extension, else by header, else all."""
    declared = F.when(declared_kind(F.col("path")).isin(KINDS), declared_kind(F.col("path")))
    header = legacy_byte0(F.col("content"))
    return blobs.select("doc_id", declared.alias("declared"), header.alias("header")).select(
        "doc_id",
        F.when(F.col("declared").isNotNull(), "extension_trusted").when(F.col("header") != "unknown", "header_used_no_extension").otherwise("no_extension_no_header_try_all").alias("policy"),
        F.coalesce("declared", F.when(F.col("header") != "unknown", F.col("header")), F.lit(",".join(KINDS))).alias("kinds"),
    )


def hit_counts(blobs: DataFrame) -> DataFrame:
    """Adds n_<kind>: strong signatures anywhere, at most 32 of each needle."""
    text, size = F.col("content"), F.octet_length("content")
    few = lambda h: F.slice(positions(text, h), 1, MOST_HITS)
    both = lambda a, b: F.size(F.array_distinct(F.concat(few(a), few(b))))
    webp = F.filter(positions(text, K.RIFF), lambda p: (p + 12 <= size) & (F.hex(bytes_at(F.col("content"), p + 8, 4)) == K.WEBP))
    counts = {
        "jpeg": F.size(few(K.SOI)), "png": F.size(few(K.PNG)), "gif": both(K.GIF87, K.GIF89), "bmp": F.size(few(K.BMP)),
        "tiff": both(K.TIFF_LE, K.TIFF_BE), "webp": F.least(F.size(webp), F.lit(MOST_HITS)),
    }
    return blobs.withColumns({f"n_{k}": c.cast("long") for k, c in counts.items()})


def fallback_order(blobs: DataFrame) -> DataFrame:
    """doc_id, place and kind: the kinds left after the first pass, those with most signatures first."""
    counted = hit_counts(blobs).select("doc_id", *[f"n_{k}" for k in KINDS]).join(primary(blobs), "doc_id")
    items = F.array(*[F.struct((-F.col(f"n_{k}")).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])
    left = F.array_sort(F.filter(items, lambda x: ~F.array_contains(F.split("kinds", ","), x["kind"])))
    return counted.select("doc_id", F.posexplode(left).alias("place", "x")).select("doc_id", (F.col("place") + 1).alias("place"), "x.kind", (-F.col("x.n")).alias("hits"))


def chosen(blobs: DataFrame) -> DataFrame:
    """blobs with declared, byte0, policy, kinds and other_kinds (arrays in the order of trying)."""
    first = primary(blobs.select("doc_id", "path", "content"))
    ranked = hit_counts(blobs.select("doc_id", "content")).select("doc_id", *[F.col(f"n_{k}") for k in KINDS])
    items = F.array(*[F.struct((-F.col(f"n_{k}")).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])
    left = F.transform(F.array_sort(F.filter(items, lambda x: ~F.array_contains("kinds", x["kind"]))), lambda x: x["kind"])
    known = declared_kind(F.col("path"))
    told = first.join(ranked, "doc_id").withColumn("kinds", F.split("kinds", ",")).withColumn("other_kinds", left)
    own = blobs.withColumns({"declared": F.when(known.isin(KINDS), known), "byte0": legacy_byte0(F.col("content")), "size": F.octet_length("content").cast("long")})
    return own.join(told, "doc_id")


# fixed values: the texts of advice

IDEA_TEXTS = {
    "exists": "Use --overwrite if you want to replace existing recovered files.",
    "jpeg_inner": "JPEG seems to have internal structure without SOI. Add more synthetic-SOI candidate families from DQT/DHT/SOF/SOS windows.",
    "jpeg_open": "JPEG has SOI but no EOI. Increase append-EOI attempts and tail-window attempts.",
    "jpeg_restart": "JPEG contains restart markers. Add restart-segment based carving / salvage attempts.",
    "jpeg_bare": "JPEG appears to be missing both header and scan markers. Recovery may require block-level brute-force or external carving tools.",
    "png_bare": "PNG has IHDR but no signature. Add more synthetic-signature / chunk-window attempts.",
    "png_open": "PNG has data but no IEND. Add append-IEND and chunk-length sanity repair attempts.",
    "png_empty": "PNG has no visible IDAT marker. Stream may be too damaged for simple salvage.",
    "gif_open": "GIF has header but no trailer. Add synthetic trailer / block terminator attempts.",
    "gif": "If GIFs matter, add deeper block-level GIF parsing instead of first-frame only salvage.",
    "bmp": "For BMP, add header-field repair attempts (pixel offset / DIB size / image size).",
    "tiff": "For TIFF, add IFD/strip-offset repair and endian-consistency checks.",
    "webp": "For WEBP, add RIFF size repair and VP8/VP8L/VP8X subtype-aware recovery.",
    "no_attempts": "No attempts were logged. Increase candidate generation and logging depth.",
    "fallback": "Primary intended kind failed, so the script also tried the remaining supported image kinds as a fallback.",
}
OTHER_HITS = "Other format signatures were found somewhere in the blob: "
ADVICE_TEXTS = {
    "no_candidate": "Most failures had no successful candidate. Candidate generation is the main bottleneck; add richer kind-specific carving before adding more save logic.",
    "external": "FFmpeg outperformed Pillow on successful recoveries. Consider increasing --max-ffmpeg-candidates or letting FFmpeg run earlier for the declared format.",
    "jpeg_inner": " failed JPEGs had internal JPEG structure but no SOI. Add more synthetic-SOI strategies from DQT/DHT/SOF/SOS windows.",
    "jpeg_open": " failed JPEGs had SOI but no EOI. Add stronger append-EOI and truncated-tail strategies.",
    "png_bare": " failed PNGs had IHDR but no PNG signature. Add more synthetic-signature / chunk-window recovery.",
    "png_open": " failed PNGs had IDAT but no IEND. Add append-IEND and chunk-repair logic.",
    "always": "Inspect recover_detail.jsonl for failed files and sort by declared_kind, marker_stats_by_kind, and the earliest failing strategies. That file is the source of truth for what to add next.",
}
#: the share of failures without any candidate from which candidates are the bottleneck
BOTTLENECK = 0.7


def signs() -> dict[str, Column]:
    """What marker counts say of a file, by the name of the text that goes with it."""
    n = F.col
    inner = reduce(lambda a, b: a | b, [n(c) > 0 for c in ("sos_count", "dqt_count", "dht_count", "sof_count")])
    return {
        "jpeg_inner": (n("soi_count") == 0) & inner, "jpeg_open": (n("soi_count") > 0) & (n("eoi_count") == 0), "jpeg_restart": n("rst_count") > 0,
        "jpeg_bare": (n("soi_count") == 0) & (n("sos_count") == 0), "png_bare": (n("ihdr_count") > 0) & (n("png_sig_count") == 0),
        "png_open": (n("idat_count") > 0) & (n("iend_count") == 0), "png_empty": n("idat_count") == 0, "gif_open": n("gif_trailer_count") == 0,
    }


def next_ideas(rows: DataFrame) -> DataFrame:
    """doc_id and ideas (a line each) for files without success.

    rows: success, error, kinds and fallback_kinds (comma-joined), attempts (their number), n_<kind> and marker counts.
    """
    found, by_kind = signs(), {k: [] for k in KINDS}
    for name in IDEA_TEXTS:
        kind = name.split("_")[0]
        if kind in by_kind:
            by_kind[kind].append(F.when(found.get(name, F.lit(True)), F.lit(IDEA_TEXTS[name])))
    none = F.when(F.col("attempts") == 0, F.lit(IDEA_TEXTS["no_attempts"]))
    table = F.create_map(*[x for k, ideas in by_kind.items() for x in (F.lit(k), F.array_compact(F.array(*ideas, none)))])
    own = F.flatten(F.transform(F.split("kinds", ","), lambda k: F.coalesce(F.try_element_at(table, k), F.array().cast("array<string>"))))
    seen = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in KINDS]))
    tried = F.col("fallback_kinds") != ""
    more = F.array_compact(F.array(
        F.when(tried, F.lit(IDEA_TEXTS["fallback"])), F.when(tried & (F.size(seen) > 0), F.concat(F.lit(OTHER_HITS), F.array_join(seen, ", "), F.lit("."))),
    ))
    ideas = F.when(F.col("error") == "output_exists", F.array(F.lit(IDEA_TEXTS["exists"]))).otherwise(F.concat(own, more))
    return rows.where("success = 0").select("doc_id", F.array_join(ideas, SEPARATOR).alias("ideas"))


def recommendations(rows: DataFrame) -> DataFrame:
    """place and advice: what the failures of a run suggest, in order.

    rows: success, error, decoder, declared_kind and marker counts of every file.
    """
    lost, found = F.col("success") == 0, signs()
    declared = lambda kind, sign: F.count_if(lost & (F.col("declared_kind") == kind) & found[sign])
    counts = rows.agg(
        F.count_if(lost).alias("failed"), F.count_if(lost & (F.col("error") == "no_candidate_succeeded")).alias("no_candidate"),
        F.count_if(~lost & (F.col("decoder") == "ffmpeg")).alias("external"), F.count_if(~lost & (F.col("decoder") == "pillow")).alias("own"),
        *[declared(sign.split("_")[0], sign).alias(sign) for sign in ("jpeg_inner", "jpeg_open", "png_bare", "png_open")],
    )
    said = F.array(
        F.when((F.col("failed") > 0) & (F.col("no_candidate") > F.col("failed") * BOTTLENECK), F.lit(ADVICE_TEXTS["no_candidate"])),
        F.when(F.col("external") > F.col("own"), F.lit(ADVICE_TEXTS["external"])),
        *[F.when(F.col(sign) > 0, F.concat(F.col(sign).cast("string"), F.lit(ADVICE_TEXTS[sign]))) for sign in ("jpeg_inner", "jpeg_open", "png_bare", "png_open")],
        F.lit(ADVICE_TEXTS["always"]),
    )
    return counts.select(F.posexplode(F.array_compact(said)).alias("place", "advice"))
