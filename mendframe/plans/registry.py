"""Every query of the engine, by name, over the corpus that the documents table gives."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.catalog import Catalog, table
from mendframe.functions import bytes as B
from mendframe.functions import kinds as K
from mendframe.operators import candidates, classify, legacy, rebuild, scoring, signatures
from mendframe.plans import oracles as O
from mendframe.plans import older, report
from mendframe.plans.evidence import Evidence
from mendframe.sources import corpus

Build = Callable[[DataFrame], DataFrame]


def on_blobs(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(corpus.derived(spark, sf_dir))


def on_classified(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return on_evidence(lambda e: build(e.classified()))


def on_evidence(build: Callable[[Evidence], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Evidence(spark, sf_dir))


PLAN = ["doc_id", "ord", "family", "strategy", "priority", "kind", "start", "end", "prepend", "append"]
PLAN_SQL = ", ".join(f'"{c}"' for c in PLAN)
CLASS = ["doc_id", "path", "family", "label", "confidence"]


def hits_of(kind: str) -> Build:
    return lambda blobs: signatures.hit_rows(signatures.records(blobs)).where(F.col("family") == kind)


def nearest_marker(blobs: DataFrame) -> DataFrame:
    """For each start of scan the two table or frame markers nearest to it, the first on ties."""
    text = F.col("content")
    found = blobs.select("doc_id", B.positions(text, K.SOS).alias("sos"), B.positions_of_any(text, [K.DQT, K.DHT, *K.SOF]).alias("marker"))
    apart = F.transform("marker", lambda m: F.struct(F.abs(m - F.col("p")).alias("far"), m.alias("at")))
    near = found.select("doc_id", "marker", F.explode("sos").alias("p")).select("doc_id", "p", F.posexplode(F.slice(F.array_sort(apart), 1, 2)).alias("nth", "m"))
    return near.select("doc_id", F.col("p").alias("sos"), (F.col("nth") + 1).alias("nth"), F.col("m.at").alias("marker"))


def previous_marker(blobs: DataFrame) -> DataFrame:
    """For each start of scan the last marker at or before it."""
    text = F.col("content")
    pool = B.positions_of_any(text, [K.SOI, K.APP0, K.APP1, K.DQT, K.DHT, *K.SOF])
    found = blobs.select("doc_id", B.positions(text, K.SOS).alias("sos"), pool.alias("marker")).select("doc_id", "marker", F.explode("sos").alias("p"))
    return found.select("doc_id", F.col("p").alias("sos"), F.array_max(F.filter("marker", lambda m: m <= F.col("p"))).alias("marker"))


def deduped(evidence: Evidence) -> DataFrame:
    """Plans offered twice; only one of each key is kept."""
    plans = evidence.plans()
    return plans.unionByName(plans).withColumn("key", candidates.plan_key()).dropDuplicates(["doc_id", "key"]).groupBy("doc_id").agg(F.count("*").alias("plans"))


def shared_payloads(evidence: Evidence) -> DataFrame:
    """Distinct payloads and how many plans of how many files give each: equal payloads need one probe only."""
    return evidence.payloads().groupBy("payload_sha256").agg(F.count("*").alias("plans"), F.count_distinct("doc_id").alias("files"))


def summary_rows(blobs: DataFrame) -> DataFrame:
    """Hits by family of each blob."""
    return signatures.hit_rows(signatures.records(blobs)).groupBy("doc_id", "family").agg(F.count("*").alias("n"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error texts made compact: documents stand in for what decoders print."""
    return table(spark, sf_dir, "documents").select("doc_id", B.compact_error(F.col("text")).alias("error"))


def one_pass_counts(classified: DataFrame) -> DataFrame:
    """Three reports in one scan, by grouping sets."""
    rows = classified.select("label", "family", "anywhere_kind")
    return rows.groupingSets([["label"], ["family"], ["anywhere_kind"]], "label", "family", "anywhere_kind").agg(F.count("*").alias("n"))


def older_groupings(blobs: DataFrame) -> DataFrame:
    """The groupings of the older engine's summary that rest on files alone."""
    rows = legacy.chosen(blobs).select(
        F.explode(F.array(*[F.struct(F.lit(name).alias("grouping"), F.coalesce(F.col(c), F.lit("none")).alias("key")) for name, c in (("by_byte0_kind", "byte0"), ("by_declared_kind", "declared"), ("by_selection_policy", "policy"))])).alias("g"))
    return rows.groupBy("g.grouping", "g.key").agg(F.count("*").alias("n"))


def register(catalog: Catalog) -> None:
    """Adds the engine's own queries to the catalog."""
    add = catalog.add
    add("file_records", on_blobs(lambda b: signatures.records(b).select("doc_id", "path", "size", "sha256", "declared_kind")),
        O.query("SELECT x.doc_id, x.path, x.size, sha256(x.content) AS sha256, declared_kind FROM x LEFT JOIN exts USING (suffix)"))
    counts = [*O.MARKERS, "internal_marker_count"]
    add("marker_stats_jpeg", on_blobs(lambda b: signatures.with_jpeg_counts(b).select("doc_id", *counts)), O.query(f"SELECT doc_id, {', '.join(counts)} FROM marked", O.MARKED))
    for name, needles, sql in (("marker_stats_other", signatures.OTHER_COUNTS, O.OTHER), ("marker_stats_legacy", signatures.LEGACY_COUNTS, O.OLDER)):
        add(name, on_blobs(lambda b, n=needles: signatures.with_counts(b, n).select("doc_id", *n)), O.query(f"SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in sql.items())} FROM x"))
    add("find_all_positions", on_blobs(lambda b: b.select("doc_id", F.explode(B.positions(F.col("content"), K.SOI)).alias("position"))),
        O.query("SELECT doc_id, unnest(pos) AS position FROM pos", O.positions({"soi": [K.SOI]})))
    for limit in (4, 8, 24):
        add(f"sampled_positions_{limit}", on_blobs(lambda b, n=limit: b.select("doc_id", F.explode(B.sample(B.positions(F.col("content"), "74"), n)).alias("position"))),
            O.query(f"SELECT doc_id, unnest({O.sample('pos', limit)}) AS position FROM pos", O.positions({"t": ["74"]})))
    hit_sql = 'SELECT doc_id, hit_no, family, signature_type, "offset", round(confidence, 6) AS confidence FROM hits'
    add("signature_hits", on_blobs(lambda b: signatures.hit_rows(signatures.records(b))), O.query(hit_sql, O.HITS))
    for kind in ("jpeg", "png", "gif", "bmp", "tiff", "flv", "mpegps", "asf", "jp2", "webp", "avi", "mp4", "mov", "heif", "avif", "mkv", "webm", "mpegts"):
        add(f"signature_hits_{kind}", on_blobs(hits_of(kind)), O.query(f"{hit_sql} WHERE family = '{kind}'", O.HITS))
    add("mpegts_sync", on_blobs(lambda b: b.select("doc_id", signatures.ts_sync(F.col("content")).alias("s")).where(f"s.score >= {K.TS_LEAST}").select("doc_id", "s.offset", "s.score")),
        O.query(f'SELECT doc_id, phase AS "offset", n AS score FROM sync WHERE n >= {K.TS_LEAST}', O.HITS))
    add("signature_summary", on_blobs(summary_rows), O.query("SELECT doc_id, family, count(*) AS n FROM hits GROUP BY ALL", O.HITS))
    for kind in ("anywhere_kind", "byte0_kind"):
        add(kind, on_blobs(lambda b, k=kind: signatures.records(b).select("doc_id", k)), O.query(f"SELECT doc_id, {kind} FROM records", O.HITS, O.RECORDS))
    add("classify", on_blobs(lambda b: classify.classified(b).select(*CLASS)), O.query(f"SELECT {', '.join(CLASS)} FROM classified", *O.ALL))
    add("jpeg_evidence", on_classified(lambda c: c.select("doc_id", F.round("jpeg_evidence", 6).alias("jpeg_evidence"))), O.query("SELECT doc_id, round(jpeg_evidence, 6) AS jpeg_evidence FROM classified", *O.ALL))
    told = {f"{k}_{c}" if not c.startswith(k) else c: f"evidence.{k}.{c}" for k, cs in classify.EVIDENCE_GROUPS.items() for c in cs}
    add("evidence", on_classified(lambda c: classify.evidence(c).select(
        "doc_id", F.size("evidence.signature_hits").alias("hits"), F.size(F.map_keys("evidence.signature_summary")).alias("families"), F.coalesce(F.get("evidence.signature_hits", 0)["signature_type"], F.lit("none")).alias("first_hit"),
        *[F.col(f"evidence.jpeg.{n}").alias(n) for n in O.MARKERS], *[F.col(e).alias(n) for n, e in told.items()])),
        O.query(f"SELECT c.doc_id, least(32, count(h.family)) AS hits, count(DISTINCT h.family) AS families, coalesce(arg_min(h.signature_type, h.hit_no), 'none') AS first_hit, {', '.join(f'any_value(c.{n}) AS {n}' for n in O.MARKERS)}, "
                f"{', '.join(f'any_value({O.OTHER[e.rsplit(chr(46), 1)[1]]}) AS {n}' for n, e in told.items())} FROM classified c JOIN x ON x.doc_id = c.doc_id LEFT JOIN hits h ON h.doc_id = c.doc_id GROUP BY c.doc_id", *O.ALL))
    byte0 = O.query("SELECT doc_id, CASE WHEN sx LIKE 'FF D8 %' THEN 'jpeg' WHEN sx LIKE '89 50 4E 47 0D 0A 1A 0A %' THEN 'png' WHEN sx LIKE '47 49 46 38 37 61 %' OR sx LIKE '47 49 46 38 39 61 %' THEN 'gif' WHEN sx LIKE '42 4D %' THEN 'bmp' "
                    "WHEN sx LIKE '49 49 2A 00 %' OR sx LIKE '4D 4D 00 2A %' THEN 'tiff' WHEN sx LIKE '52 49 46 46 %' AND substr(sx, 25, 12) = '57 45 42 50 ' THEN 'webp' ELSE 'unknown' END AS header FROM x")
    add("byte0_kind_legacy", on_blobs(lambda b: b.select("doc_id", classify.legacy_byte0(F.col("content")).alias("header"))), byte0)
    six = "('jpeg', 'png', 'gif', 'bmp', 'tiff', 'webp')"
    policy = f"h AS ({byte0.split('FROM documents')[0] and byte0[byte0.rindex('SELECT doc_id, CASE'):]}), chosen AS (SELECT x.doc_id, CASE WHEN declared_kind IN {six} THEN declared_kind END AS declared, header FROM x LEFT JOIN exts USING (suffix) JOIN h ON h.doc_id = x.doc_id)"
    chosen = "SELECT doc_id, CASE WHEN declared IS NOT NULL THEN 'extension_trusted' WHEN header <> 'unknown' THEN 'header_used_no_extension' ELSE 'no_extension_no_header_try_all' END AS policy, coalesce(declared, nullif(header, 'unknown'), 'jpeg,png,gif,bmp,tiff,webp') AS kinds FROM chosen"
    add("kind_selection_legacy", on_blobs(legacy.primary), O.query(chosen, policy))
    six_sets = {"jpeg": [K.SOI], "png": [K.PNG], "gif": [K.GIF87, K.GIF89], "bmp": [K.BMP], "tiff": [K.TIFF_LE, K.TIFF_BE], "webp": [K.RIFF]}
    ranks = (O.positions(six_sets, "six") + ", hit AS (SELECT s.doc_id, name, CASE name WHEN 'webp' THEN least(32, len(list_filter(pos, lambda p: p + 12 <= size AND substr(sx, (p + 8) * 3 + 1, 12) = '57 45 42 50 '))) "
             "WHEN 'gif' THEN len(pos) WHEN 'tiff' THEN len(pos) ELSE least(32, len(pos)) END AS n FROM six s JOIN x USING (doc_id)), places AS (SELECT * FROM (VALUES ('jpeg', 0), ('png', 1), ('gif', 2), ('bmp', 3), ('tiff', 4), ('webp', 5)) t(name, i))")
    add("fallback_rank_legacy", on_blobs(legacy.fallback_order), O.query(
        f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY -n, i) AS place, name AS kind, n AS hits FROM hit JOIN places USING (name) JOIN ({chosen}) c USING (doc_id) WHERE NOT list_contains(string_split(kinds, ','), name)", policy, ranks))

    add("summary_legacy", on_blobs(older_groupings), O.query(f"SELECT grouping, key, count(*) AS n FROM (SELECT unnest([{{'grouping': 'by_byte0_kind', 'key': header}}, {{'grouping': 'by_declared_kind', 'key': coalesce(declared, 'none')}}, {{'grouping': 'by_selection_policy', 'key': policy}}], recursive := true) "
        f"FROM chosen JOIN ({chosen}) c USING (doc_id)) GROUP BY ALL", policy))
    add("output_paths_legacy", on_blobs(lambda b: b.select("doc_id", older.output_path(F.col("path"), corpus.declared_kind(F.col("path"))).alias("output_path"))), O.query(
        "SELECT doc_id, CASE WHEN declared_kind IS NULL AND suffix = '' THEN path || '.png' ELSE path END AS output_path FROM x LEFT JOIN exts USING (suffix)"))
    add("capped_attempts_legacy", on_evidence(lambda e: e.attempts().where("ord <= 3").select("doc_id", "ord", "strategy")), O.query("SELECT doc_id, ord, strategy FROM attempts WHERE ord <= 3", *O.RUN))

    for name, build, sql in (("generic", candidates.generic, O.GENERIC), ("video", candidates.video, O.VIDEOS)):
        add(f"candidates_{name}", on_evidence(lambda e, f=build: f(e.with_content(), digest=True).select(*PLAN, "payload_sha256")), O.query(O.payload_hash(), *O.ALL, O.OFFSETS, O.SYNCS, sql))
    for kind in ("png", "gif", "bmp", "tiff", "webp"):
        add(f"candidates_{kind}_legacy", on_blobs(lambda b, k=kind: candidates.legacy(b, k, digest=True).select(*PLAN, "payload_sha256")), O.legacy(kind))
    add("candidates_jpeg_legacy", on_blobs(lambda b: candidates.legacy(b, "jpeg").select(*PLAN)), O.legacy_jpeg())
    for name, lane, sql in (("whole", candidates.jpeg_whole, O.WHOLE), ("soi_eoi", candidates.jpeg_soi, O.FROM_SOI), ("synthetic_soi", candidates.jpeg_synthetic_soi, O.FROM_MARK), ("hints", candidates.jpeg_hints, O.HINTS)):
        add(f"candidates_jpeg_{name}", on_evidence(lambda e, f=lane: candidates.jpeg(e.with_content(), f).select(*PLAN)), O.query(f"SELECT {PLAN_SQL} FROM plans", *O.ALL, O.ANCHORS, O.ranked(sql)))
    add("candidates_jpeg_rebuild", on_evidence(lambda e: rebuild.rebuild_plans(e.with_content())), O.query(O.REBUILT_ROWS, *O.ALL, *O.REBUILD))
    add("nearest_segment", on_blobs(nearest_marker), O.query(
        "SELECT s.doc_id, s.p AS sos, row_number() OVER (PARTITION BY s.doc_id, s.p ORDER BY abs(m.p - s.p), m.p) AS nth, m.p AS marker FROM (SELECT doc_id, unnest(pos) AS p FROM mk WHERE name = 'sos') s "
        "JOIN (SELECT doc_id, unnest(pos) AS p FROM mk WHERE name = 'marker') m USING (doc_id) QUALIFY nth <= 2", O.positions({"sos": [K.SOS], "marker": [K.DQT, K.DHT, *K.SOF]}, "mk")))
    add("previous_marker", on_blobs(previous_marker), O.query(
        "SELECT s.doc_id, s.p AS sos, m.p AS marker FROM (SELECT doc_id, unnest(pos) AS p FROM mk WHERE name = 'sos') s ASOF LEFT JOIN (SELECT doc_id, unnest(pos) AS p FROM mk WHERE name = 'marker') m ON s.doc_id = m.doc_id AND s.p >= m.p",
        O.positions({"sos": [K.SOS], "marker": [K.SOI, K.APP0, K.APP1, K.DQT, K.DHT, *K.SOF]}, "mk")))
    add("candidate_dedupe", on_evidence(deduped), O.query("SELECT doc_id, count(*) AS plans FROM plans GROUP BY doc_id", *O.RUN))
    add("shared_payloads", on_evidence(shared_payloads), O.query(
        f"SELECT payload_sha256, count(*) AS plans, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, payload_sha256 FROM ({O.payload_hash('generic')}) UNION ALL SELECT doc_id, payload_sha256 FROM ({O.payload_hash('video')}) "
        f"UNION ALL SELECT doc_id, payload_sha256 FROM ({O.payload_hash('jpeg')}) UNION ALL SELECT doc_id, payload_sha256 FROM ({O.REBUILT_ROWS})) GROUP BY ALL", *O.RUN))

    add("byte_entropy", on_blobs(lambda b: b.select("doc_id", F.round(B.entropy(F.col("content")), 6).alias("entropy"))), O.query(
        "SELECT x.doc_id, round(coalesce(e.entropy, 0), 6) AS entropy FROM x LEFT JOIN (SELECT doc_id, sum(-n / size::DOUBLE * log2(n / size::DOUBLE)) AS entropy FROM (SELECT doc_id, size, b, count(*) AS n FROM (SELECT doc_id, size, unnest(string_split(rtrim(sx), ' ')) AS b FROM x WHERE size > 0) GROUP BY ALL) GROUP BY doc_id) e USING (doc_id)"))
    add("compact_error", errors, r"SELECT doc_id, CASE WHEN length(j) > 400 THEN substr(j, 1, 397) || '...' ELSE j END AS error FROM (SELECT doc_id, array_to_string((list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''))[1:4], ' | ') AS j FROM documents)")
    score = 'SELECT doc_id, ord, strategy, ok, round(score, 4) AS score FROM attempts WHERE class_family {} IN ' + O.VIDEO
    for name, is_video in (("score_image", False), ("score_video", True)):
        add(name, on_evidence(lambda e, v=is_video: e.attempts().where(F.col("class_family").isin(K.VIDEO_KINDS) == F.lit(v)).select("doc_id", "ord", "strategy", "ok", F.round("score", 4).alias("score"))), O.query(score.format("" if is_video else "NOT"), *O.RUN))
    picked = ["doc_id", "ord", "strategy", "width", "height"]
    add("winner", on_evidence(lambda e: scoring.winners(e.attempts()).select(*picked, F.round("score", 4).alias("score"))), O.query(f"SELECT {', '.join(picked)}, round(score, 4) AS score FROM won", *O.RUN))
    add("winner_legacy", on_evidence(lambda e: scoring.largest(e.attempts()).select(*picked)), O.query(f"SELECT {', '.join(picked)} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY width * height DESC, ord) AS r FROM attempts WHERE ok) WHERE r = 1", *O.RUN))
    add("probe_fallback", on_evidence(lambda e: scoring.fallback(e.attempts()).select("doc_id", "ord", "strategy")), O.query(
        f"SELECT doc_id, ord, strategy FROM attempts WHERE class_family NOT IN {O.VIDEO} AND ord <= 12 AND doc_id NOT IN (SELECT doc_id FROM attempts WHERE ok)", *O.RUN))
    add("final_attempts", on_evidence(lambda e: scoring.final_attempts(scoring.winners(e.attempts())).select("doc_id", "ord", "phase")), O.query("SELECT doc_id, ord, phase || '_final' AS phase FROM won", *O.RUN))
    add("persisted_scores", on_evidence(lambda e: e.attempts().select("doc_id", "ord", F.round(scoring.persisted_score(F.col("score")), 4).alias("score"))), O.query("SELECT doc_id, ord, round(CASE WHEN score = 0 THEN '-Infinity'::DOUBLE ELSE score END, 4) AS score FROM attempts", *O.RUN))
    add("engine_gate", on_classified(lambda c: scoring.gate(c, "jpeg-v1")), O.query("SELECT doc_id, 'no_engine_for_family:' || family AS error FROM classified WHERE family <> 'jpeg'", *O.ALL))
    images = "(" + ", ".join(f"'{k}'" for k in K.IMAGE_KINDS) + ")"
    add("output_targets", on_classified(lambda c: c.select("doc_id", scoring.output_kind(F.col("declared_kind"), F.col("byte0_kind"), F.col("family")).alias("output_kind"), scoring.output_path(F.col("path"), F.col("family")).alias("output_path"))), O.query(
        f"SELECT doc_id, CASE WHEN declared_kind IN {images} THEN declared_kind WHEN byte0_kind IN {images} THEN byte0_kind WHEN family IN {images} THEN family ELSE 'png' END AS output_kind, "
        f"CASE WHEN family IN {O.VIDEO} THEN regexp_replace(path, '\\.[^./]*$', '') || CASE family WHEN 'mpegts' THEN '.ts' WHEN 'mpegps' THEN '.mpg' ELSE '.mkv' END ELSE path END AS output_path FROM classified", *O.ALL))

    add("summary_totals", on_evidence(lambda e: report.totals(e.classified(), e.outputs())), O.query("SELECT count(*) AS total_files, sum(success)::BIGINT AS recovered, greatest(0, count(*) - sum(success))::BIGINT AS failed FROM outputs", *O.RUN))
    by = "SELECT coalesce({0}, 'none') AS key, count(*) AS n FROM {1} GROUP BY ALL"
    for name, key in (("by_classification", "label"), ("by_family", "family"), ("by_anywhere_kind", "anywhere_kind"), ("by_declared_kind", "declared_kind")):
        add(name, on_classified(lambda c, k=key: report.by(c, k)), O.query(by.format(key, "classified"), *O.ALL))
    for name, key in (("by_decoder", "decoder"), ("by_strategy", "strategy")):
        add(name, on_evidence(lambda e, k=key: report.by(e.outputs(), k, "success = 1")), O.query(by.format(key, "outputs WHERE success = 1"), *O.RUN))
    kind_of = lambda: F.when(F.col("family").isin(K.VIDEO_KINDS), "video").otherwise("image")
    add("by_output_type", on_evidence(lambda e: report.by(e.outputs(), kind_of(), "success = 1")), O.query(by.format(f"CASE WHEN family IN {O.VIDEO} THEN 'video' ELSE 'image' END", "outputs WHERE success = 1"), *O.RUN))
    add("top_errors", on_evidence(lambda e: report.by(e.outputs(), "error", "success = 0")), O.query(by.format("error", "outputs WHERE success = 0"), *O.RUN))
    add("top_errors_legacy", on_evidence(lambda e: report.by(e.outputs(), "error", "success = 0").limit(legacy.MOST_ERRORS)), O.query(by.format("error", "outputs WHERE success = 0") + f" ORDER BY n DESC, key LIMIT {legacy.MOST_ERRORS}", *O.RUN))
    add("one_pass_counts", on_classified(one_pass_counts), O.query("SELECT label, family, anywhere_kind, count(*) AS n FROM classified GROUP BY GROUPING SETS ((label), (family), (anywhere_kind))", *O.ALL))
    shown = ["path", "ord", "strategy", "family", "priority", "phase", "decoder", "ok", "width", "height", "duration_ms", "frame_count", "score", "error"]
    add("attempts_report", on_evidence(lambda e: (lambda a: report.attempt_rows(a, e.classified(), e.plans()).withColumn("score", F.round("score", 4)))(e.attempts())), O.query(
        f"SELECT {', '.join('a.ok::INT AS ok' if s == 'ok' else 'c.path' if s == 'path' else 'round(a.score, 4) AS score' if s == 'score' else 'a.' + s for s in shown)} FROM attempts a JOIN classified c ON c.doc_id = a.doc_id", *O.RUN))
    add("recommendations", on_evidence(lambda e: legacy.recommendations(e.told())), O.query(O.ADVICE, *O.RUN, O.STATE))
    add("next_ideas", on_evidence(lambda e: legacy.next_ideas(e.told())), O.query(O.ideas(chosen), *O.RUN, O.STATE, policy, ranks))
