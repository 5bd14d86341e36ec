"""DuckDB SQL that says what the queries say, put together from shared common table expressions."""
from __future__ import annotations

from mendframe.functions import jpeg_tables as J
from mendframe.functions import kinds as K
from mendframe.operators import legacy as legacy_rules
from mendframe.operators.signatures import LEGACY_COUNTS, OTHER_COUNTS
from mendframe.sources.corpus import VARIANTS


def spaced(hexadecimal: str) -> str:
    """Hexadecimal with a blank after each byte, so that searches keep to whole bytes."""
    return "".join(hexadecimal[i : i + 2] + " " for i in range(0, len(hexadecimal), 2))


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def count(hexadecimal: str) -> str:
    h = spaced(hexadecimal)
    return f"(length(sx) - length(replace(sx, '{h}', ''))) // {len(h)}"


def count_any(needles: list[str]) -> str:
    return "(" + " + ".join(count(n) for n in needles) + ")::BIGINT"


def sample(pos: str, limit: int) -> str:
    rest = max(0, limit - 6)
    spread = f"list_transform(range(0, {rest}), lambda i: round_even(i * ((len({pos}) - 1)::DOUBLE / {rest}), 0)::BIGINT)" if rest else "[]::BIGINT[]"
    ends = f"list_filter([0, 1, 2, len({pos}) - 3, len({pos}) - 2, len({pos}) - 1], lambda i: i >= 0 AND i < len({pos}))"
    return f"CASE WHEN len({pos}) <= {limit} THEN {pos} ELSE list_transform(list_sort(list_distinct(list_concat({ends}, {spread}))), lambda i: {pos}[i + 1]) END"


def positions(sets: dict[str, list[str]], name: str = "pos", source: str = "x") -> str:
    """A table of (doc_id, name, pos): ascending positions of any needle of a set, empty lists where there are none."""
    needles = values([(s, spaced(n), len(n) // 2) for s, ns in sets.items() for n in ns])
    return f"""{name}_parts AS (
  SELECT doc_id, name, k, string_split(sx, needle) AS ps FROM {source} CROSS JOIN (VALUES {needles}) n(name, needle, k)
), {name} AS (
  SELECT doc_id, name, list_sort(list_distinct(flatten(list(p)))) AS pos
  FROM (SELECT doc_id, name, list_transform(range(1, len(ps)), lambda i: (list_sum(list_transform(ps[1:i], lambda s: length(s))) // 3 + (i - 1) * k)::BIGINT) AS p FROM {name}_parts)
  GROUP BY doc_id, name
)"""


BLOBS = f"""v AS (SELECT * FROM (VALUES {values([(i, *v) for i, v in enumerate(VARIANTS)])}) t(variant, ext, pre, suf)
), blobs AS (
  SELECT d.doc_id, v.variant, 'f' || lpad(d.doc_id::VARCHAR, 6, '0') || v.ext AS path, from_hex(v.pre) || encode(coalesce(d.text, '')) || from_hex(v.suf) AS content
  FROM documents d JOIN v ON d.doc_id % {len(VARIANTS)} = v.variant
), x AS (
  SELECT *, octet_length(content)::BIGINT AS size, regexp_replace(hex(content), '(..)', '\\1 ', 'g') AS sx, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS suffix FROM blobs
), exts AS (SELECT * FROM (VALUES {values(sorted(K.KIND_OF_EXTENSION.items()))}) t(suffix, declared_kind))"""

SIMPLE = values([(family, kind, first, other) for family, kind, _, first, other in K.SIGNATURES])
BRANDS = "CASE brand " + " ".join(f"WHEN '{b}' THEN '{k}'" for b, k in K.KIND_OF_BRAND.items()) + " ELSE 'mp4' END"
HITS = (
    positions({**{family: ns for family, _, ns, _, _ in K.SIGNATURES}, "riff": [K.RIFF], "ftyp": [K.FTYP], "ebml": [K.EBML]})
    + f""", sampled AS (SELECT doc_id, name, {sample("pos", K.HITS_PER_TYPE)} AS s FROM pos
), spots AS (SELECT doc_id, name, unnest(s)::BIGINT AS p FROM sampled
), simple AS (SELECT * FROM (VALUES {SIMPLE}) t(family, signature_type, first, other)
), sync AS (
  SELECT doc_id, arg_min(phase, (-n, phase)) AS phase, max(n) AS n FROM (
    SELECT doc_id, q % {K.TS_PACKET} AS phase, count(*) AS n FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[1:i], lambda s: length(s))) // 3 + (i - 1)))::BIGINT AS q
      FROM (SELECT doc_id, string_split(substr(sx, 1, {3 * K.TS_WINDOW}), '47 ') AS ps FROM x)) GROUP BY ALL) GROUP BY doc_id
), raw_hits AS (
  SELECT doc_id, family, signature_type, p AS "offset", CASE WHEN p = 0 THEN first ELSE other END::DOUBLE AS confidence FROM spots JOIN simple ON name = family
  UNION ALL
  SELECT doc_id, CASE b WHEN '57 45 42 50 ' THEN 'webp' ELSE 'avi' END, CASE b WHEN '57 45 42 50 ' THEN 'riff_webp' ELSE 'riff_avi' END, p,
         CASE WHEN p > 0 THEN 0.90 WHEN b = '57 45 42 50 ' THEN 0.99 ELSE 0.98 END
  FROM (SELECT spots.doc_id, p, substr(sx, (p + 8) * 3 + 1, 12) AS b FROM spots JOIN x USING (doc_id) WHERE name = 'riff' AND p + 12 <= size) WHERE b IN ('57 45 42 50 ', '41 56 49 20 ')
  UNION ALL
  SELECT doc_id, {BRANDS}, 'ftyp:' || CASE WHEN trim(brand) = '' THEN 'unknown' ELSE trim(brand) END, p - 4, CASE WHEN p = 4 THEN 0.99 ELSE 0.90 END
  FROM (SELECT spots.doc_id, p, decode(from_hex(replace(substr(sx, (p + 4) * 3 + 1, 12), ' ', ''))) AS brand FROM spots JOIN x USING (doc_id) WHERE name = 'ftyp' AND p >= 4 AND p + 8 <= size)
  UNION ALL
  SELECT spots.doc_id, CASE WHEN regexp_matches(substr(sx, p * 3 + 1, 384), '[57]7 [46]5 [46]2 [46]D ') THEN 'webm' ELSE 'mkv' END, 'ebml', p, CASE WHEN p = 0 THEN 0.98 ELSE 0.90 END
  FROM spots JOIN x USING (doc_id) WHERE name = 'ebml'
  UNION ALL
  SELECT doc_id, 'mpegts', 'ts_sync', phase, least(0.99::DOUBLE, 0.6::DOUBLE + n / 20.0::DOUBLE) FROM sync WHERE n >= {K.TS_LEAST}
), hits AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "offset", confidence DESC, family, signature_type) - 1 AS hit_no FROM raw_hits
), found AS (
  SELECT doc_id, arg_min(family, (-confidence, "offset", family)) AS anywhere_kind, arg_min(family, hit_no) FILTER ("offset" = 0) AS byte0, bool_or(family = 'jpeg') AS any_jpeg
  FROM hits GROUP BY doc_id
)"""
)
MARKERS = {
    "soi_count": [K.SOI], "eoi_count": [K.EOI], "sos_count": [K.SOS], "dqt_count": [K.DQT], "dht_count": [K.DHT], "app0_count": [K.APP0], "app1_count": [K.APP1],
    "sof_count": K.SOF, "rst_count": K.RST,
}
MARKED = f"""marked AS (SELECT *, sos_count + dqt_count + dht_count + sof_count + app0_count + app1_count AS internal_marker_count FROM (
  SELECT doc_id, {", ".join(f"{count_any(ns)} AS {c}" for c, ns in MARKERS.items())} FROM x))"""
RECORDS = """records AS (
  SELECT x.doc_id, x.path, x.size, sha256(x.content) AS sha256, declared_kind, coalesce(byte0, 'unknown') AS byte0_kind, coalesce(anywhere_kind, 'unknown') AS anywhere_kind, coalesce(any_jpeg, false) AS any_jpeg
  FROM x LEFT JOIN exts USING (suffix) LEFT JOIN found ON found.doc_id = x.doc_id
)"""
BOXES = "('mp4', 'mov', 'heif', 'avif', 'jp2')"
CLASSIFIED = f"""signs AS (
  SELECT *, coalesce(declared_kind = 'jpeg', false) AS is_declared, byte0_kind = 'jpeg' AS is_byte0,
         any_jpeg OR (sos_count > 0 AND (dqt_count > 0 OR dht_count > 0 OR sof_count > 0 OR rst_count > 0)) AS is_internal,
         CASE WHEN anywhere_kind <> 'unknown' THEN anywhere_kind WHEN byte0_kind <> 'unknown' THEN byte0_kind ELSE declared_kind END AS inferred
  FROM records JOIN marked USING (doc_id)
), weighed AS (
  SELECT *, is_declared OR is_byte0 OR is_internal AS is_jpeg,
         least(0.99::DOUBLE, CASE WHEN is_declared THEN 0.45 ELSE 0 END::DOUBLE + CASE WHEN is_byte0 THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN is_internal THEN 0.25 ELSE 0 END::DOUBLE
           + CASE WHEN soi_count > 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN sos_count > 0 THEN 0.15 ELSE 0 END::DOUBLE) AS jpeg_evidence FROM signs
), labelled AS (
  SELECT *, CASE WHEN is_jpeg THEN 'jpeg' ELSE coalesce(inferred, 'unknown') END AS family,
    CASE WHEN is_jpeg THEN CASE WHEN soi_count = 0 AND internal_marker_count > 0 THEN 'jpeg_missing_soi_internal_structure' WHEN soi_count > 0 AND eoi_count = 0 THEN 'jpeg_missing_eoi'
        WHEN sos_count > 0 AND dht_count = 0 THEN 'jpeg_missing_dht' WHEN soi_count > 0 AND sos_count > 0 THEN 'jpeg_structural_salvage_candidate'
        WHEN internal_marker_count > 0 THEN 'jpeg_internal_weak_signal' ELSE 'jpeg_low_signal' END
      WHEN inferred IN {BOXES} THEN CASE WHEN byte0_kind = 'unknown' AND anywhere_kind IN {BOXES} THEN 'isobmff_signature_away_from_byte0' ELSE 'isobmff_container_candidate' END
      WHEN inferred IN ('mkv', 'webm') THEN CASE WHEN byte0_kind = 'unknown' AND anywhere_kind IN ('mkv', 'webm') THEN 'ebml_signature_away_from_byte0' ELSE 'ebml_container_candidate' END
      WHEN inferred = 'avi' THEN CASE WHEN byte0_kind = 'unknown' AND anywhere_kind = 'avi' THEN 'riff_avi_signature_away_from_byte0' ELSE 'riff_avi_candidate' END
      WHEN inferred = 'mpegts' THEN CASE WHEN byte0_kind <> 'mpegts' THEN 'mpegts_desync_or_partial_packets' ELSE 'mpegts_candidate' END
      WHEN inferred IN ('mpegps', 'flv', 'asf', 'wmv') THEN inferred || '_container_candidate'
      WHEN inferred IN ('png', 'gif', 'bmp', 'tiff', 'webp', 'raw') THEN inferred || '_detected_candidate' ELSE 'unknown_low_signal' END AS label
  FROM weighed
), classified AS (
  SELECT *, CASE label WHEN 'jpeg_missing_soi_internal_structure' THEN round(greatest(jpeg_evidence, 0.82), 4) WHEN 'jpeg_missing_eoi' THEN round(greatest(jpeg_evidence, 0.85), 4)
      WHEN 'jpeg_missing_dht' THEN round(greatest(jpeg_evidence, 0.84), 4) WHEN 'jpeg_structural_salvage_candidate' THEN round(greatest(jpeg_evidence, 0.75), 4)
      WHEN 'jpeg_internal_weak_signal' THEN round(greatest(jpeg_evidence, 0.65), 4) WHEN 'jpeg_low_signal' THEN round(greatest(jpeg_evidence, 0.5), 4)
      WHEN 'isobmff_signature_away_from_byte0' THEN 0.82 WHEN 'isobmff_container_candidate' THEN 0.72 WHEN 'ebml_signature_away_from_byte0' THEN 0.8 WHEN 'ebml_container_candidate' THEN 0.7
      WHEN 'riff_avi_signature_away_from_byte0' THEN 0.79 WHEN 'riff_avi_candidate' THEN 0.69 WHEN 'mpegts_desync_or_partial_packets' THEN 0.86 WHEN 'mpegts_candidate' THEN 0.75
      WHEN 'unknown_low_signal' THEN 0.2 ELSE CASE WHEN label LIKE '%_container_candidate' THEN 0.7 ELSE 0.65 END END::DOUBLE AS confidence FROM labelled
)"""


def query(select: str, *tables: str) -> str:
    return f"WITH RECURSIVE {', '.join((BLOBS, *tables))}\n{select}"


ALL = (HITS, MARKED, RECORDS, CLASSIFIED)
VIDEO = "(" + ", ".join(f"'{k}'" for k in K.VIDEO_KINDS) + ")"

# plan rows: made (the order of generation), then ranked; equal plans keep their first place
PLAN_COLUMNS = "strategy, priority, kind, start, \"end\", prepend, append"


def ranked(made: str, name: str = "plans", order: str = "priority DESC, strategy, made") -> str:
    return f"""{name}_made AS ({made}
), {name} AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS ord
  FROM (SELECT doc_id, family, {PLAN_COLUMNS}, min(made) AS made FROM {name}_made GROUP BY ALL)
)"""


def payload_hash(plans: str = "plans") -> str:
    core = "substr(sx, start * 3 + 1, greatest(coalesce(\"end\", size) - start, 0) * 3)"
    return f"SELECT p.doc_id, ord, family, {PLAN_COLUMNS}, sha256(from_hex(prepend || replace({core}, ' ', '') || append)) AS payload_sha256 FROM {plans} p JOIN x ON x.doc_id = p.doc_id"


OFFSETS = f"""offsets AS (
  SELECT doc_id, unnest({sample("pos", 8)}) AS p FROM (
    SELECT c.doc_id, list_sort(list_distinct(list(h."offset"))) AS pos FROM classified c JOIN hits h ON h.doc_id = c.doc_id AND h.family = c.family GROUP BY c.doc_id)
)"""
GENERIC = ranked(f"""
  SELECT doc_id, family, 'full_file' AS strategy, 100 AS priority, 'slice' AS kind, 0 AS start, NULL::BIGINT AS "end", '' AS prepend, '' AS append, 0 AS made FROM classified WHERE family <> 'jpeg' AND family NOT IN {VIDEO}
  UNION ALL SELECT doc_id, family, 'signature_offset_to_end', CASE WHEN p > 0 THEN 96 ELSE 99 END, 'slice', p, NULL, '', '', 1 + p FROM classified JOIN offsets USING (doc_id) WHERE family <> 'jpeg' AND family NOT IN {VIDEO}
""")
SYNCS = f"""syncs AS (
  SELECT doc_id, unnest({sample("pos", 8)}) AS p FROM (
    SELECT doc_id, list_transform(range(1, len(ps)), lambda i: (list_sum(list_transform(ps[1:i], lambda s: length(s))) // 3 + (i - 1))::BIGINT) AS pos
    FROM (SELECT doc_id, string_split(substr(sx, 1, {3 * K.TS_WINDOW}), '47 ') AS ps FROM x))
)"""
MOVED = "CASE WHEN p > 0 THEN 'container_rebuild_plan' ELSE 'slice' END"
VIDEOS = ranked(f"""
  SELECT doc_id, family, 'full_file' AS strategy, 100 AS priority, 'slice' AS kind, 0 AS start, NULL::BIGINT AS "end", '' AS prepend, '' AS append, 0 AS made FROM classified WHERE family IN {VIDEO}
  UNION ALL SELECT doc_id, family, 'signature_offset_to_end', CASE WHEN p > 0 THEN 99 ELSE 100 END, {MOVED}, p, NULL, '', '', 1 + p FROM classified JOIN offsets USING (doc_id) WHERE family IN {VIDEO}
  UNION ALL SELECT doc_id, family, 'ts_sync_offset_to_end', CASE WHEN p > 0 THEN 101 ELSE 100 END, {MOVED}, p, NULL, '', '', 1 + p FROM classified JOIN syncs USING (doc_id) WHERE family = 'mpegts'
""")
ANCHORS = (
    positions({"soi": [K.SOI], "eoi": [K.EOI], "sos": [K.SOS], "marker": [*K.APP, K.DQT, K.DHT, K.DRI, *K.SOF, K.SOS], "rst": K.RST}, "anchor", "(SELECT x.* FROM x JOIN classified USING (doc_id) WHERE family = 'jpeg')")
    + ", eois AS (SELECT doc_id, pos AS ends FROM anchor WHERE name = 'eoi')"
)


def later(limit: int, of: str = "p") -> str:
    return sample(f"list_filter(ends, lambda e: e > {of})", limit)


def plan_rows(select: str, strategy: str, priority: int, kind: str, start: str, end: str = "NULL", prepend: str = "", append: str = "", made: str = "0") -> str:
    return f"SELECT doc_id, 'jpeg' AS family, {strategy} AS strategy, {priority} AS priority, '{kind}' AS kind, ({start})::BIGINT AS start, ({end})::BIGINT AS \"end\", '{prepend}' AS prepend, '{append}' AS append, ({made})::BIGINT AS made FROM {select}"


JPEGS = "(SELECT doc_id FROM classified WHERE family = 'jpeg')"
NEW = "synthetic_header"
WHOLE = " UNION ALL ".join([
    plan_rows(JPEGS, "'full_file'", 100, "slice", "0"), plan_rows(JPEGS, "'prepend_soi_full'", 98, NEW, "0", prepend=K.SOI), plan_rows(JPEGS, "'append_eoi_full'", 97, NEW, "0", append=K.EOI),
    plan_rows(JPEGS, "'prepend_soi_append_eoi_full'", 96, NEW, "0", prepend=K.SOI, append=K.EOI),
])
SOIS = f"(SELECT a.doc_id, unnest({sample('pos', 16)}) AS p FROM anchor a WHERE name = 'soi')"
SOI_ENDS = f"(SELECT s.doc_id, p, unnest({later(6)}) AS e FROM {SOIS} s JOIN eois USING (doc_id))"
SOI_TAILS = f"(SELECT s.doc_id, p, n, least(size, p + n) AS e FROM {SOIS} s JOIN x USING (doc_id) CROSS JOIN (VALUES (65536), (262144), (1048576), (4194304)) t(n) WHERE least(size, p + n) - p >= 128)"
FROM_SOI = " UNION ALL ".join([
    plan_rows(SOI_ENDS, "'soi_to_sampled_eoi'", 95, "slice", "p", "e + 2", made="p * 100000000 + e"), plan_rows(SOIS, "'soi_to_end'", 94, "slice", "p", made="p"),
    plan_rows(SOIS, "'soi_to_end_append_eoi'", 93, NEW, "p", append=K.EOI, made="p"), plan_rows(SOI_TAILS, "'soi_tail_' || n", 92, "slice", "p", "e", made="p"),
    plan_rows(SOI_TAILS, "'soi_tail_' || n || '_append_eoi'", 91, NEW, "p", "e", append=K.EOI, made="p"),
])
MARKS = f"(SELECT doc_id, p, b FROM (SELECT doc_id, unnest({sample('pos', 32)}) AS p FROM anchor WHERE name = 'marker') CROSS JOIN (VALUES (0), (128), (512), (2048), (8192), (32768), (131072)) t(b))"
MARK_ENDS = f"(SELECT doc_id, p, b, unnest({later(3)}) AS e FROM {MARKS} JOIN eois USING (doc_id))"
BEFORE = "greatest(0, p - b)"
FROM_MARK = " UNION ALL ".join([
    plan_rows(MARKS, "'synthetic_soi_back_' || b", 88, NEW, BEFORE, prepend=K.SOI, made="p"), plan_rows(MARKS, "'synthetic_soi_back_' || b || '_append_eoi'", 87, NEW, BEFORE, prepend=K.SOI, append=K.EOI, made="p"),
    plan_rows(MARK_ENDS, "'synthetic_soi_back_' || b || '_to_eoi'", 86, NEW, BEFORE, "e + 2", prepend=K.SOI, made="p * 100000000 + e"),
])
HINT_MARKS = f"(SELECT doc_id, p, b FROM (SELECT a.doc_id, unnest(({sample('pos', 32)})[1:16]) AS p FROM anchor a JOIN classified c ON c.doc_id = a.doc_id WHERE name = 'marker' AND label = 'jpeg_missing_soi_internal_structure') CROSS JOIN (VALUES (512), (2048), (8192), (32768)) t(b))"
HINTS = " UNION ALL ".join([
    plan_rows("classified WHERE label = 'jpeg_missing_eoi'", "'classification_hint_append_eoi'", 105, NEW, "0", append=K.EOI),
    plan_rows(HINT_MARKS, "'classification_hint_synthetic_soi_back_' || b", 106, NEW, BEFORE, prepend=K.SOI, made="p"),
])
# lanes that walk over segments: header segments from left to right, options of headers near a marker, scans
HEADERS = [K.DQT, K.DHT, K.DRI, K.COM, *K.APP, *K.SOF]
SPAN = "replace(substr(sx, {0} * 3 + 1, ({1}) * 3), ' ', '')"
STANDARD = values(
    [(parts, f"std_{J.shade(parts)}_q{q}", J.quantisation(parts, q).hex().upper(), q, "dqt") for parts in (1, 3) for q in J.QUALITIES]
    + [(parts, f"std_{J.shade(parts)}", J.huffman(parts).hex().upper(), 0, "dht") for parts in (1, 3)]
)
JPEG_ROWS = "(SELECT x.* FROM x JOIN classified USING (doc_id) WHERE family = 'jpeg')"
WALK = f"""standard AS (SELECT * FROM (VALUES {STANDARD}) t(parts, label, blob, quality, name)
), jx AS (SELECT x.doc_id, x.sx, x.size, c.label, sx LIKE '%FF D9 ' AS closed FROM x JOIN classified c ON c.doc_id = x.doc_id WHERE c.family = 'jpeg'
), {positions({m: [m] for m in HEADERS}, "heads", JPEG_ROWS)}, spans AS (
  SELECT doc_id, name AS marker, p, p + 2 + ('0x' || substr(sx, (p + 2) * 3 + 1, 2))::BIGINT * 256 + ('0x' || substr(sx, (p + 3) * 3 + 1, 2))::BIGINT AS stop
  FROM (SELECT doc_id, name, unnest(pos) AS p FROM heads) JOIN jx USING (doc_id) WHERE p + 4 <= size
), whole AS (SELECT s.doc_id, marker, p, stop FROM spans s JOIN jx USING (doc_id) WHERE stop >= p + 4 AND stop <= size
), walked AS (
  SELECT doc_id, min(p) AS p, arg_min(stop, p) AS stop, arg_min(marker, p) AS marker FROM whole GROUP BY doc_id
  UNION ALL SELECT w.doc_id, min(s.p), arg_min(s.stop, s.p), arg_min(s.marker, s.p) FROM walked w JOIN whole s ON s.doc_id = w.doc_id AND s.p >= w.stop GROUP BY w.doc_id, w.p
), segments AS (
  SELECT w.doc_id, marker, p, stop, {SPAN.format("p", "stop - p")} AS blob, row_number() OVER (PARTITION BY w.doc_id, marker ORDER BY p) AS nth FROM walked w JOIN jx USING (doc_id) QUALIFY nth <= 12
), scans AS (SELECT doc_id, unnest({sample("pos", 16)})::BIGINT AS sos, generate_subscripts({sample("pos", 16)}, 1) AS scan_no FROM anchor WHERE name = 'sos'
), lists AS (
  SELECT jx.doc_id, coalesce(e.pos, []) AS ends, coalesce(r.pos, []) AS rst, coalesce(m.pos, []) AS marks FROM jx LEFT JOIN (SELECT * FROM anchor WHERE name = 'eoi') e USING (doc_id)
  LEFT JOIN (SELECT * FROM anchor WHERE name = 'rst') r USING (doc_id) LEFT JOIN (SELECT * FROM anchor WHERE name = 'marker') m USING (doc_id)
), bare AS (
  SELECT jx.doc_id, coalesce(({sample("marks", 32)})[1], 0)::BIGINT AS target FROM jx JOIN lists USING (doc_id) WHERE label = 'jpeg_missing_soi_internal_structure' AND doc_id NOT IN (SELECT doc_id FROM scans)
), targets AS (SELECT doc_id, sos AS target FROM scans UNION SELECT doc_id, target FROM bare)"""
SOFS = "(" + ", ".join(f"'{m}'" for m in K.SOF) + ")"
APPS = "(" + ", ".join(f"'{m}'" for m in K.APP) + ")"
NEAR = "row_number() OVER (PARTITION BY {0} ORDER BY abs({1} - p), p)"
OPTIONS = f"""near AS (SELECT t.doc_id, target, p, stop, blob FROM targets t JOIN segments s USING (doc_id) WHERE marker IN {SOFS} QUALIFY {NEAR.format("t.doc_id, target, marker", "target")} <= 2
), frames AS (
  SELECT *, {NEAR.format("doc_id, target", "target")} AS frame_no, CASE WHEN length(blob) >= 20 AND length(blob) // 2 >= 10 + 3 * n THEN greatest(1, n) ELSE 1 END AS parts, CASE WHEN length(blob) >= 20 AND length(blob) // 2 >= 10 + 3 * n THEN n ELSE 0 END AS ids
  FROM (SELECT *, CASE WHEN length(blob) >= 20 THEN ('0x' || substr(blob, 19, 2))::INT ELSE 0 END AS n FROM near QUALIFY {NEAR.format("doc_id, target, blob", "target")} = 1) QUALIFY frame_no <= 4
), apps AS (
  SELECT doc_id, target, frame_no, string_agg(blob, '' ORDER BY marker) AS app FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, target, frame_no ORDER BY marker) AS app_no FROM (
      SELECT f.doc_id, target, frame_no, s.marker, s.blob FROM frames f JOIN segments s USING (doc_id) WHERE s.marker IN {APPS}
      QUALIFY row_number() OVER (PARTITION BY f.doc_id, target, frame_no, s.marker ORDER BY abs(f.p - s.p), s.p) = 1) QUALIFY app_no <= 2) GROUP BY ALL
), restarts AS (
  SELECT f.doc_id, target, frame_no, s.blob AS dri FROM frames f JOIN segments s USING (doc_id) WHERE s.marker = '{K.DRI}' QUALIFY row_number() OVER (PARTITION BY f.doc_id, target, frame_no ORDER BY abs(f.p - s.p), s.p) = 1
), found_tables AS (SELECT doc_id, CASE marker WHEN '{K.DQT}' THEN 'dqt' ELSE 'dht' END AS name, list(blob ORDER BY nth) AS found FROM segments WHERE marker IN ('{K.DQT}', '{K.DHT}') GROUP BY ALL
), offered AS (
  SELECT f.doc_id, target, frame_no, t.name, 'found_' || t.name || '_' || l.many AS label, array_to_string(found[1:l.many], '') AS blob, l.i AS place FROM frames f JOIN found_tables t USING (doc_id)
  CROSS JOIN LATERAL (SELECT unnest(ns) AS many, generate_subscripts(ns, 1) AS i FROM (SELECT CASE t.name WHEN 'dqt' THEN [CASE WHEN parts > 1 THEN 2 ELSE 1 END, 1, 2, 4] ELSE [CASE WHEN parts > 1 THEN 4 ELSE 2 END, 2, 4, 1] END AS ns)) l WHERE l.many <= len(found)
  UNION ALL SELECT f.doc_id, target, frame_no, s.name, s.label, s.blob, 10 + s.quality FROM frames f JOIN standard s ON s.parts = CASE WHEN f.parts > 1 THEN 3 ELSE 1 END
), ranked_tables AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, target, frame_no, name ORDER BY place) AS table_no FROM (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY doc_id, target, frame_no, name, blob ORDER BY place) = 1)
), options AS (
  SELECT f.doc_id, f.target, f.p AS sof_at, f.stop AS sof_end, f.blob AS sof, f.ids, coalesce(app, '{J.JFIF.hex().upper()}') AS app, q.blob AS dqt, h.blob AS dht, coalesce(dri, '') AS dri, q.label || '__' || h.label AS profile,
         row_number() OVER (PARTITION BY f.doc_id, f.target ORDER BY f.frame_no, q.table_no, h.table_no) AS option_no
  FROM frames f JOIN ranked_tables q ON q.doc_id = f.doc_id AND q.target = f.target AND q.frame_no = f.frame_no AND q.name = 'dqt' AND q.table_no <= 3
  JOIN ranked_tables h ON h.doc_id = f.doc_id AND h.target = f.target AND h.frame_no = f.frame_no AND h.name = 'dht' AND h.table_no <= 2
  LEFT JOIN apps a ON a.doc_id = f.doc_id AND a.target = f.target AND a.frame_no = f.frame_no LEFT JOIN restarts r ON r.doc_id = f.doc_id AND r.target = f.target AND r.frame_no = f.frame_no QUALIFY option_no <= 18
), headed AS (SELECT *, '{K.SOI}' || app || dqt || sof || dht || dri AS header, '{K.SOI}' || dqt || sof || dht || dri AS minimal FROM options)"""


def windows(starts: str, ends: int, least: int) -> str:
    """Rows of starts (doc_id, start) with window ends and tails, in order: sampled ends of image, fixed lengths, the end."""
    return f"""SELECT w.*, row_number() OVER (PARTITION BY doc_id, start ORDER BY k, w."end") AS window_no FROM (
    SELECT doc_id, start, e + 2 AS "end", '' AS tail, 1 AS k FROM (SELECT s.doc_id, start, unnest({sample("list_filter(ends, lambda e: e > start)", ends)}) AS e FROM {starts} s JOIN lists USING (doc_id)) WHERE e + 2 - start >= {least}
    UNION ALL SELECT DISTINCT s.doc_id, start, least(size, start + n), '{K.EOI}', 2 FROM {starts} s JOIN jx USING (doc_id) CROSS JOIN (VALUES (65536), (262144), (1048576), (4194304)) t(n) WHERE least(size, start + n) - start >= 128
    UNION ALL SELECT s.doc_id, start, NULL, CASE WHEN closed THEN '' ELSE '{K.EOI}' END, 3 FROM {starts} s JOIN jx USING (doc_id) WHERE size - start + CASE WHEN closed THEN 0 ELSE 2 END >= {least}) w"""


def built(strategy: str, priority: str, start: str, end: str, header: str, tail: str, anchor: str, source: str, made: str, split: str = "NULL", inserted: str = "''") -> str:
    return f"SELECT h.doc_id, {strategy} AS strategy, {priority} AS priority, ({start})::BIGINT AS start, ({end})::BIGINT AS \"end\", {header} AS header, {tail} AS tail, ({anchor})::BIGINT AS anchor, ({split})::BIGINT AS split, {inserted} AS inserted, [{made}]::BIGINT[] AS made FROM {source}"


FROM_SCAN = "scans h JOIN headed o ON o.doc_id = h.doc_id AND o.target = h.sos JOIN scan_windows w ON w.doc_id = h.doc_id AND w.start = h.sos"
SCAN_ORDER = "scan_no, option_no, window_no"
FROM_BARE = "bare h JOIN headed o ON o.doc_id = h.doc_id AND o.target = h.target JOIN bare_starts b ON b.doc_id = h.doc_id AND b.sof_end = o.sof_end AND b.sof_at = o.sof_at JOIN bare_windows w ON w.doc_id = h.doc_id AND w.start = b.start"
BARE_ORDER = "option_no, start_no, window_no"
SCAN_SEGMENT = ("'FFDA' || printf('%04X', 6 + 2 * ids) || printf('%02X', ids) || array_to_string(list_transform(range(0, ids), lambda i: substr(sof, 21 + 6 * i::INT, 2) || CASE WHEN i = 0 THEN '00' ELSE '11' END), '') || '003F00'")
NO_TABLES = "(SELECT s.*, m.dqt_count = 0 AS no_dqt, m.dht_count = 0 AS no_dht, m.soi_count = 0 AS no_soi, c.label AS class_label, coalesce(n.parts, 3) AS parts FROM scans s JOIN marked m USING (doc_id) JOIN classified c USING (doc_id) LEFT JOIN scan_parts n ON n.doc_id = s.doc_id AND n.sos = s.sos)"
REBUILT = f"""scan_windows AS ({windows("(SELECT DISTINCT doc_id, sos AS start FROM scans)", 4, 0)}
), scan_parts AS (
  SELECT doc_id, sos, CASE WHEN length(blob) >= 20 AND length(blob) // 2 >= 10 + 3 * n THEN greatest(1, n) ELSE 1 END AS parts FROM (
    SELECT s.doc_id, s.sos, g.blob, CASE WHEN length(g.blob) >= 20 THEN ('0x' || substr(g.blob, 19, 2))::INT ELSE 0 END AS n FROM scans s JOIN segments g USING (doc_id) WHERE g.marker IN {SOFS}
    QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.sos ORDER BY abs(s.sos - g.p), g.p) = 1)
), bare_offers AS (
  SELECT o.doc_id, sof_at, sof_end, sof_end AS start, 0 AS place FROM bare JOIN headed o USING (doc_id, target) WHERE ids > 0
  UNION ALL SELECT doc_id, sof_at, sof_end, stop, 10 + nth FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, sof_at ORDER BY back DESC) AS nth FROM (
      SELECT o.doc_id, o.sof_at, o.sof_end, g.stop, row_number() OVER (PARTITION BY o.doc_id, o.sof_at ORDER BY g.stop DESC) AS back
      FROM (SELECT DISTINCT doc_id, sof_at, sof_end FROM bare JOIN headed USING (doc_id, target) WHERE ids > 0) o JOIN segments g USING (doc_id) WHERE abs(g.p - o.sof_at) <= 131072 QUALIFY back <= 3))
  UNION ALL SELECT doc_id, sof_at, sof_end, greatest(sof_end, r - b), 100 + 10 * rst_no + back_no FROM (
    SELECT doc_id, sof_at, sof_end, unnest(l) AS r, generate_subscripts(l, 1) AS rst_no FROM (
      SELECT DISTINCT o.doc_id, sof_at, sof_end, {sample("list_filter(rst, lambda r: r > sof_end)", 4)} AS l FROM bare JOIN headed o USING (doc_id, target) JOIN lists ON lists.doc_id = o.doc_id WHERE ids > 0))
  CROSS JOIN (VALUES (256, 1), (1024, 2), (4096, 3), (16384, 4), (65536, 5)) t(b, back_no)
), bare_starts AS (
  SELECT b.doc_id, sof_at, sof_end, start, min(place) AS start_no FROM bare_offers b JOIN jx USING (doc_id) WHERE start < size - 64 GROUP BY ALL
), bare_windows AS ({windows("(SELECT DISTINCT doc_id, start FROM bare_starts)", 3, 128)}
), built AS (
  {built("'rebuild_header_from_segments_' || profile", "CASE WHEN (SELECT label FROM classified c WHERE c.doc_id = h.doc_id) = 'jpeg_missing_soi_internal_structure' THEN 109 ELSE 101 END", "sos", 'w."end"', "header", "tail", "sos", FROM_SCAN, SCAN_ORDER)}
  UNION ALL {built("'rebuild_header_from_segments_minimal_' || profile", "100", "sos", 'w."end"', "minimal", "tail", "sos", FROM_SCAN, SCAN_ORDER)}
  UNION ALL {built("'sos_window_rebuild_header_back_' || back || '_' || profile", "99", "greatest(0, sos - back)", 'w."end"', "header", "tail", "sos", FROM_SCAN + " CROSS JOIN (VALUES (0), (128), (512), (2048), (8192)) t(back)", SCAN_ORDER)}
  UNION ALL {built("'rebuild_header_with_synthetic_sos_' || profile", "111", "w.start", 'w."end"', f"header || {SCAN_SEGMENT}", "tail", "o.sof_at", FROM_BARE, BARE_ORDER)}
  UNION ALL {built("'rebuild_header_with_synthetic_sos_minimal_' || profile", "110", "w.start", 'w."end"', f"minimal || {SCAN_SEGMENT}", "tail", "o.sof_at", FROM_BARE, BARE_ORDER)}
  UNION ALL {built("'rebuild_header_with_synthetic_sos_rst_window_' || profile", "112", "w.start", 'w."end"', f"header || {SCAN_SEGMENT}", "tail", "o.sof_at", FROM_BARE + " JOIN lists ON lists.doc_id = h.doc_id AND len(rst) > 0", BARE_ORDER)}
  UNION ALL {built("'restart_window_rebuild_header_' || profile", "99", "sos", "least(size, r + 2)", "header", f"'{K.EOI}'", "sos", f"(SELECT doc_id, sos, scan_no, unnest(l) AS r, generate_subscripts(l, 1) AS rst_no FROM (SELECT s.doc_id, sos, scan_no, {sample('list_filter(rst, lambda r: r > sos)', 8)} AS l FROM scans s JOIN lists USING (doc_id) WHERE scan_no <= 8)) h JOIN jx USING (doc_id) JOIN headed o ON o.doc_id = h.doc_id AND o.target = h.sos AND option_no <= 3", "scan_no, rst_no, option_no")}
  UNION ALL {built("'inject_standard_tables_before_sos_' || CASE WHEN append THEN 'append_eoi_' ELSE '' END || CASE WHEN no_dqt THEN q.label || '__' || d.label ELSE d.label END", "CASE WHEN append THEN 102 ELSE 103 END", "0", "NULL", f"CASE WHEN no_soi THEN '{K.SOI}' ELSE '' END", f"CASE WHEN append THEN '{K.EOI}' ELSE '' END", "sos", f"{NO_TABLES} h JOIN standard q ON q.name = 'dqt' AND q.parts = CASE WHEN h.parts > 1 THEN 3 ELSE 1 END AND (no_dqt OR q.quality = {J.QUALITIES[0]}) JOIN standard d ON d.name = 'dht' AND d.parts = q.parts CROSS JOIN (VALUES (false), (true)) t(append)", "scan_no, q.quality", "sos", "CASE WHEN no_dqt THEN q.blob ELSE '' END || CASE WHEN no_dht THEN d.blob ELSE '' END")} WHERE no_dqt OR no_dht
  UNION ALL {built("'classification_hint_inject_standard_dht_' || d.label", "107", "0", "NULL", "''", "''", "sos", f"{NO_TABLES} h JOIN standard d ON d.name = 'dht' AND d.parts = CASE WHEN h.parts > 1 THEN 3 ELSE 1 END", "scan_no", "sos", "d.blob")} WHERE class_label = 'jpeg_missing_dht' AND scan_no <= 4
), rebuilt AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, strategy, made) AS ord FROM (SELECT doc_id, strategy, priority, start, "end", header, tail, anchor, split, inserted, min(made) AS made FROM built GROUP BY ALL)
)"""
REBUILD = (ANCHORS, WALK, OPTIONS, REBUILT)
REBUILT_ROWS = f"""SELECT doc_id, ord, 'jpeg' AS family, strategy, priority, '{NEW}' AS kind, start, "end", (length(header) + length(inserted)) // 2 AS header_bytes, anchor, octet_length(whole) AS payload_size, sha256(whole) AS payload_sha256 FROM (
  SELECT r.*, from_hex(header || CASE WHEN split IS NULL THEN {SPAN.format("start", 'greatest(coalesce("end", size) - start, 0)')} ELSE {SPAN.format("0", "split")} || inserted || {SPAN.format("split", "size - split")} END || tail) AS whole FROM rebuilt r JOIN jx USING (doc_id))"""

LEGACY_ORDER = 'priority DESC, start, "end" DESC NULLS LAST, made'


def legacy(kind: str) -> str:
    """The plans of one kind of the older engine, with payloads."""
    raw = f"SELECT doc_id, '{kind}' AS family, '{kind}_raw_file' AS strategy, 100 AS priority, 'slice' AS kind, 0::BIGINT AS start, NULL::BIGINT AS \"end\", '' AS prepend, '' AS append, 0 AS made FROM x"
    row = lambda frm, s, pr, st, en="NULL", pre="", made=1: f"SELECT doc_id, '{kind}', '{s}', {pr}, 'slice', {st}, {en}, '{pre}', '', {made} FROM {frm}"
    starts = f"(SELECT doc_id, unnest({sample('pos', 80)}) AS p FROM found_at WHERE name = 'starts')"
    if kind == "png":
        sets = {"starts": [K.PNG], "headers": [K.IHDR], "ends": [K.IEND]}
        ends = "JOIN (SELECT doc_id, pos AS ends FROM found_at WHERE name = 'ends') USING (doc_id)"
        at = f"(SELECT *, list_filter(ends, lambda e: e > p) AS es FROM {starts} {ends})"
        heads = f"(SELECT *, list_filter(ends, lambda e: e > p) AS es FROM (SELECT doc_id, q - 4 AS p FROM (SELECT doc_id, unnest({sample('pos', 80)}) AS q FROM found_at WHERE name = 'headers') WHERE q >= 4) {ends})"
        some = "WHERE len(es) > 0"
        rows = [
            row(f"{at} {some}", "png_sig_to_first_iend", 99, "p", "es[1] + 12"), row(f"{at} {some}", "png_sig_to_last_iend", 98, "p", "es[-1] + 12"), row(at, "png_sig_to_end", 97, "p"),
            row(f"{heads} {some}", "png_prepend_sig_at_ihdr_first_iend", 95, "p", "es[1] + 12", K.PNG), row(f"{heads} {some}", "png_prepend_sig_at_ihdr_last_iend", 94, "p", "es[-1] + 12", K.PNG),
            row(heads, "png_prepend_sig_at_ihdr_to_end", 93, "p", "NULL", K.PNG), row("x", "png_prepend_sig_whole", 92, 0, "NULL", K.PNG),
        ]
    elif kind == "gif":
        sets = {"starts": [K.GIF87, K.GIF89], "ends": [K.GIF_TRAILER]}
        at = f"(SELECT *, list_filter(ends, lambda e: e > p) AS es FROM {starts} JOIN (SELECT doc_id, pos AS ends FROM found_at WHERE name = 'ends') USING (doc_id))"
        rows = [
            row(f"{at} WHERE len(es) > 0", "gif_header_to_first_trailer", 99, "p", "es[1] + 1"), row(f"{at} WHERE len(es) > 0", "gif_header_to_last_trailer", 98, "p", "es[-1] + 1"), row(at, "gif_header_to_end", 97, "p"),
        ]
    elif kind == "tiff":
        sets = {"starts": [K.TIFF_LE, K.TIFF_BE]}
        rows = [row(starts, "tiff_header_to_end", 99, "p")]
    else:
        sets = {"starts": [K.BMP if kind == "bmp" else K.RIFF]}
        field, more = (2, 0) if kind == "bmp" else (4, 8)
        byte = lambda k: f"('0x' || substr(sx, (p + {field + k}) * 3 + 1, 2))::BIGINT"
        real = "" if kind == "bmp" else "WHERE p + 12 <= size AND substr(sx, (p + 8) * 3 + 1, 12) = '57 45 42 50 '"
        at = f"(SELECT s.doc_id, p, size, sx FROM {starts} s JOIN x USING (doc_id) {real})"
        sized = f"(SELECT doc_id, p, size, {byte(0)} + 256 * {byte(1)} + 65536 * {byte(2)} + 16777216 * {byte(3)} + {more} AS n FROM {at} WHERE p + {field + 4} <= size)"
        rows = [row(f"{sized} WHERE n BETWEEN 64 AND size - p", f"{kind}_declared_size", 99, "p", "p + n"), row(at, f"{kind}_to_end", 98, "p")]
    return query(payload_hash(), positions(sets, "found_at"), ranked(" UNION ALL ".join([raw, *rows]), order=LEGACY_ORDER))


def legacy_jpeg() -> str:
    """The plans of the older engine's JPEG lanes."""
    x_rows = "(SELECT doc_id FROM x)"
    few = lambda name: f"(SELECT doc_id, unnest({sample('pos', 12)})::BIGINT AS p FROM found_at WHERE name = '{name}')"
    ends = "JOIN (SELECT doc_id, pos AS ends FROM found_at WHERE name = 'eoi') USING (doc_id)"
    soi, backs = few("soi"), "CROSS JOIN (VALUES (0, 0), (128, 1), (512, 2), (2048, 3), (8192, 4), (32768, 5)) t(b, nth)"
    after = f"(SELECT *, list_filter(ends, lambda e: e > p) AS es FROM {soi} {ends})"
    tails = f"(SELECT s.doc_id, p, n, least(size, p + n) AS e FROM {soi} s JOIN x USING (doc_id) CROSS JOIN (VALUES (65536), (262144), (1048576), (4194304)) t(n) WHERE least(size, p + n) - p >= 128)"
    around = f"(SELECT doc_id, p, base, b, nth FROM bases {backs})"
    around_ends = f"(SELECT doc_id, p, base, b, nth, unnest({later(4)}) AS e FROM {around} {ends})"
    inner = f"(SELECT doc_id, p, b, nth FROM inners {backs})"
    inner_ends = f"(SELECT doc_id, p, b, nth, unnest({later(3)}) AS e FROM {inner} {ends})"
    order, start = "(p * 100000000 + base) * 10 + nth", "greatest(0, base - b)"
    rows = [
        plan_rows(x_rows, "'jpeg_raw_file'", 100, "slice", "0"), plan_rows(x_rows, "'jpeg_prepend_soi_whole'", 99, "slice", "0", prepend=K.SOI), plan_rows(x_rows, "'jpeg_prepend_soi_whole_append_eoi'", 98, "slice", "0", prepend=K.SOI, append=K.EOI),
        plan_rows(f"(SELECT doc_id, p, unnest({later(6)}) AS e FROM {soi} {ends})", "'jpeg_soi_to_sampled_eoi'", 97, "slice", "p", "e + 2"),
        plan_rows(f"{after} WHERE len(es) > 0", "'jpeg_soi_to_first_eoi'", 96, "slice", "p", "es[1] + 2"), plan_rows(f"{after} WHERE len(es) > 0", "'jpeg_soi_to_last_eoi'", 95, "slice", "p", "es[-1] + 2"),
        plan_rows(soi, "'jpeg_soi_to_end'", 94, "slice", "p"), plan_rows(soi, "'jpeg_soi_to_end_append_eoi'", 93, "slice", "p", append=K.EOI),
        plan_rows(tails, "'jpeg_soi_tail_' || n", 92, "slice", "p", "e", made="p * 10000000 + n"), plan_rows(tails, "'jpeg_soi_tail_' || n || '_append_eoi'", 91, "slice", "p", "e", append=K.EOI, made="p * 10000000 + n"),
        plan_rows(around_ends, "'jpeg_sos_cluster_back_' || b || '_to_eoi'", 90, "slice", start, "e + 2", prepend=K.SOI, made=order), plan_rows(around, "'jpeg_sos_cluster_back_' || b || '_to_end'", 89, "slice", start, prepend=K.SOI, made=order),
        plan_rows(around, "'jpeg_sos_cluster_back_' || b || '_to_end_append_eoi'", 88, "slice", start, prepend=K.SOI, append=K.EOI, made=order),
        plan_rows(inner, "'jpeg_synthetic_soi_marker_back_' || b", 87, "slice", BEFORE, prepend=K.SOI, made="p * 10 + nth"), plan_rows(inner, "'jpeg_synthetic_soi_marker_back_' || b || '_append_eoi'", 86, "slice", BEFORE, prepend=K.SOI, append=K.EOI, made="p * 10 + nth"),
        plan_rows(inner_ends, "'jpeg_synthetic_soi_marker_back_' || b || '_to_eoi'", 85, "slice", BEFORE, "e + 2", prepend=K.SOI, made="p * 10 + nth"),
    ]
    pools = f"""pools AS (
  SELECT doc_id, list_sort(list_distinct(list_concat(coalesce(s.held, []), t.pos))) AS pool, t.pos AS structure FROM (SELECT doc_id, pos FROM found_at WHERE name = 'structure') t LEFT JOIN (SELECT doc_id, list(p) AS held FROM {soi} GROUP BY doc_id) s USING (doc_id)
), bases AS (
  SELECT doc_id, p, unnest(list_distinct(list_filter([p, list_max(list_filter(pool, lambda m: m <= p)), list_min(list_filter(pool, lambda m: m <= p AND p - m <= 131072))], lambda m: m IS NOT NULL))) AS base FROM {few("sos")} JOIN pools USING (doc_id)
), inners AS (
  SELECT doc_id, unnest({sample("pos", 18)})::BIGINT AS p FROM (SELECT doc_id, list_sort(list_distinct(list_concat(structure, coalesce(s.held, [])))) AS pos FROM pools LEFT JOIN (SELECT doc_id, list(p) AS held FROM {few("sos")} GROUP BY doc_id) s USING (doc_id))
)"""
    sets = {"soi": [K.SOI], "eoi": [K.EOI], "sos": [K.SOS], "structure": [K.APP0, K.APP1, K.DQT, K.DHT, *K.SOF]}
    columns = "doc_id, ord, family, strategy, priority, kind, start, \"end\", prepend, append"
    return query(f"SELECT {columns} FROM plans", positions(sets, "found_at"), pools, ranked(" UNION ALL ".join(rows), order=LEGACY_ORDER))


ATTEMPTS = f"""probed AS (
  SELECT p.*, c.family AS class_family, c.label, (p.doc_id * 7 + ord * 3) % 5 <> 0 AS ok, 4 + (p.doc_id * 31 + ord * 17) % 4000 AS width, 4 + (p.doc_id * 13 + ord * 29) % 3000 AS height,
         CASE WHEN c.family IN {VIDEO} THEN (p.doc_id * 97) % 700000 ELSE 0 END AS duration_ms, CASE WHEN c.family IN {VIDEO} THEN p.doc_id % 400 ELSE 0 END AS frame_count,
         ((p.doc_id * 11 + ord) % 800)::DOUBLE / 100 AS entropy, CASE WHEN c.family IN {VIDEO} THEN 'ffmpeg-video' ELSE 'pillow' END AS decoder, 'primary' AS phase
  FROM plans p JOIN classified c ON c.doc_id = p.doc_id
), attempts AS (
  SELECT *, CASE WHEN ok THEN NULL ELSE ['ffmpeg_timeout', 'ffmpeg_failed', 'no_candidate_succeeded'][doc_id % 3 + 1] END AS error,
    CASE WHEN NOT ok THEN '-Infinity'::DOUBLE
      WHEN class_family IN {VIDEO} THEN priority * 2.0::DOUBLE + least(width * height, 50000000)::DOUBLE / 5000 + least(duration_ms::DOUBLE / 1000, 600) + least(frame_count, 300) * 2.0::DOUBLE
        + CASE WHEN class_family = family THEN 80 ELSE 0 END + CASE WHEN kind = 'container_rebuild_plan' THEN 35 ELSE 0 END
        + CASE WHEN contains(strategy, 'signature_offset') AND label LIKE '%away_from_byte0' THEN 45 ELSE 0 END + CASE WHEN label = 'mpegts_desync_or_partial_packets' AND contains(strategy, 'ts_sync') THEN 50 ELSE 0 END
      ELSE least(width * height, 50000000)::DOUBLE / 1000 + priority * 2.0::DOUBLE + entropy * 20 + CASE WHEN class_family = family THEN 80 ELSE 0 END
        + CASE WHEN label = 'jpeg_missing_dht' AND contains(strategy, 'dht') THEN 50 ELSE 0 END
        + CASE WHEN label = 'jpeg_missing_soi_internal_structure' AND (contains(strategy, 'synthetic_soi') OR contains(strategy, 'rebuild_header')) THEN 65 ELSE 0 END
        + CASE WHEN label = 'jpeg_missing_eoi' AND contains(strategy, 'append_eoi') THEN 40 ELSE 0 END + CASE WHEN contains(strategy, 'restart_window') THEN 30 ELSE 0 END
        + CASE WHEN width < 8 OR height < 8 THEN -300 ELSE 0 END + CASE WHEN width > 30000 OR height > 30000 THEN -200 ELSE 0 END END AS score FROM probed
), won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS nth FROM attempts WHERE ok) WHERE nth = 1
), outputs AS (
  SELECT c.doc_id, c.path, c.family, c.label, strategy, decoder, score, width, height, (strategy IS NOT NULL)::INT AS success, CASE WHEN strategy IS NULL THEN 'no_candidate_succeeded' END AS error
  FROM classified c LEFT JOIN (SELECT doc_id, strategy, decoder, score, width, height FROM won) w USING (doc_id)
)"""
EVERY_PLAN = f"""plans AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, strategy, made) AS ord FROM (
    {" UNION ALL ".join(f"SELECT doc_id, family, {PLAN_COLUMNS}, made::BIGINT AS made FROM {lane}" for lane in ("generic", "video", "jpeg"))}
    UNION ALL SELECT doc_id, 'jpeg', strategy, priority, '{NEW}', start, "end", '', '', ord FROM rebuilt)
)"""
OTHER = {name: count_any(ns) for name, ns in OTHER_COUNTS.items()}
OLDER = {name: count_any(ns) for name, ns in LEGACY_COUNTS.items()}
RUN = (*ALL, OFFSETS, SYNCS, ANCHORS, GENERIC.replace("plans", "generic"), VIDEOS.replace("plans", "video"), ranked(f"{WHOLE} UNION ALL {FROM_SOI} UNION ALL {FROM_MARK} UNION ALL {HINTS}", "jpeg"), WALK, OPTIONS, REBUILT, EVERY_PLAN, ATTEMPTS)


def chosen_text(name: str) -> str:
    """A fixed text of the older engine as SQL."""
    return "'" + {**legacy_rules.IDEA_TEXTS, **{f"advice {k}": v for k, v in legacy_rules.ADVICE_TEXTS.items()}}[name].replace("'", "''") + "'"


SIGNS = {
    "jpeg_inner": "soi_count = 0 AND (sos_count > 0 OR dqt_count > 0 OR dht_count > 0 OR sof_count > 0)", "jpeg_open": "soi_count > 0 AND eoi_count = 0", "jpeg_restart": "rst_count > 0",
    "jpeg_bare": "soi_count = 0 AND sos_count = 0", "png_bare": "ihdr_count > 0 AND png_sig_count = 0", "png_open": "idat_count > 0 AND iend_count = 0", "png_empty": "idat_count = 0", "gif_open": "gif_trailer_count = 0",
}
STATE = f"""others AS (SELECT doc_id, {", ".join(f"{e} AS {c}" for c, e in {**OTHER, **OLDER}.items())} FROM x
), told AS (
  SELECT o.doc_id, o.path, success, o.error, o.decoder, c.declared_kind, m.* EXCLUDE (doc_id), t.* EXCLUDE (doc_id) FROM outputs o JOIN classified c ON c.doc_id = o.doc_id JOIN marked m ON m.doc_id = o.doc_id JOIN others t ON t.doc_id = o.doc_id
)"""


def lost(kind: str, sign: str) -> str:
    return f"count_if(success = 0 AND coalesce(declared_kind = '{kind}', false) AND {SIGNS[sign]})"


FINDINGS = ("jpeg_inner", "jpeg_open", "png_bare", "png_open")
ADVICE = f"""SELECT unnest(l) AS advice, generate_subscripts(l, 1) - 1 AS place FROM (SELECT list_filter([
  CASE WHEN failed > 0 AND no_candidate > failed * {legacy_rules.BOTTLENECK} THEN {chosen_text('advice no_candidate')} END, CASE WHEN external > own THEN {chosen_text('advice external')} END,
  {", ".join(f"CASE WHEN {sign} > 0 THEN {sign} || {chosen_text('advice ' + sign)} END" for sign in FINDINGS)}, {chosen_text('advice always')}], lambda a: a IS NOT NULL) AS l
  FROM (SELECT count_if(success = 0) AS failed, count_if(success = 0 AND error = 'no_candidate_succeeded') AS no_candidate, count_if(success = 1 AND decoder = 'ffmpeg') AS external, count_if(success = 1 AND decoder = 'pillow') AS own,
        {", ".join(f"{lost(sign.split('_')[0], sign)} AS {sign}" for sign in FINDINGS)} FROM told))"""


def ideas(chosen: str) -> str:
    """Ideas for lost files; chosen gives doc_id and kinds, the table hit the signatures of each kind."""
    names = {k: [n for n in legacy_rules.IDEA_TEXTS if n.split("_")[0] == k] for k in legacy_rules.KINDS}
    case = " ".join(
        f"WHEN '{k}' THEN list_filter([{', '.join(f'CASE WHEN {SIGNS.get(n, chr(39) + chr(39) + chr(61) + chr(39) + chr(39))} THEN {chosen_text(n)} END' for n in own)}], lambda i: i IS NOT NULL)" for k, own in names.items()
    )
    kinds = "[" + ", ".join(f"'{k}'" for k in legacy_rules.KINDS) + "]"
    seen = f"list_filter({kinds}, lambda k: list_contains(coalesce(seen, []), k))"
    return f"""SELECT doc_id, array_to_string(list_concat(flatten(list_transform(string_split(kinds, ','), lambda k: CASE k {case} END)),
      list_filter([CASE WHEN len(string_split(kinds, ',')) < 6 THEN {chosen_text('fallback')} END, CASE WHEN len(string_split(kinds, ',')) < 6 AND len({seen}) > 0 THEN '{legacy_rules.OTHER_HITS}' || array_to_string({seen}, ', ') || '.' END], lambda i: i IS NOT NULL)), chr(10)) AS ideas
      FROM told JOIN ({chosen}) c USING (doc_id) LEFT JOIN (SELECT doc_id, list(name) FILTER (n > 0) AS seen FROM hit GROUP BY doc_id) h USING (doc_id) WHERE success = 0"""
