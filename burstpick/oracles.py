"""The same queries in DuckDB's SQL over the given tables."""

from __future__ import annotations

from burstpick.operators.review import KEEPER, REJECT
from burstpick.sources.standin import ACTIONS_SQL, CAPTURES_SQL, EXIF_SQL, EXPORT_REQUESTS_SQL, HEADS, JPEGS_SQL, LANDMARKS_SQL, OVERRIDES_SQL, PATCHES_SQL, YOLO_SQL

#: What a sidecar must say, by verdict.
#: The sidecar's text before and after its rating (XMP, ISO 16684-1), spelled out as the expectation.
_HEAD = """<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
    <rdf:Description rdf:about=""
      xmlns:xmp="http://ns.adobe.com/xap/1.0/"
      xmlns:dc="http://purl.org/dc/elements/1.1/"
"""
_TAIL = """>
      <dc:description>
        <rdf:Alt>
          <rdf:li xml:lang="x-default">Processed by burstpick</rdf:li>
        </rdf:Alt>
      </dc:description>
    </rdf:Description>
  </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>"""
SIDECAR = {
    KEEPER: _HEAD + '      xmp:Rating="5"\n      xmp:CreatorTool="burstpick"' + _TAIL,
    REJECT: _HEAD + '      xmp:Rating="-1"\n      xmp:CreatorTool="burstpick"\n      xmp:Label="Reject"' + _TAIL,
}

CLUSTERS = """clusters AS (
  SELECT shoot_id, image_id, ts_ms, phash, (sum(n) OVER (PARTITION BY shoot_id ORDER BY ts_ms, image_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster
  FROM (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY shoot_id ORDER BY ts_ms, image_id) > 14400000 THEN 1 ELSE 0 END AS n
    FROM captures WHERE ts_ms IS NOT NULL)
)"""
SPLIT = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY shoot_id, cluster ORDER BY ts_ms, image_id) AS rn FROM clusters
), walk AS (
  SELECT shoot_id, cluster, image_id, ts_ms, rn, phash AS anchor, 0::BIGINT AS subgroup FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.shoot_id, n.cluster, n.image_id, n.ts_ms, n.rn, CASE WHEN coalesce(bit_count(xor(w.anchor, n.phash)) > 14, false) THEN n.phash ELSE w.anchor END,
    w.subgroup + CASE WHEN coalesce(bit_count(xor(w.anchor, n.phash)) > 14, false) THEN 1 ELSE 0 END
  FROM walk w JOIN numbered n ON n.shoot_id = w.shoot_id AND n.cluster = w.cluster AND n.rn = w.rn + 1
)"""
SCENES = """placed AS (
  SELECT shoot_id, image_id, row_number() OVER s AS pos_in_scene, first_value(ts_ms) OVER s AS t0, first_value(image_id) OVER s AS i0
  FROM walk WINDOW s AS (PARTITION BY shoot_id, cluster, subgroup ORDER BY ts_ms, image_id)
  UNION ALL SELECT shoot_id, image_id, 1, NULL, image_id FROM captures WHERE ts_ms IS NULL
), heads AS (
  SELECT i0, row_number() OVER (ORDER BY t0 NULLS LAST, i0) AS scene_id FROM placed WHERE pos_in_scene = 1
), scenes AS (
  SELECT shoot_id, scene_id, pos_in_scene, image_id FROM placed JOIN heads USING (i0)
)"""
KEEPERS = """keepers AS (
  SELECT scene_id, arg_max(image_id, row(NOT blink_detected, sharpness_score, pos_in_scene)) AS keeper_id
  FROM scenes JOIN captures USING (image_id) GROUP BY scene_id
), verdicts AS (
  SELECT c.*, CASE WHEN k.keeper_id IS NOT NULL THEN 'keeper' WHEN blink_detected THEN 'reject' ELSE 'unrated' END AS verdict,
    CASE WHEN k.keeper_id IS NULL AND blink_detected THEN 'blink' END AS reject_reason
  FROM captures c LEFT JOIN keepers k ON k.keeper_id = c.image_id
)"""
EFFECTIVE = """effective AS (
  SELECT image_id, coalesce(override, verdict, 'unrated') AS effective_verdict FROM verdicts LEFT JOIN overrides USING (image_id)
), effective_keepers AS (
  SELECT scene_id, coalesce(arg_min(image_id, pos_in_scene) FILTER (override = 'keeper'),
    CASE WHEN NOT coalesce(bool_or(image_id = keeper_id AND override IN ('unrated', 'reject')), false) THEN any_value(keeper_id) END) AS effective_keeper_id
  FROM scenes JOIN keepers USING (scene_id) LEFT JOIN overrides USING (image_id) GROUP BY scene_id
)"""
DETECTIONS = """cells AS (
  SELECT vec_id, i, raw[i + 1] AS cx, raw[i + 14] AS cy, raw[i + 27] AS w, raw[i + 40] AS h, raw[i + 53] AS confidence FROM yolo, unnest(range(13)) AS u(i)
), detections AS (
  SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, i) - 1 AS pos, cx, cy, w, h, confidence FROM cells WHERE confidence >= 0.1
)"""


def _iou(a: str, b: str) -> str:
    """Overlap of rows ``a`` and ``b`` of ``detections``."""
    side = lambda c, s: f"greatest(0.0, least({a}.{c} + {a}.{s} / 2, {b}.{c} + {b}.{s} / 2) - greatest({a}.{c} - {a}.{s} / 2, {b}.{c} - {b}.{s} / 2))"
    shared = f"({side('cx', 'w')} * {side('cy', 'h')})"
    union = f"({a}.w * {a}.h + {b}.w * {b}.h - {shared})"
    return f"CASE WHEN {union} <= 0 THEN 0.0 ELSE {shared} / {union} END"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join([CAPTURES_SQL, *parts])


STACKED = (CLUSTERS, SPLIT, SCENES)
CULLED = (*STACKED, KEEPERS)
REVIEWED = (*CULLED, OVERRIDES_SQL, EFFECTIVE)
NAME = "regexp_extract({}, '[^/]*$')"
RANKED = """ranked AS (
  SELECT s.scene_id, s.image_id, row_number() OVER (PARTITION BY s.scene_id ORDER BY (s.image_id IS NOT DISTINCT FROM e.effective_keeper_id) DESC,
    coalesce(v.sharpness_score, 0) DESC, pos_in_scene) AS rank, count(*) OVER (PARTITION BY s.scene_id) AS scene_size
  FROM scenes s JOIN effective_keepers e USING (scene_id) LEFT JOIN verdicts v ON v.image_id = s.image_id
)"""
EYE_POINTS = """points AS (
  SELECT vec_id, raw, CASE WHEN len(raw) >= 1404 THEN 3 WHEN len(raw) >= 936 THEN 2 END AS k FROM landmarks
)"""


def _ear(eye: tuple[int, ...]) -> str:
    at = lambda p, c: f"raw[{eye[p]} * k + {c + 1}]::DOUBLE"
    distance = lambda p, q: f"sqrt(pow({at(p, 0)} - {at(q, 0)}, 2) + pow({at(p, 1)} - {at(q, 1)}, 2))"
    return f"CASE WHEN k IS NULL OR {distance(0, 3)} < 1e-6 THEN 1.0 ELSE ({distance(1, 5)} + {distance(2, 4)}) / (2 * {distance(0, 3)}) END"


RIGHT, LEFT = _ear((33, 159, 158, 133, 153, 145)), _ear((362, 380, 374, 263, 386, 385))
_DATE = "string_split_regex(d, '[: ]')"
EXIF_PARSED = f"""o AS (
  SELECT image_id, CASE WHEN json_valid(json) AND json_type(json) = 'ARRAY' THEN json_extract(json, '$[0]') END AS o FROM exif
), t AS (
  SELECT image_id, o, CASE WHEN json_type(o, '$.DateTimeOriginal') = 'VARCHAR' THEN {_DATE.replace('d,', "(o->>'$.DateTimeOriginal'),")} END AS p FROM o
), n AS (
  SELECT *, CASE WHEN len(p) >= 6 AND len(list_filter(p[1:6], lambda x: NOT regexp_matches(x, '^[0-9]+$'))) = 0 THEN list_transform(p[1:6], lambda x: x::BIGINT) END AS q FROM t
), y AS (
  SELECT *, q[1] - CASE WHEN q[2] <= 2 THEN 1 ELSE 0 END AS yy, (q[2] + 9) % 12 AS mm FROM n
)"""


def _sql() -> dict[str, str]:
    out = {}
    raw = "('cr2', 'cr3', 'nef', 'arw', 'raf', 'dng', 'orf', 'rw2')"
    ext = "lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+\\.([^.]*)$', 1))"
    out["filter_raw_files"] = _with() + f" SELECT image_id, file_path FROM captures WHERE {ext} IN {raw}"
    out["filter_jpegs"] = _with() + f" SELECT image_id, {NAME.format('file_path')} AS file_name, NULL::BIGINT AS ts_ms FROM captures WHERE {ext} IN ('jpg', 'jpeg') AND image_id % 4 > 0"
    out["assign_image_ids"] = _with() + " SELECT file_path, row_number() OVER (ORDER BY file_path) AS image_id FROM captures"
    picked = "CASE WHEN image_id % 3 = 0 THEN 'J' || image_id WHEN image_id % 2 = 0 THEN 'P' || image_id WHEN image_id % 5 = 0 THEN 'O' || image_id END"
    out["pick_preview"] = _with() + f" SELECT image_id, {picked} AS preview FROM captures WHERE {picked} IS NOT NULL"
    out["preview_counts"] = _with() + f" SELECT count({picked}) AS n_kept, count(*) - count({picked}) AS n_skipped FROM captures"
    text = lambda n: f"CASE WHEN json_type(o, '$.{n}') = 'VARCHAR' THEN o->>'$.{n}' END"
    out["parse_exif"] = _with(EXIF_SQL, EXIF_PARSED) + f""" SELECT image_id, {text('Make')} AS camera_make, {text('Model')} AS camera_model,
      round(try_cast(replace({text('FocalLength')}, ' mm', '') AS FLOAT)::DOUBLE, 6) AS focal_length_mm,
      round(CASE WHEN json_type(o, '$.FNumber') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN (o->>'$.FNumber')::FLOAT::DOUBLE END, 6) AS aperture,
      CASE WHEN json_type(o, '$.ISO') = 'UBIGINT' THEN (o->>'$.ISO')::BIGINT % 4294967296 END AS iso,
      CASE WHEN q[2] BETWEEN 1 AND 12 AND q[3] BETWEEN 1 AND 31 THEN
        (365 * yy + yy // 4 - yy // 100 + yy // 400 + (mm * 306 + 5) // 10 + q[3] - 719469) * 86400 + q[4] * 3600 + q[5] * 60 + q[6] END AS timestamp
      FROM y"""
    heads = ", ".join(f"'{h}'" for h in HEADS)
    is_file = " OR ".join(f"image_id % 4 = {n}" for n, h in enumerate(HEADS) if h.startswith("ffd8"))
    parsed = out["parse_exif"][out["parse_exif"].rindex(" SELECT image_id, CASE") :]
    out["ingested_photos"] = _with(EXIF_SQL, EXIF_PARSED) + f""", raw AS (
      SELECT *, row_number() OVER (ORDER BY file_path) AS id, {picked} IS NOT NULL AS kept FROM captures WHERE {ext} IN {raw}
    ), fields AS ({parsed}) SELECT id AS image_id, file_path, {NAME.format('file_path')} AS file_name, fields.timestamp * 1000 AS ts_ms, camera_make, camera_model, focal_length_mm, aperture, iso,
      CASE WHEN image_id % 3 = 0 AND ({is_file}) THEN image_id % 700 + 1 ELSE 0 END AS preview_width, CASE WHEN image_id % 3 = 0 AND ({is_file}) THEN image_id % 500 + 1 ELSE 0 END AS preview_height,
      CASE WHEN image_id % 3 = 0 THEN sha256(unhex([{heads}][(image_id % 4 + 1)::INTEGER] || 'ffc0001108' || printf('%04x%04x', (image_id % 500 + 1)::INTEGER, (image_id % 700 + 1)::INTEGER) || repeat('03', 12)))
        ELSE sha256({picked}) END AS preview_sha256,
      (SELECT count(*) FROM raw WHERE kept) AS n_kept, (SELECT count(*) FROM raw WHERE NOT kept) AS n_skipped FROM raw JOIN fields USING (image_id) WHERE kept"""
    named = "['_MG_', '.', 'IMG '][(image_id % 3 + 1)::INTEGER] || image_id || split_part(file_path, 'IMG_', 2)"
    out["list_files"] = _with() + f""", f AS (SELECT {named} AS file_name, image_id % 7 AS length FROM captures WHERE ts_ms IS NOT NULL)
      SELECT 'top/' || file_name AS file_path, file_name, length FROM f WHERE lower(regexp_extract(file_name, '^.+[.]([^.]*)$', 1)) IN {raw}"""
    out["image_summary"] = _with() + " SELECT image_id, file_path, '/previews/' || image_id || '.jpg' AS preview_path FROM captures"
    out["time_clusters"] = out["time_clusters_stitched"] = _with(CLUSTERS) + " SELECT shoot_id, image_id, cluster FROM clusters"
    out["time_clusters_global"] = _with() + """ SELECT image_id, (sum(n) OVER (ORDER BY ts_ms, image_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM
      (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms, image_id) > 60000 THEN 1 ELSE 0 END AS n FROM captures WHERE ts_ms IS NOT NULL)"""
    out["singleton_scenes"] = _with() + " SELECT image_id FROM captures WHERE ts_ms IS NULL"
    out["hamming"] = _with() + """ SELECT a.image_id, bit_count(xor(a.phash, b.phash))::BIGINT AS distance FROM captures a JOIN captures b ON b.image_id = a.image_id + 1
      WHERE a.phash IS NOT NULL AND b.phash IS NOT NULL"""
    out["split_by_phash"] = _with(CLUSTERS, SPLIT) + " SELECT shoot_id, cluster, image_id, subgroup FROM walk"
    out["stack_scenes"] = _with(*STACKED) + " SELECT shoot_id, scene_id, pos_in_scene, image_id FROM scenes"
    out["scene_arrays"] = _with(*STACKED) + " SELECT scene_id, string_agg(image_id::VARCHAR, ',' ORDER BY pos_in_scene) AS image_ids FROM scenes GROUP BY scene_id"
    out["scene_stats"] = _with(*STACKED) + """ SELECT count(*) AS scenes, count(*) FILTER (n = 1) AS singletons, coalesce(max(n), 0) AS largest,
      round(coalesce(avg(n), 0.0), 6) AS average_size FROM (SELECT count(*) AS n FROM scenes GROUP BY scene_id)"""
    out["pick_keeper"] = _with() + " SELECT shoot_id, arg_max(image_id, row(sharpness_score, image_id)) AS keeper_id FROM captures GROUP BY shoot_id"
    out["select_keepers"] = _with(*STACKED) + """ SELECT scene_id, arg_max(image_id, row(NOT blink_detected, sharpness_score, pos_in_scene)) AS keeper_id
      FROM scenes JOIN captures USING (image_id) GROUP BY scene_id"""
    out["assign_verdicts"] = _with(*CULLED) + " SELECT image_id, verdict, reject_reason FROM verdicts"
    counts = "count(*) FILTER (verdict = 'keeper') AS keepers, count(*) FILTER (verdict = 'reject') AS rejects, count(*) FILTER (verdict = 'unrated') AS unrated"
    out["cull_totals"] = _with(*CULLED) + f" SELECT count(*) AS images, {counts}, (SELECT count(DISTINCT scene_id) FROM scenes) AS scenes FROM verdicts"
    out["cull_run"] = _with(*CULLED) + f""" SELECT count(*) AS images, {counts}, (SELECT count(DISTINCT scene_id) FROM scenes) AS scenes,
      count(*) FILTER (reject_reason = 'blink') AS blinks FROM verdicts"""
    out["verdicts_by_shoot"] = _with(*CULLED) + f" SELECT shoot_id, count(*) AS images, {counts} FROM verdicts GROUP BY shoot_id"
    out["verdict_label"] = _with(*CULLED) + """ SELECT image_id, CASE verdict WHEN 'keeper' THEN '"Keeper"' WHEN 'reject' THEN '{"Reject":{"reason":"Blink"}}' ELSE '"Unrated"' END AS json, verdict AS label FROM verdicts"""
    out["effective_verdicts"] = _with(*CULLED, OVERRIDES_SQL) + """ SELECT image_id, coalesce(override, verdict, 'unrated') AS effective_verdict
      FROM verdicts LEFT JOIN overrides USING (image_id)"""
    out["effective_keepers"] = _with(*REVIEWED) + " SELECT scene_id, effective_keeper_id FROM effective_keepers"
    of = lambda v, n: f"count(*) FILTER (effective_verdict = '{v}') AS {n}"
    out["override_stats"] = _with(*REVIEWED) + f" SELECT {of(KEEPER, 'keepers')}, {of(REJECT, 'rejects')}, {of('unrated', 'unrated')}, (SELECT count(*) FROM overrides) AS overrides FROM effective"
    out["rank_scene_images"] = _with(*REVIEWED, RANKED) + " SELECT scene_id, image_id, rank, scene_size FROM ranked"
    modes = {
        "all": "SELECT DISTINCT scene_id FROM scenes",
        "keepers": "SELECT scene_id FROM effective_keepers WHERE effective_keeper_id IS NOT NULL",
        "rejects": "SELECT DISTINCT scene_id FROM scenes JOIN effective USING (image_id) WHERE effective_verdict = 'reject'",
    }
    for mode, ids in modes.items():
        out[f"filter_scenes_{mode}"] = _with(*REVIEWED) + f" SELECT scene_id, row_number() OVER (ORDER BY scene_id) AS scene_index FROM ({ids})"
    out["scene_cards"] = _with(*REVIEWED, RANKED) + """ SELECT scene_id, arg_min(image_id, rank) AS cover_id, count(*) AS n_images, count(*) > 1 AS is_burst
      FROM ranked GROUP BY scene_id"""
    middle = lambda k, s, m: f"round(CASE WHEN has_face THEN sharpness_score * {k} + sharpness_score * {s} / 2 ELSE (image_id % {m} + 1) / 2 END, 6)"
    out["focus_point"] = _with() + f" SELECT image_id, {middle(1.0, 3.0, 700)} AS focus_x, {middle(2.0, 4.0, 500)} AS focus_y FROM captures"
    entries = "SELECT image_id, file_path AS raw_file_path, CASE WHEN verdict IN ('keeper', 'reject') THEN verdict ELSE 'unrated' END AS verdict FROM export_requests JOIN captures USING (image_id)"
    out["export_entries"] = _with(EXPORT_REQUESTS_SQL) + " " + entries
    path = "regexp_replace({}, '([^/])\\.[^./]*$', '\\1') || '.xmp'"
    out["xmp_path"] = _with() + f" SELECT image_id, {path.format('file_path')} AS xmp_path FROM captures"
    content = f"CASE verdict WHEN 'keeper' THEN '{SIDECAR[KEEPER]}' ELSE '{SIDECAR[REJECT]}' END"
    out["xmp_sidecars"] = _with(EXPORT_REQUESTS_SQL) + f""", e AS ({entries}), w AS (
      SELECT '/shoots/IMG_' || (image_id // 10) || '.xmp' AS xmp_path, arg_max(verdict, image_id) AS verdict, count(*) - 1 AS collisions FROM e WHERE verdict <> 'unrated' GROUP BY 1
    ) SELECT xmp_path, verdict, {content} AS content, collisions FROM w"""
    failed = "verdict <> 'unrated' AND image_id % 1009 = 0"
    out["export_summary"] = _with(EXPORT_REQUESTS_SQL) + f""", e AS ({entries}) SELECT count(*) FILTER (verdict <> 'unrated' AND image_id % 1009 <> 0) AS files_written,
      count(*) FILTER (verdict = 'unrated') AS files_skipped, count(*) FILTER ({failed}) AS n_errors FROM e"""
    out["export_errors"] = _with(EXPORT_REQUESTS_SQL) + f", e AS ({entries}) SELECT {path.format('raw_file_path')} || ': denied' AS error FROM e WHERE {failed}"
    out["export_xmp"] = _with(EXPORT_REQUESTS_SQL) + f""", e AS ({entries}), w AS (
      SELECT 'IMG_' || (image_id // 10) || '.xmp' AS file_name, arg_max(verdict, image_id) AS verdict FROM e WHERE verdict <> 'unrated' GROUP BY 1
    ) SELECT file_name, sha256({content}) AS content_sha256 FROM w"""
    out["export_run"] = _with(EXPORT_REQUESTS_SQL) + f""", e AS ({entries}) SELECT count(*) FILTER (verdict <> 'unrated') AS files_written,
      count(*) FILTER (verdict = 'unrated') AS files_skipped, 0::BIGINT AS n_errors FROM e"""
    out["scene_report"] = _with(*CULLED) + f""" SELECT s.scene_id, count(*) AS n_images,
      coalesce(any_value({NAME.format('c.file_path')}), 'none') AS keeper
      FROM scenes s LEFT JOIN keepers k USING (scene_id) LEFT JOIN captures c ON c.image_id = k.keeper_id GROUP BY s.scene_id"""
    out["score_report"] = _with(*CULLED) + f""" SELECT image_id, {NAME.format('file_path')} AS file_name,
      printf('%.1f', sharpness_score) AS sharpness, CASE WHEN has_face THEN 'yes' ELSE 'no' END AS face,
      CASE WHEN image_id % 3 <> 0 THEN printf('%.3f', (image_id % 500) / 1000.0::DOUBLE) ELSE 'n/a' END AS ear,
      CASE verdict WHEN 'keeper' THEN 'KEEPER' WHEN 'reject' THEN 'REJECT (blink)' ELSE 'unrated' END AS verdict FROM verdicts"""
    yolo = lambda *more: "WITH RECURSIVE " + ", ".join([YOLO_SQL, *more])
    out["regions"] = yolo("""b AS (SELECT vec_id, raw[1] - 50 AS x, raw[2] - 50 AS y, raw[3] AS bw, raw[4] AS bh, vec_id % 300 + 1 AS w, vec_id % 200 + 1 AS h FROM yolo
    ), e AS (SELECT *, least(greatest(x, 0.0), w) AS l, least(greatest(y, 0.0), h) AS t FROM b
    ), f AS (SELECT *, least(bw, w - l) AS wide, least(bh, h - t) AS high FROM e
    ), g AS (SELECT *, greatest(0, trunc(l + wide * 0.1))::BIGINT AS ex, trunc(t)::BIGINT AS ey FROM f
    ), k AS (SELECT *, least(greatest(trunc(wide * 0.8)::BIGINT, 16), greatest(w - ex, 0)) AS ew, least(greatest(trunc(high * 0.4)::BIGINT, 16), greatest(h - ey, 0)) AS eh FROM g
    ), m AS (SELECT *, trunc(greatest(x - bw * 0.25, 0.0))::BIGINT AS x1, trunc(greatest(y - bh * 0.25, 0.0))::BIGINT AS y1,
      greatest(0, trunc(least(x + bw + bw * 0.25, w)))::BIGINT AS x2, greatest(0, trunc(least(y + bh + bh * 0.25, h)))::BIGINT AS y2 FROM k)""") + """
    SELECT vec_id, CASE WHEN least(ew, eh) >= 16 THEN concat_ws(',', ex, ey, ew, eh) ELSE '' END AS eye,
      CASE WHEN least(w // 2, h // 2) >= 16 THEN concat_ws(',', w // 4, h // 4, w // 2, h // 2) ELSE '' END AS center,
      concat_ws(',', x1, y1, greatest(x2 - x1, 1), greatest(y2 - y1, 1)) AS face FROM m"""
    r = lambda c, n=None: f"round({c}, 6) AS {n or c}"
    out["decode_yolo"] = yolo(DETECTIONS) + f" SELECT vec_id, pos, {', '.join(map(r, ('cx', 'cy', 'w', 'h', 'confidence')))} FROM detections"
    pair = _iou("a", "b")
    out["iou"] = yolo(DETECTIONS) + f" SELECT a.vec_id, round({pair}, 6) AS iou FROM detections a JOIN detections b ON a.vec_id = b.vec_id AND a.pos = 0 AND b.pos = 1"
    out["nms"] = yolo(DETECTIONS, f"""clash AS (
      SELECT a.vec_id, a.pos AS p, b.pos AS q FROM detections a JOIN detections b ON a.vec_id = b.vec_id AND a.pos < b.pos AND {pair} > 0.45
    ), kept AS (
      SELECT vec_id, 0::BIGINT AS step, CAST([] AS BIGINT[]) AS k FROM (SELECT DISTINCT vec_id FROM detections)
      UNION ALL
      SELECT x.vec_id, x.step + 1, CASE WHEN EXISTS (SELECT 1 FROM clash c WHERE c.vec_id = x.vec_id AND c.q = x.step AND list_contains(x.k, c.p)) THEN x.k ELSE list_append(x.k, x.step) END
      FROM kept x WHERE x.step < (SELECT count(*) FROM detections d WHERE d.vec_id = x.vec_id)
    ), final AS (
      SELECT vec_id, k FROM kept x WHERE step = (SELECT count(*) FROM detections d WHERE d.vec_id = x.vec_id)
    )""") + """ SELECT f.vec_id, list_position(f.k, d.pos)::BIGINT - 1 AS pos, round(d.confidence, 6) AS confidence
      FROM final f JOIN detections d ON d.vec_id = f.vec_id AND list_contains(f.k, d.pos)"""
    at = lambda row: f"raw[{row} * 10 + i + 1]"
    out["decode_yolo_classes"] = yolo(f"""c AS (SELECT vec_id, i, {at(0)} AS cx, {at(1)} AS cy, {at(2)} AS w, {at(3)} AS h, greatest(0.0, {at(4)}, {at(5)}) AS confidence
      FROM yolo, unnest(range(10)) AS u(i))""") + f""" SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, i) - 1 AS pos, {', '.join(map(r, ('cx', 'cy', 'w', 'h', 'confidence')))}
      FROM c WHERE confidence >= 0.1"""
    out["nms_rows"] = f"SELECT vec_id, confidence FROM ({out['nms']})"
    out["original_coords"] = yolo(DETECTIONS) + """, f AS (SELECT * FROM detections WHERE pos = 0), c AS (
      SELECT vec_id, greatest(0.0, cx / 0.64 - w / 0.64 / 2) AS x, greatest(0.0, (cy - 128) / 0.64 - h / 0.64 / 2) AS y,
        least(1000.0, cx / 0.64 + w / 0.64 / 2) AS x2, least(600.0, (cy - 128) / 0.64 + h / 0.64 / 2) AS y2 FROM f
    ) SELECT yolo.vec_id, c.vec_id IS NOT NULL AS has_face, round(x, 6) AS x, round(y, 6) AS y, round(x2 - x, 6) AS width, round(y2 - y, 6) AS height
      FROM yolo LEFT JOIN c ON c.vec_id = yolo.vec_id"""
    out["detect_blink"] = f"""WITH {LANDMARKS_SQL}, {EYE_POINTS}, e AS (SELECT vec_id, coalesce(len(raw) // k, 0)::BIGINT AS n_landmarks, {RIGHT} AS r, {LEFT} AS l FROM points)
      SELECT vec_id, n_landmarks, r < 1.0 AND l < 1.0 AS blink_detected, round(r, 6) AS right_ear, round(l, 6) AS left_ear, round((r + l) / 2, 6) AS average_ear FROM e"""
    out["fold_review_actions"] = _with(*CULLED, ACTIONS_SQL, FOLD) + " SELECT o.id AS image_id, o.v AS override FROM (SELECT unnest(state) AS o FROM fold WHERE step = n)"
    out["manifest_scores"] = _with(*CULLED) + " SELECT shoot_id, image_id, round(sharpness_score, 6) AS sharpness_score, has_face, blink_detected, verdict FROM verdicts"
    out["manifest_scenes"] = _with(*CULLED) + " SELECT shoot_id, scene_id, pos_in_scene, image_id, keeper_id FROM scenes LEFT JOIN keepers USING (scene_id)"
    totals = ", ".join(f"count(*) FILTER (verdict = '{v}') AS total_{n}" for v, n in (("keeper", "keepers"), ("reject", "rejects"), ("unrated", "unrated")))
    out["manifest_totals"] = _with(*CULLED) + f""" SELECT shoot_id, count(*) AS total_images, count(DISTINCT scene_id) AS total_scenes, {totals},
      1.5::DOUBLE AS processing_time_secs, round(1500.0::DOUBLE / count(*), 6) AS ms_per_image FROM verdicts JOIN scenes USING (shoot_id, image_id) GROUP BY shoot_id"""
    out["manifest_document"] = _with(*CULLED) + """ SELECT scene_id, pos_in_scene, image_id, keeper_id, round(sharpness_score, 6) AS sharpness_score, has_face, blink_detected, verdict
      FROM verdicts JOIN scenes USING (image_id) JOIN keepers USING (scene_id)"""
    out["manifest_document_totals"] = _with(*CULLED) + f" SELECT count(*) AS total_images, count(DISTINCT scene_id) AS total_scenes, {totals}, 1.5::DOUBLE AS processing_time_secs FROM verdicts JOIN scenes USING (image_id)"
    is_jpeg = " OR ".join(f"image_id % 4 = {n}" for n, h in enumerate(HEADS) if h.startswith("ffd8"))
    out["preview_dimensions"] = _with() + f""" SELECT image_id, CASE WHEN {is_jpeg} THEN image_id % 700 + 1 ELSE 0 END AS preview_width,
      CASE WHEN {is_jpeg} THEN image_id % 500 + 1 ELSE 0 END AS preview_height FROM captures"""
    return out | _image_sql()


#: Overrides of a scene after each of its key presses, as a list of structs.
FOLD = """pressed AS (
  SELECT scene_id, image_id, action, keeper_id, verdict, row_number() OVER (PARTITION BY scene_id ORDER BY seq) AS step, count(*) OVER (PARTITION BY scene_id) AS n
  FROM actions JOIN scenes USING (image_id) JOIN keepers USING (scene_id) JOIN (SELECT image_id, verdict FROM verdicts) USING (image_id)
), fold AS (
  SELECT DISTINCT scene_id, n, 0::BIGINT AS step, CAST([] AS STRUCT(id BIGINT, v VARCHAR)[]) AS state FROM pressed
  UNION ALL
  SELECT f.scene_id, f.n, p.step, CASE p.action
    WHEN 'K' THEN list_filter(f.state, lambda o: o.v <> 'keeper' AND o.id <> p.image_id AND o.id <> p.keeper_id)
      || CASE WHEN p.keeper_id <> p.image_id THEN [{'id': p.keeper_id, 'v': 'unrated'}] ELSE [] END || [{'id': p.image_id, 'v': 'keeper'}]
    WHEN 'X' THEN list_filter(f.state, lambda o: o.id <> p.image_id) || [{'id': p.image_id, 'v':
      CASE WHEN coalesce(list_filter(f.state, lambda o: o.id = p.image_id)[1].v, p.verdict) = 'reject' THEN 'unrated' ELSE 'reject' END}]
    ELSE list_filter(f.state, lambda o: o.id <> p.image_id) || [{'id': p.image_id, 'v': 'unrated'}] END
  FROM fold f JOIN pressed p ON p.scene_id = f.scene_id AND p.step = f.step + 1
)"""

#: Photos of 48 x 40 pixels.
NOISE = """tiles AS (
  SELECT image_id, y // 16 AS ty, x // 16 AS tx, v FROM gray WHERE y < 32 AND x < 32
), flat AS (
  SELECT * FROM (SELECT image_id, ty, tx, median(v) AS m, 256 * sum(v * v) - sum(v) * sum(v) AS s FROM tiles GROUP BY image_id, ty, tx)
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s, ty, tx) = 1
), noise AS (
  SELECT image_id, greatest(1.4826::DOUBLE * median(abs(v - m)), 0.1) AS noise FROM tiles JOIN flat USING (image_id, ty, tx) GROUP BY image_id
), around AS (
  SELECT image_id, y, x, v, lag(v) OVER r AS a, lead(v) OVER r AS b, lag(v) OVER c AS d, lead(v) OVER c AS e FROM gray
  WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)
), laplace AS (
  SELECT image_id, y, x, a + b + d + e - 4 * v AS l FROM around WHERE a + b + d + e IS NOT NULL
)"""


def _variance(x: int, y: int, w: int, h: int) -> str:
    """Laplacian variance of a crop, by photo."""
    inside = f"x > {x} AND x < {x + w - 1} AND y > {y} AND y < {y + h - 1}"
    return f"SELECT image_id, sum(l * l) / count(*)::DOUBLE - pow(sum(l) / count(*)::DOUBLE, 2) AS raw FROM laplace WHERE {inside} GROUP BY image_id"


#: 40 bits: the photo at 5 x 5 by a Lanczos filter, then signs of its differences.
HASH = """taps AS (
  SELECT n, i, j, ((j + 0.5::DOUBLE) - (i + 0.5::DOUBLE) * (n / 5.0::DOUBLE)) / (n / 5.0::DOUBLE) AS d FROM (VALUES (48), (40)) AS s(n), unnest(range(5)) AS a(i), unnest(range(n)) AS b(j)
), raw_weight AS (
  SELECT n, i, j, CASE WHEN d = 0 THEN 1 WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0 END AS w FROM taps
), weight AS (
  SELECT n, i, j, w / sum(w) OVER (PARTITION BY n, i) AS w FROM raw_weight
), down AS (
  SELECT image_id, i AS r, x, sum(w * v) AS v FROM gray JOIN weight ON n = 48 AND j = y GROUP BY ALL
), small AS (
  SELECT image_id, r, i AS c, least(255, greatest(0, round_even(sum(w * v), 0)))::BIGINT AS v FROM down JOIN weight ON n = 40 AND j = x GROUP BY ALL
), bits AS (
  SELECT a.image_id, CASE WHEN a.r = b.r THEN a.r * 4 + a.c ELSE 20 + a.r * 5 + a.c END AS place, a.v < b.v AS bit
  FROM small a JOIN small b ON a.image_id = b.image_id AND ((a.r = b.r AND a.c + 1 = b.c) OR (a.c = b.c AND a.r + 1 = b.r))
), hashes AS (
  SELECT image_id, sum(CASE WHEN bit THEN (1::BIGINT << place::INTEGER) ELSE 0 END)::BIGINT AS phash FROM bits GROUP BY image_id
)"""

#: A face of 39 x 23.25 pixels where the first pixel is red enough, closed eyes where the face's first one is.
ANALYZED = f"""first AS (
  SELECT image_id, max(CASE WHEN y = 0 THEN r END) / 255.0 > 0.3 AS has_face, max(CASE WHEN y = 6 THEN r END) / 255.0 > 0.5 AS closed FROM px WHERE x = 0 GROUP BY image_id
), eye AS ({_variance(4, 12, 31, 16)}), middle AS ({_variance(10, 12, 20, 24)}), analyzed AS (
  SELECT image_id, CASE WHEN has_face THEN eye.raw ELSE middle.raw END / noise AS sharpness_score, has_face, has_face AND closed AS blink_detected,
    CASE WHEN has_face THEN CASE WHEN closed THEN 0.25 / 3 ELSE 2.0 / 3 END END AS ear, phash
  FROM first JOIN eye USING (image_id) JOIN middle USING (image_id) JOIN noise USING (image_id) JOIN hashes USING (image_id)
)"""


def _image_sql() -> dict[str, str]:
    out = {}
    of = lambda *more: "WITH RECURSIVE " + ", ".join([PATCHES_SQL, *more])
    digest = lambda v, by="y, x": f"sha256(string_agg(printf('%02x', ({v})::INTEGER), '' ORDER BY {by}))"
    out["image_gray"] = of() + f" SELECT image_id, {digest('v')} AS gray_sha256 FROM gray GROUP BY image_id"
    out["decoded_images"] = of() + f" SELECT image_id, NULL::VARCHAR AS error, 40 AS width, 48 AS height, {digest('v')} AS gray_sha256 FROM gray GROUP BY image_id"
    out["image_focus"] = of(NOISE) + f" SELECT image_id, round(raw, 6) AS laplacian_variance, round(noise, 6) AS noise FROM ({_variance(0, 0, 40, 48)}) JOIN noise USING (image_id)"
    out["score_sharpness"] = of(NOISE) + f""" SELECT image_id, round(raw / noise, 6) AS sharpness_score, round(raw, 6) AS raw_variance, round(noise, 6) AS noise_estimate,
      'center' AS scored_region FROM ({_variance(10, 12, 20, 24)}) JOIN noise USING (image_id)"""
    out["image_hash"] = of(HASH) + " SELECT image_id, phash FROM hashes"
    near = "least(39, greatest(0, (x2 - 1) // 2 + CASE WHEN x2 % 2 = 1 THEN 1 ELSE 0 END))"
    doubled = " UNION ALL ".join(f"SELECT a.image_id, a.y, x2, {n} AS c, (3 * a.{ch} + b.{ch}) / 4.0::DOUBLE AS v FROM wide JOIN px a ON a.x = x2 // 2 JOIN px b ON b.image_id = a.image_id AND b.y = a.y AND b.x = other" for n, ch in enumerate("rgb"))
    out["image_resize"] = of(f"wide AS (SELECT x2, {near} AS other FROM unnest(range(80)) AS u(x2)), doubled AS ({doubled})") + f" SELECT image_id, {digest('round_even(v, 0)', 'y, x2, c')} AS rgb_sha256 FROM doubled GROUP BY image_id"
    boxed = " UNION ALL ".join(f"SELECT p.image_id, u.y, u.x, {n} AS c, coalesce(px.{ch}, 114) AS v FROM (SELECT DISTINCT image_id FROM patches) p, (SELECT y, x FROM unnest(range(48)) AS s(y), unnest(range(50)) AS t(x)) u LEFT JOIN px ON px.image_id = p.image_id AND px.y = u.y AND px.x = u.x - 5" for n, ch in enumerate("rgb"))
    out["image_letterbox"] = of(f"boxed AS ({boxed})") + f" SELECT image_id, {digest('v', 'y, x, c')} AS rgb_sha256, 1.0::DOUBLE AS scale, 5.0::DOUBLE AS pad_x FROM boxed GROUP BY image_id"
    value = lambda ch, y, x, mean, std: f"max(CASE WHEN y = {y} AND x = {x} THEN (({ch}::FLOAT / 255::FLOAT - {mean}::FLOAT) / {std}::FLOAT)::DOUBLE END)"
    out["image_tensor"] = of() + f""" SELECT image_id, 5760::BIGINT AS n, {value('r', 0, 0, 0.485, 0.229)} AS red, {value('g', 1, 5, 0.456, 0.224)} AS green,
      {value('b', 47, 39, 0.406, 0.225)} AS blue FROM px GROUP BY image_id"""
    scaled = lambda ch, mean, std: f"round((({ch}::FLOAT / 255::FLOAT - {mean}::FLOAT) / {std}::FLOAT)::DOUBLE * 1000)::BIGINT"
    channels = [(n, ch, mean, std) for n, (ch, mean, std) in enumerate((("r", 0.485, 0.229), ("g", 0.456, 0.224), ("b", 0.406, 0.225)))]
    nchw = " + ".join(f"{scaled(ch, mean, std)} * (({n} * 1920 + y * 40 + x) % 1009 + 1)" for n, ch, mean, std in channels)
    nhwc = " + ".join(f"{scaled(ch, mean, std)} * ((3 * (y * 40 + x) + {n}) % 1009 + 1)" for n, ch, mean, std in channels)
    out["image_tensor_digest"] = of() + f" SELECT image_id, sum({nchw})::BIGINT AS nchw, sum({nhwc})::BIGINT AS nhwc FROM px GROUP BY image_id"
    dot = lambda w: f"round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ({w}))), 6)"
    out["model_scores"] = f"SELECT vec_id, {dot('(i - 1) % 5 - 2')} AS a, {dot('(i - 1) % 3 + 1')} AS b FROM embeddings"
    of_jpegs = lambda *more: "WITH RECURSIVE " + ", ".join([JPEGS_SQL, *more])
    analyzed = """ SELECT image_id, round(sharpness_score, 6) AS sharpness_score, has_face, CASE WHEN has_face THEN 0.525 END AS face_x,
      CASE WHEN has_face THEN 12.375 END AS face_y, CASE WHEN has_face THEN 39.0 END AS face_width, CASE WHEN has_face THEN 23.25 END AS face_height, blink_detected,
      round(ear, 6) AS eye_aspect_ratio, phash FROM analyzed"""
    out["analyzed_images"], out["analyzed_previews"] = of(NOISE, HASH, ANALYZED) + analyzed, of_jpegs(NOISE, HASH, ANALYZED) + analyzed
    out["decoded_jpegs"] = of_jpegs() + f" SELECT image_id, NULL::VARCHAR AS error, 40 AS width, 48 AS height, {digest('v')} AS gray_sha256 FROM gray GROUP BY image_id"
    photos = """captures AS (
      SELECT *, image_id // 20 AS shoot_id, CASE WHEN image_id % 17 <> 0 THEN image_id * 1500 + image_id // 5 * 20000000 END AS ts_ms FROM analyzed
    )"""
    out["culled_images"] = of(NOISE, HASH, ANALYZED, photos, *CULLED) + " SELECT image_id, verdict, reject_reason FROM verdicts"
    out["culled_previews"] = of_jpegs(NOISE, HASH, ANALYZED, photos, *CULLED) + " SELECT image_id, verdict, reject_reason FROM verdicts"
    return out


ORACLES = _sql()
