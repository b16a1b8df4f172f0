"""The results of ``geoweave.queries`` as SQL for DuckDB."""

from __future__ import annotations

from geoweave.operators.rays import DIRECTIONS
from geoweave.sources.derived import LABELS, READINGS, RECTANGLES, SEGMENTS
from geoweave.sources.ingest import PASSES
from geoweave.streaming.progress import LOG_STEPS, STEPS

SEG = f"seg AS ({SEGMENTS}), green AS (SELECT * FROM seg WHERE layer = 'green'), route AS (SELECT * FROM seg WHERE layer = 'route')"
LBL = f"lbl AS ({LABELS})"
READ = f"rd AS ({READINGS})"
RECT = f"rect AS ({RECTANGLES})"


def turn(ax, ay, bx, by, cx, cy):
    return f"(({bx}-{ax})*({cy}-{ay})-({by}-{ay})*({cx}-{ax}))"


def meet(a, b):
    p, q = [f"{a}.{c}" for c in ("x1", "y1", "x2", "y2")], [f"{b}.{c}" for c in ("x1", "y1", "x2", "y2")]
    return (
        f"greatest({p[0]},{p[2]})>=least({q[0]},{q[2]}) AND greatest({q[0]},{q[2]})>=least({p[0]},{p[2]}) AND greatest({p[1]},{p[3]})>=least({q[1]},{q[3]}) AND greatest({q[1]},{q[3]})>=least({p[1]},{p[3]})"
        f" AND sign({turn(*q, p[0], p[1])})*sign({turn(*q, p[2], p[3])})<=0 AND sign({turn(*p, q[0], q[1])})*sign({turn(*p, q[2], q[3])})<=0"
    )


ANGLE = "((degrees(atan2(y2-y1, x2-x1)) + 360) % 180)"
LEN = "sqrt(CAST((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS DOUBLE))"

DRAWN = """dr AS (SELECT o_orderkey - o_orderkey % 500 AS map_id, o_orderkey AS drawing_id, o_orderkey AS k, (o_orderkey * 7919) % 1000 AS x, (o_orderkey * 104729) % 600 AS y,
 CASE WHEN o_orderkey % 5 = 0 THEN 'f' WHEN o_orderkey % 5 = 1 THEN 'fs' ELSE 's' END AS type, (o_orderkey % 8) / 4 AS width,
 CASE o_orderkey % 7 WHEN 0 THEN 0.05 WHEN 1 THEN 0.98 WHEN 2 THEN 0.9 WHEN 3 THEN 0.3 WHEN 4 THEN 0.0 WHEN 5 THEN 0.9 END AS r,
 CASE o_orderkey % 7 WHEN 0 THEN 0.6 WHEN 1 THEN 0.02 WHEN 2 THEN 0.1 WHEN 3 THEN 0.5 WHEN 4 THEN 0.0 WHEN 5 THEN 0.4 END AS g,
 CASE o_orderkey % 7 WHEN 0 THEN 0.05 WHEN 1 THEN 0.01 WHEN 2 THEN 0.95 WHEN 3 THEN 0.1 WHEN 4 THEN 0.0 WHEN 5 THEN 0.4 END AS b,
 CASE WHEN o_orderkey % 7 IN (0, 3) THEN 'green' WHEN o_orderkey % 7 IN (1, 2) THEN 'route' END AS layer FROM orders),
cl AS (SELECT * FROM dr WHERE type <> 'f' AND layer IS NOT NULL AND NOT (layer = 'green' AND k % 4 IN (0, 2) AND 5 + k % 40 < 30 AND 5 + k % 25 < 20))"""

VALID = "regexp_matches({0}, '^[0-9]{{2,3}}(/[0-9]{{1,2}})?$')"
BVALID = "regexp_matches({0}, '^[0-9]{{1,3}}(/[0-9]{{1,2}})?$')"


def repaired(table: str) -> str:
    """CTEs that end in rep(text, repaired) for the distinct texts of ``table``."""
    forms = ["CASE WHEN length(r) = 4 THEN r[:3] || '/' || r[4] END"]
    forms += [f"CASE WHEN length(r) IN (5, 6) AND r[{i}] IN ('7', '1') THEN r[:{i - 1}] || '/' || r[{i + 1}:] END" for i in range(2, 7)]
    forms += [f"CASE WHEN length(r) IN (5, 6) THEN r[:{i}] || '/' || r[{i + 1}:] END" for i in (3, 2)]
    tries = " ".join(f"WHEN {VALID.format(f'({f})')} THEN {f}" for f in forms)
    return f"""
txt AS (SELECT DISTINCT text FROM {table}), bare AS (SELECT text, trim(text) AS s, regexp_replace(trim(text), '/+$', '') AS b FROM txt),
rest AS (SELECT text, s, b, unnest(range(0, greatest(1, 1 + least(length(regexp_extract(b, '^([07]*)', 1)), length(b) - 1)))) AS k FROM bare),
cut AS (SELECT *, substr(b, CAST(k + 1 AS BIGINT)) AS r, ends_with(s, '/') AS slash FROM rest),
made AS (SELECT *, CASE WHEN {VALID.format('r')} THEN r END AS plain, CASE WHEN regexp_matches(r, '^[0-9]+$') THEN CASE {tries} END END AS slashed FROM cut),
rep AS (SELECT text, coalesce(CASE WHEN bool_or(slash) THEN arg_max(coalesce(plain, slashed), k) FILTER (WHERE coalesce(plain, slashed) IS NOT NULL)
  ELSE coalesce(arg_min(plain, k) FILTER (WHERE plain IS NOT NULL), arg_max(slashed, k) FILTER (WHERE slashed IS NOT NULL)) END, any_value(s)) AS repaired FROM made GROUP BY text)"""


LOADED = f"""{LBL}, {repaired('lbl')},
ok AS (SELECT map_id, label_ord, repaired AS text, conf, source, x, y FROM lbl JOIN rep USING (text)
 WHERE {VALID.format('repaired')} AND conf >= CASE WHEN source = 'easy_high' THEN 0.25 ELSE 0.4 END
 AND NOT (regexp_matches(repaired, '^[0-9]{{2}}$') AND conf < 0.5) AND NOT ends_with(repaired, '/0'))"""

RAYS = "rays AS (SELECT map_id, label_ord, ray, x AS x1, y AS y1, x + dx AS x2, y + dy AS y2 FROM lbl CROSS JOIN (VALUES " + ", ".join(f"({i}, {dx}.0e0, {dy}.0e0)" for i, (dx, dy) in enumerate(DIRECTIONS)) + ") v(ray, dx, dy))"
CROSSED = f"crossed AS (SELECT DISTINCT g.map_id, g.seg_id FROM green g JOIN route r ON g.map_id = r.map_id AND {meet('g', 'r')})"
FIRST = f"""hits AS (SELECT l.map_id, l.label_ord, l.ray, r.seg_id, ((r.x1-l.x1)*(r.y2-r.y1)-(r.y1-l.y1)*(r.x2-r.x1)) / nullif((l.x2-l.x1)*(r.y2-r.y1)-(l.y2-l.y1)*(r.x2-r.x1), 0) AS t
 FROM rays l JOIN green r ON l.map_id = r.map_id AND {meet('l', 'r')}),
firsts AS (SELECT map_id, label_ord, ray, arg_min(seg_id, (t, seg_id)) AS seg_id, min(t) AS t FROM hits WHERE t > 1e-6 GROUP BY ALL)"""

POINTS = "pts AS (SELECT map_id, seg_id AS ord, CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y, CAST(x2 - x1 AS DOUBLE) AS dx, CAST(y2 - y1 AS DOUBLE) AS dy FROM route)"

RING = """ring AS (SELECT map_id, face_id, 0 AS ord, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM rect UNION ALL SELECT map_id, face_id, 1, x1, y0, x1, y1 FROM rect
 UNION ALL SELECT map_id, face_id, 2, x1, y1, x0, y1 FROM rect UNION ALL SELECT map_id, face_id, 3, x0, y1, x0, y0 FROM rect)"""

TRUTH = f"{LBL}, f AS (SELECT DISTINCT map_id, text FROM lbl WHERE conf >= 0.2), t AS (SELECT DISTINCT map_id, text FROM lbl WHERE y < 480), oc AS (SELECT coalesce(f.map_id, t.map_id) AS map_id, coalesce(f.text, t.text) AS text, CASE WHEN f.text IS NULL THEN 'fn' WHEN t.text IS NULL THEN 'fp' ELSE 'tp' END AS outcome FROM f FULL JOIN t ON f.map_id = t.map_id AND f.text = t.text)"

PROGRESS = "pv AS (SELECT user_id AS job_id, event_id AS seq, ts, event_id % 9 AS idx, event_id % 3 = 0 AS complete FROM events), st AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {w})" for i, (k, _, w) in enumerate(STEPS)) + ") v(idx, step, weight))"


def fold(near_x: str, near_y: str, act: str, replace: str) -> str:
    """An ordered fold of readings as recursion: one reading of each map per step.

    ``act`` (on k, n) says whether kept reading k settles new reading n: 0 no, 1 n
    is dropped, 2 n takes k's place. State rows carry the kept readings by slot.
    """
    del near_x, near_y, replace
    return f"""
num AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY ord) AS i FROM rd),
walk AS (
 SELECT map_id, i, [{{'ord': ord, 'text': text, 'conf': conf, 'x': x, 'y': y, 'source': source}}] AS kept FROM num WHERE i = 1
 UNION ALL
 SELECT w.map_id, n.i, CASE
   WHEN list_position(list_transform(w.kept, lambda k: ({act}) > 0), true) IS NULL THEN list_append(w.kept, {{'ord': n.ord, 'text': n.text, 'conf': n.conf, 'x': n.x, 'y': n.y, 'source': n.source}})
   WHEN list_transform(w.kept, lambda k: {act})[list_position(list_transform(w.kept, lambda k: ({act}) > 0), true)] = 1 THEN w.kept
   ELSE list_transform(w.kept, lambda k, j: CASE WHEN j = list_position(list_transform(w.kept, lambda q: ({act.replace('k.', 'q.')}) > 0), true) THEN {{'ord': n.ord, 'text': n.text, 'conf': n.conf, 'x': n.x, 'y': n.y, 'source': n.source}} ELSE k END) END
 FROM walk w JOIN num n ON n.map_id = w.map_id AND n.i = w.i + 1),
last AS (SELECT map_id, unnest(arg_max(kept, i)) AS k FROM walk GROUP BY map_id)
SELECT map_id, k.ord AS ord, k.text AS text, k.conf AS conf, k.x AS x, k.y AS y, k.source AS source FROM last"""


def _dominates(a, b):
    rest = f"substr({a}.text, length({b}.text) + 1)"
    return f"(CASE WHEN {a}.text = {b}.text THEN {a}.conf >= {b}.conf ELSE starts_with({a}.text, {b}.text) AND length({a}.text) > length({b}.text) AND (starts_with({rest}, '/') OR (length({b}.text) <= 2 AND NOT contains({b}.text, '/') AND regexp_matches({rest}, '^[0-9]+$'))) END)"


DEDUP = f"CASE WHEN NOT (abs(n.x - k.x) < 20 AND abs(n.y - k.y) < 20) THEN 0 WHEN {_dominates('k', 'n')} THEN 1 WHEN {_dominates('n', 'k')} THEN 2 WHEN abs(n.x - k.x) < 5 AND abs(n.y - k.y) < 5 THEN CASE WHEN k.conf >= n.conf THEN 1 ELSE 2 END ELSE 0 END"
MERGE = "CASE WHEN k.text = n.text AND abs(n.x - k.x) < 30 AND abs(n.y - k.y) < 30 THEN CASE WHEN n.conf > k.conf THEN 2 ELSE 1 END ELSE 0 END"
CHUNK = "CASE WHEN abs(n.x - k.x) < 50 AND abs(n.y - k.y) < 30 THEN CASE WHEN length(n.text) > length(k.text) OR (length(n.text) = length(k.text) AND n.conf > k.conf) THEN 2 ELSE 1 END ELSE 0 END"
GAPS = f"CASE WHEN n.source = 'tess' AND {BVALID.format('k.text')} AND abs(n.x - k.x) < 40 AND abs(n.y - k.y) < 40 THEN 1 ELSE 0 END"

ORACLE: dict[str, str] = {
    "flatten_items": f"""WITH {DRAWN},
it AS (SELECT map_id, drawing_id, layer, k, x, y, CASE WHEN k % 4 = 1 THEN 're' WHEN k % 4 = 3 THEN 'c' ELSE 'l' END AS kind, 0 AS item FROM cl
 UNION ALL SELECT map_id, drawing_id, layer, k, x, y, CASE WHEN k % 4 = 0 THEN 'c' ELSE 'l' END, 1 FROM cl WHERE k % 4 IN (0, 2)),
s AS (SELECT map_id, drawing_id, item, 0 AS side, layer, x AS x1, y AS y1, x + k % 11 AS x2, y + 3 AS y2 FROM it WHERE kind = 'l'
 UNION ALL SELECT map_id, drawing_id, item, 0, layer, x, y, x + 7, y + k % 5 FROM it WHERE kind = 'c'
 UNION ALL SELECT map_id, drawing_id, item, 0, layer, x, y, x + 4 + k % 9, y FROM it WHERE kind = 're'
 UNION ALL SELECT map_id, drawing_id, item, 1, layer, x + 4 + k % 9, y, x + 4 + k % 9, y + 6 FROM it WHERE kind = 're'
 UNION ALL SELECT map_id, drawing_id, item, 2, layer, x + 4 + k % 9, y + 6, x, y + 6 FROM it WHERE kind = 're'
 UNION ALL SELECT map_id, drawing_id, item, 3, layer, x, y + 6, x, y FROM it WHERE kind = 're')
SELECT map_id, drawing_id, item, side, layer, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM s WHERE x1 <> x2 OR y1 <> y2""",
    "classify_layer": f"WITH {DRAWN}, a AS (SELECT *, CASE WHEN r < 0.15 AND g > 0.3 AND g < 0.85 AND b < 0.15 THEN 'green' WHEN r > 0.85 AND g < 0.15 AND b < 0.15 THEN 'route' END AS l FROM dr WHERE type <> 'f') SELECT map_id, drawing_id, l AS layer, width FROM a WHERE l = 'green' OR (l = 'route' AND width > 1.0)",
    "glyph_filter": f"WITH {DRAWN} SELECT map_id, layer, count(*) AS n FROM cl GROUP BY ALL",
    "skipped_items": f"WITH {DRAWN} SELECT map_id, 'qu' AS kind, count(*) AS n FROM dr WHERE k % 4 = 2 GROUP BY ALL",
    "color_width_top15": f"WITH {DRAWN} SELECT r, g, b, width, count(*) AS n FROM dr GROUP BY ALL ORDER BY n DESC, r NULLS FIRST, g NULLS FIRST, b NULLS FIRST, width LIMIT 15",
    "width_split": """WITH w AS (SELECT DISTINCT l_orderkey - l_orderkey % 500 AS map_id, round(((l_orderkey * 7 + l_orderkey % 500) % 17) * (l_orderkey % 5) / 8, 2) AS w FROM lineitem),
g AS (SELECT map_id, w, lag(w) OVER (PARTITION BY map_id ORDER BY w) AS b FROM w WHERE w > 0), q AS (SELECT *, round(w - b, 6) AS gap FROM g),
s AS (SELECT map_id, max(w) - min(w) AS rng, max(gap) AS gap FROM q GROUP BY map_id)
SELECT q.map_id, s.gap, min((q.b + q.w) / 2) AS threshold FROM q JOIN s ON q.map_id = s.map_id AND q.gap = s.gap WHERE s.rng >= 0.3 GROUP BY ALL""",
    "crossing_pairs": f"WITH {SEG} SELECT g.map_id, g.seg_id AS green_id, r.seg_id AS route_id FROM green g JOIN route r ON g.map_id = r.map_id AND {meet('g', 'r')}",
    "green_crossed_semi": f"WITH {SEG}, {CROSSED} SELECT * FROM crossed",
    "route_extent": f"WITH {SEG} SELECT map_id, min(least(x1, x2)) AS x_min, max(greatest(x1, x2)) AS x_max, min(least(y1, y2)) AS y_min, max(greatest(y1, y2)) AS y_max, count(*) AS n_segments FROM route GROUP BY map_id",
    "route_endpoints": f"""WITH {SEG}, p AS (SELECT map_id, seg_id, x1 AS x, y1 AS y FROM route UNION ALL SELECT map_id, seg_id, x2, y2 FROM route),
b AS (SELECT map_id, max(x) - min(x) >= max(y) - min(y) AS wide FROM p GROUP BY map_id), q AS (SELECT p.*, CASE WHEN wide THEN x ELSE y END AS a, CASE WHEN wide THEN y ELSE x END AS c FROM p JOIN b USING (map_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY a, c, seg_id) AS i, row_number() OVER (PARTITION BY map_id ORDER BY a DESC, c, seg_id) AS j FROM q)
SELECT map_id, max(x) FILTER (WHERE i = 1) AS start_x, max(y) FILTER (WHERE i = 1) AS start_y, max(x) FILTER (WHERE j = 1) AS end_x, max(y) FILTER (WHERE j = 1) AS end_y FROM o GROUP BY map_id""",
    "segment_angles": f"WITH {SEG} SELECT map_id, seg_id, round({LEN}, 6) AS length, round({ANGLE}, 6) AS angle, round(least({ANGLE}, 180 - {ANGLE}), 6) AS off_axis FROM seg",
    "angle_bucket_best": f"""WITH {SEG}, b AS (SELECT map_id, seg_id, CAST(least(floor({ANGLE} / 10), 17) AS INT) AS bucket, {LEN} AS len FROM seg), s AS (SELECT map_id, bucket, sum(len) AS len, min(seg_id) AS first FROM b GROUP BY ALL),
a AS (SELECT s.map_id, s.bucket, s.first, round(sum(n.len), 6) AS total FROM s JOIN s n ON s.map_id = n.map_id AND (n.bucket - s.bucket + 18) % 18 IN (0, 1, 17) GROUP BY ALL)
SELECT map_id, arg_max(bucket, (total, -first)) AS bucket, max(total) AS total FROM a GROUP BY map_id""",
    "pca_direction": f"WITH {SEG}, {POINTS} SELECT map_id, count(*) AS n, round(degrees(atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2), 5) AS axis FROM pts GROUP BY map_id HAVING count(*) >= 4",
    "oriented_direction": f"""WITH RECURSIVE {SEG}, {POINTS}, num AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY ord) AS i FROM pts),
w AS (SELECT map_id, i, dx AS sx, dy AS sy FROM num WHERE i = 1 UNION ALL SELECT w.map_id, n.i, sx + CASE WHEN sx * n.dx + sy * n.dy < 0 THEN -1 ELSE 1 END * n.dx, sy + CASE WHEN sx * n.dx + sy * n.dy < 0 THEN -1 ELSE 1 END * n.dy FROM w JOIN num n ON n.map_id = w.map_id AND n.i = w.i + 1)
SELECT map_id, round(arg_max(sx, i) / sqrt(arg_max(sx, i) ** 2 + arg_max(sy, i) ** 2), 6) AS ux, round(arg_max(sy, i) / sqrt(arg_max(sx, i) ** 2 + arg_max(sy, i) ** 2), 6) AS uy FROM w GROUP BY map_id""",
    "cluster_1d": f"""WITH {SEG}, f AS (SELECT map_id, x1, seg_id, CASE WHEN x1 - lag(x1) OVER (PARTITION BY map_id ORDER BY x1, seg_id) <= 15 THEN 0 ELSE 1 END AS new FROM route),
c AS (SELECT map_id, x1, CAST(sum(new) OVER (PARTITION BY map_id ORDER BY x1, seg_id) AS BIGINT) AS cluster FROM f) SELECT map_id, cluster, count(*) AS n, min(x1) AS lo, max(x1) AS hi FROM c GROUP BY ALL""",
    "last_kept_thinning": f"""WITH RECURSIVE {SEG}, {POINTS}, num AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY ord) AS i FROM pts),
w AS (SELECT map_id, i, ord, x, y, true AS keep FROM num WHERE i = 1 UNION ALL SELECT w.map_id, n.i, CASE WHEN sqrt((n.x - w.x) ** 2 + (n.y - w.y) ** 2) >= 120 THEN n.ord ELSE w.ord END, CASE WHEN sqrt((n.x - w.x) ** 2 + (n.y - w.y) ** 2) >= 120 THEN n.x ELSE w.x END, CASE WHEN sqrt((n.x - w.x) ** 2 + (n.y - w.y) ** 2) >= 120 THEN n.y ELSE w.y END, sqrt((n.x - w.x) ** 2 + (n.y - w.y) ** 2) >= 120 FROM w JOIN num n ON n.map_id = w.map_id AND n.i = w.i + 1)
SELECT map_id, ord, x, y FROM w WHERE keep""",
    "radius_clusters": f"""WITH RECURSIVE {SEG}, {POINTS}, num AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY ord) AS i FROM pts),
w AS (SELECT map_id, i, [{{'x': x, 'y': y, 'dx': dx, 'dy': dy}}] AS seeds FROM num WHERE i = 1
 UNION ALL SELECT w.map_id, n.i, CASE WHEN list_position(list_transform(w.seeds, lambda s: sqrt((s.x - n.x) ** 2 + (s.y - n.y) ** 2) <= 60), true) IS NULL THEN list_append(w.seeds, {{'x': n.x, 'y': n.y, 'dx': n.dx, 'dy': n.dy}}) ELSE w.seeds END FROM w JOIN num n ON n.map_id = w.map_id AND n.i = w.i + 1),
s AS (SELECT map_id, arg_max(seeds, i) AS seeds FROM w GROUP BY map_id),
m AS (SELECT p.*, seeds, list_position(list_transform(seeds, lambda s: sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) <= 60), true) AS cluster FROM pts p JOIN s USING (map_id)),
v AS (SELECT *, CASE WHEN dx * seeds[cluster].dx + dy * seeds[cluster].dy < 0 THEN -1.0 ELSE 1.0 END AS side FROM m)
SELECT map_id, CAST(cluster AS INT) AS cluster, round(avg(x), 6) AS x, round(avg(y), 6) AS y, sum(side * dx)::DOUBLE AS dx, sum(side * dy)::DOUBLE AS dy, count(*) AS n FROM v GROUP BY map_id, cluster""",
    "ring_edges": f"WITH {RECT}, {RING} SELECT * FROM ring",
    "ray_all_hits": f"WITH {SEG}, {LBL}, {RAYS} SELECT l.map_id, l.label_ord, l.ray, r.seg_id FROM rays l JOIN green r ON l.map_id = r.map_id AND {meet('l', 'r')}",
    "ray_first_hit": f"WITH {SEG}, {LBL}, {RAYS}, {FIRST} SELECT map_id, label_ord, ray, seg_id, round(t, 10) AS t FROM firsts",
    "ray_crossed_labels": f"WITH {SEG}, {LBL}, {RAYS}, {CROSSED}, c AS (SELECT g.* FROM green g SEMI JOIN crossed c ON g.map_id = c.map_id AND g.seg_id = c.seg_id), h AS (SELECT DISTINCT l.map_id, l.label_ord FROM rays l JOIN c ON l.map_id = c.map_id AND {meet('l', 'c')}) SELECT map_id, label_ord, text FROM lbl SEMI JOIN h USING (map_id, label_ord)",
    "ray_first_crossed_labels": f"WITH {SEG}, {LBL}, {RAYS}, {CROSSED}, {FIRST}, h AS (SELECT DISTINCT f.map_id, f.label_ord FROM firsts f SEMI JOIN crossed c ON f.map_id = c.map_id AND f.seg_id = c.seg_id) SELECT map_id, label_ord, text FROM lbl SEMI JOIN h USING (map_id, label_ord)",
    "label_repair": f"""WITH {LBL}, every AS (SELECT unnest(regexp_extract_all(text, '[0-9]{{2,6}}')) AS text FROM documents UNION ALL SELECT text FROM lbl), {repaired('every')},
sl AS (SELECT text, repaired, CASE WHEN {BVALID.format('trim(text)')} THEN trim(text) ELSE regexp_replace(trim(text), '/+$', '') END AS s FROM rep)
SELECT text, repaired, CASE WHEN {BVALID.format('s')} THEN s WHEN starts_with(s, '7') AND {BVALID.format('substr(s, 2)')} THEN substr(s, 2) WHEN regexp_matches(s, '^[0-9]{{4}}$') THEN s[:3] || '/' || s[4] ELSE trim(text) END AS reading FROM sl""",
    "label_filter": f"WITH {LOADED} SELECT map_id, label_ord, text, conf FROM ok",
    "best_label_per_text": f"WITH {LOADED} SELECT map_id, text, label_ord, conf, x, y FROM ok QUALIFY row_number() OVER (PARTITION BY map_id, text ORDER BY conf DESC, label_ord) = 1",
    "closest_label_per_text": f"WITH {LOADED} SELECT map_id, text, label_ord, conf, x, y, abs(x - 500) AS dist FROM ok QUALIFY row_number() OVER (PARTITION BY map_id, text ORDER BY abs(x - 500), label_ord) = 1",
    "one_label_per_face": f"WITH {LBL} SELECT map_id, CAST(floor(x / 100) AS INT) AS face_id, label_ord, text FROM lbl QUALIFY row_number() OVER (PARTITION BY map_id, floor(x / 100) ORDER BY conf DESC, length(text) DESC, label_ord) = 1",
    "label_dedup": f"WITH RECURSIVE {READ}, {fold('', '', DEDUP, '')}",
    "pass_merge": f"WITH RECURSIVE {READ}, {fold('', '', MERGE, '')}",
    "chunk_merge": f"WITH RECURSIVE {READ}, {fold('', '', CHUNK, '')}",
    "tesseract_gaps": f"WITH RECURSIVE {READ}, {fold('', '', GAPS, '')}".replace("ORDER BY ord) AS i FROM rd)", f"ORDER BY source = 'tess', ord) AS i FROM rd WHERE source <> 'tess' OR (conf >= 0.3 AND {BVALID.format('text')}))"),
    "face_area": f"WITH {RECT} SELECT map_id, face_id, (x1 - x0) * (y1 - y0) AS area FROM rect",
    "point_in_face": f"WITH {RECT}, p AS (SELECT CAST(c_custkey - c_custkey % 50 AS BIGINT) AS map_id, CAST(c_custkey AS BIGINT) AS label_ord, (c_custkey * 6007) % 1000 + 0.5e0 AS x, (c_custkey * 50021) % 500 + 0.25e0 AS y FROM customer) SELECT p.map_id, p.label_ord, r.face_id FROM p JOIN rect r ON p.map_id = r.map_id AND p.x > r.x0 AND p.x < r.x1 AND p.y > r.y0 AND p.y < r.y1",
    "eval_outcomes": f"WITH {TRUTH} SELECT * FROM oc",
    "eval_rollup": f"WITH {TRUTH} SELECT map_id, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM oc GROUP BY ROLLUP (map_id)",
    "set_diff_lists": f"WITH {TRUTH} SELECT map_id, coalesce(string_agg(text, ',' ORDER BY text) FILTER (WHERE outcome = 'fn'), '') AS missed, coalesce(string_agg(text, ',' ORDER BY text) FILTER (WHERE outcome = 'fp'), '') AS surplus FROM oc GROUP BY map_id",
    "variant_report": f"""WITH {TRUTH}, v AS (SELECT 'A' AS variant, outcome FROM oc UNION ALL SELECT 'B', 'tp' FROM t), n AS (SELECT variant, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM v GROUP BY variant)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, fp + fn = 0 AS perfect FROM n""",
    "gt_parse": """WITH l AS (SELECT o_orderkey - o_orderkey % 500 AS doc, o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'M' || (o_orderkey % 3) || ':' WHEN o_orderkey % 10 = 7 THEN '' WHEN o_orderkey % 10 = 5 THEN (100 + o_orderkey % 50) || ', ' || (o_orderkey % 9 + 1) || '/2,' ELSE CAST(100 + o_orderkey % 700 AS VARCHAR) END AS line FROM orders),
m AS (SELECT *, last_value(CASE WHEN ends_with(line, ':') THEN line[:-2] WHEN line = '' THEN '' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY k) AS name FROM l),
e AS (SELECT doc, name AS map_name, trim(unnest(string_split(line, ','))) AS text FROM m WHERE line <> '' AND NOT ends_with(line, ':') AND name <> '')
SELECT DISTINCT doc, map_name, text FROM e WHERE text <> ''""",
    "chunk_plan": f"WITH {SEG}, p AS (SELECT map_id, CAST(max(x1) * 7 AS BIGINT) AS wp FROM seg GROUP BY map_id), a AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {w}, {o})" for i, (_, w, o, _, _) in enumerate(PASSES)) + ") v(pass, w, o)), c AS (SELECT map_id, wp, pass, w, unnest(range(0, greatest(wp, 1), w - o)) AS l, w - o AS s FROM p CROSS JOIN a) SELECT map_id, pass, CAST(l // s AS INT) AS chunk, l AS \"left\", least(l + w, wp) AS \"right\" FROM c",
    "content_keys": "SELECT doc_id, substr(sha256(text), 1, 24) AS key FROM documents",
    "cache_misses": "WITH k AS (SELECT doc_id, lang, substr(sha256(text), 1, 24) AS key FROM documents) SELECT doc_id, key FROM k WHERE key IS NULL OR key NOT IN (SELECT key FROM k WHERE lang = 'en' AND key IS NOT NULL)",
    "pixel_coordinates": f"WITH {SEG} SELECT map_id, seg_id, CAST(round_even(x1 * 0.5e0, 0) AS BIGINT) AS px, CAST(round_even(y1 * 2.5e0, 0) AS BIGINT) AS py FROM seg",
    "clipped_segments": f"""WITH {SEG}, c AS (SELECT map_id, seg_id, x1, y1, CAST(x2 - x1 AS DOUBLE) AS dx, CAST(y2 - y1 AS DOUBLE) AS dy FROM seg),
t AS (SELECT map_id, seg_id, greatest(0, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN 100 AND 500 THEN 0 ELSE 2 END ELSE least((100 - x1) / dx, (500 - x1) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN 100 AND 400 THEN 0 ELSE 2 END ELSE least((100 - y1) / dy, (400 - y1) / dy) END) AS t0,
 least(1, CASE WHEN dx = 0 THEN CASE WHEN x1 BETWEEN 100 AND 500 THEN 1 ELSE -1 END ELSE greatest((100 - x1) / dx, (500 - x1) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN y1 BETWEEN 100 AND 400 THEN 1 ELSE -1 END ELSE greatest((100 - y1) / dy, (400 - y1) / dy) END) AS t1 FROM c)
SELECT map_id, seg_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM t WHERE round(t0, 6) < round(t1, 6)""",
    "step_ranges": f"WITH {PROGRESS} SELECT idx, step, round(100 * (sum(weight) OVER (ORDER BY idx) - weight) / sum(weight) OVER (), 6) AS from_pct, round(100 * sum(weight) OVER (ORDER BY idx) / sum(weight) OVER (), 6) AS to_pct FROM st QUALIFY idx IN (SELECT idx FROM pv)",
    "progress_percent": f"""WITH {PROGRESS}, j AS (SELECT job_id, seq, complete, weight, CASE WHEN complete AND row_number() OVER (PARTITION BY job_id, step, complete ORDER BY seq) = 1 THEN weight ELSE 0 END AS fresh FROM pv JOIN st USING (idx)),
d AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY seq) AS done FROM j)
SELECT job_id, seq, CAST(least(round_even(done + CASE WHEN complete THEN 0.0e0 ELSE 0.4e0 * weight END, 0), CASE WHEN complete THEN 100 ELSE 99 END) AS INT) AS percent FROM d""",
    "monotone_step": f"WITH {PROGRESS} SELECT job_id, seq, CAST(max(idx) OVER (PARTITION BY job_id ORDER BY seq) AS INT) AS reached FROM pv",
    "job_ttl_expired": "SELECT user_id AS job_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 30 MINUTE",
    "reading_estimates": "WITH e AS (SELECT o_orderkey, least(1800.0e0, greatest(40.0e0, o_orderkey * 1000.0e0 / 1000 * 0.25e0)) AS s FROM orders) SELECT o_orderkey, round(s, 6) AS seconds, CASE WHEN s < 60 THEN '~' || CAST(round_even(s, 0) AS BIGINT) || ' s' ELSE '~' || CAST(round_even(s / 60, 0) AS BIGINT) || ' min' END AS shown FROM e",
}

ORACLE |= {
    "frame_lines": f"""WITH {SEG}, p AS (SELECT map_id, CAST(min(x1) AS DOUBLE) AS a, CAST(min(y1) AS DOUBLE) AS b, CAST(max(x2) AS DOUBLE) AS c, CAST(max(y2) AS DOUBLE) AS d FROM seg GROUP BY map_id)
SELECT map_id, 'frame' AS layer, a AS x1, b AS y1, c AS x2, b AS y2 FROM p UNION ALL SELECT map_id, 'frame', c, b, c, d FROM p UNION ALL SELECT map_id, 'frame', c, d, a, d FROM p UNION ALL SELECT map_id, 'frame', a, d, a, b FROM p""",
    "endpoint_pairs": f"WITH {SEG} SELECT a.map_id, a.seg_id AS a, b.seg_id AS b, CAST((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 AS DOUBLE) AS d2 FROM green a JOIN green b ON a.map_id = b.map_id AND a.seg_id < b.seg_id AND (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 <= 144",
    "greedy_match": f"""WITH RECURSIVE {SEG}, p AS (SELECT a.map_id, a.seg_id AS a, b.seg_id AS b, CAST((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 AS DOUBLE) AS d2 FROM green a JOIN green b ON a.map_id = b.map_id AND a.seg_id < b.seg_id AND (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 <= 144),
n AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY d2, a, b) AS i FROM p),
w AS (SELECT map_id, i, a, b, d2, true AS ok, [a, b] AS used FROM n WHERE i = 1 UNION ALL SELECT w.map_id, n.i, n.a, n.b, n.d2, NOT list_has_any(w.used, [n.a, n.b]), CASE WHEN list_has_any(w.used, [n.a, n.b]) THEN w.used ELSE list_concat(w.used, [n.a, n.b]) END FROM w JOIN n ON n.map_id = w.map_id AND n.i = w.i + 1)
SELECT map_id, a, b, d2 FROM w WHERE ok""",
    "face_length_near_route": f"""WITH {RECT}, e AS (SELECT map_id, face_id, y0, y1, x1 - x0 AS w FROM rect)
SELECT map_id, face_id, round(CASE WHEN abs(y0 - 202) <= 5 THEN w ELSE 0 END + CASE WHEN abs(y1 - 202) <= 5 THEN w ELSE 0 END + 2 * greatest(0, least(y1, 207) - greatest(y0, 197)), 6) AS near FROM e
WHERE abs(y0 - 202) <= 5 OR abs(y1 - 202) <= 5 OR least(y1, 207) >= greatest(y0, 197)""",
    "face_length_inside": f"""WITH {RECT}, c AS (SELECT map_id, face_id, greatest(0, least(x1 - 0.5, 450) - greatest(x0 + 0.5, -10)) AS l FROM rect WHERE y0 + 0.5 < 215 AND y1 - 0.5 > 215)
SELECT map_id, face_id, round(l, 6) AS inside FROM c WHERE l > 0""",
    "nearest_label": f"""WITH {SEG}, {LBL}, d AS (SELECT l.map_id, l.label_ord, l.x, l.y, r.x1, r.y1, CAST(r.x2 - r.x1 AS DOUBLE) AS dx, CAST(r.y2 - r.y1 AS DOUBLE) AS dy FROM lbl l JOIN route r ON l.map_id = r.map_id),
t AS (SELECT *, greatest(0, least(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM d), q AS (SELECT map_id, label_ord, min(sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)) AS dist FROM t GROUP BY map_id, label_ord)
SELECT map_id, label_ord, round(dist, 6) AS dist FROM q WHERE dist < 200 QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY dist, label_ord) = 1""",
    "route_end_lines": f"""WITH {SEG}, p AS (SELECT map_id, x1 AS x, y1 AS y FROM route UNION ALL SELECT map_id, x2, y2 FROM route), e AS (SELECT map_id, min((x, y)) AS q FROM p GROUP BY map_id UNION ALL SELECT map_id, max((x, y)) FROM p GROUP BY map_id),
m AS (SELECT map_id, CAST(x1 + x2 AS DOUBLE) / 2 AS x, CAST(y1 + y2 AS DOUBLE) / 2 AS y FROM route),
f AS (SELECT e.map_id, CAST(q[1] AS DOUBLE) AS ex, CAST(q[2] AS DOUBLE) AS ey, m.x, m.y FROM e JOIN m ON e.map_id = m.map_id AND (q[1] - m.x) ** 2 + (q[2] - m.y) ** 2 <= 22500),
a AS (SELECT map_id, ex, ey, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS t FROM f GROUP BY ALL HAVING count(*) >= 4)
SELECT map_id, round(ex + 250 * sin(t), 3) AS x1, round(ey - 250 * cos(t), 3) AS y1, round(ex - 250 * sin(t), 3) AS x2, round(ey + 250 * cos(t), 3) AS y2 FROM a""",
}


def _pixels(table: str) -> str:
    """CTE px(map_id, px, py) of the pixels of the segments in ``table``."""
    seg = "face_id" if table == "ring" else "seg_id"
    return f"""st AS (SELECT map_id, {seg} AS seg_id, CAST(x1 AS BIGINT) AS a, CAST(y1 AS BIGINT) AS b, CAST(x2 AS BIGINT) AS c, CAST(y2 AS BIGINT) AS d FROM {table}),
ex AS (SELECT *, greatest(abs(c - a), abs(d - b)) AS n, unnest(range(0, greatest(abs(c - a), abs(d - b)) + 1)) AS k FROM st),
px AS (SELECT map_id, seg_id, a + CAST(CASE WHEN n > 0 THEN round_even((c - a) * k / n, 0) ELSE 0 END AS BIGINT) AS px, b + CAST(CASE WHEN n > 0 THEN round_even((d - b) * k / n, 0) ELSE 0 END AS BIGINT) AS py FROM ex)"""


#: Green pixels on pages of 1 000 by 600, and the runs farther than ten from all of them.
SHEETS = "sheets AS (SELECT DISTINCT map_id FROM seg)"
GREEN_PIXELS = f"{SEG}, {_pixels('green')}, {SHEETS}, bp AS (SELECT DISTINCT map_id, px, py FROM px WHERE px BETWEEN 0 AND 999 AND py BETWEEN 0 AND 599)"
EDGES = "SELECT map_id, py, x AS lo, x AS hi FROM sheets, range(0, 600) r(py), (VALUES (-1), (1000)) e(x)"


def _left_over(intervals: str) -> str:
    """CTEs that end in gap(map_id, py, lo, hi): what the union of the intervals leaves of the pages' lines."""
    return f"""mk AS ({intervals} UNION ALL {EDGES}),
run AS (SELECT *, max(hi) OVER (PARTITION BY map_id, py ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM mk),
gap AS (SELECT map_id, py, reached + 1 AS lo, lo - 1 AS hi FROM run WHERE lo > reached + 1)"""


DISCS = """SELECT map_id, py + dy AS py, px - w AS lo, px + w AS hi
 FROM bp, (SELECT dy, CAST(floor(sqrt(100 - dy * dy)) AS BIGINT) AS w FROM range(-10, 11) t(dy)) WHERE py + dy BETWEEN 0 AND 599"""
FAR = f"far AS (WITH {_left_over(DISCS)} SELECT * FROM gap)"

ORACLE |= {
    "background_fill": f"WITH {GREEN_PIXELS}, {FAR} SELECT * FROM far",
    "filled_background": f"WITH {GREEN_PIXELS}, {FAR}, {_left_over('SELECT map_id, py, px AS lo, px AS hi FROM bp UNION ALL SELECT * FROM far')} SELECT * FROM gap",
    "label_clearance": f"""WITH {GREEN_PIXELS}, {LBL}, dot AS (SELECT map_id, label_ord, CAST(floor(x) AS BIGINT) AS px, CAST(floor(y) AS BIGINT) AS py FROM lbl),
near AS (SELECT d.map_id, d.label_ord, (d.px - b.px) ** 2 + (d.py - b.py) ** 2 AS d2 FROM dot d JOIN (SELECT *, unnest([-1, 0, 1]) AS c FROM bp) b
 ON d.map_id = b.map_id AND d.px // 64 = b.px // 64 + c AND abs(d.px - b.px) <= 12 AND abs(d.py - b.py) <= 12)
SELECT map_id, label_ord, CAST(min(d2) AS BIGINT) AS d2 FROM near WHERE d2 <= 144 GROUP BY map_id, label_ord""",
}

ORACLE |= {
    "boundary_pixels": f"WITH {SEG}, {_pixels('seg')} SELECT map_id, seg_id, px, py FROM px",
    "closed_pixels": f"""WITH {SEG}, {_pixels('route')}, o AS (SELECT dx, dy FROM range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy <= 4),
thick AS (SELECT DISTINCT map_id, px + dx AS px, py + dy AS py FROM px, o) SELECT map_id, px + dx AS px, py + dy AS py FROM thick, o GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM o)""",
    "background_runs": f"""WITH {RECT}, {RING}, {_pixels('ring')}, ln AS (SELECT map_id, unnest(range(0, 500)) AS py FROM (SELECT DISTINCT map_id FROM rect)),
mk AS (SELECT DISTINCT map_id, py, px FROM px WHERE px BETWEEN 0 AND 999 AND py BETWEEN 0 AND 499 UNION ALL SELECT map_id, py, -1 FROM ln UNION ALL SELECT map_id, py, 1000 FROM ln),
nx AS (SELECT *, lead(px) OVER (PARTITION BY map_id, py ORDER BY px) AS nxt FROM mk)
SELECT map_id, py, px + 1 AS lo, nxt - 1 AS hi FROM nx WHERE nxt > px + 1""",
    "region_sizes": f"WITH {RECT} SELECT map_id, CAST((x1 - x0 - 1) * (y1 - y0 - 1) AS BIGINT) AS n FROM rect",
    "annotation_rows": f"""WITH {SEG}, {LOADED}, {RAYS.replace('FROM lbl', 'FROM ok')}, {CROSSED}, c AS (SELECT g.* FROM green g SEMI JOIN crossed c ON g.map_id = c.map_id AND g.seg_id = c.seg_id), h AS (SELECT DISTINCT l.map_id, l.label_ord FROM rays l JOIN c ON l.map_id = c.map_id AND {meet('l', 'c')}),
v AS (SELECT DISTINCT map_id, text FROM ok SEMI JOIN h USING (map_id, label_ord)) SELECT map_id, text, x, y, 'crossed' AS tag, 'red' AS color FROM ok SEMI JOIN v USING (map_id, text)""",
}

# the customers' rectangles with a horizontal route, and labels among them
PLOTS = f"""{RECT}, {RING}, pl AS (SELECT CAST(c_custkey - c_custkey % 50 AS BIGINT) AS map_id, CAST(c_custkey AS BIGINT) AS label_ord, CAST(c_custkey AS VARCHAR) AS text, ((c_custkey * 37) % 101) / 100 AS conf, (c_custkey * 6007) % 1000 + 0.5e0 AS x, (c_custkey * 50021) % 500 + 0.25e0 AS y FROM customer),
hit AS (SELECT * FROM rect WHERE y0 < 215 AND y1 > 215 AND x0 <= 450),
top AS (SELECT p.* FROM pl p JOIN hit r ON p.map_id = r.map_id AND p.x > r.x0 AND p.x < r.x1 AND p.y > r.y0 AND p.y < r.y1 QUALIFY row_number() OVER (PARTITION BY r.map_id, r.face_id ORDER BY conf DESC, length(text) DESC, label_ord) = 1)"""
CUT = """s AS (SELECT map_id, seg_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM seg)"""
FRAME = "((CAST({0} AS DOUBLE) - r.x1) * (r.x2 - r.x1) + ({1} - r.y1) * (r.y2 - r.y1)) / nullif(sqrt(CAST((r.x2 - r.x1) ** 2 + (r.y2 - r.y1) ** 2 AS DOUBLE)), 0)"
ACROSS = "((CAST({1} AS DOUBLE) - r.y1) * (r.x2 - r.x1) - ({0} - r.x1) * (r.y2 - r.y1)) / nullif(sqrt(CAST((r.x2 - r.x1) ** 2 + (r.y2 - r.y1) ** 2 AS DOUBLE)), 0)"

ORACLE |= {
    "noded_edges": f"""WITH {SEG}, {CUT},
p AS (SELECT l.map_id, l.seg_id, l.x1 AS x, l.y1 AS y, l.x2 - l.x1 AS dx, l.y2 - l.y1 AS dy, r.x2 - r.x1 AS ex, r.y2 - r.y1 AS ey, r.x1, r.y1, r.x2, r.y2 FROM s l JOIN s r ON l.map_id = r.map_id AND l.seg_id <> r.seg_id AND {meet('l', 'r')}),
c AS (SELECT map_id, seg_id, unnest(CASE WHEN dx * ey - dy * ex <> 0 THEN [((x1 - x) * ey - (y1 - y) * ex) / (dx * ey - dy * ex)] ELSE [((x1 - x) * dx + (y1 - y) * dy) / nullif(dx * dx + dy * dy, 0), ((x2 - x) * dx + (y2 - y) * dy) / nullif(dx * dx + dy * dy, 0)] END) AS t FROM p),
t AS (SELECT DISTINCT map_id, seg_id, t FROM c WHERE t > 0 AND t < 1 UNION SELECT map_id, seg_id, unnest([0e0, 1e0]) FROM s),
n AS (SELECT map_id, seg_id, t, (CAST(round_even((x1 + t * (x2 - x1)) * 1024, 0) AS BIGINT), CAST(round_even((y1 + t * (y2 - y1)) * 1024, 0) AS BIGINT)) AS n FROM t JOIN s USING (map_id, seg_id)),
e AS (SELECT map_id, n, lead(n) OVER (PARTITION BY map_id, seg_id ORDER BY t) AS m FROM n),
d AS (SELECT DISTINCT map_id, least(n, m) AS u, greatest(n, m) AS v FROM e WHERE m IS NOT NULL AND m <> n)
SELECT map_id, u[1] / 1024 AS x1, u[2] / 1024 AS y1, v[1] / 1024 AS x2, v[2] / 1024 AS y2 FROM d""",
    "junction_extensions": f"WITH {RECT} SELECT map_id, round(x0 + 20, 3) AS x1, round(y1, 3) AS y1, round(x0 + 20, 3) AS x2, round(y1 - 40, 3) AS y2 FROM rect",
    "cycle_verdicts": f"WITH {PLOTS} SELECT map_id, text, 'crossed' AS verdict, 'cycle' AS via, label_ord FROM top",
    "face_verdicts": f"WITH {PLOTS} SELECT map_id, text, 'crossed' AS verdict, 'face' AS via, label_ord FROM top",
    "kept_regions": f"WITH {RECT} SELECT map_id, CAST((x1 - x0 - 1) * (y1 - y0 - 1) AS BIGINT) AS n FROM rect WHERE (x1 - x0 - 1) * (y1 - y0 - 1) BETWEEN 3000 AND 6000",
    "green_in_route_buffer": f"""WITH {SEG}, j AS (SELECT l.map_id, l.seg_id, {meet('l', 'r')} AS met, {FRAME.format('l.x1', 'l.y1')} AS u1, {FRAME.format('l.x2', 'l.y2')} AS u2, {ACROSS.format('l.x1', 'l.y1')} AS v1, {ACROSS.format('l.x2', 'l.y2')} AS v2, sqrt(CAST((r.x2 - r.x1) ** 2 + (r.y2 - r.y1) ** 2 AS DOUBLE)) AS n
  FROM green l JOIN route r ON l.map_id = r.map_id AND abs(l.x1 - r.x1) < 200 AND abs(l.y1 - r.y1) < 200),
k AS (SELECT *, CASE WHEN u1 = u2 THEN CASE WHEN u1 BETWEEN 0 AND n THEN 0 ELSE 2 END ELSE least(-u1 / (u2 - u1), (n - u1) / (u2 - u1)) END AS a0, CASE WHEN u1 = u2 THEN 1 ELSE greatest(-u1 / (u2 - u1), (n - u1) / (u2 - u1)) END AS a1,
 CASE WHEN v1 = v2 THEN CASE WHEN v1 BETWEEN -2.5 AND 2.5 THEN 0 ELSE 2 END ELSE least((-2.5 - v1) / (v2 - v1), (2.5 - v1) / (v2 - v1)) END AS b0, CASE WHEN v1 = v2 THEN 1 ELSE greatest((-2.5 - v1) / (v2 - v1), (2.5 - v1) / (v2 - v1)) END AS b1 FROM j)
SELECT DISTINCT map_id, seg_id FROM k WHERE met OR greatest(0, a0, b0) <= least(1, a1, b1)""",
    "label_filter_plain": f"WITH {LBL} SELECT map_id, label_ord, text, conf FROM lbl WHERE {VALID.format('text')} AND conf >= CASE WHEN source = 'easy_high' THEN 0.25 ELSE 0.4 END AND NOT (regexp_matches(text, '^[0-9]{{2}}$') AND conf < 0.5) AND NOT ends_with(text, '/0')",
    "label_filter_sure": f"WITH {LBL} SELECT map_id, label_ord, trim(text) AS text, conf FROM lbl WHERE {BVALID.format('trim(text)')} AND conf >= 0.75",
    "place_along_route": f"""WITH {SEG}, {LBL}, q AS (SELECT *, sqrt(CAST((x2 - x1) ** 2 + (y2 - y1) ** 2 AS DOUBLE)) AS len FROM route), r AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY map_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q),
d AS (SELECT l.map_id, l.label_ord, l.x, l.y, r.*, coalesce(greatest(0, least(len, {FRAME.format('l.x', 'l.y')})), 0) AS u FROM lbl l JOIN r ON l.map_id = r.map_id),
e AS (SELECT map_id, label_ord, seg_id, start + u AS s, sqrt((x - x1 - coalesce(u / nullif(len, 0), 0) * (x2 - x1)) ** 2 + (y - y1 - coalesce(u / nullif(len, 0), 0) * (y2 - y1)) ** 2) AS dist FROM d),
b AS (SELECT map_id, label_ord, s FROM e WHERE dist <= 200 QUALIFY row_number() OVER (PARTITION BY map_id, label_ord ORDER BY round(dist, 9), seg_id) = 1)
SELECT map_id, label_ord, round(coalesce(s, x), 4) AS s FROM lbl LEFT JOIN b USING (map_id, label_ord)""",
    "face_centroids": f"WITH {RECT} SELECT map_id, face_id, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM rect",
    "parallel_pairs": f"""WITH {SEG}, e AS (SELECT map_id, seg_id, x2 AS x, y2 AS y, (x2 - x1) / sqrt(CAST((x2 - x1) ** 2 + (y2 - y1) ** 2 AS DOUBLE)) AS dx, (y2 - y1) / sqrt(CAST((x2 - x1) ** 2 + (y2 - y1) ** 2 AS DOUBLE)) AS dy FROM green WHERE x1 <> x2 OR y1 <> y2),
p AS (SELECT a.map_id, a.seg_id AS a, b.seg_id AS b, CAST((a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS DOUBLE) AS d2, a.dx AS adx, a.dy AS ady, b.dx AS bdx, b.dy AS bdy, b.x - a.x AS vx, b.y - a.y AS vy FROM e a JOIN e b ON a.map_id = b.map_id AND a.seg_id < b.seg_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 3600)
SELECT map_id, a, b, d2 FROM p WHERE d2 > 0 AND abs(adx * bdx + ady * bdy) >= 0.85 AND abs(adx * vx / sqrt(d2) + ady * vy / sqrt(d2)) <= 0.3 AND abs(bdx * vx / sqrt(d2) + bdy * vy / sqrt(d2)) <= 0.3""",
    "tangent_crosslines": f"""WITH {SEG}, f AS (SELECT p.map_id, p.seg_id AS ord, CAST(p.x1 AS DOUBLE) AS px, CAST(p.y1 AS DOUBLE) AS py, CAST(r.x1 + r.x2 AS DOUBLE) / 2 AS x, CAST(r.y1 + r.y2 AS DOUBLE) / 2 AS y FROM route p JOIN route r ON p.map_id = r.map_id AND (p.x1 - (r.x1 + r.x2) / 2) ** 2 + (p.y1 - (r.y1 + r.y2) / 2) ** 2 <= 22500),
a AS (SELECT map_id, ord, px, py, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS t FROM f GROUP BY ALL HAVING count(*) >= 4)
SELECT map_id, ord, round(px + 25 * sin(t), 3) AS x1, round(py - 25 * cos(t), 3) AS y1 FROM a""",
    "corridor_long_lines": f"WITH {RECT}, {RING} SELECT map_id, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2 FROM ring WHERE abs(x2 - x1) + abs(y2 - y1) >= 60",
    "corridor_shares": f"WITH {RECT}, c AS (SELECT map_id, face_id, (least(x1, 620) - greatest(x0, -5)) * (least(y1, 305) - greatest(y0, 195)) AS shared, least(x1, 620) > x0 AND least(y1, 305) > greatest(y0, 195) AS met FROM rect) SELECT map_id, face_id, round(shared, 3) AS shared FROM c WHERE met",
    "corridor_faces": f"WITH {RECT} SELECT map_id, face_id FROM rect WHERE least(x1, 620) > x0 AND least(y1, 305) > greatest(y0, 195) AND (least(x1, 620) - x0) * (least(y1, 305) - greatest(y0, 195)) >= 0.7 * (x1 - x0) * (y1 - y0) AND (x0 + x1) / 2 < 620 AND (y0 + y1) / 2 > 195 AND (y0 + y1) / 2 < 305",
    "corridor_labels": f"WITH {PLOTS} SELECT map_id, label_ord FROM pl WHERE x > -5 AND x < 620 AND y > 195 AND y < 305 AND map_id IN (SELECT map_id FROM rect)",
    "log_line_steps": "WITH l AS (SELECT o_orderkey, [" + ", ".join("'" + p.strip("^").replace("[0-9]+", "7") + "'" for p, _ in LOG_STEPS) + ", 'other', 'x paths:'][CAST(o_orderkey % 18 AS INT) + 1] || ' ' || o_orderkey AS line FROM orders) SELECT o_orderkey, line, CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{step}'" for p, step in LOG_STEPS) + " END AS step FROM l",
    "cancelled_events": f"""WITH {PROGRESS}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM pv), j AS (SELECT n.job_id, n.seq, coalesce(n.ts > a.ts, false) AS cancelled FROM n LEFT JOIN (SELECT job_id, ts FROM n WHERE n = 5) a ON n.job_id = a.job_id)
SELECT job_id, seq, cancelled FROM j QUALIFY NOT cancelled OR row_number() OVER (PARTITION BY job_id, cancelled ORDER BY seq) = 1""",
    "keepalive_events": f"""WITH {PROGRESS}, g AS (SELECT job_id, seq, CAST(floor(epoch(ts)) AS BIGINT) AS t0, CAST(floor(epoch(lead(ts) OVER (PARTITION BY job_id ORDER BY seq))) AS BIGINT) AS t1 FROM pv),
q AS (SELECT job_id, seq, t0, unnest(range(1, CAST(floor((t1 - t0 - 1) / 86400) AS BIGINT) + 1)) AS k FROM g WHERE t1 IS NOT NULL) SELECT job_id, seq, k, t0 + k * 86400 AS alive_at FROM q""",
    "variant_totals": f"""WITH {TRUTH}, t2 AS (SELECT map_id, text FROM lbl WHERE y < 480), s AS (SELECT count(*) * 0.25e0 AS seconds FROM t2)
SELECT 'A' AS variant, round(seconds, 1) AS seconds, CASE WHEN (SELECT count(*) FROM oc WHERE outcome = 'fn') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s UNION ALL SELECT 'B', round(seconds, 1), 'PASS' FROM s""",
}

SNAPPED = "round_even({} * 1024, 0) / 1024"
ORACLE |= {
    # the route turns left: its right side has the point, its left one the inner corner
    "buffer_frame": f"""WITH {RECT}, bend AS (SELECT face_id AS map_id, x0, y0, x1, y0 AS b0, CASE WHEN face_id % 2 = 1 THEN x1 ELSE x0 END AS cx, y1 AS cy FROM rect),
leg AS (SELECT *, (cy - b0) / sqrt((cx - x1) ** 2 + (cy - b0) ** 2) AS nx, -(cx - x1) / sqrt((cx - x1) ** 2 + (cy - b0) ** 2) AS ny FROM bend),
tip AS (SELECT *, 5 * nx / (1 - ny) AS mx, 5 * (ny - 1) / (1 - ny) AS my FROM leg),
corners AS (SELECT map_id, [[x0, y0 - 5], [x1 + mx, b0 + my], [cx + 5 * nx, cy + 5 * ny], [cx - 5 * nx, cy - 5 * ny], [x1 - mx, b0 - my], [x0, y0 + 5]] AS c FROM tip),
side AS (SELECT map_id, unnest(c) AS p, unnest(list_concat(c[2:], c[:1])) AS q FROM corners)
SELECT map_id, {SNAPPED.format('p[1]')} AS x1, {SNAPPED.format('p[2]')} AS y1, {SNAPPED.format('q[1]')} AS x2, {SNAPPED.format('q[2]')} AS y2 FROM side""",
}

ORACLE |= {
    "map_scales": f"""WITH {SEG}, r AS (SELECT map_id, greatest(max(greatest(x1, x2)) - min(least(x1, x2)), max(greatest(y1, y2)) - min(least(y1, y2))) AS extent FROM route GROUP BY map_id),
pg AS (SELECT map_id, greatest(max(x2) - min(x1), max(y2) - min(y1)) AS page FROM seg GROUP BY map_id)
SELECT map_id, greatest(0.15e0, least(2e0, CAST(coalesce(extent, page) AS DOUBLE) / 500)) AS f FROM pg LEFT JOIN r USING (map_id)""",
    "scaled_end_pairs": f"""WITH {SEG}, e AS (SELECT *, 12 * (1 + (map_id // 500) % 3)::DOUBLE / 2 AS reach FROM green)
SELECT a.map_id, a.seg_id AS a, b.seg_id AS b, CAST((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 AS DOUBLE) AS d2
FROM e a JOIN e b ON a.map_id = b.map_id AND a.seg_id < b.seg_id AND (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 <= a.reach ** 2""",
}

ORACLE |= {
    # every rectangle that the route meets is met inside; maps without a label there take their nearest
    "hybrid_plots": f"""WITH {PLOTS}, held AS (SELECT p.map_id, p.label_ord, r.face_id FROM pl p JOIN rect r ON p.map_id = r.map_id AND p.x > r.x0 AND p.x < r.x1 AND p.y > r.y0 AND p.y < r.y1),
inside AS (SELECT DISTINCT map_id, label_ord FROM held SEMI JOIN hit USING (map_id, face_id)),
d AS (SELECT map_id, label_ord, sqrt((greatest(-10 - x, 0, x - 450)) ** 2 + (y - 215) ** 2) AS dist FROM pl ANTI JOIN inside USING (map_id)),
near AS (SELECT map_id, label_ord FROM d WHERE dist < 200 QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY dist, label_ord) = 1),
v AS (SELECT map_id, label_ord, 'crossed' AS verdict, 'face' AS via FROM inside UNION ALL SELECT map_id, label_ord, 'crossed', 'nearest' FROM near
 UNION ALL SELECT map_id, label_ord, 'borderline', 'no face' FROM pl ANTI JOIN held USING (map_id, label_ord) ANTI JOIN near USING (map_id, label_ord))
SELECT map_id, CAST(label_ord AS VARCHAR) AS text, verdict, via, label_ord FROM v""",
}

ORACLE |= {
    "job_messages": f"""WITH {PROGRESS}, asked AS (SELECT job_id, ts AS asked FROM pv WHERE job_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 5),
j AS (SELECT pv.*, CASE WHEN coalesce(ts > asked, false) THEN 'cancelled' WHEN seq % 50 = 0 THEN 'error' WHEN idx = 8 AND complete THEN 'done' END AS ending FROM pv LEFT JOIN asked USING (job_id)),
live AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM (SELECT *, count(ending) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM j) WHERE ended = 0),
plain AS (SELECT live.job_id, seq, complete, weight, step, CASE WHEN complete AND row_number() OVER (PARTITION BY job_id, step, complete ORDER BY seq) = 1 THEN weight ELSE 0 END AS fresh FROM live JOIN st USING (idx) WHERE coalesce(ending, 'done') = 'done'),
share AS (SELECT *, CAST(least(round_even(sum(fresh) OVER (PARTITION BY job_id ORDER BY seq) + CASE WHEN complete THEN 0.0e0 ELSE 0.4e0 * weight END, 0), CASE WHEN complete THEN 100 ELSE 99 END) AS INT) AS percent FROM plain)
SELECT job_id, seq, 0 AS ord, 'init' AS type, NULL AS step, NULL AS percent FROM live WHERE n = 1 UNION ALL SELECT job_id, seq, 1, 'step', step, NULL FROM share UNION ALL SELECT job_id, seq, 2, 'progress', NULL, percent FROM share
UNION ALL SELECT job_id, seq, 3, ending, NULL, NULL FROM live WHERE ending IS NOT NULL UNION ALL SELECT job_id, seq, 4, 'close', NULL, NULL FROM live WHERE ending IS NOT NULL""",
}

ORACLE |= {
    "inbox_pages": f"SELECT DISTINCT substr(sha256(text), 1, 24) AS key, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE strlen(text) <= {25 << 20}",
}
