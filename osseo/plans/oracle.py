"""DuckDB SQL of the registered queries, written independently of their Spark form."""

from __future__ import annotations

from itertools import combinations

from osseo.plans.queries import RULES

MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

PX = """px AS (SELECT vec_id // 64 AS frame_id, CAST(vec_id % 64 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""
NORM = (
    PX
    + """,
fh AS (SELECT frame_id, max(y) + 1 AS h FROM px GROUP BY 1),
lv AS (SELECT frame_id, CASE WHEN p1 <= p0 THEN v0 ELSE p0 END AS lo, CASE WHEN p1 <= p0 THEN v1 ELSE p1 END AS hi FROM (
  SELECT frame_id, quantile_cont(v, 0.005) AS p0, quantile_cont(v, 0.995) AS p1, min(v) AS v0, max(v) AS v1 FROM px GROUP BY 1)),
nm AS (SELECT px.frame_id, y, x, v, CASE WHEN hi = lo THEN 0.0 ELSE least(greatest((v - lo) / (hi - lo), 0.0), 1.0) END AS z FROM px JOIN lv USING (frame_id))"""
)
MASK = NORM + ",\nmk AS (SELECT nm.*, z > cut AS m FROM nm JOIN (SELECT frame_id, quantile_cont(z, 0.8) AS cut FROM nm GROUP BY 1) USING (frame_id))"
ROWS = (
    MASK
    + """,
rw AS (SELECT frame_id, y, count(*) AS n, min(x) AS x_min, max(x) AS x_max, avg(x) AS cx, sum(z) AS zsum, sum(x * (z + 1e-6)) / sum(z + 1e-6) AS wx FROM mk WHERE m GROUP BY 1, 2)"""
)
SHAPE = """sh AS (SELECT frame_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n, avg(z) AS int_mean, stddev_pop(z) AS int_std, quantile_cont(z, 0.95) AS int_p95 FROM mk WHERE m GROUP BY 1),
sz AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h, avg(z) FILTER (NOT m) AS bg_mean, avg(CASE WHEN z >= top - 1e-6 THEN 1.0 ELSE 0.0 END) AS saturated_frac FROM (SELECT *, max(z) OVER (PARTITION BY frame_id) AS top FROM mk) GROUP BY 1)"""
# the profile over all rows of a frame, and its period
FULL = """fp AS (SELECT frame_id, y, sum(CASE WHEN m THEN z ELSE 0 END) AS zsum FROM mk GROUP BY 1, 2), pf AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i, count(*) OVER (PARTITION BY frame_id) AS n, zsum - avg(zsum) OVER (PARTITION BY frame_id) AS p FROM fp),
lg AS (SELECT DISTINCT frame_id, unnest(generate_series(greatest(3, CAST(floor(0.08 * n) AS INTEGER)), greatest(5, CAST(floor(0.45 * n) AS INTEGER)) - 1)) AS k FROM pf),
ac AS (SELECT lg.frame_id, lg.k, round(sum(a.p * b.p) / (any_value(t.e) + 1e-9), 9) AS r FROM lg JOIN pf a ON a.frame_id = lg.frame_id JOIN pf b ON b.frame_id = lg.frame_id AND b.i = a.i + lg.k JOIN (SELECT frame_id, sum(p * p) AS e FROM pf GROUP BY 1) t ON t.frame_id = lg.frame_id GROUP BY 1, 2),
pd AS (SELECT frame_id, arg_min(k, struct_pack(r := -r, k := k)) AS period, max(r) AS strength FROM ac GROUP BY 1)"""
PERIOD = """pf AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i, count(*) OVER (PARTITION BY frame_id) AS n, zsum - avg(zsum) OVER (PARTITION BY frame_id) AS p FROM rw),
lg AS (SELECT DISTINCT frame_id, unnest(generate_series(greatest(3, CAST(floor(0.08 * n) AS INTEGER)), greatest(5, CAST(floor(0.45 * n) AS INTEGER)) - 1)) AS k FROM pf),
ac AS (SELECT lg.frame_id, lg.k, round(sum(a.p * b.p) / (any_value(t.e) + 1e-9), 9) AS r FROM lg JOIN pf a ON a.frame_id = lg.frame_id JOIN pf b ON b.frame_id = lg.frame_id AND b.i = a.i + lg.k
  JOIN (SELECT frame_id, sum(p * p) AS e FROM pf GROUP BY 1) t ON t.frame_id = lg.frame_id GROUP BY 1, 2),
pd AS (SELECT frame_id, arg_min(k, struct_pack(r := -r, k := k)) AS period, max(r) AS strength FROM ac GROUP BY 1)"""
MEAS = """ms AS (SELECT event_id, user_id AS study, CASE WHEN event_type IN ('view', 'signup') THEN 'spine' WHEN event_type = 'click' THEN 'hip_right' WHEN event_type = 'purchase' THEN 'hip_left' ELSE 'error' END AS region,
  k AS kk, value AS axis_deg, k / 100000 AS kp_art_frac, CASE user_id % 3 WHEN 0 THEN value * 0.75::DOUBLE ELSE -1 END AS vb, CASE user_id % 3 WHEN 1 THEN value * 0.875::DOUBLE ELSE -1 END AS col, CASE WHEN event_id % 5 > 0 THEN k / 100 ELSE 0.25::DOUBLE END AS coverage
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)),
rg AS (SELECT study, region, count(*) AS n_frames, avg(axis_deg) AS axis_deg_mean, max(axis_deg) AS axis_deg_max, avg(kp_art_frac) AS kp_art_frac_mean, avg(vb) AS vb_axis_deg_mean, avg(col) AS col_tilt_deg_mean, avg(coverage) AS coverage_mean
  FROM ms WHERE region <> 'error' GROUP BY 1, 2)"""
VERDICT = (
    MEAS
    + f""",
vd AS (SELECT *, CASE WHEN region <> 'spine' THEN -1.0 WHEN vb_axis_deg_mean >= 0 THEN vb_axis_deg_mean WHEN col_tilt_deg_mean >= 0 THEN col_tilt_deg_mean WHEN axis_deg_max >= 0 THEN axis_deg_max ELSE -1.0 END AS tilt,
  CASE WHEN vb_axis_deg_mean >= 0 THEN {RULES.vb_axis_limit_deg}::DOUBLE ELSE {RULES.max_spine_tilt_deg}::DOUBLE END AS lim FROM rg),
vr AS (SELECT *, region = 'spine' AND tilt > lim AS fires_axis, region = 'spine' AND kp_art_frac_mean > {RULES.artifact_threshold}::DOUBLE AS fires_artifact FROM vd),
pb AS (SELECT *, 1 / (1 + exp(-(8.0::DOUBLE * coverage_mean - 4.5::DOUBLE))) AS p_cov, 1 / (1 + exp(-(0.05::DOUBLE * axis_deg_max + 1000.0::DOUBLE * kp_art_frac_mean - 3.5::DOUBLE))) AS p_sq, 1 / (1 + exp(-(0.02::DOUBLE * axis_deg_mean + 2000.0::DOUBLE * kp_art_frac_mean - 2.0::DOUBLE))) AS p_hq,
  1 / (1 + exp(-(0.05::DOUBLE * abs(axis_deg_mean - 50) - 0.5::DOUBLE))) AS p_pos, 1 / (1 + exp(-(1000.0::DOUBLE * kp_art_frac_mean + 1.0::DOUBLE - 0.25::DOUBLE + 0.5::DOUBLE))) AS p_roi FROM vr),
cd AS (SELECT *, CASE WHEN region = 'spine' THEN list_filter([CASE WHEN fires_axis THEN 'spine_axis' END, CASE WHEN fires_artifact THEN 'spine_artifact' END, CASE WHEN p_cov >= 0.5 THEN 'spine_coverage' END], lambda c: c IS NOT NULL)
  ELSE list_filter([CASE WHEN p_pos >= 0.55::DOUBLE THEN 'hip_positioning' END, CASE WHEN p_roi >= 0.45::DOUBLE THEN 'hip_roi_coverage' END], lambda c: c IS NOT NULL) END AS found FROM pb),
qc AS (SELECT *, CASE WHEN region = 'spine' THEN CAST(len(found) > 0 AS INTEGER) ELSE CAST(p_hq >= 0.5 AS INTEGER) END AS quality_class FROM cd),
cs0 AS (SELECT *, CASE WHEN region = 'spine' THEN found WHEN quality_class = 0 THEN [] WHEN len(found) > 0 THEN found WHEN p_pos / 0.55::DOUBLE >= p_roi / 0.45::DOUBLE THEN ['hip_positioning'] ELSE ['hip_roi_coverage'] END AS codes FROM qc),
vt AS (SELECT *, concat_ws(';', CASE WHEN list_contains(codes, 'spine_axis') THEN 'Не выровнена ось позвоночника' END, CASE WHEN list_contains(codes, 'spine_artifact') THEN 'Присутствуют посторонние предметы' END,
  CASE WHEN list_contains(codes, 'spine_coverage') OR list_contains(codes, 'hip_positioning') THEN 'Некорректная укладка' END, CASE WHEN list_contains(codes, 'hip_roi_coverage') THEN 'Некорректная область интереса' END) AS violation_type,
  CASE WHEN region <> 'spine' THEN '' ELSE concat_ws('; ', CASE WHEN tilt >= 0 THEN format('наклон оси {{:.1f}}°', round_even(tilt, 1)) || CASE WHEN tilt <= {RULES.max_spine_tilt_deg}::DOUBLE THEN ' (в пределах нормы, критерий 5°)' ELSE ' — превышает норму (критерий 5°)' END END,
    CASE WHEN kp_art_frac_mean >= {RULES.artifact_threshold}::DOUBLE THEN 'посторонние тонкие структуры вне позвоночника' END) END AS details FROM cs0),
sc AS (SELECT *, CASE WHEN region = 'spine' THEN 0.7 * (SELECT count(*) FROM range(1, 100) t(i) WHERE i * (2.0::DOUBLE / 99) < greatest(greatest(tilt, 0) / {RULES.max_spine_tilt_deg}::DOUBLE, kp_art_frac_mean / {RULES.artifact_threshold}::DOUBLE, p_cov / {RULES.coverage_threshold}::DOUBLE)) / 99
    + 0.3 * (SELECT count(*) FROM range(1, 100) t(i) WHERE i * (1.0::DOUBLE / 99) < p_sq) / 99
  ELSE (SELECT count(*) FROM range(1, 151) t(i) WHERE i * (1.0::DOUBLE / 150) < p_hq) / 150.0 END AS score FROM vt),
rp AS (SELECT '/data/' || event_id || '.dcm' AS path_to_study, CAST(ms.study AS VARCHAR) AS study_uid, '1.2.' || event_id AS image_uid, CASE WHEN region = 'spine' THEN 'Поясничный отдел позвоночника' WHEN region = 'error' THEN '' ELSE 'Проксимальный отдел бедра' END AS anatomical_region,
  CASE WHEN region <> 'error' THEN sc.quality_class END AS quality_class, CASE WHEN region = 'error' THEN '' ELSE sc.violation_type END AS violation_type, CASE WHEN region = 'error' THEN 'Failure' ELSE 'Success' END AS processing_status,
  round(kk / 1000, 3) AS time_of_processing, CASE WHEN region = 'error' THEN 0.0 ELSE round(sc.score, 5) END AS quality_prob,
  CASE WHEN region <> 'error' THEN sc.details WHEN event_id % 2 = 0 THEN 'ValueError' ELSE 'анатомическая область не определена' END AS details
  FROM ms LEFT JOIN sc USING (study, region))"""
)
BONE = (
    MASK
    + """,
bn AS (SELECT frame_id, y, x, z, coalesce(x >= min(x) FILTER (m) OVER w AND x <= max(x) FILTER (m) OVER w, false) AS m FROM mk WINDOW w AS (PARTITION BY frame_id, y)),
ex AS (SELECT frame_id, count(*) FILTER (m) AS px, min(y) FILTER (m) AS y_lo, max(y) FILTER (m) AS y_hi, greatest(1, max(y) FILTER (m) - min(y) FILTER (m)) AS span, (max(x) + 1) / 2 AS mx, (max(y) + 1) / 2 AS my FROM bn GROUP BY 1),
ml AS (SELECT frame_id, y, (min(x) + max(x)) / 2 AS mid FROM bn WHERE m GROUP BY 1, 2),
ln AS (SELECT frame_id, count(*) AS n, count(*) FILTER (lo) AS nl, regr_slope(mid, y) FILTER (lo) AS k FROM (SELECT ml.*, y >= floor(y_lo + 0.6::DOUBLE * (y_hi - y_lo)) AS lo FROM ml JOIN ex USING (frame_id)) GROUP BY 1),
ft AS (SELECT frame_id, avg(x) AS fx, avg(y) AS fy, count(*) AS fn, median(z) AS fz FROM bn JOIN ex USING (frame_id) WHERE m AND y >= floor(y_lo + 0.8::DOUBLE * span) GROUP BY 1),
sf AS (SELECT ex.*, CASE WHEN n >= 20 AND nl >= 8 THEN degrees(atan(k)) ELSE 0 END AS ang, fx, fy, coalesce(fn, 0) AS fn, fz FROM ex LEFT JOIN ln USING (frame_id) LEFT JOIN ft USING (frame_id)),
tn AS (SELECT frame_id, median(z) AS mid, stddev_pop(z) + 1e-6 AS sd FROM bn WHERE m GROUP BY 1)"""
)
# every target pixel looks up the source pixel that a turn by -deg sends to it
TURNED = """SELECT t.frame_id, t.y, t.x, coalesce(s.m, false) AS m FROM (
  SELECT b.frame_id, y, x, CAST(floor(round(mx + (x - mx) * cos(a) - (y - my) * sin(a), 9) + 0.5) AS INTEGER) AS sx, CAST(floor(round(my + (x - mx) * sin(a) + (y - my) * cos(a), 9) + 0.5) AS INTEGER) AS sy
  FROM {of} b JOIN {by} USING (frame_id)) t LEFT JOIN {of} s ON s.frame_id = t.frame_id AND s.x = sx AND s.y = sy"""
EVAL = """sl AS (SELECT l.doc_id AS id, 1 - quality AS y, round((n_chars % 997) / 997.0::DOUBLE, 6) AS p, source AS grp FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
tl AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM sl GROUP BY 1) WINDOW w AS (ORDER BY p DESC))"""
DRAWS = """,
g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS g FROM (SELECT DISTINCT grp FROM sl)), n AS (SELECT count(*) AS n FROM g),
d AS (SELECT b, CAST(('0x' || substr(md5('7:' || b || ':' || k), 1, 8)) AS BIGINT) % n AS g FROM (SELECT n, unnest(range(n)) AS k FROM n), range(2000) t(b))"""
DUP = "mf AS (SELECT source AS study_dir, doc_id AS rel_path, md5(text) AS pixel_md5, lang AS model FROM documents)"


def _q(prelude: str, select: str, *doubles: str, digits: int = 6) -> str:
    sql = f"WITH {prelude}\n{select}"
    return f"SELECT * REPLACE ({', '.join(f'round({d}, {digits}) AS {d}' for d in doubles)}) FROM (\n{sql})" if doubles else sql


COLUMNS = """cc AS (SELECT frame_id, x, count(*) FILTER (m) AS n, any_value(w) AS w FROM (SELECT *, max(x) OVER (PARTITION BY frame_id) + 1 AS w FROM mk) GROUP BY 1, 2),
sm AS (SELECT a.frame_id, a.x, a.w, sum(b.n * exp(-k * k / 8.0::DOUBLE)) / sum(exp(-k * k / 8.0::DOUBLE)) AS c FROM cc a, range(-5, 6) t(k), cc b WHERE b.frame_id = a.frame_id AND b.x = CASE WHEN a.x + k < 0 THEN -(a.x + k) WHEN a.x + k >= a.w THEN 2 * a.w - 2 - (a.x + k) ELSE a.x + k END GROUP BY 1, 2, 3),
cs AS (SELECT frame_id, 1 - min(c) FILTER (inn) / max(c) FILTER (inn) AS dip, least(sum(c) FILTER (lf), sum(c) FILTER (NOT lf)) / greatest(sum(c) FILTER (lf), sum(c) FILTER (NOT lf)) AS sym
  FROM (SELECT *, x >= floor(0.25::DOUBLE * w) AND x < floor(0.75::DOUBLE * w) AS inn, x < w // 2 AS lf FROM sm) GROUP BY 1)"""
COLUMN = """, wt AS (SELECT *, z - min(z) OVER (PARTITION BY frame_id, y) + 1e-6 AS wg FROM bn WHERE m), r AS (SELECT frame_id, y, sum(x * wg) / sum(wg) AS cx, max(x) - min(x) AS width, count(*) AS n FROM wt GROUP BY 1, 2),
nb AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i, count(*) OVER (PARTITION BY frame_id) AS c FROM r QUALIFY c >= 40), k AS (SELECT *, greatest(3, floor(c * 0.12)) AS k FROM nb),
g AS (SELECT frame_id, abs(degrees(atan((avg(cx) FILTER (i > c - k) - avg(cx) FILTER (i <= k)) / greatest(avg(y) FILTER (i > c - k) - avg(y) FILTER (i <= k), 1e-6)))) AS tilt,
  abs(degrees(atan(regr_slope(cx, y) FILTER (i <= floor(c / 2)))) - degrees(atan(regr_slope(cx, y) FILTER (i > floor(c / 2))))) AS kink, regr_slope(cx, y) AS s, regr_intercept(cx, y) AS ic, median(width) AS width, stddev_pop(width) AS sd, sum(n) AS area, min(y) AS top, max(y) AS bottom FROM k GROUP BY 1),
b AS (SELECT frame_id, sqrt(avg((cx - s * y - ic) ** 2)) AS rms FROM nb JOIN g USING (frame_id) GROUP BY 1)"""
PEAKS = "pk AS (SELECT frame_id, y FROM (SELECT *, lag(zsum) OVER w AS a, lead(zsum) OVER w AS b FROM rw WINDOW w AS (PARTITION BY frame_id ORDER BY y)) WHERE zsum >= a AND zsum > b)"



def _hat(size: int) -> str:
    """ht: the white top-hat of 256 steps with an elliptic element."""
    r = size // 2
    over = "FROM nb JOIN {of} b ON b.frame_id = nb.frame_id AND b.y = oy AND b.x = ox GROUP BY 1, 2, 3"
    return f"""us AS MATERIALIZED (SELECT frame_id, y, x, floor(z * 255) AS v FROM mk),
nb AS MATERIALIZED (SELECT frame_id, y, x, y + dy AS oy, x + dx AS ox FROM us, range({-r}, {r + 1}) s(dy), range({-r}, {r + 1}) t(dx) WHERE abs(dx) <= round_even(sqrt({r * r} - dy * dy), 0)),
er AS MATERIALIZED (SELECT nb.frame_id, nb.y, nb.x, min(b.v) AS v {over.format(of="us")}), di AS MATERIALIZED (SELECT nb.frame_id, nb.y, nb.x, max(b.v) AS v {over.format(of="er")}),
ht AS MATERIALIZED (SELECT mk.*, us.v - di.v AS hat FROM mk JOIN us USING (frame_id, y, x) JOIN di USING (frame_id, y, x))"""


def _parts(of: str, same: str = "") -> str:
    """lb: each pixel of ``of`` and the smallest pixel that steps to eight neighbours reach."""
    return f"""ed AS (SELECT a.frame_id, a.y * 4096 + a.x AS id, b.y * 4096 + b.x AS other FROM {of} a JOIN {of} b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 {same}),
rc AS (SELECT frame_id, id, other FROM ed UNION SELECT rc.frame_id, rc.id, ed.other FROM rc JOIN ed ON ed.frame_id = rc.frame_id AND ed.id = rc.other),
lb AS (SELECT frame_id, id, min(other) AS root FROM rc GROUP BY 1, 2), ar AS (SELECT frame_id, root, count(*) AS area FROM lb GROUP BY 1, 2)"""


def _outlines(of: str) -> str:
    """ol: root, pixels, area and length of the outer outlines of ``of``, holes filled: what the outside reaches in four directions is no part of them."""
    return f"""ou AS (SELECT DISTINCT frame_id, -1 AS y, -1 AS x FROM nm UNION SELECT o.frame_id, o.y + dy, o.x + dx FROM ou o, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx)
  WHERE o.y + dy BETWEEN -1 AND 64 AND o.x + dx BETWEEN -1 AND 64 AND NOT EXISTS (SELECT 1 FROM {of} b WHERE b.frame_id = o.frame_id AND b.y = o.y + dy AND b.x = o.x + dx)),
fl AS MATERIALIZED (SELECT frame_id, y, x FROM nm WHERE NOT EXISTS (SELECT 1 FROM ou WHERE ou.frame_id = nm.frame_id AND ou.y = nm.y AND ou.x = nm.x)),
{_parts("fl")},
ce0 AS (SELECT lb.frame_id, root, id // 4096 + dy AS cy, id % 4096 + dx AS cx, count(*) AS c, sum(CASE WHEN dy = dx THEN 1 ELSE 0 END) AS same FROM lb, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dy, dx) GROUP BY 1, 2, 3, 4),
ol AS (SELECT frame_id, root, any_value(ar.area) AS pixels, sum(CASE c WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5 ELSE 0 END) AS area, sum(CASE WHEN c = 3 THEN sqrt(2) WHEN c = 2 AND same <> 1 THEN 2 * sqrt(2) WHEN c = 2 THEN 1 ELSE 0 END) AS length FROM ce0 JOIN ar USING (frame_id, root) GROUP BY 1, 2)"""


OTSU = """hs AS (SELECT frame_id, CAST(floor(z * 255) AS INTEGER) AS bin, count(*) AS n FROM nm GROUP BY 1, 2),
cu AS (SELECT frame_id, bin, CAST(sum(n) OVER w AS DOUBLE) AS cn, CAST(sum(n * bin) OVER w AS DOUBLE) AS cs FROM hs WINDOW w AS (PARTITION BY frame_id ORDER BY bin)),
wh AS (SELECT frame_id, max(cn) AS tn, max(cs) AS ts, max(bin) AS lb FROM cu GROUP BY 1),
pr AS (SELECT a.frame_id, a.bin AS t1, b.bin AS t2, round(a.cs * a.cs / a.cn + (b.cs - a.cs) * (b.cs - a.cs) / (b.cn - a.cn) + (ts - b.cs) * (ts - b.cs) / (tn - b.cn), 6) AS s
  FROM cu a JOIN cu b ON a.frame_id = b.frame_id AND a.bin < b.bin JOIN wh ON wh.frame_id = a.frame_id WHERE b.bin < lb),
th0 AS (SELECT frame_id, t1, t2 FROM pr QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, t1, t2) = 1)"""


def _round_element(size: int) -> tuple[int, int, str]:
    r = size // 2
    return r, r, f"abs(dx) <= round_even(sqrt({r * r} - dy * dy), 0)"


def _grown(name: str, of: str, ry: int, rx: int, inside: str = "true") -> str:
    """The pixels of ``of`` and all that an element at them covers, within the frame."""
    return f"{name} AS MATERIALIZED (SELECT DISTINCT o.frame_id, CAST(o.y + dy AS INTEGER) AS y, CAST(o.x + dx AS INTEGER) AS x FROM {of} o JOIN fh USING (frame_id), range({-ry}, {ry + 1}) s(dy), range({-rx}, {rx + 1}) t(dx) WHERE {inside} AND o.y + dy BETWEEN 0 AND h - 1 AND o.x + dx BETWEEN 0 AND 63)"


def _shrunk(name: str, of: str, ry: int, rx: int, inside: str = "true") -> str:
    """The pixels whose element, as far as it lies within the frame, holds pixels of ``of`` only."""
    return f"""{name} AS MATERIALIZED (SELECT g.frame_id, g.y, g.x FROM (SELECT frame_id, y, x, CAST(y + dy AS INTEGER) AS oy, CAST(x + dx AS INTEGER) AS ox FROM nm JOIN fh USING (frame_id), range({-ry}, {ry + 1}) s(dy), range({-rx}, {rx + 1}) t(dx) WHERE {inside} AND y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND 63) g
  LEFT JOIN {of} o ON o.frame_id = g.frame_id AND o.y = oy AND o.x = ox GROUP BY 1, 2, 3 HAVING count(o.y) = count(*))"""


# the chain of every tenth row's centre, and pixels in its frame
CHAIN = """cp AS (SELECT frame_id, y AS y0, wx AS x0, lead(y) OVER w AS y1, lead(wx) OVER w AS x1, row_number() OVER w AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM rw WHERE y % 10 = 8 WINDOW w AS (PARTITION BY frame_id ORDER BY y)),
axr AS (SELECT r.frame_id, r.y, x0 + (x1 - x0) * (r.y - y0) / (y1 - y0) AS axis, i - 1 + (r.y - y0) / (y1 - y0) AS along FROM (SELECT DISTINCT frame_id, y FROM nm) r JOIN cp ON cp.frame_id = r.frame_id AND y1 IS NOT NULL AND (r.y >= y0 OR i = 1) AND (r.y < y1 OR i = n - 1)),
ptc AS (SELECT frame_id, median(y1 - y0) AS pitch FROM cp GROUP BY 1),
rfc AS (SELECT cp.frame_id, median(z) AS ref FROM cp, range(-3, 4) s(dy), range(-6, 7) t(dx), nm WHERE nm.frame_id = cp.frame_id AND nm.y = cp.y0 + dy AND nm.x = CAST(round_even(cp.x0, 0) AS INTEGER) + dx GROUP BY 1),
al0 AS MATERIALIZED (SELECT nm.frame_id, nm.y, nm.x, z, nm.x - axis AS across, along, pitch, ref FROM nm JOIN axr USING (frame_id, y) JOIN ptc USING (frame_id) JOIN rfc USING (frame_id))"""


SQL = {
    "frame_offset": _q(MASK, "SELECT frame_id, avg(x) FILTER (m) / max(x) - 0.5 AS cx_rel, abs(avg(x) FILTER (m) / max(x) - 0.5) AS cx_abs FROM mk GROUP BY 1", "cx_rel", "cx_abs"),
    "gaussian_profile": _q(
        ROWS,
        """, nb AS (SELECT frame_id, y, zsum, row_number() OVER w AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM rw WINDOW w AS (PARTITION BY frame_id ORDER BY y))
SELECT a.frame_id, a.y, sum(b.zsum * exp(-k * k / 4.5::DOUBLE)) / sum(exp(-k * k / 4.5::DOUBLE)) AS smooth FROM nb a, range(-4, 5) t(k), nb b
WHERE a.frame_id = b.frame_id AND b.i = CASE WHEN a.i + k < 1 THEN 2 - (a.i + k) WHEN a.i + k > a.n THEN 2 * a.n - (a.i + k) ELSE a.i + k END GROUP BY 1, 2""",
        "smooth",
    ),
    "disc_spacing": _q(
        ROWS + ",\n" + PEAKS,
        """, gp AS (SELECT *, y - lag(y) OVER (PARTITION BY frame_id ORDER BY y) AS g FROM pk), ex AS (SELECT frame_id, min(y) AS y0, max(y) AS y1 FROM rw GROUP BY 1)
SELECT frame_id, count(*) AS disc_n, avg(g) / (any_value(y1) - any_value(y0)) AS disc_step_norm, stddev_pop(g) / avg(g) AS disc_step_cv, (min(y) - any_value(y0)) / avg(g) AS disc_top_gap, (any_value(y1) - max(y)) / avg(g) AS disc_bot_gap
FROM gp JOIN ex USING (frame_id) GROUP BY 1 HAVING count(*) >= 2""",
        "disc_step_norm", "disc_step_cv", "disc_top_gap", "disc_bot_gap",
    ),
    "nearest_peak": _q(ROWS + ",\n" + PEAKS, ", tg AS (SELECT frame_id, max(y) * 0.6::DOUBLE AS t FROM rw GROUP BY 1) SELECT frame_id, y, abs(y - t) AS distance FROM pk JOIN tg USING (frame_id) QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY abs(y - t), y) = 1", "distance"),
    "vertebra_levels": _q(
        MASK,
        """, lm AS (SELECT frame_id, y, x, CAST(1 + y // 16 AS INTEGER) AS level FROM mk WHERE m AND y % 16 < 14), hh AS (SELECT frame_id, max(y) + 1 AS h FROM mk GROUP BY 1),
b0 AS (SELECT frame_id, level, count(*) AS n, min(y) AS top, max(y) AS bottom, avg(x) AS cx, avg(y) AS cy FROM lm GROUP BY 1, 2 HAVING count(*) >= 50),
wr AS (SELECT frame_id, level, median(coalesce(c, 0)) AS width FROM (SELECT frame_id, level, unnest(generate_series(top, bottom)) AS y FROM b0) LEFT JOIN (SELECT frame_id, level, y, count(*) AS c FROM lm GROUP BY 1, 2, 3) USING (frame_id, level, y) GROUP BY 1, 2),
l AS (SELECT *, bottom - top + 1 AS height, (bottom - top + 1) / greatest(width, 1) AS asp, avg(bottom - top + 1) OVER (PARTITION BY frame_id) AS unit, avg(cx) OVER (PARTITION BY frame_id) AS axis, row_number() OVER (PARTITION BY frame_id ORDER BY level) - 1 AS i FROM b0 JOIN wr USING (frame_id, level)),
ln3 AS (SELECT frame_id, regr_slope(cx, cy) AS s, regr_intercept(cx, cy) AS c FROM l GROUP BY 1),
g AS (SELECT frame_id, count(*) AS k, any_value(unit) AS unit, any_value(axis) AS axis, arg_min(top, level) AS top, arg_max(bottom, level) AS bottom, median(asp) AS asp, arg_min(cx, level) AS ax, arg_min(cy, level) AS ay, arg_max(cx, level) AS bx, arg_max(cy, level) AS b_y, regr_slope(asp, i) AS sa, regr_slope(width / greatest(unit, 1), i) AS sw, max(abs(cx - s * cy - c)) AS off FROM l JOIN ln3 USING (frame_id) GROUP BY 1),
as2 AS (SELECT frame_id, count(*) FILTER (x < floor(axis)) AS lf, count(*) FILTER (x >= floor(axis)) AS rt FROM lm JOIN g USING (frame_id) GROUP BY 1)
SELECT frame_id, top / unit AS vl_gap_top_bodies, (h - 1 - bottom) / unit AS vl_gap_bot_bodies, degrees(atan((bx - ax) / greatest(b_y - ay, 1e-6))) AS vl_tilt_ends, off / unit AS vl_tilt_resid, asp AS vl_aspect_med, sa AS vl_aspect_slope, sw AS vl_width_slope, abs(lf - rt) / greatest(lf + rt, 1) AS vl_lr_asym, unit / h AS vl_body_h_px
FROM g JOIN hh USING (frame_id) JOIN as2 USING (frame_id) WHERE k > 2""",
        "vl_gap_top_bodies", "vl_gap_bot_bodies", "vl_tilt_ends", "vl_tilt_resid", "vl_aspect_med", "vl_aspect_slope", "vl_width_slope", "vl_lr_asym", "vl_body_h_px",
    ),
    "spine_levels": _q(
        ROWS + BONE[len(MASK):] + ",\n" + PEAKS,
        """, sz0 AS (SELECT frame_id, max(y) + 1 AS h, max(x) + 1 AS w, min(y) FILTER (m) AS top FROM bn GROUP BY 1), mr AS (SELECT frame_id, y, (min(x) + max(x)) / 2 AS c FROM bn WHERE m GROUP BY 1, 2),
cm AS (SELECT frame_id, floor(median(c)) AS c, any_value(h) AS h, any_value(w) AS w, any_value(top) AS top FROM mr JOIN sz0 USING (frame_id) WHERE y >= floor(0.35::DOUBLE * h) AND y < floor(0.65::DOUBLE * h) GROUP BY 1),
sp0 AS (SELECT frame_id, y, count(*) AS n FROM mk JOIN cm USING (frame_id) WHERE m AND y >= floor(0.5::DOUBLE * h) AND (x < c - greatest(4, floor(0.16::DOUBLE * w)) OR x >= c + greatest(4, floor(0.16::DOUBLE * w))) GROUP BY 1, 2),
cr AS (SELECT frame_id, min(y) AS crest FROM (SELECT *, max(n) OVER (PARTITION BY frame_id) AS most FROM sp0) WHERE most >= 3 AND n >= greatest(2, 0.15::DOUBLE * most) GROUP BY 1),
dk AS (SELECT pk.frame_id, pk.y, crest, row_number() OVER (PARTITION BY pk.frame_id ORDER BY pk.y) - 1 AS i, count(*) OVER (PARTITION BY pk.frame_id) AS n FROM pk JOIN cr USING (frame_id)),
at0 AS (SELECT frame_id, arg_min(i, struct_pack(d := abs(y - crest), i := i)) AS k FROM dk WHERE n >= 2 GROUP BY 1),
kp AS (SELECT dk.*, k FROM dk JOIN at0 USING (frame_id) WHERE i >= k - 4 AND i <= k + 2),
st AS (SELECT frame_id, min(y) AS first, median(g) AS step, count(*) AS kept, max(n) AS n, least(max(k), 4) AS k, max(crest) AS crest FROM (SELECT *, y - lag(y) OVER (PARTITION BY frame_id ORDER BY y) AS g FROM kp) GROUP BY 1)
SELECT frame_id, 0.0::DOUBLE AS no_levels, crest / h AS crest_rel, CAST(n - kept AS DOUBLE) AS levels_dropped, CAST(4 - k AS DOUBLE) AS top_vertebra, CAST(4 - k <= 1 AND (first - top) / greatest(coalesce(step, 1), 1) > 0.7::DOUBLE AS DOUBLE) AS l1_visible, CAST(crest < 0.97::DOUBLE * h AS DOUBLE) AS crest_in_frame, CAST(kept - k - 1 AS DOUBLE) AS levels_below_crest FROM st JOIN cm USING (frame_id)""",
        "crest_rel",
    ),
    "medial_line": _q(
        BONE,
        """, e0 AS (SELECT frame_id, y, max(x) AS x FROM bn WHERE m GROUP BY 1, 2), s0 AS (SELECT frame_id, count(*) AS n, min(y) AS a, max(y) AS b FROM bn WHERE m GROUP BY 1)
SELECT frame_id, regr_slope(x, y) AS k, regr_intercept(x, y) AS c FROM e0 JOIN s0 USING (frame_id) WHERE n > 200 AND y >= floor(a + 0.6::DOUBLE * (b - a)) AND y < b GROUP BY 1 HAVING count(*) > 10""",
        "k", "c",
    ),
    "femur_points": _q(
        BONE,
        """, fg AS MATERIALIZED (SELECT frame_id, y, x FROM bn WHERE m), bg AS MATERIALIZED (SELECT frame_id, y, x FROM bn WHERE NOT m),
dd AS (SELECT fg.frame_id, fg.y, fg.x, abs(fg.y - bg.y) AS a, abs(fg.x - bg.x) AS b FROM fg JOIN bg ON fg.frame_id = bg.frame_id AND abs(fg.y - bg.y) + abs(fg.x - bg.x) < 60),
di AS MATERIALIZED (SELECT frame_id, y, x, round(min(CASE WHEN greatest(a, b) >= 2 * least(a, b) THEN 2.1969::DOUBLE * least(a, b) + greatest(a, b) - 2 * least(a, b) ELSE 2.1969::DOUBLE * (greatest(a, b) - least(a, b)) + 1.4::DOUBLE * (2 * least(a, b) - greatest(a, b)) END), 4) AS d FROM dd GROUP BY 1, 2, 3),
pl AS MATERIALIZED (SELECT di.*, sf.y_lo, sf.span, sf.fx, sf.fy, radians(ang) AS a, round(-((x - fx) * cos(radians(ang)) - (y - fy) * sin(radians(ang))), 9) AS off, 2 * mx AS w, 2 * my AS h FROM di JOIN sf USING (frame_id) WHERE px >= 50 AND fn >= 10),
hd AS (SELECT frame_id, y AS hy, x AS hx, d AS hr, a, fx, fy, w, h FROM pl WHERE off < 0 AND y < y_lo + 0.45::DOUBLE * span QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY d DESC, y, x) = 1),
gt0 AS (SELECT frame_id, max(off) AS gt FROM pl WHERE y < y_lo + 0.55::DOUBLE * span GROUP BY 1), sd0 AS (SELECT frame_id, median(d) AS sd FROM pl WHERE y >= floor(y_lo + 0.8::DOUBLE * span) GROUP BY 1),
wk AS (SELECT hd.*, k, hx + (fx - hx) * (k / 119::DOUBLE) AS px, hy + (fy - hy) * (k / 119::DOUBLE) AS py FROM hd, range(120) t(k) WHERE k / 119::DOUBLE > 0.15::DOUBLE AND k / 119::DOUBLE < 0.75::DOUBLE),
nk AS (SELECT wk.frame_id, px, py, coalesce(d, 0) AS nr FROM wk LEFT JOIN di ON di.frame_id = wk.frame_id AND di.y = CAST(floor(py) AS INTEGER) AND di.x = CAST(floor(px) AS INTEGER) QUALIFY row_number() OVER (PARTITION BY wk.frame_id ORDER BY coalesce(d, 0), k) = 1),
fin AS (SELECT *, sqrt((hx - px) ** 2 + (hy - py) ** 2) AS nl FROM hd JOIN nk USING (frame_id) JOIN gt0 USING (frame_id) JOIN sd0 USING (frame_id))
SELECT frame_id, 0.0::DOUBLE AS empty_lm, hr AS prox_r_px, nl / (2 * hr) AS prox_dist_ratio, nr / hr AS isthmus_ratio, degrees(acos(least(greatest(((hx - px) * sin(a) + (hy - py) * cos(a)) / (nl + 1e-6), -1), 1))) AS prox_axis_deg, gt / (2 * hr) AS gt_offset_ratio, 2 * hr / (2 * sd + 1e-6) AS prox_shaft_ratio FROM fin""",
        "prox_r_px", "prox_dist_ratio", "isthmus_ratio", "prox_axis_deg", "gt_offset_ratio", "prox_shaft_ratio",
    ),
    "contours": _q(
        "RECURSIVE " + MASK + ",\nmp AS MATERIALIZED (SELECT frame_id, y, x FROM mk WHERE m),\n" + _outlines("mp"),
        "SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY root) AS INTEGER) AS contour, pixels, area, length FROM ol", "length",
    ),
    "femur_shape": _q(
        BONE + ",\nup AS (SELECT frame_id, mx, my, radians(-ang) AS a FROM sf),\ntr AS (" + TURNED.format(of="bn", by="up") + ")",
        """, r AS (SELECT frame_id, y, min(x) AS a, max(x) AS b FROM tr WHERE m GROUP BY 1, 2), e AS (SELECT frame_id, min(y) AS y0, max(y) - min(y) + 1 AS s, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT r.*, n, b - a AS w, (y - y0) / s > 0.7::DOUBLE AS lo, (y - y0) / s > 0.3::DOUBLE AND (y - y0) / s < 0.7::DOUBLE AS pr FROM r JOIN e USING (frame_id)),
l AS (SELECT frame_id, median(w) FILTER (lo) AS sw, regr_slope(b, y) FILTER (lo) AS k, regr_intercept(b, y) FILTER (lo) AS c, max(w) FILTER (pr) AS mw, stddev_pop(w) AS sd FROM p GROUP BY 1 HAVING any_value(n) >= 20 AND count(*) FILTER (lo) >= 5 AND count(*) FILTER (pr) >= 5),
o AS (SELECT frame_id, max(b - k * y - c) AS mx, avg(greatest(b - k * y - c, 0)) AS mn FROM p JOIN l USING (frame_id) WHERE pr GROUP BY 1)
SELECT sf.frame_id, CAST(sw IS NULL AS DOUBLE) AS empty_femur, CASE WHEN sw IS NOT NULL THEN abs(ang) END AS shaft_angle_deg, sw AS shaft_width_px, o.mx AS lt_protrusion_px, CASE WHEN sw > 0 THEN o.mx / sw WHEN sw IS NOT NULL THEN 0 END AS lt_index, mn AS lt_protrusion_mean,
 CASE WHEN sw > 0 THEN mw / sw WHEN sw IS NOT NULL THEN 0 END AS prox_width_ratio, sd / (sw + 1e-6) AS width_profile_std FROM sf LEFT JOIN (l JOIN o USING (frame_id)) USING (frame_id)""",
        "shaft_angle_deg", "lt_protrusion_px", "lt_index", "lt_protrusion_mean", "prox_width_ratio", "width_profile_std",
    ),
    "shaft_axis": _q(BONE, "SELECT frame_id, px AS pixels, ang AS angle_deg, fx AS foot_x, fy AS foot_y FROM sf", "angle_deg", "foot_x", "foot_y"),
    "first_exceedance": _q(ROWS, "SELECT frame_id, min(y) AS y FROM (SELECT *, max(n) OVER (PARTITION BY frame_id) AS top FROM rw) WHERE top >= 3 AND n >= greatest(2, 0.7::DOUBLE * top) GROUP BY 1"),
    "period_phase": _q(
        ROWS + ",\n" + PERIOD,
        ", c AS (SELECT frame_id, sum(zsum * cos(2 * pi() * y / period)) AS re, sum(-zsum * sin(2 * pi() * y / period)) AS im FROM rw JOIN pd USING (frame_id) GROUP BY 1) SELECT frame_id, atan2(im, re) AS phase, sqrt(re * re + im * im) AS amplitude FROM c",
        "phase", "amplitude",
    ),
    "region_guess": _q(
        ROWS + ",\n" + SHAPE + ",\n" + PERIOD + ",\n" + COLUMNS,
        """, q AS (SELECT frame_id, 0.6::DOUBLE * least(strength / 0.35::DOUBLE, 1) + 0.4::DOUBLE * least((y1 - y0 + 1) / (x1 - x0 + 1) / 1.6::DOUBLE, 1) AS s, (x1 - x0 + 1) / w > 0.78::DOUBLE AND dip > 0.3::DOUBLE AND sym > 0.55::DOUBLE AS two, dip
  FROM sh JOIN sz USING (frame_id) JOIN pd USING (frame_id) JOIN cs USING (frame_id))
SELECT frame_id, CASE WHEN s > 0.62::DOUBLE THEN 'spine' WHEN two THEN 'hip_both' ELSE 'hip_single' END AS guess, round_even(CASE WHEN s > 0.62::DOUBLE THEN least(s, 1) WHEN two THEN least(dip + 0.2::DOUBLE, 1) ELSE greatest(0.3::DOUBLE, 1 - s) END, 2) AS confidence FROM q""",
    ),
    "outline_features": _q(
        MASK + ",\n" + SHAPE + ",\n" + FULL + ",\n" + COLUMNS + ",\ntp AS (SELECT frame_id, avg(CASE WHEN y < (h // 3) THEN 1.0 ELSE 0.0 END) AS top_heavy FROM mk JOIN sz USING (frame_id) WHERE m GROUP BY 1)",
        """SELECT frame_id, top_heavy, n / (w * h) AS area_frac, (y1 - y0 + 1) / (x1 - x0 + 1) AS bbox_aspect, (x1 - x0 + 1) / w AS col_span, dip AS profile_dip, sym AS lr_symmetry, strength AS period_strength, period / h AS period_lag, 0.0::DOUBLE AS sam_area_frac, 0.0::DOUBLE AS sam_full_frame
FROM tp JOIN sh USING (frame_id) JOIN sz USING (frame_id) JOIN cs USING (frame_id) JOIN pd USING (frame_id)""",
        "top_heavy", "area_frac", "bbox_aspect", "col_span", "profile_dip", "lr_symmetry", "period_strength", "period_lag",
    ),
    "region_features": _q(
        MASK + ",\n" + SHAPE + ",\n" + FULL + ",\ntp AS (SELECT frame_id, avg(CASE WHEN y < (h // 3) THEN 1.0 ELSE 0.0 END) AS top_heavy, avg(CASE WHEN y >= (2 * h // 3) THEN 1.0 ELSE 0.0 END) AS bot_heavy FROM mk JOIN sz USING (frame_id) WHERE m GROUP BY 1)"
        ",\nrv AS (SELECT frame_id, stddev_pop(n) / (avg(n) + 1e-9) AS row_var FROM (SELECT frame_id, y, count(*) FILTER (m) AS n FROM mk GROUP BY 1, 2) GROUP BY 1)",
        """SELECT frame_id, (y1 - y0 + 1) / (x1 - x0 + 1) AS aspect, (x1 - x0 + 1) / w AS span, n / ((x1 - x0 + 1) * (y1 - y0 + 1)) AS fill, n / (w * h) AS area, strength AS period, top_heavy, bot_heavy, row_var
FROM tp JOIN sh USING (frame_id) JOIN sz USING (frame_id) JOIN pd USING (frame_id) JOIN rv USING (frame_id)""",
        "aspect", "span", "fill", "area", "period", "top_heavy", "bot_heavy", "row_var",
    ),
    "vertebra_count": _q(
        MASK + ",\n" + SHAPE + ",\n" + FULL,
        "SELECT frame_id, (y1 - y0 + 1) / period AS n_vertebrae, CAST(period AS DOUBLE) AS period_px, strength AS period_strength, period * 1.05::DOUBLE AS vertebra_mm FROM sh JOIN pd USING (frame_id)",
        "n_vertebrae", "period_strength", "vertebra_mm",
    ),
    "artifact_inside": _q(
        "RECURSIVE " + MASK + ",\n" + _hat(11) + ",\nst AS (SELECT frame_id, count(*) AS n, greatest(12, floor(quantile_cont(hat, 0.99))) AS cut, avg(CASE WHEN z >= 0.995::DOUBLE THEN 1.0 ELSE 0.0 END) AS sat, quantile_cont(z, 0.99) - median(z) AS con FROM ht WHERE m GROUP BY 1),"
        "\nhp AS MATERIALIZED (SELECT frame_id, y, x FROM ht JOIN st USING (frame_id) WHERE m AND hat >= cut),\n" + _parts("hp"),
        """, big AS (SELECT frame_id, count(*) AS c, max(area) AS a FROM ar WHERE area >= 4 GROUP BY 1), al AS (SELECT frame_id, sum(area) AS hot FROM ar GROUP BY 1)
SELECT frame_id, 0.0::DOUBLE AS in_empty, coalesce(hot, 0) / n AS in_hot_frac, coalesce(a, 0) / n AS in_hot_max_frac, CAST(coalesce(c, 0) AS DOUBLE) AS in_hot_n, sat AS in_sat_frac, con AS in_contrast FROM st LEFT JOIN al USING (frame_id) LEFT JOIN big USING (frame_id)""",
        "in_hot_frac", "in_hot_max_frac", "in_sat_frac", "in_contrast",
    ),
    "thin_bright": _q(
        "RECURSIVE " + MASK + ",\n" + _hat(15) + """,
mb AS MATERIALIZED (SELECT DISTINCT frame_id, y + dy AS y, x + dx AS x FROM mk, range(-3, 4) s(dy), range(-3, 4) t(dx) WHERE m),
ot AS MATERIALIZED (SELECT ht.frame_id, ht.y, ht.x, CASE WHEN mb.y IS NULL THEN hat ELSE 0 END AS hat FROM ht LEFT JOIN mb ON mb.frame_id = ht.frame_id AND mb.y = ht.y AND mb.x = ht.x),
hp AS MATERIALIZED (SELECT frame_id, y, x FROM ot WHERE hat >= 25),
""" + _outlines("hp"),
        """, pt AS (SELECT frame_id, count(*) FILTER (e > 6) AS n, max(e) FILTER (e > 6) AS e, sum(area) AS area FROM (SELECT *, length * length / (4 * pi() * area + 1e-9) AS e FROM ol WHERE area >= 8) GROUP BY 1),
al AS (SELECT frame_id, count(*) AS px, avg(hat) / 255 AS b, avg(hat) FILTER (up) / 255 AS u, avg(CASE WHEN hat >= 25 THEN 1.0 ELSE 0.0 END) FILTER (up) AS t FROM (SELECT *, y < floor(0.45::DOUBLE * (max(y) OVER (PARTITION BY frame_id) + 1)) AS up FROM ot) GROUP BY 1)
SELECT frame_id, CAST(coalesce(n, 0) AS DOUBLE) AS thin_n, CAST(coalesce(e, 0) AS DOUBLE) AS thin_elong, coalesce(area, 0) / px AS thin_area_frac, b AS outside_bright, u AS outside_bright_upper, t AS thin_upper_frac FROM al LEFT JOIN pt USING (frame_id)""",
        "thin_elong", "thin_area_frac", "outside_bright", "outside_bright_upper", "thin_upper_frac",
    ),
    "main_body": _q(
        "RECURSIVE " + MASK + ",\nmp AS (SELECT frame_id, y, x FROM mk WHERE m),\n" + _parts("mp") + """,
mn AS (SELECT frame_id, root AS main, area AS most FROM ar QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, root) = 1), lp AS (SELECT lb.*, id // 4096 AS y, id % 4096 AS x FROM lb),
nr AS (SELECT DISTINCT frame_id, y + dy AS y, x + dx AS x FROM lp JOIN mn USING (frame_id), range(-7, 8) s(dy), range(-7, 8) t(dx) WHERE root = main AND dy > -7 AND dx > -7 AND abs(dx) <= round_even(sqrt(49 - dy * dy), 0)),
kp AS (SELECT DISTINCT frame_id, root FROM lp JOIN nr USING (frame_id, y, x) JOIN ar USING (frame_id, root) JOIN mn USING (frame_id) WHERE area >= 0.08::DOUBLE * most)""",
        "SELECT frame_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM lp JOIN kp USING (frame_id, root) GROUP BY 1", "cx", "cy",
    ),
    "level_cores": _q(
        "RECURSIVE " + MASK + ",\nmp AS (SELECT frame_id, y, x FROM mk WHERE m),\n" + _parts("mp", "AND a.y // 16 = b.y // 16"),
        """, lv2 AS (SELECT lb.frame_id, lb.id % 4096 AS x, CAST(1 + lb.id // 4096 // 16 AS INTEGER) AS level, area FROM lb JOIN ar USING (frame_id, root))
SELECT frame_id, level, count(*) AS n, avg(x) AS cx FROM (SELECT *, max(area) OVER (PARTITION BY frame_id, level) AS most FROM lv2) WHERE area >= 0.25::DOUBLE * most GROUP BY 1, 2""",
        "cx",
    ),
    "masked_pool": """WITH e AS (SELECT vec_id // 64 AS frame_id, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) > 0 AS m FROM embeddings),
c AS (SELECT frame_id, m, CAST(unnest(generate_series(1, len(embedding))) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM e),
a AS (SELECT frame_id, dim, CASE WHEN count(*) FILTER (m) >= 4 THEN avg(x) FILTER (m) ELSE avg(x) END AS v FROM c GROUP BY 1, 2)
SELECT frame_id, dim, round(v / (sqrt(sum(v * v) OVER (PARTITION BY frame_id)) + 1e-6::DOUBLE), 6) AS value FROM a""",
    "agreed_checks": _q(
        VERDICT,
        f""", ck AS (SELECT study, region, violation_type, 'ось позвоночника' AS task, 'rule' AS kind, tilt > {RULES.vb_axis_limit_deg}::DOUBLE AS f, NULL AS t FROM sc WHERE region = 'spine'
UNION ALL SELECT study, region, violation_type, 'посторонние предметы', 'rule', kp_art_frac_mean > {RULES.artifact_threshold}::DOUBLE, NULL FROM sc WHERE region = 'spine' UNION ALL SELECT study, region, violation_type, 'укладка позвоночника', 'head', p_cov >= 0.5, 'Некорректная укладка' FROM sc WHERE region = 'spine'
UNION ALL SELECT study, region, violation_type, 'укладка бедра', 'head', p_pos >= 0.55::DOUBLE, 'Некорректная укладка' FROM sc WHERE region <> 'spine' UNION ALL SELECT study, region, violation_type, 'область интереса бедра', 'head', p_roi >= 0.45::DOUBLE, 'Некорректная область интереса' FROM sc WHERE region <> 'spine'),
tl2 AS (SELECT *, t IS NOT NULL AND list_contains(string_split(violation_type, ';'), t) AS told FROM ck)
SELECT study, region, task, kind, CASE WHEN t IS NULL THEN f ELSE told END AS fired, CASE WHEN told AND NOT f THEN 'тип выбран по общей модели годности бедра: ближе всех к своему порогу'
  WHEN t IS NOT NULL AND f AND NOT told THEN 'выше порога, но общая модель годности бедра считает снимок годным' END AS note FROM tl2""",
    ),
    "column_shape": _q(MASK + ",\n" + COLUMNS, "SELECT frame_id, dip AS profile_dip, sym AS lr_symmetry FROM cs", "profile_dip", "lr_symmetry"),
    "rotated_box": _q(
        MASK + ",\nup AS (SELECT frame_id, (max(x) + 1) / 2 AS mx, (max(y) + 1) / 2 AS my, radians(10.0::DOUBLE) AS a FROM mk GROUP BY 1),\ntr AS (" + TURNED.format(of="mk", by="up") + ")",
        "SELECT frame_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM tr WHERE m GROUP BY 1", "cx", "cy",
    ),
    "distance_widest": _q(
        MASK,
        """, e AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM mk GROUP BY 1), d AS (SELECT a.frame_id, a.y, a.x, least(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2), any_value(least(a.x + 1, w - a.x, a.y + 1, h - a.y)) ** 2) AS d2
  FROM mk a JOIN e USING (frame_id) JOIN mk b ON b.frame_id = a.frame_id AND a.m AND NOT b.m GROUP BY 1, 2, 3)
SELECT frame_id, sqrt(d2) AS radius, y, x FROM d QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY d2 DESC, y, x) = 1""",
        "radius",
    ),
    "area_resize": _q(PX, "SELECT frame_id, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, avg(v) AS v FROM px GROUP BY 1, 2, 3", "v"),
    "legacy_score": _q(
        VERDICT,
        f"""SELECT study, region, CASE WHEN region = 'spine' THEN 0.7 * greatest(p_cov, least(greatest(tilt / {2 * RULES.max_spine_tilt_deg}, 0), 1), least(greatest(kp_art_frac_mean / {2 * RULES.artifact_threshold}, 0), 1)) + 0.3 * p_sq ELSE p_hq END AS score FROM sc""",
        "score",
    ),
    "landmark_rules": _q(
        """t AS (SELECT vec_id, [list_sum(list_transform(list_filter(list_zip(embedding, range(64)), lambda p: p[2] % 15 = k), lambda p: abs(CAST(p[1] AS DOUBLE)) * 60)) for k in range(15)] AS t FROM embeddings),
p AS (SELECT vec_id, vec_id % 7 > 0 AS ok, CASE WHEN t[3] / 80 >= 0.2 THEN t[1] END AS gx, CASE WHEN t[3] / 80 >= 0.2 THEN t[2] END AS gy, CASE WHEN t[6] / 80 >= 0.2 THEN t[5] END AS iy, CASE WHEN t[9] / 80 >= 0.2 THEN t[7] END AS lx, CASE WHEN t[9] / 80 >= 0.2 THEN t[8] END AS ly,
  CASE WHEN t[12] / 80 >= 0.2 THEN t[10] END AS ux, CASE WHEN t[12] / 80 >= 0.2 THEN t[11] END AS uy, CASE WHEN t[15] / 80 >= 0.2 THEN t[13] END AS dx, CASE WHEN t[15] / 80 >= 0.2 THEN t[14] END AS dy FROM t)""",
        """, m AS (SELECT vec_id, ok, gy * 0.73::DOUBLE AS ab, (63 - iy) * 0.73::DOUBLE AS be, lx, (lx - (0.25 * ly + 10)) * 0.6::DOUBLE AS lo, sqrt(((ux - dx) * 0.6::DOUBLE) ** 2 + ((uy - dy) * 0.73::DOUBLE) ** 2) AS nw, abs(degrees(atan2((ux - dx) * 0.6::DOUBLE, (uy - dy) * 0.73::DOUBLE + 1e-6))) AS na,
  sqrt((((ux + dx) / 2 - gx) * 0.6::DOUBLE) ** 2 + (((uy + dy) / 2 - gy) * 0.73::DOUBLE) ** 2) AS nl, sqrt(((ux - gx) * 0.6::DOUBLE) ** 2 + ((uy - gy) * 0.73::DOUBLE) ** 2) AS ng, sqrt(((gx - lx) * 0.6::DOUBLE) ** 2 + ((gy - ly) * 0.73::DOUBLE) ** 2) AS gl FROM p)
SELECT vec_id, CAST(NOT ok AS DOUBLE) AS lmk_empty, CASE WHEN ok THEN ab END AS lmk_above_gt_mm, CASE WHEN ok THEN CAST(ab >= 30 AS DOUBLE) END AS lmk_above_gt_ok, CASE WHEN ok THEN be END AS lmk_below_isch_mm, CASE WHEN ok THEN CAST(be >= 30 AS DOUBLE) END AS lmk_below_isch_ok,
 CASE WHEN ok THEN CAST(lx IS NULL AS DOUBLE) END AS lmk_lt_absent, CASE WHEN ok AND vec_id % 2 = 0 THEN lo END AS lmk_lt_out_mm, CASE WHEN ok THEN nw END AS lmk_neck_w_mm, CASE WHEN ok THEN na END AS lmk_neck_ang, CASE WHEN ok THEN nl END AS lmk_neck_len_mm, CASE WHEN ok AND nw > 1 THEN nl / nw END AS lmk_neck_ratio,
 CASE WHEN ok THEN ng END AS lmk_neck_to_gt_mm, CASE WHEN ok THEN gl END AS lmk_gt_lt_mm FROM m""",
        "lmk_above_gt_mm", "lmk_below_isch_mm", "lmk_lt_out_mm", "lmk_neck_w_mm", "lmk_neck_ang", "lmk_neck_len_mm", "lmk_neck_ratio", "lmk_neck_to_gt_mm", "lmk_gt_lt_mm",
    ),
    "head_contributions": _q(
        "e AS (SELECT vec_id, i, (i * 7 % 16 - 7.5::DOUBLE) / 4 * (CAST(embedding[i + 1] AS DOUBLE) - 0.01::DOUBLE * (i % 8)) AS impact FROM embeddings, range(64) t(i))",
        "SELECT vec_id, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, impact FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(impact) DESC, i) <= 3",
        "impact",
    ),
    "pixel_normalize": _q(
        NORM,
        """, ends AS (SELECT frame_id, min(v) a, max(v) b FROM px GROUP BY 1),
hb AS (SELECT frame_id, least(CAST(floor((v - a) / (b - a) * 64) AS BIGINT), 63) AS bin, count(*) AS n FROM px JOIN ends USING (frame_id) GROUP BY 1, 2),
hm AS (SELECT frame_id, arg_min(bin, struct_pack(n := -n, bin := bin)) AS mode_bin FROM hb GROUP BY 1)
SELECT frame_id, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mode_bin) AS mode_bin, any_value(mode_bin) > 32 AS inverted, avg(z) AS z_mean, stddev_pop(z) AS z_std, count(*) FILTER (z >= 1) AS n_high
FROM nm JOIN lv USING (frame_id) JOIN hm USING (frame_id) GROUP BY 1""",
        "lo", "hi", "z_mean", "z_std",
    ),
    "fix_polarity": _q(
        PX,
        """, e0 AS (SELECT frame_id, max(v) AS top FROM px GROUP BY 1), p1 AS (SELECT px.frame_id, y, x, top - v AS v FROM px JOIN e0 USING (frame_id)),
e1 AS (SELECT frame_id, min(v) AS a, max(v) AS b FROM p1 GROUP BY 1),
hb AS (SELECT frame_id, least(CAST(floor((v - a) / (b - a) * 64) AS BIGINT), 63) AS bin, count(*) AS n FROM p1 JOIN e1 USING (frame_id) GROUP BY 1, 2),
hm AS (SELECT frame_id, arg_min(bin, struct_pack(n := -n, bin := bin)) > 32 AS inverted FROM hb GROUP BY 1)
SELECT frame_id, avg(CASE WHEN inverted THEN b - v ELSE v END) AS v_mean, bool_or(inverted) AS inverted FROM p1 JOIN e1 USING (frame_id) JOIN hm USING (frame_id) GROUP BY 1""",
        "v_mean",
    ),
    "otsu_threshold": _q(NORM + ",\n" + OTSU, "SELECT * FROM th0"),
    "soft_bone": _q(
        NORM + ",\n" + OTSU + ",\nb0 AS MATERIALIZED (SELECT frame_id, y, x FROM nm JOIN th0 USING (frame_id) WHERE floor(z * 255) > t1),\n" + _shrunk("b1", "b0", *_round_element(5)) + ",\n" + _grown("b2", "b1", *_round_element(5)),
        "SELECT f.frame_id, count(b2.y) AS n, avg(z) FILTER (b2.y IS NOT NULL) AS z_mean, avg(b2.x) AS cx FROM nm f LEFT JOIN b2 USING (frame_id, y, x) GROUP BY 1",
        "z_mean", "cx",
    ),
    "bone_mask": _q(
        "RECURSIVE " + NORM + ",\n" + OTSU + ",\nb0 AS MATERIALIZED (SELECT frame_id, y, x FROM nm JOIN th0 USING (frame_id) WHERE floor(z * 255) > t2),\n"
        + ",\n".join([_grown("b1", "b0", 1, 10), _shrunk("b2", "b1", 1, 10), _grown("b3", "b2", *_round_element(9)), _shrunk("b4", "b3", *_round_element(9))])
        + """,
ou AS (SELECT DISTINCT frame_id, -1 AS y, -1 AS x FROM nm UNION SELECT o.frame_id, o.y + dy, o.x + dx FROM ou o, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx)
  WHERE o.y + dy BETWEEN -1 AND 64 AND o.x + dx BETWEEN -1 AND 64 AND NOT EXISTS (SELECT 1 FROM b4 WHERE b4.frame_id = o.frame_id AND b4.y = o.y + dy AND b4.x = o.x + dx)),
b5 AS MATERIALIZED (SELECT frame_id, y, x FROM nm WHERE NOT EXISTS (SELECT 1 FROM ou WHERE ou.frame_id = nm.frame_id AND ou.y = nm.y AND ou.x = nm.x)),
"""
        + ",\n".join([_shrunk("b6", "b5", *_round_element(3)), _grown("b7", "b6", *_round_element(3))]),
        "SELECT f.frame_id, count(b7.y) AS n, avg(z) FILTER (b7.y IS NOT NULL) AS z_mean FROM nm f LEFT JOIN b7 USING (frame_id, y, x) GROUP BY 1",
        "z_mean",
    ),
    "spinous_ridge": _q(
        BONE,
        """, gy AS (SELECT k, exp(-0.5::DOUBLE * (k / 15.0::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (k / 15.0::DOUBLE) ** 2)) OVER () AS g FROM range(-60, 61) t(k)), gx AS (SELECT k, exp(-0.5::DOUBLE * (k / 1.5::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (k / 1.5::DOUBLE) ** 2)) OVER () AS g FROM range(-6, 7) t(k)),
my AS (SELECT h, y, abs((y + k + (h - 1) + 10 * (h - 1)) % (2 * (h - 1)) - (h - 1)) AS s, sum(g) AS g FROM (SELECT DISTINCT h FROM fh) JOIN gy ON true JOIN (SELECT unnest(range(64)) AS y) ON y < h GROUP BY 1, 2, 3),
v1 AS MATERIALIZED (SELECT nm.frame_id, my.y, nm.x, sum(g * z) AS z FROM nm JOIN fh USING (frame_id) JOIN my ON my.h = fh.h AND my.s = nm.y GROUP BY 1, 2, 3),
v2 AS MATERIALIZED (SELECT a.frame_id, a.y, a.x, sum(g * b.z) AS z FROM v1 a, gx, v1 b WHERE b.frame_id = a.frame_id AND b.y = a.y AND b.x = abs((a.x + k + 63 + 126) % 126 - 63) GROUP BY 1, 2, 3),
cr0 AS (SELECT frame_id, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM bn WHERE m GROUP BY 1, 2), cs1 AS (SELECT frame_id, min(y) AS y0, max(y) AS y1, count(*) AS rows FROM cr0 GROUP BY 1),
mp0 AS (SELECT frame_id, count(*) FILTER (m) AS px FROM mk GROUP BY 1),
ok0 AS (SELECT cr0.*, x1 - x0 + 1 AS w FROM cr0 JOIN cs1 USING (frame_id) JOIN mp0 USING (frame_id) WHERE px >= 500 AND rows >= 40 AND n >= 12 AND y >= floor(y0 + 0.15::DOUBLE * rows) AND y <= floor(y1 - 0.15::DOUBLE * rows) AND floor(0.75::DOUBLE * (x1 - x0 + 1)) - floor(0.25::DOUBLE * (x1 - x0 + 1)) >= 4),
pr0 AS (SELECT frame_id, y, any_value(w) AS w, median(z) AS md, stddev_pop(z) AS sd, max(z) FILTER (mid) AS top, arg_min(pos, struct_pack(v := -round(z, 12), pos := pos)) FILTER (mid) AS peak FROM (SELECT ok0.frame_id, ok0.y, w, v2.x - x0 AS pos, z, v2.x - x0 >= floor(0.25::DOUBLE * w) AND v2.x - x0 < floor(0.75::DOUBLE * w) AS mid FROM ok0 JOIN v2 ON v2.frame_id = ok0.frame_id AND v2.y = ok0.y AND v2.x BETWEEN x0 AND x1) GROUP BY 1, 2),
of0 AS (SELECT *, (peak - (w - 1) / 2) / w AS off, (top - md) / (sd + 1e-6) AS sure, (row_number() OVER (PARTITION BY frame_id ORDER BY y) - 1) / (count(*) OVER (PARTITION BY frame_id) - 1) AS u, count(*) OVER (PARTITION BY frame_id) AS c FROM pr0),
sp1 AS (SELECT frame_id, median(abs(off)) AS a, quantile_cont(abs(off), 0.9) AS b, regr_slope(off, u) AS s, stddev_pop(off) AS d, median(sure) AS e, median(w) / 64 AS f FROM of0 WHERE c >= 20 GROUP BY 1)
SELECT fh.frame_id, CAST(a IS NULL AS DOUBLE) AS sp_absent, coalesce(a, -1) AS sp_offset_med, coalesce(b, -1) AS sp_offset_max, coalesce(s, -1) AS sp_offset_slope, coalesce(d, -1) AS sp_offset_sd, coalesce(e, -1) AS sp_ridge_conf, coalesce(f, -1) AS sp_width_med FROM fh LEFT JOIN sp1 USING (frame_id)""",
        "sp_offset_med", "sp_offset_max", "sp_offset_slope", "sp_offset_sd", "sp_ridge_conf", "sp_width_med",
    ),
    "isotropic": _q(
        PX,
        """, t AS (SELECT x2, (x2 + 0.5) * 64 / 37 - 0.5 AS p FROM range(37) r(x2)), w AS (SELECT x2, CAST(floor(least(greatest(p, 0), 63)) AS INTEGER) AS a, least(greatest(p, 0), 63) - floor(least(greatest(p, 0), 63)) AS f FROM t),
r AS (SELECT l.frame_id, l.y, x2, l.v * (1 - f) + coalesce(h.v, 0) * f AS v FROM w JOIN px l ON l.x = a LEFT JOIN px h ON h.frame_id = l.frame_id AND h.y = l.y AND h.x = a + 1)
SELECT frame_id, CAST(x2 AS INTEGER) AS x, avg(v) AS v_mean, max(v) AS v_max FROM r GROUP BY 1, 2""",
        "v_mean", "v_max",
    ),
    "mask_store": _q(MASK, "SELECT frame_id, count(*) AS n, avg(y) AS cy, avg(x) AS cx FROM mk WHERE CASE WHEN frame_id % 3 > 0 THEN m ELSE y < 32 END GROUP BY 1", "cy", "cx"),
    "display_names": """WITH c AS (SELECT DISTINCT CASE WHEN event_id % 5 = 0 THEN 'emb' || (user_id % 8) || '_mean' ELSE event_type || '_' || ['mean', 'max_asym', 'dev', 'deg'][event_id % 4 + 1] END AS feature, event_type, event_id % 5 = 0 AS emb, user_id % 8 AS k, CASE WHEN event_id % 5 > 0 THEN event_id % 4 END AS s FROM events)
SELECT DISTINCT feature, CASE WHEN emb THEN 'компонента ' || k || ' эмбеддинга снимка' WHEN s = 3 OR event_type NOT IN ('view', 'click', 'purchase') OR event_type = 'purchase' AND s <> 1 THEN feature WHEN event_type = 'purchase' THEN 'покупка (разница сторон)'
  ELSE CASE event_type WHEN 'view' THEN 'взгляд' ELSE 'щелчок' END || CASE s WHEN 0 THEN ' (в среднем)' WHEN 1 THEN ' (максимум) (разница сторон)' ELSE ' (отклонение от нормы)' END END AS name FROM c""",
    "chain_dp": _q(
        "RECURSIVE " + ROWS + ",\n" + PEAKS + """,
pn AS MATERIALIZED (SELECT frame_id, y, zsum AS r, row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i, max(abs(zsum)) OVER (PARTITION BY frame_id) AS sc, count(*) OVER (PARTITION BY frame_id) AS n FROM pk JOIN rw USING (frame_id, y)),
dp AS (SELECT frame_id, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS score, CAST([] AS BIGINT[]) AS back FROM (SELECT DISTINCT frame_id FROM pn)
  UNION ALL SELECT q.frame_id, q.i, list_append(score, q.r + 0.45::DOUBLE * q.sc + CASE WHEN best > 0 THEN best ELSE 0 END), list_append(back, CASE WHEN best > 0 THEN came ELSE 0 END) FROM (
    SELECT dp.frame_id, p.i, p.r, p.sc, any_value(score) AS score, any_value(back) AS back, max(score[o.i] - 0.02::DOUBLE * p.sc * abs(p.y - o.y - 6)) FILTER (p.y - o.y BETWEEN 0.55::DOUBLE * 6 AND 1.8::DOUBLE * 6) AS best,
      arg_max(o.i, struct_pack(s := score[o.i] - 0.02::DOUBLE * p.sc * abs(p.y - o.y - 6), i := -o.i)) FILTER (p.y - o.y BETWEEN 0.55::DOUBLE * 6 AND 1.8::DOUBLE * 6) AS came
    FROM dp JOIN pn p ON p.frame_id = dp.frame_id AND p.i = dp.i + 1 LEFT JOIN pn o ON o.frame_id = dp.frame_id AND o.i <= dp.i GROUP BY 1, 2, 3, 4) q),
fi AS (SELECT frame_id, score, back, list_position(score, list_max(score)) AS top FROM dp QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY i DESC) = 1),
wk AS (SELECT frame_id, back, CAST(top AS BIGINT) AS i, 0 AS d FROM fi UNION ALL SELECT frame_id, back, back[i], d + 1 FROM wk WHERE back[i] > 0)""",
        "SELECT frame_id, CAST(max(d) OVER (PARTITION BY frame_id) - d AS INTEGER) AS ord, y FROM wk JOIN pn USING (frame_id, i)",
    ),
    "level_rows": _q(
        "RECURSIVE " + ROWS + """,
sr AS MATERIALIZED (SELECT frame_id, y, row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i, count(*) OVER (PARTITION BY frame_id) AS n, [-abs(y / 64.0::DOUBLE - (k + 0.5::DOUBLE) / 4) * (1 + zsum) for k in range(4)] AS s FROM rw),
lv9 AS (SELECT frame_id, i, s AS total, [CAST([1, 2, 3, 4] AS BIGINT[])] AS back FROM sr WHERE i = 1
  UNION ALL SELECT l.frame_id, r.i, [list_max(l.total[1:k]) + r.s[k] for k in range(1, 5)], list_append(l.back, [list_position(l.total, list_max(l.total[1:k])) for k in range(1, 5)]) FROM lv9 l JOIN sr r ON r.frame_id = l.frame_id AND r.i = l.i + 1),
en AS (SELECT l.frame_id, total, back, n FROM lv9 l JOIN sr ON sr.frame_id = l.frame_id AND sr.i = l.i AND sr.i = sr.n),
bk AS (SELECT frame_id, back, n AS i, CAST(list_position(total, list_max(total)) AS BIGINT) AS k FROM en UNION ALL SELECT frame_id, back, i - 1, CAST(back[i][k] AS BIGINT) FROM bk WHERE i > 1)""",
        "SELECT frame_id, y, CAST(k - 1 AS INTEGER) AS level FROM bk JOIN sr USING (frame_id, i)",
    ),
    "chain_frame": _q(ROWS + ",\n" + CHAIN, "SELECT frame_id, y, x, across, along, pitch, ref FROM al0 WHERE x % 8 = y % 8", "across", "along", "pitch", "ref"),
    "kp_spine": _q(
        "RECURSIVE " + ROWS + ",\n" + CHAIN + """,
gw AS (SELECT k, exp(-0.5::DOUBLE * k * k) / sum(exp(-0.5::DOUBLE * k * k)) OVER () AS g FROM range(-4, 5) t(k)),
g1 AS MATERIALIZED (SELECT a.frame_id, a.y, a.x, sum(g * b.z) AS z FROM nm a JOIN fh USING (frame_id), gw, nm b WHERE b.frame_id = a.frame_id AND b.x = a.x AND b.y = CASE WHEN a.y + k < 0 THEN -1 - (a.y + k) WHEN a.y + k >= h THEN 2 * h - 1 - (a.y + k) ELSE a.y + k END GROUP BY 1, 2, 3),
g2 AS MATERIALIZED (SELECT a.frame_id, a.y, a.x, sum(g * b.z) AS z FROM g1 a, gw, g1 b WHERE b.frame_id = a.frame_id AND b.y = a.y AND b.x = CASE WHEN a.x + k < 0 THEN -1 - (a.x + k) WHEN a.x + k > 63 THEN 127 - (a.x + k) ELSE a.x + k END GROUP BY 1, 2, 3),
br AS MATERIALIZED (SELECT al0.frame_id, al0.y, al0.x, across > 0 AS right_side FROM al0 JOIN g2 USING (frame_id, y, x) WHERE g2.z >= 0.35::DOUBLE * ref AND abs(across) >= 1.3::DOUBLE * 6),
tc AS (SELECT br.* FROM br JOIN fh USING (frame_id) WHERE y >= h - 3 UNION SELECT br.* FROM tc JOIN br ON br.frame_id = tc.frame_id AND br.right_side = tc.right_side AND abs(br.y - tc.y) + abs(br.x - tc.x) = 1),
hi0 AS (SELECT frame_id, any_value(h) - min(y) AS high FROM (SELECT frame_id, right_side, y FROM tc GROUP BY 1, 2, 3 HAVING count(*) >= 0.3::DOUBLE * 6) JOIN fh USING (frame_id) GROUP BY 1),
fr AS (SELECT f.frame_id, h, coalesce(high, 0) AS high, coalesce(high, 0) > 0 AND coalesce(high, 0) < 0.6::DOUBLE * h AS pelvis FROM ptc f JOIN fh USING (frame_id) LEFT JOIN hi0 USING (frame_id)),
li0 AS MATERIALIZED (SELECT frame_id, y, x, CAST(least(z / greatest(ref, 1e-3::DOUBLE), 3) AS FLOAT) AS v FROM al0),
nb AS MATERIALIZED (SELECT frame_id, y, x, y + dy AS oy, x + dx AS ox FROM li0, range(-3, 4) s(dy), range(-3, 4) t(dx) WHERE abs(dx) <= round_even(sqrt(9 - dy * dy), 0)),
er AS MATERIALIZED (SELECT nb.frame_id, nb.y, nb.x, min(b.v) AS v FROM nb JOIN li0 b ON b.frame_id = nb.frame_id AND b.y = oy AND b.x = ox GROUP BY 1, 2, 3), di AS MATERIALIZED (SELECT nb.frame_id, nb.y, nb.x, max(b.v) AS v FROM nb JOIN er b ON b.frame_id = nb.frame_id AND b.y = oy AND b.x = ox GROUP BY 1, 2, 3),
ts0 AS MATERIALIZED (SELECT a.frame_id, a.y, a.x FROM nm a JOIN nm b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND b.z > 0.02::DOUBLE GROUP BY 1, 2, 3 HAVING count(*) = 25),
art AS (SELECT al0.frame_id, count(*) AS n FROM al0 JOIN li0 USING (frame_id, y, x) JOIN di USING (frame_id, y, x) JOIN ts0 USING (frame_id, y, x) JOIN fr USING (frame_id) WHERE li0.v - di.v >= 0.25::FLOAT AND abs(across) >= 1.3::DOUBLE * 6 AND (NOT pelvis OR al0.y < h - high) GROUP BY 1)""",
        """SELECT frame_id, CASE WHEN pelvis THEN high / pitch ELSE CAST(high > 0 AS DOUBLE) END AS kp_wing_vis, CAST(high = 0 AS DOUBLE) AS kp_wing_absent, coalesce(art.n, 0) / (64 * h) AS kp_art_frac FROM fr JOIN ptc USING (frame_id) LEFT JOIN art USING (frame_id)""",
        "kp_wing_vis", "kp_art_frac",
    ),
    "body_chain": _q(
        "RECURSIVE " + ROWS + ",\n" + PEAKS + """,
cd0 AS (SELECT frame_id, round(wx, 6) AS x, CAST(y AS DOUBLE) AS y, n * 10.0::DOUBLE AS area, round(zsum, 6) AS s, 0.05::DOUBLE + round(zsum, 6) / 100 AS conf FROM pk JOIN rw USING (frame_id, y)),
c10 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) AS i, 1.2418418802382916::DOUBLE * s - 0.17134103222406044::DOUBLE * abs(ln(area / (0.9::DOUBLE * 1.4::DOUBLE * 64))) + 3.546852470389268::DOUBLE AS node FROM (SELECT * FROM cd0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, y, x) <= 10)),
sg AS MATERIALIZED (SELECT a.frame_id, a.i, b.i AS j, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len, a.node AS na, b.node AS nb FROM c10 a JOIN c10 b ON a.frame_id = b.frame_id AND b.y - a.y > 0.55::DOUBLE * 8),
pa AS (SELECT frame_id, i, j, dx, dy, len, na + nb - 2.547764021483717::DOUBLE * abs(len - 8) / 8 AS score, [i, j] AS path FROM sg
  UNION ALL SELECT pa.frame_id, sg.i, sg.j, sg.dx, sg.dy, sg.len, score + sg.nb - 2.547764021483717::DOUBLE * abs(sg.len - 8) / 8 - 2.2863905908415556::DOUBLE * acos(least(greatest((pa.dx * sg.dx + pa.dy * sg.dy) / (pa.len * sg.len), -1), 1)), list_append(path, sg.j) FROM pa JOIN sg ON sg.frame_id = pa.frame_id AND sg.i = pa.j),
bp AS (SELECT frame_id, arg_max(path, score) AS path FROM pa GROUP BY 1)""",
        "SELECT frame_id, CAST(list_position(path, i) - 1 AS INTEGER) AS ord, y, x AS px FROM bp JOIN c10 USING (frame_id) WHERE list_contains(path, i)",
        "px",
    ),
    "bright_arcs": _q(
        "RECURSIVE " + MASK + ",\n" + _hat(11) + ",\nhp AS MATERIALIZED (SELECT frame_id, y, x FROM ht JOIN (SELECT frame_id, greatest(18, floor(quantile_cont(hat, 0.99))) AS cut FROM ht GROUP BY 1) USING (frame_id) WHERE hat >= cut AND NOT m),\n" + _parts("hp"),
        """, ax0 AS (SELECT frame_id, root, count(*) AS n, var_samp(id // 4096) AS a, var_samp(id % 4096) AS b, covar_samp(id // 4096, id % 4096) AS c FROM lb GROUP BY 1, 2 HAVING count(*) >= 6),
le AS (SELECT frame_id, 4 * sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)) / 64 AS l FROM ax0), up0 AS (SELECT ht.frame_id, avg(CASE WHEN hp.y IS NULL THEN 0.0 ELSE 1.0 END) AS u FROM ht JOIN fh USING (frame_id) LEFT JOIN hp USING (frame_id, y, x) WHERE ht.y < floor(0.35::DOUBLE * h) GROUP BY 1)
SELECT frame_id, coalesce(max(l), 0) AS arc_max_len, coalesce(sum(l), 0) AS arc_total_len, CAST(count(*) FILTER (l > 0.25) AS DOUBLE) AS arc_n_long, any_value(u) AS arc_upper_frac FROM up0 LEFT JOIN le USING (frame_id) GROUP BY 1""",
        "arc_max_len", "arc_total_len", "arc_upper_frac",
    ),
    "row_profile": _q(ROWS, "SELECT * FROM rw", "cx", "zsum", "wx"),
    "col_profile": _q(MASK, "SELECT frame_id, x, count(*) AS n, min(y) AS y_min, max(y) AS y_max, avg(z) AS zmean FROM mk WHERE m GROUP BY 1, 2", "zmean"),
    "silhouette_geometry": _q(
        ROWS + ",\n" + SHAPE,
        """, cl AS (SELECT frame_id, regr_slope(cx, y) AS k, regr_intercept(cx, y) AS c FROM rw GROUP BY 1 HAVING count(*) >= 20), cv AS (SELECT frame_id, avg(abs(cx - k * y - c)) AS off FROM rw JOIN cl USING (frame_id) GROUP BY 1)
SELECT frame_id, n / (w * h) AS area_frac, (y1 - y0 + 1) / (x1 - x0 + 1) AS bbox_aspect, n / ((x1 - x0 + 1) * (y1 - y0 + 1)) AS fill, (x1 - x0 + 1) / w AS col_span, (y1 - y0 + 1) / h AS row_span,
 y0 / h AS margin_top_frac, (h - 1 - y1) / h AS margin_bottom_frac, x0 / w AS margin_left_frac, (w - 1 - x1) / w AS margin_right_frac, CAST(y0 <= 1 AS DOUBLE) AS touch_top, CAST(y1 >= h - 2 AS DOUBLE) AS touch_bottom, CAST(x0 <= 1 AS DOUBLE) AS touch_left, CAST(x1 >= w - 2 AS DOUBLE) AS touch_right,
 int_mean, int_std, int_p95, int_mean - bg_mean AS contrast, saturated_frac, bg_mean, 0.0::DOUBLE AS empty, coalesce(off / w, 0) AS curvature FROM sh JOIN sz USING (frame_id) LEFT JOIN cv USING (frame_id)""",
        "area_frac", "bbox_aspect", "fill", "col_span", "row_span", "margin_top_frac", "margin_bottom_frac", "margin_left_frac", "margin_right_frac", "int_mean", "int_std", "int_p95", "contrast", "saturated_frac", "bg_mean", "curvature",
    ),
    "axis_orientation": _q(
        MASK,
        """, cv AS (SELECT frame_id, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM mk WHERE m GROUP BY 1),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS lam FROM cv)
SELECT frame_id, CASE WHEN abs(degrees(atan2(b, lam - a))) > 90 THEN 180 - abs(degrees(atan2(b, lam - a))) ELSE abs(degrees(atan2(b, lam - a))) END AS axis_deg, 4 * sqrt(lam) AS length FROM l""",
        "axis_deg", "length",
    ),
    "centerline_regression": _q(
        BONE,
        """, rb AS (SELECT frame_id, y, avg(x) AS cx, max(x) - min(x) AS wd FROM bn WHERE m GROUP BY 1, 2), li AS (SELECT frame_id, regr_slope(cx, y) AS s, regr_intercept(cx, y) AS i, count(*) AS n, median(wd) AS width, stddev_pop(wd) AS sd FROM rb GROUP BY 1),
rs AS (SELECT rb.frame_id, rb.y, cx, cx - s * rb.y - i AS res, ntile(3) OVER (PARTITION BY rb.frame_id ORDER BY rb.y) AS t FROM rb JOIN li USING (frame_id)),
th AS (SELECT frame_id, max(s) - min(s) AS spread, max(sign(s)) - min(sign(s)) AS sg FROM (SELECT frame_id, t, regr_slope(cx, y) AS s FROM rs GROUP BY 1, 2 HAVING count(*) > 10) GROUP BY 1),
bd AS (SELECT frame_id, sqrt(avg(res * res)) AS rms, max(abs(res)) AS mx FROM rs GROUP BY 1)
SELECT frame_id, CASE WHEN n >= 40 THEN 0.0::DOUBLE ELSE 1.0 END AS empty_spine, CASE WHEN n >= 40 THEN abs(degrees(atan(s))) END AS tilt_deg, CASE WHEN n >= 40 THEN rms / (width + 1e-6) END AS curv_rms_norm, CASE WHEN n >= 40 THEN mx / (width + 1e-6) END AS curv_max_norm,
 CASE WHEN n >= 40 THEN CAST(coalesce(sg, 0) > 0 AS DOUBLE) END AS slope_sign_change, CASE WHEN n >= 40 THEN degrees(atan(coalesce(spread, 0))) END AS slope_spread, CASE WHEN n >= 40 THEN sd / (width + 1e-6) END AS width_cv FROM li LEFT JOIN th USING (frame_id) JOIN bd USING (frame_id)""",
        "tilt_deg", "curv_rms_norm", "curv_max_norm", "slope_spread", "width_cv",
    ),
    "column_tilt": _q(BONE, COLUMN + " SELECT sf.frame_id, tilt AS col_tilt_deg, kink AS col_kink_deg FROM sf LEFT JOIN g USING (frame_id)", "col_tilt_deg", "col_kink_deg"),
    "spine_column": _q(
        BONE,
        COLUMN
        + """ SELECT sf.frame_id, CAST(tilt IS NULL AS DOUBLE) AS empty_column, tilt AS col_tilt_deg, rms / (width + 1e-6) AS col_curv_norm, kink AS col_kink_deg, width / (2 * mx) AS col_width_med, sd / (width + 1e-6) AS col_width_cv, (bottom - top) / (2 * my) AS col_height_frac,
 area / (4 * mx * my) AS col_area_frac, top / (2 * my) AS col_top_margin, (2 * my - bottom) / (2 * my) AS col_bottom_margin FROM sf LEFT JOIN (g JOIN b USING (frame_id)) USING (frame_id)""",
        "col_tilt_deg", "col_curv_norm", "col_kink_deg", "col_width_med", "col_width_cv", "col_height_frac", "col_area_frac", "col_top_margin", "col_bottom_margin",
    ),
    "label_verdicts": """WITH f AS (SELECT d.doc_id AS study, 1 - quality AS a, toxic AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT study, 'spine' AS region, a AS flags_or, NULL AS v FROM f WHERE a IS NOT NULL UNION ALL SELECT study, 'hip_right', greatest(coalesce(a, 0), coalesce(b, 0)), CASE WHEN study % 3 = 0 THEN b END FROM f WHERE coalesce(a, b) IS NOT NULL)
SELECT study, region, CAST(flags_or AS INTEGER) AS flags_or, CAST(coalesce(v, flags_or) AS INTEGER) AS verdict_itog, CAST(coalesce(v, flags_or) <> flags_or AS INTEGER) AS verdict_mismatch FROM r""",
    "label_folds": """WITH f AS (SELECT source, CAST((row_number() OVER (ORDER BY md5('20260915:' || source), source) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT d.doc_id, source, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT source AS study, doc_id, region, fold FROM (SELECT doc_id, source, 'spine' AS region FROM l WHERE quality IS NOT NULL UNION ALL SELECT doc_id, source, 'hip_right' FROM l WHERE coalesce(quality, toxic) IS NOT NULL) JOIN f USING (source)""",
    # each kept peak is the end of a chain: the next candidate replaces it if it is nearer than the gap and higher, and follows it if it is not nearer
    "spaced_peaks": _q(
        ROWS + ",\n" + PEAKS,
        """, c AS (SELECT frame_id, y, zsum AS v, row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i FROM pk JOIN rw USING (frame_id, y) WHERE zsum > 5),
s AS (WITH RECURSIVE f AS (SELECT frame_id, i, y, v, y AS ky, v AS kv, [{'y': y, 'v': v}] AS kept FROM c WHERE i = 1
  UNION ALL SELECT c.frame_id, c.i, c.y, c.v, CASE WHEN c.y - ky >= 8 OR c.v > kv THEN c.y ELSE ky END, CASE WHEN c.y - ky >= 8 OR c.v > kv THEN c.v ELSE kv END,
    CASE WHEN c.y - ky >= 8 THEN list_append(kept, {'y': c.y, 'v': c.v}) WHEN c.v > kv THEN list_append(kept[1:-2], {'y': c.y, 'v': c.v}) ELSE kept END FROM f JOIN c ON c.frame_id = f.frame_id AND c.i = f.i + 1)
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY i DESC) = 1)
SELECT frame_id, k.y AS y, k.v AS value FROM (SELECT frame_id, unnest(kept) AS k FROM s)""",
        "value",
    ),
    "anatomy_visibility": _q(
        MASK + ", sz AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM mk GROUP BY 1)",
        """SELECT frame_id, avg(CAST(m AS INTEGER)) FILTER ((x < floor(0.28 * w) OR x >= floor(0.72 * w)) AND y >= floor(0.85 * h)) AS iliac_bottom_frac,
 avg(CAST(m AS INTEGER)) FILTER ((x < floor(0.28 * w) OR x >= floor(0.72 * w)) AND y < floor(0.15 * h)) AS ribs_top_frac FROM mk JOIN sz USING (frame_id) GROUP BY 1""",
        "iliac_bottom_frac", "ribs_top_frac",
    ),
    "masked_fov": _q(
        NORM,
        """, cx AS (SELECT frame_id, avg(CAST(d > 0.98 AS INTEGER)) AS mc, (max(x) FILTER (d <= 0.98) - min(x) FILTER (d <= 0.98) + 1) / count(*) AS ox FROM (SELECT frame_id, x, avg(CAST(z <= 0.002 AS INTEGER)) AS d FROM nm GROUP BY 1, 2) GROUP BY 1),
cy AS (SELECT frame_id, avg(CAST(d > 0.98 AS INTEGER)) AS mr, (max(y) FILTER (d <= 0.98) - min(y) FILTER (d <= 0.98) + 1) / count(*) AS oy FROM (SELECT frame_id, y, avg(CAST(z <= 0.002 AS INTEGER)) AS d FROM nm GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT frame_id, avg(CAST(z <= 0.002 AS INTEGER)) AS masked_frac FROM nm GROUP BY 1)
SELECT frame_id, masked_frac, CASE WHEN ox * oy > 0 THEN mc ELSE 0 END AS masked_cols, CASE WHEN ox * oy > 0 THEN mr ELSE 0 END AS masked_rows, CASE WHEN ox * oy > 0 THEN ox ELSE 1 END AS fov_w_frac, CASE WHEN ox * oy > 0 THEN oy ELSE 1 END AS fov_h_frac FROM f JOIN cx USING (frame_id) JOIN cy USING (frame_id)""",
        "masked_cols", "masked_rows", "masked_frac", "fov_w_frac", "fov_h_frac",
    ),
    "autocorr_period": _q(ROWS + ",\n" + PERIOD, "SELECT frame_id, CAST(period AS INTEGER) AS period, strength FROM pd", "strength"),
    "local_peaks": _q(ROWS, "SELECT frame_id, y, zsum AS value FROM (SELECT *, lag(zsum) OVER w AS a, lead(zsum) OVER w AS b FROM rw WINDOW w AS (PARTITION BY frame_id ORDER BY y)) WHERE zsum >= a AND zsum > b", "value"),
    "disc_response": _q(
        ROWS,
        """, nb AS (SELECT frame_id, y, zsum, row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM rw),
re AS (SELECT a.frame_id, a.y, w AS width, 0.5 * avg(b.zsum) FILTER (b.i < a.i - w) - avg(b.zsum) FILTER (b.i >= a.i - w AND b.i < a.i) + 0.5 * avg(b.zsum) FILTER (b.i >= a.i) AS r
  FROM nb a, (VALUES (3), (4), (5)) t(w), nb b WHERE b.frame_id = a.frame_id AND b.i BETWEEN a.i - 2 * w AND a.i + w - 1 AND a.i > 2 * w AND a.i + w - 1 <= a.n GROUP BY 1, 2, 3)
SELECT frame_id, width, y, round(r, 9) AS response FROM re QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(r, 9) DESC, width, y) = 1""",
        "response",
    ),
    "proximal_grid": _q(
        BONE,
        """, di AS (SELECT a.frame_id, a.y, a.x, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM bn a JOIN ex USING (frame_id) JOIN bn b ON b.frame_id = a.frame_id WHERE a.m AND a.y >= floor(y_lo + 0.8::DOUBLE * span) AND NOT b.m GROUP BY 1, 2, 3),
wd AS (SELECT frame_id, greatest(4, 2 * median(d)) AS sw FROM di GROUP BY 1),
ce AS (SELECT frame_id, m, (z - mid) / sd AS s, CAST(floor(((y - y_lo) * cos(radians(ang)) + (x - fx) * sin(radians(ang))) / span / 0.75::DOUBLE * 4) AS INTEGER) AS i,
  CAST(floor((((x - fx) * cos(radians(ang)) - (y - fy) * sin(radians(ang))) / sw + 1.6::DOUBLE) / 3.2::DOUBLE * 3) AS INTEGER) AS j FROM bn JOIN sf USING (frame_id) JOIN wd USING (frame_id) JOIN tn USING (frame_id) WHERE px >= 50 AND fn >= 10)
SELECT frame_id, i, j, CASE WHEN count(*) < 12 THEN -1.0 ELSE avg(CAST(m AS INTEGER)) END AS fill, CASE WHEN count(*) < 12 THEN -1.0 ELSE coalesce(avg(s) FILTER (m), -1) END AS intensity FROM ce WHERE i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 2 GROUP BY 1, 2, 3""",
        "fill", "intensity",
    ),
    "medial_contrast": _q(
        BONE,
        """, zo AS (SELECT frame_id, (z - mid) / sd AS s FROM bn JOIN sf USING (frame_id) JOIN tn USING (frame_id) WHERE m AND px >= 50 AND fn >= 10 AND (x - fx) * cos(radians(ang)) - (y - fy) * sin(radians(ang)) > 0 AND (y - y_lo) / span > 0.35::DOUBLE AND (y - y_lo) / span < 0.72::DOUBLE),
g AS (SELECT frame_id, quantile_cont(s, 0.9) AS p, avg(CAST(s > 1 AS INTEGER)) AS b FROM zo GROUP BY 1 HAVING count(*) >= 20)
SELECT frame_id, coalesce(p, -1) AS med_prox_contrast, coalesce(b, -1) AS med_prox_bright_frac, CAST(p IS NOT NULL AS DOUBLE) AS med_prox_ok FROM sf LEFT JOIN g USING (frame_id)""",
        "med_prox_contrast", "med_prox_bright_frac",
    ),
    "trochanter_density": _q(
        BONE,
        """, a AS (SELECT b.frame_id, y, x, z, m, min(x) FILTER (m) OVER w AS lo, max(x) FILTER (m) OVER w AS hi, count(*) FILTER (m) OVER w AS k FROM bn b JOIN sf USING (frame_id)
  WHERE px >= 200 AND fn >= 10 AND y >= floor(y_lo + 0.25::DOUBLE * span) AND y < floor(y_lo + 0.55::DOUBLE * span) WINDOW w AS (PARTITION BY b.frame_id, y)),
bd AS (SELECT frame_id FROM a GROUP BY 1 HAVING count(*) FILTER (m) >= 40),
r AS (SELECT frame_id, y, max(z) AS pk, avg(z) AS mn, (any_value(hi) - arg_min(x, struct_pack(z := -z, x := x))) / (any_value(hi) - floor(any_value(hi) - 0.5::DOUBLE * (any_value(hi) - any_value(lo)))) AS ps
  FROM a WHERE k >= 6 AND hi > floor(hi - 0.5::DOUBLE * (hi - lo)) + 1 AND x BETWEEN floor(hi - 0.5::DOUBLE * (hi - lo)) AND hi GROUP BY 1, 2),
s AS (SELECT *, abs(pk - lag(pk) OVER (PARTITION BY frame_id ORDER BY y)) AS st FROM r),
g AS (SELECT frame_id, max(pk) AS pk, avg(mn) AS mn, median(ps) AS ps, stddev_pop(ps) AS sd, median(st) AS st FROM s JOIN bd USING (frame_id) GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT sf.frame_id, greatest(CASE WHEN fn > 20 THEN fz ELSE mid END, 1e-3) AS ref FROM sf JOIN tn USING (frame_id))
SELECT sf.frame_id, CAST(pk IS NULL AS DOUBLE) AS lt_dens_empty, pk / ref AS lt_dens_peak, mn / ref AS lt_dens_mean, ps AS lt_dens_pos, sd AS lt_dens_pos_std, st / ref AS lt_dens_grad FROM sf LEFT JOIN (g JOIN f USING (frame_id)) USING (frame_id)""",
        "lt_dens_peak", "lt_dens_mean", "lt_dens_pos", "lt_dens_pos_std", "lt_dens_grad",
    ),
    "side_margins": _q(
        MASK,
        """, g AS (SELECT frame_id, min(x) FILTER (m) * 0.6::DOUBLE AS l, (max(x) - max(x) FILTER (m)) * 0.6::DOUBLE AS r FROM mk GROUP BY 1)
SELECT frame_id, l AS roi_margin_left_mm, r AS roi_margin_right_mm, least(l, r) AS roi_margin_min_mm, CAST(least(l, r) >= 20 AS DOUBLE) AS roi_margin_ok, greatest(0.0, 20 - least(l, r)) AS roi_margin_deficit_mm FROM g""",
        "roi_margin_left_mm", "roi_margin_right_mm", "roi_margin_min_mm", "roi_margin_deficit_mm",
    ),
    "side_detect": _q(
        MASK,
        """, ct AS (SELECT frame_id, quantile_cont(CAST(y AS DOUBLE), 0.3) AS a, quantile_cont(CAST(y AS DOUBLE), 0.7) AS b FROM mk WHERE m GROUP BY 1),
g AS (SELECT frame_id, avg(x) FILTER (y < a) AS top_x, avg(x) FILTER (y > b) AS bottom_x FROM mk JOIN ct USING (frame_id) WHERE m GROUP BY 1)
SELECT *, CASE WHEN top_x IS NULL OR bottom_x IS NULL THEN 'unknown' WHEN top_x > bottom_x THEN 'right' ELSE 'left' END AS side FROM g""",
        "top_x", "bottom_x",
    ),
    "region_route": _q(
        MASK + ",\n" + SHAPE + ",\n" + FULL,
        """, ct AS (SELECT frame_id, quantile_cont(CAST(y AS DOUBLE), 0.3) AS a, quantile_cont(CAST(y AS DOUBLE), 0.7) AS b FROM mk WHERE m GROUP BY 1),
sd AS (SELECT frame_id, avg(x) FILTER (y < a) AS tx, avg(x) FILTER (y > b) AS bx FROM mk JOIN ct USING (frame_id) WHERE m GROUP BY 1),
c AS (SELECT sz.frame_id, coalesce(n, 0) AS n, tx, bx, 0.6 * least(coalesce(strength, 0) / 0.35::DOUBLE, 1.0) + 0.4 * least(coalesce((y1 - y0 + 1) / (x1 - x0 + 1), 0) / 1.6::DOUBLE, 1.0) AS score
  FROM sz LEFT JOIN sh USING (frame_id) LEFT JOIN pd USING (frame_id) LEFT JOIN sd USING (frame_id)),
d AS (SELECT *, CASE WHEN score > 0.62 THEN least(score, 1) ELSE least(1 - score, 1) END AS cf FROM c)
SELECT frame_id, score, CASE WHEN n < 50 THEN 0.0 WHEN cf < 0.6 OR score > 0.62 THEN cf WHEN tx IS NULL OR bx IS NULL THEN 0.0 ELSE round_even(cf, 2) END AS confidence, CASE WHEN n < 50 OR cf < 0.6 THEN 'unknown' WHEN score > 0.62 THEN 'spine' WHEN tx > bx THEN 'hip_right' WHEN tx <= bx THEN 'hip_left' ELSE 'unknown' END AS region FROM d""",
        "score", "confidence",
    ),
    "mirror_frames": _q(PX, "SELECT frame_id, 63 - x AS x, avg(v) AS v_mean FROM px GROUP BY 1, 2", "v_mean"),
    "morph_rect_tophat": _q(
        NORM,
        """, e1 AS (SELECT frame_id, y, x, z, min(z) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM nm),
e2 AS (SELECT frame_id, y, x, z, min(o) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM e1),
d1 AS (SELECT frame_id, y, x, z, max(o) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM e2),
d2 AS (SELECT frame_id, y, x, z - max(o) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hat FROM d1)
SELECT frame_id, avg(hat) AS hat_mean, max(hat) AS hat_max, count(*) FILTER (hat >= 0.5) AS n_bright FROM d2 GROUP BY 1""",
        "hat_mean", "hat_max",
    ),
    "components_stats": _q(
        MASK,
        """, p AS (SELECT frame_id, y, x, y * 64 + x AS id FROM mk WHERE m),
ed AS (SELECT a.frame_id, a.id, b.id AS other FROM p a JOIN p b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
rc AS (SELECT frame_id, id, other FROM ed UNION SELECT rc.frame_id, rc.id, ed.other FROM rc JOIN ed ON ed.frame_id = rc.frame_id AND ed.id = rc.other),
lb AS (SELECT frame_id, id, min(other) AS root FROM rc GROUP BY 1, 2)
SELECT p.frame_id, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM p JOIN lb USING (frame_id, id) GROUP BY p.frame_id, root""",
    ).replace("WITH px", "WITH RECURSIVE px", 1),
    "interp_chain": _q(
        ROWS,
        """, pt AS (SELECT frame_id, y AS y0, wx AS x0, lead(y) OVER w AS y1, lead(wx) OVER w AS x1, row_number() OVER w AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM rw WHERE y % 16 = 5 WINDOW w AS (PARTITION BY frame_id ORDER BY y))
SELECT rw.frame_id, rw.y, x0 + (x1 - x0) * (rw.y - y0) / (y1 - y0) AS x FROM rw JOIN pt ON pt.frame_id = rw.frame_id AND y1 IS NOT NULL AND (rw.y >= y0 OR pt.i = 1) AND (rw.y < y1 OR pt.i = pt.n - 1)""",
        "x",
    ),
    "region_aggregate": _q(MEAS, "SELECT * FROM rg", "axis_deg_mean", "axis_deg_max", "kp_art_frac_mean", "vb_axis_deg_mean", "col_tilt_deg_mean", "coverage_mean"),
    "pair_asymmetry": _q(
        MEAS,
        """SELECT a.study, a.region, a.axis_deg_mean, CASE WHEN b.study IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS has_pair, coalesce(a.axis_deg_mean - b.axis_deg_mean, 0) AS axis_deg_mean_diff, abs(coalesce(a.axis_deg_mean - b.axis_deg_mean, 0)) AS axis_deg_mean_asym
FROM rg a LEFT JOIN rg b ON a.study = b.study AND b.region = CASE a.region WHEN 'hip_right' THEN 'hip_left' WHEN 'hip_left' THEN 'hip_right' END""",
        "axis_deg_mean", "axis_deg_mean_diff", "axis_deg_mean_asym",
    ),
    "verdict_axis": _q(VERDICT, "SELECT study, region, tilt, fires_axis FROM vr", "tilt"),
    "verdict_artifact": _q(VERDICT, "SELECT study, region, kp_art_frac_mean AS art, fires_artifact FROM vr", "art", digits=9),
    "quality_score": _q(VERDICT, "SELECT study, region, score FROM sc", "score"),
    "head_decisions": _q(VERDICT, "SELECT study, region, p_cov AS spine_coverage, p_sq AS spine_quality, p_hq AS hip_quality, p_pos AS hip_positioning, p_roi AS hip_roi, 0.0::DOUBLE AS no_head, p_cov >= 0.5 AS covers, false AS fires_no_head FROM pb", "spine_coverage", "spine_quality", "hip_quality", "hip_positioning", "hip_roi"),
    "hip_reconcile": _q(VERDICT, "SELECT study, region, quality_class, array_to_string(codes, ';') AS types FROM cs0 WHERE region <> 'spine'"),
    "violation_text": _q(
        VERDICT,
        """SELECT study, region, CASE WHEN n_frames % 2 = 1 OR violation_type LIKE '%Некорректная укладка%' THEN violation_type WHEN violation_type = '' THEN 'Некорректная укладка' ELSE violation_type || ';Некорректная укладка' END AS violation_type FROM vt""",
    ),
    "report_rows": _q(VERDICT, "SELECT * FROM rp", "time_of_processing", "quality_prob"),
    "report_details": _q(VERDICT, "SELECT study, region, details FROM vt"),
    "rule_checks": _q(
        VERDICT,
        f"""SELECT study, region, 'ось позвоночника' AS task, 'rule' AS kind, round(tilt, 2) AS value, {RULES.vb_axis_limit_deg}::DOUBLE AS threshold, tilt > {RULES.vb_axis_limit_deg}::DOUBLE AS fired FROM sc WHERE region = 'spine'
UNION ALL SELECT study, region, 'посторонние предметы', 'rule', round(kp_art_frac_mean, 5), {RULES.artifact_threshold}::DOUBLE, kp_art_frac_mean > {RULES.artifact_threshold}::DOUBLE FROM sc WHERE region = 'spine'
UNION ALL SELECT study, region, 'укладка позвоночника', 'head', round(p_cov, 3), 0.5, p_cov >= 0.5 FROM sc WHERE region = 'spine'
UNION ALL SELECT study, region, 'укладка бедра', 'head', round(p_pos, 3), 0.55, p_pos >= 0.55::DOUBLE FROM sc WHERE region <> 'spine'
UNION ALL SELECT study, region, 'область интереса бедра', 'head', round(p_roi, 3), 0.45, p_roi >= 0.45::DOUBLE FROM sc WHERE region <> 'spine'""",
        "threshold", "value",
    ),
    "run_summary": _q(VERDICT, "SELECT processing_status, anatomical_region, count(*) AS n, count(*) FILTER (quality_class = 1) AS violations, avg(time_of_processing) AS mean_time, avg(quality_prob) AS mean_prob FROM rp GROUP BY 1, 2", "mean_time", "mean_prob"),
    "feature_resolution": _q(MEAS, "SELECT event_id, axis_deg AS plain, kp_art_frac AS stripped, abs(axis_deg - 50) AS deviation, -1.0::DOUBLE AS absent FROM ms", "plain", "stripped", "deviation"),
    "manifest_dedup": _q(DUP, "SELECT rel_path, study_dir, pixel_md5, dense_rank() OVER (ORDER BY pixel_md5) - 1 AS dup_group, count(*) OVER (PARTITION BY pixel_md5) AS dup_count, rel_path = min(rel_path) OVER (PARTITION BY pixel_md5) AS is_canonical FROM mf"),
    "manifest_summary": _q(
        DUP,
        """, s AS (SELECT study_dir, count(*) AS n FROM mf GROUP BY 1)
SELECT (SELECT count(*) FROM mf) AS files, (SELECT count(DISTINCT pixel_md5) FROM mf) AS distinct_md5, count(*) AS studies, min(n) AS frames_min, CAST(floor(median(n)) AS BIGINT) AS frames_median, max(n) AS frames_max FROM s""",
    ),
    "value_counts": _q(
        DUP,
        """, c AS (SELECT 'model' AS "column", model AS value, count(*) AS n FROM mf GROUP BY 2 UNION ALL SELECT 'study_dir', study_dir, count(*) FROM mf GROUP BY 2)
SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 8""",
    ),
    "label_long": """SELECT d.doc_id AS study, 'spine' AS region, 1 - quality AS flags_or, CASE WHEN quality = 0 THEN 'spine_artifact' ELSE '' END AS violation_type FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL
UNION ALL SELECT d.doc_id, 'hip_right', greatest(toxic, 1 - quality), concat_ws('|', CASE WHEN toxic = 1 THEN 'hip_r_roi' END, CASE WHEN quality = 0 THEN 'spine_artifact' END) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(quality, toxic) IS NOT NULL""",
    "study_folds": "SELECT source AS study, CAST((row_number() OVER (ORDER BY md5('20260915:' || source), source) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents)",
    "files_semi_anti": """SELECT l.doc_id, 'found' AS state FROM labels l JOIN documents d ON d.doc_id = l.doc_id UNION ALL SELECT doc_id + 1000000000, 'missing' FROM labels
UNION ALL SELECT doc_id, 'stray' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "lookup_fallback": "SELECT d.doc_id, coalesce(quality * 10.0::DOUBLE, CASE WHEN n_chars > 1000 THEN n_chars % 90 * 1.0::DOUBLE ELSE -1.0 END) AS axis FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "roc_auc": _q(EVAL, "SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS roc_auc FROM sl a, sl b WHERE a.y = 1 AND b.y = 0", "roc_auc"),
    "pr_auc": _q(EVAL, "SELECT sum(pos / np * tp / (tp + fp)) AS pr_auc FROM tl", "pr_auc"),
    "threshold_by_rate": "SELECT round(p[least(len(p), CAST(floor(h) AS BIGINT) + 1)] + (h - floor(h)) * (p[least(len(p), CAST(floor(h) AS BIGINT) + 2)] - p[least(len(p), CAST(floor(h) AS BIGINT) + 1)]), 6) AS threshold FROM (WITH "
    + EVAL
    + " SELECT list(p ORDER BY p) AS p, (count(*) - 1) * (1 - avg(y)) AS h FROM sl)",
    "threshold_by_f1": _q(EVAL, "SELECT p AS threshold, round(2 * tp / (tp + fp + np), 12) AS f1 FROM tl ORDER BY 2 DESC, 1 LIMIT 1", "threshold", "f1"),
    "confusion_report": _q(
        EVAL,
        """, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM sl)
SELECT *, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, 2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, (tp + fn) / (tp + fp + fn + tn) AS prevalence, tp + fn < 15 AS exploratory FROM c""",
        "sensitivity", "specificity", "f1", "balanced_accuracy", "prevalence",
    ),
    "bootstrap_ci": _q(
        EVAL + DRAWS,
        """, r AS (SELECT b, sum(tp) / sum(pos) AS s FROM d JOIN (SELECT g, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sl JOIN g USING (grp) GROUP BY 1) USING (g) GROUP BY b HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM r""",
        "low", "high",
    ),
    "bootstrap_auc_ci": _q(
        EVAL + DRAWS,
        """, e AS (SELECT b, p, sum(pos * times) AS pos, sum(neg * times) AS neg FROM (SELECT b, g, count(*) AS times FROM d GROUP BY 1, 2) JOIN (SELECT g, p, sum(y) AS pos, sum(1 - y) AS neg FROM sl JOIN g USING (grp) GROUP BY 1, 2) USING (g) GROUP BY 1, 2),
f AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY p DESC) AS above FROM e), r AS (SELECT b, 1 - sum(pos * (above - neg / 2)) / (sum(pos) * sum(neg)) AS s FROM f GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM r""",
        "low", "high",
    ),
    "corr_pairs": "SELECT * REPLACE (round(r, 6) AS r) FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in combinations(MEASURED, 2)) + ")",
    "corr_prune": """WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) > 0.97 AS qe, abs(corr(l_quantity, l_discount)) > 0.97 AS qd, abs(corr(l_extendedprice, l_discount)) > 0.97 AS ed FROM lineitem)
SELECT 'l_quantity' AS feature UNION ALL SELECT 'l_extendedprice' FROM c WHERE NOT qe UNION ALL SELECT 'l_discount' FROM c WHERE NOT qd AND (qe OR NOT ed)""",
    "embedding_norm": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT vec_id, round(norm, 6) AS norm, round(v[1] / (norm + 1e-6), 6) AS first, round(list_sum(list_transform(v, lambda x: x / (norm + 1e-6))), 6) AS total FROM n""",
    "embedding_pool": "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, count(*) AS n FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2",
    "topk_candidates": """WITH s AS (SELECT label, vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings)
SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 30""",
}

_AT = {n: SQL[n].replace("p >= 0.5", "p >= 0.4::DOUBLE").replace("p < 0.5", "p < 0.4::DOUBLE") for n in ("confusion_report", "bootstrap_ci")}
SQL["evaluation_row"] = f"""SELECT 'quality' AS task, 'surrogate' AS model, c.tp + c.fp + c.fn + c.tn AS n, c.tp + c.fn AS positives, round(c.prevalence, 3) AS prevalence, round(c.f1, 3) AS f1, round(c.sensitivity, 3) AS sensitivity, round(c.specificity, 3) AS specificity,
 concat_ws('/', c.tp, c.fp, c.fn, c.tn) AS counts, CASE WHEN c.exploratory THEN 'exploratory' ELSE '' END AS status, round(a.roc_auc, 3) AS roc_auc, format('{{:.2f}}–{{:.2f}}', b.low, b.high) AS auc_interval, round(d.pr_auc, 3) AS pr_auc, format('{{:.2f}}–{{:.2f}}', e.low, e.high) AS sensitivity_interval
FROM ({_AT["confusion_report"]}) c, ({SQL["roc_auc"]}) a, ({SQL["bootstrap_auc_ci"]}) b, ({SQL["pr_auc"]}) d, ({_AT["bootstrap_ci"]}) e"""
