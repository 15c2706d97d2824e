"""The engine's queries in DuckDB SQL."""

from __future__ import annotations

from ..functions.language import PLACEHOLDERS, VERBS

ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"

EV = """
ev AS (SELECT CAST(user_id AS BIGINT) AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(value AS DOUBLE) AS x FROM events),
evr AS (SELECT e, CASE WHEN quantile_cont(x, 0.95) - quantile_cont(x, 0.05) <= 1e-9 THEN 1.0 ELSE quantile_cont(x, 0.95) - quantile_cont(x, 0.05) END AS r FROM ev GROUP BY e),
evd AS (SELECT e, i, (x / r - lag(x / r) OVER (PARTITION BY e ORDER BY i)) * 30.0 AS d FROM ev JOIN evr USING (e)),
sp AS (SELECT e, i - 1 AS i, sqrt(d * d) AS speed FROM evd WHERE i > 0),
ec AS (SELECT CAST(user_id AS BIGINT) AS e, event_type, count(*) AS k FROM events GROUP BY ALL),
ep AS (SELECT e, CAST(sum(k) AS BIGINT) AS length, arg_min(event_type, (-k, event_type)) AS task FROM ec GROUP BY e),
spn AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM sp),
wi AS (SELECT e, i, speed, n, least(n, 90) AS size, unnest(CASE WHEN n < 16 THEN [] WHEN n < 90 THEN [0] ELSE range(0, (n - 90) // 45 + 1) END) AS win FROM spn),
wn AS (SELECT * FROM wi WHERE n < 90 OR (i >= win * 45 AND i < win * 45 + 90)),
wj AS (SELECT *, (speed - 2 * lag(speed, 1) OVER w + lag(speed, 2) OVER w) * 900.0 AS jerk FROM wn WINDOW w AS (PARTITION BY e, win ORDER BY i)),
wl AS (SELECT e, win, max(abs(speed)) AS peak, sum(jerk * jerk) AS j, any_value(size) AS k FROM wj GROUP BY e, win),
wv AS (SELECT e, -ln(pow((k - 1) / 30.0, 3) / (peak * peak) * j / 30.0) AS v FROM wl WHERE peak > 0 AND j > 0),
raw AS (
  SELECT e, 'length_z' AS metric, '' AS signal, length / 30.0::DOUBLE AS value, CAST(NULL AS DOUBLE) AS worst FROM ep
  UNION ALL SELECT e, 'path_length_z', '', sum(speed) / 30.0, NULL FROM sp GROUP BY e
  UNION ALL SELECT e, 'ldlj', 'arm', median(v), quantile_cont(v, 0.05) FROM wv GROUP BY e),
gr AS (SELECT e, CASE WHEN k >= 30 THEN 'task:' || task ELSE '__pooled__' END AS group_label, CASE WHEN k >= 30 THEN 'task' ELSE 'pooled' END AS basis FROM (SELECT *, count(*) OVER (PARTITION BY task) AS k FROM ep)),
val AS (SELECT raw.*, group_label FROM raw JOIN gr USING (e)),
q AS (SELECT group_label, metric, signal, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c, count(*) AS n FROM val GROUP BY ALL),
dv AS (SELECT group_label, metric, signal, median(abs(value - b)) AS mad, median(value - b) FILTER (value > b) AS up, median(b - value) FILTER (value < b) AS down FROM val JOIN q USING (group_label, metric, signal) GROUP BY ALL),
st AS (SELECT group_label, metric, signal, b AS median, mad, CASE WHEN c - b > 0 THEN (c - b) * 1.4826 ELSE coalesce(up / 2, 1e-12) END AS scale_high, CASE WHEN b - a > 0 THEN (b - a) * 1.4826 ELSE coalesce(down / 2, 1e-12) END AS scale_low, n
  FROM q JOIN dv USING (group_label, metric, signal)),
z AS (SELECT e, group_label, metric, signal, value, CASE
    WHEN metric IN ('length_z', 'path_length_z') THEN abs(greatest(least((value - median) / greatest(1.4826 * mad, 0.05 * abs(median), 1e-9), 10), -10))
    WHEN metric = 'ldlj' THEN greatest(least((median - value) / greatest(scale_low, 1e-12), 10), -10) END AS z
  FROM val JOIN st USING (group_label, metric, signal)),
pg AS (SELECT e, CASE WHEN metric = 'ldlj' THEN 0.5 * z ELSE z END AS v, CASE WHEN metric = 'ldlj' THEN 'motion' ELSE 'time' END AS grp FROM z WHERE metric IN ('ldlj', 'length_z')),
ps AS (SELECT e, max(v) AS score, count(*) FILTER (v >= 2) AS n_flags, arg_max(grp, (v, CASE grp WHEN 'motion' THEN 1 ELSE 0 END)) AS driver FROM pg GROUP BY e),
rk AS (SELECT gr.e, group_label, basis, round(score, 6) + 0.0 AS score, coalesce(n_flags, 0) AS n_flags, driver, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 3 THEN 'fail' WHEN score >= 2 THEN 'warn' ELSE 'pass' END AS verdict
  FROM gr LEFT JOIN ps USING (e))
"""

SU = f"""
su AS (SELECT CAST(l_suppkey AS BIGINT) AS e, row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS i, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
sa AS (SELECT e, i, unnest([0, 1, 2, 3]) AS dim, unnest([CAST(l_quantity AS DOUBLE), l_extendedprice, l_discount, l_tax]) AS a FROM su),
fr AS (SELECT *, coalesce(lag(a, 3) OVER w, first_value(a) OVER w) AS s FROM sa WINDOW w AS (PARTITION BY e, dim ORDER BY i)),
rg AS (SELECT e, dim, CASE WHEN quantile_cont(a, 0.95) - quantile_cont(a, 0.05) <= 1e-9 THEN 1.0 ELSE quantile_cont(a, 0.95) - quantile_cont(a, 0.05) END AS ra,
  CASE WHEN quantile_cont(s, 0.95) - quantile_cont(s, 0.05) <= 1e-9 THEN 1.0 ELSE quantile_cont(s, 0.95) - quantile_cont(s, 0.05) END AS rs FROM fr GROUP BY e, dim),
u AS (SELECT fr.*, a / ra AS ua, s / rs AS us FROM fr JOIN rg USING (e, dim)),
meta AS (SELECT CAST(s_suppkey AS BIGINT) AS e, n_name AS source_id, r_name AS task FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

GRIP = """
gu AS (SELECT e, i, (a - min(a) OVER (PARTITION BY e)) / (max(a) OVER (PARTITION BY e) - min(a) OVER (PARTITION BY e)) AS unit, a, s, max(a) OVER (PARTITION BY e) - min(a) OVER (PARTITION BY e) AS span, count(*) OVER (PARTITION BY e) AS n FROM fr WHERE dim = 2),
gs AS (SELECT *, CASE WHEN unit < 0.4 THEN 0 WHEN unit > 0.6 THEN 1 END AS said, CAST(first_value(unit) OVER (PARTITION BY e ORDER BY i) >= 0.5 AS INTEGER) AS f FROM gu WHERE span > 1e-9),
gt AS (SELECT *, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY e ORDER BY i ROWS UNBOUNDED PRECEDING), f) AS state FROM gs),
gb AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY e ORDER BY i), f) AS before FROM gt),
tr AS (SELECT e, i, unit > 0.5 AS high FROM gb WHERE state <> before)
"""

OL = f"""
ol AS (SELECT CAST(l_orderkey AS BIGINT) AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS i, CAST(l_linenumber AS BIGINT) AS fi, CAST(l_quantity AS DOUBLE) AS a0, l_extendedprice AS a1 FROM lineitem)
"""

SHORT = f"""{OL},
oa AS (SELECT e, i, unnest([0, 1]) AS dim, unnest([a0, a1]) AS x FROM ol),
orr AS (SELECT e, dim, CASE WHEN quantile_cont(x, 0.95) - quantile_cont(x, 0.05) <= 1e-9 THEN 1.0 ELSE quantile_cont(x, 0.95) - quantile_cont(x, 0.05) END AS r FROM oa GROUP BY e, dim),
od AS (SELECT e, i, dim, (x / r - lag(x / r) OVER (PARTITION BY e, dim ORDER BY i)) * 30.0 AS d FROM oa JOIN orr USING (e, dim)),
f AS (SELECT e, i - 1 AS i, sqrt(sum(d * d)) AS f FROM od WHERE i > 0 GROUP BY e, i),
p9 AS (SELECT e, quantile_cont(f, 0.9) AS p, count(*) AS n FROM f GROUP BY e),
rf AS (SELECT e, n, coalesce(median(f) FILTER (f > p / 2), any_value(p)) AS ref FROM f JOIN p9 USING (e) GROUP BY e, n),
fl AS (SELECT e, i, n, f, ref, CASE WHEN 0.05 * ref > 0 THEN f < 0.05 * ref ELSE f <= 0 END AS idle FROM f JOIN rf USING (e)),
isl AS (SELECT e, i, n, row_number() OVER (PARTITION BY e ORDER BY i) - row_number() OVER (PARTITION BY e, idle ORDER BY i) AS k, idle FROM fl),
runs AS (SELECT e, min(i) AS start, max(i) + 1 AS stop, any_value(n) AS n FROM isl WHERE idle GROUP BY e, k)
"""

TEXTS = """
tx AS (SELECT 'c-' || conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'p-' || p_partkey, p_name FROM part UNION ALL SELECT 'v-' || p_partkey, 'Picking up the ' || p_name FROM part)
"""


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_LANGUAGE = f"""WITH {TEXTS},
w AS (SELECT id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS t, coalesce(regexp_replace(text, '\\s+', '', 'g'), '') = '' AS blank, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS plain FROM tx),
r AS (SELECT *, CASE WHEN blank THEN NULL WHEN array_to_string(t, ' ') IN {_in(PLACEHOLDERS)} THEN 'placeholder text' WHEN plain AND len(t) < 3 THEN 'fewer than 3 words'
  WHEN plain AND len(list_filter(t, lambda x: x IN {_in(VERBS)} OR (x LIKE '%ing' AND length(x) > 4 AND (x[:-4] IN {_in(VERBS)} OR x[:-4] || 'e' IN {_in(VERBS)} OR (length(x) > 4 AND x[:-5] IN {_in(VERBS)}))))) = 0 THEN 'no action verb' END AS reason FROM w)
SELECT id, CASE WHEN blank THEN 1.0 ELSE 0.0 END::DOUBLE AS task_missing, CASE WHEN blank THEN NULL WHEN reason IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS task_generic, reason FROM r"""

def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


_LAG = f"""WITH {SU},
v AS (SELECT e, dim, i, ua - lag(ua) OVER w AS a, us - lag(us) OVER w AS s FROM u WHERE dim IN (0, 1) WINDOW w AS (PARTITION BY e, dim ORDER BY i)),
c AS (SELECT e, dim, i, a - avg(a) OVER (PARTITION BY e, dim) AS a, s - avg(s) OVER (PARTITION BY e, dim) AS s FROM v WHERE i > 0),
nr AS (SELECT e, dim, sqrt(sum(a * a) * sum(s * s)) AS norm, count(*) AS n FROM c GROUP BY e, dim),
lg AS (SELECT c.e, c.dim, t.lag, sum(c.a * d.s) / any_value(norm) * any_value(n) / (any_value(n) - t.lag) AS k FROM c JOIN nr USING (e, dim) CROSS JOIN (SELECT unnest(range(0, 31)) AS lag) t JOIN c d ON d.e = c.e AND d.dim = c.dim AND d.i = c.i + t.lag
  WHERE norm > 1e-12 AND t.lag <= least(30, n // 3) AND n >= 7 GROUP BY c.e, c.dim, t.lag),
sc AS (SELECT e, lag, avg(k) AS k FROM lg GROUP BY e, lag),
lags AS (SELECT e, arg_max(lag, (k, -lag)) AS lag FROM sc GROUP BY e HAVING max(k) >= 0.3)"""

_ACC = f"""WITH {SU},
ac AS (SELECT e, dim, i - 2 AS i, abs(us - 2 * lag(us, 1) OVER w + lag(us, 2) OVER w) * 900.0 AS acc FROM u WHERE dim IN (0, 1) WINDOW w AS (PARTITION BY e, dim ORDER BY i)),
am AS (SELECT e, dim, median(acc) AS med FROM ac WHERE i >= 0 GROUP BY e, dim),
ad AS (SELECT e, dim, any_value(med) AS med, median(abs(acc - med)) AS mad FROM ac JOIN am USING (e, dim) WHERE i >= 0 GROUP BY e, dim),
spk AS (SELECT e, i, bool_or(acc > greatest(med + 8.0 * 1.4826 * mad, 20.0)) AS spike FROM ac JOIN ad USING (e, dim) WHERE i >= 0 GROUP BY e, i)"""

_AUX = f"""WITH {SU},
nn AS (SELECT e, count(*) AS n, least(count(*), 32) AS k FROM su GROUP BY e HAVING count(*) >= 2),
pk AS (SELECT e, j, CASE WHEN j = k - 1 THEN n - 1 ELSE CAST(floor(j * (CAST(n - 1 AS DOUBLE) / (k - 1))) AS BIGINT) END AS i FROM (SELECT e, n, k, unnest(range(0, k)) AS j FROM nn)),
aux AS (SELECT e, j, list(ua ORDER BY dim) AS a, list(us ORDER BY dim) AS s FROM u JOIN pk USING (e, i) GROUP BY e, j),
ax AS (SELECT aux.*, task, count(DISTINCT e) OVER (PARTITION BY task) AS peers FROM aux JOIN meta USING (e)),
pr AS (SELECT x.e, x.j, y.e AS o, y.j AS oj, list_sum(list_transform(list_zip(x.s, y.s), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d, list_sum(list_transform(list_zip(x.a, y.a), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS g FROM ax x JOIN ax y ON x.task = y.task AND x.e <> y.e WHERE x.peers >= 5),
rn AS (SELECT *, row_number() OVER (PARTITION BY e, j ORDER BY round(d, 9), o, oj) AS r FROM pr)"""

INTEGRITY = f"""WITH {OL}, s AS (SELECT *, fi - lag(fi) OVER (PARTITION BY e ORDER BY i) AS step FROM ol),
p AS (SELECT e, count(*) AS length, count(DISTINCT fi) AS k, min(fi) AS lo, max(fi) AS hi, count(*) FILTER (step < 0) AS ooo, max(abs(step / 30.0::DOUBLE - 1 / 30.0::DOUBLE)) AS dev, CAST(count(*) FILTER (NOT isfinite(a0)) + count(*) FILTER (NOT isfinite(a1)) AS BIGINT) AS bad FROM s GROUP BY e),
g AS (SELECT p.* EXCLUDE (e), coalesce(p.e, CAST(o_orderkey AS BIGINT)) AS e, length - k AS dup, hi - lo + 1 - k AS mis, CAST(lo <> 0 AS BIGINT) AS o, abs(length - (o_custkey % 7 + 1)) AS lm, CAST(length < 10 OR length / 30.0 < 1 AS BIGINT) AS ts FROM p FULL JOIN orders ON o_orderkey = p.e)
SELECT e AS episode_id, dup + mis + ooo + o AS frame_gaps, nullif(concat_ws(', ', CASE WHEN dup > 0 THEN dup || ' duplicated' END, CASE WHEN mis > 0 THEN mis || ' missing' END, CASE WHEN ooo > 0 THEN ooo || ' out of order' END, CASE WHEN o > 0 THEN 'does not start at 0' END), '') AS note,
  {_r('dev', 'timestamp_dev')}, lm AS length_mismatch, bad AS nonfinite_values, ts AS too_short, CASE WHEN length IS NULL THEN 'unknown' WHEN dup + mis + ooo + o > 0 OR coalesce(lm, 0) > 0 OR bad > 0 OR ts > 0 THEN 'fail' ELSE 'pass' END AS verdict,
  concat_ws(',', CASE WHEN dup + mis + ooo + o > 0 THEN 'frame_gaps' END, CASE WHEN lm > 0 THEN 'length_mismatch' END, CASE WHEN bad > 0 THEN 'nonfinite_values' END, CASE WHEN ts > 0 THEN 'too_short' END) AS failing FROM g"""

VW = """
vw AS (SELECT e AS window_id, length, CAST(e % 5 AS DOUBLE) AS from_s, e % 5 + (length + e % 4) / 30.0::DOUBLE AS to_s FROM ep),
vf AS (SELECT e AS window_id, e % 5 + i / 30.0::DOUBLE AS frame_t FROM ev),
st12 AS (SELECT window_id, k, from_s + (to_s - from_s) * (k + 0.5) / 12 AS t FROM vw, (SELECT unnest(range(0, 12)) AS k) WHERE to_s > from_s)
"""

ORACLE: dict[str, str] = {
    "episode_speed": f"WITH {EV} SELECT e AS episode_id, i, {_r('speed', 'speed')} FROM sp",
    "raw_metrics": f"WITH {EV} SELECT e AS episode_id, metric, signal, {_r('value', 'value')}, {_r('worst', 'worst')} FROM raw",
    "groups": f"WITH {EV} SELECT e AS episode_id, group_label, basis FROM gr",
    "norm_stats": f"WITH {EV} SELECT group_label, metric, signal, {_r('median', 'median')}, {_r('mad', 'mad')}, {_r('scale_high', 'scale_high')}, {_r('scale_low', 'scale_low')}, n FROM st",
    "warn_thresholds": f"WITH {EV} SELECT group_label, metric, signal, {_r('CASE WHEN metric = ' + chr(39) + 'ldlj' + chr(39) + ' THEN median - 2 * scale_low ELSE median + 2 * scale_high END', 'warn_at')} FROM st",
    "z_scores": f"WITH {EV} SELECT e AS episode_id, group_label, metric, signal, {_r('value', 'value')}, {_r('z', 'z')} FROM z",
    "event_ranking": f"WITH {EV} SELECT e AS episode_id, group_label, basis, score, n_flags, driver, verdict FROM rk",
    "worst_episodes": f"WITH {EV} SELECT e AS episode_id, score, driver FROM rk ORDER BY score DESC NULLS LAST, e LIMIT 12",
    "verdict_counts": f"WITH {EV} SELECT v.verdict, count(rk.e) AS k FROM (VALUES ('fail'), ('pass'), ('unknown'), ('warn')) v(verdict) LEFT JOIN rk ON rk.verdict = v.verdict GROUP BY v.verdict",
    "score_histogram": f"WITH {EV}, en AS (SELECT min(score) AS a, max(score) AS b FROM ps), bi AS (SELECT least(19, CAST(floor((score - a) / ((b - a) / 20)) AS BIGINT)) AS bin, count(*) AS k FROM ps, en GROUP BY 1) SELECT r.bin, {_r('a + r.bin * (b - a) / 20', 'lo')}, {_r('a + (r.bin + 1) * (b - a) / 20', 'hi')}, coalesce(k, 0) AS k FROM (SELECT unnest(range(0, 20)) AS bin) r CROSS JOIN en LEFT JOIN bi ON bi.bin = r.bin",
    "balance": f"WITH {SU}, n AS (SELECT count(*) AS n FROM meta), b AS (SELECT 'task_key' AS dimension, task AS key, count(*) AS k FROM meta GROUP BY task UNION ALL SELECT 'source_id', source_id, count(*) FROM meta GROUP BY source_id) SELECT dimension, key, k, k < 5 AS under_covered, k > 0.5 * n AS dominant FROM b, n",
    "integrity": INTEGRITY,
    "language": _LANGUAGE,
    "canonical_task": f"""WITH {TEXTS}, o AS (SELECT id, list_transform([translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' Second: task! ', text], lambda t: trim(regexp_replace(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS k FROM tx)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(k, lambda t: t <> ''))), ' | ') AS task_key FROM o""",
    "time_metrics": f"""WITH {SHORT}, pa AS (SELECT e, max(stop - start) AS pause FROM runs WHERE start > 0 AND stop < n GROUP BY e),
t AS (SELECT e, n, min(i) FILTER (NOT idle) AS first, max(i) FILTER (NOT idle) AS last, avg(CAST(idle AS DOUBLE)) AS frac, median(f) FILTER (i >= n - 30) / any_value(CASE WHEN ref > 0 THEN ref END) AS fin FROM fl WHERE n >= 8 GROUP BY e, n),
a AS (SELECT t.*, coalesce(pause, 0) AS pause FROM t LEFT JOIN pa USING (e)),
l AS (SELECT e, 'idle_lead_s' AS metric, coalesce(first, n) / 30.0 AS v FROM a UNION ALL SELECT e, 'idle_trail_s', coalesce(n - 1 - last, n) / 30.0 FROM a UNION ALL SELECT e, 'longest_pause_s', pause / 30.0 FROM a UNION ALL SELECT e, 'idle_frac', frac FROM a UNION ALL SELECT e, 'end_motion_ratio', fin FROM a)
SELECT e AS episode_id, metric, {_r('v', 'value')} FROM l WHERE v IS NOT NULL""",
    "idle_spans": f"WITH {SHORT} SELECT e AS episode_id, start, stop, n FROM runs",
    "temporal_tags": f"WITH {SHORT} SELECT e AS episode_id, CAST(round_even(start / 30.0::DOUBLE * 1e9, 0) AS BIGINT) AS start_ns, greatest(CAST(round_even(stop / 30.0::DOUBLE * 1e9, 0) AS BIGINT), CAST(round_even(start / 30.0::DOUBLE * 1e9, 0) AS BIGINT) + 1) AS end_ns, 'idle:info' AS tag FROM runs",
    "gripper_transitions": f"WITH {SU}, {GRIP} SELECT e AS episode_id, i AS idx, high FROM tr",
    "gripper_flips": f"WITH {SU}, {GRIP}, c AS (SELECT e, count(*) AS k FROM tr GROUP BY e) SELECT DISTINCT gs.e AS episode_id, {_r('coalesce(k, 0) * 30.0 / n', 'value')} FROM gs LEFT JOIN c USING (e)",
    "recoveries": f"""WITH {SU}, {GRIP},
c AS (SELECT a.e, a.i AS c1, (SELECT min(b.i) FROM tr b WHERE b.e = a.e AND b.high AND b.i > a.i) AS o FROM tr a WHERE NOT a.high),
t AS (SELECT c.*, (SELECT min(b.i) FROM tr b WHERE b.e = c.e AND NOT b.high AND b.i > c.o) AS c2 FROM c WHERE o IS NOT NULL),
k AS (SELECT * FROM t WHERE c2 IS NOT NULL AND (o - c1) / 30.0 <= 6 AND (c2 - o) / 30.0 <= 3 AND (c2 - c1) / 30.0 <= 6),
d AS (SELECT k.e, c1, o, c2, sqrt(avg((p.ua - q.ua) * (p.ua - q.ua))) AS d FROM k JOIN u p ON p.e = k.e AND p.i = k.c1 AND p.dim IN (0, 1) JOIN u q ON q.e = k.e AND q.i = k.c2 AND q.dim = p.dim GROUP BY ALL)
SELECT e AS episode_id, c1, o, c2 FROM d WHERE d <= 0.15""",
    "missed_grasps": f"""WITH {SU}, {GRIP},
o AS (SELECT e, median(a - s) AS off FROM gs WHERE unit >= 0.5 GROUP BY e HAVING count(*) >= 3),
c AS (SELECT a.e, a.i + 15 AS j, (SELECT min(b.i) FROM tr b WHERE b.e = a.e AND b.high AND b.i > a.i) AS nx FROM tr a WHERE NOT a.high),
k AS (SELECT c.e, abs((gs.a - gs.s) - off) / span <= 0.1 AS missed FROM c JOIN gs ON gs.e = c.e AND gs.i = c.j JOIN o ON o.e = c.e WHERE c.j < coalesce(c.nx, gs.n))
SELECT e AS episode_id, {_r('avg(CAST(missed AS DOUBLE))', 'value')} FROM k GROUP BY e""",
    "track_lag": f"{_LAG} SELECT e AS episode_id, lag FROM lags",
    "track_resid": f"""{_LAG},
gp AS (SELECT x.e, x.dim, x.ua - y.us AS d FROM u x JOIN lags USING (e) JOIN u y ON y.e = x.e AND y.dim = x.dim AND y.i = x.i + lags.lag WHERE x.dim IN (0, 1)),
gm AS (SELECT e, dim, median(d) AS med FROM gp GROUP BY e, dim)
SELECT e AS episode_id, {_r('avg(abs(d - med))', 'value')} FROM gp JOIN gm USING (e, dim) GROUP BY e""",
    "accel_spikes": f"{_ACC} SELECT e AS episode_id, {_r('avg(CAST(spike AS DOUBLE))', 'value')} FROM spk GROUP BY e",
    "spike_clusters": f"""{_ACC.replace('8.0 * 1.4826', '1.5 * 1.4826').replace('20.0)', '1.0)')}, s AS (SELECT *, avg(CAST(spike AS DOUBLE)) OVER (PARTITION BY e) AS share FROM spk),
n AS (SELECT e, i, CASE WHEN i - lag(i) OVER (PARTITION BY e ORDER BY i) <= 3 THEN 0 ELSE 1 END AS fresh FROM s WHERE spike AND share < 0.3),
k AS (SELECT e, i, sum(fresh) OVER (PARTITION BY e ORDER BY i) AS k FROM n)
SELECT e AS episode_id, {_r('(min(i) + 1) / 30.0', 'start_s')}, {_r('(max(i) + 2) / 30.0', 'end_s')} FROM k WHERE k <= 12 GROUP BY e, k""",
    "joint_limits": f"""WITH {SU}, b AS (SELECT dim, min(s) AS lo, max(s) AS hi FROM fr WHERE dim IN (0, 1) GROUP BY dim),
p AS (SELECT e, dim, max(s) - min(s) AS ptp FROM fr WHERE dim IN (0, 1) GROUP BY e, dim)
SELECT e AS episode_id, {_r('avg(CAST(s <= lo + 0.02 * (hi - lo) OR s >= hi - 0.02 * (hi - lo) AS DOUBLE))', 'value')} FROM fr JOIN b USING (dim) JOIN p USING (e, dim) WHERE hi - lo > 1e-9 AND ptp >= 0.05 * (hi - lo) GROUP BY e""",
    "stats_leverage": f"""WITH {SU}, x AS (SELECT e, 'a' AS v, dim, min(a) AS lo, max(a) AS hi FROM fr GROUP BY e, dim UNION ALL SELECT e, 's', dim, min(s), max(s) FROM fr GROUP BY e, dim),
m AS (SELECT x.*, source_id, count(*) OVER (PARTITION BY source_id, v, dim) AS k FROM x JOIN meta USING (e)),
o AS (SELECT m.e, m.v, m.dim, any_value(m.lo) AS lo, any_value(m.hi) AS hi, min(y.lo) AS olo, max(y.hi) AS ohi FROM m JOIN m y ON y.source_id = m.source_id AND y.v = m.v AND y.dim = m.dim AND y.e <> m.e WHERE m.k >= 3 GROUP BY m.e, m.v, m.dim)
SELECT e AS episode_id, count(*) FILTER (lo < olo - 0.05 * greatest(ohi - olo, 1e-9) OR hi > ohi + 0.05 * greatest(ohi - olo, 1e-9)) AS leverage FROM o GROUP BY e""",
    "action_divergence": f"{_AUX}, pf AS (SELECT e, j, avg(g) AS g FROM rn WHERE r <= 5 GROUP BY e, j) SELECT e AS episode_id, {_r('avg(g)', 'value')} FROM pf GROUP BY e",
    "novelty": f"""WITH p AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
d AS (SELECT a.vec_id AS e, b.vec_id AS o, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY d, o) AS r FROM d) SELECT e AS episode_id, {_r('avg(d)', 'value')} FROM r WHERE r <= 5 GROUP BY e""",
    "camera": f"""WITH p AS (SELECT label AS camera, vec_id AS frame, list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.53) / 1.06 * 256))) AS INTEGER)) AS px FROM embeddings),
c AS (SELECT camera, frame, px, k, k // 8 AS y, k % 8 AS x FROM (SELECT *, unnest(range(0, 64)) AS k FROM p)),
l AS (SELECT camera, frame, px[k + 1] AS v, CAST(px[CASE WHEN y = 0 THEN 1 ELSE y - 1 END * 8 + x + 1] + px[CASE WHEN y = 7 THEN 6 ELSE y + 1 END * 8 + x + 1] + px[y * 8 + CASE WHEN x = 0 THEN 1 ELSE x - 1 END + 1] + px[y * 8 + CASE WHEN x = 7 THEN 6 ELSE x + 1 END + 1] - 4 * px[k + 1] AS DOUBLE) AS lap FROM c),
s AS (SELECT camera, frame, var_pop(lap) AS sharp, abs(avg(v) - 127.5) / 127.5 AS exposure, avg(CAST(v = 0 OR v = 255 AS DOUBLE)) AS clipped FROM l GROUP BY camera, frame)
SELECT camera, {_r('log10(1 + quantile_cont(sharp, 0.1))', 'blur')}, {_r('log10(1 + min(sharp))', 'blur_worst')}, {_r('median(exposure)', 'exposure_err')}, {_r('max(exposure)', 'exposure_worst')}, {_r('avg(clipped)', 'clipped_frac')}, {_r('max(clipped)', 'clipped_worst')} FROM s GROUP BY camera""",
    "wide_results": f"WITH {EV} SELECT e AS episode_id, {_r('max(value) FILTER (metric = ' + chr(39) + 'ldlj' + chr(39) + ')', 'q_ldlj')}, {_r('max(value) FILTER (metric = ' + chr(39) + 'length_z' + chr(39) + ')', 'q_length_z')}, {_r('max(value) FILTER (metric = ' + chr(39) + 'path_length_z' + chr(39) + ')', 'q_path_length_z')} FROM raw GROUP BY e",
    "upsert": f"""WITH {EV}, w AS (SELECT e, max(value) FILTER (metric = 'ldlj') AS l, max(value) FILTER (metric = 'length_z') AS n, max(value) FILTER (metric = 'path_length_z') AS p FROM raw GROUP BY e)
SELECT w.e AS episode_id, {_r('n', 'q_length_z')}, {_r('CASE WHEN basis = ' + chr(39) + 'pooled' + chr(39) + ' THEN NULL ELSE p END', 'q_path_length_z')}, {_r('CASE WHEN basis = ' + chr(39) + 'pooled' + chr(39) + ' THEN l END', 'q_ldlj')} FROM w JOIN gr USING (e)""",
    "majority_schema": f"WITH {EV}, s AS (SELECT e, CASE WHEN length % 10 = 0 THEN '50 fps' ELSE '30 fps' END AS sig FROM ep), c AS (SELECT sig, count(*) AS k FROM s GROUP BY sig), t AS (SELECT arg_min(sig, (-k, sig)) AS main, max(k) / sum(k) AS share FROM c) SELECT e AS episode_id, CAST(share >= 0.5 AND sig <> main AS BIGINT) AS mismatch, share < 0.5 AS mixed FROM s, t",
    "sparc": f"""WITH {SU},
dd AS (SELECT e, dim, i, (ua - lag(ua) OVER (PARTITION BY e, dim ORDER BY i)) * 30.0 AS d FROM u WHERE dim IN (0, 1)),
ss AS (SELECT e, i - 1 AS i, sqrt(sum(d * d)) AS s FROM dd WHERE i > 0 GROUP BY e, i),
sn AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM ss),
w AS (SELECT e, i, s, n, unnest(CASE WHEN n < 16 THEN [] WHEN n < 90 THEN [0] ELSE range(0, (n - 90) // 45 + 1) END) AS win FROM sn),
x AS (SELECT e, win, i - win * 45 AS t, s, least(n, 90) AS size FROM w WHERE n < 90 OR (i >= win * 45 AND i < win * 45 + 90)),
l AS (SELECT e, win, list(s ORDER BY t) AS s, CAST(pow(2, ceil(log2(any_value(size))) + 4) AS BIGINT) AS nfft FROM x GROUP BY e, win),
b AS (SELECT e, win, nfft, s, unnest(range(0, CAST(floor(10.0 * nfft / 30.0) AS BIGINT) + 1)) AS k FROM l),
m AS (SELECT e, win, k, k * 30.0 / nfft AS f, sqrt(pow(list_sum(list_transform(s, lambda v, t: v * cos(2 * pi() * k * (t - 1) / nfft))), 2) + pow(list_sum(list_transform(s, lambda v, t: v * sin(2 * pi() * k * (t - 1) / nfft))), 2)) / list_sum(s) AS a FROM b),
h AS (SELECT e, win, max(k) AS hi FROM m WHERE a >= 0.05 GROUP BY e, win),
g AS (SELECT m.e, m.win, f, a, lag(f) OVER q AS pf, lag(a) OVER q AS pa, max(f) OVER (PARTITION BY m.e, m.win) AS top FROM m JOIN h ON h.e = m.e AND h.win = m.win AND m.k <= h.hi WINDOW q AS (PARTITION BY m.e, m.win ORDER BY m.k)),
v AS (SELECT e, win, -sum(sqrt(pow((f - pf) / top, 2) + pow(a - pa, 2))) AS v FROM g WHERE pf IS NOT NULL GROUP BY e, win)
SELECT e AS episode_id, {_r('median(v)', 'value')}, {_r('quantile_cont(v, 0.05)', 'worst')} FROM v GROUP BY e""",
    "length_control": f"""WITH {EV}, c AS (SELECT e, i, x FROM (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM ev) WHERE n > 54 AND i < 54),
r2 AS (SELECT e, CASE WHEN quantile_cont(x, 0.95) - quantile_cont(x, 0.05) <= 1e-9 THEN 1.0 ELSE quantile_cont(x, 0.95) - quantile_cont(x, 0.05) END AS r FROM c GROUP BY e),
d2 AS (SELECT e, i, abs(x / r - lag(x / r) OVER (PARTITION BY e ORDER BY i)) AS d FROM c JOIN r2 USING (e)),
b AS (SELECT e, round(sum(d), 6) AS b FROM d2 WHERE i > 0 GROUP BY e),
p AS (SELECT round(value, 6) AS a, b FROM raw JOIN b USING (e) WHERE metric = 'path_length_z'),
ra AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM p)
SELECT 'path_length_z' AS metric, {_r('corr(x, y)', 'rho')} FROM ra""",
    "corruption_idle_start": f"""WITH {EV},
c AS (SELECT e, i + 60 AS i, x FROM ev UNION ALL SELECT e, k AS i, x FROM (SELECT e, x, unnest(range(0, 60)) AS k FROM ev WHERE i = 0)),
r2 AS (SELECT e, CASE WHEN quantile_cont(x, 0.95) - quantile_cont(x, 0.05) <= 1e-9 THEN 1.0 ELSE quantile_cont(x, 0.95) - quantile_cont(x, 0.05) END AS r FROM c GROUP BY e),
d2 AS (SELECT e, i, abs(x / r - lag(x / r) OVER (PARTITION BY e ORDER BY i)) AS d FROM c JOIN r2 USING (e)),
b AS (SELECT e, 'path_length_z' AS metric, sum(d) AS b FROM d2 WHERE i > 0 GROUP BY e UNION ALL SELECT e, 'length_z', count(*) / 30.0::DOUBLE FROM c GROUP BY e),
p AS (SELECT metric, value AS a, b FROM raw JOIN b USING (e, metric))
SELECT metric, count(*) AS pairs, count(*) FILTER (b > a) AS worse, {_r('avg(CAST(b > a AS DOUBLE))', 'pass_rate')} FROM p GROUP BY metric""",
    "sample_times": f"WITH {EV}, {VW} SELECT window_id, CAST(k AS BIGINT) AS k, {_r('t', 't')} FROM st12",
    "frames_at": f"""WITH {EV}, {VW} SELECT window_id, CAST(k AS BIGINT) AS k, {_r('t', 't')}, {_r('coalesce((SELECT min(frame_t) FROM vf WHERE vf.window_id = s.window_id AND frame_t >= s.t - 1e-3), (SELECT max(frame_t) FROM vf WHERE vf.window_id = s.window_id))', 'frame_t')} FROM st12 s WHERE s.window_id IN (SELECT window_id FROM vf)""",
    "bursts": f"""WITH {EV}, {VW}, b AS (SELECT window_id, to_s, from_s + (to_s - from_s) * (k + 0.5) / 6 AS start FROM vw, (SELECT unnest(range(0, 6)) AS k)),
r AS (SELECT window_id, start, frame_t, row_number() OVER (PARTITION BY window_id, start ORDER BY frame_t) AS r FROM b JOIN vf USING (window_id) WHERE frame_t >= start - 1e-3 AND frame_t < to_s)
SELECT window_id, {_r('start', 'start')}, r, {_r('frame_t', 'frame_t')} FROM r WHERE r <= 6""",
    "video_window_mismatch": f"""WITH {EV}, {VW}, c AS (SELECT window_id AS e, length, 'front' AS camera, to_s - from_s AS w FROM vw UNION ALL SELECT window_id, length, 'wrist', to_s + CASE WHEN window_id % 3 = 0 THEN 0.5 ELSE 0 END - from_s FROM vw),
g AS (SELECT e, camera, abs(w - length / 30.0::DOUBLE) * 30.0 AS gap FROM c) SELECT e AS episode_id, {_r('max(gap)', 'value')}, arg_min(camera, (-gap, camera)) AS camera FROM g GROUP BY e""",
    "best_lag": f"""WITH {SU}, p AS (SELECT e, i, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS x, (s - avg(s) OVER w) / stddev_pop(s) OVER w AS y, count(*) OVER w AS n FROM fr WHERE dim = 0 WINDOW w AS (PARTITION BY e)),
c AS (SELECT x.e, k, sum(x.x * y.y) / (any_value(x.n) - abs(k)) AS c FROM p x CROSS JOIN (SELECT unnest(range(-30, 31)) AS k) JOIN p y ON y.e = x.e AND y.i = x.i + k WHERE abs(k) <= least(30, x.n // 3) GROUP BY x.e, k),
n AS (SELECT *, lag(c) OVER w AS l, lead(c) OVER w AS r FROM c WINDOW w AS (PARTITION BY e ORDER BY k)),
b AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY c DESC, k) AS q FROM n)
SELECT e AS episode_id, {_r('k + coalesce(CASE WHEN l - 2 * c + r < 0 THEN greatest(least(0.5 * (l - r) / (l - 2 * c + r), 0.5), -0.5) ELSE 0 END, 0)', 'lag')}, {_r('c', 'corr')} FROM b WHERE q = 1 AND c >= 0.3""",
    "trace": f"WITH {SU}, n AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM su) SELECT e AS episode_id, i AS idx, round(CAST(l_quantity AS DOUBLE), 4) AS a0, round(l_extendedprice, 4) AS a1, round(l_discount, 4) AS a2, round(l_tax, 4) AS a3 FROM n WHERE i % greatest(1, CAST(ceil(n / 400.0) AS BIGINT)) = 0",
    "aux_sample": f"{_AUX} SELECT e AS episode_id, j, " + ", ".join(_r(f"{v[0]}[{i + 1}]", f"{v}{i}") for v in ("action", "state") for i in range(4)) + " FROM aux",
    "gripper_phases": f"""WITH {SU}, {GRIP}, dd AS (SELECT e, dim, i, (ua - lag(ua) OVER (PARTITION BY e, dim ORDER BY i)) * 30.0 AS d FROM u WHERE dim IN (0, 1)),
ss AS (SELECT e, i - 1 AS i, sqrt(sum(d * d)) AS s FROM dd WHERE i > 0 GROUP BY e, i),
ph AS (SELECT ss.e, ss.i, s, count(tr.i) OVER (PARTITION BY ss.e ORDER BY ss.i) AS phase FROM ss LEFT JOIN tr ON tr.e = ss.e AND tr.i = ss.i)
SELECT e AS episode_id, phase, min(i) AS start, count(*) AS n, {_r('sum(s) / 30.0', 'path')} FROM ph GROUP BY e, phase""",
    "outlier_flags": f"""WITH p AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
d AS (SELECT a.label, a.vec_id AS e, b.vec_id AS o, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY d, o) AS r FROM d), v AS (SELECT label, e, avg(d) AS v FROM r WHERE r <= 5 GROUP BY label, e),
q AS (SELECT label, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM v GROUP BY label), u AS (SELECT label, median(v - b) AS up FROM v JOIN q USING (label) WHERE v > b GROUP BY label),
z AS (SELECT e, label, greatest(least((v - b) / CASE WHEN c > b THEN (c - b) * 1.4826 ELSE coalesce(up / 2, 1e-12) END, 10), -10) AS z FROM v JOIN q USING (label) LEFT JOIN u USING (label))
SELECT e AS episode_id, CAST(label AS VARCHAR) AS group_label, {_r('z', 'z')}, z >= 2 AS is_outlier FROM z""",
    "panel_summary": f"WITH {EV} SELECT task AS task_key, count(*) AS episodes, {_r('avg(score)', 'mean_score')}, count(*) FILTER (verdict <> 'pass') AS flagged, count(*) FILTER (basis = 'pooled') AS pooled FROM rk JOIN ep USING (e) GROUP BY task",
    "flag_false_alarms": "WITH i AS (" + INTEGRITY + ") " + " UNION ALL ".join(f"SELECT '{c}' AS metric, {_r(f'avg(CAST({c} > 0 AS DOUBLE))', 'rate')} FROM i" for c in ("frame_gaps", "length_mismatch", "nonfinite_values", "too_short")),
}

_SPEED = """
dd AS (SELECT e, dim, i, (ua - lag(ua) OVER (PARTITION BY e, dim ORDER BY i)) * 30.0 AS d FROM u WHERE dim IN (0, 1)),
ss AS (SELECT e, i - 1 AS i, sqrt(sum(d * d)) AS s FROM dd WHERE i > 0 GROUP BY e, i),
sn AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM ss)
"""

_LDLJ = f"""WITH {SU}, {_SPEED},
w AS (SELECT e, i, s, n, least(n, 90) AS size, unnest(CASE WHEN n < 16 THEN [] WHEN n < 90 THEN [0] ELSE range(0, (n - 90) // 45 + 1) END) AS win FROM sn),
x AS (SELECT * FROM w WHERE n < 90 OR (i >= win * 45 AND i < win * 45 + 90)),
j AS (SELECT *, (s - 2 * lag(s, 1) OVER q + lag(s, 2) OVER q) * 900.0 AS jerk FROM x WINDOW q AS (PARTITION BY e, win ORDER BY i)),
l AS (SELECT e, win, max(abs(s)) AS peak, sum(jerk * jerk) AS j, any_value(size) AS k FROM j GROUP BY e, win),
v AS (SELECT e, -ln(pow((k - 1) / 30.0, 3) / (peak * peak) * j / 30.0) AS v FROM l WHERE peak > 0 AND j > 0)
SELECT e AS episode_id, {_r('median(v)', 'value')} FROM v GROUP BY e"""


def _ranked(metric: str, query: str, signal: str = "") -> str:
    return f"SELECT episode_id AS e, '{metric}' AS metric, '{signal}' AS signal, value FROM ({query})"


# a ranking's peers share the normalisation group, not only the task
_AMONG_LABELS = ORACLE["action_divergence"].replace("FROM aux JOIN meta USING (e))", "FROM aux JOIN (SELECT e, CASE WHEN count(*) OVER (PARTITION BY task) >= 15 THEN task ELSE '__pooled__' END AS task FROM meta) USING (e))")

RANKING = f"""
raw AS ({' UNION ALL '.join([
    _ranked('sparc', ORACLE['sparc'], 'arm_right'),
    _ranked('ldlj', _LDLJ, 'arm_right'),
    _ranked('length_z', "SELECT CAST(l_suppkey AS BIGINT) AS episode_id, round(count(*) / 30.0::DOUBLE, 6) AS value FROM lineitem GROUP BY l_suppkey"),
    _ranked('track_resid', ORACLE['track_resid'], 'arm_right'),
    _ranked('accel_spike_frac', ORACLE['accel_spikes']),
    _ranked('joint_limit_frac', ORACLE['joint_limits']),
    _ranked('gripper_flips_per_s', ORACLE['gripper_flips'], 'gripper_right'),
    _ranked('missed_grasp_frac', ORACLE['missed_grasps'], 'arm_right'),
    _ranked('action_divergence', _AMONG_LABELS),
])}),
meta AS (SELECT CAST(s_suppkey AS BIGINT) AS e, r_name AS task FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
gr AS (SELECT e, task, CASE WHEN k >= 15 THEN 'task:' || task ELSE '__pooled__' END AS group_label, CASE WHEN k >= 15 THEN 'task' ELSE 'pooled' END AS basis FROM (SELECT *, count(*) OVER (PARTITION BY task) AS k FROM meta)),
val AS (SELECT raw.*, group_label FROM raw JOIN gr USING (e)),
q AS (SELECT group_label, metric, signal, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM val GROUP BY ALL),
dv AS (SELECT group_label, metric, signal, median(abs(value - b)) AS mad, median(value - b) FILTER (value > b) AS up, median(b - value) FILTER (value < b) AS down FROM val JOIN q USING (group_label, metric, signal) GROUP BY ALL),
st AS (SELECT group_label, metric, signal, b AS median, mad, CASE WHEN c - b > 0 THEN (c - b) * 1.4826 ELSE coalesce(up / 2, 1e-12) END AS high, CASE WHEN b - a > 0 THEN (b - a) * 1.4826 ELSE coalesce(down / 2, 1e-12) END AS low
  FROM q JOIN dv USING (group_label, metric, signal)),
z AS (SELECT e, group_label, metric, signal, value, greatest(least(CASE
    WHEN metric = 'length_z' THEN abs((value - median) / greatest(1.4826 * mad, 0.05 * abs(median), 1e-9))
    WHEN metric IN ('sparc', 'ldlj') THEN (median - value) / greatest(low, 1e-12) ELSE (value - median) / greatest(high, 1e-12) END, 10), -10) AS z
  FROM val JOIN st USING (group_label, metric, signal)),
mem(metric, grp, weight, ordinal) AS (VALUES ('sparc', 'motion', 1.0, 0), ('ldlj', 'motion', 0.5, 0), ('length_z', 'time', 1.0, 1), ('track_resid', 'tracking', 1.0, 2), ('accel_spike_frac', 'tracking', 1.0, 2), ('joint_limit_frac', 'tracking', 1.0, 2), ('gripper_flips_per_s', 'gripper', 1.0, 3), ('missed_grasp_frac', 'gripper', 1.0, 3), ('action_divergence', 'consistency', 1.0, 4)),
pg AS (SELECT e, grp, ordinal, max(CAST(weight AS DOUBLE) * z) AS v FROM z JOIN mem USING (metric) GROUP BY ALL),
ps AS (SELECT e, max(v) AS score, count(*) FILTER (v >= 2) AS n_flags, arg_max(grp, (v, -ordinal)) AS driver FROM pg GROUP BY e),
rk AS (SELECT gr.e, group_label, basis, score, coalesce(n_flags, 0) AS n_flags, driver, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 3 THEN 'fail' WHEN score >= 2 THEN 'warn' ELSE 'pass' END AS verdict FROM gr LEFT JOIN ps USING (e))
"""

_RANKED = ["sparc", "ldlj", "length_z", "track_resid", "accel_spike_frac", "joint_limit_frac", "gripper_flips_per_s", "missed_grasp_frac", "action_divergence"]
_SIGNALS = ["arm_right", "gripper_right"]

_ARCS = ORACLE["sparc"][: ORACLE["sparc"].rindex("SELECT e AS episode_id")]
_SPIKES = ORACLE["spike_clusters"].replace("1.5 * 1.4826", "8.0 * 1.4826").replace("1.0)) AS spike", "20.0)) AS spike")
_MOTION_SPANS = f"""
SELECT episode_id, {_r('start_s', 'start_s')}, {_r('end_s', 'end_s')}, label, kind FROM (
  SELECT e AS episode_id, win * 45 / 30.0::DOUBLE AS start_s, (win * 45 + least(n, 90)) / 30.0::DOUBLE AS end_s, 'roughest window (arm_right)' AS label, 'rough' AS kind FROM (SELECT e, arg_min(win, (v, win)) AS win FROM ({_ARCS} SELECT e, win, v FROM v) GROUP BY e) JOIN (SELECT CAST(l_suppkey AS BIGINT) AS e, count(*) - 1 AS n FROM lineitem GROUP BY ALL) USING (e)
  UNION ALL SELECT episode_id, start_s, end_s, 'acceleration spike', 'spike' FROM ({_SPIKES})
  UNION ALL SELECT episode_id, c1 / 30.0::DOUBLE, c2 / 30.0::DOUBLE, 'regrasp recovery', 'recovery' FROM ({ORACLE['recoveries']}))"""

ORACLE |= {
    "quality_ranking": f"WITH {RANKING} SELECT e AS episode_id, group_label, basis, {_r('score', 'score')}, n_flags, driver, verdict, '' AS failed FROM rk",
    "ranking_signals": f"WITH {RANKING} SELECT e AS episode_id, group_label, metric, signal, {_r('z', 'z')}, {_r('value', 'value')} FROM z",
    "metric_rows": f"WITH {RANKING} SELECT e AS episode_id, metric, {_r('value', 'value')}, {_r('z', 'z')}, CASE WHEN signal = '' THEN '' ELSE signal || '=' || CAST(round(value * 1000) AS BIGINT) END AS breakdown FROM z",
    "present_signals": f"WITH {RANKING} SELECT metric, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM raw WHERE signal <> '' GROUP BY metric",
    "first_task": f"WITH {EV} SELECT e AS episode_id, length, task AS task_key FROM ep WHERE task = (SELECT min(task) FROM ep)",
    "family_scores": f"WITH {RANKING} SELECT e AS episode_id, grp AS family, {_r('max(z)', 'score')}, count(*) FILTER (z >= 2) AS n_flags FROM z JOIN mem USING (metric) GROUP BY e, grp",
    "feature_matrix": f"WITH {RANKING}, p AS (SELECT group_label, e, " + ", ".join(f"max(z) FILTER (metric = '{x}') AS {x}" for x in _RANKED) + " FROM z GROUP BY ALL) SELECT group_label AS grp, e AS episode_id, " + ", ".join(_r(f"coalesce({x}, median({x}) OVER (PARTITION BY group_label), 0)", x) for x in _RANKED) + " FROM p",
    "flat_results": f"WITH {RANKING}, wo AS (SELECT e, 'sparc' AS metric, worst FROM (SELECT episode_id AS e, worst FROM ({ORACLE['sparc']})) UNION ALL SELECT e, 'ldlj', round(quantile_cont(v, 0.05), 6) FROM ({_LDLJ[: _LDLJ.rindex('SELECT e AS episode_id')]} SELECT e, v FROM v) GROUP BY e), "
    + "zz AS (SELECT z.*, worst FROM z LEFT JOIN wo USING (e, metric)) SELECT e AS episode_id, "
    + ", ".join(f"{_r(f'max(value) FILTER (metric = {chr(39)}{x}{chr(39)})', f'q_{x}')}, nullif(max(signal) FILTER (metric = '{x}'), '') AS q_{x}_signal, {_r(f'max(worst) FILTER (metric = {chr(39)}{x}{chr(39)})', f'q_{x}_worst')}, {_r(f'max(z) FILTER (metric = {chr(39)}{x}{chr(39)})', f'q_{x}_z')}, " + ", ".join(_r(f"max(value) FILTER (metric = '{x}' AND signal = '{g}')", f"q_{x}_on_{g}") for g in _SIGNALS) for x in _RANKED)
    + " FROM zz GROUP BY e",
    "recovery_count": f"WITH r AS ({ORACLE['recoveries']}) SELECT CAST(s_suppkey AS BIGINT) AS episode_id, CAST(count(c1) AS DOUBLE) AS value FROM supplier LEFT JOIN r ON r.episode_id = s_suppkey GROUP BY s_suppkey",
    "pauses": f"""WITH {SU}, {_SPEED}, p9 AS (SELECT e, quantile_cont(s, 0.9) AS p FROM ss GROUP BY e),
rf AS (SELECT e, coalesce(median(s) FILTER (s > p / 2), any_value(p)) AS ref FROM ss JOIN p9 USING (e) GROUP BY e),
fl AS (SELECT e, i, n, CASE WHEN 0.05 * ref > 0 THEN s < 0.05 * ref ELSE s <= 0 END AS idle FROM sn JOIN rf USING (e)),
isl AS (SELECT e, i, n, idle, row_number() OVER (PARTITION BY e ORDER BY i) - row_number() OVER (PARTITION BY e, idle ORDER BY i) AS k FROM fl),
runs AS (SELECT e, min(i) AS start, max(i) + 1 AS stop, any_value(n) AS n FROM isl WHERE idle GROUP BY e, k),
rec AS ({ORACLE['recoveries']})
SELECT e AS episode_id, start, stop, n FROM runs WHERE start > 0 AND stop < n AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.episode_id = runs.e AND runs.start < rec.c2 + 30 AND runs.stop > rec.c1 - 30)""",
    "motion_spans": _MOTION_SPANS,
    "span_severity": f"""WITH {RANKING}, ms AS ({_MOTION_SPANS}), kz AS (SELECT e AS episode_id, CASE metric WHEN 'sparc' THEN 'rough' ELSE 'spike' END AS kind, max(round(z, 6)) AS z FROM z WHERE metric IN ('sparc', 'accel_spike_frac') GROUP BY ALL)
SELECT ms.episode_id, start_s, end_s, label, ms.kind, CASE WHEN ms.kind = 'recovery' THEN 'info' WHEN z >= 3 THEN 'fail' ELSE 'warn' END AS severity FROM ms LEFT JOIN kz ON kz.episode_id = ms.episode_id AND kz.kind = ms.kind WHERE ms.kind = 'recovery' OR z >= 2""",
    "integrity_review": f"SELECT episode_id, verdict, failing FROM ({INTEGRITY}) ORDER BY CASE verdict WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, episode_id",
    "top_tasks": "SELECT event_type AS task_key, count(DISTINCT user_id) AS k FROM events GROUP BY event_type ORDER BY k DESC, task_key LIMIT 12",
    "language_verdict": f"SELECT CASE WHEN coalesce(task_missing, 0) > 0 OR coalesce(task_generic, 0) > 0 THEN 'warn' ELSE 'pass' END AS verdict, reason, count(*) AS k FROM ({_LANGUAGE}) GROUP BY ALL",
    "dense_steps": f"""WITH {EV}, {VW}, c AS (SELECT window_id, from_s + greatest((to_s - from_s - 1) / 2, 0) AS a, to_s - greatest((to_s - from_s - 1) / 2, 0) AS b FROM vw),
r AS (SELECT window_id, frame_t, row_number() OVER (PARTITION BY window_id ORDER BY frame_t) - 1 AS q FROM c JOIN vf USING (window_id) WHERE frame_t >= a - 1e-3 AND frame_t < b - 1e-3)
SELECT window_id, q // 3 AS r, {_r('frame_t', 'frame_t')} FROM r WHERE q % 3 = 0""",
    "resampled": f"WITH {EV}, n AS (SELECT e, i, x, lead(x) OVER (PARTITION BY e ORDER BY i) AS y FROM ev) SELECT e AS episode_id, i + 0.5::DOUBLE AS t, {_r('(x + y) / 2', 'v')} FROM n WHERE y IS NOT NULL",
    "frame_changes": f"""WITH p AS (SELECT label AS camera, vec_id AS t, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000000) AS BIGINT)) AS x, lag(list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000000) AS BIGINT))) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings)
SELECT camera, t, CAST(list_sum(list_transform(list_zip(x, y), lambda q: abs(q[1] - q[2]))) // len(x) AS BIGINT) AS v FROM p WHERE y IS NOT NULL""",
    "tag_selection": "WITH b AS (SELECT arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders GROUP BY o_custkey) SELECT CAST(o_orderkey AS BIGINT) AS episode_id, CASE WHEN k IS NULL THEN o_orderpriority ELSE array_to_string(list_sort([o_orderpriority, 'largest']), ',') END AS tags FROM orders LEFT JOIN b ON k = o_orderkey",
}

ORACLE["flag_states"] = """
WITH n AS (SELECT CAST(l_suppkey AS BIGINT) AS e, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT CAST(s_suppkey AS BIGINT) AS e FROM supplier)
SELECT e AS episode_id, unnest(['frame_gaps', 'timestamp_dev', 'length_mismatch', 'video_window_mismatch', 'nonfinite_values', 'too_short', 'schema_mismatch']) AS metric,
  unnest([0.0, 0.0, 0.0, 0.0, 0.0, CAST(n < 10 OR n / 30.0 < 1 AS DOUBLE), 0.0]::DOUBLE[]) AS value FROM n
UNION ALL SELECT e, unnest(['task_missing', 'task_generic']), 0.0 FROM s"""

_TWO = f"""WITH {RANKING}, p2 AS (SELECT e, grp, ordinal, max(CASE WHEN metric = 'sparc' THEN 2.0 ELSE CAST(weight AS DOUBLE) END * z) AS v FROM z JOIN mem USING (metric) WHERE grp IN ('motion', 'time') GROUP BY ALL),
s2 AS (SELECT e, max(v) AS score, count(*) FILTER (v >= 2) AS n_flags, arg_max(grp, (v, -ordinal)) AS driver FROM p2 GROUP BY e),
r2 AS (SELECT gr.e, score, coalesce(n_flags, 0) AS n_flags, driver, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 3 THEN 'fail' WHEN score >= 2 THEN 'warn' ELSE 'pass' END AS verdict FROM gr LEFT JOIN s2 USING (e))"""
ORACLE |= {
    "profile_scores": f"{_TWO} SELECT e AS episode_id, 'policy' AS profile, {_r('score', 'score')}, n_flags, driver, verdict FROM rk UNION ALL SELECT e, 'moves', {_r('score', 'score')}, n_flags, driver, verdict FROM r2",
    "result_rows": f"""{_TWO}, n AS (SELECT CAST(l_suppkey AS BIGINT) AS e, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT rk.e AS episode_id, rk.group_label, rk.basis AS group_basis, count(*) OVER (PARTITION BY rk.group_label) AS group_n, CAST(1 AS BIGINT) AS config_version, {_r('rk.score', 'score_policy')}, rk.n_flags AS nflags_policy, rk.driver AS driver_policy, rk.verdict AS verdict_policy,
  {_r('r2.score', 'score_moves')}, r2.n_flags AS nflags_moves, r2.driver AS driver_moves, r2.verdict AS verdict_moves, CASE WHEN n IS NULL THEN 'unknown' WHEN n < 30 THEN 'fail' ELSE 'pass' END AS integrity_verdict, 'pass' AS language_verdict, '' AS frame_gaps_note, '' AS task_generic_note, '' AS failed FROM rk JOIN r2 USING (e) LEFT JOIN n USING (e)""",
    "family_review": f"WITH {RANKING}, f AS (SELECT e AS episode_id, grp AS family, round(max(z), 6) AS score, count(*) FILTER (z >= 2) AS n_flags FROM z JOIN mem USING (metric) GROUP BY e, grp) SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, episode_id) AS place FROM f",
    "language_review": f"SELECT id, CASE WHEN coalesce(task_missing, 0) > 0 OR coalesce(task_generic, 0) > 0 THEN 'warn' ELSE 'pass' END AS verdict, coalesce(reason, '') AS reason FROM ({_LANGUAGE})",
}
