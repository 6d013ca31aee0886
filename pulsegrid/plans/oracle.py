"""The registered queries in DuckDB's SQL, written apart from the operators: joins and list functions where those use array columns."""

from __future__ import annotations

T, W, DUR, FPS = 60, 15, 6.0, 10.0
PIX = "recording_id, pixel_id"


def grid(by_type: bool = False) -> str:
    rec = "event_type" if by_type else "'events'"
    return f"""
ev AS (SELECT {rec} AS recording_id, CAST(user_id AS INTEGER) AS pixel_id, CAST(epoch_us(ts) // 43200000000 - 39446 AS INTEGER) AS t, avg(value) AS v FROM events GROUP BY ALL),
px AS (SELECT DISTINCT recording_id, pixel_id FROM ev),
s AS (SELECT px.recording_id, px.pixel_id, CAST(f.t AS INTEGER) AS t, f.t * {DUR} / {T - 1} AS time_s, coalesce(ev.v, 0.0) AS v
  FROM px CROSS JOIN (SELECT unnest(range({T})) AS t) f LEFT JOIN ev ON ev.recording_id = px.recording_id AND ev.pixel_id = px.pixel_id AND ev.t = f.t),
p AS (SELECT recording_id, pixel_id, list(v ORDER BY t) AS v FROM s GROUP BY ALL)"""


# lists count from 1 in this SQL, frames from 0
RUNS = """
runs AS (SELECT recording_id, pixel_id, grp, min(t) AS a, max(t) AS b, any_value(v) AS v FROM (
  SELECT *, sum(step) OVER (PARTITION BY recording_id, pixel_id ORDER BY t) AS grp FROM (
    SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY recording_id, pixel_id ORDER BY t) THEN 0 ELSE 1 END AS step FROM {src})) GROUP BY ALL),
near AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM runs WINDOW w AS (PARTITION BY recording_id, pixel_id ORDER BY a)),
maxima AS (SELECT recording_id, pixel_id, (a + b) // 2 AS t, v FROM near WHERE before < v AND after < v),
minima AS (SELECT recording_id, pixel_id, (a + b) // 2 AS t, v FROM near WHERE before > v AND after > v)"""

PROMINENCES = """
sides AS (SELECT m.recording_id, m.pixel_id, m.t, m.v,
    coalesce(max(s.t) FILTER (WHERE s.t < m.t AND s.v > m.v), -1) AS l, coalesce(min(s.t) FILTER (WHERE s.t > m.t AND s.v > m.v), 1000000) AS r
  FROM maxima m JOIN {src} s USING (recording_id, pixel_id) GROUP BY ALL),
prominences AS (SELECT d.recording_id, d.pixel_id, d.t, d.v, d.v - greatest(min(s.v) FILTER (WHERE s.t > d.l AND s.t <= d.t), min(s.v) FILTER (WHERE s.t >= d.t AND s.t < d.r)) AS prominence
  FROM sides d JOIN {src} s USING (recording_id, pixel_id) GROUP BY d.recording_id, d.pixel_id, d.t, d.v)"""

MASK = """
pm AS (SELECT recording_id, pixel_id, var_pop(v) AS pulsatility FROM s GROUP BY ALL),
bd AS (SELECT recording_id, min(pulsatility) AS lo, max(pulsatility) AS hi, quantile_cont(pulsatility, 0.65) AS p65 FROM pm GROUP BY ALL),
hist AS (SELECT recording_id, least(CAST(floor((pulsatility - lo) / ((hi - lo) / 256)) AS INTEGER), 255) AS bin, lo, hi, count(*) AS n FROM pm JOIN bd USING (recording_id) WHERE hi > lo GROUP BY ALL),
cs AS (SELECT recording_id, bin, lo + (bin + 0.5) * ((hi - lo) / 256) AS c, sum(n) OVER u AS w1, sum(n) OVER d AS w2,
    sum(n * (lo + (bin + 0.5) * ((hi - lo) / 256))) OVER u AS s1, sum(n * (lo + (bin + 0.5) * ((hi - lo) / 256))) OVER d AS s2
  FROM hist WINDOW u AS (PARTITION BY recording_id ORDER BY bin), d AS (PARTITION BY recording_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ot AS (SELECT recording_id, c AS otsu FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(w1 * w2 * (s1 / w1 - s2 / w2) ^ 2, 9) DESC, bin) AS k FROM cs WHERE w2 > 0) WHERE k = 1),
fr AS (SELECT recording_id, avg(CAST(pulsatility > otsu AS DOUBLE)) AS share FROM pm LEFT JOIN ot USING (recording_id) GROUP BY ALL),
mask AS (SELECT pm.recording_id, pm.pixel_id, pulsatility,
    pulsatility > CASE WHEN hi - lo < 1e-10 OR otsu IS NULL OR share < 0.03 OR share > 0.85 THEN p65 ELSE otsu END AS active
  FROM pm JOIN bd USING (recording_id) LEFT JOIN ot USING (recording_id) JOIN fr USING (recording_id))"""

TRACE = """
trace AS (SELECT recording_id, t, time_s, coalesce(avg(v) FILTER (WHERE active), avg(v)) AS v FROM s JOIN mask USING (recording_id, pixel_id) GROUP BY ALL)"""

# peaks of the trace: the distance rule walks from the highest peak down
BEATS = f"""
tr AS (SELECT recording_id, 0 AS pixel_id, t, v FROM trace),
{RUNS.format(src="tr")},
{PROMINENCES.format(src="tr")},
kept AS (SELECT recording_id, list_reduce(list_transform(list({{'v': v, 't': t}} ORDER BY v DESC, t DESC), lambda x: [x.t]),
    lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(k - b[1]) < {max(int(FPS * 0.8), 2)})) > 0 THEN a ELSE list_concat(a, b) END) AS ts FROM maxima GROUP BY ALL),
tb AS (SELECT recording_id, max(v) - min(v) AS rng FROM tr GROUP BY ALL),
beats AS (SELECT q.recording_id, CAST(q.t AS INTEGER) AS t FROM prominences q JOIN kept USING (recording_id) JOIN tb USING (recording_id) WHERE list_contains(ts, q.t) AND q.prominence >= 0.15 * rng AND rng >= 1e-6),
bl AS (SELECT r.recording_id, coalesce(list(b.t ORDER BY b.t) FILTER (WHERE b.t IS NOT NULL), CAST([] AS INTEGER[])) AS beats FROM tb r LEFT JOIN beats b USING (recording_id) GROUP BY ALL)"""

NEIGHBOURS = f"""
xy AS (SELECT *, pixel_id // {{w}} AS y, pixel_id % {{w}} AS x FROM {{src}}),
nb AS (SELECT a.recording_id, a.pixel_id AS src, b.pixel_id AS dst, a.v AS av, b.v AS bv FROM xy a JOIN xy b ON a.recording_id = b.recording_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)))"""

UNIT = f"""
z AS (SELECT recording_id, pixel_id, t, (v - avg(v) OVER w) / CASE WHEN sqrt(var_pop(v) OVER w * {T}) < 1e-10 THEN 1 ELSE sqrt(var_pop(v) OVER w * {T}) END AS v FROM s WINDOW w AS (PARTITION BY recording_id, pixel_id))"""

NCC = f"""
{UNIT},
zp AS (SELECT recording_id, pixel_id, list(v ORDER BY t) AS v FROM z GROUP BY ALL),
{NEIGHBOURS.format(w=W, src="zp")},
edges AS (SELECT recording_id, src, dst, greatest(0.0, least(1.0, max(list_sum(list_transform(range(greatest(0, -lag), least({T}, {T} - lag)), lambda i: av[i + 1] * bv[i + lag + 1]))))) AS weight
  FROM nb CROSS JOIN (SELECT unnest(range(-{T // 4}, {T // 4 + 1})) AS lag) GROUP BY ALL)"""


def crossing(first: str, end: str, level: str, rising: bool, v: str = "v") -> str:
    """When list ``v`` first reaches a level in frames first..end-1."""
    sign = ">=" if rising else "<="
    step = f"({DUR} / {T - 1})"
    hit = f"list_filter(range({first}, {end}), lambda i: {v}[i + 1] {sign} ({level}))[1]"
    return f"""(SELECT CASE WHEN h = {first} THEN h * {step} WHEN {v}[h] = {v}[h + 1] THEN (h - 1) * {step} ELSE (h - 1 + (({level}) - {v}[h]) / ({v}[h + 1] - {v}[h])) * {step} END FROM (SELECT {hit} AS h))"""


def _tau(first: str, end: str) -> str:
    share = "(v[i + 1] - base) / amp"
    frames = f"list_filter(range({first}, {end}), lambda i: amp > 0 AND {share} > 0.05 AND {share} < 0.95)"
    return f"""(SELECT CASE WHEN {end} - {first} >= 5 AND amp >= 1e-9 AND count(*) >= 4 AND regr_slope(ln((v[i + 1] - base) / amp), i * {DUR} / {T - 1}) < 0 THEN -1000 / regr_slope(ln((v[i + 1] - base) / amp), i * {DUR} / {T - 1}) END FROM (SELECT unnest({frames}) AS i))"""


def rounded(columns: list[str], names: list[str], src: str) -> str:
    return "SELECT " + ", ".join([*names, *[f"round({c}, 6) AS {c}" for c in columns]]) + f" FROM {src}"


KIN = ["bpm", "amp", "f0", "t_on_ms", "t10_on", "t50_on", "t90_on", "t_off_ms", "t10_off", "t50_off", "t90_off", "cd"]
STEP = f"({DUR} / {T - 1})"

SINGLE = f"""
mx AS (SELECT recording_id, pixel_id, list(q.t ORDER BY q.t) AS peaks, arg_max(q.t, (q.prominence, -q.t)) AS peak
  FROM prominences q JOIN (SELECT recording_id, pixel_id, max(v) - min(v) AS rng FROM s GROUP BY ALL) USING (recording_id, pixel_id) WHERE rng >= 1e-6 AND prominence >= 0.15 * rng GROUP BY ALL),
mn AS (SELECT recording_id, pixel_id, list(t ORDER BY t) AS minima FROM minima GROUP BY ALL),
k1 AS (SELECT recording_id, pixel_id, v, peaks, peak, coalesce(minima, []) AS minima,
    CASE WHEN len(peaks) >= 2 THEN CAST(floor(list_median(list_transform(range(1, len(peaks)), lambda i: peaks[i + 1] - peaks[i]))) AS INTEGER) ELSE {T // 2} END AS period
  FROM mx JOIN p USING (recording_id, pixel_id) LEFT JOIN mn USING (recording_id, pixel_id)),
k2 AS (SELECT *, least({T}, peak + CAST(floor(period * 1.5) AS INTEGER)) AS search,
    coalesce(list_max(list_filter(minima, lambda m: m < peak)), list_max(list_filter(range(0, peak), lambda i: v[i + 1] <= list_min(v[1:peak + 1]) + 0.05 * (v[peak + 1] - list_min(v[1:peak + 1])))), 0) AS start FROM k1),
k3 AS (SELECT *, v[start + 1] AS base, v[peak + 1] - v[start + 1] AS amp, coalesce(list_min(list_filter(minima, lambda m: m > peak AND m < search)), search) AS fin FROM k2),
k4 AS (SELECT *, {", ".join(f"{crossing('start', 'peak + 1', f'base + {k / 100} * amp', True)} AS r{k}" for k in (10, 50, 90))}, {", ".join(f"{crossing('peak', 'search', f'base + {k / 100} * amp', False)} AS d{k}" for k in (2, 10, 50, 90))} FROM k3),
single AS (SELECT recording_id, pixel_id, len(peaks) / {DUR} * 60 AS bpm, amp, base AS f0, (peak - start) * {STEP} * 1000 AS t_on_ms,
    abs(r10 - start * {STEP}) * 1000 AS t10_on, abs(r50 - start * {STEP}) * 1000 AS t50_on, abs(r90 - start * {STEP}) * 1000 AS t90_on,
    coalesce(abs(d2 - peak * {STEP}) * 1000, CASE WHEN fin < {T} THEN (fin - peak) * {STEP} * 1000 END) AS t_off_ms,
    abs(d90 - peak * {STEP}) * 1000 AS t10_off, abs(d50 - peak * {STEP}) * 1000 AS t50_off, abs(d10 - peak * {STEP}) * 1000 AS t90_off,
    coalesce(abs(d10 - r10) * 1000, abs(d50 - r50) * 1000 * 1.6) AS cd, (d10 IS NULL OR r10 IS NULL) AND d50 IS NOT NULL AND r50 IS NOT NULL AS cd_estimated FROM k4)"""

# the trace's runs and prominences have the same names, so the pixels' come in a nested query
BEAT_AVERAGED = f"""
b1 AS (SELECT p.recording_id, pixel_id, v, beats, list_max(v) - list_min(v) AS rng,
    CASE WHEN len(beats) >= 2 THEN CAST(floor(list_median(list_transform(range(1, len(beats)), lambda i: beats[i + 1] - beats[i]))) AS INTEGER) ELSE {T // 2} END AS period FROM p JOIN bl USING (recording_id)),
b2 AS (SELECT *, unnest(beats) AS peak FROM b1 WHERE rng >= 1e-6),
b3 AS (SELECT *, greatest(0, peak - greatest(period // 2, 3)) AS lo FROM b2),
b4 AS (SELECT *, lo + list_position(v[lo + 1:peak], list_min(v[lo + 1:peak])) - 1 AS start FROM b3 WHERE lo < peak),
b5 AS (SELECT *, v[start + 1] AS base, v[peak + 1] - v[start + 1] AS amp, least({T}, peak + CAST(floor(period * 1.5) AS INTEGER)) AS stop, list_filter(beats, lambda b: b > peak)[1] AS nxt FROM b4),
b6 AS (SELECT *, CASE WHEN nxt IS NOT NULL AND least(nxt, stop) - peak > 1 THEN least(stop, peak + list_position(v[peak + 1:least(nxt, stop)], list_min(v[peak + 1:least(nxt, stop)])))  ELSE stop END AS fin FROM b5 WHERE amp >= 0.05 * rng),
b7 AS (SELECT *, {_tau('peak', 'fin')} AS tau, {", ".join(f"{crossing('start', 'peak + 1', f'base + {k / 100} * amp', True)} AS r{k}" for k in (10, 50, 90))}, {", ".join(f"{crossing('peak', 'fin', f'base + {k / 100} * amp', False)} AS d{k}" for k in (5, 10, 50, 90))} FROM b6),
b8 AS (SELECT recording_id, pixel_id, len(beats) AS n, amp, base AS f0, (peak - start) * {STEP} * 1000 AS t_on_ms,
    abs(r10 - start * {STEP}) * 1000 AS t10_on, abs(r50 - start * {STEP}) * 1000 AS t50_on, abs(r90 - start * {STEP}) * 1000 AS t90_on,
    coalesce(tau * ln(20), abs(d5 - peak * {STEP}) * 1000) AS t_off_ms, abs(d90 - peak * {STEP}) * 1000 AS t10_off, abs(d50 - peak * {STEP}) * 1000 AS t50_off, coalesce(tau * ln(10), abs(d10 - peak * {STEP}) * 1000) AS t90_off FROM b7),
averaged AS (SELECT recording_id, pixel_id, max(n) / {DUR} * 60 AS bpm, {", ".join(f"avg({k}) AS {k}" for k in KIN if k not in ("bpm", "cd"))}, avg(t_on_ms) + avg(t_off_ms) - avg(t10_on) AS cd FROM b8 GROUP BY ALL)"""

ENV = f"quantile_cont(v, 0.1) OVER (PARTITION BY {PIX} ORDER BY t ROWS BETWEEN {max(T // 8, 3) // 2} PRECEDING AND {max(T // 8, 3) // 2} FOLLOWING)"

G = "WITH" + grid()
GT = "WITH" + grid(True)

DOM = f"""
ks AS (SELECT k, k * {(T - 1) / (T * DUR)!r} AS f FROM (SELECT unnest(range({T // 2 + 1})) AS k) WHERE k * {(T - 1) / (T * DUR)!r} BETWEEN 0.3 AND 5.0),
dft AS (SELECT recording_id, pixel_id, k, f, round(sqrt(sum(v * cos(2 * pi() * k * t / {T})) ^ 2 + sum(v * sin(2 * pi() * k * t / {T})) ^ 2), 9) AS m FROM s CROSS JOIN ks GROUP BY ALL),
dom AS (SELECT recording_id, pixel_id, CASE WHEN max(m) > 0 THEN arg_max(f, (m, -k)) ELSE 0 END AS dom_freq FROM dft GROUP BY ALL)"""



def _sections() -> list[list[float]]:
    """The filter's coefficients and settled states at this frame rate: fixed numbers to the SQL, which has its own recurrence."""
    from ..operators.bandpass import _settled, band, design

    sections = design(*band(FPS))
    return [[*map(float, (b0, b1, b2, a1, a2)), *map(float, z)] for (b0, b1, b2, _, a1, a2), z in zip(sections, _settled(sections), strict=True)]


def _pass(name: str, src: str) -> str:
    """One run of the filter over lists ``x`` of ``src``, a frame at a step: lists ``x`` of what comes out."""
    sections = _sections()
    states = [f"z{i}{j}" for i in range(len(sections)) for j in (1, 2)]
    begin = ", ".join(f"{z!r} * x[1]" for s in sections for z in s[5:])
    step, new, u = [], [], "x[k + 1]"
    for i, (b0, b1, b2, a1, a2, _, _) in enumerate(sections):
        step.append(f"{b0!r} * {u} + z{i}1 AS o{i}")
        new += [f"{b1!r} * {u} - ({a1!r}) * o{i} + z{i}2 AS n{i}1", f"{b2!r} * {u} - ({a2!r}) * o{i} AS n{i}2"]
        u = f"o{i}"
    outs = [f"o{i}" for i in range(len(sections))]
    return f"""
{name}_walk({PIX}, k, x, {", ".join(states)}, y) AS (
  SELECT {PIX}, 0, x, {begin}, CAST(0 AS DOUBLE) FROM {src}
  UNION ALL SELECT {PIX}, k + 1, x, {", ".join(n.split(" AS ")[1] for n in new)}, {outs[-1]} FROM (SELECT *, {", ".join(step)}, {", ".join(new)} FROM {name}_walk WHERE k < len(x))),
{name} AS (SELECT {PIX}, list(y ORDER BY k) AS x FROM {name}_walk WHERE k > 0 GROUP BY ALL)"""


PAD = 27
FILTERED = f"""
ext AS (SELECT {PIX}, list_concat(list_transform(range({PAD}), lambda i: 2 * v[1] - v[{PAD + 1} - i]), v, list_transform(range({PAD}), lambda i: 2 * v[{T}] - v[{T - 1} - i])) AS x FROM p),
{_pass("ahead", "ext")},
turned AS (SELECT {PIX}, list_reverse(x) AS x FROM ahead),
{_pass("back", "turned")},
fp AS (SELECT {PIX}, list_reverse(x)[{PAD + 1}:{PAD + T}] AS v FROM back),
fs AS (SELECT {PIX}, CAST(t AS INTEGER) AS t, v[t + 1] AS v FROM fp, (SELECT unnest(range({T})) AS t))"""
FILTERED_MASK = MASK.replace("FROM s GROUP BY ALL", "FROM fs GROUP BY ALL", 1)
GR = "WITH RECURSIVE" + grid()

SQL: dict[str, str] = {
    "prj01_normalise": G + """, b AS (SELECT recording_id, quantile_cont(v, 0.004) AS lo, quantile_cont(v, 0.996) AS hi0 FROM s WHERE t < 16 GROUP BY ALL), c AS (SELECT recording_id, lo, CASE WHEN hi0 <= lo THEN lo + 1 ELSE hi0 END AS hi FROM b)
SELECT recording_id, pixel_id, t, round((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255, 6) AS v FROM s JOIN c USING (recording_id)""",
    "prj04_coordinates": G + f" SELECT recording_id, pixel_id, pixel_id // {W} AS y, pixel_id % {W} AS x FROM px",
    "prj06_sanitise": G + " SELECT recording_id, pixel_id, t, round(CASE WHEN v % 7 < 1 THEN 0 ELSE v END, 6) AS v FROM s",
    "prj08_centre_l2": G + "," + UNIT + " SELECT recording_id, pixel_id, t, round(v, 6) AS v FROM z",
    "prj09_zscore": G + " SELECT recording_id, pixel_id, t, round((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w < 1e-10 THEN 1 ELSE stddev_pop(v) OVER w END, 6) AS v FROM s WINDOW w AS (PARTITION BY recording_id, pixel_id)",
    "prj10_standardise": G + ", f AS (SELECT recording_id, pixel_id, var_pop(v) AS puls, max(v) - min(v) AS range FROM s GROUP BY ALL) SELECT recording_id, pixel_id, round(coalesce((puls - avg(puls) OVER w) / nullif(stddev_pop(puls) OVER w, 0), 0), 6) AS puls, round(coalesce((range - avg(range) OVER w) / nullif(stddev_pop(range) OVER w, 0), 0), 6) AS range FROM f WINDOW w AS (PARTITION BY recording_id)",
    "stn02_block_mean": G + f" SELECT recording_id, t, pixel_id // {W} // 2 AS by, pixel_id % {W} // 2 AS bx, round(sum(v) / 4, 6) AS v FROM s GROUP BY ALL",
    "win01_envelope": G + f" SELECT recording_id, pixel_id, t, round({ENV}, 6) AS env FROM s",
    "win03_boundary_baseline": G + ", neg AS (SELECT recording_id, pixel_id, t, -v AS v FROM s)," + RUNS.format(src="neg") + f""",
m0 AS (SELECT recording_id, pixel_id, list_sort(list_reduce(list_transform(list({{'v': v, 't': t}} ORDER BY v DESC, t DESC), lambda x: [x.t]),
    lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(k - b[1]) < {max(5, T // 10)})) > 0 THEN a ELSE list_concat(a, b) END)) AS m FROM maxima GROUP BY ALL),
e AS (SELECT recording_id, pixel_id, t, v, {ENV} AS env FROM s),
j AS (SELECT e.recording_id, e.pixel_id, t, e.v AS sv, env, m, p.v AS v, least(greatest(len(list_filter(m, lambda k: k <= e.t)), 1), len(m) - 1) AS i FROM e JOIN p USING (recording_id, pixel_id) LEFT JOIN m0 USING (recording_id, pixel_id))
SELECT recording_id, pixel_id, t, round(sv - CASE WHEN len(m) > 1 THEN v[m[i] + 1] + (v[m[i + 1] + 1] - v[m[i] + 1]) * (t - m[i]) / (m[i + 1] - m[i]) ELSE env END, 6) AS v FROM j""",
    "win04_above_minimum": G + " SELECT recording_id, pixel_id, t, round(v - min(v) OVER (PARTITION BY recording_id, pixel_id), 6) AS v FROM s",
    "win05_bandpass": GR + "," + FILTERED + f" SELECT {PIX}, t, round(v, 6) + CAST(0 AS DOUBLE) AS v FROM fs",
    "agg06_phase": GR + "," + FILTERED + "," + FILTERED_MASK + "," + TRACE + "," + BEATS + "," + DOM.replace("FROM s CROSS", "FROM fs CROSS") + f""",
-- the imaginary part of the analytic signal is a sum over the frames an odd way off
hl AS (SELECT a.recording_id, a.pixel_id, a.t, any_value(a.v) AS v, sum(CASE WHEN (a.t - b.t) % 2 <> 0 THEN b.v * 2.0 / {T} / tan(pi() * (a.t - b.t) / {T}) ELSE 0 END) AS h FROM fs a JOIN fs b USING (recording_id, pixel_id) GROUP BY ALL),
ph AS (SELECT recording_id, pixel_id, avg(atan2(h, v)) AS phase FROM hl GROUP BY ALL)
SELECT p.recording_id, p.pixel_id, round(pulsatility, 6) AS puls, round(dom_freq, 6) AS dom_freq,
  round(CASE WHEN len(beats) > 0 THEN list_avg(list_transform(beats, lambda b: v[b + 1] - list_min(v[greatest(b - {max(int(1.5 * FPS), 3)}, 0) + 1:b + 1]))) ELSE list_max(v) - list_min(v) END, 6) AS mean_amp,
  round(phase, 6) + CAST(0 AS DOUBLE) AS phase_offset, round(len(list_filter(v, lambda x: x > list_min(v) + 0.5 * (list_max(v) - list_min(v)))) / {T}, 6) AS duty
FROM p JOIN mask USING (recording_id, pixel_id) JOIN bl USING (recording_id) JOIN dom USING (recording_id, pixel_id) JOIN ph USING (recording_id, pixel_id) WHERE active""",
    "agg07_filtered": GR + "," + FILTERED + "," + FILTERED_MASK + """ SELECT recording_id, round(coalesce(greatest(0, least(1, avg(c))), 0), 6) AS sync_index FROM (
  SELECT a.recording_id, a.pixel_id, b.pixel_id AS other, corr(a.v, b.v) AS c FROM fs a JOIN fs b ON a.recording_id = b.recording_id AND a.t = b.t AND a.pixel_id < b.pixel_id
  WHERE (a.recording_id, a.pixel_id) IN (SELECT (recording_id, pixel_id) FROM mask WHERE active) AND (b.recording_id, b.pixel_id) IN (SELECT (recording_id, pixel_id) FROM mask WHERE active) GROUP BY ALL) WHERE NOT isnan(c) GROUP BY ALL""",
    "win06_local_maxima": G + "," + RUNS.format(src="s") + " SELECT recording_id, pixel_id, CAST(t AS INTEGER) AS t FROM maxima",
    "win07_prominence": G + "," + RUNS.format(src="s") + "," + PROMINENCES.format(src="s") + " SELECT recording_id, pixel_id, CAST(t AS INTEGER) AS t, round(prominence, 6) AS prominence FROM prominences",
    "win08_peak_distance": G + "," + RUNS.format(src="s") + """,
kept AS (SELECT recording_id, pixel_id, list_reduce(list_transform(list({'v': v, 't': t} ORDER BY v DESC, t DESC), lambda x: [x.t]), lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(k - b[1]) < 8)) > 0 THEN a ELSE list_concat(a, b) END) AS ts FROM maxima GROUP BY ALL)
SELECT recording_id, pixel_id, CAST(unnest(ts) AS INTEGER) AS t FROM kept""",
    "win09_level_crossing": G + f" SELECT recording_id, pixel_id, round({crossing('0', str(T), 'list_min(v) + 0.5 * (list_max(v) - list_min(v))', True)}, 6) AS time_s FROM p",
    "win10_beat_period": G + "," + RUNS.format(src="s") + f" SELECT px.recording_id, px.pixel_id, CAST(coalesce(floor(median(t - prev)), {T // 2}) AS INTEGER) AS period FROM px LEFT JOIN (SELECT *, lag(t) OVER (PARTITION BY recording_id, pixel_id ORDER BY t) AS prev FROM maxima) USING (recording_id, pixel_id) GROUP BY ALL",
    "agg01_pulsatility": G + " SELECT recording_id, pixel_id, round(var_pop(v), 6) AS pulsatility FROM s GROUP BY ALL",
    "agg02_activity_mask": G + "," + MASK + " SELECT recording_id, pixel_id, active FROM mask",
    "agg03_reference_trace": G + "," + MASK + "," + TRACE + " SELECT recording_id, t, round(v, 6) AS v FROM trace",
    "agg04_beats": G + "," + MASK + "," + TRACE + "," + BEATS + " SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS INTEGER) AS beat_no, t FROM beats",
    "agg05_activation_map": G + "," + MASK + "," + TRACE + "," + BEATS + f""",
a1 AS (SELECT p.recording_id, p.pixel_id, p.v, b.t AS beat, greatest(b.t - {int(FPS * 3)}, 0) AS lo FROM p JOIN mask m USING (recording_id, pixel_id) JOIN beats b USING (recording_id) WHERE m.active),
a2 AS (SELECT *, list_min(v[lo + 1:beat + 1]) AS base, v[beat + 1] - list_min(v[lo + 1:beat + 1]) AS amp FROM a1),
a3 AS (SELECT *, CASE WHEN beat + 1 - lo >= 2 AND amp >= 1e-6 THEN {crossing('lo', 'beat + 1', 'base + 0.5 * amp', True)} END AS at_s FROM a2)
SELECT recording_id, pixel_id, round(avg(late) * 1000, 6) AS activation_ms FROM (SELECT *, at_s - min(at_s) OVER (PARTITION BY recording_id, beat) AS late FROM a3) GROUP BY ALL""",
    "agg06_features": G + "," + MASK + "," + TRACE + "," + BEATS + "," + DOM + f"""
SELECT p.recording_id, p.pixel_id, round(pulsatility, 6) AS puls, round(dom_freq, 6) AS dom_freq,
  round(CASE WHEN len(beats) > 0 THEN list_avg(list_transform(beats, lambda b: v[b + 1] - list_min(v[greatest(b - {max(int(1.5 * FPS), 3)}, 0) + 1:b + 1]))) ELSE list_max(v) - list_min(v) END, 6) AS mean_amp,
  round(len(list_filter(v, lambda x: x > list_min(v) + 0.5 * (list_max(v) - list_min(v)))) / {T}, 6) AS duty
FROM p JOIN mask USING (recording_id, pixel_id) JOIN bl USING (recording_id) JOIN dom USING (recording_id, pixel_id) WHERE active""",
    "agg07_synchronicity": G + """ SELECT recording_id, round(greatest(0, least(1, avg(c))), 6) AS sync_index FROM (
  SELECT a.recording_id, a.pixel_id, b.pixel_id AS other, corr(a.v, b.v) AS c FROM s a JOIN s b ON a.recording_id = b.recording_id AND a.t = b.t AND a.pixel_id < b.pixel_id GROUP BY ALL) WHERE NOT isnan(c) GROUP BY ALL""",
    "agg09_single_transient": G + "," + RUNS.format(src="s") + "," + PROMINENCES.format(src="s") + "," + SINGLE + " " + rounded(KIN, ["recording_id", "pixel_id", "cd_estimated"], "single"),
    "agg10_beat_averaged": G + "," + MASK + "," + TRACE + "," + BEATS + "," + BEAT_AVERAGED + """,
alone AS (WITH""" + (RUNS.format(src="s") + "," + PROMINENCES.format(src="s") + "," + SINGLE).replace("\nruns AS", " runs AS", 1) + """ SELECT * FROM single WHERE (recording_id, pixel_id) NOT IN (SELECT (recording_id, pixel_id) FROM averaged)),
both_ AS (SELECT recording_id, pixel_id, """ + ", ".join(KIN) + " FROM averaged UNION ALL SELECT recording_id, pixel_id, " + ", ".join(KIN) + " FROM alone) " + rounded(KIN, ["recording_id", "pixel_id"], "both_"),
    "agg11_decay_tau": G + f", q AS (SELECT recording_id, pixel_id, v, list_position(v, list_max(v)) - 1 AS peak, list_min(v) AS base, list_max(v) - list_min(v) AS amp FROM p) SELECT recording_id, pixel_id, round({_tau('peak', str(T))}, 6) AS tau_ms FROM q",
    "gra01_correlation_graph": G + "," + NCC + " SELECT recording_id, src, dst, round(weight, 6) AS weight FROM edges",
    "gra02_cosine_graph": """WITH v AS (SELECT 'embeddings' AS recording_id, CAST(vec_id AS INTEGER) AS pixel_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),""" + NEIGHBOURS.format(w=25, src="v") + " SELECT recording_id, src, dst, round(greatest(0.0, least(1.0, list_cosine_similarity(av, bv))), 6) AS weight FROM nb",
    "agg08_cluster_score": G + "," + NCC + " SELECT recording_id, round(coalesce(avg(weight) FILTER (WHERE src % 3 = dst % 3), 0), 6) AS score FROM edges GROUP BY ALL",
    "joi05_label_map": G + "," + MASK + " SELECT recording_id, pixel_id, CASE WHEN active THEN pixel_id % 3 - 1 ELSE -2 END AS label, CASE WHEN NOT active THEN 0 WHEN pixel_id % 3 = 0 THEN 1 ELSE pixel_id % 3 + 1 END AS map_value FROM mask",
    "smp01_heaviest": GT + " SELECT recording_id, pixel_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round((list_max(v) - list_min(v)) ^ 2, 6) DESC, pixel_id) AS k FROM p) WHERE k <= 10",
    "snk04_metrics_sheet": G + "," + RUNS.format(src="s") + "," + PROMINENCES.format(src="s") + "," + SINGLE + " SELECT recording_id, pixel_id, " + ", ".join(f"round_even(round({c}, 6), 3) AS {c}" for c in KIN) + " FROM single",
    "snk05_traces_sheet": G + " SELECT t, round(time_s, 6) AS time_s, " + ", ".join(f"round(max(v) FILTER (WHERE pixel_id = {i}), 6) AS \"events_P{i + 1}_Y{i // W}X{i % W}\"" for i in range(3)) + " FROM s GROUP BY t, time_s",
    "orc02_batch": GT + "," + RUNS.format(src="s") + "," + PROMINENCES.format(src="s") + "," + SINGLE + """
, am AS (SELECT recording_id, pixel_id, row_number() OVER (PARTITION BY recording_id ORDER BY round((list_max(v) - list_min(v)) ^ 2, 6) DESC, pixel_id) AS k FROM p)
""" + f"SELECT recording_id AS \"Filename\", pixel_id AS \"ID\", pixel_id % {W} AS \"X (Binned)\", pixel_id // {W} AS \"Y (Binned)\", cd_estimated, " + ", ".join(f"round({c}, 6) AS {c}" for c in KIN) + " FROM single JOIN am USING (recording_id, pixel_id) WHERE k <= 10",
    "nn03_contrastive_loss": """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS z FROM embeddings WHERE vec_id < 2 * (SELECT count(*) // 2 FROM embeddings)),
q AS (SELECT a.vec_id, ln(sum(exp(list_inner_product(a.z, b.z) / 0.5))) - max(CASE WHEN b.vec_id // 2 = a.vec_id // 2 THEN list_inner_product(a.z, b.z) / 0.5 END) AS loss FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id // 64 = b.vec_id // 64 GROUP BY a.vec_id)
SELECT vec_id // 64 AS block, round(avg(loss), 6) AS loss FROM q GROUP BY ALL""",
}



def drawn(k: int) -> str:
    """The weighted draw: the largest ln(u) / w of the pixels in ``candidates``, u from a digest."""
    u = "(CAST(concat('0x', substr(md5(concat_ws('|', recording_id, pixel_id, 42)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0"
    return f"""
weights AS (SELECT recording_id, pixel_id, (list_max(v) - list_min(v)) ^ 2 AS weight FROM candidates JOIN p USING (recording_id, pixel_id)),
known AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY recording_id) > 0 THEN weight ELSE 1 END AS w FROM weights),
drawn AS (SELECT * FROM (SELECT recording_id, pixel_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN w > 0 THEN ln({u}) / w ELSE -CAST('inf' AS DOUBLE) END DESC, pixel_id) AS INTEGER) AS rank FROM known) WHERE rank <= {k})"""


POINTS = "," + MASK + ", candidates AS (SELECT recording_id, pixel_id FROM mask WHERE active)," + drawn(6)
META = """WITH m AS (SELECT doc_id, concat('in/', doc_id, CASE WHEN doc_id % 8 = 7 THEN '.vsi' WHEN doc_id % 16 < 8 THEN '.tiff' ELSE '.TIF' END) AS path, CASE WHEN doc_id % 8 IN (1, 7) THEN 0.04 + doc_id % 5 / 100.0 WHEN doc_id % 8 = 2 THEN 1.0 END AS finterval, n_chars FROM documents),
f AS (SELECT *, CASE doc_id % 8 WHEN 0 THEN n_chars / 10 + 1 WHEN 1 THEN round_even(1 / finterval, 4) WHEN 2 THEN round_even(doc_id % 50 + 0.5, 4) WHEN 3 THEN round_even(1 / ((50 + doc_id % 7) * 0.001), 4)
  WHEN 4 THEN round_even(1000.0 / (20 + doc_id % 11), 4) WHEN 5 THEN round_even(1000.0 / (40 + doc_id % 9), 4) END AS fps FROM m)"""
SQL |= {
    "smp02_weighted_sample": GT + ", candidates AS (SELECT recording_id, pixel_id FROM px)," + drawn(10) + " SELECT * FROM drawn",
    "smp02_labelled_sample": G + POINTS + " SELECT *, concat('P', rank) AS point FROM drawn",
    "ui05_selected_traces": G + POINTS + " SELECT recording_id, concat('P', rank) AS point, t, round(time_s, 6) AS time_s, round(v, 6) AS v FROM s JOIN drawn USING (recording_id, pixel_id)",
    "ui06_selected_metrics": SQL["agg10_beat_averaged"].rsplit("SELECT", 1)[0].rstrip() + ", candidates AS (SELECT recording_id, pixel_id FROM mask WHERE active)," + drawn(6) + " SELECT recording_id, concat('P', rank) AS point, " + ", ".join(f"round({c}, 6) AS {c}" for c in KIN) + " FROM both_ JOIN drawn USING (recording_id, pixel_id)",
    "src06_timing": META + " SELECT doc_id, path, round(fps, 6) AS fps, CASE doc_id % 8 WHEN 0 THEN 'sidecar' WHEN 1 THEN 'finterval' WHEN 2 THEN 'fps' WHEN 3 THEN 'ome' WHEN 4 THEN 'summary' WHEN 5 THEN 'info' END AS fps_source, CAST(CASE WHEN doc_id % 8 = 7 THEN doc_id % 100 ELSE doc_id % 90 END AS INTEGER) AS n_frames, CASE WHEN doc_id % 8 = 5 THEN 2 ELSE 0 END AS times FROM f",
    "src07_batch_rate": META + " SELECT doc_id, finterval IS NOT NULL OR doc_id % 3 = 0 AS use_fps, round(CASE WHEN finterval IS NOT NULL THEN 1 / finterval ELSE 15.0 END, 6) AS value FROM m",
    "snk01_sidecars": META + " SELECT regexp_replace(path, '[.][^./]*$', '.fps') AS path, concat('{\"fps\":', CAST(CAST(fps AS DOUBLE) AS VARCHAR), ',\"path\":\"', split_part(path, '/', 2), '\"}') AS content FROM f WHERE fps IS NOT NULL",
    "prj02_duration": """WITH u AS (SELECT user_id, count(*) AS frames FROM events GROUP BY user_id), d AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN frames / (15.0 + user_id % 10) ELSE 15.0 + user_id % 10 END AS seconds FROM u)
SELECT user_id, frames, round(CAST(seconds AS DOUBLE), 6) AS seconds, CASE WHEN greatest(frames * 20, (user_id % 7 + 1) * 400) < 2048 THEN 16 ELSE 32 END AS bin_size, seconds BETWEEN 1 AND 300 AS likely FROM d""",
    "stn01_blur": G + f""",
h AS (SELECT recording_id, t, max(pixel_id) // {W} + 1 AS h FROM s GROUP BY ALL),
g AS (SELECT h.recording_id, h.t, h, n // {W} AS y, n % {W} AS x, coalesce(v, 0.0) AS v FROM (SELECT *, unnest(range(h * {W})) AS n FROM h) h LEFT JOIN s ON s.recording_id = h.recording_id AND s.t = h.t AND s.pixel_id = n),
k AS (SELECT o, exp(-o * o / 1.28) / sum(exp(-o * o / 1.28)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS o)),
ky AS (SELECT *, ((y + o) % (2 * h) + 2 * h) % (2 * h) AS m FROM g CROSS JOIN k),
down AS (SELECT a.recording_id, a.t, a.h, a.y, a.x, sum(a.w * b.v) AS v FROM ky a JOIN g b ON a.recording_id = b.recording_id AND a.t = b.t AND a.x = b.x AND b.y = CASE WHEN m < a.h THEN m ELSE 2 * a.h - 1 - m END GROUP BY ALL),
kx AS (SELECT *, ((x + o) % {2 * W} + {2 * W}) % {2 * W} AS m FROM down CROSS JOIN k)
SELECT a.recording_id, a.t, a.y, a.x, round(sum(a.w * b.v), 6) AS v FROM kx a JOIN down b ON a.recording_id = b.recording_id AND a.t = b.t AND a.y = b.y AND b.x = CASE WHEN m < {W} THEN m ELSE {2 * W - 1} - m END GROUP BY ALL""",
}

# frames with every pixel, normalised by the first frames' percentiles, blurred with mirrored edges, in blocks of 2 x 2
FRONT_W = -(-W // 2)
FRONT = "WITH" + grid(True) + f""",
h AS (SELECT recording_id, max(pixel_id) // {W} + 1 AS h FROM px GROUP BY ALL),
raw AS (SELECT h.recording_id, f.t, h, n // {W} AS y, n % {W} AS x, coalesce(v, 0.0) AS v FROM (SELECT *, unnest(range(h * {W})) AS n FROM h) h CROSS JOIN (SELECT unnest(range({T})) AS t) f
  LEFT JOIN s ON s.recording_id = h.recording_id AND s.t = f.t AND s.pixel_id = n),
b AS (SELECT recording_id, quantile_cont(v, 0.004) AS lo, quantile_cont(v, 0.996) AS hi FROM raw WHERE t < 16 GROUP BY ALL),
g AS (SELECT recording_id, t, h, y, x, (least(greatest(v, lo), hi) - lo) / (hi - lo) * 255 AS v FROM raw JOIN b USING (recording_id)),
k AS (SELECT o, exp(-o * o / 1.28) / sum(exp(-o * o / 1.28)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS o)),
ky AS (SELECT *, ((y + o) % (2 * h) + 2 * h) % (2 * h) AS m FROM g CROSS JOIN k),
down AS (SELECT a.recording_id, a.t, a.h, a.y, a.x, sum(a.w * b.v) AS v FROM ky a JOIN g b ON a.recording_id = b.recording_id AND a.t = b.t AND a.x = b.x AND b.y = CASE WHEN m < a.h THEN m ELSE 2 * a.h - 1 - m END GROUP BY ALL),
kx AS (SELECT *, ((x + o) % {2 * W} + {2 * W}) % {2 * W} AS m FROM down CROSS JOIN k),
smooth AS (SELECT a.recording_id, a.t, a.y, a.x, sum(a.w * b.v) AS v FROM kx a JOIN down b ON a.recording_id = b.recording_id AND a.t = b.t AND a.y = b.y AND b.x = CASE WHEN m < {W} THEN m ELSE {2 * W - 1} - m END GROUP BY ALL),
binned AS (SELECT recording_id, CAST(y // 2 * {FRONT_W} + x // 2 AS INTEGER) AS pixel_id, t, sum(v) / 4 AS v FROM smooth GROUP BY ALL)"""

# signals without their boundary baseline, band-passed for the mask
CHAIN = GR.replace(grid(), grid(True).replace("s AS (SELECT px", "s0 AS (SELECT px").replace("FROM s GROUP BY ALL)", "FROM s0 GROUP BY ALL)").replace("\np AS", "\np0 AS")).replace("SELECT event_type", "SELECT event_type") + """,
s AS (WITH neg AS (SELECT recording_id, pixel_id, t, -v AS v FROM s0),""" + RUNS.format(src="neg") + f""",
  m0 AS (SELECT recording_id, pixel_id, list_sort(list_reduce(list_transform(list({{'v': v, 't': t}} ORDER BY v DESC, t DESC), lambda x: [x.t]),
    lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(k - b[1]) < {max(5, T // 10)})) > 0 THEN a ELSE list_concat(a, b) END)) AS m FROM maxima GROUP BY ALL),
  e AS (SELECT recording_id, pixel_id, t, time_s, v, {ENV} AS env FROM s0),
  j AS (SELECT e.recording_id, e.pixel_id, t, time_s, e.v AS sv, env, m, p0.v AS v, least(greatest(len(list_filter(m, lambda k: k <= e.t)), 1), len(m) - 1) AS i FROM e JOIN p0 USING (recording_id, pixel_id) LEFT JOIN m0 USING (recording_id, pixel_id))
  SELECT recording_id, pixel_id, t, time_s, sv - CASE WHEN len(m) > 1 THEN v[m[i] + 1] + (v[m[i + 1] + 1] - v[m[i] + 1]) * (t - m[i]) / (m[i + 1] - m[i]) ELSE env END AS v FROM j WHERE recording_id <> 'error'),
p AS (SELECT recording_id, pixel_id, list(v ORDER BY t) AS v FROM s GROUP BY ALL)"""


def _fit(src: str, *suffixes: str) -> str:
    """``src`` (y, g of each suffix) with a, c and the squared error r of the decay of log time constant g fitted to the list y."""
    each = lambda f: ", ".join(f(k) for k in suffixes)
    over = f"range(1, {T + 1})"
    out = f"SELECT *, {each(lambda k: f'list_transform(range({T}), lambda i: exp(-least(i * {STEP} / greatest(exp(g{k}), 1e-5), 700))) AS e{k}')} FROM {src}"
    out = f"SELECT *, {each(lambda k: f'list_avg(e{k}) AS m{k}')} FROM ({out})"
    out = f"SELECT *, {each(lambda k: f'list_sum(list_transform(e{k}, lambda x: (x - m{k}) * (x - m{k}))) AS q{k}, list_sum(list_transform({over}, lambda i: (e{k}[i] - m{k}) * y[i])) AS u{k}')} FROM ({out})"
    out = f"SELECT *, {each(lambda k: f'CASE WHEN q{k} > 1e-12 THEN greatest(u{k} / q{k}, 0.0) ELSE 0.0 END AS a{k}')} FROM ({out})"
    out = f"SELECT *, {each(lambda k: f'list_avg(list_transform({over}, lambda i: y[i] - a{k} * e{k}[i])) AS c{k}')} FROM ({out})"
    return f"SELECT *, {each(lambda k: f'list_sum(list_transform({over}, lambda i: (y[i] - a{k} * e{k}[i] - c{k}) ^ 2)) AS r{k}')} FROM ({out})"


# a grid of time constants, then a golden section between the neighbours of the best
GOLDEN = (5**0.5 - 1) / 2
DECAY = f"""
ys AS (SELECT {PIX}, list(env ORDER BY t) AS y FROM (SELECT {PIX}, t, {ENV} AS env FROM s) GROUP BY ALL),
tried AS (SELECT *, ln({DUR}) + ln(1e-3) + k * (ln(1e3) - ln(1e-3)) / 60 AS g0 FROM ys, (SELECT unnest(range(61)) AS k)),
best AS (SELECT {PIX}, any_value(y) AS y, arg_min(k, (r0, k)) AS k FROM ({_fit("tried", "0")}) GROUP BY ALL),
section AS (
  SELECT {PIX}, y, 0 AS n, ln({DUR}) + ln(1e-3) + greatest(k - 1, 0) * (ln(1e3) - ln(1e-3)) / 60 AS lo, ln({DUR}) + ln(1e-3) + least(k + 1, 60) * (ln(1e3) - ln(1e-3)) / 60 AS hi FROM best
  UNION ALL SELECT {PIX}, y, n + 1, CASE WHEN r1 <= r2 THEN lo ELSE g1 END, CASE WHEN r1 <= r2 THEN g2 ELSE hi END
  FROM ({_fit(f"(SELECT *, hi - {GOLDEN!r} * (hi - lo) AS g1, lo + {GOLDEN!r} * (hi - lo) AS g2 FROM section WHERE n < 60)", "1", "2")})),
fitted AS ({_fit("(SELECT *, (lo + hi) / 2 AS g3 FROM section WHERE n = 60)", "3")})"""

SQL |= {
    "win02_fit": GR + "," + DECAY + f" SELECT recording_id, pixel_id, round(r3 / {T}, 6) AS error FROM fitted",
    "orc01_front": FRONT + "," + MASK.replace("FROM s GROUP BY ALL", "FROM binned GROUP BY ALL", 1) + " SELECT recording_id, pixel_id, round(pulsatility, 6) AS pulsatility, active FROM mask",
    "orc02_isolated": CHAIN + "," + FILTERED + "," + FILTERED_MASK + "," + RUNS.format(src="s") + "," + PROMINENCES.format(src="s") + "," + SINGLE + f""",
am AS (SELECT recording_id, pixel_id, row_number() OVER (PARTITION BY recording_id ORDER BY round((list_max(v) - list_min(v)) ^ 2, 6) DESC, pixel_id) AS k FROM p JOIN mask USING (recording_id, pixel_id) WHERE active)
SELECT recording_id AS "Filename", pixel_id AS "ID", pixel_id % {W} AS "X (Binned)", pixel_id // {W} AS "Y (Binned)", {", ".join(f"round({c}, 6) AS {c}" for c in KIN)}, 'ok' AS status FROM single JOIN am USING (recording_id, pixel_id) WHERE k <= 10
UNION ALL SELECT DISTINCT recording_id, CAST(NULL AS INTEGER), NULL, NULL, {", ".join("NULL" for _ in KIN)}, 'too few finite values' FROM px WHERE recording_id = 'error'""",
    "clu03_inherited": GT + """, l AS (SELECT recording_id, pixel_id, CASE WHEN pixel_id % 11 > 0 THEN pixel_id * 7 % 2 - 1 ELSE -2 END AS l1, pixel_id * 7 % 3 - 1 AS l2, pixel_id * 7 % 4 - 1 AS l3 FROM px),
m AS (SELECT recording_id, pixel_id, 'features' AS method, l1 AS label, 'features' AS status FROM l
  UNION ALL SELECT recording_id, pixel_id, 'correlation', CASE WHEN recording_id = 'error' THEN l1 ELSE l2 END, CASE WHEN recording_id = 'error' THEN 'features' ELSE 'correlation' END FROM l
  UNION ALL SELECT recording_id, pixel_id, 'contrastive', CASE recording_id WHEN 'error' THEN l1 WHEN 'click' THEN l2 ELSE l3 END, CASE recording_id WHEN 'error' THEN 'features' WHEN 'click' THEN 'correlation' ELSE 'contrastive' END FROM l)
SELECT *, CASE label WHEN -2 THEN 0 WHEN -1 THEN 1 ELSE label + 2 END AS map_value FROM m""",
    "gra06_fallback": GT + f""",
xy AS (SELECT *, pixel_id // {W} AS y, pixel_id % {W} AS x FROM px WHERE pixel_id < 60),
ends AS (SELECT a.recording_id, a.pixel_id, CAST(count(*) AS INTEGER) AS n FROM xy a JOIN xy b ON a.recording_id = b.recording_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL)
SELECT recording_id, pixel_id, CAST(CASE recording_id WHEN 'view' THEN 0 WHEN 'error' THEN pixel_id % 4 + 10 * coalesce(n, 0) WHEN 'click' THEN pixel_id % 3 + 10 * coalesce(n, 0) ELSE pixel_id % 2 + 10 * coalesce(n, 0) END AS INTEGER) AS label,
  CASE recording_id WHEN 'view' THEN 'single' WHEN 'error' THEN 'density' WHEN 'click' THEN 'spectral' ELSE 'communities' END AS status FROM px LEFT JOIN ends USING (recording_id, pixel_id)""",
    "src04_companions": """WITH f AS (SELECT concat('in/_rec', doc_id % 50, '_/stack', doc_id % 3, '/frame_', doc_id, CASE doc_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.ETS' ELSE '.ets' END) AS path, CAST(n_chars AS BIGINT) AS length, concat('rec', doc_id % 50) AS recording_id FROM documents)
SELECT recording_id, path, length FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY length DESC, path) AS k FROM f WHERE lower(path) LIKE '%.ets') WHERE k = 1""",
    "snk01_written": SQL["snk01_sidecars"],
    "snk06_batch_written": SQL["orc02_batch"],
    # frames that end by a day before the last event; a beat needs three frames on either side
    "str01_beats": """WITH ev AS (SELECT CAST(user_id AS INTEGER) AS pixel_id, CAST(epoch_us(ts) // 43200000000 - 39446 AS INTEGER) AS t, value, epoch_us(ts) AS us FROM events),
c AS (SELECT pixel_id, t, avg(value) AS v FROM ev WHERE (t + 39447) * 43200000000 <= (SELECT max(us) // 1000 * 1000 FROM ev) - 86400000000 GROUP BY ALL),
e AS (SELECT n.pixel_id, n.t, coalesce(v, 0.0) AS v FROM (SELECT pixel_id, unnest(range(max(t) + 1)) AS t FROM c GROUP BY pixel_id) n LEFT JOIN c USING (pixel_id, t)),
w AS (SELECT *, max(v) OVER b AS vb, min(v) OVER b AS low, count(*) OVER b AS nb, max(v) OVER a AS va, count(*) OVER a AS na FROM e
  WINDOW b AS (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT pixel_id, CAST(t AS INTEGER) AS t, round(v, 6) AS v FROM w WHERE nb = 3 AND na = 3 AND v >= vb AND v > va AND v >= low""",
}

# a zero has no sign in a result
for _name, _columns in {"prj08_centre_l2": ["v"], "prj09_zscore": ["v"], "prj10_standardise": ["puls", "range"], "win03_boundary_baseline": ["v"]}.items():
    SQL[_name] = "SELECT * REPLACE (" + ", ".join(f"{c} + CAST(0 AS DOUBLE) AS {c}" for c in _columns) + f") FROM ({SQL[_name]})"
