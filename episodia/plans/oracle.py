"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from ..operators.folds import at
from ..config import micros
from . import params as P

GAP = micros(P.FEATURES.gap)
HOLD, SCORE_GAP = micros(P.EVALUATION.hold), micros(P.EVALUATION.score_gap)
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BY = "PARTITION BY asset_id ORDER BY us"


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0e0)" + (f" AS {name}" if name else "")


TEL = """tel AS (SELECT CAST(user_id % 4 AS VARCHAR) AS asset_id, epoch_us(ts) AS us, value,
  CAST(event_type = 'click' AS DOUBLE) AS is_click, CAST(event_type = 'error' AS DOUBLE) AS is_error, CAST(event_type = 'view' AS DOUBLE) AS is_view FROM events)"""

REG = f"""{TEL},
raw AS (SELECT *, CASE WHEN is_click = 1 THEN 'LOADED' WHEN value >= 35 THEN 'OFFLOAD' ELSE 'STOPPED' END AS raw FROM tel),
raw1 AS (SELECT *, CASE WHEN lag(raw) OVER w IS DISTINCT FROM raw THEN us END AS c FROM raw WINDOW w AS ({BY})),
raw2 AS (SELECT *, us - last_value(c IGNORE NULLS) OVER ({BY} {SO_FAR}) AS held FROM raw1),
com AS (SELECT *, coalesce(last_value(CASE WHEN held >= {micros(P.REGIMES.min_duration)} THEN raw END IGNORE NULLS) OVER ({BY} {SO_FAR}), first_value(raw) OVER ({BY} {SO_FAR})) AS com FROM raw2),
com1 AS (SELECT * EXCLUDE (c), CASE WHEN lag(com) OVER w IS DISTINCT FROM com THEN us END AS c FROM com WINDOW w AS ({BY})),
com2 AS (SELECT *, us - last_value(c IGNORE NULLS) OVER ({BY} {SO_FAR}) AS settling FROM com1),
reg AS (SELECT asset_id, us, value, is_click, is_error, is_view, CASE WHEN settling <= {micros(P.REGIMES.settle)} THEN 'TRANSITION' ELSE com END AS regime FROM com2)"""


def runs(gap: int | None) -> str:
    cut = f" OR us - lag(us) OVER w > {gap}" if gap is not None else ""
    flags = f"coalesce(lead(start_us) OVER v - end_us > {gap}, FALSE) AS gap_truncated, coalesce(start_us - lag(end_us) OVER v > {gap} AND lag(regime) OVER v = regime, FALSE) AS start_is_gap_continuation" if gap is not None else "FALSE AS gap_truncated, FALSE AS start_is_gap_continuation"
    return f"""{REG},
rows0 AS (SELECT *, CASE WHEN lag(regime) OVER w IS DISTINCT FROM regime{cut} THEN 1 ELSE 0 END AS fresh FROM reg WINDOW w AS ({BY})),
rows1 AS (SELECT *, CAST(sum(fresh) OVER ({BY} {SO_FAR}) AS BIGINT) AS run_id FROM rows0),
rows2 AS (SELECT *, (us - first_value(us) OVER (PARTITION BY asset_id, run_id ORDER BY us)) / 1e6 AS x FROM rows1),
runs0 AS (SELECT asset_id, run_id, any_value(regime) AS regime, min(us) AS start_us, max(us) AS end_us, count(*) AS n, (max(us) - min(us)) / 1e6 AS duration_s, max(value) AS peak,
  CASE WHEN count(*) >= 2 THEN regr_slope(value, x) END AS slope FROM rows2 GROUP BY asset_id, run_id),
runs AS (SELECT *, {flags} FROM runs0 WINDOW v AS (PARTITION BY asset_id ORDER BY run_id))"""


RUN_W = "PARTITION BY asset_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def last_completed(label: str, value: str, void: bool = True) -> str:
    got = f"CASE WHEN gap_truncated THEN NULL ELSE {value} END" if void else value
    return f"last_value(CASE WHEN regime = '{label}' THEN {{'v': {got}, 'g': gap_truncated}} END IGNORE NULLS) OVER ({RUN_W})"


PERIOD = """per0 AS (SELECT *, CASE WHEN regime = 'STOPPED' AND NOT start_is_gap_continuation THEN start_us END AS s0 FROM runs),
per1 AS (SELECT *, CASE WHEN s0 IS NOT NULL THEN (start_us - last_value(s0 IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6 END AS p0 FROM per0),
per AS (SELECT *, last_value(p0 IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS period FROM per1)"""

RUNNING = """CASE WHEN regime = 'STOPPED' THEN x END"""


def running_slope() -> str:
    w = f"PARTITION BY asset_id, run_id ORDER BY us {SO_FAR}"
    return f"CASE WHEN regime = 'STOPPED' AND count(*) OVER ({w}) >= 3 THEN regr_slope(value, x) OVER ({w}) END"


def frame(width: int) -> str:
    return f"{BY} RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW"


def ratio(v: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {v} / {b} WHEN {b} = 0 AND {v} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {b} = 0 AND {v} < 0 THEN CAST('-Infinity' AS DOUBLE) END"


FEATURES = f"""{runs(GAP)}, {PERIOD},
feat0 AS (SELECT *, {last_completed('STOPPED', 'duration_s')} AS s1, {last_completed('OFFLOAD', 'duration_s')} AS o1, {last_completed('LOADED', 'duration_s')} AS l1, {last_completed('STOPPED', 'slope', False)} AS d1, {last_completed('STOPPED', 'abs(slope)', False)} AS d2, {last_completed('OFFLOAD', 'peak')} AS k1 FROM per),
feat AS (SELECT r.asset_id, r.us, r.regime, f.s1.v AS stopped_duration_last, f.o1.v AS offload_duration_last, f.l1.v AS loaded_duration_last, coalesce(f.s1.g, FALSE) AS run_gap_truncated,
  {RUNNING.replace('regime', 'r.regime')} AS stopped_elapsed, f.period AS cycle_period_last, f.d1.v AS decay_rate_last, f.d2.v AS abs_decay, f.k1.v AS peak_last,
  avg(CAST(r.regime = 'LOADED' AS DOUBLE)) OVER (PARTITION BY r.asset_id ORDER BY r.us RANGE BETWEEN {micros(P.FEATURES.duty) - 1} PRECEDING AND CURRENT ROW) AS duty_ratio_trailing,
  rs AS decay_rate_running
  FROM (SELECT *, {running_slope()} AS rs FROM rows2) r JOIN feat0 f USING (asset_id, run_id))"""


def severity(side: str, q: str) -> str:
    ramp = "1 - 2 * " if side == "low" else "2 * "
    tail = "" if side == "low" else " - 1"
    rank = f"(SELECT CASE WHEN count(*) = 0 THEN 0.5 ELSE (count(*) FILTER (t.{q} < d.{q}) + count(*) FILTER (t.{q} <= d.{q})) / (2.0 * count(*)) END FROM train t WHERE t.asset_id = d.asset_id AND t.{q} IS NOT NULL)"
    return f"CASE WHEN d.{q} IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, {ramp}{rank}{tail})) END"


def _rank_cte(q: str) -> str:
    """Ranks by distinct value, so that no row is compared with all others."""
    return f"""pt_{q} AS (SELECT asset_id, {q} AS v, sum(t) AS t FROM (SELECT asset_id, {q}, 1 AS t FROM quant WHERE us < {at(P.EVENTS[1].start)} UNION ALL SELECT asset_id, {q}, 0 FROM quant) WHERE {q} IS NOT NULL GROUP BY ALL),
rk_{q} AS (SELECT asset_id, v, CASE WHEN sum(t) OVER (PARTITION BY asset_id) = 0 THEN 0.5 ELSE (2 * sum(t) OVER (PARTITION BY asset_id ORDER BY v {SO_FAR}) - t) / (2.0 * sum(t) OVER (PARTITION BY asset_id)) END AS rk FROM pt_{q})"""


RULE_COLUMNS = {"short_stopped_duration": ("low", "q1"), "fast_pressure_decay": ("high", "q2"), "low_peak_pressure": ("low", "q3"), "high_duty_ratio": ("high", "q4")}
_med = lambda c: f"median({c}) OVER ({frame(micros(P.RULES.baseline))})"
QUANTITIES = f"""{FEATURES},
quant0 AS (SELECT *, {_med('stopped_duration_last')} AS b1, {_med('abs_decay')} AS b2, {_med('peak_last')} AS b3 FROM feat),
quant AS (SELECT asset_id, us, {ratio('stopped_duration_last', 'b1')} AS q1, {ratio('abs_decay', 'b2')} AS q2, {ratio('peak_last', 'b3')} AS q3, duty_ratio_trailing AS q4 FROM quant0)"""
RULES = f"""{QUANTITIES},
{', '.join(_rank_cte(q) for q in ('q1', 'q2', 'q3', 'q4'))},
sev AS (SELECT d.asset_id, d.us, {', '.join(f"CASE WHEN rk_{q}.rk IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, {'1 - 2 * ' if side == 'low' else '2 * '}rk_{q}.rk{'' if side == 'low' else ' - 1'})) END AS {name}" for name, (side, q) in RULE_COLUMNS.items())}
  FROM quant d {' '.join(f'LEFT JOIN rk_{q} ON rk_{q}.asset_id = d.asset_id AND rk_{q}.v = d.{q}' for q in ('q1', 'q2', 'q3', 'q4'))})"""


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in row) + ")" for row in rows)


def _excl(e) -> tuple[str, str]:
    return ("start_us - pre", "CASE WHEN maint_us IS NOT NULL THEN maint_us + post ELSE end_us + fallback END")


S = P.SPLIT
EVENTS = f"""ev AS (SELECT event_id, start_us, end_us, maint_us, {micros(S.embargo)} AS emb,
  start_us - {micros(S.pre_margin)} AS x0, CASE WHEN maint_us IS NOT NULL THEN maint_us + {micros(S.post_settle)} ELSE end_us + {micros(S.fallback_post)} END AS x1,
  CASE WHEN maint_us IS NOT NULL THEN greatest(end_us, maint_us) + {micros(S.post_settle)} ELSE end_us + {micros(S.fallback_post)} END AS mask_end
  FROM ({_values([(e.id, at(e.start), at(e.end), at(e.maintenance) if e.maintenance else None) for e in P.EVENTS])}) t(event_id, start_us, end_us, maint_us)),
regions AS (SELECT * FROM ({_values([(at(x.start), at(x.end)) for x in S.regions])}) t(start_us, end_us)),
bounds AS (SELECT {at(P.DATA_START)} AS ds, {at(P.DATA_END)} AS de)"""


def union_of(source: str, name: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""{name}0 AS (SELECT *, CASE WHEN max(end_us) OVER ({part}ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_us THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}1 AS (SELECT *, sum(fresh) OVER ({part}ORDER BY start_us, end_us {SO_FAR}) AS g FROM {name}0),
{name} AS (SELECT {cols}min(start_us) AS start_us, max(end_us) AS end_us FROM {name}1 GROUP BY {cols}g)"""


W_US = int(max(P.WIDTHS) * P.HOUR)
FOLDS = f"""{EVENTS},
fold AS (SELECT event_id, ds AS train_start, start_us - {W_US} - 2 * emb AS train_end, start_us - {W_US} - emb AS test_start, coalesce(greatest(end_us, maint_us), end_us) AS test_end, start_us AS event_start_us, end_us AS event_end_us FROM ev, bounds),
cuts AS (SELECT event_id, greatest(a, train_start) AS start_us, least(b, train_end) AS end_us FROM fold, (SELECT x0 AS a, x1 AS b FROM ev UNION ALL SELECT start_us, end_us FROM regions) WHERE b > train_start AND a < train_end),
{union_of('cuts', 'holes', 'event_id')}"""
TRAIN = f"""{FOLDS}, {TEL},
train AS (SELECT f.event_id, t.* FROM tel t JOIN fold f ON t.us >= f.train_start AND t.us < f.train_end WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE h.event_id = f.event_id AND t.us >= h.start_us AND t.us < h.end_us)),
test AS (SELECT f.event_id, t.* FROM tel t JOIN fold f ON t.us BETWEEN f.test_start AND f.test_end)"""
MASKS = "masks AS (SELECT start_us, mask_end AS end_us FROM ev UNION ALL SELECT start_us, end_us FROM regions)"

STRETCH = f"""{EVENTS},
wide AS (SELECT start_us - {W_US} - {micros(P.EVALUATION.pooled_buffer)} AS start_us, mask_end + {micros(P.EVALUATION.pooled_buffer)} AS end_us FROM ev UNION ALL SELECT start_us - {micros(P.EVALUATION.pooled_buffer)}, end_us + {micros(P.EVALUATION.pooled_buffer)} FROM regions),
{union_of('wide', 'outs')},
edges AS (SELECT least(start_us, de) AS b, end_us FROM outs, bounds UNION ALL SELECT de, de FROM bounds),
stretch AS (SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INTEGER) AS scope_id, a AS start_us, b AS end_us FROM (SELECT coalesce(greatest(lag(end_us) OVER (ORDER BY b, end_us), ds), ds) AS a, b FROM edges, bounds) WHERE b > a)"""


def flagged(source: str, by: str, threshold: str, prefix: str = "e") -> str:
    w = f"PARTITION BY {by} ORDER BY us"
    p = prefix
    return f"""{p}0 AS (SELECT *, coalesce(score >= {threshold}, FALSE) AS above, CASE WHEN us - lag(us) OVER ({w}) > {SCORE_GAP} OR lag(us) OVER ({w}) IS NULL THEN 1 ELSE 0 END AS cut FROM {source}),
{p}1 AS (SELECT *, sum(cut) OVER ({w} {SO_FAR}) AS seg FROM {p}0),
{p}2 AS (SELECT *, last_value(CASE WHEN above THEN us END IGNORE NULLS) OVER (PARTITION BY {by}, seg ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_up, lag(above) OVER (PARTITION BY {by}, seg ORDER BY us) AS prev FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN above AND (prev_up IS NULL OR (NOT prev AND us - prev_up > {HOLD})) THEN 1 ELSE 0 END AS fresh FROM {p}2),
{p}4 AS (SELECT *, CASE WHEN above THEN CAST(sum(fresh) OVER ({w} {SO_FAR}) AS BIGINT) END AS id FROM {p}3),
{p}5 AS (SELECT {by}, id AS episode, min(us) AS start_us, max(us) AS end_us FROM {p}4 WHERE above GROUP BY {by}, id)"""


SCORED = f"{TEL}, scored AS (SELECT *, value / 100 AS score FROM tel)"
FOLD_EP = f"""{TRAIN}, {MASKS}, testscored AS (SELECT *, value / 100 AS score FROM test), {flagged('testscored', 'event_id, asset_id', str(P.SCORE_THRESHOLD))},
cats AS (SELECT e.*, f.event_start_us, CASE WHEN e.start_us <= f.event_start_us AND e.end_us >= f.event_start_us - {24 * P.HOUR} THEN 'early_warning' WHEN e.start_us <= f.event_end_us AND e.end_us >= f.event_start_us THEN 'concurrent'
  WHEN EXISTS (SELECT 1 FROM masks m WHERE e.start_us <= m.end_us AND e.end_us >= m.start_us) THEN 'masked' ELSE 'false_alarm' END AS category FROM e5 e JOIN fold f USING (event_id)),
per_ AS (SELECT a.asset_id, f.event_id, f.test_start AS lo, f.test_end AS hi FROM fold f, (SELECT DISTINCT asset_id FROM test) a),
miss0 AS (SELECT event_id, asset_id, greatest(m.start_us, lo) AS start_us, least(m.end_us, hi) AS end_us FROM per_, masks m UNION ALL
  SELECT event_id, asset_id, greatest(s, lo), least(us, hi) FROM (SELECT event_id, asset_id, lag(us) OVER (PARTITION BY event_id, asset_id ORDER BY us) AS s, us FROM test) JOIN per_ USING (event_id, asset_id) WHERE us - s > {SCORE_GAP}),
miss AS (SELECT * FROM miss0 WHERE end_us > start_us),
{union_of('miss', 'lost', 'event_id, asset_id')},
days AS (SELECT p.event_id, p.asset_id, greatest(hi - lo - coalesce(l.t, 0), 0) / 86400000000.0 AS days FROM per_ p LEFT JOIN (SELECT event_id, asset_id, CAST(sum(end_us - start_us) AS BIGINT) AS t FROM lost GROUP BY ALL) l USING (event_id, asset_id)),
res AS (SELECT d.event_id, d.asset_id, coalesce(c.n, 0) AS n_episodes, coalesce(c.fa, 0) AS n_false_alarms, coalesce(c.ma, 0) AS n_masked, coalesce(c.det, FALSE) AS detected, NOT coalesce(c.det, FALSE) AND coalesce(c.con, FALSE) AS concurrent_only, c.lead_h, d.days,
  CASE WHEN d.days > 0 THEN coalesce(c.fa, 0) / d.days ELSE 0.0 END AS false_alarms_per_day FROM days d LEFT JOIN (SELECT event_id, asset_id, count(*) AS n, count(*) FILTER (category = 'false_alarm') AS fa, count(*) FILTER (category = 'masked') AS ma, bool_or(category = 'early_warning') AS det, bool_or(category = 'concurrent') AS con,
  (any_value(event_start_us) - min(start_us) FILTER (category = 'early_warning')) / 3.6e9 AS lead_h FROM cats GROUP BY ALL) c USING (event_id, asset_id))"""
N = P.EVALUATION.permutation_samples
PERM = f"""{FOLD_EP},
place AS (SELECT event_id, asset_id, lo, lo + CAST(floor(i * (hi - lo) / {N - 1}) AS BIGINT) AS t FROM per_, range(0, {N}) g(i)),
perm AS (SELECT p.event_id, p.asset_id, avg(CAST(EXISTS (SELECT 1 FROM e5 e WHERE e.event_id = p.event_id AND e.asset_id = p.asset_id AND e.start_us <= p.t AND e.end_us >= p.t - {12 * P.HOUR}) AS DOUBLE)) AS p_permutation, count(*) AS n_valid FROM place p WHERE t - {12 * P.HOUR} >= lo GROUP BY ALL)"""
POOLED = f"""{STRETCH}, {SCORED}, thr AS (SELECT * FROM (VALUES (0.8e0), (0.9e0), (1.0e0), (1.2e0)) t(threshold)),
prow AS (SELECT s.*, t.scope_id FROM scored s JOIN stretch t ON s.us BETWEEN t.start_us AND t.end_us), prows AS (SELECT * FROM prow, thr), {flagged('prows', 'asset_id, scope_id, threshold', 'threshold', 'p')},
pper AS (SELECT a.asset_id, s.scope_id, s.start_us AS lo, s.end_us AS hi FROM stretch s, (SELECT DISTINCT asset_id FROM prow) a),
phole AS (SELECT asset_id, scope_id, CAST(sum(us - s) AS BIGINT) AS t FROM (SELECT asset_id, scope_id, us, lag(us) OVER (PARTITION BY asset_id, scope_id ORDER BY us) AS s FROM prow) WHERE us - s > {SCORE_GAP} GROUP BY ALL),
pdays AS (SELECT asset_id, sum(greatest(hi - lo - coalesce(t, 0), 0) / 86400000000.0) AS days FROM pper LEFT JOIN phole USING (asset_id, scope_id) GROUP BY asset_id),
pool AS (SELECT d.asset_id, h.threshold, coalesce(n.n, 0) AS n_episodes, d.days, CASE WHEN d.days > 0 THEN coalesce(n.n, 0) / d.days ELSE 0.0 END AS rate FROM pdays d CROSS JOIN thr h LEFT JOIN (SELECT asset_id, threshold, count(*) AS n FROM p5 GROUP BY ALL) n USING (asset_id, threshold))"""

# Whole evaluations of the rule model: training (t), history (h) and stretch (s) rows of each fold go through the same
# expressions, told apart by a series name of kind/event/asset/scope.
EV_PREFIX = f"""{REG.replace("reg AS (", "reg0 AS (")}, {FOLDS}, {STRETCH.removeprefix(EVENTS).removeprefix(",")}, {MASKS},
ext AS (SELECT f.*, greatest(f.test_end, coalesce((SELECT arg_min(x.x0, x.start_us) FROM ev x WHERE x.start_us > f.event_start_us), de)) AS ext_end FROM fold f, bounds),
reg AS (SELECT 't/' || f.event_id || '/' || asset_id || '/' AS asset_id, us, value, regime FROM reg0 r JOIN fold f ON r.us >= f.train_start AND r.us < f.train_end WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE h.event_id = f.event_id AND r.us >= h.start_us AND r.us < h.end_us)
  UNION ALL SELECT 'h/' || f.event_id || '/' || asset_id || '/', us, value, regime FROM reg0 r JOIN ext f ON r.us BETWEEN f.train_start AND f.ext_end
  UNION ALL SELECT 's/' || f.event_id || '/' || asset_id || '/' || s.scope_id, us, value, regime FROM reg0 r JOIN stretch s ON r.us BETWEEN s.start_us AND s.end_us CROSS JOIN fold f)"""


def _ev_rank(q: str) -> str:
    return f"""pt_{q} AS (SELECT k, {q} AS v, sum(t) AS t FROM (SELECT k, {q}, 1 AS t FROM qk WHERE kind = 't' UNION ALL SELECT k, {q}, 0 FROM qk) WHERE {q} IS NOT NULL GROUP BY ALL),
rk_{q} AS (SELECT k, v, CASE WHEN sum(t) OVER (PARTITION BY k) = 0 THEN 0.5 ELSE (2 * sum(t) OVER (PARTITION BY k ORDER BY v {SO_FAR}) - t) / (2.0 * sum(t) OVER (PARTITION BY k)) END AS rk FROM pt_{q})"""


_ev_severities = [f"CASE WHEN rk_{q}.rk IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, {'1 - 2 * ' if side == 'low' else '2 * '}rk_{q}.rk{'' if side == 'low' else ' - 1'})) END" for side, q in RULE_COLUMNS.values()]
_ev_quantiles = f"(VALUES {', '.join(f'({p!r}e0)' for p in P.QUANTILES)}) t(quantile)"
_ev_widths = f"(VALUES {', '.join(f'({w!r}e0)' for w in P.WIDTHS)}) t(width_h)"
EV_SCORES = f"""{QUANTITIES.replace(REG, EV_PREFIX)},
qk AS (SELECT *, split_part(asset_id, '/', 1) AS kind, split_part(asset_id, '/', 2) || '/' || split_part(asset_id, '/', 3) AS k FROM quant),
{', '.join(_ev_rank(q) for _, q in RULE_COLUMNS.values())},
sc AS (SELECT kind, CAST(split_part(d.asset_id, '/', 2) AS INTEGER) AS event_id, split_part(d.asset_id, '/', 3) AS asset_id, split_part(d.asset_id, '/', 4) AS scope_id, us, greatest({', '.join(_ev_severities)}) AS score
  FROM qk d {' '.join(f'LEFT JOIN rk_{q} ON rk_{q}.k = d.k AND rk_{q}.v = d.{q}' for _, q in RULE_COLUMNS.values())}),
cut AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT event_id, asset_id, {p!r}e0 AS quantile, quantile_cont(score, {p!r}) AS threshold FROM sc WHERE kind = 't' GROUP BY event_id, asset_id" for p in P.QUANTILES)})),
etest AS (SELECT s.event_id, s.asset_id, s.us, s.score FROM sc s JOIN ext f USING (event_id) WHERE kind = 'h' AND s.us BETWEEN f.test_start AND f.ext_end)"""
EV_EPISODES = f"""{EV_SCORES},
erows AS (SELECT e.*, quantile, threshold FROM etest e JOIN cut USING (event_id, asset_id)), {flagged('erows', 'event_id, asset_id, quantile', 'threshold', 'w')}"""
EV_RESULTS = f"""{EV_EPISODES},
wid AS (SELECT * FROM {_ev_widths}), qs AS (SELECT * FROM {_ev_quantiles}),
ecat AS (SELECT e.*, width_h, f.event_start_us, CASE WHEN e.start_us <= f.event_start_us AND e.end_us >= f.event_start_us - CAST(width_h * {P.HOUR} AS BIGINT) THEN 'early_warning' WHEN e.start_us <= f.event_end_us AND e.end_us >= f.event_start_us THEN 'concurrent'
  WHEN EXISTS (SELECT 1 FROM masks m WHERE e.start_us <= m.end_us AND e.end_us >= m.start_us) THEN 'masked' ELSE 'false_alarm' END AS category FROM w5 e JOIN fold f USING (event_id) CROSS JOIN wid),
eper AS (SELECT a.asset_id, f.event_id, f.test_start AS lo, f.ext_end AS hi FROM ext f, (SELECT DISTINCT asset_id FROM etest) a),
miss0 AS (SELECT event_id, asset_id, greatest(m.start_us, lo) AS start_us, least(m.end_us, hi) AS end_us FROM eper, masks m UNION ALL
  SELECT event_id, asset_id, greatest(s, lo), least(us, hi) FROM (SELECT event_id, asset_id, lag(us) OVER (PARTITION BY event_id, asset_id ORDER BY us) AS s, us FROM etest) JOIN eper USING (event_id, asset_id) WHERE us - s > {SCORE_GAP}),
miss AS (SELECT * FROM miss0 WHERE end_us > start_us), {union_of('miss', 'lost', 'event_id, asset_id')},
edays AS (SELECT p.event_id, p.asset_id, greatest(hi - lo - coalesce(l.t, 0), 0) / 86400000000.0 AS days FROM eper p LEFT JOIN (SELECT event_id, asset_id, CAST(sum(end_us - start_us) AS BIGINT) AS t FROM lost GROUP BY ALL) l USING (event_id, asset_id)),
eplace AS (SELECT event_id, asset_id, width_h, quantile, lo, CAST(width_h * {P.HOUR} AS BIGINT) AS w, lo + CAST(floor(i * (hi - lo) / {N - 1}) AS BIGINT) AS t FROM eper CROSS JOIN wid CROSS JOIN qs, range(0, {N}) g(i)),
eperm AS (SELECT p.event_id, p.asset_id, p.width_h, p.quantile, avg(CAST(EXISTS (SELECT 1 FROM w5 e WHERE e.event_id = p.event_id AND e.asset_id = p.asset_id AND e.quantile = p.quantile AND e.start_us <= p.t AND e.end_us >= p.t - p.w) AS DOUBLE)) AS p_permutation, count(*) AS n_valid FROM eplace p WHERE t - w >= lo GROUP BY ALL),
eres0 AS (SELECT d.event_id, d.asset_id, wid.width_h, qs.quantile, coalesce(c.n, 0) AS n_episodes, coalesce(c.fa, 0) AS n_false_alarms, coalesce(c.ma, 0) AS n_masked, coalesce(c.det, FALSE) AS detected, NOT coalesce(c.det, FALSE) AND coalesce(c.con, FALSE) AS concurrent_only, c.lead_h, d.days,
  CASE WHEN d.days > 0 THEN coalesce(c.fa, 0) / d.days ELSE 0.0 END AS false_alarms_per_day FROM edays d CROSS JOIN wid CROSS JOIN qs LEFT JOIN (SELECT event_id, asset_id, width_h, quantile, count(*) AS n, count(*) FILTER (category = 'false_alarm') AS fa, count(*) FILTER (category = 'masked') AS ma, bool_or(category = 'early_warning') AS det, bool_or(category = 'concurrent') AS con,
  (any_value(event_start_us) - min(start_us) FILTER (category = 'early_warning')) / 3.6e9 AS lead_h FROM ecat GROUP BY ALL) c ON c.event_id = d.event_id AND c.asset_id = d.asset_id AND c.width_h = wid.width_h AND c.quantile = qs.quantile),
eres AS (SELECT r.*, 1 - exp(-false_alarms_per_day * r.width_h / 24) AS p_poisson, p.p_permutation, p.n_valid FROM eres0 r LEFT JOIN eperm p USING (event_id, asset_id, width_h, quantile))"""
EV_POOLED = f"""{EV_SCORES},
erows AS (SELECT s.event_id, s.scope_id, s.asset_id, s.us, s.score, quantile, threshold FROM sc s JOIN cut USING (event_id, asset_id) WHERE kind = 's'), {flagged('erows', 'event_id, scope_id, asset_id, quantile', 'threshold', 'p')},
hole AS (SELECT event_id, scope_id, asset_id, CAST(sum(us - s) AS BIGINT) AS t FROM (SELECT event_id, scope_id, asset_id, us, lag(us) OVER (PARTITION BY event_id, scope_id, asset_id ORDER BY us) AS s FROM sc WHERE kind = 's') WHERE us - s > {SCORE_GAP} GROUP BY ALL),
pdays AS (SELECT a.event_id, a.asset_id, sum(greatest(s.end_us - s.start_us - coalesce(t, 0), 0) / 86400000000.0) AS days FROM (SELECT DISTINCT event_id, asset_id FROM sc WHERE kind = 't') a CROSS JOIN stretch s LEFT JOIN hole h ON h.event_id = a.event_id AND h.asset_id = a.asset_id AND h.scope_id = CAST(s.scope_id AS VARCHAR) GROUP BY ALL),
pool AS (SELECT d.event_id, d.asset_id, qs.quantile, coalesce(n.n, 0) AS n_episodes, d.days, CASE WHEN d.days > 0 THEN coalesce(n.n, 0) / d.days ELSE 0.0 END AS rate FROM pdays d CROSS JOIN (SELECT * FROM {_ev_quantiles}) qs LEFT JOIN (SELECT event_id, asset_id, quantile, count(*) AS n FROM p5 GROUP BY ALL) n ON n.event_id = d.event_id AND n.asset_id = d.asset_id AND n.quantile = qs.quantile)"""


def scaler(center: str, scale: str) -> str:
    return f"WITH {TEL} SELECT asset_id, 'value' AS channel, {r(center, 'center')}, {r(f'CASE WHEN abs({scale}) < 1e-8 THEN 1.0 ELSE {scale} END', 'scale')}, count(*) AS n FROM tel GROUP BY asset_id"


def q(p: float, x: str = "value") -> str:
    return f"quantile_cont({x}, {p})"


_agree = lambda a, b: f"SELECT '{a[0]}' AS flag_a, '{b[0]}' AS flag_b, {r(f'avg(CAST(coalesce(({a[1]}) = ({b[1]}), FALSE) AS DOUBLE))', 'agreement')} FROM tel"
_flags = [("is_click", "CASE WHEN is_click = 1 THEN 'on' ELSE 'off' END"), ("is_error", "CASE WHEN is_error = 1 THEN 'off' ELSE 'on' END"), ("is_view", "CASE WHEN is_view = 1 THEN 'on' END")]
_month = lambda c: f"strftime(make_timestamp({c}), '%Y-%m')"
_stat_w = f"{BY} ROWS BETWEEN {P.LENGTH - 1} PRECEDING AND CURRENT ROW"
WIN = f"""win AS (SELECT *, row_number() OVER ({BY}) - 1 AS rn, first_value(us) OVER ({_stat_w}) AS start_us, first_value(value) OVER ({_stat_w}) AS v0, avg(CAST(CAST(value AS FLOAT) AS DOUBLE)) OVER ({_stat_w}) AS m, stddev_pop(CAST(CAST(value AS FLOAT) AS DOUBLE)) OVER ({_stat_w}) AS sd, min(CAST(value AS FLOAT)) OVER ({_stat_w}) AS lo, max(CAST(value AS FLOAT)) OVER ({_stat_w}) AS hi FROM tel)"""
WIN_OK = f"rn >= {P.LENGTH - 1} AND (rn - {P.LENGTH - 1}) % {P.STRIDE} = 0 AND us - start_us <= {P.LENGTH * P.INTERVAL_US * (1 + P.TOLERANCE)!r}"
_base = f"base AS (SELECT *, median(value) OVER ({frame(P.DAY)}) AS b, min(us) OVER (PARTITION BY asset_id) AS first_us FROM tel)"
ACTIVE = "regime IN ('LOADED', 'OFFLOAD', 'STOPPED')"

ORACLE_SQL: dict[str, str] = {
    "regime_labels": f"WITH {REG} SELECT asset_id, us, regime FROM reg",
    "regime_occupancy": f"WITH {runs(None)}, occ AS (SELECT regime, count(*) AS n_rows FROM reg GROUP BY regime), ru AS (SELECT regime, count(*) AS n_runs, {q(.5, 'duration_s')} AS a, {q(.25, 'duration_s')} AS b, {q(.75, 'duration_s')} AS c FROM runs GROUP BY regime) SELECT regime, n_rows, {r('n_rows * 100.0 / (SELECT count(*) FROM reg)', 'percent')}, n_runs, {r('a', 'median_s')}, {r('b', 'q25_s')}, {r('c', 'q75_s')} FROM occ JOIN ru USING (regime)",
    "channel_stats": f"WITH {REG} SELECT regime, 'value' AS channel, {r(q(.5), 'median')}, {r(f'{q(.75)} - {q(.25)}', 'iqr')} FROM reg GROUP BY GROUPING SETS ((), (regime))",
    "run_lengths": f"WITH {runs(GAP)} SELECT asset_id, run_id, regime, start_us, end_us, n, {r('duration_s', 'duration_s')}, gap_truncated, start_is_gap_continuation FROM runs",
    "flag_semantics": f"WITH {TEL}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS flag, {c} AS level, value FROM tel" for c in ("is_click", "is_error", "is_view")) + f") SELECT flag, level, count(*) AS n, {r('avg(value)', 'value_mean')}, {r(q(.5), 'value_median')} FROM f GROUP BY flag, level",
    "flag_agreement": f"WITH {TEL} " + " UNION ALL ".join(_agree(_flags[i], _flags[j]) for i, j in ((0, 1), (0, 2), (1, 2))),
    "monthly_gap_runs": f"WITH {runs(GAP)}, g AS (SELECT {_month('us')} AS month, count(*) AS n, sum(d) / 1e6 AS s FROM (SELECT us, lead(us) OVER ({BY}) - us AS d FROM reg) WHERE d > {GAP} GROUP BY 1), u AS (SELECT {_month('start_us')} AS month, count(*) AS n, {q(.5, 'duration_s')} AS m FROM runs WHERE regime = 'STOPPED' GROUP BY 1) SELECT coalesce(g.month, u.month) AS month, coalesce(g.n, 0) AS n_gaps, {r('coalesce(g.s, 0.0)', 'gap_s')}, coalesce(u.n, 0) AS n_runs, {r('u.m', 'median_run_s')} FROM g FULL JOIN u ON g.month = u.month",
    "sampling_profile": f"WITH {TEL}, t AS (SELECT DISTINCT asset_id, us // {P.MIN} * {P.MIN} AS us FROM tel), d AS (SELECT asset_id, us, us - lag(us) OVER ({BY}) AS i FROM t), c AS (SELECT asset_id, i, count(*) AS n, min(us) AS met FROM d WHERE i IS NOT NULL GROUP BY ALL), m AS (SELECT asset_id, i AS mode_us FROM c QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, met) = 1) SELECT d.asset_id, count(*) AS n_rows, {r('sum(i) / 1e6', 'span_s')}, count(*) FILTER (i > {GAP}) AS n_gaps, {r(f'coalesce(sum(i) FILTER (i > {GAP}), 0) / 1e6', 'gap_s')}, {r('max(i) / 1e6', 'largest_s')}, any_value(mode_us) AS mode_us FROM d JOIN m USING (asset_id) GROUP BY d.asset_id",
    "gap_list": f"WITH {TEL} SELECT asset_id, s AS start_us, us AS end_us FROM (SELECT asset_id, us, lag(us) OVER ({BY}) AS s FROM tel) WHERE us - s > {GAP}",
    "gap_adjacent": f"WITH {TEL}, g AS (SELECT asset_id, s, us AS e FROM (SELECT asset_id, us, lag(us) OVER ({BY}) AS s FROM tel) WHERE us - s > {2 * P.HOUR}) SELECT asset_id, us, EXISTS (SELECT 1 FROM g WHERE g.asset_id = t.asset_id AND (abs(t.us - g.s) <= {30 * P.MIN} OR abs(t.us - g.e) <= {30 * P.MIN})) AS gap_adjacent FROM tel t",
    "largest_gaps": f"WITH {TEL} SELECT asset_id, s AS start_us, us AS end_us FROM (SELECT asset_id, us, lag(us) OVER ({BY}) AS s FROM tel) WHERE us - s > {GAP} ORDER BY us - s DESC, asset_id, s LIMIT 15",
    "interval_histogram": f"WITH {TEL} SELECT (us - s) // {P.MIN} AS minutes, count(*) AS n FROM (SELECT us, lag(us) OVER ({BY}) AS s FROM tel) WHERE s IS NOT NULL GROUP BY 1 ORDER BY n DESC, minutes LIMIT 10",
    "resample_grid": f"WITH {TEL}, b AS (SELECT asset_id, o + (us - o) // {20 * P.MIN} * {20 * P.MIN} AS bin_us, avg(value) AS value, max(is_click) AS is_click FROM (SELECT *, min(us) OVER (PARTITION BY asset_id) // {P.DAY} * {P.DAY} AS o FROM tel) GROUP BY ALL), g AS (SELECT asset_id, unnest(range(min(bin_us), max(bin_us) + 1, {20 * P.MIN})) AS bin_us FROM b GROUP BY asset_id) SELECT g.asset_id, g.bin_us, {r('b.value', 'value')}, {r('b.is_click', 'is_click')} FROM g LEFT JOIN b USING (asset_id, bin_us)",
    "window_index": f"WITH {TEL}, {WIN} SELECT asset_id, start_us, us AS end_us FROM win WHERE {WIN_OK}",
    "window_stats": f"WITH {TEL}, {WIN} SELECT asset_id, us, {r('m', 'value_mean', 4)}, {r('sd', 'value_std', 4)}, {r('CAST(lo AS DOUBLE)', 'value_min', 4)}, {r('CAST(hi AS DOUBLE)', 'value_max', 4)}, {r(f'(CAST(CAST(value AS FLOAT) AS DOUBLE) - CAST(CAST(v0 AS FLOAT) AS DOUBLE)) / {P.LENGTH}', 'value_slope', 4)} FROM win WHERE {WIN_OK}",
    "last_completed_duration": f"WITH {FEATURES} SELECT asset_id, us, {r('stopped_duration_last', 'stopped_duration_last')}, run_gap_truncated AS stopped_duration_last_gap FROM feat",
    "running_elapsed": f"WITH {runs(GAP)} SELECT asset_id, us, {r(RUNNING, 'running_elapsed_s')} FROM rows2",
    "running_slope": f"WITH {runs(GAP)} SELECT asset_id, us, {r(running_slope(), 'running_slope')} FROM rows2",
    "last_run_slope": f"WITH {runs(GAP)} SELECT asset_id, run_id, {r('slope', 'slope')}, {r(last_completed('STOPPED', 'slope', False) + '.v', 'decay_rate_last')} FROM runs",
    "last_run_peak": f"WITH {FEATURES} SELECT asset_id, us, {r('peak_last', 'last_peak')} FROM feat",
    "cycle_period": f"WITH {runs(GAP)}, {PERIOD} SELECT asset_id, run_id, {r('period', 'cycle_period_s')} FROM per",
    "duty_ratio": f"WITH {FEATURES} SELECT asset_id, us, {r('duty_ratio_trailing', 'duty_ratio')} FROM feat",
    "baseline_trailing": f"WITH {TEL}, {_base} SELECT asset_id, us, {r(ratio('value', 'b'), 'relative')} FROM base",
    "baseline_lagged": f"WITH {TEL}, {_base}, b2 AS (SELECT asset_id, us, CASE WHEN us - first_us >= {P.DAY} THEN b END AS b FROM base) SELECT t.asset_id, t.us, {r(ratio('t.value', 'b2.b'), 'relative')} FROM tel t ASOF LEFT JOIN b2 ON t.asset_id = b2.asset_id AND t.us - {2 * P.DAY} >= b2.us",
    "cycle_features": f"WITH {FEATURES}, m AS (SELECT *, {_med('stopped_duration_last')} AS b1, {_med('cycle_period_last')} AS b2, {_med('decay_rate_last')} AS b3 FROM feat) SELECT asset_id, us, " + ", ".join(r(c, c) for c in ("stopped_duration_last", "offload_duration_last", "loaded_duration_last", "stopped_elapsed", "cycle_period_last", "duty_ratio_trailing", "decay_rate_last", "decay_rate_running")) + ", run_gap_truncated, " + ", ".join(r(ratio(c, b), f"{c}_rel_baseline") for c, b in (("stopped_duration_last", "b1"), ("cycle_period_last", "b2"), ("decay_rate_last", "b3"))) + " FROM m",
    "robust_scaler": scaler(q(0.5), f"({q(0.75)} - {q(0.25)})"),
    "standard_scaler": scaler("avg(value)", "stddev_pop(value)"),
    "minmax_scaler": scaler("min(value)", "(max(value) - min(value))"),
    "scaler_by_regime": f"WITH {REG} SELECT asset_id, regime, 'value' AS channel, {r(q(.5), 'center')}, {r(f'CASE WHEN abs({q(.75)} - {q(.25)}) < 1e-8 THEN 1.0 ELSE {q(.75)} - {q(.25)} END', 'scale')}, count(*) AS n FROM reg GROUP BY asset_id, regime",
    "scaled_rows": f"WITH {REG}, s AS (SELECT asset_id, regime, round({q(.5)}, 12) AS c, {q(.75)} - {q(.25)} AS s FROM reg GROUP BY asset_id, regime) SELECT asset_id, us, regime, {r(f'CASE WHEN {ACTIVE} THEN (value - c) / CASE WHEN abs(s) < 1e-8 THEN 1.0 ELSE s END ELSE 0.0 END', 'value')}, {r('is_click', 'is_click')} FROM reg JOIN s USING (asset_id, regime)",
    "exclusion_union": f"WITH {EVENTS}, x AS (SELECT x0 AS start_us, x1 AS end_us FROM ev UNION ALL SELECT start_us, end_us FROM regions), {union_of('x', 'u')} SELECT start_us, end_us FROM u",
    "gap_union": f"WITH {TEL}, x AS (SELECT asset_id, s - {P.HOUR} AS start_us, us + {P.HOUR} AS end_us FROM (SELECT asset_id, us, lag(us) OVER ({BY}) AS s FROM tel) WHERE us - s > {GAP}), {union_of('x', 'u', 'asset_id')} SELECT asset_id, start_us, end_us FROM u",
    "normal_stretches": f"WITH {STRETCH} SELECT scope_id, start_us, end_us FROM stretch",
    "fold_plan_table": f"WITH {FOLDS} SELECT f.event_id, train_start, train_end, test_start, test_end, CAST(count(h.start_us) AS INTEGER) AS n_exclusions, {r('(train_end - train_start - coalesce(sum(h.end_us - h.start_us), 0)) / 86400000000.0', 'training_days')} FROM fold f LEFT JOIN holes h USING (event_id) GROUP BY f.event_id, train_start, train_end, test_start, test_end",
    "max_width": f"WITH {EVENTS} SELECT e.event_id, {r('greatest(0, least(e.start_us - 2 * e.emb - ds - 1000000, coalesce((SELECT min(e.start_us - e.emb - x.x1) FROM ev x WHERE x.start_us < e.start_us), 9000000000000000000))) / 3.6e9', 'width_h')} FROM ev e, bounds",
    "train_slice": f"WITH {TRAIN} SELECT event_id, asset_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM train GROUP BY ALL",
    "test_slice": f"WITH {TRAIN} SELECT event_id, asset_id, us FROM test",
    "window_coverage": f"WITH {EVENTS}, {TEL}, w AS (SELECT event_id, width_h, start_us - CAST(width_h * {P.HOUR} AS BIGINT) AS lo, start_us AS hi FROM ev, (VALUES {', '.join(f'({w!r}e0)' for w in P.WIDTHS)}) t(width_h)) SELECT a.asset_id, w.event_id, w.width_h, {r(f'least(1.0, (SELECT count(*) FROM tel t WHERE t.asset_id = a.asset_id AND t.us >= w.lo AND t.us < w.hi) / ((w.hi - w.lo) / {P.INTERVAL_US}.0))', 'coverage')} FROM w, (SELECT DISTINCT asset_id FROM tel) a",
    "threshold_sweep": f"WITH {TRAIN} " + " UNION ALL ".join(f"SELECT event_id, asset_id, {p!r}e0 AS quantile, {r(q(p, 'value / 100'), 'threshold')} FROM train GROUP BY event_id, asset_id" for p in P.QUANTILES),
    "percentile_rank": f"WITH {TRAIN} SELECT x.event_id, x.asset_id, x.us, {r('(count(*) FILTER (t.value < x.value) + count(*) FILTER (t.value <= x.value)) / (2.0 * count(*))', 'percentile')} FROM test x JOIN train t USING (event_id, asset_id) GROUP BY x.event_id, x.asset_id, x.us",
    "score_shift": f"WITH {TRAIN}, a AS (SELECT event_id, {q(.5, 'value / 100')} AS m, {q(.99, 'value / 100')} AS p, max(value / 100) AS x FROM train GROUP BY event_id) SELECT a.event_id, {r('any_value(a.m)', 'train_median')}, {r('any_value(a.p)', 'train_p99')}, {r('any_value(a.x)', 'train_max')}, {r(q(.5, 'value / 100'), 'test_median')}, {r(q(.99, 'value / 100'), 'test_p99')}, {r('max(value / 100)', 'test_max')}, {r('avg(CAST(value / 100 > a.p AS DOUBLE))', 'share_above_p99')} FROM test JOIN a USING (event_id) GROUP BY a.event_id",
    "median_imputation": f"WITH {TEL}, m AS (SELECT asset_id, {q(.5)} AS m FROM tel WHERE is_view = 0 GROUP BY asset_id) SELECT asset_id, us, {r('CASE WHEN is_view = 0 THEN value ELSE m END', 'x')} FROM tel JOIN m USING (asset_id)",
    "rule_severity": f"WITH {RULES} SELECT asset_id, us, {', '.join(r(c, c) for c in RULE_COLUMNS)} FROM sev",
    "rule_score": f"WITH {RULES} SELECT asset_id, us, {r('greatest(' + ', '.join(RULE_COLUMNS) + ')', 'score')} FROM sev",
    "alert_episodes": f"WITH {SCORED}, {flagged('scored', 'asset_id', str(P.SCORE_THRESHOLD))} SELECT e.asset_id, e.episode, e.start_us, e.end_us, {r('max(s.score)', 'peak')}, count(*) AS n_rows FROM e5 e JOIN scored s ON s.asset_id = e.asset_id AND s.us BETWEEN e.start_us AND e.end_us GROUP BY ALL",
    "episode_ranking": f"WITH {SCORED}, {flagged('scored', 'asset_id', str(P.SCORE_THRESHOLD))}, m AS (SELECT e.asset_id, e.episode, s.* EXCLUDE (asset_id) FROM e5 e JOIN scored s ON s.asset_id = e.asset_id AND s.us BETWEEN e.start_us AND e.end_us), l AS (" + " UNION ALL ".join(f"SELECT asset_id, episode, '{c}' AS contributor, avg({c}) AS v FROM m GROUP BY ALL" for c in ("is_click", "is_error", "is_view", "score")) + f") SELECT asset_id, episode, contributor, {r('v', 'value')}, CAST(row_number() OVER (PARTITION BY asset_id, episode ORDER BY v DESC, contributor) AS INTEGER) AS place FROM l",
    "episode_categories": f"WITH {FOLD_EP} SELECT event_id, asset_id, start_us, end_us, category FROM cats",
    "evaluated_days": f"WITH {FOLD_EP} SELECT event_id, asset_id, {r('days', 'days')} FROM days",
    "fold_evaluation": f"WITH {FOLD_EP} SELECT event_id, asset_id, n_episodes, n_false_alarms, n_masked, detected, concurrent_only, {r('lead_h', 'lead_h')}, {r('days', 'days')}, {r('false_alarms_per_day', 'false_alarms_per_day')} FROM res",
    "pooled_false_alarms": f"WITH {POOLED} SELECT asset_id, threshold, n_episodes, {r('days', 'days')}, {r('rate', 'rate')} FROM pool",
    "operating_point": f"WITH {POOLED}, w AS (SELECT threshold, max(rate) AS worst FROM pool GROUP BY threshold) SELECT min(threshold) FILTER (worst <= 3.0) IS NOT NULL AS found, min(threshold) FILTER (worst <= 3.0) AS quantile FROM w",
    "chance_poisson": f"WITH {FOLD_EP} SELECT event_id, asset_id, {r('1 - exp(-false_alarms_per_day)', 'p_poisson')} FROM res",
    "chance_permutation": f"WITH {PERM} SELECT event_id, asset_id, {r('p_permutation', 'p_permutation')}, n_valid FROM perm",
    "skill_table": f"WITH RECURSIVE {PERM}, j AS (SELECT asset_id, detected, p_permutation AS p, row_number() OVER (PARTITION BY asset_id ORDER BY event_id) AS i FROM res JOIN perm USING (event_id, asset_id)), outcomes AS (SELECT asset_id, CAST(0 AS BIGINT) AS i, 0 AS hits, 1.0e0 AS pr FROM (SELECT DISTINCT asset_id FROM j) UNION ALL SELECT o.asset_id, o.i + 1, o.hits + b.b, o.pr * CASE WHEN b.b = 1 THEN j.p ELSE 1 - j.p END FROM outcomes o JOIN j ON j.asset_id = o.asset_id AND j.i = o.i + 1, (VALUES (0), (1)) b(b)), g AS (SELECT asset_id, sum(p) AS expected, CAST(count(*) FILTER (detected) AS INTEGER) AS observed, max(i) AS n FROM j GROUP BY asset_id) SELECT g.asset_id, {r('any_value(expected)', 'expected')}, any_value(observed) AS observed, {r('sum(pr) FILTER (hits >= observed)', 'p_skill')} FROM g JOIN outcomes o ON o.asset_id = g.asset_id AND o.i = g.n GROUP BY g.asset_id",
    "describe_channels": f"WITH {TEL} " + " UNION ALL ".join(f"SELECT '{c}' AS channel, count({c}) AS n, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'lo')}, {r(q(.25, c), 'q25')}, {r(q(.5, c), 'median')}, {r(q(.75, c), 'q75')}, {r(f'max({c})', 'hi')} FROM tel" for c in ("value", "is_error")),
    "flag_separation": f"WITH {TEL} " + " UNION ALL ".join(f"SELECT '{c}' AS flag, {r(f'abs(avg({c}) FILTER (value < 35) - avg({c}) FILTER (value >= 35))', 'separation')} FROM tel" for c in ("is_click", "is_error", "is_view")),
    "mode_shift": f"WITH {TEL}, a AS (SELECT {q(.25)} AS a, {q(.5)} AS b, {q(.75)} AS c FROM tel WHERE is_click = 1), z AS (SELECT {q(.25)} AS a, {q(.5)} AS b, {q(.75)} AS c FROM tel WHERE is_click <> 1) SELECT {r('a.b', 'low_median')}, {r('a.c - a.a', 'low_iqr')}, {r('z.b', 'high_median')}, {r('z.c - z.a', 'high_iqr')}, {r('abs(a.b - z.b)', 'shift')}, {r('(SELECT avg(CAST(value BETWEEN 30 AND 40 AS DOUBLE)) FROM tel)', 'valley_share')} FROM a, z",
    "stats_drift": f"WITH {TEL}, a AS (SELECT {q(.5)} AS m, {q(.75)} - {q(.25)} AS i FROM tel WHERE us < {at(P.EVENTS[1].start)}), z AS (SELECT {q(.5)} AS m, {q(.75)} - {q(.25)} AS i FROM tel) SELECT 'value' AS channel, {r('a.m', 'part_center')}, {r('a.i', 'part_iqr')}, {r('z.m', 'whole_center')}, {r('z.i', 'whole_iqr')}, {r('(a.m - z.m) / z.m * 100', 'center_percent')}, {r('(a.i - z.i) / z.i * 100', 'iqr_percent')} FROM a, z",
    "smoothed_durations": f"WITH {REG}, s0 AS (SELECT asset_id, us, CASE WHEN us - lag(us) OVER ({BY}) > {GAP} OR lag(us) OVER ({BY}) IS NULL THEN 1 ELSE 0 END AS fresh FROM reg WHERE regime = 'STOPPED'), s1 AS (SELECT *, CAST(sum(fresh) OVER ({BY} {SO_FAR}) AS BIGINT) AS run_id FROM s0), s2 AS (SELECT asset_id, run_id, min(us) AS start_us, (max(us) - min(us)) / 1e6 AS duration_s FROM s1 GROUP BY ALL) SELECT asset_id, run_id, start_us, {r('duration_s', 'duration_s')}, {r('CASE WHEN count(*) OVER w >= 20 THEN median(duration_s) OVER w END', 'smoothed_s')} FROM s2 WINDOW w AS (PARTITION BY asset_id ORDER BY run_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "max_against_train": f"WITH {TRAIN}, t AS (SELECT event_id, asset_id, max(value / 100) AS top FROM test GROUP BY ALL) SELECT event_id, asset_id, {r('any_value(top)', 'top')}, {r('avg(CAST(value / 100 < top AS DOUBLE)) * 100', 'percent_below')} FROM train JOIN t USING (event_id, asset_id) GROUP BY event_id, asset_id",
    "rule_evaluation": f"WITH {EV_RESULTS} SELECT event_id, asset_id, width_h, quantile, n_episodes, n_false_alarms, n_masked, detected, concurrent_only, {r('lead_h', 'lead_h')}, {r('days', 'days')}, {r('false_alarms_per_day', 'false_alarms_per_day')}, {r('p_poisson', 'p_poisson')}, {r('p_permutation', 'p_permutation')}, n_valid, detected AND (p_poisson > {P.EVALUATION.chance_threshold} OR p_permutation > {P.EVALUATION.chance_threshold}) AS explained_by_chance FROM eres",
    "rule_pooled": f"WITH {EV_POOLED} SELECT event_id, asset_id, quantile, n_episodes, {r('days', 'days')}, {r('rate', 'rate')} FROM pool",
    "rule_shift": f"WITH {EV_SCORES}, a AS (SELECT event_id, {q(.5, 'score')} AS m, {q(.99, 'score')} AS p, max(score) AS x FROM sc WHERE kind = 't' GROUP BY event_id) SELECT a.event_id, {r('any_value(a.m)', 'train_median')}, {r('any_value(a.p)', 'train_p99')}, {r('any_value(a.x)', 'train_max')}, {r(q(.5, 'score'), 'test_median')}, {r(q(.99, 'score'), 'test_p99')}, {r('max(score)', 'test_max')}, {r('avg(CAST(score > a.p AS DOUBLE))', 'share_above_p99')} FROM etest JOIN a USING (event_id) GROUP BY a.event_id",
    "rule_episodes": f"WITH {EV_EPISODES} SELECT event_id, asset_id, quantile, episode, start_us, end_us FROM w5",
    "rule_calibration": f"WITH {EV_SCORES} " + " UNION ALL ".join(f"SELECT CAST(split_part(asset_id, '/', 2) AS INTEGER) AS event_id, split_part(asset_id, '/', 3) AS asset_id, '{name}' AS rule, {r(f'quantile_cont({c}, 0.05)', 'value')} FROM qk WHERE kind = 't' GROUP BY ALL" for name, (_, c) in RULE_COLUMNS.items()),
    "train_validation": f"WITH {TRAIN}, n AS (SELECT event_id, asset_id, us, row_number() OVER (PARTITION BY event_id, asset_id ORDER BY us) AS i, count(*) OVER (PARTITION BY event_id, asset_id) AS n FROM train) SELECT event_id, asset_id, us, i > n - least(round_even(n * 0.15, 0), n - 1) AS validation FROM n",
    "fold_history": f"WITH {FOLDS}, {TEL} SELECT f.event_id, t.asset_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM tel t JOIN (SELECT f.*, greatest(f.test_end, coalesce((SELECT arg_min(x.x0, x.start_us) FROM ev x WHERE x.start_us > f.event_start_us), de)) AS ext_end FROM fold f, bounds) f ON t.us BETWEEN f.train_start AND f.ext_end GROUP BY ALL",
    "since_change": f"WITH {REG}, c AS (SELECT *, CASE WHEN lag(regime) OVER ({BY}) IS DISTINCT FROM regime THEN us END AS c FROM reg) SELECT asset_id, us, us - last_value(c IGNORE NULLS) OVER ({BY} {SO_FAR}) AS held_us FROM c",
    "plain_scaled_rows": f"WITH {TEL}, s AS (SELECT asset_id, {q(.5)} AS c, {q(.75)} - {q(.25)} AS s FROM tel GROUP BY asset_id) SELECT asset_id, us, {r('(value - c) / CASE WHEN abs(s) < 1e-8 THEN 1.0 ELSE s END', 'value')}, {r('is_click', 'is_click')} FROM tel JOIN s USING (asset_id)",
    "amplifying_scalers": f"WITH {REG}, s AS (SELECT asset_id, regime, {q(.75)} - {q(.25)} AS i FROM reg GROUP BY ALL), t AS (SELECT asset_id, regime, CASE WHEN abs(i) < 1e-8 THEN 1.0 ELSE i END AS scale FROM s) SELECT asset_id, regime, 'value' AS channel, {r('scale', 'scale')} FROM t WHERE {ACTIVE} AND 1 / scale > 0.02",
    "episode_overview": f"WITH {SCORED}, {flagged('scored', 'asset_id', str(P.SCORE_THRESHOLD))}, m AS (SELECT e.asset_id, e.episode, s.* EXCLUDE (asset_id) FROM e5 e JOIN scored s ON s.asset_id = e.asset_id AND s.us BETWEEN e.start_us AND e.end_us), l AS (" + " UNION ALL ".join(f"SELECT asset_id, episode, '{c}' AS contributor, avg({c}) AS v FROM m GROUP BY ALL" for c in ("is_click", "is_error", "is_view", "score")) + f"), k AS (SELECT *, row_number() OVER (PARTITION BY asset_id, episode ORDER BY v DESC, contributor) AS place FROM l), g AS (SELECT asset_id, episode, count(*) FILTER (v > 0.5) AS strong, any_value(contributor) FILTER (place = 1) AS top FROM k GROUP BY ALL), x AS (SELECT asset_id, episode, max(score) AS peak FROM m GROUP BY ALL), t AS (SELECT asset_id, top FROM (SELECT asset_id, top, count(*) AS n FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, top) = 1) SELECT x.asset_id, {r('count(*) / 30.0', 'per_day')}, {r('avg(peak)', 'mean_peak')}, {r('max(peak)', 'max_peak')}, {r('avg(strong)', 'mean_strong')}, any_value(t.top) AS top FROM x JOIN g USING (asset_id, episode) JOIN t USING (asset_id) GROUP BY x.asset_id",
    "top_contributors": f"WITH {SCORED}, {flagged('scored', 'asset_id', str(P.SCORE_THRESHOLD))}, m AS (SELECT e.asset_id, e.episode, s.* EXCLUDE (asset_id) FROM e5 e JOIN scored s ON s.asset_id = e.asset_id AND s.us BETWEEN e.start_us AND e.end_us), l AS (" + " UNION ALL ".join(f"SELECT asset_id, episode, '{c}' AS contributor, max({c}) AS v FROM m GROUP BY ALL" for c in ("is_click", "is_error", "is_view", "score")) + f") SELECT asset_id, episode, contributor, {r('v', 'value')}, CAST(row_number() OVER w AS INTEGER) AS place FROM l WINDOW w AS (PARTITION BY asset_id, episode ORDER BY v DESC, contributor) QUALIFY row_number() OVER w <= 2",
    "gap_shares": f"WITH {SCORED}, {flagged('scored', 'asset_id', str(P.SCORE_THRESHOLD))}, g AS (SELECT asset_id, s, us AS e FROM (SELECT asset_id, us, lag(us) OVER ({BY}) AS s FROM tel) WHERE us - s > {2 * P.HOUR}), a AS (SELECT asset_id, us, CAST(EXISTS (SELECT 1 FROM g WHERE g.asset_id = t.asset_id AND (abs(t.us - g.s) <= {3 * P.HOUR} OR abs(t.us - g.e) <= {3 * P.HOUR})) AS DOUBLE) AS near FROM tel t) SELECT asset_id, CAST(NULL AS BIGINT) AS episode, {r('avg(near)', 'share')} FROM a GROUP BY asset_id UNION ALL SELECT e.asset_id, e.episode, {r('avg(near)', 'share')} FROM e5 e JOIN a ON a.asset_id = e.asset_id AND a.us BETWEEN e.start_us AND e.end_us GROUP BY e.asset_id, e.episode",
    "windows_off_gaps": f"WITH {TEL}, {WIN}, g AS (SELECT asset_id, s, us AS e FROM (SELECT asset_id, us, lag(us) OVER ({BY}) AS s FROM tel) WHERE us - s > {2 * P.HOUR}) SELECT asset_id, us FROM win t WHERE {WIN_OK} AND NOT EXISTS (SELECT 1 FROM g WHERE g.asset_id = t.asset_id AND (abs(t.us - g.s) <= {3 * P.HOUR} OR abs(t.us - g.e) <= {3 * P.HOUR}))",
    "feature_matrix": f"WITH {FEATURES}, {WIN}, m AS (SELECT *, {_med('stopped_duration_last')} AS b1 FROM feat) SELECT w.asset_id, w.us, {r('w.m', 'value_mean', 4)}, {r('CAST(w.hi AS DOUBLE)', 'value_max', 4)}, {r('m.stopped_duration_last', 'cycle_stopped_duration_last', 4)}, {r('m.duty_ratio_trailing', 'cycle_duty_ratio_trailing', 4)}, {r(ratio('m.stopped_duration_last', 'm.b1'), 'cycle_stopped_duration_last_rel_baseline', 4)} FROM win w JOIN m USING (asset_id, us) WHERE {WIN_OK}",
}
