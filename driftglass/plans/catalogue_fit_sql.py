"""DuckDB SQL for the queries that fit models: local regressions in closed form, Newton steps, linear systems and sequence smoothers by recursion."""

from __future__ import annotations

from .catalogue_sql import _DAYS, _EVENT_DAYS, _GRID, _HOURS

ORACLES: dict[str, str] = {}

# --- local regression ----------------------------------------------------------------------


def _train(source: str = "days", keys: str = "") -> str:
    """CTE train(keys, i, x, y): rows numbered in the order of x."""
    by = f"PARTITION BY {keys} " if keys else ""
    return f"train AS MATERIALIZED (SELECT {keys + ', ' if keys else ''}(row_number() OVER ({by}ORDER BY x) - 1) AS i, x, y FROM {source})"


def _near(name: str, points: str, count: str, keys: str = "", train: str = "train", tie: str = "i") -> str:
    """CTE name(keys, q, i, y, z, d, h, w): the `count` nearest rows of each point q, z from it, with tricube weights; keys are shared with train or points'."""
    lead = "".join(f"{k.strip()}, " for k in keys.split(",") if k.strip())
    join = f"JOIN {train} t USING ({keys})" if keys else f", {train} t"
    return f"""{name}_ranked AS (
  SELECT {lead}q, t.i, t.y, t.x - q AS z, abs(t.x - q) AS d, row_number() OVER (PARTITION BY {lead}q ORDER BY abs(t.x - q), t.{tie}) AS r, {count} AS k FROM {points} {join}
), {name} AS MATERIALIZED (
  SELECT *, CASE WHEN h <= 0 THEN 1.0::DOUBLE WHEN d < h THEN power(1 - power(d / h, 3), 3) ELSE 0.0 END AS w
  FROM (SELECT *, max(d) OVER (PARTITION BY {lead}q) AS h FROM {name}_ranked WHERE r <= k)
)"""


def _fit(name: str, near: str, weights: str | None = None, keys: str = "", degree: int = 1) -> str:
    """CTE name(keys, q, f, slope, corner): local fits with the locality weights, times those of weights(keys, i, b); corner is of the inverse normal matrix."""
    lead = "".join(f"{k.strip()}, " for k in keys.split(",") if k.strip())
    source = f"(SELECT {lead}q, z, y, h, w * b AS w FROM {near} JOIN {weights} USING ({lead}i))" if weights else near
    group = f"GROUP BY {lead}q"
    if degree == 0:
        return f"{name} AS MATERIALIZED (SELECT {lead}q, sum(w * y) / sum(w) AS f, NULL::DOUBLE AS slope, 1 / sum(w) AS corner FROM {source} {group})"
    if degree == 1:
        return f"""{name} AS MATERIALIZED (SELECT {lead}q, CASE WHEN m < 2 THEN t0 / s0 ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END AS f,
  CASE WHEN m >= 2 THEN (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) END AS slope, CASE WHEN m < 2 THEN 1 / s0 ELSE s2 / (s0 * s2 - s1 * s1) END AS corner
  FROM (SELECT {lead}q, count(*) FILTER (WHERE w > 0) AS m, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * y) AS t0, sum(w * z * y) AS t1 FROM {source} {group}))"""
    return f"""{name} AS MATERIALIZED (SELECT {lead}q, (r * (c * e - d * d) - b * (s * e - d * t) + c * (s * d - c * t)) / det AS f, (a * (s * e - t * d) - r * (b * e - c * d) + c * (b * t - s * c)) / det / h AS slope, (c * e - d * d) / det AS corner
  FROM (SELECT *, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS det FROM (
    SELECT {lead}q, any_value(h) AS h, sum(w) AS a, sum(w * u) AS b, sum(w * u * u) AS c, sum(w * u * u * u) AS d, sum(w * u * u * u * u) AS e, sum(w * y) AS r, sum(w * u * y) AS s, sum(w * u * u * y) AS t
    FROM (SELECT *, CASE WHEN h > 0 THEN z / h ELSE z END AS u FROM {source}) {group})))"""


def _robust(name: str, fit: str, keys: str = "", train: str = "train") -> str:
    """CTE name(keys, i, b): bisquare weights of the residuals of a fit at the training rows."""
    lead = "".join(f"{k.strip()}, " for k in keys.split(",") if k.strip())
    by = f"(PARTITION BY {keys})" if keys else "()"
    return f"""{name} AS MATERIALIZED (
  SELECT {lead}i, CASE WHEN r / (6 * s) < 1 THEN power(1 - power(r / (6 * s), 2), 2) ELSE 0.0::DOUBLE END AS b
  FROM (SELECT {lead}i, r, greatest(median(r) OVER {by}, 1e-8::DOUBLE * greatest(median(spread) OVER {by}, 1e-300::DOUBLE)) AS s
    FROM (SELECT {lead}i, abs(y - f) AS r, abs(y - median(y) OVER {by}) AS spread FROM {train} JOIN (SELECT {lead}q AS x, f FROM {fit}) USING ({lead}x))))"""


def _robust_fit(name: str, near: str, updates: int, keys: str = "", degree: int = 1, train: str = "train") -> str:
    """CTEs up to name(keys, q, f, …) and name_b(keys, i, b): weights are updated so many times, then used."""
    parts, weights = [], None
    for k in range(updates):
        parts += [_fit(f"{name}_{k}", near, weights, keys, degree), _robust(f"{name}_b{k}", f"{name}_{k}", keys, train)]
        weights = f"{name}_b{k}"
    return ", ".join([*parts, _fit(name, near, weights, keys, degree), f"{name}_b AS (SELECT * FROM {weights})"])


def _leverage(name: str, near: str, fit: str, weights: str, keys: str = "") -> str:
    """CTE name(keys, trace): the sum of what each training row weighs in its own fit."""
    lead = "".join(f"{k.strip()}, " for k in keys.split(",") if k.strip())
    group = f"GROUP BY {keys}" if keys else ""
    return f"{name} AS MATERIALIZED (SELECT {lead}sum(n.w * b * corner) AS trace FROM {near} n JOIN {weights} USING ({lead}i) JOIN {fit} USING ({lead}q) WHERE n.z = 0 {group})"


def _span(span: str, least: int, table: str = "train", where: str = "") -> str:
    return f"(SELECT least(count(*), greatest(ceil({span}::DOUBLE * count(*)), {least})) FROM {table} {where})"


_POINTS = "points AS (SELECT x AS q FROM days)"
_SIZES = "sizes AS (SELECT k FROM (SELECT unnest([4, 6, 10, 16, 26, 42, 67, 107]) AS k) WHERE k < (SELECT count(*) FROM train) UNION ALL SELECT count(*) FROM train)"
#: The neighbourhood of every training row by corrected AIC, and robust local lines with it (one update).
_ADAPTIVE = f"""{_train()}, {_POINTS}, {_SIZES}, every AS MATERIALIZED (
  SELECT q, i, y, x - q AS z, abs(x - q) AS d, row_number() OVER (PARTITION BY q ORDER BY abs(x - q), i) AS r FROM points, train
), tried_raw AS (SELECT k, q, i, y, z, d, max(d) OVER (PARTITION BY k, q) AS h FROM every JOIN sizes ON r <= k
), tried AS MATERIALIZED (SELECT *, CASE WHEN h <= 0 THEN 1.0::DOUBLE WHEN d < h THEN power(1 - power(d / h, 3), 3) ELSE 0.0 END AS w FROM tried_raw
), {_fit("lines", "tried", None, "k")}, scores AS (
  SELECT k, q, ln(sum(CASE WHEN w > 0 THEN power(y - f - slope * z, 2) ELSE 0 END) / k) + (4 + 12.0::DOUBLE / (k - 3)) / k AS score FROM tried JOIN lines USING (k, q) GROUP BY k, q
), selected AS MATERIALIZED (SELECT q, k FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, k DESC) AS place FROM scores) WHERE place = 1
), near AS MATERIALIZED (SELECT tried.* FROM tried JOIN selected USING (k, q)), {_robust_fit("a", "near", 1)}, {_leverage("a_trace", "near", "a", "a_b")}"""

ORACLES["adaptive_loess"] = f"WITH {_HOURS}, {_ADAPTIVE} SELECT q::INTEGER AS hour, k::INTEGER AS k, round(f, 6) AS fit FROM a JOIN selected USING (q)"
ORACLES["adaptive_fast"] = f"""WITH {_HOURS}, {_GRID}, {_ADAPTIVE}, sized AS (
  SELECT g, q, k FROM (SELECT g, grid.q, s.k, row_number() OVER (PARTITION BY g ORDER BY abs(s.q - grid.q), s.q) AS place FROM grid, selected s) WHERE place = 1
), {_near("around", "sized", "k")}, {_fit("means", "around", "a_b")},
scale AS (SELECT sqrt(sum(power(y - f, 2)) / greatest(count(*) - any_value(trace), 1)) AS sigma FROM train JOIN a ON q = x, a_trace),
lengths AS (SELECT q, sqrt(sum(CASE WHEN w > 0 THEN power((s2 - s1 * z) / (s0 * s2 - s1 * s1), 2) ELSE 0 END)) AS length
  FROM around JOIN (SELECT q, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2 FROM around GROUP BY q) USING (q) GROUP BY q)
SELECT g::INTEGER AS g, round(f, 6) AS fit, round(sigma * length, 6) AS se FROM sized JOIN means USING (q) JOIN lengths USING (q), scale"""

#: Fixed spans of robust lines (two updates) and their GCV.
_FIXED = f"""spans AS (SELECT unnest([0.3, 0.5, 0.75]::DOUBLE[]) AS span), spaced AS (SELECT span, q FROM spans, points), train_s AS MATERIALIZED (SELECT span, i, x, y FROM spans, train),
{_near("near_s", "spaced", _span("span", 3), "span", "train_s")}, {_robust_fit("l", "near_s", 2, "span", 1, "train_s")}, {_leverage("l_trace", "near_s", "l", "l_b", "span")},
l_gcv AS (SELECT span, avg(power(y - f, 2)) / power(greatest(1 - any_value(trace) / count(*), 1e-6::DOUBLE), 2) AS gcv FROM l JOIN train ON x = q JOIN l_trace USING (span) GROUP BY span),
l_best AS (SELECT span, gcv FROM l_gcv ORDER BY gcv, span LIMIT 1)"""
ORACLES["automatic_smoother"] = f"""WITH {_EVENT_DAYS}, {_ADAPTIVE}, {_FIXED},
a_gcv AS (SELECT avg(power(y - f, 2)) / power(greatest(1 - any_value(trace) / count(*), 1e-6::DOUBLE), 2) AS gcv FROM a JOIN train ON x = q, a_trace)
SELECT CASE WHEN l_best.gcv < a_gcv.gcv THEN 'Loess' ELSE 'AdaptiveLoess' END AS smoother, a.q::INTEGER AS day, round(CASE WHEN l_best.gcv < a_gcv.gcv THEN l.f ELSE a.f END, 6) AS fit
FROM a, a_gcv, l_best JOIN l USING (span) WHERE l.q = a.q"""

def _line(days: str, grid: str, kind: str, span: str, least: int, degree: int, updates: int = 1) -> str:
    """CTEs up to told(key, q, f, slope) at the points of grid(key, q), after robust fits at the rows."""
    return f"""{days}, {_train()}, {_POINTS}, {_near("near", "points", _span(span, least))}, {_robust_fit("l", "near", updates, "", degree)}, {grid},
{_near("around", kind, _span(span, least))}, {_fit("told", "around", "l_b", "", degree)}"""


ORACLES["loess_deg1_grid"] = f"WITH {_line(_DAYS, _GRID, 'grid', '0.1', 3, 1)} SELECT g, round(f, 4) AS fit FROM told JOIN grid USING (q)"
ORACLES["loess_deg1_slopes"] = f"WITH {_line(_DAYS, _GRID, 'grid', '0.1', 3, 1)} SELECT g, round(slope, 4) AS slope FROM told JOIN grid USING (q)"
ORACLES["nw_grid"] = f"WITH {_line(_DAYS, _GRID, 'grid', '0.1', 2, 0)} SELECT g, round(f, 4) AS fit FROM told JOIN grid USING (q)"
ORACLES["nw_se"] = f"""WITH {_line(_DAYS, _GRID, 'grid', '0.1', 2, 0)}, {_leverage("l_trace", "near", "l", "l_b")},
scale AS (SELECT sqrt(sum(power(y - f, 2)) / greatest(count(*) - any_value(trace), 1)) AS sigma FROM train JOIN l ON q = x, l_trace)
SELECT any_value(g) AS g, round(any_value(sigma) * sqrt(sum(w * w)) / sum(w), 4) AS se FROM around JOIN grid USING (q), scale GROUP BY q"""
ORACLES["loess_deg2_grid"] = f"WITH {_line(_HOURS, 'asked AS (SELECT q FROM points)', 'asked', '0.3', 4, 2)} SELECT q::INTEGER AS hour, round(f, 6) AS fit FROM told"
ORACLES["loess_robust"] = f"""WITH {_line(_EVENT_DAYS, 'asked AS (SELECT q FROM points)', 'asked', '0.5', 3, 1, 3)}
SELECT q::INTEGER AS day, round(f, 6) AS fit, round(b, 6) AS weight FROM told JOIN train ON x = q JOIN l_b USING (i)"""
ORACLES["nw_gcv_span"] = f"""WITH {_EVENT_DAYS}, {_train()}, {_POINTS}, spans AS (SELECT unnest([0.2, 0.4, 0.8]::DOUBLE[]) AS span), spaced AS (SELECT span, q FROM spans, points), train_s AS MATERIALIZED (SELECT span, i, x, y FROM spans, train),
{_near("near_s", "spaced", _span("span", 2), "span", "train_s")}, {_robust_fit("l", "near_s", 1, "span", 0, "train_s")}, {_leverage("l_trace", "near_s", "l", "l_b", "span")},
gcv AS (SELECT span, avg(power(y - f, 2)) / power(greatest(1 - any_value(trace) / count(*), 1e-6::DOUBLE), 2) AS gcv FROM l JOIN train ON x = q JOIN l_trace USING (span) GROUP BY span)
SELECT span, round(gcv, 6) AS gcv, gcv = min(gcv) OVER () AS chosen FROM gcv"""
ORACLES["extrapolation_policies"] = f"""WITH {_line(_EVENT_DAYS, 'hull AS (SELECT min(x) AS lo, max(x) AS hi FROM days), asked AS (SELECT d::DOUBLE AS q FROM range(-5, 36) t(d))', 'asked', '0.5', 3, 1)}
SELECT 'polynomial' AS policy, q::INTEGER AS day, round(f, 6) AS fit FROM told
UNION ALL SELECT 'nearest', p.q::INTEGER, round(l.f, 6) FROM asked p, hull JOIN l ON l.q = greatest(lo, least(hi, p.q))
UNION ALL SELECT 'unavailable', q::INTEGER, CASE WHEN q BETWEEN lo AND hi THEN round(f, 6) END FROM told, hull"""

# --- validation ----------------------------------------------------------------------------

#: The order of a shuffle: swaps from the end by a 64-bit congruential generator; dealt(x, fold).
_SEED = 0xDADA2026


def _shuffled(folds: int) -> str:
    return f"""deal(place, state, ids) AS (
  SELECT (count(*) - 1)::BIGINT, {_SEED}::HUGEINT, list(x ORDER BY x) FROM days
  UNION ALL
  SELECT place - 1, s, list_transform(ids, lambda v, i: CASE WHEN i = place + 1 THEN ids[(s % (place + 1))::BIGINT + 1] WHEN i = (s % (place + 1))::BIGINT + 1 THEN ids[place + 1] ELSE v END)
  FROM (SELECT place, ids, (state * 6364136223846793005::HUGEINT + 1442695040888963407) % 18446744073709551616::HUGEINT AS s FROM deal WHERE place > 0)
), dealt AS MATERIALIZED (SELECT x, (p % {folds})::INTEGER AS fold FROM (SELECT unnest(ids) AS x, unnest(range(0, len(ids))) AS p FROM deal WHERE place = 0))"""


ORACLES["cross_validation"] = f"""WITH RECURSIVE {_EVENT_DAYS}, {_shuffled(5)}, spans AS (SELECT unnest([0.5, 0.75]::DOUBLE[]) AS span),
kept AS (SELECT span, f.fold, d.x, d.y FROM spans, (SELECT DISTINCT fold FROM dealt) f, days d JOIN dealt USING (x) WHERE dealt.fold <> f.fold),
{_train("kept", "span, fold")}, points AS (SELECT span, fold, x AS q FROM train), counted AS (SELECT span, fold, count(*) AS n FROM train GROUP BY span, fold),
sized AS (SELECT span, fold, q, least(n, greatest(ceil(span * n), 3)) AS k FROM points JOIN counted USING (span, fold)), {_near("near", "sized", "k", "span, fold")},
{_robust_fit("l", "near", 1, "span, fold")}, {_leverage("l_trace", "near", "l", "l_b", "span, fold")},
gcv AS (SELECT span, fold, avg(power(y - f, 2)) / power(greatest(1 - any_value(trace) / count(*), 1e-6::DOUBLE), 2) AS gcv FROM l JOIN train t USING (span, fold) JOIN l_trace USING (span, fold) WHERE t.x = l.q GROUP BY span, fold),
best AS (SELECT fold, span FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gcv, span) AS place FROM gcv) WHERE place = 1),
asked AS (SELECT span, fold, x AS q, least(n, greatest(ceil(span * n), 3)) AS k FROM dealt JOIN best USING (fold) JOIN counted USING (span, fold)),
{_near("around", "asked", "k", "span, fold")}, {_fit("held", "around", "l_b", "span, fold")}
SELECT q::BIGINT AS id, held.fold, round(days.y, 6) AS observed, round(f, 6) AS predicted FROM held JOIN days ON x = q"""

#: Blocked folds of three, a robust line and a robust parabola (span 0.75, one update) on the other folds' rows.
ORACLES["model_comparison"] = f"""WITH {_EVENT_DAYS}, dealt AS MATERIALIZED (SELECT x, y, ((row_number() OVER (ORDER BY x) - 1) * 3 // (SELECT count(*) FROM days))::INTEGER AS fold FROM days),
kept AS (SELECT f.fold, d.x, d.y FROM (SELECT DISTINCT fold FROM dealt) f, dealt d WHERE d.fold <> f.fold), {_train("kept", "fold")},
counted AS (SELECT fold, count(*) AS n, avg(y) AS centre FROM train GROUP BY fold),
sized AS (SELECT fold, x AS q, least(n, greatest(ceil(0.75::DOUBLE * n), 3)) AS k FROM train JOIN counted USING (fold)), {_near("near", "sized", "k", "fold")}, {_robust_fit("l", "near", 1, "fold")},
bent AS (SELECT fold, x AS q, least(n, greatest(ceil(0.75::DOUBLE * n), 4)) AS k FROM train JOIN counted USING (fold)), centred AS (SELECT fold, i, x, y - centre AS y FROM train JOIN counted USING (fold)),
{_near("near2", "bent", "k", "fold", "centred")}, {_robust_fit("c", "near2", 1, "fold", 2, "centred")}, offsets AS (SELECT fold, avg(f) AS shift FROM c GROUP BY fold),
asked AS (SELECT fold, x AS q, least(n, greatest(ceil(0.75::DOUBLE * n), 3)) AS k, least(n, greatest(ceil(0.75::DOUBLE * n), 4)) AS k2 FROM dealt JOIN counted USING (fold)),
{_near("around", "(SELECT fold, q, k FROM asked)", "k", "fold")}, {_fit("one", "around", "l_b", "fold")}, {_near("around2", "(SELECT fold, q, k2 AS k FROM asked)", "k", "fold", "centred")}, {_fit("two", "around2", "c_b", "fold", 2)},
losses AS (SELECT dealt.x AS id, dealt.fold, power(dealt.y - one.f, 2) AS a, power(dealt.y - (centre + two.f - shift), 2) AS b
  FROM dealt JOIN one ON one.q = dealt.x AND one.fold = dealt.fold JOIN two ON two.q = dealt.x AND two.fold = dealt.fold JOIN counted ON counted.fold = dealt.fold JOIN offsets ON offsets.fold = dealt.fold)
SELECT id::BIGINT AS id, fold, round(a, 5) AS baseline_loss, round(b, 5) AS candidate_loss, round(b - a, 5) AS difference FROM losses"""

# --- Poisson local likelihood --------------------------------------------------------------

_STEPS = 9


def _newton_steps() -> str:
    """CTEs beta0 … betaN(span, q, b0, b1): Newton steps of local Poisson lines."""
    parts = ["beta0 AS (SELECT span, q, ln(greatest((SELECT avg(y) FROM train), 0.1::DOUBLE)) AS b0, 0.0::DOUBLE AS b1 FROM spaced)"]
    for k in range(_STEPS):
        parts.append(f"""beta{k + 1} AS MATERIALIZED (SELECT span, q, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS b0, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1 FROM (
  SELECT span, q, sum(v) AS s0, sum(v * z) AS s1, sum(v * z * z) AS s2, sum(v * r) AS t0, sum(v * z * r) AS t1
  FROM (SELECT span, q, z, w * exp(b0 + b1 * z) AS v, b0 + b1 * z + y / exp(b0 + b1 * z) - 1 AS r FROM near JOIN beta{k} USING (span, q)) GROUP BY span, q))""")
    return ", ".join(parts)


ORACLES["local_likelihood_poisson"] = f"""WITH days AS (SELECT (h - min(h) OVER ())::DOUBLE AS x, n::DOUBLE AS y FROM (SELECT epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1)),
{_train()}, {_POINTS}, spans AS (SELECT unnest([0.3, 0.5]::DOUBLE[]) AS span), spaced AS (SELECT span, q FROM spans, points), train_s AS MATERIALIZED (SELECT span, i, x, y FROM spans, train),
{_near("near", "spaced", _span("span", 3), "span", "train_s")}, {_newton_steps()},
told AS MATERIALIZED (SELECT span, q, exp(b0) AS mu, exp(b0) * b1 AS slope, s2 / (s0 * s2 - s1 * s1) AS corner FROM beta{_STEPS} JOIN (
  SELECT span, q, sum(v) AS s0, sum(v * z) AS s1, sum(v * z * z) AS s2 FROM (SELECT span, q, z, w * exp(b0 + b1 * z) AS v FROM near JOIN beta{_STEPS} USING (span, q)) GROUP BY span, q) USING (span, q)),
aic AS (SELECT span, sum(CASE WHEN y = 0 THEN 2 * mu ELSE 2 * (y * ln(y / mu) - (y - mu)) END) + 2 * sum(mu * corner) AS aic FROM told JOIN train ON x = q GROUP BY span)
SELECT q::INTEGER AS hour, round(mu, 5) AS fit, round(mu * sqrt(corner), 5) AS se, round(slope, 5) AS slope FROM told WHERE span = (SELECT span FROM aic ORDER BY aic, span LIMIT 1)"""

# --- bootstrap -----------------------------------------------------------------------------


def _word(source: str, keys: str, z: str, name: str) -> str:
    """CTEs up to name(keys, word): the output function of SplitMix64 on the state z (64 bits, unsigned)."""
    times = lambda a, b: f"(({a})::UHUGEINT * {b}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""{name}_a AS (SELECT {keys}, ({z})::UBIGINT AS s FROM {source}), {name}_b AS (SELECT {keys}, {times("xor(s, s >> 30)", 0xBF58476D1CE4E5B9)} AS s FROM {name}_a),
{name}_c AS (SELECT {keys}, {times("xor(s, s >> 27)", 0x94D049BB133111EB)} AS s FROM {name}_b), {name} AS (SELECT {keys}, xor(s, s >> 31) AS word FROM {name}_c)"""


_WRAP = "% 18446744073709551616::UHUGEINT"
ORACLES["bootstrap_smoother"] = f"""WITH {_EVENT_DAYS}, original AS MATERIALIZED (SELECT -1 AS replica, (row_number() OVER (ORDER BY x) - 1) AS i, x, y FROM days), n AS (SELECT count(*) AS n FROM days),
replicas AS (SELECT unnest(range(40)) AS replica), {_word("replicas", "replica", f"({_SEED}::UHUGEINT + replica::UHUGEINT) {_WRAP}", "first")},
places AS (SELECT replica, word, i FROM first, n, range(n) r(i)), {_word("places", "replica, i", f"(word::UHUGEINT + (i + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) {_WRAP}", "draws")},
train AS MATERIALIZED (SELECT * FROM original UNION ALL SELECT d.replica::INTEGER, d.i, o.x, o.y FROM draws d, n JOIN original o ON o.i = d.word % n),
points AS (SELECT DISTINCT replica, x AS q FROM train), {_near("near", "points", "(SELECT least(n, greatest(ceil(0.75::DOUBLE * n), 3)) FROM n)", "replica")}, {_robust_fit("l", "near", 1, "replica")},
asked AS (SELECT DISTINCT replica, unnest([5.0, 15.0, 25.0]::DOUBLE[]) AS q FROM train), {_near("around", "asked", "(SELECT least(n, greatest(ceil(0.75::DOUBLE * n), 3)) FROM n)", "replica")}, {_fit("told", "around", "l_b", "replica")}
SELECT ((t.q - 5) / 10)::INTEGER AS id, round(any_value(o.f), 6) AS reference, round(avg(t.f), 6) AS mean, round(stddev_samp(t.f), 6) AS sd, round(quantile_cont(t.f, 0.025), 6) AS lo, round(quantile_cont(t.f, 0.975), 6) AS hi
FROM told t JOIN told o ON o.replica = -1 AND o.q = t.q WHERE t.replica >= 0 GROUP BY t.q"""

# --- sequences -----------------------------------------------------------------------------


def _bands(i: str, n: str) -> tuple[str, str, str]:
    """Entries (i, i), (i, i + 1) and (i, i + 2) of D'D for second differences of n places."""
    inside = lambda j: f"(({i}) - {j} BETWEEN 0 AND ({n}) - 3)::INT"
    return f"({inside(0)} + 4 * {inside(1)} + {inside(2)})", f"(-2 * {inside(0)} - 2 * {inside(1)})", f"{inside(0)}"


def _factor(keys: str) -> str:
    """Recursive CTE down(keys, i, n, p, d, e, f, w, …): the factor of 1 + p D'D and the forward substitution of y, from seq(keys, i, y, n, p)."""
    lead = "".join(f"seq.{k.strip()}, " for k in keys.split(","))
    a0, a1, a2 = _bands("i + 1", "n")
    b0, b1, b2 = _bands("0", "n")
    return f"""down AS (
  SELECT {lead}i, n, p, 1 + p * {b0} AS d, p * {b1} / (1 + p * {b0}) AS e, p * {b2} / (1 + p * {b0}) AS f, y AS w, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS w1 FROM seq WHERE i = 0 AND n > 2
  UNION ALL
  SELECT {lead.replace("seq.", "")}i + 1, n, p, dd, (p * {a1} - f * d * e) / dd, p * {a2} / dd, ww, f, d, w
  FROM (SELECT down.*, 1 + p * {a0} - e * e * d - f1 * f1 * d1 AS dd, s.y - e * w - f1 * w1 AS ww FROM down JOIN (SELECT {lead.replace("seq.", "")}i AS o, y FROM seq) s USING ({keys}) WHERE o = i + 1)
)"""


def _back(keys: str) -> str:
    """Recursive CTE up(keys, i, z, …, s0, s1, …): the solution, and diagonals of the inverse."""
    names = [k.strip() for k in keys.split(",")]
    lead, other = "".join(f"{k}, " for k in names), "".join(f"up.{k}, " for k in names)
    return f"""up AS (
  SELECT {lead}i, w / d AS z, 0.0::DOUBLE AS z1, 1 / d AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s01 FROM down WHERE i = n - 1
  UNION ALL
  SELECT {lead}o, w / d - e * z - f * z1, z, 1 / d - e * (-e * s0 - f * s1) - f * (-e * s1 - f * s01), -e * s0 - f * s1, s0
  FROM up JOIN (SELECT {lead}i AS o, d, e, f, w FROM down) b USING ({keys}) WHERE o = i - 1
)"""


ORACLES["whittaker_gcv"] = f"""WITH RECURSIVE {_HOURS}, seq AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY x) - 1) AS i, x, y, count(*) OVER (PARTITION BY p) AS n FROM days, (SELECT unnest([1.0, 10.0, 100.0, 1000.0]::DOUBLE[]) AS p)),
{_factor("p").replace("seq.p, i, n, p,", "seq.p, i, n,").replace("SELECT p, i + 1, n, p,", "SELECT p, i + 1, n,")}, {_back("p")},
gcv AS (SELECT p, avg(power(y - z, 2)) / power(greatest(1 - sum(s0) / count(*), 1e-6::DOUBLE), 2) AS gcv FROM up JOIN seq USING (p, i) GROUP BY p)
SELECT p AS penalty, x::INTEGER AS hour, round(z, 6) AS fit FROM up JOIN seq USING (p, i) WHERE p = (SELECT p FROM gcv ORDER BY gcv, p LIMIT 1)"""

ORACLES["whittaker_groups"] = f"""WITH RECURSIVE seq AS MATERIALIZED (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS i, value AS y, count(*) OVER (PARTITION BY user_id) AS n, 100.0::DOUBLE AS p FROM events),
{_factor("user_id")}, {_back("user_id")}, factor AS MATERIALIZED (SELECT user_id, i AS o, n, d, e, f FROM down),
fore AS (
  SELECT user_id, o AS j, o AS i, 1.0::DOUBLE AS w, 0.0::DOUBLE AS w1, e, f, 0.0::DOUBLE AS f1 FROM factor
  UNION ALL
  SELECT user_id, j, i + 1, -fore.e * w - f1 * w1, w, b.e, b.f, fore.f FROM fore JOIN factor b USING (user_id) WHERE b.o = i + 1
), held AS MATERIALIZED (SELECT user_id, j, i, w FROM fore
), aft AS (
  SELECT user_id, j, o AS i, w / d AS z, 0.0::DOUBLE AS z1 FROM held JOIN factor USING (user_id) WHERE o = i AND o = n - 1
  UNION ALL
  SELECT aft.user_id, aft.j, b.o, coalesce(h.w, 0) / b.d - b.e * z - b.f * z1, z FROM aft JOIN factor b ON b.user_id = aft.user_id AND b.o = aft.i - 1 LEFT JOIN held h ON h.user_id = aft.user_id AND h.j = aft.j AND h.i = aft.i - 1
), lengths AS (SELECT user_id, j AS i, sqrt(sum(z * z)) AS length FROM aft GROUP BY user_id, j
), scale AS (SELECT user_id, sqrt(sum(power(y - z, 2)) / greatest(count(*) - sum(s0), 1)) AS sigma FROM up JOIN seq USING (user_id, i) GROUP BY user_id)
SELECT user_id, event_id, round(z, 6) AS fit, round(sigma * length, 6) AS se FROM seq LEFT JOIN up USING (user_id, i) LEFT JOIN lengths USING (user_id, i) LEFT JOIN scale USING (user_id)"""

_WALKED = """down AS (
  SELECT 0::BIGINT AS i, -10 / 11.0::DOUBLE AS c, y / 11.0::DOUBLE AS d FROM days WHERE x = 0
  UNION ALL
  SELECT i + 1, -10 / m, (y + 10 * d) / m FROM (SELECT i, d, days.y, CASE WHEN i + 2 = n THEN 11.0::DOUBLE ELSE 21.0::DOUBLE END + 10 * c AS m FROM down JOIN days ON days.x = i + 1, (SELECT count(*) AS n FROM days))
), up AS (
  SELECT i, d AS z FROM down WHERE i = (SELECT count(*) - 1 FROM days)
  UNION ALL
  SELECT b.i, b.d - b.c * z FROM up JOIN down b ON b.i = up.i - 1
)"""
ORACLES["whittaker_order1"] = f"WITH RECURSIVE {_EVENT_DAYS}, {_WALKED} SELECT i::INTEGER AS day, round(z, 6) AS fit FROM up"
ORACLES["whittaker_interpolation"] = f"""WITH RECURSIVE {_EVENT_DAYS}, {_WALKED}, ends AS (SELECT max(i) AS last FROM up),
b AS (SELECT k / 2.0::DOUBLE AS x, last, least(floor(k / 2.0), last - 1) AS lo FROM range(-2, 62) t(k), ends)
SELECT b.x, CASE WHEN b.x BETWEEN 0 AND last THEN round(l.z * (1 - (b.x - lo)) + h.z * (b.x - lo), 6) END AS fit, CASE WHEN b.x BETWEEN 0 AND last THEN round(h.z - l.z, 6) END AS slope
FROM b LEFT JOIN up l ON l.i = lo LEFT JOIN up h ON h.i = lo + 1"""

#: The direct algorithm of Condat (2013) for one-dimensional total variation, one state a step; segments are told as they are settled.
_JUMP_DOWN, _JUMP_UP = "ys[k + 2] + umin < vmin - p", "ys[k + 2] + umax > vmax + p"
def _total_variation(penalty: float) -> str:
    """CTEs up to curve(x, fit)."""
    return f"""held AS MATERIALIZED (SELECT list(y ORDER BY x) AS ys, list(x ORDER BY x) AS xs, count(*) AS n, {penalty}::DOUBLE AS p FROM days),
walk AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS k0, 0::BIGINT AS km, 0::BIGINT AS kp, ys[1] - p AS vmin, ys[1] + p AS vmax, p AS umin, -p AS umax, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::DOUBLE AS v, false AS done FROM held
  UNION ALL
  SELECT CASE act WHEN 'down' THEN km + 1 WHEN 'up' THEN kp + 1 WHEN 'on' THEN k + 1 WHEN 'low' THEN km + 1 WHEN 'high' THEN kp + 1 ELSE k END,
    CASE act WHEN 'down' THEN km + 1 WHEN 'up' THEN kp + 1 WHEN 'low' THEN km + 1 WHEN 'high' THEN kp + 1 ELSE k0 END,
    CASE act WHEN 'down' THEN km + 1 WHEN 'up' THEN kp + 1 WHEN 'low' THEN km + 1 WHEN 'on' THEN CASE WHEN umin + ys[k + 2] - vmin >= p THEN k + 1 ELSE km END ELSE km END,
    CASE act WHEN 'down' THEN km + 1 WHEN 'up' THEN kp + 1 WHEN 'high' THEN kp + 1 WHEN 'on' THEN CASE WHEN umax + ys[k + 2] - vmax <= -p THEN k + 1 ELSE kp END ELSE kp END,
    CASE act WHEN 'down' THEN ys[km + 2] WHEN 'up' THEN ys[kp + 2] - 2 * p WHEN 'low' THEN ys[km + 2] WHEN 'on' THEN CASE WHEN umin + ys[k + 2] - vmin >= p THEN vmin + (umin + ys[k + 2] - vmin - p) / (k - k0 + 2) ELSE vmin END ELSE vmin END,
    CASE act WHEN 'down' THEN ys[km + 2] + 2 * p WHEN 'up' THEN ys[kp + 2] WHEN 'high' THEN ys[kp + 2] WHEN 'on' THEN CASE WHEN umax + ys[k + 2] - vmax <= -p THEN vmax + (umax + ys[k + 2] - vmax + p) / (k - k0 + 2) ELSE vmax END ELSE vmax END,
    CASE act WHEN 'down' THEN p WHEN 'up' THEN p WHEN 'low' THEN p WHEN 'high' THEN ys[kp + 2] - p - vmin WHEN 'on' THEN least(umin + ys[k + 2] - vmin, p) ELSE umin END,
    CASE act WHEN 'down' THEN -p WHEN 'up' THEN -p WHEN 'low' THEN ys[km + 2] + p - vmax WHEN 'high' THEN -p WHEN 'on' THEN greatest(umax + ys[k + 2] - vmax, -p) ELSE umax END,
    CASE WHEN act <> 'on' THEN k0 END, CASE act WHEN 'down' THEN km WHEN 'low' THEN km WHEN 'up' THEN kp WHEN 'high' THEN kp WHEN 'end' THEN n - 1 END,
    CASE act WHEN 'down' THEN vmin WHEN 'low' THEN vmin WHEN 'up' THEN vmax WHEN 'high' THEN vmax WHEN 'end' THEN vmin + umin / (k - k0 + 1) END, act = 'end'
  FROM (SELECT *, CASE WHEN k < n - 1 THEN CASE WHEN {_JUMP_DOWN} THEN 'down' WHEN {_JUMP_UP} THEN 'up' ELSE 'on' END WHEN umin < 0 THEN 'low' WHEN umax > 0 THEN 'high' ELSE 'end' END AS act FROM walk, held WHERE NOT done)
), curve AS (SELECT xs[i + 1] AS x, v AS fit FROM held, (SELECT unnest(range(s, e + 1)) AS i, v FROM walk WHERE s IS NOT NULL))"""


ORACLES["total_variation"] = f"""WITH RECURSIVE {_HOURS}, {_total_variation(20.0)}
SELECT x::INTEGER AS hour, round(fit, 9) AS fit, sum(CASE WHEN jump > 1e-6 THEN 1 ELSE 0 END) OVER (ORDER BY x)::BIGINT AS segment FROM (SELECT *, abs(fit - lag(fit) OVER (ORDER BY x)) AS jump FROM curve)"""
ORACLES["tv_nearest"] = f"WITH RECURSIVE {_EVENT_DAYS}, {_total_variation(2.0)} SELECT k::INTEGER AS third, round(fit, 9) AS fit FROM range(0, 88) t(k) JOIN curve ON x = (k + 1) // 3"

# --- likelihood models ---------------------------------------------------------------------


def _solve(matrix: str, p: int) -> str:
    """The matrix (a list of p rows of any width) after Gauss-Jordan elimination of its first p columns."""
    k = "s[1][1]::INTEGER"
    return (f"list_reduce(list_prepend({matrix}, list_transform(range(1, {p + 1}), lambda k: [[k::DOUBLE]])), lambda m, s: list_transform(m, lambda row, i: CASE WHEN i = {k} "
            f"THEN list_transform(row, lambda v: v / row[{k}]) ELSE list_transform(row, lambda v, j: v - row[{k}] * m[{k}][j] / m[{k}][{k}]) END))")


def _gram(p: int, weight: str) -> str:
    """Columns g1_1 … of the weighted sums of products of a list column d."""
    return ", ".join(f"sum({weight} * d[{i}] * d[{j}]) AS g{i}_{j}" for i in range(1, p + 1) for j in range(i, p + 1))


def _square(p: int, ridge: float, extra=lambda i: []) -> str:
    """The matrix of _gram's columns, `ridge` added to the diagonal but for the first place, with more columns."""
    cell = lambda i, j: f"g{min(i, j)}_{max(i, j)}" + (f" + {ridge!r}" if i == j > 1 and ridge else "")
    return "[" + ", ".join("[" + ", ".join([cell(i, j) for j in range(1, p + 1)] + extra(i)) + "]::DOUBLE[]" for i in range(1, p + 1)) + "]"


def _spline(u: str, knots: int) -> list[str]:
    return [u, f"{u} * {u}", f"{u} * {u} * {u}", *[f"power(greatest({u} - {j}::DOUBLE / {knots + 1}, 0), 3)" for j in range(1, knots + 1)]]


def _spline_slope(u: str, knots: int) -> list[str]:
    return ["1.0::DOUBLE", f"2 * {u}", f"3 * {u} * {u}", *[f"3 * power(greatest({u} - {j}::DOUBLE / {knots + 1}, 0), 2)" for j in range(1, knots + 1)]]


def _tensor(u: str, v: str, a: int, b: int) -> list[str]:
    return [f"({x}) * ({y})" for x in _spline(u, a) for y in _spline(v, b)]


def _design(columns: list[str], scaled: str, kept: str) -> str:
    """CTEs raw(…, c), means(m) and design(…, d): centred columns behind a 1, from scaled(kept, …)."""
    p = len(columns)
    return f"""raw AS MATERIALIZED (SELECT {kept}, [{', '.join(columns)}]::DOUBLE[] AS c FROM {scaled}), means AS MATERIALIZED (SELECT [{', '.join(f'avg(c[{i}])' for i in range(1, p + 1))}] AS m FROM raw),
design AS MATERIALIZED (SELECT {kept}, list_prepend(1.0::DOUBLE, list_transform(c, lambda v, i: v - m[i])) AS d FROM raw, means)"""


def _gaussian(p: int, penalty: float) -> str:
    """CTEs sums, solved(beta, inv, g), fitted(rss, edf, s2, cov): penalized least squares of y on d, its covariance."""
    right = ", ".join(f"sum(y * d[{i}]) AS t{i}" for i in range(1, p + 1))
    unit = lambda i: [f"t{i}"] + ["1.0" if i == j else "0.0" for j in range(1, p + 1)]
    return f"""sums AS MATERIALIZED (SELECT count(*) AS n, {_gram(p, "1")}, {right} FROM design),
reduced AS MATERIALIZED (SELECT n, {_solve(_square(p, 2 * penalty, unit), p)} AS r, {_square(p, 0)} AS g FROM sums),
solved AS MATERIALIZED (SELECT n, g, list_transform(r, lambda row: row[{p + 1}]) AS beta, list_transform(r, lambda row: row[{p + 2}:]) AS inv FROM reduced),
spread AS MATERIALIZED (SELECT any_value(n) AS n, sum(power(y - list_dot_product(d, beta), 2)) AS rss FROM design, solved),
parts AS MATERIALIZED (SELECT beta, inv, list_transform(inv, lambda a: list_transform(g, lambda b: list_dot_product(a, b))) AS part FROM solved),
fitted AS MATERIALIZED (SELECT beta, rss / greatest(n - list_sum(list_transform(range(1, {p + 1}), lambda i: part[i][i])), 1) AS s2, list_transform(part, lambda a: list_transform(inv, lambda b: list_dot_product(a, b))) AS cov FROM parts, spread)"""


def _newton(p: int, penalty: float, family: str, steps: int) -> str:
    """Recursive CTE newton(step, beta), and last(beta, cov), of a penalized likelihood of y on d."""
    ridge = 2 * penalty
    mu = "exp(e)" if family == "poisson" else "1 / (1 + exp(-e))"
    weight = "u" if family == "poisson" else "u * (1 - u)"
    start = "ln(greatest(avg(y), 1e-6::DOUBLE))" if family == "poisson" else "ln(avg(y) / (1 - avg(y)))"
    right = ", ".join(f"sum((y - u) * d[{i}])" + (f" - {ridge!r} * any_value(beta[{i}])" if i > 1 else "") + f" AS t{i}" for i in range(1, p + 1))
    unit = lambda i: ["1.0" if i == j else "0.0" for j in range(1, p + 1)]
    return f"""newton AS (
  SELECT 0 AS step, list_prepend({start}, list_transform(range({p - 1}), lambda i: 0.0::DOUBLE)) AS beta FROM design
  UNION ALL
  SELECT step + 1, list_transform({_solve(_square(p, ridge, lambda i: [f't{i}']), p)}, lambda row, i: beta[i] + row[{p + 1}])
  FROM (SELECT step, any_value(beta) AS beta, {_gram(p, weight)}, {right} FROM (SELECT step, beta, d, y, {mu} AS u FROM (SELECT step, beta, d, y, list_dot_product(d, beta) AS e FROM newton, design WHERE step < {steps})) GROUP BY step)
), told AS MATERIALIZED (SELECT beta, {_gram(p, weight)} FROM (SELECT beta, d, {mu} AS u FROM (SELECT beta, d, list_dot_product(d, beta) AS e FROM newton, design WHERE step = {steps})) GROUP BY beta),
inverted AS MATERIALIZED (SELECT beta, list_transform({_solve(_square(p, ridge, unit), p)}, lambda row: row[{p + 1}:]) AS inv, {_square(p, 0)} AS g FROM told),
last AS MATERIALIZED (SELECT beta, list_transform(list_transform(inv, lambda a: list_transform(g, lambda b: list_dot_product(a, b))), lambda a: list_transform(inv, lambda b: list_dot_product(a, b))) AS cov FROM inverted)"""


_FORM = "sqrt(greatest(list_dot_product({d}, list_transform({cov}, lambda a: list_dot_product(a, {d}))), 0))"
_LINES = "lines AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, round(l_discount * 100) AS discount, l_quantity::DOUBLE AS quantity, l_extendedprice / 1000 AS y FROM lineitem)"
_UNIT = "scaled AS (SELECT y, (quantity - min(quantity) OVER ()) / (max(quantity) OVER () - min(quantity) OVER ()) AS u, (discount - min(discount) OVER ()) / (max(discount) OVER () - min(discount) OVER ()) AS v FROM lines)"
_LEVELS = [f"(flag = {k})::INTEGER" for k in (1, 2)] + [f"(discount = {k})::INTEGER" for k in range(1, 11)]
ORACLES["categorical_factors"] = f"""WITH {_LINES}, design AS MATERIALIZED (SELECT y, [1, {', '.join(_LEVELS)}]::DOUBLE[] AS d FROM lines), {_gaussian(13, 1e-3)}
SELECT i::INTEGER - 1 AS k, round(beta[i], 6) AS beta, round(sqrt(cov[i][i] * s2), 6) AS se FROM fitted, range(1, 14) r(i)"""

_EFFECT = _spline("u", 3) + _spline("v", 1)
ORACLES["partial_effects"] = f"""WITH {_LINES}, {_UNIT}, {_design(_EFFECT, "scaled", "y")}, {_gaussian(11, 0.1)},
ends AS (SELECT min(quantity) AS lo, max(quantity) AS hi FROM lines), asked AS (SELECT lo, hi, lo + (hi - lo) * j / 49.0::DOUBLE AS x, j / 49.0::DOUBLE AS u FROM ends, range(50) r(j)),
told AS (SELECT x, list_transform([{', '.join(_spline('u', 3))}]::DOUBLE[], lambda v, i: v - m[i]) AS c, [{', '.join(_spline_slope('u', 3))}]::DOUBLE[] AS s, hi - lo AS wide FROM asked, means),
valued AS (SELECT x, list_dot_product(c, beta[2:7]) AS effect, list_dot_product(s, beta[2:7]) / wide AS grad, 1.6448536269514722::DOUBLE * sqrt(s2) * {_FORM.format(d="c", cov="list_transform(cov[2:7], lambda row: row[2:7])")} AS half FROM told, fitted)
SELECT 0::BIGINT AS predictor, round(x, 6) AS x, round(effect, 6) AS effect, round(grad, 6) AS grad, round(effect - half, 6) AS lo, round(effect + half, 6) AS hi FROM valued"""

_SURFACE = _spline("u", 1) + _spline("v", 1) + _tensor("u", "v", 1, 1)
ORACLES["tensor_surface"] = f"""WITH {_LINES}, {_UNIT}, {_design(_SURFACE, "scaled", "y")}, {_gaussian(25, 0.1)},
ends AS (SELECT min(quantity) AS q0, max(quantity) AS q1, min(discount) AS d0, max(discount) AS d1 FROM lines),
v AS MATERIALIZED (SELECT xi, yi, q0 + (q1 - q0) * u AS x, d0 + (d1 - d0) * v AS y, beta[1] + list_dot_product(list_transform([{', '.join(_SURFACE)}]::DOUBLE[], lambda c, i: c - m[i]), beta[2:]) AS v
  FROM (SELECT i AS xi, j AS yi, i / 19.0::DOUBLE AS u, j / 11.0::DOUBLE AS v FROM range(20) a(i), range(12) b(j)), ends, fitted, means),
levels AS (SELECT min(v) + (max(v) - min(v)) * unnest([1, 2, 3]) / 4 AS level FROM v),
cells AS (SELECT level, a.xi, a.yi, [a.x, b.x, c.x, d.x] AS xs, [a.y, b.y, c.y, d.y] AS ys, [a.v, b.v, c.v, d.v] AS vs FROM levels, v a
  JOIN v b ON b.xi = a.xi + 1 AND b.yi = a.yi JOIN v c ON c.xi = a.xi + 1 AND c.yi = a.yi + 1 JOIN v d ON d.xi = a.xi AND d.yi = a.yi + 1),
edges AS (SELECT *, unnest([1, 2, 3, 4]) AS e FROM cells),
cuts AS (SELECT level, xi, yi, e, xs[e] + (level - vs[e]) / (vs[e % 4 + 1] - vs[e]) * (xs[e % 4 + 1] - xs[e]) AS px, ys[e] + (level - vs[e]) / (vs[e % 4 + 1] - vs[e]) * (ys[e % 4 + 1] - ys[e]) AS py
  FROM edges WHERE (vs[e] <= level) <> (vs[e % 4 + 1] <= level)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY level, xi, yi ORDER BY e) - 1 AS k FROM cuts)
SELECT round(a.level, 5) AS level, a.yi::INTEGER AS yi, a.xi::INTEGER AS xi, (a.k // 2)::INTEGER AS part, round(a.px, 5) AS x0, round(a.py, 5) AS y0, round(b.px, 5) AS x1, round(b.py, 5) AS y1
FROM numbered a JOIN numbered b ON a.level = b.level AND a.xi = b.xi AND a.yi = b.yi AND b.k = a.k + 1 WHERE a.k % 2 = 0"""

_TOXIC = _spline("u", 3)
ORACLES["additive_binomial"] = f"""WITH RECURSIVE sized AS (SELECT l.doc_id, toxic::DOUBLE AS y, ln(n_chars + 1.0::DOUBLE) AS size FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL),
scaled AS (SELECT doc_id, y, (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) AS u FROM sized), {_design(_TOXIC, "scaled", "doc_id, y")}, {_newton(7, 1.0, "binomial", 12)},
told_rows AS (SELECT doc_id, list_dot_product(d, beta) AS e, {_FORM.format(d="d", cov="cov")} AS s FROM design, last)
SELECT doc_id, round(1 / (1 + exp(-e)), 6) AS fit, round(s * exp(-e) / power(1 + exp(-e), 2), 6) AS se, round(1 / (1 + exp(-e + 1.959963984540054::DOUBLE * s)), 6) AS lo, round(1 / (1 + exp(-e - 1.959963984540054::DOUBLE * s)), 6) AS hi FROM told_rows"""

_HOURLY = _spline("u", 3) + _spline("v", 3)
ORACLES["additive_poisson"] = f"""WITH RECURSIVE counted AS (SELECT h, (h % 24)::DOUBLE AS of_day, (h - min(h) OVER ())::DOUBLE AS hour, n::DOUBLE AS y FROM (SELECT epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1)),
scaled AS (SELECT h, y, max(hour) OVER () - min(hour) OVER () AS wide, (hour - min(hour) OVER ()) / (max(hour) OVER () - min(hour) OVER ()) AS u, (of_day - min(of_day) OVER ()) / (max(of_day) OVER () - min(of_day) OVER ()) AS v FROM counted),
{_design(_HOURLY, "scaled", "h, y, u, wide")}, {_newton(13, 1.0, "poisson", 12)}
SELECT h, round(exp(list_dot_product(d, beta)), 5) AS fit, round(exp(list_dot_product(d, beta)) * list_dot_product([{', '.join(_spline_slope('u', 3))}]::DOUBLE[], beta[2:7]) / wide, 6) AS slope FROM design, last"""

# --- backfitting ---------------------------------------------------------------------------

_ROUNDS = 12


def _backfit() -> str:
    """CTEs of so many rounds of two terms: robust lines (one update) of what the other term leaves, centred."""
    parts = ["a0 AS (SELECT i, 0.0::DOUBLE AS e FROM train)", "b0 AS (SELECT i, 0.0::DOUBLE AS e FROM train)"]
    for k in range(1, _ROUNDS + 1):
        for term, other, x in (("a", f"b{k - 1}", "hour"), ("b", f"a{k}", "of_day")):
            r = f"{term}{k}"
            parts += [f"{r}_rest AS MATERIALIZED (SELECT i, {x} AS x, y - centre - e AS y FROM train JOIN {other} USING (i), middle)",
                      f"{r}_near AS MATERIALIZED (SELECT q, n.i, r.y, z, h, w FROM near_{term} n JOIN {r}_rest r USING (i))",
                      _robust_fit(f"{r}_f", f"{r}_near", 1, "", 1, f"{r}_rest"), f"{r} AS MATERIALIZED (SELECT i, f - avg(f) OVER () AS e FROM {r}_rest JOIN {r}_f ON x = q)"]
    return ", ".join(parts)


ORACLES["additive_backfitting"] = f"""WITH train AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1) AS i, h, (h - min(h) OVER ())::DOUBLE AS hour, (h % 24)::DOUBLE AS of_day, y FROM (SELECT epoch_us(ts) // 3600000000 AS h, avg(value) AS y FROM events GROUP BY 1)),
middle AS (SELECT avg(y) AS centre FROM train), train_a AS (SELECT i, hour AS x, y FROM train), train_b AS (SELECT i, of_day AS x, y FROM train), points_a AS (SELECT DISTINCT x AS q FROM train_a), points_b AS (SELECT DISTINCT x AS q FROM train_b),
{_near("near_a", "points_a", _span("0.3", 3), "", "train_a")}, {_near("near_b", "points_b", _span("0.5", 3), "", "train_b")}, {_backfit()}
SELECT h, round(a.e, 6) AS of_hour, round(b.e, 6) AS of_day, round(centre + a.e + b.e, 6) AS fit FROM train JOIN a{_ROUNDS} a USING (i) JOIN b{_ROUNDS} b USING (i), middle"""
