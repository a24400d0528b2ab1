"""DuckDB SQL for the queries of the catalogue."""

ORACLES: dict[str, str] = {}

_DAYS = "days AS (SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1)"
_EVENT_DAYS = "days AS (SELECT (row_number() OVER (ORDER BY d) - 1)::DOUBLE AS x, y FROM (SELECT ts::DATE AS d, avg(value) AS y FROM events GROUP BY 1))"
_HOURS = "days AS (SELECT (h - min(h) OVER ())::DOUBLE AS x, y FROM (SELECT epoch_us(ts) // 3600000000 AS h, avg(value) AS y FROM events GROUP BY 1))"
_GRID = "grid AS (SELECT g::INTEGER AS g, lo + (hi - lo) * g::DOUBLE / 199.0::DOUBLE AS q FROM range(200) t(g), (SELECT min(x) AS lo, max(x) AS hi FROM days))"


def _near(points: str, key: str, span: float, least: int) -> str:
    """CTEs near (the k nearest days of each point, u = distance / bandwidth) and w (with tricube weights)."""
    return f"""ranked AS (
  SELECT {key}, q, x, y, abs(x - q) AS d, row_number() OVER (PARTITION BY {key} ORDER BY abs(x - q), x) AS r FROM {points}, days
), near AS (
  SELECT *, max(d) OVER (PARTITION BY {key}) AS h FROM ranked WHERE r <= (SELECT least(count(*), greatest(ceil({span}::DOUBLE * count(*)), {least})) FROM days)
), w AS (
  SELECT {key}, q, x, y, x - q AS z, h, CASE WHEN h <= 0 THEN 1.0 WHEN d < h THEN power(1 - power(d / h, 3), 3) ELSE 0.0 END AS w FROM near
)"""


_LINE = "sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * y) AS t0, sum(w * z * y) AS t1"
_LEVEL, _SLOPE = "(s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)", "(s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1)"

ORACLES["local_likelihood_mean"] = f"""WITH days AS (SELECT doc_id::DOUBLE AS x, max(toxic)::DOUBLE AS y FROM labels WHERE toxic IS NOT NULL GROUP BY 1),
points AS (SELECT x AS q FROM days), {_near('points', 'q', 0.3, 2).replace('SELECT q, q,', 'SELECT q,')}
SELECT q::BIGINT AS doc_id, round(sum(w * y) / sum(w), 4) AS share FROM w GROUP BY q"""
ORACLES["knn_topk"] = """WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS a, p_retailprice AS b FROM part),
pairs AS (SELECT q.k AS query, p.k AS p_partkey, (q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) AS d2 FROM p q, p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, p_partkey) AS rank FROM pairs)
SELECT query, rank::INTEGER AS rank, p_partkey, round(d2, 4) AS d2 FROM ranked WHERE rank <= 5"""
ORACLES["bounding_box"] = """WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS p, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS d FROM orders),
b AS (SELECT min(p) AS p0, max(p) AS p1, min(d) AS d0, max(d) AS d1 FROM o WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey, p BETWEEN p0 AND p1 AND d BETWEEN d0 AND d1 AS inside FROM o, b"""
ORACLES["finite_rows"] = "SELECT event_id, round(ln(value - 99.5), 6) AS a FROM events WHERE value >= 100"
ORACLES["response_family"] = """WITH v AS (SELECT 'labels' AS tab, 'toxic' AS col, toxic::DOUBLE AS v FROM labels UNION ALL SELECT 'lineitem', 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'events', 'value', value FROM events)
SELECT tab, col, CASE WHEN bool_and(v IN (0, 1)) THEN 'binomial' WHEN bool_and(v >= 0 AND v = floor(v)) THEN 'poisson' ELSE 'gaussian' END AS family FROM v WHERE isfinite(v) GROUP BY tab, col"""
ORACLES["level_codes"] = "SELECT event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS code, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"
ORACLES["bin_means"] = "SELECT floor(l_quantity / 5)::BIGINT AS bin, round(avg(l_quantity), 6) AS x, round(avg(l_extendedprice), 3) AS y, count(*) AS n FROM lineitem GROUP BY 1"
ORACLES["folds_blocked"] = "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) * 7 // (SELECT count(*) FROM labels))::INTEGER AS fold FROM labels"
ORACLES["folds_shuffled"] = """WITH RECURSIVE deal(place, state, ids) AS (
  SELECT (count(*) - 1)::BIGINT, 42::HUGEINT, list(n_nationkey ORDER BY n_nationkey) FROM nation
  UNION ALL
  SELECT place - 1, s, list_transform(ids, lambda v, i: CASE WHEN i = place + 1 THEN ids[(s % (place + 1))::BIGINT + 1] WHEN i = (s % (place + 1))::BIGINT + 1 THEN ids[place + 1] ELSE v END)
  FROM (SELECT place, ids, (state * 6364136223846793005::HUGEINT + 1442695040888963407) % 18446744073709551616::HUGEINT AS s FROM deal WHERE place > 0)
), dealt AS (SELECT unnest(ids) AS n_nationkey, unnest(range(0, len(ids))) AS p FROM deal WHERE place = 0)
SELECT n_nationkey, (p % 4)::INTEGER AS fold FROM dealt"""
ORACLES["folds_shuffled_labels"] = ORACLES["folds_shuffled"].replace("n_nationkey", "doc_id").replace("FROM nation", "FROM labels").replace("p % 4", "p % 7")
ORACLES["folds_stratified"] = """WITH c AS (SELECT toxic, count(*) AS m FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)
SELECT f::INTEGER AS fold, toxic, (m - f + 4) // 5 AS n FROM c, range(5) t(f) WHERE m > f"""
_SCORED = """rows AS (SELECT l.doc_id AS id, quality::DOUBLE AS observed, 0.05::DOUBLE + 0.9::DOUBLE * n_chars / (n_chars + 300.0::DOUBLE) AS predicted,
  0.5::DOUBLE + 0.4::DOUBLE * n_chars / (n_chars + 1000.0::DOUBLE) AS other, (l.doc_id % 5)::INTEGER AS fold FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)"""
_BINNED = f"""WITH {_SCORED}, ranked AS (SELECT *, row_number() OVER (ORDER BY predicted, id) AS r, count(*) OVER () AS n FROM rows),
bins AS (SELECT (r * least(10, n) - 1) // n AS bin, count(*) AS n, min(predicted) AS min_p, max(predicted) AS max_p, avg(predicted) AS mean_p, avg(observed) AS observed_frequency FROM ranked GROUP BY 1)"""
ORACLES["calibration_bins"] = _BINNED + " SELECT bin::INTEGER AS id, n, round(min_p, 8) AS min_p, round(max_p, 8) AS max_p, round(mean_p, 8) AS mean_p, round(observed_frequency, 8) AS observed_frequency FROM bins"
ORACLES["calibration_summary"] = _BINNED + """ SELECT count(*) AS n, least(10, count(*))::INTEGER AS bins, round(avg(observed), 8) AS prevalence, round(avg(predicted), 8) AS mean_p, round(avg(power(observed - predicted, 2)), 8) AS brier,
  round((SELECT sum(n * abs(observed_frequency - mean_p)) / sum(n) FROM bins), 8) AS ece FROM rows"""
ORACLES["cv_metrics_binomial"] = f"WITH {_SCORED} SELECT fold, count(*) AS n, round(avg(-2 * (observed * ln(predicted) + (1 - observed) * ln(1 - predicted))), 8) AS mean_deviance FROM rows GROUP BY fold"
ORACLES["cv_metrics_gaussian"] = "SELECT (o_orderkey % 6)::INTEGER AS fold, count(*) AS n, round(sqrt(avg(power(o_totalprice - o_custkey * 10.0::DOUBLE, 2))), 3) AS rmse, round(avg(abs(o_totalprice - o_custkey * 10.0::DOUBLE)), 3) AS mae FROM orders GROUP BY 1"
ORACLES["paired_comparison"] = f"""WITH {_SCORED}, losses AS (SELECT -2 * (observed * ln(predicted) + (1 - observed) * ln(1 - predicted)) AS a, -2 * (observed * ln(other) + (1 - observed) * ln(1 - other)) AS b FROM rows),
d AS (SELECT b - a AS d, 1e-12 * greatest(1, abs(a), abs(b)) AS t FROM losses)
SELECT 0::BIGINT AS unpaired, 0::BIGINT AS other_fold, 0::BIGINT AS infinite, round(avg(d), 8) AS mean_difference, count(*) FILTER (WHERE d < -t) AS candidate_wins, count(*) FILTER (WHERE d > t) AS baseline_wins, count(*) FILTER (WHERE abs(d) <= t) AS ties FROM d"""
ORACLES["residuals_binomial"] = f"""WITH {_SCORED} SELECT id, round(observed - predicted, 7) AS raw, round((observed - predicted) / sqrt(predicted * (1 - predicted)), 7) AS pearson,
  round(CASE WHEN observed = 1 THEN sqrt(-2 * ln(predicted)) ELSE -sqrt(-2 * ln(1 - predicted)) END, 7) AS deviance FROM rows"""
ORACLES["residuals_poisson"] = """WITH h AS (SELECT epoch_us(ts) // 3600000000 AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1), m AS (SELECT *, avg(n) OVER () AS mu FROM h)
SELECT h, round(n - mu, 7) AS raw, round((n - mu) / sqrt(mu), 7) AS pearson, round(sign(n - mu) * sqrt(greatest(0, 2 * (n * ln(n / mu) - (n - mu)))), 7) AS deviance FROM m"""
ORACLES["bootstrap_summary"] = "SELECT (event_id % 7)::INTEGER AS id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY 1"
ORACLES["segment_count"] = f"WITH {_EVENT_DAYS}, z AS (SELECT x, round(y / 10) * 10 AS z FROM days) SELECT sum(CASE WHEN j > 1e-6 THEN 1 ELSE 0 END)::BIGINT + 1 AS segments FROM (SELECT abs(z - lag(z) OVER (ORDER BY x)) AS j FROM z)"
ORACLES["ridge_factor_gaussian"] = """WITH s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS n1, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N'))::DOUBLE AS n2,
  sum(l_extendedprice / 1000) AS s, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice / 1000 END) AS s1, sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_extendedprice / 1000 END) AS s2 FROM lineitem),
b AS (SELECT *, (s - n1 * s1 / (n1 + 100) - n2 * s2 / (n2 + 100)) / (n - n1 * n1 / (n1 + 100) - n2 * n2 / (n2 + 100)) AS b0 FROM s)
SELECT 0::INTEGER AS k, round(b0, 6) AS beta FROM b UNION ALL SELECT 1, round((s1 - n1 * b0) / (n1 + 100), 6) FROM b UNION ALL SELECT 2, round((s2 - n2 * b0) / (n2 + 100), 6) FROM b"""
_C = ["u", "u * u", "u * u * u", "power(greatest(u - 0.5, 0), 3)"]
ORACLES["gram_spline_design"] = "WITH r AS (SELECT (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS u FROM lineitem) SELECT " + ", ".join(
    f"round(sum(({_C[i]}) * ({_C[j]})), 4) AS g{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM r"
ORACLES["contour_segments"] = """WITH g AS (SELECT i AS xi, j AS yi, -2.0::DOUBLE + 4.0::DOUBLE * i / 20 AS x, -1.0::DOUBLE + 4.0::DOUBLE * j / 16 AS y FROM range(21) a(i), range(17) b(j)),
v AS (SELECT *, x * x + y * y - x * y AS v FROM g), levels AS (SELECT unnest([0.5, 1.5, 3.0]::DOUBLE[]) AS level),
cells AS (SELECT level, a.xi, a.yi, [a.x, b.x, c.x, d.x] AS xs, [a.y, b.y, c.y, d.y] AS ys, [a.v, b.v, c.v, d.v] AS vs FROM levels, v a
  JOIN v b ON b.xi = a.xi + 1 AND b.yi = a.yi JOIN v c ON c.xi = a.xi + 1 AND c.yi = a.yi + 1 JOIN v d ON d.xi = a.xi AND d.yi = a.yi + 1),
edges AS (SELECT *, unnest([1, 2, 3, 4]) AS e FROM cells),
cuts AS (SELECT level, xi, yi, e, xs[e] + (level - vs[e]) / (vs[e % 4 + 1] - vs[e]) * (xs[e % 4 + 1] - xs[e]) AS px, ys[e] + (level - vs[e]) / (vs[e % 4 + 1] - vs[e]) * (ys[e % 4 + 1] - ys[e]) AS py
  FROM edges WHERE (vs[e] <= level) <> (vs[e % 4 + 1] <= level)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY level, xi, yi ORDER BY e) - 1 AS k FROM cuts)
SELECT a.level, a.yi::INTEGER AS yi, a.xi::INTEGER AS xi, (a.k // 2)::INTEGER AS part, round(a.px, 8) AS x0, round(a.py, 8) AS y0, round(b.px, 8) AS x1, round(b.py, 8) AS y1
FROM numbered a JOIN numbered b ON a.level = b.level AND a.xi = b.xi AND a.yi = b.yi AND b.k = a.k + 1 WHERE a.k % 2 = 0"""
ORACLES["sparse_dispatch"] = """WITH c AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS c1, count(DISTINCT l_linestatus) AS c2, count(DISTINCT l_quantity) AS c3, count(DISTINCT l_suppkey) AS c4 FROM lineitem),
v AS (SELECT n, unnest(['l_returnflag', 'l_linestatus', 'l_quantity', 'l_suppkey']) AS name, unnest([c1, c2, c3, c4]) AS c, unnest([1, 2, 3, 4]) AS i FROM c)
SELECT v.name AS a, w.name AS b, v.n, v.c + w.c - 1 AS p, v.n * (v.c + w.c - 1) >= 250000 AND 3.0 / (v.c + w.c - 1) <= 0.12 AS sparse FROM v JOIN v w ON v.i < w.i"""
ORACLES["link_functions"] = """SELECT event_id, round(1 / (1 + exp(-u)), 8) AS logit, round(exp(u), 8) AS log, round(CASE WHEN u >= 0 AND u < 1 THEN power(1 - u * u * u, 3) ELSE 0 END, 8) AS tricube,
  round(CASE WHEN u >= 0 AND u < 1 THEN power(1 - u * u, 2) ELSE 0 END, 8) AS bisquare, round(sign(u) * greatest(abs(u) - 0.5, 0), 8) AS soft FROM (SELECT event_id, value / 100 - 2 AS u FROM events)"""
ORACLES["quadratic_forms"] = "SELECT event_id, round(greatest(1 + v * v * 2 + 0.125 * c * c + v - 0.5 * v * c, 0), 8) AS q FROM (SELECT event_id, value / 100 AS v, (user_id % 10)::DOUBLE AS c FROM events)"
