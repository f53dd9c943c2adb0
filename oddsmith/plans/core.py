"""Scalar probability, ensembles, metrics, calibration, learning weights and data quality."""

from __future__ import annotations

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import Spark
from oddsmith.plans import relations as R

#: Decimal odds per order, by integer remainders; long rows (id, key, ord, odds).
_ODDS = """odds AS (SELECT o_orderkey AS id, k.key AS key, k.ord AS ord, 1.4e0 + CAST((o_orderkey * k.m + o_custkey) % 50 AS DOUBLE) / 10e0 AS odds
  FROM orders CROSS JOIN (VALUES ('home', 0, 3), ('draw', 1, 7), ('away', 2, 11)) AS k(key, ord, m))"""


def devig_power(d: Spark, source: str = "odds") -> str:
    """CTE devig(id, key, ord, odds, fair): k in [0.5, 1.5] with sum((1/d)^k) = 1 over each id's book, then normalised. The sum is convex and falling in k, so eight Newton steps
    from 1 reach it; the checking engine bisects."""
    if d.name == "duckdb":
        body = f"""vig_books AS (SELECT id, list(1e0 / odds ORDER BY ord) AS q FROM {source} GROUP BY id),
vig_steps AS (
  SELECT id, q, 0.5e0 AS lo, 1.5e0 AS hi, 0 AS i FROM vig_books
  UNION ALL
  SELECT id, q, CASE WHEN list_sum(list_transform(q, lambda x: power(x, (lo + hi) / 2e0))) > 1e0 THEN (lo + hi) / 2e0 ELSE lo END,
    CASE WHEN list_sum(list_transform(q, lambda x: power(x, (lo + hi) / 2e0))) > 1e0 THEN hi ELSE (lo + hi) / 2e0 END, i + 1 FROM vig_steps WHERE i < 80),
vig_k AS (SELECT id, (lo + hi) / 2e0 AS k FROM vig_steps WHERE i = 80)"""
    else:
        power_sum, slope = "aggregate(q, 0e0, (s, x) -> s + power(x, k))", "aggregate(q, 0e0, (s, x) -> s + power(x, k) * ln(x))"
        body = f"""vig_books AS (SELECT id, collect_list(1e0 / odds) AS q FROM {source} GROUP BY id),
vig_k AS (SELECT id, aggregate(sequence(1, 8), 1e0, (k, i) -> greatest(0.5e0, least(1.5e0, k - ({power_sum} - 1e0) / {slope}))) AS k FROM vig_books)"""
    return f"""{body},
devig AS (SELECT o.id, o.key, o.ord, o.odds, power(1e0 / o.odds, k.k) / sum(power(1e0 / o.odds, k.k)) OVER (PARTITION BY o.id) AS fair
  FROM {source} o JOIN vig_k k ON k.id = o.id)"""


def plans(d: Spark) -> dict[str, str]:
    pred, outs = R.predictions(d), R.model_outputs(d)
    rec = "WITH RECURSIVE" if d.name == "duckdb" else "WITH"
    pooled = f"""{pred}, {outs}, voters AS (
  SELECT id, key, ord, actual, model, p, weight / sum(weight) OVER (PARTITION BY id, key) AS w FROM model_outputs WHERE NOT abstained AND weight > 0e0),
pool AS (SELECT id, key, min(ord) AS ord, min(actual) AS actual, count(*) AS n, sum(w * {P.logit("p")}) AS score, 1e0 / sum(w * w) AS effective FROM voters GROUP BY id, key),
pooled AS (SELECT *, exp(score - smax) / sum(exp(score - smax)) OVER (PARTITION BY id) AS p FROM (SELECT *, max(score) OVER (PARTITION BY id) AS smax FROM pool) AS y)"""
    conf_terms = f"""terms AS (
  SELECT o_orderkey AS id, 0.35e0 + 0.65e0 * {P.smoothstep("CAST(o_orderkey % 101 AS DOUBLE) / 100e0", 0.4, 0.95)} AS t1,
    0.30e0 + 0.70e0 * CAST(o_orderkey % 10 AS DOUBLE) / 9e0 AS t2, CAST(o_custkey AS DOUBLE) / (o_custkey + 200e0) AS t3,
    0.40e0 + 0.60e0 * power(CAST(o_orderkey % 7 AS DOUBLE) / 6e0, 1.5e0) AS t4, 0.65e0 + 0.35e0 * (CAST(o_custkey % 5 AS DOUBLE) / (o_custkey % 5 + 5e0)) AS t5,
    0.55e0 + 0.45e0 * CAST(o_orderkey % 4 AS DOUBLE) / 3e0 AS t6 FROM orders)"""
    names = ("data quality", "agreement", "sample", "completeness", "diversity", "regime")
    least = "least(t1, t2, t3, t4, t5, t6)"
    limiting = "CASE " + " ".join(f"WHEN t{i + 1} = {least} THEN '{n}'" for i, n in enumerate(names)) + " END"
    quality = """datasets AS (
  SELECT o_custkey AS subject, o_orderpriority AS capability, CAST(o_orderkey % 7200 AS DOUBLE) AS age, 900e0 + CAST(o_custkey % 5 AS DOUBLE) * 900e0 AS max_age,
    CAST(o_orderkey % 11 AS DOUBLE) / 10e0 AS completeness, o_orderkey % 3 + 1 AS n_sources, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS DOUBLE) / 40e0 END AS disagreement,
    CASE o_orderkey % 7 WHEN 0 THEN 1e0 WHEN 1 THEN 0.97e0 WHEN 2 THEN 0.92e0 WHEN 3 THEN 0.85e0 WHEN 4 THEN 0.70e0 WHEN 5 THEN 0.45e0 ELSE 0.25e0 END AS reliability FROM orders),
rated AS (SELECT *, greatest(0e0, 1e0 - age / (3e0 * max_age)) AS fresh,
    least(1e0, 0.55e0 + 0.225e0 * (n_sources - 1)) * CASE WHEN disagreement IS NULL THEN 0.85e0 ELSE 1e0 - least(1e0, disagreement) END AS corroboration FROM datasets),
scored AS (SELECT *, 0.3e0 * fresh + 0.3e0 * completeness + 0.2e0 * reliability + 0.2e0 * corroboration AS own FROM rated)"""
    return {
        "prob_clamp_logit_sigmoid": f"""SELECT event_id, round({P.clamp_probability("p")}, 9) AS clamped, round({P.logit("p")}, 6) AS logit, round({P.sigmoid("value - 50e0")}, 6) AS sigmoid
FROM (SELECT event_id, value, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) / 100e0 END AS p FROM events) AS x""",
        "prob_normalize": f"""WITH {_ODDS}, v AS (SELECT id, key, CASE WHEN id % 15 = 0 THEN 0e0 ELSE 1e0 / odds END AS x FROM odds)
SELECT id, key, round(CASE WHEN sum(x) OVER w = 0e0 THEN 1e0 / count(*) OVER w ELSE x / nullif(sum(x) OVER w, 0e0) END, 6) AS p FROM v WINDOW w AS (PARTITION BY id)""",
        "prob_softmax_temperature": f"""WITH {R.predictions(d)} SELECT id, key, round(exp((score - smax) / 2e0) / sum(exp((score - smax) / 2e0)) OVER (PARTITION BY id), 6) AS p FROM predictions""",
        "prob_odds_conversions": f"""WITH {_ODDS} SELECT id, key, odds, round(1e0 / odds, 6) AS implied, {P.american("odds")} AS american, round(sum(1e0 / odds) OVER (PARTITION BY id) - 1e0, 6) AS overround FROM odds""",
        "prob_devig_multiplicative": f"WITH {_ODDS} SELECT id, key, round((1e0 / odds) / sum(1e0 / odds) OVER (PARTITION BY id), 6) AS fair FROM odds",
        "prob_devig_power": f"{rec} {_ODDS}, {devig_power(d)} SELECT id, key, round(fair, 6) AS fair FROM devig",
        "prob_analyse_edge": f"""{rec} {_ODDS}, {devig_power(d)} SELECT id, key, round(m - fair, 6) AS edge, round(1e0 / m, 6) AS fair_odds, round(sum(1e0 / odds) OVER (PARTITION BY id) - 1e0, 6) AS overround
FROM (SELECT *, CAST((id + ord) % 60 + 20 AS DOUBLE) / 100e0 AS m FROM devig) AS x""",
        "prob_shrink_recency": f"""SELECT o_orderkey AS id, round({P.shrink("o_totalprice / 130000e0", "CAST(o_orderkey % 40 AS DOUBLE)", "1.35e0", "6e0")}, 6) AS shrunk,
  round(exp(-0.18e0 * (o_orderkey % 15)), 6) AS recency, round(ln(2e0) / 0.18e0, 6) AS half_life FROM orders""",
        "prob_kelly": f"""WITH {_ODDS}, x AS (SELECT id, key, odds, CAST((id * 7 + ord) % 60 + 10 AS DOUBLE) / 100e0 AS p FROM odds)
SELECT id, key, round({P.kelly_fraction("p", "odds")}, 6) AS kelly, round(least(0.02e0, 0.25e0 * {P.kelly_fraction("p", "odds")}), 6) AS stake, round(odds * p - 1e0, 6) AS ev, round(1e0 / odds, 6) AS breakeven FROM x""",
        "prob_normal_distribution": f"""SELECT event_id, round({P.erf("x")}, 6) AS erf_x, round({P.normal_cdf("x")}, 6) AS cdf, round({P.normal_quantile("q")}, 6) AS quantile
FROM (SELECT event_id, CAST(event_id % 801 - 400 AS DOUBLE) / 100e0 AS x, CAST(event_id % 999 + 1 AS DOUBLE) / 1000e0 AS q FROM events) AS t""",
        "prob_risk_level": f"""WITH {pred}, e AS (SELECT id, min(confidence) AS conf, -sum(CASE WHEN p > 0e0 THEN p * ln(p) ELSE 0e0 END) / ln(3e0) AS h,
    CAST(id % 13 AS DOUBLE) / 10e0 AS ext, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 17 AS DOUBLE) / 100e0 END AS vol FROM predictions GROUP BY id),
s AS (SELECT id, 0.35e0 * h + 0.30e0 * (1e0 - conf) + 0.15e0 * least(1e0, ext) + CASE WHEN vol IS NULL THEN 0.20e0 * h ELSE 0.20e0 * least(1e0, vol / 0.08e0) END AS score FROM e)
SELECT id, round(score, 6) AS score, {P.risk_level("round(score, 9)")} AS level FROM s""",
        "prob_direction": "SELECT event_id, CASE WHEN p > 0.52e0 THEN 'bullish' WHEN p < 0.48e0 THEN 'bearish' ELSE 'neutral' END AS direction FROM (SELECT event_id, CAST(event_id % 1000 AS DOUBLE) / 999e0 AS p FROM events) AS x",
        "prob_confidence": f"""WITH {conf_terms}, c AS (SELECT *, least(greatest(0.95e0 * t1 * t2 * t3 * t4 * t5 * t6, 0.01e0), 1e0) AS confidence FROM terms)
SELECT id, round(confidence, 6) AS confidence, {P.confidence_label("round(confidence, 9)")} AS label, {limiting} AS limiting FROM c""",
        "prob_build_prediction": f"""WITH {R.predictions(d)}, {outs}, src AS (
  SELECT id, key, model, p - 0.3333e0 AS contribution, abstained FROM model_outputs),
f AS (SELECT id, count(CASE WHEN coalesce(contribution, 0e0) >= 0e0 THEN 1 END) AS supporting, count(CASE WHEN contribution < 0e0 THEN 1 END) AS opposing, bool_or(abstained) AS any_missing FROM src GROUP BY id)
SELECT p.id, f.supporting, f.opposing, round(sum(p.p), 9) AS total, CASE WHEN bool_or(p.is_demo) THEN 'demo' WHEN bool_or(f.any_missing) THEN 'partial' ELSE 'live' END AS data_mode
FROM predictions p JOIN f ON f.id = p.id GROUP BY p.id, f.supporting, f.opposing""",
        # ensembles
        "ensemble_pool": f"WITH {pooled} SELECT id, key, round(p, 6) AS p, n AS voters, round(effective, 6) AS effective FROM pooled",
        "ensemble_agreement": f"""WITH {pooled}, l AS (SELECT id, key, {P.logit("p")} AS x, w FROM voters), m AS (SELECT id, key, sum(w * x) AS mu, count(*) AS n FROM l GROUP BY id, key),
s AS (SELECT l.id, l.key, min(m.n) AS n, sqrt(sum(l.w * power(l.x - m.mu, 2))) AS sd FROM l JOIN m ON m.id = l.id AND m.key = l.key GROUP BY l.id, l.key)
SELECT id, CASE WHEN min(n) < 2 THEN 1e0 ELSE round(1e0 - least(1e0, avg(sd) / 2.2e0), 6) END AS agreement FROM s GROUP BY id""",
        "ensemble_binary_pool": f"""WITH {R.predictions(d)}, {outs}, v AS (SELECT id, model, p, weight / sum(weight) OVER (PARTITION BY id) AS w FROM model_outputs WHERE key = 'F' AND NOT abstained)
SELECT id, round({P.sigmoid("x")}, 6) AS p0, round(1e0 - {P.sigmoid("x")}, 6) AS p1 FROM (SELECT id, sum(w * {P.logit("p")}) AS x FROM v GROUP BY id) AS s""",
        "ensemble_weights_from_skill": """WITH s AS (SELECT c_nationkey AS pool, c_custkey AS model, CASE WHEN c_custkey % 3 = 0 THEN 0.25e0 ELSE greatest(0e0, c_acctbal / 10000e0 - 0.4e0) END AS skill FROM customer)
SELECT pool, model, round(CASE WHEN sum(skill) OVER w = 0e0 THEN 1e0 / count(*) OVER w ELSE skill / nullif(sum(skill) OVER w, 0e0) END, 6) AS weight FROM s WINDOW w AS (PARTITION BY pool)""",
        # metrics
        "metric_brier_logloss": f"""WITH {pred}, per AS (SELECT id, sum(power(p - CASE WHEN key = actual THEN 1e0 ELSE 0e0 END, 2)) AS b, -ln({P.clamp_probability("max(CASE WHEN key = actual THEN p END)")}) AS l FROM predictions GROUP BY id)
SELECT count(*) AS n, round(avg(b), 6) AS brier, round(avg(l), 6) AS log_loss, round(1e0 - avg(b) / (2e0 / 3e0), 6) AS skill FROM per""",
        "metric_binary_baseline": f"""WITH {pred}, b AS (SELECT p, CASE WHEN actual = 'F' THEN 1e0 ELSE 0e0 END AS y FROM predictions WHERE key = 'F'), r AS (SELECT avg(y) AS rate, avg(power(p - y, 2)) AS brier FROM b)
SELECT round(brier, 6) AS brier, round(rate * rate * (1e0 - rate) + power(1e0 - rate, 2) * rate, 6) AS baseline, round(1e0 - brier / (rate * rate * (1e0 - rate) + power(1e0 - rate, 2) * rate), 6) AS skill FROM r""",
        "metric_directional_accuracy": f"""WITH {pred} SELECT round(avg(CASE WHEN key = actual THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, ord) AS rk FROM predictions) AS x WHERE rk = 1""",
        "metric_calibration": f"""WITH {pred}, bins AS (SELECT {d.series(0, 9)} AS bin), b AS (
  SELECT least(CAST(floor(p * 10e0) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(CASE WHEN key = actual THEN 1e0 ELSE 0e0 END) AS rate FROM predictions GROUP BY 1)
SELECT CAST(bins.bin AS BIGINT) AS bin, coalesce(b.n, 0) AS n, round(b.mean_p, 6) AS mean_p, round(b.rate, 6) AS rate, round(abs(b.mean_p - b.rate), 6) AS gap FROM bins LEFT JOIN b ON b.bin = bins.bin""",
        "metric_calibration_error": f"""WITH {pred}, b AS (
  SELECT least(CAST(floor(p * 10e0) AS BIGINT), 9) AS bin, count(*) AS n, abs(avg(p) - avg(CASE WHEN key = actual THEN 1e0 ELSE 0e0 END)) AS gap FROM predictions GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, CAST(sum(n) AS BIGINT) >= 500 AS displayable FROM b""",
        "metric_isotonic_apply": """WITH knots AS (SELECT * FROM (VALUES (0.1e0, 0.05e0), (0.3e0, 0.28e0), (0.5e0, 0.55e0), (0.7e0, 0.66e0), (0.9e0, 0.97e0)) AS t(x, y)),
spans AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM knots),
q AS (SELECT event_id, least(greatest(CAST(event_id % 1000 AS DOUBLE) / 999e0, 0.1e0), 0.9e0) AS p FROM events)
SELECT q.event_id, round(CASE WHEN s.x2 IS NULL THEN s.y ELSE s.y + (q.p - s.x) / (s.x2 - s.x) * (s.y2 - s.y) END, 6) AS calibrated FROM q JOIN spans s ON q.p >= s.x AND (q.p < s.x2 OR s.x2 IS NULL)""",
        "learn_predict_logistic": """WITH x AS (SELECT o_orderkey AS id, o_totalprice / 200000e0 AS f1, CAST(o_custkey % 10 AS DOUBLE) / 10e0 AS f2 FROM orders),
s AS (SELECT id, 0.2e0 + 0.8e0 * f1 - 0.3e0 * f2 AS a, -0.1e0 + 0.1e0 * f1 + 0.4e0 * f2 AS b, 0e0 - 0.5e0 * f1 + 0.2e0 * f2 AS c FROM x)
SELECT id, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS home, round(exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS draw
FROM (SELECT *, greatest(a, b, c) AS m FROM s) AS y""",
        "learn_adaptive_weights": f"""WITH {R.predictions(d)}, {outs}, r AS (SELECT model, count(DISTINCT id) AS n, sum(power(p - CASE WHEN key = actual THEN 1e0 ELSE 0e0 END, 2)) / count(DISTINCT id) AS brier FROM model_outputs WHERE NOT abstained GROUP BY model),
s AS (SELECT *, (1e0 - brier / (2e0 / 3e0)) * n / (n + 50e0) AS shrunk FROM r)
SELECT model, n, round(brier, 6) AS brier, CASE WHEN n < 30 THEN 1e0 ELSE round(least(greatest(1e0 + 2.5e0 * shrunk, 0.4e0), 1.6e0), 6) END AS weight FROM s""",
        # data quality
        "data_quality": f"""WITH {quality}, cov AS (SELECT count(DISTINCT o_orderpriority) AS expected FROM orders)
SELECT s.subject, {P.js_round("100e0 * (0.28e0 * avg(fresh) + 0.24e0 * avg(completeness) + 0.18e0 * avg(reliability) + 0.14e0 * avg(corroboration) + 0.16e0 * count(DISTINCT capability) / min(c.expected))")} AS score,
  bool_or(age > max_age) AS stale, round(min(own), 6) AS worst FROM scored s CROSS JOIN cov c GROUP BY s.subject""",
        "data_quality_missing": """SELECT c.c_custkey, p.o_orderpriority AS missing FROM customer c CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) AS p
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = p.o_orderpriority)""",
        "freshness_state": """SELECT event_id, CASE WHEN age IS NULL THEN 'expired' WHEN age < 5e0 THEN 'live' WHEN age / 900e0 < 0.5e0 THEN 'fresh' WHEN age / 900e0 < 1e0 THEN 'aging' WHEN age / 900e0 < 3e0 THEN 'stale' ELSE 'expired' END AS state,
  CASE WHEN age IS NULL THEN 'unknown' WHEN age < 60e0 THEN concat(CAST(CAST(floor(age) AS BIGINT) AS VARCHAR(20)), 's') WHEN age < 3600e0 THEN concat(CAST(CAST(floor(age / 60e0) AS BIGINT) AS VARCHAR(20)), 'm') ELSE concat(CAST(CAST(floor(age / 3600e0) AS BIGINT) AS VARCHAR(20)), 'h') END AS age_text
FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id % 4000 AS DOUBLE) END AS age FROM events) AS x""",
        "box_score_completeness": """SELECT l_suppkey, round(0.5e0 + 0.5e0 * sum(CASE WHEN l_discount > 0e0 THEN 1e0 ELSE 0e0 END + CASE WHEN l_tax > 0e0 THEN 1e0 ELSE 0e0 END) / (2e0 * count(*)), 6) AS completeness FROM lineitem GROUP BY l_suppkey""",
    }
