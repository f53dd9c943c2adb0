"""Technical indicators, volatility, structure and order flow over candles; windows per asset in time order, null while warming up."""

from __future__ import annotations

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import Spark
from oddsmith.plans import relations as R


def frame(p: int, last: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY asset ORDER BY rn ROWS BETWEEN {p - 1} PRECEDING AND {last})"


def over(f: str, p: int) -> str:
    """A function of the last p rows, null before there are p."""
    return f"CASE WHEN rn >= {p} THEN {f} OVER {frame(p)} END"


def ema_sql(period: int, alpha: float, x: str = "c", seed_from: int = 1) -> str:
    """DuckDB's recursive form of an average seeded with the mean of the first `period` values: the oracle of the grouped fold."""
    return f"""src AS (SELECT asset, rn, {x} AS x FROM bars WHERE rn >= {seed_from}),
seed AS (SELECT asset, {period + seed_from - 1} AS rn, avg(x) AS e FROM src WHERE rn <= {period + seed_from - 1} GROUP BY asset HAVING count(*) = {period}),
rec AS (SELECT asset, CAST(rn AS BIGINT) AS rn, e FROM seed UNION ALL SELECT s.asset, s.rn, {alpha!r}e0 * s.x + (1e0 - {alpha!r}e0) * r.e FROM rec r JOIN src s ON s.asset = r.asset AND s.rn = r.rn + 1)"""


def cci_deviation(d: Spark) -> str:
    """CTE dev: m with the mean absolute deviation of the last twenty typical prices; the checking engine joins what Spark keeps in the frame."""
    if d.name == "duckdb":
        return """dev AS (SELECT a.asset, a.rn, min(a.tp) AS tp, min(a.mean) AS mean, avg(abs(b.tp - a.mean)) AS mad FROM m a JOIN m b ON b.asset = a.asset AND b.rn BETWEEN a.rn - 19 AND a.rn WHERE a.rn >= 20 GROUP BY a.asset, a.rn)"""
    return """held AS (SELECT *, collect_list(tp) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS last FROM m),
dev AS (SELECT asset, rn, tp, mean, aggregate(last, 0e0, (s, x) -> s + abs(x - mean)) / 20e0 AS mad FROM held WHERE rn >= 20)"""


def plans(d: Spark) -> dict[str, str]:
    bars = R.bars(d)
    tp = "(h + l + c) / 3e0"
    ranged = f"""ranged AS (SELECT *, {over("max(h)", 14)} AS hh, {over("min(l)", 14)} AS ll FROM bars)"""
    ret = """ret AS (SELECT *, CASE WHEN rn = 1 THEN NULL WHEN c > 0e0 AND lag(c) OVER (PARTITION BY asset ORDER BY rn) > 0e0 THEN ln(c / lag(c) OVER (PARTITION BY asset ORDER BY rn)) ELSE 0e0 END AS r FROM bars)"""
    tr = """tr AS (SELECT *, CASE WHEN rn > 1 THEN greatest(h - l, abs(h - lag(c) OVER (PARTITION BY asset ORDER BY rn)), abs(l - lag(c) OVER (PARTITION BY asset ORDER BY rn))) END AS tr FROM bars)"""
    swings = """sw AS (SELECT *, count(*) OVER (PARTITION BY asset) AS total,
    max(h) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS h_before, max(h) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS h_after,
    min(l) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l_before, min(l) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS l_after FROM bars),
swing AS (
  SELECT asset, rn, 'high' AS kind, h AS price FROM sw WHERE rn > 2 AND rn <= total - 2 AND h > h_before AND h > h_after
  UNION ALL SELECT asset, rn, 'low', l FROM sw WHERE rn > 2 AND rn <= total - 2 AND l < l_before AND l < l_after)"""
    book = f"""{R.book(d)}, best AS (SELECT book_id, max(CASE WHEN side = 'bid' THEN price END) AS bid, min(CASE WHEN side = 'ask' THEN price END) AS ask FROM book GROUP BY book_id),
mids AS (SELECT *, (bid + ask) / 2e0 AS mid FROM best WHERE bid IS NOT NULL AND ask IS NOT NULL)"""
    depth = lambda pct: f"""near AS (SELECT b.book_id, sum(CASE WHEN side = 'bid' THEN qty ELSE 0e0 END) AS bids, sum(CASE WHEN side = 'ask' THEN qty ELSE 0e0 END) AS asks, count(*) AS n, max(qty) AS largest
  FROM book b JOIN mids m ON m.book_id = b.book_id WHERE abs(b.price - m.mid) <= m.mid * {pct}e0 GROUP BY b.book_id)"""  # noqa: E731
    return {
        "ta_sma": f"WITH {bars} SELECT asset, rn, round({over('avg(c)', 20)}, 6) AS sma20, round({over('avg(c)', 50)}, 6) AS sma50 FROM bars",
        "ta_wma": f"""WITH {bars} SELECT asset, rn, CASE WHEN rn >= 5 THEN round(({" + ".join(f"{5 - i} * lag(c, {i}) OVER (PARTITION BY asset ORDER BY rn)" for i in range(5))}) / 15e0, 6) END AS wma5 FROM bars""",
        "ta_bollinger": f"""WITH {bars}, b AS (SELECT asset, rn, c, {over("avg(c)", 20)} AS m, {over("stddev_pop(c)", 20)} AS sd FROM bars)
SELECT asset, rn, round(m + 2e0 * sd, 6) AS upper_band, round(m - 2e0 * sd, 6) AS lower_band, round({P.safe_div("4e0 * sd", "m", "0e0")}, 6) AS bandwidth,
  round(CASE WHEN sd IS NULL THEN NULL WHEN sd < 1e-12 THEN 0.5e0 ELSE (c - (m - 2e0 * sd)) / nullif(4e0 * sd, 0e0) END, 6) AS percent_b FROM b""",
        "ta_stochastic": f"""WITH {bars}, {ranged}, k AS (SELECT asset, rn, CASE WHEN hh IS NULL THEN NULL WHEN hh = ll THEN 50e0 ELSE least(greatest(100e0 * (c - ll) / nullif(hh - ll, 0e0), 0e0), 100e0) END AS k FROM ranged)
SELECT asset, rn, round(k, 6) AS k, CASE WHEN rn >= 16 THEN round(avg(k) OVER {frame(3)}, 6) END AS d FROM k""",
        "ta_roc_momentum": f"""WITH {bars}, x AS (SELECT asset, rn, c, lag(c, 10) OVER (PARTITION BY asset ORDER BY rn) AS past FROM bars)
SELECT asset, rn, round({P.safe_div("(c - past) * 100e0", "past")}, 6) AS roc, round(c - past, 6) AS momentum FROM x""",
        "ta_cci": f"""WITH {bars}, t AS (SELECT asset, rn, {tp} AS tp FROM bars), m AS (SELECT *, {over("avg(tp)", 20)} AS mean FROM t),
{cci_deviation(d)}
SELECT asset, rn, round(CASE WHEN mad < 1e-12 THEN 0e0 ELSE (tp - mean) / nullif(0.015e0 * mad, 0e0) END, 5) AS cci FROM dev""",
        "ta_williams_r": f"WITH {bars}, {ranged} SELECT asset, rn, round(CASE WHEN hh IS NULL THEN NULL WHEN hh = ll THEN -50e0 ELSE -100e0 * (hh - c) / nullif(hh - ll, 0e0) END, 6) + 0e0 AS williams FROM ranged",
        "ta_mfi": f"""WITH {bars}, t AS (SELECT asset, rn, v, {tp} AS tp, lag({tp}) OVER (PARTITION BY asset ORDER BY rn) AS past FROM bars),
f AS (SELECT asset, rn, CASE WHEN tp > past THEN tp * v ELSE 0e0 END AS up, CASE WHEN tp < past THEN tp * v ELSE 0e0 END AS down FROM t),
s AS (SELECT asset, rn, sum(up) OVER {frame(14)} AS up, sum(down) OVER {frame(14)} AS down FROM f)
SELECT asset, rn, round(CASE WHEN up = 0e0 AND down = 0e0 THEN 50e0 WHEN down = 0e0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + up / nullif(down, 0e0)) END, 5) AS mfi FROM s WHERE rn >= 15""",
        "ta_true_range": f"WITH {bars}, {tr} SELECT asset, rn, round(tr, 6) AS true_range FROM tr",
        "ta_obv": f"""WITH {bars}, x AS (SELECT asset, rn, CASE WHEN rn = 1 OR c = lag(c) OVER (PARTITION BY asset ORDER BY rn) THEN 0e0 WHEN c > lag(c) OVER (PARTITION BY asset ORDER BY rn) THEN v ELSE -v END AS s FROM bars)
SELECT asset, rn, round(sum(s) OVER (PARTITION BY asset ORDER BY rn ROWS UNBOUNDED PRECEDING), 4) + 0e0 AS obv FROM x""",
        "ta_vwap_session": f"""WITH {bars}, x AS (SELECT asset, rn, v, {tp} AS tp, CAST(floor(open_time / 86400000e0) AS BIGINT) AS session FROM bars)
SELECT asset, rn, round({P.safe_div("sum(tp * v) OVER w", "sum(v) OVER w")}, 6) AS vwap FROM x WINDOW w AS (PARTITION BY asset, session ORDER BY rn ROWS UNBOUNDED PRECEDING)""",
        "ta_vwap_rolling": f"WITH {bars}, x AS (SELECT asset, rn, v, {tp} * v AS tv FROM bars) SELECT asset, rn, CASE WHEN rn >= 20 THEN round(sum(tv) OVER {frame(20)} / nullif(sum(v) OVER {frame(20)}, 0e0), 6) END AS vwap20 FROM x",
        "ta_typical_price": f"WITH {bars} SELECT asset, rn, round({tp}, 6) AS typical FROM bars",
        "vol_realised_annualised": f"WITH {bars}, {ret} SELECT asset, rn, CASE WHEN rn >= 21 THEN round(stddev_pop(r) OVER {frame(20)}, 6) END AS vol, CASE WHEN rn >= 21 THEN round(stddev_pop(r) OVER {frame(20)} * sqrt(8760e0), 5) END AS annual FROM ret",
        "vol_annualise_timeframes": f"""WITH {bars}, {ret}, s AS (SELECT asset, stddev_pop(r) AS vol FROM ret GROUP BY asset), f AS (SELECT * FROM (VALUES ('1m', 525600e0), ('5m', 105120e0), ('15m', 35040e0), ('1h', 8760e0), ('4h', 2190e0), ('1d', 365e0)) AS t(timeframe, periods))
SELECT asset, timeframe, round(vol * sqrt(periods), 4) AS annual FROM s CROSS JOIN f""",
        "window_tail_percentile": f"""WITH {bars}, t AS (SELECT asset, rn, c, row_number() OVER (PARTITION BY asset ORDER BY rn DESC) AS back FROM bars), now AS (SELECT asset, c FROM t WHERE back = 1)
SELECT t.asset, count(*) AS n, round((sum(CASE WHEN t.c < n.c THEN 1e0 ELSE 0e0 END) + sum(CASE WHEN t.c = n.c THEN 0.5e0 ELSE 0e0 END)) / count(*), 6) AS percentile FROM t JOIN now n ON n.asset = t.asset WHERE t.back <= 100 GROUP BY t.asset""",
        "window_last_defined": f"""WITH {bars}, x AS (SELECT asset, rn, CASE WHEN n % 3 = 0 THEN NULL ELSE c END AS c FROM bars)
SELECT asset, max_by(c, CASE WHEN c IS NOT NULL THEN rn END) AS last_known, min_by(c, CASE WHEN c IS NOT NULL THEN rn END) AS first_known FROM x GROUP BY asset""",
        "vol_parkinson": f"""WITH {bars}, x AS (SELECT asset, rn, CASE WHEN h > 0e0 AND l > 0e0 THEN power(ln(h / l), 2) END AS q FROM bars)
SELECT asset, rn, CASE WHEN rn >= 20 THEN round(sqrt(avg(q) OVER {frame(20)} / (4e0 * ln(2e0))), 6) END AS parkinson FROM x""",
        "vol_garman_klass": f"""WITH {bars}, x AS (SELECT asset, rn, CASE WHEN h > 0e0 AND l > 0e0 AND o > 0e0 AND c > 0e0 THEN 0.5e0 * power(ln(h / l), 2) - (2e0 * ln(2e0) - 1e0) * power(ln(c / o), 2) END AS q FROM bars)
SELECT asset, rn, CASE WHEN rn >= 20 THEN round(sqrt(greatest(0e0, avg(q) OVER {frame(20)})), 6) END AS garman_klass FROM x""",
        "structure_swings": f"WITH {bars}, {swings} SELECT asset, rn, kind, price FROM swing",
        "structure_trend": f"""WITH {bars}, {swings}, last4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, kind ORDER BY rn DESC) AS k FROM swing) AS z WHERE k <= 4),
steps AS (SELECT asset, kind, price, lag(price) OVER (PARTITION BY asset, kind ORDER BY rn) AS past FROM last4),
f AS (SELECT asset, kind, avg(CASE WHEN past IS NULL THEN NULL WHEN price > past THEN 1e0 ELSE 0e0 END) AS up, count(*) AS n, max(price) - min(price) AS span FROM steps GROUP BY asset, kind),
x AS (SELECT f.asset, min(f.n) AS n, count(*) AS sides, avg(up) AS up, max(span) AS span, min(z.c) AS c FROM f JOIN (SELECT asset, max_by(c, rn) AS c FROM bars GROUP BY asset) AS z ON z.asset = f.asset GROUP BY f.asset),
y AS (SELECT *, greatest(up, 1e0 - up) AS cons, least(greatest({P.safe_div("span", "c", "0e0")} / 0.05e0, 0e0), 1e0) AS disp FROM x)
SELECT asset, CASE WHEN n < 2 OR sides < 2 THEN 'ranging' WHEN up >= 0.75e0 THEN 'HH-HL' WHEN 1e0 - up >= 0.75e0 THEN 'LH-LL' WHEN disp < 0.4e0 THEN 'ranging' ELSE 'transition' END AS trend,
  round(CASE WHEN n < 2 OR sides < 2 THEN 0e0 WHEN cons >= 0.75e0 THEN 0.6e0 * cons + 0.4e0 * disp WHEN disp < 0.4e0 THEN 1e0 - disp / 0.4e0 ELSE disp END, 6) AS strength FROM y""",
        "structure_fibonacci": f"""WITH {bars}, e AS (SELECT asset, max(h) AS hi, min(l) AS lo FROM bars GROUP BY asset)
SELECT asset, r.ratio, r.kind, dir.up, round(CASE WHEN dir.up THEN CASE WHEN r.kind = 'retracement' THEN hi - (hi - lo) * r.ratio ELSE lo + (hi - lo) * r.ratio END
  ELSE CASE WHEN r.kind = 'retracement' THEN lo + (hi - lo) * r.ratio ELSE hi - (hi - lo) * r.ratio END END, 6) AS price FROM e
CROSS JOIN (VALUES (0.236e0, 'retracement'), (0.382e0, 'retracement'), (0.5e0, 'retracement'), (0.618e0, 'retracement'), (0.786e0, 'retracement'), (1.272e0, 'extension'), (1.618e0, 'extension')) AS r(ratio, kind) CROSS JOIN (VALUES (true), (false)) AS dir(up)""",
        "structure_volume_bins": f"""WITH {bars}, e AS (SELECT asset, max(h) AS hi, min(l) AS lo, (max(h) - min(l)) / 24e0 AS w FROM bars GROUP BY asset),
bins AS (SELECT {d.series(0, 23)} AS bin), g AS (SELECT e.asset, b.bin, lo + b.bin * w AS b0, lo + (b.bin + 1) * w AS b1, w FROM e CROSS JOIN bins b),
v AS (SELECT g.asset, g.bin, sum(CASE WHEN x.h = x.l THEN CASE WHEN x.l >= g.b0 AND (x.l < g.b1 OR g.bin = 23) THEN x.v ELSE 0e0 END
    ELSE x.v * greatest(0e0, least(x.h, g.b1) - greatest(x.l, g.b0)) / nullif(x.h - x.l, 0e0) END) AS volume, min(g.b0 + g.w / 2e0) AS mid
  FROM g JOIN bars x ON x.asset = g.asset AND x.h >= g.b0 AND x.l <= g.b1 GROUP BY g.asset, g.bin)
SELECT asset, CAST(bin AS BIGINT) AS bin, round(mid, 6) AS mid, round(volume, 5) AS volume FROM v""",
        "orderflow_imbalance": f"""WITH {book}, {depth("0.005")} SELECT m.book_id, round(m.mid, 6) AS mid, round((m.ask - m.bid) / m.mid * 10000e0, 6) AS spread_bps,
  round(CASE WHEN coalesce(n.bids + n.asks, 0e0) = 0e0 THEN 0e0 ELSE (n.bids - n.asks) / nullif(n.bids + n.asks, 0e0) END, 6) AS imbalance FROM mids m LEFT JOIN near n ON n.book_id = m.book_id""",
        "orderflow_walls": f"""WITH {book}, close_levels AS (SELECT b.book_id, b.side, b.price, b.qty, abs(b.price - m.mid) / m.mid AS dist FROM book b JOIN mids m ON m.book_id = b.book_id WHERE abs(b.price - m.mid) <= m.mid * 0.05e0),
med AS (SELECT book_id, side, {d.quantile("qty", 0.5)} AS med, count(*) AS n FROM close_levels GROUP BY book_id, side)
SELECT l.book_id, l.side, l.price, round(l.qty / m.med, 6) AS multiple, CAST(row_number() OVER (PARTITION BY l.book_id, l.side ORDER BY l.dist, l.price) AS BIGINT) AS nearest
FROM close_levels l JOIN med m ON m.book_id = l.book_id AND m.side = l.side WHERE m.n >= 5 AND l.qty >= 5e0 * m.med""",
        "orderflow_depth_score": f"""WITH {book}, {depth("0.01")} SELECT m.book_id, round(CASE WHEN coalesce(n.bids, 0e0) = 0e0 OR coalesce(n.asks, 0e0) = 0e0 THEN 0e0 ELSE
  0.35e0 * exp(-((m.ask - m.bid) / m.mid * 10000e0) / 10e0) + 0.3e0 * least(1e0, n.n / 40e0) + 0.2e0 * (1e0 - abs(n.bids - n.asks) / nullif(n.bids + n.asks, 0e0)) + 0.15e0 * (1e0 - n.largest / nullif(n.bids + n.asks, 0e0)) END, 6) AS depth_score
FROM mids m LEFT JOIN near n ON n.book_id = m.book_id""",
        "orderflow_aggressor": f"""WITH {bars}, t AS (SELECT asset, v, CASE WHEN n % 4 = 0 OR asset = 'error' THEN NULL ELSE least(greatest(tb, 0e0), v) END AS buy, row_number() OVER (PARTITION BY asset ORDER BY rn DESC) AS back FROM bars)
SELECT asset, round(sum(CASE WHEN buy IS NULL THEN 0e0 ELSE 2e0 * buy - v END) / nullif(sum(CASE WHEN buy IS NULL THEN 0e0 ELSE v END), 0e0), 6) AS imbalance, round(count(buy) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM t WHERE back <= 30 GROUP BY asset""",
        "scenarios": f"""WITH s AS (SELECT event_id AS id, CAST(event_id % 98 + 1 AS DOUBLE) / 100e0 AS p, 0.01e0 + CAST(event_id % 20 AS DOUBLE) / 200e0 AS sigma, 100e0 + value AS spot FROM events),
q AS (SELECT *, {P.normal_quantile("p")} AS z FROM s)
SELECT id, round({P.normal_cdf("(-0.5e0 - z)")}, 6) AS bear, round(1e0 - {P.normal_cdf("(0.5e0 - z)")}, 6) AS bull, round({P.normal_cdf("(0.5e0 - z)")} - {P.normal_cdf("(-0.5e0 - z)")}, 6) AS base,
  round(spot * exp(-1.645e0 * sigma), 6) AS low, round(spot * exp(1.645e0 * sigma), 6) AS high FROM q""",
        "timeframe_spec": "SELECT timeframe, candle, horizon FROM (VALUES ('15m', '15m', 1), ('1h', '1h', 1), ('4h', '4h', 1), ('24h', '1h', 24), ('7d', '4h', 42), ('30d', '1d', 30)) AS t(timeframe, candle, horizon)",
        "session_gap_windows": f"""WITH e AS (SELECT user_id, {d.epoch_ms("ts")} AS t FROM events), g AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600000 THEN 0 ELSE 1 END AS new_session FROM e),
s AS (SELECT user_id, t, sum(new_session) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(t) - min(t) AS length_ms FROM s GROUP BY user_id, session""",
        "sliding_day_stats": f"""WITH {bars}, hours AS (SELECT asset, open_time, v, h, l FROM bars), steps AS (SELECT asset, open_time, {d.series(0, 23)} AS k, v, h, l FROM hours)
SELECT asset, open_time + k * 3600000 AS window_end, round(sum(v), 4) AS volume, max(h) AS high, min(l) AS low FROM steps GROUP BY 1, 2""",
    }
