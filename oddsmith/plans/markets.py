"""Prediction markets: venue adapters, liquidity, resolution risk, opportunities, thresholds, dislocation, consensus."""

from __future__ import annotations

from oddsmith.functions import probability as P
from oddsmith.functions.dialect import Spark
from oddsmith.plans import relations as R

#: Function words that titles are compared without.
TITLE_STOPWORDS = (
    "a", "an", "the", "will", "would", "be", "is", "are", "was", "were", "been", "to", "of", "in", "on", "at", "by", "for", "or", "and", "do", "does", "did", "it", "its", "this", "that", "than",
)
#: Fixed value: titles are linked above this similarity.
LINK_ABOVE = 0.6
#: Series of venue tickers, with and without a known underlying.
TICKERS = ("KXBTCD", "KXETH", "SOLY", "KXDOGEMAXY", "FED", "BTC", "KXXRPH", "KXBTCMINY", "DOGEX", "KXNBA", "ETHMAX")


def title_tokens(d: Spark, title: str) -> str:
    """Lower-case words without function words, years and numbers; a plural s of four letters and more is dropped."""
    stop = ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)
    words = d.regex_all(f"lower({title})", "[a-z0-9]+")
    kept = d.filter(words, "w", f"w NOT IN ({stop}) AND NOT {d.matches('w', '^[0-9]+$')}")
    return d.sort(d.distinct(d.map(kept, "w", f"CASE WHEN length(w) >= 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END")))


def plans(d: Spark) -> dict[str, str]:
    quotes, book = R.quotes(d), R.book(d)
    log_score = lambda v, lo, hi: P.clamp(f"(100e0 * (log10({v} + 1e0) - {lo}e0) / ({hi}e0 - {lo}e0))", "0e0", "100e0")
    liq = f"""liq AS (SELECT *, CASE WHEN spread IS NULL THEN 35e0 ELSE 100e0 / (1e0 + power(spread / 0.04e0, 2)) END AS s_spread,
    0.5e0 * {log_score("volume", 2, 6)} + 0.3e0 * {log_score("volume24h", 1.5, 5)} + 0.2e0 * {log_score("liquidity", 2, 5)} AS s_volume FROM quotes),
graded AS (SELECT *, least(70e0, (0.45e0 * s_spread + 0.30e0 * s_volume) / 0.75e0) AS score FROM liq)"""
    grade = "CASE WHEN score >= 80e0 THEN 'excellent' WHEN score >= 60e0 THEN 'good' WHEN score >= 40e0 THEN 'fair' WHEN score >= 20e0 THEN 'poor' ELSE 'illiquid' END"
    shape = "CASE WHEN hours IS NULL THEN 0.85e0 WHEN hours < 6e0 THEN greatest(0.75e0 + 0.25e0 * hours / 6e0, CASE WHEN grade = 'excellent' THEN 0.95e0 ELSE 0e0 END) WHEN hours <= 2160e0 THEN 1e0 ELSE greatest(0.6e0, 1e0 - (hours / 24e0 - 90e0) / 365e0) END"
    opp = f"""{quotes}, {liq},
cand AS (SELECT *, {grade} AS grade, least(greatest(p + CAST((market * 13 + venue * 7) % 41 - 20 AS DOUBLE) / 100e0, 0.01e0), 0.99e0) AS model, CAST((market + venue) % 60 + 40 AS DOUBLE) / 100e0 AS conf, CAST(market % 50 + 50 AS DOUBLE) AS dq,
    CAST(venue % 40 + 60 AS DOUBLE) / 100e0 AS agree, CAST(market % 5 AS DOUBLE) / 10e0 AS news, CASE market % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk,
    CASE WHEN venue % 6 = 0 THEN NULL ELSE CAST((market * 31) % 4000 AS DOUBLE) END AS hours, market % 17 = 0 AS demo, CASE WHEN market % 4 = 0 THEN NULL ELSE CAST((market * 3 + venue) % 60 - 20 AS DOUBLE) / 100e0 END AS past_skill, CAST(market % 7 AS DOUBLE) * 20e0 AS past_n FROM graded),
s0 AS (SELECT *, model - p AS edge, model - (p + spread / 2e0) AS ev, {shape} AS time_part FROM cand),
s1 AS (SELECT *, 100e0 * (0.26e0 * tanh(abs(edge) / 0.06e0) + 0.18e0 * conf + 0.10e0 * dq / 100e0 + 0.10e0 * agree + 0.14e0 * score / 100e0 + 0.10e0 * least(1e0, greatest(0e0, 0.5e0 + 0.5e0 * coalesce(past_skill * past_n / (past_n + 25e0), 0e0))) + 0.06e0 * time_part) / 0.94e0
    * CASE risk WHEN 'low' THEN 1e0 WHEN 'medium' THEN 0.8e0 ELSE 0.55e0 END * (1e0 - 0.3e0 * news) AS raw FROM s0),
opps AS (SELECT *, CASE WHEN spread >= abs(edge) THEN least(35e0, raw) ELSE raw END AS total FROM s1)"""
    reasons = d.filter(d.array(
        "CASE WHEN demo THEN 'demo' ELSE '' END", "CASE WHEN abs(edge) < 0.04e0 THEN 'edge' ELSE '' END", "CASE WHEN conf < 0.45e0 THEN 'confidence' ELSE '' END", "CASE WHEN grade IN ('poor', 'illiquid') THEN 'liquidity' ELSE '' END",
        "CASE WHEN spread >= abs(edge) THEN 'spread' ELSE '' END", "CASE WHEN risk = 'high' AND abs(edge) < 0.10e0 THEN 'risk' ELSE '' END", "CASE WHEN total < 45e0 THEN 'score' ELSE '' END"), "x", "x <> ''")
    tokens = title_tokens(d, "title")
    digital = lambda s, k, v, t: P.normal_cdf(f"(ln({s} / {k}) / ({v} * sqrt({t})))")
    risk_text = "lower(coalesce(description, ''))"
    sourced = f"({d.matches('description', 'https?://')} OR {d.matches('description', '[a-z0-9][.](com|org|gov|net|test)')} OR {d.matches('description', '[A-Z][a-z]+ [A-Z][a-z]+')})"
    return {
        "market_binary_outcomes": f"WITH {quotes} SELECT market, venue, round(p, 6) AS yes, round(1e0 - p, 6) AS no, round(least(greatest(p - spread / 2e0, 0e0), 1e0), 6) AS bid, round(least(p + spread / 2e0, 1e0), 6) AS ask FROM quotes",
        "market_book_reflection": f"""WITH {book}, no_bids AS (SELECT book_id, round(qty / 1000e0, 4) AS size, CAST(CAST(round(price * 100) AS BIGINT) % 100 AS DOUBLE) / 100e0 AS p FROM book WHERE side = 'bid')
SELECT book_id, round(1e0 - p, 4) AS yes_ask, sum(size) AS size, CAST(row_number() OVER (PARTITION BY book_id ORDER BY round(1e0 - p, 4)) AS BIGINT) AS best FROM no_bids GROUP BY book_id, round(1e0 - p, 4)""",
        "market_ticker_underlying": f"""WITH t AS (SELECT p_partkey AS id, concat({d.at(d.array(*(d.lit(x) for x in TICKERS)), f"CAST(p_partkey % {len(TICKERS)} + 1 AS INT)")}, '-', CAST(p_size AS VARCHAR(10)), 'DEC31') AS ticker FROM part)
SELECT id, ticker, nullif({d.regex_one(d.at(d.split("ticker", "-"), 1), "^(?:KX)?(BTC|ETH|SOL|XRP|DOGE)(?:D|H|Y|MAXY?|MINY?)?$")}, '') AS underlying FROM t""",
        "market_status": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'settled' WHEN o_orderkey % 5 = 0 THEN 'closed' WHEN o_orderkey % 7 = 0 THEN 'suspended' WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'unknown' END AS status FROM orders",
        "liquidity_scores": f"WITH {quotes.replace('quotes AS (', 'all_quotes AS (', 1)}, quotes AS (SELECT market, venue, p, volume, volume24h, liquidity, CASE WHEN venue % 7 > 0 THEN spread END AS spread, updated FROM all_quotes), {liq} SELECT market, venue, round(s_spread, 5) AS spread_score, round(s_volume, 5) AS volume_score, round(score, 5) AS score, {grade} AS grade FROM graded",
        "liquidity_depth": f"""WITH {R.market_books(d)}, m AS (SELECT book_id, (max(CASE WHEN side = 'bid' THEN price END) + min(CASE WHEN side = 'ask' THEN price END)) / 2e0 AS mid FROM market_books GROUP BY book_id),
z AS (SELECT b.book_id, sum(CASE WHEN abs(b.price - m.mid) <= 0.05e0 + 1e-9 THEN qty ELSE 0e0 END) AS v FROM market_books b JOIN m ON m.book_id = b.book_id GROUP BY b.book_id) SELECT book_id, round({log_score("v", 1, 4)}, 5) AS depth FROM z""",
        "liquidity_composite": f"""WITH {quotes}, {liq}, {R.market_books(d)}, mid AS (SELECT book_id, (max(CASE WHEN side = 'bid' THEN price END) + min(CASE WHEN side = 'ask' THEN price END)) / 2e0 AS mid FROM market_books GROUP BY book_id),
near AS (SELECT b.book_id, sum(CASE WHEN abs(b.price - m.mid) <= 0.05e0 + 1e-9 THEN qty ELSE 0e0 END) AS v FROM market_books b JOIN mid m ON m.book_id = b.book_id GROUP BY b.book_id),
with_depth AS (SELECT g.market, g.venue, g.s_spread, g.s_volume, CASE WHEN g.market % 3 > 0 THEN {log_score("n.v", 1, 4)} END AS depth FROM graded g LEFT JOIN near n ON n.book_id = g.venue),
final AS (SELECT market, venue, depth, CASE WHEN depth IS NULL THEN least(70e0, (0.45e0 * s_spread + 0.30e0 * s_volume) / 0.75e0) ELSE 0.45e0 * s_spread + 0.30e0 * s_volume + 0.25e0 * depth END AS score FROM with_depth)
SELECT market, venue, round(depth, 5) AS depth, round(score, 5) AS score, {grade} AS grade FROM final""",
        "liquidity_slippage": f"""WITH {book}, a AS (SELECT book_id, price, qty, sum(price * qty) OVER (PARTITION BY book_id ORDER BY price ROWS UNBOUNDED PRECEDING) AS cum FROM book WHERE side = 'ask'),
f AS (SELECT book_id, price, qty, least(greatest(20000e0 - (cum - price * qty), 0e0), price * qty) AS spent, cum FROM a)
SELECT book_id, CASE WHEN max(cum) < 20000e0 THEN NULL ELSE round(greatest(0e0, 20000e0 / sum(spent / price) - min(price)), 6) END AS slippage FROM f GROUP BY book_id""",
        "resolution_risk": f"""WITH {R.titles(d)}, s AS (SELECT id, CASE WHEN description IS NULL THEN 2 ELSE
    CASE WHEN {risk_text} LIKE '%in the sole discretion%' THEN 1 ELSE 0 END + CASE WHEN {risk_text} LIKE '%may be determined%' THEN 1 ELSE 0 END + CASE WHEN {risk_text} LIKE '%or similar%' THEN 1 ELSE 0 END + CASE WHEN {risk_text} LIKE '%consensus of%' THEN 1 ELSE 0 END
    + CASE WHEN {risk_text} LIKE '%official source%' AND NOT {sourced} THEN 1 ELSE 0 END + CASE WHEN NOT {sourced} THEN 1 ELSE 0 END
    + CASE WHEN {d.matches(risk_text, "\\bsignificant\\b")} THEN 1 ELSE 0 END + CASE WHEN {d.matches(risk_text, "\\bmajor\\b")} THEN 1 ELSE 0 END + CASE WHEN {d.matches(risk_text, "\\bwidely reported\\b")} THEN 1 ELSE 0 END END
    + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS points FROM titles)
SELECT id, points, CASE WHEN points = 0 THEN 'low' WHEN points <= 2 THEN 'medium' ELSE 'high' END AS risk FROM s""",
        "opportunity_evaluate": f"WITH {opp} SELECT market, venue, round(edge, 6) AS edge, round(ev, 6) AS ev, round(total, 5) AS score, {d.join(reasons, ',')} AS reasons, {d.size(reasons)} = 0 AS actionable FROM opps",
        "briefing_top_opportunities": f"""WITH {opp}, r AS (SELECT market, venue, total, {d.size(reasons)} = 0 AS actionable, {d.at(reasons, 1)} AS reason FROM opps),
best AS (SELECT market, venue, total, 'actionable' AS part, CAST(NULL AS VARCHAR(20)) AS reason FROM r WHERE actionable ORDER BY round(total, 6) DESC, market, venue LIMIT 5),
no AS (SELECT market, venue, total, 'rejected' AS part, reason FROM r WHERE NOT actionable ORDER BY round(total, 6) DESC, market, venue LIMIT 2)
SELECT market, venue, round(total, 5) AS score, part, reason FROM best UNION ALL SELECT market, venue, round(total, 5), part, reason FROM no""",
        "opportunity_time_shape": f"SELECT event_id, round({shape}, 6) AS shape FROM (SELECT event_id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE CAST(event_id * 7 % 9000 AS DOUBLE) / CASE WHEN event_id % 5 = 0 THEN 1000e0 ELSE 1e0 END END AS hours, CASE WHEN event_id % 2 = 0 THEN 'excellent' ELSE 'good' END AS grade FROM events) AS x",
        "opportunity_rank_score": f"WITH {opp} SELECT market, venue, CAST(rk AS BIGINT) AS rk FROM (SELECT market, venue, row_number() OVER (ORDER BY round(total, 6) DESC, market, venue) AS rk FROM (SELECT * FROM opps ORDER BY round(total, 6) DESC, market, venue LIMIT 100) AS t) AS r",
        "opportunity_rank_edge_change": f"""WITH {opp}, top AS (SELECT market, venue, round(abs(edge), 6) AS e, round(abs({P.logit("model")} - {P.logit("p")}), 6) AS moved, round(edge, 6) AS signed_edge FROM opps)
SELECT market, venue, e, moved, signed_edge FROM top ORDER BY moved DESC, e DESC, market, venue LIMIT 100""",
        "opportunity_list_ending_soon": f"WITH {opp} SELECT market, venue, hours FROM opps ORDER BY hours ASC NULLS LAST, market, venue LIMIT 100",
        "opportunity_list_risk": f"WITH {opp} SELECT market, venue, risk, news FROM opps ORDER BY CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, news, market, venue LIMIT 100",
        "threshold_probability": f"""WITH q AS (SELECT event_id, 100e0 + value AS spot, 80e0 + CAST(event_id % 160 AS DOUBLE) AS strike, 0.3e0 + CAST(event_id % 8 AS DOUBLE) / 10e0 AS vol, CAST(event_id % 400 AS DOUBLE) / 365.25e0 AS years FROM events)
SELECT event_id, round(CASE WHEN years < 1e0 / 8766e0 THEN CASE WHEN spot > strike THEN 1e0 WHEN spot = strike THEN 0.5e0 ELSE 0e0 END ELSE {digital("spot", "strike", "vol", "greatest(years, 0.0001e0)")} END, 6) AS above FROM q""",
        "threshold_range": f"""WITH q AS (SELECT event_id, 100e0 + value AS spot, 80e0 + CAST(event_id % 60 AS DOUBLE) AS lo, 90e0 + CAST(event_id % 90 AS DOUBLE) AS hi, 0.5e0 AS vol, 0.25e0 AS t FROM events)
SELECT event_id, CASE WHEN hi <= lo THEN NULL ELSE round(least(greatest({digital("spot", "lo", "vol", "t")} - {digital("spot", "hi", "vol", "t")}, 0e0), 1e0), 6) END AS p FROM q""",
        "market_scan": f"""WITH {R.bars(d, 86_400_000)}, r AS (SELECT asset, rn, ln(c / lag(c) OVER (PARTITION BY asset ORDER BY rn)) AS r, c FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY rn DESC) - 1 AS back FROM r WHERE r IS NOT NULL),
v AS (SELECT asset, sqrt(sum(CASE WHEN rn = 2 THEN power(0.94e0, back) ELSE 0e0 END * r * r + CASE WHEN back > 0 THEN 0.06e0 * power(0.94e0, back - 1) ELSE 0e0 END * r * r)) * sqrt(365e0) AS vol, max_by(c, rn) AS spot FROM k GROUP BY asset),
m AS (SELECT p_partkey AS market, CASE p_partkey % 7 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' WHEN 2 THEN 'view' ELSE 'none' END AS asset, 20e0 + CAST(p_size AS DOUBLE) AS strike, CAST(p_partkey % 90 + 1 AS DOUBLE) / 365.25e0 AS t FROM part)
SELECT count(*) AS scanned, count(v.asset) AS covered, count(*) - count(v.asset) AS no_coverage, round(avg(CASE WHEN v.vol > 0e0 THEN {digital("v.spot", "m.strike", "greatest(v.vol, 0.000001e0)", "m.t")} END), 5) AS mean_p FROM m LEFT JOIN v ON v.asset = m.asset""",
        "title_tokens": f"WITH {R.titles(d)} SELECT id, {d.join(tokens, ' ')} AS tokens FROM titles",
        "dislocation_detect": f"""WITH {quotes}, g AS (SELECT market, count(*) AS n, max(p) - min(p) AS spread FROM quotes WHERE p > 0e0 AND p < 1e0 GROUP BY market),
m AS (SELECT *, least(greatest(avg(p) OVER (PARTITION BY market) + CAST((market * 13) % 41 - 20 AS DOUBLE) / 100e0, 0.01e0), 0.99e0) AS model FROM quotes WHERE p > 0e0 AND p < 1e0),
e AS (SELECT market, venue, abs(model - p) AS edge, row_number() OVER (PARTITION BY market ORDER BY round(abs(model - p), 9) DESC, venue) AS rk FROM m)
SELECT g.market, g.n, round(g.spread, 6) AS spread, e.venue AS widest, round(e.edge, 6) AS edge FROM g JOIN e ON e.market = g.market AND e.rk = 1 WHERE g.n >= 2 AND g.spread >= 0.05e0""",
        "consensus_weighted": f"""WITH {quotes}, w AS (SELECT market, p, volume * greatest(0.02e0, CAST(venue % 10 AS DOUBLE) / 9e0) AS w, CAST(venue % 10 AS DOUBLE) / 9e0 AS ind FROM quotes)
SELECT market, round({P.sigmoid("x")}, 6) AS p, round(greatest(1e0, simpson * ind), 6) AS effective, round(1e0 - ind, 6) AS herding FROM (SELECT market, sum(w * {P.logit("p")}) / sum(w) AS x, power(sum(w), 2) / sum(w * w) AS simpson, avg(ind) AS ind FROM w GROUP BY market) AS s""",
        "consensus_independence": f"""WITH s AS (SELECT event_type AS market, user_id AS trader, CAST(floor({d.epoch_ms("ts")} / 60000e0) AS BIGINT) AS minute, value AS size, CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE -1e0 END AS side, event_id FROM events),
t AS (SELECT market, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT minute) AS DOUBLE) AS minutes, CAST(count(DISTINCT round(size, 4)) AS DOUBLE) AS sizes, CAST(count(DISTINCT trader) AS DOUBLE) AS traders, avg(side) AS imb FROM s GROUP BY market)
SELECT market, CASE WHEN n < 2e0 THEN 1e0 ELSE round(power(minutes / n, 0.5e0) * power(sizes / n, 0.25e0) * power(traders / n, 0.15e0) * power(greatest(0.25e0, 1e0 - imb * imb), 0.1e0), 6) END AS independence FROM t""",
    }
