"""Relations of the forecasting domains, derived from the tables at hand; each is the text of one CTE."""

from __future__ import annotations

from oddsmith.functions.dialect import Spark


def bars(d: Spark, width_ms: int = 3_600_000, name: str = "bars") -> str:
    """Candles per asset and bucket; the first and last value by time are open and close."""
    t = f"CAST(floor({d.epoch_ms('ts')} / {width_ms}e0) AS BIGINT) * {width_ms}"
    return f"""{name}_raw AS (
  SELECT event_type AS asset, {t} AS open_time, min_by(value, ts) AS o, max(value) AS h, min(value) AS l, max_by(value, ts) AS c,
    sum(value) AS v, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0e0 END) AS tb, count(*) AS n
  FROM events GROUP BY event_type, {t}),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset ORDER BY open_time) AS BIGINT) AS rn FROM {name}_raw)"""


def games(d: Spark) -> str:
    """Fixtures: the customer's nation is at home, the first supplier's nation is away; scores by integer remainders."""
    return f"""first_supplier AS (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey),
games AS (
  SELECT o.o_orderkey AS game_id, {d.epoch_ms('o.o_orderdate')} AS kickoff, c.c_nationkey AS home, s.s_nationkey AS away,
    o.o_orderkey % 5 AS hs, o.o_custkey % 4 AS aws, {d.date_text('o.o_orderdate', 'yyyy')} AS season, n.n_regionkey AS league
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN first_supplier f ON f.l_orderkey = o.o_orderkey
    JOIN supplier s ON s.s_suppkey = f.suppkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  WHERE c.c_nationkey <> s.s_nationkey)"""


def expected_goals(d: Spark) -> str:
    """Expected goals of both sides by the first order's lines; games of fewer than three lines have none."""
    return """expected AS (SELECT l_orderkey AS game_id, 20e0 * avg(l_discount) AS home_xg, 25e0 * avg(l_tax) AS away_xg FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3)"""


def absences(d: Spark) -> str:
    """Players that may miss games: a nation's suppliers in debt, one status each."""
    return """absences AS (SELECT s_nationkey AS team, CASE s_suppkey % 6 WHEN 0 THEN 'out' WHEN 1 THEN 'suspended' WHEN 2 THEN 'doubtful' WHEN 3 THEN 'questionable' WHEN 4 THEN 'probable' ELSE 'unknown' END AS status FROM supplier WHERE s_acctbal < 0)"""


def team_games(d: Spark) -> str:
    """Each game from both sides, latest first; needs games."""
    return """team_rows AS (
  SELECT league, season, game_id, kickoff, home AS team, away AS opponent, 1 AS is_home, hs AS gf, aws AS ga FROM games
  UNION ALL SELECT league, season, game_id, kickoff, away, home, 0, aws, hs FROM games),
team_games AS (
  SELECT *, CASE WHEN gf > ga THEN 1e0 WHEN gf = ga THEN 0.5e0 ELSE 0e0 END AS result,
    row_number() OVER (PARTITION BY league, team ORDER BY kickoff DESC, game_id DESC) - 1 AS ago
  FROM team_rows)"""


def book(d: Spark) -> str:
    """Order book of each supplier: levels from lineitem, side by line status, prices spread around 100; one level a side is a wall."""
    return """book AS (
  SELECT l_suppkey AS book_id, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
    CASE WHEN l_linestatus = 'O' THEN 100e0 - (l_partkey % 60 + 1) * 0.05e0 ELSE 100e0 + (l_partkey % 60 + 1) * 0.05e0 END AS price,
    sum(l_quantity * CASE WHEN l_partkey % 60 = l_suppkey % 60 THEN 12e0 ELSE 1e0 END) AS qty
  FROM lineitem GROUP BY 1, 2, 3)"""


def market_books(d: Spark) -> str:
    """Books of binary markets, a supplier each: prices are probabilities around one half."""
    return """market_books AS (
  SELECT l_suppkey AS book_id, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
    CASE WHEN l_linestatus = 'O' THEN 0.5e0 - (l_partkey % 60 + 1) * 0.0025e0 ELSE 0.5e0 + (l_partkey % 60 + 1) * 0.0025e0 END AS price, sum(l_quantity) AS qty
  FROM lineitem GROUP BY 1, 2, 3)"""


def asset_books(d: Spark) -> str:
    """Each asset's book: those of every so many suppliers, level by level."""
    return f"""{book(d)},
assets AS (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT event_type AS asset FROM events) AS e),
asset_books AS (SELECT a.asset, b.side, b.price, sum(b.qty) AS qty FROM book b JOIN assets a ON b.book_id % a.n = a.k GROUP BY a.asset, b.side, b.price)"""


def derivatives(d: Spark) -> str:
    """Funding and open interest of each asset but the last by name, from its events."""
    return """derivatives AS (
  SELECT event_type AS asset, (avg(CASE WHEN user_id % 2 = 0 THEN 1e0 ELSE -1e0 END)) / 1000e0 AS funding_rate, sum(CASE WHEN event_id % 3 = 0 THEN value ELSE 0e0 END) AS open_interest_value, sum(value) AS quote_volume
  FROM events WHERE event_type < (SELECT max(event_type) FROM events) GROUP BY event_type)"""


def quotes(d: Spark) -> str:
    """Binary market quotes: part = market, supplier = venue, probability by an integer hash."""
    return """quotes AS (
  SELECT l_partkey AS market, l_suppkey AS venue, CAST(min((l_partkey * 7919 + l_suppkey * 104729) % 97 + 1) AS DOUBLE) / 99e0 AS p,
    sum(l_extendedprice) AS volume, sum(l_quantity) * 10e0 AS volume24h, sum(l_quantity) * 40e0 AS liquidity,
    CAST(min((l_partkey + l_suppkey) % 9 + 1) AS DOUBLE) / 100e0 AS spread, max(l_shipdate) AS updated
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def predictions(d: Spark) -> str:
    """Three-way predictions of an order's status: raw scores by integer remainders, softmax, what came true; long rows."""
    return """pred_scores AS (
  SELECT o_orderkey AS id, o_custkey AS subject, k.key AS key, k.ord AS ord, o_orderstatus AS actual, o_orderdate AS generated_at,
    CAST((o_orderkey * k.mult + o_custkey) % 17 AS DOUBLE) / 6e0 + CASE WHEN o_orderstatus = k.key AND o_orderkey % 3 > 0 THEN 0.8e0 ELSE 0e0 END AS score,
    CAST(o_orderkey % 89 + 5 AS DOUBLE) / 100e0 AS confidence, o_orderkey % 11 = 0 AS is_demo
  FROM orders CROSS JOIN (VALUES ('F', 0, 31), ('O', 1, 37), ('P', 2, 41)) AS k(key, ord, mult)),
predictions AS (
  SELECT *, exp(score - max(score) OVER (PARTITION BY id)) / sum(exp(score - smax)) OVER (PARTITION BY id) AS p
  FROM (SELECT *, max(score) OVER (PARTITION BY id) AS smax FROM pred_scores) AS x)"""


def model_outputs(d: Spark) -> str:
    """Four models' shares of each prediction, some abstaining; needs pred_scores."""
    return """model_scores AS (
  SELECT s.id, s.key, s.ord, s.actual, m.model, m.weight, (s.id + m.off * 3) % 7 = 0 AS abstained,
    s.score + CAST((s.id * m.off + s.ord * 5) % 11 AS DOUBLE) / 10e0 AS score
  FROM pred_scores s CROSS JOIN (VALUES ('elo', 1, 0.3e0), ('form', 2, 0.2e0), ('market', 3, 0.4e0), ('rates', 4, 0.1e0)) AS m(model, off, weight)),
model_outputs AS (
  SELECT *, exp(score - smax) / sum(exp(score - smax)) OVER (PARTITION BY id, model) AS p
  FROM (SELECT *, max(score) OVER (PARTITION BY id, model) AS smax FROM model_scores) AS x)"""


def rates(d: Spark) -> str:
    """Scoring rates of every pairing that was played, by the sides' goals over the league's mean, shrunk to it: (league, home, away, pair, lh, la)."""
    shrunk = lambda x: f"(avg({x}) / min(mean) * count(*) + 6e0) / (count(*) + 6e0)"
    return f"""{games(d)}, both_sides AS (SELECT league, home AS team, hs AS gf, aws AS ga FROM games UNION ALL SELECT league, away, aws, hs FROM games),
league_mean AS (SELECT league, (avg(hs) + avg(aws)) / 2e0 AS mean FROM games GROUP BY league),
team_rates AS (SELECT s.league, s.team, {shrunk("gf")} AS att, {shrunk("ga")} AS def, min(mean) AS mean FROM both_sides s JOIN league_mean m ON m.league = s.league GROUP BY s.league, s.team),
pairs AS (
  SELECT f.league, f.home, f.away, f.league * 10000 + f.home * 100 + f.away AS pair, least(greatest((h.mean + 0.125e0) * h.att * a.def, 0.05e0), 6e0) AS lh, least(greatest((h.mean - 0.125e0) * a.att * h.def, 0.05e0), 6e0) AS la
  FROM (SELECT DISTINCT league, home, away FROM games) AS f JOIN team_rates h ON h.league = f.league AND h.team = f.home JOIN team_rates a ON a.league = f.league AND a.team = f.away)"""


def matrix(d: Spark, rho: float = -0.11, normalised: bool = True) -> str:
    """Dixon-Coles score matrices of all pairings: rows (pair, lh, la, h, a, p)."""
    tau = f"""CASE WHEN h = 0 AND a = 0 THEN greatest(0e0, 1e0 - lh * la * ({rho}e0)) WHEN h = 0 AND a = 1 THEN greatest(0e0, 1e0 + lh * ({rho}e0))
      WHEN h = 1 AND a = 0 THEN greatest(0e0, 1e0 + la * ({rho}e0)) WHEN h = 1 AND a = 1 THEN greatest(0e0, 1e0 - ({rho}e0)) ELSE 1e0 END"""
    last = "p_raw / sum(p_raw) OVER (PARTITION BY pair)" if normalised else "p_raw"
    return f"""{rates(d)},
goals AS (SELECT {d.series(0, 10)} AS g),
fact AS (SELECT g, CASE g WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 WHEN 2 THEN 2e0 WHEN 3 THEN 6e0 WHEN 4 THEN 24e0 WHEN 5 THEN 120e0 WHEN 6 THEN 720e0 WHEN 7 THEN 5040e0 WHEN 8 THEN 40320e0 WHEN 9 THEN 362880e0 ELSE 3628800e0 END AS f FROM goals),
cells_raw AS (
  SELECT pair, lh, la, hg.g AS h, ag.g AS a, exp(-lh) * power(lh, hg.g) / hg.f * exp(-la) * power(la, ag.g) / ag.f AS base
  FROM pairs CROSS JOIN fact hg CROSS JOIN fact ag),
cells_tau AS (SELECT pair, lh, la, h, a, base * {tau} AS p_raw FROM cells_raw),
cells AS (SELECT pair, lh, la, h, a, {last} AS p FROM cells_tau)"""


def articles(d: Spark) -> str:
    """News articles: a document's first sentence is the title; one a minute, sources by name."""
    first = d.at(d.split("text", "."), 1)
    return f"""articles AS (
  SELECT doc_id AS id, doc_id * 60000 AS published, source, lang, trim({first}) AS title, text AS body
  FROM documents WHERE text IS NOT NULL AND length(trim({first})) > 0)"""


#: What the derived headlines say: who, what, and of what; eight documents in a row report one story.
SUBJECTS = (
    "Bitcoin", "Federal Reserve", "Nvidia", "U.S. Treasury", "the SEC", "Manchester City", "crude oil", "Tesla and Apple", "BTCUSDT", "bitcoin ETF inflows", "USA", "Fed officials",
    "European Union", "chipmakers", "Ethereum", "Premier League", "Senate", "gold prices", "barça", "OpenAI", "quiet corner",
)
VERBS = (
    "surges sharply", "did not crash", "warns of losses", "slightly gains", "isn’t bankrupt", "plunges", "holds talks", "denies any fraud", "beats estimates", "massively outperforms",
    "faces lawsuit", "wins approval", "never halts trading",
)
TAILS = (
    "as Bitcoin miners expand", "after interest rates decision", "amid recession fears", "in Tokyo", "while the Fed and the ECB wait", "on strong growth", "over tariffs", "without panic",
    "as Apple suppliers in China delay plans",
)
CLASSES = ("OFFICIAL", "PRIMARY_SOURCE", "HIGH_RELIABILITY", "ESTABLISHED_MEDIA", "SECONDARY", "SOCIAL", "UNVERIFIED")
NEWS_CATEGORIES = ("markets", "business", "crypto", "world", "tech", "sports", "other")


def headlines(d: Spark) -> str:
    """Every article under a headline of known words and its own first words: (id, published, source, class, category, lead, title, cluster).

    Eight articles in a row carry one lead; a cluster is the articles of one lead within 48 hours, under its least id.
    """
    pick = lambda items, i: d.at(d.array(*(d.lit(x) for x in items)), f"CAST({i} % {len(items)} + 1 AS INT)")
    own = d.regex_one("title", "^([^ ]+ [^ ]+ [^ ]+)")
    return f"""{articles(d)},
told AS (SELECT *, CAST(floor(id / 8e0) AS BIGINT) AS k FROM articles),
led AS (
  SELECT id, published, source, {pick(CLASSES, "ascii(substr(coalesce(source, 'x'), length(coalesce(source, 'x')), 1))")} AS class, {pick(NEWS_CATEGORIES, "k")} AS category,
    concat({pick(SUBJECTS, "k")}, ' ', {pick(VERBS, "CAST(floor(k / 3e0) AS BIGINT)")}, ' ', {pick(TAILS, "CAST(floor(k / 7e0) AS BIGINT)")}) AS lead, {own} AS own
  FROM told),
headlines AS (
  SELECT id, published, source, class, category, lead, concat(lead, CASE WHEN id % 4 = 0 THEN ' ' ELSE ': ' END, own) AS title,
    min(id) OVER (PARTITION BY lead, CAST(floor(published / 172800000e0) AS BIGINT)) AS cluster
  FROM led)"""


#: What the derived market titles ask: of what, in which words, by when; four markets in a row ask one question on four venues.
ASKED = (
    "Bitcoin above $120k", "BTC below $60,000", "Ethereum hit 5k", "the Fed cuts rates", "Lakers win the NBA championship", "Solana above $300", "Inflation CPI exceeds 4", "it rain in Paris",
    "Hurricane landfall in Florida", "new movie tops the box office", "NASA launches a moon mission", "Nvidia earnings beat", "XRP reach $3.50", "Dogecoin under 0.1 or over 1", "the president wins the election", "something else entirely",
)
RULES = (
    "Resolves by CoinDesk price at https://example.com/price", "May be determined by the exchange", "In the sole discretion of the admin, or similar", "Official source: federalreserve.gov", "a consensus of credible reporting",
    "Widely reported major result", "Price from Binance Exchange", "a significant amount", "plain text",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def titles(d: Spark) -> str:
    """Market titles and resolution rules of all parts: (id, title, description); a question in four wordings, a tenth without rules."""
    pick = lambda items, i: d.at(d.array(*(d.lit(x) for x in items)), f"CAST({i} % {len(items)} + 1 AS INT)")
    k = "CAST(floor(p_partkey / 4e0) AS BIGINT)"
    asked, month, rule = pick(ASKED, k), pick(MONTHS, f"CAST(floor({k} / 16e0) AS BIGINT)"), pick(RULES, "p_partkey * 7")
    year = f"CAST(2026 + CAST(floor({k} / 192e0) AS BIGINT) % 3 AS VARCHAR(4))"
    return f"""titles AS (
  SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('Will ', {asked}, ' by ', {month}, ' ', {year}, '? ', p_name) WHEN 1 THEN concat({asked}, ' in ', {month}, ': ', p_name)
      WHEN 2 THEN concat({asked}, ' before the end of ', {month}, ' ', {year}, '? ', p_name) ELSE concat(p_name, ' - ', {asked}, ' by ', {month}, ' 31?') END AS title,
    CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE {rule} END AS description
  FROM part)"""
