"""News text: normalisation, tokens, fingerprints, duplicates, entities, sentiment, TF-IDF, importance."""

from __future__ import annotations

from oddsmith.functions import lexicons as L
from oddsmith.functions.dialect import Spark
from oddsmith.plans import relations as R

def tokens(d: Spark, text: str) -> str:
    """Lower-case runs of letters and digits, joined by single dots or hyphens, of two characters and more, without stopwords."""
    stop = ", ".join(f"'{w}'" for w in L.STOPWORDS)
    plain = d.replace_all(f"lower({text})", "['’]", "")
    return d.filter(d.regex_all(plain, "[a-z0-9]+(?:[-.][a-z0-9]+)*"), "w", f"length(w) >= 2 AND w NOT IN ({stop})")


#: Symbols as venues write them: bases, then separators and quotes.
BASES, QUOTES = ("btc", "ETH", "doge", "SOL", "XBT", "xdg", " xrp"), ("-usd", "/USDT", "USDT", "_usdc", "USD", "")
#: Query parameters that tell of a click and not of a document; named character references of feeds.
TRACKING = "^(utm_|ref$|ref_|fbclid$|gclid$|msclkid$|mc_|cmp$|cmpid$|smid$|ito$|ns_|sref$|mod$|taid$|guccounter$|guce_)"
REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "amp": "&",
}


def plain_text(d: Spark, html: str) -> str:
    """Text without tags, numeric and named references decoded (the ampersand's last, so that nothing is decoded twice), white space collapsed."""
    out = d.replace_all(html, "<[^>]*>", " ")
    for pattern, code in (("(?i)&#x[0-9a-f]+;", d.from_hex("substr(m, 4, length(m) - 4)")), ("&#[0-9]{1,9};", "CAST(substr(m, 3, length(m) - 3) AS BIGINT)")):
        out = d.fold(d.distinct(d.regex_all(out, pattern)), out, "acc", "m", f"replace(acc, m, {d.char(code)})")
    for name, by in REFERENCES.items():
        out = d.replace_all(out, f"(?i)&{name};", by)
    return f"trim({d.replace_all(out, '[ \t\n\r\f\x0b\xa0]+', ' ')})"


def fnv1a(d: Spark, s: str) -> str:
    """32-bit FNV-1a over the characters of ASCII text, as BIGINT."""
    chars = d.filter(f"string_split({s}, '')" if d.name == "duckdb" else f"split({s}, '')", "c", "c <> ''")
    codes = d.map(chars, "c", f"CAST({d.code('c')} AS BIGINT)")
    return d.fold(codes, "CAST(2166136261 AS BIGINT)", "hsh", "cd", f"({d.xor('hsh', 'cd')} * CAST(16777619 AS BIGINT)) & CAST(4294967295 AS BIGINT)")


def weights(d: Spark) -> str:
    """The words of all titles: vec(id, w, x), TF-IDF at unit length, and idf(w, idf)."""
    return f"""{R.articles(d)}, tk AS (SELECT id, published, {tokens(d, "title")} AS tok FROM articles), fl AS (SELECT id, {d.unnest("tok")} AS w FROM tk), tf AS (SELECT id, w, CAST(count(*) AS DOUBLE) AS tf FROM fl GROUP BY id, w),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM articles), idf AS (SELECT w, ln((min(nd.n) + 1e0) / (count(*) + 1e0)) + 1e0 AS idf FROM tf CROSS JOIN nd GROUP BY w),
vec AS (SELECT tf.id, tf.w, tf.tf * idf.idf / sqrt(sum(power(tf.tf * idf.idf, 2)) OVER (PARTITION BY tf.id)) AS x FROM tf JOIN idf ON idf.w = tf.w)"""


def plans(d: Spark) -> dict[str, str]:
    art = R.articles(d)
    host = f"lower({d.regex_one('url', '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)')})"
    path = d.replace_all(d.regex_one("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"), "/$", "")
    query = d.regex_one("url", "^[^?#]*[?]([^#]*)")
    kept = d.sort(d.map(d.filter(d.split(query, "&"), "q", f"q <> '' AND NOT {d.matches(f'lower({d.at(d.split("q", "="), 1)})', TRACKING)}"), "q", "CASE WHEN q LIKE '%=%' THEN q ELSE concat(q, '=') END"))
    canonical = f"CASE WHEN {host} = '' THEN lower(trim(url)) ELSE concat({host}, {path}, CASE WHEN {d.size(kept)} > 0 THEN concat('?', {d.join(kept, '&')}) ELSE '' END) END"
    plain, print_of = plain_text(d, "html"), lambda tok: d.base36(fnv1a(d, d.join(d.sort(d.distinct(tok)), " ")))
    tfidf = weights(d)
    dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))" if d.name == "duckdb" else "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0e0, (s, x) -> s + x)"
    norm = lambda t: dot.replace("b.embedding", f"{t}.embedding").replace("a.embedding", f"{t}.embedding")
    return {
        "text_strip_html": f"SELECT page_id, md5({plain}) AS digest, CAST(length({plain}) AS BIGINT) AS n FROM pages",
        "text_tokenize": f"WITH {art} SELECT id, {d.size(tokens(d, 'title'))} AS n, {d.join(tokens(d, 'title'), ' ')} AS tokens FROM articles",
        "text_canonical_url": f"SELECT page_id, {canonical} AS url FROM pages",
        "text_fnv1a": f"SELECT page_id, {fnv1a(d, canonical)} AS hash, {d.base36(fnv1a(d, canonical))} AS id FROM pages",
        "text_fingerprint": f"WITH {art} SELECT id, {print_of(tokens(d, 'title'))} AS fingerprint FROM articles",
        "text_normalize_article": f"WITH {art} SELECT id, title, CASE WHEN length(body) <= length(title) + 40 THEN NULL ELSE md5(body) END AS summary FROM articles WHERE length(trim(title)) > 0",
        "text_dedupe": f"""WITH {art}, f AS (SELECT id, published, md5(body) AS url_hash, {d.sort(d.distinct(tokens(d, "title")))} AS tk FROM articles), a AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY published DESC, id DESC) AS r1 FROM f),
b AS (SELECT id, published, {d.size("tk")} AS n, {d.join("tk", " ")} AS print FROM a WHERE r1 = 1), c AS (SELECT *, row_number() OVER (PARTITION BY print ORDER BY published DESC, id DESC) AS r2 FROM b)
SELECT id, n FROM c WHERE r2 = 1 OR n < 3""",
        "text_latest_news": f"WITH {art}, u AS (SELECT *, row_number() OVER (PARTITION BY md5(body) ORDER BY published DESC, id DESC) AS r FROM articles) SELECT id, source FROM u WHERE r = 1 ORDER BY published DESC, id DESC LIMIT 40",
        "text_search": f"WITH {art} SELECT id FROM articles WHERE lower(concat(title, ' ', body)) LIKE '%thea%'",
        "text_idf": f"WITH {tfidf} SELECT w, round(idf, 6) AS idf FROM idf",
        "text_tfidf_cosine": f"WITH {tfidf}, asked AS (SELECT id AS q FROM articles WHERE id % 50 = 0), qv AS (SELECT v.id, v.w, v.x FROM vec v JOIN asked ON asked.q = v.id) SELECT a.id AS a, b.id AS b, round(sum(a.x * b.x), 6) AS cosine FROM qv a JOIN vec b ON a.w = b.w AND a.id <> b.id GROUP BY a.id, b.id",
        "embedding_cosine_knn": f"""WITH unit AS (SELECT vec_id, embedding, sqrt({norm("a")}) AS size FROM embeddings AS a), q AS (SELECT vec_id, embedding, size FROM unit WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS q, b.vec_id AS v, {dot} / (a.size * b.size) AS cos FROM q a JOIN unit b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cos, 9) DESC, v) AS rk FROM s) SELECT q, v, CAST(rk AS BIGINT) AS rk, round(cos, 6) AS cosine FROM r WHERE rk <= 5""",
        "json_extract": f"SELECT event_id, {d.json_text('props', 'k')} AS k FROM events",
        "date_parts": f"SELECT o_orderkey, {d.date_text('o_orderdate', 'yyyyMMdd')} AS ymd, {d.date_text('o_orderdate', 'yyyy')} AS y, {d.epoch_ms('o_orderdate')} AS ms, {d.month_start('o_orderdate')} AS month_start FROM orders",
        "date_ages": f"SELECT o_orderkey, round(({d.epoch_ms('l_shipdate')} - {d.epoch_ms('o_orderdate')}) / 86400000e0, 6) AS days, round(({d.epoch_ms('l_shipdate')} - {d.epoch_ms('o_orderdate')}) / 31557600000e0, 6) AS years FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
        "capability_fallback": """WITH s AS (SELECT doc_id % 50 AS k, source, CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 WHEN 'src3' THEN 2 ELSE 3 END AS priority, min(doc_id) AS doc FROM documents GROUP BY 1, 2, 3)
SELECT k, source, doc FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, source) AS r FROM s) AS x WHERE r = 1""",
        "symbol_canonical": f"""WITH s AS (SELECT p_partkey AS id, concat({d.at(d.array(*(d.lit(x) for x in BASES)), f"CAST(p_partkey % {len(BASES)} + 1 AS INT)")}, {d.at(d.array(*(d.lit(x) for x in QUOTES)), f"CAST(floor(p_partkey / 3e0) % {len(QUOTES)} + 1 AS INT)")}) AS s FROM part),
p AS (SELECT id, s, {d.regex_one(d.replace_all("upper(trim(s))", "[-/_: ]", ""), "^(.+?)(USDT|USDC|USD|EUR)?$")} AS base FROM s)
SELECT id, s, concat(CASE base WHEN 'XBT' THEN 'BTC' WHEN 'XDG' THEN 'DOGE' ELSE base END, 'USDT') AS canonical FROM p""",
        "market_stats_24h": f"""WITH {R.bars(d)}, x AS (SELECT *, lag(c, 24) OVER (PARTITION BY asset ORDER BY rn) AS past, sum(v) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS vol24 FROM bars)
SELECT asset, rn, round(CASE WHEN past <= 0e0 THEN 0e0 ELSE (c - past) / nullif(past, 0e0) * 100e0 END, 5) AS change_pct, round(vol24 * c, 6) AS quote_volume FROM x WHERE past IS NOT NULL""",
        "candles_tail_limit": f"WITH {R.bars(d)} SELECT asset, open_time, o, h, l, c FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY open_time DESC) AS back FROM bars) AS x WHERE back <= 300",
        "candle_sanity": f"WITH {R.bars(d)} SELECT asset, count(*) AS n, count(CASE WHEN h < greatest(o, c) OR l > least(o, c) OR h < l OR v < 0e0 THEN 1 END) AS broken FROM bars GROUP BY asset",
        "briefing_pulse": f"""WITH {R.bars(d, 86_400_000)}, p AS (SELECT asset, rn, CAST((rn * 37 + length(asset) * 11) % 100 AS DOUBLE) / 100e0 AS p FROM bars), last AS (SELECT asset, max_by(p, rn) AS p FROM p GROUP BY asset)
SELECT count(CASE WHEN p > 0.52e0 THEN 1 END) AS bullish, count(CASE WHEN p < 0.48e0 THEN 1 END) AS bearish, count(CASE WHEN p >= 0.48e0 AND p <= 0.52e0 THEN 1 END) AS neutral, round(avg(p), 6) AS mean_p, min_by(asset, concat(CAST(1000 - CAST(round(abs(p - 0.5e0) * 1000) AS BIGINT) AS VARCHAR(10)), asset)) AS strongest FROM last""",
        "briefing_watch_next": f"""WITH {R.games(d)}, x AS (SELECT game_id, kickoff, CAST(game_id % 50 + 30 AS DOUBLE) / 100e0 AS top_p, CAST(game_id % 20 + 10 AS DOUBLE) / 100e0 AS next_p FROM games)
SELECT game_id, round(top_p - next_p, 6) AS margin FROM x WHERE kickoff > 852076800000 AND kickoff <= 852076800000 + 72 * 3600000 AND round(top_p - next_p, 9) > 0.15e0 ORDER BY round(top_p - next_p, 9) DESC, game_id LIMIT 5""",
        "briefing_risk_flags": """SELECT 'stale' AS flag, count(*) AS n FROM events WHERE event_id % 4000 > 1800 UNION ALL SELECT 'low confidence', count(*) FROM orders WHERE o_orderkey % 89 + 5 < 35 UNION ALL SELECT 'demo', count(*) FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'standing caveat', 1""",
        "briefing_report": f"""WITH {R.headlines(d)}, lines AS (
  SELECT 1 AS ord, 'news' AS section, concat(CAST(count(DISTINCT cluster) AS VARCHAR(20)), ' stories, ', CAST(count(DISTINCT CASE WHEN class = 'OFFICIAL' THEN cluster END) AS VARCHAR(20)), ' official') AS line FROM headlines WHERE class <> 'UNVERIFIED'
  UNION ALL SELECT 2, 'markets', concat(CAST(count(*) AS VARCHAR(20)), ' parts priced') FROM part
  UNION ALL SELECT 3, 'fixtures', concat(CAST(count(*) AS VARCHAR(20)), ' orders in play') FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 4, 'risk', 'probabilities are estimates, not advice')
SELECT CAST(ord AS BIGINT) AS ord, section, line FROM lines""",
        "briefing_hedge_phrases": "SELECT event_id, CASE WHEN c < 0.35e0 THEN 'weak' WHEN c <= 0.6e0 THEN 'moderate' ELSE 'strong' END AS tier, CASE WHEN c >= 0.6e0 THEN 'clearly up' WHEN c >= 0.52e0 THEN 'leaning up' WHEN c > 0.48e0 THEN 'balanced' WHEN c > 0.4e0 THEN 'leaning down' ELSE 'clearly down' END AS phrase FROM (SELECT event_id, CAST(event_id % 100 AS DOUBLE) / 100e0 AS c FROM events) AS x",
        "briefing_what_changed": """WITH a AS (SELECT o_custkey AS k, max(o_orderkey % 100) / 100e0 AS conf, max(o_orderkey % 3) AS dir FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY o_custkey), b AS (SELECT o_custkey AS k, max(o_orderkey % 100) / 100e0 AS conf, max(o_orderkey % 3) AS dir FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY o_custkey)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' WHEN a.dir <> b.dir THEN 'flip' ELSE 'moved' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.dir <> b.dir OR abs(a.conf - b.conf) > 0.1e0""",
        "map_lookup_default": f"""WITH m AS (SELECT {d.map_of("n_nationkey", "n_regionkey")} AS m FROM nation), k AS (SELECT DISTINCT s_nationkey + (s_suppkey % 3) * 20 AS k FROM supplier)
SELECT k.k, coalesce({d.map_get("m.m", "k.k")}, -1) AS region, {d.map_total("m.m")} AS total FROM k CROSS JOIN m""",
        "stream_dedupe_batch": "SELECT event_type, user_id, count(*) AS seen, min(event_id) AS kept FROM events GROUP BY event_type, user_id",
    }
