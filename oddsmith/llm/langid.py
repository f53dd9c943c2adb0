"""Language identification of pages by Bayesian fusion of evidence.

Text gives a naive Bayes likelihood over hashed byte 4-grams, learnt from all documents with a language. The declared
markup language, the address suffix and the language-like segment of the address each give a likelihood ratio, and the
host gives a prior that is smoothed towards its domain's, which is smoothed towards that of all pages. Those tables come
from grouped sums over all pages; a page's own vote is taken out of its host's and domain's counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import broadcast_if_small, materialize, small_batches, utf8_list

BUCKETS = 1 << 18
#: Languages with a class of their own, those with the most documents; the documents of all others are one class, OTHER.
MAX_LANGUAGES = 256
OTHER = "other"
#: Languages that a task counts, or the driver reads, at a time.
AT_ONCE = 16
#: 4-grams overlap and are not independent: their log-likelihoods count this much.
TEMPER = 0.25
#: Pseudo-counts that hosts get from their domain, domains from all pages, and every likelihood table.
HOST_STRENGTH, DOMAIN_STRENGTH, SMOOTHING = 8.0, 16.0, 0.5
UNKNOWN = "und"


def gram_buckets(data: bytes):
    """Hashed byte 4-grams of the text in lower case, white space and ASCII punctuation made single spaces."""
    import numpy as np

    words = data.lower().translate(_SPACED).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 4 or not words:
        return np.zeros(0, np.int64)
    gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return ((gram * np.uint32(2654435769)) >> np.uint32(14)).astype(np.int64)


_SPACED = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang"):
    """(languages, log-probabilities[language, bucket], log share of each) from all rows with a text and a language.

    Counts are summed per task before the shuffle; their size is languages times BUCKETS, whatever the corpus. Beyond
    MAX_LANGUAGES languages the ones with the fewest documents are counted together as OTHER.
    """
    import numpy as np

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    by_size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    languages = [r["lang"] for r in by_size.take(MAX_LANGUAGES + 1)]
    if len(languages) > MAX_LANGUAGES:
        named = [x for x in languages if x != OTHER][: MAX_LANGUAGES - 1]
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(named), F.col("lang")).otherwise(F.lit(OTHER)))
        languages = [*named, OTHER]
    languages = sorted(languages)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, object] = {}
        n: dict[str, int] = {}

        def flush() -> Iterator:
            for lang, own in sums.items():
                seen = np.flatnonzero(own)
                bucket, value = np.append(seen, -1), np.append(own[seen], n[lang])
                for at in range(0, len(bucket), 1 << 16):
                    b, v = bucket[at : at + (1 << 16)], value[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b.astype(np.int64)), pa.array(v.astype(np.int64))], names=["lang", "bucket", "n"])
            sums.clear()
            n.clear()

        for batch in batches:
            for part in small_batches(batch, 0):
                by: dict[str, list[bytes]] = {}
                for data, lang in zip(utf8_list(part.column(0)), part.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(data)
                for lang, own in by.items():
                    if lang not in sums and len(sums) >= AT_ONCE:
                        yield from flush()
                    n[lang] = n.get(lang, 0) + len(own)
                    sums[lang] = sums.get(lang, 0) + np.bincount(np.concatenate([gram_buckets(x) for x in own]), minlength=BUCKETS)
        yield from flush()

    counted = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    log_p, share = np.empty((len(languages), BUCKETS), np.float32), np.ones(len(languages))
    for at in range(0, len(languages), AT_ONCE):
        own = languages[at : at + AT_ONCE]
        found = counted.where(F.col("lang").isin(own)).toArrow()  # AT_ONCE * (BUCKETS + 1) rows at most
        place = {lang: i for i, lang in enumerate(own)}
        row = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
        counts, gram = np.full((len(own), BUCKETS), SMOOTHING), bucket >= 0
        counts[row[gram], bucket[gram]] += n[gram]
        share[at + row[~gram]] += n[~gram]
        log_p[at : at + len(own)] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return languages, log_p, np.log(share / share.sum()) if languages else np.zeros(0)


_OPEN = re.compile(rb"<(?:!--|(script|style|noscript)\b|(html|meta)\b)?", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([a-z]{2,3})\b", re.I)
_CONTENT = re.compile(rb"\bcontent\s*=\s*[\"']?([a-z]{2,3})\b", re.I)


def text_and_declared(data: bytes) -> tuple[bytes, str]:
    """(text without markup, declared language or "") of a page in one pass that never goes back.

    Comments, scripts and styles go with what they enclose; one without an end, and a tag without an end, are text. The
    language is that of the first html tag or content-language meta tag that has one.
    """
    low, out, at, declared = data.lower(), [], 0, ""
    missing: set[bytes] = set()

    def after(mark: bytes, start: int) -> int:
        if mark in missing:
            return -1
        found = low.find(mark, start)
        if found < 0:
            missing.add(mark)  # nor is there one further on
            return -1
        return found + len(mark)

    while m := _OPEN.search(low, at):
        start, end = m.start(), -1
        if m.group().startswith(b"<!--"):
            end = after(b"-->", m.end())
        elif m.group(1):
            closing = after(b"</" + m.group(1), m.end())
            end = max(after(b">", closing), closing) if closing >= 0 else -1
        if end < 0:
            end = after(b">", m.end())
            if end >= 0 and m.group(2) and not declared:
                tag = low[start:end]
                said = _LANG.search(tag) if m.group(2) == b"html" else b"content-language" in tag and _CONTENT.search(tag)
                declared = said.group(1).decode() if said else ""
        out.append(data[at:start])
        if end < 0:
            out.append(b" ")
            at = m.end()
        else:
            out.append(b" ")
            at = end
    return b"".join([*out, data[at:]]), declared


#: Labels that, before a country's suffix, make no domain of their own.
_REGISTRIES = ("ac", "co", "com", "edu", "gov", "gob", "go", "ne", "net", "or", "org")


def domain_of(host: str) -> tuple[str, str]:
    """(domain, suffix) of a host: its last two labels, or three below a country's registry; an address or a bare name has no suffix."""
    labels = host.split(".")
    if len(labels) < 2 or ":" in host or labels[-1].isdigit():
        return host, ""
    n = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _REGISTRIES else 2
    return ".".join(labels[-n:]), labels[-1]


def text_evidence(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, domain, suffix, segment, declared, n_grams, text array<double>): tempered log-likelihoods, less the largest.

    Markup is removed before; texts without letters have equal likelihoods. Null html or url gives empty evidence of
    that kind; repeated rows stay; an empty table gives an empty result; other columns are dropped.
    """
    languages, log_p, _ = model
    held = pages.sparkSession.sparkContext.broadcast((languages, log_p))
    code = "|".join(re.escape(x.lower()) for x in languages if x) or "(?!)"
    address = re.compile(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::\d*)?([^?#]*)", re.I)
    segment_of = re.compile(rf"/({code})(?:[-_][a-z]+)?(?=/|$)", re.I)

    def each(batches: Iterator) -> Iterator:
        import html as markup

        import numpy as np
        import pyarrow as pa

        names, log_p = held.value
        log_p = np.ascontiguousarray(log_p.T)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()))
        for batch in batches:
            for part in small_batches(batch, 2):
                out = []
                for url, data in zip(part.column(1).to_pylist(), utf8_list(part.column(2)), strict=True):
                    data = data or b""
                    m = address.match(url or "")
                    host = m.group(1).lower().rstrip(".") if m else ""
                    domain, suffix = domain_of(host)
                    segment = segment_of.search(m.group(2)) if m else None
                    text, declared = text_and_declared(data)
                    if b"&" in text:
                        text = markup.unescape(text.decode("utf-8", "replace")).encode("utf-8", "replace")
                    grams = gram_buckets(text)
                    scores = np.zeros(len(names))
                    for at in range(0, len(grams), 1 << 16):
                        scores += log_p[grams[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                    scores = TEMPER * (scores - scores.max(initial=-np.inf)) if len(names) else scores
                    out.append((host, domain, suffix, segment.group(1).lower() if segment else "", declared, len(grams), scores.tolist()))
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["page_id", "host", "domain", "suffix", "segment", "declared", "n_grams", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"page_id {kind}, host string, domain string, suffix string, segment string, declared string, n_grams bigint, text array<double>")


def _votes(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Per key the number of pages whose text votes for each language: partial sums, one row per key."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum((F.col("vote") == i).cast("double")) for i in range(n))).alias("votes"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host, domain, suffix, n_grams) for every row.

    Null html or url gives no evidence of that kind; without any evidence the prior of all pages decides, ties go to the
    alphabetically first language. Repeated rows are each a page. Without documents that have a language, lang is "und".
    Other columns are dropped.
    """
    model = fit_text_model(docs)
    languages, _, log_share = model
    evidence = text_evidence(pages, model, id_col, url_col, html_col)
    if not languages:
        return evidence.select("page_id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(UNKNOWN).alias("text_lang"), "declared", "host", "domain", "suffix", "n_grams")
    n = len(languages)
    best = F.array_position("text", F.array_max("text")) - 1
    rows = evidence.withColumn("vote", F.when(F.col("n_grams") > 0, best).otherwise(-1).cast("int"))
    rows = materialize(rows, "evidence")
    total = [1.0 + x for x in (_votes(rows, [], n).first()["votes"] or [0.0] * n)] if rows.take(1) else [math.exp(x) for x in log_share]
    top = [x / sum(total) for x in total]
    hosts = materialize(_votes(rows, ["host", "domain"], n), "hosts")
    domains = materialize(hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("votes")[i]) for i in range(n))).alias("domain_votes")), "domains")
    priors = materialize(hosts.join(domains, "domain").select(F.col("host").alias("h"), "votes", "domain_votes"), "priors")
    joined = rows.join(broadcast_if_small(priors), rows["host"] == F.col("h"))
    own = [(F.col("vote") == i).cast("double") for i in range(n)]
    others = F.when(F.col("vote") >= 0, 1.0).otherwise(0.0)
    size = lambda c: sum((F.col(c)[i] for i in range(n)), F.lit(0.0)) - others
    host_prior = []
    for i in range(n):
        domain = (F.col("domain_votes")[i] - own[i] + DOMAIN_STRENGTH * top[i]) / (size("domain_votes") + DOMAIN_STRENGTH)
        host_prior.append((F.col("votes")[i] - own[i] + HOST_STRENGTH * domain) / (size("votes") + HOST_STRENGTH))
    score = [F.col("text")[i] + F.log(host_prior[i]) for i in range(n)]
    for column in ("declared", "segment", "suffix"):
        known = likelihood_ratios(rows, column, n).select(F.col(column).alias(f"k_{column}"), F.col("ratios").alias(f"r_{column}"))
        joined = joined.join(broadcast_if_small(known), F.col(column) == F.col(f"k_{column}"), "left")
        score = [s + F.coalesce(F.col(f"r_{column}")[i], F.lit(0.0)) for i, s in enumerate(score)]
    joined = joined.withColumn("score", F.array(*score))
    top_score = F.array_max("score")
    weight = F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max("score")))
    named = F.array(*map(F.lit, languages))
    return joined.select(
        "page_id", named[(F.array_position("score", top_score) - 1).cast("int")].alias("lang"), F.round(1 / weight, 6).alias("confidence"),
        F.when(F.col("vote") >= 0, F.get(named, F.col("vote"))).otherwise(UNKNOWN).alias("text_lang"), "declared", "host", "domain", "suffix", "n_grams",
    )


def likelihood_ratios(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(value, ratios): log P(value | language) with smoothing, for each value of the column; votes by text stand for the language.

    There may be any number of values: they stay a table, which is joined by shuffle where it is too large to broadcast.
    """
    found = materialize(_votes(rows.where((F.col(column) != "") & (F.col("vote") >= 0)), [column], n), "values")
    sums = found.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("votes")[i]).alias(f"v{i}") for i in range(n))).first()
    totals = [(sums[f"v{i}"] or 0.0) + SMOOTHING * (sums["n"] + 1) for i in range(n)]
    return found.select(column, F.array(*(F.log((F.col("votes")[i] + SMOOTHING) / total) for i, total in enumerate(totals))).alias("ratios"))
