"""Source divergence audit: which sources of a language differ in words, and by which words, in exact integers.

Two passes over the words. The first counts document frequencies exactly and keeps a language's terms of three
documents or more. The second counts every kept term's occurrences with Aho-Corasick automata of delimiter-padded terms.
Documents are read once: a task writes their normalised words in chunks of bounded size together with the chunk's document
frequencies. Summed over chunks these say which terms are kept, and each chunk gets its own kept terms and no others. So
an automaton is no larger than its chunk's words, at any size of the corpus and its vocabulary, and nothing is broadcast
but the totals of groups, if they are small.

Divergences are sums over all kept terms, those that a group lacks included. They are worked out from sparse postings:
all terms count as absent from both sources at first; then each source's own terms are put right by how many of them
have the same share, and last the terms that both have, in one pass over the postings of each term.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.common import broadcast_if_small, materialize, small_batches, utf8_list

#: Fixed values of the contract: documents of a kept term, the unit of shares, added to every count, ranks of terms.
LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: A chunk closes at so many bytes of words or so many distinct terms; its texts are rows of at most PIECE bytes or one document.
CHUNK, CHUNK_TERMS, PIECE = 32 << 20, 1 << 19, 1 << 20
#: A longer term is known by a digest until the result names it; terms hold no digits, so no term is taken for one.
LONG = 256
#: Pair sums that a task holds before it passes them on.
HELD = 1 << 18

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(data: bytes | None) -> list[bytes]:
    """Terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of UTF-8 text, A-Z in lower case."""
    return data.translate(_LETTERS).split() if data else []


def _key(term: bytes) -> bytes:
    return b"0" + hashlib.sha256(term).hexdigest().encode() if len(term) > LONG else term


def _pieces(data: bytes) -> Iterator[bytes]:
    """Normalised text in pieces of about PIECE bytes, cut at spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _squeezed(held: list) -> bytes:
    """A size and words, as compressed text with a space at either end."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b" " + b" ".join(held[1:]) + b" ")


def _unsqueezed(words: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(words)


class _Chunk:
    """Words and document frequencies of one chunk."""

    def __init__(self) -> None:
        self.texts: dict = {}
        self.freq: dict = {}
        self.names: dict = {}
        self.size = 0

    def add(self, lang: str, source: str, data: bytes | None) -> Iterator[tuple]:
        """Takes a document; gives the rows of words that have grown to PIECE bytes."""
        held, seen = self.texts.setdefault((lang, source), [0]), set()
        for piece in _pieces(data.translate(_LETTERS)) if data else ():
            words = piece.split()
            own = set(words)
            if own and max(map(len, own)) > LONG:
                self.names |= {_key(w): w for w in own if len(w) > LONG}
                words = [_key(w) for w in words]
                own = set(words)
            seen |= own
            held.append(b" ".join(words))
            held[0] += len(held[-1])
            self.size += len(held[-1]) + 64
            if held[0] > PIECE:
                yield (lang, source, _squeezed(held), None, None, None)
                held[:] = [0]
        self.freq.setdefault(lang, Counter()).update(seen)

    def full(self, size: int) -> bool:
        return self.size > size or sum(map(len, self.freq.values())) > CHUNK_TERMS

    def rows(self) -> Iterator[tuple]:
        for (lang, source), held in self.texts.items():
            yield (lang, source, _squeezed(held), None, None, None)
        for lang, own in self.freq.items():
            for term, n in own.items():
                yield (lang, None, None, term, self.names.get(term), n)


def chunks(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """(chunk, lang, source, words, term, name, docs): rows of words of one group, and rows of a chunk's document frequencies.

    words is the group's terms between spaces, a space at either end, compressed; name is the term of a digest. Every group
    has a row of words, if only an empty one.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        text = ("term", "name")
        schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("words", pa.binary()), *((c, pa.string()) for c in text), ("docs", pa.int64())])
        task, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def packed(rows: list[tuple]):
            columns = [[task << 32 | number] * len(rows), *zip(*rows, strict=True)]
            arrays = [pa.array(c, pa.binary()).cast(pa.string()) if f.name in text else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for part in small_batches(batch, 2):
                for lang, source, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8_list(part.column(2)), strict=True):
                    for row in chunk.add(lang, source, data):
                        yield packed([row])
                if chunk.full(size):
                    yield from map(packed, _grouped(chunk.rows()))
                    chunk, number = _Chunk(), number + 1
        yield from map(packed, _grouped(chunk.rows()))

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*named).mapInArrow(each, "chunk long, lang string, source string, words binary, term string, name string, docs long")


def _grouped(rows: Iterator[tuple], most: int = 1 << 15, size: int = 4 << 20) -> Iterator[list[tuple]]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[2] or b"") + len(row[4] or b"")
        if len(held) >= most or weight > size:
            yield held
            held, weight = [], 0
    if held:
        yield held


def kept_terms(rows: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(chunk, lang, term): of each chunk's terms those of at least `least` documents of the language, counted exactly over all chunks."""
    found = rows.where("term IS NOT NULL").select("chunk", "lang", "term", "docs")
    return found.withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("all") >= least).select("chunk", "lang", "term")


def occurring_groups(rows: DataFrame) -> DataFrame:
    """(gid, lang, source): every group of a document, with or without terms, by a number."""
    return materialize(rows.where("words IS NOT NULL").select("lang", "source").distinct(), "groups").withColumn("gid", F.monotonically_increasing_id())


def occurrences(rows: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, gid, n, lang_n): occurrences of kept terms per group, n > 0, and in the whole language.

    A chunk's kept terms of a language come first, then its words: the automaton of the terms runs over the words.
    """
    heads = kept.select("chunk", "lang", F.lit(None).cast("long").alias("gid"), F.lit(None).cast("binary").alias("words"), "term")
    bodies = rows.where("words IS NOT NULL").join(broadcast_if_small(groups), ["lang", "source"]).select("chunk", "lang", "gid", "words", F.lit(None).cast("string").alias("term"))
    placed = heads.union(bodies).repartition("chunk", "lang").sortWithinPartitions("chunk", "lang", F.col("gid").asc_nulls_first())

    def each(batches: Iterator) -> Iterator:
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        at, terms, machine, found = None, [], None, []
        schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("gids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])

        def summed():
            if not found:
                return
            ids, counts = (np.concatenate([f[i] for f in found]) for i in (1, 2))
            gids = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            order = np.argsort(ids, kind="stable")
            ids, counts, gids = ids[order], counts[order].astype(np.int32), gids[order]
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            ends = np.append(starts, len(ids)).astype(np.int32)
            names = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(ids[starts]))
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(gids), pa.array(counts))]
            whole = pa.RecordBatch.from_arrays([pa.array([at[1]] * len(starts), pa.string()), names, *lists], schema=schema)
            for i in range(0, len(starts), 1 << 14):
                yield whole.slice(i, 1 << 14)

        for batch in batches:
            for part in small_batches(batch, 3):
                columns = [part.column(i).to_pylist() for i in range(4)]
                for chunk, lang, gid, words, term in zip(*columns, utf8_list(part.column(4)), strict=True):
                    if (chunk, lang) != at:
                        yield from summed()
                        at, terms, machine, found = (chunk, lang), [], None, []
                    if term is not None:
                        terms.append(term)
                    elif terms:
                        if machine is None:
                            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                            for i, t in enumerate(terms):
                                machine.add_word(f" {t.decode('latin-1')} ", i)  # bytes as characters
                            machine.make_automaton()
                        text = _unsqueezed(words).decode("latin-1")
                        ids, counts = np.unique(np.fromiter(map(itemgetter(1), machine.iter(text)), np.int64), return_counts=True)
                        if len(ids):
                            found.append((gid, ids, counts))
        yield from summed()

    packed = placed.mapInArrow(each, "lang string, term string, gids array<bigint>, counts array<int>")
    flat = packed.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("gids", "counts")).alias("x"))
    sums = flat.groupBy("lang", "term", F.col("x.gids").alias("gid")).agg(F.sum("x.counts").alias("n"))
    return sums.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term")))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (n + 1) / (total + terms)), exact for any long counts."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(18,0)) * ({n} + 1) div ({total} + {terms})")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def group_totals(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(gid, lang, source, total, lang_total, terms, absent): a row per occurring group; absent is the share of a term that it lacks.

    terms is the number of the language's kept terms. Each of them occurs in a group.
    """
    sums = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    terms = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    both = groups.join(sums, "gid", "left").join(terms, "lang", "left")
    both = both.withColumns({"total": F.coalesce("total", F.lit(0)), "terms": F.coalesce("terms", F.lit(0))})
    found = materialize(both, "group-sums")
    found = found.join(found.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang")
    found = found.withColumn("absent", F.when(F.col("terms") > 0, _share("0", "total", "terms")))
    return materialize(found, "totals")


def scored(rows: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(gid, lang, term, item, p, q, absent): the postings with their group's and their language's share of the term."""
    named = materialize(rows.where("name IS NOT NULL").groupBy("lang", "term").agg(F.max("name").alias("name")), "named")
    rows = counts.join(broadcast_if_small(totals.drop("lang", "source")), "gid").join(broadcast_if_small(named), ["lang", "term"], "left")
    return rows.select(
        "gid", "lang", "term", F.coalesce("name", "term").alias("item"), _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"), "absent"
    )


def _common(batches: Iterator) -> Iterator:
    """Of postings in order of (lang, term): what the terms that two groups share change in their divergence, either way."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([("gid", pa.int64()), ("other", pa.int64()), ("value", pa.int64())])
    total: dict[tuple[int, int], int] = {}

    def packed():
        keys = list(total)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(total.values(), pa.int64())], schema=schema)

    def gap(p, q):
        return (p - q) * (p - q) // q

    def add(rows) -> None:
        key, gid, p, absent = rows
        names, gid = np.unique(gid, return_inverse=True)
        at = np.arange(len(key))
        for shift in range(1, len(key)):
            at = at[at + shift < len(key)]
            at = at[key[at] == key[at + shift]]
            if not len(at):
                return
            a, b = at, at + shift
            for g, s in ((a, b), (b, a)):
                change = gap(p[g], p[s]) - gap(p[g], absent[s]) - gap(absent[g], p[s]) + gap(absent[g], absent[s])
                pair, place = np.unique(gid[g] * len(names) + gid[s], return_inverse=True)
                sums = np.zeros(len(pair), np.int64)
                np.add.at(sums, place, change)
                for k, v in zip(pair.tolist(), sums.tolist(), strict=True):
                    ends = int(names[k // len(names)]), int(names[k % len(names)])
                    total[ends] = total.get(ends, 0) + v

    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
        if not table.num_rows:
            continue
        lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
        new = np.zeros(table.num_rows, np.int64)
        if table.num_rows > 1:
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1]))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
        key = np.cumsum(new)
        last = int(np.searchsorted(key, key[-1]))
        columns = [table.column(c).to_numpy() for c in ("gid", "p", "absent")]
        add([key[:last], *(c[:last] for c in columns)])
        left = table.slice(last).combine_chunks().to_batches()[0]
        if len(total) > HELD:
            yield packed()
            total.clear()
    if left is not None:
        add([np.zeros(left.num_rows, np.int64), *(left.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "p", "absent"))])
    if total:
        yield packed()


def pair_values(posts: DataFrame, totals: DataFrame) -> DataFrame:
    """(gid, other, value) for every two groups of a language, in either order; value is exact."""
    ends = totals.select("lang", "terms", F.col("gid").alias("g"), F.col("absent").alias("a"))
    others = totals.select("lang", F.col("gid").alias("s"), F.col("absent").alias("b"))
    base = ends.join(broadcast_if_small(others), "lang").where("g <> s")
    base = base.selectExpr("g AS gid", "s AS other", f"CASE WHEN terms = 0 THEN 0 ELSE terms * {_gap('a', 'b')} END AS value")
    alike = posts.groupBy("lang", F.col("gid").alias("g"), F.col("absent").alias("a"), "p").agg(F.count(F.lit(1)).alias("m"))
    own = alike.join(broadcast_if_small(others), "lang").where("g <> s").groupBy("g", "s")
    own = materialize(own.agg(F.expr(f"sum(m * ({_gap('p', 'b')} - {_gap('a', 'b')}))").alias("to"), F.expr(f"sum(m * ({_gap('b', 'p')} - {_gap('b', 'a')}))").alias("fro")), "own-terms")
    placed = posts.select("lang", "term", "gid", "p", "absent").repartition("lang", "term").sortWithinPartitions("lang", "term")
    common = placed.mapInArrow(_common, "gid long, other long, value long")
    parts = base.union(own.selectExpr("g", "s", "to")).union(own.selectExpr("s", "g", "fro")).union(common)
    return parts.groupBy("gid", "other").agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, size: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group of a language and source, all other sources and its own terms.

    Part pair: every other source of the language, and the sum over all kept terms of floor((p - q)^2 / q), p and q being
    the shares of the two; part term: kept terms that the group uses more than its language does, ranks to `top`. Ranks go
    by value, then by item. Null text, language and source are empty strings; groups without terms, and languages without kept
    terms, have pairs (of value 0 for the latter). Repeated rows are documents each; texts count whole, of any length; an empty
    table gives none; other columns are dropped. Values are exact as long as they are longs. size is a chunk's bytes.
    """
    rows = materialize(chunks(docs, size=size), "chunks")
    groups = materialize(occurring_groups(rows), "numbered-groups")
    counts = materialize(occurrences(rows, kept_terms(rows, least), groups), "occurrences")
    totals = group_totals(groups, counts)
    posts = materialize(scored(rows, counts, totals), "postings")
    about = totals.select("gid", "lang", "source")
    pairs = pair_values(posts, totals).join(broadcast_if_small(about), "gid")
    pairs = pairs.join(broadcast_if_small(about.select(F.col("gid").alias("other"), F.col("source").alias("item"))), "other")
    in_order = Window.partitionBy("gid").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(in_order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    more = posts.where("p > q").selectExpr("gid", "item", f"{_gap('p', 'q')} AS value").withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top)
    return pairs.union(more.join(broadcast_if_small(about), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
