"""Benchmark decontamination with training suffix arrays.

Each task holds shards of the corpus, a few megabytes of text each. Per shard it sorts a word-level suffix array and
binary-searches every test suffix in it. The range of suffixes that begin with a suffix's window gives the documents to
remove; the neighbours of the place where the whole suffix belongs give its longest verbatim match and where it lies.
No rows are shuffled. Test items travel in blocks of bounded size, one pass over the corpus each, so a task holds one
block; equal windows of all items of a block are one window, so that a passage many items share is searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.llm.common import materialize, small_batches, utf8_list, words_of

WINDOW = 10
#: Text bytes of one block of test items and of one shard of the corpus.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
SPANS = "array<struct<first:bigint,end:bigint>>"
RESULT = f"n_words bigint, spans {SPANS}, item_ids array<string>"


@dataclass
class TestItems:
    """A block of test items: words as small integers with a 0 after each item, and the distinct windows to look for.

    Window i is the size[i] words from at[i]; the items that have it are item[start[i]:start[i + 1]], each once. suffix
    are all places of words, with their item.
    """

    names: list[str]
    vocabulary: dict[bytes, int]
    words: object
    item_start: object
    at: object
    size: object
    start: object
    item: object
    suffix: object
    suffix_item: object

    @classmethod
    def encode(cls, items: list[tuple[str, bytes | None]], window: int) -> TestItems:
        import numpy as np

        vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        starts, names = [], []
        windows: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for name, data in items:
            words = words_of(data)
            if not words:
                continue
            k = min(window, len(words))
            first, number = len(flat), len(names)
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            flat += [*own, 0]
            for i in range(len(own) - k + 1):
                _, having = windows.setdefault(tuple(own[i : i + k]), (first + i, []))
                if not having or having[-1] != number:
                    having.append(number)
            starts.append(first)
            names.append(name)
        text = np.array(flat + [0] * window, np.int64)
        starts = np.array(starts, np.int64)
        suffix = np.flatnonzero(text)
        sizes = [len(x) for _, x in windows.values()]
        return cls(
            names, vocabulary, text, starts, np.array([a for a, _ in windows.values()], np.int64), np.array([len(w) for w in windows], np.int64),
            np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.array([n for _, x in windows.values() for n in x], np.int64),
            suffix, np.searchsorted(starts, suffix, "right") - 1,
        )

    def having(self, windows) -> list[int]:
        """The items, each once, that have one of the windows."""
        import numpy as np

        first, count = self.start[windows], self.start[windows + 1] - self.start[windows]
        place = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        return np.unique(self.item[place]).tolist()


def suffix_array(text, depth: int):
    """Positions of the non-zero words of text, sorted by the suffixes from there to the next 0, to a depth of `depth` words."""
    import numpy as np

    rank, k = text.astype(np.int64), 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        ended = rank == 0
        distinct, rank = np.unique(np.where(ended, 0, rank * (int(rank.max(initial=0)) + 1) + after), return_inverse=True)
        rank = rank + (0 if ended.any() else 1)
        if len(distinct) >= len(rank) - int(ended.sum()) + 1:
            break
        k *= 2
    order = np.argsort(rank, kind="stable")
    return order[np.searchsorted(rank[order], 1) :]


def _compared(text, here, words, at, depth):
    """(sign of the text's suffix against the words, words that agree), to depth[i] words each; a 0 ends both sides."""
    import numpy as np

    order, agreed = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
    tied, j = np.flatnonzero(depth > 0), 0
    while len(tied):
        a, b = text[np.minimum(here[tied] + j, len(text) - 1)], words[np.minimum(at[tied] + j, len(words) - 1)]
        order[tied] = np.sign(a - b)
        same = (a == b) & (a > 0)
        agreed[tied[same]] += 1
        j += 1
        tied = tied[same]
        tied = tied[depth[tied] > j]
    return order, agreed


def _first_place(text, suffixes, words, at, depth, upper: bool):
    """By binary search of all test suffixes at once, the first place of the suffix array not below (upper: above) each."""
    import numpy as np

    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(suffixes), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        order, _ = _compared(text, suffixes[mid], words, at[open_], depth[open_])
        right = (order <= 0) if upper else (order < 0)
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


def _known_runs(words, least: int):
    """(text, place): the runs of known words (> 0) of at least `least` words, a 0 after each, and where each word was."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate([[0], (words > 0).astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    long = last - first >= least
    first, size = first[long], (last - first)[long]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    place = np.repeat(first - shift, size + 1) + np.arange(int((size + 1).sum()))
    text = words[np.minimum(place, len(words) - 1)].copy()
    text[shift + size] = 0
    return text, place


@dataclass
class Shard:
    """The words of some texts one after another, a 0 after each, by the vocabulary of a block of test items."""

    words: object
    starts: object
    sizes: object

    @classmethod
    def of(cls, texts: list[list[bytes]], items: TestItems) -> Shard:
        import numpy as np

        sizes = np.array([len(w) for w in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        ids = np.zeros(int((sizes + 1).sum()), np.int64)
        for start, own in zip(starts, texts, strict=True):
            ids[start : start + len(own)] = np.fromiter(map(items.vocabulary.get, own, repeat(0)), np.int64, len(own))
        return cls(ids, starts, sizes)


def occurrences(words, items: TestItems):
    """(position in words, window) of every occurrence of a distinct window in an array of word ids.

    A position has at most one window of each size, so there are no more than WINDOW times the words.
    """
    import numpy as np

    none = np.zeros(0, np.int64)
    # runs of known words that are shorter than the shortest window cannot hold one: their suffixes need no place
    text, place = _known_runs(words, int(items.size.min())) if len(items.at) else (none, none)
    if not len(text):
        return none, none
    suffixes = suffix_array(text, int(items.size.max()))
    low, high = (_first_place(text, suffixes, items.words, items.at, items.size, upper) for upper in (False, True))
    count = high - low
    window = np.repeat(np.arange(len(items.at)), count)
    rank = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return place[suffixes[rank]], window


def search(texts: list[bytes | None], items: TestItems) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text of one shard: its words, the spans of words that windows cover, the names of the items with occurring windows."""
    import numpy as np

    words = [words_of(x) for x in texts]
    shard = Shard.of(words, items)
    place, window = occurrences(shard.words, items)
    hit = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(hit, place, 1)
    np.add.at(hit, place + items.size[window], -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8)])))
    first, end = edge[::2], edge[1::2]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[list[str]] = [[] for _ in texts]
    for d, a, b in zip((np.searchsorted(shard.starts, first, "right") - 1).tolist(), first.tolist(), end.tolist(), strict=True):
        spans[d].append((a - int(shard.starts[d]), b - int(shard.starts[d])))
    # a document's windows, each once, then the items that have them: equal sets of windows are looked up once
    pairs = np.unique(np.stack([np.searchsorted(shard.starts, place, "right") - 1, window]), axis=1)
    known: dict[bytes, list[str]] = {}
    for d in np.unique(pairs[0]).tolist():
        own = pairs[1][np.searchsorted(pairs[0], d) : np.searchsorted(pairs[0], d, "right")]
        if (found := known.get(own.tobytes())) is None:
            found = known[own.tobytes()] = sorted(items.names[i] for i in items.having(own))
        names[d] = found
    return [(len(w), s, n) for w, s, n in zip(words, spans, names, strict=True)]


def longest_in_shard(texts: list[bytes | None], items: TestItems, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, its word, text, its word, words) of the longest verbatim match of test suffixes of at least a window.

    A suffix whose match is only the rest of the match of the suffix one word before is left out.
    """
    import numpy as np

    shard = Shard.of([words_of(x) for x in texts], items)
    lengths = np.diff(np.append(items.item_start, len(items.words) - window))[items.suffix_item] - 1 if len(items.suffix) else np.zeros(0, np.int64)
    text, place = _known_runs(shard.words, int(min(window, lengths.min()))) if len(items.suffix) else (np.zeros(0), None)
    if not len(text):
        return
    suffixes = suffix_array(text, int(lengths.max()))
    depth = items.item_start[items.suffix_item] + lengths - items.suffix
    belongs = _first_place(text, suffixes, items.words, items.suffix, depth, False)
    best, where = np.zeros(len(depth), np.int64), np.zeros(len(depth), np.int64)
    for neighbour in (belongs, belongs - 1):
        there = suffixes[np.clip(neighbour, 0, len(suffixes) - 1)]
        _, agreed = _compared(text, there, items.words, items.suffix, depth)
        agreed[(neighbour < 0) | (neighbour >= len(suffixes))] = 0
        better = agreed > best
        best[better], where[better] = agreed[better], there[better]
    follows = np.zeros(len(best), bool)
    follows[1:] = (items.suffix_item[1:] == items.suffix_item[:-1]) & (best[1:] == best[:-1] - 1)
    for i in np.flatnonzero((best >= np.minimum(window, lengths)) & ~follows).tolist():
        at = int(place[where[i]])
        d = int(np.searchsorted(shard.starts, at, "right")) - 1
        yield int(items.suffix_item[i]), int(items.suffix[i] - items.item_start[items.suffix_item[i]]), d, at - int(shard.starts[d]), int(best[i])


def encoded_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Broadcast]:
    """The test items as broadcast blocks of at most BLOCK_BYTES of text (a longer item alone); the driver holds one block at a time.

    Every row is an item; a null id is named "" and a null text has no words.
    """
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.encode(F.col(text_col), "UTF-8").alias("t"))
    block, total, given = [], 0, False
    for row in rows.toLocalIterator():
        size = len(row.t or b"")
        if block and total + size > BLOCK_BYTES:
            yield sc.broadcast(TestItems.encode(block, window))
            block, total, given = [], 0, True
        block.append((row.i, None if row.t is None else bytes(row.t)))
        total += size
    if block or not given:
        yield sc.broadcast(TestItems.encode(block, window))


def _searched(rows: DataFrame, items: Broadcast) -> DataFrame:
    """rows(doc_id, text) to (doc_id, n_words, spans, item_ids) by one block of items."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in small_batches(batch, 1, SHARD_BYTES):
                found = search(utf8_list(part.column(1)), items.value)
                spans = [[{"first": a, "end": b} for a, b in s] for _, s, _ in found]
                arrays = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, span), pa.array([x for *_, x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n_words", "spans", "item_ids"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans) for every row of docs.

    A window is `window` consecutive words of an item, or all words of a shorter item. spans are the stretches of words
    (first, end) that windows cover, n_hit their words; item_ids are the ids, sorted as strings, of the items with an
    occurring window, once for each such row of benchmark. Null, empty and wordless texts give zeros and empty arrays;
    repeated rows stay; matches never cross from one document into the next; an empty benchmark hits nothing. Other
    columns of docs are dropped. A benchmark of several blocks takes a pass over docs for each.
    """
    blocks = encoded_blocks(benchmark, window)
    items, more = next(blocks), next(blocks, None)
    if more is None:
        found = _searched(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items)
    else:
        rows = materialize(docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("doc_id"), F.col(text_col).alias("text")), "rows")
        parts = [materialize(_searched(rows, items), "searched")]
        while more is not None:
            items.destroy()
            items = more
            parts.append(materialize(_searched(rows, items).where(F.size("item_ids") > 0), "searched"))
            more = next(blocks, None)
        both = parts[0]
        for part in parts[1:]:
            both = both.union(part)
        both = both.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
        found = both.select("doc_id.id", "n_words", _merged("spans").alias("spans"), F.array_sort("item_ids").alias("item_ids")).withColumnRenamed("id", "doc_id")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", "spans")


def _merged(spans: str):
    """The union of spans, sorted."""
    joined = lambda a, s: F.when(
        (F.size(a) > 0) & (s["first"] <= F.element_at(a, -1)["end"]),
        F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), joined)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_word, n_words, doc_id, doc_word): the longest verbatim match of each test suffix over all rows of docs.

    Suffixes match by a window at least (shorter items: whole); a suffix whose match is only the rest of the match of the
    suffix one word before is left out within a shard. Of equally long matches the one with the smallest document and word
    counts, null ids last; items with equal ids are one. No items, no documents and wordless texts match nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id string, item_word bigint, n_words bigint, doc_id {kind}, doc_word bigint")
    for items in encoded_blocks(benchmark, window):

        def each(batches: Iterator, items: Broadcast = items) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for part in small_batches(batch, 1, SHARD_BYTES):
                    out = list(longest_in_shard(utf8_list(part.column(1)), items.value, window))
                    if out:
                        item, item_word, doc, doc_word, n = zip(*out, strict=True)
                        arrays = [pa.array([items.value.names[i] for i in item], pa.string()), pa.array(item_word, pa.int64()), pa.array(n, pa.int64()), part.column(0).take(pa.array(doc)), pa.array(doc_word, pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        found = found.union(materialize(rows.mapInArrow(each, found.schema), "matches"))
        items.destroy()
    least = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_word")).alias("m")
    best = found.groupBy("item_id", "item_word").agg(least)
    return best.select("item_id", "item_word", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.doc_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns.

    Null, empty and wordless texts stay; repeated rows stay or go together; an empty benchmark removes nothing. A
    benchmark of several blocks takes a pass for each, over what the one before left and wrote.
    """
    at = docs.columns.index(text_col)
    blocks = encoded_blocks(benchmark, window)
    items = next(blocks)
    while True:

        def each(batches: Iterator, items: Broadcast = items) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for part in small_batches(batch, at, SHARD_BYTES):
                    yield part.filter(pa.array([not spans for _, spans, _ in search(utf8_list(part.column(at)), items.value)]))

        docs, more = docs.mapInArrow(each, T.StructType(docs.schema.fields)), next(blocks, None)
        if more is None:
            return docs
        docs, items = materialize(docs, "clean"), more
