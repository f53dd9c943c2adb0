"""Sequence packing by cutting stock: column generation over the histogram of piece lengths.

Documents are cut at multiples of the capacity; what remains of them is a piece of 1 to 1023 tokens. A linear program
over patterns of piece lengths is solved on the driver - it sees one row per length, whatever the corpus - and its
rounded patterns are dealt to the pieces, which are ranked within their length.
"""

from __future__ import annotations

import logging
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.common import broadcast_if_small, crc, materialize, small_batches
from oddsmith.llm.tokens import CachedBpe

CAPACITY = 1024
#: Ranks are taken within (length, bucket); a length has as many buckets as keep about this many pieces in each, and up to SPREAD in any case.
BUCKET_PIECES = 250_000
SPREAD = 64
_HASHES = 1 << 20
#: The linear program ends when it is this close to its bound.
GAP = 0.0005
#: Pricing ends after so many rounds at the latest; cutting_stock then warns of the gap it reached.
ROUNDS = 60


def price(lengths, duals, capacity: int):
    """Knapsack by dynamic programming: the best value for each capacity and the item that was put in last."""
    import numpy as np

    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, room, "right"))
        best[room] = best[room - 1]
        if k:
            values = best[room - lengths[:k]] + duals[:k]
            i = int(values.argmax())
            if values[i] > best[room] + 1e-12:
                best[room], last[room] = values[i], i
    return best, last


def _pattern(last, lengths, room: int) -> Counter:
    found: Counter = Counter()
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            found[int(last[room])] += 1
            room -= int(lengths[last[room]])
    return found


def _first_basis(lengths: list[int], demand: list[float], capacity: int) -> tuple[list[Counter], list[float]]:
    """First fit decreasing as a basic solution: each pattern is used until it exhausts one length, whose column it becomes."""
    left, open_ = list(demand), list(range(len(lengths)))
    basis: list[Counter] = [Counter() for _ in lengths]
    x = [0.0] * len(lengths)
    while open_:
        pattern, room, at = Counter(), capacity, len(open_) - 1
        while at >= 0:
            i = open_[at]
            copies = min(room // lengths[i], max(1, int(left[i])))
            if copies:
                pattern[i] = copies
                room -= copies * lengths[i]
            at = min(at, bisect_right(open_, room, key=lengths.__getitem__)) - 1
        ended = min(pattern, key=lambda i: left[i] / pattern[i])
        times = left[ended] / pattern[ended]
        for i, n in pattern.items():
            left[i] -= n * times
        open_.remove(ended)
        basis[ended], x[ended] = pattern, times
    return basis, x


def cutting_stock(demand: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> tuple[list[tuple[Counter, float]], float]:
    """Patterns (a count by length) with fractional multiplicities that meet the demand, and a bound on their number.

    Revised simplex with delayed columns from a first-fit basis: each pricing solves one knapsack and offers the best
    pattern that ends with each length; those that still price out enter one by one. It ends at the gap to the
    greater of Farley's bound and the volume's, or after ROUNDS pricings with a warning that names the gap reached; the patterns meet the demand at any time.
    """
    import numpy as np

    lengths = np.array(sorted(demand), np.int64)
    m = len(lengths)
    if not m:
        return [], 0.0
    basis, start = _first_basis(lengths.tolist(), [float(demand[int(n)]) for n in lengths], capacity)
    a = np.zeros((m, m))
    for j, c in enumerate(basis):
        a[list(c), j] = list(c.values())
    inverse, x = np.linalg.inv(a), np.array(start)
    bound = sum(n * c for n, c in demand.items()) / capacity  # no pattern holds more than the capacity
    for _ in range(ROUNDS):
        duals = inverse.sum(axis=0)
        best, last = price(lengths, np.maximum(duals, 0), capacity)
        bound = max(bound, x.sum() / max(best[capacity], 1.0))
        if best[capacity] <= 1 + 1e-9 or x.sum() - bound <= gap * bound:
            break
        offers = duals + best[capacity - lengths]
        for i in np.argsort(-offers)[: max(8, m // 8)]:
            if offers[i] <= 1 + 1e-9:
                break
            column = _pattern(last, lengths, capacity - int(lengths[i]))
            column[int(i)] += 1
            at, n = np.array(list(column)), np.array(list(column.values()), float)
            gain = duals[at] @ n - 1
            if gain <= 1e-9:
                continue
            direction = inverse[:, at] @ n
            positive = np.flatnonzero(direction > 1e-9)
            if not len(positive):
                continue
            ratios = x[positive] / direction[positive]
            row, step = int(positive[ratios.argmin()]), float(ratios.min())
            x = np.maximum(x - step * direction, 0)
            x[row] = step
            inverse[row] /= direction[row]
            direction[row] = 0
            touched = np.flatnonzero(np.abs(direction) > 1e-12)
            inverse[touched] -= np.outer(direction[touched], inverse[row])
            duals = duals - gain * inverse[row]
            basis[row] = column
    else:
        logging.getLogger(__name__).warning("cutting stock: %d rounds end %.4f above the bound", ROUNDS, x.sum() / max(bound, 1e-9) - 1)
    return [(Counter({int(lengths[i]): n for i, n in c.items()}), float(v)) for c, v in zip(basis, x, strict=True) if v > 1e-9], float(bound)


def whole_patterns(demand: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with whole multiplicities that meet the demand exactly.

    Multiplicities are rounded down, then patterns are added while the rest has all their pieces, largest fraction
    first; what is left, a few pieces per length at most, is packed best fit decreasing.
    """
    left = Counter({n: c for n, c in demand.items() if c})
    plan: Counter = Counter()

    def use(pattern: Counter, times: int) -> None:
        if times > 0:
            plan[tuple(sorted(pattern.elements(), reverse=True))] += times
            left.subtract({n: c * times for n, c in pattern.items()})

    fractional, _ = cutting_stock(dict(left), capacity, gap)
    for pattern, times in fractional:
        use(pattern, min(int(times + 1e-6), *(left[n] // c for n, c in pattern.items())))
    for pattern, times in sorted(fractional, key=lambda p: (-(p[1] % 1), sorted(p[0].items()))):
        use(pattern, min(1, *(left[n] // c for n, c in pattern.items())))
    room: list[int] = []
    bins: dict[int, list[list[int]]] = defaultdict(list)
    for n in sorted((+left).elements(), reverse=True):
        at = bisect_left(room, n)
        free = room.pop(at) if at < len(room) else capacity
        own = bins[free].pop() if bins[free] else []
        own.append(n)
        insort(room, free - n)
        bins[free - n].append(own)
    plan.update(tuple(own) for kept in bins.values() for own in kept)
    return sorted(plan.items(), reverse=True)


def _pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    def each(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa

        bpe, end = CachedBpe(tokenizer_path), struct.pack("<I", end_id)
        for batch in batches:
            for part in small_batches(batch, 1):
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), bpe.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for at in range(0, len(ids), 4 * capacity):
                        piece = ids[at : at + 4 * capacity]
                        out.append((doc, at // 4, len(piece) // 4, crc(piece), len(ids) // 4, piece if with_ids else None))
                kinds = (part.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 6 if with_ids else 5], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece of a document.

    A document is its ids and end_id after them; null and empty texts are end_id alone. Documents longer than capacity
    are cut at its multiples, each full piece is a sequence of its own; the rest stays whole. Rows with equal ids are
    packed each. Pieces are ranked within their length by a bucket of their hash, then by id, start and checksum; the
    hash covers the row's place in the input too, so that repeated rows do not share a bucket. ids (little-endian
    unsigned 32-bit) are returned on demand. An empty table gives an empty result; other columns are dropped.
    """
    spark = docs.sparkSession
    pieces = _pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(_HASHES))
    pieces = materialize(pieces.withColumn("spread", spread), "pieces")
    demand = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    pieces_of = [demand.get(n, 0) for n in range(capacity + 1)]
    buckets = [min(_HASHES, max(-(-n // BUCKET_PIECES), min(SPREAD, -(-n // SPREAD)))) for n in pieces_of]
    own_buckets = F.split(F.lit(",".join(map(str, buckets))), ",")[F.col("length").cast("int")].cast("long")
    pieces = pieces.withColumn("bucket", F.floor(F.col("spread") * own_buckets / _HASHES).cast("long")).drop("spread")
    # one row per BUCKET_PIECES pieces and SPREAD * capacity rows besides
    counts = materialize(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    spans, used, sequence = [], Counter(), 0
    for pattern, times in whole_patterns(demand, capacity):
        offset = 0
        for n in pattern:
            spans.append((n, used[n], used[n] + times, sequence - used[n], offset))
            used[n] += times
            offset += n
        sequence += times
    plan = spark.createDataFrame(spans, "length bigint, rank_from bigint, rank_to bigint, shift bigint, offset bigint")
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(broadcast_if_small(materialize(base, "bases")), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    dealt = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    columns = ["doc_id", "start", pieces["length"], "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset"]
    return dealt.select(*columns, *["ids"] * with_ids)
