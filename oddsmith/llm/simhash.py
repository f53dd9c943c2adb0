"""SimHash classes, found by meet-in-the-middle ball hashing, and near copies by exact Jaccard similarity: of the ball's pairs, of MinHash keys beyond its reach, and of all that is left by prefixes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.llm.common import broadcast_if_small, materialize, small_batches, utf8_list
from oddsmith.llm.components import connected_components

SEED = 42
_CHUNK = 1 << 16
#: Keys of a shingle set and minima in each.
BANDS, BAND_ROWS = 25, 5
#: Counters that order shingles, rare ones first; any order is exact, this one keeps common shingles out of the prefixes.
_COUNTERS, _PIECES = 1 << 20, 16


def simhash64(data: bytes | None, k: int = 3) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles of UTF-8 text, repeats included.

    A-Z is lower-cased, words are runs without ASCII white space. Fewer words than k: the whole sequence is the one
    shingle. No words (null, empty, blank): 0. A bit is set if it is set in over half of the shingles' XXH64.
    """
    import numpy as np
    from xxhash import xxh64_digest

    words = data.lower().split() if data else []
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    k = min(k, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size) + np.arange(len(words))
    starts = ends - size
    total = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        digests = b"".join([xxh64_digest(joined[i:j], SEED) for i, j in spans])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
        total += np.add.reduceat(bits, np.arange(0, to - at, 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit SimHash per row; repeated rows stay, other columns are dropped."""

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, 1):
                fps = np.array([simhash64(x, k) for x in utf8_list(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, fp bigint")


def ball_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Links (u, v), u > v, that connect the distinct fingerprints fp at most `bits` apart.

    Each fingerprint emits every variant within half the radius (65 for two bits: itself and one flip of each bit).
    Two fingerprints within the radius share a variant, and any two that share one are within it, as the radius is even:
    so within a variant each fingerprint is linked to the one before it in order, which connects the same components as
    all pairs. A variant has no more fingerprints than a fingerprint has variants, however large the corpus. Links are
    then deduplicated and their distance verified. Odd radii are refused: their halves would miss or overshoot.
    """
    if bits not in (2, 4):
        raise ValueError("the radius is twice that of the variants, which is 1 or 2 bits: bits is 2 or 4")
    single = [1 << b for b in range(64)]
    masks = [0, *single, *(a | b for a in single for b in single if a < b and bits == 4)]
    signed = F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)), ",").cast("array<bigint>")
    balls = fps.select("fp", F.explode(signed).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    near = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = balls.select(F.col("fp").alias("u"), near.alias("v")).where("v is not null").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest id reachable over links of at most `bits` bits.

    Null and blank texts have fingerprint 0 and link like any other. Rows with equal ids or texts stay, each with its
    class. A null id takes part in linking but is never a component's id unless the component has none. An empty
    table gives an empty result. Exact copies meet as one fingerprint before any pair is formed.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = materialize(connected_components(ball_links(distinct.select("fp"), bits)), "roots")
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("fp", "least")
    label = materialize(distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "label")
    # both sides are plain exchanges, so adaptive execution splits the partition of a fingerprint that many rows share
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(data: bytes | None, k: int = 5):
    """Sorted distinct XXH64 (as int64) of the k-word shingles of UTF-8 text, words as in simhash64; none for no words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.int64)
    found = {xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(max(1, len(words) - k + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def minhash_bands(hashes):
    """BANDS keys (int64): each mixes its number and BAND_ROWS minima of the set under as many multiply-shift hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    draw = np.random.default_rng(SEED)
    factor, shift = draw.integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    factor = factor * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    x = hashes.view(np.uint64)
    for at in range(0, len(x), 1024):
        mixed = x[at : at + 1024, None] * factor + shift
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * factor).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def _with_bands(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """docs and __row (a number of the row), __set (a digest of its shingles), __fp (its SimHash) and __bands, both null without words."""
    at = docs.columns.index(text_col)
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())

    def each(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, at):
                sets, fps, bands = [], [], []
                for data in utf8_list(part.column(at)):
                    hashes = shingle_hashes(data, k)
                    sets.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    fps.append(simhash64(data) if len(hashes) else None)
                    bands.append(minhash_bands(hashes) if len(hashes) else None)
                part = part.append_column("__set", pa.array(sets, pa.binary())).append_column("__fp", pa.array(fps, pa.uint64()).view(pa.int64()))
                yield part.append_column("__bands", pa.array(bands, pa.list_(pa.int64())))

    added = [T.StructField("__set", T.BinaryType()), T.StructField("__fp", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))]
    return numbered.mapInArrow(each, T.StructType([*numbered.schema, *added]))


def _shingle_sets(rows: DataFrame, text_col: str, k: int) -> DataFrame:
    """(row, hashes) of every row."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, 1):
                hashes = [shingle_hashes(x, k) for x in utf8_list(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["row", "hashes"])

    return rows.select("__row", text_col).mapInArrow(each, "row bigint, hashes array<bigint>")


def candidate_pairs(sets: DataFrame) -> DataFrame:
    """(u, v), u > v, of sets(row, bands): in each bucket every row meets the first and the last row in the bucket's own random order.

    That is all pairs of buckets of up to three rows; in a larger one, whose order differs from band to band, a row
    meets up to 2 * BANDS others, so pairs grow with the rows and not with the square of a group. It is a first round:
    what it leaves apart meets in remaining_pairs.
    """
    keyed = sets.select("row", F.explode("bands").alias("key"))
    at = F.struct(F.xxhash64("row", "key"), "row")
    ends = keyed.groupBy("key").agg(F.min(at)["row"].alias("lo"), F.max(at)["row"].alias("hi")).where("lo <> hi")
    met = keyed.join(ends, "key").select("row", F.explode(F.array("lo", "hi")).alias("end")).where("row <> end")
    return met.select(F.greatest("row", "end").alias("u"), F.least("row", "end").alias("v")).distinct()


def ball_pairs(sets: DataFrame, bits: int = 2) -> DataFrame:
    """(u, v), u > v, of sets(row, fp): in a fingerprint rows meet as in candidate_pairs, and the least rows of two fingerprints that ball_links joins meet.

    Rows without a fingerprint meet none. A fingerprint has at most 65 links of its own, so pairs grow with the rows.
    """
    known = sets.where("fp is not null")
    firsts = materialize(known.groupBy("fp").agg(F.min("row").alias("row")), "firsts")
    one, two = (firsts.select(F.col("fp").alias(x), F.col("row").alias(f"row_{x}")) for x in "uv")
    met = ball_links(firsts.select("fp"), bits).join(one, "u").join(two, "v")
    near = met.select(F.greatest("row_u", "row_v").alias("u"), F.least("row_u", "row_v").alias("v"))
    return candidate_pairs(known.select("row", F.array("fp").alias("bands"))).union(near)


def _counts(rows: DataFrame, text_col: str, k: int):
    """How many texts of rows have a shingle of each remainder modulo _COUNTERS: an array of 4 MB at any size, which only orders shingles."""
    import numpy as np

    size = _COUNTERS // _PIECES

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            for part in small_batches(batch, 0):
                found = [shingle_hashes(x, k) for x in utf8_list(part.column(0))]
                counts += np.bincount(np.concatenate(found) & (_COUNTERS - 1), minlength=_COUNTERS)
        if counts.any():
            held = np.minimum(counts, 65535).astype(np.uint16).reshape(_PIECES, size)
            yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([x.tobytes() for x in held], pa.binary())], names=["piece", "counts"])

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[piece] = total.get(piece, 0) + np.frombuffer(counts.as_buffer(), np.uint16).astype(np.int64)
        kept = [np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(kept, pa.binary())], names=["piece", "counts"])

    kind = "piece int, counts binary"
    total = np.zeros((_PIECES, size), np.uint32)
    for r in rows.select(text_col).mapInArrow(each, kind).repartition(_PIECES, "piece").mapInArrow(summed, kind).collect():
        total[r["piece"]] = np.frombuffer(r["counts"], np.uint32)
    return total.ravel()


def _prefixes(rows: DataFrame, text_col: str, k: int, least: float, counts) -> DataFrame:
    """(row, n, at, token): of a row's n shingles, in order of (count, hash), the first n - ceil(least * n) + 1 with their places from 0.

    Two sets that are `least` alike share at least ceil(least * n) shingles of each, so they share one of these.
    """

    def each(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in small_batches(batch, 1):
                sizes, firsts = [], []
                for data in utf8_list(part.column(1)):
                    hashes = shingle_hashes(data, k)
                    n = len(hashes)
                    sizes.append(n)
                    order = np.argsort(counts[hashes & (_COUNTERS - 1)], kind="stable")
                    firsts.append(hashes[order[: n - int(np.ceil(least * n - 1e-9)) + 1]] if n else hashes)
                many = np.array([len(x) for x in firsts], np.int64)
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                own = np.repeat(np.arange(part.num_rows), many)
                columns = [part.column(0).take(pa.array(own)), pa.array(np.array(sizes, np.int32)[own]), pa.array(at.astype(np.int32)), pa.array(np.concatenate(firsts))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "at", "token"])

    return rows.select("__row", text_col).mapInArrow(each, "row bigint, n int, at int, token bigint")


def remaining_pairs(prefixes: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(u, v), u > v: all pairs of prefixes(row, n, at, token) that may be `least` alike and that parts(node, root) does not hold together.

    A prefix filter with the bounds of sizes and places, so every pair that is `least` alike is among them. Pairs of one
    part connect nothing new, so a large group of near copies makes none once it is connected; otherwise pairs grow with
    the square of the rows of a token, which are those that have nothing rarer.
    """
    span = Window.partitionBy("token")
    shared = prefixes.select("*", F.min("row").over(span).alias("lo"), F.max("row").over(span).alias("hi")).where("lo <> hi").drop("lo", "hi")
    shared = materialize(shared, "shared")
    owned = shared.join(broadcast_if_small(parts), shared["row"] == parts["node"], "left").select("row", "n", "at", "token", F.coalesce("root", "row").alias("part"))
    owned = owned.select("*", F.min("part").over(span).alias("lo"), F.max("part").over(span).alias("hi")).where("lo <> hi").drop("lo", "hi")
    one, two = (owned.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "at", "part"))) for x in "uv")
    sizes = F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v") - 1e-9
    places = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v")) >= least / (1 + least) * (F.col("n_u") + F.col("n_v")) - 1e-9
    met = one.join(two, "token").where((F.col("row_u") > F.col("row_v")) & (F.col("part_u") != F.col("part_v")) & sizes & places)
    return met.select(F.col("row_u").alias("u"), F.col("row_v").alias("v")).distinct()


def _alike(pairs: DataFrame, rows: DataFrame, text_col: str, k: int, least: float) -> DataFrame:
    """Those of pairs(u, v) of rows whose shingle sets have a Jaccard similarity of `least` or more, counted exactly."""
    nodes = materialize(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct(), "nodes")
    nodes = broadcast_if_small(nodes)
    sets = materialize(_shingle_sets(rows.join(nodes, rows["__row"] == nodes["row"], "left_semi"), text_col, k), "sets")
    one, two = (sets.select(F.col("row").alias(x), F.col("hashes").alias(f"h{x}"), F.size("hashes").alias(f"n{x}")) for x in "uv")
    sized = pairs.join(one, "u").join(two, "v").where(F.least("nu", "nv") >= least * F.greatest("nu", "nv"))
    both = F.size(F.array_intersect("hu", "hv"))
    return sized.where(both >= least * (F.col("nu") + F.col("nv") - both)).select("u", "v")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each class of docs, with all its columns: a class is connected by pairs whose sets of k-word shingles have a Jaccard similarity of `least` or more.

    A first round takes the pairs of SimHash's ball and, for what lies beyond its two bits, those that share one of BANDS
    MinHash keys; a second one takes all pairs that the first has left apart and that share a shingle of their prefixes,
    which no pair of `least` or more can avoid. The similarity of every candidate is counted exactly, so the classes are
    those of all pairs. Rows of equal shingles are one class before any pair is formed; all null
    and blank texts are one class. The row with the smallest id is kept, one with a null id only if the class has no
    other; among rows with equal ids exactly one is kept. An empty table gives an empty result.
    """
    rows = materialize(_with_bands(docs, text_col, k), "shingled")
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    distinct = rows.groupBy("__set").agg(F.min(F.struct(*(order[c].alias(c) for c in ("no_id", "id", "row")), F.col("__fp").alias("fp"), F.col("__bands").alias("bands"))).alias("first"))
    distinct = materialize(distinct.select("__set", "first.*"), "distinct")
    pairs = materialize(ball_pairs(distinct.select("row", "fp")).union(candidate_pairs(distinct.select("row", "bands"))).distinct(), "pairs")
    parts = materialize(connected_components(_alike(pairs, rows, text_col, k, least)), "parts")
    single = broadcast_if_small(distinct.select("row"))
    single = rows.join(single, rows["__row"] == single["row"], "left_semi")
    left = materialize(remaining_pairs(_prefixes(single, text_col, k, least, _counts(single, text_col, k)), parts, least), "left")
    links = parts.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_alike(left, rows, text_col, k, least))
    roots = materialize(connected_components(links), "roots")
    linked = distinct.join(roots, distinct["row"] == roots["node"]).select("__set", "root", F.struct("no_id", "id", "row").alias("own"))
    kept = linked.groupBy("root").agg(F.min("own")["row"].alias("best"))
    moved = linked.join(kept, "root").select("__set", "best")
    label = materialize(distinct.join(moved, "__set", "left").select("__set", F.coalesce("best", "row").alias("best")), "label")
    gone = materialize(rows.select("__row", "__set").join(label, "__set").where("__row <> best").select(F.col("__row").alias("gone")), "gone")
    gone = broadcast_if_small(gone)
    return rows.join(gone, rows["__row"] == gone["gone"], "left_anti").select(*docs.columns)
