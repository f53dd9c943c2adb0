"""Sharding over fixed virtual slots: DataFrame functions only on the path of the rows.

Records hash into thousands of slots, bytes are summed per slot, and a versioned slot-to-shard map says where a slot
lives. Rebalancing edits the map: it moves as few slots as it can. The map and the sums have one row per slot, whatever
the corpus, so the driver edits them and joins broadcast them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmith.llm.common import materialize

N_SLOTS = 4096
MAX_SLOTS = 1 << 16
#: Rebalancing stops when the largest shard exceeds the smallest by this share of the mean.
TOLERANCE = 0.001
#: A slot of more than this many mean slots in bytes or rows is hot: its rows are dealt over all slots.
HOT = 8


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] at a version; versions are only ever added."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        if not 0 < n_shards <= n_slots <= MAX_SLOTS:
            raise ValueError("0 < shards <= slots <= MAX_SLOTS")
        return cls(1, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        found = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            found[shard] += slot_bytes[slot]
        return found

    def rebalanced(self, slot_bytes: list[int], tolerance: float = TOLERANCE) -> SlotMap:
        """The next version: slots go one by one from the fullest shard to the emptiest, each the one that levels them best."""
        shard_of, loads = list(self.shard_of), self.loads(slot_bytes)
        own: list[set[int]] = [set() for _ in loads]
        for slot, shard in enumerate(shard_of):
            if slot_bytes[slot]:
                own[shard].add(slot)
        for _ in range(4 * len(shard_of)):
            most, least = max(range(len(loads)), key=loads.__getitem__), min(range(len(loads)), key=loads.__getitem__)
            gap = loads[most] - loads[least]
            if gap <= tolerance * sum(loads) / len(loads):
                break
            slot = min((s for s in own[most] if slot_bytes[s] < gap), key=lambda s: (abs(2 * slot_bytes[s] - gap), s), default=None)
            if slot is None:
                break
            own[most].remove(slot)
            own[least].add(slot)
            loads[most] -= slot_bytes[slot]
            loads[least] += slot_bytes[slot]
            shard_of[slot] = least
        return SlotMap(self.version + 1, self.n_shards, tuple(shard_of))

    def grown(self, slot_bytes: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots from the others; nothing else moves."""
        shard_of, loads = list(self.shard_of), [*self.loads(slot_bytes), 0]
        share = sum(loads) / len(loads)
        for slot in sorted(range(len(shard_of)), key=lambda s: (-slot_bytes[s], s)):
            n, shard = slot_bytes[slot], shard_of[slot]
            if n and loads[-1] + n <= share and loads[shard] - n >= share * 0.999:
                loads[shard] -= n
                loads[-1] += n
                shard_of[slot] = self.n_shards
        return SlotMap(self.version + 1, self.n_shards + 1, tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, n_shards, slot, shard), one row per slot."""
        listed = F.split(F.lit(",".join(map(str, self.shard_of))), ",")
        rows = spark.range(1).select(F.posexplode(listed).alias("slot", "shard"))
        return rows.select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), "slot", F.col("shard").cast("int").alias("shard"))

    def store(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; a version that is there already is an error."""
        self.frame(spark).drop("version").coalesce(1).write.parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or the latest stored version."""
        rows = spark.read.parquet(path)
        version = rows.agg(F.max("version")).first()[0] if version is None else version
        found = rows.where(F.col("version") == version).select("slot", "shard", "n_shards").collect()  # a row per slot
        return cls(version, found[0]["n_shards"], tuple(r["shard"] for r in sorted(found, key=lambda r: r["slot"])))


def slotted(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, spread): size is the UTF-8 bytes of the text (null: none) plus 1.

    The slot hashes the id alone, so a changed text stays where it is; rows without an id hash their text's checksum.
    spread is another slot, which hashes the row's place too; rows of a hot slot go there.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), F.col("text_crc32").cast("string")))
    spread = F.xxhash64(key, "text_crc32", F.monotonically_increasing_id())
    return rows.select("*", F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int").alias("virtual_slot"), F.pmod(spread, F.lit(n_slots)).cast("int").alias("spread"))


def slot_sums(rows: DataFrame) -> DataFrame:
    """(virtual_slot, rows, bytes), partly summed before the shuffle: one row per slot at most."""
    return rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def assign_shards(docs: DataFrame, path: str, n_shards: int = 8, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, map_version, shard, slot) for every row of docs; bytes per shard are near equal.

    Stores the first map and its rebalanced successor under path, then places rows by the stored map. slot is the
    row's place in its shard, gapless from 0: the places of a virtual slot follow those of the ones before it in the
    shard, so rows are numbered within virtual slots and no shard is gathered in one task. A slot that holds over HOT
    mean slots, as when one id repeats in very many rows, is hot: its rows are dealt over all slots. Null texts count one
    byte; repeated rows stay and get places of their own; an empty table gives an empty result; other columns are dropped.
    """
    spark = docs.sparkSession
    rows = materialize(slotted(docs, n_slots, id_col, text_col), "slotted")
    sums = slot_sums(rows).collect()  # n_slots rows at most
    most = {c: HOT * sum(r[c] for r in sums) / n_slots for c in ("rows", "bytes")}
    hot = [r["virtual_slot"] for r in sums if r["rows"] > HOT and any(r[c] > m for c, m in most.items())]
    if hot:
        rows = rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), F.col("spread")).otherwise(F.col("virtual_slot")))
    rows = rows.drop("spread")
    sums = {r["virtual_slot"]: r for r in slot_sums(rows).collect()}  # n_slots rows at most
    slot_bytes = [sums[s]["bytes"] if s in sums else 0 for s in range(n_slots)]
    first = SlotMap.initial(n_shards, n_slots)
    first.store(spark, path)
    first.rebalanced(slot_bytes).store(spark, path)
    placed = SlotMap.load(spark, path)
    ahead, bases = [0] * n_shards, []
    for slot, shard in enumerate(placed.shard_of):
        bases.append(ahead[shard])
        ahead[shard] += sums[slot]["rows"] if slot in sums else 0
    base = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, bases))), ",")).alias("virtual_slot", "base"))
    where = placed.frame(spark).select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))
    lookup = where.join(base, "virtual_slot").select("virtual_slot", "shard", "map_version", F.col("base").cast("long").alias("base"))
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(F.broadcast(lookup), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("base") + F.col("rank") - 1).alias("slot")
    )
