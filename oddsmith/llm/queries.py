"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import audio, conversations, decontaminate, divergence, langid, mixing, oracles, packing, pii, sharding, simhash, tokencounts, toxicity, warc
from oddsmith.llm.common import fresh_path, table


#: A deployment passes its own secret; this one makes the registered queries repeatable.
SURROGATE_KEY = b"registered queries: not a secret"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary's place on this machine; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=0)


def op2_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digests(audio.stored(table(spark, sf_dir, "documents")))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.convert_pages(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "record_id", "date")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_texts(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op6_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "slot-map"), n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version",
    )


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), k=3, bits=2)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.toxic_passages(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokencounts.maintained_totals(docs, fresh_path(spark, "token-ledger"), tokenizer_path(), "byte_bpe_50k")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op13_repair_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(conversations.damage(table(spark, sf_dir, "conversations")))


REGISTERED = (
    op1_cutting_stock_packing,
    op2_suffix_array_decontamination,
    op3_audio_features,
    op4_arc_to_warc,
    op5_surrogates,
    op6_language_evidence,
    op7_virtual_slots,
    op8_simhash_ball,
    op9_toxic_segments,
    op10_token_rollups,
    op11_source_divergence,
    op12_entropy_balancing,
    op13_repair_layers,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    """The others cannot be written in DuckDB's SQL (tokenizers, XXH64, suffix arrays, trained models, rounding by hashes): they are tested against brute force."""
    return {"op11_source_divergence": oracles.OP11, "op13_repair_layers": oracles.OP13}
