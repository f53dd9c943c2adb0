"""Delta-maintained token counts by source, language and tokenizer version.

A ledger folder holds, per committed batch, the rows that changed and the signed sums they add to the totals. A batch is
committed by one small file whose name is its number: it is written elsewhere and renamed into place, so there are no
half commits, of two writers that reach for a number one wins, and the other starts again from the new state. Whatever
was written without a commit does not count, and a batch that is committed is never applied again. Totals are the sums
of committed deltas: nothing is recounted. Every COMPACT_EVERY batches the current state and totals are written whole,
so that a batch reads these and a few later changes, however long the history.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from oddsmith.llm.common import broadcast_if_small, small_batches
from oddsmith.llm.tokens import CachedBpe

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
CHANGE = "key string, tokenizer_version string, op string, source string, lang string, n_docs bigint, n_tokens bigint, n_bytes bigint"
STORED = CHANGE + ", bucket int"
DELTA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, n_bytes bigint"
#: Files are sorted by a key's bucket, so that a batch of few keys reads only the row groups that may hold them.
N_BUCKETS = 4096
COMPACT_EVERY = 8


def counted(docs: DataFrame, tokenizer_path: str, version: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Upserts with exact counts, a row of CHANGE per row of docs: null and empty texts have none.

    A row without an id is keyed by its text's digest. Rows of one id are one record of the ledger, which counts each of
    them; an empty table gives no changes; columns other than id, text, source and lang are dropped.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = CachedBpe(tokenizer_path)
        for batch in batches:
            for part in small_batches(batch, 1):
                n = [len(ids) // 4 for ids in bpe.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(part.column(i) for i in (2, 3, 4))], names=["key", "n_tokens", "n_bytes", "source", "lang"])

    rows = _keyed(docs, id_col, text_col).select("key", "text", "n_bytes", "source", "lang")
    made = rows.mapInArrow(each, "key string, n_tokens bigint, n_bytes bigint, source string, lang string")
    return made.select("key", F.lit(version).alias("tokenizer_version"), F.lit("upsert").alias("op"), "source", "lang", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def estimated(docs: DataFrame, version: str, bytes_per_token: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Upserts with provisional counts from the text's length, to be revised by exact ones; rows and keys as in counted."""
    rows = _keyed(docs, id_col, text_col)
    one = F.lit(1).cast("long").alias("n_docs")
    return rows.select("key", F.lit(version).alias("tokenizer_version"), F.lit("upsert").alias("op"), "source", "lang", one, F.ceil(F.col("n_bytes") / bytes_per_token).cast("long").alias("n_tokens"), "n_bytes")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.sha2(text, 256)))
    return docs.select(key.alias("key"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


@dataclass(frozen=True)
class Commit:
    batch: str
    seq: int
    attempt: str
    compacted: bool


class Ledger:
    """Rollups in a folder, which readers see as of their committed batches. Several writers may work at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commits(self) -> list[Commit]:
        """One per batch, in order."""
        try:
            rows = self.spark.read.schema("batch string, seq bigint, attempt string, compacted boolean").parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted((Commit(**r.asDict()) for r in rows), key=lambda c: c.seq)

    def _recent(self, commits: list[Commit]) -> list[Commit]:
        """The last compacted commit, if there is one, and those after it."""
        last = max((i for i, c in enumerate(commits) if c.compacted), default=0)
        return commits[last:]

    def _folder(self, attempt: str, what: str) -> str:
        return f"{self.path}/attempts/{attempt}/{what}"

    def _read(self, commits: list[Commit], whole: str, part: str, schema: str) -> DataFrame:
        """Rows of the compacted form `whole` and of the parts after it, with the number of their batch."""
        out = self.spark.createDataFrame([], schema + ", seq bigint")
        for c in self._recent(commits):
            rows = self.spark.read.schema(schema).parquet(self._folder(c.attempt, whole if c.compacted else part))
            out = out.unionByName(rows.withColumn("seq", F.lit(c.seq)))
        return out

    def _latest(self, past: DataFrame) -> DataFrame:
        """The rows of each key's last batch: a key has as many as it has sources and languages."""
        last = past.groupBy("key", "tokenizer_version").agg(F.max("seq").alias("last"))
        same = (past["key"] == last["key"]) & past["tokenizer_version"].eqNullSafe(last["tokenizer_version"]) & (past["seq"] == last["last"])
        return past.join(last, same, "left_semi")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of CHANGE rows (op upsert or delete) under its id; False, and nothing read, if it is committed already.

        The upserts of one key and tokenizer version in a batch are one record, whose counts are added up and which
        replaces the record before; a key with upserts and deletes is replaced. Deletes of what is not there add
        nothing. Null sources and languages are groups of their own, null counts are zero (of n_docs: one), rows without
        a key are dropped. A writer that dies before its commit leaves nothing that counts, and a retry applies the
        batch. A writer that another one overtakes starts again from what that one committed.
        """
        attempt = uuid.uuid4().hex
        live = F.col("op") != "delete"
        number = lambda c, default: F.sum(F.when(live, F.coalesce(c, F.lit(default)))).alias(c)
        group = [F.when(live, F.col(c)).alias(c) for c in ("source", "lang")]
        new = changes.where("key is not null").groupBy("key", "tokenizer_version", F.when(live, "upsert").otherwise("delete").alias("op"), *group)
        new = new.agg(number("n_docs", 1), number("n_tokens", 0), number("n_bytes", 0))
        written = False
        while True:
            commits = self.commits()
            if any(c.batch == batch for c in commits):
                return False
            if not written:
                bucket = F.pmod(F.xxhash64("key"), F.lit(N_BUCKETS)).cast("int")
                new.withColumn("bucket", bucket).sortWithinPartitions("bucket").write.parquet(self._folder(attempt, "changes"))
                written = True
            if self._commit(batch, attempt, commits):
                return True
            attempt = self._moved(attempt)

    def _moved(self, attempt: str) -> str:
        """A fresh attempt with the changes of an overtaken one."""
        fresh = uuid.uuid4().hex
        self._changes(attempt).write.parquet(self._folder(fresh, "changes"))
        return fresh

    def _changes(self, attempt: str) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self._folder(attempt, "changes"))

    def _commit(self, batch: str, attempt: str, commits: list[Commit]) -> bool:
        now = self._changes(attempt)
        delta = now.where("op = 'upsert'").select(*KEYS, *SUMS)
        seq = 1 + max((c.seq for c in commits), default=0)
        compacts = len(self._recent(commits)) >= COMPACT_EVERY
        if commits:
            buckets = [r[0] for r in now.select("bucket").distinct().collect()]  # N_BUCKETS at most
            past = self._read(commits, "state", "changes", STORED).where(F.col("bucket").isin(buckets))
            keys = broadcast_if_small(now.select(F.col("key").alias("k"), F.col("tokenizer_version").alias("v")).distinct())
            old = self._latest(past.join(keys, (F.col("key") == F.col("k")) & F.col("tokenizer_version").eqNullSafe(F.col("v")), "left_semi"))
            delta = delta.unionByName(old.where("op = 'upsert'").select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS)))
        delta.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).write.parquet(self._folder(attempt, "deltas"))
        if compacts:
            own = self.spark.read.schema(DELTA).parquet(self._folder(attempt, "deltas"))
            totals = self._read(commits, "totals", "deltas", DELTA).drop("seq").unionByName(own)
            totals.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).write.parquet(self._folder(attempt, "totals"))
            state = self._latest(self._read(commits, "state", "changes", STORED).unionByName(now.withColumn("seq", F.lit(seq))))
            state.where("op = 'upsert'").drop("seq").sortWithinPartitions("bucket").write.parquet(self._folder(attempt, "state"))
        row = self.spark.createDataFrame([(batch, seq, attempt, compacts)], "batch string, seq bigint, attempt string, compacted boolean")
        row.coalesce(1).write.parquet(self._folder(attempt, "commit"))
        return self._published(attempt, seq)

    def _published(self, attempt: str, seq: int) -> bool:
        """Renames the attempt's commit file to its number; False if another writer has that number already."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (self._folder(attempt, "commit"), f"{self.path}/commits/{seq:012d}.parquet"))
        fs = folder.getFileSystem(conf)
        fs.mkdirs(target.getParent())
        part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(folder).toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(part), fs.makeQualified(target), none)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e) or fs.exists(target):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """Sums of all committed deltas; groups without documents are left out."""
        rows = self._read(self.commits(), "totals", "deltas", DELTA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs <> 0")


def maintained_totals(docs: DataFrame, path: str, tokenizer_path: str, version: str) -> DataFrame:
    """Totals of docs: estimates are inserted when documents arrive, exact counts revise them, and a repeated batch is ignored.

    Every row counts, also rows that share an id; null and empty texts are documents without tokens; null sources and
    languages are groups of their own; an empty table gives no totals; other columns are dropped.
    """
    ledger = Ledger(docs.sparkSession, path)
    ledger.apply("arrival", estimated(docs, version))
    exact = counted(docs, tokenizer_path, version)
    ledger.apply("exact", exact)
    ledger.apply("exact", exact)  # what a retried job does: it finds the commit and reads nothing
    return ledger.totals()
