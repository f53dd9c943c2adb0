"""What the corpus operators share: the shared folder, cut lineage, checked broadcasts, word bytes."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its measured bytes stay under this many.
BROADCAST_BYTES = 64 << 20
#: Of each byte: lower case for A-Z, a space for ASCII other than letters and digits, itself beyond ASCII.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir.setdefault("dir", tempfile.mkdtemp(prefix="oddsmith-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor costs one task, not the job."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frame_bytes(df: DataFrame) -> int:
    """Bytes of all rows of df as measured: octets of strings and binaries, elements of arrays, 8 per other value and 16 per row."""

    def width(c, kind) -> object:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            own = F.octet_length(c).cast("long")
        elif isinstance(kind, T.ArrayType):
            own = F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(0).cast("long"), lambda a, x: a + width(x, kind.elementType))
        elif isinstance(kind, T.StructType):
            own = sum((width(c[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
        else:
            return F.lit(8).cast("long")
        return F.coalesce(own, F.lit(0).cast("long")) + 8

    total = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16).cast("long"))
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured bytes of df, which should be materialised, fit the bound; otherwise leave the join to the planner."""
    return F.broadcast(df) if frame_bytes(df) <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and takes the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text."""
    return data.translate(_PLAIN).split() if data else []


def utf8_list(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(batch, text_index: int, max_bytes: int = 8 << 20, max_rows: int = 2048):
    """Slices of an Arrow batch that hold at most max_bytes of text (a longer single text alone)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and (total + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
