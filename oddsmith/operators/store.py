"""The prediction store: idempotent appends on natural keys, histories, and settlement as a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, keys: list[str], latest: str | None = None) -> None:
    """Append the rows whose key is not stored; of equal keys in the batch the latest counts. A repeated call appends nothing."""
    order = [F.col(latest).desc()] if latest else [F.lit(0)]
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    old = existing(rows.sparkSession, path, rows.schema).select(*keys)
    match = F.lit(True)
    left, right = first.alias("new"), old.alias("old")
    for k in keys:
        match = match & F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}"))
    left.join(right, match, "left_anti").write.mode("append").parquet(path)


def latest_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


def throttled(rows: DataFrame, key: str, at: str, gap_ms: int = 1_800_000) -> DataFrame:
    """Per key the rows at least gap_ms after the last one that was let through (not the last one seen)."""

    def each(pdf):
        pdf = pdf.sort_values(at)
        kept, last = [], None
        for t in pdf[at]:
            kept.append(last is None or t - last >= gap_ms)
            last = t if kept[-1] else last
        return pdf[kept]

    return rows.groupBy(key).applyInPandas(each, rows.schema)


def hydrated(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """parents with an array of structs for each kind of child, in the order of the columns named for it.

    Children of all kinds meet in one grouped pass, a row each with the columns of its kind, so a parent is joined once
    however many kinds there are. A parent without children of a kind has an empty array; children without a parent are left out.
    """
    rows = None
    for kind, (frame, order) in children.items():
        columns = [*order, *(c for c in frame.columns if c not in (key, *order))]
        own = frame.select(key, F.struct(*columns).alias(kind))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    grouped = rows.groupBy(key).agg(*(F.sort_array(F.collect_list(kind)).alias(kind) for kind in children))
    empty = [F.coalesce(kind, F.array().cast(grouped.schema[kind].dataType)).alias(kind) for kind in children]
    return parents.join(grouped, key, "left").select(*parents.columns, *empty)
