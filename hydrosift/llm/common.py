"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosift.session import ensure_checkpoint_dir

WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage durably (a lost executor costs nothing already written)
    and lets several consumers read one result without recomputing it."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the key's decimal text is 0 modulo ``folds``: the held-out fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == 0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: bound to a lambda
    variable, so the optimizer cannot copy its expression into every use."""
    return F.transform(F.array(value), body)[0]


def in_batches(df: DataFrame, run, schema: str | T.StructType, batch_bytes: int = 4 << 20) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes (not only in rows), so
    that many long texts in a row do not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df.mapInArrow(run, schema)


def without(docs: DataFrame, ids: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (NULL is an id like
    any other), with their own columns.  ``ids`` is broadcast when a bounded
    count shows at most ``max_rows`` rows; otherwise the join shuffles."""
    ids = ids.select(F.col("doc_id").alias("__id")).distinct()
    if ids.limit(max_rows + 1).count() <= max_rows:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_anti")
