"""Spark session defaults and lineage-cutting helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sized for the local test box; on a cluster these come from the job config.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only tables whose planned size is under 32 MB; larger
    # sides fall back to a shuffled sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(app: str = "hydrosift", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the job config names a shared folder and it is used as is.
    Only when nothing is configured, a folder of the session's warehouse (also
    shared) takes its place; nothing is written to a machine's own folders.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder (survives
    executor loss).  Written as a table: a checkpoint keeps all shuffle partitions,
    so that later jobs, and each pass of a fit, have as many tasks for a few rows."""
    return stage_table(df, "cut")


def stage_table(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: cuts the lineage like a checkpoint, and later scans are
    columnar (pruned, pushed-down, vectorized)."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of a narrow frame that a task of a fit passes over; of one on which a linear model
#: makes a matrix product a pass (128 columns: 64 MB)
FIT_ROWS, LINEAR_FIT_ROWS = 1 << 14, 1 << 16


def for_fits(df: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``df`` written, in as many parts as its rows ask for: fits are hundreds of short
    jobs, whose tasks cost more than a few thousand rows (linear ones: more than
    tens of thousands)."""
    out = stage_table(df, "fit")
    return out.coalesce(max(1, -(-out.count() // rows)))
