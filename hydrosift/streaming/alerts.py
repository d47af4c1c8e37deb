"""Alert stream (S1): readings arriving as files -> index -> alert rows and
outbox messages, a watermarked daily mean per site, and one message per alert
episode of a site.

Sinks are idempotent: every micro-batch overwrites its own ``batch_id=N``
folder, so a replayed batch after a failure does not duplicate rows.  The
daily means run in update mode with a watermark, so state for closed days is
dropped; readers take the latest version of each (site, day).  Episodes are kept
as state per site while they may still grow and are written once, when the
watermark has passed their end; alerts later than that are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosift.functions import wqi as W
from hydrosift.session import ensure_checkpoint_dir
from hydrosift.sources.lookups import GW_ALERT_BODY, GW_ALERT_SUBJECT
from hydrosift.sources.views import event_readings

EVENT_PARAMS = {"ph": "ph", "turbidity": "turbidity", "chloride": "chloride", "nitrate": "nitrate",
                "iron": "iron"}


def alert_rows(readings: DataFrame) -> DataFrame:
    """Index, class and alert flag per reading; message text for alerts."""
    r = readings.withColumn("wqi", W.bis_wqi(EVENT_PARAMS, missing="skip"))
    r = r.withColumn("wqi_class", W.wqi_class_gw("wqi")).withColumn("alert", W.alert_gw("wqi"))
    body = F.format_string(GW_ALERT_BODY.format(site="%s", wqi="%.2f"), F.col("site"), F.col("wqi"))
    return r.withColumns({
        "subject": F.when(F.col("alert"), F.lit(GW_ALERT_SUBJECT)),
        "body": F.when(F.col("alert"), body),
    })


def episode_rows(alerts: DataFrame, gap: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """One message per alert episode: a site's alerts, each within ``gap`` of the
    one before.  Streamed, an episode comes out once, when alerts of any site
    are more than ``gap`` and ``watermark`` beyond its last one; its worst
    reading fills the message."""
    body = F.format_string(GW_ALERT_BODY.format(site="%s", wqi="%.2f"), F.col("site"), F.col("worst"))
    return (alerts.withWatermark("ts", watermark)
            .groupBy(F.session_window("ts", gap).alias("episode"), "site")
            .agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_alerts"), F.max("wqi").alias("worst"))
            .select("site", F.col("episode.start").alias("first_ts"), "last_ts", "n_alerts", "worst",
                    F.lit(GW_ALERT_SUBJECT).alias("subject"), body.alias("body")))


def _sink(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_alert_stream(spark: SparkSession, source: str, out_dir: str | None = None,
                     schema=None, available_now: bool = True, processing_time: str | None = None,
                     watermark: str = "1 day", only: str | None = None, gap: str = "1 day"):
    """Start the streaming queries ("alerts", "daily", "episodes", or ``only`` one of them)
    over a file source; returns (queries, out_dir).

    With ``available_now`` the queries process what is there and stop.
    """
    base = out_dir or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    if schema is None:
        schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).parquet(source)
    scored = alert_rows(event_readings(events))
    alerts = scored.where(F.col("alert")).select("event_id", "ts", "site", "wqi", "wqi_class", "subject", "body")
    daily = (scored.withWatermark("ts", watermark)
             .groupBy(F.window("ts", "1 day"), "site")
             .agg(F.avg("wqi").alias("wqi_mean"), F.count(F.lit(1)).alias("n"),
                  F.count_if(F.col("alert")).alias("n_alerts")))
    queries = []
    for name, df, mode in (("alerts", alerts, "append"), ("daily", daily, "update"),
                           ("episodes", episode_rows(alerts, gap, watermark), "append")):
        if only not in (None, name):
            continue
        w = (df.writeStream.outputMode(mode).foreachBatch(_sink(f"{base}/{name}"))
             .option("checkpointLocation", f"{base}/_checkpoints/{name}"))
        if available_now:
            w = w.trigger(availableNow=True)
        elif processing_time:
            w = w.trigger(processingTime=processing_time)
        queries.append(w.start())
    return queries, base


def read_alerts(spark: SparkSession, base: str) -> DataFrame:
    """Rows of all batches; a stream that wrote no batch has none."""
    schema = ("event_id long, ts timestamp, site string, wqi double, wqi_class string, subject string, body string, batch_id int")
    return spark.read.schema(schema).parquet(f"{base}/alerts").drop("batch_id") \
        if _exists(spark, f"{base}/alerts") else spark.createDataFrame([], schema).drop("batch_id")


def read_episodes(spark: SparkSession, base: str) -> DataFrame:
    """Closed episodes of all batches; a stream that wrote no batch has none."""
    schema = ("site string, first_ts timestamp, last_ts timestamp, n_alerts long, worst double, subject string, body string, batch_id int")
    return spark.read.schema(schema).parquet(f"{base}/episodes").drop("batch_id") \
        if _exists(spark, f"{base}/episodes") else spark.createDataFrame([], schema).drop("batch_id")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_daily(spark: SparkSession, base: str) -> DataFrame:
    """Latest version of every (site, day) across micro-batches."""
    d = spark.read.parquet(f"{base}/daily")
    rec = F.struct("wqi_mean", "n", "n_alerts")
    latest = d.groupBy(F.col("window.start").alias("day_start"), "site").agg(
        F.max_by(rec, F.col("batch_id")).alias("r"))
    return latest.select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "site",
                         F.col("r.wqi_mean").alias("wqi_mean"), F.col("r.n").alias("n"),
                         F.col("r.n_alerts").alias("n_alerts"))
