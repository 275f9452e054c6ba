"""Structured Streaming over event and document folders. Windows are an extension; first-seen and change capture mirror batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators.dedup import NEAR, block_keys, greedy_resolution, near_pairs
from sievewright.tables import table, written

LATE = "10 minutes"


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of each type in tumbling or sliding windows; batch or stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


def stream_windows(spark: SparkSession, folder: str, schema: str, length: str = "1 hour") -> DataFrame:
    return windowed(spark.readStream.schema(schema).parquet(folder).withWatermark("ts", LATE), length)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.col("s.start").alias("start"), "events")


def stream_first_seen(docs: DataFrame, text_col: str = "text", time_col: str = "ingested_at", late: str = "1 day") -> DataFrame:
    """First document of each normalized text within the watermark; state is bounded by it."""
    keyed = docs.withColumn("fp", T.fingerprint(T.profile_text(F.col(text_col)))).withWatermark(time_col, late)
    return keyed.dropDuplicatesWithinWatermark(["fp"])


def keep_latest(spark: SparkSession, path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """Writer for foreachBatch: each batch's newest row of a key, one folder a batch, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; rows go to Parquet under path, never to the driver.

    Appended rows gather; in other modes each batch has its own folder, which a
    repeated batch overwrites, and the last folder holds the whole result.
    """
    out = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        out = out.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch_id={n}"))
    out.start().awaitTermination()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def near_duplicate_state(spark: SparkSession, path: str, id_col: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """Writer for foreachBatch over (id, signature): keeps what is near nothing kept before.

    A batch is resolved by itself in id order after what is near an earlier
    survivor has gone; survivors are one folder a batch, so a repeated batch
    gives the same folder again.
    """
    schema = "class_id long, signature long"

    def write(batch: DataFrame, batch_id: int) -> None:
        own = written(batch.where("signature is not null").groupBy("signature").agg(F.min(id_col).alias("class_id")).select("class_id", "signature"), "arrivals")
        kept = spark.read.schema(f"{schema}, batch_id long").parquet(path).where(F.col("batch_id") < batch_id) if _there(spark, path) else spark.createDataFrame([], f"{schema}, batch_id long")
        fresh = own.join(near_to(own, kept), "class_id", "left_anti")
        stays = greedy_resolution(near_pairs(fresh, "class_id"), fresh).where("kept").select("class_id")
        fresh.join(stays, "class_id", "left_semi").select("class_id", "signature").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def near_to(own: DataFrame, kept: DataFrame) -> DataFrame:
    """class_id of the signatures within NEAR bits of a kept one, found by shared blocks."""
    left = own.select("class_id", F.col("signature").alias("s"), F.explode(block_keys(F.col("signature"))).alias("key"))
    right = kept.select(F.col("signature").alias("t"), F.explode(block_keys(F.col("signature"))).alias("key"))
    return left.join(right, "key").where(T.hamming(F.col("s"), F.col("t")) <= NEAR).select("class_id").distinct()


def missing_status_sweep(spark: SparkSession, path: str, status: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """Writer for foreachBatch: statuses of the rows that have none yet; a sweep that runs again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates([key])
        if _there(spark, path):
            rows = rows.join(spark.read.parquet(path).where(F.col("batch_id") != batch_id).select(key), key, "left_anti")
        status(rows).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


def event_change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, errors and distinct users of each day, with a rollup over types."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.rollup("event_type", "day").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


QUERIES = {
    "event_windows": (event_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"),
    "event_sessions": (
        event_sessions,
        """WITH d AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events WHERE ts IS NOT NULL), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM d)
        SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k""",
    ),
    "event_rollup": (event_change_rates, "SELECT event_type, ts::DATE AS day, grouping(event_type, ts::DATE)::INT AS level, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type, ts::DATE)"),
}
