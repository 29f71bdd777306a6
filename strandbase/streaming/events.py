"""Event streams: watermarked windows, as batch queries and as streams that give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import table
from ..registry import query


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start_us, event_type, n, total) of windows that don't overlap."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


def tumbling_stream(spark: SparkSession, path: str, name: str, lateness: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """The same from a folder of Parquet files read as a stream, to its end."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    rows = out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")
    run = rows.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("t1_tumbling_windows", "SELECT epoch_us(ts) // 86400000000 * 86400000000 AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t1(spark, d):
    return tumbling(table(spark, d, "events"))


@query(
    "t2_session_windows",
    "WITH x AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
)
def t2(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")
