"""Typed tables in text form: CSV and JSON lines, manifests, sinks that are read back, ranged reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros, table
from ..plans.paths import scratch
from ..registry import query


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256, rows) of a JSON list."""
    return spark.read.schema("name string, bytes long, sha256 string, rows long").option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and line-feed ends."""
    df.write.option("header", True).option("lineSep", "\n").csv(path)


def write_receipts(df: DataFrame, path: str, id_column: str = "receipt_id") -> None:
    """JSON lines, each with the SHA-256 of its content as id."""
    df.withColumn(id_column, F.sha2(F.to_json(F.struct(*df.columns)).cast("binary"), 256)).write.json(path)


def ranged(df: DataFrame, content: str, offset: int, limit: int) -> DataFrame:
    """``df`` with piece (text if it is UTF-8, else base64) and its encoding, for up to 65,536 bytes from an offset."""
    if not 0 <= limit <= 65_536:
        raise ValueError("the limit is at most 65536")
    piece = F.substring(F.col(content).cast("binary"), offset + 1, limit)
    text = F.try_validate_utf8(piece.cast("string"))
    return df.withColumn("piece", F.coalesce(text, F.base64(piece))).withColumn("encoding", F.when(text.isNull(), "base64").otherwise("utf-8"))


@query("s12_csv_with_casts", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders")
def s12(spark, d):
    lines = table(spark, d, "orders").select(F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string")).alias("line"))
    row = F.from_csv("line", F.lit("o_orderkey long, o_orderstatus string, price double"), {"sep": ";"})
    return lines.select(row.alias("r")).select("r.o_orderkey", "r.o_orderstatus", F.round("r.price", 2).alias("price"))


@query("s13_jsonl_read", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def s13(spark, d):
    return table(spark, d, "events").select(F.from_json("props", "k long").alias("p")).groupBy(F.col("p.k").alias("k")).count().withColumnRenamed("count", "n")


@query("s14_csv_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s14(spark, d):
    path = scratch(spark, "csv")
    write_csv(table(spark, d, "nation"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("header", True).csv(path)


@query("s15_receipt_sink", """SELECT sha256('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS receipt_id, r_regionkey, r_name FROM region""")
def s15(spark, d):
    path = scratch(spark, "receipts")
    write_receipts(table(spark, d, "region"), path)
    return spark.read.schema("receipt_id string, r_regionkey int, r_name string").json(path)


@query("s17_ranged_read", "SELECT page_id, substring(url, 4, 12) AS piece, 'utf-8' AS encoding FROM pages")
def s17(spark, d):
    return ranged(table(spark, d, "pages").select("page_id", "url"), "url", 3, 12).drop("url")


@query("s18_epoch_micros", "SELECT event_id, epoch_us(ts) AS us FROM events")
def s18(spark, d):
    return table(spark, d, "events").select("event_id", micros(F.col("ts")).alias("us"))
