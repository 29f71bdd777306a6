"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_width(v: Column) -> Column:
    """Bits needed for a non-negative integer: 0 for 0."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v)))


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 to 0, 1, 2, 3."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_bytes(v: Column) -> Column:
    """Bytes of a non-negative integer at seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(bit_width(v) / 7)).cast("long")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of texts, cut at line feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def words(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, word): what stands between spaces and line feeds, empty ones left out."""
    return df.select(id_column, F.posexplode(F.filter(F.split(text_column, "[ \n]+"), lambda w: w != "")).alias("pos", "word"))
