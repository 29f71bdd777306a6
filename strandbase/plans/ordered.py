"""Global order without a global task: windows inside buckets of the order, joined with a running sum over buckets.

A window without PARTITION BY moves the whole table to one task.  Here rows are
dealt by a bucket that follows the order: a block of row ids (``running_sum``,
``previous``), or, where there is no such number, ranges that Spark samples from all
columns of the order (``ranked``), so that no value, prefix or frequency makes a
bucket hot.  What buckets know of each other is summed in two levels: one row for
some 16 million rows meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import scratch

BLOCK = 4096
#: The block of null ids, which come first.
_NULLS = -(1 << 62)


def block_of(row_id: str, size: int = BLOCK) -> Column:
    return F.coalesce(F.floor(F.col(row_id) / size), F.lit(_NULLS))


def _earlier(by: str | None, order: str):
    w = Window.partitionBy(by) if by else Window.partitionBy()
    return w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _before(totals: DataFrame) -> DataFrame:
    """(__b, __before) from (__b, __t): the sum over all smaller buckets."""
    nothing = F.lit(0)
    if totals.schema["__b"].dataType.simpleString() not in ("int", "bigint"):
        return totals.select("__b", F.coalesce(F.sum("__t").over(_earlier(None, "__b")), nothing).alias("__before"))
    wide = totals.withColumn("__s", F.floor(F.col("__b") / BLOCK))
    tops = wide.groupBy("__s").agg(F.sum("__t").alias("__st")).select("__s", F.coalesce(F.sum("__st").over(_earlier(None, "__s")), nothing).alias("__top"))
    inner = wide.withColumn("__in", F.coalesce(F.sum("__t").over(_earlier("__s", "__b")), nothing))
    return inner.join(tops, "__s").select("__b", (F.col("__in") + F.col("__top")).alias("__before"))


def _summed(rows: DataFrame, order: list, name: str, inclusive: bool) -> DataFrame:
    """Rows with a bucket ``__b`` and a value ``__v``: the sum of the values before each."""
    until = 0 if inclusive else -1
    inner = F.coalesce(F.sum("__v").over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, until)), F.lit(0))
    before = _before(rows.groupBy("__b").agg(F.sum("__v").alias("__t")))
    return rows.withColumn("__in", inner).join(before, "__b").withColumn(name, F.col("__in") + F.col("__before")).drop("__b", "__v", "__in", "__before")


def running_sum(df: DataFrame, bucket: Column, order: list, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each (and with its own, if inclusive); ``bucket`` isn't null and follows the order."""
    return _summed(df.withColumn("__b", bucket).withColumn("__v", value), order, name, inclusive)


def by_ranges(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``__b``, the number of its range in the order; written, so that the ranges stay as they are."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).withColumn("__b", F.spark_partition_id().cast("long"))
    path = scratch(spark, "ranges")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def ranked(df: DataFrame, order: list, name: str = "rank", value: Column | None = None) -> DataFrame:
    """``df`` with each row's place, from 1, in the order; or, with a ``value``, the sum of the values before it.

    The columns of ``order`` make rows distinct.
    """
    rows = df.withColumn("__v", F.lit(1) if value is None else value)
    return _summed(by_ranges(rows, order), order, name, inclusive=value is None)


def global_rank(df: DataFrame, bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in the order."""
    return running_sum(df, bucket, order, F.lit(1), name, inclusive=True)


def _carried(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``rows`` in buckets ``__b`` with prev_<column> of the row before each, the last of the bucket before for a bucket's first."""
    lasts = rows.groupBy("__b").agg(F.max(F.struct(order, *(F.col(c).alias(f"__{k}") for k, c in enumerate(columns)))).alias("__last"))
    wide = lasts.withColumn("__s", F.floor(F.col("__b") / BLOCK))
    tops = wide.groupBy("__s").agg(F.max(F.struct("__b", "__last"))["__last"].alias("__end")).select("__s", F.lag("__end").over(Window.orderBy("__s")).alias("__top"))
    inner = wide.withColumn("__in", F.lag("__last").over(Window.partitionBy("__s").orderBy("__b")))
    carry = inner.join(tops, "__s").select("__b", F.coalesce("__in", "__top").alias("__carry"))
    w = Window.partitionBy("__b").orderBy(order)
    seen = rows.withColumn("__first", F.row_number().over(w) == 1)
    for c in columns:
        seen = seen.withColumn(f"prev_{c}", F.lag(c).over(w))
    out = seen.join(carry, "__b")
    for k, c in enumerate(columns):
        out = out.withColumn(f"prev_{c}", F.when(F.col("__first"), F.col("__carry")[f"__{k}"]).otherwise(F.col(f"prev_{c}")))
    return out.drop("__b", "__first", "__carry")


def previous(df: DataFrame, row_id: str, columns: list[str], size: int = BLOCK, missing=None) -> DataFrame:
    """``df`` with prev_<column> of the row with the next smaller id; ids are distinct and may have gaps of any size.

    Each block's last row is carried to the next block that has rows.
    """
    out = _carried(df.withColumn("__b", block_of(row_id, size)), columns, row_id)
    if missing is not None:
        out = out.fillna(missing, [f"prev_{c}" for c in columns])
    return out


def predecessor(df: DataFrame, value: str, name: str = "prev") -> DataFrame:
    """Distinct values in ascending order, each with the one before it; values of any kind that can be ordered."""
    rows = by_ranges(df.select(value).distinct(), [value])
    return _carried(rows, [value], value).withColumnRenamed(f"prev_{value}", name)
