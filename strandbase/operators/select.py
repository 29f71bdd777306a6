"""Selected-row queries: which rows, and their bytes and offsets in the answer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import table
from ..plans.ordered import BLOCK, block_of, global_rank, running_sum
from ..registry import query

FEW = 200_000


def take(rows: DataFrame, ids: DataFrame, row_id: str = "row_id", value: str = "value") -> DataFrame:
    """Rows by id with their offset in the concatenated answer; ids are broadcast if they are counted to be few."""
    ids = ids.select(row_id)  # so a row of the broadcast is one id
    side = F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids
    hit = rows.join(side, row_id, "left_semi")
    return running_sum(hit, block_of(row_id), [row_id], F.octet_length(value).cast("long"), "offset")


def take_planned(rows: DataFrame, ids: DataFrame, n_rows: int, row_id: str = "row_id", value: str = "value") -> DataFrame:
    """``take``, but a selection of every row is a plain scan."""
    if ids.distinct().count() == n_rows:
        return running_sum(rows, block_of(row_id), [row_id], F.octet_length(value).cast("long"), "offset")
    return take(rows, ids, row_id, value)


def nested_sample(rows: DataFrame, percents: list[float], n_rows: int, row_id: str = "row_id", seed: str = "123", ceiling: bool = False) -> DataFrame:
    """(percent, row_id): the floor (or ceiling) of n p / 100 rows least in the order of a seeded hash; larger percents hold smaller ones."""
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(row_id).cast("string")))
    digits = max(1, math.ceil(math.log(max(n_rows, 1) / BLOCK + 1, 16)))  # of the hash: buckets hold about BLOCK rows at any size
    bucket = F.conv(F.substring("key", 1, min(digits, 12)), 16, 10).cast("long")
    ranked = global_rank(rows.select(row_id).withColumn("key", key), bucket, ["key", row_id])
    size = math.ceil if ceiling else math.floor
    wanted = [F.struct(F.lit(float(p)).alias("percent"), F.lit(size(n_rows * p / 100)).alias("k")) for p in percents]
    return ranked.select(row_id, "rank", F.explode(F.array(*wanted)).alias("w")).where("rank <= w.k").select("w.percent", row_id)


def block_take(rows: DataFrame, ids: DataFrame, row_id: str = "row_id", size: int = 1000) -> DataFrame:
    """Rows by id, reading only blocks that hold some: a block column of the stored table prunes files."""
    blocks = ids.select(F.floor(F.col(row_id) / size).alias("block")).distinct()
    blocked = rows.withColumn("block", F.floor(F.col(row_id) / size))
    return blocked.join(blocks, "block", "left_semi").join(ids, row_id, "left_semi")


def span_take(rows: DataFrame, ids: DataFrame, row_id: str = "row_id", value: str = "value", size: int = 64) -> DataFrame:
    """(row_id, start, n_bytes, value): whole rows cut out of their payload by offsets, which count all rows.

    The payload is the values one after another, in blocks of ``size`` ids; only blocks
    that hold a wanted row are put together.  A null value is an empty row.
    """
    n = F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    block = F.floor(F.col(row_id) / size)
    spans = running_sum(rows.select(row_id, n.alias("n_bytes")), block_of(row_id), [row_id], F.col("n_bytes"), "start").withColumn("block", block)
    bases = spans.groupBy("block").agg(F.min("start").alias("base"))
    hit = spans.join(ids.select(row_id).distinct(), row_id, "left_semi").join(bases, "block")
    blocked = rows.select(row_id, value, block.alias("block")).join(hit.select("block").distinct(), "block", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(row_id), F.col(value).alias("v")))), lambda x: x["v"])
    payloads = blocked.groupBy("block").agg(F.array_join(ordered, "").cast("binary").alias("payload"))
    piece = F.substring(F.col("payload"), (F.col("start") - F.col("base") + 1).cast("int"), F.col("n_bytes").cast("int"))
    return hit.join(payloads, "block").select(row_id, "start", "n_bytes", piece.cast("string").alias(value))


def checkpoints(rows: DataFrame, row_id: str, value: str, every: int = 32) -> DataFrame:
    """Each row's offset as its block's absolute offset and the offset inside the block."""
    size = F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    run = running_sum(rows, block_of(row_id), [row_id], size, "offset").withColumn("block", F.floor(F.col(row_id) / every))
    # A block begins at its least row, whichever id that has.
    first = F.min("offset").over(Window.partitionBy("block"))
    return run.withColumn("block_offset", first).withColumn("inner_offset", F.col("offset") - F.col("block_offset"))


def _names(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.concat("c_name", F.lit("\n")).alias("value"))


_ROWS = "rows_ AS (SELECT c_custkey AS row_id, c_name || chr(10) AS value FROM customer)"
_OFFSET = "CAST(coalesce(sum(octet_length(encode(value))) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


@query("r1_full_scan", "SELECT count(*) AS n_rows, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS n_bytes FROM customer")
def r1(spark, d):
    return _names(spark, d).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("value")).cast("long").alias("n_bytes"))


@query("r2_take_rows_offsets", f"WITH {_ROWS}, hit AS (SELECT * FROM rows_ WHERE row_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) SELECT row_id, value, {_OFFSET} AS \"offset\" FROM hit")
def r2(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("row_id")).distinct()
    return take(_names(spark, d), ids)


@query(
    "r3_boundary_selections",
    f"""WITH {_ROWS}, n AS (SELECT count(*) AS n FROM rows_) SELECT s AS selection, row_id FROM (
    SELECT 'last' AS s, row_id FROM rows_, n WHERE row_id = n - 1 UNION ALL SELECT 'first', row_id FROM rows_ WHERE row_id = 0
    UNION ALL SELECT 'even', row_id FROM rows_ WHERE row_id % 2 = 0 UNION ALL SELECT 'triple', row_id FROM rows_, n WHERE row_id IN (0, n // 2, n - 1))""",
)
def r3(spark, d):
    rows = _names(spark, d).select("row_id")
    n = rows.count()
    tests = {"last": F.col("row_id") == n - 1, "first": F.col("row_id") == 0, "even": F.col("row_id") % 2 == 0, "triple": F.col("row_id").isin(0, n // 2, n - 1)}
    names = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("selection"), "row_id")


def _sample_sql(size: str) -> str:
    return f"WITH r AS (SELECT c_custkey AS row_id, row_number() OVER (ORDER BY md5('123:' || c_custkey), c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT CAST(p AS DOUBLE) AS percent, row_id FROM r, (SELECT unnest([1, 3, 10, 30, 100]) AS p) WHERE k <= {size}(n * p / 100.0)"


@query("r4_nested_sample", _sample_sql("floor"))
def r4(spark, d):
    rows = _names(spark, d)
    return nested_sample(rows, [1, 3, 10, 30, 100], rows.count())


@query("r5_ceiling_sample", _sample_sql("ceil"))
def r5(spark, d):
    rows = _names(spark, d)
    return nested_sample(rows, [1, 3, 10, 30, 100], rows.count(), ceiling=True)


@query("r6_block_take", "SELECT o_orderkey AS row_id, o_orderpriority AS value FROM orders WHERE o_orderkey IN (SELECT c_custkey * 10 FROM customer WHERE c_mktsegment = 'BUILDING')")
def r6(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") * 10).alias("row_id"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("value"))
    return block_take(rows, ids).select("row_id", "value")


@query(
    "r7_checkpoint_offsets",
    f"WITH {_ROWS}, o AS (SELECT row_id, {_OFFSET} AS off FROM rows_) SELECT o.row_id, b.off AS block_offset, o.off - b.off AS inner_offset FROM o JOIN o b ON b.row_id = o.row_id // 32 * 32",
)
def r7(spark, d):
    return checkpoints(_names(spark, d), "row_id", "value").select("row_id", "block_offset", "inner_offset")


@query("r8_direct_offset_take", "SELECT doc_id, md5(substring(text, 11, 20)) AS piece FROM documents WHERE doc_id % 7 = 3")
def r8(spark, d):
    return table(spark, d, "documents").where("doc_id % 7 = 3").select("doc_id", F.md5(F.substring("text", 11, 20).cast("binary")).alias("piece"))


@query(
    "r8b_offset_span_take",
    """WITH o AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    s AS (SELECT doc_id, text, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM o)
    SELECT doc_id, start, n_bytes, text FROM s WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def r8b(spark, d):
    return span_take(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"), "doc_id", "text")


@query("r9_selectivity_plan", f"WITH {_ROWS} SELECT row_id, {_OFFSET} AS \"offset\" FROM rows_")
def r9(spark, d):
    rows = _names(spark, d)
    return take_planned(rows, rows.select("row_id"), rows.count()).select("row_id", "offset")


def violations(ids: DataFrame, order: str, row_id: str, n_rows: int) -> DataFrame:
    """(unsorted, out_of_range) of a selection given in the order of ``order``."""
    from ..plans.ordered import previous

    checked = previous(ids, order, [row_id])
    return checked.agg(
        F.count(F.when(F.col(f"prev_{row_id}") > F.col(row_id), 1)).alias("unsorted"),
        F.count(F.when((F.col(row_id) < 0) | (F.col(row_id) >= n_rows), 1)).alias("out_of_range"),
    )


@query(
    "r11_selection_validation",
    """SELECT count(CASE WHEN p > o_custkey THEN 1 END) AS unsorted, count(CASE WHEN o_custkey < 0 OR o_custkey >= 1000 THEN 1 END) AS out_of_range
    FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders)""",
)
def r11(spark, d):
    return violations(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 1000)


@query(
    "r12_capacity",
    """SELECT cap, CASE WHEN total <= cap THEN total ELSE -1 END AS written FROM (SELECT CAST(sum(octet_length(encode(c_name))) AS BIGINT) AS total FROM customer), (SELECT unnest([0, 17999, 27000, 100000000]) AS c) t(c0) , LATERAL (SELECT CAST(c0 AS BIGINT) AS cap)""",
)
def r12(spark, d):
    total = table(spark, d, "customer").agg(F.sum(F.octet_length("c_name")).cast("long").alias("total"))
    caps = F.explode(F.array(*(F.lit(c).cast("long") for c in (0, 17_999, 27_000, 100_000_000))))
    return total.select("total", caps.alias("cap")).select("cap", F.when(F.col("total") <= F.col("cap"), F.col("total")).otherwise(F.lit(-1)).alias("written"))


@query(
    "r11b_validation_of_customers",
    """SELECT count(CASE WHEN p > o_custkey THEN 1 END) AS unsorted, count(CASE WHEN o_custkey < 0 OR o_custkey >= (SELECT count(*) FROM customer) THEN 1 END) AS out_of_range
    FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders)""",
)
def r11b(spark, d):
    return violations(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", table(spark, d, "customer").count())


@query(
    "r12b_capacity_about_total",
    """SELECT cap, CASE WHEN total <= cap THEN total ELSE -1 END AS written FROM (SELECT total, unnest([0, total - 1, total, total + 1, 2 * total]) AS cap FROM (SELECT CAST(sum(octet_length(encode(c_name))) AS BIGINT) AS total FROM customer))""",
)
def r12b(spark, d):
    total = table(spark, d, "customer").agg(F.sum(F.octet_length("c_name")).cast("long").alias("total"))
    t = F.col("total")
    caps = F.explode(F.array(F.lit(0).cast("long"), t - 1, t, t + 1, t * 2))
    return total.select("total", caps.alias("cap")).select("cap", F.when(t <= F.col("cap"), t).otherwise(F.lit(-1)).alias("written"))


@query("r13_row_length", "SELECT octet_length(encode(url)) AS n_bytes, count(*) AS n_rows FROM pages GROUP BY ALL")
def r13(spark, d):
    return table(spark, d, "pages").groupBy(F.octet_length("url").cast("long").alias("n_bytes")).agg(F.count("*").alias("n_rows"))


@query("r14_catalog_filter", "SELECT p_partkey, p_name FROM part WHERE p_type NOT LIKE '%STEEL%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#33')")
def r14(spark, d):
    return table(spark, d, "part").where(~F.col("p_type").like("%STEEL%") & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#33")).select("p_partkey", "p_name")


@query(
    "r15_key_from_path",
    r"SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS arm, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/[a-z]{2}/') THEN 'other' ELSE 'none' END AS stage FROM pages",
)
def r15(spark, d):
    stage = F.when(F.col("url").rlike("/en/"), "english").when(F.col("url").rlike("/[a-z]{2}/"), "other").otherwise("none")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("arm"), stage.alias("stage"))
