"""Measurement: exactness, ledgers, timings, comparison of methods."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import table
from ..plans.ordered import ranked
from ..registry import query


def mismatches(a: DataFrame, b: DataFrame, row_id: str, value: str) -> DataFrame:
    """(n_rows, n_bad): rows of either table that the other lacks or has otherwise."""
    both = a.select(row_id, F.col(value).alias("x"), F.lit(1).alias("ina")).join(b.select(row_id, F.col(value).alias("y"), F.lit(1).alias("inb")), row_id, "full")
    return both.agg(F.count("*").alias("n_rows"), F.count(F.when(~F.col("x").eqNullSafe(F.col("y")) | F.col("ina").isNull() | F.col("inb").isNull(), 1)).alias("n_bad"))


@query("m1_roundtrip_mismatch", "SELECT count(*) AS n_rows, count(CASE WHEN c_custkey % 100 = 7 THEN 1 END) AS n_bad FROM customer")
def m1(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_name")
    b = a.withColumn("c_name", F.when(F.col("c_custkey") % 100 == 7, F.reverse("c_name")).otherwise(F.col("c_name")))
    return mismatches(a, b, "c_custkey", "c_name")


@query("m2_selected_rows_check", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad FROM customer WHERE c_custkey % 10 = 3")
def m2(spark, d):
    from .select import take

    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("value"))
    ids = rows.where("row_id % 10 = 3").select("row_id")
    got = take(rows, ids)
    return mismatches(got, rows.where("row_id % 10 = 3"), "row_id", "value")


@query("m3_row_count_conservation", "SELECT 'orders' AS name, count(*) AS n_rows, count(*) = (SELECT count(DISTINCT o_orderkey) FROM orders) AS conserved FROM orders")
def m3(spark, d):
    one = table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("k"))
    return one.select(F.lit("orders").alias("name"), "n_rows", (F.col("n_rows") == F.col("k")).alias("conserved"))


@query("m4_sum_per_trial", "SELECT event_id % 7 AS trial, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def m4(spark, d):
    return table(spark, d, "events").groupBy((F.col("event_id") % 7).alias("trial")).agg(F.round(F.sum("value"), 4).alias("seconds"))


@query("m5_median_min_max", "SELECT event_type, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def m5(spark, d):
    found = exact_medians(table(spark, d, "events"), "event_type", "value")
    return found.select("event_type", F.round("median", 6).alias("median"), "low", "high")


def exact_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, low, high): from counts of values in order, so no group is held in one place; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    run = ranked(counts, [group, value], "before", F.col("n"))
    whole = run.groupBy(group).agg(F.min("before").alias("base"), F.sum("n").alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    placed = run.join(whole, run[group].eqNullSafe(whole[group])).drop(whole[group]).withColumn("at", F.col("before") - F.col("base"))
    holds = lambda k: (F.col("at") <= k) & (k < F.col("at") + F.col("n"))
    middle = [F.max(F.when(holds(k), F.col(value))) for k in (F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))]
    return placed.groupBy(group).agg(((middle[0] + middle[1]) / 2).alias("median"), F.max("low").alias("low"), F.max("high").alias("high"))


@query("m6_geomean_throughput", "SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS geomean FROM events WHERE value > -1 GROUP BY event_type")
def m6(spark, d):
    return table(spark, d, "events").where("value > -1").groupBy("event_type").agg(F.round(F.exp(F.avg(F.ln(F.col("value") + 1))), 6).alias("geomean"))


@query("m7_throughput", "SELECT doc_id % 10 AS method, round(sum(octet_length(encode(text))) / 1e6 / (1 + doc_id % 10), 6) AS mb_s, round(count(*) / 1e6 / (1 + doc_id % 10), 9) AS mrows_s FROM documents GROUP BY doc_id % 10")
def m7(spark, d):
    m = (F.col("doc_id") % 10).alias("method")
    sums = table(spark, d, "documents").groupBy(m).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
    return sums.select("method", F.round(F.col("b") / 1e6 / (F.col("method") + 1), 6).alias("mb_s"), F.round(F.col("n") / 1e6 / (F.col("method") + 1), 9).alias("mrows_s"))


@query("m8_ratio_bits_per_byte", "SELECT lang, round(n / p, 6) AS ratio, round(8 * p / n, 6) AS bits_per_byte FROM (SELECT lang, CAST(sum(octet_length(encode(text))) AS DOUBLE) AS n, CAST(sum(n_chars // 2 + 16) AS DOUBLE) AS p FROM documents GROUP BY lang)")
def m8(spark, d):
    sums = table(spark, d, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).cast("double").alias("n"), F.sum(F.floor(F.col("n_chars") / 2) + 16).cast("double").alias("p"))
    return sums.select("lang", F.round(F.try_divide("n", "p"), 6).alias("ratio"), F.round(F.try_divide(8 * F.col("p"), F.col("n")), 6).alias("bits_per_byte"))


def ledger(files: DataFrame, decoders: DataFrame, exempt: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, package): archive bytes, one decoder, and the parts of it that aren't exempt."""
    archives = files.groupBy(dataset).agg(F.sum("archive").alias("archive"))
    charged = decoders.join(exempt, "part", "left_anti").groupBy(dataset).agg(F.sum("bytes").alias("decoder"))
    return archives.join(charged, dataset, "left").select(dataset, (F.col("archive") + F.coalesce("decoder", F.lit(0))).cast("long").alias("package"))


@query("m9_package_ledger", "WITH a AS (SELECT c_nationkey AS dataset, sum(length(c_name)) AS archive FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS dataset, sum(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END) AS decoder FROM supplier GROUP BY 1) SELECT a.dataset, CAST(archive + coalesce(decoder, 0) AS BIGINT) AS package FROM a LEFT JOIN s USING (dataset)")
def m9(spark, d):
    files = table(spark, d, "customer").select(F.col("c_nationkey").alias("dataset"), F.length("c_name").alias("archive"))
    parts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("dataset"), F.col("s_suppkey").alias("part"), F.col("s_suppkey").alias("bytes"))
    return ledger(files, parts, parts.where("part % 3 = 0").select("part"))


def reachable(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """(root, node): all nodes that edges (src, dst) lead to, by levels; each level joins only what is new."""
    known = roots.select(F.col("root"), F.col("root").alias("node"))
    level = known
    for _ in range(most):
        level = level.join(edges, level["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct().join(known, ["root", "node"], "left_anti").checkpoint()
        if not level.limit(1).count():
            return known
        known = known.unionAll(level)
    raise ValueError("the graph is deeper than allowed")


@query("m10_dependency_closure", "WITH RECURSIVE r AS (SELECT n_nationkey AS root, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT root, node // 2 FROM r WHERE node > 0) SELECT CAST(root AS BIGINT) AS root, node FROM r")
def m10(spark, d):
    if spark.sparkContext.getCheckpointDir() is None:
        from ..plans.paths import scratch

        spark.sparkContext.setCheckpointDir(scratch(spark, "closure"))
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("root"))
    edges = nodes.where("root > 0").select(F.col("root").alias("src"), F.floor(F.col("root") / 2).alias("dst"))
    return reachable(edges, nodes)


@query("m11_target_test", "SELECT p_brand, max(p_size) <= 50 AND min(p_retailprice) > 800 AND bool_and(p_retailprice > 850) AS passed FROM part GROUP BY p_brand")
def m11(spark, d):
    ok = (F.max("p_size") <= 50) & (F.min("p_retailprice") > 800) & F.bool_and(F.col("p_retailprice") > 850)
    return table(spark, d, "part").groupBy("p_brand").agg(ok.alias("passed"))


def pareto(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points that no other beats in one measure without losing in the other; equal points stay together.

    By windows inside buckets of x rather than all pairs: a point stays if its y is the
    best at its x and above every y at a larger x.
    """
    best = points.groupBy(x).agg(F.max(y).alias("top"))
    edges = best.approxQuantile(x, [i / 64 for i in range(65)], 0.001) if best.limit(1).count() else []
    cuts = sorted(set(edges))
    bucket = sum((F.when(F.col(x) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = best.withColumn("bucket", bucket)
    tops = rows.groupBy("bucket").agg(F.max("top").alias("bt"))
    beyond = tops.select("bucket", F.max("bt").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("beyond"))
    within = F.max("top").over(Window.partitionBy("bucket").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    front = rows.withColumn("within", within).join(beyond, "bucket").where((F.col("within").isNull() | (F.col("top") > F.col("within"))) & (F.col("beyond").isNull() | (F.col("top") > F.col("beyond"))))
    return points.join(front.select(x, F.col("top").alias(y)), [x, y], "left_semi")


@query("m12_pareto_frontier", "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))")
def m12(spark, d):
    return pareto(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("m13_grouped_sums_first_seen", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, row_number() OVER (ORDER BY min(o_orderkey)) AS place FROM orders GROUP BY o_orderpriority")
def m13(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first"))
    return g.select("o_orderpriority", "n", "total", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))


@query("m14_exact_money", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS money FROM lineitem GROUP BY 1")
def m14(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("money"))


@query("m15_tiered_rate", "SELECT l_shipdate IS NULL AS undated, CAST(sum(CASE WHEN l_quantity > 30 THEN l_quantity * 2 ELSE l_quantity END) AS BIGINT) AS cost FROM lineitem GROUP BY 1")
def m15(spark, d):
    rate = F.when(F.col("l_quantity") > 30, F.col("l_quantity") * 2).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(F.col("l_shipdate").isNull().alias("undated")).agg(F.sum(rate).cast("long").alias("cost"))


@query("m16_uniqueness_and_references", "SELECT (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS is_unique, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS dangling")
def m16(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    marked = orders.join(customers.select(F.col("c_custkey").alias("known")).distinct(), F.col("o_custkey") == F.col("known"), "left")
    return marked.agg((F.count("*") == F.countDistinct("o_orderkey")).alias("is_unique"), F.count(F.when(F.col("known").isNull(), 1)).alias("dangling"))


def code_lines(text: Column) -> Column:
    """Lines that aren't blank after line comments are cut."""
    return F.size(F.filter(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, "//.*$", "")) != ""))


@query("m17_code_lines", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '//.*$', '')) <> '')) AS n FROM documents")
def m17(spark, d):
    return table(spark, d, "documents").select("doc_id", code_lines(F.col("text")).cast("long").alias("n"))


@query("m18_compare_selected", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey IN (1, 5, 8, 13, 21, 34, 55, 89)")
def m18(spark, d):
    return table(spark, d, "part").where(F.col("p_partkey").isin(1, 5, 8, 13, 21, 34, 55, 89)).select("p_partkey", "p_brand", "p_size")


@query("m19_counter_parse", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS count FROM events")
def m19(spark, d):
    line = F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("<not supported>")).otherwise(F.col("user_id").cast("string")), F.lit(";;cycles"))
    rows = table(spark, d, "events").select("event_id", F.split(line, ";").alias("p"))
    return rows.select("event_id", F.expr("try_cast(p[0] AS long)").alias("count"))


@query("m20_best_scheme", "SELECT p_brand, arg_min(p_container, (size, p_container)) AS best FROM (SELECT p_brand, p_type AS p_container, min(p_size) AS size FROM part GROUP BY ALL) GROUP BY p_brand")
def m20(spark, d):
    sized = table(spark, d, "part").groupBy("p_brand", F.col("p_type").alias("scheme")).agg(F.min("p_size").alias("size"))
    return sized.groupBy("p_brand").agg(F.min_by("scheme", F.struct("size", "scheme")).alias("best"))


@query("m21_rotated_order", "SELECT n_nationkey, r AS replay, (n_nationkey + r) % 25 AS place FROM nation, (SELECT unnest([0, 1, 2]) AS r)")
def m21(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("replay")).withColumn("place", (F.col("n_nationkey") + F.col("replay")) % 25)


def mutations(df: DataFrame, row_id: str, packed: str) -> DataFrame:
    """(row_id, kind, k, mutated): a packed value cut short (empty, one to four fifths) and with one of its first eight bytes changed."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.lit("cut").alias("kind"), i.alias("k"), F.substring(F.col(packed), F.lit(1), F.floor(F.octet_length(packed) * i / 5).cast("int")).alias("mutated")))
    flip = lambda i: F.concat(F.substring(F.col(packed), F.lit(1), i), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(F.col(packed), i + 1, F.lit(1))), 16, 10).cast("long").bitwiseXOR(F.lit(255))), 2, "0")), F.substring(F.col(packed), i + 2, F.octet_length(packed)))
    flips = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.lit("flip").alias("kind"), i.alias("k"), flip(i).alias("mutated")))
    return df.select(row_id, F.explode(F.concat(cuts, flips)).alias("m")).select(row_id, "m.*")


@query("m22_corruption_cases")
def m22(spark, d):
    """Every mutated block must fail to unpack or give other bytes: never the original without notice."""
    from .match import packed_blocks

    @F.pandas_udf("string")
    def verdict(mutated: pd.Series, packed: pd.Series) -> pd.Series:
        def one(m: bytes, p: bytes) -> str:
            try:
                return "same" if zlib.decompress(m) == zlib.decompress(p) else "differs"
            except zlib.error:
                return "rejected"

        return pd.Series([one(bytes(m), bytes(p)) for m, p in zip(mutated, packed, strict=True)])

    blocks = packed_blocks(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name")
    cases = mutations(blocks, "block", "packed").join(blocks.select("block", "packed"), "block")
    return cases.select("kind", "k", verdict("mutated", "packed").alias("verdict")).groupBy("kind", "k", "verdict").agg(F.count("*").alias("n"))


@query("m23_retry_merge", "SELECT c.c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN n >= 15 THEN 'kept' ELSE 'failed' END AS status FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def m23(spark, d):
    done = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "missing").when(F.col("n") >= 15, "kept").otherwise("failed").alias("status"))
