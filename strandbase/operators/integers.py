"""Integer columns: frames, differences, runs, planes, packings and the choice among them by size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bit_width, micros, table, varint_bytes, zigzag
from ..plans.ordered import block_of, global_rank, previous, ranked, running_sum
from ..registry import query


def _keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("v"))


_K = "k AS (SELECT o_orderkey AS row_id, o_custkey AS v FROM orders)"
_W = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


def frame_of_reference(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, least, width, n, bits): values less their group's least take ``width`` bits each."""
    spans = df.groupBy(*group).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))
    width = bit_width(F.col("most") - F.col("least")).cast("long")
    return spans.select(*group, "least", width.alias("width"), "n", (width * F.col("n")).alias("bits"))


@query("i1_frame_of_reference_bits", "SELECT c, least, " + _W.format("(most - least)") + " AS width, n, n * (" + _W.format("(most - least)") + ") AS bits FROM (SELECT 'o_custkey' AS c, min(o_custkey) AS least, max(o_custkey) AS most, count(*) AS n FROM orders UNION ALL SELECT 'l_partkey', min(l_partkey), max(l_partkey), count(*) FROM lineitem)")
def i1(spark, d):
    both = table(spark, d, "orders").select(F.lit("o_custkey").alias("c"), F.col("o_custkey").alias("v")).unionAll(table(spark, d, "lineitem").select(F.lit("l_partkey"), "l_partkey"))
    return frame_of_reference(both, ["c"], "v")


@query("i2_delta", f"WITH {_K} SELECT row_id, v - coalesce(lag(v) OVER (ORDER BY row_id), 0) AS delta FROM k")
def i2(spark, d):
    return previous(_keys(spark, d), "row_id", ["v"]).select("row_id", (F.col("v") - F.coalesce("prev_v", F.lit(0))).alias("delta"))


@query("i3_delta_zigzag", f"WITH {_K}, x AS (SELECT row_id, v - coalesce(lag(v) OVER (ORDER BY row_id), 0) AS delta FROM k) SELECT row_id, xor(delta * 2, delta >> 63) AS z FROM x")
def i3(spark, d):
    return i2(spark, d).select("row_id", zigzag(F.col("delta")).alias("z"))


@query("i4_varint_cost", f"WITH {_K}, x AS (SELECT row_id, v - coalesce(lag(v) OVER (ORDER BY row_id), 0) AS delta FROM k), z AS (SELECT xor(delta * 2, delta >> 63) AS z FROM x) SELECT CAST(greatest(1, ceil((CASE WHEN z = 0 THEN 0 ELSE length(bin(z)) END) / 7.0)) AS BIGINT) AS n_bytes, count(*) AS n FROM z GROUP BY ALL")
def i4(spark, d):
    return i3(spark, d).groupBy(varint_bytes(F.col("z")).alias("n_bytes")).agg(F.count("*").alias("n"))


def bit_pack(df: DataFrame, row_id: str, value: str, width: int, size: int = 4096) -> DataFrame:
    """(block, n, packed): values of a block as ``width``-bit fields, lowest bit first."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch["values"]:
                v = np.asarray(values, np.uint64)
                bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
                out.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
            yield pd.DataFrame({"block": batch["block"], "n": batch["n"], "packed": out})

    blocks = df.groupBy(block_of(row_id, size).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct(row_id, value))), lambda s: s[value]).alias("values"))
    return blocks.select("block", F.size("values").alias("n"), "values").mapInPandas(pack, "block long, n int, packed binary")


def bit_unpack(packed: DataFrame, width: int, size: int = 4096) -> DataFrame:
    """(row_id, v) from blocks of ``bit_pack``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, n, data in zip(batch["block"], batch["n"], batch["packed"], strict=True):
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
                v = (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1).astype(np.int64)
                yield pd.DataFrame({"row_id": block * size + np.arange(n), "v": v})

    return packed.mapInPandas(unpack, "row_id long, v long")


@query("i5_bit_packing_roundtrip", "SELECT o_orderkey AS row_id, o_custkey AS v FROM orders")
def i5(spark, d):
    return bit_unpack(bit_pack(_keys(spark, d), "row_id", "v", 40), 40)


def runs(df: DataFrame, row_id: str, value: str) -> DataFrame:
    """(run, v, first, n): maximal runs of equal values in row order."""
    marked = previous(df, row_id, [value]).withColumn("new", F.when(F.col(f"prev_{value}").eqNullSafe(F.col(value)), 0).otherwise(1))
    numbered = running_sum(marked, block_of(row_id), [row_id], F.col("new"), "run", inclusive=True)
    return numbered.groupBy("run").agg(F.min(value).alias("v"), F.min(row_id).alias("first"), F.count("*").alias("n"))


@query("i6_run_length", "WITH x AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT event_id, event_type, sum(new) OVER (ORDER BY event_id) AS run FROM x) SELECT CAST(run AS BIGINT) AS run, min(event_type) AS v, min(event_id) AS first, count(*) AS n FROM r GROUP BY run")
def i6(spark, d):
    return runs(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type").withColumn("run", F.col("run").cast("long"))


@query("i7_byte_planes", "SELECT CAST(p AS INTEGER) AS plane, (o_custkey >> (8 * p)) & 255 AS byte, count(*) AS n FROM orders, (SELECT unnest([0, 1, 2, 3]) AS p) GROUP BY ALL")
def i7(spark, d):
    planes = F.explode(F.array(*(F.struct(F.lit(p).alias("plane"), F.shiftright("o_custkey", 8 * p).bitwiseAND(255).alias("byte")) for p in range(4)))).alias("x")
    return table(spark, d, "orders").select(planes).groupBy("x.plane", "x.byte").agg(F.count("*").alias("n"))


def costs(df: DataFrame, row_id: str, value: str) -> DataFrame:
    """(mode, bytes) of storing a column in each of five ways; one pass with the difference beside the value."""
    z = zigzag(F.col(value) - F.coalesce(f"prev_{value}", F.lit(0)))
    seen = previous(df, row_id, [value]).withColumn("z", z)
    one = seen.agg(
        (F.count("*") * 8).alias("raw"),
        F.ceil(F.count("*") * bit_width(F.max(value) - F.min(value)) / 8).alias("frame"),
        F.sum(varint_bytes(F.col(value))).alias("varint"),
        F.sum(varint_bytes(F.col("z"))).alias("delta_varint"),
        F.ceil(F.count("*") * bit_width(F.max("z")) / 8).alias("delta_packed"),
    )
    return one.unpivot([], ["raw", "frame", "varint", "delta_varint", "delta_packed"], "mode", "bytes").withColumn("bytes", F.col("bytes").cast("long"))


@query(
    "i8_best_integer_mode",
    "WITH e AS (SELECT event_id, user_id AS v, user_id - coalesce(lag(user_id) OVER (ORDER BY event_id), 0) AS dl FROM events), z AS (SELECT v, xor(dl * 2, dl >> 63) AS z FROM e), c AS (SELECT 'raw' AS mode, count(*) * 8 AS bytes FROM z UNION ALL SELECT 'frame', CAST(ceil(count(*) * length(bin(max(v) - min(v))) / 8.0) AS BIGINT) FROM z UNION ALL SELECT 'varint', CAST(sum(greatest(1, ceil((CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END) / 7.0))) AS BIGINT) FROM z UNION ALL SELECT 'delta_varint', CAST(sum(greatest(1, ceil((CASE WHEN z = 0 THEN 0 ELSE length(bin(z)) END) / 7.0))) AS BIGINT) FROM z UNION ALL SELECT 'delta_packed', CAST(ceil(count(*) * length(bin(max(z))) / 8.0) AS BIGINT) FROM z) SELECT mode, bytes, bytes = min(bytes) OVER () AND mode = first_value(mode) OVER (ORDER BY bytes, mode) AS best FROM c",
)
def i8(spark, d):
    rows = costs(table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id")
    best = F.min(F.struct("bytes", "mode")).over(Window.partitionBy())  # five rows
    return rows.withColumn("b", best).select("mode", "bytes", (F.col("mode") == F.col("b.mode")).alias("best"))


@query("i9_constant_columns", "SELECT 'l_linestatus' AS c, count(DISTINCT l_linestatus) = 1 AS constant FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) = 1 FROM lineitem UNION ALL SELECT 'fixed', true")
def i9(spark, d):
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.lit("x").alias("fixed"))
    one = rows.agg(*((F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count("*"))).alias(c) for c in rows.columns))
    return one.unpivot([], rows.columns, "c", "constant")


@query(
    "i10_singletons_and_repeats",
    "WITH n AS (SELECT text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text), r AS (SELECT text, row_number() OVER (ORDER BY first) AS id FROM n WHERE n > 1) SELECT d.doc_id, r.id FROM documents d LEFT JOIN r ON d.text = r.text",
)
def i10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    repeated = docs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    ids = global_rank(repeated, block_of("first"), ["first"], "id")
    return docs.join(ids.select("key", F.col("id").cast("long").alias("id")), "key", "left").select("doc_id", "id")


@query("i11_quantised_grid", "SELECT count(*) AS n, count(CASE WHEN (q * 10000000 + 2097152) // 4194304 = v THEN 1 END) AS n_exact FROM (SELECT v, (v * 4194304 + 5000000) // 10000000 AS q FROM (SELECT o_custkey * 1000003 % 10000000 AS v FROM orders))")
def i11(spark, d):
    v = table(spark, d, "orders").select((F.col("o_custkey") * 1_000_003 % 10_000_000).alias("v"))
    q = v.withColumn("q", F.floor((F.col("v") * 4_194_304 + 5_000_000) / F.lit(10_000_000).cast("decimal(20,0)")).cast("long"))
    back = F.floor((F.col("q") * 10_000_000 + 2_097_152) / F.lit(4_194_304).cast("decimal(20,0)")).cast("long")
    return q.agg(F.count("*").alias("n"), F.count(F.when(back == F.col("v"), 1)).alias("n_exact"))


@query("i12_radix_pack", "SELECT o_orderkey // 5 AS word, CAST(sum((o_custkey % 1000) * CAST(pow(1000, o_orderkey % 5) AS BIGINT)) AS BIGINT) AS packed FROM orders GROUP BY ALL")
def i12(spark, d):
    power = F.element_at(F.array(*(F.lit(1000**k).cast("long") for k in range(5))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 5).alias("word")).agg(F.sum((F.col("o_custkey") % 1000) * power).cast("long").alias("packed"))


def radix_pack(df: DataFrame, row_id: str, value: str, radix: int, digits: int) -> DataFrame:
    """(word, n, packed): ``digits`` consecutive values below ``radix`` in one number, the first the lowest digit."""
    assert radix**digits < 1 << 63
    place = F.pmod(F.col(row_id), F.lit(digits))
    power = F.element_at(F.array(*(F.lit(radix**k).cast("long") for k in range(digits))), (place + 1).cast("int"))
    fits = F.when((F.col(value) < 0) | (F.col(value) >= radix), F.raise_error(F.lit("a value is not below the radix"))).otherwise(F.col(value))
    return df.groupBy(F.floor(F.col(row_id) / digits).alias("word")).agg(F.sum(fits.cast("long") * power).cast("long").alias("packed"), F.sort_array(F.collect_list(place.cast("int"))).alias("places"))


def radix_unpack(packed: DataFrame, radix: int, digits: int) -> DataFrame:
    """(row_id, v) from words of ``radix_pack``."""
    powers = F.array(*(F.lit(radix**k).cast("long") for k in range(digits)))
    each = packed.select("word", "packed", F.explode("places").alias("place"))
    digit = F.pmod(F.floor(F.col("packed") / F.element_at(powers, F.col("place") + 1).cast("decimal(20,0)")).cast("long"), F.lit(radix))
    return each.select((F.col("word") * digits + F.col("place")).alias("row_id"), digit.alias("v"))


@query("i12b_radix_pack_roundtrip", "SELECT l.row_id, l.v, CAST(p.packed AS BIGINT) AS packed FROM (SELECT o_orderkey AS row_id, o_custkey AS v FROM orders) l JOIN (SELECT o_orderkey // 3 AS word, sum(o_custkey * CAST(pow(2000003, o_orderkey % 3) AS HUGEINT)) AS packed FROM orders GROUP BY ALL) p ON p.word = l.row_id // 3")
def i12b(spark, d):
    """Three whole values a word; the rows come out of the words."""
    words = radix_pack(_keys(spark, d), "row_id", "v", 2_000_003, 3)
    back = radix_unpack(words, 2_000_003, 3)
    return back.join(words.select("word", "packed"), F.floor(F.col("row_id") / 3) == F.col("word")).select("row_id", "v", "packed")


@query("i13_decimal_triplets", "SELECT c_custkey, (CAST(substring(c_name, 10, 3) AS BIGINT) << 20) | (CAST(substring(c_name, 13, 3) AS BIGINT) << 10) | CAST(substring(c_name, 16, 3) AS BIGINT) AS packed FROM customer")
def i13(spark, d):
    part = lambda at: F.substring("c_name", at, 3).cast("long")
    return table(spark, d, "customer").select("c_custkey", F.shiftleft(part(10), 20).bitwiseOR(F.shiftleft(part(13), 10)).bitwiseOR(part(16)).alias("packed"))


@query("i14_base64_ids", "SELECT o_orderkey, md5('x' || o_orderkey) AS back FROM orders")
def i14(spark, d):
    raw = F.unhex(F.md5(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).cast("binary")))
    ids = table(spark, d, "orders").select("o_orderkey", F.translate(F.regexp_replace(F.base64(raw), "=", ""), "+/", "-_").alias("id22"))
    return ids.select("o_orderkey", F.lower(F.hex(F.unbase64(F.concat(F.translate("id22", "-_", "+/"), F.lit("=="))))).alias("back"))


@query(
    "i15_scaled_decimals",
    "SELECT l_orderkey, l_linenumber, cents // 1000 AS base, cents % 1000 AS tail, cents >= 5000000 AS escaped FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)",
)
def i15(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cents.alias("c")).select("l_orderkey", "l_linenumber", F.floor(F.col("c") / 1000).alias("base"), (F.col("c") % 1000).alias("tail"), (F.col("c") >= 5_000_000).alias("escaped"))


@query("i16_grouped_frame", "SELECT o_orderstatus, o_orderpriority, min(o_custkey) AS least, " + _W.format("(max(o_custkey) - min(o_custkey))") + " AS width, count(*) AS n, count(*) * (" + _W.format("(max(o_custkey) - min(o_custkey))") + ") AS bits FROM orders GROUP BY ALL")
def i16(spark, d):
    return frame_of_reference(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_custkey")


@query("i17_rank_permutation", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) AS place FROM customer")
def i17(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_name", "c_custkey")
    return ranked(rows, ["c_mktsegment", "c_name", "c_custkey"], "place").select("c_custkey", F.col("place").cast("long").alias("place"))


@query(
    "i18_time_predictors",
    "WITH x AS (SELECT event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (ORDER BY event_id) AS p1, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS p2 FROM events) SELECT event_id, t - coalesce(p1, 0) AS by_row, t - coalesce(p2, 0) AS by_type FROM x",
)
def i18(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", micros(F.col("ts")).alias("t"))
    by_row = previous(rows, "event_id", ["t"])
    # Within a type: the last time of the type in earlier blocks is carried by a window over block totals.
    w = Window.partitionBy("event_type", "b").orderBy("event_id")
    blocks = rows.withColumn("b", block_of("event_id")).groupBy("event_type", "b").agg(F.max(F.struct("event_id", "t"))["t"].alias("last"))
    carried = blocks.withColumn("carry", F.last("last").over(Window.partitionBy("event_type").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    typed = by_row.withColumn("b", block_of("event_id")).withColumn("p2", F.lag("t").over(w)).join(carried.select("event_type", "b", "carry"), ["event_type", "b"])
    return typed.select("event_id", (F.col("t") - F.coalesce("prev_t", F.lit(0))).alias("by_row"), (F.col("t") - F.coalesce("p2", "carry", F.lit(0))).alias("by_type"))


@query(
    "i19_pair_context",
    "WITH x AS (SELECT event_type AS cur, coalesce(lag(event_type) OVER (ORDER BY event_id), '-') AS prev FROM events), n AS (SELECT prev, cur, count(*) AS n FROM x GROUP BY ALL) SELECT CASE WHEN n < 200 THEN 'rare' ELSE prev || '>' || cur END AS context, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL",
)
def i19(spark, d):
    pairs = previous(table(spark, d, "events").select("event_id", "event_type"), "event_id", ["event_type"], missing="-")
    counts = pairs.groupBy(F.col("prev_event_type").alias("prev"), F.col("event_type").alias("cur")).agg(F.count("*").alias("n"))
    return counts.groupBy(F.when(F.col("n") < 200, "rare").otherwise(F.concat("prev", F.lit(">"), "cur")).alias("context")).agg(F.sum("n").alias("n"))


@query(
    "i20_best_predictor_per_group",
    "WITH x AS (SELECT event_type, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (ORDER BY event_id), 0) AS a, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS b FROM events), c AS (SELECT event_type, CAST(sum(greatest(1, ceil((CASE WHEN a = 0 THEN 0 ELSE length(bin(xor(a * 2, a >> 63))) END) / 7.0))) AS BIGINT) AS by_row, CAST(sum(greatest(1, ceil((CASE WHEN b = 0 THEN 0 ELSE length(bin(xor(b * 2, b >> 63))) END) / 7.0))) AS BIGINT) AS by_type FROM x GROUP BY event_type) SELECT *, CASE WHEN by_row <= by_type THEN 'by_row' ELSE 'by_type' END AS best FROM c",
)
def i20(spark, d):
    rows = i18(spark, d).join(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    sizes = rows.groupBy("event_type").agg(*(F.sum(varint_bytes(zigzag(F.col(c)))).alias(c) for c in ("by_row", "by_type")))
    return sizes.withColumn("best", F.when(F.col("by_row") <= F.col("by_type"), "by_row").otherwise("by_type"))


@query("i21_predicted_index", "SELECT doc_id, xor((n - p) * 2, (n - p) >> 63) AS residual FROM (SELECT doc_id, octet_length(encode(text)) AS n, (n_chars * 9 + 40) // 8 AS p FROM documents)")
def i21(spark, d):
    n, p = F.octet_length("text").cast("long"), F.floor((F.col("n_chars") * 9 + 40) / 8)
    return table(spark, d, "documents").select("doc_id", zigzag(n - p).alias("residual"))
