"""Matches and block sorting: back references, rotations, ranks, runs, and rows out of packed blocks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.columns import table
from ..registry import query
from .integers import runs

SEQUENCE = "array<struct<lit: binary, len: int, off: int>>"
#: What a task holds of its results at a time, and what a part costs as Python objects.
BATCH_BYTES = 1 << 21
PART_BYTES = 400


def earlier(data: bytes, least: int) -> memoryview:
    """For each place the nearest one before it with the same ``least`` bytes, or -1; four bytes a place."""
    n = max(0, len(data) - least + 1)
    byte = np.frombuffer(data, np.uint8)
    code = np.zeros(n, np.uint64)
    for k in range(least):
        if k and not k % 4:  # room for four bytes more
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        code = code << np.uint64(8) | byte[k : k + n]
    order = np.argsort(code, kind="stable").astype(np.int32)
    same = code[order[1:]] == code[order[:-1]]
    out = np.full(n, -1, np.int32)
    out[order[1:][same]] = order[:-1][same]
    return memoryview(out)


def references(data: bytes, lazy: bool = True, least: int = 4, chain: int = 16) -> list[tuple[bytes, int, int]]:
    """(literal run, copy length, distance) triples; ``lazy`` puts a match off if the next byte begins a longer one."""
    before = earlier(data, least)

    def longest(i: int) -> tuple[int, int]:
        """The longest copy from the last ``chain`` places with the same bytes, of equally long ones the nearest."""
        most, best, back, j = min(255, len(data) - i), 0, 0, before[i]
        for _ in range(chain):
            if j < 0 or best >= most:
                break
            if not best or data[j : j + best + 1] == data[i : i + best + 1]:
                k = best or least
                while k + 16 <= most and data[j + k : j + k + 16] == data[i + k : i + k + 16]:
                    k += 16
                while k < most and data[j + k] == data[i + k]:
                    k += 1
                best, back = k, i - j
            j = before[j]
        return best, back

    out, i, start = [], 0, 0
    ahead = None
    while i < len(before):
        size, off = ahead or longest(i)
        ahead = None
        if size and lazy and i + 1 < len(before):
            ahead = longest(i + 1)
            if ahead[0] > size:
                size = 0
        if not size:
            i += 1
            continue
        out.append((data[start:i], size, off))
        i += size
        start, ahead = i, None
    out.append((data[start:], 0, 0))
    return out


def replay(parts: list) -> bytes:
    """The bytes that a sequence of ``references`` stands for; a copy from before the beginning is an error."""
    out = bytearray()
    for lit, size, off in parts:
        out += lit
        if size:
            if not 0 < off <= len(out):
                raise ValueError("a copy from before the beginning")
            piece = out[len(out) - off : len(out) - off + size]
            out += (piece * -(-size // len(piece)))[:size]
    return bytes(out)


def _rows_out(batches: Iterator[pa.RecordBatch], change: Callable, column: str, kind: pa.DataType, cost: Callable) -> Iterator[pa.RecordBatch]:
    """The first column of each row changed, the others kept; a batch goes out as soon as its values cost BATCH_BYTES."""
    for batch in batches:
        held, room, start = [], 0, 0
        for at, v in enumerate(batch.column(0), 1):
            held.append(None if not v.is_valid else change(v.as_py()))
            room += 0 if held[-1] is None else cost(held[-1])
            if room >= BATCH_BYTES or at == batch.num_rows:
                kept = [c.slice(start, at - start) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(held, kind), *kept], [column, *batch.schema.names[1:]])
                held, room, start = [], 0, at


def _changed(df: DataFrame, value: str, change: Callable, column: str, kind: str, cost: Callable) -> DataFrame:
    """``df`` with ``column`` made from ``value``, which goes."""
    kept = [c for c in df.columns if c != value]
    arrow = to_arrow_type(_parse_datatype_string(kind))
    schema = StructType([StructField(column, _parse_datatype_string(kind)), *(df.schema[c] for c in kept)])
    return df.select(value, *kept).mapInArrow(lambda batches: _rows_out(batches, change, column, arrow, cost), schema).select(*kept, column)


def matched(df: DataFrame, row_id: str, value: str, lazy: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, parts): each value as literals and copies; a value is a block of its own, null stays null."""
    cut = lambda v: [{"lit": a, "len": n, "off": o} for a, n, o in references(v, lazy)]
    rows = df.select(row_id, *keep, F.col(value).cast("binary").alias("__value"))
    return _changed(rows, "__value", cut, "parts", SEQUENCE, lambda parts: PART_BYTES * len(parts))


def unmatched(df: DataFrame, row_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, value) from ``matched``."""
    whole = lambda parts: replay([(p["lit"], p["len"], p["off"]) for p in parts])
    return _changed(df.select(row_id, *keep, "parts"), "parts", whole, "value", "binary", len)


@query("z1_lazy_matches_roundtrip", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def z1(spark, d):
    parts = matched(table(spark, d, "conversations"), "conv_id", "text", keep=("turn",))
    return unmatched(parts, "conv_id", keep=("turn",)).select("conv_id", "turn", F.sha2("value", 256).alias("digest"))


@query("z3_learned_symbol_costs", "WITH c AS (SELECT substring(url, CAST(i AS INT), 1) AS sym FROM (SELECT url, unnest(range(1, length(url) + 1)) AS i FROM pages)), n AS (SELECT sym, count(*) AS n FROM c GROUP BY sym) SELECT sym, round(-log2(n / (SELECT sum(n) FROM n)), 5) AS bits FROM n")
def z3(spark, d):
    n = table(spark, d, "pages").select(F.explode(F.split("url", "")).alias("sym")).groupBy("sym").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0]
    return n.select("sym", F.round(-F.log2(F.col("n") / F.lit(total)), 5).alias("bits"))


@query("z5_sequence_classes")
def z5(spark, d):
    parts = matched(table(spark, d, "pages"), "page_id", "html").select(F.explode("parts").alias("p"))
    size = F.when(F.col("p.len") == 0, "none").when(F.col("p.len") < 16, "short").otherwise("long")
    far = F.when(F.col("p.off") == 0, "none").when(F.col("p.off") < 256, "near").otherwise("far")
    return parts.groupBy(size.alias("length_class"), far.alias("offset_class")).agg(F.count("*").alias("n"), F.sum(F.octet_length("p.lit")).alias("literal_bytes"))


@query("z6_match_verification", "SELECT count(*) AS n, count(*) AS n_equal FROM pages")
def z6(spark, d):
    back = unmatched(matched(table(spark, d, "pages"), "page_id", "html", keep=("html",)), "page_id", keep=("html",))
    return back.agg(F.count("*").alias("n"), F.count(F.when(F.col("html").cast("binary").eqNullSafe(F.col("value")), 1)).alias("n_equal"))


def rotations_sorted(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, last, primary): the last column of each value's sorted rotations and the place of the value itself."""
    n = F.length(text)
    at = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("i")
    turned = df.select(row_id, text, at).select(row_id, "i", F.concat(F.substring(F.col(text), F.col("i") + 1, n), F.substring(F.col(text), F.lit(1), F.col("i"))).alias("r"))
    rows = turned.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("r", "i"))).alias("rs"))
    return rows.select(row_id, F.array_join(F.transform("rs", lambda x: F.right(x["r"], F.lit(1))), "").alias("last"), (F.array_position(F.transform("rs", lambda x: x["i"]), 0) - 1).alias("primary"))


@query(
    "z7_block_sort",
    "WITH r AS (SELECT p_partkey, i, substring(p_name, CAST(i + 1 AS INT)) || substring(p_name, 1, CAST(i AS INT)) AS r FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS i FROM part)), o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY r, i) - 1 AS k FROM r) SELECT p_partkey, string_agg(right(r, 1), '' ORDER BY k) AS last, min(CASE WHEN i = 0 THEN k END) AS \"primary\" FROM o GROUP BY p_partkey",
)
def z7(spark, d):
    return rotations_sorted(table(spark, d, "part"), "p_partkey", "p_name")


@query("z8_block_sort_inverse", "SELECT p_partkey, p_name AS text FROM part")
def z8(spark, d):
    """Rank and occurrence give each place its successor; following them from the primary row spells the value."""
    rows = rotations_sorted(table(spark, d, "part"), "p_partkey", "p_name")
    w = Window.partitionBy("p_partkey")
    chars = rows.select("p_partkey", "primary", F.posexplode(F.split("last", "")).alias("k", "c"))
    place = chars.withColumn("first", F.row_number().over(w.orderBy("c", "k")) - 1)
    tables = place.groupBy("p_partkey", "primary").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "k", "c"))), lambda x: F.struct(x["k"], x["c"])).alias("t"))
    start = F.struct(F.col("primary").cast("int").alias("k"), F.lit("").alias("s"))
    walk = F.aggregate("t", start, lambda acc, _: F.struct(F.element_at("t", acc["k"] + 1)["k"].alias("k"), F.concat(acc["s"], F.element_at("t", acc["k"] + 1)["c"]).alias("s")))
    return tables.select("p_partkey", walk["s"].alias("text"))


@query("z9_half_front_ranks")
def z9(spark, d):
    """Each symbol's place in a list in which it then moves half-way to the front; a fold over the value."""
    alphabet = F.array_sort(F.array_distinct(F.split("last", "")))
    rows = rotations_sorted(table(spark, d, "part"), "p_partkey", "p_name").withColumn("alphabet", alphabet)

    def step(acc, c):
        at = F.array_position(acc["order"], c).cast("int")
        to = (F.floor((at - 1) / 2)).cast("int")
        without = F.array_remove(acc["order"], c)
        moved = F.concat(F.slice(without, F.lit(1), to), F.array(c), F.slice(without, to + 1, F.size(without)))
        return F.struct(moved.alias("order"), F.concat(acc["ranks"], F.array(at - 1)).alias("ranks"))

    start = F.struct(F.col("alphabet").alias("order"), F.array().cast("array<int>").alias("ranks"))
    ranks = F.aggregate(F.split("last", ""), start, step)["ranks"]
    return rows.select(F.explode(ranks).alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))


@query("z10_zero_runs", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS v FROM orders), y AS (SELECT *, CASE WHEN lag(v) OVER (ORDER BY o_orderkey) = v THEN 0 ELSE 1 END AS new FROM x), r AS (SELECT v, sum(new) OVER (ORDER BY o_orderkey) AS run FROM y) SELECT n, count(*) AS n_runs, length(bin(n + 1)) - 1 AS digits FROM (SELECT run, count(*) AS n FROM r WHERE v = 0 GROUP BY run) GROUP BY n")
def z10(spark, d):
    flags = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("v"))
    zero = runs(flags, "o_orderkey", "v").where("v = 0").groupBy("n").agg(F.count("*").alias("n_runs"))
    return zero.withColumn("digits", (F.length(F.bin(F.col("n") + 1)) - 1).cast("long"))


def packed_blocks(df: DataFrame, row_id: str, value: str, size: int = 1000) -> DataFrame:
    """(block, offsets, packed): rows of a block joined and compressed."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [bytes(v) for v in pdf.sort_values(row_id)[value]]
        ends = pd.Series(map(len, rows)).cumsum().tolist()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "offsets": [[0, *ends]], "packed": [zlib.compress(b"".join(rows))]})

    return df.select(F.floor(F.col(row_id) / size).alias("block"), row_id, F.col(value).cast("binary").alias(value)).groupBy("block").applyInPandas(pack, "block long, offsets array<long>, packed binary")


def rows_from_blocks(blocks: DataFrame, ids: DataFrame, row_id: str, size: int = 1000) -> DataFrame:
    """(row_id, value) of the wanted rows; only their blocks are unpacked.  Ids are dense."""
    wanted = ids.groupBy(F.floor(F.col(row_id) / size).alias("block")).agg(F.collect_set(row_id).alias("ids"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, offsets, packed, rows in zip(batch["block"], batch["offsets"], batch["packed"], batch["ids"], strict=True):
                raw = zlib.decompress(packed)
                at = sorted(int(r) for r in rows)
                inner = [r - block * size for r in at]
                yield pd.DataFrame({row_id: at, "value": [raw[offsets[k] : offsets[k + 1]] for k in inner]})

    return blocks.join(wanted, "block").mapInPandas(unpack, f"{row_id} long, value binary")


@query("z11_rows_from_packed_blocks", "SELECT c_custkey, c_name AS value FROM customer WHERE c_custkey % 97 = 5")
def z11(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    found = rows_from_blocks(packed_blocks(customers, "c_custkey", "c_name"), customers.where("c_custkey % 97 = 5").select("c_custkey"), "c_custkey")
    return found.select("c_custkey", F.col("value").cast("string").alias("value"))
