"""Entropy coding: sizes by SQL, code lengths and codes for bounded alphabets, control codecs by block."""

from __future__ import annotations

import bz2
import heapq
import lzma
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import table
from ..registry import query


def byte_counts(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, sym, n): how often each byte occurs; the hex digits of a value are cut in pairs."""
    pairs = F.regexp_extract_all(F.hex(F.col(column).cast("binary")), F.lit(".."), F.lit(0))
    each = df.select(group, F.explode(pairs).alias("h"))
    return each.groupBy(group, F.conv("h", 16, 10).cast("int").alias("sym")).agg(F.count("*").alias("n"))


_BYTES = "b AS (SELECT p_brand AS g, CAST(ascii(substring(p_name, CAST(i AS INT), 1)) AS INTEGER) AS sym FROM (SELECT p_brand, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)), c AS (SELECT g, sym, count(*) AS n FROM b GROUP BY ALL)"


def _part_counts(spark, d) -> DataFrame:
    return byte_counts(table(spark, d, "part").select(F.col("p_brand").alias("g"), "p_name"), "g", "p_name")


def entropy(counts: DataFrame, group: str = "g") -> DataFrame:
    """(group, n, bits): the Shannon bound of each group's symbols."""
    total = counts.groupBy(group).agg(F.sum("n").alias("total"))
    return counts.join(total, group).groupBy(group).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.log2(F.col("total") / F.col("n"))), 4).alias("bits"))


@query("e1_entropy", f"WITH {_BYTES}, t AS (SELECT g, sum(n) AS total FROM c GROUP BY g) SELECT g, CAST(sum(n) AS BIGINT) AS n, round(sum(n * log2(total / n)), 4) AS bits FROM c JOIN t USING (g) GROUP BY g")
def e1(spark, d):
    return entropy(_part_counts(spark, d))


def huffman_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Code lengths of at most ``limit`` bits; counts are raised from below until the longest fits."""
    floor = 1
    while True:
        heap = [(max(n, floor), s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        lengths = dict.fromkeys(counts, 0 if len(counts) > 1 else 1)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths.values()) <= limit:
            return lengths
        floor = floor * 2


def package_merge(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    leaves = sorted((n, (s,)) for s, n in counts.items())
    merged: list[tuple[int, tuple]] = []
    for _ in range(limit):
        merged = sorted(leaves + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2], strict=False)])
    lengths = dict.fromkeys(counts, 0)
    for _, symbols in merged[: 2 * len(counts) - 2]:
        for s in symbols:
            lengths[s] += 1
    return lengths


def code_lengths(counts: DataFrame, limit: int = 16, group: str = "g", optimal: bool = False) -> DataFrame:
    """(group, sym, n, len): one group of counts (at most 256 symbols) at a time."""
    make = package_merge if optimal else huffman_lengths

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = make(dict(zip(pdf["sym"].tolist(), pdf["n"].tolist(), strict=True)), limit)
        return pdf.assign(len=pdf["sym"].map(lengths).astype("int32"))

    kind = counts.schema[group].dataType.simpleString()
    return counts.select(group, "sym", "n").groupBy(group).applyInPandas(of_group, f"{group} {kind}, sym int, n long, len int")


@query("e2_huffman_kraft", f"WITH {_BYTES} SELECT g, count(*) AS n_symbols, 1.0 AS kraft, true AS within_limit FROM c GROUP BY g")
def e2(spark, d):
    lengths = code_lengths(_part_counts(spark, d))
    return lengths.groupBy("g").agg(F.count("*").alias("n_symbols"), F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"), (F.max("len") <= 16).alias("within_limit"))


@query("e2b_package_merge", f"WITH {_BYTES} SELECT g, count(*) AS n_symbols, 1.0 AS kraft, true AS no_longer FROM c GROUP BY g")
def e2b(spark, d):
    counts = _part_counts(spark, d)
    best = code_lengths(counts, 6, optimal=True)
    plain = code_lengths(counts, 6).groupBy("g").agg(F.sum(F.col("n") * F.col("len")).alias("plain"))
    total = best.groupBy("g").agg(F.count("*").alias("n_symbols"), F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"), F.sum(F.col("n") * F.col("len")).alias("bits"))
    return total.join(plain, "g").select("g", "n_symbols", "kraft", (F.col("bits") <= F.col("plain")).alias("no_longer"))


def canonical_codes(lengths: DataFrame, group: str = "g") -> DataFrame:
    """(group, sym, n, len, code): codes in the order of length, then symbol.

    A code is what precedes it in that order, counted in units of its own length.
    """
    w = Window.partitionBy(group).orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)
    units = F.coalesce(F.sum(F.pow(F.lit(2), 32 - F.col("len")).cast("long")).over(w), F.lit(0))
    return lengths.withColumn("units", units).withColumn("code", F.floor(F.col("units") / F.pow(F.lit(2), 32 - F.col("len"))).cast("long")).drop("units")


_LEN = "l AS (SELECT g, sym, n, CASE WHEN k = 1 THEN 1 ELSE CAST(ceil(log2(k)) AS INTEGER) END AS len FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM c))"


@query("e3_canonical_codes", f"WITH {_BYTES}, {_LEN} SELECT g, sym, len, row_number() OVER (PARTITION BY g ORDER BY sym) - 1 AS code FROM l")
def e3(spark, d):
    counts = _part_counts(spark, d)
    k = F.count("*").over(Window.partitionBy("g"))
    fixed = counts.withColumn("len", F.when(k == 1, 1).otherwise(F.ceil(F.log2(k))).cast("int"))
    return canonical_codes(fixed).select("g", "sym", "len", "code")


@query("e4_encoded_bits", f"WITH {_BYTES}, {_LEN} SELECT g, CAST(sum(n * len) AS BIGINT) AS bits FROM l GROUP BY g")
def e4(spark, d):
    counts = _part_counts(spark, d)
    k = F.count("*").over(Window.partitionBy("g"))
    fixed = counts.withColumn("len", F.when(k == 1, 1).otherwise(F.ceil(F.log2(k))))
    return fixed.groupBy("g").agg(F.sum(F.col("n") * F.col("len")).cast("long").alias("bits"))


@query("e3b_huffman_codes")
def e3b(spark, d):
    """Canonical codes of the Huffman lengths of each group."""
    return canonical_codes(code_lengths(_part_counts(spark, d))).select("g", "sym", "n", "len", "code")


@query("e4b_huffman_bits")
def e4b(spark, d):
    return code_lengths(_part_counts(spark, d)).groupBy("g").agg(F.sum(F.col("n") * F.col("len")).cast("long").alias("bits"))


def normalised(counts: DataFrame, bits: int = 12, group: str = "g") -> DataFrame:
    """(group, sym, n, freq): frequencies that sum to 2^bits, none zero; the largest remainders are rounded up."""
    w = Window.partitionBy(group)
    scale = F.col("n") * F.lit(1 << bits)
    total = F.sum("n").over(w)
    base = F.greatest(F.floor(scale / total), F.lit(1))
    rows = counts.withColumn("total", total).withColumn("base", base.cast("long")).withColumn("rest", F.pmod(scale, F.col("total")))
    need = F.lit(1 << bits) - F.sum("base").over(w)
    ranked = rows.withColumn("need", need).withColumn("up", F.row_number().over(w.orderBy(F.desc("rest"), "sym")))
    # Where raising rare symbols to one took too much, the most frequent give it back.
    ranked = ranked.withColumn("down", F.row_number().over(w.orderBy(F.desc("base"), "sym")))
    freq = F.when((F.col("need") > 0) & (F.col("up") <= F.col("need")), F.col("base") + 1).when((F.col("need") < 0) & (F.col("down") == 1), F.col("base") + F.col("need")).otherwise(F.col("base"))
    return ranked.select(group, "sym", "n", freq.cast("long").alias("freq"))


@query("e5_normalised_frequencies", f"WITH {_BYTES} SELECT g, count(*) AS n_symbols, 4096 AS total, true AS positive FROM c GROUP BY g")
def e5(spark, d):
    return normalised(_part_counts(spark, d)).groupBy("g").agg(F.count("*").alias("n_symbols"), F.sum("freq").alias("total"), (F.min("freq") > 0).alias("positive"))


@query(
    "e9_order1_entropy",
    "WITH b AS (SELECT substring(p_name, CAST(i - 1 AS INT), 1) AS a, substring(p_name, CAST(i AS INT), 1) AS b FROM (SELECT p_name, unnest(range(2, length(p_name) + 1)) AS i FROM part)), c AS (SELECT a, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT a, sum(n) AS total FROM c GROUP BY a) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * log2(total / n)), 4) AS bits FROM c JOIN t USING (a)",
)
def e9(spark, d):
    chars = table(spark, d, "part").select(F.split("p_name", "").alias("s"))
    pairs = chars.select(F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("a"), F.slice("s", F.lit(2), F.size("s") - 1).alias("b"))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    total = counts.groupBy("a").agg(F.sum("n").alias("total"))
    return counts.join(total, "a").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.log2(F.col("total") / F.col("n"))), 4).alias("bits"))


def control_codecs() -> dict:
    """Name to (compress, decompress) of the general codecs at hand."""
    found = {
        **{f"zlib-{k}": (lambda b, k=k: zlib.compress(b, k), zlib.decompress) for k in (1, 6, 9)},
        **{f"bzip2-{k}": (lambda b, k=k: bz2.compress(b, k), bz2.decompress) for k in (1, 9)},
        **{f"xz-{k}": (lambda b, k=k: lzma.compress(b, preset=k), lzma.decompress) for k in (0, 6)},
        "raw": (bytes, bytes),
    }
    try:
        import zstandard
    except ImportError:
        return found
    return found | {f"zstd-{k}": (lambda b, k=k: zstandard.ZstdCompressor(level=k).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b)) for k in (1, 3, 19)}


def compressed(df: DataFrame, row_id: str, value: str, methods: list[str], rows_a_block: int = 256) -> DataFrame:
    """(method, block, n_rows, raw_bytes, packed_bytes, digest): blocks of rows by each method, with the SHA-256 of what comes back."""
    import hashlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(bytes(v) for v in pdf.sort_values(row_id)[value])
        codecs = control_codecs()
        rows = []
        for m in methods:
            pack, unpack = codecs[m]
            packed = pack(raw)
            rows.append((m, int(pdf["block"].iloc[0]), len(pdf), len(raw), len(packed), hashlib.sha256(unpack(packed)).hexdigest()))
        return pd.DataFrame(rows, columns=["method", "block", "n_rows", "raw_bytes", "packed_bytes", "digest"])

    blocks = df.select(F.floor(F.col(row_id) / rows_a_block).alias("block"), row_id, F.col(value).cast("binary").alias(value))
    return blocks.groupBy("block").applyInPandas(run, "method string, block long, n_rows long, raw_bytes long, packed_bytes long, digest string")


@query(
    "e10_control_codecs",
    "WITH b AS (SELECT p_partkey // 256 AS block, string_agg(p_name, '' ORDER BY p_partkey) AS v, count(*) AS n FROM part GROUP BY 1) SELECT m AS method, block, n AS n_rows, octet_length(encode(v)) AS raw_bytes, sha256(v) AS digest FROM b, (SELECT unnest(['zlib-6', 'bzip2-9', 'xz-0', 'zstd-3', 'raw']) AS m)",
)
def e10(spark, d):
    return compressed(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", ["zlib-6", "bzip2-9", "xz-0", "zstd-3", "raw"]).drop("packed_bytes")


@query("e11_checksums", "SELECT page_id, sha256(html) AS sha256, md5(html) AS md5 FROM pages")
def e11(spark, d):
    raw = F.col("html").cast("binary")
    return table(spark, d, "pages").select("page_id", F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"))
