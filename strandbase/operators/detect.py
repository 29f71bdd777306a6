"""Domain detectors: a predicate over a whole column, a typed projection, and its exact inverse.

``Detector.report`` counts the rows that match and the rows that the inverse gives
back byte for byte; a column is of the domain if both are all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import table
from ..registry import query


@dataclass(frozen=True)
class Detector:
    """``pattern`` must match whole values; ``decompose`` gives typed columns by name, ``recompose`` the value from them."""

    name: str
    pattern: str
    decompose: Callable[[Column], dict[str, Column]]
    recompose: Callable[[], Column]

    def project(self, df: DataFrame, column: str) -> DataFrame:
        matched = F.col(column).rlike(self.pattern)
        typed = {k: F.when(matched, v) for k, v in self.decompose(F.col(column)).items()}
        return df.withColumn("matched", matched).withColumns(typed)

    def report(self, df: DataFrame, column: str) -> DataFrame:
        back = self.recompose()
        return self.project(df, column).agg(
            F.count("*").alias("n_rows"),
            F.count(F.when(F.col("matched"), 1)).alias("n_match"),
            F.count(F.when(F.col("matched") & (back == F.col(column)), 1)).alias("n_roundtrip"),
        )


def prefix_digits(prefix: str, width: int) -> Detector:
    return Detector("prefix digits", f"^{prefix}[0-9]{{{width}}}$", lambda c: {"number": F.try_to_number(F.substring(c, len(prefix) + 1, width), F.lit("9" * width)).cast("long")}, lambda: F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), width, "0")))


DNA = Detector(
    "dna",
    "^[acgt]{9}$",
    lambda c: {"code": F.conv(F.translate(c, "acgt", "0123"), 4, 10).cast("long")},
    lambda: F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 4), 9, "0"), "0123", "acgt"),
)
HEX = Detector("hex", "^(0|[1-9A-F][0-9A-F]{0,7})$", lambda c: {"number": F.conv(c, 16, 10).cast("long")}, lambda: F.hex("number"))
COORDINATES = Detector(
    "coordinates",
    r"^\((-?[0-9]+)\.([0-9]+), (-?[0-9]+)\.([0-9]+)\)$",
    lambda c: {k: F.regexp_extract(c, r"^\((-?[0-9]+)\.([0-9]+), (-?[0-9]+)\.([0-9]+)\)$", i) for i, k in enumerate(("lat", "lat_digits", "lon", "lon_digits"), 1)},
    lambda: F.concat(F.lit("("), "lat", F.lit("."), "lat_digits", F.lit(", "), "lon", F.lit("."), "lon_digits", F.lit(")")),
)
EMAIL = Detector(
    "email", r"^.+@[^@]+$", lambda c: {"local": F.regexp_extract(c, "^(.+)@([^@]+)$", 1), "domain": F.regexp_extract(c, "^(.+)@([^@]+)$", 2)}, lambda: F.concat("local", F.lit("@"), "domain")
)

_MD5 = "md5('x' || o_orderkey)"


def _md5() -> Column:
    return F.md5(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).cast("binary"))


def _orders(spark, d, column: Column) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", column.alias("value"))


@query("d1_prefix_digits", "SELECT count(*) AS n_rows, count(CASE WHEN regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 1 END) AS n_match, count(CASE WHEN 'Customer#' || lpad(CAST(CAST(substring(c_name, 10, 9) AS BIGINT) AS VARCHAR), 9, '0') = c_name THEN 1 END) AS n_roundtrip FROM customer")
def d1(spark, d):
    return prefix_digits("Customer#", 9).report(table(spark, d, "customer"), "c_name")


_DNA_SQL = f"list_reduce(list_transform(range(1, 10), lambda i: substring('acgt', CAST(1 + strpos('0123456789abcdef', substring({_MD5}, i, 1)) % 4 AS INT), 1)), lambda a, b: a || b)"


@query(
    "d2_dna_two_bits",
    f"WITH v AS (SELECT o_orderkey, {_DNA_SQL} AS value FROM orders) SELECT o_orderkey, CAST(list_reduce(list_transform(range(1, 10), lambda i: strpos('acgt', substring(value, i, 1)) - 1), lambda a, b: a * 4 + b) AS BIGINT) AS code FROM v",
)
def d2(spark, d):
    letters = F.translate(F.substring(_md5(), 1, 9), "0123456789abcdef", "cgtacgtacgtacgta")
    return DNA.project(_orders(spark, d, letters), "value").select("o_orderkey", "code")


@query(
    "d3_hex_uint32",
    f"SELECT o_orderkey, CAST(list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substring({_MD5}, i, 1)) - 1), lambda a, b: a * 16 + b) AS BIGINT) AS number, true AS exact FROM orders",
)
def d3(spark, d):
    value = F.upper(F.regexp_replace(F.substring(_md5(), 1, 8), "^0+(?=.)", ""))
    return HEX.project(_orders(spark, d, value), "value").select("o_orderkey", "number", (F.hex("number") == F.col("value")).alias("exact"))


def positional_mask(df: DataFrame, column: str) -> DataFrame:
    """(pos, n_distinct, least): how many characters occur at each position of a fixed-width column."""
    each = df.select(F.posexplode(F.split(column, "")).alias("pos", "ch"))
    met = each.select((F.col("pos") + 1).alias("pos"), "ch").distinct()  # hashed; a least string beside the rows would sort them all
    return met.groupBy("pos").agg(F.count("ch").alias("n_distinct"), F.min("ch").alias("least"))


@query("d4_positional_template", f"WITH v AS (SELECT substring({_MD5}, 1, 8) || '-4fix-' || substring({_MD5}, 9, 4) AS u FROM orders) SELECT CAST(i AS INTEGER) AS pos, count(DISTINCT substring(u, CAST(i AS INT), 1)) AS n_distinct, min(substring(u, CAST(i AS INT), 1)) AS least FROM v, (SELECT unnest(range(1, 19)) AS i) GROUP BY i")
def d4(spark, d):
    value = F.concat(F.substring(_md5(), 1, 8), F.lit("-4fix-"), F.substring(_md5(), 9, 4))
    return positional_mask(_orders(spark, d, value), "value")


def gcd_of(df: DataFrame, column: str) -> DataFrame:
    """The greatest common divisor of a column's non-negative integers: folded in each task, then over tasks."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            total = int(np.gcd(total, np.gcd.reduce(batch[column].to_numpy(), initial=0)))
        yield pd.DataFrame({"g": [total]})

    partial = df.select(column).mapInPandas(fold, "g long")
    return partial.agg(F.aggregate(F.collect_set("g"), F.lit(0).cast("long"), _gcd).alias("gcd"))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm on two integers; 96 steps suffice for 64 bits."""
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"]))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step)["a"]


@query("d5_uuid_v1_fields", "SELECT min(t) AS base, max(t) AS top, bit_and(t) AS all_bits, bit_or(t) AS any_bits FROM (SELECT o_orderkey * 40 + 1000 AS t FROM orders)")
def d5(spark, d):
    t = table(spark, d, "orders").select((F.col("o_orderkey") * 40 + 1000).alias("t"))
    return t.agg(F.min("t").alias("base"), F.max("t").alias("top"), F.bit_and("t").alias("all_bits"), F.bit_or("t").alias("any_bits"))


def _hex(v: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(v), width, "0"))


def _digits(c: Column, *cuts: tuple[int, int]) -> Column:
    """The number that the hex digits at (place, length) make; at most 62 bits."""
    return F.conv(F.concat(*(F.substring(c, a, n) for a, n in cuts)), 16, 10).cast("long")


def _uuid_v1(t: Column, clock: Column, node: Column) -> Column:
    """The text of a version-1 UUID from its 60-bit time, 14-bit clock sequence and 48-bit node."""
    low, mid, high = t.bitwiseAND(0xFFFFFFFF), F.shiftright(t, 32).bitwiseAND(0xFFFF), F.shiftright(t, 48)
    return F.concat_ws("-", _hex(low, 8), _hex(mid, 4), F.concat(F.lit("1"), _hex(high, 3)), _hex(clock + 0x8000, 4), _hex(node, 12))


UUID_V1 = Detector(
    "uuid v1",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-1[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z",
    lambda c: {"time": _digits(c, (16, 3), (10, 4), (1, 8)), "clock": _digits(c, (20, 4)).bitwiseAND(0x3FFF), "node": _digits(c, (25, 12))},
    lambda: _uuid_v1(F.col("time"), F.col("clock"), F.col("node")),
)


@query("d5b_uuid_v1_detector")
def d5b(spark, d):
    """Strings made of orders, parsed and given back: counts, base and step of the time, masks of what follows it."""
    made = _uuid_v1(F.col("o_orderkey") * 40 + 131_000_000_000_001_000, F.col("o_custkey").cast("long").bitwiseAND(0x3FFF), F.col("o_orderkey") * 65_537 + 0x0242AC110002)
    rows = _orders(spark, d, made)
    parsed = UUID_V1.project(rows, "value").where("matched")
    suffix = F.shiftleft("clock", 48).bitwiseOR(F.col("node"))
    fields = parsed.agg(F.min("time").alias("base"), F.max("time").alias("top"), F.bit_and(suffix).alias("all_bits"), F.bit_or(suffix).alias("any_bits"))
    base = parsed.agg(F.min("time").alias("base"))
    step = gcd_of(parsed.crossJoin(F.broadcast(base)).select((F.col("time") - F.col("base")).alias("t")), "t").withColumnRenamed("gcd", "step")
    return UUID_V1.report(rows, "value").crossJoin(fields).crossJoin(step)


@query("d5g_gcd", "SELECT CAST(list_reduce(list(DISTINCT t), lambda a, b: gcd(a, b)) AS BIGINT) AS gcd FROM (SELECT o_orderkey * 40 AS t FROM orders)")
def d5g(spark, d):
    return gcd_of(table(spark, d, "orders").select((F.col("o_orderkey") * 40).alias("t")), "t")


@query(
    "d6_uuid_v4_split",
    f"WITH v AS (SELECT o_orderkey, substring({_MD5}, 1, 8) || '-' || substring({_MD5}, 9, 4) || '-' || substring({_MD5}, 13, 4) || '-' || substring({_MD5}, 17, 4) || '-' || substring({_MD5}, 21, 12) AS u FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(u, '^.{{14}}4.{{4}}[89ab]') THEN 'packed' ELSE 'exception' END AS part, CASE WHEN regexp_matches(u, '^.{{14}}4.{{4}}[89ab]') THEN replace(substring(u, 1, 14) || substring(u, 16), '-', '') ELSE u END AS stored FROM v",
)
def d6(spark, d):
    u = F.concat_ws("-", F.substring(_md5(), 1, 8), F.substring(_md5(), 9, 4), F.substring(_md5(), 13, 4), F.substring(_md5(), 17, 4), F.substring(_md5(), 21, 12))
    rows = _orders(spark, d, u)
    v4 = F.col("value").rlike("^.{14}4.{4}[89ab]")
    packed = F.replace(F.concat(F.substring("value", 1, 14), F.substring("value", 16, 100)), F.lit("-"), F.lit(""))
    return rows.select("o_orderkey", F.when(v4, "packed").otherwise("exception").alias("part"), F.when(v4, packed).otherwise(F.col("value")).alias("stored"))


_COORD = "'(40.' || CAST(o_orderkey * 7919 % 1000000 AS VARCHAR) || ', -73.' || CAST(o_orderkey * 104729 % 10000000 AS VARCHAR) || ')'"


def _coordinates(spark, d):
    k = F.col("o_orderkey")
    return _orders(spark, d, F.concat(F.lit("(40."), (k * 7919 % 1_000_000).cast("string"), F.lit(", -73."), (k * 104_729 % 10_000_000).cast("string"), F.lit(")")))


@query("d7_coordinates_exact", f"SELECT o_orderkey, '40' AS lat, CAST(o_orderkey * 7919 % 1000000 AS VARCHAR) AS lat_digits, '-73' AS lon, CAST(o_orderkey * 104729 % 10000000 AS VARCHAR) AS lon_digits, {_COORD} AS value FROM orders")
def d7(spark, d):
    rows = COORDINATES.project(_coordinates(spark, d), "value")
    return rows.select("o_orderkey", "lat", "lat_digits", "lon", "lon_digits", COORDINATES.recompose().alias("value"))


@query(
    "d8_coordinates_binary64",
    "SELECT count(*) AS n_rows, count(CASE WHEN t = '40.0' OR NOT regexp_matches(t, '0$') THEN 1 END) AS n_exact FROM (SELECT '40.' || CAST(o_orderkey * 7919 % 1000000 AS VARCHAR) AS t FROM orders)",
)
def d8(spark, d):
    text = F.concat("lat", F.lit("."), "lat_digits")
    rows = COORDINATES.project(_coordinates(spark, d), "value").withColumn("same", text.cast("double").cast("string") == text)
    return rows.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("same"), 1)).alias("n_exact"))


def skeletons(df: DataFrame, column: str, top: int = 64) -> DataFrame:
    """(skeleton, n, score, rank): values with digit runs masked; the ``top`` by rows times constant bytes."""
    masked = df.select(F.regexp_replace(column, "[0-9]+", "#").alias("skeleton")).groupBy("skeleton").agg(F.count("*").alias("n"))
    scored = masked.withColumn("score", F.col("n") * F.octet_length("skeleton"))
    best = scored.orderBy(F.desc("score"), "skeleton").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "skeleton")))


@query(
    "d9_url_skeleton_topk",
    "SELECT skeleton, n, n * octet_length(encode(skeleton)) AS score, CAST(row_number() OVER (ORDER BY n * octet_length(encode(skeleton)) DESC, skeleton) AS INTEGER) AS rank FROM (SELECT regexp_replace(url, '[0-9]+', '#', 'g') AS skeleton, count(*) AS n FROM pages GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY n * octet_length(encode(skeleton)) DESC, skeleton) <= 64",
)
def d9(spark, d):
    return skeletons(table(spark, d, "pages"), "url")


@query("d10_url_host_dictionary", "SELECT h AS host, count(*) AS n, CAST(sum(octet_length(encode(url)) - octet_length(encode(h))) AS BIGINT) AS rest_bytes FROM (SELECT url, regexp_extract(url, '^[^:]+://[^/?#]*') AS h FROM pages) GROUP BY h")
def d10(spark, d):
    rows = table(spark, d, "pages").select("url", F.regexp_extract("url", "^[^:]+://[^/?#]*", 0).alias("host"))
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("url") - F.octet_length("host")).cast("long").alias("rest_bytes"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("d11_email_split", f"SELECT regexp_extract(e, '^(.+)@([^@]+)$', 2) AS domain, count(*) AS n, count(DISTINCT regexp_extract(e, '^(.+)@([^@]+)$', 1)) AS n_local FROM (SELECT unnest(regexp_extract_all(text, '{_MAIL}')) AS e FROM documents) GROUP BY ALL")
def d11(spark, d):
    mails = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("value"))
    return EMAIL.project(mails, "value").groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("local").alias("n_local"))


def dictionary_ids(df: DataFrame, column: str) -> DataFrame:
    """(value, id): distinct values numbered in their order; only distinct values are ranked."""
    from ..plans.ordered import ranked

    return ranked(df.select(F.col(column).alias("value")).distinct(), ["value"], "id").withColumn("id", F.col("id") - 1)


@query("d12_row_dictionary", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS id FROM part")
def d12(spark, d):
    part = table(spark, d, "part")
    return part.join(dictionary_ids(part, "p_name"), F.col("p_name") == F.col("value")).select("p_partkey", F.col("id").cast("long").alias("id"))


@query("d13_positional_constants", "SELECT CAST(i AS INTEGER) AS pos, count(DISTINCT substring(c_name, CAST(i AS INT), 1)) AS n_distinct, min(substring(c_name, CAST(i AS INT), 1)) AS least FROM customer, (SELECT unnest(range(1, 19)) AS i) GROUP BY i")
def d13(spark, d):
    return positional_mask(table(spark, d, "customer"), "c_name")


_SPANS = r"\d{4}-\d{2}-\d{2}|\b[0-9a-f]{8}\b|\d+"


@query("d14_typed_spans", r"SELECT doc_id, CASE WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}') THEN 'date' WHEN regexp_full_match(s, '\d+') THEN 'number' ELSE 'hex8' END AS kind, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '" + _SPANS + "')) AS s FROM documents) GROUP BY ALL")
def d14(spark, d):
    spans = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_SPANS), F.lit(0))).alias("s"))
    kind = F.when(F.col("s").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(F.col("s").rlike(r"^\d+$"), "number").otherwise("hex8")
    return spans.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("n_chars"))


@query("d15_line_ending_class", "SELECT CASE WHEN ends_with(v, chr(13) || chr(10)) THEN 'crlf' WHEN ends_with(v, chr(10)) THEN 'lf' ELSE 'none' END AS ending, count(*) AS n FROM (SELECT text || CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) ELSE '' END AS v FROM documents) GROUP BY ALL")
def d15(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("\r\n")).when(F.col("doc_id") % 3 == 1, F.lit("\n")).otherwise(F.lit(""))
    v = F.concat("text", tail)
    ending = F.when(F.endswith(v, F.lit("\r\n")), "crlf").when(F.endswith(v, F.lit("\n")), "lf").otherwise("none")
    return table(spark, d, "documents").groupBy(ending.alias("ending")).agg(F.count("*").alias("n"))


@query("d16_raw_fallback", "SELECT doc_id, sha256(text) AS digest FROM documents")
def d16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def smallest_encodings(df: DataFrame, name: str = "name", value: str = "v") -> DataFrame:
    """(name, raw, dictionary, numbered, choice): bytes of each column in three encodings; raw stays where none is smaller.

    raw: values and ends.  dictionary: distinct values and an index a row.  numbered: one prefix and four
    bytes a row, for columns that are the prefix and digits of one length throughout; else null.
    """
    parts = df.groupBy(name, value).agg(F.count("*").alias("n")).withColumn("size", F.octet_length(value) + 1).withColumn("prefix", F.regexp_extract(value, "^([^0-9]*)[0-9]{1,9}$", 1))
    fits = F.bool_and(F.col(value).rlike("^[^0-9]*[0-9]{1,9}$")) & (F.min("prefix") == F.max("prefix")) & (F.min("size") == F.max("size"))
    stats = parts.groupBy(name).agg(F.sum("n").alias("rows"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("size")).alias("raw"), F.sum("size").alias("values"), fits.alias("fits"), F.octet_length(F.min("prefix")).alias("p"))
    index = F.when(F.col("k") <= 256, 1).when(F.col("k") <= 65_536, 2).otherwise(4)
    sized = stats.select(name, F.col("raw").cast("long").alias("raw"), (F.col("values") + F.col("rows") * index).cast("long").alias("dictionary"), F.when(F.col("fits"), F.col("rows") * 4 + F.col("p") + 1).cast("long").alias("numbered"))
    least = F.least("dictionary", "numbered")
    choice = F.when(least >= F.col("raw"), "raw").when(F.col("numbered") == least, "numbered").otherwise("dictionary")
    return sized.withColumn("choice", choice)


@query(
    "d16b_smallest_encoding_or_raw",
    r"""WITH r AS (SELECT 'c_name' AS name, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'p_key', CAST(p_partkey AS VARCHAR) FROM part),
    p AS (SELECT name, v, count(*) AS n, octet_length(encode(v)) + 1 AS size, regexp_extract(v, '^([^0-9]*)[0-9]{1,9}$', 1) AS prefix FROM r GROUP BY name, v),
    s AS (SELECT name, sum(n) AS n, count(*) AS k, sum(n * size) AS raw, sum(size) AS vals, bool_and(regexp_matches(v, '^[^0-9]*[0-9]{1,9}$')) AND min(prefix) = max(prefix) AND min(size) = max(size) AS fits, octet_length(encode(min(prefix))) AS p FROM p GROUP BY name),
    z AS (SELECT name, CAST(raw AS BIGINT) AS raw, CAST(vals + n * CASE WHEN k <= 256 THEN 1 WHEN k <= 65536 THEN 2 ELSE 4 END AS BIGINT) AS dictionary, CASE WHEN fits THEN CAST(n * 4 + p + 1 AS BIGINT) END AS numbered FROM s)
    SELECT *, CASE WHEN least(dictionary, coalesce(numbered, dictionary)) >= raw THEN 'raw' WHEN numbered <= dictionary THEN 'numbered' ELSE 'dictionary' END AS choice FROM z""",
)
def d16b(spark, d):
    of = lambda t, c: table(spark, d, t).select(F.lit(c).alias("name"), F.col(c).cast("string").alias("v"))
    keys = table(spark, d, "part").select(F.lit("p_key").alias("name"), F.col("p_partkey").cast("string").alias("v"))
    return smallest_encodings(of("customer", "c_name").unionByName(of("customer", "c_mktsegment")).unionByName(of("part", "p_brand")).unionByName(of("pages", "url")).unionByName(keys))


@query(
    "d17_url_date_family",
    r"SELECT page_id, lang, CAST(y << 9 | (m << 5) | dd AS BIGINT) AS packed FROM (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, CAST(2000 + page_id % 30 AS BIGINT) AS y, CAST(1 + page_id % 12 AS BIGINT) AS m, CAST(1 + page_id % 28 AS BIGINT) AS dd FROM pages)",
)
def d17(spark, d):
    k = F.col("page_id")
    dated = F.concat("url", F.lit("/"), (2000 + k % 30).cast("string"), F.lit("/"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("/"), F.lpad((1 + k % 28).cast("string"), 2, "0"))
    rows = table(spark, d, "pages").select("page_id", dated.alias("u"))
    part = lambda i: F.regexp_extract("u", "/([0-9]{4})/([0-9]{2})/([0-9]{2})$", i).cast("long")
    packed = F.shiftleft(part(1), 9).bitwiseOR(F.shiftleft(part(2), 5)).bitwiseOR(part(3))
    return rows.select("page_id", F.regexp_extract("u", "/([a-z]{2})/", 1).alias("lang"), packed.alias("packed"))
