"""Structure in text columns: log templates, JSON fields, category lists, indentation and lexical classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bit_width, lines, micros, table
from ..plans.ordered import global_rank, previous, ranked
from ..registry import query

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_LINE = "event_type || ' user=' || user_id || ' at=' || epoch_us(ts) || ' id=' || md5('u' || user_id) || ' props=' || props"


def log_lines(spark, d) -> DataFrame:
    """(event_id, line): events as log lines."""
    e = table(spark, d, "events")
    line = F.concat("event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" at="), micros(F.col("ts")).cast("string"), F.lit(" id="), F.md5(F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary")), F.lit(" props="), "props")
    return e.select("event_id", line.alias("line"))


def mask(line: Column) -> Column:
    """The line with what varies replaced: identifiers, long hex, digit runs."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, _UUID, "<uuid>"), "[0-9a-f]{32,40}", "<hex>"), "[0-9]+", "#")


def templates(df: DataFrame, row_id: str, line: str) -> DataFrame:
    """(template, n, first, id): masks numbered by first appearance."""
    found = df.select(row_id, mask(F.col(line)).alias("template")).groupBy("template").agg(F.count("*").alias("n"), F.min(row_id).alias("first"))
    return global_rank(found, F.floor(F.col("first") / 4096), ["first"], "id").withColumn("id", F.col("id") - 1)


_MASK = "regexp_replace(regexp_replace(line, '[0-9a-f]{32,40}', '<hex>', 'g'), '[0-9]+', '#', 'g')"
_LOG = f"l AS (SELECT event_id, {_LINE} AS line FROM events)"


@query("j1_template_mining", f"WITH {_LOG}, m AS (SELECT {_MASK} AS template, count(*) AS n, min(event_id) AS first FROM l GROUP BY 1) SELECT template, n, first, row_number() OVER (ORDER BY first) - 1 AS id FROM m")
def j1(spark, d):
    return templates(log_lines(spark, d), "event_id", "line").withColumn("id", F.col("id").cast("long"))


@query(
    "j2_typed_fields",
    rf"WITH {_LOG} SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT s, CASE WHEN length(s) >= 32 THEN 'id' ELSE 'number' END AS kind FROM (SELECT unnest(regexp_extract_all(line, '[0-9a-f]{{32}}|[0-9]+')) AS s FROM l)) GROUP BY kind",
)
def j2(spark, d):
    fields = log_lines(spark, d).select(F.explode(F.regexp_extract_all("line", F.lit("[0-9a-f]{32}|[0-9]+"), F.lit(0))).alias("s"))
    return fields.groupBy(F.when(F.length("s") >= 32, "id").otherwise("number").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("n_chars"))


def split_gain(df: DataFrame, field: str, value: str, most: int = 64) -> DataFrame:
    """(distinct, whole_bits, split_bits, split): whether partitioning on a field of few values makes another column cheaper."""
    parts = df.groupBy(field).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    bits = lambda n, most_, least: n * bit_width(most_ - least)
    one = parts.agg(
        F.count("*").alias("distinct"),
        bits(F.sum("n"), F.max("most"), F.min("least")).cast("long").alias("whole_bits"),
        (F.sum(bits(F.col("n"), F.col("most"), F.col("least"))) + F.count("*") * 64).cast("long").alias("split_bits"),
    )
    return one.withColumn("split", (F.col("distinct") <= most) & (F.col("split_bits") < F.col("whole_bits")))


_BITS = "CASE WHEN max(v) = min(v) THEN 0 ELSE length(bin(max(v) - min(v))) END"


@query("j3_template_split", f"WITH e AS (SELECT event_type AS f, user_id AS v FROM events), w AS (SELECT count(DISTINCT f) AS dist, count(*) * ({_BITS}) AS whole_bits FROM e), p AS (SELECT CAST(sum(b) + count(*) * 64 AS BIGINT) AS split_bits FROM (SELECT count(*) * ({_BITS}) AS b FROM e GROUP BY f)) SELECT dist AS \"distinct\", whole_bits, split_bits, dist <= 64 AND split_bits < whole_bits AS split FROM w, p")
def j3(spark, d):
    return split_gain(table(spark, d, "events"), "event_type", "user_id")


@query(
    "j4_field_storage_choice",
    "WITH s AS (SELECT p_type AS t, count(*) AS n, count(DISTINCT p_brand) AS k, CAST(sum(octet_length(encode(p_brand))) AS BIGINT) AS inline_ FROM part GROUP BY 1), c AS (SELECT t, inline_, k * 9 + n * (CASE WHEN k <= 1 THEN 0 WHEN k <= 256 THEN 1 ELSE 2 END) AS dict_ FROM s) SELECT t, inline_ AS inline_bytes, dict_ AS dictionary_bytes, CASE WHEN dict_ < inline_ THEN 'dictionary' ELSE 'inline' END AS choice FROM c",
)
def j4(spark, d):
    stats = table(spark, d, "part").groupBy(F.col("p_type").alias("t")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("k"), F.sum(F.octet_length("p_brand")).cast("long").alias("inline_bytes"))
    unit = F.when(F.col("k") <= 1, 0).when(F.col("k") <= 256, 1).otherwise(2)
    sized = stats.withColumn("dictionary_bytes", (F.col("k") * 9 + F.col("n") * unit).cast("long"))
    return sized.select("t", "inline_bytes", "dictionary_bytes", F.when(F.col("dictionary_bytes") < F.col("inline_bytes"), "dictionary").otherwise("inline").alias("choice"))


@query("j5_frequency_order", f"WITH {_LOG}, m AS (SELECT {_MASK} AS template, count(*) AS n, min(event_id) AS first FROM l GROUP BY 1) SELECT template, row_number() OVER (ORDER BY n DESC, first) - 1 AS id FROM m")
def j5(spark, d):
    found = templates(log_lines(spark, d), "event_id", "line")
    return ranked(found.select("template", "n", "first"), [F.desc("n"), "first"], "id").select("template", (F.col("id") - 1).cast("long").alias("id"))


@query("j6_template_rendering", f"WITH {_LOG} SELECT event_id, line FROM l")
def j6(spark, d):
    literals = F.split("line", "[0-9]+", -1)
    fields = F.concat(F.regexp_extract_all("line", F.lit("[0-9]+"), F.lit(0)), F.array(F.lit("")))
    parts = log_lines(spark, d).select("event_id", literals.alias("literals"), fields.alias("fields"))
    return parts.select("event_id", F.array_join(F.zip_with("literals", "fields", lambda a, b: F.concat(a, b)), "").alias("line"))


_JSON = """'{"name":' || '"' || c_name || '"' || ',"segment":' || '"' || c_mktsegment || '"' || ',"nation":' || c_nationkey || '}'"""


def _records(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lit('{"name":"'), "c_name", F.lit('","segment":"'), "c_mktsegment", F.lit('","nation":'), F.col("c_nationkey").cast("string"), F.lit("}")).alias("json"))


@query("j7_json_field_scan", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def j7(spark, d):
    row = F.from_json("json", "name string, segment string, nation int")
    return _records(spark, d).select("c_custkey", row.alias("r")).select("c_custkey", "r.*")


@query("j8_json_pairs", "SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def j8(spark, d):
    pairs = F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e")
    return table(spark, d, "events").select("event_id", pairs).select("event_id", F.col("e.key").alias("k"), F.col("e.value").alias("v"))


@query("j9_category_split", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, cs[i] AS category FROM (SELECT p_partkey, string_split(p_type || ', ' || p_brand, ', ') AS cs, unnest(range(1, len(string_split(p_type || ', ' || p_brand, ', ')) + 1)) AS i FROM part)")
def j9(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split(F.concat_ws(", ", "p_type", "p_brand"), ", ")).alias("pos", "category"))


@query("j10_tuple_dictionary", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_type, p_size) - 1 AS id FROM part")
def j10(spark, d):
    part = table(spark, d, "part")
    keys = ["p_brand", "p_type", "p_size"]
    ids = ranked(part.select(*keys).distinct(), keys, "id").withColumn("id", (F.col("id") - 1).cast("long"))
    return part.join(ids, keys).select("p_partkey", "id")


@query("j11_common_rare", "SELECT line, count(*) AS n, count(*) >= 4 AS common FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(*) > 1")
def j11(spark, d):
    return lines(table(spark, d, "documents")).groupBy("line").agg(F.count("*").alias("n")).where("n > 1").withColumn("common", F.col("n") >= 4)


@query("j12_day_mask", "SELECT user_id, bit_or(1 << CAST(epoch_us(ts) // 86400000000 % 7 AS INTEGER)) AS days, count(*) AS n FROM events GROUP BY user_id")
def j12(spark, d):
    day = F.floor(micros(F.col("ts")) / 86_400_000_000) % 7
    one = F.element_at(F.array(*(F.lit(1 << k) for k in range(7))), (day + 1).cast("int"))
    return table(spark, d, "events").groupBy("user_id").agg(F.bit_or(one).alias("days"), F.count("*").alias("n"))


def pair_merges(df: DataFrame, id_column: str, items: str, least: int = 8, top: int = 4096, most_bytes: int = 512) -> DataFrame:
    """(a, b, n): adjacent items of arrays that occur often enough to be worth one symbol."""
    nexts = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    pairs = df.select(F.explode(F.zip_with(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), nexts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.octet_length("a") + F.octet_length("b") <= most_bytes))
    return counted.orderBy(F.desc("n"), "a", "b").limit(top)


@query(
    "j13_adjacent_pairs",
    "WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), p AS (SELECT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w)) SELECT a, b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 8 AND octet_length(encode(a)) + octet_length(encode(b)) <= 512 ORDER BY n DESC, a, b LIMIT 4096",
)
def j13(spark, d):
    return pair_merges(table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("ws")), "doc_id", "ws")


@query(
    "j14_phrase_slots",
    "WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents), f AS (SELECT w, count(*) AS n, least(octet_length(encode(w)) // 4, 8) AS class FROM w WHERE w <> '' GROUP BY w HAVING count(*) >= 20) SELECT w, n, class, row_number() OVER (PARTITION BY class ORDER BY n DESC, w) AS slot FROM f",
)
def j14(spark, d):
    counted = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w != ''").groupBy("w").agg(F.count("*").alias("n")).where("n >= 20")
    sized = counted.withColumn("class", F.least(F.floor(F.octet_length("w") / 4), F.lit(8)))
    return sized.select("w", "n", "class", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "w")).cast("long").alias("slot"))


def _code(spark, d) -> DataFrame:
    text = F.concat(F.repeat(F.lit(" "), (4 * (F.col("l_linenumber") % 4)).cast("int")), F.when(F.col("l_linenumber") % 3 == 0, "def ").when(F.col("l_linenumber") % 3 == 1, "return ").otherwise("if "), "l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, ":").otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", text.alias("s"))


_CODE = "c AS (SELECT l_orderkey, l_linenumber, l_returnflag, repeat(' ', CAST(4 * (l_linenumber % 4) AS INTEGER)) || CASE l_linenumber % 3 WHEN 0 THEN 'def ' WHEN 1 THEN 'return ' ELSE 'if ' END || l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN ':' ELSE '' END AS s FROM lineitem)"


def line_class(line: Column) -> Column:
    body = F.ltrim(line)
    return F.when(body == "", "blank").when(body.rlike("^(def|class|@)"), "head").when(body.rlike("^(if|else|elif|for|while|try)\\b"), "branch").when(body.rlike("^(return|raise|pass)\\b"), "leave").otherwise("other")


_CLASS = "CASE WHEN ltrim(s) = '' THEN 'blank' WHEN regexp_matches(ltrim(s), '^(def|class|@)') THEN 'head' WHEN regexp_matches(ltrim(s), '^(if|else|elif|for|while|try)\\b') THEN 'branch' WHEN regexp_matches(ltrim(s), '^(return|raise|pass)\\b') THEN 'leave' ELSE 'other' END"


@query(
    "j15_indentation_context",
    f"WITH {_CODE}, x AS (SELECT length(s) - length(ltrim(s)) AS indent, lag(length(s) - length(ltrim(s))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS p, lag(right(s, 1)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS tail, {_CLASS} AS class FROM c) SELECT coalesce(tail, '') AS tail, class, CAST(indent - coalesce(p, 0) AS BIGINT) AS delta, count(*) AS n FROM x GROUP BY ALL",
)
def j15(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag")
    indent = F.length("s") - F.length(F.ltrim("s"))
    rows = _code(spark, d).withColumn("indent", indent).select(F.coalesce(F.lag(F.right("s", F.lit(1))).over(w), F.lit("")).alias("tail"), line_class(F.col("s")).alias("class"), (F.col("indent") - F.coalesce(F.lag("indent").over(w), F.lit(0))).cast("long").alias("delta"))
    return rows.groupBy("tail", "class", "delta").agg(F.count("*").alias("n"))


@query("j16_line_classes", f"WITH {_CODE} SELECT {_CLASS} AS class, CASE WHEN right(s, 1) = ':' THEN 'opens' ELSE 'other' END AS tail, count(*) AS n FROM c GROUP BY ALL")
def j16(spark, d):
    tail = F.when(F.right("s", F.lit(1)) == ":", "opens").otherwise("other")
    return _code(spark, d).groupBy(line_class(F.col("s")).alias("class"), tail.alias("tail")).agg(F.count("*").alias("n"))


_LEX = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[ \n\t]+|[^A-Za-z0-9_ \n\t]"


@query("j17_lexical_tokens", f"SELECT kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM (SELECT t, CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'word' WHEN regexp_matches(t, '^[0-9]') THEN 'number' WHEN regexp_matches(t, '^[ \\n\\t]') THEN 'space' ELSE 'other' END AS kind FROM (SELECT unnest(regexp_extract_all(html, '{_LEX}')) AS t FROM pages)) GROUP BY kind")
def j17(spark, d):
    tokens = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(_LEX), F.lit(0))).alias("t"))
    kind = F.when(F.col("t").rlike("^[A-Za-z_]"), "word").when(F.col("t").rlike("^[0-9]"), "number").when(F.col("t").rlike("^[ \n\t]"), "space").otherwise("other")
    return tokens.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("t")).cast("long").alias("n_chars"))


@query("j18_number_spans", "SELECT l_orderkey, l_linenumber, CASE WHEN starts_with(s, '-') THEN 1 ELSE 0 END AS negative, CAST(length(split_part(ltrim(s, '-'), '.', 1)) AS INTEGER) AS int_digits, CAST(length(split_part(s, '.', 2)) AS INTEGER) AS frac_digits FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || l_partkey || '.' || l_suppkey AS s FROM lineitem)")
def j18(spark, d):
    s = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(""), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_suppkey").cast("string"))
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).withColumn("p", F.split(F.regexp_replace("s", "^-", ""), "\\."))
    return parts.select("l_orderkey", "l_linenumber", F.startswith("s", F.lit("-")).cast("int").alias("negative"), F.length(F.col("p")[0]).alias("int_digits"), F.length(F.col("p")[1]).alias("frac_digits"))


@query(
    "j19_map_key_dictionaries",
    "WITH kv AS (SELECT 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part), n AS (SELECT k, v, count(*) AS n FROM kv GROUP BY ALL) SELECT k, v, n, dense_rank() OVER (PARTITION BY k ORDER BY v) - 1 AS id, CASE WHEN count(*) OVER (PARTITION BY k) <= 256 THEN 1 ELSE 2 END AS width FROM n",
)
def j19(spark, d):
    attributes = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    counted = table(spark, d, "part").select(F.explode(attributes).alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("k")
    return counted.select("k", "v", "n", (F.dense_rank().over(w.orderBy("v")) - 1).cast("long").alias("id"), F.when(F.count("*").over(w) <= 256, 1).otherwise(2).alias("width"))


@query("j20_separator_and_rebuild", "SELECT count(*) AS n, CAST(2 AS BIGINT) AS n_separators, true AS rebuilt FROM customer")
def j20(spark, d):
    pattern = r'^(\{"name":")(.*)(","segment":")(.*)(","nation":)(.*)(\})$'
    g = [F.regexp_extract("json", pattern, i) for i in range(1, 8)]
    rows = _records(spark, d).select("json", *(x.alias(f"g{i}") for i, x in enumerate(g, 1)))
    back = F.concat(*(f"g{i}" for i in range(1, 8)))
    return rows.agg(F.count("*").alias("n"), (F.countDistinct("g3") + F.countDistinct("g5")).alias("n_separators"), F.bool_and(back == F.col("json")).alias("rebuilt"))
