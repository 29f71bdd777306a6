"""Dictionaries and grammars over text columns: counts, gains, merges, fragments, fronts and contexts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import table, words
from ..plans.ordered import predecessor, ranked
from ..plans.paths import scratch
from ..registry import query

_WORDS = "w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) AS word FROM documents)"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query("x1_symbol_histogram", "SELECT c AS sym, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def x1(spark, d):
    each = _docs(spark, d).select(F.explode(F.split("text", "")).alias("sym"))
    return each.where("sym != ''").groupBy("sym").agg(F.count("*").alias("n"))


def word_dictionary(df: DataFrame, id_column: str, text_column: str, code_bytes: int = 2, top: int = 4096) -> DataFrame:
    """(word, n, gain, id): words worth a code of ``code_bytes``, best by bytes saved, numbered by frequency."""
    n = words(df, id_column, text_column).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    size = F.octet_length("word")
    best = n.withColumn("gain", ((size - code_bytes) * F.col("n") - size).cast("long")).where("gain > 0").orderBy(F.desc("gain"), "word").limit(top)
    return best.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("long"))


_DICT = f"{_WORDS}, n AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 2), b AS (SELECT word, n, (octet_length(encode(word)) - 2) * n - octet_length(encode(word)) AS gain FROM n), t AS (SELECT * FROM b WHERE gain > 0 ORDER BY gain DESC, word LIMIT 4096), dict AS (SELECT *, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM t)"


@query("x2_word_dictionary_gain", f"WITH {_DICT} SELECT word, n, gain, id FROM dict")
def x2(spark, d):
    return word_dictionary(_docs(spark, d), "doc_id", "text")


@query("x3_word_substitution", f"WITH {_DICT} SELECT doc_id, count(id) AS coded, CAST(sum(CASE WHEN id IS NULL THEN octet_length(encode(w.word)) + 1 ELSE 2 END) AS BIGINT) AS n_bytes FROM w LEFT JOIN dict ON w.word = dict.word GROUP BY doc_id")
def x3(spark, d):
    dictionary = word_dictionary(_docs(spark, d), "doc_id", "text").select("word", "id")  # at most 4096 rows
    coded = words(_docs(spark, d), "doc_id", "text").join(F.broadcast(dictionary), "word", "left")
    return coded.groupBy("doc_id").agg(F.count("id").alias("coded"), F.sum(F.when(F.col("id").isNull(), F.octet_length("word") + 1).otherwise(2)).cast("long").alias("n_bytes"))


def pair_counts(df: DataFrame, tokens: str, weight: str | None = None) -> DataFrame:
    """(a, b, n): adjacent tokens of arrays, each array counted once or ``weight`` times."""
    ends = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.explode(F.arrays_zip(F.slice(tokens, F.lit(1), ends).alias("a"), F.slice(tokens, F.lit(2), ends).alias("b"))).alias("p")
    times = (F.col(weight) if weight else F.lit(1)).cast("long").alias("times")
    return df.select(pairs, times).groupBy("p.a", "p.b").agg(F.sum("times").alias("n"))


@query("x4_pair_counts", "SELECT a, b, count(*) AS n FROM (SELECT substring(p_name, CAST(i AS INT), 1) AS a, substring(p_name, CAST(i + 1 AS INT), 1) AS b FROM (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM part)) GROUP BY ALL")
def x4(spark, d):
    return pair_counts(table(spark, d, "part").select(F.split("p_name", "").alias("t")), "t")


def symbol_pairs(df: DataFrame, coded: str, weight: str) -> DataFrame:
    """(a, b, n): adjacent characters of strings, each string counted ``weight`` times; a pair is one short key, not a row of arrays."""
    at = df.where(F.length(coded) >= 2).select(coded, weight, F.explode(F.sequence(F.lit(1), F.length(coded) - 1)).alias("i"))
    n = at.groupBy(F.substring(F.col(coded), F.col("i"), F.lit(2)).alias("ab")).agg(F.sum(weight).alias("n"))
    return n.select(F.substring("ab", 1, 1).alias("a"), F.substring("ab", 2, 1).alias("b"), "n")


#: Supplementary private-use code points stand for the symbols of rules, less those that the texts have themselves.
PRIVATE = (range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))


def merge_pairs(coded: Column, pairs: dict[tuple[str, str], str]) -> Column:
    """A string of one-character tokens with every listed pair replaced, greedily from left to right.

    Replacing one pair after the other is the same as all at once where, as here, no
    pair's first token is another's second.
    """
    for (a, b), c in pairs.items():
        coded = F.replace(coded, F.lit(a + b), F.lit(c))
    return coded


def unused_symbols(df: DataFrame, text: str) -> Iterator[str]:
    """Private-use characters that no text has, in order; at most 131,068 are looked at."""
    own = F.filter(F.split(text, ""), lambda c: c >= F.lit(chr(PRIVATE[0].start)))
    met = {r.c for r in df.select(F.explode(own).alias("c")).distinct().collect()}
    return (chr(k) for block in PRIVATE for k in block if chr(k) not in met)


def byte_pairs(df: DataFrame, row_id: str, text: str, rounds: int | None = 6, a_round: int = 16, longest: int | None = None, weight: str | None = None) -> tuple[DataFrame, list[tuple[str, str, str]], list[dict]]:
    """Batched pair merges: (rows (row_id, coded, weight), rules (a, b, symbol), cost after each round).

    A round counts pairs over all rows, ``weight`` times each, takes the most frequent whose
    members don't overlap, and rewrites the rows; the table of rows is written between rounds.
    ``longest`` bounds the characters that a token may stand for; pairs beyond it
    aren't ranked, so the first pair of a round is always replaced and training ends
    only after ``rounds`` or, without them, when no pair is left that occurs twice.
    Null texts stay null.  Every token is one character of ``coded``.
    """
    spark = df.sparkSession
    width: dict[str, int] = {}
    rows = df.select(row_id, F.col(text).alias("coded"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("weight"))
    rules: list[tuple[str, str, str]] = []
    ledger: list[dict] = []
    for number in itertools.count():
        path = scratch(spark, "pairs")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        if not number:
            symbols = unused_symbols(rows, "coded")  # of the written rows: what made them runs once
        used = int(rows.agg(F.sum(F.length("coded") * F.col("weight"))).first()[0] or 0)
        ledger.append({"round": number, "tokens": used, "rules": len(rules), "cost": 2 * used + 4 * len(rules)})
        if number == rounds:
            break
        counted = symbol_pairs(rows, "coded", "weight").where("n >= 2")
        if longest is not None:
            wide = F.create_map(*(F.lit(x) for kv in width.items() for x in kv)) if width else None
            size_of = lambda c, wide=wide: F.lit(1) if wide is None else F.coalesce(F.element_at(wide, F.col(c)), F.lit(1))
            counted = counted.where(size_of("a") + size_of("b") <= longest)
        best = counted.orderBy(F.desc("n"), "a", "b").limit(4 * a_round).collect()
        chosen: dict[tuple[str, str], str] = {}
        lefts, rights = set(), set()
        for r in best:
            if r.a not in rights and r.b not in lefts and len(chosen) < a_round:
                symbol = next(symbols)
                chosen[r.a, r.b] = symbol
                width[symbol] = width.get(r.a, 1) + width.get(r.b, 1)
                rules.append((r.a, r.b, symbol))
                lefts.add(r.a)
                rights.add(r.b)
        if not chosen:
            break
        rows = rows.select(row_id, merge_pairs(F.col("coded"), chosen).alias("coded"), "weight")
    return rows, rules, ledger


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, a, b) of rules, which are few."""
    return spark.createDataFrame([(c, a, b) for a, b, c in rules], "id string, a string, b string")


def rule_texts(rules: DataFrame) -> DataFrame:
    """(id, depth, s): what each rule (id, a, b) stands for, and the levels of rules below it; a join a level, to any depth."""
    spark = rules.sparkSession
    path = scratch(spark, "expansion")
    known = rules.select("id", F.array("a", "b").alias("parts"), F.lit(1).alias("depth"))
    for level in itertools.count():
        open_ = known.select("id", "depth", F.posexplode("parts").alias("pos", "p"))
        deeper = open_.join(rules.select(F.col("id").alias("p"), "a", "b"), "p", "left")
        part = F.when(F.col("a").isNull(), F.array("p")).otherwise(F.array("a", "b")).alias("q")
        step = deeper.groupBy("id", "depth").agg(F.array_sort(F.collect_list(F.struct("pos", part))).alias("s"), F.count("a").alias("more"))
        step = step.select("id", F.flatten(F.transform("s", lambda x: x["q"])).alias("parts"), (F.col("depth") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("depth"), "more")
        place = f"{path}/{level}"
        step.write.parquet(place)
        step = spark.read.schema(step.schema).parquet(place)
        known = step.select("id", "parts", "depth")
        if not step.where("more > 0").limit(1).count():
            return known.select("id", "depth", F.array_join("parts", "").alias("s"))


def expand(coded: DataFrame, rules: DataFrame, row_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, text) of coded rows: rules (id, a, b) are expanded first, then each row's symbols are looked up where it stands."""
    import pyarrow as pa

    texts = {ord(r.id): r.s for r in rule_texts(rules).collect()}  # as few as the rules, which training has collected

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if v is None else v.translate(texts) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], [*batch.schema.names[1:], "text"])

    rows = coded.select(row_id, *keep)
    return coded.select("coded", row_id, *keep).mapInArrow(spell, StructType([*rows.schema.fields, StructField("text", StringType())]))


@query("x5_byte_pair_roundtrip", "SELECT p_partkey, p_name AS text FROM part")
def x5(spark, d):
    tokens, rules, _ = byte_pairs(table(spark, d, "part"), "p_partkey", "p_name")
    return expand(tokens, rule_table(spark, rules), "p_partkey")


@query("x6_pair_at_a_time_roundtrip", "SELECT r_regionkey, r_name AS text FROM region")
def x6(spark, d):
    """Exact pair replacement: one rule, the most frequent pair, a round, until no pair repeats."""
    tokens, rules, _ = byte_pairs(table(spark, d, "region"), "r_regionkey", "r_name", rounds=None, a_round=1)
    return expand(tokens, rule_table(spark, rules), "r_regionkey")


def parsed(df: DataFrame, row_id: str, text: str, dictionary: list[str], shortest: bool) -> DataFrame:
    """(row_id, pieces): each text as dictionary entries and single characters, longest first or fewest in all."""
    import pandas as pd

    entries = frozenset(dictionary)
    most = max(map(len, entries), default=1)

    def cut(s: str) -> list[str]:
        n = len(s)
        if shortest:
            cost, size = [0] * (n + 1), [1] * (n + 1)
            for i in range(n - 1, -1, -1):
                cost[i], size[i] = min((cost[i + k] + 1, -k) for k in range(1, min(most, n - i) + 1) if k == 1 or s[i : i + k] in entries)
                size[i] = -size[i]
        else:
            size = [next((k for k in range(min(most, n - i), 1, -1) if s[i : i + k] in entries), 1) for i in range(n)]
        out, i = [], 0
        while i < n:
            out.append(s[i : i + size[i]])
            i += size[i]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({row_id: batch[row_id], "pieces": [cut(s or "") for s in batch[text]]})

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, text).mapInPandas(run, f"{row_id} {kind}, pieces array<string>")


def _entries(spark, d) -> list[str]:
    found = fragments(table(spark, d, "pages").select("url"), "url", [4, 6, 8, 12], 1, 100).select("fragment").collect()  # at most 400 rows
    return [r.fragment for r in found]


@query("x9_shortest_parse", "SELECT page_id, url AS text, true AS no_longer FROM pages")
def x9(spark, d):
    pages, entries = table(spark, d, "pages"), _entries(spark, d)
    best = parsed(pages, "page_id", "url", entries, True)
    greedy = parsed(pages, "page_id", "url", entries, False).withColumnRenamed("pieces", "greedy")
    return best.join(greedy, "page_id").select("page_id", F.array_join("pieces", "").alias("text"), (F.size("pieces") <= F.size("greedy")).alias("no_longer"))


@query("x11_greedy_longest_match", "SELECT page_id, url AS text FROM pages")
def x11(spark, d):
    return parsed(table(spark, d, "pages"), "page_id", "url", _entries(spark, d), False).select("page_id", F.array_join("pieces", "").alias("text"))


@query("x7_grammar_expansion", "WITH RECURSIVE g AS (SELECT n_nationkey AS root, n_nationkey AS id, 0 AS depth FROM nation UNION ALL SELECT root, 2 * id + k, depth + 1 FROM g, (SELECT unnest([1, 2]) AS k) WHERE depth < 3 AND 2 * id + k < 100) SELECT root, count(*) AS n FROM g GROUP BY root")
def x7(spark, d):
    """A fixed number of levels: each is a join with the rules."""
    rules = spark.range(0, 100).select(F.col("id").cast("long").alias("id"), F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2)).alias("child")).where("child < 100")
    level = table(spark, d, "nation").select(F.col("n_nationkey").alias("root"), F.col("n_nationkey").cast("long").alias("id"))
    every = level
    for _ in range(3):
        level = level.join(rules, "id").select("root", F.col("child").alias("id"))
        every = every.unionAll(level)
    return every.groupBy("root").agg(F.count("*").alias("n"))


def _word_grammar(spark, d, rounds: int | None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Merges learned from all words of the documents: rounds rewrite distinct words, which stand for all their uses."""
    counted = words(_docs(spark, d), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"))
    coded, rules, _ = byte_pairs(counted, "word", "word", rounds=rounds, a_round=32, weight="n")
    return coded, rules


@query("x5b_word_merges_roundtrip", f"WITH {_WORDS} SELECT word, word AS text, count(*) AS n FROM w GROUP BY word")
def x5b(spark, d):
    """48 rounds of merges over the documents' words, and the words again from their codes."""
    coded, rules = _word_grammar(spark, d, 48)
    return expand(coded, rule_table(spark, rules), "word", ("weight",)).select("word", "text", F.col("weight").alias("n"))


@query("x7b_learned_grammar_expansion")
def x7b(spark, d):
    """(text, depth, n_chars) of every rule of a grammar learned from the documents' words, to any depth."""
    _, rules = _word_grammar(spark, d, 16)
    return rule_texts(rule_table(spark, rules)).select(F.col("s").alias("text"), "depth", F.length("s").alias("n_chars"))


def symbol_table(df: DataFrame, text: str, rounds: int = 5, size: int = 255, longest: int = 8) -> list[str]:
    """Up to ``size`` symbols of 1 to ``longest`` characters: each round parses with the table so far, counts symbols
    and neighbours over all rows, and keeps those that cover most."""
    from collections import Counter
    import pandas as pd

    symbols: list[str] = []
    for _ in range(rounds):
        known = frozenset(symbols)

        def count(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found: Counter = Counter()
                for s in batch[text]:
                    i, before = 0, ""
                    while s and i < len(s):
                        k = next((k for k in range(min(longest, len(s) - i), 1, -1) if s[i : i + k] in known), 1)
                        now = s[i : i + k]
                        found[now] += 1
                        if before and len(before) + k <= longest:
                            found[before + now] += 1
                        before, i = now, i + k
                yield pd.DataFrame({"symbol": list(found), "n": list(found.values())})

        counted = df.select(text).mapInPandas(count, "symbol string, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
        symbols = [r.symbol for r in counted.orderBy(F.desc(F.col("n") * F.length("symbol")), "symbol").limit(size).collect()]
    return symbols


@query("x22_symbol_table_roundtrip", "SELECT page_id, url AS text, true AS shorter FROM pages")
def x22(spark, d):
    pages = table(spark, d, "pages")
    parts = parsed(pages, "page_id", "url", symbol_table(pages, "url"), False)
    return parts.select("page_id", F.array_join("pieces", "").alias("text"), (F.size("pieces") < F.length(F.array_join("pieces", ""))).alias("shorter"))


@query("x8_stop_at_best_cost")
def x8(spark, d):
    _, _, ledger = byte_pairs(table(spark, d, "part"), "p_partkey", "p_name", rounds=4)
    rows = spark.createDataFrame([(r["round"], r["tokens"], r["rules"], r["cost"]) for r in ledger], "round int, tokens long, rules int, cost long")
    best = F.min(F.struct("cost", "round")).over(Window.partitionBy())  # a row a round
    return rows.withColumn("best", F.col("round") == best["round"])


def fragments(df: DataFrame, text: str, lengths: list[int], stride: int, top: int) -> DataFrame:
    """(length, fragment, n, score): fixed-length pieces at a stride, best by bytes covered, ``top`` a length."""
    starts = F.explode(F.array(*(F.lit(n) for n in lengths))).alias("length")
    each = df.select(text, starts).where(F.length(text) >= F.col("length"))
    pieces = each.select("length", F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("length") + 1, F.lit(stride)), lambda i: F.substring(F.col(text), i, F.col("length")))).alias("fragment"))
    counted = pieces.groupBy("length", "fragment").agg(F.count("*").alias("n")).where("n >= 2").withColumn("score", F.col("n") * F.col("length"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("length").orderBy(F.desc("score"), "fragment"))).where(F.col("place") <= top).drop("place")


@query(
    "x12_ngram_mining",
    "WITH p AS (SELECT k AS length, substring(url, CAST(i AS INT), k) AS fragment FROM (SELECT url, k, unnest(range(1, length(url) - k + 2, 4)) AS i FROM pages, (SELECT unnest([8, 12, 16, 24]) AS k) WHERE length(url) >= k)), c AS (SELECT length, fragment, count(*) AS n FROM p GROUP BY length, fragment), r AS (SELECT length, fragment, n, n * length AS score, row_number() OVER (PARTITION BY length ORDER BY n * length DESC, fragment) AS k FROM c WHERE n >= 2) SELECT length, fragment, n, score FROM r WHERE k <= 200",
)
def x12(spark, d):
    return fragments(table(spark, d, "pages").select("url"), "url", [8, 12, 16, 24], 4, 200)


@query(
    "x12b_ngram_mining_six_lengths",
    "WITH p AS (SELECT k AS length, substring(url, CAST(i AS INT), k) AS fragment FROM (SELECT url, k, unnest(range(1, length(url) - k + 2)) AS i FROM pages, (SELECT unnest([8, 12, 16, 24, 32, 48]) AS k) WHERE length(url) >= k)), c AS (SELECT length, fragment, count(*) AS n FROM p GROUP BY length, fragment), r AS (SELECT length, fragment, n, n * length AS score, row_number() OVER (PARTITION BY length ORDER BY n * length DESC, fragment) AS k FROM c WHERE n >= 2) SELECT length, fragment, n, score FROM r WHERE k <= 24000",
)
def x12b(spark, d):
    """Pieces at every place, 24,000 a length."""
    return fragments(table(spark, d, "pages").select("url"), "url", [8, 12, 16, 24, 32, 48], 1, 24_000)


@query("x13_usage_and_prune", f"WITH {_DICT} SELECT dict.word, count(*) AS used, count(*) * octet_length(encode(dict.word)) AS score FROM w JOIN dict ON w.word = dict.word GROUP BY dict.word HAVING count(*) * octet_length(encode(dict.word)) >= 500")
def x13(spark, d):
    dictionary = word_dictionary(_docs(spark, d), "doc_id", "text").select("word")
    used = words(_docs(spark, d), "doc_id", "text").join(F.broadcast(dictionary), "word").groupBy("word").agg(F.count("*").alias("used"))
    return used.withColumn("score", F.col("used") * F.octet_length("word")).where("score >= 500")


@query("x14_phrase_candidates", "WITH w AS (SELECT list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM documents), p AS (SELECT ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS phrase FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM w)) SELECT phrase, count(*) AS n FROM p GROUP BY phrase HAVING count(*) >= 10")
def x14(spark, d):
    """Only expressions that Spark compiles: a lambda for each phrase was most of the time."""
    ws = F.array_remove(F.split(F.translate("text", "\n", " "), " "), "").alias("ws")
    at = _docs(spark, d).select(ws).where(F.size("ws") >= 3).select("ws", F.explode(F.sequence(F.lit(0), F.size("ws") - 3)).alias("i"))
    phrases = at.select(F.concat_ws(" ", *(F.get("ws", F.col("i") + k) for k in range(3))).alias("phrase"))
    return phrases.groupBy("phrase").agg(F.count("*").alias("n")).where("n >= 10")


@query("x15_sampled_codebook_choice", "WITH v AS (SELECT c_mktsegment AS v FROM customer WHERE c_custkey % 10 = 0), n AS (SELECT v, count(*) AS n FROM v GROUP BY v), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM n) SELECT size, CAST(sum(CASE WHEN k <= size THEN n + octet_length(encode(v)) ELSE n * octet_length(encode(v)) END) AS BIGINT) AS cost FROM r, (SELECT unnest([0, 1, 2, 4, 8]) AS size) GROUP BY size")
def x15(spark, d):
    sample = table(spark, d, "customer").where("c_custkey % 10 = 0").groupBy(F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("n"))
    size = F.octet_length("v")
    each = ranked(sample, [F.desc("n"), "v"], "k").withColumn("size", F.explode(F.array(*(F.lit(s) for s in (0, 1, 2, 4, 8)))))
    return each.groupBy("size").agg(F.sum(F.when(F.col("k") <= F.col("size"), F.col("n") + size).otherwise(F.col("n") * size)).cast("long").alias("cost"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) != F.substring(b, F.lit(1), i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(same, F.lit(1)) - 1, n))


def front_coded(df: DataFrame, value: str, bucket: Column) -> DataFrame:
    """(value, lcp, suffix): distinct values in order, each as what it shares with the one before.

    Buckets follow the order, so only a bucket's first value lacks its true
    predecessor: it is kept whole, as at the start of a block.
    """
    w = Window.partitionBy("bucket").orderBy(value)
    rows = df.select(value).distinct().withColumn("bucket", bucket).withColumn("prev", F.coalesce(F.lag(value).over(w), F.lit("")))
    lcp = common_prefix(F.col("prev"), F.col(value))
    return rows.withColumn("lcp", lcp).select(F.col(value).alias("value"), "lcp", rest_of(F.col(value), F.col("lcp")))


def rest_of(value: Column, at: Column) -> Column:
    """All that follows the first ``at`` characters."""
    return F.substring(value, at + 1, F.length(value)).alias("suffix")


@query("x16b_front_coding_one_order", f"WITH u AS (SELECT DISTINCT url FROM pages), o AS (SELECT url, coalesce(lag(url) OVER (ORDER BY url), '') AS prev FROM u), l AS (SELECT url, CAST({{}} AS INTEGER) AS lcp FROM o) SELECT url AS value, lcp, substring(url, lcp + 1) AS suffix FROM l".format("len(list_filter(range(1, least(length(prev), length(url)) + 1), lambda i: substring(prev, 1, CAST(i AS INT)) = substring(url, 1, CAST(i AS INT))))"))
def x16b(spark, d):
    """Every value but the very first is coded by its true predecessor, over ranges of the order."""
    rows = predecessor(table(spark, d, "pages"), "url")
    lcp = common_prefix(F.coalesce("prev", F.lit("")), F.col("url"))
    return rows.withColumn("lcp", lcp).select(F.col("url").alias("value"), "lcp", rest_of(F.col("url"), F.col("lcp")))


_LCP = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substring({0}, 1, CAST(i AS INT)) = substring({1}, 1, CAST(i AS INT))))"


@query("x16_front_coding_sorted", f"WITH u AS (SELECT DISTINCT url FROM pages), o AS (SELECT url, coalesce(lag(url) OVER (PARTITION BY substring(url, 1, 9) ORDER BY url), '') AS prev FROM u), l AS (SELECT url, CAST({_LCP.format('prev', 'url')} AS INTEGER) AS lcp FROM o) SELECT url AS value, lcp, substring(url, lcp + 1) AS suffix FROM l")
def x16(spark, d):
    return front_coded(table(spark, d, "pages"), "url", F.substring("url", 1, 9))


@query("x17_reversed_variant", f"WITH f AS (SELECT DISTINCT url AS v FROM pages), r AS (SELECT DISTINCT reverse(url) AS v FROM pages), a AS (SELECT 'forward' AS way, v, coalesce(lag(v) OVER (PARTITION BY substring(v, 1, 9) ORDER BY v), '') AS prev FROM f UNION ALL SELECT 'reversed', v, coalesce(lag(v) OVER (PARTITION BY substring(v, 1, 2) ORDER BY v), '') FROM r) SELECT way, CAST(sum(length(v) - {_LCP.format('prev', 'v')}) AS BIGINT) AS suffix_chars FROM a GROUP BY way")
def x17(spark, d):
    pages = table(spark, d, "pages")
    both = front_coded(pages, "url", F.substring("url", 1, 9)).withColumn("way", F.lit("forward")).unionAll(front_coded(pages.select(F.reverse("url").alias("u")), "u", F.substring("u", 1, 2)).withColumn("way", F.lit("reversed")))
    return both.groupBy("way").agg(F.sum(F.length("suffix")).cast("long").alias("suffix_chars"))


@query("x18_parent_dictionary", "SELECT p AS parent, count(*) AS n, CAST(sum(length(u) - length(p)) AS BIGINT) AS tail_chars FROM (SELECT DISTINCT url AS u, regexp_extract(url, '^.*/') AS p FROM pages) GROUP BY p")
def x18(spark, d):
    values = table(spark, d, "pages").select(F.col("url").alias("u")).distinct().withColumn("parent", F.regexp_extract("u", "^.*/", 0))
    return values.groupBy("parent").agg(F.count("*").alias("n"), F.sum(F.length("u") - F.length("parent")).cast("long").alias("tail_chars"))


@query("x20_split_long_words", f"WITH {_WORDS} SELECT DISTINCT substring(word, CAST(i * 8 + 1 AS INT), 8) AS piece FROM (SELECT word, unnest(range(0, (length(word) + 7) // 8)) AS i FROM w)")
def x20(spark, d):
    w = words(_docs(spark, d), "doc_id", "text").select("word").distinct()
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("word") + 7) / 8).cast("int") - 1), lambda i: F.substring(F.col("word"), i * 8 + 1, F.lit(8)))
    return w.select(F.explode(parts).alias("piece")).distinct()


@query("x21_frequency_renumbering", "SELECT p_type AS v, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS id FROM part GROUP BY p_type")
def x21(spark, d):
    n = table(spark, d, "part").groupBy(F.col("p_type").alias("v")).agg(F.count("*").alias("n"))
    return ranked(n, [F.desc("n"), "v"], "id").select("v", (F.col("id") - 1).cast("long").alias("id"))


@query("x23_bounded_pair_dictionary", "SELECT s_suppkey, s_name AS text, true AS bounded FROM supplier")
def x23(spark, d):
    """Pair merges whose tokens stand for at most 16 characters."""
    tokens, rules, _ = byte_pairs(table(spark, d, "supplier"), "s_suppkey", "s_name", rounds=5, longest=16)
    size: dict[int, int] = {}
    for a, b, c in rules:
        size[c] = size.get(a, 1) + size.get(b, 1)
    return expand(tokens, rule_table(spark, rules), "s_suppkey").withColumn("bounded", F.lit(max(size.values(), default=0) <= 16))


@query(
    "x24_context_classes",
    "WITH b AS (SELECT substring(p_name, CAST(i - 1 AS INT), 1) AS a, substring(p_name, CAST(i AS INT), 1) AS b FROM (SELECT p_name, unnest(range(2, length(p_name) + 1)) AS i FROM part)) SELECT CASE WHEN regexp_matches(a, '[a-z]') THEN 'lower' WHEN regexp_matches(a, '[A-Z]') THEN 'upper' WHEN regexp_matches(a, '[0-9]') THEN 'digit' WHEN a = ' ' THEN 'space' ELSE 'other' END AS context, b AS sym, count(*) AS n FROM b GROUP BY ALL",
)
def x24(spark, d):
    counts = pair_counts(table(spark, d, "part").select(F.split("p_name", "").alias("t")), "t")
    context = F.when(F.col("a").rlike("[a-z]"), "lower").when(F.col("a").rlike("[A-Z]"), "upper").when(F.col("a").rlike("[0-9]"), "digit").when(F.col("a") == " ", "space").otherwise("other")
    return counts.groupBy(context.alias("context"), F.col("b").alias("sym")).agg(F.sum("n").alias("n"))


def merge_losses(counts: DataFrame) -> DataFrame:
    """(a, b, loss): bits lost if the contexts a < b share one table; more than 256 contexts are an error, so all pairs are few."""
    if counts.select("context").distinct().limit(257).count() > 256:
        raise ValueError("more than 256 contexts")
    ent = lambda n, t: n * F.log2(t / n)
    totals = counts.groupBy("context").agg(F.sum("n").alias("t"))
    own = counts.join(totals, "context").groupBy("context", "t").agg(F.sum(ent(F.col("n"), F.col("t"))).alias("bits"))
    a, b = own.select(F.col("context").alias("a"), F.col("t").alias("ta"), F.col("bits").alias("ba")), own.select(F.col("context").alias("b"), F.col("t").alias("tb"), F.col("bits").alias("bb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    # Each side of a pair brings its own counts by an equi-join.
    sides = [pairs.join(counts, F.col("context") == F.col(side)).select("a", "b", "ta", "tb", "ba", "bb", "sym", "n") for side in ("a", "b")]
    both = sides[0].unionByName(sides[1]).groupBy("a", "b", "ta", "tb", "ba", "bb", "sym").agg(F.sum("n").alias("n"))
    joint = both.groupBy("a", "b", "ba", "bb").agg(F.sum(ent(F.col("n"), F.col("ta") + F.col("tb"))).alias("bits"))
    return joint.select("a", "b", F.round(F.col("bits") - F.col("ba") - F.col("bb"), 3).alias("loss"))


@query(
    "x25_context_merge_losses",
    "WITH c AS (SELECT p_brand AS context, substring(p_name, 1, 1) AS sym, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT context, sum(n) AS t FROM c GROUP BY context), o AS (SELECT context, t, sum(n * log2(t / n)) AS bits FROM c JOIN t USING (context) GROUP BY ALL), p AS (SELECT a.context AS a, b.context AS b, a.t + b.t AS t, a.bits + b.bits AS bits FROM o a JOIN o b ON a.context < b.context), m AS (SELECT p.a, p.b, p.t, p.bits, c.sym, sum(c.n) AS n FROM p JOIN c ON c.context = p.a OR c.context = p.b GROUP BY ALL) SELECT a, b, round(sum(n * log2(t / n)) - bits, 3) AS loss FROM m GROUP BY a, b, bits",
)
def x25(spark, d):
    return merge_losses(table(spark, d, "part").groupBy(F.col("p_brand").alias("context"), F.substring("p_name", 1, 1).alias("sym")).agg(F.count("*").alias("n")))


def merge_contexts(counts: dict[str, dict[str, int]], groups: int) -> dict[str, int]:
    """Group number of each context after merging, again and again, the two groups that lose the fewest bits; at most 256 contexts.

    Ties go to the groups whose least contexts come first.  Groups are numbered by their least context.
    """
    import numpy as np

    if len(counts) > 256:
        raise ValueError("more contexts than bytes have values")
    names = sorted(counts)
    symbols = sorted({s for c in counts.values() for s in c})
    place = {s: i for i, s in enumerate(symbols)}
    table_ = np.zeros((len(names), len(symbols)))
    for i, c in enumerate(names):
        for s, n in counts[c].items():
            table_[i, place[s]] = n
    bits = lambda t: t.sum(-1) * np.log2(np.maximum(t.sum(-1), 1)) - (t * np.log2(np.maximum(t, 1))).sum(-1)
    members = [[c] for c in names]
    loss = np.full((len(names), len(names)), np.inf)
    for i in range(len(names)):
        loss[i, i + 1 :] = bits(table_[i] + table_[i + 1 :]) - bits(table_[i]) - bits(table_[i + 1 :])
    while len(members) > max(groups, 1):
        i, j = divmod(int(np.argmin(np.round(loss, 6))), len(members))
        table_[i] += table_[j]
        members[i] += members.pop(j)
        table_ = np.delete(table_, j, 0)
        loss = np.delete(np.delete(loss, j, 0), j, 1)
        mine = bits(table_[i] + table_) - bits(table_[i]) - bits(table_)
        loss[:i, i], loss[i, i + 1 :] = mine[:i], mine[i + 1 :]
    return {c: g for g, m in enumerate(sorted(members, key=min)) for c in m}


@query("x25b_context_groups")
def x25b(spark, d):
    """Contexts (the character class or byte before) of all bytes of the urls, merged down to 16, 8 and 4 groups.

    Spark counts pairs; the merging works on at most 256 x 256 counts.
    """
    raw = table(spark, d, "pages").select(F.regexp_extract_all(F.hex(F.col("url").cast("binary")), F.lit("[0-9A-F]{2}"), F.lit(0)).alias("t"))
    counts: dict[str, dict[str, int]] = {}
    for r in pair_counts(raw, "t").collect():  # at most 65,536 rows
        counts.setdefault(r.a, {})[r.b] = r.n
    rows = [(k, c, g) for k in (16, 8, 4) for c, g in merge_contexts(counts, k).items()]
    return spark.createDataFrame(rows, "groups int, context string, grp int")


@query("x26_grammar_size_search")
def x26(spark, d):
    part = table(spark, d, "part")
    _, _, ledger = byte_pairs(part, "p_partkey", "p_name", rounds=3, a_round=32)
    rows = spark.createDataFrame([(r["rules"], r["tokens"], r["cost"]) for r in ledger], "rules int, tokens long, cost long")
    return rows.withColumn("smallest", F.col("cost") == F.min("cost").over(Window.partitionBy()))


@query("x27_prefix_cover_candidates", "SELECT substring(url, 1, CAST(k AS INT)) AS prefix, count(*) AS n, (count(*) - 1) * k AS saving FROM pages, (SELECT unnest(range(3, 97)) AS k) WHERE length(url) >= k GROUP BY k, 1 HAVING count(*) >= 4")
def x27(spark, d):
    lengths = F.explode(F.sequence(F.lit(3), F.least(F.length("url"), F.lit(96)))).alias("k")
    each = table(spark, d, "pages").where(F.length("url") >= 3).select("url", lengths).select("k", F.substring(F.col("url"), F.lit(1), F.col("k")).alias("prefix"))
    return each.groupBy("k", "prefix").agg(F.count("*").alias("n")).where("n >= 4").select("prefix", "n", ((F.col("n") - 1) * F.col("k")).alias("saving"))
