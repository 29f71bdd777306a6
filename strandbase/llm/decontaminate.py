"""Operator 6, benchmark decontamination: a prefix-filtered set join with DataFrame operations only.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z go to lower case.  A
window is ``window`` consecutive words of an item (all of them, if it has fewer).
A document word is hit if it lies in an occurrence of a window.

1. Count how often each benchmark word occurs in the documents (repeats included),
   and order words by that rarity.
2. A document can hold a window only where it holds the window's rarest word: for
   full containment this prefix of one word is enough.  Document words are
   joined with the windows on it, in the order of the text.
3. The place of the rare word in the window bounds where the occurrence begins and
   ends; it must lie inside the document, and its words must equal the window's.

The windows are broadcast only if they are counted to be few (``most_broadcast``):
then one pass over the texts finds and verifies, and only hits are shuffled.
Beyond that, slim rows (document, place, word) are shuffled instead.

Null texts and texts without words have no words and are clean; an item without
words has no windows.  Windows that several items share are joined once and count
for each item.  Null ids are kept; rows with equal id and text get equal rows.
Extra columns are ignored.  Empty tables on either side give clean documents or
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

WINDOW = 10
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text in order; A-Z alone are changed, and pure ASCII takes the short way there."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, window: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """((wid, window as an array of words), each once; (wid, item), each once)."""
    words = items.select(F.col(id_column).cast("string").alias("item"), words_of(F.col(text_column)).alias("words")).where(F.size("words") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    each = words.withColumn("start", start).select("item", F.slice("words", F.col("start"), window).alias("window")).distinct()
    distinct = materialise(each.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return distinct, materialise(each.join(distinct, "window").select("wid", "item"), "window-items")


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _keyed_windows(words: DataFrame, windows: DataFrame, most_broadcast: int) -> DataFrame:
    """(word, at, wid, window): each window that can occur, by its rarest word and that word's place in it."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    each = words.select(F.explode("words").alias("word"))
    if _few(vocabulary, most_broadcast):
        counts = each.join(F.broadcast(vocabulary), "word").groupBy("word").count()
    else:
        counts = each.groupBy("word").count().join(vocabulary, "word", "left_semi")
    ranked = windows.select("wid", "window", F.posexplode("window").alias("at", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")).alias("r")
    keyed = ranked.groupBy("wid", "window").agg(rarest).where("r.n > 0")
    return materialise(keyed.select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), "wid", "window"), "window-keys")


def _found_by_broadcast(words: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc, tie, n_words, wid, s, e): a row for each document with its n_words, and one for each occurrence.

    One pass in the order of the text: the document's words are at hand where the
    rare word is found, so an occurrence is verified in the join itself.  The row of the
    empty word stands for the document: words[0] of every document is one.
    """
    mark = words.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("at"), F.lit(-1).cast("long").alias("wid"), F.array().cast("array<string>").alias("window"))
    marked = words.withColumn("words", F.concat(F.array(F.lit("")), "words"))
    each = marked.select("doc", "tie", "words", F.posexplode("words").alias("pos", "word"))
    start, size = F.col("pos") - F.col("at"), F.size("window")
    inside = (start >= 1) & (start + size <= F.size("words"))
    same = F.slice("words", F.greatest(start + 1, F.lit(1)), size) == F.col("window")
    is_mark = F.col("wid") < 0
    found = each.join(F.broadcast(keyed.unionByName(mark)), "word").where(is_mark | (inside & same))
    return found.select("doc", "tie", F.when(is_mark, F.size("words") - 1).cast("long").alias("n_words"), F.when(~is_mark, F.col("wid")).alias("wid"), start.alias("s"), (start + size).alias("e"))


def _found_by_shuffle(words: DataFrame, keyed: DataFrame) -> DataFrame:
    """The same where the windows are too many to broadcast: slim rows are joined, then verified in two more joins."""
    marks = words.select("doc", "tie", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("long").alias("wid"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    each = words.select("doc", "tie", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    near = keyed.select("word", "at", "wid", F.size("window").alias("size"))
    start = F.col("pos") - F.col("at")
    open_ = each.join(near, "word").where((start >= 0) & (start + F.col("size") <= F.col("n"))).select("doc", "tie", "wid", (start + 1).alias("s"), (start + F.col("size") + 1).alias("e")).distinct()
    texts = words.dropDuplicates(["doc", "tie"])
    got = open_.alias("o").join(texts.alias("w"), F.expr("o.doc <=> w.doc and o.tie = w.tie")).select("o.*", F.slice("w.words", F.col("s"), F.col("e") - F.col("s")).alias("got"))
    hits = got.join(keyed.select("wid", "window"), "wid").where("got = window").select("doc", "tie", F.lit(None).cast("long").alias("n_words"), "wid", "s", "e")
    return marks.unionByName(hits)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = 200_000, doc_id: str = "doc_id", item_id: str = "item_id", text_column: str = "text") -> DataFrame:
    """(doc_id, tie, n_words, n_hit, n_items, items_sha256, contaminated) for each document row; ``tie`` is a hash of its text."""
    windows, window_items = windows_of(items, window, item_id, text_column)
    words = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text_column)).alias("tie"), words_of(F.col(text_column)).alias("words"))
    keyed = _keyed_windows(words, windows, most_broadcast)
    find = _found_by_broadcast if _few(keyed, most_broadcast) else _found_by_shuffle
    found = materialise(find(words, keyed), "occurrences")

    span = F.when(F.col("wid").isNotNull(), F.struct("s", "e"))
    spans = found.groupBy("doc", "tie").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set(span)).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["e"]).alias("end"), (acc["n"] + F.greatest(s["e"] - F.greatest(acc["end"], s["s"]), F.lit(0))).alias("n")),
    )["n"]
    pairs = found.where("wid is not null").select("doc", "tie", "wid").distinct().join(window_items, "wid").select("doc", "tie", "item").distinct()
    lists = pairs.groupBy("doc", "tie").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = spans.select("doc", "tie", "n_words", "copies", covered.alias("n_hit")).alias("a").join(lists.alias("b"), F.expr("a.doc <=> b.doc and a.tie = b.tie"), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    rows = both.select(
        F.col("a.doc").alias(doc_id),
        F.col("a.tie").alias("tie"),
        "n_words",
        "n_hit",
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return rows.drop("copy")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each document row."""
    return report(docs, items, **options).drop("tie")


def clean_documents(docs: DataFrame, items: DataFrame, most_broadcast: int = 200_000, doc_id: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    found = report(docs, items, most_broadcast=most_broadcast, doc_id=doc_id, text_column=text_column, **options)
    leaks = materialise(found.where("contaminated").select(F.col(doc_id).alias("__id"), F.col("tie").alias("__leak")).distinct(), "leaks")
    leaks = F.broadcast(leaks) if _few(leaks, most_broadcast) else leaks
    rows = docs.withColumn("__tie", F.xxhash64(F.col(text_column)))
    return rows.join(leaks, (F.col("__tie") == F.col("__leak")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)
