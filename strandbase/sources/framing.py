"""Sources of byte-exact rows: line-feed, NUL and opaque framing, archives, ordered concatenation, bounded prefixes."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import lines, table
from ..plans.ordered import block_of, ranked, running_sum
from ..registry import query


def split_rows(df: DataFrame, id_column: str, text_column: str, delimiter: str = "\n") -> DataFrame:
    """(id, row_no, value): rows that keep their delimiter; a last row without one is kept, an empty remainder isn't a row."""
    parts = df.select(id_column, F.split(text_column, delimiter, -1).alias("parts"))
    each = parts.select(id_column, F.size("parts").alias("n"), F.posexplode("parts").alias("row_no", "part"))
    last = F.col("row_no") == F.col("n") - 1
    return each.where(~(last & (F.col("part") == ""))).select(id_column, "row_no", F.when(last, F.col("part")).otherwise(F.concat("part", F.lit(delimiter))).alias("value"))


def read_framed(spark: SparkSession, path: str, framing: str = "lf") -> DataFrame:
    """(file, row_id, value) of files under ``path``; framing lf, nul or none.

    Spark splits large files at delimiters by itself.  Its reader drops them, so they
    are put back, except on a file's last row if the file's length says there was none.
    """
    if framing == "none":
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("row_id"), F.col("content").alias("value"))
    delimiter = {"lf": "\n", "nul": "\0"}[framing]
    raw = spark.read.option("lineSep", delimiter).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("body"))
    totals = raw.groupBy("file").agg(F.sum(F.octet_length("body") + 1).alias("whole"), F.max(F.struct("at", "seq")).alias("last"))
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    known = totals.join(sizes, "file").select("file", "last", (F.col("whole") > F.col("length")).alias("open"))
    rows = raw.join(known, "file")
    bare = F.col("open") & (F.struct("at", "seq") == F.col("last"))
    rows = rows.withColumn("value", F.when(bare, F.col("body")).otherwise(F.concat("body", F.lit(delimiter).cast("binary"))))
    numbered = running_sum(rows.select("file", "at", "seq", "value"), F.struct("file", "at"), ["seq"], F.lit(1), "place")
    first = numbered.groupBy("file").agg(F.min("place").alias("first"))
    return numbered.join(first, "file").select("file", (F.col("place") - F.col("first")).alias("row_id"), "value")


def read_members(spark: SparkSession, path: str, kind: str = "zip", wanted: list[str] | None = None, basename: str | None = None) -> DataFrame:
    """(archive, member, content) of the archives at ``path``: see ``members``."""
    return members(spark.read.format("binaryFile").load(path).select("path", "content"), kind, wanted, basename)


def members(files: DataFrame, kind: str = "zip", wanted: list[str] | None = None, basename: str | None = None) -> DataFrame:
    """(archive, member, content) of zip or tar.gz archives (path, content).

    Repeated, unsafe and, if ``wanted`` is given, other members are errors.  With a
    ``basename`` only the member so called comes out, of which there must be one.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                if kind == "zip":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(i.filename, z.read(i), (i.external_attr >> 28) == 0xA) for i in z.infolist() if not i.is_dir()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                        found = [(m.name, t.extractfile(m).read() if m.isfile() else b"", not m.isfile()) for m in t if not m.isdir()]
                names = [n for n, _, _ in found]
                bad = [n for n, _, link in found if link or n.startswith("/") or ".." in n.split("/")]
                if bad or len(set(names)) < len(names) or (wanted is not None and set(names) != set(wanted)):
                    raise ValueError(f"{archive}: unexpected members {bad or names}")
                if basename is not None:
                    found = [f for f in found if f[0].rsplit("/", 1)[-1] == basename]
                    if len(found) != 1:
                        raise ValueError(f"{archive}: {len(found)} members are called {basename}")
                yield pd.DataFrame({"archive": archive, "member": [n for n, _, _ in found], "content": [c for _, c, _ in found]})

    return files.select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")


@query(
    "s1_lf_rows",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS row_no, CASE WHEN i < n THEN p || chr(10) ELSE p END AS value
    FROM (SELECT doc_id, len(ps) AS n, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))
    WHERE NOT (i = n AND p = '')""",
)
def s1(spark, d):
    return split_rows(table(spark, d, "documents"), "doc_id", "text")


@query(
    "s2_nul_rows",
    """SELECT conv_id, CAST(i - 1 AS INTEGER) AS row_no, octet_length(encode(p)) + CASE WHEN i < n THEN 1 ELSE 0 END AS n_bytes
    FROM (SELECT conv_id, len(ps) AS n, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i
      FROM (SELECT conv_id, string_split(string_agg(text, chr(1) ORDER BY turn), chr(1)) AS ps FROM conversations GROUP BY conv_id))
    WHERE NOT (i = n AND p = '')""",
)
def s2(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = turns.select("conv_id", F.array_join(F.col("t.text"), "\1").alias("text"))
    return split_rows(joined, "conv_id", "text", "\1").select("conv_id", "row_no", F.octet_length("value").cast("long").alias("n_bytes"))


@query("s3_opaque_scan", "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS digest FROM pages")
def s3(spark, d):
    return table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


def until_bytes(rows: DataFrame, row_id: str, size, limit: int, whole_last: bool = True) -> DataFrame:
    """Rows in order while what precedes them is less than ``limit`` bytes; or, not ``whole_last``, while they fit."""
    slim = rows.select(row_id, F.coalesce(size, F.lit(0)).cast("long").alias("__n"))  # the values themselves stay where they are
    run = running_sum(slim, block_of(row_id), [row_id], F.col("__n"), "before")
    return run.where(F.col("before") < limit if whole_last else F.col("before") + F.col("__n") <= limit).drop("__n")


@query(
    "s4_scan_with_byte_cap",
    """SELECT doc_id, CAST(before AS BIGINT) AS before FROM (SELECT doc_id, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, octet_length(encode(text)) AS n FROM documents)
    WHERE before + n <= 700000""",
)
def s4(spark, d):
    rows = table(spark, d, "documents")
    return until_bytes(rows, "doc_id", F.octet_length("text"), 700_000, whole_last=False).select("doc_id", F.col("before").cast("long").alias("before"))


def inflate(rows: DataFrame, row_id: str, size, limit: int) -> DataFrame:
    """All rows again and again, with the number of the copy, until ``limit`` bytes are reached."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    copies = -(-limit // total) if total else 0
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0))))) if copies else rows.limit(0).withColumn("copy", F.lit(0))
    run = running_sum(each, F.col("copy").cast("long") * (1 << 40) + block_of(row_id), [row_id], size, "before")
    return run.where(F.col("before") < limit)


@query(
    "s5_corpus_inflation",
    """WITH t AS (SELECT sum(octet_length(encode(c_name))) AS n FROM customer),
    r AS (SELECT c_custkey, copy, octet_length(encode(c_name)) AS n FROM customer, (SELECT unnest(range(0, CAST(ceil(100000.0 / n) AS BIGINT))) AS copy FROM t))
    SELECT c_custkey, CAST(copy AS INTEGER) AS copy, CAST(before AS BIGINT) AS before FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY copy, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) WHERE before < 100000""",
)
def s5(spark, d):
    return inflate(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", F.octet_length("c_name"), 100_000).select("c_custkey", "copy", F.col("before").cast("long").alias("before"))


@query(
    "s8_ordered_concat",
    """SELECT page_id, CAST(coalesce(sum(octet_length(encode(html)) + 1) OVER (ORDER BY url, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, octet_length(encode(html)) + 1 AS n_bytes FROM pages""",
)
def s8(spark, d):
    sizes = table(spark, d, "pages").select("url", "page_id", (F.octet_length("html") + 1).cast("long").alias("n_bytes"))
    return ranked(sizes, ["url", "page_id"], "start", F.col("n_bytes")).select("page_id", F.col("start").cast("long").alias("start"), "n_bytes")


@query(
    "s9_bounded_prefix",
    """SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(before AS BIGINT) AS before FROM (
      SELECT doc_id, i - 1 AS line_no, coalesce(sum(octet_length(encode(line)) + 1) OVER (ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT doc_id, unnest(ps) AS line, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)))
    WHERE before < 1000000""",
)
def s9(spark, d):
    return lines_until(table(spark, d, "documents"), 999_999)


_LINES = """SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(before AS BIGINT) AS before FROM (
      SELECT doc_id, i - 1 AS line_no, coalesce(sum(octet_length(encode(line)) + 1) OVER (ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT doc_id, unnest(ps) AS line, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)))"""


def lines_until(docs: DataFrame, most: int, row_id: str = "doc_id") -> DataFrame:
    """(row_id, line_no, before): lines that at most ``most`` bytes stand before.

    Sizes are summed over documents first; only texts that begin in time are cut into lines.
    """
    begins = until_bytes(docs, row_id, F.octet_length("text") + 1, most + 1).withColumnRenamed("before", "__base")
    each = lines(docs).select(row_id, "line_no", (F.octet_length("line") + 1).cast("long").alias("__n")).join(begins, row_id)
    w = Window.partitionBy(row_id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    run = each.withColumn("before", F.col("__base") + F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return run.where(F.col("before") <= most).select(row_id, "line_no", F.col("before").cast("long").alias("before"))


@query("s4b_scan_seven_megabytes", f"{_LINES} WHERE before <= 7000000")
def s4b(spark, d):
    """Lines until more than 7,000,000 bytes are read: the line that passes them is the last."""
    return lines_until(table(spark, d, "documents"), 7_000_000)


@query("s9b_hundred_megabyte_prefix", f"{_LINES} WHERE before < 100000000")
def s9b(spark, d):
    """Whole lines through the first that reaches 100 MB."""
    return lines_until(table(spark, d, "documents"), 99_999_999)
