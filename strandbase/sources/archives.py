"""Archives of many members as tables, manifests that are checked against the data, and files that appear whole or not at all."""

from __future__ import annotations

import hashlib
import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import table
from ..plans.paths import scratch
from ..registry import query
from .framing import members, read_members
from .tables import read_manifest


def archived(df: DataFrame, kind: str = "zip") -> DataFrame:
    """(path, content): an archive of the rows (path, member, body) of each path; a path's rows are few by the caller's choice."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        rows = sorted(zip(pdf["member"], pdf["body"], strict=True))
        if kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in rows:
                    z.writestr(zipfile.ZipInfo(name), bytes(body))
        else:
            with tarfile.open(fileobj=out, mode="w:gz") as t:
                for name, body in rows:
                    info = tarfile.TarInfo(name)
                    info.size = len(body)
                    t.addfile(info, io.BytesIO(bytes(body)))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})

    return df.select("path", "member", F.col("body").cast("binary").alias("body")).groupBy("path").applyInPandas(build, "path string, content binary")


def _put(uri: str, content: bytes) -> None:
    """Write under another name, then rename: readers see the whole file or none, and a repeated task attempt does no harm."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, inner)


def publish(files: DataFrame, folder: str) -> DataFrame:
    """Write files (path, content) into ``folder`` and give a receipt for each: (path, bytes, sha256), from a written table."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                _put(f"{folder}/{path}", bytes(content))
            digests = [hashlib.sha256(bytes(c)).hexdigest() for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "bytes": batch["content"].map(len), "sha256": digests})

    spark = files.sparkSession
    schema = "path string, bytes long, sha256 string"
    receipts = scratch(spark, "receipts")
    files.select("path", "content").mapInPandas(put, schema).write.parquet(receipts)
    return spark.read.schema(schema).parquet(receipts)


def write_manifest(entries: DataFrame, path: str) -> None:
    """Entries (name, bytes, sha256, rows), few by nature, as one JSON list."""
    listed = entries.agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "bytes", "sha256", "rows")))).alias("value"))
    listed.coalesce(1).write.text(path)


def verified(manifest: DataFrame, measured: DataFrame) -> DataFrame:
    """(name, verdict) for every name of either side: ok, missing, unlisted, or the first thing that differs."""
    m, d = manifest.alias("m"), measured.alias("d")
    verdict = F.when(F.col("d.name").isNull(), "missing").when(F.col("m.name").isNull(), "unlisted")
    for c in ("bytes", "rows", "sha256"):
        verdict = verdict.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"d.{c}")), c)
    return m.join(d, "name", "full").select("name", verdict.otherwise("ok").alias("verdict"))


def _page_files(spark, d, ending: str) -> DataFrame:
    block = F.concat(F.lit("block-"), F.floor(F.col("page_id") / 100).cast("string"), F.lit(ending))
    return table(spark, d, "pages").select(block.alias("path"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.col("html").alias("body"))


@query("s6_zip_members", "SELECT 'block-' || (page_id // 100) || '.zip' AS archive, 'pages/' || page_id || '.html' AS member, sha256(html) AS digest FROM pages")
def s6(spark, d):
    """Every member of archives that were written to files and read again."""
    folder = scratch(spark, "archives")
    publish(archived(_page_files(spark, d, ".zip")), folder)
    found = read_members(spark, f"{folder}/*.zip")
    return found.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "member", F.sha2("content", 256).alias("digest"))


@query("s7_tar_member_by_name", "SELECT 'block-' || (page_id // 100) || '.tar.gz' AS archive, 'pages ' || count(*) AS content FROM pages GROUP BY ALL")
def s7(spark, d):
    """One member of each archive, chosen by its base name, which is to be there exactly once."""
    pages = _page_files(spark, d, ".tar.gz")
    notes = pages.groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit("notes/ABOUT").alias("member"), F.concat(F.lit("pages "), F.col("n").cast("string")).alias("body"))
    found = members(archived(pages.unionByName(notes), "tar.gz"), "tar.gz", basename="ABOUT")
    return found.select("archive", F.col("content").cast("string").alias("content"))


def _named_columns(spark, d) -> DataFrame:
    """(name, rows, bytes, sha256) of two fixed tables of a few rows."""
    out = []
    for name, key, value in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")):
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(value).alias("v")))), lambda x: x["v"]), "\n")
        whole = table(spark, d, name).agg(body.alias("body"), F.count("*").alias("rows"))
        out.append(whole.select(F.lit(name).alias("name"), F.octet_length("body").cast("long").alias("bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), "rows"))
    return out[0].unionByName(out[1])


@query(
    "s11_manifest_check",
    """WITH n AS (SELECT 'region' AS name, string_agg(r_name, chr(10) ORDER BY r_regionkey) AS body, count(*) AS n FROM region UNION ALL SELECT 'nation', string_agg(n_name, chr(10) ORDER BY n_nationkey), count(*) FROM nation)
    SELECT name, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, sha256(body) AS sha256, n AS rows, 'ok' AS verdict FROM n""",
)
def s11(spark, d):
    """A manifest is written, read and held against what the tables hold."""
    path = scratch(spark, "manifest")
    measured = _named_columns(spark, d)
    write_manifest(measured, path)
    manifest = read_manifest(spark, path)
    return manifest.join(verified(manifest, measured), "name").select("name", "bytes", "sha256", "rows", "verdict")


@query("s16_archive_receipts", "SELECT 'block-' || (page_id // 100) || '.zip' AS path, true AS same_bytes, count(*) AS n_members FROM pages GROUP BY ALL")
def s16(spark, d):
    """Receipts of archives against the files that a reader finds."""
    folder = scratch(spark, "archives")
    receipts = publish(archived(_page_files(spark, d, ".zip")), folder)
    files = spark.read.format("binaryFile").load(f"{folder}/*.zip").select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "length", F.sha2("content", 256).alias("digest"))
    counts = read_members(spark, f"{folder}/*.zip").groupBy(F.regexp_extract("archive", "[^/]*$", 0).alias("name")).agg(F.count("*").alias("n_members"))
    both = receipts.join(files, F.col("path") == F.col("file"), "full").join(counts, F.col("path") == F.col("name"), "left")
    same = F.coalesce((F.col("bytes") == F.col("length")) & (F.col("sha256") == F.col("digest")), F.lit(False))
    return both.select("path", same.alias("same_bytes"), "n_members")
