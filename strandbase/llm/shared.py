"""The folder that driver and executors share, and files that tasks write there.

Everything an operator keeps between two jobs goes to the folder named by
``spark.checkpoint.dir``.  Only where that is unset (tests, a single machine)
a fresh local folder takes its place.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; also makes ``checkpoint()`` use it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        key = sc.applicationId
        if key not in _FALLBACK:
            _FALLBACK[key] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        root = _FALLBACK[key]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd", under: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder (in its subfolder ``under``) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{under}/{name}-{uuid.uuid4().hex}" if under else fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a shared path that no later job reads, so that what an operator leaves is what its result reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def make_folder(spark: SparkSession, path: str) -> str:
    """Create a shared folder that tasks then put files into."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    return path


def _posix(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put_file(uri: str, chunks: list) -> None:
    """Write one file whole or not at all, so that a repeated task attempt is harmless."""
    path = _posix(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(inner) as out:
            for chunk in chunks:
                out.write(memoryview(chunk).cast("B"))
        return
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        for chunk in chunks:
            out.write(memoryview(chunk).cast("B"))
    os.replace(part, path)


def local_file(uri: str) -> tuple[str, bool]:
    """(a path of ``uri`` that can be memory-mapped, whether it is a copy): itself on a mounted store, else a copy in the process's own folder."""
    path = _posix(uri)
    if path is not None:
        return path, False
    from pyarrow import fs

    copy = os.path.join(tempfile.gettempdir(), f"mapped-{os.getpid()}-{uuid.uuid5(uuid.NAMESPACE_URL, uri).hex}")
    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(inner) as src, open(copy, "wb") as out:
        while block := src.read(1 << 22):
            out.write(block)
    return copy, True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
