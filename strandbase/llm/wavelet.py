"""Operator 10, token-id output: a wavelet matrix in one compressed file for each shard of ids.

``write_shards`` range-partitions documents by id, encodes them and writes runs of
about ``shard_tokens`` ids as wavelet matrices: one plane of bits for each bit of
the id, from the highest down, each followed by a stable partition on that bit,
with a running count of ones at every 512th bit.  ``WaveletMatrix`` answers
``access``, ``rank`` (occurrences before a place) and ``select`` (the place of the
k-th occurrence) from these planes alone.

A shard is one row of a Parquet table written by Spark, so a lost executor's
files are written again and a partial file is never seen; Parquet compresses it.

Null texts are empty documents (only the end id); rows of one id follow each other
in the order of a hash of their text, null ids come first; extra columns are
ignored; an empty table writes no shard and reads back as an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_path
from .tokencount import encoder, texts_of
from .vectext import slices

SHARD_TOKENS = 1 << 20
BLOCK = 512
_HEAD = struct.Struct("<4sIQQ")


class WaveletMatrix:
    """A sequence of integers below 2 ** levels, as bit-planes with rank and select support."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.planes, self.ones = n, planes, ones
        self.levels = len(planes)
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        n, planes, ones = len(values), [], []
        padded = -(-n // BLOCK) * BLOCK
        for level in range(levels - 1, -1, -1):
            bits = (values & values.dtype.type(1 << level)).astype(bool)
            whole = np.zeros(padded, bool)
            whole[:n] = bits
            planes.append(np.packbits(whole, bitorder="little"))
            ones.append(np.concatenate(([0], np.cumsum(whole.reshape(-1, BLOCK).sum(1)))).astype(np.uint32))
            values = np.concatenate((values[~bits], values[bits]))
        return cls(n, planes, ones)

    def to_bytes(self) -> bytes:
        parts = [_HEAD.pack(b"WVM1", self.levels, self.n, BLOCK)]
        parts += [x.tobytes() for pair in zip(self.planes, self.ones, strict=True) for x in pair]
        return b"".join(parts)

    @classmethod
    def from_buffer(cls, data) -> WaveletMatrix:
        magic, levels, n, block = _HEAD.unpack_from(data, 0)
        if magic != b"WVM1" or block != BLOCK:
            raise ValueError("not a wavelet matrix")
        at, planes, ones = _HEAD.size, [], []
        blocks = -(-n // BLOCK)
        for _ in range(levels):
            planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
            ones.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
        return cls(n, planes, ones)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : (i + 7) >> 3]
        more = int(np.bitwise_count(part).sum()) if len(part) else 0
        if i & 7:
            more -= int(self.planes[level][i >> 3] >> (i & 7)).bit_count()
        return int(self.ones[level][block]) + more

    def _select(self, level: int, k: int, bit: int) -> int:
        """The place of the k-th (from 0) bit of this value."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            before = self._rank1(level, mid + 1)
            if (before if bit else mid + 1 - before) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value among the first i."""
        low = 0
        for level in range(self.levels):
            a, b = self._rank1(level, low), self._rank1(level, i)
            if value >> (self.levels - 1 - level) & 1:
                low, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, i = low - a, i - b
        return i - low

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 if there are fewer."""
        low, path = 0, []
        for level in range(self.levels):
            bit = value >> (self.levels - 1 - level) & 1
            ones = self._rank1(level, low)
            low = self.zeros[level] + ones if bit else low - ones
            path.append(bit)
        if k >= self.rank(value, self.n):
            return -1
        at = low + k
        for level in range(self.levels - 1, -1, -1):
            at = self._select(level, at - self.zeros[level], 1) if path[level] else self._select(level, at, 0)
        return at

    def access_and_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the value at each place, its occurrences before), many places at once: one pass down the planes."""
        at, low, value = places.astype(np.int64), np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for level in range(self.levels):
            plane = self.planes[level]
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)))
            padded = np.append(plane, np.uint8(0))

            def ones(i: np.ndarray, before=before, padded=padded) -> np.ndarray:
                return before[i >> 3] + np.bitwise_count(padded[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8))

            bit = (plane[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            a, b = ones(at), ones(low)
            at, low = np.where(bit, self.zeros[level] + a, at - a), np.where(bit, self.zeros[level] + b, low - b)
            value = value << 1 | bit
        return value, at - low

    def values(self, kind=np.uint16) -> np.ndarray:
        """The whole sequence, undoing the partitions from the lowest plane up."""
        out = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[~bits] = out[: self.zeros[level]]
            back[bits] = out[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            out = back
        return out


SCHEMA = "part int, shard int, n_docs long, n_tokens long, doc_ids array<{kind}>, doc_tokens array<int>, matrix binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, shard_tokens: int = SHARD_TOKENS, part_bytes: int = 16 << 20, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode all documents in ascending order of id and write one file of wavelet matrices for each range of ids."""
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    parts = max(1, -(-int(size) // part_bytes))
    kind = docs.schema[id_column].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        levels = max(1, (ids_of.library.get_vocab_size() - 1).bit_length())
        part, shard = TaskContext.get().partitionId(), 0
        held, owners, sizes, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(held), levels).to_bytes()
            columns = [[part], [shard], [len(owners)], [total]]
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            arrays += [pa.array([owners], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int32())), pa.array([matrix], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "shard", "n_docs", "n_tokens", "doc_ids", "doc_tokens", "matrix"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for piece in slices(batch, "text", 1 << 20):
                ids, offsets = ids_of(texts_of(piece.column("text")))
                ids = np.insert(ids, offsets[1:], ids.dtype.type(end_id))
                offsets = offsets + np.arange(len(offsets))
                held.append(ids)
                owners += piece.column("id").to_pylist()
                sizes += np.diff(offsets).tolist()
                total += len(ids)
                if total >= shard_tokens:
                    yield close()
                    shard += 1
                    held, owners, sizes, total = [], [], [], 0
        if owners:
            yield close()

    tie = F.xxhash64(F.col(text_column))
    slim = docs.select(F.col(id_column).alias("id"), tie.alias("tie"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(shards, SCHEMA.format(kind=kind)).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, id_column: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, first_id, first_id_rank) of every document, from the files; ``kind`` is the id's type.

    ``first_id`` is the document's first token, ``first_id_rank`` how often it stands before in its shard: both by the
    matrix's access and rank, without decoding.
    """
    table = spark.read.schema(SCHEMA.format(kind=kind)).parquet(path)
    # A row for each shard: its place among all ids.  Parts are summed first, so that no window sees all shards.
    per_part = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("part", "shard", "n_tokens").withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    starts = starts.join(per_part, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix.from_buffer(batch.column("matrix")[k].as_buffer())
                ids = matrix.values(np.uint16 if matrix.levels <= 16 else np.uint32)
                sizes = np.array(batch.column("doc_tokens")[k].values)
                ends = np.cumsum(sizes, dtype=np.int64)
                whole = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(whole[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                begin = ends - sizes
                # The first id of each document, and how often it stands before.
                first, earlier = matrix.access_and_rank(begin)
                columns = [begin, sizes.astype(np.int64), np.array(crc, np.int64), first, earlier]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take([k] * len(sizes)), batch.column("shard").take([k] * len(sizes)), batch.column("doc_ids")[k].values, *map(pa.array, columns)],
                    ["part", "shard", "id", "inner", "n_tokens", "ids_crc32", "first_id", "first_id_rank"],
                )

    read = table.select("part", "shard", "doc_ids", "doc_tokens", "matrix").mapInArrow(documents, f"part int, shard int, id {kind}, inner long, n_tokens long, ids_crc32 long, first_id long, first_id_rank long")
    out = read.join(starts, ["part", "shard"])
    return out.select(F.col("id").alias(id_column), (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "first_id", "first_id_rank")


def token_file(docs: DataFrame, **options) -> DataFrame:
    """Write the shards to a new path in the shared folder and read the documents' digests back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "wavelet")
    write_shards(docs, path, **options)
    id_column = options.get("id_column", "doc_id")
    return read_shards(spark, path, id_column, docs.schema[id_column].dataType.simpleString())
