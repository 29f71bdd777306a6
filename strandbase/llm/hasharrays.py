"""Sorted arrays of 64-bit keys with values, one file a shard, which workers memory-map.

A shard holds the keys with the same highest ``bits`` bits; its number grows with
the input, so that a shard's size doesn't.  Tasks send blocks of keys to the
shards, a reducer merges each shard and writes its file (``reduce_shards``), and
``Shards`` and ``CountArrays`` look up many keys at once.  Every shard has a file,
empty or not, and files carry their own sizes, so the driver holds nothing for
each shard.  A process keeps at most ``MOST_OPEN`` files mapped.

``CountArrays`` store a key in about 33 bits: its bits after the shard's name are
cut into a bucket (as many as keys / 16, whose beginnings are kept) and the 32
bits that follow, in order inside the bucket.  Two keys of a shard are taken for
one with a chance of about 2 ** -28.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import local_file, put_file

KEYS_A_SHARD = 1 << 21
MOST_OPEN = 512
U64 = np.uint64

_maps: OrderedDict[str, tuple[np.ndarray, str, bool]] = OrderedDict()


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file, memory-mapped; those used longest ago are let go, and copies of remote files deleted."""
    if uri not in _maps:
        path, copied = local_file(uri)
        _maps[uri] = (np.memmap(path, np.uint8, "r"), path, copied)
        while len(_maps) > MOST_OPEN:
            _, (_, old, was_copied) = _maps.popitem(last=False)
            if was_copied:
                os.unlink(old)
    _maps.move_to_end(uri)
    return _maps[uri][0]


def bits_for(keys: int, most: int = KEYS_A_SHARD) -> int:
    """The number of bits that name a shard, for about so many keys."""
    return max(0, (-(-max(keys, 1) // most) - 1).bit_length())


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def placed(home: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """``key`` with its highest bits from ``home``, which thus says the shard."""
    return key if not bits else (home >> U64(64 - bits) << U64(64 - bits)) | (key >> U64(bits))


def cuts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the runs in sorted keys."""
    if not len(keys):
        return
    shard = shard_of(keys, bits)
    edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    for a, b in zip(edge, [*edge[1:], len(keys)], strict=True):
        yield int(shard[a]), int(a), int(b)


def file_of(path: str, name: str, shard: int) -> str:
    return f"{path}/{name}-{shard:06d}.bin"


def _sections(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """A header of lengths in bytes, then the arrays, each from a multiple of eight."""
    out = [np.array([a.nbytes for a in arrays], U64)]
    for a in arrays:
        out += [np.ascontiguousarray(a), np.zeros(-a.nbytes % 8, np.uint8)]
    return [a for a in out if a.nbytes]


def _read_sections(whole: np.ndarray, kinds: list[np.dtype]) -> list[np.ndarray]:
    lengths = whole[: 8 * len(kinds)].view(U64).tolist()
    at, found = 8 * len(kinds), []
    for n, kind in zip(lengths, kinds, strict=True):
        found.append(whole[at : at + n].view(kind))
        at += -(-n // 8) * 8
    return found


class Shards:
    """Whole 64-bit keys with columns of the given kinds."""

    def __init__(self, path: str, name: str, bits: int, kinds: list):
        self.path, self.name, self.bits, self.kinds = path, name, bits, [np.dtype(k) for k in kinds]

    def write(self, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        put_file(file_of(self.path, self.name, shard), _sections([keys, *(v.astype(k, copy=False) for v, k in zip(values, self.kinds, strict=True))]))

    def arrays(self, shard: int) -> list[np.ndarray]:
        """[keys, values...] of one shard."""
        return _read_sections(mapped(file_of(self.path, self.name, shard)), [np.dtype(U64), *self.kinds])

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """[whether there, place in the shard, values...] for sorted keys; absent keys have value 0."""
        there, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        values = [np.zeros(len(keys), k) for k in self.kinds]
        for shard, a, b in cuts(keys, self.bits):
            have, *columns = self.arrays(shard)
            if not len(have):
                continue
            at = np.searchsorted(have, keys[a:b])
            at[at == len(have)] = 0
            hit = have[at] == keys[a:b]
            there[a:b], place[a:b] = hit, at
            for out, column in zip(values, columns, strict=True):
                out[a:b][hit] = column[at[hit]]
        return [there, place, *values]

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        """[whether there, values...] for keys in any order, each distinct one looked up once."""
        distinct, place = np.unique(keys, return_inverse=True)
        there, _, *values = self.find(distinct)
        return [x[place] for x in (there, *values)]


class CountArrays:
    """Keys of about 33 bits with ``width`` small non-negative counts each, most of which are alike.

    A byte names one of the most frequent rows of counts; the rest stand in lists of
    exceptions, in the order of the keys, one list for each width that holds a row,
    with their places: a lookup reads no more of a shard than it asks for.
    """

    #: A row that has no name of its own is in the list of its narrowest width: codes 253, 254 and 255.
    WIDTHS = [np.dtype(k) for k in (np.uint8, np.uint16, np.int64)]
    NAMED = 256 - len(WIDTHS)
    KINDS = [*(np.dtype(k) for k in (np.int64, np.uint32, np.uint32, np.uint8, np.int64)), *WIDTHS, *[np.dtype(np.uint32)] * len(WIDTHS)]

    def __init__(self, path: str, name: str, bits: int, width: int):
        self.path, self.name, self.bits, self.width = path, name, bits, width

    def _split(self, keys: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
        tail = keys << U64(self.bits) if self.bits else keys
        bucket = (tail >> U64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
        return bucket, ((tail << U64(bucket_bits)) >> U64(32)).astype(np.uint32)

    def write(self, shard: int, keys: np.ndarray, rows: np.ndarray) -> None:
        """``keys`` sorted and distinct, ``rows``: (keys, width)."""
        rows = rows.reshape(len(keys), self.width).astype(np.int64, copy=False)
        bucket_bits = max(0, (len(keys) // 16).bit_length() - 1)
        bucket, low = self._split(keys, bucket_bits)
        edges = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1)).astype(np.uint32)
        small = (rows < 1 << 16).all(1) if self.width > 1 else (rows[:, 0] < 1 << 62)
        joined = rows[:, 0].astype(U64)
        for k in range(1, self.width):
            joined = joined << U64(16) | rows[:, k].astype(U64)
        common, number = np.unique(joined[small], return_counts=True)
        common = common[np.argsort(-number, kind="stable")[: self.NAMED]]
        most = rows.max(1, initial=0)
        code = (self.NAMED + (most >= 1 << 8) + (most >= 1 << 16)).astype(np.uint8)
        if len(common):
            order = np.argsort(common)
            at = np.searchsorted(common[order], joined)
            at[at == len(common)] = 0
            hit = small & (common[order][at] == joined)
            code[hit] = order[at[hit]]
        table = np.zeros((len(common), self.width), np.int64)
        for k in range(self.width):
            table[:, k] = common >> U64(16 * (self.width - 1 - k)) & U64(0xFFFF) if self.width > 1 else common
        rest = [rows[code == self.NAMED + k].astype(kind) for k, kind in enumerate(self.WIDTHS)]
        places = [np.flatnonzero(code == self.NAMED + k).astype(np.uint32) for k in range(len(self.WIDTHS))]
        put_file(file_of(self.path, self.name, shard), _sections([np.array([bucket_bits], np.int64), edges, low, code, table, *rest, *places]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there, rows of counts) for sorted keys; absent keys have zeros."""
        there, out = np.zeros(len(keys), bool), np.zeros((len(keys), self.width), np.int64)
        for shard, a, b in cuts(keys, self.bits):
            head, edges, low, code, table, *rest = _read_sections(mapped(file_of(self.path, self.name, shard)), self.KINDS)
            if not len(low):
                continue
            bucket, want = self._split(keys[a:b], int(head[0]))
            begin, end = edges[bucket].astype(np.int64), edges[bucket + 1].astype(np.int64)
            # all queries halve their bucket together
            lo, hi = begin, end
            while True:
                open_ = lo < hi
                if not open_.any():
                    break
                mid = (lo + hi) >> 1
                less = open_ & (low[np.minimum(mid, len(low) - 1)] < want)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            at = np.minimum(lo, len(low) - 1)
            hit = (lo < end) & (low[at] == want)
            at = at[hit]
            found = np.zeros((len(at), self.width), np.int64)
            its = code[at]
            named = its < self.NAMED
            found[named] = table.reshape(-1, self.width)[its[named]]
            for k, (rows, places) in enumerate(zip(rest[: len(self.WIDTHS)], rest[len(self.WIDTHS) :], strict=True)):
                mine = its == self.NAMED + k
                if mine.any():
                    found[mine] = rows.reshape(-1, self.width)[np.searchsorted(places, at[mine])]
            there[a:b], out[a:b][hit] = hit, found
        return there, out

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for keys in any order, each distinct one looked up once."""
        distinct, place = np.unique(keys, return_inverse=True)
        there, rows = self.find(distinct)
        return there[place], rows[place]


def blank_shards(blocks: DataFrame, bits: int, **fixed) -> DataFrame:
    """A row for every shard with the columns of ``blocks``, null but for ``fixed``: so each shard is written, be it empty."""
    shards = blocks.sparkSession.range(0, 1 << bits, 1, max(1, (1 << bits) >> 12))
    value = lambda c: F.lit(fixed[c]) if c in fixed else F.col("id") if c == "shard" else F.lit(None)
    return shards.select(*(value(f.name).cast(f.dataType).alias(f.name) for f in blocks.schema.fields))


def reduce_shards(blocks: DataFrame, parts: int, merge: Callable[[tuple, list[dict]], Iterator[dict]], keys: list[str], schema: str) -> DataFrame:
    """All blocks with the same ``keys`` are given to ``merge`` together, as rows; it yields rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            for row in merge(now, held):
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    if held:
                        yield from close()
                    now, held = key, []
                held.append(row)
        if held:
            yield from close()

    return blocks.repartition(max(1, parts), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
