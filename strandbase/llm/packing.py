"""Operator 4, packing: documents into sequences of at most ``length`` tokens with balanced attention cost.

A document's tokens and one end id are cut into pieces.  Whole sequences' worth
are sequences of their own; what is left of each document (shorter than a
sequence) is packed: the cost of a piece of n tokens is estimated as
``linear * n + quadratic * n * n``, and in descending order of length each goes
to the sequence of lowest cost that has room for all of it.  What finds no room
whole is cut over the sequences with the most room left, so that every group
fills its sequences but for less than one.

Documents are dealt to groups by a hash of their id and text, rows that are repeated
whole by a hash of their place besides; a group holds a bounded number of tokens
(or one longer document) whatever the input's size, and groups pack independently.
The number of groups grows with the input.

Null texts are empty documents (one end id); null and repeated ids keep a piece
list for each row; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .tokencount import encoder, texts_of
from .vectext import slices

LENGTH = 2048
GROUP_BYTES = 8 << 20


def pack_lengths(sizes: np.ndarray, length: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pack items of 1 .. length - 1 tokens; gives (item, start in it, size, sequence, offset there).

    Items go in descending size, ties by position, to the cheapest sequence with room,
    ties to the lowest number.  The sequences are as few as can hold all tokens.
    """
    total = int(sizes.sum())
    number = -(-total // length)
    room = np.full(number, length, np.int64)
    cost = np.zeros(number)
    out = []
    price = lambda n: linear * n + quadratic * n * n
    heap = [(0.0, s) for s in range(number)]
    left: list[int] = []
    order = np.argsort(-sizes, kind="stable").tolist()
    whole = sizes.tolist()
    # Sizes fall, so a sequence that lacks room for this item may have it for a later one: it waits in a
    # list by room and returns when the items are small enough.
    waiting: list[tuple[int, int]] = []
    for item in order:
        n = whole[item]
        while waiting and -waiting[0][0] >= n:
            _, s = heapq.heappop(waiting)
            heapq.heappush(heap, (cost[s], s))
        while heap and room[heap[0][1]] < n:
            _, s = heapq.heappop(heap)
            if room[s]:
                heapq.heappush(waiting, (-int(room[s]), s))
        if not heap:
            left.append(item)
            continue
        _, s = heapq.heappop(heap)
        out.append((item, 0, n, s, length - int(room[s])))
        room[s] -= n
        cost[s] += price(n)
        if room[s]:
            heapq.heappush(heap, (cost[s], s))
    rooms = [(-int(r), s) for s, r in enumerate(room) if r]
    heapq.heapify(rooms)
    for item in left:
        start, n = 0, whole[item]
        while n:
            r, s = heapq.heappop(rooms)
            take = min(n, -r)
            out.append((item, start, take, s, length - int(room[s])))
            room[s] -= take
            start, n = start + take, n - take
            if room[s]:
                heapq.heappush(rooms, (-int(room[s]), s))
    return out


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, groups: int, id_column: str, text_column: str) -> DataFrame:
    """(group, id, tie, ids): ids as little-endian unsigned integers of 2 or 4 bytes, the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = ids_of(texts_of(part.column("text")))
                ids = np.insert(ids, offsets[1:], ids.dtype.type(end_id))
                offsets = (offsets + np.arange(len(offsets))) * ids.itemsize
                blob = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("id"), part.column("tie"), blob], ["grp", "id", "tie", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    tie = F.xxhash64(F.col(id_column), F.col(text_column))
    rows = docs.select(F.col(id_column).alias("id"), tie.alias("tie"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # Rows are dealt by id and text, repeated ones by their place in a written table besides, which a lost executor doesn't change.
    repeated = materialise(rows.groupBy("id", "tie").count().where("count > 1").select(F.col("tie").alias("again")).distinct(), "repeated-rows")
    grp = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("grp")
    slim = rows.select(grp("tie"), "id", "tie", "text")
    if repeated.head(1):
        copies = materialise(rows.join(repeated, F.col("tie") == F.col("again"), "left_semi").withColumn("place", F.monotonically_increasing_id()), "copies")
        single = slim.join(repeated, F.col("tie") == F.col("again"), "left_anti")
        slim = single.unionByName(copies.select(grp("tie", "place"), "id", "tie", "text"))
    return slim.mapInArrow(encode, f"grp int, id {kind}, tie long, ids binary")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, length: int = LENGTH, group_bytes: int = GROUP_BYTES, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids as array of int])."""
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    groups = max(1, -(-int(size) // group_bytes))
    tokens = tokenised(docs, tokenizer, end_id, groups, id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def group_rows(grp: int, ids: list, ties: list, blobs: list[bytes], unit) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, ties[i]))
        arrays = [np.frombuffer(blobs[i], unit) for i in order]
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        pieces = []  # (document, start, length, sequence, offset)
        number = 0
        for d, n in enumerate((sizes // length).tolist()):
            for k in range(n):
                pieces.append((d, k * length, length, number, 0))
                number += 1
        rest = np.flatnonzero(sizes % length)
        for item, start, n, s, offset in pack_lengths(sizes[rest] % length, length):
            d = int(rest[item])
            pieces.append((d, int(sizes[d]) // length * length + start, n, number + s, offset))
        cut = [arrays[d][start : start + n] for d, start, n, _, _ in pieces]
        columns = [
            pa.array([ids[order[p[0]]] for p in pieces]),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([zlib.crc32(c.astype("<u4")) for c in cut], pa.int64()),
            pa.array([int(sizes[p[0]]) for p in pieces], pa.int64()),
            pa.array([(grp << 32) + p[3] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
        ]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([p[2] for p in pieces]))).astype(np.int32), np.concatenate(cut).astype(np.int32)))
        return pa.RecordBatch.from_arrays(columns, names)

    def pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = encoder(tokenizer).kind
        now, held = None, ([], [], [])
        for batch in batches:
            for grp, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if grp != now and held[0]:
                    yield group_rows(now, *held, unit)
                    held = ([], [], [])
                now = grp
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if held[0]:
            yield group_rows(now, *held, unit)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    packed = tokens.repartition(groups, "grp").sortWithinPartitions("grp").mapInArrow(pack_groups, schema)
    return packed.withColumnRenamed("id", id_column)
