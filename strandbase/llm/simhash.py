"""Operator 7, SimHash near-duplicates by anchor-point covering.

Fingerprint: bit b is set if more than half of the XXH64 hashes (seed 42) of the
text's word shingles have it set; no words give zero.

Search: the 64 bits are cut into ``threshold // 2 + 1`` blocks, so that two
fingerprints within the threshold differ in at most one bit of some block.  In
each block the anchors are a covering code: the Hamming code of 15 bits (every
word lies within one bit of exactly one code word) beside the remaining bits as
they are.  A fingerprint has one *home*, the anchor that covers it, and is
replicated to every anchor within covering radius plus one that can be home to
a fingerprint one bit away.  Only homes are compared with the replicas at their
anchor, in blocks of bounded size, and pairs leave as spanning edges, so dense
anchors give few rows.  Anchors with many fingerprints are split over a grid of
salts, each cell of bounded size and compared apart; nothing is dropped.

Equal fingerprints are merged before the search and linked by it to the rest;
connected components of the links are the groups.  Null texts count as empty, and
all texts without words share fingerprint zero; null ids form no component id of
their own (the least non-null id of the group, else null); each input row gives
one row, repeated ids included; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spanning
from .shared import materialise
from .similar import similar_edges
from .vectext import LOWER, ranges, slices, string_parts, word_spans

PAIRS = 1 << 21
#: Fingerprints on each side of a cell.
HOT = 16_384
#: Rows of ids and keys, about 40 bytes each, that are broadcast.
MOST_BROADCAST = 200_000

# Hamming code of 15 bits: position i carries the column i + 1; the syndrome is the columns' sum.
_SYNDROME = np.zeros(1 << 15, np.int64)
for _bit in range(15):
    _SYNDROME[1 << _bit : 2 << _bit] = _SYNDROME[: 1 << _bit] ^ (_bit + 1)
_FLIP = np.concatenate(([0], 1 << np.arange(15)))
#: for each syndrome but zero the seven pairs of positions whose columns sum to it, as masks
_PAIRS_OF = np.array([[(1 << i - 1) | (1 << j - 1) for i in range(1, 16) for j in range(i + 1, 16) if i ^ j == s] if s else [0] * 7 for s in range(16)])


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """The fingerprint of each text of a batch."""
    starts, ends, before = word_spans(data, offsets)
    n = len(offsets) - 1
    words = np.diff(before)
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    spaced = np.full(int((sizes + 1).sum()), 32, np.uint8)
    spaced[ranges(begin, sizes)] = LOWER[data[ranges(starts, sizes)]]
    text = spaced.tobytes()
    number = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first = ranges(before[:-1], number)
    last = first + np.repeat(np.minimum(words, shingle), number) - 1
    digest = xxhash.xxh64_intdigest
    low, high = begin[first].tolist(), (begin[last] + sizes[last]).tolist()
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(low, high, strict=True)), np.uint64, len(first))
    owner = np.repeat(np.arange(n), number)
    counts = np.zeros((n, 64), np.int64)
    for lo in range(0, len(hashes), 1 << 17):
        part = hashes[lo : lo + (1 << 17)]
        mine = owner[lo : lo + len(part)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        counts[mine[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > number[:, None], axis=1, bitorder="little").view("<u8").ravel()


def blocks_of(threshold: int) -> list[tuple[int, int]]:
    """(shift, width) of blocks of which one holds at most one differing bit."""
    number = threshold // 2 + 1
    edges = [64 * k // number for k in range(number + 1)]
    if number > 4:
        raise ValueError("blocks of fewer than 15 bits: use a threshold of at most 7")
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row of the fingerprint, whether it is its home) for all replicas; prints as unsigned 64-bit."""
    out = []
    row = np.arange(len(prints))
    for number, (shift, width) in enumerate(blocks_of(threshold)):
        block = ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        word, rest = block & 0x7FFF, block >> 15
        syndrome = _SYNDROME[word]
        code = word ^ _FLIP[syndrome]
        base = number << 56
        out.append((base | rest << 15 | code, row, np.ones(len(row), bool)))
        off = np.flatnonzero(syndrome)
        for k in range(7):
            near = word[off] ^ _PAIRS_OF[syndrome[off], k]
            out.append((base | rest[off] << 15 | near, row[off], np.zeros(len(off), bool)))
        for bit in range(width - 15):
            out.append((base | (rest ^ (1 << bit)) << 15 | code, row, np.zeros(len(row), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compare(group: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges among the fingerprints of each group (rows sorted by group), homes against all, in bounded blocks."""
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(group)))
    homes = np.flatnonzero(home)
    mine = np.searchsorted(edge, homes, "right") - 1
    many = size[mine]
    homes, mine, many = homes[many > 1], mine[many > 1], many[many > 1]
    run = np.cumsum(many)
    at = 0
    while at < len(homes):
        done = run[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(run, done + PAIRS, "right")))
        other = ranges(edge[mine[at:to]], many[at:to])
        one = np.repeat(homes[at:to], many[at:to])
        close = (np.bitwise_count(prints[one] ^ prints[other]) <= threshold) & (prints[one] != prints[other])
        if close.any():
            yield spanning(prints[one[close]], prints[other[close]])
        at = to


def links(classes: DataFrame, threshold: int = 4) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints ``fp`` (distinct, as long) within the threshold."""
    spark = classes.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            anchor, row, home = anchors(prints, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    replicas = classes.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    sizes = replicas.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = materialise(sizes.select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("k")), "hot-anchors")
    number = hot.count()
    if number:
        small = F.broadcast(hot) if number <= 100_000 else hot
        k = F.coalesce("k", F.lit(1))
        mine = F.pmod(F.xxhash64("fp"), k).cast("int")
        # Grid of k x k: a home is compared with every column of replicas, a replica with every row of homes.
        split = replicas.join(small, "anchor", "left").withColumn("mine", mine).withColumn("k", k)
        as_home = split.where("home").select("anchor", "fp", "home", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"), "mine", "k")
        as_home = as_home.select("anchor", (F.col("mine") * F.col("k") + F.col("other")).alias("salt"), "fp", "home")
        as_other = split.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"), "mine", "k")
        as_other = as_other.select("anchor", (F.col("other") * F.col("k") + F.col("mine")).alias("salt"), "fp", "home")
        replicas = as_home.unionByName(as_other)
    else:
        replicas = replicas.withColumn("salt", F.lit(0))

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            anchor, salt, prints, home = (np.concatenate(x) for x in zip(*held, strict=True))
            change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            end = len(anchor) if last else int(change[-1]) if len(change) else 0
            group = np.zeros(end, np.int64)
            group[change[change < end]] = 1
            for a, b in compare(np.cumsum(group), prints[:end], home[:end], threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])
            held = [(anchor[end:], salt[end:], prints[end:], home[end:])]
            rows = len(anchor) - end

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "salt", "fp", "home")]
            held.append((cols[0], cols[1], cols[2].view(np.uint64), cols[3].astype(bool)))
            rows += batch.num_rows
            if rows > 1 << 19:
                yield from flush(False)
        if held:
            yield from flush(True)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = replicas.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(compare_all, "u long, v long").distinct()


def fingerprint_table(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tie, fp as long) for each row, kept in the shared folder; ``tie`` orders rows of one id."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = fingerprints(*string_parts(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(found.view(np.int64))], ["id", "tie", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("tie"), F.col(text_column).alias("text"))
    return materialise(slim.mapInArrow(prints, f"id {kind}, tie long, fp long"), "fingerprints")


def _groups(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, component, least): the component of each fingerprint, and its own least (id, tie), null ids last."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    classes = materialise(prints.groupBy("fp").agg(F.min(place).alias("least")), "classes")
    groups = components(links(classes, threshold)).withColumnRenamed("node", "fp")
    return classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row."""
    prints = fingerprint_table(docs, shingle, id_column, text_column)
    named = _groups(prints, threshold)
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    of = named.select("fp", "component").join(least, "component").select("fp", F.col("least.id").alias("component_id"))
    return prints.join(of, "fp").select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = 7, shingle: int = 2, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one, the one with the least id, of each group of near copies.

    Fingerprints of pairs of words find the candidates; near copies are those whose sets of
    shingles of ``words`` words have the Jaccard ``similarity`` or more, which is verified
    for every two distinct texts of a candidate group.  Groups are components of near copies.
    """
    prints = fingerprint_table(docs, shingle, id_column, text_column)
    linked = components(links(materialise(prints.select("fp").distinct(), "classes"), threshold)).withColumnRenamed("node", "fp")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    texts = prints.join(linked, "fp", "left").groupBy(F.coalesce("component", "fp").alias("grp"), "tie").agg(F.min(place).alias("least"))
    texts = materialise(texts.select("grp", "tie", F.col("least.id").alias("id")), "texts")
    several = materialise(texts.groupBy("grp").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a != b").select("grp"), "several")
    few = F.broadcast(several) if several.count() <= MOST_BROADCAST else several
    wanted = materialise(texts.join(few, "grp", "left_semi").select("grp", F.col("tie").alias("__key"), F.col("id").alias("__id")), "candidates")
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("key"), F.col(text_column).alias("text"))
    small = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    held = rows.join(small, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id"))).select("grp", "key", "text")
    copies = components(similar_edges(held, words, similarity)).withColumnRenamed("node", "tie")
    kept = texts.join(copies, "tie", "left").groupBy(F.coalesce("component", "tie").alias("grp"))
    kept = kept.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("least")).select(F.col("least.id").alias("__id"), F.col("least.tie").alias("__kept"))
    rows = docs.withColumn("__tie", F.xxhash64(F.col(text_column)))
    out = rows.join(kept, (F.col("__tie") == F.col("__kept")) & F.col(id_column).eqNullSafe(F.col("__id")), "left_semi")
    if prints.count() != prints.select("id", "tie").distinct().count():  # the same row twice or more
        out = out.dropDuplicates([id_column, "__tie"])
    return out.select(*docs.columns)
