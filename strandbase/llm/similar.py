"""Exact similarity inside candidate groups: which texts of a group are near copies.

A group (of SimHash links, say) is only a set of candidates.  Its distinct texts
become sorted sets of word-shingle hashes, which are compared exactly.  A group that
fits a cell of bounded sets and bytes is compared there, each set with each.  A larger
group is dealt over cells, so it is shared among tasks, in two steps:

1. Every set is compared with a few pivots of its group.  The sets similar to the pivot
   that has most of them are *settled*: they are in one component, whatever else they
   are similar to.
2. Only the sets that are not settled are compared with all sets of the group.

So a group of near copies costs a few comparisons a text, not its square; no
component is lost, since a pair of settled sets could only join what is joined.
Cells count shared shingles in tiles of bounded size and give spanning edges of the
pairs that pass, never the pairs.

Sets without shingles are similar to each other and to nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import spanning
from .shared import materialise
from .vectext import shingle_hashes, slices, string_parts, word_hashes

#: Sets, and their bytes, on a side of a cell.
CELL_ROWS = 1024
CELL_BYTES = 16 << 20
#: Shingles of one tile of counts.
TILE = 4096
#: Sets of a large group that all others are compared with first.
PIVOTS = 8
#: Large groups (a row of a few numbers each) that are broadcast.
MOST_BROADCAST = 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles of ``words`` words, A-Z in lower case, in order."""
    found, before = shingle_hashes(*word_hashes(data, offsets), words)
    return [np.unique(found[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``left``, place in ``right``) of all pairs of sets with that Jaccard similarity or more."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    column = []
    for k in (0, 1):
        place = np.searchsorted(shared, flat[k])
        inside = place < len(shared)
        inside[inside] = shared[place[inside]] == flat[k][inside]
        order = np.argsort(place[inside], kind="stable")
        column.append((place[inside][order], owner[k][inside][order]))
    both = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact up to 16 million shared shingles a tile
    total = np.zeros(both.shape, np.int64)
    for lo in range(0, len(shared), TILE):
        side = []
        for (at, who), n in zip(column, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, (lo, lo + TILE))
            tile = np.zeros((n, min(TILE, len(shared) - lo)), np.float32)
            tile[who[a:b], at[a:b] - lo] = 1
            side.append(tile)
        np.matmul(side[0], side[1].T, out=both)
        total += both.astype(np.int64)
    return np.nonzero(total * (1 + similarity) >= similarity * (sizes[0][:, None] + sizes[1][None, :]) - 1e-9)


def similar_edges(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (u, v) that connect exactly the similar texts of each group; ``texts`` is (grp long, key long, text).

    ``key`` tells texts apart; a text that comes more than once counts once.
    """
    spark = texts.sparkSession

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(*string_parts(part.column("text")), words)]
                yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("key"), pa.array(sets, pa.binary())], ["grp", "key", "shingles"])

    made = texts.select("grp", "key", "text").mapInArrow(to_sets, "grp long, key long, shingles binary")
    sets = materialise(made.groupBy("grp", "key").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    large = materialise(_cells_of(sets).where("k > 1"), "large-groups")
    number = large.count()
    small = lambda df: F.broadcast(df) if number <= MOST_BROADCAST else df
    if not number:
        return compared(sets.select("grp", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("first"), "key", "shingles"), similarity).select("u", "v").distinct()
    whole = sets.join(small(large), "grp", "left_anti").select("grp", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("first"), "key", "shingles")
    dealt = sets.join(small(large), "grp").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    least = dealt.groupBy("grp").agg(F.array_distinct(F.array(*(F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(PIVOTS)))).alias("keys"))
    pivots = dealt.join(least.select("grp", F.explode("keys").alias("key")), ["grp", "key"])
    pivots = pivots.select("grp", every("k").alias("lo"), F.lit(-1).alias("hi"), F.lit(False).alias("first"), "key", "shingles")
    stars = compared(dealt.select("grp", F.col("mine").alias("lo"), F.lit(-1).alias("hi"), F.lit(True).alias("first"), "key", "shingles").unionByName(pivots), similarity, spanned=False)
    stars = materialise(stars, "pivot-links")
    best = stars.groupBy("grp", "v").count().groupBy("grp").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    best = materialise(best, "best-pivots")
    settled = stars.join(small(best), ["grp", "v"]).select("grp", F.col("u").alias("key")).unionByName(best.select("grp", F.col("v").alias("key")))
    rest = materialise(dealt.join(settled, ["grp", "key"], "left_anti"), "unsettled-sets")
    rows = materialise(_cells_of(rest).withColumnRenamed("k", "r"), "unsettled-groups")
    mine = F.pmod(F.xxhash64("key", F.lit(1)), F.col("r")).cast("int")
    ours = rest.join(small(rows), "grp").select("grp", (-1 - mine).alias("lo"), every("k").alias("hi"), F.lit(True).alias("first"), "key", "shingles")
    others = dealt.join(small(rows), "grp").select("grp", every("r").alias("row"), "mine", "key", "shingles")
    others = others.select("grp", (-1 - F.col("row")).alias("lo"), F.col("mine").alias("hi"), F.lit(False).alias("first"), "key", "shingles")
    found = compared(whole.unionByName(ours).unionByName(others), similarity)
    return found.select("u", "v").unionByName(stars.select("u", "v")).distinct()


def _cells_of(sets: DataFrame) -> DataFrame:
    """(grp, k): into how many cells of bounded size each group goes."""
    return sets.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(F.octet_length("shingles")) / CELL_BYTES)).cast("int").alias("k"))


def compared(cells: DataFrame, similarity: float, spanned: bool = True) -> DataFrame:
    """(grp, u, v) of the similar sets of each cell (grp, lo, hi): the rows that are ``first`` against the others, or each with each where lo = hi.

    Spanning edges only, or all pairs (with ``u`` a first) if not ``spanned``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        held: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            keys, sets_ = [np.array(held[0], np.int64), np.array(held[2], np.int64)], [held[1], held[3]]
            if cell[1] == cell[2]:  # one side against itself
                keys[1], sets_[1] = keys[0], sets_[0]
            if len(keys[0]) and len(keys[1]) and (cell[1] != cell[2] or len(keys[0]) > 1):
                i, j = similar_pairs(*sets_, similarity)
                a, b = keys[0][i], keys[1][j]
                u, v = a[a != b], b[a != b]
                if spanned:
                    u, v = spanning(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), cell[0], np.int64)), pa.array(u), pa.array(v)], ["grp", "u", "v"])

        for batch in batches:
            grp, lo, hi, first, key = (batch.column(c).to_pylist() for c in ("grp", "lo", "hi", "first", "key"))
            for n, s in enumerate(batch.column("shingles")):
                now = (grp[n], lo[n], hi[n])
                if now != cell:
                    if cell is not None:
                        yield from flush()
                    cell, held = now, ([], [], [], [])
                side = 0 if first[n] else 2
                held[side].append(key[n])
                held[side + 1].append(np.frombuffer(s.as_py(), np.uint64))
        if cell is not None:
            yield from flush()

    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = cells.repartition(parts, "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    return dealt.mapInArrow(compare, "grp long, u long, v long")
