"""Operator 1, LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark.

Tokens are runs of bytes other than ASCII white space, A-Z in lower case, then one
end token for each text; ``order - 1`` beginning marks stand before a text as
context only.  The highest order is counted as it is, lower orders by the number
of distinct tokens before them; each order has three discounts from its counts of
counts, and the lowest is interpolated with the uniform distribution over the
vocabulary and one unknown token.

Counting: a first pass counts words; a word's place in those sorted arrays is its
number in what follows.  Tasks then send n-grams, summed within the task, to shards
by the hash of their *pivot*: the words between the first and the last.  So a shard
has all n-grams of the contexts and of the shorter n-grams it meets, and trigrams
are shuffled once for both orders.  A pivot that is frequent enough to fill a
shard (its words' counts say so) is split over shards by the hash of the whole
n-gram; what its parts know of contexts and bigrams is summed in a round more.
Shards are written as sorted hash arrays of about five bytes an n-gram; workers
memory-map them and look up all tokens of a batch at once.  The driver sees
totals only; 64-bit counts throughout.

Null texts count as empty (one end token); null ids are learned from as those of
the id "" would be; each row is scored by itself, repeated rows count repeatedly;
extra columns are ignored; from an empty table nothing is learned, and all
probabilities are the uniform one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hasharrays import CountArrays, Shards, bits_for, blank_shards, cuts, placed, reduce_shards
from .shared import fresh_path, make_folder
from .vectext import combine, count_sorted, mix, slices, string_parts, word_hashes

U64 = np.uint64
END = U64(0x9AE16A3B2F90404F)
BEGIN = U64(0xC949C7DEFA7A3F1D)
FLUSH = 1 << 20
SHARD_KEYS = 1 << 21
#: A pivot that occurs more often is split.
PIVOT_KEYS = 1 << 19


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, the end token after each text; offsets of texts: n + 1)."""
    words, before = word_hashes(*string_parts(column))
    return np.insert(words, before[1:], END), before + np.arange(len(before))


def shifted(tokens: np.ndarray, offsets: np.ndarray, back: int, mark=BEGIN) -> np.ndarray:
    """For each token the one ``back`` places before it in its text, else the beginning mark."""
    if not back:
        return tokens
    out = np.full(len(tokens), mark, tokens.dtype)
    out[back:] = tokens[:-back]
    for k in range(back):
        at = offsets[:-1] + k
        out[at[at < offsets[1:]]] = mark
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _from_planes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U64)


def pack_block(columns: list[np.ndarray], counts: list[np.ndarray], bits: int) -> dict:
    """Rows of numbers below 2 ** bits with counts, in the order of the numbers: as many as fit are joined, the first are stored as differences."""
    joined: list[np.ndarray] = []
    room = 0
    for c in columns:
        if joined and room >= bits:
            joined[-1] = joined[-1] << U64(bits) | c
        else:
            joined.append(c)
            room = 64
        room -= bits
    order = np.lexsort(joined[::-1])
    joined = [c[order] for c in joined]
    joined[0] = np.diff(joined[0], prepend=U64(0))
    return {"parts": [_planes(c) for c in joined] + [_planes(c[order].astype(U64)) for c in counts], "rows": len(order)}


def unpack_blocks(rows: list[dict], width: int, counts: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, counts: one row for each) of all blocks."""
    columns: list[list[np.ndarray]] = [[np.zeros(0, U64)] for _ in range(width)]
    found = [np.zeros((0, counts), np.int64)]
    each = max(1, 64 // bits)
    for r in rows:
        numbers = [_from_planes(p, r["rows"]) for p in r["parts"]]
        numbers[0] = np.cumsum(numbers[0], dtype=U64)
        for k in range(width):
            last = min(width, (k // each + 1) * each) - 1
            columns[k].append(numbers[k // each] >> U64(bits * (last - k)) & U64((1 << bits) - 1))
        found.append(np.stack(numbers[-counts:], 1).astype(np.int64))
    return [np.concatenate(c) for c in columns], np.concatenate(found)


def runs(ordered: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    yield from zip([0, *edge.tolist()], [*edge.tolist(), len(ordered)], strict=True) if len(ordered) else ()


def sum_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, index of the first row of each, summed rows)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order[first], np.add.reduceat(rows[order], first, axis=0) if len(keys) else rows


def follower_rows(counts: np.ndarray) -> np.ndarray:
    """What each n-gram adds to its context: its count, and whether that is one, two, more."""
    return np.stack((counts, counts == 1, counts == 2, counts > 2), 1).astype(np.int64)


BLOCKS = "kind string, level int, shard int, parts array<binary>, rows int"
ROUND = BLOCKS + ", total long, n1 long, n2 long, n3 long, n4 long, more long"


@dataclass
class Words:
    """Words by their hashes, with training counts; a word's number is one more than its place, 0 is an unknown word."""

    arrays: Shards
    places: int  # bits of a place within a shard

    @property
    def bits(self) -> int:
        return self.arrays.bits + self.places + 1

    def numbers(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, training count) of each token."""
        distinct, at = np.unique(tokens, return_inverse=True)
        there, place, count = self.arrays.find(distinct)
        shard = distinct >> U64(64 - self.arrays.bits) if self.arrays.bits else np.zeros(len(distinct), U64)
        number = np.where(there, (shard << U64(self.places) | place.astype(U64)) + U64(1), U64(0))
        return number[at], count[at]

    def column(self, arrays: Shards, k: int, numbers: np.ndarray) -> np.ndarray:
        """Column ``k`` of arrays that stand in the order of the words, for known numbers."""
        distinct, at = np.unique(numbers, return_inverse=True)
        shard = (distinct - U64(1)) >> U64(self.places)
        place = ((distinct - U64(1)) & U64((1 << self.places) - 1)).astype(np.int64)
        out = np.zeros(len(distinct), np.int64)
        for a, b in runs(shard):
            out[a:b] = arrays.arrays(int(shard[a]))[k][place[a:b]]
        return out[at]


@dataclass
class Layout:
    """Which shard an n-gram of word numbers belongs to."""

    words: Words
    bits: int
    share: int = PIVOT_KEYS

    def splits(self, pivot: list[np.ndarray], counts: list[np.ndarray] | None = None) -> np.ndarray:
        """Over how many shards each pivot is split: its rarest word's count says how often it can occur."""
        if not self.bits:
            return np.ones(len(pivot[0]), np.int64)
        known = counts or [self.words.column(self.words.arrays, 1, p) for p in pivot]
        return np.minimum(-(-np.minimum.reduce(known) // self.share), 1 << self.bits)

    def home(self, pivot: list[np.ndarray], split: np.ndarray, key: np.ndarray) -> np.ndarray:
        """``key`` placed in its pivot's shard, or in one of those that the pivot is split over."""
        first = mix(combine(*pivot) + U64(0x2545F4914F6CDD1D))
        part = (key >> U64(20)) % np.maximum(split, 1).astype(U64)
        return placed(mix(first + part), key, self.bits)


@dataclass
class Model:
    """Arrays of each order and of contexts, the discounts, and the training totals."""

    order: int
    tokens: int
    vocabulary: int
    texts: int
    layout: Layout
    after: Shards  # by word: tokens before it, and as a context total, n1, n2, n3
    grams: dict[int, CountArrays]
    contexts: dict[int, CountArrays]
    split_grams: CountArrays
    split_contexts: dict[int, CountArrays]
    discounts: dict[int, tuple[float, float, float]]
    lowest: tuple[float, float]  # total of the lowest order's counts, weight of the uniform distribution

    def probabilities(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        numbers, counts = self.layout.words.numbers(tokens)
        return self.of_numbers(numbers, counts, offsets)

    def of_numbers(self, numbers: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p = np.full(len(numbers), 1.0 / (self.vocabulary + 1))
        total, spare = self.lowest
        if not total:
            return p
        words = self.layout.words
        begin = words.numbers(np.array([BEGIN]))[0][0]
        column = [shifted(numbers, offsets, k, begin) for k in range(self.order)]
        often = [shifted(counts, offsets, k, self.texts) for k in range(self.order)]

        def by_word(k: int, x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), np.int64)
            out[x > 0] = words.column(self.after, k, x[x > 0])
            return out

        p = self._kept(1, by_word(0, numbers)) / total + spare * p
        for k in range(2, self.order + 1):
            gram = column[k - 1 :: -1]  # oldest first
            if k == 2:
                stats = [by_word(j, gram[0]) for j in (1, 2, 3, 4)]
                there = stats[0] > 0
            else:
                there, rows = self._contexts_of(k, gram, often[k - 1 :: -1])
                stats = list(rows.T)
            total, n1, n2, n3 = stats
            d1, d2, d3 = self.discounts[k]
            n = self._counts_of(k, gram, often[k - 1 :: -1], there)
            weight = np.maximum(total, 1)
            p = np.where(there, self._kept(k, n) / weight + (d1 * n1 + d2 * n2 + d3 * n3) / weight * p, p)
        return p

    def _contexts_of(self, k: int, gram: list[np.ndarray], often: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        context = combine(*gram[:-1])
        split = self.layout.splits(gram[1:-1], often[1:-1])
        there, rows = self.contexts[k].of(self.layout.home(gram[1:-1], np.ones_like(split), context))
        many = np.flatnonzero(split > 1)
        if len(many):
            there[many], rows[many] = self.split_contexts[k].of(mix(context[many]))
        return there, rows

    def _counts_of(self, k: int, gram: list[np.ndarray], often: list[np.ndarray], there: np.ndarray) -> np.ndarray:
        """Counts of the n-grams whose context is there."""
        pivot, known = (gram[1:-1], often[1:-1]) if k > 2 else (gram[:1], often[:1])
        key = combine(*gram)
        split = self.layout.splits(pivot, known)
        n = np.zeros(len(key), np.int64)
        whole = k == self.order or k > 2
        one = np.flatnonzero(there & ((split <= 1) | whole))
        n[one] = self.grams[k].of(self.layout.home([p[one] for p in pivot], split[one], key[one]))[1][:, 0]
        many = np.flatnonzero(there & (split > 1) & (not whole))
        if len(many):
            n[many] = self.split_grams.of(mix(key[many]))[1][:, 0]
        return n

    def _kept(self, level: int, n: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[level]])
        return n - d[np.minimum(n, 3)]


def discounts_from(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts by counts of counts; where these are too few for the formula, half a count."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, offsets) of about FLUSH tokens at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        for part in slices(batch, "text"):
            held.append(tokens_of(part.column("text")))
            n += len(held[-1][0])
            if n >= FLUSH:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    before = np.cumsum([0, *(len(t) for t, _ in held)])
    return np.concatenate([t for t, _ in held]), np.concatenate([[0], *(o[1:] + b for (_, o), b in zip(held, before, strict=False))])


def count_words(docs: DataFrame, path: str, size: int) -> tuple[Words, int, int, int]:
    """(words, tokens, distinct words, texts) of the column ``text``; beginning marks are counted beside, one a text."""
    arrays = Shards(path, "words", bits_for(size // 32, SHARD_KEYS), [np.int64])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, offsets in token_batches(batches):
            keys, _, number = count_sorted(np.append(tokens, np.full(len(offsets) - 1, BEGIN)))
            rows = [(s, keys[a:b].tobytes(), _planes(number[a:b].astype(U64))) for s, a, b in cuts(keys, arrays.bits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])

    def merge(key: tuple, rows: list[dict]) -> Iterator[dict]:
        rows = [r for r in rows if r["keys"] is not None]
        keys = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r["keys"], U64) for r in rows)])
        counts = np.concatenate([np.zeros(0, U64), *(_from_planes(r["counts"], len(r["keys"]) // 8) for r in rows)]).astype(np.int64)
        keys, _, counts = count_sorted(keys, counts)
        arrays.write(key[0], keys, counts)
        begins = int(counts[keys == BEGIN].sum())
        yield {"n": len(keys), "tokens": int(counts.sum()) - begins, "texts": begins}

    blocks = docs.mapInArrow(count, "shard int, keys binary, counts binary")
    done = reduce_shards(blocks.unionByName(blank_shards(blocks, arrays.bits)), 1 << arrays.bits, merge, ["shard"], "n long, tokens long, texts long")
    r = done.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"), F.max("n").alias("most")).first()
    return Words(arrays, int(r.most).bit_length()), r.tokens, r.n - (r.texts > 0), r.texts


def train(docs: DataFrame, order: int = 3, text_column: str = "text") -> Model:
    """Count a model from all rows of ``docs``."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    path = make_folder(spark, fresh_path(spark, "ngrams"))
    slim = docs.select(F.col(text_column).alias("text"))
    size = int(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    words, tokens, vocabulary, texts = count_words(slim, path, size)
    bits = bits_for(tokens, SHARD_KEYS)
    layout = Layout(words, bits, PIVOT_KEYS)
    width = words.bits
    after = Shards(path, "after", words.arrays.bits, [np.int64] * 4)
    grams = {k: CountArrays(path, f"grams{k}", bits, 1) for k in range(2, order + 1)}
    contexts = {k: CountArrays(path, f"contexts{k}", bits, 4) for k in range(3, order + 1)}
    split_grams = CountArrays(path, "split-grams", bits, 1)
    split_contexts = {k: CountArrays(path, f"split-contexts{k}", bits, 4) for k in range(3, order + 1)}
    block_type = _arrow(BLOCKS)

    def blocks_by(keys: np.ndarray, columns: list[np.ndarray], rows: np.ndarray, kind: str, level: int, by: int = bits) -> Iterator[dict]:
        """Blocks for the shard that each key (sorted) names."""
        for shard, a, b in cuts(keys, by):
            yield {"kind": kind, "level": level, "shard": shard} | pack_block([c[a:b] for c in columns], list(rows[a:b].T), width)

    def gram_blocks(columns: list[np.ndarray], counts: np.ndarray | None, level: int, often: list[np.ndarray] | None = None) -> Iterator[dict]:
        """n-grams to their pivots' shards; the pivot's words stand first."""
        pivot, known = (columns[1:-1], often and often[1:-1]) if level > 2 else (columns[:1], often and often[:1])
        key = layout.home(pivot, layout.splits(pivot, known), combine(*columns))
        keys, first, total = count_sorted(key, counts)
        turned = [*columns[1:-1], columns[0], columns[-1]] if level > 2 else columns
        yield from blocks_by(keys, [c[first] for c in turned], total[:, None], "n", level)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = words.numbers(np.array([BEGIN]))[0][0]
        for found, offsets in token_batches(batches):
            numbers, counts = words.numbers(found)
            columns = [shifted(numbers, offsets, k, begin) for k in range(order - 1, -1, -1)]
            often = [shifted(counts, offsets, k, texts) for k in range(order - 1, -1, -1)]
            for row in gram_blocks(columns, None, order, often):
                yield pa.RecordBatch.from_pylist([row], schema=block_type)

    def word_rows(word: np.ndarray, rows: np.ndarray) -> Iterator[dict]:
        """Sums by word to the shards of words: tokens before it, then its figures as a context."""
        key, _, total = sum_by(word, rows)
        shard = (key - U64(1)) >> U64(words.places)
        for a, b in runs(shard):
            yield {"kind": "w", "level": 1, "shard": int(shard[a])} | pack_block([key[a:b]], list(total[a:b].T), width)

    def bigram_words(first: np.ndarray, last: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        """What distinct bigrams tell of their words."""
        none = np.zeros((len(first), 1), np.int64)
        as_context = np.concatenate((none, follower_rows(counts)), 1)
        before = np.concatenate((none + 1, np.zeros((len(last), 4), np.int64)), 1)
        yield from word_rows(np.concatenate((first, last)), np.concatenate((as_context, before)))

    def times(counts: np.ndarray) -> dict:
        return {"rows": len(counts), "total": int(counts.sum()), "more": int((counts > 2).sum())} | {f"n{k}": int((counts == k).sum()) for k in (1, 2, 3, 4)}

    def merge_grams(level: int, rows: list[dict], shard: int) -> Iterator[dict]:
        """n-grams of two words or more at their pivots: arrays are written, shorter n-grams passed on."""
        turned, counts = unpack_blocks(rows, level, 1, width)
        columns = [turned[-2], *turned[:-2], turned[-1]] if level > 2 else turned
        pivot = columns[1:-1] if level > 2 else columns[:1]
        split = layout.splits(pivot)
        keys, first, counts = sum_by(layout.home(pivot, split, combine(*columns)), counts)
        counts = counts[:, 0]
        columns, split = [c[first] for c in columns], split[first]
        grams[level].write(shard, keys, counts[:, None])
        yield {"kind": f"done{level}", "level": level, "shard": shard} | times(counts)
        if level == 2:
            yield from bigram_words(columns[0], columns[1], counts)
            return
        one = split <= 1
        context, at, stats = sum_by(combine(*columns[:-1]), follower_rows(counts))
        whole = one[at]
        key = layout.home([c[at][whole] for c in columns[1:-1]], split[at][whole], context[whole])
        order_ = np.argsort(key)
        contexts[level].write(shard, key[order_], stats[whole][order_])
        part = ~whole
        key = mix(context[part])
        order_ = np.argsort(key)
        yield from blocks_by(key[order_], [c[at][part][order_] for c in columns[:-1]], stats[part][order_], "c", level)
        suffix, at, before = sum_by(combine(*columns[1:]), np.ones((len(counts), 1), np.int64))
        shorter, before = [c[at] for c in columns[1:]], before[:, 0]
        if level > 3:
            yield from gram_blocks(shorter, before, level - 1)
            return
        whole = one[at]
        key = layout.home([shorter[0][whole]], split[at][whole], suffix[whole])
        order_ = np.argsort(key)
        grams[2].write(shard, key[order_], before[whole][order_][:, None])
        yield {"kind": "done2", "level": 2, "shard": shard} | times(before[whole])
        yield from bigram_words(shorter[0][whole], shorter[1][whole], before[whole])
        part = ~whole
        key = mix(suffix[part])
        order_ = np.argsort(key)
        yield from blocks_by(key[order_], [c[part][order_] for c in shorter], before[part][order_][:, None], "s", 2)

    def merge_words(shard: int, rows: list[dict]) -> Iterator[dict]:
        (word,), sums = unpack_blocks(rows, 1, 5, width)
        there, _ = words.arrays.arrays(shard)
        out = np.zeros((len(there), 5), np.int64)
        np.add.at(out, ((word - U64(1)) & U64((1 << words.places) - 1)).astype(np.int64), sums)
        after.write(shard, *out.T)
        yield {"kind": "done1", "level": 1, "shard": shard} | times(out[:, 0][out[:, 0] > 0])

    def merge(now: str, level: int):
        def run(key: tuple, rows: list[dict]) -> Iterator[dict]:
            kind, at, shard = key
            mine = [r for r in rows if r["parts"] is not None]
            if kind == "n" and at == level and now == "grams":
                yield from merge_grams(level, mine, shard)
            elif kind == "c" and now == "split":
                columns, stats = unpack_blocks(mine, at - 1, 4, width)
                keys, _, stats = sum_by(mix(combine(*columns)), stats)
                split_contexts[at].write(shard, keys, stats)
            elif kind == "s" and now == "split":
                columns, counts = unpack_blocks(mine, 2, 1, width)
                keys, first, counts = sum_by(mix(combine(*columns)), counts)
                split_grams.write(shard, keys, counts)
                yield {"kind": "done2", "level": 2, "shard": shard} | times(counts[:, 0])
                yield from bigram_words(columns[0][first], columns[1][first], counts[:, 0])
            elif kind == "w" and now == "words":
                yield from merge_words(shard, mine)
            else:
                yield from rows

        return run

    keys = ["kind", "level", "shard"]
    parts = 1 << bits
    blocks = slim.mapInArrow(count, BLOCKS)
    for level in range(order, 1 if order == 2 else 2, -1):
        blocks = reduce_shards(blocks.unionByName(blank_shards(blocks, bits, kind="n", level=level)), parts, merge("grams", level), keys, ROUND)
    if order > 2:
        for level in range(3, order + 1):
            blocks = blocks.unionByName(blank_shards(blocks, bits, kind="c", level=level))
        blocks = blocks.unionByName(blank_shards(blocks, bits, kind="s", level=2))
        blocks = reduce_shards(blocks, parts, merge("split", 2), keys, ROUND)
    blocks = blocks.unionByName(blank_shards(blocks, words.arrays.bits, kind="w", level=1))
    done = reduce_shards(blocks, parts, merge("words", 1), keys, ROUND).where(F.col("kind").startswith("done"))
    names = ("total", "n1", "n2", "n3", "n4", "more")
    totals = {r.level: r for r in done.groupBy("level").agg(*(F.sum(n).alias(n) for n in names)).collect()}
    discounts = {k: discounts_from(*(totals[k][f"n{i}"] for i in (1, 2, 3, 4))) for k in range(1, order + 1)}
    all_ = totals[1].total
    d1, d2, d3 = discounts[1]
    spare = (d1 * totals[1].n1 + d2 * totals[1].n2 + d3 * totals[1].more) / all_ if all_ else 1.0
    return Model(order, tokens, vocabulary, texts, layout, after, grams, contexts, split_grams, split_contexts, discounts, (all_, spare))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row; scores in log10."""
    kept = [f"__{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, offsets = tokens_of(part.column("text"))
                starts, n = offsets[:-1], np.diff(offsets)
                numbers, count = model.layout.words.numbers(tokens)
                base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
                full = np.log10(model.of_numbers(numbers, count, offsets))
                sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, full)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(part.column(k) for k in kept), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** (-sums[2] / n))],
                    ["id", *kept, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = f"id {types['id']}, " + "".join(f"`{k}` {types[k]}, " for k in kept) + "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    out = slim.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_column), *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def held_out(id_column: str = "doc_id", folds: int = 7, fold: int = 2):
    """Whether a row is of the fold that isn't learned from: the CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score_held_out(docs: DataFrame, order: int = 3) -> DataFrame:
    """Learn from all documents but one fold, score all: see ``score``; adds ``held_out``. At order 3 all trigrams are scored where they are counted."""
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    if order == 3:
        from .lmjoin import score_table

        return score_table(slim, ~F.col("held_out"), keep=("held_out",))
    model = train(slim.where("not held_out"), order)
    return score(slim, model, keep=("held_out",))
