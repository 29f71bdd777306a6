"""Operator 1 over a whole table: trigrams are scored where they are counted.

A model that has to answer for all of the table it was learned from is as large as
the table, so no task may look up its tokens in all of it.  Instead:

1. Words are counted (``lmscore.count_words``) and get numbers.  Texts become
   *frames*, one row for about a million tokens, and are not read again.
2. Each frame sends its distinct trigrams u v w, with their counts in what is learned
   from, to shards by the hash of v.  A shard thus has all trigrams of the contexts
   u v and of the bigrams v w that it meets, sums them up, and answers each frame with
   the figures of its trigrams, in the order in which they came.
3. A frequent v is dealt by the hash of u too, for then the contexts stay whole; if u
   is frequent as well, by that of w.  What such a shard knows of bigrams and contexts
   is a part.  Parts are summed by a second deal, which answers the frames that ask.
4. What bigrams tell of words is summed by word.
5. Answers and frames meet by frame; a frame deals its trigrams as before, so the
   answers' order is known, and its texts' probabilities are multiplied.

Each step's work is in proportion to its input and each shard is read once, in order.
The driver gets totals only.  Rows, columns, nulls and ties: see ``lmscore``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lmscore
from .hasharrays import Shards, bits_for, blank_shards, reduce_shards, shard_of
from .lmscore import BEGIN, U64, Words, _joined, count_words, discounts_from, runs, shifted, tokens_of
from .shared import fresh_path, make_folder, materialise
from .vectext import combine, mix, slices

ASKED = "kind string, shard int, batch long, rows int, data binary"
ANSWERED = ASKED + ", total long, n1 long, n2 long, n3 long, n4 long, more long"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of the jobs inside go when each ends."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def packed(columns: list[np.ndarray]) -> bytes:
    """Non-negative numbers, each column in as many byte planes as it needs, compressed; the widths stand first."""
    widths, planes = [], []
    for c in columns:
        c = np.ascontiguousarray(c.astype("<u8", copy=False))
        widths.append(max(1, -(-int(c.max(initial=0)).bit_length() // 8)))
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T).tobytes())
    return bytes(widths) + pa.Codec("zstd").compress(b"".join(planes), asbytes=True)


def unpacked(data: bytes, rows: int, columns: int, least: int = 8) -> list[np.ndarray]:
    """Unsigned integers of as many bytes as they need, ``least`` at least."""
    widths = data[:columns]
    flat = np.frombuffer(pa.Codec("zstd").decompress(data[columns:], rows * sum(widths), asbytes=True), np.uint8)
    out, at = [], 0
    for w in widths:
        size = max(least, 1 << (w - 1).bit_length())
        full = np.zeros((rows, size), np.uint8)
        full[:, :w] = flat[at : at + rows * w].reshape(w, rows).T
        out.append(full.view(f"<u{size}").ravel())
        at += rows * w
    return out


def encode(columns: list[np.ndarray], sums: list[np.ndarray], bits: int) -> bytes:
    """Rows of word numbers below 2 ** bits, best in order, with sums."""
    if len(columns) > 1 and 2 * bits <= 64:
        columns = [columns[0] << U64(bits) | columns[1], *columns[2:]]
    return packed([np.diff(columns[0], prepend=U64(0)), *columns[1:], *sums])


def decode(data: bytes, rows: int, width: int, sums: int, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    two = width > 1 and 2 * bits <= 64
    first, *rest = unpacked(data, rows, width - two + sums)
    first = np.cumsum(first, dtype=U64)
    columns = [first >> U64(bits), first & U64((1 << bits) - 1)] if two else [first]
    columns += rest[: len(rest) - sums]
    return columns, [s.view(np.int64) for s in rest[len(rest) - sums :]]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by key, where each group begins in that order, group of each row)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def summed(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


def followers(counts: np.ndarray, order: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """What n-grams add to their contexts: the sum of their counts, and how many are one, two, more."""
    return [summed(x, order, starts) for x in (counts, counts == 1, counts == 2, counts > 2)]


def small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


@dataclass
class Ask:
    """Distinct tuples of word numbers, in the order of their shards; ``place``: of each row among them."""

    columns: list[np.ndarray]
    shard: np.ndarray
    place: np.ndarray  # 32 bits
    group: tuple[np.ndarray, np.ndarray]  # order and beginnings of equal rows

    @classmethod
    def of(cls, local: list[np.ndarray], numbers: np.ndarray, shards: Callable[[list[np.ndarray]], np.ndarray]) -> Ask:
        """``local``: columns of places in ``numbers``; ``shards`` names the shard of such places."""
        bits = max(1, (len(numbers) - 1).bit_length())
        if bits * len(local) <= 64:
            key = np.zeros(len(local[0]), U64)
            for c in local:
                key = key << U64(bits) | c.astype(U64)
        else:
            key = combine(*(c.astype(U64) for c in local))
        order, starts, group = grouped(key)
        own = [c[order[starts]] for c in local]
        shard = shards(own)
        by = np.argsort(shard, kind="stable")
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        return cls([numbers[c[by]] for c in own], shard[by], place[group], (order, starts))

    def blocks(self, kind: str, batch: int, sums: list[np.ndarray], bits: int) -> Iterator[dict]:
        for a, b in runs(self.shard):
            yield {"kind": kind, "shard": int(self.shard[a]), "batch": batch, "rows": b - a, "data": encode([c[a:b] for c in self.columns], [s[a:b] for s in sums], bits)}


@dataclass
class Deal:
    """Which shard has what; a frame and a shard come to the same by themselves."""

    words: Words
    bits: int  # of shards
    share: int  # a word that occurs more often is split

    def splits(self, numbers: np.ndarray) -> np.ndarray:
        """Over how many shards trigrams with each word in the middle are dealt."""
        if not self.bits:
            return np.ones(len(numbers), np.int64)
        count = np.zeros(len(numbers), np.int64)
        count[numbers > 0] = self.words.column(self.words.arrays, 1, numbers[numbers > 0])
        return np.clip(-(-count // self.share), 1, 1 << self.bits)

    def trigram_shards(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, split_u: np.ndarray, split_v: np.ndarray) -> np.ndarray:
        side = np.where((split_u > 1) | (u == 0), combine(u, w), mix(u))
        part = (side >> U64(20)) % split_v.astype(U64)
        return self.narrow(shard_of(mix(mix(v + U64(0x2545F4914F6CDD1D)) + part), self.bits))

    def by_hash(self, *columns: np.ndarray) -> np.ndarray:
        return self.narrow(shard_of(mix(combine(*columns)), self.bits))

    def narrow(self, shard: np.ndarray) -> np.ndarray:
        return shard.astype(np.uint16) if self.bits <= 16 else shard


class Frame:
    """The tokens of some texts as places in their distinct word numbers, and what it asks for."""

    def __init__(self, row: dict, deal: Deal, begin: U64):
        found = unpacked(row["words"], row["n_words"], 1)[0]
        self.numbers = np.unique(np.append(found, begin))
        self.n = np.asarray(row["n"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.n)))
        self.w = np.searchsorted(self.numbers, found).astype(np.int32)[unpacked(row["tokens"], int(self.starts[-1]), 1, 4)[0]]
        mark = int(np.searchsorted(self.numbers, begin))
        split = deal.splits(self.numbers)
        v = shifted(self.w, self.starts, 1, mark)
        u = shifted(self.w, self.starts, 2, mark)
        known = self.numbers > 0
        self.asked = np.flatnonzero(known[v])  # after an unknown word there is nothing to ask
        number = self.numbers
        self.trigrams = Ask.of([v[self.asked], u[self.asked], self.w[self.asked]], number, lambda c: deal.trigram_shards(number[c[1]], number[c[0]], number[c[2]], split[c[1]], split[c[0]]))
        by_hash = lambda c: deal.by_hash(number[c[0]], number[c[1]])
        self.part_grams = np.flatnonzero((split[v] > 1) & known[self.w])
        self.bigrams = Ask.of([v[self.part_grams], self.w[self.part_grams]], number, by_hash)
        self.part_contexts = np.flatnonzero((split[v] > 1) & (split[u] > 1))
        self.contexts = Ask.of([u[self.part_contexts], v[self.part_contexts]], number, by_hash)
        self.v = v


def frames_of(docs: DataFrame, words: Words, tokens: int, vocabulary: int, keep: list[str]) -> DataFrame:
    """(batch, lists of id, *keep, learned, n, n_known and base score of its texts, words, n_words, tokens) for about FLUSH tokens each."""
    most = lmscore.FLUSH

    def frame(batch: int, held: list) -> pa.RecordBatch:
        found, offsets = _joined([(t, o) for _, t, o in held])
        distinct, at, often = np.unique(found, return_inverse=True, return_counts=True)
        number, count = words.numbers(distinct)
        base = np.log10((count + 1) / (tokens + vocabulary + 1))
        order = np.argsort(-often, kind="stable")  # frequent words get small places
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sums = [pa.array(np.add.reduceat(x[at], offsets[:-1])) for x in ((count > 0).astype(np.int64), base)]
        lists = [pa.concat_arrays([p.column(c) for p, _, _ in held]) for c in ("id", *keep, "learned")] + [pa.array(np.diff(offsets)), *sums]
        ends = pa.array([0, len(offsets) - 1], pa.int32())
        values = [pa.array([batch]), *(pa.ListArray.from_arrays(ends, x) for x in lists), pa.array([packed([number[order]])]), pa.array([len(order)], pa.int32()), pa.array([packed([place[at]])])]
        return pa.RecordBatch.from_arrays(values, ["batch", "id", *keep, "learned", "n", "known", "base", "words", "n_words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, n = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for part in slices(whole, "text"):
                held.append((part, *tokens_of(part.column("text"))))
                n += len(held[-1][1])
                if n >= most:
                    yield frame(batch, held)
                    batch, held, n = batch + 1, [], 0
        if n:
            yield frame(batch, held)

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    lists = "".join(f"`{c}` array<{types[c]}>, " for c in ("id", *keep))
    return docs.mapInArrow(run, f"batch long, {lists}learned array<boolean>, n array<long>, known array<long>, base array<double>, words binary, n_words int, tokens binary")


def times(level: int, shard: int, counts: np.ndarray) -> dict:
    """Counts of counts, of n-grams that were learned."""
    return {"kind": f"done{level}", "shard": shard, "rows": len(counts), "total": int(counts.sum()), "more": int((counts > 2).sum())} | {f"n{k}": int((counts == k).sum()) for k in (1, 2, 3, 4)}


def word_rows(v: np.ndarray, w: np.ndarray, before: np.ndarray, words: Words) -> Iterator[dict]:
    """What distinct bigrams tell of their words, to the shards of words: tokens before it, then its figures as a context."""
    by_v, at_v, _ = grouped(v)
    by_w, at_w, _ = grouped(w)
    word = np.concatenate((v[by_v[at_v]], w[by_w[at_w]]))
    as_context = followers(before, by_v, at_v)
    columns = [np.zeros(len(word), np.int64) for _ in range(5)]
    columns[0][len(at_v) :] = np.diff(np.append(at_w, len(w)))
    for column, x in zip(columns[1:], as_context, strict=True):
        column[: len(at_v)] = x
    order, starts, _ = grouped(word)
    word, columns = word[order[starts]], [summed(c, order, starts) for c in columns]
    shard = (word - U64(1)) >> U64(words.places)
    for a, b in runs(shard):
        yield {"kind": "w", "shard": int(shard[a]), "rows": b - a, "data": encode([word[a:b]], [c[a:b] for c in columns], words.bits)}


def answers(kind: str, rows: list[dict], figures: Callable[[slice], list[np.ndarray]], at: int = 0) -> Iterator[dict]:
    """To each block of those that ask, the figures of its rows."""
    for r in rows:
        here = slice(at, at := at + r["rows"])
        yield {"kind": kind, "shard": r["shard"], "batch": r["batch"], "rows": r["rows"], "data": packed(figures(here))}


def merge_trigrams(deal: Deal, shard: int, rows: list[dict]) -> Iterator[dict]:
    width = deal.words.bits
    parts = [decode(r["data"], r["rows"], 3, 1, width) for r in rows]
    v, u, w = (np.concatenate([c[k] for c, _ in parts]) for k in range(3))
    count = np.concatenate([small(s[0]) for _, s in parts])
    del parts
    order, starts, trigram = grouped(combine(u, v, w))
    first = order[starts]
    count = summed(count, order, starts)
    u, v, w, trigram = u[first], v[first], w[first], trigram.astype(np.int32)
    del order, first
    split = deal.splits(v)
    halves = np.flatnonzero(split > 1)
    whole = split <= 1
    kept = np.ones(len(v), bool)  # whether all of its context is here
    kept[halves] = deal.splits(u[halves]) <= 1
    del split
    order, starts, context = grouped(combine(u, v))
    first = order[starts]
    stats, context = followers(count, order, starts), context.astype(np.int32)
    some = np.flatnonzero(~kept[first] & (stats[0] > 0))
    yield from sum_blocks("c", [u[first[some]], v[first[some]]], [x[some] for x in stats], deal)
    stats = [small(x) for x in stats]
    del u, order, first
    order, starts, bigram = grouped(combine(v, w))
    first = order[starts]
    before, bigram = summed(count > 0, order, starts), bigram.astype(np.int32)
    del order
    some = first[found := np.flatnonzero(~whole[first] & (before > 0))]
    yield from sum_blocks("s", [v[some], w[some]], [before[found]], deal)
    some = first[found := np.flatnonzero(whole[first] & (before > 0))]
    v, w = v[some], w[some]
    yield times(3, shard, count[count > 0])
    yield times(2, shard, before[found])
    yield from word_rows(v, w, before[found], deal.words)
    count, before = small(count), small(before)
    del v, w, first, some, found

    def figures(here: slice) -> list[np.ndarray]:
        row = trigram[here]
        return [count[row], *(x[context[row]] * kept[row] for x in stats), before[bigram[row]] * whole[row]]

    yield from answers("an", rows, figures)


def sum_blocks(kind: str, columns: list[np.ndarray], sums: list[np.ndarray], deal: Deal) -> Iterator[dict]:
    """Sums of parts, to shards by the hash of their words."""
    shard = deal.by_hash(*columns)
    order = np.lexsort((*columns[::-1], shard))
    for a, b in runs(shard[order]):
        mine = order[a:b]
        yield {"kind": kind, "shard": int(shard[mine[0]]), "rows": b - a, "data": encode([c[mine] for c in columns], [x[mine] for x in sums], deal.words.bits)}


def merge_parts(deal: Deal, kind: str, shard: int, rows: list[dict]) -> Iterator[dict]:
    """Bigrams ("s") or contexts ("c"): sums of parts, and frames that ask for them."""
    sums = 4 if kind == "c" else 1
    rows.sort(key=lambda r: r["batch"] is None)
    asked = [r for r in rows if r["batch"] is not None]
    parts = [decode(r["data"], r["rows"], 2, sums if r["batch"] is None else 0, deal.words.bits) for r in rows]
    first, second = (np.concatenate([c[k] for c, _ in parts]) for k in range(2))
    order, starts, group = grouped(combine(first, second))
    total = [summed(np.concatenate([x[k] if x else np.zeros(len(c[0]), np.int64) for c, x in parts]), order, starts) for k in range(sums)]
    yield from answers(f"a{kind}", asked, lambda here: [x[group[here]] for x in total])
    if kind == "s":
        learned = np.flatnonzero(total[0] > 0)
        here = order[starts][learned]
        yield times(2, shard, total[0][learned])
        yield from word_rows(first[here], second[here], total[0][learned], deal.words)


def merge_words(words: Words, after: Shards, shard: int, rows: list[dict]) -> Iterator[dict]:
    out = np.zeros((len(words.arrays.arrays(shard)[0]), 5), np.int64)
    for r in rows:
        (word,), sums = decode(r["data"], r["rows"], 1, 5, words.bits)
        out[((word - U64(1)) & U64((1 << words.places) - 1)).astype(np.int64)] += np.stack(sums, 1)  # distinct in a block
    after.write(shard, *out.T)
    yield times(1, shard, out[:, 0][out[:, 0] > 0])


def by_kind(merges: dict[str, Callable]) -> Callable[[tuple, list[dict]], Iterator[dict]]:
    def run(key: tuple, rows: list[dict]) -> Iterator[dict]:
        if key[0] not in merges:
            yield from rows
        else:
            yield from merges[key[0]](key[1], [r for r in rows if r["data"] is not None])

    return run


@dataclass
class Totals:
    """What probabilities need beside the frames' answers."""

    deal: Deal
    after: Shards
    tokens: int
    vocabulary: int
    discounts: dict[int, tuple[float, float, float]]
    lowest: tuple[float, float]

    def kept(self, level: int, n: np.ndarray) -> np.ndarray:
        return n - np.array([0.0, *self.discounts[level]])[np.minimum(n, 3)]

    def left(self, k: int, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
        d1, d2, d3 = self.discounts[k]
        return d1 * n1 + d2 * n2 + d3 * n3

    def probabilities(self, frame: Frame, found: dict[str, list[np.ndarray]], at_once: int = 1 << 16) -> np.ndarray:
        """Of all tokens of a frame; ``found``: the columns of its answers by kind."""
        total, spare = self.lowest
        uniform = 1.0 / (self.vocabulary + 1)
        out = np.full(len(frame.w), uniform)
        if not total:
            return out
        known = frame.numbers > 0
        word = np.zeros((5, len(known)), np.int64)
        for k in range(5):
            word[k, known] = self.deal.words.column(self.after, k, frame.numbers[known])
        lowest = self.kept(1, word[0]) / total + spare * uniform
        seen, weight, left = word[1] > 0, np.maximum(word[1], 1), self.left(2, *word[2:])
        asks = []
        for ask, rows, kind, width in ((frame.trigrams, frame.asked, "an", 6), (frame.bigrams, frame.part_grams, "as", 1), (frame.contexts, frame.part_contexts, "ac", 4)):
            columns = found.get(kind) or [np.zeros(0, np.uint8)] * width
            if len(columns[0]) != len(ask.shard):
                raise ValueError(f"{len(columns[0])} answers of {len(ask.shard)}")
            place = np.full(len(out), len(ask.shard), np.int32)  # the last one: nothing asked
            place[rows] = ask.place
            asks.append((place, [np.append(c, c.dtype.type(0)) for c in columns]))
        (own, figures), (by_gram, (grams,)), (by_context, contexts) = asks
        for a in range(0, len(out), at_once):
            here = slice(a, a + at_once)
            row, context, v = own[here], by_context[here], frame.v[here]
            n3, *stats, n2 = (c[row].astype(np.int64) for c in figures)
            n2 += grams[by_gram[here]].astype(np.int64)
            stats = [x + c[context].astype(np.int64) for x, c in zip(stats, contexts, strict=True)]  # the one or the other is zero
            p = lowest[frame.w[here]]
            p = np.where(seen[v], (self.kept(2, n2) + left[v] * p) / weight[v], p)
            out[here] = np.where(stats[0] > 0, (self.kept(3, n3) + self.left(3, *stats[1:]) * p) / np.maximum(stats[0], 1), p)
        return out


def score_table(docs: DataFrame, learned, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``lmscore.score`` for each row, by a model of order 3 learned from the rows where ``learned`` holds."""
    spark = docs.sparkSession
    kept = [f"__{k}" for k in range(len(keep))]
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.coalesce(learned, F.lit(False)).alias("learned"))
    path = make_folder(spark, fresh_path(spark, "trigrams"))
    train = slim.where("learned").select("text")
    with shuffles_released(spark):
        size = int(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        words, tokens, vocabulary, texts = count_words(train, path, size)
        tokens = tokens or 0
        frames = materialise(frames_of(slim, words, tokens, vocabulary, kept), "frames", under=path)
        deal = Deal(words, bits_for(tokens, lmscore.SHARD_KEYS), lmscore.PIVOT_KEYS)
        parts, width = 1 << deal.bits, words.bits
        after = Shards(path, "after", words.arrays.bits, [np.int64] * 4)
        schema = lmscore._arrow(ASKED)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin = words.numbers(np.array([BEGIN]))[0][0]
            for r in (r for b in batches for r in b.to_pylist()):
                frame = Frame(r, deal, begin)
                order, starts = frame.trigrams.group
                count = np.add.reduceat(np.repeat(np.array(r["learned"], np.int64), frame.n)[frame.asked][order], starts) if len(starts) else starts
                sums = np.empty(len(count), np.int64)
                sums[frame.trigrams.place[order[starts]]] = count
                for rows in (frame.trigrams.blocks("n", r["batch"], [sums], width), frame.bigrams.blocks("s", r["batch"], [], width), frame.contexts.blocks("c", r["batch"], [], width)):
                    if rows := list(rows):
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

        keys = ["kind", "shard"]
        blocks = frames.select("batch", "learned", "n", "words", "n_words", "tokens").mapInArrow(ask, ASKED)
        first = materialise(reduce_shards(blocks, parts, by_kind({"n": lambda shard, rows: merge_trigrams(deal, shard, rows)}), keys, ANSWERED), "first", under=path)
        merges = {k: lambda shard, rows, k=k: merge_parts(deal, k, shard, rows) for k in ("s", "c")}
        second = materialise(reduce_shards(first.where("kind in ('s', 'c')").select(*ASKED_COLUMNS), parts, by_kind(merges), keys, ANSWERED), "second", under=path)
        both = first.unionByName(second)
        rows = both.where("kind = 'w'").select(*ASKED_COLUMNS)
        third = reduce_shards(rows.unionByName(blank_shards(rows, words.arrays.bits, kind="w")), 1 << words.arrays.bits, by_kind({"w": lambda shard, rows: merge_words(words, after, shard, rows)}), keys, ANSWERED)
        names = ("total", "n1", "n2", "n3", "n4", "more")
        done = both.where(F.col("kind").startswith("done")).unionByName(third).groupBy("kind").agg(*(F.sum(n).alias(n) for n in names)).collect()
    of = {r.kind: r for r in done}
    counts = lambda k: tuple(of[f"done{k}"][f"n{i}"] for i in (1, 2, 3, 4)) if f"done{k}" in of else (0, 0, 0, 0)
    discounts = {k: discounts_from(*counts(k)) for k in (1, 2, 3)}
    lowest = of["done1"]
    spare = sum(d * n for d, n in zip(discounts[1], (lowest.n1, lowest.n2, lowest.more), strict=True)) / lowest.total if lowest.total else 1.0
    totals = Totals(deal, after, tokens, vocabulary, discounts, (lowest.total, spare))
    asked = both.where("kind in ('an', 'as', 'ac')").select(*ASKED_COLUMNS)
    return answered(frames, asked, totals, kept, parts).select(F.col("id").alias(id_column), *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


ASKED_COLUMNS = [c.split()[0] for c in ASKED.split(", ")]


def answered(frames: DataFrame, asked: DataFrame, totals: Totals, keep: list[str], parts: int) -> DataFrame:
    """Each frame with its answers: a row for each text."""
    begin_of = totals.deal.words
    types = {f.name: f.dataType.elementType.simpleString() for f in frames.schema.fields if f.name in ("id", *keep)}
    names = ["id", *keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def close(row: pa.RecordBatch, answers: dict[str, list[list[np.ndarray]]], begin: U64) -> pa.RecordBatch:
        frame = Frame({c: row.column(c)[0].as_py() for c in ("words", "n_words", "tokens")} | {"n": row.column("n")[0].values.to_numpy(zero_copy_only=False)}, totals.deal, begin)
        found = {k: [np.concatenate(c) for c in zip(*blocks, strict=True)] for k, blocks in answers.items()}
        score = np.add.reduceat(np.log10(totals.probabilities(frame, found)), frame.starts[:-1])
        lists = [row.column(c)[0].values for c in ("id", *keep, "n", "known", "base")]
        lists[-1:-1] = [pa.array(np.full(len(score), totals.tokens, np.int64))]
        return pa.RecordBatch.from_arrays([*lists, pa.array(score), pa.array(10 ** (-score / frame.n))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = begin_of.numbers(np.array([BEGIN]))[0][0]
        found: dict[str, list[list[np.ndarray]]] = {}
        for b in batches:
            kinds, rows, data = (b.column(c) for c in ("kind", "rows", "data"))
            for i in range(b.num_rows):
                kind = kinds[i].as_py()
                if kind == "frame":  # the last of its batch
                    yield close(b.slice(i, 1), found, begin)
                    found = {}
                else:
                    found.setdefault(kind, []).append(unpacked(data[i].as_py(), rows[i].as_py(), {"an": 6, "as": 1, "ac": 4}[kind], 1))

    frame = frames.drop("learned").withColumns({"kind": F.lit("frame"), "shard": F.lit(0), "rows": F.lit(0), "data": F.lit(None).cast("binary")})
    both = asked.unionByName(frame, allowMissingColumns=True).repartition(2 * parts, "batch").sortWithinPartitions("batch", "kind", "shard")
    schema = "".join(f"`{c}` {types[c]}, " for c in ("id", *keep)) + "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return both.mapInArrow(run, schema)
