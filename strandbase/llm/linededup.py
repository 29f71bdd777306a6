"""Operator 8, line dedup: an exact set-similarity join of lines.

A line's tokens are the set of its shingles of ``shingle`` words (a shorter line
is one shingle).  A line is removed if an earlier line, in the order of document
id and line number, has Jaccard similarity of at least ``threshold`` with it.
Lines without words are never removed.

1. Count in how many lines each token occurs.  Tokens of a single line can't match.
2. Order each line's tokens by rarity; two lines can only be similar if they share
   one of their first ``n - ceil(t n) + 1`` tokens.  Lines whose prefix holds no
   shared token are done.  Lines with equal token sets are one from here on.
3. Join on prefix tokens; of the candidates the length and positional bounds leave,
   verify Jaccard exactly, and keep for each line only the earliest match, so that a
   family of near copies gives few rows.  A token of very many or very long lines is
   split over a grid of salts whose cells have a bounded size, and cells are compared
   in blocks that are bounded in lines and in tokens.
4. Mark every line whose earliest match is earlier, and cut the marked lines out of
   the texts, looking them up in sorted arrays; texts are never shuffled.

Line numbers count from 0; lines are separated by a line feed.  Null texts stay
null and have no lines.  Rows with equal id and text are treated alike.  Null ids
come first in the order.  Extra columns are carried along; a column of the report
whose name the input has gets underscores before its name until it is free
(``report_names``).  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hasharrays import Shards, bits_for, blank_shards, cuts, reduce_shards
from .shared import drop, fresh_path, make_folder, materialise
from .vectext import BYTE_VALUE_LOWER, IS_SPACE, combine, mix, ranges, shingle_hashes, slices, span_hashes, string_parts

U64 = np.uint64
#: Lines, and bytes of their tokens, on each side of a cell.
CELL = 8192
CELL_BYTES = 32 << 20
#: Lines in a block of comparisons, and numbers in its table.
BLOCK = 512
TABLE = 1 << 23
FLUSH = 1 << 20


def least_prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def line_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end without the line feed, lines before each text: n + 1); an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    # A break at the very end of a text begins an empty line that sorts before the next text's first.
    number = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    before = np.concatenate(([0], np.cumsum(number)))
    end = np.append(begin[1:] - 1, len(data))
    end[before[1:] - 1] = offsets[1:]
    return begin, end, before


def line_tokens(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all lines, sorted and distinct within a line; tokens before each line: n + 1; lines before each text)."""
    begin, end, lines = line_edges(data, offsets)
    word = ~IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    # a text's last word may touch the next text's first
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    hashes = span_hashes(BYTE_VALUE_LOWER[data], starts, stops)
    words = np.searchsorted(starts, np.append(begin, len(data)))
    tokens, before = shingle_hashes(hashes, words, shingle)
    owner = np.repeat(np.arange(len(begin)), np.diff(before))
    order = np.lexsort((tokens, owner))
    tokens = tokens[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[first], np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(begin))))), lines


def _quantised(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys to 32 bits beyond those that name the shard: enough to tell shared tokens from others, and half the size."""
    return keys >> U64(32 - bits) << U64(32 - bits) if bits < 32 else keys


def shared_tokens(docs: DataFrame, path: str, bits: int, shingle: int) -> Shards:
    """In how many lines each token occurs, for those of two or more."""
    arrays = Shards(path, "tokens", bits, [np.uint32])

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate(held))
        rows = [(s, (tokens[a:b] >> U64(32 - bits)).astype(np.uint32).tobytes()) for s, a, b in cuts(tokens, bits)]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.binary())], ["shard", "keys"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(line_tokens(*string_parts(part.column("text")), shingle)[0])
                if sum(map(len, held)) >= FLUSH:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    def merge(key: tuple, rows: list[dict]) -> Iterator[dict]:
        keys = np.sort(np.concatenate([np.frombuffer(r["keys"] or b"", np.uint32) for r in rows]))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        number = np.diff(np.append(first, len(keys)))
        many = number > 1
        whole = (keys[first[many]].astype(U64) << U64(32 - bits)) | (U64(key[0]) << U64(64 - bits) if bits else U64(0))
        arrays.write(key[0], whole, np.minimum(number[many], (1 << 32) - 1))
        yield {"n": int(many.sum())}

    blocks = docs.select("text").mapInArrow(count, "shard int, keys binary")
    reduce_shards(blocks.unionByName(blank_shards(blocks, bits)), 1 << bits, merge, ["shard"], "n long").agg(F.sum("n")).first()
    return arrays


def candidates(docs: DataFrame, path: str, tokens: Shards, shingle: int, threshold: float) -> DataFrame:
    """A row for each line whose prefix holds a shared token: (id, tie, line, sig, n, skipped, shared).

    ``shared`` has the line's shared tokens, rarest first, in the batch's first row of a token set; ``skipped``
    is the number of its tokens before them, which no other line has.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, before, lines = line_tokens(*string_parts(part.column("text")), shingle)
                n = np.diff(before)
                _, number = tokens.of(_quantised(keys, tokens.bits))
                owner = np.repeat(np.arange(len(n)), n)
                shared = number > 0
                skipped = n - np.bincount(owner[shared], minlength=len(n))
                take = (n > 0) & (skipped < least_prefix(n, threshold))
                signature = np.zeros(len(n), U64)
                some = n > 0
                signature[some] = np.add.reduceat(mix(keys), before[:-1][some]) if len(keys) else 0
                signature = combine(signature, n.astype(U64))
                chosen = np.flatnonzero(take)
                _, first = np.unique(signature[chosen], return_index=True)
                own = np.zeros(len(chosen), bool)
                own[first] = True
                mine = shared & take[owner]
                order = np.lexsort((keys[mine], number[mine], owner[mine]))
                flat, who = keys[mine][order], owner[mine][order]
                low, high = np.searchsorted(who, chosen), np.searchsorted(who, chosen, "right")
                text = np.searchsorted(lines, chosen, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(text)),
                        part.column("tie").take(pa.array(text)),
                        pa.array((chosen - lines[text]).astype(np.int32)),
                        pa.array(signature[chosen].view(np.int64)),
                        pa.array(n[chosen].astype(np.int32)),
                        pa.array(skipped[chosen].astype(np.int32)),
                        pa.array([flat[a:b].tobytes() if o else None for a, b, o in zip(low.tolist(), high.tolist(), own.tolist(), strict=True)], pa.binary()),
                    ],
                    ["id", "tie", "line", "sig", "n", "skipped", "shared"],
                )

    return materialise(docs.mapInArrow(find, f"id {kind}, tie long, line int, sig long, n int, skipped int, shared binary"), "candidates", under=path)


def bounded(rows: np.ndarray, have: np.ndarray) -> Iterator[np.ndarray]:
    """``rows`` in blocks: at most BLOCK of them, and fewer where their tokens are many."""
    at = 0
    while at < len(rows):
        part = rows[at : at + BLOCK]
        cost = np.cumsum(have[part]) * 4 * np.arange(1, len(part) + 1)
        end = at + max(1, int(np.searchsorted(cost, TABLE, "right")))
        yield rows[at:end]
        at = end


def earliest_similar(sets: list[np.ndarray], sizes: np.ndarray, rest: np.ndarray, threshold: float, queries: np.ndarray, against: np.ndarray) -> np.ndarray:
    """For each query the first of ``against`` (ascending positions) before it with Jaccard >= threshold, else -1.

    ``rest`` is how many tokens of a line, in the common order, stand at the joined token or
    after it: pairs that share too few even if all of these are equal are passed over.
    """
    have = np.fromiter(map(len, sets), np.int64, len(sets))
    best = np.full(len(sets), -1, np.int64)
    for block in bounded(against, have):
        open_ = queries[(best[queries] < 0) & (queries > block[0])]
        for mine in bounded(open_, have):
            least = np.ceil(threshold / (1 + threshold) * (sizes[mine][:, None] + sizes[block]) - 1e-9)
            may = (np.minimum(rest[mine][:, None], rest[block]) >= least) & (block < mine[:, None])
            q, o = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(q):
                continue
            rows = [*mine[q].tolist(), *block[o].tolist()]
            distinct, place = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
            grid = np.zeros((len(rows), len(distinct)), np.float32)
            grid[np.repeat(np.arange(len(rows)), have[rows]), place] = 1
            both = np.rint(grid[: len(q)] @ grid[len(q) :].T).astype(np.int64)
            need = threshold * (sizes[mine[q]][:, None] + sizes[block[o]] - both) - 1e-9
            ok = (both >= need) & may[np.ix_(q, o)]
            hit = ok.any(1)
            best[mine[q][hit]] = block[o][ok[hit].argmax(1)]
    return best[queries]


def earliest_matches(lines: DataFrame, path: str, threshold: float) -> DataFrame:
    """(sig, best): the place of the earliest line similar to each token set, its own first place included."""
    spark = lines.sparkSession
    place = F.struct("id", "tie", "line")
    firsts = lines.groupBy("sig").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.max("skipped").alias("skipped"), F.max("shared").alias("shared"))
    firsts = materialise(firsts, "sets", under=path)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            skipped = batch.column("skipped").to_numpy(zero_copy_only=False)
            keys, offsets = string_parts(batch.column("shared"))
            keys = np.ascontiguousarray(keys).view(np.int64)
            have = np.diff(offsets) // 8
            number = np.minimum(least_prefix(n, threshold) - skipped, have)
            row = np.repeat(np.arange(len(n)), number)
            at = ranges(offsets[:-1] // 8, number)
            position = at - offsets[:-1][row] // 8 + skipped[row]
            columns = [pa.array(keys[at]), batch.column("sig").take(pa.array(row)), pa.array(position.astype(np.int32)), pa.array(have[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "sig", "position", "have"])

    slim = firsts.select("sig", "n", "skipped", "shared").mapInArrow(prefix, "token long, sig long, position int, have int")
    slim = materialise(slim, "prefixes", under=path)
    # Tokens of one token set only are of no use, however often that line is repeated.  Tokens that the same
    # sets share lead to the same comparisons: of these the first in the common order stands for all (it is
    # the first that any two of the sets share, which the positional bound needs).
    digest = [F.sum(F.xxhash64("sig", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    alike = slim.groupBy("token").agg(F.count("*").alias("k"), F.min("position").alias("position"), F.sum("have").alias("have"), *digest).where("k > 1")
    grid = F.greatest(F.ceil(F.col("k") / CELL), F.ceil(F.col("have") * 8 / CELL_BYTES)).cast("int")
    many = alike.groupBy("k", "have", "h1", "h2").agg(F.min(F.struct("position", "token"))["token"].alias("token")).withColumn("grid", grid)
    dealt = slim.drop("have").join(many.select("token", "grid"), "token").join(firsts, "sig")
    mine = F.pmod(F.xxhash64("sig"), F.col("grid")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    as_query = dealt.withColumn("other", each).withColumn("salt", mine * F.col("grid") + F.col("other")).withColumn("query", F.lit(True))
    as_query = as_query.withColumn("against", mine == F.col("other"))
    as_other = dealt.withColumn("other", each).where(mine != F.col("other")).withColumn("salt", F.col("other") * F.col("grid") + mine).withColumn("query", F.lit(False)).withColumn("against", F.lit(True))
    grid = as_query.unionByName(as_other).select("token", "salt", "query", "against", "position", "sig", "n", "shared", "first.*")
    kind = lines.schema["id"].dataType.simpleString()

    def merge(key: tuple, rows: list[dict]) -> Iterator[dict]:
        rows.sort(key=lambda r: (r["id"] is not None, r["id"] if r["id"] is not None else 0, r["tie"], r["line"]))
        sets = [np.frombuffer(r["shared"], U64) for r in rows]
        sizes = np.array([r["n"] for r in rows], np.int64)
        position = np.array([r["position"] for r in rows], np.int64)
        queries = np.flatnonzero([r["query"] for r in rows])
        against = np.flatnonzero([r["against"] for r in rows])
        for q, f in zip(queries.tolist(), earliest_similar(sets, sizes, sizes - position, threshold, queries, against).tolist(), strict=True):
            if f >= 0:
                yield {"sig": rows[q]["sig"], "id": rows[f]["id"], "tie": rows[f]["tie"], "line": rows[f]["line"]}

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    better = reduce_shards(grid, parts, merge, ["token", "salt"], f"sig long, id {kind}, tie long, line int")
    both = better.select("sig", place.alias("best")).unionByName(firsts.select("sig", F.col("first").alias("best")))
    # Written out: Spark can then split a line that is repeated very often in the join that follows.
    return materialise(both.groupBy("sig").agg(F.min("best").alias("best")), "best", under=path)


def removed_lines(docs: DataFrame, path: str, shingle: int, threshold: float) -> Shards:
    """A set of keys, one for each removed line: see ``line_keys``.  docs: (id, tie, text)."""
    spark = docs.sparkSession
    work = make_folder(spark, f"{path}/work")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = shared_tokens(docs, work, bits_for(int(size) // 6), shingle)
    lines = candidates(docs, work, tokens, shingle, threshold)
    best = earliest_matches(lines, work, threshold)
    gone = lines.select("sig", "id", "tie", "line").join(best, "sig").where(F.struct("id", "tie", "line") > F.col("best")).select("tie", "line")
    arrays = Shards(path, "removed", bits_for(int(size) // 64), [])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tie, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tie", "line"))
            keys = np.unique(line_keys(tie, line))
            rows = list(cuts(keys, arrays.bits))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int32()), pa.array([keys[a:b].tobytes() for _, a, b in rows], pa.binary())], ["shard", "keys"])

    def merge(key: tuple, rows: list[dict]) -> Iterator[dict]:
        keys = np.unique(np.concatenate([np.frombuffer(r["keys"] or b"", U64) for r in rows]))
        arrays.write(key[0], keys)
        yield {"n": len(keys)}

    blocks = gone.mapInArrow(keyed, "shard int, keys binary")
    reduce_shards(blocks.unionByName(blank_shards(blocks, arrays.bits)), 1 << arrays.bits, merge, ["shard"], "n long").agg(F.sum("n")).first()
    drop(spark, work)
    return arrays


def line_keys(tie: np.ndarray, line: np.ndarray) -> np.ndarray:
    return combine(mix(tie.astype(np.int64).view(U64)), line.astype(np.int64).view(U64))


REPORT = ("n_lines", "n_removed", "removed")


def report_names(columns: list[str], prefix: str = "") -> dict[str, str]:
    """What the columns of the report are called beside the given ones: underscores make a taken name free."""
    taken = {c.lower() for c in columns}
    out = {}
    for c in REPORT:
        name = prefix + c
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out[c] = name
    return out


def dedup_lines(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text", prefix: str = "") -> DataFrame:
    """The input's columns with the text less its removed lines, then n_lines, n_removed and removed (line numbers), named by ``report_names``."""
    if not 0.5 <= threshold <= 1 or math.isnan(threshold):
        raise ValueError("the threshold is between 0.5 and 1")
    spark = docs.sparkSession
    path = make_folder(spark, fresh_path(spark, "lines"))
    tie = F.xxhash64(F.col(id_column), F.col(text_column))
    slim = docs.select(F.col(id_column).alias("id"), tie.alias("tie"), F.col(text_column).alias("text")).where("text is not null")
    removed = removed_lines(slim, path, shingle, threshold)
    rest = [c for c in docs.columns if c != text_column]
    wide = docs.select(F.col(text_column).alias("__text"), tie.alias("__tie"), F.struct(*rest).alias("__rest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                column = part.column("__text")
                data, offsets = string_parts(column)
                begin, end, lines = line_edges(data, offsets)
                text = np.repeat(np.arange(part.num_rows), np.diff(lines))
                number = np.arange(len(begin)) - lines[text]
                there = removed.of(line_keys(part.column("__tie").to_numpy(zero_copy_only=False)[text], number))[0]
                whole = data.tobytes()
                texts, totals, gone = column.to_pylist(), [], []
                for i in range(part.num_rows):
                    a, b = int(lines[i]), int(lines[i + 1])
                    off = np.flatnonzero(there[a:b])
                    if texts[i] is None:
                        off, b = off[:0], a
                    if len(off):
                        keep = np.flatnonzero(~there[a:b]) + a
                        texts[i] = b"\n".join([whole[begin[k] : end[k]] for k in keep.tolist()]).decode()
                    totals.append(b - a)
                    gone.append(off.tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()), part.column("__rest"), pa.array(totals, pa.int32()), pa.array(list(map(len, gone)), pa.int32()), pa.array(gone, pa.list_(pa.int32()))],
                    ["__text", "__rest", "n_lines", "n_removed", "removed"],
                )

    rest_type = wide.schema["__rest"].dataType.simpleString()
    out = wide.mapInArrow(cut, f"__text string, __rest {rest_type}, n_lines int, n_removed int, removed array<int>")
    columns = [F.col("__text").alias(c) if c == text_column else F.col("__rest")[c].alias(c) for c in docs.columns]
    names = report_names(docs.columns, prefix)
    return out.select(*columns, *(F.col(c).alias(names[c]) for c in REPORT))
