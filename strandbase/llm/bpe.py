"""Byte-level BPE as two deterministic finite-state transducers.

``Pretokenizer`` reads character classes and marks where a pre-token begins.
A text is cut into chunks; each chunk is turned into its *state map* (the state
it ends in, for every state it may begin in), the maps are composed by a
parallel prefix scan, and with the entry states so found all chunks are read
side by side.

``CountTransducer`` reads the bytes of one pre-token.  Its states are compiled
from the merge table as they are first needed, and every transition carries the
number of tokens that it adds to the count.

``Encoder`` gives token ids: pre-tokens by the first transducer, the ids of
each distinct pre-token by the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .vectext import ranges, span_hashes

CHUNK = 128

# Character classes
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE_MID, APOSTROPHE_1, APOSTROPHE_2, FIRST = range(9)
N_SYMBOLS = 16  # the same again for the first character of a text
# States: what has just been read
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, AFTER_WHITE, SUFFIX_1, SUFFIX_2, FRESH = range(9)
N_STATES = 9


def _transition_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token begins) for each symbol and state."""
    step = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    begins = np.ones((N_SYMBOLS, N_STATES), bool)
    for kind, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[kind] = own
        begins[kind, [own, AFTER_SPACE]] = False
    step[LETTER, [SUFFIX_1, SUFFIX_2]] = FRESH, SUFFIX_1
    begins[LETTER, [SUFFIX_1, SUFFIX_2]] = False
    step[SPACE_LAST], step[WHITE_LAST], step[WHITE_MID] = AFTER_SPACE, AFTER_WHITE, IN_WHITE
    begins[WHITE_MID, IN_WHITE] = False
    for kind, suffix in ((APOSTROPHE_1, SUFFIX_1), (APOSTROPHE_2, SUFFIX_2)):
        step[kind] = suffix
        step[kind, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[kind, [IN_OTHERS, AFTER_SPACE]] = False
    for kind in range(8):
        step[8 + kind] = step[kind, FRESH]
    return step, begins


def _after_symbol() -> np.ndarray:
    """Whether a pre-token begins at a symbol, by the symbol before it, outside of suffixes such as 's."""
    _, begins = _transition_tables()
    state = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, IN_WHITE, IN_OTHERS, IN_OTHERS]
    return np.ascontiguousarray(begins[:, state])


_AFTER = _after_symbol()


def _character_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            table[c] = LETTER
        elif major == "N":
            table[c] = NUMBER
    # The white space of the pattern: fixed values.
    for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = WHITE_MID
    return table


class Pretokenizer:
    """Cuts texts as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` does."""

    def __init__(self, special: str = "<|endoftext|>"):
        self.special = special
        self.classes = _character_classes()
        step, begins = _transition_tables()
        self.step, self.begins = step.ravel().astype(np.intp), begins.ravel()
        pair = np.empty((N_SYMBOLS, N_SYMBOLS, N_STATES), np.uint8)
        for a in range(N_SYMBOLS):
            for b in range(N_SYMBOLS):
                pair[a, b] = step[b][step[a]]
        self.pair = pair.ravel().astype(np.intp)

    def symbols(self, points: np.ndarray, first: np.ndarray, separator: np.ndarray) -> np.ndarray:
        """Classes with the two characters of look-ahead resolved, so that the automaton itself needs none."""
        n = len(points)
        kind = self.classes[points]
        white = kind == WHITE_MID
        followed = np.zeros(n, bool)
        followed[:-1] = ~white[1:]
        followed[separator[separator > 0] - 1] = False
        last = white & followed
        kind[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
        quote = np.flatnonzero(points == 39)
        if len(quote):
            ahead = np.concatenate((points, np.zeros(2, points.dtype)))
            one, two = ahead[quote + 1], ahead[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            kind[quote[short]] = APOSTROPHE_1
            kind[quote[long]] = APOSTROPHE_2
        kind[first] += 8
        return kind

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """For each character whether a pre-token begins there: state maps of chunks, prefix scan, then all chunks at once."""
        n = len(symbols)
        chunks = -(-n // CHUNK)
        lanes = np.full(chunks * CHUNK, OTHER, np.uint8)
        lanes[:n] = symbols
        lanes = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
        maps = np.repeat(np.arange(N_STATES)[:, None], chunks, axis=1)
        for j in range(0, CHUNK, 2):
            row = (lanes[j].astype(np.intp) * N_SYMBOLS + lanes[j + 1]) * N_STATES
            maps += row
            maps = self.pair.take(maps)
        shift = 1
        while shift < chunks:  # after round r a map covers the 2^r chunks that end with its own
            maps[:, shift:] = np.take_along_axis(maps[:, shift:], maps[:, :-shift], axis=0)
            shift *= 2
        state = np.empty(chunks, np.intp)
        state[0], state[1:] = FRESH, maps[FRESH, :-1]
        out = np.empty((CHUNK, chunks), bool)
        for j, row in enumerate(lanes):
            state += row.astype(np.intp) * N_STATES
            out[j] = self.begins.take(state)
            state = self.step.take(state)
        return out.T.ravel()[:n]

    def starts_at_once(self, symbols: np.ndarray) -> np.ndarray:
        """The same as ``starts``: with the look-ahead resolved, the preceding character decides, but for apostrophes."""
        before = np.concatenate(([FIRST], symbols[:-1]))
        before[before >= FIRST] -= FIRST
        out = _AFTER[symbols, before]
        quote = np.flatnonzero((symbols == APOSTROPHE_1) | (symbols == APOSTROPHE_2) | (symbols == APOSTROPHE_1 + 8) | (symbols == APOSTROPHE_2 + 8))
        if len(quote):
            quote = quote[out[quote]]
            out[quote + 1] = False
            long = (symbols[quote] & 7) == APOSTROPHE_2
            out[quote[long] + 2] = False
            ends = quote + 2 + long
            ends = ends[ends < len(out)]
            follows = symbols[ends]
            out[ends[(follows & 7) == LETTER]] = True
        return out

    def spans(self, texts: list[str], scan: bool = True) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a joined text, its code points, begin and end of each pre-token in it, pre-tokens before each text: n + 1).

        The special string is one pre-token.
        """
        parts: list[str] = []
        owner: list[int] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if self.special in text:
                for k, piece in enumerate(text.split(self.special)):
                    if k:
                        whole.append(len(parts))
                        parts.append(self.special)
                        owner.append(i)
                    if piece:
                        parts.append(piece)
                        owner.append(i)
            elif text:
                parts.append(text)
                owner.append(i)
        if not parts:
            none = np.zeros(0, np.int64)
            return "", np.zeros(0, np.uint32), none, none, np.zeros(len(texts) + 1, np.int64)
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        first = ends - lengths
        symbols = self.symbols(points, np.concatenate((first, ends)), ends)
        begin = self.starts(symbols) if scan else self.starts_at_once(symbols)
        for k in whole:
            begin[first[k] + 1 : ends[k]] = False
        at = np.flatnonzero(begin)
        low, high = np.searchsorted(at, first), np.searchsorted(at, ends)
        stop = np.append(at[1:], len(points))
        mine = np.ones(len(at), bool)
        mine[high] = False
        per_text = np.bincount(np.asarray(owner, np.int64), weights=high - low, minlength=len(texts)).astype(np.int64)
        return joined, points, at[mine], stop[mine], np.concatenate(([0], np.cumsum(per_text)))

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(all pre-tokens, number of pre-tokens before each text: n + 1)."""
        joined, _, begin, end, before = self.spans(texts)
        return [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], before


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_SPREAD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BYTES = [bytes([b]) for b in range(256)]


class CountTransducer:
    """Bytes of a pre-token to its number of tokens.

    Of all tokens that end a prefix exactly one ends the prefix's own encoding: the
    one that can stand after the last token of what precedes it.  So a state need
    hold no more than the longest suffix that a longer token begins with and, for
    each place in it where such a token begins, the last token there and the count
    relative to now.  States are compiled as they are first reached; when ``most``
    is passed the table starts afresh, which changes no result.
    """

    def __init__(self, path: str, most: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.token = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        for a, b in merges:
            left, right = raw(a), raw(b)
            self.token.setdefault(left + right, len(self.halves))
            self.halves.append((self.token[left], self.token[right]))
        self.merge = {h: i for i, h in enumerate(self.halves) if h}
        self.begun = {t[:k] for t in self.token for k in range(len(t))}
        self.most = most
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.ahead: dict[bytes, tuple] = {}
        self._afresh()

    def _afresh(self) -> None:
        # A state: (suffix, last token, count relative to now, the same one place back, ...); -1 is the word's
        # beginning, -2 a place of no more use.
        start = (b"", -1, 0)
        self.keys = [start]
        self.number = {start: 0}
        self._resize(18)

    def _resize(self, bits: int) -> None:
        """Transitions are in an open-addressed table: state * 256 + byte to (next state, tokens added)."""
        old = (self.at[self.at >= 0], self.to[self.at >= 0]) if bits > 18 else ((), ())
        self.bits, self.filled = bits, 0
        self.at = np.full(1 << bits, -1, np.int64)
        self.to = np.zeros(1 << bits, np.int64)
        for key, value in zip(*map(list, old), strict=True):
            self._put(int(key), int(value))

    def _put(self, key: int, value: int) -> None:
        slot = (key * _SPREAD & _MASK) >> (64 - self.bits)
        at = self.at
        while at.item(slot) >= 0:
            slot = slot + 1 & len(at) - 1
        at[slot] = key
        self.to[slot] = value
        self.filled += 1

    def _get(self, key: int) -> int:
        slot = (key * _SPREAD & _MASK) >> (64 - self.bits)
        at = self.at
        while (found := at.item(slot)) != key:
            if found < 0:
                return -1
            slot = slot + 1 & len(at) - 1
        return self.to.item(slot)

    def _get_all(self, keys: np.ndarray) -> np.ndarray:
        """The values of many keys, -1 where there is none."""
        slot = ((keys.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.intp)
        found = self.at.take(slot)
        out = self.to.take(slot)
        out[found < 0] = -1
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & len(self.at) - 1
            here = self.at.take(slot[open_])
            out[open_] = np.where(here < 0, -1, self.to.take(slot[open_]))
            open_ = open_[(here != keys[open_]) & (here >= 0)]
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can stand right after a: undoing merges from the latest, no merge across the gap comes first."""
        key = (a, b)
        known = self.adjacent.get(key)
        if known is not None:
            return known
        before = len(self.halves)
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < before:
                ok = False
                break
            if a < 256 and b < 256:
                ok = True
                break
            if a > b:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]
        if len(self.adjacent) > 1_000_000:
            self.adjacent.clear()
        self.adjacent[key] = ok
        return ok

    def _ahead(self, longer: bytes) -> tuple:
        """(tokens that end here with their sizes, longest suffix to keep, which of its places can still begin a token)."""
        known = self.ahead.get(longer)
        if known is None:
            ends = [(size, self.token[longer[-size:]]) for size in range(len(longer), 0, -1) if longer[-size:] in self.token]
            kept = longer
            while kept not in self.begun:
                kept = kept[1:]
            alive = [kept[-d:] in self.begun for d in range(1, len(kept) + 1)]
            if len(self.ahead) > 200_000:
                self.ahead.clear()
            known = self.ahead[longer] = (ends, kept, alive)
        return known

    def compile(self, key: int) -> int:
        """The transition of a state under a byte: next state and tokens added, in one number."""
        places = self.keys[key >> 8]
        ends, kept, alive = self._ahead(places[0] + _BYTES[key & 255])
        n = len(places)
        for size, token in ends:
            k = 2 * size - 1
            if k < n:
                last = places[k]
                if last == -1 or last >= 0 and self.may_follow(last, token):
                    added = places[k + 1] + 1
                    break
        now = [kept, token, 0]
        for k, ok in enumerate(alive):
            k = 2 * k + 1
            if k >= n:
                break
            if ok and places[k] != -2:
                now += (places[k], places[k + 1] - added)
            else:
                now += (-2, 0)
        now = tuple(now)
        target = self.number.get(now)
        if target is None:
            target = self.number[now] = len(self.keys)
            self.keys.append(now)
        value = target << 8 | added + 128
        if 2 * self.filled > len(self.at):
            self._resize(self.bits + 1)
        self._put(key, value)
        return value

    def count(self, word: bytes) -> int:
        """Number of tokens of one pre-token, byte after byte."""
        total = state = 0
        for byte in word:
            key = state << 8 | byte
            value = self._get(key)
            if value < 0:
                value = self.compile(key)
            total += (value & 255) - 128
            state = value >> 8
        return total

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, side_by_side: int = 256) -> np.ndarray:
        """Number of tokens of each pre-token data[begin:end], all read side by side; longer ones one after another."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        total = np.zeros(len(begin), np.int64)
        skip = int(np.searchsorted(-size[order], -side_by_side, "left"))
        for k in order[:skip].tolist():
            total[k] = self.count(data[begin[k] : end[k]].tobytes())
        order = order[skip:]
        if len(self.keys) > self.most:
            self._afresh()
        sizes, at = size[order], begin[order]
        state, sums = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = len(order)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes[:active], -j, "left"))
            key = state[:active] * 256 + data[at[:active] + j]
            moves = self._get_all(key)
            missing = np.flatnonzero(moves < 0)
            if len(missing):
                distinct, place = np.unique(key[missing], return_inverse=True)
                moves[missing] = np.array([self.compile(k) for k in distinct.tolist()])[place]
            sums[:active] += (moves & 255) - 128
            state[:active] = moves >> 8
        total[order] = sums
        return total


def utf8_lengths(points: np.ndarray) -> np.ndarray:
    return (1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)


class Counter:
    """Token counts of whole texts by the two transducers."""

    def __init__(self, path: str):
        self.cut = Pretokenizer()
        self.transducer = CountTransducer(path)

    def __call__(self, texts: list[str]) -> np.ndarray:
        joined, points, begin, end, before = self.cut.spans(texts)
        if not len(begin):
            return np.zeros(len(texts), np.int64)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        if len(data) != len(points):
            place = np.concatenate(([0], np.cumsum(utf8_lengths(points))))
            begin, end = place[begin], place[end]
        counts = self.transducer.counts(data, begin, end)
        if self.cut.special in joined:
            mark = self.cut.special.encode()
            size = end - begin
            for k in np.flatnonzero(size == len(mark)).tolist():
                if data[begin[k] : end[k]].tobytes() == mark:
                    counts[k] = 1
        run = np.concatenate(([0], np.cumsum(counts)))
        return run[before[1:]] - run[before[:-1]]


class Encoder:
    """Token ids of whole texts as the ``tokenizers`` library gives them.

    The library encodes each distinct pre-token once; pre-tokens are told apart by
    64-bit hashes, and when more than ``most_words`` are known the memory starts afresh.
    """

    def __init__(self, path: str, most_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        newline = self.library.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else -1
        self.cut = Pretokenizer()
        self.most_words = most_words
        self._afresh()

    def _afresh(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.slot = np.zeros(0, np.int64)  # the place of each in offset
        self.offset = np.zeros(1, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _encode(self, words: list[str], block: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each); the library gets them joined by line feeds, which merge with no word that it is given so."""
        ids, stops, n = [], [], 0
        for lo in range(0, len(words), block):
            [found] = self.library.encode_batch_fast(["\n".join(words[lo : lo + block]) + "\n"], add_special_tokens=False)
            part = np.array(found.ids, self.kind)
            ids.append(part)
            stops.append(np.flatnonzero(part == self.newline) + n)
            n += len(part)
        stop = np.concatenate(stops)
        if len(stop) != len(words):
            raise ValueError("a pre-token holds a line feed")
        flat = np.concatenate(ids)
        return flat[flat != self.newline], np.diff(stop, prepend=-1) - 1

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of any kind."""
        plain = np.fromiter((not w[-1].isspace() and w != self.cut.special for w in words), bool, len(words))
        if self.newline < 0:
            plain[:] = False
        rest = np.flatnonzero(~plain)
        others = [x.ids for x in self.library.encode_batch_fast([words[k] for k in rest.tolist()], add_special_tokens=False)]
        lengths = np.zeros(len(words), np.int64)
        lengths[rest] = np.fromiter(map(len, others), np.int64, len(others))
        flat = np.zeros(0, self.kind)
        if plain.any():
            flat, lengths[plain] = self._encode([words[k] for k in np.flatnonzero(plain).tolist()])
        out = np.empty(int(lengths.sum()), self.kind)
        start = np.cumsum(lengths) - lengths
        out[ranges(start[plain], lengths[plain])] = flat
        for k, ids in zip(rest.tolist(), others, strict=True):
            out[start[k] : start[k] + len(ids)] = ids
        return out, lengths

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets: n + 1)."""
        joined, points, begin, end, before = self.cut.spans(texts, scan=False)
        if not len(begin):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        keys = span_hashes(points + np.uint64(0x5851F42D4C957F2D), begin, end)
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > self.most_words:
            self._afresh()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            spans = first[new]
            ids, lengths = self._learn([joined[a:b] for a, b in zip(begin[spans].tolist(), end[spans].tolist(), strict=True)])
            self.slot = np.insert(self.slot, at[new], len(self.offset) - 1 + np.arange(len(spans)))
            self.known = np.insert(self.known, at[new], distinct[new])
            self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(lengths)))
            self.ids = np.concatenate((self.ids, ids))
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][place]
        low = self.offset[slot]
        size = self.offset[slot + 1] - low
        return self.ids[ranges(low, size)], np.concatenate(([0], np.cumsum(size)))[before]
