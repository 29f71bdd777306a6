"""Plain versions of the operators, and small tables with every awkward case."""

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tie string, words long, keep boolean, n_removed string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def space_words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(t)) if w]


def awkward_texts():
    base = [f"w{i * 7919 % 997} of the thing number{i}" for i in range(40)]
    passage = " ".join(base[:12])
    return [
        "", None, " ", "\n", "\n\n", "a", "A a\tA", passage, passage, passage + " Extra", passage.replace("w0", "W0"),
        "\n".join([passage, "short line", passage]), "short line\nother", "short line", "é ß 中文 😀 'tis it's <|endoftext|> x  y\r\n",
        "x" * 5000, "ab " * 3000, " ".join(base * 30), "\0\0 nul", passage + "\n" + " ".join(base[20:32]), " ".join(base[20:32]), "tail\n",
    ]


def table(spark, texts=None, repeat=True):
    texts = awkward_texts() if texts is None else texts
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t), "clash", None, i, None, "x") for i, t in enumerate(texts)]
    if repeat and rows:
        rows += [rows[7], rows[7], (None, texts[7], "en", "src0", 3, "clash", None, 1, True, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def fingerprint(t, k=4):
    w = space_words(t)
    if not w:
        return 0
    found = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(t, k=5):
    w = space_words(t)
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar(a, b, least=0.8):
    return a == b or len(a & b) / len(a | b) >= least - 1e-9


def components(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_copies(texts):
    """The first of each text's group: links of candidates by pairs of words, then of those that are similar."""
    prints = [fingerprint(t, 2) for t in texts]
    candidates = components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 7)
    sets = [shingles(t) for t in texts]
    return components(len(texts), lambda i, j: candidates[i] == candidates[j] and similar(sets[i], sets[j]))


def removed_lines(docs):
    """{(place of the document): [line numbers]} for (key, text) in order; equal keys are one document."""
    seen, out = [], {}
    for key, text in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0][0] is not None, d[0])):
        gone = []
        own = []
        for i, line in enumerate(text.split("\n")):
            w = space_words(line)
            s = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
            if s and any(len(s & o) / len(s | o) >= 0.8 - 1e-9 for o in seen + own):
                gone.append(i)
            if s:
                own.append(s)
        seen += own
        out[key] = gone
    return out


def hits(docs, items, window=10):
    split = lambda t: [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)) if x]
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(k))
    out = []
    for t in docs:
        w, found = split(t), set()
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if got := windows.get(tuple(w[i : i + size])):
                    found |= got
                    hit[i : i + size] = [True] * size
        out.append((len(w), sum(hit), sorted(found)))
    return out


def kneser_ney(texts, train, order, discounts):
    """(base, full) log10 scores of each text; learned from the texts at ``train``."""
    tokens = [[*space_words(t), "</s>"] for t in texts]
    count = {order: Counter()}
    words = Counter()
    for k in train:
        words.update(tokens[k])
        t = ["<s>"] * (order - 1) + tokens[k]
        count[order].update(tuple(t[i : i + order]) for i in range(len(tokens[k])))
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    d = {k: (0, *discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4)))) for k, c in count.items()}
    context = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in count}
    for k, c in count.items():
        for g, v in c.items():
            row = context[k][g[:-1]]
            row[0] += v
            row[min(v, 3)] += 1
    n, v = sum(words.values()), len(words)

    def p(g):
        if not g:
            return 1 / (v + 1)
        row = context[len(g)].get(g[:-1])
        if not row:
            return p(g[1:])
        c, dd = count[len(g)].get(g, 0), d[len(g)]
        return (c - dd[min(c, 3)] + (dd[1] * row[1] + dd[2] * row[2] + dd[3] * row[3]) * p(g[1:])) / row[0]

    out = []
    for t in tokens:
        padded = ["<s>"] * (order - 1) + t
        out.append((sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(t))), sum(w in words for w in t), len(t), n))
    return out


def crc_fold(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 7
