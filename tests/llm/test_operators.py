import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

PATH = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.table(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return brute.table(spark, [], repeat=False)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from strandbase.llm.tokencount import tokenizer_path

    return Tokenizer.from_file(tokenizer_path(PATH))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("order", [2, 3])
def test_op1(spark, docs, rows, empty, order):
    from strandbase.llm.lmscore import discounts_from, score_held_out

    expected = brute.kneser_ney([r.text for r in rows], [i for i, r in enumerate(rows) if brute.crc_fold(r.doc_id) != 2], order, discounts_from)
    want = sorted((r.doc_id is None, r.doc_id or 0, brute.crc_fold(r.doc_id) == 2, n, known, total, round(base, 5), round(full, 5)) for r, (base, full, known, n, total) in zip(rows, expected, strict=True))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in score_held_out(docs, order).collect())
    assert got == want
    assert score_held_out(empty, order).count() == 0


def test_op1_learns_nothing_from_nothing(spark, docs, empty):
    from strandbase.llm.lmscore import score, train

    r = score(docs, train(empty)).where("doc_id = 5").first()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_op1_probabilities_sum_to_one(spark, docs):
    from strandbase.llm.lmscore import END, shifted, tokens_of, train
    import pyarrow as pa

    texts = ["a b a c", "a b b", "c a b d e f a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = train(df, 2)
    words, _ = tokens_of(pa.array(["a b c d e f"]))
    follow = [np.array([words[0], w], np.uint64) for w in words]  # after "a": each word, the end, one unknown
    p = [model.probabilities(np.array(f), np.array([0, 2]))[1] for f in follow] + [model.probabilities(np.array([words[0], 12345], np.uint64), np.array([0, 2]))[1]]
    assert words[-1] == END and shifted(words, np.array([0, 7]), 1)[0] != words[0]
    assert math.isclose(sum(p), 1.0, rel_tol=1e-9)


def test_op1_query_has_two_words_of_context(spark, sf_dir):
    from strandbase.llm.lmscore import discounts_from
    from strandbase.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = brute.kneser_ney([r.text for r in rows], [i for i, r in enumerate(rows) if brute.crc_fold(r.doc_id) != 2], 3, discounts_from)
    got = {r.doc_id: r.score for r in QUERIES["op1_kneser_ney_scores"](spark, sf_dir).collect()}
    assert len(got) == len(rows) and all(math.isclose(got[r.doc_id], full, rel_tol=1e-6) for r, (_, full, *_) in zip(rows, expected, strict=True))


@pytest.mark.parametrize("bits", [12, 21, 22, 40])
def test_op1_blocks_of_any_width(bits):
    from strandbase.llm.lmscore import pack_block, unpack_blocks

    rng = np.random.default_rng(bits)
    columns = [rng.integers(0, 1 << bits, 5000).astype(np.uint64) for _ in range(4)]
    counts = [rng.integers(1, 1 << 40, 5000) for _ in range(2)]
    back, n = unpack_blocks([pack_block(columns, counts, bits)] * 2, 4, 2, bits)
    assert sorted(zip(*back, *n.T, strict=True)) == sorted([*zip(*columns, *counts, strict=True)] * 2)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_op1_split_pivots_and_many_shards(spark, docs, rows, order, monkeypatch):
    from strandbase.llm import lmscore

    monkeypatch.setattr(lmscore, "SHARD_KEYS", 200)
    monkeypatch.setattr(lmscore, "PIVOT_KEYS", 7)
    expected = brute.kneser_ney([r.text for r in rows], range(len(rows)), order, lmscore.discounts_from)
    model = lmscore.train(docs, order)
    assert model.layout.bits > 3
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 5)) for r in lmscore.score(docs, model).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, n, round(full, 5)) for r, (_, full, _, n, _) in zip(rows, expected, strict=True))


def test_op1_counts_beyond_32_bits(tmp_path):
    from strandbase.llm.hasharrays import CountArrays

    keys = np.sort(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    rows = np.ones((5000, 4), np.int64)
    rows[7] = (1 << 40, 3, 1 << 33, 5)
    rows[100:800, 1] = np.arange(700)
    for bits in (0, 1):
        arrays = CountArrays(str(tmp_path), f"x{bits}", bits, 4)
        arrays.write(0, keys, rows)
        there, found = arrays.of(np.append(keys[::-1], np.uint64(12345)))
        assert there[:-1].all() and not there[-1] and (found[:-1] == rows[::-1]).all()


def test_op2(spark, docs, rows, empty):
    from strandbase.llm.media import audio_features, read_tensors, store_media

    got = audio_features(store_media(docs)).collect()
    assert len(got) == len(rows)
    texts = Counter((r.text or "").encode() for r in rows)
    seen = defaultdict(set)
    payloads = {hashlib.sha256(t + b"\0" * (-len(t) % 64 if t else 64)).hexdigest(): t for t in texts}
    for r in got:
        t = payloads[r.payload_sha256]
        p = t + b"\0" * (-len(t) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(t), len(p), zlib.crc32(p[-64:]))
        seen[t].add((r.media_bytes, r.media_sha256, r.feature, bytes(r.tensors)))
        patches, spans = read_tensors(bytes(r.tensors))
        assert patches.shape[1:] == (32, 24) and len(spans) == len(patches) and (spans[:, 1] > spans[:, 0]).all()
        for s in r.segments:
            assert 0 <= s.start_ms < s.end_ms
    assert all(len(v) == 1 for v in seen.values())
    assert audio_features(store_media(empty)).count() == 0


def test_op2_silence_is_the_floor_of_every_band():
    from strandbase.llm.media import AudioSettings, features

    _, _, found, level = features(memoryview(bytes([128]) * 640), 8000, AudioSettings())
    assert np.allclose(level, -6.0) and not found


def test_op2_signal():
    from strandbase.llm.media import AudioSettings, from_wave, log_mel, resample, segments, to_wave

    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000).astype(np.float32)
    out = resample(tone, 3, 4, 12)
    assert len(out) == 6000
    assert np.abs(out[50:-50] - np.sin(2 * np.pi * 440 * np.arange(6000) / 6000)[50:-50]).max() < 1e-3
    high = np.sin(2 * np.pi * 3500 * np.arange(8000) / 8000).astype(np.float32)
    assert np.abs(resample(high, 3, 4, 12)[50:-50]).max() < 0.2  # beyond what the new rate can hold
    mel, _ = log_mel(out, 6000, AudioSettings())
    assert len(set(mel.argmax(1)[1:-1].tolist())) == 1
    assert segments(np.array([0, 1, 3, 1, 0, 1, 1, 0, 3.0]), 2, 1) == [(2, 4), (8, 9)]
    assert segments(np.zeros(3), 2, 1) == []
    rate, samples = from_wave(to_wave(b"abc", 8000))
    assert rate == 8000 and bytes(samples) == b"abc"


def test_op3_held_out_pages_and_edges(spark):
    from strandbase.llm.htmltext import blocks_of, extract, fit_weights, labelled_pages, main_text

    w = fit_weights()
    pages = list(labelled_pages(100, seed=1234))
    right = sum(extract("".join(p for p, _ in page), w) == "\n".join(b.text for p, y in page if y for b in blocks_of(p)) for page in pages)
    assert right >= 90
    html = [None, "", "plain words only", "<p>cut off <b>here &am", "<script>x</script>", "<article><p>a &amp; b&nbsp; c</p><p>d</p></article><footer>&copy; me</footer>", "<<<>>", "<div class=" + "x" * 10000]
    df = spark.createDataFrame([(i, None, h, "clash") for i, h in enumerate(html)] + [(None, "u", html[5], "x")], "page_id long, url string, html string, text string")
    got = main_text(df).collect()
    assert len(got) == len(html) + 1
    by = {r.page_id: r for r in got}
    assert by[0].text == by[1].text == by[4].text == "" and by[5].text == "a & b c\nd" == by[None].text and by[5].n_chars == 9
    assert main_text(df.limit(0)).count() == 0


def test_op3_visible_template(spark, sf_dir):
    import html
    import re

    from strandbase.llm.htmltext import main_text

    truth = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        truth[r.page_id] = "\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()} == truth


#: Layouts by hand, none written by the rules that weights are learned from: (page, its main text).
INDEPENDENT = [
    ("<body><div id='top-menu'><a href=/>Home</a> <a href=/n>News</a></div><article><h1>Rain</h1><p>It rained all day in the old town and nobody went out.</p><p>See <a href=x>a link of words</a></p></article><div class='usernote'><b>Ann</b><p>I do not think that it rained at all here, what a strange claim.</p></div></body>",
     "Rain\nIt rained all day in the old town and nobody went out.\nSee a link of words"),
    ("<body><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><main><h1>List of hills</h1><p>These hills are near the river.</p><ul><li><a href=1>First hill</a></li><li><a href=2>Second hill</a></li></ul><p>All of them can be climbed in a day by most people.</p></main><footer>Copyright the hill club</footer></body>",
     "List of hills\nThese hills are near the river.\nFirst hill\nSecond hill\nAll of them can be climbed in a day by most people."),
    ("<body><div class='cookie-consent-bar'>We use cookies to make this better for you. <button>Accept</button></div><div class='post-content'><h2>Soup</h2><p>Boil the water, add salt and wait for ten minutes.</p><aside class='newsletter-box'><p>Get our letter each week in your inbox</p></aside><p>Serve it hot with bread.</p></div><div class='sidebar'><h3>Popular</h3><ul><li><a>Cake</a></li></ul></div></body>",
     "Soup\nBoil the water, add salt and wait for ten minutes.\nServe it hot with bread."),
    ("<body><header><h1>The Daily Paper</h1><nav><a>World</a><a>Sport</a></nav></header><article><header><h1>Bridge opens</h1></header><p>The bridge was opened on Monday after three years of work.</p><blockquote><p>It is a fine bridge, said the mayor.</p></blockquote><form action=/s><label>Mail</label><input><p>Subscribe to the news</p></form><p>Traffic began at noon.</p></article><section class='comments'><div class='comment'><p>At last, I have waited for this bridge so long.</p></div></section></body>",
     "Bridge opens\nThe bridge was opened on Monday after three years of work.\nIt is a fine bridge, said the mayor.\nTraffic began at noon."),
]


@pytest.mark.parametrize("k", range(len(INDEPENDENT)))
def test_op3_independent_layouts(k):
    from strandbase.llm.htmltext import extract, fit_weights

    page, want = INDEPENDENT[k]
    assert extract(page, fit_weights()) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep words here", "<ul>" + "<div>" * 30_000 + "<li>x" * 30_000, "<p><b>a" * 50_000, "<div>" * 20_000 + "</span>" * 50_000, "".join(f"<i class=c{k}>" for k in range(30_000)) + "<p>x" * 20_000, "<svg>" * 30_000])
def test_op3_steps_do_not_grow_with_depth(page):
    import time

    from strandbase.llm.htmltext import blocks_of

    began = time.process_time()
    blocks_of(page)
    assert time.process_time() - began < 5


def test_op4(spark, docs, rows, empty, library):
    from strandbase.llm.packing import pack

    got = pack(docs).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter((r.doc_id, len(ids_of(library, r.text)) + 1) for r in rows)
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append([*ids_of(library, r.text), 1])
    pieces = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        assert any(t[r.start : r.start + r.length] == r.ids and crc(r.ids) == r.ids_crc32 for t in texts[r.doc_id])
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == {k: sum(map(len, v)) for k, v in texts.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(pieces.values()) // 2048)
    assert pack(empty).count() == 0


def test_op4_repeated_rows_are_dealt(spark):
    from strandbase.llm.packing import tokenised

    df = spark.range(2000).selectExpr("1L as doc_id", "'the same words again' as text").union(spark.range(50).selectExpr("id", "concat('text ', id)"))
    n = [r.n for r in tokenised(df, PATH, 1, 16, "doc_id", "text").groupBy("grp").agg(F.count("*").alias("n")).collect()]
    assert sum(n) == 2050 and len(n) == 16 and max(n) < 300


def test_op4_balance():
    from strandbase.llm.packing import pack_lengths

    sizes = np.random.default_rng(3).integers(1, 2048, 500)
    out = pack_lengths(sizes)
    filled, back = Counter(), Counter()
    for item, _, n, s, offset in sorted(out, key=lambda x: (x[3], x[4])):
        assert offset == filled[s]
        filled[s] += n
        back[item] += n
    assert [back[i] for i in range(500)] == sizes.tolist() and max(filled.values()) <= 2048
    assert len(filled) == -(-int(sizes.sum()) // 2048)


def test_op5(spark, sf_dir, docs, rows, empty):
    from strandbase.llm.quality import classify, keep_good

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    none = labels.limit(0)
    got = classify(docs, none).collect()
    assert len(got) == len(rows) and all(r.keep for r in got)  # nothing learned: all are good
    assert classify(empty, labels).count() == 0
    bad = spark.createDataFrame([(None, 1, 0), (3, None, None), (3, 0, 1), (3, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert keep_good(docs, bad).columns == docs.columns


def test_op5_held_out_accuracy(spark):
    from strandbase.llm.quality import classify

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    test = labels.where("doc_id % 2 = 1").collect()
    assert sum((got[r.doc_id].p_good >= 0.5) == (r.quality == 1) for r in test) >= 0.98 * len(test)
    assert sum((got[r.doc_id].p_toxic >= 0.5) == (r.toxic == 1) for r in test) >= 0.9 * len(test)
    clean = [r for r in test if r.quality == 1 and r.toxic == 0]
    assert sum(got[r.doc_id].keep for r in clean) >= 0.98 * len(clean)


@pytest.mark.parametrize("most", [200_000, 1])
def test_op6(spark, docs, rows, empty, most):
    from strandbase.llm.decontaminate import clean_documents, decontaminate

    items = [(1, "w0 of the thing number0"), (2, rows[7].text), (3, None), (4, "..."), (5, "SHORT line"), (6, "absent words here"), (10, rows[20].text), (11, rows[20].text), (None, "tail")]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, words string")
    found = brute.hits([r.text for r in rows], [i for i in items if i[0] is not None] + [])
    # an item without an id has windows but no name to list
    extra = brute.hits([r.text for r in rows], items)
    want = sorted((r.doc_id is None, r.doc_id or 0, n, extra[i][1], len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), extra[i][1] > 0) for i, (r, (n, _, f)) in enumerate(zip(rows, found, strict=True)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs, bench, most_broadcast=most).collect())
    assert got == want
    kept = clean_documents(docs, bench, most_broadcast=most)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)
    assert decontaminate(empty, bench).count() == 0
    assert {r.contaminated for r in decontaminate(docs, bench.limit(0)).collect()} == {False}


def test_op7(spark, docs, rows, empty):
    from strandbase.llm.simhash import keep_one, near_duplicates

    prints = [brute.fingerprint(r.text) for r in rows]
    groups = brute.components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = defaultdict(list)
    for g, r in zip(groups, rows, strict=True):
        least[g] += [r.doc_id] * (r.doc_id is not None)
    want = sorted((r.doc_id is None, r.doc_id or 0, f"{p:016x}", min(least[g])) for r, p, g in zip(rows, prints, groups, strict=True))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    assert got == want
    copies = defaultdict(list)
    for g, r in zip(brute.near_copies([r.text for r in rows]), rows, strict=True):
        copies[g] += [r.doc_id] * (r.doc_id is not None)
    kept = keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({min(v) for v in copies.values()})
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_op7_near_copies_are_verified(spark, monkeypatch):
    """A group of many near copies over cells of three sets, edited documents, and documents that only share words."""
    from strandbase.llm import similar
    from strandbase.llm.components import components
    from strandbase.llm.simhash import keep_one

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(900)]
    base = list(rng.choice(words, 120))
    texts = []
    for k in range(20):  # one word in 120 is another: a similarity of 0.92
        t = list(base)
        t[int(rng.integers(5, 115))] = f"edit{k}"
        texts.append(" ".join(t))
    for _ in range(30):
        t = list(rng.choice(words, int(rng.integers(3, 200))))
        texts += [" ".join(t), " ".join(t[1:] + ["end"]), " ".join(rng.permutation(t)), "\t".join(t).upper()]
    want = sorted(set(brute.near_copies(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows, size in ((1024, 16 << 20), (3, 16 << 20), (1024, 2000)):
        monkeypatch.setattr(similar, "CELL_ROWS", rows)
        monkeypatch.setattr(similar, "CELL_BYTES", size)
        assert sorted(r.doc_id for r in keep_one(df).collect()) == want
    # groups as given: two families with a chain between them, sets without shingles, a lone set, a small group
    near = [(1, k, " ".join(["x"] * (k % 2) + base[: 100 + 2 * k])) for k in range(12)] + [(1, 50 + k, texts[k]) for k in range(20)]
    near += [(1, 90 + k, "") for k in range(3)] + [(1, 99, "alone here")] + [(2, 200 + k, texts[k]) for k in range(2)]
    table = spark.createDataFrame(near + near[:5], "grp long, key long, text string")
    want = brute.components(len(near), lambda i, j: near[i][0] == near[j][0] and brute.similar(brute.shingles(near[i][2]), brute.shingles(near[j][2])))
    want = {near[i][1]: near[g][1] for i, g in enumerate(want) if want.count(g) > 1}
    for rows, pivots in ((1024, 8), (3, 8), (3, 1), (1, 2)):
        monkeypatch.setattr(similar, "CELL_ROWS", rows)
        monkeypatch.setattr(similar, "CELL_BYTES", 16 << 20)
        monkeypatch.setattr(similar, "PIVOTS", pivots)
        assert {r.node: r.component for r in components(similar.similar_edges(table)).collect()} == want
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(0, 60, 40)]
    monkeypatch.setattr(similar, "TILE", 7)
    got = set(zip(*(x.tolist() for x in similar.similar_pairs(sets[:20], sets[20:], 0.3)), strict=True))
    one = [set(s.tolist()) for s in sets]
    assert got == {(i, j) for i in range(20) for j in range(20) if one[i] == one[20 + j] or len(one[i] & one[20 + j]) / max(1, len(one[i] | one[20 + j])) >= 0.3}


def test_op7_links_are_complete(spark):
    from strandbase.llm import simhash

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres:
        for _ in range(30):
            p = int(c)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    groups = brute.components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    want = {s: signed[g] for s, g in zip(signed, groups, strict=True)}
    for hot in (4096, 3):
        old, simhash.HOT = simhash.HOT, hot
        try:
            found = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
        finally:
            simhash.HOT = old
        together = defaultdict(set)
        for s in signed:
            together[found.get(s, s)].add(s)
        expected = defaultdict(set)
        for s, g in want.items():
            expected[g].add(s)
        assert sorted(map(sorted, together.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("hub, most", [(1 << 12, 100_000), (2, 100_000), (2, 1)])
def test_components_with_hubs(spark, hub, most, monkeypatch):
    from strandbase.llm import components as c

    monkeypatch.setattr(c, "HUB", hub)
    monkeypatch.setattr(c, "MOST_HUBS", most)
    rng = np.random.default_rng(4)
    pairs = [(0, k) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(int(a), int(b)) for a, b in rng.integers(200, 320, (90, 2))] + [(139, 200)]
    want = brute.components(320, lambda i, j: (i, j) in pairs or (j, i) in pairs)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in c.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: want[x] for x in nodes}


@pytest.mark.parametrize("cell", [8192, 2])
def test_op8(spark, docs, rows, empty, cell):
    from strandbase.llm import linededup

    keyed = docs.withColumn("k", F.xxhash64("doc_id", "text")).collect()
    want = brute.removed_lines([((r.doc_id, r.k) if r.doc_id is not None else (None, r.k), r.text) for r in keyed])
    by_key = {(k[0], t): v for (k, t), v in zip([((r.doc_id, r.k), r.text) for r in keyed], [want.get((r.doc_id, r.k), []) for r in keyed], strict=True)}
    old, linededup.CELL = linededup.CELL, cell
    try:
        out = linededup.dedup_lines(docs.withColumn("original", F.col("text")))
        got = out.collect()
    finally:
        linededup.CELL = old
    assert len(got) == len(rows) and out.columns[: len(docs.columns)] == docs.columns
    assert {r.n_removed for r in got} == {"x", None}  # the input's column of that name stays
    for r in got:
        gone = by_key[r.doc_id, r.original]
        assert r.removed == gone and r._n_removed == len(gone)
        if r.original is None:
            assert r.text is None and r.n_lines == 0
        else:
            lines = r.original.split("\n")
            assert r.n_lines == len(lines) and r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert linededup.dedup_lines(empty).count() == 0


def test_op8_near_lines(spark):
    from strandbase.llm.linededup import dedup_lines

    rng = np.random.default_rng(11)
    line = [f"v{k}" for k in rng.integers(0, 10**6, 60)]
    texts = []
    for i in range(60):
        w = list(line)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"edit{i}"
        texts.append(" ".join(w) + "\nown line of document " + str(i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.removed_lines([((i, 0), t) for i, t in enumerate(texts)])
    assert {r.doc_id: r.removed for r in dedup_lines(df).collect()} == {k[0]: v for k, v in want.items()}


@pytest.mark.parametrize("table", [1 << 23, 5000])
def test_op8_blocks(table, monkeypatch):
    from strandbase.llm import linededup

    monkeypatch.setattr(linededup, "TABLE", table)
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(60, rng.integers(1, 50), replace=False)).astype(np.uint64) for _ in range(300)]
    sizes = np.array(list(map(len, sets)))
    queries, against = np.arange(1, 300, 2), np.arange(0, 300, 3)
    got = linededup.earliest_similar(sets, sizes, sizes, 0.6, queries, against)
    similar = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.6
    assert got.tolist() == [next((a for a in against.tolist() if a < q and similar(q, a)), -1) for q in queries.tolist()]
    assert all(len(b) * 4 * sum(len(sets[r]) for r in b) <= table or len(b) == 1 for b in linededup.bounded(against, sizes))


def test_op9(spark, docs, rows, empty, library):
    from strandbase.llm.tokencount import count_tokens

    key = lambda k: (k is None, k or 0)
    want = sorted((*key(r.doc_id), len((r.text or "").encode()), len(ids_of(library, r.text)), len(ids_of(library, r.text)) > 1024) for r in rows)
    assert sorted((*key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs).collect()) == want
    assert count_tokens(empty).count() == 0


def test_op9_transducers(library):
    import random

    from strandbase.llm.bpe import Counter as Tokens
    from strandbase.llm.bpe import CountTransducer, Encoder
    from strandbase.llm.tokencount import tokenizer_path

    pool = ["a", "b", "'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "1", "٣", "!", "é", "中", "<|endoftext|>", "<|end", "　", "😀", "\r\n", "'re", "\0", "the", "ing"]
    rnd = random.Random(17)
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["aaa" * 2000, " " * 700 + "x", "'" * 300]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    tokens, encode = Tokens(tokenizer_path(PATH)), Encoder(tokenizer_path(PATH), most_words=50)
    tokens.transducer.most = 200  # start afresh often
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        assert tokens(part).tolist() == [len(x) for x in want[lo : lo + 500]]
        ids, offsets = encode(part)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[lo : lo + 500]
    scan, local = tokens.cut.spans(texts), tokens.cut.spans(texts, scan=False)
    assert (scan[2] == local[2]).all()
    one = CountTransducer(tokenizer_path(PATH))
    assert one.count(b"antidisestablishmentarianism") == len(ids_of(library, "antidisestablishmentarianism"))


def test_op10(spark, docs, rows, empty, library):
    from strandbase.llm.wavelet import token_file

    got = sorted(token_file(docs).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    full = [(r.doc_id, [*ids_of(library, r.text), 2]) for r in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.first_id) for r in got) == Counter((k, len(i), crc(i), i[0]) for k, i in full)
    seen = Counter()
    by_id = {k: i for k, i in full if k not in (None, 7)}
    for r in got:  # one shard here
        assert r.doc_id not in by_id or r.first_id_rank == seen[r.first_id]
        seen.update(by_id.get(r.doc_id) or next(i for k, i in full if k == r.doc_id and crc(i) == r.ids_crc32))
    assert token_file(empty).count() == 0


def test_op10_small_shards(spark, docs, rows):
    from strandbase.llm.wavelet import token_file

    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    one = sorted(tuple(r)[:-1] for r in token_file(whole).collect())  # the rank is within a shard
    many = sorted(tuple(r)[:-1] for r in token_file(whole, shard_tokens=50, part_bytes=2000).collect())
    assert one == many


def test_wavelet_matrix():
    from strandbase.llm.wavelet import WaveletMatrix

    v = np.random.default_rng(1).integers(0, 300, 3000).astype(np.uint16)
    w = WaveletMatrix.from_buffer(WaveletMatrix.build(v, 9).to_bytes())
    assert (w.values() == v).all()
    for i in range(0, 3000, 41):
        k = int((v[:i] == v[i]).sum())
        assert (w.access(i), w.rank(int(v[i]), i), w.select(int(v[i]), k)) == (v[i], k, i)
    many = np.arange(0, 3000, 7)
    assert [x.tolist() for x in w.access_and_rank(many)] == [v[many].tolist(), [w.rank(int(v[i]), int(i)) for i in many]]
    assert w.select(5, 10**6) == -1 and w.rank(299, 3000) == (v == 299).sum()
    for n in (0, 1, 512, 513):
        assert WaveletMatrix.from_buffer(WaveletMatrix.build(v[:n], 9).to_bytes()).values().tolist() == v[:n].tolist()


def test_op3_svg_and_math():
    from strandbase.llm.htmltext import blocks_of, extract, fit_weights

    first, second = "the first of the words " * 6, "the second of the words " * 6
    page = "<html><body>{}<article><p>{}</p>{}<p>{}</p></article><footer class=footer>{}me</footer></body></html>".format
    plain = extract(page("", first, "", second, ""), fit_weights())
    assert plain == f"{first.strip()}\n{second.strip()}"
    icons = ["<svg/>", '<svg class="icon" width="9"/>', '<SVG data-x="a>b" />', "<math/>", "<svg><title/><style/><svg></svg><text>no</text></svg>", "<svg><foreignObject><p>no</p></foreignObject></svg>", '<svg viewBox="0 0 9 9"><path d="M0">', "<svg><title>no</title><g>", "<math><mi>"]
    for icon in icons:
        assert extract(page(icon, first, "", second, icon), fit_weights()) == plain
        assert extract(page("", first, icon, second, icon), fit_weights()) == plain
        assert [b.text for b in blocks_of(f"<p>a {icon}</p><p>b")] == ["a", "b"]
    formula = '<math display="inline"><mi>x</mi><mo>=</mo><mn>2</mn></math>'
    assert [b.text for b in blocks_of(f"<p>so {formula} holds</p><p>b <math/>c")] == ["so x=2 holds", "b c"]
    assert extract(page("", first + formula * 30, "", second, ""), fit_weights()) == f"{first}{'x=2' * 30}\n{second.strip()}"


def test_op3_pages_without_closed_svg_in_one_run():
    from strandbase.llm.htmltext import blocks_of

    assert [b.text for b in blocks_of("<a><svg/>one</a> two <svg viewBox='0'/> three")] == ["one two three"]
    assert [b.text for b in blocks_of("a <svg><desc>x")] == ["a"]
