"""Small helpers against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandbase.operators.entropy import control_codecs, huffman_lengths, package_merge
from strandbase.operators.match import references, replay
from strandbase.operators.metrics import pareto
from strandbase.plans.ordered import block_of, global_rank, previous, running_sum


@given(st.lists(st.sampled_from([b"a", b"ab", b"abc", b"\0", b"xyzw", b"q" * 9])).map(b"".join), st.booleans())
@settings(deadline=None)
def test_references_round_trip(data, lazy):
    assert replay(references(data, lazy)) == data


@given(st.dictionaries(st.integers(0, 255), st.integers(1, 10**6), min_size=2, max_size=60))
@settings(deadline=None)
def test_code_lengths(counts):
    for make in (huffman_lengths, package_merge):
        lengths = make(counts, 9)
        assert max(lengths.values()) <= 9
        assert sum(2.0**-n for n in lengths.values()) == 1.0
    cost = lambda x: sum(counts[s] * n for s, n in x.items())
    assert cost(package_merge(counts, 9)) <= cost(huffman_lengths(counts, 9))


@given(st.binary(max_size=500))
@settings(deadline=None, max_examples=20)
def test_control_codecs(data):
    for pack, unpack in control_codecs().values():
        assert unpack(pack(data)) == data


def test_ordered_plans(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") * 7919 % 101).alias("v")).repartition(5)
    values = [i * 7919 % 101 for i in range(1000)]
    run = {r.id: r.s for r in running_sum(df, block_of("id", 64), ["id"], F.col("v"), "s").collect()}
    assert run == {i: sum(values[:i]) for i in range(1000)}
    prev = {r.id: r.prev_v for r in previous(df, "id", ["v"], size=64).collect()}
    assert prev == {i: values[i - 1] if i else None for i in range(1000)}
    rank = {r.id: r.k for r in global_rank(df, F.floor(F.col("v") / 10), ["v", "id"], "k").collect()}
    order = sorted(range(1000), key=lambda i: (values[i], i))
    assert rank == {i: k + 1 for k, i in enumerate(order)}


def test_pareto_ties_and_empty(spark):
    points = [(1, 5.0), (1, 5.0), (2, 4.0), (2, 3.0), (3, 4.0), (0, 9.0)]
    got = sorted((r.x, r.y) for r in pareto(spark.createDataFrame(points, "x int, y double"), "x", "y").collect())
    assert got == [(0, 9.0), (1, 5.0), (1, 5.0), (3, 4.0)]
    assert pareto(spark.createDataFrame([], "x int, y double"), "x", "y").count() == 0


def test_stream_gives_the_batch_rows(spark, sf_dir):
    from strandbase.streaming.events import tumbling, tumbling_stream

    path = f"{sf_dir}/events.parquet"
    batch = sorted(tumbling(spark.read.parquet(path)).collect())
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-events-")
    os.symlink(path, os.path.join(folder, "events.parquet"))
    assert sorted(tumbling_stream(spark, folder, "tumbled").collect()) == batch


def test_span_take_cuts_whole_rows_by_offset(spark):
    from strandbase.operators.select import span_take

    texts = ["é" * (i % 5) + f"row {i}\n" if i % 11 else (None if i % 2 else "") for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, value string").repartition(7)
    ids = spark.createDataFrame([(i * 37 % 310,) for i in range(40)] + [(0,), (0,), (11,), (299,)], "row_id long")
    payload = b"".join((t or "").encode() for t in texts)
    got = {r.row_id: r for r in span_take(rows, ids).collect()}
    assert sorted(got) == sorted({i * 37 % 310 for i in range(40)} & set(range(300)) | {0, 11, 299})
    for i, r in got.items():
        assert r.start == sum(len((t or "").encode()) for t in texts[:i])
        assert r.value.encode() == payload[r.start : r.start + r.n_bytes] == (texts[i] or "").encode()


def test_codes_and_bits_are_of_a_huffman_coder(spark, sf_dir):
    import heapq
    from collections import Counter, defaultdict

    from strandbase import registry

    registry.load()
    counts = defaultdict(Counter)
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_name").collect():
        counts[r.p_brand].update(r.p_name.encode())
    bits = {}
    for g, c in counts.items():
        heap, bits[g] = sorted(c.values()), 0
        while len(heap) > 1:
            heapq.heappush(heap, both := heapq.heappop(heap) + heapq.heappop(heap))
            bits[g] += both
    assert {r.g: r.bits for r in registry.QUERIES["e4b_huffman_bits"](spark, sf_dir).collect()} == bits
    assert any(bits[g] < sum(c.values()) * (len(c) - 1).bit_length() for g, c in counts.items())
    codes = defaultdict(dict)
    for r in registry.QUERIES["e3b_huffman_codes"](spark, sf_dir).collect():
        assert 0 <= r.code < 1 << r.len
        codes[r.g][r.sym] = (r.len, r.code, r.n)
    for g, c in counts.items():
        assert {s: n for s, (_, _, n) in codes[g].items()} == c and sum(n * k for k, _, n in codes[g].values()) == bits[g]
        texts = sorted(f"{code:0{k}b}" for k, code, _ in codes[g].values())
        assert not any(b.startswith(a) for a, b in zip(texts, texts[1:]))
        assert [s for _, s in sorted((f"{codes[g][s][1]:0{codes[g][s][0]}b}", s) for s in c)] == sorted(c, key=lambda s: (codes[g][s][0], s))


def test_uuid_v1_fields(spark, sf_dir):
    import math
    import uuid

    from strandbase import registry
    from strandbase.operators.detect import UUID_V1

    registry.load()
    good = [str(uuid.UUID(fields=(i * 99_991 % 2**32, i * 7 % 2**16, 0x1000 + i % 4096, 0x80 + i % 64, i % 256, i * 123_456_789 % 2**48))) for i in range(200)] + ["ffffffff-ffff-1fff-bfff-ffffffffffff", "00000000-0000-1000-8000-000000000000"]
    bad = [str(uuid.UUID(int=5, version=4)), good[5].upper().replace("0", "A"), good[3] + "\n", "", None, good[1][:-1]]
    df = spark.createDataFrame([(v,) for v in good + bad], "value string")
    seen = {r.value: (r.time, r.clock, r.node) for r in UUID_V1.project(df, "value").where("matched").collect()}
    assert seen == {v: (u.time, u.clock_seq, u.node) for v in good for u in [uuid.UUID(v)]}
    assert tuple(UUID_V1.report(df, "value").first()) == (len(good + bad), len(good), len(good))
    r = registry.QUERIES["d5b_uuid_v1_detector"](spark, sf_dir).first()
    keys = [k.o_orderkey for k in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()]
    assert r.n_rows == r.n_match == r.n_roundtrip == len(keys) and r.base == min(keys) * 40 + 131_000_000_000_001_000
    assert r.step == math.gcd(*(40 * (k - min(keys)) for k in keys)) and r.any_bits & r.all_bits == r.all_bits > 0


def plain_pairs(texts, rounds, a_round, weights=None):
    """Coded texts, rules and cost after each round, by counting and rewriting lists."""
    from collections import Counter

    plain, made, costs = [list(t) for t in texts], [], []
    weights = weights or [1] * len(texts)
    met = {c for t in texts for c in t}
    symbols = iter([chr(k) for k in range(0xF0000, 0xF1000) if chr(k) not in met])
    while True:
        used = sum(len(t) * w for t, w in zip(plain, weights))
        costs.append((len(costs), used, len(made), 2 * used + 4 * len(made)))
        n = Counter()
        for t, w in zip(plain, weights):
            for p in zip(t, t[1:]):
                n[p] += w
        chosen, lefts, rights = {}, set(), set()
        for p in sorted((p for p in n if n[p] >= 2), key=lambda p: (-n[p], p))[: 4 * a_round]:
            if p[0] not in rights and p[1] not in lefts and len(chosen) < a_round:
                chosen[p] = next(symbols)
                lefts.add(p[0])
                rights.add(p[1])
        if len(costs) - 1 == rounds or not chosen:
            return plain, made, costs
        made += [(*p, c) for p, c in chosen.items()]
        for t in plain:
            i = 0
            while i < len(t) - 1:
                if (t[i], t[i + 1]) in chosen:
                    t[i : i + 2] = [chosen[t[i], t[i + 1]]]
                i += 1


@pytest.mark.parametrize("rounds,a_round,weighted", [(None, 1, False), (None, 3, True), (4, 16, False)])
def test_pairs_are_replaced_as_by_hand(spark, rounds, a_round, weighted):
    from strandbase.operators.dictionary import byte_pairs, expand, rule_table, rule_texts

    texts = ["abab cab", "cababab", "xyz", "", "aaaaaaa", "日本語の日本語", "\U000f0000 taken \U000f0000 taken 😀😀😀", "a.b*a.b*", "one one one"]
    weights = [1 + i % 3 for i in range(len(texts))] if weighted else None
    df = spark.createDataFrame([(i, t, (weights or [9] * 99)[i]) for i, t in enumerate(texts)] + [(99, None, 5)], "id long, text string, w long")
    coded, rules, ledger = byte_pairs(df, "id", "text", rounds=rounds, a_round=a_round, weight="w" if weighted else None)
    plain, made, costs = plain_pairs(texts, rounds, a_round, weights)
    assert rules == made and [(r["round"], r["tokens"], r["rules"], r["cost"]) for r in ledger] == costs
    assert {r.id: r.coded for r in coded.collect()} == {99: None, **{i: "".join(t) for i, t in enumerate(plain)}}
    table = rule_table(spark, rules)
    assert {r.id: r.text for r in expand(coded, table, "id").collect()} == {99: None, **dict(enumerate(texts))}
    spelled, depth = {}, {}
    for a, b, c in made:
        spelled[c] = spelled.get(a, a) + spelled.get(b, b)
        depth[c] = 1 + max(depth.get(a, 0), depth.get(b, 0))
    assert {r.id: (r.s, r.depth) for r in rule_texts(table).collect()} == {c: (spelled[c], depth[c]) for c in spelled}


@pytest.mark.parametrize("name,rounds,a_round", [("x8_stop_at_best_cost", 4, 16), ("x26_grammar_size_search", 3, 32)])
def test_costs_of_rounds(spark, sf_dir, name, rounds, a_round):
    from strandbase import registry

    names = [r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").collect()]
    _, _, costs = plain_pairs(names, rounds, a_round)
    found = registry.QUERIES[name](spark, sf_dir).collect()
    assert sorted((r.rules, r.tokens, r.cost) for r in found) == sorted((n, used, cost) for _, used, n, cost in costs)


def test_half_front_ranks(spark, sf_dir):
    from collections import Counter

    from strandbase import registry

    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").collect():
        t = r.p_name
        turned = sorted((t[i:] + t[:i], i) for i in range(len(t)))
        order = sorted(set(t))
        for c in (x[-1] for x, _ in turned):
            at = order.index(c)
            want[at] += 1
            order.insert(at // 2, order.pop(at))
    assert {r["rank"]: r.n for r in registry.QUERIES["z9_half_front_ranks"](spark, sf_dir).collect()} == want


def plain_references(data, least=4, chain=16, most=255):
    """Greedy: at each place the longest copy from the nearest of the last ``chain`` places with the same four bytes."""
    out, i, start = [], 0, 0
    while i < len(data):
        found = [j for j in range(i) if len(data) >= i + least and data[j : j + least] == data[i : i + least]][-chain:]
        size, back = max(((next((k for k in range(min(most, len(data) - i)) if data[j + k] != data[i + k]), min(most, len(data) - i)), j) for j in found), default=(0, 0))
        if not size:
            i += 1
            continue
        out.append((data[start:i], size, i - back))
        i += size
        start = i
    return [*out, (data[start:], 0, 0)]


def test_sequences_are_real_copies(spark, sf_dir):
    """Without laziness the parts are those of the plain search; with it, all copies are real and at most twice as much is left as literals."""
    pages = [r.html.encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(6).collect()]
    for data in (*pages, b"", b"a", b"abcabcabcabc", bytes(600)):
        assert references(data, False) == plain_references(data)
        parts, at = references(data), 0
        assert replay(parts) == data
        for lit, size, off in parts:
            at += len(lit)
            assert all(data[at + k] == data[at + k - off] for k in range(size)) and (size >= 4 or not size) and off <= at
            at += size
        literals = [sum(len(x) for x, _, _ in p) for p in (parts, plain_references(data))]
        assert literals[0] <= 2 * literals[1]
    assert references(b"abcabcabcabc") == [(b"abc", 9, 3), (b"", 0, 0)]


def test_too_long_pairs_dont_end_the_training(spark):
    from strandbase.operators.dictionary import byte_pairs

    df = spark.createDataFrame([(i, "abcdefghijkl") for i in range(9)] + [(9, "xy"), (10, "xy")], "id long, text string")
    _, rules, _ = byte_pairs(df, "id", "text", rounds=12, a_round=1, longest=2)
    assert [a + b for a, b, _ in rules] == ["ab", "cd", "ef", "gh", "ij", "kl", "xy"]


def test_merged_contexts_lose_least():
    from strandbase.operators.dictionary import merge_contexts

    counts = {"a": {"x": 90, "y": 10}, "b": {"x": 9, "y": 1}, "c": {"z": 50}, "d": {"z": 7, "x": 1}, "e": {"w": 5}}
    assert merge_contexts(counts, 3) == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    assert merge_contexts(counts, 9) == {c: i for i, c in enumerate("abcde")}
    assert set(merge_contexts(counts, 1).values()) == {0}


def test_half_front_ranks_against_a_list(spark, sf_dir):
    from collections import Counter

    from strandbase import registry

    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").collect():
        s = r.p_name
        turned = sorted((s[i:] + s[:i], i) for i in range(len(s)))
        last = [t[-1] for t, _ in turned]
        order = sorted(set(last))
        for c in last:
            at = order.index(c)
            want[at] += 1
            order.remove(c)
            order.insert(at // 2, c)
    assert {r["rank"]: r.n for r in registry.QUERIES["z9_half_front_ranks"](spark, sf_dir).collect()} == dict(want)


def test_sequences_cost_less_than_literals_and_their_classes_add_up(spark, sf_dir):
    from strandbase import registry
    from strandbase.operators.match import references, replay

    n = literals = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        data = r.html.encode()
        parts = references(data)
        assert replay(parts) == data
        at = 0
        for lit, size, off in parts:  # every copy repeats what stands there
            at += len(lit)
            assert data[at : at + size] == bytes(data[at - off + k % off] for k in range(size)) if size else True
            at += size
        n, literals = n + len(parts), literals + sum(len(p[0]) for p in parts)
        assert sum(len(p[0]) for p in parts) < 0.7 * len(data)
    rows = registry.QUERIES["z5_sequence_classes"](spark, sf_dir).collect()
    assert (sum(r.n for r in rows), sum(r.literal_bytes for r in rows)) == (n, literals)


def test_exact_medians(spark):
    from statistics import median

    from strandbase.operators.metrics import exact_medians

    groups = {"a": [1.0], "b": [1.0, 2.0], "c": [5.0] * 7 + [1.0, 9.0], "d": [float(k * 37 % 101) for k in range(100)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    assert {r.g: (r.median, r.low, r.high) for r in exact_medians(df, "g", "v").collect()} == {g: (median(v), min(v), max(v)) for g, v in groups.items()}


def test_matches_leave_a_task_in_small_batches(monkeypatch):
    """What a task holds doesn't grow with the rows of an incoming batch, and all rows and kept columns come out in order."""
    import pyarrow as pa

    from strandbase.operators import match

    monkeypatch.setattr(match, "BATCH_BYTES", 1000)
    values = [None if k % 7 == 3 else b"abcd" * (k % 50) for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(range(500))], ["v", "k"])
    out = list(match._rows_out(iter([batch]), lambda v: v + b"!", "w", pa.binary(), len))
    assert [(r["k"], r["w"]) for b in out for r in b.to_pylist()] == [(k, None if v is None else v + b"!") for k, v in enumerate(values)]
    assert max(sum(len(r["w"] or b"") for r in b.to_pylist()) for b in out) <= 1000 + 201


def test_match_verification_counts_rows_with_repeated_ids_and_null_texts(spark, tmp_path):
    from strandbase import registry

    spark.createDataFrame([(1, "abcabcabc"), (1, "abcabcabc"), (1, "xyz"), (2, None), (3, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert tuple(registry.QUERIES["z6_match_verification"](spark, str(tmp_path)).first()) == (5, 5)
    assert sum(r.literal_bytes for r in registry.QUERIES["z5_sequence_classes"](spark, str(tmp_path)).collect()) == 9


def test_turns_beyond_a_thousand_keep_their_conversation(spark, tmp_path):
    from strandbase import registry

    spark.createDataFrame([(1, 1500, "a"), (2, 500, "b"), (None, 1, "c")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {(r.conv_id, r.turn) for r in registry.QUERIES["z1_lazy_matches_roundtrip"](spark, str(tmp_path)).collect()} == {(1, 1500), (2, 500), (None, 1)}


def test_characters_of_positions_are_hashed_before_anything_is_sorted(spark):
    from strandbase.operators.detect import positional_mask

    df = spark.createDataFrame([("ab1",), ("ab2",), ("xb",), (None,), ("ab1",)], "v string")
    found = positional_mask(df, "v")
    assert sorted(map(tuple, found.collect())) == [(1, 2, "a"), (2, 1, "b"), (3, 2, "1")]
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "HashAggregate" in [line for line in plan if "Aggregate" in line][-1]  # the one next to the rows


def test_phrases_are_compiled_and_take_any_blanks(spark, tmp_path):
    from strandbase import registry

    registry.load()
    texts = [" a  b\n\nc d ", "a b c", "\na b\tc c", "x y", "", None, " \n "]
    spark.createDataFrame([(i, t) for i in range(9) for t in texts], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["x14_phrase_candidates"](spark, str(tmp_path))
    assert {r.phrase: r.n for r in found.collect()} == {"a b c": 18}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_symbols_are_those_of_arrays(spark):
    from strandbase.operators.dictionary import pair_counts, symbol_pairs

    texts = ["abab", "b", "", None, "a\U000f0000b", "aaa", "x\n a", "日本日本"]
    df = spark.createDataFrame([(t, 1 + i) for i, t in enumerate(texts)], "coded string, weight long")
    want = pair_counts(df.select(F.split("coded", "").alias("t"), "weight"), "t", "weight")
    assert sorted(map(tuple, symbol_pairs(df, "coded", "weight").collect())) == sorted(map(tuple, want.collect()))


def test_codes_are_spelled_where_they_stand(spark):
    from strandbase.operators.dictionary import expand, rule_table

    df = spark.createDataFrame([(i % 2, t, i) for i, t in enumerate(["\U000f0001c", "", None, "ab\U000f0000"])], "id long, coded string, w long")
    rules = rule_table(spark, [("a", "b", "\U000f0000"), ("\U000f0000", "b", "\U000f0001")])
    found = expand(df, rules, "id", ("w",))  # ids may repeat
    assert {(r.id, r.w, r.text) for r in found.collect()} == {(0, 0, "abbc"), (1, 1, ""), (0, 2, None), (1, 3, "abab")}
    assert not any(word in found._jdf.queryExecution().optimizedPlan().toString() for word in ("Join", "Aggregate"))


def test_what_makes_the_texts_runs_once_before_pairs_are_learned(spark):
    from strandbase.operators.dictionary import byte_pairs

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, "abab") for i in range(50)], "id long, text string")
    byte_pairs(df.mapInArrow(count, df.schema), "id", "text", rounds=2)
    assert seen.value == 50
