"""Orders with gaps, nulls, one common prefix, few or many equal counts, and very long values."""

import pytest
from pyspark.sql import functions as F

from strandbase.plans import ordered


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)


IDS = [0, 1, 2, 3, 9, 10, 33, 64, 65, 4100, 4101, 10**6, 10**12, 10**12 + 1]


@pytest.mark.parametrize("size", [4, 4096])
def test_previous_over_gaps(spark, size):
    df = spark.createDataFrame([(i, f"v{i}") for i in IDS], "id long, v string")
    got = {r.id: r.prev_v for r in ordered.previous(df, "id", ["v"], size).collect()}
    assert got == {i: f"v{p}" if p is not None else None for p, i in zip([None, *IDS], IDS)}


def test_one_run_over_gaps(spark):
    from strandbase.operators.integers import runs

    df = spark.createDataFrame([(i, "same") for i in IDS], "id long, v string")
    assert [(r.v, r.first, r.n) for r in runs(df, "id", "v").collect()] == [("same", 0, len(IDS))]


def test_running_sum_over_gaps_and_a_null_id(spark):
    df = spark.createDataFrame([(None, 5), *((i, i % 7) for i in IDS)], "id long, v long")
    got = {r.id: r.s for r in ordered.running_sum(df, ordered.block_of("id", 4), ["id"], F.col("v"), "s").collect()}
    at, want = 5, {None: 0}
    for i in IDS:
        want[i] = at
        at += i % 7
    assert got == want


def test_ranked_by_equal_counts_and_one_prefix(spark):
    values = [("https://one.host/" + "x" * (k % 5) + str(k), 1) for k in range(500)]
    df = spark.createDataFrame(values, "v string, n long")
    got = {r.v: r.k for r in ordered.ranked(df, [F.desc("n"), "v"], "k").collect()}
    assert got == {v: k + 1 for k, v in enumerate(sorted(v for v, _ in values))}
    dealt = [r.n for r in ordered.by_ranges(df, [F.desc("n"), "v"]).groupBy("__b").agg(F.count("*").alias("n")).collect()]
    assert len(dealt) == 8 and max(dealt) < 150
    sums = {r.v: r.s for r in ordered.ranked(df, ["v"], "s", F.length("v")).collect()}
    at = 0
    for v in sorted(sums):
        assert sums[v] == at
        at += len(v)


def test_predecessor(spark):
    values = [f"https://one.host/{k * 7919 % 1000}" for k in range(300)]
    got = {r.v: r.prev for r in ordered.predecessor(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    asc = sorted(set(values))
    assert got == dict(zip(asc, [None, *asc]))


def test_checkpoints_without_the_first_row_of_a_block(spark):
    from strandbase.operators.select import checkpoints

    df = spark.createDataFrame([(i, "ab" * (i % 3 + 1)) for i in (0, 1, 33, 34, 64)], "id long, v string")
    got = sorted((r.id, r.offset, r.block_offset, r.inner_offset) for r in checkpoints(df, "id", "v").collect())
    assert got == [(0, 0, 0, 0), (1, 2, 0, 2), (33, 6, 6, 0), (34, 8, 6, 2), (64, 12, 12, 0)]


def test_front_coding_of_a_long_value(spark):
    from strandbase.operators.dictionary import front_coded

    long = "k" + "a" * 1_500_000
    got = {r.value[:3]: (r.lcp, len(r.suffix)) for r in front_coded(spark.createDataFrame([(long,), ("b",)], "v string"), "v", F.substring("v", 1, 1)).collect()}
    assert got == {"kaa": (0, 1_500_001), "b": (0, 1)}
