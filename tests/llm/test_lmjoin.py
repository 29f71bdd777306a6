import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return brute.table(spark).cache()


@pytest.mark.parametrize("bits", [12, 27, 33, 40])
@pytest.mark.parametrize("width", [1, 2, 3])
def test_blocks_of_any_width(bits, width):
    from strandbase.llm.lmjoin import decode, encode

    rng = np.random.default_rng(bits)
    columns = [rng.integers(0, 1 << bits, 3000).astype(np.uint64) for _ in range(width)]
    sums = [rng.integers(0, 1 << 40, 3000), np.zeros(3000, np.int64)]
    back, n = decode(encode(columns, sums, bits), 3000, width, 2, bits)
    assert all((a == b).all() for a, b in zip([*columns, *sums], [*back, *n], strict=True))


@pytest.mark.parametrize("flush", [1, 300, 1 << 20])
@pytest.mark.parametrize("pivot", [2, 40, 1 << 19])
def test_op1_is_scored_where_it_is_counted(spark, docs, flush, pivot, monkeypatch):
    """Frames, split words, split pairs of words; no array that each part of the texts is looked up in is left of n-grams."""
    from strandbase.llm import lmscore
    from strandbase.llm.shared import shared_root

    monkeypatch.setattr(lmscore, "SHARD_KEYS", 200)
    monkeypatch.setattr(lmscore, "PIVOT_KEYS", pivot)
    monkeypatch.setattr(lmscore, "FLUSH", flush)
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/*/*.bin")
    files = lambda: {str(x.getPath().getName()).rsplit("-", 1)[0] for x in store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(store) or [] if x.getModificationTime() >= began}
    began = spark.sparkContext._jvm.System.currentTimeMillis()
    rows = docs.collect()
    expected = brute.kneser_ney([r.text for r in rows], [i for i, r in enumerate(rows) if brute.crc_fold(r.doc_id) != 2], 3, lmscore.discounts_from)
    got = lmscore.score_held_out(docs, 3).collect()
    assert files() == {"words", "after"}
    want = sorted((r.doc_id is None, r.doc_id or 0, brute.crc_fold(r.doc_id) == 2, n, known, total, round(base, 5), round(full, 5)) for r, (base, full, known, n, total) in zip(rows, expected, strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_op1_learns_nothing_and_keeps_columns(spark, docs):
    from strandbase.llm.lmjoin import score_table

    named = docs.withColumns({"name": F.concat(F.lit("n"), F.col("doc_id").cast("string")), "part": F.struct("doc_id")})
    got = score_table(named, F.lit(None).cast("boolean"), "name", keep=("part",)).collect()
    assert sorted(str(r.name) for r in got) == sorted(str(r.name) for r in named.collect())
    assert all(r.name is None or r.name == f"n{r.part.doc_id}" for r in got)
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_op1_arrays_are_read_where_asked(tmp_path, monkeypatch):
    """A lookup of exceptions searches their places and doesn't go through all keys of the shard."""
    from strandbase.llm import hasharrays

    keys = np.sort(np.random.default_rng(3).integers(0, 2**63, 300_000, dtype=np.uint64))
    rows = np.ones((len(keys), 1), np.int64)
    rows[::3, 0] = np.arange(len(rows[::3])) + 5
    arrays = hasharrays.CountArrays(str(tmp_path), "x", 0, 1)
    arrays.write(0, keys, rows)
    sizes = []
    whole = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: (sizes.append(len(x)), whole(x))[1])
    there, found = arrays.of(keys[3000:3010])
    assert there.all() and (found == rows[3000:3010]).all() and max(sizes, default=0) <= 10
