import zlib

import numpy as np

from tests.llm import brute


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage's effect on what the one before it kept, by plain versions."""
    import corpus_pipeline
    from strandbase.llm.quality import classify
    from strandbase.llm.shared import materialise
    from strandbase.llm.tokencount import tokenizer_path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]

    def after(name, df):
        out = materialise(stages[name](spark, df, sf_dir), name)
        return out, out.collect()

    kept = {r.doc_id for r in classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").collect()}
    docs, rows = after("quality", docs)
    assert docs.columns == columns and {r.doc_id for r in rows} == kept

    gone = brute.removed_lines([((r.doc_id, 0), r.text) for r in rows])
    want = {}
    for r in rows:
        lines = r.text.split("\n")
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone[r.doc_id, 0])
        if left.strip(" ") or not gone[r.doc_id, 0]:
            want[r.doc_id] = left
    docs, rows = after("line_dedup", docs)
    assert docs.columns == columns and {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)

    rows.sort(key=lambda r: r.doc_id)
    want = {rows[g].doc_id for g in brute.near_copies([r.text for r in rows])}
    docs, rows = after("near_duplicates", docs)
    assert docs.columns == columns and {r.doc_id for r in rows} == want and len(rows) == len(want)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r.doc_id for r, (_, n, _) in zip(rows, brute.hits([r.text for r in rows], items), strict=True) if not n}
    docs, rows = after("decontamination", docs)
    assert docs.columns == columns and {r.doc_id for r in rows} == clean

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in rows}
    _, pieces = after("packing", docs)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())


def test_awkward_documents(spark, sf_dir):
    import corpus_pipeline
    from strandbase.llm.shared import materialise

    for docs in (brute.table(spark), brute.table(spark, [], repeat=False)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialise(stage(spark, docs, sf_dir), "awkward")
            assert k == 4 or docs.columns == columns


def test_op6_sql(spark):
    from strandbase.llm.queries import ORACLE_SQL, QUERIES
    from tests.parity import database, rows_of, rows_of_sql

    for name, sql in ORACLE_SQL.items():
        for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
            assert rows_of(QUERIES[name](spark, d)) == rows_of_sql(database(d), sql)
