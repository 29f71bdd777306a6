import itertools
import io
import tarfile
import zipfile

import pytest

from strandbase.sources.framing import read_framed, read_members, split_rows


def rows(df):
    return [(r.row_id, bytes(r.value)) for r in df.orderBy("file", "row_id").collect()]


@pytest.mark.parametrize(
    "content, framing, expected",
    [
        (b"alpha\n\nbeta\ntail", "lf", [b"alpha\n", b"\n", b"beta\n", b"tail"]),
        (b"alpha\n\nbeta\n", "lf", [b"alpha\n", b"\n", b"beta\n"]),
        (b"\n", "lf", [b"\n"]),
        (b"a\r\nb\n", "lf", [b"a\r\n", b"b\n"]),
        (b"q1\0q2\nx\0", "nul", [b"q1\0", b"q2\nx\0"]),
        (b"any\n\0thing", "none", [b"any\n\0thing"]),
        ("é😀\nß".encode(), "lf", ["é😀\n".encode(), "ß".encode()]),
    ],
)
def test_framing(spark, tmp_path, content, framing, expected):
    (tmp_path / "column").write_bytes(content)
    assert rows(read_framed(spark, str(tmp_path), framing)) == list(enumerate(expected))


def test_framing_joint_rows(spark, tmp_path):
    data = [f"row {i}: {'abc' * (i % 9)}\n".encode() for i in range(203)]
    (tmp_path / "a").write_bytes(b"".join(data))
    (tmp_path / "b").write_bytes(b"one\ntwo")
    found = read_framed(spark, str(tmp_path)).orderBy("file", "row_id").collect()
    assert [bytes(r.value) for r in found] == [*data, b"one\n", b"two"]
    assert [r.row_id for r in found] == [*range(203), 0, 1]


def test_split_rows_keeps_every_byte(spark):
    texts = ["", "\n", "a", "a\n", "a\n\nb", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {}
    for r in split_rows(df, "k", "t").orderBy("k", "row_no").collect():
        found[r.k] = found.get(r.k, "") + r.value
    assert found == {1: "\n", 2: "a", 3: "a\n", 4: "a\n\nb"}


def test_archives(spark, tmp_path):
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "a.zip", "w") as z:
        z.writestr("x.txt", b"one")
        z.writestr("y.txt", b"two")
    got = {r.member: bytes(r.content) for r in read_members(spark, str(tmp_path / "z"), "zip", ["x.txt", "y.txt"]).collect()}
    assert got == {"x.txt": b"one", "y.txt": b"two"}
    with pytest.raises(Exception, match="unexpected members"):
        read_members(spark, str(tmp_path / "z"), "zip", ["x.txt"]).collect()
    (tmp_path / "t").mkdir()
    with tarfile.open(tmp_path / "t" / "a.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("m")
        info.size = 4
        t.addfile(info, io.BytesIO(b"data"))
    assert [bytes(r.content) for r in read_members(spark, str(tmp_path / "t"), "tar").collect()] == [b"data"]


def test_byte_limits_of_the_reference(spark):
    import pyarrow.parquet as pq

    from strandbase import registry

    registry.load()
    d = "/root/testdata/sf0.1"
    docs = sorted(zip(*pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    sizes = [len(line.encode()) + 1 for _, text in docs for line in text.split("\n")]
    before = [0, *itertools.accumulate(sizes)][:-1]
    assert before[-1] > 7_000_000
    for name, expected in (("s4b_scan_seven_megabytes", [b for b in before if b <= 7_000_000]), ("s9b_hundred_megabyte_prefix", [b for b in before if b < 100_000_000])):
        got = registry.QUERIES[name](spark, d).toPandas()["before"]
        assert sorted(got) == expected
