"""The data sources, the sink, the line reader and exact quantiles."""

import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from booktext.operators import jobs
from booktext.sources import archives as A
from booktext.sources import stores


def archive(path, files: dict, cut: int | None = None) -> int:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(out.getvalue()[:cut])
    return len(out.getvalue())


@pytest.fixture
def shelf(tmp_path):
    big = random.Random(1).randbytes(2_000_000)
    archive(tmp_path / "b/one.epub", {"a.xhtml": "<p>A</p>", "big.jpg": big, "cover.jpg": b"cover", "b.css": "p{}"})
    archive(tmp_path / "b/sub/Two.EPUB", {"x.opf": "é".encode("utf-16")})
    archive(tmp_path / "b/cut.epub", {"a.xhtml": "<p>A</p>"}, cut=60)
    (tmp_path / "b/zero.epub").write_bytes(b"")
    (tmp_path / "b/other.txt").write_text("no book")
    return tmp_path / "b"


def test_listing_has_empty_files_and_takes_filters(spark, shelf):
    rows = {r["book_id"].rpartition("/")[2]: r["n_bytes"] for r in A.scan_library(spark, str(shelf)).collect()}
    assert rows.keys() == {"one.epub", "cut.epub", "zero.epub"} and rows["zero.epub"] == 0
    assert A.scan_library(spark, f"file://{shelf}", recurse=True).count() == 4
    assert A.scan_library(spark, str(shelf / "nowhere")).count() == 0
    found = stores.registered(spark).read.format("book_archives").option("recurse", "true").load(str(shelf))
    assert {(r["name"], r["size"], r["content"] is None) for r in found.filter(F.col("book_id").endswith("one.epub")).collect()} == {
        ("a.xhtml", 8, False), ("big.jpg", 2_000_000, True), ("cover.jpg", 5, True), ("b.css", 3, False)
    }
    broken = found.filter("error is not null").select("book_id").collect()
    assert {r["book_id"].rpartition("/")[2] for r in broken} == {"cut.epub", "zero.epub"}


def test_filters_on_addresses_are_pushed():
    reader = stores.ArchiveReader({"path": "/x"})
    asked = [stores.EqualTo(("book_id",), "/x/a"), stores.EqualTo(("name",), "n"), stores.StringEndsWith(("book_id",), "a")]
    assert list(reader.pushFilters(asked)) == asked[1:2] and reader._passes("/x/a") and not reader._passes("/x/b")


def test_partitions_hold_so_many_bytes(shelf, monkeypatch):
    monkeypatch.setattr(stores, "PARTITION_BYTES", 1_000)
    parts = stores.ArchiveReader({"path": str(shelf), "recurse": "true"}).partitions()
    assert sum(len(p.files) for p in parts) == 4 and all(len(p.files) == 1 or sum(f[1] for f in p.files) <= 1_000 for p in parts) and len(parts) > 1


def test_images_are_not_inflated(shelf, monkeypatch):
    """Of an archive of 2 MB, the directory and the wanted entries are read: some kilobytes."""
    read = []
    plain = zipfile.ZipFile

    class Counted(io.RawIOBase):
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            data = self.f.read(n) if n >= 0 else self.f.read()
            read.append(len(data))
            return data

        seek, tell, seekable = (lambda self, *a: self.f.seek(*a)), (lambda self: self.f.tell()), (lambda self: True)

    monkeypatch.setattr(stores.zipfile, "ZipFile", lambda f: plain(Counted(f)))
    rows = list(stores.entry_rows(str(shelf / "one.epub"), stores.re.compile(stores.KINDS)))
    assert [r[1] for r in rows] == ["a.xhtml", "big.jpg", "cover.jpg", "b.css"] and rows[1][3] is None and sum(read) < 100_000
    assert [r[3] for r in stores.entry_rows(str(shelf / "one.epub"), A._NONE, None, {"cover.jpg"})] == [b"cover"]


def test_texts_of_entries(spark, shelf, tmp_path):
    archive(tmp_path / "t/t.epub", {"bom.html": b"\xef\xbb\xbfA", "le.html": "Aé".encode("utf-16"), "be.html": b"\xfe\xff" + "é漢".encode("utf-16-be"), "bad.html": b"A\xffB\x80C", "empty.html": b""})
    rows = {r["name"]: r["text"] for r in A.explode_archives(A.scan_library(spark, str(tmp_path / "t"))).collect()}
    assert rows == {"bom.html": "A", "le.html": "Aé", "be.html": "é漢", "bad.html": "A�B�C", "empty.html": ""}
    wanted = spark.createDataFrame([(str(shelf / "one.epub"), "cover.jpg"), (str(shelf / "one.epub"), "none"), (str(shelf / "cut.epub"), "a.xhtml")], "book_id string, name string")
    assert [(r["name"], bytes(r["content"])) for r in A.read_entries(wanted).collect()] == [("cover.jpg", b"cover")]


def test_sink_streams_and_replaces(spark, tmp_path):
    out = tmp_path / "out"
    rows = [("a/b.txt", i, f"line {i}\n") for i in range(200)] + [("c d%2.txt", 0, "no end"), ("e.txt", 0, ""), ("f.txt", 0, None)]
    df = spark.createDataFrame(rows, "target string, i int, piece string").repartition(5)
    A.write_pieces(df, str(out), ["i"])
    A.write_pieces(df.filter("target = 'e.txt'").withColumn("piece", F.lit("new")), str(out), ["i"])
    got = {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()}
    mark = b"\xef\xbb\xbf"
    assert got == {"a/b.txt": mark + b"".join(b"line %d\n" % i for i in range(200)), "c d%2.txt": mark + b"no end\n", "e.txt": mark + b"new\n", "f.txt": mark + b"\n"}


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    A.write_pieces(spark.createDataFrame([("a.txt", 0, "old")], "target string, i int, piece string"), str(out), ["i"])

    @F.udf("string")
    def fails(i):
        if i == 3:
            raise ValueError("lost")
        return "new"

    df = spark.range(4).select(F.concat(F.lit("a"), F.when(F.col("id") > 0, F.col("id")).otherwise(F.lit("")), F.lit(".txt")).alias("target"), F.lit(0).alias("i"), fails("id").alias("piece"))
    with pytest.raises(Exception, match="lost"):
        A.write_pieces(df, str(out), ["i"])
    assert {str(p.relative_to(out)): p.read_text(encoding="utf-8-sig") for p in out.rglob("*") if p.is_file()} == {"a.txt": "old\n"}


def test_attempts_of_one_task_do_not_meet(tmp_path):
    writer = stores.TextWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"target": ["x.txt"], "piece": ["one"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.files[0][0] != kept.files[0][0]
    writer.commit([kept, None])
    assert [p.name for p in tmp_path.iterdir()] == ["x.txt"]
    writer.abort([])


def test_reader_carries_state_over_splits(spark, tmp_path):
    """A file cut into many splits reads as the whole one: header, sections, contents, cover."""
    cover = "--==[ Cover ]==--\n" + "QUJD\n" * 50 + "--==[ /Cover ]==--"
    body = "".join(f"\n--==# Part {i} #==--\n\n" + "".join(f"    line {i} {j}\n" for j in range(40)) + f"sub {i}\n" for i in range(8))
    text = f"RTB-1\nTitle: T: x\nAuthor: A\nAuthor: B\nCover: True\n\n    opening\n\n--==# Contents #==--\nPart 0\n{body}\n{cover}\n"
    A.write_text_books(spark.createDataFrame([("b", "t.txt", text), ("c", "s.txt", "RTB-1\nTitle: S\n\n    only\n")], "book_id string, target string, text string"), str(tmp_path / "o"))
    columns = ["path", "header", "line_no", "section", "depth", "label", "kind", "text"]
    whole = A.read_text_books(spark, str(tmp_path / "o")).select(columns).orderBy("path", "line_no").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path / "o")).rdd.getNumPartitions() > 5
        split = A.read_text_books(spark, str(tmp_path / "o")).select(columns).orderBy("path", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert split == whole
    rows = [r for r in whole if r["path"].endswith("t.txt") and r["kind"] != "blank"]
    assert [(h["k"], h["v"]) for h in rows[0]["header"]] == [("Title", "T: x"), ("Author", "A"), ("Author", "B"), ("Cover", "True")]
    assert [(r["label"], r["section"]) for r in rows if r["kind"] == "sub-heading"] == [(f"Part {i}", i + 2) for i in range(8)]
    assert sum(r["kind"] == "paragraph" for r in rows) == 321 and not any("QUJD" in r["text"] or r["text"] == "Part 0" for r in rows)


def test_exact_quantiles(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jobs, "BINS", 7)
    monkeypatch.setattr(jobs, "FEW", 5)
    rng = random.Random(2)
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 40, [rng.gauss(0, 1e9) for _ in range(501)], [1e-300, 1.0, 1e300] * 9, [float(i % 3) for i in range(100)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = jobs.exact_quantiles(df, [0.0, 0.25, 0.5, 0.9, 1.0])
        want = [np.quantile(values, p) if values else None for p in (0.0, 0.25, 0.5, 0.9, 1.0)]
        assert got == pytest.approx(want, rel=1e-12) if values else got == want
