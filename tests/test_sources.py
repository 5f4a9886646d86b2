"""Sources and sinks on files made here."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold.operators import chunking
from quirefold.sources import epub, sinks

CONTAINER = '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
PACKAGE = '<package xmlns="o"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b%20c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'


def book(path, names=(), first="mimetype"):
    files = {"META-INF/container.xml": CONTAINER, "OEBPS/p.opf": PACKAGE, "OEBPS/a.xhtml": "<html><body><h1>A  b</h1><p>x<b>y</b>\nz</p><script>no</script></body></html>", "OEBPS/t/b c.xhtml": "<html><body><p>one</p><p> </p>two</body></html>"}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(first, "application/epub+zip")
        for n, t in files.items():
            z.writestr(n, t)
        for n in names:
            z.writestr(n, "x")


def test_epub_pages(spark, tmp_path):
    book(tmp_path / "good.epub")
    book(tmp_path / "late.epub", first="later")
    book(tmp_path / "unsafe.epub", names=["../x"])
    book(tmp_path / "locked.epub", names=["META-INF/encryption.xml"])
    (tmp_path / "torn.epub").write_bytes(b"PK")
    got = {(r["path"].rsplit("/", 1)[-1], r["page_no"], r["text"], r["reason"]) for r in epub.epub_pages(spark, str(tmp_path)).collect()}
    assert got == {
        ("good.epub", 1, "one\ntwo", None), ("good.epub", 2, "A b\nxy z", None), ("late.epub", None, None, "malformed_document"),
        ("unsafe.epub", None, None, "unsafe_path"), ("locked.epub", None, None, "encrypted_document"), ("torn.epub", None, None, "malformed_document"),
    }


def test_xhtml_entities_and_blocks():
    assert epub.xhtml_text("<html><body><figure>x<figcaption>cap</figcaption>y</figure>a&nbsp;b &eacute; &amp;</body></html>".encode()) == "x\ncap\ny\na b é &"


def test_damaged_entry_is_one_rejected_file(spark, tmp_path):
    book(tmp_path / "good.epub")
    data = bytearray((tmp_path / "good.epub").read_bytes())
    at = data.index(b"one</p>")
    data[at : at + 3] = b"two"
    (tmp_path / "bad.epub").write_bytes(bytes(data))
    got = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in epub.epub_pages(spark, str(tmp_path)).collect()}
    assert got == {"good.epub": None, "bad.epub": "malformed_document"}


def test_xhtml_rejects():
    for bad in (b"<p>", b'<!DOCTYPE x [<!ENTITY a "b">]><p>&a;</p>', b"<d>" * 200 + b"</d>" * 200):
        with pytest.raises(epub.Rejected):
            epub.xhtml_text(bad)


def test_shards_and_upsert(spark, tmp_path):
    pages = spark.createDataFrame([("b", 1, " ".join(f"w{i}" for i in range(500))), ("c", 1, "few words")], "book_id string, page_no int, text string")
    manifest = sinks.write_shards(chunking.chunk_windows(pages), str(tmp_path), per_shard=4).orderBy("book_id", "shard").collect()
    assert [(r["book_id"], r["shard"], r["first_order"], r["last_order"], r["n_chunks"]) for r in manifest][:2] == [("b", 0, 0, 3, 4), ("b", 1, 4, 7, 4)]
    assert {r["reason"] for r in sinks.read_shards(spark, str(tmp_path)).collect()} == {None}
    small = sinks.write_shards(chunking.chunk_windows(pages), str(tmp_path / "s"), per_shard=4, max_bytes=600).collect()
    assert all(r["n_chunks"] <= 4 and (r["n_bytes"] <= 600 or r["n_chunks"] == 1) for r in small) and len(small) > len(manifest)
    spark.read.parquet(str(tmp_path / "s" / "manifest")).where("book_id = 'c'").withColumn("n_bytes", F.lit(1).cast("long")).write.parquet(str(tmp_path / "t" / "manifest"))
    chunking.chunk_windows(pages).withColumn("shard", F.lit(0)).write.parquet(str(tmp_path / "t" / "shards"))
    assert {(r["book_id"], r["reason"]) for r in sinks.read_shards(spark, str(tmp_path / "t")).collect()} == {("b", "unknown"), ("c", "bytes")}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sinks.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, sinks.upsert(once, new, ["k"]).collect()))
