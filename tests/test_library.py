"""A library of archives to text books, end to end."""

import base64
import io
import os
import zipfile

import pytest

from booktext.plans.library import library
from booktext.sources import outcomes

CONTAINER = '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
HEAD = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>'
NAV = '<nav epub:type="toc"><ol><li><a href="pic.xhtml">Plate</a></li><li><a href="a.xhtml">One</a><ol><li><a href="a.xhtml#mid">Middle</a></li></ol></li><li><a href="b.xhtml">Two</a></li><li><a href="end.xhtml">Last plate</a></li></ol></nav>'
CSS = "p{margin:0;text-indent:0} .gap{margin-top:20px} .box{border-top:1px solid;border-bottom:1px solid} .head{border:1px solid} .late{font-size:80%;text-align:center}"
LINK = '<html><head><link rel="stylesheet" href="s.css"/></head><body>'
PAGES = {
    "title.xhtml": "<html><body><p>Fables</p><p>2001</p></body></html>",
    "open.xhtml": f"{LINK}<p>Before all.</p></body></html>",
    "list.xhtml": "<html><body><p>Contents</p><p>Plate</p><p>One</p><p>Two</p></body></html>",
    "pic.xhtml": '<html><body><img src="c.jpg"/></body></html>',
    "a.xhtml": f'{LINK}<h1>One</h1><p>First<a epub:type="noteref" href="b.xhtml#n1">1</a>, and <a href="b.xhtml#w">tale</a>.</p><p class="gap">After a gap.</p><h2 id="mid">Middle</h2>'
    '<p>In the middle.</p><p>Still there.</p><h3>A part</h3><p>Of it.</p><p><span class="head">Boxed</span></p><p>Under it.</p></body></html>',
    "b.xhtml": f'{LINK}<p>Two</p><div class="box"><p>In a box.</p></div><p>Then.</p><aside epub:type="footnote" id="n1"><p>1. The note.</p></aside><aside epub:type="footnote" id="w"><p>The tale of it.</p></aside></body></html>',
    "end.xhtml": '<html><body><img src="c.jpg"/></body></html>',
}
JPEG = bytes(range(200))
WANT = """\
RTB-1
Title: Fables
Author: A. One
Date: 2001
Language: en
Cover: True

    Before all.

--==# Contents #==--
Plate
One
  Middle
Two
Last plate

--==# Plate #==--

--==# One #==--

    First (Note[1]), and tale (Note[★1]).

    After a gap.

--==## Middle ##==--

    In the middle.
    Still there.

A part

    Of it.

====================
Boxed
====================

    Under it.

--==# Two #==--

    --------------------
    In a box.
    --------------------
    Then.
    Note[1]: The note.
    Note[★1]: The tale of it.

--==# Last plate #==--

--==[ Cover ]==--
{cover}
--==[ /Cover ]==--"""


def archive(title: str, pages: dict[str, str], nav: str = NAV) -> bytes:
    items = "".join(f'<item id="{n}" href="{n}" media-type="application/xhtml+xml"/>' for n in pages)
    refs = "".join(f'<itemref idref="{n}"/>' for n in ["nav", *pages])
    opf = (
        f'{HEAD}<dc:title>{title}</dc:title><dc:creator>A. One</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        f'<item id="c" href="c.jpg" media-type="image/jpeg" properties="cover-image"/>{items}</manifest><spine>{refs}</spine></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        for name, data in ({"p.opf": opf, "nav.xhtml": nav, "s.css": CSS, "c.jpg": JPEG} | pages).items():
            z.writestr(f"O/{name}", data)
    return out.getvalue()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    spark.sparkContext.setCheckpointDir(str(root / "checkpoints"))
    books = root / "books"
    (books / "sub").mkdir(parents=True)
    (books / "a.epub").write_bytes(archive("Other", {"x.xhtml": "<p>Other text.</p>"}))
    (books / "sub/plain.epub").write_bytes(archive("", {"x.xhtml": "<p>Only text.</p>"}, nav="<nav></nav>"))
    (books / "a.EPUB").write_bytes(archive("Fables", PAGES))  # the first by path of two books with one target
    (books / "bad.epub").write_bytes(b"not an archive")
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    (books / "empty.epub").write_bytes(empty.getvalue())
    (books / "zero.epub").write_bytes(b"")
    (books / "cut.epub").write_bytes(archive("Cut", PAGES)[:900])
    (books / "pictures.epub").write_bytes(archive("P", {f"p{i}.xhtml": '<body><img src="c.jpg"/></body>' for i in range(4)}))
    first = library(spark, f"file://{books}", str(root / "out")).collect()
    return root, first


def text_of(root, target: str) -> str:
    data = (root / "out" / target).read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and data.endswith(b"\n") and not data.endswith(b"\n\n")
    return data.decode("utf-8-sig").rstrip("\n")


def test_text_is_as_the_format_says(made):
    root, _ = made
    cover = base64.b64encode(JPEG).decode()
    lines = "\n".join(cover[i : i + 76] for i in range(0, len(cover), 76))
    assert text_of(root, "a.txt") == WANT.replace("{cover}", lines)
    assert text_of(root, "sub/plain.txt").split("\n\n") == ["RTB-1\nTitle: plain\nAuthor: A. One\nLanguage: en\nCover: True", "    Only text.", *text_of(root, "a.txt").split("\n\n")[-1:]]


def test_outcomes(made):
    root, first = made
    got = {r["book_id"].rpartition("/")[2]: (r["target"], r["kind"]) for r in first}
    assert got == {
        "a.EPUB": ("a.txt", "ok"), "a.epub": ("a.txt", "skip"), "plain.epub": ("sub/plain.txt", "ok"), "bad.epub": ("bad.txt", "fail"),
        "empty.epub": ("empty.txt", "fail"), "pictures.epub": ("pictures.txt", "image"), "zero.epub": ("zero.txt", "fail"), "cut.epub": ("cut.txt", "fail"),
    }
    assert all(r["detail"] for r in first if r["kind"] in ("ok", "fail"))


def test_written_books_are_kept(spark, made):
    root, _ = made
    again = {r["target"]: r["kind"] for r in library(spark, str(root / "books"), str(root / "out")).collect()}
    assert again == {"a.txt": "skip", "sub/plain.txt": "skip", "bad.txt": "fail", "empty.txt": "fail", "pictures.txt": "image", "zero.txt": "fail", "cut.txt": "fail"}
    assert sorted(str(p.relative_to(root / "out")) for p in (root / "out").rglob("*.txt")) == ["a.txt", "sub/plain.txt"]
    assert not list((root / "out").glob(".staged-*"))


def test_changed_archives_are_found(spark, made):
    """Another time alone is no change; another content is, and is written anew where that is asked for. The log alone says so."""
    root, _ = made
    run = lambda **k: {r["target"]: (r["kind"], r["detail"]) for r in library(spark, str(root / "books/sub"), str(root / "out2"), **k).collect()}
    assert run()["plain.txt"][0] == "ok"
    os.utime(root / "books/sub/plain.epub", (1, 1))
    assert run()["plain.txt"] == ("skip", "")
    (root / "books/sub/plain.epub").write_bytes(archive("", {"x.xhtml": "<p>New text.</p>"}, nav="<nav></nav>"))
    assert run()["plain.txt"] == ("skip", "changed")
    assert run(refresh=True)["plain.txt"][0] == "ok" and "New text." in (root / "out2/plain.txt").read_text()
    outcomes.compact_log(spark, str(root / "out2"))
    assert len(list((root / "out2/_outcomes").iterdir())) == 1 and outcomes.read_log(spark, str(root / "out2")).count() == 1
    (root / "out2/plain.txt").unlink()
    assert run()["plain.txt"] == ("skip", "")  # the log knows it still
