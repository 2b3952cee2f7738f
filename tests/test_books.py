"""Archives, the tokenizer and the text format, on small books made here."""

import io
import zipfile

from pyspark.sql import functions as F

from booktext.functions import text as X
from booktext.operators import extract, layout, notes
from booktext.sources import archives as A

OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" unique-identifier="i"><metadata>
<dc:title>Fables</dc:title><dc:creator>A. One</dc:creator><dc:creator>B. Two</dc:creator><dc:language>en</dc:language>
<meta property="belongs-to-collection" id="c1">Old Tales</meta><meta refines="#c1" property="collection-type">series</meta><meta refines="#c1" property="group-position">3</meta>
<meta name="cover" content="img"/></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="img" href="c.jpg" media-type="image/jpeg"/></manifest>
<spine><itemref idref="nav"/><itemref idref="a"/><itemref idref="a"/></spine></package>"""
NAV = '<nav type="x"><ol><li><a href="a.xhtml">One</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="a.xhtml#s">Part</a><ol><li><a href="../a.xhtml">In</a></li></ol></li></ol></nav>'
HTML = '<html><head><link rel="stylesheet" href="s.css"><style>p{margin:0}</style></head><body><p id="s">One<br>two</p><div><p></p></div><hr/><p class="x">See <a href="http://e.org/?utm_a=1">site</a> <ruby>漢<rt>kan</rt></ruby></p></body></html>'


def book(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        for name, data in ({"O/p.opf": OPF, "O/nav.xhtml": NAV, "O/a.xhtml": HTML, "O/s.css": "p{margin-top:1em}", "O/c.jpg": b"\xff\xd8x"} | files).items():
            z.writestr(name, data)
    return out.getvalue()


def test_archive_tables(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.epub").write_bytes(book())
    (tmp_path / "lib/B.EPUB").write_bytes(b"not a zip")
    books = A.scan_library(spark, str(tmp_path / "lib"))
    assert books.count() == 2
    entries = A.explode_archives(books).cache()
    packages = A.read_packages(entries).cache()
    good = packages.filter("error is null").collect()
    assert len(good) == 1 and good[0]["title"] == "Fables" and good[0]["authors"] == ["A. One", "B. Two"]
    assert packages.filter("error is not null").count() == 1
    assert A.book_series(A.part(packages, "metas")).collect()[0][1:] == ("Old Tales", "3")
    assert A.pick_cover(A.part(packages, "manifest"), A.part(packages, "metas"), entries).first()["cover_path"] == "O/c.jpg"
    nav = entries.filter("name = 'O/nav.xhtml'").select("book_id", F.col("name").alias("doc"), "text")
    toc = A.read_toc(nav).orderBy("toc_pos").collect()
    assert [(t["depth"], t["doc"], t["fragment"], t["label"]) for t in toc] == [(1, "O/a.xhtml", "s", "Part"), (2, "a.xhtml", None, "In")]
    html = entries.filter("name = 'O/a.xhtml'").select("book_id", F.col("name").alias("doc"), F.col("text").alias("html"))
    sheets = A.doc_stylesheets(html, entries).orderBy("sheet_pos").collect()
    assert [s["css"] for s in sheets] == ["p{margin-top:1em}", "p{margin:0}"]


def test_lines(spark):
    docs = spark.createDataFrame([("b", "d", HTML), ("b", "n", None)], "book_id string, doc string, html string")
    x = extract.extract_documents(docs).cache()
    lines = extract.table_of(x, "lines").orderBy("line_idx").collect()
    assert [(r["text"], r["blanks"]) for r in lines] == [("One", 0), ("two", 0), (X.RULE, 1), ("See site <http://e.org/> 漢", 0)]
    assert [(a["name"], a["line_idx"]) for a in extract.table_of(x, "anchors").collect()] == [("s", 0)]


def test_notes_written(spark):
    html = '<p>Word<a epub:type="noteref" href="#n1">1</a>, more</p><aside epub:type="footnote" id="n1"><p>1. The note</p></aside>'
    docs = spark.createDataFrame([("b", "d", html)], "book_id string, doc string, html string")
    x = extract.extract_documents(docs).cache()
    links, keys = extract.table_of(x, "links").withColumnRenamed("n", "link_pos"), extract.table_of(x, "note_keys")
    labels = notes.note_labels(links, keys)
    assert [(r["key"], r["text"], r["marker"]) for r in labels.collect()] == [("d#n1", "1", True)]
    held = notes.attach_labels(labels.select("book_id", F.lit("d").alias("doc"), "key"), labels)
    again = extract.extract_documents(docs.join(held, ["book_id", "doc"]).withColumn("word", F.lit("Note")))
    text = [r["text"] for r in extract.table_of(again, "lines").orderBy("line_idx").collect()]
    assert text == ["Word (Note[1]), more", "Note[1]: The note"]


def test_css_and_borders(spark):
    sheet = "p{margin:1px} .x{border:1px solid} p.x{margin:2px} .y .z{font-size:150%} @media all{.x{margin:9px}} /* p{margin:7px} */"
    rules = extract.css_rules(spark.createDataFrame([("b", "d", sheet)], "book_id string, doc string, css string")).cache()
    e = spark.createDataFrame([("b", "d", "p", ["x"]), ("b", "d", "p", [])], "book_id string, doc string, tag string, classes array<string>")
    got = {tuple(r["classes"]): r["props"] for r in extract.css_declared(e, rules).collect()}
    assert got[("x",)]["margin"] == "2px" and got[()]["margin"] == "1px" and got[("x",)]["border"] == "1px solid"
    run = extract.run_style(spark.createDataFrame([("b", "d", ["z"])], "book_id string, doc string, classes array<string>"), rules).first()
    assert run["size"] == 1.5 and run["heavier"] and not run["indented"]
    lines = spark.createDataFrame([("b", "d", 0, "t", 2)], "book_id string, doc string, line_idx int, text string, blanks int")
    boxes = spark.createDataFrame([("b", "d", 0, 0, "div", {"border": "1px solid"}), ("b", "d", 0, 0, "td", {"border": "1px solid"})], "book_id string, doc string, first_idx int, last_idx int, tag string, props map<string,string>")
    assert [(r["text"], r["blanks"]) for r in layout.border_lines(lines, boxes).orderBy("sub").collect()] == [(X.RULE, 2), ("t", 0), (X.RULE, 0)]


def test_headings_and_body(spark):
    s = "book_id string, spine_pos int, line_idx int, size double, indented boolean"
    body = layout.body_style(spark.createDataFrame([("b", 0, 0, 1.5, False), ("b", 0, 1, None, True), ("b", 0, 2, 1.0, True)], s))
    assert body.first()[1:] == (1.0, True)
    run = "array<struct<text:string,framed:boolean,heavier:boolean>>"
    schema = f"book_id string, line_idx int, text string, tag string, framed boolean, in_notes boolean, after_image boolean, centred boolean, line_size double, line_indented boolean, underlined boolean, runs {run}"
    rows = [
        ("b", 0, "H", "h2", False, False, False, False, None, False, False, []), ("b", 1, "N", "h2", False, True, False, False, None, False, False, []),
        ("b", 2, "F", "p", False, False, False, False, None, False, False, [("F", True, False)]), ("b", 3, "C", "p", False, False, True, True, 0.8, False, False, []),
        ("b", 4, "U", "p", False, False, False, False, 1.4, False, True, [("U", False, True)]), ("b", 5, "x", "p", False, False, False, False, 1.4, True, False, [("x", False, True)]),
    ]
    got = layout.sub_headings(spark.createDataFrame(rows, schema), body).orderBy("line_idx").collect()
    assert [r["kind"] for r in got] == [1, 0, 2, 3, 2, 0]


def test_text_books_round_trip(spark, tmp_path):
    text = "RTB-1\nTitle: T\nCover: True\n\n    opening\n\n--==# Contents #==--\nOne\n\n--==# One #==--\n\n    para\nsub\n\n--==[ Cover ]==--\nQUJD\n--==[ /Cover ]==--\n"
    books = spark.createDataFrame([("b", "t.txt", text)], "book_id string, target string, text string")
    assert A.write_text_books(books, str(tmp_path / "out")).first()["n_chars"] == len(text)
    rows = A.read_text_books(spark, str(tmp_path / "out")).orderBy("line_no").collect()
    assert [(r["kind"], r["label"]) for r in rows if r["kind"] != "blank"] == [("paragraph", None), ("fence", "One"), ("paragraph", "One"), ("sub-heading", "One")]
    assert {h["k"]: h["v"] for h in rows[0]["header"]}["Title"] == "T"


def test_blanks_and_lone_links(spark):
    """A block closed in its own tag leaves its parent's blank; a lone link goes only if the line before shows it in its brackets."""
    html = {
        "a": "<p>x</p><div><p/></div><p>y</p>",
        "b": "<p>x</p><div><p></p></div><p>y</p>",
        "c": '<p><a href="http://e.org/long">see</a></p><p><a href="http://e.org">http://e.org</a></p>',
        "d": "<p>at http://e.org</p><p><a href='http://e.org'></a></p>",
        "e": '<p>see <a href="http://e.org">it</a></p><p><a href="http://e.org"></a></p>',
    }
    docs = spark.createDataFrame([("b", k, v) for k, v in html.items()], "book_id string, doc string, html string")
    rows = extract.table_of(extract.extract_documents(docs), "lines").orderBy("doc", "line_idx").collect()
    got = {k: [(r["text"], r["blanks"]) for r in rows if r["doc"] == k] for k in html}
    assert got["a"] == [("x", 0), ("y", 1)] and got["b"] == [("x", 0), ("y", 1)]
    assert [t for t, _ in got["c"]] == ["see <http://e.org/long>", "<http://e.org>"]
    assert [t for t, _ in got["d"]] == ["at http://e.org", "<http://e.org>"]
    assert [t for t, _ in got["e"]] == ["see it <http://e.org>"]


def written(spark, html: str, labels: dict | None = None, known: list | None = None, stars: dict | None = None) -> list[tuple]:
    docs = spark.createDataFrame([("b", "d", html, labels or {}, known, stars or {}, "Note")], "book_id string, doc string, html string, labels map<string,string>, known array<string>, stars map<string,int>, word string")
    docs = docs if known is not None else docs.drop("known")
    rows = extract.table_of(extract.extract_documents(docs, scan=False), "lines").orderBy("line_idx").collect()
    return [(r["text"], r["in_notes"]) for r in rows]


def test_note_scopes_without_markup(spark):
    """An id with a label opens a note that ends with the block it is on or in; the way back goes; the number printed goes once."""
    one = {"d#n1": "1"}
    assert written(spark, '<p id="n1">The note. <a href="c#r1">↺</a></p>', one) == [("Note[1]: The note.", True)]
    assert written(spark, '<div id="n1"><p></p></div><p>Not the note</p>', one) == [("Not the note", False)]
    assert written(spark, '<p id="n1">1</p><p>After</p>', one) == [("Note[1]", True), ("After", False)]
    assert written(spark, '<p><a name="n1"></a>Named only</p>', one) == [("Named only", False)]
    assert written(spark, '<p><a id="n1" href="c#r1">1</a>：The note</p><p>After</p>', one) == [("Note[1]: The note", True), ("After", False)]
    assert written(spark, '<p><a href="c#r1" id="n1">1 all of it</a></p>', one) == [("Note[1]: all of it", True)]
    two = one | {"d#n2": "2"}
    listed = '<section epub:type="footnotes"><h2>Notes</h2><ol><li id="n1">1. First</li><li><p id="n2">2. Second</p><p>more</p></li></ol></section><p>x</p>'
    assert written(spark, listed, two) == [("Notes", True), ("Note[1]: First", True), ("Note[2]: Second", True), ("more", True), ("x", False)]
    assert written(spark, '<div id="n1"><p>1 One</p><p id="n2">2 inside it</p></div>', two) == [("Note[1]: One", True), ("2 inside it", True)]


def test_note_references(spark):
    one = {"d#n1": "[註1]"}
    assert written(spark, '<p>茶<a href="#n1">[註1]</a>。</p>', one)[0][0] == "茶 (Note[1])。"
    assert written(spark, '<p>Tea<a href="#n1"></a> and<a href="#n1">1</a>more</p>', one)[0][0] == "Tea (Note[1]) and (Note[1]) more"
    # a link that no markup declares is a reference only where its target is a note
    assert written(spark, '<p>see <a href="#n1">1</a></p>', one, known=[])[0][0] == "see 1"
    assert written(spark, '<p>see <a epub:type="noteref" href="#n1">1</a></p>', one, known=[])[0][0] == "see (Note[1])"
    assert written(spark, '<p>the <a href="#w">word</a>, so</p>', {}, stars={"d#w": 3})[0][0] == "the word (Note[★3]), so"
    # what the book prints itself keeps its blanks
    assert written(spark, "<p>a(註[1])b</p>")[0][0] == "a(註[1])b"


def test_addresses_are_written_by_the_column_rules(spark):
    row = lambda html: written(spark, html)[0][0]
    assert row('<p><a href="http://e.org/?q=1& &z=2&utm_a=3#f">it</a></p>') == "it <http://e.org/?q=1& &z=2#f>"
    assert row('<p>mail <a href="mailto:a@b.c?subject=x">A@b.c</a></p>') == "mail <mailto:a@b.c>"
    assert row('<p><a href="https://e.org/%41/">http://E.org/a</a>!</p>') == "<https://e.org/%41/>!"
    assert row('<head><a href="http://no.org">x</a></head><p><a href="http://e.org/a">one</a> <a href="#x">in</a> <a href="http://e.org/b"></a></p>') == "one <http://e.org/a> in <http://e.org/b>"
    assert row('<p>x <a href="ftp:f">\n</a></p>') == "x <ftp:f>"


def test_runs_end_inside_their_parents(spark):
    docs = spark.createDataFrame([("b", "d", "<p><span class=a>one <i class=b>two</span> three</i> <b class=c>four</b></p>")], "book_id string, doc string, html string")
    line = extract.table_of(extract.extract_documents(docs), "lines").first()
    assert [(r["text"], r["classes"]) for r in line["runs"]] == [("one two", ["a"]), ("four", ["c"])]


def test_run_style_rules(spark):
    """The last class that says a size settles it, readable or not; indents of any sign count; words stand anywhere in a value."""
    sheet = ".a{font-size:2em} .b{font-size:large} .c{text-indent:-1em} .z{text-indent:0} .d{text-align:-webkit-center} .e{text-align:center!important} .f{text-decoration:dotted underline red} .g{font-weight:700} .h{font-weight:BOLD} .i{font-size:120%} .j{font-size:16px}"
    rules = extract.css_rules(spark.createDataFrame([("b", "d", sheet)], "book_id string, doc string, css string"))
    asked = [["a"], ["a", "b"], ["b", "a"], ["c"], ["z"], ["d"], ["e"], ["f"], ["g"], ["h"], ["i"], ["j"], []]
    e = spark.createDataFrame([("b", "d", c) for c in asked], "book_id string, doc string, classes array<string>")
    got = {tuple(r["classes"]): (r["size"], r["indented"], r["heavier"], r["centred"], r["underlined"]) for r in extract.run_style(e, rules).collect()}
    f = False
    assert got == {
        ("a",): (2.0, f, True, f, f), ("a", "b"): (None, f, True, f, f), ("b", "a"): (2.0, f, True, f, f), ("c",): (None, True, f, f, f), ("z",): (None, f, f, f, f),
        ("d",): (None, f, f, True, f), ("e",): (None, f, f, True, f), ("f",): (None, f, f, f, True), ("g",): (None, f, True, f, f), ("h",): (None, f, True, f, f),
        ("i",): (1.2, f, True, f, f), ("j",): (1.0, f, f, f, f), (): (None, f, f, f, f),
    }


def test_marker_core_peels_to_the_end(spark):
    texts = {"1": "1", "[1]": "1", "（註1）": "1", "Note [ 2 ]": "2", "note": "note", "((*1))": "*1", "[]": "[]", "注 [a b]": "a b", " 〔註 3〕 ": "3", "(1) and (2)": "1) and (2", "[" * 30 + "x" + "]" * 30: "x", "註" * 12 + "9": "9", "": "", "([1)]": "([1)]"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.marker_core(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == texts


def test_first_anchor_and_last_group_by_place(spark):
    lines = spark.createDataFrame([("b", "d", 0, "text", 0)], "book_id string, doc string, line_idx int, text string, kind int")
    anchors = spark.createDataFrame([("b", "d", "z", 0, 0), ("b", "d", "a", 0, 1)], "book_id string, doc string, name string, line_idx int, anchor_pos int")
    stars = spark.createDataFrame([("b", "d", "z", "first"), ("b", "d", "a", "second")], "book_id string, doc string, name string, label string")
    assert [r["text"] for r in notes.star_note_lines(lines, anchors, stars).collect()] == ["first: text"]
    labels = spark.createDataFrame([("b", "k1", "w", 1, False), ("b", "k2", "v", 2, False)], "book_id string, key string, text string, first_pos int, marker boolean")
    groups = spark.createDataFrame([("b", "k1", 9, 0), ("b", "k1", 3, 1), ("b", "k2", 3, 2)], "book_id string, key string, group_id int, group_pos int")
    assert {r["key"]: r["star"] for r in notes.star_numbers(labels, groups).collect()} == {"k1": 1, "k2": 1}


def test_ncx_with_entities_is_refused(spark):
    ncx = '<ncx>{}<navMap><navPoint><navLabel><text>One\x01</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>'
    docs = spark.createDataFrame([("b", "t.ncx", ncx.format("")), ("c", "t.ncx", '<!DOCTYPE x [<!ENTITY e "v">]>' + ncx.format(""))], "book_id string, doc string, text string")
    assert [(r["book_id"], r["doc"], r["label"]) for r in A.read_ncx(docs).collect()] == [("b", "a.xhtml", "One")]
