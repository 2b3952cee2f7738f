"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from booktext.functions import css as C
from booktext.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "shown,core,marker",
    [("1", "1", True), ("[1]", "1", True), ("（註1）", "1", True), ("①", "①", True), ("*1", "*1", True), ("†", "†", True), ("十", "十", False), ("word 2", "word 2", False), ("[[註3]]", "3", True), ("()", "()", False)],
)
def test_markers(spark, shown, core, marker):
    assert one(spark, X.marker_core(F.lit(shown))) == core
    assert one(spark, X.is_marker(F.lit(shown))) is marker


@pytest.mark.parametrize(
    "text,out",
    [("詞(註[1])。後", "詞 (註[1])。後"), ("a(Note[2])b", "a (Note[2]) b"), ("a  (Note[2])  b", "a (Note[2]) b"), ("a (註[1])(註[2]), x", "a (註[1]) (註[2]), x")],
)
def test_note_mark_spacing(spark, text, out):
    assert " ".join(one(spark, X.space_note_marks(F.lit(text))).split()) == " ".join(out.split())


@pytest.mark.parametrize(
    "url,out",
    [
        ("http://a/?utm_source=x&p=1", "http://a/?p=1"), ("http://a/?utm_source=x#f", "http://a/#f"), ("http://a/b", "http://a/b"), ("mailto:a@b?subject=x", "mailto:a@b"),
        ("http://a/?q=%20x&&hl=de", "http://a/?q=%20x"),
    ],
)
def test_clean_url(spark, url, out):
    assert one(spark, X.clean_url(F.lit(url))) == out


@pytest.mark.parametrize("base,href,out", [("OEBPS/", "../a/b.html", "a/b.html"), ("", "./x%20y+z", "x y+z"), ("a/", "../../b", "b"), ("a/", "b%zz", "a/b%zz")])
def test_resolve_path(spark, base, href, out):
    assert one(spark, X.resolve_path(F.lit(base), F.lit(href))) == out


@pytest.mark.parametrize("value,px", [("2em", 32.0), ("0", 0.0), ("5", 5.0), ("12pt", 16.0), ("1.2.3px", None), ("auto", None)])
def test_css_length(spark, value, px):
    assert one(spark, C.css_length(F.lit(value))) == px


@pytest.mark.parametrize("value,sides", [("1", "1111"), ("1 2", "1212"), ("1 2 3", "1232"), ("1 2 3 4", "1234")])
def test_css_side(spark, value, sides):
    assert "".join(one(spark, C.css_side(F.lit(value), s)) for s in C.SIDES) == sides


@pytest.mark.parametrize(
    "props,top",
    [({"border": "1px solid"}, True), ({"border": "0 solid"}, True), ({"border": "none"}, False), ({"border-style": "none dashed"}, False), ({"border-top-style": "solid"}, True), ({"border": "1px solid", "border-top-width": "0"}, False), ({"x": "y"}, False)],
)
def test_border(spark, props, top):
    m = F.create_map(*[F.lit(x) for kv in props.items() for x in kv])
    assert one(spark, C.border_visible(m, "top")) is top


def test_vocabulary_and_format(spark):
    assert one(spark, C.is_note_element(F.lit("footnote x"), F.lit(None), F.lit(None)))
    assert not one(spark, C.is_note_element(F.lit("footnotes"), F.lit(None), F.lit(None)))
    assert one(spark, C.is_note_area(F.lit(None), F.lit("doc-endnotes")))
    assert one(spark, C.font_key(F.lit(' "Times New", serif,'))) == "times new,serif"
    assert one(spark, X.body_line(F.lit("--==# x #==--"), F.lit(""))) == " --==# x #==--"
    assert one(spark, X.fence(F.lit(9), F.lit("L"))) == "--==###### L ######==--"
    assert one(spark, X.same_target(F.lit("Example.com/a/"), F.lit("https://example.com/a?utm_x=1")))
