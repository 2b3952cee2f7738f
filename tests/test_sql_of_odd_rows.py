"""Queries against their SQL on few rows that the small tables do not hold."""

from hashlib import sha256

import duckdb

from booktext.plans.queries import ORACLES, QUERIES


def both(spark, folder, name: str, table: str, rows: list[tuple], schema: str) -> list[tuple]:
    """The query's rows, which are the SQL's."""
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{table}.parquet"))
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    theirs = c.sql(ORACLES[name])
    ours = [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*theirs.columns).collect()]
    assert sorted(ours, key=str) == sorted(theirs.fetchall(), key=str)
    return ours


def test_star_numbers_of_words_that_are_markers(spark, tmp_path):
    """Every marker is out, not numbers and bracketed numbers alone; what only begins like one has a number."""
    texts = ["94.182 a", "+1 (87)", "[*]", "（註1）", "【註 ①】", "((((1", "(((1))) x", "[注[1]]", "†‡", "一二", "Note 7", "note", "word", "*1\nx", "  1  ", " 12　", "1)", "注注注注注1", "<<1>>", "[]", " \n\t", "１２．"]
    rows = [(26 + 52 * i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = both(spark, tmp_path, "star_numbers", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = {int(key[1:-2]): star for _, key, star in got if key.endswith("#n")}
    out = {t for i, t in enumerate(texts) if 26 + 52 * i not in at}
    assert out == {"94.182 a", "[*]", "（註1）", "【註 ①】", "[注[1]]", "†‡", "Note 7", "  1  ", " 12　", "注注注注注1", "<<1>>"}


PAGES = "page_id long, url string, html string"


def test_page_lines_of_cut_and_rare_references(spark, tmp_path):
    """A text cut inside a reference: names that need no semicolon count, others stay; a reference does not reach over a tag."""
    lines = {
        "<p>token = &quot</p>": ['token = "'], "<p>&quo</p><p>&am<b>p;</b></p>": ["&quo", "&amp;"], "<p>&copyx &middot</p>": ["©x ·"], "<p>&lt;b&gt &#39;&#x27 &ampquot;</p>": ["<b> '' &quot;"],
        "<p>&notit; &notin; &#128; &#0; &#xD800; &#1;.&#99999999999999999999;</p>": ["¬it; ∉ € � � .�"], "<p>\xa0a&nbsp;\x1c</p>&emsp;": ["a"],
        "a<hr>b<br/>c<ruby>d<rt>e</rt></ruby> 1 < 2 > 1": ["a", "-" * 20, "b", "cd 1 < 2 > 1"], "": [], None: [],
    }
    got = both(spark, tmp_path, "page_lines", "pages", [(i, "http://h/", x) for i, x in enumerate(lines)], PAGES)
    assert sorted(got) == [(i, n, t) for i, ts in enumerate(lines.values()) for n, t in enumerate(ts)]


def test_text_book_digests_of_cut_references_and_no_address(spark, tmp_path):
    rows = [(3, "http://h/b", "<p>x = &quot</p><p>&quo"), (1, "https://h/a", '<html lang="ja"><p>&copy h &middot'), (2, None, "<p>a</p>&nbsp;<p>b"), (4, None, None), (5, "no address", "<p>c &amp d"), (6, "http://empty/", "")]
    got = both(spark, tmp_path, "text_book_digests", "pages", rows, PAGES)
    digest = lambda text: sha256(text.encode()).hexdigest()
    assert {(b, n, d) for b, n, d in got} == {
        ("h", 3, digest('　　© h ·\n    x = "\n    &quo\n')), (None, 2, digest("    a\n    b\n")), ("", 1, digest("    c & d\n")),
    }
