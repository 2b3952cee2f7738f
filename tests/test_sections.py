"""Sections and tables of contents: results at the edges, and plans that do not grow faster than the book."""

import pytest
from pyspark.sql import functions as F

from booktext.operators import sections as S
from booktext.plans import fixtures as T
from booktext.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_carry_toc_forward_lands_on_the_next_kept_document(spark):
    docs = spark.createDataFrame(
        [("b", 0, "a", False, False), ("b", 1, "c", True, True), ("b", 2, "d", True, False), ("b", 3, "e", True, False), ("b", 4, "f", False, False), (None, 0, "n", True, False), ("c", 0, "a", False, True)],
        "book_id string, spine_pos int, doc string, has_text boolean, skipped boolean",
    )
    entries = docs.select("book_id", "doc", (F.col("spine_pos") * 2).alias("toc_pos"), F.lit(1).alias("depth"), F.lit("x").alias("fragment"), F.col("doc").alias("label"))
    got = S.carry_toc_forward(docs, entries)
    assert {(r["book_id"], r["doc"]): r["land_pos"] for r in got.collect()} == {("b", "a"): 2, ("b", "c"): 2, ("b", "d"): 2, ("b", "e"): 3, ("b", "f"): None, ("c", "a"): None}


def test_carry_toc_forward_reads_a_book_once(spark):
    """A frame up to the book's end is read anew for each row, the square of the documents of a book; lines are not needed for a first line."""
    found = plan(QUERIES["carry_toc_forward"](spark, SF)).lower()
    assert "window" in found and "unboundedfollowing" not in found and "explode" not in found


@pytest.mark.parametrize("text", ["", " \t\r\n\f\x0b", "\n\n \t a\x0b  b \r\nc", "\xa0\nx", "one", " \r\r\n\n two", "　a 　", "\x1c\n\x0c", None])
def test_first_line_is_the_first_of_lines(spark, tmp_path, text):
    d = spark.createDataFrame([(5, text, "en", "s", 0), (10, "w", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    first = {r["doc"]: r["text"] for r in T.lines(spark, str(tmp_path)).filter("line_idx = 0").collect()}
    want = {("5", first.get("5", "Plate 5")), ("10", "w")}
    assert {(r["doc"], r["label"]) for r in T.toc(spark, str(tmp_path)).filter("fragment is null").collect()} == want
