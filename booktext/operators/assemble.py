"""From lines to one text a book: spacing of headings, the contents block, joining and assembly.

Windows over lines span one document's rows; what one document leaves to the next is carried by tables of one row a document.
Document keys are structs, so that null books and places are keys like others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from booktext.functions import text as X


def heading_spacing(lines: DataFrame) -> DataFrame:
    """lines(book_id, spine_pos, line_idx, text, blanks, kind, section_start, indent) with runs (blank lines before) and blocks
    (what is written). One blank before and after a heading; state starts anew at a section."""
    rows = lines.withColumn("_k", F.struct("book_id", "spine_pos"))
    ends = rows.groupBy("_k").agg(F.max_by("kind", "line_idx").alias("kind"))
    carried = F.lag("kind").over(W.partitionBy("_k.book_id").orderBy("_k"))
    rows = rows.join(ends.select("_k", carried.alias("_carried")), "_k")
    w = W.partitionBy("_k").orderBy("line_idx")
    before = F.when(F.row_number().over(w) == 1, F.col("_carried")).otherwise(F.lag("kind").over(w))
    after = F.coalesce((before != 0) & ~F.col("section_start"), F.lit(False))
    runs = F.when(after, 0).when(F.col("kind") != 0, 1).otherwise(F.col("blanks")).cast("int")
    line = X.body_line(F.col("text"), F.when(F.col("kind").isin(0, 3), F.col("indent")).otherwise(""))
    boxed = F.array(F.lit(X.BOX_RULE), X.body_line(F.col("text"), F.lit("")), F.lit(X.BOX_RULE))
    blocks = F.when(F.col("kind") == 2, boxed).otherwise(F.array(line))
    tail = F.when(F.col("kind") != 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("runs", runs).withColumn("blocks", F.concat(F.array_repeat(F.lit(""), F.col("runs")), blocks, tail))
    return rows.drop("_k", "_carried")


def place_contents(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """blocks(book_id, pos, block, is_fence, depth, label) with part: 1 opening text, 2 the contents block (at the first
    fence's pos), 3 from that fence on.
    The contents list the fences' labels, two blanks a level; a book without fences has none."""
    fences = blocks.filter("is_fence")
    rows = blocks.withColumn("_k", F.struct("book_id"))
    first = fences.groupBy(F.struct("book_id").alias("_k")).agg(F.min("pos").alias("_first"))
    part = F.when(F.col("pos") >= F.col("_first"), 3).otherwise(1)
    rows = rows.join(first, "_k", "left").select("book_id", part.alias("part"), "pos", "block")
    entry = F.concat(F.repeat(F.lit("  "), (F.col("depth") - 1).cast("int")), F.col("label"))
    listed = fences.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("es"))
    listed = listed.join(books.select("book_id", "language"), "book_id", "left")
    head = X.fence(F.lit(1), X.contents_word(F.col("language")))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("es", lambda x: x["e"]), "\n"))
    made = listed.select("book_id", F.lit(2).alias("part"), F.col("es")[0]["pos"].alias("pos"), text.alias("block"))
    return rows.unionByName(made)


def join_blocks(blocks: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """blocks(book_id, ..., block) that are not blank, each with its separator: two line feeds at structural blocks (and after
    one), else one and one more for each blank before. by: the columns that come first in the order and name a document."""
    rows = blocks.withColumn("_k", F.struct("book_id", *by))
    w = W.partitionBy("_k").orderBy(*order)
    blank = F.when(F.col("block") == "", 1).otherwise(0)
    rows = rows.withColumn("_b", F.sum(blank).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    full = rows.filter("block <> ''").withColumn("_s", F.col("block").startswith("--=="))
    said = F.col("block") != ""
    # what a document leaves to the next: its blanks, its blocks, and the last of them
    ends = rows.groupBy("_k").agg(
        F.max("_b").alias("blanks"), F.count(F.when(said, 1)).alias("n"), F.max(F.when(said, F.col("_b"))).alias("b"),
        F.max_by(F.col("block").startswith("--=="), F.when(said, F.struct(*order))).alias("s"),
    )
    past = W.partitionBy("_k.book_id").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_b0", F.coalesce(F.sum("blanks").over(past), F.lit(0)))
    last = F.last(F.when(F.col("n") > 0, F.struct((F.col("_b0") + F.col("b")).alias("b"), F.col("s").alias("s"))), ignorenulls=True).over(past)
    ends = ends.select("_k", "_b0", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_n0"), last.alias("_last"))
    full = full.join(ends, "_k")
    head = F.row_number().over(w) == 1
    place = F.row_number().over(w) + F.col("_n0")
    before = F.when(head, F.col("_last.b")).otherwise(F.lag("_b").over(w) + F.col("_b0"))
    structural = F.col("_s") | F.when(head, F.col("_last.s")).otherwise(F.lag("_s").over(w)) | (place == 2)
    plain = F.concat(F.lit("\n"), F.repeat(F.lit("\n"), (F.col("_b") + F.col("_b0") - before).cast("int")))
    sep = F.when(place == 1, "").when(structural, "\n\n").otherwise(plain)
    return full.withColumn("sep", sep).drop("_k", "_b", "_s", "_b0", "_n0", "_last")


def assemble_books(pieces: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """book_id, text: all pieces of a book in order, ended by one line feed. Documents are put together first, then books of
    them; the order is made inside the groups."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["piece"]), "")
    item = F.struct(*order, F.concat("sep", "block").alias("piece"))
    docs = pieces.groupBy(F.struct("book_id", *by).alias("k")).agg(joined(F.array_sort(F.collect_list(item))).alias("piece"))
    books = docs.groupBy("k.book_id").agg(joined(F.array_sort(F.collect_list(F.struct("k", "piece")))).alias("text"))
    return books.select("book_id", F.concat("text", F.lit("\n")).alias("text"))
