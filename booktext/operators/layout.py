"""Spacing, rules and body style from stylesheets: windows over (book, doc), aggregates over small keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from booktext.functions import css as C
from booktext.functions import text as X

DOC = ["book_id", "doc"]
TABLE_TAGS = ["table", "thead", "tbody", "tr", "td", "th", "caption"]


def ordinary_gap(gaps: DataFrame) -> DataFrame:
    """book_id, doc, ordinary: the most common gap, the smallest of equals."""
    n = gaps.filter("gap is not null").groupBy(*DOC, "gap").agg(F.count("*").alias("n"))
    return n.groupBy(*DOC).agg(F.max_by("gap", F.struct(F.col("n"), (-F.col("gap")).alias("g"))).alias("ordinary"))


def style_gaps(lines: DataFrame, threshold: float = 8.0) -> DataFrame:
    """lines(book_id, doc, line_idx, font, top, bottom, owner, heading, styled, blanks) with gap, ordinary and new_blanks."""
    w = W.partitionBy(*DOC).orderBy("line_idx")
    before = lambda c: F.lag(c).over(w)
    ok = F.col("styled") & before("styled") & ~F.col("heading") & ~before("heading") & (F.col("owner") != before("owner"))
    rows = lines.withColumn("comparable", F.coalesce(ok, F.lit(False))).withColumn("font_changed", ~F.col("font").eqNullSafe(before("font")))
    rows = rows.withColumn("gap", F.when(F.col("comparable"), F.greatest(before("bottom"), F.col("top"))))
    rows = rows.join(ordinary_gap(rows), DOC, "left").withColumn("ordinary", F.coalesce("ordinary", F.lit(0.0)))
    extra = F.when(F.col("comparable") & (F.col("font_changed") | (F.col("gap") - F.col("ordinary") >= threshold)), 1).otherwise(0)
    return rows.withColumn("new_blanks", F.greatest("blanks", extra)).drop("comparable", "font_changed")


def collapse_rules(lines: DataFrame) -> DataFrame:
    """lines(book_id, doc, line_idx, sub, text, blanks): two or more rules in a row become the first, with the largest
    blanks; blanks at and right after a rule are at most 1."""
    w = W.partitionBy(*DOC).orderBy("line_idx", "sub")
    rule = F.col("text") == X.RULE
    follows = F.coalesce(rule & (F.lag("text").over(w) == X.RULE), F.lit(False))
    rows = lines.withColumn("follows", follows)
    island = F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("island", island)
    rows = rows.withColumn("blanks", F.max("blanks").over(W.partitionBy(*DOC, "island"))).filter("not follows")
    near = rule | F.coalesce(F.lag("text").over(w) == X.RULE, F.lit(False))
    return rows.withColumn("blanks", F.when(near, F.least("blanks", F.lit(1))).otherwise(F.col("blanks"))).drop("follows", "island")


def border_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """A rule before the first and after the last line of every box with a visible top or bottom border; tables do not count.
    boxes(book_id, doc, first_idx, last_idx, tag, props MAP). Order by (line_idx, sub): 0 rule, 1 line, 2 rule."""
    b = boxes.filter(~F.col("tag").isin(TABLE_TAGS))
    top = b.filter(C.border_visible(F.col("props"), "top")).select(*DOC, F.col("first_idx").alias("line_idx")).distinct().withColumn("above", F.lit(True))
    low = b.filter(C.border_visible(F.col("props"), "bottom")).select(*DOC, F.col("last_idx").alias("line_idx")).distinct().withColumn("below", F.lit(True))
    rows = lines.join(top, [*DOC, "line_idx"], "left").join(low, [*DOC, "line_idx"], "left")
    above, below = F.coalesce("above", F.lit(False)), F.coalesce("below", F.lit(False))
    item = lambda sub, t, n: F.struct(F.lit(sub).alias("sub"), t.alias("text"), n.cast("int").alias("blanks"))
    parts = F.concat(
        F.when(above, F.array(item(0, F.lit(X.RULE), F.col("blanks")))).otherwise(F.array().cast("array<struct<sub:int,text:string,blanks:int>>")),
        F.array(item(1, F.col("text"), F.when(above, F.lit(0)).otherwise(F.col("blanks")))),
        F.when(below, F.array(item(2, F.lit(X.RULE), F.lit(0)))).otherwise(F.array().cast("array<struct<sub:int,text:string,blanks:int>>")),
    )
    keep = [c for c in lines.columns if c not in ("text", "blanks")]
    return rows.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.*")


def body_style(lines: DataFrame) -> DataFrame:
    """book_id, size (the most common, the first seen of equals; none counts as 1.0), indented (more than half).
    lines(book_id, spine_pos, line_idx, size, indented)."""
    rows = lines.withColumn("size", F.coalesce("size", F.lit(1.0)))
    n = rows.groupBy("book_id", "size").agg(
        F.count("*").alias("n"), F.min(F.struct("spine_pos", "line_idx")).alias("at"), F.sum(F.col("indented").cast("int")).alias("n_in")
    )
    best = F.max_by("size", F.struct(F.col("n"), (-F.col("at.spine_pos")).alias("a"), (-F.col("at.line_idx")).alias("b")))
    return n.groupBy("book_id").agg(best.alias("size"), (F.sum("n_in") * 2 > F.sum("n")).alias("indented"))


def sub_headings(lines: DataFrame, body: DataFrame) -> DataFrame:
    """lines with kind: 0 none, 1 plain, 2 boxed, 3 caption. lines(book_id, line_idx, text, tag, framed, in_notes, after_image, centred,
    line_size, line_indented, underlined, runs ARRAY<STRUCT<text, framed, heavier>>)."""
    b = body.select("book_id", F.col("size").alias("body_size"), F.col("indented").alias("body_indented"))
    rows = lines.join(b, "book_id", "left").withColumn("body_size", F.coalesce("body_size", F.lit(1.0))).withColumn("body_indented", F.coalesce("body_indented", F.lit(False)))
    size = F.coalesce("line_size", "body_size")
    boxed = F.exists("runs", lambda r: (r["text"] == F.col("text")) & r["framed"])
    covered = (F.size("runs") > 0) & (X.norm(F.array_join(F.transform("runs", lambda r: r["text"]), "")) == X.norm(F.col("text")))
    kind = (
        F.when(F.col("in_notes"), 0)
        .when(F.col("tag").rlike("^h[1-6]$"), F.when(boxed | F.col("framed"), 2).otherwise(1))
        .when(boxed, 2)
        .when(F.col("after_image") & (size < F.col("body_size")) & F.col("centred"), 3)
        .when((F.col("line_idx") == 0) & covered & F.exists("runs", lambda r: r["heavier"]), 1)
        .when(F.col("body_indented") & covered & (size > F.col("body_size")) & ~F.col("line_indented"), F.when(F.col("underlined"), 2).otherwise(1))
        .otherwise(0)
    )
    return rows.withColumn("kind", kind).drop("body_size", "body_indented")
