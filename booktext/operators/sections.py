"""Reading order, table of contents, skipped pages and sections: joins and windows keyed by book first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from booktext.functions import text as X

DOC = ["book_id", "doc"]


def reading_docs(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine items that exist, are HTML (or do not say) and are not the nav document; a document's first place only."""
    m = manifest.select("book_id", "item_id", F.col("path").alias("doc"), "media", "is_nav")
    rows = spine.join(m, ["book_id", "item_id"]).filter((F.coalesce("media", F.lit("")) == "") | F.col("media").contains("html"))
    first = F.row_number().over(W.partitionBy(*DOC).orderBy("spine_pos"))
    return rows.filter(~F.coalesce("is_nav", F.lit(False))).withColumn("n", first).filter("n = 1").select("book_id", "spine_pos", "item_id", "doc")


def toc_for_docs(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """TOC entries under the documents they point into; entries to other documents vanish."""
    return docs.select("book_id", "spine_pos", "doc").join(toc.select("book_id", "toc_pos", "depth", "doc", "fragment", "label"), DOC, "left")


def contents_pages(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """Documents without an entry whose lines (a leading contents label aside) are mostly TOC labels: at least 3 lines,
    3 hits and 70 %."""
    labels = toc.select("book_id", X.norm(F.col("label")).alias("key")).distinct()
    rows = lines.join(toc.select(*DOC).distinct(), DOC, "left_anti")
    rows = rows.filter(~((F.col("line_idx") == 0) & X.is_contents_label(F.col("text"))))
    keyed = rows.select(*DOC, X.norm(F.col("text")).alias("key")).join(labels.withColumn("hit", F.lit(1)), ["book_id", "key"], "left")
    n = keyed.groupBy(*DOC).agg(F.count("*").alias("n_lines"), F.count("hit").alias("n_hits"))
    return n.filter("n_lines >= 3 and n_hits >= 3 and n_hits * 100 >= n_lines * 70")


def title_pages(lines: DataFrame, toc: DataFrame, books: DataFrame) -> DataFrame:
    """Documents without an entry of 1 to 6 lines, the first a known name, all known names or dated; with the guessed
    date: the first of the first 8 lines of at most 24 characters with a year."""
    names = F.array_union(F.array(F.coalesce("title", F.lit(""))), F.coalesce("authors", F.array().cast("array<string>")))
    names = F.when(F.coalesce("publisher", F.lit("")) != "", F.array_union(names, F.array("publisher"))).otherwise(names)
    known = books.select("book_id", F.transform(names, X.norm).alias("known"))
    rows = lines.join(toc.select(*DOC).distinct(), DOC, "left_anti").join(known, "book_id")
    ok = F.array_contains("known", X.norm(F.col("text")))
    dated = (F.length("text") <= 24) & X.date_hint(F.col("text")) & (F.col("line_idx") < 8)
    out = rows.groupBy(*DOC).agg(
        F.count("*").alias("n_lines"), F.max(F.when(F.col("line_idx") == 0, ok)).alias("first_known"),
        F.bool_and(ok | X.date_hint(F.col("text"))).alias("all_known"), F.min_by(F.when(dated, F.col("text")), F.when(dated, F.col("line_idx"))).alias("guessed_date"),
    )
    return out.filter("n_lines <= 6 and first_known and all_known").select(*DOC, "n_lines", "guessed_date")


def title_page_cut(docs: DataFrame) -> DataFrame:
    """docs(book_id, spine_pos, doc, is_title, guessed_date) with dropped: title pages up to and including the first dated one."""
    w = W.partitionBy("book_id").orderBy("spine_pos").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("is_title") & F.col("guessed_date").isNotNull(), 1).otherwise(0)).over(w), F.lit(0))
    return docs.withColumn("dropped", F.col("is_title") & (before == 0))


def carry_toc_forward(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with land_pos: the place of the document that shows them, itself or the next kept one; null at the book's
    end. docs(book_id, spine_pos, doc, has_text, skipped). Read from the book's end, so that the frame grows: one that shrinks is read
    anew for each row."""
    w = W.partitionBy("book_id").orderBy(F.desc("spine_pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = F.when(F.col("has_text") & ~F.col("skipped"), F.col("spine_pos"))
    landing = docs.select(*DOC, F.last(kept, ignorenulls=True).over(w).alias("land_pos"), "spine_pos")
    return entries.select(*DOC, "toc_pos", "depth", "fragment", "label").join(landing, DOC)


def section_lines(lines: DataFrame, anchors: DataFrame, entries: DataFrame) -> DataFrame:
    """Each line with the entry it belongs to: the last one that starts at or before it. Lines before the first start are
    dropped. A window over lines and starts together: no range join."""
    a = anchors.select(*DOC, F.col("name").alias("fragment"), F.col("line_idx").alias("start"))
    starts = entries.join(a, [*DOC, "fragment"], "left").select(
        *DOC, F.coalesce("start", F.lit(0)).alias("line_idx"), F.lit(0).alias("kind"), F.col("toc_pos").alias("tie"),
        F.struct("toc_pos", "depth", "label").alias("entry"), F.lit(None).cast("string").alias("text"),
    )
    body = lines.select(*DOC, "line_idx", F.lit(1).alias("kind"), F.lit(0).cast(starts.schema["tie"].dataType).alias("tie"), F.lit(None).cast(starts.schema["entry"].dataType).alias("entry"), "text")
    w = W.partitionBy(*DOC).orderBy("line_idx", "kind", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = starts.unionByName(body).withColumn("entry", F.last("entry", ignorenulls=True).over(w))
    return both.filter("kind = 1 and entry is not null").select(*DOC, "line_idx", "text", "entry.toc_pos", "entry.depth", "entry.label")


def strip_repeated_title(section: DataFrame) -> DataFrame:
    """section(book_id, doc, toc_pos, label, line_idx, text, kind) without a first line equal to the label, or its first two
    joined, and then without leading headings (kinds 1 and 2) that the label contains."""
    key = [*DOC, "toc_pos"]
    w = W.partitionBy(*key).orderBy("line_idx")
    t, label = X.norm(F.col("text")), X.norm(F.col("label"))
    rows = section.withColumn("n", F.row_number().over(w)).withColumn("pair", X.norm(F.concat("text", F.coalesce(F.lead("text").over(w), F.lit("")))))
    cut = F.when((F.col("n") == 1) & (t == label), 1).when((F.col("n") == 1) & F.lead("text").over(w).isNotNull() & (F.col("pair") == label), 2).otherwise(0)
    rows = rows.withColumn("cut", cut).withColumn("cut", F.max("cut").over(W.partitionBy(*key))).filter("n > cut")
    lead = F.col("kind").isin(1, 2) & (t != "") & F.contains(label, t)
    rows = rows.withColumn("streak", F.min(F.when(lead, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.filter("streak = 0").drop("n", "pair", "cut", "streak")


def known_names(books: DataFrame) -> DataFrame:
    """book_id, name: title, authors and publisher, normalised and distinct."""
    rows = books.select("book_id", F.explode(F.array_compact(F.concat(F.array("title", "publisher"), F.coalesce("authors", F.array().cast("array<string>"))))).alias("name"))
    return rows.select("book_id", X.norm(F.col("name")).alias("name")).filter("name <> ''").distinct()


def first_lines(lines: DataFrame, n: int = 8) -> DataFrame:
    return lines.filter(F.col("line_idx") < n)


def book_order(path: Column) -> Column:
    """Sort key of a library: path parts, not strings."""
    return F.split(path, "/")


def library_order(books: DataFrame) -> DataFrame:
    """book_id and place of all books by path parts. Books are dealt into ranges of the order, numbered inside them, and each
    range adds the sizes of those before it; ranges are checkpointed, since their bounds are sampled."""
    spark = books.sparkSession
    ranges = books.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), book_order(F.col("book_id")))
    ranges = ranges.withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(book_order(F.col("book_id"))))
    return ranges.withColumn("_place", place).join(F.broadcast(sizes), "_part").select("book_id", (F.col("_place") + F.col("_before")).alias("place"))
