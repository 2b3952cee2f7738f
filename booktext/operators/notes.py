"""Footnotes across a whole book: equi-joins on (book, key), never on book alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from booktext.functions import text as X


def mutual_note_pairs(links: DataFrame, note_keys: DataFrame) -> DataFrame:
    """book_id, key of undeclared notes: a link with text that is not its whole line, whose target's first owner comes later
    and points back at one of the link's ids. One owner a key, so a popular target does not multiply rows."""
    owned = links.select("book_id", "link_pos", F.col("target").alias("back"), F.explode("ids").alias("key"))
    owner = owned.groupBy("book_id", "key").agg(F.min(F.struct("link_pos", "back")).alias("home"))
    known = note_keys.select("book_id", F.col("key").alias("target")).distinct()
    refs = links.filter("not declared and not whole and coalesce(text, '') <> ''").join(known, ["book_id", "target"], "left_anti")
    found = refs.withColumnRenamed("target", "key").join(owner, ["book_id", "key"])
    return found.filter((F.col("home.link_pos") > F.col("link_pos")) & F.array_contains("ids", F.col("home.back"))).select("book_id", "key").distinct()


def all_note_keys(note_keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Declared note keys and mutual pairs, each key once."""
    return note_keys.select("book_id", "key").unionByName(pairs.select("book_id", "key")).distinct()


def note_labels(links: DataFrame, keys: DataFrame) -> DataFrame:
    """book_id, key, text (first shown by a link that is declared or hits a note), first_pos, and whether it is a marker."""
    k = keys.select("book_id", F.col("key").alias("target")).distinct().withColumn("hit", F.lit(True))
    rows = links.join(k, ["book_id", "target"], "left").filter("coalesce(text, '') <> '' and (declared or hit)")
    out = rows.groupBy("book_id", "target").agg(F.min_by("text", "link_pos").alias("text"), F.min("link_pos").alias("first_pos"))
    return out.select("book_id", F.col("target").alias("key"), "text", "first_pos", X.is_marker(F.col("text")).alias("marker"))


def star_numbers(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """book_id, key, star: a number for each note of word keys, by first appearance, shared by the keys of one note group
    (the last group of a key counts, by its place in groups(book_id, key, group_id[, group_pos]), else by its id)."""
    place = "group_pos" if "group_pos" in groups.columns else "group_id"
    g = groups.groupBy("book_id", "key").agg(F.max_by("group_id", place).alias("group_id"))
    rows = labels.filter("not marker").join(g, ["book_id", "key"], "left")
    unit = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("k"), F.col("key")))
    rows = rows.withColumn("unit", unit).withColumn("at", F.min("first_pos").over(W.partitionBy("book_id", "unit")))
    return rows.select("book_id", "key", F.dense_rank().over(W.partitionBy("book_id").orderBy("at")).alias("star"))


def attach_labels(doc_keys: DataFrame, labels: DataFrame) -> DataFrame:
    """book_id, doc, labels MAP<key, text>: what each document cites or owns. doc_keys(book_id, doc, key)."""
    rows = doc_keys.distinct().join(labels.select("book_id", "key", "text"), ["book_id", "key"])
    return rows.groupBy("book_id", "doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "text")))).alias("labels"))


def star_note_lines(lines: DataFrame, anchors: DataFrame, stars: DataFrame) -> DataFrame:
    """lines(book_id, doc, line_idx, text, kind) with sub: a line `label: text` before a heading that a star points at, or the
    prefix in place; rules are passed over; the first anchor of a line counts, by anchor_pos if anchors have it, else by name.
    stars(book_id, doc, name, label)."""
    place = "anchor_pos" if "anchor_pos" in anchors.columns else "name"
    at = anchors.join(stars, ["book_id", "doc", "name"]).groupBy("book_id", "doc", "line_idx").agg(F.min_by("label", place).alias("label"))
    rows = lines.join(at, ["book_id", "doc", "line_idx"], "left")
    label = F.when(F.col("text") != X.RULE, F.col("label"))
    said = F.concat(label, F.lit(": "), F.col("text"))
    item = lambda sub, t, k: F.struct(F.lit(sub).alias("sub"), t.alias("text"), k.cast("int").alias("kind"))
    parts = (
        F.when(label.isNotNull() & (F.col("kind") != 0), F.array(item(0, said, F.lit(0)), item(1, F.col("text"), F.col("kind"))))
        .when(label.isNotNull(), F.array(item(1, said, F.col("kind")))).otherwise(F.array(item(1, F.col("text"), F.col("kind"))))
    )
    keep = [c for c in lines.columns if c not in ("text", "kind")]
    return rows.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.*")
