"""The registered query of the fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints as fp
from .common import materialize, table


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = lambda c: F.xxhash64(c)
    rows = fp.neighbours(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), mark("text").alias("mark"), "next_id", mark("next_text").alias("next_mark"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    # repeated rows may have different rows after them, and so different edited texts
    rows = rows.withColumn("edited_mark", mark("edited"))
    edited = fp.simhash(rows.select("doc_id", "mark", "edited_mark", "edited"), ["doc_id", "mark", "edited_mark"], "edited")
    edited = edited.select(F.col("doc_id").alias("d1"), F.col("mark").alias("m1"), F.col("edited_mark").alias("e1"), F.col("fingerprint").alias("edited_fp"))
    own = materialize(fp.simhash(docs.select("doc_id", mark("text").alias("mark"), "text"), ["doc_id", "mark"]), "simhash")
    mine = own.select(F.col("doc_id").alias("d2"), F.col("mark").alias("m2"), F.col("fingerprint").alias("own_fp"))
    nexts = own.select(F.col("doc_id").alias("d3"), F.col("mark").alias("m3"), F.col("fingerprint").alias("next_fp"))
    base = rows.select("doc_id", "n_chars", "mark", "edited_mark", "next_id", "next_mark", F.sha2("edited", 256).alias("edited_sha256"))
    # the search: every row whose id is divisible by 100 against all rows
    asked = own.filter("doc_id % 100 = 0")
    near = fp.search(asked, own)
    counts = own.groupBy("fingerprint").agg(F.count("*").alias("n"))
    hits = near.join(counts, "fingerprint").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    out = (
        base.join(mine, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("mark") == F.col("m2")))
        .join(edited, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("mark") == F.col("m1")) & (F.col("edited_mark") == F.col("e1")))
        .join(nexts, F.col("next_id").eqNullSafe(F.col("d3")) & (F.col("next_mark") == F.col("m3")))
        .join(hits, (F.col("own_fp") == F.col("query")) & (F.col("doc_id") % 100 == 0), "left")
    )
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("own_fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        fp.likeness(F.col("own_fp"), F.col("edited_fp")).alias("near_edited"), fp.likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )
