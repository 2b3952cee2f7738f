"""Targets, pending work, outcomes, picture books and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from booktext.functions import text as X

ENTRY_CAP = 16 * 1024


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def plan_targets(books: DataFrame, root: str, outdir: str | None, mirror: bool = True, force: bool = False) -> DataFrame:
    """book_id, target: beside the book, flat in outdir, or at the same place below it. In the flat layout the first book of a
    name in path order gets the target, with force the last."""
    p = F.col("book_id")
    if outdir is None:
        return books.select("book_id", F.concat(F.regexp_replace(p, r"[^/]*$", ""), stem(p), F.lit(".txt")).alias("target"))
    if mirror:
        inside = F.regexp_replace(F.substring(p, len(root.rstrip("/")) + 2, 1 << 30), r"[^/]*$", "")
        return books.select("book_id", F.concat(F.lit(outdir.rstrip("/") + "/"), inside, stem(p), F.lit(".txt")).alias("target"))
    rows = books.select("book_id", F.concat(F.lit(outdir.rstrip("/") + "/"), stem(p), F.lit(".txt")).alias("target"))
    parts = F.split("book_id", "/")
    w = W.partitionBy("target").orderBy(parts.desc() if force else parts)
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def pending_jobs(jobs: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Jobs whose target is not there yet (with force: all)."""
    return jobs if force else jobs.join(existing.select("target").distinct(), "target", "left_anti")


def kept_jobs(jobs: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The outcomes of jobs that are not run again."""
    rows = jobs.join(existing.select("target").distinct(), "target", "left_semi")
    rows = rows.filter(F.lit(not force))
    return rows.select("book_id", "target", F.lit("skip").alias("kind"), F.lit("").alias("detail"))


def outcomes(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """book_id, target, kind, detail of jobs that ran: texts(book_id, title, error, and text or n_chars)."""
    rows = jobs.join(texts, "book_id", "left")
    n = F.col("n_chars") if "n_chars" in texts.columns else F.length("text")
    bad = F.col("error").isNotNull() | n.isNull()
    said = F.concat(F.col("title"), F.lit(" ("), n, F.lit(" chars)"))
    return rows.select(
        "book_id", "target", F.when(bad, "fail").otherwise("ok").alias("kind"), F.when(bad, F.coalesce("error", F.lit("no text"))).otherwise(said).alias("detail")
    )


def tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def library_summary(rows: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return rows.agg(n("ok").alias("n_ok"), n("skip").alias("n_kept"), n("fail").alias("n_failed"), n("image").alias("n_image"))


#: Bins of one round of exact_quantiles(), and values that end it.
BINS, FEW = 1_000, 1_000


def exact_quantiles(values: DataFrame, shares: list[float]) -> list[float | None]:
    """The interpolated quantiles of the one numeric column of values, nulls left out: each rank's value is enclosed by histograms between the least and
    greatest value that it may have, narrowed in rounds, so that no task ever holds more than BINS counts or FEW values."""
    v = values.select(F.col(values.columns[0]).cast("double").alias("v")).filter("v is not null")

    def ranked(rank: int, n: int) -> float:
        low, high = v.agg(F.min("v"), F.max("v")).first()
        while low < high and n > FEW:
            part = v.filter(F.col("v").between(low, high))
            bin_ = F.floor((F.col("v") - low) / (high - low) * BINS)
            for r in part.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():
                if rank < r["n"]:
                    low, high, n = r["low"], r["high"], r["n"]
                    break
                rank -= r["n"]
        if low == high:
            return low
        return sorted(r["v"] for r in v.filter(F.col("v").between(low, high)).collect())[rank]

    n, out = v.count(), []
    for p in shares:
        at = p * (n - 1)
        if not n:
            out.append(None)
            continue
        a = ranked(math.floor(at), n)
        b = a if at == math.floor(at) else ranked(math.floor(at) + 1, n)
        out.append(a if a == b else (math.floor(at) + 1 - at) * a + (at - math.floor(at)) * b)
    return out


def size_report(sizes: DataFrame) -> DataFrame:
    """sizes(book_id, bytes_in, bytes_out): totals, their ratio, and the median and least ratio of a book."""
    r = F.col("bytes_out") / F.col("bytes_in")
    (median,) = exact_quantiles(sizes.select(r), [0.5])
    return sizes.agg(
        F.sum("bytes_in").alias("total_in"), F.sum("bytes_out").alias("total_out"), (F.sum("bytes_out") / F.sum("bytes_in")).alias("ratio"),
        F.lit(median).cast("double").alias("median_ratio"), F.min(r).alias("min_ratio"),
    )


def picture_book_verdict(pages: DataFrame, cap: int = ENTRY_CAP) -> DataFrame:
    """pages(book_id, n_bytes, html, pre_paginated): is each book pictures only? Larger pages count as text unread; pages are
    two numbers before the shuffle."""
    single = F.when((F.col("n_bytes") <= cap) & F.col("html").isNotNull(), X.is_single_image_page(F.col("html"))).otherwise(False)
    n = pages.groupBy("book_id").agg(F.count("*").alias("n_pages"), F.count_if(single).alias("n_single"), F.bool_or("pre_paginated").alias("fixed"))
    verdict = F.when(F.coalesce("fixed", F.lit(False)), F.col("n_single") == F.col("n_pages")).otherwise(
        (F.col("n_single") >= 3) & (F.col("n_single") * 10 >= F.col("n_pages") * 7)
    )
    return n.select("book_id", "n_pages", "n_single", verdict.alias("is_picture_book"))


def drop_picture_books(jobs: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The jobs that stay, and the outcomes of those that do not."""
    bad = verdicts.filter("is_picture_book").select("book_id")
    return jobs.join(bad, "book_id", "left_anti"), jobs.join(bad, "book_id", "left_semi").select("book_id", "target", F.lit("image").alias("kind"), F.lit("").alias("detail"))
