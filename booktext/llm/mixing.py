"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a keyed digest of their id), repeated for as many
epochs as allowed, and given a virtual finish time: the source's tokens up to and including the
document, divided by the source's target. A global range sort on that time, cut at the total
budget, is the mix. Both running sums are two-level: documents are dealt into buckets of the
shuffle order (or of the finish time), the buckets' sums are accumulated, and only the order
inside a bucket is a window. So a source with a third of all rows is spread over its buckets.

Nulls: a null text or size counts 0; a null source is a source of its own, sorted last. Documents of
size 0 are never taken. Equal ids are ordered by the digest of the text, equal rows share one place. Empty tables give empty
results. Other columns are kept, whatever their names; one called as a column that is added gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, shielded

#: Rows that a bucket of the shuffle order or of the finish time should hold.
BUCKET_ROWS = 20_000


def n_words(text: Column) -> Column:
    """Words of the whole text (null: 0)."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    parts = F.split(spaced, " +")
    return F.size(F.filter(parts, lambda x: x != "")).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes(source, source_size) with weight and target: `share` of all sizes dealt by weight, none above
    `most` times its size, the excess dealt anew by weight. In closed form: sources are capped in order of
    size by weight as long as the level that the others would get is above their cap. One row a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    everyone = W.partitionBy()
    order = W.orderBy("fill", "rank")
    capped = (
        ranked.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.least(F.sum("source_size").over(everyone) * F.lit(float(share)), F.sum("cap").over(everyone)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("over", F.col("level") >= F.col("fill"))
    )
    level = F.min(F.when(~F.col("over"), F.struct("fill", "rank", "level"))).over(everyone)["level"]
    return capped.withColumn("target", F.when(F.col("over"), F.col("cap")).otherwise(level * F.col("weight"))).select(
        "source", "source_size", "weight", "target", "budget"
    )


def mix(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, taken and epochs of each row.

    taken is size times the epochs in which the document comes before the cut."""
    return shielded(docs, ["doc_id", "text", "source"], lambda d: _mixed(d, weights, share, most, seed))


def _mixed(docs: DataFrame, weights: list[float], share: float, most: float, seed: str) -> DataFrame:
    keep = docs.columns
    order_key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = materialize(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), order_key.alias("_o"), F.md5(F.coalesce("text", F.lit(""))).alias("_t")
        ),
        "mix-sizes",
    )
    n = max(1, rows.count())
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    rows = rows.withColumn("_b", F.conv(F.substring("_o", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32))
    rows = rows.withColumn("_b", F.floor("_b").cast("int"))
    # level 1: running sums of each source, bucket by bucket
    parts = materialize(rows.groupBy("source", "_b").agg(F.sum("size").alias("part")), "mix-parts")
    sizes = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    aims = targets(sizes, list(weights), share, most)
    base = F.coalesce(F.sum("part").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("_base", base).join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "part")
    offsets = offsets.select(F.col("source").alias("_s"), F.col("_b").alias("_b2"), "_base", "source_size", "target")
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2"))).drop("_s", "_b2")
    inside = F.sum("size").over(W.partitionBy("source", "_b").orderBy("_o", "_t").rowsBetween(W.unboundedPreceding, W.currentRow))
    done = placed.withColumn("_done", F.col("_base") + inside)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))).alias("_e")
    queue = done.select("*", epochs)
    queue = queue.withColumn("_finish", (F.col("_done") + F.col("_e") * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")))
    queue = materialize(queue.filter(F.col("size") > 0).filter("_finish is not null").select(
        "doc_id", "source", "size", "_o", "_t", "_e", "_finish"), "mix-queue")
    # level 2: the global order of finish times, cut at the budget. Every source ends its target at time 1.
    step = F.floor(F.col("_finish") * buckets).cast("long").alias("_f")
    times = queue.groupBy(step).agg(F.sum("size").alias("part"), F.max("_finish").alias("last"))
    before = times.withColumn("_start", F.coalesce(F.sum("part").over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = aims.agg(F.coalesce(F.max("budget"), F.lit(0.0)).alias("_total"))
    # times has a row for each bucket, total has one row
    before = before.crossJoin(F.broadcast(total)).select(F.col("_f").alias("_f2"), "_start", "_total", "part")
    timed = queue.withColumn("_f", F.floor(F.col("_finish") * buckets).cast("long"))
    timed = timed.join(before, F.col("_f") == F.col("_f2"))
    whole = timed.filter(F.col("_start") + F.col("part") <= F.col("_total"))
    cut = timed.filter((F.col("_start") < F.col("_total")) & (F.col("_start") + F.col("part") > F.col("_total")))
    run = F.sum("size").over(W.partitionBy("_f").orderBy("_finish", F.col("source").asc_nulls_last(), "_o", "_t").rowsBetween(W.unboundedPreceding, -1))
    cut = cut.withColumn("_run", F.coalesce(run, F.lit(0))).filter(F.col("_start") + F.col("_run") < F.col("_total")).drop("_run")
    taken = whole.unionByName(cut).groupBy("_o", "_t", "source").agg(F.max("_e").alias("_last"))
    taken = taken.select(F.col("_o").alias("_o2"), F.col("_t").alias("_t2"), F.col("source").alias("_s2"), (F.col("_last") + 1).cast("int").alias("epochs"))
    keyed = docs.select(*keep, n_words(F.col("text")).alias("size"), order_key.alias("_o"), F.md5(F.coalesce("text", F.lit(""))).alias("_t"))
    per_source = aims.select(F.col("source").alias("_s3"), "source_size", "target")
    out = keyed.join(taken, (F.col("_o") == F.col("_o2")) & (F.col("_t") == F.col("_t2")) & F.col("source").eqNullSafe(F.col("_s2")), "left")
    out = out.join(per_source, F.col("source").eqNullSafe(F.col("_s3")), "left")
    epochs = F.coalesce("epochs", F.lit(0))
    return out.select(*keep, "size", "source_size", "target", (F.col("size") * epochs).alias("taken"), epochs.alias("epochs"))
