"""SimHash fingerprints and Hamming search, in DataFrame operations only.

Terms are words; each occurrence votes with the word's length (at most 16) on the 64 bits of its hash.
Votes are summed as 32 longs of two 32-bit lanes each, so a document is one row of map-side sums and
a very long text is never held as votes. Bit i is set if more than half of the weight voted for it.

Search: fingerprints are cut into `blocks` blocks; a table for each choice of (blocks - radius) blocks
holds the fingerprints keyed by those blocks. Fingerprints within `radius` differ in at most radius
blocks, so they share the key of some table: the search is exact. Equal fingerprints are joined once.

Nulls: a null text is empty; a text without words has the fingerprint 0. Repeated rows have one fingerprint, but each its own
neighbour. Null ids are kept; neighbours() takes numeric ids. Extra columns are not touched.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import SPACES

LANES = [f"_v{i}" for i in range(32)]
MASK = 0x0000000100000001
MAX_WEIGHT = 16


def simhash(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fingerprint LONG, one row for each distinct value of the keys (which say what text it is)."""
    word = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), SPACES)).alias("_w")
    votes = df.select(*keys, word).select(
        *keys, F.xxhash64("_w").alias("_h"), F.least(F.length("_w"), F.lit(MAX_WEIGHT)).cast("long").alias("_n")
    )
    lane = lambda i: F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(MASK)) * F.col("_n")
    summed = votes.groupBy(*keys).agg(*[F.sum(lane(i)).alias(LANES[i]) for i in range(32)], F.sum("_n").alias("_total"))
    low = lambda i: F.col(LANES[i]).bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda i: F.shiftrightunsigned(F.col(LANES[i]), 32)
    bit = lambda v, at: F.when(v * 2 > F.col("_total"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
    parts = [bit(low(i), i) for i in range(32)] + [bit(high(i), i + 32) for i in range(32)]
    return summed.select(*keys, _ored(parts).alias("fingerprint"))


def _ored(parts: list[Column]) -> Column:
    while len(parts) > 1:
        parts = [parts[i].bitwiseOR(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of the 64 bits that agree."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)).cast("double") / 64.0


def tables(fps: DataFrame, radius: int, blocks: int, name: str) -> DataFrame:
    """fps(fingerprint) in all permuted tables: _table INT, _key LONG and the fingerprint as `name`."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    rows = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        rows.append(F.struct(F.lit(n).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(mask).cast("long")).alias("k")))
    return fps.select(F.col("fingerprint").alias(name), F.explode(F.array(*rows)).alias("x")).select(name, F.col("x.t").alias("_table"), F.col("x.k").alias("_key"))


def search(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, fingerprint) of distinct fingerprints of queries(fingerprint) and fps(fingerprint) within radius."""
    q = tables(queries.select("fingerprint").distinct(), radius, blocks, "query")
    a = tables(fps.select("fingerprint").distinct(), radius, blocks, "fingerprint")
    near = q.join(a, ["_table", "_key"]).filter(F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))) <= radius)
    return near.select("query", "fingerprint").distinct()


def neighbours(docs: DataFrame, bucket_rows: int = 2_000) -> DataFrame:
    """docs(doc_id, text) with next_id, next_text: the row that follows by descending doc_id, after the last the first.

    Rows are dealt into ranges of doc_id whose bounds are quantiles; only the order inside a range is a
    window, and each range's last row takes the first row of the next range, of which there is one a range."""
    n = docs.count()
    ranges = max(1, min(10_000, math.ceil(n / bucket_rows)))
    cuts = []
    if ranges > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(at).alias("_r"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    w = W.partitionBy("_r").orderBy(*order)
    inside = rows.select("*", F.lead(F.struct("doc_id", "text")).over(w).alias("_next"), F.row_number().over(w).alias("_n"))
    first = inside.filter("_n = 1").select("_r", F.struct("doc_id", "text").alias("_first"))
    present = [r["_r"] for r in rows.select("_r").distinct().orderBy("_r").collect()]  # one number a range
    follows = {a: present[(i + 1) % len(present)] for i, a in enumerate(present)}
    before = {b: a for a, b in follows.items()}
    back = F.element_at(F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv]), F.col("_r")) if before else F.lit(0)
    heads = first.select(back.alias("_r0"), "_first")
    out = inside.join(heads, (F.col("_r") == F.col("_r0")) & F.col("_next").isNull(), "left")
    nxt = F.coalesce("_next", "_first")
    return out.select("doc_id", "text", nxt["doc_id"].alias("next_id"), nxt["text"].alias("next_text"))
