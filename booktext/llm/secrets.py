"""Secret scans, in DataFrame operations only.

Base rules are patterns. Beside them every candidate token (a run of 16 or more of the characters that
keys are written in) is scored by two character Markov models, one of random strings and one of ordinary
identifiers: the log-likelihood ratio of its character pairs, a state for each character. Both are trained from labelled
samples: random strings are those of `generated()`, a fixed table of every alphabet, and the values that base rules found; ordinary ones
are all other tokens of 8 to 15 characters of the corpus (keys that no rule found are longer, so they do not teach the model) and
generated numbers. Training takes the rows (or values) whose hash lies in the share that gives about `train_rows` of them: a
bounded sample by design, taken where the rows are; scoring covers every whole text.

Weights are rounded to thousandths and summed as integers, so results do not depend on the order of rows.
All steps are linear in a text's length and its number of spans: tokens are scored as arrays, overlaps are found by running
maxima, and redacted texts are put together from blocks.

Nulls: a null text is empty; null ids are kept. Rows are told apart by id and a hash of the text, and
repeated rows get the same spans. Positions are code points, end exclusive. Empty tables give empty results. Other columns
are kept; one called secret_spans (or one that starts with _secret) raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import materialize

# The base rules. Runs are maximal, so a least length inside the pattern drops the same
# matches as a check afterwards; only assign needs that check.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Characters of a candidate at least. Shorter tokens train the model of ordinary identifiers, unless a base rule found them.
LEAST = 16
ORDINARY = r"[A-Za-z0-9+/_=-]{8,}"
#: States: the characters from "+" to "z", of which 68 can stand in a token.
FIRST, STATES, LETTERS = ord("+"), 80, 68
#: Pairs' worth of weight that a second character's own probability has.
BACKOFF = 5
#: Alphabets of random strings, and how many strings of each train the model.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = [LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS, LOWER + UPPER, LOWER + DIGITS, UPPER + DIGITS, LOWER, UPPER, DIGITS + "abcdef"]
STRINGS, NUMBERS = 250, 1000
#: Rows (and values) that train the two models, about.
TRAIN_ROWS = 20_000
#: Thousandths of log-likelihood ratio a character pair that a random string reaches.
THRESHOLD = 700


def spans_of(rows: DataFrame, pattern: str, kind: str, group: int = 0, least: int = 0) -> DataFrame:
    """rows(id, mark, text) -> id, mark, kind, start, end, value of each leftmost non-overlapping match.

    Texts without a match are filtered first; positions are running sums of the gaps' and matches' lengths."""
    hit = rows.filter(F.col("text").rlike(pattern))
    gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    parts = hit.select("id", "mark", F.posexplode(F.arrays_zip(whole.alias("m"), value.alias("v"), gaps.alias("g"))).alias("pos", "x"))
    parts = parts.select("id", "mark", "pos", "x.m", "x.v", "x.g").filter("m is not null").distinct()
    w = W.partitionBy("id", "mark").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.sum(F.col("g") + F.length("m")).over(w)
    out = parts.select("id", "mark", F.lit(kind).alias("kind"), (at - F.length("m")).alias("start"), at.alias("end"), F.col("v").alias("value"))
    return out.filter(F.length("value") >= least) if least else out


def base_spans(rows: DataFrame) -> DataFrame:
    """The base rules' spans of rows(id, mark, text)."""
    return (
        spans_of(rows, ASSIGN, "assign", 1, 8)
        .unionByName(spans_of(rows, ACCESS, "access"))
        .unionByName(spans_of(rows, HEX, "hex"))
    )


def steps(token: Column) -> Column:
    """ARRAY<INT>: each neighbouring pair of characters of a token as one number."""
    at = F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), lambda c: F.ascii(c) - FIRST)
    n = F.greatest(F.length(token) - 1, F.lit(0))
    return F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda a, b: a * STATES + b)


def train(random: DataFrame, ordinary: DataFrame, token: str = "value") -> list[int]:
    """Thousandths of log P_random(b|a) - log P_ordinary(b|a) for all pairs of states, as one list.

    A pair's probability is interpolated with its second character's, which has add-one smoothing: a model without samples is
    uniform."""
    rows = random.select(F.explode(steps(F.col(token))).alias("k"), F.lit(1).alias("r")).unionByName(ordinary.select(F.explode(steps(F.col(token))).alias("k"), F.lit(0).alias("r")))
    counted = rows.groupBy("k").agg(F.sum("r").alias("nr"), F.sum(1 - F.col("r")).alias("no"))
    every = random.sparkSession.range(STATES * STATES).select(F.col("id").cast("int").alias("k"))
    full = every.join(counted, "k", "left").fillna(0)
    first, second = W.partitionBy(F.floor(F.col("k") / STATES)), W.partitionBy(F.col("k") % STATES)

    def log(c: str) -> Column:
        alone = (F.sum(c).over(second) + 1) / (F.sum(c).over(W.partitionBy()) + LETTERS)
        return F.log((F.col(c) + BACKOFF * alone) / (F.sum(c).over(first) + BACKOFF))

    weights = full.select("k", F.round((log("nr") - log("no")) * 1000).cast("int").alias("weight"))
    return [r["weight"] for r in weights.orderBy("k").collect()]  # STATES * STATES numbers


def ratio(token: Column, weights: list[int]) -> Column:
    """A token's log-likelihood ratio in thousandths, summed over its pairs of characters."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # a constant
    return F.aggregate(steps(token), F.lit(0).cast("long"), lambda a, k: a + F.get(table, k))


def generated(spark: SparkSession, strings: int = STRINGS, alphabets: list[str] = ALPHABETS, seed: int = 6) -> DataFrame:
    """alphabet INT and value: so many random strings of 16 to 64 characters of each alphabet, the same in every run."""
    rows = spark.range(strings * len(alphabets)).select((F.col("id") % len(alphabets)).cast("int").alias("alphabet"), "id")
    letters = F.element_at(F.array(*[F.lit(a) for a in alphabets]), F.col("alphabet") + 1)
    n = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(49)) + 16).cast("int")
    one = lambda i: F.substring(letters, (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.length(letters)) + 1).cast("int"), F.lit(1))
    return rows.select("alphabet", F.array_join(F.transform(F.sequence(F.lit(1), n), one), "").alias("value"))


def _share(key: Column, rows: int, total: int) -> Column:
    """Does the hash of the key lie in the share of its range that gives about so many of the total?"""
    return F.lit(True) if total <= rows else F.pmod(key, F.lit(1 << 30)) < F.lit(int((1 << 30) * rows / total))


def learn(rows: DataFrame, base: DataFrame, train_rows: int = TRAIN_ROWS) -> list[int]:
    """The models' weights from rows(id, mark, text) and their base spans."""
    key = F.xxhash64("id", "mark")
    words = rows.filter(_share(key, train_rows, rows.count())).select("id", "mark", F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)).alias("w")).dropDuplicates(["id", "mark"])
    words = words.select(F.explode("w").alias("value")).filter(F.length("value") < LEAST)
    values = base.select(F.explode(F.regexp_extract_all("value", F.lit(ORDINARY), F.lit(0))).alias("value")).distinct()
    ordinary = words.join(values, "value", "left_anti").unionByName(generated(rows.sparkSession, NUMBERS, [DIGITS]).select("value"))
    picked = base.filter(_share(F.xxhash64("id", "mark", "start"), train_rows, base.count())).select("value")
    return train(picked.unionByName(generated(rows.sparkSession).select("value")), ordinary)


def spans_table(rows: DataFrame, train_rows: int = TRAIN_ROWS, threshold: int = THRESHOLD, weights: list[int] | None = None) -> DataFrame:
    """id, mark, kind, start, end of all spans of rows(id, mark, text)."""
    base = materialize(base_spans(rows), "secret-base")
    weights = weights or learn(rows, base, train_rows)
    tokens = spans_of(rows, CANDIDATE, "markov")
    found = tokens.filter(ratio(F.col("value"), weights) >= F.lit(threshold) * (F.length("value") - 1))
    # a token inside or across a base span is that span's: the nearest base spans on either side are running extremes
    both = base.select("id", "mark", "kind", "start", "end").unionByName(found.select("id", "mark", "kind", "start", "end"))
    is_base = F.col("kind") != "markov"
    text = W.partitionBy("id", "mark")
    reach = F.max(F.when(is_base, F.col("end"))).over(text.orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.min(F.when(is_base, F.col("start"))).over(text.orderBy(F.col("start").desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumn("reach", reach).withColumn("ahead", ahead)
    free = ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    return both.filter(is_base | free).select("id", "mark", "kind", "start", "end")


def scan(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) -> id, mark, spans ARRAY<STRUCT<start, kind INT, end>> sorted and cuts ARRAY<STRUCT<start, end>> (the text
    between spans, overlapping ones joined) and tail (where the last ends), for texts with a span."""
    rows = docs.select(F.col("doc_id").alias("id"), mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    spans = spans_table(rows, **options)
    before = W.partitionBy("id", "mark").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0)))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    item = F.struct(F.col("start").cast("long").alias("start"), number.alias("kind"), F.col("end").cast("long").alias("end"))
    cut = F.when(F.col("start") >= F.col("past"), F.struct(F.col("past").cast("int").alias("start"), F.col("start").cast("int").alias("end")))
    return spans.groupBy("id", "mark").agg(
        F.array_sort(F.collect_set(item)).alias("spans"), F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("end").cast("int").alias("tail")
    )


def mark(text: Column) -> Column:
    """A hash of the text; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"], x["end"])), ",")


def _joined(docs: DataFrame, **options) -> DataFrame:
    """docs with _secret_spans, _secret_cuts and _secret_tail."""
    if clash := [c for c in docs.columns if c == "secret_spans" or c.startswith("_secret")]:
        raise ValueError(f"columns {clash} are there already")
    found = scan(docs, **options)
    found = found.select(*[F.col(c).alias(f"_secret_{c}") for c in found.columns])
    on = F.col("doc_id").eqNullSafe(F.col("_secret_id")) & (mark(F.col("text")) == F.col("_secret_mark"))
    return docs.join(found, on, "left")


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """docs with secret_spans, an empty array where there are none."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return _joined(docs, **options).select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("_secret_spans", none).alias("secret_spans"))


#: Code points of the blocks that a text is cut into where it is put together anew.
BLOCK = 4096


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is cut into blocks: only the blocks at its ends are searched."""
    i, j = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    head, tail = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
    one = F.substring(head, start % BLOCK + 1, end - start)
    more = F.concat(F.substring(head, start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), end % BLOCK))
    return F.when(end <= start, F.lit("")).when(i == j, one).otherwise(more)


def redact(docs: DataFrame, label: str = "[secret]", **options) -> DataFrame:
    """docs with the text of every span replaced by a label; overlapping spans are joined. No row goes."""
    rows = _joined(docs, **options)
    # the last block of a whole number of blocks is empty
    blocks = F.concat(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), F.array(F.lit("")))
    rows = rows.withColumn("_secret_blocks", F.when(F.size("_secret_cuts") > 0, blocks))
    parts = F.transform("_secret_cuts", lambda x: F.concat(_piece(F.col("_secret_blocks"), x["start"], x["end"]), F.lit(label)))
    cut = F.concat(F.array_join(parts, ""), _piece(F.col("_secret_blocks"), F.col("_secret_tail"), F.length("text")))
    text = F.when(F.size("_secret_cuts") > 0, cut).otherwise(F.col("text"))
    return rows.withColumn("_secret_text", text).select(*[F.col("_secret_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
