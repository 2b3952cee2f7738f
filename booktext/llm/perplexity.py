"""Quality rules by n-gram perplexity: a modified Kneser-Ney model for each language, counted by Spark.

Symbols are the bytes of the text in UTF-8, with digits made 0 and white space made a blank, so any
language has at most 256. Tasks count the n-grams of whole texts with numpy; Spark adds up the counts,
derives the lower orders' continuation counts, the discounts of each language and order (from its counts of
counts), and the interpolated log probabilities and back-off weights. Both tables are kept as arrays of 64-bit
hashes in sorted order with their values beside them. They are broadcast if they hold at most `broadcast_entries`
entries; beyond that, documents' n-grams are joined to the tables by hash, with the same results, because
log probabilities are integers (ten-thousandths of a bit).

No document is scored by a model that counted it: documents are dealt to folds by the hash of their text (so equal texts
share one), and each fold is scored by the counts of all documents of the other folds.

A document's score is its mean bits a word (log2 of the perplexity by words), in hundredths. Bands are language-specific:
Tukey fences round the quartiles of the language's scores, wider for short texts; documents outside are
rejected.

Nulls: a null text is empty, a null language is a language of its own, null ids are kept. Texts shorter than
the order have no n-grams, no score, and pass the band. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, giving_back, materialize, mix, shielded, shingles, slices, utf8

ORDER = 5
#: Ten-thousandths of a bit.
UNIT = 10_000
#: Entries (16 bytes each) that a broadcast may have.
BROADCAST_ENTRIES = 12_000_000
#: N-grams of a language that a counting task holds before it counts them, at least.
COUNT_KEYS = 250_000
#: Parts that documents are dealt to; each is scored by the counts of the others.
FOLDS = 2
#: Interquartile ranges below the lower and above the upper quartile that a score may lie.
LOWER, UPPER = 4.0, 4.0
#: Words at which the band of a short text is wider by the square root of two.
SHORT = 100

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[48:58] = 48
_FOLD[9:14] = 32
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (8 bits a symbol) of all texts, and the text each belongs to; none crosses texts."""
    n = len(data)
    if n < order:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = _FOLD[data].astype(np.uint64)
    key = np.zeros(n - order + 1, dtype=np.uint64)
    for i in range(order):
        key = (key << np.uint64(8)) | x[i : n - order + 1 + i]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = row[: n - order + 1] == row[order - 1 :]
    return key[whole], row[: n - order + 1][whole]


def _count(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    at = np.argsort(keys, kind="stable")
    keys, n = keys[at], n[at]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram LONG, n LONG over docs(text, lang), as each task counts them: a task has at most one row of an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: dict[str | None, list] = {}  # keys not yet counted
        held: dict[str | None, tuple] = {}

        def settle(lang: str | None) -> None:
            k, c = _count(np.concatenate(raw.pop(lang)))
            if lang in held:
                k, c = _count(np.r_[held[lang][0], k], np.r_[held[lang][1], c])
            held[lang] = (k, c)

        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                key, row = grams(data, offsets, order)
                langs = part.column("lang").to_pylist()
                names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                of = np.array([names[x] for x in langs])[row]
                for lang, i in names.items():
                    mine = raw.setdefault(lang, [])
                    mine.append(key[of == i])
                    # twice what is held, so that merging stays linear in the text
                    if sum(map(len, mine)) > max(COUNT_KEYS, 2 * len(held.get(lang, ((),))[0])):
                        settle(lang)
        for lang in list(raw):
            settle(lang)
        for lang, (k, c) in held.items():
            for i in range(0, len(k), 100_000):
                a = k[i : i + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(c[i : i + 100_000].astype(np.int64))], ["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(giving_back(run), "lang string, gram long, n long")


def summed(rows: DataFrame) -> DataFrame:
    """lang, gram, n of counted() rows, summed after they are dealt out: adding up in each task before that would fill a hash table
    with all its rows and merge none."""
    return rows.repartition("lang", "gram").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram LONG, n LONG over all docs(text, lang)."""
    return summed(counted(docs, order))


def model(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From counts of the highest order: probs(lang, level, gram, logp) and backs(lang, level, gram, back), in units of
    bits / UNIT. backs' gram is a context of level - 1 symbols."""
    levels = {order: counts.select("lang", "gram", F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        levels[k] = materialize(levels[k + 1].select("lang", tail).groupBy("lang", "gram").agg(F.count("*").alias("c")), f"kn-{k}")
    below, probs, backs = None, None, None
    for k in range(1, order + 1):
        rows = levels[k].withColumn("ctx", F.shiftright("gram", 8))
        of = lambda n: F.sum((F.col("c") == n).cast("double"))
        d = levels[k].groupBy("lang").agg(*[of(i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        sound = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
        disc = lambda i: F.when(sound, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(0.5 * i))
        d = d.select(F.col("lang").alias("l"), *[disc(i).alias(f"d{i}") for i in (1, 2, 3)])
        rows = rows.join(F.broadcast(d), F.col("lang").eqNullSafe(F.col("l"))).drop("l")  # a row for each language
        own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("off", own)
        ctx = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum(F.round(F.col("off") * 1e6).cast("long")).alias("offs"))
        ctx = ctx.select(F.col("lang").alias("l"), F.col("ctx").alias("x"), "total", (F.col("offs") / F.lit(1e6) / F.col("total")).alias("gamma"))
        rows = rows.join(ctx, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ctx") == F.col("x"))).drop("l", "x")
        if below is None:
            rows = rows.withColumn("p0", F.lit(1 / 256))
        else:
            low = below.select(F.col("lang").alias("l"), F.col("gram").alias("g"), F.col("p").alias("p0"))
            tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            rows = rows.join(low, F.col("lang").eqNullSafe(F.col("l")) & (tail == F.col("g")))
        p = (F.col("c") - F.col("off")) / F.col("total") + F.col("gamma") * F.col("p0")
        below = materialize(rows.select("lang", "gram", p.alias("p"), "ctx", "gamma"), f"kn-p{k}")
        bits = lambda c: F.round(F.log2(F.greatest(F.col(c), F.lit(1e-12))) * UNIT).cast("int")
        prob = below.select("lang", F.lit(k).alias("level"), "gram", bits("p").alias("logp"))
        back = below.groupBy("lang", "ctx").agg(F.max("gamma").alias("gamma")).select("lang", F.lit(k).alias("level"), F.col("ctx").alias("gram"), bits("gamma").alias("back"))
        probs = prob if probs is None else probs.unionByName(prob)
        backs = back if backs is None else backs.unionByName(back)
    return probs, backs


def lang_mark(lang: str | None) -> int:
    """A language's part of the hash."""
    import xxhash

    return xxhash.xxh64_intdigest("" if lang is None else "=" + lang)


def hashes(gram: np.ndarray, level: int, mark: int | np.ndarray, context: bool) -> np.ndarray:
    """64-bit hashes of n-grams of one level."""
    salt = 2 * level + context
    return mix(gram ^ mix(np.atleast_1d(np.asarray(mark, dtype=np.uint64)) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))


def hashed(rows: DataFrame, value: str, context: bool) -> DataFrame:
    """h LONG and the value, of rows(lang, level, gram, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict = {}
        for b in batches:
            langs, level = b.column(0).to_pylist(), b.column(1).to_numpy()
            gram = b.column(2).to_numpy().astype(np.uint64)
            mark = np.array([marks[x] if x in marks else marks.setdefault(x, lang_mark(x)) for x in langs], dtype=np.uint64)
            h = np.zeros(len(gram), dtype=np.uint64)
            for k in np.unique(level):
                at = level == k
                h[at] = hashes(gram[at], int(k), mark[at], context)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(3)], ["h", value])

    return rows.select("lang", "level", "gram", value).mapInArrow(giving_back(run), f"h long, {value} int")


class HashArray:
    """Values by 64-bit hash: a sorted array, with an index on the leading bits to start the search at."""

    def __init__(self, h: np.ndarray, values: np.ndarray) -> None:
        at = np.argsort(h)
        self.h, self.values = h[at], values[at]
        self.bits = np.uint64(64 - max(1, int(max(1, len(h))).bit_length()))
        edges = np.arange(1 << int(64 - self.bits), dtype=np.uint64) << self.bits
        self.index = np.r_[np.searchsorted(self.h, edges), len(h)].astype(np.int64)
        self.longest = int(np.diff(self.index).max(initial=0))
        self.h = np.r_[self.h, np.zeros(self.longest + 1, np.uint64)]
        self.values = np.r_[self.values, np.zeros(self.longest + 1, self.values.dtype)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which hashes are there."""
        top = (h >> self.bits).astype(np.int64)
        at, end = self.index[top], self.index[top + 1]
        there = (self.h[at] == h) & (at < end)
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            there[left] = self.h[at[left]] == h[left]
            left = left[~there[left] & (at[left] + 1 < end[left])]
        return np.where(there, self.values[at], 0), there


def score_grams(key: np.ndarray, mark: np.ndarray, probs: HashArray, backs: HashArray, order: int) -> np.ndarray:
    """Log probability (bits / UNIT) of each n-gram's last symbol, backing off from the highest order."""
    out = np.zeros(len(key), dtype=np.int64)
    left = np.arange(len(key))
    for k in range(order, 0, -1):
        g, m = key[left] & np.uint64((1 << 8 * k) - 1), mark[left]
        value, there = probs.find(hashes(g, k, m, False))
        out[left] += value
        left = left[~there]
        if not len(left):
            return out
        back, _ = backs.find(hashes(g[~there] >> np.uint64(8), k, m[~there], True))
        out[left] += back
    out[left] += -8 * UNIT
    return out


def base_stats(texts: pa.Array, words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    d, o = words.data, words.offsets
    first, n = words.first, len(texts)
    inside = np.zeros(len(d) + 1, dtype=np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    lead = (np.cumsum(inside[:-1]) > 0) & ((d & 0xC0) != 0x80)
    sums = lambda x: np.r_[0, np.cumsum(x)][o[1:]] - np.r_[0, np.cumsum(x)][o[:-1]]
    dup, rep = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= 6:
            s = shingles(words.hash[a:b])
            t = np.sort(s)
            if (same := t[1:] == t[:-1]).any():
                twice = np.flatnonzero(np.isin(s, t[1:][same]))
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, np.minimum(twice + 5, b - a), -1)
                rep[i] = int((np.cumsum(cover)[: b - a] > 0).sum())
        raw = d[o[i] : o[i + 1]].tobytes()
        if b"\n" in raw:
            lines = raw.split(b"\n")
            if len(set(lines)) < len(lines):
                dup[i] = sum(c - 1 for x, c in Counter(lines).items() if c > 1 and x.split())
    return [np.diff(first), sums(lead.astype(np.int64)), sums(_SYMBOL[d]), dup, rep]


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(docs: DataFrame, probs: DataFrame, backs: DataFrame, order: int = ORDER, broadcast_entries: int = BROADCAST_ENTRIES, sent: list[Broadcast] | None = None) -> DataFrame:
    """docs(text, lang, ...) without text, with STATS, n_grams and bits (the sum, in units of bits / UNIT). sent gets the broadcast
    model, for a caller that destroys it when the rows are written."""
    sc = docs.sparkSession.sparkContext
    tables = [materialize(hashed(probs, "logp", False), "kn-probs"), materialize(hashed(backs, "back", True), "kn-backs")]
    if sum(t.count() for t in tables) > broadcast_entries:
        return _score_joined(docs, *tables, order)
    cols = [t.toArrow() for t in tables]  # bounded by broadcast_entries
    arrays = [HashArray(c.column(0).to_numpy().astype(np.int64).view(np.uint64), c.column(1).to_numpy().astype(np.int32)) for c in cols]
    shared = sc.broadcast([(a.h, a.values, a.bits, a.index, a.longest) for a in arrays])
    if sent is not None:
        sent.append(shared)
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for fields in shared.value:
            a = HashArray.__new__(HashArray)
            a.h, a.values, a.bits, a.index, a.longest = fields
            made.append(a)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                stats = base_stats(part.column("text"), words)
                key, row = grams(words.data, words.offsets, order)
                mark = np.array([lang_mark(x) for x in part.column("lang").to_pylist()], dtype=np.uint64)
                bits = score_grams(key, mark[row], *made, order)
                n = np.bincount(row, minlength=part.num_rows)
                total = np.bincount(row, weights=bits, minlength=part.num_rows)  # integers below 2**53
                extra = [pa.array(x.astype(np.int64)) for x in (*stats, n, total)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + extra, names + STATS + ["n_grams", "bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(giving_back(run), schema + "".join(f", {c} long" for c in [*STATS, "n_grams", "bits"]))


def _score_joined(docs: DataFrame, probs: DataFrame, backs: DataFrame, order: int) -> DataFrame:
    """score() for a model of any size: documents' distinct n-grams are joined to the tables by hash."""
    names = [c for c in docs.columns if c != "text"]
    rows = docs.withColumn("_key", F.xxhash64(*docs.columns))
    fields = [f for f in rows.schema if f.name != "text"]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = base_stats(part.column("text"), Words(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + [pa.array(x.astype(np.int64)) for x in s], [f.name for f in fields] + STATS)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                key, row = grams(*utf8(part.column("text")), order)
                mark = np.array([lang_mark(x) for x in part.column("lang").to_pylist()], dtype=np.uint64)
                ids = part.column("_key").to_numpy()
                for i in range(part.num_rows):
                    k, n = _count(key[row == i])
                    for level in range(order, 0, -1):
                        g = k & np.uint64((1 << 8 * level) - 1)
                        h, c = hashes(g, level, mark[i], False), hashes(g >> np.uint64(8), level, mark[i], True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(k), ids[i])), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))],
                            ["_key", "gram", "n", "h", "c"],
                        ).append_column("level", pa.array(np.full(len(k), level, np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    base = rows.mapInArrow(stats, schema + "".join(f", {c} long" for c in STATS))
    one = rows.dropDuplicates(["_key"])
    asked = one.select("_key", "text", "lang").mapInArrow(looked, "_key long, gram long, n long, h long, c long, level int")
    found = asked.join(probs, "h", "left").join(backs.select(F.col("h").alias("c"), "back"), "c", "left")
    per = found.groupBy("_key", "gram").agg(
        F.max("n").alias("n"),
        # a level found has all lower ones below it; the levels above give their back-off weights
        F.max(F.when(F.col("logp").isNotNull(), F.struct("level", "logp")))["logp"].alias("logp"),
        F.coalesce(F.sum(F.when(F.col("logp").isNull(), F.col("back"))), F.lit(0)).alias("off"),
    )
    value = F.col("n") * (F.coalesce("logp", F.lit(-8 * UNIT)) + F.col("off"))
    total = per.groupBy("_key").agg(F.sum("n").alias("n_grams"), F.sum(value).alias("bits"))
    out = base.join(total, "_key", "left").fillna(0, ["n_grams", "bits"])
    return out.select(*names, *STATS, "n_grams", "bits")


def banded(scored: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """scored with score (hundredths of a bit a word), low, high and in_band, by language."""
    s = F.when((F.col("n_grams") > 0) & (F.col("n_words") > 0), F.round(-F.col("bits") / F.col("n_words") / F.lit(UNIT / 100)).cast("int"))
    rows = scored.withColumn("score", s)
    q = rows.groupBy("lang").agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1.0))
    q = q.select(F.col("lang").alias("_l"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), iqr.alias("iqr"))
    rows = rows.join(q, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")
    # means over few words scatter more
    wide = F.col("iqr") * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("n_words"), F.lit(1)))
    rows = rows.withColumn("low", F.col("q1") - lower * wide).withColumn("high", F.col("q3") + upper * wide).drop("q1", "q3", "iqr")
    return rows.withColumn("in_band", F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(True)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _key(fold: Column, rest: Column) -> Column:
    """The name of a fold's model of a language: the fold, then "=" and the language if it is not null."""
    return F.concat(fold.cast("string"), rest)


def held_out(rows: DataFrame, folds: int) -> DataFrame:
    """From counted() rows whose lang names the fold counted, the counts of all other folds under each fold's name."""
    own, rest = F.regexp_extract("lang", "^[0-9]+", 0).cast("int"), F.regexp_replace("lang", "^[0-9]+", "")
    rows = rows.select(own.alias("own"), rest.alias("rest"), "gram", "n")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("fold <> own")
    return summed(rows.select(_key(F.col("fold"), F.col("rest")).alias("lang"), "gram", "n"))


def score_held_out(docs: DataFrame, folds: int = FOLDS, **options) -> DataFrame:
    """score() of docs(text, lang, ...), each by a model of its language without its fold."""
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(folds)).cast("int")
    rows = docs.withColumn("_fold", fold).withColumn("_lang", F.col("lang"))
    rows = rows.withColumn("lang", _key(F.col("_fold"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))))
    probs, backs = model(materialize(held_out(counted(rows), folds), "kn-counts"))
    out = None
    for i in range(folds):  # one fold's model at a time is broadcast
        mine = F.col("lang").rlike(f"^{i}(=|$)")
        sent: list[Broadcast] = []
        part = materialize(score(rows.filter(F.col("_fold") == i), probs.filter(mine), backs.filter(mine), sent=sent, **options), "kn-scored")
        for model_sent in sent:  # else it stays in the executors' heaps beside the next one
            model_sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumn("lang", F.col("_lang")).drop("_fold", "_lang")


def judge(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, lang, ...) without text, with STATS, score, low, high, in_band, base_failed and kept. An empty table gives an empty
    result; other columns are kept, whatever their names, and one called as a column that is added gives way to it."""

    def work(d: DataFrame) -> DataFrame:
        rows = banded(score_held_out(d, **options)).withColumn("base_failed", base_failed())
        return rows.withColumn("kept", ~F.col("base_failed") & F.col("in_band"))

    return shielded(docs, ["text", "lang"], work)
