"""Removal of repeated passages: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of `least` bytes that also starts in a document with a smaller id. Strings are judged on the input.

Which strings meet: each window of `least` bytes has a key, the least hash of the grams in it; equal windows have equal
keys. Neighbouring windows of one key are one piece (a substring of the text), and pieces meet by key. Pieces whose key lies in
one document only cannot repeat: a first pass finds the keys of two or more documents exactly, from sorted arrays of keys dealt by range, and
keeps them as a bitmap of 2**BITMAP_BITS bits (32 MB, whatever the input; a false hit only adds a piece to compare, and
an input with more repeated keys than bits only loses the saving). Equal pieces of a task are counted as one before they are dealt.

What decides: the pieces of some keys, each with an end mark, are one text of about BLOCK_BYTES. Its suffixes are sorted by
more than `least` symbols, which gives the Burrows-Wheeler transform; breadth-first backward extension of its intervals then finds the places
in suffix order where the common prefix is 0, 1, 2, ... symbols long, an interval being extended only if it found a new
place, and stops at `least`: whatever is left between two such places shares `least` bytes. All intervals of one length are
extended at once, as arrays. The least id of each group of windows says from which documents its bytes go.

Windows of a key that very many documents have (HOT_ROWS) are dealt by their own hash, so no key's pieces outgrow a task.

Nulls: a null text is empty; a row with a null id is neither smaller nor greater than others, so it keeps all and takes nothing. Rows
with one id do not repeat each other; repeated rows get one result each. Texts shorter than `least` stay. Empty tables give empty
results; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, dropped, materialize, mix, slices, utf8

LEAST = 50
GRAM = 16
BITMAP_BITS = 28
#: Keys that a task sorts at once, and keys of a range, about.
KEYS_AT_ONCE, RANGE_KEYS = 1 << 20, 1 << 20
#: Windows of a piece at most; a longer run of one key is cut.
MOST_WINDOWS = 1_000
BLOCK_BYTES = 250_000
#: Rows of a key that is hot, unless a millionth of all is more.
HOT_ROWS = 200_000
#: Shares of the keys that are decided one after the other, so that only one share's pieces are on disk.
SHARES = 2
#: Text whose equal pieces a task counts as one.
HELD_BYTES = 8_000_000
#: Pieces that are cut out of the text at once.
AT_ONCE = 20_000


def keys(data: np.ndarray, least: int) -> np.ndarray:
    """The key of the window at each place: the least of its grams' hashes."""
    n = len(data) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,)).astype(np.uint64)
    h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
    eight *= np.uint64(0xD6E8FEB86659FD93)
    h += eight[8:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    size, done = least - GRAM + 1, 1
    while 2 * done <= size:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:n], h[size - done : size - done + n])


def runs(texts: pa.Array, least: int) -> tuple[np.ndarray, ...]:
    """Data, offsets, and of each piece: its text's number, first place, number of windows, and key."""
    data, offsets = utf8(texts)
    key = keys(data, least)
    whole = np.ones(len(key), bool)  # windows that end in the text they begin in
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        whole[max(begin, end - least + 1) : end] = False
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (key[1:] != key[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | new[1:]
    start, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
    n = stop - start
    if (n > MOST_WINDOWS).any():
        parts = -(-n // MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop = np.repeat(start, parts) + nth * MOST_WINDOWS, np.repeat(stop, parts)
        n = np.minimum(stop - start, MOST_WINDOWS)
    return data, offsets, np.searchsorted(offsets, start, "right") - 1, start, n, key[start]


def shared_keys(docs: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of the keys that occur in two or more rows of docs(text), by their leading bits; and the hot keys, sorted: those of more rows
    than HOT_ROWS and than a millionth of all keys' rows (about), so a million at most."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(2, math.ceil(math.log2(1 + total / 18 / RANGE_KEYS))))
    hot = max(HOT_ROWS, total // 18 // 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> pa.RecordBatch:
            k = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            once, count = k[first], np.diff(np.append(first, len(k))).astype(np.uint32)
            at = np.searchsorted(once, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            cut = lambda a: [p.tobytes() for p in np.split(a, at)]
            return pa.RecordBatch.from_pydict({"range": np.arange(1 << bits), "keys": cut(once), "counts": cut(count)})

        for b in batches:
            for part in slices(b):
                _, _, text, _, _, key = runs(part.column("text"), least)
                by = np.lexsort((key, text))
                key, text = key[by], text[by]
                own = np.ones(len(key), bool)
                own[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                held.append(key[own])
                n += int(own.sum())
                if n >= KEYS_AT_ONCE:
                    yield dealt()
                    held, n = [], 0
        if n:
            yield dealt()

    def join(table: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        by = np.argsort(k)
        k, count = k[by], count[by]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
        k, count = k[first], np.add.reduceat(count, first) if len(first) else count
        on = np.zeros(1 << BITMAP_BITS - bits, np.uint8)
        on[((k[count > 1] << np.uint64(bits)) >> np.uint64(64 - BITMAP_BITS + bits)).astype(np.int64)] = 1
        return pa.table({"range": [table.column("range")[0].as_py()], "bitmap": [np.packbits(on).tobytes()], "hot": [k[count > hot].tobytes()]})

    parts = docs.select("text").mapInArrow(run, "range long, keys binary, counts binary")
    found = materialize(parts.groupBy("range").applyInArrow(join, "range long, bitmap binary, hot binary"), "ranges")
    out, often = np.zeros((1 << BITMAP_BITS) // 8, np.uint8), [np.zeros(0, np.uint64)]
    size = len(out) >> bits
    for r in found.toLocalIterator():  # 2**BITMAP_BITS bits, and a million keys, at most
        out[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["bitmap"], np.uint8)
        often.append(np.frombuffer(r["hot"], np.uint64))
    dropped(found)
    return out, np.sort(np.concatenate(often))


def _pieces(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, hot: np.ndarray, least: int, share: int | None = None) -> Iterator[tuple]:
    """Rows, data, and of each piece whose key is in the bitmap: its text's number, first place in the data and in the text, size,
    key, and mark (a hash of its bytes). A window of a hot key is a piece by itself, whose key is its mark."""
    for b in batches:
        for part in slices(b):
            data, offsets, text, start, n, key = runs(part.column("text"), least)
            slot = key >> np.uint64(64 - BITMAP_BITS)
            hit = bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
            if share is not None:
                hit &= key % np.uint64(SHARES) == share
            text, start, n, key = text[hit], start[hit], n[hit], key[hit]
            if not len(text):
                continue
            single = np.zeros(len(key), bool)
            if len(hot):
                single = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                times = np.where(single, n, 1)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                text, key, single = (np.repeat(x, times) for x in (text, key, single))
                start, n = np.repeat(start, times) + nth, np.where(single, 1, np.repeat(n, times))
            size = n + least - 1
            p, q = _powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * p[: len(data)], out=sums[1:])
            mark = mix((sums[start + size] - sums[start]) * q[start] + size.astype(np.uint64))
            yield part, data, text, start, start - offsets[text], size, np.where(single, mark, key).view(np.int64), mark.view(np.int64)


def _cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    whole = data[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(whole)])


def contents(docs: DataFrame, shared, least: int, share: int | None = None) -> DataFrame:
    """key, mark, low, high (the least and greatest doc_id that has it) and s BINARY of the pieces of docs(doc_id, text) in one share of
    the keys (None: all), equal pieces of a task's HELD_BYTES as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            at = np.r_[0, np.cumsum([len(h[0]) for h in held])]
            key, mark, ids, start, size = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
            start += np.repeat(at[:-1], [len(h[1]) for h in held])
            by = np.lexsort((mark, key))
            k, m = key[by], mark[by]
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
            low, high, own = np.minimum.reduceat(ids[by], first), np.maximum.reduceat(ids[by], first), by[first]
            data, k, m, start, size = np.concatenate([h[0] for h in held]), k[first], m[first], start[own], size[own]
            for i in range(0, len(own), AT_ONCE):
                part = slice(i, i + AT_ONCE)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in (k, m, low, high)), _cut_out(data, start[part], size[part])], ["key", "mark", "low", "high", "s"])

        for part, data, text, start, _, size, key, mark in _pieces(batches, *shared.value, least, share):
            held.append((data, key, mark, part.column("doc_id").to_numpy()[text], start, size))
            n += len(data)
            if n >= HELD_BYTES:
                yield from merged()
                held, n = [], 0
        if held:
            yield from merged()

    return docs.select("doc_id", "text").mapInArrow(run, "key long, mark long, low long, high long, s binary")


def places(docs: DataFrame, shared, least: int) -> DataFrame:
    """key, mark, doc_id, row, start of the pieces of docs(doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, text, _, place, _, key, mark in _pieces(batches, *shared.value, least):
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mark), part.column("doc_id").take(at), part.column("row").take(at), pa.array(place)], ["key", "mark", "doc_id", "row", "start"])

    return docs.mapInArrow(run, "key long, mark long, doc_id long, row long, start long")


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Places of a circular text of symbols (uint8) in the order of their suffixes' first `least` symbols (or more).

    Ranks are doubled: a suffix's rank and that of the suffix `done` places on make its next rank. Up to 2**21 places, two ranks and
    a place fit one number, so that plain sorting gives the order."""
    n = len(text)
    place, width = max(1, (n - 1).bit_length()), max(1, int(text.max()).bit_length())
    packed = 3 * place <= 63
    done = (63 - place * packed) // width
    key = np.zeros(n, np.int64)
    for i in range(done):
        key <<= width
        key |= np.roll(text, -i)
    while True:
        if packed:
            key <<= place
            key |= np.arange(n)
            key.sort()
            order = key & ((1 << place) - 1)
            key >>= place
        else:
            order = np.argsort(key)
            key = key[order]
        new = np.zeros(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        if done >= least or new.sum() == n - 1:
            return order
        rank = np.empty(n, np.int32 if packed else np.int64)
        rank[order] = np.cumsum(new, dtype=rank.dtype)
        if packed:
            key = rank.astype(np.int64) << place
            key |= np.roll(rank, -done)
        else:
            key = rank * n + np.roll(rank, -done)
        done *= 2


def borders(bwt: np.ndarray, least: int) -> np.ndarray:
    """Does a group of suffixes with a common prefix of `least` symbols begin here, in suffix order (and at the end)? bwt: uint8.

    Level by level: the intervals of all strings of `level` symbols that found a new border are extended by each symbol before
    them; the end of a new interval is a border with a common prefix of `level` symbols, unless a shorter one was found there."""
    n = len(bwt)
    before = np.empty(n, np.int64)
    before[np.argsort(bwt, kind="stable")] = np.arange(n)
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        size = high - low
        ends = np.cumsum(size)
        if not len(ends):
            break
        at = np.repeat(low - ends + size, size) + np.arange(ends[-1])
        own = np.repeat(np.arange(len(low)), size)
        by = np.argsort(bwt[at], kind="stable")
        symbol, own, at = bwt[at][by], own[by], at[by]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])]
        first = np.flatnonzero(new)
        low = before[at[first]]
        high = low + np.diff(np.append(first, len(at)))
        fresh = ~found[high]
        low, high = low[fresh], high[fresh]
        found[high] = True
    return found


def least_ids(pieces: list[bytes], ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its piece's number, its place there, and the least id of all pieces that hold the same window."""
    size = np.array([len(p) for p in pieces])
    first = np.r_[0, np.cumsum(size + 1)]
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    if len(present) > 255:
        raise ValueError("256 different bytes: not UTF-8")
    small = np.zeros(256, np.uint8)
    small[present] = np.arange(1, len(present) + 1)
    text = np.zeros(first[-1], np.uint8)  # 0 is the end mark
    text[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = small[flat]
    order = suffix_order(text, least)
    begin = borders(text[order - 1], least)[:-1]
    piece = np.repeat(np.arange(len(size)), size + 1)
    window = np.arange(len(text)) - first[piece] <= size[piece] - least
    value = np.where(window[order], ids[piece[order]], np.iinfo(np.int64).max)
    group = np.minimum.reduceat(value, np.flatnonzero(begin))
    out = np.empty(len(text), np.int64)
    out[order] = group[np.cumsum(begin) - 1]
    at = np.flatnonzero(window)
    return piece[at], at - first[piece[at]], out[at]


def verdicts(found: DataFrame, least: int) -> DataFrame:
    """key, mark, first, last, least_id: windows first to last (exclusive) of a piece also lie in a document least_id, smaller than the greatest
    that has the piece; from the rows of contents()."""
    names = ["key", "mark", "first", "last", "least_id"]

    def decided(t: pa.Table) -> pa.RecordBatch | None:
        """Of all rows of some keys, sorted by key and mark."""
        key, mark, low, high = (t.column(c).to_numpy() for c in ("key", "mark", "low", "high"))
        new_key = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new_key | np.r_[True, mark[1:] != mark[:-1]])
        low, high, of = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.cumsum(new_key[first]) - 1
        begin = np.flatnonzero(new_key[first])
        # keys of one document only (false hits of the bitmap) repeat nothing
        some = (np.minimum.reduceat(low, begin) < np.maximum.reduceat(high, begin))[of]
        first, low, high = first[some], low[some], high[some]
        if not len(first):
            return None
        piece, place, ids = least_ids(t.column("s").take(pa.array(first)).to_pylist(), low, least)
        on = ids < high[piece]
        piece, place, ids = piece[on], place[on], ids[on]
        if not len(piece):
            return None
        a = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1) | (ids[1:] != ids[:-1])])
        row = first[piece[a]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[row], mark[row], place[a], place[np.append(a[1:], len(piece)) - 1] + 1, ids[a])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """What is held, in blocks that end where a key does; the last key stays unless nothing follows."""
            nonlocal held
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)] if last else [])
            bytes_ = np.r_[0, np.cumsum(pc.binary_length(t.column("s")).to_numpy())]
            begin = 0
            for end in ends[np.append(np.flatnonzero(np.diff(bytes_[ends.astype(int)] // BLOCK_BYTES)), len(ends) - 1)].astype(int) if len(ends) else ():
                if end > begin and (out := decided(t.slice(begin, end - begin))) is not None:
                    yield out
                begin = max(begin, end)
            held = t.slice(begin).to_batches()

        for b in batches:
            held.append(b)
            if sum(h.nbytes for h in held) >= 2 * BLOCK_BYTES:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    return found.repartition("key").sortWithinPartitions("key", "mark").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def cut(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, spans ARRAY<STRUCT<start LONG, end LONG>> (the maximal runs of bytes that go) and kept BINARY of docs(doc_id, text)."""
    if least < 2 * GRAM:
        raise ValueError(f"least must be {2 * GRAM} or more")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    known = docs.filter("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(shared_keys(known, least))  # 40 MB at most
    shares = [materialize(verdicts(contents(known, shared, least, i), least), "verdicts") for i in range(SHARES)]
    said = reduce(DataFrame.unionByName, shares)
    gone = places(known, shared, least).join(said, ["key", "mark"]).filter("doc_id > least_id")
    gone = gone.select("row", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + (least - 1)).alias("end")).alias("x"))
    spans = materialize(gone.groupBy("row").agg(F.collect_list("x").alias("spans")), "spans")
    dropped(*shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            n, spans, kept = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("spans")):
                raw = text.encode("utf-8", "surrogatepass")
                n.append(len(raw))
                if not gone.is_valid:
                    spans.append([])
                    kept.append(raw)
                    continue
                x = gone.values
                a, e = x.field("start").to_numpy(), x.field("end").to_numpy()
                by = np.argsort(a)
                a, e = a[by], np.maximum.accumulate(e[by])
                new = np.r_[True, a[1:] > e[:-1]]
                a, e = a[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]
                spans.append([{"start": int(i), "end": int(j)} for i, j in zip(a, e)])
                kept.append(b"".join(raw[i:j] for i, j in zip([0, *e.tolist()], [*a.tolist(), len(raw)])))
            item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, item), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return docs.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
