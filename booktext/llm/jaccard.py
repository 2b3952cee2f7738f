"""N-gram Jaccard join by a grouped prefix join.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents with equal sets are one class. Elements
are ordered rare first, by a count sketch of all documents' shingles (any fixed order is valid; this one keeps
passages that many documents share out of the prefixes). Classes with equal prefixes and sizes are one group. Groups
that share a prefix element are candidates, filtered by size, by the element's places and by parity bitmaps of
the sets (necessary conditions, so no link is lost), then expanded and verified with whole sets.

Candidates never grow with the square of a family of near copies: in each round every group is only paired with
the most central group under each of its prefix elements; verified links are made components; a pair in one
component needs no check. After the pivot rounds, the pairs of classes that still share an element across
components are compared by bitmap inside the join, so no component is missed; an element of many classes is cut into tiles
for that.

Whole sets are made only of the classes in a round's remaining pairs, from one text of each. The list of those texts is
broadcast if it has at most `BROADCAST_ROWS` rows and joined by shuffle otherwise.

Hashes of 64 bits stand for shingles, sets and rows; at 10**9 classes the chance of any false match is about 3 %.
Nulls: null and empty texts have empty sets and link with nothing; rows with a null id are linked as all others, and null
is the component of rows that have no other id to name it. Repeated rows are in one class. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, dropped, give_back, giving_back, materialize, mix, released, shingles_of, slices
from .components import connected_components

K = 5
SIMILARITY = 80
SKETCH_BITS = 20
SKETCH_CHUNK = 4096
PIVOT_ROUNDS = 2
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 16
BITS = [f"b{i}" for i in range(BITMAP_WORDS)]
#: Words of the bitmap folded together, which the postings of the last round carry.
FOLDED = [f"f{i}" for i in range(4)]
#: Classes of one element that one tile of the last round holds, about.
TILE = 512
#: Rows (two longs) that a broadcast may have.
BROADCAST_ROWS = 2_000_000


def sets(batches: Iterator[pa.RecordBatch], k: int = K) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the distinct shingle hashes of all their texts (A-Z lower-cased) in order of text and hash, and where each text's begin."""
    for batch in batches:
        for part in slices(batch):
            v, of = shingles_of(Words(part.column("text"), lower=True), k)
            at = np.argsort(v)
            at = at[np.argsort(of[at].astype(np.uint16) if part.num_rows < 1 << 16 else of[at], kind="stable")]
            v, of = v[at], of[at]
            new = np.ones(len(v), dtype=bool)
            new[1:] = (v[1:] != v[:-1]) | (of[1:] != of[:-1])
            v, of = v[new], of[new]
            yield part, v, np.searchsorted(of, np.arange(part.num_rows + 1))


def sketch(docs: DataFrame, k: int = K, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many of all documents' shingles fall in each of 2**bits slots; its size does not depend on the data."""
    n = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch):
                v, _ = shingles_of(Words(part.column("text"), lower=True), k)
                np.add.at(total, (v >> np.uint64(64 - bits)).astype(np.int64), 1)
        for at in range(0, n, SKETCH_CHUNK):
            part = total[at : at + SKETCH_CHUNK]
            if part.any():
                kind = np.min_scalar_type(int(part.max()))
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([kind.itemsize], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], ["at", "width", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(SKETCH_CHUNK, n), np.int64)
        for width, counts in zip(rows["width"], rows["counts"]):
            total += np.frombuffer(counts, dtype=f"u{width}").astype(np.int64)
        return pd.DataFrame({"at": rows["at"][:1], "counts": [total.tobytes()]})

    parts = docs.select("text").mapInArrow(giving_back(run), "at long, width int, counts binary")
    out = np.zeros(n, np.int64)
    for row in parts.groupBy("at").applyInPandas(add, "at long, counts binary").collect():  # n slots
        out[row["at"] : row["at"] + SKETCH_CHUNK] = np.frombuffer(row["counts"], np.int64)
    return out


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i + 1]], modulo 2**64."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def class_marks(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set; 0 of an empty one."""
    n = np.diff(edges)
    mark = mix(_sums(mix(v), edges) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return np.where(n > 0, mark, 0)


def parities(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A bitmap of each set, whose bit i is the parity of the elements that fall on it: two sets' bitmaps differ in at most as
    many bits as the sets differ in elements."""
    n, width = len(edges) - 1, 64 * BITMAP_WORDS
    of = np.repeat(np.arange(n), np.diff(edges))
    odd = np.bincount(of * width + (v & np.uint64(width - 1)).astype(np.int64), minlength=n * width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, BITMAP_WORDS)


def prefixes(docs: DataFrame, counts: np.ndarray, similarity: int = SIMILARITY, k: int = K, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, row, n, cls, grp, prefix ARRAY<INT> and the bitmap's words of docs(doc_id, row, text): grp is the group of equal
    prefix and size; its leading byte says how common the prefix is, so the greatest group of an element is its most
    central one. Elements are cut to 32 bits: a false match is found out by verifying."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2**bits slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for part, v, edges in sets(batches, k):
            n = np.diff(edges)
            of = np.repeat(np.arange(len(n)), n)
            c = freq[(v >> np.uint64(64 - bits)).astype(np.int64)]
            at = np.lexsort((c, of))  # rare first, equals by hash
            keep = np.where(n > 0, n - (n * similarity + 99) // 100 + 1, 0)
            at = at[np.arange(len(v)) - edges[of] < keep[of]]
            p, ends = v[at], np.r_[0, np.cumsum(keep)]
            common = np.minimum(126, 4 * np.log2(1 + _sums(c[at], ends) / np.maximum(keep, 1))).astype(np.uint64)
            h = mix(_sums(mix(p + np.uint64(1)), ends) + n.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            grp = np.where(n > 0, common << np.uint64(56) | h >> np.uint64(8), 0).astype(np.uint64).view(np.int64)
            words = parities(v, edges)
            pre = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((mix(p) >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            arrays = [part.column("doc_id"), part.column("row"), pa.array(n.astype(np.int64)), pa.array(class_marks(v, edges)), pa.array(grp), pre]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(words[:, i].copy()) for i in range(BITMAP_WORDS)], ["doc_id", "row", "n", "cls", "grp", "prefix", *BITS])

    ident = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(giving_back(run), f"doc_id {ident}, row long, n long, cls long, grp long, prefix array<int>" + "".join(f", {b} long" for b in BITS))


def set_table(docs: DataFrame, wanted: DataFrame, k: int = K) -> DataFrame:
    """cls and items BINARY (sorted hashes) of the classes in wanted(row, cls), one row each; sets are made anew from
    the texts of the rows in wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, edges in sets(batches, k):
            ends = pa.array((8 * edges).astype(np.int32)).buffers()[1]
            items = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, ends, pa.py_buffer(v.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("cls"), items], ["cls", "items"])

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select("row", "text").join(F.broadcast(wanted) if few else wanted, "row").select("cls", "text")
    return rows.mapInArrow(giving_back(run), "cls long, items binary").dropDuplicates(["cls"])


def verify(pairs: DataFrame, items: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs(a, b) of classes whose sets reach the similarity."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= similarity * (len(p) + len(q) - both))
        give_back()
        return pd.Series(out, dtype=bool)

    left = items.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = items.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(linked("x", "y")).select("a", "b")


def link(docs: DataFrame, similarity: int = SIMILARITY, k: int = K, rounds: int = PIVOT_ROUNDS, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = materialize(prefixes(docs, sketch(docs, k, bits), similarity, k, bits), "jac-rows")
    some = rows.filter("n > 0")
    first = [F.first(c).alias(c) for c in ["n", "grp", *BITS]]
    classes = materialize(some.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), *first), "jac-classes")
    released(classes)
    groups = classes.groupBy("grp").agg(F.min("cls").alias("head"), F.first("n").alias("n"), F.count("*").alias("members"))
    # all members of a group have its prefix
    each = some.select("grp", "prefix").dropDuplicates(["grp"]).select("grp", F.posexplode("prefix").alias("pos", "e"))
    # written before the postings are dealt out again, so that only one of the two shuffles is on disk at a time
    hot = materialize(each.groupBy("e").count().filter("count > 1").select("e"), "jac-hot")
    # the members of a group of several classes also meet under an element of its own
    own = groups.filter("members > 1").select("grp", F.lit(0).alias("pos"), F.hash("grp").alias("e"))
    posts = each.join(hot, "e").select("grp", "pos", "e").unionByName(own)
    posts = materialize(posts.join(groups.select("grp", "n", "head"), "grp"), "jac-posts")
    dropped(hot)
    released(posts)
    near = posts.select("grp").distinct()
    members = materialize(classes.join(near, "grp", "left_semi").select("grp", "cls", "n", "row", *BITS), "jac-members")
    asked = members.select("grp", "cls", "n")
    tried = comp = None
    for turn in range(rounds + 1):
        # a round is written in steps, each a plan of a few joins: all that a plan's joins need lies on the driver while it runs
        if turn == 0:
            met = materialize(_ordered(_central(posts, groups, asked, similarity)), "jac-met")
        else:
            mixed = _mixed(posts, asked, comp)
            if mixed.isEmpty():  # nor is there any later
                dropped(mixed)
                break
            across = released(materialize(_labelled(posts, members, comp, turn == rounds).join(mixed, "e"), "jac-across"))
            met = _ordered(_across(across, turn, turn == rounds, similarity)).join(tried, ["a", "b"], "left_anti")
            met = materialize(met, "jac-met")
            dropped(mixed, across)
        released(met)
        cand = released(materialize(_alike_pairs(met, members, similarity), "jac-pairs"))
        dropped(met)
        if comp is not None and cand.isEmpty():  # nothing to verify or merge
            continue
        tried = cand if tried is None else tried.unionByName(cand)
        used = cand.select(F.col("a").alias("cls")).unionByName(cand.select(F.col("b").alias("cls"))).distinct()
        wanted = materialize(members.select("row", "cls").join(used, "cls", "left_semi"), "jac-wanted")
        good = released(materialize(verify(cand, set_table(docs, wanted, k), similarity), "jac-links"))
        dropped(wanted)
        comp = _merged(comp, good, asked)
        released(comp)
    named = classes.join(comp, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "doc_id")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = released(materialize(named.select("cls", "root").join(ids, "root").select("cls", "component_id"), "jac-named"))
    out = rows.select("doc_id", "n", "cls").join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _central(posts: DataFrame, groups: DataFrame, asked: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of the first round: members of each group with the head of the most central group under each of its
    elements, and with their own head."""
    best = posts.groupBy("e").agg(F.max(F.struct("grp", "head", "n", "pos")).alias("top"))
    c = posts.join(best, "e").filter(F.col("grp") != F.col("top")["grp"])
    c = c.select("grp", "n", "pos", F.col("top")["head"].alias("b"), F.col("top")["n"].alias("m"), F.col("top")["pos"].alias("at"))
    c = c.filter(_near(similarity)).select("grp", "b").unionByName(groups.filter("members > 1").select("grp", F.col("head").alias("b")))
    return c.distinct().join(asked.select("grp", "cls"), "grp").filter("cls <> b").select(F.col("cls").alias("a"), "b")


def _alike_pairs(pairs: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """The pairs(a, b) that sizes and bitmaps allow."""
    left = members.select(F.col("cls").alias("a"), "n", *BITS)
    right = members.select(F.col("cls").alias("b"), F.col("n").alias("m"), *[F.col(c).alias(f"o{c}") for c in BITS])
    return pairs.join(left, "a").join(right, "b").filter(_alike(similarity)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """The different pairs, the lesser class first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed(posts: DataFrame, asked: DataFrame, comp: DataFrame) -> DataFrame:
    """The elements e that classes of different components share, and the tiles that each is cut into; written."""
    roots = asked.select("grp", "cls").join(comp, "cls").select("grp", "root")
    mixed = posts.select("e", "grp").join(roots, "grp").groupBy("e").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("df"))
    return released(materialize(mixed.filter("r1 <> r2").select("e", F.ceil(F.col("df") / TILE).cast("int").alias("tiles")), "jac-mixed"))


def _labelled(posts: DataFrame, members: DataFrame, comp: DataFrame, last: bool) -> DataFrame:
    """Postings of classes with their component; for the last round with their folded bitmap."""
    folded = [reduce(Column.bitwiseXOR, [F.col(c) for c in BITS[i :: len(FOLDED)]]).alias(f) for i, f in enumerate(FOLDED)] if last else []
    labelled = members.join(comp, "cls").select("grp", "cls", "n", "root", *folded)
    return posts.select("e", "pos", "grp").join(labelled, "grp").drop("grp")


def _across(q: DataFrame, turn: int, last: bool, similarity: int) -> DataFrame:
    """Pairs (a, b) of classes under one element and in different components: each with a pivot, or in the last round all.
    q: the labelled postings of the mixed elements."""
    if last:
        left = q.withColumn("tile", F.pmod(F.hash("cls"), "tiles"))
        other = [F.col(c).alias(f"o{c}") for c in FOLDED]
        right = q.select("e", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("cls").alias("b"), F.col("root").alias("rb"), F.col("n").alias("m"), F.col("pos").alias("at"), *other)
        cand = left.join(right, ["e", "tile"]).filter((F.col("root") < F.col("rb")) & (F.col("cls") != F.col("b")) & _near(similarity) & _alike(similarity, FOLDED))
        return cand.select(F.col("cls").alias("a"), "b")
    # another pivot each round: the class with the greatest hash for this round under each element
    best = q.groupBy("e").agg(F.max(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("b"), F.col("root").alias("rb"), F.col("n").alias("m"), F.col("pos").alias("at"))).alias("t"))
    cand = q.join(best.select("e", "t.b", "t.rb", "t.m", "t.at"), "e").filter("root <> rb").filter(_near(similarity))
    return cand.select(F.col("cls").alias("a"), "b")


def _merged(comp: DataFrame | None, good: DataFrame, asked: DataFrame) -> DataFrame:
    """comp(cls, root) after the links good(a, b): only roots that a new link names are joined anew."""
    if comp is None:
        found = connected_components(good, "jac-cc")
        return materialize(asked.join(found, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root")), "jac-comp")
    if good.isEmpty():
        return comp
    ends = good.join(comp.select(F.col("cls").alias("a"), F.col("root").alias("u")), "a").join(comp.select(F.col("cls").alias("b"), F.col("root").alias("v")), "b")
    found = connected_components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")), "jac-cc")
    found = found.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return materialize(comp.join(found, "root", "left").select("cls", F.coalesce("new", "root").alias("root")), "jac-comp")


def _near(similarity: int) -> Column:
    """Can sets of n and m elements that share the one at places pos and at be a link? Their overlap must reach
    similarity / (100 + similarity) of n + m, so some shared element lies in both prefixes that this leaves."""
    least = F.ceil(F.lit(similarity) * (F.col("n") + F.col("m")) / F.lit(100 + similarity))
    sizes = (F.col("n") * 100 >= F.col("m") * similarity) & (F.col("m") * 100 >= F.col("n") * similarity)
    return sizes & (F.col("pos") <= F.col("n") - least) & (F.col("at") <= F.col("m") - least)


def _alike(similarity: int, bits: list[str] = BITS) -> Column:
    """Do the bitmaps allow sets of n and m elements to be a link? They may differ in n + m - 2 * overlap elements."""
    least = F.ceil(F.lit(similarity) * (F.col("n") + F.col("m")) / F.lit(100 + similarity))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in bits), F.lit(0))
    return apart <= F.col("n") + F.col("m") - 2 * least
