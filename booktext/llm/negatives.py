"""Hard-negative mining by an STR-packed R-tree over integer vectors.

Packing (sort, tile, recursively): the four components of greatest spread cut the rows into slabs by quantiles of the first, ranges of the second
inside a slab (one range shuffle, whose partitions hold about a tile each) and, inside a tile, slabs and runs of the third and fourth: the leaves.
Nodes hold the least and greatest value of each component; over the leaves of a task's tiles lie further levels of FANOUT children.

An anchor's inner product with any row of a box lies, component by component, between a * low and a * high, so a box has
an interval of scores. A best-first queue opens the box with the greatest possible score that counts (the interval's end or the
score window's, whichever is less) and leaves out boxes outside the window or strictly below the k-th score found; boxes that
tie with the k-th are opened, since a smaller id may lie in them. The search is exact.

Work is dealt in cells of at most ANCHORS anchors and TILES tiles: every anchor meets every tile's boxes in some task, and only
each cell's k best rows leave it. Scores are exact integers: floats of 53 bits where the largest product sum fits, 64-bit
integers otherwise (scores beyond 64 bits are out of range). Ties go to the smaller id.

Rows with a null label, id or vector, or a null or non-finite component take no part. A shorter vector counts as filled up with
zeros. Repeated rows are rows of their own; rows with the anchor's own id are never its positives. Empty tables give empty
results; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Components of the rows of a tile, about: 4,096 rows of 64.
TILE_VALUES = 1 << 18
#: Leaves of a tile, and children of an inner node.
FANOUT = 16
#: Anchors and tiles that one cell holds at most, about; anchors whose boxes are bounded at once.
ANCHORS, TILES, AT_ONCE = 4096, 32, 256
#: Cells that one block of anchors is spread over, if there are so many tiles.
SPREAD = 16
MOST_PARTITIONS = 2000


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """n (a number for each row), vec_id, label, v ARRAY<BIGINT>: floor(scale * x) of each component of rows(vec_id, label, embedding)."""
    odd = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(True)))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return materialize(good.select(F.monotonically_increasing_id().alias("n"), F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v")), "vectors")


def matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of dim integers, short ones filled up with zeros."""
    a = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(a.offsets.to_numpy())
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def spread(rows: DataFrame, dim: int, top: int = 4) -> list[int]:
    """The components of greatest variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros(dim)
        for b in batches:
            x = matrix(b.column("v"), dim).astype(float)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim), "n": np.full(dim, n), "s": s, "q": q})

    sums = rows.select("v").mapInArrow(run, "i long, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    return [r["i"] for r in sums.orderBy(var.desc(), "i").limit(top).collect()]


def tiles(rows: DataFrame, count: int, dim: int) -> DataFrame:
    """col INT and a packed tile (rows, ids, labels, vecs BINARY, kind) for each tile of integers(); count is the number of rows."""
    size = max(FANOUT, TILE_VALUES // max(dim, 1))
    parts = max(1, min(MOST_PARTITIONS, math.ceil(count / (0.75 * size))))
    dims = spread(rows, dim) if dim else [0]
    dims = (dims * 4)[:4]
    at = lambda i: F.coalesce(F.get("v", F.lit(dims[i])), F.lit(0))
    slabs = math.ceil(math.sqrt(parts))
    cuts = sorted(set(rows.select(at(0).cast("double").alias("x")).approxQuantile("x", [i / slabs for i in range(1, slabs)], 0.2 / slabs))) if slabs > 1 else []
    slab = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < at(0))) if cuts else F.lit(0)
    order = ["slab", "x", "n"]
    dealt = rows.select(slab.alias("slab"), at(1).alias("x"), "n", "vec_id", "label", "v").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    columns = max(min(parts, SPREAD), math.ceil(parts / TILES))

    def packed(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, col: int) -> pa.RecordBatch:
        runs, side = np.arange(len(v)), math.isqrt(FANOUT)
        if dim:  # slabs by the third component, each in order of the fourth
            runs = np.argsort(v[:, dims[2]], kind="stable")
            runs = np.concatenate([s[np.argsort(v[s, dims[3]], kind="stable")] for s in np.array_split(runs, side)])
        v = v[runs]
        low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
        kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        return pa.RecordBatch.from_pydict({
            "col": pa.array([col], pa.int32()), "rows": pa.array([len(v)], pa.int32()), "kind": [kind],
            "ids": [ids[runs].tobytes()], "labels": [labels[runs].tobytes()], "vecs": [v.astype(kind).tobytes()],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seq = [], 0, 0
        for b in batches:
            part = int(b.column("part")[0].as_py()) if b.num_rows else 0
            while b.num_rows:
                take = b.slice(0, size - n)
                held.append((take.column("vec_id").to_numpy(), take.column("label").to_numpy(), matrix(take.column("v"), dim)))
                n, b = n + take.num_rows, b.slice(take.num_rows)
                if n == size:
                    yield packed(*map(np.concatenate, zip(*held)), (part + seq) % columns)
                    held, n, seq = [], 0, seq + 1
        if n:
            yield packed(*map(np.concatenate, zip(*held)), (part + seq) % columns)

    out = dealt.select("vec_id", "label", "v", F.spark_partition_id().alias("part")).mapInArrow(run, "col int, rows int, kind string, ids binary, labels binary, vecs binary")
    return materialize(out, "tiles")


class Tree:
    """An R-tree over packed tiles: rows in leaf order, and for each level (leaves first) its boxes and where its children begin."""

    def __init__(self, table: pa.Table, dim: int, kind: type) -> None:
        rows = table.column("rows").to_pylist()
        self.ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        self.labels = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("labels").to_pylist()])
        self.v = np.concatenate([np.frombuffer(x, k).reshape(n, dim) for x, k, n in zip(table.column("vecs").to_pylist(), table.column("kind").to_pylist(), rows)]).astype(kind)
        first = np.concatenate([[0], np.cumsum(rows)])
        starts = np.concatenate([b + np.unique(np.linspace(0, n, FANOUT, endpoint=False).astype(int)) for b, n in zip(first, rows)])
        self.levels = []
        low, high = np.minimum.reduceat(self.v, starts), np.maximum.reduceat(self.v, starts)
        children = np.append(starts, len(self.v))
        while True:
            self.levels.append((low, high, children))
            if len(low) <= FANOUT:
                break
            starts = np.arange(0, len(low), FANOUT)
            children = np.append(starts, len(low))
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)

    def bounds(self, a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and greatest possible score of each anchor (a row) with each box, level by level."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high, _ in self.levels]

    def best(self, k: int, anchor: np.ndarray, bounds: list, wanted: np.ndarray, seen: dict, least: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best wanted rows whose scores lie in the window, by a best-first queue. bounds are one anchor's; seen
        keeps the scores of leaves between searches."""
        top = len(self.levels) - 1

        def key(level: int, i: int) -> float | None:
            """The greatest score of a box that counts, or None if the box is outside the window."""
            low, high = bounds[level][0][i], bounds[level][1][i]
            if (least is not None and high < least) or (most is not None and low > most):
                return None
            return high if most is None or high < most else most

        queue = [(-u, top, i) for i in range(len(self.levels[top][0])) if (u := key(top, i)) is not None]
        heapify(queue)
        scores, ids, kth = np.zeros(0, self.v.dtype), np.zeros(0, np.int64), None
        while queue:
            u, level, i = heappop(queue)
            if kth is not None and -u < kth:
                break
            a, b = self.levels[level][2][i], self.levels[level][2][i + 1]
            if level:
                for j in range(a, b):
                    u = key(level - 1, j)
                    if u is not None and (kth is None or u >= kth):
                        heappush(queue, (-u, level - 1, j))
                continue
            if i not in seen:
                seen[i] = self.v[a:b] @ anchor
            s = seen[i]
            ok = wanted[a:b]
            if least is not None:
                ok = ok & (s >= least)
            if most is not None:
                ok = ok & (s <= most)
            if kth is not None:
                ok = ok & (s >= kth)
            if not ok.any():
                continue
            scores, ids = np.concatenate([scores, s[ok]]), np.concatenate([ids, self.ids[a:b][ok]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            if len(scores) == k:
                kth = scores[-1]
        return scores, ids


def _cells(anchors: DataFrame, packed: DataFrame, dim: int, kind: type, find, schema: str, blocks: int, columns: int) -> DataFrame:
    """find(tree, anchors) of every block of anchors(n, vec_id, label, v, ...) with every column of tiles."""
    a = anchors.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    t = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = min(MOST_PARTITIONS, 4 * blocks * columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in names})
        rows = find(Tree(right, dim, kind), left)
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(names, zip(*rows))} if rows else {k: pa.array([], pa.int64()) for k in names})

    names = [c.split()[0] for c in schema.split(", ")]
    return a.repartition(parts, "block", "col").groupBy("block", "col").cogroup(t.repartition(parts, "block", "col").groupBy("block", "col")).applyInArrow(run, schema)


def _ranked(found: DataFrame, by: list[str], score: str, ident: str, k: int, name: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ident))
    return found.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor of integers() and each of its best rows
    of the same label, the best rows of other labels whose score is between least and most per cent of the positive's."""
    facts = rows.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.count(F.when(is_anchor, 1)).alias("anchors"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"),
    ).first()
    dim, blocks = facts["dim"], max(1, math.ceil(facts["anchors"] / ANCHORS))
    # the sums of products stay exact in a float below 2**53
    kind = np.float64 if max(dim, 1) * (facts["top"] or 0) ** 2 < 1 << 53 else np.int64
    packed = tiles(rows, facts["n"], dim)
    columns = packed.agg(F.coalesce(F.max("col"), F.lit(0))).first()[0] + 1
    asked = rows.filter(is_anchor)

    def near(tree: Tree, table: pa.Table) -> list[tuple]:
        out = []
        for at, a, labels, ids in _anchors(table):
            bounds = tree.bounds(a.astype(kind))
            for i, anchor in enumerate(a.astype(kind)):
                mine_ = [(lo[i], hi[i]) for lo, hi in bounds]
                wanted = (tree.labels == labels[i]) & (tree.ids != ids[i])
                scores, found = tree.best(positives, anchor, mine_, wanted, {})
                out += [(at[i], ids[i], int(j), int(s)) for s, j in zip(scores, found)]
        return out

    def _anchors(table: pa.Table) -> Iterator[tuple]:
        for b in range(0, table.num_rows, AT_ONCE):
            part = table.slice(b, AT_ONCE)
            yield part.column("n").to_pylist(), matrix(part.column("v"), dim), part.column("label").to_pylist(), part.column("vec_id").to_pylist()

    found = _cells(asked, packed, dim, kind, near, "n long, anchor_id long, positive_id long, positive_score long", blocks, columns)
    best = materialize(_ranked(found, ["n"], "positive_score", "positive_id", positives, "place"), "positives")
    windows = best.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("windows"))
    asked = asked.join(windows, "n")

    def hard(tree: Tree, table: pa.Table) -> list[tuple]:
        out, at_row = [], 0
        for at, a, labels, ids in _anchors(table):
            wins = table.slice(at_row, len(at)).column("windows").to_pylist()
            at_row += len(at)
            bounds = tree.bounds(a.astype(kind))
            for i, anchor in enumerate(a.astype(kind)):
                mine_ = [(lo[i], hi[i]) for lo, hi in bounds]
                wanted, seen, done = tree.labels != labels[i], {}, {}
                for w in wins[i]:
                    ps = w["positive_score"]
                    low, high = -(-least * ps // 100), most * ps // 100
                    if low > high:
                        continue
                    if ps not in done:
                        done[ps] = tree.best(negatives, anchor, mine_, wanted, seen, low, high)
                    out += [(at[i], ids[i], w["place"], w["positive_id"], ps, int(j), int(s)) for s, j in zip(*done[ps])]
        return out

    schema = "n long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _cells(asked, packed, dim, kind, hard, schema, blocks, columns)
    out = _ranked(found, ["n", "place"], "negative_score", "negative_id", negatives, "rank")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
