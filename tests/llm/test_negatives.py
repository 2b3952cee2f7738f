"""op12: the mined rows against every pair scored in Python; the tree's boxes and pruning."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from booktext.llm import negatives, queries


def brute(rows: list[tuple], k: int = 5, m: int = 10) -> list[tuple]:
    good = []
    for vec, label, x in rows:
        if vec is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        good.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    for i, (a, la, va) in enumerate(good):
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), r, lr) for j, (r, lr, v) in enumerate(good) if j != i)
        for s, p, _ in [t for t in scored if t[2] == la and t[1] != a][:k]:
            hard = [(n, t) for n, t, lt in scored if lt != la and 30 * -s <= 100 * -n <= 90 * -s][:m]
            out += [(a, p, rank, t, -s, -n) for rank, (n, t) in enumerate(hard, 1)]
    return sorted(out)


def table_of(spark, path, rows):
    schema = "vec_id long, label int, embedding array<float>, rank int, v string"
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3).write.parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("scale", [1.0, 4_000_000.0])
def test_query_equals_all_pairs(spark, tmp_path, monkeypatch, scale):
    """Many small tiles, ties, repeated rows and ids, bad rows, short and empty vectors; the greater scale needs 64-bit integers."""
    monkeypatch.setattr(negatives, "TILE_VALUES", 16 * 6)
    rng = random.Random(int(scale))
    value = lambda: rng.choice([0.5, 0.25, 1.0, -0.5, 0.75, rng.random()]) * scale
    rows = [(i, rng.randrange(4), [value() for _ in range(6)]) for i in range(420)]
    rows += [(100, 1, rows[7][2]), (rows[5][0], 2, rows[5][2]), rows[9], rows[9], rows[200]]
    rows += [(i, 2, [0.5 * scale] * 6) for i in range(1000, 1060)]
    rows += [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (600, 1, None), (700, 1, [1.0, None] * 3), (800, 1, [float("nan")] * 6), (900, 2, [float("inf")] * 6)]
    rows += [(1200, 2, [0.75 * scale, 0.5 * scale]), (1300, 2, []), (1301, 2, [scale])]
    rows = [(i, label, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, label, x in rows]
    table_of(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in queries.op12_negatives(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_empty_table_and_no_anchor(spark, tmp_path):
    table_of(spark, tmp_path / "a", [])
    table_of(spark, tmp_path / "b", [(1, 2, [1.0, 2.0]), (2, 3, [1.0, 2.0])])
    table_of(spark, tmp_path / "c", [(0, 2, []), (2, 3, [])])
    for name in "abc":
        assert queries.op12_negatives(spark, str(tmp_path / name)).collect() == []


def packed(v: np.ndarray, labels: np.ndarray) -> pa.Table:
    ids = np.arange(len(v))
    return pa.table({"rows": [len(v)], "kind": ["i8"], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vecs": [v.astype(np.int64).tobytes()]})


def test_boxes_hold_their_rows_and_prune(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (40, 8))
    v = np.sort(np.repeat(centres, 25, axis=0) + rng.integers(-3, 4, (1000, 8)), axis=0)
    tree = negatives.Tree(packed(v, np.zeros(1000, np.int64)), 8, np.float64)
    a = rng.integers(-200, 200, (5, 8)).astype(float)
    for (low, high), (_, _, children) in zip(tree.bounds(a)[:1], tree.levels[:1]):
        s = a @ tree.v.T
        for i in range(len(children) - 1):
            part = s[:, children[i] : children[i + 1]]
            assert (part >= low[:, [i]]).all() and (part <= high[:, [i]]).all()
    bounds = tree.bounds(a)
    for i in range(5):
        seen: dict = {}
        scores, ids = tree.best(3, a[i], [(lo[i], hi[i]) for lo, hi in bounds], np.ones(1000, bool), seen)
        want = sorted((-x, j) for j, x in enumerate(v @ a[i]))[:3]
        assert [(-s, j) for s, j in zip(scores, ids)] == want
        assert len(seen) < len(tree.levels[0][0])  # some leaves were never opened
