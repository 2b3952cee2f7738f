"""op13: the query and its parts against every 50-byte string held in a dictionary."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from booktext.llm import queries, repeats


def brute(rows: list[tuple], least: int = 50) -> list[tuple]:
    raw = [(d, (t or "").encode()) for d, t in rows]
    first: dict[bytes, int] = {}
    for d, t in raw:
        if d is not None:
            for i in range(len(t) - least + 1):
                first[t[i : i + least]] = min(d, first.get(t[i : i + least], d))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        if d is not None:
            for i in range(len(t) - least + 1):
                if first[t[i : i + least]] < d:
                    gone[i : i + least] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus() -> list[tuple]:
    rng = random.Random(13)
    words = ["ab", "the", "über", "né", "x", "passage", "\n", "日本", "of", "z9"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = [text(30) for _ in range(4)]
    rows = [(i, text(rng.randint(0, 40)) + rng.choice(shared)[: rng.choice([45, 49, 50, 51, 200])] + text(rng.randint(0, 40))) for i in range(60)]
    rows += [(100, rows[3][1]), (-5, rows[7][1][:120]), (101, "a" * 700), (102, "b" + "a" * 2500), (103, "aB" * 60), (104, "xaB" * 60 + "aB" * 40)]
    rows += [(200, None), (201, ""), (None, rows[3][1]), (202, "short"), (203, shared[0][:50]), (203, rows[4][1]), (100, rows[3][1]), (204, shared[1] * 40)]
    return rows


@pytest.mark.parametrize("block, hot, windows", [(250_000, 200_000, 1_000), (300, 200_000, 20), (2_000, 3, 1_000)])
def test_query_equals_a_dictionary(spark, tmp_path, monkeypatch, block, hot, windows):
    for name, value in (("BLOCK_BYTES", block), ("HOT_ROWS", hot), ("MOST_WINDOWS", windows)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, row int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_repeats(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_table_of_the_driver(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_repeats(spark, sf).collect()), key=str) == brute(rows)


def test_suffixes_of_long_texts(monkeypatch):
    """Texts whose ranks do not fit one number are sorted in the other way, with the same order of prefixes."""
    rng = np.random.default_rng(5)
    text = np.r_[np.tile(rng.integers(1, 200, 700_000), 3), 0].astype(np.uint8)
    assert len(text) > 1 << 21
    order = repeats.suffix_order(text, 50)
    twice = np.r_[text, text[:60]].tobytes()
    at = np.r_[np.arange(0, len(order) - 1, 997), np.arange(3000)]
    assert all(twice[order[i] : order[i] + 50] <= twice[order[i + 1] : order[i + 1] + 50] for i in at) and len(np.unique(order)) == len(text)


def test_borders_are_where_common_prefixes_are_short():
    rng = np.random.default_rng(2)
    for n, letters, least in ((40, 2, 5), (200, 3, 8), (500, 4, 6), (300, 1, 9)):
        text = np.r_[rng.integers(1, letters + 1, n), 0].astype(np.uint8)
        order = repeats.suffix_order(text, least)
        twice = np.r_[text, text, text]
        prefix = [tuple(twice[i : i + least]) for i in order]
        assert prefix == sorted(prefix)
        want = [True] + [a != b for a, b in zip(prefix, prefix[1:])] + [True]
        assert repeats.borders(text[order - 1], least).tolist() == want


def test_equal_windows_have_equal_keys():
    rng = random.Random(1)
    same = "".join(rng.choices("abcd ", k=50))
    texts = ["".join(rng.choices("abcd ", k=k)) + same + "tail" * k for k in (0, 3, 50, 77)]
    found = []
    data, offsets, text, start, n, key = repeats.runs(pa.array(texts), 50)
    for i, t in enumerate(texts):
        at = offsets[i] + t.index(same)
        found.append(key[np.searchsorted(start, at, "right") - 1])
    assert len(set(found)) == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_repeats(spark, str(tmp_path)).collect() == []
