"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the splitting pattern) is encoded as the product of its halves. Two
encoded neighbours are joined by encoding anew a window of tokens round their boundary, which
grows until the token kept on either side provably stays: a sequence of tokens is the encoding
of its bytes exactly when every pair of neighbours encodes to itself, so the join is done as
soon as the pairs at both edges of the window do. Joining is associative, which makes the whole
text a tree product; pieces of a text are joined by plain concatenation, since no merge crosses
a match. Decoding concatenates byte strings up a tree over all of a text's tokens.

Nulls and empty texts have no tokens. Repeated rows are encoded alike. Extra columns are kept
beside the new ones; a clash of names raises ValueError when the plan is built.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

#: Entries that each of a worker's two token caches holds before it is emptied (about 200 bytes each).
CACHE = 100_000
#: Bytes of distinct pieces and their ids that a worker keeps; a piece longer than PIECE_BYTES is not kept.
PIECES_BYTES = 48_000_000
PIECE_BYTES = 256
#: The longest bytes whose ids are kept as parts of pieces.
SPAN_BYTES = 8
#: The rank of a pair that is no token.
NONE = 1 << 60
#: Byte strings that a node of the decoding tree concatenates.
FAN = 64


class Pieces(dict):
    """piece -> its ids in decimal, joined by commas; made when first asked for. A long piece is made but not kept. Those in use
    before turn() are taken over when asked for again, the others go at the turn after it."""

    def __init__(self, made: Callable[[bytes], tuple[int, ...]]) -> None:
        self.made, self.held, self.old = made, 0, {}

    def __missing__(self, piece: str) -> str:
        found = self.old.get(piece)
        if found is None:
            found = ",".join(map(str, self.made(piece.encode())))
        if len(piece) <= PIECE_BYTES:
            self[piece] = found
            self.held += 220 + len(piece) + len(found)
        return found

    def turn(self) -> None:
        self.old, self.held = dict(self), 0
        super().clear()

    def clear(self) -> None:
        self.old, self.held = {}, 0
        super().clear()


class TreeBpe:
    """Encoder and decoder over mergeable ranks. Bounded caches; otherwise stateless."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self._spans: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self._pieces = Pieces(self.piece)
        self._text_of = {str(i): b for b, i in ranks.items()}

    def _merge(self, span: bytes) -> tuple[int, ...]:
        """The lowest-ranked pair of neighbours merges first, the leftmost of equals."""
        if len(span) > 64:
            return self._merge_long(span)
        ranks, parts = self.ranks, [span[i : i + 1] for i in range(len(span))]
        order = [ranks.get(span[i : i + 2], NONE) for i in range(len(span) - 1)]
        while order and (best := min(order)) != NONE:
            at = order.index(best)
            parts[at : at + 2] = [both := parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = ranks.get(parts[at - 1] + both, NONE)
            if at < len(order):
                order[at] = ranks.get(both + parts[at + 1], NONE)
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, span: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs, for the rare wide window: n log n."""
        ranks, n = self.ranks, len(span)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(span[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = stop[i]
            if not j or j >= n or stop[j] != end:
                continue
            stop[i], stop[j] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(span[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(span[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[span[i : stop[i]]])
            i = stop[i]
        return tuple(out)

    def _short(self, span: bytes) -> tuple[int, ...]:
        found = self._spans.get(span)
        if found is None:
            if len(self._spans) >= CACHE:
                self._spans.clear()
            found = self._spans[span] = self._merge(span)
        return found

    def _pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two neighbouring tokens' bytes; (a, b) itself if they stay."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            found = self._pairs[a, b] = self._merge(self.bytes_of[a] + self.bytes_of[b])
        return found

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the concatenation, from the encodings of its two sides."""
        if not a or not b:
            return a or b
        left = right = 1
        middle = self._pair(a[-1], b[0])
        if middle == (a[-1], b[0]):
            return a + b
        while True:
            before, after = a[: len(a) - left], b[right:]
            left_ok = not before or self._pair(before[-1], middle[0]) == (before[-1], middle[0])
            right_ok = not after or self._pair(middle[-1], after[0]) == (middle[-1], after[0])
            if left_ok and right_ok:
                return before + middle + after
            left, right = min(left * (2 - left_ok), len(a)), min(right * (2 - right_ok), len(b))
            window = b"".join(map(self.bytes_of.__getitem__, a[len(a) - left :] + b[:right]))
            middle = self._short(window) if len(window) <= 32 else self._merge(window)

    def piece(self, span: bytes) -> tuple[int, ...]:
        """A whole piece: halves encoded recursively, then joined."""
        spans, half = self._spans, len(span) // 2
        found = spans.get(span)
        if found is not None:
            return found
        whole = self.ranks.get(span)
        if whole is not None:
            found = (whole,)
        elif len(span) <= 3:
            return self._short(span)
        else:
            a, b = span[:half], span[half:]
            found = self.join(spans.get(a) or self.piece(a), spans.get(b) or self.piece(b))
        if len(span) <= SPAN_BYTES:
            if len(self._spans) >= CACHE:
                self._spans.clear()
            self._spans[span] = found
        return found

    def encode_joined(self, text: str) -> tuple[str, int]:
        """Ids of the text joined by commas, and their number."""
        if not text:
            return "", 0
        if 2 * self._pieces.held > PIECES_BYTES:
            self._pieces.turn()
        joined = ",".join(map(self._pieces.__getitem__, self.split.findall(text)))
        return joined, joined.count(",") + 1

    def forget(self) -> None:
        """Empty the caches of text at the end of a task; the tokens' pairs serve the next one."""
        self._spans.clear()
        self._pieces.clear()

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' bytes, concatenated up the tree."""
        return up_the_tree(list(map(self.bytes_of.__getitem__, ids)))

    def decode_joined(self, joined: str) -> bytes:
        """The same for ids in decimal, joined by commas."""
        return up_the_tree(list(map(self._text_of.__getitem__, joined.split(",")))) if joined else b""


def up_the_tree(parts: list[bytes]) -> bytes:
    """The product of all parts: each level's nodes concatenate FAN neighbours, until one is left."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return parts[0] if parts else b""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODERS: dict[tuple[str, str], TreeBpe] = {}


def coder(path: str, pattern: str) -> TreeBpe:
    """One encoder for each worker process and vocabulary."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ids ARRAY<INT>: the tokens of each whole text (null: none)."""
    if ids in df.columns:
        raise ValueError(f"column {ids} is there already")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(ranks_path, pattern)
        for texts in batches:
            yield pd.Series([list(map(int, x.split(","))) if x else [] for x in (c.encode_joined(t or "")[0] for t in texts)])
        c.forget()

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column out BINARY: the bytes of the ids (null: empty)."""
    if out in df.columns:
        raise ValueError(f"column {out} is there already")

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(ranks_path, pattern)
        for rows in batches:
            yield pd.Series([c.decode(x.tolist() if hasattr(x, "tolist") else x) if x is not None else b"" for x in rows])

    return df.withColumn(out, run(F.col(ids)))


def digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of each text: ids encoded, hashed, read back and decoded
    row by row inside the task, so that no row of ids crosses to the JVM. A clash of names raises ValueError."""
    if clash := {"n_tokens", "ids_sha256", "decoded_sha256", "_bpe"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = T.StructType(
        [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(ranks_path, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                joined, n = c.encode_joined(t or "")
                back = c.decode_joined(joined)
                rows.append((n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    made = df.withColumn("_bpe", run(F.col(text)))
    return made.select(*[F.col(x) for x in df.columns], "_bpe.*")
