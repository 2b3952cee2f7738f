"""Personal data: base patterns, and a skip-chain conditional random field over each whole document.

Nodes are the tokens that hold a digit or an at sign; every other token has the label O for sure, so leaving it out
changes no marginal. Neighbouring nodes share a chain potential; a node also shares a skip potential with the last
token before it that is the same or similar (equal letters and digits, or equal last seven digits), however far away.
Loopy belief propagation gives each node's marginals, so that occurrences of one token get one label.

Training is piecewise: node weights by multinomial logistic regression, chain and skip potentials by smoothed
log-odds of label pairs. Labels are those of the base patterns in the whole texts of about `train_rows` rows (those whose
hash lies in the share that gives so many): a bounded sample by design. Its rows become nodes and edges where they are, and are counted
there by features and labels; only these counts reach the driver. Inference covers every whole text.

Nulls: a null text is empty; null ids are kept and repeated rows scanned alike. Ties of labels go to O, then to the
kind listed first. Positions are code points, end exclusive. Patterns and graphs take time linear in a text's length. Empty
tables give empty results. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRAIN_ROWS = 4_000
#: Marginal that a label needs.
SURE = 0.9
ROUNDS = 20

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NODE = re.compile(r"[0-9@]")
L = len(KINDS) + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, in linear time: the local part is all that fits before
    an at sign, down to the end of the match before."""
    past, at = 0, text.find("@")
    while at >= 0:
        local = LOCAL.match(text[past:at][::-1]).end()
        m = DOMAIN.match(text, at + 1) if local else None
        past = m.end() if m else at + 1
        if m:
            yield at - local, m.end()
        at = text.find("@", past)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` with parts of at most 255, in linear time: each four numbers of a
    run of dotted numbers."""
    for m in NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns' matches that pass their check, by kind, then start."""
    out: list[tuple[int, int, int]] = [(0, *x) for x in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [(1, *x) for x in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() > 37:  # 19 digits with a sign between any two
            continue
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


class Graph:
    """A document's nodes: spans, token numbers, features, chain and skip edges."""

    def __init__(self, text: str) -> None:
        tokens = [(n, m.start(), m.end()) for n, m in enumerate(TOKEN.finditer(text)) if _NODE.search(m[0])]
        self.spans = [(a, b) for _, a, b in tokens]
        self.starts, self.ends = np.array(self.spans, dtype=int).reshape(-1, 2).T
        words = [text[a:b] for a, b in self.spans]
        self.x = np.array([features(w) for w in words]).reshape(-1, FEATURES)
        self.chain = [(i - 1, i) for i in range(1, len(tokens)) if tokens[i][0] == tokens[i - 1][0] + 1]
        self.skip, seen = [], {}
        for i, w in enumerate(words):
            norm = re.sub("[^0-9a-z@]", "", w.lower())
            digits = re.sub("[^0-9]", "", w)
            keys = {norm, digits[-7:] if len(digits) >= 7 else norm}
            # neighbouring words share a chain edge already
            self.skip += [(j, i) for j in sorted({seen[k] for k in keys if k in seen}) if tokens[i][0] != tokens[j][0] + 1]
            seen |= dict.fromkeys(keys, i)

    def labels(self, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """0 for O, or 1 + the kind of the first span that a token meets."""
        out = np.zeros(len(self.spans), dtype=int)
        for kind, s, e in sorted(spans, reverse=True):
            # tokens that end after s and start before e
            out[np.searchsorted(self.ends, s, "right") : np.searchsorted(self.starts, e, "left")] = kind + 1
        return out


FEATURES = 19


def features(w: str) -> list[float]:
    """A token's shape: what it is made of, not which token it is."""
    core = w.strip(".,;:!?\"'|*#%$&")
    digits = sum(c in "0123456789" for c in core)
    dots, dashes = core.count("."), core.count("-")
    letters = sum(c.isalpha() for c in core)
    at = core.find("@")
    part = core.split(".")
    quad = len(part) == 4 and all(p.isdecimal() and len(p) <= 3 for p in part)
    return [
        1.0, float(at > 0), float(at > 0 and "." in core[at:]), float(quad), float(core[:1] == "+"), float(core[:1] == "(" and core[-1:] == ")"),
        float(digits == len(core) and 16 <= digits <= 19), float(digits == len(core) and digits < 4), float(digits == len(core) and 4 <= digits < 16),
        float(digits == len(core) and digits > 19), float(letters == 0), float(letters > 0 and at < 0), float(dots > 0), float(dots > 1),
        float(dashes > 0 and letters == 0), float(digits == 0), min(digits, 20) / 20.0, min(letters, 20) / 20.0,
        float(digits == len(core) and 16 <= digits <= 19 and luhn(core)),
    ]


class SkipChain:
    """Weights (L x FEATURES), chain and skip log-potentials (L x L)."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.weights, self.chain, self.skip = weights, chain, skip

    @staticmethod
    def fit(nodes: dict[tuple, int], chain: dict[tuple, int], skip: dict[tuple, int], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> SkipChain:
        """From how often each (features, label), chain pair and skip pair of labels occurs."""
        tables = [np.ones((L, L)), np.ones((L, L))]
        for table, pairs in zip(tables, (chain, skip)):
            for (i, j), n in pairs.items():
                table[i, j] += n
        tables[1] = tables[1] + tables[1].T
        odds = lambda t: np.log(t / t.sum()) - np.log(t.sum(1, keepdims=True) / t.sum()) - np.log(t.sum(0, keepdims=True) / t.sum())
        w = np.zeros((L, FEATURES))
        if nodes:
            seen = sorted(nodes)
            x, aim = np.array([f for f, _ in seen]), np.eye(L)[[y for _, y in seen]]
            share, m = np.array([nodes[k] for k in seen], float)[:, None], np.zeros_like(w)
            share /= share.sum()
            for _ in range(steps):
                z = x @ w.T
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                m = 0.9 * m + ((share * (p - aim)).T @ x + ridge * w)
                w = w - rate * m
        return SkipChain(w, *(np.clip(odds(t), -3, 3) for t in tables))

    def marginals(self, g: Graph) -> np.ndarray:
        """Each node's label probabilities by loopy belief propagation, damped, in log space."""
        unary = g.x @ self.weights.T
        kinds = [(np.array(edges, dtype=int).reshape(-1, 2), np.exp(table)) for edges, table in ((g.chain, self.chain), (g.skip, self.skip))]
        # a message of each edge in either direction
        ways = [(e[:, 0], e[:, 1], t) for e, t in kinds] + [(e[:, 1], e[:, 0], t.T) for e, t in kinds]
        msg = [np.zeros((len(src), L)) for src, _, _ in ways]

        def believed() -> np.ndarray:
            out = unary.copy()
            for (_, dst, _), m in zip(ways, msg):
                np.add.at(out, dst, m)
            return out

        for _ in range(ROUNDS if g.chain or g.skip else 0):
            belief, change, new = believed(), 0.0, []
            for n, (src, _, table) in enumerate(ways):
                cavity = belief[src] - msg[(n + 2) % 4]  # less what came the other way
                top = cavity.max(axis=1, keepdims=True)
                m = np.log(np.exp(cavity - top) @ table)
                m -= np.logaddexp.reduce(m, axis=1, keepdims=True)
                change = max(change, np.abs(m - msg[n]).max(initial=0.0))
                new.append(0.5 * msg[n] + 0.5 * m)
            msg = new
            if change < 1e-4:
                break
        belief = believed()
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of neighbouring nodes with one sure label, off the base spans, as (4 + kind, start, end)."""
        if not _NODE.search(text):
            return []
        g = Graph(text)
        p = self.marginals(g)
        y = np.where(p.max(1) >= SURE, p.argmax(1), 0)
        met = g.labels(base) > 0
        out, pairs = [], set(g.chain)
        for i, (a, b) in enumerate(g.spans):
            if not y[i] or met[i]:
                continue
            word = text[a:b]
            a, b = a + len(word) - len(word.lstrip(".,;:!?\"'|")), b - (len(word) - len(word.rstrip(".,;:!?\"'|")))
            if out and (i - 1, i) in pairs and y[i - 1] == y[i] and not met[i - 1]:
                out[-1] = (out[-1][0], out[-1][1], b)
            else:
                out.append((len(KINDS) + int(y[i]) - 1, a, b))
        return sorted(out)


def counted(text: str) -> tuple[Counter, Counter, Counter]:
    """How often each (features, label) of a text's nodes occurs, and each pair of labels along its chain and skip edges."""
    g = Graph(text)
    y = g.labels(base_spans(text)).tolist()
    return Counter(zip(map(tuple, g.x.tolist()), y)), Counter((y[i], y[j]) for i, j in g.chain), Counter((y[i], y[j]) for i, j in g.skip)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> SkipChain:
    """A model from the whole texts of about train_rows rows, those whose hash lies in the share of its range that gives so many."""
    total, key = docs.count(), F.xxhash64("doc_id", "text")
    rows = docs if total <= train_rows else docs.filter(F.pmod(key, F.lit(1 << 30)) < F.lit(int((1 << 30) * train_rows / total)))
    rows = rows.filter(F.col("text").rlike("[0-9@]")).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = [Counter(), Counter(), Counter()]
            for text in b["text"]:
                for into, found in zip(sums, counted(text)):
                    into.update(found)
            nodes = [(0, list(x), y, 0, n) for (x, y), n in sums[0].items()]
            pairs = [(k, [], i, j, n) for k in (1, 2) for (i, j), n in sums[k].items()]
            yield pd.DataFrame(nodes + pairs, columns=["part", "x", "y", "z", "n"])

    found = rows.mapInPandas(run, "part int, x array<double>, y int, z int, n long").groupBy("part", "x", "y", "z").agg(F.sum("n").alias("n"))
    tables = [{}, {}, {}]
    for r in found.collect():  # the features take few values: at most some 10,000 rows
        tables[r["part"]][(tuple(r["x"]), r["y"]) if r["part"] == 0 else (r["y"], r["z"])] = r["n"]
    return SkipChain.fit(*tables)


NAMES = [*KINDS, *(f"crf_{k}" for k in KINDS)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, model: SkipChain | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, base and added ARRAY<STRUCT<kind INT, start LONG, end LONG>> of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, train_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base = [base_spans(t) if isinstance(t, str) else [] for t in b["text"]]
            added = [shared.value.added(t, s) if isinstance(t, str) else [] for t, s in zip(b["text"], base)]
            show = lambda rows: [[{"kind": k, "start": s, "end": e} for k, s, e in r] for r in rows]
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": show(base), "added": show(added)})

    item = "array<struct<kind:int,start:bigint,end:bigint>>"
    ident = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {ident}, base {item}, added {item}")
