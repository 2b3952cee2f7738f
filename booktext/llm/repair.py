"""Conversation structure repair: the cheapest edits that give each conversation the roles `(s?(ua)+)?`.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3; a must for blank and duplicate rows) and Insert of an empty user or
assistant row anywhere (2); an undeleted truncated row costs 1 more. Every path through the edit graph has one integer as its
weight: its high digits are the cost, its low digits (three bits each, a fixed width) are the letters of the edits by
position, D < I < K < R as 1 to 4, with zeros at the end for the positions that are left. The least integer is thus the cheapest
path and, among the cheapest, the one whose letters come first; a plain integer minimum over the nodes (rows read, role state)
decides everything. Keeping only the least integer of a node is exact: two paths of equal cost over the same rows never have letters of
which one is the beginning of the other, since the longer would have more Inserts. Two Inserts are never neighbours on a
cheapest path (leaving both out stays legal, and a lone system row is cheaper deleted), so one before each row and one at the end do.

Paths compose: a piece of a conversation is a table (state at its beginning, state at its end) -> least integer, pieces join by
adding shifted integers, and halves are joined recursively. Rows are dealt by ranges of (conversation, order), so one long conversation
spreads over many tasks: each makes its piece, and only pieces and letters meet.

Order: turn (nulls first), then role, the text's first 256 characters, its hash and the number of the copy. Nulls: a null role or text is one space, null
turns are no gap, a null conversation is one of its own. Repeated rows are duplicates. Empty roles and roles that begin with other letters
than s, u or a are never kept. Equal texts are told by 128 bits of hashes. Empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The digits of the letters D, I, K and R.
LETTERS = "DIKR"
D, I, K, R = 1, 2, 3, 4
#: Rows whose paths are found at once, before pieces are joined.
BLOCK = 64
#: Role states (nothing yet, after system, after user, after assistant) and what may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}
ENDS = (START, ASSISTANT)

#: (state at the beginning, state at the end) -> (weight, letters written), and the width in letters.
Piece = tuple[dict[tuple[int, int], tuple[int, int]], int]


def block(roles: str, faults: str, begin: tuple[int, ...]) -> Piece:
    """The piece of some rows: their roles' initials (other letters: a dot) and faults (b, d, t or a dot)."""
    width = 2 * len(roles)
    top, out = 3 * width, {}
    for first in begin:
        nodes = {first: (0, 0)}

        def put(into: dict, state: int, w: int, n: int, cost: int, letter: int) -> None:
            new = (w + (cost << top) + (letter << top - 3 * (n + 1)), n + 1)
            if state not in into or new < into[state]:
                into[state] = new

        for role, fault in zip(roles, faults):
            before = dict(nodes)
            for q, (w, n) in nodes.items():
                for r in ROLES:
                    if r in NEXT[q]:
                        put(before, NEXT[q][r], w, n, INSERT, I)
            nodes, more = {}, TRUNCATED if fault == "t" else 0
            for q, (w, n) in before.items():
                put(nodes, q, w, n, DELETE, D)
                if fault in "bd":
                    continue
                if role in NEXT[q]:
                    put(nodes, NEXT[q][role], w, n, KEEP + more, K)
                for r in ROLES:
                    if r in NEXT[q]:
                        put(nodes, NEXT[q][r], w, n, REROLE + more, R)
        out |= {(first, q): v for q, v in nodes.items()}
    return out, width


def joined(a: Piece, b: Piece) -> Piece:
    """The piece of a's rows and then b's."""
    (left, wa), (right, wb), out = a, b, {}
    top, low = 3 * (wa + wb), (1 << 3 * wb) - 1
    for (p, q), (v, n) in left.items():
        for (q2, r), (w, m) in right.items():
            if q == q2:
                new = ((v << 3 * wb) + (w >> 3 * wb << top) + ((w & low) << 3 * (wa - n)), n + m)
                if (p, r) not in out or new < out[p, r]:
                    out[p, r] = new
    return out, wa + wb


def piece(roles: str, faults: str, begin: tuple[int, ...]) -> Piece:
    if len(roles) <= BLOCK:
        return block(roles, faults, begin)
    half = len(roles) // (2 * BLOCK) * BLOCK or BLOCK
    return joined(piece(roles[:half], faults[:half], begin), piece(roles[half:], faults[half:], tuple(range(4))))


def end(whole: Piece) -> tuple[int, str]:
    """Cost and letters of the cheapest path of a whole conversation, whose last step may be an Insert."""
    table, width = whole
    # one more letter of width for the last Insert
    last: Piece = ({(q, q): (0, 0) for q in ENDS} | {(USER, ASSISTANT): ((INSERT << 3) + I, 1)}, 1)
    out, width = joined((table, width), last)
    w, n = min(v for (p, q), v in out.items() if p == START and q in ENDS)
    low = w & ((1 << 3 * width) - 1)
    return w >> 3 * width, format(low, "o").zfill(width)[:n].translate(str.maketrans("1234", LETTERS))


def step(state: int, letter: str, role: str) -> int:
    """The role state after an edit of a row with that initial."""
    if letter == "D":
        return state
    return NEXT[state][role] if letter == "K" else ASSISTANT if state == USER else USER


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def ordered(messages: DataFrame) -> DataFrame:
    """conv_id and turn (as text), part, at, role, text, fault (b, d, t or a dot) of messages(conv_id, turn, role, text): `at` numbers all
    rows in order, and `part` is the range that a row lies in. Copies are counted before they are dealt out."""
    said = messages.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    said = said.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    said = said.withColumn("m1", F.xxhash64("role", "text")).withColumn("m2", F.xxhash64("text", F.lit(1), "role"))
    first = said.groupBy("conv_id", "m1", "m2").agg(F.min(F.struct("turn"))["turn"].alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("m1").alias("f1"), F.col("m2").alias("f2"), "first")
    rows = said.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("m1") == F.col("f1")) & (F.col("m2") == F.col("f2")))
    rows = rows.select("conv_id", "turn", "role", "text", "m1", "first", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    again = (F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("first"))
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank(F.col("text")), "b").when(again, "d").when(~whole, "t").otherwise(".")
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 256), F.col("m1"), F.col("copy")]
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), *[k.alias(f"k{i}") for i, k in enumerate(keys[3:])])
    order = ["conv_id", "turn", "role", "k0", "k1", "k2"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    texts = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]  # so that nulls leave whole numbers whole in pandas
    rows = rows.select(texts[0], F.shiftright("at", 33).cast("int").alias("part"), "at", texts[1], "role", "text", "fault")
    return materialize(rows, "turns")


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches, cut where a key changes; a run may come in several pieces, as the batches cut it."""
    for b in batches:
        if len(b):
            new = (b[keys].isna() != b[keys].shift().isna()).any(axis=1) | ((b[keys] != b[keys].shift()) & b[keys].notna()).any(axis=1)
            at = [*new.to_numpy().nonzero()[0].tolist(), len(b)]
            at = at if at[0] == 0 else [0, *at]
            for i, j in zip(at, at[1:]):
                yield b.iloc[i:j]


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def pieces(turns: DataFrame) -> DataFrame:
    """One row for each (conv_id, part) of ordered(): its roles' initials and faults, one character a row, its turns, and
    its piece. A conversation that begins inside the part has one beginning only."""
    initial = F.regexp_replace(F.substring(F.concat("role", F.lit(" ")), 1, 1), "[^sua]", ".")
    narrow = turns.select("conv_id", "part", "at", "turn", initial.alias("role"), "fault")
    narrow = narrow.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def made() -> pd.DataFrame:
            roles, faults = "".join(h[0] for h in held), "".join(h[1] for h in held)
            turns = [t for h in held for t in h[2]]
            known = [int(t) for t in turns if t is not None]
            begin = (START,) if held[0][3] & ((1 << 33) - 1) else tuple(range(4))
            table, width = piece(roles, faults, begin)
            rows = [f"{p},{q},{n},{v:x}" for (p, q), (v, n) in table.items()]
            return pd.DataFrame({
                "conv_id": [key[0]], "part": [key[1]], "roles": [roles], "faults": [faults], "width": [width], "paths": [rows],
                "low": [min(known, default=None)], "high": [max(known, default=None)], "turns": [len(set(known))],
            })

        for r in _runs(batches, ["conv_id", "part"]):
            new = (r["conv_id"].iloc[0], r["part"].iloc[0])
            if key is not None and not _same(key, new):
                yield made()
                held = []
            key = new
            held.append(("".join(r["role"]), "".join(r["fault"]), r["turn"].tolist(), int(r["at"].iloc[0])))
        if held:
            yield made()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for b in run(batches):
            out = [b] if out is None else [*out, b]
            if len(out) == 1000:
                yield pd.concat(out, ignore_index=True)
                out = None
        if out:
            yield pd.concat(out, ignore_index=True)

    schema = "conv_id string, part int, roles string, faults string, width long, paths array<string>, low long, high long, turns long"
    return narrow.mapInPandas(whole, schema)


def plan(turns: DataFrame) -> DataFrame:
    """For each (conv_id, part) of ordered(): letters (its share of the cheapest edits), the role state and number of rows written
    before it; and on the first part of each conversation its report, null elsewhere: gaps, blank, duplicate, truncated, illegal,
    cost and audit."""
    dealt = pieces(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def solved(held: list) -> list[tuple]:
        tables = [({(int(p), int(q)): (int(v, 16), int(n)) for p, q, n, v in (x.split(",") for x in h.paths)}, int(h.width)) for h in held]
        whole = tables[0]
        for t in tables[1:]:
            whole = joined(whole, t)
        cost, audit = end(whole)
        roles, faults = "".join(h.roles for h in held), "".join(h.faults for h in held)
        illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
        known = [h for h in held if not pd.isna(h.low)]
        distinct = sum(h.turns for h in known) - sum(a.high == b.low for a, b in zip(known, known[1:]))
        gaps = int(known[-1].high - known[0].low + 1 - distinct) if known else 0
        report = (gaps, *(faults.count(c) for c in "bdt"), illegal, cost, audit)
        out, at, row, state, written = [], 0, 0, START, 0
        for h in held:
            begin, first, before = at, state, written
            left = len(h.roles)
            while at < len(audit) and (left or h is held[-1]):
                letter = audit[at]
                state = step(state, letter, roles[row] if letter != "I" else ".")
                written += letter != "D"
                row, left, at = row + (letter != "I"), left - (letter != "I"), at + 1
            out.append((h.conv_id, h.part, audit[begin:at], first, before, *(report if h is held[0] else [None] * 7)))
        return out

    names = ["conv_id", "part", "letters", "state", "written", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out = [], []
        for b in batches:
            for r in b.itertuples(index=False):
                if held and not _same((held[0].conv_id,), (r.conv_id,)):
                    out += solved(held)
                    held = []
                held.append(r)
            if out:
                yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[5:11]})
                out = []
        if held:
            yield pd.DataFrame(solved(held), columns=names).astype({n: "Int64" for n in names[5:11]})

    longs = ", ".join(f"{n} long" for n in names[5:11])
    return dealt.mapInPandas(run, f"conv_id string, part int, letters string, state int, written long, {longs}, audit string")


def repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, pos, role, text of the repaired conversations, from ordered() and plan(): parts are repaired apart from each other, row by row."""
    head = edits.select("conv_id", "part", F.lit(-1).cast("long").alias("at"), "letters", "state", "written", F.lit("").alias("role"), F.lit("").alias("text"))
    rows = turns.select("conv_id", "part", "at", F.lit("").alias("letters"), F.lit(0).alias("state"), F.lit(0).cast("long").alias("written"), "role", "text")
    dealt = head.unionByName(rows).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, at, state, written, conv, out = "", 0, START, 0, None, []

        def inserts() -> None:
            nonlocal at, state, written
            while at < len(letters) and letters[at] == "I":
                state = step(state, "I", ".")
                out.append((conv, written, ROLES["a" if state == ASSISTANT else "u"], ""))
                at, written = at + 1, written + 1

        for b in batches:
            for r in b.itertuples(index=False):
                if r.at < 0:
                    inserts()
                    letters, at, state, written, conv = r.letters, 0, r.state, r.written, r.conv_id
                    continue
                inserts()
                letter = letters[at]
                at += 1
                if letter != "D":
                    state = step(state, letter, r.role[:1])
                    out.append((conv, written, r.role if letter == "K" else ROLES["a" if state == ASSISTANT else "u"], r.text))
                    written += 1
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "pos", "role", "text"])
                out = []
        inserts()
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "pos", "role", "text"])

    return dealt.mapInPandas(run, "conv_id string, pos long, role string, text string")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired(): lowercase hex of role:text lines, joined by line feeds. A hash reads its bytes one after
    the other, so a conversation streams through one task, with nothing held but the hash."""
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for b in batches:
            for r in b.itertuples(index=False):
                if state is None or not _same((key,), (r.conv_id,)):
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = r.conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{r.role}:{r.text}".encode())
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
                out = []
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["conv_id", "repaired_sha256"])

    return dealt.mapInPandas(run, "conv_id string, repaired_sha256 string")
