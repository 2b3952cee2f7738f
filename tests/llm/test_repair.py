"""op11: every edit sequence of short conversations tried; pieces joined like whole ones; the query against the trial."""

import hashlib
import itertools
import random
import re
import zlib

from booktext.llm import queries, repair

LEGAL = re.compile(r"(s?(ua)+)?")


def rows_of(roles: str, faults: str) -> list[tuple[str, str]]:
    return list(zip(roles, faults))


def tried(rows: list[tuple[str, str]]) -> tuple[int, str, list[str]]:
    """Cost, audit and the new rows' roles of the best of all edit sequences: one Insert at most before each row and at the end."""
    best = None
    slots = [None, "u", "a"]
    acts = [("D", None), ("K", None), ("R", "u"), ("R", "a")]
    for ins in itertools.product(slots, repeat=len(rows) + 1):
        for act in itertools.product(acts, repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for i, (role, fault) in enumerate(rows):
                if ins[i]:
                    cost, audit, roles = cost + 2, audit + "I", roles + ins[i]
                letter, to = act[i]
                if letter != "D" and fault in "bd":
                    break
                audit += letter
                if letter == "D":
                    cost += 3
                else:
                    roles += role if letter == "K" else to
                    cost += (letter == "R") * 2 + (fault == "t")
            else:
                if ins[-1]:
                    cost, audit, roles = cost + 2, audit + "I", roles + ins[-1]
                if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, roles)
    return best


def test_least_integer_is_the_best_of_all_edits():
    rng = random.Random(11)
    for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 3] + [3] * 30:
        roles, faults = ("".join(rng.choices(c, k=n)) for c in ("suua.a", "...tbd"))
        if not n:
            continue
        got = repair.end(repair.piece(roles, faults, (repair.START,)))
        assert got == tried(rows_of(roles, faults))[:2], (roles, faults)


def test_pieces_join_to_the_whole(monkeypatch):
    rng = random.Random(3)
    for n in (5, 17, 40):
        roles, faults = ("".join(rng.choices(c, k=n)) for c in ("suaua.", "...tbd"))
        whole = repair.end(repair.block(roles, faults, (repair.START,)))
        monkeypatch.setattr(repair, "BLOCK", 2)
        assert repair.end(repair.piece(roles, faults, (repair.START,))) == whole
        monkeypatch.setattr(repair, "BLOCK", 64)
        cut = n // 3
        parts = [repair.piece(roles[:cut], faults[:cut], (repair.START,)), repair.piece(roles[cut:], faults[cut:], tuple(range(4)))]
        assert repair.end(repair.joined(*parts)) == whole


def expected(rows: list[tuple]) -> dict:
    """The query's rows by conversation, step by step in Python."""
    out, kept = {}, {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, None)
        said = lambda x: " " if x is None else str(x)
        which = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
        role = "user" if which == 4 else role
        kept.setdefault(conv, [])
        kept[conv] += [(turn, role, text)] * (0 if which == 0 else 2 if which == 3 else 1)
    for conv in out:
        said = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), ""
        for _, role, text in said:
            end = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults += "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "."
            seen.add((role, text))
        turns = {t for t, _, _ in said if t is not None}
        initials = [r[:1] or " " for _, r, _ in said]
        cost, audit, roles = tried(list(zip(initials, faults))) if said else (0, "", "")
        lines, at, i = [], 0, 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else said[i][1:]
            i += letter != "I"
            if letter != "D":
                lines.append((role if letter == "K" else {"u": "user", "a": "assistant"}[roles[at]]) + ":" + text)
                at += 1
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_query_equals_the_trial(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " \t", "What?  \n", None, "Ça va!", "Long " * 3000 + "end.", "a ", "Yes."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "user", None, "", "tool"]), rng.choice(texts)) for conv in range(60) for turn in range(rng.randint(1, 3))]
    rows += [(None, None, "user", "Null."), (None, 3, "assistant", "Null."), (99, None, None, None), (99, 7, "user", "Same."), (99, 7, "user", "Same."), (2**60 + 1, -5, "user", "x")]
    rows = [(*r, "extra", 1) for r in rows]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, part int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    want = expected([r[:4] for r in rows])
    assert got == want


def test_a_long_conversation_spreads_over_parts(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"Text {t}."])) for t in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = repair.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = turns.orderBy("at").collect()
    assert len({r["part"] for r in held}) > 1
    roles, faults = "".join(r["role"][:1] for r in held), "".join(r["fault"] for r in held)
    edits = repair.plan(turns)
    report = edits.filter("audit is not null").first()
    assert (report["cost"], report["audit"]) == repair.end(repair.block(roles, faults, (repair.START,)))
    assert "".join(r["letters"] for r in edits.orderBy("part").collect()) == report["audit"]
    lines = repair.repaired(turns, edits).orderBy("pos").collect()
    assert [r["pos"] for r in lines] == list(range(len(lines)))
    assert LEGAL.fullmatch("".join(r["role"][:1] for r in lines))
    text = "\n".join(f"{r['role']}:{r['text']}" for r in lines)
    assert repair.digests(repair.repaired(turns, edits)).first()["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_repair(spark, str(tmp_path)).collect() == []
