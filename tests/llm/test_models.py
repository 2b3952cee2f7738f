"""Trained models as the queries train them: recall on labelled and held-out strings, and labels on whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from booktext.llm import fingerprint_queries, fingerprints, mixing, perplexity, pii, secrets

TABLES = ["/root/testdata/sf0.01", "/root/testdata/sf0.1"]


@pytest.mark.parametrize("sf", TABLES)
def test_secrets_of_every_alphabet(spark, sf):
    """The weights that the query learns, at its threshold: at least 0.9 of each kind of random string, and no other token of the table."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.select(F.col("doc_id").alias("id"), secrets.mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).alias("text")).cache()
    base = secrets.base_spans(rows).cache()
    weights = secrets.learn(rows, base)
    rng = random.Random(66)
    strings = [(k, "".join(rng.choices(a, k=rng.randint(lo, hi)))) for k, a in enumerate(secrets.ALPHABETS) for lo, hi in ((16, 19), (20, 40)) for _ in range(200)]
    over = secrets.ratio(F.col("value"), weights) >= secrets.THRESHOLD * (F.length("value") - 1)
    got = spark.createDataFrame(strings, "kind int, value string").groupBy("kind").agg(F.avg(over.cast("int")).alias("recall")).collect()
    assert len(got) == len(secrets.ALPHABETS) and min(r["recall"] for r in got) >= 0.9
    values = base.select("value").distinct()
    tokens = rows.select(F.explode(F.regexp_extract_all("text", F.lit(secrets.CANDIDATE), F.lit(0))).alias("value")).filter(over).distinct()
    extra = [r["value"] for r in tokens.collect()]
    known = [r["value"] for r in values.collect()]
    assert all(any(v in e or e in v for v in known) for e in extra)


def test_generated_strings_are_what_they_say(spark):
    rows = secrets.generated(spark, 50).collect()
    assert len(rows) == 50 * len(secrets.ALPHABETS) == len({r["value"] for r in rows})
    assert all(16 <= len(r["value"]) <= 64 and set(r["value"]) <= set(secrets.ALPHABETS[r["alphabet"]]) for r in rows)
    assert [r["value"] for r in secrets.generated(spark, 50).collect()] == [r["value"] for r in rows]


def test_planted_secrets_are_added_by_the_method(spark):
    """Keys without a keyword among the table's documents are found whole, and no document without a base span gains one."""
    rng = random.Random(9)
    keys = ["".join(rng.choices(a, k=30)) for a in secrets.ALPHABETS for _ in range(3)]
    docs = spark.read.parquet(f"{TABLES[0]}/documents.parquet").select("doc_id", "text")
    planted = spark.createDataFrame([(-1 - i, f"see {k} here") for i, k in enumerate(keys)], "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in secrets.with_spans(docs.unionByName(planted)).selectExpr("doc_id", "transform(secret_spans, x -> struct(x.start, x.end, x.kind)) as s").collect()}
    whole = [[tuple(x) for x in found[-1 - i]] == [(4, 4 + len(k), 4)] for i, k in enumerate(keys)]
    assert sum(whole) >= 0.9 * len(keys)
    assert not [d for d, s in found.items() if d >= 0 and any(x["kind"] == 4 for x in s) and all(x["kind"] == 4 for x in s)]


@pytest.mark.parametrize("sf", TABLES)
def test_pii_labels_of_held_out_tokens(spark, sf):
    """Trained on half of the table, the field names at least 0.9 of the other half's base tokens of each kind, by shape alone."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = pii.train(d.filter("doc_id % 2 = 0"))
    hit, all_ = [0] * pii.L, [0] * pii.L
    wrong = plain = 0
    for r in d.filter("doc_id % 2 = 1 and text rlike '[0-9@]'").collect():
        g = pii.Graph(r["text"])
        y, p = g.labels(pii.base_spans(r["text"])), model.marginals(g)
        for want, got, sure in zip(y.tolist(), p.argmax(1).tolist(), p.max(1).tolist()):
            all_[want] += 1
            hit[want] += want == got
            plain += want == 0
            wrong += want == 0 and got != 0 and sure >= pii.SURE
    assert all(hit[k] >= 0.9 * all_[k] for k in range(1, pii.L) if all_[k]), (hit, all_)
    assert wrong <= 0.05 * plain


def test_pii_training_sees_whole_texts(spark):
    texts = ["call +1 (222) 555-1234 or +49 30 1234 5678 now 77", "card 4111 1111 1111 1111, a@b.co and 10.0.0.1", "x " * 20_000 + "+1 (333) 555-9999", None, ""]
    want = [sum((pii.counted(t)[k] for t in texts if t), pii.Counter()) for k in range(3)]
    assert {y for _, y in want[0]} == {0, 1, 2, 3, 4}
    got = pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    same = pii.SkipChain.fit(*want)
    assert (got.weights == same.weights).all() and (got.chain == same.chain).all() and (got.skip == same.skip).all()


def test_pii_added_spans_by_enumeration(spark):
    """Added spans are the runs of sure labels off the base spans; the marginals of small chains are those of all labelings."""
    import numpy as np

    rng = np.random.default_rng(7)
    text = "ring 555-1234, 7 x (222) 12345678 y 99."
    g = pii.Graph(text)
    model = pii.SkipChain(4 * rng.normal(size=(pii.L, pii.FEATURES)), rng.normal(size=(pii.L, pii.L)), np.zeros((pii.L, pii.L)))
    u, p = g.x @ model.weights.T, np.zeros((len(g.spans), pii.L))
    for y in np.ndindex(*[pii.L] * len(g.spans)):
        e = np.exp(sum(u[i, k] for i, k in enumerate(y)) + sum(model.chain[y[i], y[j]] for i, j in g.chain))
        for i, k in enumerate(y):
            p[i, k] += e
    p /= p.sum(1, keepdims=True)
    want, before = [], None
    for i, (a, b) in enumerate(g.spans):
        k = int(p[i].argmax()) if p[i].max() >= pii.SURE else 0
        word = text[a:b]
        a, b = a + len(re.match(r"[.,;:!?\"'|]*", word)[0]), b - len(re.search(r"[.,;:!?\"'|]*$", word)[0])
        if k and before == k and (i - 1, i) in g.chain:
            want[-1] = (*want[-1][:2], b)
        elif k:
            want.append((len(pii.KINDS) + k - 1, a, b))
        before = k
    assert model.added(text, []) == sorted(want)


def test_repeated_rows_have_their_own_edited_text(spark, tmp_path):
    rows = [(5, "one two three four"), (5, "one two three four"), (4, "alpha beta gamma delta epsilon"), (4, None), (None, "one two three four")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint_queries.op4_simhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = fingerprints.neighbours(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    want = []
    for r in near:
        half = len(r["text"]) // 2
        want.append((r["doc_id"], r["text"][: len(r["text"]) - half] + r["next_text"][:half]))
    prints = {t: f"{f & (2**64 - 1):016x}" for t, f in fingerprints.simhash(spark.createDataFrame([(t,) for _, t in want], "text string").distinct(), ["text"]).collect()}
    assert sorted((str(r["doc_id"]), r["edited_fingerprint"]) for r in got) == sorted((str(d), prints[t]) for d, t in want)
    assert len({r["edited_fingerprint"] for r in got if r["doc_id"] == 5}) == 2


def test_clashing_columns_of_quality_rules_and_mixing(spark):
    """Any names of the caller do no harm; those of added columns give way."""
    texts = [(i, f"word{i} " + "some more words of a text that is long enough " * 3, "en", "ab"[i % 2]) for i in range(8)]
    plain = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    given = plain
    for c in ("n_words", "_fold", "_lang", "_l", "_key", "gram", "_o", "_t", "_b", "_e", "size", "epochs", "_s", "own", "dotted.name", "_given0"):
        given = given.withColumn(c, F.lit("x"))
    judged, alone = perplexity.judge(given), perplexity.judge(plain)
    assert len(set(judged.columns)) == len(judged.columns) and {"gram", "_fold", "dotted.name"} <= set(judged.columns)
    key = lambda rows: sorted((r["doc_id"], r["n_words"], r["kept"], r["score"]) for r in rows)
    got = judged.collect()
    assert key(got) == key(alone.collect()) and {r["gram"] for r in got} == {"x"}
    mixed = mixing.mix(given)
    got = mixed.collect()
    want = {r["doc_id"]: (r["size"], r["taken"], r["epochs"]) for r in mixing.mix(plain).collect()}
    assert {r["doc_id"]: (r["size"], r["taken"], r["epochs"]) for r in got} == want and {r["_o"] for r in got} == {"x"}
    for work in (perplexity.judge, mixing.mix):
        assert work(given.limit(0)).count() == 0
