"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, licenses, mixing, negatives, perplexity, pii, repair, repeats, secrets, warc
from .common import materialize, table
from .fingerprint_queries import op4_simhash

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = rows.unionByName(probe)
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    messages = rows.select(
        F.col("conv_id").alias("tree_id"), place.cast("long").alias("msg_id"), (place - 1).cast("long").alias("parent_id"),
        "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"),
    )
    # each conversation is a tree of one branch; its best branch is all of it
    out = chat.format_trees(messages, branches=1).withColumn("turns", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\e'), '</turn>', '\t'), '### ', '\h') as body,
  replace(replace(replace(replace(role, '\', '\e'), '</turn>', '\t'), '### ', '\h'), ':', '\c') as head from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(head) + length(body) + 14) as bigint) as formatted_chars
from e group by conv_id
"""


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", *perplexity.STATS, "base_failed", "kept", "score")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP5_SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
   md5('mix' || coalesce(cast(doc_id as varchar), 'null')) as o, md5(coalesce(text, '')) as t from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
c as (select *, case rank % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, source_size * 2.0::double as cap,
   (sum(source_size) over ())::double * 1.5::double as budget from r),
f as (select *, cap / weight as fill from c),
g as (select *, coalesce(sum(cap) over (order by fill, rank rows between unbounded preceding and 1 preceding), 0) as cap_before,
   sum(weight) over (order by fill, rank rows between current row and unbounded following) as weight_left from f),
h as (select *, (budget - cap_before) / weight_left as level, (budget - cap_before) / weight_left >= fill as over from g),
l as (select level from h where not over order by fill, rank limit 1),
a as (select source, source_size, budget, case when over then cap else (select level from l) * weight end as target from h),
q as (select d.*, a.source_size, a.target, a.budget, e.e,
   (sum(size) over (partition by d.source, e.e order by o, t rows between unbounded preceding and current row) + e.e * a.source_size) / a.target as finish
   from d join a on d.source is not distinct from a.source, (select unnest([0, 1]) as e) e where size > 0 and target > 0),
k as (select *, coalesce(sum(size) over (order by finish, source nulls last, o, t rows between unbounded preceding and 1 preceding), 0) as run from q),
x as (select o, t, source, count(*) as epochs from k where run < budget group by all)
select d.doc_id, d.size, a.source_size, a.target, cast(d.size * coalesce(x.epochs, 0) as bigint) as taken
from d join a on d.source is not distinct from a.source
left join x on d.o = x.o and d.t = x.t and d.source is not distinct from x.source
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] < 4)
    return rows.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("secret_spans")).alias("spans"),
        F.size("secret_spans").cast("long").alias("n_found"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in pii.NAMES])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    item = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])
    text = lambda c: F.array_join(F.transform(c, item), ",")
    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_found"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults: by crc32 of conv_id:turn a row is dropped, emptied, cut, repeated or given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(which == 1, "").when(which == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select(
        "conv_id", "turn", F.when(which == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(which == 0, 0).when(which == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = repair.ordered(damaged(rows))
    edits = materialize(repair.plan(turns), "edits")
    hashes = repair.digests(repair.repaired(turns, edits)).select(F.col("conv_id").alias("c2"), "repaired_sha256")
    reports = edits.filter("audit is not null").drop("part", "letters", "state", "written").withColumnRenamed("conv_id", "c1")
    ids = rows.select("conv_id").distinct()
    name = F.col("conv_id").cast("string")
    out = ids.join(reports, name.eqNullSafe(F.col("c1")), "left").join(hashes, name.eqNullSafe(F.col("c2")), "left")
    none = lambda c, x: F.coalesce(F.col(c), x).alias(c)
    return out.select(
        "conv_id", *[none(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        none("audit", F.lit("")), none("repaired_sha256", F.sha2(F.lit(""), 256)),
    )


OP11_SQL = r"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
   coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
h as (select *, xor(list_reduce([4294967295::bigint] || list_transform(range(1, strlen(k) + 1), lambda i: ord(substr(k, i, 1))::bigint),
   lambda crc, b: list_reduce([xor(crc, b)] || [x::bigint for x in range(8)], lambda v, s: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 as w from c),
d as (select conv_id, turn, case when w = 4 then 'user' else role end as role,
   case when w = 1 then '' when w = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
   unnest(range(case when w = 0 then 0 when w = 3 then 2 else 1 end)) as copy from h),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
   row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again from d),
f as (select *, substr(role, 1, 1) as r, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when again > 1 then 'd'
   when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '.' end as fault,
   lag(substr(role, 1, 1)) over (partition by conv_id order by i) as p from n),
a as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank,
   count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
   count(*) filter (where i > 1 and p || r not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
-- what may follow each state (0 nothing yet, 1 system, 2 user, 3 assistant)
nx(q, c, q2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins as (select q, 0 as cost, '' as letter, '' as line, q as q2 from (values (0), (1), (2), (3)) t(q)
  union all select q, 2, 'I', case c when 'u' then 'user:' else 'assistant:' end || chr(10), q2 from nx where c <> 's'),
act as (select conv_id, i, q, 3 as cost, 'D' as letter, '' as line, q as q2 from f, (values (0), (1), (2), (3)) t(q)
  union all select conv_id, i, q, (fault = 't')::int, 'K', role || ':' || text || chr(10), q2 from f join nx on r = c where fault in ('.', 't')
  union all select conv_id, i, q, 2 + (fault = 't')::int, 'R', case c when 'u' then 'user:' else 'assistant:' end || text || chr(10), q2 from f, nx
    where fault in ('.', 't') and c <> 's'),
e as (select conv_id, i, ins.q, {'c': ins.cost + act.cost, 'a': ins.letter || act.letter, 'o': ins.line || act.line} as x, act.q2
  from ins join act on ins.q2 = act.q),
dp as (select conv_id, 0::bigint as i, 0 as q, {'c': 0, 'a': '', 'o': ''} as best from a
  union all select dp.conv_id, e.i, e.q2, min({'c': dp.best.c + e.x.c, 'a': dp.best.a || e.x.a, 'o': dp.best.o || e.x.o})
  from dp join e on dp.conv_id is not distinct from e.conv_id and e.i = dp.i + 1 and e.q = dp.q group by dp.conv_id, e.i, e.q2),
z as (select dp.conv_id, min({'c': dp.best.c + ins.cost, 'a': dp.best.a || ins.letter, 'o': dp.best.o || ins.line}) as best
  from dp join a on dp.conv_id is not distinct from a.conv_id and dp.i = a.n join ins on dp.q = ins.q where ins.q2 in (0, 3) group by dp.conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit,
  sha256(coalesce(best.o[:-2], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join a on o.conv_id is not distinct from a.conv_id
left join z on o.conv_id is not distinct from z.conv_id
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.integers(rows.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


OP12_SQL = r"""
with e as (select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
   list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s as (select a.n, a.vec_id as anchor_id, r.n as m, r.vec_id, r.label = a.label as same, list_dot_product(a.v, r.v)::bigint as score
   from e a join e r on a.n <> r.n where a.vec_id % 100 = 0),
p as (select n, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by n order by score desc, vec_id) as place
   from s where same and vec_id <> anchor_id qualify place <= 5),
q as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.n, place order by s.score desc, s.vec_id) as rank
   from p join s on p.n = s.n and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score qualify rank <= 10)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from q
"""


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {
    "op1_chat": op1_chat, "op2_perplexity": op2_perplexity, "op3_jaccard": op3_jaccard, "op4_simhash": op4_simhash, "op5_mix": op5_mix,
    "op6_secrets": op6_secrets, "op7_pii": op7_pii, "op8_bpe": op8_bpe, "op9_warc": op9_warc, "op10_licenses": op10_licenses,
    "op11_repair": op11_repair, "op12_negatives": op12_negatives, "op13_repeats": op13_repeats,
}
ORACLES = {"op1_chat": OP1_SQL, "op5_mix": OP5_SQL, "op11_repair": OP11_SQL, "op12_negatives": OP12_SQL}
