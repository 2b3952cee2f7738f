"""Book-like tables that Spark derives from pages and documents, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

SP = r"""sp as (select regexp_extract(url,'https?://([^/]+)',1) book_id, cast(row_number() over (partition by regexp_extract(url,'https?://([^/]+)',1) order by page_id) - 1 as int) spine_pos,
 cast(page_id as varchar) doc, regexp_extract(html,'<html lang="([a-z]+)"',1) as language, url, html from pages)"""
SD = """sd as (select source book_id, cast(row_number() over (partition by source order by doc_id) - 1 as int) spine_pos, cast(doc_id as varchar) doc, doc_id, lang as language, text from documents)"""
SL = r"""sl as (select book_id, spine_pos, doc, doc_id, i-1 raw_idx, trim(regexp_replace(l[i],'[ \t\r\n\f\x0B]+',' ','g')) as text from (select *, string_split(text,chr(10)) l, unnest(range(1,len(string_split(text,chr(10)))+1)) i from sd))"""
SLINES = """slines as (select book_id, spine_pos, doc, doc_id, cast(row_number() over (partition by doc_id order by raw_idx) - 1 as int) line_idx, text,
 cast(case when (doc_id + raw_idx) % 6 = 5 then 1 when (doc_id + raw_idx) % 11 = 10 then 2 else 0 end as int) blanks,
 cast(case when doc_id % 9 = 4 then 1 when doc_id % 9 = 7 then 2 else 0 end * case when row_number() over (partition by doc_id order by raw_idx) % 5 = 1 then 1 else 0 end as int) kind
 from sl where text <> '')"""
STOC = """stoc as (select book_id, doc, spine_pos*2 toc_pos, cast(1 + doc_id % 8 as int) as depth, cast(null as varchar) fragment, case when doc_id % 5 = 0 then l0 else concat('Chapter ', doc) end as label from
 (select sd.book_id, sd.doc, sd.spine_pos, sd.doc_id, coalesce(s.text, concat('Plate ', sd.doc)) l0 from sd left join (select doc_id, text from slines where line_idx=0) s on sd.doc_id=s.doc_id) x where doc_id % 3 <> 0
 union all select book_id, doc, spine_pos*2+1, 2, 'mid', concat('Part ', doc) from sd where doc_id % 5 = 1)"""
SLINKS = """slinks as (select book_id, spine_pos*2 link_pos, concat('d',doc,'#n') target, case doc_id % 4 when 0 then doc when 1 then concat('[',doc,']') when 2 then substring(text,1,6) else concat('注',doc) end as text, doc_id % 13 = 0 declared, [concat('d',doc,'#r')] ids, doc_id % 11 = 0 whole from sd
 union all select book_id, 1000000000+spine_pos*2, concat('d',doc,'#r'), '^', false, [concat('d',doc,'#n')], true from sd where doc_id % 6 <> 5)"""
DOCS = f"with {SD}, {SL}, {SLINES}, {STOC}"
#: The first of lines(), null if there is none: read where the text is, since whole texts cut into lines cost more than all the rest of a table of contents.
FIRST_LINE = r"""nullif(trim(regexp_replace(regexp_extract(text, r'^[ \t\r\n\f\x0B]*([^\n]*)', 1), r'[ \t\r\n\f\x0B]+', ' ')), '')"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet")
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    pos = (F.row_number().over(W.partitionBy("book_id").orderBy("page_id")) - 1).alias("spine_pos")
    return p.withColumn("book_id", host).select(
        "book_id", pos, F.col("page_id").cast("string").alias("doc"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"), "url", "html"
    )


def documents(spark: SparkSession, sf: str, text: str = "text") -> DataFrame:
    """text: what is kept of each text, worked out before the documents are dealt out."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "lang", F.expr(text).alias("text"))
    pos = (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).alias("spine_pos")
    return d.select(F.col("source").alias("book_id"), pos, F.col("doc_id").cast("string").alias("doc"), "doc_id", F.col("lang").alias("language"), "text")


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("book_id", "spine_pos", "doc", "doc_id", F.posexplode(F.split("text", "\n")).alias("raw_idx", "t"))
    return rows.select("book_id", "spine_pos", "doc", "doc_id", "raw_idx", F.trim(F.regexp_replace("t", r"[ \t\r\n\f\x0B]+", " ")).alias("text"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_lines(spark, sf).filter("text <> ''")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("raw_idx"))
    s = F.col("doc_id") + F.col("raw_idx")
    return rows.select(
        "book_id", "spine_pos", "doc", "doc_id", (n - 1).alias("line_idx"), "text", F.when(s % 6 == 5, 1).when(s % 11 == 10, 2).otherwise(0).alias("blanks"),
        F.when(n % 5 == 1, F.when(F.col("doc_id") % 9 == 4, 1).when(F.col("doc_id") % 9 == 7, 2).otherwise(0)).otherwise(0).alias("kind"),
    )


def toc(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, f"case when doc_id % 5 = 0 then {FIRST_LINE} end")  # the only labels that show one
    a = d.filter("doc_id % 3 <> 0")
    label = F.when(F.col("doc_id") % 5 == 0, F.coalesce("text", F.concat(F.lit("Plate "), "doc"))).otherwise(F.concat(F.lit("Chapter "), "doc"))
    a = a.select("book_id", "doc", (F.col("spine_pos") * 2).alias("toc_pos"), (1 + F.col("doc_id") % 8).cast("int").alias("depth"), F.lit(None).cast("string").alias("fragment"), label.alias("label"))
    b = d.filter("doc_id % 5 = 1").select("book_id", "doc", (F.col("spine_pos") * 2 + 1).alias("toc_pos"), F.lit(2).alias("depth"), F.lit("mid").alias("fragment"), F.concat(F.lit("Part "), "doc").alias("label"))
    return a.unionByName(b)


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    n = lines(spark, sf).groupBy("book_id", "doc").agg(F.count("*").alias("n"))
    return n.select("book_id", "doc", F.lit("mid").alias("name"), F.expr("cast(n div 2 as int)").alias("line_idx"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    k = F.col("doc_id") % 4
    shown = F.when(k == 0, F.col("doc")).when(k == 1, F.concat(F.lit("["), "doc", F.lit("]"))).when(k == 2, F.substring("text", 1, 6)).otherwise(F.concat(F.lit("注"), "doc"))
    at = lambda s: F.concat(F.lit("d"), "doc", F.lit(s))
    a = d.select("book_id", (F.col("spine_pos") * 2).cast("long").alias("link_pos"), at("#n").alias("target"), shown.alias("text"), (F.col("doc_id") % 13 == 0).alias("declared"), F.array(at("#r")).alias("ids"), (F.col("doc_id") % 11 == 0).alias("whole"))
    b = d.filter("doc_id % 6 <> 5").select("book_id", (1000000000 + F.col("spine_pos") * 2).cast("long").alias("link_pos"), at("#r").alias("target"), F.lit("^").alias("text"), F.lit(False).alias("declared"), F.array(at("#n")).alias("ids"), F.lit(True).alias("whole"))
    return a.unionByName(b)
