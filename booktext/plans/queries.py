"""Registered queries of the book operators over the given tables, with their DuckDB SQL."""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from booktext.functions import css as C
from booktext.functions import text as X
from booktext.operators import assemble, extract, jobs, layout, notes
from booktext.operators import sections as S
from booktext.plans import archive_queries  # noqa: F401 - registers its queries
from booktext.plans import convert
from booktext.plans import fixtures as T
from booktext.plans.registry import ORACLES, QUERIES, query  # noqa: F401

WS = X.WS


def _n(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def _c(x: str) -> str:
    inner = rf"regexp_replace({x}, '[ \t\r\n\f\x0B]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({inner}, '^{WS}+', ''), '{WS}+$', '')"


def _texts(xs) -> str:
    return "[" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


#: A character reference: HTML's names, some of which need no semicolon, and numbers, some of which stand for others or for nothing.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;\x02]{1,32};?)"
_OTHERS = {n: html.unescape(f"&#{n};") for n in [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p + e for p in range(0, 0x110000, 0x10000) for e in (0xFFFE, 0xFFFF))]}
BLOCK_TAGS, TAG_END = "|".join(sorted(extract.BLOCKS - {"hr"})), r"(?:[\t\n\r\f /][^>]*)?>"
# chr(1) stands between lines, chr(2) where a tag inside a line was: a reference does not reach over it
PAGE_LINES = rf"""rn as (select unnest({_texts(html5)}) as name, unnest({_texts(html5.values())}) as said),
 ro as (select unnest({[*_OTHERS]}) as n, unnest({_texts(_OTHERS.values())}) as said),
 a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<rt\b.*?</rt>|<rp\b.*?</rp>','','g'),'(?s)<!--.*?-->','','g') h from pages),
 a2 as (select page_id, regexp_replace(regexp_replace(h, '(?i)<hr{TAG_END}', chr(1) || '{X.RULE}' || chr(1), 'g'), '(?i)</?(?:{BLOCK_TAGS}){TAG_END}|<br{TAG_END}', chr(1), 'g') h from a),
 b as (select page_id, unnest(s) t, generate_subscripts(s,1) n0 from (select page_id, string_split(regexp_replace(h, '<[a-zA-Z/!?][^>]*>', chr(2), 'g'), chr(1)) s from a2)),
 r0 as (select distinct unnest(regexp_extract_all(t, '{REFERENCE}')) as ref from b),
 r1 as (select ref, case when starts_with(lower(ref), '&#x') then try_cast('0x0' || ltrim(rtrim(substr(ref, 4), ';'), '0') as bigint) else try_cast('0' || ltrim(rtrim(substr(ref, 3), ';'), '0') as bigint) end as n from r0 where starts_with(ref, '&#')),
 rs as (select ref, case when r1.n is null or r1.n > 1114111 or r1.n between 55296 and 57343 then chr(65533) else coalesce(said, chr(cast(r1.n as int))) end as said from r1 left join ro on ro.n = r1.n
 union all select ref, coalesce(arg_max(said || substr(ref, length(name) + 2), length(name)), ref) from r0 left join rn on starts_with(ref, '&' || name) where not starts_with(ref, '&#') group by ref),
 b2 as (select page_id, n0, unnest(string_split_regex(t, '{REFERENCE}')) as part, unnest(regexp_extract_all(t, '{REFERENCE}')) as ref, generate_subscripts(string_split_regex(t, '{REFERENCE}'), 1) as k from b),
 b3 as (select page_id, n0, replace(string_agg(part || coalesce(said, ''), '' order by k), chr(2), '') as t from b2 left join rs using (ref) group by page_id, n0),
 c as (select page_id, n0, {_c('t')} as t from b3),
 plines as (select page_id, row_number() over (partition by page_id order by n0) - 1 line_idx, t as text from c where t <> '')"""


@query(f"with {PAGE_LINES} select page_id, cast(line_idx as int) as line_idx, text from plines")
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every page."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("").alias("book_id"), F.col("page_id").cast("string").alias("doc"), "html")
    rows = extract.table_of(extract.extract_documents(p, scan=False, tables=("lines",)), "lines")
    return rows.select(F.col("doc").cast("long").alias("page_id"), "line_idx", "text")


@query(
    f"""with {T.SP}, {PAGE_LINES}, l as (select sp.book_id, sp.spine_pos, p.line_idx, case when starts_with(language,'zh') or starts_with(language,'ja') then '　　' else '    ' end || p.text as t
 from plines p join sp on sp.doc = cast(p.page_id as varchar))
 select book_id, count(*) as n_lines, sha256(string_agg(t, chr(10) order by spine_pos, line_idx) || chr(10)) as text_sha256 from l group by book_id"""
)
def text_book_digests(spark: SparkSession, sf: str) -> DataFrame:
    """One text a host. Without the blanks that empty elements leave, which SQL cannot see."""
    docs = T.pages(spark, sf)
    carry = ("spine_pos", "language")
    rows = extract.table_of(extract.extract_documents(docs, scan=False, tables=("lines",), carry=carry), "lines", carry)
    blocks = rows.select("book_id", "spine_pos", "line_idx", X.body_line(F.col("text"), X.indent(F.col("language"))).alias("block"))
    order = ["spine_pos", "line_idx"]
    # a first paragraph counts as structural in the format; here the separator is one line feed throughout
    pieces = assemble.join_blocks(blocks, order, order[:1]).withColumn("sep", F.regexp_replace("sep", "\n+", "\n"))
    text = assemble.assemble_books(pieces, order, order[:1])
    # no line holds a line feed and each is ended by one; counting them apart would read all pages anew and lose those without an address
    return text.select("book_id", F.regexp_count("text", F.lit("\n")).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


@query()
def text_books(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: pages to one text a host."""
    return convert.text_books(T.pages(spark, sf))


@query(
    rf"""select doc_id, sha256({_c('text')}) as collapsed, sha256({_n('text')}) as normed, regexp_matches(text, '(1[6-9][0-9][0-9]|20[0-9][0-9])') as dated,
 regexp_matches(text, '^{WS}*(目次|目錄|目录|Contents|CONTENTS|TOC){WS}*[:：]?{WS}*$') as contents_label from documents"""
)
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P2, P19, P20 over whole texts."""
    d, t = spark.read.parquet(f"{sf}/documents.parquet"), F.col("text")
    return d.select("doc_id", F.sha2(X.collapse(t), 256).alias("collapsed"), F.sha2(X.norm(t), 256).alias("normed"), X.date_hint(t).alias("dated"), X.is_contents_label(t).alias("contents_label"))


_NAME = "lower(trim(string_split(p,'=')[1]))"
_TRACK = "(" + ",".join(f"'{x}'" for x in X.TRACKING) + ")"
CLEAN = f"""cl as (select page_id, url, string_split(url,'#')[1] base, substr(url, length(string_split(url,'#')[1])+1) frag from pages),
 cm as (select *, string_split(base,'?')[1] head, substr(base, length(string_split(base,'?')[1])+2) query, instr(base,'?') > 0 asked from cl),
 cn as (select *, list_filter(string_split(query,'&'), lambda p: p <> '' and {_NAME} not in {_TRACK} and not regexp_matches({_NAME}, '^(utm_|pk_|mtm_)')) kept from cm),
 co as (select page_id, url, case when not asked then url else head || case when len(kept) > 0 then '?' || array_to_string(kept,'&') else '' end || frag end as clean from cn)"""


@query(
    f"""with {CLEAN} select page_id, clean, regexp_matches(url, '^(?i)(https?|mailto|ftp|ftps|tel)\\s*:') as external,
 rtrim(regexp_replace(lower(url_decode(clean)), '^(https?://|mailto:)', ''), '/') = rtrim(regexp_replace(lower(url_decode(url)), '^(https?://|mailto:)', ''), '/') as same,
 regexp_matches('<' || url || '>', '^(?i)<[a-z][a-z0-9+.-]*:[^>]*>$') as lone from co"""
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """P3-P6 on the pages' addresses; `same` compares the cleaned address with the raw one, its own cleaning undone."""
    p, u = spark.read.parquet(f"{sf}/pages.parquet"), F.col("url")
    key = lambda c: F.rtrim(F.regexp_replace(F.lower(X.percent_decode(c)), "^(https?://|mailto:)", ""), F.lit("/"))
    c = X.clean_url(u)
    return p.select("page_id", c.alias("clean"), X.is_external(u).alias("external"), (key(c) == key(u)).alias("same"), X.is_lone_link(F.concat(F.lit("<"), u, F.lit(">"))).alias("lone"))


_CHANGED = r"""case page_id % 3 when 0 then string_split(url,'#')[1] || case when contains(string_split(url,'#')[1], '?') then '&' else '?' end || 'utm_x=1' || substr(url, length(string_split(url,'#')[1]) + 1)
 when 1 then regexp_replace(url, '^(https?://[^/?#]*)', '\1/elsewhere') else regexp_replace(upper(url), '^HTTPS?://', 'http://') end"""
_BOTH = f"from (select page_id * 2 as page_id, url from pages where url is not null union all select page_id * 2 + 1, {_CHANGED} from pages where url is not null)"


@query(
    f"""with {CLEAN.replace("from pages", _BOTH)}, ky as (select page_id, rtrim(regexp_replace(lower(url_decode(clean)), '^(https?://|mailto:)', ''), '/') as k from co)
 select a.page_id // 2 as page_id, a.k = b.k as same from ky a join ky b on b.page_id = a.page_id + 1 where a.page_id % 2 = 0"""
)
def page_same_target(spark: SparkSession, sf: str) -> DataFrame:
    """P5: a tracking parameter more (page_id % 3 = 0) or another scheme and case (2) is the same target, another path (1) is not."""
    p = spark.read.parquet(f"{sf}/pages.parquet").filter("url is not null")
    base, rest = F.substring_index("url", "#", 1), F.col("url")
    more = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("utm_x=1"), F.substring(rest, F.length(base) + 1, F.length(rest)))
    path = F.regexp_replace("url", r"^(https?://[^/?#]*)", "$1/elsewhere")
    swapped = F.regexp_replace(F.upper("url"), "^HTTPS?://", "http://")
    k = F.col("page_id") % 3
    return p.select("page_id", X.same_target(F.when(k == 0, more).when(k == 1, path).otherwise(swapped), F.col("url")).alias("same"))


_VIS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>',' ','g'), '(?is)<style\b.*?</style>|<script\b.*?</script>',' ','g'), '(?s)<[^>]*>',' ','g'), '&[a-zA-Z#0-9]+;',' ','g')"
_LEN = f"length({_n(_VIS)})"
_IMG = r"len(regexp_extract_all(html, '(?i)<im(?:g|age)\b'))"


@query(f"select page_id, {_LEN} as visible, cast({_IMG} as int) as images, {_IMG} = 1 and {_LEN} < 100 as single from pages")
def page_visible(spark: SparkSession, sf: str) -> DataFrame:
    """P7, P8."""
    h = F.col("html")
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", X.visible_length(h).cast("long").alias("visible"), X.image_refs(h).alias("images"), X.is_single_image_page(h).alias("single"))


@query(
    f"""with {T.SP}, v as (select book_id, strlen(html) <= 16384 and {_LEN} < 3000 as single from sp)
 select book_id, count(*) as n_pages, cast(sum(case when single then 1 else 0 end) as bigint) as n_single,
 sum(case when single then 1 else 0 end) >= 3 and sum(case when single then 1 else 0 end) * 10 >= count(*) * 7 as is_picture_book from v group by book_id"""
)
def picture_books(spark: SparkSession, sf: str) -> DataFrame:
    """A1 by host. The pages have no images, so a page whose visible text is under 3,000 gets one put in and the rest cut."""
    p = T.pages(spark, sf)
    short = X.visible_length(F.col("html")) < 3000
    html = F.when(short, F.lit("<p>x<img src='a'></p>")).otherwise(F.col("html"))
    rows = p.select("book_id", F.octet_length("html").alias("n_bytes"), html.alias("html"), F.lit(False).alias("pre_paginated"))
    return jobs.picture_book_verdict(rows)


_VERDICT = ORACLES["picture_books"].split("select book_id, count(*)")[0]


@query(
    f"""{_VERDICT}, g as (select book_id, sum(case when single then 1 else 0 end) s, count(*) n from v group by book_id)
 select book_id, case when s >= 3 and s * 10 >= n * 7 then 'image' else 'job' end as kind from g"""
)
def drop_picture_books(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that stay and books that go."""
    work = T.pages(spark, sf).select("book_id", F.concat("book_id", F.lit(".txt")).alias("target")).distinct()
    stay, gone = jobs.drop_picture_books(work, picture_books(spark, sf))
    return stay.select("book_id", F.lit("job").alias("kind")).unionByName(gone.select("book_id", "kind"))


def _by_lang(ja: str, ko: str, hans: str, hant: str, other: str) -> str:
    return f"case when starts_with(c,'ja') then '{ja}' when starts_with(c,'ko') then '{ko}' when starts_with(c,'zh') and regexp_matches(c,'hans|-cn|-sg|-my') then '{hans}' when starts_with(c,'zh') then '{hant}' else '{other}' end"


@query(
    f"""with x as (select doc_id, case doc_id % 7 when 0 then 'ja' when 1 then 'ko' when 2 then 'zh_Hans' when 3 then 'zh-TW' else lang end as l from documents), y as (select *, replace(lower(l),'_','-') c from x)
 select doc_id, {_by_lang('注', '주', '注', '註', 'Note')} as note, {_by_lang('図', '그림', '图', '圖', 'Fig')} as caption,
 case when starts_with(c,'zh') or starts_with(c,'ja') then '目次' else 'Contents' end as contents from y"""
)
def language_words(spark: SparkSession, sf: str) -> DataFrame:
    """P13."""
    k = F.col("doc_id") % 7
    lang = F.when(k == 0, "ja").when(k == 1, "ko").when(k == 2, "zh_Hans").when(k == 3, "zh-TW").otherwise(F.col("lang"))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", X.note_word(lang).alias("note"), X.caption_word(lang).alias("caption"), X.contents_word(lang).alias("contents"))


def _core(x: str, rounds: int) -> str:
    """marker_core() in SQL, for texts with at most so many words and brackets in front."""
    solid, gap = "[^" + WS[1:], f"{WS}*"
    x = f"regexp_replace(regexp_replace({x}, '^{gap}', ''), '{gap}$', '')"
    for _ in range(rounds):
        x = f"regexp_replace({x}, '(?s)^(?:註|注|주|Note|note){gap}({solid}.*)$', '\\1')"
        for a, b in X.BRACKETS:
            esc = "\\" if a in "[(<" else ""
            x = f"regexp_replace({x}, '(?s)^{esc}{a}{gap}({solid}.*?){gap}{esc}{b}$', '\\1')"
    return x


@query(f"with {T.SD}, {T.SLINKS}, c as (select book_id, link_pos, {_core('text', 3)} as c from slinks) select book_id, link_pos, regexp_matches(c, '{X.MARKER}') as marker, 'Note[' || c || ']' as label from c")
def note_markers(spark: SparkSession, sf: str) -> DataFrame:
    """P9-P11 on numbers, bracketed numbers, prefixed numbers and the first characters of texts."""
    rows = T.links(spark, sf)
    return rows.select("book_id", "link_pos", X.is_marker(F.col("text")).alias("marker"), X.note_label(F.lit("Note"), F.col("text")).alias("label"))


@query(
    f"""{T.DOCS} select book_id, toc_pos, doc, '--==' || repeat('#', least(greatest(depth,1),6)) || ' ' || label || ' ' || repeat('#', least(greatest(depth,1),6)) || '==--' as fence, '    ' || label as body from stoc"""
)
def toc_fences(spark: SparkSession, sf: str) -> DataFrame:
    """P21."""
    t = T.toc(spark, sf)
    return t.select("book_id", "toc_pos", "doc", X.fence(F.col("depth"), F.col("label")).alias("fence"), X.body_line(F.col("label"), F.lit("    ")).alias("body"))


@query(
    f"""with {T.SD} select doc_id, 'RTB-1' || chr(10) || 'Title: ' || case when doc_id % 3 = 0 then 'stem' || doc else 'T' || doc end || chr(10) || 'Author: a' || doc || chr(10) || 'Author: b'
 || case when doc_id % 2 = 0 then chr(10) || 'Publisher: ' || book_id else '' end || case when doc_id % 5 = 0 then chr(10) || 'Date: 1999' else '' end || case when coalesce(language, '') <> '' then chr(10) || 'Language: ' || language else '' end || chr(10) || 'Cover: ' || case when doc_id % 4 = 0 then 'True' else 'False' end as header
 from sd"""
)
def headers(spark: SparkSession, sf: str) -> DataFrame:
    """P22."""
    d = T.documents(spark, sf)
    n = F.col("doc_id")
    none = F.lit(None).cast("string")
    h = X.header_block(
        F.when(n % 3 != 0, F.concat(F.lit("T"), "doc")), F.array(F.concat(F.lit("a"), "doc"), F.lit("b")), F.when(n % 2 == 0, F.col("book_id")),
        F.lit(""), F.col("language"), none, none, n % 4 == 0, F.concat(F.lit("stem"), "doc"), F.when(n % 5 == 0, "1999"),
    )
    return d.select("doc_id", h.alias("header"))


@query(
    f"""with {T.SD}, sp2 as (select book_id, spine_pos, doc_id % 900 as item from sd),
 m as (select book_id, doc_id % 900 as item, min(spine_pos) sp, min(doc_id) d from sd group by all),
 m2 as (select book_id, item, 'p' || (d % 800) as doc, case when d % 11 = 0 then 'image/png' when d % 3 = 0 then '' else 'application/xhtml+xml' end media, d % 50 = 7 nav from m),
 j as (select sp2.book_id, spine_pos, cast(sp2.item as varchar) item_id, doc, row_number() over (partition by sp2.book_id, doc order by spine_pos) n from sp2 join m2 on sp2.book_id = m2.book_id and sp2.item = m2.item where (media = '' or media like '%html%') and not nav)
 select book_id, spine_pos, item_id, doc from j where n = 1"""
)
def reading_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Spine items named by doc_id % 900, paths that repeat, some images, some nav documents."""
    d = T.documents(spark, sf).withColumn("item", F.col("doc_id") % 900)
    spine = d.select("book_id", "spine_pos", F.col("item").cast("string").alias("item_id"))
    m = d.groupBy("book_id", "item").agg(F.min("doc_id").alias("d"))
    media = F.when(F.col("d") % 11 == 0, "image/png").when(F.col("d") % 3 == 0, "").otherwise("application/xhtml+xml")
    manifest = m.select("book_id", F.col("item").cast("string").alias("item_id"), F.concat(F.lit("p"), (F.col("d") % 800).cast("string")).alias("path"), media.alias("media"), (F.col("d") % 50 == 7).alias("is_nav"))
    return S.reading_docs(spine, manifest)


@query(r"""with s as (select page_id, regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1) l from pages), u as (select page_id, unnest(l) css, generate_subscripts(l,1) n from s)
 select page_id, cast(n - 1 as int) as sheet_pos, css from u""")
def page_stylesheets(spark: SparkSession, sf: str) -> DataFrame:
    """Inline style sheets."""
    from booktext.sources.archives import doc_stylesheets

    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("").alias("book_id"), F.col("page_id").cast("string").alias("doc"), "html")
    return doc_stylesheets(p, None).select(F.col("doc").cast("long").alias("page_id"), "sheet_pos", "css")


@query(r"""with s as (select page_id, regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1) l from pages), u as (select page_id, unnest(l) css from s),
 r as (select page_id, regexp_extract_all(css, '([^{};]+)\{([^{}]*)\}', 1) a, regexp_extract_all(css, '([^{};]+)\{([^{}]*)\}', 2) b from u),
 x as (select page_id, unnest(a) sel, unnest(b) d from r), y as (select page_id, trim(sel) sel, unnest(string_split(d,';')) d from x)
 select page_id, 'tag' as kind, lower(sel) as tag, lower(trim(string_split(d,':')[1])) as prop, trim(substr(d, instr(d,':')+1)) as value from y where regexp_matches(sel,'^[a-zA-Z][a-zA-Z0-9]*$') and lower(trim(string_split(d,':')[1])) in ('margin','margin-top','margin-bottom','font-family','border')""")
def page_css_rules(spark: SparkSession, sf: str) -> DataFrame:
    """X13 on inline style sheets."""
    from booktext.sources.archives import doc_stylesheets

    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("").alias("book_id"), F.col("page_id").cast("string").alias("doc"), "html")
    rules = extract.css_rules(doc_stylesheets(p, None))
    return rules.select(F.col("doc").cast("long").alias("page_id"), "kind", "tag", "prop", "value")


@query(f"{T.DOCS} select sd.book_id, sd.spine_pos, sd.doc, t.toc_pos, t.depth, t.fragment, t.label from sd left join stoc t on sd.book_id = t.book_id and sd.doc = t.doc")
def toc_for_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Some documents are not in the reading order, so their entries vanish."""
    return S.toc_for_docs(T.documents(spark, sf), T.toc(spark, sf))


_DECL = f"with {T.SD}, {T.SLINKS}, dk as (select book_id, 'd' || doc || '#n' as key from sd where doc_id % 17 = 0)"
_OWN = "ow as (select book_id, unnest(ids) as key, link_pos, target from slinks), o1 as (select book_id, key, min(link_pos) p, arg_min(target, link_pos) back from ow group by all)"
_PAIRS = f"""{_DECL}, {_OWN}, mp as (select distinct l.book_id, l.target as key from slinks l join o1 on o1.book_id = l.book_id and o1.key = l.target
 where not declared and not whole and coalesce(l.text,'') <> '' and o1.p > l.link_pos and list_contains(l.ids, o1.back) and not exists (select 1 from dk where dk.book_id = l.book_id and dk.key = l.target))"""


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    return T.documents(spark, sf).filter("doc_id % 17 = 0").select("book_id", F.concat(F.lit("d"), "doc", F.lit("#n")).alias("key"))


@query(f"{_PAIRS} select book_id, key from mp")
def mutual_note_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J5."""
    return notes.mutual_note_pairs(T.links(spark, sf), _declared(spark, sf))


_KEYS = f"{_PAIRS}, nk as (select book_id, key from dk union select book_id, key from mp)"


@query(f"{_KEYS} select book_id, key from nk")
def note_keys(spark: SparkSession, sf: str) -> DataFrame:
    """U1."""
    return notes.all_note_keys(_declared(spark, sf), mutual_note_pairs(spark, sf))


_LABELS = rf"""{_KEYS}, nl as (select l.book_id, l.target as key, arg_min(l.text, l.link_pos) as text, min(l.link_pos) as first_pos from slinks l left join nk on nk.book_id = l.book_id and nk.key = l.target
 where coalesce(l.text,'') <> '' and (l.declared or nk.key is not null) group by all)"""


@query(f"{_LABELS} select book_id, key, text, first_pos from nl")
def note_labels(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    return notes.note_labels(T.links(spark, sf), note_keys(spark, sf)).drop("marker")


@query(
    rf"""{_LABELS}, sg as (select book_id, 'd' || doc || '#n' as key, spine_pos // 8 as g from sd where doc_id % 2 = 0), w as (select nl.*, coalesce('g' || g, 'k' || nl.key) as unit from nl left join sg on sg.book_id = nl.book_id and sg.key = nl.key
 where not regexp_matches({_core('text', 6)}, '{X.MARKER}')), v as (select *, min(first_pos) over (partition by book_id, unit) a from w)
 select book_id, key, cast(dense_rank() over (partition by book_id order by a) as int) as star from v"""
)
def star_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of up to eight documents' notes. Words are at most six characters, so six rounds of the SQL peel all of them."""
    g = T.documents(spark, sf).filter("doc_id % 2 = 0").select("book_id", F.concat(F.lit("d"), "doc", F.lit("#n")).alias("key"), F.expr("spine_pos div 8").alias("group_id"))
    return notes.star_numbers(notes.note_labels(T.links(spark, sf), note_keys(spark, sf)), g)


@query(
    f"""{T.DOCS}, an as (select book_id, doc, count(*) // 2 as s from slines group by all), e as (select t.*, case when fragment is null then 0 else coalesce(s, 0) end as start from stoc t left join an using (book_id, doc)),
 f as (select *, lead(start) over (partition by book_id, doc order by start, toc_pos) nx from e)
 select l.book_id, l.doc, l.line_idx, l.text, f.toc_pos, f.depth, f.label from slines l join f on f.book_id = l.book_id and f.doc = l.doc and l.line_idx >= f.start and (nx is null or l.line_idx < nx)"""
)
def section_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines under their TOC entry."""
    return S.section_lines(T.lines(spark, sf), T.anchors(spark, sf), T.toc(spark, sf))


_CONTENTS = f"""{T.DOCS}, lab as (select distinct book_id, {_n('label')} k from stoc), r as (select l.* from slines l where not exists (select 1 from stoc t where t.book_id = l.book_id and t.doc = l.doc)),
 sc as (select book_id, doc, line_idx, text from r union all select book_id, 'c' || book_id, 0, 'Contents' from sd group by all union all select book_id, 'c' || book_id, cast(row_number() over (partition by book_id order by toc_pos) as int), label from stoc)"""


@query(
    f"""{_CONTENTS}, q as (select sc.book_id, sc.doc, count(*) as n_lines, count(lab.k) as n_hits from sc left join lab on lab.book_id = sc.book_id and lab.k = {_n('sc.text')}
 where not (line_idx = 0 and regexp_matches(text, '^(目次|目錄|目录|Contents|CONTENTS|TOC)[:：]?$')) group by all) select * from q where n_lines >= 3 and n_hits >= 3 and n_hits * 100 >= n_lines * 70"""
)
def contents_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A2: a contents page a book is put in."""
    t = T.toc(spark, sf)
    doc = F.concat(F.lit("c"), "book_id").alias("doc")
    head = T.documents(spark, sf).select("book_id").distinct().select("book_id", doc, F.lit(0).alias("line_idx"), F.lit("Contents").alias("text"))
    body = t.select("book_id", doc, F.row_number().over(W.partitionBy("book_id").orderBy("toc_pos")).alias("line_idx"), F.col("label").alias("text"))
    return S.contents_pages(T.lines(spark, sf).select("book_id", "doc", "line_idx", "text").unionByName(head).unionByName(body), t)


_TITLES = f"""{T.DOCS}, bk as (select distinct book_id, 'Title ' || book_id as title, 'Some One' as author, 'Press' as publisher from sd),
 tl as (select book_id, spine_pos, doc, doc_id, unnest([0,1,2]) line_idx, unnest(['Title ' || book_id, 'Some  One', case when doc_id % 4 = 0 then 'Press' else 'Press ' || (1900 + doc_id % 150) end]) as text from sd)"""
_TP = f"""{_TITLES}, r as (select * from tl where not exists (select 1 from stoc t where t.book_id = tl.book_id and t.doc = tl.doc)),
 tp as (select book_id, doc, count(*) as n_lines, arg_min(case when length(text) <= 24 and regexp_matches(text,'1[6-9][0-9]{{2}}|20[0-9]{{2}}') then text end, line_idx) as guessed_date from r group by all)"""


def _title_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = T.documents(spark, sf)
    third = F.when(F.col("doc_id") % 4 == 0, "Press").otherwise(F.concat(F.lit("Press "), (1900 + F.col("doc_id") % 150).cast("string")))
    return d.select("book_id", "spine_pos", "doc", F.posexplode(F.array(F.concat(F.lit("Title "), "book_id"), F.lit("Some  One"), third)).alias("line_idx", "text"))


def _title_books(spark: SparkSession, sf: str) -> DataFrame:
    return T.documents(spark, sf).select("book_id").distinct().select("book_id", F.concat(F.lit("Title "), "book_id").alias("title"), F.array(F.lit("Some One")).alias("authors"), F.lit("Press").alias("publisher"))


@query(f"{_TP} select * from tp")
def title_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A title page for each document."""
    return S.title_pages(_title_lines(spark, sf), T.toc(spark, sf), _title_books(spark, sf))


@query(
    f"""{_TP}, x as (select sd.book_id, sd.spine_pos, sd.doc, tp.doc is not null as is_title, tp.guessed_date from sd left join tp using (book_id, doc)),
 y as (select *, coalesce(sum(case when is_title and guessed_date is not null then 1 else 0 end) over (partition by book_id order by spine_pos rows between unbounded preceding and 1 preceding), 0) b from x)
 select book_id, spine_pos, doc, is_title and b = 0 as dropped from y"""
)
def title_page_cut(spark: SparkSession, sf: str) -> DataFrame:
    """W5."""
    t = title_pages(spark, sf).select("book_id", "doc", "guessed_date", F.lit(True).alias("is_title"))
    d = T.documents(spark, sf).select("book_id", "spine_pos", "doc").join(t, ["book_id", "doc"], "left").fillna(False, ["is_title"])
    return S.title_page_cut(d).select("book_id", "spine_pos", "doc", "dropped")


@query("with n as (select distinct source as book_id, unnest(['Title'||source, 'SomeOne', 'Press']) as name from documents) select * from n")
def known_names(spark: SparkSession, sf: str) -> DataFrame:
    """U3."""
    return S.known_names(_title_books(spark, sf))


@query(
    f"""{T.DOCS}, k as (select book_id, doc, spine_pos, doc_id % 7 <> 0 and doc_id % 10 <> 4 as kept from sd),
 l as (select *, min(case when kept then spine_pos end) over (partition by book_id order by spine_pos rows between current row and unbounded following) as land_pos from k)
 select l.book_id, l.doc, t.toc_pos, t.depth, t.fragment, t.label, l.land_pos, l.spine_pos from stoc t join l using (book_id, doc)"""
)
def carry_toc_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of documents without text land on the next kept one."""
    d = T.documents(spark, sf).select("book_id", "spine_pos", "doc", (F.col("doc_id") % 7 != 0).alias("has_text"), (F.col("doc_id") % 10 == 4).alias("skipped"))
    return S.carry_toc_forward(d, T.toc(spark, sf))


_SECT = ORACLES["section_lines"]


@query(
    f"""with s0 as ({_SECT}), s as (select s0.*, (line_idx * 7 + toc_pos) % 3 as kind, row_number() over (partition by book_id, doc, toc_pos order by line_idx) n, count(*) over (partition by book_id, doc, toc_pos) m,
 {_n("text || coalesce(lead(text) over (partition by book_id, doc, toc_pos order by line_idx), '')")} pair, {_n('text')} t, {_n('label')} lb from s0),
 c as (select *, max(case when n = 1 and t = lb then 1 when n = 1 and m > 1 and pair = lb then 2 else 0 end) over (partition by book_id, doc, toc_pos) cut from s),
 d as (select *, min(case when kind in (1,2) and t <> '' and contains(lb, t) then 1 else 0 end) over (partition by book_id, doc, toc_pos order by line_idx rows between unbounded preceding and current row) streak from c where n > cut)
 select book_id, doc, toc_pos, line_idx, text from d where streak = 0"""
)
def strip_repeated_title(spark: SparkSession, sf: str) -> DataFrame:
    """W6."""
    s = section_lines(spark, sf).withColumn("kind", (F.col("line_idx") * 7 + F.col("toc_pos")) % 3)
    return S.strip_repeated_title(s).select("book_id", "doc", "toc_pos", "line_idx", "text")


@query(
    f"""with {T.SD}, {T.SL}, {T.SLINES}, st as (select *, doc_id % 5 = 2 and line_idx = 0 as ss from slines), w as (select *, lag(kind) over (partition by book_id order by spine_pos, line_idx) pk from st)
 select book_id, doc, line_idx, cast(case when pk <> 0 and not ss then 0 when kind <> 0 then 1 else blanks end as int) as runs from w"""
)
def heading_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """W8."""
    rows = T.lines(spark, sf).withColumn("section_start", (F.col("doc_id") % 5 == 2) & (F.col("line_idx") == 0)).withColumn("indent", F.lit("    "))
    return assemble.heading_spacing(rows).select("book_id", "doc", "line_idx", "runs")


_BLK = f"""{T.DOCS}, u as (select book_id, spine_pos, -1 as i, '--==' || repeat('#', least(depth,6)) || ' ' || label || ' ' || repeat('#', least(depth,6)) || '==--' as block, true as f, depth, label from stoc join sd using (book_id, doc) where fragment is null
 union all select book_id, spine_pos, line_idx * 10 + 9, '    ' || text, false, 0, null from slines
 union all select book_id, spine_pos, line_idx * 10 + k, '', false, 0, null from slines, (select unnest(range(1,3)) k) where k <= blanks),
 v as (select *, max(case when f then 1 else 0 end) over (partition by book_id order by spine_pos, i rows between unbounded preceding and current row) seen from u),
 cw as (select book_id, case when min(language) like 'zh%' then '目次' else 'Contents' end w from sd group by all),
 p as (select book_id, case when seen = 1 then 3 else 1 end as part, spine_pos, i, block from v union all
 select book_id, 2, min(spine_pos), -1, '--==# ' || any_value(w) || ' #==--' || chr(10) || string_agg(repeat('  ', depth - 1) || label, chr(10) order by spine_pos) from u join cw using (book_id) where f group by book_id)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    t = T.toc(spark, sf).filter("fragment is null").join(T.documents(spark, sf).select("book_id", "doc", "spine_pos"), ["book_id", "doc"])
    pos = lambda i: F.struct(F.col("spine_pos").cast("int").alias("spine_pos"), i.cast("int").alias("i")).alias("pos")
    a = t.select("book_id", pos(F.lit(-1)), X.fence(F.col("depth"), F.col("label")).alias("block"), F.lit(True).alias("is_fence"), "depth", "label")
    x = T.lines(spark, sf)
    none = [F.lit(False).alias("is_fence"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("label")]
    b = x.select("book_id", pos(F.col("line_idx") * 10 + 9), X.body_line(F.col("text"), F.lit("    ")).alias("block"), *none)
    c = x.filter("blanks > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "blanks"))).select("book_id", pos(F.col("line_idx") * 10 + F.col("k")), F.lit("").alias("block"), *none)
    return a.unionByName(b).unionByName(c)


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    books = T.documents(spark, sf).groupBy("book_id").agg(F.min("language").alias("language"))
    return assemble.place_contents(_blocks(spark, sf), books)


@query(f"{_BLK} select book_id, cast(part as int) as part, cast(spine_pos as int) as spine_pos, cast(i as int) as i, block from p")
def place_contents(spark: SparkSession, sf: str) -> DataFrame:
    """W9."""
    return _placed(spark, sf).select("book_id", "part", "pos.spine_pos", "pos.i", "block")


_JOINED = f"""{_BLK}, o as (select *, sum(case when block = '' then 1 else 0 end) over (partition by book_id order by part, spine_pos, i rows between unbounded preceding and current row) b from p),
 z as (select *, starts_with(block,'--==') s, row_number() over (partition by book_id order by part, spine_pos, i) n, lag(starts_with(block,'--==')) over (partition by book_id order by part, spine_pos, i) ps,
 b - lag(b) over (partition by book_id order by part, spine_pos, i) g from o where block <> ''),
 sp1 as (select *, case when n = 1 then '' when s or ps or n = 2 then chr(10) || chr(10) else chr(10) || repeat(chr(10), cast(g as int)) end sep from z)"""


@query(f"{_JOINED} select book_id, sha256(string_agg(sep || block, '' order by part, spine_pos, i) || chr(10)) as text_sha256, cast(length(string_agg(sep || block, '' order by part, spine_pos, i)) + 1 as int) as n_chars from sp1 group by book_id")
def assembled_books(spark: SparkSession, sf: str) -> DataFrame:
    """Whole books from the documents."""
    pieces = assemble.join_blocks(_placed(spark, sf), ["part", "pos"], ["part", "pos.spine_pos"])
    b = assemble.assemble_books(pieces, ["part", "pos"], ["part", "pos.spine_pos"])
    return b.select("book_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"))


_STYLE = f"""with {T.SD}, {T.SL}, {T.SLINES}, ss as (select book_id, doc, line_idx, blanks, case when line_idx % 4 = 3 then 'serif' else 'sans' end font, case line_idx % 3 when 0 then 0.0 when 1 then 8.0 else 21.0 end top, 8.0 bottom, line_idx // 2 as owner, kind <> 0 as heading from slines),
 pr as (select *, lag(heading) over q ph, lag(owner) over q po, lag(bottom) over q pb, lag(font) over q pf from ss window q as (partition by book_id, doc order by line_idx)),
 cm as (select *, coalesce(not heading and not ph and owner <> po, false) ok from pr), gp as (select *, case when ok then greatest(pb, top) end gap from cm),
 gn as (select book_id, doc, gap, count(*) n from gp where gap is not null group by all), og as (select book_id, doc, gap as ordinary from (select *, row_number() over (partition by book_id, doc order by n desc, gap) r from gn) where r = 1)"""


@query(f"{_STYLE} select gp.book_id, gp.doc, gp.line_idx, gap, cast(greatest(blanks, case when ok and (font is distinct from pf or gap - coalesce(ordinary, 0) >= 8) then 1 else 0 end) as int) as new_blanks from gp left join og using (book_id, doc)")
def style_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """W1, A6."""
    n = F.col("line_idx")
    rows = T.lines(spark, sf).select(
        "book_id", "doc", "line_idx", "blanks", F.when(n % 4 == 3, "serif").otherwise("sans").alias("font"), F.when(n % 3 == 0, 0.0).when(n % 3 == 1, 8.0).otherwise(21.0).alias("top"),
        F.lit(8.0).alias("bottom"), F.expr("line_idx div 2").alias("owner"), (F.col("kind") != 0).alias("heading"), F.lit(True).alias("styled"),
    )
    return layout.style_gaps(rows).select("book_id", "doc", "line_idx", "gap", "new_blanks")


@query(f"{_STYLE} select book_id, doc, ordinary from og")
def ordinary_gap(spark: SparkSession, sf: str) -> DataFrame:
    """A6."""
    return layout.ordinary_gap(style_gaps(spark, sf))


_RULES = f"""with {T.SD}, {T.SL}, {T.SLINES}, rl as (select book_id, doc, line_idx, blanks, case when (doc_id + line_idx) % 5 in (2,3) then repeat('-',20) else text end as text from slines),
 f as (select *, coalesce(text = repeat('-',20) and lag(text) over (partition by book_id, doc order by line_idx) = repeat('-',20), false) fo from rl),
 g as (select *, sum(case when fo then 0 else 1 end) over (partition by book_id, doc order by line_idx rows between unbounded preceding and current row) isl from f),
 h as (select *, max(blanks) over (partition by book_id, doc, isl) mb from g), k as (select *, lag(text) over (partition by book_id, doc order by line_idx) pt from h where not fo)"""


@query(f"{_RULES} select book_id, doc, line_idx, text, cast(case when text = repeat('-',20) or pt = repeat('-',20) then least(mb, 1) else mb end as int) as blanks from k")
def collapse_rules(spark: SparkSession, sf: str) -> DataFrame:
    """W3."""
    rule = (F.col("doc_id") + F.col("line_idx")) % 5
    rows = T.lines(spark, sf).select("book_id", "doc", "line_idx", "blanks", F.lit(0).alias("sub"), F.when(rule.isin(2, 3), F.lit(X.RULE)).otherwise(F.col("text")).alias("text"))
    return layout.collapse_rules(rows).drop("sub")


_JOBS = """j as (select '/lib/' || coalesce(source, 'none') || '/' || (doc_id % 3) || '/b' || (doc_id // 3) || '.epub' as book_id, min(doc_id) as d, min(length(text)) as n_chars from documents group by 1)"""


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A book of each document: three by three they have one stem."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    s = lambda c: c.cast("string")
    path = F.concat(F.lit("/lib/"), F.coalesce("source", F.lit("none")), F.lit("/"), s(F.col("doc_id") % 3), F.lit("/b"), s(F.expr("doc_id div 3")), F.lit(".epub"))
    return d.groupBy(path.alias("book_id")).agg(F.min("doc_id").alias("d"), F.min(F.length("text")).alias("n_chars"))


@query(f"""with {_JOBS}, t as (select book_id, '/out/' || regexp_extract(book_id, '([^/]*)\\.epub$', 1) || '.txt' as flat, '/out/' || substr(replace(book_id, '.epub', '.txt'), 6) as mirrored, replace(book_id, '.epub', '.txt') as beside from j),
 r as (select *, row_number() over (partition by flat order by string_split(book_id, '/')) n from t) select book_id, beside, mirrored, case when n = 1 then flat end as flat from r""")
def plan_targets(spark: SparkSession, sf: str) -> DataFrame:
    """S2 in its three layouts."""
    b = _jobs(spark, sf)
    a = jobs.plan_targets(b, "/lib", None).withColumnRenamed("target", "beside")
    m = jobs.plan_targets(b, "/lib", "/out").withColumnRenamed("target", "mirrored")
    f = jobs.plan_targets(b, "/lib", "/out", mirror=False).withColumnRenamed("target", "flat")
    return a.join(m, "book_id").join(f, "book_id", "left")


_OUT = f"""with {_JOBS}, w as (select book_id, replace(book_id, '.epub', '.txt') as target, d, n_chars from j), oc as (select book_id, target, case when d % 3 = 0 then 'skip' when d % 10 = 1 or n_chars is null then 'fail' else 'ok' end as kind,
 case when d % 3 = 0 then '' when d % 10 = 1 then 'bad zip' when n_chars is null then 'no text' else 'B' || d || ' (' || n_chars || ' chars)' end as detail from w)"""


@query(f"{_OUT} select * from oc")
def job_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """S13, S14, U2."""
    b = _jobs(spark, sf)
    work = jobs.plan_targets(b, "/lib", None)
    there = work.join(b, "book_id").filter("d % 3 = 0").select("target")
    none = F.lit(None).cast("string")
    bad = F.col("d") % 10 == 1
    texts = b.select("book_id", F.concat(F.lit("B"), F.col("d").cast("string")).alias("title"), "n_chars", F.when(bad, "bad zip").otherwise(none).alias("error"))
    done = jobs.outcomes(jobs.pending_jobs(work, there), texts)
    return done.unionByName(jobs.kept_jobs(work, there))


@query(f"{_OUT} select kind, count(*) as n from oc group by kind")
def outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    """S14."""
    return jobs.tally(job_outcomes(spark, sf))


@query(f"{_OUT} select count(*) filter (where kind = 'ok') as n_ok, count(*) filter (where kind = 'skip') as n_kept, count(*) filter (where kind = 'fail') as n_failed, count(*) filter (where kind = 'image') as n_image from oc")
def library_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    return jobs.library_summary(job_outcomes(spark, sf))


@query(f"""with {T.SP}, z as (select book_id, cast(sum(strlen(html)) as bigint) bi, cast(sum({_LEN}) as bigint) bo from sp group by all)
 select cast(sum(bi) as bigint) as total_in, cast(sum(bo) as bigint) as total_out, sum(bo) / sum(bi) as ratio, median(bo / bi) as median_ratio, min(bo / bi) as min_ratio from z""")
def size_report(spark: SparkSession, sf: str) -> DataFrame:
    """A8."""
    p = T.pages(spark, sf)
    sizes = p.groupBy("book_id").agg(F.sum(F.octet_length("html").cast("long")).alias("bytes_in"), F.sum(X.visible_length(F.col("html")).cast("long")).alias("bytes_out"))
    return jobs.size_report(sizes)


@query(r"""select doc_id, sha256('--==[ Cover ]==--' || chr(10) || rtrim(regexp_replace(base64(encode(coalesce(text, ''))), '(.{76})', '\1' || chr(10), 'g'), chr(10)) || chr(10) || '--==[ /Cover ]==--') as cover from documents""")
def cover_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """S15."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.sha2(X.cover_block(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), 256).alias("cover"))


@query(f"with {T.SD}, {T.SL}, {T.SLINES} select doc_id, cast(line_idx as int) as line_idx, text from slines where line_idx < 8")
def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """O4."""
    return S.first_lines(T.lines(spark, sf)).select("doc_id", "line_idx", "text")


@query(f"with {_JOBS} select book_id, row_number() over (order by string_split(book_id, '/')) as place from j")
def library_order(spark: SparkSession, sf: str) -> DataFrame:
    """O1: all books in path order."""
    return S.library_order(_jobs(spark, sf).select("book_id"))


@query(f"{T.DOCS}, r as (select book_id, doc, toc_pos, case when fragment is null then 0 else 1 end as start from stoc) select book_id, doc, toc_pos, cast(row_number() over (partition by book_id, doc order by start, toc_pos) as int) as place from r")
def section_order(spark: SparkSession, sf: str) -> DataFrame:
    """O2: sections of a document by start, then TOC order."""
    t = T.toc(spark, sf).withColumn("start", F.when(F.col("fragment").isNull(), 0).otherwise(1))
    return t.select("book_id", "doc", "toc_pos", F.row_number().over(W.partitionBy("book_id", "doc").orderBy("start", "toc_pos")).alias("place"))


_WORDS4 = "['t' || doc_id, 'r' || doc_id, 'b' || doc_id, 'l' || doc_id]"


@query(
    f"""with u as (select doc_id, source, {_WORDS4} w, doc_id % 4 + 1 k, doc_id % 40 + 0.5::double x, doc_id % 9 c from documents)
 select doc_id, case when doc_id % 11 = 10 then null else x * case c when 0 then 1.0::double when 1 then 16.0::double when 2 then 16.0::double when 3 then 96.0::double / 72 when 4 then 16.0::double
  when 5 then 96.0::double when 6 then 96.0::double / 2.54::double when 7 then 96.0::double / 25.4::double else 1.0::double end end as pixels, w[1] as top_side, w[least(k, 2)] as right_side,
  case when k <= 2 then w[1] else w[3] end as bottom_side, case when k = 4 then w[4] else w[least(k, 2)] end as left_side, lower('font ' || source || ',serif') as font from u"""
)
def css_values(spark: SparkSession, sf: str) -> DataFrame:
    """A length in each unit, shorthands of one to four values, font lists."""
    d, n = spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id")
    units = F.array(*map(F.lit, ["px", "em", "rem", "pt", "pc", "in", "cm", "mm", ""]))
    s = lambda c: c.cast("string")
    length = F.when(n % 11 == 10, "auto").otherwise(F.concat(s(n % 40), F.lit(".5"), F.get(units, (n % 9).cast("int"))))
    words = F.array_join(F.slice(F.array(*[F.concat(F.lit(x), s(n)) for x in "trbl"]), F.lit(1), (n % 4 + 1).cast("int")), "  ")
    sides = [C.css_side(words, side).alias(f"{side}_side") for side in C.SIDES]
    return d.select("doc_id", C.css_length(length).alias("pixels"), *sides, C.font_key(F.concat(F.lit("\"Font "), "source", F.lit("\" , 'SERIF'"))).alias("font"))


@query(
    """with b as (select doc_id, ['solid', 'dashed', 'none', 'hidden', 'double'][doc_id % 5 + 1] not in ('none', 'hidden') as drawn, doc_id % 7 = 5 as cleared from documents)
 select doc_id, drawn and not cleared as top_drawn, drawn as left_drawn, drawn as framed from b"""
)
def css_borders(spark: SparkSession, sf: str) -> DataFrame:
    """A shorthand for all sides, and a style of its own for some top sides."""
    d, n = spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id")
    style = F.get(F.array(*map(F.lit, ["solid", "dashed", "none", "hidden", "double"])), (n % 5).cast("int"))
    whole = F.create_map(F.lit("border"), F.concat((n % 3 + 1).cast("string"), F.lit("px "), style))
    props = F.when(n % 7 == 5, F.map_concat(whole, F.create_map(F.lit("border-top-style"), F.lit("none")))).otherwise(whole)
    return d.select("doc_id", C.border_visible(props, "top").alias("top_drawn"), C.border_visible(props, "left").alias("left_drawn"), C.is_framed(props).alias("framed"))


@query(
    """with t as (select doc_id, string_split(lower(['footnote', 'chapter endnotes', 'Rearnote x', 'FOOTNOTES', 'footnoted'][doc_id % 5 + 1] || ' ' || ['doc-endnote', 'doc-footnotes', ''][doc_id % 3 + 1]), ' ') w from documents)
 select doc_id, list_has_any(w, ['footnote', 'endnote', 'rearnote', 'doc-footnote', 'doc-endnote', 'doc-note']) as element,
  list_has_any(w, ['footnotes', 'endnotes', 'rearnotes', 'doc-footnotes', 'doc-endnotes', 'doc-rearnotes']) as area from t"""
)
def note_elements(spark: SparkSession, sf: str) -> DataFrame:
    """P23."""
    d, n = spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    kind, role = pick(["footnote", "chapter endnotes", "Rearnote x", "FOOTNOTES", "footnoted"]), pick(["doc-endnote", "doc-footnotes", ""])
    return d.select("doc_id", C.is_note_element(kind, role, F.lit("")).alias("element"), C.is_note_area(kind, role).alias("area"))


_SHOWN = "case doc_id % 5 when 0 then '[' || doc_id || ']' when 1 then '注 ' || doc_id when 2 then '(註［' || doc_id || '］)' when 3 then '【 * 】' else 'Note' || doc_id end"


@query(f"select doc_id, regexp_extract({_SHOWN}, '[0-9*]+') as core from documents")
def marker_cores(spark: SparkSession, sf: str) -> DataFrame:
    """P9."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", X.marker_core(F.expr(_SHOWN)).alias("core"))


@query(
    """with m as (select doc_id, 'w' || doc_id as a, '(' || ['註', '注', '주', 'Note'][doc_id % 4 + 1] || '[' || doc_id || '])' as mark, ['', '。', 'next', ', then'][doc_id // 4 % 4 + 1] as b from documents)
 select doc_id, a || ' ' || mark || case when regexp_matches(b, '^[a-z]') then ' ' else '' end || b as spaced from m"""
)
def mark_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """Marks with none to two blanks, ASCII or ideographic, on either side."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = F.col("doc_id")
    pick = lambda k, *values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    blank = lambda k: pick(k, "", " ", "　", "　 ")
    mark = F.concat(F.lit("("), pick(n, "註", "注", "주", "Note"), F.lit("["), n.cast("string"), F.lit("])"))
    text = F.concat(F.lit("w"), n.cast("string"), blank(n % 7), mark, blank(n % 5), pick(F.floor(n / 4), "", "。", "next", ", then"))
    return d.select("doc_id", X.space_note_marks(text).alias("spaced"))


@query("select doc_id, 'OEBPS/' || case doc_id % 3 when 0 then source || '/x' || doc_id || '.html' when 1 then 'y+' || doc_id else source || '/a/ z' || doc_id end as path from documents")
def resolved_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses inside an archive seen from a document's folder: parent steps, dots, empty parts, escapes."""
    d, n = spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id")
    s = n.cast("string")
    href = F.when(n % 3 == 0, F.concat(F.lit("x"), s, F.lit(".html"))).when(n % 3 == 1, F.concat(F.lit("../y+"), s)).otherwise(F.concat(F.lit("./a//%20z"), s))
    return d.select("doc_id", X.resolve_path(F.concat(F.lit("OEBPS/"), "source", F.lit("/")), href).alias("path"))


@query(
    f"""with {T.SD}, {T.SL}, {T.SLINES}, bx as (select book_id, doc, doc_id, count(*) // 2 as last from slines where doc_id % 3 = 0 and doc_id % 4 <> 0 group by all),
 l as (select s.*, b.doc is not null and s.line_idx = 0 as above, b.doc is not null and b.doc_id % 2 = 1 and s.line_idx = b.last as below from slines s left join bx b on b.book_id = s.book_id and b.doc = s.doc)
 select book_id, doc, line_idx, 0 as sub, repeat('-', 20) as text, blanks from l where above union all select book_id, doc, line_idx, 1, text, case when above then 0 else blanks end from l
 union all select book_id, doc, line_idx, 2, repeat('-', 20), 0 from l where below"""
)
def border_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A box round the first half of some documents, with all borders or a top one; tables are among the boxes."""
    n = F.col("doc").cast("long")
    props = F.create_map(F.when(n % 2 == 1, "border").otherwise("border-top"), F.lit("1px solid"))
    boxes = T.anchors(spark, sf).filter(n % 3 == 0).select("book_id", "doc", F.lit(0).alias("first_idx"), F.col("line_idx").alias("last_idx"), F.when(n % 4 == 0, "td").otherwise("div").alias("tag"), props.alias("props"))
    return layout.border_lines(T.lines(spark, sf).select("book_id", "doc", "line_idx", "text", "blanks"), boxes)


_BODY = f"""with {T.SD}, {T.SL}, {T.SLINES}, bs as (select *, 1 + doc_id % 3 * 0.5::double as size, (doc_id + line_idx) % 5 < 3 as indented from slines),
 bn as (select book_id, size, count(*) n, min(cast(spine_pos as bigint) * 10000000 + line_idx) p, sum(case when indented then 1 else 0 end) n_in from bs group by all),
 body as (select book_id, size, indented from (select *, row_number() over (partition by book_id order by n desc, p) r, sum(n_in) over (partition by book_id) * 2 > sum(n) over (partition by book_id) as indented from bn) where r = 1)"""


@query(f"{_BODY} select * from body")
def body_styles(spark: SparkSession, sf: str) -> DataFrame:
    """A5: a third of the documents each at three sizes."""
    n = F.col("doc_id")
    size = F.when(n % 3 != 0, 1 + n % 3 * F.lit(0.5))
    return layout.body_style(T.lines(spark, sf).select("book_id", "spine_pos", "line_idx", size.alias("size"), ((n + F.col("line_idx")) % 5 < 3).alias("indented")))


@query(
    f"""{_BODY}, h as (select s.*, doc_id % 9 = 4 and line_idx % 5 = 0 as h2, line_idx % 6 = 0 and doc_id % 8 = 3 as boxed, coalesce(case line_idx % 3 when 0 then 0.8::double when 2 then 1.5::double end, b.size) ls, b.size as bs, b.indented as bi
  from slines s join body b on s.book_id is not distinct from b.book_id)
 select book_id, doc, line_idx, cast(case when doc_id % 11 = 0 then 0 when h2 then case when boxed or doc_id % 4 = 1 then 2 else 1 end when boxed then 2 when line_idx % 7 = 3 and ls < bs and doc_id % 2 = 0 then 3
  when line_idx = 0 then 1 when bi and line_idx % 6 in (0, 1) and ls > bs and line_idx % 4 <> 0 then case when doc_id % 5 = 0 then 2 else 1 end else 0 end as int) as kind from h"""
)
def sub_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings by tag, box, place after an image, first line, size and indent."""
    n, i = F.col("doc_id"), F.col("line_idx")
    run = lambda t, framed, heavier: F.struct(t.alias("text"), framed.alias("framed"), F.lit(heavier).alias("heavier"))
    none = F.lit(False)
    whole = F.array(run(F.col("text"), n % 8 == 3, True))
    two = F.array(run(F.substring("text", 1, 3), none, False), run(F.substring(F.col("text"), F.lit(4), F.length("text")), none, False))
    rows = T.lines(spark, sf).select(
        "book_id", "doc", "line_idx", "text", F.when((n % 9 == 4) & (i % 5 == 0), "h2").otherwise("p").alias("tag"), (n % 4 == 1).alias("framed"), (n % 11 == 0).alias("in_notes"),
        (i % 7 == 3).alias("after_image"), (n % 2 == 0).alias("centred"), F.when(i % 3 == 0, 0.8).when(i % 3 == 2, 1.5).alias("line_size"), (i % 4 == 0).alias("line_indented"),
        (n % 5 == 0).alias("underlined"), F.when(i % 6 == 0, whole).when(i % 6 == 1, two).otherwise(F.slice(whole, 1, 0)).alias("runs"),
    )
    return layout.sub_headings(rows, body_styles(spark, sf)).select("book_id", "doc", "line_idx", "kind")


@query(
    f"""{_LABELS}, dd as (select book_id, doc, 'd' || doc || '#n' as key from sd union all select book_id, doc, 'd' || (doc_id + 20) || '#n' from sd)
 select dd.book_id, dd.doc, string_agg(dd.key || '=' || nl.text, ';' order by dd.key) as labels from dd join nl on nl.book_id = dd.book_id and nl.key = dd.key group by all"""
)
def attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Each document cites its own note and that of a document further on."""
    d = T.documents(spark, sf)
    key = lambda c: F.concat(F.lit("d"), c.cast("string"), F.lit("#n"))
    cited = d.select("book_id", "doc", F.explode(F.array(key(F.col("doc_id")), key(F.col("doc_id") + 20), key(F.col("doc_id")))).alias("key"))
    out = notes.attach_labels(cited, note_labels(spark, sf))
    entry = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("book_id", "doc", F.array_join(entry, ";").alias("labels"))


@query(
    f"""with {T.SD}, {T.SL}, {T.SLINES}, an as (select book_id, doc, count(*) // 2 as line_idx, '★' || doc as label, 1 as o from slines where doc_id % 3 = 0 group by all union all select book_id, doc, 0, '★0', 2 from sd where doc_id % 6 = 0),
 am as (select book_id, doc, line_idx, arg_min(label, o) as label from an group by all), l as (select s.*, am.label from slines s left join am on am.book_id = s.book_id and am.doc = s.doc and am.line_idx = s.line_idx)
 select book_id, doc, line_idx, 0 as sub, label || ': ' || text as text, 0 as kind from l where label is not null and kind <> 0
 union all select book_id, doc, line_idx, 1, case when label is not null and kind = 0 then label || ': ' || text else text end, kind from l"""
)
def star_note_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Stars at the middle and the first line of some documents, which is one line where they are short."""
    d = T.documents(spark, sf).select("book_id", "doc", "doc_id")
    top = d.select("book_id", "doc", F.lit("top").alias("name"), F.lit(0).alias("line_idx"))
    stars = d.filter("doc_id % 3 = 0").select("book_id", "doc", F.lit("mid").alias("name"), F.concat(F.lit("★"), "doc").alias("label"))
    stars = stars.unionByName(d.filter("doc_id % 6 = 0").select("book_id", "doc", F.lit("top").alias("name"), F.lit("★0").alias("label")))
    rows = T.lines(spark, sf).select("book_id", "doc", "line_idx", "text", "kind")
    return notes.star_note_lines(rows, T.anchors(spark, sf).unionByName(top), stars)


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    rule = lambda pos, kind, tag, cls, prop, value: F.struct(F.lit(pos).alias("rule_pos"), F.lit(kind).alias("kind"), F.lit(tag).alias("tag"), F.lit(cls).alias("cls"), F.lit(prop).alias("prop"), value.alias("value"))
    some = F.array(
        rule(0, "tag", "p", "", "margin", F.lit("0")), rule(1, "class", "", "a", "margin", F.concat(n, F.lit("px"))), rule(2, "both", "p", "b", "margin", F.lit("2em")),
        rule(3, "class", "", "b", "font-family", F.concat(F.lit("F"), n)), rule(4, "class", "", "a", "margin", F.lit("4px")), rule(5, "tag", "div", "", "font-family", F.lit("Div")),
    )
    return T.documents(spark, sf).select("book_id", "doc", F.explode(some).alias("r")).select("book_id", "doc", "r.*")


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda tag, *classes: F.struct(F.lit(tag).alias("tag"), F.array(*map(F.lit, classes)).cast("array<string>").alias("classes"))
    some = F.array(item("p"), item("p", "a"), item("p", "a", "b"), item("p", "b", "a"), item("div", "b"), item("div", "x"))
    return T.documents(spark, sf).select("book_id", "doc", F.explode(some).alias("e")).select("book_id", "doc", "e.*")


_DECLARED = f"""with {T.SD}, el as (select book_id, doc, doc_id, unnest(['p', 'p', 'p', 'p', 'div', 'div']) as tag, unnest(['', 'a', 'a b', 'b a', 'b', 'x']) as classes from sd),
 rl as (select * from (values (0, 'p', '', 'margin'), (1, '', 'a', 'margin'), (2, 'p', 'b', 'margin'), (3, '', 'b', 'font-family'), (4, '', 'a', 'margin'), (5, 'div', '', 'font-family')) v(pos, t, c, prop)),
 mt as (select el.*, pos, prop, case pos when 0 then '0' when 1 then doc_id || 'px' when 2 then '2em' when 3 then 'F' || doc_id when 4 then '4px' else 'Div' end as value,
  row_number() over (partition by book_id, doc, el.tag, classes, prop order by case when c = '' then 0 else instr(classes, c) end desc, case when t <> '' and c <> '' then 1 else 0 end desc, pos desc) r
  from el join rl on (t = '' or t = el.tag) and (c = '' or list_contains(string_split(classes, ' '), c)))"""


@query(f"""{_DECLARED} select el.book_id, el.doc, el.tag, el.classes, coalesce(string_agg(prop || ':' || value, ';' order by prop), '') as props from el left join (select * from mt where r = 1) m
 on m.book_id is not distinct from el.book_id and m.doc = el.doc and m.tag = el.tag and m.classes = el.classes group by all""")
def css_declared(spark: SparkSession, sf: str) -> DataFrame:
    """Tag, class and tag-with-class rules over six shapes of elements a document."""
    entry = F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return extract.css_declared(_elements(spark, sf), _rules(spark, sf)).select("book_id", "doc", "tag", F.array_join("classes", " ").alias("classes"), F.array_join(entry, ";").alias("props"))


@query(f"""{_DECLARED}, {T.SL}, {T.SLINES} select s.book_id, s.doc, s.line_idx, lower(m.value) as font from slines s join mt m on m.book_id = s.book_id and m.doc = s.doc and m.r = 1 and m.prop = 'font-family'
 where m.tag = case when line_idx % 2 = 0 then 'div' else 'p' end and m.classes = case when line_idx % 2 = 0 then case when line_idx % 3 = 0 then 'b' else 'x' end else 'a b' end""")
def inherited_font(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost block that declares a font counts; inner ones without one are passed over."""
    i = F.col("line_idx")
    item = lambda tag, *classes: F.struct(F.lit(tag).alias("tag"), F.array(*map(F.lit, classes)).cast("array<string>").alias("classes"))
    chain = F.when(i % 2 == 1, F.array(item("div", "x"), item("p", "a", "b"), item("p", "a"))).when(i % 3 == 0, F.array(item("p", "a", "b"), item("div", "b"))).otherwise(F.array(item("div", "b"), item("div", "x"), item("p")))
    declared = extract.css_declared(_elements(spark, sf), _rules(spark, sf))
    return extract.inherited_font(T.lines(spark, sf).select("book_id", "doc", "line_idx", chain.alias("chain")), declared)
