"""Queries over archives that Spark makes from pages, and over documents built from them: sources, sinks and the tokenizer's tables with SQL.

A volume is the pages of one host with 50 neighbouring ids, so that no archive grows with a host. Its archive has a package, a
nav or an NCX, a style sheet, a cover and its pages in three encodings; some volumes are cut short, empty or declare entities."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext.functions import text as X
from booktext.operators import extract, notes
from booktext.plans import library as LB
from booktext.plans.registry import query
from booktext.plans.shared import shared_folder
from booktext.sources import archives as A
from booktext.sources.stores import opened, registered

VOLUME = 50
LINK = '<link rel="stylesheet" href="../s.css"/>'
CONTAINER = '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
VP = rf"""vp as (select page_id, page_id // {VOLUME} as v, regexp_extract(url,'https?://([^/]+)',1) as host, concat(regexp_extract(url,'https?://([^/]+)',1), '/', page_id // {VOLUME}) as book_id,
 regexp_extract(html,'<html lang="([a-z]+)"',1) as language, concat('Page', regexp_replace(regexp_extract(html,'<title>([^<]*)</title>',1),'[^A-Za-z0-9]','','g'), ' ', page_id) as label,
 concat('{LINK}', html) as html from pages),
 vn as (select *, row_number() over (partition by book_id order by page_id) - 1 as pos, count(*) over (partition by book_id) as n from vp),
 vol as (select book_id, min(v) as v, min(host) as host, min(n) as n, min_by(language, page_id) as language from vn group by book_id),
 good as (select * from vol where v % 7 not in (3, 4)), read as (select * from good where n % 13 <> 12)"""


def volume_pages(spark: SparkSession, sf: str) -> DataFrame:
    """book_id, v, host, page_id, language, label, html."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    host, v = F.regexp_extract("url", "https?://([^/]+)", 1), F.expr(f"page_id div {VOLUME}")
    word = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-z0-9]", "")
    return p.select(
        F.concat(host, F.lit("/"), v).alias("book_id"), v.alias("v"), host.alias("host"), "page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"),
        F.concat(F.lit("Page"), word, F.lit(" "), "page_id").alias("label"), F.concat(F.lit(LINK), "html").alias("html"),
    )


def _archive(rows: pd.DataFrame) -> bytes:
    rows = rows.sort_values("page_id")
    v, host, book, n = int(rows["v"].iloc[0]), rows["host"].iloc[0], rows["book_id"].iloc[0], len(rows)
    item = lambda i, href, media, props="": f'<item id="{i}" href="{href}" media-type="{media}" properties="{props}"/>'
    pages = [(f"p{p}", f"text/p{p}.xhtml", label) for p, label in zip(rows["page_id"], rows["label"])]
    items = [item(i, href, "application/xhtml+xml") for i, href, _ in pages] + [item("css", "s.css", "text/css")]
    if n % 4 != 3:
        items.append(item("img", "c.jpg", "image/jpeg", "cover-image" * (n % 4 == 0)))
    if n % 4 == 2:
        items.append(item("gone", "gone.jpg", "image/jpeg", "cover-image"))
    nav = n % 2 == 0
    items.append(item("nav", "nav/nav.xhtml", "application/xhtml+xml", "nav") if nav else item("ncx", "toc.ncx", "application/x-dtbncx+xml"))
    entity = '<!DOCTYPE package [<!ENTITY e "x">]>' if n % 13 == 12 else ""
    metas = f'<meta property="belongs-to-collection" id="c1">{host}</meta><meta refines="#c1" property="collection-type">{"series" if n % 3 < 2 else "set"}</meta><meta refines="#c1" property="group-position">{v}</meta>'
    metas += '<meta name="cover" content="img"/>' * (n % 4 in (1, 2)) + '<meta property="rendition:layout">pre-paginated</meta>' * (n % 5 == 0)
    opf = (
        f'{entity}<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> </dc:title><dc:title>{book}</dc:title><dc:creator>{host}</dc:creator>'
        + f"<dc:creator>Volume {v}</dc:creator>" * (v % 2) + f"<dc:language>{rows['language'].iloc[0]}</dc:language><dc:date>{2000 + v}</dc:date>{metas}</metadata><manifest>{''.join(items)}</manifest>"
        + f'<spine{"" if nav else " toc=" + chr(34) + "ncx" + chr(34)}>' + "".join(f'<itemref idref="{i}"/>' for i, _, _ in [*pages, pages[0]]) + "</spine></package>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("O/p.opf", opf)
        z.writestr("O/s.css", f"p{{margin:{v}px}}")
        if n % 4 != 3:
            z.writestr("O/c.jpg", b"\xff\xd8" + book.encode())
        if nav:
            rest = "".join(f'<li><a href="../{h}">{t}</a><ol><li><a href="../{h}#mid">{t} mid</a></li></ol></li>' for _, h, t in pages)
            z.writestr("O/nav/nav.xhtml", f'<nav epub:type="landmarks"><ol><li><a href="x">no</a></li></ol></nav><nav epub:type="toc"><ol>{rest}</ol></nav>')
        else:
            point = lambda t, h, inside="": f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{h}"/>{inside}</navPoint>'
            rest = "".join(point(t, h, point(f"{t} mid", f"{h}#mid")) for _, h, t in pages)
            z.writestr("O/toc.ncx", f"<ncx><navMap>{rest}</navMap></ncx>")
        for (_, href, _), p, html in zip(pages, rows["page_id"], rows["html"]):
            z.writestr(f"O/{href}", html.encode(("utf-8", "utf-8-sig", "utf-16")[int(p) % 3]))
    data = out.getvalue()
    return data[: len(data) // 2] if v % 7 == 3 else b"" if v % 7 == 4 else data


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    """book_id and content: the archive of each volume."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"book_id": rows["book_id"][:1], "content": [_archive(rows)]})

    return volume_pages(spark, sf).groupBy("book_id").applyInPandas(run, "book_id string, content binary")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return A.explode_archives(volumes(spark, sf))


@query(
    f"""with {VP} select book_id, unnest(['META-INF/container.xml', 'O/p.opf', 'O/s.css', case when n % 2 = 0 then 'O/nav/nav.xhtml' else 'O/toc.ncx' end]) as name, cast(null as bigint) as size, false as broken from good
 union all select book_id, 'O/c.jpg', cast(null as bigint), false from good where n % 4 <> 3
 union all select book_id, concat('O/text/p', page_id, '.xhtml'), case page_id % 3 when 0 then strlen(html) when 1 then strlen(html) + 3 else 2 + 2 * (length(html) + length(regexp_replace(html, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) end, false from vn where v % 7 not in (3, 4)
 union all select book_id, null, null, true from vol where v % 7 in (3, 4)"""
)
def archive_entries(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the entries of every archive, with the sizes of documents; broken and empty ones."""
    size = F.when(F.col("name").startswith("O/text/"), F.col("size"))
    return _entries(spark, sf).select("book_id", "name", size.alias("size"), F.col("error").isNotNull().alias("broken"))


@query(f"with {VP} select book_id, page_id, length(html) as n_chars, sha256(html) as text_sha256 from vn where v % 7 not in (3, 4)")
def archive_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in UTF-8, with and without a mark, and in UTF-16."""
    page = F.regexp_extract("name", r"^O/text/p(\d+)\.xhtml$", 1)
    return _entries(spark, sf).filter(page != "").select("book_id", page.cast("long").alias("page_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query(
    f"""with {VP}, s as (select book_id, string_agg(concat('p', page_id), ',' order by page_id) || ',' || min_by(concat('p', page_id), page_id) as spine from vn group by book_id)
 select vol.book_id, r.book_id is null as refused, case when r.book_id is not null then vol.book_id end as title, case when r.book_id is not null then vol.host || case when vol.v % 2 = 1 then concat('|Volume ', vol.v) else '' end else '' end as authors,
 case when r.book_id is not null then r.language end as language, case when r.book_id is not null then cast(2000 + r.v as varchar) end as date, coalesce(r.n % 5 = 0, false) as fixed,
 case when r.book_id is not null then cast(r.n + 2 + case r.n % 4 when 3 then 0 when 2 then 2 else 1 end as int) else 0 end as n_items, case when r.book_id is not null then s.spine else '' end as spine
 from vol left join read r on vol.book_id = r.book_id join s on vol.book_id = s.book_id"""
)
def archive_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Package documents; the first title with text, all creators, items and spine; a package with entities is refused."""
    p = A.read_packages(_entries(spark, sf))
    return p.select(
        "book_id", F.col("error").isNotNull().alias("refused"), "title", F.array_join("authors", "|").alias("authors"), "language", "date", F.col("pre_paginated").alias("fixed"),
        F.size("manifest").alias("n_items"), F.array_join(F.transform(F.array_sort("spine"), lambda x: x["item_id"]), ",").alias("spine"),
    )


@query(f"""with {VP} select book_id, case when n % 3 < 2 then host end as series, case when n % 3 < 2 then cast(v as varchar) end as series_index, case when n % 4 <> 3 then 'O/c.jpg' end as cover_path from read""")
def archive_metas(spark: SparkSession, sf: str) -> DataFrame:
    """The series that refined metas name, and the cover that is there."""
    entries = _entries(spark, sf)
    p = A.read_packages(entries)
    metas = A.part(p, "metas")
    series, cover = A.book_series(metas), A.pick_cover(A.part(p, "manifest"), metas, entries)
    return p.filter("error is null").select("book_id").join(series, "book_id", "left").join(cover, "book_id", "left")


@query(
    f"""with {VP}, d as (select book_id, page_id, pos, concat('O/text/p', page_id, '.xhtml') as doc, label from vn where v % 7 not in (3, 4) and n % 13 <> 12)
 select book_id, cast(2 * pos as int) as toc_pos, 1 as depth, doc, cast(null as varchar) as fragment, label from d union all select book_id, cast(2 * pos + 1 as int), 2, doc, 'mid', concat(label, ' mid') from d"""
)
def archive_toc(spark: SparkSession, sf: str) -> DataFrame:
    """Nav documents, and the NCX of books without one. Places of nav entries count from the toc's first."""
    entries = _entries(spark, sf)
    rows = LB.book_toc(A.read_packages(entries), entries)
    first = rows.groupBy("book_id").agg(F.min("toc_pos").alias("least"))
    return rows.join(first, "book_id").select("book_id", (F.col("toc_pos") - F.col("least")).alias("toc_pos"), "depth", "doc", "fragment", "label")


@query(
    rf"""with {VP}, d as (select book_id, v, concat('O/text/p', page_id, '.xhtml') as doc, regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1) as inl from vn where v % 7 not in (3, 4))
 select book_id, doc, 0 as sheet_pos, concat('p{{margin:', v, 'px}}') as css from d union all select book_id, doc, cast(i as int), inl[i] from d, unnest(range(1, len(inl) + 1)) t(i)"""
)
def archive_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Linked style sheets, then inline ones."""
    entries = _entries(spark, sf)
    docs = entries.filter("name like 'O/text/%'").select("book_id", F.col("name").alias("doc"), F.col("text").alias("html"))
    return A.doc_stylesheets(docs, entries)


@query(
    f"""with {VP} select concat(replace(book_id, '/', '_'), '.epub') as file, v % 7 = 4 as empty, v % 7 in (3, 4) as broken, cast(case when v % 7 in (3, 4) then 0 else n + 4 + case when n % 4 = 3 then 0 else 1 end end as bigint) as n_entries,
 cast(case when v % 7 in (3, 4) then 0 else n + 4 end as bigint) as n_read from vol"""
)
def archive_files(spark: SparkSession, sf: str) -> DataFrame:
    """Archives as files, listed with empty ones, and the entries of the archive source; images are not read."""
    folder = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"

    def save(batches):
        for b in batches:
            store, root = opened(folder)
            store.create_dir(root, recursive=True)
            names = [book.replace("/", "_") + ".epub" for book in b["book_id"]]
            for name, content in zip(names, b["content"]):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
            yield pd.DataFrame({"file": names})

    written = volumes(spark, sf).mapInPandas(save, "file string")
    written.write.format("noop").mode("overwrite").save()
    files = A.scan_library(spark, folder)
    entries = registered(spark).read.format("book_archives").load(folder)
    found = entries.groupBy("book_id").agg(F.count("name").alias("n_entries"), F.count("content").alias("n_read"), F.bool_or(F.col("error").isNotNull()).alias("broken"))
    return files.join(found, "book_id").select(F.regexp_extract("book_id", r"([^/]*)$", 1).alias("file"), (F.col("n_bytes") == 0).alias("empty"), "broken", "n_entries", "n_read")


SHELF = """b as (select concat(coalesce(source, ''), '/', doc_id // 100, '.txt') as target, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))), lambda x: x <> '') as l from documents)"""


@query(
    f"""with {SHELF.replace(chr(92) * 2, chr(92))},
 r as (select target, doc_id, 0 as i, 'fence' as kind, cast(doc_id as varchar) as text from b union all select target, doc_id, i, 'paragraph', l[i] from b, unnest(range(1, len(l) + 1)) t(i)),
 o as (select *, row_number() over (partition by target order by doc_id, i) as n, sum(case when i = 0 then 1 else 0 end) over (partition by target order by doc_id, i) as section from r)
 select target, target as title, count(*) as n_lines, count(*) filter (where kind = 'fence') as n_fences, sha256(string_agg(concat(section, '|', kind, '|', text), chr(10) order by n)) as lines_sha256 from o group by target"""
)
def text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents streamed into text books of exact names and read again by line."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    target = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.expr("doc_id div 100"), F.lit(".txt"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\n\f\x0B]+", " "))), lambda x: x != "")
    body = F.transform(lines, lambda x: F.concat(X.body_line(x, F.lit("    ")), F.lit("\n")))
    head = F.concat(F.lit("\n"), X.fence(F.lit(1), F.col("doc_id").cast("string")), F.lit("\n\n"))
    pieces = d.select(target.alias("target"), "doc_id", F.posexplode(F.concat(F.array(head), body)).alias("n", "piece"))
    tops = pieces.select("target").distinct().select("target", F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("n"), F.concat(F.lit("RTB-1\nTitle: "), "target", F.lit("\nCover: False\n")).alias("piece"))
    A.write_pieces(pieces.unionByName(tops), folder, ["doc_id", "n"])
    rows = A.read_text_books(spark, folder).filter("kind <> 'blank'")
    name = F.regexp_extract("path", r"/texts-[0-9a-f]{32}/(.*)$", 1)
    title = F.element_at(F.map_from_entries("header"), "Title")
    said = F.concat_ws("|", "section", "kind", F.when(F.col("kind") == "fence", F.col("label")).otherwise(F.substring("text", 5, 1 << 30)))
    rows = rows.groupBy(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("target"), title.alias("title")).agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "fence").alias("n_fences"), F.array_sort(F.collect_list(F.struct("line_no", said.alias("t")))).alias("ls")
    )
    return rows.select("target", "title", "n_lines", "n_fences", F.sha2(F.array_join(F.transform("ls", lambda x: x["t"]), "\n"), 256).alias("lines_sha256"))


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    """A document of each page with blocks, runs, addresses and a note, made of its id and label: book_id, doc, spine_pos, language, html."""
    p, t, s = F.col("page_id").cast("string"), F.col("label"), F.lit
    odd, third = F.col("page_id") % 2 == 1, F.col("page_id") % 3
    doc = F.concat(s("p"), p, s(".xhtml"))
    html = F.concat(
        s('<body><h2 id="h'), p, s('">'), t, s("</h2>"), F.when(third == 0, "<p></p>").when(third == 1, "<div><p></p><p> </p></div>").otherwise("<div/>"),
        s('<p class="a">One <span class="b">'), t, s("</span> <i class=c>x<b class=d>y</i></b></p>"),
        s('<div class="box"><p id="x'), p, s('">see <a href="http://e.org/'), p, s("?utm_a=1&amp;q="), p, s('">site</a></p><p><a href="http://e.org/'), p, s('?q='), p, s('"><img src="i.png"/></a></p></div>'),
        s('<p>word<a id="r'), p, s('"'), F.when(odd, "").otherwise(' epub:type="noteref"'), s(' href="'), doc, s("#n"), p, s('">['), p, s("]</a>, more</p>"),
        s('<ol><li><p id="n'), p, s('"><a href="'), doc, s("#r"), p, s('">['), p, s("]</a>. Note of "), t, s("</p></li></ol><p>end</p><hr/><p>a<br/>b</p></body>"),
    )
    return volume_pages(spark, sf).select("book_id", doc.alias("doc"), F.col("page_id").cast("int").alias("spine_pos"), F.lit("en").alias("language"), html.alias("html"))


#: The lines of such a document by their places: heading, first, site, reference, note, end, rule, a, b. The lone address repeats the line before.
SHAPED = f"""{VP}, sl as (select book_id, page_id, page_id % 3 as third, label, unnest(range(9)) as i from vn),
 st as (select book_id, concat('p', page_id, '.xhtml') as doc, cast(i as int) as line_idx, case i when 0 then label when 1 then concat('One ', label, ' xy') when 2 then concat('see site <http://e.org/', page_id, '?q=', page_id, '>')
  when 3 then concat('word (Note[', page_id, ']), more') when 4 then concat('Note[', page_id, ']: Note of ', label) when 5 then 'end' when 6 then repeat('-', 20) when 7 then 'a' else 'b' end as text,
  cast(case when i = 1 then case third when 0 then 1 when 1 then 2 else 0 end when i = 3 then 1 else 0 end as int) as blanks, i = 4 as in_notes, i = 3 as after_image, i = 4 as note_line, page_id, label from sl)"""


def _shaped_tables(spark: SparkSession, sf: str) -> DataFrame:
    shared_folder(spark)
    noted, _ = LB.with_notes(shaped(spark, sf))
    return extract.extract_documents(noted, scan=False)


@query(f"with {SHAPED} select book_id, doc, line_idx, text, blanks, in_notes, after_image, note_line from st")
def shaped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Blanks, flags, addresses, references, note bodies and ways back of lines, written with the labels of the whole book."""
    return extract.table_of(_shaped_tables(spark, sf), "lines").select("book_id", "doc", "line_idx", "text", "blanks", "in_notes", "after_image", "note_line")


@query(f"""with {SHAPED}, a as (select book_id, concat('p', page_id, '.xhtml') as doc, page_id, unnest([0, 2, 3, 4]) as line_idx from vn)
 select book_id, doc, concat(case line_idx when 0 then 'h' when 2 then 'x' when 3 then 'r' else 'n' end, page_id) as name, cast(line_idx as int) as line_idx from a""")
def shaped_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and the lines that they are on."""
    return extract.table_of(_shaped_tables(spark, sf), "anchors").select("book_id", "doc", "name", "line_idx")


@query(f"""with {SHAPED}, d as (select book_id, concat('p', page_id, '.xhtml') as doc, unnest([{{'t': 'h2', 'c': '', 'f': 0, 'e': 0}}, {{'t': 'p', 'c': 'a', 'f': 1, 'e': 1}}, {{'t': 'p', 'c': '', 'f': 2, 'e': 2}}, {{'t': 'div', 'c': 'box', 'f': 2, 'e': 2}},
 {{'t': 'p', 'c': '', 'f': 3, 'e': 3}}, {{'t': 'p', 'c': '', 'f': 4, 'e': 4}}, {{'t': 'li', 'c': '', 'f': 4, 'e': 4}}, {{'t': 'ol', 'c': '', 'f': 4, 'e': 4}}, {{'t': 'p', 'c': '', 'f': 5, 'e': 5}}, {{'t': 'p', 'c': '', 'f': 7, 'e': 8}},
 {{'t': 'body', 'c': '', 'f': 0, 'e': 8}}]) as b from vn) select book_id, doc, cast(b.f as int) as first_idx, cast(b.e as int) as last_idx, b.t as tag, b.c as classes from d""")
def shaped_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with lines, from the first to the last."""
    return extract.table_of(_shaped_tables(spark, sf), "boxes").select("book_id", "doc", "first_idx", "last_idx", "tag", F.array_join("classes", " ").alias("classes"))


@query(f"""with {SHAPED} select book_id, doc, line_idx, case line_idx when 0 then 'body>h2' when 1 then 'body>p.a' when 2 then 'body>div.box>p' when 4 then 'body>ol>li>p' when 6 then 'body' else 'body>p' end as chain,
 case when line_idx = 1 then concat(label, '=span.b|xy=i.c') else '' end as runs, line_idx = 8 as same_owner from st""")
def shaped_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The open blocks round each line, its runs in the order of their ends, and whether it has the owner of the line before."""
    from pyspark.sql import Window as W

    rows = extract.table_of(_shaped_tables(spark, sf), "lines")
    named = lambda x: F.concat_ws(".", x["tag"], F.when(F.size(x["classes"]) > 0, F.array_join(x["classes"], ".")))
    same = F.coalesce(F.col("owner") == F.lag("owner").over(W.partitionBy("book_id", "doc").orderBy("line_idx")), F.lit(False))
    return rows.select("book_id", "doc", "line_idx", F.array_join(F.transform("chain", named), ">").alias("chain"), F.array_join(F.transform("runs", lambda x: F.concat(x["text"], F.lit("="), named(x))), "|").alias("runs"), same.alias("same_owner"))


@query(f"""with {VP}, d as (select book_id, page_id, concat('p', page_id, '.xhtml') as doc from vn)
 select book_id, doc, 0 as n, concat(doc, '#n', page_id) as target, concat('[', page_id, ']') as text, page_id % 2 = 0 as declared, concat(doc, '#r', page_id) as ids, false as whole from d
 union all select book_id, doc, 1, concat(doc, '#r', page_id), concat('[', page_id, ']'), false, concat(doc, '#n', page_id), false from d""")
def shaped_links(spark: SparkSession, sf: str) -> DataFrame:
    """The internal links of the scanning pass."""
    rows = extract.table_of(extract.extract_documents(shaped(spark, sf), write=False), "links")
    return rows.select("book_id", "doc", "n", "target", "text", "declared", F.array_join("ids", ",").alias("ids"), "whole")


@query(f"""with {VP}, c as (select book_id, concat('p', page_id, '.xhtml') as doc, page_id, unnest(['a', 'b', 'a b', 'b a', 'c', 'd e', '']) as classes from vn)
 select book_id, doc, classes, case classes when 'a' then 1.0 + (page_id % 5) / 10.0::double when 'b a' then 1.0 + (page_id % 5) / 10.0::double when 'c' then (page_id % 30) / 16.0::double end as size,
 classes = 'd e' and page_id % 4 <> 0 as indented, case classes when 'a' then page_id % 5 > 0 when 'a b' then page_id % 5 > 0 when 'b a' then page_id % 5 > 0 when 'c' then page_id % 30 > 16 when 'd e' then page_id % 2 = 0 else false end as heavier,
 classes in ('b', 'a b', 'b a') as centred, classes = 'd e' as underlined from c""")
def run_styles(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, indents, weight and words that the classes of a run declare, by a style sheet of each page."""
    p = F.col("page_id")
    css = F.concat(
        F.lit(".a{font-size:"), ((p % 5) * 10 + 100).cast("string"), F.lit("%} .b{font-size:large;text-align:-webkit-center} .c{font-size:"), (p % 30).cast("string"), F.lit("px} .d{text-indent:-"), (p % 4).cast("string"),
        F.lit("em;font-weight:"), F.when(p % 2 == 0, "700").otherwise("400"), F.lit("} p .e{text-decoration:dotted underline}"),
    )
    docs = volume_pages(spark, sf).select("book_id", F.concat(F.lit("p"), "page_id", F.lit(".xhtml")).alias("doc"), css.alias("css"))
    asked = F.array(*[F.array(*[F.lit(c) for c in x]).cast("array<string>") for x in (["a"], ["b"], ["a", "b"], ["b", "a"], ["c"], ["d", "e"], [])])
    elements = docs.select("book_id", "doc", F.explode(asked).alias("classes"))
    rows = extract.run_style(elements, extract.css_rules(docs))
    return rows.select("book_id", "doc", F.array_join("classes", " ").alias("classes"), "size", "indented", "heavier", "centred", "underlined")


def _shaped_archive(rows: pd.DataFrame) -> bytes:
    """A book of shaped() documents without pictures, with a nav entry for each."""
    rows = rows.sort_values("spine_pos")
    book = rows["book_id"].iloc[0]
    items = "".join(f'<item id="i{n}" href="{d}" media-type="application/xhtml+xml"/>' for n, d in zip(rows["spine_pos"], rows["doc"]))
    refs = "".join(f'<itemref idref="i{n}"/>' for n in rows["spine_pos"])
    entries = "".join(f'<li><a href="{d}">{t}</a></li>' for d, t in zip(rows["doc"], rows["label"]))
    opf = (
        f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{book}</dc:title><dc:creator>A. One</dc:creator><dc:language>en</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("O/p.opf", opf)
        z.writestr("O/nav.xhtml", f'<nav epub:type="toc"><ol>{entries}</ol></nav>')
        for d, html in zip(rows["doc"], rows["html"]):
            z.writestr(f"O/{d}", html)
    return out.getvalue()


@query(
    f"""with {SHAPED}, d as (select st.book_id, page_id, any_value(label) as label, string_agg(case line_idx when 1 then '' when 3 then chr(10) || chr(10) else chr(10) end || '    ' || text, '' order by line_idx) as body from st where line_idx > 0 group by st.book_id, page_id),
 b as (select book_id, 'RTB-1' || chr(10) || 'Title: ' || book_id || chr(10) || 'Author: A. One' || chr(10) || 'Language: en' || chr(10) || 'Cover: False' || chr(10) || chr(10) || '--==# Contents #==--' || chr(10) || string_agg(label, chr(10) order by page_id)
  || string_agg(chr(10) || chr(10) || '--==# ' || label || ' #==--' || chr(10) || chr(10) || body, '' order by page_id) || chr(10) as text from d group by book_id)
 select replace(book_id, '/', '_') || '.txt' as target, 'ok' as kind, book_id || ' (' || length(text) || ' chars)' as detail, sha256(text) as text_sha256 from b"""
)
def library_books(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job: archives of documents with notes, addresses and headings, converted and read again as whole files."""
    folder = f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}"
    html = F.regexp_replace("html", "<img[^>]*>", "")
    docs = shaped(spark, sf).withColumn("html", html).withColumn("label", F.regexp_extract("html", "<h2[^>]*>([^<]*)</h2>", 1))

    def save(rows: pd.DataFrame) -> pd.DataFrame:
        store, root = opened(f"{folder}/in")
        store.create_dir(root, recursive=True)
        name = rows["book_id"].iloc[0].replace("/", "_") + ".epub"
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(_shaped_archive(rows))
        return pd.DataFrame({"file": [name]})

    docs.groupBy("book_id").applyInPandas(save, "file string").write.format("noop").mode("overwrite").save()
    done = LB.library(spark, f"{folder}/in", f"{folder}/out")
    texts = spark.read.text(f"{folder}/out", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    texts = texts.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("target"), F.sha2(F.regexp_replace("value", "^\\x{FEFF}", ""), 256).alias("text_sha256"))
    return done.select("target", "kind", "detail").join(texts, "target", "left")
