"""E-book archives as tables: listing, entries, package metadata, tables of contents, style sheets, text books."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from booktext.functions import text as X
from booktext.sources.stores import KINDS, batched, entry_rows, registered

ENTRIES = "book_id string, name string, size long, content binary, raw string, error string"


def scan_library(spark: SparkSession, path: str, recurse: bool = False) -> DataFrame:
    """book_id, n_bytes and changed of the book files under path, empty ones too. Nothing of them is read."""
    return registered(spark).read.format("book_files").option("recurse", str(recurse)).load(path)


def decode_bytes(data: bytes) -> str:
    for name in ("utf-8-sig", "utf-16"):
        try:
            return data.decode(name)
        except UnicodeError:
            continue
    return data.decode("utf-8", "replace")


def explode_archives(books: DataFrame, keep: str = KINDS) -> DataFrame:
    """book_id, name, size, text, error: one row an entry of books(book_id[, content]), with the text of the kinds that are read. Other
    entries (images, fonts) are not inflated. A broken or empty archive has a row with an error. Without content, archives are opened by
    range; memory follows the largest entry that is read."""
    pattern, given = re.compile(keep), "content" in books.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column("content") if given else [None] * b.num_rows
            rows = (row for book, c in zip(b.column("book_id").to_pylist(), contents) for row in entry_rows(book, pattern, c.as_py() if c is not None else None))
            for out in batched(rows):
                # what is no UTF-8 is decoded here, the rest in the JVM
                raw = [None if c is None or _is_utf8(c) else decode_bytes(c) for c in out.column("content").to_pylist()]
                content = pa.array([None if r is not None else c for c, r in zip(out.column("content").to_pylist(), raw)], pa.binary())
                columns = {"content": content, "raw": pa.array(raw, pa.string())}
                yield pa.RecordBatch.from_arrays([columns.get(n, out.column(n) if n in out.schema.names else None) for n in _NAMES], _NAMES)

    found = books.select("book_id", *["content"] * given).mapInArrow(run, ENTRIES)
    return found.select("book_id", "name", "size", F.coalesce(decode_text(F.col("content")), "raw").alias("text"), "error")


_NAMES = ["book_id", "name", "size", "content", "raw", "error"]


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeError:
        return False
    return True


def read_entries(wanted: DataFrame) -> DataFrame:
    """book_id, name, content of the entries in wanted(book_id, name[, content of the archive]): only these are inflated."""
    given = "content" in wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column("content").to_pylist() if given else [None] * b.num_rows
            rows = (row for book, name, c in zip(b.column("book_id").to_pylist(), b.column("name").to_pylist(), contents) for row in entry_rows(book, _NONE, c, {name}))
            yield from batched(row for row in rows if row[3] is not None)

    return wanted.select("book_id", "name", *["content"] * given).mapInArrow(run, "book_id string, name string, size long, content binary, error string").select("book_id", "name", "content")


_NONE = re.compile("(?!)")


def decode_text(content: Column) -> Column:
    """Valid UTF-8 without its mark; null for the rest, which explode_archives() has decoded."""
    return F.when(F.is_valid_utf8(content), F.regexp_replace(content.cast("string"), "^\\x{FEFF}", ""))


def clean_xml(text: Column) -> Column:
    """Without the characters that XML forbids; null where entities are declared in the first 64 KiB."""
    good = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    return F.when(~F.substring(text, 1, 65536).rlike("(?i)<!ENTITY"), good)


PACKAGE = (
    "book_id string, title string, authors array<string>, publisher string, date string, language string, pre_paginated boolean, opf string, "
    "manifest array<struct<item_pos:int,item_id:string,path:string,media:string,props:array<string>>>, spine array<struct<spine_pos:int,item_id:string>>, "
    "metas array<struct<pos:int,id:string,name:string,property:string,refines:string,content:string,text:string>>, toc_id string, error string"
)


def read_packages(entries: DataFrame) -> DataFrame:
    """One row a book of PACKAGE: the package document that the container names, read as a table of items, spine and metas."""
    xml = entries.filter("text is not null").select("book_id", "name", clean_xml(F.col("text")).alias("text"))
    container = xml.filter("name = 'META-INF/container.xml'")
    opf = container.select("book_id", F.expr("xpath(text, \"//*[local-name()='rootfile']/@full-path\")[0]").alias("name"))
    books = entries.select("book_id").distinct()
    found = books.join(opf, "book_id", "left").join(xml, ["book_id", "name"], "left")
    errors = entries.filter("error is not null").select("book_id", "error")
    found = found.join(errors, "book_id", "left")

    def local(e) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from booktext.operators.extract import resolve

        names = [x.strip().split(" ")[0] for x in ("book_id,title,authors,publisher,date,language,pre_paginated,opf,manifest,spine,metas,toc_id,error").split(",")]
        for b in batches:
            out = []
            for book, opf, text, error in zip(b["book_id"], b["name"], b["text"], b["error"]):
                error = error if isinstance(error, str) else None
                empty = (book, None, [], None, None, None, False, opf if isinstance(opf, str) else None, [], [], [], None)
                if error or not isinstance(text, str):
                    out.append((*empty, error or "no package document"))
                    continue
                try:
                    root = ElementTree.fromstring(text)
                except ElementTree.ParseError as e:
                    out.append((*empty, f"package: {e}"))
                    continue
                every = list(root.iter())
                said = lambda k, every=every: [t for e in every if local(e) == k and (t := "".join(e.itertext()).strip())]
                first = lambda k, said=said: next(iter(said(k)), None)
                items = {}
                for e in every:
                    if local(e) == "item" and e.get("id") and e.get("href"):
                        items.pop(e.get("id"), None)
                        items[e.get("id")] = (resolve(opf, e.get("href").partition("#")[0]).partition("#")[0], e.get("media-type") or "", (e.get("properties") or "").split())
                spine = [e.get("idref") for e in every if local(e) == "itemref" and e.get("idref")]
                metas = [
                    {"pos": n, "id": e.get("id"), "name": e.get("name"), "property": e.get("property"), "refines": (e.get("refines") or "").lstrip("#") or None, "content": e.get("content"), "text": "".join(e.itertext()).strip() or None}
                    for n, e in enumerate(x for x in every if local(x) == "meta")
                ]
                toc = next((e.get("toc") for e in every if local(e) == "spine"), None)
                out.append((
                    book, first("title"), said("creator"), first("publisher"), first("date"), first("language"), "pre-paginated" in text.lower(), opf,
                    [{"item_pos": n, "item_id": k, "path": p, "media": m, "props": q} for n, (k, (p, m, q)) in enumerate(items.items())],
                    [{"spine_pos": n, "item_id": k} for n, k in enumerate(spine)], metas, toc, None,
                ))
            yield pd.DataFrame(out, columns=names)

    return found.select("book_id", "name", "text", "error").mapInPandas(run, PACKAGE)


def part(packages: DataFrame, name: str) -> DataFrame:
    """manifest, spine or metas as rows."""
    return packages.select("book_id", F.explode(name).alias("x")).select("book_id", "x.*")


def book_series(metas: DataFrame) -> DataFrame:
    """book_id, series, series_index: the first collection with text whose type is not stated or is series."""
    c = metas.filter("property = 'belongs-to-collection' and text is not null")
    last = lambda p: F.max_by(F.when(F.col("property") == p, F.col("text")), F.when(F.col("property") == p, F.col("pos")))
    r = metas.filter("refines is not null").groupBy("book_id", F.col("refines").alias("id")).agg(last("collection-type").alias("kind"), last("group-position").alias("series_index"))
    rows = c.select("book_id", "pos", "id", "text").join(r, ["book_id", "id"], "left").filter("kind is null or kind = 'series'")
    return rows.groupBy("book_id").agg(F.min_by("text", "pos").alias("series"), F.min_by("series_index", "pos").alias("series_index"))


def pick_cover(manifest: DataFrame, metas: DataFrame, entries: DataFrame) -> DataFrame:
    """book_id, cover_path: the first item with the cover-image property, else the image that <meta name="cover"> names; it must be there."""
    named = metas.filter("name = 'cover' and content is not null").select("book_id", F.col("content").alias("item_id"), F.lit(True).alias("named")).distinct()
    rows = manifest.join(named, ["book_id", "item_id"], "left")
    rule = F.when(F.array_contains("props", "cover-image"), 0).when(F.col("named") & F.col("media").startswith("image/"), 1)
    there = entries.select("book_id", X.resolve_path(F.lit(""), F.col("name")).alias("path")).distinct()
    rows = rows.withColumn("rule", rule).filter("rule is not null").join(there, ["book_id", "path"], "left_semi")
    return rows.groupBy("book_id").agg(F.min_by("path", F.struct("rule", "item_pos")).alias("cover_path"))


class _Nav(HTMLParser):
    """Entries (nav number, type, depth, href, label) of the nav elements of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.nav, self.kind, self.lists, self.href, self.text = [], -1, None, 0, None, []

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        if tag == "nav":
            self.nav, self.kind, self.lists = self.nav + 1, f"{a.get('epub:type') or ''} {a.get('type') or ''}".lower(), 0
        elif tag == "ol":
            self.lists += 1
        elif tag == "a" and self.kind is not None:
            self.href, self.text = a.get("href") or "", []

    def handle_endtag(self, tag: str) -> None:
        if tag == "ol":
            self.lists -= 1
        elif tag == "a" and self.href is not None:
            label = " ".join("".join(self.text).split())
            if label:
                self.out.append((self.nav, self.kind, max(1, self.lists), self.href, label))
            self.href = None
        elif tag == "nav":
            self.kind = None

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def _ncx(text: str) -> list[tuple]:
    out, local = [], lambda e: e.tag.rpartition("}")[2]

    def walk(e, depth: int) -> None:
        for p in e:
            if local(p) != "navPoint":
                continue
            label = next((" ".join("".join(t.itertext()).split()) for c in p if local(c) == "navLabel" for t in c if local(t) == "text"), "")
            src = next((c.get("src") for c in p if local(c) == "content"), None)
            if label and src:
                out.append((0, "toc", depth, src, label))
            walk(p, depth + 1)

    try:
        for m in ElementTree.fromstring(text).iter():
            if local(m) == "navMap":
                walk(m, 1)
    except ElementTree.ParseError:
        return []
    return out


def _entries(docs: DataFrame, reader) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from booktext.operators.extract import resolve

        for b in batches:
            rows = []
            for book, doc, text in zip(b["book_id"], b["doc"], b["text"]):
                for n, (nav, kind, depth, href, label) in enumerate(reader(text if isinstance(text, str) else "")):
                    target, _, fragment = resolve(doc, href).partition("#")
                    rows.append((book, nav, "toc" in kind, n, depth, target, fragment or None, label))
            yield pd.DataFrame(rows, columns=["book_id", "nav", "is_toc", "toc_pos", "depth", "doc", "fragment", "label"])

    return docs.select("book_id", "doc", "text").mapInPandas(run, "book_id string, nav int, is_toc boolean, toc_pos int, depth int, doc string, fragment string, label string")


def read_toc(docs: DataFrame) -> DataFrame:
    """toc rows of nav documents: the first nav with entries whose type has toc, else the first with entries."""

    def read(text: str) -> list[tuple]:
        p = _Nav()
        p.feed(text)
        p.close()
        return p.out

    rows = _entries(docs, read)
    best = rows.groupBy("book_id").agg(F.min(F.struct((~F.col("is_toc")).alias("other"), "nav"))["nav"].alias("nav"))
    return rows.join(best, ["book_id", "nav"], "left_semi").drop("nav", "is_toc")


def read_ncx(docs: DataFrame) -> DataFrame:
    """toc rows of NCX documents; none where the XML is bad or declares entities."""
    return _entries(docs.withColumn("text", clean_xml(F.col("text"))), _ncx).drop("nav", "is_toc")


def toc_of(nav: DataFrame, ncx: DataFrame) -> DataFrame:
    """nav entries, and the NCX's of books where nav gave none."""
    return nav.unionByName(ncx.join(nav.select("book_id").distinct(), "book_id", "left_anti"))


def doc_stylesheets(docs: DataFrame, entries: DataFrame | None) -> DataFrame:
    """book_id, doc, sheet_pos, css: linked sheets in document order, then inline ones. docs(book_id, doc, html)."""
    inline = docs.select("book_id", "doc", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1))).alias("n", "css"))
    if entries is None:
        return inline.withColumnRenamed("n", "sheet_pos")
    tags = docs.select("book_id", "doc", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))).alias("n", "t"))
    href = F.regexp_extract("t", r"(?is)\bhref\s*=\s*[\"']([^\"']*)", 1)
    tags = tags.filter(F.lower("t").rlike("stylesheet|text/css")).select("book_id", "doc", "n", X.resolve_path(F.regexp_extract("doc", r"^(.*/)?", 0), F.substring_index(href, "#", 1)).alias("name"))
    linked = tags.join(entries.filter("text is not null").select("book_id", "name", F.col("text").alias("css")), ["book_id", "name"])
    both = linked.select("book_id", "doc", F.lit(0).alias("k"), "n", "css").unionByName(inline.select("book_id", "doc", F.lit(1).alias("k"), "n", "css"))
    pos = F.row_number().over(W.partitionBy("book_id", "doc").orderBy("k", "n")) - 1
    return both.select("book_id", "doc", pos.alias("sheet_pos"), "css")


def write_pieces(pieces: DataFrame, path: str, order: list[str]) -> None:
    """Write pieces(target, piece, ...) in order as one file a target below path. A book streams through its task, piece by piece."""
    registered(pieces.sparkSession)
    rows = pieces.repartition("target").sortWithinPartitions("target", *order).select("target", "piece")
    rows.write.format("text_books").mode("append").save(path)


def write_text_books(books: DataFrame, path: str) -> DataFrame:
    """Write books(book_id, target, text) as one UTF-8 file with a byte order mark a target; book_id, target, n_chars (without the mark)."""
    write_pieces(books.select("target", F.col("text").alias("piece")), path, [])
    return books.select("book_id", "target", F.length("text").alias("n_chars"))


def read_text_books(spark: SparkSession, path: str) -> DataFrame:
    """One row a line after the header: path, header (its fields in order), line_no, section (0 before the first fence), depth, label, kind
    (fence, paragraph, sub-heading, blank), text. The cover goes first, then the Contents block. Files are read by line and may be split: what a
    split leaves to the next (lines, header, fences, the cover) is carried by one row a split."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"))
    mark = r"^--==(#+) (.*) #+==--$"
    rows = rows.withColumn("fence", F.when(X.looks_like_fence(F.col("text")), F.struct(F.regexp_extract("text", mark, 2).alias("label"), F.length(F.regexp_extract("text", mark, 1)).alias("depth"))))
    rows = rows.withColumn("cover", (F.col("text") == "--==[ Cover ]==--").cast("int")).withColumn("empty", (F.col("text") == "").cast("int"))
    here = W.partitionBy("path", "b").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = lambda c: F.sum(F.col(c)).over(here).alias(c)
    rows = rows.withColumn("one", F.lit(1)).withColumn("fenced", F.col("fence").isNotNull().cast("int"))
    local = rows.select("path", "b", "i", "text", n("one"), n("empty"), n("cover"), n("fenced"), F.last("fence", True).over(here).alias("fence"), F.col("fenced").alias("is_fence"))
    sums = rows.groupBy("path", "b").agg(*[F.sum(c).alias(c) for c in ("one", "empty", "cover", "fenced")], F.max_by("fence", F.when(F.col("fence").isNotNull(), F.col("i"))).alias("fence"))
    past = W.partitionBy("path").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("path", "b", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}0") for c in ("one", "empty", "cover", "fenced")], F.last("fence", True).over(past).alias("fence0"))
    total = lambda c: F.col(c) + F.col(f"{c}0")
    rows = local.join(before, ["path", "b"]).filter(total("cover") == 0).select(
        "path", "text", (total("one") - 1).cast("int").alias("line_no"), total("empty").alias("empty"), total("fenced").alias("section"), F.coalesce("fence", "fence0").alias("fence"), "is_fence"
    )
    field = F.struct(F.regexp_extract("text", "^([^:]+): ?", 1).alias("k"), F.regexp_replace("text", "^[^:]+: ?", "").alias("v"))
    heads = rows.filter((F.col("empty") == 0) & F.col("text").rlike("^[^:]+:")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", field.alias("f")))).alias("h"))
    heads = heads.select("path", F.transform("h", lambda x: x["f"]).alias("header"))
    body = rows.filter("empty > 0").join(heads, "path", "left")
    body = body.filter(~F.coalesce(F.col("fence.label").isin("Contents", "目次") & (F.col("fence.depth") == 1), F.lit(False)))
    kind = F.when(F.col("is_fence") == 1, "fence").when(F.col("text") == "", "blank").when(F.col("text").rlike(r"^(    |\x{3000}\x{3000})"), "paragraph").otherwise("sub-heading")
    none = F.array().cast("array<struct<k:string,v:string>>")
    return body.select("path", F.coalesce("header", none).alias("header"), "line_no", "section", "fence.depth", "fence.label", kind.alias("kind"), "text")
