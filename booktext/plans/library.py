"""A whole library of archives to text books: one lazy plan over tables keyed by book, document and note.

`library()` lists the archives, leaves out targets that are there already and books of pictures, and writes the rest; a broken
or empty archive is an outcome and stops nothing. A log beside the texts says what was written from which archive. It needs the session's checkpoint folder: tables that several steps use are written there once, which
keeps plans short and survives lost executors, and so are the job list and the outcomes, which would read otherwise once the texts are
written. Set spark.cleaner.referenceTracking.cleanCheckpoints to have them removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from booktext.functions import css as C
from booktext.functions import text as X
from booktext.operators import assemble, extract, jobs as J, layout, notes as N, sections as S
from booktext.sources import archives as A
from booktext.sources.outcomes import append_log, archive_marks, read_log
from booktext.sources.stores import opened, registered

DOC = ["book_id", "doc"]
#: Where the sections go whose pages have no text after them.
END = (1 << 31) - 1


def library(
    spark: SparkSession, path: str, outdir: str, recurse: bool = True, force: bool = False, with_cover: bool = True, banner: str = X.BANNER, refresh: bool = False
) -> DataFrame:
    """Write the text book of every archive under path into outdir; book_id, target, kind (ok, skip, fail, image) and detail of each. Targets that
    are there are kept; the detail of a kept one is "changed" where its archive has changed since, and with refresh it is written anew."""
    books = A.scan_library(spark, path, recurse)
    root = opened(path)[1] if path.startswith("file:") else path  # as the addresses of local books begin
    targets = J.plan_targets(books, root, "").withColumn("target", F.ltrim("target", F.lit("/"))).join(books, "book_id").checkpoint()
    log = read_log(spark, outdir).filter("kind = 'ok'").select("target", F.col("book_id").alias("was"), F.col("n_bytes").alias("was_bytes"), F.col("changed").alias("was_changed"), F.col("mark").alias("was_mark"))
    there = log.select("target").unionByName(_written(spark, outdir)).distinct().checkpoint()
    # an archive of another size or time is looked at: it has changed if its central directory has
    touched = targets.join(log, "target").filter("book_id = was and (n_bytes <> was_bytes or changed <> was_changed)")
    changed = touched.join(archive_marks(touched), "book_id").filter(~F.col("mark").eqNullSafe(F.col("was_mark"))).select("book_id").checkpoint()
    # of books with one target the first by path is written (with force the last) and the others are kept as they are
    parts = F.split("book_id", "/")
    alone = F.row_number().over(W.partitionBy("target").orderBy(parts.desc() if force else parts)) == 1
    pending = J.pending_jobs(targets, there, force).withColumn("alone", alone).checkpoint()
    again = targets.join(changed.filter(F.lit(refresh and not force)), "book_id", "left_semi").checkpoint()
    jobs = pending.filter("alone").drop("alone").unionByName(again)
    doubles = pending.filter("not alone").select("book_id", "target", F.lit("skip").alias("kind"), F.lit("").alias("detail"))
    kept = J.kept_jobs(targets, there, force).join(again, "book_id", "left_anti").join(changed.withColumn("new", F.lit(True)), "book_id", "left")
    kept = kept.select("book_id", "target", "kind", F.when(F.col("new"), "changed").otherwise("").alias("detail")).unionByName(doubles).checkpoint()
    entries = A.explode_archives(jobs).persist()
    packages = A.read_packages(entries).checkpoint()
    docs = book_docs(packages, entries).checkpoint()
    known = jobs.join(archive_marks(jobs), "book_id").select("book_id", "n_bytes", "changed", "mark").checkpoint()
    jobs, pictures = J.drop_picture_books(jobs.select("book_id", "target"), J.picture_book_verdict(docs.select("book_id", "n_bytes", "html", "pre_paginated")))
    about, pieces, order = book_pieces(packages.join(jobs, "book_id", "left_semi"), entries, docs.join(jobs, "book_id", "left_semi"), with_cover, banner)
    pieces = pieces.select("book_id", *order, F.concat("sep", "block").alias("piece")).checkpoint()
    made = about.join(pieces.groupBy("book_id").agg((F.sum(F.length("piece")) + 1).alias("n_chars")), "book_id", "left")
    ran = J.outcomes(jobs, made).unionByName(pictures).checkpoint()
    good = ran.filter("kind = 'ok'").select("book_id", "target")
    A.write_pieces(pieces.join(good, "book_id"), outdir, order)
    append_log(ran.join(known, "book_id", "left"), outdir)
    entries.unpersist()
    return ran.unionByName(kept)


def _written(spark: SparkSession, outdir: str) -> DataFrame:
    """The targets in outdir, by their names; the texts are not read."""
    files = registered(spark).read.format("book_files").option("recurse", "true").option("suffix", ".txt").load(outdir)
    root = opened(outdir)[1].rstrip("/")
    return files.select(F.substring_index("book_id", f"{root}/", -1).alias("target")).filter(~F.col("target").startswith(".staged-"))


def book_docs(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """book_id, spine_pos, doc, language, pre_paginated, n_bytes and html of the documents to read; those not in the archive vanish."""
    manifest = A.part(packages, "manifest").withColumn("is_nav", F.array_contains("props", "nav"))
    docs = S.reading_docs(A.part(packages, "spine"), manifest).select("book_id", "spine_pos", "doc")
    about = packages.select("book_id", "language", "pre_paginated")
    return docs.join(_texts(entries).withColumnRenamed("text", "html"), DOC).join(about, "book_id")


def _texts(entries: DataFrame) -> DataFrame:
    return entries.filter("text is not null").select("book_id", X.resolve_path(F.lit(""), F.col("name")).alias("doc"), F.col("size").alias("n_bytes"), "text")


def book_toc(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """The table of contents of each book: the nav document's, else that of the NCX that the spine names, else of the first."""
    manifest = A.part(packages, "manifest")
    texts = _texts(entries).drop("n_bytes")
    nav = manifest.filter(F.array_contains("props", "nav")).groupBy("book_id").agg(F.min_by("path", "item_pos").alias("doc"))
    named = manifest.join(packages.select("book_id", "toc_id"), "book_id")
    same = F.coalesce(F.col("item_id") == F.col("toc_id"), F.lit(False))
    ncx = named.filter(same | (F.col("media") == "application/x-dtbncx+xml"))
    ncx = ncx.groupBy("book_id").agg(F.min_by("path", F.struct((~same).alias("other"), "item_pos")).alias("doc"))
    return A.toc_of(A.read_toc(nav.join(texts, DOC)), A.read_ncx(ncx.join(texts, DOC)))


def book_wide(spine_pos: Column, n: Column) -> Column:
    """A place in the book of the n-th thing of a document."""
    return F.shiftleft(spine_pos.cast("long"), 32) + n


def with_notes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with labels, stars and word for the writing pass, and stars(book_id, doc, name, label) for star_note_lines: the scanning
    pass of all documents comes first, since a note may stand in a later one."""
    found = extract.extract_documents(docs.select(*DOC, "html"), write=False).checkpoint()
    places = docs.select(*DOC, "spine_pos")
    links = extract.table_of(found, "links").join(places, DOC).withColumn("link_pos", book_wide(F.col("spine_pos"), F.col("n")))
    declared = extract.table_of(found, "note_keys").join(places, DOC)
    keys = N.all_note_keys(declared, N.mutual_note_pairs(links, declared))
    labels = N.note_labels(links, keys)
    groups = declared.filter("group_n is not null").select("book_id", "key", F.concat_ws("#", "doc", "group_n").alias("group_id"), book_wide(F.col("spine_pos"), F.col("group_n")).alias("group_pos"))
    stars = N.star_numbers(labels, groups)
    home = F.substring_index("key", "#", 1)
    used = links.select("book_id", "doc", F.col("target").alias("key")).unionByName(keys.select("book_id", home.alias("doc"), "key"))
    held = N.attach_labels(used, labels.filter("marker"))
    known = keys.join(used, ["book_id", "key"]).groupBy(*DOC).agg(F.collect_set("key").alias("known"))
    starred = used.distinct().join(stars, ["book_id", "key"]).groupBy(*DOC).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "star")))).alias("stars"))
    out = docs.join(held, DOC, "left").join(starred, DOC, "left").join(known, DOC, "left").withColumn("word", X.note_word(F.col("language")))
    out = out.withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    words = docs.select("book_id", X.note_word(F.col("language")).alias("word")).distinct()
    at = stars.join(words, "book_id").select("book_id", home.alias("doc"), F.substring_index("key", "#", -1).alias("name"), F.concat("word", F.lit("[★"), "star", F.lit("]")).alias("label"))
    return out, at


def styled_lines(docs: DataFrame, lines: DataFrame, boxes: DataFrame, entries: DataFrame) -> DataFrame:
    """lines with kind, captions written and blanks from style sheets, and rules as lines of their own in order of line_idx, edge.
    Styles are looked up by the distinct shapes of a document."""
    sheets = A.doc_stylesheets(docs.select(*DOC, "html"), entries).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("sheet_pos", "css"))).alias("s"))
    rules = extract.css_rules(sheets.select(*DOC, F.array_join(F.transform("s", lambda x: x["css"]), "\n").alias("css")))
    shape = ["tag", "classes"]
    inner = F.element_at("chain", -1)
    lines = lines.withColumn("tag", F.when(F.size("chain") > 0, inner["tag"]).otherwise("")).withColumn("classes", F.when(F.size("chain") > 0, inner["classes"]).otherwise(F.array().cast("array<string>")))
    chain = lines.select(*DOC, F.explode("chain").alias("b")).select(*DOC, "b.*")
    runs = lines.select(*DOC, "line_idx", F.posexplode("runs").alias("run_pos", "r")).select(*DOC, "line_idx", "run_pos", "r.text", "r.tag", "r.classes")
    elements = chain.unionByName(runs.select(*DOC, *shape)).unionByName(boxes.select(*DOC, *shape)).unionByName(lines.select(*DOC, *shape)).distinct()
    declared = extract.css_declared(elements, rules).checkpoint()
    # a line is styled by the classes of its block and of its runs
    lines = lines.withColumn("styling", F.concat("classes", F.flatten(F.transform("runs", lambda r: r["classes"]))))
    looks = extract.run_style(lines.select(*DOC, F.col("styling").alias("classes")).unionByName(runs.select(*DOC, "classes")), rules).checkpoint()
    framed = declared.select(*DOC, *shape, C.is_framed(F.col("props")).alias("box"))
    each = runs.join(looks.select(*DOC, "classes", "heavier", "framed"), [*DOC, "classes"]).join(framed, [*DOC, *shape])
    each = each.groupBy(*DOC, "line_idx").agg(F.array_sort(F.collect_list(F.struct("run_pos", "text", (F.col("framed") | F.col("box")).alias("framed"), "heavier"))).alias("runs"))
    look = looks.select(*DOC, F.col("classes").alias("styling"), F.col("size").alias("line_size"), F.col("indented").alias("line_indented"), "centred", "underlined")
    props = declared.select(*DOC, *shape, C.is_framed(F.col("props")).alias("framed"), _margin("top").alias("top"), _margin("bottom").alias("bottom"))
    rows = lines.drop("runs").join(each, [*DOC, "line_idx"], "left").join(look, [*DOC, "styling"]).join(props, [*DOC, *shape])
    none = F.array().cast("array<struct<run_pos:int,text:string,framed:boolean,heavier:boolean>>")
    rows = rows.withColumn("runs", F.coalesce("runs", none)).join(extract.inherited_font(lines, declared), [*DOC, "line_idx"], "left")
    rows = rows.join(docs.select(*DOC, "spine_pos", "language"), DOC)
    body = layout.body_style(rows.select("book_id", "spine_pos", "line_idx", F.col("line_size").alias("size"), F.col("line_indented").alias("indented")))
    rows = layout.sub_headings(rows, body).checkpoint()
    rows = rows.withColumn("heading", F.col("kind") != 0).withColumn("styled", F.size("chain") > 0)
    rows = layout.style_gaps(rows).withColumn("blanks", F.col("new_blanks"))
    caption = F.concat(X.caption_word(F.col("language")), F.lit(":["), "text", F.lit("]"))
    rows = rows.withColumn("text", F.when(F.col("kind") == 3, caption).otherwise(F.col("text")))
    rows = rows.select(*DOC, "spine_pos", "language", "line_idx", "text", "blanks", "kind")
    held = boxes.join(declared, [*DOC, *shape])
    rows = layout.collapse_rules(layout.border_lines(rows, held))
    return rows.withColumn("kind", F.when(F.col("text") == X.RULE, 0).otherwise(F.col("kind"))).withColumnRenamed("sub", "edge")


def _margin(side: str) -> Column:
    get = lambda k: F.element_at("props", k)
    return F.coalesce(C.css_length(F.coalesce(get(f"margin-{side}"), C.css_side(get("margin"), side))), F.lit(0.0))


def book_pieces(packages: DataFrame, entries: DataFrame, docs: DataFrame, with_cover: bool = True, banner: str = X.BANNER) -> tuple[DataFrame, DataFrame, list[str]]:
    """book_id, title, error of every book in packages; its pieces (sep, block), a row each; and the columns that order them. No row holds a book."""
    noted, stars = with_notes(docs)
    found = extract.extract_documents(noted, scan=False).checkpoint()
    lines = styled_lines(docs, extract.table_of(found, "lines"), extract.table_of(found, "boxes"), entries).checkpoint()
    anchors = extract.table_of(found, "anchors")
    lines = N.star_note_lines(lines, anchors, stars)
    # lines are numbered anew with the rules and note lines among them; an anchor is at the first of its line
    n = F.row_number().over(W.partitionBy(*DOC).orderBy("line_idx", "edge", "sub")) - 1
    lines = lines.withColumn("was", F.col("line_idx")).withColumn("line_idx", n).drop("edge", "sub").checkpoint()
    moved = lines.groupBy(*DOC, "was").agg(F.min("line_idx").alias("line_idx"))
    anchors = anchors.withColumnRenamed("line_idx", "was").join(moved, [*DOC, "was"]).select(*DOC, "name", "line_idx")

    toc = book_toc(packages, entries)
    titles = S.title_pages(lines, toc, packages.select("book_id", "title", "authors", "publisher"))
    contents = S.contents_pages(lines, toc).select(*DOC, F.lit(True).alias("is_contents"))
    texted = lines.select(*DOC).distinct().withColumn("has_text", F.lit(True))
    state = docs.select("book_id", "spine_pos", "doc").join(texted, DOC, "left").join(titles.withColumn("is_title", F.lit(True)), DOC, "left").join(contents, DOC, "left")
    state = S.title_page_cut(state.fillna(False, ["has_text", "is_title", "is_contents"])).withColumn("skipped", F.col("dropped") | F.col("is_contents")).checkpoint()
    guessed = state.filter("dropped and guessed_date is not null").groupBy("book_id").agg(F.min_by("guessed_date", "spine_pos").alias("guessed"))

    listed = S.carry_toc_forward(state, S.toc_for_docs(docs, toc).filter("toc_pos is not null"))
    place = F.row_number().over(W.partitionBy("book_id").orderBy("spine_pos", "toc_pos"))
    listed = listed.withColumn("toc_pos", place).withColumn("fragment", F.when(F.col("spine_pos") == F.col("land_pos"), F.col("fragment")))
    landing = state.select("book_id", F.col("spine_pos").alias("land_pos"), F.col("doc").alias("landing"))
    listed = listed.join(landing, ["book_id", "land_pos"], "left").select("book_id", F.col("landing").alias("doc"), "land_pos", "toc_pos", "depth", "fragment", "label")
    starts = listed.join(anchors.withColumnRenamed("name", "fragment"), [*DOC, "fragment"], "left").withColumn("start", F.coalesce("line_idx", F.lit(0))).drop("line_idx").checkpoint()
    shown = ~X.is_contents_label(F.col("label"))

    kept = lines.join(state.filter("not skipped").select(*DOC), DOC, "left_semi")
    inside = S.section_lines(kept, anchors, listed.filter("doc is not null")).filter(shown)
    inside = inside.join(kept.select(*DOC, "line_idx", "kind"), [*DOC, "line_idx"])
    inside = S.strip_repeated_title(inside).select(*DOC, "line_idx", "toc_pos")
    opening = kept.join(starts.select(*DOC).distinct(), DOC, "left_anti").select(*DOC, "line_idx", F.lit(None).cast("int").alias("toc_pos"))
    rows = kept.join(inside.unionByName(opening), [*DOC, "line_idx"])
    rows = rows.join(starts.select("book_id", "toc_pos", "start"), ["book_id", "toc_pos"], "left")
    new = ~F.col("toc_pos").eqNullSafe(F.lag("toc_pos").over(W.partitionBy("book_id").orderBy("spine_pos", "line_idx")))
    rows = assemble.heading_spacing(rows.withColumn("section_start", new).withColumn("indent", X.indent(F.col("language"))))
    at = lambda spine, start, toc, line, n: F.struct(*[c.cast("int").alias(k) for k, c in zip(("spine_pos", "start", "toc_pos", "line_idx", "n"), (spine, start, toc, line, n))])
    none = F.lit(-1)
    rows = rows.select("book_id", "spine_pos", F.coalesce("start", none).alias("start"), F.coalesce("toc_pos", none).alias("toc_pos"), "line_idx", F.posexplode("blocks").alias("n", "block"))
    body = rows.select("book_id", at(*[F.col(c) for c in ("spine_pos", "start", "toc_pos", "line_idx", "n")]).alias("pos"), "block", F.lit(False).alias("is_fence"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("label"))
    fences = starts.filter(shown).select("book_id", at(F.coalesce("land_pos", F.lit(END)), F.col("start"), F.col("toc_pos"), none, none).alias("pos"), X.fence(F.col("depth"), F.col("label")).alias("block"), F.lit(True).alias("is_fence"), "depth", "label")
    blocks = assemble.place_contents(body.unionByName(fences).checkpoint(), packages.select("book_id", "language"))

    metas = A.part(packages, "metas")
    cover = A.pick_cover(A.part(packages, "manifest"), metas, entries)
    places = entries.filter("name is not null").select("book_id", X.resolve_path(F.lit(""), F.col("name")).alias("cover_path"), "name")
    # of all images only the covers are read
    cover = A.read_entries(cover.join(places, ["book_id", "cover_path"]).filter(F.lit(with_cover)).groupBy("book_id").agg(F.min("name").alias("name"))).checkpoint()
    about = packages.filter("error is null").join(A.book_series(metas), "book_id", "left").join(guessed, "book_id", "left").join(cover.select("book_id", F.lit(True).alias("has_cover")), "book_id", "left")
    head = X.header_block(
        F.col("title"), F.col("authors"), F.col("publisher"), F.col("date"), F.col("language"), F.col("series"), F.col("series_index"), F.coalesce("has_cover", F.lit(False)),
        J.stem(F.col("book_id")), F.col("guessed"), banner,
    )
    nowhere = F.lit(None).cast(blocks.schema["pos"].dataType).alias("pos")
    blocks = blocks.unionByName(about.select("book_id", F.lit(0).alias("part"), nowhere, head.alias("block")))
    blocks = blocks.unionByName(cover.select("book_id", F.lit(4).alias("part"), nowhere, X.cover_block(F.col("content")).alias("block")))
    order, by = ["part", "pos"], ["part", "pos.spine_pos"]
    pieces = assemble.join_blocks(blocks, order, by)
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(J.stem(F.col("book_id")))
    return packages.select("book_id", title.alias("title"), "error"), pieces, order
