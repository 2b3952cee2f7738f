"""Whole jobs: pages to one text a host, and a library of archives to text books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from booktext.functions import text as X
from booktext.operators import assemble, extract


def text_books(docs: DataFrame) -> DataFrame:
    """docs(book_id, spine_pos, doc, language, html) to book_id, text, n_lines: every paragraph indented for its language,
    documents in reading order."""
    carry = ("spine_pos", "language")
    found = extract.extract_documents(docs, scan=False, tables=("lines",), carry=carry)
    rows = extract.table_of(found, "lines", carry).select("book_id", "doc", *carry, "line_idx", "text", "blanks")
    block = X.body_line(F.col("text"), X.indent(F.col("language")))
    blank = F.array_repeat(F.struct(F.lit(0).alias("sub"), F.lit("").alias("block")), F.col("blanks"))
    items = F.concat(blank, F.array(F.struct(F.lit(1).alias("sub"), block.alias("block"))))
    blocks = rows.select("book_id", "spine_pos", "line_idx", F.posexplode(items).alias("n", "x")).select("book_id", "spine_pos", "line_idx", "n", "x.block")
    order = ["spine_pos", "line_idx", "n"]
    pieces = assemble.join_blocks(blocks, order, order[:1])
    n = rows.groupBy("book_id").agg(F.count("*").alias("n_lines"))
    return assemble.assemble_books(pieces, order, order[:1]).join(n, "book_id")
