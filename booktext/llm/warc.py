"""WARC archives: writing pages as records, and reading them back with segment reassembly.

The writer frames each payload as an HTTP response with chunked transfer coding and cuts blocks
longer than a segment into a first record and continuation records. The reader parses the files
record by record by Content-Length, groups continuation records by origin identifier, orders them by
segment number, verifies the total length, and decodes the chunked framing.

Nulls: a null html is an empty payload; a null id is written as "null" and read back as null. Of equal
payloads the smallest id is the response (nulls last). Repeated ids give records of their own, since a record's name holds its
id, its payload's digest and, where rows are equal in both, a number for each copy; so all rows are read back as many times as
they were written. Empty tables give empty archives. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir

#: Bytes of a block that one record holds at most; longer blocks go on in continuation records.
SEGMENT_BYTES = 48 * 1024
CHUNK_BYTES = 16 * 1024
#: Records in one archive file at most: with segments, a file is bounded by FILE_RECORDS * SEGMENT_BYTES.
FILE_RECORDS = 2_000
DATE = "2024-01-01T00:00:00Z"

RECORD = "record_id string, warc_type string, origin string, segment int, total long, refers_to string, digest string, block binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer coding."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload inside chunked framing; ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, ident: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", DATE), *extra, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _records(ident: str, url: str, payload: bytes, refers: str | None, copy: int, segment: int) -> list[bytes]:
    """All records of one page. The page's name is its id and its payload's digest, a record's name adds the number of the copy."""
    digest = sha1_base32(payload)
    rid = f"urn:page:{ident}:{digest}:{copy}"
    url = "".join(c for c in url if c > " ") or "urn:none"
    extra = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record("revisit", rid, http, [*extra, ("WARC-Refers-To", f"<urn:page:{refers}:{digest}:0>"), ("WARC-Profile", profile)])]
    block = http + chunked(payload)
    if len(block) <= segment:
        return [_record("response", rid, block, extra)]
    cuts = range(0, len(block), segment)
    out = [_record("response", rid, block[:segment], [*extra, ("WARC-Segment-Number", "1")])]
    for n, at in enumerate(cuts[1:], 2):
        more = [("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", str(n))]
        if n == len(cuts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record("continuation", f"{rid}:{n}", block[at : at + segment], more))
    return out


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT_BYTES) -> None:
    """Write pages(page_id, url, html) as gzipped archives under path: a response for each payload of at least
    min_bytes (the smallest page_id), revisits for its other pages, responses for smaller payloads."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    # which pages revisit which: decided over ids and digests alone, so that no payload meets its copies
    each = rows.groupBy("page_id", "key").agg(F.count("*").alias("copies"), F.first(F.length("payload")).alias("size"))
    first = each.groupBy("key").agg(F.min("page_id").alias("first_id"), F.sum("copies").alias("n")).filter("n > 1").select(F.col("key").alias("k"), "first_id")
    each = each.join(first, F.col("key") == F.col("k"))
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    refers = F.when(revisit, F.coalesce(F.col("first_id").cast("string"), F.lit("null")))
    told = each.select(F.col("page_id").alias("p"), "k", refers.alias("refers"), "copies").filter("refers is not null or copies > 1")
    rows = rows.join(told, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left")
    # of equal rows each has a number, in any order
    copy = F.when(F.col("copies") > 1, F.monotonically_increasing_id() + 1).otherwise(0).alias("copy")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for ident, url, payload, refers, copy in zip(b["id"], b["url"], b["payload"], b["refers"], b["copy"]):
                for record in _records(ident, url, bytes(payload), refers, int(copy), segment):
                    out.append(record[:-1])  # the writer of lines adds the last line feed
                    size += len(record)
                if size > 4_000_000:
                    yield pd.DataFrame({"record": out})
                    out, size = [], 0
            yield pd.DataFrame({"record": out})

    ident = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("id")
    records = rows.select(ident, "url", "payload", "refers", copy).mapInPandas(made, "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", "\n").text(path)
    )


def parse(stream: Iterator[bytes]) -> Iterator[tuple]:
    """Records of one archive, from its decompressed bytes in pieces."""
    buf = b""
    stream = iter(stream)

    def more(n: int) -> bool:
        nonlocal buf
        parts = [buf]
        have = len(buf)
        while have < n:
            piece = next(stream, None)
            if piece is None:
                break
            parts.append(piece)
            have += len(piece)
        buf = b"".join(parts)
        return have >= n

    while True:
        at = buf.find(b"\r\n\r\n")
        while at < 0:
            if not more(len(buf) + 1):
                if buf.strip():
                    raise ValueError("archive ends inside a header")
                return
            at = buf.find(b"\r\n\r\n")
        lines = buf[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not more(at + 4 + size + 4):
            raise ValueError("archive ends inside a block")
        block, buf = buf[at + 4 : at + 4 + size], buf[at + 8 + size :]
        uri = lambda k: head.get(k, "").strip("<>") or None
        total = head.get("warc-segment-total-length")
        digest = head.get("warc-payload-digest", "").partition(":")[2] or None
        yield (
            uri("warc-record-id"), head["warc-type"], uri("warc-segment-origin-id"), int(head.get("warc-segment-number", 0)),
            int(total) if total else None, uri("warc-refers-to"), digest, block,
        )


def _inflate(content: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Bytes of a gzip file (of any number of members) or a plain one, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        d = zlib.decompressobj(31)
        for at in range(0, len(content), step):
            yield d.decompress(content[at : at + step])
            if d.eof:
                break
        content = d.unused_data + content[at + step :] if d.eof else b""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under path, as they stand (segments apart)."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for content in b["content"]:
                rows, size = [], 0
                for r in parse(_inflate(bytes(content))):
                    rows.append(r)
                    size += len(r[-1])
                    if size > 4_000_000:
                        yield pd.DataFrame(rows, columns=names).astype({"total": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"total": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(parsed, RECORD)


@F.pandas_udf(T.StructType().add("payload_bytes", T.LongType()).add("payload_digest", T.StringType()).add("ok", T.BooleanType()))
def decoded(blocks: pd.Series) -> pd.DataFrame:
    """Size and digest of the payload of each block (given in parts); null and not ok where there is none or its framing is broken."""
    rows = []
    for parts in blocks:
        try:
            head, _, body = b"".join(map(bytes, parts)).partition(b"\r\n\r\n")
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            rows.append((len(payload), sha1_base32(payload), True))
        except (ValueError, TypeError):  # no block, or broken framing
            rows.append((None, None, False))
    out = pd.DataFrame(rows, columns=["payload_bytes", "payload_digest", "ok"])
    return out.astype({"payload_bytes": "Int64", "ok": "bool"})


def decode_singles(records: DataFrame) -> DataFrame:
    """records with d, the decoded payload of unsegmented responses; only segments keep their block."""
    alone = (F.col("segment") == 0) & (F.col("warc_type") == "response")
    rows = records.withColumn("d", decoded(F.when(alone, F.array("block"))))
    return rows.withColumn("block", F.when(F.col("segment") > 0, F.col("block")))


def payloads(records: DataFrame) -> DataFrame:
    """One row a page: record_id, warc_type, refers_to, digest, payload_bytes, payload_digest, ok.

    Single records are decoded where they are; only segments are shuffled, by origin identifier."""

    records = records if "d" in records.columns else decode_singles(records)
    single = records.filter("segment = 0 and warc_type = 'response'").select("record_id", "warc_type", "refers_to", "digest", "d")
    parts = records.filter("segment > 0").withColumn("origin", F.coalesce("origin", "record_id"))
    whole = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("segment").alias("last"),
        F.count("*").alias("n"),
        F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
    )
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"]))
    good = (F.col("n") == F.col("last")) & (F.col("total") == size)
    blocks = F.when(good, F.transform("parts", lambda x: x["block"])).alias("block")
    whole = whole.select(F.col("origin").alias("record_id"), F.lit("response").alias("warc_type"), F.lit(None).cast("string").alias("refers_to"), "digest", blocks)
    rows = single.unionByName(whole.withColumn("d", decoded("block")).drop("block"))
    rows = rows.select("record_id", "warc_type", "refers_to", "digest", "d.*")
    return rows.withColumn("ok", F.col("ok") & F.col("payload_digest").eqNullSafe(F.col("digest")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, ok; revisits take the size from their response."""
    records = materialize(decode_singles(read(spark, path)), "warc-records")  # archives are parsed once
    found = payloads(records)
    ident = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    revisits = records.filter("warc_type = 'revisit'").select("record_id", "refers_to", "digest")
    page = lambda c: F.substring_index(c, ":", 4)  # noqa: E731  urn:page:id:digest
    sized = found.select(page(F.col("record_id")).alias("r2"), "payload_bytes", "payload_digest", "ok")
    revisits = revisits.join(sized.dropDuplicates(["r2"]), page(F.col("refers_to")) == F.col("r2"), "left")
    back = revisits.select(
        "record_id", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"),
        (F.coalesce("ok", F.lit(False)) & F.col("payload_digest").eqNullSafe(F.col("digest"))).alias("ok"),
    )
    pages = found.select("record_id", F.lit("response").alias("record_type"), "refers_to", "payload_bytes", "payload_digest", "ok").unionByName(back)
    return pages.select(
        ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"), "ok"
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return read_pages(spark, path)
