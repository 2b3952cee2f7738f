"""Data sources of the library: a listing of book files, the entries of archives, and a sink of one text file a book.

Files are opened through pyarrow's file systems (local folders, HDFS, S3, Google and Azure stores) by ranges, in tasks. An archive is never
read whole: its central directory first, then the entries that are wanted, one after the other. The sink stages its files beside
the targets and moves them there when all tasks have ended."""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Kinds of entries that are read: packages, tables of contents, documents and style sheets.
KINDS = r"(?i)\.(opf|ncx|x?html?|xml|css)$"
FILES = "book_id string, n_bytes long, changed timestamp"
ENTRIES = "book_id string, name string, size long, content binary, error string"
#: Files of one partition of a listing, bytes of archives of one partition of their entries, and of one batch.
FILES_AT_ONCE, PARTITION_BYTES, BATCH_BYTES = 10_000, 128 << 20, 4 << 20
_ENTRY = pa.schema([("book_id", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it. file:/x, file:///x and /x are one."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def list_books(path: str, recurse: bool, suffix: str) -> list[tuple[str, int, object]]:
    """(address, bytes, time of change) of the files below path whose names end so, in any case; empty ones too."""
    store, root = opened(path)
    scheme = "" if isinstance(store, fs.LocalFileSystem) else path.partition("://")[0] + "://"
    found = store.get_file_info(fs.FileSelector(root, recursive=recurse, allow_not_found=True))
    return sorted((scheme + f.path, f.size or 0, f.mtime) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


def entry_rows(book: str, keep: re.Pattern, content: bytes | None = None, only: set[str] | None = None) -> Iterator[tuple]:
    """(book_id, name, size, content, error) of an archive's entries in the order of its directory; content only of names that match keep (or
    are in only). Damage is one row with an error, after the entries before it."""
    try:
        store, path = opened(book)
        source = pa.BufferReader(content) if content is not None else store.open_input_file(path)
        with source as f, zipfile.ZipFile(f) as z:
            for i in z.infolist():
                if only is None or i.filename in only:
                    yield book, i.filename, i.file_size, z.read(i) if only is not None or keep.search(i.filename) else None, None
    except Exception as e:  # noqa: BLE001 - any damage is this book's outcome, not the job's
        yield book, None, None, None, f"{type(e).__name__}: {e}"


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRIES in batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[3] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ENTRY)], schema=_ENTRY)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ENTRY)], schema=_ENTRY)


@dataclass
class Files(InputPartition):
    files: list


class BookFiles(DataSource):
    """format("book_files").load(path): FILES of the books below a path; options recurse and suffix."""

    @classmethod
    def name(cls) -> str:
        return "book_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(dict(self.options))


class FileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.recurse, self.suffix = options["path"], options.get("recurse", "false").lower() == "true", options.get("suffix", ".epub").lower()
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the address are applied to the listing; the others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("book_id",):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, book: str) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return book == f.value
            return book in f.value if isinstance(f, In) else book.startswith(f.value) if isinstance(f, StringStartsWith) else book.endswith(f.value)

        return all(map(one, self.tests))

    def found(self) -> list[tuple]:
        return [f for f in list_books(self.path, self.recurse, self.suffix) if self._passes(f[0])]

    def partitions(self) -> list[Files]:
        found = self.found()
        return [Files(found[i : i + FILES_AT_ONCE]) for i in range(0, len(found) or 1, FILES_AT_ONCE)]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from partition.files


class BookArchives(BookFiles):
    """format("book_archives").load(path): ENTRIES of the archives below a path; options recurse, suffix and keep (a pattern of names)."""

    @classmethod
    def name(cls) -> str:
        return "book_archives"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(FileReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.keep = re.compile(options.get("keep", KINDS))

    def partitions(self) -> list[Files]:
        """Neighbours by address, up to PARTITION_BYTES of archives or FILES_AT_ONCE of them a partition."""
        out, size = [], 0
        for f in self.found():
            if not out or size + f[1] > PARTITION_BYTES or len(out[-1].files) == FILES_AT_ONCE:
                out.append(Files([]))
                size = 0
            out[-1].files.append(f)
            size += f[1]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from batched(row for book, _, _ in partition.files for row in entry_rows(book, self.keep))


@dataclass
class Staged(WriterCommitMessage):
    files: list


class TextBooks(DataSource):
    """format("text_books").save(folder) of rows (target, piece): each target is one UTF-8 file of that name below the folder, with a byte order
    mark, its pieces in the order of the rows, ended by one line feed. A target's rows must stand together in one partition. Files
    that are there are replaced; nothing is to be seen before all tasks have ended, nor what killed tasks left."""

    @classmethod
    def name(cls) -> str:
        return "text_books"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TextWriter(self.options["path"])


class TextWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.staging = path, f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = opened(self.path)
        mine = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # another attempt of this task has a folder of its own
        store.create_dir(mine, recursive=True)
        files, out, now, ended = [], None, None, True

        def close() -> None:
            if out is not None:
                out.write(b"" if ended else b"\n")
                out.close()

        for b in iterator:
            for target, piece in zip(b.column("target").to_pylist(), b.column("piece").to_pylist()):
                if out is None or target != now:
                    close()
                    files.append((f"{mine}/{len(files)}", target))
                    out, now, ended = store.open_output_stream(files[-1][0]), target, False
                    out.write(b"\xef\xbb\xbf")
                if piece:
                    out.write(piece.encode("utf-8", "replace"))
                    ended = piece.endswith("\n")
        close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.path)
        made = set()
        for staged, target in (f for m in messages if m for f in m.files):
            place = posixpath.join(root, target.lstrip("/"))
            folder = posixpath.dirname(place)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            store.move(staged, place)
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


def registered(spark: SparkSession) -> SparkSession:
    """The session with these sources known to it; filters are pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BookFiles, BookArchives, TextBooks):
        spark.dataSource.register(source)
    return spark
