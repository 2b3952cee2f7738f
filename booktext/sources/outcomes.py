"""The outcome log of a library: an append-only table beside the texts, so that a rerun reads neither texts nor archives.

Each run appends one file set of (target, book_id, n_bytes, changed, mark, kind, detail, run). The latest row of a target counts; compaction
writes these rows as a file set of their own and then removes the older ones, so that a reader at any moment finds the same rows."""

from __future__ import annotations

import hashlib
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext.sources.stores import opened

LOG = "target string, book_id string, n_bytes long, changed timestamp, mark string, kind string, detail string, run long"
FOLDER = "_outcomes"


def archive_marks(books: DataFrame) -> DataFrame:
    """book_id, mark: a hash of the names, sizes and checksums in each archive's central directory, which is all that is read of it; null where it
    cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for book in b.column("book_id").to_pylist():
                try:
                    store, path = opened(book)
                    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        marks.append(hashlib.sha1(repr(sorted((i.filename, i.file_size, i.CRC) for i in z.infolist())).encode()).hexdigest())
                except Exception:  # noqa: BLE001 - a broken archive is the outcome of its job
                    marks.append(None)
            yield pa.RecordBatch.from_arrays([b.column("book_id"), pa.array(marks, pa.string())], ["book_id", "mark"])

    return books.select("book_id").mapInArrow(run, "book_id string, mark string")


def _all(spark: SparkSession, outdir: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{outdir}/{FOLDER}/*")
    except AnalysisException:  # there is none yet
        return spark.createDataFrame([], LOG)


def read_log(spark: SparkSession, outdir: str) -> DataFrame:
    """The latest row of each target."""
    rows = _all(spark, outdir)
    latest = F.max_by(F.struct(*rows.columns), F.struct("run", "kind", "detail")).alias("x")
    return rows.groupBy("target").agg(latest).select("x.*")


def append_log(rows: DataFrame, outdir: str) -> None:
    """Add rows(target, book_id, n_bytes, changed, mark, kind, detail) as one run."""
    stamped = rows.withColumn("run", F.unix_micros(F.current_timestamp()))
    stamped.select(*[c.split()[0] for c in LOG.split(", ")]).write.parquet(f"{outdir}/{FOLDER}/run-{uuid.uuid4().hex}")


def compact_log(spark: SparkSession, outdir: str) -> None:
    """Leave only the latest row of each target."""
    before = {f.rpartition("/")[0] for f in _all(spark, outdir).inputFiles()}
    read_log(spark, outdir).write.parquet(f"{outdir}/{FOLDER}/run-{uuid.uuid4().hex}")
    for folder in before:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
