"""Real files from rows: ``placed_files`` writes each row's text at its byte place in the file it names.

A page is a file of one row; a document of any size is a file of many, each at the sum of the
bytes before it, so many tasks write one document at once and none holds it. A task that runs
again writes the same bytes at the same places, so a lost executor or a second attempt changes
nothing. The folder counts only when all tasks have committed and its marker stands.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from inkweave.operators.ordered import running
from inkweave.session import stage, width

MARKER = "_SUCCESS"
#: Bytes that a task gathers before it writes.
GATHERED = 8 << 20


def _local(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: files are written at places, which needs a mounted file system; use write_document for others")
    return unquote(parsed.path) if parsed.scheme else path


class _Placed(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = _local(path)
        if os.path.exists(os.path.join(self.path, MARKER)):
            raise FileExistsError(f"{path} holds finished files")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, start, parts, size = None, 0, [], 0
        for batch in iterator:
            for file, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and (file != name or at != start + size or size >= GATHERED):
                    self._flush(name, start, parts)
                    parts, size = [], 0
                if not parts:
                    name, start = file, at
                parts.append((text or "").encode())
                size += len(parts[-1])
        if parts:
            self._flush(name, start, parts)
        return WriterCommitMessage()

    def _flush(self, name: str, start: int, parts: list[bytes]) -> None:
        target = os.path.normpath(os.path.join(self.path, name))
        if not target.startswith(os.path.join(os.path.normpath(self.path), "")):
            raise ValueError(f"{name} leaves the folder")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        handle, data = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644), memoryview(b"".join(parts))
        try:
            while len(data):
                done = os.pwrite(handle, data, start)
                start, data = start + done, data[done:]
        finally:
            os.close(handle)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        open(os.path.join(self.path, MARKER), "w").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing to undo: without the marker no file counts."""


class PlacedFiles(DataSource):
    """``placed_files``: rows (file, at, text) into files under ``path``, which must not hold finished ones."""

    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def schema(self) -> str:
        return "file string, at bigint, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Placed(self.options["path"])


def _write(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(PlacedFiles)
    rows.write.format("placed_files").mode("append").save(path)


def _folder(job_id: Column) -> Column:
    """Folder of a job, named as partition folders are."""
    return F.concat(F.lit("job_id="), F.replace(F.url_encode(job_id), F.lit("+"), F.lit("%20")), F.lit("/"))


def write_markdown(files: DataFrame, path: str, name: str = "filename", text: str = "content") -> None:
    """One file per row of ``files(job_id, <name>, <text>)``; names are unique in a job (see ``bundle.last_write_wins``)."""
    _write(files.select(F.concat(_folder(F.col("job_id")), F.col(name)).alias("file"), F.lit(0).cast("long").alias("at"), F.col(text).alias("text")), path)


def with_offsets(parts: DataFrame, order: list[str]) -> DataFrame:
    """``parts`` with ``at``: the bytes of the job's parts before. A large job is cut at range borders and summed in two steps."""
    cut = stage(parts.repartitionByRange(width(parts.sparkSession), "job_id", *order).withColumn("_part", F.spark_partition_id().cast("long")))
    sums = {"_end": F.octet_length("text").cast("long")}
    return running(cut, ["job_id"], F.col("_part"), [F.col(c) for c in order], sums=sums).withColumn("at", F.col("_end") - F.octet_length("text")).drop("_end", "_part")


def write_single(parts: DataFrame, path: str, order: list[str], name: str = "all_docs.md") -> None:
    """One file per job from ``parts(job_id, *order, text)``, each part at its offset."""
    placed = with_offsets(parts, order).select(F.concat(_folder(F.col("job_id")), F.lit(name)).alias("file"), "at", "text")
    ranged = placed.repartitionByRange(width(parts.sparkSession), "file", "at").sortWithinPartitions("file", "at")
    _write(ranged, path)


def single_documents(spark: SparkSession, path: str, name: str = "all_docs.md") -> DataFrame:
    """(job_id, n_bytes, content) of what :func:`write_single` wrote; content is read only if it is used. A document without a byte gives no row."""
    if not os.path.exists(os.path.join(_local(path), MARKER)):
        raise FileNotFoundError(f"{path} holds no finished files")
    from inkweave.sources.readers import job_of_path

    return spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path).select(
        job_of_path(F.col("_metadata.file_path")).alias("job_id"), F.col("length").alias("n_bytes"), "content")
