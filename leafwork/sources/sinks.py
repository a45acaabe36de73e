"""A sink that writes a file for each row, and shows none of them before the whole job has succeeded.

A task's attempt writes its files, and a list of them, into a folder of its own under `_attempts`; what it reports to the
driver is where that list is. The commit moves the files of the attempts that count to their places and their lists to
`_manifest`, a task at a time; then, as after a failed job, the job's attempts go. So attempts that were killed, run twice
or lost leave nothing, and a job that failed leaves no file among the documents; a task that outlives its failed job can leave its attempt,
which nobody reads.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILES = "doc_id string, chapter_index int, output_name string, data binary, error string"
MANIFEST = "doc_id string, chapter_index int, path string, bytes long, error string"
ATTEMPTS, LISTS = "_attempts", "_manifest"
MOST = 8 << 20  # bytes of files that an Arrow batch holds


def located(place: str) -> str:
    """A folder as Arrow's file systems want it: a URI or an absolute path."""
    return place.rstrip("/") if "://" in place else os.path.abspath(place)


def folder_of(doc_id: str) -> str:
    """A folder of the document's own: letters, digits and ._-~ stay, other bytes are percent-encoded, and a name of dots too.

    The sink's own folders are no document's.
    """
    name = quote(str(doc_id), safe="")
    if name in (ATTEMPTS, LISTS):
        return "%5F" + name[1:]
    return name if name.strip(".") else name.replace(".", "%2E") or "%"


@dataclass
class Written(WriterCommitMessage):
    attempt: str | None  # its folder


class ChapterFiles(DataSource):
    """df.write.format("chapter_files").option("path", folder): rows as FILES says; those with an error, or without data, are listed alone.

    Files of a document share a folder. Of rows that name the same file the one listed last stays.
    """

    @classmethod
    def name(cls) -> str:
        return "chapter_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("chapter_files adds to a folder: use mode('append')")
        return FilesWriter(located(self.options["path"]), self.options.get("job") or uuid.uuid4().hex)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, place: str, job: str) -> None:
        self.place, self.job = place, job

    def open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.place)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Runs in tasks. A task without rows leaves nothing to commit."""
        task, listed, folder = TaskContext.get(), None, None
        for batch in batches:
            if not len(batch):
                continue
            if listed is None:
                fs, base = self.open()
                folder = f"{base}/{ATTEMPTS}/{self.job}/{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}"
                fs.create_dir(folder, recursive=True)
                listed, n = fs.open_output_stream(f"{folder}/list"), 0
            named = {c: batch.column(c).to_pylist() for c in ("doc_id", "chapter_index", "output_name", "error")}
            data = batch.column("data")
            for k, (doc_id, chapter, name, error) in enumerate(zip(*named.values(), strict=True)):
                row = {"doc_id": doc_id, "chapter_index": chapter, "path": None, "bytes": 0, "error": error}
                if error is None and data[k].is_valid:
                    place, n = f"{folder_of(doc_id)}/{name}", n + 1
                    with fs.open_output_stream(f"{folder}/{n}") as out:
                        out.write(data[k].as_buffer())
                    row |= {"path": f"{self.place}/{place}", "bytes": len(data[k].as_buffer()), "from": n, "to": place}
                listed.write(json.dumps(row).encode() + b"\n")
        if listed is not None:
            listed.close()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        """Runs in the driver, which holds the list of one task at a time. Tasks are taken in order, so that of files of one name the same stays each time."""
        fs, base = self.open()
        folders: set[str] = set()
        for k, folder in enumerate(sorted(m.attempt for m in messages if m is not None and m.attempt)):
            with fs.open_input_stream(f"{folder}/list") as listed:
                rows = [json.loads(line) for line in listed.readall().splitlines()]
            for row in rows:
                if row["path"] is not None:
                    target = f"{base}/{row['to']}"
                    if (above := target.rpartition("/")[0]) not in folders:
                        fs.create_dir(above, recursive=True)
                        folders = {above}
                    fs.move(f"{folder}/{row['from']}", target)
            fs.create_dir(f"{base}/{LISTS}", recursive=True)
            fs.move(f"{folder}/list", f"{base}/{LISTS}/{self.job}-{k:06d}")
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """This job's attempts go, also those that nobody reported; the folder of attempts too, once it is empty."""
        fs, base = self.open()
        with suppress(FileNotFoundError):
            fs.delete_dir(f"{base}/{ATTEMPTS}/{self.job}")
        if not fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{ATTEMPTS}", allow_not_found=True)):
            with suppress(FileNotFoundError):
                fs.delete_dir(f"{base}/{ATTEMPTS}")


def write_files(files: DataFrame, place: str) -> DataFrame:
    """Write rows as FILES says, now and once; returns what was written, read from the job's lists: any action on that writes nothing.

    (doc_id, chapter_index, path, bytes, error): path is null, and error says why, for what could not be made.
    """
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(ChapterFiles)
    with batches_of(spark, MOST):
        files.write.format(ChapterFiles.name()).mode("append").option("path", place).option("job", job).save()
    return manifest(spark, place, job)


def manifest(spark: SparkSession, place: str, job: str = "") -> DataFrame:
    """What jobs, or one of them, wrote below a folder."""
    fs, base = pyarrow.fs.FileSystem.from_uri(located(place))
    found: Iterable = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{LISTS}", allow_not_found=True))
    lists = [f"{located(place)}/{LISTS}/{f.base_name}" for f in found if f.base_name.startswith(job)]
    return spark.read.schema(MANIFEST).json(lists) if lists else spark.createDataFrame([], MANIFEST)


class batches_of:  # noqa: N801
    """Within it, Arrow batches hold at most so many bytes; then what the session had is put back."""

    NAME = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark: SparkSession, most: int) -> None:
        self.conf, self.most = spark.conf, most

    def __enter__(self) -> None:
        self.before = self.conf.get(self.NAME, None)
        self.conf.set(self.NAME, str(self.most))

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(self.NAME)
        else:
            self.conf.set(self.NAME, self.before)
