"""EPUB files as a data source that reads of each book only what the asked columns need.

A book is opened at its end: the ZIP directory there says where each file lies, and only the files that are needed are read,
by ranges. What is needed follows from the schema: contents and reading order take the package file and the table of
contents, the content of items takes all of them. Filters on the path choose files before any is opened.
"""

from __future__ import annotations

import fnmatch
import os
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from leafwork.sources.epub_files import BOOK, ITEM, NAMES, PARTS, read_book

BLOCK = 32 << 20  # bytes to be read that a task is given
LIGHT = 64 << 10  # what a book without its items' content counts for


def book_schema(parts: Iterable[str]) -> T.StructType:
    """path, error, bytes_read, and the parts asked for: items (without content), contents (items with it), spine, toc, metadata."""
    parts = set(parts)
    if unknown := parts - set(PARTS):
        raise ValueError(f"a book has no {', '.join(sorted(unknown))}")
    bare = T.ArrayType(T.StructType([f for f in ITEM if f.name != "content"]))
    fields = [T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), T.StructField("bytes_read", T.LongType())]
    for f in BOOK:
        if f.name in parts or f.name == "items" and "contents" in parts:
            fields.append(T.StructField(f.name, bare if f.name == "items" and "contents" not in parts else f.dataType))
    return T.StructType(fields)


@dataclass
class Books(InputPartition):
    paths: list[str]


class Counted:
    """A file that counts what is read from it."""

    def __init__(self, file: pyarrow.NativeFile) -> None:
        self.file, self.bytes = file, 0

    def read(self, n: int = -1) -> bytes:
        out = self.file.read() if n is None or n < 0 else self.file.read(n)
        self.bytes += len(out)
        return out

    def __getattr__(self, name: str):
        return getattr(self.file, name)


class EpubBooks(DataSource):
    """spark.read.format("epub_books").schema(book_schema(...)).load(folder or file): a row a book, whatever its depth below the folder."""

    @classmethod
    def name(cls) -> str:
        return "epub_books"

    def schema(self) -> T.StructType:
        return book_schema(PARTS)

    def reader(self, schema: T.StructType) -> BookReader:
        return BookReader(self.options["path"], schema)


class BookReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.scheme, bare = ("file:", path.removeprefix("file:")) if "://" not in path.removeprefix("file://") else ("", path)
        self.place = os.path.abspath(bare.replace("///", "/")) if self.scheme else bare
        self.columns = [f.name for f in schema]
        self.wanted = {n for n in self.columns if n in PARTS}
        if "items" in self.wanted and "content" in schema["items"].dataType.elementType.names:
            self.wanted.add("contents")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Those on the path are the reader's."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def keeps(self, path: str) -> bool:
        return all(path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value) for f in self.filters)

    def partitions(self) -> list[Books]:
        """Files in blocks of about equal work, in order of their paths. Runs in the driver, which holds the paths alone."""
        fs, base = pyarrow.fs.FileSystem.from_uri(self.place)
        top = fs.get_file_info(base)
        found = [top] if top.is_file else fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        head = self.scheme or self.place.partition("://")[0] + "://"
        out, held = [[]], 0
        for info in sorted(found, key=lambda x: x.path):
            if not info.is_file or not fnmatch.fnmatchcase(info.base_name, NAMES) or not self.keeps(head + info.path):
                continue
            held += info.size if "contents" in self.wanted else min(info.size, LIGHT)
            if out[-1] and held > BLOCK:
                out.append([])
                held = 0
            out[-1].append(head + info.path)
        return [Books(p) for p in out]

    def read(self, partition: Books) -> Iterator[tuple]:
        for path in partition.paths:
            row = {"path": path, "error": None, "bytes_read": 0}
            try:
                fs, base = pyarrow.fs.FileSystem.from_uri(path.removeprefix(self.scheme))
                with fs.open_input_file(base) as file:
                    counted = Counted(file)
                    try:
                        row |= read_book(zipfile.ZipFile(counted), self.wanted)
                    finally:
                        row["bytes_read"] = counted.bytes
            except Exception as e:  # noqa: BLE001  one bad book doesn't end the job
                row |= {"error": f"{type(e).__name__}: {e}", **{c: [] for c in self.wanted if c in self.columns}}
            yield tuple(row[c] for c in self.columns)


def scan_epubs(spark: SparkSession, path: str, parts: Iterable[str] = PARTS) -> DataFrame:
    """One row a book: path, error (null if it could be read), bytes_read and the parts asked for (see book_schema).

    For file systems that pyarrow.fs reads; epub_files.read_epubs reads whole books from any that Spark reads. The session's
    filters may from now on go down to Python data sources.
    """
    spark.dataSource.register(EpubBooks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(EpubBooks.name()).schema(book_schema(parts)).load(path)
