"""WARC archives as dictionary-compressed Zstandard: one frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import RK, forget, map_arrow, materialize, new_path, number, raw

SKIPPABLE = 0x184D2A5D  # frame type that the .warc.zst format gives to its dictionary
SAMPLE_BYTES, SAMPLE_RECORD = 2 << 20, 16 << 10  # bound of what a dictionary is trained on: in all, and of each record
DICT_BYTES, LEVEL = 32 << 10, 3
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(page: str | None, row: int | None) -> str:
    """The name of a page's record: its id, percent-encoded; a page without an id is named by its row."""
    return f"<urn:row:{row}>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def record(name: str, url: str, payload: bytes, digest: str, target: str | None) -> bytes:
    """One response record, or a revisit record of the record named `target`, which carries the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if target is not None else http + payload
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if target is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {target}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, smaller for less text; where there is too little to train on, the text itself."""
    size = DICT_BYTES
    while size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:
            size //= 2
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterator[bytes], sample_bytes: int = SAMPLE_BYTES, sample_record: int = SAMPLE_RECORD) -> int:
    """Dictionary from the first records, `sample_bytes` in all and `sample_record` of each; then every record, whole, as a frame of its own."""
    held, size, n = [], 0, 0
    for x in records:
        held.append(x)
        size += len(x)
        if size >= sample_bytes:
            break
    trained = train([x[:sample_record] for x in held])
    body = trained.as_bytes()
    out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    for part in (held, records):
        for x in part:
            out.write(press.compress(x))
            n += 1
        held = None
    return n


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    head = source.read(8)
    trained = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        trained = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1]))
        head = b""
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(opener.stream_reader(_Chain(head, source), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block


class _Chain:
    def __init__(self, first: bytes, rest) -> None:
        self.first, self.rest = first, rest

    def read(self, n: int = -1) -> bytes:
        if self.first:
            first, self.first = self.first, b""
            return first
        return self.rest.read(n)


def _write(place: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                data, offs = raw(batch.column(2))
                ids, urls, rows, keepers, targets = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
                for i in range(len(batch)):
                    payload = data[offs[i] : offs[i + 1]].tobytes()
                    target = None if keepers[i] is None else urn(targets[i], keepers[i])
                    yield record(urn(ids[i], rows[i]), urls[i] or "", payload, hashlib.sha1(payload).hexdigest(), target)

        todo = records()
        first = next(todo, None)
        if first is None:
            return
        fs, base = pyarrow.fs.FileSystem.from_uri(place)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"  # each attempt has its own file; the manifest names those of tasks that ended well
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            n = write_archive(out, _after(first, todo))
        yield pa.RecordBatch.from_arrays([pa.array([f"{place}/{name}"]), pa.array([n])], names=["path", "records"])

    return run


def _after(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _page(name: str | None) -> str | None:
    """The page that a record's name stands for, if it has an id."""
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name and name.startswith("<urn:page:") else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, where = pyarrow.fs.FileSystem.from_uri(path)
            rows = []
            with fs.open_input_stream(where, compression=None) as source:
                for fields, block in read_archive(source):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} is damaged")
                    rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
                    if len(rows) >= 5000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)


def write_warc(pages: DataFrame, place: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Write a record for each row under `place`; of equal payloads of at least `least` bytes the one with the largest id is the response, others revisit it.

    Payloads are compared by SHA-1 and length, grouped with map-side partial maxima; only keys move for that, and a hot
    payload's partition is split at the join. Returns (path, records), already written.

    Defined cases: a null payload is empty; a null url is an empty string, line ends in it are percent-encoded; an id may
    be of any type and hold any character; a null id stays null, its record is named by its row; rows that repeat an id
    are records of their own; of tied ids one row is the response; a very long payload is held whole, four times over; an
    empty table writes no file; other columns are ignored, whatever their names.
    """
    own = F.col(f"`{id_col}`")
    rows = number(pages.select(own.alias("id", metadata=pages.schema[id_col].metadata), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{payload_col}`").alias("payload")), "id")
    body = F.coalesce("payload", F.lit(""))
    big = rows.select(RK, "id", F.unhex(F.sha1(body.cast("binary"))).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    kept = big.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("id", RK)).alias("last")).where("n > 1")
    kept = materialize(kept.select("digest", "size", F.col(f"last.{RK}").alias("keeper"), F.col("last.id").cast("string").alias("target")), "warc-kept")
    again = big.join(kept, ["digest", "size"]).where(F.col(RK) != F.col("keeper")).select(RK, "keeper", "target")
    whole = rows.join(again, RK, "left").select(F.col("id").cast("string").alias("id"), "url", "payload", RK, "keeper", "target")
    made = materialize(map_arrow(whole, _write(place), "path string, records long"), "warc-manifest")
    forget(kept)
    return made


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to) of the files that a manifest names; payloads are checked against their digests."""
    files = manifest.select("path")
    n = max(1, min(files.count(), 4096))
    return map_arrow(files.repartition(n, "path"), _read, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", **names: str) -> DataFrame:
    """write_warc to the shared folder, then read_warc."""
    kind = pages.schema[id_col].dataType
    got = read_warc(write_warc(pages, new_path(pages.sparkSession, "warc"), id_col, **names))
    # every name that was read is null or stands for an id of this type
    return got.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
