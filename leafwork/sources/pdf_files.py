"""PDF files: outline, layout and metadata as tables, files of page ranges, and a writer of plain text pages.

Where an optional PDF library is installed it reads and cuts; else the reader of this package does, which knows simple files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.paginate import HEIGHT, MARGIN, WIDTH, lay_out
from leafwork.sources.pdf_reader import Pdf

LAYOUT = "path string, total_pages int, error string, outline array<struct<seq:int,level:int,title:string,page:int>>, spans array<struct<page:int,block:int,block_type:int,line:int,span:int,text:string,size:double>>, metadata map<string,string>"


def _text(s: str) -> bytes:
    return s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def text_pdf(text: str, title: str = "", creator: str = "") -> bytes:
    """Wrapped text on A4 pages, as one PDF."""
    pages: dict[int, list[tuple[int, str]]] = {1: []}
    for page, y, line in lay_out(text):
        pages.setdefault(page, []).append((y, line))
    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n)) + b"] /Count %d >>" % n, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Title (" + _text(title) + b") /Creator (" + _text(creator) + b") >>"]
    for k, page in enumerate(sorted(pages)):
        drawn = b"\n".join(b"BT /F1 11 Tf %d %d Td (" % (MARGIN, HEIGHT - y) + _text(line) + b") Tj ET" for y, line in pages[page])
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, 6 + 2 * k))
        objects.append(b"<< /Length %d >>\nstream\n" % len(drawn) + drawn + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def library():
    """The optional PDF library, or None."""
    try:
        import fitz
    except ImportError:
        return None
    return fitz


def parse_pdf(lib, content: bytes) -> dict:
    """total_pages, outline, spans and metadata of one file. lib: the optional library, or None."""
    if lib is None:
        own = Pdf(content)
        spans = [{"page": n, "block": b, "block_type": 0, "line": k, "span": j, "text": text, "size": size} for n, (_, page) in enumerate(own.pages, 1) for b, k, j, text, size in own.spans(page)]
        outline = [{"seq": i, "level": level, "title": title, "page": page} for i, (level, title, page) in enumerate(own.outline(), 1)]
        return {"total_pages": len(own.pages), "outline": outline, "spans": spans, "metadata": own.metadata()}
    with lib.open(stream=content, filetype="pdf") as doc:
        spans = [
            {"page": n, "block": b, "block_type": block.get("type", 0), "line": k, "span": j, "text": span.get("text", ""), "size": float(span.get("size", 0))}
            for n, page in enumerate(doc, 1)
            for b, block in enumerate(page.get_text("dict").get("blocks", []))
            for k, line in enumerate(block.get("lines", []))
            for j, span in enumerate(line.get("spans", []))
        ]
        outline = [{"seq": i, "level": level, "title": title, "page": page} for i, (level, title, page) in enumerate(doc.get_toc(), 1)]
        return {"total_pages": len(doc), "outline": outline, "spans": spans, "metadata": {k: str(v) for k, v in (doc.metadata or {}).items() if v}}


def cut(lib, content: bytes, chapters: list) -> Iterator[tuple[dict, bytes]]:
    """Each chapter with a file of its pages; its metadata is the source's with the chapter's title, or none."""
    if lib is None:
        own = Pdf(content)
        for c in chapters:
            yield c, own.copy(int(c["start_page"]), int(c["end_page"]), own.metadata() | {"title": c["title"]} if c["preserve_metadata"] else {})
        return
    with lib.open(stream=content, filetype="pdf") as doc:
        for c in chapters:
            with lib.open() as part:
                part.insert_pdf(doc, from_page=int(c["start_page"]) - 1, to_page=int(c["end_page"]) - 1)
                if c["preserve_metadata"]:
                    part.set_metadata({**(doc.metadata or {}), "title": c["title"]})
                data = part.tobytes()
            yield c, data


def parse_pdfs(files: DataFrame) -> DataFrame:
    """Outline, layout and metadata of PDF files (path, content). A file that fails has its error in its row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                row = {"path": path, "total_pages": 0, "error": None, "outline": [], "spans": [], "metadata": {}}
                try:
                    row |= parse_pdf(library(), content)
                except Exception as e:  # noqa: BLE001
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([row])  # a file at a time

    return files.mapInPandas(run, LAYOUT)


def pdf_contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a PDF file or of those below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")


def documents(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").select(F.col("path").alias("doc_id"), F.col("total_pages").cast("long").alias("total_pages"))


def outline(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("doc_id"), F.inline("outline")).withColumn("page", F.col("page").cast("long"))


def spans(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("doc_id"), F.inline("spans")).withColumn("page", F.col("page").cast("long"))
