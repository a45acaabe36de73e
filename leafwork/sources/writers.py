"""Files of chapters: made row by row, without side effects, and written by the sink of sinks.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import html
from leafwork.sources import pdf_files
from leafwork.sources.epub_files import book_bytes
from leafwork.sources.pdf_files import text_pdf
from leafwork.sources.sinks import FILES, folder_of, write_files

__all__ = ["chapter_epubs", "chapter_pdfs", "chapter_text_pdfs", "folder_of", "write_epub", "write_pdf", "write_text_pdf"]
COLUMNS = ["doc_id", "chapter_index", "output_name", "data", "error"]


def _made(build: Callable[[pd.Series], bytes]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A file for each row, or why there is none; a row at a time leaves the task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                data, error = None, None
                try:
                    data = build(row)
                except Exception as e:  # noqa: BLE001  one bad chapter doesn't end the job
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(str(row["doc_id"]), int(row["chapter_index"]), row["output_name"], data, error)], columns=COLUMNS)

    return run


def chapter_epubs(contents: DataFrame) -> DataFrame:
    """A book, as the sink takes it, for each row (doc_id, chapter_index, output_name, title, file_path, content and, from split.chapter_books,
    resources and metadata); a chapter whose content is missing holds its title alone.
    """
    def build(row: pd.Series) -> bytes:
        title, path = row["title"] or "", row["file_path"] or "chapter.xhtml"
        page = html.decode(row["content"]) if row["content"] is not None else f"<html><body><h1>{escape(title)}</h1></body></html>"
        resources = [(r["href"], r["item_type"], r["content"]) for r in (row["resources"] if row["resources"] is not None else ())]
        metadata = [{**m, "attrs": dict(m["attrs"] or {})} for m in (row["metadata"] if row["metadata"] is not None else ())]
        return book_bytes(title, [(path, page)], resources, metadata)

    extra = [F.col(c) if c in contents.columns else F.lit(None).cast(t).alias(c) for c, t in (("resources", "array<struct<href:string,item_type:string,content:binary>>"), ("metadata", "array<struct<namespace:string,key:string,value:string,attrs:map<string,string>>>"))]
    return contents.select(F.col("doc_id").cast("string").alias("doc_id"), "chapter_index", "output_name", "title", "file_path", "content", *extra).mapInPandas(_made(build), FILES)


def write_epub(contents: DataFrame, place: str) -> DataFrame:
    """chapter_epubs written below `place`; returns what was written (see sinks.write_files)."""
    return write_files(chapter_epubs(contents), place)


def chapter_pdfs(plan: DataFrame, files: DataFrame) -> DataFrame:
    """A PDF of each chapter's pages, as the sink takes it: plan from split.plan_pdf, files (doc_id, content).

    A document goes to one task with all its chapters and is opened once; a chapter without pages is skipped, its number
    stays unused.
    """
    chapters = plan.where("NOT is_inverted").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter_index", "output_name", "title", "start_page", "end_page", "preserve_metadata"))).alias("chapters"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc_id, content, todo in zip(part["doc_id"], part["content"], part["chapters"], strict=True):
                done = 0
                try:
                    for chapter, data in pdf_files.cut(pdf_files.library(), content, todo):
                        yield pd.DataFrame([(str(doc_id), int(chapter["chapter_index"]), chapter["output_name"], data, None)], columns=COLUMNS)
                        done += 1
                except Exception as e:  # noqa: BLE001  one bad file doesn't end the job
                    yield pd.DataFrame([(str(doc_id), int(c["chapter_index"]), c["output_name"], None, f"{type(e).__name__}: {e}") for c in todo[done:]], columns=COLUMNS)

    return files.select("doc_id", "content").join(chapters, "doc_id").mapInPandas(run, FILES)


def write_pdf(plan: DataFrame, files: DataFrame, place: str) -> DataFrame:
    """chapter_pdfs written below `place`; returns what was written (see sinks.write_files)."""
    return write_files(chapter_pdfs(plan, files), place)


def chapter_text_pdfs(contents: DataFrame) -> DataFrame:
    """A PDF of each chapter's wrapped text, as the sink takes it, with title and source as metadata where these are to be kept; chapters without content are skipped, their numbers stay unused."""
    def build(row: pd.Series) -> bytes:
        text = html.parse(row["content"])["text"]
        return text_pdf(text, row["title"] or "", str(row["doc_id"])) if row["preserve_metadata"] else text_pdf(text)

    keep = F.col("preserve_metadata") if "preserve_metadata" in contents.columns else F.lit(True).alias("preserve_metadata")
    rows = contents.where("content IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "chapter_index", "output_name", "title", "content", keep)
    return rows.mapInPandas(_made(build), FILES)


def write_text_pdf(contents: DataFrame, place: str) -> DataFrame:
    """chapter_text_pdfs written below `place`; returns what was written (see sinks.write_files)."""
    return write_files(chapter_text_pdfs(contents), place)
