"""Command line: preview and split of EPUB and PDF files, and outlines of PDF files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import options
from leafwork.functions import strings as S
from leafwork.operators import book, layout, split
from leafwork.sources import epub_files, epub_scan, pdf_files, writers

VERSION = "0.1.0"
KINDS = {"epub": options.EPUB_STRATEGIES, "pdf": options.PDF_STRATEGIES}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("leafwork")
    top.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("preview", "split"):
        p = commands.add_parser(name)
        p.add_argument("path", help="an EPUB or PDF file, or a folder of them")
        p.add_argument("--kind", choices=tuple(KINDS), help="what to take from a folder (epub)")
        p.add_argument("--strategy", default="hybrid", type=str.lower)
        p.add_argument("--sensitivity", default="medium", type=lambda x: options.choice(x, tuple(options.FONT_RATIO)))
        p.add_argument("--toc-level", default=1, type=int, help="level of an EPUB's contents; 0 is all")
        p.add_argument("--bookmark-level", default=1, type=int, help="level of a PDF's bookmarks")
        if name == "split":
            p.add_argument("-o", "--output-dir")
            p.add_argument("--pattern", help=f"{split.EPUB_PATTERN} or {split.PDF_PATTERN}")
            p.add_argument("--output-format", default="epub", choices=("epub", "pdf"), help="of an EPUB's chapters")
            p.add_argument("--no-metadata", action="store_true")
            p.add_argument("--yes", action="store_true", help="split even where chapters have low confidence, or a PDF has none")
    p = commands.add_parser("outline", help="bookmarks of PDF files: pages, the first 50, entries by level")
    p.add_argument("path")
    return top


def parse(args: list[str] | None = None) -> argparse.Namespace:
    top = parser()
    a = top.parse_args(args)
    if a.command == "outline":
        return a
    suffix = a.path.rpartition("/")[2].rpartition(".")[2].lower()
    a.kind = a.kind or (suffix if suffix in KINDS else "epub")
    if a.strategy not in KINDS[a.kind]:
        top.error(f"{a.strategy!r} is no strategy for {a.kind} files: {', '.join(KINDS[a.kind])}")
    return a


def report(made: DataFrame) -> int:
    """Names of up to ten files, else how many; chapters that failed. 1 if any did."""
    bad = made.where("error IS NOT NULL")
    n, failed = made.where("error IS NULL").count(), bad.count()
    print(f"{n} files")
    if n <= 10:
        made.where("error IS NULL").orderBy("doc_id", "chapter_index").select("path").show(truncate=False)
    if failed:
        print(f"{failed} chapters failed")
        bad.select("doc_id", "chapter_index", "error").show(100, truncate=False)
    return int(failed > 0)


def confirmed(a: argparse.Namespace, why: str) -> bool:
    """--yes, or an answer where someone is there to give it."""
    if a.yes:
        return True
    if not sys.stdin.isatty():
        print(f"{why} --yes splits nonetheless.")
        return False
    return input(f"{why} Split nonetheless? [y/N] ").strip().lower() in ("y", "yes")


def place_of(spark: SparkSession, a: argparse.Namespace) -> str:
    return a.output_dir or spark.range(1).select(S.default_output(F.lit(a.path.rstrip("/")))).first()[0]


def epub(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "preview" and a.strategy == "native":  # needs no chapter's content
        books = epub_scan.scan_epubs(spark, a.path, ["items", "spine", "toc", "metadata"]).persist()
    else:
        books = epub_files.read_epubs(spark, a.path).persist()
    books.where("error IS NOT NULL").select("path", "error").show(100, truncate=False)
    items, spine, toc, metadata = (epub_files.table(books, n) for n in ("items", "spine", "toc", "metadata"))
    chapters = book.detect_epub(items, spine, toc, a.strategy, a.sensitivity, a.toc_level)
    book.summarize_epub(items, toc, chapters, a.strategy).show(truncate=False)
    if chapters.isEmpty():
        print("Nothing to split.")
        return 1
    if a.command == "preview":
        book.preview_epub(chapters).show(1000, truncate=False)
        return 0
    if not book.low_confidence(chapters).where("low_confidence > 0").isEmpty() and not confirmed(a, "Some chapters have low confidence."):
        return 1
    plan = split.plan_epub(chapters, a.pattern or split.EPUB_PATTERN, a.output_format, not a.no_metadata)
    if a.output_format == "pdf":
        return report(writers.write_text_pdf(split.chapter_sections(split.chapter_contents(plan, items, False)), place_of(spark, a)))
    contents = split.chapter_sections(split.chapter_contents(plan, items))
    return report(writers.write_epub(split.chapter_books(contents, items, metadata), place_of(spark, a)))


def pdf(spark: SparkSession, a: argparse.Namespace) -> int:
    files = pdf_files.pdf_contents(spark, a.path)
    parsed = pdf_files.parse_pdfs(files).persist()
    parsed.where("error IS NOT NULL").select("path", "error").show(100, truncate=False)
    documents, outline, spans = (f(parsed) for f in (pdf_files.documents, pdf_files.outline, pdf_files.spans))
    if a.command == "outline":
        documents.show(1000, truncate=False)
        layout.first_entries(outline).orderBy("doc_id", "seq").show(1000, truncate=False)
        layout.level_histogram(outline).show()
        return 0
    chapters = layout.detect_pdf(documents, outline, spans, a.strategy, a.sensitivity, a.bookmark_level)
    summary = layout.summarize_pdf(documents, outline, chapters, a.strategy).persist()
    summary.show(truncate=False)
    layout.preview_pdf(chapters).show(1000, truncate=False)
    if a.command == "preview":
        if not summary.where("try_heuristic").isEmpty():
            print("Some files have no bookmarks; --strategy heuristic may find chapters.")
        return 0
    if not summary.where("confirm").isEmpty() and not confirmed(a, "Some files would stay whole."):
        return 1
    plan = split.plan_pdf(chapters, a.pattern or split.PDF_PATTERN, not a.no_metadata)
    return report(writers.write_pdf(plan, files.withColumnRenamed("path", "doc_id"), place_of(spark, a)))


def main(args: list[str] | None = None) -> int:
    a = parse(args)
    spark = SparkSession.builder.appName("leafwork").getOrCreate()
    return epub(spark, a) if a.command != "outline" and a.kind == "epub" else pdf(spark, a)


if __name__ == "__main__":
    sys.exit(main())
