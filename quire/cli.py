"""Command line: convert books to EPUB packages, audit packages. Run with spark-submit or python -m quire.cli."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quire.plans.convert import Options, convert
from quire.sinks.audit import as_json, audit, epub_audit, report
from quire.sinks.epub import epubs
from quire.sources import adapters, external


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="convert books to EPUB packages")
    c.add_argument("input", help="folder of PDF files, or of the documents or pages table")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--source", choices=("pdf", "documents", "pages"), default="pdf")
    for name in ("title", "author"):
        c.add_argument(f"--{name}", default="")
    c.add_argument("--lang", default="en")
    c.add_argument("--profile", choices=("academic", "general"), default="academic")
    c.add_argument("--ocr", choices=("auto", "force", "off"), default="auto")
    c.add_argument("--ocr-lang", default="eng")
    c.add_argument("--dpi", type=int, default=300)
    for name in ("repair-ocr", "preserve-page-breaks", "keep-print-nav", "quiet"):
        c.add_argument(f"--{name}", action="store_true")
    a = sub.add_parser("audit", help="audit EPUB packages")
    a.add_argument("input")
    a.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """0: done and fine; 1: the audit found problems; 2: wrong use."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if args.command == "audit":
        found = epub_audit(external.epub_parts(spark, args.input)).cache()
        for row in (as_json(found) if args.json else report(found)).toLocalIterator():
            print(row[1])
        return 0 if found.where("not ok").isEmpty() else 1
    if args.source == "pdf" and not external.available("pdf"):
        print("quire: this installation cannot read PDF files", file=sys.stderr)
        return 2
    lines = external.pdf_lines(external.pdf_files(spark, args.input)) if args.source == "pdf" else getattr(adapters, {"documents": "document_lines", "pages": "page_lines"}[args.source])(spark.read.parquet(args.input))
    options = Options(args.title, args.author, args.lang, args.profile, args.ocr, args.ocr_lang, args.dpi, args.repair_ocr, args.preserve_page_breaks, args.keep_print_nav)
    made = convert(lines, options)
    chapters = made.html(args.lang)
    epubs(made.books, chapters, made.subheads).write.mode("overwrite").parquet(args.output)
    if not args.quiet:
        for row in report(audit(chapters.selectExpr("book_id", "concat('chap_', ch) as name", "html"))).toLocalIterator():
            print(row[0], row[1], sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
