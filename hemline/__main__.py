"""Command line: ``spark-submit``-able jobs, one per subcommand (``python -m hemline --help``)."""

from __future__ import annotations

import argparse
import sys

from hemline import constants as C
from hemline.functions.pages import SITES
from hemline.operators.pages import extract_product_pages, gather_links
from hemline.plans.brand_report import brand_report
from hemline.plans.cleaners import CLEANERS, clean_listing
from hemline.plans.forum import extract_forum, forum_sentiment
from hemline.plans.research import research_analysis
from hemline.plans.texts import batch_sentiment
from hemline.schemas import PAGE
from hemline.session import build_session
from hemline.sources.readers import read_lexicon, read_parquet
from hemline.sources.writers import run_tagged_path, write_csv, write_parquet_once
from hemline.streaming.page_feed import append_product_records, page_stream
from hemline.valence import DEFAULT_LEXICON


PRINTED = 100


def _run_options(command: argparse.ArgumentParser) -> None:
    command.add_argument("--run_tag", help="name of the run folder; default is the UTC time")
    command.add_argument("--no_suffix", action="store_true", help="no run folder")


def _file_options(command: argparse.ArgumentParser) -> None:
    command.add_argument("--coalesce", type=int, default=0, help="number of output files; 0 leaves one per task")


def _lexicon_option(command: argparse.ArgumentParser) -> None:
    command.add_argument("--lexicon", help="tab-separated list of term and valence; default is a short built-in list")


def _quote_option(command: argparse.ArgumentParser) -> None:
    command.add_argument("--multiline", action="store_true", help="line breaks inside quotes: one task per file")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hemline")
    commands = top.add_subparsers(dest="command", required=True)

    clean = commands.add_parser("clean", help="one shop's listing to the cleaned product schema")
    clean.add_argument("shop", choices=sorted(CLEANERS))
    clean.add_argument("--input", required=True)
    clean.add_argument("--output", required=True)

    extract = commands.add_parser("extract-forum", help="posts of some forums, years and months as gzip JSON")
    extract.add_argument("--submissions", required=False, help="folder of submissions, year=/month= below it")
    extract.add_argument("--comments", required=False, help="folder of comments, year=/month= below it")
    extract.add_argument("--include_submissions", action="store_true")
    extract.add_argument("--include_comments", action="store_true")
    extract.add_argument("--subs", nargs="*", default=list(C.FORUM_SUBREDDITS))
    extract.add_argument("--start_year", type=int, default=C.FORUM_YEARS[0])
    extract.add_argument("--end_year", type=int, default=C.FORUM_YEARS[1])
    extract.add_argument("--months", nargs="*", type=int, default=list(C.FORUM_MONTHS))
    extract.add_argument("--brands", nargs="*", default=[], help="only posts that name one of these")
    extract.add_argument("--output", required=True)
    _run_options(extract)
    _file_options(extract)

    forum = commands.add_parser("forum-sentiment", help="clean, score and summarize submissions")
    forum.add_argument("--input", required=True)
    forum.add_argument("--format", choices=("parquet", "json"), default="parquet")
    forum.add_argument("--output_base", required=True)
    forum.add_argument("--min_len", type=int, default=C.MIN_TOKENS)
    _run_options(forum)
    _file_options(forum)
    _lexicon_option(forum)

    texts = commands.add_parser("batch-sentiment", help="scores of the text columns of CSV files")
    texts.add_argument("--inputs", nargs="+", required=True)
    texts.add_argument("--text_cols", nargs="+", default=list(C.TEXT_COLUMNS))
    texts.add_argument("--output", required=True)
    _quote_option(texts)
    _lexicon_option(texts)

    research = commands.add_parser("research", help="the product study over listing CSVs")
    research.add_argument("--inputs", nargs="+", required=True)
    research.add_argument("--k", type=int, default=C.CLUSTERS)
    research.add_argument("--output_base", required=True)
    _quote_option(research)
    _run_options(research)
    _lexicon_option(research)

    brands = commands.add_parser("brand-report", help="mean price and sentiment per brand")
    brands.add_argument("--inputs", nargs="+", required=True)
    brands.add_argument("--output", help="folder; default prints some brands")
    brands.add_argument("--format", choices=("csv", "json"), default="csv", help="JSON gives one record per line")

    pages = commands.add_parser("extract-pages", help="product records from a folder of page files")
    pages.add_argument("--site", choices=sorted(SITES), required=True)
    pages.add_argument("--input", required=True)
    pages.add_argument("--output", required=True)
    pages.add_argument("--checkpoint", help="append only pages not seen before, remembered here")
    pages.add_argument("--links", action="store_true", help="distinct product addresses instead of records")
    return top


def _lexicon(spark, args):
    return read_lexicon(spark, args.lexicon) if args.lexicon else DEFAULT_LEXICON


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session(f"hemline {args.command}")
    if args.command == "clean":
        clean_listing(spark, args.shop, args.input, args.output)
    elif args.command == "extract-forum":
        both = not (args.include_submissions or args.include_comments)
        wanted = {
            "submissions": args.submissions if both or args.include_submissions else None,
            "comments": args.comments if both or args.include_comments else None,
        }
        extract_forum(
            spark, {kind: path for kind, path in wanted.items() if path},
            run_tagged_path(args.output, args.run_tag, args.no_suffix),
            (args.start_year, args.end_year), args.months, args.subs, args.coalesce or None, args.brands)
    elif args.command == "forum-sentiment":
        forum_sentiment(
            spark, args.input, run_tagged_path(args.output_base, args.run_tag, args.no_suffix),
            args.format, args.min_len, args.coalesce or None, _lexicon(spark, args))
    elif args.command == "batch-sentiment":
        write_csv(batch_sentiment(spark, args.inputs, args.text_cols, _lexicon(spark, args), args.multiline), args.output)
    elif args.command == "research":
        output = run_tagged_path(args.output_base, args.run_tag, args.no_suffix)
        if not research_analysis(spark, args.inputs, output, args.k, _lexicon(spark, args), args.multiline):
            print("No product data found. Check input paths.")
            return 1
    elif args.command == "brand-report":
        report = brand_report(spark, args.inputs)
        if args.output and args.format == "json":
            report.write.mode("error").json(args.output)
        elif args.output:
            write_csv(report, args.output)
        else:
            report.show(PRINTED, truncate=False)
            if report.count() > PRINTED:
                print(f"These are {PRINTED} of the brands; --output writes them all.")
    elif args.command == "extract-pages":
        rules = SITES[args.site]
        if args.links:
            write_parquet_once(
                gather_links(read_parquet(spark, args.input, PAGE), rules).select("url"), args.output)
        elif args.checkpoint:
            append_product_records(page_stream(spark, args.input), rules, args.output, args.checkpoint).awaitTermination()
        else:
            write_parquet_once(extract_product_pages(read_parquet(spark, args.input, PAGE), rules), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
