"""Command line of a harvest."""

import argparse

from pyspark.sql import SparkSession

from pagemill.plans.harvest import run


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagemill", description="Harvest landed listing pages into a catalog.")
    parser.add_argument("pages", help="directory of landed pages (parquet: id, page, batch, html)")
    parser.add_argument("root", help="shared directory for chunks, progress, metadata and catalog")
    parser.add_argument("-f", "--force", action="store_true", help="start from zero and replace the catalog")
    parser.add_argument("-c", "--check", action="store_true", help="only compare the catalog with the metadata")
    parser.add_argument("--crawl-only", "--crawl", action="store_true", help="only measure the categories")
    parser.add_argument("--no-crawl", "--skip-crawl", action="store_true", help="use the metadata there is")
    options = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    checked = run(
        spark, options.pages, options.root, options.force, options.check, options.crawl_only, options.no_crawl
    )
    if checked is not None:
        checked.show()


if __name__ == "__main__":
    main()
