"""Command line: index or purge a source tree, or say what is supported."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.accessibility import LEVELS
from .operators.store import GraphStore
from .plans import index
from .sources import files, git, history


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fernweave", description="Source trees as a property graph in Parquet tables.")
    p.add_argument("--input", help="solution, project or directory; found in the current directory if absent")
    p.add_argument("--store", help="folder of the graph")
    p.add_argument("--no-key", action="store_true", help="index without a project")
    p.add_argument("--include", help="comma-separated extensions", default=",".join(files.DEFAULT_INCLUDES))
    p.add_argument("--min-accessibility", choices=list(LEVELS), default="NotApplicable")
    p.add_argument("--history-log", help="text of the bulk log")
    p.add_argument("--commit-log", help="text of the commit log")
    p.add_argument("--diff", help="text of the name-status diff: incremental run")
    p.add_argument("--diff-base", help="reference or range: incremental run, with diff and commits from git")
    p.add_argument("--batch-size", type=int, help="most rows of a written file")
    p.add_argument("--log-level", choices=["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "OFF"], type=str.upper)
    p.add_argument("--debug", action="store_true", help="as --log-level DEBUG")
    p.add_argument("--verbose", action="store_true", help="as --log-level INFO")
    p.add_argument("--quiet", action="store_true", help="as --log-level ERROR, without totals")
    p.add_argument("--facts", help="folder of analyzer JSON")
    p.add_argument("--skip-dependencies", action="store_true")
    p.add_argument("--purge-data", action="store_true")
    p.add_argument("--yes", action="store_true", help="purge without asking")
    p.add_argument("--supported-files", action="store_true")
    p.add_argument("--info", action="store_true")
    p.add_argument("--version", action="version", version="fernweave 0.1")
    return p


def checked(argv: list[str] | None = None) -> argparse.Namespace:
    """Parsed arguments; exits on combinations that make no sense."""
    p = parser()
    args = p.parse_args(argv)
    if args.purge_data and args.min_accessibility != "NotApplicable":
        p.error("--purge-data takes no --min-accessibility")
    if not (args.supported_files or args.info) and not args.store:
        p.error("--store is required")
    if sum([bool(args.log_level), args.debug, args.verbose, args.quiet]) > 1:
        p.error("--log-level, --debug, --verbose and --quiet exclude each other")
    if args.diff and args.diff_base:
        p.error("--diff and --diff-base exclude each other")
    return args


def key_of(path: str) -> str:
    from pathlib import Path

    return Path(path).absolute().stem.lower()


def main(argv: list[str] | None = None) -> int:
    args = checked(argv)
    if args.supported_files:
        print("\n".join(f"{extension}\t{handler}" for handler, extension, _, _ in files.HANDLERS))
        return 0
    spark = SparkSession.builder.appName("fernweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.info:
        print(f"spark {spark.version}")
        return 0
    if int(spark.version.split(".")[0]) < 4:
        sys.exit("Spark 4 or later is needed")
    spark.sparkContext.setLogLevel(args.log_level or ("DEBUG" if args.debug else "INFO" if args.verbose else "ERROR" if args.quiet else "WARN"))
    if args.batch_size:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", args.batch_size)
    source = files.resolve_input(args.input)
    key = None if args.no_key else key_of(source)
    store, extensions = GraphStore(spark, args.store), tuple(args.include.split(","))
    if args.purge_data:
        if not args.yes and input(f"Purge {key or 'everything'}? [y/N] ").strip().lower() != "y":
            return 1
        print(index.purge(store, key, extensions, not args.skip_dependencies))
        return 0
    from pathlib import Path

    from .sources.analyzer import read_analysis

    root = source if Path(source).is_dir() else str(Path(source).parent)
    graph = index.index(spark, root, store, key, inputs_of(spark, root, args, read_analysis), extensions, args.min_accessibility)
    if not args.quiet:
        index.totals(graph).show(50, truncate=False)
    return 0


def inputs_of(spark: SparkSession, root: str, args: argparse.Namespace, read_analysis) -> index.Inputs:
    """Logs and diff as given; what is not given comes from git, where the tree is in a repository."""
    read = lambda path: history.read_log(spark, path) if path else None
    log, commits, diff = read(args.history_log), read(args.commit_log), read(args.diff)
    if args.diff_base:
        diff = git.changed_files(spark, root, args.diff_base)
        commits = git.commit_log(spark, root, args.diff_base) if commits is None else commits
    if log is None:
        try:
            git.repository_root(root)
            log = git.bulk_log(spark, root)
        except (RuntimeError, OSError):
            log = None
    return index.Inputs(history=log, commits=commits, diff=diff, facts=read_analysis(spark, args.facts) if args.facts else None)


if __name__ == "__main__":
    sys.exit(main())
