"""Version-control text from a working tree: the git command runs on the driver, its output goes to the shared folder.

Output is passed on as it comes, so the driver holds a piece of it at a time; parsing is
left to history.  Paths are relative to the folder asked about.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import read_log
from .shared import shared_folder

_PIECE = 1 << 20
#: author, date, hash and refs of a commit; and its hash, author, date and subject
_TOUCH = "|".join(("%an <%ae>", "%aI", "%H", "%D"))
_COMMIT = "|#|".join(("%H", "%an", "%ae", "%aI", "%s"))


def repository_root(folder: str) -> str:
    """The top of the working tree that holds the folder; raises where there is none."""
    found = subprocess.run(["git", "rev-parse", "--show-toplevel"], cwd=folder, capture_output=True, text=True)
    if found.returncode:
        raise RuntimeError(f"{folder} is in no repository")
    return found.stdout.strip()


def commit_range(base: str) -> str:
    """A range as given, or from where a reference and HEAD parted to HEAD."""
    return base if ".." in base else f"{base}...HEAD"


def _output(spark: SparkSession, folder: str, *arguments: str) -> tuple[DataFrame, str]:
    """(lines (log, ord, line) of the command's output, its complaint if it failed)."""
    place = f"{shared_folder(spark, 'git')}/output.txt"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    target = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    run = subprocess.Popen(["git", "-c", "core.quotePath=false", *arguments], cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.STDOUT)
    last = b""
    try:
        while piece := run.stdout.read(_PIECE):
            target.write(bytearray(piece))
            last = piece
    finally:
        target.close()
        failed = run.wait()
    return read_log(spark, place), last.decode(errors="replace").strip() if failed else ""


def _nothing(lines: DataFrame) -> DataFrame:
    return lines.where(F.lit(False))


def bulk_log(spark: SparkSession, folder: str) -> DataFrame:
    """Lines for history.bulk_history(): every commit with the paths that it touched; none where git fails."""
    lines, failed = _output(spark, folder, "log", "HEAD", "--relative", "--name-only", f"--format=COMMIT|{_TOUCH}")
    return _nothing(lines) if failed else lines


def file_log(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Lines for history.single_file_history(), the log named by the path; none where git fails."""
    lines, failed = _output(spark, folder, "log", "HEAD", f"--format={_TOUCH}", "--", path)
    return (_nothing(lines) if failed else lines).withColumn("log", F.lit(path))


def commit_log(spark: SparkSession, folder: str, base: str, skip: int = 0, size: int | None = None) -> DataFrame:
    """Lines for history.commits(): the commits of a range, or a page of them; none where git fails."""
    page = [f"--skip={skip}"] + ([f"--max-count={size}"] if size is not None else [])
    lines, failed = _output(spark, folder, "log", commit_range(base), *page, "--relative", "--name-status", f"--format=COMMIT|{_COMMIT}")
    return _nothing(lines) if failed else lines


def changed_files(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """Lines for history.diff(); raises where git fails, as an empty diff would select nothing."""
    lines, failed = _output(spark, folder, "diff", "--relative", "--name-status", commit_range(base))
    if failed:
        raise RuntimeError(f"git diff failed: {failed}")
    return lines


def commit_count(folder: str, base: str) -> int:
    """How many commits the range has; 0 where git fails."""
    found = subprocess.run(["git", "rev-list", "--count", commit_range(base)], cwd=folder, capture_output=True, text=True)
    return 0 if found.returncode else int(found.stdout)
