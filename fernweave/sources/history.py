"""Version-control text as tables: logs with carried headers, diffs, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def carry_header(lines: DataFrame, is_header: Column, by: str = "log") -> DataFrame:
    """Adds `header`: the latest line so far for which is_header holds.  Lines have the log they belong to, ord and line."""
    order = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(order))


def bulk_history(lines: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, path_ci, ord, author, date, hash, refs) of `COMMIT|name <email>|date|hash|refs` headers, each followed by paths."""
    from .files import included

    held = carry_header(lines, F.col("line").startswith("COMMIT|") & (F.size(F.split("line", r"\|")) >= 5))
    part = F.split("header", r"\|")
    rows = held.where(~F.col("line").startswith("COMMIT|") & F.col("line").rlike(r"\S") & F.col("header").isNotNull())
    rows = rows.select(F.trim("line").alias("path"), "ord", part[1].alias("author"), F.expr("try_to_timestamp(split(header, '[|]')[2])").alias("date"), part[3].alias("hash"), S.blank_to_null(part[4]).alias("refs"))
    rows = rows.withColumn("path_ci", F.lower("path"))
    return rows if extensions is None else rows.where(included(F.col("path"), extensions))


def single_file_history(lines: DataFrame) -> DataFrame:
    """The same columns from `name <email>|date|hash|refs` lines of one file; lines with a bad date or fewer than two parts are skipped."""
    part = F.split(F.trim("line"), r"\|")
    rows = lines.where(F.size(part) >= 2).select(
        F.col("log").alias("path"), "ord", part[0].alias("author"), F.expr("try_to_timestamp(split(trim(line), '[|]')[1])").alias("date"), F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("hash"), S.blank_to_null(F.get(part, F.lit(3))).alias("refs")
    )
    return rows.where("date is not null").withColumn("path_ci", F.lower("path"))


def author_stats(history: DataFrame) -> DataFrame:
    """(path_ci, author, first_commit, last_commit, commit_count)."""
    return history.groupBy("path_ci", "author").agg(F.min("date").alias("first_commit"), F.max("date").alias("last_commit"), F.count("*").cast("int").alias("commit_count"))


def file_metadata(history: DataFrame) -> DataFrame:
    """Per path, whatever its case: created, last_modified, authors, commits in log order, tags in their first spelling."""
    base = history.groupBy("path_ci").agg(
        F.min("date").alias("created"), F.max("date").alias("last_modified"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash"))), lambda x: x["hash"]).alias("commits")
    )
    authors = author_stats(history).groupBy("path_ci").agg(F.array_sort(F.collect_list(F.struct(F.col("author").alias("name"), "first_commit", "last_commit", "commit_count"))).alias("authors"))
    each = history.where("refs is not null").select("path_ci", "ord", F.posexplode(S.tags_of_refs(F.col("refs"))).alias("at", "tag"))
    first = each.groupBy("path_ci", F.lower("tag").alias("tag_ci")).agg(F.min(F.struct("ord", "at", "tag")).alias("first"))
    tags = first.groupBy("path_ci").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["tag"]).alias("tags"))
    none = F.expr("cast(array() as array<string>)")
    return base.join(authors, "path_ci").join(tags, "path_ci", "left").withColumn("tags", F.coalesce("tags", none))


def with_history(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files with their history; a file without any has null times and empty lists."""
    joined = files.withColumn("path_ci", F.lower("relative_path")).join(metadata, "path_ci", "left").drop("path_ci")
    kinds = dict(metadata.dtypes)
    return joined.withColumns({c: F.coalesce(F.col(c), F.expr(f"cast(array() as {kinds[c]})")) for c in ("authors", "commits", "tags")})


def commits(lines: DataFrame) -> DataFrame:
    """Commits of `COMMIT|hash|#|name|#|email|#|date|#|subject` headers, each followed by `status<TAB>path` lines.

    A malformed header leaves the commit before it current, which is emitted again with the
    files that follow; of a rename the old path counts.
    """
    line = F.trim("line")
    rows = lines.where(F.col("line").rlike(r"\S")).select("log", "ord", line.alias("line"))
    part = F.split(F.expr("substring(line, 8)"), r"\|#\|", 5)
    head = F.col("line").startswith("COMMIT|")
    good = head & (F.size(part) >= 5) & F.expr("try_to_timestamp(split(substring(line, 8), '[|]#[|]', 5)[3]) is not null")
    order = Window.partitionBy("log").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = carry_header(rows, good).withColumn("block", F.count(F.when(head, 1)).over(order)).where("header is not null")
    fields = F.split(F.expr("substring(header, 8)"), r"\|#\|", 5)
    changed = F.filter(F.split("line", "\t"), lambda x: x != "")
    file = F.when(~head & (F.size(changed) >= 2), F.struct(F.col("ord"), F.get(changed, F.lit(1)).alias("path"), F.get(changed, F.lit(0)).startswith("D").alias("is_deleted")))
    found = rows.groupBy("log", "block", "header").agg(F.array_sort(F.collect_list(file)).alias("files"), F.min("ord").alias("ord"))
    return found.select(
        "ord", fields[0].alias("hash"), fields[1].alias("author_name"), fields[2].alias("author_email"), F.expr("try_to_timestamp(split(substring(header, 8), '[|]#[|]', 5)[3])").alias("date"), fields[4].alias("message"),
        F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["is_deleted"].alias("is_deleted"))).alias("changed_files"),
    )


def diff(lines: DataFrame) -> DataFrame:
    """(path, is_deleted) of `status<TAB>path` lines."""
    part = F.split("line", "\t")
    return lines.where(F.size(part) >= 2).select(part[1].alias("path"), part[0].startswith("D").alias("is_deleted"))


def page(rows: DataFrame, skip: int, size: int, by: str = "ord") -> DataFrame:
    return rows.orderBy(by).offset(skip).limit(size)


def read_log(spark, path: str) -> DataFrame:
    """(log, ord, line) of text files, a log per file."""
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("log"), F.col("value"))
    return text.select("log", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("ord", "line"))
