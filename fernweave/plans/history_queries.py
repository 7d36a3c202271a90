"""Logs, diffs and histories over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import history
from .query import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a history: the type is the file, the user the author."""
    tag = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("HEAD -> main, tag: V"), F.col("user_id") % 5)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("tag: v"), F.col("user_id") % 5))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("path_ci"), F.col("event_id").alias("ord"), F.concat(F.lit("u"), "user_id").alias("author"), F.col("ts").alias("date"), F.concat(F.lit("h"), "event_id").alias("hash"), tag.alias("refs")
    )


@query("""SELECT event_type AS path_ci, 'u' || user_id AS author, min(ts) AS first_commit, max(ts) AS last_commit, count(*)::INTEGER AS commit_count FROM events GROUP BY ALL""")
def author_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.author_stats(_events(spark, sf_dir))


@query("""WITH tagged AS (
  SELECT event_type, event_id, CASE event_id % 3 WHEN 0 THEN 'V' || user_id % 5 WHEN 1 THEN 'v' || user_id % 5 END AS tag FROM events),
first AS (SELECT event_type, arg_min(tag, event_id) AS tag, min(event_id) AS at_id FROM tagged WHERE tag IS NOT NULL GROUP BY event_type, lower(tag)),
tags AS (SELECT event_type, string_agg(tag, ',' ORDER BY at_id) AS tags FROM first GROUP BY event_type)
SELECT e.event_type AS path_ci, min(ts) AS created, max(ts) AS last_modified, count(DISTINCT user_id) AS authors, string_agg('h' || event_id, ',' ORDER BY event_id) AS commits, any_value(t.tags) AS tags
FROM events e JOIN tags t USING (event_type) GROUP BY e.event_type""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.file_metadata(_events(spark, sf_dir))
    return found.select("path_ci", "created", "last_modified", F.size("authors").cast("bigint").alias("authors"), F.array_join("commits", ",").alias("commits"), F.array_join("tags", ",").alias("tags"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header
FROM conversations""")
def log_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "role", F.col("text").alias("line"))
    return history.carry_header(lines, F.col("role") == "user", by="conv_id").select("conv_id", F.col("ord").alias("turn"), "header")


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a commit log per customer: a header each, then a line per item."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sep = "|#|"
    head = orders.select(
        F.col("o_custkey").cast("string").alias("log"), (F.col("o_orderkey") * 100000).alias("ord"),
        F.concat(F.lit("COMMIT|h"), "o_orderkey", F.lit(f"{sep}n{sep}n@x{sep}"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(f"T00:00:00+00:00{sep}"), "o_orderpriority").alias("line"),
    )
    each = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_returnflag") == "R", "D").otherwise("M")
    files = each.select(
        F.col("o_custkey").cast("string").alias("log"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey") % 10000).alias("ord"), F.concat(status, F.lit("\tp"), "l_partkey").alias("line")
    ).distinct()
    return head.unionByName(files)


@query("""WITH each AS (SELECT DISTINCT o_orderkey, o_orderdate, o_orderpriority, l_linenumber, l_partkey, l_returnflag = 'R' AS gone FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT 'h' || o_orderkey AS hash, any_value(o_orderdate) AS date, any_value(o_orderpriority) AS message, count(l_partkey) AS files, count(*) FILTER (WHERE gone) AS gone,
       coalesce(min('p' || l_partkey), '') AS first_path FROM each GROUP BY o_orderkey""")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.commits(_log_lines(spark, sf_dir))
    gone = F.size(F.filter("changed_files", lambda f: f["is_deleted"])).cast("bigint")
    first = F.coalesce(F.array_min(F.transform("changed_files", lambda f: f["path"])), F.lit(""))
    return found.select("hash", "date", "message", F.size("changed_files").cast("bigint").alias("files"), gone.alias("gone"), first.alias("first_path"))


@query("""SELECT event_id, 'u/' || user_id AS path, 'deleted' AS state FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'u/' || user_id, 'modified' FROM events WHERE event_type <> 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def diff_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors delete a path, purchases modify one; what else has a modified path is selected by it."""
    from ..sources.files import changed_only

    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("u/"), "user_id").alias("relative_path"))
    status = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "purchase", "M")
    found = history.diff(events.withColumn("line", F.concat(status, F.lit("\t"), "relative_path")).where("line is not null"))
    deleted = events.where("event_type = 'error'").select("event_id", F.col("relative_path").alias("path"), F.lit("deleted").alias("state"))
    kept = changed_only(events.where("event_type <> 'error'"), found.where("not is_deleted").select("path"))
    return deleted.unionByName(kept.select("event_id", F.col("relative_path").alias("path"), F.lit("modified").alias("state")))
