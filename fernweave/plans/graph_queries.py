"""Keyed writes, edges, sweeps and purges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Graph, distinct_dependencies, last_wins, merge, resolve_edges, row_chunks, unresolved_edges
from ..sources import analyzer
from .query import query, table


@query("""SELECT l_partkey, l_shipdate, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) = 1""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").alias("_d"), F.col("l_orderkey").alias("_o"), F.col("l_linenumber").alias("_n"), "l_suppkey", "l_quantity", "l_shipdate")
    return last_wins(rows, "l_partkey", ["_d", "_o", "_n"]).select("l_partkey", "l_shipdate", "l_suppkey", "l_quantity")


@query("SELECT p_partkey, CASE WHEN p_size <= 40 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 10 THEN p_brand END AS p_brand FROM part")
def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts: small ones are new, large ones stay, those between are updated."""
    part = table(spark, sf_dir, "part")
    existing = part.where("p_size > 10").select("p_partkey", "p_name", "p_brand")
    return merge(existing, part.where("p_size <= 40").select("p_partkey", F.upper("p_name").alias("p_name")), "p_partkey")


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order to supplier relationships, and symbols for some of both."""
    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("from_key"), F.concat(F.lit("s"), "l_suppkey").alias("to_key"), F.col("l_returnflag").alias("rel_type"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("key"))
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("key"))
    return links, orders.union(suppliers)


_LINKS = """WITH links AS (SELECT DISTINCT 'o' || l_orderkey AS src_key, 's' || l_suppkey AS dst_key, l_returnflag AS rel_type FROM lineitem),
keys AS (SELECT 'o' || o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT src_key, dst_key, rel_type FROM links WHERE """


@query(_LINKS + "src_key IN (SELECT key FROM keys) AND dst_key IN (SELECT key FROM keys)")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_edges(*_links(spark, sf_dir))


@query(_LINKS + "NOT (src_key IN (SELECT key FROM keys) AND dst_key IN (SELECT key FROM keys))")
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unresolved_edges(*_links(spark, sf_dir))


def _graph(spark: SparkSession, sf_dir: str, once: bool = True) -> Graph:
    """Nations outside region 0 as projects, customers as files (of no project if in debt), parts as symbols, suppliers as dependencies, orders as commits, priorities as authors.

    once: each declares edge is there once; not needed where it is only asked whether there is one.
    """
    t = lambda name: table(spark, sf_dir, name)
    key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    projects = t("nation").where("n_regionkey > 0")
    owned = t("customer").where("c_acctbal >= 0").select(key("n", "c_nationkey").alias("src_key"), key("c", "c_custkey").alias("dst_key"))
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(key("c", "o_custkey").alias("src_key"), key("p", "l_partkey").alias("dst_key"))
    if once:
        bought = bought.distinct()
    base = Graph(spark)
    shape = lambda rows, label: base.merged(label, rows)
    return base.put(
        project=shape(projects.select(key("n", "n_nationkey").alias("key"), F.col("n_name").alias("name")), "project"),
        file=shape(t("customer").select(key("c", "c_custkey").alias("key"), key("c", "c_custkey").alias("path")), "file"),
        symbol=shape(t("part").select(key("p", "p_partkey").alias("key"), F.col("p_name").alias("name"), F.concat(key("p", "p_partkey"), F.lit("."), F.lower("p_brand")).alias("file_path")), "symbol"),
        dependency=shape(t("supplier").select(key("s", "s_suppkey").alias("key"), F.col("s_name").alias("name")), "dependency"),
        commit=shape(t("orders").select(key("o", "o_orderkey").alias("hash")), "commit"),
        author=shape(t("orders").select(F.col("o_orderpriority").alias("name")).distinct(), "author"),
        has_file=owned.join(projects.select(key("n", "n_nationkey").alias("src_key")), "src_key", "left_semi"),
        declares=bought,
        depends_on=t("supplier").join(projects, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(key("n", "s_nationkey").alias("src_key"), key("s", "s_suppkey").alias("dst_key")),
        part_of_project=t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(projects, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(key("o", "o_orderkey").alias("src_key"), key("n", "c_nationkey").alias("dst_key")),
        committed=t("orders").select(F.col("o_orderpriority").alias("src_key"), key("o", "o_orderkey").alias("dst_key")),
    )


_BOUGHT = "bought AS (SELECT DISTINCT 'c' || o_custkey AS src_key, 'p' || l_partkey AS dst_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("SELECT DISTINCT 'c' || l_orderkey AS src_key, 'p' || p_partkey AS dst_key FROM lineitem JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = l_orderkey")
def declares_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols join the file that declares them; files that are not there give no edge."""
    graph = Graph(spark).put(file=_graph(spark, sf_dir)["file"])
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("key"), F.lit("x").alias("name"), F.concat(F.lit("c"), "l_orderkey").alias("file_key"), F.lit("").alias("relative_path"), F.lit(None).cast("string").alias("documentation"),
        F.lit(None).cast("string").alias("comments"), F.lit(None).cast("string").alias("namespace"), F.col("l_linenumber").alias("ordinal"),
    )
    return graph.upsert_symbols(rows)["declares"]


@query("SELECT 'n' || c_nationkey AS src_key, 'c' || c_custkey AS dst_key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey > 0 AND c_acctbal >= 0")
def optional_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files keep their row without a project, and get an edge only to one that exists."""
    none = F.expr("cast(array() as array<string>)")
    null = F.lit(None).cast("timestamp")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("file_key"), F.col("c_name").alias("file_name"), F.col("c_name").alias("relative_path"), F.lit("").alias("file_hash"), null.alias("created"), null.alias("last_modified"),
        F.expr("cast(array() as array<struct<name: string, first_commit: timestamp, last_commit: timestamp, commit_count: int>>)").alias("authors"), none.alias("commits"), none.alias("tags"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("n"), "c_nationkey")).alias("repo_key"), F.lit("").alias("namespace"), F.lit("x").alias("language"), F.lit("x").alias("technology"), F.lit(0).alias("ordinal"),
    )
    return Graph(spark).put(project=_graph(spark, sf_dir)["project"]).upsert_files(rows)["has_file"]


@query("SELECT 'pkg:' || p_name AS key, max(p_name) AS name, max(p_type) AS version FROM part GROUP BY p_name")
def dep_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_dependencies(table(spark, sf_dir, "part").select(F.concat(F.lit("pkg:"), "p_name").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("version"))).orderBy("key")


@query("""WITH made AS (SELECT p_brand || CASE p_partkey % 2 WHEN 0 THEN '(net9.0)' ELSE '(net8.0)' END AS project, p_brand AS base, p_type AS name, p_size FROM part),
one AS (SELECT base, min(project) AS project FROM made GROUP BY lower(base), base)
SELECT DISTINCT m.base AS project, 'pkg:' || m.name AS key, m.name, 'v' || m.p_size AS version FROM made m JOIN one o USING (project)""")
def assembly_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of one target framework per project."""
    suffix = F.when(F.col("p_partkey") % 2 == 0, "(net9.0)").otherwise("(net8.0)")
    references = table(spark, sf_dir, "part").select(F.concat("p_brand", suffix).alias("project"), F.concat("p_type", F.lit(", Culture=neutral")).alias("assembly"), F.concat(F.lit("v"), "p_size").alias("version"))
    return analyzer.assembly_dependencies(references).distinct()


@query(f"""WITH {_BOUGHT}, flushed AS (SELECT 'c' || c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'), kept AS (SELECT 'p' || p_partkey AS key FROM part WHERE p_size > 10),
stale AS (SELECT DISTINCT dst_key FROM bought WHERE src_key IN (SELECT key FROM flushed) AND dst_key NOT IN (SELECT key FROM kept))
SELECT src_key, dst_key FROM bought WHERE dst_key NOT IN (SELECT dst_key FROM stale)""")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    flushed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("file_key"))
    keep = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("key"))
    return _graph(spark, sf_dir).sweep(flushed, keep)["declares"].select("src_key", "dst_key")


@query(f"""WITH {_BOUGHT}, gone AS (SELECT 'c' || c_custkey AS key FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT 'p' || p_partkey AS key, 'p' || p_partkey IN (SELECT dst_key FROM bought WHERE src_key IN (SELECT key FROM gone)) AS deleted FROM part
UNION ALL SELECT 'c' || c_custkey, c_mktsegment = 'MACHINERY' FROM customer""")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("c"), "c_custkey").alias("path"))
    graph = _graph(spark, sf_dir).soft_delete(paths, at=F.expr("timestamp'2024-01-01'"))
    both = graph["symbol"].select("key", "deleted").unionByName(graph["file"].select("key", "deleted"))
    return both.select("key", F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query("""WITH each AS (SELECT 'p' || l_partkey AS key, l_returnflag = 'R' AS deleted, o_orderdate, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT key, arg_max(deleted, (o_orderdate, o_orderkey)) AS deleted FROM (SELECT key, o_orderdate, o_orderkey, max(deleted) AS deleted FROM each GROUP BY ALL) GROUP BY key""")
def commit_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as their newest commit left them."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    each = items.groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("is_deleted"))
    changed = each.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("p"), "l_partkey").alias("path"), "is_deleted")).alias("changed_files"))
    order = F.expr("-(unix_seconds(cast(o_orderdate as timestamp)) * 100000000 + o_orderkey)")
    commits = orders.join(changed, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderpriority").alias("author_name"), F.lit("x").alias("author_email"), F.col("o_orderdate").cast("timestamp").alias("date"), F.lit("").alias("message"), "changed_files", order.alias("ord")
    )
    return Graph(spark).upsert_commits(commits, None)["file"].select("key", "deleted")


_PURGE = f"""WITH {_BOUGHT},
projects AS (SELECT 'n' || n_nationkey AS key FROM nation WHERE n_regionkey > 0),
has_file AS (SELECT 'n' || c_nationkey AS src_key, 'c' || c_custkey AS dst_key FROM customer WHERE c_acctbal >= 0 AND 'n' || c_nationkey IN (SELECT key FROM projects)),
owners AS (SELECT DISTINCT h.src_key AS project, b.dst_key AS symbol FROM has_file h JOIN bought b ON b.src_key = h.dst_key),
part_of AS (SELECT 'o' || o_orderkey AS commit, 'n' || c_nationkey AS project FROM orders JOIN customer ON o_custkey = c_custkey WHERE 'n' || c_nationkey IN (SELECT key FROM projects)),
gone_commits AS (SELECT 'o' || o_orderkey AS commit FROM orders WHERE 'o' || o_orderkey IN (SELECT commit FROM part_of WHERE project = 'n3') OR 'o' || o_orderkey NOT IN (SELECT commit FROM part_of)),
left_commits AS (SELECT o_orderpriority AS author, 'o' || o_orderkey AS commit FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT commit FROM gone_commits))
SELECT 'symbol' AS label, count(*) AS purged FROM part WHERE 'p' || p_partkey IN (SELECT symbol FROM owners WHERE project = 'n3') OR 'p' || p_partkey NOT IN (SELECT symbol FROM owners)
UNION ALL SELECT 'file', count(*) FROM customer WHERE c_nationkey = 3 OR 'c' || c_custkey NOT IN (SELECT dst_key FROM has_file)
UNION ALL SELECT 'dependency', count(*) FROM supplier WHERE s_nationkey = 3
UNION ALL SELECT 'commit', count(*) FROM gone_commits
UNION ALL SELECT 'author', count(*) FROM (SELECT DISTINCT o_orderpriority AS author FROM orders) a
  WHERE author NOT IN (SELECT author FROM left_commits)
UNION ALL SELECT 'project', count(*) FROM projects WHERE key = 'n3'"""


@query(_PURGE)
def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What purging one project removes, by kind."""
    return _graph(spark, sf_dir, once=False).purge("n3")[1]


@query(f"""SELECT sum(purged)::BIGINT AS total FROM ({_PURGE})""")
def purge_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, once=False).purge("n3")[1].agg(F.sum("purged").alias("total"))


@query("SELECT DISTINCT 's' || l_suppkey AS from_key, 'p' || l_partkey AS to_key, 'INVOKES' AS rel_type FROM lineitem")
def invokes_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzer.invocations(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee")))


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS chunk FROM orders")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_chunks(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5, by="o_custkey")


@query("""WITH urls AS (SELECT 'pkg:' || s_suppkey AS dep_key, 'url:' || s_nationkey AS url_key FROM supplier) SELECT DISTINCT dep_key AS src_key, url_key AS dst_key FROM urls WHERE dep_key IN (SELECT 'pkg:' || s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def dependency_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL edges only from dependencies that exist."""
    suppliers = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("pkg:"), "s_suppkey")
    graph = Graph(spark).upsert_dependencies(suppliers.where("s_acctbal > 0").select(key.alias("key"), F.col("s_name").alias("name"), F.lit("1").alias("version")), None)
    urls = suppliers.select(key.alias("dep_key"), F.concat(F.lit("url:"), "s_nationkey").alias("url_key"), F.col("s_nationkey").cast("string").alias("name"))
    return graph.upsert_urls(urls)["has_url"]


@query("""WITH usings AS (SELECT 'f' || c_custkey AS file, 'm' || c_nationkey AS project, 'N' || (c_custkey % 9) AS name, c_acctbal > 9900 AS is_global FROM customer),
every AS (SELECT file, name FROM usings UNION SELECT u.file, g.name FROM usings u JOIN usings g ON g.project = u.project AND g.is_global AND g.file <> u.file)
SELECT DISTINCT file AS from_key, 'repo:' || name AS to_key, 'DEPENDS_ON' AS rel_type FROM every WHERE name NOT IN ('N1', 'N4')""")
def external_usings(spark: SparkSession, sf_dir: str) -> DataFrame:
    usings = table(spark, sf_dir, "customer").select(
        F.lit("repo").alias("repo_key"), F.concat(F.lit("m"), "c_nationkey").alias("project"), F.concat(F.lit("f"), "c_custkey").alias("file_key"), F.concat(F.lit("N"), F.col("c_custkey") % 9).alias("name"), (F.col("c_acctbal") > 9900).alias("is_global")
    )
    return analyzer.external_usings(usings, spark.createDataFrame([("N1",), ("N4",)], "name string"))


@query("""WITH alive AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'P')
SELECT DISTINCT 'c' || o_custkey AS src_key, 'o' || o_orderkey AS dst_key FROM orders WHERE o_orderstatus <> 'P' OR o_custkey NOT IN (SELECT o_custkey FROM alive)""")
def microbatch_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream of symbols, flushed batch by batch into a stored graph that held all of them; what no batch brought is swept."""
    from ..operators.store import GraphStore
    from ..sources.shared import shared_folder
    from ..streaming.flush import flush_symbols, open_stream

    store, none = GraphStore(spark, shared_folder(spark, "store")), F.lit(None).cast("string")

    def symbols(orders: DataFrame) -> DataFrame:
        return orders.select(
            F.concat(F.lit("o"), "o_orderkey").alias("key"), F.lit("x").alias("name"), F.concat(F.lit("c"), "o_custkey").alias("file_key"), F.lit("").alias("relative_path"), none.alias("documentation"),
            none.alias("comments"), none.alias("namespace"), F.lit(0).alias("ordinal"),
        )

    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("key")).distinct()
    graph = Graph(spark)
    store.commit(graph.put(file=graph.merged("file", files)).upsert_symbols(symbols(table(spark, sf_dir, "orders"))))
    stream = open_stream(spark, f"{sf_dir}/orders.parquet", 1).where("o_orderstatus <> 'P'")
    return flush_symbols(symbols(stream), store, shared_folder(spark, "stream"))["declares"].select("src_key", "dst_key")
