"""Scalar functions, filters and dispatch over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import accessibility as A
from ..functions import scalars as S
from ..operators.rows import as_symbols
from ..sources import files
from .query import query, table

_NAMES = ("a.cs", "package.json", "pubspec.yaml", "Main.CSS", "view.tsx", "notes.txt", "index.html", "App.razor", "types.d.ts", "lib.dart", "data.xml", "Makefile")
_FOLDERS = ("src", "source/core", "obj/x", "lib", "Build", "web/node_modules/y", "docs", ".git")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: a path from the page's URL, with folders and names that its id picks."""
    part = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", pick(_FOLDERS), F.regexp_replace(part, "/+$", ""), pick(_NAMES)).alias("relative_path"))


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_PATHS_SQL = f"""paths AS (
  SELECT page_id, {_list(_FOLDERS)}[page_id % {len(_FOLDERS)} + 1] || '/' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/+$', '') || '/'
         || {_list(_NAMES)}[page_id % {len(_NAMES)} + 1] AS relative_path FROM pages)"""


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"))


@query(rf"""WITH {_PATHS_SQL},
parts AS (SELECT *, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS folder FROM paths)
SELECT page_id, relative_path AS file_key,
       CASE WHEN regexp_matches(relative_path, '\.(cs|razor|xaml)$') THEN regexp_replace(replace(folder, '/', '.'), '(?i)^(src|source)(\.|$)', '') ELSE folder END AS namespace
FROM parts""")
def infer_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", S.normalize_path(F.col("relative_path")).alias("file_key"), S.infer_namespace(F.col("relative_path")).alias("namespace"))


_DIMENSION = ", ".join(f"('{h}', '{e}', '{lang}', '{tech}')" for h, e, lang, tech in files.HANDLERS)


@query(rf"""WITH {_PATHS_SQL}, dim(handler, ext, language, technology) AS (VALUES {_DIMENSION}),
parts AS (SELECT *, lower(regexp_extract(relative_path, '([^/]*)$', 1)) AS name FROM paths)
SELECT p.page_id, p.relative_path, coalesce(n.handler, e.handler) AS handler, coalesce(n.language, e.language) AS language, coalesce(n.technology, e.technology) AS technology
FROM parts p LEFT JOIN dim n ON n.ext = p.name LEFT JOIN dim e ON e.ext = regexp_extract(p.name, '(\.[^.]*)$', 1)""")
def handler_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dispatch(_paths(spark, sf_dir))


@query(f"""WITH {_PATHS_SQL}
SELECT min(relative_path) AS relative_path FROM paths
WHERE len(list_filter({_list(files.DEFAULT_INCLUDES)}, lambda e: ends_with(lower(relative_path), e))) > 0
  AND NOT list_has_any(string_split(lower(relative_path), '/'), {_list(files.EXCLUDED)})
GROUP BY lower(relative_path)""")
def discovery_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.discover(_paths(spark, sf_dir)).select("relative_path").distinct()


@query(r"""WITH spaced AS (SELECT p_partkey, 'Shop.DotNet.' || p_type || upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', 'X') || '.iOS' AS namespace FROM part),
each AS (SELECT p_partkey, unnest(string_split(namespace, '.')) AS seg FROM spaced)
SELECT DISTINCT p_partkey, CASE WHEN seg IN ('DotNet', 'iOS') THEN seg
       ELSE regexp_replace(regexp_replace(seg, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([a-z])([A-Z])', '\1_\2', 'g') END AS tag
FROM each WHERE seg <> ''""")
def namespace_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.replace(F.substring("p_name", 2, 1000), F.lit(" "), F.lit("X")))
    namespace = F.concat(F.lit("Shop.DotNet."), "p_type", name, F.lit(".iOS"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(S.namespace_tags(namespace)).alias("tag")).distinct()


@query("""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
       length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1 AS middle_line
FROM documents""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.substring("text", F.lit(1), F.expr("cast(length(text) div 2 as int)"))
    return table(spark, sf_dir, "documents").select("doc_id", S.line_of(F.col("text")).cast("bigint").alias("n_lines"), S.line_of(half).cast("bigint").alias("middle_line"))


@query("""SELECT 'part/' || p_partkey || ':Part:' || p_name || ':' || p_size AS key, p_name AS name, 'Part' AS kind, p_brand AS class, p_name || ' (' || p_type || ')' AS fqn, 'Public' AS accessibility,
       'part/' || p_partkey AS file_key, p_size AS start_line, p_size AS end_line, p_type AS version, 'unknown' AS language FROM part""")
def symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("file_key", F.concat(F.lit("part/"), "p_partkey")).withColumns({"relative_path": F.col("file_key"), "namespace": F.lit(None).cast("string")})
    symbols = as_symbols(
        rows, S.text_key(F.col("file_key"), "Part", F.col("p_name"), F.col("p_size")), F.col("p_name"), F.lit("Part"), F.col("p_brand"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), F.col("p_size"),
        version=F.col("p_type"), language=F.lit("unknown"), technology=F.lit("unknown"),
    )
    return symbols.select("key", "name", "kind", "class", "fqn", "accessibility", "file_key", "start_line", "end_line", "version", "language")


@query(r"SELECT doc_id, substr(CASE WHEN regexp_matches(text, '\S') THEN text END, 1, 8000) AS documentation FROM documents")
def truncate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate(S.blank_to_null(F.col("text"))).alias("documentation"))


_BY_PRIORITY = {"1-URGENT": "Public", "2-HIGH": "Internal", "3-MEDIUM": "Protected", "4-NOT SPECIFIED": "NotApplicable", "5-LOW": "Private"}


@query(f"""WITH named AS (SELECT o_orderkey, o_orderstatus = 'F' AS explicit, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _BY_PRIORITY.items())} END AS level FROM orders),
ranked AS (SELECT *, CASE level WHEN 'NotApplicable' THEN 0 WHEN 'Private' THEN 1 WHEN 'Protected' THEN 3 WHEN 'Internal' THEN 4 WHEN 'Public' THEN 6 END AS n FROM named)
SELECT o_orderkey, n >= 4 OR n = 0 AS as_type, n >= 4 OR explicit AS as_member, CASE WHEN level IN ('Public', 'Private', 'Protected', 'Internal') THEN n ELSE 6 END >= 4 AS as_fact FROM ranked""")
def accessibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.lit(False), F.lit(""))
    for priority, name in _BY_PRIORITY.items():
        level = level.when(F.col("o_orderpriority") == priority, name)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("explicit"), level.alias("level"))
    declared = F.col("level")
    return rows.select(
        "o_orderkey", A.type_visible(declared, "Internal").alias("as_type"), A.member_visible(declared, F.col("explicit"), "Internal").alias("as_member"), A.fact_visible(declared, "Internal").alias("as_fact")
    )


_SCHEMES = ("github:", "git+ssh://git@github.com/", "ssh://git@gitlab.com/", "git+https://user:pw@", "git://", "https://")


@query(rf"""WITH made AS (SELECT page_id, {_list(_SCHEMES)}[page_id % {len(_SCHEMES)} + 1] || regexp_replace(url, '^[a-z]+://', '') || '.git' AS url FROM pages),
plain AS (SELECT page_id, CASE
    WHEN starts_with(url, 'github:') THEN 'https://github.com/' || substr(url, 8)
    WHEN starts_with(url, 'git+ssh://git@github.com/') THEN 'https://github.com/' || substr(url, 26)
    WHEN starts_with(url, 'ssh://git@gitlab.com/') THEN 'https://gitlab.com/' || substr(url, 22)
    WHEN starts_with(url, 'git+https://') THEN 'https://' || substr(url, 13)
    WHEN starts_with(url, 'git://') THEN 'https://' || substr(url, 7) ELSE url END AS url FROM made)
SELECT page_id, regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]+@', '\1'), '(?i)\.git$', '') AS url FROM plain""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, _SCHEMES)), (F.col("page_id") % len(_SCHEMES) + 1).cast("int"))
    made = F.concat(pick, F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".git"))
    return table(spark, sf_dir, "pages").select("page_id", S.normalize_repository_url(made).alias("url"))


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def handler_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query(rf"""WITH made AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '(net9.0)' WHEN 1 THEN '(netstandard2.0)' ELSE '' END AS project, p_name || '.' || p_type || ', Version=' || p_size AS assembly FROM part)
SELECT p_partkey, nullif(regexp_extract(project, '\(([^)]+)\)$', 1), '') AS framework, regexp_replace(project, '\([^)]+\)$', '') AS base, trim(string_split(string_split(assembly, ',')[1], ':')[1]) AS assembly,
       'repo' || ':' || assembly AS symbol_key FROM made""")
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 3 == 0, "(net9.0)").when(F.col("p_partkey") % 3 == 1, "(netstandard2.0)").otherwise("")
    made = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("project"), F.concat("p_name", F.lit("."), "p_type", F.lit(", Version="), "p_size").alias("assembly"))
    return made.select(
        "p_partkey", S.target_framework(F.col("project")).alias("framework"), S.base_project(F.col("project")).alias("base"), S.assembly_name(F.col("assembly")).alias("assembly"),
        S.stable_symbol_key(F.lit("repo"), F.col("assembly")).alias("symbol_key"),
    )
