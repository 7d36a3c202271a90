"""Facts that language analyzers report, as symbol and relationship rows.

C#, TypeScript, JavaScript and Dart need a compiler to be understood; an analyzer runs
outside Spark and leaves one JSON document per project (schemas.ANALYSIS).  C# facts may
also carry explicit interface implementations in a `explicitInterface` flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import accessibility as A
from ..functions import scalars as S
from ..operators.rows import as_relationships, as_symbols


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """One row per analysed file: project_name, project_root, fact_path, symbols, relationships."""
    raw = spark.read.schema(schemas.ANALYSIS).option("multiLine", True).json(path)
    each = raw.select(F.col("projectName").alias("project_name"), F.col("projectRoot").alias("project_root"), F.explode("files").alias("fact_path", "facts"))
    return each.select("project_name", "project_root", S.normalize_path(F.col("fact_path")).alias("fact_path"), "facts.symbols", "facts.relationships")


def match_files(files: DataFrame, analysis: DataFrame, fix_nested: bool = False) -> DataFrame:
    """Files with their facts, by path whatever its case.

    Fact paths are relative to the project.  They are compared with the path as it is,
    unless fix_nested puts the project root (a column `root` of files) before them.
    """
    path = F.lower("relative_path")
    if fix_nested:
        path = F.lower(F.when(F.col("root") != "", F.expr("substring(relative_path, length(root) + 2)")).otherwise(F.col("relative_path")))
    return files.withColumn("_ci", path).join(analysis.withColumn("_ci", F.lower("fact_path")), "_ci").drop("_ci")


def fact_symbols(matched: DataFrame, least: str = "NotApplicable") -> DataFrame:
    """Symbol rows; a symbol ends on the line where it starts, and keeps no comments."""
    each = matched.select("file_key", "relative_path", F.col("namespace").alias("file_namespace"), "language", "technology", F.explode("symbols").alias("s"))
    kept = each.where(A.fact_visible(F.col("s.accessibility"), least))
    return as_symbols(
        kept, key=S.text_key(F.col("file_key"), F.col("s.kind"), F.col("s.name"), F.col("s.startLine")), name=F.col("s.name"), kind=F.col("s.kind"), cls=F.col("s.class"), fqn=F.col("s.fqn"),
        line=F.col("s.startLine"), accessibility=F.col("s.accessibility"), documentation=F.col("s.documentation"), namespace=F.coalesce("s.namespace", "file_namespace"),
    )


def root_prefix(relative_path: Column, fact_path: Column) -> Column:
    """What stands before the project-relative path."""
    return F.substring(relative_path, F.lit(1), F.greatest(F.length(relative_path) - F.length(fact_path), F.lit(0)))


def fact_relationships(matched: DataFrame, cross_file: bool = True) -> DataFrame:
    """Relationship rows as reported; with cross_file, targets may lie in other files of the project."""
    each = matched.select("file_key", root_prefix(F.col("relative_path"), F.col("fact_path")).alias("prefix"), F.explode("relationships").alias("r"))
    target = F.col("file_key")
    if cross_file:
        target = F.when(F.coalesce("r.toFile", F.lit("")) == "", target).otherwise(F.concat("prefix", S.normalize_path(F.col("r.toFile"))))
    return as_relationships(
        each, S.text_key(F.col("file_key"), F.col("r.fromKind"), F.col("r.fromSymbol"), F.col("r.fromLine")), S.text_key(target, F.col("r.toKind"), F.col("r.toSymbol"), F.col("r.toLine")), F.col("r.relType")
    )


def assembly_dependencies(references: DataFrame) -> DataFrame:
    """(project, key, name, version) of assembly references (project, assembly, version), one target framework per project."""
    from pyspark.sql import Window

    base = references.withColumn("base", S.base_project(F.col("project")))
    order = Window.partitionBy(F.lower("base")).orderBy("project")
    first = base.select("base", "project").distinct().withColumn("n", F.row_number().over(order)).where("n = 1").select("project")
    name = S.assembly_name(F.col("assembly"))
    return base.join(first, "project", "left_semi").where(name != "").select(F.col("base").alias("project"), F.concat(F.lit("pkg:"), name).alias("key"), name.alias("name"), "version")


def external_usings(usings: DataFrame, own: DataFrame) -> DataFrame:
    """(from_key, to_key, rel_type): using lines (repo_key, project, file_key, name, is_global) that name no namespace of own (name).

    Global usings hold for every other file of the project too, once.
    """
    lines = usings.select("repo_key", "project", "file_key", "name")
    shared = usings.where("is_global").select("project", "name", F.col("file_key").alias("origin"))
    files = usings.select("repo_key", "project", "file_key").distinct()
    spread = files.join(shared, "project").where("file_key <> origin").select("repo_key", "project", "file_key", "name")
    outside = lines.unionByName(spread).join(own.select("name").distinct(), "name", "left_anti")
    return outside.select(F.col("file_key").alias("from_key"), S.stable_symbol_key(F.col("repo_key"), F.col("name")).alias("to_key"), F.lit("DEPENDS_ON").alias("rel_type")).dropDuplicates()


def using_lines(files: DataFrame) -> DataFrame:
    """(file_key, name, is_global) of `using` directives in C# text: the lexical part of what a compiler would report."""
    found = files.select("file_key", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*((?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?[\w.]+)[ \t]*;"), F.lit(1))).alias("line"))
    return found.select("file_key", F.regexp_extract("line", r"([\w.]+)$", 1).alias("name"), F.col("line").startswith("global").alias("is_global"))


def invocations(calls: DataFrame) -> DataFrame:
    """(from_key, to_key, rel_type) of calls (caller, callee), a callee once per caller."""
    return calls.select(F.col("caller").alias("from_key"), F.col("callee").alias("to_key"), F.lit("INVOKES").alias("rel_type")).dropDuplicates()
