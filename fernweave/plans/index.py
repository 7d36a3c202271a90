"""Whole runs: full index, incremental index and purge of a source tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..operators import text_extract, tree_extract
from ..operators.store import Graph, GraphStore, empty
from ..sources import analyzer, files, history
from ..sources.shared import stored

_TEXT = {"css": text_extract.css, "html": text_extract.html, "razor": text_extract.razor}
_TREE = ("xml", "xaml", "csproj", "json", "npm", "pubspec")
_FACTS = {"csharp": True, "typescript": True, "javascript": True, "dart": False}


@dataclass(frozen=True)
class Inputs:
    """What a run reads besides the tree: logs (log, ord, line), analyzer facts, project references, package metadata."""

    history: DataFrame | None = None
    commits: DataFrame | None = None
    diff: DataFrame | None = None
    facts: DataFrame | None = None
    references: DataFrame | None = None
    nuspecs: DataFrame | None = None
    npm_metadata: DataFrame | None = None
    catalog: DataFrame | None = None


def extract_all(chosen: DataFrame, facts: DataFrame | None = None, least: str = "NotApplicable") -> tuple[DataFrame, DataFrame]:
    """(symbols with ordinal, relationships) of dispatched files: one branch per handler, then a union."""
    spark = chosen.sparkSession
    symbols, links = empty(spark, schemas.SYMBOL).withColumn("ordinal", F.lit(0)), empty(spark, schemas.RELATIONSHIP)
    text = chosen.withColumn("content", F.decode("content", "UTF-8"))

    def numbered(rows: DataFrame) -> DataFrame:
        return rows if "ordinal" in rows.columns else rows.withColumn("ordinal", F.coalesce("start_line", F.lit(0)))

    for handler, run in _TEXT.items():
        found, edges = run(text.where(F.col("handler") == handler), least)
        symbols, links = symbols.unionByName(numbered(found)), links.unionByName(edges)
    for handler in _TREE:
        found, edges = tree_extract.extract(text.where(F.col("handler") == handler), handler, least)
        symbols, links = symbols.unionByName(found), links.unionByName(edges)
    if facts is not None:
        for handler, cross in _FACTS.items():
            matched = analyzer.match_files(chosen.where(F.col("handler") == handler).drop("content"), facts)
            symbols = symbols.unionByName(numbered(analyzer.fact_symbols(matched, least)))
            links = links.unionByName(analyzer.fact_relationships(matched, cross))
    return symbols, links


def index(spark: SparkSession, root: str, store: GraphStore, repo_key: str | None, inputs: Inputs = Inputs(), extensions: tuple[str, ...] = files.DEFAULT_INCLUDES, least: str = "NotApplicable") -> Graph:
    """Indexes the tree into the store: everything, or with inputs.diff what changed.

    Order: project, dependencies, soft deletes, files, symbols, edges, sweep, URLs, commits.
    Edges are resolved against all symbols of the store.  Commits are taken in even if no
    changed file is left.
    """
    graph = store.load().upsert_project(repo_key, repo_key)
    if inputs.references is not None:
        graph = graph.upsert_dependencies(analyzer.assembly_dependencies(inputs.references).select("key", "name", "version"), repo_key)
    modified = None
    if inputs.diff is not None:
        changes = history.diff(inputs.diff)
        modified = changes.where("not is_deleted").select("path")
        graph = graph.soft_delete(changes.where("is_deleted").select("path"))
    tree = files.read_files(spark, root)
    chosen = files.dispatch(files.changed_only(files.discover(tree, inputs.catalog, extensions, pubspec=True), modified)).where("handler is not null")
    log = history.bulk_history(inputs.history) if inputs.history is not None else None
    base = chosen.select("file_key", "file_name", "relative_path", S.content_hash(F.col("content")).alias("file_hash"), F.lit(repo_key).cast("string").alias("repo_key"), "namespace", "language", "technology")
    if log is not None:
        base = history.with_history(base, history.file_metadata(log))
    else:
        base = base.withColumns({c: F.lit(None).cast("timestamp") for c in ("created", "last_modified")} | {c: F.expr(f"cast(array() as {schemas.FILE[c].dataType.simpleString()})") for c in ("authors", "commits", "tags")})
    base = stored(base)
    symbols, links = map(stored, extract_all(chosen, inputs.facts, least))  # every table below reads them
    graph = graph.upsert_files(base.withColumn("ordinal", F.lit(0))).settle("file", "author").upsert_symbols(symbols).settle("symbol", "declares")
    graph = graph.link_symbols(links)
    graph = graph.sweep(chosen.select("file_key"), symbols.select("key"))
    packages = symbols.where("kind = 'Dependency'")
    for urls in _urls(packages, inputs):
        graph = graph.upsert_urls(urls)
    if inputs.commits is not None:
        graph = graph.upsert_commits(history.commits(inputs.commits), repo_key)
    return store.commit(graph)


def _urls(packages: DataFrame, inputs: Inputs) -> list[DataFrame]:
    found = []
    if inputs.nuspecs is not None:
        found.append(tree_extract.nuspec_urls(packages.where("technology = 'dotnet'").select("name", "version").distinct(), inputs.nuspecs))
    if inputs.npm_metadata is not None:
        names = packages.where("technology = 'node'").select("name", S.directory(F.col("relative_path")).alias("package_dir")).distinct()
        found.append(tree_extract.npm_urls(names, inputs.npm_metadata))
    return found


def purge(store: GraphStore, repo_key: str | None, extensions: tuple[str, ...] | None = None, dependencies: bool = True) -> int:
    """Removes a project, or everything for a null key; the whole default list of extensions means no limit.  Returns how many nodes went."""
    limit = None if extensions is None or set(extensions) == set(files.DEFAULT_INCLUDES) else list(extensions)
    graph, counts = store.load().purge(repo_key, limit, dependencies)
    total = counts.agg(F.coalesce(F.sum("purged"), F.lit(0))).first()[0]
    store.commit(graph)
    return int(total)


def totals(graph: Graph) -> DataFrame:
    """(name, n) of every table."""
    out = None
    for name in [*schemas.NODES, *schemas.EDGES]:
        rows = graph[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
