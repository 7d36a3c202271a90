"""Finding files, reading them, and choosing the extractor of each."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

EXCLUDED = ("bin", "obj", ".git", ".idea", "node_modules", ".dart_tool", "build")
DEFAULT_INCLUDES = tuple(f".{x}" for x in "cs csproj css dart html js json razor ts tsx xaml xml".split())
#: handler, extension or whole file name, language, technology
HANDLERS = tuple(
    tuple(row.split())
    for row in (
        "csharp .cs csharp dotnet", "razor .razor csharp dotnet", "csproj .csproj xml dotnet", "xaml .xaml xaml dotnet", "typescript .ts typescript node", "typescript .tsx typescript node",
        "javascript .js javascript node", "npm package.json json node", "css .css css web", "html .html html web", "json .json json json", "xml .xml xml xml", "dart .dart dart flutter", "pubspec pubspec.yaml yaml flutter",
    )
)


def resolve_input(given: str | None, here: str = ".") -> str:
    """An existing file or directory as given; else the one solution, project or pubspec here, else the directory."""
    if given:
        if not Path(given).exists():
            raise FileNotFoundError(given)
        return given
    for pattern in ("*.sln", "*.slnx", "*.csproj", "pubspec.yaml"):
        found = sorted(Path(here).glob(pattern))
        if len(found) > 1:
            raise ValueError(f"several candidates: {', '.join(p.name for p in found)}")
        if found:
            return str(found[0])
    return here


def included(path: Column, extensions: tuple[str, ...] = DEFAULT_INCLUDES) -> Column:
    """Whether the path ends in one of the extensions, whatever the case."""
    low = F.lower(path)
    ends = F.lit(False)
    for extension in extensions:
        ends = ends | low.endswith(extension.lower())
    return ends


def excluded(path: Column) -> Column:
    """Whether any segment of the relative path is a directory of build products or tools."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, EXCLUDED)))


def generated_script(path: Column) -> Column:
    """Files that compilers and bundlers write, and declaration files."""
    return F.lower(path).rlike(r"(\.d\.ts|\.min\.js|\.bundle\.js|\.generated\.[jt]sx?|\.g\.[jt]s)$|(^|/)(dist|out|generated)/")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, file_name, file_key, namespace, content) of every file below root; content is read only where selected."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = S.relative_path(str(Path(root).absolute()), F.regexp_replace(S.normalize_path(F.col("path")), "^file:/+", "/"))
    found = raw.select(path.alias("relative_path"), "content")
    return found.select("relative_path", S.file_name(F.col("relative_path")).alias("file_name"), F.col("relative_path").alias("file_key"), S.infer_namespace(F.col("relative_path")).alias("namespace"), "content")


def discover(disk: DataFrame, catalog: DataFrame | None = None, extensions: tuple[str, ...] = DEFAULT_INCLUDES, pubspec: bool = False) -> DataFrame:
    """Files to process: those of a catalogue first, then those on disk, each path once whatever its case.

    Both have relative_path; the catalogue may bypass the exclusions.  Empty projects of
    the catalogue take no part, as they have no documents.
    """
    keep = included(F.col("relative_path"), extensions)
    if pubspec:
        keep = keep | (F.lower(S.file_name(F.col("relative_path"))) == "pubspec.yaml")
    walked = disk.where(keep & ~excluded(F.col("relative_path")))
    ci = F.lower("relative_path")
    if catalog is not None:
        known = catalog.where(keep).select("relative_path")
        own = disk.join(known, "relative_path", "left_semi")
        walked = own.unionByName(walked.withColumn("_ci", ci).join(known.select(ci.alias("_ci")).distinct(), "_ci", "left_anti").drop("_ci"))
    first = walked.groupBy(ci.alias("_ci")).agg(F.min("relative_path").alias("relative_path")).select("relative_path")
    return walked.join(first, "relative_path", "left_semi")


def changed_only(files: DataFrame, modified: DataFrame | None) -> DataFrame:
    """All files without a diff, none for an empty one, else those whose path it names."""
    if modified is None:
        return files
    return files.withColumn("_ci", F.lower("relative_path")).join(modified.select(F.lower("path").alias("_ci")).distinct(), "_ci", "left_semi").drop("_ci")


def dispatch(files: DataFrame) -> DataFrame:
    """handler, language and technology of each file: its whole name decides before its extension; both null where none fits.

    The dimension has one row per format, so it is folded into an expression, not joined.
    """
    name = F.lower(S.file_name(F.col("relative_path")))
    entries = [x for h, e, lang, tech in HANDLERS for x in (F.lit(e), F.struct(F.lit(h).alias("handler"), F.lit(lang).alias("language"), F.lit(tech).alias("technology")))]
    known = F.create_map(*entries)
    whole, by_extension = F.try_element_at(known, name), F.try_element_at(known, F.regexp_extract(name, r"(\.[^.]*)$", 1))
    chosen = F.when(name.startswith("."), by_extension).otherwise(F.coalesce(whole, by_extension))
    return files.withColumn("_chosen", chosen).select(*files.columns, *(F.col(f"_chosen.{c}").alias(c) for c in ("handler", "language", "technology")))


def nearest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """relative_path and root: the deepest directory above each file that roots (root) names; the top is ''."""
    parts = F.split(F.col("relative_path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.select("relative_path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root")
    return each.groupBy("relative_path").agg(F.max_by("root", F.length("root")).alias("root"))
