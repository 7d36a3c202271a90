"""Scalar functions of the graph build, Column in and Column out, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 8000
VERBATIM_TAGS = ("DotNet", "iOS")
_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "dev.azure.com")
_PREFIXES = (
    *((f"{host.partition('.')[0]}:", f"https://{host}/") for host in _HOSTS[:3]),
    *((f"{scheme}git@{host}/", f"https://{host}/") for scheme in ("git+ssh://", "ssh://") for host in _HOSTS),
    *((f"git{scheme}://", f"{to}://") for scheme, to in (("+https", "https"), ("+http", "http"), ("", "https"))),
)


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def relative_path(root: str, path: Column) -> Column:
    """The path below root; a path that is not below it is returned as it is."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def infer_namespace(path: Column) -> Column:
    """The directory; for C#, Razor and XAML dotted and without a leading src or source."""
    folder = directory(path)
    dotted = F.regexp_replace(F.translate(folder, "/", "."), r"(?i)^(src|source)(\.|$)", "")
    return F.when(path.rlike(r"\.(cs|razor|xaml)$"), dotted).otherwise(folder)


def truncate(text: Column, most: int = MAX_TEXT) -> Column:
    return F.substring(text, 1, most)


def blank_to_null(text: Column) -> Column:
    return F.when(text.rlike(r"\S"), text)


def namespace_tags(namespace: Column) -> Column:
    """Segments of a namespace, words of a segment parted by underscores, acronyms kept whole."""
    border = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    segments = F.filter(F.split(F.coalesce(blank_to_null(namespace), F.lit("")), r"\."), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.isin(*VERBATIM_TAGS), s).otherwise(F.regexp_replace(s, border, "_")))


def line_of(prefix: Column) -> Column:
    """The 1-based line that follows a prefix of the text."""
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def normalize_repository_url(url: Column) -> Column:
    """Shorthands and SSH forms as HTTPS, without credentials and a last .git; null for null or empty."""
    bare = F.trim(url)
    low = F.lower(bare)
    spelled = F.when(F.lit(False), bare)
    for prefix, to in _PREFIXES:
        spelled = spelled.when(low.startswith(prefix), F.concat(F.lit(to), F.substring(bare, len(prefix) + 1, 1 << 30)))
    spelled = F.regexp_replace(spelled.otherwise(bare), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]+@", "$1")
    return F.when(url != "", F.regexp_replace(spelled, r"(?i)\.git$", ""))


def binding_path(value: Column) -> Column:
    """The path of a {Binding ...} value, null for anything else."""
    path = F.regexp_extract(value, r"^[{]Binding\s+(\S+?)(\s*,.*)?[}]$", 1)
    return F.nullif(F.regexp_replace(path, "^Path=", ""), F.lit(""))


def text_key(file_key: Column, kind: str | Column, name: Column, line: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", file_key, kind, name, *([line.cast("string")] if line is not None else []))


def stable_symbol_key(repo_key: Column, display: Column) -> Column:
    return F.concat(F.coalesce(repo_key, F.lit("")), F.lit(":"), display)


def target_framework(project: Column) -> Column:
    return F.nullif(F.regexp_extract(project, r"\(([^)]+)\)$", 1), F.lit(""))


def base_project(project: Column) -> Column:
    return F.regexp_replace(project, r"\([^)]+\)$", "")


def assembly_name(name: Column) -> Column:
    return F.trim(F.split(F.split(name, ",")[0], ":")[0])


def repo_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))


def tags_of_refs(refs: Column) -> Column:
    """Names after `tag:` in a list of refs, the first spelling of each."""
    each = F.filter(F.transform(F.split(refs, ","), lambda r: F.trim(r)), lambda r: r.startswith("tag:"))
    return F.transform(each, lambda r: F.trim(F.substring(r, 5, 1 << 30)))


def dart_accessibility(name: Column, protected: Column) -> Column:
    return F.when(name.startswith("_"), "Private").when(protected, "Protected").otherwise("Public")


def member_fqn(file: Column, owner: Column, name: Column) -> Column:
    return F.concat(file, F.lit("::"), F.concat_ws(".", owner, name))


def relative_import(origin: Column, spec: Column) -> Column:
    """A relative import as a path from the project root, .ts if it has no extension."""
    joined = F.split(F.concat_ws("/", F.nullif(directory(origin), F.lit("")), spec), "/")

    def step(done: Column, part: Column) -> Column:
        return F.when((part == ".") | (part == ""), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    path = F.array_join(F.aggregate(joined, F.expr("cast(array() as array<string>)"), step), "/")
    return F.when(file_name(path).contains("."), path).otherwise(F.concat(path, F.lit(".ts")))
