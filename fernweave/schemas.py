"""Row types of the property graph: in-flight rows, node tables, edge tables."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _parts(text: str) -> list[str]:
    """The text cut at commas outside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> T.DataType:
    kind, _, inner = text.partition("<")
    if not inner:
        return _PLAIN[kind]
    inner = inner[:-1]
    if kind == "array":
        return T.ArrayType(_type(inner))
    if kind == "map":
        return T.MapType(*map(_type, _parts(inner)))
    return T.StructType([T.StructField(n.strip(), _type(t.strip())) for n, _, t in (x.partition(":") for x in _parts(inner))])


def shape(text: str) -> T.StructType:
    """A row type from `name type, ...`; unlike StructType.fromDDL it needs no session."""
    return T.StructType([T.StructField(n, _type(t.strip())) for n, _, t in (x.partition(" ") for x in _parts(text))])


SYMBOL = shape(
    "key string, name string, kind string, class string, fqn string, accessibility string, file_key string, relative_path string, start_line int, end_line int, "
    "documentation string, comments string, namespace string, version string, language string, technology string"
)
RELATIONSHIP = shape("from_key string, to_key string, rel_type string")
AUTHOR_STATS = "struct<name: string, first_commit: timestamp, last_commit: timestamp, commit_count: int>"
FILE = shape(
    "file_key string, file_name string, relative_path string, file_hash string, created timestamp, last_modified timestamp, "
    f"authors array<{AUTHOR_STATS}>, commits array<string>, tags array<string>, repo_key string, namespace string, language string, technology string"
)
COMMIT = shape("hash string, author_name string, author_email string, date timestamp, message string, changed_files array<struct<path: string, is_deleted: boolean>>")
DEPENDENCY = shape("key string, name string, version string")
URL = shape("dep_key string, url_key string, name string")
_FACT_SYMBOL = "name: string, kind: string, class: string, fqn: string, accessibility: string, startLine: int, endLine: int, documentation: string, comments: string, namespace: string, containingClass: string"
_FACT_LINK = "fromSymbol: string, fromKind: string, fromLine: int, toSymbol: string, toKind: string, toLine: int, toFile: string, relType: string"
ANALYSIS = shape(
    f"projectName string, projectRoot string, files map<string, struct<symbols: array<struct<{_FACT_SYMBOL}>>, relationships: array<struct<{_FACT_LINK}>>>>"
)

#: Node tables with their unique key, and edge tables with their ends.
NODES = {
    "project": ("key", shape("key string, name string")),
    "file": ("key", shape("key string, path string, file_name string, namespace string, hash string, created timestamp, last_modified timestamp, deleted boolean, deleted_at timestamp, commits array<string>, tags array<string>, language string, technology string")),
    "symbol": ("key", T.StructType([*[f for f in SYMBOL if f.name != "relative_path"], T.StructField("file_path", T.StringType()), T.StructField("deleted", T.BooleanType()), T.StructField("deleted_at", T.TimestampType())])),
    "dependency": ("key", DEPENDENCY),
    "author": ("name", shape("name string, email string")),
    "commit": ("hash", shape("hash string, date timestamp, message string, author string")),
    "tag": ("name", shape("name string")),
    "url": ("key", shape("key string, name string")),
}
_ENDS = "src_key string, dst_key string"
EDGES = {
    "has_file": ("project", "file", shape(_ENDS)),
    "authored": ("author", "file", shape(f"{_ENDS}, first_commit timestamp, last_commit timestamp, commit_count int")),
    "declares": ("file", "symbol", shape(_ENDS)),
    "has_tag": ("symbol", "tag", shape(_ENDS)),
    "part_of_project": ("commit", "project", shape(_ENDS)),
    "committed": ("author", "commit", shape(_ENDS)),
    "modified_file": ("commit", "file", shape(_ENDS)),
    "depends_on": ("project", "dependency", shape(_ENDS)),
    "has_url": ("dependency", "url", shape(_ENDS)),
    "link": ("symbol", "symbol", shape(f"{_ENDS}, rel_type string")),
}
