"""Extractors that need a parser: XML, XAML, project files, JSON, package manifests.

Spark's XML and JSON functions give neither line numbers nor repeated keys in order, so
these walk the text in Python, Arrow batches in and out, one file at a time.  A file that
cannot be parsed gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import accessibility as A

XAML_SPACES = frozenset((
    *(f"http://schemas.microsoft.com/{name}" for name in ("client/2007", "dotnet/2021/maui", "winfx/2006/xaml", "winfx/2006/xaml/presentation", "winfx/2009/xaml")),
    "http://xamarin.com/schemas/2014/forms", "https://github.com/avaloniaui",
))
_BINDING = re.compile(r"^[{]Binding\s+(\S+?)(\s*,.*)?[}]$")
_EVENT_ENDS = ("Click", "Changed", "Loaded", "Pressed", "Released")
_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SYMBOL) + ", ordinal int, from_key string, rel_type string"


class Element:
    """A parsed element: local name, attributes as (namespace, name, value), line, text, children."""

    def __init__(self, name: str, line: int, attributes: list[tuple[str, str, str]]):
        self.space, _, self.name = name.rpartition("}") if "}" in name else ("", "", name)
        self.line, self.attributes, self.children, self.text = line, attributes, [], []

    def walk(self) -> Iterator[Element]:
        """This element and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            top = stack.pop()
            yield top
            stack.extend(reversed(top.children))

    def get(self, name: str) -> str | None:
        return next((v for space, n, v in self.attributes if n == name and not space), None)

    def value(self) -> str:
        return "".join("".join(e.text) for e in self.walk()) if self.children else "".join(self.text)


def parse_xml(content: str) -> Element | None:
    """The root, with lines; None where the text is not well-formed.  Names read {namespace}local."""
    parser = expat.ParserCreate(namespace_separator="}")
    parser.ordered_attributes = True
    parser.buffer_text = True
    stack: list[Element] = []
    roots: list[Element] = []

    def start(name: str, attributes: list[str]) -> None:
        named = [(*(k.rsplit("}", 1) if "}" in k else ("", k)), v) for k, v in zip(attributes[::2], attributes[1::2])]
        element = Element(name, parser.CurrentLineNumber, named)
        (stack[-1].children if stack else roots).append(element)
        stack.append(element)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda text: stack[-1].text.append(text) if stack else None
    try:
        parser.Parse(content.lstrip("﻿").encode(), True)
    except expat.ExpatError:
        return None
    return roots[0]


class Emit:
    """Collects rows of one file."""

    def __init__(self, file: dict):
        self.file, self.rows = file, []

    def add(self, key, name, kind, cls, fqn, line, link, source=None, accessibility="Public", documentation=None, comments=None, version=None, plain=False, namespace=...):
        f = self.file
        self.rows.append({
            "key": key, "name": name, "kind": kind, "class": cls, "fqn": fqn, "accessibility": accessibility, "file_key": f["file_key"], "relative_path": f["relative_path"],
            "start_line": line, "end_line": line, "documentation": documentation, "comments": comments, "namespace": f["namespace"] if namespace is ... else namespace, "version": version,
            "language": "unknown" if plain else f["language"], "technology": "unknown" if plain else f["technology"],
            "ordinal": len(self.rows), "from_key": f["file_key"] if source is None else source, "rel_type": link,
        })

    def dependency(self, name: str, version: str | None) -> None:
        self.add(f"pkg:{name}", name, "Dependency", name, f"{name} ({version})" if version is not None else name, -1, "DEPENDS_ON", documentation=version, version=version)

    def attributes(self, element: Element, parent: str, kind: str, link: str, skip: Callable[[str, str], bool] | None = None, comment: Callable[[str], str | None] | None = None) -> None:
        """One symbol per attribute, but for those that skip names; comment may read a value."""
        for space, name, value in element.attributes:
            if not (skip and skip(space, name)):
                key = f"{self.file['file_key']}:{kind}:{element.name}.{name}:{element.line}"
                self.add(key, name, kind, "attribute", f"{element.name}.{name}={value}", element.line, link, source=parent, documentation=value, comments=comment(value) if comment else None)


def binding(value: str) -> str | None:
    hit = _BINDING.match(value)
    return hit and hit[1].removeprefix("Path=")


def _xml(emit: Emit, root: Element, least: str) -> None:
    if not A.manifest_visible(least):
        return
    for e in root.walk():
        key = f"{emit.file['file_key']}:XmlElement:{e.name}:{e.line}"
        emit.add(key, e.name, "XmlElement", "element", e.name, e.line, "CONTAINS")
        emit.attributes(e, key, "XmlAttribute", "HAS_ATTRIBUTE")


def _is_event(name: str) -> bool:
    return name.endswith(_EVENT_ENDS) or name == "Command"


def _xaml(emit: Emit, root: Element, least: str) -> None:
    def own(e: Element, name: str) -> str | None:
        return next((v for space, n, v in e.attributes if n == name and (not space or space in XAML_SPACES)), None)

    file = emit.file["file_key"]
    owner = own(root, "Class")
    emit.file = emit.file | {"namespace": owner.rpartition(".")[0] or None if owner else None}
    for e in root.walk():
        named = own(e, "Name")
        named = own(e, "Key") if named is None else named
        suffix = f":{named}" if named is not None else ""
        key = f"{file}:{e.name}{suffix}:{e.line}"
        if A.manifest_visible(least):
            emit.add(key, named if named is not None else e.name, "XamlElement", "element", e.name + suffix, e.line, "CONTAINS")
        if A.manifest_visible(least, "Private"):
            for _, name, value in e.attributes:
                if _is_event(name):
                    emit.add(f"{file}:EventHandler:{value}", value, "XamlEventHandler", "event-handler", value, e.line, "BINDS_TO", source=key, accessibility="Private")
        if A.manifest_visible(least):
            emit.attributes(e, key, "XamlAttribute", "SETS_PROPERTY", lambda space, name: space in XAML_SPACES or _is_event(name), binding)


def _csproj(emit: Emit, root: Element, least: str) -> None:
    if not A.manifest_visible(least):
        return
    file = emit.file["file_key"]
    for group in root.children:
        for e in group.children if group.name == "PropertyGroup" else ():
            if (value := e.value()).strip():
                emit.add(f"{file}:Property:{e.name}:{e.line}", e.name, "ProjectProperty", e.name, f"{e.name}: {value}", e.line, "HAS_PROPERTY", documentation=value, plain=True)
    below = list(root.walk())[1:]
    for e in below:
        if e.name == "PackageReference" and (name := e.get("Include")):
            version = e.get("Version")
            inner = next((c.value() for c in e.children if c.name == "Version" and c.space == e.space), None)
            emit.dependency(name, inner if version is None else version)
    for e in below:
        if e.name == "ProjectReference" and (name := e.get("Include")):
            emit.add(f"{file}:ProjectReference:{name}:{e.line}", name, "ProjectReference", name, name, e.line, "DEPENDS_ON", plain=True)


class Pairs(list):
    """The members of a JSON object, in order, repeated names included."""


def _refuse(name: str):
    raise ValueError(name)


def parse_json(content: str):
    """Strict JSON, objects as Pairs; raises ValueError."""
    return json.loads(content.removeprefix("﻿"), object_pairs_hook=Pairs, parse_constant=_refuse)


def json_paths(content: str) -> list[tuple[str, str]]:
    """(name, dotted path) of every property, in order; none where the text is not JSON."""
    try:
        value = parse_json(content)
    except (ValueError, RecursionError):
        return []
    out, stack = [], [(value, "")]
    while stack:
        value, path = stack.pop()
        if isinstance(value, tuple):  # a member whose turn has come
            name, inner = value
            out.append((name, path))
            stack.append((inner, path))
        elif isinstance(value, Pairs):
            stack.extend(reversed([((name, inner), f"{path}.{name}" if path else name) for name, inner in value]))
        elif isinstance(value, list):
            stack.extend(reversed([(item, f"{path}[{i}]") for i, item in enumerate(value)]))
    return out


def _json(emit: Emit, content: str, least: str) -> None:
    if A.text_symbols_visible(least):
        for name, path in json_paths(content):
            emit.add(f"{emit.file['file_key']}:JsonProperty:{path}", name, "JsonProperty", "property", path, -1, "CONTAINS")


def _npm(emit: Emit, content: str, least: str) -> None:
    if not A.manifest_visible(least):
        return
    try:
        root = parse_json(content)
    except (ValueError, RecursionError):
        return
    for section in ("dependencies", "devDependencies"):
        found = next((v for k, v in reversed(root) if k == section), None) if isinstance(root, Pairs) else None
        for name, version in found if isinstance(found, Pairs) else ():
            if name:
                emit.dependency(name, version if isinstance(version, str) else None)


def parse_pubspec(content: str) -> dict:
    """name, sdk, dependencies and dev_dependencies as (name, version) lists, line by line."""
    out = {"name": "", "sdk": None, "dependencies": [], "dev_dependencies": []}
    section, environment = None, False
    for line in content.split("\n"):
        line = line.rstrip("\r")
        if line and not line[0].isspace():
            environment = line.startswith("environment:")
            section = next((s for s in ("dependencies", "dev_dependencies") if line.startswith(s + ":")), None)
            if line.startswith("name:"):
                out["name"] = line[5:].strip()
        elif bare := line.strip():
            key, colon, value = bare.partition(":")
            if environment and bare.startswith("sdk:"):
                out["sdk"] = value.strip().strip("\"'") or out["sdk"]
            elif section and colon and key.strip():
                out[section].append((key.strip(), value.strip() or None))
    return out


def _pubspec(emit: Emit, content: str, least: str) -> None:
    if A.manifest_visible(least):
        found = parse_pubspec(content)
        for name, version in found["dependencies"] + found["dev_dependencies"]:
            emit.dependency(name, version)


def _from_xml(walk: Callable[[Emit, Element, str], None]) -> Callable[[Emit, str, str], None]:
    def run(emit: Emit, content: str, least: str) -> None:
        if (root := parse_xml(content)) is not None:
            walk(emit, root, least)

    return run


WALKERS: dict[str, Callable[[Emit, str, str], None]] = {
    "xml": _from_xml(_xml), "xaml": _from_xml(_xaml), "csproj": _from_xml(_csproj), "json": _json, "npm": _npm, "pubspec": _pubspec,
}


def extract(files: DataFrame, handler: str, least: str = "NotApplicable") -> tuple[DataFrame, DataFrame]:
    """(symbols with their ordinal in the file, relationships) of files (file_key, relative_path, namespace, language, technology, content)."""
    walk = WALKERS[handler]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch.to_dict("records"):
                emit = Emit(file)
                if isinstance(file["content"], str):
                    walk(emit, file["content"], least)
                rows += emit.rows
            if rows:
                yield pd.DataFrame(rows)

    both = files.select("file_key", "relative_path", "namespace", "language", "technology", F.col("content").cast("string").alias("content")).mapInPandas(run, _ROWS)
    symbols = both.select(*schemas.SYMBOL.fieldNames(), "ordinal")
    return symbols, both.select("from_key", F.col("key").alias("to_key"), "rel_type")


def nuspec_urls(packages: DataFrame, nuspecs: DataFrame) -> DataFrame:
    """(dep_key, url_key, name): project and repository URLs of packages (name, version) from nuspecs (id, version, content)."""
    bare = F.regexp_replace("content", r"\sxmlns=(\"[^\"]*\"|'[^']*')", "")
    meta = nuspecs.select(F.lower("id").alias("id"), "version", F.array(F.trim(F.xpath_string(bare, F.lit("package/metadata/projectUrl"))), F.trim(F.xpath_string(bare, F.lit("package/metadata/repository/@url")))).alias("urls"))
    found = packages.withColumn("id", F.lower("name")).join(meta, ["id", "version"]).select("name", F.explode("urls").alias("url")).where("url <> ''")
    return found.select(F.concat(F.lit("pkg:"), "name").alias("dep_key"), F.concat(F.lit("url:"), "url").alias("url_key"), F.col("url").alias("name"))


def npm_urls(packages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(dep_key, url_key, name): homepage and repository of packages (name, package_dir) from metadata files (path, content).

    node_modules/<name>/package.json is preferred to the first of node_modules/.pnpm/<name>@*.
    """
    from ..functions import scalars as S

    folder = F.when(F.col("package_dir") == "", "node_modules/").otherwise(F.concat("package_dir", F.lit("/node_modules/")))
    wanted = packages.select("name", "package_dir", F.concat(folder, "name", F.lit("/package.json")).alias("plain"), F.concat(folder, F.lit(".pnpm/"), F.replace("name", F.lit("/"), F.lit("+")), F.lit("@")).alias("store"))
    plain = wanted.join(metadata, F.col("plain") == F.col("path")).select("name", "package_dir", F.lit(0).alias("rank"), "path", "content")
    entry = F.regexp_extract("path", "^(.*/[.]pnpm/[^/]+@)[^/]*/node_modules/", 1)
    inner = F.regexp_extract("path", "^.*/[.]pnpm/[^/]+@[^/]*/node_modules/(.+)/package[.]json$", 1)
    held = metadata.select(F.lower(entry).alias("entry"), inner.alias("inner"), F.col("path"), F.col("content")).where("entry <> ''")
    stored = wanted.join(held, (F.lower("store") == F.col("entry")) & (F.col("name") == F.col("inner"))).select("name", "package_dir", F.lit(1).alias("rank"), "path", "content")
    first = plain.unionByName(stored).groupBy("name", "package_dir").agg(F.min(F.struct("rank", "path", "content")).alias("first")).select("name", "first.content")
    repository = F.coalesce(F.get_json_object("content", "$.repository.url"), F.when(~F.get_json_object("content", "$.repository").startswith("{"), F.get_json_object("content", "$.repository")))
    urls = first.select("name", F.explode(F.array(F.trim(F.get_json_object("content", "$.homepage")), S.normalize_repository_url(repository))).alias("url")).where("url <> ''")
    return urls.select(F.concat(F.lit("pkg:"), "name").alias("dep_key"), F.concat(F.lit("url:"), "url").alias("url_key"), F.col("url").alias("name"))
