"""Extractors by regular expression: style sheets, HTML, Razor.  All in the JVM.

A match's line follows from the line ends in the text before it.  Those are counted per
gap and per match and summed by a window over the matches, so the work is linear in the
text, and only what matched is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import accessibility as A
from ..functions import scalars as S
from .rows import as_relationships, as_symbols

CSS = r"([^{]+)\s*\{"
HTML_ID = r"(?i)id=['\"](.*?)['\"]"
HTML_SCRIPT = r"(?i)<script\s+.*?src=['\"](.*?)['\"]"
RAZOR = r"(?m)^@(?:inherits|inject|model|using)\s+(.+)$"
RAZOR_NAMESPACE = r"(?m)^@namespace\s+(.+)$"


def _line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def matches(files: DataFrame, pattern: str, *keep: str, by: str = "file_key", content: str = "content") -> DataFrame:
    """keep, at (0-based), found (the whole match), value (its first group) and line, per match."""
    held = list(dict.fromkeys([by, *keep]))
    text = F.col(content)
    whole, group = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), _line_ends)
    each = files.select(*held, F.posexplode(F.arrays_zip(whole.alias("found"), group.alias("value"), gaps.alias("gap"))).alias("at", "m"))
    each = each.where("m.found is not null").select(*held, "at", "m.found", "m.value", "m.gap")
    order = Window.partitionBy(by).orderBy("at")
    before = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(_line_ends(F.col("found"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select(*held, "at", "found", "value", (before + 1).cast("int").alias("line"))


_BASE = ("file_key", "relative_path", "namespace", "language", "technology")


def _emit(found: DataFrame, kind: Column | str, token: Column | str, cls: str, link: str, with_line: bool = True) -> tuple[DataFrame, DataFrame]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    key = S.text_key(F.col("file_key"), token, F.col("value"), F.col("line") if with_line else None)
    symbols = as_symbols(found, key, F.col("value"), kind, F.lit(cls), F.col("value"), F.col("line"))
    return symbols, as_relationships(found, F.col("file_key"), key, link)


def _nothing(files: DataFrame) -> DataFrame:
    return files.where(F.lit(False))


def css(files: DataFrame, least: str = "NotApplicable", clean_selectors: bool = False) -> tuple[DataFrame, DataFrame]:
    """Selectors: the text up to each opening brace, rule bodies included unless clean_selectors takes what follows the last brace."""
    found = matches(files if A.text_symbols_visible(least) else _nothing(files), CSS, *_BASE)
    value = F.regexp_extract("value", r"([^}]*)$", 1) if clean_selectors else F.col("value")
    found = found.withColumn("value", F.regexp_replace(value, r"^\s+|\s+$", "")).where((F.col("value") != "") & ~F.col("value").startswith("@"))
    return _emit(found, "CssSelector", "CssSelector", "selector", "CONTAINS")


def html(files: DataFrame, least: str = "NotApplicable") -> tuple[DataFrame, DataFrame]:
    """Script references and element ids."""
    files = files if A.text_symbols_visible(least) else _nothing(files)
    scripts, script_links = _emit(matches(files, HTML_SCRIPT, *_BASE), "HtmlScriptReference", "ScriptRef", "script", "DEPENDS_ON")
    ids, id_links = _emit(matches(files, HTML_ID, *_BASE), "HtmlElementId", "ElementId", "element", "CONTAINS")
    return scripts.unionByName(ids), script_links.unionByName(id_links)


def razor(files: DataFrame, least: str = "NotApplicable") -> tuple[DataFrame, DataFrame]:
    """Directives; @namespace gives the namespace of the file."""
    named = S.blank_to_null(F.trim(F.regexp_extract("content", RAZOR_NAMESPACE, 1)))
    files = files.withColumn("namespace", named)
    found = matches(files if A.text_symbols_visible(least) else _nothing(files), RAZOR, *_BASE).withColumn("value", F.trim(F.regexp_replace("value", "\r", "")))
    start = F.trim("found")
    kind = F.when(start.startswith("@using"), "UsingDirective").when(start.startswith("@inject"), "InjectDirective").when(start.startswith("@model"), "ModelDirective").otherwise("InheritsDirective")
    return _emit(found, kind, kind, "component", "CONTAINS", with_line=False)
