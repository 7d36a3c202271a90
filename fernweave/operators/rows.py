"""Symbol and relationship rows, with the defaults that all extractors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def as_symbols(
    rows: DataFrame, key: Column, name: Column, kind: Column, cls: Column, fqn: Column, line: Column, accessibility: Column | None = None,
    documentation: Column | None = None, comments: Column | None = None, namespace: Column | None = None, version: Column | None = None,
    language: Column | None = None, technology: Column | None = None,
) -> DataFrame:
    """Symbols from rows with file_key, relative_path, namespace, language and technology."""
    none = F.lit(None).cast("string")
    values = {
        "key": key, "name": name, "kind": kind, "class": cls, "fqn": fqn, "accessibility": F.lit("Public") if accessibility is None else accessibility,
        "file_key": F.col("file_key"), "relative_path": F.col("relative_path"), "start_line": line.cast("int"), "end_line": line.cast("int"),
        "documentation": none if documentation is None else documentation, "comments": none if comments is None else comments,
        "namespace": F.col("namespace") if namespace is None else namespace, "version": none if version is None else version,
        "language": F.col("language") if language is None else language, "technology": F.col("technology") if technology is None else technology,
    }
    return rows.select(*(values[f.name].alias(f.name) for f in schemas.SYMBOL))


def as_relationships(rows: DataFrame, source: Column, target: Column, kind: Column | str) -> DataFrame:
    return rows.select(source.alias("from_key"), target.alias("to_key"), (F.lit(kind) if isinstance(kind, str) else kind).alias("rel_type"))
