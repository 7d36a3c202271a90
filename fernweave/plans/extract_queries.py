"""Extractors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_extract, tree_extract
from .query import query, table


def _style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style sheet of each page as a file, with a line end after each rule."""
    style = F.replace(F.regexp_extract("html", "<style>(.*?)</style>", 1), F.lit("}"), F.lit("}\n"))
    pages = table(spark, sf_dir, "pages")
    sheet = F.concat(style, F.lit("@media x{ .a{b:c} }\n#p"), F.col("page_id").cast("string"), F.lit(" h1{x:y}"))
    return pages.select("page_id", F.concat(F.lit("page/"), "page_id", F.lit(".css")).alias("file_key"), F.col("url").alias("relative_path"), F.lit("page").alias("namespace"), F.lit("css").alias("language"), F.lit("web").alias("technology"), sheet.alias("content"))


_SHEETS = """sheets AS (
  SELECT page_id, 'page/' || page_id || '.css' AS file_key,
         replace(regexp_extract(html, '<style>(.*?)</style>', 1), '}', '}' || chr(10)) || '@media x{ .a{b:c} }' || chr(10) || '#p' || page_id || ' h1{x:y}' AS content FROM pages)"""
_SELECTORS = rf"""WITH {_SHEETS},
cut AS (SELECT page_id, file_key, regexp_extract_all(content, '[^{{]+\{{') AS found FROM sheets),
each AS (SELECT page_id, file_key, unnest(found) AS found, unnest(generate_series(1, len(found))) AS pos FROM cut),
lined AS (
  SELECT page_id, file_key, regexp_replace(regexp_replace(found, '\s*\{{$', ''), '^\s+|\s+$', '', 'g') AS name,
         (coalesce(sum(length(found) - length(replace(found, chr(10), ''))) OVER (PARTITION BY file_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INTEGER AS start_line
  FROM each),
symbols AS (SELECT *, file_key || ':CssSelector:' || name || ':' || start_line AS key FROM lined WHERE name <> '' AND name NOT LIKE '@%')"""


@query(f"{_SELECTORS} SELECT key, name, file_key, start_line FROM symbols")
def css_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, _ = text_extract.css(_style_files(spark, sf_dir), "Private")
    return symbols.select("key", "name", "file_key", "start_line")


@query(f"{_SELECTORS} SELECT file_key, count(DISTINCT key) AS selectors, max(start_line) AS last_line FROM symbols GROUP BY file_key")
def page_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which selectors each page declares: extraction, keyed dedup, the declaring join, a count."""
    files = _style_files(spark, sf_dir)
    symbols, _ = text_extract.css(files, "Private")
    one = symbols.groupBy("key", "file_key").agg(F.max("start_line").alias("start_line"))
    declared = one.join(files.select("file_key"), "file_key")
    return declared.groupBy("file_key").agg(F.count("*").alias("selectors"), F.max("start_line").alias("last_line"))


_HREF = r"(?i)href=['\"](.*?)['\"]"


@query(r"""WITH cut AS (SELECT page_id, regexp_extract_all(html, '(?i)href=[''"](.*?)[''"]', 1) AS found FROM pages)
SELECT page_id, unnest(generate_series(0, len(found) - 1)) AS pos, unnest(found) AS name FROM cut""")
def html_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    return text_extract.matches(pages, _HREF, by="page_id").select("page_id", F.col("at").cast("bigint").alias("pos"), F.col("value").alias("name"))


@query("""WITH cut AS (SELECT page_id, regexp_replace(html, '<div class="', '<div id="', 'g') AS html FROM pages),
found AS (SELECT page_id, regexp_extract_all(html, '(?i)id=[''"](.*?)[''"]', 1) AS ids FROM cut)
SELECT page_id, count(*) AS n, min(name) AS first_name FROM (SELECT page_id, unnest(ids) AS name FROM found) GROUP BY page_id""")
def html_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, after classes of divs were made ids; also those inside other attribute names."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", '<div class="', '<div id="').alias("content"))
    found = text_extract.matches(pages, text_extract.HTML_ID, by="page_id")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.min("value").alias("first_name"))


@query("""SELECT event_id, unnest(['props', 'props.k', 'tags']) AS fqn, unnest(['event/' || event_id || ':JsonProperty:props', 'event/' || event_id || ':JsonProperty:props.k', 'event/' || event_id || ':JsonProperty:tags']) AS key,
       unnest(['props', 'k', 'tags']) AS name FROM events
UNION ALL SELECT event_id, 'tags[1].t', 'event/' || event_id || ':JsonProperty:tags[1].t', 't' FROM events""")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit('{"props": '), "props", F.lit(', "tags": [1, {"t": null}]}'))
    events = table(spark, sf_dir, "events")
    files = events.select(F.concat(F.lit("event/"), "event_id").alias("file_key"), F.lit("").alias("relative_path"), F.lit("").alias("namespace"), F.lit("json").alias("language"), F.lit("json").alias("technology"), content.alias("content"))
    symbols, _ = tree_extract.extract(files, "json", "Private")
    return symbols.select(F.substring("file_key", 7, 100).cast("bigint").alias("event_id"), "fqn", "key", "name")


@query("""SELECT 'pubspec/' || p_partkey AS file_key, unnest(['pkg:' || replace(p_name, ' ', '_'), 'pkg:flutter', 'pkg:sdk', 'pkg:lints']) AS key,
       unnest(['^' || p_size || '.0.0', NULL, 'flutter', 'any']) AS version FROM part""")
def pubspec_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("name: app\nenvironment:\n  sdk: '>=3.0.0 <4.0.0'\ndependencies:\n  "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(": ^"), "p_size",
        F.lit(".0.0\n  flutter:\n    sdk: flutter\nflutter:\n  uses: x\ndev_dependencies:\r\n  lints: any\r\n"),
    )
    parts = table(spark, sf_dir, "part")
    files = parts.select(F.concat(F.lit("pubspec/"), "p_partkey").alias("file_key"), F.lit("").alias("relative_path"), F.lit("").alias("namespace"), F.lit("yaml").alias("language"), F.lit("flutter").alias("technology"), text.alias("content"))
    symbols, _ = tree_extract.extract(files, "pubspec")
    return symbols.select("file_key", "key", "version")


@query("""SELECT 'npm/' || p_partkey AS file_key, unnest(['pkg:' || p_name, 'pkg:dev']) AS key, unnest([p_name || ' (' || p_size || ')', 'dev (1)']) AS fqn FROM part""")
def npm_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"devDependencies": {"dev": "1"}, "dependencies": {"'), "p_name", F.lit('": "'), "p_size", F.lit('"}}'))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("npm/"), "p_partkey").alias("file_key"), F.lit("").alias("relative_path"), F.lit("").alias("namespace"), F.lit("json").alias("language"), F.lit("node").alias("technology"), text.alias("content"))
    symbols, _ = tree_extract.extract(files, "npm")
    return symbols.select("file_key", "key", "fqn")


@query("""SELECT 'xml/' || p_partkey AS file_key, unnest(['XmlElement', 'XmlElement', 'XmlAttribute']) AS kind, unnest(['part', 'size', 'value']) AS name, unnest([1, 2, 2])::INTEGER AS start_line,
       unnest([NULL, NULL, p_size::VARCHAR]) AS documentation FROM part""")
def xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<part>\n<size value='"), "p_size", F.lit("'/></part>"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("xml/"), "p_partkey").alias("file_key"), F.lit("").alias("relative_path"), F.lit("").alias("namespace"), F.lit("xml").alias("language"), F.lit("xml").alias("technology"), text.alias("content"))
    symbols, _ = tree_extract.extract(files, "xml")
    return symbols.select("file_key", "kind", "name", "start_line", "documentation")
