"""Operator 2: substring dedup by runs of sentences.

A text is cut into pieces at full stops, question and exclamation marks and line ends; the
pieces put together are the text.  Pieces that are not blank, trimmed and in lower case,
are its sentences.  Every run of RUN consecutive sentences with MIN_CHARS characters or
more is hashed (96 bits) and joined globally.  The first occurrence of a run, by doc_id,
then text hash, then position, stays; the sentences of any later occurrence are repeated,
also within one document.  A span is a longest stretch of repeated sentences; one of
MIN_WORDS words or more is removed, a shorter one (a menu, a greeting) stays.

Spread: the runs are counted by their hashes alone, with map-side combining; only those
that occur twice or more meet the texts' runs again, and AQE can split the partition of a
run that occurs in very many documents.  What follows goes by document.

Defined cases: rows with a null doc_id or a null or empty text take no part.  Rows equal
in doc_id and text are one document and give one row; rows that share a doc_id but not the
text are documents of their own.  Documents without a removed sentence give no row.  An
empty table gives no rows.  Very long texts are read whole.  Other columns are ignored,
whatever their names.  Words are counted by the blanks within a sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN, MIN_CHARS, MIN_WORDS = 2, 40, 20
_PIECE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
_BLANK = " \n\t\r"


def _pieces(text):
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _runs(docs: DataFrame, run: int, min_chars: int) -> DataFrame:
    """(doc_id, body, first, h1, h2, words): each run, with the number of its first sentence and the words of each."""
    said = F.filter(F.transform(_pieces(F.lower("text")), lambda x: F.btrim(x, F.lit(_BLANK))), lambda x: x != "")
    each = docs.select("doc_id", F.xxhash64("text").alias("body"), said.alias("said")).where(F.size("said") >= run)

    def one(i):
        keys = [F.get(F.col("said"), i + k) for k in range(run)]
        chars = sum((F.length(k) for k in keys[1:]), F.length(keys[0]))
        words = F.array(*(F.length(k) - F.length(F.replace(k, F.lit(" "), F.lit(""))) + 1 for k in keys))
        return F.struct(i.alias("first"), F.xxhash64(*keys).alias("h1"), F.hash(*keys).alias("h2"), words.alias("words"), chars.alias("chars"))

    runs = F.filter(F.transform(F.sequence(F.lit(0), F.size("said") - run), one), lambda r: r["chars"] >= min_chars)
    return each.select("doc_id", "body", F.inline(runs)).drop("chars")


def repeated_sentences(docs: DataFrame, run: int = RUN, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of each document that loses sentences; text is what stays."""
    texts = docs.select("doc_id", "text").where("doc_id is not null and text <> ''")
    runs = _runs(texts, run, min_chars)
    counted = runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where("n > 1").drop("n")
    hits = runs.join(counted, ["h1", "h2"])
    here = F.struct("body", "first")  # in the document that keeps a run, all occurrences but the first are later ones
    hits = hits.repartition("doc_id", "h1", "h2").withColumn("keep", F.min(here).over(Window.partitionBy("doc_id", "h1", "h2")))
    later = hits.where((F.col("doc_id") != F.col("owner")) | (here != F.col("keep")))
    said = later.select("doc_id", "body", "first", F.posexplode("words").alias("k", "words")).select("doc_id", "body", (F.col("first") + F.col("k")).alias("at"), "words")
    said = said.repartition("doc_id", "body").distinct()
    said = said.withColumn("span", F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "body").orderBy("at")))
    spans = said.groupBy("doc_id", "body", "span").agg(F.sum("words").alias("words"), F.min("at").alias("a"), F.max("at").alias("b")).where(F.col("words") >= min_words)
    gone = spans.groupBy("doc_id", "body").agg(F.collect_list(F.struct("a", "b")).alias("spans"), F.sum(F.col("b") - F.col("a") + 1).cast("int").alias("n_removed"))

    cut = texts.select("doc_id", F.xxhash64("text").alias("body"), "text").join(gone, ["doc_id", "body"]).dropDuplicates(["doc_id", "body"])
    parts = cut.withColumn("parts", _pieces(F.col("text")))
    parts = parts.withColumn("places", F.filter(F.transform("parts", lambda p, i: F.when(F.btrim(p, F.lit(_BLANK)) != "", i)), lambda i: i.isNotNull()))
    lost = F.flatten(F.transform("spans", lambda s: F.sequence(F.get("places", s["a"]), F.get("places", s["b"]))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), lost)
    return parts.select("doc_id", F.size("places").alias("n_sentences"), "n_removed", F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "").alias("text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECE}')) AS piece, unnest(generate_series(0, len(regexp_extract_all(text, '{_PIECE}')) - 1)) AS pos
  FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
said AS (SELECT doc_id, pos, lower(trim(piece, chr(32) || chr(10) || chr(9) || chr(13))) AS key FROM pieces),
numbered AS (SELECT doc_id, pos, key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM said WHERE key <> ''),
runs AS (
  SELECT doc_id, nth, key || {" || ".join(f"chr(31) || lead(key, {k}) OVER w" for k in range(1, RUN))} AS run
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
later AS (
  SELECT doc_id, nth FROM runs WHERE run IS NOT NULL AND length(run) - {RUN - 1} >= {MIN_CHARS}
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, nth) > 1),
repeated AS (SELECT DISTINCT doc_id, unnest(generate_series(nth, nth + {RUN - 1})) AS nth FROM later),
stretches AS (
  SELECT doc_id, nth, pos, length(key) - length(replace(key, ' ', '')) + 1 AS words, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS span
  FROM repeated JOIN numbered USING (doc_id, nth)),
spans AS (SELECT doc_id, min(pos) AS since, max(pos) AS till FROM stretches GROUP BY doc_id, span HAVING sum(words) >= {MIN_WORDS}),
gone AS (SELECT doc_id, unnest(generate_series(since, till)) AS pos FROM spans)
SELECT p.doc_id, sum((s.key <> '')::INTEGER)::INTEGER AS n_sentences, sum((s.key <> '' AND g.pos IS NOT NULL)::INTEGER)::INTEGER AS n_removed,
       coalesce(string_agg(CASE WHEN g.pos IS NULL THEN p.piece END, '' ORDER BY p.pos), '') AS text
FROM pieces p JOIN said s USING (doc_id, pos) LEFT JOIN gone g USING (doc_id, pos)
GROUP BY p.doc_id HAVING sum((g.pos IS NOT NULL)::INTEGER) > 0
"""
