"""Operator 6: quality rules with adaptive thresholds.

Four rates, in thousandths, are measured on each text: symbols, capitals, words said
before and sentences said before.  Additions to the denominators keep very short texts
near 0.  For each language and source a quantile sketch of each rate is kept: counts in
logarithmic buckets of ratio GAMMA (DDSketch), which merge by addition.  The fence of a
rate comes from the sketch alone.  Where the sketch falls apart into two classes, so that
the best split between buckets explains APART of the variance, the fence is half way across
that split; what lies below is tried once more, as two sorts of rejects may lie above.  The
fence is never below the third quartile plus FENCE times the interquartile range, which
stands alone in a group that does not fall apart.  One that neither falls apart nor varies
between its quartiles has no fence.  A group's sketch is smoothed by that of its language, which
counts as PRIOR documents more, whatever the sizes of the two.  Documents are joined with
the fences of their group; those beyond one go.

Defined cases: a null or blank text is rejected.  Null languages and sources are groups of
their own.  doc_id may be null or repeated; rows are judged one by one, so equal rows fare
alike.  Values that tie with a fence stay, and so do all of a group without any spread.
Very long texts are read whole.  An empty table gives an empty table.  All
columns of the input come back as they were; added names avoid those of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cut import cut
from .matching import fresh

GAMMA, FENCE, APART, PRIOR = 1.02, 3, 0.9, 100
#: Groups whose fences are broadcast; with more of them they are joined by a shuffle.
BROADCAST_GROUPS = 50_000
RATES = ("symbols", "capitals", "same_words", "same_sentences")
_SYMBOLS = r"[!#$%&*+<=>@\\^_`{|}~/\[\]]+"
_CAPITALS = "[A-ZÀ-ÖØ-Þ]+"


def rates(text: Column) -> dict[str, Column]:
    """The rates of a text, as whole thousandths; 0 for a null."""
    n = F.length(text)
    words = F.filter(F.split(F.lower(text), r"[ \n]+"), lambda x: x != "")
    sentences = F.filter(F.split(text, r"[.!?\n]+ *"), lambda x: x != "")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.floor(F.lit(1000) * part / whole).cast("int"), F.lit(0))

    return {
        "symbols": share(n - F.length(F.regexp_replace(text, _SYMBOLS, "")), n + 50),
        "capitals": share(n - F.length(F.regexp_replace(text, _CAPITALS, "")), n + 100),
        "same_words": share(F.size(words) - F.size(F.array_distinct(words)), F.size(words) + 20),
        "same_sentences": share(F.size(sentences) - F.size(F.array_distinct(sentences)), F.size(sentences) + 5),
    }


def sketches(docs: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): the quantile sketch of each rate in each group.  Sketches merge by summing n."""
    measured = docs.select("lang", "source", F.array(*(c.alias(k) for k, c in rates(F.col("text")).items())).alias("values"))
    bucket = F.ceil(F.log(F.col("value") + 1.0) / F.log(F.lit(GAMMA))).cast("int")
    names = F.array(*(F.lit(k) for k in RATES))
    each = measured.select("lang", "source", F.posexplode("values").alias("at", "value"))
    counted = each.groupBy("lang", "source", "at", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counted.select("lang", "source", F.element_at(names, F.col("at") + 1).alias("rate"), "bucket", "n")


def _splits(rows: DataFrame, of: str) -> DataFrame:
    """rows (g, v, w) with split and apart: where each group falls apart best, and the share of the variance which that explains."""
    group = Window.partitionBy("g")
    upto = group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    here = F.col(of)  # rows that are not of it weigh nothing
    w, v = F.when(here, F.col("w")).otherwise(0.0), F.col("v")
    sums = rows.withColumns({"w0": F.sum(w).over(upto), "w9": F.sum(w).over(group), "s0": F.sum(w * v).over(upto), "s9": F.sum(w * v).over(group), "q9": F.sum(w * v * v).over(group)})
    sums = sums.withColumn("next", F.lead("v").over(group.orderBy("v")))
    d = F.try_divide
    mean, share = d("s9", "w9"), d("w0", "w9")
    between = F.pow(d("s0", "w0") - d(F.col("s9") - F.col("s0"), F.col("w9") - F.col("w0")), F.lit(2.0)) * share * (1 - share)
    apart = F.round(d(between, d("q9", "w9") - mean * mean), 6)
    best = F.max(F.when(here & (F.col("w9") > F.col("w0")), F.struct(apart.alias("apart"), "v", ((F.col("v") + F.col("next")) / 2).alias("at")))).over(group)
    return sums.select(*rows.columns, F.when(best["apart"] >= APART, best["at"]).alias("split"))


def thresholds(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, symbols, capitals, same_words, same_sentences): the fences of each group; null for none."""
    sketch = cut(sketches(docs))
    own = sketch.groupBy("lang", "source", "rate").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    by_lang = sketch.groupBy(F.col("lang").alias("l"), F.col("rate").alias("r"), "bucket").agg(F.sum("n").alias("m")).withColumn("docs", F.sum("m").over(Window.partitionBy("l", "r")))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r")))
    # integers, so that the order of adding up does not matter: own counts times the language's documents, and prior times the language's counts
    weight = F.coalesce(F.try_element_at("counts", F.col("bucket")), F.lit(0)).cast("double") * F.col("docs") + F.col("m") * F.lit(float(prior))
    value = F.round(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (GAMMA + 1) - 1)
    rows = joined.select(F.struct("lang", "source", "rate").alias("g"), value.alias("v"), weight.alias("w")).groupBy("g", "v").agg(F.sum("w").alias("w")).where("w > 0")
    once = _splits(rows.withColumn("all", F.lit(True)), "all").withColumnRenamed("split", "first")
    twice = _splits(once.withColumn("below", F.coalesce(F.col("v") < F.col("first"), F.lit(False))), "below").withColumnRenamed("split", "second")
    group = Window.partitionBy("g")
    ranked = twice.withColumns({"upto": F.sum("w").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(group)})

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("total") * F.lit(q), F.col("v")))

    spread = ranked.groupBy("g").agg(F.max(F.coalesce("second", "first")).alias("split"), quantile(0.25).alias("low"), quantile(0.75).alias("high"))
    tail = F.col("high") + FENCE * (F.col("high") - F.col("low"))
    fence = F.when((F.col("high") > F.col("low")) | F.col("split").isNotNull(), F.greatest("split", tail))
    return spread.groupBy("g.lang", "g.source").agg(*(F.max(F.when(F.col("g.rate") == k, fence)).alias(k) for k in RATES))


def keep_good(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The documents, in all their columns, that no rule rejects."""
    table = cut(thresholds(docs, prior))
    small = table.count() <= BROADCAST_GROUPS
    names = {c: fresh(f"fence_{c}", docs.columns) for c in table.columns}
    table = table.toDF(*names.values())
    joined = docs.join(F.broadcast(table) if small else table, docs["lang"].eqNullSafe(table[names["lang"]]) & docs["source"].eqNullSafe(table[names["source"]]))
    good = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    for k, rate in rates(F.col("text")).items():
        good = good & F.coalesce(rate <= F.col(names[k]), F.lit(True))
    return joined.where(good).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_good(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    def splits(rows: str, here: str, name: str) -> str:
        by = "PARTITION BY lang, source, rate"
        return f"""
  SELECT * EXCLUDE (w0, w9, s0, s9, q9, next, here, apart), CASE WHEN max(apart) OVER ({by}) >= {APART} THEN first_value((v + next) / 2) OVER ({by} ORDER BY apart DESC NULLS LAST, v DESC) END AS {name}
  FROM (
    SELECT *, CASE WHEN here AND w9 > w0 THEN
      round(pow(s0 / w0 - (s9 - s0) / (w9 - w0), 2) * (w0 / w9) * (1 - w0 / w9) / (q9 / w9 - (s9 / w9) * (s9 / w9)), 6) END AS apart
    FROM (
      SELECT *, {here} AS here, sum(CASE WHEN {here} THEN w ELSE 0 END) OVER u AS w0, sum(CASE WHEN {here} THEN w ELSE 0 END) OVER g AS w9,
             sum(CASE WHEN {here} THEN w * v ELSE 0 END) OVER u AS s0, sum(CASE WHEN {here} THEN w * v ELSE 0 END) OVER g AS s9,
             sum(CASE WHEN {here} THEN w * v * v ELSE 0 END) OVER g AS q9, lead(v) OVER u AS next
      FROM {rows} WINDOW u AS ({by} ORDER BY v), g AS ({by})))"""

    words = r"list_filter(string_split_regex(lower(text), '[ \n]+'), lambda x: x <> '')"
    sentences = r"list_filter(string_split_regex(text, '[.!?\n]+ *'), lambda x: x <> '')"
    symbols = _SYMBOLS.replace("'", "''")
    return f"""
WITH parts AS (SELECT *, {words} AS ws, {sentences} AS ss FROM documents),
measured AS (
  SELECT *,
    coalesce(1000 * (length(text) - length(regexp_replace(text, '{symbols}', '', 'g'))) // (length(text) + 50), 0) AS symbols,
    coalesce(1000 * (length(text) - length(regexp_replace(text, '{_CAPITALS}', '', 'g'))) // (length(text) + 100), 0) AS capitals,
    coalesce(1000 * (len(ws) - len(list_distinct(ws))) // (len(ws) + 20), 0) AS same_words,
    coalesce(1000 * (len(ss) - len(list_distinct(ss))) // (len(ss) + 5), 0) AS same_sentences
  FROM parts),
each AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {k} AS value FROM measured" for k in RATES)}),
sketch AS (SELECT lang, source, rate, ceil(ln(value + 1.0::DOUBLE) / ln({GAMMA}::DOUBLE))::INTEGER AS bucket, count(*) AS n FROM each GROUP BY ALL),
by_lang AS (SELECT lang, rate, bucket, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY lang, rate) AS docs FROM sketch GROUP BY lang, rate, bucket),
own AS (SELECT DISTINCT lang, source, rate FROM sketch),
raw AS (
  SELECT o.lang, o.source, o.rate, round(pow({GAMMA}::DOUBLE, b.bucket) * 2 / {GAMMA + 1}::DOUBLE - 1) AS v, coalesce(s.n, 0)::DOUBLE * b.docs + b.m * {PRIOR}::DOUBLE AS w
  FROM own o JOIN by_lang b ON o.lang IS NOT DISTINCT FROM b.lang AND o.rate = b.rate
  LEFT JOIN sketch s ON s.lang IS NOT DISTINCT FROM o.lang AND s.source IS NOT DISTINCT FROM o.source AND s.rate = o.rate AND s.bucket = b.bucket),
smooth AS (SELECT lang, source, rate, v, sum(w) AS w FROM raw GROUP BY ALL HAVING sum(w) > 0),
once AS ({splits("smooth", "true", "first")}),
twice AS ({splits("once", "coalesce(v < first, false)", "second")}),
spread AS (
  SELECT lang, source, rate, max(coalesce(second, first)) AS split, min(CASE WHEN upto >= total * 0.25::DOUBLE THEN v END) AS low, min(CASE WHEN upto >= total * 0.75::DOUBLE THEN v END) AS high
  FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY v) AS upto, sum(w) OVER (PARTITION BY lang, source, rate) AS total FROM twice) GROUP BY lang, source, rate),
fences AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN rate = '{k}' AND (high > low OR split IS NOT NULL) THEN greatest(split, high + {FENCE} * (high - low)) END) AS {k}" for k in RATES)}
  FROM spread GROUP BY lang, source)
SELECT m.doc_id, m.text, m.lang, m.source, m.n_chars
FROM measured m JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
WHERE regexp_matches(m.text, '\\S') AND {" AND ".join(f"coalesce(m.{k} <= f.{k}, true)" for k in RATES)}
"""


OP6_SQL = _sql()
