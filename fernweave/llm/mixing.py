"""Operator 7: mixing sources to target weights by Poisson replication.

The target share of a source over its present share of the characters is its mean
repetition rate.  Each document gets a count from the Poisson distribution of that mean,
by inversion of a uniform number made from the MD5 of a seed and its doc_id: the count is
the number of values of the cumulative distribution that do not exceed it.  Documents are
exploded by their counts and spread by a second hash: each partition takes an equal part
of its range and sorts it, so that the order of the output, partitions one after another,
is a random permutation fixed by the seed, whatever the number of partitions.

Without given weights the target is tempered: a source's share is proportional to its
present size to the power ALPHA.

Defined cases: a null source is a source of its own.  A source without characters, or with
weight 0 or none among given weights, has rate 0 and no copies.  A null doc_id draws by
the MD5 of its text; repeated rows of one doc_id draw alike.  A null text counts 0
characters.  Very long texts are read whole.  Copies that tie in mix_key follow by doc_id,
then copy_no; rows that tie in all three come in any order.  An empty table gives no rows.  The added columns copy_no and mix_key get
trailing underscores where the input has such names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cut import cut
from .matching import fresh

ALPHA, SEED = 0.5, "fernweave"
#: Numbers in the distributions of all sources that are broadcast (8 bytes each); more of them are joined by a shuffle.
BROADCAST_NUMBERS = 1_000_000
_UNIT = float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, n_chars, rate), a row for each source that documents have."""
    sizes = docs.groupBy(F.col("source").alias("source")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n_chars").cast("double"), F.lit(float(alpha))))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        sizes = sizes.join(given, F.col("source").cast("string").eqNullSafe(F.col("name")), "left").drop("name")
        sizes = sizes.withColumn("weight", F.when(F.col("n_chars") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    totals = sizes.agg(F.sum("n_chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rated = sizes.crossJoin(F.broadcast(totals))  # one row
    rate = F.when((F.col("n_chars") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("n_chars"))
    return rated.select("source", "n_chars", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _distributions(rates: DataFrame) -> DataFrame:
    """(mix_source, cdf): the cumulative Poisson distribution of each source, until it is 1 in double precision."""
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    terms = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log(F.col("rate") / F.col("k")))
    terms = terms.withColumn("p", F.exp(F.sum(factor).over(upto)))
    terms = terms.withColumn("c", F.sum("p").over(upto))
    return terms.groupBy(F.col("source").alias("mix_source")).agg(F.sort_array(F.collect_list("c")).alias("cdf"))


def _uniform(key, what: str):
    """A number in [0, 1) from the MD5 of seed, purpose and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:{what}:"), key)), 1, 13), 16, 10).cast("bigint")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Every document as often as drawn, with copy_no from 0 and mix_key, by which the output is spread and sorted."""
    table = cut(_distributions(source_rates(docs, weights, alpha)))
    small = (table.agg(F.sum(F.size("cdf") + 8)).first()[0] or 0) <= BROADCAST_NUMBERS
    copy_no, mix_key = fresh("copy_no", docs.columns), fresh("mix_key", docs.columns)
    names = [fresh(x, [*docs.columns, copy_no, mix_key]) for x in ("mix_source", "cdf", "mix_draw")]
    table = table.toDF(*names[:2])
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    joined = docs.join(F.broadcast(table) if small else table, docs["source"].eqNullSafe(table[names[0]]))
    drawn = joined.withColumn(names[2], _uniform(key, "draw") / F.lit(_UNIT))
    count = F.expr(f"size(filter(`{names[1]}`, c -> c <= `{names[2]}`))")
    copies = drawn.withColumn(names[2], count).where(F.col(names[2]) > 0)
    copies = copies.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(names[2]) - 1)).alias(copy_no))
    spread = copies.withColumn(mix_key, _uniform(F.concat(key, F.lit(":"), F.col(copy_no).cast("string")), "order"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each takes an equal part of the keys' range, in order
    width = -(-int(_UNIT) // parts)
    return spread.repartitionById(parts, F.expr(f"cast(`{mix_key}` div {width} as int)")).sortWithinPartitions(mix_key, "doc_id", copy_no)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = f"""
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS n, pow(coalesce(sum(length(text)), 0)::DOUBLE, {ALPHA}) AS w
  FROM documents GROUP BY source),
rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM sizes WHERE n > 0),
terms AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT)) AS k FROM rates),
logs AS (SELECT source, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END AS f FROM terms),
mass AS (SELECT source, k, exp(sum(f) OVER (PARTITION BY source ORDER BY k)) AS p FROM logs),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass),
drawn AS (
  SELECT *, ('0x' || substr(md5('{SEED}:draw:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n FROM drawn d),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(0, n - 1)) AS copy_no FROM counted WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
       ('0x' || substr(md5('{SEED}:order:' || doc_id::VARCHAR || ':' || copy_no::VARCHAR), 1, 13))::BIGINT AS mix_key
FROM copies
"""
