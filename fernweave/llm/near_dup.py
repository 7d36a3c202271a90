"""Operator 4: near duplicates by SuperMinHash, banding, verification and union-find.

1. One pass over all texts makes a SuperMinHash signature of the word 3-shingles of each
   document and a 128-bit hash of its words.  Documents with the same words are one
   candidate from here on.
2. The bands of a signature are its bucket keys.  Each member of a bucket is paired with
   the least id in it; the pairs are verified by the exact Jaccard index of their shingle
   sets.  Then every pair of one bucket whose ends are still in different groups is
   verified too, so the outcome is that of verifying all pairs of every bucket, without
   the quadratic work inside groups that already hang together.  Pairs whose sizes rule
   them out are never fetched, and a large bucket is paired block by block, in many tasks.
   The shingles of a set are their 64-bit hashes.
3. Groups are the connected components of the verified pairs: union-find inside each
   partition, then alternating large-star and small-star rounds across partitions.

Defined cases: a null doc_id takes no part.  A text that is null, empty or without words
has no shingles and is never grouped.  A text of fewer than three words is one shingle.
Rows that share a doc_id are one document, with the union of their matches: texts are
compared row by row, as (doc_id, part) with a part for each of its unlike texts.  Ties are
settled by the least doc_id, which is the one kept.  A doc_id may be a string or any other
type that has an order; group_id is of its type.  Very long texts are read whole.  An empty table gives no rows.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .cut import cut
from .superminhash import SLOTS, bands, shingles, signatures
from .tokens import mix, slices, words

THRESHOLD, WIDTH, ROWS = 0.55, 3, 4
#: Members of a bucket that one task pairs with all of the bucket.
BLOCK = 2000
_SLICE = 2_000_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _word_sums(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each text's sequence of words."""
    place = (np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.uint64)
    out = []
    for odd in _ODD:
        each = mix(hashes + (place + np.uint64(1)) * np.uint64(odd))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
        out.append((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64))
    return out


def _sign(width: int, slots: int, rows: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts, _SLICE):
                hashes, starts = words(texts.slice(low, high - low))
                some = np.flatnonzero(np.diff(starts))
                if not len(some):
                    continue
                first, second = _word_sums(hashes, starts)
                keys = bands(signatures(*shingles(hashes, starts, width), slots), rows)[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low).take(pa.array(some)),
                        pa.array(first[some]),
                        pa.array(second[some]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "w1", "w2", "bands"],
                )

    return run


def _shingle_sets(width: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts, _SLICE):
                hashes, starts = words(texts.slice(low, high - low))
                sums = [pa.array(w) for w in _word_sums(hashes, starts)]
                elements, at = shingles(hashes, starts, width)
                small = elements
                order = np.lexsort([small, np.repeat(np.arange(high - low), np.diff(at))])
                small, doc = small[order], np.repeat(np.arange(high - low), np.diff(at))
                first = np.ones(len(small), bool)
                first[1:] = (small[1:] != small[:-1]) | (doc[1:] != doc[:-1])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=high - low))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), *sums, pa.ListArray.from_arrays(pa.array(ends), pa.array(small[first].view(np.int64)))], ["doc_id", "w1", "w2", "shingles"]
                )

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have a Jaccard index of the threshold at least."""
    left = sets.select(F.col("text").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("text").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    size_a, size_b = F.size("sa"), F.size("sb")
    fits = F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)
    found = pairs.join(left, "a").join(right, "b").where(fits)
    return found.where(shared >= threshold * (size_a + size_b - shared)).select("a", "b")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, slots: int = SLOTS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, group_id, kept) for every document in a group of two or more; group_id is the group's least doc_id."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    key_type = texts.schema["doc_id"].dataType.simpleString()
    signed = cut(texts.mapInArrow(_sign(width, slots, rows), f"doc_id {key_type}, w1 bigint, w2 bigint, bands array<bigint>"))

    first = signed.groupBy("w1", "w2").agg(F.min("doc_id").alias("b"), F.count("*").alias("n"))
    copies = signed.select("doc_id", "w1", "w2").join(first.where("n > 1"), ["w1", "w2"]).where("doc_id <> b")
    copies = copies.select(F.col("doc_id").alias("a"), "b")
    part = (F.expr("row_number() over (partition by b order by w1, w2)") - 1).alias("part")
    parts = cut(first.select(F.col("b").alias("doc_id"), "w1", "w2", part))
    sole = signed.join(parts, ["doc_id", "w1", "w2"])
    members = sole.select(F.struct("doc_id", "part").alias("text"), F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")  # numbers only, of which most buckets have one
    buckets = cut(members.join(several.select("bucket"), "bucket", "left_semi").select("text", "bucket"))
    least = buckets.groupBy("bucket").agg(F.min("text").alias("least"))

    ids = parts.join(buckets.select("text.*").distinct(), ["doc_id", "part"], "left_semi")
    shape = f"doc_id {key_type}, w1 bigint, w2 bigint, shingles array<bigint>"
    sets = texts.join(ids, "doc_id", "left_semi").mapInArrow(_shingle_sets(width), shape).join(ids, ["doc_id", "w1", "w2"])
    sets = cut(sets.groupBy("doc_id", "w1", "w2", "part").agg(F.first("shingles").alias("shingles")).select(F.struct("doc_id", "part").alias("text"), "shingles", F.size("shingles").alias("n")))
    near = buckets.join(least, "bucket").where("text.doc_id <> least.doc_id").select(F.col("text").alias("a"), F.col("least").alias("b")).distinct()
    near = cut(_verified(near, sets, threshold))

    groups = cut(connected_components(near.select("a.doc_id", "b.doc_id").toDF("a", "b")))
    placed = buckets.select("bucket", "text", F.col("text.doc_id").alias("doc_id")).join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.select("bucket", "text", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("low <> high")
    placed = cut(placed.join(open_.select("bucket", "blocks"), "bucket").join(sets.select("text", "n"), "text"))
    x = placed.withColumn("block", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int")).alias("x")
    y = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    fits = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block"))
    rest = x.join(y, same & (F.col("x.root") != F.col("y.root")) & (F.col("x.doc_id") < F.col("y.doc_id")) & fits)
    rest = rest.select(F.col("x.text").alias("b"), F.col("y.text").alias("a")).distinct().join(near, ["a", "b"], "left_anti")
    rest = _verified(rest, sets, threshold).select("a.doc_id", "b.doc_id").toDF("a", "b")

    links = copies.unionByName(groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).unionByName(rest)
    found = connected_components(links)
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents without those near_duplicates() marks as not kept; a repeated doc_id keeps the row of its least text."""
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = cut(again)
    if again.isEmpty():
        return left
    order = F.row_number().over(_by_text())
    several = left.join(again, "doc_id", "left_semi").select(*docs.columns)
    numbered = several.select(F.struct(*several.columns).alias("row")).withColumn("n", order)
    one = numbered.where("n = 1").select("row.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def _by_text():
    from pyspark.sql import Window

    return Window.partitionBy("row.doc_id").orderBy("row.text")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
