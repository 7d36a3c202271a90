import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fernweave.llm import mixing as M
from fernweave.llm import quality as Q

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy_no string, docs int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "clash", 3) for i, t, lang, source in rows], SHAPE)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(n)).capitalize()


def corpus():
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(20, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(400)]
    bad = ["x | y | z | " * 40, "AB CD!! " * 60, "same same same " * 80, "One line again.\n" * 50, None, "", " \n "]
    return rows + [(1000 + i, t, "en", "a") for i, t in enumerate(bad)]


def brute_kept(rows, prior):
    """The rules in plain Python, with quantiles from all values' bucket representatives."""
    import re

    def rate(a, b):
        return math.floor(1000 * a / b) if b else 0

    def measure(t):
        if t is None:
            return dict.fromkeys(Q.RATES, 0)
        words = [w for w in re.split(r"[ \n]+", t.lower()) if w]
        said = [s for s in re.split(r"[.!?\n]+ *", t) if s]
        return {
            "symbols": rate(sum(map(len, re.findall(Q._SYMBOLS, t))), len(t) + 50), "capitals": rate(sum(map(len, re.findall(Q._CAPITALS, t))), len(t) + 100),
            "same_words": rate(len(words) - len(set(words)), len(words) + 20), "same_sentences": rate(len(said) - len(set(said)), len(said) + 5),
        }

    def bucket(v):
        return math.ceil(math.log(v + 1.0) / math.log(Q.GAMMA))

    def value(v):
        return round(2 * Q.GAMMA ** bucket(v) / (Q.GAMMA + 1) - 1)

    measured = [(r, measure(r[1])) for r in rows]

    def split(weights):
        """(share of the variance explained, fence) of the best split; ties go to the greater values."""
        values, total = sorted(weights), sum(weights.values())
        mean = sum(v * w for v, w in weights.items()) / total
        variance = sum(w * (v - mean) ** 2 for v, w in weights.items()) / total
        best = (0, None)
        for low, high in zip(values, values[1:]):
            w0 = sum(w for v, w in weights.items() if v <= low)
            m0 = sum(v * w for v, w in weights.items() if v <= low) / w0
            m1 = sum(v * w for v, w in weights.items() if v > low) / (total - w0)
            best = max(best, (round((m0 - m1) ** 2 * w0 / total * (1 - w0 / total) / variance, 6), (low + high) / 2))
        return best

    def fence(lang, source, name):
        mine = Counter(value(m[name]) for r, m in measured if r[2:] == (lang, source))
        wide = Counter(value(m[name]) for r, m in measured if r[2] == lang)
        weights = {v: mine[v] * wide.total() + prior * n for v, n in wide.items()}
        weights = {v: w for v, w in weights.items() if w}
        at, (share, once) = None, split(weights)
        if share >= Q.APART:
            at = once
            share, twice = split({v: w for v, w in weights.items() if v < once})
            at = twice if share >= Q.APART else once
        total, upto, quartiles = sum(weights.values()), 0, []
        for v in sorted(weights):
            upto += weights[v]
            while len(quartiles) < 2 and upto >= total * (0.25, 0.75)[len(quartiles)]:
                quartiles.append(v)
        low, high = quartiles
        if at is None and low == high:
            return math.inf
        return max(high + Q.FENCE * (high - low), -1 if at is None else at)

    fences = {key: {k: fence(*key, k) for k in Q.RATES} for key in {r[2:] for r, _ in measured}}
    return [r[0] for r, m in measured if r[1] and r[1].strip() and all(m[k] <= fences[r[2:]][k] for k in Q.RATES)]


@pytest.mark.parametrize("prior", [0, 10, 100, 10_000])
def test_quality_matches_brute_force(spark, prior):
    rows = corpus()
    left = Q.keep_good(table(spark, rows), prior)
    assert left.columns == [c.split()[0] for c in SHAPE.split(", ")]
    ids = sorted(r.doc_id for r in left.select("doc_id").collect())
    assert ids == sorted(brute_kept(rows, prior))
    if prior == 100:
        assert all(i < 1000 for i in ids) and len(ids) >= 395


def test_fences_follow_a_shifted_group(spark):
    """Of two sources with the same spread, one uses three times as many capitals; each has its own rejects."""
    rng = random.Random(6)

    def text(capitals):
        return "".join(rng.choice("ABCDEF") if rng.random() < capitals else rng.choice("abcdefghij   ") for _ in range(1500))

    rows = [(i, text(0.10 + 0.02 * rng.random()), "en", "calm") for i in range(300)] + [(1000 + i, text(0.30 + 0.02 * rng.random()), "en", "loud") for i in range(300)]
    rows += [(500, text(0.30), "en", "calm"), (1500, text(0.55), "en", "loud")]
    fences = {r.source: r.capitals for r in Q.thresholds(table(spark, rows), 0).collect()}
    assert fences["calm"] < 290 and 330 < fences["loud"] < 520
    kept = {r.doc_id for r in Q.keep_good(table(spark, rows), 0).collect()}
    assert 500 not in kept and 1500 not in kept and len(kept) >= 590


def test_a_group_without_spread_has_no_fence(spark):
    rows = [(i, "same words in every row", "en", "a") for i in range(20)]
    assert Q.thresholds(table(spark, rows)).first().symbols is None and Q.keep_good(table(spark, rows)).count() == 20


def test_sketches_merge(spark):
    docs = table(spark, corpus())
    whole = {(r.rate, r.bucket): r.n for r in Q.sketches(docs).groupBy("rate", "bucket").agg(F.sum("n").alias("n")).collect()}
    halves = Q.sketches(docs.where("doc_id % 2 = 0")).unionByName(Q.sketches(docs.where("doc_id % 2 = 1")))
    assert whole == {(r.rate, r.bucket): r.n for r in halves.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).collect()}


def test_quality_edges(spark):
    assert Q.keep_good(table(spark, [])).count() == 0
    rows = [(None, "Plain words here.", None, None)] * 3 + [(1, "word " * 200_000, "en", "a"), (2, "Short.", "en", "a")]
    assert sorted(str(r.doc_id) for r in Q.keep_good(table(spark, rows)).collect()) in (["2", "None", "None", "None"], ["1", "2", "None", "None", "None"])


def test_quality_keeps_labelled_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = Q.keep_good(docs).join(labels, "doc_id").groupBy("quality").count().collect()
    kept, every = {r.quality: r["count"] for r in judged}, {r.quality: r["count"] for r in docs.join(labels, "doc_id").groupBy("quality").count().collect()}
    assert kept[1] >= 0.99 * every[1] and kept.get(0, 0) <= 0.2 * every[0]


@pytest.mark.parametrize("name, run, sql", [("op6", Q.op6_quality_rules, Q.OP6_SQL), ("op7", M.op7_mix_sources, M.OP7_SQL)])
def test_sql(spark, sf_dir, name, run, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    found = run(spark, sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(cursor.fetchall())


def test_mixing_reaches_the_weights(spark):
    rng = random.Random(5)
    rows = [(i, "t" * rng.randint(50, 150), "en", s) for i, s in enumerate(["a"] * 3000 + ["b"] * 1000 + [None] * 200)]
    docs = table(spark, rows)
    out = M.mix_sources(docs, {"a": 1, "b": 1, None: 2}).cache()
    assert out.columns == [*docs.columns, "copy_no_", "mix_key"]
    chars = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    total = docs.agg(F.sum("n_chars")).first()[0]
    for source, share in {"a": 0.25, "b": 0.25, None: 0.5}.items():
        assert abs(chars[source] / total - share) < 0.03
    counts = [r["count"] for r in out.where("source is null").groupBy("doc_id").count().collect()]
    rate = {r.source: r.rate for r in M.source_rates(docs, {"a": 1, "b": 1, None: 2}).collect()}[None]
    mean = sum(counts) / 200
    assert abs(mean - rate) < 4 * math.sqrt(rate / 200) and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, M.mix_sources(docs.repartition(3), {"a": 1, "b": 1, None: 2}).collect()), key=str)
    first = [r.doc_id for r in out.limit(200).collect()]
    assert sum(a < b for a, b in zip(first, first[1:])) < 150  # no longer in order


def test_counts_invert_the_distribution(spark):
    import hashlib

    rates = {r.source: r.rate for r in M.source_rates(table(spark, [(i, "x" * 100, "en", "ab"[i % 3 > 0]) for i in range(300)])).collect()}
    rows = [(i, "x" * 100, "en", "ab"[i % 3 > 0]) for i in range(300)]
    got = {r.doc_id: r["count"] for r in M.mix_sources(table(spark, rows)).groupBy("doc_id").count().collect()}
    for i, _, _, s in rows:
        u = int(hashlib.md5(f"{M.SEED}:draw:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rates[s])
        c = p
        while c <= u:
            k += 1
            p *= rates[s] / k
            c += p
        assert got.get(i, 0) == k


def test_mixing_edges(spark):
    assert M.mix_sources(table(spark, [])).count() == 0
    rows = [(None, "some text", "en", "a"), (None, "some text", "en", "a"), (2, None, "en", "void"), (3, "", "en", "void"), (4, "y" * 500_000, "en", "b")]
    out = [(r.doc_id, r.source) for r in M.mix_sources(table(spark, rows)).collect()]
    assert all(s != "void" for _, s in out) and sum(s == "a" for _, s in out) % 2 == 0
    assert M.mix_sources(table(spark, rows), {"a": 0}).count() == 0
    assert M.mix_sources(table(spark, rows), {"b": 1}).where("source = 'a'").count() == 0


def test_order_of_the_mix_does_not_follow_the_partitions(spark):
    rows = [(i, f"text {i}", "en", "ab"[i % 2]) for i in range(300)]
    orders = []
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        mixed = M.mix_sources(table(spark, rows))
        pieces = mixed.withColumn("part", F.spark_partition_id()).collect()
        assert [r.part for r in pieces] == sorted(r.part for r in pieces)
        orders.append([(r.doc_id, r.mix_key) for r in pieces])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert orders[0] == orders[1] and [k for _, k in orders[0]] == sorted(k for _, k in orders[0])
