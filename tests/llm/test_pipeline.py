import hashlib
import math
import random

import corpus_pipeline
from fernweave.llm import decontaminate, mixing, registry, secret_scan
from test_near_dup import brute_groups
from test_quality_and_mixing import brute_kept, prose
from test_secrets_and_leaks import brute_leaks, token

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture():
    rng = random.Random(11)
    bench = [(i, prose(rng, 30)) for i in range(4)]
    rows = [[i, prose(rng, rng.randint(30, 120)), "en", rng.choice("ab")] for i in range(120)]
    for i in range(0, 20):  # near copies of the next one
        rows[i][1] = rows[i + 20][1] + " tail"
    for i in range(50, 58):
        rows[i][1] += " " + bench[i % 4][1]
    for i in range(60, 66):
        rows[i][1] += f' key {token(seed=i)} and token = "{hashlib.sha1(str(i).encode()).hexdigest()}"'
    for i in range(70, 75):
        rows[i][1] = "junk | | " * 50
    return [tuple(r) for r in rows], bench


def brute(rows, bench):
    kept = set(brute_kept(rows, 100))
    rows = [r for r in rows if r[0] in kept]
    dropped = {i for least, group in brute_groups([(r[0], " ".join(__import__("re").findall(r"[a-z0-9]+", r[1].lower()))) for r in rows]).items() for i in group if i != least}
    rows = [r for r in rows if r[0] not in dropped and not brute_leaks(r[1], bench)]
    rows = [(i, secret_scan.redacted(t), lang, s) for i, t, lang, s in rows]
    chars = {}
    for _, t, _, s in rows:
        chars[s] = chars.get(s, 0) + len(t)
    weight = {s: n**mixing.ALPHA for s, n in chars.items()}
    out = []
    for i, t, lang, s in rows:
        rate = weight[s] / sum(weight.values()) * sum(chars.values()) / chars[s]
        u = int(hashlib.md5(f"{mixing.SEED}:draw:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [(i, t, lang, s, len(t), n) for n in range(k)]
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame([(*r, len(r[1])) for r in rows], SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted(tuple(r) for r in found.select("doc_id", "text", "lang", "source", "n_chars", "copy_no").collect())
    want = sorted(brute(rows, bench))
    assert got == want
    ids = {r[0] for r in got}
    assert not ids & {*range(50, 58), *range(70, 75)} and not ids & set(range(20, 40)) and any("[REDACTED:" in r[1] for r in got)


def test_stages_pass_documents_on(spark, sf_dir, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "source_mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shape, before = docs.schema, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert docs.schema.simpleString() == shape.simpleString() and 0 < docs.count() <= before
            before = docs.count()


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_has_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert decontaminate.MIN_WORDS >= 2 * decontaminate.SEED - 1  # so that no run is missed
