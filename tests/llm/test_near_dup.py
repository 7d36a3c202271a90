import random

import numpy as np
import pyarrow as pa
import pytest

from fernweave.llm import near_dup
from fernweave.llm.components import connected_components
from fernweave.llm.superminhash import SLOTS, bands, shingles, signatures
from fernweave.llm.tokens import slices, words

SHAPE = "doc_id bigint, text string, bands string, group_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SHAPE)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def edited(rng, text, share):
    return " ".join("".join(rng.choices("xyz", k=6)) if rng.random() < share else w for w in text.split())


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute_groups(rows, threshold=near_dup.THRESHOLD):
    """Components of all pairs whose Jaccard index reaches the threshold."""
    sets = [(i, shingle_set(t)) for i, t in rows if t]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, _ in sets:
        groups.setdefault(root(i), set()).add(i)
    return {k: v for k, v in groups.items() if len(v) > 1}


def test_words_are_those_of_a_plain_split():
    texts = ["Hello, wörld  x1", None, "", "A-b\nA B", "é"]
    hashes, starts = words(pa.array(texts))
    assert np.diff(starts).tolist() == [3, 0, 0, 4, 1]
    assert hashes[3] == hashes[5] and hashes[4] == hashes[6] and len(set(hashes.tolist())) == 6
    again, _ = words(pa.array(["b", "hello"]))
    assert again.tolist() == [hashes[4], hashes[0]]
    sliced, _ = words(pa.array(texts).slice(3, 1))
    assert sliced.tolist() == hashes[3:7].tolist()
    assert list(slices(pa.array(["aaaa", "b", "c"]), 3)) == [(0, 1), (1, 3)]


def test_signature_estimates_the_jaccard_index():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        both, own = rng.integers(0, 2**63, 300, np.uint64), rng.integers(0, 2**63, (2, 100), np.uint64)
        a, b = np.concatenate([both, own[0]]), np.concatenate([both, own[1]])
        m = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        errors.append((m[0] == m[1]).mean() - 300 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(0.6 * 0.4 / SLOTS) * 1.05


def plain_superminhash(elements, slots):
    """The published loop, element by element, over the same draws."""
    from fernweave.llm.superminhash import _GOLDEN
    from fernweave.llm.tokens import mix

    least = [2**64 - 1] * slots
    for e in elements:
        p = list(range(slots))
        for j in range(slots):
            draw = int(mix(np.array([e], np.uint64) + np.uint64((j + 1) * _GOLDEN & (2**64 - 1)))[0])
            k = j + ((draw & 0xFFFF) * (slots - j) >> 16)
            p[j], p[k] = p[k], p[j]
            least[p[j]] = min(least[p[j]], (j << 48) + (draw >> 16))
    return least


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300])
def test_early_stopping_changes_nothing(n):
    e = np.random.default_rng(n).integers(0, 2**63, n, np.uint64)
    m = signatures(np.concatenate([e, e[:1]]), np.array([0, n, n, n + 1]), 32)
    assert m[0].tolist() == plain_superminhash(e, 32)
    assert (m[1] == np.uint64(2**64 - 1)).all()
    assert m[2].tolist() == plain_superminhash(e[:1], 32)
    assert bands(m, 4).shape == (3, 8)


def test_shingles_of_short_texts():
    hashes, starts = words(pa.array(["a b", "a b c d", ""]))
    found, at = shingles(hashes, starts, 3)
    assert np.diff(at).tolist() == [1, 2, 0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (4, 9), (9, 10), (10, 11), (11, 12), (2, 1)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, 10: 4, 11: 4, 12: 4, 7: 7}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)]
    random.Random(3).shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8))
    assert {r.root for r in found.collect()} == {0} and found.count() == 201


def test_groups_match_brute_force(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for size, share in [(1, 0)] * 30 + [(2, 0), (3, 0.02), (6, 0.05), (4, 0.08), (12, 0.04)]:
        base = sentence(rng, rng.randint(30, 200))
        for k in range(size):
            rows.append((n, base if k == 0 else edited(rng, base, share)))
            n += 1
    rng.shuffle(rows)
    found = {}
    for r in near_dup.near_duplicates(table(spark, rows)).collect():
        found.setdefault(r.group_id, set()).add(r.doc_id)
        assert r.kept == (r.doc_id == r.group_id)
    exact = brute_groups(rows)
    pairs = lambda g: {(a, b) for v in g.values() for a in v for b in v if a < b}
    assert pairs(found) <= pairs(exact) and len(pairs(found)) >= 0.9 * len(pairs(exact))


def test_edges_of_the_input(spark):
    long = sentence(random.Random(1), 60_000)
    rows = [(1, None), (2, ""), (3, " .. "), (4, "one two"), (5, "One, two!"), (6, "one"), (None, "one two"), (8, long), (9, long + " end"), (10, "a b c d e f"), (10, "a b c d e f"), (11, "A b c d e f"), (12, "z")]
    found = {r.doc_id: r.group_id for r in near_dup.near_duplicates(table(spark, rows)).collect()}
    assert found == {4: 4, 5: 4, 8: 8, 9: 8, 10: 10, 11: 10}
    left = near_dup.drop_near_duplicates(table(spark, rows))
    assert left.columns == ["doc_id", "text", "bands", "group_id"]
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 8, 10, 12] and left.where("doc_id is null").count() == 1


def test_one_id_with_two_texts_is_one_document(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (3, "v w x y z")]
    assert {(r.doc_id, r.group_id) for r in near_dup.near_duplicates(table(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_near_copies_of_one_of_several_texts(spark):
    rng = random.Random(11)
    a, b, c = (sentence(rng, 100) for _ in range(3))
    near = lambda x: " ".join(x.split()[:-2] + ["new", "end"])
    rows = [(5, a), (5, b), (5, c), (2, near(a)), (7, near(b)), (9, sentence(rng, 100))]
    assert {(r.doc_id, r.group_id) for r in near_dup.near_duplicates(table(spark, rows)).collect()} == {(2, 2), (5, 2), (7, 2)}
    assert near_dup.near_duplicates(table(spark, [(1, a), (1, near(a)), (2, b)])).count() == 0


def test_empty_table(spark):
    assert near_dup.near_duplicates(table(spark, [])).count() == 0
    assert near_dup.drop_near_duplicates(table(spark, [])).count() == 0


def test_ids_that_are_strings_and_small_blocks(spark):
    rng = random.Random(11)
    texts = [sentence(rng, 60) for _ in range(4)]
    rows = [(f"d{k:03d}", t if k % 3 else edited(rng, t, 0.03)) for k, t in enumerate(texts * 6)] + [("z", None), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r.doc_id: (r.group_id, r.kept) for r in near_dup.near_duplicates(docs, block=2).collect()}
    number = {i: n for n, (i, _) in enumerate(sorted(r for r in rows if r[0]))}
    numbered = spark.createDataFrame([(number[i], t) for i, t in rows if i], "doc_id bigint, text string")
    want = {r.doc_id: (r.group_id, r.kept) for r in near_dup.near_duplicates(numbered).collect()}
    assert {number[i]: (number[g], k) for i, (g, k) in found.items()} == want and len(want) == 24
