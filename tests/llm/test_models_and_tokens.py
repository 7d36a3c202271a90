import math
import random

import pyarrow as pa
import pytest

from fernweave.llm import licence_scan as L
from fernweave.llm import lm_score as M
from fernweave.llm import token_counts as T
from fernweave.llm.licence_texts import PROSE, TEMPLATES

SHAPE = "doc_id bigint, text string, chunk string, n int, start string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], SHAPE)


@pytest.fixture(scope="module")
def model():
    return L.LicenceModel(["Plain words of a story about nothing in particular.", "Es war einmal ein kleines Haus am Rand der Stadt."] * 30)


def test_held_out_accuracy(model):
    assert model.held_out_accuracy > 0.7 and model.held_out_family > 0.7 and 0.5 <= model.least < 1


@pytest.mark.parametrize("text, family", [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under the Apache License, Version 2.0.", "Apache"), ("All rights reserved.", "reserved"),
    ("Released under the MIT License.", "MIT"), ("Copyright 2020 by Example Ltd. All rights reserved.", "reserved"), ("Licensed under the Example Commercial Agreement between the parties.", "unknown"),
])
def test_families(model, text, family):
    assert model.classify(text)[0] == family


def test_prose_states_no_licence(model):
    assert all(model.classify(t) is None for t in PROSE)
    assert all(model.classify(t)[0] == f for f, ts in TEMPLATES.items() for t in ts[:1])


def test_scan(spark, model):
    long = "filler text\n" * 100_000 + "Released under the MIT License."
    rows = [(1, "x\nReleased under the MIT License.\ny"), (1, "x\nReleased under the MIT License.\ny"), (None, "All rights reserved."), (2, None), (3, ""), (4, "plain"), (5, long)]
    found = L.scan_licences(table(spark, rows), model)
    assert found.columns == ["doc_id", "start", "end", "family", "probability", "overlap"]
    assert sorted((r.doc_id or 0, r.start, r.end, r.family) for r in found.collect()) == [(0, 0, 20, "reserved"), (1, 2, 33, "MIT"), (1, 2, 33, "MIT"), (5, 1_200_000, 1_200_031, "MIT")]
    assert L.scan_licences(table(spark, [])).count() == 0


def lines_of(text):
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line)
        at += len(line) + 1


def brute_statements(model, text):
    """The definition: every line classified, doubtful neighbours also as one paragraph."""
    out, run, gap = [], [], []

    def close():
        said = [(a, b, model.classify(text[a:b])) for a, b in run]
        if len(run) > 1:
            whole = model.classify(text[run[0][0] : run[-1][1]])
            if whole and whole[0] != "unknown" and all(s is None or s[0] in ("unknown", whole[0]) for _, _, s in said):
                said = [(run[0][0], run[-1][1], whole)]
        out.extend((a, b, s[0]) for a, b, s in said if s)
        run.clear()

    for a, b in lines_of(text):
        if margin(model, text[a:b]) > -L.MARGIN:
            if len(gap) > L.BRIDGE or any(not text[x:y].strip() for x, y in gap) or a == b:
                close()
            run.append((a, b))
            gap = []
        else:
            gap.append((a, b))
    close()
    return out


def margin(model, text):
    rows = model._rows_of(text)
    scores = model.weights[rows].astype(float).sum(axis=0) + model.bias.astype(float)
    return (scores[:-1] - scores[-1]).max()


def test_every_paragraph_is_classified(spark, model):
    rng = random.Random(4)
    known = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()}) + ["filler", "ΑΣ", "İx", "\n", "\n", "\n\n"]
    pieces = [*known, *("\n" + t for ts in TEMPLATES.values() for t in ts), "Released under MIT.\n", "Distributed under the Boost terms\n", "Creative-Commons Attribution 4.0\n"]
    texts = [" ".join(rng.choices(pieces if n % 2 else known, k=rng.randint(1, 80))) for n in range(300)]
    stated = {(i, a, b) for i, t in enumerate(texts) for a, b in lines_of(t) if model.classify(t[a:b]) is not None}
    found = model.doubtful(texts)
    assert len(found) == len(set(found)) and {(i, a, b) for i, a, b in found if model.classify(texts[i][a:b]) is not None} == stated
    want = sorted((i, *row) for i, t in enumerate(texts) for row in brute_statements(model, t))
    rows = L.scan_licences(table(spark, [*enumerate(texts), (900, None), (901, "")]), model).collect()
    assert sorted((r.doc_id, r.start, r.end, r.family) for r in rows) == want and len(want) > 100
    joined = {(i, a, b) for i, a, b, _ in want} - stated
    assert joined and all("\n" in texts[i][a:b] for i, a, b in joined)


@pytest.mark.parametrize("text, family", [("x\nReleased under MIT.\ny", "MIT"), ("x\nDistributed under the Boost terms", "unknown"), ("Creative-Commons Attribution 4.0\n", "CC-BY")])
def test_statements_without_an_anchor(model, text, family):
    assert [model.classify(text[a:b])[0] for i, a, b in model.doubtful([text]) if model.classify(text[a:b])] == [family]


def test_a_wrapped_notice_is_one_paragraph(spark, model):
    notice = TEMPLATES["Apache"][1].split()
    wrapped = "\n".join(" ".join(notice[k : k + 5]) for k in range(0, len(notice), 5))
    text = f"A story begins here and goes on.\n{wrapped}\nThe end of the story is near."
    found = L.scan_licences(table(spark, [(1, text)]), model).collect()
    (row,) = found  # it ends with the last line that is not surely of no licence
    assert (row.start, row.family) == (33, "Apache") and row.end > 33 + len(wrapped) // 3


def test_words_of_notices_in_other_texts_state_no_licence():
    rng = random.Random(5)
    german = [" ".join(rng.choices(["Haus", "Baum", "die", "Stadt", "der", "geht", "kleine", "Dorf"], k=12) + ["mit"] + rng.choices(["Hund", "Katze", "ihm"], k=2)) + "." for _ in range(300)]
    plain = [" ".join(rng.choices(["Haus", "Baum", "die", "Stadt", "der"], k=12)) for _ in range(900)]
    model = L.LicenceModel(plain + german[:30])
    assert all(model.classify(t) is None for t in german) and model.classify("Released under the MIT License.")[0] == "MIT"


def test_training_is_bounded_and_repeatable(spark):
    docs = table(spark, [(i, f"text number {i} of a story\nanother line") for i in range(300)])
    a, b = L.train(docs, 20), L.train(docs.repartition(5), 20)
    assert (a.weights == b.weights).all() and a.least == b.least


TOKEN_TEXTS = ["Hello  world's\n\n end   ", "", None, "日本語 テキスト 123 <|endoftext|> 🎉", "a" * 5000, "  ", "tabs\t\there\r\n", "don't Don'T"]


def encoder():
    with open(T.VOCABULARY, "rb") as file:
        return T.encoding(file.read(), T.PATTERN)


@pytest.mark.parametrize("most", [1, 3, 500_000])
def test_token_counts_match_the_tokenizer(spark, most):
    rng = random.Random(1)
    rows = list(enumerate(TOKEN_TEXTS)) + [(100 + i, " ".join(rng.choices(["the", "of", "Ümlaut", "x1", "…"], k=50))) for i in range(30)]
    rows += [(None, "null id"), (1, "repeated"), (1, "repeated")]
    found = T.token_counts(table(spark, rows), chunk_tokens=most)
    assert found.columns == ["doc_id", "n_pre_tokens", "n_tokens"]
    want = sorted((-1 if i is None else i, len(encoder().encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in found.collect()) == want


def test_token_counts_of_very_long_and_of_no_texts(spark):
    long = "word another 12 " * 200_000
    assert T.token_counts(table(spark, [(1, long)])).first().n_tokens == len(encoder().encode_ordinary(long))
    assert T.token_counts(table(spark, [])).count() == 0


def test_packing_round_trips():
    import numpy as np

    for numbers in ([], [0], [1, 2**31, 7]):
        assert T._unsqueeze(T._squeeze(np.array(numbers, np.int64))).tolist() == numbers
    for words in ([], [""], ["a", "", "é€", "\x00"]):
        assert T._unpack_words(T._pack_words(words)) == [w.encode() for w in words]


class Plain:
    """The model from its definition: counts in a dictionary, probabilities by recursion, one symbol at a time."""

    def __init__(self, texts, order, least, discount):
        self.order, self.d, self.counts = order, discount, {}
        for t in texts:
            s = M.START + (t or "") + M.END
            for i in range(1, len(s)):
                for k in range(min(order, i + 1)):
                    g = s[i - k : i + 1]
                    self.counts[g] = self.counts.get(g, 0) + 1
        self.known = {g: n for g, n in self.counts.items() if n >= least or len(g) == 1}
        self.c, self.k, self.n = {}, {}, {}
        for g, n in self.counts.items():
            h = g[:-1]
            self.c[h] = self.c.get(h, 0) + n
            if g in self.known:
                self.k[h], self.n[h] = self.k.get(h, 0) + n, self.n.get(h, 0) + 1

    def p(self, h, x):
        c = self.c.get(h, 0)
        back = (c - self.k.get(h, 0) + self.d * self.n.get(h, 0)) / c if c else 1.0
        below = 1 / (self.n.get("", 0) + 1) if not h else self.p(h[1:], x)
        return (max(self.known[h + x] - self.d, 0) / c if h + x in self.known and c else 0) + back * below

    def score(self, text):
        s, total = M.START + (text or ""), 0.0
        for i, x in enumerate((text or "") + M.END):
            total += math.log(self.p(s[max(0, i + 1 - self.order + 1) : i + 1] if self.order > 1 else "", x))
        return total


CORPUS = ["abracadabra", "abra", "cadabra abra", "", None, "zebra ä", "bra" * 10, "日本語", "日本 語"]


@pytest.mark.parametrize("order, least", [(1, 1), (2, 2), (3, 1), (5, 2), (5, 3)])
@pytest.mark.parametrize("table_size", [1, M._TABLE])
@pytest.mark.parametrize("wide", [False, True])
def test_scores_match_the_definition(monkeypatch, order, least, table_size, wide):
    """wide: with more letters than fit an integer five at a time, and texts walked in segments and slices."""
    texts = [*CORPUS, "abrax", "unseen ß", "zzz", "abra cadabra " * 9]
    corpus = [*CORPUS, *(chr(0x4E00 + i) for i in range(5000))] if wide else CORPUS
    if wide:
        monkeypatch.setattr(M, "SEGMENT", 6)
        monkeypatch.setattr(M, "_SLICE", 30)
        monkeypatch.setattr(M, "_DENSE", 1)
    plain = Plain(corpus, order, least, M.DISCOUNT)
    counts = {r["gram"]: r["n"] for r in M.ngram_counts(pa.array(corpus, pa.string()), order).to_pylist()}
    assert {g: n for g, n in counts.items() if n} == {g: n for g, n in plain.counts.items() if not g == M.START}
    stats = {g: (plain.known.get(g, 0), plain.c.get(g, 0), plain.k.get(g, 0), plain.n.get(g, 0)) for g in {*plain.known, "", M.START, *plain.c} if g in plain.known or g in ("", M.START)}
    monkeypatch.setattr(M, "_TABLE", table_size)
    sent = pa.table([pa.array(list(stats), pa.string()), *(pa.array(x, pa.int64()) for x in zip(*stats.values()))], ["gram", "n", "followed", "known", "kinds"])
    automaton = M.Automaton(sent, order, M.DISCOUNT)
    assert automaton.arc is None if table_size == 1 else wide or automaton.arc is not None
    assert automaton.score(pa.array(texts, pa.string())).tolist() == pytest.approx([plain.score(t) for t in texts], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    plain = Plain(CORPUS, 3, 2, M.DISCOUNT)
    letters = {g for g in plain.known if len(g) == 1}
    for h in ("", "a", "br", M.START):
        assert sum(plain.p(h, x) for x in letters) + plain.p(h, "never") == pytest.approx(1)


@pytest.mark.parametrize("chunk", [5, 40, 1_000_000])
def test_scores_over_tables(spark, chunk):
    rows = list(enumerate(CORPUS)) + [(None, "abra"), (0, "abracadabra")]
    plain = Plain([t for _, t in rows], 4, 2, M.DISCOUNT)
    found = M.lm_scores(table(spark, rows), order=4, chunk_chars=chunk)
    assert found.columns == ["doc_id", "n_symbols", "log_prob", "perplexity"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_symbols, round(r.log_prob, 8)) for r in found.collect())
    assert got == sorted((-1 if i is None else i, len(t or "") + 1, round(plain.score(t), 8)) for i, t in rows)


def test_scores_under_another_corpus_and_of_odd_tables(spark):
    corpus = table(spark, list(enumerate(CORPUS)))
    plain = Plain(CORPUS, M.ORDER, M.MIN_COUNT, M.DISCOUNT)
    long = "abra cadabra " * 30_000
    rows = [(1, "abba"), (2, "q\x00x"), (3, long)]
    got = {r.doc_id: r.log_prob for r in M.lm_scores(table(spark, rows), corpus).collect()}
    assert got[1] == pytest.approx(plain.score("abba")) and got[2] == pytest.approx(plain.score("q�x")) and got[3] == pytest.approx(plain.score(long))
    assert M.lm_scores(table(spark, [])).count() == 0
    assert M.lm_scores(table(spark, [(1, "ab")]), table(spark, [])).first().log_prob == pytest.approx(0.0)  # one symbol, the unknown
