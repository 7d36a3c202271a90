"""Operator 1: licence scans by a trained paragraph classifier.

A multinomial logistic regression over sparse word 1- to 3-grams is fitted on notices of
twelve licence families, on statements of other terms, and on paragraphs without any: a
bounded sample of the corpus, LINES lines of LINE_CHARS characters at most out of BACKGROUND
documents, all chosen by hash, each also with a licence word put in.  A sampled line counts
as such a paragraph if it shares less than half of OVERLAP with every notice.  Those that
the model still takes for statements are put in as further examples and the model is fitted
again, MINING times at most, as words of the notices also occur by themselves, such as the
German "mit".  The model is calibrated by cross-validation in FOLDS: a notice and all that
was made of it are held out together.  On the held-out scores a temperature is fitted, then
the least probability at which a family is believed, so that of the held-out examples of no
family at most FALSE_RATE pass, confirmed as below.  Less certain statements are of family `unknown`.  A family
that is predicted must also be confirmed: the paragraph's n-grams are compared with the
family's notices, and where the best overlap is under OVERLAP the family is `unknown`.

Paragraphs are lines, and all of them are classified.  The n-grams of many texts at a time
are looked up and their weights summed in numpy; paragraphs that `none` wins by MARGIN or
more, far beyond rounding, are done with, and the rest goes through classify().  Lines that
are not done with, and BRIDGE others at most between two of them, are also read as one
paragraph, as a notice may be wrapped; no blank line lies inside it.  Where that gives a
confirmed family, and no line states another one, it is one row instead of one for each line.

Defined cases: a null or empty text gives no rows.  A null doc_id stays null, repeated rows
repeat theirs.  Of families that tie in probability the first by name counts.  On an empty
table the model is fitted on the notices alone and the result is empty.  Very long texts
and paragraphs are read whole.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import FORMS, NAMES, OTHER, PROSE, RESERVED, TEMPLATES
from .tokens import slices

BACKGROUND, LINES, LINE_CHARS = 200, 1000, 10_000
FALSE_RATE, OVERLAP, MINING, MARGIN, FOLDS, BRIDGE = 0.02, 0.5, 4, 0.01, 4, 2
_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")
_TOKENS = re.compile(rf"\n|{_WORDS.pattern}")
_NO_WORD, _LINE_END, _SLICE = -1, -2, 1_000_000
_SEED, _STEPS, _COPIES = 20240501, 220, 24


def ngrams(text: str, most: int = 3) -> list[str]:
    words = _WORDS.findall(text.lower())
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


class LicenceModel:
    """Weights over a vocabulary of n-grams, a temperature, a least probability, and the notices' n-grams."""

    def __init__(self, background: list[str]):
        rng = np.random.default_rng(_SEED)
        self.families = sorted(TEMPLATES)
        self.classes = [*self.families, "unknown", "none"]
        self.notices = {f: [set(ngrams(t)) for t in TEMPLATES[f]] for f in self.families}
        formed = [form.format(name) for names in NAMES.values() for name in names for form in FORMS]
        terms = {g for texts in [*TEMPLATES.values(), OTHER, RESERVED, formed] for t in texts for g in ngrams(t)}
        self.vocabulary = {g: i for i, g in enumerate(sorted(terms))}
        self._index()
        plain = [p for p in background if p.strip() and self._overlap(p) < OVERLAP / 2]
        examples = self._examples(plain, rng)
        for left in reversed(range(MINING + 1)):
            self._learn(examples)
            wrong = [p for p in plain if self.classify(p) is not None] if left else []
            if not wrong:
                break
            examples = examples + [(p, "none", f"line {p}") for p in wrong for _ in range(_COPIES)]
        confirmed = np.array([[self._overlap_with(f, t) >= OVERLAP for f in self.families] for t, _, _ in examples])
        self._calibrate(*self._held_out(examples, rng), confirmed)

    def _learn(self, examples: list[tuple[str, str, str]]) -> None:
        self.weights, self.bias = self._fit([self._rows_of(t) for t, _, _ in examples], np.array([self.classes.index(c) for _, c, _ in examples]))
        self.temperature, self.least = 1.0, 0.5

    def _held_out(self, examples: list[tuple[str, str, str]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(scores, classes) of all examples, each by a model that saw nothing made of the same notice or line."""
        rows, y = [self._rows_of(t) for t, _, _ in examples], np.array([self.classes.index(c) for _, c, _ in examples])
        sources = sorted({(c, of) for _, c, of in examples})
        order = sorted(range(len(sources)), key=lambda i: (sources[i][0], rng.random()))  # the notices of a family are spread over the folds
        fold_of = {}
        for n, i in enumerate(order):
            fold_of.setdefault(sources[i][1], n % FOLDS)
        fold = np.array([fold_of[of] for _, _, of in examples])
        scores = np.zeros((len(examples), len(self.classes)))
        for k in range(FOLDS):
            seen, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            weights, bias = self._fit([rows[i] for i in seen], y[seen])
            for i in held:
                scores[i] = weights[rows[i]].sum(axis=0) + bias
        return scores, y

    def _overlap(self, text: str) -> float:
        """The best overlap of a text with any notice."""
        return max(self._overlap_with(f, text) for f in self.families)

    def _overlap_with(self, family: str, text: str) -> float:
        grams = set(ngrams(text))
        return max(len(grams & n) / min(len(grams), len(n)) for n in self.notices[family]) if grams else 0.0

    def _index(self) -> None:
        """The vocabulary by word numbers: the row of each word, and sorted codes and rows of runs of two and of three."""
        words = sorted(g for g in self.vocabulary if " " not in g)
        self._ids = {w: i for i, w in enumerate(words)} | {"\n": _LINE_END}
        self._rows = np.array([self.vocabulary[w] for w in words])
        self._codes = []
        for n in (2, 3):
            coded = sorted((self._code([self._ids[w] for w in g.split(" ")]), row) for g, row in self.vocabulary.items() if g.count(" ") == n - 1)
            self._codes.append(np.array(coded, np.int64).reshape(-1, 2).T)

    def _code(self, words):
        code = 0
        for w in words:
            code = code * len(self._ids) + w
        return code

    def doubtful(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(number of the text, start, end) of all paragraphs but those that `none` wins by MARGIN or more."""
        ids = np.fromiter(map(self._ids.get, _TOKENS.findall("\n".join(texts).lower()), repeat(_NO_WORD)), np.int64)
        paragraph = np.cumsum(ids == _LINE_END)
        at = np.flatnonzero(ids >= 0)
        found = [(paragraph[at], self._rows[ids[at]])]
        for n, (codes, rows) in zip((2, 3), self._codes):
            at = at[at + n <= len(ids)]
            at = at[ids[at + n - 1] >= 0]
            run = self._code([ids[at + k] for k in range(n)])
            place = np.minimum(np.searchsorted(codes, run), len(codes) - 1)
            known = codes[place] == run
            found.append((paragraph[at[known]], rows[place[known]]))
        once = np.unique(np.concatenate([p * len(self.vocabulary) + r for p, r in found]))
        where, rows = np.divmod(once, len(self.vocabulary))
        lines = np.array([t.count("\n") + 1 for t in texts])
        lead = self.bias[:-1].astype(float) - self.bias[-1]
        best = np.full(lines.sum(), lead.max())
        if len(once):
            first = np.flatnonzero(np.diff(where, prepend=-1))
            ahead = self.weights[:, :-1].astype(float) - self.weights[:, -1:]
            best[where[first]] = (np.add.reduceat(ahead[rows], first) + lead).max(axis=1)
        out, ends = [], np.cumsum(lines)
        for k in np.flatnonzero(best > -MARGIN):
            i = int(np.searchsorted(ends, k, "right"))
            if not out or out[-1][0] != i:
                starts = [0, *(m.end() for m in re.finditer("\n", texts[i])), len(texts[i]) + 1]
            line = int(k - (ends[i] - lines[i]))
            out.append((i, starts[line], starts[line + 1] - 1))
        return out

    def _examples(self, plain: list[str], rng: np.random.Generator) -> list[tuple[str, str, str]]:
        """(text, class, the notice or line that it was made of)."""
        out = []
        around_ = plain or PROSE
        for label, texts in [*TEMPLATES.items(), ("unknown", OTHER), ("none", PROSE)]:
            for text in texts:
                out.append((text, label, text))
                for _ in range(_COPIES):
                    words = text.split()
                    words = [w for w in words if rng.random() > 0.12] or words
                    if rng.random() < 0.4:  # the notice inside a longer paragraph
                        around = str(rng.choice(around_)).split()[: int(rng.integers(3, 30))]
                        words = around + words if rng.random() < 0.5 else words + around
                    lost = " ".join(words)
                    if label in ("unknown", "none") or self._named(label, lost):
                        out.append((lost, label, text))
                    elif self._overlap(lost) < OVERLAP:  # what lost its family's name states other terms; what looks like another family's says nothing
                        out.append((lost, "unknown", text))
        named = [(form.format(name), label, name) for label, names in NAMES.items() for name in names for form in FORMS] + [(text, "reserved", text) for text in RESERVED]
        for text, label, of in named:
            around = str(rng.choice(around_)).split()[: int(rng.integers(3, 30))]
            out += [(text, label, f"name {of}"), (" ".join([*around, *text.split()]), label, f"name {of}")]
        for text in around_:
            words = text.split()
            out.append((text, "none", f"line {text}"))
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(["license", "licence", "copyright", "Apache", "warranty", "BSD", "GNU", "redistribution", "licensed"])))
            out.append((" ".join(words), "none", f"line {text}"))
        return out

    def _named(self, family: str, text: str) -> bool:
        mine = set(ngrams(text))
        best = {f: max(len(mine & n) / len(n) for n in notices) for f, notices in self.notices.items()}
        return best[family] == max(best.values()) and sum(v == best[family] for v in best.values()) == 1

    def _rows_of(self, text: str) -> list[int]:
        return sorted(i for g in set(ngrams(text)) if (i := self.vocabulary.get(g)) is not None)

    def _fit(self, rows: list[list[int]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adam on the regularised log-loss, whole batch, over the sparse features; every class weighs the same."""
        k, size = len(self.classes), len(self.vocabulary)
        target = np.eye(k, dtype=np.float32)[y]
        weight = (1 / np.maximum(1, np.bincount(y, minlength=k)))[y].astype(np.float32)[:, None]
        weight /= weight.sum()
        feature = np.concatenate([np.array([*r, size], np.int64) for r in rows])  # the last one, the bias, is in every row
        starts = np.cumsum([0, *(len(r) + 1 for r in rows[:-1])])
        by_feature = np.argsort(feature, kind="stable")
        example = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])[by_feature]
        present, first_of = np.unique(feature[by_feature], return_index=True)
        params, first, second = (np.zeros((size + 1, k), np.float32) for _ in range(3))
        for step in range(1, _STEPS + 1):
            scores = np.add.reduceat(params[feature], starts)
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = weight * (scores / scores.sum(axis=1, keepdims=True) - target)
            grad = 2e-5 * params
            grad[-1] = 0
            grad[present] += np.add.reduceat(error[example], first_of)
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            params -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return params[:-1], params[-1]

    def _calibrate(self, scores: np.ndarray, y: np.ndarray, confirmed: np.ndarray) -> None:
        def probabilities(t: float) -> np.ndarray:
            e = np.exp((scores - scores.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = np.linspace(0.5, 5, 46)
        losses = [-np.log(np.maximum(1e-12, probabilities(t)[np.arange(len(y)), y])).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])
        p = probabilities(self.temperature)
        self.held_out_accuracy = float((p.argmax(axis=1) == y).mean())
        foreign = np.sort((p[:, : len(self.families)] * confirmed).max(axis=1)[(y >= len(self.families))])
        taken = np.where(y < len(self.families), y, -1)
        best = p[:, : len(self.families)].argmax(axis=1)
        self.held_out_family = float((best == taken)[taken >= 0].mean())
        self.least = max(0.5, float(foreign[int(np.ceil((1 - FALSE_RATE) * len(foreign))) - 1]) if len(foreign) else 0.5)

    def classify(self, text: str) -> tuple[str, float, float] | None:
        """(family or 'unknown', probability of a statement's best family, overlap with its notices); None where no licence is stated."""
        grams = set(ngrams(text))
        at = sorted(i for g in grams if (i := self.vocabulary.get(g)) is not None)
        scores = (self.weights[at].sum(axis=0) + self.bias) / self.temperature
        p = np.exp(scores - scores.max())
        p /= p.sum()
        if p.argmax() == len(self.classes) - 1:
            return None
        best = int(p[: len(self.families)].argmax())
        family = self.families[best]
        overlap = self._overlap_with(family, text)
        sure = p[best] >= self.least and p.argmax() == best and overlap >= OVERLAP
        return (family if sure else "unknown"), float(p[best]), overlap


def train(docs: DataFrame, background: int = BACKGROUND, lines: int = LINES, line_chars: int = LINE_CHARS) -> LicenceModel:
    """The model, with negative paragraphs from so many lines of `background` documents, those of least hash."""
    hashed = docs.where("text is not null").select(F.xxhash64("doc_id").alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(background).agg(F.max("h")).first()[0]  # only hashes travel
    each = hashed.where(F.col("h") <= F.lit(last)).select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, line_chars)).distinct()
    sample = each.orderBy(F.xxhash64("line"), "line").limit(lines)  # LINES x LINE_CHARS characters at most
    return LicenceModel([row["line"] for row in sample.collect()])


def _next_to(between: str) -> bool:
    """Whether what lies between two lines is BRIDGE lines at most, none of them blank."""
    inner = between[1:].split("\n")[:-1]
    return len(inner) <= BRIDGE and all(line.strip() for line in inner)


def statements(model: LicenceModel, text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int, str, float, float]]:
    """(start, end, family, probability, overlap) of what the doubtful lines of a text state, in order."""
    out, at = [], 0
    while at < len(lines):
        to = at + 1
        while to < len(lines) and _next_to(text[lines[to - 1][1] : lines[to][0]]) and lines[to][1] > lines[to][0]:
            to += 1
        each = [(a, b, model.classify(text[a:b])) for a, b in lines[at:to]]
        if to - at > 1:
            whole = model.classify(text[lines[at][0] : lines[to - 1][1]])
            families = {said[0] for _, _, said in each if said} - {"unknown"}
            if whole is not None and whole[0] != "unknown" and families <= {whole[0]}:
                each = [(lines[at][0], lines[to - 1][1], whole)]
        out += [(a, b, *said) for a, b, said in each if said is not None]
        at = to
    return out


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """(doc_id, start, end, family, probability, overlap): each paragraph that states a licence."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for low, high in slices(batch.column(1), _SLICE):
                some = [(i, t) for i, t in enumerate(batch.column(1).slice(low, high - low).to_pylist(), low) if t]
                lines: dict[int, list[tuple[int, int]]] = {}
                for k, start, end in shared.value.doubtful([t for _, t in some]) if some else []:
                    lines.setdefault(k, []).append((start, end))
                for k, found in lines.items():
                    i, text = some[k]
                    for start, end, family, p, overlap in statements(shared.value, text, found):
                        at.append(i)
                        rows.append((start, end, family, round(p, 4), round(overlap, 4)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["doc_id", "start", "end", "family", "probability", "overlap"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, start bigint, end bigint, family string, probability double, overlap double")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
