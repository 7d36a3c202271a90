"""Operator 8: language-model scoring by a weighted backoff automaton.

The model is a smoothed character n-gram model of ORDER, from counts over the whole corpus.
An n-gram is known if it occurs MIN_COUNT times or more; single characters always are.
Absolute discounting, interpolated: with C the count of a context's continuations, K and N
the count and number of its known ones, and D the discount,

    backoff(context) = (C - K + D N) / C
    p(x | context)   = (count - D) / C + backoff(context) p(x | shorter context)

down to a uniform floor over the known characters and one unknown; the probabilities of a
context sum to one.  Known n-grams below ORDER are the states of an automaton, the known
continuations of a state its arcs; the failure arc leads to the longest proper suffix and
costs log backoff.  A text is read from left to right in one traversal: the state is
carried, and log-probabilities accumulate, up to an end symbol.  All texts of a chunk walk
side by side, a symbol a step.

How it is spread: documents fall into chunks by a hash; a chunk's distinct n-grams are
counted in numpy and written to the shared folder.  The model is DataFrame aggregations of
them, each chunk gets just the known n-grams it asked for, by a join, and builds its own
part of the automaton.  Neither model nor vocabulary is ever collected or broadcast.  Inside
a chunk n-grams are Arrow strings or integer codes, never Python objects, and texts are
worked on in slices, so a worker's memory is some ten times the characters of a chunk.

The state after a symbol is the longest known n-gram that ends there, so it follows from
the last ORDER - 1 symbols.  A text longer than SEGMENT is therefore read by several
walkers; each reads the ORDER - 1 symbols before its part first, without counting them, and
holds from there on the state that one walker would have carried.

Defined cases: a null text scores as an empty one, the end symbol alone.  A null doc_id
stays null; repeated rows each get their row, and count as often as they occur.  NUL and
the two private characters of start and end are read as U+FFFD.  An empty table, or an
empty corpus, gives no rows or floor probabilities.  Very long texts are read whole.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import stored
from .tokens import slices

ORDER, MIN_COUNT, DISCOUNT = 5, 2, 0.75
#: Characters of a chunk, on average, and symbols that one walker reads.
CHUNK_CHARS, SEGMENT = 16_000_000, 4096
START, END = "\U0010fffe", "\U0010ffff"
_SLICE, _TABLE, _DENSE = 2_000_000, 1 << 24, 1 << 24


def _codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, how many of them each has); a null is an empty string."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]] if len(column) else b""
    return np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32), sizes


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each between start and end; where each begins, and the end)."""
    raw, sizes = _codepoints(column)
    starts = np.concatenate([[0], np.cumsum(sizes + 2)]).astype(np.int64)
    codes = np.empty(int(starts[-1]), np.uint32)
    inner = np.ones(len(codes), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    codes[inner] = np.where((raw == 0) | (raw >= ord(START)), np.uint32(0xFFFD), raw)
    codes[starts[:-1]], codes[starts[1:] - 1] = ord(START), ord(END)
    return codes, starts


def _dense(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, place of each code among them); by a table where that is small, else by sorting."""
    if limit > _DENSE:
        distinct, places = np.unique(codes, return_inverse=True)
        return distinct, places.astype(np.int32)
    seen = np.zeros(limit, bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    table = np.zeros(limit, np.int32)
    table[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, table[codes]


def ngram_counts(texts: pa.Array, order: int = ORDER) -> pa.Table:
    """(gram, n): how often each n-gram up to the order occurs; the start symbol and the empty context count 0."""
    parts = [pa.table({"gram": pa.array(["", START]), "n": pa.array([0, 0], pa.int64())})]
    for low, high in slices(texts, _SLICE):
        codes, starts = _symbols(texts.slice(low, high - low))
        alphabet, symbol = _dense(codes, 0x110000)
        alphabet, width = alphabet.astype(np.uint32), len(alphabet)
        ids, grams = symbol, alphabet[:, None]
        for k in range(1, order + 1):
            if k > 1:  # over text borders too, at first; what lies across one is taken off the counts
                kind = np.int64 if len(grams) * width > 2**31 - 1 else np.int32
                pairs, ids = _dense(ids[:-1] * kind(width) + symbol[k - 1 :], len(grams) * width)
                grams = np.hstack([grams[pairs // width], alphabet[pairs % width][:, None]])
            counts = np.bincount(ids, minlength=len(grams))
            across = (starts[1:-1, None] - np.arange(1, k)[None, :]).ravel()
            across = across[(across >= 0) & (across < len(ids))]
            counts -= np.bincount(ids[np.unique(across)], minlength=len(grams))
            some = counts > 0
            if k == 1:
                some &= alphabet != ord(START)
            said = np.ascontiguousarray(grams[some]).view(f"<U{k}").ravel()
            parts.append(pa.table({"gram": pa.array(said, pa.string()), "n": pa.array(counts[some], pa.int64())}))
    summed = pa.concat_tables(parts).group_by("gram").aggregate([("n", "sum")])
    return summed.select(["gram", "n_sum"]).rename_columns(["gram", "n"])


def _keys(letters: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an integer for each n-gram, for it without its last letter, for it without its first), equal where the n-grams are.

    letters has the numbers of the letters from 1 on and 0 beyond an n-gram's end.
    """
    n, order = letters.shape
    shorter, suffix = letters.copy(), np.zeros_like(letters)
    some = np.flatnonzero(lengths > 0)
    shorter[some, lengths[some] - 1] = 0
    suffix[:, :-1] = letters[:, 1:]
    bits = int(width).bit_length()

    def packed(matrix: np.ndarray) -> np.ndarray:
        code = np.zeros(len(matrix), np.int64)
        for k in range(matrix.shape[1]):
            code = (code << bits) | matrix[:, k]
        return code

    if bits * order <= 63:
        return packed(letters), packed(shorter), packed(suffix)
    code = np.zeros(3 * n, np.int64)  # too many letters for one integer: what was seen so far is numbered anew at each place
    every = np.concatenate([letters, shorter, suffix])
    for k in range(order):
        code = np.unique(code * np.int64(width + 1) + every[:, k], return_inverse=True)[1].astype(np.int64)
    return code[:n], code[n : 2 * n], code[2 * n :]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


class Automaton:
    """States, arcs and failure arcs over the known n-grams (gram, n, followed, known, kinds) that a chunk was sent."""

    def __init__(self, sent: pa.Table, order: int, discount: float):
        grams = sent.column("gram").combine_chunks()
        counts, of, known, kinds = (_column(sent, c) for c in ("n", "followed", "known", "kinds"))
        flat, lengths = _codepoints(grams)
        if not len(lengths) or lengths.min() > 0:
            lengths = np.append(lengths, 0)
            counts, of, known, kinds = (np.append(x, 0) for x in (counts, of, known, kinds))
        # the empty context is row 0, then the n-grams below the order, shorter ones first
        by = np.argsort(lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[by]
        lengths, counts, of, known, kinds = lengths[by], counts[by], of[by], known[by], kinds[by]
        alphabet, letter = _dense(flat, 0x110000)
        self.width = len(alphabet) + 1  # the last symbol stands for any unknown one
        self.symbol = np.full(0x110000, self.width - 1, np.int32)
        self.symbol[alphabet] = np.arange(len(alphabet))
        letters = np.zeros((len(lengths), order), np.int32)
        for k in range(order):
            has = lengths > k
            letters[has, k] = letter[begin[has] + k] + 1
        last = letters[np.arange(len(lengths)), np.maximum(lengths - 1, 0)] - 1
        own, shorter, suffix = _keys(letters, lengths, self.width)
        del letters, letter, flat
        sorted_ = np.argsort(own)
        ordered = own[sorted_]
        context, suffix = (sorted_[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] for x in (shorter, suffix))

        n, c = counts.astype(np.float64), of.astype(np.float64)
        left = np.where(c > 0, (c - known + discount * kinds) / np.maximum(c, 1), 1.0)
        floor = left[0] / (kinds[0] + 1)
        p = np.full(len(n), floor)
        for k in range(1, int(lengths.max()) + 1):
            at = np.flatnonzero((lengths == k) & (n > 0))
            p[at] = (n[at] - discount) / c[context[at]] + p[suffix[at]] * (left[context[at]] if k > 1 else 1.0)
        states = int(np.searchsorted(lengths, order))
        self.lengths, self.fail = lengths[:states], suffix[:states]
        self.cost = np.where(self.lengths > 0, np.log(left[:states]), 0.0)
        self.floor = float(np.log(floor))
        first = np.flatnonzero((lengths == 1) & (last == self.symbol[ord(START)]))
        self.start = int(first[0]) if len(first) and first[0] < states else 0
        read = np.flatnonzero(n > 0)
        self.origin, self.letter, self.log_p = context[read], last[read].astype(np.int64), np.log(p[read])
        self.target = np.where(lengths[read] < order, read, suffix[read])
        self.before = order - 1
        self._table() if states * self.width <= _TABLE else self._sparse()

    def _table(self) -> None:
        """Failure arcs followed beforehand: the arc that every state and symbol ends up with.

        What the failure arcs on the way cost is the difference of two sums, each along all of a state's failure arcs.
        """
        paid, none = np.zeros(len(self.lengths)), len(self.origin)
        arc = np.full((len(self.lengths), self.width), none, np.int32)
        depth = self.lengths[self.origin]
        for k in range(int(self.lengths.max()) + 1):
            if k:
                rows = np.flatnonzero(self.lengths == k)  # next to each other
                paid[rows] = paid[self.fail[rows]] + self.cost[rows]
                if len(rows):
                    np.take(arc, self.fail[rows], axis=0, out=arc[rows[0] : rows[-1] + 1], mode="clip")
            here = np.flatnonzero(depth == k)
            arc[self.origin[here], self.letter[here]] = here
        self.arc, self.paid = arc.ravel(), paid
        self.target = np.append(self.target, 0).astype(np.int32)
        self.base = np.append(self.log_p - paid[self.origin], self.floor)

    def _sparse(self) -> None:
        self.arc = None
        keys = self.origin * self.width + self.letter
        order = np.argsort(keys)
        self.keys, self.target, self.log_p = keys[order], self.target[order], self.log_p[order]

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log-probabilities) of one symbol each."""
        if self.arc is not None:
            arc = self.arc.take(state * np.int64(self.width) + symbol)
            return self.target.take(arc), self.base.take(arc) + self.paid.take(state)
        gained, out = np.zeros(len(state)), np.zeros(len(state), np.int32)
        state, open_ = state.copy(), np.arange(len(state))
        while len(open_):
            key = state[open_] * np.int64(self.width) + symbol[open_]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            out[open_[hit]] = self.target[at[hit]]
            gained[open_[hit]] += self.log_p[at[hit]]
            open_ = open_[~hit]
            ground = state[open_] == 0
            gained[open_[ground]] += self.floor
            open_ = open_[~ground]
            gained[open_] += self.cost[state[open_]]
            state[open_] = self.fail[state[open_]]
        return out, gained

    def _walk(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log-probability of each text (code points between start and end), from left to right, state in hand."""
        symbol = self.symbol[codes]
        texts = len(starts) - 1
        parts = np.maximum(1, -(-(np.diff(starts) - 1) // SEGMENT))
        text = np.repeat(np.arange(texts), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = starts[text] + 1 + nth * SEGMENT  # the first symbol that this walker counts
        sizes = np.minimum(SEGMENT, starts[text + 1] - begin)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes, text, nth = begin[order], sizes[order], text[order], nth[order]
        state = np.where(nth > 0, 0, self.start).astype(np.int32)
        later = np.flatnonzero(nth > 0)
        for back in range(min(self.before, SEGMENT), 0, -1):
            state[later] = self._step(state[later], symbol.take(begin[later] - back))[0]
        total, active = np.zeros(len(text)), len(text)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[active - 1] <= step:
                active -= 1
            state[:active], gained = self._step(state[:active], symbol.take(begin[:active] + step))
            total[:active] += gained
        return np.bincount(text, total, texts)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The log-probability of each text with its end symbol."""
        found = [self._walk(*_symbols(texts.slice(low, high - low))) for low, high in slices(texts, _SLICE)]
        return np.concatenate(found) if found else np.zeros(0)


def _chunked(docs: DataFrame, chunks: int) -> DataFrame:
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))


def _counted(order: int):
    def run(table: pa.Table) -> pa.Table:
        counts = ngram_counts(table.column("text").combine_chunks(), order)
        pa.default_memory_pool().release_unused()
        return counts.add_column(0, "chunk", pa.repeat(table.column("chunk")[0], len(counts)))

    return run


def language_model(grams: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(gram, n, followed, known, kinds) of every known n-gram: its count, and as a context C, K and N."""
    counted = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    known = (F.col("n") >= min_count) | ((F.length("gram") == 1) & (F.col("n") > 0))
    zero = F.lit(0).cast("bigint")
    arc = F.struct(F.col("gram"), F.when(known, F.col("n")).otherwise(zero).alias("n"), zero.alias("followed"), zero.alias("known"), zero.alias("kinds"))
    context = F.struct(
        F.expr("substring(gram, 1, length(gram) - 1)").alias("gram"), zero.alias("n"), F.col("n").alias("followed"),
        F.when(known, F.col("n")).otherwise(zero).alias("known"), F.when(known, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("kinds"),
    )
    both = counted.where("gram <> ''").select(F.inline(F.array(arc, context)))
    merged = both.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", "followed", "known", "kinds")))
    return merged.where(f"n > 0 or gram = '' or gram = '{START}'")


def lm_scores(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) of every row, under the model of the corpus (the documents themselves if none is given)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        placed = _chunked(rows, max(1, -(-chars // chunk_chars)))
        return placed, stored(placed.groupBy("chunk").applyInArrow(_counted(order), "chunk int, gram string, n bigint"))

    placed, asked = counted(docs)
    model = language_model(asked if corpus is None else counted(corpus)[1], min_count)
    answers = asked.select("chunk", "gram").join(model, "gram").select("chunk", "gram", "n", "followed", "known", "kinds")

    def run(texts: pa.Table, sent: pa.Table) -> pa.Table:
        automaton = Automaton(sent, order, discount)
        column = texts.column("text").combine_chunks()
        log_prob = automaton.score(column)
        symbols = pc.add(pc.fill_null(pc.utf8_length(column), 0).cast(pa.int64()), 1)
        perplexity = np.exp(np.minimum(700, -log_prob / symbols.to_numpy(zero_copy_only=False))) if len(log_prob) else log_prob
        return pa.table({"doc_id": texts.column("doc_id"), "n_symbols": symbols, "log_prob": pa.array(log_prob), "perplexity": pa.array(perplexity)})

    joined = placed.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return joined.applyInArrow(run, f"doc_id {kind}, n_symbols bigint, log_prob double, perplexity double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
