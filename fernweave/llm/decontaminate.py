"""Operator 3: benchmark decontamination.

The test questions and answers are normalised to lower-case words and cut into blocks of
SEED words, end to end, the last block reaching back if it would be short.  All blocks
form one Aho-Corasick automaton, whose size is that of the benchmark.  Each document is
normalised in the same way and scanned once.  A block that occurs is a seed: from it the
match is extended word by word, both ways, to the longest run of words that document and
item share.  A run counts if it has MIN_WORDS words or is the whole item.  As any run of
2 * SEED - 1 words holds a block, no run of MIN_WORDS words is missed.  Offsets are those
of the original text, mapped back for documents with a seed only.

Defined cases: a null or empty text has no matches.  An item that is null or has fewer
than LEAST words is not looked for, as such a phrase says nothing of a leak.  Items of
equal text are all reported.  A null doc_id is reported as null by leaks(), and such a
document is kept or dropped by its own text in drop_leaks().  Repeated rows repeat their
matches.  An empty benchmark gives no matches.  Other columns are never read by the scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .matching import kept, lower_in_place

SEED, MIN_WORDS, LEAST = 6, 13, 5
#: Characters of the benchmark that one automaton may hold; a larger benchmark takes several passes.
AUTOMATON_CHARS = 32_000_000
_WORDS = re.compile(r"\w+")


def _blocks(words: list[str]) -> list[tuple[str, int]]:
    """The blocks of an item, between blanks, each with the place of its first word; a repeated block with each of its places."""
    if len(words) <= SEED:
        return [(f" {' '.join(words)} ", 0)]
    starts = [*range(0, len(words) - SEED + 1, SEED)]
    if starts[-1] + SEED < len(words):
        starts.append(len(words) - SEED)
    return [(f" {' '.join(words[s : s + SEED])} ", s) for s in starts]


class Leaks:
    """The automaton over some items, and the words of each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if t and len(w := _WORDS.findall(lower_in_place(t))) >= LEAST]
        blocks: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(self.items):
            for block, start in _blocks(words):
                blocks.setdefault(block, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for block, where in blocks.items():
            self.automaton.add_word(block, (len(block), where))
        if blocks:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, words) of each run that counts, in order."""
        if not text or not self.items:
            return []
        words = _WORDS.findall(low := lower_in_place(text))
        line = f" {' '.join(words)} "
        seeds = [(end, size, where) for end, (size, where) in self.automaton.iter(line)]
        if not seeds:
            return []
        place, at = {}, 0
        for k, word in enumerate(words):
            place[at] = k  # the blank before each word
            at += len(word) + 1
        runs, reached = set(), {}
        for end, size, where in seeds:
            here = place[end + 1 - size]
            for n, start in where:
                if here < reached.get((n, here - start), 0):
                    continue  # inside a run that an earlier seed has given
                item = self.items[n][1]
                low_d, low_i = here, start
                while low_d and low_i and words[low_d - 1] == item[low_i - 1]:
                    low_d, low_i = low_d - 1, low_i - 1
                high_d, high_i = here, start
                while high_d < len(words) and high_i < len(item) and words[high_d] == item[high_i]:
                    high_d, high_i = high_d + 1, high_i + 1
                reached[n, here - start] = high_d
                if high_d - low_d >= min(MIN_WORDS, len(item)):
                    runs.add((n, low_d, high_d))
        spans = [m.span() for m in _WORDS.finditer(low)] if runs else []
        return sorted({(self.items[n][0], spans[a][0], spans[b - 1][1], b - a) for n, a, b in runs}, key=lambda x: (x[1], x[2], x[0]))


def _groups(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items, in groups of AUTOMATON_CHARS characters at most; one group for any usual benchmark."""
    out, size = [[]], 0
    for item, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if size + len(text) > AUTOMATON_CHARS and out[-1]:
            out.append([])
            size = 0
        out[-1].append((item, text))
        size += len(text)
    return out


def _share(docs: DataFrame, group: list[tuple[int, str]]):
    """What gives a worker its automaton: built once per worker, and known by the group's digest."""
    shared = docs.sparkSession.sparkContext.broadcast(group)
    digest = hashlib.sha256(repr(group).encode()).hexdigest()
    return lambda: kept(("leaks", digest), lambda: Leaks(shared.value))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, words): where a document repeats a benchmark item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(item_kind)
    found = None
    for group in _groups(benchmark):
        share = _share(docs, group)

        def scan(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            finder = share()
            for batch in batches:
                hits = [(i, *hit) for i, t in enumerate(batch.column(1)) for hit in finder.find(t.as_py())]
                if hits:
                    at, items, starts, ends, words = zip(*hits)
                    columns = [pa.array(items, item_type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(words, pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], ["doc_id", "item_id", "start", "end", "words"])

        part = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, item_id {item_kind.simpleString()}, start bigint, end bigint, words bigint")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, in all their columns, without those that repeat a benchmark item; one pass, no shuffle."""
    place = docs.columns.index("text")
    for group in _groups(benchmark):
        share = _share(docs, group)

        def keep(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            finder = share()
            for batch in batches:
                clean = pa.array([not finder.find(t.as_py()) for t in batch.column(place)], pa.bool_())
                yield batch.filter(clean)

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
