"""Operator 10: token counts without token ids.

1. A pass over the texts splits them into pre-tokens and keeps, per document, the
   frequency of each.  Documents are gathered in chunks; a chunk has one dictionary of its
   pre-tokens, and its documents' frequencies refer to places in it.  Both are written to
   the shared folder, packed and compressed.
2. The dictionaries travel, cut by a hash of the pre-token, to where all occurrences of a
   pre-token meet.  There its pieces are counted once, and each chunk gets its answers as
   one byte string, aligned with what it asked.
3. Frequencies and answers join by chunk; a document's count is the sum of frequency times
   pieces.  No text is ever turned into ids: a pre-token is encoded by itself, once in the
   whole corpus, and only the number of its pieces is kept.

Shuffled are the distinct pre-tokens of each chunk and the packed frequencies, never texts.
A chunk ends at CHUNK_TOKENS distinct pre-tokens or with its partition; a bucket's dictionary
is dropped when the next bucket begins.  The vocabulary is a file on the driver, of
VOCABULARY_BYTES at most; its content travels with the job, so executors need no such file.

Defined cases: a null text counts 0, as an empty one does.  A null doc_id stays null and
repeated rows each get their row.  An empty table gives no rows.  Very long texts are read
whole.  Special tokens written out in a text are ordinary text.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import stored
from .matching import kept

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_TOKENS = 500_000
#: Greatest size of a vocabulary file; it is broadcast.
VOCABULARY_BYTES = 64 << 20


def encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file's content."""

    def load() -> tiktoken.Encoding:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return kept(("encoding", hashlib.sha256(vocabulary).digest(), pattern), load)


def _squeeze(numbers: np.ndarray) -> bytes:
    """uint32 numbers, their bytes in planes, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return zstandard.compress(np.array([len(words), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 3)


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 * (n + 1)
    starts = np.concatenate([[4 * (n + 1)], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class _Chunk:
    """The documents gathered so far, and the dictionary of their pre-tokens."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.ids: list[pa.Array] = []
        self.sizes: list[int] = []
        self.which: list[np.ndarray] = []
        self.often: list[np.ndarray] = []

    def add(self, frequencies: Counter) -> None:
        places = self.places
        which = np.fromiter((places.setdefault(w, len(places)) for w in frequencies), np.int64, len(frequencies))
        often = np.fromiter(frequencies.values(), np.int64, len(frequencies))
        order = np.argsort(which, kind="stable")
        self.sizes.append(len(which))
        self.which.append(np.diff(which[order], prepend=0))
        self.often.append(often[order])

    def rows(self, chunk: int, buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row of frequencies, and one row of pre-tokens for each bucket."""
        if not self.sizes:
            return
        blobs = [_squeeze(np.array(self.sizes)), _squeeze(np.concatenate(self.which)), _squeeze(np.concatenate(self.often))]
        asked: dict[int, tuple[list[str], list[int]]] = {}
        for word in sorted(self.places):
            words, at = asked.setdefault(zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets, ([], []))
            words.append(word)
            at.append(self.places[word])
        ids = pa.concat_arrays(self.ids)
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)] + [len(ids)] * len(asked), pa.int32()), ids)
        columns = {
            "chunk": pa.array([chunk] * (1 + len(asked)), pa.int64()),
            "bucket": pa.array([-1, *asked], pa.int32()),
            "ids": lists,
            "places": pa.array([blobs[0], *(_squeeze(np.array(at)) for _, at in asked.values())], pa.binary()),
            "words": pa.array([blobs[1], *(_pack_words(words) for words, _ in asked.values())], pa.binary()),
            "often": pa.array([blobs[2], *[None] * len(asked)], pa.binary()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _gather(pattern: str, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        chunk, number = _Chunk(), TaskContext.get().partitionId() << 24
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            since = 0
            for i, text in enumerate(batch.column(1)):
                chunk.add(Counter(split.findall(text.as_py() or "")))
                if len(chunk.places) >= most:
                    chunk.ids.append(batch.column(0).slice(since, i + 1 - since))
                    yield from chunk.rows(number, buckets, id_type)
                    chunk, number, since = _Chunk(), number + 1, i + 1
            if since < len(batch):
                chunk.ids.append(batch.column(0).slice(since))
        yield from chunk.rows(number, buckets, id_type)

    return run


def _count_pieces(vocabulary: Broadcast, pattern: str):
    """Answers to all that was asked in a partition, bucket after bucket; a pre-token is encoded once, in its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[bytes, int] = {}
        model, open_ = None, None
        for batch in batches:
            model = model or encoding(vocabulary.value, pattern)
            answers = []
            for bucket, blob in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if bucket != open_:
                    pieces, open_ = {}, bucket
                words = _unpack_words(blob)
                for word in words:
                    if word not in pieces:
                        pieces[word] = len(model.encode_ordinary(word.decode("utf-8", "surrogatepass")))
                answers.append(_squeeze(np.fromiter((pieces[w] for w in words), np.int64, len(words))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.binary())], ["chunk", "places", "pieces"])

    return run


def _sum(frequencies: pa.Table, answers: pa.Table) -> pa.Table:
    """The counts of one chunk's documents."""
    row = frequencies.slice(0, 1).to_pydict()
    ids = frequencies.column("ids").combine_chunks().slice(0, 1).flatten()
    sizes = _unsqueeze(row["places"][0]).astype(np.int64)
    places = [_unsqueeze(b) for b in answers.column("places").to_pylist()]
    pieces = np.zeros(sum(map(len, places)), np.int64)
    for at, blob in zip(places, answers.column("pieces").to_pylist()):
        pieces[at] = _unsqueeze(blob)
    ends = np.cumsum(sizes)
    steps, often = _unsqueeze(row["words"][0]).astype(np.int64), _unsqueeze(row["often"][0]).astype(np.int64)
    run = np.cumsum(steps)
    before = np.concatenate([[0], run])[np.concatenate([[0], ends[:-1]]).astype(np.int64)] if len(ends) else run
    which = run - np.repeat(before, sizes)  # the differences start anew with each document
    total = np.concatenate([[0], np.cumsum(pieces[which] * often)])
    words = np.concatenate([[0], np.cumsum(often)])
    starts = ends - sizes
    columns = [ids, pa.array(words[ends] - words[starts], pa.int64()), pa.array(total[ends] - total[starts], pa.int64())]
    return pa.Table.from_arrays(columns, ["doc_id", "n_pre_tokens", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) of every row."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = f"chunk bigint, bucket int, ids array<{kind}>, places binary, words binary, often binary"
    packed = stored(docs.select("doc_id", "text").mapInArrow(_gather(pattern, buckets, chunk_tokens), shape))
    asked = packed.where("bucket >= 0").select("chunk", "places", "words", "bucket").repartition("bucket").sortWithinPartitions("bucket")
    if os.path.getsize(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than VOCABULARY_BYTES")
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    answers = asked.mapInArrow(_count_pieces(shared, pattern), "chunk bigint, places binary, pieces binary")
    frequencies = packed.where("bucket < 0").select("chunk", "ids", "places", "words", "often")
    joined = frequencies.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return joined.applyInArrow(_sum, f"doc_id {kind}, n_pre_tokens bigint, n_tokens bigint")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
