"""Encoding texts with a public byte-level BPE vocabulary, by dynamic programming.

Texts are cut into words by the vocabulary's pattern.  Inside a word every prefix
has exactly one encoding, so one number a prefix, its last token, holds
them all: of the tokens that end there (found by an automaton over the vocabulary that
follows suffix links), it is the one that starts at the word's start or is compatible with the
last token of the prefix before it.  Two tokens are compatible if merging their joined
bytes gives the two again.  Following the stored tokens back from the word's end gives its ids; the work
is linear in a word's length, however long a run of one character is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies unless told otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pairs remembered by a worker; the memory is emptied when full.
REMEMBERED = 200_000
#: Words longer than this are not remembered.
_LONG = 64
#: Ids in one output batch.
_BATCH = 2_000_000


class Encoder:
    """Encodes words and texts; made once in each Python worker."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.words = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.machine.add_word(token.decode("latin-1"), (len(token), i))
        self.machine.make_automaton()
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by the definition: always merge the pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, first: int, second: int) -> bool:
        found = self.pairs.get((first, second))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[first, second] = self.merged(self.bytes[first] + self.bytes[second]) == [first, second]
        return found

    @cached_property
    def reachable(self) -> set[int]:
        """Tokens that merging their own bytes gives back."""
        return {i for t, i in self.ranks.items() if self.merged(t) == [i]}

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        last = [-1] * (len(data) + 1)
        end, ends = -1, []

        def settle() -> None:
            for length, token in sorted(ends, reverse=True):
                start = end + 1 - length
                if token in self.reachable if start == 0 else last[start] >= 0 and self.compatible(last[start], token):
                    last[end + 1] = token
                    break

        for at, match in self.machine.iter(data.decode("latin-1")):
            if at != end:
                settle()
                end, ends = at, []
            ends.append(match)
        settle()
        ids, at = [], len(data)
        while at > 0:
            ids.append(last[at])
            at -= len(self.bytes[last[at]])
        return ids[::-1]

    def text(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for w in self.words(text) if text else ():
            found = self.known.get(w)
            if found is None:
                found = self.word(w)
                if len(w) <= _LONG:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[w] = found
            ids += found
        return ids


_MADE: dict[int, Encoder] = {}


def _shared(spark: SparkSession, vocabulary: str):
    """The vocabulary file (of fixed size, about 1 MB) for all workers, read by the driver."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(shared) -> Encoder:
    """This worker's encoder of a broadcast vocabulary."""
    raw = shared.value
    key = hash(raw)
    if key not in _MADE:
        _MADE[key] = Encoder(raw)
    return _MADE[key]


def encode(documents: DataFrame, id_: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens.

    Null and empty texts both get the empty list, so ``ids`` is never null.  One row per input row;
    repeated or null ids are kept as they are.  Other columns are dropped.  Texts of any
    length are encoded whole.
    """
    shared = _shared(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            ids, size, first = [], 0, 0
            for k in range(batch.num_rows):
                ids.append(encoder.text(batch.column(1)[k].as_py()))
                size += len(ids[-1])
                if size >= _BATCH or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
                    ids, size, first = [], 0, k + 1

    kind = documents.schema[id_].dataType.simpleString()
    return documents.select(F.col(id_), F.col(text)).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_)


def token_counts(documents: DataFrame, text: str = "text", name: str = "tokens", vocabulary: str = VOCABULARY, keep_text: bool = False) -> DataFrame:
    """``documents`` with the number of tokens of each text in place of (or beside) the text; zero for null and empty texts."""
    shared = _shared(documents.sparkSession, vocabulary)
    others = [c for c in documents.columns if c not in (text, name)] + [text] * keep_text
    schema = documents.select(*others, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            column = batch.column(text)
            counts = [len(encoder.text(column[k].as_py())) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(counts, pa.int64())], names=[*others, name])

    return documents.select(*dict.fromkeys([*others, text])).mapInArrow(run, schema)
