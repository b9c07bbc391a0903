"""Operator 9: byte-level BPE encoding and decoding.

Method: length-bucketed padded numpy matrices. The distinct pieces of a batch of texts go
into one matrix per power-of-two length; in each round every row merges its leftmost pair of
least rank, pairs are looked up in an open-addressing hash table held in two numpy arrays,
and rows that have no pair left are taken out (compaction).

Defined results: null text encodes like the empty text (no ids); a null doc_id stays null;
repeated rows give repeated rows; columns other than doc_id and text are not read. Ids that
are out of range make decode raise.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from newsflow.llm.merges import NO_RANK, PairMerges
from newsflow.llm.shared import arrow_session
from newsflow.sources.testbed import spread

#: A piece with more bytes than this merges through a heap instead of a matrix row, whose rounds would cost the square of its length.
LONGEST_ROW = 256
#: Distinct pieces that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 400_000


class ByteBPE:
    """Encodes and decodes with the ranks in a .tiktoken file and a pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        self.vocabulary: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.decimal = [str(k) for k in range(len(self.vocabulary))]
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.merges = self._pairs()
        self.known: dict[str, tuple[int, ...]] = {}

    def _pairs(self) -> PairMerges:
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        return PairMerges(left, right, merged)

    def _merge_matrix(self, pieces: list[bytes], width: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(index, ids) of each piece; all have at most width bytes."""
        flat, lens = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], np.array([len(p) for p in pieces])
        for words, sizes, ids in self.merges.merge(flat, lens, width):
            held, ends = ids.tolist(), np.cumsum(sizes)
            for k, start, end in zip(words.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                yield k, tuple(held[start:end])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        n = len(piece)
        ids: list[int] = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.merges.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        vocabulary, ranks = self.vocabulary, self.ranks
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := ranks.get(vocabulary[ids[x]] + vocabulary[ids[y]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(x for x in ids if x >= 0)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in (p for p in pieces if p not in self.known):
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = (rank,)
            elif len(raw) > LONGEST_ROW:
                self.known[piece] = self._merge_long(raw)
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, members in by_width.items():
            for k in range(0, len(members), step := max(1, (1 << 20) // width)):
                part = members[k : k + step]
                for index, ids in self._merge_matrix([raw for _, raw in part], width):
                    self.known[part[index][0]] = ids

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """The matrices take the distinct pieces of all these texts at once."""
        cut = [self.pattern.findall(text) for text in texts]
        self.learn(set().union(*cut))
        return [list(chain.from_iterable(map(self.known.__getitem__, pieces))) for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process."""
    return ByteBPE(path, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path, pattern)
    for batch in batches:
        lists = bpe.encode_many([t or "" for t in batch.column(1).to_pylist()])
        yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>: the token ids of each whole text."""
    arrow_session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_encoded, path=path, pattern=pattern), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path, pattern)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, bytes binary."""
    arrow_session(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path, pattern=pattern), "doc_id long, bytes binary")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path, pattern)
    hexed = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        counts, ids_hex, text_hex = [], [], []
        for ids in bpe.encode_many([t or "" for t in batch.column(1).to_pylist()]):
            counts.append(len(ids))
            ids_hex.append(hexed(",".join(map(bpe.decimal.__getitem__, ids)).encode()))
            text_hex.append(hexed(bpe.decode(ids)))
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text in one pass and keep what identifies the two results."""
    arrow_session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_round_trip, path=path, pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _checked(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path, pattern)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        lists = bpe.encode_many(texts)
        intact = [bpe.decode(ids) == text.encode() for ids, text in zip(lists, texts, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(map(len, lists), pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(intact)], names=["doc_id", "n_tokens", "ids", "intact"])


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids, intact: whether the ids decode to the text."""
    arrow_session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_checked, path=path, pattern=pattern), "doc_id long, n_tokens long, ids array<int>, intact boolean")


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return digests(docs, *public_vocabulary())
