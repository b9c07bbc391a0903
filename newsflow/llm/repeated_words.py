"""Operator 1: substring dedup on words with fixed-block anchors.

A repeat of ``window`` words holds at least one whole block of ``window / 2`` words that
starts at a multiple of that length in its document. So (A) every batch of documents sends
its aligned blocks, the reference blocks, and all its rolling windows of that length, the
probes, to buckets by hash; a bucket answers which reference blocks some other place hits.
(B) Windows of the full length that contain a hit block are candidates: the anchor extended
to the least length of a repeat. Batches send these, each once with the first document that
holds it; a bucket answers who does not hold the first start. (C) Batches join the windows
to maximal runs and cut them out.

Hashes are sent once per batch and bucket, however often they occur in it, so a passage that
a third of all documents share costs each bucket one entry per batch. Sent hashes are 40 bits
or more for anchors (a filter only: enough that few blocks look hit by chance) and 96 bits
for full windows. Texts stay in their batches.

Defined results: null text has no words; a null doc_id comes before all others; rows that
repeat a doc_id are documents of their own, ordered as staged (identical rows give the same
rows in any order); columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.shared import Batch, arrow_session, batch_bytes, binary_batch, bucket_cuts, is_in, mix, n_buckets, planes, rows_of, stage_batches, unplanes

_ODD = np.uint64(0xD6E8FEB86659FD93)
_ODD2 = np.uint64(0xA0761D6478BD642F)


class _Memo(dict):
    """word -> 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_memo = _Memo()


class Words:
    """The words of a batch, one after another, and the hashes of runs of them."""

    def __init__(self, batch: Batch):
        split = [doc.split() for doc in batch.docs()]
        self.words = [w for doc in split for w in doc]
        self.counts = np.array([len(doc) for doc in split], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(split)), self.counts)
        self.hashes = np.fromiter(map(_memo.__getitem__, self.words), np.uint64, len(self.words))

    def runs(self, length: int, odd: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of that many words within a document start, and their hashes."""
        n = len(self.words) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(length):
            h = h * odd + self.hashes[k : k + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return at, mix(h[at])


def _anchors(batches: Iterator[pa.RecordBatch], block: int, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, batch, hashes, flags): one entry per distinct run of block words; flags: is a block, occurs again."""
    for row in rows_of(batches):
        batch = Batch(row)
        words = Words(batch)
        at, h = words.runs(block, _ODD)
        if not len(at):
            continue
        h >>= np.uint64(64 - 8 * width)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        heads = np.flatnonzero(first)
        aligned = (at - words.starts[words.doc[at]]) % block == 0
        is_block = np.maximum.reduceat(aligned, heads)
        again = np.diff(np.concatenate([heads, [len(h)]])) > 1
        yield from _dealt(batch.number, h[heads], buckets, 8 * width, width, lambda a, b, x=is_block, y=again: np.packbits(np.concatenate([x[a:b], y[a:b]])).tobytes())


def _dealt(number: int, h: np.ndarray, buckets: int, bits: int, width: int, more) -> Iterator[pa.RecordBatch]:
    cuts = bucket_cuts(h, buckets, bits).tolist()
    rows = [(k, number, planes(h[a:b], width), more(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    if rows:
        yield binary_batch(["bucket", "batch", "hashes", "flags"], rows)


def _hit_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per bucket: the hashes that are a block somewhere and occur in two places, to each batch in which they are a block."""
    for held in _buckets(batches):
        h = np.concatenate([unplanes(r["hashes"], width) for r in held])
        sizes = [len(r["hashes"]) // width for r in held]
        flags = [np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=2 * n).astype(bool) for r, n in zip(held, sizes, strict=True)]
        is_block = np.concatenate([f[:n] for f, n in zip(flags, sizes, strict=True)])
        again = np.concatenate([f[n:] for f, n in zip(flags, sizes, strict=True)])
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
        size = np.diff(np.concatenate([heads, [len(h)]]))
        hot = np.logical_or.reduceat(is_block[order], heads) & ((size > 1) | np.logical_or.reduceat(again[order], heads))
        told = np.empty(len(h), bool)
        told[order] = np.repeat(hot, size)
        told &= is_block
        rows, start = [], 0
        for r, n in zip(held, sizes, strict=True):
            if told[start : start + n].any():
                rows.append((r["batch"], 0, planes(h[start : start + n][told[start : start + n]], width), b"", b"", b"", b""))
            start += n
        if rows:
            yield binary_batch(TOLD, rows)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of a partition sorted by bucket, bucket by bucket."""
    held: list[dict] = []
    for row in rows_of(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


#: What a batch gets back, in the columns of a staged batch: kind 0 is an answer, kind 1 the batch.
TOLD = ["batch", "kind", "doc_ids", "missing", "lens", "blob", "more"]
TOLD_SCHEMA = "batch long, kind int, doc_ids binary, missing binary, lens binary, blob binary, more binary"


def meet(staged: DataFrame, told: DataFrame) -> DataFrame:
    """Each batch behind the answers for it, in one partition."""
    n = n_buckets(staged.sparkSession)
    rows = staged.select("batch", F.lit(1).alias("kind"), "doc_ids", "missing", "lens", "blob", (F.col("more") if "more" in staged.columns else F.lit(b"")).alias("more"))
    return told.unionByName(rows).repartition(n, "batch").sortWithinPartitions("batch", "kind")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], dict]]:
    """(answers, batch) for every batch of a partition of meet()."""
    held: list[dict] = []
    for row in rows_of(batches):
        if row["kind"] == 0:
            held.append(row)
        else:
            yield held, row
            held = []


def _candidates(words: Words, hit: np.ndarray, block: int, window: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and second hash of the windows whose first aligned block is hit."""
    at, h = words.runs(window, _ODD)
    if not len(at):
        return at, h, h
    begin = words.starts[words.doc[at]]
    aligned = at + (begin - at) % block
    where, b = words.runs(block, _ODD)
    of = np.zeros(len(words.words) + 1, bool)
    of[where] = is_in(b >> np.uint64(64 - 8 * width), hit)
    keep = of[aligned]
    _, h2 = words.runs(window, _ODD2)
    return at[keep], h[keep], h2[keep] >> np.uint64(32)


def _windows(batches: Iterator[pa.RecordBatch], block: int, window: int, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, batch, hashes, flags): the distinct candidate windows of each batch; flags: second hash and first doc_id."""
    for told, row in met(batches):
        if not told:
            continue
        batch = Batch(row)
        words = Words(batch)
        at, h, h2 = _candidates(words, np.sort(np.concatenate([unplanes(r["doc_ids"], width) for r in told])), block, window, width)
        if not len(at):
            continue
        order = np.lexsort((at, h2, h))
        at, h, h2 = at[order], h[order], h2[order]
        heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))
        at, h, h2 = at[heads], h[heads], h2[heads]
        ids = batch.ids[words.doc[at]].view(np.uint64) ^ np.uint64(1 << 63)  # in unsigned order
        yield from _dealt(batch.number, h, buckets, 64, 8, lambda a, b, x=h2, y=ids: planes(x[a:b], 4) + planes(y[a:b]))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: to each batch the windows whose first start is in another one."""
    for held in _buckets(batches):
        sizes = [len(r["hashes"]) // 8 for r in held]
        h = np.concatenate([unplanes(r["hashes"]) for r in held])
        h2 = np.concatenate([unplanes(r["flags"][: 4 * n], 4) for r, n in zip(held, sizes, strict=True)])
        ids = np.concatenate([unplanes(r["flags"][4 * n :]) for r, n in zip(held, sizes, strict=True)])
        number = np.repeat(np.array([r["batch"] for r in held], np.int64), sizes)
        order = np.lexsort((number, ids, h2, h))
        a, b = h[order], h2[order]
        later = np.empty(len(h), bool)
        later[order] = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        rows, start = [], 0
        for r, n in zip(held, sizes, strict=True):
            mine = later[start : start + n]
            if mine.any():
                rows.append((r["batch"], 0, planes(h[start : start + n][mine]), b"", b"", b"", b""))
            start += n
        if rows:
            yield binary_batch(TOLD, rows)


OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"


def _cut(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for told, row in met(batches):
        batch = Batch(row)
        words = Words(batch)
        at, h = words.runs(window, _ODD)
        _, h2 = words.runs(window, _ODD2)
        h2 = h2 >> np.uint64(32)
        gone = np.zeros(len(words.words) + 1, np.int64)
        if len(at):
            order = np.lexsort((at, h2, h))
            a, b = h[order], h2[order]
            repeat = np.empty(len(at), bool)
            repeat[order] = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
            if told:
                # an answer is compared with the windows of this batch only, so 64 bits do
                repeat |= is_in(h, np.sort(np.concatenate([unplanes(r["doc_ids"]) for r in told])))
            np.add.at(gone, at[repeat], 1)
            np.add.at(gone, at[repeat] + window, -1)
        removed = np.cumsum(gone)[:-1] > 0
        columns: list[list] = [[], [], [], [], []]
        for i in range(len(batch.lens)):
            s, e = int(words.starts[i]), int(words.starts[i + 1])
            out = removed[s:e]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]))).tolist()
            kept = b" ".join([w for w, r in zip(words.words[s:e], out.tolist(), strict=True) if not r]) if edges else b" ".join(words.words[s:e])
            text = hashlib.sha256(kept).hexdigest() if digest else kept.decode()
            spans = None if digest else [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)]
            for column, value in zip(columns, (batch.id(i), e - s, int(out.sum()), spans, text), strict=True):
                column.append(value)
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()), strict=True)]
        yield pa.record_batch(arrays, names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 20, digest: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, spans (runs of removed words) and kept_text.

    Removes every word covered by a window of words that also starts earlier. With digest,
    kept_text is its SHA-256 and spans are null.
    """
    spark = arrow_session(docs.sparkSession)
    block, n = window // 2, n_buckets(spark)
    dealt = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    sent = "bucket int, batch long, hashes binary, flags binary"
    staged = stage_batches(docs, batch_bytes(spark))
    # about one entry per word; one block in 32 may look hit by chance
    entries = staged.count() * batch_bytes(spark) / 6
    width = min(8, max(5, math.ceil((math.log2(entries + 1) + 5) / 8)))
    hits = dealt(staged.mapInArrow(partial(_anchors, block=block, buckets=n, width=width), sent)).mapInArrow(partial(_hit_blocks, width=width), TOLD_SCHEMA)
    windows = meet(staged, hits).mapInArrow(partial(_windows, block=block, window=window, buckets=n, width=width), sent)
    later = dealt(windows).mapInArrow(_later, TOLD_SCHEMA)
    return meet(staged, later).mapInArrow(partial(_cut, window=window, digest=digest), OUT)


def op1_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20, digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept_text").alias("kept_sha256"))
