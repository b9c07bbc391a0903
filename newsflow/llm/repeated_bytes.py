"""Operator 5: substring dedup on bytes by merging shard Burrows-Wheeler transforms.

Every ``length``-byte string has one anchor: the leftmost place in it whose 32-byte gram has
the least hash (short grams repeat by chance, and then strangers would meet). Equal strings
have equal anchors at equal places, so only the suffixes at anchors are kept, about 2 / length
of them per byte, and of these only those whose anchor occurs twice.

(A) Batches of documents, the shards, send the hashes of their anchors; buckets answer which
occur twice. (B) For these a shard makes its transform: its suffixes from the anchor on, cut
off where no string can reach, sorted, with what precedes each (the column that makes a
transform of a sorted list of suffixes, here the whole left context instead of one symbol, and
its order as well), and the common prefix of each with its predecessor. Equal entries of a
shard are sent once. (C) A bucket merges the shards' lists by iterative interleave refinement:
the interleave starts as one list behind the other and each round refines its intervals by the
next eight bytes. Entries of one shard keep their order and those whose known common prefix
goes beyond the round move as one, so no suffixes are sorted again; an interval is finished
when all of it comes from one shard. The round in which entries of different shards part gives
their common prefix. The tree of these prefixes is walked from the deepest interval up, always
joining the smaller set of left contexts to the larger: the neighbours in left order give, for
each depth, the longest match to both sides of an anchor, and where it has ``length`` bytes the
covered range goes back to the shard. (D) Shards cut the ranges out.

An anchor that occurs more than ``hot`` times is not merged in one place: for each of its
occurrences every window of the length that holds it is sent as a 128-bit hash, dealt by that
hash, and the repeated ones are answered. So a passage that a third of all documents share is
spread over all buckets by what surrounds it. Elsewhere bytes are compared and hashes only
select. Texts stay in their shards.

Defined results: null text is empty; null and repeated doc_ids are kept as they are; columns
other than doc_id and text are not read; lengths from 16 to 65,535.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.repeated_words import TOLD, TOLD_SCHEMA, meet, met
from newsflow.llm.shared import Batch, arrow_session, batch_bytes, binary_batch, is_in, mix, n_buckets, planes, rows_of, stage_batches, unplanes

_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Entries that a bucket merges in one go (whole groups).
MERGED_AT_ONCE = 20_000
#: Occurrences beyond which an anchor is dealt by windows.
HOT = 4096
#: Bytes of a count.
COUNT = 4
#: Anchors are a fifteenth of the text, so fewer buckets do for their hashes.
FEWER = 8


def gram_of(length: int) -> int:
    """Bytes of the gram by which strings of that length are anchored; the result doesn't depend on it."""
    return 32 if length >= 128 else 8


def _eights(text: bytes) -> np.ndarray:
    """The eight bytes at every place as an integer."""
    raw = np.frombuffer(text, np.uint8)
    eight = np.empty(max(0, len(raw) - 7), np.uint64)
    for k in range(min(8, len(eight))):
        eight[k::8] = raw[k : k + 8 * ((len(raw) - k) // 8)].view("<u8")
    return eight


def grams(text: bytes, gram: int) -> np.ndarray:
    """The hash of that many bytes, a multiple of eight, at every place."""
    if len(text) < gram:
        return np.empty(0, np.uint64)
    eight, n = _eights(text), len(text) - gram + 1
    out = eight[:n].copy()
    for k in range(8, gram, 8):
        out *= _ODD
        out += eight[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def window_hashes(text: bytes, length: int, seed: int) -> np.ndarray:
    """The hash of that many bytes at every place, by doubling; two overlapping powers of two make the length."""
    if len(text) < length:
        return np.empty(0, np.uint64)
    h, have = mix(_eights(text) ^ np.uint64(seed)), 8
    while 2 * have <= length:
        h, have = mix(h[:-have] * _ODD + h[have:]), 2 * have
    return mix(h[: len(text) - length + 1] * _ODD + h[length - have :])


def anchors(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings within documents, and their hashes."""
    h, window = grams(text, gram_of(length)), length - gram_of(length) + 1
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # least value of the windows that start at each place and the leftmost place that has it, by doubling
    least, at, have = h, np.arange(len(h), dtype=np.int32 if len(h) < 1 << 31 else np.int64), 1
    while have < window:
        step = min(have, window - have)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.minimum(least[:-step], least[step:])
        have += step
    ok = np.ones(len(least), bool)
    for s in starts[1:-1].tolist():
        ok[max(0, s - length + 1) : s] = False
    place = np.unique(at[ok]).astype(np.int64)
    return place, h[place]


def _with_anchors(text: bytes, starts: np.ndarray, length: int) -> list[bytes]:
    place, h = anchors(text, starts, length)
    return [place.astype(np.uint32).tobytes() if len(text) < 1 << 32 else place.astype(np.uint64).tobytes(), h.tobytes()]


def _send_hashes(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, batch, hashes, counts); a batch has fewer than 2**32 anchors."""
    for row in rows_of(batches):
        h = np.frombuffer(row["hashes"], np.uint64)
        if not len(h):
            continue
        value, count = np.unique(h, return_counts=True)
        to = (value % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        value, count, to = value[order], count[order], to[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1)).tolist()
        yield binary_batch(["bucket", "batch", "hashes", "counts"], [(int(to[a]), row["batch"], value[a:b].tobytes(), planes(count[a:b], COUNT)) for a, b in zip(cuts, cuts[1:], strict=False)])


def _partition_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in rows_of(batches):
        if held and held[0][key] != row[key]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _repeated_anchors(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """To each batch its anchors that occur twice, and which of them occur more than hot times."""
    for held in _partition_rows(batches, "bucket"):
        value = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in held])
        count = np.concatenate([unplanes(r["counts"], COUNT) for r in held])
        _, inverse = np.unique(value, return_inverse=True)
        total = np.bincount(inverse, count)[inverse]
        rows, start = [], 0
        for r in held:
            v, c = (x[start : start + len(r["counts"]) // COUNT] for x in (value, total))
            start += len(v)
            if (c > 1).any():
                rows.append((r["batch"], 0, v[c > 1].tobytes(), v[c > hot].tobytes(), b"", b"", b""))
        if rows:
            yield binary_batch(TOLD, rows)


class Shard:
    """The anchors of a batch and the contexts around them that strings can reach."""

    def __init__(self, row: dict, length: int):
        self.batch = Batch(row)
        raw = row["more"]
        self.place = np.frombuffer(raw, np.uint32 if len(self.batch.text) < 1 << 32 else np.uint64).astype(np.int64)
        doc = np.searchsorted(self.batch.starts, self.place, "right") - 1
        self.gram = gram_of(length)
        self.left = np.maximum(self.batch.starts[doc], self.place - (length - self.gram))
        self.end = self.batch.starts[doc + 1]
        self.right = np.minimum(self.end, self.place + length)

    def hashes(self) -> np.ndarray:
        h = grams(self.batch.text, self.gram)
        return h[self.place] if len(self.place) else np.empty(0, np.uint64)


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes a column, padded, and the sizes."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    width = -(-int(sizes.max(initial=0)) // 8) * 8 + 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), ">u8").reshape(len(strings), width // 8), sizes


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that eight-byte symbols have in common."""
    differ = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    return np.where(differ.any(axis=1), differ.argmax(axis=1), 8)


def common_prefixes(strings: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Of each string with its predecessor, -1 for the first of a group."""
    out = np.full(len(strings), -1, np.int64)
    for k in range(0, len(strings), step := 4096):
        symbols, sizes = _matrix(strings[max(0, k - 1) : k + step])
        if len(symbols) < 2:
            continue
        word = (symbols[1:] != symbols[:-1]).argmax(axis=1)
        rows = np.arange(len(word))
        same = (symbols[1:] == symbols[:-1]).all(axis=1)
        equal = word * 8 + _equal_bytes(symbols[rows, word], symbols[rows + 1, word])
        least = np.minimum(sizes[1:], sizes[:-1])
        out[max(0, k - 1) + 1 : max(0, k - 1) + 1 + len(word)] = np.where(same, least, np.minimum(equal, least))
    out[np.concatenate([[True], groups[1:] != groups[:-1]]) if len(out) else []] = -1
    return out


#: An entry of a transform: anchor, its place, size of the left context, whether the shard has it again, size of both contexts, common prefix
#: with the entry before, place in the order of left contexts and the common left context with the entry before in that order.
META = np.dtype([("h", "<u8"), ("place", "<i8"), ("before", "<u2"), ("again", "u1"), ("size", "<u4"), ("prefix", "<i4"), ("left_at", "<u4"), ("left_prefix", "<i4")])


def transform_of(shard: Shard, h: np.ndarray, chosen: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """The shard's sorted suffixes at the chosen anchors with their left contexts, in the order of buckets and anchors."""
    text, found = shard.batch.text, {}
    for k in chosen.tolist():
        a, p, b = int(shard.left[k]), int(shard.place[k]), int(shard.right[k])
        key = (int(h[k]) % buckets, int(h[k]), text[p:b], text[a:p][::-1])
        if key in found:
            found[key][1] = 1
        else:
            found[key] = [p, 0]
    entries = sorted(found)
    meta = np.zeros(len(entries), META)
    meta["h"], meta["before"], meta["size"] = [e[1] for e in entries], [len(e[3]) for e in entries], [len(e[2]) + len(e[3]) for e in entries]
    meta["place"], meta["again"] = [found[e][0] for e in entries], [found[e][1] for e in entries]
    meta["prefix"] = common_prefixes([e[2] for e in entries], meta["h"])
    by_left = sorted(range(len(entries)), key=lambda i: (entries[i][0], entries[i][1], entries[i][3]))
    meta["left_at"][by_left] = np.arange(len(entries))
    meta["left_prefix"][by_left] = common_prefixes([entries[i][3] for i in by_left], meta["h"][by_left])
    return meta, [e[3][::-1] + e[2] for e in entries]


def _entries(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, kind, batch, meta, bodies): kind 0 is a part of the shard's transform, kind 1 has windows around hot anchors."""
    squeeze = zstandard.ZstdCompressor(level=6)
    for told, row in met(batches):
        if not told:
            continue
        shard, rows = Shard(row, length), []
        h = shard.hashes()
        known, hot = (np.sort(np.concatenate([np.frombuffer(r[c], np.uint64) for r in told])) for c in ("doc_ids", "missing"))
        is_hot = is_in(h, hot)
        meta, bodies = transform_of(shard, h, np.flatnonzero(is_in(h, known) & ~is_hot), buckets)
        cuts = np.flatnonzero(np.diff((meta["h"] % np.uint64(buckets)).astype(np.int64), prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows.append((int(meta["h"][a]) % buckets, 0, shard.batch.number, meta[a:b].tobytes(), squeeze.compress(b"".join(bodies[a:b]))))
        if is_hot.any():
            rows += _windows(shard, is_hot, length, buckets)
        if rows:
            yield binary_batch(["bucket", "kind", "batch", "meta", "bodies"], rows)


def _windows(shard: Shard, hot: np.ndarray, length: int, buckets: int) -> list[tuple]:
    """Rows with the distinct windows that hold a hot anchor, as two hashes, and whether the shard has them again."""
    wanted = np.zeros(len(shard.batch.text) + 2, np.int64)
    begin, end = shard.left[hot], np.minimum(shard.place[hot], shard.end[hot] - length) + 1
    np.add.at(wanted, begin[begin < end], 1)
    np.add.at(wanted, end[begin < end], -1)
    at = np.flatnonzero(np.cumsum(wanted) > 0)
    w1, w2 = (window_hashes(shard.batch.text, length, seed)[at] for seed in (1, 2))
    to = (w1 % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((w2, w1, to))
    w1, w2, to = w1[order], w2[order], to[order]
    heads = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])) if len(w1) else np.empty(0, np.int64)
    again = np.diff(np.concatenate([heads, [len(w1)]])) > 1
    w1, w2, to = w1[heads], w2[heads], to[heads]
    cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1)).tolist()
    return [(int(to[a]), 1, shard.batch.number, w1[a:b].tobytes() + w2[a:b].tobytes(), again[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]


def _repeated_windows(held: list[dict]) -> list[tuple]:
    """To each batch its windows that occur twice."""
    w1, w2 = (np.concatenate([np.frombuffer(r["meta"], np.uint64).reshape(2, -1)[k] for r in held]) for k in (0, 1))
    again = np.concatenate([np.frombuffer(r["bodies"], bool) for r in held])
    order = np.lexsort((w2, w1))
    a, b = w1[order], w2[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    size = np.diff(np.concatenate([heads, [len(a)]]))
    told = np.empty(len(a), bool)
    told[order] = np.repeat((size > 1) | np.logical_or.reduceat(again[order], heads), size)
    rows, start = [], 0
    for r in held:
        mine = slice(start, start + len(r["bodies"]))
        start = mine.stop
        if told[mine].any():
            rows.append((r["batch"], 0, b"", w1[mine][told[mine]].tobytes(), b"", b"", b""))
    return rows


def interleave(strings: list[bytes], groups: np.ndarray, shards: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of the shards' lists in each group, and the common prefix of each entry with its predecessor there.

    Entries come group by group and in each group shard by shard, sorted; known is the common
    prefix with the predecessor in the shard's own list, -1 for its first. Each round refines
    the intervals that hold entries of several shards by the next eight bytes.
    """
    symbols, sizes = _matrix(strings)
    n = len(strings)
    order, interval, prefix, depth = np.arange(n), np.searchsorted(groups, groups), np.zeros(n, np.int64), 0

    def several(first: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Whether the interval that begins there holds more than one shard."""
        return np.bincount(first, shard != shard[first], len(first))[first] > 0

    active = np.flatnonzero(several(interval, shards))
    while len(active):
        who, where = order[active], interval[active]
        # entries of one shard that agree beyond this round move as one
        heads = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (who[1:] != who[:-1] + 1) | (known[who[1:]] < 8 * (depth + 1))]))
        lead = who[heads]
        symbol, left = symbols[lead, depth].astype(np.uint64), np.clip(sizes[lead] - depth * 8, 0, 8)
        by = np.lexsort((left, symbol, where[heads]))  # stable: a shard's order stays
        size = np.diff(np.concatenate([heads, [len(who)]]))[by]
        take = np.repeat(heads[by] - (np.cumsum(size) - size), size) + np.arange(len(who))
        order[active] = who = who[take]
        symbol, left = np.repeat(symbol[by], size), np.repeat(left[by], size)
        same = where[1:] == where[:-1]
        parts = (symbol[1:] != symbol[:-1]) | (left[1:] != left[:-1])
        cut = np.flatnonzero(same & parts)
        prefix[active[cut + 1]] = depth * 8 + np.minimum(_equal_bytes(symbol[cut], symbol[cut + 1]), np.minimum(left[cut], left[cut + 1]))
        begins = np.concatenate([[True], ~same | parts])
        first = np.maximum.accumulate(np.where(begins, np.arange(len(active)), 0))
        interval[active] = active[first]
        ended = (left < 8) & ~begins
        prefix[active[ended]] = depth * 8 + left[ended]
        active = active[several(first, shards[who]) & (left == 8)]
        depth += 1
    # neighbours from one shard are neighbours in its list
    own = np.concatenate([[False], order[1:] == order[:-1] + 1]) & (known[order] >= 0) if n else np.empty(0, bool)
    prefix[own] = known[order[own]]
    return order, prefix


def matches(lefts: list[bytes], rights: list[bytes], again: list[bool], groups: np.ndarray, shards: np.ndarray, known: np.ndarray, by_left: np.ndarray, left_known: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """For each entry how far strings of the length that others share reach to the left and to the right of its anchor; zeros for none.

    lefts are reversed, by_left lists the entries in the shards' orders of left contexts.
    """
    n, ends = len(rights), groups.tolist()
    low, high = [0] * n, [0] * n
    for k in range(n):
        if again[k] and len(lefts[k]) + len(rights[k]) >= length:
            low[k], high[k] = len(lefts[k]), len(rights[k])
    order, prefix = (x.tolist() for x in interleave(rights, groups, shards, known))
    left_order, left_prefix = interleave([lefts[k] for k in by_left.tolist()], groups, shards[by_left], left_known)
    left_order = by_left[left_order]
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    rank, left_order = rank.tolist(), left_order.tolist()
    # least common left context over a range of ranks
    table = [left_prefix]
    while 2 << len(table) <= 2 * n:
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    lists = [t.tolist() for t in table]

    def meets(a: int, b: int, depth: int) -> None:
        level = (b - a).bit_length() - 1
        both = min(lists[level][a + 1], lists[level][b - (1 << level) + 1])
        if both + depth >= length:
            for e in (left_order[a], left_order[b]):
                low[e], high[e] = max(low[e], both), max(high[e], depth)

    # intervals of the merged order, deepest first: stacks of depths and of left ranks
    sets: list[list[int]] = []
    depths: list[int] = []

    def join() -> None:
        depth, small, large = depths.pop(), sets.pop(), sets.pop()
        if len(small) > len(large):
            small, large = large, small
        for r in small:
            at = bisect_left(large, r)
            if at:
                meets(large[at - 1], r, depth)
            if at < len(large):
                meets(r, large[at], depth)
            large.insert(at, r)
        sets.append(large)

    for k in range(n):
        if k and ends[k] == ends[k - 1]:
            while depths and depths[-1] > prefix[k]:
                join()
            depths.append(prefix[k])
        else:
            while depths:
                join()
            sets.clear()
        sets.append([rank[order[k]]])
    while depths:
        join()
    return low, high


def _ranges(held: list[dict], length: int) -> list[tuple]:
    """The merged transforms of a bucket: to each batch (place, from, until) of what its entries share."""
    open_ = zstandard.ZstdDecompressor()
    parts, bodies = [np.frombuffer(r["meta"], META) for r in held], [open_.decompress(r["bodies"]) for r in held]
    meta, row = np.concatenate(parts), np.repeat(np.arange(len(held)), [len(p) for p in parts])
    ends = np.concatenate([np.cumsum(p["size"], dtype=np.int64) for p in parts])
    order = np.argsort(meta["h"], kind="stable")
    low, high = np.zeros(len(meta), np.int64), np.zeros(len(meta), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(meta["h"][order]) != 0, [True]]))
    start = 0
    while start < len(order):
        until = int(heads[max(np.searchsorted(heads, start + MERGED_AT_ONCE, "right") - 1, np.searchsorted(heads, start, "right"))])
        mine = order[start:until]
        m, shards = meta[mine], row[mine]
        texts = [bodies[r][e - s : e] for r, e, s in zip(shards.tolist(), ends[mine].tolist(), m["size"].tolist(), strict=True)]
        before, groups = m["before"].tolist(), np.searchsorted(m["h"], m["h"])
        by_left = np.lexsort((m["left_at"], shards, groups))
        low[mine], high[mine] = matches([t[:b][::-1] for t, b in zip(texts, before, strict=True)], [t[b:] for t, b in zip(texts, before, strict=True)], m["again"].astype(bool).tolist(), groups, shards, m["prefix"].astype(np.int64), by_left, m["left_prefix"][by_left].astype(np.int64), length)
        start = until
    rows = []
    for k, r in enumerate(held):
        told = (row == k) & (high > 0)
        if told.any():
            place = meta["place"][told]
            rows.append((r["batch"], 0, np.column_stack([place, place - low[told], place + high[told]]).tobytes(), b"", b"", b"", b""))
    return rows


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for held in _partition_rows(batches, "bucket"):
        lists, windows = ([r for r in held if r["kind"] == kind] for kind in (0, 1))
        rows = (_ranges(lists, length) if lists else []) + (_repeated_windows(windows) if windows else [])
        if rows:
            yield binary_batch(TOLD, rows)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for told, row in met(batches):
        shard = Shard(row, length)
        batch, text = shard.batch, shard.batch.text
        gone = np.zeros(len(text) + 1, np.int64)
        ranges = np.concatenate([np.frombuffer(r["doc_ids"], np.int64).reshape(-1, 3) for r in told]) if told else np.empty((0, 3), np.int64)
        windows = np.sort(np.concatenate([np.frombuffer(r["missing"], np.uint64) for r in told])) if told else np.empty(0, np.uint64)
        if len(ranges):
            # ranges were sent for one of several equal entries of this shard
            same: dict[tuple[int, bytes], list[int]] = {}
            known = {int(p): k for k, p in enumerate(shard.place.tolist())}
            body = lambda k: (int(shard.place[k] - shard.left[k]), text[shard.left[k] : shard.right[k]])
            h = shard.hashes()
            wanted = np.isin(h, h[[known[p] for p in np.unique(ranges[:, 0]).tolist()]])
            for k in np.flatnonzero(wanted).tolist():
                same.setdefault(body(k), []).append(int(shard.place[k]))
            for p, a, b in ranges.tolist():
                for q in same[body(known[p])]:
                    gone[q + a - p] += 1
                    gone[q + b - p] -= 1
        if len(windows):
            # an answer is compared with the windows of this batch only, so 64 bits do
            hit = is_in(window_hashes(text, length, 1), windows)
            for s in batch.starts[1:-1].tolist():
                hit[max(0, s - length + 1) : s] = False
            at = np.flatnonzero(hit)
            gone[at] += 1
            gone[at + length] -= 1
        removed = np.cumsum(gone)[:-1] > 0
        columns: list[list] = [[], [], [], [], [], []]
        for i, (s, e) in enumerate(zip(batch.starts[:-1].tolist(), batch.starts[1:].tolist(), strict=True)):
            out = removed[s:e]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]))).tolist()
            gaps = [0, *edges, e - s]
            kept = b"".join(text[s + a : s + b] for a, b in zip(gaps[::2], gaps[1::2], strict=True))
            spans = None if digest else [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            kept = hashlib.sha256(kept).hexdigest().encode() if digest else kept
            for column, value in zip(columns, (batch.id(i), e - s, int(out.sum()), len(edges) // 2, spans, kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400, digest: bool = False, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, spans and kept bytes.

    Removes every byte covered by a string of the length that also starts elsewhere. With
    digest, kept is the hexadecimal SHA-256 and spans are null.
    """
    if not 16 <= length <= 65_535:
        raise ValueError("length must be 16 to 65,535 bytes")
    spark = arrow_session(docs.sparkSession)
    n = n_buckets(spark)
    dealt = lambda df, buckets=n: df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    staged = stage_batches(docs, batch_bytes(spark), partial(_with_anchors, length=length), "more binary, hashes binary")
    few = max(1, n // FEWER)
    sent = staged.select("batch", "hashes").mapInArrow(partial(_send_hashes, buckets=few), "bucket int, batch long, hashes binary, counts binary")
    repeated = dealt(sent, few).mapInArrow(partial(_repeated_anchors, hot=hot), TOLD_SCHEMA)
    entries = meet(staged, repeated).mapInArrow(partial(_entries, length=length, buckets=n), "bucket int, kind int, batch long, meta binary, bodies binary")
    ranges = dealt(entries).mapInArrow(partial(_merge, length=length), TOLD_SCHEMA)
    return meet(staged, ranges).mapInArrow(partial(_cut, length=length, digest=digest), OUT)


def op5_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400, digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
