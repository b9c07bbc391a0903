"""Operator 4: near-duplicates by SimHash, compared through pivot distance tables.

Each text gets a 64-bit fingerprint; equal fingerprints form one class. Every class carries
its Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality two
fingerprints within ``radius`` bits differ by at most ``radius`` in every coordinate of that
table, so a pair whose largest coordinate difference exceeds it is discarded and only the
survivors are verified bit by bit.

Classes meet in cells: the bits are cut into ``radius + 2`` blocks, at least two of which are
equal for any pair that links, so a class joins one cell for each pair of blocks and no link
is lost. A cell with many classes is cut again by pairs of blocks of its other bits. A cell walks its table in the order of the first coordinate, emits only a spanning
forest of the links it finds and never all pairs; connected components then grow over the
shared cells by star contraction, with all links and labels in distributed tables.

Links of 0.8 shingle similarity need wider fingerprints and a radius at which no distance to
a fixed pivot discards anything (those of strangers are 128 of 256 bits, give or take 8), and
their cells by blocks of bits would hold most of a corpus. ``one_of_each`` therefore meets in
cells of equal least shingle hashes and takes each cell's pivots from the cell itself: copies
are near one of them and strangers are not, so the table discards again. Fingerprints within
``DEVIATIONS`` standard deviations only make candidates; a pair becomes a link when the exact
similarity of its shingle sets is large enough.

No group is one task's work: one with more than a stated number of members is dealt into parts,
each of which links its own members. Nearly all of a group of copies is connected then, over
its parts of this and other cells. Who is not in the group's largest component is sent to all
of its parts and compared there, so every pair that is not connected already meets (``joined``).

Defined results: null text counts as empty; a text without words has fingerprint zero and
links like any other; a null doc_id keeps its fingerprint and its class, but never names a
component unless all members are null; rows that repeat a doc_id each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.shared import arrow_rows, arrow_session, mix, scratch_table, shared_folder
from newsflow.operators.components import components

PIVOTS = 24
#: Fingerprints of a cell of equal blocks that one task compares; larger cells are cut again, up to LEVELS times.
BIT_CELL, LEVELS = 4096, 3
#: Words of a wide fingerprint; cells of a text, each of ROWS least hashes.
WIDE = 4
BANDS, ROWS = 16, 4
#: Standard deviations of the bits by which candidates may differ; small sets differ in up to 48 bits on average at 0.8, not 39.
DEVIATIONS = 5
#: Fingerprints of a cell, and shingle sets of a candidate group, that one task compares; larger groups are dealt into parts.
CELL, TOGETHER = 1024, 256
#: Groups that are dealt into parts are broadcast with their numbers up to so many rows of 24 bytes.
BROADCAST_ROWS = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased word shingles, repeats included; none without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; signed."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):  # a long text's bit matrix stays small
        part = h[k : k + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit set if it is set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    return majority(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (signed 64-bit)."""
    arrow_session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed, spread evenly over all 64-bit values."""
    return mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def blocks(bits: list[int], radius: int) -> list[list[int]]:
    """Places of bits, cut into radius + 2 runs."""
    edges = [round(len(bits) * k / (radius + 2)) for k in range(radius + 3)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def free_bits(path: int, level: int, radius: int) -> list[int]:
    """The bits that are not fixed in a cell of that level; path names the pair of blocks of each level above."""
    bits, pairs = list(range(64)), list(combinations(range(radius + 2), 2))
    for k in range(level):
        cut = blocks(bits, radius)
        fixed = {bit for block in pairs[path // len(pairs) ** k % len(pairs)] for bit in cut[block]}
        bits = [bit for bit in bits if bit not in fixed]
    return bits


def _to_cells(batches: Iterator[pa.RecordBatch], radius: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, path, fp) go to one finer cell for each pair of blocks of the bits that are still free."""
    pairs = list(combinations(range(radius + 2), 2))
    for batch in batches:
        cell, path, fp = (batch.column(k).to_numpy() for k in range(3))
        fp = fp.view(np.uint64)
        for way in np.unique(path).tolist():
            mine = np.flatnonzero(path == way)
            cut = blocks(free_bits(way, level, radius), radius)
            for k, pair in enumerate(pairs):
                mask = np.uint64(sum(1 << bit for block in pair for bit in cut[block]))
                # cells that share a key by chance only compare more
                key = mix(mix((fp[mine] & mask) ^ np.uint64(k + 1)) ^ cell[mine].view(np.uint64))
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(len(mine), way + k * len(pairs) ** level)), pa.array(fp[mine].view(np.int64))], names=["cell", "path", "fp"])


def cell_forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links among distinct fingerprints of one cell, found through the pivot table."""
    n = len(fp)
    table = np.empty((PIVOTS, n), np.int8)
    for k, p in enumerate(pivots()):
        table[k] = np.bitwise_count(fp ^ p)
    order = np.argsort(table[0], kind="stable")
    fp, table = fp[order], table[:, order]
    until = np.searchsorted(table[0], table[0] + radius, "right")
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, left = [], n
    for i in range(n):
        if left == 1:
            break
        near = np.arange(i + 1, until[i])
        for k in range(1, PIVOTS):
            if not len(near):
                break
            near = near[np.abs(table[k, near] - table[k, i]) <= radius]
            if len(near) < 8:
                break
        if len(near):
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= radius]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                left -= 1
                links.append((i, j))
    signed = fp.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def _cell_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by cell -> links. A cell may go on in the next Arrow batch."""

    def emit(fps: np.ndarray, out: list) -> None:
        if len(fps) > 1:
            out += cell_forest(np.unique(fps).view(np.uint64), radius)

    held_cell, held = None, []
    for batch in batches:
        cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(cell)) + 1
        links: list = []
        for c, part in zip(cell[np.concatenate([[0], cuts])].tolist() if len(cell) else [], np.split(fp, cuts), strict=False):
            if c != held_cell:
                if held:
                    emit(np.concatenate(held), links)
                held_cell, held = c, []
            held.append(part)
        if links:
            yield _link_batch(links)
    links = []
    if held:
        emit(np.concatenate(held), links)
    if links:
        yield _link_batch(links)


def _link_batch(links: list) -> pa.RecordBatch:
    a, b = np.array(links, np.int64).T
    return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def links(classes: DataFrame, radius: int = 3, most: int = BIT_CELL) -> DataFrame:
    """classes(fp), distinct -> a, b: links within the radius that connect what is connected.

    A cell of more than ``most`` fingerprints is cut again by pairs of blocks of its free bits,
    two of which are equal for each of its links as well: for a radius of 3 about 38 bits stay
    free, then 23, then 14 (16 at most), so that a cell of the last level has at most 65,536
    distinct fingerprints, and if it has many, most of them link.
    """
    spark = classes.sparkSession
    finer = lambda df, level: df.select("cell", "path", "fp").mapInArrow(partial(_to_cells, radius=radius, level=level), "cell long, path long, fp long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cells, small = finer(classes.selectExpr("0L as cell", "0L as path", "fp"), 0), []
    for level in range(1, LEVELS):
        large = cells.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > most).select("cell", F.lit(True).alias("large")).checkpoint()
        n_large = large.count()
        if not n_large:
            break
        sized = cells.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "cell", "left")
        small.append(sized.where("large is null").select("cell", "path", "fp"))
        cells = scratch_table(finer(sized.where("large"), level), f"cells{level}")
    for part in small:
        cells = cells.unionByName(part)
    dealt = cells.select("cell", "fp").repartition(n, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(partial(_cell_links, radius=radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id (the smallest doc_id that links reach)."""
    shared_folder(docs.sparkSession)
    prints = fingerprints(docs, shingle).checkpoint()
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), radius))
    # a class without links is its own component
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")).checkpoint()
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def most_different(similarity: float, deviations: float = 1) -> int:
    """Bits of a wide fingerprint by which texts of that shingle similarity differ, some standard deviations included.

    Equal sizes are assumed, where the angle is widest: that between two shingle sets is
    acos(2 s / (1 + s)), and a bit differs with probability angle / pi. Five of six pairs at
    exactly the similarity are within one deviation.
    """
    bits = 64 * WIDE
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The wide fingerprint of a set of shingle hashes (zero without any) and its BANDS cells."""
    wide = np.array([majority(mix(h ^ salt)) for salt in _salts(WIDE)], np.int64).tobytes()
    if not len(h):
        return wide, [0] * BANDS
    factors = _salts(BANDS * ROWS) | np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, (factors[:, None] * h[None, k : k + 4096]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ part)
    return wide, key.view(np.int64).tolist()


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(101, 101 + n, dtype=np.uint64))


def shingle_set(text: pa.Scalar, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle))


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The text, which comes first, is replaced by node (a hash of its set of shingles), fp and cells."""
    for batch in batches:
        sets = [shingle_set(t, shingle) for t in batch.column(0)]
        found = [sketch(h) for h in sets]
        node = np.array([xxhash.xxh64_intdigest(h.tobytes(), 43) for h in sets], np.uint64).view(np.int64)
        wide, cells = pa.array([w for w, _ in found], pa.binary()), pa.array([c for _, c in found], pa.list_(pa.int64()))
        yield pa.record_batch([*batch.columns[1:], pa.array(node), wide, cells], names=[*batch.schema.names[1:], "node", "fp", "cells"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The text, which comes first, is replaced by its set of shingle hashes."""
    for batch in batches:
        sets = pa.array([shingle_set(t, shingle).tobytes() for t in batch.column(0)], pa.binary())
        yield pa.record_batch([*batch.columns[1:], sets], names=[*batch.schema.names[1:], "shingles"])


def near_links(fp: np.ndarray, label: np.ndarray, own: np.ndarray, radius: int, verify=None) -> list[tuple[int, int]]:
    """Links (places) that connect what pairs of wide fingerprints within the radius connect, one of each pair being an own row.

    Rows of one label are connected already and not compared. What the table of distances to
    pivots among the rows discards is not looked at; verify(i, near) may discard more.
    """
    n, label, links = len(fp), label.copy(), []
    table = [np.bitwise_count(fp ^ fp[p]).sum(axis=1, dtype=np.int16) for p in np.linspace(0, n - 1, min(PIVOTS, n // 8), dtype=int)]
    for i in np.flatnonzero(own).tolist():
        near = np.flatnonzero(label != label[i])
        if not len(near) and own.all():
            break
        for row in table:
            if len(near) < 8:
                break
            near = near[np.abs(row[near] - row[i]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[i]).sum(axis=1) <= radius]
        if verify is not None and len(near):
            near = verify(i, near)
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            links += [(i, j) for j in near[first].tolist()]
            label[np.isin(label, others)] = label[i]
    return links


class ShingleSets:
    """Sets of shingle hashes of a group, for exact similarities."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes, self.similarity = np.array([len(h) for h in sets]), similarity
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.marked = np.zeros(len(values), bool)

    def part(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] - self.sizes[k] : self.ends[k]]

    def verify(self, i: int, near: np.ndarray) -> np.ndarray:
        """Those of near whose set has the similarity to that of i."""
        sizes, s = self.sizes, self.similarity
        near = near[np.minimum(sizes[near], sizes[i]) >= s * np.maximum(sizes[near], sizes[i]) - 0.5]
        self.marked[self.part(i)] = True
        same = np.array([np.count_nonzero(self.marked[self.part(j)]) for j in near.tolist()], np.int64)
        self.marked[self.part(i)] = False
        return near[same / np.maximum(sizes[near] + sizes[i] - same, 1) >= s]


def _group_links(batches: Iterator[pa.RecordBatch], radius: int, similarity: float | None = None) -> Iterator[pa.RecordBatch]:
    """Partitions (group, part, own, label, node, fp) sorted by group and part -> links between nodes; with a similarity there are shingles, too, and links are verified.

    A part may go on in the next Arrow batch.
    """
    held_key, held = None, []

    def emit() -> Iterator[pa.RecordBatch]:
        own, label, node, fp = (np.concatenate([h[k] for h in held]) for k in range(4))
        if len(node) < 2:
            return
        sets = [np.frombuffer(x, np.uint64) for h in held for x in h[4]]
        found = near_links(fp, label, own, radius, ShingleSets(sets, similarity).verify if sets else None)
        if found:
            yield _link_batch([(int(node[i]), int(node[j])) for i, j in found])

    for batch in batches:
        group, part, label, node = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
        own = batch.column(2).to_numpy(zero_copy_only=False)
        fp = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, WIDE)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(group) != 0) | (np.diff(part) != 0)) + 1, [len(group)]]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if (group[a], part[a]) != held_key:
                if len(held) > 1 or held and len(held[0][0]) > 1:
                    yield from emit()
                held_key, held = (group[a], part[a]), []
            held.append((own[a:b], label[a:b], node[a:b], fp[a:b], [] if similarity is None else batch.column(6).slice(a, b - a).to_pylist()))
    if held:
        yield from emit()


def joined(rows: DataFrame, radius: int, most: int, similarity: float | None = None, groups: DataFrame | None = None) -> DataFrame:
    """rows(group, node, fp, with a similarity shingles) -> node, root: components of the links within groups. groups has the rows' groups, if it is cheaper.

    A group of more than ``most`` rows is dealt into parts. After these are linked, the rows
    outside of its largest component go to all parts, too, so that no pair of different
    components is left out. That costs little for copies; for texts that make candidates but no
    links it compares all pairs, in blocks.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    more = ["shingles"] if similarity is not None else []

    def links_of(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("group", "part", "own", "label", "node", "fp", *more).repartition(n, "group", "part").sortWithinPartitions("group", "part")
        return dealt.mapInArrow(partial(_group_links, radius=radius, similarity=similarity), "a long, b long")

    large = (rows if groups is None else groups).groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") > most).select("group", F.ceil(F.col("size") / most).cast("int").alias("parts")).checkpoint()
    n_large = large.count()
    if n_large and similarity is not None:
        rows = scratch_table(rows, "sets")  # read twice
    small_side = F.broadcast if n_large <= BROADCAST_ROWS else lambda df: df
    own_part = F.pmod(F.xxhash64("group", "node"), F.col("parts")).cast("int")
    parted = rows.join(small_side(large), "group", "left").withColumn("part", F.coalesce(own_part, F.lit(0))) if n_large else rows.withColumn("part", F.lit(0))
    found = components(links_of(parted.withColumns({"own": F.lit(True), "label": F.col("node")})))
    if not n_large:
        return found
    inside = rows.join(small_side(large), "group").join(found, "node", "left").withColumns({"label": F.coalesce("root", "node"), "part": own_part})
    largest = inside.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    inside = inside.join(small_side(largest), "group")
    parts = F.when(F.col("label") == F.col("largest"), F.array("part")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    meet = inside.select("*", F.explode(parts).alias("_to")).withColumn("own", F.col("part") == F.col("_to")).withColumn("part", F.col("_to"))
    return components(links_of(meet).unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, cell: int = CELL, together: int = TOGETHER) -> DataFrame:
    """docs without all but one row of each group that pairs of that shingle similarity (or more) connect.

    The least doc_id's row stays (nulls last), of several the one with the least text hash.
    Candidates share one of the BANDS cells (a pair of similarity 0.8 in 9,997 of 10,000 cases)
    and differ in few enough of 64 * WIDE bits; what they connect is verified by the shingle
    sets themselves. Tasks compare up to ``cell`` fingerprints and ``together`` sets with each
    other. Texts without words are one group. Sets and their shingles are told apart by 64-bit hashes.
    """
    spark = arrow_session(docs.sparkSession)
    shared_folder(spark)
    key = [F.col("doc_id").isNull().alias("__newsflow_null"), F.coalesce("doc_id", F.lit(0)).alias("__newsflow_id"), F.xxhash64("text").alias("__newsflow_key")]
    names = ["__newsflow_null", "__newsflow_id", "__newsflow_key"]
    schema = "__newsflow_null boolean, __newsflow_id long, __newsflow_key long, node long, fp binary, cells array<long>"
    prints = scratch_table(docs.select("text", *key).mapInArrow(partial(_sketches, shingle=shingle), schema), "prints")
    radius = most_different(similarity, DEVIATIONS)
    cells = prints.select("node", "fp", "cells").distinct().select(F.explode(F.array_distinct("cells")).alias("group"), "node", "fp")
    with arrow_rows(spark, 10_000):
        near = joined(cells, radius, cell)
    near = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    classes = prints.groupBy("node").agg(F.min(F.struct(*names)).alias("m"), F.first("fp").alias("fp"))  # copies leave one row before the joins
    candidates = classes.join(near, "node").select("m.*", F.col("root").alias("group"), "node", "fp").checkpoint()
    # only candidates' shingles are made and moved; a repeated row repeats its set, which is not compared with itself
    texts = docs.select("text", *key).join(candidates, names).select("text", "group", "node", "fp")
    sets = texts.mapInArrow(partial(_sets, shingle=shingle), "group long, node long, fp binary, shingles binary")
    found = joined(sets, radius, together, similarity, candidates)
    least = classes.join(found, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("m").alias("m")).select("m.*")
    return docs.select("*", *key).join(least, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
