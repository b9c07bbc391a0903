"""Operator 11: the trie of conversation prefixes.

Method: each conversation gets a chain of cryptographic digests, one for each prefix; prefixes
are exploded and grouped by (depth, digest) into nodes; nodes are exploded to their ancestors for
sums over subtrees. Nothing but 128-bit digests and counts moves, never a text.

How it holds at any size:

* Turns are numbered by a range sort, so that a conversation of any length lies over as many
  tasks as it needs. Its chain is made in blocks of BLOCK turns: inside of a block all tasks work
  at once, and only one digest for each block is chained in order. The digest of a prefix
  depends on the prefix alone.
* The smallest member of a node is the smallest member of everything on its own path below, so
  the nodes of one smallest member form a chain. A chain's nodes are summed before the explode,
  which then makes one row for each ancestor above the chain: never more rows than turns.
* A node with very many children would be one task's join; nodes that have over a thousandth of
  all children (under a thousand nodes) are broadcast.
* The digest of a node's ends takes sorted ids one after another by definition. Range tasks write
  them as pieces of text, so one task streams over pieces, never holding more than one.

Defined results: a null role or text is empty; turns with a null conv_id belong to no
conversation and are left out; a null turn comes first; turns of one number are in the order of
their digests, repeated rows one after another; an empty table gives no node, not even the root;
other columns are not read. Texts and conversations may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm.shared import arrow_rows, rows_of, scratch_table

BLOCK = 256
#: Ids in one piece of a node's ends.
PIECE = 8192
#: Arrow batches of blocks, which hold up to BLOCK turns each, and of narrow rows.
BLOCKS, NARROW = 256, 8192
NODE = ["depth", "d1", "d2"]


def keyed(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn, key, points: a digest of (role, text) and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).alias("points"))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, runs): turns carry their place in a global order, runs say for each conversation and sort task where its turns begin and how many precede them."""
    turns = keyed(conversations)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    turns = scratch_table(placed.select("conv_id", "key", "points", "at"), "turns").withColumn("part", F.shiftright("at", 33))
    runs = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns, runs.select("conv_id", "part", "first", before.alias("before"), F.sum("size").over(whole).alias("total"))


def whole_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) for trie, each conversation as it is."""
    turns, runs = numbered(conversations)
    placed = turns.join(runs, ["conv_id", "part"])
    return (
        placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("depth"), "key", "points", F.col("total").alias("length")),
        runs.where("before = 0").select("conv_id", F.col("total").alias("length")),
    )


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) for trie: conversation c begins with the first h turns of c - c % group, then come its own turns after its first h; h = crc32(c) % (most + 1)."""
    turns, runs = numbered(conversations)
    runs = scratch_table(runs, "runs")
    base = F.col("conv_id") - F.col("conv_id") % group
    place = F.col("at") - F.col("first") + F.col("before")
    first = turns.where(F.col("conv_id") % group == 0).join(runs.where(F.col("before") < most), ["conv_id", "part"]).where(place < most)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "key", "points"))).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    head = F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.expr("slice(array(named_struct('place', 0L, 'key', x'', 'points', 0)), 1, 0)"))
    known = runs.withColumns({"base": base, "h": h}).join(heads, "base", "left").withColumn("head", head)
    known = known.withColumns({"taken": F.size("head"), "length": F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))})
    known = scratch_table(known.select("conv_id", "part", "first", "before", "h", "head", "taken", "length"), "known")
    own = turns.join(known.drop("head"), ["conv_id", "part"]).where(place >= F.col("h")).select("conv_id", (place - F.col("h") + F.col("taken") + 1).alias("depth"), "key", "points", "length")
    starts = known.where("before = 0")
    given = starts.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.key", "t.points", "length")
    return own.unionByName(given), starts.select("conv_id", "length")


def _next(before: bytes, key: bytes) -> bytes:
    return hashlib.sha256(before + key).digest()[:16]


PREFIXES = "conv_id long, block long, length long, d1 array<long>, d2 array<long>, points array<int>"


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows of (conv_id, block, length, digests one after another, points)."""
    sizes = [len(r[4]) for r in rows]
    pairs = np.frombuffer(b"".join(r[3] for r in rows), "<i8").reshape(-1, 2)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(pairs[:, k]), pa.int64())) for k in (0, 1)]
    return pa.record_batch([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), *lists, pa.array([r[4] for r in rows], pa.list_(pa.int32()))], names=[c.split()[0] for c in PREFIXES.split(", ")])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the prefixes inside of each block."""
    for batch in batches:
        rows = []
        for row in rows_of([batch]):
            digest, digests = b"", []
            for turn in row["turns"]:
                digest = _next(digest, turn["key"])
                digests.append(digest)
            rows.append((row["conv_id"], row["block"], row["length"], b"".join(digests), [t["points"] for t in row["turns"]]))
        if rows:
            yield _prefix_batch(rows)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (conv_id, block, d1, d2), the last digest inside of each block, the digest of all turns before each block but the first."""
    conv, carry = None, b""
    for batch in batches:
        out = []
        for c, block, d1, d2 in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            last = np.array([d1, d2], "<i8").tobytes()
            if c != conv:
                conv, carry = c, last
                continue
            out.append((c, block, *np.frombuffer(carry, "<i8").tolist()))
            carry = _next(carry, last)
        yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["conv_id", "block", "c1", "c2"])


def _deepened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests inside of a block that has a carry become digests of whole prefixes."""
    for batch in batches:
        rows = []
        for row in rows_of([batch]):
            carry = np.array([row["c1"], row["c2"]], "<i8").tobytes()
            local = np.array([row["d1"], row["d2"]], "<i8").T.tobytes()
            digests = b"".join(_next(carry, local[k : k + 16]) for k in range(0, len(local), 16))
            rows.append((row["conv_id"], row["block"], row["length"], digests, row["points"]))
        if rows:
            yield _prefix_batch(rows)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns(conv_id, depth from 1, key, points, length) -> one row for each block of a conversation with the digests of its prefixes."""
    spark = turns.sparkSession
    blocks = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("depth", "key", "points"))).alias("turns"))
    with arrow_rows(spark, BLOCKS):
        blocks = scratch_table(blocks.mapInArrow(_chained, PREFIXES), "blocks")
    last = blocks.where(F.col("length") > BLOCK).select("conv_id", "block", F.element_at("d1", -1).alias("d1"), F.element_at("d2", -1).alias("d2"))
    with arrow_rows(spark, NARROW):
        carries = scratch_table(last.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_carried, "conv_id long, block long, c1 long, c2 long"), "carries")
    with arrow_rows(spark, BLOCKS):
        deep = scratch_table(blocks.where("block > 0").join(carries, ["conv_id", "block"]).mapInArrow(_deepened, PREFIXES), "deep")
    return blocks.where("block = 0").unionByName(deep)


def exploded(blocks: DataFrame, *columns: str | Column) -> DataFrame:
    """One row for each prefix: columns, depth, d1, d2, points."""
    return blocks.select(*columns, F.posexplode(F.arrays_zip("d1", "d2", "points")), "block").select(*columns, (F.col("block") * BLOCK + F.col("pos") + 1).alias("depth"), "col.d1", "col.d2", "col.points")


ROOT = ("0L as depth", "0L as d1", "0L as d2")


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (depth, d1, d2, conv_id) the runs of one node, as joined decimals."""
    for batch in batches:
        pieces = []
        for node, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[:3]):
            ids = [r[3] for r in rows]
            pieces.append((*node, ids[0], ",".join(map(str, ids))))
        if pieces:
            columns = list(zip(*pieces, strict=True))
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*NODE, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted pieces one digest for each node."""

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array([r[k] for r in done], pa.int64()) for k in range(3)), pa.array([r[3] for r in done], pa.string())], names=[*NODE, "ends_sha256"])

    node, state = None, None
    for batch in batches:
        done = []
        for d, d1, d2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d, d1, d2) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (d, d1, d2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield batch_of(done)
    if node is not None:
        yield batch_of([(*node, state.hexdigest())])


def ends(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """Of each node at which conversations end, the digest of their ids."""
    spark = paths.sparkSession
    at = F.col("length") - F.col("block") * BLOCK
    last = paths.where((at >= 1) & (at <= BLOCK)).select(F.col("length").alias("depth"), F.element_at("d1", at.cast("int")).alias("d1"), F.element_at("d2", at.cast("int")).alias("d2"), "conv_id")
    last = last.unionByName(conversations.where("length = 0").selectExpr(*ROOT, "conv_id"))
    with arrow_rows(spark, PIECE):
        pieces = scratch_table(last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_in_pieces, "depth long, d1 long, d2 long, first long, ids string"), "pieces")
    with arrow_rows(spark, BLOCKS):
        return scratch_table(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth long, d1 long, d2 long, ends_sha256 string"), "ends")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """turns(conv_id, depth, key, points, length), conversations(conv_id, length) -> one row for each node.

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    conversations, paths = scratch_table(conversations, "conversations"), prefixes(turns)
    steps = exploded(paths, "conv_id", "length").unionByName(conversations.selectExpr("conv_id", "length", *ROOT, "0 as points"))
    nodes = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"))
    nodes = scratch_table(nodes.select(*NODE, "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("points")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf")), "nodes")
    nodes = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    # chains: the nodes of one smallest member, in stretches of BLOCK
    whole = Window.partitionBy("conv_id")
    later = F.coalesce(F.sum("sum_saved").over(whole.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("sum_saved"), F.sum("leaf").alias("leaf"), F.min("depth").alias("low"), F.max("depth").alias("high"))
    stretches = stretches.select("conv_id", "block", "low", later.alias("later"), F.min("low").over(whole).alias("top"), F.max("high").over(whole).alias("bottom"), F.sum("sum_saved").over(whole).alias("chain_saved"), F.sum("leaf").over(whole).alias("chain_leaves"))
    stretches = scratch_table(stretches, "stretches")
    chains = stretches.where("low = top and top > 0").select("conv_id", "top", "chain_saved", "chain_leaves")
    # each chain to all its ancestors
    above = chains.where("top > 1").select("*", F.explode(F.expr(f"sequence(0L, (top - 2) div {BLOCK})")).alias("block")).join(paths.drop("length"), ["conv_id", "block"])
    above = exploded(above, "conv_id", "top", "chain_saved", "chain_leaves").where("depth < top").drop("points")
    above = scratch_table(above.unionByName(chains.selectExpr("*", *ROOT)), "above")
    below = above.groupBy(*NODE).agg(F.sum("chain_saved").alias("more_saved"), F.sum("chain_leaves").alias("more_leaves"), F.sum((F.col("depth") == F.col("top") - 1).cast("long")).alias("n_tops"))
    below = scratch_table(below, "below")
    # whose node each chain hangs from
    many = max(1, chains.count() // 1000)
    hangs = above.where("depth = top - 1").select(*NODE, F.col("conv_id").alias("chain"))
    busy = below.where(F.col("n_tops") > many).select(*NODE)
    names = nodes.select(*NODE, F.col("conv_id").alias("parent"))
    parents = hangs.join(F.broadcast(scratch_table(busy.join(names, NODE), "busy")), NODE, "left")
    parents = scratch_table(parents, "parents")
    rest = parents.where("parent is null").drop("parent").join(names, NODE)
    parents = parents.where("parent is not null").unionByName(rest).select(F.col("chain").alias("conv_id"), "parent")
    own = nodes.join(stretches.join(parents, "conv_id", "left").drop("low", "chain_saved"), ["conv_id", "block"])
    inside = F.sum("saved").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("inside", inside)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.join(below, NODE, "left").join(ends(paths, conversations), NODE, "left").select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (zero(F.col("n_tops")) + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"), (F.col("chain_leaves") + zero(F.col("more_leaves"))).alias("n_leaves"),
        (F.col("inside") + F.col("later") + zero(F.col("more_saved"))).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared beginnings."""
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


OP11_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, length(text) AS points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS p FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
s AS (SELECT c.conv_id, c.h, c.n, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT c.conv_id, o.p + 1 AS depth, o.k, o.points FROM c JOIN o ON o.conv_id = c.base AND o.p < c.h
    UNION ALL SELECT s.conv_id, o.p - s.h + s.taken + 1, o.k, o.points FROM s JOIN o ON o.conv_id = s.conv_id AND o.p >= s.h),
q AS (SELECT conv_id, depth, points, string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM r
    UNION ALL SELECT conv_id, 0, 0, '', taken + greatest(n - h, 0) = 0 FROM s),
g AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(points) AS saved, bool_and(ended) AS leaf,
    sha256(coalesce(string_agg(CASE WHEN ended THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM q GROUP BY depth, path),
u AS (SELECT path, saved, leaf, depth, unnest(range(0, depth + 1)) AS above FROM g),
w AS (SELECT above, substr(path, 1, greatest(65 * above - 1, 0)) AS path, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (depth = above + 1) AS n_children FROM u GROUP BY 1, 2)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, w.n_children, w.n_leaves, w.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN w ON w.above = g.depth AND w.path = g.path LEFT JOIN g p ON g.depth > 0 AND p.depth = g.depth - 1 AND p.path = substr(g.path, 1, greatest(65 * (g.depth - 1) - 1, 0))
"""
