"""Operator 10: token counts by separator scan.

Input are flat token files without an index: ids one after another, each document followed by
an end-of-document id. A file is read as numbered blocks of fixed size (byte ranges of it, the
last one shorter), wherever documents begin. In each block a vectorised search finds the
separators; a block tells how many it has and how many ids stand before the first and behind
the last. A prefix scan over those summaries, in two levels so that no task sees all blocks of
a file, gives every block the number of documents before it and the length that is carried
into it, from which every document's count follows.

``pack`` writes such files from texts into the shared folder, and a list of their doc_ids in
order; ``flat_files`` takes those that are there. Ids have 16 or 32 bits, little-endian. Files
are opened through Arrow's file systems (local or mounted paths, hdfs, s3, gs), which read
ranges; a task that runs again writes a file of its own and only what it reports is used.

Defined results: a null text has no tokens and still counts as a document of length 0; null
and repeated doc_ids give one row each; an unfinished document at the end of a file counts as
one if it has ids; an empty file has no documents; a file that ends within an id raises.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm.byte_bpe import codec, public_vocabulary
from newsflow.llm.shared import arrow_session, n_buckets, scratch_folder, scratch_table

END = 50256
BLOCK = 1 << 16
#: Bytes after which pack starts a new file, and blocks in a group of the two-level scan.
FILE_BYTES = 1 << 28
GROUP = 256


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI as Spark writes it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _pack(batches: Iterator[pa.RecordBatch], path: str, pattern: str, end: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Rows of (file, first, docs), and of (file, bytes) for a finished file."""
    bpe = codec(path, pattern)
    width = np.uint16 if len(bpe.vocabulary) <= 1 << 16 and end < 1 << 16 else np.uint32
    store, root = _opened(folder)
    store.create_dir(root, recursive=True)
    name, out, first, size = "", None, 0, 0
    for batch in batches:
        if out is None:
            name, first, size = f"{uuid.uuid4().hex}.tokens", 0, 0
            out = store.open_output_stream(f"{root}/{name}")
        for tokens in bpe.encode_many([t or "" for t in batch.column(1).to_pylist()]):
            size += out.write(np.array([*tokens, end], width).tobytes())
        yield _packed(f"{folder}/{name}", first, batch.column(0).to_pylist(), None, width)
        first += batch.num_rows
        if size >= FILE_BYTES:
            out.close()
            yield _packed(f"{folder}/{name}", None, None, size, width)
            out = None
    if out is not None:
        out.close()
        yield _packed(f"{folder}/{name}", None, None, size, width)


def _packed(file: str, first: int | None, docs: list | None, size: int | None, width: type) -> pa.RecordBatch:
    return pa.record_batch([pa.array([file]), pa.array([first], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([np.dtype(width).itemsize], pa.int32())], names=["file", "first", "docs", "bytes", "width"])


def pack(docs: DataFrame, path: str, pattern: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> files (file, bytes, width) and names (file, nth, doc_id)."""
    spark = arrow_session(docs.sparkSession)
    folder = scratch_folder(spark, "token-files")
    packed = docs.select("doc_id", "text").mapInArrow(partial(_pack, path=path, pattern=pattern, end=end, folder=folder), "file string, first long, docs array<bigint>, bytes long, width int")
    both = scratch_table(packed, "tokens")
    names = both.where("docs is not null").select("file", "first", F.posexplode("docs").alias("k", "doc_id"))
    return both.where("bytes is not null").select("file", "bytes", "width"), names.select("file", (F.col("first") + F.col("k")).alias("nth"), "doc_id")


def flat_files(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Flat token files of any size under a path or pattern: file, bytes, width. Only their names and sizes are read here."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.lit(width).alias("width"))


def token_blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """files(file, bytes, width) -> file, block, start, bytes, width: ranges of block ids, dealt evenly."""
    step = F.lit(block) * F.col("width")
    ranges = files.where("bytes > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))))
    start = F.col("block") * step
    return ranges.select("file", "block", start.alias("start"), F.least(F.col("bytes") - start, step).alias("bytes"), "width").repartition(n_buckets(files.sparkSession))


def _ids(file: str, start: int, size: int, width: int) -> np.ndarray:
    if size % width:
        raise ValueError(f"{file} ends within an id of {width} bytes")
    store, path = _opened(file)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_at(size, start), np.uint16 if width == 2 else np.uint32)


def _scan(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    """The separators of each block: its summary and the documents' lengths within it."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ids = _ids(r["file"], r["start"], r["bytes"], r["width"])
            at = np.flatnonzero(ids == end)
            head, tail = (int(at[0]), len(ids) - int(at[-1]) - 1) if len(at) else (len(ids), len(ids))
            out.append((r["file"], r["block"], len(at), head, tail, (np.diff(at) - 1).tolist()))
        files, blocks, n, heads, tails, inner = zip(*out, strict=True) if out else ((),) * 6
        arrays = [pa.array(files, pa.string()), *(pa.array(x, pa.int64()) for x in (blocks, n, heads, tails)), pa.array(inner, pa.list_(pa.int64()))]
        yield pa.record_batch(arrays, names=["file", "block", "n", "head", "tail", "inner"])


def counts(blocks: DataFrame, end: int = END, group: int = GROUP) -> DataFrame:
    """token_blocks() -> file, nth, n_tokens: the ids before each separator."""
    arrow_session(blocks.sparkSession)
    seen = scratch_table(blocks.mapInArrow(partial(_scan, end=end), "file string, block long, n long, head long, tail long, inner array<bigint>"), "seen")
    # carried(x, y): what a run of blocks passes on; a block without separators adds to it
    keyed = seen.withColumn("g", F.floor(F.col("block") / group))
    inside = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(w, n: str, tail: str, place: str) -> tuple:
        """Separators before, and ids behind the last of them (or all, if there is none)."""
        total = F.coalesce(F.sum(n).over(w), F.lit(0))
        last = F.max(F.when(F.col(n) > 0, F.struct(place, F.col(f"_upto_{n}"), tail))).over(w)
        upto = F.coalesce(F.sum(tail).over(w), F.lit(0))
        return total, F.when(last.isNull(), upto).otherwise(last[tail] + upto - last[f"_upto_{n}"]), last.isNotNull()

    keyed = keyed.withColumn("_upto_n", F.sum("tail").over(Window.partitionBy("file", "g").orderBy("block")))
    before, carried, any_ = ahead(inside, "n", "tail", "block")
    keyed = keyed.withColumns({"before": before, "carried": carried, "closed": any_})
    whole = F.max(F.when(F.col("n") > 0, F.struct("block", "_upto_n", "tail")))
    groups = keyed.groupBy("file", "g").agg(F.sum("n").alias("gn"), F.sum("tail").alias("gsum"), whole.alias("last"))
    groups = groups.withColumn("gtail", F.when(F.col("last").isNull(), F.col("gsum")).otherwise(F.col("last.tail") + F.col("gsum") - F.col("last._upto_n"))).drop("last", "gsum")
    groups = groups.withColumn("_upto_gn", F.sum("gtail").over(Window.partitionBy("file").orderBy("g")))
    gbefore, gcarried, _ = ahead(Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1), "gn", "gtail", "g")
    final = Window.partitionBy("file").orderBy(F.desc("g"))
    groups = groups.select("file", "g", "gn", "gtail", gbefore.alias("gbefore"), gcarried.alias("gcarried"), (F.row_number().over(final) == 1).alias("is_last"))
    d = keyed.join(groups.select("file", "g", "gbefore", "gcarried"), ["file", "g"])
    carried = F.col("carried") + F.when(F.col("closed"), F.lit(0)).otherwise(F.col("gcarried"))
    first = F.when(F.col("n") > 0, F.array(F.col("head") + carried)).otherwise(F.array().cast("array<bigint>"))
    found = d.select("file", (F.col("before") + F.col("gbefore")).alias("before"), F.posexplode(F.concat(first, F.coalesce("inner", F.array().cast("array<bigint>")))).alias("k", "n_tokens"))
    found = found.select("file", (F.col("before") + F.col("k")).alias("nth"), "n_tokens")
    rest = F.col("gtail") + F.when(F.col("gn") > 0, F.lit(0)).otherwise(F.col("gcarried"))
    open_ = groups.where("is_last").select("file", (F.col("gbefore") + F.col("gn")).alias("nth"), rest.alias("n_tokens")).where("n_tokens > 0")
    return found.unionByName(open_)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as flat token files, and from these the count of each document."""
    files, names = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())
    # packed lists look small to the optimizer, which would broadcast all names
    return names.hint("merge").join(counts(token_blocks(files)), ["file", "nth"]).select("doc_id", "n_tokens")
