"""What the operators of this subpackage share: a folder for scratch tables that every
executor sees, corpora packed into batches, and a compact form of sorted hashes.

A *batch* is one row that holds about ``batch_bytes`` of text (whole documents, ordered by
doc_id, compressed). Batches are written once to a table in the shared folder, so a batch
keeps its number and its content when a task is run again on another executor; later
phases exchange hashes between batches and never look at another batch's text.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.session import arrow_rows, shared_folder  # noqa: F401  arrow_rows is imported from here

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ROWS_PER_ARROW_BATCH = 64
NO_ID = -(2**63)

_scratch: list[tuple[SparkSession, str]] = []


def arrow_session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since one row may be a very long text or a packed batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ROWS_PER_ARROW_BATCH:
        spark.conf.set(key, str(ROWS_PER_ARROW_BATCH))
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted with the scratch tables."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}/{name}"
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.append((spark, path))
    return path


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many scratch tables this process has; see drop_scratch."""
    return len(_scratch)


def drop_scratch(since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables of this process that were made since a mark, but for the last ``keep`` ones."""
    dropped = _scratch[since : len(_scratch) - keep]
    del _scratch[since : len(_scratch) - keep]
    for spark, path in reversed(dropped):
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def n_buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batch_bytes(spark: SparkSession) -> int:
    """Larger batches where there are more buckets, so that their exchange stays linear."""
    return min(64 << 20, max(1 << 20, 2048 * n_buckets(spark)))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches, one at a time and without building Python lists of values."""
    for batch in batches:
        columns = list(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in columns}


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes | None]]:
    """(doc_id, UTF-8 bytes) from Arrow batches with these two columns in this order."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            value = texts[i]
            yield ids[i].as_py(), value.as_buffer().to_pybytes() if value.is_valid else None


STAGED = "batch long, doc_ids binary, missing binary, lens binary, blob binary"


def stage_batches(docs: DataFrame, size: int, extra: Callable[[bytes, np.ndarray], tuple] | None = None, extra_schema: str = "") -> DataFrame:
    """docs(doc_id, text) packed into batches and written once. extra(text, starts) adds columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=9)

        def flush(held: list) -> pa.RecordBatch:
            nonlocal number
            held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or b""))
            ids = np.array([NO_ID if d is None else d for d, _ in held], np.int64)
            missing = np.array([(d is None) + 2 * (t is None) for d, t in held], np.uint8)
            lens = np.array([len(t or b"") for _, t in held], np.int64)
            blob = b"".join(t or b"" for _, t in held)
            row = [(part << 32) | number, ids.tobytes(), missing.tobytes(), lens.tobytes(), squeeze.compress(blob)]
            number += 1
            if extra is not None:
                row += extra(blob, np.concatenate([[0], np.cumsum(lens)]))
            return pa.record_batch([pa.array([v]) if isinstance(v, int) else pa.array([v], pa.binary()) for v in row], names=names)

        held, total = [], 0
        for doc_id, text in text_rows(batches):
            held.append((doc_id, text))
            total += len(text or b"") + 32
            if total >= size:
                yield flush(held)
                held, total = [], 0
        if held:
            yield flush(held)

    schema = STAGED + (f", {extra_schema}" if extra_schema else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return scratch_table(docs.select("doc_id", "text").mapInArrow(pack, schema), "batches")


class Batch:
    """A staged batch, opened."""

    def __init__(self, row: dict):
        self.number = row["batch"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.missing = np.frombuffer(row["missing"], np.uint8)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.text = zstandard.decompress(row["blob"]) if row["blob"] else b""
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])

    def id(self, i: int) -> int | None:
        return None if self.missing[i] & 1 else int(self.ids[i])

    def docs(self) -> Iterator[bytes]:
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield self.text[a:b]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Unsigned integers byte plane by byte plane: the high bytes of sorted ones compress well."""
    raw = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unplanes(data: bytes, width: int = 8) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64).reshape(-1)


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each of the equal ranges of a sorted hash starts; ends with the length."""
    edges = np.array([-(-(k << bits) // buckets) for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges, "left"), [len(sorted_hashes)]])


def binary_batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """An Arrow batch of integers and bytes from rows."""
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int32() if n == "bucket" or n == "kind" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def only(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated where it stands.

    A filter is pushed below the projections that it depends on and takes their expressions
    with it; arrays that a condition is made of would then be computed again for each of
    their elements. What a generator makes cannot be pushed.
    """
    one = F.explode_outer(F.when(condition, F.array(F.lit(1)))).alias("__newsflow_one")
    return df.select("*", one).where("__newsflow_one is not null").drop("__newsflow_one")


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
