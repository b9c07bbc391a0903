"""All pairs of rows of a group in memory of a few blocks, without a copy of any row on disk for each block that it meets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.session import arrow_rows, shared_folder, written

#: Up to so many blocks each has a partition of its own; of more, about LYING lie in one.
APART, LYING = 32, 4


def met(rows: DataFrame, group: str, n_blocks: int, task: Callable[[object, pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
    """rows(group, _lead, _part, _many, ...) -> what task(group, one, other, same) makes of every two blocks of a group that are not both without a lead, and of each leading block with itself.

    A block has the rows of one _part with the same _lead; _many says that the group has several,
    n_blocks is their number in all such groups. They are packed into one binary value each and meet
    in a Cartesian product of their partitions, which are read again for each other partition: time
    grows with the square of a group, disk with its rows. A group of one block is one group. The
    result is written; rows are read twice.
    """
    shared_folder(rows.sparkSession)
    inside = [c for c in rows.columns if c not in (group, "_lead", "_part", "_many")]
    alone = rows.where(~F.col("_many") & F.col("_lead")).select(group, *inside)
    alone = written(alone.groupBy(group).applyInPandas(lambda key, block: task(key[0], block, block, True), schema))
    if not n_blocks:
        return alone
    rows = rows.where("_many").drop("_many")
    kind = rows.schema[group].dataType.simpleString()
    n = max(min(n_blocks, APART), -(-n_blocks // LYING))

    def pack(key: tuple, block: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, (held := block.select(inside)).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(held)
        return pa.table({group: pa.array([key[0].as_py()], block.schema.field(group).type), "_lead": [key[1].as_py()], "_part": pa.array([key[2].as_py()], pa.int32()), "_held": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("_part", F.col("_part").cast("int")).repartition(n, group, "_lead", "_part")
    blocks = dealt.groupBy(group, "_lead", "_part").applyInArrow(pack, f"`{group}` {kind}, _lead boolean, _part int, _held binary").checkpoint()
    one, other = (blocks.select(*(F.col(c).alias(f"{side}{c}") for c in blocks.columns)) for side in ("l", "r"))
    once = ~F.col("r_lead") | (F.col("l_part") <= F.col("r_part"))
    pairs = one.where("l_lead").join(other.hint("shuffle_replicate_nl"), (F.col(f"l{group}") == F.col(f"r{group}")) & once)
    opened = lambda held: pa.ipc.open_stream(pa.py_buffer(held.as_buffer())).read_all().to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch.column(c)[k] for c in batch.schema.names}
                same = x["r_lead"].as_py() and x["l_part"].as_py() == x["r_part"].as_py()
                mine = opened(x["l_held"])
                found = task(x[f"l{group}"].as_py(), mine, mine if same else opened(x["r_held"]), same)
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    with arrow_rows(rows.sparkSession, 1):
        return alone.unionByName(written(pairs.mapInArrow(run, schema)))
