"""Problem 1: the N best items of every group, by secondary sort and streamed Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import valid_number

RANK = "rank_in_group"


def _keep_first(n: int, n_groups: int, with_rank: bool):
    """A function over Arrow batches sorted by group: emits the first ``n`` rows of each group, holding one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # key of the group that the previous batch ended in
        seen = 0  # its rows so far
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, dtype=bool)
            for i in range(n_groups):
                col = batch.column(i)
                if rows > 1:
                    new[1:] |= pc.not_equal(col.slice(1), col.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            key = [batch.column(i)[0].as_py() for i in range(n_groups)]
            new[0] = key != last
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            rank = np.arange(rows, dtype=np.int64)
            if len(starts):
                at = np.where(group >= 0, starts[np.maximum(group, 0)], 0)
                rank = rank - at
            rank[group < 0] += seen  # these go on with the previous batch's group
            mask = rank < n
            last = [batch.column(i)[rows - 1].as_py() for i in range(n_groups)]
            seen = int(rank[-1]) + 1
            if mask.any():
                out = batch.filter(pa.array(mask))
                if with_rank:
                    ranks = pa.array((rank[mask] + 1).astype(np.int32), type=pa.int32())
                    out = pa.RecordBatch.from_arrays([*out.columns, ranks], names=[*out.schema.names, RANK])
                yield out

    return run


def top_n_per_group(
    df: DataFrame, groups: list[str], score: str, ident: str, n: int, latest: str | None = None
) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every group, equal scores by ``ident`` ascending (byte order).

    Result: the group columns, ``ident``, ``score`` and ``rank_in_group`` (1 is best); other
    columns of ``df`` play no part, whatever their names. Rows with a null in a group column or
    a null or NaN score are left out first; a group without any other row is absent. A null
    ``ident`` sorts before all others. Of several rows of one ``ident`` in a group one counts: the
    one with the latest ``latest`` (null is earliest; at the same time the higher score), or
    without ``latest`` the one with the highest score. An empty table gives an empty result.

    Plan: one shuffle by (group, ident), with a map-side combine that folds repeated rows; then every
    partition is sorted by (group, score, ident) and streams at most ``n`` rows a group, so that
    a group with a third of all rows is worked on by all partitions; the few survivors are
    shuffled by group and streamed once more. No task holds a group.
    """
    cols = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    base = df.select(*cols, F.col(ident).alias("ident"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"),
                     (F.col(latest) if latest else F.lit(None).cast("timestamp")).alias("at"))
    keys = [f"g{i}" for i in range(len(groups))]
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    base = base.filter(valid_number(F.col("score")))
    if latest:
        once = base.groupBy(*keys, "ident").agg(F.max(F.struct("at", "score")).getField("score").alias("score"))
    else:
        once = base.groupBy(*keys, "ident").agg(F.max("score").alias("score"))
    once = once.select(*keys, "score", "ident")
    order = [*(F.asc(k) for k in keys), F.desc("score"), F.asc("ident")]
    schema = once.schema
    local = once.sortWithinPartitions(*order).mapInArrow(_keep_first(n, len(keys), False), schema)
    ranked = T.StructType([*schema.fields, T.StructField(RANK, T.IntegerType())])
    best = local.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_keep_first(n, len(keys), True), ranked)
    return best.select(
        *(F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)),
        F.col("ident").alias(ident), F.col("score").alias(score), F.col(RANK),
    )
