"""Problem 2: percentiles of very large columns by deterministic buffer collapsing.

A sketch of one group is a set of sorted buffers of ``BUFFER`` values, each standing for
``FAN ** level`` values a slot, and fewer than ``BUFFER`` loose values of weight 1. When ``FAN``
buffers of one level are full they collapse into one of the next level: their values are
merged and every ``FAN``-th is kept, from the middle position on. A collapse into weight W moves
any rank by at most W / 2; the sum of these bounds is carried along, so each sketch knows its own
greatest rank error. Merging two sketches pools their buffers and goes on collapsing: it
does not matter in which tasks, or on which days, the parts were made.

With h levels the error is at most n * h / (2 * BUFFER): under 0.001 * n up to n = 10 ** 12.
Below FAN * BUFFER = 65,536 values nothing collapses and the percentiles are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUFFER = 4096
FAN = 16
#: Values that a task holds for all its groups before it hands on what it has.
HELD = 2_000_000


class Sketch:
    """Buffers by level, loose values, count and rank-error bound of one group."""

    __slots__ = ("levels", "loose", "n_loose", "n", "error")

    def __init__(self) -> None:
        self.levels: dict[int, list[np.ndarray]] = {}
        self.loose: list[np.ndarray] = []
        self.n_loose = 0
        self.n = 0
        self.error = 0.0

    def add(self, values: np.ndarray) -> None:
        """New values of weight 1."""
        if len(values):
            self.n += len(values)
            self._loose(values)

    def _loose(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= BUFFER:
            pool = np.concatenate(self.loose)
            full = len(pool) // BUFFER * BUFFER
            for i in range(0, full, BUFFER):
                self._full(0, np.sort(pool[i : i + BUFFER]))
            self.loose = [pool[full:]] if full < len(pool) else []
            self.n_loose = len(pool) - full

    def _full(self, level: int, buffer: np.ndarray) -> None:
        at = self.levels.setdefault(level, [])
        at.append(buffer)
        if len(at) == FAN:
            self.levels[level] = []
            merged = np.sort(np.concatenate(at), kind="stable")
            weight = FAN ** (level + 1)
            self.error += weight / 2
            self._full(level + 1, merged[FAN // 2 - 1 :: FAN])

    def merge(self, level: int, values: np.ndarray) -> None:
        """A buffer of another sketch; its count and error are added by the caller."""
        if level == 0 and len(values) < BUFFER:
            self._loose(values)
        else:
            self._full(level, values)

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """(level, values) of every buffer; the first row also carries count and error."""
        if self.loose:
            yield 0, np.concatenate(self.loose)
        for level, buffers in sorted(self.levels.items()):
            for b in buffers:
                yield level, b

    def quantiles(self, ps: list[float]) -> list[float | None]:
        """The values of rank max(1, ceil(p * n)), within the error bound."""
        parts = list(self.rows())
        if not parts:
            return [None] * len(ps)
        values = np.concatenate([v for _, v in parts])
        weights = np.concatenate([np.full(len(v), float(FAN) ** lv) for lv, v in parts])
        order = np.argsort(values, kind="stable")
        values, cum = values[order], np.cumsum(weights[order])
        ranks = np.maximum(1.0, np.ceil(np.array(ps) * self.n))
        return [float(x) for x in values[np.minimum(np.searchsorted(cum, ranks), len(values) - 1)]]


def _emit(out: dict[tuple, Sketch], schema: pa.Schema, n_keys: int) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in schema.names]
    held = 0
    for key, sk in out.items():
        first = True
        for level, values in sk.rows():
            row = [*key, level, values, sk.n if first else 0, sk.error if first else 0.0]
            first = False
            for c, v in zip(cols, row, strict=True):
                c.append(v)
            held += len(values)
            if held > HELD // 4:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                cols, held = [[] for _ in schema.names], 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _arrow_schema(keys: list[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    names = to_arrow_schema(T.StructType([*keys, T.StructField("measure", T.StringType())]))
    return pa.schema([*names, ("level", pa.int32()), ("buffer", pa.list_(pa.float64())), ("n", pa.int64()), ("rank_error", pa.float64())])


def _fields(keys: list[T.StructField]) -> T.StructType:
    return T.StructType([
        *keys, T.StructField("measure", T.StringType()), T.StructField("level", T.IntegerType()),
        T.StructField("buffer", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType()),
    ])


def build_sketches(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One partial sketch for each task, group and measure, without any shuffle.

    A value counts if it is neither null, NaN nor negative (a negative latency, cost or count is a
    fault of the record); groups without such a value have no row for that measure. A null key
    is a group of its own. Columns: the keys, measure, level, buffer, n, rank_error.
    """
    src = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), *(F.col(m).cast("double").alias(f"m{j}") for j, m in enumerate(measures)))
    n_keys = len(keys)
    key_fields = [T.StructField(k, src.schema.fields[i].dataType) for i, k in enumerate(keys)]
    arrow = _arrow_schema(key_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.table(batch.columns[:n_keys], names=[f"k{i}" for i in range(n_keys)])
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            dicts = []
            for i in range(n_keys):
                enc = tab.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
                codes = codes * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False)
                dicts.append((enc.indices.to_numpy(zero_copy_only=False), enc.dictionary))
            order = np.argsort(codes, kind="stable")
            bounds = np.flatnonzero(np.diff(codes[order], prepend=codes[order[0]] - 1))
            ends = np.append(bounds[1:], len(order))
            values = [batch.column(n_keys + j).to_numpy(zero_copy_only=False)[order] for j in range(len(measures))]
            good = [np.nan_to_num(v, nan=-1.0, posinf=-1.0) >= 0 for v in values]
            for a, b in zip(bounds, ends, strict=True):
                row = order[a]
                key = tuple(d[int(ix[row])].as_py() for ix, d in dicts)
                for j, m in enumerate(measures):
                    v = values[j][a:b][good[j][a:b]]
                    if len(v):
                        held.setdefault((*key, m), Sketch()).add(v)
                        count += len(v)
            if count > HELD:
                yield from _emit(held, arrow, n_keys + 1)
                held, count = {}, 0
        yield from _emit(held, arrow, n_keys + 1)

    return src.mapInArrow(run, _fields(key_fields))


def _merge_stream(n_keys: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        sk = Sketch()
        done: dict[tuple, Sketch] = {}
        held = 0
        for batch in batches:
            key_cols = [batch.column(i).to_pylist() for i in range(n_keys)]
            levels, ns, errs = (batch.column(n_keys + i).to_pylist() for i in (0, 2, 3))
            buffers = batch.column(n_keys + 1)
            flat, off = buffers.values.to_numpy(zero_copy_only=False), buffers.offsets.to_numpy()
            for r in range(batch.num_rows):
                key = tuple(c[r] for c in key_cols)
                if key != now:
                    if now is not None:
                        done[now] = sk
                        held += sum(len(v) for _, v in sk.rows())
                        if held > HELD:
                            yield from _emit(done, arrow, n_keys)
                            done, held = {}, 0
                    now, sk = key, Sketch()
                sk.n += ns[r]
                sk.error += errs[r]
                sk.merge(levels[r], flat[off[r] : off[r + 1]])
        if now is not None:
            done[now] = sk
        yield from _emit(done, arrow, n_keys)

    return run


def merge_sketches(sketches: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """One sketch for each group: partial sketches of any origin (tasks, days, tables) combined.

    Two rounds, so that a group with very many partial sketches is first combined in ``salts``
    tasks; within a task the buffers stream in order of the group and only one group's sketch is held.
    """
    fields = [f for f in sketches.schema.fields if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))
    schema, arrow = _fields(fields), _arrow_schema(fields)
    cols = [*keys, "measure", "level", "buffer", "n", "rank_error"]
    by = [*keys, "measure"]
    merge = _merge_stream(len(by), arrow)
    out = sketches.select(*cols)
    if salts > 1:
        salted = out.withColumn("_salt", F.pmod(F.xxhash64("level", "n", "rank_error", F.get("buffer", F.lit(0))), F.lit(salts)))
        out = salted.repartition(*by, "_salt").sortWithinPartitions(*by, "level").select(*cols).mapInArrow(merge, schema)
    return out.repartition(*by).sortWithinPartitions(*by, "level").mapInArrow(merge, schema)


def read_percentiles(sketches: DataFrame, keys: list[str], ps: dict[str, float]) -> DataFrame:
    """The percentiles of merged sketches: one row for each group and measure.

    Columns: the keys, measure, n, max_rank_error (in ranks; 0 means exact) and one column for each
    percentile: the value of rank max(1, ceil(p * n)) give or take max_rank_error ranks.
    """
    by = [*keys, "measure"]
    fields = [next(f for f in sketches.schema.fields if f.name == k) for k in by]
    names, probs = list(ps), list(ps.values())
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("max_rank_error", T.DoubleType()), *(T.StructField(x, T.DoubleType()) for x in names)])
    n_keys = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now: tuple | None = None
        sk = Sketch()
        rows: list[tuple] = []

        def close() -> None:
            rows.append((*now, sk.n, sk.error, *sk.quantiles(probs)))

        for batch in batches:
            key_cols = [batch.column(i).to_pylist() for i in range(n_keys)]
            levels, ns, errs = (batch.column(n_keys + i).to_pylist() for i in (0, 2, 3))
            buffers = batch.column(n_keys + 1)
            flat, off = buffers.values.to_numpy(zero_copy_only=False), buffers.offsets.to_numpy()
            for r in range(batch.num_rows):
                key = tuple(c[r] for c in key_cols)
                if key != now:
                    if now is not None:
                        close()
                    now, sk = key, Sketch()
                sk.n += ns[r]
                sk.error += errs[r]
                sk.levels.setdefault(levels[r], []).append(flat[off[r] : off[r + 1]])
        if now is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    cols = [*by, "level", "buffer", "n", "rank_error"]
    return sketches.select(*cols).mapInArrow(run, schema)


def percentiles(df: DataFrame, keys: list[str], measures: list[str], ps: dict[str, float]) -> DataFrame:
    """Percentiles of each measure in every group; see build_sketches, merge_sketches and read_percentiles."""
    return read_percentiles(merge_sketches(build_sketches(df, keys, measures), keys), keys, ps)
