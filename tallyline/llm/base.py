"""What the operators of this sub-package share: reading, cutting lineage, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_table, durable_table, ensure_checkpoint_dir

__all__ = ["bounded_sample", "drop_table", "durable", "durable_table", "ensure_checkpoint_dir", "joined", "read", "valid_number"]

#: Rows of a small side that are broadcast (a few short columns each); a larger one is spread over salts.
BROADCAST_ROWS = 500_000
SALTS = 16


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: its lineage ends there, so a lost executor costs nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def joined(big: DataFrame, small: DataFrame, keys: list[str], rows: int, spread: str, how: str = "inner") -> DataFrame:
    """``big`` with ``small`` (of ``rows`` rows, unique keys), neither of which sends a popular key to one task: small is broadcast up to
    BROADCAST_ROWS; a larger one is repeated for each salt, and the rows of big are salted by their column ``spread``."""
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(many, [*keys, "_salt"], how).drop("_salt")


def valid_number(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of ``key``: the same ones however the table is split.

    A first cut by hash keeps the final ordering small; the count it needs reads no
    column. Only for fitting models: nothing is scored from it.
    """
    total = df.count()
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    if total > 2 * rows:
        df = df.filter(h < F.lit(int((1 << 30) * min(1.0, 1.5 * rows / total))))
    return df.orderBy(h, F.col(key)).limit(rows)
