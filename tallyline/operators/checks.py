"""Integrity checks: each gives a frame of violations (check, subject, detail); a check passes if it is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def resolves(df: DataFrame, key: str, known: DataFrame, known_key: str, check: str) -> DataFrame:
    """Keys without a row in ``known`` (VC-2, VC-6, VC-12): one row for each, with how often it is named."""
    named = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    missing = named.join(known.select(F.col(known_key).alias("_k")), "_k", "left_anti")
    return _rows(missing, check, F.col("_k"), F.col("n"))


def present(df: DataFrame, key: str, columns: list[str], check: str) -> DataFrame:
    """Rows that lack a needed value (VC-1, VC-3)."""
    lacking = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    x = df.select(F.col(key).alias("_k"), F.array_join(lacking, ",").alias("_d")).filter("_d <> ''").distinct()
    return _rows(x, check, F.col("_k"), F.col("_d"))


def holds(df: DataFrame, key: str, condition: Column, detail: Column, check: str) -> DataFrame:
    """Rows for which a condition is false (VC-4, VC-11, VC-15 to VC-17, VC-19); null counts as false."""
    x = df.filter(~F.coalesce(condition, F.lit(False))).select(F.col(key).alias("_k"), detail.cast("string").alias("_d")).distinct()
    return _rows(x, check, F.col("_k"), F.col("_d"))


def unique(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Keys with more than one row (VC-8, VC-18)."""
    x = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return _rows(x, check, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def identical_runs(scores: DataFrame, group: str, run: str, item: str, value: str) -> DataFrame:
    """Runs of a group with the same values on the same items (VC-5): group, n_runs, first.

    A run's signature is its count and sums of hashes of its rows, which do not depend on order, so a run of any
    length is folded map-side and never collected.
    """
    h = F.xxhash64(F.col(item), F.col(value))
    sig = scores.groupBy(group, run).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)")).alias("t"))
    same = sig.groupBy(group, "n", "s", "x", "t").agg(F.count("*").alias("n_runs"), F.min(run).alias("first_run")).filter("n_runs > 1")
    return same.select(group, "n_runs", "first_run")


def one_of(df: DataFrame, key: str, column: str, allowed: list[str], check: str) -> DataFrame:
    """Values outside an enumeration (VC-13, VC-20)."""
    x = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(F.col(key).alias("_k"), F.col(column).alias("_d")).distinct()
    return _rows(x, check, F.col("_k"), F.col("_d"))


def agrees(df: DataFrame, key: str, column: str, check: str) -> DataFrame:
    """Keys whose rows do not agree on a value (VC-14)."""
    x = df.groupBy(F.col(key).alias("_k")).agg(F.countDistinct(column).alias("n")).filter("n > 1")
    return _rows(x, check, F.col("_k"), F.col("n"))


def stale_scorers(derived: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``derived`` (run_id, scorer, scorer_hash) whose hash is not that of the scorer in ``current`` (scorer, scorer_hash), or whose scorer is gone (VC-10)."""
    return derived.join(current, ["scorer", "scorer_hash"], "left_anti")
