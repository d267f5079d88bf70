"""Joins that need more than an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(series: DataFrame, baseline: str, arm: str = "config_id", item: str = "item_id", by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Every arm against the baseline on the items both have: by, arm, item, a, b, delta = a - b (JN-1). One join for all arms."""
    base = series.filter(F.col(arm) == baseline).select(*by, item, F.col("value").alias("b"))
    other = series.filter(F.col(arm) != baseline).select(*by, arm, item, F.col("value").alias("a"))
    return other.join(base, [*by, item]).withColumn("delta", F.round(F.col("a") - F.col("b"), 9))


def shared_by_all(series: DataFrame, arm: str = "config_id", item: str = "item_id", by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Items that every arm of their group has (JN-2): counted, not self-joined."""
    k = series.groupBy(*by).agg(F.countDistinct(arm).alias("k"))
    per = series.groupBy(*by, item).agg(F.countDistinct(arm).alias("n"))
    return per.join(k, list(by)).filter("n = k").select(*by, item)


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], seconds: int, ident: str, value: str, at: str = "at") -> DataFrame:
    """For each row of ``left`` the ``value`` of the row of ``right`` with equal keys and the smallest |time difference|, at most ``seconds`` (JN-15).

    Of equally near rows the earlier wins, then the smaller value. Rows without a near one keep null. Times fall
    into buckets of ``seconds``; a left row meets three buckets, so a busy key joins only what is near, never all
    of its rows with each other.
    """
    bucket = F.floor(F.unix_micros(at) / F.lit(seconds * 1_000_000))
    probe = left.select(ident, *keys, F.col(at).alias("_at"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_bucket"))
    other = right.select(*keys, F.col(at).alias("_other"), F.col(value).alias("_value"), bucket.alias("_bucket"))
    gap = F.abs(F.unix_micros("_at") - F.unix_micros("_other"))
    near = probe.join(other, [*keys, "_bucket"]).withColumn("_gap", gap).filter(F.col("_gap") <= seconds * 1_000_000)
    best = near.groupBy(ident).agg(F.min(F.struct("_gap", "_other", "_value")).alias("m"))
    return left.join(best, ident, "left").select(left["*"], F.col("m._value").alias(f"nearest_{value}"), (F.col("m._gap") / 1e6).alias("gap_s"))


def followed_within(left: DataFrame, right: DataFrame, keys: list[str], days: int, at: str = "at", row_id: str = "row_id") -> DataFrame:
    """Rows of ``left`` with days to the first later row of ``right`` with equal keys, 0 to ``days`` days after, else null (JN-16).

    ``row_id`` is a column of ``left`` that tells its rows apart. Bucketed like nearest_within: only rows at most ``days`` apart meet.
    """
    span = days * 86_400_000_000
    bucket = F.floor(F.unix_micros(at) / F.lit(span))
    ident = "_row"
    rows = left.withColumn(ident, F.col(row_id))
    probe = rows.select(ident, *keys, F.unix_micros(at).alias("_at"), F.explode(F.sequence(bucket, bucket + 1)).alias("_bucket"))
    other = right.select(*keys, F.unix_micros(at).alias("_other"), bucket.alias("_bucket")).distinct()
    hit = probe.join(other, [*keys, "_bucket"]).filter((F.col("_other") >= F.col("_at")) & (F.col("_other") - F.col("_at") <= span))
    first = hit.groupBy(ident).agg(((F.min("_other") - F.first("_at")) / 86_400_000_000).alias("days_after"))
    return rows.join(first, ident, "left").drop(ident)


def follow_twice(df: DataFrame, ident: str, link: str, value: str) -> DataFrame:
    """The value of a row, or of the row it points to, or of the one that points to; else null (JN-17)."""
    a = df.select(F.col(ident).alias("_id1"), F.col(link).alias("_l1"), F.col(value).alias("_v1"))
    b = df.select(F.col(ident).alias("_id2"), F.col(value).alias("_v2"))
    x = df.join(a, F.col(link) == F.col("_id1"), "left").join(b, F.col("_l1") == F.col("_id2"), "left")
    return x.select(df[ident], F.coalesce(df[value], "_v1", F.when(F.col("_v1").isNull(), F.col("_v2"))).alias("resolved"))


def first_match(df: DataFrame, key: str, preferred: Column, at: str, value: str) -> DataFrame:
    """For each key the value of its first row, preferred ones before the others, then the earliest (JN-18)."""
    order = F.struct(F.when(preferred, 0).otherwise(1).alias("p"), F.col(at).alias("t"), F.col(value).alias("v"))
    return df.groupBy(key).agg(F.min(order).getField("v").alias(value))


def changed(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """added, removed or changed keys between two versions (DS-3, DS-12)."""
    a, b = old.select(F.col(key).alias("k0"), F.col(digest).alias("h0")), new.select(F.col(key).alias("k1"), F.col(digest).alias("h1"))
    x = a.join(b, F.col("k0") == F.col("k1"), "full_outer")
    state = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")), "changed")
    return x.select(F.coalesce("k0", "k1").alias(key), state.alias("state")).filter("state IS NOT NULL")
