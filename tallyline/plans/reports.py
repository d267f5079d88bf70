"""Composed reports: leaderboards, comparisons with filters, replication cards, judging summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import paired as pr
from ..operators.aggregates import arm_table
from ..operators.joins import shared_by_all
from ..operators.ranks import tolerant_ranks
from .frames import series


def leaderboard(facts: DataFrame, metric: str, ascending: bool = False, reference: Column | None = None) -> DataFrame:
    """One table for each dataset and reference (ST-17, ST-56): mean and spread over repeats, average rank on the items all arms share, position.

    Arms without a score come last; equal means share no position, the name decides. References are never averaged
    across: an arm scored against two of them has a row in each table.
    """
    f = facts.withColumn("reference", reference if reference is not None else F.lit("gold"))
    table = ["dataset_id", "reference"]
    runs = f.groupBy(*table, "config_id", "run_id").agg(F.avg(metric).alias("mean"))
    s = series(f, metric, *table, "config_id", "item_id")
    ranks = tolerant_ranks(s.join(shared_by_all(s, by=tuple(table)), [*table, "item_id"], "left_semi"), [*table, "item_id"], "config_id", "value", ascending)
    avg = ranks.groupBy(*table, "config_id").agg(F.round(F.avg("rank"), 9).alias("avg_rank"))
    order = F.asc_nulls_last("mean") if ascending else F.desc_nulls_last("mean")
    t = arm_table(runs, *table).join(avg, [*table, "config_id"], "left")
    t = t.withColumn("position", F.row_number().over(Window.partitionBy(*table).orderBy(order, "config_id")))
    return t.select(*table, "config_id", "mean", "spread", "n_runs", "avg_rank", "position")


def compare_filtered(facts: DataFrame, metric: str, baseline: str, keep: Column | None = None, items: DataFrame | None = None, **options) -> DataFrame:
    """The compare call (CV-2): a filter over rows, a list of items, then every arm against the baseline."""
    f = facts if keep is None else facts.filter(keep)
    s = series(f, metric)
    return pr.compare(s if items is None else s.join(items, "item_id", "left_semi"), baseline, **options)


def replication(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs of each arm, item by item (ST-53): n, identical, mean change, items on one side only."""
    b = before.select("dataset_id", "config_id", "item_id", F.col("value").alias("b"))
    a = after.select("dataset_id", "config_id", "item_id", F.col("value").alias("a"))
    x = b.join(a, ["dataset_id", "config_id", "item_id"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return x.groupBy("dataset_id", "config_id").agg(
        F.count_if(both).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.round(F.avg(F.when(both, F.col("a") - F.col("b"))), 9).alias("change"), F.count_if(~both).alias("one_side"))


def reference_guard(arms: DataFrame, baseline: str, free_metric: bool = False) -> DataFrame:
    """Arms scored against another reference than the baseline's are set aside (FI-9): ``arms`` has dataset_id, config_id, reference."""
    base = arms.filter(F.col("config_id") == baseline).groupBy("dataset_id").agg(F.max("reference").alias("wanted"))
    x = arms.join(base, "dataset_id", "left")
    return x.select("dataset_id", "config_id", "reference", (F.col("wanted").isNotNull() & (F.col("reference") != F.col("wanted")) & F.lit(not free_metric)).alias("set_aside"))
