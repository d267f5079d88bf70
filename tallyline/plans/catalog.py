"""The questions that pages of arms and metrics ask of a table of facts (UD-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Catalog:
    """Answers as frames over ``facts`` (run_id, config_id, dataset_id, item_id and the metrics). Another source answers by a class with the same methods.

    ``shape`` are metrics that describe an item or output and rank nothing, ``lower`` those of which less is better.
    """

    item_word = "item"

    def __init__(self, facts: DataFrame, metrics: tuple[str, ...], shape: tuple[str, ...] = (), lower: tuple[str, ...] = ()) -> None:
        self.facts, self.metrics, self.shape_metrics, self.lower = facts, metrics, shape, frozenset(lower)

    def arms(self) -> DataFrame:
        return self.facts.select(F.col("config_id").alias("arm")).distinct()

    def arms_of(self, match: str) -> DataFrame:
        """Arms whose name holds ``match``."""
        return self.arms().filter(F.col("arm").contains(match))

    def describe(self) -> DataFrame:
        """arm, n_datasets, n_runs, n_items."""
        return self.facts.groupBy(F.col("config_id").alias("arm")).agg(
            F.countDistinct("dataset_id").alias("n_datasets"), F.countDistinct("run_id").alias("n_runs"), F.countDistinct("dataset_id", "item_id").alias("n_items"))

    def scores(self, arm: str) -> DataFrame:
        """dataset_id, item_id, metric, value: the mean over the arm's runs; what is missing has no row."""
        x = self.facts.filter(F.col("config_id") == arm)
        pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in self.metrics))).alias("s")
        return x.select("dataset_id", "item_id", pairs).filter("s.value IS NOT NULL").groupBy("dataset_id", "item_id", F.col("s.metric").alias("metric")).agg(F.avg("s.value").alias("value"))

    def recorded_means(self, metric: str) -> DataFrame:
        """arm, mean of a metric over all rows, for display where there are no scores by item to test."""
        return self.facts.groupBy(F.col("config_id").alias("arm")).agg(F.avg(metric).alias("mean"))

    def preferred_metrics(self) -> tuple[str, ...]:
        return tuple(m for m in self.metrics if m not in self.shape_metrics)

    def input_hashes(self, inputs: DataFrame, text: str = "text") -> DataFrame:
        """item_id, sha256 of the inputs that arms read."""
        return inputs.select("item_id", F.sha2(text, 256).alias("sha256"))

    def lower_is_better(self, metric: str) -> bool:
        return metric in self.lower

    def is_neutral(self, metric: str) -> bool:
        return metric in self.shape_metrics
