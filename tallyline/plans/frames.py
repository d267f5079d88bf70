"""The base frames that queries start from, and the SQL that says the same in DuckDB.

The fact table is ``predictions``: one row per run and item with wide measures. Rows can be delivered
twice; the one logged last counts. An arm is a config_id, repeats are its runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ["overlap_f1", "latency_ms", "cost_usd", "tokens_in", "tokens_out"]
KEYS = ["pred_id", "run_id", "config_id", "dataset_id", "item_id", "created_at"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(c: Column | str) -> Column:
    """A score: NaN is none (SC-4)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def facts(spark: SparkSession, sf_dir: str, *measures: str) -> DataFrame:
    """Every prediction once, as logged last, with the measures asked for; a hash aggregation with map-side combine.

    Rows of one pred_id and logged_at are taken to be alike.
    """
    wanted = list(measures) or [*MEASURES, "resumed"]
    p = table(spark, sf_dir, "predictions").select(*KEYS, "logged_at", *wanted)
    at = F.coalesce("logged_at", F.lit("0001-01-01").cast("timestamp"))
    return p.groupBy(*KEYS).agg(*(number(F.max_by(m, at)).alias(m) for m in wanted))


def long_scores(df: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Wide rows to (run_id, config_id, dataset_id, item_id, metric, value); missing values give no row (D6)."""
    names = measures or MEASURES
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))).alias("s")
    return df.select("run_id", "config_id", "dataset_id", "item_id", pairs).select("run_id", "config_id", "dataset_id", "item_id", "s.metric", "s.value").filter("value IS NOT NULL")


def series(df: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Mean over an arm's repeats of each item: (dataset_id, config_id, item_id, value), rounded so that ties are ties (SC-5, SC-6)."""
    by = list(keys) or ["dataset_id", "config_id", "item_id"]
    return df.filter(F.col(metric).isNotNull()).groupBy(*by).agg(F.round(F.avg(metric), 9).alias("value"))


FACTS = """
f AS (SELECT * REPLACE (CASE WHEN NOT isnan(overlap_f1) THEN overlap_f1 END AS overlap_f1, CASE WHEN NOT isnan(latency_ms) THEN latency_ms END AS latency_ms,
  CASE WHEN NOT isnan(cost_usd) THEN cost_usd END AS cost_usd) FROM predictions
  QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY logged_at DESC NULLS LAST) = 1),
long AS (SELECT run_id, config_id, dataset_id, item_id, metric, value FROM (
  SELECT run_id, config_id, dataset_id, item_id, unnest(['overlap_f1', 'latency_ms', 'cost_usd', 'tokens_in', 'tokens_out']) AS metric,
    unnest([overlap_f1, latency_ms, cost_usd, tokens_in::DOUBLE, tokens_out::DOUBLE]) AS value FROM f) WHERE value IS NOT NULL),
series AS (SELECT dataset_id, config_id, item_id, round(avg(overlap_f1), 9) AS value FROM f WHERE overlap_f1 IS NOT NULL GROUP BY ALL)
"""


def sql(body: str, *ctes: str) -> str:
    """A query over the base frames f, long and series, and more CTEs if given."""
    return "WITH " + ", ".join([FACTS, *ctes]) + " " + body
