"""The pN_ queries and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consensus, leakage, packing, pairs, quantiles, ranking, reading, topn, truncation
from .base import durable, joined, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- 1: top N items within every group

_P1 = """
WITH valid AS (SELECT stratum, run_id, primary_score + 0.0 AS primary_score, filed_at FROM run_candidates
  WHERE stratum IS NOT NULL AND primary_score IS NOT NULL AND NOT isnan(primary_score)),
once AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY stratum, run_id
  ORDER BY filed_at DESC NULLS LAST, primary_score DESC) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY primary_score DESC, run_id) AS rank_in_group FROM once)
"""


@query("p1_found", _P1 + "SELECT stratum, run_id FROM ranked WHERE rank_in_group <= 3")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_top3(spark, sf_dir).select("stratum", "run_id")


@query("p1_top3", _P1 + "SELECT stratum, run_id, primary_score, rank_in_group::INT AS rank_in_group FROM ranked WHERE rank_in_group <= 3")
def p1_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "run_candidates", "stratum", "run_id", "primary_score", "filed_at")
    return topn.top_n_per_group(runs, ["stratum"], "primary_score", "run_id", 3, latest="filed_at")


# --- 2: percentiles

PS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
MEASURES = ["latency_ms", "cost_usd", "tokens_out"]


def _predictions_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pred_id once, as logged last (rows of one pred_id and logged_at are taken to be alike), with its day."""
    p = read(spark, sf_dir, "predictions", "pred_id", "config_id", "dataset_id", "created_at", "logged_at", *MEASURES)
    keys = ["pred_id", "config_id", "dataset_id", F.to_date("created_at").alias("day")]
    at = F.coalesce("logged_at", F.lit("0001-01-01").cast("timestamp"))
    return p.groupBy(*keys).agg(*(F.max_by(m, at).alias(m) for m in MEASURES))


_P2_ONCE = """
WITH last AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY logged_at DESC NULLS LAST) = 1),
long AS (SELECT config_id, dataset_id, created_at::DATE AS day, 'latency_ms' AS measure, latency_ms AS x FROM last UNION ALL
  SELECT config_id, dataset_id, created_at::DATE, 'cost_usd', cost_usd FROM last UNION ALL
  SELECT config_id, dataset_id, created_at::DATE, 'tokens_out', tokens_out::DOUBLE FROM last),
good AS (SELECT * FROM long WHERE x IS NOT NULL AND NOT isnan(x) AND x >= 0 AND NOT isinf(x))
"""


def _p2_sql(key: str, source: str = _P2_ONCE) -> str:
    """Nearest rank; at 65,535 values a group or fewer the sketch is exact and its error bound 0."""
    pick = ", ".join(f"max(CASE WHEN r = greatest(1, ceil({p}::DOUBLE * n)) THEN x END) AS {name}" for name, p in PS.items())
    return source + f""", r AS (SELECT {key}, measure, x, row_number() OVER (PARTITION BY {key}, measure ORDER BY x) AS r,
      count(*) OVER (PARTITION BY {key}, measure) AS n FROM good)
    SELECT {key}, measure, max(n) AS n, 0.0::DOUBLE AS max_rank_error, {pick} FROM r GROUP BY {key}, measure"""


_P2_GROUPS = {"config_id": "config_id", "dataset_id": "dataset_id", "day": "day::VARCHAR", "config_id|day": "config_id || '|' || day::VARCHAR"}


def _p2_all_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{name}' AS grouping, {key} AS group_key, measure, x FROM good" for name, key in _P2_GROUPS.items())
    body = _p2_sql("grouping, group_key", _P2_ONCE.replace("good AS", "good0 AS") + ", good AS (" + parts.replace("FROM good", "FROM good0") + ")")
    return body


@query("p2_percentiles", _p2_all_sql())
def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By config, by dataset, by day and by config and day, from one pass over the table."""
    day = F.col("day").cast("string")
    keys = {"config_id": F.col("config_id"), "dataset_id": F.col("dataset_id"), "day": day, "config_id|day": F.concat("config_id", F.lit("|"), day)}
    groups = F.explode(F.array(*(F.struct(F.lit(k).alias("grouping"), v.alias("group_key")) for k, v in keys.items()))).alias("g")
    long = _predictions_once(spark, sf_dir).select(groups, *MEASURES).select("g.grouping", "g.group_key", *MEASURES)
    return quantiles.percentiles(long, ["grouping", "group_key"], MEASURES, PS)


@query("p2_by_config", _p2_sql("config_id"))
def p2_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_predictions_once(spark, sf_dir), ["config_id"], MEASURES, PS)


@query("p2_by_dataset", _p2_sql("dataset_id"))
def p2_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_predictions_once(spark, sf_dir), ["dataset_id"], MEASURES, PS)


@query("p2_by_day", _p2_sql("day", _P2_ONCE.replace("created_at::DATE", "created_at::DATE::VARCHAR")))
def p2_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_predictions_once(spark, sf_dir).withColumn("day", F.col("day").cast("string")), ["day"], MEASURES, PS)


@query("p2_days_combined", _p2_sql("config_id"))
def p2_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch for each config and day, as would be kept from one day to the next, combined into those of the whole."""
    daily = quantiles.merge_sketches(quantiles.build_sketches(_predictions_once(spark, sf_dir), ["config_id", "day"], MEASURES), ["config_id", "day"], salts=1)
    whole = quantiles.merge_sketches(daily, ["config_id"])
    return quantiles.read_percentiles(whole, ["config_id"], PS)


@query("p2_within_bounds", _P2_ONCE + "SELECT dataset_id, measure, count(*) AS n, " + ", ".join(f"true AS {x}" for x in PS) + " FROM good GROUP BY 1, 2")
def p2_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every percentile of every dataset lies, by exact ranks, within the error that its sketch states: true at any size of a group."""
    once = _predictions_once(spark, sf_dir)
    got = durable(quantiles.percentiles(once, ["dataset_id"], MEASURES, PS))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in MEASURES))).alias("e")
    long = once.select("dataset_id", pairs).select("dataset_id", "e.measure", "e.x").filter("x >= 0 AND NOT isnan(x) AND x < double('infinity')")
    met = joined(long, got.withColumnRenamed("n", "of"), ["dataset_id", "measure"], got.count(), "x")
    counts = [c for x in PS for c in (F.count_if(F.col("x") < F.col(x)).alias(f"{x}_below"), F.count_if(F.col("x") <= F.col(x)).alias(f"{x}_upto"))]
    r = met.groupBy("dataset_id", "measure").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.max("max_rank_error").alias("error"), *counts)
    rank = {x: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) for x, p in PS.items()}
    ok = [((F.col("n") == F.col("of")) & (F.col(f"{x}_below") < rank[x] + F.col("error")) & (F.col(f"{x}_upto") >= rank[x] - F.col("error"))).alias(x) for x in PS]
    return r.select("dataset_id", "measure", "n", *ok)


_P2_RESULTS = """
WITH once AS (SELECT call_id, source, max(latency_ms) AS latency_ms, max(tokens_out) AS tokens_out FROM results GROUP BY call_id, source),
long AS (SELECT source, 'latency_ms' AS measure, latency_ms AS x FROM once UNION ALL SELECT source, 'tokens_out', tokens_out::DOUBLE FROM once),
good AS (SELECT * FROM long WHERE x IS NOT NULL AND NOT isnan(x) AND x >= 0 AND NOT isinf(x))
"""


@query("p2_results_by_source", _p2_sql("source", _P2_RESULTS))
def p2_results_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "results", "call_id", "source", "latency_ms", "tokens_out")
    once = r.groupBy("call_id", "source").agg(F.max("latency_ms").alias("latency_ms"), F.max("tokens_out").alias("tokens_out"))
    return quantiles.percentiles(once, ["source"], ["latency_ms", "tokens_out"], PS)


# --- 3: global ranking from pairwise comparisons


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = p3_strengths(spark, sf_dir)
    return topn.top_n_per_group(s, ["set_id"], "strength", "run_id", 5).select("set_id", "run_id")


@query("p3_strengths")
def p3_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "verdicts", "verdict_id", "set_id", "judge", "arm_ids", "better", "created_at")
    return ranking.strengths(v)


# --- 6: consensus from several annotators' labels


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.grade_labels(read(spark, sf_dir, "item_scores", "score_id", "run_id", "item_id", "judge", "per_dimension", "created_at"))


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.fit(_labels(spark, sf_dir)).grades.select("run_id", "item_id", "dim_name", "grade")


@query("p6_annotators")
def p6_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.fit(_labels(spark, sf_dir)).annotators


_P6_LABELS = """
WITH once AS (SELECT * FROM item_scores QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY created_at) = 1),
entries AS (SELECT run_id, item_id, judge, unnest(map_entries(per_dimension)) AS e FROM once),
labels AS (SELECT run_id, item_id, lower(trim(e.key)) AS dim_name, judge, e.value AS grade FROM entries
  WHERE e.value BETWEEN 1 AND 5 AND judge IS NOT NULL)
"""


@query("p6_agreement", _P6_LABELS + """, g AS (SELECT run_id, item_id, dim_name, grade, count(*) AS n FROM labels GROUP BY ALL)
SELECT run_id, item_id, dim_name, sum(n)::BIGINT AS n_labels,
  CASE WHEN sum(n) > 1 THEN round(sum(n * (n - 1))::DOUBLE / (sum(n) * (sum(n) - 1)), 9) END AS agreement
FROM g GROUP BY run_id, item_id, dim_name""")
def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.unit_agreement(_labels(spark, sf_dir))


@query("p6_finalist_agreement", _P6_LABELS + """, pairs AS (SELECT f.run_id, any_value(f.agreement_rate) AS recorded, count(*) AS n_pairs,
  round(sum(CASE WHEN abs(a.grade - b.grade) <= 1 THEN 1 ELSE 0 END)::DOUBLE / count(*), 9) AS within_one
  FROM finalists f JOIN labels a ON a.run_id = f.run_id AND a.judge = f.primary_judge
  JOIN labels b ON b.run_id = f.run_id AND b.judge = f.cross_judge AND b.item_id = a.item_id AND b.dim_name = a.dim_name GROUP BY f.run_id)
SELECT run_id, round(recorded, 9) AS agreement_rate, n_pairs, within_one FROM pairs""")
def p6_finalist_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every finalist with a cross judge: the recorded agreement rate beside the share of grade pairs within one."""
    f = read(spark, sf_dir, "finalists", "run_id", "primary_judge", "cross_judge", "agreement_rate")
    lab = _labels(spark, sf_dir)
    a = f.join(lab.withColumnRenamed("grade", "ga"), (f.run_id == lab.run_id) & (f.primary_judge == lab.judge)).select(f.run_id, "cross_judge", "agreement_rate", "item_id", "dim_name", "ga")
    b = lab.select(F.col("run_id"), F.col("judge").alias("cross_judge"), "item_id", "dim_name", F.col("grade").alias("gb"))
    pairs = a.join(b, ["run_id", "cross_judge", "item_id", "dim_name"])
    within = (F.abs(F.col("ga") - F.col("gb")) <= 1).cast("double")
    return pairs.groupBy("run_id").agg(F.round(F.max("agreement_rate"), 9).alias("agreement_rate"), F.count("*").alias("n_pairs"), F.round(F.avg(within), 9).alias("within_one"))


# --- 8: evaluation texts leaking into training text


#: The share of an item's words from which p8_found counts it as leaked.
SHARE = 0.4


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "test_items", "item_id", "text"))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the problem states it: two fifths of the item or more, in stretches of seven words or more, which items of fewer words cannot have."""
    return _leaks(spark, sf_dir).filter(F.col("share") >= SHARE).filter(F.col("n_words") >= leakage.STRETCH).select("doc_id", "item_id")


@query("p8_leaked_items")
def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, into how many documents with two fifths or more and with less, and how far at most."""
    much = F.col("share") >= SHARE
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_if(much).alias("n_docs"), F.count_if(~much).alias("n_docs_partly"), F.max("share").alias("greatest_share"))


# --- 4: text cut off by field limits


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "completions", "call_id", "source", "text")
    r = read(spark, sf_dir, "results", "call_id", "source", "output").withColumnRenamed("output", "text")
    return c.unionByName(r)


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_texts(spark, sf_dir)).filter("cut").select("call_id")


@query("p4_by_source")
def p4_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_source(truncation.truncated(_texts(spark, sf_dir)))


@query("p4_limits")
def p4_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = truncation.records(_texts(spark, sf_dir))
    return truncation.limits(rec).select("source", "encoding", "length", "n_texts", "n_cut", F.round("expected", 6).alias("expected"))


# --- 5: broken prompt and response pairs


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "results", "call_id", "source", "prompt", "output", "lang")
    j = read(spark, sf_dir, "judge_results", "call_id", F.concat(F.lit("judge "), F.col("judge")).alias("source"), F.col("message").alias("prompt"), "output", F.lit(None).cast("string").alias("lang"))
    both = r.unionByName(j)
    return pairs.defects(both, pairs.learn(both))


# --- 7: filling fixed-capacity containers


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"))
    return packing.fill(tokens, read(spark, sf_dir, "containers", "container_kind", "capacity_tokens"))


@query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


@query("p7_summary")
def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(_filled(spark, sf_dir))


# --- 9: reading level of each document


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = reading.train(read(spark, sf_dir, "reading_anchors"))
    return reading.levels(read(spark, sf_dir, "documents", "doc_id", "text"), reader).select("doc_id", "level")


@query("p9_by_source")
def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How demanding each source is: prose documents, mean score and the share of each level."""
    reader = reading.train(read(spark, sf_dir, "reading_anchors"))
    got = reading.levels(read(spark, sf_dir, "documents", "doc_id", "text", "source"), reader, "source")
    shares = [F.round(F.avg((F.col("level") == k).cast("double")), 6).alias(f"level_{k}") for k in range(1, reading.LEVELS + 1)]
    return got.groupBy("source").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"), *shares)


@query("p9_validation")
def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated grades by source of the anchors (their language, as these name no source): texts held out, share right, mean error in levels."""
    reader = reading.train(read(spark, sf_dir, "reading_anchors"))
    return spark.createDataFrame(reader.by_source if reader else [], "source string, n_texts int, accuracy double, mean_error double")
