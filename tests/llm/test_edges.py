"""Extra columns with clashing names, empty tables, nulls everywhere, repeats: every operator has a defined result."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tallyline.llm import consensus, leakage, packing, pairs, quantiles, ranking, reading, topn, truncation

NAMES = ("a", "b", "d", "i", "j", "k", "m", "n", "x", "e", "w", "g0", "m0", "k0", "at", "score", "ident", "vote", "salt", "judge_", "level_", "tokens_", "code", "cut", "ending", "covered", "part", "piece", "grade", "labels", "who", "rank_in_group", "n_full", "lean", "first")


def load(spark, name, rows=None):
    df = spark.read.parquet(f"{DATA}/{name}.parquet")
    return df if rows is None else df.limit(rows)


def cluttered(df):
    """With columns of the names that the operators use inside."""
    for n in NAMES:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("clash"))
    return df


def nulled(df, key):
    """Every row again, with nulls in all columns but the key, and one of nulls alone."""
    none = df.select(*(F.col(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
    return df.unionByName(none).unionByName(none.select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes)).limit(1))


def anchors(spark):
    return reading.train(load(spark, "reading_anchors"))


OPERATORS = {
    "topn": ("run_candidates", "run_id", lambda s, df: topn.top_n_per_group(df, ["stratum"], "primary_score", "run_id", 3, latest="filed_at")),
    "quantiles": ("predictions", "pred_id", lambda s, df: quantiles.percentiles(df, ["config_id"], ["latency_ms", "tokens_out"], {"p50": 0.5})),
    "ranking": ("verdicts", "verdict_id", lambda s, df: ranking.strengths(df)),
    "truncation": ("completions", "call_id", lambda s, df: truncation.truncated(df)),
    "pairs": ("results", "call_id", lambda s, df: pairs.defects(df, pairs.learn(df, 500))),
    "consensus": ("item_scores", "score_id", lambda s, df: consensus.fit(consensus.grade_labels(df)).grades),
    "packing": ("documents", "doc_id", lambda s, df: packing.fill(packing.token_counts(df), load(s, "containers"))),
    "leakage": ("documents", "doc_id", lambda s, df: leakage.leaks(df, cluttered(load(s, "test_items")))),
    "reading": ("documents", "doc_id", lambda s, df: reading.levels(df, anchors(s))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_change_nothing(spark, name):
    table, _, op = OPERATORS[name]
    df = load(spark, table)
    assert op(spark, cluttered(df)).count() == op(spark, df).count() > 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    table, _, op = OPERATORS[name]
    assert op(spark, load(spark, table).filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_in_every_column(spark, name):
    table, key, op = OPERATORS[name]
    assert op(spark, nulled(load(spark, table, 60), key)).count() >= 0


def test_reader_without_anchors(spark):
    none = reading.train(load(spark, "reading_anchors").filter(F.lit(False)))
    assert none is None and reading.levels(load(spark, "documents"), none).count() == 0


def test_containers_without_kinds(spark):
    assert packing.fill(packing.token_counts(load(spark, "documents")), load(spark, "containers").filter(F.lit(False))).count() == 0
