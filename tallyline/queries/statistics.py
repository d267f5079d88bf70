"""Paired tests, rank tests and frontiers over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import leaderboard as lb
from ..operators import paired as pr
from ..operators.aggregates import correlation, exact_percentiles
from ..operators.joins import paired
from ..plans.frames import facts, series, sql
from ..storage import durable_table
from . import query

q = sql
BASE = "arm_base"
_PAIR = "pair AS (SELECT s.dataset_id, s.config_id, s.item_id, s.value AS a, b.value AS b, round(s.value - b.value, 9) AS delta FROM series s JOIN series b USING (dataset_id, item_id) WHERE b.config_id = 'arm_base' AND s.config_id <> 'arm_base')"


def _series(spark, d):
    return series(facts(spark, d, "overlap_f1"), "overlap_f1")


@query("st_8_deltas", q("""SELECT dataset_id, config_id, count(*) AS n, round(avg(a), 9) AS mean, round(avg(b), 9) AS baseline_mean, round(avg(delta), 9) AS delta, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties,
pow(2.0, 1 - count(*)) AS least_p FROM pair GROUP BY 1, 2""", _PAIR))
def deltas(spark, d):
    t = pr.delta_table(paired(_series(spark, d), BASE), ["dataset_id", "config_id"])
    return t.select("dataset_id", "config_id", "n", F.round("mean", 9).alias("mean"), F.round("baseline_mean", 9).alias("baseline_mean"), F.round("mean_delta", 9).alias("delta"), "wins", "losses", "ties", F.pow(F.lit(2.0), 1 - F.col("n")).alias("least_p"))


@query("st_8_compare")
def compare(spark, d):
    return pr.compare(_series(spark, d), BASE)


@query("st_9_compare_by")
def compare_by(spark, d):
    """By length of the prompt, one joint correction over groups and arms."""
    f = facts(spark, d, "overlap_f1", "tokens_in")
    g = f.groupBy("item_id").agg(F.avg("tokens_in").alias("t")).select("item_id", F.when(F.col("t") < 200, "short").when(F.col("t") < 350, "middle").otherwise("long").alias("grp"))
    return pr.compare(series(f, "overlap_f1"), BASE, groups=g, intervals=False, joint=True)


@query("st_11_family")
def family(spark, d):
    return pr.family_test(_series(spark, d), "opal_l")


# All items in tens, a test for each ten, whose sign patterns SQL enumerates (ST-1 by groups as in ST-9).
_TENS = _PAIR + """, few AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, grp, config_id ORDER BY item_id) - 1 AS i FROM (SELECT *, regexp_extract(item_id, '(\\d+)$', 1)::INT // 10 AS grp FROM pair)),
obs AS (SELECT dataset_id, grp, config_id, count(*) AS n, abs(sum(delta)) AS total FROM few GROUP BY 1, 2, 3),
pat AS (SELECT dataset_id, grp, config_id, m, abs(sum(CASE WHEN (m >> i) & 1 = 1 THEN delta ELSE -delta END)) AS s FROM few JOIN obs USING (dataset_id, grp, config_id) JOIN (SELECT unnest(generate_series(0, 1023)) AS m) ON m < (1 << n) GROUP BY 1, 2, 3, 4),
p AS (SELECT dataset_id, grp, config_id, any_value(n) AS n, CASE WHEN any_value(total) < 1e-12 THEN 1.0 ELSE avg(CASE WHEN s >= total - 1e-9 THEN 1.0 ELSE 0 END) END AS p FROM pat JOIN obs USING (dataset_id, grp, config_id) GROUP BY 1, 2, 3)"""
_BY_TENS = ["dataset_id", "grp", "config_id"]


def _tens(spark, d):
    return paired(_series(spark, d), BASE).withColumn("grp", F.floor(F.regexp_extract("item_id", r"(\d+)$", 1).cast("int") / 10).cast("int"))


def _tested(p, *keys):
    p = durable_table(p.select(*keys, "item_id", "a", "b", "delta"))
    t = pr.delta_table(p, list(keys))
    return t.join(pr.tests(p, list(keys), t, intervals=False), list(keys)).select(*keys, "n", F.coalesce("p", F.lit(1.0)).alias("p"))


def _tens_p(spark, d):
    return _tested(_tens(spark, d), *_BY_TENS)


def _all_p(spark, d):
    """Every pair of every dataset and arm: beyond what SQL can enumerate."""
    return _tested(paired(_series(spark, d), BASE), "dataset_id", "config_id")


@query("st_1_exact", q("SELECT dataset_id, grp, config_id, n, round(p, 9) AS p FROM p", _TENS))
def exact(spark, d):
    """A test for every ten items of every pair; st_1_exact_all tests each pair as a whole."""
    return _tens_p(spark, d).withColumn("p", F.round("p", 9))


@query("st_1_exact_all")
def exact_all(spark, d):
    return _all_p(spark, d).withColumn("p", F.round("p", 9))


_HOLM = _TENS + """, h AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY dataset_id, grp) AS m FROM p WINDOW w AS (PARTITION BY dataset_id, grp ORDER BY p, config_id))"""


@query("st_3_holm", q("""SELECT dataset_id, grp, config_id, round(0.05 / (m - i), 9) AS threshold, bool_and(p <= 0.05::DOUBLE / (m - i)) OVER (PARTITION BY dataset_id, grp ORDER BY p, config_id ROWS UNBOUNDED PRECEDING) AS significant,
round(max(least(1.0, p * (m - i))) OVER (PARTITION BY dataset_id, grp ORDER BY p, config_id ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM h""", _HOLM))
def holm(spark, d):
    """A family of arms for every ten items; st_3_holm_all takes the pairs as wholes."""
    return _stepped(_tens_p(spark, d), "dataset_id", "grp")


@query("st_3_holm_all")
def holm_all(spark, d):
    return _stepped(_all_p(spark, d), "dataset_id")


def _stepped(p, *family):
    x = pr.holm(p, "p", list(family), ["config_id"])
    return x.select(*family, "config_id", F.round("threshold", 9).alias("threshold"), "significant", F.round("p_holm", 9).alias("p_holm"))


@query("st_5_bonferroni", q("SELECT dataset_id, grp, config_id, round(least(1.0, p * m), 9) AS p_corrected, p <= 0.05::DOUBLE / m AS significant FROM h", _HOLM))
def bonferroni(spark, d):
    """A family of arms for every ten items; st_5_bonferroni_all takes the pairs as wholes."""
    return _by_count(_tens_p(spark, d), "dataset_id", "grp")


@query("st_5_bonferroni_all")
def bonferroni_all(spark, d):
    return _by_count(_all_p(spark, d), "dataset_id")


def _by_count(p, *family):
    from pyspark.sql.window import Window

    x = p.withColumn("m", F.count("*").over(Window.partitionBy(*family)))
    corrected, s = pr.bonferroni(F.col("p"), F.col("m"))
    return x.select(*family, "config_id", F.round(corrected, 9).alias("p_corrected"), s.alias("significant"))


@query("st_7_interval", q("""SELECT dataset_id, config_id, round(avg(delta) - (1.959964 + (pow(1.959964, 3) + 1.959964) / (4 * (count(*) - 1))) * stddev_samp(delta) / sqrt(count(*)), 6) AS low,
round(avg(delta) + (1.959964 + (pow(1.959964, 3) + 1.959964) / (4 * (count(*) - 1))) * stddev_samp(delta) / sqrt(count(*)), 6) AS high FROM pair GROUP BY 1, 2 HAVING count(*) > 30""", _PAIR))
def interval(spark, d):
    z = 1.959964
    n = F.count("*")
    half = (z + (z**3 + z) / (4 * (n - 1))) * F.stddev_samp("delta") / F.sqrt(n)
    return paired(_series(spark, d), BASE).groupBy("dataset_id", "config_id").agg(n.alias("n"), F.round(F.avg("delta") - half, 6).alias("low"), F.round(F.avg("delta") + half, 6).alias("high")).filter("n > 30").drop("n")


@query("st_12_bootstrap")
def bootstrap(spark, d):
    """Two keyword classifiers of languages against a third, on macro-F1."""
    from ..plans.frames import table

    x = F.lower("text")
    t = table(spark, d, "documents").filter("lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("item_id"), F.lower("lang").alias("gold"), x.alias("x"))
    by = lambda *r: F.coalesce(*(F.when(F.col("x").rlike(p), k) for k, p in r), F.lit("en"))
    a = by(("de", " (der|die|das|und) "), ("fr", " (le|les|des|une) "), ("es", " (el|los|una|por) "))
    arms = {"german": by(("de", " (der|die|das|und) ")), "none": F.lit("en"), "romance": by(("fr", " (le|les|des|une) "), ("es", " (el|los|una|por) "))}
    rows = [t.select(F.lit(k).alias("opponent"), "item_id", "gold", a.alias("a"), v.alias("b")) for k, v in arms.items()]
    return pr.bootstrap(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query("st_13_significance")
def significance(spark, d):
    return lb.significance(_series(spark, d))


@query("st_14_pairs")
def pairs(spark, d):
    return lb.distinguishable(lb.significance(_series(spark, d)))


@query("st_20_holdout")
def holdout(spark, d):
    """The rank tests on items that were not judged before."""
    from ..plans.frames import table

    return lb.significance(_series(spark, d).join(table(spark, d, "item_scores").select("item_id"), "item_id", "left_anti"))


@query("st_21_stability")
def stability(spark, d):
    return lb.stability(_series(spark, d))


_PTS = "pts AS (SELECT dataset_id, config_id, round(avg(overlap_f1), 9) AS quality, round(sum(cost_usd), 9) AS cost, round(avg(latency_ms), 7) AS speed FROM f GROUP BY 1, 2)"
_DOM = """d AS (SELECT a.dataset_id, a.config_id AS a, b.config_id AS b, b.quality AS bq FROM pts a JOIN pts b ON a.dataset_id = b.dataset_id AND a.config_id <> b.config_id AND b.quality >= a.quality AND b.cost <= a.cost AND b.speed <= a.speed
AND (b.quality > a.quality OR b.cost < a.cost OR b.speed < a.speed)), best AS (SELECT dataset_id, a AS config_id, arg_min(b, (-bq, b)) AS dominated_by FROM d WHERE (dataset_id, b) NOT IN (SELECT dataset_id, a FROM d) GROUP BY 1, 2)"""


@query("st_18_frontier", q("SELECT p.dataset_id, p.config_id, quality, cost, speed, dominated_by FROM pts p LEFT JOIN best USING (dataset_id, config_id) WHERE quality IS NOT NULL AND cost IS NOT NULL AND speed IS NOT NULL", _PTS, _DOM))
def frontier(spark, d):
    f = facts(spark, d, "overlap_f1", "cost_usd", "latency_ms")
    p = f.groupBy("dataset_id", "config_id").agg(F.round(F.avg("overlap_f1"), 9).alias("quality"), F.round(F.sum("cost_usd"), 9).alias("cost"), F.round(F.avg("latency_ms"), 7).alias("speed"))
    return lb.frontier(p, ["dataset_id"], "config_id", ["quality"], ["cost", "speed"])


@query("st_19_frontier_2d", q("SELECT dataset_id, config_id, quality, cost FROM pts p WHERE quality IS NOT NULL AND cost IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.dataset_id = p.dataset_id AND b.quality >= p.quality AND b.cost <= p.cost AND (b.quality > p.quality OR b.cost < p.cost))", _PTS))
def frontier_2d(spark, d):
    f = facts(spark, d, "overlap_f1", "cost_usd")
    p = f.groupBy("dataset_id", "config_id").agg(F.round(F.avg("overlap_f1"), 9).alias("quality"), F.round(F.sum("cost_usd"), 9).alias("cost"))
    return lb.frontier(p, ["dataset_id"], "config_id", ["quality"], ["cost"]).filter("dominated_by IS NULL").drop("dominated_by")


@query("st_16_decimals", q("SELECT dataset_id, max(length(split_part(overlap_f1::VARCHAR, '.', 2)))::INT AS decimals FROM f WHERE overlap_f1 IS NOT NULL GROUP BY 1"))
def decimals(spark, d):
    """How many decimals the stored scores have."""
    f = facts(spark, d, "overlap_f1").filter("overlap_f1 IS NOT NULL")
    return f.groupBy("dataset_id").agg(F.max(F.length(F.substring_index(F.col("overlap_f1").cast("string"), ".", -1))).alias("decimals"))


@query("st_26_wilson", """WITH v AS (SELECT judge, count(*)::DOUBLE AS n, sum(CASE lower(trim(better)) WHEN '1' THEN 1 WHEN 'tie' THEN 0.5 ELSE 0 END)::DOUBLE AS k FROM (SELECT DISTINCT verdict_id, judge, better FROM verdicts) WHERE lower(trim(better)) IN ('1', '2', 'tie') GROUP BY 1)
SELECT judge, round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 4) AS low,
round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 4) AS high FROM v""")
def wilson(spark, d):
    from ..plans.frames import table

    v = table(spark, d, "verdicts").select("verdict_id", "judge", F.lower(F.trim("better")).alias("b")).distinct().filter(F.col("b").isin("1", "2", "tie"))
    k = v.groupBy("judge").agg(F.sum(F.when(F.col("b") == "1", 1.0).when(F.col("b") == "tie", 0.5).otherwise(0.0)).alias("k"), F.count("*").cast("double").alias("n"))
    low, high = pr.wilson(F.col("k"), F.col("n"))
    return k.select("judge", low.alias("low"), high.alias("high"))


@query("st_27_proportion", """SELECT source, round(avg(x), 9) AS share, round(1.96 * sqrt(avg(x) * (1 - avg(x)) / count(*)), 9) AS half FROM (SELECT DISTINCT call_id, source, CASE WHEN finish_reason = 'length' THEN 1.0 ELSE 0 END AS x FROM completions) GROUP BY 1""")
def proportion(spark, d):
    from ..plans.frames import table

    c = table(spark, d, "completions").select("call_id", "source", F.coalesce(F.col("finish_reason") == "length", F.lit(False)).cast("double").alias("x")).distinct()
    p, half = pr.proportion(F.sum("x"), F.count("*"))
    return c.groupBy("source").agg(F.round(p, 9).alias("share"), F.round(half, 9).alias("half"))


_CORR = "m AS (SELECT dataset_id, item_id, avg(overlap_f1) AS x, avg(tokens_out) AS y FROM f WHERE overlap_f1 IS NOT NULL AND tokens_out IS NOT NULL GROUP BY 1, 2)"


@query("st_23_pearson", q("SELECT dataset_id, count(*) AS n, round(corr(x, y), 6) AS r, round(tanh(atanh(corr(x, y)) - 1.96 / sqrt(count(*) - 3)), 6) AS low, round(tanh(atanh(corr(x, y)) + 1.96 / sqrt(count(*) - 3)), 6) AS high FROM m GROUP BY 1 HAVING count(*) > 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0", _CORR))
def pearson(spark, d):
    """With Fisher's interval (ST-50)."""
    m = facts(spark, d, "overlap_f1", "tokens_out").filter("overlap_f1 IS NOT NULL AND tokens_out IS NOT NULL").groupBy("dataset_id", "item_id").agg(F.avg("overlap_f1").alias("x"), F.avg("tokens_out").alias("y"))
    c = m.groupBy("dataset_id").agg(F.count("*").alias("n"), correlation("x", "y").alias("r")).filter("n > 3 AND r IS NOT NULL")
    low, high = pr.fisher(F.col("r"), F.col("n"))
    return c.select("dataset_id", "n", F.round("r", 6).alias("r"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("st_24_spearman", q("""SELECT dataset_id, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho FROM (SELECT dataset_id, rank() OVER (PARTITION BY dataset_id ORDER BY x) + (count(*) OVER (PARTITION BY dataset_id, x) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY dataset_id ORDER BY y) + (count(*) OVER (PARTITION BY dataset_id, y) - 1) / 2.0 AS ry FROM (SELECT dataset_id, item_id, round(x, 9) AS x, round(y, 9) AS y FROM m)) GROUP BY 1""", _CORR))
def spearman(spark, d):
    from ..operators.ranks import midrank

    m = facts(spark, d, "overlap_f1", "tokens_out").filter("overlap_f1 IS NOT NULL AND tokens_out IS NOT NULL").groupBy("dataset_id", "item_id").agg(F.round(F.avg("overlap_f1"), 9).alias("x"), F.round(F.avg("tokens_out"), 9).alias("y"))
    r = m.select("dataset_id", midrank(["dataset_id"], F.asc("x"), "x").alias("rx"), midrank(["dataset_id"], F.asc("y"), "y").alias("ry"))
    return r.groupBy("dataset_id").agg(F.round(correlation("rx", "ry"), 6).alias("rho"))


@query("st_48_spread", q("SELECT dataset_id, config_id, round(max(m) - min(m), 9) AS spread FROM (SELECT dataset_id, config_id, run_id, avg(overlap_f1) AS m FROM f WHERE overlap_f1 IS NOT NULL GROUP BY ALL) GROUP BY 1, 2 HAVING count(*) > 1"))
def spread(spark, d):
    m = facts(spark, d, "overlap_f1").filter("overlap_f1 IS NOT NULL").groupBy("dataset_id", "config_id", "run_id").agg(F.avg("overlap_f1").alias("m"))
    return m.groupBy("dataset_id", "config_id").agg(F.round(F.max("m") - F.min("m"), 9).alias("spread"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query("st_46_run_compare", q("""SELECT metric, round(b - a, 9) AS delta, CASE WHEN round(b - a, 9) = 0 THEN 'identical' WHEN CASE WHEN metric IN ('cost_usd', 'tokens_in', 'tokens_out', 'latency_ms') THEN round(b - a, 9) < 0 ELSE round(b - a, 9) > 0 END THEN 'better' ELSE 'worse' END AS verdict
FROM (SELECT metric, avg(value) FILTER (config_id = 'opal_l') AS a, avg(value) FILTER (config_id = 'opal_s') AS b FROM long GROUP BY 1)"""))
def run_compare(spark, d):
    from ..operators.filters import verdict
    from ..plans.frames import MEASURES, long_scores

    arm = lambda c: F.avg(F.when(F.col("config_id") == c, F.col("value")))
    x = long_scores(facts(spark, d, *MEASURES)).groupBy("metric").agg(F.round(arm("opal_s") - arm("opal_l"), 9).alias("delta"))
    return x.select("metric", "delta", verdict(F.col("metric"), F.col("delta")).alias("verdict"))


@query("st_47_hypothesis", q("""SELECT dataset_id, grp, config_id, CASE WHEN significant AND delta > 0 THEN 'agrees' WHEN significant AND delta < 0 THEN 'contradicts' ELSE 'open' END AS better,
CASE WHEN significant AND delta < 0 THEN 'contradicts' ELSE 'agrees' END AS no_worse FROM (SELECT dataset_id, grp, config_id, p <= 0.05 AS significant, delta FROM p JOIN (SELECT dataset_id, grp, config_id, avg(delta) AS delta FROM few GROUP BY 1, 2, 3) USING (dataset_id, grp, config_id))""", _TENS))
def hypothesis(spark, d):
    x = _tens_p(spark, d).join(_tens(spark, d).groupBy(*_BY_TENS).agg(F.avg("delta").alias("delta")), _BY_TENS)
    s, low = F.col("p") <= 0.05, F.lit(False)
    return x.select(*_BY_TENS, pr.agreement_with_hypothesis(F.lit("better"), F.col("delta"), low, s).alias("better"), pr.agreement_with_hypothesis(F.lit("no worse"), F.col("delta"), low, s).alias("no_worse"))


@query("st_49_price_slope", q("""SELECT dataset_id, count(*) AS n, round(regr_slope(quality, log10(cost)), 6) AS slope, round(corr(quality, log10(cost)), 6) AS r FROM pts WHERE cost > 0 AND quality IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(cost) > 0 AND stddev_pop(quality) > 0""", _PTS))
def price_slope(spark, d):
    """Quality for ten times the cost, over arms that cost something."""
    f = facts(spark, d, "overlap_f1", "cost_usd")
    p = f.groupBy("dataset_id", "config_id").agg(F.round(F.avg("overlap_f1"), 9).alias("quality"), F.round(F.sum("cost_usd"), 9).alias("cost")).filter("cost > 0 AND quality IS NOT NULL")
    return p.groupBy("dataset_id").agg(F.count("*").alias("n"), F.round(F.try_divide(F.covar_pop("quality", F.log10("cost")), F.var_pop(F.log10("cost"))), 6).alias("slope"), F.round(correlation("quality", F.log10("cost")), 6).alias("r")).filter("n >= 3 AND r IS NOT NULL")


# Under no correlation the density of r goes with (1 - r^2)^((n - 4) / 2); with r = sin t the tail is an integral of cos(t)^(n - 3), by Simpson's rule.
_TAIL = """c AS (SELECT dataset_id, count(*) AS n, corr(x, y) AS r FROM m GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0), k AS (SELECT unnest(generate_series(0, 4000)) AS i),
w AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM k),
h AS (SELECT dataset_id, n, r, asin(abs(r)) AS lo, sum(w * pow(cos(pi() / 2 * i / 4000), n - 3)) * (pi() / 2) AS whole, sum(w * pow(cos(asin(abs(r)) + (pi() / 2 - asin(abs(r))) * i / 4000), n - 3)) * (pi() / 2 - asin(abs(r))) AS tail FROM c, w GROUP BY 1, 2, 3)"""


@query("st_51_r_p_value", q("SELECT dataset_id, n, round(r, 6) AS r, round(tail / whole, 6) AS p FROM h", _CORR, _TAIL))
def r_p_value(spark, d):
    m = facts(spark, d, "overlap_f1", "tokens_out").filter("overlap_f1 IS NOT NULL AND tokens_out IS NOT NULL").groupBy("dataset_id", "item_id").agg(F.avg("overlap_f1").alias("x"), F.avg("tokens_out").alias("y"))

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pr.r_p_value(a, int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    c = m.groupBy("dataset_id").agg(correlation("x", "y").alias("r"), F.count("*").alias("n")).filter("n >= 3 AND r IS NOT NULL")
    return c.select("dataset_id", "n", F.round("r", 6).alias("r"), F.round(p("r", "n"), 6).alias("p"))


@query("st_52_percentile_rank", q("""SELECT dataset_id, config_id, round((rank() OVER (PARTITION BY dataset_id ORDER BY mu) - 1 + 0.5 * (count(*) OVER (PARTITION BY dataset_id, mu) - 1)) / nullif(count(*) OVER (PARTITION BY dataset_id) - 1, 0), 9) AS pct_rank
FROM (SELECT dataset_id, config_id, round(avg(value), 9) AS mu FROM series GROUP BY 1, 2)"""))
def percentile_rank(spark, d):
    m = _series(spark, d).groupBy("dataset_id", "config_id").agg(F.round(F.avg("value"), 9).alias("mu"))
    return lb.percentile_rank(m, ["dataset_id"], "mu").select("dataset_id", "config_id", F.round("pct_rank", 9).alias("pct_rank"))


@query("st_55_rank_shift", q("""SELECT dataset_id, config_id, row_number() OVER (PARTITION BY dataset_id ORDER BY q DESC, config_id) - row_number() OVER (PARTITION BY dataset_id ORDER BY t, config_id) AS shift
FROM (SELECT dataset_id, config_id, round(avg(overlap_f1), 9) AS q, round(avg(tokens_out), 9) AS t FROM f GROUP BY 1, 2) WHERE q IS NOT NULL AND t IS NOT NULL"""))
def rank_shift(spark, d):
    from pyspark.sql.window import Window

    m = facts(spark, d, "overlap_f1", "tokens_out").groupBy("dataset_id", "config_id").agg(F.round(F.avg("overlap_f1"), 9).alias("q"), F.round(F.avg("tokens_out"), 9).alias("t")).filter("q IS NOT NULL AND t IS NOT NULL")
    w = Window.partitionBy("dataset_id")
    return m.select("dataset_id", "config_id", (F.row_number().over(w.orderBy(F.desc("q"), "config_id")) - F.row_number().over(w.orderBy("t", "config_id"))).alias("shift"))


@query("cv_6_analysis", q("""SELECT dataset_id, config_id, round(quantile_cont(delta, 0.25), 9) AS q1, round(quantile_cont(delta, 0.5), 9) AS q2, round(quantile_cont(delta, 0.75), 9) AS q3 FROM pair GROUP BY 1, 2""", _PAIR))
def analysis(spark, d):
    p = paired(_series(spark, d), BASE)
    x = exact_percentiles(p, ["dataset_id", "config_id"], "delta", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return x.select("dataset_id", "config_id", *(F.round(c, 9).alias(c) for c in ("q1", "q2", "q3")))
