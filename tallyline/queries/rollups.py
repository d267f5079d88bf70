"""Aggregations and ranks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as ag
from ..operators import ranks as rk
from ..plans.frames import MEASURES, facts, long_scores, series, sql, table
from . import query

q = sql


@query("ag_1_run_scores", q("""SELECT run_id, metric, round(avg(value), 9) AS mean, count(*) AS n, CASE WHEN metric IN ('cost_usd', 'tokens_in', 'tokens_out') THEN round(sum(value), 8) END AS total FROM long GROUP BY 1, 2"""))
def run_scores(spark, d):
    return ag.run_scores(long_scores(facts(spark, d, *MEASURES)), digits=9)


_RUNS = "r AS (SELECT dataset_id, config_id, run_id, avg(overlap_f1) AS mean FROM f WHERE overlap_f1 IS NOT NULL GROUP BY ALL)"


@query("ag_2_arm_table", q("SELECT dataset_id, config_id, round(avg(mean), 9) AS mean, round(max(mean) - min(mean), 9) AS spread, count(*) AS n_runs FROM r GROUP BY 1, 2", _RUNS))
def arm_table(spark, d):
    r = facts(spark, d, "overlap_f1").filter("overlap_f1 IS NOT NULL").groupBy("dataset_id", "config_id", "run_id").agg(F.avg("overlap_f1").alias("mean"))
    return ag.arm_table(r)


@query("ag_3_repeats", q("""SELECT config_id, metric, round(avg(m), 9) AS mean, count(*) AS n_runs FROM (SELECT config_id, run_id, metric, avg(value) AS m FROM long GROUP BY ALL)
JOIN (SELECT config_id, count(DISTINCT run_id) AS k FROM f GROUP BY 1) USING (config_id) GROUP BY 1, 2 HAVING count(*) = any_value(k)"""))
def repeats(spark, d):
    """Means over an arm's repeats of the metrics that all of them have."""
    f = facts(spark, d, *MEASURES)
    k = f.groupBy("config_id").agg(F.countDistinct("run_id").alias("k"))
    m = long_scores(f).groupBy("config_id", "run_id", "metric").agg(F.avg("value").alias("m")).groupBy("config_id", "metric").agg(F.round(F.avg("m"), 9).alias("mean"), F.count("*").alias("n_runs"))
    return m.join(k, "config_id").filter("n_runs = k").drop("k")


@query("ag_4_summary", q("SELECT config_id, count(*) AS n, round(avg(latency_ms), 9) AS mean, round(quantile_cont(latency_ms, 0.5), 9) AS p50, round(quantile_cont(latency_ms, 0.95), 9) AS p95 FROM f WHERE latency_ms IS NOT NULL GROUP BY 1"))
def summary(spark, d):
    x = ag.exact_percentiles(facts(spark, d, "latency_ms"), ["config_id"], "latency_ms", {"p50": 0.5, "p95": 0.95})
    return x.select("config_id", "n", *(F.round(c, 9).alias(c) for c in ("mean", "p50", "p95")))


@query("ag_5_quartiles", """WITH s AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT source, max(CASE WHEN i = floor(0.25 * (n - 1) + 0.5) THEN n_chars END) AS q1, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN n_chars END) AS q2, max(CASE WHEN i = floor(0.75 * (n - 1) + 0.5) THEN n_chars END) AS q3 FROM s GROUP BY 1""")
def quartiles(spark, d):
    return ag.nearest_rank(table(spark, d, "documents"), ["source"], "n_chars", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query("ag_5_histogram", """WITH x AS (SELECT lang, n_chars AS v FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL), s AS (SELECT lang, min(v) AS lo, max(v) AS hi, greatest(1, ceil((max(v) - min(v) + 1) / 10.0))::BIGINT AS width FROM x GROUP BY 1),
frame AS (SELECT lang, lo, width, unnest(generate_series(0, (hi - lo) // width)) AS bin FROM s), c AS (SELECT lang, (v - lo) // width AS bin, count(*) AS n FROM x JOIN s USING (lang) GROUP BY 1, 2)
SELECT lang, lo + bin * width AS start, width, coalesce(n, 0) AS n FROM frame LEFT JOIN c USING (lang, bin)""")
def histogram(spark, d):
    return ag.histogram(table(spark, d, "documents").filter("lang IS NOT NULL"), ["lang"], "n_chars")


@query("ag_6_inclusive_quartiles", q("SELECT dataset_id, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS q2, round(quantile_cont(value, 0.75), 9) AS q3 FROM series GROUP BY 1"))
def inclusive(spark, d):
    x = ag.exact_percentiles(series(facts(spark, d, "overlap_f1"), "overlap_f1"), ["dataset_id"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return x.select("dataset_id", *(F.round(c, 9).alias(c) for c in ("q1", "q2", "q3")))


# A keyword classifier of languages (SF-5): the first rule that matches.
RULES = {"de": " (der|die|das|und|den) ", "fr": " (le|les|des|une|dans) ", "es": " (el|los|una|por|del) ", "en": " (the|and|of|for) "}
_PAIRS = "p AS (SELECT lower(lang) AS gold, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{v}') THEN '{k}'" for k, v in RULES.items()) + " END AS pred FROM documents WHERE lang IS NOT NULL)"


def _pairs(spark, d):
    x = F.lower("text")
    c = None
    for k, v in RULES.items():
        c = F.when(x.rlike(v), k) if c is None else c.when(x.rlike(v), k)
    return table(spark, d, "documents").filter("lang IS NOT NULL").select(F.lower("lang").alias("gold"), c.alias("pred"))


_CLASS = """c AS (SELECT label, sum(g) AS support, sum(p) AS predicted, sum(t) AS tp FROM (SELECT gold AS label, 1 AS g, 0 AS p, CASE WHEN gold = pred THEN 1 ELSE 0 END AS t FROM p
UNION ALL SELECT pred, 0, 1, 0 FROM p WHERE pred IS NOT NULL) GROUP BY 1 HAVING sum(g) > 0),
k AS (SELECT label, support::BIGINT AS support, coalesce(tp / nullif(predicted, 0), 0) AS pr, tp / support AS re FROM c),
s AS (SELECT label, support, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM k)"""


@query("ag_7_per_class", f"WITH {_PAIRS}, {_CLASS} SELECT * FROM s")
def per_class(spark, d):
    return ag.per_class(_pairs(spark, d))


@query("ag_8_class_summary", f"""WITH {_PAIRS}, {_CLASS} SELECT n, accuracy, unparsed, macro_f1, worst_class FROM (SELECT count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 9) AS accuracy,
round(avg(CASE WHEN pred IS NULL THEN 1.0 ELSE 0 END), 9) AS unparsed FROM p), (SELECT round(avg(f1), 9) AS macro_f1, arg_min(label, (f1, label)) AS worst_class FROM s)""")
def class_summary(spark, d):
    return ag.class_summary(_pairs(spark, d))


@query("ag_9_confusion", f"WITH {_PAIRS} SELECT gold, " + ", ".join(f"sum(CASE WHEN pred = '{k}' THEN 1 ELSE 0 END)::BIGINT AS {k}" for k in ("de", "en", "es", "fr")) + ", sum(CASE WHEN pred IS NULL THEN 1 ELSE 0 END)::BIGINT AS \"<unparsed>\" FROM p GROUP BY 1")
def confusion(spark, d):
    return ag.confusion(_pairs(spark, d), ["de", "en", "es", "fr"])


_CELLS = """x AS (SELECT DISTINCT call_id, regexp_extract(run_id, '^([a-z]+)_', 1) AS grp, coalesce(finish_reason, 'none') AS down, CASE WHEN tokens_out >= max_tokens THEN 'full' WHEN tokens_out IS NULL THEN 'none' ELSE 'below' END AS across FROM completions)"""


@query("ag_10_crosstab", f"""WITH {_CELLS} SELECT coalesce(grp, 'none') AS grp, CASE WHEN grouping(down) = 1 THEN 'all' ELSE down END AS down, CASE WHEN grouping(across) = 1 THEN 'all' ELSE across END AS across, count(*) AS n
FROM x GROUP BY GROUPING SETS ((grp, down, across), (grp, down), (grp, across), (grp))""")
def crosstab(spark, d):
    """Groups come from the run's name by a regular expression with a capture."""
    x = table(spark, d, "completions").select("call_id", "run_id", "finish_reason", F.when(F.col("tokens_out") >= F.col("max_tokens"), "full").when(F.col("tokens_out").isNull(), "none").otherwise("below").alias("across")).distinct()
    return ag.crosstab(x, F.regexp_extract("run_id", "^([a-z]+)_", 1), F.col("finish_reason"), F.col("across"))


# Entity sets: what a reply lists as JSON, bare, fenced or between sentences, against the places and numbers of its prompt.
_LISTED = r"(?s)\[\s*\{\s*\"text\".*\}\s*\]"
_ENT = f"o AS (SELECT DISTINCT call_id, prompt, regexp_extract(output, '{_LISTED}') AS output FROM results WHERE json_valid(regexp_extract(output, '{_LISTED}')))," + """
pred AS (SELECT call_id, e.text AS text, e.type AS type FROM (SELECT call_id, unnest(from_json(output, '[{"text":"VARCHAR","type":"VARCHAR"}]')) AS e FROM o)),
gold AS (SELECT call_id, text, CASE WHEN regexp_full_match(text, '[0-9]+') THEN 'number' ELSE 'place' END AS type FROM (SELECT call_id, unnest(list_distinct(regexp_extract_all(prompt, '[0-9]+|[A-Z][a-z]+'))) AS text FROM o))"""


def _entities(spark, d):
    o = table(spark, d, "results").select("call_id", "prompt", F.regexp_extract("output", _LISTED, 0).alias("output")).filter("output <> ''").distinct()
    parsed = F.from_json("output", "array<struct<text:string,type:string>>")
    o = o.withColumn("es", parsed).filter("es IS NOT NULL AND is_variant_null(coalesce(try_parse_json(output), parse_json('null'))) = false")
    pred = o.select("call_id", F.explode("es").alias("e")).select("call_id", "e.text", "e.type")
    found = F.array_distinct(F.regexp_extract_all("prompt", F.lit("[0-9]+|[A-Z][a-z]+"), F.lit(0)))
    gold = o.select("call_id", F.explode(found).alias("text")).select("call_id", "text", F.when(F.col("text").rlike("^[0-9]+$"), "number").otherwise("place").alias("type"))
    return pred, gold


_MATCH = """pc AS (SELECT call_id, text, type, count(*) AS p FROM pred GROUP BY ALL), gc AS (SELECT call_id, text, type, count(*) AS g FROM gold GROUP BY ALL),
m AS (SELECT call_id, text, type, least(coalesce(p, 0), coalesce(g, 0)) AS tp, coalesce(p, 0) - least(coalesce(p, 0), coalesce(g, 0)) AS fp, coalesce(g, 0) - least(coalesce(p, 0), coalesce(g, 0)) AS fn FROM pc FULL JOIN gc USING (call_id, text, type))"""
_PRF = """round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE coalesce(tp / nullif(tp + fp, 0), 0) END, 9) AS precision, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE coalesce(tp / nullif(tp + fn, 0), 0) END, 9) AS recall,
round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END, 9) AS f1"""
_SUMS = "sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn"


def _sums(m, *by):
    return m.groupBy(*by).agg(*(F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")))


@query("ag_11_micro_prf", f"WITH {_ENT}, {_MATCH} SELECT tp, fp, fn, {_PRF} FROM (SELECT {_SUMS} FROM m)")
def micro(spark, d):
    p, g = _entities(spark, d)
    return _sums(ag.match_sets(p, g, ["call_id"], ["text", "type"])).select("tp", "fp", "fn", *ag.prf(*map(F.col, ("tp", "fp", "fn"))))


@query("ag_12_per_type", f"WITH {_ENT}, {_MATCH} SELECT type, {_PRF} FROM (SELECT type, {_SUMS} FROM m GROUP BY 1)")
def per_type(spark, d):
    p, g = _entities(spark, d)
    return _sums(ag.match_sets(p, g, ["call_id"], ["text", "type"]), "type").select("type", *ag.prf(*map(F.col, ("tp", "fp", "fn"))))


@query("sf_9_item_prf", f"WITH {_ENT}, {_MATCH} SELECT call_id, {_PRF} FROM (SELECT call_id, {_SUMS} FROM m GROUP BY 1)")
def item_prf(spark, d):
    p, g = _entities(spark, d)
    return _sums(ag.match_sets(p, g, ["call_id"], ["text", "type"]), "call_id").select("call_id", *ag.prf(*map(F.col, ("tp", "fp", "fn"))))


@query("ag_13_type_confusion", f"""WITH {_ENT}, g AS (SELECT call_id, text, max(type) AS gold FROM gold GROUP BY 1, 2) SELECT gold, type AS pred, count(*) AS n FROM pred JOIN g USING (call_id, text) GROUP BY 1, 2""")
def type_confusion(spark, d):
    """Spans that match whatever their type, by gold and predicted type; of several gold types the last."""
    p, g = _entities(spark, d)
    g = g.groupBy("call_id", "text").agg(F.max("type").alias("gold"))
    return p.join(g, ["call_id", "text"]).groupBy("gold", F.col("type").alias("pred")).agg(F.count("*").alias("n"))


@query("ag_14_consensus", f"""WITH {_ENT}, i AS (SELECT DISTINCT call_id, item_id, run_id FROM results), k AS (SELECT item_id, count(DISTINCT run_id) AS n_arms FROM i JOIN (SELECT DISTINCT call_id FROM pred) USING (call_id) GROUP BY 1),
c AS (SELECT item_id, text, count(DISTINCT run_id) AS arms FROM pred JOIN i USING (call_id) GROUP BY 1, 2) SELECT item_id, text, arms, n_arms FROM c JOIN k USING (item_id) WHERE arms >= 2 AND arms * 2 >= n_arms""")
def consensus(spark, d):
    """Members that at least half of an item's arms name (two at least)."""
    p, _ = _entities(spark, d)
    i = table(spark, d, "results").select("call_id", "item_id", "run_id").distinct()
    x = p.join(i, "call_id")
    k = x.groupBy("item_id").agg(F.countDistinct("run_id").alias("n_arms"))
    c = x.groupBy("item_id", "text").agg(F.countDistinct("run_id").alias("arms"))
    return c.join(k, "item_id").filter((F.col("arms") >= 2) & (F.col("arms") * 2 >= F.col("n_arms")))


@query("ag_16_billed", """WITH o AS (SELECT DISTINCT call_id, judge, cost_usd, tokens_in, tokens_out FROM judge_results), a AS (SELECT judge, count(*) AS n, count(cost_usd) AS with_bill, sum(cost_usd) AS billed, sum(tokens_in * 1e-6 + tokens_out * 4e-6) AS recorded FROM o GROUP BY ROLLUP (judge))
SELECT coalesce(judge, 'TOTAL') AS judge, n, with_bill, round(billed, 8) AS billed, round(recorded, 8) AS recorded, CASE WHEN with_bill = n THEN round(billed / nullif(recorded, 0), 6) END AS ratio FROM a""")
def billed(spark, d):
    """Billed against recorded cost with a total; a ratio only where every call has its bill."""
    o = table(spark, d, "judge_results").select("call_id", "judge", "cost_usd", "tokens_in", "tokens_out").distinct()
    rec = F.col("tokens_in") * 1e-6 + F.col("tokens_out") * 4e-6
    a = o.rollup("judge").agg(F.count("*").alias("n"), F.count("cost_usd").alias("with_bill"), F.sum("cost_usd").alias("b"), F.sum(rec).alias("r"))
    return a.select(F.coalesce("judge", F.lit("TOTAL")).alias("judge"), "n", "with_bill", F.round("b", 8).alias("billed"), F.round("r", 8).alias("recorded"),
                    F.when(F.col("n") == F.col("with_bill"), F.round(F.try_divide("b", "r"), 6)).alias("ratio"))


@query("ag_17_projection", q("SELECT config_id, round(avg(latency_ms) * 1000, 4) AS expected_ms, round(max(latency_ms) * 1000, 4) AS at_most_ms, round(avg(cost_usd) * 1000, 8) AS expected_usd FROM f GROUP BY 1"))
def projection(spark, d):
    """A thousand items at an arm's mean and its slowest call."""
    f = facts(spark, d, "latency_ms", "cost_usd")
    return f.groupBy("config_id").agg(F.round(F.avg("latency_ms") * 1000, 4).alias("expected_ms"), F.round(F.max("latency_ms") * 1000, 4).alias("at_most_ms"), F.round(F.avg("cost_usd") * 1000, 8).alias("expected_usd"))


@query("ag_18_fields", """WITH x AS (SELECT unnest(['lang', 'source', 'n_chars', 'title']) AS field, unnest(['choice', 'choice', 'number', 'text']) AS kind, unnest([lang, source, n_chars::VARCHAR, title]) AS text, unnest([NULL, NULL, n_chars::DOUBLE, NULL]) AS num FROM documents)
SELECT field, kind, count(text) AS filled, count(*) AS "of", min(num) AS least, max(num) AS greatest, count(DISTINCT text) AS n_distinct, quantile_cont(num, 0.5) AS median FROM x GROUP BY 1, 2""")
def fields(spark, d):
    return ag.field_summary(table(spark, d, "documents"), {"lang": "choice", "source": "choice", "n_chars": "number", "title": "text"})


@query("ag_19_shape", """WITH t AS (SELECT DISTINCT call_id, output FROM results WHERE output IS NOT NULL) SELECT CASE WHEN starts_with(trim(output), '[') THEN 'list' WHEN starts_with(trim(output), '{') THEN 'record'
WHEN NOT contains(trim(output), ' ') THEN 'label' ELSE 'text' END AS shape, count(*) AS n, count(DISTINCT output) AS n_distinct FROM t GROUP BY 1""")
def shape(spark, d):
    t = table(spark, d, "results").filter("output IS NOT NULL").select("call_id", "output").distinct()
    x = F.trim("output")
    s = F.when(x.startswith("["), "list").when(x.startswith("{"), "record").when(~x.contains(" "), "label").otherwise("text")
    return t.groupBy(s.alias("shape")).agg(F.count("*").alias("n"), F.countDistinct("output").alias("n_distinct"))


@query("ag_20_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))::INT AS n_words FROM documents")
def words(spark, d):
    w = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f]+"), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", w.alias("n_words"))


@query("ag_21_coverage", q("SELECT dataset_id, count(DISTINCT config_id) AS n_arms, count(DISTINCT run_id) AS n_runs, count(DISTINCT item_id) AS n_items, max(created_at)::DATE::VARCHAR AS last_day FROM f GROUP BY 1"))
def coverage(spark, d):
    p = table(spark, d, "predictions")
    return p.groupBy("dataset_id").agg(F.countDistinct("config_id").alias("n_arms"), F.countDistinct("run_id").alias("n_runs"), F.countDistinct("item_id").alias("n_items"), F.to_date(F.max("created_at")).cast("string").alias("last_day"))


_DAYS = "u AS (SELECT dataset_id, config_id, run_id, min(created_at)::DATE AS day FROM f GROUP BY ALL)"


@query("ag_22_activity", q("SELECT dataset_id, day::VARCHAR AS day, count(*) AS n_runs FROM u GROUP BY 1, 2", _DAYS))
def activity(spark, d):
    u = table(spark, d, "predictions").groupBy("dataset_id", "config_id", "run_id").agg(F.to_date(F.min("created_at")).alias("day"))
    return u.groupBy("dataset_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_runs"))


_SPEND = """e AS (SELECT created_at::DATE AS day, 'arm' AS kind, cost_usd AS usd, tokens_in + tokens_out AS tokens FROM f UNION ALL
SELECT day, 'judge', usd, tokens FROM (SELECT DISTINCT verdict_id, created_at::DATE AS day, cost_usd AS usd, tokens_in + tokens_out AS tokens FROM verdicts))"""


@query("ag_23_spend", q("SELECT day::VARCHAR AS day, kind, round(sum(usd), 8) AS usd, sum(tokens)::BIGINT AS tokens FROM e GROUP BY 1, 2", _SPEND))
def spend(spark, d):
    """Money and tokens by day and kind; an amount that nobody recorded adds nothing."""
    return _spend(spark, d).select(F.col("day").cast("string").alias("day"), "kind", F.round("usd", 8).alias("usd"), "tokens")


def _spend(spark, d):
    a = facts(spark, d, "cost_usd", "tokens_in", "tokens_out").select(F.to_date("created_at").alias("day"), F.lit("arm").alias("kind"), F.col("cost_usd").alias("usd"), (F.col("tokens_in") + F.col("tokens_out")).cast("bigint").alias("tokens"))
    v = table(spark, d, "verdicts").select("verdict_id", F.to_date("created_at").alias("day"), F.lit("judge").alias("kind"), F.col("cost_usd").alias("usd"), (F.col("tokens_in") + F.col("tokens_out")).alias("tokens")).distinct().drop("verdict_id")
    return a.unionByName(v).groupBy("day", "kind").agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"))


@query("ag_24_tiles", q("""SELECT kind, round(sum(CASE WHEN day BETWEEN DATE '2026-05-01' AND DATE '2026-05-30' THEN usd END), 8) AS now, round(sum(CASE WHEN day BETWEEN DATE '2026-04-01' AND DATE '2026-04-30' THEN usd END), 8) AS before,
count(DISTINCT CASE WHEN day BETWEEN DATE '2026-05-01' AND DATE '2026-05-30' THEN day END) AS days FROM e GROUP BY 1""", _SPEND))
def tiles(spark, d):
    """A flow in a period and in the one before."""
    s = _spend(spark, d)
    now, before = F.col("day").between("2026-05-01", "2026-05-30"), F.col("day").between("2026-04-01", "2026-04-30")
    return s.groupBy("kind").agg(F.round(F.sum(F.when(now, F.col("usd"))), 8).alias("now"), F.round(F.sum(F.when(before, F.col("usd"))), 8).alias("before"), F.countDistinct(F.when(now, F.col("day"))).alias("days"))


@query("ag_25_in_period", q("""SELECT dataset_id, count(DISTINCT run_id) FILTER (created_at >= '2026-03-01' AND created_at < '2026-04-01') AS runs, count(DISTINCT config_id) FILTER (created_at >= '2026-03-01' AND created_at < '2026-04-01') AS arms,
count(DISTINCT run_id) FILTER (created_at >= '2026-02-01' AND created_at < '2026-03-01') AS runs_before FROM f GROUP BY 1"""))
def in_period(spark, d):
    t = F.col("created_at")
    now, before = (t >= "2026-03-01") & (t < "2026-04-01"), (t >= "2026-02-01") & (t < "2026-03-01")
    return table(spark, d, "predictions").groupBy("dataset_id").agg(F.countDistinct(F.when(now, F.col("run_id"))).alias("runs"), F.countDistinct(F.when(now, F.col("config_id"))).alias("arms"), F.countDistinct(F.when(before, F.col("run_id"))).alias("runs_before"))


@query("ag_26_feed", """WITH a AS (SELECT 'run' AS kind, config_id AS subject, created_at::DATE AS day, count(DISTINCT run_id) AS n FROM predictions GROUP BY ALL UNION ALL SELECT 'verdict', set_id, created_at::DATE, count(DISTINCT verdict_id) FROM verdicts GROUP BY ALL)
SELECT kind, subject, day::VARCHAR AS day, n FROM a ORDER BY a.day DESC, kind, subject LIMIT 200""")
def feed(spark, d):
    """Events rolled up by subject and day, the newest 200."""
    a = table(spark, d, "predictions").groupBy(F.lit("run").alias("kind"), F.col("config_id").alias("subject"), F.to_date("created_at").alias("day")).agg(F.countDistinct("run_id").alias("n"))
    b = table(spark, d, "verdicts").groupBy(F.lit("verdict").alias("kind"), F.col("set_id").alias("subject"), F.to_date("created_at").alias("day")).agg(F.countDistinct("verdict_id").alias("n"))
    return a.unionByName(b).orderBy(F.desc("day"), "kind", "subject").limit(200).select("kind", "subject", F.col("day").cast("string").alias("day"), "n")


@query("ag_29_metric_index", q("SELECT metric, dataset_id, count(DISTINCT config_id) AS n_arms FROM long GROUP BY 1, 2"))
def metric_index(spark, d):
    return long_scores(facts(spark, d, *MEASURES)).groupBy("metric", "dataset_id").agg(F.countDistinct("config_id").alias("n_arms"))


@query("ag_30_provider_mix", "SELECT run_id, source, count(DISTINCT call_id) AS n FROM completions GROUP BY 1, 2")
def provider_mix(spark, d):
    return table(spark, d, "completions").groupBy("run_id", "source").agg(F.countDistinct("call_id").alias("n"))


@query("ag_31_cut_off", "SELECT run_id, count(DISTINCT call_id) AS n FROM completions WHERE finish_reason = 'length' OR (max_tokens > 0 AND tokens_out >= max_tokens) GROUP BY 1")
def cut_off(spark, d):
    hit = (F.col("finish_reason") == "length") | ((F.col("max_tokens") > 0) & (F.col("tokens_out") >= F.col("max_tokens")))
    return table(spark, d, "completions").filter(hit).groupBy("run_id").agg(F.countDistinct("call_id").alias("n"))


_WON = """w AS (SELECT dataset_id, item_id, config_id, 1.0 / count(*) OVER (PARTITION BY dataset_id, item_id) AS share FROM (SELECT *, max(value) OVER (PARTITION BY dataset_id, item_id) AS best FROM series) WHERE best - value < 1e-9)"""


@query("ag_32_footer", q("""SELECT s.dataset_id, s.config_id, round(avg(value), 9) AS mean, count(*) AS n, round(sum(coalesce(share, 0)) / count(*), 9) AS win_rate FROM series s LEFT JOIN w USING (dataset_id, item_id, config_id) GROUP BY 1, 2""", _WON))
def footer(spark, d):
    """Mean and win rate under each arm of a sheet; shared wins are split."""
    s = series(facts(spark, d, "overlap_f1"), "overlap_f1")
    best = F.max("value").over(Window.partitionBy("dataset_id", "item_id"))
    x = s.withColumn("won", (best - F.col("value") < 1e-9).cast("int"))
    x = x.withColumn("share", F.col("won") / F.sum("won").over(Window.partitionBy("dataset_id", "item_id")))
    return x.groupBy("dataset_id", "config_id").agg(F.round(F.avg("value"), 9).alias("mean"), F.count("*").alias("n"), F.round(F.sum("share") / F.count("*"), 9).alias("win_rate"))


@query("ag_34_label_coverage", "SELECT judge, count(DISTINCT item_id) AS items, count(DISTINCT run_id) AS runs FROM item_scores WHERE len(map_keys(per_dimension)) > 0 GROUP BY 1")
def label_coverage(spark, d):
    return table(spark, d, "item_scores").filter(F.size("per_dimension") > 0).groupBy("judge").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("run_id").alias("runs"))


_LAB = """once AS (SELECT * FROM item_scores QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY created_at) = 1), g AS (SELECT run_id, item_id, judge, lower(e.key) AS dim, e.value AS grade FROM (SELECT run_id, item_id, judge, unnest(map_entries(per_dimension)) AS e FROM once))"""


def grades(spark, d):
    """run_id, item_id, judge, dim, grade with each score_id once."""
    x = table(spark, d, "item_scores").groupBy("score_id").agg(F.min_by(F.struct("run_id", "item_id", "judge", "per_dimension"), F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp"))).alias("x"))
    return x.select("x.run_id", "x.item_id", "x.judge", F.explode(F.map_entries("x.per_dimension")).alias("e")).select("run_id", "item_id", "judge", F.lower("e.key").alias("dim"), F.col("e.value").alias("grade"))


@query("ag_37_panel", f"""WITH {_LAB}, m AS (SELECT f.run_id, f.primary_judge, f.cross_judge, g.judge, dim, avg(grade) AS mean FROM finalists f JOIN g ON g.run_id = f.run_id AND (g.judge = f.primary_judge OR g.judge = f.cross_judge) GROUP BY ALL),
o AS (SELECT run_id, primary_judge, cross_judge, avg(mean) FILTER (judge = primary_judge) AS p, avg(mean) FILTER (judge = cross_judge) AS c FROM m GROUP BY ALL)
SELECT run_id, primary_judge, cross_judge, round(p, 9) AS primary_overall, round(c, 9) AS cross_overall, coalesce(abs(p - c) > 0.5, false) AS contested FROM o""")
def panel(spark, d):
    """Mean by dimension, then over dimensions, of the two judges of a finalist; contested beyond half a grade."""
    f = table(spark, d, "finalists").select("run_id", "primary_judge", "cross_judge")
    m = f.join(grades(spark, d), "run_id").filter((F.col("judge") == F.col("primary_judge")) | (F.col("judge") == F.col("cross_judge")))
    m = m.groupBy("run_id", "primary_judge", "cross_judge", "judge", "dim").agg(F.avg("grade").alias("mean"))
    o = m.groupBy("run_id", "primary_judge", "cross_judge").agg(F.avg(F.when(F.col("judge") == F.col("primary_judge"), F.col("mean"))).alias("p"), F.avg(F.when(F.col("judge") == F.col("cross_judge"), F.col("mean"))).alias("c"))
    return o.select("run_id", "primary_judge", "cross_judge", F.round("p", 9).alias("primary_overall"), F.round("c", 9).alias("cross_overall"), F.coalesce(F.abs(F.col("p") - F.col("c")) > 0.5, F.lit(False)).alias("contested"))


@query("ag_38_complete_items", f"""WITH {_LAB}, k AS (SELECT run_id, item_id, count(DISTINCT judge) AS judges FROM g WHERE judge IN ('judge_ash', 'judge_elm') GROUP BY 1, 2) SELECT run_id, item_id, round(avg(grade), 9) AS grade FROM g JOIN k USING (run_id, item_id) WHERE judges = 2 AND judge IN ('judge_ash', 'judge_elm') GROUP BY 1, 2""")
def complete_items(spark, d):
    """Mean over judges, only of items that all of them completed."""
    g = grades(spark, d).filter(F.col("judge").isin("judge_ash", "judge_elm"))
    return g.groupBy("run_id", "item_id").agg(F.countDistinct("judge").alias("k"), F.round(F.avg("grade"), 9).alias("grade")).filter("k = 2").drop("k")


@query("ag_39_judge_calls", """WITH v AS (SELECT DISTINCT verdict_id, judge, better, cost_usd FROM verdicts) SELECT judge, count(*) AS verdicts, count(*) FILTER (better IS NULL OR lower(trim(better)) NOT IN ('1', '2', 'tie')) AS unparsed, round(sum(cost_usd), 8) AS billed, count(*) FILTER (cost_usd IS NULL) AS cost_unknown FROM v GROUP BY 1""")
def judge_calls(spark, d):
    v = table(spark, d, "verdicts").select("verdict_id", "judge", "better", "cost_usd").distinct()
    bad = F.col("better").isNull() | ~F.lower(F.trim("better")).isin("1", "2", "tie")
    return v.groupBy("judge").agg(F.count("*").alias("verdicts"), F.count_if(bad).alias("unparsed"), F.round(F.sum("cost_usd"), 8).alias("billed"), F.count_if(F.col("cost_usd").isNull()).alias("cost_unknown"))


@query("ag_40_family_gap", f"WITH {_LAB} SELECT judge, round(avg(grade) FILTER (starts_with(run_id, 'opal')) - avg(grade) FILTER (NOT starts_with(run_id, 'opal')), 9) AS gap FROM g GROUP BY 1")
def family_gap(spark, d):
    """How much higher a judge grades one family than the others."""
    own = F.col("run_id").startswith("opal")
    return grades(spark, d).groupBy("judge").agg(F.round(F.avg(F.when(own, F.col("grade"))) - F.avg(F.when(~own, F.col("grade"))), 9).alias("gap"))


# --- ranks


@query("rk_1_midrank", q("""SELECT dataset_id, item_id, config_id, rank() OVER (PARTITION BY dataset_id, item_id ORDER BY value) + (count(*) OVER (PARTITION BY dataset_id, item_id, value) - 1) / 2.0 AS rank FROM series"""))
def midrank(spark, d):
    s = series(facts(spark, d, "overlap_f1"), "overlap_f1")
    return s.select("dataset_id", "item_id", "config_id", rk.midrank(["dataset_id", "item_id"], F.asc("value"), "value").alias("rank"))


@query("rk_2_within_item", q("""SELECT dataset_id, item_id, config_id, rank() OVER (PARTITION BY dataset_id, item_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset_id, item_id, value) - 1) / 2.0 AS rank FROM series"""))
def within_item(spark, d):
    """Values are rounded far above the tolerance here, so ties within it are ties of equals."""
    return rk.tolerant_ranks(series(facts(spark, d, "overlap_f1"), "overlap_f1"), ["dataset_id", "item_id"], "config_id", "value")


@query("rk_3_average_rank", q("""SELECT dataset_id, config_id, round(avg(rank), 9) AS avg_rank FROM (SELECT dataset_id, item_id, config_id, rank() OVER (PARTITION BY dataset_id, item_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset_id, item_id, value) - 1) / 2.0 AS rank FROM series) GROUP BY 1, 2"""))
def average_rank(spark, d):
    return within_item(spark, d).groupBy("dataset_id", "config_id").agg(F.round(F.avg("rank"), 9).alias("avg_rank"))


@query("rk_5_tied_at_top", q("SELECT dataset_id, count(*) FILTER (mu = best) AS tied FROM (SELECT *, max(mu) OVER (PARTITION BY dataset_id) AS best FROM (SELECT dataset_id, config_id, round(avg(value), 2) AS mu FROM series GROUP BY 1, 2)) GROUP BY 1"))
def tied_at_top(spark, d):
    m = series(facts(spark, d, "overlap_f1"), "overlap_f1").groupBy("dataset_id", "config_id").agg(F.round(F.avg("value"), 2).alias("mu"))
    return m.withColumn("best", F.max("mu").over(Window.partitionBy("dataset_id"))).groupBy("dataset_id").agg(F.count_if(F.col("mu") == F.col("best")).alias("tied"))


_CAND = "c AS (SELECT stratum, run_id, max(primary_score) AS score FROM run_candidates WHERE stratum IS NOT NULL AND primary_score IS NOT NULL AND NOT isnan(primary_score) GROUP BY 1, 2)"


@query("rk_7_promote", f"""WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, run_id) AS rank, first_value(score) OVER (PARTITION BY stratum ORDER BY score DESC, run_id) AS leader FROM c),
t AS (SELECT stratum, run_id, score FROM r WHERE rank <= 4 AND score >= 0.9 * leader ORDER BY score DESC, run_id LIMIT 300)
SELECT stratum, run_id, score, 'top' AS reason FROM t UNION ALL SELECT stratum, run_id, score, 'override' FROM r WHERE contains(run_id, '_106_') AND (stratum, run_id) NOT IN (SELECT stratum, run_id FROM t)""")
def promote(spark, d):
    c = table(spark, d, "run_candidates").filter("stratum IS NOT NULL AND primary_score IS NOT NULL AND NOT isnan(primary_score)").groupBy("stratum", "run_id").agg(F.max("primary_score").alias("score"))
    return rk.promote(c, "stratum", "score", "run_id", 4, 0.9, 300, ("_106_",))


@query("rk_8_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(spark, d):
    return rk.latest(table(spark, d, "events"), ["user_id"], ["ts"], ["event_id", "event_type"])


@query("rk_9_dedup", """SELECT doc_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS k FROM documents WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""")
def dedup(spark, d):
    """The first of documents that are equal but for case and blanks; grouped by a hash of the text."""
    x = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r\\f\\x0b]+", " ")), 256).alias("k"))
    return rk.first_of(x, F.col("k"), "doc_id", ["doc_id"])


@query("rk_10_state", "SELECT user_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type IN ('purchase', 'view')")
def state(spark, d):
    """The last line of a log wins, then the filter."""
    return rk.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).filter(F.col("event_type").isin("purchase", "view"))


@query("rk_12_winners", q("SELECT dataset_id, item_id, config_id, round(share, 9) AS share FROM w", _WON))
def winners(spark, d):
    return rk.argmax_set(series(facts(spark, d, "overlap_f1"), "overlap_f1"), ["dataset_id", "item_id"], "config_id", "value").withColumn("share", F.round("share", 9))


@query("rk_14_running", q("SELECT kind, day::VARCHAR AS day, round(sum(sum(usd)) OVER (PARTITION BY kind ORDER BY day), 9) AS running FROM e GROUP BY kind, day", _SPEND))
def running(spark, d):
    return rk.running_total(_spend(spark, d), ["kind"], "day", "usd").select("kind", F.col("day").cast("string").alias("day"), F.round("running", 9).alias("running"))


@query("rk_15_newest", "SELECT doc_id FROM documents WHERE created_at IS NOT NULL ORDER BY created_at DESC, doc_id DESC LIMIT (SELECT round_even(count(created_at) * 0.2, 0)::BIGINT FROM documents)")
def newest(spark, d):
    return rk.newest_share(table(spark, d, "documents").select("doc_id", "created_at"), "created_at", "doc_id", 0.2).select("doc_id")


_ARMS = "a AS (SELECT DISTINCT dataset_id, item_id, config_id FROM predictions)"


@query("rk_16_shuffled", f"WITH {_ARMS} SELECT dataset_id, item_id, config_id, row_number() OVER (PARTITION BY dataset_id, item_id ORDER BY sha256('7|primary|' || dataset_id || '|' || item_id || '|' || config_id), config_id) AS place FROM a")
def shuffled(spark, d):
    a = table(spark, d, "predictions").select("dataset_id", "item_id", "config_id").distinct()
    return rk.shuffled(a, ["dataset_id", "item_id"], "config_id", "7", "primary")


@query("rk_17_blocks", f"""WITH {_ARMS}, s AS (SELECT dataset_id, item_id, config_id, row_number() OVER (PARTITION BY dataset_id, item_id ORDER BY config_id) AS place, count(*) OVER (PARTITION BY dataset_id, item_id) AS n FROM a),
k AS (SELECT *, ceil(n / 4.0)::BIGINT AS k FROM s), t AS (SELECT *, n % k AS big, n // k AS size FROM k) SELECT dataset_id, item_id, config_id, CASE WHEN place <= big * (size + 1) THEN (place - 1) // (size + 1) ELSE big + (place - 1 - big * (size + 1)) // size END AS block FROM t""")
def blocks(spark, d):
    a = table(spark, d, "predictions").select("dataset_id", "item_id", "config_id").distinct()
    a = a.withColumn("place", F.row_number().over(Window.partitionBy("dataset_id", "item_id").orderBy("config_id")))
    return rk.blocks(a, ["dataset_id", "item_id"], "place", 4).select("dataset_id", "item_id", "config_id", "block")
