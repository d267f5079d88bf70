"""Scans, filters and joins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import filters, joins
from ..plans.frames import MEASURES, facts, long_scores, number, series, sql, table
from . import query

BASE = "arm_base"


def q(s: str, *ctes: str) -> str:
    return sql(s, *ctes)


def dataset(df, name="elver_qa"):
    return df.filter(F.col("dataset_id") == name)


@query("sc_1_run_scan", "SELECT DISTINCT run_id, config_id, dataset_id FROM predictions WHERE dataset_id = 'elver_qa' AND contains(config_id, 'opal')")
def run_scan(spark, d):
    p = table(spark, d, "predictions").filter((F.col("dataset_id") == "elver_qa") & F.col("config_id").contains("opal"))
    return p.select("run_id", "config_id", "dataset_id").distinct()


@query("sc_4_scores", q("SELECT metric, count(*) AS n, round(avg(value), 9) AS mean FROM long GROUP BY metric"))
def scores(spark, d):
    return long_scores(facts(spark, d, *MEASURES)).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"))


@query("sc_5_per_item", q("SELECT item_id, value FROM series WHERE config_id = 'arm_base' AND dataset_id = 'elver_qa'"))
def per_item(spark, d):
    f = dataset(facts(spark, d, "overlap_f1")).filter(F.col("config_id") == BASE)
    return series(f, "overlap_f1").select("item_id", "value")


@query("sc_6_matrix", q("SELECT config_id, item_id, value FROM series WHERE dataset_id = 'dunmore_sum'"))
def matrix(spark, d):
    return series(dataset(facts(spark, d, "overlap_f1"), "dunmore_sum"), "overlap_f1").select("config_id", "item_id", "value")


@query("sc_7_by_arm", "SELECT config_id, count(DISTINCT run_id) AS n_runs, min(run_id) AS first_run, max(run_id) AS last_run FROM predictions GROUP BY config_id")
def by_arm(spark, d):
    return table(spark, d, "predictions").groupBy("config_id").agg(F.countDistinct("run_id").alias("n_runs"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))


_SC11 = """WITH e AS (SELECT event_id::VARCHAR AS id, props AS body, ts AS created_at, event_type AS outcome, 'https://example.org/e/' || event_id AS url FROM events)
SELECT id, body, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, outcome, url FROM e
WHERE outcome IN ('error', 'signup') AND created_at >= '2024-01-05' AND created_at < '2024-01-20'"""


@query("sc_11_import", _SC11)
def imported(spark, d):
    """Mapped records with a text condition (a list is IN) and a half-open window, both pushed to the scan."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("error", "signup") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("body"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                    F.col("event_type").alias("outcome"), F.concat(F.lit("https://example.org/e/"), "event_id").alias("url"))


@query("sc_13_unknown_items", "SELECT DISTINCT item_id FROM item_scores WHERE item_id NOT IN (SELECT item_id FROM predictions WHERE item_id IS NOT NULL) AND item_id IS NOT NULL")
def unknown_items(spark, d):
    """Imported scores whose item no run knows: refused."""
    known = table(spark, d, "predictions").select("item_id")
    return table(spark, d, "item_scores").select("item_id").distinct().join(known, "item_id", "left_anti").filter("item_id IS NOT NULL")


@query("sc_15_page", "SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) BETWEEN 101 AND 150")
def page(spark, d):
    """Rows [100, 150) of a split in key order: the offset is found with a top-k, not a global sort."""
    first = table(spark, d, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(150)
    place = F.row_number().over(Window.orderBy("doc_id"))  # over the 150 rows alone
    return first.withColumn("place", place).filter("place > 100").drop("place")


@query("sc_17_latest_run", """WITH r AS (SELECT dataset_id, config_id, run_id, max(created_at) AS last_at FROM predictions GROUP BY ALL)
SELECT dataset_id, config_id, run_id FROM r QUALIFY row_number() OVER (PARTITION BY dataset_id, config_id ORDER BY last_at DESC, run_id DESC) = 1""")
def latest_run(spark, d):
    """An arm is read as its latest run has it (JN-19)."""
    r = table(spark, d, "predictions").groupBy("dataset_id", "config_id", "run_id").agg(F.max("created_at").alias("at"))
    return r.groupBy("dataset_id", "config_id").agg(F.max(F.struct("at", "run_id")).getField("run_id").alias("run_id"))


@query("sk_2_clean", "SELECT pred_id, max(CASE WHEN NOT isnan(latency_ms) AND NOT isinf(latency_ms) THEN latency_ms END) AS latency_ms FROM predictions GROUP BY pred_id")
def clean(spark, d):
    """NaN and infinite values leave as null."""
    x = F.when(~F.isnan("latency_ms") & (F.abs("latency_ms") < float("inf")), F.col("latency_ms"))
    return table(spark, d, "predictions").groupBy("pred_id").agg(F.max(x).alias("latency_ms"))


# --- filters


@query("fi_1_family", "SELECT config_id, 'part' AS how FROM predictions WHERE contains(config_id, '_m') AND config_id <> 'opal_m' GROUP BY 1 UNION ALL SELECT config_id, 'list' FROM predictions WHERE config_id IN ('opal_l', 'opal_s') GROUP BY 1")
def family(spark, d):
    arms = table(spark, d, "predictions").select("config_id").distinct()
    c = F.col("config_id")
    return arms.filter(filters.family(c, "_m", "opal_m")).withColumn("how", F.lit("part")).unionByName(arms.filter(filters.family(c, "opal_l,opal_s")).withColumn("how", F.lit("list")))


@query("fi_2_items", q("SELECT config_id, item_id FROM series WHERE dataset_id = 'brio_topics' AND item_id NOT IN (SELECT item_id FROM test_items) AND item_id IN (SELECT item_id FROM item_scores)"))
def items(spark, d):
    s = series(dataset(facts(spark, d, "overlap_f1"), "brio_topics"), "overlap_f1").select("config_id", "item_id")
    return s.join(table(spark, d, "test_items").select("item_id"), "item_id", "left_anti").join(table(spark, d, "item_scores").select("item_id"), "item_id", "left_semi").select("config_id", "item_id")


@query("fi_3_field", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars <= 1500")
def field(spark, d):
    x = table(spark, d, "documents")
    return x.filter(filters.field(F.col("lang"), "choice", "en") & filters.field(F.col("n_chars"), "integer", "500..1500")).select("doc_id")


@query("fi_4_where", "SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') = '7' AND coalesce(event_type, '') <> 'view'")
def where(spark, d):
    e = table(spark, d, "events")
    paths = {"props.k": F.get_json_object("props", "$.k"), "event_type": F.col("event_type")}
    return e.filter(filters.where(paths, "props.k=7") & filters.where(paths, "event_type!=view")).select("event_id")


@query("fi_5_window", """SELECT CASE WHEN ts IS NULL THEN 'no time' WHEN ts < '2024-01-05' THEN 'before since' WHEN ts >= '2024-01-25' THEN 'at or after until' ELSE 'inside' END AS reason,
count(*) AS n FROM events GROUP BY 1""")
def window(spark, d):
    e = table(spark, d, "events").select(F.coalesce(filters.outside(F.col("ts").cast("timestamp"), "2024-01-05", "2024-01-25"), F.lit("inside")).alias("reason"))
    return e.groupBy("reason").agg(F.count("*").alias("n"))


_SIGNALS = {"long": "n_chars > 2000", "untitled": "title IS NULL", "unlabelled": "lang IS NULL", "capitals": "lang = upper(lang)"}


@query("fi_6_signals", "WITH s AS (SELECT doc_id, " + ", ".join(f"coalesce({v}, false) AS {k}" for k, v in _SIGNALS.items()) + """ FROM documents)
SELECT doc_id, long::INT + untitled::INT + unlabelled::INT + capitals::INT AS n_signals FROM s WHERE untitled AND long""")
def signals(spark, d):
    """Rows that carry every wanted signal, with how many they carry."""
    got = F.filter(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in _SIGNALS.items())), lambda x: x.isNotNull())
    x = table(spark, d, "documents").select("doc_id", got.alias("signals"))
    return x.filter(F.array_contains("signals", "untitled") & F.array_contains("signals", "long")).select("doc_id", F.size("signals").alias("n_signals"))


@query("fi_7_disagreement", q("""SELECT DISTINCT s.item_id FROM series s JOIN series b USING (dataset_id, item_id)
WHERE s.dataset_id = 'calder_ner' AND b.config_id = 'arm_base' AND s.config_id <> 'arm_base' AND abs(s.value - b.value) > 0.3"""))
def disagreement(spark, d):
    p = joins.paired(series(dataset(facts(spark, d, "overlap_f1"), "calder_ner"), "overlap_f1"), BASE)
    return p.filter(F.abs(F.col("a") - F.col("b")) > 0.3).select("item_id").distinct()


@query("fi_8_arm_patterns", q("""SELECT config_id, round(avg(value), 9) AS mean FROM series WHERE dataset_id = 'elver_qa' AND (config_id LIKE 'opal\\_%' ESCAPE '\\' OR contains(config_id, 'tarn'))
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"""))
def arm_patterns(spark, d):
    s = series(dataset(facts(spark, d, "overlap_f1")), "overlap_f1").filter(filters.arm_patterns(F.col("config_id"), "opal_*,tarn"))
    return s.groupBy("config_id").agg(F.round(F.avg("value"), 9).alias("mean")).orderBy(F.desc("mean"), "config_id").limit(3)


@query("fi_10_one_dataset", "SELECT config_id, count(DISTINCT dataset_id) AS n_datasets FROM predictions GROUP BY 1 HAVING count(DISTINCT dataset_id) > 1")
def one_dataset(spark, d):
    return table(spark, d, "predictions").groupBy("config_id").agg(F.countDistinct("dataset_id").alias("n_datasets")).filter("n_datasets > 1")


@query("fi_11_metric_kinds", q("""SELECT DISTINCT metric, CASE WHEN metric IN ('cost_usd', 'tokens_in', 'tokens_out') THEN 'cost' WHEN metric = 'latency_ms' THEN 'speed' ELSE 'quality' END AS kind,
metric IN ('cost_usd', 'tokens_in', 'tokens_out', 'latency_ms') AS lower_is_better FROM long"""))
def metric_kinds(spark, d):
    m = F.col("metric")
    return long_scores(facts(spark, d, *MEASURES)).select("metric").distinct().select("metric", filters.metric_kind(m).alias("kind"), filters.lower_is_better(m).alias("lower_is_better"))


@query("fi_12_direction", q("""WITH r AS (SELECT DISTINCT metric, config_id FROM long)
SELECT metric, config_id, CASE WHEN config_id = 'opal_m' AND metric = 'tokens_out' THEN 'higher' WHEN metric = 'overlap_f1' AND contains(config_id, 'zs') THEN 'lower'
WHEN metric IN ('cost_usd', 'tokens_in', 'tokens_out', 'latency_ms') THEN 'lower' ELSE 'higher' END AS direction FROM r""".replace("WITH r AS", "SELECT * FROM (WITH r AS") + ")"))
def direction(spark, d):
    """Resolved from a flag, a goal's declaration, the run's record, and the name, in this order."""
    r = long_scores(facts(spark, d, *MEASURES)).select("metric", "config_id").distinct()
    m, c = F.col("metric"), F.col("config_id")
    return r.select("metric", "config_id", filters.direction(F.when((c == "opal_m") & (m == "tokens_out"), "higher"), F.when((m == "overlap_f1") & c.contains("zs"), "lower"), F.lit(None), m).alias("direction"))


@query("fi_13_default_metric", q("SELECT metric FROM (SELECT metric, count(DISTINCT run_id) AS n FROM long WHERE metric NOT IN ('cost_usd', 'tokens_in', 'tokens_out', 'latency_ms') GROUP BY 1 ORDER BY n DESC, metric LIMIT 1)"))
def default_metric(spark, d):
    m = long_scores(facts(spark, d, *MEASURES)).filter(filters.metric_kind(F.col("metric")) == "quality")
    return m.groupBy("metric").agg(F.countDistinct("run_id").alias("n")).orderBy(F.desc("n"), "metric").limit(1).select("metric")


@query("fi_14_bookkeeping", "SELECT config_id, sum(CASE WHEN resumed = 1 THEN 1 ELSE 0 END)::BIGINT AS n_resumed, 4 AS n_metrics FROM (SELECT DISTINCT pred_id, config_id, resumed FROM predictions) GROUP BY 1")
def bookkeeping(spark, d):
    """Of the stored columns, those that are metrics; replayed rows counted beside."""
    cols = spark.createDataFrame([(c,) for c in ("resumed", "self_family_gap", "overlap_f1", "latency_ms", "cost_usd", "tokens_out")], "metric string")
    n = cols.filter(~filters.bookkeeping(F.col("metric"))).count()
    p = table(spark, d, "predictions").select("pred_id", "config_id", "resumed").distinct()
    return p.groupBy("config_id").agg(F.sum(F.when(F.col("resumed") == 1, 1).otherwise(0)).alias("n_resumed")).withColumn("n_metrics", F.lit(n))


@query("fi_15_ambiguous", """WITH r AS (SELECT DISTINCT dataset_id, config_id, run_id FROM predictions)
SELECT dataset_id, config_id, count(*) AS n_runs, count(DISTINCT regexp_replace(run_id, '_r\\d+$', '')) AS n_stems FROM r GROUP BY ALL
HAVING count(*) > 1 AND (NOT bool_and(regexp_matches(run_id, '_r\\d+$')) OR count(DISTINCT regexp_replace(run_id, '_r\\d+$', '')) > 1)""")
def ambiguous(spark, d):
    return filters.ambiguous_runs(table(spark, d, "predictions").select("dataset_id", "config_id", "run_id").distinct())


@query("fi_16_mixed_versions", """WITH a AS (SELECT DISTINCT 'model_' || (p_size % 7) || '_v' || (p_partkey % 3) AS arm FROM part),
x AS (SELECT DISTINCT regexp_extract(arm, '^(.*)_v(\\d+)$', 1) AS stem, regexp_extract(arm, '^(.*)_v(\\d+)$', 2) AS version FROM a)
SELECT stem, count(*) AS n_versions FROM x GROUP BY 1 HAVING count(*) > 1""")
def mixed_versions(spark, d):
    a = table(spark, d, "part").select(F.concat(F.lit("model_"), F.col("p_size") % 7, F.lit("_v"), F.col("p_partkey") % 3).alias("arm"))
    return filters.mixed_versions(a, "arm")


@query("fi_17_sample", "SELECT doc_id FROM documents WHERE substr(sha256('s1:' || doc_id), 1, 16) < '4000000000000000'")
def sample(spark, d):
    return table(spark, d, "documents").filter(filters.sampled(F.col("doc_id"), 0.25, "s1")).select("doc_id")


@query("fi_18_subset", "SELECT item_id FROM (SELECT DISTINCT item_id FROM test_items) ORDER BY sha256('7|noise|' || item_id), item_id LIMIT (SELECT greatest(1, round_even(0.15 * count(DISTINCT item_id), 0)::BIGINT) FROM test_items)")
def subset(spark, d):
    return filters.seeded_subset(table(spark, d, "test_items"), "item_id", 0.15, "7", "noise")


# --- joins


@query("jn_1_paired", q("""SELECT s.dataset_id, s.config_id, count(*) AS n, round(avg(s.value - b.value), 9) AS delta, sum(CASE WHEN round(s.value - b.value, 9) > 0 THEN 1 ELSE 0 END)::BIGINT AS wins,
sum(CASE WHEN round(s.value - b.value, 9) < 0 THEN 1 ELSE 0 END)::BIGINT AS losses FROM series s JOIN series b USING (dataset_id, item_id) WHERE b.config_id = 'arm_base' AND s.config_id <> 'arm_base' GROUP BY 1, 2"""))
def paired(spark, d):
    p = joins.paired(series(facts(spark, d, "overlap_f1"), "overlap_f1"), BASE)
    return p.groupBy("dataset_id", "config_id").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 9).alias("delta"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"))


@query("jn_2_shared_by_all", q("""SELECT s.dataset_id, s.item_id FROM series s JOIN (SELECT dataset_id, count(DISTINCT config_id) AS k FROM series GROUP BY 1) USING (dataset_id) GROUP BY 1, 2 HAVING count(DISTINCT config_id) = any_value(k)"""))
def shared(spark, d):
    return joins.shared_by_all(series(facts(spark, d, "overlap_f1"), "overlap_f1"))


@query("jn_3_holdout", q("SELECT DISTINCT item_id FROM series WHERE item_id NOT IN (SELECT item_id FROM item_scores WHERE item_id IS NOT NULL)"))
def holdout(spark, d):
    return series(facts(spark, d, "overlap_f1"), "overlap_f1").select("item_id").distinct().join(table(spark, d, "item_scores").select("item_id"), "item_id", "left_anti")


@query("jn_4_item_list", q("SELECT dataset_id, config_id, count(*) AS n FROM series WHERE item_id IN (SELECT item_id FROM test_items) GROUP BY 1, 2"))
def item_list(spark, d):
    s = series(facts(spark, d, "overlap_f1"), "overlap_f1").join(table(spark, d, "test_items").select("item_id"), "item_id", "left_semi")
    return s.groupBy("dataset_id", "config_id").agg(F.count("*").alias("n"))


@query("jn_5_by_content", "WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL AND text <> '') SELECT sha AS item_sha256, count(*) AS n_docs, min(doc_id) AS first_doc FROM h GROUP BY 1 HAVING count(*) > 1")
def by_content(spark, d):
    """Items that share their bytes carry each other's labels: grouped by content hash, never paired."""
    h = table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''").select("doc_id", F.sha2("text", 256).alias("item_sha256"))
    return h.groupBy("item_sha256").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


@query("jn_7_left_outer", """WITH r AS (SELECT DISTINCT call_id, item_id, source FROM results), t AS (SELECT item_id, length(text) AS reference_chars FROM test_items)
SELECT r.call_id, r.item_id, t.reference_chars FROM r LEFT JOIN t USING (item_id)""")
def left_outer(spark, d):
    """Outputs with their reference if there is one."""
    r = table(spark, d, "results").select("call_id", "item_id", "source").distinct()
    t = table(spark, d, "test_items").select("item_id", F.length("text").cast("bigint").alias("reference_chars"))
    return r.join(t, "item_id", "left").select("call_id", "item_id", "reference_chars")


_MEANS = "m AS (SELECT config_id, metric, round(avg(value), 9) AS mean FROM long WHERE dataset_id = 'elver_qa' GROUP BY 1, 2)"


@query("jn_9_full_outer", q("""SELECT coalesce(a.metric, b.metric) AS metric, a.mean AS a, b.mean AS b, CASE WHEN a.metric IS NULL THEN 'only b' WHEN b.metric IS NULL THEN 'only a' ELSE 'both' END AS side
FROM (SELECT * FROM m WHERE config_id = 'opal_l') a FULL OUTER JOIN (SELECT * FROM m WHERE config_id = 'opal_s' AND metric <> 'tokens_in') b ON a.metric = b.metric""", _MEANS))
def full_outer(spark, d):
    m = dataset(long_scores(facts(spark, d, *MEASURES))).groupBy("config_id", "metric").agg(F.round(F.avg("value"), 9).alias("mean"))
    a = m.filter("config_id = 'opal_l'").select(F.col("metric").alias("ma"), F.col("mean").alias("a"))
    b = m.filter("config_id = 'opal_s' AND metric <> 'tokens_in'").select(F.col("metric").alias("mb"), F.col("mean").alias("b"))
    side = F.when(F.col("ma").isNull(), "only b").when(F.col("mb").isNull(), "only a").otherwise("both")
    return a.join(b, F.col("ma") == F.col("mb"), "full_outer").select(F.coalesce("ma", "mb").alias("metric"), "a", "b", side.alias("side"))


@query("jn_13_alias", """WITH a AS (SELECT s_suppkey AS model, unnest(['sup' || s_suppkey, 'S-' || s_suppkey]) AS alias FROM supplier)
SELECT l_orderkey, l_linenumber, model FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'sup' || l_suppkey ELSE 'S-' || l_suppkey END AS alias FROM lineitem) JOIN a USING (alias)""")
def alias(spark, d):
    """Calls to model records by any of their aliases."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("model"), F.explode(F.array(F.concat(F.lit("sup"), "s_suppkey"), F.concat(F.lit("S-"), "s_suppkey"))).alias("alias"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.when(F.col("l_linenumber") % 2 == 0, "sup").otherwise("S-"), "l_suppkey").alias("alias"))
    return x.join(a, "alias").select("l_orderkey", "l_linenumber", "model")


@query("jn_14_superseded", """WITH r AS (SELECT run_id, stratum, filed_at, primary_score FROM run_candidates WHERE stratum IS NOT NULL),
l AS (SELECT stratum, run_id, max(filed_at) AS last FROM r GROUP BY 1, 2) SELECT DISTINCT r.stratum, r.run_id, strftime(r.filed_at, '%Y-%m-%d %H:%M:%S.%f') AS filed_at, r.filed_at < l.last AS superseded FROM r JOIN l USING (stratum, run_id)""")
def superseded(spark, d):
    """Filings of a run that a later filing replaces."""
    r = table(spark, d, "run_candidates").filter("stratum IS NOT NULL").select("stratum", "run_id", "filed_at").distinct()
    last = r.groupBy("stratum", "run_id").agg(F.max("filed_at").alias("last"))
    return r.join(last, ["stratum", "run_id"]).select("stratum", "run_id", F.date_format("filed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("filed_at"), (F.col("filed_at") < F.col("last")).alias("superseded"))


_NEAR = """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT event_id AS other, user_id, ts AS t2 FROM events WHERE event_type = 'click'),
n AS (SELECT e.event_id, c.other, abs(epoch_us(e.ts) - epoch_us(c.t2)) AS gap, c.t2 FROM e JOIN c ON e.user_id = c.user_id AND abs(epoch_us(e.ts) - epoch_us(c.t2)) <= 7200000000
  QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(c.t2)), c.t2, c.other) = 1)
SELECT e.event_id, n.other AS nearest_other, round(gap / 1e6, 6) AS gap_s FROM e LEFT JOIN n USING (event_id)"""


@query("jn_15_nearest", _NEAR)
def nearest(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "at")
    right = e.filter("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", "at")
    return joins.nearest_within(left, right, ["user_id"], 7200, "event_id", "other").select("event_id", "nearest_other", F.round("gap_s", 6).alias("gap_s"))


@query("jn_16_followed", """SELECT e.event_id, round((SELECT min(epoch_us(p.ts)) - epoch_us(e.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts >= e.ts AND epoch_us(p.ts) - epoch_us(e.ts) <= 2 * 86400000000) / 86400000000, 9) AS days_after
FROM events e WHERE e.event_type = 'signup'""")
def followed(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    left = e.filter("event_type = 'signup'").select("event_id", "user_id", "at", F.col("event_id").alias("row_id"))
    return joins.followed_within(left, e.filter("event_type = 'purchase'").select("user_id", "at"), ["user_id"], 2).select("event_id", F.round("days_after", 9).alias("days_after"))


_LINKS = """links AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey - 1 END AS same_as, CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN p_brand END AS verdict FROM part)"""


@query("jn_17_two_hops", "WITH " + _LINKS + " SELECT a.n, coalesce(a.verdict, b.verdict, c.verdict) AS resolved FROM links a LEFT JOIN links b ON a.same_as = b.n LEFT JOIN links c ON b.same_as = c.n")
def two_hops(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") - 1).alias("same_as"), F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_size") > 10), F.col("p_brand")).alias("verdict"))
    return joins.follow_twice(p, "n", "same_as", "verdict")


@query("jn_18_first_match", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, ts, event_id) = 1")
def first_match(spark, d):
    return joins.first_match(table(spark, d, "events"), "user_id", F.col("event_type") == "signup", "ts", "event_id")
