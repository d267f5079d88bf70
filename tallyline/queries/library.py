"""Dataset algebra, views and integrity checks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as vc
from ..operators import datasets as ds
from ..operators import filters
from ..operators.joins import changed
from ..plans import periods
from ..plans.frames import facts, series, sql, table
from . import query

q = sql


@query("ds_1_freeze", "SELECT item_id, sha256(coalesce(text, '')) AS sha256 FROM test_items")
def freeze(spark, d):
    return ds.freeze(table(spark, d, "test_items"), "item_id", "text")


_V = "a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN sha256(coalesce(upper(text), '')) ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 10 <> 7)"


@query("ds_3_lineage", f"WITH {_V} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def lineage(spark, d):
    """Two versions of a dataset: some documents left out of each and some rewritten."""
    x = table(spark, d, "documents")
    t = F.coalesce("text", F.lit(""))
    a = x.filter("doc_id % 10 <> 3").select("doc_id", F.sha2(t, 256).alias("h"))
    b = x.filter("doc_id % 10 <> 7").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 5, F.upper(t)).otherwise(t), 256).alias("h"))
    return changed(a, b, "doc_id", "h")


@query("ds_4_split", "SELECT doc_id, CASE WHEN substr(sha256('11:' || doc_id), 1, 15) < '4cccccccccccccc' OR substr(sha256('11:' || doc_id), 1, 15) = '4cccccccccccccc' THEN 'test' ELSE 'validation' END AS side FROM documents")
def split(spark, d):
    return table(spark, d, "documents").select("doc_id", ds.side("11", F.col("doc_id"), 0.3).alias("side"))


@query("ds_6_extend", "SELECT item_id, 'parent' AS origin FROM test_items UNION ALL SELECT DISTINCT item_id, 'pick' FROM results WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM test_items)")
def extend(spark, d):
    a = table(spark, d, "test_items").select("item_id", F.lit("parent").alias("origin"))
    b = table(spark, d, "results").filter("item_id IS NOT NULL").select("item_id", F.lit("pick").alias("origin")).distinct()
    return ds.extend(a, b, "item_id")


@query("ds_7_from_capture", """SELECT event_id FROM (SELECT * FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) QUALIFY row_number() OVER (PARTITION BY props ORDER BY event_id) = 1""")
def from_capture(spark, d):
    """A condition, the newest of each key, then the first of equal bodies."""
    from ..operators import ranks as rk

    e = table(spark, d, "events").filter(filters.where({"event_type": F.col("event_type")}, "event_type!=view"))
    one = rk.latest(e, ["user_id", "event_type"], ["ts"], ["event_id", "props"])
    return rk.first_of(one, F.col("props"), "event_id", ["event_id"])


@query("ds_8_sets", "SELECT coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN a.item_id IS NULL THEN 'right' WHEN b.item_id IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT item_id FROM predictions) a FULL JOIN (SELECT DISTINCT item_id FROM item_scores) b ON a.item_id = b.item_id")
def sets(spark, d):
    return ds.set_table(table(spark, d, "predictions").select("item_id"), table(spark, d, "item_scores").select("item_id"))


@query("ds_11_profile", "SELECT count(doc_id) AS n_items, count(DISTINCT sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')))) AS n_texts, count(*) FILTER (len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) = 0) AS n_empty, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')))::BIGINT AS n_words, count(*) FILTER (regexp_matches(text, 'https?://\\S+')) AS n_linked FROM documents")
def profile(spark, d):
    return ds.profile(table(spark, d, "documents"), "doc_id", "text")


@query("ds_12_drift", "SELECT item_id, 'changed' AS state FROM test_items WHERE contains(text, 'boat') AND replace(text, 'boat', 'ship') <> text")
def drift(spark, d):
    """Reference texts against the hashes of their manifest."""
    t = table(spark, d, "test_items")
    return changed(t.select("item_id", F.sha2("text", 256).alias("h")), t.select("item_id", F.sha2(F.regexp_replace("text", "boat", "ship"), 256).alias("h")), "item_id", "h")


RULES = [
    {"when": {"event_type": "error"}, "range": {"k": {"min": 50}}, "label": "severe"}, {"when": {"event_type": ["error", "view"]}, "skip": True},
    {"exists": ["k"], "unless": {"event_type": "purchase"}, "min_age_days": 20, "label": "old"}, {"when": {"event_type": "purchase"}, "label": "sale"},
]


@query("ds_15_rules", """SELECT event_id, CASE WHEN event_type = 'error' AND json_extract(props, '$.k')::DOUBLE >= 50 THEN 'severe' WHEN event_type IN ('error', 'view') THEN NULL
WHEN json_extract(props, '$.k') IS NOT NULL AND event_type <> 'purchase' AND date_diff('day', ts::DATE, DATE '2024-01-31') >= 20 THEN 'old' WHEN event_type = 'purchase' THEN 'sale' END AS label FROM events""")
def rules(spark, d):
    e = table(spark, d, "events")
    fields = {"event_type": F.col("event_type"), "k": F.get_json_object("props", "$.k")}
    age = F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return e.select("event_id", filters.rule_column(RULES, fields, age).alias("label"))


@query("ds_16_attach", "SELECT t.item_id, count(s.score_id) AS n_scores FROM test_items t LEFT JOIN (SELECT DISTINCT score_id, item_id FROM item_scores) s USING (item_id) GROUP BY 1")
def attach(spark, d):
    n = table(spark, d, "item_scores").groupBy("item_id").agg(F.countDistinct("score_id").alias("n"))
    return table(spark, d, "test_items").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_scores"))


@query("ds_17_new_values", """WITH n AS (SELECT DISTINCT unnest(['source', 'lang']) AS field, unnest([source, lang]) AS value FROM documents WHERE created_at >= '2026-01-01'), b AS (SELECT DISTINCT unnest(['source', 'lang']) AS field, unnest([source, lang]) AS value FROM documents WHERE created_at < '2026-01-01')
SELECT field, value FROM n WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.field = n.field AND b.value = n.value)""")
def new_values(spark, d):
    x = table(spark, d, "documents")
    return ds.new_values(x.filter("created_at >= '2026-01-01'"), x.filter("created_at < '2026-01-01'"), ["source", "lang"])


@query("ds_18_blind", "SELECT item_id, config_id, chr(64 + row_number() OVER (PARTITION BY item_id ORDER BY sha256('5|' || item_id || '|' || config_id), config_id)::INT) AS letter FROM (SELECT DISTINCT item_id, config_id FROM predictions)")
def blind(spark, d):
    return ds.blind(table(spark, d, "predictions").select("item_id", "config_id").distinct(), "item_id", "config_id", "5")


@query("ds_21_arms", "SELECT config_id FROM (SELECT DISTINCT config_id FROM predictions WHERE dataset_id = 'elver_qa' UNION SELECT DISTINCT config_id FROM predictions WHERE dataset_id = 'brio_topics') WHERE config_id NOT IN (SELECT config_id FROM predictions WHERE dataset_id = 'ister_judge')")
def arms(spark, d):
    """Arms that ran or were carried over, less the retired."""
    p = table(spark, d, "predictions")
    of = lambda n: p.filter(F.col("dataset_id") == n).select("config_id")
    return of("elver_qa").union(of("brio_topics")).distinct().join(of("ister_judge"), "config_id", "left_anti")


@query("ds_22_adjudicated", "SELECT doc_id, CASE WHEN doc_id % 17 = 0 AND lower(lang) IS NOT DISTINCT FROM 'en' THEN 'ruled' ELSE lang END AS lang, doc_id % 17 = 0 AND lower(lang) IS DISTINCT FROM 'en' AS stale FROM (SELECT doc_id, lower(lang) AS lang FROM documents)")
def adjudicated(spark, d):
    g = table(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang"))
    o = g.filter("doc_id % 17 = 0").select("doc_id", F.lit("en").alias("gold"), F.lit("ruled").alias("ruling"))
    return ds.adjudicated(g, o, "doc_id", "lang")


@query("ds_23_sources", "SELECT source, label, count(*) AS n FROM (SELECT event_type AS label, 'owner' AS source FROM events WHERE user_id % 2 = 0 UNION ALL SELECT CASE WHEN value > 50 THEN 'big' ELSE 'small' END, 'rule' FROM events) GROUP BY 1, 2")
def sources(spark, d):
    e = table(spark, d, "events")
    x = ds.union_sources({"owner": e.filter("user_id % 2 = 0").select(F.col("event_type").alias("label")), "rule": e.select(F.when(F.col("value") > 50, "big").otherwise("small").alias("label"))}, ["label"])
    return x.groupBy("source", "label").agg(F.count("*").alias("n"))


@query("ds_25_cascade", "SELECT doc_id, CASE WHEN regexp_matches(title, '^Notes on') THEN 'notes' WHEN regexp_matches(title, '^(Results|Résultats)') THEN 'results' WHEN regexp_matches(title, '\\d') THEN 'numbered' ELSE 'unknown' END AS verdict FROM documents")
def cascade(spark, d):
    return table(spark, d, "documents").select("doc_id", ds.cascade(F.col("title"), [("^Notes on", "notes"), ("^(Results|Résultats)", "results"), (r"\d", "numbered")], "unknown").alias("verdict"))


@query("sf_34_digest")
def digest(spark, d):
    return ds.digest(ds.freeze(table(spark, d, "test_items"), "item_id", "text"), "item_id", "sha256")


# --- views


@query("cv_3_by_field", q("SELECT CASE WHEN tokens_in IS NULL THEN 'none' WHEN tokens_in < 200 THEN 'short' ELSE 'long' END AS grp, count(DISTINCT item_id) AS n_items, round(avg(overlap_f1), 9) AS mean FROM f GROUP BY 1"))
def by_field(spark, d):
    f = facts(spark, d, "overlap_f1", "tokens_in")
    g = F.when(F.col("tokens_in").isNull(), "none").when(F.col("tokens_in") < 200, "short").otherwise("long")
    return f.groupBy(g.alias("grp")).agg(F.countDistinct("item_id").alias("n_items"), F.round(F.avg("overlap_f1"), 9).alias("mean"))


@query("cv_4_untested", "SELECT DISTINCT run_id FROM run_candidates WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM predictions)")
def untested(spark, d):
    """Runs with a run-level score only."""
    return table(spark, d, "run_candidates").filter("run_id IS NOT NULL").select("run_id").distinct().join(table(spark, d, "predictions").select("run_id"), "run_id", "left_anti")


@query("cv_5_conditions", "SELECT key, count(DISTINCT value) AS n_values FROM (SELECT unnest(['response_model', 'max_tokens', 'source', 'finish_reason']) AS key, unnest([response_model, max_tokens::VARCHAR, source, finish_reason]) AS value FROM completions WHERE starts_with(run_id, 'opal')) WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT value) > 1")
def conditions(spark, d):
    """Settings that differ between the calls compared."""
    kv = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("response_model", "max_tokens", "source", "finish_reason")))).alias("x")
    x = table(spark, d, "completions").filter("startswith(run_id, 'opal')").select(kv).select("x.*").filter("value IS NOT NULL").distinct()
    return x.groupBy("key").agg(F.count("*").alias("n_values")).filter("n_values > 1")


_ARMS5 = ("arm_base", "opal_l", "opal_s", "tarn_l", "wren_m")


@query("cv_7_sheet", q("SELECT dataset_id, item_id, " + ", ".join(f"max(value) FILTER (config_id = '{a}') AS {a}" for a in _ARMS5) + " FROM series GROUP BY 1, 2"))
def sheet(spark, d):
    """Items by arms, arms named beforehand so that no pass is needed to find them."""
    s = series(facts(spark, d, "overlap_f1"), "overlap_f1")
    return s.groupBy("dataset_id", "item_id").pivot("config_id", list(_ARMS5)).agg(F.max("value"))


@query("cv_8_items_out", q("SELECT dataset_id, item_id, count(*) AS n_arms, max(value) AS best, min(value) AS worst FROM series GROUP BY 1, 2"))
def items_out(spark, d):
    s = series(facts(spark, d, "overlap_f1"), "overlap_f1")
    return s.groupBy("dataset_id", "item_id").agg(F.count("*").alias("n_arms"), F.max("value").alias("best"), F.min("value").alias("worst"))


_M = "date_trunc('month', t)::DATE"
_W = "date_trunc('week', t)::DATE"
_BOUNDS = {
    **{f"{n}d": (f"t - {n - 1}", "t", f"t - {2 * n - 1}", f"t - {n}") for n in (7, 14, 30, 90)}, "week": (_W, "t", f"{_W} - 7", "t - 7"), "lastweek": (f"{_W} - 7", f"{_W} - 1", f"{_W} - 14", f"{_W} - 8"),
    "month": (_M, "t", f"({_M} - INTERVAL 1 MONTH)::DATE", f"least(({_M} - INTERVAL 1 MONTH)::DATE + (day(t) - 1)::INT, last_day(({_M} - INTERVAL 1 MONTH)::DATE))"),
    "lastmonth": (f"({_M} - INTERVAL 1 MONTH)::DATE", f"last_day(({_M} - INTERVAL 1 MONTH)::DATE)", f"({_M} - INTERVAL 2 MONTH)::DATE", f"last_day(({_M} - INTERVAL 2 MONTH)::DATE)"),
    "year": ("date_trunc('year', t)::DATE", "t", "(date_trunc('year', t) - INTERVAL 12 MONTH)::DATE", "(t - INTERVAL 12 MONTH)::DATE"), "all": ("f", "t", "NULL", "NULL"),
}


@query("cv_9_periods", "WITH x AS (SELECT max(o_orderdate)::DATE AS t, min(o_orderdate)::DATE AS f FROM orders) " + " UNION ALL ".join(f"SELECT '{k}' AS period, ({a})::DATE::VARCHAR AS since, ({b})::DATE::VARCHAR AS until, ({c})::DATE::VARCHAR AS prev_since, ({e})::DATE::VARCHAR AS prev_until FROM x" for k, (a, b, c, e) in _BOUNDS.items()))
def period_bounds(spark, d):
    x = table(spark, d, "orders").agg(F.to_date(F.max("o_orderdate")).alias("t"), F.to_date(F.min("o_orderdate")).alias("f"))
    p = periods.table(x, "t", F.col("t"), F.col("f"))
    return p.select("period", *(F.col(c).cast("string").alias(c) for c in ("since", "until", "prev_since", "prev_until")))


@query("cv_10i_orders_in_periods", "WITH x AS (SELECT max(o_orderdate)::DATE AS t, min(o_orderdate)::DATE AS f FROM orders), b AS (" + " UNION ALL ".join(f"SELECT '{k}' AS period, ({a})::DATE AS since, ({b})::DATE AS until FROM x" for k, (a, b, _, _) in _BOUNDS.items()) + "), o AS (SELECT o_orderdate::DATE AS day, count(*) AS n, sum(o_totalprice) AS usd FROM orders GROUP BY 1) SELECT period, sum(n)::BIGINT AS n, round(sum(usd), 2) AS usd FROM o JOIN b ON day BETWEEN since AND until GROUP BY 1")
def in_periods(spark, d):
    """Daily totals first; every day then goes to the periods it lies in, whose bounds are computed once."""
    o = table(spark, d, "orders")
    today, first = o.agg(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate"))).first()
    at = [F.struct(F.lit(k).alias("period"), *(c.alias(n) for c, n in zip(periods.bounds(k, F.lit(today), F.lit(first))[:2], ("since", "until"), strict=True))) for k in periods.KEYS]
    days = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("usd"))
    x = days.select("day", "n", "usd", F.explode(F.array(*at)).alias("p")).filter(F.col("day").between(F.col("p.since"), F.col("p.until")))
    return x.groupBy("p.period").agg(F.sum("n").alias("n"), F.round(F.sum("usd"), 2).alias("usd"))


@query("cv_11_search", "SELECT 'arm' AS kind, config_id AS name FROM predictions WHERE contains(lower(config_id), 'opal') GROUP BY 2 UNION ALL SELECT 'dataset', dataset_id FROM predictions WHERE contains(lower(dataset_id), 'opal') GROUP BY 2 UNION ALL SELECT 'set', set_id FROM verdicts WHERE contains(lower(set_id), 'opal') GROUP BY 2 UNION ALL SELECT 'run', run_id FROM run_candidates WHERE contains(lower(run_id), 'opal') GROUP BY 2")
def search(spark, d):
    parts = {"arm": ("predictions", "config_id"), "dataset": ("predictions", "dataset_id"), "set": ("verdicts", "set_id"), "run": ("run_candidates", "run_id")}
    out = None
    for kind, (t, c) in parts.items():
        x = table(spark, d, t).filter(F.lower(c).contains("opal")).select(F.lit(kind).alias("kind"), F.col(c).alias("name")).distinct()
        out = x if out is None else out.unionByName(x)
    return out


@query("cv_16_warnings", q("""SELECT dataset_id, config_id, list_sort(list_filter([CASE WHEN n_runs > 1 THEN 'averaged' END, CASE WHEN missing > 0 THEN 'missing scores' END, CASE WHEN resumed > 0 THEN 'replayed' END], lambda x: x IS NOT NULL))::VARCHAR AS warnings FROM (SELECT dataset_id, config_id, count(DISTINCT run_id) AS n_runs, count(*) - count(overlap_f1) AS missing, sum(resumed) AS resumed FROM f GROUP BY 1, 2)"""))
def warnings(spark, d):
    f = facts(spark, d, "overlap_f1", "resumed")
    x = f.groupBy("dataset_id", "config_id").agg(F.countDistinct("run_id").alias("n_runs"), F.count_if(F.col("overlap_f1").isNull()).alias("missing"), F.sum("resumed").alias("resumed"))
    w = F.array_sort(F.filter(F.array(F.when(F.col("n_runs") > 1, F.lit("averaged")), F.when(F.col("missing") > 0, F.lit("missing scores")), F.when(F.col("resumed") > 0, F.lit("replayed"))), lambda c: c.isNotNull()))
    return x.select("dataset_id", "config_id", F.concat(F.lit("["), F.array_join(w, ", "), F.lit("]")).alias("warnings"))


@query("cv_17_flags", """WITH c AS (SELECT DISTINCT call_id, run_id, finish_reason, tokens_out, max_tokens, text FROM completions) SELECT run_id, count(*) FILTER (finish_reason = 'length') AS cut_off, count(*) FILTER (tokens_out > max_tokens / 2) AS long_replies, count(*) FILTER (text IS NULL OR text = '') AS no_answer FROM c GROUP BY 1 HAVING cut_off + long_replies + no_answer > 0""")
def flags(spark, d):
    c = table(spark, d, "completions").select("call_id", "run_id", "finish_reason", "tokens_out", "max_tokens", F.xxhash64("text").alias("h"), (F.col("text").isNull() | (F.col("text") == "")).alias("none")).distinct()
    x = c.groupBy("run_id").agg(F.count_if(F.col("finish_reason") == "length").alias("cut_off"), F.count_if(F.col("tokens_out") > F.col("max_tokens") / 2).alias("long_replies"), F.count_if("none").alias("no_answer"))
    return x.filter("cut_off + long_replies + no_answer > 0")


# --- checks


def _check(body: str) -> str:
    return body


@query("vc_2_runs_resolve", "SELECT 'run exists' AS \"check\", run_id AS subject, count(*)::VARCHAR AS detail FROM predictions WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM run_candidates WHERE run_id IS NOT NULL) GROUP BY 2")
def runs_resolve(spark, d):
    return vc.resolves(table(spark, d, "predictions"), "run_id", table(spark, d, "run_candidates"), "run_id", "run exists")


@query("vc_3_provenance", "SELECT DISTINCT 'provenance' AS \"check\", run_id AS subject, CASE WHEN run_dir IS NULL AND stratum IS NULL THEN 'run_dir,stratum' WHEN run_dir IS NULL THEN 'run_dir' ELSE 'stratum' END AS detail FROM run_candidates WHERE run_dir IS NULL OR stratum IS NULL")
def provenance(spark, d):
    return vc.present(table(spark, d, "run_candidates"), "run_id", ["run_dir", "stratum"], "provenance")


@query("vc_4_sizes", "SELECT 'size' AS \"check\", doc_id::VARCHAR AS subject, n_chars::VARCHAR AS detail FROM documents WHERE length(coalesce(text, '')) IS DISTINCT FROM n_chars")
def stored_sizes(spark, d):
    return vc.holds(table(spark, d, "documents"), "doc_id", F.length(F.coalesce("text", F.lit(""))) == F.col("n_chars"), F.col("n_chars"), "size")


@query("vc_5_identical_runs", q("""SELECT dataset_id, count(*) AS n_runs, min(run_id) AS first_run FROM (SELECT dataset_id, run_id, string_agg(item_id || '=' || coalesce(overlap_f1::VARCHAR, ''), ';' ORDER BY item_id) AS sig FROM f WHERE overlap_f1 IS NOT NULL GROUP BY 1, 2) GROUP BY dataset_id, sig HAVING count(*) > 1"""))
def identical_runs(spark, d):
    f = facts(spark, d, "overlap_f1").filter("overlap_f1 IS NOT NULL")
    return vc.identical_runs(f, "dataset_id", "run_id", "item_id", "overlap_f1")


@query("vc_8_one_filing", "SELECT 'one filing' AS \"check\", stratum || '|' || run_id AS subject, count(*)::VARCHAR AS detail FROM run_candidates WHERE stratum IS NOT NULL GROUP BY stratum, run_id HAVING count(*) > 1")
def one_filing(spark, d):
    return vc.unique(table(spark, d, "run_candidates").filter("stratum IS NOT NULL"), ["stratum", "run_id"], "one filing")


@query("vc_12_verdicts", "SELECT 'arm exists' AS \"check\", arm AS subject, count(*)::VARCHAR AS detail FROM (SELECT unnest(arm_ids) AS arm FROM verdicts) WHERE arm IS NOT NULL AND arm NOT IN (SELECT run_id FROM run_candidates WHERE run_id IS NOT NULL) GROUP BY 2")
def verdict_arms(spark, d):
    v = table(spark, d, "verdicts").select(F.explode("arm_ids").alias("arm"))
    return vc.resolves(v, "arm", table(spark, d, "run_candidates"), "run_id", "arm exists")


@query("vc_13_values", "SELECT DISTINCT 'better' AS \"check\", verdict_id::VARCHAR AS subject, lower(trim(better)) AS detail FROM verdicts WHERE better IS NOT NULL AND lower(trim(better)) NOT IN ('1', '2', 'tie')")
def verdict_values(spark, d):
    v = table(spark, d, "verdicts").select("verdict_id", F.lower(F.trim("better")).alias("better"))
    return vc.one_of(v, "verdict_id", "better", ["1", "2", "tie"], "better")


@query("vc_14_one_dataset", "SELECT 'one dataset' AS \"check\", run_id AS subject, count(DISTINCT dataset_id)::VARCHAR AS detail FROM predictions GROUP BY 2 HAVING count(DISTINCT dataset_id) > 1")
def one_dataset(spark, d):
    return vc.agrees(table(spark, d, "predictions"), "run_id", "dataset_id", "one dataset")


@query("vc_15_grades", "SELECT DISTINCT 'grade' AS \"check\", score_id::VARCHAR AS subject, e.key || '=' || e.value AS detail FROM (SELECT score_id, unnest(map_entries(per_dimension)) AS e FROM item_scores) WHERE e.value NOT BETWEEN 1 AND 5")
def grade_scale(spark, d):
    e = table(spark, d, "item_scores").select("score_id", F.explode(F.map_entries("per_dimension")).alias("e")).filter("e.value IS NOT NULL")
    return vc.holds(e, "score_id", F.col("e.value").between(1, 5), F.concat("e.key", F.lit("="), "e.value"), "grade")


@query("vc_18_aliases", "SELECT 'alias' AS \"check\", alias AS subject, count(*)::VARCHAR AS detail FROM (SELECT split_part(p_name, ' ', 1) AS alias FROM part) GROUP BY 2 HAVING count(*) > 1")
def aliases(spark, d):
    return vc.unique(table(spark, d, "part").select(F.element_at(F.split("p_name", " "), 1).alias("alias")), ["alias"], "alias")
