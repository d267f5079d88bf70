"""Further roll-ups, rankings, scorers, dataset steps, views and checks over the test tables."""

from __future__ import annotations

import functools
import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parsers as ps
from ..functions import text as tx
from ..operators import agreement as agr
from ..operators import checks as vc
from ..operators import datasets as ds
from ..operators import paired as pr
from ..operators import ranks as rk
from ..operators.aggregates import correlation, per_class
from ..operators.joins import paired
from ..plans import periods, reports
from ..storage import durable_table
from ..plans.frames import MEASURES, facts, long_scores, series, sql, table
from . import query
from .rollups import _CLASS, _LAB, _PAIRS, _pairs, grades
from .scoring import _DENSE, _dense, _outputs, _OUT, _votes, _VOTES, _w
from .selections import BASE

q = sql
# Arms whose last run has an even repeat number were scored against a silver reference.
_REF = "ref AS (SELECT dataset_id, config_id, CASE WHEN max(regexp_extract(run_id, '_r(\\d+)$', 1)::INT) % 2 = 0 THEN 'silver' ELSE 'gold' END AS reference FROM f GROUP BY 1, 2)"


def _repeat(c="run_id"):
    return F.regexp_extract(c, r"_r(\d+)$", 1).cast("int")


def _series(spark, d):
    return series(facts(spark, d, "overlap_f1"), "overlap_f1")


@query("fi_9_reference_guard", q("SELECT dataset_id, config_id, reference, coalesce(reference <> (SELECT max(b.reference) FROM ref b WHERE b.dataset_id = ref.dataset_id AND b.config_id = 'arm_base'), false) AS set_aside FROM ref", _REF))
def reference_guard(spark, d):
    a = table(spark, d, "predictions").groupBy("dataset_id", "config_id").agg(F.when(F.max(_repeat()) % 2 == 0, "silver").otherwise("gold").alias("reference"))
    return reports.reference_guard(a, BASE)


_HALF = "h AS (SELECT dataset_id, config_id, item_id, regexp_extract(run_id, '_r(\\d+)$', 1)::INT % 2 AS odd, round(avg(overlap_f1), 9) AS value FROM f WHERE overlap_f1 IS NOT NULL GROUP BY ALL)"


@query("jn_8_cross_version", q("SELECT dataset_id, config_id, count(*) AS n, round(avg(b.value - a.value), 9) AS delta FROM h a JOIN h b USING (dataset_id, config_id, item_id) WHERE a.odd = 1 AND b.odd = 0 GROUP BY 1, 2 HAVING count(*) >= 3", _HALF))
def cross_version(spark, d):
    """The same arm on two versions of a dataset, on the items both hold."""
    f = facts(spark, d, "overlap_f1").withColumn("odd", _repeat() % 2)
    s = series(f, "overlap_f1", "dataset_id", "config_id", "item_id", "odd")
    a, b = (s.filter(F.col("odd") == k).select("dataset_id", "config_id", "item_id", F.col("value").alias(n)) for k, n in ((1, "a"), (0, "b")))
    return a.join(b, ["dataset_id", "config_id", "item_id"]).groupBy("dataset_id", "config_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 9).alias("delta")).filter("n >= 3")


@query("jn_10_qrels", f"WITH {_DENSE} SELECT query_id, place::INT AS place, CASE WHEN c.label = q.label THEN 1 ELSE 0 END AS grade FROM top JOIN embeddings c ON c.vec_id = doc_id JOIN q USING (query_id)")
def qrels(spark, d):
    """A ranking exploded and met with its relevance grades; what has none is 0."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    r = _dense(spark, d).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    return r.join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").select("query_id", "place", F.coalesce((F.col("label") == F.col("want")).cast("int"), F.lit(0)).alias("grade"))


_RELABEL = _PAIRS + ", p2 AS (SELECT CASE WHEN pred IS NOT NULL AND pred <> gold AND pred <> 'en' THEN pred ELSE gold END AS gold, pred FROM p)"


@query("ag_15_ceiling", f"WITH {_RELABEL}, {_CLASS.replace('FROM p ', 'FROM p2 ').replace('FROM p' + chr(10), 'FROM p2' + chr(10))} SELECT * FROM s")
def ceiling(spark, d):
    """Scores after the gold is relabelled where the classifier's keywords contradict it."""
    p = _pairs(spark, d)
    gold = F.when(F.col("pred").isNotNull() & (F.col("pred") != F.col("gold")) & (F.col("pred") != "en"), F.col("pred")).otherwise(F.col("gold"))
    return per_class(p.select(gold.alias("gold"), "pred"))


@query("ag_27_configs", q("SELECT config_id, count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT run_id) AS n_runs, round(sum(cost_usd), 8) AS usd, min(created_at)::DATE::VARCHAR AS first_day, max(created_at)::DATE::VARCHAR AS last_day FROM f GROUP BY 1"))
def configs(spark, d):
    f = facts(spark, d, "cost_usd")
    return f.groupBy("config_id").agg(F.countDistinct("dataset_id").alias("n_datasets"), F.countDistinct("run_id").alias("n_runs"), F.round(F.sum("cost_usd"), 8).alias("usd"), F.to_date(F.min("created_at")).cast("string").alias("first_day"), F.to_date(F.max("created_at")).cast("string").alias("last_day"))


_MOVED = "rr AS (SELECT dataset_id, config_id, run_id, avg(overlap_f1) AS m, max(created_at) AS t FROM f WHERE overlap_f1 IS NOT NULL GROUP BY ALL)"


@query("ag_28_moved", q("SELECT dataset_id, config_id, round(arg_max(m, (t, run_id)) - arg_min(m, (t, run_id)), 9) AS moved FROM rr GROUP BY 1, 2", _MOVED))
def moved(spark, d):
    """How far an arm's last run is from its first."""
    r = facts(spark, d, "overlap_f1").filter("overlap_f1 IS NOT NULL").groupBy("dataset_id", "config_id", "run_id").agg(F.avg("overlap_f1").alias("m"), F.max("created_at").alias("t"))
    last, first = F.max(F.struct("t", "run_id", "m")).getField("m"), F.min(F.struct("t", "run_id", "m")).getField("m")
    return r.groupBy("dataset_id", "config_id").agg(F.round(last - first, 9).alias("moved"))


@query("ag_33_signals", "SELECT signal, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN title IS NULL THEN 'untitled' END, CASE WHEN lang IS NULL THEN 'unlabelled' END], lambda x: x IS NOT NULL)) AS signal FROM documents) GROUP BY 1")
def signal_counts(spark, d):
    s = F.filter(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("title").isNull(), "untitled"), F.when(F.col("lang").isNull(), "unlabelled")), lambda x: x.isNotNull())
    return table(spark, d, "documents").select(F.explode(s).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


@query("ag_35_distinct", "SELECT dataset_id, count(DISTINCT item_id) AS items, count(DISTINCT run_id) AS runs FROM predictions GROUP BY 1")
def distinct(spark, d):
    """Exact; approx_count_distinct is there for those who want it."""
    return table(spark, d, "predictions").groupBy("dataset_id").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("run_id").alias("runs"))


@query("ag_36_cube", "SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE coalesce(source, '-') END AS source, CASE WHEN grouping(finish_reason) = 1 THEN '*' ELSE coalesce(finish_reason, '-') END AS finish_reason, count(*) AS n FROM (SELECT DISTINCT call_id, source, finish_reason FROM completions) GROUP BY CUBE (source, finish_reason)")
def cube(spark, d):
    c = table(spark, d, "completions").select("call_id", "source", "finish_reason").distinct().cube("source", "finish_reason").agg(F.count("*").alias("n"), F.grouping("source").alias("gs"), F.grouping("finish_reason").alias("gf"))
    name = lambda g, c: F.when(F.col(g) == 1, "*").otherwise(F.coalesce(c, F.lit("-"))).alias(c)
    return c.select(name("gs", "source"), name("gf", "finish_reason"), "n")


@query("rk_4_subset_ranks", q("SELECT dataset_id, config_id, rank() OVER (PARTITION BY dataset_id ORDER BY mu DESC) + (count(*) OVER (PARTITION BY dataset_id, mu) - 1) / 2.0 AS rank FROM (SELECT dataset_id, config_id, round(avg(value), 9) AS mu FROM series WHERE item_id IN (SELECT item_id FROM test_items) GROUP BY 1, 2)"))
def subset_ranks(spark, d):
    m = _series(spark, d).join(table(spark, d, "test_items").select("item_id"), "item_id", "left_semi").groupBy("dataset_id", "config_id").agg(F.round(F.avg("value"), 9).alias("mu"))
    return m.select("dataset_id", "config_id", rk.midrank(["dataset_id"], F.desc("mu"), "mu").alias("rank"))


@query("rk_6_missing_last", "SELECT stratum, run_id, primary_score, row_number() OVER (PARTITION BY stratum ORDER BY primary_score DESC NULLS LAST, run_id) AS position FROM (SELECT stratum, run_id, max(CASE WHEN isnan(primary_score) THEN NULL ELSE primary_score END) AS primary_score FROM run_candidates GROUP BY 1, 2)")
def missing_last_all(spark, d):
    """Every run of every stratum in its place, those without a score last. The window spills."""
    r = table(spark, d, "run_candidates").groupBy("stratum", "run_id").agg(F.max(F.when(~F.isnan("primary_score"), F.col("primary_score"))).alias("primary_score"))
    return r.withColumn("position", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc_nulls_last("primary_score"), "run_id")))


@query("rk_11_latest_rescore", "SELECT stratum, run_id, arg_max(primary_score, (filed_at, primary_score)) AS primary_score FROM run_candidates WHERE stratum IS NOT NULL AND primary_score IS NOT NULL AND NOT isnan(primary_score) AND filed_at IS NOT NULL GROUP BY 1, 2")
def latest_rescore(spark, d):
    r = table(spark, d, "run_candidates").filter("stratum IS NOT NULL AND primary_score IS NOT NULL AND NOT isnan(primary_score) AND filed_at IS NOT NULL")
    return rk.latest(r, ["stratum", "run_id"], ["filed_at"], ["primary_score"])


@query("rk_13_one_place", q("SELECT dataset_id, config_id, row_number() OVER (PARTITION BY dataset_id ORDER BY best DESC, config_id) AS place FROM (SELECT dataset_id, config_id, round(max(m), 9) AS best FROM rr GROUP BY 1, 2)", _MOVED))
def one_place(spark, d):
    """Runs of a dataset ranked with one place for each config: its best run."""
    r = facts(spark, d, "overlap_f1").filter("overlap_f1 IS NOT NULL").groupBy("dataset_id", "config_id", "run_id").agg(F.avg("overlap_f1").alias("m"))
    b = r.groupBy("dataset_id", "config_id").agg(F.round(F.max("m"), 9).alias("best"))
    return b.select("dataset_id", "config_id", F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("best"), "config_id")).alias("place"))


# --- statistics


@query("st_2_drawn")
def drawn(spark, d):
    """Seeded sign-flip p of every arm of every dataset."""
    p = durable_table(paired(_series(spark, d), BASE))
    t = pr.delta_table(p, ["dataset_id", "config_id"])
    return pr.tests(p, ["dataset_id", "config_id"], t)


@query("st_10_pair", q("SELECT dataset_id, count(*) AS n, round(avg(a.value - b.value), 9) AS delta, count(*) FILTER (a.value > b.value) AS wins, count(*) FILTER (a.value = b.value) AS ties FROM series a JOIN series b USING (dataset_id, item_id) WHERE a.config_id = 'opal_l' AND b.config_id = 'opal_s' GROUP BY 1"))
def pair(spark, d):
    p = paired(_series(spark, d).filter(F.col("config_id").isin("opal_l", "opal_s")), "opal_s")
    t = pr.delta_table(p, ["dataset_id", "config_id"])
    return t.select("dataset_id", "n", F.round("mean_delta", 9).alias("delta"), "wins", "ties")


_SHARED = "sh AS (SELECT dataset_id, item_id FROM series JOIN (SELECT dataset_id, count(DISTINCT config_id) AS k FROM series GROUP BY 1) USING (dataset_id) GROUP BY 1, 2 HAVING count(DISTINCT config_id) = any_value(k))"


@query("st_17_leaderboard", q("""SELECT dataset_id, 'gold' AS reference, config_id, round(avg(m), 9) AS mean, round(max(m) - min(m), 9) AS spread, count(*) AS n_runs, any_value(avg_rank) AS avg_rank,
row_number() OVER (PARTITION BY dataset_id ORDER BY round(avg(m), 9) DESC NULLS LAST, config_id) AS position FROM (SELECT dataset_id, config_id, run_id, avg(overlap_f1) AS m FROM f GROUP BY ALL) LEFT JOIN
(SELECT dataset_id, config_id, round(avg(r), 9) AS avg_rank FROM (SELECT dataset_id, config_id, rank() OVER (PARTITION BY dataset_id, item_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset_id, item_id, value) - 1) / 2.0 AS r FROM series JOIN sh USING (dataset_id, item_id)) GROUP BY 1, 2) USING (dataset_id, config_id) GROUP BY dataset_id, config_id""", _SHARED))
def leaderboard(spark, d):
    return reports.leaderboard(facts(spark, d, "overlap_f1"), "overlap_f1")


@query("st_56_by_reference", q("""SELECT dataset_id, reference, config_id, round(avg(m), 9) AS mean, count(*) AS n_runs FROM (SELECT dataset_id, config_id, run_id, CASE WHEN regexp_extract(run_id, '_r(\\d+)$', 1)::INT % 2 = 0 THEN 'silver' ELSE 'gold' END AS reference, avg(overlap_f1) AS m FROM f GROUP BY ALL) GROUP BY 1, 2, 3"""))
def by_reference(spark, d):
    ref = F.when(_repeat() % 2 == 0, "silver").otherwise("gold")
    return reports.leaderboard(facts(spark, d, "overlap_f1"), "overlap_f1", reference=ref).select("dataset_id", "reference", "config_id", "mean", "n_runs")


_TIERS = "ti AS (SELECT dataset_id, item_id, regexp_extract(config_id, '^(.*)_[ls]$', 1) AS family, max(value) FILTER (ends_with(config_id, '_l')) AS l, max(value) FILTER (ends_with(config_id, '_s')) AS s FROM series WHERE regexp_matches(config_id, '_[ls]$') GROUP BY ALL)"


@query("st_37_tiers", q("SELECT dataset_id, family, count(*) AS n, round(avg(l - s), 9) AS delta FROM ti WHERE l IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2", _TIERS))
def tiers(spark, d):
    """The large against the small arm of each family."""
    s = _series(spark, d).filter(F.col("config_id").rlike("_[ls]$"))
    end = lambda x: F.max(F.when(F.col("config_id").endswith(x), F.col("value")))
    t = s.groupBy("dataset_id", "item_id", F.regexp_extract("config_id", "^(.*)_[ls]$", 1).alias("family")).agg(end("_l").alias("l"), end("_s").alias("s")).dropna(subset=["l", "s"])
    return t.groupBy("dataset_id", "family").agg(F.count("*").alias("n"), F.round(F.avg(F.col("l") - F.col("s")), 9).alias("delta"))


_SILVER = f"""o1 AS (SELECT call_id, item_id, split_part(run_id, '_', 1) AS family, output FROM results WHERE output IS NOT NULL AND lang = 'en' QUALIFY row_number() OVER (PARTITION BY item_id, split_part(run_id, '_', 1) ORDER BY call_id, output) = 1),
o2 AS (SELECT call_id, item_id, family, {_w('output')} AS w FROM o1), pr AS (SELECT a.family AS author, b.family AS subject, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE 2 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END AS f1 FROM o2 a JOIN o2 b USING (item_id) WHERE a.family <> b.family)"""


@query("st_38_silver", f"WITH {_SILVER} SELECT author, subject, count(*) AS n, round(avg(f1), 9) AS f1 FROM pr GROUP BY 1, 2")
def silver(spark, d):
    """Each family's first output of an item as the reference for the others': one row an item and family, so that pairs are of families."""
    o = table(spark, d, "results").filter("output IS NOT NULL AND lang = 'en'").groupBy("item_id", F.element_at(F.split("run_id", "_"), 1).alias("family")).agg(F.min(F.struct("call_id", "output")).getField("output").alias("output"))
    o = o.select("item_id", "family", F.array_distinct(tx.words(F.col("output"))).alias("w"))
    a, b = o.select("item_id", F.col("family").alias("author"), F.col("w").alias("x")), o.select("item_id", F.col("family").alias("subject"), F.col("w").alias("y"))
    f1 = F.when((F.size("x") == 0) | (F.size("y") == 0), 0.0).otherwise(2 * F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y")))
    return a.join(b, "item_id").filter("author <> subject").groupBy("author", "subject").agg(F.count("*").alias("n"), F.round(F.avg(f1), 9).alias("f1"))


@query("st_53_replication", q("""SELECT dataset_id, config_id, count(*) FILTER (a.value IS NOT NULL AND b.value IS NOT NULL) AS n, count(*) FILTER (a.value = b.value) AS identical, round(avg(a.value - b.value), 9) AS change, count(*) FILTER (a.value IS NULL OR b.value IS NULL) AS one_side
FROM (SELECT * FROM h WHERE odd = 1) b FULL JOIN (SELECT * FROM h WHERE odd = 0) a USING (dataset_id, config_id, item_id) GROUP BY 1, 2""", _HALF))
def replication(spark, d):
    f = facts(spark, d, "overlap_f1").withColumn("odd", _repeat() % 2)
    s = series(f, "overlap_f1", "dataset_id", "config_id", "item_id", "odd")
    return reports.replication(s.filter("odd = 1"), s.filter("odd = 0"))


@query("st_54_judge_ceiling", f"""WITH {_LAB}, x AS (SELECT judge, dim, grade, (sum(grade) OVER w - grade) / (count(*) OVER w - 1) AS rest, count(*) OVER w AS k FROM g WHERE grade BETWEEN 1 AND 5 WINDOW w AS (PARTITION BY run_id, item_id, dim))
SELECT judge, dim, round(CASE WHEN stddev_pop(grade) > 0 AND stddev_pop(rest) > 0 THEN corr(grade, rest) END, 6) AS r FROM x WHERE k >= 3 GROUP BY 1, 2""")
def judge_ceiling(spark, d):
    """By dimension, how well one judge foretells the mean of the others."""
    w = Window.partitionBy("run_id", "item_id", "dim")
    x = grades(spark, d).filter(F.col("grade").between(1, 5)).withColumn("k", F.count("*").over(w)).withColumn("rest", (F.sum("grade").over(w) - F.col("grade")) / (F.col("k") - 1)).filter("k >= 3")
    return x.groupBy("judge", "dim").agg(F.round(correlation("grade", "rest"), 6).alias("r"))


# --- scorers


@query("sf_5_classifier", f"WITH {_PAIRS} SELECT coalesce(pred, 'none') AS pred, count(*) AS n FROM p GROUP BY 1")
def classifier(spark, d):
    return _pairs(spark, d).groupBy(F.coalesce("pred", F.lit("none")).alias("pred")).agg(F.count("*").alias("n"))


@query("sf_11_dedupe", "SELECT set_id, item_id, min(verdict_id) AS first_verdict, count(DISTINCT a) AS n_arms FROM (SELECT set_id, item_id, verdict_id, unnest(arm_ids) AS a FROM verdicts) GROUP BY 1, 2")
def dedupe(spark, d):
    """Arms that a set shows for an item, each once."""
    v = table(spark, d, "verdicts").select("set_id", "item_id", "verdict_id", F.explode("arm_ids").alias("a"))
    return v.groupBy("set_id", "item_id").agg(F.min("verdict_id").alias("first_verdict"), F.countDistinct("a").alias("n_arms"))


#: So many queries meet the documents in one scan.
FLOOR_QUERIES = 1000


def _first_by_hash(names: list[str], k: int = 5):
    """Of the doc_ids that a task has, the first k of every query by hash: k rows a query are held, whatever the documents."""

    def run(batches):
        starts, best = [f"floor|{n}|".encode() for n in names], [[] for _ in names]
        for batch in batches:
            docs = [(str(i).encode(), i) for i in batch.column(0).to_pylist()]
            for q, start in enumerate(starts):
                best[q] = heapq.nsmallest(k, best[q] + [(sha256(start + t).digest(), i) for t, i in docs])
        rows = [(n, i, h) for n, kept in zip(names, best, strict=True) for h, i in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["query_id", "doc_id", "h"])

    return run


@query("sf_18_random_floor", "SELECT query_id, doc_id FROM (SELECT t.item_id AS query_id, d.doc_id FROM (SELECT DISTINCT item_id FROM test_items) t, documents d) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sha256('floor|' || query_id || '|' || doc_id), doc_id) <= 5")
def random_floor_all(spark, d):
    """The floor over all documents, for every test item. The queries go to the documents in blocks; each task keeps five a query, and a window picks among those."""
    names = sorted(r[0] for r in table(spark, d, "test_items").select("item_id").distinct().collect())
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = [docs.mapInArrow(_first_by_hash(names[i : i + FLOOR_QUERIES]), "query_id string, doc_id long, h binary") for i in range(0, len(names), FLOOR_QUERIES)]
    p = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id string, doc_id long, h binary")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("h", "doc_id"))).filter("place <= 5").select("query_id", "doc_id")


@query("sf_23_item_taus", f"""WITH {_LAB}, x AS (SELECT x.run_id, x.judge AS ja, y.judge AS jb, x.dim, x.item_id, x.grade AS a, y.grade AS b FROM g x JOIN g y USING (run_id, item_id, dim) WHERE x.judge < y.judge),
p AS (SELECT l.ja, l.jb, l.run_id, l.dim, sum(sign(l.a - r.a) * sign(l.b - r.b)) AS c, sum(abs(sign(l.a - r.a))) AS u, sum(abs(sign(l.b - r.b))) AS w FROM x l JOIN x r ON l.ja = r.ja AND l.jb = r.jb AND l.run_id = r.run_id AND l.dim = r.dim AND l.item_id < r.item_id GROUP BY 1, 2, 3, 4)
SELECT ja, jb, run_id, dim, round(CASE WHEN u = 0 OR w = 0 THEN 0 ELSE c / sqrt(u * w) END, 6) AS tau FROM p""")
def item_taus(spark, d):
    """By pair of judges, run and dimension, tau-b over the run's items that both graded (tens of items; an item has a handful of judges)."""
    g = grades(spark, d).withColumnRenamed("judge", "ja").withColumnRenamed("grade", "a")
    x = g.join(g.withColumnsRenamed({"ja": "jb", "a": "b"}), ["run_id", "item_id", "dim"]).filter("ja < jb")
    y = x.groupBy("ja", "jb", "run_id", "dim").agg(F.array_sort(F.collect_list(F.struct("item_id", "a", "b"))).alias("xs")).filter(F.size("xs") >= 2)
    return y.select("ja", "jb", "run_id", "dim", F.round(agr.kendall_tau_b(F.col("xs.a"), F.col("xs.b")), 6).alias("tau"))


@query("sf_24_chance", f"WITH {_VOTES} SELECT set_id, round(avg(CASE vote WHEN 'tie' THEN 0.5 WHEN '1' THEN 1 ELSE 0 END), 9) AS first_share, round(1.0 / 2, 9) AS chance FROM v GROUP BY 1")
def chance(spark, d):
    return _votes(spark, d).groupBy("set_id").agg(F.round(F.avg(F.when(F.col("vote") == "tie", 0.5).when(F.col("vote") == "1", 1.0).otherwise(0.0)), 9).alias("first_share"), F.round(F.lit(0.5), 9).alias("chance"))


@query("sf_30_echo", "SELECT item_id, array_to_string(list_slice(string_split(text, '. '), 1, 2), '. ') AS output FROM test_items")
def echo(spark, d):
    return table(spark, d, "test_items").select("item_id", F.array_join(F.slice(F.split("text", "\\. "), 1, 2), ". ").alias("output"))


@query("sf_35_fields", """SELECT doc_id, try_cast(title AS DOUBLE) AS number, CASE lower(lang) WHEN 'en' THEN true WHEN 'de' THEN false END AS flag, CASE WHEN regexp_full_match(created_at::DATE::VARCHAR, '\\d{4}-\\d{2}-\\d{2}') THEN created_at::DATE::VARCHAR END AS day FROM documents""")
def field_values(spark, d):
    """Texts read as numbers, flags and days; what does not read is null."""
    day = F.to_date("created_at").cast("string")
    return table(spark, d, "documents").select("doc_id", F.col("title").try_cast("double").alias("number"), F.when(F.lower("lang") == "en", True).when(F.lower("lang") == "de", False).alias("flag"), F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).alias("day"))


@query("sf_36_diff")
def diff(spark, d):
    """Words that each output keeps of its reference, inserts and deletes, and the marked text."""
    return _outputs(spark, d).select("call_id", ps.diffed("reference", "output").alias("d")).select("call_id", "d.*")


_MONTHS = "mo AS (SELECT date_trunc('month', created_at)::DATE AS month, count(*) AS n FROM f GROUP BY 1)"


@query("sf_38_trend", q("SELECT month::VARCHAR AS month, n, CASE WHEN lag(n) OVER (ORDER BY month) <> 0 THEN round((n - lag(n) OVER (ORDER BY month)) / abs(lag(n) OVER (ORDER BY month)) * 100, 1) END AS change FROM mo", _MONTHS))
def trend(spark, d):
    m = facts(spark, d, "overlap_f1").groupBy(F.trunc("created_at", "month").alias("month")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    return m.select(F.col("month").cast("string").alias("month"), "n", periods.trend(F.col("n"), before).alias("change"))


# --- datasets and views


@query("ds_2_verify", "SELECT item_id FROM test_items WHERE sha256(replace(text, 'boat', 'ship')) <> sha256(text)")
def verify(spark, d):
    """Items whose text no longer has its frozen hash."""
    t = table(spark, d, "test_items")
    frozen = ds.freeze(t, "item_id", "text")
    now = t.select("item_id", F.sha2(F.regexp_replace("text", "boat", "ship"), 256).alias("now"))
    return frozen.join(now, "item_id").filter("now <> sha256").select("item_id")


@query("ds_9_intersect", "SELECT item_id FROM predictions INTERSECT SELECT item_id FROM test_items")
def intersect(spark, d):
    return table(spark, d, "predictions").select("item_id").intersect(table(spark, d, "test_items").select("item_id"))


@query("ds_10_except", "SELECT item_id FROM predictions EXCEPT SELECT item_id FROM test_items")
def except_(spark, d):
    return table(spark, d, "predictions").select("item_id").subtract(table(spark, d, "test_items").select("item_id"))


@query("ds_14_labels_from_run", "SELECT DISTINCT call_id, lower(trim(output)) AS label FROM results WHERE output IS NOT NULL AND regexp_matches(output, '[A-Za-z]') AND (finish_reason IS NULL OR finish_reason NOT IN ('length', 'max_tokens')) AND length(output) < 20")
def labels_from_run(spark, d):
    """Outputs as labels; empty and cut off ones are refused."""
    ok = F.col("output").isNotNull() & F.col("output").rlike("[A-Za-z]") & (F.col("finish_reason").isNull() | ~F.col("finish_reason").isin("length", "max_tokens")) & (F.length("output") < 20)
    return table(spark, d, "results").filter(ok).select("call_id", F.lower(F.trim("output")).alias("label")).distinct()


@query("ds_19_rescore", f"WITH {_OUT}, w AS (SELECT call_id, {_w('output')} AS a, {_w('reference')} AS b FROM o) SELECT call_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS score FROM w")
def rescore(spark, d):
    o = _outputs(spark, d)
    x = ds.rescore(o.select("call_id", "output"), o.select("call_id", "reference"), "call_id", tx.overlap_f1(F.col("output"), F.col("reference")), ["call_id"])
    return x.select("call_id", F.round("score", 9).alias("score"))


@query("ds_24_judged_runs", f"WITH {_LAB} SELECT run_id, round(avg(grade), 9) AS judge_score, count(DISTINCT item_id) AS n_items FROM g WHERE grade BETWEEN 1 AND 5 GROUP BY 1")
def judged_runs(spark, d):
    """Runs whose metric is the mean grade."""
    return grades(spark, d).filter(F.col("grade").between(1, 5)).groupBy("run_id").agg(F.round(F.avg("grade"), 9).alias("judge_score"), F.countDistinct("item_id").alias("n_items"))


@query("cv_1_base", q("SELECT dataset_id, config_id, metric, round(avg(value), 9) AS mean, count(DISTINCT run_id) AS n_runs, count(DISTINCT item_id) AS n_items FROM long GROUP BY 1, 2, 3"))
def base_view(spark, d):
    return long_scores(facts(spark, d, *MEASURES)).groupBy("dataset_id", "config_id", "metric").agg(F.round(F.avg("value"), 9).alias("mean"), F.countDistinct("run_id").alias("n_runs"), F.countDistinct("item_id").alias("n_items"))


@query("cv_2_compare")
def compare(spark, d):
    """A comparison over the items that were judged, on short prompts."""
    items = table(spark, d, "item_scores").select("item_id").distinct()
    return reports.compare_filtered(facts(spark, d, "overlap_f1", "tokens_in"), "overlap_f1", BASE, F.col("tokens_in") < 350, items, intervals=False)


@query("cv_10b_datasets", "SELECT p.dataset_id, count(DISTINCT p.item_id) AS n_items, count(DISTINCT t.item_id) AS held_out, count(DISTINCT p.config_id) AS n_arms FROM predictions p LEFT JOIN test_items t USING (item_id) GROUP BY 1")
def dataset_view(spark, d):
    p = table(spark, d, "predictions").select("dataset_id", "item_id", "config_id").distinct().join(table(spark, d, "test_items").select("item_id", F.col("item_id").alias("held")), "item_id", "left")
    return p.groupBy("dataset_id").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("held").alias("held_out"), F.countDistinct("config_id").alias("n_arms"))


@query("cv_10f_models", "SELECT response_model AS model, count(DISTINCT call_id) AS calls, count(DISTINCT run_id) AS runs, min(created_at)::DATE::VARCHAR AS first_day FROM completions WHERE response_model IS NOT NULL GROUP BY 1")
def models(spark, d):
    c = table(spark, d, "completions").filter("response_model IS NOT NULL")
    return c.groupBy(F.col("response_model").alias("model")).agg(F.countDistinct("call_id").alias("calls"), F.countDistinct("run_id").alias("runs"), F.to_date(F.min("created_at")).cast("string").alias("first_day"))


@query("cv_10m_captures", "SELECT event_type, count(*) AS n, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day FROM events GROUP BY 1")
def capture_listing(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.to_date(F.min("ts")).cast("string").alias("first_day"), F.to_date(F.max("ts")).cast("string").alias("last_day"))


@query("cv_12_deploy_check", "WITH a AS (SELECT p_brand AS k, max(p_size)::VARCHAR AS v FROM part GROUP BY 1), b AS (SELECT p_brand AS k, max(p_size)::VARCHAR AS v FROM part WHERE p_partkey % 5 <> 0 AND p_type <> 'x' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.v = b.v THEN 'matched' ELSE 'differing' END AS state FROM a FULL JOIN b ON a.k = b.k")
def deploy_check(spark, d):
    """Settings as promoted against settings as deployed."""
    p = table(spark, d, "part")
    a = p.groupBy(F.col("p_brand").alias("k")).agg(F.max("p_size").cast("string").alias("va"))
    b = p.filter("p_partkey % 5 <> 0 AND p_type <> 'x'").groupBy(F.col("p_brand").alias("k2")).agg(F.max("p_size").cast("string").alias("vb"))
    return a.join(b, F.col("k") == F.col("k2"), "full_outer").select(F.coalesce("k", "k2").alias("k"), F.when(F.col("k2").isNull(), "missing").when(F.col("va") == F.col("vb"), "matched").otherwise("differing").alias("state"))


@query("cv_13_runs", "SELECT run_id, any_value(dataset_id) AS dataset_id, count(DISTINCT item_id) AS n_items FROM predictions GROUP BY 1")
def list_runs(spark, d):
    return table(spark, d, "predictions").groupBy("run_id").agg(F.first("dataset_id").alias("dataset_id"), F.countDistinct("item_id").alias("n_items"))


@query("cv_14_age", "SELECT config_id, date_diff('day', max(created_at)::DATE, DATE '2026-12-31') AS age_days, CASE WHEN date_diff('day', max(created_at)::DATE, DATE '2026-12-31') > 180 THEN 'stale' ELSE 'current' END AS status FROM predictions GROUP BY 1")
def age(spark, d):
    a = F.date_diff(F.lit("2026-12-31").cast("date"), F.to_date(F.max("created_at")))
    return table(spark, d, "predictions").groupBy("config_id").agg(a.alias("age_days")).withColumn("status", F.when(F.col("age_days") > 180, "stale").otherwise("current"))


@query("cv_18_judging", f"WITH {_VOTES} SELECT set_id, count(*) AS n, count(DISTINCT judge) AS judges, count(DISTINCT item_id) AS items, round(avg(CASE WHEN vote = 'tie' THEN 1.0 ELSE 0 END), 9) AS ties FROM v GROUP BY 1")
def judging(spark, d):
    return _votes(spark, d).groupBy("set_id").agg(F.count("*").alias("n"), F.countDistinct("judge").alias("judges"), F.countDistinct("item_id").alias("items"), F.round(F.avg((F.col("vote") == "tie").cast("double")), 9).alias("ties"))


_AXES = "ax AS (SELECT config_id, metric, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM long WHERE metric IN ('overlap_f1', 'cost_usd', 'latency_ms') GROUP BY 1, 2)"


def _axes(spark, d):
    from ..operators.aggregates import exact_percentiles

    long = long_scores(facts(spark, d, "overlap_f1", "cost_usd", "latency_ms"), ["overlap_f1", "cost_usd", "latency_ms"])
    return exact_percentiles(long, ["config_id", "metric"], "value", {"p50": 0.5, "p95": 0.95})


@query("st_39_axes", q("SELECT config_id, metric, n, round(mean, 9) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95, CASE metric WHEN 'overlap_f1' THEN mean >= 0.6 WHEN 'latency_ms' THEN p95 <= 4000 END AS within FROM ax", _AXES))
def axes(spark, d):
    """Quality, cost and speed of every arm: mean, median, 95th percentile, and whether the axis is within its limit (none for cost)."""
    m = F.col("metric")
    within = F.when(m == "overlap_f1", F.col("mean") >= 0.6).when(m == "latency_ms", F.col("p95") <= 4000)
    return _axes(spark, d).select("config_id", "metric", "n", F.round("mean", 9).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), within.alias("within"))


@query("st_43_ratios", q("SELECT a.config_id, a.metric, round(a.mean / nullif(b.mean, 0), 6) AS ratio FROM ax a JOIN ax b USING (metric) WHERE b.config_id = 'arm_base'", _AXES))
def ratios(spark, d):
    """Every axis of every arm as a multiple of the baseline's."""
    x = _axes(spark, d)
    b = x.filter(F.col("config_id") == BASE).select("metric", F.col("mean").alias("base"))
    return x.join(b, "metric").select("config_id", "metric", F.round(F.try_divide("mean", F.when(F.col("base") != 0, F.col("base"))), 6).alias("ratio"))


@query("st_36_items")
def items_test(spark, d):
    """Two judges' mean grades tested over the runs that both graded."""
    g = grades(spark, d).filter(F.col("grade").between(1, 5) & F.col("judge").isin("rater_03", "rater_01"))
    s = g.groupBy(F.lit("grades").alias("dataset_id"), F.col("judge").alias("config_id"), F.concat_ws("|", "run_id", "item_id").alias("item_id")).agg(F.round(F.avg("grade"), 9).alias("value"))
    return pr.compare(s, "rater_01")


@query("ds_20_latest_scoring", "SELECT run_id, stratum, count(*) AS n_filings, arg_max(primary_score, (filed_at, primary_score)) AS current, count(DISTINCT primary_score) > 1 AS rescored FROM run_candidates WHERE stratum IS NOT NULL AND filed_at IS NOT NULL AND primary_score IS NOT NULL AND NOT isnan(primary_score) GROUP BY 1, 2")
def latest_scoring(spark, d):
    r = table(spark, d, "run_candidates").filter("stratum IS NOT NULL AND filed_at IS NOT NULL AND primary_score IS NOT NULL AND NOT isnan(primary_score)")
    return r.groupBy("run_id", "stratum").agg(F.count("*").alias("n_filings"), F.max(F.struct("filed_at", "primary_score")).getField("primary_score").alias("current"), (F.min("primary_score") != F.max("primary_score")).alias("rescored"))


@query("cv_10c_references", q("SELECT dataset_id, reference, count(*) AS n_arms FROM ref GROUP BY 1, 2", _REF))
def reference_view(spark, d):
    a = table(spark, d, "predictions").groupBy("dataset_id", "config_id").agg(F.when(F.max(_repeat()) % 2 == 0, "silver").otherwise("gold").alias("reference"))
    return a.groupBy("dataset_id", "reference").agg(F.count("*").alias("n_arms"))


@query("cv_10d_metric", q("SELECT dataset_id, count(*) AS n_arms, arg_min(config_id, (-mu, config_id)) AS best FROM (SELECT dataset_id, config_id, round(avg(value), 9) AS mu FROM series GROUP BY 1, 2) GROUP BY 1"))
def metric_view(spark, d):
    m = _series(spark, d).groupBy("dataset_id", "config_id").agg(F.round(F.avg("value"), 9).alias("mu"))
    return m.groupBy("dataset_id").agg(F.count("*").alias("n_arms"), F.min(F.struct((-F.col("mu")).alias("k"), "config_id")).getField("config_id").alias("best"))


@query("cv_10e_arm", q("SELECT dataset_id, metric, count(DISTINCT run_id) AS n_runs, round(avg(value), 9) AS mean FROM long WHERE config_id = 'opal_m' GROUP BY 1, 2"))
def arm_view(spark, d):
    x = long_scores(facts(spark, d, *MEASURES)).filter("config_id = 'opal_m'")
    return x.groupBy("dataset_id", "metric").agg(F.countDistinct("run_id").alias("n_runs"), F.round(F.avg("value"), 9).alias("mean"))


@query("cv_10h_item", q("SELECT s.config_id, s.value, round(s.value - b.value, 9) AS delta FROM series s LEFT JOIN (SELECT item_id, value FROM series WHERE config_id = 'arm_base') b USING (item_id) WHERE s.item_id = 'elver_qa_0007'"))
def item_view(spark, d):
    """One item as every arm has it, against the baseline."""
    s = series(facts(spark, d, "overlap_f1").filter("item_id = 'elver_qa_0007'"), "overlap_f1")
    b = s.filter(F.col("config_id") == BASE).select("item_id", F.col("value").alias("b"))
    return s.join(b, "item_id", "left").select("config_id", "value", F.round(F.col("value") - F.col("b"), 9).alias("delta"))


@query("cv_10l_labels", f"WITH {_LAB} SELECT judge, dim, count(*) AS n, count(DISTINCT item_id) AS items, round(avg(grade), 9) AS mean FROM g WHERE grade BETWEEN 1 AND 5 GROUP BY 1, 2")
def labels_view(spark, d):
    return grades(spark, d).filter(F.col("grade").between(1, 5)).groupBy("judge", "dim").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.round(F.avg("grade"), 9).alias("mean"))


@query("cv_10n_months", q("SELECT dataset_id, date_trunc('month', created_at)::DATE::VARCHAR AS month, count(DISTINCT run_id) AS runs, round(sum(cost_usd), 8) AS usd FROM f GROUP BY 1, 2"))
def months(spark, d):
    f = facts(spark, d, "cost_usd")
    return f.groupBy("dataset_id", F.trunc("created_at", "month").cast("string").alias("month")).agg(F.countDistinct("run_id").alias("runs"), F.round(F.sum("cost_usd"), 8).alias("usd"))


@query("ud_8_corpus_metrics", f"WITH p AS (SELECT split_part(source, '/', 1) AS grp, lower(lang) AS gold, CASE WHEN regexp_matches(lower(text), ' (der|die|das|und|den) ') THEN 'de' WHEN regexp_matches(lower(text), ' (le|les|des|une|dans) ') THEN 'fr' WHEN regexp_matches(lower(text), ' (el|los|una|por|del) ') THEN 'es' WHEN regexp_matches(lower(text), ' (the|and|of|for) ') THEN 'en' END AS pred FROM documents WHERE lang IS NOT NULL) SELECT grp, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 9) AS accuracy FROM p GROUP BY 1")
def corpus_metrics(spark, d):
    from ..sources.plugins import corpus_metrics as of
    from .rollups import RULES

    x = F.lower("text")
    c = None
    for k, v in RULES.items():
        c = F.when(x.rlike(v), k) if c is None else c.when(x.rlike(v), k)
    t = table(spark, d, "documents").filter("lang IS NOT NULL").select(F.element_at(F.split("source", "/"), 1).alias("kind"), F.lower("lang").alias("gold"), c.alias("pred"))
    return of(t, "kind", "gold", "pred", ["accuracy"]).withColumn("accuracy", F.round("accuracy", 9))


# --- checks


@query("vc_1_complete", "SELECT DISTINCT 'complete' AS \"check\", pred_id::VARCHAR AS subject, array_to_string(list_filter([CASE WHEN overlap_f1 IS NULL THEN 'overlap_f1' END, CASE WHEN tokens_out IS NULL THEN 'tokens_out' END], lambda x: x IS NOT NULL), ',') AS detail FROM predictions WHERE overlap_f1 IS NULL OR tokens_out IS NULL")
def complete(spark, d):
    return vc.present(table(spark, d, "predictions"), "pred_id", ["overlap_f1", "tokens_out"], "complete")


@query("vc_6_finalists", "SELECT 'judge exists' AS \"check\", cross_judge AS subject, count(*)::VARCHAR AS detail FROM finalists WHERE cross_judge IS NOT NULL AND cross_judge NOT IN (SELECT judge FROM item_scores WHERE judge LIKE 'judge%') GROUP BY 2")
def finalists(spark, d):
    known = table(spark, d, "item_scores").filter("judge LIKE 'judge%'").select("judge")
    return vc.resolves(table(spark, d, "finalists"), "cross_judge", known, "judge", "judge exists")


@query("vc_7_readable", "SELECT 'has rows' AS \"check\", run_id AS subject, count(*)::VARCHAR AS detail FROM results WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM predictions) GROUP BY 2")
def readable(spark, d):
    return vc.resolves(table(spark, d, "results"), "run_id", table(spark, d, "predictions"), "run_id", "has rows")


@query("vc_16_references", "SELECT DISTINCT 'drift' AS \"check\", item_id AS subject, sha256(text) AS detail FROM test_items WHERE contains(text, 'boat')")
def references(spark, d):
    t = table(spark, d, "test_items")
    return vc.holds(t, "item_id", F.sha2(F.regexp_replace("text", "boat", "ship"), 256) == F.sha2("text", 256), F.sha2("text", 256), "drift")


@query("vc_17_captures", "SELECT 'readable' AS \"check\", event_id::VARCHAR AS subject, event_type AS detail FROM events WHERE NOT coalesce(json_extract(props, '$.k')::BIGINT >= 5, false)")
def capture_bodies(spark, d):
    return vc.holds(table(spark, d, "events"), "event_id", F.get_json_object("props", "$.k").try_cast("bigint") >= 5, F.col("event_type"), "readable")


@query("vc_20_languages", "SELECT DISTINCT 'language' AS \"check\", doc_id::VARCHAR AS subject, lang AS detail FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'de', 'fr', 'es')")
def languages(spark, d):
    return vc.one_of(table(spark, d, "documents"), "doc_id", "lang", ["en", "de", "fr", "es"], "language")
