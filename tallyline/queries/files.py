"""Readers, sinks, data sources and plug-ins over files that the queries write below the checkpoint folder, and hooks for stored replies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsers as ps
from ..functions import text as tx
from ..operators import checks as vc
from ..operators import paired as pr
from ..operators.joins import paired
from ..plans.catalog import Catalog
from ..plans.frames import facts, series, sql, table
from ..sources import plugins, readers, sinks
from ..storage import ensure_checkpoint_dir
from ..streaming import captures as cap
from . import query
from .scoring import _DENSE, _dense, _OUT, _outputs
from .statistics import BASE

q = sql


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _documents(df, key: str, folder: str) -> str:
    """One JSON document a file: a partition folder for each value of ``key``, of which there are few."""
    body = F.to_json(F.struct(*(c for c in df.columns))).alias("value")
    df.repartition(key).select(body, F.col(key).alias("part")).write.partitionBy("part").text(folder)
    return folder


@query("sc_2_prediction_lines", q("SELECT item_id, count(*) AS n, count(overlap_f1) AS n_scored, round(sum(overlap_f1), 6) AS total, sum(resumed)::BIGINT AS n_resumed FROM f GROUP BY 1"))
def prediction_lines(spark, d):
    """The facts written as prediction lines and read back strictly."""
    folder = _folder(spark)
    facts(spark, d, "overlap_f1", "resumed").select("item_id", "overlap_f1", F.col("resumed").cast("int").alias("resumed")).write.json(folder)
    p = readers.predictions(spark, folder, ["overlap_f1"])
    return p.groupBy("item_id").agg(F.count("*").alias("n"), F.count("overlap_f1").alias("n_scored"), F.round(F.sum("overlap_f1"), 6).alias("total"), F.sum("resumed").cast("bigint").alias("n_resumed"))


@query("sc_3_metrics", q("SELECT dataset_id, count(DISTINCT run_id) AS n_items, round(avg(overlap_f1), 9) AS overlap_f1 FROM f GROUP BY 1"))
def metrics(spark, d):
    """A record for each dataset, one document a file, scanned as run records."""
    f = facts(spark, d, "overlap_f1").groupBy("dataset_id").agg(F.countDistinct("run_id").alias("n_items"), F.round(F.avg("overlap_f1"), 9).alias("mean"))
    rec = f.select("dataset_id", F.col("dataset_id").alias("run_id"), F.lit("all").alias("config_id"), "n_items", F.create_map(F.lit("overlap_f1"), "mean").alias("scores"))
    r = readers.runs(spark, _documents(rec, "dataset_id", _folder(spark)), config_id="all")
    return r.select("dataset_id", "n_items", r["scores"]["overlap_f1"].alias("overlap_f1"))


@query("sc_8_texts", "SELECT item_id, sha256(text) AS sha FROM test_items")
def texts(spark, d):
    """Reference texts, a file each, read as a folder."""
    folder = _folder(spark)
    sinks.write_texts(table(spark, d, "test_items"), "item_id", "text", folder)
    return readers.texts(spark, folder).select("item_id", F.sha2("text", 256).alias("sha"))


@query("sc_16_corpus", "SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS n_tokens FROM test_items")
def corpus(spark, d):
    folder = _folder(spark)
    sinks.write_texts(table(spark, d, "test_items"), "item_id", "text", folder)
    return readers.texts(spark, folder).select("item_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"))


@query("sc_9_label_sets", "SELECT dataset_id, 'owner' AS set_name, item_id, sha256(text) AS item_sha256, CASE WHEN length(text) % 2 = 0 THEN 'maybe, yes' ELSE 'no' END AS answers FROM test_items")
def label_sets(spark, d):
    t = table(spark, d, "test_items")
    label = F.when(F.length("text") % 2 == 0, F.lit('{"accept": ["yes", "maybe", "yes"]}')).otherwise("no")
    sets = t.groupBy("dataset_id").agg(F.collect_list(F.struct("item_id", F.sha2("text", 256).alias("sha256"), label.alias("label"))).alias("labels")).withColumn("set", F.lit("owner"))
    return readers.label_sets(spark, _documents(sets, "dataset_id", _folder(spark))).select("dataset_id", "set_name", "item_id", "item_sha256", F.array_join("answers", ", ").alias("answers"))


@query("sc_10_captures", "SELECT CASE WHEN event_id % 50 = 0 THEN 'changed' ELSE 'ok' END AS state, count(*) AS n, count(ts) AS n_dated FROM events GROUP BY 1")
def captures(spark, d):
    """Events as captures, every fiftieth with another hash than its body's."""
    folder = _folder(spark)
    h = F.sha2(F.when(F.col("event_id") % 50 == 0, F.concat("props", F.lit("!"))).otherwise(F.col("props")), 256)
    table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("body"), F.col("ts").cast("string").alias("created_at"), h.alias("sha256")).write.json(folder)
    return readers.captures(spark, folder).groupBy("state").agg(F.count("*").alias("n"), F.count("created_at").alias("n_dated"))


@query("sc_12_records", "SELECT substr(ts::VARCHAR, 1, 10) AS day, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1")
def records(spark, d):
    """JSON lines through the ``records`` data source (UD-6)."""
    folder = _folder(spark)
    table(spark, d, "events").select("event_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("created_at")).write.json(folder)
    spark.dataSource.register(plugins.JsonRecords)
    r = spark.read.format("records").option("path", folder.removeprefix("file:")).option("id", "event_id").load()
    return r.groupBy(F.col("created_at").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("sk_1_run_table", q("SELECT dataset_id, count(*) AS n, CASE WHEN dataset_id = 'elver_qa' THEN 2 ELSE 1 END AS written FROM f GROUP BY 1"))
def run_table(spark, d):
    """The fact table written by dataset; one dataset is written again and replaces its files alone."""
    folder, f = _folder(spark), facts(spark, d, "overlap_f1").withColumn("written", F.lit(1))
    sinks.write_runs(f, folder)
    sinks.write_runs(f.filter("dataset_id = 'elver_qa'").withColumn("written", F.lit(2)), folder)
    return spark.read.parquet(folder).groupBy("dataset_id").agg(F.count("*").alias("n"), F.max("written").alias("written"))


@query("sk_3_sheet", "SELECT doc_id, title, '' AS note FROM (SELECT doc_id, coalesce(title, '') AS title FROM documents)")
def sheet_file(spark, d):
    folder = _folder(spark)
    sinks.write_sheet(table(spark, d, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title")), folder, ("note",))
    x = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(folder)
    return x.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("note", F.lit("")).alias("note"))


@query("sk_4_report", "SELECT contested, count(*) AS n, sum(n_items)::BIGINT AS n_items FROM finalists GROUP BY 1")
def report(spark, d):
    folder, f = _folder(spark), table(spark, d, "finalists").select("run_id", "contested", "n_items")
    sinks.write_report(f, f.filter("contested"), folder)
    return spark.read.schema(f.schema).json(f"{folder}/finalists").groupBy("contested").agg(F.count("*").alias("n"), F.sum("n_items").cast("bigint").alias("n_items"))


_ORACLE = f"""{_DENSE}, r AS (SELECT query_id, sum(CASE WHEN c.label = q.label THEN 1 ELSE 0 END)::BIGINT AS hits FROM top JOIN embeddings c ON c.vec_id = doc_id JOIN q USING (query_id) GROUP BY 1),
n AS (SELECT q.query_id, count(*) AS n FROM q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.query_id GROUP BY 1)"""


@query("sf_13_oracle", f"WITH {_ORACLE} SELECT query_id, hits::INT AS hits, round(coalesce(list_sum(list_transform(generate_series(1, hits), lambda i: 1 / log2(i + 1))), 0) / list_sum(list_transform(generate_series(1, least(10, n)), lambda i: 1 / log2(i + 1))), 6) AS ceiling FROM r JOIN n USING (query_id)")
def oracle(spark, d):
    """The nDCG that the best order of the ten nearest would have; relevant documents that were not retrieved stand as places in the ideal order."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    r = _dense(spark, d).join(e.withColumnsRenamed({"vec_id": "doc_id", "label": "got"}), "doc_id").join(e.withColumnRenamed("vec_id", "query_id"), "query_id")
    own = r.groupBy("query_id", "label").agg(F.collect_list(F.col("doc_id").cast("string")).alias("docs"), F.collect_list(F.when(F.col("got") == F.col("label"), F.col("doc_id").cast("string"))).alias("found"))
    n = e.groupBy("label").agg((F.count("*") - 1).alias("n"))
    x = own.join(n, "label").filter("n > 0")
    missing = F.greatest(F.least(F.lit(10), F.col("n")) - F.size("found"), F.lit(0)).cast("int")
    ids = F.concat("found", F.transform(F.slice(F.sequence(F.lit(1), F.lit(10)), F.lit(1), missing), lambda i: F.concat(F.lit("other "), i.cast("string"))))
    grades = F.map_from_arrays(ids, F.transform(ids, lambda _: F.lit(1)))
    return x.select("query_id", F.size("found").alias("hits"), F.round(tx.oracle_ndcg(F.col("docs"), grades), 6).alias("ceiling"))


@query("sf_14_rankings", "SELECT verdict_id, any_value(array_to_string(arm_ids, ' ')) AS ranking FROM verdicts WHERE arm_ids IS NOT NULL GROUP BY 1")
def rankings(spark, d):
    """Rankings as models write them: bare, fenced, or behind a short lead."""
    v = table(spark, d, "verdicts").filter("arm_ids IS NOT NULL").groupBy("verdict_id").agg(F.min("arm_ids").alias("arms"))
    body = F.to_json("arms")
    reply = F.when(F.col("verdict_id") % 3 == 0, body).when(F.col("verdict_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Best first: "), body))
    return v.select("verdict_id", F.array_join(ps.ranking(reply), " ").alias("ranking"))


@query("sf_31_answers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_sort(list_distinct([lang, source])), '|') ELSE lang END AS answers FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def answers(spark, d):
    x = table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    label = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.array("lang", "source").alias("accept")))).otherwise(F.col("lang"))
    return x.select("doc_id", F.array_join(readers.answers(label), "|").alias("answers"))


_W = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


@query("ud_1_scorer", f"WITH {_OUT}, w AS (SELECT call_id, {_W.format('output')} AS x, list_distinct({_W.format('output')}) AS a, list_distinct({_W.format('reference')}) AS b FROM o) SELECT call_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS overlap_f1, len(x)::INT AS output_words FROM w")
def scorer(spark, d):
    s = plugins.score(_outputs(spark, d), "overlap")
    return s.select("call_id", F.round("overlap_f1", 9).alias("overlap_f1"), "output_words")


@query("ud_2_system", "SELECT item_id, array_to_string(list_slice(string_split(text, '. '), 1, 2), '. ') AS output FROM test_items")
def system(spark, d):
    return plugins.call_system(table(spark, d, "test_items"), plugins.echo(2))


@query("ud_3_declarations", "SELECT 'overlap' AS scorer, 'overlap_f1' AS primary_metric, unnest(['overlap_f1', 'output_words']) AS metric, unnest(['quality', 'descriptive']) AS kind, unnest(['higher', 'none']) AS direction")
def declarations(spark, d):
    """What every registered scorer declares of its metrics."""
    return plugins.declared(spark).filter("scorer = 'overlap'")


@query("ud_9_judge", "SELECT item_id, " + ", ".join(f"(('0x' || substr(sha256('ash|' || item_id || '|{x}'), 1, 8))::BIGINT % 5 + 1)::INT AS {x}" for x in ("faithfulness", "fluency")) + " FROM test_items")
def judge(spark, d):
    g = table(spark, d, "test_items").select("item_id", plugins.fake_judge("ash", F.col("item_id"), ["faithfulness", "fluency"]).alias("g"))
    return g.select("item_id", g["g"]["faithfulness"].alias("faithfulness"), g["g"]["fluency"].alias("fluency"))


_OBJ = "r AS (SELECT DISTINCT call_id, item_id, judge, output, regexp_extract(output, '\\{[^{}]*\\}') AS o FROM judge_results), b AS (SELECT call_id, item_id, judge, output, CASE WHEN json_valid(o) AND json_type(o, '$.better') IN ('UBIGINT', 'BIGINT') AND json_extract_string(o, '$.better') IN ('1', '2') THEN json_extract_string(o, '$.better') WHEN json_valid(o) AND json_type(o, '$.better') = 'VARCHAR' AND lower(trim(json_extract_string(o, '$.better'))) = 'tie' THEN 'tie' END AS v FROM r)"


@query("ud_4_reparsed", f"WITH {_OBJ} SELECT coalesce(v, '<unparsed>') AS label, count(*) AS n, 'pairwise-1' AS scorer FROM b GROUP BY 1")
def reparsed(spark, d):
    """Stored replies parsed anew by the task's own parser, with the name of the scorer that did it."""
    x = table(spark, d, "judge_results").select("call_id", "item_id", "judge", "output").distinct()
    return plugins.reparse(x, "pairwise").groupBy("label", "scorer").agg(F.count("*").alias("n"))


@query("ud_5_decisions", f"WITH {_OBJ} SELECT item_id, count(*) AS n, count(DISTINCT trim(coalesce(v, output, ''))) AS n_decisions FROM b GROUP BY 1")
def decisions(spark, d):
    """For each item, how many decisions its replies come to: replies of one decision are the same, unread ones by their text."""
    x = table(spark, d, "judge_results").select("call_id", "item_id", "judge", "output").distinct()
    return plugins.decided(x, "pairwise").groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("decision").alias("n_decisions"))


@query("ud_7_catalog", q("SELECT config_id AS arm, count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT run_id) AS n_runs, round(avg(overlap_f1), 9) AS recorded FROM f GROUP BY 1"))
def catalog(spark, d):
    """Every arm as the catalog describes it."""
    c = Catalog(facts(spark, d, "overlap_f1", "latency_ms"), ("overlap_f1", "latency_ms"), lower=("latency_ms",))
    return c.describe().join(c.recorded_means("overlap_f1"), "arm").select("arm", "n_datasets", "n_runs", F.round("mean", 9).alias("recorded"))


@query("sk_6_p_table", q("SELECT p.dataset_id, count(*) AS n, true AS kept FROM (SELECT DISTINCT dataset_id, config_id FROM series s WHERE config_id <> 'arm_base' AND EXISTS (SELECT 1 FROM series b WHERE b.dataset_id = s.dataset_id AND b.item_id = s.item_id AND b.config_id = 'arm_base')) p GROUP BY 1"))
def p_table(spark, d):
    """The p-values of all pairs, asked for twice: the second time all come from the table that the first one left."""
    pairs, folder, keys = paired(series(facts(spark, d, "overlap_f1"), "overlap_f1"), BASE), _folder(spark), ["dataset_id", "config_id"]
    first = pr.stored_tests(pairs, keys, folder)
    again = pr.stored_tests(pairs, keys, folder)
    x = again.join(first.select(*keys, F.col("p").alias("p0")), keys)
    return x.groupBy("dataset_id").agg(F.count("*").alias("n"), F.every(F.col("stored") & F.col("p").eqNullSafe(F.col("p0"))).alias("kept"))


@query("vc_10_scorers", "SELECT run_id FROM (SELECT DISTINCT run_id, primary_judge FROM finalists WHERE primary_judge IS NOT NULL) WHERE length(run_id) % 7 = 0")
def stale_scorers(spark, d):
    """Derived runs whose scorer's hash is not the current one: here every run whose name has a length divisible by seven carries an older one."""
    f = table(spark, d, "finalists").filter("primary_judge IS NOT NULL").select("run_id", F.col("primary_judge").alias("scorer")).distinct()
    current = f.select("scorer", F.sha2("scorer", 256).alias("scorer_hash")).distinct()
    derived = f.select("run_id", "scorer", F.sha2(F.concat("scorer", F.when(F.length("run_id") % 7 == 0, "-old").otherwise("")), 256).alias("scorer_hash"))
    return vc.stale_scorers(derived, current).select("run_id").distinct()


@query("ss_5_resumed", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def resumed(spark, d):
    """A stream run twice over the same events: the second run starts where the first ended and adds nothing."""
    folder = _folder(spark)
    src = f"{folder}/source"
    table(spark, d, "events").write.parquet(src)
    stream = cap.deduplicated(cap.events(spark, src), "event_id", "3650 days").select("event_id", "event_type")
    cap.run_once(stream, f"{folder}/out")
    return cap.run_once(stream, f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"))
