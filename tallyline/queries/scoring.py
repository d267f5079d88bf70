"""Agreement, judging and scorers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parsers as ps
from ..functions import rouge as rg
from ..functions import text as tx
from ..operators import agreement as agr
from ..operators.aggregates import correlation
from ..operators.retrieval import bm25 as search
from ..operators.retrieval import nearest
from ..plans.frames import table
from . import query
from .rollups import _LAB, grades

_VOTES = "v AS (SELECT set_id, item_id, judge, pass_name, block_no, arm_ids[1] AS a, arm_ids[2] AS b, lower(trim(better)) AS vote FROM verdicts WHERE lower(trim(better)) IN ('1', '2', 'tie') QUALIFY row_number() OVER (PARTITION BY verdict_id ORDER BY created_at, better) = 1)"


def _votes(spark, d):
    v = table(spark, d, "verdicts").withColumn("vote", F.lower(F.trim("better"))).filter(F.col("vote").isin("1", "2", "tie"))
    x = v.groupBy("verdict_id").agg(F.min(F.struct("created_at", "better", "set_id", "item_id", "judge", "pass_name", "block_no", "arm_ids", "vote")).alias("x")).select("x.*")
    return x.select("set_id", "item_id", "judge", "pass_name", "block_no", F.get("arm_ids", F.lit(0)).alias("a"), F.get("arm_ids", F.lit(1)).alias("b"), "vote")


# Two judges' grades of the same outputs.
_TWO = "t AS (SELECT x.run_id, x.item_id, x.dim, x.judge AS ja, y.judge AS jb, x.grade AS a, y.grade AS b FROM g x JOIN g y USING (run_id, item_id, dim) WHERE x.judge < y.judge AND x.grade BETWEEN 1 AND 5 AND y.grade BETWEEN 1 AND 5)"


def _two(spark, d):
    """Pairs of judges that graded the same output; a unit has a handful of judges (JN-6)."""
    g = grades(spark, d).filter(F.col("grade").between(1, 5))
    x = g.select("run_id", "item_id", "dim", F.col("judge").alias("ja"), F.col("grade").alias("a"))
    y = g.select("run_id", "item_id", "dim", F.col("judge").alias("jb"), F.col("grade").alias("b"))
    return x.join(y, ["run_id", "item_id", "dim"]).filter(F.col("ja") < F.col("jb"))


@query("jn_6_label_pairs", f"WITH {_LAB}, {_TWO} SELECT ja, jb, count(*) AS n, count(*) FILTER (a = b) AS same FROM t GROUP BY 1, 2")
def label_pairs(spark, d):
    return _two(spark, d).groupBy("ja", "jb").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


_KAPPA = "m AS (SELECT ja, jb, a, b, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT ja, jb, sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same FROM m GROUP BY 1, 2), pa AS (SELECT ja, jb, a AS v, sum(c) AS na FROM m GROUP BY 1, 2, 3), pb AS (SELECT ja, jb, b AS v, sum(c) AS nb FROM m GROUP BY 1, 2, 3), e AS (SELECT ja, jb, sum(na * nb) AS e FROM pa JOIN pb USING (ja, jb, v) GROUP BY 1, 2)"


@query("st_28_kappa", f"WITH {_LAB}, {_TWO}, {_KAPPA} SELECT ja, jb, n::BIGINT AS n, same::BIGINT AS same, round((same / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)), 4) AS kappa FROM n LEFT JOIN e USING (ja, jb)")
def kappa(spark, d):
    return agr.kappa(_two(spark, d), ["ja", "jb"])


@query("st_29_alpha", f"""WITH {_LAB}, {_TWO}, o AS (SELECT ja, jb, avg(CASE WHEN a <> b THEN 1.0 ELSE 0 END) AS observed FROM t GROUP BY 1, 2), v AS (SELECT ja, jb, v, count(*) AS c FROM (SELECT ja, jb, unnest([a, b]) AS v FROM t) GROUP BY 1, 2, 3),
s AS (SELECT ja, jb, sum(c) AS m, sum(c * c) AS q FROM v GROUP BY 1, 2) SELECT ja, jb, CASE WHEN m * m > q THEN round(1 - observed / ((m * m - q) / (m * (m - 1))), 4) END AS alpha FROM o JOIN s USING (ja, jb)""")
def alpha(spark, d):
    return agr.alpha(_two(spark, d), ["ja", "jb"])


@query("st_30_categories", f"WITH {_LAB} SELECT count(*) AS n_labels, count(*) <= 50 AS categories FROM (SELECT DISTINCT grade FROM g WHERE grade IS NOT NULL)")
def categories(spark, d):
    return agr.are_categories(grades(spark, d).select(F.col("grade").cast("string").alias("v")), "v")


@query("st_25_kendall", f"""WITH {_LAB}, x AS (SELECT x.run_id, x.item_id, x.judge AS ja, y.judge AS jb, x.dim, x.grade AS a, y.grade AS b FROM g x JOIN g y USING (run_id, item_id, dim) WHERE x.judge = 'judge_ash' AND y.judge = 'judge_elm'),
p AS (SELECT l.run_id, l.item_id, sum(sign(l.a - r.a) * sign(l.b - r.b)) AS c, sum(abs(sign(l.a - r.a))) AS u, sum(abs(sign(l.b - r.b))) AS w FROM x l JOIN x r ON l.run_id = r.run_id AND l.item_id = r.item_id AND l.dim < r.dim GROUP BY 1, 2)
SELECT run_id, item_id, round(CASE WHEN u = 0 OR w = 0 THEN 0 ELSE c / sqrt(u * w) END, 6) AS tau FROM p""")
def kendall(spark, d):
    """Tau-b of two judges' grades over the dimensions of an output (two at least)."""
    g = grades(spark, d)
    x = g.filter("judge = 'judge_ash'").select("run_id", "item_id", "dim", F.col("grade").alias("a")).join(g.filter("judge = 'judge_elm'").select("run_id", "item_id", "dim", F.col("grade").alias("b")), ["run_id", "item_id", "dim"])
    y = x.groupBy("run_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("dim", "a", "b"))).alias("xs")).filter(F.size("xs") >= 2)
    return y.select("run_id", "item_id", F.round(agr.kendall_tau_b(F.col("xs.a"), F.col("xs.b")), 6).alias("tau"))


@query("st_31_bradley_terry")
def bradley_terry(spark, d):
    v = _votes(spark, d)
    first = F.when(F.col("vote") == "1", 1.0).when(F.col("vote") == "tie", 0.5).otherwise(0.0)
    return agr.bradley_terry(v.select("set_id", "item_id", "a", "b", first.alias("wa"), (1 - first).alias("wb")), "set_id")


@query("st_31_win_matrix", f"WITH {_VOTES} SELECT set_id, arm, opponent, round(sum(w)::DOUBLE, 6) AS wins FROM (SELECT set_id, a AS arm, b AS opponent, CASE vote WHEN '1' THEN 1 WHEN 'tie' THEN 0.5 ELSE 0 END AS w FROM v UNION ALL SELECT set_id, b, a, CASE vote WHEN '2' THEN 1 WHEN 'tie' THEN 0.5 ELSE 0 END FROM v) GROUP BY 1, 2, 3")
def win_matrix(spark, d):
    v = _votes(spark, d)
    w = lambda x: F.when(F.col("vote") == x, 1.0).when(F.col("vote") == "tie", 0.5).otherwise(0.0)
    both = F.explode(F.array(F.struct(F.col("a").alias("arm"), F.col("b").alias("opponent"), w("1").alias("w")), F.struct(F.col("b").alias("arm"), F.col("a").alias("opponent"), w("2").alias("w")))).alias("e")
    return v.select("set_id", both).select("set_id", "e.*").groupBy("set_id", "arm", "opponent").agg(F.round(F.sum("w"), 6).alias("wins"))


_PASS = "p AS (SELECT set_id, judge, item_id, block_no, least(a, b) AS x, greatest(a, b) AS y, pass_name, max(CASE WHEN vote = 'tie' THEN 'tie' WHEN (vote = '1') = (a < b) THEN 'x' ELSE 'y' END) AS won FROM v GROUP BY ALL)"


@query("st_32_kept_verdicts", f"WITH {_VOTES}, {_PASS} SELECT judge, count(*) AS n, round(avg(CASE WHEN l.won = r.won THEN 1.0 ELSE 0 END), 9) AS kept FROM p l JOIN p r USING (set_id, judge, item_id, block_no, x, y) WHERE l.pass_name = 'primary' AND r.pass_name = 'position' GROUP BY 1")
def kept_verdicts(spark, d):
    """Share of verdicts that stay when the places are swapped."""
    v = _votes(spark, d)
    won = F.when(F.col("vote") == "tie", "tie").when((F.col("vote") == "1") == (F.col("a") < F.col("b")), "x").otherwise("y")
    p = v.groupBy("set_id", "judge", "item_id", "block_no", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "pass_name").agg(F.max(won).alias("won"))
    keys = ["set_id", "judge", "item_id", "block_no", "x", "y"]
    j = p.filter("pass_name = 'primary'").select(*keys, F.col("won").alias("l")).join(p.filter("pass_name = 'position'").select(*keys, F.col("won").alias("r")), keys)
    return j.groupBy("judge").agg(F.count("*").alias("n"), F.round(F.avg((F.col("l") == F.col("r")).cast("double")), 9).alias("kept"))


@query("st_33_judge_agreement", f"""WITH {_LAB}, {_TWO}, m AS (SELECT ja, jb, run_id, avg(a) AS a, avg(b) AS b FROM t GROUP BY 1, 2, 3) SELECT ja, jb, count(*) AS n_runs, round(avg(abs(a - b)), 6) AS mean_diff, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS r FROM m GROUP BY 1, 2 HAVING count(*) >= 3""")
def judge_agreement(spark, d):
    m = _two(spark, d).groupBy("ja", "jb", "run_id").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return m.groupBy("ja", "jb").agg(F.count("*").alias("n_runs"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_diff"), F.round(correlation("a", "b"), 6).alias("r")).filter("n_runs >= 3")


@query("st_34_majority", f"WITH {_LAB}, c AS (SELECT run_id, item_id, dim, grade, count(*) AS n FROM g WHERE grade BETWEEN 1 AND 5 GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY run_id, item_id, dim) AS top, FROM c) SELECT run_id, item_id, dim, any_value(grade) AS grade, any_value(n) AS n FROM m WHERE n = top AND n >= 2 GROUP BY 1, 2, 3 HAVING count(*) = 1")
def majority(spark, d):
    """The grade that most judges give, if one alone has two votes or more."""
    c = grades(spark, d).filter(F.col("grade").between(1, 5)).groupBy("run_id", "item_id", "dim", "grade").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run_id", "item_id", "dim")
    top = c.withColumn("top", F.max("n").over(w)).filter((F.col("n") == F.col("top")) & (F.col("n") >= 2))
    return top.groupBy("run_id", "item_id", "dim").agg(F.count("*").alias("k"), F.max("grade").alias("grade"), F.max("n").alias("n")).filter("k = 1").drop("k")


@query("st_35_leave_one_out", f"""WITH {_LAB}, x AS (SELECT judge, run_id, item_id, dim, grade, (sum(grade) OVER w - grade) / (count(*) OVER w - 1) AS rest, count(*) OVER w AS k FROM g WHERE grade BETWEEN 1 AND 5 WINDOW w AS (PARTITION BY run_id, item_id, dim))
SELECT judge, count(*) AS n, round(CASE WHEN stddev_pop(grade) > 0 AND stddev_pop(rest) > 0 THEN corr(grade, rest) END, 6) AS r, round(avg(abs(grade - rest)), 6) AS mean_error FROM x WHERE k >= 3 GROUP BY 1""")
def leave_one_out(spark, d):
    """Each judge against the mean of the others."""
    w = Window.partitionBy("run_id", "item_id", "dim")
    x = grades(spark, d).filter(F.col("grade").between(1, 5)).withColumn("k", F.count("*").over(w)).withColumn("rest", (F.sum("grade").over(w) - F.col("grade")) / (F.col("k") - 1)).filter("k >= 3")
    return x.groupBy("judge").agg(F.count("*").alias("n"), F.round(correlation("grade", "rest"), 6).alias("r"), F.round(F.avg(F.abs(F.col("grade") - F.col("rest"))), 6).alias("mean_error"))


@query("sf_27_won_from", f"WITH {_VOTES} SELECT set_id, item_id, arm, round(avg(w), 9) AS won FROM (SELECT set_id, item_id, a AS arm, CASE vote WHEN '1' THEN 1 WHEN 'tie' THEN 0.5 ELSE 0 END AS w FROM v UNION ALL SELECT set_id, item_id, b, CASE vote WHEN '2' THEN 1 WHEN 'tie' THEN 0.5 ELSE 0 END FROM v) GROUP BY 1, 2, 3")
def won_from(spark, d):
    """Share of its comparisons that an arm won on an item."""
    v = _votes(spark, d)
    w = lambda x: F.when(F.col("vote") == x, 1.0).when(F.col("vote") == "tie", 0.5).otherwise(0.0)
    both = F.explode(F.array(F.struct(F.col("a").alias("arm"), w("1").alias("w")), F.struct(F.col("b").alias("arm"), w("2").alias("w")))).alias("e")
    return v.select("set_id", "item_id", both).groupBy("set_id", "item_id", F.col("e.arm").alias("arm")).agg(F.round(F.avg("e.w"), 9).alias("won"))


# --- scorers: outputs against the texts of test items of the same dataset

_OUT = "o AS (SELECT DISTINCT r.call_id, r.output, t.text AS reference FROM results r JOIN (SELECT regexp_extract(item_id, '(\\d+)$', 1)::INT AS n, min(text) AS text FROM test_items GROUP BY 1) t ON regexp_extract(r.item_id, '(\\d+)$', 1)::INT % 30 = t.n WHERE r.output IS NOT NULL)"


def _outputs(spark, d):
    t = table(spark, d, "test_items").groupBy(F.regexp_extract("item_id", r"(\d+)$", 1).cast("int").alias("n")).agg(F.min("text").alias("reference"))
    r = table(spark, d, "results").filter("output IS NOT NULL").select("call_id", "output", (F.regexp_extract("item_id", r"(\d+)$", 1).cast("int") % 30).alias("n")).distinct()
    return r.join(t, "n").select("call_id", "output", "reference")


def _w(x):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"


@query("sf_1_overlap_f1", f"WITH {_OUT}, w AS (SELECT call_id, {_w('output')} AS a, {_w('reference')} AS b FROM o) SELECT call_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS f1, len(a)::INT AS n FROM w")
def overlap(spark, d):
    o = _outputs(spark, d)
    return o.select("call_id", F.round(tx.overlap_f1(F.col("output"), F.col("reference")), 9).alias("f1"), F.size(F.array_distinct(tx.words(F.col("output")))).alias("n"))


@query("sf_2_output_words", "SELECT call_id, max(len(list_filter(regexp_split_to_array(lower(output), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')))::INT AS n_words FROM results WHERE output IS NOT NULL GROUP BY 1")
def output_words(spark, d):
    return table(spark, d, "results").filter("output IS NOT NULL").groupBy("call_id").agg(F.max(tx.output_words(F.col("output"))).alias("n_words"))


_ALIASES = {"trade": "trade", "sport": "sport", "weather": "weather", "science": "science", "commerce": "trade", "handel": "trade", "comercio": "trade", "deporte": "sport", "wetter": "weather", "tiempo": "weather", "forschung": "science", "ciencia": "science"}
_CASES = " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in _ALIASES.items())


@query("sf_3_labels", f"WITH s AS (SELECT DISTINCT call_id, regexp_replace(lower(trim(output)), '^[\\s\"''`*.\\[(]+|[\\s\"''`*.!\\])]+$', '', 'g') AS bare FROM results WHERE length(output) < 20) SELECT call_id, CASE bare {_CASES} END AS label FROM s")
def labels(spark, d):
    r = table(spark, d, "results").filter(F.length("output") < 20).select("call_id", "output").distinct()
    return r.select("call_id", tx.parse_label(F.col("output"), _ALIASES).alias("label"))


@query("sf_6_normalised", "SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(title)), 'ß', 'ss'), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^(?:the|a|an) (\\S)', '\\1') AS title FROM documents")
def normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", ps.normalized("title").alias("title"))


@query("sf_15_tokens", "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::INT AS n FROM documents")
def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))


_BI = "b AS (SELECT call_id, list_distinct(list_transform(generate_series(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1])) AS a, list_distinct(list_transform(generate_series(1, len(y) - 1), lambda i: y[i] || ' ' || y[i + 1])) AS c FROM (SELECT call_id, regexp_extract_all(lower(output), '[a-z0-9]+') AS x, regexp_extract_all(lower(reference), '[a-z0-9]+') AS y FROM o))"


@query("sf_19_grounding", f"WITH {_OUT}, {_BI} SELECT call_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, c)) / len(a) END, 9) AS grounding FROM b")
def grounding(spark, d):
    return _outputs(spark, d).select("call_id", F.round(tx.grounding(F.col("output"), F.col("reference")), 9).alias("grounding"))


@query("sf_20_format", """SELECT DISTINCT call_id, regexp_matches(output, '(?m)^\\s*([-*]|\\d+[.)]) ') AS bullets, regexp_matches(output, '(?m)^#{1,6} |\\*\\*[^*]+\\*\\*') AS markdown, contains(trim(output, ' '), chr(10) || chr(10)) AS paragraphs FROM results WHERE output IS NOT NULL""")
def formats(spark, d):
    f = tx.format_flags(F.col("output"))
    return table(spark, d, "results").filter("output IS NOT NULL").select("call_id", f["bullets"].alias("bullets"), f["markdown"].alias("markdown"), f["paragraphs"].alias("paragraphs")).distinct()


@query("sf_21_first_words", "SELECT doc_id, regexp_extract(text, '^(?:\\s*\\S+){0,12}') AS head FROM documents WHERE text IS NOT NULL")
def first_words(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.clip_words(F.col("text"), 12).alias("head"))


@query("sf_22_rouge")
def rouge(spark, d):
    """Stemmed ROUGE-1 and ROUGE-Lsum with coverage, concision, length ratio and compression against the prompt."""
    p = table(spark, d, "results").filter("output IS NOT NULL").groupBy("call_id").agg(F.min("prompt").alias("prompt"))
    o = _outputs(spark, d).join(p, "call_id")
    return o.select("call_id", rg.summary_facets("output", "reference", "prompt").alias("f")).select("call_id", "f.*")


_R1 = "x AS (SELECT call_id, unnest(regexp_extract_all(lower(output), '[a-z0-9]+')) AS w FROM o), y AS (SELECT call_id, unnest(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS w FROM o), m AS (SELECT call_id, sum(least(a.n, b.n)) AS hit FROM (SELECT call_id, w, count(*) AS n FROM x GROUP BY 1, 2) a JOIN (SELECT call_id, w, count(*) AS n FROM y GROUP BY 1, 2) b USING (call_id, w) GROUP BY 1)"


@query("sf_22_words", f"WITH {_OUT}, {_R1} SELECT call_id, round(coalesce(2 * hit / (len(regexp_extract_all(lower(output), '[a-z0-9]+')) + len(regexp_extract_all(lower(reference), '[a-z0-9]+'))), 0), 9) AS rouge1, len(regexp_extract_all(output, '\\S+'))::INT AS summary_words FROM o LEFT JOIN m USING (call_id)")
def rouge_words(spark, d):
    """ROUGE-1 over words as they are, and the length."""
    o = _outputs(spark, d)
    return o.select("call_id", F.round(tx.rouge_1(F.col("output"), F.col("reference")), 9).alias("rouge1"), F.size(F.regexp_extract_all("output", F.lit(r"\S+"), F.lit(0))).alias("summary_words"))


_BETTER = r"""r AS (SELECT call_id, regexp_extract(output, '\{[^{}]*\}') AS o FROM judge_results), b AS (SELECT call_id, CASE WHEN json_valid(o) THEN json_type(o, '$.better') END AS kind, CASE WHEN json_valid(o) THEN json_extract_string(o, '$.better') END AS v FROM r)"""


@query("sf_25_pairwise_replies", f"WITH {_BETTER} SELECT call_id, max(CASE WHEN kind IN ('UBIGINT', 'BIGINT') AND v IN ('1', '2') THEN v WHEN kind = 'VARCHAR' AND lower(trim(v)) = 'tie' THEN 'tie' END) AS better FROM b GROUP BY 1")
def pairwise_replies(spark, d):
    """Of every reply, bare, fenced or between sentences."""
    return table(spark, d, "judge_results").select("call_id", ps.pairwise("output").alias("better")).groupBy("call_id").agg(F.max("better").alias("better"))


_GRADES = r"""r AS (SELECT DISTINCT call_id, regexp_extract(output, '(?s)\{.*\}') AS o FROM judge_results WHERE output IS NOT NULL), v AS (SELECT call_id, json_extract(o, '$.faithfulness') AS a, json_extract(o, '$.fluency') AS b FROM r WHERE json_valid(o)),
n AS (SELECT * FROM v WHERE json_type(a) = 'ARRAY' AND json_type(b) = 'ARRAY' AND json_array_length(a) = 2 AND json_array_length(b) = 2), t AS (SELECT call_id, list_concat(json_extract(a, '$[*]'), json_extract(b, '$[*]')) AS x FROM n),
g AS (SELECT call_id, list_transform(x, lambda y: y::VARCHAR::DOUBLE) AS x FROM t WHERE len(list_filter(x, lambda y: json_type(y) IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 4)"""


@query("sf_25_block_replies", f"WITH {_GRADES} SELECT DISTINCT call_id, (x[1] + x[3]) / 2 AS first, (x[2] + x[4]) / 2 AS second FROM g WHERE list_min(x) >= 1 AND list_max(x) <= 5")
def block_replies(spark, d):
    parse = ps.block_parser(2, ["faithfulness", "fluency"])
    return table(spark, d, "judge_results").select("call_id", parse("output").alias("means")).filter("means IS NOT NULL").select("call_id", F.element_at("means", 1).alias("first"), F.element_at("means", 2).alias("second")).distinct()


_LIST = r"(?s)\[\s*\{.*\}\s*\]"


@query("sf_10_entities", f"WITH x AS (SELECT call_id, regexp_extract(output, '{_LIST}') AS o FROM results), y AS (SELECT call_id, json_extract(o, '$[*].text') AS t, json_array_length(o) AS n FROM x WHERE json_valid(o)) SELECT call_id, max(n)::INT AS n_entities FROM y WHERE len(list_filter(t, lambda v: json_type(v) = 'VARCHAR')) = n GROUP BY 1")
def entity_counts(spark, d):
    e = table(spark, d, "results").select("call_id", ps.entity_list("output").alias("es")).filter("es IS NOT NULL")
    return e.groupBy("call_id").agg(F.max(F.size("es")).alias("n_entities"))


_SH = "s AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(x) - 7), lambda i: array_to_string(x[i:i+7], ' ')))) AS sh FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM documents WHERE text IS NOT NULL)), t AS (SELECT item_id, unnest(list_distinct(list_transform(generate_series(1, len(x) - 7), lambda i: array_to_string(x[i:i+7], ' ')))) AS sh FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM test_items))"


@query("sf_26_quotes", f"WITH {_SH} SELECT DISTINCT doc_id FROM s JOIN t USING (sh)")
def quotes(spark, d):
    """Documents that share eight words in a row with any test item: a semi-join on hashes of shingles, so no shingle of the items is broadcast unless Spark finds it small."""
    x = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.transform(tx.ngrams(tx.tokens(F.col("text")), 8), lambda s: F.xxhash64(s))).alias("h"))
    t = table(spark, d, "test_items").select(F.explode(F.transform(tx.ngrams(tx.tokens(F.col("text")), 8), lambda s: F.xxhash64(s))).alias("h")).distinct()
    return x.join(t, "h", "left_semi").select("doc_id").distinct()


@query("sf_32_text_hash", "SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS sha FROM documents WHERE text IS NOT NULL")
def text_hash(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.text_sha256(F.col("text")).alias("sha"))


@query("sf_33_canonical", "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS sha FROM events")
def canonical(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(ps.canonical_json("props"), 256).alias("sha"))


# --- retrieval: embeddings as queries and corpus, relevant = same label

_DENSE = """q AS (SELECT vec_id AS query_id, label, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, c.vec_id AS doc_id, list_cosine_similarity(q.e::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM q, embeddings c WHERE c.vec_id <> q.query_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS place FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) <= 10)"""


def _dense(spark, d):
    """The ten nearest of every twentieth vector among all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.filter("vec_id % 20 = 0"), 10)


@query("sf_17_dense", f"WITH {_DENSE} SELECT query_id, doc_id, place::INT AS place FROM top")
def dense(spark, d):
    return _dense(spark, d).select("query_id", "doc_id", "place")


@query("sf_12_ndcg", f"""WITH {_DENSE}, r AS (SELECT query_id, place, CASE WHEN c.label = q.label THEN 1 ELSE 0 END AS g FROM top JOIN embeddings c ON c.vec_id = doc_id JOIN q USING (query_id)),
n AS (SELECT q.query_id, count(*) AS n FROM q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.query_id GROUP BY 1)
SELECT query_id, round(sum(g / log2(place + 1)) / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(generate_series(1, least(10, any_value(n))::BIGINT)) AS i)), 6) AS ndcg, round(sum(g) / any_value(n), 9) AS recall, round(coalesce(1.0 / min(CASE WHEN g = 1 THEN place END), 0), 9) AS mrr
FROM r JOIN n USING (query_id) GROUP BY query_id""".replace("(SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(generate_series(1, least(10, any_value(n))::BIGINT)) AS i))", "list_sum(list_transform(generate_series(1, least(10, any_value(n))::BIGINT), lambda i: 1 / log2(i + 1)))"))
def ndcg(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id"), "label")
    r = _dense(spark, d).join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    sizes = e.groupBy(F.col("label").alias("want")).agg((F.count("*") - 1).alias("n"))
    hit = (F.col("label") == F.col("want")).cast("double")
    x = r.join(sizes, "want").groupBy("query_id").agg(F.sum(hit / F.log2(F.col("place") + 1.0)).alias("dcg"), F.sum(hit).alias("k"), F.first("n").alias("n"), F.min(F.when(hit == 1, F.col("place"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return x.filter("n > 0").select("query_id", F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.col("k") / F.col("n"), 9).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("mrr"))


_BM = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS f FROM t GROUP BY 1, 2), dl AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(n) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avg_len), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), idf AS (SELECT w, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
fl AS (SELECT 0.25 * avg(idf) AS floor FROM idf), i AS (SELECT w, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM idf, fl),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM test_items), qw AS (SELECT query_id, w, count(*) AS k FROM q GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, sum(k * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avg_len))) AS score FROM qw JOIN tf USING (w) JOIN i USING (w) JOIN dl USING (doc_id), st GROUP BY 1, 2)"""


@query("sf_16_bm25", f"WITH {_BM} SELECT query_id, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 5")
def bm25(spark, d):
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "test_items").select(F.col("item_id").alias("query_id"), "text")
    return search(docs, items, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"))
