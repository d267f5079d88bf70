"""Hand-worked cases and the edges: nulls, ties, repeats, empty tables, extra columns."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyline.functions import parsers as ps
from tallyline.functions import text as tx
from tallyline.operators import aggregates as ag
from tallyline.operators import agreement as agr
from tallyline.operators import checks as vc
from tallyline.operators import datasets as ds
from tallyline.operators import filters, joins
from tallyline.operators import ranks as rk


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_entity_sets(spark):
    s = "item_id string, text string, type string"
    gold = spark.createDataFrame([("a", "Paris", "location"), ("b", "Ada", "person"), ("b", "IBM", "organization")], s)
    half = spark.createDataFrame([("a", "Paris", "location"), ("b", "Ada", "person")], s)
    m = ag.match_sets(half, gold, ["item_id"], ["text", "type"]).groupBy().agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    r = m.select(*ag.prf(*map(F.col, ("tp", "fp", "fn")))).first()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, pytest.approx(2 / 3), 0.8)
    twice = spark.createDataFrame([("a", "Paris", "location"), ("a", "Paris", "location")], s)
    r = ag.match_sets(twice, gold.filter("item_id = 'a'"), ["item_id"], ["text", "type"]).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 0)
    none = spark.range(1).select(*ag.prf(F.lit(0), F.lit(0), F.lit(0))).first()
    assert none["f1"] == 1.0


def test_classes(spark):
    p = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "B")], "gold string, pred string")
    r = ag.class_summary(p).first()
    assert r["accuracy"] == 0.75 and r["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 2) and r["worst_class"] == "A"
    c = {x["gold"]: (x["A"], x["B"], x["<unparsed>"]) for x in ag.confusion(p, ["A", "B"]).collect()}
    assert c == {"A": (1, 1, 0), "B": (0, 2, 0)}
    u = spark.createDataFrame([("A", None), ("A", "A")], "gold string, pred string")
    assert ag.class_summary(u).first()["unparsed"] == 0.5
    assert ag.per_class(spark.createDataFrame([], "gold string, pred string")).count() == 0


def test_rankings(spark):
    def of(ranking, qrels):
        s = tx.ranking_scores(F.array(*map(F.lit, ranking)) if ranking else F.lit(None).cast("array<string>"), F.create_map(*(F.lit(x) for kv in qrels.items() for x in kv)))
        return spark.range(1).select(*(c.alias(k) for k, c in s.items())).first()

    import math

    assert of(["d1", "d2", "d3", "d4"], {"d1": 1, "d2": 1})["ndcg"] == pytest.approx(1.0)
    assert of(["x", "d1"], {"d1": 1})["ndcg"] == pytest.approx(1 / math.log2(3))
    late = of([f"x{i}" for i in range(10)] + ["d1"], {"d1": 1})
    assert late["ndcg"] == 0 and late["recall_deep"] == 1.0 and late["first_relevant"] == 11 and late["mrr"] == 0
    assert of(None, {"d1": 1})["ndcg"] == 0.0
    o = spark.range(1).select(tx.oracle_ndcg(F.array(F.lit("d3"), F.lit("d1")), F.create_map(F.lit("d1"), F.lit(1), F.lit("d2"), F.lit(1))).alias("o")).first()["o"]
    assert o == pytest.approx(1 / (1 + 1 / math.log2(3)))


def test_label_agreement(spark):
    data = [("yes", "yes")] * 20 + [("yes", "no")] * 5 + [("no", "yes")] * 10 + [("no", "no")] * 15
    p = spark.createDataFrame([("s", a, b) for a, b in data], "g string, a string, b string")
    k = agr.kappa(p, ["g"]).first()
    assert k["kappa"] == 0.4 and k["same"] == 35
    one = spark.createDataFrame([("s", "yes", "yes")] * 3, "g string, a string, b string")
    assert agr.kappa(one, ["g"]).first()["kappa"] is None and agr.alpha(one, ["g"]).first()["alpha"] is None
    d = spark.range(1).select(agr.masi(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("m")).first()["m"]
    assert d == pytest.approx(1 - 0.5 * 2 / 3)
    long = spark.createDataFrame([("a sentence with many words",)], "v string")
    assert not agr.are_categories(long, "v").first()["categories"]


def test_answers(spark):
    from tallyline.sources.readers import answers

    r = spark.createDataFrame([('{"accept": ["file", "escalate", "file"]}',), ("plain",)], "l string").select(answers(F.col("l")).alias("a")).collect()
    assert [x["a"] for x in r] == [["escalate", "file"], ["plain"]]


def test_capture_rows(spark):
    t = lambda x: dt.datetime.fromisoformat(x) if x else None
    c = spark.createDataFrame([("a1", "x", t("2026-10-01")), ("a2", None, t("2026-10-05")), ("a3", "y", t("2026-10-09T12:00:00")), ("a4", "x", None)], "id string, kind string, at timestamp")
    p = {"kind": F.col("kind")}
    assert rows(c.filter(filters.where(p, "kind=x")), "id") == [("a1",), ("a4",)]
    assert rows(c.filter(filters.where(p, "kind=")), "id") == [("a2",)]
    x = {r["id"]: r["why"] for r in c.select("id", filters.outside(F.col("at"), "2026-10-02", "2026-10-09 10:00:00").alias("why")).collect()}
    assert x == {"a1": "before since", "a2": None, "a3": "at or after until", "a4": "no time"}


@pytest.mark.parametrize(("rule", "holds"), [
    ({"when": {"verdict": "noise"}, "label": "l"}, True), ({"when": {"verdict": ["file", "noise"]}, "label": "l"}, True), ({"when": {"verdict": "file"}, "label": "l"}, False),
    ({"when": {"issue": "12"}, "label": "l"}, True), ({"unless": {"verdict": "noise"}, "label": "l"}, False), ({"exists": ["gone"], "label": "l"}, False), ({"absent": ["gone"], "label": "l"}, True),
    ({"range": {"days": {"min": 3, "max": 5}}, "label": "l"}, True), ({"range": {"days": {"min": 5}}, "label": "l"}, False), ({"range": {"verdict": {"min": 0}}, "label": "l"}, False),
    ({"min_age_days": 10, "label": "l"}, True), ({"min_age_days": 11, "label": "l"}, False), ({"when": {"gone": None}, "label": "l"}, True),
])
def test_rules(spark, rule, holds):
    df = spark.createDataFrame([("noise", "4", "12", None)], "verdict string, days string, issue string, gone string")
    col = filters.rule_column([rule], {c: F.col(c) for c in df.columns}, F.lit(10))
    assert (df.select(col.alias("l")).first()["l"] == "l") == holds


def test_first_rule_wins_and_skip_is_null(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    col = filters.rule_column([{"when": {"v": "a"}, "skip": True}, {"exists": ["v"], "label": "rest"}], {"v": F.col("v")})
    assert [r["l"] for r in df.select(col.alias("l")).collect()] == [None, "rest"]


def test_split_is_stable(spark):
    df = spark.range(200).select(ds.side("7", F.col("id"), 0.3).alias("s"), "id")
    more = spark.range(400).select(ds.side("7", F.col("id"), 0.3).alias("t"), "id")
    assert df.join(more, "id").filter("s <> t").count() == 0
    assert 40 <= df.filter("s = 'test'").count() <= 80


@pytest.mark.parametrize(("n", "want"), [(29, [15, 14]), (17, [9, 8]), (16, [16]), (1, [1])])
def test_block_sizes(spark, n, want):
    df = spark.range(1, n + 1).select(F.lit("i").alias("item"), F.col("id").alias("place"))
    assert [r["c"] for r in rk.blocks(df, ["item"], "place", 16).groupBy("block").agg(F.count("*").alias("c")).orderBy("block").collect()] == want


def test_midranks_and_winners(spark):
    df = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 1.0), ("i", "c", 0.5)], "item string, arm string, v double")
    got = {r["arm"]: r["r"] for r in df.select("arm", rk.midrank(["item"], F.asc("v"), "v").alias("r")).collect()}
    assert got == {"a": 2.5, "b": 2.5, "c": 1.0}
    assert rows(rk.argmax_set(df, ["item"], "arm", "v"), "arm", "share") == [("a", 0.5), ("b", 0.5)]


def test_promotion(spark):
    df = spark.createDataFrame([("s", "r1", 1.0), ("s", "r2", 0.95), ("s", "r3", 0.5), ("t", "r4", 0.4), ("t", "keep_me", 0.1)], "stratum string, run string, score double")
    got = rows(rk.promote(df, "stratum", "score", "run", 2, 0.9, 2, ("keep",)), "run", "reason")
    assert got == [("keep_me", "override"), ("r1", "top"), ("r2", "top")]


def test_nearest_within(spark):
    t = dt.datetime(2026, 1, 1, 12)
    s = dt.timedelta(seconds=1)
    left = spark.createDataFrame([(1, "u", t), (2, "u", t + 1000 * s), (3, None, t)], "id long, who string, at timestamp")
    right = spark.createDataFrame([("early", "u", t - 60 * s), ("late", "u", t + 60 * s), ("far", "u", t + 1121 * s)], "body string, who string, at timestamp")
    got = {r["id"]: r["nearest_body"] for r in joins.nearest_within(left, right, ["who"], 120, "id", "body").collect()}
    assert got == {1: "early", 2: None, 3: None}
    assert joins.nearest_within(left, right.limit(0), ["who"], 120, "id", "body").count() == 3


def test_changed_and_sets(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, h string")
    b = spark.createDataFrame([("y", "2"), ("z", None), ("w", "1")], "k string, h string")
    assert rows(joins.changed(a, b, "k", "h"), "k", "state") == [("w", "added"), ("x", "removed"), ("y", "changed")]
    assert rows(ds.set_table(a.select("k"), b.select("k")), "k", "side") == [("w", "right"), ("x", "left"), ("y", "both"), ("z", "both")]


def test_percentiles_of_odd_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", 5.0), (None, 2.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["p50"]) for r in ag.exact_percentiles(df, ["g"], "v", {"p50": 0.5}).collect()}
    assert got == {"a": (2, 2.0), "b": (1, 5.0), None: (1, 2.0)}
    assert ag.exact_percentiles(df.limit(0), ["g"], "v", {"p50": 0.5}).count() == 0
    h = ag.histogram(spark.createDataFrame([("a", 0), ("a", 9), ("a", 25)], "g string, v long"), ["g"], "v").orderBy("start").collect()
    assert [(r["start"], r["n"]) for r in h][:2] == [(0, 1), (3, 0)] and sum(r["n"] for r in h) == 3


def test_checks_can_fail(spark):
    a = spark.createDataFrame([("r1", "d1", 1.0), ("r2", "d1", 1.0), ("r9", None, None)], "run string, dataset string, v double")
    known = spark.createDataFrame([("r1",), ("r2",)], "run string")
    assert rows(vc.resolves(a, "run", known, "run", "c"), "subject", "detail") == [("r9", "1")]
    assert rows(vc.present(a, "run", ["dataset", "v"], "c"), "subject", "detail") == [("r9", "dataset,v")]
    assert rows(vc.holds(a, "run", F.col("v") > 0, F.col("v"), "c"), "subject") == [("r9",)]
    assert rows(vc.unique(a, ["dataset"], "c"), "subject", "detail") == [("d1", "2")]
    assert rows(vc.one_of(a, "run", "dataset", ["d2"], "c"), "subject") == [("r1",), ("r2",)]
    assert rows(vc.agrees(a, "dataset", "run", "c"), "subject") == [("d1",)]
    s = spark.createDataFrame([("d", "r1", "i1", 0.1), ("d", "r1", "i2", 0.2), ("d", "r2", "i2", 0.2), ("d", "r2", "i1", 0.1), ("d", "r3", "i1", 0.1)], "d string, run string, item string, v double")
    assert rows(vc.identical_runs(s, "d", "run", "item", "v"), "n_runs", "first_run") == [(2, "r1")]
    assert vc.identical_runs(s.limit(0), "d", "run", "item", "v").count() == 0


def test_digest_ignores_order_and_sees_change(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "k string, h string")
    b = spark.createDataFrame([("y", "2"), ("x", "1")], "k string, h string")
    c = spark.createDataFrame([("y", "1"), ("x", "2")], "k string, h string")
    d = [ds.digest(x, "k", "h").first()["digest"] for x in (a, b, c)]
    assert d[0] == d[1] != d[2]


def test_parsers():
    assert ps.normalize("The Café-Bar, Élan") == "cafe bar elan"
    assert ps.parse_pairwise('Sure: {"better": 2, "reason": "x"}') == "2" and ps.parse_pairwise('{"better": true}') is None and ps.parse_pairwise('{"better": " TIE"}') == "tie" and ps.parse_pairwise(None) is None
    assert ps.parse_pick('{"best": [3, 1]}', 3) == [3, 1] and ps.parse_pick('{"best": [3, 1, 3]}', 3) is None and ps.parse_pick('{"best": 2}', 3) is None and ps.parse_pick('{"best": [4]}', 3) is None
    assert all(ps.parse_pairwise(f'{{"better": {v}}}') is None for v in ('"1"', "1.0", "3", "null", '"both"')) and ps.parse_pairwise('{"better": 1}') == "1" and ps.parse_pick('{"best": true}', 3) is None
    assert ps.parse_block('{"f": [1, 5], "g": [3, 3]}', 2, ["f", "g"]) == [2.0, 4.0] and ps.parse_block('{"f": [1, 6], "g": [3, 3]}', 2, ["f", "g"]) is None
    assert ps.parse_ranking('```json\n["d1", "d2"]\n```') == ["d1", "d2"] and ps.parse_ranking("1. d7\n2. d9") == ["d7", "d9"] and ps.parse_ranking('{"a": 1}') is None and ps.parse_ranking("") is None
    assert ps.entities("Here: [{'text': 'IBM', 'type': 'Org'},]") == [{"text": "IBM", "type": "org"}] and ps.entities("none") is None
    assert ps.canonical('{"b": 1, "a": "é"}') == '{"a":"é","b":1}' and ps.canonical("{") is None
    assert ps.rouge_l("a b c d", "a c d e") == pytest.approx(2 * 3 / 8) and ps.rouge_l(None, "a") == 0.0


def test_text_scores(spark):
    df = spark.createDataFrame([("a b b", "b c"), ("", "x"), (None, "x"), ("Is this it?", "is this it?")], "o string, r string")
    got = [r[0] for r in df.select(tx.overlap_f1(F.col("o"), F.col("r"))).collect()]
    assert got == [0.5, 0.0, 0.0, 1.0]
    g = [r[0] for r in df.select(tx.grounding(F.col("o"), F.col("r"))).collect()]
    assert g == [0.0, 0.0, 0.0, 1.0]
    lab = spark.createDataFrame([("The answer is: Sport.",), ("I think weather, not sport",), ("**Trade**",), ("none",)], "t string")
    assert [r[0] for r in lab.select(tx.parse_label(F.col("t"), {"sport": "s", "weather": "w", "trade": "t"})).collect()] == ["s", "w", "t", None]
    f = tx.format_flags(F.lit("# Head\n\n- one\n- two"))
    r = spark.range(1).select(*(c.alias(k) for k, c in f.items())).first()
    assert r["markdown"] and r["bullets"] and r["paragraphs"] and not r["overlong"]


def test_blind_sheet_is_a_permutation(spark):
    df = spark.createDataFrame([("i", a) for a in "pqr"] + [("j", "p")], "item string, arm string")
    got = rows(ds.blind(df, "item", "arm", "1").filter("item = 'i'"), "letter")
    assert got == [("A",), ("B",), ("C",)]


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([("d", "a", "i", 1.0, 9, "x"), ("d", "b", "i", 0.5, 8, "y")], "dataset_id string, config_id string, item_id string, value double, n long, delta string")
    assert joins.paired(df, "b").count() == 1 and joins.shared_by_all(df).count() == 1


def test_adjudication_and_rules_of_sources(spark):
    g = spark.createDataFrame([("i", "a"), ("j", "a"), ("k", None)], "item string, label string")
    o = spark.createDataFrame([("i", "a", "b"), ("j", "z", "b")], "item string, gold string, ruling string")
    assert rows(ds.adjudicated(g, o, "item", "label"), "item", "label", "stale") == [("i", "b", False), ("j", "a", True), ("k", None, False)]


def test_answer_json(spark):
    from tallyline.sources.sinks import answer

    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 0.5, None)], "a long, b double, c string")
    assert [json.loads(r["json"]) for r in answer(df).collect()] == [{"a": 1, "b": None, "c": "x"}, {"a": 2, "b": 0.5, "c": None}]


def test_random_floor_takes_every_document_and_test_item(spark, tmp_path, monkeypatch):
    import hashlib

    from tallyline.queries import QUERIES, more

    items, docs = [("brio_topics", "b1"), ("elver_qa", "e1"), ("elver_qa", "e2")], range(1, 40)
    spark.createDataFrame(items, "dataset_id string, item_id string").write.parquet(f"{tmp_path}/test_items.parquet")
    spark.createDataFrame([(i,) for i in docs], "doc_id long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(more, "FLOOR_QUERIES", 2)
    got = sorted(tuple(r) for r in QUERIES["sf_18_random_floor"](spark, str(tmp_path)).collect())
    assert got == sorted((q, i) for _, q in items for i in sorted(docs, key=lambda i: hashlib.sha256(f"floor|{q}|{i}".encode()).hexdigest())[:5])  # noqa: B023


def test_runs_without_a_score_come_last_in_every_stratum(spark, tmp_path):
    from tallyline.queries import QUERIES

    rows = [("arm_base", f"r{i:03}", i / 300) for i in range(250)] + [("arm_base", "none", None), ("arm_base", "nan", float("nan")), ("other", "x", None), ("other", "y", 0.5)]
    spark.createDataFrame(rows, "stratum string, run_id string, primary_score double").write.parquet(f"{tmp_path}/run_candidates.parquet")
    got = {(r["stratum"], r["run_id"]): r["position"] for r in QUERIES["rk_6_missing_last"](spark, str(tmp_path)).collect()}
    assert len(got) == 254 and (got["arm_base", "r249"], got["arm_base", "nan"], got["arm_base", "none"]) == (1, 251, 252) and (got["other", "y"], got["other", "x"]) == (1, 2)


@pytest.mark.parametrize(("word", "want"), [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("troubled", "troubl"), ("hopping", "hop"),
    ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("radically", "radic"), ("vietnamization", "vietnam"), ("predication", "predic"),
    ("operator", "oper"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"),
    ("rate", "rate"), ("controlling", "control"), ("dying", "die"), ("news", "news"), ("enjoy", "enjoy"), ("cry", "cri"), ("geology", "geolog"), ("is", "is"),
])
def test_stems(word, want):
    from tallyline.functions.rouge import stem

    assert stem(word) == want


def _common_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_summary_facets(spark):
    import random

    from tallyline.functions import rouge as rg

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = sorted(rg.common_places(a, b))
        assert len(at) == _common_length(a, b) == _common_length([a[i] for i in at], b)
    assert rg.summary_overlap("w1 w2 w3 w4 w5.", "w1 w2 w6 w7 w8. w1 w3 w8 w9 w5.") == pytest.approx((0.4, 0.8, 8 / 15))  # the published example of the union
    f = rg.facets("The dogs ran home. It rained and it rained.", "A dog runs home.", "The dogs ran home after it rained.")
    assert f["rouge1"] == pytest.approx(2 * 2 / 13, abs=1e-9) and f["coverage"] == 0.5 and f["concision"] == pytest.approx(2 / 9) and f["length_vs_reference"] == 2.25 and f["compression"] == pytest.approx(9 / 7, abs=1e-6)
    assert rg.clip("a  b\nc d", 3) == "a  b\nc" and rg.clip("a b", 0) == "" and rg.clip("a b", 9) == "a b"
    rows = [("x", "the cat", "the cat", "the cat sat"), ("none", None, "a", "b"), ("bare", "a b", None, None), ("empty", "", "", "")]
    df = spark.createDataFrame(rows, "k string, o string, r string, s string")
    got = {r["k"]: r["f"] for r in df.select("k", rg.summary_facets("o", "r", "s").alias("f")).collect()}
    assert got["x"]["rougeLsum"] == 1.0 and got["none"]["summary_words"] is None and got["bare"]["summary_words"] == 2 and got["bare"]["rouge1"] is None and got["empty"]["rougeLsum"] == 0.0


def test_word_diff():
    assert ps.word_diff("a b c d", "a x c d e") == {"kept": 3, "inserted": 2, "deleted": 1, "marked": "a [-b-] {+x+} c d {+e+}"}
    assert ps.word_diff(None, "a") == {"kept": 0, "inserted": 1, "deleted": 0, "marked": "{+a+}"} and ps.word_diff("a", "")["marked"] == "[-a-]"
    import random

    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        m = ps.word_diff(" ".join(a), " ".join(b))["marked"].split()
        assert [w.strip("[-]") for w in m if "{+" not in w] == a and [w.strip("{+}") for w in m if "[-" not in w] == b


def test_nearest_and_bm25_by_brute_force(spark, monkeypatch):
    import math
    import random

    import numpy as np

    from tallyline.operators import retrieval as rt

    rng = random.Random(7)
    v = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(rt, "BLOCK_CELLS", 30)
    monkeypatch.setattr(rt, "BATCH", 7)
    got = {}
    for r in rt.nearest(df, df.filter("vec_id % 5 = 0"), 4).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = r["doc_id"]
    unit = {i: np.array(x) / max(np.linalg.norm(x), 1e-30) for i, x in v if x}
    for q in range(0, 60, 5):
        want = sorted((i for i in unit if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 9) + 0.0, i))[:4]
        assert [got[q][p] for p in (1, 2, 3, 4)] == want
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(40, None)]
    queries = [(f"q{i}", " ".join(rng.choice([*words, "unknown"]) for _ in range(3))) for i in range(9)] + [("none", None)]
    bag = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, bag.values())) / len(docs)
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w in words if (k := sum(w in b for b in bag.values()))}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else floor for w, x in idf.items()}
    got = {}
    for r in rt.bm25(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id string, text string"), 3).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = (r["doc_id"], r["score"])
    for q, t in queries:
        s = {i: round(sum(idf[w] * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in (t or "").split() if w in b), 6) for i, b in bag.items() if set(b) & set((t or "").split())}
        want = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [got.get(q, {}).get(p) for p in range(1, len(want) + 1)] == [(i, pytest.approx(x, abs=2e-6)) for i, x in want]
    assert rt.bm25(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(queries, "query_id string, text string"), 3).count() == 0


def test_normalised_in_either_place(spark):
    texts = ["The  Café, Ltd.", "a_b\tC", "An  Apple!", "the", "", None, "ﬁne Straße", "\x1cA. B"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ps.normalized("t")).collect()]
    assert got == [ps.normalize(t) for t in texts]
