import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyline.sources import plugins, readers, sinks
from tallyline.streaming import captures as cap


def test_run_scan_skips_what_it_cannot_read(spark, tmp_path):
    for name, text in {"a": json.dumps({"run_id": "a", "dataset_id": "d", "config_id": "opal", "scores": {"f1": 0.5}}), "b": "{ broken", "c": json.dumps({"run_id": "c", "dataset_id": "d"})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert [r["run_id"] for r in readers.runs(spark, str(tmp_path), dataset_id="d", match="op").collect()] == ["a"]


def test_prediction_scan(spark, tmp_path):
    p = tmp_path / "predictions.jsonl"
    p.write_text('{"item_id": "i", "f1": 0.5, "resumed": 0}\n\n{"item_id": "j", "f1": true}\n{"item_id": "k", "f1": 1}\n')
    got = {r["item_id"]: r["f1"] for r in readers.predictions(spark, str(p), ["f1"]).collect()}
    assert got == {"i": 0.5, "j": None, "k": 1.0}
    p.write_text('{"item_id": "i", "f1": 0.5}\n{ broken\n')
    assert readers.predictions(spark, str(p), ["f1"], strict=False).count() == 1
    with pytest.raises(Exception):
        readers.predictions(spark, str(p), ["f1"]).collect()


def test_texts_labels_and_captures(spark, tmp_path):
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold/i1.txt").write_text("two\nlines")
    assert readers.texts(spark, str(tmp_path / "gold")).first().asDict() == {"item_id": "i1", "text": "two\nlines"}
    (tmp_path / "set.json").write_text(json.dumps({"dataset_id": "d", "set": "s", "labels": [{"item_id": "i", "sha256": "h", "label": '{"accept": ["b", "a"]}'}]}))
    assert readers.label_sets(spark, str(tmp_path / "set.json")).first()["answers"] == ["a", "b"]
    good = hashlib.sha256(b"body").hexdigest()
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(r) + "\n" for r in ({"id": "1", "body": "body", "sha256": good, "created_at": "2026-01-01"}, {"id": "2", "body": "other", "sha256": good})))
    assert {r["id"]: r["state"] for r in readers.captures(spark, str(tmp_path / "c.jsonl")).collect()} == {"1": "ok", "2": "changed"}


def test_importer_maps_columns_and_urls(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("key\tbody\n7\thello\n")
    r = readers.imported(spark, str(p), {"id": "key", "body": "body"}, tab=True, url="https://h/{key}/v").first()
    assert (r["id"], r["body"], r["outcome"], r["url"]) == ("7", "hello", None, "https://h/7/v")


def test_run_sink_replaces_a_dataset_only(spark, tmp_path):
    df = spark.createDataFrame([("d1", "c", 1.0), ("d2", "c", 2.0)], "dataset_id string, config_id string, v double")
    sinks.write_runs(df, str(tmp_path / "t"))
    sinks.write_runs(df.filter("dataset_id = 'd1'").withColumn("v", F.lit(5.0)), str(tmp_path / "t"))
    assert {r["dataset_id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"d1": 5.0, "d2": 2.0}
    sinks.write_sheet(df, str(tmp_path / "sheet"), ("note",))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheet")).columns == ["dataset_id", "config_id", "v", "note"]


def test_data_source_and_plugins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 3, "created_at": "2026-01-01"}\n\n{"id": 4}\n')
    spark.dataSource.register(plugins.JsonRecords)
    got = spark.read.format("records").option("path", str(tmp_path)).load().collect()
    assert [(r["id"], r["created_at"]) for r in got] == [("3", "2026-01-01"), ("4", None)]
    items = spark.createDataFrame([("i", "One. Two. Three."), ("j", None)], "item_id string, text string")
    out = {r["item_id"]: r["output"] for r in plugins.call_system(items, plugins.echo(2)).collect()}
    assert out == {"i": "One. Two", "j": None}
    s = plugins.score(spark.createDataFrame([("a b", "b")], "output string, reference string"), "overlap").first()
    assert s["overlap_f1"] == pytest.approx(2 / 3) and s["output_words"] == 2
    g = items.select("item_id", plugins.fake_judge("ash", F.col("item_id"), ["f", "g"]).alias("m")).first()
    assert g["m"] == {d: plugins.fake_grade("ash", "i", d) for d in ("f", "g")}


def test_a_second_run_of_a_stream_adds_nothing(spark, tmp_path):
    src = tmp_path / "src"
    spark.sql("SELECT 1L AS event_id, timestamp_ntz'2026-01-01 10:00:00' AS ts, 2.0D AS value UNION ALL SELECT 1L, timestamp_ntz'2026-01-01 10:00:00', 2.0D").write.parquet(str(src))
    run = lambda: cap.run_once(cap.deduplicated(cap.events(spark, str(src)), "event_id", "1 day").select("event_id"), str(tmp_path / "out")).count()
    assert run() == 1 and run() == 1
    spark.sql("SELECT 2L AS event_id, timestamp_ntz'2026-01-01 11:00:00' AS ts, 2.0D AS value").write.mode("append").parquet(str(src))
    assert run() == 2


def test_corpus_metrics_and_report(spark, tmp_path):
    df = spark.createDataFrame([("x", "A", "A"), ("x", "A", "B"), ("x", "B", "B"), ("x", "B", "B"), ("y", "A", None), ("y", None, "A")], "k string, gold string, pred string")
    got = {r["grp"]: (r["accuracy"], r["macro_f1"]) for r in plugins.corpus_metrics(df, "k", "gold", "pred", ["accuracy", "macro_f1"]).collect()}
    assert got["x"] == (0.75, pytest.approx((2 / 3 + 0.8) / 2)) and got["y"] == (0.0, 0.0)
    sinks.write_report(df, df.limit(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/finalists")).count() == 6


def test_tasks_and_catalog(spark):
    from tallyline.plans.catalog import Catalog

    df = spark.createDataFrame([("i", '{"better": 1}'), ("i", 'So: {"better": 1, "reason": "x"}'), ("i", " odd "), ("i", None)], "item_id string, output string")
    assert sorted(r["label"] for r in plugins.reparse(df, "pairwise").collect()) == ["1", "1", plugins.UNPARSED, plugins.UNPARSED]
    assert sorted(r["decision"] for r in plugins.decided(df, "pairwise").collect()) == ["", "1", "1", "odd"]
    t = plugins.TASKS["pairwise"]
    x = spark.createDataFrame([('{"better": 2}', '{"better":2}'), ("a ", "a"), (None, None), ("a", "b")], "a string, b string")
    assert [r[0] for r in x.select(t.same(F.col("a"), F.col("b"))).collect()] == [True, True, True, False] and t.scorer_id == "pairwise-1"
    f = spark.createDataFrame([("r1", "x", "d", "i", 0.5, 9.0), ("r2", "x", "d", "i", 0.7, None), ("r3", "y", "e", "i", None, 1.0)], "run_id string, config_id string, dataset_id string, item_id string, f1 double, ms double")
    c = Catalog(f, ("f1", "ms"), shape=("ms",), lower=("ms",))
    assert {r["arm"]: (r["n_datasets"], r["n_runs"], r["n_items"]) for r in c.describe().collect()} == {"x": (1, 2, 1), "y": (1, 1, 1)}
    assert {(r["metric"], round(r["value"], 9)) for r in c.scores("x").collect()} == {("f1", 0.6), ("ms", 9.0)} and c.preferred_metrics() == ("f1",)
    assert [r["arm"] for r in c.arms_of("y").collect()] == ["y"] and c.lower_is_better("ms") and c.is_neutral("ms") and not c.is_neutral("f1")


def test_texts_are_refused_when_they_are_many(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "k string, t string")
    sinks.write_texts(df, "k", "t", str(tmp_path / "t"))
    assert {r["item_id"]: r["text"] for r in readers.texts(spark, str(tmp_path / "t")).collect()} in ({"a": "x", "b": ""}, {"a": "x"})
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_texts(df, "k", "t", str(tmp_path / "u"), most=1)
