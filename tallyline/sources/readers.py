"""Scans of run trees, label sets, captures and corpora, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The closed part of a run record; open parts stay text and are read by path (D5).
RUN = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("dataset_id", T.StringType()), T.StructField("config_id", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("n_items", T.LongType()), T.StructField("primary_metric", T.StringType()), T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("metric_kinds", T.MapType(T.StringType(), T.StringType())), T.StructField("metric_directions", T.MapType(T.StringType(), T.StringType())),
])
CAPTURE = T.StructType([T.StructField("id", T.StringType()), T.StructField("body", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("source", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("sha256", T.StringType())])


def runs(spark: SparkSession, path: str, dataset_id: str | None = None, match: str | None = None, config_id: str | None = None) -> DataFrame:
    """Run records, one JSON document a file; unreadable ones and those without a config are skipped (SC-1, SC-3)."""
    schema = T.StructType([*RUN.fields, T.StructField("_bad", T.StringType())])
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    r = r.filter(F.col("_bad").isNull() & F.col("config_id").isNotNull()).drop("_bad")
    for c, v in (("dataset_id", dataset_id), ("config_id", config_id)):
        if v is not None:
            r = r.filter(F.col(c) == v)
    return r.filter(F.col("config_id").contains(match)) if match else r


def predictions(spark: SparkSession, path: str, metrics: list[str], strict: bool = True) -> DataFrame:
    """Rows of predictions.jsonl; a malformed line fails the read or, if not strict, is dropped; blank lines do not count (SC-2).

    Metrics that are no number (a boolean, a text) are missing (SC-4).
    """
    schema = T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(m, T.StringType()) for m in metrics), T.StructField("resumed", T.IntegerType()), T.StructField("_meta", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.select("item_id", *(F.col(m).try_cast("double").alias(m) for m in metrics), "resumed", "_meta")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One text a file: item_id (the file's name) and text (SC-8, SC-16)."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("item_id"), F.col("value").alias("text"))


def label_sets(spark: SparkSession, path: str) -> DataFrame:
    """Labels of label-set documents, exploded: dataset_id, set_name, item_id, item_sha256, answers (SC-9, SF-31)."""
    label = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("label", T.StringType())])
    schema = T.StructType([T.StructField("dataset_id", T.StringType()), T.StructField("set", T.StringType()), T.StructField("labels", T.ArrayType(label))])
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    x = d.select("dataset_id", F.col("set").alias("set_name"), F.explode("labels").alias("l")).select("dataset_id", "set_name", "l.item_id", F.col("l.sha256").alias("item_sha256"), "l.label")
    return x.withColumn("answers", answers(F.col("label")))


def answers(label):
    """The accepted answers of a label: ``{"accept": [...]}`` or the text itself, sorted and distinct (SF-31)."""
    many = F.from_json(label, "struct<accept:array<string>>")["accept"]
    return F.array_sort(F.array_distinct(F.coalesce(many, F.array(label))))


def captures(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Capture records with their state: ``ok`` or ``changed`` if the body does not have its recorded hash (SC-10, VC-17)."""
    c = spark.read.schema(CAPTURE).json(path).withColumn("created_at", F.try_to_timestamp("created_at"))
    if not verify:
        return c
    return c.withColumn("state", F.when(F.sha2(F.coalesce("body", F.lit("")), 256).eqNullSafe(F.col("sha256")), "ok").otherwise("changed"))


def imported(spark: SparkSession, path: str, mapping: dict[str, str], tab: bool = False, url: str | None = None) -> DataFrame:
    """Records of a JSONL or TSV file by a column mapping to id, body, created_at, outcome, with a URL template of ``{column}`` (SC-11)."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path) if tab else spark.read.json(path)
    out = [F.col(mapping[k]).cast("string").alias(k) if k in mapping else F.lit(None).cast("string").alias(k) for k in ("id", "body", "created_at", "outcome")]
    if url:
        parts = []
        for i, x in enumerate(url.replace("{", "\0").replace("}", "\0").split("\0")):
            parts.append(F.coalesce(F.col(x).cast("string"), F.lit("")) if i % 2 else F.lit(x))
        out.append(F.concat(*parts).alias("url"))
    return rows.select(*out)
