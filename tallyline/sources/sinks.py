"""Sinks: run tables, sheets and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_runs(df: DataFrame, path: str) -> None:
    """The fact table, partitioned so that a scan of a dataset reads only its files; rewriting a dataset replaces it (SK-1, SS-5)."""
    df.repartition("dataset_id", "config_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def answer(df: DataFrame) -> DataFrame:
    """One JSON text a row; NaN and infinite values are null (SK-2)."""
    cols = [F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_sheet(df: DataFrame, path: str, fill: tuple[str, ...] = ()) -> None:
    """A CSV sheet with empty columns to fill in (SK-3)."""
    df.select("*", *(F.lit("").alias(c) for c in fill)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_texts(df: DataFrame, key: str, text: str, folder: str, most: int = 10_000) -> None:
    """A text file for each row, named by its key, for sets that are small by nature; more than ``most`` rows are refused, as a table is the place for them (SC-8)."""
    spark = df.sparkSession
    rows = df.select(key, text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} texts: write a table")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, t in rows:
        out = fs.create(path(f"{folder}/{k}.txt"), True)
        out.write(bytearray((t or "").encode()))
        out.close()


def write_report(finalists: DataFrame, promoted: DataFrame, path: str) -> None:
    """Finalists and the promotion summary as JSON lines beside each other (SK-4)."""
    finalists.write.mode("overwrite").json(f"{path}/finalists")
    promoted.write.mode("overwrite").json(f"{path}/promotions")
