"""Plug-ins: a JSON-lines data source for Spark, scorers, corpus metrics, systems and judges as functions (UD-1, UD-2, UD-3, UD-6, UD-8, UD-9)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class JsonRecords(DataSource):
    """``spark.read.format("records")``: files of JSON lines as (id, body, created_at), one partition a file (UD-6, SC-12)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "id string, body string, created_at string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.ident = options["path"], options.get("id", "id")

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(x for x in p.glob("*.json*") if x.name[0] not in "._") if p.is_dir() else [p])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    r = json.loads(line)
                    yield str(r.get(self.ident)), json.dumps(r, sort_keys=True, ensure_ascii=False), r.get("created_at")


@dataclass
class Scorer:
    """A scorer: columns from output and reference, and what its metrics are (UD-1, UD-3)."""

    name: str
    columns: Callable[[Column, Column], dict[str, Column]]
    primary: str
    kinds: dict[str, str] = field(default_factory=dict)
    directions: dict[str, str] = field(default_factory=dict)


SCORERS: dict[str, Scorer] = {}


def register(scorer: Scorer) -> Scorer:
    if scorer.primary in scorer.directions and scorer.directions[scorer.primary] not in ("higher", "lower"):
        raise ValueError("a direction is higher or lower")
    SCORERS[scorer.name] = scorer
    return scorer


def score(df: DataFrame, name: str, output: str = "output", reference: str = "reference") -> DataFrame:
    """``df`` with the metrics of a scorer; they stay in the JVM if the scorer's columns do."""
    return df.select("*", *(c.alias(k) for k, c in SCORERS[name].columns(F.col(output), F.col(reference)).items()))


def call_system(items: DataFrame, system: Callable[[str], str], key: str = "item_id", text: str = "text") -> DataFrame:
    """A system's output for every item, batch by batch (UD-2)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"item_id": pdf[key].astype(str), "output": [system(t) if t is not None else None for t in pdf[text]]})

    return items.select(key, text).mapInPandas(run, "item_id string, output string")


def echo(sentences: int) -> Callable[[str], str]:
    """The first sentences of a text: a deterministic arm (SF-30)."""
    return lambda text: ". ".join(text.split(". ")[:sentences])


def fake_judge(name: str, item: Column, dims: list[str], low: int = 1, high: int = 5) -> Column:
    """Grades that follow from the hash of judge, item and dimension (UD-9)."""
    grade = lambda d: (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(name), item, F.lit(d)), 256), 1, 8), 16, 10).cast("bigint") % (high - low + 1) + low).cast("int")
    return F.create_map(*(x for d in dims for x in (F.lit(d), grade(d))))


def fake_grade(name: str, item: str, dim: str, low: int = 1, high: int = 5) -> int:
    """fake_judge for one value, for tests."""
    return int(hashlib.sha256(f"{name}|{item}|{dim}".encode()).hexdigest()[:8], 16) % (high - low + 1) + low


def _default(output: Column, reference: Column) -> dict[str, Column]:
    from ..functions.text import output_words, overlap_f1

    return {"overlap_f1": overlap_f1(output, reference), "output_words": output_words(output)}


def declared(spark) -> DataFrame:
    """scorer, primary_metric, metric, kind and direction of every registered scorer (UD-3); a metric without a word on it is of quality, and a descriptive one has no direction."""
    empty = spark.range(1).select(F.lit("").alias("o"), F.lit("").alias("r"))
    rows = []
    for s in SCORERS.values():
        for m in s.columns(empty["o"], empty["r"]):
            kind = s.kinds.get(m, "quality")
            rows.append((s.name, s.primary, m, kind, s.directions.get(m, "higher") if kind == "quality" else "none"))
    return spark.createDataFrame(rows, "scorer string, primary_metric string, metric string, kind string, direction string")


@dataclass
class Task:
    """How stored replies are read: a column of labels, and a version that changes when the reading does (UD-4, UD-5).

    ``title`` names an item by a column of it.
    """

    name: str
    parse_label: Callable[[Column], Column]
    version: int = 1
    title: Callable[[Column], Column] | None = None

    @property
    def scorer_id(self) -> str:
        return f"{self.name}-{self.version}"

    def decision(self, output: Column) -> Column:
        """What a view shows for a reply: its label, else the reply itself."""
        return F.coalesce(self.parse_label(output), output)

    def same(self, a: Column, b: Column) -> Column:
        """Whether two replies are one decision, blanks at their ends aside; nothing is like nothing."""
        bare = lambda x: F.trim(F.coalesce(self.decision(x), F.lit("")))
        return bare(a) == bare(b)


UNPARSED = "<unparsed>"
TASKS: dict[str, Task] = {}


def add_task(task: Task) -> Task:
    TASKS[task.name] = task
    return task


def reparse(df: DataFrame, task: str, output: str = "output") -> DataFrame:
    """``df`` with label (or <unparsed>) and scorer, whatever an earlier parser had stored (UD-4)."""
    t = TASKS[task]
    return df.withColumn("label", F.coalesce(t.parse_label(F.col(output)), F.lit(UNPARSED))).withColumn("scorer", F.lit(t.scorer_id))


def decided(df: DataFrame, task: str, output: str = "output") -> DataFrame:
    """``df`` with decision: rows of one decision are the same in the sense of Task.same (UD-5)."""
    return df.withColumn("decision", F.trim(F.coalesce(TASKS[task].decision(F.col(output)), F.lit(""))))


def _pairwise(output: Column) -> Column:
    from ..functions.parsers import pairwise

    return pairwise(output)


add_task(Task("pairwise", _pairwise))
register(Scorer("overlap", _default, "overlap_f1", {"output_words": "descriptive"}, {"overlap_f1": "higher"}))


def accuracy(cells: dict[tuple[str, str | None], int]) -> float:
    return sum(n for (g, p), n in cells.items() if g == p) / sum(cells.values())


def macro_f1(cells: dict[tuple[str, str | None], int]) -> float:
    """Over the gold labels; a null prediction is none."""
    labels = {g for g, _ in cells}
    total = 0.0
    for x in labels:
        tp = cells.get((x, x), 0)
        both = sum(n for (g, _), n in cells.items() if g == x) + sum(n for (_, p), n in cells.items() if p == x)
        total += 2 * tp / both
    return total / len(labels)


CORPUS: dict[str, Callable[[dict], float]] = {"accuracy": accuracy, "macro_f1": macro_f1}


def corpus_metrics(df: DataFrame, by: str, gold: str, pred: str, names: list[str]) -> DataFrame:
    """Metrics of whole corpora by group (UD-8): functions of the counts of (gold, predicted), so that a group's rows are folded before any function sees them."""
    cells = df.filter(F.col(gold).isNotNull()).groupBy(F.col(by).cast("string").alias("grp"), F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        c = {(g, p if isinstance(p, str) else None): int(n) for g, p, n in zip(pdf["g"], pdf["p"], pdf["n"], strict=True)}
        return pd.DataFrame([[pdf["grp"].iloc[0], *(float(CORPUS[m](c)) for m in names)]], columns=["grp", *names])

    return cells.groupBy("grp").applyInPandas(one, "grp string, " + ", ".join(f"{m} double" for m in names))
