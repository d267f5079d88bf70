"""Dataset algebra: splits, versions, extensions, labels from several sources, sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import text_sha256


def freeze(items: DataFrame, key: str, text: str) -> DataFrame:
    """Item and hash of its text (DS-1)."""
    return items.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256"))


def side(seed: str, key: Column, share: float) -> Column:
    """validation or test: the first 15 hex digits of sha256(seed:key) as a share of 16^15 (DS-4); stable across versions."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 15), 16, 10).cast("double")
    return F.when(head / F.lit(float(16**15)) < share, "test").otherwise("validation")


def extend(parent: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The parent's items and the new ones it does not have (DS-6)."""
    return parent.unionByName(more.join(parent.select(key), key, "left_anti").select(parent.columns))


def set_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members of two sets and where they stand: left, right or both (DS-8 to DS-10), from one aggregation."""
    x = left.distinct().withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(right.distinct().withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    s = x.groupBy(*left.columns).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    return s.select(*left.columns, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def new_values(now: DataFrame, before: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) pairs of ``now`` that ``before`` never had (DS-17)."""

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("x.*").filter("value IS NOT NULL").distinct()

    return long(now).join(long(before), ["field", "value"], "left_anti")


def adjudicated(gold: DataFrame, overrides: DataFrame, key: str, label: str) -> DataFrame:
    """Gold with overrides where the gold they were made for still holds; ``stale`` marks the others (DS-22). ``overrides``: key, gold, ruling."""
    o = overrides.select(F.col(key).alias("_k"), F.col("gold").alias("_g"), F.col("ruling").alias("_r"))
    x = gold.join(o, gold[key] == F.col("_k"), "left")
    same = F.col("_g").eqNullSafe(gold[label])
    return x.select(gold[key], F.when(same, F.coalesce("_r", gold[label])).otherwise(gold[label]).alias(label), (F.col("_k").isNotNull() & ~same).alias("stale"))


def union_sources(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """UNION ALL of labelled rows, each with its source (DS-23)."""
    return reduce(DataFrame.unionByName, (df.select(*columns, F.lit(name).alias("source")) for name, df in parts.items()))


def cascade(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first regular expression that finds something (DS-25, SF-5)."""
    out: Column | None = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(default) if out is not None else F.lit(default)


def blind(df: DataFrame, item: str, arm: str, seed: str) -> DataFrame:
    """A letter for each arm of an item, in an order that the hash of seed, item and arm gives (DS-18)."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(item), F.col(arm)), 256)
    place = F.row_number().over(Window.partitionBy(item).orderBy(h, arm))
    return df.select(item, arm, F.chr(64 + place).alias("letter"))


def rescore(outputs: DataFrame, references: DataFrame, key: str, scorer: Column, carry: list[str]) -> DataFrame:
    """New scores from stored outputs; what the call cost is carried on (DS-19, JN-7)."""
    return outputs.join(references, key, "left").select(*carry, scorer.alias("score"))


def digest(df: DataFrame, key: str, sha: str) -> DataFrame:
    """One hash of a set of (key, hash) pairs whatever their order and number: sums of halves of each row's hash, hashed (SF-34). Nothing is collected."""
    row = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col(sha)), 256)
    word = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    s = df.agg(F.count("*").alias("n"), *(F.sum(word(i)).alias(f"s{i}") for i in range(4)))
    return s.select("n", F.sha2(F.concat_ws("|", "n", *(f"s{i}" for i in range(4))), 256).alias("digest"))


def profile(df: DataFrame, key: str, text: str) -> DataFrame:
    """Items, distinct texts, empty ones, words, and how many hold a link (DS-11)."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != ""))
    return df.agg(F.count(key).alias("n_items"), F.countDistinct(text_sha256(F.col(text))).alias("n_texts"), F.count_if(words == 0).alias("n_empty"), F.sum(words).alias("n_words"), F.count_if(F.col(text).rlike(r"https?://\S+")).alias("n_linked"))
