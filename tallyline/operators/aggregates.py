"""Roll-ups of scores, classes, entity sets, costs and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r; null where either side has no spread (ST-23)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def run_scores(long: DataFrame, digits: int = 6) -> DataFrame:
    """Mean of every metric of a run over the rows that carry it, and the sums of cost and tokens (AG-1)."""
    total = F.when(F.col("metric").isin("cost_usd", "tokens_in", "tokens_out"), F.round(F.sum("value"), 8))
    return long.groupBy("run_id", "metric").agg(F.round(F.avg("value"), digits).alias("mean"), F.count("*").alias("n"), total.alias("total"))


def arm_table(run_means: DataFrame, *table: str) -> DataFrame:
    """Mean and spread of an arm's runs (AG-2, ST-48), by dataset or by ``table``."""
    return run_means.groupBy(*(table or ("dataset_id",)), "config_id").agg(
        F.round(F.avg("mean"), 9).alias("mean"), F.round(F.max("mean") - F.min("mean"), 9).alias("spread"), F.count("*").alias("n_runs"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles with n and mean, exact, without holding a group in memory (AG-4, AG-6).

    Equal values are counted first (map-side combine), then a running count over the distinct values of a
    group finds the two order statistics around each percentile; the window sorts and spills.
    """
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    part = Window.partitionBy(*keys)
    v = v.withColumn("_cum", F.sum("_c").over(part.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(part))
    aggs = [F.first("_n").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.first("_n")).alias("mean")]
    for name, p in ps.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("_cum") > low, F.col("_v"))).alias(f"_lo_{name}"), F.min(F.when(F.col("_cum") > high, F.col("_v"))).alias(f"_hi_{name}"), F.first(pos - low).alias(f"_w_{name}")]
    got = v.groupBy(*keys).agg(*aggs)
    cols = [(F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * F.col(f"_w_{x}")).alias(x) for x in ps]
    return got.select(*keys, "n", "mean", *cols)


def nearest_rank(df: DataFrame, keys: list[str], value: str, fs: dict[str, float]) -> DataFrame:
    """The value at position floor(f (n - 1) + 0.5) of the sorted values (AG-5)."""
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    part = Window.partitionBy(*keys)
    v = v.withColumn("_cum", F.sum("_c").over(part.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(part))
    return v.groupBy(*keys).agg(*(F.min(F.when(F.col("_cum") > F.floor(F.lit(f) * (F.col("_n") - 1) + 0.5), F.col("_v"))).alias(name) for name, f in fs.items()))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """At most ``bins`` equal bins of whole width over a group's range, empty ones too (AG-5)."""
    x = df.filter(F.col(value).isNotNull())
    span = x.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = span.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / bins)).cast("bigint"))
    counts = x.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("c")).join(span, keys)
    counts = counts.groupBy(*keys, F.floor((F.col("_v") - F.col("lo")) / F.col("width")).alias("bin")).agg(F.sum("c").alias("n"))
    frame = span.select(*keys, "lo", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("hi") - F.col("lo")) / F.col("width")))).alias("bin"))
    return frame.join(counts, [*keys, "bin"], "left").select(*keys, (F.col("lo") + F.col("bin") * F.col("width")).alias("start"), "width", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of every gold label; what divides by zero is 0 (AG-7). A null prediction is unparsed."""
    side = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold).eqNullSafe(F.col(pred))).cast("int").alias("t")),
                             F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("s")
    c = pairs.select(side).select("s.*").filter("label IS NOT NULL").groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return c.filter("support > 0").select("label", "support", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def class_summary(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Accuracy, macro-F1 over all gold labels, share unparsed, worst class (AG-8)."""
    a = pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.col(gold).eqNullSafe(F.col(pred)).cast("int")), 9).alias("accuracy"), F.round(F.avg(F.col(pred).isNull().cast("int")), 9).alias("unparsed"))
    c = per_class(pairs, gold, pred).agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.min(F.struct("f1", "label")).getField("label").alias("worst_class"))
    return a.withColumn("_one", F.lit(1)).join(c.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def confusion(pairs: DataFrame, labels: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Gold by predicted with <unparsed>, zeros kept (AG-9)."""
    x = pairs.select(F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit("<unparsed>")).alias("pred"))
    return x.groupBy("gold").pivot("pred", [*labels, "<unparsed>"]).count().na.fill(0)


def crosstab(df: DataFrame, group: Column, down: Column, across: Column) -> DataFrame:
    """Counts of two values by group with totals on every side; a total has ``all`` in its place (AG-10, AG-36)."""
    x = df.select(F.coalesce(group, F.lit("none")).alias("grp"), F.coalesce(down, F.lit("none")).alias("down"), F.coalesce(across, F.lit("none")).alias("across"))
    c = x.groupBy("grp", "down", "across").agg(F.count("*").alias("n"))
    g = c.groupingSets([["grp", "down", "across"], ["grp", "down"], ["grp", "across"], ["grp"]], "grp", "down", "across").agg(F.sum("n").alias("n"), F.grouping("down").alias("gd"), F.grouping("across").alias("ga"))
    return g.select("grp", F.when(F.col("gd") == 1, "all").otherwise(F.col("down")).alias("down"), F.when(F.col("ga") == 1, "all").otherwise(F.col("across")).alias("across"), "n")


def member_counts(members: DataFrame, by: list[str], member: list[str]) -> DataFrame:
    """Multiset counts of members for each item."""
    return members.groupBy(*by, *member).agg(F.count("*").alias("c"))


def match_sets(pred: DataFrame, gold: DataFrame, by: list[str], member: list[str]) -> DataFrame:
    """True positives, false positives and negatives of every member: one-to-one matching of multisets (SF-7)."""
    p, g = member_counts(pred, by, member).withColumnRenamed("c", "p"), member_counts(gold, by, member).withColumnRenamed("c", "g")
    x = p.join(g, [*by, *member], "full_outer").na.fill(0, ["p", "g"])
    return x.select(*by, *member, F.least("p", "g").alias("tp"), (F.col("p") - F.least("p", "g")).alias("fp"), (F.col("g") - F.least("p", "g")).alias("fn"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; nothing on both sides is 1 (SF-8)."""
    none = (tp + fp + fn) == 0
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return [F.round(F.when(none, 1.0).otherwise(c), 9).alias(n) for n, c in (("precision", p), ("recall", r), ("f1", f1))]


def field_summary(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """For each declared field: filled, of, distinct, and least, median, greatest for numbers (AG-18)."""
    cols = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind"), F.col(n).cast("string").alias("text"), (F.col(n).cast("double") if k == "number" else F.lit(None).cast("double")).alias("num")) for n, k in fields.items()))).alias("x")
    x = df.select(cols).select("x.*")
    base = x.groupBy("field", "kind").agg(F.count("text").alias("filled"), F.count("*").alias("of"), F.min("num").alias("least"), F.max("num").alias("greatest"))
    distinct = x.groupBy("field", "text").agg(F.count("*").alias("c")).groupBy("field").agg(F.count("text").alias("n_distinct"))
    median = exact_percentiles(x, ["field"], "num", {"median": 0.5}).select("field", "median")
    return base.join(distinct, "field").join(median, "field", "left")
