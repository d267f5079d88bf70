"""Paired comparisons of arms, their p-values and family-wise verdicts."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import signflip as sf
from ..storage import durable_table
from .joins import paired


def holm(df: DataFrame, p: str, by: list[str], ties: list[str], alpha: float = sf.ALPHA, family: int | None = None) -> DataFrame:
    """threshold, significant and p_holm of Holm's step-down (ST-3, ST-4); rows without p keep null and false.

    ``by`` names the families; equal p-values go in the order of ``ties``. The p's of a family are few: one per arm.
    """
    w = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p, *ties)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    m = F.greatest(F.count(p).over(Window.partitionBy(*by)), F.lit(family or 0))
    i = F.row_number().over(w) - 1
    thr = F.when(F.col(p).isNotNull(), F.lit(alpha) / (m - i))
    out = df.withColumn("threshold", thr).withColumn("significant", F.coalesce(F.every(F.col(p) <= F.col("threshold")).over(run), F.lit(False)))
    return out.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max(F.least(F.lit(1.0), F.col(p) * (m - i))).over(run)))


def bonferroni(p: Column, family: Column | int, alpha: float = sf.ALPHA) -> tuple[Column, Column]:
    """(corrected p, significant) (ST-5)."""
    k = F.lit(family) if isinstance(family, int) else family
    return F.least(F.lit(1.0), p * k), p <= F.lit(alpha) / k


def delta_table(pairs: DataFrame, keys: list[str], higher_is_better: bool = True) -> DataFrame:
    """n, means, delta, wins, losses, ties and the sums the limit needs, by aggregation alone (ST-8 without p)."""
    sign = 1 if higher_is_better else -1
    d = F.col("delta") * sign
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("a").alias("mean"), F.avg("b").alias("baseline_mean"), F.avg("delta").alias("mean_delta"),
        F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"),
        F.sum("delta").alias("_total"), F.sum(F.col("delta") * F.col("delta")).alias("_squares"))


def _limit(total: str, squares: str) -> Column:
    """The limit of the sign-flip p, from a pair's sums."""

    @F.pandas_udf("double")
    def limit(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([sf.limit_p(x, y) for x, y in zip(t, s, strict=True)], dtype="float64")

    return limit(total, squares)


#: Draws that one task makes; longer tests are split by passes, and each part skips ahead in the stream.
TASK_DRAWS = 200_000_000


def _exact(pairs: DataFrame, keys: list[str], plan: DataFrame, intervals: bool) -> DataFrame:
    """keys, p, low and high of pairs of at most EXACT items, whose deltas are an array of a row."""

    @F.pandas_udf("p double, low double, high double")
    def test(deltas: pd.Series) -> pd.DataFrame:
        rows = [(sf.exact_p(d), *((sf.interval(d) if intervals else None) or (None, None))) for d in (np.asarray(x, dtype=float) for x in deltas)]
        return pd.DataFrame(rows, columns=["p", "low", "high"], dtype="float64")

    got = pairs.select(*keys, "delta").join(plan.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list("delta")).alias("deltas"))
    return got.withColumn("x", test("deltas")).select(*keys, "x.*")


def _sampled(pairs: DataFrame, keys: list[str], plan: DataFrame, permutations: int, seed: int, intervals: bool) -> DataFrame:
    """keys, p, low and high of the pairs in ``plan``: keys, n (at most DRAWN) and state, that of their stream before them (null at its start).

    A task holds the deltas of one pair and draws at most TASK_DRAWS signs; hits of a pair's parts are summed. Short pairs
    are enumerated many to a batch.
    """
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    each = F.greatest(F.lit(1), F.floor(F.lit(TASK_DRAWS) / F.col("n"))).cast("int")
    number = F.ceil(F.lit(permutations) / each).cast("int")
    parts = plan.filter(F.col("n") > sf.EXACT).select(*keys, F.col("state").alias("_state"), each.alias("_each"), F.explode(F.sequence(F.lit(0), number - 1)).alias("_part"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        part, each, state = int(pdf["_part"].iloc[0]), int(pdf["_each"].iloc[0]), pdf["_state"].iloc[0]
        d = pdf.sort_values("item_id")["delta"].to_numpy(float)
        p = hit = None
        first = part * each
        passes = min(each, permutations - first)
        if state is None and passes == permutations:
            p = sf.drawn_p(d, permutations, seed)
        else:
            hit = sf.drawn_hits(d, passes, sf.Signs(seed, first * len(d), state))
        ci = sf.interval(d) if intervals and not part else None
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), p, hit, *(ci or (None, None))]], columns=[*keys, "p", "hit", "low", "high"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", p double, hit double, low double, high double"
    got = pairs.select(*keys, "item_id", "delta").join(parts, keys).groupBy(*keys, "_part").applyInPandas(one, schema)
    p = F.coalesce(F.max("p"), (F.sum("hit") + 1) / (permutations + 1))
    got = got.groupBy(*keys).agg(p.alias("p"), F.max("low").alias("low"), F.max("high").alias("high"))
    return got.unionByName(_exact(pairs, keys, plan.filter(F.col("n") <= sf.EXACT), intervals))


def tests(pairs: DataFrame, keys: list[str], table: DataFrame, intervals: bool = True, permutations: int = sf.PERMUTATIONS, seed: int = sf.SEED) -> DataFrame:
    """p and interval for each row of ``table`` (from delta_table); p is null for a single item and where all deltas are 0.

    Every test has a stream of its own from the seed. Pairs above DRAWN items are never gathered: the limit comes from the sums.
    """
    plan = table.filter(F.col("n") <= sf.DRAWN).select(*keys, "n", F.lit(None).cast("binary").alias("state"))
    got = _sampled(pairs, keys, plan, permutations, seed, intervals)
    moved = table.filter((F.col("n") >= 2) & (F.col("_squares") > 0)).select(*keys, F.lit(True).alias("_moved"))
    got = got.join(moved, keys, "left").select(*keys, F.when(F.col("_moved"), F.col("p")).alias("p"), "low", "high")

    z = 1.959964
    half = (z + (z**3 + z) / (4 * (F.col("n") - 1))) * F.sqrt((F.col("_squares") - F.col("_total") * F.col("mean_delta")) / (F.col("n") - 1)) / F.sqrt("n")
    long = table.filter(F.col("n") > sf.DRAWN).select(*keys, F.when(F.col("_squares") > 0, _limit("_total", "_squares")).alias("p"), (F.col("mean_delta") - half).alias("low"), (F.col("mean_delta") + half).alias("high"))
    return got.unionByName(long)


def stored_tests(pairs: DataFrame, keys: list[str], folder: str, permutations: int = sf.PERMUTATIONS, seed: int = sf.SEED) -> DataFrame:
    """keys, p, low, high and stored: tests() of every pair, kept in a table at ``folder`` under a hash of the deltas and settings (SK-6).

    The hash is a sum over the pair's items, so no pair is gathered for it. What the table has is read, the rest is computed and appended.
    """
    spark = pairs.sparkSession
    pairs = durable_table(pairs.select(*keys, "item_id", "a", "b", "delta"))
    table = delta_table(pairs, keys)
    item = F.xxhash64("item_id", "delta")
    mark = pairs.groupBy(*keys).agg(F.sum(item.cast("decimal(38,0)")).cast("string").alias("h1"), F.sum(F.xxhash64("item_id", "delta", F.lit(1)).cast("decimal(38,0)")).cast("string").alias("h2"))
    key = F.sha2(F.concat_ws("|", F.lit(f"sign-flip {permutations} {seed} {sf.EXACT} {sf.DRAWN}"), "h1", "h2"), 256)
    wanted = durable_table(table.join(mark, keys).withColumn("key", key))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = "key string, p double, low double, high double"
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    old = durable_table(spark.read.schema(schema).parquet(folder).dropDuplicates(["key"])) if there else spark.createDataFrame([], schema)
    missing = wanted.join(old, "key", "left_anti")
    new = durable_table(missing.select(*keys, "key").join(tests(pairs, keys, missing, permutations=permutations, seed=seed), keys).select("key", "p", "low", "high").dropDuplicates(["key"]))
    new.write.mode("append").parquet(folder)
    known = old.withColumn("stored", F.lit(True)).unionByName(new.withColumn("stored", F.lit(False)))
    return wanted.select(*keys, "key").join(known, "key").select(*keys, "p", "low", "high", "stored")


def verdict(n: Column, p: Column, significant: Column, delta: Column, higher_is_better: bool = True, neutral: bool = False) -> Column:
    up, down = ("higher", "lower") if neutral else ("better", "worse") if higher_is_better else ("worse", "better")
    return (F.when(p.isNull() & (n < 2), "untestable").when(p.isNull(), "identical").when(~significant, "not significant")
            .when(delta > 0, f"significant: {up}").otherwise(f"significant: {down}"))


def compare(series: DataFrame, baseline: str, higher_is_better: bool = True, neutral: bool = False, family: int | None = None, groups: DataFrame | None = None,
            intervals: bool = True, joint: bool = False) -> DataFrame:
    """Every arm against the baseline of its dataset (ST-8): n, means, delta, wins, losses, ties, least p, p, interval, Holm threshold, verdict.

    ``groups`` (item_id, grp) breaks the items up; with ``joint`` one correction covers all of a dataset's
    groups and arms (ST-9). All pairs come from one join, all tests from one grouped pass; the pairs are written once, as
    their sums, their tests and the choice between these read them.
    """
    pairs = paired(series, baseline)
    keys = ["dataset_id", "config_id"]
    if groups is not None:
        pairs, keys = pairs.join(groups, "item_id"), ["dataset_id", "grp", "config_id"]
    pairs = durable_table(pairs.select(*keys, "item_id", "a", "b", "delta"))
    table = durable_table(delta_table(pairs, keys, higher_is_better))
    x = table.join(tests(pairs, keys, table, intervals), keys)
    x = holm(x, "p", ["dataset_id"] if joint or groups is None else ["dataset_id", "grp"], [k for k in keys if k != "dataset_id"], family=family)
    least = F.pow(F.lit(2.0), 1 - F.col("n"))
    return x.select(
        *keys, "n", F.round("mean", 9).alias("mean"), F.round("baseline_mean", 9).alias("baseline_mean"), F.round("mean_delta", 9).alias("delta"), "wins", "losses", "ties",
        least.alias("least_p"), "p", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "threshold", "p_holm",
        verdict(F.col("n"), F.col("p"), F.col("significant"), F.col("mean_delta"), higher_is_better, neutral).alias("verdict"))


def family_test(series: DataFrame, arm: str, permutations: int = sf.PERMUTATIONS, seed: int = sf.SEED, least_items: int = 3) -> DataFrame:
    """One arm against a family of opponents whose draws come from one stream, in the opponents' order (ST-11).

    One task a dataset runs through its stream and notes the state at which each opponent begins; each opponent is then a task of
    its own, or several. Opponents of more than DRAWN items take the limit from their sums; Holm's family has both.
    """
    keys = ["dataset_id", "config_id"]
    pairs = durable_table(paired(series, arm).select(*keys, "item_id", "a", "b", "delta"))
    n = durable_table(delta_table(pairs, keys).filter(F.col("n") >= least_items))

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, stream = pdf.sort_values("config_id"), sf.Signs(seed)
        out, ahead = [], 0
        for items in pdf["n"].tolist():
            if items > sf.EXACT:
                stream.skip(ahead)
                ahead = items * permutations
            out.append(stream.state())
        return pdf.assign(state=out)

    plan = n.filter(F.col("n") <= sf.DRAWN).select(*keys, "n").groupBy("dataset_id").applyInPandas(states, "dataset_id string, config_id string, n long, state binary")
    got = n.join(_sampled(pairs, keys, plan, permutations, seed, False), keys).select(*keys, "n", (-F.col("mean_delta")).alias("delta"), "p")
    long = n.filter(F.col("n") > sf.DRAWN).select(*keys, "n", (-F.col("mean_delta")).alias("delta"), _limit("_total", "_squares").alias("p"))
    return holm(got.unionByName(long), "p", ["dataset_id"], ["config_id"])


class _Cells:
    """Counts of items by cell of labels (gold, a, b), as codes: what a corpus metric of both arms needs of a sample."""

    def __init__(self, gold: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, metric: str) -> None:
        self.gold, self.arms, self.k, self.metric = gold, (a, b), k, metric

    def score(self, x: np.ndarray, c: np.ndarray) -> float:
        hit = self.gold == x
        if self.metric != "macro_f1":
            return float(c[hit].sum() / c.sum())
        tp = np.bincount(self.gold[hit], c[hit], self.k)
        den = np.bincount(self.gold, c, self.k) + np.bincount(x[x < self.k], c[x < self.k], self.k)
        return float(np.where(den > 0, 2 * tp / np.maximum(den, 1), 0.0).mean())

    def delta(self, c: np.ndarray) -> float:
        return self.score(self.arms[0], c) - self.score(self.arms[1], c)


def _picks(rng: random.Random, n: int, count: int) -> np.ndarray:
    """The next ``count`` values of ``rng.randrange(n)``, n under 2^32, from words of the stream; words that it draws again are passed over."""
    k, got, left = n.bit_length(), [], count
    while left:
        # Each value takes one word at least, so no more than are needed are drawn.
        words = np.frombuffer(rng.getrandbits(32 * left).to_bytes(4 * left, "little"), dtype="<u4") >> (32 - k)
        got.append(words[words < n])
        left -= len(got[-1])
    return np.concatenate(got)


def bootstrap(pairs: DataFrame, metric: str = "macro_f1", draws: int = 5000, seed: int = 7, least_items: int = 10) -> DataFrame:
    """Paired bootstrap of a corpus metric (ST-12): ``pairs`` has opponent, item_id, gold, a and b (the two arms' labels).

    One resample serves both arms. Those with under ``least_items`` are left out, and gold that reads as free text
    (labels for more than half the items) is refused. Opponents of at most DRAWN items follow each other on one
    stream of item draws, in order of name. Longer ones are not gathered: their items are counted by cell of labels,
    and resamples are drawn of the counts, which is the same distribution from a generator of their own.
    """
    sizes = pairs.groupBy("opponent").agg(F.count("*").alias("n"), F.countDistinct("gold").alias("labels"))
    worst = sizes.agg(F.max("n").alias("n"), F.max(F.col("labels") / F.col("n")).alias("share")).first()
    if (worst["n"] or 0) >= 4 and (worst["share"] or 0) > 0.5:
        raise ValueError("the gold labels read as free text")
    names = sorted(r[0] for r in pairs.select("gold").distinct().collect())
    code = {x: i for i, x in enumerate(names)}
    k = len(names)

    def coded(g: pd.DataFrame) -> list[np.ndarray]:
        return [g[c].map(lambda x: code.get(x, k)).to_numpy(int) for c in ("gold", "a", "b")]

    def row(name: str, n: int, cells: _Cells, whole: np.ndarray, samples) -> tuple:
        ds = np.sort([cells.delta(c) for c in samples])
        below = float((ds <= 0).mean())
        return name, n, cells.delta(whole), float(ds[int(0.025 * draws)]), float(ds[min(int(0.975 * draws), draws - 1)]), max(2 * min(below, 1 - below), 1 / draws)

    cols = ["opponent", "n", "delta", "low", "high", "p"]

    def stream(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, rows = random.Random(seed), []
        for name, g in pdf.groupby("opponent", sort=True):
            kinds, at = np.unique(np.stack(coded(g.sort_values("item_id"))), axis=1, return_inverse=True)
            n, at, size = len(g), at.ravel(), kinds.shape[1]
            samples = (np.bincount(at[_picks(rng, n, n)], minlength=size).astype(float) for _ in range(draws))
            rows.append(row(name, n, _Cells(*kinds, k, metric), np.bincount(at, minlength=size).astype(float), samples))
        return pd.DataFrame(rows, columns=cols)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds, at = np.unique(np.stack(coded(pdf)), axis=1, return_inverse=True)
        c = np.bincount(at.ravel(), pdf["items"])
        name, n = pdf["opponent"].iloc[0], int(c.sum())
        rng = np.random.default_rng([seed, *name.encode()])
        samples = (rng.multinomial(n, c / n).astype(float) for _ in range(draws))
        return pd.DataFrame([row(name, n, _Cells(*kinds, k, metric), c, samples)], columns=cols)

    schema = "opponent string, n long, delta double, low double, high double, p double"
    short = sizes.filter((F.col("n") >= least_items) & (F.col("n") <= sf.DRAWN)).select("opponent")
    long = sizes.filter((F.col("n") >= least_items) & (F.col("n") > sf.DRAWN)).select("opponent")
    got = pairs.join(short, "opponent", "left_semi").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(stream, schema)
    # A label that no gold has counts for none, so that free texts of an arm fall into one cell.
    known = lambda c: F.when(F.col(c).isin(names), F.col(c)).alias(c)
    cells = pairs.join(long, "opponent", "left_semi").groupBy("opponent", "gold", known("a"), known("b")).agg(F.count("*").alias("items"))
    got = got.unionByName(cells.groupBy("opponent").applyInPandas(counted, schema))
    return holm(got.withColumn("one", F.lit(1)), "p", ["one"], ["opponent"]).drop("one")


def agreement_with_hypothesis(direction: Column, delta: Column, lower: Column, significant: Column) -> Column:
    """Whether a result agrees with what was expected: better, worse or no worse (ST-47)."""
    gain = F.when(lower, -delta).otherwise(delta)
    return (F.when(direction == "better", F.when(significant & (gain > 0), "agrees").when(significant & (gain < 0), "contradicts").otherwise("open"))
            .when(direction == "worse", F.when(significant & (gain < 0), "agrees").when(significant & (gain > 0), "contradicts").otherwise("open"))
            .when(direction == "no worse", F.when(significant & (gain < 0), "contradicts").otherwise("agrees")))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; k may be fractional (ST-26)."""
    p, zz = k / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.round(F.greatest(F.lit(0.0), mid - half), 4), F.round(F.least(F.lit(1.0), mid + half), 4)


def proportion(hits: Column, n: Column) -> tuple[Column, Column]:
    """Share and half-width of its normal interval (ST-27)."""
    p = hits / n
    return p, 1.96 * F.sqrt(p * (1 - p) / n)


def fisher(r: Column, n: Column) -> tuple[Column, Column]:
    """Interval of a correlation (ST-50)."""
    return F.tanh(F.atanh(r) - 1.96 / F.sqrt(n - 3)), F.tanh(F.atanh(r) + 1.96 / F.sqrt(n - 3))


def r_p_value(r: float, n: int) -> float | None:
    """Two-sided p of a Pearson r from Student's t with n - 2 degrees of freedom, by the incomplete beta's continued fraction (ST-51)."""
    if n < 3 or r is None or math.isnan(r):
        return None
    x = 1 - min(r * r, 1.0)
    a, b = (n - 2) / 2, 0.5
    if x in (0.0, 1.0):
        return float(x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front / b * _fraction(b, a, 1 - x)
    return front / a * _fraction(a, b, x)


def _fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h
