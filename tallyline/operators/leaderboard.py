"""Rank tests over all arms of a dataset, their stability, and frontiers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import durable_table
from .joins import shared_by_all
from .ranks import TOLERANCE

#: Cells of arms and items that a task shuffles and resamples; a dataset's items are dealt to as many tasks as that takes.
TASK_CELLS = 4_000
#: A dataset of at most this many cells is packed into one row for split-half draws; of larger ones the drawn items are joined.
CELLS = 5_000_000


def nemenyi_q(k: int, alpha: float = 0.05) -> float | None:
    """Critical value of the studentised range over sqrt(2) with infinite degrees of freedom, for 2 to 40 arms (ST-14): bisection on the range's distribution, integrated by Simpson's rule."""
    if not 2 <= k <= 40:
        return None
    x = np.linspace(-8, 8, 2001)
    pdf = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))
    w = np.ones(len(x))
    w[1:-1:2], w[2:-1:2] = 4, 2
    w *= (x[1] - x[0]) / 3
    erf = np.vectorize(math.erf)

    def below(q: float) -> float:
        return float(k * (w * pdf * (cdf - 0.5 * (1 + erf((x - q) / math.sqrt(2)))) ** (k - 1)).sum())

    lo, hi = 0.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < 1 - alpha else (lo, mid)
    return (lo + hi) / 2 / math.sqrt(2)


def ranks_of(rows: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Midranks along the last axis, smallest first; a value ties with its group's first within the tolerance. All rows go together, column by column."""
    order = np.argsort(rows, axis=-1, kind="stable")
    v = np.take_along_axis(rows, order, -1)
    k = v.shape[-1]
    first, last = np.zeros(v.shape), np.zeros(v.shape)
    for c in range(1, k):
        head = np.take_along_axis(v, first[..., [c - 1]].astype(int), -1)[..., 0]
        first[..., c] = np.where(v[..., c] - head > tolerance, c, first[..., c - 1])
    last[..., k - 1] = k - 1
    for c in range(k - 2, -1, -1):
        last[..., c] = np.where(first[..., c + 1] == first[..., c], last[..., c + 1], c)
    out = np.empty(v.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, -1)
    return out


def _grid(series: DataFrame, by: str) -> DataFrame:
    """The cells of the items that all arms share, written once."""
    return durable_table(series.select(by, "config_id", "item_id", "value").join(shared_by_all(series), [by, "item_id"], "left_semi"))


def _packed(m: pd.DataFrame) -> bytes:
    return np.ascontiguousarray(m.to_numpy(float)).tobytes()


def significance(series: DataFrame, ascending: bool = False, seed: int = 20260925, shuffles: int = 5000, resamples: int = 2000) -> DataFrame:
    """Friedman by permutation, Nemenyi difference and rank probabilities of each dataset (ST-13 to ST-15).

    One row for each arm: k, n_items, p (of an arm effect), critical_difference, avg_rank, p_first (alone), p_top and
    p_bottom over resampled items. Datasets with under two arms or three shared items are absent. Any number of items:
    they are dealt to tasks that shuffle and resample their share and return sums by arm, which add up. Shuffles and
    resamples use numpy's seeded generator; how often a resample takes items of a task's share is drawn alike by all tasks.
    """
    grid = _grid(series, "dataset_id")
    size = grid.groupBy("dataset_id").agg(F.countDistinct("config_id").alias("k"), F.countDistinct("item_id").alias("n")).filter("k >= 2 AND n >= 3")
    size = size.select("dataset_id", "n", F.ceil(F.col("k") * F.col("n") / TASK_CELLS).cast("int").alias("parts"))
    x = grid.join(size, "dataset_id").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    shares = x.groupBy("dataset_id", "part").agg(F.countDistinct("item_id").alias("m")).groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("shares"))
    x = x.join(shares, "dataset_id").select("dataset_id", "config_id", "item_id", "value", "n", "part", F.col("shares.part").alias("which"), F.col("shares.m").alias("many"))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="item_id", columns="config_id", values="value").sort_index()
        v = m.to_numpy(float) * (1 if ascending else -1)
        r = ranks_of(v)
        part, (here, k) = int(pdf["part"].iloc[0]), v.shape
        rng = np.random.default_rng([seed, part])
        step, shuffled = max(1, 2_000_000 // v.size), []
        for i in range(0, shuffles, step):
            shuffled.append(rng.permuted(np.broadcast_to(r, (min(step, shuffles - i), here, k)), axis=-1).sum(1))
        n, which, many = int(pdf["n"].iloc[0]), list(pdf["which"].iloc[0]), np.asarray(pdf["many"].iloc[0], dtype=float)
        taken = np.random.default_rng(seed).multinomial(n, many / n, resamples)[:, which.index(part)]
        means = rng.multinomial(taken, np.full(here, 1 / here)) @ v / n
        return pd.DataFrame([[pdf["dataset_id"].iloc[0], part, n, list(m.columns), _packed(pd.DataFrame(np.vstack([r.sum(0)[None, :], *shuffled, means])))]], columns=["dataset_id", "part", "n", "arms", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["sums"])
        return pd.DataFrame([[*pdf.iloc[0][["dataset_id", "part", "n", "arms"]], total.tobytes()]], columns=["dataset_id", "part", "n", "arms", "sums"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        arms, n = list(pdf["arms"].iloc[0]), int(pdf["n"].iloc[0])
        k = len(arms)
        sums = sum(np.frombuffer(b) for b in pdf["sums"]).reshape(-1, k)
        avg, shuffled, place = sums[0] / n, sums[1 : shuffles + 1] / n, ranks_of(sums[shuffles + 1 :])
        hits = int(((shuffled**2).sum(1) >= (avg**2).sum() - 1e-12).sum())
        q = nemenyi_q(k)
        top = max(1, min(5, k // 4))  # fixed value: how many places count as top and bottom
        return pd.DataFrame({
            "dataset_id": pdf["dataset_id"].iloc[0], "config_id": arms, "k": k, "n_items": n, "p": (hits + 1) / (shuffles + 1), "critical_difference": q * math.sqrt(k * (k + 1) / (6 * n)) if q else None, "avg_rank": avg,
            "p_first": (place == 1).mean(0), "p_top": (place <= top).mean(0), "p_bottom": (place > k - top).mean(0),
        })

    partial = "dataset_id string, part int, n long, arms array<string>, sums binary"
    got = x.groupBy("dataset_id", "part").applyInPandas(share, partial)
    got = got.groupBy("dataset_id", F.pmod("part", F.lit(32))).applyInPandas(lambda key, pdf: added(pdf), partial)
    return got.groupBy("dataset_id").applyInPandas(whole, "dataset_id string, config_id string, k int, n_items int, p double, critical_difference double, avg_rank double, p_first double, p_top double, p_bottom double")


def distinguishable(avg_ranks: DataFrame) -> DataFrame:
    """Pairs of arms further apart than the critical difference, the better first (ST-14); arms are few, so they are joined by dataset."""
    a = avg_ranks.select("dataset_id", F.col("config_id").alias("better"), F.col("avg_rank").alias("ra"), F.col("critical_difference").alias("cd"))
    b = avg_ranks.select("dataset_id", F.col("config_id").alias("worse"), F.col("avg_rank").alias("rb"))
    return a.join(b, "dataset_id").filter(F.col("rb") - F.col("ra") > F.col("cd")).select("dataset_id", "better", "worse", (F.col("rb") - F.col("ra")).alias("gap"))


def _halves(n: int, size: int, draws: int, seed: int) -> np.ndarray:
    """draws x 2 x size item numbers of 0..n-1: two halves without a common item for each draw."""
    rng = np.random.default_rng([seed, size, n])
    return np.stack([rng.choice(n, 2 * size, replace=False) for _ in range(draws)]).reshape(draws, 2, size)


def _agreement(means: np.ndarray, full: np.ndarray) -> tuple:
    """What the halves' means (draws x 2 x arms) say: rho, rho_low, p_same_winner, rank_move, tied_first, undecided."""
    means = np.round(means, 12)
    ranks = ranks_of(means, 0.0)
    dev = ranks - ranks.mean(-1, keepdims=True)
    spread = np.sqrt((dev**2).sum(-1))
    has = (spread > 0).all(1)
    rho = np.sort((dev[has, 0] * dev[has, 1]).sum(-1) / spread[has].prod(1))
    best = ranks == ranks.min(-1, keepdims=True)
    one = (best.sum(-1) == 1).all(1)
    same = best[one].argmax(-1)
    low = float(rho[int(0.05 * len(rho))]) if len(rho) else None
    tied = (means[:, 0] == means[:, 0].min(-1, keepdims=True)).sum(-1)
    return (float(rho.mean()) if len(rho) else None, low, float((same[:, 0] == same[:, 1]).mean()) if len(same) else None,
            float(np.median(np.abs(ranks[:, 0] - full), axis=-1).mean()), float(tied.mean()), int((~one).sum()))


def stability(series: DataFrame, sizes: tuple[int, ...] = (10, 20, 50, 100), draws: int = 400, seed: int = 20260926, ascending: bool = False, cells: int = CELLS) -> DataFrame:
    """Split-half stability of the ranking (ST-21, ST-22): for each size two disjoint halves, drawn ``draws`` times.

    Columns: rho (mean Spearman), rho_low (5th percentile), p_same_winner (of draws with one winner in both halves),
    rank_move (mean over draws of the median move against the full ranking), tied_first, undecided. Sizes of which a
    dataset does not hold two are absent, as are datasets of under three arms. Each size is a task. A dataset above ``cells``
    is not gathered: the drawn items are joined to their values and averaged by draw, half and arm; the draws are the same.
    """
    sign = 1 if ascending else -1
    grid = _grid(series, "dataset_id")
    counts = grid.groupBy("dataset_id").agg(F.count("*").alias("cells"), F.countDistinct("item_id").alias("n"), F.countDistinct("config_id").alias("k")).filter("k >= 3")
    counts = counts.filter(F.col("n") >= 2 * min(sizes))
    fits = F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda s: 2 * s <= F.col("n"))).alias("size")
    schema = "dataset_id string, size int, rho double, rho_low double, p_same_winner double, rank_move double, tied_first double, undecided int"
    cols = ["dataset_id", "size", "rho", "rho_low", "p_same_winner", "rank_move", "tied_first", "undecided"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="item_id", columns="config_id", values="value").sort_index()
        return pd.DataFrame([[pdf["dataset_id"].iloc[0], len(m), m.shape[1], _packed(m)]], columns=["dataset_id", "n", "k", "packed"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        d, n, k, packed, size = pdf.iloc[0][["dataset_id", "n", "k", "packed", "size"]]
        v = np.frombuffer(packed).reshape(n, k) * sign
        return pd.DataFrame([[d, size, *_agreement(v[_halves(int(n), int(size), draws, seed)].mean(2), ranks_of(v.mean(0), 0.0))]], columns=cols)

    small = grid.join(counts.filter(F.col("cells") <= cells).select("dataset_id"), "dataset_id", "left_semi")
    packs = small.groupBy("dataset_id").applyInPandas(pack, "dataset_id string, n int, k int, packed binary")
    got = packs.select("*", fits).groupBy("dataset_id", "size").applyInPandas(inside, schema)

    def numbers(pdf: pd.DataFrame) -> pd.DataFrame:
        d, n, size = pdf.iloc[0][["dataset_id", "n", "size"]]
        at = _halves(int(n), int(size), draws, seed)
        draw, half, _ = np.indices(at.shape)
        return pd.DataFrame({"dataset_id": d, "size": size, "draw": draw.ravel(), "half": half.ravel(), "at": at.ravel()})

    def outside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "half", "config_id"])
        k = pdf["config_id"].nunique()
        full = pdf["full"].to_numpy(float)[:k] * sign
        return pd.DataFrame([[pdf["dataset_id"].iloc[0], pdf["size"].iloc[0], *_agreement(pdf["mu"].to_numpy(float).reshape(draws, 2, k) * sign, ranks_of(full, 0.0))]], columns=cols)

    large = counts.filter(F.col("cells") > cells).select("dataset_id", "n")
    picks = large.select("dataset_id", "n", fits).groupBy("dataset_id", "size").applyInPandas(numbers, "dataset_id string, size int, draw int, half int, at int")
    big = grid.join(large, "dataset_id", "left_semi")
    items = big.select("dataset_id", "item_id").distinct().withColumn("at", F.row_number().over(Window.partitionBy("dataset_id").orderBy("item_id")) - 1)
    drawn = picks.join(items, ["dataset_id", "at"]).join(big, ["dataset_id", "item_id"]).groupBy("dataset_id", "size", "draw", "half", "config_id").agg(F.avg("value").alias("mu"))
    means = big.groupBy("dataset_id", "config_id").agg(F.avg("value").alias("full"))
    return got.unionByName(drawn.join(means, ["dataset_id", "config_id"]).groupBy("dataset_id", "size").applyInPandas(outside, schema))


def frontier(points: DataFrame, by: list[str], arm: str, up: list[str], down: list[str]) -> DataFrame:
    """Each arm with its best dominator, or null on the frontier (ST-18, ST-19, JN-11).

    An arm is dominated by one that is at least as good on every axis and better on one; rows with a missing axis are
    left out. Arms of one group are few (tens); they meet by group key. The dominator named is the best by the first
    axis among those on the frontier, then by name.
    """
    axes = [*up, *down]
    p = points.select(*by, arm, *axes).dropna(subset=axes)
    a = p.select(*by, F.col(arm).alias("_a"), *(F.col(x).alias(f"_a_{x}") for x in axes))
    b = p.select(*by, F.col(arm).alias("_b"), *(F.col(x).alias(f"_b_{x}") for x in axes))
    ok, better = F.col("_a") != F.col("_b"), F.lit(False)
    for x in up:
        ok &= F.col(f"_b_{x}") >= F.col(f"_a_{x}")
        better |= F.col(f"_b_{x}") > F.col(f"_a_{x}")
    for x in down:
        ok &= F.col(f"_b_{x}") <= F.col(f"_a_{x}")
        better |= F.col(f"_b_{x}") < F.col(f"_a_{x}")
    pairs = a.join(b, by).filter(ok & better)
    beaten = pairs.select(*by, F.col("_a").alias(arm)).distinct()
    front = p.join(beaten, [*by, arm], "left_anti").select(*by, F.col(arm).alias("_b"))
    first = axes[0]
    order = F.struct((-F.col(f"_b_{first}") if first in up else F.col(f"_b_{first}")).alias("v"), F.col("_b").alias("n"))
    best = pairs.join(front, [*by, "_b"], "left_semi").groupBy(*by, F.col("_a").alias(arm)).agg(F.min(order).getField("n").alias("dominated_by"))
    return p.join(best, [*by, arm], "left")


def percentile_rank(df: DataFrame, by: list[str], value: str, tied: float = 0.5) -> DataFrame:
    """(number below + tied x number equal besides itself) / n others (ST-52)."""
    w = Window.partitionBy(*by)
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1
    n = F.count(F.lit(1)).over(w) - 1
    return df.withColumn("pct_rank", F.try_divide(below + tied * equal, n))
