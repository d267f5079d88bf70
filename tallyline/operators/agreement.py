"""Agreement of judges and label sets, and strengths from comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable_table


def kendall_tau_b(xs: Column, ys: Column) -> Column:
    """Tau-b of two arrays of equal length, 0 if either is constant (ST-25, JN-12). For short arrays: it forms all pairs of one row."""
    n = F.size(xs)
    idx = F.sequence(F.lit(0), n - 1)

    def over(i: Column) -> Column:
        def add(acc: Column, j: Column) -> Column:
            dx, dy = F.signum(F.get(xs, i) - F.get(xs, j)), F.signum(F.get(ys, i) - F.get(ys, j))
            use = (j > i).cast("double")
            return F.struct((acc["c"] + use * dx * dy).alias("c"), (acc["x"] + use * dx * dx).alias("x"), (acc["y"] + use * dy * dy).alias("y"))

        return F.aggregate(idx, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), add)

    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    tot = F.aggregate(F.transform(idx, over), zero, lambda a, b: F.struct((a["c"] + b["c"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    return F.when((n < 2) | (tot["x"] == 0) | (tot["y"] == 0), 0.0).otherwise(tot["c"] / F.sqrt(tot["x"] * tot["y"]))


def kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """n, same and Cohen's kappa of two labels (ST-28); null where chance agreement is 1."""
    cells = pairs.groupBy(*by, a, b).agg(F.count("*").alias("c"))
    tot = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    pa = cells.groupBy(*by, F.col(a).alias("v")).agg(F.sum("c").alias("na"))
    pb = cells.groupBy(*by, F.col(b).alias("v")).agg(F.sum("c").alias("nb"))
    pe = pa.join(pb, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    x = tot.join(pe, by, "left")
    po, chance = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    return x.select(*by, "n", "same", F.when(chance < 1, F.round((po - chance) / (1 - chance), 4)).alias("kappa"))


def masi(a: Column, b: Column) -> Column:
    """MASI distance of two answer sets given as sorted distinct arrays."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    nested = (shared == F.size(a)) | (shared == F.size(b))
    return F.when(a == b, 0.0).when(shared == 0, 1.0).otherwise(1 - shared / union * F.when(nested, F.lit(2 / 3)).otherwise(F.lit(1 / 3)))


def alpha(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", several: bool = False) -> DataFrame:
    """Krippendorff's alpha of two labels for each item (ST-29): nominal, or with MASI distance over answer sets (arrays).

    Values are counted first; the expected distance pairs the distinct values, which are few for categories.
    """
    dist = masi if several else (lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    obs = pairs.groupBy(*by, a, b).agg(F.count("*").alias("c"))
    observed = obs.groupBy(*by).agg((F.sum(dist(F.col(a), F.col(b)) * F.col("c")) / F.sum("c")).alias("observed"))
    v = pairs.select(*by, F.explode(F.array(F.col(a), F.col(b))).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("c"))
    m = v.groupBy(*by).agg(F.sum("c").alias("m"))
    two = v.join(v.select(*by, F.col("v").alias("w"), F.col("c").alias("k")), by)
    expected = two.groupBy(*by).agg(F.sum(dist(F.col("v"), F.col("w")) * F.col("c") * F.col("k")).alias("e"))
    x = observed.join(m, by).join(expected, by)
    e = F.col("e") / (F.col("m") * (F.col("m") - 1))
    return x.select(*by, F.when(e > 0, F.round(1 - F.col("observed") / e, 4)).alias("alpha"))


def are_categories(labels: DataFrame, label: str, most: int = 50, chars: int = 40, words: int = 3) -> DataFrame:
    """Whether labels are categories or free text (ST-30)."""
    x = labels.select(F.col(label).alias("v")).filter("v IS NOT NULL").distinct()
    ok = F.every((F.length("v") <= chars) & ~F.col("v").contains("\n") & (F.size(F.split("v", r"\s+")) <= words))
    return x.agg(F.count("*").alias("n_labels"), F.coalesce((F.count("*") <= most) & ok, F.lit(True)).alias("categories"))


#: Weights (resamples x pairs of arms) that one task works on at a time.
RESAMPLED_CELLS = 4_000_000


def bt_strengths(i: np.ndarray, j: np.ndarray, wins: np.ndarray, losses: np.ndarray, n: int, prior: float = 0.5, start: np.ndarray | None = None, tolerance: float = 1e-9, rounds: int = 5000) -> np.ndarray:
    """Bradley-Terry strengths by minorisation (Hunter 2004), with a virtual draw of weight ``prior`` in every pair; geometric mean 1 (ST-31).

    Pairs are arms i and j of 0..n-1; ``wins`` of i over j and ``losses`` may hold one row for each of many samples, which are
    fitted together. The virtual draws are summed over all arms by columns, so memory grows with arms and pairs, not with their square.
    """
    wins, losses = np.atleast_2d(wins), np.atleast_2d(losses)
    samples, met = wins.shape[0], wins + losses
    one = np.arange(samples)[:, None] * n
    at_i, at_j = (one + i).ravel(), (one + j).ravel()

    def by_arm(for_i: np.ndarray, for_j: np.ndarray) -> np.ndarray:
        return (np.bincount(at_i, for_i.ravel(), samples * n) + np.bincount(at_j, for_j.ravel(), samples * n)).reshape(samples, n)

    won = by_arm(wins, losses) + (n - 1) * prior / 2
    p = np.ones((samples, n)) if start is None else np.broadcast_to(start, (samples, n)).copy()
    todo = np.ones(samples, dtype=bool)
    for _ in range(rounds):
        shared = met / (p[:, i] + p[:, j])
        if samples * n * n <= RESAMPLED_CELLS:
            drawn = (prior / (p[:, :, None] + p[:, None, :])).sum(2) - prior / (2 * p)
        else:
            drawn = np.stack([(prior / (p + p[:, [k]])).sum(1) for k in range(n)], 1) - prior / (2 * p)
        new = won / (by_arm(shared, shared) + drawn)
        new /= np.exp(np.log(new).mean(1, keepdims=True))
        still = np.abs(new / p - 1).max(1) >= tolerance
        p = np.where(todo[:, None], new, p)
        todo &= still
        if not todo.any():
            break
    return p


def _refitted(i: np.ndarray, j: np.ndarray, wins: np.ndarray, losses: np.ndarray, n: int, start: np.ndarray, prior: float = 0.5, tolerance: float = 1e-7, rounds: int = 50) -> np.ndarray:
    """The strengths of bt_strengths for many samples near ``start``, by Newton steps on their logarithms: the likelihood with its virtual draws is concave."""
    samples = len(wins)
    games = np.full((samples, n, n), prior)
    games[:, i, j] += wins + losses
    games[:, j, i] += wins + losses
    games[:, np.arange(n), np.arange(n)] = 0
    won = np.full((samples, n), (n - 1) * prior / 2)
    np.add.at(won, (slice(None), i), wins)
    np.add.at(won, (slice(None), j), losses)
    t = np.broadcast_to(np.log(start), (samples, n)).copy()
    for _ in range(rounds):
        share = 1 / (1 + np.exp(t[:, None, :] - t[:, :, None]))  # how likely the row beats the column
        slope = won - (games * share).sum(2)
        w = games * share * (1 - share)
        bend = -w
        bend[:, np.arange(n), np.arange(n)] = w.sum(2)
        step = np.linalg.solve(bend + 1 / n, slope[..., None])[..., 0]  # the mean is free, the constant holds it
        t += np.clip(step, -1, 1)
        if np.abs(step).max() < tolerance:
            break
    return np.exp(t - t.mean(1, keepdims=True))


#: Arms up to which resamples are refitted with full matrices; more are refitted by minorisation, pair by pair.
MATRIX_ARMS = 300


def bradley_terry(comparisons: DataFrame, by: str, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """Strength with a 95 % interval over resampled items for each arm of a set (ST-31).

    ``comparisons``: ``by``, item_id, a, b, wa, wb (a tie is half for each). They are folded by item and pair first. The
    resamples of a set are dealt to as many tasks as their weights need; each starts from the fit to all items.
    """
    x = comparisons.groupBy(by, "item_id", "a", "b").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    rows = x.groupBy(by).agg(F.count("*").alias("_rows"))
    parts = F.least(F.lit(resamples), F.ceil(F.col("_rows") * resamples / F.lit(10 * RESAMPLED_CELLS))).cast("int")
    dealt = x.join(rows.select(by, parts.alias("_parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")), by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.r_[pdf["a"].to_numpy(str), pdf["b"].to_numpy(str)], return_inverse=True)
        a, b = codes[: len(pdf)], codes[len(pdf) :]
        n = len(names)
        pair, cell = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
        i, j = pair // n, pair % n
        item = np.unique(pdf["item_id"].to_numpy(str), return_inverse=True)[1]
        wa, wb = pdf["wa"].to_numpy(float), pdf["wb"].to_numpy(float)
        up, down = np.where(a < b, wa, wb), np.where(a < b, wb, wa)
        full = bt_strengths(i, j, np.bincount(cell, up, len(pair)), np.bincount(cell, down, len(pair)), n)[0]
        part, parts = int(pdf["_part"].iloc[0]), int(pdf["_parts"].iloc[0])
        rng, items = np.random.default_rng([seed, part]), int(item.max()) + 1
        count = resamples // parts + (part < resamples % parts)
        dense = n <= MATRIX_ARMS
        step = max(1, RESAMPLED_CELLS // max(items, len(pair), n * n if dense else n))
        reps = []
        for begin in range(0, count, step):
            size = min(step, count - begin)
            times = rng.multinomial(items, np.full(items, 1 / items), size)
            if items * len(pair) <= RESAMPLED_CELLS:
                won, lost = np.zeros((items, len(pair))), np.zeros((items, len(pair)))
                np.add.at(won, (item, cell), up)
                np.add.at(lost, (item, cell), down)
                wins, losses = times @ won, times @ lost
            else:
                wins, losses = np.empty((size, len(pair))), np.empty((size, len(pair)))
                for r in range(size):
                    t = times[r][item]
                    wins[r], losses[r] = np.bincount(cell, up * t, len(pair)), np.bincount(cell, down * t, len(pair))
            reps.append(_refitted(i, j, wins, losses, n, full) if dense else bt_strengths(i, j, wins, losses, n, start=full, tolerance=1e-7))
        all_ = np.concatenate(reps)
        low, high = np.quantile(all_, [0.025, 0.975], axis=0)
        # The resamples of a set that is one task need not travel.
        return pd.DataFrame({by: pdf[by].iloc[0], "arm": names, "strength": full, "low": low, "high": high, "reps": list(all_.T) if parts > 1 else None})

    got = dealt.groupBy(by, "_part").applyInPandas(one, f"{by} string, arm string, strength double, low double, high double, reps array<double>")

    @F.pandas_udf("low double, high double")
    def ends(reps: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([np.quantile(np.concatenate(list(r)), [0.025, 0.975]) for r in reps], columns=["low", "high"])

    got = durable_table(got)
    several = got.filter("reps IS NOT NULL").groupBy(by, "arm").agg(F.max("strength").alias("strength"), F.collect_list("reps").alias("reps")).withColumn("e", ends("reps"))
    arms = got.filter("reps IS NULL").select(by, "arm", "strength", "low", "high").unionByName(several.select(by, "arm", "strength", "e.low", "e.high"))
    return arms.select(by, "arm", *(F.round(c, 6).alias(c) for c in ("strength", "low", "high")))


def credit(picked: Column, reference: Column) -> Column:
    """|P and R| / (|P| |R|) of two pick sets (ST-34)."""
    return F.try_divide(F.size(F.array_intersect(picked, reference)), F.size(picked) * F.size(reference))
