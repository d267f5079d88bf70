"""Problem 3: one ranking from pairwise votes, by offence-defence scaling of the smoothed win matrix.

W[i, j] is how often i beat j (a tie is half a win for either). Offence and defence are the
row and column factors of a Sinkhorn scaling of W:

    offence[i] = sum_j W[i, j] / defence[j] / t[i]
    defence[j] = sum_i W[i, j] / offence[i] / t[j]

and strength = offence / defence. If i beats j with odds p[i] : p[j], then W is a diagonal matrix p
times a symmetric one, the scaling of a symmetric matrix is symmetric, and offence / defence comes
out as p whatever the schedule of comparisons was. The margins t are the votes each
contestant took part in, so that a seldom compared one does not weigh like the others.

Smoothing: every contestant also plays ``FIELD`` won and lost votes against a field of its own
set, which ties loose parts together, and ``SELF`` votes against itself, which gives the
matrix the total support that the iteration needs.

A judge who leans to the first or second place multiplies the odds of that side; votes are weighted
with the root of that factor, which takes it out of both directions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_table, durable, durable_table, joined

FIELD = 0.25
SELF = 0.25
#: The scaling ends when no log strength moves by more than this, whatever the size of a set; what has not ended by then is marked as not converged.
TOLERANCE = 1e-6
ITERATIONS = 10_000
#: Rows of counts that one task may hold for a set; sets with more are scaled by joins.
EDGES_IN_MEMORY = 400_000
SALTS = 16
#: Judges whose leanings are broadcast; one judge may have a third of all votes, so votes are not shuffled by judge below that.
JUDGES_IN_MEMORY = 20_000


def pair_counts(verdicts: DataFrame) -> DataFrame:
    """Votes folded to set_id, judge, a, b (a shown first), first, second, tie: partial counts, several rows a pair.

    ``better`` counts with blanks and case aside. Left out: values that are no vote, rows without two
    different run_ids, without set_id or verdict_id. Rows of one verdict_id and pair count once (of
    different votes the smallest). One shuffle: by set, pair and a salt from the verdict_id, so
    that rows of one verdict_id meet and a hot pair is split; both aggregations stay in its partitions.
    """
    v = verdicts.select(
        "verdict_id", "set_id", F.coalesce("judge", F.lit("")).alias("judge"), F.get("arm_ids", F.lit(0)).alias("a"), F.get("arm_ids", F.lit(1)).alias("b"),
        F.size("arm_ids").alias("n_arms"), F.lower(F.trim("better")).alias("vote"), F.pmod(F.xxhash64("verdict_id"), F.lit(SALTS)).alias("salt"),
    )
    v = v.filter(F.col("vote").isin("1", "2", "tie") & (F.col("n_arms") == 2) & (F.col("a") != F.col("b")) & F.col("set_id").isNotNull() & F.col("verdict_id").isNotNull())
    vote = F.when(F.col("vote") == "tie", 3).otherwise(F.col("vote").cast("int"))
    v = v.select("set_id", "a", "b", "salt", "judge", "verdict_id", vote.alias("vote")).repartition("set_id", "a", "b", "salt")
    once = v.groupBy("set_id", "a", "b", "salt", "judge", "verdict_id").agg(F.min("vote").alias("vote"))
    hits = lambda x: F.sum((F.col("vote") == x).cast("double"))
    return once.groupBy("set_id", "a", "b", "salt", "judge").agg(hits(1).alias("first"), hits(2).alias("second"), hits(3).alias("tie")).drop("salt")


def leanings(pairs: DataFrame) -> DataFrame:
    """judge, lean: the root of the odds that this judge prefers what is shown first."""
    return pairs.groupBy("judge").agg(F.sqrt((F.sum("first") + 5) / (F.sum("second") + 5)).alias("lean"))


def weighted(pairs: DataFrame) -> DataFrame:
    """set_id, a, b, wa, wb: wins of a and of b, ties halved, each judge's lean to a side taken out."""
    lean = leanings(pairs)
    known = lean.limit(JUDGES_IN_MEMORY + 1).collect()
    if len(known) <= JUDGES_IN_MEMORY:  # else by an ordinary join
        lean = F.broadcast(pairs.sparkSession.createDataFrame([(r["judge"], r["lean"]) for r in known], "judge string, lean double"))
    p = pairs.join(lean, "judge")
    return p.select("set_id", "a", "b", ((F.col("first") + F.col("tie") / 2) / F.col("lean")).alias("wa"), ((F.col("second") + F.col("tie") / 2) * F.col("lean")).alias("wb"))


def win_matrix(w: DataFrame) -> DataFrame:
    """set_id, i, j, w (i beat j) of weighted pairs."""
    both = w.select("set_id", F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.col("wa").alias("w")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), F.col("wb").alias("w")))).alias("e"))
    return both.groupBy("set_id", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum("e.w").alias("w"))


def scale(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
    """Log strengths of contestants 0..n-1 from wins w of i over j, with mean 0, and whether the scaling converged."""
    t = (np.bincount(i, w, n) + np.bincount(j, w, n)) / 2 + FIELD + SELF
    t_f = FIELD * n + SELF
    d, d_f = np.ones(n), 1.0
    last = np.zeros(n)
    for _ in range(ITERATIONS):
        o = (np.bincount(i, w / d[j], n) + FIELD / d_f + SELF / d) / t
        o_f = (FIELD * (1 / d).sum() + SELF / d_f) / t_f
        d, d_f = (np.bincount(j, w / o[i], n) + FIELD / o_f + SELF / o) / t, (FIELD * (1 / o).sum() + SELF / o_f) / t_f
        now = np.log(o / d)
        moved = np.abs(now - last).max()
        if moved < TOLERANCE:
            break
        last = now
    return now - now.mean(), bool(moved < TOLERANCE)


def _in_memory(pairs: DataFrame) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf["a"].to_numpy(str), pdf["b"].to_numpy(str)]), return_inverse=True)
        a, b = codes[: len(pdf)], codes[len(pdf) :]
        s, converged = scale(np.r_[a, b], np.r_[b, a], np.r_[pdf["wa"].to_numpy(float), pdf["wb"].to_numpy(float)], len(names))
        return pd.DataFrame({"set_id": pdf["set_id"].iloc[0], "run_id": names, "strength": np.exp(s), "converged": converged})

    return pairs.groupBy("set_id").applyInPandas(one, "set_id string, run_id string, strength double, converged boolean")


def _by_joins(edges: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same scaling for sets of any size: two joins and aggregations a round.

    A popular contestant's or set's rows are never sent to one task (see joined). Each round is written as a table and
    the one before is removed.
    """
    e = durable_table(edges)
    ends = e.select("set_id", F.explode(F.array(F.col("i"), F.col("j"))).alias("run_id"), "w")
    nodes = ends.groupBy("set_id", "run_id").agg((F.sum("w") / 2 + FIELD + SELF).alias("t"))
    nodes = durable_table(nodes.select("*", F.lit(1.0).alias("o"), F.lit(1.0).alias("d"), F.lit(1.0).alias("o_f"), F.lit(1.0).alias("d_f"), F.lit(0.0).alias("s")))
    size = nodes.agg(F.count("*").alias("n"), F.countDistinct("set_id").alias("sets")).first()

    def half(state: DataFrame, frm: str, to: str, using: str) -> DataFrame:
        """One side anew: ``using`` is the other side's factor."""
        factor = state.select("set_id", F.col("run_id").alias(frm), F.col(using).alias("u"))
        sums = joined(e, factor, ["set_id", frm], size["n"], to).groupBy("set_id", F.col(to).alias("run_id")).agg(F.sum(F.col("w") / F.col("u")).alias("x"))
        field = state.groupBy("set_id").agg(((F.sum(FIELD / F.col(using)) + SELF / F.first(f"{using}_f")) / (F.count("*") * FIELD + SELF)).alias("x_f"))
        new = (F.coalesce("x", F.lit(0.0)) + FIELD / F.col(f"{using}_f") + SELF / F.col(using)) / F.col("t")
        own = "o" if using == "d" else "d"
        met = joined(state.join(sums, ["set_id", "run_id"], "left"), field, ["set_id"], size["sets"], "run_id")
        return met.select("set_id", "run_id", "t", new.alias(own), using, F.col("x_f").alias(f"{own}_f"), f"{using}_f", "s")

    moved = 0.0
    for _ in range(iterations):
        state = half(half(nodes, "j", "i", "d"), "i", "j", "o")
        after = F.log(F.col("o") / F.col("d"))
        before, nodes = nodes, durable_table(state.select("set_id", "run_id", "t", "o", "d", "o_f", "d_f", after.alias("s"), F.abs(after - F.col("s")).alias("moved")))
        drop_table(before)
        moved = nodes.agg(F.max("moved")).first()[0] or 0.0
        if moved < tolerance:
            break
    mean = nodes.groupBy("set_id").agg(F.avg("s").alias("mean"), (F.max("moved") < tolerance).alias("converged"))
    return joined(nodes, mean, ["set_id"], size["sets"], "run_id").select("set_id", "run_id", F.exp(F.col("s") - F.col("mean")).alias("strength"), "converged")


def strengths(verdicts: DataFrame, edges_in_memory: int = EDGES_IN_MEMORY) -> DataFrame:
    """set_id, run_id, strength (geometric mean 1 in a set) and converged: odds of a over b are strength a : strength b.

    See pair_counts() for what counts. Contestants without any valid vote are absent, an empty
    table gives an empty result, repeated rows count once. Votes are folded to counts before they
    are gathered by set; a set with more than ``edges_in_memory`` rows of counts is never
    gathered but scaled by joins.
    """
    pairs = durable_table(pair_counts(verdicts))
    w = weighted(pairs)
    sizes = pairs.groupBy("set_id").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= edges_in_memory:
        return _in_memory(w)
    sizes = durable(sizes)
    small = w.join(sizes.filter(F.col("n") <= edges_in_memory), "set_id", "left_semi")
    large = w.join(sizes.filter(F.col("n") > edges_in_memory), "set_id", "left_semi")
    return _in_memory(small).unionByName(_by_joins(win_matrix(large)))
