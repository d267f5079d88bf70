"""Ranks, windows, top-k and latest-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 1e-9


def midrank(by: list[str], order: Column, *ties: str) -> Column:
    """1-based rank, equal values share the average of theirs (RK-1, RK-4)."""
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, *ties)) - 1) / 2.0


def tolerant_ranks(df: DataFrame, by: list[str], arm: str, value: str, ascending: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranks within an item where a value ties with the head of its group if it is within ``tolerance`` of it (RK-2).

    Runs of values whose neighbours are within the tolerance are found by a lag. Almost all are no wider than the tolerance and are
    one group; only in wider ones each value looks its group up, from head to head.
    """
    sign = 1.0 if ascending else -1.0
    w = Window.partitionBy(*by).orderBy("_v", arm)
    x = df.select(*by, arm, (F.col(value) * sign).alias("_v")).withColumn("_at", F.row_number().over(w) - 1)
    x = x.withColumn("_run", F.sum(F.coalesce(F.col("_v") - F.lag("_v").over(w) > tolerance, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "_run")
    wide = F.max("_v").over(run) - F.min("_v").over(run) > tolerance
    x = x.withColumn("_wide", F.coalesce(wide, F.lit(False))).withColumn("_mid", F.avg("_at").over(run)).withColumn("_first", F.min("_at").over(run))
    x = x.withColumn("_vs", F.array_sort(F.collect_list(F.when(F.col("_wide"), F.col("_v"))).over(run)))
    own = F.col("_at") - F.col("_first")

    def step(acc: Column, v: Column) -> Column:
        same = (acc["i"] > 0) & (v - acc["head"] <= tolerance)
        start = F.when(same, acc["start"]).otherwise(acc["i"])
        mine = F.when(acc["i"] == own, start).otherwise(acc["mine"])
        return F.struct(F.when(same, acc["head"]).otherwise(v).alias("head"), start.alias("start"), mine.alias("mine"),
                        F.when((acc["i"] < own) | (start == mine), acc["i"]).otherwise(acc["last"]).alias("last"), (acc["i"] + 1).alias("i"))

    zero = F.struct(F.lit(0.0).alias("head"), F.lit(0).alias("start"), F.lit(0).alias("mine"), F.lit(0).alias("last"), F.lit(0).alias("i"))
    looked = F.aggregate("_vs", zero, step, lambda acc: (acc["mine"] + acc["last"]) / 2)
    return x.select(*by, arm, (F.when(F.col("_wide"), F.col("_first") + looked).otherwise(F.col("_mid")) + 1).alias("rank"))


def latest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregation that combines map-side (RK-8, RK-10, RK-11)."""
    return df.groupBy(*keys).agg(F.max(F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), *keep)).alias("m")).select(*keys, *(f"m.{k}" for k in keep))


def first_of(df: DataFrame, key: Column, position: str, keep: list[str]) -> DataFrame:
    """The first occurrence of each key in order of position (RK-9)."""
    return df.groupBy(key.alias("_key")).agg(F.min(F.struct(F.col(position).alias("_at"), *keep)).alias("m")).select(*(f"m.{k}" for k in keep))


def collapsed(text: Column) -> Column:
    """Lower case with runs of blanks as one."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def promote(df: DataFrame, group: str, score: str, ident: str, top: int, floor: float, cap: int, terms: tuple[str, ...] = ()) -> DataFrame:
    """Of every group the ``top`` best at or above floor x leader, at most ``cap`` over all, and whatever holds a term (RK-7).

    Equal scores go by ``ident``. Columns: group, ident, score, reason (top, override). The filter on the rank lets every
    partition cut a group to ``top`` rows before it is gathered, so that a large group costs no more than a small
    one; the leader is then sought among those rows. A cap needs one order over the promoted rows only, found as a top-k.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), ident)
    r = df.select(group, ident, score)
    best = r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    best = best.withColumn("leader", F.max(score).over(Window.partitionBy(group)))
    good = best.filter(F.col(score) >= floor * F.col("leader")).orderBy(F.desc(score), ident).limit(cap).select(group, ident, score, F.lit("top").alias("reason"))
    if not terms:
        return good
    hit = F.lit(False)
    for t in terms:
        hit |= F.col(ident).contains(t)
    more = r.filter(hit).select(group, ident, score, F.lit("override").alias("reason")).join(good, [group, ident], "left_anti")
    return good.unionByName(more)


def argmax_set(df: DataFrame, by: list[str], arm: str, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Every arm within ``tolerance`` of its item's best, with its share 1/k (RK-12)."""
    best = F.max(value).over(Window.partitionBy(*by))
    won = df.withColumn("_best", best).filter(F.col("_best") - F.col(value) < tolerance)
    return won.select(*by, arm, (1 / F.count(F.lit(1)).over(Window.partitionBy(*by))).alias("share"))


def running_total(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Cumulative sums of an already aggregated series (RK-14)."""
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def newest_share(df: DataFrame, key: str, ident: str, share: float) -> DataFrame:
    """The round(n x share) newest rows by (key, ident) (RK-15, DS-5)."""
    n = round(df.filter(F.col(key).isNotNull()).count() * share)
    return df.filter(F.col(key).isNotNull()).orderBy(F.desc(key), F.desc(ident)).limit(n)


def shuffled(df: DataFrame, by: list[str], member: str, seed: str, salt: str) -> DataFrame:
    """Members of an item in order of sha256(seed|salt|item|member), with their place (RK-16)."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(salt), *(F.col(b) for b in by), F.col(member)), 256)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(h, member)))


def blocks(df: DataFrame, by: list[str], place: str, per_call: int) -> DataFrame:
    """Fewest blocks of at most ``per_call`` members, sizes differing by one, bigger first (RK-17)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    k = F.ceil(n / per_call)
    big = n % k
    size = F.floor(n / k)
    cut = big * (size + 1)
    block = F.when(F.col(place) <= cut, F.floor((F.col(place) - 1) / (size + 1))).otherwise(big + F.floor((F.col(place) - 1 - cut) / size))
    return df.withColumn("block", block.cast("int"))
