"""Predicates and selections that compile to columns, so that they reach the scan."""

from __future__ import annotations

import fnmatch
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COST = ("cost_usd", "total_cost_usd", "tokens_in", "tokens_out")
SPEED = ("latency_ms",)
DESCRIPTIVE = ("output_words",)


def family(arm: Column, against: str, exclude: str | None = None) -> Column:
    """A comma list names arms exactly, a single word is part of the name; ``exclude`` is left out (FI-1)."""
    names = [x.strip() for x in against.split(",") if x.strip()]
    hit = arm.isin(*names) if "," in against else arm.contains(against)
    return hit & (arm != exclude) if exclude else hit


def field(col: Column, kind: str, want: str) -> Column:
    """One field filter: ``lo..hi`` on numbers (open ends, inclusive), else equality as text; null never passes (FI-3)."""
    if kind in ("number", "integer", "duration") and ".." in want:
        lo, hi = want.split("..", 1)
        out = col.isNotNull()
        if lo:
            out &= col >= float(lo)
        if hi:
            out &= col <= float(hi)
        return out
    return F.coalesce(col.cast("string") == F.lit(want), F.lit(False))


def where(paths: dict[str, Column], condition: str) -> Column:
    """``F=V``, ``F:V`` or ``F!=V`` over text values, null compared as the empty string (FI-4)."""
    op = "!=" if "!=" in condition else "=" if "=" in condition else ":"
    name, value = condition.split(op, 1)
    c = F.coalesce(paths[name].cast("string"), F.lit(""))
    return c != F.lit(value) if op == "!=" else c == F.lit(value)


def outside(at: Column, since: str, until: str) -> Column:
    """Why a record is outside [since, until), or null (FI-5, SS-2)."""
    return F.when(at.isNull(), "no time").when(at < F.lit(since).cast("timestamp"), "before since").when(at >= F.lit(until).cast("timestamp"), "at or after until")


def sampled(key: Column, rate: float, seed: str) -> Column:
    """The first 8 bytes of sha256(seed:key) as a share of 2^64, below ``rate``: the same side in every capture (FI-17)."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head < F.lit(int(rate * (1 << 64))).cast("decimal(20,0)")


def seeded_subset(df: DataFrame, key: str, share: float, seed: str, salt: str) -> DataFrame:
    """The k keys of smallest sha256(seed|salt|key); k = share of all, halves to even, at least one (FI-18).

    Works from the distinct keys; the cut is by rank over the hash, found with a top-k that holds k keys.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    n = keys.count()
    k = min(n, max(1, round(share * n)))
    return keys.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.lit(salt), F.col(key).cast("string")), 256), key).limit(k)


def arm_patterns(arm: Column, raw: str) -> Column:
    """Comma-separated patterns: a glob where there is a wildcard, else part of the name (FI-8)."""
    out = F.lit(False)
    for p in (x.strip() for x in raw.split(",")):
        if p:
            out |= arm.rlike(f"^{fnmatch.translate(p).removeprefix('(?s:').split(')')[0]}$") if any(c in p for c in "*?[") else arm.contains(p)
    return out


def metric_kind(metric: Column, declared: dict[str, str] | None = None) -> Column:
    """cost, speed, descriptive or quality; a declaration overrides the names (FI-11)."""
    c = F.when(F.lit(False), "")
    for k, v in (declared or {}).items():
        c = c.when(metric == k, v)
    return c.when(metric.isin(*COST), "cost").when(metric.isin(*SPEED), "speed").when(metric.isin(*DESCRIPTIVE), "descriptive").otherwise("quality")


def lower_is_better(metric: Column) -> Column:
    return metric.isin(*COST, *SPEED) | metric.startswith("total_tokens")


def direction(flag: Column, goal: Column, recorded: Column, metric: Column) -> Column:
    """flag, else the goal's, else the run's, else by name (FI-12)."""
    return F.coalesce(flag, goal, recorded, F.when(lower_is_better(metric), "lower").otherwise("higher"))


def verdict(metric: Column, delta: Column) -> Column:
    """What a movement means: identical, changed, better or worse (ST-46)."""
    return (
        F.when(delta == 0, "identical").when(metric.isin(*DESCRIPTIVE), "changed")
        .when(F.when(lower_is_better(metric), delta < 0).otherwise(delta > 0), "better").otherwise("worse")
    )


def bookkeeping(metric: Column) -> Column:
    """Columns that are no metric (FI-14)."""
    return metric.startswith("self_family_") | metric.startswith("resumed")


def is_repeat(run_id: Column) -> Column:
    return run_id.rlike(r"_r\d+$")


def ambiguous_runs(runs: DataFrame) -> DataFrame:
    """Arms of a dataset with several runs that are not one set of repeats (FI-15, VC-8)."""
    per = runs.groupBy("dataset_id", "config_id").agg(
        F.countDistinct("run_id").alias("n_runs"), F.min(is_repeat(F.col("run_id")).cast("int")).alias("all_repeats"),
        F.countDistinct(F.regexp_replace("run_id", r"_r\d+$", "")).alias("n_stems"))
    return per.filter((F.col("n_runs") > 1) & ((F.col("all_repeats") == 0) | (F.col("n_stems") > 1))).drop("all_repeats")


def mixed_versions(arms: DataFrame, arm: str) -> DataFrame:
    """Stems that stand with more than one ``_vN`` (FI-16)."""
    x = arms.select(F.regexp_extract(arm, r"^(.*)_v(\d+)$", 1).alias("stem"), F.regexp_extract(arm, r"^(.*)_v(\d+)$", 2).alias("version")).filter("stem <> ''").distinct()
    return x.groupBy("stem").agg(F.count("*").alias("n_versions")).filter("n_versions > 1")


def rule_column(rules: list[dict[str, Any]], fields: dict[str, Column], age_days: Column | None = None) -> Column:
    """A rule list (when, unless, exists, absent, range, min_age_days -> label or skip) as one CASE; the first rule that holds wins (DS-15).

    Values compare equal if they are, or if their texts are. No rule or a skip gives null.
    """

    def same(c: Column, want: Any) -> Column:
        hit = F.lit(False)
        for w in want if isinstance(want, list) else [want]:
            if w is None:
                hit |= c.isNull()
            else:
                text = str(w).lower() if isinstance(w, bool) else str(w)
                hit |= F.coalesce(F.lower(c.cast("string")) == text if isinstance(w, bool) else c.cast("string") == text, F.lit(False))
        return hit

    out: Column | None = None
    for rule in rules:
        hold = F.lit(True)
        for f, w in (rule.get("when") or {}).items():
            hold &= same(fields[f], w)
        for f, w in (rule.get("unless") or {}).items():
            hold &= ~same(fields[f], w)
        for f in rule.get("exists") or []:
            hold &= fields[f].isNotNull()
        for f in rule.get("absent") or []:
            hold &= fields[f].isNull()
        for f, bounds in (rule.get("range") or {}).items():
            v = fields[f].try_cast("double")
            hold &= v.isNotNull()
            if "min" in bounds:
                hold &= v >= bounds["min"]
            if "max" in bounds:
                hold &= v <= bounds["max"]
        if "min_age_days" in rule:
            hold &= F.coalesce(age_days >= rule["min_age_days"], F.lit(False)) if age_days is not None else F.lit(False)
        label = F.lit(None).cast("string") if rule.get("skip") else F.lit(str(rule["label"]))
        out = F.when(hold, label) if out is None else out.when(hold, label)
    return out if out is not None else F.lit(None).cast("string")
