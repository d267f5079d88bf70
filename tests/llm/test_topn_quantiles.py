import datetime as dt
import math
import random

import numpy as np
import pytest

from tallyline.llm import quantiles as qt
from tallyline.llm import topn

RUNS = "stratum string, run_id string, primary_score double, filed_at timestamp, ident string, score string, g0 int"


def t(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def brute(rows, n):
    last = {}
    for g, r, s, at, *_ in rows:
        if g is not None and s is not None and not math.isnan(s):
            key = (at is not None, at, s) if at is not None else (False, t(0), s)
            if (g, r) not in last or key > last[g, r]:
                last[g, r] = key
    out = {}
    for (g, r), k in last.items():
        out.setdefault(g, []).append((-k[2], r or "", r))
    return sorted((g, r, i + 1) for g, v in out.items() for i, (_, _, r) in enumerate(sorted(v)[:n]))


def test_top_n_is_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None, ""]), f"r{rng.randint(0, 60)}", rng.choice([None, float("nan"), -1.0, 0.0, -0.0, 0.5, 0.5, 0.9, rng.random()]), rng.choice([None, t(rng.randint(0, 5))]), "x", "y", 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, RUNS).repartition(7)
    got = topn.top_n_per_group(df, ["stratum"], "primary_score", "run_id", 3, latest="filed_at")
    assert sorted((r["stratum"], r["run_id"], r["rank_in_group"]) for r in got.collect()) == brute(rows, 3)


def test_top_n_edges(spark):
    assert topn.top_n_per_group(spark.createDataFrame([], RUNS), ["stratum"], "primary_score", "run_id", 3).count() == 0
    one = spark.createDataFrame([("s", None, 1.0, None, "", "", 0), ("s", "r", 1.0, None, "", "", 0)], RUNS)
    assert [r["run_id"] for r in topn.top_n_per_group(one, ["stratum"], "primary_score", "run_id", 1).collect()] == [None]
    hot = spark.range(20_000).selectExpr("'hot' AS g", "concat('r', id) AS r", "pmod(id * 7919, 1000) / 10D AS s")
    got = topn.top_n_per_group(hot, ["g"], "s", "r", 2).collect()
    assert all(x["s"] == 99.9 for x in got) and [x["r"] for x in sorted(got, key=lambda x: x["rank_in_group"])] == sorted(f"r{i}" for i in range(20_000) if i * 7919 % 1000 == 999)[:2]


def test_several_group_columns(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, "y", 2.0), ("a", 1, "z", 3.0)], "g string, h int, r string, s double")
    got = {(r["g"], r["h"]): r["r"] for r in topn.top_n_per_group(df, ["g", "h"], "s", "r", 1).collect()}
    assert got == {("a", 1): "z", ("a", 2): "y"}


@pytest.mark.parametrize("shape", ["normal", "ties", "sorted", "tail"])
def test_sketch_stays_within_its_bound(shape):
    rng = np.random.default_rng(2)
    n = 400_000
    x = {"normal": rng.normal(100, 5, n), "ties": rng.integers(0, 5, n).astype(float), "sorted": np.arange(n, dtype=float), "tail": rng.pareto(1.1, n)}[shape]
    parts = [qt.Sketch() for _ in range(5)]
    for i, p in enumerate(parts):
        for chunk in np.array_split(x[i::5], 9):
            p.add(chunk)
    whole = qt.Sketch()
    for p in parts:
        whole.n += p.n
        whole.error += p.error
        for level, v in p.rows():
            whole.merge(level, v)
    assert whole.n == n and 0 < whole.error <= 0.001 * n
    srt = np.sort(x)
    for p, v in zip((0.01, 0.5, 0.9, 0.99), whole.quantiles([0.01, 0.5, 0.9, 0.99]), strict=True):
        r = max(1, math.ceil(p * n))
        low, high = np.searchsorted(srt, v, "left") + 1, np.searchsorted(srt, v, "right")
        assert low - whole.error <= r <= high + whole.error


def test_percentiles_of_groups(spark):
    rows = [("a", 1.0, 5), ("a", None, 5), ("a", float("nan"), 6), ("a", -3.0, None), ("a", 9.0, 7), (None, 2.0, 1), ("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, m0 double, k0 long")
    got = {(r["g"], r["measure"]): (r["n"], r["p50"], r["max_rank_error"]) for r in qt.percentiles(df, ["g"], ["m0", "k0"], {"p50": 0.5}).collect()}
    assert got == {("a", "m0"): (2, 1.0, 0.0), ("a", "k0"): (4, 5.0, 0.0), (None, "m0"): (1, 2.0, 0.0), (None, "k0"): (1, 1.0, 0.0)}
    assert qt.percentiles(df.limit(0), ["g"], ["m0"], {"p50": 0.5}).count() == 0


def test_days_combine_into_the_whole(spark):
    df = spark.range(150_000).selectExpr("'hot' AS g", "pmod(id, 5) AS day", "pmod(id * 48271, 100003) / 7D AS v").repartition(6)
    ps = {"p50": 0.5, "p99": 0.99}
    days = qt.merge_sketches(qt.build_sketches(df, ["g", "day"], ["v"]), ["g", "day"], salts=1)
    whole = qt.read_percentiles(qt.merge_sketches(days, ["g"]), ["g"], ps).first()
    assert whole["n"] == 150_000
    exact = np.sort(df.toPandas()["v"].to_numpy())
    for name, p in ps.items():
        at = np.searchsorted(exact, whole[name], "right")
        assert abs(at - math.ceil(p * 150_000)) <= whole["max_rank_error"] + 3
