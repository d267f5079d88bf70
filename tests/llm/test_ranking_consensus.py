import random

import numpy as np
import pytest

from tallyline.llm import consensus as cs
from tallyline.llm import ranking as rk

VOTES = "verdict_id long, set_id string, judge string, arm_ids array<string>, better string, created_at timestamp"


def simulate(spark, sets=3, n=9, games=700, seed=3, lean=1.5):
    rng = random.Random(seed)
    rows, truth = [], {}
    for s in range(sets):
        p = {f"r{s}_{i}": 1.5**i for i in range(n)}
        names = list(p)
        rng.shuffle(names)
        truth[f"s{s}"] = sorted(p, key=p.get, reverse=True)
        for _ in range(games):
            a = names[min(int(rng.expovariate(0.4)), n - 1)]  # some meet often, some seldom
            b = rng.choice([x for x in names if x != a])
            if rng.random() < 0.5:
                a, b = b, a
            j = rng.choice(["fair", "leans"])
            k = lean if j == "leans" else 1.0
            w = rng.choice([" 1", "1"]) if rng.random() < k * p[a] / (k * p[a] + p[b]) else "2 "
            rows.append((len(rows), f"s{s}", j, [a, b], rng.choice(["Tie", " tie "]) if rng.random() < 0.05 else w, None))
    return spark.createDataFrame(rows, VOTES), truth


def test_strengths_order_contestants(spark):
    v, truth = simulate(spark)
    got = {}
    for r in rk.strengths(v).collect():
        got.setdefault(r["set_id"], {})[r["run_id"]] = r["strength"]
    for s, order in truth.items():
        mine = sorted(got[s], key=got[s].get, reverse=True)
        assert len(set(mine[:3]) & set(order[:3])) >= 2 and np.corrcoef([mine.index(x) for x in order], range(len(order)))[0, 1] > 0.9
        assert np.log(list(got[s].values())).mean() == pytest.approx(0, abs=1e-9)


def test_joins_and_memory_agree(spark, monkeypatch):
    v, _ = simulate(spark, sets=2, n=4, games=60)
    from tallyline.llm import base

    a = {(r["set_id"], r["run_id"]): r["strength"] for r in rk.strengths(v).collect()}
    monkeypatch.setattr(base, "BROADCAST_ROWS", 3)
    salted = rk._by_joins(rk.win_matrix(rk.weighted(rk.pair_counts(v))), iterations=2)
    monkeypatch.undo()
    plain = rk._by_joins(rk.win_matrix(rk.weighted(rk.pair_counts(v))), iterations=2)
    assert sorted((*r[:2], round(r[2], 9), r[3]) for r in salted.collect()) == sorted((*r[:2], round(r[2], 9), r[3]) for r in plain.collect()) and not plain.first()["converged"]
    b = {(r["set_id"], r["run_id"]): r["strength"] for r in rk._by_joins(rk.win_matrix(rk.weighted(rk.pair_counts(v))), iterations=14, tolerance=1e-5).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=5e-3) for k in a)


def test_sinkhorn_recovers_exact_odds():
    p = np.array([1.0, 2.0, 4.0, 8.0])
    i, j = np.array([(a, b) for a in range(4) for b in range(4) if a != b]).T
    games = 1e6 * (1 + (i + j) % 3) * (1 + 50 * ((i + j) == 1))  # very uneven
    s, converged = rk.scale(i, j, games * p[i] / (p[i] + p[j]), 4)
    assert converged
    assert np.exp(s - s[0]) == pytest.approx(p, rel=1e-3)


def test_votes_that_do_not_count(spark):
    rows = [(1, "s", "j", ["a", "b"], "1", None), (1, "s", "j", ["a", "b"], "1", None), (2, "s", "j", ["a", "b"], "both", None), (3, "s", "j", ["a", "a"], "1", None), (4, "s", None, ["a", "b"], None, None),
            (5, None, "j", ["a", "b"], "1", None), (6, "s", "j", ["a"], "1", None), (7, "s", "j", None, "1", None), (8, "s", None, ["a", "b"], "TIE ", None)]
    df = spark.createDataFrame(rows, VOTES)
    c = rk.pair_counts(df).groupBy("a", "b").sum("first", "second", "tie").collect()
    assert [tuple(r) for r in c] == [("a", "b", 1.0, 0.0, 1.0)]
    s = {r["run_id"]: r["strength"] for r in rk.strengths(df).collect()}
    assert s["a"] > 1 > s["b"]
    assert rk.strengths(df.limit(0)).count() == 0


def labels(spark, seed=1, units=400):
    """Nine judges: four good, one inverted, one a grade too high, one careless, one of few labels, one constant."""
    rng = random.Random(seed)
    near = lambda t: min(5, max(1, t + rng.choice([0, 0, 0, 0, 1, -1])))
    judges = {**{f"good{i}": near for i in range(4)}, "inverted": lambda t: 6 - near(t), "high": lambda t: min(5, near(t) + 1), "careless": lambda t: rng.randint(1, 5), "few": near, "constant": lambda t: 3}
    rows, truth = [], {}
    for u in range(units):
        t = rng.randint(1, 5)
        truth[f"r{u % 7}", f"i{u}", "fluency"] = t
        for j in rng.sample(sorted(judges), 5):
            if j != "few" or u < 40:
                rows.append((f"r{u % 7}", f"i{u}", "fluency", j, judges[j](t)))
    return spark.createDataFrame(rows, "run_id string, item_id string, dim_name string, judge string, grade int"), truth


def accuracy(grades, truth):
    got = {(r["run_id"], r["item_id"], r["dim_name"]): r["grade"] for r in grades.collect()}
    return np.mean([got[k] == v for k, v in truth.items() if k in got])


def test_consensus_beats_the_vote_and_knows_the_judges(spark):
    df, truth = labels(spark)
    fit = cs.fit(df)
    votes = {}
    for r in df.collect():
        votes.setdefault((r["run_id"], r["item_id"], r["dim_name"]), []).append(r["grade"])
    plain = np.mean([max(sorted(set(votes[k])), key=votes[k].count) == v for k, v in truth.items() if k in votes])
    mine = accuracy(fit.grades, truth)
    assert mine > plain + 0.05 and mine > 0.75
    j = {r["judge"]: r for r in fit.annotators.collect()}
    assert j["inverted"]["judge_type"] == "inverted" and j["high"]["judge_type"] == "lenient" and j["few"]["judge_type"] == "accurate"
    assert j["inverted"]["information"] > 0.5 > j["careless"]["information"] and j["good0"]["accuracy"] > 0.5 > j["careless"]["accuracy"]


def test_joined_fit_is_the_same(spark, monkeypatch):
    df, truth = labels(spark, units=120)
    monkeypatch.setattr(cs, "ITERATIONS", 4)
    a, b = cs.fit(df), cs.fit(df, in_memory=2)
    assert abs(accuracy(a.grades, truth) - accuracy(b.grades, truth)) < 0.05 and b.grades.count() == a.grades.count()
    assert {r["judge"] for r in b.annotators.collect()} == {r["judge"] for r in a.annotators.collect()}


SCORES = "score_id long, run_id string, item_id string, judge string, per_dimension map<string,int>, created_at timestamp"


def test_grade_labels(spark):
    rows = [(1, "r", "i", "j", {"Fluency": 3, "coverage": 9}, None), (1, "r", "i", "j", {"Fluency": 3, "coverage": 9}, None), (2, "r", "i", "k", {}, None), (3, "r", "i", None, {"fluency": 2}, None), (4, "r", "i", "m", None, None), (5, None, "i", "j", {"fluency": 1}, None)]
    df = spark.createDataFrame(rows, SCORES)
    got = sorted((str(r["run_id"]), r["dim_name"], r["judge"], r["grade"]) for r in cs.grade_labels(df).collect())
    assert got == [("None", "fluency", "j", 1), ("r", "fluency", "j", 3)]
    assert cs.fit(cs.grade_labels(df)).grades.count() == 2
    none = cs.fit(cs.grade_labels(df.limit(0)))
    assert none.grades.count() == 0 and none.annotators.count() == 0
    a = cs.unit_agreement(spark.createDataFrame([("r", "i", "f", "a", 3), ("r", "i", "f", "b", 3), ("r", "i", "f", "c", 1)], "run_id string, item_id string, dim_name string, judge string, grade int")).first()
    assert a["n_labels"] == 3 and a["agreement"] == pytest.approx(1 / 3)
