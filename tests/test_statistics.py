import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions import signflip as sf
from tallyline.operators import leaderboard as lb
from tallyline.operators import paired as pr

SERIES = "dataset_id string, config_id string, item_id string, value double"


def brute(d):
    total = abs(sum(d))
    hits = sum(abs(sum(s * x for s, x in zip(signs, d))) >= total - 1e-12 for signs in itertools.product((1, -1), repeat=len(d)))
    return hits / 2 ** len(d)


@pytest.mark.parametrize("n", range(1, 13))
def test_exact_is_the_enumeration(n):
    rng = random.Random(n)
    d = [rng.choice([0.1, -0.1, 0.05, 0.3, -0.2]) for _ in range(n)]
    assert sf.exact_p(np.array(d)) == pytest.approx(brute(d))


def test_known_p_values():
    assert sf.exact_p(np.full(10, 0.1)) == 2 / 2**10
    assert sf.exact_p(np.array([0.1, -0.1, 0.05, -0.05])) == 1.0
    assert sf.p_value([]) == 1.0
    assert sf.least_p(5) == 2 / 32


def test_drawn_p_takes_the_signs_of_the_literal_loop():
    d = np.array([random.Random(3).gauss(0.05, 0.3) for _ in range(1)] + [0.02 * (i % 7) - 0.05 for i in range(40)])
    rng, hits = random.Random(sf.SEED), 0
    seen = abs(math.fsum(d) / len(d))
    for _ in range(300):
        hits += abs(math.fsum(x if rng.random() < 0.5 else -x for x in d) / len(d)) >= seen
    assert sf.drawn_p(d, permutations=300) == (hits + 1) / 301


def test_limit_is_near_the_draws():
    d = np.random.default_rng(1).normal(0.02, 1, 4000)
    assert sf.limit_p(d.sum(), float(d @ d)) == pytest.approx(sf.drawn_p(d, 2000), abs=0.04)


def test_interval():
    assert sf.interval(np.full(5, 0.1)) is None
    low, high = sf.interval(np.array([0.1, 0.2, 0.15, 0.12, 0.18, 0.11, 0.16, 0.14]))
    assert 0 < low < 0.145 < high < 0.25
    d = np.random.default_rng(0).normal(1, 1, 100)
    low, high = sf.interval(d)
    assert low < d.mean() < high


def test_pairs_of_more_items_than_a_power_of_two_holds(spark):
    assert sf.least_p(1) == 1 and sf.least_p(1024) == 2.0**-1023 and sf.least_p(5000) == 0
    a = np.random.default_rng(2).integers(0, 5, 1100) / 4
    rows = [("d", k, f"i{i:04}", float(v)) for k, x in (("base", a), ("mine", a[::-1] + 0.25)) for i, v in enumerate(x)]
    d = a[::-1] + 0.25 - a
    half = 1.959964 * d.std(ddof=1) / math.sqrt(len(d))
    got = pr.compare(spark.createDataFrame(rows, SERIES), "base").first()
    assert (got["n"], got["least_p"]) == (1100, 0) and got["p"] == sf.drawn_p(np.round(d, 9))
    assert got["low"] == pytest.approx(d.mean() - half, abs=1e-3) and got["high"] == pytest.approx(d.mean() + half, abs=1e-3)


def arms(spark):
    rows = [("d", "base", f"e{i}", 0.5) for i in range(10)] + [("d", "better", f"e{i}", 0.6) for i in range(10)] + [("d", "one_item", "e0", 0.9), ("d", "same", "e1", 0.5), ("d", "same", "e2", 0.5)]
    return spark.createDataFrame(rows, SERIES)


def test_compare_verdicts(spark):
    got = {r["config_id"]: r for r in pr.compare(arms(spark), "base").collect()}
    assert got["better"]["verdict"] == "significant: better" and got["better"]["wins"] == 10 and got["better"]["p"] == 2 / 2**10
    assert got["one_item"]["verdict"] == "untestable" and got["one_item"]["p"] is None
    assert got["same"]["verdict"] == "identical"
    got = {r["config_id"]: r for r in pr.compare(arms(spark), "base", higher_is_better=False).collect()}
    assert got["better"]["verdict"] == "significant: worse" and got["better"]["losses"] == 10
    got = {r["config_id"]: r for r in pr.compare(arms(spark), "base", neutral=True).collect()}
    assert got["better"]["verdict"] == "significant: higher"


def test_compare_of_nothing(spark):
    assert pr.compare(spark.createDataFrame([], SERIES), "base").count() == 0
    assert pr.compare(arms(spark), "no such arm").count() == 0


def test_long_pairs_take_the_limit(spark, monkeypatch):
    monkeypatch.setattr(sf, "DRAWN", 5)
    p = {r["config_id"]: r["p"] for r in pr.compare(arms(spark), "base").collect()}
    assert p["better"] == pytest.approx(sf.limit_p(1.0, 0.1))


@pytest.mark.parametrize(("ps", "family", "want"), [
    ({"a": 0.001, "b": 0.02, "c": 0.03}, None, {"a": (0.05 / 3, True), "b": (0.025, True), "c": (0.05, True)}),
    ({"a": 0.001, "b": 0.06, "c": 0.01}, None, {"a": (0.05 / 3, True), "c": (0.025, True), "b": (0.05, False)}),
    ({"a": 0.02}, 3, {"a": (0.05 / 3, False)}), ({"a": 0.05}, None, {"a": (0.05, True)}), ({"a": 0.03, "b": 0.04}, None, {"a": (0.025, False), "b": (0.05, False)}),
])
def test_holm(spark, ps, family, want):
    df = spark.createDataFrame([("f", k, v) for k, v in ps.items()], "fam string, arm string, p double")
    got = {r["arm"]: (r["threshold"], r["significant"]) for r in pr.holm(df, "p", ["fam"], ["arm"], family=family).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1]


def test_family_shares_one_stream(spark):
    rng = random.Random(5)
    rows = [("d", a, f"i{i:02}", round(rng.random(), 4)) for a in ("mine", "x", "y") for i in range(40)]
    got = {r["config_id"]: r["p"] for r in pr.family_test(spark.createDataFrame(rows, SERIES), "mine", permutations=200).collect()}
    by = {a: {i: v for _, b, i, v in rows if b == a} for a in ("mine", "x", "y")}
    stream = sf.Signs(sf.SEED)
    for o in ("x", "y"):
        d = np.array([round(by["mine"][i] - by[o][i], 9) for i in sorted(by["mine"])])
        assert got[o] == sf.p_value(d, 200, stream=stream)


def test_rank_tests_find_an_effect(spark):
    rng = random.Random(1)
    rows = [("d", a, f"i{i}", round(m + 0.05 * rng.random(), 6)) for a, m in (("a", 0.9), ("b", 0.6), ("c", 0.3), ("e", 0.28)) for i in range(30)] + [("few", "a", "i0", 1.0), ("few", "b", "i0", 0.0)]
    s = spark.createDataFrame(rows, SERIES)
    got = {r["config_id"]: r for r in lb.significance(s, shuffles=500, resamples=200).collect()}
    assert set(got) == {"a", "b", "c", "e"} and got["a"]["avg_rank"] == 1.0 and got["a"]["p_first"] == 1.0 and got["a"]["p"] == pytest.approx(1 / 501)
    st = lb.stability(s.filter("dataset_id = 'd'"), draws=20).collect()
    assert [r["size"] for r in st] == [10] and st[0]["p_same_winner"] == 1.0


@pytest.mark.parametrize(("k", "q"), [(2, 1.960), (3, 2.343), (5, 2.728), (10, 3.164)])
def test_nemenyi_values(k, q):
    assert lb.nemenyi_q(k) == pytest.approx(q, abs=2e-3)
    assert lb.nemenyi_q(41) is None


def test_tolerant_ranks_anchor_at_the_head(spark):
    from tallyline.operators.ranks import tolerant_ranks

    rows = [("i", "a", 1.0), ("i", "b", 1.0 - 0.8e-9), ("i", "c", 1.0 - 1.6e-9), ("i", "d", 0.2)]
    got = {r["arm"]: r["rank"] for r in tolerant_ranks(spark.createDataFrame(rows, "item string, arm string, v double"), ["item"], "arm", "v").collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0, "d": 4.0}
    rng = np.random.default_rng(1)
    rows = [(f"i{k}", f"a{j}", float(v)) for k in range(40) for j, v in enumerate(np.round(rng.random(9) * 4e-9, 11))]
    got = {(r["item"], r["arm"]): r["rank"] for r in tolerant_ranks(spark.createDataFrame(rows, "item string, arm string, v double"), ["item"], "arm", "v", ascending=True).collect()}
    for k in range(40):
        mine = [x for x in rows if x[0] == f"i{k}"]
        assert [got[x[0], x[1]] for x in mine] == lb.ranks_of(np.array([x[2] for x in mine])).tolist()


def test_bootstrap_refuses_free_text(spark):
    df = spark.createDataFrame([("o", f"i{i}", f"text {i}", "a", "b") for i in range(12)], "opponent string, item_id string, gold string, a string, b string")
    with pytest.raises(ValueError, match="free text"):
        pr.bootstrap(df)


def test_r_p_value():
    assert pr.r_p_value(0.0, 10) == pytest.approx(1.0)
    assert pr.r_p_value(0.6319, 10) == pytest.approx(0.05, abs=1e-3)
    assert pr.r_p_value(0.5, 2) is None


def test_frontier(spark):
    pts = spark.createDataFrame([("g", "a", 0.9, 5.0, 1.0), ("g", "b", 0.8, 1.0, 1.0), ("g", "c", 0.7, 6.0, 2.0), ("g", "same", 0.8, 1.0, 1.0), ("g", "none", None, 1.0, 1.0)], "g string, arm string, q double, cost double, speed double")
    got = {r["arm"]: r["dominated_by"] for r in lb.frontier(pts, ["g"], "arm", ["q"], ["cost", "speed"]).collect()}
    assert got == {"a": None, "b": None, "same": None, "c": "a"}


def test_wilson_and_kendall(spark):
    from tallyline.operators.agreement import kendall_tau_b

    low, high = pr.wilson(F.lit(8.0), F.lit(10.0))
    r = spark.range(1).select(low.alias("l"), high.alias("h"), kendall_tau_b(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 3, 2)))).alias("t"),
                              kendall_tau_b(F.array(*map(F.lit, (1, 1))), F.array(*map(F.lit, (1, 3)))).alias("z")).first()
    assert (r["l"], r["h"]) == (0.4902, 0.9433) and r["t"] == pytest.approx(1 / 3) and r["z"] == 0.0


def predictions(spark, folder, rows):
    """A folder with a predictions table of (config_id, item_id, overlap_f1), all of dataset d."""
    at = F.lit("2026-01-01").cast("timestamp")
    df = spark.createDataFrame([(i, f"{c}_r1", c, "d", item, v) for i, (c, item, v) in enumerate(rows)], "pred_id long, run_id string, config_id string, dataset_id string, item_id string, overlap_f1 double")
    df.withColumn("created_at", at).withColumn("logged_at", at).write.parquet(f"{folder}/predictions.parquet")
    return str(folder)


def test_exact_holm_and_bonferroni_take_every_item(spark, tmp_path):
    from tallyline.queries import QUERIES

    ids = [f"i{i:02}" for i in range(15)]
    # Arms that equal the baseline on the first twelve items and differ on the last three, or the other way about.
    deltas = {"late": [0.0] * 12 + [0.1, 0.2, 0.3], "turns": [0.1] * 10 + [-0.1] * 5, "wins": [round(0.01 * (i + 1), 9) for i in range(15)]}
    d = predictions(spark, tmp_path, [("arm_base", i, 0.5) for i in ids] + [(a, i, round(0.5 + x, 9)) for a, xs in deltas.items() for i, x in zip(ids, xs)])
    want = {a: brute(xs) for a, xs in deltas.items()}
    got = {r["config_id"]: r for r in QUERIES["st_1_exact_all"](spark, d).collect()}
    assert {a: r["n"] for a, r in got.items()} == dict.fromkeys(deltas, 15)
    assert {a: r["p"] for a, r in got.items()} == pytest.approx(want, abs=1e-9)
    places, run, ok = sorted(want, key=lambda a: (want[a], a)), 0.0, True
    holm = {r["config_id"]: r for r in QUERIES["st_3_holm_all"](spark, d).collect()}
    for i, a in enumerate(places):
        run, ok = max(run, min(1.0, want[a] * (3 - i))), ok and want[a] <= 0.05 / (3 - i)
        assert holm[a]["p_holm"] == pytest.approx(run, abs=1e-9) and holm[a]["significant"] == ok
    bonferroni = {r["config_id"]: (r["p_corrected"], r["significant"]) for r in QUERIES["st_5_bonferroni_all"](spark, d).collect()}
    for a, p in want.items():
        assert bonferroni[a][0] == pytest.approx(min(1.0, 3 * p), abs=1e-9) and bonferroni[a][1] == (p <= 0.05 / 3)


LABELS = "opponent string, item_id string, gold string, a string, b string"


def labelled(opponents, n):
    rng = random.Random(9)
    return [(o, f"i{i:03}", g, g if rng.random() < 0.8 else "x", g if rng.random() < r else rng.choice(["x", "y", "other"])) for o, r in opponents for i, g in ((i, rng.choice(["x", "y", "z"])) for i in range(n))]


def literal_f1(pairs, labels):
    f = []
    for k in labels:
        tp = sum(g == p == k for g, p in pairs)
        den = sum(g == k for g, _ in pairs) + sum(p == k for _, p in pairs)
        f.append(2 * tp / den if den else 0.0)
    return sum(f) / len(f)


def test_bootstrap_of_cells_takes_the_draws_of_the_literal_loop(spark):
    rows = labelled([("o1", 0.6), ("o2", 0.8)], 37)
    got = {r["opponent"]: r for r in pr.bootstrap(spark.createDataFrame(rows, LABELS), draws=200).collect()}
    rng = random.Random(7)
    for o in ("o1", "o2"):
        x = sorted(r for r in rows if r[0] == o)
        delta = lambda idx: literal_f1([(x[i][2], x[i][3]) for i in idx], "xyz") - literal_f1([(x[i][2], x[i][4]) for i in idx], "xyz")  # noqa: B023, E731
        ds = sorted(delta([rng.randrange(37) for _ in range(37)]) for _ in range(200))
        assert (got[o]["delta"], got[o]["low"], got[o]["high"]) == pytest.approx((delta(range(37)), ds[5], ds[195]))


def test_bootstrap_of_many_items_is_drawn_from_counts(spark, monkeypatch):
    df = spark.createDataFrame(labelled([("o1", 0.6), ("o2", 0.8)], 300), LABELS)
    drawn = {r["opponent"]: r for r in pr.bootstrap(df).collect()}
    monkeypatch.setattr(sf, "DRAWN", 100)
    counted = {r["opponent"]: r for r in pr.bootstrap(df).collect()}
    assert drawn.keys() == counted.keys() == {"o1", "o2"}
    for o, r in drawn.items():
        assert counted[o]["n"] == 300 and counted[o]["delta"] == pytest.approx(r["delta"])
        assert (counted[o]["low"], counted[o]["high"]) == pytest.approx((r["low"], r["high"]), abs=0.01)
        assert counted[o]["p"] == pytest.approx(r["p"], abs=4 * 2 * math.sqrt(2 * 0.25 / 5000))  # four standard errors of the two shares


def test_corpus_bootstrap_and_resamples_are_whole(spark):
    from conftest import DATA, plain
    from tallyline.plans.frames import facts, series, table
    from tallyline.queries import QUERIES

    got = QUERIES["st_12_bootstrap"](spark, "/root/testdata/sf0.01").collect()
    assert {r["n"] for r in got} == {table(spark, "/root/testdata/sf0.01", "documents").filter("lang IS NOT NULL").count()}
    whole = lb.stability(series(facts(spark, DATA, "overlap_f1"), "overlap_f1"), draws=400)
    assert plain(QUERIES["st_21_stability"](spark, DATA).collect()) == plain(whole.collect())


def test_strengths_take_the_draws_of_the_operator(spark, monkeypatch):
    from conftest import DATA
    from tallyline.operators import agreement as agr
    from tallyline.queries import QUERIES

    seen = []
    real = agr.bradley_terry
    monkeypatch.setattr(agr, "bradley_terry", lambda *a, **k: seen.append(k.get("resamples", 200)) or real(*a, **k))
    assert QUERIES["st_31_bradley_terry"](spark, DATA).count() > 0 and seen == [200]


def test_long_opponents_stay_in_the_family(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("d", a, f"i{i:02}", round(rng.random(), 4)) for a, n in (("mine", 40), ("long", 40), ("short", 10), ("two", 2)) for i in range(n)]
    by = {a: {i: v for _, b, i, v in rows if b == a} for a in ("mine", "long")}
    monkeypatch.setattr(sf, "DRAWN", 20)
    got = {r["config_id"]: r for r in pr.family_test(spark.createDataFrame(rows, SERIES), "mine").collect()}
    d = np.array([round(by["mine"][i] - by["long"][i], 9) for i in sorted(by["mine"])])
    assert got.keys() == {"long", "short"}
    assert got["long"]["p"] == pytest.approx(sf.limit_p(d.sum(), float(d @ d))) and got["long"]["delta"] == pytest.approx(d.mean()) and got["long"]["n"] == 40
    assert min(r["threshold"] for r in got.values()) == pytest.approx(0.05 / 2)


def test_family_of_every_dataset(spark, tmp_path):
    from tallyline.queries import QUERIES

    d = predictions(spark, tmp_path, [(a, f"i{i}", x * i) for a, x in (("opal_l", 0.1), ("other", 0.05)) for i in range(5)])
    assert [(r["dataset_id"], r["config_id"], r["n"]) for r in QUERIES["st_11_family"](spark, d).collect()] == [("d", "other", 5)]


def test_split_draws_are_the_same_draws(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("d", a, f"i{i:03}", round(rng.random(), 4)) for a in ("base", "mine", "x", "y") for i in range(45)]
    s = spark.createDataFrame(rows, SERIES)
    whole = {r["config_id"]: r["p"] for r in pr.compare(s, "base").collect()}
    family = {r["config_id"]: r["p"] for r in pr.family_test(s, "mine", permutations=300).collect()}
    monkeypatch.setattr(pr, "TASK_DRAWS", 45 * 7)  # parts of seven passes
    assert {r["config_id"]: r["p"] for r in pr.family_test(s, "mine", permutations=300).collect()} == family
    monkeypatch.setattr(pr, "TASK_DRAWS", 45 * 3000)
    assert {r["config_id"]: r["p"] for r in pr.compare(s, "base").collect()} == whole


def test_interval_ends_are_where_the_test_turns():
    rng = np.random.default_rng(4)
    for n in (6, 9, 14, 18):
        d = np.round(rng.normal(0.2, 0.5, n), 2)
        low, high = sf.interval(d)
        step = 1e-9 * (1 + np.abs(d).max())
        assert sf.exact_p(d - high + 10 * step) > sf.ALPHA >= sf.exact_p(d - high - 10 * step) and sf.exact_p(d - low - 10 * step) > sf.ALPHA >= sf.exact_p(d - low + 10 * step)


def test_stability_inside_and_outside_of_a_task(spark):
    rng = random.Random(3)
    rows = [("d", a, f"i{i:03}", round(m + rng.random(), 4)) for a, m in (("a", 0.5), ("b", 0.3), ("c", 0.0)) for i in range(60)] + [("small", a, f"i{i}", 1.0) for a in "abc" for i in range(5)]
    s = spark.createDataFrame(rows, SERIES)
    inside, outside = (sorted(tuple(r) for r in lb.stability(s, draws=30, cells=c).collect()) for c in (lb.CELLS, 0))
    assert [r[:2] for r in inside] == [("d", 10), ("d", 20)] and len(outside) == 2
    for a, b in zip(inside, outside, strict=True):
        assert a[2:] == pytest.approx(b[2:])
    assert lb.stability(s.limit(0)).count() == 0


def test_rank_tests_dealt_to_tasks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("d", a, f"i{i:03}", round(m + rng.random(), 4)) for a, m in (("a", 0.06), ("b", 0.0), ("c", 0.0)) for i in range(90)]
    s = spark.createDataFrame(rows, SERIES)
    one = {r["config_id"]: r for r in lb.significance(s, shuffles=2000, resamples=2000).collect()}
    monkeypatch.setattr(lb, "TASK_CELLS", 30)
    many = {r["config_id"]: r for r in lb.significance(s, shuffles=2000, resamples=2000).collect()}
    for a in "abc":
        assert many[a]["avg_rank"] == pytest.approx(one[a]["avg_rank"]) and many[a]["p"] == pytest.approx(one[a]["p"], abs=0.04) and many[a]["p_first"] == pytest.approx(one[a]["p_first"], abs=0.04)


def test_ranks_of_ties_at_the_head():
    assert lb.ranks_of(np.array([[1.0, 1.0 + 0.8e-9, 1.0 + 1.6e-9, 3.0], [2.0, 1.0, 2.0, 2.0]])).tolist() == [[1.5, 1.5, 3.0, 4.0], [3.0, 1.0, 3.0, 3.0]]


def test_bradley_terry_resamples(spark, monkeypatch):
    from tallyline.operators import agreement as agr

    rng = random.Random(9)
    p = {"a": 4.0, "b": 2.0, "c": 1.0}
    rows = []
    for i in range(300):
        x, y = rng.sample("abc", 2)
        w = 1.0 if rng.random() < p[x] / (p[x] + p[y]) else 0.0
        rows.append(("s", f"i{i % 60}", x, y, w, 1 - w))
    df = spark.createDataFrame(rows, "set_id string, item_id string, a string, b string, wa double, wb double")
    got = {r["arm"]: r for r in agr.bradley_terry(df, "set_id", resamples=300).collect()}
    assert all(r["low"] < r["strength"] < r["high"] for r in got.values()) and got["a"]["strength"] > got["b"]["strength"] > got["c"]["strength"]
    w = np.zeros((3, 3))
    for _, _, x, y, a, b in rows:
        w["abc".index(x), "abc".index(y)] += a
        w["abc".index(y), "abc".index(x)] += b
    s = np.array([got[x]["strength"] for x in "abc"])
    games = w + w.T + 0.5
    np.fill_diagonal(games, 0)
    assert (games * s[:, None] / (s[:, None] + s[None, :])).sum(1) == pytest.approx(w.sum(1) + 0.5, abs=1e-3)  # wins are what the strengths expect
    monkeypatch.setattr(agr, "RESAMPLED_CELLS", 2000)  # dealt to several tasks
    many = {r["arm"]: r for r in agr.bradley_terry(df, "set_id", resamples=300).collect()}
    assert all(many[a]["strength"] == got[a]["strength"] and many[a]["low"] == pytest.approx(got[a]["low"], rel=0.15) and many[a]["high"] == pytest.approx(got[a]["high"], rel=0.15) for a in "abc")
    assert agr.bradley_terry(df.limit(0), "set_id").count() == 0


def test_refits_are_the_same_by_either_way(spark, monkeypatch):
    from tallyline.operators import agreement as agr

    rng = np.random.default_rng(3)
    i, j = np.triu_indices(6, 1)
    keep = rng.random(len(i)) < 0.7
    i, j = i[keep], j[keep]
    wins, losses = rng.integers(0, 9, (5, len(i))).astype(float), rng.integers(0, 9, (5, len(i))).astype(float)
    full = agr.bt_strengths(i, j, wins.sum(0), losses.sum(0), 6)[0]
    assert agr._refitted(i, j, wins, losses, 6, full) == pytest.approx(agr.bt_strengths(i, j, wins, losses, 6, start=full), rel=1e-4)


def test_stored_tests_are_read_and_extended(spark, tmp_path):
    from tallyline.operators.joins import paired

    rng = random.Random(2)
    rows = [("d", a, f"i{i:02}", round(rng.random(), 4)) for a in ("base", "x", "y") for i in range(35)]
    s = spark.createDataFrame(rows, SERIES)
    keys, folder = ["dataset_id", "config_id"], str(tmp_path / "p")
    one = {r["config_id"]: (r["p"], r["stored"]) for r in pr.stored_tests(paired(s.filter("config_id <> 'y'"), "base"), keys, folder, permutations=200).collect()}
    two = {r["config_id"]: (r["p"], r["stored"]) for r in pr.stored_tests(paired(s, "base"), keys, folder, permutations=200).collect()}
    assert one["x"][1] is False and two["x"] == (one["x"][0], True) and two["y"][1] is False
    other = pr.stored_tests(paired(s, "base"), keys, folder, permutations=100).collect()
    assert not any(r["stored"] for r in other)
    assert pr.stored_tests(paired(s.limit(0), "base"), keys, folder).count() == 0


def test_leaderboard_of_names_with_marks(spark):
    from tallyline.plans.reports import leaderboard

    f = spark.createDataFrame([("a#b", "x", "r1", "i1", 0.5), ("a#b", "y", "r2", "i1", 0.7), ("a", "x", "r3", "i1", None)], "dataset_id string, config_id string, run_id string, item_id string, m double")
    got = {(r["dataset_id"], r["config_id"]): (r["position"], r["avg_rank"]) for r in leaderboard(f, "m").collect()}
    assert got == {("a#b", "y"): (1, 1.0), ("a#b", "x"): (2, 2.0), ("a", "x"): (1, None)}
