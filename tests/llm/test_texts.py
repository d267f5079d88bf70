import html
import json
import random

import numpy as np
import pytest

from conftest import DATA
from tallyline.llm import endings as en
from tallyline.llm import leakage as lk
from tallyline.llm import packing as pk
from tallyline.llm import pairs as pa
from tallyline.llm import reading as rd
from tallyline.llm import truncation as tr


@pytest.fixture(scope="module")
def model():
    import pandas as pd

    c, r = pd.read_parquet(f"{DATA}/completions.parquet"), pd.read_parquet(f"{DATA}/results.parquet")
    big = pd.read_parquet("/root/testdata/sf0.01/completions.parquet")
    return en.ContextModel().learn(t for t in [*c["text"], *r["output"], *big["text"]] if t).pruned()


WHOLE = [
    "The score drops 79 items on this set.", "trade", "Weather.\n", "- the recorded price\n- an earlier decision\n- the frozen dataset", '{"better": 2, "reason": "The list needs the key."}', '[{"text": "X", "type": "place"}]',
    '```json\n{"better": 1, "reason": "The list needs the key."}\n```', "The log takes the key.\n\n-- \nquill_l", "The log takes the key.\n\n## juniper_qa", "The log takes the key.\n\n(kestrel_sum, 741)", "The log takes the key.\n\n— rater 420",
    "The log takes the key. ✓", "(The log takes the key.)", "The log reads the key with no cost…", "The log takes it:\n\n```yaml\nparsed: 0.7\ncorrect: 0.22\n```", "It works after version 3.1.", '"The list needs the key."',
]
CUT = [
    "The score drops 79 items on th", "The score drops 79 items on this set. The co\n", "1) the frozen dataset\n2) the order of the lea", '{"better": 2, "reason": "The leaderboard page expl"}', '[{"text": "Hov", "type": "number"}, {"te',
    '```json\n[{"text": "Muskisk", "type": "ot', "The log takes it:\n\n```yaml\nparsed: 0.7\ncorre", "The cost report reduces the latency budget during the wee...", "and then the run ch [truncated]", "and the [+421 chars]", "skips the ol (more)",
    "contradi<cut>", "La liste prend une cl�", "skips its own text. The label set predicts the gap wi</p>", "The pilot slice explai\n\n---", "The captured sam)", "The log takes the key.\n\n(jun", "delays the recorded price before version 3.",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_endings(model, text):
    assert en.inspect(text, model) in (en.WHOLE, en.OPEN)


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(model, text):
    assert en.inspect(text, model) == en.CUT


@pytest.mark.parametrize("text", [None, "", " \n", "﻿", "​", "...", "-", '""', "<p></p>", "```json\n\n```", "\xa0\xa0"])
def test_empty_texts(model, text):
    assert en.is_empty(text) and en.inspect(text, model) == en.EMPTY


def test_a_very_long_text(model):
    assert en.inspect("The log takes the key. " * 50_000 + "And the", model) == en.CUT


def test_lengths_under_encodings(spark):
    texts = ['a "b"\n<é>&\'', "😀\\", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    for t, r in zip(texts, df.select(*(c.alias(k) for k, c in tr.lengths(F.col("t")).items())).collect(), strict=True):
        assert r["characters"] == len(t) and r["utf8_bytes"] == len(t.encode()) and r["utf16_units"] == len(t.encode("utf-16-be")) // 2
        assert r["html_characters"] == len(html.escape(t, quote=True).replace("&#x27;", "&#39;")) and r["html_bytes"] == len(html.escape(t, quote=True).replace("&#x27;", "&#39;").encode())
        assert r["json_ascii"] == len(json.dumps(t)) - 2 and r["json_characters"] == len(json.dumps(t, ensure_ascii=False)) - 2 and r["json_bytes"] == len(json.dumps(t, ensure_ascii=False).encode()) - 2
        assert r["crlf_characters"] == len(t.replace("\n", "\r\n")) and r["crlf_bytes"] == len(t.replace("\n", "\r\n").encode())


def test_hidden_limit_is_found(spark):
    rng = random.Random(1)
    words = "the score list reads keeps a key page for now and then finds its own text in one day".split()
    rows = []
    for i in range(600):
        t = ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 12))) for _ in range(rng.randint(2, 9))) + "."
        rows.append((i, "stores" if i % 2 else "whole", t.encode()[:150].decode(errors="ignore") if i % 2 else t))
    rows += [(i + 1000, None, None) for i in range(3)]
    calls = tr.truncated(spark.createDataFrame(rows, "call_id long, source string, text string"))
    rep = {r["source"]: r for r in tr.by_source(calls).collect()}
    cut = sum(len(t) == 150 and t[-1] != "." for _, s, t in rows if s == "stores")
    assert rep["stores"]["n_cut"] == pytest.approx(cut, abs=6) and rep["whole"]["n_cut"] <= 3 and rep["stores"]["n_at_limit"] >= cut
    lim = {(r["source"], r["length"]) for r in tr.limits(tr.records(spark.createDataFrame(rows, "call_id long, source string, text string"))).collect()}
    assert ("stores", 150) in lim and not any(s == "whole" for s, _ in lim)
    assert tr.truncated(spark.createDataFrame([], "call_id long, source string, text string")).count() == 0


@pytest.fixture(scope="module")
def judge(model):
    import pandas as pd

    r = pd.read_parquet("/root/testdata/sf0.01/results.parquet")
    return pa.Judge(model, pa.LanguageDictionary.learn(zip(r["prompt"], r["lang"], strict=True)))


P = "Why did birch_m fall behind on hollis_dedup after version 1.8?"


@pytest.mark.parametrize(("prompt", "output", "want"), [
    (P, None, "empty"), (P, "```\n```", "empty"), (P, "The score drops 79 items on th", "truncated"), (P, "I can't help with that request. Please try another question.", "refusal"),
    (P, "The list reads the key. Regrettably, I must decline to respond here.", "refusal"), (P, "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"), (P, "Lo siento, pero no me es posible responder a esto.", "refusal"),
    (P, "Je suis désolé, mais il m'est impossible d'aider ici. Puis-je vous aider autrement ?", "refusal"), (P, '{"better": null, "reason": "I apologise; I\'d rather not take on this task."}', "refusal"),
    (P, "Unfortunately the second repeat failed, so only one counts. The list reads the key with care.", None), (P, "The report cannot confirm the gap, yet it gives a figure. The list reads the key.", None),
    (P, P, "copied"), (P, P.upper(), "copied"), (P, "Input:\n" + P, "copied"), (P, "The cost report delays the recorded price because the log finds the key.", None),
    (P, "Der Bericht über marl_topics erklärt den Mittelwert der Auswahl und die Liste braucht den Rest mit Mühe.", "other_language"),
    (P + " Answer in German.", "Der Bericht über marl_topics erklärt den Mittelwert der Auswahl und die Liste braucht den Rest mit Mühe.", None),
    (P + " Answer in German.", "The cost report delays the recorded price because the log finds the key.", "other_language"), ("List the places.", '[{"text": "Sein", "type": "number"}]', None),
    (None, "The log finds the key.", None), ("", "The log finds the key.", None),
])
def test_defects(judge, prompt, output, want):
    assert judge.defect(prompt, output) == want


CONTEXT = "The harbour office bought forty lamps in the spring. The mayor opened the bridge before the fair. " * 12


@pytest.mark.parametrize(("prompt", "output", "want"), [
    ("Is it raining now?", "Is it raining now?", True), ("Is it raining now?", "Q: Is it raining now?", True), ("Is it raining now?", "Is it raining now? Yes, since noon.", False), ("Is it raining now?", "Yes.", False),
    ("Tea or coffee?", "Coffee.", False), ("Hi", "Hi", True), (CONTEXT + "\n\nWho opened the bridge?", "Who opened the bridge?", True), (CONTEXT + "\n\nWho opened the bridge?", "The mayor opened the bridge.", False),
    (CONTEXT + "\n\nWho opened the bridge?", "The mayor opened the bridge before the fair.", False), (CONTEXT, CONTEXT[: len(CONTEXT) // 3], True), (CONTEXT, CONTEXT[100 : 100 + len(CONTEXT) * 2 // 3], True),
    ("今天下雨吗？", "今天下雨吗？", True), ("今天下雨吗？", "不，今天是晴天。", False), ("", "", False),
])
def test_copies_of_any_length(prompt, output, want):
    assert pa.Copies().copied(prompt, output) == want


@pytest.mark.parametrize("output", ["Il rapporto mostra che la seconda misura conferma la differenza di cento punti in questa serie.", "这份报告说明第二次测量证实了差异。", "Отчёт показывает, что второе измерение подтверждает разницу.", "Raport pokazuje, że drugi pomiar potwierdza różnicę między seriami."])
def test_languages_beyond_the_dictionary(judge, output):
    assert judge.defect(P, output, "en") in ("other_language", "truncated") and judge.other_language(P, output, "en")


@pytest.mark.parametrize("text", ["यह रिपोर्ट दूसरे माप की पुष्टि करती है।", "هل يؤكد التقرير الفرق؟", "这份报告说明了差异。", "Այս զեկույցը հաստատում է։"])
def test_sentence_ends_of_other_scripts(model, text):
    assert en.inspect(text, model) == en.WHOLE and en.inspect(text[:-1], model) == en.CUT


def test_long_markup_is_empty():
    assert en.is_empty("<div class='x'></div>\n" * 400) and not en.is_empty("<div></div>" * 400 + "word")


def test_counts_over_tasks_are_those_of_one(spark):
    texts = ["The log takes the key. It is short.", "- one\n- two", "The log takes it. ", None, ""] * 3
    got = en.context_model(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t")
    want = en.ContextModel().learn(t for t in texts if t).pruned()
    assert all(getattr(got, k) == getattr(want, k) for k in en.KINDS) and got.texts == want.texts
    assert en.context_model(spark.createDataFrame([(t,) for t in texts], "t string"), "t", entries=5).held() <= 5


def test_answers_rest_on_the_counts_that_are_looked_up(model):
    counts = {(kind, key): n for kind, key, n in model.counts()}
    texts = [*WHOLE, *CUT, "- a\n- in version 3", "It is version 9.", "qzx", "The log takes qzx…", "- the key\n- the qzx", "The key.\n\n# the qzx"]
    asked = {t: q for t in texts if not isinstance(q := en.question(t), str)}
    assert {q[0] for q in asked.values()} == {"version", "known", "alone", "item", "number", "dots"}
    for t, q in asked.items():
        own = en.ContextModel.of((*k, counts[k]) for k in en.looked_up(q) if k in counts)
        assert en.answer(q, own) == en.inspect(t, model)


def test_endings_do_not_depend_on_what_a_model_holds(spark, monkeypatch):
    def found():
        rec = sorted((tuple(r) for r in tr.records(texts).collect()), key=str)
        bad = sorted((r["call_id"], r["defect"]) for r in pa.defects(pairs, pa.learn(pairs)).collect())
        return rec, bad

    texts, pairs = spark.read.parquet(f"{DATA}/completions.parquet"), spark.read.parquet(f"{DATA}/results.parquet")
    more = [(i, "s", t) for i, t in enumerate([*WHOLE, *CUT, "qzx", None, ""] * 2, 10**6)] + [(None, None, "The log takes qzx…")]
    texts = texts.select("call_id", "source", "text").unionByName(spark.createDataFrame(more, "call_id long, source string, text string"))
    whole = found()
    for entries in (0, 300):
        monkeypatch.setattr(en.context_model, "__defaults__", (entries,))
        assert en.context_model(texts, "text").held() <= entries
        assert found() == whole
        assert en.context_model(texts, "text").partial


def test_open_endings_at_a_limit_are_truncated_in_both(spark):
    rows = [(i, "s", "Say it.", "The log takes the key in round " + "x" * (i % 9) + " before 1.", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "call_id long, source string, prompt string, output string, lang string")
    rec = pa.examined(df, pa.learn(df))
    assert set(rec.columns) >= set(tr.LENGTHS) and rec.count() == 20


def test_defects_over_rows(spark, judge):
    s = "call_id long, prompt string, output string, lang string"
    df = spark.createDataFrame([(1, P, None, "en"), (1, P, None, "en"), (2, P, "The log finds the key.", None), (3, None, "", None)], s)
    assert sorted((r["call_id"], r["defect"]) for r in pa.defects(df, judge).collect()) == [(1, "empty"), (3, "empty")]
    assert pa.defects(df.limit(0), judge).count() == 0


def brute_cover(item, doc):
    grams = {tuple(doc[i : i + 7]) for i in range(len(doc) - 6)}
    hit = [False] * len(item)
    for i in range(len(item) - 6):
        if tuple(item[i : i + 7]) in grams:
            hit[i : i + 7] = [True] * 7
    return sum(hit)


def test_search_is_brute_force():
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(40)]
    items = [(f"i{k}", [rng.choice(vocab) for _ in range(rng.randint(7, 40))]) for k in range(60)]
    t = lk.Tables(items)
    for _ in range(60):
        doc = []
        for _ in range(rng.randint(1, 6)):
            doc += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            w = rng.choice(items)[1]
            a = rng.randint(0, len(w) - 1)
            doc += w[a : a + rng.randint(3, 30)]
        got = {k: len(v) for k, v in t.find(doc).items()}
        assert got == {k: c for k, (_, w) in enumerate(items) if (c := brute_cover(w, doc))}


def test_leaks_under_disguise(spark):
    text = "The Kavax ferry company's crew rejected a well-known contract worth 206 crowns because the café in Fovirn announced 485 houses."
    esc = json.dumps({"t": text})
    docs = [(1, f"Before. {text} After."), (2, text.upper().replace(" ", "\n> ")), (3, esc), (4, html.escape(text)), (5, "<p>" + text.replace("ferry", "<b>ferry</b>") + "</p>"), (6, text.replace("contract", "con-\ntract").replace("crew", "c­rew")),
            (7, " ".join(text.split()[:9])), (8, " ".join(text.split()[:5])), (9, None), (10, ""), (11, "The Kavax ferry company said little about its contract.")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("i", text), ("short", "one two three"), ("none", None), (None, text)], "item_id string, text string")
    got = {r["doc_id"]: r["share"] for r in lk.leaks(d, items).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[1] == got[3] == 1.0
    assert {r["doc_id"]: r["share"] for r in lk.leaks(d, items, words_in_a_pass=8).collect()} == got
    assert lk.leaks(d, items.limit(0)).count() == 0 and lk.leaks(d.limit(0), items).count() == 0


def test_short_items_passages_and_joined_scripts(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 30)}"
    items = [(f"i{k}", " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 20, 60])] + [("zh", "今天天气很好我们去公园散步吧"), ("zh2", "你好"), ("mark", "...")]
    docs = [(d, " ".join(word() for _ in range(200))) for d in range(30)] + [(100, "他说今天天气很好我们去公园，散步吧。"), (101, items[8][1][:40]), (102, "说你 好")]
    want = set()
    for d, t in docs:
        text = lk.words(t)
        for i, x in items:
            w = lk.words(x)
            n = min(7, len(w))
            grams = {tuple(text[k : k + n]) for k in range(len(text) - n + 1)} if n else set()
            hit = {j for k in range(len(w) - n + 1) if n and tuple(w[k : k + n]) in grams for j in range(k, k + n)}
            if hit:
                want.add((d, i, len(hit)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert (100, "zh", 14) in want and (102, "zh2", 2) in want and any(d == 101 and i == "i8" for d, i, _ in want) and len(want) > 40
    assert {tuple(r)[:3] for r in lk.leaks(df, it).collect()} == want
    monkeypatch.setattr(lk, "HELD_CHARACTERS", 500)
    assert {tuple(r)[:3] for r in lk.leaks(df, it, words_in_a_pass=15).collect()} == want


@pytest.mark.parametrize(("sizes", "capacity", "least"), [([6, 5, 5, 4], 10, 2), ([7, 6, 4, 3, 3, 3, 2, 2], 10, 3), ([], 10, 0), ([0, 0], 10, 1), ([10] * 5, 10, 5), ([51, 27, 26, 23, 23, 21, 20, 9], 100, 2), ([1] * 95, 10, 10)])
def test_bins_are_few(sizes, capacity, least):
    b = pk.pack(np.array(sizes, dtype=int), capacity)
    used = np.bincount(b, np.array(sizes)) if len(b) else np.array([])
    assert len(used) == least and (not len(used) or used.max() <= capacity)


def test_bins_of_random_sizes():
    rng = np.random.default_rng(5)
    for capacity in (50, 512):
        s = rng.integers(1, capacity + 1, 300)
        b = pk.pack(s, capacity)
        assert np.bincount(b, s).max() <= capacity and len(np.unique(b)) <= len(pk.best_fit(np.sort(s)[::-1], capacity)) and len(np.unique(b)) >= pk.lower_bound(s, capacity)


def test_every_text_is_packed_once_and_whole(spark):
    tokens = spark.createDataFrame([(i, int(x)) for i, x in enumerate([0, 5, 100, 101, 250, 99, 1, 1, 60, 40])] + [(4, 250)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("small", 100), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens long")
    got = pk.fill(tokens, kinds, group=3).collect()
    per, used = {}, {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r["tokens"])
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
    assert {k: sum(v) for k, v in per.items()} == {0: 0, 1: 5, 2: 100, 3: 101, 4: 250, 5: 99, 6: 1, 7: 1, 8: 60, 9: 40} and max(used.values()) <= 100
    assert len(per[4]) == 3 and len(per[3]) == 2 and all(len(v) == 1 for k, v in per.items() if k not in (3, 4)) and {r["container_kind"] for r in got} == {"small"}
    assert pk.fill(tokens.limit(0), kinds).count() == 0


def test_tokens(spark):
    got = {r["doc_id"]: r["tokens"] for r in pk.token_counts(spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


@pytest.fixture(scope="module")
def reader():
    import pandas as pd

    a = pd.read_parquet(f"{DATA}/reading_anchors.parquet")
    return rd.Reader(list(zip(a["anchor_id"], a["lang"], a["level"], a["text"], strict=True)))


def test_held_out_anchors(reader):
    assert reader.held_out["accuracy"] > 0.85 and reader.held_out["mean_error"] < 0.2


@pytest.mark.parametrize(("text", "prose"), [
    ("# Head\n\nThe list reads the key.\nIt is short. " * 9, True), ("- The list reads the key now\n" * 9, True), ("2026-01-01 10:00:00 INFO eval.run n=4\n" * 9, False), ("| a | b |\n|---|---|\n" + "| x | 1 |\n" * 9, False),
    ('{"id": 1, "input": "The list reads the key."}\n' * 9, False), ("model_0: moss_l\n  def f(x): return x[1] + 2\n" * 9, False), ("", False), (None, False),
    ("The list reads the key. It is short.\n" * 9 + "\n```\ntool run --x\n```\n", True),
])
def test_prose(text, prose):
    said, share = rd.sentences(text)
    assert rd.is_prose(share, said) == prose


def test_sources_are_held_out_together(spark, reader):
    import pandas as pd

    a = pd.read_parquet(f"{DATA}/reading_anchors.parquet")
    rows = [(int(i), k, int(lv), t, f"s{n % 20}") for n, (i, k, lv, t) in enumerate(zip(a["anchor_id"], a["lang"], a["level"], a["text"], strict=True))]
    fold = rd._folds(rd.Reader.cleaned(rows))
    assert all(len({f for f, r in zip(fold, rows, strict=True) if r[4] == s}) == 1 for s in {r[4] for r in rows}) and len(set(fold)) == rd.FOLDS
    trained = rd.train(spark.createDataFrame([(*r[:4], "x") for r in rows], "anchor_id long, lang string, level int, text string, other string"))
    assert trained.held_out == pytest.approx(reader.held_out) and {x[0] for x in trained.by_source} == {"en", "de", "fr", "es"} and sum(x[1] for x in trained.by_source) == 7 * len(rows)


def test_variety_is_that_of_the_whole_text():
    same, other = [["w"] * 10] * 10, [[f"w{i}{j}" for i in range(10)] for j in range(10)]
    at = rd.NAMES.index("variety")
    f = lambda tokens: rd.features(tokens, 0, "en", rd.Lexicon([]))[at]
    assert f(same + other) == f(other + same) == pytest.approx((0.01 + 1) / 2)


def test_levels(spark, reader):
    import pandas as pd

    a = pd.read_parquet(f"{DATA}/reading_anchors.parquet")
    rows = [(int(i), t) for i, t in zip(a["anchor_id"], a["text"], strict=True)] + [(900, "Too short."), (901, None), (902, "")]
    got = {r["doc_id"]: r["level"] for r in rd.levels(spark.createDataFrame(rows, "doc_id long, text string"), reader).collect()}
    assert set(got) == set(a["anchor_id"]) and np.mean([got[i] == lv for i, lv in zip(a["anchor_id"], a["level"], strict=True)]) > 0.95
    assert rd.levels(spark.createDataFrame([], "doc_id long, text string"), reader).count() == 0


@pytest.mark.parametrize(("seed", "capacity", "n", "low", "high", "want"), [(120, 200, 105, 0.1, 0.15, 13), (320, 200, 101, 0.2, 0.4, 31), (201, 200, 119, 0.15, 0.3, 28)])
def test_search_finds_what_takes_hundreds_of_nodes(seed, capacity, n, low, high, want):
    rng = np.random.default_rng(seed)
    rng.choice([200, 500, 1000]), rng.integers(20, 120), rng.choice([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5], 2, replace=False)
    sizes = rng.integers(int(low * capacity), int(high * capacity) + 1, n)
    assert pk.pack(sizes, capacity).max() + 1 == want


def test_fillings_are_the_undominated_ones():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(40):
        room, sizes = 30, rng.integers(3, 16, 7)
        count = np.bincount(sizes, minlength=room + 1)
        all_ = {tuple(sorted(c, reverse=True)) for r in range(8) for c in itertools.combinations(sizes.tolist(), r) if sum(c) <= room}

        def dominated(f):
            rest = list(sizes)
            for x in f:
                rest.remove(x)
            left = room - sum(f)
            parts = {sub for r in range(len(f) + 1) for sub in itertools.combinations(f, r)}
            return any(sum(p) < x <= sum(p) + left or (len(p) > 1 and x == sum(p)) for x in rest for p in parts)

        got = [tuple(sorted(f, reverse=True)) for f in pk._Fillings(count, room, room)]
        assert set(got) == {f for f in all_ if not dominated(f)} and len(got) == len(set(got))
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_packing_of_many_reaches_what_it_reached():
    rng = np.random.default_rng(0)
    s = np.r_[rng.integers(257, 500, 500), rng.integers(128, 256, 700), rng.integers(5, 60, 150)]
    n = pk.pack(s, 512).max() + 1
    assert pk.lower_bound(s, 512) <= n <= 690 and n <= len(pk.best_fit(np.sort(s)[::-1], 512))


def test_a_limit_on_sentence_ends_shows_as_the_greatest_length(spark):
    rng = random.Random(3)
    rec = [(i, "s", 0, rng.randint(20, 300)) for i in range(200)] + [(1000 + i, "s", 0, 301) for i in range(12)] + [(2000 + i, "t", 0, rng.randint(20, 300)) for i in range(200)]
    df = spark.createDataFrame(rec, "call_id long, source string, ending int, characters int")
    assert [(r["source"], r["encoding"], r["length"]) for r in tr.limits(df).collect()] == [("s", "characters", 301)]
