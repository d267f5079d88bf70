"""Text scorers as columns: tokens, overlap, n-grams, format flags, rankings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case (SF-15)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def overlap_f1(output: Column, reference: Column) -> Column:
    """F1 of two sets of words, 0 if either is empty (SF-1)."""

    def body(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))

    return let(F.struct(F.array_distinct(words(output)).alias("a"), F.array_distinct(words(reference)).alias("b")), body)


def best_overlap(output: Column, accepted: Column) -> Column:
    """Best F1 over an array of accepted answers."""
    return F.aggregate(accepted, F.lit(0.0), lambda m, r: F.greatest(m, overlap_f1(output, r)))


def output_words(text: Column) -> Column:
    return F.size(words(text))


def ngrams(ts: Column, n: int) -> Column:
    """The distinct n-grams of an array of words, joined by blanks."""

    def body(t: Column) -> Column:
        last = F.size(t) - n
        grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
        return F.when(last >= 0, F.array_distinct(grams)).otherwise(F.expr("CAST(array() AS array<string>)"))

    return let(ts, body)


def grounding(summary: Column, source: Column) -> Column:
    """Share of a summary's distinct bigrams that stand in its source (SF-19)."""
    pair = F.struct(ngrams(tokens(summary), 2).alias("a"), ngrams(tokens(source), 2).alias("b"))
    return let(pair, lambda s: F.coalesce(F.try_divide(F.size(F.array_intersect(s["a"], s["b"])), F.size(s["a"])), F.lit(0.0)))


def rouge_1(summary: Column, reference: Column) -> Column:
    """Unigram F1 over multisets without stemming (SF-22): counts of each word are matched one to one."""

    def body(s: Column) -> Column:
        a, b = s["a"], s["b"]
        hit = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * hit / (F.size(a) + F.size(b)))

    return let(F.struct(tokens(summary).alias("a"), tokens(reference).alias("b")), body)


def format_flags(text: Column, most_words: int = 90) -> dict[str, Column]:
    """Marks of a reply that is not the bare summary asked for (SF-20)."""
    return {
        "narrates": text.rlike(r"(?i)^\s*(here is|here's|this (article|text|passage)|the (article|text|passage) (is|describes|discusses))"),
        "labelled": text.rlike(r"(?i)^\s*(\*\*)?summary(\*\*)?\s*:"), "markdown": text.rlike(r"(?m)^#{1,6} |\*\*[^*]+\*\*"), "bullets": text.rlike(r"(?m)^\s*([-*]|\d+[.)]) "),
        "paragraphs": F.trim(text).contains("\n\n"), "overlong": output_words(text) > most_words,
    }


def sentences(text: Column) -> Column:
    """Sentences by a lookbehind split (SF-21)."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def clip_words(text: Column, budget: int) -> Column:
    """The first words of a text with their blanks."""
    return F.regexp_extract(text, rf"^(?:\s*\S+){{0,{budget}}}", 0)


def text_sha256(text: Column) -> Column:
    """Hash of a text with blanks collapsed (SF-32)."""
    return F.sha2(F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")), 256)


def parse_label(text: Column, aliases: dict[str, str]) -> Column:
    """The label of a reply (SF-3, SF-4): marks and lead-ins off, an alias as a whole, else the alias that stands first as a whole word."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(the )?(answer|label|topic|category)( is)?\s*:?\s*", "")
    bare = F.regexp_replace(bare, r"^[\s\"'`*.\[(]+|[\s\"'`*.!\])]+$", "")
    exact = F.coalesce(*(F.when(bare == a.lower(), v) for a, v in aliases.items()))
    found = F.array_sort(F.filter(F.array(*(F.struct(F.regexp_instr(bare, F.lit(rf"(?<![a-z0-9]){a.lower()}(?![a-z0-9])")).alias("at"), F.lit(v).alias("label")) for a, v in aliases.items())), lambda s: s["at"] > 0))
    return F.coalesce(exact, F.get(found, F.lit(0))["label"])


# --- rankings


def dedupe(ranking: Column) -> Column:
    """First occurrence wins (SF-11)."""
    return F.array_distinct(ranking)


def ranking_scores(ranking: Column, qrels: Column, k: int = 10, deep: int = 100) -> dict[str, Column]:
    """nDCG@k, recall@k and @deep, MRR@k and the first relevant rank of an array of ids against a map id -> grade (SF-12).

    Gains are 2^grade - 1 over log2(place + 1); ids without a grade keep their place and gain nothing; an empty or null
    ranking scores 0.
    """
    r = F.coalesce(ranking, F.expr("CAST(array() AS array<string>)"))
    grade = lambda i: F.coalesce(F.try_element_at(qrels, i), F.lit(0))
    gain = lambda g, pos: (F.pow(F.lit(2.0), g) - 1) / F.log2(pos + 2.0)
    head = F.slice(r, 1, k)
    dcg = F.aggregate(F.transform(head, lambda x, i: gain(grade(x), i)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.slice(F.reverse(F.array_sort(F.filter(F.map_values(qrels), lambda g: g > 0))), 1, k)
    idcg = F.aggregate(F.transform(ideal, lambda g, i: gain(g, i)), F.lit(0.0), lambda s, x: s + x)
    relevant = F.map_keys(F.map_filter(qrels, lambda _, g: g > 0))
    n = F.size(relevant)
    first = F.aggregate(F.transform(r, lambda x, i: F.when(grade(x) > 0, i + 1).otherwise(F.lit(2147483647))), F.lit(2147483647), lambda m, x: F.least(m, x))
    recall = lambda m: F.coalesce(F.try_divide(F.size(F.array_intersect(F.slice(r, 1, m), relevant)), n), F.lit(0.0))
    return {
        "ndcg": F.coalesce(F.try_divide(dcg, idcg), F.lit(0.0)), "recall_k": recall(k), "recall_deep": recall(deep),
        "mrr": F.when(first <= k, 1.0 / first).otherwise(0.0), "first_relevant": F.when(first < 2147483647, first),
    }


def oracle_ndcg(candidates: Column, qrels: Column, k: int = 10) -> Column:
    """nDCG of the best order of the candidates (SF-13)."""
    best = F.transform(F.reverse(F.array_sort(F.transform(candidates, lambda x: F.struct(F.coalesce(F.try_element_at(qrels, x), F.lit(0)).alias("g"), x.alias("x"))))), lambda s: s["x"])
    return ranking_scores(best, qrels, k)["ndcg"]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors (SF-17)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
