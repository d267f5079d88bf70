"""ROUGE-1 and summary-level ROUGE-L over stemmed words, and the facets of a summary that rest on them (SF-22)."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

# --- Porter's stemmer (Porter 1980), with the extensions that the common Python implementation makes by default.

# Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "innings": "inning", "outings": "outing", "cannings": "canning",
    "sky": "sky", "die": "die", "lie": "lie", "tie": "tie", "news": "news", "inning": "inning", "outing": "outing", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Endings and what replaces them, each list in the order in which it is tried.
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _form(word: str) -> str:
    """The word as vowels (v) and consonants (c); y is a vowel behind a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", _form(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y; or, in two letters, vowel and consonant."""
    f = _form(stem)
    return (f.endswith("cvc") and stem[-1] not in "wxy") or f == "vc"


def _replaced(word: str, endings, least: int) -> str:
    """The first ending that the word has decides: it is replaced if what stands before it measures ``least``."""
    for end, new in endings:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if _measure(stem) >= least else word
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    stem = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
    if stem is None or "v" not in _form(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _form(stem).endswith("cc") and stem[-1] == stem[-2]:
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word if word.endswith("ss") or not word.endswith("s") else word[:-1]


def _derived(word: str) -> str:
    if word.endswith("alli"):
        return _derived(word[:-2]) if _measure(word[:-4]) > 0 else word
    if word.endswith("logi") and not any(word.endswith(e) for e, _ in SECOND):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replaced(word, SECOND, 1)


def _residual(word: str) -> str:
    for end in FOURTH:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _form(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _residual(_replaced(_derived(word), THIRD, 1))
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


# --- overlaps

_TOKEN = re.compile("[a-z0-9]+")
# Fixed value: what parts sentences.
_SENTENCE_GAP = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def tokens(text: str) -> list[str]:
    """Stemmed runs of a-z and 0-9; words of up to three letters stay as they are."""
    return [stem(x) if len(x) > 3 else x for x in _TOKEN.findall(text.lower())]


def lines(text: str) -> list[str]:
    """One sentence a line; lines that the text has are kept."""
    return [x for part in _SENTENCE_GAP.split(text.strip()) for x in part.strip().split("\n") if x]


def clip(text: str, budget: int) -> str:
    """The first ``budget`` words with the blanks between them."""
    m = re.match(rf"\s*(?:\S+\s+){{0,{max(budget - 1, 0)}}}\S*", text)
    return m[0].strip() if budget > 0 else ""


def common_places(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b. Row i of the table is kept as the set of columns where it steps up."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, row, rows = (1 << len(b)) - 1, 0, [0]
    for x in a:
        u = row | where.get(x, 0)
        row = u & ~(u - ((row << 1) | 1)) & full
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif (rows[i] & ((1 << (j - 1)) - 1)).bit_count() > (rows[i - 1] & ((1 << j) - 1)).bit_count():
            j -= 1
        else:
            i -= 1
    return out


def summary_overlap(reference: str, output: str) -> tuple[float, float, float]:
    """Precision, recall and F1 of summary-level ROUGE-L: each reference sentence's words that any output sentence has in order, each word counted no more often than either text has it."""
    ref, out = [tokens(x) for x in lines(reference)], [tokens(x) for x in lines(output)]
    m, n = sum(map(len, ref)), sum(map(len, out))
    if not m or not n:
        return 0.0, 0.0, 0.0
    left = Counter(x for s in ref for x in s) & Counter(x for s in out for x in s)
    hits = 0
    for s in ref:
        for at in sorted(set().union(*(common_places(s, t) for t in out))):
            if left[s[at]] > 0:
                left[s[at]] -= 1
                hits += 1
    p, r = hits / n, hits / m
    return p, r, 2 * p * r / (p + r) if hits else 0.0


def word_overlap(reference: str, output: str) -> float:
    """F1 of ROUGE-1."""
    a, b = Counter(tokens(reference)), Counter(tokens(output))
    hits = sum((a & b).values())
    return 2 * hits / (a.total() + b.total()) if hits else 0.0


FACETS = ("summary_words", "rouge1", "rougeLsum", "reference_words", "coverage", "concision", "length_vs_reference", "compression")


def facets(output: str | None, reference: str | None, source: str | None = None) -> dict[str, float | None]:
    """What is said of a summary: its words; with a reference ROUGE-1 and ROUGE-Lsum, coverage (recall of the output cut to the reference's
    length), concision (precision of the whole output) and length ratio; with a source the compression. What cannot be said is null."""
    out: dict[str, float | None] = dict.fromkeys(FACETS)
    if output is None:
        return out
    n = len(output.split())
    out["summary_words"] = float(n)
    if reference is None:
        return out
    budget = len(reference.split())
    precision, _, f1 = summary_overlap(reference, output)
    out |= {"rouge1": round(word_overlap(reference, output), 10), "rougeLsum": round(f1, 10), "reference_words": float(budget), "concision": round(precision, 10)}
    out["coverage"] = round(summary_overlap(reference, clip(output, budget) if budget else output)[1], 10)
    if budget:
        out["length_vs_reference"] = round(n / budget, 6)
    if source and source.split():
        out["compression"] = round(n / len(source.split()), 6)
    return out


def summary_facets(output, reference, source):
    """Column function of facets()."""
    return F.pandas_udf(_series_facets, ", ".join(f"{x} double" for x in FACETS))(output, reference, source)


def _series_facets(output: pd.Series, reference: pd.Series, source: pd.Series) -> pd.DataFrame:
    none = lambda x: x if isinstance(x, str) else None
    return pd.DataFrame([facets(none(a), none(b), none(c)) for a, b, c in zip(output, reference, source, strict=True)], columns=FACETS, dtype="float64")
