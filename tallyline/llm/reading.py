"""Problem 9: reading level of prose, by gradient-boosted regression trees over text features.

Features describe length, vocabulary, syntax and cohesion by their distributions in a text and are put on
one scale by language. The trees are trained on the anchors and on texts resampled from
their sentences, so that length says nothing of the level. Cross-validation by source (whole sources are held out; an anchor without
one is a source of its own) gives predictions for unseen texts, from which the cuts between the levels are calibrated and of which
the errors are reported by source or language. Folds and the final model are trained in Spark tasks.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample
from .pairs import LANGUAGES, LanguageDictionary

LEVELS = 5
MIN_WORDS = 60
#: Anchors that may be trained on, chosen by hash of anchor_id.
MAX_ANCHORS = 5_000
RESAMPLED = 24
FOLDS = 8

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d|^\s*\d\d:\d\d:\d\d|^\s*(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b")
_JSON = re.compile(r"^\s*[\[{]\s*(?:[\"{\[].*)?$|^\s*[\]}],?\s*$|^\s*\"[^\"]{1,60}\"\s*:\s")
_TABLE = re.compile(r"^\s*\|.*\|?\s*$|^[^|\t]*(?:\t[^\t]*){2,}$|^\s*[+|][-+=|]{3,}\s*$|^[^\s,]+(?:,[^\s,]*){3,}$")
_SETTING = re.compile(r"^\s*[-#;]?\s*[\w.\-\[\]]{1,50}\s*[:=]\s*[^.!?]{0,60}$|^\s*\[[\w .\-]+\]\s*$")
_CODE = re.compile(r"^\s*(?:def|class|import|from|return|if|elif|else|for|while|try|except|with|func|function|var|let|const|public|private|static|void|int|#include|@\w+|SELECT|INSERT|UPDATE|echo|export|sudo|git|pip|\$)\b.*[(:;={)]|.*[;{}]\s*$|^\s*(?:\$|>>>)\s")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_QUOTE = re.compile(r"^\s*(?:>\s*)+")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyäöüàâéèêëîïôûùáíóúœæ]+")


def sentences(text: str | None) -> tuple[list[str], float]:
    """The sentences of a text's prose and the share of its words that are prose.

    Headings are left out on both sides; fenced blocks, logs, tables, settings, code and JSON are not prose.
    Lines broken inside a sentence are joined, bullets begin a sentence of their own.
    """
    if not text:
        return [], 0.0
    other = 0
    if "```" in text or "~~~" in text:
        def drop(m: re.Match) -> str:
            nonlocal other
            other += len(m[0].split())
            return "\n"

        text = _FENCE.sub(drop, text)
    units: list[str] = []
    prose, now = 0, ""
    for line in text.split("\n"):
        line = _QUOTE.sub("", line) if ">" in line[:12] else line
        x = line.strip()
        if not x or _HEADING.match(line):
            if x and now:
                units.append(now)
                now = ""
            continue
        n = x.count(" ") + 1
        bullet = _BULLET.match(x)
        body = x[bullet.end() :] if bullet else x
        if _LOG.match(body) or _JSON.match(x) or _TABLE.match(x) or _CODE.match(x) or (n <= 12 and _SETTING.match(body)):
            other += n
            if now:
                units.append(now)
                now = ""
            continue
        prose += n
        if bullet or (now and (now.rstrip("\"'”’)*_ ")[-1:] in ".!?…:" or (not now[-1:].isalnum() and now[-1:] not in ",;-–—"))):
            if now:
                units.append(now)
            now = body
        else:
            now = f"{now} {body}" if now else body
    if now:
        units.append(now)
    out = [s for u in units for s in _SPLIT.split(u) if len(s.split()) >= 3]
    return out, prose / max(1, prose + other)


NAMES = (
    "words", "median", "p90", "spread", "chars", "chars_spread", "over6", "over8", "over11", "under4", "syllables", "polysyllables",
    "grade_mean", "grade_high", "variety", "commas", "clauses", "lix", "ari", "overlap", "repeats", "short_sentences", "long_sentences",
)


class Lexicon:
    """The mean level of the anchors in which a word stands, by language."""

    def __init__(self, rows: list[tuple[str, int, str]]) -> None:
        total: dict[tuple[str, str], float] = defaultdict(float)
        n: Counter = Counter()
        for lang, level, text in rows:
            for w in {w.lower() for w in _WORD.findall(text)}:
                total[lang, w] += level
                n[lang, w] += 1
        mean = (LEVELS + 1) / 2
        self.grade = {k: (total[k] + mean) / (n[k] + 1) for k in n if n[k] >= 2}


_KNOWN: dict[str, tuple[int, int]] = {}


def _word(w: str) -> tuple[int, int]:
    """Letters and syllables of a word, kept for the next time (up to a bound)."""
    v = _KNOWN.get(w)
    if v is None:
        v = len(w), len(_VOWELS.findall(w)) or 1
        if len(_KNOWN) < 300_000:
            _KNOWN[w] = v
    return v


def _spread(x: list, mean: float) -> float:
    return math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))


def _at(x: list, q: float) -> float:
    """Quantile of a sorted list, between its neighbours."""
    pos = q * (len(x) - 1)
    i = int(pos)
    return x[i] + (x[min(i + 1, len(x) - 1)] - x[i]) * (pos - i)


def tokenized(said: list[str]) -> tuple[list[list[str]], int]:
    """The words of every sentence in lower case, and the commas and their like."""
    return [t for s in said if (t := _WORD.findall(s.lower()))] or [["x"]], sum(s.count(",") + s.count(";") + s.count(":") for s in said)


def features(tokens: list[list[str]], commas: int, lang: str, lexicon: Lexicon) -> list[float]:
    """One value for each of NAMES."""
    flat = [w for t in tokens for w in t]
    n, m = len(flat), len(tokens)
    sizes = sorted(len(t) for t in tokens)
    known = [_word(w) for w in flat]
    info = np.array(known)
    chars, syl = info[:, 0], info[:, 1]
    get = lexicon.grade.get
    grades = [g for w in flat if (g := get((lang, w)))]
    sets = [{w for w in t if len(w) > 4} for t in tokens]
    overlap = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:])]
    windows = [flat[i : i + 100] for i in range(0, max(1, n - 99), 100)]  # of the whole text
    s_mean, c_mean = n / m, float(chars.mean())
    over6 = np.count_nonzero(chars > 6) / n
    return [
        s_mean, _at(sizes, 0.5), _at(sizes, 0.9), _spread(sizes, s_mean), c_mean, float(chars.std()), over6, np.count_nonzero(chars > 8) / n, np.count_nonzero(chars > 11) / n, np.count_nonzero(chars < 4) / n,
        float(syl.mean()), np.count_nonzero(syl >= 4) / n, sum(grades) / len(grades) if grades else 3.0, sum(g >= 3.7 for g in grades) / len(grades) if grades else 0.3, sum(len(set(w)) / len(w) for w in windows) / len(windows),
        commas / m, commas / n, s_mean + 100 * over6, 4.71 * c_mean + 0.5 * s_mean, sum(overlap) / len(overlap) if overlap else 0.0, 1 - len(set(flat)) / n,
        sum(v <= 8 for v in sizes) / m, sum(v >= 22 for v in sizes) / m,
    ]


class Trees:
    """Gradient-boosted regression trees for squared error, on features cut into bins of equal weight."""

    def __init__(self, rounds: int = 160, depth: int = 3, rate: float = 0.08, least: int = 10, bins: int = 48, share: float = 0.6, seed: int = 7) -> None:
        self.rounds, self.depth, self.rate, self.least, self.bins, self.share, self.seed = rounds, depth, rate, least, bins, share, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rng = np.random.default_rng(self.seed)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        width = max(len(c) for c in cuts) + 1
        binned = np.stack([np.searchsorted(c, x[:, j], "left") + j * width for j, c in enumerate(cuts)], 1)
        self.base = float(y.mean())
        self.trees: list[list[tuple]] = []
        now = np.full(len(y), self.base)
        n_use = max(1, int(self.share * x.shape[1]))
        for _ in range(self.rounds):
            use = rng.choice(x.shape[1], n_use, replace=False)
            tree: list[tuple] = []
            self._grow(tree, binned, y - now, np.arange(len(y)), use, cuts, width, self.depth, now)
            self.trees.append(tree)
        return self

    def _grow(self, tree, binned, r, rows, use, cuts, width, depth, now) -> int:
        at = len(tree)
        tree.append(())
        total, n = r[rows].sum(), len(rows)
        best = -1
        if depth and n >= 2 * self.least:
            # Histograms of all features in use at once.
            flat, size = binned[rows][:, use].ravel(), width * len(cuts)
            c = np.cumsum(np.bincount(flat, minlength=size).reshape(-1, width)[use], 1)[:, :-1]
            s = np.cumsum(np.bincount(flat, np.repeat(r[rows], len(use)), size).reshape(-1, width)[use], 1)[:, :-1]
            ok = (c >= self.least) & (n - c >= self.least)
            gain = np.where(ok, s * s / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total * total / n, 0)
            best = int(gain.argmax()) if gain.max() > 1e-9 else -1
        if best < 0:
            value = self.rate * total / (n + 1)
            now[rows] += value
            tree[at] = (-1, value, 0, 0)
            return at
        j, i = int(use[best // (width - 1)]), best % (width - 1)
        left = binned[rows, j] <= i + j * width
        a = self._grow(tree, binned, r, rows[left], use, cuts, width, depth - 1, now)
        b = self._grow(tree, binned, r, rows[~left], use, cuts, width, depth - 1, now)
        tree[at] = (j, float(cuts[j][i]), a, b)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                j, v, a, b = tree[at]
                if j < 0:
                    out[rows] += v
                elif len(rows):
                    left = x[rows, j] <= v
                    stack += [(a, rows[left]), (b, rows[~left])]
        return out


def _folds(anchors: list[tuple]) -> np.ndarray:
    """The fold of every anchor. Anchors of one source share a fold; sources are dealt in order of level and language."""
    order = sorted(range(len(anchors)), key=lambda k: (anchors[k][2], anchors[k][1], anchors[k][0]))
    dealt: dict = {}
    for k in order:
        dealt.setdefault(anchors[k][4] or ("", k), len(dealt) % FOLDS)
    return np.array([dealt[a[4] or ("", k)] for k, a in enumerate(anchors)])


class Reader:
    """Features, trees and cuts, trained on (anchor_id, lang, level, text, source); the source may be null or left out.

    ``held`` are the predictions of the folds if they have been made elsewhere.
    """

    def __init__(self, anchors: list[tuple], held: list[tuple] | None = None) -> None:
        anchors = self.cleaned(anchors)
        if not anchors:
            raise ValueError("no anchors to learn from")
        self.languages = LanguageDictionary.learn((a[3], a[1]) for a in anchors)
        self._train(anchors, RESAMPLED)
        self.cuts = np.arange(1, LEVELS) + 0.5
        self.held_out: dict[str, float] = {}
        self.by_source: list[tuple[str, int, float, float]] = []
        self.calibrate([self.fold(anchors, f) for f in range(FOLDS)] if held is None else held)

    @staticmethod
    def cleaned(anchors: list[tuple]) -> list[tuple]:
        return [(a[0], a[1].lower(), int(a[2]), a[3], a[4] if len(a) > 4 else None) for a in anchors if a[1] and a[2] and a[3]]

    @staticmethod
    def fold(anchors: list[tuple], f: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Scores, levels and sources (or languages) of the texts that a model without fold ``f`` has not seen; nothing of too few anchors."""
        anchors = Reader.cleaned(anchors)
        of = _folds(anchors) if anchors else np.zeros(0)
        part, out = [a for a, k in zip(anchors, of, strict=True) if k != f], [a for a, k in zip(anchors, of, strict=True) if k == f]
        if len(anchors) < 4 * FOLDS or not part or not out:
            return np.zeros(0), np.zeros(0), []
        model = Reader.__new__(Reader)
        model._train(part, 8)
        raw, lang, y = model._raw(out, 6)
        names = [a[4] or a[1] for a in out for _ in range(7)]
        return model.trees.predict(model._scaled(raw, lang)), y, names

    def calibrate(self, held: list[tuple]) -> None:
        """Cuts between the levels from held-out predictions, and what errors these leave over all and by source."""
        s, y = (np.concatenate([h[i] for h in held] or [np.zeros(0)]) for i in (0, 1))
        if not len(s):
            return
        self.cuts = self._calibrate(s, y)
        names, got = np.array([n for h in held for n in h[2]]), 1 + np.searchsorted(self.cuts, s)
        self.held_out = {"accuracy": float((got == y).mean()), "mean_error": float(np.abs(got - y).mean())}
        self.by_source = [(str(n), int((names == n).sum()), float((got == y)[names == n].mean()), float(np.abs(got - y)[names == n].mean())) for n in np.unique(names)]

    @staticmethod
    def _calibrate(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Between two levels, the middle of the stretch of cuts with the fewest errors, drawn halfway to the middle of the levels as anchors are few."""
        cuts = []
        for k in range(1, LEVELS):
            grid = np.arange(k + 0.2, k + 0.8, 0.02)
            wrong = np.array([((s > c) != (y > k))[(y == k) | (y == k + 1)].sum() for c in grid])
            cuts.append((float(grid[wrong == wrong.min()].mean()) + k + 0.5) / 2)
        return np.array(cuts)

    def _train(self, anchors: list, resampled: int) -> None:
        self.lexicon = Lexicon([(a[1], a[2], a[3]) for a in anchors])
        raw, lang, y = self._raw(anchors, resampled)
        self.scale: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for k in {*lang, ""}:
            rows = raw if k == "" else raw[np.array(lang) == k]
            self.scale[k] = (rows.mean(0), rows.std(0) + 1e-6)
        self.trees = Trees().fit(self._scaled(raw, lang), y)

    def _raw(self, anchors: list, resampled: int) -> tuple[np.ndarray, list[str], np.ndarray]:
        rng = np.random.default_rng(11)
        rows, langs, y = [], [], []
        for _, lang, level, text, _ in anchors:
            said, _ = sentences(text)
            lexicon = self.lexicon
            rows.append(features(*tokenized(said), lang, lexicon))
            langs.append(lang)
            y.append(level)
            for _ in range(resampled):
                want = math.exp(rng.uniform(math.log(MIN_WORDS), math.log(900)))
                some, n = [], 0
                while n < want:
                    s = said[int(rng.integers(len(said)))]
                    some.append(s)
                    n += len(s.split())
                rows.append(features(*tokenized(some), lang, lexicon))
                langs.append(lang)
                y.append(level)
        return np.array(rows), langs, np.array(y, dtype=float)

    def _scaled(self, raw: np.ndarray, lang: list[str]) -> np.ndarray:
        out = np.empty_like(raw)
        names = np.array([k if k in self.scale else "" for k in lang])
        for k in np.unique(names):
            mean, std = self.scale[k]
            out[names == k] = (raw[names == k] - mean) / std
        return out

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """Scores of texts given as sentences, on the scale of the levels."""
        if not texts:
            return np.zeros(0)
        cut = [tokenized(t) for t in texts]
        lang = [self._language(tokens) for tokens, _ in cut]
        raw = np.array([features(*t, k, self.lexicon) for t, k in zip(cut, lang, strict=True)])
        return self.trees.predict(self._scaled(raw, lang))

    def _language(self, tokens: list[list[str]]) -> str:
        """The language that the words speak for, or none."""
        get = self.languages.words.get
        found = [v for t in tokens for w in t if (v := get(w))]
        if not found:
            return ""
        sums = [sum(x) for x in zip(*found, strict=True)]
        return self.languages.order[max(range(len(sums)), key=sums.__getitem__)]

    def level(self, score: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, score)


def train(anchors: DataFrame) -> Reader | None:
    """Trains on at most MAX_ANCHORS rows of ``anchors`` (anchor_id, lang, level, text, and source if there is one), chosen by hash of the id; None without any.

    Every fold, and the final model, is a Spark task.
    """
    spark = anchors.sparkSession
    source = F.col("source").cast("string") if "source" in anchors.columns else F.lit(None).cast("string")
    good = anchors.filter("text IS NOT NULL AND lang IS NOT NULL AND level BETWEEN 1 AND 5").select("anchor_id", "lang", "level", "text", source.alias("source"))
    rows = sorted((tuple(r) for r in bounded_sample(good, "anchor_id", MAX_ANCHORS).collect() if sentences(r["text"])[0]), key=lambda r: r[:3])
    if not rows:
        return None
    shared = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                got = Reader.fold(shared.value, f) if f < FOLDS else Reader(shared.value, [])
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([pickle.dumps(got)])], names=["fold", "got"])

    done = {r["fold"]: pickle.loads(r["got"]) for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "fold long, got binary").collect()}
    reader = done[FOLDS]
    reader.calibrate([done[f] for f in range(FOLDS)])
    return reader


def is_prose(share: float, said: list[str]) -> bool:
    return share >= 0.6 and bool(said)


def levels(documents: DataFrame, reader: Reader | None, *keep: str) -> DataFrame:
    """doc_id, level and score of every document of ``documents`` (doc_id, text) that is prose and has at least 60 words.

    Words count between blanks, over the whole text; null, empty, short and other texts (logs, tables,
    settings, code, JSON lines) are absent; without a reader all are. Columns in ``keep`` are passed on. Texts stay
    where they are.
    """
    schema = "doc_id long, level int, score double" + "".join(f", `{k}` string" for k in keep)
    if reader is None:
        return documents.sparkSession.createDataFrame([], schema)
    src = documents.select("doc_id", "text", *(F.col(k).cast("string").alias(k) for k in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and len(t) >= 2 * MIN_WORDS - 1 and len(t.split()) >= MIN_WORDS:
                    said, share = sentences(t)
                    if is_prose(share, said):
                        rows.append(i)
                        texts.append(said)
            if rows:
                s = reader.score(texts)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(reader.level(s).astype(np.int32)), pa.array(s), *part.columns[2:]], names=["doc_id", "level", "score", *keep])

    return src.mapInArrow(run, schema)
