"""Where a text stops: whole, or inside a word, a sentence or a structure.

``ContextModel`` is counted from all texts. For the one and two words before a place it
counts how often a sentence, or a line of a list, ends there and how often it goes on; it also keeps
the words it has seen inside texts. ``context_model`` counts within tasks and sums by context. ``question`` takes off what was put behind the text (marks,
brackets, rules, tags) and looks at what is left: JSON must parse, fences must close, prose must
end its sentence, a last list item must be one that could end, a last word must be a word. What only the corpus can tell is
left as a question of a few words, and ``answer`` looks these up. A model too large for a task holds its most frequent counts;
questions that it can't answer are joined with the table of all counts (``settled``).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import durable_table, joined

WHOLE, CUT, EMPTY = "whole", "cut", "empty"
#: Ends like a whole text, but with something that could have gone on: cut if the text is as long as its store allows.
OPEN = "open"
#: Endings by code, from the best to the worst.
CODES = {WHOLE: 0, EMPTY: 1, OPEN: 2, CUT: 3}

_SPACE = " \t\r\n ​‌‍⁠﻿­"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:[_\-]\w+)*|\d+(?:[.,]\d+)*|\w+")
_PIECE = re.compile(rf"({_TOKEN.pattern})(\W*)")
_MARK = re.compile(
    r"(?:\s*(?:\[(?:\+\s*\d+\s*\w+|…|\.\.\.|(?:text |output |response )?(?:truncated|cut(?: off)?|continued|more|clipped|snip(?:ped)?|abridged|omitted|gekürzt|tronqué|truncado)[^\]]*)\]"
    r"|\((?:more|continued|cont\.?|cut|truncated|\.\.\.|…|\+\s*\d+[^)]*)\)"
    r"|<(?:cut|truncated|snip|more|eot|eos|end)\s*/?>|<\|[^|<>]*\|>|>>>|\{\{?more\}?\}))\s*$", re.I)  # fmt: skip
_TAG_END = re.compile(r"</?[A-Za-z][A-Za-z0-9]*\s*/?>\s*$")
_RULE = re.compile(r"\n\s*(?:-{3,}|\*{3,}|_{3,}|={3,})\s*$")
_DOTS = re.compile(r"(?:…|\.{3,})\s*$")
_CLOSERS = "\"'”’»)]}*_`✓✔"
#: All marks that end sentences, in any script, by their Unicode property.
_TERMINAL = "".join(regex.findall(r"\p{Sentence_Terminal}", "".join(chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000)))
_STOP = re.compile(f"[{re.escape(_TERMINAL)}]")
#: Scripts that write sentences without a mark at their end (Thai, Lao): such an ending says nothing.
_UNMARKED = re.compile("[\u0e00-\u0eff]$")
#: Contexts and words that a model holds in memory; of more, the most frequent, and the others stay in a table.
MODEL_ENTRIES = 400_000
#: What is seen less often than once in so many texts may be the rest of a cut word.
TEXTS_A_COUNT = 20_000
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 500_000
_ITEM = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*+•])\s+")
_FENCE = re.compile(r"```")
_PAIR_LINE = re.compile(r"^\s*[\"']?[\w .\-]{1,40}[\"']?\s*[:=]\s*\S.*$")
_NUMBER_END = re.compile(r"\d[\d.,]*[%€$]?$")


def norm(token: str) -> str:
    """Numbers, version numbers and identifiers stand for their kind."""
    if token[0].isdigit():
        return "9.9" if "." in token[:-1] or "," in token[:-1] else "9"
    if "_" in token:
        return "id"
    return token.lower()


KINDS = ("ends", "goes_on", "words", "alone")


class ContextModel:
    """Counts of what follows a context; contexts are the last one or two words.

    ``table`` has all counts (kind, key, n) if the model holds only a part of them, else it is None. Tasks get the
    model without the table.
    """

    def __init__(self) -> None:
        self.table: DataFrame | None = None
        self.partial = False
        self.ends: Counter = Counter()
        self.goes_on: Counter = Counter()
        self.words: Counter = Counter()
        self.alone: Counter = Counter()
        self.texts = 0

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def learn(self, texts: Iterable[str]) -> ContextModel:
        """The model of the texts."""
        return self.add(texts).closed()

    def add(self, texts: Iterable[str]) -> ContextModel:
        for text in texts:
            if not text:
                continue
            self.texts += 1
            text = _strip_marks(text.strip(_SPACE))[0]
            if text[-1:] in ("…", "."):
                text = _DOTS.sub("", text)
            lines = text.split("\n")
            if len(lines) == 1 and len(text) < 40:
                self.alone[text.strip(" .!").lower()] += 1
            for k, line in enumerate(lines):
                self._line(line, k < len(lines) - 1, bool(_ITEM.match(line)))
        return self

    def _line(self, line: str, more: bool, item: bool) -> None:
        found = _PIECE.findall(line.lower())
        if not found:
            return
        tokens = [t if t.isalpha() else norm(t) for t, _ in found]
        pairs = list(zip(["", *tokens], tokens))
        gap = found[-1][1]
        stop = bool(_STOP.search(gap)) if gap else False
        # Words are the marginals of the pairs; what norm() changes is counted by itself, as is a last word that no pair has.
        self.words.update([t for t, _ in (found if more else found[:-1]) if not t.isalpha()])
        if (stop and (more or len(gap.strip()) <= 3)) or (more and item):
            self.ends[pairs[-1]] += 1
            if not more and tokens[-1].isalpha():
                self.words[tokens[-1]] -= 1
        elif more and tokens[-1].isalpha():
            self.words[tokens[-1]] += 1
        # A mark without a blank behind it stands inside something.
        at = [i for i, (_, g) in enumerate(found[:-1]) if g != " " and g[-1:].isspace() and _STOP.search(g)]
        if at:
            self.ends.update([pairs[i] for i in at])
            for i in reversed(at):
                del pairs[i]
        self.goes_on.update(pairs[:-1])

    def held(self) -> int:
        return len(self.ends) + len(self.goes_on) + len(self.words) + len(self.alone)

    def closed(self) -> ContextModel:
        """The model of what was counted, with the counts of single words, which are sums over their pairs."""
        model = ContextModel()
        model.texts, model.alone = self.texts, self.alone
        words = Counter(self.words)
        for mine, its in ((self.ends, model.ends), (self.goes_on, model.goes_on)):
            its.update(mine)
            for (_, t), n in mine.items():
                its[t] += n
                if t.isalpha() and t != "id":
                    words[t] += n
        model.words = Counter({w: n for w, n in words.items() if n > 0})
        return model

    def counts(self) -> Iterator[tuple[int, str, int]]:
        """(kind, key, count) of everything in a closed model; the texts themselves are of a kind of their own."""
        yield len(KINDS), "", self.texts
        for kind, name in enumerate(KINDS):
            for k, n in getattr(self, name).items():
                yield kind, k if isinstance(k, str) else "\0".join(k), n

    @staticmethod
    def of(rows: Iterable[tuple[int, str, int]]) -> ContextModel:
        """The model of counts as counts() gives them."""
        model = ContextModel()
        tables = [getattr(model, name) for name in KINDS]
        for kind, key, n in rows:
            if kind == len(KINDS):
                model.texts = n
                continue
            tables[kind][_entry(kind, key)] = n
        return model

    def pruned(self, least: int = 2) -> ContextModel:
        """Without what was seen less than ``least`` times: bounds the model by the sample."""
        for name in KINDS:
            c = getattr(self, name)
            setattr(self, name, Counter({k: v for k, v in c.items() if v >= least}))
        return self

    def can_end(self, tokens: list[str]) -> float:
        """How likely a sentence or line ends after these (raw) words, 0 to 1."""
        if not tokens:
            return 0.0
        last = norm(tokens[-1])
        pair = (norm(tokens[-2]) if len(tokens) > 1 else "", last)
        e, g = self.ends[pair], self.goes_on[pair]
        e1, g1 = self.ends[last], self.goes_on[last]
        alone = e1 / (e1 + g1 + 1)
        if last in ("9", "9.9", "id") and e + g == 0:
            alone *= 0.3
        return (e + 2 * alone) / (e + g + 2)

    def known(self, word: str) -> bool:
        w = word.lower()
        return w in self.words or w in self.alone

    def holds(self, asked: Asked) -> bool:
        """Whether the model has every count that the answer rests on."""
        return not self.partial or all(_entry(kind, key) in getattr(self, KINDS[kind]) for kind, key in looked_up(asked))


def _entry(kind: int, key: str) -> str | tuple[str, ...]:
    """The key of a count, as the model's tables have it."""
    return tuple(key.split("\0")) if kind < 2 and "\0" in key else key


def context_model(texts: DataFrame, text: str, entries: int = MODEL_ENTRIES) -> ContextModel:
    """The model counted from every row of ``texts``: summed within tasks, then by context.

    What was seen twice or more and once in ``TEXTS_A_COUNT`` texts is kept, so that the model is alike at every size
    of a corpus. If that is more than ``entries``, the model holds the most frequent of it, which bounds what the driver and the
    tasks hold, and is partial: all that is kept stays in ``table``, for settled(). Null texts count for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(m: ContextModel) -> Iterator[pa.RecordBatch]:
            if m.texts:
                kind, key, n = zip(*m.counts(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key), pa.array(n, pa.int64())], names=["kind", "key", "n"])

        model = ContextModel()
        for b in batches:
            model.add(b.column(0).to_pylist())
            if model.held() > HELD_COUNTS:
                yield from flush(model.closed())
                model = ContextModel()
        yield from flush(model.closed())

    part = texts.select(text).filter(F.col(text).isNotNull()).mapInArrow(run, "kind int, key string, n long")
    whole = durable_table(part.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter(f"n >= 2 OR kind = {len(KINDS)}"))
    total = whole.filter(F.col("kind") == len(KINDS)).agg(F.max("n")).first()[0] or 0
    steps = [max(2, -(-total // TEXTS_A_COUNT)) * 2**k for k in range(40)]
    sizes = whole.agg(*(F.count_if(F.col("n") >= x).alias(str(k)) for k, x in enumerate(steps))).first()
    least = next(x for k, x in enumerate(steps) if sizes[str(k)] <= entries)
    got = whole.filter((F.col("n") >= least) | (F.col("kind") == len(KINDS))).toPandas()
    model = ContextModel.of(zip(got["kind"], got["key"], got["n"], strict=True))
    if least > steps[0]:
        model.partial, model.table = True, whole.filter((F.col("n") >= steps[0]) & (F.col("kind") < len(KINDS)))
    return model


#: What an ending asks of the corpus: a kind of question and the words it is about (see answer).
Asked = tuple[str, ...]


def _context(tokens: list[str]) -> tuple[str, str]:
    return norm(tokens[-2]) if len(tokens) > 1 else "", norm(tokens[-1])


def looked_up(asked: Asked) -> list[tuple[int, str]]:
    """(kind, key) of all counts that the answer to ``asked`` rests on, as ContextModel.counts() names them."""
    kind, *words = asked
    if kind == "version":
        return [(k, f"{words[0]}\0{x}") for k in (0, 1) for x in ("9.9", "9")]
    whole = {"known": words, "alone": words[1:], "item": words[:1]}.get(kind, [])
    keys = [(k, w.lower()) for w in whole for k in (2, 3)]
    if kind == "alone":
        keys.append((3, words[0]))
    if kind in ("item", "number", "dots"):
        before, last = words[-2:]
        keys += [(k, x) for k in (0, 1) for x in (f"{before}\0{last}", last)]
    return list(dict.fromkeys(keys))


def answer(asked: Asked, model: ContextModel) -> str:
    """The ending that a question leaves to the corpus, by kind:

    ``version`` (word): a point after a number, where the word stands before version numbers only; ``known`` (word): a last word; ``alone`` (text,
    words): a text of one or two words; ``item`` (word, context), ``number`` (context): a last item of a list; ``dots`` (context): prose before
    an ellipsis.
    """
    kind, *words = asked
    if kind == "version":
        versions, plain = (model.ends[words[0], x] + model.goes_on[words[0], x] for x in ("9.9", "9"))
        return CUT if versions > 20 * (plain + 0.2) else OPEN
    if kind == "known":
        sound = model.known(words[0])
    elif kind == "alone":
        sound = model.alone[words[0]] or (len(words) > 1 and all(map(model.known, words[1:])))
    else:
        likely = model.can_end([w for w in words[-2:] if w])
        sound = likely >= {"item": 0.05, "number": 0.1, "dots": 0.04}[kind] and (kind != "item" or model.known(words[0]))
    return WHOLE if sound else CUT


def settled(rows: DataFrame, model: ContextModel) -> DataFrame:
    """``rows`` (call_id, ending, asked and others) without ``asked``, with the codes of endings that were left open as questions.

    The distinct questions are joined with the counts they rest on, from the table of all counts, and the answers with the rows.
    Texts take no part in this. Nothing is done for a model that holds all counts.
    """
    if not model.partial:
        return rows.drop("asked")

    @F.pandas_udf("array<struct<kind: int, key: string>>")
    def keys(asked: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "key": x} for k, x in looked_up(tuple(a))] for a in asked], dtype=object)

    @F.pandas_udf("int")
    def told(asked: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([CODES[answer(tuple(a), ContextModel.of((x["kind"], x["key"], x["n"]) for x in c))] for a, c in zip(asked, counts, strict=True)], dtype="int32")

    rows = durable_table(rows)
    open_ones = rows.filter(F.col("asked").isNotNull())
    wanted = open_ones.select("asked").distinct().select("asked", F.explode(keys("asked")).alias("k")).select("asked", "k.*")
    found = wanted.join(model.table, ["kind", "key"], "left").groupBy("asked").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("kind", "key", "n"))).alias("counts"))
    answers = durable_table(found.select("asked", told("asked", "counts").alias("told")))
    now = joined(open_ones.drop("ending"), answers, ["asked"], answers.count(), "call_id").withColumnRenamed("told", "ending")
    return rows.filter(F.col("asked").isNull()).unionByName(now).drop("asked")


def _tail_tokens(s: str, n: int = 3) -> list[str]:
    return [m[0] for m in _TOKEN.finditer(s[-160:])][-n:]


def _sentence(s: str) -> str | Asked:
    """Prose: does it stop at the end of a sentence?"""
    s = s.rstrip(_SPACE)
    dots = s[-1:] in ("…", ".") and bool(_DOTS.search(s))
    core = _DOTS.sub("", s).rstrip(_SPACE) if dots else s
    bare = core.rstrip(_CLOSERS + _SPACE)
    if not bare:
        return EMPTY
    if _UNMARKED.search(bare):
        return OPEN
    if bare[-1] in _TERMINAL:
        if bare[-1] == "." and len(bare) > 1 and bare[-2].isdigit():
            t = _tail_tokens(bare, 2)
            return ("version", norm(t[0])) if len(t) == 2 and norm(t[1]) == "9" else OPEN
        return WHOLE
    if dots and (t := _tail_tokens(bare)):
        return "dots", *_context(t)
    return CUT


def _strip_marks(s: str) -> tuple[str, bool]:
    """Without marks put behind the text, and whether one of them says that it was cut."""
    marked = False
    while True:
        s = s.rstrip(_SPACE)
        last = s[-1:]
        if last.isalnum() or last in _TERMINAL:
            return s, marked
        if last in ")]}>" and (m := _MARK.search(s)):
            s, marked = s[: m.start()], True
        elif last == ">" and (m := _TAG_END.search(s)) and m.start() > 0:
            s = s[: m.start()]
        elif last in "-*_=" and (m := _RULE.search(s)):
            s = s[: m.start()]
        else:
            return s, marked


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [x for v in value.values() for x in _strings(v)]
    if isinstance(value, list):
        return [x for v in value for x in _strings(v)]
    return []


def json_part(s: str):
    """(value, rest) if a JSON object or array stands in s, bare, fenced or between sentences; (None, None) if one begins but does not parse."""
    at = min((p for p in (s.find('{"'), s.find("{\n"), s.find('[{"'), s.find("[\n"), s.find('["')) if p >= 0), default=-1)
    if at < 0:
        return None
    try:
        value, end = json.JSONDecoder().raw_decode(s, at)
    except ValueError:
        return None, None
    return value, s[end:]


# Marks and markup up to the first character that says something.
_NOTHING = re.compile(r"(?:```[\w+-]*|<[^<>]*>|&(?:nbsp|#160|#xa0|zwnj|shy);|[\W_])*+", re.I)
_ANY = re.compile(r"[^\W_]")


def is_empty(text: str | None) -> bool:
    """Null, or nothing but blanks, marks and markup, however long."""
    return not text or _NOTHING.match(text).end() == len(text)


def inspect(text: str | None, model: ContextModel) -> str:
    """``whole``, ``cut``, ``open`` or ``empty`` (see is_empty), by what the model holds."""
    q = question(text)
    return q if isinstance(q, str) else answer(q, model)


def judged(text: str | None, model: ContextModel) -> str | Asked:
    """As inspect(); the question itself where a partial model does not hold the answer."""
    q = question(text)
    return answer(q, model) if not isinstance(q, str) and model.holds(q) else q


def question(text: str | None) -> str | Asked:
    """``whole``, ``cut``, ``open`` or ``empty`` (see is_empty), or what has to be asked of the corpus to tell."""
    if is_empty(text):
        return EMPTY
    s = text.rstrip(_SPACE)
    if s[-1] == "�":
        return CUT
    s, marked = _strip_marks(s)
    if not s:
        return EMPTY
    fences = len(_FENCE.findall(s)) if "`" in s else 0
    if fences % 2:
        return CUT
    if s[0] in "{[" or '{"' in s or "{\n" in s:
        got = json_part(s)
        if got is not None:
            value, rest = got
            if rest is None:
                return CUT
            rest = rest.strip(_SPACE + "`")
            if rest and len(_TOKEN.findall(rest)) > 1:
                return _tail(rest)
            said = _strings(value)
            if said and len(said[-1].split()) >= 3:
                return _tail(said[-1])
            longest = max(said, key=len, default="")
            return _tail(longest) if len(longest.split()) >= 5 else WHOLE
    if fences and s.endswith("```"):
        body = s[: s.rstrip("`").__len__()].rstrip(_SPACE)
        opened = body.rfind("```")
        lines = body[opened:].split("\n")[1:]
        if lines and sum(bool(_PAIR_LINE.match(x)) for x in lines[:-1]) == len(lines) - 1:
            return WHOLE if _PAIR_LINE.match(lines[-1]) or not lines[-1].strip() else CUT
        return WHOLE
    if marked and not s.rstrip(_CLOSERS).endswith(tuple(_TERMINAL)):
        return CUT
    return _tail(s)


def _tail(s: str) -> str | Asked:
    """Prose, lists, labels, headings and sign-offs."""
    s = s.rstrip(_SPACE)
    if not s:
        return EMPTY
    line = s[s.rfind("\n") + 1 :]
    bare = _DOTS.sub("", line).rstrip(_CLOSERS + _SPACE)
    if bare and bare[-1] in _TERMINAL and not re.fullmatch(r"\s*(?:\d{1,3}[.)]|[-*+])", bare):
        return _sentence(s)
    several = "\n" in s
    tokens = _tail_tokens(bare)
    if several and not tokens:
        return CUT if re.fullmatch(r"\s*(?:\d{1,3}[.)]|[-*+])?\s*", bare) else WHOLE
    if several and _ITEM.match(line):
        body = _ITEM.sub("", bare)
        above = s[: s.rfind("\n")].rstrip(_SPACE).split("\n")[-1]
        if above and _ITEM.match(above) and above.rstrip(_CLOSERS + _SPACE)[-1:] in _TERMINAL:
            return _sentence(line)  # items of this list are sentences
        t = _tail_tokens(body)
        if not t or (line.count("(") > line.count(")")):
            return CUT
        return ("number", *_context(t)) if t[-1][0].isdigit() else ("item", t[-1].lower(), *_context(t))
    if _aside(line, several):
        if line.count("(") > line.count(")") or line.count("[") > line.count("]"):
            return CUT
        if _NUMBER_END.search(bare) or line.rstrip().endswith((")", "]")):
            return WHOLE
        return ("known", tokens[-1].lower()) if tokens else CUT
    if not several and len(line) < 40 and len(line.split()) <= 2:
        return "alone", bare.strip(" .!").lower(), *(t.lower() for t in tokens)
    return _sentence(s)


_ASIDE = (
    re.compile(r"^#{1,6}\s+\S"), re.compile(r"^\(?[\w .\-]+,\s*[\w.\-]+\)?$"), re.compile(r"^[—–-]{1,2}\s*[\w .]+$"), re.compile(r"^\[\d+\]\s*\S"),
    re.compile(r"^[\w ]+ vs\.? [\w ]+(?::\s*[\d.]+)?$"), re.compile(r"^[\w .]{1,40}\s*[=:]\s*[\d.]+%?$"), re.compile(r"^\w+(?:[_-]\w+)+$"), re.compile(r"^\([\w ]*$"),
)


def _aside(line: str, several: bool) -> bool:
    """A line that ends no sentence because it is none: heading, sign-off, reference, measured value."""
    x = line.strip(_SPACE)
    return several and len(x) < 70 and any(p.match(x) for p in _ASIDE)
