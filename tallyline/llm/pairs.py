"""Problem 5: prompt and response pairs that are useless, each with its defect.

Copies: the response is compressed with its prompt as a zstandard dictionary; what costs almost nothing
then is in the prompt already, and a check of word shingles confirms it. Refusals: a
dictionary of first-person refusals. Other language: a dictionary of words by language, learned from
labelled prompts, against the language of the prompt or the one it asks for; a response in a script of its
own, or whose words the dictionary mostly does not give to that language, is in none of the dictionary's languages.
Truncation: the terminal-context model of endings and the storage limits of truncation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import endings, truncation
from .base import bounded_sample, durable

EMPTY, REFUSAL, COPIED, TRUNCATED, OTHER = "empty", "refusal", "copied", "truncated", "other_language"
DEFECTS = (EMPTY, REFUSAL, COPIED, TRUNCATED, OTHER)
LANGUAGES = ("en", "de", "fr", "es")
#: Labelled prompts from which the language dictionary is learned.
SAMPLE = 12_000
#: A response whose compressed size falls to this share by the prompt's dictionary, give or take what one match costs, is a candidate copy.
CANDIDATE, MATCH_COST = 0.55, 12
#: The wanted language must claim this share of a response's words, in responses from LEAST_WORDS up.
CLAIMED, LEAST_WORDS = 0.4, 6

# Fixed values of this project: first-person refusals by language, written as patterns.
REFUSALS = {
    "en": (
        r"\bI(?:['’]m| am)? (?:sorry,? but I )?(?:can(?:not|['’]t|not)|could ?n[o'’]t|won['’]t|will not|must (?:decline|refuse)|(?:have to|need to) (?:decline|refuse)|decline|refuse"
        r"|(?:not|un)\s?able to|not (?:allowed|permitted|comfortable|in a position|going) |(?:do not|don['’]t) (?:feel able|think I can|wish to))"
        r"(?=.{0,60}(?:\b(?:help|assist|answer|respond|comply|provide|fulfil|complete|do that|do this|discuss|support|share|give|task|request|here|this|that)\b|\.))",
        r"\bI(?:['’]d| would) rather not\b", r"\bI (?:must|have to|will have to) (?:decline|refuse|pass)\b", r"\bI(?:['’]m| am) (?:not able|unable) to\b",
        r"\b(?:isn['’]t|is not|not) (?:something I (?:can|could|am able)|possible for me)\b", r"\bsomething I (?:won['’]t|will not|can(?:no|['’])t)\b",
        r"\bagainst my (?:guidelines|policy|policies|rules|principles|instructions)\b", r"\b(?:beyond|outside) (?:what I can|my (?:abilities|scope|remit))\b",
    ),
    "de": (
        r"\b(?:kann|darf|möchte|will|werde) ich (?:\w+ ){0,5}(?:nicht|keine?n?)\b", r"\bich (?:kann|darf|möchte|will|werde|muss)\b[^.!?]{0,60}\b(?:nicht|keine?n?|ablehnen|passen)\b",
        r"\b(?:muss|möchte) ich (?:\w+ ){0,3}(?:ablehnen|verzichten|passen)\b", r"\b(?:übernehme|beantworte|bearbeite|mache|behandle) ich (?:leider )?(?:nicht|keine)\b",
        r"\blehne ich\b", r"\bich lehne\b", r"\bmir (?:leider )?nicht (?:möglich|erlaubt|gestattet)\b",
    ),
    "fr": (
        r"\bje ne (?:peux|puis|suis|souhaite|saurais|veux|vais|pourrai)\b[^.!?]{0,30}\b(?:pas|aider|répondre|traiter|en mesure)", r"\bje ne (?:peux|puis|saurais)\b",
        r"\bje (?:préfère|préférerais) (?:ne pas|m['’]abstenir|éviter)\b", r"\bje (?:dois|me vois contraint(?:e)? de?) (?:décliner|refuser)\b", r"\bje (?:décline|refuse)\b",
        r"\bm['’](?:est|était) (?:impossible|pas possible|interdit)\b", r"\bpas possible pour moi\b", r"\bcontraire à mes (?:règles|consignes|principes)\b",
    ),
    "es": (
        r"\bno (?:puedo|podría|me es posible|estoy (?:autorizado|en condiciones)|quiero|deseo|voy a|debo)\b(?=[^.!?]{0,60}(?:ayudar|responder|atender|tratar|hacer|dar|contestar|cumplir|eso|esto|\.|!))",
        r"\bprefiero no\b", r"\bpreferiría no\b", r"\b(?:debo|tengo que) (?:rechazar|declinar|negarme)\b", r"\bme niego\b", r"\bva contra mis (?:normas|reglas)\b", r"\bno me está permitido\b",
    ),
    "it": (r"\bnon (?:posso|potrei|sono in grado di|mi è possibile)\b(?=[^.!?]{0,60}(?:aiutar|risponder|fornir|soddisfar|far|\.|!))", r"\b(?:devo|preferisco) (?:rifiutare|non)\b"),
    "pt": (r"\bnão (?:posso|poderia|consigo|me é possível)\b(?=[^.!?]{0,60}(?:ajudar|responder|fornecer|atender|fazer|\.|!))", r"\b(?:devo|prefiro) (?:recusar|não)\b"),
    "nl": (r"\bik (?:kan|mag|wil|zal)\b[^.!?]{0,60}\b(?:niet|geen)\b", r"\b(?:kan|mag|wil|zal) ik (?:\w+ ){0,5}(?:niet|geen)\b", r"\bik (?:moet|wil) (?:weigeren|afslaan)\b"),
}
_REFUSAL = re.compile("|".join(p for patterns in REFUSALS.values() for p in patterns), re.I)
# What may stand behind a refusal: offers and advice.
_OFFER = re.compile(r"\b(?:something else|another question|else (?:I|you)|specialist|ask a|andere Frage|sonst etwas|Fachmann|Fachfrau|autre question|autrement|aider|spécialiste|otra (?:cosa|pregunta)|especialista)\b", re.I)

_NAMES = {
    "en": r"english|englisch(?:e|en)?|anglais|ingl[eé]s", "de": r"german|deutsch(?:e|en)?|allemand|alem[aá]n", "fr": r"french|franz[öo]sisch(?:e|en)?|fran[çc]ais|franc[eé]s",
    "es": r"spanish|spanisch(?:e|en)?|espagnol|espa[ñn]ol|castellano",
}
_ASKED = re.compile(r"\b(?:in|into|to|auf|ins|in das|en|al|au|vers l['’]|in plain)\s*(?:the\s+|das\s+|die\s+)?(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _NAMES.items()) + r")\b", re.I)
_WORD = re.compile(r"(?<!\w)[^\W\d_]{2,}(?!\w)")
# One of these stands in every refusal that _REFUSAL finds: a quick way past the other texts.
_HINTS = (
    "can't", "can’t", "cannot", "can not", "could", "won't", "won’t", "will not", "declin", "refus", " able", "unable", "not allowed", "not permitted", "not comfortable", "not in a", "not going",
    "not feel", "n't feel", "not think", "n't think", "not wish", "n't wish", "rather not", "must pass", "to pass", "possib", "something i ", "against my", "beyond what", "beyond my", "outside what", "outside my",
    " ich ", "\nich ", "\"ich ", "„ich ", "(ich ", "mir ",
    "je ne", "je préf", "je dois", "je me", "je déc", "m'est", "m’est", "était", "contraire", "no puedo", "no podría", "no me", "no estoy", "no quiero", "no deseo", "no voy", "no debo",
    "prefiero", "preferir", "rechazar", "negarme", "niego", "mis normas", "mis reglas",
    "non posso", "non potrei", "non sono", "non mi", "devo", "preferisco", "não", "prefiro", " ik ", "\nik ", "\"ik ", "(ik ",
)
_HINTED = ahocorasick.Automaton()
for _h in _HINTS:
    _HINTED.add_word(_h, _h)
_HINTED.make_automaton()
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_NOISE = re.compile(r"```\w*")


class LanguageDictionary:
    """Words with what they say for each language, from labelled texts."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        seen = Counter()
        for c in counts.values():
            seen.update(c.keys())
        total = {k: sum(c.values()) + 1.0 for k, c in counts.items()}
        self.order = tuple(counts)
        self.words: dict[str, tuple[float, ...]] = {}
        for w in seen:
            p = [(counts[k][w] + 0.05) / total[k] for k in self.order]
            if sum(counts[k][w] for k in self.order) < 2:
                continue
            mean = sum(math.log(x) for x in p) / len(p)
            self.words[w] = tuple(max(-4.0, min(4.0, math.log(x) - mean)) for x in p)

    @staticmethod
    def learn(rows: Iterable[tuple[str, str]]) -> LanguageDictionary:
        return LanguageDictionary(LanguageDictionary.count(rows))

    @staticmethod
    def count(rows: Iterable[tuple[str, str]]) -> dict[str, Counter]:
        """Words by language of (text, language) rows; other languages are left out."""
        counts: dict[str, Counter] = {k: Counter() for k in LANGUAGES}
        for text, lang in rows:
            if text and lang and lang.lower() in counts:
                counts[lang.lower()].update(w.lower() for w in _WORD.findall(_NOISE.sub(" ", text)))
        return counts

    def evidence(self, words: list[str], want: str | None = None) -> tuple[list[float], int, int]:
        """Evidence for each language, the number of words it rests on, and how many of these speak for ``want``."""
        get = self.words.get
        found = [v for v in map(get, words) if v]
        if not found:
            return [0.0] * len(self.order), 0, 0
        columns = list(zip(*found, strict=True))
        own = columns[self.order.index(want)] if want in self.order else ()
        return list(map(sum, columns)), len(found), len([x for x in own if x > 0])

    def language(self, text: str) -> str | None:
        """The language that the words speak for, or none. Words between blanks decide if they are clear, else all words do."""
        low = text.lower()
        s, n, _ = self.evidence(low.split())
        if n < 8 or sorted(s)[-1] - sorted(s)[-2] < n:
            s, n, _ = self.evidence(_WORD.findall(low))
        return self.order[max(range(len(s)), key=s.__getitem__)] if n else None


_NOT_LATIN = re.compile("[^\\W\\d_\x00-\u024f\u1e00-\u1eff]")


def foreign_script(text: str) -> bool:
    """Whether most letters are of another script than the dictionary's languages, which are all written in Latin."""
    return not text.isascii() and _NOT_LATIN.search(text) is not None and len(_NOT_LATIN.findall(text)) * 2 > sum(map(str.isalpha, text))


def refuses(text: str) -> bool:
    """Whether the response, as a whole, declines: a first-person refusal with at most one sentence of anything else before it."""
    if next(_HINTED.iter(" " + text.lower()), None) is None or not _REFUSAL.search(text):
        return False
    parts = [p for p in _SENTENCE.split(text.strip()) if p and endings._ANY.search(p)]
    at = [i for i, p in enumerate(parts) if _REFUSAL.search(p)]
    if not at:
        at = [0]
    before, after = at[0], [p for p in parts[at[-1] + 1 :] if not _OFFER.search(p) and not _REFUSAL.search(p)]
    return before <= 1 and len(after) <= 1


_UNIT = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def _units(text: str) -> list[str]:
    """Words, and single characters of scripts that write without blanks."""
    return _UNIT.findall(text.lower())


def _covered(words: list[str], grams: set, n: int) -> list[bool]:
    """Which words stand in one of the stretches of n words."""
    out = [False] * len(words)
    for i in range(len(words) - n + 1):
        if tuple(words[i : i + n]) in grams:
            out[i : i + n] = [True] * n
    return out


def _grams(words: list[str], n: int) -> set:
    return set(zip(*(words[i:] for i in range(n)), strict=False))


class Copies:
    """Finds responses that stand in their prompts."""

    def __init__(self) -> None:
        self.params = zstandard.ZstdCompressionParameters.from_level(1, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.plain = zstandard.ZstdCompressor(compression_params=self.params)

    def sizes(self, prompt: str, response: str) -> tuple[int, int]:
        """Compressed size of the response with the prompt as dictionary, and without."""
        p, r = prompt.lower().encode(errors="replace").rjust(8), response.lower().encode(errors="replace")
        d = zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = self.params if len(p) + len(r) < 1 << 17 else zstandard.ZstdCompressionParameters.from_level(3, source_size=len(p) + len(r), write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(r)), len(self.plain.compress(r))

    def copied(self, prompt: str, response: str) -> bool:
        """The prompt, most of it, its beginning or what it asks, and next to nothing else; of any length.

        A stretch from the middle of a prompt alone is no copy, as an answer may quote its source.
        """
        small, alone = self.sizes(prompt, response)
        return small <= CANDIDATE * alone + MATCH_COST and self._confirmed(prompt, response)

    def _confirmed(self, prompt: str, response: str) -> bool:
        p, r = _units(prompt), _units(response)
        if not p or not r:
            return False
        n = min(3, len(p), len(r))
        from_prompt = _covered(r, _grams(p, n), n)
        foreign = len(r) - sum(from_prompt)
        own, behind = set(p), next((i for i, x in enumerate(reversed(from_prompt)) if x), len(r))
        behind = sum(x not in own for x in r[len(r) - behind :])
        if foreign > max(min(4, len(r) // 3), 0.3 * len(r)) or behind > 0.15 * len(r):
            return False
        again = _grams(r, n)
        if sum(_covered(p, again, n)) >= 0.5 * len(p):
            return True
        if not foreign and len(r) >= 5 and p[: len(r)] == r:
            return True
        return any(self._holds(q, r) for q in self._asked(prompt))

    @staticmethod
    def _asked(prompt: str) -> list[list[str]]:
        """What a prompt asks: its first and last paragraphs where there are several and they are a sentence or two, and questions in them."""
        parts = [x for x in _PARAGRAPH.split(prompt.strip()) if x.strip()]
        out = []
        for x in {0, len(parts) - 1} if parts else ():
            said = [y for y in _SENTENCE.split(parts[x]) if y.strip()]
            if len(parts) > 1 and len(said) <= 2:
                out.append(_units(parts[x]))
            out += [_units(y) for y in said if y.rstrip(" \t\"'”’»)]}*_`")[-1:] in "?؟？"]
        return [x for x in out if len(x) >= 3]

    @staticmethod
    def _holds(asked: list[str], r: list[str]) -> bool:
        n = min(3, len(r))
        return sum(_covered(asked, _grams(r, n), n)) >= 0.8 * len(asked)


class Judge:
    """Labels pairs, with models that are learned once and shared by all tasks."""

    def __init__(self, contexts: endings.ContextModel, languages: LanguageDictionary) -> None:
        self.contexts, self.languages = contexts, languages

    def __getstate__(self):
        return {"contexts": self.contexts, "languages": self.languages}

    def examine(self, prompt: str | None, response: str | None, lang: str | None = None) -> tuple[str | None, str | endings.Asked]:
        """(defect apart from truncation, ending of the response, or what it asks of counts that the model does not hold).

        Without a prompt only the response is looked at. The language of a response that turns out to be cut does not count (see defects).
        """
        if endings.is_empty(response):
            return EMPTY, endings.EMPTY
        ending = endings.judged(response, self.contexts)
        said = self.prose(response)
        if refuses(said if said else response):
            return REFUSAL, ending
        if prompt:
            if not hasattr(self, "copies"):
                self.copies = Copies()
            if self.copies.copied(prompt, response):
                return COPIED, ending
        if ending != endings.CUT and said and self.other_language(prompt, said, lang):
            return OTHER, ending
        return None, ending

    def defect(self, prompt: str | None, response: str | None, lang: str | None = None) -> str | None:
        """The defect of a pair taken by itself, or None if it is sound."""
        d, ending = self.examine(prompt, response, lang)
        return TRUNCATED if ending == endings.CUT and d in (None, OTHER) else d

    def prose(self, response: str) -> str:
        """What is said in words: of JSON its longer strings, else the text."""
        if response[:1] in "{[`" or '{"' in response or "{\n" in response:
            got = endings.json_part(response)
            if got is not None:
                if got[1] is None:
                    return response
                return " ".join(x for x in endings._strings(got[0]) if len(x.split()) >= 3)
        return response

    def other_language(self, prompt: str | None, said: str, lang: str | None) -> bool:
        want = self.wanted(prompt, lang)
        if want is None:
            return False
        if foreign_script(said):
            return True
        low = said.lower()
        words = low.split()
        s, n, claimed = self.languages.evidence(words, want)
        if n >= 8 and claimed > 2 * CLAIMED * len(words) and max(s) == s[self.languages.order.index(want)]:
            return False  # clear from the words between blanks
        words = _WORD.findall(low)
        s, n, claimed = self.languages.evidence(words, want)
        if len(words) >= LEAST_WORDS and claimed < CLAIMED * len(words):
            return True  # of another language, or of none that the dictionary knows
        if not n:
            return False
        best = max(range(len(s)), key=s.__getitem__)
        i = self.languages.order.index(want)
        return best != i and s[best] - s[i] > (2.5 if n <= 2 else 4.0)

    def wanted(self, prompt: str | None, lang: str | None) -> str | None:
        """The language the prompt asks for, else its own."""
        if prompt:
            head, _, rest = prompt.partition("\n\n")
            tail = rest.rsplit("\n\n", 1)[-1] if rest else ""
            for part in (head, tail):
                if len(part) < 300 and (asked := list(_ASKED.finditer(part))):
                    return asked[-1].lastgroup
        if lang and lang.lower() in LANGUAGES:
            return lang.lower()
        return self.languages.language(prompt) if prompt else None


def learn(pairs: DataFrame, sample: int = SAMPLE) -> Judge:
    """Models for ``pairs`` (call_id, prompt, output, lang).

    The terminal contexts are counted from all outputs; the language dictionary is learned from at most ``sample``
    prompts that carry a language label, chosen by hash of the id.
    """
    labelled = pairs.select("call_id", "prompt", "lang").filter(F.lower("lang").isin(*LANGUAGES) & F.col("prompt").isNotNull())
    known = bounded_sample(labelled, "call_id", sample)
    return Judge(endings.context_model(pairs, "output"), LanguageDictionary(_word_counts(known)))


def _word_counts(known: DataFrame) -> dict[str, Counter]:
    """The words of labelled texts by language, counted where they are; a word seen once says nothing and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, w, n) for k, c in LanguageDictionary.count(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)).items() for w, n in c.items()]
            if rows:
                lang, word, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    n = known.select("prompt", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("word").pivot("lang", list(LANGUAGES)).agg(F.sum("n")).na.fill(0)
    got = n.filter(" + ".join(LANGUAGES) + " >= 2").toPandas()
    return {k: Counter({w: int(c) for w, c in zip(got["word"], got[k], strict=True) if c}) for k in LANGUAGES}


def examined(pairs: DataFrame, judge: Judge) -> DataFrame:
    """call_id, source, code of the defect apart from truncation (null if none), ending code and lengths of every pair's output.

    Of repeated rows of a call_id the first defect and the worst ending count. Texts are read where they are;
    what is shuffled is a few numbers a pair.
    """
    source = F.coalesce("source", F.lit("")) if "source" in pairs.columns else F.lit("")
    named = truncation.lengths(F.coalesce("output", F.lit("")))
    rows = pairs.select("call_id", source.alias("source"), "prompt", "output", "lang", *(c.cast("int").alias(n) for n, c in named.items()))
    code, names = {d: i for i, d in enumerate(DEFECTS)}, ["call_id", "source", "code", "ending", "asked", *named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge.examine(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            codes, ends = pa.array([code.get(d) for d, _ in got], pa.int32()), pa.array([truncation.CODES[e] if isinstance(e, str) else None for _, e in got], pa.int32())
            asked = pa.array([None if isinstance(e, str) else list(e) for _, e in got], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, ends, asked, *b.columns[5:]], names=names)

    found = rows.mapInArrow(run, "call_id long, source string, code int, ending int, asked array<string>, " + ", ".join(f"{n} int" for n in named))
    found = endings.settled(found, judge.contexts)
    return found.groupBy("call_id", "source").agg(F.min("code").alias("code"), F.max("ending").alias("ending"), *(F.max(n).alias(n) for n in named))


def defects(pairs: DataFrame, judge: Judge) -> DataFrame:
    """call_id and defect of every defective pair of ``pairs`` (call_id, prompt, output, lang, and source if there is one); sound ones are absent.

    A pair has one defect, the first that applies of empty, refusal, copied, truncated, other_language;
    of repeated rows of a call_id the first such. Truncated means the same as in truncation: an ending that was cut,
    or one that leaves the matter open at a storage limit of the source. Null outputs are empty, null prompts leave out
    the comparison with the prompt.
    """
    rec = durable(examined(pairs, judge))
    cut = truncation.cut_calls(rec, truncation.limits(rec))
    at = {d: i for i, d in enumerate(DEFECTS)}
    code = F.when(F.col("cut") & (F.col("code").isNull() | (F.col("code") == at[OTHER])), at[TRUNCATED]).otherwise(F.col("code"))
    one = cut.select("call_id", code.alias("code")).filter("code IS NOT NULL").groupBy("call_id").agg(F.min("code").alias("code"))
    return one.select("call_id", F.element_at(F.array(*map(F.lit, DEFECTS)), F.col("code") + 1).alias("defect"))
