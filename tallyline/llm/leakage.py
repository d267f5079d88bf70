"""Problem 8: evaluation texts inside training texts, by Wu-Manber search over words.

Patterns are all stretches of ``STRETCH`` words of every test item, and the whole of an item that is shorter. Text and items
are reduced to words in the same way (layout, case, punctuation, markup and character escapes are gone; in scripts written
without blanks each character is a word), and a "character" of the search is a word. A shift table over blocks of two words
tells how far the window may jump: a block that ends no pattern allows the greatest jump, so most of a clean document is never
looked at. Where the shift is 0, a table keyed by the last three words gives the stretches that
can end here, and comparison of all words confirms them.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 7
BLOCK = 2
SUFFIX = 3
#: Words of test items in one set of tables (some 200 bytes a word in a worker); more items make more sets, which a task takes in turn.
WORDS_IN_A_PASS = 400_000
#: Characters of documents that a task reduces to words and holds while it takes one set of tables after the other.
HELD_CHARACTERS = 8_000_000

_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrtfbv\"'/\\])")
_SIMPLE = {"n": " ", "r": " ", "t": " ", "f": " ", "b": "", "v": " "}
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|wbr|mark|code|sup|sub|font|small|big|q|cite|abbr|del|ins|kbd|var)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|!--.*?--|![A-Za-z][^<>]*)>", re.S)
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_LINK = re.compile(r"\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)")
_BROKEN = re.compile(r"(?<=\w)[-\u2010\u2011]\s*\r?\n[\s>|#*]*(?=\w)")
_INNER = re.compile(r"(?<=\w)(?:[-\u2010\u2011'\u2019\u02bc]|\*{1,3}|`|~~)(?=\w)")
_WORD = re.compile(r"[^\W_]+")
# Thai, Lao, Burmese, Khmer, kana and Chinese characters: written without blanks between words.
_JOINED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_JOINED = re.compile(f"[{_JOINED}]")
_WORD_OR_SIGN = re.compile(rf"(?!_)(?:[{_JOINED}]|[^\W_{_JOINED}]+)")


def _unescape(m: re.Match) -> str:
    x = m[1]
    if x[0] in "ux" and len(x) > 1:
        try:
            return chr(int(x[1:].strip("{}"), 16))
        except (ValueError, OverflowError):
            return " "
    return _SIMPLE.get(x, x)


def words(text: str | None) -> list[str]:
    """The words of a text, without layout, case, punctuation, markup and character escapes; null and empty have none."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
        if "\\" in text:
            text = _ESCAPE.sub(_unescape, text)
        if any("\ud800" <= c <= "\udfff" for c in text):
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "%" in text and re.search(r"%[0-9A-Fa-f]{2}", text):
        text = unquote(text.replace("+", " ") if "%20" not in text and text.count("+") > 3 else text)
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "](" in text:
        text = _LINK.sub("] ", text)
    if "-" in text or not text.isascii():
        text = _BROKEN.sub("", text)
    text = _INNER.sub("", text).casefold()
    return (_WORD if text.isascii() or not _HAS_JOINED.search(text) else _WORD_OR_SIGN).findall(text)


class Tables:
    """Shift table and suffix buckets of the stretches of some items, all of ``stretch`` words."""

    def __init__(self, items: list[tuple[str, list[str]]], stretch: int = STRETCH) -> None:
        self.stretch, self.block, self.suffix = stretch, min(BLOCK, stretch), min(SUFFIX, stretch)
        self.names = [name for name, _ in items]
        self.lengths = [len(w) for _, w in items]
        self.ids: dict[str, int] = {}
        for _, w in items:
            for x in w:
                self.ids.setdefault(x, len(self.ids) + 1)
        self.far = stretch - self.block + 1
        self.size = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[int, int]]]] = {}
        for k, (_, w) in enumerate(items):
            v = [self.ids[x] for x in w]
            for at in range(len(v) - stretch + 1):
                p = tuple(v[at : at + stretch])
                for end in range(self.block, stretch + 1):
                    block = p[end - 1] if self.block == 1 else p[end - 2] * self.size + p[end - 1]
                    self.shift[block] = min(self.shift.get(block, self.far), stretch - end)
                self.buckets.setdefault(p[-self.suffix :], {}).setdefault(p, []).append((k, at))

    def find(self, text: list[str]) -> dict[int, set[int]]:
        """Item -> positions of its words that stand in the text in stretches of at least ``stretch`` words."""
        get = self.ids.get
        v = [get(x, 0) for x in text]
        shift, size, far, buckets, n = self.shift.get, self.size, self.far, self.buckets.get, len(v)
        stretch, suffix, single = self.stretch, self.suffix, self.block == 1
        found: dict[int, set[int]] = {}
        end = stretch - 1
        while end < n:
            jump = shift(v[end] if single else v[end - 1] * size + v[end], far)
            if jump:
                end += jump
                continue
            bucket = buckets(tuple(v[end - suffix + 1 : end + 1]))
            if bucket and (hits := bucket.get(tuple(v[end - stretch + 1 : end + 1]))):
                for k, at in hits:
                    found.setdefault(k, set()).update(range(at, at + stretch))
            end += 1
        return found


def tables(items: list[tuple[str, list[str]]]) -> list[Tables]:
    """One for all items of STRETCH words or more, and one for each shorter length that there is, whose items are sought as wholes."""
    by: dict[int, list] = {}
    for item in items:
        by.setdefault(min(STRETCH, len(item[1])), []).append(item)
    return [Tables(part, n) for n, part in sorted(by.items())]


_KEPT: dict = {}


def _kept(key: tuple, shared) -> list[Tables]:
    """The tables of a broadcast set of items; those used last stay in the Python worker."""
    if _KEPT.get("key") != key:
        _KEPT.clear()
        _KEPT.update(key=key, tables=tables(shared.value))
    return _KEPT["tables"]


def _sets(items: Iterator[tuple[str, str]], words_in_a_pass: int) -> Iterator[list[tuple[str, list[str]]]]:
    now, total = [], 0
    for name, text in items:
        w = words(text)
        if not w:
            continue
        if now and total + len(w) > words_in_a_pass:
            yield now
            now, total = [], 0
        now.append((name, w))
        total += len(w)
    if now:
        yield now


def leaks(documents: DataFrame, items: DataFrame, words_in_a_pass: int = WORDS_IN_A_PASS) -> DataFrame:
    """Every pair of ``documents`` (doc_id, text) and ``items`` (item_id, text) where a stretch of the item stands in the document.

    Columns: doc_id, item_id, covered (the item's words found in stretches of at least seven of its
    consecutive words; a shorter item is found as a whole or not at all), n_words (of the item) and share. Passages of any share
    are reported; whoever wants the greater ones filters by share. Whole texts are searched; null texts and texts without a
    word match nothing. Items of equal text are all reported. Repeated rows of a document or item give one row.

    Items are read to the driver in a stream and broadcast in sets of at most ``words_in_a_pass`` words. The documents never
    move and are reduced to words once: a task holds HELD_CHARACTERS of them and takes all sets in turn.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    schema = "doc_id long, item_id string, covered int, n_words int"
    stream = ((r["item_id"], r["text"]) for r in items.select("item_id", "text").filter("item_id IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator())
    sets = [(number, spark.sparkContext.broadcast(part)) for number, part in enumerate(_sets(stream, words_in_a_pass))]
    if not sets:
        return spark.createDataFrame([], schema + ", share double")
    names, search_id = ["doc_id", "item_id", "covered", "n_words"], uuid.uuid4().hex

    def search(held: list[tuple[int, list[str]]]) -> Iterator[pa.RecordBatch]:
        for number, shared in sets:
            rows = [(doc, t.names[k], len(at), t.lengths[k]) for t in _kept((search_id, number), shared) for doc, w in held for k, at in t.find(w).items()]
            if rows:
                d, i, c, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i), pa.array(c, pa.int32()), pa.array(n, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((doc, words(text)))
                size += len(text)
                if size > HELD_CHARACTERS:
                    yield from search(held)
                    held, size = [], 0
        yield from search(held)

    best = docs.mapInArrow(run, schema).groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "n_words")).alias("x"))
    return best.select("doc_id", "item_id", "x.covered", "x.n_words", F.round(F.col("x.covered") / F.col("x.n_words"), 6).alias("share"))
