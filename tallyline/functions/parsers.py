"""Reply parsers that need a loop over characters: Arrow-batched pandas functions."""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from .rouge import common_places

_PUNCT = re.compile(r"[^\w\s]|_")
_BLANK = re.compile(r"\s+")
_COMMA = re.compile(r",\s*([\]}])")


def normalize(text: str | None) -> str | None:
    """Compatibility form, no accents, case folded, punctuation as blanks, one leading article dropped (SF-6)."""
    if text is None:
        return None
    x = unicodedata.normalize("NFKD", text)
    x = "".join(c for c in x if not unicodedata.combining(c)).casefold()
    x = _BLANK.sub(" ", _PUNCT.sub(" ", x)).strip()
    return re.sub(r"^(?:the|a|an) (?=\S)", "", x)


def normalized(column):
    """Column function; see the plain one above. ASCII texts stay in the JVM, only others go to Python."""
    x = F.col(column) if isinstance(column, str) else column
    ascii_ = F.length(x) == F.octet_length(x)
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " "), r"\s+", " "))
    plain = F.regexp_replace(bare, r"^(?:the|a|an) (?=\S)", "")
    return F.when(ascii_, plain).otherwise(F.pandas_udf(_series_normalized, "string")(F.when(~ascii_, x)))


def _series_normalized(text: pd.Series) -> pd.Series:
    return text.map(normalize)


def first_object(text: str | None) -> dict | None:
    """The first JSON object that parses, wherever it stands (SF-25)."""
    at = -1 if text is None else text.find("{")
    while at >= 0:
        try:
            value, _ = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            value = None
        if isinstance(value, dict):
            return value
        at = text.find("{", at + 1)
    return None


def _whole(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def parse_pairwise(text: str | None) -> str | None:
    """1, 2 or tie of a pairwise reply's ``better``: one of these numbers, as a number, or that word; anything else is unreadable."""
    value = (first_object(text) or {}).get("better")
    if _whole(value):
        return str(value) if value in (1, 2) else None
    return "tie" if isinstance(value, str) and value.strip().lower() == "tie" else None


def parse_pick(text: str | None, n: int) -> list[int] | None:
    """The numbers that a pick reply's ``best`` lists, in its order: whole ones from 1 to n, none twice, at least one; anything else is unreadable."""
    value = (first_object(text) or {}).get("best")
    good = isinstance(value, list) and len(value) > 0 and all(_whole(v) and 1 <= v <= n for v in value) and len(set(value)) == len(value)
    return value if good else None


def parse_block(text: str | None, n: int, dims: list[str], low: float = 1, high: float = 5) -> list[float] | None:
    """Mean grade of each of n outputs over the dimensions. The object reaches from the first brace to the last; each dimension lists n numbers on the scale."""
    body = (text or "")[(text or "").find("{") :]
    try:
        got = json.loads(body[: body.rfind("}") + 1])
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    rows = [got.get(d) for d in dims]
    if not all(isinstance(r, list) and len(r) == n and all((_whole(v) or isinstance(v, float)) and low <= v <= high for v in r) for r in rows):
        return None
    return [math.fsum(column) / len(dims) for column in zip(*rows, strict=True)]


def pairwise(column):
    """Column function; see the plain one above."""
    return F.pandas_udf(_series_pairwise, "string")(column)


def _series_pairwise(text: pd.Series) -> pd.Series:
    return text.map(parse_pairwise)


def block_parser(n: int, dims: list[str]):
    @F.pandas_udf("array<double>")
    def parse(text: pd.Series) -> pd.Series:
        return text.map(lambda t: parse_block(t, n, dims))

    return parse


def parse_ranking(text: str | None) -> list[str] | None:
    """Ids of a ranking reply: a JSON array, bare or fenced, else one id a line after a short lead (SF-14); objects are refused."""
    if not text or not text.strip():
        return None
    body = re.sub(r"^\s*```\w*\n|\n```\s*$", "", text.strip())
    at = body.find("[")
    if at >= 0 and (not body[:at].strip() or len(body[:at].strip()) <= 64):
        try:
            value, _ = json.JSONDecoder().raw_decode(body, at)
        except ValueError:
            value = None
        if isinstance(value, list):
            return [str(v) for v in value] if all(isinstance(v, (str, int)) and not isinstance(v, bool) for v in value) else None
    if body.lstrip().startswith("{"):
        return None
    out = []
    for line in body.splitlines():
        m = re.match(r"\s*(?:\d{1,3}[.)]|[-*])?\s*([A-Za-z]*_?\d[\w-]*)\s*$", line)
        if m:
            out.append(m[1])
    return out or None


def ranking(column):
    """Column function; see the plain one above."""
    return F.pandas_udf(_series_ranking, "array<string>")(column)


def _series_ranking(text: pd.Series) -> pd.Series:
    return text.map(parse_ranking)


def entities(text: str | None) -> list[dict] | None:
    """Text and type of the entities of a reply (SF-10): the first array of objects that parses, after mending single quotes and trailing commas; null if there is none."""
    if text is None:
        return None
    at = text.find("[")
    while at >= 0:
        body = text[at:]
        quoted = re.sub(r"(?<=[{\[,:\s])'|'(?=[}\],:])", '"', body)
        for body in (body, _COMMA.sub(r"\1", body), quoted, _COMMA.sub(r"\1", quoted)):
            try:
                value, _ = json.JSONDecoder().raw_decode(body)
            except ValueError:
                continue
            if isinstance(value, list) and all(isinstance(v, dict) and isinstance(v.get("text"), str) for v in value):
                return [{"text": v["text"], "type": str(v.get("type", "")).lower()} for v in value]
        at = text.find("[", at + 1)
    return None


def entity_list(column):
    """Column function; see the plain one above."""
    return F.pandas_udf(_series_entity_list, "array<struct<text:string,type:string>>")(column)


def _series_entity_list(text: pd.Series) -> pd.Series:
    return text.map(entities)


def canonical(value: str | None) -> str | None:
    """A JSON text with sorted keys and no blanks, for hashing (SF-33); null if it does not parse."""
    try:
        return None if value is None else json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def canonical_json(column):
    """Column function; see the plain one above."""
    return F.pandas_udf(_series_canonical_json, "string")(column)


def _series_canonical_json(value: pd.Series) -> pd.Series:
    return value.map(canonical)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit sets."""
    where: dict[str, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    row, full = 0, (1 << len(b)) - 1
    for x in a:
        u = row | where.get(x, 0)
        row = u & ~(u - ((row << 1) | 1)) & full
    return row.bit_count()


def word_diff(old: str | None, new: str | None) -> dict:
    """What ``new`` keeps, inserts and deletes of the words of ``old``, by a longest common subsequence, and the marked text ([-deleted-], {+inserted+}) (SF-36)."""
    a, b = (old or "").split(), (new or "").split()
    kept = sorted(common_places(a, b))
    marked, i, j = [], 0, 0
    for at in [*kept, len(a)]:
        marked += [f"[-{w}-]" for w in a[i:at]]
        word = a[at] if at < len(a) else None
        while j < len(b) and b[j] != word:
            marked.append(f"{{+{b[j]}+}}")
            j += 1
        if word is not None:
            marked.append(word)
        i, j = at + 1, j + 1
    return {"kept": len(kept), "inserted": len(b) - len(kept), "deleted": len(a) - len(kept), "marked": " ".join(marked)}


def diffed(old, new):
    """Column function of word_diff."""
    return F.pandas_udf(_series_diff, "kept int, inserted int, deleted int, marked string")(old, new)


def _series_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_diff(a, b) for a, b in zip(old, new, strict=True)], columns=["kept", "inserted", "deleted", "marked"])


def rouge_l(summary: str | None, reference: str | None) -> float:
    """F1 of the longest common subsequence of words (SF-22)."""
    a, b = (re.findall(r"[a-z0-9]+", (t or "").lower()) for t in (summary, reference))
    n = lcs(a, b) if a and b else 0
    return 2 * n / (len(a) + len(b)) if n else 0.0


def rouge_l_f1(summary, reference):
    """Column function of rouge_l."""
    return F.pandas_udf(_series_rouge_l, "double")(summary, reference)


def _series_rouge_l(summary: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a, b) for a, b in zip(summary, reference, strict=True)], dtype="float64")
