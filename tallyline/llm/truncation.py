"""Problem 4: texts that were stored only up to some point, and how often each source cuts.

Lengths of every text are recomputed under several encodings, since a store may count characters,
UTF-8 bytes, UTF-16 units, or what is left after entity escaping, JSON escaping or conversion of
newlines. Grouped by source and encoding, a hidden limit shows as a length that far more
texts have than its neighbours, most of them with endings that stop short, or as the greatest length
of all. Endings are inspected with a model of terminal contexts counted from all texts (see endings); a text at its source's limit whose ending leaves
the matter open counts as cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import endings
from .base import durable

#: The encodings under which lengths are taken.
LENGTHS = ("characters", "utf8_bytes", "utf16_units", "html_characters", "html_bytes", "json_ascii", "json_characters", "json_bytes", "crlf_characters", "crlf_bytes")
CODES = endings.CODES


def lengths(text: Column) -> dict[str, Column]:
    """Length of a text under each encoding, as expressions that stay in the JVM."""
    chars, size = F.length(text), F.octet_length(text)

    def of(*marks: str) -> Column:
        return sum((chars - F.length(F.replace(text, F.lit(c))) for c in marks), F.lit(0))

    plain = chars == size  # ASCII, so that nothing has to be encoded anew
    quotes, newlines = of('"'), of("\n")
    utf16 = F.when(plain, chars).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))
    json = chars + quotes + of("\\", "\t", "\r") + newlines
    not_ascii = F.when(plain, 0).otherwise(chars - F.length(F.regexp_replace(text, "[^\\x00-\\x7f]", "")))
    html = 4 * of("&") + 3 * of("<", ">")
    return {
        "characters": chars, "utf8_bytes": size, "utf16_units": utf16, "html_characters": chars + html + 5 * quotes + 4 * of("'"),
        "html_bytes": size + html + 5 * quotes + 4 * of("'"), "json_ascii": json + 5 * not_ascii + 6 * (utf16 - chars), "json_characters": json,
        "json_bytes": size + (json - chars), "crlf_characters": chars + newlines, "crlf_bytes": size + newlines,
    }


def inspector(model: endings.ContextModel):
    """A column function: text to the code of its ending, or to what it asks of counts that the model does not hold."""
    shared = {}

    @F.pandas_udf("ending int, asked array<string>")
    def code(text: pd.Series) -> pd.DataFrame:
        m = shared.setdefault("m", model)
        got = [endings.judged(t, m) for t in text]
        ending = pd.array([CODES[x] if isinstance(x, str) else None for x in got], dtype="Int32")
        return pd.DataFrame({"ending": ending, "asked": pd.Series([None if isinstance(x, str) else list(x) for x in got], dtype=object)})

    return code


def records(texts: DataFrame) -> DataFrame:
    """One row for each call_id of ``texts`` (call_id, source, text): the code of its ending and its lengths.

    Null and empty texts have code 1; of repeated rows the worst ending counts. Whole texts are
    read once and dropped; what is shuffled is a few numbers a text.
    """
    model = endings.context_model(texts, "text")
    named = lengths(F.coalesce("text", F.lit("")))
    flat = texts.select("call_id", F.coalesce("source", F.lit("")).alias("source"), inspector(model)("text").alias("x"), *(c.cast("int").alias(n) for n, c in named.items()))
    flat = endings.settled(flat.select("call_id", "source", "x.*", *named), model)
    return flat.groupBy("call_id", "source").agg(F.max("ending").alias("ending"), *(F.max(n).alias(n) for n in named))


def limits(rec: DataFrame) -> DataFrame:
    """Hidden storage limits: source, encoding, length, n_texts (of that length), n_cut and expected (by the lengths around).

    A length is a limit if the texts that have it are four times as many as the mean of the 24 lengths around it,
    and either five or more of them are cut and these are the most, or five or more texts have it and none
    of the source is longer, which shows limits that fall on the ends of sentences.
    """
    names = [n for n in rec.columns if n in LENGTHS]
    long = rec.filter(F.col("ending") != CODES[endings.EMPTY]).select(
        "source", (F.col("ending") == CODES[endings.CUT]).cast("int").alias("cut"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("encoding"), F.col(n).alias("length")) for n in names))).alias("e"),
    )
    h = long.groupBy("source", "e.encoding", "e.length").agg(F.count("*").alias("n_texts"), F.sum("cut").alias("n_cut"))
    near = Window.partitionBy("source", "encoding").orderBy("length").rangeBetween(-12, 12)
    h = h.withColumn("expected", (F.sum("n_texts").over(near) - F.col("n_texts")) / 24)
    longest = F.max("length").over(Window.partitionBy("source", "encoding"))
    h = h.withColumn("last", (F.col("length") == longest) & (F.col("n_texts") >= 5))
    cuts = (F.col("n_cut") >= 5) & (F.col("n_cut") * 2 > F.col("n_texts"))
    return h.filter((cuts | F.col("last")) & (F.col("n_texts") >= 4 * F.col("expected"))).drop("last")


def cut_calls(rec: DataFrame, lim: DataFrame) -> DataFrame:
    """rec with at_limit (its length is a limit of its source under some encoding) and cut."""
    names = [n for n in rec.columns if n in LENGTHS]
    per = lim.groupBy("source").agg(F.collect_set(F.concat_ws(":", "encoding", "length")).alias("limits"))
    own = F.array(*(F.concat_ws(":", F.lit(n), F.col(n)) for n in names))
    x = rec.join(per, "source", "left").withColumn("at_limit", F.coalesce(F.arrays_overlap(own, "limits"), F.lit(False)))
    return x.withColumn("cut", (F.col("ending") == CODES[endings.CUT]) | (F.col("at_limit") & (F.col("ending") == CODES[endings.OPEN]))).drop("limits")


def truncated(texts: DataFrame) -> DataFrame:
    """call_id, source, ending code, lengths, at_limit and cut for every call; see records, limits and cut_calls."""
    rec = durable(records(texts))
    return cut_calls(rec, limits(rec))


def by_source(calls: DataFrame) -> DataFrame:
    """How often each source truncates: n_texts (not empty ones), n_cut, share and n_at_limit."""
    full = calls.filter(F.col("ending") != CODES[endings.EMPTY])
    return full.groupBy("source").agg(
        F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 9).alias("share"),
        F.sum(F.col("at_limit").cast("long")).alias("n_at_limit"),
    )
