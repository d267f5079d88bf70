"""Lexical and dense retrieval: blocks of queries travel to the corpus, and every task keeps its own best documents of each query."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..storage import durable_table

# Fixed values of the Okapi variant: saturation, length weight, floor for negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Cells (queries x their words, or queries x dimensions) of one block; a task takes one block after the other for each batch of documents.
BLOCK_CELLS = 4_000_000
#: Documents that are scored at a time.
BATCH = 1000


class Best:
    """The k best documents of every query so far: higher scores first, equal ones by document."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score, self.doc = np.full((queries, 0), -np.inf), np.zeros((queries, 0), dtype=np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        """``score`` is queries x documents; -inf is no match."""
        score = np.hstack([self.score, score])
        doc = np.hstack([self.doc, np.broadcast_to(doc, (len(score), len(doc)))])
        if score.shape[1] > self.k:
            # What is above the k-th score stays; of those equal to it the smallest documents.
            kth = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            rank = np.where(score > kth, -1, np.where(score == kth, doc, np.iinfo(np.int64).max))
            at = np.argpartition(rank, self.k - 1, axis=1)[:, : self.k]
            score, doc = np.take_along_axis(score, at, 1), np.take_along_axis(doc, at, 1)
        self.score, self.doc = score, doc


_KEPT: dict = {}


def _block(key: tuple, shared, build):
    """What a task makes of a broadcast block; that of the last block stays in the Python worker."""
    if _KEPT.get("key") != key:
        _KEPT.clear()
        _KEPT.update(key=key, value=build(shared.value))
    return _KEPT["value"]


def _search(corpus: DataFrame, blocks: list, k: int, build, score, digits: int) -> DataFrame:
    """query, doc_id, score, place of the k best by score rounded to ``digits``: ``corpus`` (doc_id, payload) is read once.

    ``blocks`` are pairs (query names, content); build(content) makes what score(built, names, docs, payloads) needs to give
    queries x documents scores. Each task sends k rows a query to the final choice.
    """
    spark = corpus.sparkSession
    schema = "query_id string, doc_id long, score double"
    if not blocks:
        return spark.createDataFrame([], schema + ", place int")
    shared = [(names, spark.sparkContext.broadcast(content)) for names, content in blocks]
    search_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(names), k) for names, _ in shared]
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                docs, payload = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                for n, (names, content) in enumerate(shared):
                    best[n].add(np.round(score(_block((search_id, n), content, build), names, docs, payload), digits), docs)
        for (names, _), found in zip(shared, best, strict=True):
            q, c = np.nonzero(found.score > -np.inf)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=object)[q], pa.string()), pa.array(found.doc[q, c]), pa.array(found.score[q, c])], names=["query_id", "doc_id", "score"])

    got = corpus.mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return got.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


_TOKEN = re.compile("[a-z0-9]+")


def bm25(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents of every query (query_id, text) by BM25, equal scores by doc_id (SF-16). Documents that share no word are no match.

    Two passes over the texts: one counts words, with lengths in the same aggregation, and one scores. The queries and the
    counts of their words go to the driver; of all other words only how many there are and their mean idf, since a
    negative idf becomes EPSILON times that mean.
    """
    t = documents.select(tokens(F.col("text")).alias("t"))
    word = F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("word")
    counts = durable_table(t.select(F.size("t").alias("n"), word).groupBy("word").agg(F.count("*").alias("df"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("length")))
    every = counts.filter("word = ''").first()
    n_docs, avg_len = (every["df"], every["length"] / every["df"] or 1.0) if every else (0, 1.0)
    idf = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    floor = EPSILON * (counts.filter("word <> ''").agg(F.avg(idf)).first()[0] or 0.0)
    wanted = queries.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).distinct()
    known = {r["word"]: r["idf"] if r["idf"] >= 0 else floor for r in counts.join(wanted, "word").select("word", idf.alias("idf")).toLocalIterator()}

    blocks, now, words = [], [], set()
    for r in queries.select("query_id", "text").orderBy("query_id").toLocalIterator():
        own = {w: n for w, n in Counter(_TOKEN.findall((r["text"] or "").lower())).items() if w in known}
        if now and (len(now) + 1) * len(words | own.keys()) > BLOCK_CELLS:
            blocks.append(([q for q, _ in now], [{w: n * known[w] for w, n in o.items()} for _, o in now]))
            now, words = [], set()
        now.append((r["query_id"], own))
        words |= own.keys()
    if now:
        blocks.append(([q for q, _ in now], [{w: n * known[w] for w, n in o.items()} for _, o in now]))

    def build(content: list[dict[str, float]]):
        column: dict[str, int] = {}
        for o in content:
            for w in o:
                column.setdefault(w, len(column))
        weight, has = np.zeros((len(column), len(content))), np.zeros((len(column), len(content)), dtype=np.float32)
        for q, o in enumerate(content):
            for w, x in o.items():
                weight[column[w], q], has[column[w], q] = x, 1
        return column, weight, has

    def score(built, names, docs, texts) -> np.ndarray:
        column, weight, has = built
        tf = np.zeros((len(docs), len(column)))
        for i, text in enumerate(texts.to_pylist()):
            found = _TOKEN.findall((text or "").lower())
            for w, f in Counter(w for w in found if w in column).items():
                tf[i, column[w]] = f * (K1 + 1) / (f + K1 * (1 - B + B * len(found) / avg_len))
        met = ((tf > 0).astype(np.float32) @ has) > 0
        return np.where(met, tf @ weight, -np.inf).T

    return _search(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), blocks, k, build, score, 6)


def nearest(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``corpus`` (vec_id, embedding) to every query (vec_id, embedding) by cosine, but for the query itself; equal ones by vec_id (SF-17).

    Exact over all rows: one pass, to which queries travel in blocks. Null vectors are left out; a vector of zeros is at 0 from all.
    """
    blocks, names, rows = [], [], []
    for r in queries.filter("embedding IS NOT NULL").select("vec_id", "embedding").orderBy("vec_id").toLocalIterator():
        names.append(str(r[0]))
        rows.append(r[1])
        if (len(rows) + 1) * len(r[1]) > BLOCK_CELLS:
            blocks.append((names, np.array(rows, dtype=float)))
            names, rows = [], []
    if rows:
        blocks.append((names, np.array(rows, dtype=float)))

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)

    def score(built, names, docs, vectors) -> np.ndarray:
        q, ids = built
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        s = q @ unit(flat.reshape(len(docs), -1)).T
        s[ids[:, None] == docs[None, :]] = -np.inf
        return s

    own = [(n, (m, np.array(n, dtype=np.int64))) for n, m in blocks]
    vectors = corpus.filter("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return _search(vectors, own, k, lambda c: (unit(c[0]), c[1]), score, 9).select(F.col("query_id").cast("long").alias("query_id"), "doc_id", F.col("score").alias("s"), "place")
