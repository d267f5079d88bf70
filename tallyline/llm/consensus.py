"""Problem 6: consensus labels from annotators of unlike worth, by a community confusion model.

Annotators belong to a few types. A type m has a confusion matrix (true grade by given grade)
shared by its members; the matrix of one annotator is that of its types with ``STRENGTH``
pseudo-labels plus its own labels, so an annotator with few labels is judged by its type and
one with many by itself. Variational updates go round between

    the posterior of every unit's true grade,
    the annotators' expected confusion counts,
    the types' matrices and each annotator's membership,

until the counts settle. A type that inverts the scale or is one grade too high is as useful as an
accurate one; a type whose matrix has equal rows says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_table, durable, durable_table, joined

GRADES = 5
STRENGTH = 20.0
PRIOR = 10.0
#: Rounds end when no expected count moves by more than this share of the greatest; what has not ended by then is marked as not converged.
TOLERANCE = 1e-3
ITERATIONS = 200
#: Annotators whose matrices are held by the driver and every worker (200 bytes each); beyond, they are joined.
ANNOTATORS_IN_MEMORY = 20_000

TYPES = ("accurate", "lenient", "strict", "inverted", "careless", "middling", "generous")


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to above 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def prototypes() -> np.ndarray:
    """Where each type starts: rows are true grades, columns given grades."""
    g = np.arange(GRADES)

    def near(centre: np.ndarray, width: float = 0.8) -> np.ndarray:
        p = np.exp(-np.abs(g[None, :] - centre[:, None]) / width) + 0.02
        return p / p.sum(1, keepdims=True)

    level = np.full(GRADES, float(GRADES // 2))
    return np.stack([
        near(g), near(np.minimum(g + 1, GRADES - 1)), near(np.maximum(g - 1, 0)), near(GRADES - 1 - g),
        np.full((GRADES, GRADES), 1 / GRADES), near(level), near(level + 1),
    ])


class Model:
    """Types and annotators given the expected confusion counts."""

    def __init__(self) -> None:
        self.start = prototypes()
        self.alpha = PRIOR * self.start + 0.1
        self.share = np.full(len(self.start), 1 / len(self.start))

    def types(self, counts: np.ndarray, member: np.ndarray) -> None:
        """New type matrices from memberships and counts (annotator, true, given)."""
        self.alpha = PRIOR * self.start + 0.1 + np.einsum("km,kcg->mcg", member, counts)
        self.share = (member.sum(0) + 1) / (member.sum() + len(self.start))

    def membership(self, counts: np.ndarray) -> np.ndarray:
        elog = digamma(self.alpha) - digamma(self.alpha.sum(2, keepdims=True))
        s = np.einsum("kcg,mcg->km", counts, elog) + np.log(self.share)
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    def annotators(self, counts: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Expected log confusion of every annotator."""
        return _elog(self.dirichlet(counts, member))

    def dirichlet(self, counts: np.ndarray, member: np.ndarray) -> np.ndarray:
        mean = self.alpha / self.alpha.sum(2, keepdims=True)
        return STRENGTH * np.einsum("km,mcg->kcg", member, mean) + counts


def _elog(a: np.ndarray) -> np.ndarray:
    return digamma(a) - digamma(a.sum(2, keepdims=True))


def vote(n_annotators: int) -> np.ndarray:
    """Log confusion to begin with: all are accurate, so the first posterior is a smoothed vote."""
    return np.log(np.repeat(prototypes()[:1], n_annotators, 0))


def grade_labels(item_scores: DataFrame) -> DataFrame:
    """run_id, item_id, dim_name, judge, grade: each score_id once, names in lower case, grades 1 to 5 only.

    Of several rows of one score_id the earliest counts. Rows without a map, with a null name, grade
    or judge give no label.
    """
    x = item_scores.select("score_id", "run_id", "item_id", "judge", "created_at", F.map_entries("per_dimension").alias("d"))
    x = x.filter(F.size("d") > 0).groupBy("score_id").agg(F.min_by(F.struct("run_id", "item_id", "judge", "d"), F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp"))).alias("x"))
    x = x.select("x.run_id", "x.item_id", "x.judge", F.explode("x.d").alias("e"))
    x = x.select("run_id", "item_id", F.lower(F.trim("e.key")).alias("dim_name"), "judge", F.col("e.value").alias("grade"))
    return x.filter(F.col("grade").between(1, GRADES) & F.col("judge").isNotNull() & F.col("dim_name").isNotNull())


def _posterior(off: np.ndarray, who: np.ndarray, given: np.ndarray, n: np.ndarray, elog: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior of the true grade for each unit; labels of unit u are off[u]..off[u+1]."""
    part = elog[who, :, given] * n[:, None]
    cum = np.vstack([np.zeros((1, GRADES)), np.cumsum(part, 0)])
    s = cum[off[1:]] - cum[off[:-1]] + prior
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def _unpack(batch: pa.RecordBatch, dims: dict[str, int]):
    lab = batch.column(batch.schema.get_field_index("labels"))
    off = lab.offsets.to_numpy()
    flat = lab.values.slice(off[0], off[-1] - off[0])
    who, given, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    dim = np.array([dims[x] for x in batch.column(batch.schema.get_field_index("dim_name")).to_pylist()], dtype=np.int64)
    return off - off[0], who.astype(np.int64), given.astype(np.int64) - 1, n.astype(float), dim


COUNT_COLS = [f"n{c}{g}" for c in range(GRADES) for g in range(GRADES)]


def _statistics(units: DataFrame, elog: np.ndarray, prior: np.ndarray, dims: dict[str, int], n_annotators: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected confusion counts of every annotator and grade counts of every dimension: one pass, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GRADES, n_annotators * GRADES))
        classes = np.zeros((len(dims), GRADES))
        for b in batches:
            if b.num_rows:
                off, who, given, n, dim = _unpack(b, dims)
                q = _posterior(off, who, given, n, elog, prior[dim])
                unit = np.repeat(np.arange(len(q)), np.diff(off))
                for c in range(GRADES):
                    total[c] += np.bincount(who * GRADES + given, q[unit, c] * n, n_annotators * GRADES)
                    classes[:, c] += np.bincount(dim, q[:, c], len(dims))
        counts = total.reshape(GRADES, n_annotators, GRADES).transpose(1, 0, 2).reshape(n_annotators, -1)
        padded = np.zeros((len(dims), GRADES * GRADES))
        padded[:, :GRADES] = classes
        rows = np.vstack([counts, padded])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(n_annotators), -1 - np.arange(len(dims))]), *(pa.array(rows[:, k]) for k in range(GRADES * GRADES))], names=["who", *COUNT_COLS])

    schema = "who long, " + ", ".join(f"{c} double" for c in COUNT_COLS)
    got = units.select("dim_name", "labels").mapInArrow(run, schema).groupBy("who").agg(*(F.sum(c).alias(c) for c in COUNT_COLS)).toPandas()
    counts, classes = np.zeros((n_annotators, GRADES, GRADES)), np.zeros((len(dims), GRADES))
    for r in got.itertuples(index=False):
        values = np.array(r[1:])
        if r[0] >= 0:
            counts[r[0]] = values.reshape(GRADES, GRADES)
        else:
            classes[-1 - r[0]] = values[:GRADES]
    return counts, classes


def _log_prior(classes: np.ndarray) -> np.ndarray:
    return digamma(classes + 1) - digamma((classes + 1).sum(1, keepdims=True))


class Fit:
    """A fitted model: the units' grades, what is known of the annotators, and whether the rounds converged."""

    def __init__(self, grades: DataFrame, annotators: DataFrame, converged: bool) -> None:
        self.grades, self.annotators, self.converged = grades, annotators, converged


def fit(labels: DataFrame, in_memory: int = ANNOTATORS_IN_MEMORY) -> Fit:
    """Consensus of ``labels`` (run_id, item_id, dim_name, judge, grade).

    ``grades``: run_id, item_id, dim_name, grade (the most probable; of equally probable ones the
    lower), probability. ``annotators``: judge, judge_type, n_labels, accuracy (chance of giving the
    true grade), information (bits that a label of this judge tells of the true grade).
    Labels are folded to counts of (unit, judge, grade) first, so repeated ones cost nothing and no
    task holds more of a unit than judges times grades. Null run_ids and item_ids make units of
    their own. Up to ``in_memory`` judges their matrices travel with the tasks and a round
    is one pass without any shuffle of labels; with more, labels and matrices are joined.
    An empty table gives empty results.
    """
    counts = durable(labels.groupBy("run_id", "item_id", "dim_name", "judge", "grade").agg(F.count("*").alias("n")))
    per_judge = counts.groupBy("judge").agg(F.sum("n").alias("n_labels"))
    if per_judge.count() > in_memory:
        return _fit_joined(counts, per_judge)
    spark = counts.sparkSession
    judges = sorted((r["judge"], r["n_labels"]) for r in per_judge.collect())
    dims = {r[0]: i for i, r in enumerate(counts.select("dim_name").distinct().orderBy("dim_name").collect())}
    schema = "judge string, judge_type string, n_labels long, accuracy double, information double"
    if not judges:
        none = spark.createDataFrame([], "run_id string, item_id string, dim_name string, grade int, probability double")
        return Fit(none, spark.createDataFrame([], schema), True)
    number = spark.createDataFrame([(j, k) for k, (j, _) in enumerate(judges)], "judge string, who int")
    units = counts.join(F.broadcast(number), "judge").groupBy("run_id", "item_id", "dim_name").agg(F.collect_list(F.struct("who", F.col("grade").cast("int").alias("given"), "n")).alias("labels"))
    units = durable(units)
    k = len(judges)
    model, elog, prior = Model(), vote(k), np.log(np.full((len(dims), GRADES), 1 / GRADES))
    last, converged = None, False
    for _ in range(ITERATIONS):
        n, classes = _statistics(units, elog, prior, dims, k)
        member = model.membership(n)
        model.types(n, member)
        member = model.membership(n)
        elog, prior = model.annotators(n, member), _log_prior(classes)
        converged = last is not None and np.abs(n - last).max() <= TOLERANCE * max(1.0, np.abs(n).max())
        if converged:
            break
        last = n
    share = classes.sum(0) / classes.sum()
    rows = [(j, *_worth(d, m, share), int(c)) for (j, c), d, m in zip(judges, model.dirichlet(n, member), member, strict=True)]
    annotators = spark.createDataFrame([(j, t, c, a, i) for j, t, a, i, c in rows], schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                off, who, given, m, dim = _unpack(b, dims)
                q = _posterior(off, who, given, m, elog, prior[dim])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((q.argmax(1) + 1).astype(np.int32)), pa.array(q.max(1))], names=["run_id", "item_id", "dim_name", "grade", "probability"])

    grades = units.select("run_id", "item_id", "dim_name", "labels").mapInArrow(decide, "run_id string, item_id string, dim_name string, grade int, probability double")
    return Fit(grades, annotators, bool(converged))


def _worth(dirichlet: np.ndarray, member: np.ndarray, share: np.ndarray) -> tuple[str, float, float]:
    p = dirichlet / dirichlet.sum(1, keepdims=True)
    joint = share[:, None] * p
    given = joint.sum(0)
    return TYPES[int(member.argmax())], float((share * p.diagonal()).sum()), float((joint * np.log2(p / given)).sum())


def _fit_joined(counts: DataFrame, per_judge: DataFrame) -> Fit:
    """fit() for any number of judges: matrices are rows, joined to the labels; the driver holds only types and class counts."""
    spark = counts.sparkSession
    model = Model()
    flat = GRADES * GRADES
    first = [float(x) for x in np.log(prototypes()[0]).ravel()]
    matrices = per_judge.select("judge", F.array(*map(F.lit, first)).alias("elog"))
    prior = {r[0]: [0.0] * GRADES for r in counts.select("dim_name").distinct().collect()}
    unit = ["run_id", "item_id", "dim_name"]
    many = per_judge.count()
    last, converged, q, n = None, False, None, None
    for _ in range(ITERATIONS):
        old = q, n
        table = spark.createDataFrame([(d, list(map(float, p))) for d, p in prior.items()], "dim_name string, prior array<double>")
        x = joined(counts, matrices, ["judge"], many * 25, "item_id")  # a matrix weighs as much as 25 short rows
        sums = [F.sum(F.col("n") * F.element_at("elog", (F.lit(c * GRADES) + F.col("grade")).cast("int"))).alias(f"s{c}") for c in range(GRADES)]
        x = x.groupBy(*unit).agg(*sums).join(table, "dim_name")
        s = [F.col(f"s{c}") + F.element_at("prior", F.lit(c + 1)) for c in range(GRADES)]
        top = F.greatest(*s)
        e = [F.exp(v - top) for v in s]
        whole = e[0] + e[1] + e[2] + e[3] + e[4]
        q = durable_table(x.select(*unit, *((v / whole).alias(f"q{c}") for c, v in enumerate(e))))
        per = counts.join(q, [counts[c].eqNullSafe(q[c]) for c in unit]).groupBy(counts["judge"], counts["grade"]).agg(*(F.sum(F.col("n") * F.col(f"q{c}")).alias(f"q{c}") for c in range(GRADES)))
        cells = [F.sum(F.when(F.col("grade") == g + 1, F.col(f"q{c}")).otherwise(0.0)).alias(f"n{c}{g}") for c in range(GRADES) for g in range(GRADES)]
        n = durable_table(per.groupBy("judge").agg(*cells).select("judge", F.array(*COUNT_COLS).alias("counts")))
        member = n.mapInPandas(_map_membership(model), "judge string, counts array<double>, member array<double>")
        tot = member.select(F.posexplode("member").alias("m", "p"), "counts").select("m", "p", *(F.element_at("counts", i + 1).alias(f"c{i}") for i in range(flat)))
        got = tot.groupBy("m").agg(F.sum("p").alias("p"), *(F.sum(F.col("p") * F.col(f"c{i}")).alias(f"c{i}") for i in range(flat))).collect()
        for r in got:
            model.alpha[r["m"]] = PRIOR * model.start[r["m"]] + 0.1 + np.array([r[f"c{i}"] for i in range(flat)]).reshape(GRADES, GRADES)
        p = np.array([next((r["p"] for r in got if r["m"] == m), 0.0) for m in range(len(model.start))])
        model.share = (p + 1) / (p.sum() + len(p))
        before, matrices = matrices, durable_table(n.mapInPandas(_map_matrices(model), "judge string, elog array<double>"))
        if old[1] is not None:
            drop_table(before)
        classes = q.groupBy("dim_name").agg(*(F.sum(f"q{c}").alias(f"q{c}") for c in range(GRADES))).collect()
        prior = {r["dim_name"]: _log_prior(np.array([[r[f"q{c}"] for c in range(GRADES)]]))[0] for r in classes}
        for t in old:
            drop_table(t)
        now = model.alpha.copy()
        converged = last is not None and np.abs(now - last).max() <= TOLERANCE * np.abs(now).max()
        if converged:
            break
        last = now
    share = np.array([[r[f"q{c}"] for c in range(GRADES)] for r in classes]).sum(0)
    share = share / share.sum()
    worth = n.mapInPandas(_map_worth(model, share), "judge string, judge_type string, accuracy double, information double")
    annotators = per_judge.join(worth, "judge").select("judge", "judge_type", "n_labels", "accuracy", "information")
    top = F.greatest(*(f"q{c}" for c in range(GRADES)))
    grade = F.coalesce(*(F.when(F.col(f"q{c}") == top, F.lit(c + 1)) for c in range(GRADES)))
    return Fit(q.select(*unit, grade.cast("int").alias("grade"), top.alias("probability")), annotators, bool(converged))


def _stack(pdf) -> np.ndarray:
    return np.stack(pdf["counts"].to_numpy()).reshape(len(pdf), GRADES, GRADES)


def _map_membership(model: Model):
    def run(pdfs):
        for pdf in pdfs:
            if len(pdf):
                yield pdf.assign(member=list(model.membership(_stack(pdf))))

    return run


def _map_matrices(model: Model):
    def run(pdfs):
        for pdf in pdfs:
            if len(pdf):
                n = _stack(pdf)
                yield pdf[["judge"]].assign(elog=list(model.annotators(n, model.membership(n)).reshape(len(pdf), -1)))

    return run


def _map_worth(model: Model, share: np.ndarray):
    def run(pdfs):
        for pdf in pdfs:
            if len(pdf):
                n = _stack(pdf)
                m = model.membership(n)
                w = [_worth(d, k, share) for d, k in zip(model.dirichlet(n, m), m, strict=True)]
                yield pdf[["judge"]].assign(judge_type=[x[0] for x in w], accuracy=[x[1] for x in w], information=[x[2] for x in w])

    return run


def unit_agreement(labels: DataFrame) -> DataFrame:
    """For each unit: its labels, judges' pairs, and the share of pairs of labels that agree (null below two labels)."""
    g = labels.groupBy("run_id", "item_id", "dim_name", "grade").agg(F.count("*").alias("n"))
    u = g.groupBy("run_id", "item_id", "dim_name").agg(F.sum("n").alias("n_labels"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    pairs = F.col("n_labels") * (F.col("n_labels") - 1)
    return u.select("run_id", "item_id", "dim_name", "n_labels", F.when(pairs > 0, F.round(F.col("same") / pairs, 9)).alias("agreement"))
