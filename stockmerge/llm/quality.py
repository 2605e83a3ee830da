"""Quality grades by ordinal (cumulative-link) regression on hashed words.

P(grade > k | text) = sigmoid(w . x - t_k) with one weight vector w and ordered thresholds t_0 < t_1 < ...;
x is the length-normalised vector of 1 + log(count) over hashed words.  The expected grade is the sum of the tail probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Codes, column, least_hashed, lower_ascii, sampled_texts, slices, texts_of, word_code

SCHEMA = "doc_id long, expected_grade double, tail_probability double, grade int, selected boolean"
DIMENSIONS = 1 << 14


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # increasing; one fewer than grades


def bucket(word: str) -> int:
    return word_code(word.strip(".,;:!?\"'()")) % DIMENSIONS


class Features:
    def __init__(self):
        self.codes = Codes(bucket, limit=400_000)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places and unit-length values of a text; none for a null or blank one."""
        words = WORD.findall(lower_ascii(text)) if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        counts = np.bincount(self.codes.array(words), minlength=1)
        at = np.flatnonzero(counts)
        value = 1 + np.log(counts[at])
        return at, value / np.sqrt((value**2).sum())


_KNOWN = Features()  # kept between the tasks of a Python worker


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for a toxic text, else 1, and 2 for good quality.  A missing label counts as not toxic, or as not
    good.  Several labels of one document give their lowest grade; labels without an id are ignored."""
    g = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).otherwise(1 + (F.coalesce("quality", F.lit(0)) > 0).cast("int"))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(g).cast("int").alias("grade"))


def sample(docs: DataFrame, graded: DataFrame, per_grade: int) -> DataFrame:
    """(grade, at, value): the features of at most ``per_grade`` different rows (id and text) of each grade.  Labelled ids are chosen without
    texts, those with the least hashes, so that at most ``per_grade`` of them for each of three grades meet the documents, as a broadcast; an
    id may have many texts, so the rows are then chosen in the same way."""
    met = docs.where("text IS NOT NULL").join(F.broadcast(least_hashed(graded, "grade", per_grade)).drop("rn"), "doc_id")
    chosen = sampled_texts(met.select("doc_id", "grade", "text"), "grade", per_grade)

    def run(batches):
        for batch in slices(batches):
            found = [_KNOWN(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "grade"), column(batch, "rn"), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int64())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))], ["grade", "rn", "at", "value"])

    return chosen.select("grade", "rn", "text").mapInArrow(run, "grade int, rn int, at array<long>, value array<double>")


def fit(docs: DataFrame, graded: DataFrame, per_grade: int = 1500, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Learn from at most ``per_grade`` rows of each grade (see ``sample``), also where ids or rows repeat; this documented
    bound is what passes through the driver.  Full-batch adaptive gradient steps; thresholds stay ordered as the
    first plus exponentials.  With fewer than two grades the model is empty and predicts grade 0."""
    pdf = sample(docs, graded, per_grade).toPandas().sort_values(["grade", "rn"], ignore_index=True)
    classes = sorted(set(pdf["grade"])) if len(pdf) else []
    if len(classes) < 2:
        return Model(np.zeros(DIMENSIONS), np.zeros(0))
    top = int(max(classes))
    y = pdf["grade"].to_numpy(int)
    lengths = pdf["at"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), lengths)
    at = np.concatenate([np.asarray(a, np.int64) for a in pdf["at"]])
    value = np.concatenate([np.asarray(v, float) for v in pdf["value"]])
    share = np.array([1.0 / max(1, (y == g).sum()) for g in range(top + 1)])[y]
    share *= len(y) / share.sum()  # each grade weighs the same
    over = (y[:, None] > np.arange(top)[None]).astype(float)
    w, raw = np.zeros(DIMENSIONS), np.r_[-1.0, np.zeros(top - 1)]
    seen_w, seen_t = np.full(DIMENSIONS, 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        t = np.r_[raw[0], raw[0] + np.cumsum(np.exp(raw[1:]))]
        score = np.bincount(row, value * w[at], len(y))
        miss = (1 / (1 + np.exp(-(score[:, None] - t[None]))) - over) * share[:, None] / len(y)
        gw = np.bincount(at, value * miss.sum(1)[row], DIMENSIONS) + decay * w
        gt = -miss.sum(0)
        gr = np.r_[gt.sum(), [gt[k:].sum() * np.exp(raw[k]) for k in range(1, top)]]
        seen_w += gw**2
        seen_t += gr**2
        w -= rate * gw / np.sqrt(seen_w)
        raw -= 0.2 * rate * gr / np.sqrt(seen_t)
    t = np.r_[raw[0], raw[0] + np.cumsum(np.exp(raw[1:]))]
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}  # a row for each grade
    return recalibrated(w, t, np.bincount(row, value * w[at], len(y)), y, counts)


def recalibrated(w: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, counts: dict[int, int], rounds: int = 100) -> Model:
    """The model with its scale and thresholds fitted anew (Newton's method on the same likelihood, for scores x) with every sampled row
    standing for as many labels of its grade as there are: the sample has grades in other shares than the labels."""
    share = np.array([counts.get(g, 0) / max(1, (y == g).sum()) for g in range(len(t) + 1)], float)[y]
    share /= max(share.sum(), 1e-9)
    p = np.r_[1.0, t]
    for _ in range(rounds):
        over = 1 / (1 + np.exp(-np.clip(p[0] * x[:, None] - p[None, 1:], -50, 50)))
        miss = (over - (y[:, None] > np.arange(len(t))[None])) * share[:, None]
        bend = over * (1 - over) * share[:, None]
        gradient = np.r_[(miss.sum(1) * x).sum(), -miss.sum(0)] + 1e-4 * np.r_[p[0] - 1, np.zeros(len(t))]
        hessian = np.diag(np.r_[(bend.sum(1) * x**2).sum(), bend.sum(0)] + 1e-4)
        hessian[0, 1:] = hessian[1:, 0] = -(bend * x[:, None]).sum(0)
        step = np.linalg.solve(hessian, gradient)
        p = p - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    ordered = np.maximum.accumulate(p[1:] + np.arange(len(t)) * 1e-9)
    return Model(w * p[0], ordered) if p[0] > 0 else Model(w, t)


def score(docs: DataFrame, model: Model, tail: int | None = None, cut: float = 0.5) -> DataFrame:
    """For every row: expected grade, P(grade >= ``tail``), the likeliest grade, and selected = that tail
    probability is at least ``cut``.  Without ``tail`` it is that of the top grade.

    Null and blank texts get expected grade 0, probability 0 and are not selected.  Repeated rows are scored each;
    only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            out = np.zeros((batch.num_rows, 3))
            for i, text in enumerate(texts_of(batch)):
                at, value = _KNOWN(text)
                if len(at) and len(m.thresholds):
                    over = 1 / (1 + np.exp(np.clip(m.thresholds - (m.weights[at] * value).sum(), -50, 50)))
                    single = -np.diff(np.r_[1.0, over, 0.0])
                    out[i] = over.sum(), over[min(tail or len(over), len(over)) - 1], single.argmax()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype("int32")), pa.array((out[:, 1] >= cut) & (out[:, 1] > 0))],
                ["doc_id", "expected_grade", "tail_probability", "grade", "selected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs.select("doc_id", "text"), grades(labels), **options))
