"""Language identification with string kernels.

A text is the set of its byte 1-, 2- and 3-grams (lower-cased UTF-8): the blended-spectrum *presence*
kernel of two texts is the cosine of their sets.  A bounded sample of labelled rows gives landmark
texts (Nystroem map) and training texts (kernel ridge regression, one output for each language).
Scoring builds a 0/1 matrix for a few hundred texts at a time and multiplies it through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, sampled_texts, slices, texts_of

SCHEMA = "doc_id long, lang_pred string, score double"


LOW, CHECKED = 0.01, 5  # share of labelled texts that may score less than the threshold; every so many-th row is for it


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # sorted codes of the n-grams that occur in landmarks
    landmarks: np.ndarray  # len(grams) x m, columns of unit length
    weights: np.ndarray  # m x languages
    least: float = 0.0  # the score that all but LOW of the labelled texts it did not learn from reach for some language


def gram_codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of all byte 1-, 2- and 3-grams; lengths have disjoint ranges below 2**24 + 2**16 + 2**8."""
    a = data.astype(np.int32)
    out = [a]
    if len(a) > 1:
        out.append(256 + (a[:-1] << 8) + a[1:])
    if len(a) > 2:
        out.append(256 + 65536 + (a[:-2] << 16) + (a[1:-1] << 8) + a[2:])
    return out


_CODES = 256 + 65536 + (1 << 24)


def encode(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


class Presence:
    """Rows over the landmark n-grams, by one table of all codes: presence divided by the length of the whole presence set,
    so that the product of two rows is the cosine of the sets (as far as landmarks have the n-grams, which they all do for one side)."""

    def __init__(self, grams: np.ndarray):
        self.n = len(grams)
        self.place = np.full(_CODES, self.n, np.uint16 if self.n < 65535 else np.int32)
        self.place[grams] = np.arange(self.n)

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.n + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            size = 0
            for codes in gram_codes(encode(text)):
                row[self.place[codes]] = 1
                ordered = np.sort(codes)
                size += 1 + int(np.count_nonzero(ordered[1:] != ordered[:-1])) if len(codes) else 0
            row /= max(1.0, size**0.5)  # of all its n-grams, also those that no landmark has
        return out[:, : self.n]


def labelled(docs: DataFrame) -> DataFrame:
    """Rows a model may learn from: crc32 of the id is not 2 modulo 4, language and text are known."""
    return docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out_part() != 2)
    )


def held_out_part():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0))


def fit(docs: DataFrame, per_language: int = 500, landmarks: int = 64, ridge: float = 1e-2) -> Model:
    """Learn from at most ``per_language`` different rows (id and text) of each language, those with the smallest hash of the id, however often ids or
    rows repeat.  The sample is bounded, so it may go through the driver; the rest of the corpus does not.

    The first ``landmarks`` of a language are landmarks; all languages weigh the same.  Every CHECKED-th row is left out of the regression; the
    threshold ``least`` is the LOW quantile of the best scores of these rows, whatever their label, so that wrong labels do not move it.
    Without any labelled row the model knows no language."""
    sample = sampled_texts(labelled(docs), "lang", per_language).toPandas().sort_values(["rn", "lang"], ignore_index=True)
    langs = sorted(set(sample["lang"]))
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    texts, own = sample["text"].tolist(), sample["lang"].map(langs.index).to_numpy(int)
    learn = (sample["rn"] % CHECKED != 0).to_numpy()
    marks = [texts[i] for i in np.flatnonzero(learn & (sample["rn"] <= landmarks).to_numpy())]
    grams = np.unique(np.concatenate([np.unique(c) for t in marks for c in gram_codes(encode(t))] or [np.zeros(0, np.int32)]))
    presence = Presence(grams)
    basis = presence.rows(marks).T.copy()
    near = np.concatenate([presence.rows(part) @ basis for part in _parts(texts)])
    weights = regression((basis.T @ basis).astype(np.float64), near[learn].astype(np.float64), own[learn], len(langs), ridge)
    out = near @ weights[:-1] + weights[-1]
    tested = ~learn if not learn.all() else learn
    scores = out[tested].max(1)
    return Model(langs, grams, basis, weights.astype(np.float32), float(np.clip((np.quantile(scores, LOW, method="lower") + 1) / 2, 0, 1)))


def regression(core: np.ndarray, near: np.ndarray, own: np.ndarray, langs: int, ridge: float) -> np.ndarray:
    """Weights of the landmarks' kernels and, last, a constant, one column for each language: ridge regression (of the constant, too) on the
    Nystroem map of kernels ``near`` between rows and landmarks and ``core`` among landmarks; targets are 1 for the own language, else -1, and all
    languages weigh the same, however many rows they have."""
    values, vectors = np.linalg.eigh(core)
    keep = values > 1e-6 * max(values.max(), 1e-9)
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.c_[near @ whiten, np.ones(len(near))]
    target = np.where(own[:, None] == np.arange(langs)[None], 1.0, -1.0)
    rows = np.bincount(own, minlength=langs)
    weighed = phi.T * (len(own) / langs / rows[own])
    solved = np.linalg.solve(weighed @ phi + ridge * np.eye(phi.shape[1]), weighed @ target)
    return np.r_[whiten @ solved[:-1], solved[-1:]]


def _parts(texts: list[str], n: int = 128):
    return [texts[i : i + n] for i in range(0, len(texts), n)]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row, read as whole texts.

    ``und`` with score 0 for a null text, a text without a letter, or a model without languages.  Repeated
    ids give repeated rows; ties of two languages go to the alphabetically first.  Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        presence = Presence(m.grams)
        for batch in slices(batches, 128):
            lang, score = _judge(texts_of(batch), m, presence)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _judge(texts: list[str | None], m: Model, presence: Presence) -> tuple[list[str], list[float]]:
    real = [i for i, t in enumerate(texts) if t is not None and m.langs and any(map(str.isalpha, t))]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if real:
        near = presence.rows([texts[i] for i in real]) @ m.landmarks
        out = near @ m.weights[:-1] + m.weights[-1]
        best = out.argmax(1)
        top = np.clip((out[np.arange(len(real)), best].astype(float) + 1) / 2, 0, 1)
        for i, b, s in zip(real, best, top, strict=True):
            lang[i], score[i] = m.langs[b], float(s)
    return lang, score


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict for all of them."""
    return predict(docs, fit(docs, **options))


def keep(docs: DataFrame, model: Model, least: float = 0.0, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told (not ``und``) with a score of at least ``least``
    and is among ``languages``, if given.  Rows stay where they are; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        presence = Presence(m.grams)
        for batch in slices(batches, 128):
            lang, score = _judge(texts_of(batch), m, presence)
            yield batch.filter(pa.array([g != "und" and s >= least and (languages is None or g in languages) for g, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
