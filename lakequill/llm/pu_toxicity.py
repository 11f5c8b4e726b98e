"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are set against unlabelled ones, toxic texts among them. With class prior p the risk is
p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)): the second part estimates the risk on the negatives, and where it turns
negative (the model has begun to fit single texts) the step goes the other way. Features are the presence of
words, hashed; several linear classifiers are trained in numpy on a bounded sample and averaged. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, pick, text_chunks

FEATURE_BITS = 20
#: Beginnings of words, in bytes, that are features beside the words: inflected forms share them.
PREFIXES = (4, 5, 6)
#: Bounds of the training sample; texts with the least hash of their id are taken.
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 14_000
#: Features of one text of the sample, at most; so the driver gets 160 MB at most. Scores are of all features.
MAX_TERMS = 2048
#: Rows with this remainder of crc32(id as text) are held out of training.
FOLDS, HELD_OUT = 5, 0
CLASSIFIERS = 3
STEPS = 150
#: Features are kept whose shares among positive and unlabelled texts differ by so many deviations.
MIN_DEVIATIONS = 4.5
WEIGHT_DECAY = 2e-3
RATE = 0.08


@dataclass
class Model:
    weights: np.ndarray  # one per hashed feature
    bias: float

    def margins(self, indices: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _row_sums(self.weights[indices], first) + self.bias


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[first[1:]] - sums[first[:-1]]


class _Terms(Words):
    """Words cut at white space and at ASCII marks."""

    _space = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and beginnings of each text: (indices, first index of each text and the end)."""
    words = _Terms(texts, fold_case=True)
    hashes = np.concatenate((words.hashes, *(words.prefixes(size) + np.uint64(size) for size in PREFIXES)))
    slots = (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    owner = np.tile(np.repeat(np.arange(len(texts)), np.diff(words.first)), 1 + len(PREFIXES))
    keys = np.unique(owner << FEATURE_BITS | slots)
    return keys & ((1 << FEATURE_BITS) - 1), np.searchsorted(keys, np.arange(len(texts) + 1) << FEATURE_BITS)


def train(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float, seed: int = 7) -> Model:
    """Average of CLASSIFIERS linear models, each on its own bootstrap of the rows."""
    size = 1 << FEATURE_BITS
    found = [np.bincount(i, minlength=size) for i, _ in (positive, unlabelled)]
    rows = [max(1, len(f) - 1) for _, f in (positive, unlabelled)]
    pooled = (found[0] + found[1]) / sum(rows)
    deviation = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / rows[0] + 1 / rows[1]))
    usable = np.flatnonzero(np.abs(found[0] / rows[0] - found[1] / rows[1]) >= MIN_DEVIATIONS * deviation)
    usable = usable[found[0][usable] + found[1][usable] >= 4]
    column = np.full(size, -1)
    column[usable] = np.arange(len(usable))
    total, bias = np.zeros(len(usable)), 0.0
    rng = np.random.default_rng(seed)
    parts = []
    for indices, first in (positive, unlabelled):
        columns = column[indices]
        inside = columns >= 0
        starts = np.concatenate(([0], np.cumsum(inside)))[first]
        parts.append((columns[inside], starts))
    for _ in range(CLASSIFIERS):
        weights, step = _fit(parts, [rng.poisson(1.0, len(f) - 1).astype(float) for _, f in parts], prior, len(usable))
        total += weights / CLASSIFIERS
        bias += step / CLASSIFIERS
    out = np.zeros(size, np.float32)
    out[usable] = total
    return Model(out, bias)


def _fit(parts: list, counts: list[np.ndarray], prior: float, size: int) -> tuple[np.ndarray, float]:
    w = np.zeros(size + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    (pc, pf), (uc, uf) = parts
    cp, cu = (c / max(c.sum(), 1.0) for c in counts)
    for t in range(1, STEPS + 1):
        # Logistic loss: loss(z) for a positive is log(1 + e^-z), for a negative log(1 + e^z).
        zp, zu = _row_sums(w[pc], pf) + w[-1], _row_sums(w[uc], uf) + w[-1]
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative_risk = cu @ np.logaddexp(0, zu) - prior * (cp @ np.logaddexp(0, zp))
        if negative_risk >= 0:
            gp, gu = cp * (prior * (sp - 1) - prior * sp), cu * su
        else:
            gp, gu = cp * prior * sp, -cu * su
        grad = np.zeros(size + 1)
        for columns, first, slope in ((pc, pf, gp), (uc, uf, gu)):
            grad += np.bincount(columns, np.repeat(slope, np.diff(first)), size + 1)
        grad[:-1] += WEIGHT_DECAY * w[:-1]
        grad[-1] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w[:-1], float(w[-1])


def _fold(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def fit_on_tables(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on at most MAX_POSITIVE + MAX_UNLABELLED texts of ``docs(doc_id, text)``; None without positives among them."""
    seen = labels.where((_fold("doc_id") != HELD_OUT) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = seen.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    if not counts["p"]:
        return None
    prior = min(max(counts["p"] / counts["n"], 1e-3), 0.5)
    least = F.xxhash64("doc_id")
    chosen = [
        [r["doc_id"] for r in ids.orderBy(least, "doc_id").limit(bound).collect()]  # bounded
        for ids, bound in (
            (seen.where("toxic = 1").select("doc_id"), MAX_POSITIVE),
            (docs.where(_fold("doc_id") != HELD_OUT).select("doc_id").distinct(), MAX_UNLABELLED),
        )
    ]
    wanted = sorted({*chosen[0], *chosen[1]})
    sample = spark.createDataFrame([(i,) for i in wanted], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            indices, first = features(texts)
            lists = [_some_terms(indices[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "terms"])

    near = docs.join(F.broadcast(sample), "doc_id", "left_semi").select("doc_id", "text")
    rows = near.mapInArrow(run, "doc_id long, terms array<int>").toArrow().sort_by("doc_id")
    ids = rows.column("doc_id").to_numpy()
    terms = rows.column("terms").combine_chunks()
    flat, first = terms.values.to_numpy(), terms.offsets.to_numpy().astype(np.int64)

    def part(chosen_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.isin(ids, chosen_ids))
        lengths = (first[1:] - first[:-1])[at]
        pieces = [flat[first[i] : first[i + 1]] for i in at]
        return np.concatenate(pieces) if pieces else flat[:0], np.concatenate(([0], np.cumsum(lengths)))

    positive, unlabelled = part(chosen[0]), part(chosen[1])
    if len(positive[1]) < 2 or len(unlabelled[1]) < 2:
        return None
    return train(positive, unlabelled, prior)


def _some_terms(terms: np.ndarray) -> np.ndarray:
    """At most MAX_TERMS of a training text's features, chosen by hash, in their order."""
    if len(terms) <= MAX_TERMS:
        return terms
    least = np.argpartition(mix(terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), MAX_TERMS)[:MAX_TERMS]
    return terms[np.sort(least)]


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for every row of ``docs``.

    Null and empty texts have no features and get the score of the bias. Rows without an id are scored, never
    trained on, and not held out. Labels of rows that are held out, and null ones, are never read;
    of several for one id the highest counts. Without any confirmed toxic text every score is 0.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    model = fit_on_tables(spark, docs, pick(labels, doc_id="doc_id", toxic="toxic"))
    shared = spark.sparkContext.broadcast(model)  # one weight per hashed feature, 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            if shared.value is None:
                scores = np.zeros(len(texts))
            else:
                scores = 1 / (1 + np.exp(-np.clip(shared.value.margins(*features(texts)), -500, 500)))
            arrays = [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted"])

    scored = docs.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
