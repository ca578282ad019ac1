"""Quality classifier by importance resampling.

Two bag-of-hashed-n-gram models, of the target text (documents labelled good) and of all raw text, give each document
the logarithm of its importance weight: the mean log ratio of its n-grams, as if it had ``TEMPER`` of them, so that
long documents do not drown the noise. The sample is drawn without replacement by Gumbel top-k: the k documents whose
weight plus Gumbel noise is largest stay. k is a parameter; by default it is the number of documents that are expected
to be good, by a logistic regression of the labels on the weight, and a share ``EXTRA`` of all beyond them, which the noise
draws from the others in proportion to their weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint, kth_largest, small_frame

BUCKETS = 1 << 14
SMOOTHING = 1.0
SEED = 20
#: Labelled documents of each class that fit the target model and the regression, at most: those of the smallest hashes.
MAX_LABELLED = 20000
#: N-grams that a document weighs as, and the share of all documents that is drawn beyond the expected good ones.
TEMPER, EXTRA = 10.0, 0.01
#: Scores are compared as whole millionths, so that ties are exact.
UNIT = 1_000_000
_TOKENS = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """A word's hash, kept for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = crc32(word.encode("utf-8", "surrogatepass"))
        return h


def _buckets(text: str | None, hashes: _Hashes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and word pairs of a text, in lower case; runs of marks are words.

    A word that follows itself makes the pair of a repeat, whatever the word.
    """
    words = _TOKENS.findall((text or "").lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
    pairs[h[:-1] == h[1:]] = 0
    return np.concatenate((h, pairs)).astype(np.int64) % buckets


@dataclass
class Model:
    """Log ratios by bucket, and the labelled ids, by whether they are good, that a regression may use."""

    ratios: np.ndarray
    labelled: dict[int, bool] = field(default_factory=dict)

    def weight(self, text: str | None, hashes: _Hashes) -> float:
        found = _buckets(text, hashes, len(self.ratios))
        return TEMPER * float(self.ratios[found].mean()) if len(found) else 0.0


def _sampled(labels: DataFrame, quality: int) -> set[int]:
    rows = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    return {r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()}


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> Model:
    """Count n-grams of all rows of ``docs`` and of the labelled good ones, in one scan.

    Tasks add up their own counts; the driver gets two numbers for each bucket. Without a good label all log weights
    are zero. An id that is labelled both ways counts as good.
    """
    good, bad = _sampled(labels, 1), _sampled(labels, 0)

    def count(batches) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = _Hashes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        held: tuple[list, list] = ([], [])
        n = 0

        def add_up() -> None:
            for sums, parts in zip((raw, target), held):
                if parts:
                    sums += np.bincount(np.concatenate(parts), minlength=buckets)
                    parts.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _buckets(text, hashes, buckets)
                held[0].append(found)
                if doc_id in good:
                    held[1].append(found)
                n += len(found)
                if n > 1 << 20:
                    add_up()
                    n = 0
        add_up()
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    counts = docs.select(*columns).mapInArrow(count, "bucket long, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    log = lambda x: np.log(x + SMOOTHING) - np.log(x.sum() + SMOOTHING * buckets)
    ids = {i: True for i in good} | {i: False for i in bad - good}
    return Model(log(target) - log(raw) if target.sum() else np.zeros(buckets), ids if target.sum() and bad - good else {})


def _regression(scored: list[tuple[float, bool]]) -> tuple[float, float]:
    """Slope and intercept of the log odds of being good, by Newton steps; a small penalty on the slope keeps it finite."""
    x, y = np.array([[w, 1.0] for w, _ in scored]), np.array([float(g) for _, g in scored])
    b, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += np.clip(step, -2, 2)
    return float(b[0]), float(b[1])


def weights(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, log_weight)`` per row; an empty or null text weighs 0."""

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            w = [model.weight(t, hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, log_weight double")


def gumbel(doc_id: Column, seed: int | Column = SEED) -> Column:
    """Gumbel noise that is a function of the document and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def key(weight: Column, doc_id: Column, seed: int | Column = SEED) -> Column:
    """The weight with noise, in whole millionths."""
    return F.floor((weight + gumbel(doc_id, seed)) * UNIT).cast("long")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, model: Model | None = None) -> DataFrame:
    """``(doc_id, log_weight, score, kept)`` per row of ``docs``.

    ``k`` rows stay: by default those expected to be good and ``EXTRA`` of all; all of them where the labels lack a class.
    Rows that tie with the last one stay too, so copies of a row, with its id, share its fate. A null text is an empty one,
    which weighs 0; a null doc_id has the noise of a null. Where there are no rows the result is empty. Labels that repeat
    or have nulls count once or not at all.
    """
    model = model or fit(docs, labels)
    rows = checkpoint(weights(docs, model).withColumn("key", key(F.col("log_weight"), F.col("doc_id"), seed)))
    last = _last(rows, model, k)
    return rows.select("doc_id", "log_weight", (F.col("key") / UNIT).alias("score"), (F.col("key") >= last).alias("kept"))


def _last(rows: DataFrame, model: Model, k: int | None) -> int:
    """The least key that stays, of rows ``(doc_id, log_weight, key)``."""
    if k is None:
        k = expected(rows, model)
    last = kth_largest(rows, "key", k)
    return (-(1 << 63) if k else (1 << 63) - 1) if last is None else last


def expected(rows: DataFrame, model: Model) -> int:
    """How many of the rows are expected to be good, and the extra share."""
    if not model.labelled:
        return rows.count()
    ids = small_frame(rows.sparkSession, sorted(model.labelled.items()), "doc_id long, good boolean")
    # one row for each labelled id, of which there are at most twice MAX_LABELLED
    sample = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "good").agg(F.max("log_weight").alias("w")).orderBy("doc_id").collect()
    if len({r.good for r in sample}) < 2:
        return rows.count()
    slope, start = _regression([(r.w, r.good) for r in sample])
    n, good = rows.agg(F.count("*"), F.sum(1 / (1 + F.exp(-(F.col("log_weight") * slope + start))))).first()
    return min(n, round(good or 0) + math.ceil(EXTRA * n))


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, all columns unchanged, without a shuffle of the texts.

    Rows and their keys are checkpointed, so texts are read twice: to count, and to weigh.
    """
    model = fit(docs, labels)

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        hashes = _Hashes()
        return pa.array([model.weight(t, hashes) for t in texts.to_pylist()], pa.float64())

    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), weight(F.col("text").cast("string")).alias("log_weight"))
    rows = checkpoint(rows.withColumn("key", key(F.col("log_weight"), F.col("doc_id"), seed)))
    last = _last(rows.select("doc_id", "log_weight", "key"), model, k)
    return rows.where(F.col("key") >= last).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
