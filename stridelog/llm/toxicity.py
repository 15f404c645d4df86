"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, is_held_out, staged

#: Bounds of the sample that is learned from: rows, and code points of a text.
POSITIVE_ROWS = 2000
UNLABELLED_ROWS = 6000
TRAIN_CHARS = 10_000
#: Features are those of at least MIN_ROWS positive rows and MIN_SHARE of them (copies of a few
#: rows must not pass for evidence) that are more frequent in positive rows by at least
#: MIN_DIFFERENCE standard errors and whose rows are, by the share of toxic labels, toxic with a
#: probability of MIN_TOXIC or more; of these the FEATURES most significant.
MIN_ROWS = 5
MIN_SHARE = 0.02
MIN_DIFFERENCE = 5.0
MIN_TOXIC = 0.5
FEATURES = 4000
PAIRS = "doc_id bigint, positive int, feature binary"
THRESHOLD = 0.3
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"

# A word is a run of ASCII letters and digits and of all characters beyond ASCII, in lower case.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
#: Lengths in bytes of the word beginnings that are features besides whole words: languages
#: inflect, so an insult is often seen with an ending that the sample does not have.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def features_of(text: str | None) -> set[bytes]:
    words = set((text or "").encode().translate(_TO_WORDS).split())
    found = set(words)
    for n in BEGINNINGS:
        found.update(b"^" + w[:n] for w in words if len(w) > n)
    return found


class Model:
    """Weights by feature and a bias; the score is the logistic function of their sum."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        known = self.weights.keys() & features_of(text)
        total = self.bias + sum(sorted(self.weights[w] for w in known))
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    n_features: int,
    prior: float,
    steps: int = 600,
    rate: float = 0.05,
    shrink: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative PU risk under the sigmoid loss.

    The risk is prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)).
    While the second term is negative, which only overfitting can make it, its gradient is
    followed upwards instead. The sigmoid loss is bounded, so a few rows far on one side cannot
    turn the term. Each row is the array of its features. Weights shrink towards zero (soft
    threshold), so features without evidence carry none.
    """
    rows = [*positive, *unlabelled]
    sizes = np.array([len(r) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    is_positive = np.arange(len(rows)) < len(positive)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    weights, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    mean = np.zeros(n_features + 1)
    square = np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        margin = bias + np.bincount(row, weights[column], len(rows))
        p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        negative = p[~is_positive].sum() / n_u - prior * p[is_positive].sum() / n_p
        steep = p * (1 - p)
        slope = steep * np.where(is_positive, -prior / n_p, 1 / n_u)
        if negative < 0:
            slope = -slope
        else:
            slope = slope - np.where(is_positive, prior / n_p, 0) * steep
        gradient = np.append(np.bincount(column, slope[row], n_features), slope.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        bias -= move[-1]
        weights -= move[:-1]
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - shrink)
    return weights, float(bias)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on documents that are not held out: confirmed toxic ones and a sample of all.

    Positives are rows that a label marks toxic, unlabelled ones any rows, labelled or not. Both
    samples are bounded (the rows whose ids hash lowest, among texts of at most ``TRAIN_CHARS``
    code points), and only the numbers of the rows' chosen features reach the driver. The class
    prior is the share of toxic rows among the labelled ones, or less where the unlabelled rows
    show fewer of the positive rows' features than that share needs. Without a positive row the model
    is the constant prior 0.
    """
    spark = docs.sparkSession
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return Model({}, -50.0)
    ids = docs.filter((F.length("text") <= TRAIN_CHARS) & F.col("doc_id").isNotNull())
    ids = ids.filter(~is_held_out(F.col("doc_id"))).select("doc_id")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.filter("toxic = 1").select("doc_id")
    positive = ids.join(toxic, "doc_id", "left_semi").orderBy(*by_hash).limit(POSITIVE_ROWS)
    unlabelled = ids.orderBy(*by_hash).limit(UNLABELLED_ROWS)
    sample = [
        (r.doc_id, side)
        for side, rows in enumerate((unlabelled, positive))
        for r in rows.distinct().collect()
    ]
    sample_ids = F.broadcast(spark.createDataFrame(sample, "doc_id bigint, positive int"))
    pairs = staged(
        docs.select("doc_id", "text").join(sample_ids, "doc_id").mapInArrow(_explode, PAIRS),
        "features",
    )
    n_p = sum(side for _, side in sample)
    n_u = len(sample) - n_p
    p = F.col("in_p") / max(1, n_p)
    u = F.col("in_u") / max(1, n_u)
    both = (F.col("in_p") + F.col("in_u")) / (n_p + n_u)
    # Standard errors by which the shares of rows with the feature differ.
    differ = (p - u) / F.sqrt(both * (1.000001 - both) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    prior = min(max(float(share), 1e-3), 0.5)
    mostly_toxic = prior * p >= MIN_TOXIC * u
    chosen = (
        pairs.groupBy("feature")
        .agg(F.sum("positive").alias("in_p"), F.sum(1 - F.col("positive")).alias("in_u"))
        .filter(F.col("in_p") >= max(MIN_ROWS, MIN_SHARE * n_p))
        .filter(mostly_toxic & (differ >= MIN_DIFFERENCE))
        .orderBy(differ.desc(), "feature")
        .limit(FEATURES)
    )
    words = [bytes(r.feature) for r in chosen.collect()]
    numbers = F.broadcast(
        spark.createDataFrame([(w, i) for i, w in enumerate(words)], "feature binary, number int")
    )
    found = (
        pairs.join(numbers, "feature")
        .groupBy("doc_id", "positive")
        .agg(F.array_sort(F.collect_set("number")).alias("numbers"))
        .collect()
    )
    rows: dict[tuple[int, int], np.ndarray] = {(i, s): np.zeros(0, np.int64) for i, s in sample}
    for r in found:
        rows[r.doc_id, r.positive] = np.array(r.numbers, np.int64)
    ordered = sorted(rows)
    positives = [rows[k] for k in ordered if k[1]]
    others = [rows[k] for k in ordered if not k[1]]
    # However toxic rows are spread, u(A) >= prior * p(A) for any event A, here "has a feature".
    hit_p, hit_u = (np.mean([len(r) > 0 for r in side] or [0]) for side in (positives, others))
    bound = hit_u / hit_p if hit_p and hit_u else prior
    weights, bias = fit_nnpu(positives, others, len(words), min(prior, float(bound)))
    return Model({w: float(x) for w, x in zip(words, weights, strict=True) if x}, bias)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = sorted(features_of(row["text"]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["doc_id"]] * len(found), pa.int64()),
                    pa.array([row["positive"]] * len(found), pa.int32()),
                    pa.array(found, pa.binary()),
                ],
                ["doc_id", "positive", "feature"],
            )


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: probability that its whole text is toxic.

    NULL and empty texts get the score of a text without known features. Rows are independent: ids
    may be NULL or repeated. Only id and text are read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(2)], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").alias("text"),
    ).mapInArrow(score, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``."""
    model = learn(docs, labels)
    position = docs.columns.index("text")
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position)
            yield batch.filter(pa.array([model.score(t.as_py()) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, learn(docs, labels))
