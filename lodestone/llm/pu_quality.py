"""Quality classifier learned from positive and unlabelled texts.

Trusted good texts are the positives, web text without labels is the rest.  The
class prior is estimated from the two samples, and a logistic model minimises
the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_worker_state, trim_memory
from .line_cleaning import repeated_words

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "stops", "line_breaks", "non_ascii", "distinct", "top_word",
    "same_next", "log_longest", "short_words", "ends", "repeats", "dup_lines", "at_signs", "entropy", "upper_words", "symbol_words", "capital_words",
)


def features(raw: bytes) -> tuple[float, ...]:
    """Shape of a whole text (UTF-8): no vocabulary, language or source goes in."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    symbols = int(count[[35, 42, 36, 37, 38, 60, 62, 61, 123, 125, 92, 94, 126]].sum())
    bags = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = count[count > 0] / size
    return (
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        upper / max(1, upper + lower),
        digits / size,
        min(3.0, symbols / n),
        min(3.0, (int(count[33]) + int(count[63])) / n),
        int(count[124]) / n,
        (int(count[46]) + int(count[44])) / n,
        int(count[10]) / n,
        float(count[128:].sum()) / size,
        len(bags) / n**0.9,
        max(bags.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        float(np.log1p(max(map(len, bags)))),
        sum(len(w) <= 3 for w in words) / n,
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
        repeated_words(words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        int(count[64]) / n,
        float(-(share * np.log2(share)).sum()),
        sum(map(bytes.isupper, words)) / n,
        sum(not w[-1:].isalnum() and w[-1] not in b".,;:" and w[-1] < 128 for w in words) / n,
        sum(map(bytes.istitle, words)) / n,
    )


@dataclass(frozen=True)
class Model:
    """A fitted classifier: ``score = sigmoid(w . expand(x) + b)``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Distances from the trusted texts' mean, damped, and how far each lies outside of their usual range."""
        z = (x - self.mean) / self.scale
        return np.concatenate([0.3 * np.clip(z, -3, 3), np.log1p(np.maximum(0, np.abs(z) - 2))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss; whole batches, so repeated fits agree."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    theta = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    p1, u1 = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    for step in range(1, steps + 1):
        at_p, at_u = p1 @ theta, u1 @ theta
        as_bad_u, as_bad_p = np.logaddexp(0, at_u).mean(), np.logaddexp(0, at_p).mean()
        grad_good = -prior * p1.T @ sigmoid(-at_p) / len(p)
        grad_bad = u1.T @ sigmoid(at_u) / len(u) - prior * p1.T @ sigmoid(at_p) / len(p)
        # where the estimate of the negatives' risk falls below 0, that part is unlearnt
        grad = grad_good + grad_bad if as_bad_u - prior * as_bad_p >= 0 else -grad_bad
        grad = grad + decay * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def estimate_prior(p_scores: np.ndarray, u_scores: np.ndarray) -> float:
    """Share of positives in the unlabelled sample.

    Above any threshold, positives are at least as dense among the trusted as
    among the unlabelled; the least ratio of the two shares bounds the prior.
    """
    cuts = np.quantile(p_scores, np.linspace(0.0, 0.9, 91))
    above_p = 1 - np.searchsorted(np.sort(p_scores), cuts) / len(p_scores)
    above_u = 1 - np.searchsorted(np.sort(u_scores), cuts) / len(u_scores)
    margin = np.sqrt(1 / np.maximum(1, above_p * len(p_scores)) + 1 / np.maximum(1, above_u * len(u_scores)))
    return float(np.clip(((above_u / np.maximum(above_p, 1e-9)) * (1 + margin)).min(), 0.02, 0.98))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, rate: float = 0.05, decay: float = 10.0) -> Model:
    """Fit on two feature matrices; the prior is estimated unless it is given.

    ``decay`` is the weight decay of a single positive: the more there are, the
    less the weights are held back.
    """
    spread = np.concatenate([positives, unlabelled]).std(axis=0)
    blank = Model(positives.mean(axis=0), np.maximum(positives.std(axis=0), 0.1 * spread) + 1e-9, np.zeros(2 * positives.shape[1]), 0.0, 0.5)
    p, u = blank.expand(positives), blank.expand(unlabelled)
    decay /= len(positives)
    if prior is None:
        w, b = _descend(p, u, 0.5, steps // 2, rate, decay)
        prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = _descend(p, u, prior, steps, rate, decay)
    return Model(blank.mean, blank.scale, w, b, prior)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
    return np.array([features(t.as_py() or b"") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _sample_matrix(documents: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of one row (of least hash of the text) of each document named in ``ids``, whose number a parameter bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_matrix(batch).tolist(), pa.list_(pa.float64()))], ["doc_id", "hash", "x"])

    chosen = documents.selectExpr("doc_id", "xxhash64(text) as hash", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    found = chosen.mapInArrow(run, "doc_id long, hash long, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("hash", "x")).alias("row")).select("doc_id", "row.x").toPandas().sort_values("doc_id", kind="stable")
    return np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))


def held_out(doc_id) -> F.Column:
    """Whether a document belongs to the fold whose labels are never learnt from."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, max_positives: int = 20_000, max_unlabelled: int = 20_000) -> Model | None:
    """Fit on bounded samples: trusted positives and texts taken without their labels.

    Positives are documents outside the held-out fold that all their label rows
    call good.  Samples are the documents of least hash of the doc_id, each with
    one row however often its id is repeated, so the same tables give the same
    model and the driver gets ``max_positives + max_unlabelled`` rows at most.
    Without positives or texts there is no model.
    """
    learnable = ~held_out(F.col("doc_id"))
    good = labels.filter(learnable).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1 and doc_id is not null")
    drawn = lambda ids, seed, n: ids.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
    p = _sample_matrix(documents, drawn(good, 1, max_positives))
    u = _sample_matrix(documents, drawn(documents.filter(learnable).select("doc_id").distinct(), 2, max_unlabelled))
    return fit(p, u) if len(p) and len(u) else None


def score_documents(documents: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (int) of every document, in one pass without a shuffle.

    Empty and null texts get the score of a text without words.  Without a
    model every score is 0.5.  Repeated rows are scored each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(_matrix(batch)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    scored = documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose text scores at least ``threshold``.

    Null and empty texts are scored as texts without words; repeated rows each
    for itself; without a model every row stays.
    """
    names, schema = documents.columns, documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        for batch in batches:
            if model is None:
                yield batch
                continue
            good = model.scores(_matrix(batch)) >= threshold
            yield batch.filter(pa.array(good))
        trim_memory()

    return documents.mapInArrow(run, schema).select(*names)
