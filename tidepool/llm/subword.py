"""Text classifier on averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

A text's features are its words, its 3- and 4-character grams and a mark for every word that repeats the one
before; each is hashed to one of ``BUCKETS`` vectors. The vectors' mean goes through a linear softmax. Training is
per-document gradient descent in numpy on a bounded sample of labelled rows (``max_rows``), in one task. Because
the output is linear in the mean, the trained vectors and weights fold into one number per bucket and class, so
scoring is look-ups and running sums over all texts, without a shuffle; the folded model has a fixed size.

Part of the sample (``CALIBRATION``) is not trained on: it sets the temperature of the softmax.

Texts of more than ``PIECE`` characters are read in pieces of that length (features do not span pieces, in training
and scoring alike) and their sums added, so memory is bounded while the whole text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.tokens import mixed, powers, prefix_hash

BUCKETS_LOG2 = 17
DIMENSIONS = 16
EPOCHS = 6
RATE = 1.0
GRAMS = (3, 4)
PIECE = 1 << 18
MAX_ROWS = 4000
CALIBRATION = 5  # one row in five


def _pieces(texts: list[str], lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of every text, code points, offsets) for groups of texts of about PIECE characters together."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        text = text or ""
        text = text.lower() if lower else text
        for at in range(0, max(1, len(text)), PIECE):
            part = text[at : at + PIECE]
            rows.append(row)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield _points(rows, held)
                rows, held, size = [], [], 0
    if rows:
        yield _points(rows, held)


def _points(rows: list[int], held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(x) for x in held], out=offsets[1:])
    return np.array(rows), np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


SPACE = np.zeros(0x3001, bool)
SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = True


def _features(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of feature: bucket of every feature in text order, and each text's first and end feature."""
    shift = np.uint64(64 - BUCKETS_LOG2)
    sums = prefix_hash(points)
    _, inverse = powers(len(points) + 1)
    for n in GRAMS:
        count = max(0, len(points) - n + 1)
        hashed = (sums[n : n + count] - sums[:count]) * inverse[:count]
        hashed *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        yield hashed >> shift, np.minimum(offsets[:-1], count), np.clip(offsets[1:] - n + 1, np.minimum(offsets[:-1], count), None)
    space = SPACE[np.minimum(points, 0x3000)]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = False
    edge[offsets] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]]))) if len(points) else np.zeros(0, np.int64)
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1 if len(points) else start
    words = mixed((sums[end] - sums[start]) * inverse[start])
    first = np.searchsorted(start, offsets)
    yield words >> shift, first[:-1], first[1:]
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    again = again[~np.isin(again, first)]
    where = np.searchsorted(again, first)
    yield np.zeros(len(again), np.uint64), where[:-1], where[1:]


def bags(texts: list[str], lower: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, share of the text's features) of every text."""
    out = []
    for text in texts:
        ids, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, points, offsets in _pieces([text], lower):
            found, inverse = np.unique(np.concatenate([ids, *(b for b, _, _ in _features(points, offsets))]), return_inverse=True)
            more = np.bincount(inverse[len(ids) :], minlength=len(found))
            more[inverse[: len(ids)]] += n
            ids, n = found, more
        out.append((ids.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    """``table``[bucket, class] and ``bias`` give the logits before division by ``temperature``."""

    classes: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    lower: bool
    reject_below: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, classes)."""
        total = np.zeros((len(texts), len(self.classes)))
        number = np.zeros(len(texts))
        for rows, points, offsets in _pieces(texts, self.lower):
            for buckets, first, end in _features(points, offsets):
                np.add.at(number, rows, end - first)
                for k in range(len(self.classes)):
                    running = np.zeros(len(buckets) + 1)
                    np.cumsum(self.table[k][buckets], out=running[1:], dtype=np.float64)
                    np.add.at(total[:, k], rows, running[end] - running[first])
        return _softmax((total / np.maximum(1, number)[:, None] + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], lower: bool, keep: float = 0.99) -> Model:
    """Trains on all rows but every CALIBRATION-th; ``reject_below`` keeps ``keep`` of the calibration rows."""
    classes = sorted(set(labels)) or ["?"]
    target = np.array([classes.index(x) for x in labels], np.int64)
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 1 / DIMENSIONS, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(classes))).astype(np.float32)
    bias = np.zeros(len(classes), np.float32)
    features = bags(texts, lower)
    held = np.arange(len(texts)) % CALIBRATION == 0 if len(texts) >= 10 * CALIBRATION else np.zeros(len(texts), bool)
    trained = np.flatnonzero(~held)
    steps = EPOCHS * len(trained)
    for step in range(steps):
        if step % max(1, len(trained)) == 0:
            order = rng.permutation(trained)
        row = order[step % len(trained)]
        ids, share = features[row]
        mean = share @ vectors[ids]
        error = _softmax(mean @ weights + bias)
        error[target[row]] -= 1
        rate = np.float32(RATE * (1 - step / steps))
        pull = weights @ error
        weights -= rate * np.outer(mean, error).astype(np.float32)
        bias -= np.float32(0.1) * rate * error
        vectors[ids] -= (rate * len(ids) ** 0.5 * share)[:, None] * pull
    table = np.ascontiguousarray((vectors @ weights).T)
    logits = np.array([table[:, ids] @ share + bias for ids, share in features]).reshape(-1, len(classes))
    known, answer = (logits[held], target[held]) if held.any() else (logits, target)
    temperature, below = 1.0, 0.0
    if len(known):
        loss = lambda t: -np.log(np.maximum(1e-12, _softmax(known / t)[np.arange(len(answer)), answer])).mean()
        temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
        below = float(np.quantile(_softmax(known / temperature).max(axis=1), 1 - keep))
    return Model(classes, table, bias, temperature, lower, below)


def train(labelled: DataFrame, text: str, label: str, order: list[str], lower: bool, max_rows: int = MAX_ROWS) -> Model:
    """Model of at most ``max_rows`` rows, the first by ``order`` (a hash first, so a fair sample); NULL labels are left out.

    The hash of the last row is found without the texts. The sample meets in one task; what comes to the driver is
    the folded model of fixed size.
    """
    known = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), *order)
    last = known.select(order[0]).orderBy(order[0]).limit(max_rows).agg(F.max(order[0])).first()[0]
    sample = known.filter(F.col(order[0]) <= F.lit(last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: [r[c] for c in order])[:max_rows]
        m = fit([r["text"] for r in rows], [r["label"] for r in rows], lower)
        yield pa.RecordBatch.from_pylist([{
            "classes": m.classes, "table": m.table.tobytes(), "bias": m.bias.tolist(), "temperature": m.temperature, "reject_below": m.reject_below,
        }])

    schema = "classes array<string>, table binary, bias array<double>, temperature double, reject_below double"
    got = sample.repartition(1).mapInArrow(run, schema).first()
    if got is None:
        return fit([], [], lower)
    table = np.frombuffer(bytes(got["table"]), np.float32).reshape(len(got["classes"]), -1)
    return Model(list(got["classes"]), table, np.array(got["bias"], np.float32), got["temperature"], lower, got["reject_below"])


def score(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` with one more column, ``_probabilities`` (array, in the order of ``model.classes``)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 2**BUCKETS_LOG2 floats per class
    names = [*rows.columns, "_probabilities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                p = shared.value.probabilities(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(p), pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_probabilities", T.ArrayType(T.DoubleType()))]))
