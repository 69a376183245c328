"""Quality classifier: a factorisation machine over hashed words and structure statistics of a text.

The score is the sigmoid of  w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2),  the sum-of-squares
form of all pairwise interactions, so that scoring is linear in the number of features.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import append_columns, blocks, text_bytes, words

#: Hashed word slots, slots of the statistics, rank of the interactions.
WORD_SLOTS, STATS, BINS, RANK = 1 << 15, 12, 8, 6
SLOTS = WORD_SLOTS + STATS * (BINS + 1)
#: Labels are learned from at most so many labelled texts, chosen by the hash of their doc_id.
TRAIN_ROWS = 6000
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int8)
for _kind, _chars in enumerate((b"", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\r\n\f\v", b".,;:'\"-?()", b"!#$%&*+/<=>@[\\]^_`{|}~")):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 2


def statistics(text: bytes, found: list[bytes]) -> list[float]:
    """Twelve shares and scaled sizes, each from 0 to 1; all 0 for an empty text."""
    if not text:
        return [0.0] * STATS
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7)
    n, lines, many = len(text), text.split(b"\n"), max(1, len(found))
    letters = max(1, kinds[1] + kinds[2])
    different = len(set(found))
    return [
        min(1.0, np.log1p(n) / 14),
        min(1.0, letters / many / 16),
        kinds[1] / letters,
        kinds[3] / n,
        kinds[4] / n,
        min(1.0, kinds[5] / n * 4),
        min(1.0, kinds[6] / n * 4),
        different / many,
        1 - len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 1000),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        min(1.0, np.log1p(many) / 12),
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: word presence weighted to unit length, each statistic as itself and as one of its bins."""
    found = words(text)
    slots = np.unique(np.fromiter((crc32(w) & (WORD_SLOTS - 1) for w in set(found)), np.int64)) if found else np.zeros(0, np.int64)
    stats = np.array(statistics(text, found))
    at = WORD_SLOTS + np.arange(STATS) * (BINS + 1)
    bins = at + 1 + np.minimum(BINS - 1, (stats * BINS).astype(np.int64))
    values = np.full(len(slots), 1 / np.sqrt(max(1, len(slots))))
    return np.r_[slots, at, bins], np.r_[values, stats, np.full(STATS, 0.5)]


class Machine:
    def __init__(self, seed: int = 7):
        self.bias = 0.0
        self.weights = np.zeros((SLOTS, 1 + RANK))
        self.weights[:, 1:] = np.random.default_rng(seed).normal(0, 0.02, (SLOTS, RANK))

    def score(self, slots: np.ndarray, values: np.ndarray, start: np.ndarray) -> np.ndarray:
        """One score from 0 to 1 for each row of features, rows beginning at ``start``."""
        part = self.weights[slots] * values[:, None]
        sums = np.add.reduceat(part, start, axis=0)
        squares = np.add.reduceat((part[:, 1:] ** 2).sum(1), start)
        return 1 / (1 + np.exp(-(self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
        """Minibatch Adam on the logistic loss."""
        if not len(labels):
            return self
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(seed)
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                chosen = order[k : k + batch]
                size = np.array([len(rows[i][0]) for i in chosen])
                slots = np.concatenate([rows[i][0] for i in chosen])
                values = np.concatenate([rows[i][1] for i in chosen])[:, None]
                start = np.cumsum(size) - size
                part = self.weights[slots] * values
                sums = np.add.reduceat(part, start, axis=0)
                error = np.repeat((self.score(slots, values[:, 0], start) - labels[chosen]) / len(chosen), size)[:, None]
                grad = np.concatenate([values, values * (np.repeat(sums[:, 1:], size, axis=0) - part[:, 1:])], axis=1) * error
                full = decay * self.weights
                for c in range(1 + RANK):
                    full[:, c] += np.bincount(slots, grad[:, c], SLOTS)
                step += 1
                m += 0.1 * (full - m)
                v += 0.01 * (full**2 - v)
                self.weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                self.bias -= rate * float(error[start].sum())
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, learn=None) -> Machine:
    """A machine learned from at most ``rows`` texts that have a quality of 0 or 1, chosen by hash among those that
    the condition ``learn`` (on doc_id) admits. Of rows that share a doc_id the smallest text counts, of several labels of
    a doc_id the larger. Without any, every score is 0.5 or so."""
    known = labels.where("quality in (0, 1) and doc_id is not null")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    # the sample is bounded: one task learns from it, and only the weights come to the driver
    found = texts.select("doc_id", "quality", text_bytes()).mapInArrow(_featured, "doc_id long, quality long, slots binary, vals binary")
    learned = found.repartition(1).mapInArrow(_fitted, "bias double, weights binary").collect()
    machine = Machine()
    for row in learned:
        machine.bias, machine.weights = row["bias"], np.frombuffer(row["weights"], np.float64).reshape(SLOTS, 1 + RANK)
    return machine


def _featured(batches):
    """Rows (doc_id, quality, text) with the features of their texts."""
    for batch in batches:
        for part in blocks(batch):
            made = [features(x) for x in part.column(2).to_pylist()]
            packed = [pa.array([x[k].astype(t).tobytes() for x in made], pa.binary()) for k, t in enumerate((np.int32, np.float32))]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int64()), *packed], names=["doc_id", "quality", "slots", "vals"])


def _fitted(batches):
    """Bias and weights learned from the rows of ``_featured``, in order of doc_id."""
    ids, labels, rows = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        rows += [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    machine = Machine().fit([(rows[i][0].astype(np.int64), rows[i][1].astype(float)) for i in order], np.array(labels, float)[order])
    yield pa.RecordBatch.from_arrays([pa.array([machine.bias]), pa.array([machine.weights.tobytes()], pa.binary())], names=["bias", "weights"])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1) and predicted (1 if score >= THRESHOLD, else 0).

    Only the text is read. Null and empty texts have a score too (that of no words and no statistics); repeated
    rows get equal scores. One narrow pass; the weights are of fixed size.
    """
    known = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32)))

    def make():
        model = Machine.__new__(Machine)
        model.bias, model.weights = known.value

        def handle(block):
            made = [features(x) for x in block]
            size = np.array([len(a) for a, _ in made])
            score = model.score(np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made]), np.cumsum(size) - size)
            return {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

        return handle

    return append_columns(docs, make, "score double, predicted int")


def held_out(column: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.col(column).cast("string")) % parts == part


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = train(docs, labels, learn=~held_out())
    found = scored(docs.select("doc_id", "text"), machine)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
