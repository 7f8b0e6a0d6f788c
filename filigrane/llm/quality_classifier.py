"""Quality classifier by supervised subword embeddings.

Every word and every character n-gram of a word is hashed to a bucket with a learned vector; a document is the average
of the vectors of all its features, and a softmax layer over it gives the class. Vectors and output layer are learned
together by stochastic gradient descent in numpy on the driver.

Learning uses at most `sample_rows` labelled ids, the first in a fixed hash order, and of rows with equal ids the one with
the least hash of its text. Executors turn their whole texts into bucket counts (at most 8 bytes a bucket), so the driver
never holds a text. Scoring reads every whole
text once, without a shuffle: the score of a text is a sum over its words, and each word is computed once per task.

Defined cases: a text without words (null, empty, blank) has no features and gets the score of the output layer's bias
alone; ids that are null or have no label are scored but not learned from; an id labelled twice counts once, with its
largest label; without labelled rows, or with one class only, every score is that of the class shares (0.5 without
any); repeated rows get equal scores; clashing columns of the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigrane.llm.common import append_columns, utf8
from filigrane.llm.subwords import WordSums, batches_of, one_of_each, sample_order, sparse_features

SAMPLE_ROWS = 4000
BUCKETS = 1 << 16
DIM = 10
ORDERS = (3, 4)
EPOCHS = 20
LEAST_STEPS = 2000
BATCH = 32
RATE = 4.0
SEED = 7


@dataclass
class Embeddings:
    """A softmax classifier over averaged vectors."""

    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    classes: list[int]

    @classmethod
    def learn(cls, labels: list[int], packed: list[bytes], *, buckets=BUCKETS, dim=DIM, epochs=EPOCHS, size=BATCH, rate=RATE, seed=SEED) -> Embeddings:
        classes = sorted(set(labels))
        rng = np.random.default_rng(seed)
        table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        out, bias = np.zeros((dim, max(1, len(classes)))), np.zeros(max(1, len(classes)))
        if len(classes) < 2:
            return cls(table, out, bias, classes)
        y = np.eye(len(classes))[[classes.index(v) for v in labels]]
        bias = np.log(y.mean(0))
        batches = batches_of(packed, size, rng)
        epochs = max(epochs, -(-LEAST_STEPS // len(batches)))
        steps, total = 0, epochs * len(batches)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                rows, b = batches[k]
                lr = rate * (1 - steps / total)
                steps += 1
                h = b.means(table)
                z = h @ out + bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                g = (p - y[rows]) / len(rows)
                back = g @ out.T
                out -= lr * (h.T @ g)
                bias -= 0.1 * lr * g.sum(0)
                table[b.cols] -= (lr * len(rows) * b.spread(back)).astype(np.float32)
        return cls(table, out, bias, classes)

    def scores(self, sums: np.ndarray, counts: np.ndarray, label: int = 1) -> np.ndarray:
        """Probability of a label, from the sums of projected vectors."""
        if label not in self.classes:
            return np.full(len(counts), 0.0 if self.classes else 0.5)
        if len(self.classes) == 1:
            return np.ones(len(counts))
        z = sums / np.maximum(counts, 1)[:, None] + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p[:, self.classes.index(label)] / p.sum(1)


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    buckets: int = BUCKETS,
    orders=ORDERS,
    **options,
) -> Embeddings:
    """Learn from the labelled rows of `docs`; `labels` holds only rows that may be learned from."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    # A first draw by the hash leaves a few times `sample_rows` ids however many there are; the first of these are taken.
    part = F.pmod(sample_order("__id"), F.lit(1_000_000_000)) / 1e9
    drawn = own.where(part * own.count() < 4 * sample_rows + 100)
    wanted = drawn.orderBy(part, "__id").limit(sample_rows)
    # At most `sample_rows` small rows are broadcast.
    sample = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(wanted), "__id")
    rows = sparse_features(one_of_each(sample, "__id"), "text", "label", orders, buckets).collect()
    rows.sort()
    return Embeddings.learn([r["label"] for r in rows], [bytes(r["packed"]) for r in rows], buckets=buckets, **options)


FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score_quality(docs: DataFrame, model: Embeddings, text_col: str = "text", orders=ORDERS) -> DataFrame:
    """All rows and columns of `docs` with score (0 to 1) and predicted (score >= 0.5)."""
    # The projected table is what scoring needs: buckets x classes, a fixed size.
    sent = docs.sparkSession.sparkContext.broadcast((model.table.astype(np.float64) @ model.out, model))

    def make():
        table, own = sent.value
        sums = WordSums(table, orders)

        def work(column):
            score = own.scores(*sums(utf8(column)))
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return work

    return append_columns(docs, text_col, FIELDS, make)
