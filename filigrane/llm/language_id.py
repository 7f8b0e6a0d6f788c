"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. For up to `EXHAUSTIVE` languages the code is exhaustive (every way to divide the
languages in two, each once), beyond it random codewords are drawn, of which no two bits divide the languages alike. One binary logistic
classifier per bit, over hashed character n-grams of the lower-cased words, averaged over the text, predicts that bit; all are learned together by
stochastic gradient descent in numpy. Decoding is weighted by loss: a language's distance is the sum over bits of the
logistic loss of the predicted margin against its codeword, and the nearest codeword wins. The score is the softmax of
the negative distances; a text whose second language is nearly as near is flagged as ambiguous.

Learning uses at most `sample_rows` ids per language and `most_rows` of all, the first in a fixed hash order, and of rows
with equal ids the one with the least hash of its text; more than `MAX_LANGS` languages raise ValueError. So their number
and the texts' bucket counts bound what is broadcast and what the driver holds. Scoring is one pass without a shuffle over whole texts.

Defined cases: a null text, and a text without a letter, is `und` with score 0; with no row to learn from everything is
`und`; with one language every text with a letter is that language with score 1; null languages and ids are not learned
from; repeated rows get equal results; clashing columns of the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigrane.llm.common import append_columns
from filigrane.llm.subwords import WordSums, batches_of, one_of_each, sample_order, sparse_features

SAMPLE_ROWS = 800
MOST_ROWS = 16_000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
EXHAUSTIVE = 6
RANDOM_BITS = 48
EPOCHS = 12
LEAST_STEPS = 1000
BATCH = 32
RATE = 60.0
SEED = 11
AMBIGUOUS = 0.1

MAX_LANGS = 1000


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """Languages x bits, of -1 and 1."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        # All ways to divide n languages in two: bit patterns in which the first language is 1, but not all.
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for i in range(n)], float)
    rng = np.random.default_rng(seed)
    bits = RANDOM_BITS + 2 * int(np.ceil(np.log2(n)))
    best, most = None, -1
    for _ in range(200):  # the draw whose nearest two codewords are furthest apart
        drawn = rng.choice([-1.0, 1.0], (n, 4 * bits))
        drawn = drawn[:, np.abs(drawn.sum(0)) < n] * 1.0
        drawn *= drawn[0]  # a bit and its opposite divide the languages alike
        code = drawn[:, np.sort(np.unique(drawn, axis=1, return_index=True)[1])[:bits]]
        if code.shape[1] < bits:
            continue
        gram = code @ code.T
        np.fill_diagonal(gram, -np.inf)
        apart = (code.shape[1] - gram.max()) / 2
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class OutputCode:
    langs: list[str]
    code: np.ndarray
    table: np.ndarray
    bias: np.ndarray

    @classmethod
    def learn(cls, labels: list[str], packed: list[bytes], *, buckets=BUCKETS, epochs=EPOCHS, size=BATCH, rate=RATE, seed=SEED) -> OutputCode:
        langs = sorted(set(labels))
        code = codewords(len(langs), seed)
        table, bias = np.zeros((buckets, code.shape[1]), np.float32), np.zeros(code.shape[1])
        if len(langs) < 2:
            return cls(langs, code, table, bias)
        y = code[[langs.index(v) for v in labels]]
        rng = np.random.default_rng(seed)
        batches = batches_of(packed, size, rng)
        epochs = max(epochs, -(-LEAST_STEPS // len(batches)))
        steps, total = 0, epochs * len(batches)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                rows, b = batches[k]
                lr = rate * (1 - steps / total)
                steps += 1
                margin = b.means(table) + bias
                g = -y[rows] / (1 + np.exp(np.clip(y[rows] * margin, -40, 40))) / len(rows)
                bias -= 0.01 * lr * g.sum(0)
                table[b.cols] -= (lr * b.spread(g)).astype(np.float32)
        return cls(langs, code, table, bias)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language's index, its score and the second one's."""
        if len(self.langs) == 1:
            one = np.ones(len(margins))
            return np.zeros(len(margins), np.int64), one, one - 1
        loss = np.stack([np.logaddexp(0, -margins * c).sum(1) for c in self.code], 1)
        loss *= 4 / self.code.shape[1]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        first = p.argmax(1)
        ordered = np.sort(p, 1)
        return first, ordered[:, -1], ordered[:, -2]


def learn_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    most_rows: int = MOST_ROWS,
    buckets: int = BUCKETS,
    orders=ORDERS,
    **options,
) -> OutputCode:
    """Learn from `docs`, which holds only rows that may be learned from."""
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{lang_col}`").alias("label")).where("label IS NOT NULL AND __id IS NOT NULL")
    # A first draw by the hash leaves a few times `sample_rows` ids of each language, the window then takes the first.
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    n_langs = counts.count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"{n_langs} languages, at most {MAX_LANGS}")
    sample_rows = min(sample_rows, most_rows // max(1, n_langs))
    part = F.pmod(sample_order("__id"), F.lit(1_000_000_000)) / 1e9
    drawn = rows.join(F.broadcast(counts), "label").where(part * F.col("n") < 4 * sample_rows + 100)
    first = Window.partitionBy("label").orderBy(part, "__id")
    wanted = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample_rows).select("__id", "label").distinct()
    wanted = wanted.groupBy("__id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    # At most `most_rows` ids.
    sample = texts.join(F.broadcast(wanted), "__id")
    sample = one_of_each(sample, "__id")
    got = sparse_features(sample, "text", "label", orders, buckets, whole=False, repeats=False, lower=True).collect()
    got.sort()
    return OutputCode.learn([r["label"] for r in got], [bytes(r["packed"]) for r in got], buckets=buckets, **options)


FIELDS = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
)


def identify_languages(docs: DataFrame, model: OutputCode, text_col: str = "text", orders=ORDERS, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """All rows and columns of `docs` with lang_pred, score and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        sums = WordSums(own.table.astype(np.float64), orders, whole=False, repeats=False) if len(own.langs) > 1 else None

        def work(column):
            texts = column.to_pylist()
            known = np.array([t is not None and bool(own.langs) and any(map(str.isalpha, t)) for t in texts], bool)
            first, score, second = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            if known.any():
                some = [t.lower().encode("utf-8", "replace") for t, k in zip(texts, known, strict=True) if k]
                if sums:
                    total, n = sums(some)
                    margins = total / np.maximum(n, 1)[:, None] + own.bias
                else:
                    margins = np.zeros((len(some), 0))
                first[known], score[known], second[known] = own.decode(margins)
            langs = [own.langs[i] if k else "und" for i, k in zip(first, known, strict=True)]
            return {"lang_pred": pa.array(langs, pa.string()), "score": score, "ambiguous": known & (score - second < ambiguous)}

        return work

    return append_columns(docs, text_col, FIELDS, make)
