"""Hashed word and character n-gram features, shared by the two classifiers.

A word is a run of characters other than space and the ASCII controls 9-13. Its features are hashes, modulo a number of
buckets, of the word itself and of its character n-grams with `<` and `>` as borders. A document's features are those of
its words with their number, and one feature for each word that repeats the one before it. Linear scores over averaged
features are sums over words, so a task computes each distinct word once and then only looks it up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import map_arrow, pieces, utf8

CACHE_WORDS = 400_000
REPEAT = 0  # the bucket of a repeated word; hashes use the others


def word_features(words: list[bytes], orders: Iterable[int], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) for each feature of each word."""
    texts = [w.decode("utf-8", "replace") for w in words]
    chars = np.frombuffer(("<" + "><".join(texts) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters up to the word's end
    owners, found = [], []
    if whole:
        owners.append(np.arange(len(words)))
        found.append(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15))
    for n in orders:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ chars[j : len(chars) - n + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        inside = left[: len(h)] >= n
        owners.append(owner[: len(h)][inside])
        found.append(h[inside] * np.uint64(0x9E3779B97F4A7C15))
    slots = (np.concatenate(found) >> np.uint64(24)) % np.uint64(buckets - 1) + np.uint64(1)
    return np.concatenate(owners), slots.astype(np.int64)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class WordSums:
    """For each text the sum over its features of rows of `table`, and the number of its features."""

    def __init__(self, table: np.ndarray, orders: Iterable[int], whole: bool = True, repeats: bool = True):
        self.table, self.orders, self.whole, self.repeats = table, tuple(orders), whole, repeats
        self.forget()

    def forget(self) -> None:
        self.words = Words()
        self.sums = np.zeros((0, self.table.shape[1]))
        self.counts = np.zeros(0, np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.forget()
        known = len(self.words)
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((self.words[w] for words in split for w in words), np.int64, int(n.sum()))
        new = list(self.words)[known:]
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            owner, slot = word_features(some, self.orders, len(self.table), self.whole)
            sums = np.stack([np.bincount(owner, weights=c[slot], minlength=len(some)) for c in self.table.T], 1)
            self.sums = np.concatenate([self.sums, sums])
            self.counts = np.concatenate([self.counts, np.bincount(owner, minlength=len(some))])
        doc = np.repeat(np.arange(len(texts)), n)
        out = np.stack([np.bincount(doc, weights=c[ids], minlength=len(texts)) for c in self.sums.T], 1)
        total = np.bincount(doc, weights=self.counts[ids], minlength=len(texts)).astype(np.int64)
        if self.repeats and len(ids):
            again = np.bincount(doc[1:], weights=(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]), minlength=len(texts)).astype(np.int64)
            out += again[:, None] * self.table[REPEAT]
            total += again
        return out, total


def sparse_features(sample: DataFrame, text_col: str, label_col: str, orders, buckets: int, whole: bool = True, repeats: bool = True, lower: bool = False) -> DataFrame:
    """Per row of a bounded sample its label and its buckets with counts, as packed arrays: at most 8 bytes a bucket,
    however long the text is."""

    def run(batches):
        for piece in pieces(batches, text_col):
            rows = []
            for text in utf8(piece.column(text_col)):
                if lower:
                    text = text.decode("utf-8", "replace").lower().encode()
                counted: dict = {}
                words = text.split()
                for w in words:
                    counted[w] = counted.get(w, 0) + 1
                slots, weights = np.zeros(0, np.int64), np.zeros(0)
                if counted:
                    owner, slot = word_features(list(counted), orders, buckets, whole)
                    weight = np.fromiter(counted.values(), np.int64, len(counted))[owner]
                    slots, at = np.unique(slot, return_inverse=True)
                    weights = np.bincount(at, weights=weight)
                again = sum(a == b for a, b in zip(words, words[1:], strict=False)) if repeats else 0
                if again:
                    slots, weights = np.append(slots, REPEAT), np.append(weights, again)
                rows.append(slots.astype("<i4").tobytes() + weights.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([piece.column(label_col), pa.array(rows, pa.binary())], names=["label", "packed"])

    kind = sample.schema[label_col].dataType.simpleString()
    return map_arrow(sample.select(label_col, text_col), run, f"label {kind}, packed binary")


def unpacked(rows: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets, and their shares in all features of the row."""
    slots, shares = [], []
    for r in rows:
        n = len(r) // 8
        slots.append(np.frombuffer(r, "<i4", n))
        w = np.frombuffer(r, "<f4", n, offset=4 * n)
        shares.append(w / max(1.0, float(w.sum())))
    return slots, shares


def sample_order(id_col: str) -> Column:
    """A fixed order that does not follow the ids."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("string"))


def one_of_each(sample: DataFrame, id_col: str) -> DataFrame:
    """label and text of one row for each id of a sample: of rows with equal ids that with the least hash of its text.
    An id may have any number of rows, so they meet pre-aggregated."""
    best = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"), F.col("label").alias("label")))
    return sample.groupBy(id_col).agg(best.alias("one")).select("one.label", "one.text")


class Batch:
    """Rows of a mini-batch as entries sorted by row, and the same entries sorted by bucket."""

    def __init__(self, slots: list[np.ndarray], shares: list[np.ndarray]):
        n = np.array([len(s) for s in slots])
        self.n_rows = len(slots)
        self.rows = np.repeat(np.arange(len(slots), dtype=np.int32), n)
        cols = np.concatenate(slots) if len(slots) else np.zeros(0, np.int32)
        self.cols, at = np.unique(cols, return_inverse=True)
        self.at = at.astype(np.int32)
        self.share = np.concatenate(shares).astype(np.float32)
        self.by_col = np.argsort(self.at, kind="stable").astype(np.int32)
        self.edges = np.searchsorted(self.at[self.by_col], np.arange(len(self.cols)))

    def means(self, table: np.ndarray) -> np.ndarray:
        own = table[self.cols][self.at] * self.share[:, None]
        return np.stack([np.bincount(self.rows, weights=c, minlength=self.n_rows) for c in own.T], 1)

    def spread(self, grad: np.ndarray) -> np.ndarray:
        """Gradient of each bucket in `cols` from the gradient of each row's mean."""
        own = (grad[self.rows] * self.share[:, None])[self.by_col]
        return np.add.reduceat(own, self.edges, axis=0) if len(self.edges) else np.zeros((0, grad.shape[1]))


def batches_of(packed: list[bytes], size: int, rng: np.random.Generator) -> list[tuple[np.ndarray, Batch]]:
    slots, shares = unpacked(packed)
    order = rng.permutation(len(packed))
    return [(rows, Batch([slots[i] for i in rows], [shares[i] for i in rows])) for rows in np.array_split(order, max(1, len(order) // size))]
