"""Language-model scoring by prediction by partial matching (PPM), with a word unigram score beside it.

The model is a trie of byte contexts of up to three bytes, gathered from every training text. A symbol is predicted by
the longest known context; a context in which it was not seen escapes to the next shorter one with the estimate of
method C (distinct symbols over all counts plus distinct symbols), and the symbols of the longer context are excluded
from the counts of the shorter one. Below order 0 all bytes left are equally likely. Byte 255, which no UTF-8 text has,
stands before a text and ends it. A text's score is the log10 probability of its bytes and its end.

All (context, symbol) counts follow from the counts of 4-byte strings, which executors count and Spark adds up. The trie
is sent to the executors if it has at most `max_nodes` strings, a checked bound. Beyond it, nothing is broadcast: the
log probability of every distinct string is computed in groups of the two bytes before the symbol, of which the tables
below order 2 are of fixed size, and joined to the strings of each distinct text, known by its 128-bit hash. Both ways
give the same scores.

The unigram score needs each word's count in all training texts. The `FREQUENT` most frequent words, a fixed number, are
broadcast (those above a count that leaves at most so many); all other words of a text meet their counts in a shuffle join on the word.

`adaptive_score` is the same model learned from nothing while it reads one text, in plain Python.

Defined cases: null is the empty text, of which the end is still predicted; without a training text every byte has
probability 1/256 and every word log10(1) = 0; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import map_arrow, materialize, pieces, utf8

FREQUENT = 1 << 16
MAX_NODES = 4_000_000
ORDER = 3
EDGE = 255


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte strings of texts between their edges, and where each text's begin."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join([edge * ORDER + t + edge for t in texts]), np.uint8).astype(np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    if len(data) < 4:
        return np.zeros(0, np.uint32), starts
    grams = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    keep = np.ones(len(grams), bool)
    ends = np.cumsum(n + ORDER)[:-1]  # a text's strings end where the next text's edge begins
    for j in range(1, ORDER + 1):
        keep[ends - j] = False
    return grams[keep], starts


def count_grams(docs: DataFrame, text_col: str) -> DataFrame:
    """gram (as a long) and its count over all rows."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for piece in pieces(batches, text_col):
            own, n = np.unique(grams_of(utf8(piece.column(text_col)))[0], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            if len(keys) > 1 << 20:
                yield rows(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield rows(keys, counts)

    def rows(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["gram", "n"])

    return map_arrow(docs.select(text_col), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one order: their (context, symbol) strings with counts, and per context the count of all, the number
    of distinct symbols, and what the next shorter order counts for those symbols."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    excluded: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> Level:
        """grams: sorted; shorter: the count of each string without its first byte."""
        contexts, first = np.unique(grams >> 8, return_index=True)
        if not len(grams):
            return cls(grams, counts, contexts, counts, counts, counts)
        n = np.diff(np.append(first, len(grams)))
        return cls(grams, counts, contexts, np.add.reduceat(counts, first), n, np.add.reduceat(shorter, first))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted table, and which keys it has."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def shorten(grams: np.ndarray, counts: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings without their first byte, their counts, and those counts for each longer string."""
    own, at = np.unique(grams & mask, return_inverse=True)
    n = np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)
    return own, n, n[at]


class Trie:
    """PPM statistics of orders 3 to 0. `low` gives the strings of order 1 if `grams` are only a part of all."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None):
        order = np.argsort(grams)
        g3, n3 = grams[order].astype(np.int64), counts[order].astype(np.int64)
        g2, n2, s3 = shorten(g3, n3, 0xFFFFFF)
        g1, n1, _ = shorten(g2, n2, 0xFFFF)
        if low:
            g1, n1 = low
        s2 = n1[np.searchsorted(g1, g2 & 0xFFFF)] if len(g2) else n2
        g0, n0, s1 = shorten(g1, n1, 0xFF)
        self.levels = [Level.of(g3, n3, s3), Level.of(g2, n2, s2), Level.of(g1, n1, s1), Level.of(g0, n0, np.zeros(len(g0), np.int64))]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string after the others."""
        grams = grams.astype(np.int64)
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        excluded = np.zeros(len(grams), np.int64)
        gone = np.zeros(len(grams), np.int64)
        for k, level in enumerate(self.levels):
            own = grams[open_] & (0xFFFFFFFF >> (8 * k))
            at, known = find(level.contexts, own >> 8)
            spot, seen = find(level.grams, own)
            if len(level.contexts):
                n = np.where(known, level.total[at], 0) - excluded
                q = np.where(known, level.distinct[at], 0) - gone
                live = known & (q > 0)
                hit = live & seen
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[open_[hit]] += np.log10(level.counts[spot[hit]] / (n + q)[hit])
                    esc = live & ~seen
                    out[open_[esc]] += np.log10(q[esc] / (n + q)[esc])
                excluded, gone = np.where(known, level.excluded[at], 0), np.where(known, level.distinct[at], 0)
                open_, excluded, gone = open_[~hit], excluded[~hit], gone[~hit]
        out[open_] -= np.log10(np.maximum(1, 256 - gone))
        return out


def adaptive_score(text: bytes) -> float:
    """log10 probability of one text and its end under a trie that learns only from what it has read of it."""
    counts: list[dict[bytes, Counter]] = [{} for _ in range(ORDER + 1)]
    history = bytes([EDGE]) * ORDER
    score = 0.0
    for s in text + bytes([EDGE]):
        excluded: set[int] = set()
        for k in range(ORDER, -1, -1):
            seen = counts[k].get(history[len(history) - k :], Counter())
            left = {x: n for x, n in seen.items() if x not in excluded}
            if left:
                total = sum(left.values()) + len(left)
                if s in left:
                    score += math.log10(left[s] / total)
                    break
                score += math.log10(len(left) / total)
            excluded |= seen.keys()
        else:
            score -= math.log10(max(1, 256 - len(excluded)))
        for k in range(ORDER + 1):
            counts[k].setdefault(history[len(history) - k :], Counter())[s] += 1
        history = (history + bytes([s]))[-ORDER:]
    return score


def words_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words with the highest counts, at most `most`: those above a count that a histogram of the counts gives, so that
    the driver gets no more than it keeps."""
    size = F.floor(F.log(F.col("c")) * 64)
    histogram = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, held = None, 0
    for r in histogram:
        held += r["n"]
        if held > most:
            break
        least = r["size"]
    return counts.where(size >= least) if least is not None else counts.limit(0)


def score_texts(
    docs: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
    max_nodes: int = MAX_NODES,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    train: the condition on the rows to learn from.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    training = docs.where(F.coalesce(train, F.lit(False))).select(F.coalesce(text, F.lit("")).alias("text"))
    counts = materialize(training.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("c")), "words")
    grams = materialize(count_grams(training, "text"), "grams")
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    # Every training text has one end, byte 255 after something.
    ends = grams.where(F.col("gram") % 256 == EDGE).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    n_nodes = grams.count()
    total, vocabulary = n_words + ends, distinct + (ends > 0)
    mass = math.log10(total + vocabulary + 1)
    top = {r["word"].encode(): r["c"] for r in most_frequent(counts, frequent).collect()}
    trie = None
    if n_nodes <= max_nodes:
        got = grams.toPandas()
        trie = Trie(got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64))
    sent = spark.sparkContext.broadcast((top, trie))
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")
    ).withColumn("hash", F.lit(None).cast("binary") if trie else F.unhex(F.md5(F.col("text").cast("binary"))))
    id_kind = rows.schema["doc_id"].dataType
    own = f"struct<doc_id:{id_kind.simpleString()},hash:binary,n_tokens:bigint,n_known:bigint,base:double,score:double>"

    def run(batches):
        known, model = sent.value
        place = {w: i for i, w in enumerate(known)}
        logs = np.log10(np.fromiter(known.values(), np.float64, len(known)) + 1)
        for piece in pieces(batches, "text"):
            texts = utf8(piece.column("text"))
            keys = piece.column("key").to_pylist()
            out_key, out_word, out_n = [], [], []
            base, n_tokens, n_known = [], [], []
            for key, t in zip(keys, texts, strict=True):
                words = t.lower().split()
                at = np.array([place.get(w, -1) for w in words], np.int64)
                hit = at >= 0
                base.append(float(logs[at[hit]].sum()) + math.log10(ends + 1) - mass * (len(words) + 1))
                n_tokens.append(len(words) + 1)
                n_known.append(int(hit.sum()) + (ends > 0))
                if not hit.all():
                    rare = Counter(words[i] for i in np.flatnonzero(~hit).tolist())
                    out_key += [key] * len(rare)
                    out_word += rare.keys()
                    out_n += rare.values()
            score = None
            if model is not None:
                found, starts = grams_of(texts)
                u = np.unique(found)
                score = np.add.reduceat(model.log10(u)[np.searchsorted(u, found)], starts)
            ids = piece.column("doc_id")
            structs = pa.StructArray.from_arrays(
                [
                    ids, piece.column("hash"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(score if score is not None else [0.0] * len(texts), pa.float64()),
                ],
                names=["doc_id", "hash", "n_tokens", "n_known", "base", "score"],
            )
            # A text's own row has a word with a space, which no count has; its key keeps such rows apart.
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), pa.array([f" {k}" for k in keys]), pa.array([0] * len(keys), pa.int64()), structs],
                names=["key", "word", "n", "own"],
            )
            if out_key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_key, pa.int64()), pa.array(out_word, pa.binary()).cast(pa.string()), pa.array(out_n, pa.int64()), pa.nulls(len(out_key), structs.type)],
                    names=["key", "word", "n", "own"],
                )

    parts = map_arrow(rows, run, f"key bigint, word string, n bigint, own {own}")
    rare = counts.where(F.col("c") > 0)
    joined = parts.join(rare, "word", "left")
    c = F.coalesce("c", F.lit(0))
    scored = joined.select(
        "key",
        (F.col("n") * F.log10(c + 1)).alias("part"),
        F.when(c > 0, F.col("n")).otherwise(0).alias("known"),
        *[F.col(f"own.{x}").alias(x) for x in ("doc_id", "hash", "n_tokens", "n_known", "base", "score")],
    )
    per_text = scored.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        *([F.max("hash").alias("hash")] if trie is None else []),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.max("base") + F.sum("part")).alias("base_score"),
        F.max("score").alias("score"),
    )
    if trie is None:
        per_text = per_text.drop("score").join(joined_scores(rows, grams), "hash").drop("hash")
    return per_text.drop("key")


def joined_scores(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """hash and score of each distinct text without a broadcast of the trie."""

    def run(batches):
        for piece in pieces(batches, "text"):
            found, starts = grams_of(utf8(piece.column("text")))
            doc = np.repeat(np.arange(piece.num_rows), np.diff(np.append(starts, len(found))))
            pair, n = np.unique((doc.astype(np.uint64) << np.uint64(32)) | found.astype(np.uint64), return_counts=True)
            keys = piece.column("hash").take(pa.array((pair >> np.uint64(32)).astype(np.int64)))
            own = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(own), pa.array(n.astype(np.int64))], names=["hash", "gram", "n"])

    own = map_arrow(rows.select("hash", "text"), run, "hash binary, gram bigint, n bigint")
    own = own.groupBy("hash", "gram").agg(F.max("n").alias("n"))  # copies of a text have equal counts
    low = grams.groupBy((F.col("gram") % 65536).alias("g")).agg(F.sum("n").alias("n")).orderBy("g").toPandas()  # at most 65,536
    sent = rows.sparkSession.sparkContext.broadcast((low["g"].to_numpy(np.int64), low["n"].to_numpy(np.int64)))
    middle = F.floor(F.col("gram") / 256).cast("long") % 65536
    asked = own.select("gram").distinct().withColumn("middle", middle)

    def logs(known, wanted):
        trie = Trie(known["gram"].to_numpy(np.int64), known["n"].to_numpy(np.int64), sent.value)
        wanted["p"] = trie.log10(wanted["gram"].to_numpy(np.int64))
        return wanted[["gram", "p"]]

    table = grams.withColumn("middle", middle).groupBy("middle").cogroup(asked.groupBy("middle")).applyInPandas(logs, "gram bigint, p double")
    return own.join(table, "gram").groupBy("hash").agg(F.sum(F.col("n") * F.col("p")).alias("score"))
