"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z only) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. The patterns are all windows of
`window` consecutive words of each benchmark item; an item of fewer words, but not none, is one window. Words are the
symbols of the search: those that no item has become 0, which matches nothing. For each pattern length there is one
machine: a shift table over hashed blocks of two symbols tells how far the text position may jump, blocks with shift 0
point to the patterns that end in them, the patterns' prefix blocks are compared next, then all symbols directly. The
jumps run for many stretches of text at once.

Documents are searched where they are read, without a shuffle. The tables are broadcast in blocks of at most
`BLOCK_WORDS` words of benchmark text, a fixed bound; a larger benchmark gives several blocks, and a longer item is cut
into parts that overlap by all but one word of a window. One block is searched in place. Of several, one at a time is
built, sent, searched and dropped; the hits of documents that it found are written, and these are put together by
document. So neither the broadcast nor the driver grows with the benchmark; each block costs a pass over the texts.

A text is contaminated if words were hit and they are at least `1 / share` of its words (`share` = 20: 5 %).

Defined cases: null and empty texts have no words and are clean; items that are null or have no words match nothing;
repeated rows get equal results; an item listed twice counts once per id; an item with a null id searches, counts in
`n_items` and is written as the text `null`; empty tables give no rows or no hits; columns of the input that clash with
result columns are replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigrane.llm.common import append_columns, materialize, packed, unpacked_rows, utf8, without

WINDOW = 13
SHARE = 20
BLOCK_WORDS = 1_000_000
TABLE_BITS = 20
STRETCH = 256

#: Lower-cases A-Z and turns every byte that no word holds into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Machine:
    """Wu-Manber tables for patterns of one length, over word numbers of 1 and more."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, self.m = patterns, patterns.shape[1]
        self.block = min(2, self.m)
        blocks = self.m - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, blocks, np.int32)
        for j in range(blocks):  # position j in the pattern, the last block gets shift 0
            np.minimum.at(self.shift, self.hashed(patterns, j), blocks - 1 - j)
        suffix = self.hashed(patterns, blocks - 1)
        order = np.argsort(suffix, kind="stable")
        self.patterns, suffix = patterns[order], suffix[order]
        self.order = order
        self.first = np.searchsorted(suffix, np.arange((1 << TABLE_BITS) + 1)).astype(np.int64)

    def hashed(self, symbols: np.ndarray, at: int) -> np.ndarray:
        a = symbols[:, at].astype(np.uint64)
        b = symbols[:, at + self.block - 1].astype(np.uint64)
        return slot(a, b)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the occurrences in `text` and the patterns that occur there."""
        n, m, gap = len(text), self.m, self.block - 1
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        at = np.arange(m - 1, n, STRETCH)  # ends of possible windows; one runner for each stretch of them
        stop = np.minimum(at + STRETCH, n)
        ends = []
        while len(at):
            step = self.shift[slot(text[at - gap].astype(np.uint64), text[at].astype(np.uint64))]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(ends)
        bucket = slot(text[ends - gap].astype(np.uint64), text[ends].astype(np.uint64))
        starts = ends - (m - 1)
        found = []
        step = 1 << 18
        for i in range(0, len(starts), step):  # bounded: at most `step` positions meet their buckets at once
            low, high = self.first[bucket[i : i + step]], self.first[bucket[i : i + step] + 1]
            k = 0
            here = starts[i : i + step]
            while len(here):  # the k-th pattern of every bucket that has one
                live = low + k < high
                here, low, high = here[live], low[live], high[live]
                p = low + k
                same = text[here] == self.patterns[p, 0]
                same &= text[here + gap] == self.patterns[p, gap]
                s, p = here[same], p[same]
                for j in range(m):
                    same = text[s + j] == self.patterns[p, j]
                    s, p = s[same], p[same]
                found.append((s, p))
                k += 1
        if not found:
            return none, none
        return np.concatenate([s for s, _ in found]), self.order[np.concatenate([p for _, p in found])]


def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Patterns:
    """The windows of a block of items, by length, and the words that they are made of."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, list[int]]] = {}
        self.items: list[str] = []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            if not ids:
                continue
            k = len(self.items)
            self.items.append(item)
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1):
                owners = by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.machines = [
            (Machine(np.array(list(windows), np.int32).reshape(len(windows), m)), list(windows.values()))
            for m, windows in sorted(by_length.items())
        ]

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Words of each text, its maximal hit runs (first word, end) and the items that occur in it."""
        known = self.words.get
        stream: list[int] = []
        starts = np.zeros(len(texts) + 1, np.int64)
        n_words = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            n_words[i] = len(words)
            stream.extend([known(w, 0) for w in words])
            stream.append(0)  # no window crosses it
            starts[i + 1] = len(stream)
        ids = np.array(stream, np.int32)
        edges = np.zeros(len(ids) + 1, np.int32)
        items: list[set[str]] = [set() for _ in texts]
        for machine, owners in self.machines:
            at, which = machine.search(ids)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + machine.m, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                items[d].update(self.items[k] for k in owners[p])
        hit = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
        step = np.diff(hit)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        doc = np.searchsorted(starts, begin, side="right") - 1
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
            runs[d].append((b - int(starts[d]), e - int(starts[d])))
        return n_words, runs, items


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Patterns in blocks of bounded size; the driver holds one block of items at a time."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("i"), F.col(f"`{text_col}`").alias("t")
    ).where(F.col("t").isNotNull())
    held: list[tuple[str, bytes]] = []
    n = 0
    step = max(1, block_words - window + 1)
    for row in rows.toLocalIterator():
        words = words_of(row["t"].encode("utf-8", "replace"))
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + step + window - 1]
            if held and n + len(part) > block_words:
                yield Patterns(held, window)
                held, n = [], 0
            held.append((row["i"], b" ".join(part)))
            n += len(part)
    if held:
        yield Patterns(held, window)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    block_words: int = BLOCK_WORDS,
    spans: bool = False,
) -> DataFrame:
    """All rows and columns of `docs` with the columns of `FIELDS`; `spans` adds the hit runs and the items' ids."""
    spark = docs.sparkSession
    extra = [
        T.StructField("hit_runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
    fields = T.StructType([*FIELDS, *extra])
    blocks = pattern_blocks(benchmark, item_col, item_text_col, window, block_words)
    first, second = next(blocks, None) or Patterns([], window), next(blocks, None)
    if second is None:
        out = append_columns(docs, text_col, fields, searcher(spark.sparkContext.broadcast(first), share))
        return out if spans else out.drop("hit_runs", "item_ids")
    # Several blocks: equal texts have equal hits, so texts are put together by their 128-bit hash.
    key = [F.xxhash64(F.col(f"`{text_col}`")), F.xxhash64(F.lit(7), F.col(f"`{text_col}`"))]
    texts = docs.select(F.col(f"`{text_col}`").alias("t"), key[0].alias("k0"), key[1].alias("k1"))
    parts, patterns = [], [first, second]
    del first, second
    while patterns:
        sent = spark.sparkContext.broadcast(patterns.pop(0))
        hits = append_columns(texts, "t", fields, searcher(sent, share)).where("n_hit > 0").select("k0", "k1", "hit_runs", "item_ids")
        parts.append(materialize(hits, "hits"))
        sent.destroy()
        patterns += [p for p in [next(blocks, None)] if p is not None]
    every = reduce(DataFrame.union, parts)
    found = every.groupBy("k0", "k1").agg(
        F.array_distinct(F.flatten(F.collect_set("hit_runs"))).alias("__runs"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("__items"),
    )
    kept = without(docs.columns, fields.fieldNames(), spark)
    beside = [key[0].alias("__k0"), key[1].alias("__k1"), F.col(f"`{text_col}`").alias("n_words")]
    rest = packed(docs, *beside, columns=kept) if kept else docs.select(F.lit(None).alias("row"), *beside)
    plain = append_columns(rest, "n_words", T.StructType([FIELDS["n_words"]]), counter)
    joined = plain.join(found, (F.col("__k0") == F.col("k0")) & (F.col("__k1") == F.col("k1")), "left")
    runs = F.coalesce(F.array_sort("__runs"), F.array().cast("array<array<bigint>>"))
    items = F.coalesce(F.array_sort("__items"), F.array().cast("array<string>"))
    # Words covered by sorted runs: each adds what lies beyond the furthest end so far.
    covered = F.aggregate(
        "hit_runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(r[0], a["end"]))).alias("n"),
            F.greatest(a["end"], r[1]).alias("end"),
        ),
    )["n"]
    out = (
        joined.withColumns({"hit_runs": runs, "item_ids": items})
        .withColumns({"n_hit": covered, "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)})
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
        .select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *fields.fieldNames())
    )
    return out if spans else out.drop("hit_runs", "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated; all their columns."""
    held = packed(docs, F.col(f"`{options.pop('text_col', 'text')}`").alias("n_words"))
    judged = decontaminate(held, benchmark, text_col="n_words", **options)
    return unpacked_rows(judged.where(~F.col("contaminated")), docs.columns)


def counter():
    return lambda column: {"n_words": np.array([len(words_of(t)) for t in utf8(column)], np.int64)}


def searcher(patterns, share: int):
    def make():
        own = patterns.value

        def work(column):
            n_words, runs, items = own.search(utf8(column))
            n_hit = np.array([sum(e - b for b, e in r) for r in runs], np.int64)
            return {
                "n_words": n_words,
                "n_hit": n_hit,
                "n_items": np.array([len(x) for x in items], np.int64),
                "items_sha256": pa.array([digest(x) for x in items], pa.string()),
                "contaminated": (n_hit > 0) & (share * n_hit >= n_words),
                "hit_runs": [[list(r) for r in x] for x in runs],
                "item_ids": [sorted(x) for x in items],
            }

        return work

    return make
