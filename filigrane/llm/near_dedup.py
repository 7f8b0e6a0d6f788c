"""MinHash near-deduplication with DartMinHash signatures.

A text is the multiset of its shingles of `shingle` words (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a text of fewer
words, but not none, is one shingle. Similarity is weighted Jaccard of the shingle counts. For each shingle, darts are
thrown by hash into the region (weight x time) that it spans: bands of weight [0, 1), [1, 2), [2, 4), ... each have a
Poisson process of darts in time, and a dart carries a coordinate out of `k`. A text keeps the darts below its weights
and, for each coordinate, the earliest; two texts agree in a coordinate with the probability of their similarity. Time
runs until about k ln k + 2k darts are in, and is doubled for texts that leave a coordinate empty, so short and long
texts cost the same few darts besides one look at each shingle.

`bands` groups of `rows` coordinates are the bucket keys of the join. Work goes from texts to distinct texts (by their
128-bit hash, pre-aggregated), from buckets to links, from links to classes:

1. every member of a bucket is linked to the bucket's leader, the member with the most bucket mates, if their exact
   similarity is `threshold` or more;
2. links are joined to connected components (alternating large and small stars, each step written to shared storage);
3. buckets that still hold several components are compared in pairs of blocks of about `BLOCK` members by their
   signatures; pairs of different components that agree well enough are checked exactly, in place, until a member has a
   link to the other component. The members of a bucket's largest component are in blocks of their own, which meet the
   others' but not each other: the work is that of the texts outside it times the bucket, not the bucket's square.

So a group of thousands of copies costs one link per text and bucket, no pairs are emitted within a group, and no link
between texts that share a bucket is lost but for a chance of 3e-8: step 3 looks at pairs whose signatures agree in at
least the threshold less `SIGMAS` standard deviations, which a pair of similarity 0.8 fails that often. Groups meet in
joins that Spark can split and in pre-aggregated minima. With 25 bands of 5 rows a pair of similarity 0.8 is missed with
probability 5e-5.

Defined cases: a null text is a class of its own; texts without words are in one class if they are equal; repeated
rows are in one class and one of them stays; null ids come first when a class's document is chosen; an empty table gives
an empty result; other columns pass through `drop_near_duplicates` untouched, whatever their names; of rows equal in id and
text that differ in other columns any one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import map_arrow, materialize, narrowed, packed, pieces, unpacked_rows, utf8

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
BLOCK = 512
SIGMAS = 6
CACHE_WORDS = 200_000

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[bytes], size: int, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of texts and how many each has."""
    if len(words) > CACHE_WORDS:
        words.clear()
    split = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter((words[w] for ws in split for w in ws), np.uint64, int(n.sum()))
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    starts = np.cumsum(n) - n
    at = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    short = np.repeat(n < size, count)
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        if len(h):
            inside = ~short | (at + j < np.repeat(starts + n, count))
            out = np.where(inside, mix(out * C1 + h[np.minimum(at + j, len(h) - 1)] + np.uint64(j + 1)), out)
    return out, count


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The earliest dart of each coordinate (n_docs x k); which documents have elements at all."""
    total = np.bincount(doc, weights=weights, minlength=n_docs)
    sig = np.zeros((n_docs, k), np.uint64)
    with np.errstate(divide="ignore"):
        until = (k * np.log(k) + 2 * k) / total
    # Regions: band 0 is [0, 1), band b is [2**(b-1), 2**b).
    n_bands = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    region = np.repeat(np.arange(len(elements)), n_bands)
    band = np.arange(len(region)) - np.repeat(np.cumsum(n_bands) - n_bands, n_bands)
    low = np.where(band == 0, 0.0, 2.0 ** (band - 1))
    width = np.where(band == 0, 1.0, low)
    seed = mix(elements[region] ^ (band.astype(np.uint64) * C1))
    owner, weight = doc[region], weights[region]
    open_ = total > 0
    while open_.any():
        live = np.flatnonzero(open_[owner])
        at = np.zeros(len(live))
        darts: list[tuple] = []
        t = 0
        while len(live):
            t += 1
            h = mix(seed[live] + np.uint64(t * int(C1) % (1 << 64)))
            at = at - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width[live]
            inside = at <= until[owner[live]]
            live, at, h = live[inside], at[inside], h[inside]
            g = mix(h ^ C3)
            height = low[live] + width[live] * ((g >> np.uint64(11)).astype(np.float64) / 2.0**53)
            hit = height < weight[live]
            dart = mix(g + C1)
            darts.append((owner[live][hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64), at[hit], dart[hit]))
        slot, at, dart = (np.concatenate([d[i] for d in darts]) for i in range(3))
        first = np.full(n_docs * k, np.inf)
        np.minimum.at(first, slot, at)
        best = at == first[slot]
        flat = sig.reshape(-1)
        flat[slot[best]] = dart[best]
        empty = np.isinf(first.reshape(n_docs, k)).any(1)
        open_ &= empty
        until = np.where(open_, until * 2, until)
    return sig, total > 0


def weighted(texts: list[bytes], size: int, words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, and the text that each belongs to."""
    found, count = shingles(texts, size, words)
    ends = np.cumsum(count)
    elements, weights, doc = [], [], []
    for i, (e, c) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)):
        if c:
            u, n = np.unique(found[e - c : e], return_counts=True)
            elements.append(u)
            weights.append(n)
            doc.append(np.full(len(u), i))
    if not elements:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(elements), np.concatenate(weights), np.concatenate(doc)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * C1, (len(sig), bands)).copy()
    parts = sig.reshape(len(sig), bands, rows)
    for j in range(rows):
        out = mix(out * C2 + parts[:, :, j])
    return out


def sign(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """key, doc_id, bands and a short signature (16 bits a coordinate) for rows key, doc_id, text."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = WordHashes()
        for piece in pieces(batches, "text", 2 << 20):
            texts = utf8(piece.column("text"))
            elements, weights, doc = weighted(texts, size, words)
            sig, full = signatures(elements, weights, doc, len(texts), bands * rows)
            keys = band_keys(sig, bands, rows).astype(np.int64)
            short = (sig >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("key"),
                    piece.column("doc_id"),
                    pa.array([k if f else [] for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() if f else b"" for s, f in zip(short, full, strict=True)], pa.binary()),
                ],
                names=["key", "doc_id", "bands", "sig"],
            )

    return map_arrow(texts, run, f"key binary, doc_id {kind}, bands array<bigint>, sig binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets: sorted distinct elements and their counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text, for a part of the nodes: other documents are mostly left out before the shuffle."""
    where = nodes.select("node", "key", F.col("first.doc_id").alias("d"))
    near = narrowed(docs, "key", where.select("key"))
    return near.join(where, (near["key"] == where["key"]) & near["doc_id"].eqNullSafe(where["d"])).select("node", "text")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs a < b of nodes whose texts are similar enough, by exact weighted Jaccard."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(nodes.join(wanted, "node"), docs)
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        words = WordHashes()
        last, left = None, None
        for piece in pieces(batches, "tb"):
            a_ids, b_ids = piece.column("a").to_pylist(), piece.column("b").to_pylist()
            keep = []
            for a, ta, tb in zip(a_ids, utf8(piece.column("ta")), utf8(piece.column("tb")), strict=True):
                if a != last:
                    last, left = a, weighted([ta], size, words)[:2]
                keep.append(similarity(left, weighted([tb], size, words)[:2]) >= threshold)
            k = np.array(keep, bool)
            if len(words) > CACHE_WORDS:
                words.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a_ids)[k], pa.int64()), pa.array(np.array(b_ids)[k], pa.int64())], names=["a", "b"])

    return map_arrow(both.select("a", "b", "ta", "tb"), run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and the least node of its component, for nodes with links: alternating large and small stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
        state = now
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")


def bags(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, and its text's distinct shingles with their counts as packed arrays."""
    texts = texts_of(nodes, docs)

    def run(batches):
        words = WordHashes()
        for piece in pieces(batches, "text"):
            found = [weighted([t], size, words)[:2] for t in utf8(piece.column("text"))]
            packed = [pa.array([x[i].astype("<i8").tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([piece.column("node"), *packed], names=["node", "elements", "weights"])

    return map_arrow(texts, run, "node bigint, elements binary, weights binary").dropDuplicates(["node"])


def mixed_links(buckets: DataFrame, nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int, threshold: float, least: float) -> DataFrame:
    """Links between different components that share a bucket: at least one for any two that have one there.

    Members of such buckets are compared in pairs of blocks. A pair is looked at in the first bucket that it shares, if
    it agrees in a share `least` of the signature; its similarity is computed exactly in place, until a member has a
    link to the other component. So what comes out is bounded by members times components, not by pairs.
    """
    members = buckets.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    parts = members.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("n")).where("main.n < n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    large = F.col("n") > BLOCK  # a bucket of one block is one group
    m, r = F.when(large, blocks(F.col("main.n"))).otherwise(0), F.when(large, blocks(F.col("n") - F.col("main.n"))).otherwise(1)
    mixed = mixed.select("bucket", F.col("main.class").alias("main"), m.alias("m"), r.alias("r"))
    rows = materialize(members.join(materialize(mixed, "mixed"), "bucket"), "members")
    # Blocks 0 to m - 1 hold the largest component, the r blocks behind them all others.
    h, inside = F.xxhash64("node"), (F.col("class") == F.col("main")) & (F.col("m") > 0)
    own = F.when(inside, F.pmod(h, F.greatest("m", F.lit(1)))).otherwise(F.col("m") + F.pmod(h, F.col("r"))).cast("int")
    others = F.sequence(F.when(inside, F.col("m")).otherwise(F.lit(0)), F.col("m") + F.col("r") - 1)
    spread = rows.withColumn("own", own).withColumn("other", F.explode(others))
    spread = spread.select("node", "class", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    asked = nodes.join(rows.select("node").distinct(), "node")
    content = asked.select("node", "bands", "sig").join(bags(asked, docs, size), "node")
    spread = spread.join(content, "node")

    def run(pdf):
        import pandas as pd

        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), -1)
        bands = np.stack(pdf["bands"].to_list()).astype(np.int64)
        node, cls, own = pdf["node"].to_numpy(), pdf["class"].to_numpy(), pdf["own"].to_numpy()
        here = np.flatnonzero((bands == pdf["bucket"].iloc[0]).all(0))[0]  # the band of this bucket
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        unpacked: dict = {}

        def bag(k):
            if k not in unpacked:
                unpacked[k] = tuple(np.frombuffer(pdf[c].iloc[k], kind) for c, kind in (("elements", "<u8"), ("weights", "<i8")))
            return unpacked[k]

        a, b = [], []
        for x in left.tolist():
            y = right[cls[right] != cls[x]]
            agree = (sig[y] == sig[x]).mean(1)
            near = (agree >= least) & ~(bands[y, :here] == bands[x, :here]).any(1)
            order = np.argsort(-agree[near], kind="stable")
            linked = set()
            for k in y[near][order].tolist():
                if cls[k] not in linked and similarity(bag(x), bag(k)) >= threshold:
                    linked.add(cls[k])
                    a.append(min(node[x], node[k]))
                    b.append(max(node[x], node[k]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return spread.groupBy("bucket", "i", "j").applyInPandas(run, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """A table of distinct texts: key (128-bit hash of the text), class_id (least id of the class), class_key and
    n_same (the key and the number of equal rows of the document that stands for the class), n_docs (of the class)."""
    source = docs.select(F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    signed = sign(source, shingle, bands, rows)
    # Copies meet pre-aggregated: one row per text and map task, whatever the number of copies.
    same = signed.groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    texts = same.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n_docs"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    every = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("a < z")
    # The sides with one row a bucket are tables of their own: the joins then have a shuffle on each side, and Spark can
    # split a bucket that many share.
    shared = materialize(shared.select("bucket", "n"), "shared")
    buckets = materialize(every.join(shared, "bucket"), "buckets")
    # A bucket's leader is its most central member: that with the most bucket mates in all its buckets.
    central = buckets.groupBy("node").agg(F.sum("n").alias("mates"))
    leaders = buckets.join(central, "node").groupBy("bucket").agg((-F.max(F.struct("mates", (-F.col("node")).alias("order")))["order"]).alias("leader"))
    leaders = materialize(leaders, "leaders")
    pairs = buckets.join(leaders, "bucket").where("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    links = materialize(confirmed(materialize(pairs.distinct(), "pairs"), nodes, source, shingle, threshold), "confirmed")
    classes = components(links)
    k = bands * rows
    least = threshold - SIGMAS * (threshold * (1 - threshold) / k) ** 0.5
    rest = materialize(mixed_links(buckets.select("bucket", "node"), nodes, classes, source, shingle, threshold, least), "more")
    if not rest.isEmpty():
        classes = components(materialize(rest.union(links).distinct(), "confirmed"))
    named = nodes.select("node", "key", "first", "n_docs").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    head = named.groupBy("class").agg(
        F.min(F.struct(F.col("first.doc_id").alias("doc_id"), F.col("key"), F.col("first.n").alias("n"))).alias("head"), F.sum("n_docs").alias("n")
    )
    return named.join(head, "class").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"), F.col("head.n").alias("n_same"), F.col("n").alias("n_docs"))


def dedup_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id, class_size and kept for every row; of rows equal in id and text all have the same `kept`."""
    table = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("key"))
    found = rows.where("key IS NOT NULL").join(table, "key")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    found = found.select("doc_id", "class_id", F.col("n_docs").alias("class_size"), kept.alias("kept"))
    alone = rows.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` with one document of each class: that with the least id; all their columns."""
    table = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    heads = materialize(table.where("key = class_key").select("key", F.col("class_id").alias("id"), "n_same"), "heads")
    text = F.col(f"`{text_col}`")
    rows = packed(docs, F.unhex(F.md5(text.cast("binary"))).alias("text_key"), F.col(f"`{id_col}`").alias("row_id"))

    def of(some: DataFrame) -> DataFrame:
        return rows.join(some, (F.col("text_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("id")), "left_semi")

    kept = of(heads.where("n_same = 1")).select("row")
    again = heads.where("n_same > 1")
    if not again.isEmpty():  # equal rows of one id and text: one of them stays, told before the shuffle
        kept = kept.union(of(again).groupBy("text_key", "row_id").agg(F.first("row").alias("row")).select("row"))
    return unpacked_rows(kept, docs.columns).unionByName(docs.where(text.isNull()))
