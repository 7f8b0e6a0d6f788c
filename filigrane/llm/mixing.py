"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order, null last, weigh `weights`, repeating. They share the budget (by default all words there
are) by weight; a target stops at `max_repeats` times its source's size and the excess is shared by weight among the
rest until no target is above. A source whose target is q whole passes and a remainder is taken q times whole; for the
remainder its documents are counted by exact length, each length gives its even share, and a bounded-knapsack dynamic
program over what is left of each length fits the rest of the budget to the word, if any subset can. Which documents of
a length are taken follows from a seeded hash of their ids.

Only (source, length) counts and (source, length, hash bucket) counts meet, never texts. A length's documents are taken
by whole hash buckets and by rank within the last one, so that a source or length with a third of all rows is spread
over `BUCKETS` groups. Equal ids with different texts are in different buckets; rows equal in id and text are ranked as
one with their number, and the few of them that a last bucket needs are told by numbers in stretches of rows (`SALT`).
The dynamic program sees one source's counts, bounded by the number of its distinct lengths and by `dp_words`. It fits
what even shares leave over, less than one document of each length; where that is more than `dp_words` words, the longest
documents that fit are taken until it is not, so the sum is the nearest one that the rest can reach. Sources are
categories: the driver holds one row for each, and more than `MAX_SOURCES` raise ValueError.

Defined cases: null and empty texts have size 0 and are taken with 0 words; rows with equal ids are ranked by a hash of
their texts, identical rows are interchangeable; an empty table gives an empty result; a source of size 0 has target 0;
`mix` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.llm.common import materialize, packed, unpacked_rows

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 20240607
BUCKETS = 256
SALT = 16  # bits: rows numbered by one task
MAX_SOURCES = 100_000
CHUNK = 1 << 12
DP_WORDS = 1 << 20


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets_of(sizes: dict, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, budget: int | None = None) -> dict:
    """Each source's target as a fraction: shares by weight, with what exceeds `max_repeats` sizes shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode("utf-8") if s is not None else b""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    rest = Fraction(sum(sizes.values()) if budget is None else budget)
    open_, out = list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if rest * weight[s] > max_repeats * sizes[s] * total]
        if not above:
            out.update({s: rest * weight[s] / total for s in open_})
            break
        for s in above:
            out[s] = Fraction(max_repeats * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to `budget` as can be."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = budget - int((take * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # the longest that fit, until the program can take over
        if rest <= dp_words:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), (rest - dp_words) // int(lengths[i]))
            if more > 0:
                take[i] += more
                rest -= more * int(lengths[i])
    return take + knapsack(lengths, counts - take, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts split in powers of two, reachable sums as bits up to twice the budget, and for each sum
    the first item that reached it. The sum nearest to the budget is taken, the smaller of two as near."""
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    most = int(min(2 * budget, (lengths * counts).sum()))
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        left, step = int(min(counts[i], most // lengths[i] if lengths[i] > 0 else 0)), 1
        while left > 0:
            n = min(step, left)
            items.append((i, n))
            left, step = left - n, step * 2
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    first = np.full(most + 1, -1, np.int32)
    for k, (i, n) in enumerate(items):
        w = int(lengths[i]) * n
        if w > most:
            continue
        new = np.flatnonzero(reach[: most + 1 - w] & ~reach[w:]) + w
        if len(new):
            reach[new] = True
            first[new] = k
            if most >= budget and reach[budget]:
                break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= int(lengths[i]) * n
    return take


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    budget: int | None = None,
    seed: int = SEED,
    dp_words: int = DP_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: its id, size, source_size, target, times (how often it is taken) and taken (words), with `keep`."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("__source"),
        size_of(text).alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("__hash"),
        F.xxhash64(F.lit(seed), text).alias("__tie"),
        F.shiftright(F.monotonically_increasing_id(), SALT).alias("__salt"),
        *[F.col(f"`{c}`").alias(f"__keep_{c}") for c in keep],
    ).withColumn("__bucket", F.pmod(F.xxhash64("__hash", "__tie"), F.lit(BUCKETS)).cast("int"))
    # Texts are read and counted once: what follows works on ids, sizes and hashes.
    rows = materialize(rows, "mix")
    counted = rows.groupBy("__source", "size", "__bucket").agg(F.count("*").alias("n"))
    summed = counted.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(summed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source = {r[0]: int(r[1]) for r in summed}
    targets = targets_of(by_source, weights, max_repeats, budget)
    plan = [(s, by_source[s], float(t), int(t // by_source[s]) if by_source[s] else 0, int(t % by_source[s]) if by_source[s] else 0) for s, t in targets.items()]
    kinds = "__source string, source_size long, target double, __times long, __rest long"
    sources = docs.sparkSession.createDataFrame(plan, kinds)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        pdf["__more"] = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["__rest"].iloc[0]), dp_words)
        return pdf[["__source", "size", "__more"]]

    lengths = counted.groupBy("__source", "size").agg(F.sum("n").alias("n"))
    more = lengths.join(F.broadcast(sources), lengths["__source"].eqNullSafe(sources["__source"])).select(lengths["__source"], "size", "n", "__rest")
    more = more.groupBy("__source").applyInPandas(fitted, "__source string, size long, __more long")
    # Whole buckets before the last one, and in that one as many documents as are still missing.
    before = Window.partitionBy("__source", "size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    share = counted.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    share = share.join(more.withColumnsRenamed({"__source": "s2", "size": "z2"}), F.col("__source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2"))).select(
        F.col("__source").alias("s3"), F.col("size").alias("z3"), F.col("__bucket").alias("b3"), "n", (F.col("__more") - F.col("__before")).alias("__here")
    )
    match = F.col("__source").eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z3")) & (F.col("__bucket") == F.col("b3"))
    shared = rows.join(share, match, "left").drop("s3", "z3", "b3")
    whole = (F.col("__here") <= 0) | (F.col("__here") >= F.col("n"))
    last = F.coalesce(~whole, F.lit(False))
    extra = shared.where(~last).withColumn("__extra", F.coalesce(F.col("__here") > 0, F.lit(False)).cast("long"))
    ranked = extra.unionByName(ranked_last(shared.where(last)))
    named = sources.withColumnRenamed("__source", "s4")
    out = ranked.join(F.broadcast(named), F.col("__source").eqNullSafe(F.col("s4")), "left")
    times = F.col("__times") + F.col("__extra")
    return out.select(
        "doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep if c != "doc_id"]
    )


def ranked_last(rows: DataFrame) -> DataFrame:
    """`__extra` of the rows of buckets that are taken in part (`__here` of them): by hash, then by text and id. Equal rows
    are ranked together, and only where the border runs through them are they numbered, in stretches."""
    bucket, equal = ["__source", "size", "__bucket", "__here"], ["__hash", "__tie", "doc_id"]
    named = {c: f"g{c}" for c in (*bucket, *equal)}

    def on(other: dict):
        return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(g)) for c, g in other.items()])

    before = Window.partitionBy(*bucket).orderBy(*equal).rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(*bucket, *equal).agg(F.count("*").alias("__same"))
    groups = groups.withColumn("__take", F.least("__same", F.greatest(F.lit(0), F.col("__here") - F.coalesce(F.sum("__same").over(before), F.lit(0)))))
    rows = rows.join(groups.withColumnsRenamed(named), on(named)).drop(*named.values())
    cut = (F.col("__take") > 0) & (F.col("__take") < F.col("__same"))
    some = rows.where(cut)
    salted = {c: f"g{c}" for c in (*bucket, *equal, "__salt")}
    earlier = Window.partitionBy(*bucket, *equal).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    stretches = some.groupBy(*bucket, *equal, "__salt").agg(F.count("*").alias("__k"))
    stretches = stretches.withColumn("__k", F.coalesce(F.sum("__k").over(earlier), F.lit(0)))
    here = Window.partitionBy(*bucket, *equal, "__salt").orderBy(F.lit(1))
    some = some.withColumn("__number", F.row_number().over(here)).join(stretches.withColumnsRenamed(salted), on(salted)).drop(*salted.values())
    some = some.withColumn("__extra", (F.col("__number") + F.col("__k") <= F.col("__take")).cast("long")).drop("__number", "__k")
    rest = rows.where(~cut).withColumn("__extra", (F.col("__take") > 0).cast("long"))
    return rest.unionByName(some).drop("__same", "__take")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is taken; all their columns.

    A plan row finds its document by a hash of all columns; rows equal in all of them have one plan together: one stands
    for all, and is repeated first in chunks, then in each chunk, so that no task repeats it alone.
    """
    every = [F.to_json(F.col(f"`{f.name}`")) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in docs.columns])
    own = [F.col(f"`{c}`").alias(a) for c, a in ((id_col, "doc_id"), (source_col, "source"), (text_col, "text"))]
    rows = packed(docs, *own, F.xxhash64(nulls, *every).alias("k0"), F.xxhash64(F.lit(1), nulls, *every).alias("k1"))
    plan = mix_plan(rows, keep=("k0", "k1"), **options).groupBy("k0", "k1").agg(F.sum("times").alias("total"), F.count("*").alias("same"))
    plan = materialize(plan.where("total > 0"), "taken")
    rows = rows.select("row", "k0", "k1")
    taken = rows.join(plan.where("same = 1"), ["k0", "k1"]).select("row", F.explode(F.array_repeat(F.lit(0), F.col("total").cast("int"))).alias("again"))
    equal = plan.where("same > 1")
    if not equal.isEmpty():
        one = rows.join(equal, ["k0", "k1"]).groupBy("k0", "k1").agg(F.first("row").alias("row"), F.first("total").alias("total"))
        chunks = one.select("row", "k0", "total", F.explode(F.sequence(F.lit(0), F.expr(f"(total - 1) div {CHUNK}"))).alias("chunk")).repartition("k0", "chunk")
        size = F.least(F.lit(CHUNK), F.col("total") - F.col("chunk") * CHUNK).cast("int")
        taken = taken.union(chunks.select("row", F.explode(F.array_repeat(F.lit(0), size)).alias("again")))
    return unpacked_rows(taken, docs.columns)
