"""Profiles of a catalogue: distributions, histograms, token fan-out and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions.shared import materialize
from filigrane.operators.views import HIDDEN, REPARSE, SYSTEM

# Upper bounds of the buckets, doubling; the last bucket is open.
COUNT_BUCKETS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
FANOUT_BUCKETS = COUNT_BUCKETS[1:]
LENGTH_BUCKETS = (0, 4, 8, 16, 32, 64, 128, 255)
DEPTH_BUCKETS = (0, 1, 2, 3, 4, 8, 16, 32)


def bucket(value: Column, bounds) -> Column:
    """Index of the first bucket whose upper bound holds the value."""
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(value <= b, i).otherwise(out)
    return out


def nearest_ranks(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles per group, without putting a group's values into one task: values are counted, ranges of
    them are summed, and each rank is looked for in the range that holds it."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranged = counts.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    parts = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__size").over(before), F.lit(0)), "n": F.sum("__size").over(whole)})
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.greatest(F.lit(1), F.ceil(F.col("n") * q)).alias("r")) for k, q in shares.items()])).alias("rank")
    asked = parts.select(*by, "__part", "__before", "__size", ranks).where((F.col("rank.r") > F.col("__before")) & (F.col("rank.r") <= F.col("__before") + F.col("__size")))
    inside = Window.partitionBy(*by, "__part").orderBy("__v")
    running = ranged.withColumn("__to", F.sum("__n").over(inside))
    hit = running.join(asked, [*by, "__part"]).where((F.col("__before") + F.col("__to") >= F.col("rank.r")) & (F.col("__before") + F.col("__to") - F.col("__n") < F.col("rank.r")))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("rank.k") == k, F.col("__v"))).alias(k) for k in shares])


def summarize(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, nearest-rank percentiles and the largest value; zeros if there is none."""
    by = by or []
    shares = {f"p{q}": q / 100 for q in (50, 90, 95, 99)}
    all_ = df.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.max(value), F.lit(0)).cast("long").alias("largest"))
    ranks = nearest_ranks(df, value, shares, by)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]
    both = all_.alias("a").join(ranks.alias("r") if by else F.broadcast(ranks).alias("r"), on, "left")
    return both.select(*[F.col(f"a.{c}").alias(c) for c in by], "n", *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in shares], "largest")


def histogram(df: DataFrame, value: str, bounds) -> DataFrame:
    return df.groupBy(bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def log2_histogram(df: DataFrame, value: str) -> DataFrame:
    """By powers of two; 0 has a bucket of its own, -1."""
    b = F.when(F.col(value) <= 0, -1).otherwise(F.floor(F.log2(F.col(value).cast("double"))).cast("int"))
    return df.where(F.col(value).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def token_fanout(posted: DataFrame) -> DataFrame:
    """Tokens and postings by how many items a token has."""
    df = posted.groupBy("token").agg(F.count("*").alias("df"))
    return df.groupBy(bucket(F.col("df"), FANOUT_BUCKETS).alias("bucket")).agg(F.count("*").alias("tokens"), F.sum("df").alias("edges"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def token_ratios(occurrences: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Shares of tokens with one item, of repeated (item, token) edges and of edges of shared tokens."""
    edges = occurrences.groupBy("token", id_col).agg(F.count("*").alias("times"))
    tokens = edges.groupBy("token").agg(F.count("*").alias("df"), F.sum("times").alias("times"))
    s = tokens.agg(F.count("*").alias("tokens"), F.sum("df").alias("edges"), F.sum("times").alias("times"), F.count_if(F.col("df") == 1).alias("single"), F.sum(F.when(F.col("df") > 1, F.col("df")).otherwise(0)).alias("shared"))
    return s.select("tokens", "edges", ratio(F.col("single"), F.col("tokens")).alias("singleton_ratio"), ratio(F.col("times") - F.col("edges"), F.col("times")).alias("duplicate_ratio"), ratio(F.col("shared"), F.col("edges")).alias("shared_ratio"))


def extension_profile(files: DataFrame, ext: str, least: int = 50, share: int = 1000) -> DataFrame:
    """Extensions that are common enough to be named; the rest is `other`, files without one are `none`."""
    counts = files.groupBy(F.col(ext).alias("extension")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    named = counts.crossJoin(F.broadcast(total))  # one row
    public = (F.col("n") >= least) & (F.col("n") * share >= F.col("total"))
    label = F.when(F.coalesce(F.col("extension"), F.lit("")) == "", "none").when(public, F.col("extension")).otherwise("other")
    return named.groupBy(label.alias("extension")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "extension")


def case_only_pairs(items: DataFrame, parent: str, name: str) -> DataFrame:
    """Pairs of names in one folder that differ in case only."""
    k = items.groupBy(parent, F.lower(name).alias("key")).agg(F.countDistinct(name).alias("k"))
    return k.groupBy(parent).agg(F.sum(F.expr("k * (k - 1) div 2")).alias("pairs")).where("pairs > 0")


def children_kinds(folders: DataFrame, rows: DataFrame, key: str, parent_key: str, dir_col: str = "is_dir") -> DataFrame:
    """Files, directories and all children of each folder, zeros included."""
    n = rows.groupBy(F.col(parent_key).alias(key)).agg(F.count_if(~F.col(dir_col)).alias("files"), F.count_if(dir_col).alias("dirs"))
    out = folders.select(key).join(n, key, "left").fillna(0, ["files", "dirs"])
    return out.withColumn("total", F.col("files") + F.col("dirs"))


def catalog_counts(items: DataFrame, name_col: str = "name", dir_col: str = "is_dir", root=None, id_col: str = "id") -> DataFrame:
    """Files, directories (but for the root), distinct names and all items."""
    inner = F.col(id_col) != F.lit(root) if root is not None else F.lit(True)
    return items.agg(F.count_if(~F.col(dir_col)).alias("files"), F.count_if(F.col(dir_col) & inner).alias("directories"), F.countDistinct(name_col).alias("names"), F.count_if(inner).alias("items"))


def scan_roots(items: DataFrame, roots: list[str], separator: str = "/", path: str = "full_path") -> tuple[DataFrame, DataFrame]:
    """Items below any of the roots, each once, and per root its items and those that an earlier root has already."""
    first = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(roots))):
        first = F.when((F.col(path) == r) | F.startswith(path, F.lit(r + separator)), i).otherwise(first)
    own = items.withColumn("__root", first).where("__root IS NOT NULL")
    own = own.dropDuplicates([path])
    inside = F.explode(F.array_compact(F.array(*[F.when((F.col(path) == r) | F.startswith(path, F.lit(r + separator)), i) for i, r in enumerate(roots)])))
    per = own.select("__root", inside.alias("i")).groupBy("i").agg(F.count("*").alias("items"), F.count_if(F.col("__root") != F.col("i")).alias("overlap"))
    names = F.array(*[F.lit(r) for r in roots])
    return own.drop("__root"), per.select(F.element_at(names, F.col("i") + 1).alias("root"), "items", "overlap")


def children_per_parent(parents: DataFrame, rows: DataFrame, key: str, parent_key: str) -> DataFrame:
    n = rows.groupBy(F.col(parent_key).alias(key)).agg(F.count("*").alias("n"))
    return parents.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def name_indicators(items: DataFrame, stem: str) -> DataFrame:
    """Over stems with a letter: how many hold Turkish letters, dotted or dotless i, are in capitals throughout, fold
    differently in Turkish, or are ASCII."""
    n = F.col(stem)
    letters = F.regexp_replace(n, r"[^\p{L}]", "")
    has = lambda pattern: F.count_if(F.rlike(n, F.lit(pattern)))
    return items.where(letters != "").agg(
        F.count("*").alias("lettered"),
        has("[çğıöşüÇĞİÖŞÜ]").alias("turkish"),
        has("[ıİ]").alias("special_i"),
        F.count_if(~F.rlike(letters, F.lit(r"[^\p{Lu}]"))).alias("all_upper"),
        has("[Iİ]").alias("folds_differently"),
        F.count_if(~F.rlike(n, F.lit(r"[^\x00-\x7F]"))).alias("ascii"),
    )


def special_counts(items: DataFrame, path: str, long_path: int = 260, name: str | None = None, attributes: str | None = None) -> DataFrame:
    """Long paths, names with white space and with %; with attributes also links elsewhere, hidden and system items."""
    p, n = F.col(path), F.col(name or path)
    aggs = [F.count_if(F.length(p) > long_path).alias("long_paths"), F.count_if(F.rlike(n, F.lit(r"\s"))).alias("with_space"), F.count_if(F.contains(n, F.lit("%"))).alias("with_percent")]
    if attributes:
        aggs += [F.count_if(F.col(attributes).bitwiseAND(F.lit(bit)) != 0).alias(k) for k, bit in (("links", REPARSE), ("hidden", HIDDEN), ("system", SYSTEM))]
    return items.agg(*aggs)


def fingerprint(metrics: DataFrame, keep: str | None = None) -> DataFrame:
    """SHA-256 of each row as canonical JSON, columns in name order; `keep` is a column beside it."""
    own = sorted(c for c in metrics.columns if c != keep)
    return metrics.select(*([keep] if keep else []), F.sha2(F.to_json(F.struct(*own)), 256).alias("fingerprint"))


def dense_rank(items: DataFrame, name: str, rank: str = "rank") -> DataFrame:
    """The rank of each row's name among the distinct names: these are numbered in ranges, with the sizes of the ranges
    before, and rows meet them in a join, so no task sees all names."""
    names = items.select(name).distinct().repartitionByRange(name).withColumn("__part", F.spark_partition_id())
    names = materialize(names.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(name))), "names")
    sizes = names.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    ranks = names.join(F.broadcast(before), "__part").select(name, (F.col("__own") + F.col("__before")).cast("long").alias(rank))
    return items.join(ranks, name)
