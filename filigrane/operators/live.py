"""Catalogues keyed by path: whole batches of events, reconciliation with a walk, keep-last, open counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "/"


def same_or_below(path: Column, separator: str = SEPARATOR) -> Column:
    """A path and all paths above it."""
    parts = F.split(path, "\\Q" + separator + "\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def keep_last(items: DataFrame, order: list[str], path: str = "full_path") -> DataFrame:
    """Of rows with one path in any case the last one; pre-aggregated, so a path may have any number of rows."""
    rest = [c for c in items.columns]
    return items.groupBy(F.lower(path).alias("__k")).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select("__r.*")


def count_opens(items: DataFrame, opened: DataFrame, path: str = "full_path") -> DataFrame:
    """The items with their open counts raised by the number of rows in `opened` for them."""
    n = opened.groupBy(F.col(path).alias("__p")).agg(F.count("*").alias("__n"))
    return items.join(n, F.col(path) == F.col("__p"), "left").withColumn("open_count", F.col("open_count") + F.coalesce("__n", F.lit(0))).drop("__p", "__n")


def removals(cached: DataFrame, walked: DataFrame, scopes: DataFrame, existing: DataFrame | None = None, separator: str = SEPARATOR) -> DataFrame:
    """Cached paths that are to go, and why, without what lies below another one that goes.

    type: the walk found the other kind; excluded: under an excluded scope; gone: not found by the walk, nor under a
    protected or unreadable scope, nor among `existing` paths. scopes: path and kind (excluded, protected, unreadable).
    """
    found = walked.select(F.col("full_path").alias("__w"), F.col("is_dir").alias("__d"))
    places = cached.select("full_path", F.explode(same_or_below(F.col("full_path"), separator)).alias("path"))
    under = places.join(scopes.select("path", "kind").distinct(), "path").groupBy("full_path").agg(F.max((F.col("kind") == "excluded").cast("int")).alias("__x"), F.max(F.col("kind").isin("protected", "unreadable").cast("int")).alias("__s"))
    rows = cached.join(found, F.col("full_path") == F.col("__w"), "left").join(under, "full_path", "left")
    if existing is not None:
        rows = rows.join(existing.select(F.col("full_path").alias("__e")).distinct(), F.col("full_path") == F.col("__e"), "left")
    else:
        rows = rows.withColumn("__e", F.lit(None).cast("string"))
    why = F.when(F.col("__w").isNotNull(), F.when(F.col("__d") != F.col("is_dir"), "type")).when(F.col("__x") == 1, "excluded").when((F.coalesce("__s", F.lit(0)) == 0) & F.col("__e").isNull(), "gone")
    marked = rows.select("full_path", "is_dir", why.alias("why")).where("why IS NOT NULL")
    return without_nested(marked, separator)


def without_nested(rows: DataFrame, separator: str = SEPARATOR, path: str = "full_path") -> DataFrame:
    """Rows whose path lies below no other row's."""
    above = rows.select(path, F.explode(same_or_below(F.col(path), separator)).alias("__a")).where(F.col("__a") != F.col(path))
    nested = above.join(rows.select(F.col(path).alias("__a")).distinct(), "__a").select(path).distinct()
    return rows.join(nested, path, "left_anti")


def drop_subtrees(items: DataFrame, gone: DataFrame, separator: str = SEPARATOR, path: str = "full_path") -> DataFrame:
    """Items but for those paths and all below them."""
    below = items.select(path, F.explode(same_or_below(F.col(path), separator)).alias("__g")).join(gone.select(F.col(path).alias("__g")).distinct(), "__g").select(path).distinct()
    return items.join(below, path, "left_anti")


def upsert_state(items: DataFrame, delta: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """Items after an upsert: a directory that becomes a file loses what was below it, unless the delta has it too."""
    was = items.where("is_dir").select("full_path")
    flipped = delta.where("NOT is_dir").join(was, "full_path", "left_semi").select("full_path")
    kept = drop_subtrees(items, flipped, separator).join(delta.select("full_path"), "full_path", "left_anti")
    return kept.unionByName(delta.select(*items.columns))


def reconcile_store(items: DataFrame, walked: DataFrame, scopes: DataFrame, separator: str = SEPARATOR) -> tuple[DataFrame, DataFrame]:
    """Items after a walk: removals with all below them, then upserts that keep open counts; and the rows to persist, with
    their action (delete, insert, update)."""
    gone = removals(items, walked, scopes, separator=separator).select("full_path")
    kept = drop_subtrees(items, gone, separator)
    old = kept.select(F.col("full_path").alias("__p"), F.col("open_count").alias("__o"), F.xxhash64("is_dir", "size_bytes", "modified").alias("__h"))
    new = walked.join(old, F.col("full_path") == F.col("__p"), "left").withColumn("open_count", F.coalesce("__o", F.lit(0)))
    action = F.when(F.col("__p").isNull(), "insert").when(F.col("__h") != F.xxhash64("is_dir", "size_bytes", "modified"), "update")
    final = kept.join(walked.select("full_path"), "full_path", "left_anti").unionByName(new.select(*items.columns))
    lost = items.join(kept.select("full_path"), "full_path", "left_anti").select("full_path", F.lit("delete").alias("action"))
    return final, lost.unionByName(new.select("full_path", action.alias("action")).where("action IS NOT NULL"))


def apply_events(items: DataFrame, events: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """Items after a batch of events (ordinal, kind, full_path, old_path, is_dir, size_bytes, modified).

    Renames move a row and all below it, the deepest renamed folder above a row counting, and keep open counts if the kind
    is the same; a deleted path takes along what was there before the deletion; created and modified paths are upserted
    and keep the open count of their path, unless the batch deletes them later. The last event of a path counts.
    """
    columns = items.columns
    moves = events.where("kind = 'renamed'").groupBy("old_path").agg(F.max_by(F.struct("full_path", "is_dir", "ordinal"), "ordinal").alias("m"))
    moves = moves.select(F.col("old_path").alias("__from"), F.col("m.full_path").alias("__to"), F.col("m.ordinal").alias("__at"), F.col("m.is_dir").alias("__dir"))
    places = items.select("full_path", F.explode(same_or_below(F.col("full_path"), separator)).alias("__from")).join(moves, "__from")
    best = places.groupBy("full_path").agg(F.max_by(F.struct("__from", "__to", "__dir", "__at"), F.length("__from")).alias("m"))
    moved = items.join(best, "full_path", "left")
    target = F.concat(F.col("m.__to"), F.substring("full_path", F.length("m.__from") + 1, F.lit(1 << 30)))
    keeps = F.col("m").isNull() | (F.col("m.__from") != F.col("full_path")) | (F.col("m.__dir") == F.col("is_dir"))
    moved = moved.withColumns({"__old": F.col("full_path"), "__since": F.coalesce(F.col("m.__at"), F.lit(-1)), "open_count": F.when(keeps, F.col("open_count")).otherwise(F.lit(0))})
    moved = moved.withColumn("full_path", F.when(F.col("m").isNotNull(), target).otherwise(F.col("full_path"))).drop("m", "__old")
    # Of rows that meet at one path the one that moved there last stays.
    moved = moved.groupBy("full_path").agg(F.max_by(F.struct("__since", *[c for c in columns if c != "full_path"]), "__since").alias("r")).select("full_path", "r.*")
    ends = events.where("kind = 'deleted'").groupBy(F.col("full_path").alias("__gone")).agg(F.max("ordinal").alias("__when"))
    below = moved.select("full_path", "__since", F.explode(same_or_below(F.col("full_path"), separator)).alias("__gone")).join(ends, "__gone")
    dead = below.where("__when > __since").select("full_path").distinct()
    left = moved.join(dead, "full_path", "left_anti").drop("__since").select(*columns)
    put = events.where("kind IN ('created', 'modified')").groupBy("full_path").agg(F.max_by(F.struct("is_dir", "size_bytes", "modified", "ordinal"), "ordinal").alias("p")).select("full_path", "p.*")
    later = put.select("full_path", "ordinal", F.explode(same_or_below(F.col("full_path"), separator)).alias("__gone")).join(ends, "__gone").where("__when > ordinal").select("full_path").distinct()
    put = put.join(later, "full_path", "left_anti").drop("ordinal").join(left.select("full_path", "open_count"), "full_path", "left").withColumn("open_count", F.coalesce("open_count", F.lit(0)))
    return upsert_state(left, put.select(*columns), separator)
