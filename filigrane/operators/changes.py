"""Keeping a catalogue current: merges, reconciliation, cascades and the folding of change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigrane.operators import links

STRUCTURAL = ("created", "deleted", "renamed")


def upsert(base: DataFrame, delta: DataFrame, key: str, preserve: tuple[str, ...] = ()) -> DataFrame:
    """New rows and new values for old rows; columns in `preserve` keep an old row's value."""
    new = delta.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in base.columns if c != key], F.lit(True).alias("__new"))
    out = base.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    return out.select(
        key,
        *[
            (F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")) if c in preserve else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))).alias(c)
            for c in base.columns
            if c != key
        ],
    )


def reconcile(cached: DataFrame, disk: DataFrame, key: str, compare: tuple[str, ...], kind: str | None = None) -> DataFrame:
    """key and action: insert, delete, replace (the kind changed), update (a compared value did) or keep."""
    a = cached.select(key, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in {*compare, *([kind] if kind else [])}])
    b = disk.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in {*compare, *([kind] if kind else [])}])
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    action = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete")
    if kind:
        action = action.when(~F.col(f"a_{kind}").eqNullSafe(F.col(f"b_{kind}")), "replace")
    return a.join(b, key, "full_outer").select(key, action.when(changed, "update").otherwise("keep").alias("action"))


def cascade_delete(tree: DataFrame, deleted: DataFrame, id_col: str = "id") -> DataFrame:
    """The tree without the deleted rows and all that lies below them; `tree` has `ancestors`."""
    gone = deleted.select(F.col(id_col).alias("__gone")).distinct()
    below = tree.select(id_col, F.explode(F.concat("ancestors", F.array(id_col))).alias("__gone")).join(gone, "__gone").select(id_col).distinct()
    return tree.join(below, id_col, "left_anti")


def deleted_subtree(tree: DataFrame, paths: DataFrame, separator: str = "/") -> DataFrame:
    """Rows at the paths or below them by their own path, so orphans that no walk reaches are found too."""
    from filigrane.operators.live import same_or_below

    gone = paths.select(F.col("path").alias("__g")).distinct()
    below = tree.select("path", F.explode(same_or_below(F.col("path"), separator)).alias("__g")).join(gone, "__g").select("path").distinct()
    return tree.join(below, "path", "left_semi")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents, rows[key] == parents[parent_key], "left_anti")


def outermost(roots: DataFrame, path_col: str = "path", separator: str = "/") -> DataFrame:
    """Distinct roots that lie below no other root: each root's ancestors are looked up, so the join is an equality."""
    own = roots.select(F.col(path_col).alias("path")).distinct()
    parts = F.split("path", "\\Q" + separator + "\\E")
    above = own.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))).alias("up")).where(F.size(parts) > 1)
    nested = above.join(own.select(F.col("path").alias("up")), "up").select("path").distinct()
    return own.join(nested, "path", "left_anti")


def pair_links(missing: DataFrame, extra: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The i-th missing link of a record and its i-th extra link are one rename."""
    w = Window.partitionBy(key).orderBy(*order)
    a = missing.withColumn("__i", F.row_number().over(w))
    b = extra.withColumn("__i", F.row_number().over(w))
    names = [c for c in missing.columns if c != key]
    return a.select(key, "__i", *[F.col(c).alias(f"old_{c}") for c in names]).join(b.select(key, "__i", *[F.col(c).alias(f"new_{c}") for c in names]), [key, "__i"], "full_outer").drop("__i")


def coalesce_events(events: DataFrame, key: str, order: list[str], kind_col: str = "kind") -> DataFrame:
    """Modified events of a key between structural ones merge into the first, with the last one's values and a count."""
    structural = F.col(kind_col).isin(*STRUCTURAL)
    w = Window.partitionBy(key).orderBy(*order)
    segment = F.sum(structural.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumns({"segment": segment, "structural": structural})
    first = Window.partitionBy(key, "segment", "structural").orderBy(*order)
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = {f"last_{c}": F.last(c).over(whole) for c in events.columns if c not in (key, kind_col)}
    return rows.withColumns(last | {"merged": F.count("*").over(whole), "__i": F.row_number().over(first)}).where(F.col("structural") | (F.col("__i") == 1)).drop("__i")


def debounce(events: DataFrame, key: str, order: list[str], kind_col: str = "kind") -> DataFrame:
    """Within a batch: a later modification replaces an earlier one; a path with a structural event has no modification."""
    structural = F.col(kind_col).isin(*STRUCTURAL)
    all_ = Window.partitionBy(key)
    later = Window.partitionBy(key, kind_col).orderBy(*[F.col(c).desc() for c in order])
    rows = events.withColumns({"__any": F.max(structural.cast("int")).over(all_), "__i": F.row_number().over(later)})
    return rows.where(structural | ((F.col("__any") == 0) & (F.col("__i") == 1))).drop("__any", "__i")


def fold_state(records: DataFrame, keys: list[str], order: list[str], kind_col: str = "kind") -> DataFrame:
    """One event per file and batch from its records: deleted wins, then renamed, created, modified."""
    flag = lambda k: F.max((F.col(kind_col) == k).cast("int"))
    at = F.struct(*order)
    out = records.groupBy(*keys).agg(flag("created").alias("c"), flag("deleted").alias("d"), flag("renamed").alias("r"), F.count("*").alias("records"), F.max(at).alias("last"))
    kind = F.when(F.col("d") == 1, "deleted").when(F.col("r") == 1, "renamed").when(F.col("c") == 1, "created").otherwise("modified")
    return out.select(*keys, kind.alias("kind"), "records", *[F.col(f"last.{c}").alias(f"last_{c}") for c in order])


def emit_kind(old: Column, new: Column, deleted: Column, created: Column, modified: Column) -> Column:
    """The events of a file, from its paths before a rename and after it (null: none, or not in view)."""
    one = lambda k, p, q=None: F.struct(F.lit(k).alias("kind"), p.alias("path"), (q if q is not None else F.lit(None).cast("string")).alias("old_path"))
    renamed = F.coalesce(F.lower(old) != F.lower(new), F.lit(False))
    none = F.array().cast("array<struct<kind:string,path:string,old_path:string>>")
    first = F.when(renamed, F.array(one("renamed", new, old))).otherwise(none)
    then = (
        F.when(deleted, F.array(one("deleted", F.coalesce(new, old))))
        .when(renamed, none)
        .when(new.isNull() & old.isNotNull(), F.array(one("deleted", old)))
        .when(new.isNotNull() & created, F.array(one("created", new)))
        .when(new.isNotNull() & modified, F.array(one("modified", new)))
        .otherwise(none)
    )
    return F.concat(first, then)


def withheld_events(events: DataFrame, visible: DataFrame, separator: str = "/") -> DataFrame:
    """Events as a reader may see them: kind, path and old_path (null: nothing to see), `withheld`, whether an end is not
    visible, and `scopes`, the nearest visible folders above what is not. visible: the paths that may be listed."""
    seen = visible.select(F.col("path").alias("__v")).distinct()
    parts = lambda c: F.split(c, "\\Q" + separator + "\\E")
    above = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts(c)) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts(c), F.lit(1), i), separator))
    ends = events.select(F.explode(F.array("path", "old_path")).alias("__p")).where("__p IS NOT NULL").distinct()
    nearest = ends.select("__p", F.explode(above(F.col("__p"))).alias("__v")).join(seen, "__v").groupBy("__p").agg(F.max_by("__v", F.length("__v")).alias("__s"))
    known = ends.join(seen, F.col("__p") == F.col("__v"), "left").join(nearest, "__p", "left")
    out = events
    for c, name in (("path", "__new"), ("old_path", "__old")):
        own = known.select(F.col("__p").alias(f"{name}_p"), F.col("__v").alias(f"{name}_v"), F.col("__s").alias(f"{name}_scope"))
        out = out.join(own, F.col(c) == F.col(f"{name}_p"), "left")
    new, old = F.col("__new_v").isNotNull(), F.col("__old_v").isNotNull()
    kind = split_rename(F.col("kind"), F.col("old_path"), F.col("path"), old, new)
    path = F.when(kind == "deleted", F.when((F.col("kind") == "renamed") & ~new, F.col("old_path")).otherwise(F.col("path"))).otherwise(F.col("path"))
    hid = ~new | ((F.col("kind") == "renamed") & ~old)
    scopes = F.array_compact(F.array(F.when(~new, F.col("__new_scope")), F.when((F.col("kind") == "renamed") & ~old, F.col("__old_scope"))))
    return out.select(
        *[c for c in events.columns if c not in ("kind", "path", "old_path")],
        kind.alias("kind"), F.when(kind.isNotNull(), path).alias("path"), F.when(kind == "renamed", F.col("old_path")).alias("old_path"), hid.alias("withheld"), F.array_distinct(scopes).alias("scopes"),
    )


def split_rename(kind: Column, old: Column, new: Column, old_seen: Column, new_seen: Column) -> Column:
    """A rename with one end out of view is a deletion or a creation; with none in view it is nothing (null)."""
    return F.when(kind != "renamed", F.when(new_seen, kind)).when(old_seen & new_seen, kind).when(old_seen, F.lit("deleted")).when(new_seen, F.lit("created"))


def pages_by_size(entries: DataFrame, group: str, order: list[str], size_col: str, budget: int) -> DataFrame:
    """A page number for each entry. A page takes entries as long as they fit the budget, the first one in any case, and
    the next page starts with the entry that did not fit. That is a fold over a group in order: groups are spread over
    tasks, and each streams its sorted rows with one running size as its state."""
    names = entries.columns
    schema = T.StructType([*entries.schema, T.StructField("page", T.LongType())])

    def fold(frames):
        last, page, held = object(), 0, 0
        for pdf in frames:
            pages = []
            for key, size in zip(pdf[group].tolist(), pdf[size_col].tolist(), strict=True):
                if key != last:
                    last, page, held = key, 0, size
                elif held + size > budget:
                    page, held = page + 1, size
                else:
                    held += size
                pages.append(page)
            yield pdf.assign(page=pages)

    return entries.repartition(group).sortWithinPartitions(group, *order).select(*names).mapInPandas(fold, schema)


def project_pages(entries: DataFrame, subscriptions: DataFrame, budget: int, overhead: int = 64) -> DataFrame:
    """Events of current deliveries with the page that carries them and `resume`, where the page stopped.

    entries: sequence, delivery, event (positions), root, generation, gap, fault, kind, path, old_path, withheld. A
    delivery is current if its generation is that of its root's subscription. A root's gaps and faults of a page collapse
    into one flag each. An event costs its paths and `overhead`; a page takes what fits, one event in any case.
    """
    wanted = subscriptions.select("root", F.col("generation").alias("__g"))
    own = entries.join(wanted, "root").where("generation = __g").drop("__g")
    cost = F.octet_length("path") + F.coalesce(F.octet_length("old_path"), F.lit(0)) + overhead
    own = own.withColumns({"bytes": F.coalesce(cost, F.lit(overhead)).cast("long"), "feed": F.lit(0)})
    paged = pages_by_size(own, "feed", ["sequence", "delivery", "event"], "bytes", budget)
    root = Window.partitionBy("page", "root")
    at = F.min(F.struct("sequence", "delivery", "event")).over(Window.partitionBy("page"))
    return paged.withColumns({"has_gap": F.max(F.coalesce(F.col("gap"), F.lit(False))).over(root), "has_fault": F.max(F.coalesce(F.col("fault"), F.lit(False))).over(root), "resume": at}).drop("feed", "bytes")


def current_deliveries(deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries of the generation that their root is subscribed with."""
    return deliveries.join(subscriptions.select("root", "generation"), ["root", "generation"], "left_semi")


def apply_changes(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """A batch of upserts and deletions without previous names; see `links.apply_batch`. Root is the entry that is its own
    parent."""
    root = entries.where("file_ref = parent_ref").select("file_ref").head()
    fill = {c: F.lit(0).cast("long") for c in links.META if c not in entries.columns}
    whole = changes.withColumns({c: F.lit(0).cast("long") for c in links.META if c not in changes.columns})
    whole = whole.withColumns({"previous_parent": F.lit(None).cast("long"), "previous_name": F.lit(None).cast("string")})
    final, _ = links.apply_batch(entries.withColumns(fill), whole, root[0] if root else 5)
    return final.select(*entries.columns)
