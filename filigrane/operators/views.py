"""Filters, sorts and pages over items. All are columns or plain DataFrame operations, so scans get the predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.functions.kinds import in_categories
from filigrane.functions.text import extension, parent_path, segments

MIB = 1 << 20
SMALL, LARGE = MIB, 100 * MIB


@dataclass(frozen=True)
class ItemFilter:
    """Category, size and date bind files only; the kind alone hides directories."""

    categories: frozenset = field(default_factory=frozenset)
    size: str = "any"  # any, small, medium, large
    date: str = "any"  # any, today, week, month, year
    kind: str = "all"  # all, files, folders

    def column(self, now: Column, name="name", is_dir="is_dir", size="size_bytes", modified="modified") -> Column:
        d = F.col(is_dir)
        ok = F.lit(True)
        if self.categories:
            ok = ok & in_categories(F.col(name), self.categories)
        if self.size != "any":
            ok = ok & size_in(F.col(size), self.size)
        if self.date != "any":
            ok = ok & date_in(F.col(modified), self.date, now)
        both = {"files": ~d & ok, "folders": d}.get(self.kind, d | ok)
        return F.coalesce(both, F.lit(False))


def size_in(size: Column, bucket: str) -> Column:
    bounds = {"small": size < SMALL, "medium": (size >= SMALL) & (size <= LARGE), "large": size > LARGE}
    return F.coalesce(bounds[bucket], F.lit(False))


def date_in(when: Column, span: str, now: Column) -> Column:
    today = F.date_trunc("day", now)
    start = {"today": today, "week": now - F.expr("INTERVAL 7 DAYS"), "month": now - F.expr("INTERVAL 30 DAYS"), "year": F.add_months(now, -12)}[span]
    if span == "year":
        start = now - F.expr("INTERVAL 1 YEAR")
    return F.coalesce(when >= start, F.lit(False))


@dataclass(frozen=True)
class CatalogFilter:
    """Bounds that go down to the scan: dates from (inclusive) to (exclusive), sizes in MB inclusive; a null fails an
    active bound; directories are not held against sizes, and against dates only if asked for."""

    files: bool = True
    folders: bool = True
    created_from: str | None = None
    created_before: str | None = None
    modified_from: str | None = None
    modified_before: str | None = None
    min_mb: float | None = None
    max_mb: float | None = None
    extensions: tuple[str, ...] = ()
    folder_names: tuple[str, ...] = ()
    date_directories: bool = False

    def column(self, separator: str = "/", name="name", path="full_path", is_dir="is_dir", size="size_bytes", created="created", modified="modified") -> Column:
        d = F.col(is_dir)
        ok = (d & F.lit(self.folders)) | (~d & F.lit(self.files))
        dates = F.lit(True)
        for c, low, high in ((created, self.created_from, self.created_before), (modified, self.modified_from, self.modified_before)):
            # A bound that is no time does not bind; it is tried once, as a constant.
            if low:
                dates = dates & (F.lit(low).try_cast("timestamp").isNull() | (F.col(c) >= F.lit(low).try_cast("timestamp")))
            if high:
                dates = dates & (F.lit(high).try_cast("timestamp").isNull() | (F.col(c) < F.lit(high).try_cast("timestamp")))
        ok = ok & (dates if self.date_directories else d | dates)
        mb = F.col(size) / F.lit(1048576.0)
        if self.min_mb is not None:
            ok = ok & (d | (mb >= self.min_mb))
        if self.max_mb is not None:
            ok = ok & (d | (mb <= self.max_mb))
        if self.extensions:
            ok = ok & F.lower(extension(F.col(name))).isin([e.lower() for e in self.extensions])
        if self.folder_names:
            ok = ok & has_segment(F.col(path), self.folder_names, separator)
        return F.coalesce(ok, F.lit(False))


def has_segment(path: Column, names, separator: str = "/") -> Column:
    """Any part of the path is one of the names, without regard to case."""
    return F.arrays_overlap(F.transform(segments(path, separator), F.lower), F.array(*[F.lit(n.lower()) for n in names]))


@dataclass(frozen=True)
class ItemSort:
    """What is missing comes last in both directions; ties go by score, name and path, always ascending."""

    field: str = "relevance"  # relevance, name, size, modified, kind
    descending: bool | None = None

    def keys(self, name="name", path="full_path", is_dir="is_dir", size="size_bytes", modified="modified", score="score") -> list[Column]:
        down = self.descending if self.descending is not None else self.field not in ("name", "kind")
        ties = [F.col(score).desc(), F.lower(F.col(name)), F.lower(F.col(path)), F.col(path)]
        own = {
            "relevance": None,
            "name": F.lower(F.col(name)),
            "size": F.when(~F.col(is_dir), F.col(size)),
            "modified": F.col(modified),
            "kind": F.when(F.col(is_dir), F.lit("")).otherwise(F.lower(extension(F.col(name)))),
        }[self.field]
        if own is None:
            return ties
        return [own.desc_nulls_last() if down else own.asc_nulls_last(), *ties]


def top(items: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows in order; a limit of none or less gives no row. Filters belong before this."""
    ordered = items.orderBy(*keys)
    return (ordered.offset(offset) if offset else ordered).limit(max(0, limit))


def page_with_total(items: DataFrame, keys: list[Column], limit: int, offset: int) -> DataFrame:
    """A page, each row with the number of all rows: counted by itself, so the page stays a top-k."""
    total = items.agg(F.count("*").alias("total"))
    return top(items, keys, limit, offset).crossJoin(F.broadcast(total))  # one row


def as_results(items: DataFrame) -> DataFrame:
    """Rows as a result list shows them: a directory has neither size nor time."""
    return items.select("name", "full_path", "is_dir", F.when(~F.col("is_dir"), F.col("size_bytes")).alias("size_bytes"), F.when(~F.col("is_dir"), F.col("modified")).alias("modified"), "score")


def as_items(rows: DataFrame, root: str, separator: str = "/") -> DataFrame:
    """Rows as catalogue items: a directory has no size but keeps its times; nothing was opened yet; the root has no
    parent path."""
    return rows.select(
        "name", "full_path", "is_dir", F.when(~F.col("is_dir"), F.col("size_bytes")).alias("size_bytes"), "created", "modified",
        F.lit(0).alias("open_count"), F.when(F.col("full_path") == root, F.lit("")).otherwise(parent_path(F.col("full_path"), separator)).alias("parent_path"),
    )


def by_distinct_name(items: DataFrame, test, name_col: str = "name") -> DataFrame:
    """Items whose name passes a test that is costly: it runs once for each distinct name."""
    names = items.select(name_col).distinct()
    return items.join(names.where(test(F.col(name_col))), name_col, "left_semi")


# Attribute bits.
HIDDEN, SYSTEM, REPARSE = 0x2, 0x4, 0x400


def listing(children: DataFrame, limit: int) -> DataFrame:
    """What is in a folder: directories, then files, each by name; hidden ones are left out, and system directories.
    `truncated` tells whether the limit was reached."""
    bits = F.col("attributes")
    shown = (bits.bitwiseAND(F.lit(HIDDEN)) == 0) & ~(F.col("is_dir") & (bits.bitwiseAND(F.lit(SYSTEM)) != 0))
    page = children.where(shown).orderBy(F.col("is_dir").desc(), F.lower("name"), "name").limit(max(0, limit))
    return page.crossJoin(F.broadcast(page.agg((F.count("*") >= limit).alias("truncated"))))  # one row


def walk_snapshot(walked: DataFrame, root: str, path_col: str = "full_path") -> tuple[DataFrame, DataFrame]:
    """What a walk may catalogue, and its scopes (path, kind): protected and unreadable folders are not gone, excluded
    ones are. Hidden and system entries are left out but for the root. walked: with attributes and `state` (ok, denied,
    failed, excluded)."""
    bits = F.col("attributes")
    shown = (bits.bitwiseAND(F.lit(HIDDEN | SYSTEM)) == 0) | (F.col(path_col) == root)
    kinds = F.when(F.col("state") == "denied", "protected").when(F.col("state") == "failed", "unreadable").when(F.col("state") == "excluded", "excluded").when(~shown, "excluded")
    scopes = walked.select(F.col(path_col).alias("path"), kinds.alias("kind")).where("kind IS NOT NULL")
    return walked.where(shown & F.col("state").isin("ok", "denied", "failed")), scopes


def filtered_page(page: DataFrame, item_filter: ItemFilter, now: Column, sort: ItemSort) -> DataFrame:
    """A folder's page, capped already, through a filter: directories first, then by the sort."""
    return page.where(item_filter.column(now)).withColumn("score", F.lit(0.0)).orderBy(F.col("is_dir").desc(), *sort.keys())


def folder_view(items: DataFrame, sort: ItemSort, limit: int) -> DataFrame:
    """A listing: directories first, then the sort with no score."""
    scored = items.withColumn("score", F.lit(0.0))
    return top(scored, [F.col("is_dir").desc(), *sort.keys()], limit)


def auto_open(results: DataFrame) -> DataFrame:
    """The first result if it scores 100 or more and leads by 40 and by a quarter of the second's score."""
    two = results.orderBy(F.col("score").desc(), F.lower("name"), F.lower("full_path"), "full_path").limit(2)
    pair = two.agg(F.max("score").alias("best"), F.max_by("full_path", "score").alias("full_path"), F.min("score").alias("other"), F.count("*").alias("n"))
    lead = (F.col("n") == 1) | (F.col("best") - F.col("other") >= F.greatest(F.lit(40.0), 0.25 * F.abs("other")))
    return pair.where((F.col("best") >= 100) & lead).select("full_path", F.col("best").alias("score"))
