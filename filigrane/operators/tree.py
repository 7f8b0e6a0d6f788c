"""Trees of parent references: reachability, paths, ancestors, descendants, lookups and audits.

A walk is a frontier that joins one level at a time with all rows. Each level is written to shared storage once and read
from there by the next one and by the result, so no level is computed twice, whatever the depth, and Spark knows its size
when it chooses between a broadcast and a shuffle. Rows not connected to the root never enter a frontier, so cycles
cannot; a walk that is deeper than `max_depth` (several links of one directory into itself) raises ValueError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.functions.shared import materialize

MAX_DEPTH = 65_536
RESOLVE_DEPTH = 512
SYSTEM_RECORDS = 16
SEPARATOR = "/"


def reachable(entries: DataFrame, root, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "name", dir_col: str | None = "is_dir", max_depth: int = MAX_DEPTH, closed_col: str | None = None) -> DataFrame:
    """Rows connected to the root, through directories only, with depth, path, the ids above them (`ancestors`, root
    first) and `sort_path`, the names above and own in upper case, by which a pre-order walk sorts. Directories with
    `closed_col` (links elsewhere) are rows, but not entered."""
    opened = F.col(dir_col) if dir_col else F.lit(True)
    if closed_col:
        opened = opened & ~F.coalesce(F.col(closed_col), F.lit(False))
    own = entries.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent_id"), F.col(name_col).alias("name"), (F.col(dir_col) if dir_col else F.lit(True)).alias("is_dir"), opened.alias("__open"), F.upper(F.col(name_col)).alias("__key"))
    kind = own.schema["id"].dataType.simpleString()
    front = own.where(F.col("id") == F.lit(root)).select(
        "id", "parent_id", "name", "is_dir", F.lit(0).alias("depth"), F.col("name").alias("path"), F.array().cast(f"array<{kind}>").alias("ancestors"), F.array(F.col("__key")).alias("sort_path"), "__open"
    )
    rest = own.where(F.col("id") != F.lit(root))
    levels = []
    while True:
        front = materialize(front, "level")
        if levels and front.isEmpty():
            break
        levels.append(front)
        if len(levels) > max_depth + 1:
            raise ValueError(f"deeper than {max_depth}")
        above = front.where("__open").select(
            F.col("id").alias("__up"), F.col("depth").alias("__depth"), F.col("path").alias("__path"), F.concat("ancestors", F.array("id")).alias("__ancestors"), F.col("sort_path").alias("__sort")
        )
        front = rest.join(above, F.col("parent_id") == F.col("__up")).select(
            "id", "parent_id", "name", "is_dir", (F.col("__depth") + 1).alias("depth"), F.concat_ws(SEPARATOR, "__path", "name").alias("path"),
            F.col("__ancestors").alias("ancestors"), F.concat("__sort", F.array("__key")).alias("sort_path"), "__open",
        )
    return reduce(DataFrame.unionByName, levels).drop("__open")


def searchable(entries: DataFrame, tree: DataFrame, id_col: str = "id") -> DataFrame:
    """All entries with `path`: those whose parents have not come yet are found by name at once, and have none so far."""
    return entries.join(tree.select(F.col("id").alias(id_col), "path"), id_col, "left")


def walk_below(entries: DataFrame, start, id_col: str = "id", parent_col: str = "parent_id", surrogate_col: str = "surrogate", listed_col: str = "listed", volume_col: str = "volume") -> tuple[DataFrame, DataFrame]:
    """The directories below one, and one row with how many were skipped: links elsewhere and other volumes are neither
    taken nor entered, what cannot be listed is taken but not entered. Nothing is taken if the start cannot be entered."""
    home = entries.where(F.col(id_col) == F.lit(start)).select(F.col(volume_col).alias("__home"), F.col(surrogate_col).alias("__s"))
    rows = entries.crossJoin(F.broadcast(home))  # one row
    foreign = F.col(surrogate_col) | (F.col(volume_col) != F.col("__home"))
    own = rows.withColumns({"__foreign": foreign, "__closed": foreign | ~F.col(listed_col), "__dir": F.lit(True), "__name": F.lit("")})
    found = reachable(own, start, id_col, parent_col, "__name", "__dir", closed_col="__closed").select(F.col("id").alias(id_col))
    marked = own.join(found, id_col, "left_semi")
    taken = marked.where(~F.col("__foreign") & (F.col(id_col) != F.lit(start)) & ~F.col("__s"))
    skipped = marked.agg(F.count_if(F.col("__foreign") | ~F.col(listed_col)).alias("skipped"))
    return taken.select(*entries.columns), skipped


def without_system(entries: DataFrame, root, id_col: str = "id") -> DataFrame:
    """Entries but for those with the numbers that the file system keeps for itself; the root stays."""
    return entries.where((F.col(id_col).bitwiseAND(F.lit((1 << 48) - 1)) >= SYSTEM_RECORDS) | (F.col(id_col) == F.lit(root)))


def paths_of(entries: DataFrame, root, ids: DataFrame, max_depth: int = RESOLVE_DEPTH, **columns) -> DataFrame:
    """id, path and `resolved` of each asked id: false if it is unknown, not connected or deeper than `max_depth`."""
    tree = reachable(entries, root, **columns).where(F.col("depth") <= max_depth).select("id", "path")
    return ids.select("id").distinct().join(tree, "id", "left").withColumn("resolved", F.col("path").isNotNull())


def disconnected(entries: DataFrame, tree: DataFrame, id_col: str = "id") -> DataFrame:
    return entries.join(tree.select(F.col("id").alias(id_col)), id_col, "left_anti")


def children(tree: DataFrame, parent) -> DataFrame:
    return tree.where(F.col("parent_id") == F.lit(parent)).orderBy(F.lower("name"), "name", "id")


def descendants(tree: DataFrame, folders: list) -> DataFrame:
    """Rows below any of the folders, each once."""
    return tree.where(F.arrays_overlap("ancestors", F.array(*[F.lit(f) for f in folders])))


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): one row for each row and each directory above it."""
    return tree.select("id", "depth", F.posexplode("ancestors").alias("at", "ancestor")).select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


def pre_order(tree: DataFrame) -> DataFrame:
    """Depth first, by name without regard to case."""
    return tree.orderBy("sort_path", "id")


def breadth_first(tree: DataFrame) -> DataFrame:
    return tree.orderBy("depth", "sort_path", "id")


def all_items(tree: DataFrame, root) -> DataFrame:
    """Everything but the root, by name."""
    return tree.where(F.col("id") != F.lit(root)).orderBy(F.upper("name"), "name", "id")


def roots_of(entries: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Rows without a parent, or with one that is not there or is themselves."""
    known = entries.select(F.col(id_col).alias("__p")).distinct()
    own = entries.where(F.col(parent_col).isNull() | (F.col(parent_col) == F.col(id_col)))
    lost = entries.where(F.col(parent_col) != F.col(id_col)).join(known, F.col(parent_col) == F.col("__p"), "left_anti")
    return own.unionByName(lost)


def audit(entries: DataFrame, root, id_col: str = "id", parent_col: str = "parent_id", dir_col: str = "is_dir") -> DataFrame:
    """One row of counts: rows, directories, rows whose parent is missing, rows whose parent is a file, rows below no root
    though their parents are there (in a cycle or below one)."""
    rows = entries.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent_id"), F.lit("").alias("name"), F.col(dir_col).alias("is_dir"))
    parents = rows.select(F.col("id").alias("__p"), F.col("is_dir").alias("__d")).distinct()
    tree = reachable(rows, root).select("id").distinct().withColumn("__in", F.lit(True))
    every = rows.join(parents, F.col("parent_id") == F.col("__p"), "left").join(tree, "id", "left")
    inner = F.col("id") != F.lit(root)
    return every.agg(
        F.count("*").alias("rows"),
        F.count_if("is_dir").alias("directories"),
        F.count_if(inner & F.col("__p").isNull()).alias("missing_parent"),
        F.count_if(inner & (F.col("__d") == F.lit(False))).alias("parent_is_file"),
        F.count_if(F.col("__in").isNull() & F.col("__d")).alias("cut_off"),
    )


def subtree(tree: DataFrame, folder_path: str, separator: str = SEPARATOR) -> DataFrame:
    """All that is below a path, orphans too: rows that have it among their ancestors' paths, and rows without a place in
    the tree whose own path begins with it."""
    return tree.where(F.startswith("path", F.lit(folder_path + separator)))


def find_path(tree: DataFrame, paths: DataFrame, separator: str = SEPARATOR, path_col: str = "path") -> DataFrame:
    """`asked` and the id of the row there: segment by segment the name as it is, else the first one in another case.

    Rows and paths meet by the hash of the path in upper case; the best of a path's rows is that which agrees exactly in
    the most segments from the root on, so one exact match above counts before any below."""
    asked = paths.select(F.col(path_col).alias("asked")).distinct()
    plain = F.regexp_replace("asked", "\\Q" + separator + "\\E+$", "")
    asked = asked.withColumn("__plain", plain).withColumn("__h", F.xxhash64(F.upper("__plain")))
    rows = tree.select("id", F.col("path").alias("__path"), F.xxhash64(F.upper("path")).alias("__h"))
    met = asked.join(rows, "__h").where(F.upper("__plain") == F.upper("__path"))
    cut = "\\Q" + separator + "\\E"
    same = F.zip_with(F.split("__plain", cut), F.split("__path", cut), lambda a, b: a == b)
    best = F.min(F.struct(F.transform(same, lambda x: ~x).alias("off"), F.col("id"), F.col("__path").alias("path")))
    return met.groupBy("asked").agg(best.alias("b")).select("asked", "b.id", "b.path")


def scope_rows(tree: DataFrame, root, scopes: list[str], separator: str = SEPARATOR) -> DataFrame:
    """Rows under any of the scopes' paths, the scopes themselves included; no scope, or the root among them: all rows.
    A path that is not there holds nothing."""
    spark = tree.sparkSession
    if not scopes:
        return tree
    found = find_path(tree, spark.createDataFrame([(s,) for s in scopes], "path string"), separator)
    ids = [r["id"] for r in found.select("id").collect()]  # at most one for each literal scope
    if root in ids:
        return tree
    return tree.where(F.col("id").isin(ids) | F.arrays_overlap("ancestors", F.array(*[F.lit(i) for i in ids]))) if ids else tree.limit(0)


def nearest_root(tree: DataFrame, roots: DataFrame, id_col: str = "id") -> DataFrame:
    """Each row below a selected root with the nearest one: what lies in a root inside another goes to the inner one."""
    wanted = roots.select(F.col(id_col).alias("root")).distinct()
    places = tree.select("id", F.posexplode(F.concat("ancestors", F.array("id"))).alias("at", "root"))
    best = places.join(wanted, "root").groupBy("id").agg(F.max_by("root", "at").alias("root"))
    return tree.join(best, "id")


def breadcrumb(path, roots: list[str], separator: str = "/"):
    """The longest root that holds the path, then each further part with the path up to it."""
    best = F.greatest(*[F.when((path == r) | F.startswith(path, F.lit(r + separator)), F.length(F.lit(r))).otherwise(-1) for r in roots], F.lit(-1))
    rest = F.filter(F.split(F.substring(path, best + 2, F.length(path)), "\\Q" + separator + "\\E"), lambda s: s != "")
    root = F.substring(path, F.lit(1), best)
    steps = F.transform(F.sequence(F.lit(1), F.size(rest)), lambda i: F.concat_ws(separator, root, F.array_join(F.slice(rest, F.lit(1), i), separator)))
    return F.when(best >= 0, F.concat(F.array(root), F.when(F.size(rest) > 0, steps).otherwise(F.array().cast("array<string>"))))


def crumbs_that_fit(crumbs, budget: int):
    """The longest tail whose parts, each min(length, 24) + 4 wide, are within the budget; one at least."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(a, c):
        cost = a["used"] + F.least(F.length(c), F.lit(24)) + 4
        stop = a["full"] | ((cost > budget) & (F.size(a["kept"]) > 0))
        return F.struct(F.when(stop, a["kept"]).otherwise(F.concat(F.array(c), a["kept"])).alias("kept"), F.when(stop, a["used"]).otherwise(cost).alias("used"), stop.alias("full"))

    return F.aggregate(F.reverse(crumbs), start, step)["kept"]


def visible(tree: DataFrame, denied: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows all of whose directories above may be listed: an anti join on the closure, so one denied folder hides all
    that lies below it."""
    gone = denied.select(F.col(id_col).alias("__up")).distinct()
    hidden = tree.select("id", F.explode("ancestors").alias("__up")).join(gone, "__up").select("id").distinct()
    return tree.join(hidden, "id", "left_anti")


def visible_where(tree: DataFrame, can_list) -> DataFrame:
    """`visible` with a condition on rows in place of a table: what it does not hold for hides all below it."""
    return visible(tree, tree.where(F.col("is_dir") & ~F.coalesce(can_list, F.lit(False))).select("id"))


def descendants_from(tree: DataFrame, folders: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows below any of the folders of a table, each once."""
    wanted = folders.select(F.col(id_col).alias("__up")).distinct()
    below = tree.select("id", F.explode("ancestors").alias("__up")).join(wanted, "__up").select("id").distinct()
    return tree.join(below, "id", "left_semi")
