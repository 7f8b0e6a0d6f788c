"""Change feeds as streams: idempotent merges by batch, journal projection and rates with state.

A journal position plays the part of an offset: what is not committed is read again, and a batch that was committed is
not applied twice. Gaps are rows that ask for a rebuild of their root.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.functions.shared import materialize
from filigrane.operators.changes import emit_kind
from filigrane.operators.metrics import fold_rates
from filigrane.sources import files
from filigrane.sources.logs import load_snapshot, save_snapshot


def merge_sink(root: str, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame, key: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: version n + 1 of the snapshot is version n merged with batch n. A batch whose version is there
    already is a replay and changes nothing.

    With a `key`, which `merge` must not move rows across, the snapshot is kept in buckets by its hash: a version names a
    table for each bucket, and only the buckets of the batch's keys are merged and written; `read_buckets` reads it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if key:
            merge_buckets(batch, batch_id)
            return
        if load_snapshot(spark, root, batch_id + 1) is not None:
            return
        before = load_snapshot(spark, root, batch_id) if batch_id else empty
        if before is None:
            raise RuntimeError(f"snapshot {batch_id} of {root} is missing or damaged; rebuild it before going on")
        save_snapshot(merge(before, batch), root, batch_id + 1)

    def merge_buckets(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if files.exists(spark, f"{root}/buckets-{batch_id + 1:012d}.json"):
            return
        text = files.read_text(spark, f"{root}/buckets-{batch_id:012d}.json")
        if batch_id and text is None:
            raise RuntimeError(f"version {batch_id} of {root} is missing; rebuild it before going on")
        places = json.loads(text) if text else {}
        slot = F.pmod(F.xxhash64(key), F.lit(buckets))
        batch = batch.withColumn("__slot", slot)
        touched = [r[0] for r in batch.select("__slot").distinct().collect()]  # at most `buckets`
        old = [places[str(b)] for b in touched if str(b) in places]
        before = spark.read.schema(empty.schema).parquet(*old) if old else empty
        after = merge(before, batch.drop("__slot")).withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(buckets)))
        own = f"{root}/data/{batch_id + 1:012d}-{uuid.uuid4().hex}"
        after.repartition("__slot").write.partitionBy("__slot").parquet(own)
        there = set(files.list_names(spark, own))
        for b in touched:
            places.pop(str(b), None)
            if f"__slot={b}" in there:
                places[str(b)] = f"{own}/__slot={b}"
        files.claim(spark, f"{root}/buckets-{batch_id + 1:012d}.json", json.dumps(places))

    return write


def read_buckets(spark: SparkSession, root: str, version: int, schema) -> DataFrame:
    """A version that `merge_sink` keeps in buckets."""
    text = files.read_text(spark, f"{root}/buckets-{version:012d}.json")
    if text is None:
        raise RuntimeError(f"there is no version {version} of {root}")
    places = list(json.loads(text).values())
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process what there is and stop; the checkpoint keeps the position."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rates(stream: DataFrame, key: str = "key", ts: str = "observed_at", value: str = "value", least: float = 0.25) -> DataFrame:
    """Counter rates with state kept between batches; within a batch samples are taken in time order."""

    def step(keys, frames, state):
        held = list(state.get) if state.exists else [None, None, None]
        held = [None if x is None or pd.isna(x) else x for x in held]
        pdf = pd.concat(list(frames)).sort_values(ts, kind="stable")
        out = fold_rates(zip(pdf[ts].map(lambda t: t.timestamp()), pdf[value], strict=True), least, held)
        state.update(tuple(held))
        yield pd.DataFrame({key: [keys[0]] * len(pdf), ts: pdf[ts].to_numpy(), "rate": pd.array(out, "Float64")})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, rate double", "at double, value double, rate double", "append", "NoTimeout")


# Reasons of journal records.
CREATE, DELETE, SECURITY, OLD_NAME, NEW_NAME, BASIC_INFO, REPARSE, CLOSE = 0x100, 0x200, 0x800, 0x1000, 0x2000, 0x8000, 0x100000, 0x80000000
DATA = 0x1 | 0x2 | 0x4 | 0x10 | 0x20 | 0x40
DIRECTORY = 16
MAX_DEPTH = 512


def has(bits: int) -> Column:
    return F.col("reason").bitwiseAND(F.lit(bits)) != 0


def folder_versions(records: DataFrame, folders: DataFrame) -> DataFrame:
    """ref, parent, name and the positions [since, until) in which a directory has them. Deleted directories keep their
    last place until the batch ends, so what was below them still resolves."""
    old_only = has(OLD_NAME) & ~has(NEW_NAME)
    own = records.where((F.col("attributes").bitwiseAND(F.lit(DIRECTORY)) != 0) & ~old_only & ~has(DELETE))
    own = own.select(F.col("file_ref").alias("ref"), F.col("parent_ref").alias("parent"), "name", F.col("usn").alias("since"))
    every = folders.select(F.col("file_ref").alias("ref"), F.col("parent_ref").alias("parent"), "name", F.lit(-1).cast("long").alias("since")).unionByName(own)
    until = F.lead("since").over(Window.partitionBy("ref").orderBy("since"))
    return every.withColumn("until", F.coalesce(until, F.lit((1 << 63) - 1)))


def paths_at(asked: DataFrame, versions: DataFrame, root_ref: int, root_path: str, separator: str = "\\") -> DataFrame:
    """`path` of each asked directory (ref) at a position (usn), or null: walks up, one level a round, with the names that
    the directories had at that position."""
    front = materialize(asked.select("ref", "usn").distinct().select("ref", "usn", F.col("ref").alias("at"), F.lit("").alias("tail")), "walk")
    done = None
    for _ in range(MAX_DEPTH):
        here = front.where(F.col("at") == F.lit(root_ref)).select("ref", "usn", F.concat(F.lit(root_path), "tail").alias("path"))
        done = here if done is None else done.unionByName(here)
        rest = front.where(F.col("at") != F.lit(root_ref))
        at = versions.select(F.col("ref").alias("at"), "parent", "name", "since", "until")
        up = rest.join(at, "at").where((F.col("usn") > F.col("since")) & (F.col("usn") <= F.col("until")))
        front = materialize(up.select("ref", "usn", F.col("parent").alias("at"), F.concat(F.lit(separator), "name", "tail").alias("tail")), "walk")
        if front.isEmpty():
            break
    return done


def journal_gap(records: DataFrame, root_ref: int) -> DataFrame:
    """One row: why the batch cannot be projected, or null. The root was renamed or deleted; a name is not a single
    segment; a file's old name comes twice without a new one between."""
    broken = (F.col("file_ref") == F.lit(root_ref)) & has(OLD_NAME | NEW_NAME | DELETE)
    bad = (F.col("file_ref") != F.lit(root_ref)) & (F.rlike("name", F.lit(r"[\\/:]")) | F.col("name").isin("", ".", ".."))
    renames = records.where(has(OLD_NAME | NEW_NAME) & (F.col("file_ref") != F.lit(root_ref)))
    before = F.lag((has(OLD_NAME) & ~has(NEW_NAME))).over(Window.partitionBy("file_ref").orderBy("usn"))
    twice = renames.withColumn("__b", before).where("__b").where(has(OLD_NAME) & ~has(NEW_NAME)).agg(F.min("usn").alias("t"))
    found = records.agg(F.min(F.when(broken, F.col("usn"))).alias("b"), F.min(F.when(bad, F.col("usn"))).alias("i")).crossJoin(twice)  # one row each
    late = F.lit((1 << 63) - 1)
    invalid = F.least(F.coalesce("i", late), F.coalesce("t", late))
    reason = F.when(F.col("b").isNotNull() & (F.col("b") <= invalid), "root-identity-changed").when(invalid < late, "feed-state-invalid")
    return found.select(reason.alias("gap"))


def project_journal(records: DataFrame, folders: DataFrame, root_ref: int = 5, root_path: str = "C:", excluded: Column | None = None) -> DataFrame:
    """Events of a batch of records, by the last position of what they tell.

    folders: file_ref, parent_ref and name of the directories known before the batch. Records of a file tell one thing
    until its old name comes or its new one has come; paths are those at the record's position, so folders that the batch
    creates, moves or nests resolve, and what is below a moved folder resolves to both places. A closing record that only
    repeats the last rename tells nothing. Records under an unknown parent give nothing, or a deletion if they had a
    visible old name. `excluded`: a condition on `path` of what must not be seen; a rename across it is split. A batch
    with a gap (`journal_gap`) gives no events.
    """
    gap = journal_gap(records, root_ref)
    own = records.where(F.col("file_ref") != F.lit(root_ref))
    versions = materialize(folder_versions(own, folders), "versions")
    where = paths_at(own.select(F.col("parent_ref").alias("ref"), "usn"), versions, root_ref, root_path)
    placed = own.join(where.select(F.col("ref").alias("parent_ref"), "usn", F.col("path").alias("folder")), ["parent_ref", "usn"], "left")
    path = F.when(F.col("folder").isNotNull(), F.concat(F.col("folder"), F.lit("\\"), F.col("name")))
    if excluded is not None:
        placed = placed.withColumn("path", path)
        path = F.when(~excluded, F.col("path"))
    by_file = Window.partitionBy("file_ref").orderBy("usn")
    is_dir = F.col("attributes").bitwiseAND(F.lit(DIRECTORY)) != 0
    rows = placed.withColumns({"path": path, "is_dir": is_dir, "old_only": has(OLD_NAME) & ~has(NEW_NAME), "new": has(NEW_NAME)})
    place = F.struct("parent_ref", "name", "is_dir")
    renamed = F.last(F.when(F.col("new"), place), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    started = F.last(F.when(F.col("old_only"), F.lit(1)).when(F.col("new"), F.lit(0)), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    again = F.col("new") & has(CLOSE) & (F.coalesce(started, F.lit(0)) == 0) & F.coalesce(renamed == place, F.lit(False))
    rows = rows.withColumn("again", again)
    rows = rows.withColumn("reason", F.when(F.col("again"), F.col("reason").bitwiseAND(F.lit(~(OLD_NAME | NEW_NAME | CLOSE)))).otherwise(F.col("reason"))).withColumn("new", F.col("new") & ~F.col("again"))
    starts = F.col("old_only") | F.coalesce(F.lag("new").over(by_file), F.lit(True))
    rows = rows.withColumn("segment", F.sum(starts.cast("int")).over(by_file))
    counts = ~F.col("old_only") & ((F.col("path").isNotNull() & (F.col("reason") != 0)) | F.col("new"))
    told = F.col("path").isNotNull() & ~F.col("old_only")
    any_ = lambda bits: F.max((told & has(bits)).cast("int")) == 1
    one = rows.groupBy("file_ref", "segment").agg(
        F.max_by(F.when(F.col("old_only"), F.col("path")), F.when(F.col("old_only"), F.col("usn"))).alias("old"),
        F.max_by(F.struct("path"), F.when(counts, F.col("usn"))).alias("now"),
        any_(DELETE).alias("deleted"), (any_(CREATE) | any_(NEW_NAME)).alias("created"), any_(DATA | BASIC_INFO | SECURITY | REPARSE).alias("modified"),
        (F.max((has(SECURITY | REPARSE) & (F.col("path").isNotNull() | F.col("old_only"))).cast("int")) == 1).alias("refresh_subtree"),
        F.max_by("is_dir", "usn").alias("is_dir"), F.max(F.when(F.col("old_only") | counts, F.col("usn"))).alias("usn"),
    )
    event = F.explode(emit_kind(F.col("old"), F.col("now.path"), F.col("deleted"), F.col("created"), F.col("modified")))
    out = one.where("usn IS NOT NULL").select("usn", "is_dir", "refresh_subtree", event.alias("e")).where("e.path IS NOT NULL")
    out = out.crossJoin(F.broadcast(gap)).where("gap IS NULL")  # one row
    return out.select("usn", "e.kind", "e.path", "e.old_path", "is_dir", "refresh_subtree").orderBy("usn")


def folders_after(records: DataFrame, folders: DataFrame) -> DataFrame:
    """The directory map when the batch is accepted: last places, without what was deleted and all below it."""
    last = folder_versions(records, folders).where(F.col("until") == F.lit((1 << 63) - 1)).select(F.col("ref").alias("file_ref"), F.col("parent").alias("parent_ref"), "name")
    final = records.groupBy("file_ref").agg(F.max_by("reason", "usn").alias("reason")).where(has(DELETE)).select("file_ref")
    left = materialize(last.join(final, "file_ref", "left_anti"), "folders")
    front = materialize(final, "gone")
    while not front.isEmpty():
        front = materialize(left.join(front.select(F.col("file_ref").alias("parent_ref")), "parent_ref", "left_semi").select("file_ref"), "gone")
        left = materialize(left.join(front, "file_ref", "left_anti"), "folders")
    return left


def changed_files(records: DataFrame, most: int = 20_000) -> DataFrame:
    """A page for a reader that fetches present states: distinct files in the order in which they were first seen, at most
    `most`, and `next_usn`, the position to go on from: behind all records, or at the first file left out."""
    first = records.groupBy("file_ref").agg(F.min("usn").alias("first_usn")).orderBy("first_usn", "file_ref").limit(most + 1)
    page = first.withColumn("i", F.row_number().over(Window.orderBy("first_usn", "file_ref")))  # a bounded page
    end = page.agg(F.min(F.when(F.col("i") > most, F.col("first_usn"))).alias("cut")).crossJoin(records.agg((F.max("usn") + 1).alias("behind")))
    return page.where(F.col("i") <= most).crossJoin(F.broadcast(end)).select("file_ref", "first_usn", F.coalesce("cut", "behind").alias("next_usn"))


def read_gap(journal_id: int, first_usn: int, next_usn: int, expected_id: int, accepted: int) -> str | None:
    """Why a reader at `accepted` cannot go on: another journal, or a position that it does not hold."""
    if journal_id != expected_id:
        return "journal-replaced"
    if accepted < first_usn or accepted > next_usn:
        return "position-lost"
    return None


def append_log(spark: SparkSession, path: str, rows: DataFrame, sequence: int) -> None:
    """One folder per sequence number, overwritten by a replay."""
    rows.write.mode("overwrite").parquet(f"{path}/sequence={sequence:012d}")
