"""A store of a catalogue's tables as versioned snapshots, with notes and excluded paths beside them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.operators import changes, live
from filigrane.sources import files, logs

TABLES = ("directories", "files", "tokens", "file_tokens")
KEEP = ("open_count", "created")


@dataclass(frozen=True)
class Store:
    """Tables below a folder. Each write makes a new version of a table; readers keep the one that they opened."""

    spark: SparkSession
    root: str

    def read(self, table: str) -> DataFrame | None:
        return logs.load_snapshot(self.spark, f"{self.root}/{table}", logs.latest_version(self.spark, f"{self.root}/{table}"))

    def write(self, table: str, rows: DataFrame, batch: str, key: str | None = None) -> bool:
        """The table's next version; False if this batch made the latest one already."""
        place = f"{self.root}/{table}"
        now = logs.latest_version(self.spark, place)
        if now and logs.manifest_of(self.spark, place, now)["batch"] == batch:
            return False
        return logs.commit(rows, place, now, batch, key)

    def upsert(self, table: str, rows: DataFrame, batch: str) -> bool:
        """Rows by path; open counts and creation times of rows that are there stay."""
        before = self.read(table)
        return self.write(table, rows if before is None else changes.upsert(before, rows, "full_path", KEEP), batch, "full_path")

    def files_of(self, directory: str) -> DataFrame:
        return self.read("files").where(F.col("parent_path") == directory)

    def opened(self, opens: DataFrame, batch: str) -> DataFrame:
        """Raise open counts; the files that were opened with their new counts."""
        self.write("files", live.count_opens(self.read("files"), opens), batch, "full_path")
        return self.read("files").join(opens.select("full_path").distinct(), "full_path", "left_semi").select("full_path", "open_count")

    def counts(self) -> DataFrame:
        tables = [t for t in TABLES if self.read(t) is not None]
        rows = [self.read(t).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in tables]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def compact(self, table: str, keep: int = 1) -> list[int]:
        """Remove all versions of a table but for the last ones."""
        place = f"{self.root}/{table}"
        return logs.drop_versions(self.spark, place, logs.latest_version(self.spark, place) - keep + 1)

    def _notes(self) -> dict:
        text = files.read_text(self.spark, f"{self.root}/notes.json")
        return json.loads(text) if text else {"values": {}, "excluded": []}

    def put(self, key: str, value: str) -> None:
        notes = self._notes()
        notes["values"][key] = value
        files.write_text(self.spark, f"{self.root}/notes.json", json.dumps(notes))

    def get(self, key: str) -> str | None:
        return self._notes()["values"].get(key)

    def exclude(self, paths: list[str]) -> None:
        notes = self._notes()
        notes["excluded"] = sorted({*notes["excluded"], *paths})
        files.write_text(self.spark, f"{self.root}/notes.json", json.dumps(notes))

    def excluded(self) -> list[str]:
        return self._notes()["excluded"]

    def clear(self) -> None:
        files.delete(self.spark, self.root)


def open_if(spark: SparkSession, root: str, version: int, facts: dict, build) -> DataFrame:
    """The snapshot if its manifest and data are as the facts say (schema, rows, checksum, batch), else what `build` makes."""
    found = logs.load_snapshot(spark, root, version, facts)
    return build() if found is None else found


def slices(items: DataFrame, order_col: str, size: int = 8192) -> DataFrame:
    """The slice that each row is prepared in, so that long preparations go step by step."""
    return items.withColumn("slice", F.floor(F.col(order_col) / size).cast("long"))
