"""Metric logs as text (`;`, five fields) and catalogues as versioned snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.sources import files

# The header, and the group that marks an event.
HEADER = "zaman;bölüm;etiket;değer;sayısal"
EVENT_GROUP = "OLAY"


def read_metric_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples (ts, group, label, value, numeric) and a table with the number of lines that are none."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit(HEADER[:6])))
    f = F.split("value", ";")
    rows = lines.select(F.size(f).alias("n"), F.try_to_timestamp(F.get(f, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), F.get(f, F.lit(1)).alias("group"), F.get(f, F.lit(2)).alias("label"),
                        F.get(f, F.lit(3)).alias("value"), F.get(f, F.lit(4)).try_cast("double").alias("numeric"))
    good = (F.col("n") == 5) & F.col("ts").isNotNull()
    return rows.where(good).drop("n").orderBy("ts"), rows.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"))


def write_metric_log(samples: DataFrame, path: str) -> None:
    text = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "group", "label", F.coalesce("value", F.lit("")), F.coalesce(F.col("numeric").cast("string"), F.lit("")))
    samples.select(text.alias("value")).write.mode("overwrite").text(path)


def checksum(items: DataFrame) -> tuple[int, str]:
    """Rows, and the sum of their hashes: the same whatever their order or files."""
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(items.columns)]).cast("decimal(38,0)")), F.lit(0))).head()
    return n, str(total)


def save_snapshot(items: DataFrame, root: str, version: int, batch_hash: str | None = None) -> bool:
    """A version is its own folder. Its data gets a name of its own; the manifest, which names it with its rows, checksum
    and schema, makes the version valid and is created last, once: of several writers one succeeds."""
    spark = items.sparkSession
    path = f"{root}/v={version:012d}"
    data = f"data-{uuid.uuid4().hex}"
    items.write.parquet(f"{path}/{data}")
    written = spark.read.schema(items.schema).parquet(f"{path}/{data}")
    rows, total = checksum(written)
    manifest = {"version": version, "data": data, "rows": rows, "checksum": total, "schema": items.schema.simpleString(), "batch": batch_hash}
    if files.claim(spark, f"{path}/manifest.json", json.dumps(manifest)):
        return True
    files.delete(spark, f"{path}/{data}")
    return False


def manifest_of(spark: SparkSession, root: str, version: int) -> dict | None:
    """What makes a version valid; None if it is missing or damaged."""
    try:
        text = files.read_text(spark, f"{root}/v={version:012d}/manifest.json")
        return json.loads(text) if text else None
    except ValueError:
        return None
    except Exception as error:
        if "ChecksumException" in str(error):
            return None
        raise


def load_snapshot(spark: SparkSession, root: str, version: int, expected: dict | None = None) -> DataFrame | None:
    """The version's rows, or None if it is missing, damaged or not as `expected` (facts of the manifest), so that the
    caller builds it anew. Faults of the store are raised, not taken for a missing version."""
    manifest = manifest_of(spark, root, version)
    if manifest is None or any(manifest.get(k) != v for k, v in (expected or {}).items()):
        return None
    path = f"{root}/v={version:012d}/{manifest['data']}"
    if not files.exists(spark, path):
        return None
    items = spark.read.parquet(path)
    try:
        whole = items.schema.simpleString() == manifest["schema"] and checksum(items) == (manifest["rows"], manifest["checksum"])
    except Exception as error:
        if any(sign in str(error) for sign in ("CANNOT_READ_FILE", "FAILED_READ_FILE", "is not a Parquet file", "FileNotFound", "PATH_NOT_FOUND", "ChecksumException")):
            return None
        raise
    return items if whole else None


def latest_version(spark: SparkSession, root: str) -> int:
    versions = [int(n.split("=")[1]) for n in files.list_names(spark, root) if n.startswith("v=")]
    return max((v for v in versions if manifest_of(spark, root, v) is not None), default=0)


def commit(items: DataFrame, root: str, expected: int, batch_hash: str, key: str | None = None) -> bool:
    """Write version `expected` + 1 if `expected` is the latest; False if this very batch made the next version already;
    any other state, or a key that comes twice, raises ValueError. Writers race for the manifest, and one wins."""
    spark = items.sparkSession
    if key and not items.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} comes twice in the batch")
    now = manifest_of(spark, root, expected + 1)
    if now is None and (not expected or manifest_of(spark, root, expected) is not None) and save_snapshot(items, root, expected + 1, batch_hash):
        return True
    now = now or manifest_of(spark, root, expected + 1)
    if now is not None and now["batch"] == batch_hash:
        return False
    raise ValueError(f"{expected} is not the latest version of {root}")


def drop_versions(spark: SparkSession, root: str, before: int) -> list[int]:
    """Remove versions that no reader needs any more."""
    old = [int(n.split("=")[1]) for n in files.list_names(spark, root) if n.startswith("v=")]
    gone = [v for v in old if v < before]
    for v in gone:
        files.delete(spark, f"{root}/v={v:012d}")
    return sorted(gone)
