"""Batch renames: new names from rules, and a check of the whole plan."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigrane.functions.shared import materialize
from filigrane.functions.text import base_name, parent_path

# Names that no file can have, and characters that no name holds (beside the control characters).
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])
FORBIDDEN = r'[\x00-\x1f<>:"/\\|?*]'
NUMBER = "{n}"


@dataclass(frozen=True)
class Rules:
    """A template for the stem with the number of the file in it, else behind it; a text to replace whatever its case;
    lower, upper or title case by Turkish rules."""

    template: str | None = None
    start: int = 1
    find: str | None = None
    replace: str = ""
    case: str | None = None


def fold_length(text: str) -> str:
    """Lower case of the same length, all kinds of i alike."""
    return "".join("i" if c in "İIı" else c.lower() if len(c.lower()) == 1 else c for c in text)


def turkish_lower(text: str) -> str:
    return text.replace("İ", "i").replace("I", "ı").lower()


def turkish_upper(text: str) -> str:
    return "".join("İ" if c == "i" else c.upper() if len(c.upper()) == 1 else c for c in text)


def turkish_title(text: str) -> str:
    """The first letter of each word in upper case; apostrophes do not end a word."""
    out, inside = [], False
    for c in turkish_lower(text):
        out.append(turkish_upper(c) if c.isalpha() and not inside else c)
        inside = c.isalpha() or inside and c in "'’"
    return "".join(out)


def replace_all(text: str, find: str, by: str) -> str:
    folded, key, out, at = fold_length(text), fold_length(find), [], 0
    while (hit := folded.find(key, at)) >= 0:
        out += [text[at:hit], by]
        at = hit + len(key)
    return "".join([*out, text[at:]])


def renamed(name: str, is_dir: bool, number: int, width: int, rules: Rules) -> str:
    dot = name.rfind(".")
    cut = len(name) if is_dir or dot < 0 or dot == len(name) - 1 else dot
    stem, ext = name[:cut], name[cut:]
    if dot == len(name) - 1 and not is_dir and dot >= 0:  # a dot at the end is no extension and does not stay
        stem, ext = name, ""
    if rules.template and rules.template.strip():
        digits = str(number).rjust(width, "0")
        stem = rules.template.replace(NUMBER, digits) if NUMBER in rules.template else f"{rules.template.rstrip()} {digits}"
    if rules.find:
        stem = replace_all(stem, rules.find, rules.replace)
    stem = {"lower": turkish_lower, "upper": turkish_upper, "title": turkish_title}.get(rules.case or "", str)(stem)
    return (stem.strip() + ext).strip()


def new_name(name: Column, is_dir: Column, number: Column, width: int, rules: Rules) -> Column:
    """Stems by Turkish case rules, which the JVM's functions do not have: an Arrow function over whole batches."""

    @F.pandas_udf(T.StringType())
    def make(names: pd.Series, dirs: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([renamed(n, bool(d), int(k), width, rules) for n, d, k in zip(names, dirs, numbers, strict=True)], dtype=object)

    return make(name, is_dir, number)


def ordinals(files: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """`ordinal` from 0 in the order of the columns: numbered within ranges, with the sizes of the ranges before.

    The numbered ranges are written once, since Spark samples their bounds anew wherever it computes them: sizes and rows
    would come from different ranges, and each reader of the result would see other numbers.
    """
    ranged = files.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    own = materialize(ranged.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "ordinals")
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    return own.join(F.broadcast(before), "__part").withColumn("ordinal", F.col("__own") + F.col("__before") - 1).drop("__part", "__own", "__n", "__before")


def invalid(name: Column) -> Column:
    """Empty, with a forbidden character, a dot or space at the end, or a reserved name before the last dot."""
    before_dot = F.regexp_replace(name, r"\.[^.]*$", "")
    return (name == "") | F.rlike(name, F.lit(FORBIDDEN)) | F.rlike(name, F.lit(r"[. ]$")) | F.upper(before_dot).isin(*RESERVED)


def plan(files: DataFrame, target: Column, existing: DataFrame | None = None, path: str = "path", separator: str = "/") -> DataFrame:
    """The rows of `files` with `folder`, `old_name`, `new_name` and `status`.

    invalid; unchanged; exists, if another file of the folder has the name now in any case, whether it is in the plan and
    moves or not; duplicate, if two of the plan take one name; else ready. A change of case only is ready. `existing`: the
    paths that are there (those of the plan if not given).
    """
    rows = files.withColumns({"folder": F.coalesce(parent_path(F.col(path), separator), F.lit("")), "old_name": base_name(F.col(path), separator)})
    rows = rows.withColumn("new_name", target)
    there = (files if existing is None else existing).select(F.upper(F.col(path)).alias("__there")).distinct()
    wanted = F.when(F.col("folder") == "", F.col("new_name")).otherwise(F.concat_ws(separator, "folder", "new_name"))
    rows = rows.withColumn("__wanted", F.upper(wanted))
    taken = rows.groupBy("__wanted").agg(F.count("*").alias("__same"))
    rows = rows.join(taken, "__wanted").join(there, F.col("__wanted") == F.col("__there"), "left")
    exists = F.col("__there").isNotNull() & (F.upper("new_name") != F.upper("old_name"))
    status = F.when(invalid(F.col("new_name")), "invalid").when(F.col("new_name") == F.col("old_name"), "unchanged").when(exists, "exists").when(F.col("__same") > 1, "duplicate").otherwise("ready")
    return rows.withColumn("status", status).drop("__wanted", "__there", "__same")


def plan_renames(files: DataFrame, rules: Rules, order: list[str], existing: DataFrame | None = None, path: str = "path", is_dir: str = "is_dir", separator: str = "/") -> DataFrame:
    """The plan of a batch: files are numbered in order, with as many digits as the last number has."""
    width = max(1, len(str(rules.start + files.count() - 1)))
    rows = ordinals(files, order)
    target = new_name(base_name(F.col(path), separator), F.col(is_dir), F.col("ordinal") + rules.start, width, rules)
    return plan(rows, target, existing, path, separator)


def can_apply(planned: DataFrame) -> DataFrame:
    """One row: whether something is ready and nothing else but unchanged."""
    ready = F.count_if(F.col("status") == "ready")
    other = F.count_if(~F.col("status").isin("ready", "unchanged"))
    return planned.agg(((ready > 0) & (other == 0)).alias("can_apply"))
