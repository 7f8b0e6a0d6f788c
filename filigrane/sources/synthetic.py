"""Items from a seed: the same names whatever the number of partitions.

Names come from one xorshift sequence. A step of it is linear over bits, so a partition jumps to its place in the sequence
with powers of the step's matrix instead of walking there.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# What names are made of.
FIRST = ("rapor", "butce", "fatura", "fotograf", "arsiv", "proje", "sunum", "toplanti", "Istanbul", "İzmir", "ışık", "inceleme")
SECOND = ("yillik", "taslak", "final", "eski", "yeni", "kisisel", "ortak", "2024", "2025", "2026", "A", "B")
EXTENSIONS = (".pdf", ".docx", ".txt", ".xlsx", ".jpg", ".png", ".zip", ".md")
DIRECTORY_EVERY, FOLDER_ITEMS, ZERO_SEED = 20, 128, 0x9E3779B9
SCHEMA = "item_id long, name string, full_path string, is_dir boolean, parent_path string"


def step(x: int) -> int:
    x ^= x << 13 & 0xFFFFFFFF
    x ^= x >> 17
    return x ^ (x << 5 & 0xFFFFFFFF)


def times(matrix: list[int], x: int) -> int:
    """A matrix of bits, one word for each bit of the argument, applied to a word."""
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= matrix[i]
        x, i = x >> 1, i + 1
    return out


def jump(x: int, n: int) -> int:
    """The word after n steps."""
    matrix = [step(1 << i) for i in range(32)]
    while n:
        if n & 1:
            x = times(matrix, x)
        matrix = [times(matrix, column) for column in matrix]
        n >>= 1
    return x


def draws_before(index: int) -> int:
    """Three for each file, two for each directory."""
    return 3 * index - -(-index // DIRECTORY_EVERY)


def synthetic_corpus(spark: SparkSession, count: int, seed: int = 1701, root: str = "C:\\Synthetic", separator: str = "\\") -> DataFrame:
    """`count` items; every 20th is a directory, 128 lie in a folder."""
    if count < 1:
        raise ValueError("one item at least")
    start = seed & 0xFFFFFFFF or ZERO_SEED

    def make(batches):
        at, state = None, 0
        for batch in batches:
            rows = []
            for index in batch.column(0).to_pylist():
                if index != at:
                    state = jump(start, draws_before(index))
                at = index + 1
                is_dir = index % DIRECTORY_EVERY == 0
                parts = []
                for choices in (FIRST, SECOND) if is_dir else (FIRST, SECOND, EXTENSIONS):
                    state = step(state)
                    parts.append(choices[state % len(choices)])
                name = f"{parts[0]}-{parts[1]}-{index:07d}" + "".join(parts[2:])
                folder = f"{root}{separator}d{index // FOLDER_ITEMS:05d}"
                rows.append((index, name, f"{folder}{separator}{name}", is_dir, folder))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return spark.range(count).mapInArrow(make, SCHEMA)


def corpus_fingerprint(items: DataFrame) -> str:
    """SHA-256 of all items in order: lengths and bytes of name and path, and the kind. The items stream through the
    driver a partition at a time."""
    digest = hashlib.sha256()
    for r in items.orderBy("item_id").toLocalIterator():
        for text in (r["name"], r["full_path"]):
            data = text.encode()
            digest.update(struct.pack("<i", len(data)) + data)
        digest.update(b"\1" if r["is_dir"] else b"\0")
    return digest.hexdigest()
