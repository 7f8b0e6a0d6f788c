"""Removal of repeated substrings by hash-compared suffix sorting.

Every byte covered by a string of `length` bytes that starts anywhere else too (in any text, or elsewhere in the same)
is removed. Sorting all suffixes of a corpus would move every byte many times, so suffixes are first cut down to those
that can matter, without losing any:

1. Each window of `length` bytes has an anchor, its least hashed string of `anchor` bytes (the leftmost of equals).
   Equal windows have equal anchors at equal offsets. One row per anchor, about one in 76 bytes, goes through a shuffle:
   the anchor's hash, the hash of its slice (all windows with that anchor), and where it is. Anchors that occur once
   are done with.
2. Slices with both hashes equal are a class. If they lie in different texts or places, the bytes of each are fetched and
   grouped as they are: a class of one byte string is repeated as a whole. A class of several strings, a collision of
   the hashes, is taken apart, and its slices go to step 3 one by one.
3. What is left are anchors with several different slices, at the borders of repeated passages. One slice of each kind
   is fetched as bytes, and within an anchor's group the suffixes that start at its windows are sorted: a mergesort
   whose comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes.
   Neighbours that share `length` bytes are compared byte by byte, so a hash collision removes nothing.
   Groups with over `hot` different slices are not put together in a task. They are split by all that follows, down to
   single suffixes: windows are grouped by their hashes in a pre-aggregated shuffle, and those found twice once more by
   their bytes.

So no byte is removed for a hash alone. Compared strings have at most `length` + 255 bytes; the known families of strings
that collide in every polynomial hash modulo 2**64 begin at 1,024. Texts are known by their 128-bit hash (equal rows are
one text), and texts are shuffled only if they have a slice to fetch or a byte to remove.

Defined cases: null is the empty text; texts shorter than `length` keep everything; repeated rows repeat each other, so
all their windows go; overlapping repeats count; an empty table gives an empty result; a `length` of more than `anchor`
+ 255 raises ValueError.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import map_arrow, materialize, narrowed, pieces, utf8

LENGTH = 200
ANCHOR = 50
SEGMENT = 1 << 19
BULK = 1 << 20
HOT = 4_000
REPEATED, AMONG, CROWDED = 1, 2, 4

BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Prefix polynomial hashes modulo 2**64 of a byte string; equal substrings have equal hashes."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes.powers) < n:
            size = 1 << n.bit_length()
            Hashes.powers = powers_of(BASE, size)
            Hashes.inverses = powers_of(INVERSE, size)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes.powers[: n - 1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * Hashes.inverses[start]

    def windows(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return (self.prefix[size:] - self.prefix[:n]) * Hashes.inverses[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def anchors(segments: list[bytes], length: int, size: int) -> tuple[np.ndarray, ...]:
    """For each anchor: its segment, first and last window, its own start, its hash and the hash of its slice."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    hashes = Hashes(data)
    g = mix(hashes.windows(size))
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), length - size + 1)
    first = (least & low).astype(np.int64)  # start of each window's anchor
    starts = np.arange(len(first))
    valid = np.flatnonzero(np.repeat(ends, sizes)[: len(first)] - starts >= length)
    own = first[valid]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)])
    lo = valid[new]
    hi = valid[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(valid) - 1]])]
    at = own[new]
    slices = mix(hashes.of(lo, hi + length) + (hi - lo).astype(np.uint64) * C1 + (at - lo).astype(np.uint64) * C3)
    return np.searchsorted(ends, lo, side="right"), lo - (ends - sizes)[np.searchsorted(ends, lo, side="right")], hi - lo, at - lo, g[at], slices


def segments_of(texts: list[bytes], length: int) -> tuple[list[bytes], list[int], list[int]]:
    """Texts cut so that every window lies in one segment; the text and the offset of each."""
    parts, owner, offset = [], [], []
    for i, t in enumerate(texts):
        for s in range(0, len(t) - length + 1, SEGMENT):
            parts.append(t[s : s + SEGMENT + length - 1])
            owner.append(i)
            offset.append(s)
    return parts, owner, offset


def anchor_rows(texts: DataFrame, length: int, size: int, slice_bits: int = 64) -> DataFrame:
    """key, h (of the anchor), sh (of the slice, of which `slice_bits` bits are kept) and at: first window << 16 |
    anchor's offset << 8 | further windows."""
    if not 0 <= length - size <= 255:
        raise ValueError(f"an anchor of {size} bytes cannot stand for windows of {length}")

    def run(batches):
        for piece in pieces(batches, "text", SEGMENT):
            parts, owner, offset = segments_of(utf8(piece.column("text")), length)
            i = 0
            while i < len(parts):
                j, held = i, 0
                while j < len(parts) and (j == i or held + len(parts[j]) <= 4 * SEGMENT):
                    held += len(parts[j])
                    j += 1
                seg, lo, more, off, h, sh = anchors(parts[i:j], length, size)
                seg = seg + i
                at = ((lo + np.array(offset, np.int64)[seg]) << 16) | (off << 8) | more
                sh >>= np.uint64(64 - slice_bits)
                keys = piece.column("key").take(pa.array(np.array(owner, np.int64)[seg]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(h.astype(np.int64)), pa.array(sh.astype(np.int64)), pa.array(at)], names=["key", "h", "sh", "at"])
                i = j

    return map_arrow(texts, run, "key binary, h bigint, sh bigint, at bigint")


def common_extension(hashes: Hashes, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to `most`, the suffixes at x and y share: a binary search over hashes."""
    got = np.zeros(len(x), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        fits = got + step <= most
        end = np.minimum(got + step, most)
        same = hashes.of(x + got, x + end) == hashes.of(y + got, y + end)
        got = np.where(fits & same, end, got)
        step >>= 1
    return got


def suffix_sort(data: np.ndarray, hashes: Hashes, at: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Order of suffixes by segment, then by their first `length` bytes: all segments merge their runs together."""
    order = np.argsort(segment, kind="stable")
    seg = segment[order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(seg)))
    begin, size = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(len(seg)) - begin
    width = 1
    while len(seg) and width < size.max():
        live = np.flatnonzero(size > width)
        r, b, n = place[live], begin[live], size[live]
        run = r // width
        other = run ^ 1
        lo0 = np.minimum(other * width, n)
        lo, hi = lo0.copy(), np.minimum((other + 1) * width, n)
        left = run < other
        x = at[order[live]]
        while True:
            busy = np.flatnonzero(lo < hi)
            if not len(busy):
                break
            mid = (lo[busy] + hi[busy]) // 2
            y = at[order[b[busy] + mid]]
            own = x[busy]
            same = common_extension(hashes, own, y, length)
            full = same >= length
            spot = np.minimum(same, length - 1)
            # For equals, those of the left run come first.
            less = np.where(full, ~left[busy], data[y + spot] < data[own + spot])
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
        target = b + np.minimum(run, other) * width + (r - run * width) + (lo - lo0)
        moved = order[live].copy()
        order[target] = moved
        width *= 2
    return order


def repeated_windows(group: np.ndarray, slices: list[bytes], more: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice, window) of all windows that another slice of the same anchor has too."""
    data = np.frombuffer(b"".join(slices), np.uint8)
    base = np.cumsum([0, *map(len, slices)])[:-1]
    n = more + 1
    which = np.repeat(np.arange(len(slices)), n)
    window = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    segment = group[which] * 256 + (off[which] - window)
    at = base[which] + window
    # Suffixes that are alone at their anchor and offset need no sorting.
    _, inverse, count = np.unique(segment, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    which, window, segment, at = which[some], window[some], segment[some], at[some]
    hashes = Hashes(data)
    order = suffix_sort(data, hashes, at, segment, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((segment[a] == segment[b]) & (hashes.of(at[a], at[a] + length) == hashes.of(at[b], at[b] + length)))
    hit = np.zeros(len(at), bool)
    reach = np.arange(length)
    for i in range(0, len(near), 10_000):
        x, y = a[near[i : i + 10_000]], b[near[i : i + 10_000]]
        same = (data[at[x][:, None] + reach] == data[at[y][:, None] + reach]).all(1)
        hit[x[same]] = hit[y[same]] = True
    return which[hit], window[hit]


def runs_of(which: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows: slice, first and last."""
    order = np.lexsort((window, which))
    which, window = which[order], window[order]
    if not len(which):
        return which, window, window
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(which) - 1]])
    return which[new], window[new], window[last]


def border_runs(slices: DataFrame, length: int) -> DataFrame:
    """key, start, end of repeated runs in slices with a key, from rows sorted by anchor; slices without one stand for a
    class that is removed anyway."""

    def settle(table: pa.Table):
        group = np.unique(table.column("h").to_numpy(), return_inverse=True)[1]
        at = table.column("at").to_numpy()
        which, window = repeated_windows(group, table.column("slice").to_pylist(), at & 255, (at >> 8) & 255, length)
        keep = table.column("key").is_valid().to_numpy(zero_copy_only=False)[which]
        which, first, last = runs_of(which[keep], window[keep])
        begin = (at >> 16)[which]
        return pa.RecordBatch.from_arrays(
            [table.column("key").combine_chunks().take(pa.array(which)), pa.array(begin + first), pa.array(begin + last + length)], names=["key", "start", "end"]
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for piece in pieces(batches, "slice", BULK // 4):
            held.append(piece)
            size += piece.num_rows * (length + 80)
            if size < BULK:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0  # the last anchor may go on
            if cut:
                yield settle(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = (len(h) - cut) * (length + 80) if cut else size
        if held:
            yield settle(pa.Table.from_batches(held))

    return map_arrow(slices, run, "key binary, start bigint, end bigint")


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def hot_runs(slices: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different slices: single suffixes meet by hash, then by their bytes."""

    def windows(batches):
        reach = np.arange(length)
        for piece in pieces(batches, "slice", BULK // 64):
            at = np.array(piece.column("at").to_pylist(), np.int64)
            data = piece.column("slice").to_pylist()
            n = (at & 255) + 1
            base = np.cumsum([0, *map(len, data)])[:-1]
            which = np.repeat(np.arange(len(data)), n)
            window = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            flat = np.frombuffer(b"".join(data), np.uint8)
            first = base[which] + window
            h = Hashes(flat).of(first, first + length)
            offset = ((at >> 8) & 255)[which] - window
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(which)) for c in (piece.column("key"), piece.column("h"))]
                + [pa.array((at >> 16)[which] + window), pa.array(mix(h + offset.astype(np.uint64) * C1).astype(np.int64)), binaries(flat[first[:, None] + reach])],
                names=["key", "h", "start", "w", "bytes"],
            )

    own = map_arrow(slices, windows, "key binary, h bigint, start bigint, w bigint, bytes binary")
    twice = own.groupBy("h", "w").agg(F.count("*").alias("times")).where("times > 1").select("h", "w", F.xxhash64("h", "w").alias("hw"))
    twice = materialize(twice, "twice")
    hits = narrowed(own.withColumn("hw", F.xxhash64("h", "w")), "hw", twice.select("hw")).drop("hw").join(twice.drop("hw"), ["h", "w"])
    hits = materialize(hits, "hits")
    same = materialize(hits.groupBy("h", "w", "bytes").agg(F.count("*").alias("times")).where("times > 1").drop("times"), "same")
    return hits.where("key IS NOT NULL").join(same, ["h", "w", "bytes"]).select("key", "start", (F.col("start") + length).alias("end"))


def fetched_slices(source: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The rows of `asked` (key, h, sh, at, kind) with the bytes of their slices. One row of each text is read; slices
    that follow one another, and so overlap, are rows that follow one another."""
    asked = asked.groupBy("key").agg(F.collect_set(F.struct("at", "h", "sh", "kind")).alias("asked"))
    holder = narrowed(source.select("key", "id"), "key", asked.select("key")).groupBy("key").agg(F.min("id").alias("holder"))
    asked = asked.join(holder, "key")
    near = narrowed(source, "key", asked.select("key"))
    found = near.join(asked, (near["key"] == asked["key"]) & near["id"].eqNullSafe(asked["holder"])).select(near["key"], "text", "asked")

    def cut(batches):
        for piece in pieces(batches, "text", SEGMENT):
            out: dict = {k: [] for k in ("key", "h", "sh", "at", "kind", "slice")}
            for key, t, wanted in zip(piece.column("key").to_pylist(), utf8(piece.column("text")), piece.column("asked").to_pylist(), strict=True):
                for w in sorted(wanted, key=lambda w: w["at"]):
                    start = w["at"] >> 16
                    for k in ("h", "sh", "at", "kind"):
                        out[k].append(w[k])
                    out["key"].append(key)
                    out["slice"].append(t[start : start + (w["at"] & 255) + length])
            types = {"key": pa.binary(), "slice": pa.binary(), "kind": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return map_arrow(found, cut, "key binary, h bigint, sh bigint, at bigint, kind int, slice binary")


def repeated_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, slice_bits: int = 64
) -> DataFrame:
    """key (128-bit hash of a text) and runs: its byte ranges (start, end) that are repeated, not yet merged."""
    text = F.col(f"`{text_col}`")
    source = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    source = source.where(F.octet_length("text") >= length)
    rows = anchor_rows(source.select("key", "text"), length, anchor, slice_bits)
    # A table of its own, so that the join has a shuffle on each side and Spark can split an anchor that many share.
    shared = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    matched = materialize(rows.join(shared, "h"), "anchors")
    place = F.struct("key", "at")
    kinds = matched.groupBy("h", "sh").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    kinds = materialize(kinds.select("h", "sh", "n", "first", (F.col("first") != F.col("last")).alias("spread")), "slices")
    several = materialize(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "several")
    # kind: REPEATED if the slice's class has several rows, AMONG if its anchor has several classes, CROWDED if over `hot`.
    flags = F.when(F.col("n") > 1, REPEATED).otherwise(0) + F.when(F.col("kinds") > 1, AMONG).otherwise(0) + F.when(F.col("kinds") > hot, CROWDED).otherwise(0)
    asked = kinds.join(several, "h").where("kinds > 1 OR spread")
    asked = materialize(asked.select("first.key", "h", "sh", "first.at", flags.alias("kind"), "spread"), "asked")
    # Of a class in several places the bytes of each are compared, of others one slice is enough.
    compared = materialize(asked.where("spread").select("h", "sh", "kind"), "compared")
    names = ["key", "h", "sh", "at", "kind"]
    members = matched.join(compared, ["h", "sh"]).select(*names)
    slices = fetched_slices(source, asked.where("NOT spread").select(*names).union(members), length)
    slices = materialize(slices, "cuts")

    def of(rows: DataFrame, kind: int, yes: bool = True) -> DataFrame:
        return rows.where((F.col("kind").bitwiseAND(F.lit(kind)) != 0) == yes)

    variants = materialize(of(slices, REPEATED).groupBy("h", "sh", "kind", "slice").agg(F.min("at").alias("at")), "variants")
    mixed = materialize(variants.groupBy("h", "sh").agg(F.count("*").alias("k")).where("k > 1").drop("k"), "mixed")
    span = [F.shiftright("at", 16).alias("start"), (F.shiftright("at", 16) + F.expr("at & 255") + length).alias("end")]
    twice, checked = kinds.where("n > 1").select("h", "sh"), variants
    columns = ["key", "h", "at", "slice", "kind"]
    border = of(of(slices, REPEATED, False), AMONG).select(*columns)
    parts = []
    if not mixed.isEmpty():  # slices that only their hashes put together: each by itself
        twice, checked = (x.join(mixed, ["h", "sh"], "left_anti") for x in (twice, checked))
        border = border.union(of(slices, REPEATED).join(mixed, ["h", "sh"]).select(*columns))
        parts.append(matched.join(mixed, ["h", "sh"]).groupBy("key", "at").agg(F.count("*").alias("n")).where("n > 1").select("key", *span))
    parts.append(matched.join(twice, ["h", "sh"]).select("key", *span).distinct())
    border = border.dropDuplicates(["key", "h", "at"])
    border = border.union(of(checked, AMONG).select(F.lit(None).cast("binary").alias("key"), *columns[1:]))
    usual = of(border, CROWDED, False).drop("kind")
    parts.append(border_runs(usual.repartition("h").sortWithinPartitions("h"), length))
    if not several.where(F.col("kinds") > hot).isEmpty():
        parts.append(hot_runs(of(border, CROWDED).drop("kind"), length))
    return reduce(DataFrame.union, parts).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; `texts` adds the bytes that stay."""
    found = materialize(repeated_spans(docs, id_col=id_col, text_col=text_col, length=length, **options), "runs")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
    # Texts without a repeated byte need no join: they are told by their keys alone.
    touched = narrowed(rows, "key", found.select("key")).join(found, "key")

    def cut(batches):
        for piece in pieces(batches, "text"):
            out: dict = {k: [] for k in names}
            for doc_id, t, runs in zip(piece.column("doc_id").to_pylist(), utf8(piece.column("text")), piece.column("runs").to_pylist(), strict=True):
                spans = merged(runs)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(t[at:s])
                    at = e
                left = b"".join([*kept, t[at:]])
                values = (doc_id, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left)
                for k, v in zip(names, values, strict=False):
                    out[k].append(v)
            types = {"doc_id": piece.column("doc_id").type, "kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in out.items()], names=names)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
    with_repeats = map_arrow(touched.select("doc_id", "text", "runs"), cut, schema)
    columns = ["doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")]
    columns += [F.col("text").cast("binary").alias("kept")] * texts
    plain = rows.select("key", *columns).join(found.select("key"), "key", "left_anti").drop("key")
    return with_repeats.unionByName(plain)
