"""Token ids as length-delimited binary records with an offset index.

Every text is encoded by a public tokenizer (`tokenizers` library, no special tokens added), `end_id` is appended, and
the sequences are written in ascending id order to files of framed records:

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

all little-endian. The mask rotates a crc32 right by 15 bits and adds a constant, so that a crc stored in checksummed
data is not mistaken for its own. A payload is: u8 format (1), u8 width of an id in bytes (2 if the vocabulary fits,
else 4), u8 flag (1: the document has an id), u8 zero, i64 document id, ids. Beside `part-*.rec` stands `part-*.idx`, for
each record a pair of i64: its offset in the file and its number of ids; it allows shuffled reads by position.

Files are written under the shared folder by the executors through Arrow's file systems (file, hdfs, s3, ...), first
under a name of their own for each attempt and then renamed, so that a repeated task leaves one whole set of files. They
are read back with Spark's binaryFile source. Rows are range-partitioned by id into partitions of about `part_bytes` of
text at most, each sorted, and a task begins a new file where one would pass `part_bytes`; so a file is bounded by bytes, however
long or short the documents are, but for a single record that is longer. What was written (one row per file) is a table
too: files are placed one after another by sums over it, in blocks of `BLOCK_FILES`, and records meet their file's place
in a join, which Spark broadcasts if it knows the table to be small. The driver holds no list of files.

Defined cases: null and empty texts are sequences of the end id alone; null ids come first; rows with equal ids are
ordered by a hash of the text, then by the text; an empty table writes no file and gives an empty result; other columns
play no role.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.llm.common import map_arrow, materialize, pieces, release, shared_path, small_batches, utf8, worker_store

CACHE_WORDS = 550_000
PART_BYTES = 8 << 20
MOST_PARTS = 100_000
FILE_BYTES = 64 << 20
BLOCK_FILES = 4096
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: By byte: 1 an ASCII letter or digit, 2 ASCII punctuation, 3 white space, 0 others.
KINDS = np.array([1 if chr(c).isalnum() and c < 128 else 2 if c in PUNCTUATION else 3 if c in b" \t\n\r\v\f" else 0 for c in range(256)], np.uint8)
#: First byte of the characters from U+0300 on, the first one that combines with another.
COMBINING = 0xCC
MAY_COMBINE = re.compile(rb"[A-Z][\xcc-\xff]")
MASK = 0xA282EAD8
END_ID = 1


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def unmasked(value: int) -> int:
    value = (value - MASK) & 0xFFFFFFFF
    return ((value >> 17) | (value << 15)) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join([head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))])


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<BBBBq", 1, width, doc_id is not None, 0, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def records(data: bytes | memoryview):
    """(offset, id or None, token ids) of each record; a wrong length, checksum or format raises ValueError."""
    at, view = 0, memoryview(data)
    while at < len(view):
        if at + 12 > len(view):
            raise ValueError(f"cut record head at byte {at}")
        size, crc = struct.unpack_from("<QI", view, at)
        if masked(bytes(view[at : at + 8])) != crc or at + 16 + size > len(view):
            raise ValueError(f"bad record length at byte {at}")
        body = view[at + 12 : at + 12 + size]
        if zlib.crc32(body) != unmasked(struct.unpack_from("<I", view, at + 12 + size)[0]):
            raise ValueError(f"bad record checksum at byte {at}")
        form, width, has_id, _, doc_id = struct.unpack_from("<BBBBq", body)
        if form != 1 or width not in (2, 4):
            raise ValueError(f"unknown record format at byte {at}")
        yield at, doc_id if has_id else None, np.frombuffer(body, f"<u{width}", offset=12)
        at += 16 + size


def record_at(read_range, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset from the index; `read_range(offset, size)` returns bytes of the file."""
    size = struct.unpack("<Q", read_range(offset, 8))[0]
    _, doc_id, ids = next(records(read_range(offset, size + 16)))
    return doc_id, ids


#: The steps before the model for which words may be encoded apart: composed (NFC), white space to spaces, lower case;
#: then contractions, runs of letters, single digits and runs of the rest, each a piece of its own.
STEPS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Encodes words once and looks them up afterwards, where the vocabulary's steps before the model are those of
    `STEPS` and `SPLIT`; with other vocabularies it encodes whole texts.

    No piece holds white space, and none is composed across it, so the ids of a text are those of its words. A word is
    its core and a tail of ASCII punctuation, which are encoded apart where a piece ends between them: after a character
    that the vocabulary itself, asked once for each, keeps apart from punctuation. ASCII letters are put in lower case
    here, unless a character that may combine with them follows: composing comes before lowering, and some letters have a
    composed form in one case only. Words and cores are held in two generations of bounded size each: when the young one
    is full it becomes the old one, and what is used again moves back.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.apart_from_tail: dict[str, bool] = {}
        steps = json.loads(self.tokenizer.to_str())
        normal, cut, added = steps["normalizer"] or {}, steps["pre_tokenizer"] or {}, steps["added_tokens"]
        first = next(iter(cut.get("pretokenizers", ())), {})
        # The rules about words hold for these steps, and for special tokens that begin with a mark to be told by.
        self.by_words = (
            tuple(n["type"] for n in normal.get("normalizers", ())) == STEPS
            and first.get("pattern") == {"Regex": SPLIT}
            and first.get("behavior") == "Removed"
            and bool(first.get("invert"))
            and [p["type"] for p in cut["pretokenizers"][1:]] == ["ByteLevel"]
            and not cut["pretokenizers"][1]["add_prefix_space"]
            and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["content"].split()[1:] for t in added)
        )
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.suffixed = bool(suffix) and self.by_words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def folded(self, text: bytes) -> bytes:
        """The text in lower case with a space between a letter or digit and one punctuation mark that ends a word:
        the same ids from fewer different words."""
        if b"<|" in text:
            return text
        raw = np.frombuffer(text, np.uint8)
        if (((raw[:-1] - 65) < 26) & (raw[1:] >= COMBINING)).any():
            return text
        data = np.frombuffer(text.lower(), np.uint8)
        kind = KINDS[data]
        ends = np.append(kind[2:] == 3, True) if len(kind) > 1 else np.zeros(0, bool)
        at = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1) & ends) + 1
        return np.insert(data, at, 32).tobytes()

    def ends_piece(self, last: str) -> bool:
        """Whether a piece ends after a core that ends in this character, if punctuation follows."""
        if last not in self.apart_from_tail:
            both, one, tail = (e.ids for e in self.tokenizer.encode_batch([f"{last},", last, ","], add_special_tokens=False))
            self.apart_from_tail[last] = both == one + tail
        return self.apart_from_tail[last]

    def parts(self, word: bytes) -> tuple[bytes, bytes]:
        """Core and tail of a word: encoded apart they give the ids of the word."""
        if b"<|" in word:  # special tokens are matched as they are
            return word, b""
        core = word.rstrip(PUNCTUATION)
        if not core:
            return word, b""
        if not word.isascii() and MAY_COMBINE.search(word):
            return word, b""
        if core[-1] < 128 and KINDS[core[-1]] != 1:  # a control character counts as punctuation
            return word.lower(), b""
        if core[-1] >= 128 and len(core) < len(word) and not self.ends_piece(core.decode("utf-8", "replace")[-1]):
            return word.lower(), b""
        return core.lower(), word[len(core) :]

    def learn(self, words: list[bytes]) -> None:
        old, known = self.old, self.words
        known[b""] = b""
        kept = [w for w in words if w in old]
        known.update(zip(kept, map(old.__getitem__, kept), strict=True))
        if kept:
            words = [w for w in words if w not in old]
        parts = list(map(self.parts, words))
        fresh = {x for pair in parts for x in pair} - known.keys()
        kept = [x for x in fresh if x in old]
        known.update(zip(kept, map(old.__getitem__, kept), strict=True))
        fresh.difference_update(kept)
        plain, other = [], []
        for x in fresh:
            (plain if self.suffixed and x.decode("utf-8", "replace").isalpha() else other).append(x)
        for i in range(0, len(plain), 512):
            known.update(self.joined(plain[i : i + 512]))
        for i in range(0, len(other), 4096):
            known.update(self.apart(other[i : i + 4096]))
        known.update((w, known[c] + known[t]) for w, (c, t) in zip(words, parts, strict=True))

    def apart(self, words: list[bytes]):
        got = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [(w, np.array(e.ids, f"<u{self.width}").tobytes()) for w, e in zip(words, got, strict=True)]

    def joined(self, words: list[bytes]):
        """Words of letters are one piece each, and only a piece's last token ends in the suffix."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, f"<u{self.width}")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self.apart(words)
        data, edges = ids.tobytes(), [0, *(ends * self.width).tolist()]
        return [(w, data[a:b]) for w, a, b in zip(words, edges, edges[1:], strict=False)]

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        kind = f"<u{self.width}"
        end = np.array([end_id], kind).tobytes()
        if not self.by_words:
            return [np.frombuffer(ids + end, kind) for _, ids in self.apart(texts)]
        if len(self.words) > CACHE_WORDS:
            self.old, self.words = self.words, {}
        known = self.words.get
        split, found, new = [], [], set()
        for t in texts:
            words = self.folded(t).split()
            ids = list(map(known, words))
            missing = [i for i, x in enumerate(ids) if x is None] if None in ids else ()
            split.append([(i, words[i]) for i in missing])
            new.update([words[i] for i in missing])
            found.append(ids)
        self.learn(list(new))
        out = []
        for ids, missing in zip(found, split, strict=True):
            for i, w in missing:
                ids[i] = known(w)
            ids.append(end)
            out.append(np.frombuffer(b"".join(ids), kind))
        return out


def worker_encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker, for all tasks that it runs."""
    store = worker_store()
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def file_system(uri: str):
    """Arrow's file system for a folder and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_records(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    part_bytes: int = PART_BYTES,
    file_bytes: int = FILE_BYTES,
    path: str | None = None,
) -> DataFrame:
    """Write the files; returns the manifest, a table of one row per file: file, n_records, n_ids, n_bytes, path.

    Writing is an action and takes place here.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "records")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).head()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-size // part_bytes)))
    # Rows with equal ids may be a third of all: the text's hash divides them between partitions, still in order.
    spread = rows.withColumn("h", F.xxhash64("text"))
    ordered = spread.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h", "text").drop("h")

    def write(batches):
        gc.disable()  # millions of small byte strings, no cycles
        try:
            yield from write_part(batches)
        finally:
            gc.enable()
            release(keep=True)

    def write_part(batches):
        import public_tokenizers
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
        part = TaskContext.get().partitionId()
        store, folder = file_system(path)
        store.create_dir(folder, recursive=True)
        own, done = f"_attempt-{uuid.uuid4().hex}", []
        out, index, at, n_ids = None, [], 0, 0

        def close():
            out.close()
            with store.open_output_stream(f"{folder}/{own}-{len(done)}.idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            done.append((f"part-{part:07d}-{len(done):05d}", len(index) // 2, n_ids, at))

        for piece in pieces(batches, "text"):
            for doc_id, ids in zip(piece.column("id").to_pylist(), encoder.encode(utf8(piece.column("text")), end_id), strict=True):
                record = frame(payload_of(doc_id, ids, encoder.width))
                if out and at + len(record) > file_bytes:
                    close()
                    out, index, at, n_ids = None, [], 0, 0
                out = out or store.open_output_stream(f"{folder}/{own}-{len(done)}.rec")
                out.write(record)
                index += [at, len(ids)]
                at, n_ids = at + len(record), n_ids + len(ids)
        if out:
            close()
        for i, (name, *_) in enumerate(done):
            for kind in ("idx", "rec"):
                store.move(f"{folder}/{own}-{i}.{kind}", f"{folder}/{name}.{kind}")
        if done:
            names, *sizes = zip(*done, strict=True)
            columns = [pa.array([f"{n}.rec" for n in names]), *[pa.array(x, pa.int64()) for x in sizes], pa.array([path] * len(done))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "n_records", "n_ids", "n_bytes", "path"])

    small_batches(spark)
    return materialize(ordered.mapInArrow(write, "file string, n_records long, n_ids long, n_bytes long, path string"), "manifest")


def placed(sizes: DataFrame) -> DataFrame:
    """file and `before`, the ids of all files before it, from file and n_ids: sums in blocks of files, then over blocks."""
    rows = sizes.select("file", "n_ids", F.expr(f"cast(substring(file, 6, 7) as long) div {BLOCK_FILES}").alias("block"))
    inside = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for thousands of files
    blocks = rows.groupBy("block").agg(F.sum("n_ids").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    return rows.join(blocks, "block").select("file", (F.col("inside") + F.col("earlier")).alias("before"))


def read_records(spark: SparkSession, path: str, manifest: DataFrame | None = None, ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, file, offset and, if asked for, the ids themselves.

    `start` is the number of ids before the document in all files in order.
    """
    kinds = "doc_id long, within long, n_tokens long, ids_crc32 long, file string, offset long"
    if ids:
        kinds += ", ids array<int>"
    if manifest is None:
        # The ids of a file are summed from its index.
        index = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.idx").load(path).select("path", "content")

        def count(batches):
            for b in batches:
                n = [int(np.frombuffer(c, "<i8")[1::2].sum()) for c in b.column("content").to_pylist()]
                files = [p.rsplit("/", 1)[-1].replace(".idx", ".rec") for p in b.column("path").to_pylist()]
                yield pa.RecordBatch.from_pydict({"file": files, "n_ids": n})

        manifest = materialize(index.mapInArrow(count, "file string, n_ids long"), "manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rec").load(path).select("path", "content")

    def parse(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                name = name.rsplit("/", 1)[-1]
                out: dict = {k.split()[0]: [] for k in kinds.split(", ")}
                held = start = 0
                for offset, doc_id, found in records(content.as_buffer()):
                    out["doc_id"].append(doc_id)
                    out["within"].append(start)
                    out["n_tokens"].append(len(found))
                    out["ids_crc32"].append(zlib.crc32(found.astype("<u4").tobytes()))
                    out["file"].append(name)
                    out["offset"].append(offset)
                    if ids:
                        out["ids"].append(found.astype(np.int32))
                    start += len(found)
                    held += len(found) if ids else 1
                    if held > 1 << 18:
                        yield batch_of(out, kinds)
                        out, held = {k: [] for k in out}, 0
                if out["doc_id"]:
                    yield batch_of(out, kinds)

    own = map_arrow(files, parse, kinds, collect=False).join(placed(manifest), "file")
    columns = ["doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset"]
    return own.select(*columns, *(["ids"] if ids else []))


def records_of(docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """Write the files of `docs` and read them back; an empty table has none."""
    spark = docs.sparkSession
    path = options.pop("path", None) or shared_path(spark, "records")
    manifest = write_records(docs, tokenizer_path, path=path, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long")
    return read_records(spark, path, manifest)


def batch_of(columns: dict, kinds: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    named = dict(k.split(" ", 1) for k in kinds.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(v, types[named[k]]) for k, v in columns.items()], names=list(columns))
