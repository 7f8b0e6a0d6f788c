"""Quality rules by tokeniser fertility.

Each text is cut into words (`[^\\x20\\x09-\\x0D]+`) and every word is encoded by two public vocabularies: a SentencePiece
BPE with byte fallback and a byte-level BPE for many languages. Per text this gives characters per token under both, the
share of byte-fallback tokens and the entropy of the token distribution in bits. The script that most words are written
in picks the band; a text outside of its band is rejected. Plain surface counts come with it: a text of fewer than
`min_words` words, or with over `max_repeat_percent` % of its words in repeated 3-word windows, fails the base rule.

Words are encoded once per task and looked up afterwards, so the cost follows the number of distinct words. The work is
one pass without a shuffle; memory is one piece of a few MB, plus the words of a task up to `CACHE_WORDS`.

Defined cases: a null or empty text has no words and fails the base rule; a text whose words have no letter uses the
band `Other`; repeated rows are judged alike, one result each; an empty table gives an empty result; a column of the
input that has the name of a result column is replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from filigrane.llm.common import append_columns, utf8

CACHE_WORDS = 150_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Per script: least characters per token under the piece and the byte vocabulary, most of either, largest share of
#: byte-fallback tokens, least token entropy in bits. Scripts without spaces between words have one long "word", and
#: vocabularies made for Latin text spend several tokens on each of their characters.
BANDS = {
    "Latin": (1.60, 1.75, 12.0, 0.10, 5.2),
    "Greek": (0.70, 0.70, 12.0, 0.60, 4.5),
    "Cyrillic": (1.00, 1.00, 12.0, 0.30, 5.0),
    "Hebrew": (0.60, 0.60, 12.0, 0.60, 4.5),
    "Arabic": (0.60, 0.60, 12.0, 0.60, 4.5),
    "Indic": (0.30, 0.30, 12.0, 0.95, 4.0),
    "Thai": (0.30, 0.30, 12.0, 0.95, 4.0),
    "Kana": (0.40, 0.40, 12.0, 0.90, 4.5),
    "Hangul": (0.30, 0.30, 12.0, 0.95, 4.5),
    "Han": (0.30, 0.30, 12.0, 0.95, 4.5),
    "Other": (0.20, 0.20, 12.0, 1.00, 2.0),
}
#: First and last code point of the blocks that tell a script.
BLOCKS = [
    (0x41, 0x24F, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x590, 0x5FF, "Hebrew"),
    (0x600, 0x77F, "Arabic"), (0x900, 0xDFF, "Indic"), (0xE00, 0xE7F, "Thai"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x3FFFF, "Han"),
]
SCRIPTS = list(BANDS)

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("script", T.StringType()),
        T.StructField("piece_chars_per_token", T.DoubleType()),
        T.StructField("byte_chars_per_token", T.DoubleType()),
        T.StructField("byte_fallback_share", T.DoubleType()),
        T.StructField("token_entropy", T.DoubleType()),
    ]
)


def script_of(word: str) -> int:
    """Index of the script of a word's first letter."""
    for c in word:
        if c.isalpha():
            p = ord(c)
            for low, high, name in BLOCKS:
                if low <= p <= high:
                    return SCRIPTS.index(name)
            break
    return SCRIPTS.index("Other")


class Words(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Fertility:
    """Measures texts; holds what it has learnt of each word so far."""

    def __init__(self, piece_path: str, byte_path: str, bands: dict, min_words: int, max_repeat_percent: int):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])
        self.bands = np.array([bands[s] for s in SCRIPTS])
        self.min_words, self.max_repeat_percent = min_words, max_repeat_percent
        self.forget()

    def forget(self) -> None:
        self.words = Words()
        self.chars = np.zeros(0, np.int64)
        self.scripts = np.zeros(0, np.int64)
        self.n_byte = np.zeros(0, np.int64)
        self.n_fallback = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        encoded = self.piece.encode(texts, num_threads=1)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        tokens = np.fromiter((i for ids in encoded for i in ids), np.int32, int(lengths.sum()))
        owner = np.repeat(np.arange(len(new)), lengths)
        fallback = np.bincount(owner, weights=self.fallback[tokens], minlength=len(new)).astype(np.int64)
        n_byte = np.fromiter((len(self.byte.encode_ordinary(" " + t)) for t in texts), np.int64, len(new))
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, texts), np.int64, len(new))])
        self.scripts = np.concatenate([self.scripts, np.fromiter(map(script_of, texts), np.int64, len(new))])
        self.n_byte = np.concatenate([self.n_byte, n_byte])
        self.n_fallback = np.concatenate([self.n_fallback, fallback])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.tokens = np.concatenate([self.tokens, tokens])

    def measure(self, texts: list[bytes]) -> dict:
        if len(self.words) > CACHE_WORDS:
            self.forget()
        known = len(self.words)
        split = [t.split() for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((self.words[w] for words in split for w in words), np.int64, int(n_words.sum()))
        if len(self.words) > known:
            self.learn(list(self.words)[known:])
        del split
        ends = np.cumsum(n_words)
        doc = np.repeat(np.arange(len(texts)), n_words)

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=values, minlength=len(texts)).astype(np.int64)

        word_chars = total(self.chars[ids])
        n_tokens = np.diff(self.starts)[ids]
        n_piece, n_byte, n_fallback = total(n_tokens), total(self.n_byte[ids]), total(self.n_fallback[ids])
        script = np.zeros((len(texts), len(SCRIPTS)), np.int64)
        np.add.at(script, (doc, self.scripts[ids]), 1)
        lettered = script.copy()
        lettered[:, SCRIPTS.index("Other")] = 0
        script = np.where(lettered.sum(1) > 0, lettered.argmax(1), SCRIPTS.index("Other"))
        n_repeat = np.zeros(len(texts), np.int64)
        entropy = np.zeros(len(texts))
        symbols, dup_lines = [], []
        for i, (text, end, n) in enumerate(zip(texts, ends, n_words, strict=True)):
            own = ids[end - n : end]
            n_repeat[i] = repeated(own, len(self.words))
            entropy[i] = self.entropy(own)
            symbols.append(len(text) - len(text.translate(None, b"#*$%&|<>")))
            lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else ()
            dup_lines.append(len(lines) - len(set(lines)))
        with np.errstate(divide="ignore", invalid="ignore"):
            per_piece = np.where(n_piece > 0, word_chars / n_piece, 0.0)
            per_byte = np.where(n_byte > 0, word_chars / n_byte, 0.0)
            share = np.where(n_piece > 0, n_fallback / n_piece, 0.0)
        base_failed = (n_words < self.min_words) | (100 * n_repeat > self.max_repeat_percent * n_words)
        least, least_byte, most, most_share, least_entropy = self.bands[script].T
        inside = (per_piece >= least) & (per_byte >= least_byte) & (per_piece <= most) & (per_byte <= most)
        inside &= (share <= most_share) & (entropy >= least_entropy)
        return {
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": np.array(symbols, np.int64),
            "n_dup_lines": np.array(dup_lines, np.int64),
            "n_repeat_words": n_repeat,
            "base_failed": base_failed,
            "kept": ~base_failed & inside,
            "script": pa.array([SCRIPTS[i] for i in script], pa.string()),
            "piece_chars_per_token": per_piece,
            "byte_chars_per_token": per_byte,
            "byte_fallback_share": share,
            "token_entropy": entropy,
        }

    def entropy(self, words: np.ndarray) -> float:
        """Bits per token of the piece vocabulary's tokens in a text."""
        first = self.starts[words]
        n = self.starts[words + 1] - first
        total = int(n.sum())
        if not total:
            return 0.0
        at = np.arange(total) + np.repeat(first - (np.cumsum(n) - n), n)
        tokens = np.sort(self.tokens[at])
        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        p = np.diff(edges) / total
        return float(-(p * np.log2(p)).sum())


def repeated(ids: np.ndarray, n_ids: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    if n_ids <= 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, own = np.unique(ids, return_inverse=True)
        pairs = own[:-1] * len(ids) + own[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        windows = pairs[:-1] * len(ids) + own[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    hit = np.zeros(len(ids), bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def fertility_rules(
    df: DataFrame,
    text_col: str = "text",
    *,
    piece_path: str | None = None,
    byte_path: str | None = None,
    bands: dict | None = None,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    into: str | None = None,
) -> DataFrame:
    """All rows and columns of `df` with the columns of `FIELDS`, or with one struct `into` of them.

    The paths name vocabulary files that each executor can open; by default those of the installed public package.
    """
    bands = BANDS | (bands or {})

    def make():
        import public_tokenizers

        meter = Fertility(
            piece_path or public_tokenizers.path("piece_bpe_32k.model"),
            byte_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
            bands, min_words, max_repeat_percent,
        )
        return lambda column: meter.measure(utf8(column))

    return append_columns(df, text_col, FIELDS, make, into)
