"""Name text: folding, tokens, distances, path parts.

Folding is done once, where a catalogue is built, by Arrow functions; names of plain ASCII have native equivalents.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What separates the tokens of a name.
DELIMITERS = " _-.,[]()"
SPLIT = r"[ _\-.,\[\]()]"


def fold_text(text: str) -> str:
    """Without accents; dotless and dotted i of either case become i. ASCII but for I stays as it is."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", plain.replace("ı", "i").replace("İ", "i").replace("I", "i"))


#: Composed letters that fold to another one, by the general rule.
ACCENTED = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if fold_text(c) != c and len(fold_text(c)) == 1)
PLAIN = "".join(map(fold_text, ACCENTED))


def fold_native(name: Column) -> Column:
    """Folding within the JVM for composed letters of the usual languages; `fold` covers all."""
    return F.translate(name, ACCENTED, PLAIN)


def upper_text(text: str) -> str:
    """Upper case that keeps the number of characters; dotted and dotless i keep their form."""
    return "".join(c if c in "ıİ" or len(c.upper()) != 1 else c.upper() for c in text)


def tokens_of(text: str | None) -> list[str]:
    """Tokens in order, duplicates kept; one that folds to something else is followed by its folded form."""
    out: list[str] = []
    lowered = unicodedata.normalize("NFC", text or "").replace("İ", "i").replace("I", "ı").lower()
    for d in DELIMITERS:
        lowered = lowered.replace(d, " ")
    for token in lowered.split(" "):
        token = token.strip()
        if token:
            out.append(token)
            if not token.isascii() and (folded := fold_text(token)) != token:
                out.append(folded)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(names: pd.Series) -> pd.Series:
    return names.map(tokens_of)


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else fold_text(x))


@F.pandas_udf(T.StringType())
def fold_upper(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else upper_text(x))


@F.pandas_udf(T.StringType())
def plain(names: pd.Series) -> pd.Series:
    """The key of accent-blind search: folded, then upper case."""
    return names.map(lambda x: None if x is None else upper_text(fold_text(x)))


def tokenize_ascii(name: Column) -> Column:
    """Native tokens for names of ASCII without a capital I."""
    return F.filter(F.transform(F.split(F.lower(name), SPLIT), lambda t: F.trim(t)), lambda t: t != "")


def extension(name: Column) -> Column:
    """From the last dot on; empty if there is none or nothing follows it."""
    return F.regexp_extract(name, r"(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def base_name(path: Column, separator: str = "/") -> Column:
    return F.substring_index(path, separator, -1)


def parent_path(path: Column, separator: str = "/") -> Column:
    cut = F.length(path) - F.length(base_name(path, separator)) - len(separator)
    return F.when(cut > 0, F.substring(path, F.lit(1), cut))


def segments(path: Column, separator: str = "/") -> Column:
    return F.filter(F.split(path, "\\Q" + separator + "\\E"), lambda s: s != "")


def depth(path: Column, separator: str = "/") -> Column:
    return F.size(segments(path, separator))


def in_scope(path: Column, root: Column, separator: str = "/") -> Column:
    """Equal to the root or below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit(separator)))


def byte_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance in UTF-8 bytes: each byte is read as one character."""
    x, y = (F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") for c in (a, b))
    return F.levenshtein(x, y) if most is None else F.levenshtein(x, y, most)


def near(a: Column, b: Column, most: int) -> Column:
    """Within a distance in characters; an empty operand is never near. The length gap is tested first."""
    return (a != "") & (b != "") & (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, most) >= 0)


def ticks_to_seconds(ticks: Column) -> Column:
    """Whole seconds since 1970 of a count of 100 ns since year 1; 0 and less are unknown."""
    return F.when(ticks > 0, F.floor((ticks - F.lit(621355968000000000)) / F.lit(10_000_000)).cast("long"))


def filetime_to_timestamp(ticks: Column) -> Column:
    """100 ns since 1601 as a timestamp."""
    return F.when(ticks > 0, F.timestamp_micros(F.expr("0") + F.floor((ticks - F.lit(116444736000000000)) / 10).cast("long")))
