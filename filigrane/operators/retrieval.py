"""Token postings and name search.

Postings are one row per item and token. Query tokens are few, so they are literals or a broadcast of a known size;
vocabulary scans (substring, fuzzy) run over distinct tokens before they meet the postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.functions.text import byte_distance, fold_native, fold_text, near, tokenize_ascii


def postings(items: DataFrame, tokens: Column | None = None, id_col: str = "item_id", name_col: str = "name") -> DataFrame:
    own = tokens if tokens is not None else tokenize_ascii(F.col(name_col))
    return items.select(id_col, F.explode(F.array_distinct(own)).alias("token"))


def vocabulary(posted: DataFrame) -> DataFrame:
    return posted.select("token").distinct()


def exact(posted: DataFrame, tokens: list[str]) -> DataFrame:
    return posted.where(F.col("token").isin(tokens))


def partial(posted: DataFrame, part: str, id_col: str = "item_id") -> DataFrame:
    """Items with a token that contains the part, each once: distinct tokens are tested, then meet the postings."""
    wanted = vocabulary(posted).where(F.contains("token", F.lit(part)))
    return posted.join(wanted, "token", "left_semi").select(id_col).distinct()


def fuzzy(posted: DataFrame, token: str, most: int = 2, id_col: str = "item_id", group_col: str | None = None) -> DataFrame:
    """Items with the very token if there is any (per group if one is given), else those with tokens near it. Distances
    are taken of distinct tokens only."""
    by = [group_col] if group_col else []
    words = posted.select(*by, "token").distinct()
    close = words.withColumn("__hit", (F.col("token") == token).cast("int")).where((F.col("__hit") == 1) | near(F.col("token"), F.lit(token), most))
    gate = close.groupBy(*by).agg(F.max("__hit").alias("__exact"))
    close = close.join(F.broadcast(gate), group_col) if group_col else close.crossJoin(F.broadcast(gate))  # one row
    wanted = close.where(F.col("__hit") == F.col("__exact")).select(*by, "token")
    return posted.join(wanted, [*by, "token"], "left_semi").select(id_col).distinct()


def federated(parts: list[DataFrame], keys: list[Column], limit: int) -> DataFrame:
    """The first results of several volumes in one order: each gives its own first ones, all of which are ordered again."""
    tops = [p.orderBy(*keys).limit(max(0, limit)) for p in parts]
    return reduce(DataFrame.unionByName, tops).orderBy(*keys).limit(max(0, limit))


# Whole words in names

# What stands beside a whole word.
BREAKS = r"[ _\-.,\[\]()]"


def name_forms(items: DataFrame, name_col: str = "name") -> DataFrame:
    """The distinct names with their upper-case form and their plain one (folded, then upper case): words are looked for
    in these, and items meet them in an equality join."""
    names = items.select(F.col(name_col).alias("name")).distinct()
    return names.select("name", F.upper("name").alias("folded"), F.upper(fold_native(F.col("name"))).alias("plain"))


def has_word(form: Column, word: str) -> Column:
    """The word between breaks or ends."""
    return F.rlike(form, F.lit(f"(^|{BREAKS})\\Q{word}\\E({BREAKS}|$)")) if word and "\0" not in word else F.lit(False)


def names_with(forms: DataFrame, token: str, whole: bool) -> DataFrame:
    """Names that hold the token in upper case, or its plain form in either form."""
    upper, plain = token.upper(), fold_text(token).upper()
    test = has_word if whole else lambda c, w: F.contains(c, F.lit(w)) if w else F.lit(False)
    return forms.where(test(F.col("folded"), upper) | test(F.col("folded"), plain) | test(F.col("plain"), plain))


def token_items(items: DataFrame, token: str, mode: str = "whole", most: int = 2, limit: int = 64, name_col: str = "name") -> DataFrame:
    """Items whose name has the token as a whole word, in part, or (fuzzy, only if no name has it whole) one of the words
    nearest to it. Tests run on distinct names."""
    if not token.strip():
        return items.limit(0)
    forms = name_forms(items, name_col)
    hit = names_with(forms, token, mode != "partial").select("name")
    if mode == "fuzzy":
        words = forms.select("name", F.explode(F.split("plain", BREAKS)).alias("word")).where(F.octet_length("word").between(3, 64) & ~F.rlike("word", F.lit("[0-9]")))
        seen = words.groupBy("word").agg(F.min("name").alias("first_seen"))
        near_ = near_words(seen, fold_text(token).upper(), most, limit, byte_distance)
        close = words.join(F.broadcast(near_.select("word")), "word", "left_semi").select("name").distinct()  # at most `limit`
        gate = hit.agg((F.count("*") == 0).alias("none"))
        hit = hit.unionByName(close.crossJoin(F.broadcast(gate)).where("none").select("name"))  # one row
    return items.join(hit.distinct().withColumnRenamed("name", name_col), name_col, "left_semi")


# Blocks that can hold a text

GRAM_BITS = 16_384
BLOCK_ROWS = 256


def gram_bits(text: Column, size: int = 3, hashes: int = 2) -> Column:
    """The bits of all strings of `size` characters of a text in upper case."""
    upper = F.upper(text)
    grams = F.transform(F.sequence(F.lit(1), F.length(upper) - (size - 1)), lambda i: F.substring(upper, i, F.lit(size)))
    bits = lambda g: F.array(*[F.pmod(F.xxhash64(g, F.lit(k)), F.lit(GRAM_BITS)).cast("int") for k in range(hashes)])
    none = F.array().cast("array<int>")
    return F.when(F.length(upper) >= size, F.array_distinct(F.flatten(F.transform(grams, bits)))).otherwise(none)


def gram_blocks(items: DataFrame, order_col: str, name_col: str = "name", rows: int = BLOCK_ROWS) -> DataFrame:
    """block and a bitmap of the trigrams of its names. order_col: row numbers, of which `rows` make a block."""
    posted = items.select(F.floor(F.col(order_col) / rows).alias("block"), F.explode(gram_bits(F.col(name_col))).alias("bit"))
    return posted.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def blocks_with(blocks: DataFrame, text: str) -> DataFrame:
    """Blocks that may hold the text: all of its trigrams' bits are set. Shorter texts may be anywhere."""
    if len(text) < 3:
        return blocks.select("block")
    one = blocks.withColumn("__t", F.lit(text))
    byte = lambda b: F.conv(F.hex(F.substring("bits", F.floor(b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    held = F.forall(gram_bits(F.col("__t")), lambda b: F.getbit(byte(b), (b % 8).cast("int")) == 1)
    return one.where(held).select("block")


def literal_in_blocks(items: DataFrame, blocks: DataFrame, text: str, order_col: str, name_col: str = "name", rows: int = BLOCK_ROWS) -> DataFrame:
    """`literal`, looking only into blocks that may hold the text."""
    near_ = blocks_with(blocks, text)
    rows_ = items.withColumn("block", F.floor(F.col(order_col) / rows)).join(near_, "block", "left_semi")
    return literal(rows_, text, name_col).drop("block")


def word_bigrams(words: DataFrame) -> DataFrame:
    """(bigram, word) of a vocabulary: a substring's bigrams narrow the words that can hold it."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    return words.where(F.length("token") >= 2).select("token", F.explode(F.array_distinct(pairs)).alias("bigram"))


def words_holding(words: DataFrame, bigrams: DataFrame, part: str) -> DataFrame:
    """Words that contain the part, by way of its bigrams."""
    own = sorted({part[i : i + 2] for i in range(len(part) - 1)})
    if not own:
        return words.where(F.contains("token", F.lit(part)))
    met = bigrams.where(F.col("bigram").isin(own)).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") == len(own))
    return met.where(F.contains("token", F.lit(part))).select("token")


# A plain inverted index: a multiset of (token, path)


def index_add(index: DataFrame, items: DataFrame, tokens: Column, path_col: str = "full_path") -> DataFrame:
    return index.unionByName(items.select(F.explode(tokens).alias("token"), F.col(path_col).alias("path")))


def index_remove(index: DataFrame, paths: DataFrame, token: str | None = None) -> DataFrame:
    """Without the postings of some paths, of one token or of all."""
    gone = index.where(F.col("token") == token) if token is not None else index
    kept = index.where(F.col("token") != token) if token is not None else index.limit(0)
    return kept.unionByName(gone.join(paths.select("path").distinct(), "path", "left_anti").select(*index.columns))


def index_get(index: DataFrame, token: str, mode: str = "exact", most: int = 2) -> DataFrame:
    """Paths by token: the very one, those that contain it (letter case counts), or those near it."""
    test = {"exact": F.col("token") == token, "partial": F.contains("token", F.lit(token)), "fuzzy": near(F.col("token"), F.lit(token), most)}[mode]
    words = vocabulary(index).where(test)
    return index.join(words, "token", "left_semi").select("path").distinct()


def index_counts(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("token").alias("tokens"), F.countDistinct("path").alias("paths"), F.count("*").alias("postings"))


def near_words(words: DataFrame, word: str, most: int, limit: int = 64, distance=None) -> DataFrame:
    """Words of 3 to 64 bytes without a digit, by distance, then by the order in which they were first seen."""
    own = words.where(F.octet_length("word").between(3, 64) & ~F.rlike("word", F.lit("[0-9]")))
    d = distance(F.col("word"), F.lit(word)) if distance else F.levenshtein(F.col("word"), F.lit(word))
    return own.withColumn("distance", d).where(F.col("distance") <= most).orderBy("distance", "first_seen").limit(limit)


def literal(items: DataFrame, text: str, name_col: str = "name") -> DataFrame:
    """Names that contain the text, without regard to case; every score is 0. An empty text finds nothing."""
    found = items.where(F.contains(F.lower(name_col), F.lit(text.lower()))) if text.strip() else items.where(F.lit(False))
    return found.withColumn("score", F.lit(0.0))


def inspect(posted: DataFrame, items: DataFrame, tokens: list[str], id_col: str = "item_id") -> DataFrame:
    """Per token the number of items and the first three names."""
    named = exact(posted, tokens).join(items.select(id_col, "name"), id_col)
    return named.groupBy("token").agg(F.count("*").alias("matches"), F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("names"))


def overlay(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Base rows whose key the delta does not have, and the delta."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)
