"""URL filters by a Bloom filter cascade.

Rules and listed hosts are keys: a host and the beginning of a path, as `net/es/`. A url has as many candidate keys as
its host has suffixes at label borders, times the path lengths that occur in the keys. The universe is every candidate
key of every url in the corpus. Level 1 of a cascade is a Bloom filter of the listed keys; level 2 encodes the keys of
the universe that level 1 takes by mistake, level 3 those listed keys that level 2 takes by mistake, and so on until no
mistake is left. A key belongs to the list if the first level that rejects it is an even one, or if none does and the
number of levels is odd. So membership is exact for the whole corpus, without a join and without shipping the urls.

There is one cascade for each class of keys: rules that allow, rules that block, listed keys. What a url's keys are is
read from the cascades alone; nothing else corrects them.

Listed are special-use names and, from the corpus itself, every host with a label of which a part between hyphens is one
of `SPAM_PARTS` (`spam_hosts`). Each class is held by the driver and must not exceed `MAX_KEYS` (checked before it is
fetched). Level 1's error rate is set from the universe's size so that its mistakes are about as many as the listed keys;
every level is therefore bounded by the class and is broadcast. The universe's distinct keys are written once as two
64-bit hashes and read twice, to count them and to find the mistakes of all first levels; mistakes shrink by a constant
factor from level to level.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; an empty class fits
nothing; a key that both allows and blocks blocks; repeated urls get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import map_arrow, materialize

#: (verdict, key); a key is a host, then a path's beginning.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Special-use names that no public page can have; a url below them is blocked where no rule fits.
LISTED = ("localhost/", "local/", "invalid/", "test/", "onion/", "internal/")
#: Parts of labels that tell hosts of spam.
SPAM_PARTS = (
    "adult", "bet", "betting", "casino", "dating", "escort", "gambling", "jackpot", "loan", "loans", "lottery", "payday",
    "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "viagra", "webcam", "xxx",
)
MAX_KEYS = 4_000_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_key(key: str) -> tuple[str, str]:
    host, slash, path = key.partition("/")
    return host, slash + path


def spam_hosts(pages: DataFrame, url_col: str = "url", parts=SPAM_PARTS) -> DataFrame:
    """Keys of all hosts that have a label with one of the parts between hyphens."""
    host = host_of(F.col(f"`{url_col}`"))
    hit = F.rlike(host, F.lit("(^|[.-])(" + "|".join(parts) + ")([.-]|$)"))
    return pages.where(hit).select(F.concat(host, F.lit("/")).alias("k")).distinct()


def keys_of(listed: DataFrame) -> list[str]:
    """A list of keys, if it is within the bound."""
    n = listed.count()
    if n > MAX_KEYS:
        raise ValueError(f"{n} listed keys; the cascade's filters are broadcast, so at most {MAX_KEYS}")
    return [r["k"] for r in listed.collect()]


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys of a url that could be listed, as strings of host suffix and path beginning."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in path_lengths])
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    )


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Bloom:
    bits: np.ndarray
    n_hashes: int
    level: int  # each level hashes in its own way: what two levels take by mistake must not be the same

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, rate: float, level: int) -> Bloom:
        n = max(1, len(h1))
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        out = cls(np.zeros((size + 7) // 8, np.uint8), min(30, max(1, round(size / n * math.log(2)))), level)
        for at in out.places(h1, h2):
            np.bitwise_or.at(out.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    def places(self, h1: np.ndarray, h2: np.ndarray):
        size = np.uint64(len(self.bits) * 8)
        h1 = scramble(h1 + np.uint64(self.level * 0x9E3779B97F4A7C15 % (1 << 64)) + h2)
        h2 = scramble(h2 ^ h1)
        for i in range(self.n_hashes):
            yield (h1 + np.uint64(i) * (h2 | np.uint64(1))) % size

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self.places(h1, h2):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


@dataclass
class Cascade:
    levels: list[Bloom]

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for k, level in enumerate(self.levels):
            held = level.holds(h1[open_], h2[open_])
            out[open_[~held]] = k % 2 == 1  # level 1 (k = 0) rejects: not listed
            open_ = open_[held]
        return out


def hashes(keys: Column) -> tuple[Column, Column]:
    return F.xxhash64(keys), F.xxhash64(keys, F.lit("second"))


def pairs(keys: list[str], spark) -> np.ndarray:
    """The two hashes of each key, as Spark computes them."""
    frame = spark.createDataFrame(pd.DataFrame({"k": sorted(set(keys))}, dtype=object), "k string")
    found = frame.select(*[h.alias(n) for h, n in zip(hashes(F.col("k")), ("h1", "h2"), strict=True)]).toPandas()
    return found.to_numpy().astype(np.int64).reshape(-1, 2).view(np.uint64)


def whole(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Both hashes as one value to compare."""
    both = np.empty(len(h1), [("a", np.uint64), ("b", np.uint64)])
    both["a"], both["b"] = h1, h2
    return both


def build_cascades(universe: DataFrame, classes: dict[str, list[str]]) -> dict[str, Cascade]:
    """A cascade for each class. universe: distinct hashes h1, h2 of all keys that will ever be asked for."""
    for name, keys in classes.items():
        if len(set(keys)) > MAX_KEYS:
            raise ValueError(f"{len(set(keys))} keys in {name}; the cascade's filters are broadcast, so at most {MAX_KEYS}")
    own = {name: pairs(keys, universe.sparkSession) for name, keys in classes.items() if keys}
    n = max(1, universe.count()) if own else 1
    firsts = {name: Bloom.of(k[:, 0], k[:, 1], min(0.5, max(1e-6, len(k) / n)), 1) for name, k in own.items()}
    wrong = mistakes(universe, firsts, own)
    return {name: cascade(firsts[name], own[name], wrong[name]) if name in own else Cascade([]) for name in classes}


def cascade(first: Bloom, own: np.ndarray, wrong: tuple[np.ndarray, np.ndarray]) -> Cascade:
    """All levels, from the first one and the keys that it takes by mistake."""
    levels, mine = [first], (own[:, 0], own[:, 1])
    while len(wrong[0]):
        levels.append(Bloom.of(*wrong, 0.5, len(levels) + 1))
        held = levels[-1].holds(*mine)
        mine = (mine[0][held], mine[1][held])
        if not len(mine[0]):
            break
        levels.append(Bloom.of(*mine, 0.5, len(levels) + 1))
        held = levels[-1].holds(*wrong)
        wrong = (wrong[0][held], wrong[1][held])
    return Cascade(levels)


def mistakes(universe: DataFrame, firsts: dict[str, Bloom], own: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each class the keys of the universe that its first level takes though they aren't in it: about as many as are
    in it."""
    if not firsts:
        return {}
    sent = universe.sparkSession.sparkContext.broadcast((firsts, {name: np.sort(whole(k[:, 0], k[:, 1])) for name, k in own.items()}))

    def run(frames):
        blooms, known = sent.value
        for pdf in frames:
            h1, h2 = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
            for name, bloom in blooms.items():
                held = np.flatnonzero(bloom.holds(h1, h2))
                asked = whole(h1[held], h2[held])
                at = np.minimum(np.searchsorted(known[name], asked), len(known[name]) - 1)
                fresh = held[known[name][at] != asked]
                yield pd.DataFrame({"name": name, "h1": pdf["h1"].to_numpy()[fresh], "h2": pdf["h2"].to_numpy()[fresh]})

    found = universe.mapInPandas(run, "name string, h1 long, h2 long").toPandas()
    out = {}
    for name in firsts:
        mine = found[found["name"] == name]
        out[name] = tuple(mine[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
    return out


def judge_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    listed=LISTED,
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule, verdict and listed (the key of the list that the url was found by, where no rule fits).

    listed: keys, or a table of keys (k)."""
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    verdict_of = {key: verdict for verdict, key in rules}
    listed = keys_of(listed) if isinstance(listed, DataFrame) else list(listed)
    classes = {"allow": [k for k, v in verdict_of.items() if v == "allow"], "block": [k for k, v in verdict_of.items() if v == "block"], "listed": listed}
    lengths = sorted({len(split_key(k)[1]) for keys in classes.values() for k in keys})
    rows = rows.withColumn("__keys", candidates(F.col("host"), F.col("path"), lengths))
    # The universe: candidate keys with duplicates removed before the shuffle.
    universe = rows.select(F.explode("__keys").alias("k")).select(*[h.alias(n) for h, n in zip(hashes(F.col("k")), ("h1", "h2"), strict=True)]).distinct()
    sent = pages.sparkSession.sparkContext.broadcast(build_cascades(materialize(universe, "universe"), classes))
    hashed = [F.transform("__keys", lambda k: F.xxhash64(k)).alias("__h1"), F.transform("__keys", lambda k: F.xxhash64(k, F.lit("second"))).alias("__h2")]
    kind = rows.schema["page_id"].dataType.simpleString()
    other = "block" if default == "allow" else "allow"

    def run(batches):
        cascades = {name: own for name, own in sent.value.items() if own.levels}
        for batch in batches:
            n = batch.num_rows
            keys = batch.column("__keys")
            flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("__h1", "__h2")]
            owner = np.repeat(np.arange(n), pc.list_value_length(keys).to_numpy(zero_copy_only=False))
            best: dict = {name: [None] * n for name in classes}
            for name, own in cascades.items():
                hits = np.flatnonzero(own.member(*flat))
                for row, key in zip(owner[hits].tolist(), keys.flatten().take(pa.array(hits)).to_pylist(), strict=True):
                    # By length, then by code point; at most one key of a length and path fits a host, so ties need equal lengths.
                    best[name][row] = max(filter(None, (best[name][row], key)), key=lambda k: (len(k), k))
            rule, verdict = [], []
            for allow, block, listed_by in zip(best["allow"], best["block"], best["listed"], strict=True):
                own = max(filter(None, (allow, block)), key=lambda k: (len(k), k), default=None)
                rule.append(own)
                verdict.append("block" if own and own == block else "allow" if own else other if listed_by else default)
            found = [pa.array(x, pa.string()) for x in (rule, verdict, best["listed"])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), *found], names=["page_id", "host", "path", "rule", "verdict", "listed"])

    return map_arrow(rows.select("page_id", "host", "path", "__keys", *hashed), run, f"page_id {kind}, host string, path string, rule string, verdict string, listed string")
