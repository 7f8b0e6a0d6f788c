"""Each operator against a brute-force version on small tables, and on nulls, empty texts, repeats and empty tables."""

import base64
import hashlib
import math
import random
import struct
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from filigrane.llm import (
    decontaminate, language_id, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, queries, substring_dedup, token_records, url_filter,
)
from filigrane.llm.common import narrowed, remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int"
WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    a, b = prose(rng, 80), prose(rng, 300)
    near = b.split()
    near[150] = "changed"
    return [
        (None, None, None, None, None, 1),
        (1, "", "en", "a", 0, 2),
        (1, "", "en", "a", 0, 2),
        (2, "word " * 60, "en", "a", 1, 3),
        (3, a, None, None, 3, 4),
        (3, a, None, None, 3, 4),
        (4, a, None, "b", 3, 4),
        (5, b, "en", "b", 3, 4),
        (6, " ".join(near), "en", "ä", 3, None),
        (7, "one two", "de", "a", 3, None),
        (8, "   \n\t ", "de", "a", 3, None),
        (9, "Ünï 中文 ÇA va\n" * 30, "fr", "b", 3, None),
        (10, prose(rng, 3000), "fr", "b", 3, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_prefilter_keeps_all_wanted(spark):
    rows = spark.range(50_000).selectExpr("cast(id as string) as k")
    wanted = spark.range(0, 50_000, 97).selectExpr("cast(id as string) as k")
    got = {r["k"] for r in narrowed(rows, "k", wanted).collect()}
    assert {str(i) for i in range(0, 50_000, 97)} <= got and len(got) < 700


def test_remainder(spark):
    rows = spark.createDataFrame([(5,), (None,), (-3,)], "doc_id long").select("doc_id", remainder("doc_id", 7).alias("r")).collect()
    for r in rows:
        assert r["r"] == zlib.crc32(str("null" if r["doc_id"] is None else r["doc_id"]).encode()) % 7


# Quality rules


def plain_rules(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


def test_fertility_rules(docs, odd, texts):
    got = quality_rules.fertility_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(texts[r.doc_id])
    assert quality_rules.repeated(np.array([1, 1, 1, 1]), 2) == quality_rules.repeated(np.array([1, 1, 1, 1]), 1 << 22) == 4
    rows = quality_rules.fertility_rules(odd).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert not (r.kept and r.base_failed)
        assert r.kept in (True, False)  # the result replaces the input's column of that name
    whole = quality_rules.fertility_rules(odd, into="judged")
    assert [r.kept for r in sorted(whole.collect(), key=lambda r: r.doc_id or 0)][-1] is None


def test_fertility_measures(docs, texts):
    import public_tokenizers
    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    verdicts = Counter()
    for r in quality_rules.fertility_rules(docs).collect():
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        per_byte = sum(map(len, words)) / max(1, sum(len(byte.encode_ordinary(" " + w)) for w in words))
        assert r.byte_chars_per_token == pytest.approx(per_byte)
        least, least_byte, most, most_share, least_bits = quality_rules.BANDS[r.script]
        inside = least <= r.piece_chars_per_token <= most and least_byte <= per_byte <= most and r.byte_fallback_share <= most_share and r.token_entropy >= least_bits
        assert r.kept == (inside and not r.base_failed)
        counted = Counter(quality_rules.SCRIPTS[quality_rules.script_of(w)] for w in words)
        counted.pop("Other", None)
        assert counted[r.script] == max(counted.values()) if counted else r.script == "Other"
        verdicts[r.kept, r.base_failed] += 1
        ids = [i for w in words for i in piece.encode(w)]
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert r.piece_chars_per_token == pytest.approx(sum(map(len, words)) / len(ids))
        assert r.token_entropy == pytest.approx(-(share * np.log2(share)).sum())
        assert r.byte_fallback_share == pytest.approx(sum(piece.is_byte(i) for i in ids) / len(ids))
    assert verdicts[True, False] and verdicts[False, True]


# Near-duplicates


def plain_classes(texts, threshold=0.8):
    bags = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = sum((bags[a] & bags[b]).values())
            total = sum(bags[a].values()) + sum(bags[b].values()) - both
            if texts[a] == texts[b] or total and both / total >= threshold:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(docs, texts, odd):
    got = near_dedup.dedup_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    rows = near_dedup.dedup_classes(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {r.class_id for r in rows if r.doc_id in (3, 4)} == {3} and {r.class_id for r in rows if r.doc_id in (5, 6)} == {5}
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9, 10]


def test_chain_and_large_group_in_one_class(spark):
    rng = random.Random(2)
    base = prose(rng, 200).split()
    rows = []
    for i in range(700):  # each differs from the base in one word; any two are similar
        w = list(base)
        w[(i * 7) % 200] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, 100)) for i in range(50)]
    got = {r.doc_id: r.class_id for r in near_dedup.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(700)) and all(got[i] == i for i in range(1000, 1050))


def test_blocks_link_what_stars_miss(spark, monkeypatch):
    """With leaders that no member is like, members of one bucket are still compared in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(8)
    texts = {}
    for g in range(2):
        base = prose(rng, 120).split()
        for i in range(20):
            w = list(base)
            w[5 * i] = f"edit{i}"
            texts[2 * i + g] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("unhex(md5(cast(text as binary))) as key", "doc_id", "text")
    signed = near_dedup.sign(rows, 5, 25, 5)
    nodes = signed.selectExpr("doc_id as node", "key", "named_struct('doc_id', doc_id, 'n', 1L) as first", "transform(bands, b -> 7L) as bands", "sig")
    buckets = nodes.selectExpr("node", "7L as bucket")
    none = spark.createDataFrame([], "node long, class long")
    links = near_dedup.mixed_links(buckets, nodes, none, rows, 5, 0.8, 0.5)
    assert not any((r.a + r.b) % 2 for r in links.collect())
    classes = {r.node: r["class"] for r in near_dedup.components(links).collect()}
    assert classes == {i: i % 2 for i in range(2, 40)}


def test_signatures_rule_out_no_similar_pair(spark, monkeypatch):
    """A pair of just the threshold agrees in fewer coordinates than asked for with a chance far below that of banding."""
    asked = []
    compare = near_dedup.mixed_links
    monkeypatch.setattr(near_dedup, "mixed_links", lambda *a: asked.append(a[-1]) or compare(*a))
    near_dedup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string"))
    missed = sum(math.comb(125, i) * 0.8**i * 0.2 ** (125 - i) for i in range(126) if i / 125 < asked[0])
    assert missed < 5e-5 / 100


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for wa, wb in ((np.full(60, 1), np.repeat([1, 2], 30)), (rng.integers(1, 40, 60), rng.integers(1, 40, 60))):
        sig, full = near_dedup.signatures(np.concatenate([elements, elements]), np.concatenate([wa, wb]), np.repeat([0, 1], 60), 2, 2000)
        assert full.all() and (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.05)


# URL filter


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.COM/x", "https://example.com/en/1", "https://www.example.com/en/", "https://a.b.net/es/?q",
        "https://net/fr/x#y", "https://x.net/frx", "https://badexample.com/en/", "http://site.test/a", "http://x.org?u=http://y.net/es/", "http://com",
    ]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(rows).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.com", "/x", "com/", "allow") and got[5][2:] == ("example.com/en/", "block")
    assert got[6][2:] == ("www.example.com/en/", "allow") and got[7] == ("a.b.net", "/es/", "net/es/", "block")
    assert got[8][2:] == ("net/fr/", "block") and got[9][2:] == (None, "allow") and got[10][2:] == ("com/", "allow")
    assert got[11][2:] == (None, "block") and got[12] == ("x.org", "", None, "allow") and got[13] == ("com", "", None, "allow")
    assert url_filter.judge_urls(rows.limit(0)).count() == 0
    assert url_filter.judge_urls(rows, rules=(), listed=()).where("verdict = 'block'").count() == 0


def test_listed_hosts_come_from_the_cascade(spark):
    """Thousands of listed hosts among as many others; nothing but the cascades tells them apart."""
    urls = [(i, f"https://h{i}.{'poker-' if i % 3 == 0 else ''}site{i % 11}.org/p?x") for i in range(6000)] + [(-1, "https://sub.a.test/"), (-2, "https://spoker.org/"), (-1, "https://sub.a.test/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    hosts = url_filter.spam_hosts(pages)
    assert hosts.count() == 2000
    got = url_filter.judge_urls(pages, listed=hosts.union(spark.createDataFrame([("test/",)], "k string"))).collect()
    assert len(got) == len(urls) and sum(r.page_id == -1 for r in got) == 2
    for r in got:
        assert (r.verdict, r.rule) == ("block" if r.page_id == -1 or r.page_id >= 0 and r.page_id % 3 == 0 else "allow", None)
    both = url_filter.judge_urls(pages, rules=(("block", "org/"), ("allow", "h1.site1.org/")), listed=hosts).collect()
    assert all(r.rule == ("h1.site1.org/" if r.page_id == 1 else None if r.page_id == -1 else "org/") for r in both)


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("xxhash64(cast(id as string)) as h1", "xxhash64(cast(id as string), 'second') as h2")
    cascades = url_filter.build_cascades(universe, {"a": [str(i) for i in range(0, 20_000, 50)], "b": [str(i) for i in range(0, 20_000, 7)], "none": []})
    assert len(cascades["a"].levels) > 1 and not cascades["none"].levels
    keys = universe.toPandas()
    for name, n in (("a", 50), ("b", 7)):
        member = cascades[name].member(*(keys[c].to_numpy().view(np.uint64) for c in ("h1", "h2")))
        assert member.tolist() == [i % n == 0 for i in range(20_000)]
    with pytest.raises(ValueError):
        url_filter.MAX_KEYS, old = 3, url_filter.MAX_KEYS
        try:
            url_filter.build_cascades(universe, {"a": ["a", "b", "c", "d"]})
        finally:
            url_filter.MAX_KEYS = old


# Classifiers


def test_quality_classifier(docs, odd, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.learn_quality(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score_quality(docs, model).collect()}
    right = [got[r.doc_id].predicted == r.quality for r in labels.collect()]
    assert sum(right) / len(right) > 0.95
    rows = quality_classifier.score_quality(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.learn_quality(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(odd, none).collect()} == {0.5}
    one = quality_classifier.learn_quality(docs, labels.where("quality = 1"))
    assert {r.score for r in quality_classifier.score_quality(odd, one).collect()} == {1.0}
    assert quality_classifier.score_quality(odd.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in queries.op1_subword_embeddings(spark, d).collect() if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in got) >= 0.95 * len(got)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = [r for r in queries.op5_output_codes(spark, d).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)


def test_language_id(spark, docs, odd):
    model = language_id.learn_languages(docs)
    rows = {r.doc_id: r for r in language_id.identify_languages(odd, model).collect()}
    assert [rows[i].lang_pred for i in (None, 1, 8)] == ["und"] * 3 and rows[1].score == 0
    assert rows[10].lang_pred in model.langs
    none = language_id.learn_languages(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify_languages(odd, none).collect()} == {"und"}
    one = language_id.learn_languages(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify_languages(odd, one).collect()} == {"und", "en"}
    for n in (2, 3, 6, 7, 20):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n and (np.abs(code.sum(0)) < n).all()
        assert len({tuple(b * b[0]) for b in code.T}) == code.shape[1]  # no two bits divide the languages alike
    assert language_id.codewords(7).shape == (7, 54)
    marks = spark.createDataFrame([("½ ²",), ("① Ⅷ",), ("12 _",), ("ª",), ("中",)], "text string")
    assert [r.lang_pred == "und" for r in language_id.identify_languages(marks, model).collect()] == [True, True, True, False, False]
    with pytest.raises(ValueError):
        language_id.learn_languages(spark.range(2000).selectExpr("id as doc_id", "'x' as text", "cast(id as string) as lang"))


def plain_hashes(word, orders, buckets, whole):
    """Buckets of the features of one word, a character at a time."""
    mask = (1 << 64) - 1
    slot = lambda h: (((h * 0x9E3779B97F4A7C15) & mask) >> 24) % (buckets - 1) + 1
    out = [slot(zlib.crc32(word.encode()))] if whole else []
    marked = f"<{word}>"
    for n in orders:
        for i in range(len(marked) - n + 1):
            h = n
            for c in marked[i : i + n]:
                h = ((h ^ ord(c)) * 0xFF51AFD7ED558CCD) & mask
                h ^= h >> 29
            out.append(slot(h))
    return out


def test_quality_scores_against_a_plain_scorer(docs, texts, spark, sf_dir):
    """Mean of the learned vectors of all features of a text, then the softmax of the output layer."""
    model = quality_classifier.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sample = {i: t for i, t in texts.items() if len(t) < 2500} | {-1: "", -2: "a a a b", -3: "Ünï 中文"}
    own = spark.createDataFrame(list(sample.items()), "doc_id long, text string")
    for r in quality_classifier.score_quality(own, model).collect():
        words = [w.decode() for w in r.text.encode().split()]
        found = [s for w in words for s in plain_hashes(w, quality_classifier.ORDERS, quality_classifier.BUCKETS, True)]
        found += [0 for a, b in zip(words, words[1:], strict=False) if a == b]
        mean = np.mean([model.table[s].astype(float) for s in found], 0) if found else np.zeros(quality_classifier.DIM)
        z = np.exp(mean @ model.out + model.bias)
        assert r.score == pytest.approx(z[model.classes.index(1)] / z.sum()) and r.predicted == (r.score >= 0.5)


def test_languages_against_a_plain_decoder(docs, texts, spark):
    """Each bit's margin from the mean of the features, then the loss of each codeword."""
    model = language_id.learn_languages(docs)
    sample = {i: t for i, t in texts.items() if len(t) < 1200}
    own = spark.createDataFrame(list(sample.items()), "doc_id long, text string")
    for r in language_id.identify_languages(own, model).collect():
        words = [w.decode() for w in r.text.lower().encode().split()]
        found = [s for w in words for s in plain_hashes(w, language_id.ORDERS, language_id.BUCKETS, False)]
        margin = np.mean([model.table[s].astype(float) for s in found], 0) + model.bias
        loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margin, code, strict=True)) * 4 / len(code) for code in model.code]
        shares = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        best = int(np.argmax(shares))
        assert r.lang_pred == model.langs[best] and r.score == pytest.approx(shares[best])
        assert r.ambiguous == (shares[best] - sorted(shares)[-2] < language_id.AMBIGUOUS)


def test_repeated_ids_are_learned_once(docs, spark):
    """The sample does not depend on how often or in which order rows come."""
    some = docs.where("lang is not null")
    models = [language_id.learn_languages(x) for x in (some, some.union(some).repartition(5))]
    assert (models[0].table == models[1].table).all()


# Language model


def test_lm_scores(docs, texts, odd):
    sample = {i: t for i, t in texts.items() if len(t) < 1500}
    own = docs.where("length(text) < 1500").select("doc_id", "text")
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in sample}
    counts = Counter()
    tries = [{} for _ in range(4)]
    for i, t in sample.items():
        if train[i]:
            counts.update([*t.encode().lower().split(), None])
            b = b"\xff" * 3 + t.encode() + b"\xff"
            for j in range(3, len(b)):
                for k in range(4):
                    tries[k].setdefault(b[j - k : j], Counter())[b[j]] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_scoring.score_texts(own, remainder("doc_id", 7) != 2).collect()}
    for i, t in list(sample.items())[:60]:
        words = [*t.encode().lower().split(), None]
        assert got[i].base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        b, score = b"\xff" * 3 + t.encode() + b"\xff", 0.0
        for j in range(3, len(b)):
            gone = set()
            for k in (3, 2, 1, 0):
                left = {s: c for s, c in tries[k].get(b[j - k : j], {}).items() if s not in gone}
                if left:
                    total = sum(left.values()) + len(left)
                    if b[j] in left:
                        score += np.log10(left[b[j]] / total)
                        break
                    score += np.log10(len(left) / total)
                gone |= tries[k].get(b[j - k : j], {}).keys()
            else:
                score -= np.log10(max(1, 256 - len(gone)))
        assert got[i].score == pytest.approx(score)
    other = {r.doc_id: r for r in lm_scoring.score_texts(own, remainder("doc_id", 7) != 2, max_nodes=10, frequent=20).collect()}
    assert all(other[i].score == pytest.approx(got[i].score) and other[i].base_score == pytest.approx(got[i].base_score) for i in sample)
    rows = lm_scoring.score_texts(odd, remainder("doc_id", 7) != 2).collect()
    assert len(rows) == len(odd_rows())
    assert lm_scoring.score_texts(odd, remainder("doc_id", 7) < 0).where("base_score <> 0").count() == 0


def test_adaptive_model_learns_within_a_text():
    assert lm_scoring.adaptive_score(b"") == pytest.approx(-np.log10(256))
    assert lm_scoring.adaptive_score(b"abcabcabcabc") > lm_scoring.adaptive_score(b"qwertzuiopas")


# Decontamination


def plain_words(t):
    return bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in (t or "").encode()).split()


def plain_hits(text, items):
    words = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        own = plain_words(t)
        m = min(13, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == own[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(item) if item is not None else "null")
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_wu_manber(spark, docs, texts, sf_dir, odd):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    short = [(900, "w1 wb1"), (901, "ONE, two!"), (902, None), (903, "..."), (None, "one"), (905, "zz " * 20)]
    extra = {10_000: "a b zz zz zz zz zz zz zz zz zz zz zz zz zz zz zz", 10_001: items[0][1], 10_002: "x " * 400 + items[1][1] + " y" * 400, 10_003: "one two one"}
    some = {i: texts[i] for i in list(texts)[:60]} | extra
    rows = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    both = bench.select("item_id", "text").union(spark.createDataFrame(short, "item_id long, text string"))
    for size in (10**6, 200):
        got = decontaminate.decontaminate(rows, both, block_words=size).collect()
        assert len(got) == len(some)
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain_hits(some[r.doc_id], items + short), (size, r.doc_id)
        assert len(decontaminate.decontaminate(odd, both, block_words=size).collect()) == len(odd_rows())
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(odd, both)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 3, 4, 5, 6, 8, 9, 10]


# Repeated substrings


def plain_repeats(rows, length):
    data = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        m = np.cumsum(hit)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "slice_bits"), [(20_000, 64), (1, 64), (20_000, 3), (1, 3)])
def test_suffix_sort(spark, hot, slice_bits):
    """Whatever the way of hot anchors, and with slice hashes so short that they collide."""
    rng = random.Random(9)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = [t for _, t, *_ in odd_rows()]
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
            parts += [s[a:b], prose(rng, rng.randint(0, 5))]
        rows.append(" ".join(parts))
    rows += ["ab" * 300, "x" * 199, "x" * 200, "é" * 150 + "q", "z" * 450 + "y" + "z" * 450]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(table, hot=hot, slice_bits=slice_bits).collect()}
    want = plain_repeats(rows, 200)
    assert [got[i] for i in range(len(rows))] == want
    assert substring_dedup.remove_repeats(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.anchor_rows(table, 400, 50)


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 500)
    rng = random.Random(3)
    text = prose(rng, 900).encode()
    parts, owner, offset = substring_dedup.segments_of([text], 200)
    lo, more = [], []
    for p, o in zip(parts, offset, strict=True):
        seg, first, m, off, h, sh = substring_dedup.anchors([p], 200, 50)
        lo += (first + o).tolist()
        more += m.tolist()
    covered = sorted(s for a, m in zip(lo, more, strict=True) for s in range(a, a + m + 1))
    assert covered == list(range(len(text) - 199))


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    at, segment = np.arange(300), np.arange(300) % 7
    order = substring_dedup.suffix_sort(data, substring_dedup.Hashes(data), at, segment, 100)
    assert order.tolist() == sorted(range(300), key=lambda i: (segment[i], data[i : i + 100].tobytes(), i))


# Token records


def test_token_records(spark, docs, texts, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    manifest = token_records.write_records(docs, part_bytes=100_000, file_bytes=30_000)
    assert manifest.count() > 10 and max(r.n_bytes for r in manifest.where("n_records > 1").collect()) <= 30_000
    path = manifest.head().path
    got = token_records.read_records(spark, path, manifest, ids=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    at = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.ids == ids and r.start == at and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    again = token_records.read_records(spark, path).collect()  # the sizes from the index files
    assert {(r.doc_id, r.start) for r in again} == {(r.doc_id, r.start) for r in got}
    store, folder = token_records.file_system(path)
    one = next(r for r in got if r.offset > 0)
    with store.open_input_file(f"{folder}/{one.file}") as f:

        def read(offset, size):
            f.seek(offset)
            return f.read(size)

        assert token_records.record_at(read, one.offset)[1].tolist() == one.ids
    manifest = token_records.write_records(odd)
    rows = token_records.read_records(spark, manifest.head().path, manifest).collect()
    assert len(rows) == len(odd_rows()) and [r.doc_id for r in sorted(rows, key=lambda r: r.start)][:3] == [None, 1, 1]
    assert token_records.write_records(odd.limit(0)).count() == 0 and token_records.records_of(odd.limit(0)).count() == 0
    assert token_records.records_of(odd, public_tokenizers.path("byte_bpe_50k.json")).agg({"n_tokens": "sum"}).head()[0] == sum(
        len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in odd_rows()
    )


def encodes_alike(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_records.Encoder(path)
    assert encoder.by_words
    for i in range(0, len(texts), 20_000):
        some = texts[i : i + 20_000]
        want = tokenizer.encode_batch(some, add_special_tokens=False)
        for text, own, ids in zip(some, want, encoder.encode([t.encode() for t in some], 1), strict=True):
            assert ids.tolist() == own.ids + [1], ascii(text)


def test_words_and_texts_encode_alike():
    rng = random.Random(1)
    alphabet = "aB9'’.,!?-—é\u0301Σςσİı<|> \n\t 中½²«»ß,,..\x1c"
    odd = ["It's, BOYS', o'clock. «Été», <|endoftext|> <|ENDOFTEXT|>, a<|endoftext|>. ΟΔΟΣ, İstanbul.", "x\x85y, ﻿, Ⅷ, क्षि, 'S, don'T"]
    odd += [f"x{c}{mark} y" for c in "\u0958\u095b\u095c\u095d\u095e\u09dc\u0a5e\ufb2a\ufb47" for mark in token_records.PUNCTUATION.decode()]
    # Letters with a composed form in one case only, with marks in and out of canonical order.
    odd += [f"{a}{m}{n}, {a}{m}" for a in "HTWYJhtwyjAIK" for m in "\u0331\u0308\u030a\u030c\u0307" for n in ("", "\u0323", "\u1dc4\u0331")]
    encodes_alike(odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(1500)])


def test_every_character_encodes_alike_before_punctuation():
    marks = token_records.PUNCTUATION.decode()
    points = [c for c in map(chr, range(0x20, 0x30000)) if c.isalpha() or c.isnumeric() or unicodedata.combining(c) or ord(c) < 0x2100]
    encodes_alike([f"a{c}{marks[i % len(marks)]} {c}{marks[(i + 7) % len(marks)]}'s H{c}," for i, c in enumerate(points)])
    # Characters of many scripts in any order.
    rng = random.Random(2)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xE00), (0xE00, 0xE80), (0x1100, 0x1200), (0x1E00, 0x2000), (0x3040, 0x3100), (0xAC00, 0xAE00), (0xFB00, 0xFB50)]
    encodes_alike(["".join(chr(rng.randrange(*rng.choice(ranges[:1] * 4 + ranges))) for _ in range(rng.randint(1, 12))) for _ in range(100_000)])


def test_damage_is_noticed():
    good = token_records.frame(token_records.payload_of(7, np.array([1, 2, 3]), 2)) * 3
    assert [(i, ids.tolist()) for _, i, ids in token_records.records(good)] == [(7, [1, 2, 3])] * 3
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(token_records.records(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_records.records(good[:-1]))


# Mixing


def test_targets():
    t = mixing.targets_of({"a": 100, "b": 100, None: 1})
    assert t[None] == 3 and t["a"] == Fraction(198, 3) and t["b"] == Fraction(2 * 198, 3)
    assert mixing.targets_of({}) == {} and mixing.targets_of({"a": 0}) == {"a": 0}


def test_fit_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        budget = rng.randint(0, int((lengths * counts).sum()) + 3)
        take = mixing.knapsack(lengths, counts, min(budget, int((lengths * counts).sum())))
        assert (take <= counts).all() and abs((take * lengths).sum() - budget) == min(abs(s - budget) for s in sums)
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and abs((take * lengths).sum() - budget) <= 30


def test_mix(spark, docs, odd, texts):
    got = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs.repartition(3)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(texts)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r.size == len(texts[r.doc_id].encode().split()) and r.taken <= 3 * r.size and r.taken == r.times * r.size
        s = source[r.doc_id]
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
    want = mixing.targets_of(dict(size))
    for s in size:
        assert target[s] == pytest.approx(float(want[s])) and abs(taken[s] - target[s]) <= 60
    rows = mixing.mix(odd)
    assert rows.columns == odd.columns
    plan = mixing.mix_plan(odd).collect()
    assert Counter(r.doc_id for r in rows.collect()) == +sum((Counter({r.doc_id: r.times}) for r in plan), Counter())
    assert mixing.mix_plan(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def test_equal_rows_in_the_mix(spark):
    """A third of all rows equal in all columns, more equal in id and text only, over several stretches of rows."""
    rng = random.Random(6)
    hot = prose(rng, 12)
    rows = [(7, hot, "a", 0)] * 400 + [(8, hot, "a", i) for i in range(300)] + [(100 + i, prose(rng, rng.randint(1, 30)), rng.choice("ab"), i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x int")
    for budget in (None, 700, 9000):
        plan = mixing.mix_plan(df, budget=budget).collect()
        again = mixing.mix_plan(df.repartition(7), budget=budget).collect()
        assert sorted(plan) == sorted(again) and len(plan) == len(rows)
        taken, target = Counter(), {}
        source = {r[0]: r[2] for r in rows}
        for r in plan:
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
        assert all(abs(taken[s] - target[s]) <= 1 for s in "ab")
        got = Counter(r.doc_id for r in mixing.mix(df, budget=budget).collect())
        assert got == +sum((Counter({r.doc_id: r.times}) for r in plan), Counter())


def test_stretches_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SALT", 2)
    monkeypatch.setattr(mixing, "CHUNK", 5)
    df = spark.createDataFrame([(7, "a b c", "s")] * 50, "doc_id long, text string, source string")
    plan = mixing.mix_plan(df, budget=91).collect()
    assert Counter(r.times for r in plan) == {1: 30, 0: 20}
    assert mixing.mix(df, budget=91).count() == 30 and mixing.mix(df, budget=3 * 127).count() == 127


def test_clashing_names(spark, docs, sf_dir):
    """Results replace columns of their name in any letter case; operators that filter keep all columns as they are."""
    rng = random.Random(12)
    names = ["doc_id", "text", "source", "KEPT", "Score", "row", "key", "id", "n", "hash", "text_key", "__text_key", "__row_key", "__bucket", "__salt", "k0", "__runs", "n_words", "Contaminated", "size"]
    rows = [(i, prose(rng, 80), "s", *[f"{i}-{c}" for c in names[3:]]) for i in range(6)]
    rows += [rows[0], rows[0], (6, rows[1][1], *rows[1][2:])]
    df = spark.createDataFrame(rows, names)
    bench = spark.createDataFrame([(1, " ".join(rows[2][1].split()[:40])), (2, "zz " * 30), (3, prose(rng, 50))], "item_id long, text string")
    small = lambda c: [x.lower() for x in c]
    ruled = quality_rules.fertility_rules(df)
    assert len(set(small(ruled.columns))) == len(ruled.columns) and ruled.where("kept IS NOT NULL").count() == len(rows)
    model = quality_classifier.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert quality_classifier.score_quality(df, model).where("score >= 0").count() == len(rows)
    for size in (10**6, 30):
        found = decontaminate.decontaminate(df, bench, block_words=size)
        assert [r.doc_id for r in found.where("contaminated").collect()] == [2] and len(set(small(found.columns))) == len(found.columns)
        clean = decontaminate.drop_contaminated(df, bench, block_words=size)
        assert clean.columns == names and clean.count() == len(rows) - 1
    single = near_dedup.drop_near_duplicates(df)
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == list(range(6))
    assert all(r.KEPT == f"{r.doc_id}-KEPT" for r in single.collect())
    mixed = mixing.mix(df)
    assert mixed.columns == names and mixed.count() == len(rows)
    assert token_records.records_of(df).count() == len(rows) == substring_dedup.remove_repeats(df).count()


def test_very_long_texts(spark, docs, sf_dir):
    """Texts of 5 MB, one of a single word, and a passage that both share."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(13)
    passage = prose(rng, 100)
    words = [f"v{rng.randrange(10**6)}" for _ in range(640_000)]
    long = " ".join([*words[:300_000], passage, *words[300_000:]])
    rows = [(1, long), (2, "x" * 5_000_000), (3, prose(rng, 30) + " " + passage), (4, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 5_000_000
    ruled = {r.doc_id: r for r in quality_rules.fertility_rules(df).collect()}
    assert ruled[1].n_words == len(long.split()) and ruled[2].word_chars == 5_000_000 and ruled[2].base_failed
    assert {r.doc_id: r.class_id for r in near_dedup.dedup_classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    found = {r.doc_id: r for r in decontaminate.decontaminate(df, spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()}
    assert [found[i].n_hit for i in (1, 2, 3)] == [100, 0, 100] and found[3].contaminated and not found[1].contaminated
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert cut[1].n_removed == len(long) and cut[2].n_removed == 5_000_000 and cut[4].n_removed >= len(long) and cut[3].n_removed >= len(passage)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in token_records.records_of(df).collect()}
    assert got[3] == len(tokenizer.encode(rows[2][1], add_special_tokens=False).ids) + 1 and got[4] == got[1] + len(tokenizer.encode("end", add_special_tokens=False).ids)
    scored = {r.doc_id: r for r in lm_scoring.score_texts(df, remainder("doc_id", 7) >= 0).collect()}
    assert scored[1].n_tokens == len(long.split()) + 1 and scored[1].score < scored[3].score < 0
    assert [r.lang_pred != "und" for r in language_id.identify_languages(df, language_id.learn_languages(docs)).collect()] == [True] * 4
