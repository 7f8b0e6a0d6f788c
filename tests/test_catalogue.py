"""Every catalogue query against its SQL, and the rules that SQL does not show against plain Python."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from filigrane.functions import kinds, text
from filigrane.operators import changes, links, live, metrics, profile, rename, retrieval, search, tree, views
from filigrane.plans import catalogue, intent, workload  # noqa: F401  (registers more queries)


@pytest.fixture(scope="module")
def db(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows_of(frame):
    names = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, db, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.ORACLE:
        assert rows_of(got) == rows_of(db.execute(catalogue.ORACLE[name]).df())
    else:
        assert len(got)


# Texts


def test_tokens_and_folding():
    assert text.tokens_of("Budget-Report_final (2).PDF") == ["budget", "report", "final", "2", "pdf"]
    assert text.tokens_of("Işık.txt") == ["ışık", "isik", "txt"] and text.tokens_of("İstanbul") == ["istanbul"]
    assert text.tokens_of("görüşme") == ["görüşme", "gorusme"] and text.tokens_of("a a") == ["a", "a"] and text.tokens_of(None) == []
    assert [text.fold_text(x) for x in ("çiğdem", "ızmır", "plain")] == ["cigdem", "izmir", "plain"]
    assert text.upper_text("straße ı") == "STRAßE ı"


def test_native_tokens_equal_the_general_ones(spark):
    rng = random.Random(1729)
    names = ["".join(rng.choice("abz09 _-.,[]()") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for r in df.select("name", text.tokenize_ascii(F.col("name")).alias("a"), text.tokenize("name").alias("b")).collect():
        assert r.a == r.b == text.tokens_of(r.name)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a/b/c.tar.gz", "ßa", "a"), (".gitignore", "x", "x"), ("line.", "", "a")], "p string, x string, y string")
    got = df.select(text.extension(F.col("p")).alias("e"), text.stem(F.col("p")).alias("s"), text.parent_path(F.col("p")).alias("d"), text.byte_distance(F.col("x"), F.col("y")).alias("n"), text.near(F.col("x"), F.col("y"), 2).alias("near"),
                    text.in_scope(F.col("p"), F.lit("a/b")).alias("in")).collect()
    assert [tuple(r) for r in got] == [(".gz", "a/b/c.tar", "a/b", 2, True, True), (".gitignore", "", None, 0, True, False), ("", "line", None, 1, False, False)]


def test_kinds():
    assert kinds.type_extensions("PDF") == [".pdf"] and ".heic" in kinds.category_extensions("image") and ".sql" in kinds.category_extensions("code")
    assert kinds.toggled(frozenset({"a"}), "a") == frozenset() and kinds.folder_synonyms("Downloads") == ["downloads", "indirilenler", "download"]


# Views and search


def test_item_filter_bounds(spark):
    mib = 1 << 20
    rows = [(i, f"f{i}.txt", False, s) for i, s in enumerate((1024, mib - 1, mib, 100 * mib, 100 * mib + 1, None))] + [(9, "dir", True, None)]
    df = spark.createDataFrame(rows, "id int, name string, is_dir boolean, size_bytes long").withColumn("modified", F.lit(None).cast("timestamp"))
    got = {s: sorted(r.id for r in df.where(views.ItemFilter(size=s).column(F.current_timestamp())).collect()) for s in ("small", "medium", "large")}
    assert got == {"small": [0, 1, 9], "medium": [2, 3, 9], "large": [4, 9]}
    assert [r.id for r in df.where(views.ItemFilter(kind="folders").column(F.current_timestamp())).collect()] == [9]
    assert df.where(views.ItemFilter(date="week").column(F.current_timestamp())).count() == 1


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, name string, full_path string, is_dir boolean, size_bytes long, open_count int, parent_path string")


def test_golden_scores(spark):
    df = items(spark, [(1, "budget-report.txt", "d/budget-report.txt", False, 1, 3, "d"), (2, "budget-report-final.txt", "d/budget-report-final.txt", False, 1, 0, "d")])
    got = search.standard_search(df, text.tokens_of("budget-report.txt"), "budget-report.txt").collect()
    assert [r.item_id for r in got] == [1, 2] and got[0].score == 531
    df = items(spark, [(1, "archive-report.pdf", "Archive/archive-report.pdf", False, 1, 4, "Archive")])
    phrase = search.StructuredQuery(terms=(search.Term("archive"), search.Term("archive report", 0.5, 0, "phrase")))
    assert [r.score for r in search.structured_search(df, phrase).collect()] == [100 + 60 + 75 + 8]
    q = search.StructuredQuery(terms=(search.Term("archive"),), hard_extensions=(".pdf",))
    assert [r.score for r in search.structured_search(df, q).collect()] == [168]
    assert search.standard_search(df, [], "").count() == 0 and search.standard_search(df, ["archive"], "archive", limit=0).count() == 0


def test_sorts(spark):
    df = items(spark, [(1, "b.txt", "b.txt", False, 10, 0, ""), (2, "a.txt", "a.txt", False, 10_000, 0, ""), (3, "dir", "dir", True, None, 0, ""), (4, "A.txt", "x/A.txt", False, 10, 0, "x")])
    df = df.withColumns({"score": F.lit(0.0), "modified": F.lit(None).cast("timestamp")})
    order = lambda s: [r.item_id for r in views.top(df, s.keys(), 10).collect()]
    assert order(views.ItemSort("size")) == [2, 4, 1, 3] and order(views.ItemSort("size", False)) == [4, 1, 2, 3]
    assert order(views.ItemSort("name")) == [2, 4, 1, 3] and order(views.ItemSort("kind"))[0] == 3
    assert views.top(df, views.ItemSort().keys(), 0).count() == 0
    assert [r.item_id for r in views.folder_view(df, views.ItemSort("name"), 2).collect()] == [3, 2]


def test_auto_open(spark):
    make = lambda *s: spark.createDataFrame([(f"n{i}", f"p{i}", float(x)) for i, x in enumerate(s)], "name string, full_path string, score double")
    assert views.auto_open(make(200, 150)).collect()[0].full_path == "p0"
    assert views.auto_open(make(200, 161)).count() == 0 and views.auto_open(make(90)).count() == 0 and views.auto_open(make(100)).count() == 1


def test_fuzzy_gate(spark):
    posted = spark.createDataFrame([(1, "alpha", "v"), (2, "alphb", "v"), (3, "alphc", "w")], "item_id long, token string, volume string")
    ids = lambda df: sorted(r.item_id for r in df.collect())
    assert ids(retrieval.fuzzy(posted, "alpha")) == [1] and ids(retrieval.fuzzy(posted, "alpha", group_col="volume")) == [1, 3]
    assert ids(retrieval.fuzzy(posted, "alphx", 1)) == [1, 2, 3]


# Trees and changes


def test_tree_leaves_out_what_is_not_connected(spark):
    rows = [(5, None, "root", True), (16, 5, "a", True), (17, 16, "b", False), (18, 19, "x", True), (19, 18, "y", True), (20, 99, "lost", False), (21, 17, "under file", False)]
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, is_dir boolean")
    got = tree.reachable(df, 5)
    assert {r.id: r.path for r in got.collect()} == {5: "root", 16: "root/a", 17: "root/a/b"}
    assert sorted(r.id for r in tree.disconnected(df, got).collect()) == [18, 19, 20, 21]
    deep = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", True) for i in range(20)], "id long, parent_id long, name string, is_dir boolean")
    assert [r.id for r in tree.pre_order(tree.reachable(deep, 0)).collect()] == list(range(20))
    crumbs = spark.range(1).select(tree.breadcrumb(F.lit("C/a/b"), ["C", "C/a"]).alias("b"), tree.crumbs_that_fit(F.array(*[F.lit(x) for x in ("aaaa", "bb", "c")]), 12).alias("f")).head()
    assert crumbs.b == ["C/a", "C/a/b"] and crumbs.f == ["bb", "c"]


class Model:
    """Entries worked off one change after another, rows with references to their parents' rows."""

    def __init__(self, rows, root):
        self.rows, self.root = [dict(zip(links.ENTRY, r, strict=True)) for r in rows], root

    def folder(self, ref):
        return next((r for r in self.rows if r["file_ref"] == ref and r["is_dir"]), None)

    def select(self, ref, parent, name):
        own = [r for r in self.rows if r["file_ref"] == ref]
        exact = [r for r in own if r["parent_ref"] == parent and r["name"].upper() == name.upper()]
        return exact[0] if exact else own[0] if len(own) == 1 else None

    def upsert(self, c):
        if self.folder(c["parent_ref"]) is None:
            return None
        mask = (1 << 48) - 1
        stale = [r for r in self.rows if r["file_ref"] & mask == c["file_ref"] & mask and r["file_ref"] != c["file_ref"]]
        self.rows = [r for r in self.rows if r not in stale]
        row = self.select(c["file_ref"], c["previous_parent"], c["previous_name"]) if c["previous_name"] else None
        if row is None and c["kind"] == "add_link":
            row = next((r for r in self.rows if (r["file_ref"], r["parent_ref"], r["name"].upper()) == (c["file_ref"], c["parent_ref"], c["name"].upper())), None)
        elif row is None:
            row = self.select(c["file_ref"], c["parent_ref"], c["name"])
        if row is not None and row["is_dir"] != c["is_dir"]:
            self.rows.remove(row)
            row = None
        if row is None:
            self.rows.append({k: c[k] for k in links.ENTRY})
            return True
        changed = bool(stale) or (row["name"], row["parent_ref"]) != (c["name"], c["parent_ref"])
        row["name"], row["parent_ref"] = c["name"], c["parent_ref"]
        for r in self.rows:
            if r["file_ref"] == c["file_ref"]:
                changed |= any(r[k] != c[k] for k in links.META)
                r.update({k: c[k] for k in links.META})
        return changed

    def apply(self, batch):
        done, waiting, gone = {}, [], set()
        for c in batch:
            if c["file_ref"] & ((1 << 48) - 1) < 16 or c["file_ref"] == self.root:
                done[c["ordinal"]] = False
            elif c["kind"] == "delete":
                row = self.select(c["file_ref"], c["parent_ref"], c["name"])
                done[c["ordinal"]] = row is not None
                if row is not None:
                    self.rows.remove(row)
                    gone |= {row["file_ref"]} if row["is_dir"] else set()
            elif (ok := self.upsert(c)) is None:
                waiting.append(c)
            else:
                done[c["ordinal"]] = ok
        while waiting:
            still = []
            for c in waiting:
                ok = self.upsert(c)
                if ok is None:
                    still.append(c)
                else:
                    done[c["ordinal"]] = ok
            if len(still) == len(waiting):
                done.update({c["ordinal"]: False for c in still})
                break
            waiting = still
        while gone:
            lost = [r for r in self.rows if r["parent_ref"] in gone]
            self.rows = [r for r in self.rows if r not in lost]
            gone = {r["file_ref"] for r in lost if r["is_dir"]}
        return done


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_batches_against_a_model(spark, seed):
    """Random batches: files and folders made, moved, renamed, linked, deleted; parents that come later or never."""
    rng = random.Random(seed)
    seq = 1 << 48
    rows = [(5, 5, "root", True, 0, 0, 0, 0)] + [(100 + i + seq, 5 if i < 4 else 100 + i - 4 + seq, f"d{i}", True, 0, 0, 0, 0) for i in range(8)]
    rows += [(500 + i + seq, 100 + i % 8 + seq, f"f{i}.txt", False, 0, i, i, 0) for i in range(40)]
    batch, doomed = [], {106 + seq, 103 + seq}
    for n in range(70):
        i, roll = rng.randrange(50), rng.random()
        ref = 500 + i + (seq if rng.random() < 0.9 else 2 * seq)
        parent = rng.choice([5, 100 + seq, 101 + seq, 102 + seq, 900 + seq, 901 + seq, 777])
        c = dict.fromkeys(links.META, n) | {"ordinal": n, "kind": "upsert", "file_ref": ref, "parent_ref": parent, "name": f"f{i}.txt", "is_dir": False, "previous_parent": None, "previous_name": None}
        if roll < 0.15:
            c |= {"kind": "delete", "parent_ref": 100 + i % 8 + seq}
        elif roll < 0.3:
            c |= {"name": f"F{i}.TXT"}
        elif roll < 0.4:
            c |= {"previous_parent": 100 + i % 8 + seq, "previous_name": f"f{i}.txt", "name": f"g{i}.txt"}
        elif roll < 0.5:
            c |= {"kind": "add_link", "name": f"l{i}.txt"}
        batch.append(c)
    folder = lambda n, ref, parent, kind="upsert": dict.fromkeys(links.META, 0) | {"ordinal": n, "kind": kind, "file_ref": ref, "parent_ref": parent, "name": f"n{ref & 0xFFFF}", "is_dir": True, "previous_parent": None, "previous_name": None}
    batch += [folder(80, 901 + seq, 900 + seq), folder(81, 900 + seq, 5), folder(82, 3, 5)] + [folder(90 + i, ref, 5, "delete") for i, ref in enumerate(sorted(doomed))]
    model = Model(rows, 5)
    done = model.apply(batch)
    columns = [f.split()[0] for f in links.CHANGE_SCHEMA.split(", ")]
    entries = spark.createDataFrame(rows, links.ENTRY_SCHEMA)
    final, outcome = links.apply_batch(entries, spark.createDataFrame([tuple(c[k] for k in columns) for c in batch], links.CHANGE_SCHEMA), 5)
    assert sorted(tuple(r) for r in final.collect()) == sorted(tuple(r[k] for k in links.ENTRY) for r in model.rows)
    assert {r.ordinal: r.done == "applied" for r in outcome.collect()} == done


def test_roots_renames_and_splits(spark):
    df = spark.createDataFrame([("C/a",), ("C/a/b",), ("C/ab",), ("D",), ("C/a",)], "path string")
    assert sorted(r.path for r in changes.outermost(df).collect()) == ["C/a", "C/ab", "D"]
    files = [("d/a.txt", "b.txt"), ("d/b.txt", "c.txt"), ("d/c.txt", "C.TXT"), ("d/h.txt", "H.TXT"), ("d/e.txt", "new.txt"), ("d/f.txt", "new.txt"), ("e/x.txt", "CON.txt"), ("e/y.txt", "con.tar.gz2"), ("e/z.txt", "z.txt"), ("e/q.txt", "a\tb")]
    planned = rename.plan(spark.createDataFrame(files, "path string, t string"), F.col("t"))
    assert {r.old_name: r.status for r in planned.collect()} == {
        "a.txt": "exists", "b.txt": "exists", "c.txt": "duplicate", "h.txt": "ready", "e.txt": "duplicate", "f.txt": "duplicate", "x.txt": "invalid", "y.txt": "ready", "z.txt": "unchanged", "q.txt": "invalid",
    }
    assert not rename.can_apply(planned).head()[0]
    assert rename.can_apply(planned.where("status IN ('ready', 'unchanged')")).head()[0] and not rename.can_apply(planned.where("status = 'unchanged'")).head()[0]
    seen = spark.createDataFrame([("renamed", True, True), ("renamed", True, False), ("renamed", False, True), ("renamed", False, False), ("modified", True, True)], "k string, o boolean, n boolean")
    kinds_ = [r[0] for r in seen.select(changes.split_rename(F.col("k"), F.lit("a"), F.lit("b"), F.col("o"), F.col("n"))).collect()]
    assert kinds_ == ["renamed", "deleted", "created", None, "modified"]


def test_rates_and_verdicts(spark):
    assert metrics.fold_rates([(0, 1), (1, 3), (1.1, 9), (2, 5), (3, 4), (4, 6)], 0.25) == [None, 2.0, 2.0, 2.0, None, 2.0]
    rows = [("f", "baseline", 100.0, 10.0), ("f", "candidate", 120.0, 9.0), ("g", "baseline", 100.0, 10.0), ("g", "candidate", 90.0, 10.0), ("h", "baseline", 1.0, 1.0)]
    got = metrics.verdict(spark.createDataFrame(rows, "k string, run string, p double, a double"), ["k"], "run", ("p", "a"), 5)
    assert {r.k: r.verdict for r in got.collect()} == {"f": "regression", "g": "improvement", "h": "missing"}
    log = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((1, 8, 800, 50, 7))], "k string, ts int, v double")
    w = metrics.event_windows(log, ["k"], "ts", F.col("ts") == 2)
    both = metrics.in_windows(log, w, ["k"], "ts").groupBy("window").agg(F.count("*").alias("n")).collect()
    assert sorted((r.window, r.n) for r in both) == [(0, 3), (1, 3)]


# Planner


def test_planner():
    assert intent.keywords("Find the budget report for 2026") == ["budget", "report", "2026"] and not intent.wants_open("reopened")
    assert [(t.text, t.group) for t in intent.fallback("geçen hafta raporlar video bütçe", True, True).terms] == [("rapor", 0), ("bütçe", 1)]
    assert ".mp4" in intent.by_rules("holiday video").hard_extensions and intent.wants_open("open the report")
    words = {"anchors": [{"primary": "budget", "variants": ["budgets"], "translations": ["bütçe"]}, {"primary": "archive"}], "phrases": ["q1"], "context": ["q1", "draft"]}
    asked = {"target": "file", "folders": ["Archive"], "soft_extensions": [".pdf", ".TXT"], "hard_extensions": [".pdf"], "created_from": "2026-01-01", "created_to_exclusive": "2026-02-01", "open": True}
    q = intent.from_documents(asked, words, "budget aç")
    assert [(t.text, t.weight) for t in q.terms] == [("budget", 1.0), ("budgets", 0.9), ("bütçe", 0.8), ("q1", 0.75)] and q.soft_extensions == (".TXT",)
    assert [t.text for t in q.folder_context] == ["archive"] and [c.text for c in q.context] == ["draft"] and q.files_preferred and q.should_open
    assert not intent.from_documents(asked, words, "budget").should_open
    alone = intent.from_documents({"target": "file", "folders": ["Archive"]}, {"anchors": [{"primary": "archive"}]})
    assert [t.text for t in alone.terms] == ["archive"] and not alone.folder_context
    assert [intent.valid_date(x) for x in ("2026-02-29", "2024-02-29", "2026-99-99", "x", None)] == [None, "2024-02-29", None, None, None]
    for bad in ({"x": 1}, {"hard_extensions": "pdf"}, {"created_from": "2026-02-01", "created_to_exclusive": "2026-01-01"}):
        with pytest.raises(ValueError):
            intent.from_documents(bad, {})


def test_title_case_and_numbers(spark):
    rules = rename.Rules
    assert rename.renamed("istanbul ılık.txt", False, 1, 1, rules(case="upper")) == "İSTANBUL ILIK.txt"
    assert rename.renamed("İZMİR KIŞ.txt", False, 1, 1, rules(case="title")) == "İzmir Kış.txt"
    assert rename.renamed("x.txt", False, 7, 2, rules(template="Rapor ")) == "Rapor 07.txt" and rename.renamed("klasör.v2", True, 12, 2, rules(template="Tatil {n}")) == "Tatil 12"
    assert rename.renamed("a.txt", False, 1234, 3, rules(template="{n}")) == "1234.txt"
    files = spark.createDataFrame([(f"A/eski{i:02d}.png", False) for i in range(11)] + [("A/klasör.v2", True)], "path string, is_dir boolean")
    planned = {r.old_name: r.new_name for r in rename.plan_renames(files, rules(template="Tatil {n}"), ["path"]).collect()}
    assert planned["eski00.png"] == "Tatil 01.png" and planned["eski10.png"] == "Tatil 11.png" and planned["klasör.v2"] == "Tatil 12"


def test_phrases_are_not_required(spark):
    df = items(spark, [(1, "budget.txt", "d/budget.txt", False, 1, 0, "d"), (2, "q1-plan budget.txt", "d/q1-plan budget.txt", False, 1, 0, "d")])
    q = intent.from_documents({}, {"anchors": [{"primary": "budget"}], "phrases": ["q1 plan"]})
    assert {r.item_id: r.score for r in search.structured_search(df, q).collect()} == {1: 250.0, 2: 100 + 75 + 75 * 0.75}
    soft = search.StructuredQuery(terms=(search.Term("budget"),), soft_extensions=("df", "txt", ".TXT"))
    assert {r.score for r in search.structured_search(df, soft).collect()} == {130.0}  # the first one equal to it
    assert search.structured_search(df, search.StructuredQuery(context=(search.Term("budget", 1.0, -1, "context"),))).count() == 0
    near = search.StructuredQuery(terms=(search.Term("budgat"),))
    assert {r.score for r in search.structured_search(df, near).collect()} == {40.0}
    both = df.union(items(spark, [(3, "budgat.txt", "d/budgat.txt", False, 1, 0, "d")]))
    assert [r.item_id for r in search.structured_search(both, near).collect()] == [3]  # one that has it keeps near ones out


def test_duplicate_query_tokens(spark):
    df = items(spark, [(1, "a b", "y/a b", False, 1, 0, "y"), (2, "a b", "x/a b", False, 1, 0, "x")])
    got = search.standard_search(df, ["a", "a"], "a a").collect()
    assert [(r.item_id, r.score) for r in got] == [(2, 75.0), (1, 75.0)]  # not all tokens; ties by path


def test_service(spark):
    df = items(spark, [(1, "budget.txt", "d/budget.txt", False, 1, 9, "d")])
    calls = {"standard": lambda t: retrieval.literal(df, t), "advanced": lambda q: search.structured_search(df, q)}
    parse = lambda t: intent.from_documents({"open": True}, {"anchors": [{"primary": "budget"}]}, "open budget")
    assert intent.serve("budget", natural=False, online=True, parse=parse, **calls).mode == "standard"
    offline = intent.serve("budget", natural=True, online=False, parse=parse, **calls)
    assert offline.mode == "offline" and offline.used_fallback
    found = intent.serve("budget", natural=True, online=True, parse=parse, **calls)
    assert found.mode == "advanced" and found.open_path.collect()[0].full_path == "d/budget.txt"

    def broken(_):
        raise ValueError("no answer")

    rules = intent.serve("budget", natural=True, online=True, parse=broken, **calls)
    assert rules.mode == "rules" and rules.reason == "no answer" and rules.results.count() == 1

    def not_ready(_):
        raise LookupError("no index")

    assert intent.serve("budget", natural=True, online=True, parse=parse, standard=calls["standard"], advanced=not_ready).mode == "standard"
    again = intent.refresh(found, "other", **calls)
    assert again.results.count() == 1 and again.open_path is None


def test_nearest_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *range(50)])) for _ in range(500)] + [("c", 7), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: (r.n, r.p50, r.p90, r.p95, r.p99, r.largest) for r in profile.summarize(df, "v", ["k"]).collect()}
    for k in "abcd":
        own = sorted(v for x, v in rows if x == k and v is not None)
        rank = lambda q: own[-(-len(own) * q // 100) - 1] if own else 0
        assert got[k] == (len(own), rank(50), rank(90), rank(95), rank(99), own[-1] if own else 0)
    assert profile.summarize(df, "v").head().p50 == sorted(v for _, v in rows if v is not None)[-(-sum(v is not None for _, v in rows) // 2) - 1]


def test_paths_prefer_the_exact_name(spark):
    t = spark.createDataFrame([(1, "R"), (2, "R/a"), (3, "R/A"), (4, "R/A/x"), (5, "R/a/X")], "id long, path string")
    asked = spark.createDataFrame([("r/A",), ("R/a",), ("R/a/x",), ("R/none",)], "path string")
    assert {r.asked: r.id for r in tree.find_path(t, asked).collect()} == {"r/A": 3, "R/a": 2, "R/a/x": 5}


def test_event_batches(spark):
    schema = "full_path string, is_dir boolean, size_bytes long, modified string, open_count int"
    df = spark.createDataFrame([("a", True, 0, "m", 1), ("a/x", False, 1, "m", 2), ("a/b", True, 0, "m", 3), ("a/b/y", False, 1, "m", 4), ("z", False, 1, "m", 5)], schema)
    ev = [(1, "renamed", "n", "a", True, 0, "m"), (2, "renamed", "w", "a/b", True, 0, "m"), (3, "modified", "z", None, False, 9, "k"), (4, "created", "t", None, False, 1, "k"), (5, "deleted", "t", None, False, 1, "k")]
    events = spark.createDataFrame(ev, "ordinal long, kind string, full_path string, old_path string, is_dir boolean, size_bytes long, modified string")
    got = {r.full_path: (r.size_bytes, r.open_count) for r in live.apply_events(df, events).collect()}
    assert got == {"n": (0, 1), "n/x": (1, 2), "w": (0, 3), "w/y": (1, 4), "z": (9, 5)}


def test_ordinals_beyond_the_sample_of_bounds(spark):
    """More rows than Spark samples for the bounds of ranges; numbers have no gap, whichever columns are read."""
    rows = spark.range(60_000).select("id", F.concat(F.lit("f"), "id").alias("path"), (F.col("id") % 7).alias("tie"))
    numbered = rename.ordinals(rows, ["id"])
    assert numbered.count() == 60_000 and numbered.where("path <> concat('f', ordinal)").count() == 0
    tied = rename.ordinals(rows, ["tie"]).select("path", "tie", "ordinal")
    got = tied.toPandas().sort_values("ordinal")
    assert list(got.ordinal) == list(range(60_000)) and got.tie.is_monotonic_increasing and got.path.nunique() == 60_000
    both = tied.join(tied.select("path", F.col("ordinal").alias("again")), "path")
    assert both.where("ordinal = again").count() == 60_000


def test_rename_plan_of_a_larger_table(spark, sf_dir, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    step = part.agg(F.max("p_partkey") + 1).head()[0]
    copies = part.crossJoin(spark.range(40_000 // part.count())).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * step).drop("id")
    copies.write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = catalogue.QUERIES["rename_plan"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(c.execute(catalogue.ORACLE["rename_plan"]).df())
