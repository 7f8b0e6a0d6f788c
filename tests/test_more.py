"""Folder context, visibility and optimistic commits."""

import pytest
from pyspark.sql import functions as F

from filigrane.operators import search, tree
from filigrane.operators.views import CatalogFilter
from filigrane.plans import catalogue, intent
from filigrane.sources import logs


def test_folder_context(spark):
    df = spark.createDataFrame([("proj_sevval/stocks.php",), ("other/stocks.php",), ("my proj/sevval-old/x",), ("stocks",)], "p string")
    got = [r[0] for r in df.select(search.in_folder_context(F.col("p"), [["proj sevval", "sevval"]])).collect()]
    assert got == [True, False, True, False]
    assert [r[0] for r in df.select(search.in_folder_context(F.col("p"), [["se"]])).collect()] == [False] * 4
    names = spark.createDataFrame([(["a.txt", "Report.pdf"],), ([],)], "n array<string>")
    assert [r[0] for r in names.select(search.affects(F.col("n"), "REPORT")).collect()] == [True, False]


def test_visibility(spark):
    rows = spark.createDataFrame([(i, (i - 1) // 2 if i else None, f"n{i}", True) for i in range(15)], "id long, parent_id long, name string, is_dir boolean")
    t = tree.reachable(rows, 0)
    denied = spark.createDataFrame([(1,), (1,), (6,)], "id long")
    assert sorted(r.id for r in tree.visible(t, denied).collect()) == [0, 1, 2, 5, 6, 11, 12]
    assert sorted(r.id for r in tree.descendants_from(t, denied).collect()) == [3, 4, 7, 8, 9, 10, 13, 14]


def test_commit(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "k long, v long")
    assert logs.commit(df, str(tmp_path), 0, "h1") and not logs.commit(df, str(tmp_path), 0, "h1")
    assert logs.commit(df, str(tmp_path), 1, "h2")
    for expected, h in ((0, "h3"), (5, "h4")):
        with pytest.raises(ValueError):
            logs.commit(df, str(tmp_path), expected, h)
    assert logs.load_snapshot(spark, str(tmp_path), 2).count() == 1


def test_closure_is_whole(spark, sf_dir):
    """Regions are below one directory, nations two, customers three, orders four."""
    got = {r.kind: r.n for r in catalogue.QUERIES["tree_closure"](spark, sf_dir).groupBy(F.substring("descendant", 1, 1).alias("kind")).agg(F.count("*").alias("n")).collect()}
    size = {k: catalogue.t(spark, sf_dir, k).count() for k in ("region", "nation", "customer", "orders")}
    assert got == {"r": size["region"], "n": 2 * size["nation"], "c": 3 * size["customer"], "o": 4 * size["orders"]}


def test_folder_contents_are_whole(spark, sf_dir):
    """Below a nation are its customers and all of their orders."""
    got = {r.kind: r.n for r in catalogue.QUERIES["folder_expansion"](spark, sf_dir).groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n")).collect()}
    own = catalogue.t(spark, sf_dir, "customer").where("c_nationkey = 3")
    orders = catalogue.t(spark, sf_dir, "orders").join(own, F.col("o_custkey") == F.col("c_custkey"))
    assert got == {"c": own.count(), "o": orders.count()}


def test_filter_only(spark):
    """The case of the reference's contract test, then requests without terms on the same items."""
    day, mib = "2026-07-%02d", 1 << 20
    rows = [("Downloads", "S", True, day % 10, None, 0), ("S", "", True, "2026-01-01", None, 0), ("sub.d", "S/Downloads", True, day % 12, None, 0)]
    rows += [(f"report-{x}", f"S/{f}", False, c, s, n) for x, f, c, s, n in (
        ("z.pdf", "Downloads", day % 10, 2 * mib, 1), ("a.pdf", "Downloads", day % 10, 2 * mib, 4), ("b.txt", "Downloads", day % 10, 2 * mib, 0), ("old.pdf", "Downloads", "2026-06-30", 2 * mib, 0),
        ("unknown.pdf", "Downloads", None, None, 0), ("c.pdf", "Downloads", day % 10, 2 * mib, 1), ("outside.pdf", "Documents", day % 10, 2 * mib, 0), ("big.pdf", "Downloads", day % 10, 9 * mib, 0))]
    df = spark.createDataFrame(rows, "name string, parent_path string, is_dir boolean, made string, size_bytes long, open_count int")
    df = df.withColumns({"created": F.col("made").cast("timestamp"), "full_path": F.when(F.col("parent_path") == "", F.col("name")).otherwise(F.concat_ws("/", "parent_path", "name"))})
    bounds = CatalogFilter(created_from="2026-07-01", created_before="2026-08-01", min_mb=1, max_mb=3)
    terms = (search.Term("report-a", 0.9, 0, "phrase"),)
    q = search.StructuredQuery(terms, (search.Term("report", 0.5),), (("downloads", 0.8),), ("pdf", "txt"), ("pdf",), 0.6, 0.4, bounds, True)
    names = lambda q, n=100: [r.name for r in search.structured_search(df, q, tokens=lambda t: t.split("-"), limit=n).collect()]
    assert names(q, 2) == ["report-a.pdf", "report-c.pdf"] and names(q) == ["report-a.pdf", "report-c.pdf", "report-z.pdf"]
    inside = {"report-a.pdf", "report-b.txt", "report-c.pdf", "report-z.pdf"}
    every = search.StructuredQuery(folder_hints=(("indirilenler", 0.8),), catalog=bounds)
    assert set(names(every)) == inside | {"sub.d"}
    assert set(names(search.StructuredQuery(catalog=bounds))) == inside | {"sub.d", "Downloads", "report-outside.pdf"}
    assert set(names(search.StructuredQuery(file_weight=1.0, folder_weight=0.0, catalog=bounds))) == inside | {"report-outside.pdf"}
    assert set(names(search.StructuredQuery(file_weight=0.0, folder_weight=1.0, hard_extensions=(".pdf",), catalog=bounds))) == {"Downloads", "sub.d"}
    assert names(search.StructuredQuery(folder_hints=(("downloads", 0.2),))) == [] and names(search.StructuredQuery(context=terms)) == []


def test_filter_mode():
    asked = {"mode": "filter", "hard_extensions": [".pdf"], "folders": ["Archive"]}
    q = intent.from_documents(asked, {"anchors": [{"primary": "PDF"}, {"primary": "archive"}, {"primary": "resimler"}], "phrases": ["x"], "context": ["y"]})
    assert q.filter_only and not q.terms and not q.context
    q = intent.from_documents(asked, {"anchors": [{"primary": "pdf"}, {"primary": "budget"}]})
    assert not q.filter_only and len(q.terms) == 2 and not intent.from_documents({"mode": "keyword"}, {}).filter_only


def test_breadcrumbs_of_deep_folders(spark, sf_dir, monkeypatch):
    rows = spark.createDataFrame([("root", None, "world", True), ("f", "root", "file", False), *[(f"d{i}", f"d{i - 1}" if i else "root", f"n{i}", True) for i in range(5)]], "id string, parent_id string, name string, is_dir boolean")
    monkeypatch.setattr(catalogue, "_tree", lambda spark, d: tree.reachable(rows, "root"))
    got = {r.id: r.crumbs for r in catalogue.QUERIES["breadcrumbs"](spark, sf_dir).collect()}
    assert set(got) == {"root", "d0", "d1", "d2", "d3", "d4"} and got["d4"].endswith("|world/n0/n1/n2/n3/n4")
