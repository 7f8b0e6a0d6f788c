"""The pipeline against its stages done by hand, and every registered query on odd and empty tables."""

import os
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from filigrane.llm import queries
from tests.llm.test_operators import SCHEMA, odd_rows, plain_classes, plain_hits, plain_rules


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and not any(plain_rules(t)[-1] for t in texts.values())
    classes = plain_classes(texts)
    single = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    clean = corpus_pipeline.decontamination(spark, single, sf_dir)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i in set(classes.values()) if not plain_hits(texts[i], items)[-1])
    mixed = corpus_pipeline.mix(spark, clean, sf_dir)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("empty", [False, True])
def test_every_query_on_odd_tables(spark, sf_dir, tmp_path, empty):
    rows = spark.createDataFrame([] if empty else odd_rows(), SCHEMA)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels", "pages"):
        os.symlink(f"{sf_dir}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        if not name.startswith("op4"):
            assert query(spark, str(tmp_path)).count() == (0 if empty else len(odd_rows())), name
    corpus_pipeline.run(spark, str(tmp_path)).count()


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names and set(queries.ORACLE) <= names


def test_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in ("pages", "documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, sf_dir).toPandas().astype(str)
        want = db.execute(sql).df().astype(str)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert got[columns].sort_values(columns).values.tolist() == want[columns].sort_values(columns).values.tolist(), name
