"""More queries over the provided tables and the same in SQL: lookups, links, feeds, stores and profiles.

Where the tables hold nothing of the kind (Turkish names, journal records), rows are made from them by a rule, or stand
here as values; both sides then start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigrane.functions import codecs, kinds
from filigrane.functions import text as tx
from filigrane.functions.shared import materialize, shared_path
from filigrane.operators import changes, links, live, metrics, profile, rename, retrieval, search, tree, views
from filigrane.plans import catalogue, intent
from filigrane.plans.catalogue import ITEMS, ORDERS, TREE, part_items, query, ranked, t
from filigrane.sources import journal, logs, store
from filigrane.streaming import feeds
from filigrane.streaming.queue import Queue

KNOWN = set(catalogue.QUERIES)


def values(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def tree_of(spark, d) -> DataFrame:
    return catalogue._tree(spark, d)


def order_items(spark, d) -> DataFrame:
    """Orders below their priorities; the customer (modulo 5) counts as opens."""
    items = catalogue._order_items(spark, d)
    more = t(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 5).cast("int").alias("open_count"))
    return items.join(more, "item_id").withColumns({"parent_path": F.col("full_path"), "full_path": F.concat_ws("/", "full_path", "name")})


PLACED = f"""{ORDERS}, placed AS (SELECT items.*, o_orderpriority AS parent_path, o_orderpriority || '/' || name AS full_path, CAST(o_custkey % 5 AS INT) AS open_count, o_orderdate AS created
    FROM items JOIN orders ON o_orderkey = item_id)"""


# Projections and folders


@query(f"{PLACED} SELECT name, full_path, is_dir, CASE WHEN NOT is_dir THEN size_bytes ELSE -1 END AS size_bytes, CASE WHEN NOT is_dir THEN strftime(modified, '%Y-%m-%d') ELSE '' END AS modified FROM placed")
def result_rows(spark, d):
    rows = views.as_results(order_items(spark, d).withColumn("score", F.lit(0.0)))
    return rows.select("name", "full_path", "is_dir", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"), F.coalesce(F.date_format("modified", "yyyy-MM-dd"), F.lit("")).alias("modified"))


@query(f"{PLACED} SELECT full_path, parent_path, CASE WHEN is_dir THEN -1 ELSE size_bytes END AS size_bytes, strftime(created, '%Y-%m-%d') AS created, 0 AS open_count FROM placed")
def item_rows(spark, d):
    rows = views.as_items(order_items(spark, d), "none")
    return rows.select("full_path", "parent_path", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"), F.date_format("created", "yyyy-MM-dd").alias("created"), "open_count")


@query(f"""{PLACED}, s AS (SELECT item_id, name, is_dir FROM placed WHERE item_id % 6 <> 2 AND NOT (is_dir AND item_id % 10 = 4) AND parent_path = '2-HIGH')
    SELECT item_id, (SELECT count(*) FROM s) >= 150 AS truncated FROM s ORDER BY is_dir DESC, lower(name), name LIMIT 150""")
def folder_page(spark, d):
    """Every sixth order is hidden, every tenth a system one; the first 150 of a folder are shown."""
    bits = F.when(F.col("item_id") % 6 == 2, views.HIDDEN).otherwise(0) + F.when(F.col("item_id") % 10 == 4, views.SYSTEM).otherwise(0)
    rows = order_items(spark, d).where("parent_path = '2-HIGH'").withColumn("attributes", bits)
    return views.listing(rows, 150).select("item_id", "truncated")


@query(f"{PLACED} SELECT item_id FROM placed WHERE (is_dir OR size_bytes < 104857600) AND item_id % 4 = 1 AND parent_path <> '5-LOW'")
def walk_rows(spark, d):
    """What a walk catalogues: no hidden entries, folders that may not be listed stay, excluded ones do not."""
    state = F.when(F.col("parent_path") == "5-LOW", "excluded").when(F.col("item_id") % 3 == 0, "denied").when(F.col("item_id") % 3 == 1, "failed").otherwise("ok")
    rows = order_items(spark, d).where("is_dir OR size_bytes < 104857600").withColumns({"attributes": F.when(F.col("item_id") % 4 == 1, 32).when(F.col("item_id") % 4 == 2, 2).otherwise(4), "state": state})
    return views.walk_snapshot(rows, "none")[0].select("item_id")


@query(f"{ORDERS} SELECT item_id FROM items WHERE ends_with(lower(name), '.mp4')")
def distinct_name_filter(spark, d):
    return views.by_distinct_name(catalogue._order_items(spark, d), lambda n: kinds.in_categories(n, {"video"})).select("item_id")


@query(f"""{PLACED}, live AS (SELECT item_id, is_dir, modified, size_bytes FROM placed WHERE item_id % 5 <> 0 UNION ALL SELECT item_id, is_dir, modified, 20971520 FROM placed WHERE item_id % 5 = 0)
    SELECT item_id FROM live WHERE NOT is_dir AND modified >= TIMESTAMP '1995-06-01' AND size_bytes / 1048576.0 BETWEEN 15 AND 30""")
def overlay_filter(spark, d):
    """The pushed-down filter over a base with a delta on top."""
    rows = order_items(spark, d).select("item_id", "name", "full_path", "is_dir", "size_bytes", "created", "modified")
    delta = rows.where("item_id % 5 = 0").withColumn("size_bytes", F.lit(20 << 20).cast("long"))
    live_ = retrieval.overlay(rows, delta, "item_id")
    return live_.where(views.CatalogFilter(folders=False, modified_from="1995-06-01", min_mb=15, max_mb=30).column()).select("item_id")


# Lookups and words


@query(f"{TREE} SELECT a.asked, id FROM tree JOIN (VALUES ('world/ASIA'), ('WORLD/asia/nation_2'), ('world/Europe/Nation_3/'), ('world')) a(asked) ON lower(path) = lower(rtrim(a.asked, '/'))")
def path_lookup(spark, d):
    asked = values(spark, [("world/ASIA",), ("WORLD/asia/nation_2",), ("world/Europe/Nation_3/",), ("world/nowhere",), ("world",)], "path string")
    return tree.find_path(tree_of(spark, d), asked).select("asked", "id")


@query(f"{PLACED} SELECT upper(full_path) AS asked, item_id FROM placed WHERE item_id % 50 = 3")
def path_hash_lookup(spark, d):
    items = order_items(spark, d)
    asked = items.where("item_id % 50 = 3").select(F.upper("full_path").alias("path")).unionByName(values(spark, [("none",)], "path string"))
    return codecs.find_by_hash(codecs.path_index(items), asked).select("asked", "item_id")


@query(f"{TREE} SELECT id, path FROM tree WHERE list_has_any(list_append(ancestors, id), ['r1', 'n3'])")
def scope_filter(spark, d):
    return tree.scope_rows(tree_of(spark, d), "root", ["world/america", "world/EUROPE/nation_3", "world/none"]).select("id", "path")


@query(f"{ITEMS} SELECT item_id FROM items WHERE list_contains(tokens, 'widget')")
def whole_words(spark, d):
    return retrieval.token_items(part_items(spark, d), "Widget", "whole").select("item_id")


@query(f"{ITEMS} SELECT item_id FROM items WHERE contains(upper(name), 'IDG')")
def words_in_part(spark, d):
    return retrieval.token_items(part_items(spark, d), "idg", "partial").select("item_id")


@query(f"{ITEMS} SELECT item_id FROM items WHERE len(list_filter(tokens, lambda x: length(x) BETWEEN 3 AND 64 AND levenshtein(x, 'wodget') <= 2)) > 0")
def words_nearly(spark, d):
    return retrieval.token_items(part_items(spark, d), "wodget", "fuzzy", 2).select("item_id")


@query(f"{ITEMS} SELECT row_number() OVER (ORDER BY lower(name), lower(full_path), full_path, item_id) AS position, item_id FROM items WHERE contains(lower(name), 'ring') ORDER BY position LIMIT 60")
def federated_top(spark, d):
    """Three volumes with one order."""
    found = retrieval.literal(part_items(spark, d), "ring")
    keys = [F.lower("name"), F.lower("full_path"), F.col("full_path"), F.col("item_id")]
    return ranked(retrieval.federated([found.where(F.col("item_id") % 3 == i) for i in range(3)], keys, 60), keys, "item_id")


@query(f"{ITEMS} SELECT item_id FROM items WHERE contains(lower(name), 'old wid')")
def gram_block_search(spark, d):
    """Literal search that looks only into blocks with all trigrams of the text."""
    items = part_items(spark, d)
    return retrieval.literal_in_blocks(items, retrieval.gram_blocks(items, "item_id"), "OLD wid", "item_id").select("item_id")


@query(f"{ITEMS} SELECT DISTINCT token FROM (SELECT unnest(tokens) AS token FROM items) WHERE contains(token, 'dge')")
def bigram_words(spark, d):
    words = retrieval.vocabulary(retrieval.postings(part_items(spark, d)))
    return retrieval.words_holding(words, retrieval.word_bigrams(words), "dge")


@query(f"{ITEMS} SELECT DISTINCT full_path AS path FROM items WHERE len(list_filter(tokens, lambda x: contains(x, 'old'))) > 0 AND item_id % 4 <> 0")
def index_lookup(spark, d):
    """A plain inverted index after some paths were removed from it."""
    items = part_items(spark, d)
    index = retrieval.index_add(values(spark, [], "token string, path string"), items, tx.tokenize_ascii(F.col("name")))
    gone = items.where("item_id % 4 = 0").select(F.col("full_path").alias("path"))
    stays = items.where("item_id % 4 <> 0").select(F.col("full_path").alias("path"))
    return retrieval.index_get(retrieval.index_remove(index, gone.join(stays, "path", "left_anti")), "old", "partial").join(stays.distinct(), "path", "left_semi")


@query(f"{ITEMS} SELECT count(DISTINCT token) AS tokens, count(DISTINCT full_path) AS paths, count(*) AS postings FROM (SELECT full_path, unnest(tokens) AS token FROM items)")
def index_sizes(spark, d):
    index = retrieval.index_add(values(spark, [], "token string, path string"), part_items(spark, d), tx.tokenize_ascii(F.col("name")))
    return retrieval.index_counts(index)


# Trees


@query(f"{TREE}, p AS (SELECT id, list_filter(['root', 'r1', 'n3', 'c5'], lambda r: list_contains(list_append(ancestors, id), r)) AS inside FROM tree) SELECT id, inside[len(inside)] AS root FROM p WHERE len(inside) > 0")
def nearest_roots(spark, d):
    """Of nested roots the innermost takes a row: the nation n3 and the customer c5 lie in regions."""
    return tree.nearest_root(tree_of(spark, d), values(spark, [("root",), ("r1",), ("n3",), ("c5",)], "id string")).select("id", "root")


@query(f"{TREE} SELECT t.id FROM tree t LEFT JOIN orders ON t.id = 'o' || o_orderkey WHERE o_custkey IS NULL OR o_custkey % 3 <> 0")
def inventory_rows(spark, d):
    """Every third customer is a link to elsewhere: it is listed, but not entered."""
    rows = catalogue._tree_rows(spark, d).withColumn("link", F.col("id").like("c%") & (F.coalesce(F.substring("id", 2, 20).try_cast("long"), F.lit(1)) % 3 == 0))
    return tree.reachable(rows, "root", closed_col="link").select("id")


@query("SELECT 'root' AS id UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 2)")
def tree_roots(spark, d):
    """Where some nations are not there, their customers have no parent."""
    rows = catalogue._tree_rows(spark, d)
    gone = t(spark, d, "nation").where("n_nationkey % 5 = 2").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return tree.roots_of(rows.join(gone, "id", "left_anti")).select("id")


@query("""SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey % 5 <> 2) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + 1 AS "rows",
    (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey % 5 <> 2) + (SELECT count(*) FROM customer) + 1 AS directories,
    (SELECT count(*) FROM customer WHERE c_nationkey % 5 = 2) AS missing_parent, 0 AS parent_is_file, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 = 2) AS cut_off""")
def tree_audit(spark, d):
    rows = catalogue._tree_rows(spark, d)
    gone = t(spark, d, "nation").where("n_nationkey % 5 = 2").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return tree.audit(rows.join(gone, "id", "left_anti"), "root")


@query(f"{TREE} SELECT a.id, coalesce(path, '') AS path, path IS NOT NULL AS resolved FROM (VALUES ('n3'), ('c7'), ('zz')) a(id) LEFT JOIN tree USING (id)")
def resolved_paths(spark, d):
    out = tree.paths_of(catalogue._tree_rows(spark, d), "root", values(spark, [("n3",), ("c7",), ("zz",), ("n3",)], "id string"))
    return out.select("id", F.coalesce("path", F.lit("")).alias("path"), "resolved")


@query(f"""{TREE}, k AS (SELECT id, upper(path) AS key FROM tree WHERE depth <= 2) SELECT id, row_number() OVER (ORDER BY string_split(key, '/'), id) AS place FROM k""")
def placement_rank(spark, d):
    """Depth first by name; the folders of the first levels."""
    rows = tree.pre_order(tree_of(spark, d).where("depth <= 2"))
    return rows.select("id", F.row_number().over(Window.orderBy("sort_path", "id")).cast("long").alias("place"))


@query(f"""{TREE} SELECT id, row_number() OVER (ORDER BY depth, string_split(upper(path), '/'), id) AS place FROM tree ORDER BY place LIMIT 200""")
def breadth_first_rows(spark, d):
    rows = tree.breadth_first(tree_of(spark, d)).limit(200)
    return rows.select("id", F.row_number().over(Window.orderBy("depth", "sort_path", "id")).cast("long").alias("place"))


@query(f"""{TREE} SELECT id, row_number() OVER (ORDER BY upper(name), name, id) AS place FROM tree WHERE id <> 'root' ORDER BY place LIMIT 200""")
def all_items_by_name(spark, d):
    rows = tree.all_items(tree_of(spark, d), "root").limit(200)
    return rows.select("id", F.row_number().over(Window.orderBy(F.upper("name"), "name", "id")).cast("long").alias("place"))


@query(f"{TREE} SELECT id FROM tree WHERE starts_with(path, 'world/ASIA/NATION_2/') OR path IN ('world/ASIA/NATION_2', 'world/EUROPE') OR starts_with(path, 'world/EUROPE/')")
def deleted_subtrees(spark, d):
    gone = values(spark, [("world/ASIA/NATION_2",), ("world/EUROPE",)], "path string")
    return changes.deleted_subtree(tree_of(spark, d), gone).select("id")


# Structured search


@query(f"""{PLACED} SELECT item_id, CAST(100.0 + CASE WHEN contains(name, 'o1') THEN 0 ELSE 0 END + 2.0 * open_count AS DOUBLE) AS score FROM placed
    WHERE NOT is_dir AND ends_with(name, '.MP4') AND modified >= TIMESTAMP '1996-01-01' ORDER BY score DESC, lower(name), lower(full_path), full_path LIMIT 100""")
def predicted_types(spark, d):
    """Without hard extensions the types bind: video, from a date on that is none and one that is."""
    q = search.StructuredQuery(file_types=("video",), file_weight=1.0, folder_weight=0.0, filter_only=True, catalog=views.CatalogFilter(created_from="2026-99-99", modified_from="1996-01-01"))
    return search.structured_search(order_items(spark, d), q).select("item_id", "score")


@query(f"""{ITEMS} SELECT item_id, CAST(100.0 * 1.0 + CASE WHEN name = 'cold widget' THEN 112.5 WHEN contains(name, 'cold widget') THEN 56.25 ELSE 0 END
      + CASE WHEN name = 'widget' THEN 150 ELSE 75 END + 2.0 * open_count AS DOUBLE) AS score FROM items WHERE list_contains(tokens, 'widget')
    ORDER BY score DESC, lower(name), lower(full_path), full_path, item_id LIMIT 100""")
def structured_phrase_bonus(spark, d):
    """A phrase adds to the score and is not required."""
    q = intent.from_documents({}, {"anchors": [{"primary": "widget"}], "phrases": ["cold widget"]})
    found = search.structured_search(part_items(spark, d), q, limit=10**6)
    return views.top(found, [*search.relevance(), F.col("item_id")], 100).select("item_id", "score")


@query(f"""{TREE}, k AS (SELECT id, name, path, ancestors FROM tree WHERE NOT starts_with(id, 'r') AND id <> 'root'), hit AS (SELECT id FROM tree WHERE lower(name) = 'nation_2')
    SELECT k.id FROM k WHERE list_has_any(ancestors, (SELECT list(id) FROM hit))""")
def structured_folder_contents(spark, d):
    """A folder that the anchor finds is replaced by all that is below it."""
    rows = tree_of(spark, d)
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    items = rows.select("id", "name", F.col("path").alias("full_path"), "is_dir", above.alias("ancestors"), F.lit(0).alias("open_count"), tx.parent_path(F.col("path")).alias("parent_path"), F.lit(1).cast("long").alias("size_bytes"))
    q = search.StructuredQuery(terms=(search.Term("nation 2", 1.0, 0, "exact"),))
    return search.structured_search(items, q, limit=10**7).select("id")


@query(f"""{PLACED} SELECT item_id, CAST(175.0 + CASE WHEN ends_with(name, '.MP4') THEN 35 WHEN ends_with(name, '.pdf') THEN 30 ELSE 0 END + 2.0 * open_count AS DOUBLE) AS score
    FROM placed WHERE NOT is_dir AND parent_path = '1-URGENT' AND contains(lower(name), 'o1') ORDER BY score DESC, lower(name), lower(full_path), full_path LIMIT 100""")
def folder_context_search(spark, d):
    """The anchor `urgent` names the hinted folder: it moves to the context and filters; the other anchor stays."""
    asked = {"target": "file", "folders": ["Urgent"], "soft_extensions": ["mp4", ".pdf"]}
    q = intent.from_documents(asked, {"anchors": [{"primary": "o1"}, {"primary": "urgent"}]})
    assert [x.text for x in q.folder_context] == ["urgent"]
    # Tokens of two letters only match whole: the names' first two characters are tokens of their own here.
    tokens = lambda c: F.concat(tx.tokenize_ascii(c), F.array(F.lower(F.substring(c, 1, 2))))
    found = search.structured_search(order_items(spark, d).withColumn("parent_path", F.lit("")), q, name_tokens=tokens)
    return found.select("item_id", (F.col("score") - F.when(F.contains(F.lower("full_path"), F.lit("urgent")), 100.0).otherwise(0.0) - 100.0).alias("score"))


@query("""SELECT * FROM (VALUES (0, 'budget', 1.0, 0, 'exact'), (1, 'budgets', 0.9, 0, 'variant'), (2, 'bütçe', 0.8, 0, 'variant'), (3, 'report', 1.0, 1, 'exact'), (4, 'q1 plan', 0.75, -1, 'phrase'), (5, 'draft', 0.35, -1, 'context'))
    AS v(position, text, weight, grp, kind)""")
def planned_terms(spark, d):
    """Weights by role and position, equal texts once, phrases and context outside of the groups."""
    words = {"anchors": [{"primary": "budget", "variants": ["budgets"], "translations": ["bütçe", "Budget"]}, {"primary": "report"}], "phrases": ["q1 plan"], "context": ["draft", "report"]}
    rows = [(i, x.text, x.weight, x.group, x.kind) for i, x in enumerate(intent.weighted_terms(words))]
    return values(spark, rows, "position int, text string, weight double, grp int, kind string")


@query("SELECT * FROM (VALUES ('a', 1.0, 0), ('rapor', 1.0, 0), ('bütçe', 0.95, 1), ('b', 0.95, 0)) AS v(text, weight, grp) WHERE length(text) > 1")
def fallback_terms(spark, d):
    """Few words, one group each: no words of time or kind, no plural endings."""
    rows = [(x.text, x.weight, x.group) for x in intent.fallback("geçen hafta raporlar video bütçe", True, True).terms]
    return values(spark, rows, "text string, weight double, grp int")


@query(f"{ITEMS} SELECT item_id, CASE WHEN list_contains(tokens, 'cold') THEN 100.0 + 2.0 * open_count WHEN contains(name, 'old') THEN 25.0 + 2.0 * open_count ELSE 0 END AS score FROM items")
def strategy_scores(spark, d):
    items = part_items(spark, d)
    exact = F.array_contains(tx.tokenize_ascii(F.col("name")), "cold")
    return items.select("item_id", search.strategy_score(exact | F.contains("name", F.lit("old")), exact, F.col("open_count")).alias("score"))


# Catalogues by path


WALK = """WITH cached AS (SELECT o_orderpriority || '/' || (o_custkey % 40) || '/' || o_orderkey AS full_path, false AS is_dir, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0),
    walked AS (SELECT o_orderpriority || '/' || (o_custkey % 40) || '/' || o_orderkey AS full_path, o_orderkey % 5 = 0 AS is_dir, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"""


def _walk(spark, d):
    path = F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string"), F.col("o_orderkey").cast("string"))
    o = t(spark, d, "orders").select("o_orderkey", path.alias("full_path"))
    return o.where("o_orderkey % 7 <> 0").withColumn("is_dir", F.lit(False)), o.where("o_orderkey % 3 <> 0").withColumn("is_dir", F.col("o_orderkey") % 5 == 0)


@query(f"""{WALK} SELECT c.full_path, CASE WHEN w.full_path IS NOT NULL THEN 'type' WHEN starts_with(c.full_path, '5-LOW/') THEN 'excluded' ELSE 'gone' END AS why
    FROM cached c LEFT JOIN walked w USING (full_path) WHERE w.is_dir OR (w.full_path IS NULL AND (starts_with(c.full_path, '5-LOW/') OR NOT (starts_with(c.full_path, '2-HIGH/') OR starts_with(c.full_path, '1-URGENT/7/'))))""")
def removal_reasons(spark, d):
    cached, walked = _walk(spark, d)
    scopes = values(spark, [("5-LOW", "excluded"), ("2-HIGH", "protected"), ("1-URGENT/7", "unreadable")], "path string, kind string")
    return live.removals(cached, walked, scopes).select("full_path", "why")


@query("SELECT 'u' || user_id AS full_path, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def keep_last_rows(spark, d):
    rows = t(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, "u").otherwise("U"), "user_id").alias("full_path"), "ts", "event_id")
    return live.keep_last(rows, ["ts", "event_id"]).select(F.lower("full_path").alias("full_path"), "event_id")


@query("SELECT c_custkey, c_custkey % 9 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS open_count FROM customer")
def open_counts(spark, d):
    items = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("full_path"), (F.col("c_custkey") % 9).alias("open_count"))
    opened = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("full_path"))
    return live.count_opens(items, opened).select("c_custkey", "open_count")


@query("""WITH items AS (SELECT 'c' || c_custkey AS full_path, true AS is_dir, CAST(0 AS BIGINT) AS size_bytes FROM customer UNION ALL SELECT 'c' || o_custkey || '/' || o_orderkey, false, CAST(1 AS BIGINT) FROM orders)
    SELECT i.full_path, i.is_dir, i.size_bytes FROM items i WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 6 = 1 AND (i.full_path = 'c' || c_custkey OR starts_with(i.full_path, 'c' || c_custkey || '/')))
    UNION ALL SELECT 'c' || c_custkey, false, CAST(77 AS BIGINT) FROM customer WHERE c_custkey % 6 = 1""")
def upserted_state(spark, d):
    """Every sixth customer's folder becomes a file: what was in it goes."""
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("full_path"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size_bytes"), "c_custkey")
    o = t(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey", F.lit("/"), "o_orderkey"), F.lit(False), F.lit(1).cast("long"), F.lit(0).cast("long"))
    delta = c.where("c_custkey % 6 = 1").select("full_path", F.lit(False).alias("is_dir"), F.lit(77).cast("long").alias("size_bytes"))
    return live.upsert_state(c.union(o).drop("c_custkey"), delta)


@query("""WITH items AS (SELECT o_custkey, o_orderkey, 'c' || o_custkey || '/' || o_orderkey AS full_path, o_orderkey % 11 AS open_count FROM orders)
    SELECT CASE WHEN o_custkey % 5 = 1 THEN 'moved' || o_custkey || '/' || o_orderkey ELSE full_path END AS full_path, open_count FROM items WHERE o_custkey % 5 <> 2 AND o_orderkey % 13 <> 5
    UNION ALL SELECT full_path, open_count FROM items WHERE o_custkey % 5 NOT IN (1, 2) AND o_orderkey % 13 = 5
    UNION ALL SELECT 'moved' || o_custkey || '/' || o_orderkey, open_count FROM items WHERE o_custkey % 5 = 1 AND o_orderkey % 13 = 5
    UNION ALL SELECT 'new' || c_custkey, 0 FROM customer WHERE c_custkey % 5 = 3""")
def event_batch(spark, d):
    """Folders of customers are renamed or deleted, files are modified and made; opens go along with renames."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    path = F.concat(F.lit("c"), "o_custkey", F.lit("/"), "o_orderkey")
    items = o.select(path.alias("full_path"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size_bytes"), F.lit("a").alias("modified"), (F.col("o_orderkey") % 11).alias("open_count"))
    none = F.lit(None).cast("string")
    event = lambda df, n, kind, full, old, is_dir: df.select((F.lit(n * 10**8) + F.monotonically_increasing_id() % 1000).alias("ordinal"), F.lit(kind).alias("kind"), full.alias("full_path"), old.alias("old_path"), F.lit(is_dir).alias("is_dir"), F.lit(2).cast("long").alias("size_bytes"), F.lit("b").alias("modified"))
    folder = F.concat(F.lit("c"), "c_custkey")
    batch = event(o.where("o_orderkey % 13 = 5 AND o_custkey % 5 NOT IN (1, 2)"), 1, "modified", path, none, False)
    batch = batch.union(event(c.where("c_custkey % 5 = 1"), 2, "renamed", F.concat(F.lit("moved"), "c_custkey"), folder, True))
    batch = batch.union(event(c.where("c_custkey % 5 = 2"), 3, "deleted", folder, none, True))
    batch = batch.union(event(c.where("c_custkey % 5 = 3"), 4, "created", F.concat(F.lit("new"), "c_custkey"), none, False))
    batch = batch.union(event(c.where("c_custkey % 5 = 4"), 5, "created", F.concat(F.lit("brief"), "c_custkey"), none, False)).union(event(c.where("c_custkey % 5 = 4"), 6, "deleted", F.concat(F.lit("brief"), "c_custkey"), none, False))
    return live.apply_events(items, batch).select("full_path", "open_count")


# Links of records


LINKS = """WITH entries AS (SELECT 100 + n_nationkey AS file_ref, CAST(5 AS BIGINT) AS parent_ref, n_name AS name, true AS is_dir FROM nation UNION ALL
      SELECT 10000 + c_custkey, 100 + c_nationkey, c_name, false FROM customer)"""


def _entries(spark, d):
    meta = [F.lit(0).cast("long").alias(c) for c in links.META]
    n = t(spark, d, "nation").select((F.lit(100) + F.col("n_nationkey")).cast("long").alias("file_ref"), F.lit(5).cast("long").alias("parent_ref"), F.col("n_name").alias("name"), F.lit(True).alias("is_dir"), *meta)
    c = t(spark, d, "customer").select((F.lit(10000) + F.col("c_custkey")).cast("long").alias("file_ref"), (F.lit(100) + F.col("c_nationkey")).cast("long").alias("parent_ref"), F.col("c_name").alias("name"), F.lit(False).alias("is_dir"), *meta)
    root = values(spark, [(5, 5, "root", True, 0, 0, 0, 0)], links.ENTRY_SCHEMA)
    return root.unionByName(n).unionByName(c)


def _batch(spark, d):
    """Customers deleted, moved, renamed, put under an unknown folder or into new nested ones; two nations deleted."""
    e = _entries(spark, d).where("file_ref >= 10000").withColumn("k", F.col("file_ref") - 10000)
    none = [F.lit(None).cast("long").alias("previous_parent"), F.lit(None).cast("string").alias("previous_name")]
    same = [F.col(c) for c in links.ENTRY]
    put = lambda df, n, kind: df.select((F.lit(n * 10**7) + F.col("k")).cast("long").alias("ordinal"), F.lit(kind).alias("kind"), *same, *none)
    moved = lambda rest, parent: e.where(f"k % 10 = {rest}").withColumn("parent_ref", F.lit(parent).cast("long"))
    parts = put(e.where("k % 10 = 1"), 1, "delete").union(put(moved(2, 101), 1, "upsert")).union(put(moved(3, 999), 1, "upsert")).union(put(moved(4, 7001), 1, "upsert"))
    parts = parts.union(put(e.where("k % 10 = 5").withColumn("name", F.concat("name", F.lit("!"))), 1, "upsert"))
    dirs = values(spark, [(10**8 + 2, "upsert", 7001, 7000, "inner", True, 0, 0, 0, 0, None, None), (10**8 + 3, "upsert", 7000, 5, "outer", True, 0, 0, 0, 0, None, None), (10**8 + 4, "delete", 102, 5, "x", True, 0, 0, 0, 0, None, None), (10**8 + 5, "upsert", 3, 5, "system", True, 0, 0, 0, 0, None, None)], links.CHANGE_SCHEMA)
    return parts.union(dirs)


@query(f"""{LINKS}, k AS (SELECT *, file_ref - 10000 AS k FROM entries),
    a AS (SELECT file_ref, CASE WHEN k < 0 THEN parent_ref WHEN k % 10 = 2 THEN 101 WHEN k % 10 = 4 THEN 7001 ELSE parent_ref END AS parent_ref, CASE WHEN k % 10 = 5 AND k > 0 THEN name || '!' ELSE name END AS name FROM k WHERE k < 0 OR k % 10 <> 1)
    SELECT file_ref, parent_ref, name FROM a WHERE parent_ref <> 102 AND file_ref <> 102 UNION ALL SELECT 5, 5, 'root' UNION ALL SELECT 7000, 5, 'outer' UNION ALL SELECT 7001, 7000, 'inner'""")
def apply_batch(spark, d):
    return links.apply_batch(_entries(spark, d), _batch(spark, d), 5)[0].select("file_ref", "parent_ref", "name")


@query("""SELECT count(*) FILTER (c_custkey % 10 IN (1, 2, 4, 5) AND NOT (c_custkey % 10 = 2 AND c_nationkey = 1)) + 3 AS applied, count(*) FILTER (c_custkey % 10 = 3 OR (c_custkey % 10 = 2 AND c_nationkey = 1)) + 1 AS skipped FROM customer""")
def batch_counts(spark, d):
    return links.counts(links.apply_batch(_entries(spark, d), _batch(spark, d), 5)[1])


def _states(spark, d):
    """Of every third customer: renamed, gone, or with a second link."""
    e = _entries(spark, d).where("file_ref >= 10000").withColumn("k", F.col("file_ref") - 10000).where("k % 3 = 0")
    state = lambda df: df.select(F.col("k").alias("position"), "record_ref", *links.ENTRY)
    e = e.withColumn("record_ref", F.col("file_ref"))
    named = e.where("k % 9 = 0").withColumn("name", F.concat("name", F.lit(".new")))
    gone = e.where("k % 9 = 3").withColumns({c: F.lit(None).cast(e.schema[c].dataType) for c in links.ENTRY})
    second = e.where("k % 9 = 6").withColumns({"parent_ref": F.lit(101).cast("long"), "name": F.concat("name", F.lit(".link"))})
    return state(named).union(state(gone)).union(state(e.where("k % 9 = 6"))).union(state(second))


@query(f"""{LINKS}, k AS (SELECT *, file_ref - 10000 AS k FROM entries) SELECT file_ref, parent_ref, CASE WHEN k >= 0 AND k % 9 = 0 THEN name || '.new' ELSE name END AS name FROM k WHERE k < 0 OR k % 9 <> 3
    UNION ALL SELECT file_ref, 101, name || '.link' FROM k WHERE k >= 0 AND k % 9 = 6 UNION ALL SELECT 5, 5, 'root'""")
def reconcile_links(spark, d):
    return links.reconcile_records(_entries(spark, d), _states(spark, d), 5)[0].select("file_ref", "parent_ref", "name")


@query("""WITH n AS (SELECT c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_name || '.new' FROM customer WHERE c_custkey % 9 = 0 UNION SELECT c_name || '.link' FROM customer WHERE c_custkey % 9 = 6)
    SELECT CASE WHEN count(*) <= 4096 THEN count(*) ELSE -1 END AS names, false AS directories FROM n""")
def reconcile_impact(spark, d):
    impact = links.reconcile_records(_entries(spark, d), _states(spark, d), 5)[2]
    return impact.select(F.coalesce(F.size("names"), F.lit(-1)).cast("long").alias("names"), "directories")


# Feeds


RECORDS = """WITH r AS (SELECT event_id + 1 AS usn, 1000 + user_id AS file_ref, 20 + user_id % 5 AS parent_ref, CASE event_type WHEN 'signup' THEN 256 WHEN 'error' THEN 512 WHEN 'purchase' THEN 2048 ELSE 2 END AS reason, 'u' || user_id AS name FROM events)"""


def _records(spark, d):
    reason = F.when(F.col("event_type") == "signup", feeds.CREATE).when(F.col("event_type") == "error", feeds.DELETE).when(F.col("event_type") == "purchase", feeds.SECURITY).otherwise(2)
    return t(spark, d, "events").select((F.col("event_id") + 1).alias("usn"), (F.lit(1000) + F.col("user_id")).cast("long").alias("file_ref"), (F.lit(20) + F.col("user_id") % 5).cast("long").alias("parent_ref"), reason.cast("long").alias("reason"), F.lit(0).cast("long").alias("attributes"), F.concat(F.lit("u"), "user_id").alias("name"))


FOLDERS = [(20, 5, "a"), (21, 20, "b"), (22, 21, "c"), (23, 99, "lost")]


@query(f"""{RECORDS}, p AS (SELECT * FROM (VALUES (20, 'C:\\a'), (21, 'C:\\a\\b'), (22, 'C:\\a\\b\\c')) AS v(ref, path))
    SELECT max(usn) AS usn, path || '\\' || name AS path, CASE WHEN bool_or(reason = 512) THEN 'deleted' WHEN bool_or(reason = 256) THEN 'created' ELSE 'modified' END AS kind, bool_or(reason = 2048) AS refresh_subtree
    FROM r JOIN p ON parent_ref = ref GROUP BY file_ref, path, name""")
def journal_events(spark, d):
    """Records in known folders, nested ones too; two folders do not resolve."""
    folders = values(spark, FOLDERS, "file_ref long, parent_ref long, name string")
    return feeds.project_journal(_records(spark, d), folders).select("usn", "path", "kind", "refresh_subtree")


@query("SELECT 'C:\\one\\two\\f' || c_custkey AS path, 'created' AS kind, '' AS old_path FROM customer UNION ALL SELECT 'C:\\one', 'created', '' UNION ALL SELECT 'C:\\one\\two', 'created', '' UNION ALL SELECT 'C:\\new\\x.txt', 'modified', '' UNION ALL SELECT 'C:\\new', 'renamed', 'C:\\old'")
def nested_new_folders(spark, d):
    """Files in a new folder in a new folder; a file in a folder that was renamed before."""
    c = t(spark, d, "customer").select((F.lit(100) + F.col("c_custkey")).alias("usn"), (F.lit(1000) + F.col("c_custkey")).cast("long").alias("file_ref"), F.lit(31).cast("long").alias("parent_ref"), F.lit(feeds.CREATE).cast("long").alias("reason"), F.lit(0).cast("long").alias("attributes"), F.concat(F.lit("f"), "c_custkey").alias("name"))
    more = [(1, 30, 5, feeds.CREATE, 16, "one"), (2, 31, 30, feeds.CREATE, 16, "two"), (3, 40, 5, feeds.OLD_NAME, 16, "old"), (4, 40, 5, feeds.NEW_NAME, 16, "new"), (5, 41, 40, 2, 0, "x.txt")]
    records = c.unionByName(values(spark, more, journal.RECORD))
    out = feeds.project_journal(records, values(spark, [(40, 5, "old")], "file_ref long, parent_ref long, name string"))
    return out.select("path", "kind", F.coalesce("old_path", F.lit("")).alias("old_path"))


@query("SELECT * FROM (VALUES ('good', ''), ('root', 'root-identity-changed'), ('name', 'feed-state-invalid'), ('twice', 'feed-state-invalid')) AS v(batch, gap)")
def journal_gaps(spark, d):
    batches = {"good": [(1, 50, 5, 2, 0, "x")], "root": [(1, 5, 5, feeds.OLD_NAME, 16, "r")], "name": [(1, 50, 5, 2, 0, "a\\b")], "twice": [(1, 50, 5, feeds.OLD_NAME, 0, "x"), (2, 50, 5, feeds.OLD_NAME, 0, "x")]}
    parts = [feeds.journal_gap(values(spark, rows, journal.RECORD), 5).select(F.lit(k).alias("batch"), F.coalesce("gap", F.lit("")).alias("gap")) for k, rows in batches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"{RECORDS}, f AS (SELECT file_ref, min(usn) AS first_usn FROM r GROUP BY file_ref), o AS (SELECT *, row_number() OVER (ORDER BY first_usn, file_ref) AS i FROM f) SELECT file_ref, first_usn, (SELECT coalesce(min(first_usn) FILTER (i > 12), (SELECT max(usn) + 1 FROM r)) FROM o) AS next_usn FROM o WHERE i <= 12")
def changed_files_page(spark, d):
    return feeds.changed_files(_records(spark, d), 12)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'renamed' ELSE 'modified' END AS kind, 'd' || (user_id % 4) || '/f' || user_id AS path, CASE WHEN event_type = 'signup' THEN 'd' || (event_id % 4) || '/g' || user_id END AS old_path, user_id % 4 < 2 AS seen, event_id % 4 < 2 AS old_seen FROM events)
    SELECT event_id, coalesce(CASE WHEN kind = 'modified' THEN CASE WHEN seen THEN 'modified' END WHEN seen AND old_seen THEN 'renamed' WHEN old_seen THEN 'deleted' WHEN seen THEN 'created' END, 'none') AS kind,
      coalesce(CASE WHEN kind = 'modified' THEN CASE WHEN seen THEN path END WHEN seen THEN path WHEN old_seen THEN old_path END, '') AS path, NOT seen OR (kind = 'renamed' AND NOT old_seen) AS withheld FROM e""")
def withheld_events(spark, d):
    """Two of four folders may be listed."""
    renamed = F.col("event_type") == "signup"
    events = t(spark, d, "events").select("event_id", F.when(renamed, "renamed").otherwise("modified").alias("kind"), F.concat(F.lit("d"), F.col("user_id") % 4, F.lit("/f"), "user_id").alias("path"), F.when(renamed, F.concat(F.lit("d"), F.col("event_id") % 4, F.lit("/g"), "user_id")).alias("old_path"))
    ends = events.select("path").union(events.where("old_path IS NOT NULL").select("old_path")).distinct()
    visible = ends.where("path LIKE 'd0/%' OR path LIKE 'd1/%'").union(values(spark, [("d0",), ("d1",)], "path string"))
    out = changes.withheld_events(events, visible)
    return out.select("event_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("path", F.lit("")).alias("path"), "withheld")


@query("SELECT event_id FROM events WHERE (user_id % 3 = 0 AND event_id % 2 = 1) OR (user_id % 3 = 1 AND event_id % 2 = 0)")
def current_deliveries(spark, d):
    """Deliveries of the generation that their root is subscribed with; the third root is not subscribed."""
    rows = t(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("root"), (F.col("event_id") % 2).alias("generation"))
    return changes.current_deliveries(rows, values(spark, [(0, 1), (1, 0)], "root long, generation long")).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, 64 + length('r/' || event_type) AS cost, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE user_id % 2 = 0),
      f AS (SELECT event_id, i, cost AS held, 0::BIGINT AS page FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.i, CASE WHEN f.held + e.cost > 5000 THEN e.cost ELSE f.held + e.cost END, CASE WHEN f.held + e.cost > 5000 THEN f.page + 1 ELSE f.page END FROM f JOIN e ON e.i = f.i + 1)
    SELECT event_id, page, min(event_id) OVER (PARTITION BY page) AS resume FROM f""")
def delivery_walk(spark, d):
    """Events of the current generation in pages of 5,000 bytes, with the place where each page begins."""
    rows = t(spark, d, "events").select(F.col("event_id").cast("long").alias("sequence"), F.lit(0).alias("delivery"), F.lit(0).alias("event"), F.lit("r").alias("root"), (F.col("user_id") % 2).alias("generation"), F.lit(False).alias("gap"), F.lit(False).alias("fault"), F.concat(F.lit("r/"), "event_type").alias("path"), F.lit(None).cast("string").alias("old_path"))
    out = changes.project_pages(rows, values(spark, [("r", 0)], "root string, generation long"), 5000)
    return out.select(F.col("sequence").alias("event_id"), "page", F.col("resume.sequence").alias("resume"))


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'renamed,deleted' WHEN user_id % 2 = 0 THEN 'renamed' WHEN event_id % 3 = 0 THEN 'deleted' WHEN event_id % 3 = 1 THEN 'created' ELSE 'modified' END AS kinds FROM events""")
def emitted_kinds(spark, d):
    """A rename comes first, then a deletion; else what is left of created and modified."""
    e = t(spark, d, "events")
    moved = F.col("user_id") % 2 == 0
    out = changes.emit_kind(F.when(moved, F.lit("a/x")), F.when(moved, F.lit("b/x")).otherwise(F.lit("a/x")), F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1, F.lit(True))
    return e.select("event_id", F.array_join(F.transform(out, lambda x: x["kind"]), ",").alias("kinds"))


@query("SELECT CAST(user_id % 3 AS VARCHAR) AS root, event_type AS kind, count(*) AS n FROM events WHERE event_id <= 300 GROUP BY ALL")
def queued_events(spark, d):
    """The first page of a journal through the queue: written in entries of 4 KB, read back whole, acknowledged."""
    rows = t(spark, d, "events").where("event_id <= 300").select((F.col("user_id") % 3).cast("string").alias("root"), F.lit(1).cast("long").alias("generation"), F.lit(None).cast("string").alias("gap"), F.lit(None).cast("string").alias("fault"), F.col("event_id").cast("long").alias("position"), F.col("event_type").alias("kind"), F.concat(F.lit("p"), "event_id").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit(False).alias("is_dir"))
    queue = Queue(spark, shared_path(spark, "queue"), 4096)
    written = queue.enqueue(rows, "C", 0, 300)
    held = materialize(queue.read(written).groupBy("root", "kind").agg(F.count("*").alias("n")), "queued")
    queue.ack(written[-1])
    return held


# Sources and stores


@query(f"{RECORDS} SELECT usn, file_ref, parent_ref, reason, name FROM r WHERE usn >= 100 AND usn < 900")
def journal_range(spark, d):
    """Records to bytes and back, a buffer for each hundred, read from one position to another."""
    rows = _records(spark, d).withColumn("page", F.floor(F.col("usn") / 100))

    def encode(pdf):
        import pandas as pd

        own = [tuple(r) for r in pdf.sort_values("usn")[["usn", "file_ref", "parent_ref", "reason", "attributes", "name"]].astype(object).itertuples(index=False)]
        return pd.DataFrame({"from_usn": [int(pdf["usn"].min())], "next_usn": [int(pdf["usn"].max()) + 1], "content": [journal.encode_journal(int(pdf["usn"].max()) + 1, own)]})

    pages = rows.groupBy("page").applyInPandas(encode, "from_usn long, next_usn long, content binary")
    return journal.read_range(pages, 100, 900).select("usn", "file_ref", "parent_ref", "reason", "name")


@query("SELECT 10000 + c_custkey AS file_ref, 100 + c_nationkey AS parent_ref, c_name AS name, CAST(c_custkey AS BIGINT) AS size_bytes FROM customer WHERE c_custkey % 4 = 0")
def packed_entries(spark, d):
    """Entries as Base64 and back."""
    rows = t(spark, d, "customer").where("c_custkey % 4 = 0").select((F.lit(10000) + F.col("c_custkey")).cast("long").alias("file_ref"), (F.lit(100) + F.col("c_nationkey")).cast("long").alias("parent_ref"), F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("size_bytes"))

    def around(frames):
        for pdf in frames:
            text = codecs.pack_entries((r.file_ref, r.parent_ref, r.name, 32, r.size_bytes, 0, 0) for r in pdf.itertuples())
            back = codecs.unpack_entries(text)
            yield type(pdf)([(a, b, n, s) for a, b, n, _, s, *_ in back], columns=["file_ref", "parent_ref", "name", "size_bytes"])

    return rows.mapInPandas(around, rows.schema)


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders")
def snapshot_rows(spark, d):
    """Saved, checked against its manifest and loaded."""
    rows = t(spark, d, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS price")
    root = shared_path(spark, "snapshot")
    assert logs.commit(rows, root, 0, "first", "k") and not logs.commit(rows, root, 0, "first", "k")
    return logs.load_snapshot(spark, root, 1, {"batch": "first"})


@query("SELECT c_custkey::VARCHAR AS full_path, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS name, (c_custkey % 9) + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS open_count FROM customer")
def stored_files(spark, d):
    """A store's files after an upsert, which keeps open counts, and after some were opened."""
    c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("full_path"), F.lit("old").alias("name"), (F.col("c_custkey") % 9).alias("open_count"))
    s = store.Store(spark, shared_path(spark, "store"))
    s.upsert("files", c, "one")
    s.upsert("files", c.where("full_path % 2 = 0").withColumns({"name": F.lit("new"), "open_count": F.lit(0).cast("long")}), "two")
    s.opened(c.where("full_path % 10 = 0").select("full_path"), "three")
    return s.read("files")


@query("SELECT c_name AS name, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS files, count(o_orderkey) FILTER (o_orderstatus = 'P') AS dirs, count(o_orderkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def children_kinds(spark, d):
    o = t(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "P").alias("is_dir"))
    out = profile.children_kinds(t(spark, d, "customer"), o, "c_custkey", "o_custkey")
    return out.join(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.col("c_name").alias("name"), "files", "dirs", "total")


@query(f"""{TREE}, i AS (SELECT path, starts_with(path, 'world/ASIA') AS a, starts_with(path || '/', 'world/ASIA/NATION_2/') OR starts_with(path, 'world/EUROPE') AS b FROM tree)
    SELECT 'world/ASIA' AS root, count(*) FILTER (a) AS items, CAST(0 AS BIGINT) AS overlap FROM i UNION ALL SELECT 'world/ASIA/NATION_2', count(*) FILTER (starts_with(path || '/', 'world/ASIA/NATION_2/')), count(*) FILTER (starts_with(path || '/', 'world/ASIA/NATION_2/')) FROM i
    UNION ALL SELECT 'world/EUROPE', count(*) FILTER (starts_with(path, 'world/EUROPE')), CAST(0 AS BIGINT) FROM i""")
def scanned_roots(spark, d):
    rows = tree_of(spark, d).select(F.col("path").alias("full_path"))
    return profile.scan_roots(rows, ["world/ASIA", "world/ASIA/NATION_2", "world/EUROPE"])[1]


@query("""SELECT count(*) FILTER (length(o_comment) > 30) AS long_paths, count(*) FILTER (regexp_matches(o_clerk, '\\s')) AS with_space, count(*) FILTER (contains(o_clerk, '%')) AS with_percent, count(*) FILTER (o_orderkey & 1024 <> 0) AS links,
    count(*) FILTER (o_orderkey & 2 <> 0) AS hidden, count(*) FILTER (o_orderkey & 4 <> 0) AS system FROM (SELECT *, o_orderpriority || o_orderkey AS o_comment, o_orderpriority AS o_clerk FROM orders)""")
def attribute_counts(spark, d):
    o = t(spark, d, "orders").select(F.concat("o_orderpriority", "o_orderkey").alias("path"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("attributes"))
    return profile.special_counts(o, "path", 30, "name", "attributes")


@query("SELECT count(*) AS metrics FROM (SELECT DISTINCT user_id, event_type FROM events)")
def metric_count(spark, d):
    return metrics.distinct_metrics(t(spark, d, "events"), ["user_id", "event_type"])


@query("""WITH r AS (SELECT l_suppkey AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
      m AS (SELECT k, median(v) AS m FROM r WHERE i > n - 3 GROUP BY k), b AS (SELECT r.*, abs((v - m) / m * 100) > 60 AS off FROM r JOIN m USING (k))
    SELECT k, CASE WHEN max(n) <= 3 THEN max(n) ELSE least(max(n), greatest(3, coalesce(max(i) FILTER (off), 0) + 1)) END AS settled FROM b GROUP BY k""")
def warm_up_runs(spark, d):
    runs = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), F.col("l_extendedprice").alias("v"))
    return metrics.warm_up(runs, ["k"], "run", "v", 60.0)


@query("""WITH s AS (SELECT l_suppkey AS k, l_orderkey AS sec, min(l_quantity) OVER w AS lo, max(l_quantity) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT k, coalesce(min(sec) FILTER (lo > 0 AND (hi - lo) / lo <= 0.5 AND sec > 0), max(sec)) AS idle FROM s GROUP BY k""")
def idle_times(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("sec"), "l_quantity")
    return metrics.idle_seconds(rows, ["k"], "sec", ("l_quantity",), 0.5)


@query("SELECT s_suppkey, (s_acctbal + (s_acctbal * 3)) / 2 AS reference FROM supplier")
def paired_references(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", metrics.paired_reference(F.col("s_acctbal"), F.col("s_acctbal") * 3).alias("reference"))


# Values: names and paths that the tables do not have


@query("""SELECT * FROM (VALUES ('Işık', 'ışık|isik'), ('İstanbul-2', 'istanbul|2'), ('görüşme notu', 'görüşme|gorusme|notu'), ('a a', 'a|a'), ('', '')) AS v(name, tokens)""")
def turkish_tokens(spark, d):
    rows = values(spark, [("Işık",), ("İstanbul-2",), ("görüşme notu",), ("a a",), ("",)], "name string")
    return rows.select("name", F.array_join(tx.tokenize("name"), "|").alias("tokens"))


@query("""SELECT * FROM (VALUES ('Çiğdem', 'Cigdem', 'CIGDEM'), ('ızmır', 'izmir', 'IZMIR'), ('naïve', 'naive', 'NAIVE'), ('plain', 'plain', 'PLAIN')) AS v(name, folded, plain)""")
def folded_names(spark, d):
    rows = values(spark, [("Çiğdem",), ("ızmır",), ("naïve",), ("plain",)], "name string")
    return rows.select("name", tx.fold("name").alias("folded"), F.upper(tx.fold_native(F.col("name"))).alias("plain"))


@query("""SELECT * FROM (VALUES ('C:/a/./b//c', 'C:\\a\\b\\c', true), ('C:\\a\\..\\b', 'C:\\b', false), ('C:\\A\\x', 'C:\\A\\x', true), ('C:\\..\\x', '', false), ('C:\\ab', 'C:\\ab', false), ('C:\\a\\b.', '', false)) AS v(path, canonical, inside)""")
def canonical_paths(spark, d):
    rows = values(spark, [(p,) for p in ("C:/a/./b//c", "C:\\a\\..\\b", "C:\\A\\x", "C:\\..\\x", "C:\\ab", "C:\\a\\b.")], "path string")
    return rows.select("path", F.coalesce(codecs.canonical_path(F.col("path")), F.lit("")).alias("canonical"), codecs.contained(F.col("path"), F.lit("C:\\a")).alias("inside"))


@query("""SELECT * FROM (VALUES ('C:\\p\\.git\\x', true), ('C:\\p\\a.TMP', true), ('C:\\p\\binary\\a', false), ('C:\\node_modules\\a', true)) AS v(path, left_out)""")
def watcher_exclusions(spark, d):
    rows = values(spark, [(p,) for p in ("C:\\p\\.git\\x", "C:\\p\\a.TMP", "C:\\p\\binary\\a", "C:\\node_modules\\a")], "path string")
    return rows.select("path", kinds.excluded(F.col("path")).alias("left_out"))


@query("""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def tick_times(spark, d):
    """Times as counts of 100 ns since year 1 and since 1601, and back."""
    seconds = F.unix_timestamp("o_orderdate")
    o = t(spark, d, "orders")
    return o.select("o_orderkey", tx.ticks_to_seconds(seconds * 10_000_000 + F.lit(621355968000000000)).alias("seconds"), F.date_format(tx.filetime_to_timestamp(seconds * 10_000_000 + F.lit(116444736000000000)), "yyyy-MM-dd").alias("day"))


@query("""SELECT * FROM (VALUES ('img_1.JPG', 'Tatil-1.JPG'), ('İMG_ı.txt', 'Tatil-ı.txt'), ('x.', 'x.'), ('klasör', 'klasör')) AS v(name, renamed)""")
def turkish_renames(spark, d):
    rows = values(spark, [("img_1.JPG",), ("İMG_ı.txt",), ("x.",), ("klasör",)], "name string")
    return rows.select("name", rename.new_name(F.col("name"), F.col("name") == "klasör", F.lit(1), 1, rename.Rules(find="ımg_", replace="Tatil-")).alias("renamed"))


@query("""WITH b AS (SELECT o_orderkey, o_orderkey & 281474976710655 AS record, o_orderkey // 281474976710656 AS seq, o_orderkey & 2147483648 <> 0 AS dead, bit_count(o_orderkey) * 50.0 AS score FROM orders) SELECT * FROM b""")
def bit_facts(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", codecs.record_number(k).alias("record"), codecs.sequence_number(k).alias("seq"), codecs.is_dead(k).alias("dead"), codecs.popcount_score(k).alias("score"))


@query("SELECT c_custkey, c_custkey // 16 AS slice FROM customer")
def preparation_slices(spark, d):
    return store.slices(t(spark, d, "customer").select("c_custkey"), "c_custkey", 16)


NEW = [n for n in catalogue.QUERIES if n not in KNOWN]
