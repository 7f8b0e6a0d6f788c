"""Queries over the provided tables and the same in SQL.

`part` stands for files with names, `region > nation > customer > orders` for a tree, `orders` and `events` for change
feeds, `documents`, `pages` and `conversations` for names and texts. `now` is always a fixed value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.functions import text as tx
from filigrane.operators import changes, metrics, profile, rename, retrieval, search, tree, views
from filigrane.plans import intent

NOW = "1998-09-02 12:00:00"
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_items(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files; how often one was ordered (modulo 7) counts as its opens, its last shipping as its change."""
    facts = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg((F.count("*") % 7).alias("opens"), F.max("l_shipdate").alias("modified"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("parent_path"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("size_bytes"))
    return p.join(facts, "item_id", "left").withColumns({"open_count": F.coalesce("opens", F.lit(0)), "is_dir": F.lit(False), "full_path": F.concat_ws("/", "parent_path", "name")}).drop("opens")


ITEMS = """
    WITH facts AS (SELECT l_partkey, count(*) % 7 AS opens, max(l_shipdate) AS modified FROM lineitem GROUP BY l_partkey),
    items AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS parent_path, p_type AS kind, CAST(p_size AS BIGINT) AS size_bytes,
                     coalesce(opens, 0) AS open_count, modified, p_brand || '/' || p_name AS full_path, string_split(p_name, ' ') AS tokens
              FROM part LEFT JOIN facts ON p_partkey = l_partkey)"""


def ranked(rows: DataFrame, keys: list, *columns: str) -> DataFrame:
    """A bounded result with its position, so that the order itself is compared."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("position", *columns)


# Literal and token search


def _literal(spark, d, sort):
    found = retrieval.literal(part_items(spark, d), "WID")
    keys = [*sort.keys(), F.col("item_id")]
    return ranked(views.top(found, keys, 100), keys, "item_id", "name")


def _literal_sql(order):
    return f"""{ITEMS} SELECT row_number() OVER (ORDER BY {order}) AS position, item_id, name FROM items
               WHERE contains(lower(name), 'wid') ORDER BY position LIMIT 100"""


@query(_literal_sql("lower(name), lower(name), lower(full_path), full_path, item_id"))
def literal_search_name_asc(spark, d):
    return _literal(spark, d, views.ItemSort("name"))


@query(_literal_sql("size_bytes DESC NULLS LAST, lower(name), lower(full_path), full_path, item_id"))
def literal_search_size_desc(spark, d):
    return _literal(spark, d, views.ItemSort("size"))


@query(_literal_sql("modified DESC NULLS LAST, lower(name), lower(full_path), full_path, item_id"))
def literal_search_modified_desc(spark, d):
    return _literal(spark, d, views.ItemSort("modified"))


@query(f"""{ITEMS}, named AS (SELECT item_id, name || '.' || replace(kind, ' ', '_') AS name, replace(kind, ' ', '_') AS ext, parent_path FROM items)
    SELECT row_number() OVER (ORDER BY '.' || lower(ext), lower(name), lower(parent_path || '/' || name), parent_path || '/' || name, item_id) AS position, item_id, name FROM named
    WHERE contains(lower(name), 'wid') ORDER BY position LIMIT 100""")
def literal_search_kind(spark, d):
    """The part's type is the file's extension."""
    named = F.concat_ws(".", "name", F.replace("kind", F.lit(" "), F.lit("_")))
    items = part_items(spark, d).withColumn("name", named).withColumn("full_path", F.concat_ws("/", "parent_path", "name"))
    keys = [*views.ItemSort("kind").keys(), F.col("item_id")]
    return ranked(views.top(retrieval.literal(items, "WID"), keys, 100), keys, "item_id", "name")


@query(f"""{ITEMS}, hits AS (
    SELECT *, CAST(list_contains(tokens, 'cold') AS INT) + CAST(list_contains(tokens, 'widget') AS INT) AS hit,
           len(list_filter(tokens, lambda x: contains(x, 'widget'))) > 0 AND NOT list_contains(tokens, 'widget') AS in_part FROM items)
    SELECT item_id, name, CAST((50.0 * (hit + CAST(in_part AS INT)) + CASE WHEN hit + CAST(in_part AS INT) = 2 THEN 100 ELSE 0 END
           + CASE WHEN lower(name) = 'cold widget' THEN 200 ELSE 0 END + 25.0 * hit + 2.0 * open_count)
           * CASE WHEN hit = 0 AND in_part THEN 0.7 ELSE 1.0 END AS DOUBLE) AS score
    FROM hits WHERE hit > 0 OR in_part ORDER BY score DESC, lower(name), lower(full_path), full_path, item_id LIMIT 50""")
def token_search_scored(spark, d):
    found = search.standard_search(part_items(spark, d), ["cold", "widget"], "cold widget")
    return found.select("item_id", "name", "score")


@query(f"{ITEMS} SELECT DISTINCT item_id FROM (SELECT item_id, unnest(tokens) AS token FROM items) WHERE contains(token, 'ol')")
def partial_match(spark, d):
    return retrieval.partial(retrieval.postings(part_items(spark, d)), "ol")


@query(f"{ITEMS} SELECT DISTINCT item_id FROM (SELECT item_id, unnest(tokens) AS token FROM items) WHERE abs(length(token) - 6) <= 2 AND levenshtein(token, 'wodget') <= 2")
def fuzzy_match(spark, d):
    return retrieval.fuzzy(retrieval.postings(part_items(spark, d)), "wodget", 2)


@query(f"{ITEMS} SELECT DISTINCT item_id FROM (SELECT item_id, unnest(tokens) AS token FROM items) WHERE token = 'widget'")
def fuzzy_gate(spark, d):
    """A token that is there keeps near ones out."""
    return retrieval.fuzzy(retrieval.postings(part_items(spark, d)), "widget", 2)


@query(f"""{ITEMS} SELECT word, distance FROM (SELECT token AS word, levenshtein(token, 'gear') AS distance, min(item_id) AS first_seen
           FROM (SELECT item_id, unnest(tokens) AS token FROM items) GROUP BY token)
           WHERE length(word) BETWEEN 3 AND 64 AND distance <= 3 ORDER BY distance, first_seen, word LIMIT 64""")
def near_words(spark, d):
    words = retrieval.postings(part_items(spark, d)).groupBy(F.col("token").alias("word")).agg(F.min("item_id").alias("first_seen"))
    own = retrieval.near_words(words, "gear", 3, distance=tx.byte_distance)
    return own.select("word", F.col("distance").cast("long").alias("distance"))


@query(f"{ITEMS} SELECT token, count(*) AS items FROM (SELECT DISTINCT item_id, unnest(tokens) AS token FROM items) WHERE token IN ('cold', 'widget', 'none') GROUP BY token")
def exact_postings(spark, d):
    return retrieval.exact(retrieval.postings(part_items(spark, d)), ["cold", "widget", "none"]).groupBy("token").agg(F.count("*").alias("items"))


@query(f"""{ITEMS}, posted AS (SELECT DISTINCT item_id, name, unnest(tokens) AS token FROM items)
    SELECT token, count(*) AS matches, array_to_string(list_sort(list(DISTINCT name))[1:3], '|') AS names FROM posted WHERE token IN ('cold', 'widget') GROUP BY token""")
def token_diagnostics(spark, d):
    items = part_items(spark, d)
    out = retrieval.inspect(retrieval.postings(items), items, ["cold", "widget"])
    return out.select("token", "matches", F.array_join("names", "|").alias("names"))


@query(f"""{ITEMS}, w AS (SELECT DISTINCT item_id, unnest(tokens) AS token FROM items)
    SELECT item_id, max(CASE WHEN token IN ('cold', 'hot') THEN 1 ELSE 0 END) AS first_group, max(CASE WHEN token IN ('widget', 'gear') THEN 1 ELSE 0 END) AS second_group
    FROM w GROUP BY item_id HAVING first_group = 1 AND second_group = 1""")
def anchor_and_or(spark, d):
    """The operator alone decides; tokens of 3 letters match whole, longer ones in part too, and here no name adds any."""
    terms = tuple(search.Term(x, 1.0, g) for g, xs in ((0, ("cold", "hot")), (1, ("widget", "gear"))) for x in xs)
    items = part_items(spark, d)
    rows, none_else = search.gates(items.withColumn("__own", tx.tokenize_ascii(F.col("name"))), F.col("__own"), terms, str.split)
    every, _ = search.anchor_groups(F.col("__own"), terms, str.split, none_else)
    return rows.where(every).select("item_id", F.lit(1).alias("first_group"), F.lit(1).alias("second_group"))


@query(f"""{ITEMS}, c AS (SELECT *,
      CASE WHEN list_contains(tokens, 'widget') THEN 1.0 WHEN len(list_filter(tokens, lambda x: contains(x, 'widget'))) > 0 THEN 0.7 END AS worth FROM items)
    SELECT item_id, CAST(100.0 * worth + CASE WHEN contains(lower(full_path), 'brand#1') THEN 80.0 ELSE 0 END
         + CASE WHEN list_contains(tokens, 'cold') THEN 12.0 ELSE 0 END + 2.0 * open_count AS DOUBLE) AS score
    FROM c WHERE worth IS NOT NULL ORDER BY score DESC, lower(name), lower(full_path), full_path, item_id LIMIT 100""")
def structured_score(spark, d):
    q = search.StructuredQuery(terms=(search.Term("widget"),), context=(search.Term("cold", 0.4),), folder_hints=(("Brand#1", 0.8),))
    found = search.structured_search(part_items(spark, d), q, limit=10**6)
    keys = [F.col("score").desc(), F.lower("name"), F.lower("full_path"), F.col("full_path"), F.col("item_id")]
    return views.top(found, keys, 100).select("item_id", "score")


# Filters, sorts, pages


def _order_items(spark, d):
    o = t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("o"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", ".pdf").when(F.col("o_orderstatus") == "O", ".MP4").otherwise("")).alias("name"),
                    (F.col("o_orderstatus") == "P").alias("is_dir"), (F.col("o_totalprice") * 400).cast("long").alias("size_bytes"), F.col("o_orderdate").alias("modified"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("full_path"))


ORDERS = """WITH items AS (SELECT o_orderkey AS item_id, 'o' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN '.pdf' WHEN 'O' THEN '.MP4' ELSE '' END AS name,
    o_orderstatus = 'P' AS is_dir, CAST(trunc(o_totalprice * 400) AS BIGINT) AS size_bytes, o_orderdate AS modified FROM orders)"""


@query(f"{ORDERS} SELECT item_id FROM items WHERE is_dir OR (size_bytes BETWEEN 1048576 AND 104857600)")
def item_filter_size(spark, d):
    return _order_items(spark, d).where(views.ItemFilter(size="medium").column(F.lit(NOW).cast("timestamp"))).select("item_id")


@query(f"{ORDERS} SELECT item_id FROM items WHERE is_dir OR modified >= TIMESTAMP '{NOW}' - INTERVAL 1 YEAR")
def item_filter_date(spark, d):
    return _order_items(spark, d).where(views.ItemFilter(date="year").column(F.lit(NOW).cast("timestamp"))).select("item_id")


@query(f"{ORDERS} SELECT item_id FROM items WHERE is_dir OR ends_with(name, '.MP4')")
def item_filter_category(spark, d):
    return _order_items(spark, d).where(views.ItemFilter(categories=frozenset({"video", "audio"})).column(F.lit(NOW).cast("timestamp"))).select("item_id")


@query(f"{ORDERS} SELECT item_id FROM items WHERE NOT is_dir AND ends_with(name, '.pdf') AND size_bytes < 1048576")
def item_filter_kind(spark, d):
    return _order_items(spark, d).where(views.ItemFilter(categories=frozenset({"document"}), kind="files", size="small").column(F.lit(NOW).cast("timestamp"))).select("item_id")


@query(f"""{ORDERS} SELECT item_id FROM items WHERE is_dir OR (modified >= TIMESTAMP '1995-01-01' AND modified < TIMESTAMP '1996-01-01'
           AND size_bytes / 1048576.0 BETWEEN 10 AND 60)""")
def catalog_filter_bounds(spark, d):
    f = views.CatalogFilter(modified_from="1995-01-01", modified_before="1996-01-01", min_mb=10, max_mb=60)
    return _order_items(spark, d).where(f.column()).select("item_id")


@query(f"""{ORDERS}, c AS (SELECT items.*, o_orderpriority || '/' || name AS full_path, o_custkey % 5 AS open_count, o_orderpriority FROM items JOIN orders ON o_orderkey = item_id)
    SELECT item_id, name, CAST(200.0 + CASE WHEN ends_with(name, '.pdf') THEN 35 ELSE 0 END + 2.0 * open_count AS DOUBLE) AS score
    FROM c WHERE NOT is_dir AND o_orderpriority = '1-URGENT' AND modified >= TIMESTAMP '1995-01-01' AND modified < TIMESTAMP '1996-01-01' AND size_bytes / 1048576.0 BETWEEN 10 AND 60
    ORDER BY score DESC, lower(name), lower(full_path), full_path LIMIT 100""")
def structured_filter_only(spark, d):
    """A request without keywords; an order's customer (modulo 5) counts as its opens."""
    asked = {"mode": "filter", "target": "file", "folders": ["1-urgent"], "soft_extensions": [".pdf"], "modified_from": "1995-01-01", "modified_to_exclusive": "1996-01-01", "min_mb": 10, "max_mb": 60}
    opens = t(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 5).alias("open_count"))
    items = _order_items(spark, d).join(opens, "item_id").withColumn("full_path", F.concat_ws("/", "full_path", "name"))
    return search.structured_search(items, intent.from_documents(asked, {})).select("item_id", "name", "score")


@query("SELECT page_id FROM pages WHERE len(list_filter(string_split(lower(url), '/'), lambda s: s IN ('es', 'fr'))) > 0")
def path_segment_filter(spark, d):
    return t(spark, d, "pages").where(views.has_segment(F.col("url"), ("es", "FR"))).select("page_id")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS total FROM orders WHERE o_totalprice > 1000
          ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def top_k_offset_total(spark, d):
    rows = t(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey", "o_totalprice")
    return views.page_with_total(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25, 50)


@query(f"""{ITEMS} SELECT item_id, dense_rank() OVER (ORDER BY name) AS name_rank FROM items""")
def dense_name_rank(spark, d):
    return profile.dense_rank(part_items(spark, d).select("item_id", "name"), "name", "name_rank").select("item_id", "name_rank")


# Trees


def _tree_rows(spark, d):
    r = t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir"))
    n = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.lit(True))
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name", F.lit(True))
    o = t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), F.col("o_orderkey").cast("string"), F.lit(False))
    top = spark.createDataFrame([("root", None, "world", True)], "id string, parent_id string, name string, is_dir boolean")
    return top.union(r).union(n).union(c).union(o)


def _tree(spark, d):
    return tree.reachable(_tree_rows(spark, d), "root")


TREE = """WITH RECURSIVE rows AS (
      SELECT 'root' AS id, CAST(NULL AS VARCHAR) AS parent_id, 'world' AS name UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders),
    tree AS (SELECT id, parent_id, name, 0 AS depth, name AS path, CAST([] AS VARCHAR[]) AS ancestors FROM rows WHERE id = 'root'
      UNION ALL SELECT r.id, r.parent_id, r.name, t.depth + 1, t.path || '/' || r.name, list_append(t.ancestors, t.id) FROM rows r JOIN tree t ON r.parent_id = t.id WHERE t.depth < 20)"""


@query(f"{TREE} SELECT id, depth, path FROM tree")
def tree_paths(spark, d):
    return _tree(spark, d).select("id", "depth", "path")


@query(f"{TREE} SELECT id, path FROM tree WHERE list_has_any(ancestors, ['r1', 'n3'])")
def tree_descendants(spark, d):
    return tree.descendants(_tree(spark, d), ["r1", "n3"]).select("id", "path")


@query(f"{TREE} SELECT id, name FROM tree WHERE parent_id = 'n3'")
def tree_children(spark, d):
    return tree.children(_tree(spark, d), "n3").select("id", "name")


@query(f"{TREE} SELECT unnest(ancestors) AS ancestor, id AS descendant FROM tree")
def tree_ancestors(spark, d):
    return tree.closure(_tree(spark, d)).select("ancestor", "descendant")


@query(f"{TREE} SELECT id FROM tree WHERE list_contains(ancestors, 'n3')")
def folder_expansion(spark, d):
    """All that a matched folder is replaced by."""
    rows = _tree(spark, d).select(F.col("id").alias("full_path"), "ancestors", "is_dir", "name")
    matched = rows.where("full_path = 'n3'").drop("ancestors")
    return search.expand_folders(matched, rows, False).select(F.col("full_path").alias("id"))


@query(f"{TREE} SELECT a.ancestor, a.descendant, t.depth - u.depth AS distance FROM (SELECT unnest(ancestors) AS ancestor, id AS descendant FROM tree) a JOIN tree t ON t.id = a.descendant JOIN tree u ON u.id = a.ancestor")
def tree_closure(spark, d):
    """The ancestors of every row and how far they are above it."""
    return tree.closure(_tree(spark, d)).select("ancestor", "descendant", "distance")


@query(f"{TREE} SELECT id, NOT starts_with(id, 'o') AS is_dir FROM tree WHERE list_has_any(ancestors, ['n3', 'r0'])")
def folder_contents(spark, d):
    """A nation and a region of others, in place of which comes all that is below them, each row once."""
    rows = _tree(spark, d).select(F.col("id").alias("full_path"), "ancestors", "is_dir", "name")
    matched = rows.where("full_path IN ('n3', 'r0')").drop("ancestors")
    return search.expand_folders(matched, rows, False).select(F.col("full_path").alias("id"), "is_dir")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01')")
def orphan_rows(spark, d):
    """Customers without a late urgent order."""
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01'")
    return changes.orphans(t(spark, d, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey")


@query(f"{TREE} SELECT t.id FROM tree t LEFT JOIN orders ON t.id = 'o' || o_orderkey WHERE NOT (starts_with(t.id, 'c') AND TRY_CAST(substr(t.id, 2) AS BIGINT) % 4 = 1) AND (o_custkey IS NULL OR o_custkey % 4 <> 1)")
def reachable_rows(spark, d):
    """Rows whose chain of parents is whole: a file or a lost folder on the way cuts off what is below it."""
    rows = _tree_rows(spark, d).where("NOT (id LIKE 'c%' AND coalesce(try_cast(substring(id, 2) AS BIGINT), 0) % 4 = 1)")
    rows = rows.unionByName(t(spark, d, "orders").where("o_custkey % 4 = 1").select(F.concat(F.lit("x"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.lit("lost").alias("name"), F.lit(False).alias("is_dir")))
    return tree.reachable(rows, "root").select("id")


@query(f"{TREE} SELECT id FROM tree WHERE NOT (id IN ('r2', 'n3') OR list_has_any(ancestors, ['r2', 'n3']))")
def cascade_delete(spark, d):
    gone = spark.createDataFrame([("r2",), ("n3",)], "id string")
    return changes.cascade_delete(_tree(spark, d), gone).select("id")


@query("SELECT page_id, list_aggregate(parts[1:greatest(1, len(parts) - 1)], 'string_agg', '/') AS parent, parts[len(parts)] AS leaf, len(parts) AS depth FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '') AS parts FROM pages) WHERE len(parts) > 1")
def path_parts(spark, d):
    parts = tx.segments(F.col("url"))
    rows = t(spark, d, "pages").select("page_id", parts.alias("p")).where(F.size("p") > 1)
    return rows.select("page_id", F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("parent"), F.element_at("p", -1).alias("leaf"), F.size("p").cast("long").alias("depth"))


# Changes


@query("""WITH base AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_custkey % 9 AS opens FROM orders WHERE o_orderkey % 3 <> 0),
      delta AS (SELECT o_orderkey AS k, 'X' AS status, o_totalprice + 1 AS price, 0 AS opens FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(b.k, d.k) AS k, coalesce(d.status, b.status) AS status, coalesce(d.price, b.price) AS price, coalesce(b.opens, d.opens) AS opens FROM base b FULL JOIN delta d ON b.k = d.k""")
def upsert_merge(spark, d):
    o = t(spark, d, "orders")
    base = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "o_orderstatus AS status", "o_totalprice AS price", "o_custkey % 9 AS opens")
    delta = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "'X' AS status", "o_totalprice + 1 AS price", "0L AS opens")
    return changes.upsert(base, delta, "k", preserve=("opens",))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS kind, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0),
      b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'D' ELSE o_orderstatus END AS kind, o_totalprice + o_orderkey % 5 AS price FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' WHEN a.kind <> b.kind THEN 'replace'
      WHEN a.price <> b.price THEN 'update' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.k = b.k) GROUP BY action""")
def reconcile_actions(spark, d):
    o = t(spark, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "o_orderstatus AS kind", "o_totalprice AS price")
    b = o.where("o_orderkey % 4 <> 0").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 11 = 0 THEN 'D' ELSE o_orderstatus END AS kind", "o_totalprice + o_orderkey % 5 AS price")
    return changes.reconcile(a, b, "k", ("price",), "kind").groupBy("action").agg(F.count("*").alias("n"))


def _feed(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "created").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "renamed").otherwise("modified")
    return t(spark, d, "events").select("event_id", "ts", "user_id", kind.alias("kind"))


FEED = """WITH feed AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'purchase' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'renamed' ELSE 'modified' END AS kind FROM events)"""


@query(f"""{FEED}, s AS (SELECT *, kind <> 'modified' AS structural, sum(CASE WHEN kind <> 'modified' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM feed),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment, structural ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, segment, structural) AS merged,
          last_value(event_id) OVER (PARTITION BY user_id, segment, structural ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_event_id FROM s)
    SELECT event_id, kind, merged, last_event_id FROM r WHERE structural OR i = 1""")
def coalesce_events(spark, d):
    return changes.coalesce_events(_feed(spark, d), "user_id", ["ts", "event_id"]).select("event_id", "kind", "merged", "last_event_id")


@query(f"""{FEED}, r AS (SELECT *, max(CASE WHEN kind <> 'modified' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS structural, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) AS i FROM feed)
    SELECT event_id, kind FROM r WHERE kind <> 'modified' OR (structural = 0 AND i = 1)""")
def debounce_batch(spark, d):
    return changes.debounce(_feed(spark, d), "user_id", ["ts", "event_id"]).select("event_id", "kind")


@query(f"""{FEED} SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN max(CASE WHEN kind = 'deleted' THEN 1 ELSE 0 END) = 1 THEN 'deleted'
      WHEN max(CASE WHEN kind = 'renamed' THEN 1 ELSE 0 END) = 1 THEN 'renamed' WHEN max(CASE WHEN kind = 'created' THEN 1 ELSE 0 END) = 1 THEN 'created' ELSE 'modified' END AS kind, count(*) AS records
    FROM feed GROUP BY user_id, day""")
def fold_file_state(spark, d):
    rows = _feed(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return changes.fold_state(rows, ["user_id", "day"], ["ts", "event_id"]).select("user_id", "day", "kind", "records")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey, o_custkey, CAST(trunc(o_totalprice) AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
      f AS (SELECT o_orderkey, o_custkey, i, n AS held, 0::BIGINT AS page FROM n WHERE i = 1
        UNION ALL SELECT n.o_orderkey, n.o_custkey, n.i, CASE WHEN f.held + n.n > 300000 THEN n.n ELSE f.held + n.n END, CASE WHEN f.held + n.n > 300000 THEN f.page + 1 ELSE f.page END
        FROM f JOIN n ON n.o_custkey = f.o_custkey AND n.i = f.i + 1)
    SELECT o_orderkey, page FROM f""")
def delivery_pages(spark, d):
    """A customer's orders in pages of a byte budget; the next page starts with the order that did not fit."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("long").alias("n"))
    return changes.pages_by_size(rows, "o_custkey", ["o_orderkey"], "n", 300_000).select("o_orderkey", "page")


# Profiles


@query("""SELECT source, count(n_chars) AS n, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n_chars, 0.9) AS BIGINT) AS p90, CAST(quantile_disc(n_chars, 0.95) AS BIGINT) AS p95,
          CAST(quantile_disc(n_chars, 0.99) AS BIGINT) AS p99, max(n_chars) AS largest FROM documents GROUP BY source""")
def distribution_summary(spark, d):
    return profile.summarize(t(spark, d, "documents").select("source", "n_chars"), "n_chars", ["source"])


@query("""SELECT CASE WHEN n_chars <= 0 THEN -1 ELSE CAST(floor(log2(n_chars)) AS INT) END AS bucket, count(*) AS n FROM documents GROUP BY bucket""")
def log2_histogram(spark, d):
    return profile.log2_histogram(t(spark, d, "documents"), "n_chars")


def _bucket_sql(value, bounds):
    return "CASE " + " ".join(f"WHEN {value} <= {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


@query(f"SELECT {_bucket_sql('length(url)', profile.LENGTH_BUCKETS)} AS bucket, count(*) AS n FROM pages GROUP BY bucket")
def length_histogram(spark, d):
    return profile.histogram(t(spark, d, "pages").select(F.length("url").alias("x")), "x", profile.LENGTH_BUCKETS)


WORDS = r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)"


def _words(spark, d):
    own = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    return t(spark, d, "documents").select("doc_id", F.explode(own).alias("token"))


@query(f"""{WORDS}, f AS (SELECT token, count(DISTINCT doc_id) AS df FROM w GROUP BY token)
    SELECT {_bucket_sql('df', profile.FANOUT_BUCKETS)} AS bucket, count(*) AS tokens, CAST(sum(df) AS BIGINT) AS edges FROM f GROUP BY bucket""")
def token_df_fanout(spark, d):
    return profile.token_fanout(_words(spark, d).distinct())


@query(f"""{WORDS}, e AS (SELECT token, doc_id, count(*) AS times FROM w GROUP BY token, doc_id), f AS (SELECT token, count(*) AS df, sum(times) AS times FROM e GROUP BY token)
    SELECT count(*) AS tokens, CAST(sum(df) AS BIGINT) AS edges, count(*) FILTER (df = 1) / count(*) AS singleton_ratio, CAST(sum(times) - sum(df) AS DOUBLE) / CAST(sum(times) AS DOUBLE) AS duplicate_ratio,
      CAST(sum(df) FILTER (df > 1) AS DOUBLE) / CAST(sum(df) AS DOUBLE) AS shared_ratio FROM f""")
def token_ratios(spark, d):
    return profile.token_ratios(_words(spark, d), "doc_id")


@query("""WITH c AS (SELECT regexp_extract(url, '(\\.[a-z]+)$', 1) AS e, count(*) AS n FROM pages GROUP BY e), s AS (SELECT CASE WHEN e = '' THEN 'none' WHEN n >= 50 AND n * 1000 >= (SELECT sum(n) FROM c) THEN e ELSE 'other' END AS extension, n FROM c)
    SELECT extension, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY extension""")
def extension_privacy(spark, d):
    rows = t(spark, d, "pages").select(F.regexp_extract("url", r"(\.[a-z]+)$", 1).alias("ext"))
    return profile.extension_profile(rows, "ext")


@query(r"""SELECT count(*) AS lettered, count(*) FILTER (regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]')) AS turkish, count(*) FILTER (regexp_matches(text, '[ıİ]')) AS special_i,
    count(*) FILTER (NOT regexp_matches(core, '[^\p{Lu}]')) AS all_upper, count(*) FILTER (regexp_matches(text, '[Iİ]')) AS folds_differently,
    count(*) FILTER (NOT regexp_matches(text, '[^\x00-\x7F]')) AS ascii FROM (SELECT text, regexp_replace(text, '[^\p{L}]', '', 'g') AS core FROM documents) WHERE core <> ''""")
def name_indicators(spark, d):
    return profile.name_indicators(t(spark, d, "documents"), "text")


@query(r"SELECT count(*) FILTER (length(url) > 40) AS long_paths, count(*) FILTER (regexp_matches(url, '\s')) AS with_space, count(*) FILTER (contains(url, '%')) AS with_percent FROM pages")
def special_counts(spark, d):
    return profile.special_counts(t(spark, d, "pages"), "url", 40)


@query(r"""WITH w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM conversations), k AS (SELECT conv_id, lower(token) AS key, count(*) AS k FROM w GROUP BY ALL)
    SELECT conv_id, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS pairs FROM k GROUP BY conv_id HAVING pairs > 0""")
def case_only_pairs(spark, d):
    w = t(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("token"))
    return profile.case_only_pairs(w, "conv_id", "token")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def children_per_parent(spark, d):
    return profile.children_per_parent(t(spark, d, "customer"), t(spark, d, "orders"), "c_custkey", "o_custkey")


@query("SELECT count(*) FILTER (o_orderstatus <> 'P') AS files, count(*) FILTER (o_orderstatus = 'P') AS directories, count(DISTINCT o_orderpriority) AS names, count(*) AS items FROM orders")
def catalog_counts(spark, d):
    return profile.catalog_counts(_order_items(spark, d), "full_path")


# Metrics


@query("""WITH p AS (SELECT DISTINCT user_id, edge FROM (SELECT user_id, ts AS edge FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, min(ts) FROM events GROUP BY user_id UNION ALL SELECT user_id, max(ts) FROM events GROUP BY user_id)),
      w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY edge) - 1 AS win, edge AS lo, lead(edge) OVER (PARTITION BY user_id ORDER BY edge) AS hi FROM p)
    SELECT e.user_id, CAST(win AS INT) AS "window", count(*) AS samples, min(event_id) AS first_event FROM events e JOIN w ON e.user_id = w.user_id AND e.ts BETWEEN lo AND hi GROUP BY e.user_id, win""")
def metric_windows(spark, d):
    e = t(spark, d, "events")
    w = metrics.event_windows(e, ["user_id"], "ts", F.col("event_type") == "error")
    return metrics.in_windows(e, w, ["user_id"], "ts").groupBy("user_id", "window").agg(F.count("*").alias("samples"), F.min("event_id").alias("first_event"))


@query("""SELECT user_id, event_type, count(*) AS n, round(max_by(value, (ts, value)) - min_by(value, (ts, value)), 6) AS delta FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type HAVING count(*) >= 2""")
def metric_deltas(spark, d):
    return metrics.deltas(t(spark, d, "events"), ["user_id", "event_type"], "ts", "value").select("user_id", "event_type", "n", F.round("delta", 6).alias("delta"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS tm, sum(CAST(round(abs(value) * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT event_id, user_id, i, tm AS t0, v AS v0, CAST(NULL AS DOUBLE) AS rate FROM e WHERE i = 1
        UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.tm < f.t0 OR e.v < f.v0 OR e.tm - f.t0 >= 250000 THEN e.tm ELSE f.t0 END, CASE WHEN e.tm < f.t0 OR e.v < f.v0 OR e.tm - f.t0 >= 250000 THEN e.v ELSE f.v0 END,
          CASE WHEN e.tm < f.t0 OR e.v < f.v0 THEN NULL WHEN e.tm - f.t0 >= 250000 THEN CAST(e.v - f.v0 AS DOUBLE) / (CAST(e.tm - f.t0 AS DOUBLE) / 1000000) ELSE f.rate END
        FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT event_id, coalesce(round(rate, 4), -1) AS rate FROM f""")
def counter_rate(spark, d):
    """Rates of a running sum of values (in hundredths); -1 where there is none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.round(F.abs("value") * 100).cast("long")
    rows = t(spark, d, "events").select("user_id", "ts", "event_id", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    return metrics.counter_rates(rows, "user_id", "ts", "total", order=("ts", "event_id")).select("event_id", F.coalesce(F.round("rate", 4), F.lit(-1.0)).alias("rate"))


@query("""WITH m AS (SELECT l_returnflag AS flag, CASE WHEN year(l_shipdate) % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS run, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY flag, run),
      b AS (SELECT flag, max(p95) FILTER (run = 'baseline') AS a1, max(p95) FILTER (run = 'candidate') AS b1, max(median) FILTER (run = 'baseline') AS a2, max(median) FILTER (run = 'candidate') AS b2 FROM m GROUP BY flag),
      c AS (SELECT flag, CASE WHEN a1 > 0 THEN (b1 - a1) / a1 * 100 END AS x, CASE WHEN a2 > 0 THEN (b2 - a2) / a2 * 100 END AS y FROM b)
    SELECT flag, round(x, 6) AS p95_change, round(y, 6) AS median_change, CASE WHEN x IS NULL OR y IS NULL THEN 'missing' WHEN x > 1 OR y > 1 THEN 'regression' WHEN x < -1 OR y < -1 THEN 'improvement' ELSE 'unmeasurable' END AS verdict FROM c""")
def regression_verdict(spark, d):
    run = F.when(F.year("l_shipdate") % 2 == 0, "baseline").otherwise("candidate")
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), run.alias("run"), "l_extendedprice", "l_quantity")
    m = profile.nearest_ranks(rows, "l_extendedprice", {"p95": 0.95}, ["flag", "run"]).join(profile.nearest_ranks(rows, "l_quantity", {"median": 0.5}, ["flag", "run"]), ["flag", "run"])
    out = metrics.verdict(m, ["flag"], "run", ("p95", "median"), 1.0)
    return out.select("flag", F.round("p95_change", 6).alias("p95_change"), F.round("median_change", 6).alias("median_change"), "verdict")


# Renames and documents


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 = 0 THEN 'copy 0' || lpad(CAST(p_partkey % 9 AS VARCHAR), 3, '0') || '.txt' ELSE p_name || '-' || p_partkey || '.txt' END AS old_name FROM part),
      q AS (SELECT p.*, p_brand || '/' || old_name AS path FROM p QUALIFY row_number() OVER (PARTITION BY upper(p_brand || '/' || old_name) ORDER BY p_partkey) = 1),
      n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS k, length(CAST((SELECT count(*) FROM q) AS VARCHAR)) AS width FROM q),
      r AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'copy ' || lpad(CAST((k + 1) % 13 AS VARCHAR), 4, '0') || '.txt' WHEN p_partkey % 7 = 0 THEN 'CON.txt'
                      ELSE upper(replace(lower(left(old_name, length(old_name) - 4)), 'cold', 'warm')) || '.txt' END AS new_name FROM n),
      s AS (SELECT *, count(*) OVER (PARTITION BY upper(p_brand), upper(new_name)) AS same FROM r)
    SELECT p_partkey, new_name, CASE WHEN upper(left(new_name, length(new_name) - 4)) = 'CON' THEN 'invalid' WHEN new_name = old_name THEN 'unchanged'
      WHEN upper(new_name) <> upper(old_name) AND EXISTS (SELECT 1 FROM q e WHERE upper(e.path) = upper(s.p_brand || '/' || s.new_name)) THEN 'exists' WHEN same > 1 THEN 'duplicate' ELSE 'ready' END AS status FROM s""")
def rename_plan(spark, d):
    """All parts renamed by several rules at once: numbers, a replacement in capitals, a name that cannot be."""
    old = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("copy 0"), F.lpad((F.col("p_partkey") % 9).cast("string"), 3, "0"), F.lit(".txt"))).otherwise(F.concat("p_name", F.lit("-"), "p_partkey", F.lit(".txt")))
    p = t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), old).alias("path"), F.lit(False).alias("is_dir"))
    p = p.groupBy(F.upper("path").alias("u")).agg(F.min_by(F.struct("p_partkey", "path", "is_dir"), "p_partkey").alias("r")).select("r.*")
    rows = rename.ordinals(p, ["p_partkey"])
    own = tx.base_name(F.col("path"))
    digits = F.concat(F.lit("copy "), F.lpad(((F.col("ordinal") + 1) % 13).cast("string"), 4, "0"), F.lit(".txt"))
    shout = rename.new_name(own, F.col("is_dir"), F.col("ordinal"), 1, rename.Rules(find="COLD", replace="warm", case="upper"))
    english = F.translate(shout, "İ", "I")
    target = F.when(F.col("p_partkey") % 3 == 0, digits).when(F.col("p_partkey") % 7 == 0, F.lit("CON.txt")).otherwise(english)
    return rename.plan(rows, target).select("p_partkey", "new_name", "status")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS slot FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_intent(spark, d):
    k = F.from_json("props", "k BIGINT")["k"]
    return t(spark, d, "events").select("event_id", k.alias("k"), (k % 5).alias("slot")).where("k IS NOT NULL")


@query("""SELECT doc_id, sha256('{"n_chars":' || n_chars || ',"source":"' || source || '"}') AS fingerprint FROM documents""")
def metric_fingerprint(spark, d):
    return profile.fingerprint(t(spark, d, "documents").select("doc_id", "source", "n_chars"), keep="doc_id")


@query("""SELECT token, n FROM (SELECT lower(translate(w, 'IİÄÖÜ', 'ıiäöü')) AS token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY token)""")
def unicode_tokens(spark, d):
    return t(spark, d, "part").select(F.explode(tx.tokenize("p_name")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# Listings, crumbs, visibility


@query(f"""{ORDERS} SELECT row_number() OVER (ORDER BY is_dir DESC, lower(name), item_id) AS position, item_id, is_dir FROM items ORDER BY position LIMIT 60""")
def folder_listing(spark, d):
    page = views.folder_view(_order_items(spark, d), views.ItemSort("name"), 60)
    return ranked(page, [F.col("is_dir").desc(), F.lower("name"), F.col("item_id")], "item_id", "is_dir")


@query("""WITH s AS (SELECT lang AS full_path, CAST(count(*) AS DOUBLE) AS score FROM documents WHERE lang IS NOT NULL GROUP BY lang),
      two AS (SELECT *, row_number() OVER (ORDER BY score DESC, lower(full_path), full_path) AS i FROM s)
    SELECT a.full_path, a.score FROM two a LEFT JOIN two b ON b.i = 2 WHERE a.i = 1 AND a.score >= 100 AND (b.score IS NULL OR a.score - b.score >= greatest(40.0, 0.25 * abs(b.score)))""")
def auto_open_pick(spark, d):
    """Languages as results, scored by their documents."""
    sums = t(spark, d, "documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("full_path")).agg(F.count("*").cast("double").alias("score"))
    return views.auto_open(sums.withColumn("name", F.col("full_path")))


@query(f"""{TREE}, c AS (SELECT id, path, CASE WHEN path = 'world/ASIA' OR starts_with(path, 'world/ASIA/') THEN 'world/ASIA' ELSE 'world' END AS root FROM tree WHERE NOT starts_with(id, 'o')),
      p AS (SELECT id, root, list_filter(string_split(substr(path, length(root) + 2), '/'), lambda s: s <> '') AS parts FROM c)
    SELECT id, array_to_string(list_concat([root], list_transform(range(1, len(parts) + 1), lambda i: root || '/' || array_to_string(parts[1:i], '/'))), '|') AS crumbs FROM p""")
def breadcrumbs(spark, d):
    """Trails are for folders, at any depth; in these tables they are the rows of the first three levels and the root."""
    rows = _tree(spark, d).where("is_dir")
    return rows.select("id", F.array_join(tree.breadcrumb(F.col("path"), ["world", "world/ASIA"]), "|").alias("crumbs"))


@query(f"{TREE} SELECT id FROM tree WHERE NOT list_has_any(ancestors, ['r1', 'n3', 'c5'])")
def visible_rows(spark, d):
    return tree.visible(_tree(spark, d), spark.createDataFrame([("r1",), ("n3",), ("c5",)], "id string")).select("id")


@query(f"""{TREE}, roots AS (SELECT DISTINCT path FROM tree WHERE (depth = 1 AND id <> 'r1') OR depth = 2)
    SELECT path FROM roots r WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE o.path <> r.path AND starts_with(r.path, o.path || '/'))""")
def outermost_roots(spark, d):
    return changes.outermost(_tree(spark, d).where("(depth = 1 AND id <> 'r1') OR depth = 2"))


@query(f"""{TREE}, p AS (SELECT id, string_split(lower(path), '/') AS parts FROM tree)
    SELECT id FROM p WHERE len(list_filter(list_slice(parts, 1, len(parts) - 1), lambda s: contains(s, 'asia') OR contains(s, 'europe'))) > 0""")
def folder_context_filter(spark, d):
    return _tree(spark, d).where(search.in_folder_context(F.col("path"), [["asia", "Europe"]])).select("id")


# Renames across views, links, overlays


@query(f"""{FEED}, s AS (SELECT event_id, kind, user_id % 2 = 0 AS old_seen, user_id % 3 = 0 AS new_seen FROM feed)
    SELECT event_id, CASE WHEN kind <> 'renamed' THEN kind WHEN old_seen AND new_seen THEN 'renamed' WHEN old_seen THEN 'deleted' ELSE 'created' END AS seen_as
    FROM s WHERE (kind = 'renamed' AND (old_seen OR new_seen)) OR (kind <> 'renamed' AND new_seen)""")
def redacted_renames(spark, d):
    kind = changes.split_rename(F.col("kind"), F.lit("a"), F.lit("b"), F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0)
    return _feed(spark, d).select("event_id", kind.alias("seen_as")).where("seen_as IS NOT NULL")


@query("""WITH m AS (SELECT o_custkey AS k, o_orderkey AS old_link, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey % 3 = 0),
      e AS (SELECT o_custkey AS k, o_orderkey AS new_link, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey % 3 = 1)
    SELECT coalesce(m.k, e.k) AS k, coalesce(old_link, -1) AS old_link, coalesce(new_link, -1) AS new_link FROM m FULL JOIN e ON m.k = e.k AND m.i = e.i""")
def link_pairs(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("link"))
    return changes.pair_links(o.where("link % 3 = 0"), o.where("link % 3 = 1"), "k", ["link"]).fillna(-1)


@query("""SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 5 = 0""")
def overlay_rows(spark, d):
    o = t(spark, d, "orders")
    return retrieval.overlay(o.selectExpr("o_orderkey AS k", "o_totalprice AS price"), o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS k", "0D AS price"), "k")


@query("""WITH r AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS run, l_extendedprice AS v FROM lineitem),
      c AS (SELECT k, CASE WHEN lag(v) OVER w > 0 THEN abs((v - lag(v) OVER w) / lag(v) OVER w * 100) END AS change FROM r WINDOW w AS (PARTITION BY k ORDER BY run, v))
    SELECT k, round(max(change), 6) AS band FROM c GROUP BY k""")
def variance_band(spark, d):
    runs = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), F.col("l_extendedprice").alias("v")).alias("at"), F.col("l_extendedprice").alias("v"))
    return metrics.variance_band(runs, ["k"], "at", "v").select("k", F.round("band", 6).alias("band"))


@query("""WITH m AS (SELECT l_returnflag AS flag, l_linenumber AS stage, quantile_disc(l_quantity, 0.5) * l_linenumber AS cumulative FROM lineitem GROUP BY flag, stage),
      o AS (SELECT *, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY flag ORDER BY stage), 0) AS own FROM m)
    SELECT flag, stage, own, CASE WHEN sum(own) OVER (PARTITION BY flag) > 0 THEN round(own / sum(own) OVER (PARTITION BY flag), 6) ELSE 0 END AS share FROM o""")
def phase_split(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("stage"), (F.col("l_quantity") * F.col("l_linenumber")).alias("v"))
    return metrics.phases(rows, ["flag"], "stage", "v").select("flag", "stage", "own", F.round("share", 6).alias("share"))
