"""Sources, snapshots and streams."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from filigrane.functions import codecs
from filigrane.operators import changes, tree
from filigrane.operators.metrics import fold_rates
from filigrane.sources import journal, logs, store, synthetic
from filigrane.streaming import feeds, queue

SCHEMA = "k long, v long"


def test_metric_log(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 10:00:00.500", "cpu", "load", "7", 7.0), ("2026-01-01 10:00:01.000", "OLAY", "start", "", None)], "t string, group string, label string, value string, numeric double")
    logs.write_metric_log(rows.withColumn("ts", F.to_timestamp("t")), f"{tmp_path}/log")
    (tmp_path / "log" / "more.txt").write_text(f"{logs.HEADER}\nbad;line\n2026-13-01;a;b;c;d\n")
    got, skipped = logs.read_metric_log(spark, f"{tmp_path}/log")
    assert sorted((r.group, r.label, r.numeric) for r in got.collect()) == [("OLAY", "start", None), ("cpu", "load", 7.0)] and skipped.head().skipped == 2


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (1, 2)], SCHEMA)
    root = str(tmp_path)
    assert logs.load_snapshot(spark, root, 3) is None and logs.latest_version(spark, root) == 0
    assert logs.save_snapshot(df, root, 3) and not logs.save_snapshot(df, root, 3)  # one of several writers succeeds
    assert logs.load_snapshot(spark, root, 3).collect() == df.collect() and logs.latest_version(spark, root) == 3
    assert logs.load_snapshot(spark, root, 3, {"rows": 5}) is None
    data = logs.manifest_of(spark, root, 3)["data"]
    df.write.mode("append").parquet(f"{root}/v={3:012d}/{data}")  # more rows than the manifest says
    assert logs.load_snapshot(spark, root, 3) is None
    assert store.open_if(spark, root, 3, {}, lambda: df.limit(1)).count() == 1
    logs.save_snapshot(df, root, 4)
    (tmp_path / f"v={4:012d}" / "manifest.json").write_text("{damaged")
    assert logs.load_snapshot(spark, root, 4) is None and logs.drop_versions(spark, root, 4) == [3]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/s")
    s.put("a", "1")
    s.exclude(["x", "y"])
    s.exclude(["x"])
    assert s.get("a") == "1" and s.get("b") is None and s.excluded() == ["x", "y"] and s.read("files") is None
    rows = spark.createDataFrame([("d/a", "d", 3), ("d/b", "d", 0), ("e/c", "e", 1)], "full_path string, parent_path string, open_count long")
    assert s.upsert("files", rows, "one") and not s.upsert("files", rows, "one")
    s.upsert("files", rows.limit(1).withColumn("open_count", F.lit(0).cast("long")), "two")
    assert sorted((r.full_path, r.open_count) for r in s.files_of("d").collect()) == [("d/a", 3), ("d/b", 0)]
    assert [tuple(r) for r in s.opened(rows.where("full_path = 'd/b'").select("full_path"), "three").collect()] == [("d/b", 1)]
    assert [tuple(r) for r in s.counts().collect()] == [("files", 3)] and s.compact("files") == [1, 2]
    with pytest.raises(ValueError):
        s.write("directories", rows.union(rows), "four", "full_path")
    s.clear()
    assert s.read("files") is None


EVENT = "root string, generation long, gap string, fault string, position long, kind string, path string, old_path string, is_dir boolean"


def test_queue_and_pulls(spark, tmp_path):
    rows = [("r1", 1, None, None, i, "created", f"p{i}" * 10, None, False) for i in range(20)] + [("r2", 1, None, None, 0, "deleted", "x" * 900, None, False)]
    q = queue.Queue(spark, f"{tmp_path}/q", 500)
    written = q.enqueue(spark.createDataFrame(rows, EVENT), "C", 0, 50)
    events = q.read(written)
    assert len(written) > 3 and events.where("root = 'r1'").count() == 20 and events.where("gap = 'entry-too-large'").count() == 1
    page, more = q.pending(2)
    assert more and {r.sequence for r in page.collect()} == set(written[:2])
    page, more = q.pending(64, 1)
    assert more and {r.sequence for r in page.collect()} == {written[0]}  # the first one in any case
    session = queue.PullSession(q, "me", "rights", ("r1", "r2"))
    first = session.pull(most=2)
    assert first["receipt"] is None and first["batch_id"] == session.pull(most=2)["batch_id"]
    rest = session.pull(first["continuation"], 100)
    with pytest.raises(PermissionError):
        session.pull(first["continuation"])
    seen = []
    assert queue.adopt([first, rest], lambda df: seen.append(df.count()), lambda roots: seen.append(roots)) == ["r2"] and seen[-1] == ["r2"]
    assert session.ack(rest["receipt"]) == 1 and q.sequences() == []
    with pytest.raises(PermissionError):
        session.ack(rest["receipt"])
    again = q.enqueue(spark.createDataFrame(rows[:1], EVENT), "C", 50, 60)
    assert again[0] == written[-1] + 1 and q.discard("C", 55) == again


def test_drain_reads_again_until_accepted(spark, tmp_path):
    records = spark.createDataFrame([(i, 100 + i, 5, 0x100, 0, f"f{i}") for i in range(10)], journal.RECORD)
    q = queue.Queue(spark, f"{tmp_path}/q")
    cursor = queue.Cursor(spark, f"{tmp_path}/cursor.json", 1)
    project = lambda r: r.selectExpr("'r' AS root", "1L AS generation", "CAST(NULL AS STRING) AS gap", "CAST(NULL AS STRING) AS fault", "usn AS position", "'created' AS kind", "name AS path", "CAST(NULL AS STRING) AS old_path", "false AS is_dir")
    batch, gap = cursor.read(records, 1, 0, 6)
    assert gap is None and batch.count() == 6 == cursor.read(records, 1, 0, 6)[0].count()
    assert queue.drain(q, cursor, records, (1, 0, 6), project, "C") == ([1], None) and cursor.accepted() == 6
    assert cursor.read(records, 1, 0, 10)[0].count() == 4 and cursor.read(records, 2, 0, 10)[1] == "journal-replaced" and cursor.read(records, 1, 7, 10)[1] == "position-lost"
    late = q.enqueue(project(records.where("usn >= 6")), "C", 6, 10)  # a crash before the cursor moved
    assert queue.drain(q, cursor, records, (1, 0, 10), project, "C")[0] and late[0] not in q.sequences()
    lease = queue.Lease().renewed(0.0, 9999.0)
    assert lease.held(599.0) and not lease.held(600.0)
    assert queue.drain(q, cursor, records, (1, 0, 10), project, "C", lease, 1.0) == ([], None)
    refresh = queue.Coalescer()
    assert refresh.request() and not refresh.request() and not refresh.request() and refresh.done() and not refresh.done()
    plan = queue.PollPlan()
    assert [plan.step(700, True, True, 0, 0, True), plan.step(100, True, False, 0, 0, True), plan.step(1, False, True, 0, 0, True), plan.step(31, False, False, 0, 0, False)] == ["rescan", "wait", "apply", "save"]


def test_codecs():
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert codecs.read_varint(codecs.varint(n)) == (n, len(codecs.varint(n)))
        assert codecs.unzigzag(codecs.zigzag(n)) == n and codecs.unzigzag(codecs.zigzag(-n)) == -n
        assert codecs.unpack_ticks(*codecs.pack_ticks(n)) == n
    assert codecs.unpack_postings(codecs.pack_postings([9, 3, 3, 500])) == [3, 9, 500]
    rows = [(-5, 5, "çş", 32, 10, 1, 2), (7, -1, "half\ud800", 16, 0, 0, 0)]
    assert codecs.unpack_entries(codecs.pack_entries(rows)) == rows and codecs.unpack_entries(None) == []
    with pytest.raises(ValueError):
        codecs.unpack_entries(base64.b64encode(base64.b64decode(codecs.pack_entries(rows))[:-1]).decode())
    assert codecs.fnv1a(b"a") == 0xE40C292C


def test_journal_round_trip(spark):
    records = [(10, 1 << 48 | 20, 5, 0x100, 32, "a.txt"), (20, 21, 5, 0x80000200, 16, "çş"), (30, -5, 5, 1, 0, "")]
    data = journal.encode_journal(40, records)
    assert journal.decode_journal(data) == records
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert [r.usn for r in journal.journal_records(df, accepted=20, end=30).collect()] == [20]
    with pytest.raises(ValueError):
        journal.decode_journal(data[:-3])
    with pytest.raises(ValueError):
        journal.decode_journal(data[:8] + struct.pack("<I", 4) + data[12:])


def file_record(names, in_use=True, size=1234):
    body = b""
    body += struct.pack("<IIBBHHHIHBB", 0x10, 24 + 48, 0, 0, 0, 0, 0, 48, 24, 0, 0) + struct.pack("<QQQQIIQ", 7, 8, 9, 9, 32, 0, 0)
    for parent, space, name in names:
        data = name.encode("utf-16-le")
        content = struct.pack("<Q", parent) + bytes(56) + bytes([len(name), space]) + data
        length = -(-(24 + len(content)) // 8) * 8
        body += (struct.pack("<IIBBHHHIHBB", 0x30, length, 0, 0, 0, 0, 0, len(content), 24, 0, 0) + content).ljust(length, b"\0")
    body += struct.pack("<IIBBHHHIHBB", 0x80, 24, 0, 0, 0, 0, 0, size, 24, 0, 0) + struct.pack("<I", 0xFFFFFFFF)
    head = b"FILE" + struct.pack("<HHQHHHH", 48, 3, 0, 3, 1, 56, 1 if in_use else 0)
    record = bytearray((head.ljust(48, b"\0") + b"\x01\x00" + bytes(4)).ljust(56, b"\0") + body).ljust(1024, b"\0")
    record = bytearray(record)
    for i in (1, 2):
        record[48 + 2 * i : 50 + 2 * i] = record[512 * i - 2 : 512 * i]
        record[512 * i - 2 : 512 * i] = record[48:50]
    return bytes(record)


def test_file_records(spark):
    good = file_record([(5, 1, "long name.txt"), (5, 2, "LONGNA~1.TXT"), (6, 1, "link.txt")])
    torn = bytearray(good)
    torn[510] ^= 1
    rows = [(30, bytearray(good)), (31, torn), (32, bytearray(b"BAAD")), (33, bytearray(file_record([(5, 1, "gone")], in_use=False)))]
    got = journal.file_table(spark.createDataFrame(rows, "number long, content binary")).collect()
    assert sorted((r.file_ref, r.parent_ref, r.name, r.size_bytes) for r in got) == [(3 << 48 | 30, 5, "long name.txt", 1234), (3 << 48 | 30, 6, "link.txt", 1234)]


def test_projection(spark):
    folders = spark.createDataFrame([(6, 5, "old"), (7, 6, "deep")], "file_ref long, parent_ref long, name string")
    rows = [
        (1, 20, 5, feeds.CREATE, 16, "dir"), (2, 21, 20, feeds.CREATE, 16, "child"), (3, 22, 99, feeds.CREATE, 0, "unknown"), (4, 29, 21, feeds.CREATE, 0, "leaf"),
        (5, 23, 5, feeds.OLD_NAME, 0, "a"), (6, 23, 5, feeds.NEW_NAME, 0, "b"), (7, 24, 6, feeds.OLD_NAME, 0, "m"), (8, 24, 99, feeds.NEW_NAME, 0, "m"),
        (9, 25, 5, feeds.CREATE, 0, "tmp"), (10, 25, 5, feeds.DELETE, 0, "tmp"), (11, 26, 7, 2, 0, "mod"), (12, 6, 5, feeds.OLD_NAME, 16, "old"), (13, 6, 5, feeds.NEW_NAME, 16, "new"),
        (14, 27, 7, 2, 0, "after"), (15, 6, 5, feeds.NEW_NAME | feeds.CLOSE, 16, "new"), (16, 23, 5, feeds.OLD_NAME, 0, "b"), (17, 23, 5, feeds.NEW_NAME, 0, "B"),
    ]
    records = spark.createDataFrame(rows, journal.RECORD)
    got = feeds.project_journal(records, folders).collect()
    assert [(r.kind, r.path, r.old_path) for r in got] == [
        ("created", "C:\\dir", None), ("created", "C:\\dir\\child", None), ("created", "C:\\dir\\child\\leaf", None), ("renamed", "C:\\b", "C:\\a"), ("deleted", "C:\\old\\m", None),
        ("deleted", "C:\\tmp", None), ("modified", "C:\\old\\deep\\mod", None), ("renamed", "C:\\new", "C:\\old"), ("modified", "C:\\new\\deep\\after", None), ("created", "C:\\B", None),
    ]
    left = {r.file_ref: (r.parent_ref, r.name) for r in feeds.folders_after(records, folders).collect()}
    assert left == {6: (5, "new"), 7: (6, "deep"), 20: (5, "dir"), 21: (20, "child")}
    private = feeds.project_journal(records, folders, excluded=F.startswith("path", F.lit("C:\\new"))).collect()
    assert ("deleted", "C:\\old", None) in [(r.kind, r.path, r.old_path) for r in private] and not any(r.path.startswith("C:\\new") for r in private)
    broken = records.union(spark.createDataFrame([(18, 5, 5, feeds.OLD_NAME, 16, "x")], journal.RECORD))
    assert feeds.project_journal(broken, folders).count() == 0 and feeds.journal_gap(broken, 5).head()[0] == "root-identity-changed"
    assert feeds.read_gap(2, 0, 9, 1, 5) == "journal-replaced" and feeds.read_gap(1, 6, 9, 1, 5) == "position-lost" and feeds.read_gap(1, 0, 9, 1, 5) is None


def test_current_links(spark):
    rows = [(30, bytearray(file_record([(5, 1, "long name.txt"), (6, 1, "link.txt")]))), (31, bytearray(file_record([(5, 1, "other")])))]
    segments = spark.createDataFrame(rows, "number long, content binary")
    asked = spark.createDataFrame([(3 << 48 | 30,), (4 << 48 | 31,)], "file_ref long")
    assert sorted(r.name for r in journal.current_links(segments, asked).collect()) == ["link.txt", "long name.txt"]


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    parts = [[(1, 10), (2, 20)], [(2, 21), (3, 30)], [(1, 11)]]
    empty = spark.createDataFrame([], SCHEMA)
    sink = feeds.merge_sink(f"{tmp_path}/state", lambda a, b: changes.upsert(a, b, "k"), empty)
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        feeds.run_available(stream, f"{tmp_path}/checkpoint", sink)
        got = logs.load_snapshot(spark, f"{tmp_path}/state", i + 1)
    want = {k: v for p in parts for k, v in p}
    assert {r.k: r.v for r in got.collect()} == want
    sink(spark.createDataFrame([(9, 9)], SCHEMA), 2)  # batch 2 was committed
    assert logs.load_snapshot(spark, f"{tmp_path}/state", 3).where("k = 9").count() == 0


def test_streamed_rates(spark, tmp_path):
    rows = [("a", i, float(v)) for i, v in enumerate((1, 3, 3, 9, 2, 4))]
    kept = []
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "key string, s long, value double").selectExpr("key", "timestamp_seconds(s) AS observed_at", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, observed_at timestamp, value double").parquet(f"{tmp_path}/in")
        out = feeds.rates(stream)
        q = out.writeStream.foreachBatch(lambda df, i: kept.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.rate for r in sorted(kept, key=lambda r: r.observed_at)] == fold_rates([(i, v) for _, i, v in rows], 0.25)


def test_synthetic_corpus(spark):
    """One sequence from the first item on, whatever the partitions; jumps land where steps lead."""
    x, plain = 1701, []
    for i in range(300):
        parts = []
        for choices in (synthetic.FIRST, synthetic.SECOND, synthetic.EXTENSIONS)[: 2 if i % 20 == 0 else 3]:
            x ^= x << 13 & 0xFFFFFFFF
            x ^= x >> 17
            x ^= x << 5 & 0xFFFFFFFF
            parts.append(choices[x % len(choices)])
        plain.append(f"{parts[0]}-{parts[1]}-{i:07d}{''.join(parts[2:])}")
    rows = synthetic.synthetic_corpus(spark, 300)
    got = {r.item_id: r for r in rows.collect()}
    assert [got[i].name for i in range(300)] == plain and sum(r.is_dir for r in got.values()) == 15 and got[128].parent_path.endswith("d00001")
    assert synthetic.corpus_fingerprint(rows) == synthetic.corpus_fingerprint(rows.repartition(7)) != synthetic.corpus_fingerprint(synthetic.synthetic_corpus(spark, 300, 5))
    assert synthetic.jump(12345, 7) == synthetic.step(synthetic.jump(12345, 6))


def test_bucketed_merges(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    sink = feeds.merge_sink(f"{tmp_path}/s", lambda a, b: changes.upsert(a, b, "k"), empty, "k", 8)
    want = {}
    for i, part in enumerate([[(k, k) for k in range(50)], [(3, -3), (77, 7)], []]):
        sink(spark.createDataFrame(part, SCHEMA), i)
        want.update(part)
        assert {r.k: r.v for r in feeds.read_buckets(spark, f"{tmp_path}/s", i + 1, SCHEMA).collect()} == want
    sink(spark.createDataFrame([(9, 99)], SCHEMA), 1)  # a replay
    assert {r.k: r.v for r in feeds.read_buckets(spark, f"{tmp_path}/s", 2, SCHEMA).collect()} == want
    assert len(list((tmp_path / "s" / "data").glob("000000000002-*/__slot=*"))) <= 2  # only the buckets of the batch


def test_walk_below(spark):
    rows = [(1, None, False, True, 7), (2, 1, False, True, 7), (3, 1, True, True, 7), (4, 3, False, True, 7), (5, 2, False, False, 7), (6, 5, False, True, 7), (8, 2, False, True, 9)]
    df = spark.createDataFrame(rows, "id long, parent_id long, surrogate boolean, listed boolean, volume int")
    taken, skipped = tree.walk_below(df, 1)
    assert sorted(r.id for r in taken.collect()) == [2, 5] and skipped.head().skipped == 3
    names = tree.searchable(df.withColumn("name", F.col("id").cast("string")), tree.reachable(df.withColumns({"name": F.col("id").cast("string"), "is_dir": F.col("id") != 3}), 1))
    assert sorted(r.id for r in names.where("path IS NULL").collect()) == [4]
