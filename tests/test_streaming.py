import datetime
import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import accounts
from vellum.operators import ordered as O
from vellum.sources import collections, files
from vellum.streaming import logs, sessions

SF = "/root/testdata/sf0.001"


def test_streaks_and_sessions_match_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("failed", F.col("event_type") == "error").withColumn("reset", F.col("event_type") == "signup")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    logs.append_to(logs.failure_streaks(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.event_id, r.streak, r.locks) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = O.failure_streaks(e, "user_id", [F.col("ts"), F.col("event_id")], F.col("failed"), F.col("reset")).where("failed")
    assert got == {(r.event_id, r.streak, r.locks) for r in batch.collect()} and got
    logs.append_to(logs.idle_sessions(s), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out2"))
    every = O.idle_sessions(e, "user_id", "ts", "event_id", 1800).groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.count("*").alias("n"))
    assert closed.count() > 0 and closed.join(every, ["user_id", "started", "n"], "left_anti").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"articles": [{"chunk_id": "x", "t": "1"}, {"chunk_id": "y", "t": "2"}]}')
    (tmp_path / "b.json").write_text('{"articles": [{"chunk_id": "x", "t": "3"}]}')
    schema = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("t", T.StringType())])
    assert {(r.chunk_id, r.t) for r in files.merged_articles(spark, str(tmp_path), schema).collect()} == {("x", "1"), ("y", "2")}
    (tmp_path / "l.jsonl").write_text('{"chunk_id": "a", "t": "b"}\n\n{broken\n')
    good, bad = files.json_lines(spark, str(tmp_path / "l.jsonl"), T.StructType(list(schema)))
    assert good.count() == 1 and [r.line for r in bad.collect()] == ["{broken"]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "p.txt").write_bytes(gzip.compress("가\n나".encode()))
    (tmp_path / "g" / "q.txt").write_text("다")
    assert sorted(r.line for r in files.maybe_gzip_lines(spark, str(tmp_path / "g")).collect()) == ["가", "나", "다"]
    for body in ('[{"chunk_id": "1"}]', '{"data": [{"chunk_id": "1"}]}'):
        (tmp_path / "d.txt").write_text(body)
        assert [r.chunk_id for r in files.list_or_data(spark, str(tmp_path / "d.txt"), schema).collect()] == ["1"]
    kinds = spark.createDataFrame([("pdf", ["application/pdf"])], "extension string, mimes array<string>")
    up = spark.createDataFrame([("a.PDF", 1, "application/pdf"), ("a.exe", 1, "x"), ("a.pdf", 99 << 20, "application/pdf"), ("b.pdf", 1, "x"), ("c.pdf", 1, "application/octet-stream")], "path string, length long, mime string")
    assert [r.reason for r in files.admitted(up, kinds).collect()] == [None, "extension", "size", "mime", None]
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in files.upsert(a, b, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_more_sources(spark, tmp_path):
    f = spark.createDataFrame([("/m/a.hwp", 10), ("/m/b.hwp", 10), ("/m/c.hwp", 10), ("/m/d.pdf", 10)], "path string, modified long")
    c = spark.createDataFrame([("/cache/a.pdf", 10), ("/cache/b.pdf", 9)], "path string, modified long")
    assert {r.path: r.use for r in files.cached_conversions(f, c).collect()} == {"/m/a.hwp": "/cache/a.pdf", "/m/b.hwp": None, "/m/c.hwp": None, "/m/d.pdf": "/m/d.pdf"}
    v, w = spark.createDataFrame([(0, "p"), (1, "q")], "k int, v string"), spark.createDataFrame([(1, 0.5), (0, 0.1)], "k int, w double")
    assert {(r.v, r.w) for r in files.zip_by_place(v, w).collect()} == {("p", 0.1), ("q", 0.5)}
    for bad in (w.where("k = 0"), w.unionByName(w.where("k = 0"))):
        with pytest.raises(ValueError):
            files.zip_by_place(v, bad)
    inner, lost = files.attach(v, w.where("k = 0"), "k")
    left, _ = files.attach(v, w.where("k = 0"), "k", "left")
    assert (inner.count(), left.count(), [r.k for r in lost.collect()]) == (1, 2, [1])
    (tmp_path / "t").mkdir()
    for name in ("a.TXT", "b.md", "c.hwpx", "d.exe"):
        (tmp_path / "t" / name).write_text("본문")
    assert sorted(r.text for r in files.plain_texts(spark, str(tmp_path / "t")).collect()) == ["", "본문", "본문", "본문"]


def test_notifications_once_and_logins(spark, tmp_path):
    items = spark.createDataFrame([(1, "2024-01-08", True), (2, "2024-01-02", True), (3, "2024-01-08", False), (1, "2024-01-08", True)], "item_id long, due string, pending boolean").withColumn("due", F.col("due").cast("date"))
    for n in range(2):  # the second run finds all alerts sent
        items.write.mode("append").parquet(str(tmp_path / "in"))
        alerts = logs.deadline_alerts(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in")), "2024-01-01")
        logs.notify(alerts, str(tmp_path / "sent"), str(tmp_path / f"cp{n}"), ["item_id", "days_left"]).awaitTermination()
        assert {(r.item_id, r.days_left) for r in spark.read.parquet(str(tmp_path / "sent")).collect()} == {(1, 7), (2, 1)}
        assert spark.read.parquet(str(tmp_path / "sent")).count() == 2
    more = spark.createDataFrame([(5, "2024-01-08", True), (6, "2024-01-04", True)], "item_id long, due string, pending boolean").withColumn("due", F.col("due").cast("date"))
    more.write.mode("append").parquet(str(tmp_path / "in"))
    alerts = logs.deadline_alerts(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in")), "2024-01-01")
    out = spark.createDataFrame([(5, 7), (6, 7)], "item_id long, days_left int")  # the first wants no early alerts; the second's is another kind
    logs.notify(alerts, str(tmp_path / "sent"), str(tmp_path / "cp2"), ["item_id", "days_left"], out).awaitTermination()
    assert {(r.item_id, r.days_left) for r in spark.read.parquet(str(tmp_path / "sent")).collect()} == {(1, 7), (2, 1), (6, 3)}
    rows = spark.createDataFrame([(1, None, " 1.1.1.1, 2.2.2.2", "9.9.9.9", "x" * 300, True), (2, None, None, "9.9.9.9", None, False)], "user_id long, ts timestamp, forwarded string, peer string, agent string, success boolean")
    assert {(r.ip, len(r.agent)) for r in logs.login_rows(rows).collect()} == {("1.1.1.1", 255), ("9.9.9.9", 0)}


def test_stale_jobs(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "processing"), (2, "2024-01-01 00:00:00", "processing"), (2, "2024-01-01 00:30:00", "done"), (3, "2024-01-01 02:30:00", "processing")]
    late = [(4, "2024-01-01 03:00:00", "done")]
    kind = "job_id long, ts string, status string"
    for k, part in enumerate((rows, late, [(5, "2024-01-01 03:05:00", "done")])):
        spark.createDataFrame(part, kind).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("job_id long, ts timestamp, status string").parquet(str(tmp_path / "in"))
        logs.append_to(logs.stale_jobs(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_collections_rewrite_only_touched_buckets(spark, tmp_path):
    at = str(tmp_path / "points")
    with pytest.raises(FileNotFoundError):
        collections.read_collection(spark, at)
    first = spark.range(500).selectExpr("id AS k", "concat('a', id) AS v")
    assert collections.upsert_collection(first, at, ["k"], buckets=16)["buckets"] == 16
    assert rows_of(collections.read_collection(spark, at)) == {(k, f"a{k}") for k in range(500)}
    done = collections.upsert_collection(spark.createDataFrame([(7, "new"), (900, "more")], "k long, v string"), at, ["k"])
    assert done["buckets"] <= 2
    want = {(k, f"a{k}") for k in range(500) if k != 7} | {(7, "new"), (900, "more")}
    assert rows_of(collections.read_collection(spark, at)) == want
    pointer = collections._pointer(spark, at)
    assert sum(f == done["version"] for f in pointer["folders"].values()) == done["buckets"]
    wide = spark.createDataFrame([(7, "w", 1.5)], "k long, v string, extra double")
    collections.upsert_collection(wide, at, ["k"])
    got = collections.read_collection(spark, at)
    assert got.count() == 501 and got.where("extra is not null").collect()[0].k == 7
    assert collections.vacuum_collection(spark, at) == 0 or got.count() == 501
    with pytest.raises(ValueError):
        collections.upsert_collection(wide, at, ["v"])
    collections.upsert_collection(first.limit(0), at, ["k"])
    assert collections.read_collection(spark, at).count() == 501
    collections.upsert_collection(first.where("k < 3"), at, ["k"], recreate=True)
    assert collections.vacuum_collection(spark, at) >= 2 and collections.read_collection(spark, at).count() == 3


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "points")
    first = spark.range(50).selectExpr("id AS k", "'a' AS v")
    collections.upsert_collection(first, at, ["k"], buckets=4)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(collections, "_switch", killed)  # all files written, the pointer not yet
    with pytest.raises(KeyboardInterrupt):
        collections.upsert_collection(first.withColumn("v", F.lit("b")), at, ["k"])
    monkeypatch.undo()
    bad = first.selectExpr("k", "CASE WHEN k = 40 THEN cast(raise_error('stop') AS string) ELSE 'c' END AS v")
    with pytest.raises(Exception, match="stop"):
        collections.upsert_collection(bad, at, ["k"])
    assert {r.v for r in collections.read_collection(spark, at).collect()} == {"a"}
    assert collections.vacuum_collection(spark, at) >= 1


def test_live_sessions_against_batch_twins(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, base = random.Random(3), datetime.datetime(2024, 1, 1)
    rows, n = [], 0
    for u in range(5):
        t = base
        for _ in range(30):
            t += datetime.timedelta(seconds=rng.choice([5, 30, 60, 61, 200]))
            n += 1
            rows.append((u, n, t))
    rows.sort(key=lambda r: (r[2], r[1]))
    kind, path = "user_id long, session long, ts timestamp", str(tmp_path / "in")
    parts = [rows[k : k + 40] for k in range(0, len(rows), 40)] + [[(99, 10_000, base + datetime.timedelta(days=1))], [(99, 10_001, base + datetime.timedelta(days=2))]]
    got = {}
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
        for policy in (sessions.REPLACE, sessions.BLOCK):
            s = sessions.live_sessions(spark.readStream.schema(kind).parquet(path), policy, 60, late="0 seconds")
            logs.append_to(s, str(tmp_path / policy), str(tmp_path / f"{policy}-state")).awaitTermination()
    for policy in (sessions.REPLACE, sessions.BLOCK):
        got[policy] = {}
        for r in spark.read.parquet(str(tmp_path / policy)).where("user_id < 99").collect():
            assert (r.session, r.outcome) not in got[policy]
            got[policy][r.session, r.outcome] = r.by
    df = spark.createDataFrame(rows, kind)
    at = {s: t for _, s, t in rows}
    ends = {r.session: r.ended_by for r in accounts.single_sessions(df, "user_id", [F.col("ts"), F.col("session")], "session").collect()}
    for s, by in ends.items():  # ended by the next login, unless it had expired before
        soon = by is not None and at[by] - at[s] < datetime.timedelta(seconds=60)
        assert got["replace"].get((s, "ended")) == (by if soon else None) and ((s, "expired") in got["replace"]) != soon
    accepted = {r.session: r.accepted for r in accounts.blocked_logins(df, "user_id", ["ts", "session"], 60, "ts").collect()}
    for s, ok in accepted.items():
        assert ((s, "accepted") in got["block"]) == ok and ((s, "refused") in got["block"]) != ok and ((s, "expired") in got["block"]) == ok
    with pytest.raises(ValueError):
        sessions.live_sessions(df, "other", 60)
