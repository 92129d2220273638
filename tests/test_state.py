import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docvault.operators import limits, sessions
from docvault.streaming import admission, audit_log


def brute(rows, limits_by_kind, window):
    state, out = {}, {}
    for e, client, method, t in sorted(rows, key=lambda r: (r[3], r[0])):
        kind = "POST" if method == "POST" else "GET"
        live = [x for x in state.get((client, kind), []) if t - x <= window]
        out[e] = len(live) < limits_by_kind[kind]
        state[client, kind] = live + [t] if out[e] else live
    return out


def requests(spark, n=900):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.choice(["GET", "POST", "HEAD"]), 1_700_000_000 + rng.randint(0, 2400)) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, client string, method string, t bigint")
    return rows, df.select("event_id", "client", "method", F.timestamp_seconds("t").alias("ts"))


def test_only_admitted_requests_count(spark):
    rows, df = requests(spark)
    got = {r.event_id: r.admitted for r in limits.rate_limited(df, 4, 2, 60).collect()}
    want = brute(rows, {"GET": 4, "POST": 2}, 60)
    assert got == want and not all(want.values())


def test_streamed_verdicts_equal_batch(spark, tmp_path):
    rows, df = requests(spark, 400)
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (admission.rate_limit_stream(stream, 4, 2, 60, "1 hour").writeStream.format("memory").queryName("verdicts")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.event_id: r.admitted for r in spark.table("verdicts").collect()}
    assert got == brute(rows, {"GET": 4, "POST": 2}, 60)


def test_streamed_state_is_carried_between_batches(spark, tmp_path):
    rows, df = requests(spark, 400)
    cuts = [1_700_000_000 + k * 600 for k in range(5)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = df.filter((F.unix_seconds("ts") >= low) & (F.unix_seconds("ts") < (high if high < cuts[-1] else 2 * high)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (admission.rate_limit_stream(stream, 4, 2, 60, "1 hour").writeStream.format("memory").queryName("carried")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    got = {r.event_id: r.admitted for r in spark.table("carried").collect()}
    assert got == brute(rows, {"GET": 4, "POST": 2}, 60)


def _in_turn(spark, parts, verdicts, name, tmp_path):
    """Verdicts of a stream that takes one part after the other, and the progress of its micro-batches."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = verdicts(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.event_id: r.admitted for r in spark.table(name).collect()}, q.recentProgress


def test_keys_share_groups_and_state(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"k{rng.randint(0, 299)}", rng.choice(["GET", "POST"]), 1_700_000_000 + rng.randint(0, 300)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id bigint, client string, method string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    parts = [df.filter(f"t < {1_700_000_150}").drop("t"), df.filter(f"t >= {1_700_000_150}").drop("t")]
    got, progress = _in_turn(spark, parts, lambda s: admission.rate_limit_stream(s, 2, 1, 60, "1 hour", buckets=8), "shared", tmp_path)
    assert got == brute(rows, {"GET": 2, "POST": 1}, 60) and not all(got.values())
    assert 1 <= max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 8


def test_keys_of_a_busy_bucket_are_forgotten(spark, tmp_path):
    df = lambda k, keys: spark.range(len(keys)).select(
        (F.col("id") + 1000 * k).alias("event_id"), F.element_at(F.array(*map(F.lit, keys)), (F.col("id") + 1).cast("int")).alias("client"), F.lit("GET").alias("method"),
        F.timestamp_seconds(F.lit(1_700_000_000 + 1000 * k)).alias("ts"))
    parts = [df(0, [f"gone{i}" for i in range(500)])] + [df(k, ["stays"]) for k in range(1, 5)]
    _, progress = _in_turn(spark, parts, lambda s: admission.rate_limit_stream(s, 2, 1, 60, "1 second", buckets=1), "forgotten", tmp_path)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) == 1
    states = spark.read.format("statestore").load(str(tmp_path / "cp")).select("value.*").collect()
    assert all("gone" not in str(r) for r in states)


def test_streams_do_not_depend_on_the_time_zone(spark, tmp_path):
    # An hour that New York's clocks show twice.
    rows = [(i, "a", "GET", 1_730_611_800 + 600 * i) for i in range(14)]
    df = spark.createDataFrame(rows, "event_id bigint, client string, method string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got, _ = _in_turn(spark, [df.filter("event_id < 7").drop("t"), df.filter("event_id >= 7").drop("t")],
                          lambda s: admission.rate_limit_stream(s, 2, 1, 1800, "1 hour"), "clocks", tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == brute(rows, {"GET": 2, "POST": 1}, 1800) and not all(got.values())


def test_upload_sessions_share_groups(spark, tmp_path):
    rng = random.Random(9)
    ups = [(i, f"s{rng.randint(0, 99)}", f"up_{i}", at(rng.uniform(0, 200))) for i in range(900)]
    gone = [(None, u[1], u[2], u[3] + timedelta(minutes=rng.uniform(-5, 40))) for u in ups if rng.random() < 0.5]
    both = spark.createDataFrame(ups + gone, "event_id bigint, sid string, id string, ts timestamp")
    uploads, deletions = both.filter("event_id is not null").withColumnRenamed("ts", "created"), both.filter("event_id is null").drop("event_id")
    want = {r.event_id: r.admitted for r in sessions.accepted_uploads(uploads, deletions, 2, 1800).collect()}
    parts = [both.filter(F.col("ts") < at(90)), both.filter(F.col("ts") >= at(90))]
    got, progress = _in_turn(spark, parts, lambda s: admission.upload_stream(
        s.filter("event_id is not null").withColumnRenamed("ts", "created"), 2, 1800, "5 hours", s.filter("event_id is null").drop("event_id"), buckets=8), "sessions", tmp_path)
    assert got == want and not all(want.values())
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 8


def test_streamed_uploads_with_deletions(spark, tmp_path):
    rng = random.Random(7)
    ups = [(i, f"s{rng.randint(0, 3)}", f"up_{i}", at(rng.uniform(0, 200))) for i in range(120)]
    gone = [(u[1] if rng.random() < 0.8 else "s9", u[2], u[3] + timedelta(minutes=rng.uniform(-5, 40))) for u in ups if rng.random() < 0.5]
    uploads = spark.createDataFrame(ups, "event_id bigint, sid string, id string, created timestamp")
    deletions = spark.createDataFrame(gone, "sid string, id string, ts timestamp")
    want = {r.event_id: r.admitted for r in sessions.accepted_uploads(uploads, deletions, 2, 1800).collect()}
    both = uploads.select("event_id", "sid", "id", F.col("created").alias("ts")).unionByName(deletions.select(F.lit(None).cast("bigint").alias("event_id"), "sid", "id", "ts"))
    for k in range(4):  # one file after the other, in the order of time
        part = both.filter((F.col("ts") >= F.lit(at(-10 + 60 * k))) & (F.col("ts") < F.lit(at(-10 + 60 * (k + 1) if k < 3 else 10**5))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    verdicts = admission.upload_stream(stream().filter("event_id is not null").withColumnRenamed("ts", "created"), 2, 1800, "5 hours",
                                       stream().filter("event_id is null").drop("event_id"))
    q = verdicts.writeStream.format("memory").queryName("uploaded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    assert {r.event_id: r.admitted for r in spark.table("uploaded").collect()} == want and not all(want.values())


def at(minute):
    return datetime(2024, 5, 1, 10) + timedelta(minutes=minute)


def test_upload_cap_expiry_and_deletion(spark):
    ups = [(i, "s1", f"up_{i}", at(m)) for i, m in enumerate([0, 1, 2, 3, 10, 30.5, 40])] + [(9, "s2", "up_9", at(3))]
    uploads = spark.createDataFrame(ups, "event_id bigint, sid string, id string, created timestamp")
    gone = spark.createDataFrame([("s1", "up_1", at(9)), ("s2", "up_2", at(9))], "sid string, id string, ts timestamp")
    got = {r.id: r.admitted for r in sessions.accepted_uploads(uploads, gone).collect()}
    # the fourth is one too many; a deletion and later an expiry make room; another session cannot delete
    assert got == {"up_0": True, "up_1": True, "up_2": True, "up_3": False, "up_4": True, "up_5": True, "up_6": True, "up_9": True}
    kept = sessions.without_deleted(uploads, gone)
    assert {r.id for r in kept.collect()} == {"up_0", "up_2", "up_3", "up_4", "up_5", "up_6", "up_9"}
    assert {(r.id, r.deleted) for r in sessions.deletion_results(uploads, gone).collect()} == {("up_1", True), ("up_2", False)}
    live = sessions.live_uploads(uploads, F.lit("2024-05-01 10:30:00"))
    assert {r.id: r.expires_in_min for r in live.collect()}["up_0"] == 0 and live.filter("id = 'up_5'").count() == 0


def test_last_used_sessions(spark):
    rows = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("a", at(3)), ("c", at(0))], "sid string, ts timestamp")
    assert [r.sid for r in sessions.active_sessions(rows, 2).collect()] == ["a", "b"]


def test_audit_stream(spark, tmp_path):
    rows = spark.range(20).select(
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 9000).alias("ts"), F.col("id").alias("seq"), F.lit("s").alias("session"),
        F.lit("hr").alias("role"), F.lit("ask").alias("kind"), F.lit("q").alias("question"), F.lit("d").alias("docs"),
        F.lit(1).alias("refused"), F.lit(2).alias("masked"), F.lit(0).alias("injections"), F.lit(5).alias("ms"))
    rows.write.json(str(tmp_path / "in"))
    audit_log.store_audit(audit_log.audit_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 20 and "day" in stored.columns
    hourly = audit_log.running_totals(rows)
    assert hourly.agg(F.sum("masked")).first()[0] == 40
