"""Scalar rules, run contexts, sink guards, upserts and streams in several batches."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import values as V
from tidemark.session import stage_root
from tidemark.sources import files
from tidemark.sources import sinks as K
from tidemark.streaming import alerts as SA
from tidemark.streaming import positions as SP


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


@pytest.mark.parametrize("raw,want", [(" 8058 ", "8058.T"), ("8058.t", "8058.T"), ("abc", "ABC"), (None, "")])
def test_ticker(spark, raw, want):
    assert one(spark, V.normalize_ticker(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("1.5", 1.5), ("1d", 7.0), ("", 7.0), (None, 7.0), ("x", 7.0), ("1e3", 1000.0)])
def test_safe_float(spark, raw, want):
    assert one(spark, V.safe_float(F.lit(raw).cast("string"), 7.0)) == want


@pytest.mark.parametrize("v,want", [(90.0, "90"), (0.5, "0.5"), (100.0, "100"), (1.25, "1.25")])
def test_number_text(spark, v, want):
    assert one(spark, V.number_text(F.lit(v))) == want


def test_strict_code_raises(spark):
    assert one(spark, V.strict_security_code(F.lit(" 62730 "))) == "62730"
    with pytest.raises(Exception, match="bad security code"):
        one(spark, V.strict_security_code(F.lit("6273")))


def test_run_context_cases(spark):
    base = {"trigger_event": "schedule", "trigger_origin": "github_schedule", "dispatch_key": "", "as_of": "", "scheduled_cron": R.SCHEDULE_CRON, "timezone": R.SCHEDULE_ZONE, "run_started_at": "2026-07-27T11:20:00Z"}
    cases = [
        (base, "2026-07-27", None),
        ({**base, "run_started_at": "2026-07-27T11:00:00Z"}, "2026-07-24", None),
        ({**base, "as_of": "2026-07-24"}, None, "schedule_as_of"),
        ({**base, "run_started_at": "2026-07-27T11:20:00"}, None, "bad_run_started_at"),
        ({**base, "trigger_event": "workflow_dispatch", "trigger_origin": "cloudflare_cron", "dispatch_key": "cloudflare_cron:2026-07-27T11:17:00.000Z", "as_of": "2026-07-27"}, "2026-07-27", None),
        ({**base, "trigger_event": "workflow_dispatch", "trigger_origin": "cloudflare_cron", "dispatch_key": "cloudflare_cron:2026-07-27T18:17:00.000Z", "as_of": "2026-07-27"}, None, "dispatch_key_date"),
        ({**base, "trigger_event": "local", "trigger_origin": "local_cli"}, "2026-07-27", None),
    ]
    rows = R.resolve_run_context(spark.createDataFrame(pd.DataFrame([{**c, "i": i} for i, (c, _, _) in enumerate(cases)]))).orderBy("i").collect()
    for r, (_, day, err) in zip(rows, cases):
        assert (r.error, str(r.requested_as_of) if r.requested_as_of else None) == (err, day)


def test_sink_guard_and_json(spark):
    with pytest.raises(ValueError, match="nested.close"):
        K.assert_aggregate(spark.range(1).select(F.struct(F.lit(1).alias("close")).alias("nested")))
    with pytest.raises(ValueError, match="empty"):
        K.assert_aggregate(spark.range(0).select(F.col("id").alias("n")))
    bad = spark.range(1).select(F.lit(float("nan")).alias("b"), F.lit(1).alias("a"))
    assert K.json_text(bad).first()[0] == '{"a":1,"b":null}'
    with pytest.raises(Exception, match="non-finite"):
        K.json_text(bad, strict=True).first()


def test_upsert_last_update_wins_and_new_keys_all_append(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    upd = spark.createDataFrame([("a", 10, 0), ("a", 11, 1), ("c", 5, 2), ("c", 6, 3)], "k string, v long, p long")
    merged, counts = K.upsert(base, upd, ["k"], "p")
    assert sorted(map(tuple, merged.collect())) == [("a", 11), ("b", 2), ("c", 5), ("c", 6)]
    assert tuple(counts.first()) == (2, 2)


def test_publish_keeps_the_last_of_repeated_updates(spark):
    base = stage_root(spark) + f"/pub-{dt.datetime.now().timestamp()}"
    first = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "k string, v long, p long")
    again = spark.createDataFrame([("a", v, "n", v) for v in (3, 5, 1, 4, 2)] + [("c", 9, "n", 6)], "k string, v long, note string, p long")
    K.publish(spark, base, {"t": (first, ["k"], "p")}, "1")
    counts = K.publish(spark, base, {"t": (again, ["k"], "p")}, "2", "1")
    assert sorted(map(tuple, spark.read.parquet(K.keyed_path(base, "t", "2")).collect())) == [("a", 5, "n"), ("b", 0, ""), ("c", 9, "n")]
    assert tuple(counts.first()) == ("t", 1, 5)
    K.publish(spark, base, {"t": (first, ["k"], "p")}, "2", "1", dry_run=True)
    assert spark.read.parquet(K.keyed_path(base + "/preview", "t", "2")).count() == 2


@pytest.mark.parametrize("n,want", [(7, "0007"), (1234, "1234"), (12345, "12345")])
def test_padding_cuts_nothing(spark, n, want):
    assert spark.range(1).select(V.zero_padded(F.lit(n), 4)).first()[0] == want


def test_missing_csv_gives_no_rows(spark):
    df = files.read_csv_rows(spark, stage_root(spark) + "/absent.csv", ["a", "b"])
    assert df.count() == 0 and df.columns == ["a", "b"]


RULES = R.AlertRules("ALERTS", "signal", "v1")
META = [("1.T", "one", "Machinery", "Large"), ("2.T", "two", "Banks", "Large")]


def payload(ticker, day, score="95", flags=True):
    f = ", ".join(f'"{n}": "{"yes" if flags else "no"}"' for n in R.ALERT_FLAGS)
    return f'{{"system": "ALERTS", "type": "signal", "version": "v1", "ticker": "{ticker}", "stable_score": "{score}", "signal_date": "{day}", {f}}}'


def test_alert_stream_in_batches_equals_event_at_a_time(spark):
    texts = [payload("1", "2024-01-02", "50"), payload("1", "2024-01-02"), payload("1", "2024-01-02"), payload("2", "2024-01-02"), payload("1", "2024-01-03"), payload("1", "2024-01-02"), payload("9", "2024-01-02")]
    want = ["payload_score_below_90", "accepted", "duplicate_signal", "not_strong_sector", "accepted", "duplicate_signal", "ticker_not_in_stable_universe"]
    root = stage_root(spark) + f"/t-{dt.datetime.now().timestamp()}"
    schema = "alert_id long, received_at timestamp, payload string"
    for i in range(0, len(texts), 2):
        rows = [(j, dt.datetime(2024, 1, 5, 0, j), texts[j]) for j in range(i, min(i + 2, len(texts)))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root + "/in")
    meta = spark.createDataFrame(META, "ticker string, name string, sector string, market_cap_bucket string")
    job = SA.AlertIntake(spark, root + "/out", meta, RULES)
    job.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")).awaitTermination()
    assert [r.reason for r in job.table("alerts").orderBy("alert_id").collect()] == want
    assert [(r.pending_order_id, r.signal_date) for r in job.table("pending").orderBy("pending_order_id").collect()] == [("PO000001", "2024-01-02"), ("PO000002", "2024-01-03")]


def test_position_monitor_in_batches(spark):
    root = stage_root(spark) + f"/p-{dt.datetime.now().timestamp()}"
    schema = "position_id string, seq long, open double, low double, high double, close double"
    flat = [("hold", i, 100.0, 99.0, 101.0, 100.0) for i in range(70)]
    stop = [("stop", i, 100.0, 99.0, 101.0, 100.0) for i in range(5)] + [("stop", 5, 100.0, 80.0, 101.0, 90.0), ("stop", 6, 100.0, 50.0, 200.0, 90.0)]
    rows = sorted(flat + stop, key=lambda r: r[1])
    for a in range(0, 70, 20):
        part = [r for r in rows if a <= r[1] < a + 20]
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(root + "/in")
    q = SP.monitor(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in"))
    q.writeStream.format("parquet").option("path", root + "/o").option("checkpointLocation", root + "/c").trigger(availableNow=True).start().awaitTermination()
    got = {r.position_id: (r.exit_reason, r.exit_seq, r.bars_seen) for r in spark.read.parquet(root + "/o").collect()}
    assert got == {"hold": ("max_holding", 59, 60), "stop": ("stop_loss", 5, 6)}


def test_position_monitor_drops_late_and_repeated_bars(spark):
    root = stage_root(spark) + f"/l-{dt.datetime.now().timestamp()}"
    schema = "position_id string, seq long, open double, low double, high double, close double"
    bar = lambda i, low=99.0: ("x", i, 100.0, low, 101.0, 100.0)
    batches = [[bar(i) for i in range(10, 50)], [bar(i, 10.0) for i in range(10)] + [bar(i, 10.0) for i in range(30, 50)], [bar(i) for i in range(50, 75)] * 2]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(root + "/in")
    q = SP.monitor(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in"))
    q.writeStream.format("parquet").option("path", root + "/o").option("checkpointLocation", root + "/c").trigger(availableNow=True).start().awaitTermination()
    assert [(r.exit_reason, r.exit_seq, r.bars_seen) for r in spark.read.parquet(root + "/o").collect()] == [("max_holding", 69, 60)]


def drained(spark, stream, root):
    stream.writeStream.format("parquet").option("path", root + "/o").option("checkpointLocation", root + "/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(root + "/o")


def test_first_of_key_equals_the_batch_rule_on_out_of_order_rows(spark):
    root = stage_root(spark) + f"/f-{dt.datetime.now().timestamp()}"
    at = lambda m: dt.datetime(2024, 1, 5, 0, m)
    rows = [("k", at(9), 1), ("k", at(3), 7), ("k", at(3), 5), ("j", at(4), 2), ("j", at(2), 8), ("i", at(5), 3)]
    later = [("k", at(20), 0), ("h", at(21), 4), ("i", at(22), 1)]
    schema = "dedup_key string, received_at timestamp, alert_id long"
    for part in (rows, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(root + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
    got = sorted(map(tuple, drained(spark, SP.judged_stream(stream).select("alert_id", "reason"), root).collect()))
    checked = spark.createDataFrame(rows + later, schema).withColumn("reason", F.lit("accepted"))
    assert got == sorted(map(tuple, SA.mark_duplicates(checked).select("alert_id", "reason").collect()))
    assert [i for i, r in got if r == "accepted"] == [3, 4, 5, 8]


def test_late_bars_are_counted_and_idle_positions_forgotten(spark):
    root = stage_root(spark) + f"/w-{dt.datetime.now().timestamp()}"
    schema = "position_id string, time timestamp, seq long, open double, low double, high double, close double"
    bar = lambda p, day: (p, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), day, 100.0, 99.0, 101.0, 100.0)
    batches = [[bar("a", d) for d in range(5, 9)] + [bar("b", 5)], [bar("a", 6), bar("a", 7), bar("a", 9)], [bar("c", 60)], [bar("c", 61)], [bar("b", 62)]]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(root + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in").withWatermark("time", "1 day")
    rows = drained(spark, SP.watch(stream, idle_ms=10 * 24 * 3600 * 1000), root).collect()
    assert {(r.position_id, r.bars_seen) for r in rows if r.event == "late"} == {("a", 2)}
    assert {(r.position_id, r.bars_seen) for r in rows if r.event == "forgotten"} >= {("a", 5), ("b", 1)}


def test_a_batch_of_alerts_reads_only_the_batch_before(spark):
    root = stage_root(spark) + f"/b-{dt.datetime.now().timestamp()}"
    schema = "alert_id long, received_at timestamp, payload string"
    for i in range(6):
        spark.createDataFrame([(i, dt.datetime(2024, 1, 5, 0, i), payload("1", f"2024-01-{10 + i // 2}"))], schema).coalesce(1).write.mode("append").parquet(root + "/in")
    meta = spark.createDataFrame(META, "ticker string, name string, sector string, market_cap_bucket string")
    job = SA.AlertIntake(spark, root + "/out", meta, RULES)
    query = job.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in"))
    query.awaitTermination()
    assert [r.pending_order_id for r in job.table("pending").orderBy("pending_order_id").collect()] == ["PO000001", "PO000002", "PO000003"]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) == 3  # one flag a key, however many alerts


def test_bucketed_upsert_leaves_other_buckets_alone(spark):
    root = stage_root(spark) + f"/u-{dt.datetime.now().timestamp()}"
    files_of = lambda: {r.b: r.f for r in spark.read.option("mergeSchema", "true").parquet(root).groupBy(F.col("bucket").alias("b")).agg(F.max(F.col("_metadata.file_path")).alias("f")).collect()}
    first = spark.createDataFrame([(f"k{i}", "a", 0) for i in range(400)], "k string, v string, p int")
    assert K.upsert_buckets(spark, root, first, ["k"], "p", 16) == (400, 0)
    before = files_of()
    update = spark.createDataFrame([("k7", "b", 1), ("k7", "c", 2), ("new", "d", 1)], "k string, v string, p int").withColumn("extra", F.lit("x"))
    assert K.upsert_buckets(spark, root, update, ["k"], "p", 16) == (1, 2)
    after = files_of()
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2
    once = sorted(map(tuple, spark.read.option("mergeSchema", "true").parquet(root).select("k", "v", "extra").fillna("").collect()))
    assert len(once) == 401 and ("k7", "c", "x") in once and ("new", "d", "x") in once and ("k8", "a", "") in once
    K.upsert_buckets(spark, root, update, ["k"], "p", 16)
    assert sorted(map(tuple, spark.read.option("mergeSchema", "true").parquet(root).select("k", "v", "extra").fillna("").collect())) == once


def test_a_stream_lands_in_few_steps_from_rows_built_once(spark, tmp_path):
    from tidemark.catalog import jobs

    built = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            built.add(b.num_rows)
            yield b

    rows = spark.range(5000).selectExpr("id", "(id * 37) % 5000 AS at").repartition(3).mapInArrow(note, "id long, at long")
    tops = []

    def run(stream):
        assert stream.isStreaming
        tops.append(spark.read.parquet(str(tmp_path / "in")).agg({"at": "max"}).first()[0])

    jobs.landed(spark, rows, "at", str(tmp_path / "in"), run)
    assert built.value == 5000 and len(tops) == jobs.LANDINGS and tops == sorted(set(tops))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "in")).collect()) == list(range(5000))


def test_files_of_a_folder_are_written_by_many_tasks(spark, tmp_path):
    from tidemark.catalog import jobs

    rows = spark.createDataFrame([("R", k, f"{k}|1|5") for k in range(64)], "l_returnflag string, l_suppkey long, content string").coalesce(1)
    jobs.write_contents(rows, str(tmp_path / "run"))
    names = [p.name.split("-")[1] for p in (tmp_path / "run" / "raw").rglob("part-*.txt")]
    assert len(names) == 64 and len(set(names)) > 1


def test_files_by_key_cost_no_process_each_and_equal_sparks(spark, tmp_path):
    from tidemark.catalog import jobs

    rows = spark.createDataFrame([("R", k, f"{k}|1|5") for k in range(40)] + [("A", None, "2|ü"), ("N", -7, ""), ("X", 1, "x"), (None, 2, "y")], "l_returnflag string, l_suppkey long, content string")
    jobs.write_contents(rows, str(tmp_path / "own"))
    for flag, folder in (("R", "raw"), ("A", "normalized"), ("N", "other")):
        rows.where(F.col("l_returnflag") == flag).selectExpr("l_suppkey AS k", "content").write.partitionBy("k").text(str(tmp_path / "spark" / folder))
    held = lambda top: sorted((str(p.parent.relative_to(top)), p.read_bytes()) for p in top.rglob("part-*.txt"))
    assert held(tmp_path / "own") == held(tmp_path / "spark") and len(held(tmp_path / "own")) == 42
    # Hadoop's local file system starts a process for each checksum file too.
    assert not list((tmp_path / "own").rglob("*.crc"))


def test_files_by_key_hold_all_lines_of_a_key(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 3 AS k", "IF(id = 5, NULL, string(id)) AS line").repartition(2, "k")
    K.write_text_by_key(rows, str(tmp_path / "run"), "k", "line")
    found = sorted((tmp_path / "run").rglob("*"))
    assert [p.parent.name for p in found if p.is_file()] == ["k=0", "k=1", "k=2"]
    lines = {p.parent.name: sorted(p.read_text().split("\n")[:-1]) for p in found if p.is_file()}
    assert lines["k=2"] == sorted("" if i == 5 else str(i) for i in range(2, 3000, 3)) and len(lines["k=0"]) == 1000
    with pytest.raises(FileExistsError):
        K.write_text_by_key(rows, str(tmp_path / "run"), "k", "line")


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(90):
        (tmp_path / "raw" / f"k={k}").mkdir(parents=True)
        (tmp_path / "raw" / f"k={k}" / "part-0.txt").write_text(str(k))
    sc, conf = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(conf)
    sc.setJobGroup("listing", "listing")
    try:
        prints = files.fingerprint_files(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = [sc.statusTracker().getStageInfo(s).numTasks for j in sc.statusTracker().getJobIdsForGroup("listing") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert seen and max(seen) <= files.LISTERS * sc.defaultParallelism < 90
    assert spark.conf.get(conf) == before and prints.count() == 90
