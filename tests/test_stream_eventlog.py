import datetime as dt
import gzip
import os

from pyspark.sql import functions as F

from rollscope.sources import eventlog as evl
from rollscope.sources import files as fl
from rollscope.streaming.rolled import ingested_chunks, ingested_files, stream_rolled_files


def put(path, data, gz=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(gzip.compress(data, mtime=0) if gz else data)


def test_stream_matches_batch_and_is_incremental(spark, scratch):
    home = os.path.join(scratch, "home")
    put(f"{home}/a/a-driver_1.gz", b"x" * 10, gz=True)
    put(f"{home}/a/a-driver_2", b"yy")
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    stream_rolled_files(spark, home, out, ck, chunk_bytes=4)
    files = {r.file_name: r.length for r in ingested_files(spark, out).collect()}
    assert files == {"a-driver_1.gz": 10, "a-driver_2": 2}
    batch = fl.build_chunks(spark, home, 4)
    assert ingested_chunks(spark, out).count() == batch.count() == 4
    stream_rolled_files(spark, home, out, ck, chunk_bytes=4)          # rerun: nothing new
    assert ingested_files(spark, out).count() == 2
    put(f"{home}/b/b-exec-1_1", b"new file")
    stream_rolled_files(spark, home, out, ck, chunk_bytes=4)
    files = {r.file_name: r.length for r in ingested_files(spark, out).collect()}
    assert files["b-exec-1_1"] == 8 and len(files) == 3


def test_event_logs_round_trip(spark, scratch):
    D = dt.datetime
    flat = spark.createDataFrame(
        [("app-1", "one", 0, "2", D(2024, 1, 2), D(2024, 1, 3), False),
         ("app-1", "one", 1, "1", D(2024, 1, 1), D(2024, 1, 1, 5), True),
         ("app-2", "two", 0, "1", D(2024, 2, 1), D(2024, 2, 2), True)],
        "id string, name string, attempt_idx int, attemptId string, startTime timestamp_ntz, "
        "endTime timestamp_ntz, completed boolean")
    execs = spark.createDataFrame(
        [("app-1", "driver", "h:1", 4, D(2024, 1, 2), {"stdout": "u"})],
        "app_id string, id string, hostPort string, totalTasks int, addTime timestamp_ntz, "
        "executorLogs map<string,string>")
    root = os.path.join(scratch, "ev")
    evl.write_event_logs(evl.event_lines_of(flat, execs), root, layout="folders")
    apps, ex = evl.event_logs_to_tables(evl.read_event_lines(spark, root))
    got = {r.id: r for r in apps.collect()}
    a1 = got["app-1"].attempts
    assert [x.attemptId for x in a1] == ["2", "1"]
    assert a1[0].completed is False and a1[0].endTime is None
    assert a1[1].endTime == D(2024, 1, 1, 5)
    assert got["app-2"].name == "two"
    e = ex.collect()
    assert len(e) == 1 and e[0].app_id == "app-1" and e[0].executorLogs == {"stdout": "u"} and e[0].isActive
    out = os.path.join(scratch, "export")
    req = spark.createDataFrame([("app-1", "1")], "app_id string, attempt_id string")
    evl.export_event_logs(evl.read_event_lines(spark, root), req, out)
    back = spark.read.text(out)
    assert back.select("attempt_id").distinct().collect()[0][0] in (1, "1")
    assert back.where(F.col("value").contains("ApplicationEnd")).count() == 1


def test_exported_parts_are_listed_and_read_back(spark, scratch):
    ids = ["007", "a/b=c", "7", "x y"]  # names that a folder listing would read as numbers, or split
    flat = spark.createDataFrame([(i, f"n {i}", 0, str(k), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3), True)
                                  for i in ids for k in (1, 2)],
                                 "id string, name string, attempt_idx int, attemptId string, startTime timestamp_ntz, "
                                 "endTime timestamp_ntz, completed boolean")
    execs = spark.createDataFrame([], "app_id string, id string, hostPort string, totalTasks int, addTime timestamp_ntz, "
                                      "executorLogs map<string,string>")
    lines = evl.event_lines_of(flat, execs)
    out = os.path.join(scratch, "export")
    req = spark.createDataFrame([(i, None) for i in ids[:3]] + [("x y", "2")], "app_id string, attempt_id string")
    for _ in range(2):  # the second export replaces the first
        evl.export_event_logs(lines, req, out)
    back = {}
    for r in sorted(evl.read_exported(spark, out).collect(), key=lambda r: (r.part, r.at)):
        back.setdefault((r.app_id, r.attempt_id), []).append(r.value)
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r.log, r.line)):
        app, attempt = r.log[len("eventlog_v2_"):].rsplit("_", 1)
        if app != "x y" or attempt == "2":
            want.setdefault((app, attempt), []).append(r.value)
    assert back == want
    plain = spark.read.text(out)  # Spark's own reader finds the same lines
    assert plain.count() == sum(map(len, want.values()))
    assert not [f for _, _, names in os.walk(out) for f in names if f.endswith(".tmp")]


def test_attempts_are_sorted_after_the_shuffle_only(spark, scratch):
    rows = [("a", '{"Event":"SparkListenerApplicationStart","App ID":"1","App Name":"n","Timestamp":1}'),
            ("a", '{"Event":"SparkListenerApplicationEnd","Timestamp":9}'), ("b", '{"Event":"SparkListenerApplicationEnd","Timestamp":2}')]
    path = os.path.join(scratch, "lines")
    spark.createDataFrame(rows, "log string, value string").write.parquet(path)
    found = evl.attempts_of(evl.parse_events(spark.read.parquet(path)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "SortAggregate" not in plan[plan.rindex("Exchange"):]
    got = {r.log: (r.id, r.start_ms, r.end_ms, r.completed) for r in found.collect()}
    assert got == {"a": ("1", 1, 9, True), "b": (None, None, 2, True)}
