"""Ordinary situations that once lost or mixed data: late files, odd names, repeated ids, order."""

import gzip
import os

import pytest

from rollscope.operators import paging as pg
from rollscope.operators import slices as sl
from rollscope.operators import tenant as tn
from rollscope.session import data_key
from rollscope.sources import eventlog as evl
from rollscope.sources import files as fl
from rollscope.streaming.rolled import ingested_chunks, ingested_files, stream_rolled_files

REQUEST = "request_id string, app string, pod string, offset long, byte_length long"


def put(path, data, gz=False, age=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(gzip.compress(data, mtime=0) if gz else data)
    if age:
        t = os.path.getmtime(path) - age
        os.utime(path, (t, t))


def whole_log(spark, files, chunk_dir):
    rq = spark.createDataFrame([("r", "a", "driver", None, 10**6)], REQUEST)
    return bytes(sl.log_slices(rq, files, fl.read_chunks(spark, chunk_dir), chunk_bytes=4).first().bytes)


def test_refresh_takes_late_files_and_deletions(spark, scratch):
    home, table, chunk_dir = f"{scratch}/home", f"{scratch}/t", f"{scratch}/c"
    put(f"{home}/a/a-driver_1", b"AAAA")
    fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    day = 86_400
    put(f"{home}/a/a-driver_2", b"BBBB", age=day)
    put(f"{home}/a/a-driver_3.gz", b"CCCC", gz=True, age=day)
    put(f"{home}/a/a-driver_4", b"DDDD")
    files = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    assert whole_log(spark, files, chunk_dir) == b"AAAABBBBCCCCDDDD"
    put(f"{home}/a/a-driver_5", b"EEEE", age=30 * day)  # only an old file is new
    files = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    assert whole_log(spark, files, chunk_dir) == b"AAAABBBBCCCCDDDDEEEE"
    os.remove(f"{home}/a/a-driver_5")  # a deletion only
    files = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    assert whole_log(spark, files, chunk_dir) == b"AAAABBBBCCCCDDDD"
    put(f"{home}/a/a-driver_6.gz", b"", gz=True)  # an empty payload only
    files = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    assert {r.file_name: r.length for r in files.collect()}["a-driver_6.gz"] == 0


def test_partition_like_and_wildcard_names(spark, scratch):
    put(f"{scratch}/h[1]/a/a-driver_1", b"own")
    put(f"{scratch}/h[1]/a/day=1/a-driver_2", b"deeper")
    put(f"{scratch}/h1/b/b-driver_1", b"sibling")
    got = {(r.app, r.file_name) for r in fl.scan_log_files(spark, f"{scratch}/h[1]").collect()}
    assert got == {("a", "a-driver_1")}


def test_chunks_never_shuffle_file_bytes(spark, scratch):
    put(f"{scratch}/home/a/a-driver_1", b"0123456789")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = fl.build_chunks(spark, f"{scratch}/home", 4)
        assert "content" not in chunks._jdf.queryExecution().executedPlan().toString()
        assert [bytes(r.bytes) for r in chunks.orderBy("chunk_no").collect()] == [b"0123", b"4567", b"89"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_requests_are_answered_each(spark, scratch):
    home = f"{scratch}/home"
    put(f"{home}/a/a-driver_1", b"AAAABBBB")
    listing = fl.scan_log_files(spark, home)
    chunks = fl.build_chunks(spark, home, 4)
    files = fl.uncompressed_length(listing, chunks)
    rq = spark.createDataFrame([("r", "a", "driver", 0, 4)] * 3 + [("x", "a", None, 0, 4), ("m", "zz", "driver", 0, 4)] * 2, REQUEST)
    out = sl.log_slices(rq, files, chunks, dirs=fl.log_directories(spark, home), chunk_bytes=4).collect()
    assert [bytes(r.bytes) for r in out if r.request_id == "r"] == [b"AAAA"] * 3
    assert len(out) == 7
    assert all(r.header is None for r in out if r.request_id in "xm")


def test_growth_beyond_int(spark):
    cur = spark.createDataFrame([("c", "a", "driver", 0, 0, 5)], "client string, app string, pod string, start_byte long, end_byte long, total_bytes long")
    now = spark.createDataFrame([("a", "driver", 5 + (3 << 30))], "app string, pod string, total_bytes long")
    r = pg.new_bytes(cur, now).first()
    assert r.byte_length == 3 << 30 and r.offset == 5


def test_repeated_and_null_request_ids(spark):
    apps = spark.createDataFrame([("1", "t1-job", []), ("2", "t2-job", [])],
                                 "id string, name string, attempts array<struct<attemptId:string, startTime:timestamp_ntz, "
                                 "endTime:timestamp_ntz, completed:boolean>>")
    pol = tn.TenantPolicy.from_settings("true", "", "none")
    req = spark.createDataFrame([("r", "t1", "1"), ("r", "t1", "2"), (None, "t1", "1"), (None, "t1", "2"), ("r", "t1", "x")],
                                "request_id string, tenant_id string, app_id string")
    got = sorted((str(r.request_id), r.app_id, r.decision) for r in tn.tenant_access(req, apps, pol).collect())
    assert got == [("None", "1", "ok"), ("None", "2", "forbidden"), ("r", "1", "ok"), ("r", "2", "forbidden"), ("r", "x", "not_found")]
    seen = sorted((str(r.request_id), r.app_id, r.visible) for r in tn.tenant_match(req, apps, pol).collect())
    assert seen == [("None", "1", True), ("None", "2", False), ("r", "1", True), ("r", "2", False), ("r", "x", False)]


def start(app, ms):
    return '{"Event":"SparkListenerApplicationStart","App Name":"n","App ID":"%s","Timestamp":%d,"User":"u"}' % (app, ms)


def test_single_file_event_logs(spark, scratch):
    root = f"{scratch}/ev"
    put(f"{root}/app-1", (start("app-1", 1000) + "\n").encode())
    put(f"{root}/app-2.gz", (start("app-2", 2000) + "\n").encode(), gz=True)
    put(f"{root}/eventlog_v2_app-3/events_1_app-3", (start("app-3", 3000) + "\n").encode())
    apps, _ = evl.event_logs_to_tables(evl.read_event_lines(spark, root))
    assert sorted(r.id for r in apps.collect()) == ["app-1", "app-2", "app-3"]


def test_export_keeps_line_order(spark, scratch):
    root, out = f"{scratch}/ev", f"{scratch}/out"
    n = 5000
    for k in (1, 2, 10):  # numeric order of the rolled files, not by name
        first = [start("app-9", 1000)] if k == 1 else []
        put(f"{root}/eventlog_v2_app-9/events_{k}_app-9", "\n".join([*first, *(f"line {k} {i}" for i in range(n))]).encode())
    req = spark.createDataFrame([("app-9", None)], "app_id string, attempt_id string")
    evl.export_event_logs(evl.read_event_lines(spark, root), req, out)
    lines = []
    for d, _, names in sorted(os.walk(out)):
        for name in sorted(x for x in names if x.startswith("part-")):
            lines += gzip.open(os.path.join(d, name), "rt").read().splitlines()
    assert lines == [start("app-9", 1000), *(f"line {k} {i}" for k in (1, 2, 10) for i in range(n))]


def test_stream_takes_old_and_empty_files(spark, scratch):
    home, out, ck = f"{scratch}/home", f"{scratch}/out", f"{scratch}/ck"
    put(f"{home}/a/a-driver_1", b"AAAA")
    stream_rolled_files(spark, home, out, ck, chunk_bytes=4)
    put(f"{home}/a/a-driver_2.gz", b"", gz=True)  # a batch with nothing but an empty payload
    stream_rolled_files(spark, home, out, ck, chunk_bytes=4)
    put(f"{home}/a/a-driver_3", b"CCCC", age=40 * 86_400)
    stream_rolled_files(spark, home, out, ck, chunk_bytes=4)
    files = ingested_files(spark, out)
    assert {r.file_name: r.length for r in files.collect()} == {"a-driver_1": 4, "a-driver_2.gz": 0, "a-driver_3": 4}
    rq = spark.createDataFrame([("r", "a", "driver", None, 100)], REQUEST)
    assert bytes(sl.log_slices(rq, files, ingested_chunks(spark, out), chunk_bytes=4).first().bytes) == b"AAAACCCC"


def test_data_key_tells_folders_apart():
    assert data_key("/a/sf0.1") != data_key("/b/sf0.1") and data_key("/a/sf0.1/") == data_key("/a/sf0.1")


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from rollscope.session import shared_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                         getConf=lambda: SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))
