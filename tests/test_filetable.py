"""Chunk locators, parts of slices, the log-structured file table, growing files, listings of any storage, the stream source."""

import gzip
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from rollscope.operators import slices as sl
from rollscope.sources import eventlog as evl
from rollscope.sources import files as fl
from rollscope.sources import filetable as ft
from rollscope.sources import storage as st
from rollscope.streaming import rolled

REQUEST = "request_id string, app string, pod string, offset long, byte_length long"


def put(home, rel, data, mode="wb"):
    p = os.path.join(home, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, mode) as f:
        f.write(data)


def refreshed(spark, home, scratch, chunk=8, **more):
    files = fl.refresh_file_table(spark, home, f"{scratch}/t", f"{scratch}/c", chunk, **more)
    return files, fl.read_locators(spark, f"{scratch}/c")


def exchanged(df):
    """The columns of every exchange of the plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", text)


def test_located_slices_equal_python_and_shuffle_no_bytes(spark, scratch):
    rnd, home, logs = random.Random(3), f"{scratch}/home", {}
    for app in ("a", "b"):
        data = b""
        for k in range(6):
            piece = rnd.randbytes(rnd.choice([0, 1, 7, 8, 9, 300, 1000]))
            put(home, f"{app}/{app}-driver_{k:03}" + (".gz" if k % 2 else ""), gzip.compress(piece, mtime=0) if k % 2 else piece)
            data += piece
        logs[app] = data
    files, at = refreshed(spark, home, scratch)
    reqs = [(f"{app}{i}", app, "driver", rnd.choice([None, rnd.randint(-5, len(d) + 5)]), rnd.randint(0, len(d) + 5))
            for app, d in logs.items() for i in range(15)]
    reqs += [reqs[0], ("gone", "zz", "driver", 0, 5), ("bad", "a", None, 0, 5)]
    rq = spark.createDataFrame(reqs, REQUEST)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sl.log_slices(rq, files, at, chunk_bytes=8, bucket_bytes=64)
        moved = exchanged(out)
        rows = out.collect()
        parts = sl.log_slices(rq, files, at, chunk_bytes=8, bucket_bytes=64, part_bytes=50).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(moved) > 4 and not any(re.search(r"\b(bytes|piece|by_file)#", m) for m in moved)
    assert sorted(r.request_id for r in rows) == sorted(r[0] for r in reqs)
    assert {r.request_id: r.status for r in rows}.items() >= {"gone": "missing_dir", "bad": "bad_request"}.items()
    whole = {}
    for r in sorted(parts, key=lambda r: (r.request_id, r.part)):
        assert (r.header is None) == (r.part > 0 or r.status != "ok")
        assert r.bytes is None or len(r.bytes) <= 50
        if r.request_id != reqs[0][0] and r.bytes is not None:
            whole[r.request_id] = whole.get(r.request_id, b"") + bytes(r.bytes)
    assert max(r.part for r in parts) >= 10
    for r in rows:
        if r.status == "ok":
            assert bytes(r.bytes) == logs[r.app][r.start_byte:r.end_byte] and r.part == 0
            assert whole.get(r.request_id, bytes(r.bytes)) == bytes(r.bytes)
    assert len(at.collect()) <= 12  # one row a file with content


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_overlap_equals_all_pairs(spark, bucket):
    """Random windows and files of all sizes, files that overlap included; one log is asked for very often."""
    rnd = random.Random(bucket)
    files = [("a" if rnd.random() < .8 else "b", "p", f"f{i}", i, lo, lo + rnd.choice([1, 3, 17, 300, 5000, 70000]))
             for i, lo in enumerate(rnd.randint(0, 100_000) for _ in range(60))]
    windows = [(str(i), "a" if rnd.random() < .8 else "b", "p", "ok", lo, lo + rnd.choice([0, 1, 5, 40, 900, 30000, 200_000]))
               for i, lo in enumerate(rnd.randint(0, 110_000) for _ in range(150))]
    w = spark.createDataFrame(windows, "request_id string, app string, pod string, status string, start_byte long, end_byte long")
    m = spark.createDataFrame(files, "app string, pod string, path string, file_rank int, file_start long, file_end long")
    got = sorted((r.request_id, r.path, r.local_start, r.local_end) for r in sl.overlap(w, m, bucket).collect())
    want = sorted((q, f, max(s, fs) - fs, min(e, fe) - fs) for q, a, _, _, s, e in windows for fa, _, f, _, fs, fe in files
                  if a == fa and max(s, fs) < min(e, fe))
    assert got == want and len(want) > 500


def test_a_large_window_is_few_blocks(spark):
    df = spark.createDataFrame([(5, 100 << 30), (7, 8), (0, 1 << 22)], "lo long, hi long")
    rows = df.select("lo", "hi", F.size(sl.blocks(F.col("lo"), F.col("hi"), 1 << 22, F.lit(4))).alias("n")).collect()
    assert [r.n for r in rows][0] <= 2 * sl.RADIX * 5 and rows[1].n <= 9


def test_grown_files_give_only_new_chunks(spark, scratch):
    home = f"{scratch}/home"
    body = os.urandom(70_000)
    put(home, "a/a-driver_1", body[:30_000])
    put(home, "a/a-driver_2.gz", gzip.compress(b"first|", mtime=0))
    put(home, "a/a-exec-1_1", b"stays")
    refreshed(spark, home, scratch, 1024)
    for lo, hi in ((30_000, 50_001), (50_001, 70_000)):
        put(home, "a/a-driver_1", body[lo:hi], "ab")
        put(home, "a/a-driver_2.gz", gzip.compress(b"member %d|" % lo, mtime=0), "ab")
        before = fl.read_chunks(spark, f"{scratch}/c").count()
        files, at = refreshed(spark, home, scratch, 1024)
        new = fl.read_chunks(spark, f"{scratch}/c").count() - before
        assert new == -(-(hi - lo) // 1024) + 1
    rows = {r.file_name: r for r in files.collect()}
    assert [s.start for s in rows["a-driver_1"].segments] == [0, 30_000, 50_001] and rows["a-driver_1"].length == 70_000
    want = body + b"first|member 30000|member 50001|"
    rq = spark.createDataFrame([("all", "a", "driver", 0, 10 ** 6), ("mid", "a", "driver", 29_990, 30_000), ("tail", "a", "driver", None, 40)], REQUEST)
    for chunks in (at, fl.read_chunks(spark, f"{scratch}/c")):
        got = {r.request_id: bytes(r.bytes) for r in sl.log_slices(rq, files, chunks, chunk_bytes=1024).collect()}
        assert got == {"all": want, "mid": want[29_990:59_990], "tail": want[-40:]}
    # rotated in place: longer, but another beginning
    put(home, "a/a-driver_1", b"z" + body + b"more")
    files, at = refreshed(spark, home, scratch, 1024)
    row = files.where("file_name = 'a-driver_1'").first()
    assert [s.start for s in row.segments] == [0] and row.length == 70_005
    got = sl.log_slices(rq.where("request_id = 'all'"), files, at, chunk_bytes=1024).first()
    assert bytes(got.bytes) == b"z" + body + b"more" + want[70_000:]


def test_deltas_name_only_touched_buckets(spark, scratch):
    home = f"{scratch}/home"
    for i in range(12):
        put(home, f"app{i}/app{i}-driver_1", b"x" * (i + 1))
    refreshed(spark, home, scratch, compact_after=4)
    put(home, "app3/app3-driver_2", b"new")
    refreshed(spark, home, scratch, compact_after=4)
    assert len([d for d in os.listdir(f"{scratch}/t/delta/seq=2") if d.startswith("app_bucket=")]) == 1
    os.remove(f"{home}/app5/app5-driver_1")                     # a tombstone, in one bucket too
    files, _ = refreshed(spark, home, scratch, compact_after=4)
    assert ft.read_delta(spark, f"{scratch}/t").collect()[0].gone
    assert {r.file_name for r in files.collect()} == {f"app{i}-driver_1" for i in range(12) if i != 5} | {"app3-driver_2"}
    # chunks and locators of the next refresh are written, then the job dies before the delta is complete
    put(home, "app7/app7-driver_2", b"late")
    refreshed(spark, home, scratch, compact_after=99)
    os.remove(f"{scratch}/t/delta/seq=4/_SUCCESS")
    assert fl.read_file_table(spark, f"{scratch}/t").count() == 12
    files, at = refreshed(spark, home, scratch, compact_after=4)  # the rerun rewrites the same folders, and compacts
    assert files.count() == 13 and os.listdir(f"{scratch}/t/base") == ["seq=4"]
    rq = spark.createDataFrame([("r", "app7", "driver", 0, 100)], REQUEST)
    assert bytes(sl.log_slices(rq, files, at, chunk_bytes=8).first().bytes) == b"x" * 8 + b"late"
    assert ft._entries(spark, f"{scratch}/t") == (4, [])


def odd_home(scratch):
    home = f"{scratch}/home"
    put(home, "_job/_job-driver_1", b"starts with _")
    put(home, "a/.a-driver_9", b"hidden")
    put(home, "a/a-driver_1", b"one|")
    put(home, "a/a-driver_2.gz", gzip.compress(b"two", mtime=0))
    put(home, "a/a-driver_3", b"")
    put(home, "plain", b"no folder")
    os.makedirs(f"{home}/hollow")
    return home


def unknown(uri):
    raise st.UnknownScheme(uri)


def test_every_name_on_every_storage(spark, scratch, monkeypatch):
    home = odd_home(scratch)
    listed = sorted((r.app, str(r.file_name), r.stored_length, r._top) for r in st._listing(spark, home).collect())
    dirs = sorted(map(tuple, fl.log_directories(spark, home).collect()))
    monkeypatch.setattr(st, "arrow_location", unknown)          # only Hadoop can list this home
    monkeypatch.setattr(fl, "arrow_location", unknown)
    monkeypatch.setattr(st, "LISTED_AT_ONCE", 2)
    assert sorted((r.app, str(r.file_name), r.stored_length, r._top) for r in st._listing(spark, home).collect()) == listed
    assert sorted(map(tuple, fl.log_directories(spark, home).collect())) == dirs
    assert ("hollow", "None", 0, False) in listed and ("_job", "_job-driver_1", 13, False) in listed and ("a", "a-driver_3", 0, False) in listed
    files = fl.uncompressed_length(fl.scan_log_files(spark, home), fl.build_chunks(spark, home, 4))
    rows = {r.file_name: r for r in files.collect()}
    assert rows["a-driver_2.gz"].length == 3 and not rows["a-driver_1"].read_error and not rows["a-driver_3"].read_error
    assert rows["_job-driver_1"].read_error and rows[".a-driver_9"].read_error  # told, not left out


def test_mount_tables_resolve_and_errors_are_not_swallowed(spark, scratch):
    home = odd_home(scratch)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.trial.link./logs", f"file://{home}")
    got = {(r.app, r.file_name) for r in fl.scan_log_files(spark, "viewfs://trial/logs").collect()}
    assert got == {(r.app, r.file_name) for r in fl.scan_log_files(spark, home).collect()}
    with pytest.raises(st.UnknownScheme):
        st.arrow_location("nosuchscheme://x/y")
    with pytest.raises(Exception):
        fl.scan_log_files(spark, f"{home}/absent").collect()


def test_stream_equals_batch_for_every_name(spark, scratch):
    home = odd_home(scratch)
    out, ck = f"{scratch}/out", f"{scratch}/ck"

    def table(df):
        return sorted((r.app, r.file_name, r.length, r.read_error) for r in df.collect())

    rolled.stream_rolled_files(spark, home, out, ck, chunk_bytes=4, ranges=3)
    assert table(rolled.ingested_files(spark, out)) == table(refreshed(spark, home, scratch, 4)[0])
    put(home, "a/a-driver_1", b"grown", "ab")
    put(home, "zz/zz-driver_1", b"x")
    os.remove(f"{home}/a/a-driver_3")
    rolled.stream_rolled_files(spark, home, out, ck, chunk_bytes=4, ranges=3)
    files = rolled.ingested_files(spark, out)
    assert table(files) == table(refreshed(spark, home, scratch, 4)[0])
    offsets = rolled.ingested_offsets(spark, out)
    last = offsets.where(F.col("batch_id") == offsets.agg(F.max("batch_id")).first()[0])
    assert sorted((r.file_name, r.file_rank, r.file_start, r.file_end) for r in last.collect()) == [
        ("a-driver_1", 1, 0, 9), ("a-driver_2.gz", 2, 9, 12), ("zz-driver_1", 1, 0, 1)]
    rq = spark.createDataFrame([("r", "a", "driver", 0, 100), ("j", "_job", "driver", 0, 6)], REQUEST)
    got = {r.request_id: bytes(r.bytes) for r in sl.log_slices(rq, files, fl.read_locators(spark, f"{out}/chunks"), chunk_bytes=4).collect()}
    assert got == {"r": b"one|growntwo", "j": b"starts"}


def test_ranges_of_names():
    names = [f"n{i:03}" for i in range(100)]
    for ranges in (1, 3, 64, 1000):
        reader = rolled.ListingReader("", ranges)
        parts = reader.partitions({}, {"cuts": rolled.name_cuts(names, ranges)})
        assert len(parts) <= ranges and all(sum(p.holds(n) for p in parts) == 1 for n in [*names, "", "zzz", "n0505"])
    assert rolled.name_cuts([], 5) == []


@pytest.mark.parametrize("listed_out", [10_000, 0])
def test_compacted_event_logs_are_read_once(spark, scratch, monkeypatch, listed_out):
    monkeypatch.setattr(evl, "LISTED_OUT", listed_out)
    log = "eventlog_v2_app-1"
    start = '{"Event":"SparkListenerApplicationStart","App Name":"n","App ID":"app-1","Timestamp":1,"App Attempt ID":"1"}\n'
    added = '{"Event":"SparkListenerExecutorAdded","Timestamp":%d,"Executor ID":"%d","Executor Info":{"Host":"h","Total Cores":1,"Log Urls":{}}}\n'
    put(scratch, f"ev/{log}/events_1_app-1", (start + added % (2, 1) + added % (2, 7)).encode())
    put(scratch, f"ev/{log}/events_1_app-1.compact", (start + added % (2, 1) + added % (2, 7)).encode())  # an older one
    put(scratch, f"ev/{log}/events_2_app-1", (added % (3, 2)).encode())
    put(scratch, f"ev/{log}/events_2_app-1.compact", (start + added % (2, 1) + added % (3, 2)).encode())  # 7 is gone
    put(scratch, f"ev/{log}/events_3_app-1", (added % (4, 3)).encode())
    put(scratch, "ev/app-2", start.replace("app-1", "app-2").encode())
    apps, execs = evl.event_logs_to_tables(evl.read_event_lines(spark, f"{scratch}/ev"))
    assert sorted(r.id for r in execs.collect()) == ["1", "2", "3"]
    assert sorted(r.id for r in apps.collect()) == ["app-1", "app-2"]
