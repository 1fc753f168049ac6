"""Byte-exact slicing against plain Python slicing of the joined files."""

import random

from pyspark.sql import functions as F

from rollscope.operators import manifest as mf
from rollscope.operators import paging as pg
from rollscope.operators import slices as sl


def make_logs(seed=7):
    rnd = random.Random(seed)
    alphabet = ["a", "b", "\n", "\r\n", "é", "€", "𝄞", " "]
    files, logs = [], {}
    for li in range(6):
        app, pod = f"app{li % 3}", ("driver" if li % 2 == 0 else f"exec-{li}")
        parts = []
        for k in rnd.sample(range(1, 30), rnd.randint(0, 5)):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            name = f"{app}-{pod}_{k}" + (".gz" if rnd.random() < 0.5 else "")
            data = text.encode()
            files.append((app, name, f"h/{app}/{name}", data))
            parts.append((name, data))
        # rolled order: name without .gz, then full name
        parts.sort(key=lambda p: (p[0][:-3] if p[0].endswith(".gz") else p[0], p[0]))
        logs[(app, pod)] = b"".join(d for _, d in parts)
    return files, logs


def files_df(spark, files):
    df = spark.createDataFrame(files, "app string, file_name string, path string, content binary")
    return df.withColumn("length", F.octet_length("content").cast("long"))


def expected(logs, app, pod, offset, n):
    data = logs.get((app, pod), b"")
    total = len(data)
    off = total - n if offset is None else offset
    start = 0 if off < 0 else (total if off > total else off)
    end = min(start + n, total)
    if end < start:
        return None
    return start, end, total, data[start:end]


def test_random_requests_match_python(spark):
    files, logs = make_logs()
    rnd = random.Random(11)
    reqs = []
    for i in range(150):
        app, pod = rnd.choice(list(logs))
        offset = rnd.choice([None, -5, 0, rnd.randint(0, 120), 10**9])
        n = rnd.choice([0, 1, 3, rnd.randint(0, 150), -1])
        reqs.append((f"r{i}", app, pod, "stderr", offset, n))
    rq = spark.createDataFrame(reqs, "request_id string, app string, pod string, log_type string, "
                                     "offset long, byte_length int")
    fdf = files_df(spark, files)
    chunks = sl.chunks_from_content(fdf, 7)
    out = sl.log_slices(rq, fdf, chunks, home="h", chunk_bytes=7, bucket_bytes=16)
    got = {r.request_id: r for r in out.collect()}
    assert len(got) == len(reqs)
    for rid, app, pod, _, offset, n in reqs:
        exp, r = expected(logs, app, pod, offset, n), got[rid]
        if exp is None:
            assert r.status == "negative_length" and (r.start_byte, r.end_byte, r.total_bytes) == (0, 0, 0)
            continue
        assert r.status == "ok", (rid, r.status)
        assert (r.start_byte, r.end_byte, r.total_bytes) == exp[:3]
        assert bytes(r.bytes) == exp[3], rid
        assert r.header == f"==== Bytes {exp[0]}-{exp[1]} of {exp[2]} of h/{app}/stderr ====\n"


def test_status_values(spark):
    files, _ = make_logs()
    fdf = files_df(spark, files)
    rq = spark.createDataFrame(
        [("a", "app0", None, None, 10), ("b", "nosuch", "driver", None, 10), ("c", "app0", "exec-99", 0, 10)],
        "request_id string, app string, pod string, offset long, byte_length int")
    out = sl.log_slices(rq, fdf, sl.chunks_from_content(fdf, 5), home="h")
    got = {r.request_id: (r.status, r.total_bytes, r.slice_hex) for r in out.collect()}
    assert got["a"][0] == "bad_request"
    assert got["b"][0] == "missing_dir"
    assert got["c"] == ("ok", 0, "")  # directory exists, no file of that pod


def test_page_plan_covers_log(spark):
    files, logs = make_logs()
    fdf = files_df(spark, files)
    logs_df = spark.createDataFrame(list(logs), "app string, pod string")
    totals = mf.total_length(mf.build_manifest(logs_df, fdf))
    plan = pg.page_plan(totals, 9)
    out = sl.log_slices(pg.page_requests(plan), fdf, sl.chunks_from_content(fdf, 4), chunk_bytes=4,
                        bucket_bytes=8)
    pages = {}
    for r in out.collect():
        pages.setdefault((r.app, r.pod), []).append((r.start_byte, bytes(r.bytes)))
    for key, data in logs.items():
        got = b"".join(b for _, b in sorted(pages.get(key, [])))
        assert got == data, key


def test_load_more_and_new(spark):
    files, logs = make_logs()
    fdf = files_df(spark, files)
    key = max(logs, key=lambda k: len(logs[k]))
    total = len(logs[key])
    cur = spark.createDataFrame([("c", key[0], key[1], total // 2, total // 2 + 3, total // 2, 5)],
                                "client string, app string, pod string, start_byte long, end_byte long, "
                                "total_bytes long, byte_length int")
    prev = sl.log_slices(pg.prev_window(cur), fdf, sl.chunks_from_content(fdf, 4), chunk_bytes=4).first()
    s = total // 2
    assert (prev.start_byte, prev.end_byte) == (max(s - 5, 0), s)
    assert bytes(prev.bytes) == logs[key][max(s - 5, 0):s]
    moved = pg.advance_prev(cur, sl.log_slices(pg.prev_window(cur), fdf, sl.chunks_from_content(fdf, 4),
                                               chunk_bytes=4))
    assert moved.first().start_byte == max(s - 5, 0)
    totals = spark.createDataFrame([(key[0], key[1], total)], "app string, pod string, total_bytes long")
    new = pg.new_bytes(cur, totals)
    r = new.first()
    assert r.poll_status == ("new_bytes" if total > s else "no_new")
    got = sl.log_slices(new.drop("poll_status"), fdf, sl.chunks_from_content(fdf, 4), chunk_bytes=4).first()
    assert bytes(got.bytes) == logs[key][s:]
    shrunk = pg.new_bytes(cur.withColumn("total_bytes", F.lit(total + 10).cast("long")), totals).first()
    assert shrunk.poll_status == "truncated" and shrunk.byte_length == 0


def test_bucketed_overlap_has_no_duplicates(spark):
    files, logs = make_logs(3)
    fdf = files_df(spark, files)
    rq = spark.createDataFrame([("x", a, p, None, 10**6) for a, p in logs],
                               "request_id string, app string, pod string, offset long, byte_length int")
    rq = rq.withColumn("request_id", F.concat_ws(":", "app", "pod"))
    out = sl.log_slices(rq, fdf, sl.chunks_from_content(fdf, 3), chunk_bytes=3, bucket_bytes=2)
    for r in out.collect():
        assert bytes(r.bytes) == logs[(r.app, r.pod)]


def test_split_prefix_sum_equals_window(spark):
    rows = [("a", "driver", f"a-driver_{i:04d}" + (".gz" if i % 3 == 0 else ""), f"p{i}", (i * 7) % 13)
            for i in range(400)]
    rows += [("b", "exec-1", f"b-exec-1_{i}", f"q{i}", i % 5) for i in range(30)]
    files = spark.createDataFrame(rows, "app string, pod string, file_name string, path string, length long")
    simple = mf.with_offsets(mf.with_file_rank(files))
    cols = ["app", "pod", "file_name", "file_rank", "file_start", "file_end"]
    want = sorted(map(tuple, simple.select(*cols).collect()))
    for chars in (0, 2, 3, 40):  # one part a log, a few, one a file
        split = mf.with_rank_offsets(files, part_chars=chars)
        assert split.select(mf.rolled_part(part_chars=chars)).distinct().count() >= 2
        assert sorted(map(tuple, split.select(*cols).collect())) == want


def test_prefix_sum_by_time_with_ties_and_nulls(spark):
    rows = [("a", "driver", f"a-driver_{i}", None if i % 9 == 0 else 3600 * (i % 5) - 7200 + i % 2, i % 4) for i in range(60)]
    files = spark.createDataFrame(rows, "app string, pod string, file_name string, s long, length long") \
        .withColumn("modified", F.timestamp_seconds("s"))
    cols = ["file_name", "file_rank", "file_start", "file_end"]
    one = mf.with_offsets(mf.with_file_rank(files, "modified")).select(*cols)
    two = mf.with_rank_offsets(files, "modified").select(*cols)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_fast_pod_path_equals_general_rule(spark):
    names = ["a-exec-1_1", "a-exec-10_1", "a-driver_2", "a-exec-1_x-driver_3", "a-exec-12-exec-1_4",
             "a-weird_1", "b-exec-1_1", "a-exec-1-exec-2_5", "ab-driver_1"]
    files = spark.createDataFrame([("a" if n.startswith("a-") or n.startswith("ab") else "b", n, n, 1)
                                   for n in names], "app string, file_name string, path string, length long")
    pods = ["driver", "exec-1", "exec-10", "exec-2", "weird", "exec-12-exec-1", "x"]
    logs = spark.createDataFrame([(a, p) for a in ("a", "b") for p in pods], "app string, pod string")
    got = sorted((r.app, r.pod, r.file_name) for r in mf.match_files(logs, files).collect())
    exp = sorted((a, p, n) for a in ("a", "b") for p in pods for (fa, n) in
                 [("a" if n.startswith("a-") or n.startswith("ab") else "b", n) for n in names]
                 if fa == a and n.startswith(a) and f"-{p}_" in n)
    assert got == exp


def test_advance_new_cursor(spark):
    files, logs = make_logs()
    fdf = files_df(spark, files)
    key = max(logs, key=lambda k: len(logs[k]))
    total = len(logs[key])
    cur = spark.createDataFrame([("c", key[0], key[1], 0, 2, 2, 5)],
                                "client string, app string, pod string, start_byte long, end_byte long, "
                                "total_bytes long, byte_length int")
    totals = spark.createDataFrame([(key[0], key[1], total)], "app string, pod string, total_bytes long")
    reply = sl.log_slices(pg.new_bytes(cur, totals).drop("poll_status"), fdf, sl.chunks_from_content(fdf, 4),
                          chunk_bytes=4)
    nxt = pg.advance_new(cur, reply).first()
    assert (nxt.start_byte, nxt.end_byte, nxt.total_bytes) == (0, total, total)


def test_carried_columns_and_equal_requests(spark):
    files, logs = make_logs()
    fdf = files_df(spark, files)
    (app, pod), data = max(logs.items(), key=lambda x: len(x[1]))
    rq = spark.createDataFrame(
        [("r", app, pod, None, 6, "x"), ("r", app, pod, None, 6, "x"), ("r", app, pod, None, 6, None),
         ("none", app, pod, 0, 0, "empty"), ("bad", None, pod, 0, 5, "refused")],
        "request_id string, app string, pod string, offset long, byte_length int, bucket string")
    out = sl.log_slices(rq, fdf, sl.chunks_from_content(fdf, 4), chunk_bytes=4, bucket_bytes=2, carry=["bucket"])
    got = [(r.request_id, r.bucket, None if r.bytes is None else bytes(r.bytes)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(
        [("r", "x", data[-6:]), ("r", "x", data[-6:]), ("r", None, data[-6:]), ("none", "empty", b""),
         ("bad", "refused", None)], key=str)
