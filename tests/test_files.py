"""Hand-made rolled files: plain + gz, multi-member gz, ordering, odd names, statuses."""

import gzip
import os
import time

from pyspark.sql import functions as F

from rollscope.operators import slices as sl
from rollscope.sources import files as fl


def put(home, rel, data, gz=False):
    p = os.path.join(home, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(gzip.compress(data, mtime=0) if gz else data)


def build_home(root):
    home = os.path.join(root, "home")
    put(home, "a/a-exec-1_1.gz", b"first \xc3", gz=True)          # multi-byte cut at the file end
    put(home, "a/a-exec-1_2", b"\xa9 second\r\nno newline")
    put(home, "a/a-exec-10_1", b"other pod")                       # exec-1 must not take exec-10
    put(home, "a/a-driver_2", b"two|")
    put(home, "a/a-driver_10", b"ten|")                            # lexical order: _10 before _2
    put(home, "a/a-driver_1", b"one-plain|")
    put(home, "a/a-driver_1.gz", b"one-gz|", gz=True)              # gz twin: tie broken by full name
    put(home, "a/a-driver_3", b"")                                 # empty: listed, adds nothing
    put(home, "a/_a-driver_4", b"listed, but its name does not start with the application")
    put(home, "a/.a-driver_5", b"the same")
    put(home, "_job/_job-driver_1", b"an application that starts with _")
    os.makedirs(os.path.join(home, "hollow"))                      # a folder without files
    os.makedirs(os.path.join(home, "a", "a-driver_dir"), exist_ok=True)
    put(home, "a/a-driver_dir/inner", b"not a log file")
    two = gzip.compress(b"member-1|", mtime=0) + gzip.compress(b"member-2", mtime=0)
    put(home, "m/m-driver_1.gz", two)                              # two gzip members, written as is
    put(home, "a b/a b-driver_1", b"blank name")
    put(home, "plainapp", b"a file where a directory should be")
    return home


EXPECTED = {
    ("a", "exec-1"): b"first \xc3\xa9 second\r\nno newline",
    ("a", "exec-10"): b"other pod",
    ("a", "driver"): b"one-plain|one-gz|ten|two|",
    ("m", "driver"): b"member-1|member-2",
    ("a b", "driver"): b"blank name",
    ("_job", "driver"): b"an application that starts with _",
}


def test_listing_and_slices(spark, scratch):
    home = build_home(scratch)
    listing = fl.scan_log_files(spark, home)
    names = {(r.app, r.file_name) for r in listing.collect()}
    assert {("a", "a-driver_3"), ("a", "_a-driver_4"), ("a", ".a-driver_5"), ("_job", "_job-driver_1")} <= names
    assert ("a b", "a b-driver_1") in names
    assert all(app != "home" for app, _ in names)
    chunks = fl.build_chunks(spark, home, 4)
    files = fl.uncompressed_length(listing, chunks)
    lengths = {r.file_name: r.length for r in files.collect()}
    assert lengths["m-driver_1.gz"] == len(b"member-1|member-2")
    assert lengths["a-exec-1_1.gz"] == len(b"first \xc3")
    reqs = [(f"{a}|{p}", a, p, None, 10**6) for a, p in EXPECTED]
    reqs += [("missing", "zzz", "driver", None, 10), ("file", "plainapp", "driver", None, 10),
             ("hollow", "hollow", "driver", None, 10), ("tail", "a", "exec-1", None, 5), ("mid", "a", "exec-1", 6, 3)]
    rq = spark.createDataFrame(reqs, "request_id string, app string, pod string, offset long, byte_length int")
    out = sl.log_slices(rq, files, chunks, home=home, dirs=fl.log_directories(spark, home), chunk_bytes=4)
    got = {r.request_id: r for r in out.collect()}
    for (a, p), data in EXPECTED.items():
        r = got[f"{a}|{p}"]
        assert r.status == "ok" and bytes(r.bytes) == data, (a, p, r.bytes)
    assert got["missing"].status == "missing_dir"
    assert got["file"].status == "not_a_directory"
    assert (got["hollow"].status, got["hollow"].total_bytes) == ("ok", 0)
    full = EXPECTED[("a", "exec-1")]
    assert bytes(got["tail"].bytes) == full[-5:]
    assert bytes(got["mid"].bytes) == full[6:9]
    # the slice crosses a file border inside "é": bytes stay binary until assembled, so it survives
    assert got["mid"].text == "é "
    assert got["tail"].text == "ewline"[-5:]


def test_refresh_only_new_files(spark, scratch):
    home = build_home(scratch)
    table, chunk_dir = os.path.join(scratch, "files_t"), os.path.join(scratch, "chunks_t")
    first = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    n_files = first.count()
    n_chunks = spark.read.parquet(chunk_dir).count()
    again = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    assert again.count() == n_files
    assert spark.read.parquet(chunk_dir).count() == n_chunks
    time.sleep(1.1)
    put(home, "a/a-exec-1_3.gz", b"+more", gz=True)
    third = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    assert third.count() == n_files + 1
    lens = {r.file_name: r.length for r in third.collect()}
    assert lens["a-exec-1_3.gz"] == 5
    new_chunks = spark.read.parquet(chunk_dir).where(F.col("path").endswith("a-exec-1_3.gz")).count()
    assert new_chunks == 2 and spark.read.parquet(chunk_dir).count() == n_chunks + 2


def test_refresh_rerun_after_failure_adds_no_duplicates(spark, scratch):
    from rollscope.operators import slices as sl2
    home = build_home(scratch)
    table, chunk_dir = os.path.join(scratch, "files_t"), os.path.join(scratch, "chunks_t")
    fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    n_chunks = spark.read.parquet(chunk_dir).count()
    time.sleep(1.1)
    put(home, "a/a-exec-1_3.gz", b"+more", gz=True)
    # simulate: chunks of the next refresh written, then the job died before the file table
    saved = os.path.join(scratch, "saved_table")
    shutil_copy(table, saved)
    fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    shutil_copy(saved, table)
    files = fl.refresh_file_table(spark, home, table, chunk_dir, 4)   # rerun
    assert spark.read.parquet(chunk_dir).count() == n_chunks + 2
    chunks = fl.read_chunks(spark, chunk_dir)
    rq = spark.createDataFrame([("r", "a", "exec-1", None, 10**6)],
                               "request_id string, app string, pod string, offset long, byte_length int")
    got = sl2.log_slices(rq, files, chunks, chunk_bytes=4).first()
    assert bytes(got.bytes) == EXPECTED[("a", "exec-1")] + b"+more"


def test_states_of_the_file_table(spark, scratch):
    home = os.path.join(scratch, "home")
    table, chunk_dir = os.path.join(scratch, "files_t"), os.path.join(scratch, "chunks_t")
    put(home, "a/a-driver_1", b"one|")
    old = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    put(home, "a/a-driver_1", b"changed|")                          # the first batch is superseded
    new = fl.refresh_file_table(spark, home, table, chunk_dir, 4)
    assert (old.first().length, new.first().length) == (4, 8)      # a reader keeps the state it opened
    os.makedirs(os.path.join(table, "delta", "seq=3"))             # a refresh that was cut short
    assert fl.read_file_table(spark, table).first().length == 8
    fl.drop_superseded(spark, table, chunk_dir)
    assert os.listdir(os.path.join(table, "base")) == ["seq=2"] and len(os.listdir(chunk_dir)) == 1
    assert os.listdir(os.path.join(table, "delta")) == ["seq=3"]
    assert fl.read_chunks(spark, chunk_dir).count() == 2 and fl.read_file_table(spark, table).first().length == 8
    assert fl.read_file_table(spark, os.path.join(scratch, "none")) is None


def shutil_copy(src, dst):
    import shutil
    if os.path.exists(dst):
        shutil.rmtree(dst)
    shutil.copytree(src, dst)


def test_direct_range_reads(spark, scratch):
    home = build_home(scratch)
    files = fl.file_table(spark, home)
    lengths = {r.file_name: r.length for r in files.collect()}
    assert lengths["m-driver_1.gz"] == len(b"member-1|member-2") and lengths["a-driver_2"] == 4
    reqs = [(f"{a}|{p}", a, p, None, 10**6) for a, p in EXPECTED]
    reqs += [("tail", "a", "exec-1", None, 5), ("mid", "a", "exec-1", 6, 3), ("gzmid", "m", "driver", 4, 9)]
    rq = spark.createDataFrame(reqs, "request_id string, app string, pod string, offset long, byte_length int")
    out = sl.log_slices(rq, files, None, home=home, dirs=fl.log_directories(spark, home))
    got = {r.request_id: bytes(r.bytes) for r in out.collect()}
    for (a, p), data in EXPECTED.items():
        assert got[f"{a}|{p}"] == data
    full = EXPECTED[("a", "exec-1")]
    assert got["tail"] == full[-5:] and got["mid"] == full[6:9]
    assert got["gzmid"] == b"member-1|member-2"[4:13]


def test_broken_gzip_concerns_its_log_only(spark, scratch):
    home = os.path.join(scratch, "broken")
    packed = gzip.compress(b"x" * 50 + os.urandom(200), mtime=0)
    put(home, "a/a-driver_1", b"whole|")
    put(home, "a/a-driver_2.gz", packed[:-20])                     # cut within the member
    put(home, "a/a-exec-1_1.gz", b"healthy", gz=True)
    put(home, "b/b-driver_1.gz", b"not gzip at all")
    put(home, "c/c-driver_1.gz", gzip.compress(b"padded", mtime=0) + b"\0" * 512)
    rq = spark.createDataFrame(
        [(f"{a}|{p}", a, p, None, 100) for a, p in (("a", "driver"), ("a", "exec-1"), ("b", "driver"), ("c", "driver"))],
        "request_id string, app string, pod string, offset long, byte_length int")
    files = fl.refresh_file_table(spark, home, os.path.join(scratch, "ft"), os.path.join(scratch, "ct"), 16)
    chunks = fl.read_chunks(spark, os.path.join(scratch, "ct"))
    for out in (sl.log_slices(rq, files, chunks, home=home, chunk_bytes=16),
                sl.log_slices(rq, fl.file_table(spark, home), None, home=home)):
        got = {r.request_id: (r.status, r.total_bytes, r.bytes and bytes(r.bytes)) for r in out.collect()}
        assert got["a|driver"] == got["b|driver"] == ("read_error", 0, None)
        assert got["a|exec-1"] == ("ok", 7, b"healthy")
        assert got["c|driver"] == ("ok", 6, b"padded")


def test_text_per_file_piece(spark, scratch):
    home = build_home(scratch)
    listing = fl.scan_log_files(spark, home)
    chunks = fl.build_chunks(spark, home, 4)
    files = fl.uncompressed_length(listing, chunks)
    rq = spark.createDataFrame([("mid", "a", "exec-1", 4, 6)],
                               "request_id string, app string, pod string, offset long, byte_length int")
    whole = sl.log_slices(rq, files, chunks, chunk_bytes=4).first()
    split = sl.log_slices(rq, files, chunks, chunk_bytes=4, text_mode="per_file").first()
    assert bytes(whole.bytes) == bytes(split.bytes) == b"t \xc3\xa9 s"
    assert whole.text == "t é s"
    assert split.text == "t �� s"  # "é" cut by the file border, each half decoded alone


def test_files_of_a_log_are_chunked_together(spark, scratch):
    home = os.path.join(scratch, "home")
    for app in "abcd":
        for k in range(20):
            put(home, f"{app}/{app}-driver_{k:010d}", b"x" * 50)
    fl.refresh_file_table(spark, home, f"{scratch}/files", f"{scratch}/chunks", 16)
    places = fl.read_locators(spark, f"{scratch}/chunks").groupBy(F.regexp_extract("path", "/([a-d])-driver", 1)).agg(
        F.countDistinct("data_file").alias("n"), F.countDistinct("path").alias("paths")).collect()
    assert [(r.n, r.paths) for r in places] == [(1, 20)] * 4  # a slice opens one data file, not one for each log file


def test_listing_of_a_large_folder_comes_in_blocks(scratch):
    import pandas as pd

    from rollscope.sources import storage as st
    os.makedirs(f"{scratch}/a/folder")
    names = [f"f{k}" for k in range(10_050)]
    for name in names:
        open(f"{scratch}/a/{name}", "w").close()
    os.symlink(f"{scratch}/nowhere", f"{scratch}/a/broken")
    one = pd.DataFrame([("a", True, 0, 1)], columns=["name", "is_dir", "size", "ms"])
    frames = list(st._folder_lister(scratch)([one]))
    assert max(map(len, frames)) <= 10_000
    rows = pd.concat(frames)
    assert sorted(rows["file_name"].dropna()) == sorted(names) and rows["file_name"].isna().sum() == 1
    assert sorted(n for n, is_dir, _, _ in st.entries_of(f"{scratch}/a") if is_dir) == ["broken", "folder"]
    assert [len(f) for f in st._home_lister(f"{scratch}/a")([one])] == [10_000, 52]
