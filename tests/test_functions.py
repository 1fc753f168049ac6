from pyspark.sql import functions as F

from rollscope.functions import columns as fc


def test_java_split():
    assert fc.java_split("") == [""]
    assert fc.java_split(",") == []
    assert fc.java_split("a,") == ["a"]
    assert fc.java_split(",a") == ["", "a"]
    assert fc.java_split("a,,b,,") == ["a", "", "b"]
    assert fc.java_split(" a , b") == [" a ", " b"]


def window_py(offset, n, total):
    off = total - n if offset is None else offset
    start = 0 if off < 0 else (total if off > total else off)
    return start, min(start + n, total)


def test_resolve_window(spark):
    cases = [(None, 512, 1000), (0, 100, 50), (-5, 64, 10), (10**9, 64, 10), (50, 0, 100),
             (None, -1, 100), (None, 0, 0), (300, 102400, 200), (None, 2000, 1000), (7, 3, 7)]
    df = spark.createDataFrame(cases, "o long, n int, t long")
    s, e = fc.resolve_window("o", "n", "t")
    got = {(r.o, r.n, r.t): (r.s, r.e) for r in df.select("o", "n", "t", s.alias("s"), e.alias("e")).collect()}
    for c in cases:
        assert got[c] == window_py(*c), c


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("a-driver_1.gz", "driver", None), ("x.gz.gz", "7", "app")],
                               "f string, e string, n string")
    rows = df.select(fc.strip_gz("f").alias("s"), fc.pod_id("e").alias("p"),
                     fc.log_url(F.col("n"), fc.pod_id("e"), "/base").alias("u"),
                     fc.log_dir("home", F.col("n")).alias("d")).collect()
    assert rows[0].s == "a-driver_1" and rows[1].s == "x.gz"
    assert rows[0].p == "driver" and rows[1].p == "exec-7"
    assert rows[0].u == "/base/logPage/?appId=null&podId=driver&logType=stderr"
    assert rows[1].u == "/base/logPage/?appId=app&podId=exec-7&logType=stderr"
    assert rows[0].d == "home/null/"


def test_header_round_trip(spark):
    df = spark.createDataFrame([(12, 40, 99, "h/app1/", "stderr")], "s long, e long, t long, d string, l string")
    h = df.select(F.concat(fc.slice_header("s", "e", "t", "d", "l"), F.lit("body 7 8\n9")).alias("x"))
    assert h.first().x.startswith("==== Bytes 12-40 of 99 of h/app1/stderr ====\n")
    p = h.select(fc.parse_header("x").alias("p")).first().p
    assert (p.start_byte, p.end_byte, p.total_bytes) == (12, 40, 99)


def test_lossy_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xc3"),), (bytearray("é".encode()),)], "b binary")
    got = [r.t for r in df.select(fc.lossy_utf8("b").alias("t")).collect()]
    assert got[0] == "ok �" and got[1] == "é"


def test_latest_attempt(spark):
    df = spark.createDataFrame(
        [("a", [("3", True), ("2", True)], None), ("b", [], None), ("c", [(None, False)], "9")],
        "id string, attempts array<struct<attemptId:string, completed:boolean>>, req string")
    got = {r.id: r.x for r in df.select("id", fc.latest_attempt("attempts", "req").alias("x")).collect()}
    assert got == {"a": "3", "b": None, "c": "9"}
