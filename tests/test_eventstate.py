import gzip
import json
import os
import random

from rollscope.sources import eventlog as evl
from rollscope.sources import eventstate as es


def start(app, ms, attempt="1"):
    return json.dumps({"Event": evl.EV_APP_START, "App Name": f"name of {app}", "App ID": app, "Timestamp": ms, "App Attempt ID": attempt})


def end(ms):
    return json.dumps({"Event": evl.EV_APP_END, "Timestamp": ms})


def added(ex, ms):
    return json.dumps({"Event": evl.EV_EXEC_ADDED, "Timestamp": ms, "Executor ID": ex,
                       "Executor Info": {"Host": f"h{ex}", "Total Cores": 2, "Log Urls": {"stdout": f"u/ä{ex}"}}})


def removed(ex, ms):
    return json.dumps({"Event": evl.EV_EXEC_REMOVED, "Timestamp": ms, "Executor ID": ex, "Removed Reason": "done"})


NOISE = json.dumps({"Event": "SparkListenerTaskEnd", "Task Info": {"x": "y" * 40}})


def put(path, data, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def lines(*rows):
    return "".join(f"{r}\n" for r in rows).encode()


def rows_of(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


def same_as_full(spark, root, state):
    got, want = es.read_event_state(spark, state), evl.event_logs_to_tables(evl.read_event_lines(spark, root))
    for g, w in zip(got, want):
        assert g.columns == w.columns
        assert rows_of(g) == rows_of(w)
    return got


def test_owned_lines_cover_every_line_once():
    rng = random.Random(5)
    for _ in range(300):
        data = "".join(rng.choice("ab\n") for _ in range(rng.randrange(0, 40))).encode()
        size, first = len(data), 0
        step, block = rng.randrange(1, 12), rng.randrange(1, 9)
        whole, tails, behind = [], [], first
        for lo in range(first, max(size, 1), step):
            skip = lo > first
            at = lo - skip
            blocks = (data[i:i + block] for i in range(at, size, block))
            for part, parsed, tail in es.owned_lines(blocks, at, skip, min(lo + step, size)):
                (tails if tail else whole).append(part)
                behind = max(behind, parsed)
        cut = data.rfind(b"\n") + 1
        assert b"".join(whole) == data[:cut] and b"".join(tails) == data[cut:]
        assert behind == cut


def test_wanted_lines():
    block = lines(NOISE, start("a", 1), NOISE, end(2)) + added("1", 3).encode()
    assert list(es.wanted_lines(block)) == [x.encode() for x in (start("a", 1), end(2), added("1", 3))]
    assert list(es.wanted_lines(b"")) == []
    assert list(es.wanted_lines(start("b", 1).encode() + b"\r\n")) == [start("b", 1).encode()]


def test_any_split_of_arrivals_equals_a_full_parse(spark, scratch):
    rng = random.Random(2)
    root, state = os.path.join(scratch, "ev"), os.path.join(scratch, "state")
    logs = {
        "eventlog_v2_app-1/events_1_app-1": lines(start("app-1", 5), NOISE, added("1", 6), added("2", 7), NOISE),
        "eventlog_v2_app-1/events_2_app-1": lines(removed("1", 9), NOISE, added("3", 10)) + end(20).encode(),
        "app-2.inprogress": lines(NOISE, start("app-2", 8, "2"), NOISE, NOISE, added("driver", 9), removed("driver", 11), end(12)),
    }
    written = dict.fromkeys(logs, 0)
    while any(written[k] < len(v) for k, v in logs.items()):
        for name, data in logs.items():
            if rng.random() < 0.7:
                n = rng.randrange(0, len(data))  # cuts lines anywhere, multi-byte characters too
                put(f"{root}/{name}", data[written[name]:written[name] + n], "ab")
                written[name] = min(written[name] + n, len(data))
        os.makedirs(root, exist_ok=True)
        es.refresh_event_state(spark, root, state, part_bytes=97, compact_after=2)
        if os.listdir(root):
            same_as_full(spark, root, state)
    generations = {r.path.rsplit("/", 1)[1]: r.gen for r in es.read_files(spark, state).collect()}
    first = {r.path.rsplit("/", 1)[1]: r.at for r in es.read_files(spark, state).collect()}
    assert all(generations[k] <= first[k] for k in generations)
    assert es.refresh_event_state(spark, root, state) is False


def test_growth_reads_on_and_a_rewrite_reads_anew(spark, scratch):
    root, state = os.path.join(scratch, "ev"), os.path.join(scratch, "state")
    put(f"{root}/app-1", lines(start("app-1", 5), added("1", 6)))
    assert es.refresh_event_state(spark, root, state)
    put(f"{root}/app-1", lines(added("2", 7)), "ab")
    es.refresh_event_state(spark, root, state)
    (row,) = es.read_files(spark, state).collect()
    assert (row.gen, row.at, row.parsed) == (1, 2, os.path.getsize(f"{root}/app-1"))
    # only the new line came to the second refresh
    assert [r.id for r in spark.read.parquet(f"{state}/added/seq=2").collect()] == ["2"]
    put(f"{root}/app-1", lines(start("app-9", 1), added("7", 2), added("8", 3), added("9", 4)))
    es.refresh_event_state(spark, root, state)
    apps, execs = same_as_full(spark, root, state)
    assert [r.id for r in apps.collect()] == ["app-9"] and execs.count() == 3
    assert es.read_files(spark, state).first().gen == 3


def test_compacted_vanished_and_packed_files(spark, scratch):
    root, state = os.path.join(scratch, "ev"), os.path.join(scratch, "state")
    rolled = f"{root}/eventlog_v2_app-1"
    put(f"{rolled}/events_1_app-1", lines(start("app-1", 5), added("1", 6)))
    put(f"{rolled}/events_2_app-1", lines(added("2", 7)))
    put(f"{rolled}/_hidden", lines(added("77", 7)))
    put(f"{root}/app-3.gz", gzip.compress(lines(start("app-3", 1), added("1", 2))))
    es.refresh_event_state(spark, root, state)
    _, execs = same_as_full(spark, root, state)
    assert execs.count() == 3
    put(f"{rolled}/events_2_app-1.compact", lines(start("app-1", 5), added("2", 7)))  # the old files still stand
    put(f"{root}/app-3.gz", gzip.compress(lines(end(9))), "ab")                       # a second member
    es.refresh_event_state(spark, root, state)
    apps, execs = same_as_full(spark, root, state)
    assert sorted((r.app_id, r.id) for r in execs.collect()) == [("app-1", "2"), ("app-3", "1")]
    assert {r.id: r.attempts[0].completed for r in apps.collect()} == {"app-1": False, "app-3": True}
    os.remove(f"{root}/app-3.gz")
    es.compact(spark, state)
    es.refresh_event_state(spark, root, state)
    apps, _ = same_as_full(spark, root, state)
    assert [r.id for r in apps.collect()] == ["app-1"]


def test_broken_and_empty(spark, scratch):
    root, state = os.path.join(scratch, "ev"), os.path.join(scratch, "state")
    os.makedirs(root)
    assert es.refresh_event_state(spark, root, state) is False
    apps, execs = es.read_event_state(spark, state)
    assert apps.count() == execs.count() == 0
    put(f"{root}/empty", b"")
    whole = gzip.compress(lines(start("app-1", 1), *[NOISE] * 50))
    put(f"{root}/cut.gz", whole[:-12])
    put(f"{root}/app-2", lines(start("app-2", 2)))
    assert es.refresh_event_state(spark, root, state)
    errors = {r.path.rsplit("/", 1)[1]: r.read_error for r in es.read_files(spark, state).collect()}
    assert errors == {"empty": False, "cut.gz": True, "app-2": False}
    assert "app-2" in [r.id for r in es.read_event_state(spark, state)[0].collect()]


def test_a_refresh_that_died_is_written_over(spark, scratch):
    root, state = os.path.join(scratch, "ev"), os.path.join(scratch, "state")
    put(f"{root}/app-1", lines(start("app-1", 5), added("1", 6)))
    es.refresh_event_state(spark, root, state)
    put(f"{root}/app-1", lines(added("2", 7)), "ab")
    es.refresh_event_state(spark, root, state)
    os.remove(f"{state}/files/seq=2/_SUCCESS")  # as if it had stopped before the end
    assert es.read_event_state(spark, state)[1].count() == 1
    assert es.refresh_event_state(spark, root, state)
    _, execs = same_as_full(spark, root, state)
    assert execs.count() == 2
