"""Cursors as streaming state: equal to the batch form after any split of arrivals, restarts included."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rollscope.operators import paging as pg
from rollscope.streaming import cursors as cu
from rollscope.streaming import rolled

pytest.importorskip("google.protobuf")


class Streams:
    """Folders of totals and client events; each ``run`` is a restart from the checkpoint."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0
        for name in ("totals", "clients"):
            os.makedirs(os.path.join(root, name))

    def put(self, totals=(), clients=()):
        self.n += 1
        for name, rows, schema in (("totals", totals, cu.TOTALS), ("clients", clients, cu.CLIENT_EVENTS)):
            if rows:
                self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(os.path.join(self.root, name))

    def run(self, shards=3):
        read = self.spark.readStream
        out = os.path.join(self.root, "requests")
        requests = cu.poll_requests(read.schema(cu.TOTALS).parquet(os.path.join(self.root, "totals")),
                                    read.schema(cu.CLIENT_EVENTS).parquet(os.path.join(self.root, "clients")), shards=shards)
        q = (requests.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", os.path.join(self.root, "checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()
        rows = self.spark.read.schema(cu.REQUESTS).parquet(out).collect()
        return sorted((r.client, r.app, r.pod, r.poll_status, r.offset, r.byte_length) for r in rows)


def opened(seq, client, total, app="a", pod="driver", start=None):
    return (seq, cu.OPEN, client, app, pod, total if start is None else start, total, total, 0)


def joined(rows):
    """Ranges of new bytes by client and log, end to end."""
    out = {}
    for client, app, pod, status, lo, n in rows:
        if status == pg.STATUS_NEW:
            out.setdefault((client, app, pod), []).append((lo, lo + n))
    for key, ranges in out.items():
        ranges.sort()
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])), (key, ranges)
    return {k: (r[0][0], r[-1][1]) for k, r in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_batch_form_after_any_split(spark, scratch, seed):
    rng = random.Random(seed)
    s = Streams(spark, scratch)
    logs = [("a", "driver"), ("a", "exec-1"), ("b", "driver")]
    clients = [(f"c{i}", *logs[i % 3], rng.choice([0, 10, 50])) for i in range(9)]
    growth = [(app, pod, total, 3 * k + i) for i, (app, pod) in enumerate(logs) for k, total in enumerate([50, 80, 80, 200])]
    arrivals = ([("clients", opened(i, c, t, app, pod)) for i, (c, app, pod, t) in enumerate(clients)]
                + [("totals", g) for g in growth] + [("totals", growth[0])])
    rng.shuffle(arrivals)  # late and repeated totals, clients before and after them
    cuts = sorted(rng.sample(range(1, len(arrivals)), 2))
    for part in (arrivals[:cuts[0]], arrivals[cuts[0]:cuts[1]], arrivals[cuts[1]:]):
        s.put([r for k, r in part if k == "totals"], [r for k, r in part if k == "clients"])
        got = s.run()
    cursors = spark.createDataFrame([(c, app, pod, t, t, t, 10) for c, app, pod, t in clients],
                                    "client string, app string, pod string, start_byte long, end_byte long, total_bytes long, byte_length long")
    totals = spark.createDataFrame([(app, pod, 200) for app, pod in logs], "app string, pod string, total_bytes long")
    batch = pg.new_bytes(cursors, totals).where(F.col("poll_status") == pg.STATUS_NEW).collect()
    assert joined(got) == {(r.client, r.app, r.pod): (r.offset, r.offset + r.byte_length) for r in batch}
    assert s.run() == got  # nothing arrived: nothing is sent twice


def test_growth_pages_truncation_and_odd_rows(spark, scratch):
    s = Streams(spark, scratch)
    s.put([("a", "driver", 100, 1), ("a", "driver", None, 9), (None, "driver", 5, 9)],
          [opened(1, "c", 100, start=60), opened(1, "d", 40), opened(1, "gone", 100), opened(2, None, 0), (None, cu.OPEN, "e", "a", "driver", 0, 0, 0, 0),
           (3, "odd", "c", "a", "driver", 0, 0, 0, 0), opened(1, "f", None, app="none")])
    assert s.run() == [("d", "a", "driver", pg.STATUS_NEW, 40, 60)]
    more = (4, cu.MORE, "c", "a", "driver", None, None, None, 50)
    s.put([("a", "driver", 130, 2)], [more, more, (5, cu.MORE, "c", "a", "driver", None, None, None, 50),
                                      (6, cu.MORE, "c", "a", "driver", None, None, None, 50), (2, cu.CLOSE, "gone", "a", "driver", 0, 0, 0, 0)])
    got = s.run()
    assert [r for r in got if r[0] == "c"] == [("c", "a", "driver", cu.STATUS_MORE, 0, 10), ("c", "a", "driver", cu.STATUS_MORE, 10, 50),
                                               ("c", "a", "driver", pg.STATUS_NEW, 100, 30)]
    assert [r for r in got if r[0] == "d"] == [("d", "a", "driver", pg.STATUS_NEW, 40, 60), ("d", "a", "driver", pg.STATUS_NEW, 100, 30)]
    assert not [r for r in got if r[0] == "gone"]
    s.put([("a", "driver", 20, 3), ("a", "driver", 500, 1)])  # rotated away; an old total comes late
    got = s.run()
    assert [r for r in got if r[3] == pg.STATUS_TRUNCATED] == [(c, "a", "driver", pg.STATUS_TRUNCATED, 130, 0) for c in "cd"]
    s.put([("a", "driver", 140, 4)])
    assert joined(s.run())[("c", "a", "driver")] == (100, 140)


def test_answers_from_the_ingested_tables(spark, scratch):
    home, out = os.path.join(scratch, "home"), os.path.join(scratch, "out")
    os.makedirs(os.path.join(home, "a"))
    s = Streams(spark, scratch)

    def log(data):
        with open(os.path.join(home, "a", "a-driver_1"), "ab") as f:
            f.write(data)
        rolled.stream_rolled_files(spark, home, out, os.path.join(scratch, "ingest"), 16)

    def answer():
        clients = spark.readStream.schema(cu.CLIENT_EVENTS).parquet(os.path.join(scratch, "clients"))
        cu.answer_polls(spark, clients, out, os.path.join(scratch, "answers"), os.path.join(scratch, "polls"), 16, home)
        rows = spark.read.parquet(os.path.join(scratch, "answers")).collect()
        return sorted((r.batch_id, r.client, r.poll_status, bytes(r.bytes)) for r in rows)

    log(b"first line\n")
    s.put(clients=[opened(1, "c", 6, start=3), opened(1, "d", 11)])
    assert [r[1:] for r in answer()] == [("c", pg.STATUS_NEW, b"line\n")]
    log(b"and the second, longer line\n")
    s.put(clients=[(2, cu.MORE, "c", "a", "driver", None, None, None, 2)])
    got = answer()
    assert [r[1:] for r in got][1:] == [("c", cu.STATUS_MORE, b"ir"), ("c", pg.STATUS_NEW, b"and the second, longer line\n"),
                                        ("d", pg.STATUS_NEW, b"and the second, longer line\n")]
    assert answer() == got
    assert rolled.write_totals(spark, f"{out}/files", out) is None


def test_totals_reach_only_shards_with_clients(spark, scratch):
    """Shards that nobody opened a log in cost no state; a shard opened later gets the log's newest total."""
    s = Streams(spark, scratch)
    states = []

    def run():
        totals = spark.readStream.schema(cu.TOTALS).parquet(os.path.join(scratch, "totals"))
        clients = spark.readStream.schema(cu.CLIENT_EVENTS).parquet(os.path.join(scratch, "clients"))
        q = (cu.poll_requests(totals, clients, shards=8).writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(scratch, "requests")).option("checkpointLocation", os.path.join(scratch, "checkpoint"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        states.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators))

    s.put([(f"app{i}", "driver", 100, 1) for i in range(40)], [opened(1, "x", 60, app="app0"), opened(1, "z", 5, app="none")])
    run()
    assert states[0] <= 40 + 2 + 2 + 2  # logs, the log without a total, log and cursor of the shards that were opened
    s.put([("app0", "driver", 130, 2)], [(2, cu.MORE, "x", "app0", "driver", 0, 0, 0, 10)])
    run()
    s.put((), [opened(k, f"y{k}", 100, app="app0") for k in range(1, 20)])  # shards opened after the totals came
    run()
    rows = spark.read.schema(cu.REQUESTS).parquet(os.path.join(scratch, "requests")).collect()
    got = sorted((r.client, r.poll_status, r.offset, r.byte_length) for r in rows)
    assert got == sorted([("x", pg.STATUS_NEW, 60, 40), ("x", pg.STATUS_NEW, 100, 30), ("x", cu.STATUS_MORE, 50, 10)]
                         + [(f"y{k}", pg.STATUS_NEW, 100, 30) for k in range(1, 20)])
