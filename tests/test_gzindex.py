"""Restart index of gzip files: points on proof, reads from points, stored index, slices."""

import gzip
import io
import os
import random
import zlib

import pytest

from rollscope.operators import slices as sl
from rollscope.sources import files as fl
from rollscope.sources import gzindex as gi

HEADER = gzip.compress(b"", mtime=0)[:10]


def text(n, seed=0):
    rng = random.Random(seed)
    words = [f"executor {i} finished task {rng.random()}\n" for i in range(200)]
    out = b""
    while len(out) < n:
        out += "".join(rng.choice(words) for _ in range(50)).encode()
    return out[:n]


def flushed(data, every, mode=zlib.Z_SYNC_FLUSH, level=6):
    """One gzip member whose writer flushes after each ``every`` bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = b"".join(z.compress(data[i:i + every]) + z.flush(mode) for i in range(0, len(data), every)) + z.flush()
    return HEADER + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def points_of(stored, spacing, block=1 << 16):
    rows = list(gi.restart_points(io.BytesIO(stored), spacing, block))
    return rows[:-1], rows[-1][-1]


def check_points(stored, data, points):
    for at, raw_at, raw_end, window, _ in points:
        got = b"".join(gi.unpack_from(io.BytesIO(stored[at:]), window))
        assert got[:raw_end - raw_at] == data[raw_at:raw_end]


@pytest.mark.parametrize("block", [1, 7, 4096, 1 << 16])
@pytest.mark.parametrize("mode", [zlib.Z_SYNC_FLUSH, zlib.Z_FULL_FLUSH])
def test_flush_points(mode, block):
    data = text(60_000 if block < 100 else 300_000)
    stored = flushed(data, 5000, mode)
    assert gzip.decompress(stored) == data
    points, length = points_of(stored, 2000, block)
    assert length == len(data)
    assert len(points) >= 2
    assert all(b[0] - a[0] >= 2000 for a, b in zip(points, points[1:]))
    assert points[-1][2] == len(data)
    assert [a[2] for a in points[:-1]] == [b[1] for b in points[1:]]  # no gaps
    check_points(stored, data, points)


def test_members_padding_and_mixed_streams():
    parts = [text(40_000, 1), b"", text(90_000, 2), text(30_000, 3)]
    stored = (gzip.compress(parts[0], mtime=0) + gzip.compress(b"", mtime=0) + b"\0" * 700 + flushed(parts[2], 3000)
              + gzip.compress(parts[3], mtime=0) + b"\0" * 9)
    data = b"".join(parts)
    for block in (1, 333, 1 << 16):
        points, length = points_of(stored, 1500, block)
        assert length == len(data)
        assert any(p[3] is None for p in points) and any(p[3] is not None for p in points)
        check_points(stored, data, points)


def test_streams_without_points_and_empty_streams():
    data = text(200_000)
    assert points_of(gzip.compress(data, mtime=0), 1000) == ([], len(data))
    assert points_of(b"", 10) == ([], 0)
    assert points_of(gzip.compress(b"", mtime=0), 1) == ([], 0)


def test_the_mark_within_data_is_no_point():
    """Stored blocks hold the mark as text; no stream can be unpacked from there."""
    rng = random.Random(5)
    data = b"".join(rng.randbytes(500) + gi.FLUSH_MARK for _ in range(400))
    stored = flushed(data, 20_000, level=0)
    assert stored.count(gi.FLUSH_MARK) >= 400
    points, length = points_of(stored, 1000)
    assert length == len(data)
    check_points(stored, data, points)
    nested = flushed(flushed(text(50_000), 2000), 9000, level=0)  # a flushed stream as the text of stored blocks
    points, length = points_of(nested, 1500)
    check_points(nested, gzip.decompress(nested), points)


def test_cut_streams_are_refused():
    stored = flushed(text(50_000), 4000)
    for end in (5, 1000, len(stored) - 3):
        with pytest.raises((EOFError, zlib.error)):
            list(gi.restart_points(io.BytesIO(stored[:end]), 1000))


def test_a_tail_unpacks_little():
    data = text(3_000_000)
    stored = flushed(data, 10_000)
    for spacing in (20_000, 80_000):
        points, _ = points_of(stored, spacing)
        at, raw_at, _, window, _ = [p for p in points if p[1] <= len(data) - 100][-1]
        assert len(stored) - at <= 2 * spacing  # what a tail reads follows the spacing, not the file
        assert b"".join(gi.unpack_from(io.BytesIO(stored[at:]), window)) == data[raw_at:]


def build_home(root):
    home = os.path.join(root, "home")
    os.makedirs(os.path.join(home, "a"))
    content = {"a-driver_1.gz": text(120_000, 1), "a-driver_2": text(5_000, 2), "a-driver_3.gz": text(90_000, 3),
               "a-driver_4.gz": b"", "a-driver_5.gz": text(60_000, 5)}
    stored = {"a-driver_1.gz": flushed(content["a-driver_1.gz"], 4000), "a-driver_2": content["a-driver_2"],
              "a-driver_3.gz": gzip.compress(content["a-driver_3.gz"], mtime=0), "a-driver_4.gz": gzip.compress(b"", mtime=0),
              "a-driver_5.gz": b"".join(gzip.compress(content["a-driver_5.gz"][i:i + 7000], mtime=0) for i in range(0, 60_000, 7000))}
    for name, b in stored.items():
        with open(os.path.join(home, "a", name), "wb") as f:
            f.write(b)
    return home, b"".join(content.values())


def ask(spark, home, restarts, whole, n=40):
    rng = random.Random(9)
    reqs = [("tail", "a", "driver", None, 100), ("all", "a", "driver", 0, len(whole)), ("none", "zzz", "driver", None, 5)]
    for i in range(n):
        lo = rng.randrange(len(whole))
        reqs.append((str(i), "a", "driver", lo, rng.randint(1, 30_000)))
    rq = spark.createDataFrame(reqs, "request_id string, app string, pod string, offset long, byte_length int")
    out = sl.log_slices(rq, fl.file_table(spark, home, restarts=restarts), None, home=home, restarts=restarts)
    return reqs, {r.request_id: r for r in out.collect()}


def test_slices_through_the_stored_index(spark, scratch, monkeypatch):
    home, whole = build_home(scratch)
    index = os.path.join(scratch, "index")
    restarts = gi.refresh_restarts(spark, home, index, spacing=1500)
    kinds = {r[0] for r in restarts.where("stored_at IS NOT NULL").select("has_window").distinct().collect()}
    assert kinds == {True, False}
    for spans in (gi.SPAN_BYTES, 5_000):  # one span a file, many spans a file
        monkeypatch.setattr(gi, "SPAN_BYTES", spans)
        reqs, got = ask(spark, home, restarts, whole)
        assert bytes(got["all"].bytes) == whole and bytes(got["tail"].bytes) == whole[-100:]
        assert got["none"].status == "missing_dir"
        for rid, _, _, lo, n in reqs[3:]:
            assert bytes(got[rid].bytes) == whole[lo:lo + n], rid


def test_refresh_reads_only_changes(spark, scratch):
    home, whole = build_home(scratch)
    index = os.path.join(scratch, "index")
    first = gi.refresh_restarts(spark, home, index, spacing=1500)
    n = first.count()
    assert gi.refresh_restarts(spark, home, index, spacing=1500).count() == n
    assert len(os.listdir(index)) == 1
    more = text(20_000, 6)
    with open(os.path.join(home, "a", "a-driver_5.gz"), "ab") as f:  # another member: another generation of the file
        f.write(flushed(more, 4000))
    with open(os.path.join(home, "a", "a-driver_6.gz"), "wb") as f:
        f.write(gzip.compress(b"cut short" * 50, mtime=0)[:-9])
    restarts = gi.refresh_restarts(spark, home, index, spacing=1500)
    assert len(os.listdir(index)) == 2
    table = {r.file_name: r for r in fl.file_table(spark, home, restarts=restarts).collect()}
    plain = {r.file_name: r for r in fl.file_table(spark, home).collect()}
    assert {k: (r.length, r.read_error) for k, r in table.items()} == {k: (r.length, r.read_error) for k, r in plain.items()}
    assert table["a-driver_6.gz"].read_error
    os.remove(os.path.join(home, "a", "a-driver_6.gz"))
    _, got = ask(spark, home, restarts, whole + more, n=0)
    assert bytes(got["all"].bytes) == whole + more and bytes(got["tail"].bytes) == more[-100:]


def test_an_empty_home(spark, scratch):
    home = os.path.join(scratch, "home")
    os.makedirs(home)
    restarts = gi.refresh_restarts(spark, home, os.path.join(scratch, "index"))
    assert restarts.count() == 0
    assert fl.file_table(spark, home, restarts=restarts).count() == 0
