"""Frame logs and bundles against plain reading and writing."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linkspan.functions import wire
from linkspan.sources import bundle, frame_log
from linkspan.sources import frames as sources
from linkspan.sources.frames import split_frames


def frame(rng):
    """A length and a body: zeros, noise, or frames within the frame, whole ones at its end among them."""
    n, kind = rng.choice([1, 5, 24, 100, 900, 1558]), rng.random()
    if kind < 0.2:
        body = bytes(n)
    elif kind < 0.5:
        body = rng.randbytes(n)
    else:
        body = b"".join(m.to_bytes(4, "big") + bytes(rng.randrange(3) for _ in range(m)) for m in (rng.randrange(1, 200) for _ in range(n // 50 + 1)))
        body = body[-n:] if kind < 0.75 else body[:n]
    return len(body).to_bytes(4, "big") + body


def rows_of(data):
    """What one reader of the whole log finds: offsets, bodies and errors."""
    at, out = 0, []
    for _, body, error in split_frames(data):
        out.append((at, body, error))
        at += 4 + len(body or b"")
    return out


@pytest.mark.parametrize("seed", range(12))
def test_blocks_are_the_whole_log(tmp_path, seed):
    rng = random.Random(seed)
    data = b"".join(frame(rng) for _ in range(rng.randrange(400)))
    data = data[: len(data) - rng.randrange(20)] if seed % 3 == 0 else data
    path = str(tmp_path / "a.frames")
    with open(path, "wb") as file:
        file.write(data)
    for split in (frame_log.LONGEST, 4096, 20_000, 1 << 20):
        found = [r for b in frame_log.blocks(path, 0, len(data), split, True) for r in frame_log.block_frames(b, split)]
        assert sorted(found, key=lambda r: r[0]) == rows_of(data)
    cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(5))})
    found = [r for a, b in zip(cuts, cuts[1:]) for x in frame_log.blocks(path, a, b, 4096, False) for r in frame_log.block_frames(x, 4096)]
    assert found == [r for r in rows_of(data) if r[2] != "cut"]


def test_damage_ends_its_block(spark, tmp_path):
    """A length that cannot be: the rest of its block is lost, later blocks find their own beginning; or the log ends there."""
    rng = random.Random(3)
    good = [frame(rng) for _ in range(400)]
    data = b"".join(good[:100]) + b"\xff\xff\xff\xff" + b"".join(good[100:])
    (tmp_path / "x.frames").write_bytes(data)
    split = 1 << 14
    found = frame_log.read_log(spark, str(tmp_path), split)
    rows = sorted((r.offset, bytes(r.body) if r.body is not None else None, r.error) for r in found.collect())
    at = len(b"".join(good[:100]))
    errors = [(o, e) for o, _, e in rows if e]
    assert (at, "bad_length") in errors
    bodies = [g[4:] for g in good]
    assert [b for o, b, e in rows if o < at] == bodies[:100]
    later = [b for o, b, e in rows if o > at and not e]
    assert later and later == bodies[-len(later) :]
    strict = sorted((r.offset, r.error) for r in frame_log.whole_logs(found).collect())
    assert strict == [(o, e) for o, _, e in rows if o <= at]


def test_tasks_and_stream_agree_with_one_reader(spark, tmp_path):
    rng = random.Random(8)
    logs = {name: b"".join(frame(rng) for _ in range(n)) for name, n in (("a.frames", 300), ("b/c.frames", 200), ("_hidden", 5), (".tmp", 5), ("empty", 0))}
    (tmp_path / "in" / "b").mkdir(parents=True)
    half = {name: data[: len(data) // 2 + 3] for name, data in logs.items()}
    want = [(b, e) for name, data in logs.items() if name[0] not in "_." for _, b, e in rows_of(data)]
    plain = lambda df: sorted((bytes(r.body), r.error) for r in df.collect())

    def put(of):
        for name, data in of.items():
            (tmp_path / "in" / name).write_bytes(data)

    put(logs)
    folder = str(tmp_path / "in")
    for path in (folder, f"file://{folder}/"):
        found = frame_log.read_log(spark, path, 1 << 14)
        assert found.rdd.getNumPartitions() > 8 and plain(found) == sorted(want)
    one = frame_log.read_log(spark, f"{folder}/a.frames", 1 << 14)
    assert sorted((r.offset, bytes(r.body), r.error) for r in one.collect()) == rows_of(logs["a.frames"])

    put(half)  # the stream sees the first halves, and then the rest

    def step():
        stream = frame_log.stream_log(spark, folder, 1 << 14)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
        q.awaitTermination()

    step()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    put(logs)
    step()
    assert 0 < first < len(want) and plain(spark.read.parquet(str(tmp_path / "out"))) == sorted(want)


def test_write_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(1000).select(wire.big_endian(F.col("id"), 4).alias("body"), F.lit("x").alias("path"))
    frame_log.write_log(rows.repartition(3), path)
    frame_log.write_log(rows.limit(0), path)
    read = lambda: sorted(int.from_bytes(r.body, "big") for r in frame_log.read_log(spark, path).collect())
    assert read() == list(range(1000))
    frame_log.write_log(rows.limit(1), path)
    assert read() == [0, *range(1000)]
    frame_log.write_log(rows.where("id = 7"), path, "overwrite")
    assert read() == [7]
    for bad in (F.lit(None).cast("binary"), F.lit(b""), F.lit(bytes(1559))):
        with pytest.raises(PySparkException, match="a frame has 1 to 1558 bytes"):
            frame_log.write_log(spark.range(1).select(bad.alias("body")), path)
    assert read() == [7]
    empty = str(tmp_path / "none")
    (tmp_path / "none").mkdir()
    assert frame_log.read_log(spark, empty).count() == 0


def test_bundle_is_the_plain_concatenation(spark, tmp_path):
    rng = random.Random(2)
    files = [(f"logs/{rng.randrange(50):03d}.log", "".join(rng.choice(["line\n", "ü", "x" * 50, ""]) for _ in range(rng.randrange(40)))) for _ in range(300)]
    files += [("é.log", None), (None, "no path"), ("big.log", "y" * 3_000_000), files[0], files[0]]
    order = lambda f: (f[0] or "").encode()
    for parts in (7, None):
        out = f"file://{tmp_path}/bundle-{parts}"
        table = spark.createDataFrame([(*f, 1, "s") for f in files], "path string, text string, part int, start string").repartition(4)
        bundle.write_bundle(table, out, parts)
        whole = b"".join(bundle.text_of(spark, out))
        pieces = sorted(f"===== {p or ''} =====\n{t or ''}\n".encode() for p, t in files)
        index = sorted(bundle.index(spark, out).collect(), key=lambda r: r.start)
        assert sorted(whole[r.start : r.start + r.length] for r in index) == pieces and sum(map(len, pieces)) == len(whole)
        assert [r.path.encode() for r in index] == sorted(map(order, files))
        held = bundle.manifest(spark, out).orderBy("part").collect()
        assert len(held) == 7 or parts is None
        assert [hashlib.sha256(whole[m.start : m.start + m.length]).hexdigest() for m in held] == [m.sha256 for m in held]
        got = bundle.read_pieces(bundle.index(spark, out), out).collect()
        assert all(bytes(r.content) == whole[r.start : r.start + r.length] for r in got) and len(got) == len(files)


def test_empty_bundle(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    bundle.write_bundle(spark.createDataFrame([], "path string, text string"), out)
    assert bundle.manifest(spark, out).count() == 0 and bundle.index(spark, out).count() == 0 and not list(bundle.text_of(spark, out))


def test_read_frames_are_numbered(spark, tmp_path):
    """Numbers follow each log's order over many blocks; a refused header is a row, a bad length ends its log."""
    good = [spark.range(1).select(wire.encode_frame(F.lit(1 + n % 9), F.lit(0), F.lit(n), F.lit(b"p" * (n % 40)), F.lit(n)).alias("x")).first().x for n in range(3)]
    body = lambda n: bytes(good[n % 3])
    pieces = [body(n) if n % 10 else b"x" * 30 for n in range(800)]
    data = b"".join(len(p).to_bytes(4, "big") + p for p in pieces)
    for name, tail in (("a", b""), ("b", b"\0\0\0\0" + data)):
        (tmp_path / name).write_bytes(data + tail)
    got = sources.read_frames(spark, str(tmp_path), 4096).collect()
    for name, extra in (("a", 0), ("b", 1)):
        rows = sorted((r.frame_no, r.offset, r.error) for r in got if r.path.endswith(name))
        assert [r[0] for r in rows] == list(range(800 + extra)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
        assert [r[2] for r in rows[:800]] == [None if n % 10 else "BadControl" for n in range(800)]
        assert [r[2] for r in rows[800:]] == ["bad_length"] * extra
    assert sources.read_frames(spark, str(tmp_path / "a"), 4096, numbered=False).columns == ["path", "offset", "error", "frame"]
