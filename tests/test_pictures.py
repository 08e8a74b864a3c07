"""PNG in and out, the committing sink, and the scan that reads ids first."""

import os
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.sources import pictures, png

SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _file(raw, height, width, depth, colour, palette=b"", parts=1, interlaced=0):
    """A PNG file of filtered rows."""
    packed = zlib.compress(raw)
    cut = [len(packed) * k // parts for k in range(parts + 1)]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    body = [chunk(b"IDAT", packed[a:z]) for a, z in zip(cut, cut[1:], strict=False)]
    return b"".join([png.MAGIC, chunk(b"IHDR", head), chunk(b"tEXt", b"a\0b"), *([chunk(b"PLTE", palette)] if palette else []), *body, chunk(b"IEND", b"")])


def _filtered(plain, kinds, unit):
    """Rows of bytes under given filters, a byte at a time."""
    out = bytearray()
    for y, kind in enumerate(kinds):
        out.append(kind)
        for x in range(plain.shape[1]):
            a = int(plain[y, x - unit]) if x >= unit else 0
            b = int(plain[y - 1, x]) if y else 0
            c = int(plain[y - 1, x - unit]) if y and x >= unit else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((int(plain[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return bytes(out)


@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_kind_of_png(colour, depth):
    rng = np.random.default_rng(colour * 20 + depth)
    for height, width in ((1, 1), (7, 13), (12, 5)):
        stride = (width * SAMPLES[colour] * depth + 7) // 8
        plain = rng.integers(0, 256, (height, stride), np.uint8)
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3), np.uint8)
        data = _file(_filtered(plain, rng.integers(0, 5, height).tolist(), max(1, SAMPLES[colour] * depth // 8)), height, width, depth, colour, palette.tobytes() if colour == 3 else b"", parts=3)
        values = np.zeros((height, width, SAMPLES[colour]), int)
        for y in range(height):
            bits = int.from_bytes(plain[y].tobytes())
            for k in range(width * SAMPLES[colour]):
                values[y, k // SAMPLES[colour], k % SAMPLES[colour]] = bits >> (8 * stride - depth * (k + 1)) & ((1 << depth) - 1)
        if colour == 3:
            want = palette[values[..., 0]]
        else:
            scaled = values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)
            want = scaled[..., :3] if colour in (2, 6) else np.repeat(scaled[..., :1], 3, axis=2)
        got = png.decode([data, None, data])
        assert got[1] is None and (got[0] == want).all() and (got[2] == want).all()


def test_written_pictures_use_several_filters():
    rng, used = np.random.default_rng(1), set()
    y, x = np.mgrid[:40, :30]
    for picture in (rng.integers(0, 256, (40, 30, 3)), np.stack([x * 5, y * 4, x + y], axis=2), np.full((40, 30, 3), 77), np.stack([(x * y) % 256, (x * x) % 256, (y * y) % 256], axis=2)):
        data = png.encode(picture.astype(np.uint8))
        used |= set(png.read(data).rows[:, 0].tolist())
        assert (png.decode([data])[0] == picture).all()
    assert len(used) >= 4


def test_damaged_files_say_why():
    good = png.encode(np.zeros((3, 4, 3), np.uint8))
    bad = {b"": "not a PNG file", b"\xff\xd8jpeg": "not a PNG file", good[:-4]: "cut short", good[:50]: "damaged chunk", good[:45] + b"x" + good[46:]: "damaged chunk", _file(b"\0" * 5, 1, 4, 8, 0, interlaced=1): "interlaced", _file(b"\0" * 4, 1, 4, 8, 0): "wrong size", _file(b"\7" + b"\0" * 4, 1, 4, 8, 0): "unknown filter", _file(b"\0\3", 1, 1, 8, 3, b"abc"): "palette"}
    for data, why in bad.items():
        assert isinstance(found := png.decode([data])[0], str) and why.split()[0] in found, (data, found)


def _images(spark, n=40, partitions=4):
    rows = [(f"im/ä {i:02}" if i % 3 else f".{i:02}~_", i % 4 + 1, 5, bytearray(np.random.default_rng(i).integers(0, 256, (i % 4 + 1) * 15, np.uint8).tobytes())) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (None, 1, 1, bytearray(b"abc")), ("none", 1, 1, None)], pictures.SCHEMA).repartition(partitions)


def _names(path):
    return sorted(f"{d}/{f}" for d, _, files in os.walk(path) for f in files)


def test_pictures_come_back(spark, tmp_path):
    rows, df = _images(spark)
    path = str(tmp_path / "deep" / "out")
    pictures.write(df, path)
    got = pictures.read(pictures.files(spark, path)).collect()
    assert sorted((r.image_id, r.height, r.width, bytes(r.pixels), r.error) for r in got) == sorted((*r[:3], bytes(r[3]), None) for r in rows)
    # Only what is asked for is read, and more can be added or everything replaced.
    some = pictures.files(spark, path).filter(F.col("image_id").startswith("."))
    assert {r.image_id for r in pictures.read(some).collect()} == {r[0] for r in rows if r[0][0] == "."}
    pictures.write(df.limit(1).withColumn("image_id", F.lit("more")), f"file://{path}", "append")
    assert pictures.files(spark, path).count() == len(rows) + 1
    pictures.write(df.filter("image_id like '.%'"), path)
    assert pictures.files(spark, path).count() == sum(r[0][0] == "." for r in rows) and not any(pictures.STAGING in x for x in _names(path))
    pictures.write(df.filter("false"), path)
    assert pictures.files(spark, path).count() == 0 and len(_names(path)) == 1
    assert pictures.files(spark, str(tmp_path / "nothing")).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    _, df = _images(spark)
    path = str(tmp_path / "out")
    pictures.write(df, path)
    before = _names(path)
    wrong = df.withColumn("width", F.when(F.col("image_id") == "im/ä 10", 6).otherwise(F.col("width")))  # no such shape
    with pytest.raises(Exception, match="reshape"):
        pictures.write(wrong, path)
    assert _names(path) == before


def test_tasks_that_run_twice_leave_one_copy(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pictures, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    path = str(tmp_path / "out")
    writer = pictures.PictureWriter(path, False)
    batch = pa.RecordBatch.from_pydict({"image_id": ["a"], "height": [1], "width": [1], "pixels": [b"xyz"]})
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert len(_names(path)) == 2 and first.folder != again.folder
    writer.commit([again, None, pictures.Staged(None, 0)])
    assert [x.rsplit("/", 1)[1] for x in _names(path) if x.endswith(".png")] == ["a.png"] and not any(pictures.STAGING in x for x in _names(path))
    other = pictures.PictureWriter(path, True)
    other.write(iter([batch]))
    other.abort([None])
    assert len(_names(path)) == 2


def test_scan_reads_wanted_rows(spark, tmp_path):
    rows, df = _images(spark)
    pictures.coded(df.withColumn("view", F.lit("front"))).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    wanted = spark.createDataFrame([("im/ä 01",), ("im/ä 02",), ("im/ä 02",), ("missing",), (None,)], "image_id string")
    for most in (10, 1):
        got = pictures.decoded(pictures.scan(source, wanted, most=most)).collect()
        assert sorted((r.image_id, r.view, bytes(r.pixels)) for r in got) == [(r[0], "front", bytes(r[3])) for r in rows if r[0] in ("im/ä 01", "im/ä 02")]
    assert pictures.scan(source, wanted.filter("false")).count() == 0
    plan = pictures.scan(source, wanted)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(image_id" in plan


def test_other_formats_have_decoders_of_their_own(spark):
    rows = spark.createDataFrame([(1, bytearray(b"RAW\1\2\3")), (2, bytearray(b"??")), (3, None), (4, bytearray(png.encode(np.full((2, 1, 3), 9, np.uint8))))], "key int, image binary")
    got = {r.key: r for r in pictures.decoded(rows, others={b"RAW": lambda data: np.frombuffer(data[3:], np.uint8).reshape(1, 1, 3)}).collect()}
    assert bytes(got[1].pixels) == b"\1\2\3" and got[2].pixels is None and got[2].error == "not a PNG file"
    assert (got[3].pixels, got[3].error, got[4].height, bytes(got[4].pixels)) == (None, None, 2, b"\t" * 6)
