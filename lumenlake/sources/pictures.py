"""Pictures in and out: a sink with two-phase commit, a scan that reads ids first, and coded images to pixels.

Pixels travel as bytes, row by row, RGB, with height and width.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from . import png

FORMAT = "lumen_pictures"
SCHEMA = "image_id string, height int, width int, pixels binary"
COMMITTED, STAGING = "_committed-", "_staging-"
#: Targets up to which their ids are handed to the scan itself; more of them are joined.
IN_LIST = 10_000
#: Bytes of coded pictures that a task decodes together.
BATCH_BYTES = 16 << 20

Decoder = Callable[[bytes], np.ndarray]


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, with or without a scheme, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    if "://" not in path:
        return pafs.LocalFileSystem(), path.rstrip("/")
    fs, root = pafs.FileSystem.from_uri(path)
    return fs, root.rstrip("/")


def _file_name(image_id: str) -> str:
    """Any id as a file's name: bytes beyond letters, digits, . _ and - are written as ~ and two hex digits; so is a dot in front."""
    safe = lambda b: chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "._-") else f"~{b:02x}"
    return re.sub(r"^\.", "~2e", re.sub(r"^_", "~5f", "".join(map(safe, image_id.encode()))))


# Sink


@dataclass
class Staged(WriterCommitMessage):
    folder: str | None
    pictures: int


class PictureWriter(DataSourceArrowWriter):
    """A task writes its pictures to a folder of its own under the job's staging folder. Commit moves the folders of the
    tasks that count, then names them in one small file, which is what makes them part of the table; whatever else was
    staged, by tasks that failed or ran twice, goes. Abort removes all that was staged."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/{STAGING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = _place(self.path)
        folder, n = f"{self._staging(root)}/part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}", 0
        for b in iterator:
            for name, h, w, pixels in zip(*(b[c].to_pylist() for c in ("image_id", "height", "width", "pixels")), strict=True):
                if name is None or pixels is None:
                    continue
                if not n:
                    fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/{_file_name(name)}.png") as out:
                    out.write(png.encode(np.frombuffer(pixels, np.uint8).reshape(h, w, 3)))
                n += 1
        return Staged(folder if n else None, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        before = _commits(fs, root)
        parts = []
        for k, m in enumerate(m for m in messages if m is not None and m.folder):
            parts.append(f"part-{self.job}-{k:05}")
            fs.move(m.folder, f"{root}/{parts[-1]}")
        with fs.open_output_stream(f"{root}/{COMMITTED}{self.job}") as out:
            out.write(json.dumps(parts).encode())
        if self.overwrite:
            for name, old in before.items():
                fs.delete_file(f"{root}/{name}")
                for part in old:
                    fs.delete_dir(f"{root}/{part}")
        self._clear(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(self._staging(root)).type != pafs.FileType.NotFound:
            fs.delete_dir(self._staging(root))


class Pictures(DataSource):
    """The sink: .format("lumen_pictures").mode("append" or "overwrite").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options["path"], overwrite)


def _commits(fs: pafs.FileSystem, root: str) -> dict[str, list[str]]:
    found = {}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(COMMITTED):
            with fs.open_input_stream(f.path) as m:
                found[f.base_name] = json.loads(m.read())
    return found


def write(images: DataFrame, path: str, mode: str = "overwrite") -> None:
    """images (image_id, height, width, pixels) as PNG files, all or none of them.

    Rows without id or pixels have no file. Equal ids in one task leave one file, in different tasks one each.
    """
    spark = images.sparkSession
    spark.dataSource.register(Pictures)
    images.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")))).write.format(FORMAT).option("path", path).mode(mode).save()


# Scan


def files(spark: SparkSession, path: str) -> DataFrame:
    """image_id, file and length of the pictures that are committed at path: names only, no picture is read."""
    fs, root = _place(path)
    parts = [f"{path.rstrip('/')}/{part}" for held in _commits(fs, root).values() for part in held]
    if not parts:
        return spark.createDataFrame([], "image_id string, file string, length long")
    name = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    return spark.read.format("binaryFile").load(parts).select(F.url_decode(F.regexp_replace(name, "~", "%")).alias("image_id"), F.col("path").alias("file"), "length")


def _batches(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], list[int | None]]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded bytes."""
    for b in batches:
        at, held = 0, 0
        for i, n in enumerate(size(b)):
            if held and held + (n or 0) > BATCH_BYTES:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n or 0
        if b.num_rows > at:
            yield b.slice(at)


def _decoded(data: list[bytes | None], others: dict[bytes, Decoder]) -> list[pa.Array]:
    found = png.decode([x if x is None or not any(map(x.startswith, others)) else None for x in data])
    for i, x in enumerate(data):
        decoder = next((f for magic, f in others.items() if x is not None and x.startswith(magic)), None)
        if decoder:
            found[i] = decoder(x)
    shapes = [x.shape[:2] if isinstance(x, np.ndarray) else (None, None) for x in found]
    pixels = [x.tobytes() if isinstance(x, np.ndarray) else None for x in found]
    return [pa.array([s[0] for s in shapes], pa.int32()), pa.array([s[1] for s in shapes], pa.int32()), pa.array(pixels, pa.binary()), pa.array([x if isinstance(x, str) else None for x in found], pa.string())]


_PIXELS = StructType().add("height", "integer").add("width", "integer").add("pixels", "binary").add("error", "string")


def decoded(images: DataFrame, column: str = "image", others: dict[bytes, Decoder] | None = None) -> DataFrame:
    """images with height, width, pixels and error in place of a column of coded images.

    PNG of every colour type and depth, not interlaced, is decoded here; others: decoders of further formats by the bytes
    that their files begin with. What can't be decoded has no pixels and says why in error; null images are null.
    """
    keep, others = [c for c in images.columns if c != column], others or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, lambda b: [len(x.as_buffer()) if x.is_valid else 0 for x in b[column]]):
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *_decoded(b[column].to_pylist(), others)], names=[*keep, *_PIXELS.names])

    plain = images.select(*keep, F.col(column).cast("binary").alias(column))
    return plain.mapInArrow(run, StructType([f for f in plain.schema if f.name != column] + _PIXELS.fields))


def read(listed: DataFrame, others: dict[bytes, Decoder] | None = None) -> DataFrame:
    """The pictures of rows of `files`, joined and filtered at will before: only their bytes are read, where they are decoded."""
    keep, others = [c for c in listed.columns if c not in ("file", "length")], others or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, lambda b: b["length"].to_pylist()):
            data = []
            for path in b["file"].to_pylist():
                fs, at = _place(path)
                with fs.open_input_stream(at) as f:
                    data.append(f.read())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *_decoded(data, others)], names=[*keep, *_PIXELS.names])

    plain = listed.select(*keep, "file", "length")
    return plain.mapInArrow(run, StructType([f for f in plain.schema if f.name in keep] + _PIXELS.fields))


def scan(source: DataFrame, wanted: DataFrame, key: str = "image_id", most: int = IN_LIST) -> DataFrame:
    """The rows of source whose key is among wanted, in two steps: first ids alone, then everything of the rows that are wanted.

    Up to `most` ids that are there go into the scan itself, where Parquet leaves out row groups and pages without them;
    more of them are joined.
    """
    there = source.select(key).join(wanted.select(key), key, "left_semi").distinct()
    few = [r[0] for r in there.limit(most + 1).collect()]
    if len(few) <= most:
        return source.filter(F.col(key).isin(few)) if few else source.filter(F.lit(False))
    return source.join(wanted.select(key), key, "left_semi")


def coded(images: DataFrame, column: str = "image") -> DataFrame:
    """images (height, width, pixels and any columns) with their PNG file instead of these three; null pixels give null."""
    keep = [c for c in images.columns if c not in ("height", "width", "pixels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(b["height"].to_pylist(), b["width"].to_pylist(), strict=True)
            out = [png.encode(np.frombuffer(p.as_buffer(), np.uint8).reshape(h, w, 3)) if p.is_valid else None for p, (h, w) in zip(b["pixels"], sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(out, pa.binary())], names=[*keep, column])

    plain = images.select(*keep, "height", "width", "pixels")
    return plain.mapInArrow(run, StructType([f for f in plain.schema if f.name in keep] + [StructField(column, BinaryType())]))
