"""The boundary to an external model: a backend loaded once a worker, called on batches, everything else stays columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenlake import workers

RESULT = "boxes array<array<double>>, confidence double, inference_ms double"
Answer = tuple[list[list[float]], float | None, float]


class GroundingBackend(Protocol):
    def ground(self, image_ids: list[str], images: list[Any], phrases: list[str], seeds: list[int], **options: Any) -> list[Answer]:
        """For a batch of images and phrases: the boxes, a confidence, and milliseconds of each."""

    def attend(self, image_ids: list[str], images: list[Any], phrases: list[str], **options: Any) -> list[list[np.ndarray]]:
        """For each image and phrase, and each token that is generated: the cross-attention to the image, a row for each layer and head."""


@dataclass
class ColourBackend:
    """Grounds colours in pixels: the box of all pixels whose channel is strong, and how much of the box they fill.

    Phrases are red, green and blue; images are rows of height, width and pixels; level is how strong (0 to 255).
    """

    channels: tuple[str, ...] = ("red", "green", "blue")

    def ground(self, image_ids: list[str], images: list[Any], phrases: list[str], seeds: list[int], level: int = 128, **options: Any) -> list[Answer]:
        return [self._one(i, self.channels.index(p), level) if i is not None and p in self.channels else ([], None, 0.0) for i, p in zip(images, phrases, strict=True)]

    def attend(self, image_ids: list[str], images: list[Any], phrases: list[str], **options: Any) -> list[list[np.ndarray]]:
        """One token with one row: an entry for no pixel, then each pixel's share of the channel."""
        out = []
        for i, p in zip(images, phrases, strict=True):
            values = self._channel(i, self.channels.index(p)).ravel().astype(float) if i is not None and p in self.channels else None
            out.append([] if values is None else [np.concatenate([[0.0], values / max(values.sum(), 1)])[None, :]])
        return out

    @staticmethod
    def _channel(image: Any, channel: int) -> np.ndarray:
        return np.frombuffer(image["pixels"], np.uint8).reshape(image["height"], image["width"], 3)[..., channel]

    def _one(self, image: Any, channel: int, level: int) -> Answer:
        y, x = np.nonzero(self._channel(image, channel) >= level)
        if not len(x):
            return [], 0.0, 0.0
        box = [float(x.min()), float(y.min()), float(x.max() + 1), float(y.max() + 1)]
        return [box], len(x) / ((box[2] - box[0]) * (box[3] - box[1])), 0.0


#: Rows that a backend gets at once.
BATCH = 64


def _loaded(load: Callable[[], GroundingBackend]) -> Callable[[], GroundingBackend]:
    """What gives a worker its backend: load runs once in it, whatever the number of tasks, until another one is asked for."""
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()
    return lambda: workers.kept("backend", key, load)


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for k in range(0, len(b), BATCH):
        yield b[k : k + BATCH]


def _asked(b: pd.DataFrame) -> tuple[list, list, list]:
    return list(b["image_id"]), list(b["image"]) if "image" in b else [None] * len(b), list(b["phrase"])


def run_task(rows: DataFrame, load: Callable[[], GroundingBackend], seed: int = 0, **options: Any) -> DataFrame:
    """rows (image_id, phrase, optionally image and seed) with boxes, confidence and inference_ms of a backend.

    Filter rows before: what should not be asked must not reach the model. load runs once in each worker; options are the
    backend's own.
    """
    backend = _loaded(load)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for part in _parts(b):
                seeds = [int(s) for s in part["seed"]] if "seed" in part else [seed] * len(part)
                found += backend().ground(*_asked(part), seeds, **options)
            yield b.assign(boxes=[f[0] for f in found], confidence=[f[1] for f in found], inference_ms=[f[2] for f in found])

    return rows.mapInPandas(run, StructType(rows.schema.fields + StructType.fromDDL(RESULT).fields))


def attention(rows: DataFrame, load: Callable[[], GroundingBackend], **options: Any) -> DataFrame:
    """image_id, phrase, step (from 0) and weights of a backend's attention, a row for each layer and head: what heat_maps takes.

    Rows go on as they come, a batch of images at a time, so no map of all images is ever held. Rows for which the backend
    has no attention have no row here.
    """
    backend = _loaded(load)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _parts(b):
                ids, images, phrases = _asked(part)
                for i, p, steps in zip(ids, phrases, backend().attend(ids, images, phrases, **options), strict=True):
                    for k, weights in enumerate(steps):
                        yield pd.DataFrame({"image_id": i, "phrase": p, "step": k, "weights": list(np.asarray(weights, float))})

    return rows.mapInPandas(run, "image_id string, phrase string, step int, weights array<double>")


def _runs(rows: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n))))


def reruns(rows: DataFrame, load: Callable[[], GroundingBackend], n: int = 3, **options: Any) -> DataFrame:
    """rows asked n times with sampling, as run 1 to n: each run is a row whose seed is its number."""
    runs = _runs(rows, n).withColumn("seed", F.col("run"))
    return run_task(runs, load, **({"do_sample": True, "num_beams": 1, "temperature": 0.7} | options)).drop("seed")


def replay(rows: DataFrame, recorded: DataFrame) -> DataFrame:
    """The same from recorded answers (image_id, phrase, boxes, confidence, inference_ms): a join, no Python; null where nothing is recorded."""
    return rows.join(recorded, ["image_id", "phrase"], "left")


def replay_runs(rows: DataFrame, recorded: DataFrame, n: int = 3) -> DataFrame:
    """Reruns from recorded answers, which have a run beside their image_id and phrase; null where a run is not recorded."""
    return _runs(rows, n).join(recorded, ["image_id", "phrase", "run"], "left")
