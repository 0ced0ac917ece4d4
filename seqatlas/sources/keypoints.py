"""Keypoint archives (.npz): one file per video to one row per frame."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Array names tried in this order when the four declared arrays are absent.
SEQUENCE_NAMES = (
    "sequences", "sequence", "keypoints", "keypoint", "data", "X", "x",
    "arr_0", "features", "landmarks", "inputs", "input",
)
DECLARED = ("pose", "hands", "face", "mouth")
SCALARS = ("video_name", "source_fps", "source_total_frames", "target_frames")

FRAME_SCHEMA = """path string, sample_index int, frame long, sequence_key string,
    pose array<float>, hands array<float>, face array<float>, mouth array<float>, row array<float>,
    v_pose boolean, v_left boolean, v_right boolean, v_face boolean,
    video_name string, source_fps double, source_total_frames long, target_frames long, error string"""
ARRAY_SCHEMA = "path string, name string, shape string, dtype string, size long, has_nan boolean, has_inf boolean, error string"


def as_samples(array: np.ndarray) -> np.ndarray | None:
    """Common shapes to (sample, frame, value): (T,D), (T,K,C), (N,T,D), (N,T,K,C)."""
    if not np.issubdtype(array.dtype, np.number) or array.ndim not in (2, 3, 4):
        return None
    a = array.astype(np.float32, copy=False)
    if a.ndim == 2:
        return a[None]
    if a.ndim == 4:
        return a.reshape(*a.shape[:2], -1)
    points = a.shape[-1] in (2, 3, 4) and a.shape[1] > 10
    return a.reshape(1, a.shape[0], -1) if points else a


def _scalar(archive, name: str, cast):
    if name not in archive:
        return None
    a = np.asarray(archive[name]).ravel()
    return cast(a[0]) if a.size else None


def _frames_of(path: str, content: bytes) -> pd.DataFrame:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        names = set(z.files)
        kind = {"video_name": str, "source_fps": float, "source_total_frames": int, "target_frames": int}
        scalars = {k: _scalar(z, k, kind[k]) for k in SCALARS}
        if {"pose", "hands"} <= names:
            parts = {k: np.asarray(z[k], dtype=np.float32).reshape(len(z[k]), -1) for k in DECLARED if k in names}
            n = len(next(iter(parts.values())))
            if any(len(a) != n for a in parts.values()):
                raise ValueError("arrays of unequal length: " + ", ".join(f"{k} {len(a)}" for k, a in parts.items()))
            out = pd.DataFrame({"frame": np.arange(n), "sample_index": 0, "sequence_key": "+".join(parts)})
            for k, a in parts.items():
                out[k] = list(a)
            if "valid_mask" in names and np.ndim(z["valid_mask"]) == 2 and len(z["valid_mask"]) >= n:
                mask = np.asarray(z["valid_mask"])[:n, :4].astype(bool)
                for i, flag in enumerate(("v_pose", "v_left", "v_right", "v_face")):
                    out[flag] = mask[:, i] if i < mask.shape[1] else None
        else:
            candidates = {k: as_samples(z[k]) for k in z.files}
            usable = {k: a for k, a in candidates.items() if a is not None}
            key = next((k for k in SEQUENCE_NAMES if k in usable), None)
            key = key or max(usable, key=lambda k: usable[k].size, default=None)
            if key is None:
                raise ValueError(f"no sequence array among: {', '.join(sorted(names))}")
            a = usable[key]
            samples, frames = a.shape[:2]
            out = pd.DataFrame(
                {
                    "sample_index": np.repeat(np.arange(samples), frames),
                    "frame": np.tile(np.arange(frames), samples),
                    "sequence_key": key,
                    "row": list(a.reshape(samples * frames, -1)),
                }
            )
        return out.assign(path=path, **scalars)


BATCH_FRAMES = 2_000
FRAME_COLUMNS = [part.split()[0] for part in FRAME_SCHEMA.replace("\n", " ").split(",")]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of many small files leave together, at most about ``BATCH_FRAMES`` at a time."""
    held, count = [], 0

    def flush() -> pd.DataFrame:
        rows = pd.concat([r.reindex(columns=FRAME_COLUMNS).astype(object) for r in held], ignore_index=True)
        return rows.where(rows.notna(), None)

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows = _frames_of(path, content)
            except Exception as problem:  # a broken file becomes an error row
                rows = pd.DataFrame([{"path": path, "error": f"load_failed: {problem}"}])
            held.append(rows)
            count += len(rows)
            if count >= BATCH_FRAMES:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def decode_frames(files: DataFrame) -> DataFrame:
    """(path, content) rows to frame rows; files that fail give one row with ``error``."""
    return files.select("path", "content").mapInPandas(_decode, FRAME_SCHEMA)


def read_frames(spark: SparkSession, root: str, pattern: str = "*.npz") -> DataFrame:
    """All archives below a folder, read and decoded on the executors."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return decode_frames(reader.load(root))


def archive_metadata(frames: DataFrame) -> DataFrame:
    """One row per archive from its decoded frames: number of frames, scalars, and the share of valid
    frames of each part (NULL without a mask). A file that failed keeps its error."""
    flags = {"pose": "v_pose", "left_hand": "v_left", "right_hand": "v_right", "face": "v_face"}
    return frames.groupBy("path").agg(
        F.count("frame").alias("num_frames"),
        *[F.max(c).alias(c) for c in SCALARS],
        *[F.avg(F.col(flag).cast("double")).alias(f"valid_{part}_ratio") for part, flag in flags.items()],
        F.max("error").alias("error"),
    )


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files:
                        a = z[name]
                        floating = np.issubdtype(a.dtype, np.floating)
                        found.append(
                            (path, name, str(a.shape), str(a.dtype), a.size,
                             bool(floating and np.isnan(a).any()), bool(floating and np.isinf(a).any()), None)
                        )
                    if not z.files:
                        found.append((path, None, None, None, 0, False, False, None))
            except Exception as problem:
                found.append((path, None, None, None, None, None, None, str(problem)))
        columns = ["path", "name", "shape", "dtype", "size", "has_nan", "has_inf", "error"]
        yield pd.DataFrame(found, columns=columns)


def inspect_arrays(files: DataFrame) -> DataFrame:
    """One row per array of each archive: name, shape, type, NaN and Inf flags."""
    return files.select("path", "content").mapInPandas(_inspect, ARRAY_SCHEMA)
