"""What several operators share: stage tables, words, and rolling hashes over byte buffers."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqatlas.session import shared_folder

# Fixed value: the words of a text are maximal runs of these characters (lower-case letters,
# digits and everything beyond ASCII), taken after lower-casing A-Z.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD = re.compile(WORD_CLASS.encode())
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = True
_WORD_BYTE[0x61:0x7B] = True
_WORD_BYTE[0x80:] = True
_PRIME = 0x9E3779B97F4A7C15 | 1


def files_for(rows: int, each: int = 20_000) -> int:
    """Files (and last tasks) for a stage table of about so many rows: few small ones, and ever more with the rows."""
    return max(8, -(-rows // each))


def stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back, in at most ``files`` files.

    A lost executor then costs no recomputation, and several passes read the same rows.
    """
    if files is not None:
        df = df.coalesce(files)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python about BATCH_BYTES at a time, unless the session sets a smaller bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = str(spark.conf.get(name)).lower().rstrip("b")
    if not have.isdigit() or int(have) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def whole_documents(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads: doc_id and text (null: empty), without any other column."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def process_cache() -> dict:
    """A dictionary that outlives the task in a reused Python worker."""
    return sys.modules.setdefault("_seqatlas_process_cache", types.ModuleType("_seqatlas_process_cache")).__dict__


def release(*keep: str) -> None:
    """Let go of what earlier operators cached in this Python worker, but for the named entries and small tables."""
    cache = process_cache()
    for name in [k for k in cache if k not in ("powers", "byte_values", "gamma", "sent", *keep) and not k.startswith("__")]:
        del cache[name]
    # Freed memory goes back to the system: a worker is kept for many tasks, beside the JVM's own memory.
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Sent:
    """A value for all tasks, broadcast as bytes.

    Spark pickles what it broadcasts by reference to its module; these bytes hold the class itself, so
    workers need not be able to import the package. A worker opens them once.
    """

    def __init__(self, spark: SparkSession, value):
        self._name = uuid.uuid4().hex
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        opened = process_cache().setdefault("sent", {})
        if self._name not in opened:
            while len(opened) >= 4:
                opened.pop(next(iter(opened)))
            opened[self._name] = pickle.loads(self._bytes.value)
        return opened[self._name]


def unused(name: str, columns: Sequence[str]) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    cache = process_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_PRIME, -1, 1 << 64)
        both = []
        for base in (_PRIME, inverse):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = cache["powers"] = tuple(both)
    return have


def _byte_values() -> np.ndarray:
    cache = process_cache()
    if "byte_values" not in cache:
        cache["byte_values"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
    return cache["byte_values"]


class Prefix:
    """Prefix hashes of a byte buffer: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * self.power[: len(data)], out=self.sums[1:])

    def raw(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of(self, start, end) -> np.ndarray:
        return mix(self.raw(start, end))

    @staticmethod
    def of_rows(data: np.ndarray) -> np.ndarray:
        """Prefix sums of every row of a byte table."""
        width = data.shape[1]
        sums = np.zeros((len(data), width + 1), np.uint64)
        np.cumsum(_byte_values()[data] * _powers(width + 1)[0][:width], axis=1, out=sums[:, 1:])
        return sums

    @staticmethod
    def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[:, end] - sums[:, start]) * _powers(sums.shape[1])[1][start]


def words_of(text: str | None) -> list[bytes]:
    """The words of one text as UTF-8."""
    return _WORD.findall((text or "").encode().lower())


def slices(texts: Iterable[str | None], size: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of whole texts of about ``size`` bytes, with the place of the first."""
    first, run, total = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if run and total + len(data) > size:
            yield first, run
            first, run, total = i, [], 0
        run.append(data)
        total += len(data) + 1
    if run:
        yield first, run


def word_table(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every word of a run of texts, in order."""
    data = np.frombuffer(b"\n".join(run).lower() + b"\n", np.uint8)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(d) + 1 for d in run])
    return np.searchsorted(ends, start, side="right"), Prefix(data).of(start, end)


def shingle_table(run: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every ``width``-word shingle, repeated ones repeated.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    text, word = word_table(run)
    if not len(word):
        return text, word
    count = np.bincount(text, minlength=len(run))
    step = 0xD6E8FEB86659FD93
    mixed = np.zeros(len(word), np.uint64)
    weight = 1
    for j in range(min(width, len(word))):
        part = word[j:] * np.uint64(weight)
        # A shingle that would reach into the next text is left out below; a short text ends early.
        same = text[j:] == text[: len(part)]
        mixed[: len(part)] += np.where(same, part, np.uint64(0))
        weight = weight * step % (1 << 64)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = np.arange(len(word)) - first[text]
    keep = (place + width <= count[text]) | ((place == 0) & (count[text] < width))
    return text[keep], mix(mixed[keep])


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
