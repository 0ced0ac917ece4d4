"""Token files as wavelet matrices.

A shard holds the ids of consecutive documents (rising doc_id). Bit planes are stored from the
highest bit down; after each plane the ids are reordered, zeros before ones, in stable order.
With a sample of ranks the planes answer three questions without decoding the shard: the id
at a place, how often an id occurs before a place, and where its k-th occurrence is.

File layout: magic ``WMX1``, then one zstd frame of little-endian u64 ids, u64 documents, u32
planes, i64 doc_ids, a byte each (1: null), u64 document starts and the end, and for each plane
u64 zeros and the packed bits. Sampled ranks are recomputed from the planes on first use.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from seqatlas.llm.common import crc32, release, stage, whole_documents
from seqatlas.llm.tokens import ByteEncoder, encoder, vocabulary

MAGIC = b"WMX1"
BLOCK = 512  # bits between sampled ranks; a multiple of 8


def build(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """The file of one shard; ``starts`` has each document's first place and the end."""
    ids = ids.astype(np.uint32)
    planes = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    current = ids.astype(np.uint16) if planes <= 16 else ids
    parts = [
        struct.pack("<QQI", len(ids), len(doc_ids), planes),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        starts.astype("<u8").tobytes(),
    ]
    for plane in range(planes - 1, -1, -1):
        ones = (current & np.array(1 << plane, current.dtype)).astype(bool)
        low = current[~ones]
        parts.append(struct.pack("<Q", len(low)) + np.packbits(ones).tobytes())
        current = np.concatenate((low, current[ones]))
    body = b"".join(parts)
    return MAGIC + zstandard.ZstdCompressor(level=1).compress(body)


class Shard:
    """An opened file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        body = zstandard.ZstdDecompressor().decompress(data[4:])
        self.size, documents, self.planes = struct.unpack_from("<QQI", body)
        at = 20
        ids = np.frombuffer(body, "<i8", documents, at)
        at += 8 * documents
        null = np.frombuffer(body, "u1", documents, at)
        at += documents
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]
        self.starts = np.frombuffer(body, "<u8", documents + 1, at).astype(np.int64)
        at += 8 * (documents + 1)
        self.zeros, self.bits, width = [], [], (self.size + 7) // 8
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", body, at)[0])
            self.bits.append(np.frombuffer(body, "u1", width, at + 8))
            at += 8 + width
        self._ranks: list[np.ndarray] | None = None

    def _rank(self, plane: int, place: int) -> int:
        """Ones before a place in a plane."""
        if self._ranks is None:
            step = BLOCK // 8
            self._ranks = []
            for bits in self.bits:
                padded = np.concatenate((bits, np.zeros(-len(bits) % step, "u1"))).reshape(-1, step)
                self._ranks.append(np.concatenate(([0], np.bitwise_count(padded).sum(1, dtype=np.int64).cumsum())))
        block, bits = place // BLOCK, self.bits[plane]
        first = block * (BLOCK // 8)
        ones = int(self._ranks[plane][block]) + int(np.bitwise_count(bits[first : place // 8]).sum(dtype=np.int64))
        return ones + ((int(bits[place // 8]) >> (8 - place % 8)).bit_count() if place % 8 else 0)

    def _bit(self, plane: int, place: int) -> int:
        return int(self.bits[plane][place // 8]) >> (7 - place % 8) & 1

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for plane in range(self.planes):
            bit, ones = self._bit(plane, place), self._rank(plane, place)
            value = value << 1 | bit
            place = self.zeros[plane] + ones if bit else place - ones
        return value

    def count(self, token: int, before: int | None = None) -> int:
        """How often an id occurs before a place (the whole shard if none is given)."""
        first, last = 0, self.size if before is None else min(before, self.size)
        if token >> self.planes:
            return 0
        for plane in range(self.planes):
            a, b = self._rank(plane, first), self._rank(plane, last)
            if token >> (self.planes - 1 - plane) & 1:
                first, last = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                first, last = first - a, last - b
        return last - first

    def find(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of an id (from 0); -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        first = 0
        for plane in range(self.planes):
            ones = self._rank(plane, first)
            first = self.zeros[plane] + ones if token >> (self.planes - 1 - plane) & 1 else first - ones
        place = first + k
        for plane in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - plane) & 1
            place = self._select(plane, one, place - self.zeros[plane] if one else place)
        return place

    def _select(self, plane: int, one: int, k: int) -> int:
        """The place of the k-th one or zero of a plane, by bisection on ranks."""
        low, high = 0, self.size - 1
        while low < high:
            middle = (low + high) // 2
            ones = self._rank(plane, middle + 1)
            if (ones if one else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane undoes its reordering."""
        current = np.zeros(self.size, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.bits[plane], count=self.size).view(bool)
            above = np.empty_like(current)
            zeros = self.zeros[plane]
            above[~ones] = current[:zeros]
            above[ones] = current[zeros:] | np.array(1 << (self.planes - 1 - plane), current.dtype)
            current = above
        return current.astype("<u4")


FILES = "task int, shard int, n_ids long, payload binary"


def write_files(docs: DataFrame, path: str | None = None, end_id: int = 2, shard_ids: int = 1 << 20) -> DataFrame:
    """Tokenise whole documents in rising doc_id and write shards of about ``shard_ids`` ids.

    A document is never split over shards. Returns the table of files in the shared folder: one
    row a shard in (task, shard) order, with its payload. Null ids come first, equal ids by text.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        release("encoders")
        encode = encoder(ByteEncoder, path)
        task, shard, parts, ids, starts = TaskContext.get().partitionId(), 0, [], [], [0]

        def close():
            return pd.DataFrame({"task": [task], "shard": [shard], "n_ids": [starts[-1]], "payload": [build(np.frombuffer(b"".join(parts), "<u4"), ids, np.array(starts))]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                parts += (encode(text), end)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                starts.append(starts[-1] + len(parts[-2]) // 4 + 1)
                if starts[-1] >= shard_ids:
                    yield close()
                    shard, parts, ids, starts = shard + 1, [], [], [0]
        if ids:
            yield close()

    ordered = whole_documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInPandas(run, FILES), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    # One row a shard; the payloads stay out of it.
    order = Window.partitionBy(F.lit(0)).orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("task", "shard", "n_ids").withColumn("_first", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).drop("n_ids")

    def run(batches):
        for batch in batches:
            for payload, first in zip(batch["payload"], batch["_first"]):
                shard = Shard(bytes(payload))
                ids, starts = shard.decode(), shard.starts
                data = memoryview(ids.tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array(shard.doc_ids, "Int64"), "start": first + starts[:-1], "n_tokens": np.diff(starts),
                    "ids_crc32": [crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())],
                })

    return files.join(firsts, ["task", "shard"]).select("payload", "_first").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """How often an id occurs in each shard, from its planes alone: task, shard, occurrences, first place (null: none)."""

    def run(batches):
        for batch in batches:
            rows = []
            for task, shard, payload in zip(batch["task"], batch["shard"], batch["payload"]):
                opened = Shard(bytes(payload))
                n = opened.count(token)
                rows.append((task, shard, n, opened.find(token, 0) if n else None))
            yield pd.DataFrame(rows, columns=["task", "shard", "occurrences", "first_place"]).astype({"first_place": "Int64"})

    return files.select("task", "shard", "payload").mapInPandas(run, "task int, shard int, occurrences long, first_place long")
