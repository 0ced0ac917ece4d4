"""Best-fit packing of token sequences by length patterns.

The lengths of all pieces form a histogram whose size is bounded by the sequence length, so it
may be collected whatever the corpus. Patterns of a few lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded, and what the rounding leaves is packed by best-fit decreasing, also on counts. The
result is a table of patterns. Pieces find their place in it by their number among the pieces
of their length, so no group of equal lengths ever meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from seqatlas.llm.common import crc32, release, Sent, stage, whole_documents
from seqatlas.llm.tokens import WordEncoder, encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, place long"


def tokenised_pieces(docs: DataFrame, size: int = 2048, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its ids, ended by id 0, cut only when longer than ``size``.

    ``shard`` and ``place`` number the pieces of each length within a task. ``keep_ids`` adds the
    ids themselves. A null or empty text has the end id alone; repeated rows are packed each.
    """
    path = path or vocabulary("word_bpe_49k.json")
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    end = np.zeros(1, "<u4").tobytes()

    def cut(batches):
        release("encoders")
        encode = encoder(WordEncoder, path)
        shard, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    n = len(part) // 4
                    row = (doc_id, piece, at // 4, n, crc32(part), shard, int(seen[n]))
                    rows.append(row + (np.frombuffer(part, "<u4").astype(np.int32),) if keep_ids else row)
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return whole_documents(docs).mapInPandas(cut, schema)


def enumerate_patterns(size: int, most: int = 3) -> np.ndarray:
    """All ways to fill ``size`` exactly with at most three lengths, in falling order, padded with 0."""
    found = [np.array([[size, 0, 0]])]
    a = np.arange(size - 1, (size - 1) // 2, -1)
    found.append(np.column_stack([a, size - a, np.zeros_like(a)]))
    if most > 2:
        for longest in range(size - 2, (size - 1) // 3, -1):
            rest = size - longest
            b = np.arange(min(longest, rest - 1), (rest - 1) // 2, -1)
            found.append(np.column_stack([np.full_like(b, longest), b, rest - b]))
    return np.concatenate(found)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted |A x - histogram|, by accelerated projected gradient.

    Column p of A counts the lengths of pattern p. Short lengths weigh less, because their
    remainders fill gaps easily.
    """
    size = len(histogram) - 1
    scale = max(histogram.max(), 1)
    goal = histogram / scale
    weight = np.where(np.arange(size + 1) < size // 8, 0.3, 1.0)
    weight[0] = 0
    flat = patterns.ravel()

    def product(x):
        out = np.bincount(flat, np.repeat(x, patterns.shape[1]), size + 1)
        out[0] = 0
        return out

    # The step is set by the largest eigenvalue of A'WA, found by power iteration.
    v = np.ones(len(patterns))
    for _ in range(12):
        w = (weight * product(v))[patterns].sum(1)
        largest = np.linalg.norm(w) / max(np.linalg.norm(v), 1e-30)
        v = w / max(np.linalg.norm(w), 1e-30)
    step = 1 / max(1.1 * largest, 1e-9)
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        slope = (weight * (product(y) - goal))[patterns].sum(1)
        new = np.maximum(y - step * slope, 0)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x * scale


def round_counts(patterns: np.ndarray, fitted: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts, at most what the histogram holds, largest fitted first; and what they leave."""
    left = histogram.copy()
    left[0] = 0
    counts = np.zeros(len(patterns), np.int64)
    lists = patterns.tolist()
    # Rounded down first and up after, so that a large count doesn't take what others need.
    for wanted in (np.floor(fitted), np.where(fitted > 0.05, np.ceil(fitted), 0)):
        for p in np.argsort(-fitted, kind="stable"):
            more = int(wanted[p] - counts[p])
            if fitted[p] <= 0.05:
                break
            if more <= 0:
                continue
            need: dict[int, int] = {}
            for n in lists[p]:
                if n:
                    need[n] = need.get(n, 0) + 1
            more = min([more, *(int(left[n]) // k for n, k in need.items())])
            if more > 0:
                counts[p] += more
                for n, k in need.items():
                    left[n] -= more * k
    return counts, left


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the remaining lengths; equal sequences are one (lengths, count)."""
    open_by_space: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for n in range(size, 0, -1):
        count = int(left[n])
        space = n
        while count and space <= size:
            if not open_by_space[space]:
                space += 1
                continue
            lengths, repeats = open_by_space[space].pop()
            fits = space // n
            if count >= fits * repeats:
                used, times = repeats, fits
            elif count >= fits:
                used, times = count // fits, fits
            else:
                used, times = 1, count
            if repeats > used:
                open_by_space[space].append((lengths, repeats - used))
            open_by_space[space - n * times].append((lengths + (n,) * times, used))
            count -= used * times
        fits = size // n
        if count >= fits:
            open_by_space[size - n * fits].append(((n,) * fits, count // fits))
            count %= fits
        if count:
            open_by_space[size - n * count].append(((n,) * count, 1))
    return [x for group in open_by_space for x in group]


@dataclass
class Plan:
    """For every length, which run of its pieces goes to which sequences, at which offset."""

    key: np.ndarray  # length << 40 | first number of the run, rising
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 40) | number, side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def plan_packing(histogram: np.ndarray, most: int = 3) -> Plan:
    """Patterns and remainders for a histogram of lengths (index 0 unused)."""
    size = len(histogram) - 1
    histogram = histogram.astype(np.int64)
    patterns = enumerate_patterns(size, most)
    present = (histogram > 0) | (np.arange(size + 1) == 0)
    patterns = patterns[present[patterns].all(1)]
    chosen: list[tuple[tuple[int, ...], int]] = []
    left = histogram
    if len(patterns):
        counts, left = round_counts(patterns, fit_counts(patterns, histogram), histogram)
        chosen = [(tuple(n for n in patterns[p].tolist() if n), int(counts[p])) for p in np.flatnonzero(counts)]
    chosen += best_fit(left, size)
    used = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for lengths, repeats in chosen:
        offset = 0
        for n in lengths:
            rows.append((n << 40 | int(used[n]), int(used[n]), sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    table = np.array(sorted(rows) or [(0, 0, 0, 0)], np.int64)
    return Plan(*table.T, sequence)


def pack(pieces: DataFrame, size: int = 2048, most: int = 3) -> DataFrame:
    """Give every piece of ``tokenised_pieces`` (written to a stage table) its sequence and offset.

    Returns the pieces with sequence_id and offset; places are gapless from 0 in each sequence.
    """
    counts = pieces.groupBy("length", "shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("shard")
    numbered = counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    histogram = np.zeros(size + 1, np.int64)
    # At most ``size`` rows, whatever the input.
    for row in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    plan = Sent(pieces.sparkSession, plan_packing(histogram, most))
    # A shard holds one task's pieces: no length, however common, is one group here.
    joined = pieces.join(numbered.select("length", "shard", "_before"), ["length", "shard"])
    columns = [f for f in pieces.schema.fields if f.name not in ("shard", "place")]

    def assign(batches):
        for batch in batches:
            sequence, offset = plan.value.place(batch["length"].to_numpy(), (batch["_before"] + batch["place"]).to_numpy())
            out = batch[[f.name for f in columns]].copy()
            out["sequence_id"], out["offset"] = sequence, offset
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, offset long"
    return joined.mapInPandas(assign, schema)


def pack_documents(docs: DataFrame, size: int = 2048, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents."""
    return pack(stage(tokenised_pieces(docs, size, path, keep_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves, from pieces packed with ``keep_ids``; one row has at most ``size`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
