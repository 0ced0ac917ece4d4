"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Every paragraph (line) is hashed to a wide vector and a document's fingerprint is the sum of
its paragraphs' vectors: eight lanes modulo 2**64 taken from a 512-bit digest of the whole
paragraph, and ``LANES`` lanes modulo 2**16 in which every pair of neighbouring words of the
paragraph adds +1 or -1 to one lane. The sum doesn't depend on the order of paragraphs, and
inserting or deleting a paragraph adds or subtracts its vector. The wide lanes decide equality;
the small ones give a likeness, since the squared length of a difference of two such sums
estimates how many word pairs the texts don't share.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from seqatlas.llm.common import _WORD_BYTE, Prefix, mix, slices, stage, whole_documents

WIDE, LANES = 8, 128
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The wide (uint64) and the small (int16) lanes of each text; a null text counts as empty."""
    wide, small = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), LANES), np.int16)
    for first, run in slices(texts):
        rows = slice(first, first + len(run))
        lines = [d.split(b"\n") for d in run]
        digests = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8 * WIDE).digest() for d in lines for x in d]), "<u8").reshape(-1, WIDE)
        starts = np.concatenate(([0], np.cumsum([len(d) for d in lines])[:-1]))
        wide[rows] = np.add.reduceat(digests, starts, axis=0)
        small[rows] = _pairs(run)
    return wide, small


def _pairs(run: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"\n".join(run).lower() + b"\n", np.uint8)
    inside = np.concatenate(([False], _WORD_BYTE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros((len(run), LANES), np.int16)
    word = Prefix(data).raw(start, end)
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    text = np.searchsorted(np.cumsum([len(d) + 1 for d in run]), start, side="right")
    # The last word of a line stands alone, so that lines of one word count as well.
    alone = np.concatenate((line[1:] != line[:-1], [True]))
    following = np.concatenate((word[1:], word[:1]))
    h = mix(word * np.uint64(0xD6E8FEB86659FD93) + np.where(alone, np.uint64(0), following))
    lane = (h & np.uint64(LANES - 1)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    sums = np.bincount(text * LANES + lane, sign, len(run) * LANES)
    return sums.astype(np.int64).astype(np.int16).reshape(len(run), LANES)


def encode(wide: np.ndarray, small: np.ndarray) -> str:
    return base64.b64encode(wide.astype("<u8").tobytes() + small.astype("<i2").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data[: 8 * WIDE], "<u8"), np.frombuffer(data[8 * WIDE :], "<i2")


def changed(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after paragraphs are inserted and deleted, without the document."""
    wide, small = (a.copy() for a in decode(fingerprint))
    for paragraphs, sign in ((inserted, 1), (deleted, -1)):
        if paragraphs:
            w, s = vectors(list(paragraphs))
            total, part = w.sum(0, dtype=np.uint64), s.sum(0, dtype=np.int16)
            wide, small = (wide + total, small + part) if sign > 0 else (wide - total, small - part)
    return encode(wide, small)


def likeness(wide_a, small_a, wide_b, small_b) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 less the share of word pairs not in common; 1 for equal fingerprints."""
    apart = ((small_a - small_b).astype(np.float64) ** 2).sum(1)
    both = (small_a.astype(np.float64) ** 2).sum(1) + (small_b.astype(np.float64) ** 2).sum(1)
    near = np.clip(1 - apart / np.maximum(both, 1), 0, 1)
    near[both == 0] = 0
    near[(wide_a == wide_b).all(1)] = 1
    return near


def _results(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    """``following`` has one text more than the others have rows only if they are neighbours."""
    edited = []
    for text, after in zip(texts, following):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    wide, small = vectors(texts)
    edited_wide, edited_small = vectors(edited)
    # The next text's vectors are the next row's, but for the last row.
    if texts[1:] == following[:-1]:
        last_wide, last_small = vectors(following[-1:])
        next_wide, next_small = np.concatenate((wide[1:], last_wide)), np.concatenate((small[1:], last_small))
    else:
        next_wide, next_small = vectors(following)
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64"),
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [encode(w, s) for w, s in zip(wide, small)],
        "edited_fingerprint": [encode(w, s) for w, s in zip(edited_wide, edited_small)],
        "near_edited": likeness(wide, small, edited_wide, edited_small),
        "near_next": likeness(wide, small, next_wide, next_small),
    })


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, without their neighbours: doc_id, n_chars, fingerprint."""

    def run(batches):
        for batch in batches:
            wide, small = vectors(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_chars": batch["text"].str.len(), "fingerprint": [encode(w, s) for w, s in zip(wide, small)]})

    return whole_documents(docs).mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near they are.

    The edited text has its last half replaced by the start of the next document in rising
    doc_id (null first, equal ids by text; the first follows the last). Texts are range-partitioned
    and sorted once. A task knows the next document of all but its last row; the last and the
    first row of each task are matched afterwards by a join on task numbers.
    """
    ordered = whole_documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = RESULT + ", task int, border string, text string"

    def run(batches):
        task, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            texts = batch["text"].tolist()
            if not ids:
                continue
            if held is None:
                yield _border(task, "first", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                yield _results(ids[:-1], texts[:-1], texts[1:]).assign(task=task, border=None, text=None)
        if held is not None:
            yield _border(task, "last", *held)

    def finish(batches):
        for batch in batches:
            if len(batch):
                ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
                yield _results(ids, batch["text"].tolist(), batch["after"].tolist())

    rows = stage(ordered.mapInPandas(run, schema), "fingerprints")
    first = rows.where("border = 'first'").select("task", F.col("text").alias("after"))
    # One row a task, without texts: which task with rows comes next.
    order = Window.partitionBy(F.lit(0)).orderBy("task")
    tasks = first.select("task").withColumn("_next", F.lead("task").over(order)).withColumn("_first", F.min("task").over(Window.partitionBy(F.lit(0))))
    tasks = tasks.select("task", F.coalesce("_next", "_first").alias("_next"))
    last = rows.where("border = 'last'").select("doc_id", "text", "task").join(tasks, "task")
    pairs = last.join(first.withColumnRenamed("task", "_next"), "_next").select("doc_id", "text", "after")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return rows.where("border is null").select(*names).unionByName(pairs.mapInPandas(finish, RESULT))


def _border(task: int, border: str, doc_id, text: str) -> pd.DataFrame:
    return pd.DataFrame({
        "doc_id": pd.array([doc_id], "Int64"), "n_chars": pd.array([None], "Int64"), "edited_sha256": [None], "fingerprint": [None],
        "edited_fingerprint": [None], "near_edited": [None], "near_next": [None], "task": [task], "border": [border], "text": [text],
    })
