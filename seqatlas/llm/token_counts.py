"""Token counts of whole texts by byte-pair merging, without making any token.

A text is cut into pieces as the byte-level vocabulary asks; the symbols of a piece are its bytes.
Neighbouring pairs wait in a heap by rank and place, the symbols in a linked list: the lowest
pair is popped, joined, and the two pairs it makes with its neighbours are pushed. A piece has as
many tokens as it had symbols, less the merges. Pieces repeat, so a cache of bounded size keeps
their counts in each Python worker.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame

from seqatlas.llm.common import process_cache, release, whole_documents
from seqatlas.llm.tokens import Recent, _byte_letters, vocabulary

# Fixed value: how the byte-level vocabulary cuts a text. White space is the Unicode property, which
# leaves out the separators U+001C to U+001F.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONGEST_KEPT = 64  # characters of a piece whose count is kept


class MergeCounter:
    """Counts the tokens of a text by the merges of a byte-level vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or model["type"] != "BPE" or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path} is not a plain byte-level merge vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        number = model["vocab"]
        self.start = [number[letter] for letter in _byte_letters()]
        # (left, right) -> (rank, joined symbol)
        self.joins = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, marks))) if marks else None
        self.cut = regex.compile(PIECES).findall
        self.kept = Recent(self._merged, 400_000)

    def _merged(self, piece: str) -> int:
        return self.count_bytes(piece.encode())

    def count_bytes(self, data: bytes) -> int:
        """Tokens of one piece: its bytes less the merges."""
        n, joins = len(data), self.joins
        symbol = [self.start[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(join[0], i) for i in range(n - 1) if (join := joins.get((symbol[i], symbol[i + 1])))]
        heapify(heap)
        merges = 0
        while heap:
            rank, left = heappop(heap)
            right = after[left]
            # A pair whose left or right symbol has gone or changed since it was pushed no longer has this rank.
            join = joins.get((symbol[left], symbol[right])) if right < n else None
            if join is None or join[0] != rank:
                continue
            merges += 1
            symbol[left], symbol[right] = join[1], -1
            far = after[left] = after[right]
            if far < n:
                before[far] = left
                if new := joins.get((symbol[left], symbol[far])):
                    heappush(heap, (new[0], left))
            near = before[left]
            if near >= 0 and (new := joins.get((symbol[near], symbol[left]))):
                heappush(heap, (new[0], near))
        return n - merges

    def plain(self, text: str) -> int:
        """Tokens of a text without strings of added tokens."""
        pieces = self.cut(text)
        if len(text) <= LONGEST_KEPT or max(map(len, pieces)) <= LONGEST_KEPT:
            return sum(map(self.kept.__getitem__, pieces))
        return sum(self.kept[p] if len(p) <= LONGEST_KEPT else self._merged(p) for p in pieces)

    def __call__(self, text: str) -> int:
        """Tokens of a text; a string of an added token is one token and parts what stands around it."""
        if not text:
            return 0
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        around = self.marks.split(text)
        return len(around) - 1 + sum(self.plain(t) for t in around if t)


def counter(path: str) -> MergeCounter:
    """One counter for each Python worker and vocabulary."""
    made = process_cache().setdefault("merge_counters", {})
    if path not in made:
        made[path] = MergeCounter(path)
    return made[path]


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null or empty text has no bytes and no tokens; rows with equal or null ids are counted each;
    an empty table gives an empty result; other columns are not read. Rows stay where they are.
    """
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches):
        release("merge_counters")
        count = counter(path)
        for batch in batches:
            texts = batch["text"].tolist()
            tokens = [count(t) for t in texts]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens, "over_limit": [n > limit for n in tokens],
            })

    return whole_documents(docs).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
