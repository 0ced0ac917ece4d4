"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

An automaton over words holds every run of words of every item. A document streams through it;
the state after a word stands for the longest run that ends there and occurs in some item. A
window is ``width`` consecutive words of an item, or all words of a shorter one. Words inside
any occurrence of a window are hit; spans of hit words longer than a limit, or documents with
too large a share of hit words, go.

Items are cut into blocks of at most ``block_words`` words. Each block is one automaton of
bounded size (at most two states a word), sent to the tasks that read the documents; the hits
of several blocks are joined per document. No document is compared with another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqatlas.llm.common import Sent, bounded_batches, release, whole_documents, words_of

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<first:long,last:long>>"


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []  # (state after a word of an item, item number)
        self.names = [name for name, _ in items]
        self.shortest = width
        for number, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary) + 1))
        # A second walk finds the states, which no longer change.
        own: dict[int, set[int]] = {}
        self.short: dict[int, list[int]] = {}  # state of a whole short item -> item numbers
        for number, (_, words) in enumerate(items):
            state = 0
            for word in words:
                state = self.edges[state][self.vocabulary[word]]
                ends.append((state, number))
            if words and len(words) < width:
                self.short.setdefault(state, []).append(number)
                self.shortest = min(self.shortest, len(words))
        for state, number in ends:
            own.setdefault(state, set()).add(number)
        # Items of a window: those whose words end in the state's subtree of suffix links.
        self.of_window: dict[int, set[int]] = {}
        for state, numbers in own.items():
            at = state
            while at > 0 and self.length[at] >= width:
                if self.length[self.link[at]] < width:
                    self.of_window.setdefault(at, set()).update(numbers)
                at = self.link[at]
        # The next state on the chain of suffix links that is a whole short item, or 0.
        self.next_short = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.next_short[state] = up if up in self.short else self.next_short[up]

    def _extend(self, last: int, letter: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        if letter in edges[last]:
            known = edges[last][letter]
            return known if length[known] == length[last] + 1 else self._split(last, letter, known)
        state = len(link)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and letter not in edges[at]:
            edges[at][letter] = state
            at = link[at]
        if at >= 0:
            known = edges[at][letter]
            link[state] = known if length[known] == length[at] + 1 else self._split(at, letter, known)
        return state

    def _split(self, at: int, letter: int, known: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        copy = len(link)
        edges.append(dict(edges[known]))
        length.append(length[at] + 1)
        link.append(link[known])
        link[known] = copy
        while at >= 0 and edges[at].get(letter) == known:
            edges[at][letter] = copy
            at = link[at]
        return copy

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """(hit words as 0/1, numbers of the items with an occurring window)."""
        n = len(words)
        change = np.zeros(n + 1, np.int64)
        found: set[int] = set()
        get = self.vocabulary.get
        letters = np.fromiter([get(w, 0) for w in words], np.int64, n)
        # Only runs of words that some item has can hold a window.
        known = np.concatenate(([0], (letters > 0).astype(np.int8), [0]))
        step = np.diff(known)
        first, after = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long_enough = after - first >= self.shortest
        edges, link, length, width = self.edges, self.link, self.length, self.width
        for a, b in zip(first[long_enough].tolist(), after[long_enough].tolist()):
            state = matched = 0
            for i, letter in enumerate(letters[a:b].tolist(), a):
                while state and letter not in edges[state]:
                    state = link[state]
                    matched = length[state]
                following = edges[state].get(letter)
                if following is None:
                    state = matched = 0
                    continue
                state, matched = following, matched + 1
                if matched >= width:
                    at = state
                    while length[link[at]] >= width:
                        at = link[at]
                    found |= self.of_window[at]
                    change[i - width + 1] += 1
                    change[i + 1] -= 1
                if self.short:
                    # The longest whole short item among the suffixes of the match covers the shorter ones.
                    at = state if state in self.short and length[state] <= matched else self.next_short[state]
                    longest = length[at]
                    while at:
                        found.update(self.short[at])
                        at = self.next_short[at]
                    if longest:
                        change[i - longest + 1] += 1
                        change[i + 1] -= 1
        return np.cumsum(change[:-1]) > 0, found


def automata(benchmark: DataFrame, width: int = 13, block_words: int = 500_000) -> list[Automaton]:
    """The automata of all items, one for each ``block_words`` words (an item is never split)."""
    made, block, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if block and size + len(words) > block_words:
            made.append(Automaton(block, width))
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    if block:
        made.append(Automaton(block, width))
    return made


def hit_words(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = 500_000, share: int = 20) -> DataFrame:
    """One row per document: words, hit words, the items found and the hit spans (word numbers).

    ``contaminated``: at least one hit word in ``share``. Null and empty texts have no words;
    items without words have no window; windows of items without an id count for the hit words,
    but such items are not among the items found; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    blocks = [Sent(spark, a) for a in automata(benchmark, width, block_words)]

    def scan(batches):
        release()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                hit, items = np.zeros(len(words), bool), set()
                for block in blocks:
                    h, found = block.value.scan(words)
                    hit |= h
                    items.update(name for i in found if (name := block.value.names[i]) is not None)
                step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
                n_hit, names = int(hit.sum()), sorted(items)
                digest = hashlib.sha256(",".join(names).encode()).hexdigest()
                out.append((doc_id, len(words), n_hit, len(names), digest, n_hit > 0 and share * n_hit >= len(words), names, spans))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return whole_documents(docs).mapInPandas(scan, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, cut_longer_than: int | None = None, block_words: int = 500_000, size_column: str | None = "n_chars") -> DataFrame:
    """The documents that stay, with all their columns.

    Contaminated documents go. With ``cut_longer_than`` the hit spans of more than so many words
    are also cut from the texts that stay (the words and what stands between them), and
    ``size_column``, if there is one, gets the new length of such a text.
    """
    import re

    from seqatlas.llm.common import WORD_CLASS

    bounded_batches(docs.sparkSession)
    blocks = [Sent(docs.sparkSession, a) for a in automata(benchmark, width, block_words)]
    word, schema, at = re.compile(WORD_CLASS.encode()), docs.schema, docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        """The text without what is cut; False if the document goes."""
        if not text:
            return text
        data = text.encode()
        places = [m.span() for m in word.finditer(data.lower())]
        words = [data[a:b].lower() for a, b in places]
        hit = np.zeros(len(words), bool)
        for block in blocks:
            hit |= block.value.scan(words)[0]
        n = int(hit.sum())
        if n and share * n >= len(words):
            return False
        if n and cut_longer_than is not None:
            step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            for a, b in reversed(list(zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)))):
                if b - a > cut_longer_than:
                    data = data[: places[a][0]] + data[places[b - 1][1] :]
            return data.decode()
        return text

    names = docs.columns

    def keep(batches):
        import pyarrow as pa

        release()

        for batch in batches:
            before = batch.column(at).to_pylist()
            texts = [clean(t) for t in before]
            stays = pa.array([t is not False for t in texts], pa.bool_())
            if size_column in names:
                k = names.index(size_column)
                sizes = [c if a == b or not b else len(b) for c, a, b in zip(batch.column(k).to_pylist(), before, texts)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(sizes, batch.schema.field(k).type))
            batch = batch.set_column(at, batch.schema.field(at), pa.array([t or (None if t is None else "") for t in texts], batch.schema.field(at).type))
            yield batch.filter(stays)

    return docs.mapInArrow(keep, schema)
