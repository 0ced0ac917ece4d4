"""Removal of long byte strings that occur more than once, by sorted suffixes.

A byte goes when a ``WINDOW``-byte string covering it also starts anywhere else. Sorting every
suffix of a corpus isn't needed for that. In each window the smallest hash of its ``GRAM``-byte
substrings picks an anchor; equal windows pick the same anchor, and neighbouring windows mostly
share one, so only the suffixes at anchors are compared, each with ``WINDOW - GRAM`` bytes on
either side of its gram. An anchor whose gram occurs once can't matter; one whose gram and whole
surroundings occur more than once needs no comparison, because all its windows repeat.

What is left is a set of suffixes, one for each different surrounding of a repeated gram, and
is sorted by a distributed merge. Every task sorts its suffixes into runs and front-codes them
(the length of the prefix shared with the one before, and the rest); the runs are exchanged by
range of the leading gram hash; each range is merged by a loser tree that keeps, for every
loser, the length of the prefix it shares with the winner, so bytes known to be equal are never
compared again. In the merged order suffixes with the same gram are neighbours; two of them
share a window when the bytes they share to the left of the gram and to the right of it make
up ``WINDOW - GRAM``.

A gram with more than ``most`` different surroundings, or a five-hundredth of all (256 at least), isn't merged in one task: blocks of its neighbouring
windows are told apart by what all windows of a block share and by all they cover, as grams are by their surroundings;
windows of blocks that are still open are hashed (128 bits) and counted by a distributed aggregation, which gives the same bytes.

Repeats of a shorter length, ``passage``, come from the same pass: anchors are then picked in windows of that
length, and those of longer windows are among them; only the surroundings keep the longer reach.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqatlas.llm.common import Prefix, files_for, mix, release, stage, unused, whole_documents

WINDOW, GRAM = 400, 200
SEGMENT = 1 << 23
RANGE_BYTES = 1 << 24
_ODD = 0x9E3779B97F4A7C15
SMALL = 12
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
PASSAGES = "n_passage_bytes long, passage_text string"


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values: minima from both ends of blocks of ``width``."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM, side: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, hash of the surroundings) of the anchors of one text of bytes.

    Surroundings are ``side`` bytes on either side of the gram, by default as far as its windows reach.
    The leftmost of equal smallest hashes is picked. Very long texts are read in segments that
    overlap by a window, so that every window lies in one.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, reach = len(data), window - gram
    side = reach if side is None else side
    for first in range(0, max(n - window + 1, 0), SEGMENT):
        # Bytes before the segment are read too: they belong to the surroundings.
        begin, end = max(first - side, 0), min(first + SEGMENT + window - 1 + side, n)
        part = Prefix(data[begin:end])
        last = min(first + SEGMENT, n - window + 1)  # windows start in [first, last)
        start = np.arange(first, last + reach) - begin
        h = part.of(start, start + gram)
        packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        smallest = _window_minima(packed, reach + 1)
        at = (np.unique(smallest) & np.uint64((1 << 24) - 1)).astype(np.int64)
        at.sort()
        place = at + first
        left, right = np.minimum(place, side), np.minimum(n - place, gram + side)
        around = mix(part.raw(place - left - begin, place + right - begin) + left.astype(np.uint64) * np.uint64(1 << 20) + right.astype(np.uint64))
        found.append((place, h[at], around))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, h, around = (np.concatenate(x) for x in zip(*found))
    place, at = np.unique(place, return_index=True)
    return place, h[at], around[at]


def front_code(sorted_rows: list[bytes]) -> list[tuple[int, bytes]]:
    """(length shared with the one before, the rest) of sorted strings."""
    out, before = [], b""
    for row in sorted_rows:
        n = shared(before, row, 0)
        out.append((n, row[n:]))
        before = row
    return out


def shared(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix; the first ``known`` bytes are equal."""
    most = min(len(a), len(b))
    step = 32
    while known < most:
        if a[known : known + step] == b[known : known + step]:
            known = min(known + step, most)
        elif step == 1:
            return known
        else:
            step = max(step // 4, 1)
    return known


def merge_runs(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge front-coded runs of (shared, rest, value) into (shared with the one before, string, value).

    The loser tree holds at each inner node the loser of its last match with the length of the
    prefix it shares with the winner of that match. A new string shares a known prefix with the
    last one put out; whoever shares more is smaller, and only on a tie are further bytes compared.
    """
    count = max(len(runs), 1)
    size = 1 << (count - 1).bit_length()
    text: list[bytes | None] = [b""] * size
    value: list[object] = [None] * size
    known = [0] * size  # prefix shared with the last string put out

    def advance(i: int) -> None:
        if i >= len(runs):
            text[i] = None
            return
        try:
            n, rest, value[i] = next(runs[i])
        except StopIteration:
            text[i] = None
            return
        text[i] = text[i][:n] + rest
        known[i] = n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), after which the loser's known prefix is with the winner's string."""
        if text[a] is None:
            return b, a
        if text[b] is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared(text[a], text[b], known[a])
        if text[a][n : n + 1] <= text[b][n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * size
    for i in range(size):
        advance(i)
        known[i] = 0
    nodes = [0] * size + list(range(size))
    for i in range(size - 1, 0, -1):
        nodes[i], losers[i] = play(nodes[2 * i], nodes[2 * i + 1])
    best = nodes[1] if size > 1 else 0
    while text[best] is not None:
        yield known[best], text[best], value[best]
        advance(best)
        i = (size + best) // 2
        while i >= 1:
            best, losers[i] = play(best, losers[i])
            i //= 2


def _suffix(gram: int, right: bytes, left: bytes) -> bytes:
    """What is sorted: the gram's hash, the bytes after it, and the bytes before it backwards.

    Lengths are part of it so that the parts can be told apart.
    """
    return gram.to_bytes(8, "big") + len(right).to_bytes(2, "big")[::-1] + right + left[::-1]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of two byte tables."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def covered_in_group(right: list[bytes], left: list[bytes], room: int) -> list[tuple[int, int, int]]:
    """(member, bytes to the left, bytes to the right of the gram) covered for members of one gram.

    Two members cover when what they share to the left and right makes up ``room``.
    Small groups compare all pairs; larger ones count the windows at each offset by hash, in blocks of offsets if there are many members.
    """
    n, out = len(right), []
    if n <= min(SMALL, 4):
        back = [x[::-1] for x in left]
        for a, b in itertools.combinations(range(n), 2):
            to_right = shared(right[a], right[b], 0)
            to_left = shared(back[a], back[b], 0)
            if to_right + to_left >= room:
                out += [(a, to_left, to_right), (b, to_left, to_right)]
        return out
    if n <= SMALL:
        r = np.zeros((n, room), np.uint8)
        l = np.zeros((n, room), np.uint8)
        for i in range(n):
            r[i, : len(right[i])] = np.frombuffer(right[i], np.uint8)
            l[i, : len(left[i])] = np.frombuffer(left[i][::-1], np.uint8)
        a, b = np.triu_indices(n, 1)
        sizes_r, sizes_l = np.array([len(x) for x in right]), np.array([len(x) for x in left])
        to_right = np.minimum(_common(r[a], r[b]), np.minimum(sizes_r[a], sizes_r[b]))
        to_left = np.minimum(_common(l[a], l[b]), np.minimum(sizes_l[a], sizes_l[b]))
        for i in np.flatnonzero(to_right + to_left >= room):
            out += [(int(a[i]), int(to_left[i]), int(to_right[i])), (int(b[i]), int(to_left[i]), int(to_right[i]))]
        return out
    data = np.frombuffer(b"".join(x.rjust(room, b"\0") + y.ljust(room, b"\0") for x, y in zip(left, right)), np.uint8).reshape(n, 2 * room)
    sums = Prefix.of_rows(data)
    sizes_r, sizes_l = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    # Windows of a block share their core; only members whose core repeats are opened.
    wide = room // 5 if n >= 128 else room
    for first in range(0, room + 1, wide + 1):
        last = min(first + wide, room)
        member = np.flatnonzero(np.maximum(first, room - sizes_r) <= np.minimum(last, sizes_l))
        core = Prefix.between(sums[member], np.array([room - first]), np.array([2 * room - last]))[:, 0]
        member = member[_repeated(core[:, None])[:, 0]]
        if not len(member):
            continue
        offsets = np.arange(first, last + 1)
        h = mix(Prefix.between(sums[member], room - offsets, 2 * room - offsets))
        whole = (sizes_l[member, None] >= offsets) & (sizes_r[member, None] >= room - offsets)
        # Windows that don't lie in the text get values of their own.
        h[~whole] = mix(np.arange(1, (~whole).sum() + 1, dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        # Neighbouring offsets of a member are one span.
        step = np.diff(np.pad(_repeated(h) & whole, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(step == 1)
        end = np.nonzero(step == -1)[1]
        out += [(int(m), first + int(b) - 1, room - first - int(a)) for m, a, b in zip(member[row], begin, end)]
    return out


def _repeated(h: np.ndarray) -> np.ndarray:
    """Whether a value occurs again in its column."""
    order = np.argsort(h, axis=0)
    ranked = np.take_along_axis(h, order, 0)
    same = np.zeros((len(h) + 1, h.shape[1]), bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(h.shape, bool)
    np.put_along_axis(out, order, same[1:] | same[:-1], 0)
    return out


def _matched(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Rows with their key's columns from ``counted`` (one row a key, ``n`` rows of ``rows`` at most each).

    Keys with more than a thousandth of all rows, a thousand at most, are broadcast; the others
    are joined by a shuffle in which none of them is large.
    """
    limit = max(total // 1000, 1)
    hot, rest = counted.where(F.col(n) > limit), counted.where(F.col(n) <= limit)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(rest, keys))


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, ranges: int | None = None, most: int = 4096, passage: int | None = None) -> DataFrame:
    """(doc_id, text_hash, first, last, long) of byte runs that repeat; runs may touch and overlap.

    text_hash tells rows apart that share an id; repeated rows share their spans. With ``passage``,
    at most ``window``, runs of that length count too; those of whole windows are the long ones, in texts that hold a window.
    """
    spark, room, least = docs.sparkSession, window - gram, passage or window
    rooms = sorted({least - gram, room})
    texts = whole_documents(docs).withColumn("text_hash", F.xxhash64("text"))

    def find(batches):
        release()
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc_id, text_hash, text in zip(batch["doc_id"].astype("Int64"), batch["text_hash"], batch["text"]):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) < least:
                    continue
                place, h, around = anchors(data, least, gram, room)
                for column, x in zip(out, (np.full(len(place), 0 if doc_id is pd.NA else doc_id), np.full(len(place), text_hash), place, h.astype(np.int64), around.astype(np.int64))):
                    column.append(x)
            if out[0]:
                yield pd.DataFrame(dict(zip(("doc_id", "text_hash", "place", "gram", "around"), map(np.concatenate, out))))

    # A null id counts as 0 here; text_hash and place still tell its rows apart.
    found = stage(texts.where(F.octet_length("text") >= least).mapInPandas(find, "doc_id long, text_hash long, place int, gram long, around long"), "anchors")
    total = found.count()
    files = files_for(total, 500_000)
    # Most grams occur once; they are counted alone, and only anchors with a repeated one travel.
    grams = stage(found.groupBy("gram").agg(F.count("*").alias("all")).where("all > 1"), "grams", files)
    found = stage(_matched(found, grams, ["gram"], "all", total).drop("all"), "repeated", files)
    classes = found.groupBy("gram", "around").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash", "place")).alias("one"))
    classes = stage(classes, "surroundings", files)
    kinds = classes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    known = stage(_matched(classes, kinds, ["gram"], "kinds", total), "kinds", files)
    suffixes = known.count()
    most = min(most, max(suffixes // 500, 256))
    # Every anchor with the same gram and surroundings elsewhere: all its windows repeat.
    settled = _matched(found, classes.where("times > 1").select("gram", "around", "times"), ["gram", "around"], "times", total)
    settled = settled.select("doc_id", "text_hash", (F.col("place") - room).alias("first"), (F.col("place") + window).alias("last"), F.lit(True).alias("long"))
    # One suffix for each different surrounding of a gram that has several.
    wanted = known.select("one.doc_id", "one.text_hash", F.struct(F.col("one.place").alias("place"), "gram", "times", (F.col("kinds") > most).alias("hot")).alias("s"))
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("suffixes"))

    def with_texts(rows: DataFrame) -> DataFrame:
        return texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).join(rows, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])

    own = with_texts(wanted)
    # Ranges are sized by what is sorted: each holds about RANGE_BYTES.
    parts = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes * 2 * room // RANGE_BYTES))

    def make_runs(batches):
        """Sorted, front-coded runs of the suffixes of a task, one row for each range; hot grams by window."""
        for batch in batches:
            rows: list[tuple[bytes, int, int, int, int]] = []
            for doc_id, text_hash, text, suffixes in zip(batch["doc_id"], batch["text_hash"], batch["text"], batch["suffixes"]):
                data = text.encode()
                for s in suffixes:
                    # Anchors have the smallest hashes of their windows; multiplied, these fill all ranges evenly.
                    place, g = s["place"], int(s["gram"]) * _ODD % (1 << 64)
                    right, left = data[place + gram : place + window], data[max(place - room, 0) : place]
                    rows.append((_suffix(g, right, left), int(doc_id), int(text_hash), place, int(s["times"])))
            rows.sort()
            cuts = np.searchsorted([r[0][0] << 24 | r[0][1] << 16 | r[0][2] << 8 | r[0][3] for r in rows], [(i << 32) // parts for i in range(parts + 1)]) if rows else []
            out = []
            for i in range(parts if rows else 0):
                run = rows[cuts[i] : cuts[i + 1]]
                if run:
                    coded = front_code([r[0] for r in run])
                    out.append({
                        "range": i, "shared": [c[0] for c in coded], "rest": b"".join(c[1] for c in coded), "sizes": [len(c[1]) for c in coded],
                        "ids": [r[1] for r in run], "hashes": [r[2] for r in run], "places": [r[3] for r in run], "times": [r[4] for r in run],
                    })
            yield pd.DataFrame(out, columns=["range", "shared", "rest", "sizes", "ids", "hashes", "places", "times"])

    def open_run(row) -> Iterator[tuple[int, bytes, object]]:
        at = 0
        for n, size, *value in zip(row["shared"], row["sizes"], row["ids"], row["hashes"], row["places"], row["times"]):
            yield int(n), row["rest"][at : at + size], tuple(map(int, value))
            at += size

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, bool]] = []
        group: list[tuple[bytes, bytes, tuple]] = []

        def close() -> None:
            if len(group) > 1 and any(g[2][3] == 1 for g in group):
                members = range(len(group))
                for size in rooms:
                    reach: dict[int, tuple[int, int]] = {}
                    found = covered_in_group([group[m][0][:size] for m in members], [group[m][1][max(len(group[m][1]) - size, 0) :] for m in members], size)
                    # All runs of a member hold its gram, so together they are one run.
                    for m, to_left, to_right in found:
                        before = reach.get(members[m], (0, 0))
                        reach[members[m]] = max(before[0], to_left), max(before[1], to_right)
                    for m, (to_left, to_right) in reach.items():
                        doc_id, text_hash, place, times = group[m][2]
                        if times == 1:  # the others are settled
                            out.append((doc_id, text_hash, place - to_left, place + gram + to_right, size == room))
                    members = sorted(reach)  # who shares no short run shares no long one
                    if not members:
                        break
            group.clear()

        for n, text, value in merge_runs([open_run(r) for r in frame.to_dict("records")]):
            # Eight shared bytes: the same gram as the suffix before.
            if n < 8:
                close()
            size = int.from_bytes(text[8:10], "little")
            group.append((text[10 : 10 + size], text[10 + size :][::-1], value))
        close()
        return pd.DataFrame(out, columns=["doc_id", "text_hash", "first", "last", "long"])

    # Blocks of windows: (bytes they take beside the gram, least and most of them on its left).
    blocks = np.array([(size, a, min(a + size // 5, size)) for size in rooms for a in range(0, size + 1, size // 5 + 1)]).T

    def opened(data: bytes, place: int) -> tuple[np.ndarray, int, int]:
        """The bytes around an anchor, and how many there are on the left and on the right of the gram."""
        left = min(place, room)
        piece = np.frombuffer(data[place - left : place + window], np.uint8)
        return piece, left, len(piece) - left - gram

    def hot_blocks(batches):
        """One row for each block of windows of each suffix of a hot gram: its core lies in all of them, its span holds all."""
        names = ["gram", "block", "core", "around", "doc_id", "text_hash", "place", "first", "last"]
        for batch in batches:
            out = []
            for doc_id, text_hash, text, suffixes in zip(batch["doc_id"], batch["text_hash"], batch["text"], batch["suffixes"]):
                data = text.encode()
                for s in suffixes:
                    place = s["place"]
                    piece, left, right = opened(data, place)
                    k = np.flatnonzero(np.maximum(blocks[1], blocks[0] - right) <= np.minimum(blocks[2], left))
                    size, a, b = blocks[:, k]
                    to_left, to_right = np.minimum(b, left), np.minimum(size - a, right)
                    sums = Prefix(piece)
                    core = sums.of(left - a, left + gram + size - b)
                    around = mix(sums.raw(left - to_left, left + gram + to_right) + to_left.astype(np.uint64) * np.uint64(1 << 20) + to_right.astype(np.uint64))
                    ids = (np.full(len(k), x, np.int64) for x in (doc_id, text_hash, place))
                    out.append((np.full(len(k), s["gram"], np.int64), k, core.astype(np.int64), around.astype(np.int64), *ids, place - to_left, place + gram + to_right))
            if out:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    def hot_windows(batches):
        """One row for each window of the open blocks; the hashes are of the gram, too."""
        names = ["block", "h1", "h2", "offset", "doc_id", "text_hash", "place"]
        for batch in batches:
            out, n = [], 0
            for doc_id, text_hash, text, suffixes in zip(batch["doc_id"], batch["text_hash"], batch["text"], batch["suffixes"]):
                data = text.encode()
                for s in suffixes:
                    place = s["place"]
                    piece, left, right = opened(data, place)
                    size, a, b = blocks[:, s["block"]]
                    offsets = np.arange(max(a, size - right), min(b, left) + 1)
                    # The second hash is of other values for the same bytes.
                    both = (Prefix(x).of(left - offsets, left + gram + size - offsets).astype(np.int64) for x in (piece, piece * np.uint8(167) + (piece >> 3) + np.uint8(91)))
                    ids = (np.full(len(offsets), x, np.int64) for x in (doc_id, text_hash, place))
                    out.append((np.full(len(offsets), s["block"]), *both, offsets, *ids))
                    n += len(offsets)
                    if n > 100_000:
                        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))
                        out, n = [], 0
            if out:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    normal = own.withColumn("suffixes", F.filter("suffixes", lambda s: ~s["hot"])).where(F.size("suffixes") > 0)
    hot = own.withColumn("suffixes", F.filter("suffixes", lambda s: s["hot"])).where(F.size("suffixes") > 0)
    runs = normal.mapInPandas(make_runs, "range int, shared array<int>, rest binary, sizes array<int>, ids array<long>, hashes array<long>, places array<int>, times array<long>")
    spans = "doc_id long, text_hash long, first int, last int, long boolean"
    merged = stage(runs.repartition(parts, "range").groupBy("range").applyInPandas(merge, spans), "merged")
    if known.where(F.col("kinds") > most).isEmpty():
        return settled.unionByName(merged)
    long = F.col("block").isin([int(k) for k in np.flatnonzero(blocks[0] == room)])
    block = ["gram", "block", "core"]
    parted = stage(hot.mapInPandas(hot_blocks, "gram long, block int, core long, around long, doc_id long, text_hash long, place int, first int, last int"), "blocks")
    total = parted.count()
    classes = stage(parted.groupBy(*block, "around").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash", "place")).alias("one")), "spans", files_for(total, 500_000))
    kinds = classes.groupBy(*block).agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = _matched(parted, classes.where("times > 1").drop("one"), [*block, "around"], "times", total)
    whole = whole.select("doc_id", "text_hash", "place", "first", "last", long.alias("long"))
    wanted = _matched(classes, kinds, block, "kinds", total).select("one.doc_id", "one.text_hash", F.struct(F.col("one.place").alias("place"), "block").alias("s"))
    wanted = with_texts(wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("suffixes")))
    windows = stage(wanted.mapInPandas(hot_windows, "block int, h1 long, h2 long, offset int, doc_id long, text_hash long, place int"), "windows")
    seen = ["block", "h1", "h2", "offset"]
    repeated = windows.groupBy(*seen).agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = F.element_at(F.array(*(F.lit(int(x)) for x in blocks[0])), F.col("block") + 1)
    first = F.col("place") - F.col("offset")
    single = _matched(windows, repeated, seen, "_n", windows.count())
    single = single.select("doc_id", "text_hash", "place", first.alias("first"), (first + gram + sizes).alias("last"), long.alias("long"))
    hot_spans = whole.unionByName(single).groupBy("doc_id", "text_hash", "place", "long").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("place")
    return settled.unionByName(merged).unionByName(hot_spans)


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal runs removed) of spans that may overlap and overhang."""
    kept, removed, runs, at = [], 0, 0, 0
    end = None  # of the run so far
    begin = 0
    for first, last in sorted((max(a, 0), min(b, len(data))) for a, b in spans):
        if end is None or first > end:
            if end is not None:
                kept.append(data[at:begin])
                removed, runs, at = removed + end - begin, runs + 1, end
            begin, end = first, last
        else:
            end = max(end, last)
    if end is not None:
        kept.append(data[at:begin])
        removed, runs, at = removed + end - begin, runs + 1, end
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def _with_spans(docs: DataFrame, window: int, gram: int, **more) -> tuple[DataFrame, str]:
    """The documents with an array column of spans (null: none) as the last one, and its name."""
    identity, digest, spans = (unused(n, docs.columns) for n in ("_id", "_hash", "_spans"))
    found = removed_spans(docs, window, gram, **more).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "long")).alias(spans))
    found = found.select(F.col("doc_id").alias(identity), F.col("text_hash").alias(digest), spans)
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col(identity)) & (F.xxhash64("text") == F.col(digest))
    return docs.join(found, on, "left").drop(identity, digest).select(*docs.columns, spans), spans


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    text is what remains, without characters of which a part goes; the digest is of the remaining bytes.
    Null texts count as empty; repeated rows are copies of each other, so the strings of long
    ones repeat and go. With ``passage``, a shorter length, n_passage_bytes and passage_text follow: the bytes
    that strings of that length cover, and the text without them.
    """
    joined, name = _with_spans(whole_documents(docs), window, gram, **({} if passage is None else {"passage": passage}))
    schema = SPANS if passage is None else f"{SPANS}, {PASSAGES}"
    columns = [c.split()[0] for c in schema.split(", ")][1:]

    def digest(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch[name]):
                data = text.encode()
                every = [] if spans is None else [(s["first"], s["last"], s["long"]) for s in spans]
                kept, removed, runs = cut(data, [x[:2] for x in every if x[2]] if len(data) >= window else [])
                row = (len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if removed else text)
                if passage is not None:
                    kept, removed, _ = cut(data, [x[:2] for x in every])
                    row += (removed, kept.decode(errors="ignore") if removed else text)
                out.append(row)
            frame = pd.DataFrame(out, columns=columns)
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(object))
            yield frame.astype({"doc_id": "Int64"})

    return joined.mapInPandas(digest, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, size_column: str | None = "n_chars") -> DataFrame:
    """The documents with the repeated bytes cut from their texts, with all their columns.

    A character of which a part goes, goes whole. ``size_column``, if there is one, gets the new length.
    """
    joined, _ = _with_spans(docs, window, gram)
    at, schema = docs.columns.index("text"), docs.schema
    names = docs.columns

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            texts = []
            for text, found in zip(batch.column(at).to_pylist(), spans):
                texts.append(cut(text.encode(), [(s["first"], s["last"]) for s in found])[0].decode(errors="ignore") if found else text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size_column in names:
                k = names.index(size_column)
                columns[k] = pa.array([c if f is None else len(t) for c, f, t in zip(columns[k].to_pylist(), spans, texts)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(clean, schema)
