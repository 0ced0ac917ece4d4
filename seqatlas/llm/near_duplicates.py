"""Near-duplicate documents by improved consistent weighted sampling.

A document is its multiset of five-word shingles (a shorter one: all its words), weighted by
term frequency times inverse document frequency. Consistent weighted samples of the shingles
are grouped into bands; documents that share a band are candidates, and a pair counts when the
weighted Jaccard similarity of the whole documents reaches the threshold.

Equal texts are one class throughout: one member stands for all, and no pair of copies is ever
made. In each bucket of a band, members are first compared with the bucket's center, then, while
a bucket holds several components, with the centers of small random parts of it. What these have
not linked is compared exactly: documents outside the largest component of a bucket with those of
other components that share a band and one of their rarest shingles (the prefix filter of
set-similarity joins), at places where enough weight is left to reach the threshold. Pairs that
can't be similar enough, such as documents that have only a common passage in common, never meet.

Document frequencies are counted over all documents in ``2**18`` buckets of shingle hashes, a
table of fixed size. A frequency under ``common`` (a share of the corpus) counts as ``common``:
rarer shingles are all as telling as each other, which keeps the weights independent of corpus size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqatlas.llm.common import files_for, mix, process_cache, release, shingle_table, slices, stage, unused, whole_documents

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 2
BUCKETS = 1 << 18
#: Rounds of random parts of buckets, and how many members a part has on average.
STARS, STAR_SIZE = 1, 16


def document_frequencies(texts: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """How many documents have a shingle in each hash bucket, and how many documents there are.

    Each task counts its own documents and sends its table in 64 parts, compressed; equal parts are summed
    in tasks, and the sum has ``BUCKETS`` numbers whatever the input.
    """
    part = BUCKETS // 64

    def count(batches):
        release()
        table, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            documents += len(batch)
            for _, run in slices(batch["text"]):
                text, shingle = shingle_table(run, width)
                at = np.unique(text * BUCKETS + (shingle & np.uint64(BUCKETS - 1)).astype(np.int64)) % BUCKETS
                table += np.bincount(at, minlength=BUCKETS)
        if documents:
            yield pd.DataFrame({"part": range(64), "counts": [zlib.compress(table[i * part : (i + 1) * part].tobytes(), 1) for i in range(64)], "documents": [documents] + [0] * 63})

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for i, data, n in zip(batch["part"], batch["counts"], batch["documents"]):
                have = sums.setdefault(i, [np.zeros(part, np.int64), 0])
                have[0] += np.frombuffer(zlib.decompress(data), np.int64)
                have[1] += n
        yield pd.DataFrame({"part": list(sums), "counts": [zlib.compress(x[0].tobytes(), 1) for x in sums.values()], "documents": [x[1] for x in sums.values()]})

    schema = "part int, counts binary, documents long"
    rows = texts.select("text").mapInPandas(count, schema).repartition("part").mapInPandas(add, schema).collect()
    table, documents = np.zeros(BUCKETS, np.int64), 0
    for row in rows:
        table[row["part"] * part : (row["part"] + 1) * part] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        documents += row["documents"]
    return table, documents


def inverse_frequencies(table: np.ndarray, documents: int, common: float = 0.1) -> np.ndarray:
    """ln(1 + N / max(df, common * N)) of every bucket."""
    return np.log1p(1 / np.maximum(table / max(documents, 1), common)).astype(np.float32)


def weighted_shingles(run: list[bytes], idf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of the distinct shingles of each text, in rising order."""
    text, shingle = shingle_table(run, width)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(first)
    repeats = np.diff(np.concatenate((at, [len(text)])))
    text, shingle = text[at], shingle[at]
    return text, shingle, repeats * idf[(shingle & np.uint64(BUCKETS - 1)).astype(np.int64)]


def _gamma_table() -> np.ndarray:
    """65,536 quantiles of Gamma(2, 1), from its distribution 1 - (1 + x) exp(-x) by bisection."""
    cache = process_cache()
    if "gamma" not in cache:
        goal = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
        for _ in range(60):
            middle = (low + high) / 2
            below = 1 - (1 + middle) * np.exp(-middle) < goal
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        cache["gamma"] = low.astype(np.float32)
    return cache["gamma"]


def samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, hashes: int = BANDS * ROWS) -> np.ndarray:
    """One 64-bit value per text and hash function, the same for two texts with a probability of
    their weighted Jaccard similarity. Texts without shingles have 0 in every column.

    For each shingle and hash function: r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the hash,
    t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y e^r); the shingle of the smallest a
    is drawn, together with its t.
    """
    out = np.zeros((texts, hashes), np.uint64)
    if not len(text):
        return out
    gamma, log_w = _gamma_table(), np.log(weight).astype(np.float32)
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    owners, group = text[starts], np.cumsum(np.concatenate(([0], (text[1:] != text[:-1]).astype(np.int64))))
    low16, third = np.uint64(0xFFFF), np.float32(1 / (1 << 16))
    for k in range(hashes):
        h = mix(shingle ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = gamma[(h & low16).astype(np.int64)]
        b = ((h >> np.uint64(16)) & low16).astype(np.float32) * third
        # ln c by two uniform numbers: c = -ln(u v).
        u = ((h >> np.uint64(32)) & low16).astype(np.float32) + np.float32(0.5)
        v = (h >> np.uint64(48)).astype(np.float32) + np.float32(0.5)
        c = -np.log(u * v * np.float32(2.0**-32))
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b) - r
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == least[group])
        # Equal values go to the smallest shingle, which is the first.
        owner, first = np.unique(group[hit], return_index=True)
        drawn = hit[first]
        out[owners[owner], k] = mix(shingle[drawn] * np.uint64(31) + t[drawn].astype(np.int64).astype(np.uint64) + np.uint64(k))
    return out


def band_rows(texts: DataFrame, idf, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of (doc_id, text): the md5 of its text, its number of shingles and its band hashes."""

    def run(batches):
        import hashlib

        release()
        for batch in batches:
            ids, texts_ = batch["doc_id"].astype("Int64"), batch["text"].tolist()
            bands_out, digests, sizes = [], [], []
            for _, part in slices(texts_, 1 << 20):
                text, shingle, weight = weighted_shingles(part, idf.value, width)
                drawn = samples(text, shingle, weight, len(part), bands * rows)
                joined = np.zeros((len(part), bands), np.uint64)
                for j in range(rows):
                    joined = mix(joined * np.uint64(1099511628211) + drawn[:, j::rows])
                bands_out += list(joined.astype(np.int64))
                sizes += np.bincount(text, minlength=len(part)).tolist()
                digests += [hashlib.md5(d).hexdigest() for d in part]
            yield pd.DataFrame({"doc_id": ids, "key": digests, "n_shingles": sizes, "bands": bands_out})

    return texts.mapInPandas(run, "doc_id long, key string, n_shingles long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, idf, width: int = WIDTH) -> DataFrame:
    """Weighted Jaccard similarity of pairs (a, b) of keys of whole texts (key, text): a, b, similarity.

    Pairs are joined with the texts of both sides; a side that is in many pairs is split by
    adaptive skew joins, as all joins here are plain equi-joins.
    """
    left = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        release()
        for batch in batches:
            found = np.zeros(len(batch))
            for first, part in _pairs_of(batch):
                text, shingle, weight = weighted_shingles(part, idf.value, width)
                pair = text // 2
                order = np.lexsort((shingle, pair))
                pair, shingle, weight = pair[order], shingle[order], weight[order].astype(np.float64)
                twice = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
                n = len(part) // 2
                shared = np.bincount(pair[twice], np.minimum(weight[twice], weight[twice + 1]), n)
                total = np.bincount(pair, weight, n)
                found[first : first + n] = shared / np.maximum(total - shared, 1e-12)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": found})

    return both.mapInPandas(run, "a string, b string, similarity double")


def _pairs_of(batch: pd.DataFrame, size: int = 1 << 20):
    """Runs of whole pairs of about ``size`` bytes: place of the first, texts a, b, a, b ..."""
    first, part, total = 0, [], 0
    for i, (a, b) in enumerate(zip(batch["text_a"], batch["text_b"])):
        a, b = a.encode(), b.encode()
        if part and total + len(a) + len(b) > size:
            yield first, part
            first, part, total = i, [], 0
        part += (a, b)
        total += len(a) + len(b)
    if part:
        yield first, part


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): the smallest node reachable.

    Each round every node takes the smallest label among itself and its neighbours, and then
    the label of its label; labels are written to the shared folder, so the plan stays short.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges", files)
    labels = stage(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("component")), "labels", files)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_near"))
        hop = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", "_near").alias("_to"), F.col("component").alias("_was"))
        names = labels.select(F.col("node").alias("_node"), F.col("component").alias("_of"))
        new = hop.join(names, F.col("_to") == F.col("_node"), "left").select("node", F.least("_to", "_of").alias("component"), "_was")
        new = stage(new, "labels", files)
        if new.where("component < _was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _open_buckets(members: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """The members of buckets that hold several components, with their component.

    They have the number of members of the bucket (``_n``) and ``inner``: outside the bucket's largest component.
    """
    linked = components(links, files)
    sizes = linked.groupBy("component").agg(F.count("*").alias("_size"))
    placed = members.join(linked.join(sizes, "component"), F.col("key") == F.col("node"), "left")
    placed = placed.select("band", "hash", "key", "_order", "center", F.coalesce("component", "key").alias("component"), F.coalesce("_size", F.lit(1)).alias("_size"))
    placed = stage(placed, "placed", files)
    largest = F.max(F.struct("_size", "component"))["component"].alias("_largest")
    apart = placed.groupBy("band", "hash").agg(F.count("*").alias("_n"), F.min("component").alias("_low"), F.max("component").alias("_high"), largest)
    apart = apart.where("_low <> _high").drop("_low", "_high")
    return placed.join(apart, ["band", "hash"]).withColumn("inner", F.col("component") != F.col("_largest")).drop("_largest", "_size")


def prefixes(texts: DataFrame, idf, table, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The rarest shingles of each whole text (key, text): key, token, before, total.

    Shingles are taken in one order for all texts, by document frequency of their hash bucket and then by
    hash. before: weight of the shingles ahead of this one; total: weight of all. Those with at most
    (1 - threshold) of the weight ahead of them are returned: texts that share none of them share less
    than the threshold.
    """

    def run(batches):
        release()
        for batch in batches:
            for first, part in slices(batch["text"], 1 << 20):
                text, shingle, weight = weighted_shingles(part, idf.value, width)
                order = np.lexsort((shingle, table.value[(shingle & np.uint64(BUCKETS - 1)).astype(np.int64)], text))
                text, shingle, weight = text[order], shingle[order], weight[order].astype(np.float64)
                total = np.bincount(text, weight, len(part))[text]
                ahead = np.cumsum(weight) - weight
                starts = np.concatenate(([True], text[1:] != text[:-1]))[: len(text)]
                ahead -= ahead[starts][np.cumsum(starts) - 1]
                kept = ahead <= (1 - threshold) * total * (1 + 1e-6)
                yield pd.DataFrame({"key": batch["key"].to_numpy()[first + text[kept]], "token": shingle[kept].astype(np.int64), "before": ahead[kept], "total": total[kept]})

    return texts.select("key", "text").mapInPandas(run, "key string, token long, before double, total double")


def _prefix_pairs(open_: DataFrame, classes: DataFrame, reps: DataFrame, idf, table, threshold: float, width: int, files: int | None = None) -> DataFrame:
    """Pairs (x, y, component, _of) of members of different components that may still be similar enough.

    x is outside the largest component of one of its buckets. The first shingle that two texts share must leave
    both enough weight; every row that is no first one is only an additional chance. Rows on the way
    carry 64-bit hashes of keys and components.
    """
    keys = open_.groupBy("key").agg(F.max("inner").alias("inner"), F.first("component").alias("component"))
    keys = stage(keys.join(classes.select("key", "bands"), "key").withColumn("id", F.xxhash64("key")), "open", files)
    tokens = prefixes(reps.join(keys.select("key"), "key", "left_semi"), idf, table, threshold, width)
    tokens = tokens.join(keys.select("key", "id", "inner", F.xxhash64("component").alias("of")), "key").drop("key")
    tokens = stage(tokens, "tokens", files)
    # Only shingles of several components, at least one of them outside the largest, can link anything.
    of_token = tokens.groupBy("token").agg(F.min("of").alias("_low"), F.max("of").alias("_high"), F.max("inner").alias("_any"))
    tokens = tokens.join(of_token.where("_low <> _high and _any").select("token"), "token")
    other = tokens.select("token", F.col("id").alias("_id"), F.col("inner").alias("_inner"), F.col("of").alias("_of"), F.col("before").alias("_before"), F.col("total").alias("_total"))
    left = F.least(F.col("total") - F.col("before"), F.col("_total") - F.col("_before"))
    enough = left * (1 + 1e-6) >= threshold * (F.col("total") + F.col("_total") - left)
    met = (F.col("of") != F.col("_of")) & (~F.col("_inner") | (F.col("id") < F.col("_id"))) & enough
    found = tokens.where("inner").join(other, "token").where(met).select("id", "_id").distinct()
    there = keys.select(F.col("id").alias("_id"), F.col("key").alias("y"), F.col("component").alias("_of"), F.col("bands").alias("_bands"))
    here = keys.select("id", F.col("key").alias("x"), "component", "bands")
    return found.join(here, "id").join(there, "_id").where(F.arrays_overlap("bands", "_bands")).select("x", "y", "component", "_of")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, common: float = 0.1) -> DataFrame:
    """One row per document: doc_id, class_id, cluster_id, n_shingles, best_similarity, key, keeps.

    class_id: the smallest doc_id with an equal text. cluster_id: the smallest doc_id that
    verified links lead to. best_similarity: the largest verified similarity between the class
    and another class (null if none). key: md5 of the text; keeps: the key of the row with the
    cluster's smallest doc_id. Texts without words, null ones too (null counts as empty), are
    only ever linked to equal ones. Null ids count after all others; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    texts = whole_documents(docs)
    table, n = document_frequencies(texts, width)
    # Every table below has about as many rows as there are documents, or fewer.
    files = files_for(n, 5_000)
    idf = spark.sparkContext.broadcast(inverse_frequencies(table, n, common))
    rows = stage(band_rows(texts, idf, width), "bands", files)
    classes = stage(rows.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.max("n_shingles").alias("n_shingles")), "classes", files)
    keys = classes.where("n_shingles > 0").select("key", F.posexplode("bands").alias("band", "hash"))
    # Buckets with more than one class. A text that others were copied from shares more bands with
    # them than they do among each other, so members are compared with those of the largest buckets.
    sizes = keys.groupBy("band", "hash").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = stage(keys.join(sizes, ["band", "hash"]), "shared", files)
    degree = stage(shared.groupBy("key").agg(F.sum("_n").alias("degree")), "degrees", files)
    ranked = shared.select("band", "hash", "key").join(degree, "key").withColumn("_order", F.struct(F.col("degree").alias("d"), F.col("key").alias("k")))
    buckets = ranked.groupBy("band", "hash").agg(F.max("_order").alias("_center"))
    members = ranked.join(buckets, ["band", "hash"]).select("band", "hash", "key", "_order", F.col("_center.k").alias("center"), "_center")
    members = stage(members, "members", files)
    candidates = members.select("key").distinct()
    reps = stage(texts.select(F.md5("text").alias("key"), "text").join(candidates, "key").groupBy("key").agg(F.first("text").alias("text")), "candidates", files)
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]

    def verify(pairs: DataFrame) -> DataFrame:
        return stage(similarities(pairs, reps, idf, width), "similar", files)

    # First each member with the foremost center of its buckets, which is the same one for most of a group.
    first = members.groupBy("key").agg(F.max("_center")["k"].alias("y")).withColumnRenamed("key", "x").where("x <> y")
    tested = verify(first.select(*pair).distinct())
    for step in ("center", *range(STARS), "rest"):
        open_ = _open_buckets(members, tested.where(F.col("similarity") >= threshold), files)
        if step == "rest":
            pairs = _prefix_pairs(open_, classes, reps, idf, spark.sparkContext.broadcast(table), threshold, width, files)
        elif step == "center":
            pairs = open_.select(F.col("key").alias("x"), F.col("center").alias("y"), "component", F.lit("").alias("_of"))
        else:
            # Parts of about STAR_SIZE members, dealt anew each time; the most central member of each is its center.
            part = F.pmod(F.xxhash64("key", F.lit(step)), F.ceil(F.col("_n") / STAR_SIZE))
            dealt = open_.withColumn("_part", part)
            centers = dealt.groupBy("band", "hash", "_part").agg(F.max(F.struct(F.col("_order"), F.col("component").alias("c"))).alias("_s"))
            pairs = dealt.join(centers, ["band", "hash", "_part"]).select(F.col("key").alias("x"), F.col("_s._order.k").alias("y"), "component", F.col("_s.c").alias("_of"))
        pairs = pairs.where("x <> y and component <> _of").select(*pair).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = tested.unionByName(verify(pairs))
    close = tested.where(F.col("similarity") >= threshold)
    linked = components(close, files)
    best = close.select("a", "similarity").union(close.select("b", "similarity")).groupBy("a").agg(F.max("similarity").alias("best_similarity"))
    of_class = classes.select("key", "class_id").join(linked, F.col("key") == F.col("node"), "left").join(best, F.col("key") == F.col("a"), "left")
    of_class = stage(of_class.select("key", "class_id", F.coalesce("component", "key").alias("component"), "best_similarity"), "classes", files)
    first_row = F.min(F.struct(F.col("class_id").isNull().alias("n"), F.col("class_id").alias("c"), F.col("key").alias("k")))
    clusters = of_class.groupBy("component").agg(first_row.alias("_f")).select("component", F.col("_f.c").alias("cluster_id"), F.col("_f.k").alias("keeps"))
    of_class = of_class.join(clusters, "component").select("key", "class_id", "cluster_id", "best_similarity", "keeps")
    found = rows.select("doc_id", "key", "n_shingles").join(of_class, "key")
    return found.select("doc_id", "class_id", "cluster_id", "n_shingles", "best_similarity", "key", "keeps")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One document of each cluster, that with the smallest doc_id, with all its columns; of repeated rows one stays."""
    identity, key = (unused(n, docs.columns) for n in ("_id", "_key"))
    found = near_duplicates(docs, threshold, width)
    kept = found.where("key = keeps and doc_id <=> cluster_id").select(F.col("doc_id").alias(identity), F.col("key").alias(key)).distinct()
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(identity)) & (digest == F.col(key)), "left_semi")
    # Copies that share the id as well: any one of them.
    return rows.withColumn(key, digest).dropDuplicates(["doc_id", key]).drop(key)
