"""Token counts, vector codes and bit-plane clusters against plain versions on small tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from oracle import compare, connect
from seqatlas.llm import bit_clusters, entries, token_counts, tokens, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, row string, _label string, code string"


# --- token counts --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")).tokenizer


def test_merge_counts_equal_the_library(library):
    rnd, count = random.Random(3), token_counts.MergeCounter(tokens.vocabulary("byte_bpe_50k.json"))
    stock = "the and ing tion est a b é ñ 漢 字 \x1c \x1f \x85 \xa0   ​ 😀 's 'LL 're 12 3 ½ ² <|endoftext|> <|endof ||> \n \t  .. , !".split(" ") + [" ", "  ", "\n\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(stock) for _ in range(rnd.randint(0, 12)))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_a_long_piece_without_breaks(library):
    rnd, count = random.Random(5), token_counts.MergeCounter(tokens.vocabulary("byte_bpe_50k.json"))
    for text in ("a" * 20_000, "".join(rnd.choice("etaoin") for _ in range(20_000)), " " * 5_000 + "x", "x " * 30_000):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_every_code_point_of_the_basic_plane_is_cut_as_by_the_library(library):
    count = token_counts.MergeCounter(tokens.vocabulary("byte_bpe_50k.json"))
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}  x" for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0)]
    for text, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert count(text) == len(ids.ids), repr(text)


def test_token_counts_of_a_table(spark, library):
    texts = [None, "", "   ", "plain words", "plain words", "ends <|endoftext|> inside", "é" * 300, "word " * 512, "word " * 513]
    rows = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(texts)] + [(4, "plain words", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, over_limit int").repartition(3)
    got = sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.MergeCounter(tokens.vocabulary("word_bpe_49k.json"))


# --- vectors -------------------------------------------------------------------------------------

def floors(vector, scale):
    return [math.floor(x * scale) for x in vector]


def plain_codes(rows, positions, entries_, rounds, scale):
    """(code, error, label error) by row and the codebooks, in plain Python; and how many parts moved."""
    kept = sorted(((i, v, l) for i, v, l in rows), key=lambda r: (r[0] is None, r[0] or 0, floors(r[1], scale)))
    whole = [floors(v, scale) for _, v, _ in kept]
    width = len(whole[0]) // positions
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for v in whole[:entries_]] for p in range(positions)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    moved, before = [], None
    for _ in range(rounds):
        at = [[near(v, p) for p in range(positions)] for v in whole]
        if before:
            moved.append(sum(a != b for x, y in zip(at, before) for a, b in zip(x, y)))
        before = at
        for p in range(positions):
            for e in range(len(books[p])):
                mine = [part(v, p) for v, a in zip(whole, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out, labels = [], {}
    for (i, _, label), v in zip(kept, whole):
        at = [near(v, p) for p in range(positions)]
        error = sum(far(part(v, p), books[p][at[p]]) for p in range(positions))
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in at), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, labels[l], digest) for i, c, e, l in out], moved


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    base = [rnd.uniform(-1, 1) for _ in range(64)]
    out = []
    for i in range(60):
        v = [round(rnd.gauss(0, 0.4), 2) for _ in range(64)] if i % 3 else base
        out.append((i, v, None if i % 5 == 0 else i % 2))
    out += [out[1], out[1], (None, base, 1), (None, out[4][1], None)]
    return out


BAD = [(900, None, 1), (901, [0.1] * 63 + [None], 1), (902, [0.1] * 63 + [float("nan")], 1), (903, [float("-inf")] + [0.1] * 63, None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("salts", [None, 1, 5])
def test_codes_equal_the_plain_version(spark, rows, salts):
    want, _ = plain_codes(rows, 4, 256, 4, 1024)
    got = vector_codes.coded_vectors(table(spark, rows + BAD), salts=salts)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_codes_with_few_entries_and_empty_ones(spark, rows):
    rows = [*rows[:40], *[(100 + i, [1e3 + i] * 64, 1) for i in range(3)]]
    want, _ = plain_codes(rows, 2, 7, 3, 16)
    got = vector_codes.coded_vectors(table(spark, rows), positions=2, entries=7, rounds=3, scale=16)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_only_changed_parts_migrate_and_owners_sum_where_members_are(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    _, moved = plain_codes(rows, 4, 16, 4, 1024)
    kept = table(spark, rows).select("vec_id", vector_codes.integers(F.col("embedding"), 1024).alias("whole")).withColumn("row", F.monotonically_increasing_id())
    kept = vector_codes.stage(kept, "test-vectors")
    first = np.array(vector_codes.first_vectors(kept, 16), np.int64).reshape(16, 4, 16).transpose(1, 0, 2).copy()
    cut = F.array(*[F.slice("whole", p * 16 + 1, 16) for p in range(4)])
    buckets, seen = vector_codes.Buckets(kept, 5), []
    try:
        vector_codes.fit_codes(kept.select("row", F.posexplode(cut).alias("position", "part")), first, 4, 3, buckets, seen)
        assert seen == moved and sum(moved) > 0
        plan = vector_codes.owner_sums([spark.table(buckets.names[0])], 16)._jdf.queryExecution().executedPlan().toString()
        # The only exchange carries one row per owner; it stands above the sums of members.
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("salt")
    finally:
        buckets.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("parts_")]


def test_codes_of_odd_tables(spark, rows):
    assert vector_codes.coded_vectors(table(spark, BAD)).count() == 0
    assert vector_codes.coded_vectors(table(spark, rows).limit(0)).count() == 0
    # Vectors of another length keep their row, without a code.
    got = {r.vec_id: r for r in vector_codes.coded_vectors(table(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 4, 1), (3, [], None)])).collect()}
    assert got[1].code == "00000000" and got[1].error == 0 and got[2].code is None and got[3].code is None
    assert {r.code for r in vector_codes.coded_vectors(table(spark, [(1, [0.5] * 6, 1)])).collect()} == {None}
    with pytest.raises(Exception, match="too large"):
        vector_codes.coded_vectors(table(spark, [(1, [1e9] * 8, 1)])).collect()


def plain_clusters(rows, k, rounds, scale):
    whole = [floors(v, scale) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest()))
    centroids = [list(whole[i]) for i in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        at = [near(v) for v in whole]
        for c in range(len(centroids)):
            mine = [v for v, a in zip(whole, at) if a == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    at = [near(v) for v in whole]
    apart = [far(v, centroids[a]) for v, a in zip(whole, at)]
    inertia = [sum(d for d, a in zip(apart, at) if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(r[0], a, d, inertia[a], sum(apart), digest[a]) for r, a, d in zip(rows, at, apart)]


@pytest.mark.parametrize("k, rounds, scale", [(16, 3, 64), (3, 5, 64), (100, 2, 1), (16, 3, 5000)])
def test_clusters_equal_the_plain_version(spark, rows, k, rounds, scale):
    want = plain_clusters(rows, k, rounds, scale)
    got = bit_clusters.cluster_vectors(table(spark, [*rows, *BAD, (904, [0.5] * 63, 1), (905, [], 1)]), k, rounds, scale)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_clusters_of_nothing(spark, rows):
    assert bit_clusters.cluster_vectors(table(spark, BAD)).count() == 0
    assert bit_clusters.cluster_vectors(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("low, high", [(-1, 0), (0, 1), (-64, 63), (-65, 64), (-(1 << 25), 1 << 25)])
def test_bit_planes_give_exact_products(low, high):
    rng = np.random.default_rng(1)
    a, b = rng.integers(low, high, (9, 64), endpoint=True), rng.integers(low, high, (4, 64), endpoint=True)
    a[0], a[1] = low, high
    planes = max(high.bit_length(), (~low).bit_length()) + 1
    x, y = bit_clusters.pack(a, planes), bit_clusters.pack(b, planes)
    assert (bit_clusters.unpack(x) == a).all()
    assert (bit_clusters.products(x, y) == a @ b.T).all() and (bit_clusters.squares(x) == (a * a).sum(1)).all()


@pytest.mark.parametrize("name", ["op12_resident_codes", "op13_bit_plane_clusters"])
def test_queries_equal_their_sql(spark, name):
    assert compare(entries.QUERIES[name](spark, SF), entries.ORACLE[name], connect(SF)) is None


def test_counts_of_the_whole_table_equal_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entries.QUERIES["op11_merge_counts"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for doc_id, encoded in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False)):
        assert got[doc_id].n_tokens == len(encoded.ids) and got[doc_id].over_limit == (len(encoded.ids) > 512)
