"""Every operator of the subpackage against a plain brute-force version on small tables."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF
from seqatlas.llm import (
    common, decontaminate, entries, fingerprint, html_text, language, licenses, near_duplicates, packing, suffix_dedup, tokens, tool_calls, wavelet,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _words string, sequence_id long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sentence(rnd, n, stock="alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rnd.choice(stock) + rnd.choice(["", "", "x", "yz"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, exact and near copies, ties and repeated rows."""
    rnd = random.Random(4)
    base = sentence(rnd, 150)
    near = base.replace(" ", "  ", 1) + " more words here"
    texts = [base, base, near, None, "", "", "   ", "word", "1234 !!", "Élan — ça\nva\n\nbien\t½²", sentence(rnd, 60) + "\n" + sentence(rnd, 60)]
    texts += [sentence(rnd, rnd.randint(1, 120)) for _ in range(15)]
    texts += ["All rights reserved. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", sentence(rnd, 5000)]
    out = [(i, t, "en" if i % 2 else None, "s", 0, "clash", 7) for i, t in enumerate(texts)]
    out.append(out[0])
    out.append((3, "another text with the same id", "en", "s", 0, "clash", 7))
    out.append((None, "a text without an id, twice", None, None, None, None, None))
    out.append((None, "a text without an id, twice", None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


# --- packing -------------------------------------------------------------------------------------

def test_pieces_are_the_tokens_of_whole_texts(docs, rows):
    tok = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    packed = packing.pack_documents(docs, keep_ids=True)
    got = packed.collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = tok.plain(text or "") + bytes(4)
        for k in range(0, len(ids), 8192):
            want[doc_id, k // 8192, k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {s: len(i) for s, i in whole.items()} == {s: sum(n for _, n in p) for s, p in by.items()}


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_piece_once_and_well(seed):
    rng = np.random.default_rng(seed)
    size = 128
    histogram = np.zeros(size + 1, np.int64)
    n = [0, 1, 40, 3000, 3000, 20000][seed]
    np.add.at(histogram, np.minimum(rng.geometric(0.03, n), size), 1)
    plan = packing.plan_packing(histogram)
    used = defaultdict(list)
    for length in range(1, size + 1):
        k = int(histogram[length])
        if k:
            sequence, offset = plan.place(np.full(k, length), np.arange(k))
            for s, o in zip(sequence, offset):
                used[s].append((o, length))
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= size
    least = int(np.ceil((histogram * np.arange(size + 1)).sum() / size))
    assert least <= plan.sequences <= least * 1.01 + 1


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("kind, file", [(tokens.WordEncoder, "word_bpe_49k.json"), (tokens.ByteEncoder, "byte_bpe_50k.json")])
def test_cached_pieces_equal_the_library(kind, file):
    rnd, encode = random.Random(1), kind(tokens.vocabulary(file))
    for _ in range(1500):
        text = "".join(rnd.choice("ab .,\n\t İßſΣ'sté́1²_ \xa0  ") for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "<|endoftext|>", " 's"])
        assert encode(text) == encode.plain(text), text


def test_a_small_cache_forgets_nothing_it_needs():
    made = tokens.Recent(lambda k: k * 2, 3)
    assert [made[k] for k in "abcdeabcde"] == [k * 2 for k in "abcdeabcde"]


# --- fingerprints --------------------------------------------------------------------------------

def test_fingerprints_and_edited_texts(docs, rows):
    got = sorted((tuple(r) for r in fingerprint.neighbour_fingerprints(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert Counter(r[:3] for r in got) == Counter(want)
    prints = defaultdict(set)
    for (doc_id, text, *_), in zip(rows):
        prints[text or ""].add(fingerprint.encode(*(x[0] for x in fingerprint.vectors([text]))))
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert {r[3] for r in got} == {next(iter(p)) for p in prints.values()}
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got)


def test_fingerprints_are_homomorphic():
    of = lambda t: fingerprint.encode(*(x[0] for x in fingerprint.vectors([t])))
    assert of("one two\nthree\nfour five six") == of("four five six\none two\nthree")
    assert fingerprint.changed(of("a b\nc d"), ["new line"]) == of("a b\nc d\nnew line")
    assert fingerprint.changed(of("a b\nc d"), ["x"], ["c d"]) == of("x\na b")


def test_likeness_follows_shared_text():
    rnd = random.Random(0)
    a, b = sentence(rnd, 400), sentence(rnd, 400)
    wide, small = fingerprint.vectors([a, a[: len(a) // 2] + b[: len(b) // 2], b])
    near = lambda i, j: float(fingerprint.likeness(wide[i : i + 1], small[i : i + 1], wide[j : j + 1], small[j : j + 1])[0])
    assert near(0, 0) == 1 and near(0, 1) > near(0, 2) and 0.3 < near(0, 1) < 0.9


def test_fingerprints_of_one_and_no_document(spark, none):
    one = spark.createDataFrame([(1, "abcdef", None, None, 0, None, 0)], DOCS)
    row = fingerprint.neighbour_fingerprints(one).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1
    assert fingerprint.neighbour_fingerprints(none).count() == 0 and fingerprint.fingerprints(none).count() == 0


# --- language ------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.label_documents(table).collect()}
    truth = {r.doc_id: (r.lang, r.text) for r in table.collect()}
    assert set(got) == set(truth)
    for doc_id, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not language.has_letter(truth[doc_id][1]))
    tested = [d for d in got if got[d].held_out and truth[d][0] and got[d].lang_pred != "und"]
    assert np.mean([got[d].lang_pred == truth[d][0] for d in tested]) > 0.95


def test_language_defaults(docs, none, rows):
    got = language.label_documents(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 6, 8)) and by[7].lang_pred == "en"
    assert language.label_documents(none).count() == 0
    kept = language.reject_unidentified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (4, 5, 6, 8)").count() == 0


def test_language_sample_ignores_copies(spark):
    rnd = random.Random(8)
    different = [f"ein anderer Satz Nummer {i} mit {sentence(rnd, 5)}" for i in range(200)]
    many = [sentence(rnd, 8) + f" number {i}" for i in range(1000)]
    labelled = [("immer derselbe Text", "de")] * 20000 + [(t, "de") for t in different] + [(t, "en") for t in many]
    labelled += [(f"{i} !!", "fr") for i in range(900)] + [("une phrase", "fr"), (None, "fr"), ("no language", None)]
    table = spark.createDataFrame(labelled, "text string, lang string").repartition(5)
    got = defaultdict(list)
    for r in language.training_sample(table).collect():
        got[r.lang].append(r.text)
    assert sorted(got["de"]) == sorted([*different, "immer derselbe Text"]) and got["fr"] == ["une phrase"]
    hashes = {r.text: r.h for r in table.where("lang = 'en'").selectExpr("text", "xxhash64(text) AS h").collect()}
    assert sorted(got["en"]) == sorted(sorted(hashes, key=hashes.get)[:400])
    assert language.train(table).languages == ["de", "en", "fr"]
    assert language.training_sample(table, 3).groupBy("lang").count().where("count > 3").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n and (n < 2 or not (abs(code.sum(0)) == n).any())


def test_language_decoding_by_plain_loops(spark):
    """The whole query: each text's margins, losses and score, bit by bit and codeword by codeword."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(table.where(~language.held_out()))
    got = {r.doc_id: r for r in language.label_documents(table).collect()}
    for r in table.limit(120).collect():
        if not language.has_letter(r.text):
            continue
        x = language.features(r.text)
        losses = []
        for word in model.code:
            loss = 0.0
            for bit, sign in enumerate(word):
                margin = float(x @ model.weights[:, bit]) + float(model.bias[bit])
                loss += math.log1p(math.exp(-margin * sign)) * float(model.trust[bit])
            losses.append(loss)
        best = min(range(len(losses)), key=losses.__getitem__)
        score = math.exp(-4 * losses[best]) / sum(math.exp(-4 * v) for v in losses)
        assert got[r.doc_id].lang_pred == model.languages[best]
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-4) and got[r.doc_id].ambiguous == (got[r.doc_id].score < 0.5)


# --- near duplicates -----------------------------------------------------------------------------

def weighted(texts, docs_of, common=0.1):
    """Shingle weights of each text by the definition, with hashed document frequencies."""
    tables = {}
    for t in texts:
        text, shingle = common_shingles(t)
        tables[t] = Counter(shingle.tolist())
    frequency = Counter()
    for t, times in docs_of.items():
        for b in {s % near_duplicates.BUCKETS for s in tables[t]}:
            frequency[b] += times
    n = sum(docs_of.values())
    idf = lambda s: np.log1p(1 / max(frequency[s % near_duplicates.BUCKETS] / n, common))
    return {t: {s: k * idf(s) for s, k in c.items()} for t, c in tables.items()}


def common_shingles(text):
    return common.shingle_table([text.encode()], 5)


def test_shingles_by_definition():
    run = [b"A b c d e f", b"", b"one two", b"a b c d e", b"x", b"f a b c d e"]
    text, shingle = common.shingle_table(run, 5)
    assert text.tolist() == [0, 0, 2, 3, 4, 5, 5]
    assert shingle[0] == shingle[3] == shingle[6] and len(set(shingle.tolist())) == 5


def test_clusters_are_the_components_of_similar_pairs(spark):
    rnd = random.Random(8)
    rows, n = [], 0
    for group in range(25):
        base = sentence(rnd, rnd.randint(60, 200)).split()
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = f"edit{rnd.randint(0, 10**9)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "one"), (None, "one"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.near_duplicates(df).collect()
    assert len(got) == len(rows)
    texts = sorted({t or "" for _, t in rows})
    of = weighted(texts, Counter(t or "" for _, t in rows))
    label = {t: t for t in texts}

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            shared = sum(min(w, of[b].get(s, 0)) for s, w in of[a].items())
            total = sum(of[a].values()) + sum(of[b].values()) - shared
            if total and shared / total >= 0.8 + 1e-6:
                label[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for d, t in rows:
        if d is not None:
            r = root(t or "")
            least[r] = d if least[r] is None else min(least[r], d)
    text_of = {}
    for d, t in rows:
        text_of.setdefault(d, t or "")
    for r in got:
        assert r.cluster_id == least[root(text_of[r.doc_id])], r
    kept = near_duplicates.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len({root(t) for t in texts})


def test_near_copies_of_a_group_of_a_third(spark):
    rnd = random.Random(12)
    text = lambda n: [f"w{rnd.randint(0, 10**9)}" for _ in range(n)]
    hot, rare = text(200), text(200)
    edited = [hot + text(20), hot + text(35), rare, rare + text(35)]  # plain Jaccard 196 / (196 + 20) = 0.91 or 196 / (196 + 35) = 0.85
    rows = [hot] * 100 + edited + [text(40) for _ in range(196)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.cluster_id for r in near_duplicates.near_duplicates(df).collect()}
    assert [got[i] for i in (0, 99, 100, 101, 102, 103)] == [0, 0, 0, 101, 102, 102]


def test_similar_texts_share_a_prefix_shingle_with_enough_weight_left(spark):
    rnd = random.Random(21)
    passage = sentence(rnd, 60).split()
    texts = ["", "one two", "\u00e9t\u00e9 " * 40]
    for _ in range(40):
        copy = passage + sentence(rnd, rnd.choice([1, 2, 4, 60])).split()
        copy[rnd.randrange(len(copy))] = f"edit{rnd.randint(0, 10**9)}"
        texts.append(" ".join(copy))
    table = np.random.default_rng(3).integers(1, 50, near_duplicates.BUCKETS)
    idf = near_duplicates.inverse_frequencies(table, 100)
    sc = spark.sparkContext
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    got = defaultdict(dict)
    for r in near_duplicates.prefixes(df, sc.broadcast(idf), sc.broadcast(table)).collect():
        got[int(r.key)][r.token] = (r.before, r.total)
    text, shingle, weight = near_duplicates.weighted_shingles([t.encode() for t in texts], idf)
    of = defaultdict(dict)
    for t, h, w in zip(text.tolist(), shingle.tolist(), weight.tolist()):
        of[t][h] = w
    similar = 0
    for a in range(len(texts)):
        for b in range(a):
            shared = sum(min(w, of[b].get(h, 0)) for h, w in of[a].items())
            total = sum(of[a].values()) + sum(of[b].values()) - shared
            if not total or shared / total < 0.8:
                continue
            similar += 1
            left = [(min(got[a][k][1] - got[a][k][0], got[b][k][1] - got[b][k][0]), got[a][k][1] + got[b][k][1]) for k in got[a].keys() & got[b].keys()]
            assert any(x * (1 + 1e-6) >= 0.8 * (both - x) for x, both in left), (a, b)
    assert similar > 10 and not got[0]


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    shingle = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    wa, wb = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    text = np.repeat([0, 1], 300)
    drawn = near_duplicates.samples(text, np.concatenate((shingle, shingle)), np.concatenate((wa, wb)).astype(np.float32), 2, 1500)
    assert abs((drawn[0] == drawn[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05


def test_near_duplicates_of_nothing(none):
    assert near_duplicates.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(70)] + [("x", "y")], "a string, b string")
    got = {r.node: r.component for r in near_duplicates.components(edges).collect()}
    assert {got[k] for k in got if k < "x"} == {"0000"} and got["x"] == got["y"] == "x"


# --- licenses ------------------------------------------------------------------------------------

def test_license_scan_by_brute_force(docs, rows, none):
    got = Counter(tuple(r) for r in licenses.scan_licenses(docs).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        w = words(text)
        places, base, labels, best = [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += found
            if found:
                base.add(label)
        for line in (text or "").split("\n"):
            have = set(words(line))
            for template, label in licenses.TEMPLATES:
                own = set(template.split())
                if len(own & have) >= licenses.needed(len(own), 0.8):
                    labels.add(label)
                    best = max(best, len(own & have) / len(own))
        want[doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best] += 1
    assert got == want
    assert licenses.scan_licenses(none).count() == 0


def test_wrapped_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed"
    gpl = "\n".join("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License".split())
    texts = [f"int x;\n/* {bsd}\n*/", f"{mpl}\n", f"before\n{gpl}\nafter", "a b c\n" * 50 + "\n\n" + bsd.replace("\n", "\r\n\n"), "released\n\nunder", "\n\n", bsd.split("\n")[0], None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = Counter((r.doc_id, r.labels, r.score) for r in licenses.scan_licenses(docs).collect())
    assert got == Counter({(0, "bsd", 1.0): 2, (1, "mpl-2.0", 1.0): 1, (2, "gpl", 1.0): 1, (3, "bsd", 1.0): 1, (4, "", 0.0): 1, (5, "", 0.0): 1, (6, "", 0.0): 1, (7, "", 0.0): 1})


def test_words_around_line_ends(spark):
    rnd = random.Random(6)
    texts = [[[f"w{rnd.randint(0, 99)}" for _ in range(rnd.choice([0, 0, 1, 2, 3, 9]))] for _ in range(rnd.randint(0, 9))] for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "i long, lines array<array<string>>")
    for r in table.select("i", licenses.around_line_ends(table["lines"], 4).alias("got")).collect():
        filled = [x for x in texts[r.i] if x]
        flat, ends = sum(filled, []), np.cumsum([len(x) for x in filled])[:-1].tolist()
        assert [list(x) for x in r.got] == [flat[max(e - 4, 0) : e + 4] for e in ends]


# --- token files ---------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 7, 64, 513, 2000])
def test_wavelet_queries(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, rng.integers(1, 70000), n)
    shard = wavelet.Shard(wavelet.build(ids, [None], np.array([0, n])))
    assert (shard.decode() == ids).all()
    for i in range(0, n, max(n // 40, 1)):
        token = int(ids[i])
        at = np.flatnonzero(ids == token)
        assert shard.access(i) == token and shard.count(token) == len(at) and shard.count(token, i) == (at < i).sum()
        assert shard.find(token, 0) == at[0] and shard.find(token, len(at) - 1) == at[-1] and shard.find(token, len(at)) == -1
    assert shard.count(1 << 30) == 0


def test_token_files_hold_all_documents(docs, rows, none):
    tok = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    files = wavelet.write_files(docs, shard_ids=500)
    got = sorted((tuple(r) for r in wavelet.read_files(files).collect()), key=lambda r: r[1])
    at = 0
    for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())), strict=True):
        ids = tok.plain(text or "") + np.array([2], "<u4").tobytes()
        assert r == (doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert sum(r.occurrences for r in wavelet.occurrences(files, 2).collect()) == len(rows) and files.count() > 3
    assert wavelet.read_files(wavelet.write_files(none)).count() == 0


# --- tool calls ----------------------------------------------------------------------------------

def test_tool_calls(spark):
    good = json.dumps({"turn": 0, "text": "hé"})
    calls = [
        (1, "a", "ask", good, None, 0), (1, "b", "ask", good, "a", 2), (1, "c", "ask", '{"text": 3}', "b", 4), (1, "d", "ask", "not json", "zz", 6),
        (2, "x", "ask", good, "y", 0), (2, "y", "ask", good, "x", 1), (2, "z", "other", good, "x", 2), (3, None, "ask", None, None, None),
        (3, "r", "ask", good, None, 1), (3, "r", "ask", good, None, 1),
    ] + [(9, f"k{i:03d}", "ask", good, f"k{i - 1:03d}" if i else None, i) for i in range(100)]
    results = [(1, "a", 1, "ok"), (1, "a", 3, "late"), (1, "b", 1, "early"), (1, "q", 9, "lost"), (1, None, 9, "none"), (3, "r", 2, None)]
    got = defaultdict(list)
    for r in tool_calls.link(spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, parent_id string, turn long"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")).collect():
        got[r.call_id].append(r)
    for rows_ in got.values():
        rows_.sort(key=lambda r: r.errors == "further result")
    one = lambda k: got[k][0]
    # Two results without a call, and the second one of call a.
    assert sum(map(len, got.values())) == len(calls) + 3
    assert [(r.errors, r.result_turn, json.loads(r.canonical)["result"]) for r in got["a"][1:]] == [("further result", 3, "late")]
    assert one("a").valid and one("a").result_turn == 1 and one("a").n_results == 2 and one("a").level == 0
    assert one("a").canonical == '{"arguments":{"text":"hé","turn":0},"id":"a","name":"ask","parent":null,"result":"ok"}'
    assert one("b").errors == "result before the call" and one("b").level == 1
    assert one("c").errors == "turn is missing; text is not of type string; no result" and one("c").level == 2
    assert one("d").errors == "arguments are not an object; parent missing; no result"
    assert "cycle" in one("x").errors and "cycle" in one("y").errors and "cycle" in one("z").errors and "unknown tool" in one("z").errors
    assert len(got["r"]) == 2 and one("r").errors == "repeated identifier" and one("q").errors == "no call" and len(got[None]) == 2
    assert [got[f"k{i:03d}"][0].level for i in range(100)] == list(range(100))


def test_tool_calls_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, call_id string")
    assert tool_calls.link_conversations(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, "c"), (1, 0, "user", None, "c"), (1, 1, "assistant", "", "c")], empty.schema)
    rows = tool_calls.link_conversations(odd).collect()
    assert sorted(r.errors for r in rows) == ["text is missing", "unknown role"]
    assert [r.result_turn for r in rows if r.call_id] == [1]


def test_every_turn_and_every_result_has_a_row(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "tool", "b"), (1, 2, "assistant", "c"), (1, 3, None, None), (1, 3, "function", "d"), (2, 0, "user", "q")]
    turns += [(2, 1, "assistant", t) for t in ("x", "y", "x", None)] + [(None, 5, "assistant", "z"), (3, None, "user", "w")]
    rows = tool_calls.link_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert Counter(r.errors.split("; ")[-1] for r in rows) == Counter({"unknown role": 3, "no result": 2, "no call": 2, "further result": 3, "": 1})
    others = sorted((json.loads(r.canonical)["arguments"] for r in rows if r.errors == "unknown role"), key=str)
    assert {"chars": 1, "role": "tool", "text": "b", "turn": 1} in others and {"chars": None, "role": None, "text": None, "turn": 3} in others
    results = [json.loads(r.canonical)["result"] for r in rows if r.call_id == "call_2_0"]
    assert Counter(results) == Counter([None, "x", "x", "y"])


# --- decontamination -----------------------------------------------------------------------------

def hits(w, windows):
    hit, items = set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                items |= windows[tuple(w[k : k + n])]
                hit.update(range(k, k + n))
    return hit, items


@pytest.mark.parametrize("seed", range(40))
def test_automaton_by_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(15):
        width, letters = rnd.choice([3, 4, 5]), [b"a", b"b", b"c", b"d"][: rnd.randint(2, 4)]
        items = [(str(i), [rnd.choice(letters) for _ in range(rnd.randint(1, 9))]) for i in range(rnd.randint(1, 5))]
        doc = [rnd.choice(letters + [b"x"]) for _ in range(rnd.randint(0, 40))] + rnd.choice(items)[1]
        windows = defaultdict(set)
        for i, (_, w) in enumerate(items):
            for k in range(max(len(w) - width + 1, 1)):
                windows[tuple(w[k : k + width])].add(i)
        hit, found = hits(doc, windows)
        got, got_items = decontaminate.Automaton(items, width).scan(doc)
        assert set(np.flatnonzero(got)) == hit and got_items == found


def test_hit_words_in_blocks(spark, docs, rows, none):
    rnd = random.Random(3)
    long_text = next(t for _, t, *_ in rows if t and len(words(t)) > 4000)
    bench = [(0, rows[0][1]), (1, "word"), (2, None), (3, "..."), (4, " ".join(words(long_text)[100:120])), (5, sentence(rnd, 40)), (None, "lost item"), (4, "word")]
    table = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, doc_id string")
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        if w and i is not None:
            for k in range(max(len(w) - 12, 1)):
                windows[tuple(w[k : k + 13])].add(str(i))
    want = Counter()
    for doc_id, text, *_ in rows:
        w = words(text)
        hit, items = hits(w, windows)
        want[doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for block in (500_000, 30):
        got = decontaminate.hit_words(docs, table, block_words=block)
        assert Counter(tuple(r)[:6] for r in got.collect()) == want
    kept = decontaminate.decontaminate(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[5])
    cut = decontaminate.decontaminate(docs, table, cut_longer_than=15)
    lengths = {r.doc_id: len(words(r.text)) for r in cut.collect()}
    doc = next(d for d, t, *_ in rows if t == long_text)
    assert lengths[doc] == len(words(long_text)) - 20
    assert decontaminate.hit_words(none, table).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.hit_words(docs, table.limit(0)).collect())


def test_windows_of_items_without_id(spark):
    rnd = random.Random(5)
    lost, named = sentence(rnd, 30), sentence(rnd, 20)
    table = spark.createDataFrame([(None, lost), (None, "shortone"), (7, named)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {lost}"), (2, f"{named} {lost}"), (3, "a shortone here"), (4, "none of it")], "doc_id long, text string")
    digest = lambda names: hashlib.sha256(names.encode()).hexdigest()
    want = [(1, 31, 30, 0, digest(""), True), (2, 50, 50, 1, digest("7"), True), (3, 3, 1, 0, digest(""), True), (4, 3, 0, 0, digest(""), False)]
    for block in (500_000, 1):
        assert sorted(tuple(r)[:6] for r in decontaminate.hit_words(docs, table, block_words=block).collect()) == want
    assert [r.doc_id for r in decontaminate.decontaminate(docs, table).collect()] == [4]


# --- repeated bytes ------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(20))
def test_merge_of_front_coded_runs(seed):
    rnd = random.Random(seed)
    for _ in range(10):
        rows = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 60))]
        k = rnd.randint(1, 9)
        runs = [iter([(n, r, i) for n, r in suffix_dedup.front_code(sorted(rows[i::k]))]) for i in range(k)]
        before, got = b"", list(suffix_dedup.merge_runs(runs))
        assert [g[1] for g in got] == sorted(rows)
        for n, text, _ in got:
            assert n == suffix_dedup.shared(before, text, 0)
            before = text


def test_a_merge_never_reads_known_prefixes():
    class Watched(bytes):
        pass

    compared = []
    real = suffix_dedup.shared
    suffix_dedup.shared = lambda a, b, known: compared.append(known) or real(a, b, known)
    try:
        rows = [b"x" * 100 + bytes([97 + i]) for i in range(20)]
        runs = [iter([(n, r, 0) for n, r in suffix_dedup.front_code(rows[i::4])]) for i in range(4)]
        compared.clear()
        assert [t for _, t, _ in suffix_dedup.merge_runs(runs)] == rows
    finally:
        suffix_dedup.shared = real
    # Three matches build the tree; all later comparisons start behind the common prefix.
    assert sum(k < 100 for k in compared) <= 3


def test_suffix_ranges_are_even():
    """Anchors are the smallest hashes of their windows, yet their suffixes fill all ranges."""
    rng = np.random.default_rng(3)
    _, gram, _ = suffix_dedup.anchors(rng.integers(97, 123, 200_000).astype(np.uint8))
    first = [int.from_bytes(suffix_dedup._suffix(int(g) * suffix_dedup._ODD % (1 << 64), b"", b"")[:4], "big") for g in gram]
    counts = np.bincount([v * 8 >> 32 for v in first], minlength=8)
    assert counts.min() > 0.7 * counts.mean() and counts.max() < 1.3 * counts.mean()


def test_keys_with_many_rows_are_matched_whole(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(400)] + [("lone", 1)], "gram string, place long")
    counted = rows.groupBy("gram").count().withColumnRenamed("count", "n").where("n > 1")
    got = Counter(tuple(r) for r in suffix_dedup._matched(rows, counted, ["gram"], "n", 100_000).collect())
    assert got == Counter(tuple(r) for r in rows.join(counted, "gram").collect()) and sum(got.values()) == 900


def brute_removed(texts, window):
    count = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window, gram, most", [(400, 200, 4096), (40, 16, 4096), (40, 16, 3), (24, 24, 4096)])
def test_repeated_bytes_by_brute_force(spark, rows, none, window, gram, most):
    rnd = random.Random(window + most)
    more, base = [], sentence(rnd, 40)
    for i in range(30):
        edited = base.split()
        edited[rnd.randrange(len(edited))] = "né" * rnd.randint(0, 4)
        more.append((100 + i, " ".join(edited), None, None, None, None, None))
    more += [(200, "aaaa" * 300, None, None, None, None, None), (201, "ab" * 200 + "c" + "ab" * 100, None, None, None, None, None), (None, base, None, None, None, None, None), (0, base, None, None, None, None, None)]
    every = [*rows, *more]
    df = spark.createDataFrame(every, DOCS).repartition(4)
    original = suffix_dedup.removed_spans
    try:
        suffix_dedup.removed_spans = lambda d, w, g: original(d, w, g, most=most)
        found = suffix_dedup.repeated_bytes(df, window, gram).collect()
        got = Counter(tuple(r)[:5] for r in found)
        cut = suffix_dedup.without_repeats(df, window, gram)
        assert cut.columns == df.columns and cut.count() == len(every)
    finally:
        suffix_dedup.removed_spans = original
    texts = [(t or "").encode() for _, t, *_ in every]
    assert got == Counter((d, *r) for (d, *_), r in zip(every, brute_removed(texts, window)))
    whole = [r for r in found if len(r.text.encode()) == r.n_bytes - r.n_removed]
    assert len(whole) > len(every) // 2 and all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in whole)
    assert suffix_dedup.repeated_bytes(none, window, gram).count() == 0


@pytest.mark.parametrize("window, gram, passage, most", [(400, 80, 250, 4096), (400, 80, 250, 3), (40, 16, 24, 4096), (40, 16, 24, 3), (40, 16, 16, 4096)])
def test_passages_and_repeated_bytes_by_brute_force(spark, rows, window, gram, passage, most):
    rnd = random.Random(window + passage + most)
    more, base = [], sentence(rnd, 80)
    for i in range(30):
        edited = base.split()
        for _ in range(rnd.randint(1, 3)):
            edited[rnd.randrange(len(edited))] = "né" * rnd.randint(0, 4)
        more.append((100 + i, " ".join(edited[rnd.randint(0, 30) :]), None, None, None, None, None))
    more += [(200, "aaaa" * 300, None, None, None, None, None), (201, "ab" * 200 + "c" + "ab" * 100, None, None, None, None, None), (202, base[:300], None, None, None, None, None)]
    more += [(203, "x" * 260, None, None, None, None, None), (204, "x" * 260, None, None, None, None, None), (None, base, None, None, None, None, None), (0, base, None, None, None, None, None)]
    every = [*rows, *more]
    df = spark.createDataFrame(every, DOCS).repartition(4)
    original = suffix_dedup.removed_spans
    try:
        suffix_dedup.removed_spans = lambda d, w, g, **more: original(d, w, g, most=most, **more)
        found = suffix_dedup.repeated_bytes(df, window, gram, passage).collect()
    finally:
        suffix_dedup.removed_spans = original
    texts = [(t or "").encode() for _, t, *_ in every]
    long, short = brute_removed(texts, window), brute_removed(texts, passage)
    want = Counter((d, *r, s[1]) for (d, *_), r, s in zip(every, long, short))
    assert Counter((*tuple(r)[:5], r.n_passage_bytes) for r in found) == want
    assert any(s[1] > r[1] for r, s in zip(long, short))
    kept = {(d, s[0], s[1], s[3]) for (d, *_), s in zip(every, short)}
    whole = [r for r in found if len(r.passage_text.encode()) == r.n_bytes - r.n_passage_bytes]
    assert len(whole) > len(every) // 2
    assert all((r.doc_id, r.n_bytes, r.n_passage_bytes, hashlib.sha256(r.passage_text.encode()).hexdigest()) in kept for r in whole)


def test_op9_tells_passages_of_over_fifty_words(spark, tmp_path):
    """A passage of 55 words and under 400 bytes stays by the contract's columns and is out of passage_text."""
    rnd = random.Random(3)
    passage = " ".join(f"{rnd.choice('bcdfgh')}{rnd.randrange(1000, 10000)}" for _ in range(55))
    others = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(60)) for _ in range(3)]
    assert 250 < len(passage) < 400
    texts = [f"{others[0]} {passage}", f"{passage} {others[1]}", others[2]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in entries.op9_sorted_suffixes(spark, str(tmp_path)).collect()}
    assert [found[i].text for i in range(3)] == texts and all(r.n_removed == 0 for r in found.values())
    for i in range(2):
        assert passage not in found[i].passage_text and others[i] in found[i].passage_text
        assert found[i].n_passage_bytes in (len(passage), len(passage) + 1)
    assert found[2].passage_text == texts[2] and found[2].n_passage_bytes == 0


@pytest.mark.parametrize("segment, small", [(7, 1), (30, 12), (1 << 23, 1), (1 << 23, 12)])
def test_anchor_pairs_find_every_window(monkeypatch, segment, small):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    rnd, window, gram = random.Random(segment + small), 20, 8
    room = window - gram
    for _ in range(60):
        letters = b"ab" if rnd.random() < 0.3 else b"abcdefgh"
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 6))]
        for _ in range(3):
            a, b = rnd.choice(texts), rnd.choice(texts)
            i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
            texts.append(a[:i] + b[j : j + rnd.randint(0, 50)] + a[i:])
        spans, classes, groups, first = defaultdict(list), Counter(), defaultdict(list), set()
        found = [(n, *map(int, x)) for n, t in enumerate(texts) for x in zip(*suffix_dedup.anchors(np.frombuffer(t, np.uint8), window, gram))]
        for n, p, g, around in found:
            classes[g, around] += 1
        for n, p, g, around in found:
            if classes[g, around] > 1:
                spans[n].append((p - room, p + window))
            if (g, around) not in first:
                first.add((g, around))
                groups[g].append((n, p))
        for members in groups.values():
            right, left = [texts[n][p + gram : p + window] for n, p in members], [texts[n][max(p - room, 0) : p] for n, p in members]
            for m, a, b in suffix_dedup.covered_in_group(right, left, room) if len(members) > 1 else []:
                n, p = members[m]
                spans[n].append((p - a, p + gram + b))
        for n, (t, want) in enumerate(zip(texts, brute_removed(texts, window))):
            kept, removed, runs = suffix_dedup.cut(t, spans[n])
            assert (len(t), removed, runs, hashlib.sha256(kept).hexdigest()) == want


# --- pages ---------------------------------------------------------------------------------------

def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>", "\n", article.replace("<br>", " "))).split("\n")
        import html

        lines = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def test_pages_without_telling_elements(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_text.train(pages)
    filler = "Some longer sentence about nothing much that goes on for a while. " * 6
    page = f"<html><head><title>t</title></head><body><div class=menu><a href=/>home</a></div><div class=content><h2>Head</h2><p>{filler}</p><p>{filler}<i>end</i></p></div><div class=comments><p>I liked it</p></div><div class='footer'>&copy; x</div></body></html>"
    text = html_text.extract_texts(model, [page])[0]
    assert text.startswith("Head\nSome") and "end" in text and "liked" not in text and "home" not in text and "©" not in text
    odd = ["", None, "<", "<p", "a < b &amp; c", "<div>" * 3000 + "deep", "<script>x</script>", "<p>a<p>b</p></div></p>"]
    assert len(html_text.extract_texts(model, odd)) == len(odd)


def test_a_table_where_no_page_tells(spark):
    """Only plain elements with classes: text and link density take the place of telling ones."""
    rnd = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [sentence(rnd, rnd.randint(18, 60)).capitalize() + "." for _ in range(rnd.randint(2, 5))]
        menu = "".join(f"<li><a href='/{k}'>{sentence(rnd, 2)}</a></li>" for k in range(rnd.randint(3, 8)))
        rows.append((i, f"u{i}", f"<html><body><div class='nav'><ul>{menu}</ul></div><div id=x{i}><h2>Head {i}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div><div class=footer><p>{sentence(rnd, 4)}</p></div></body></html>"))
        want[i] = "\n".join([f"Head {i}", *paragraphs])
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_texts(table).collect()}
    assert sum(got[i] == want[i] for i in want) >= 57
    assert all(got.values())


def test_attributes_are_whole_names():
    nodes = html_text.parse("<div data-id='sidebar' data-class=menu><p id=main>x</p></div>")
    assert nodes[1].words == [] and nodes[2].words == ["main"]


def test_decoding_never_contradicts():
    rng = random.Random(1)
    nodes = html_text.parse("<div><p>a</p><div><p>b</p><ul><li>c<li>d</ul></div></div>" * 4)
    for _ in range(200):
        score = np.array([rng.uniform(-1, 1) for _ in nodes])
        keep = html_text.kept_elements(nodes, score)
        assert all(not keep[i] or keep[n.parent] for i, n in enumerate(nodes) if i)


def test_training_pages_tell_labels_and_differ(spark):
    told = [f"<body><nav>menu</nav><article><h1>Head {i}</h1><p>Some text of page {i}, long enough.</p></article></body>" for i in range(12)]
    untold = [f"<body><div>page {i}</div></body>" for i in range(60)]
    table = spark.createDataFrame([(h,) for h in told + [told[0]] * 90 + untold + [untold[0]] * 90 + [None, ""]], "html string").repartition(5)
    hashes = {r.html: r.h for r in table.selectExpr("html", "xxhash64(html) AS h").collect()}
    order = sorted(told, key=hashes.get)
    assert html_text.training_pages(table, 5) == order[:5] and html_text.training_pages(table, 12) == order
    assert html_text.training_pages(table) == order
    assert html_text.training_pages(table.where("html like '<body><div>%'"), 5) == []
    assert len(html_text.training_pages(table.where("html like '<body><div>%'"), 5, html_text.weak_labels)) == 5
    assert html_text.train(table, 5).edges


def test_pages_defaults(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_text.main_texts(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x")], empty.schema)
    assert [r.text for r in html_text.main_texts(odd).collect()] == ["", "", ""]


# --- pipeline and registration -------------------------------------------------------------------

def test_pipeline_stages_keep_the_columns_of_documents(spark, docs):
    out = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in corpus_pipeline.STAGES[:-1]:
        step_out = step(spark, out, SF)
        assert step_out.columns == out.columns, name
        out = step_out
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).where("length > 2048").count() == 0


def test_pipeline_equals_the_stages_by_brute_force(spark):
    """Exact stages are compared with plain versions, the two learned or drawn ones with their contract."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    one = common.stage(steps["language"](spark, docs, SF), "t")
    two = common.stage(steps["near_duplicates"](spark, one, SF), "t")
    three = common.stage(steps["suffix_dedup"](spark, two, SF), "t")
    four = common.stage(steps["decontamination"](spark, three, SF), "t")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(one) <= ids(docs) and ids(two) <= ids(one) and ids(three) == ids(two)
    clusters = near_duplicates.near_duplicates(one).collect()
    assert ids(two) == {r.cluster_id for r in clusters}
    before = {r.doc_id: (r.text or "").encode() for r in two.collect()}
    want = dict(zip(before, brute_removed(list(before.values()), 250)))
    after = {r.doc_id: r for r in three.collect()}
    for d, (size, removed, _, digest) in want.items():
        assert after[d].n_chars == len(after[d].text) if removed else after[d].text.encode() == before[d]
        assert removed or hashlib.sha256(after[d].text.encode()).hexdigest() == digest
        assert 0 <= size - removed - len(after[d].text.encode()) <= 6 * size
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    hits = decontaminate.hit_words(three, benchmark).collect()
    flagged = {r.doc_id for r in hits if r.contaminated}
    assert ids(four) == ids(three) - flagged and flagged
    # No whole window is left in the documents that stay, and texts without one are as they were.
    untouched = {r.doc_id for r in hits if not r.n_hit}
    texts = {r.doc_id: r.text for r in four.collect()}
    assert all(texts[d] == after[d].text for d in untouched)
    assert all(s.last - s.first + 1 < 13 for r in decontaminate.hit_words(four, benchmark).collect() for s in r.spans)
    assert all(r.n_chars == len(r.text) for r in four.collect() if r.doc_id not in untouched)


def test_stages_with_clashing_columns(spark, rows):
    names = DOCS + ", _key string, _id long, _hash long, _spans string"
    df = spark.createDataFrame([(*r, "k", 1, 2, "s") for r in rows], names)
    assert suffix_dedup.without_repeats(df, 40, 16).columns == df.columns and suffix_dedup.without_repeats(df, 40, 16).count() == len(rows)
    kept = near_duplicates.one_of_each(df)
    assert kept.columns == df.columns and {r._key for r in kept.collect()} == {"k"}


def test_operators_run_where_workers_lack_the_package(tmp_path):
    """Started from another folder, without the package on the workers' path."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from seqatlas.session import local_session
spark = local_session("elsewhere", 2, 2)
def lacks(batches):
    import importlib.util, pandas as pd
    for b in batches:
        yield pd.DataFrame({{"found": [importlib.util.find_spec("seqatlas") is not None]}})
assert not spark.range(1).mapInPandas(lacks, "found boolean").first().found
for name in ("op1_pattern_packing", "op3_language_codes", "op8_benchmark_automaton", "op10_boosted_extraction", "op12_resident_codes"):
    print(name, entry.queries()[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("op") >= 5


@pytest.mark.parametrize("name", sorted(entries.ORACLE))
def test_oracle(spark, name):
    from oracle import compare, connect

    assert compare(entries.QUERIES[name](spark, SF), entries.ORACLE[name], connect(SF)) is None


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
