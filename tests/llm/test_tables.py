"""Operators over whole tables, against brute force: dedup, near-duplicates, mixing, the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate, mixing, near_dup, substring_dedup, suffix_array
from tests.conftest import SF


@pytest.mark.parametrize("small", [1024, 2])
def test_suffix_arrays(small, monkeypatch):
    monkeypatch.setattr(suffix_array, "_SMALL", small)
    r = random.Random(1)
    for _ in range(250):
        k, n = r.choice([1, 2, 3, 6]), r.randrange(60)
        s = [r.randrange(1, k + 1) for _ in range(n)] + [0]
        sa = suffix_array.suffix_array(np.array(s), k + 1)
        want = sorted(range(n + 1), key=lambda i: s[i:])
        assert sa.tolist() == want
        p = suffix_array.permuted_lcp(np.array(s), sa)
        for a, b in zip(want, want[1:]):
            m = 0
            while max(a, b) + m <= n and s[a + m] == s[b + m]:
                m += 1
            assert p[b] == m


def _brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(b) > 0 and gone[0])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [200_000, 600])
def test_substring_dedup(spark, monkeypatch, hot):
    """Shared passages between different neighbours, copies, periods, nulls, repeated rows; both ways for hot hashes."""
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", hot)
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghij klmnop é") for _ in range(n))
    passage, copy = word(700), word(1500)
    texts = [word(r.randrange(50)) + passage[r.randrange(250) :] + word(r.randrange(300)) for _ in range(15)]
    texts += [copy, copy, copy[1:], None, "", "ab" * 600, "x" * 399, "x" * 401, word(2000), copy[:500] + word(30) + copy[600:]]
    rows = list(enumerate(texts)) + [(None, copy), (0, texts[0])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kept string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.dedup(df).collect())
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, _brute_removed([t for _, t in rows], 400)))
    assert got == want
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def _brute_shared(texts, n):
    split = [re.findall(rb"[^ \t-\r]+", (t or "").encode()) for t in texts]
    rows = defaultdict(set)
    for i, w in enumerate(split):
        for k in range(len(w) - n + 1):
            rows[tuple(w[k : k + n])].add(i)
    return [len({k + j for k in range(len(w) - n + 1) if len(rows[tuple(w[k : k + n])]) > 1 for j in range(n)}) for w in split]


@pytest.mark.parametrize("chunk", [1 << 16, 9])
def test_passages_of_over_50_words_under_400_bytes(spark, monkeypatch, chunk):
    """A passage too short in bytes to be removed is told by its words: 51 or more, in another row."""
    monkeypatch.setattr(substring_dedup, "WORD_CHUNK", chunk)
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdé") for _ in range(r.randrange(1, 7))) for _ in range(n))
    passage, copy, junk = prose(55), prose(120), prose(3)
    assert len(passage.encode()) < 400
    texts = [f"{prose(r.randrange(1, 90))}\n{passage}\t{prose(r.randrange(1, 90))}" for _ in range(6)]
    texts += [" ".join(passage.split()[a:b]) + " " + prose(20) for a, b in ((0, 50), (0, 51), (4, 55), (5, 55))]
    texts += [copy, copy, copy + " é", prose(50), None, "", " \n ", f"{junk} " * 60, prose(200), passage.upper()]
    texts += [f"{copy} {prose(9)} {passage} {copy}", "a " * 51, "a " * 30, "b" * 30 + " b" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_shared_words"]) for x in substring_dedup.dedup(df).collect()}
    want = _brute_shared(texts, 51)
    assert [got[i][1] for i in range(len(texts))] == want
    assert [got[i] for i in range(6)] == [(0, 55)] * 6 and want[6:10] == [0, 51, 51, 0]


def test_regions_in_chunks(monkeypatch):
    r = random.Random(3)
    b = np.frombuffer(bytes(r.randrange(97, 101) for _ in range(5000)) + b"zy" * 3000, np.uint8)
    whole = list(substring_dedup.regions(b))
    monkeypatch.setattr(substring_dedup, "CHUNK", 900)
    assert list(substring_dedup.regions(b)) == whole


def _brute_classes(texts, idf):
    sets = {}
    for i, t in texts.items():
        h, n = near_dup.shingles(t)
        sets[i] = (h, near_dup.weights(h, n, idf))
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if j < i and len(sets[i][0]) and near_dup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_near_duplicates(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(120)]
    texts, n = {}, 0
    for edits in [0] * 5 + [1] * 12 + [2] * 12 + [6] * 6:
        t = list(base)
        for _ in range(edits):
            t[r.randrange(len(t))] = "edit%d" % r.randrange(10**6)
        texts[n], n = " ".join(t), n + 1
    for _ in range(20):
        texts[n], n = " ".join(r.choice(words) for _ in range(60)), n + 1
    for t in (None, "", "...", "two words", "Two  WORDS!", "long " * 40000):
        texts[n], n = t, n + 1
    rows = [(i, t, "clash") for i, t in texts.items()] + [(0, texts[0], "again"), (None, "no id at all here today", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    idf = near_dup.idf_table(df.where("doc_id is not null"))
    assert got == _brute_classes(texts, idf)
    kept = near_dup.one_of_each(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted([(False, i) for i, c in got.items() if i == c] + [(True, 0)])
    assert near_dup.classes(df.limit(0)).count() == 0


def test_consistent_sampling_estimates_similarity():
    """Unbiased over many pairs of short and of very long sets, and as spread as independent samples are."""
    r = np.random.default_rng(5)
    for size, pairs in ((300, 120), (100_000, 4)):
        off = []
        for _ in range(pairs):
            keys = np.unique(r.integers(0, 1 << 32, size, dtype=np.uint32))
            cut = int(len(keys) * r.uniform(0.05, 0.3))
            a, b = (keys[:-cut], r.random(len(keys) - cut) + 0.5), (keys[cut:], r.random(len(keys) - cut) + 0.5)
            off.append(np.mean(near_dup.signature(*a) == near_dup.signature(*b)) - near_dup.weighted_jaccard(a, b))
        spread = 0.5 / np.sqrt(near_dup.BANDS * near_dup.ROWS)
        assert abs(np.mean(off)) < 4 * spread / np.sqrt(pairs) and np.sqrt(np.mean(np.square(off))) < 1.6 * spread


def similar_pairs(sets, least=0.8):
    """All pairs of ``sets`` (id: (ascending keys, weights)) of at least that weighted Jaccard similarity.

    Complete: ordered by how rare they are, the keys with more than 1 - ``least`` of a set's
    weight must hold one that a similar set has among its own such keys.
    """
    count = Counter(k for h, _ in sets.values() for k in h.tolist())
    by, out = {}, set()
    for i, (h, w) in sets.items():
        order = sorted(range(len(h)), key=lambda k: (count[int(h[k])], int(h[k])))
        total, seen, near = float(w.sum()), 0.0, set()
        for k in order:
            if seen > (1 - least) * total + 1e-6:
                break
            seen += float(w[k])
            near.update(by.setdefault(int(h[k]), []))
            by[int(h[k])].append(i)
        out |= {(j, i) for j in near if near_dup.weighted_jaccard(sets[i], sets[j]) >= least}
    return out


def recall(spark, sf):
    """(similar pairs of different texts, those in one class, pairs of one class and link that brute force lacks)"""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    idf = near_dup.idf_table(docs)
    sets, first = {}, {}
    for r in docs.orderBy("doc_id").collect():
        h, n = near_dup.shingles(r["text"])
        if len(h) and first.setdefault((h.tobytes(), n.tobytes()), r["doc_id"]) == r["doc_id"]:
            sets[r["doc_id"]] = (h, near_dup.weights(h, n, idf))
    pairs = similar_pairs(sets)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    wrong = sum(find(got[i]) != find(i) for i in sets)
    return len(pairs), sum(got[a] == got[b] for a, b in pairs), wrong


def test_recall_on_whole_tables(spark):
    pairs, found, wrong = recall(spark, "0.01")
    assert pairs >= 5 and found >= 0.9 * pairs and wrong == 0


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mixing.fit(docs, "text", "lang")
    members = mixing.memberships(docs.select("doc_id", "text"), model)
    p = members.collect()
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in p)
    fitted = mixing.fit_rates(members.drop("text"), [4.0, 3.0, 2.0, 1.0])
    rated, reached = fitted.rows, fitted.reached
    assert fitted.converged
    total = sum(r["n_tokens"] for r in p)
    want = [total * w / 10 for w in (4, 3, 2, 1)]
    assert all(abs(a - b) < 1e-3 * total for a, b in zip(reached, want))
    # The same descent in numpy, over the same memberships.
    n, x = np.array([r["n_tokens"] for r in p], float), np.array([r["posterior"] for r in p])
    rate, start = np.ones(len(p)), n @ x
    before, speed, last = rate, 1.0, np.inf
    for _ in range(mixing.MAX_STEPS):
        now = (n * rate) @ x
        if max(abs(now - want)) <= mixing.TOLERANCE * max(want):
            break
        off = float(((now - want) ** 2 / start).sum())
        if off > last:
            before, speed = rate, 1.0
        after = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead = rate + (speed - 1) / after * (rate - before)
        rate, before, speed, last = np.maximum(0, ahead - x @ (((n * ahead) @ x - want) / start)), rate, after, off
    have = {r["doc_id"]: r["rate"] for r in rated.collect()}
    assert all(abs(have[r["doc_id"]] - v) < 1e-3 for r, v in zip(p, rate)) and min(rate) >= 0


def test_mixing_of_odd_tables(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y z", "a"), (3, "x y z", "a"), (None, "q r", "b"), (4, "w " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = mixing.mix(df, df).collect()
    assert len(out) == len(rows) and all(r["rate"] >= 0 for r in out)
    assert mixing.mix(df.limit(0), df).count() == 0
    assert {r["rate"] for r in mixing.mix(df, df.limit(0)).collect()} == {1.0}
    members = mixing.memberships(df, mixing.fit(df, "text", "lang"))
    with pytest.raises(ValueError):
        mixing.fit_rates(members, [0.0, 0.0])


def test_pipeline(spark, sf):
    """Every stage on its own input: columns stay, and what goes is what its operator found."""
    docs = corpus_pipeline.table(spark, sf, "documents")
    # The small table has no secrets of its own: every tenth document gets one.
    planted = F.concat("text", F.lit(' token = "908038b7daaf91e730d2f64001c52934d43d9336" end'))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, planted).otherwise(F.col("text")))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, sf), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        rows[name] = (before, after)
        if name != "mixing":
            assert docs.columns == columns
    before, after = rows["near_dedup"]
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(list(before.values()))).collect()}
    assert set(after) == {i for i, c in found.items() if i == c}
    before, after = rows["decontaminate"]
    bench = corpus_pipeline.table(spark, sf, "benchmark")
    leaked = {r["doc_id"] for r in decontaminate.leaks(spark.createDataFrame(list(before.values())), bench).collect()}
    assert set(after) == set(before) - leaked
    before, after = rows["secret_scan"]
    assert set(after) == set(before) and all(len(r["text"]) == r["n_chars"] for r in after.values())
    assert any(i % 10 == 3 for i in after) and all(("[SECRET]" in r["text"]) == (i % 10 == 3) for i, r in after.items())
    before, after = rows["mixing"]
    assert set(after) == set(before) and all(r["rate"] >= 0 for r in after.values())
