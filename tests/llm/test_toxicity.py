"""Toxicity against a plain version of the method: own vectors, a full scan, own votes."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import toxicity


def _tables(spark, sf="0.01"):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select("doc_id", "text"), labels


def _plain_terms(text):
    """The same terms by regular expression and dictionaries; a term is named by the hash of its letters."""
    out = Counter()
    for w, n in Counter(re.findall(r"[^\W\d_]+", (text or "").lower())).items():
        places = toxicity._tables()[1]
        for k in (0, *[b for b in toxicity.BEGINNINGS if len(w) > b]):
            h = sum(ord(c) * int(places[i]) for i, c in enumerate(w[:k] if k else w)) % (1 << 64)
            h = (h + k) * 0x9E3779B97F4A7C15 % (1 << 64)
            h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            out[h >> (64 - toxicity.TERM_BITS)] += n
    return out


def test_terms():
    texts = [None, "", "1 2 !", "One one ONES été 漢字 a_b x1y", "wonderfully wonderful wonder won", "a" * 30]
    for t in texts:
        terms, counts = toxicity.term_counts(t)
        assert dict(zip(terms.tolist(), counts.tolist())) == dict(_plain_terms(t))
    whole, toxicity.PIECE = toxicity.term_counts("some words here été " * 40), 23
    try:
        assert all((a == b).all() for a, b in zip(toxicity.term_counts("some words here été " * 40), whole))
    finally:
        toxicity.PIECE = 1 << 20


def test_index_finds_what_a_full_scan_finds():
    """Random vectors with ties, for few and many blocks that the bounds leave."""
    r = np.random.default_rng(3)
    for size, width in ((0, 5), (30, 8), (700, 12), (700, 300)):
        vectors = []
        for _ in range(size):
            t = np.unique(r.integers(0, width, 6))
            v = r.integers(1, 4, len(t)).astype(np.float32)
            vectors.append((t, v / np.sqrt(v @ v)))
        index = toxicity.Index.of(vectors)
        for _ in range(40):
            t = np.unique(r.integers(0, width + 3, 5))
            q = r.random(len(t)).astype(np.float32)
            skip = r.integers(0, size, 2) if size else None
            rows, sims = index.nearest(t, q, 7, skip)
            full = np.zeros(size)
            for i, (ts, vs) in enumerate(vectors):
                full[i] = 0 if i in skip else sum(float(v) * float(q[list(t).index(x)]) for x, v in zip(ts, vs) if x in t)
            want = sorted(range(size), key=lambda i: (-full[i], i))[:7]
            assert np.allclose(sims, [full[i] for i in want if full[i] > 0], atol=1e-5)
            assert np.allclose(full[rows], sims, atol=1e-5) and len(set(rows.tolist())) == len(rows)


def test_scores_against_a_plain_version(spark):
    docs, labels = _tables(spark)
    model = toxicity.fitted(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {}
    for r in labels.collect():
        if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["toxic"])
    found = {i: _plain_terms(t) for i, t in text.items()}
    df = Counter(t for c in found.values() for t in c)
    idf = lambda t: math.log((1 + len(text)) / (1 + df[t])) + 1
    a, c = Counter(t for i, y in known.items() if y for t in found[i]), Counter(t for i, y in known.items() if not y for t in found[i])
    n1, n0 = sum(known.values()), len(known) - sum(known.values())

    def weight(t):
        s = a[t] + c[t]
        phi = (a[t] * (n0 - c[t]) - c[t] * (n1 - a[t])) / math.sqrt(max(s * (n1 + n0 - s) * n1 * n0, 1e-9))
        return idf(t) * (toxicity.BASE + toxicity.LABEL_GAIN * max(0.0, phi))

    def unit(terms):
        v = {t: (1 + math.log(n)) * weight(t) for t, n in terms.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    examples = {i: unit(found[i]) for i in known}
    some = sorted(text)[::9]
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs.where(F.col("doc_id").isin(some)), model).collect()}
    for i in some:
        q = unit(found[i])
        cosine = sorted(((sum(x * e.get(t, 0.0) for t, x in q.items()), j) for j, e in examples.items()), reverse=True)
        near = [(s, j) for s, j in cosine if s > 0][: toxicity.NEIGHBOURS]
        if len(cosine) > len(near) and near and abs(cosine[len(near)][0] - near[-1][0]) < 1e-5:
            continue  # a tie at the end: either neighbour is right
        votes = [(1 / (toxicity.CLOSENESS - min(s, 1.0)), known[j]) for s, j in near]
        raw = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if votes else None
        want = model.empty if raw is None else float(np.interp(raw, model.knots, model.calibrated))
        assert abs(got[i]["score"] - want) < 1e-3 and np.allclose([s for s, _ in near[:3]], got[i]["similarity"], atol=2e-4)


def test_calibration_leaves_the_example_out():
    vectors = [(np.array([k]), np.ones(1, np.float32)) for k in (1, 1, 2)]
    index = toxicity.Index.of(vectors)
    assert index.nearest(np.array([2]), np.ones(1, np.float32), 3, np.array([2]))[0].tolist() == []
    assert index.nearest(np.array([1]), np.ones(1, np.float32), 3, np.array([0]))[0].tolist() == [1]
    xs, ps = toxicity._isotonic(np.array([0.0, 0.2, 0.4, 0.9]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert xs.tolist() == [0.0, 0.2, 0.4, 0.9] and (np.diff(ps) >= 0).all() and abs(ps[1] - 0.5) < 0.01


def test_held_out_rows(spark):
    docs, labels = _tables(spark, "0.1")
    model = toxicity.fitted(docs, labels)
    held = labels.where(toxicity.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).join(docs, "doc_id")
    got = [(r["toxic"], r["predicted"]) for r in toxicity.score_texts(held, model).collect()]
    hits = sum(y and p for y, p in got)
    assert hits >= 0.85 * sum(y for y, _ in got) and hits >= 0.85 * sum(p for _, p in got)


def test_the_model_does_not_know_partitions(spark):
    docs, labels = _tables(spark)
    one, two = toxicity.fitted(docs, labels), toxicity.fitted(docs.repartition(7), labels.repartition(3))
    assert (one.ids == two.ids).all() and (one.weight == two.weight).all() and (one.knots == two.knots).all() and (one.calibrated == two.calibrated).all()


def test_odd_tables(spark):
    docs, labels = _tables(spark)
    r = random.Random(1)
    rows = [(1, None), (2, ""), (3, "idiot idiot"), (3, "idiot idiot"), (None, "pathetic clown"), (4, "word " * 30000), (5, "漢字 ñ"), (6, "x" * 100000)]
    odd = spark.createDataFrame([(*x, "clash", r.random()) for x in rows], "doc_id long, text string, score string, evidence double")
    for known in (labels, labels.limit(0), labels.where("toxic = 0"), spark.createDataFrame([(3, 1), (3, 0), (None, 1), (77, 1)], "doc_id long, toxic int")):
        out = toxicity.score_texts(odd, toxicity.fitted(docs, known)).collect()
        assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
    assert all(x["predicted"] == 0 for x in toxicity.score_texts(odd, toxicity.fitted(docs, labels)).where("doc_id in (1, 2)").collect())
    assert toxicity.score_texts(odd.limit(0), toxicity.fitted(odd.limit(0).select("doc_id", "text"), labels)).count() == 0
    assert toxicity.fitted(odd.select("doc_id", "text"), spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")).ids.tolist() == [4, 3]
