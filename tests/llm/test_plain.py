"""Language ID and secret scans against plain versions of their methods; odd tables for all operators."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat_format, html_text, language_id, mixing, near_dup, secret_scan, substring_dedup
from tests.llm.test_rows import ODD, _base


def _plain_ngrams(text):
    """Bucket counts of letter 1-, 2- and 3-grams, one by one."""
    cp = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    mod, out = 1 << 32, {}
    for i in range(len(cp)):
        one = cp[i] * 2654435761 % mod
        two = three = None
        if i + 1 < len(cp):
            two = (one ^ (cp[i + 1] * 2246822519 + 1) % mod) * 3266489917 % mod
        if i + 2 < len(cp):
            three = (two ^ (cp[i + 2] * 668265263 + 2) % mod) * 374761393 % mod
        grams = [one] if cp[i] != 32 else []
        grams += [two] if two is not None and (cp[i] != 32 or cp[i + 1] != 32) else []
        grams += [three] if three is not None and cp[i + 1] != 32 else []
        for g in grams:
            out[g >> 19] = out.get(g >> 19, 0) + 1
    return out


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fitted(docs)
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {r["doc_id"]: _plain_ngrams(r["text"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and any(c.isalpha() for c in r["text"])}
    df = {}
    for c in counts.values():
        for g in c:
            df[g] = df.get(g, 0) + 1
    idf = [math.log((1 + len(counts)) / (1 + df.get(g, 0))) + 1 for g in range(language_id.BUCKETS)]
    assert np.allclose(idf, model.idf)
    got = {r["doc_id"]: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    for r in rows[::25]:
        c = _plain_ngrams(r["text"])
        if not any(x.isalpha() for x in r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        v = {g: math.log1p(n) * idf[g] for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x / size * float(row[g]) for g, x in v.items()) for row in model.centroids]
        best = {}
        for k, x in zip(model.owner, cos):
            best[model.languages[k]] = max(best.get(model.languages[k], -1.0), x)
        lang = max(best, key=best.get)
        score = 1 / sum(math.exp((x - best[lang]) / language_id.TEMPERATURE) for x in best.values())
        bound = model.least[sum(e <= sum(c.values()) for e in model.edges)]
        rejected = max(x for x, s in zip(cos, model.solid) if s) < bound
        g = got[r["doc_id"]]
        assert (g["lang_pred"], g["rejected"]) == (lang, rejected) and abs(g["score"] - score) < 1e-3 and abs(g["cosine"] - best[lang]) < 1e-3


def test_equal_cosines_go_to_the_first_language():
    c = np.zeros((2, language_id.BUCKETS), np.float32)
    c[:, 5] = 1.0
    model = language_id.Model(["aa", "bb"], np.ones(language_id.BUCKETS), c, np.array([0, 1]), np.array([True, True]), np.zeros(0), np.zeros(1))
    assert model.predict("any text")[0] == "aa"


def test_markov_scores_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    samples = secret_scan.labelled_samples(docs, "text", "doc_id").collect()
    n, total = {}, {}
    for r in samples:
        before = 0
        for c in r["token"]:
            if ord(c) < 128 and before < 128:
                n[r["label"], before, ord(c)] = n.get((r["label"], before, ord(c)), 0) + 1
                total[r["label"], before] = total.get((r["label"], before), 0) + 1
            before = ord(c)
    prob = lambda y, p, c: (n.get((y, p, c), 0) + 0.5) / (total.get((y, p), 0) + 0.5 * 65)
    llr = secret_scan.trained(docs)
    assert all(abs(llr[p * 128 + c] - math.log(prob(1, p, c) / prob(0, p, c))) < 1e-5 for p in range(128) for c in range(128))
    texts = ["kJ8s9Qw2Zx7LmN4pRt6Vb1Yc3 words and internationalization_of_things_2024", "a" * 30 + "1 " + "Zk3" * 9 + " 😀x9Kp2mQ7vL4tR8wN3bY6c", None, "", "deadbeef" * 4]
    texts += [r["text"] for r in docs.limit(300).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(df, llr).collect():
        t = r["text"] or ""
        base = [tuple(map(int, s.split(":")[1:])) for s in _base(t).split(",") if s]
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
            codes = [0, *map(ord, m[0])]
            mean = sum(llr[a * 128 + b] for a, b in zip(codes, codes[1:])) / len(m[0])
            if any(c in "0123456789" for c in m[0]) and mean >= secret_scan.MIN_LLR and not any(a < m.end() and m.start() < b for a, b in base):
                want.append((m.start(), m.end()))
        assert [(s["start"], s["end"]) for s in r["all_spans"] if s["kind"] == "markov"] == want


CLASH = "score string, n_words double, lang_pred int, rate string, copies string, residual int, spans int, base_spans int, all_spans int, kept int, segment int, n_chars long, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("clash", 1.5, 1, "r", "c", 1, 1, 1, 1, 1, 1)
    rows = [(*r, *extra, len(r[1] or ""), lang, source) for r, lang, source in zip(ODD, ["en", None, "de", "en", "en", None, "de", "es"], ["a", "a", None, "b", "b", None, "a", "c"])]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")


@pytest.mark.parametrize("name", ["language", "secrets", "mixing", "substrings", "near", "empty"])
def test_odd_rows(spark, odd, name):
    """Every row gives a row; columns that clash with new ones are replaced."""
    none = odd.limit(0)
    if name == "language":
        out = language_id.identify(odd, language_id.fitted(odd)).collect()
        assert len(out) == len(ODD) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in out)
        assert all(r["lang_pred"] == "und" for r in language_id.identify(odd, language_id.fitted(none)).collect())
    elif name == "secrets":
        out = secret_scan.scan(odd, secret_scan.trained(odd)).collect()
        assert len(out) == len(ODD) and not any(r["all_spans"] for r in out)
        assert secret_scan.scan(none, secret_scan.trained(none)).count() == 0
    elif name == "mixing":
        out = mixing.mix(odd, odd, domain_col="source", keep=True)
        assert out.columns.count("rate") == 1 and out.count() == len(ODD) and out.where("rate < 0 or copies < 0").count() == 0
        tied = spark.createDataFrame([(1, "x y"), (2, "x y")], "doc_id long, text string")
        known = spark.createDataFrame([(1, "x y", "b"), (2, "x y", "a")], "doc_id long, text string, lang string")
        assert {r["domain"] for r in mixing.mix(tied, known).collect()} == {"a"}
    elif name == "substrings":
        out = substring_dedup.dedup(odd).collect()
        assert len(out) == len(ODD) and sum(r["n_removed"] > 0 for r in out) == 1
    elif name == "near":
        assert near_dup.classes(odd).count() == len({i for i, _ in ODD if i is not None})
    else:
        assert html_text.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0
        turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string, segment int")
        assert chat_format.digests(chat_format.format_turns(turns)).count() == 0
        clash = spark.createDataFrame([(1, 0, "user", "hi", 7), (1, 0, "user", "hi", 8)], turns.schema)
        assert [r["n_turns"] for r in chat_format.digests(chat_format.format_turns(clash)).collect()] == [2]


def test_pipeline_on_odd_and_empty_tables(spark, sf, odd):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0)):
        first = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, sf), name)
            assert docs.columns[: len(first)] == first
        assert docs.where(F.col("rate") < 0).count() == 0
