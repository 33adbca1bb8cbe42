"""Cases of the review: work that an earlier version left undone."""

from __future__ import annotations

import base64
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate, language_id, mixing, near_dup
from palimpsest.llm.queries import QUERIES

FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen, kieleen, uskontoon, poliittiseen tai muuhun mielipiteeseen, kansalliseen tai yhteiskunnalliseen alkuperään perustuvaa erotusta.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Mindenki, bármely megkülönböztetésre, nevezetesen fajra, színre, nemre, nyelvre, vallásra, politikai vagy bármely más véleményre való tekintet nélkül hivatkozhat a jelen Nyilatkozatban kinyilvánított összes jogokra és szabadságokra.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, di sesso, di lingua, di religione, di opinione politica o di altro genere, di origine nazionale o sociale.",
}


def test_foreign_and_random_long_texts_are_rejected(spark):
    r = random.Random(3)
    words = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(200))
    texts = dict(FOREIGN, letters=words("abcdefghijklmnopqrstuvwxyz"), consonants=words("bcdfghjklmnpqrstvwxz"))
    texts["base64"] = base64.b64encode(bytes(r.randrange(256) for _ in range(3000))).decode()
    texts["hex"] = "".join(r.choice("0123456789abcdef") for _ in range(2000))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fitted(docs)
    df = spark.createDataFrame([*texts.items(), *((f"{k} long", f"{t} " * 8) for k, t in texts.items())], "doc_id string, text string")
    assert [r["doc_id"] for r in language_id.identify(df, model).collect() if not r["rejected"]] == []
    own = language_id.identify(docs.where("n_chars >= 300").select("doc_id", "text"), model).collect()
    assert own and not any(r["rejected"] for r in own)


def test_leaks_without_long_shared_runs(spark):
    item = [f"w{k}" for k in range(24)]
    chunks = lambda n: " ".join(x for a in reversed(range(0, 24, n)) for x in item[a : a + n])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "alpha beta"), (3, "gamma"), (4, "one two three four"), (5, "!!")], "item_id long, text string")
    rows = [
        (1, chunks(3)),
        (2, chunks(4)),
        (3, " ".join("changed" if k % 5 == 4 else x for k, x in enumerate(item))),
        (4, chunks(2)),
        (5, "an Alpha, beta test"),
        (6, "beta alpha of gammas !!"),
        (7, "Gamma"),
        (8, "so one two three it is"),
        (9, "one two and three four"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(1, 1, 24), (2, 1, 24), (3, 1, 20), (5, 2, 2), (7, 3, 1), (8, 4, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == [4, 6, 9]


def test_leaks_are_those_of_tiling_every_item():
    r = random.Random(6)
    for _ in range(150):
        rows = [(k, " ".join(r.choice("abcdef") for _ in range(r.randrange(12)))) for k in range(6)]
        text = " ".join(r.choice("abcdefgh") for _ in range(r.randrange(25)))
        want = []
        for k, t in rows:
            p, d = decontaminate.tokens(t), decontaminate.tokens(text)
            n = sum(x[2] for x in decontaminate.tile(p, d, min(3, len(p)))) if p else 0
            if p and n / len(p) >= 0.7:
                want.append((k, n, len(p), round(n / len(p), 6)))
        assert decontaminate.Items.of(rows).leaks(text, 0.7) == want


def test_mixing_brings_sources_to_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    for out in (QUERIES["op1_mixing"](spark, sf), stage(spark, docs, sf)):
        got = out.select("doc_id", "n_tokens", "rate").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("rate")).alias("t")).collect()
        mean = sum(r["t"] for r in got) / len(got)
        assert len(got) > 1 and all(abs(r["t"] - mean) < 1e-3 * mean for r in got)


def test_mixing_brings_posteriors_to_their_targets_too(spark, sf):
    """Query and pipeline: every row has its posterior, and the rates differ within a source."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    model = mixing.fit(docs, "text", "source", "doc_id")
    soft = mixing.memberships(docs.select("doc_id", "source", "text"), model).select("doc_id", "source", "posterior")
    for out in (QUERIES["op1_mixing"](spark, sf), stage(spark, docs, sf)):
        rows = out.select("doc_id", "n_tokens", "domain", "membership", "rate", "residual").join(soft, "doc_id").collect()
        totals = [sum(r["n_tokens"] * r["rate"] * r["posterior"][j] for r in rows) for j in range(len(model.domains))]
        mean = sum(totals) / len(totals)
        assert all(abs(t - mean) < 1e-3 * mean for t in totals) and all(r["residual"] <= mixing.TOLERANCE for r in rows)
        assert all(r["domain"] == r["source"] and abs(r["membership"] - r["posterior"][model.domains.index(r["source"])]) < 1e-9 for r in rows)
        assert len({round(r["rate"], 6) for r in rows if r["source"] == "src0"}) > 1


def test_both_totals_of_odd_tables(spark):
    """Rows without source count by posterior in either total; the rates are the nearest to 1."""
    rows = [(k, f"a a b {'ab c'[k % 3 :]}", "hot") for k in range(6)] + [(k, f"c {'cd a'[k % 4 :]}", "cold") for k in range(10, 14)] + [(20, "a c d", None), (21, None, "hot"), (22, "", "none"), (None, "b b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit("x"))
    out = {r["doc_id"]: r for r in mixing.mix(df, df, {"hot": 1.0, "cold": 1.0}, domain_col="source", keep=True, both=True).collect()}
    model = mixing.fit(df.where("text <> ''"), "text", "source", "doc_id")
    soft = {r["doc_id"]: r["posterior"] for r in mixing.memberships(df, model).collect()}
    assert len(out) == len(rows) and model.domains == ["cold", "hot"] and all(r["place"] == "x" for r in out.values())
    n = np.array([r["n_tokens"] for r in out.values()], float)
    x = np.array([soft[k] for k in out])
    h = np.array([[float(d == r["source"]) for d in model.domains] if r["source"] in model.domains else soft[k] for k, r in out.items()])
    rate = np.array([r["rate"] for r in out.values()])
    want = n.sum() * np.array([1, 1]) / 2
    for m in (h, x):
        assert np.abs((n * rate) @ m - want).max() < 1e-3 * want.max()
    # What is added to 1 is a sum of the memberships wherever the rate is above 0.
    m, some = np.hstack([h, x]), rate > 0
    fit = np.linalg.lstsq(m[some], 1 - rate[some], rcond=None)[0]
    assert np.abs(m[some] @ fit - (1 - rate[some])).max() < 1e-4 and (m[~some] @ fit >= 1 - 1e-4).all()
    again = {r["doc_id"]: r["rate"] for r in mixing.mix(df.repartition(3), df.repartition(2), {"hot": 1.0, "cold": 1.0}, domain_col="source", both=True).collect()}
    assert again == {k: r["rate"] for k, r in out.items()}
    assert mixing.mix(df.limit(0), df, domain_col="source", both=True).count() == 0
    assert {r["rate"] for r in mixing.mix(df, df.limit(0), domain_col="source", both=True).collect()} == {1.0}
    assert {r["rate"] for r in mixing.mix(df.where("doc_id in (21, 22)"), df, domain_col="source", both=True).collect()} == {1.0}


def test_mixing_with_rows_of_unknown_source(spark):
    rows = [(1, "a a a a", "hot"), (2, "a a b", "hot"), (3, "c c", "cold"), (4, "c c c", None), (5, None, "empty"), (6, "a c", "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df, df.where("source <> 'new'"), domain_col="source").collect()}
    assert [got[k]["membership"] for k in (1, 2, 3, 5)] == [1.0] * 4 and got[4]["membership"] < 1 and got[6]["membership"] < 1
    assert got[1]["domain"] == "hot" and got[4]["domain"] == "cold"


def test_seeds_of_a_large_benchmark_are_joined(spark, monkeypatch):
    """The join and the broadcast find the same leaks, on the tables and on small alphabets."""
    r = random.Random(8)
    words = lambda n, k: " ".join(r.choice("abcdefgh"[:k]) for _ in range(n))
    rows = [(k, words(r.randrange(12), 6)) for k in range(12)] + [(None, "so it is"), (3, None), (5, "!!")]
    odd = [(k, words(r.randrange(40), 8)) for k in range(60)] + [(1, None), (None, "and so it is"), (2, ""), (7, "a b c"), (7, "a b c")]
    small = spark.createDataFrame(odd, "doc_id long, text string").withColumn("key", F.lit("clash")), spark.createDataFrame(rows, "item_id long, text string")
    full = tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    for docs, bench in (small, full):
        for limit in (4_000_000, 10):
            monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", limit)
            found = sorted(map(repr, decontaminate.leaks(docs, bench).collect()))
            left = sorted(map(repr, decontaminate.without_leaks(docs, bench).collect()))
            if limit > 10:
                want = found, left
            assert found and (found, left) == want


def test_running_hashes():
    r = random.Random(2)
    for _ in range(50):
        seq = [r.randrange(5) for _ in range(20)]
        free = [r.random() < 0.8 for _ in seq]
        size = r.randrange(1, 6)
        starts = [i for i in range(len(seq) - size + 1) if all(free[i : i + size])]
        got = list(decontaminate._running(seq, free, size))
        assert [i for i, _ in got] == starts
        by = {}
        for i, h in got:
            by.setdefault(tuple(seq[i : i + size]), set()).add(h)
        assert all(len(x) == 1 for x in by.values()) and len(by) == len({h for _, h in got})


def test_models_do_not_know_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = language_id.fitted(docs), language_id.fitted(docs.repartition(7))
    assert (one.centroids == two.centroids).all() and (one.least == two.least).all() and (one.idf == two.idf).all()
    one, two = (mixing.fit(d, "text", "lang", "doc_id") for d in (docs, docs.repartition(7)))
    assert one.tables == two.tables and one.prior == two.prior
    mixes = [mixing.mix(d, d, {"en": 1.0, "de": 3.0}, known=False).orderBy("doc_id").collect() for d in (docs, docs.repartition(5))]
    assert mixes[0] == mixes[1]


def test_missed_targets_are_told(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    posterior = F.when(F.col("doc_id") == 1, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.2), F.lit(0.8)))
    members = docs.select("doc_id", F.lit(10).cast("long").alias("n_tokens"), posterior.alias("posterior"))
    out = mixing.fit_rates(members, [1.0, 0.0])
    assert not out.converged and out.residual > 0.1 and out.steps == mixing.MAX_STEPS
    assert mixing.fit_rates(members, [0.4, 0.6]).converged


def test_secret_samples_read_whole_texts_and_repeats_once(spark):
    from palimpsest.llm import secret_scan

    rows = [(1, "start and go " * 3000 + " tailword")] + [(2, "same words here")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = [r["token"] for r in secret_scan.labelled_samples(docs, "text", "doc_id").where("label = 0").collect()]
    assert "tailword" in tokens and tokens.count("same") == 1


def test_near_duplicates_shuffle_no_texts(spark, sf, monkeypatch):
    """Texts become vectors before anything is dealt out, and weights are not copied to every band."""
    plans, real = {}, near_dup.staged

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(near_dup, "staged", spy)
    rows = [(k, "one two three four five six seven eight " * (1 + k // 4)) for k in range(8)] + [(9, "a b c d e f"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    assert len(got) == 10 and got[3] == got[0] and got[7] == got[4] and got[9] == 9 and got[10] == 10
    join, made = plans["vectors"].index("Join"), plans["vectors"].index("MapInArrow")
    assert join < made and "Join" not in plans["vectors"][made:] and "parts" not in plans["shared"].split("Join")[0]
    generated = [line for line in plans["shared"].splitlines() if "Generate" in line]
    assert generated and all("parts" not in line and "weight" not in line for line in generated)
    for n in (0, 1, 1000):
        words = near_dup.id_bits(spark.range(n))
        bits = 64 * len(words)
        place = [r["p"] for r in spark.range(n).select(near_dup._place(bits).alias("p")).collect()]
        assert all(words[p >> 6] >> (p & 63) & 1 for p in place) and sum(int(w).bit_count() for w in words.view("uint64")) <= n


def test_posteriors_of_many_domains_without_their_tables_in_the_plan(spark):
    """Texts longer than one block of words as plain sums; tables written into the plan took the driver's memory."""
    rng = np.random.default_rng(5)
    tables = [[round(float(x), 5) for x in -12 * rng.random(mixing.BUCKETS)] for _ in range(21)]
    model = mixing.Classifier([f"s{j:02}" for j in range(21)], [-3.0] * 21, tables)
    words = [f"w{i * i % 977}" for i in range(5000)]
    df = spark.createDataFrame([(n, " ".join(words[:n])) for n in (0, 1, 30, 1789, 5000)], "n int, text string")
    out = mixing.memberships(df, model)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert len(out._jdf.queryExecution().explainString(mode)) < 100_000
    place = {r["w"]: r["b"][0] for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", mixing._buckets(F.col("w")).alias("b")).collect()}
    for r in out.collect():
        z = np.array([sum(t[place[w]] for w in words[: r["n"]]) for t in tables]) * min(1.0, mixing.EVIDENCE_WORDS / max(r["n"], 1))
        e = np.exp(z - z.max())
        assert r["n_tokens"] == r["n"] and np.allclose(r["posterior"], e / e.sum(), atol=1e-9)
