"""Toxicity by nearest labelled examples.

Every text is compared with labelled examples by the exact cosine of TF-IDF vectors over the
whole vocabulary: words and their beginnings, hashed to ``TERMS`` terms.  The examples stand
in an inverted index whose postings are cut into blocks of examples; each block keeps the
largest weight of every term, which bounds the cosine of all its examples, so that blocks
which cannot reach the k best are skipped.  The neighbours vote, weighted by their closeness,
and the votes are calibrated against the examples, each scored without itself.

A term weighs its idf times ``BASE + LABEL_GAIN`` x its correlation with label 1 (phi, from
the examples, at least 0), so no term is left out; ``gain=0`` gives the plain TF-IDF.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, map_rows, sha_uniform, staged

#: Labelled rows of each label from which the examples are drawn; idf counts all documents.
SAMPLE_PER_LABEL = 1000
TERM_BITS = 18
TERMS = 1 << TERM_BITS
#: Besides whole words, beginnings of this many letters count as terms, which catches compounds.
BEGINNINGS = (4, 6)
BASE, LABEL_GAIN = 0.02, 4.0
NEIGHBOURS = 16
BLOCK = 64
#: Blocks of the largest bounds, read first; of the others those are read that can still hold one of the best.
FIRST_BLOCKS = 4
#: A term is frequent if more than one row in this many has it.
FREQUENT = 8
#: A neighbour's vote is divided by this number less its cosine.
CLOSENESS = 1.05
PIECE = 1 << 20
_U = np.uint64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters; odd multipliers by place in a word, the same everywhere."""
    letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return letters, np.random.default_rng(606).integers(1, 1 << 63, 4096, dtype=np.uint64) * _U(2) + _U(1)


def _terms_of(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + _U(kind)) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (h >> _U(64 - TERM_BITS)).astype(np.int32)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of the whole lower-cased text, ascending, and their counts.

    Long texts are read piece by piece; a piece ends at white space if there is any.
    """
    letters, places = _tables()
    found, at = [], 0
    text = text or ""
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        cp = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        at = end
        inside = letters[cp]
        edge = np.zeros(len(cp) + 1, bool)
        edge[0], edge[1:-1], edge[-1] = inside[0], inside[1:] != inside[:-1], inside[-1]
        bounds = np.flatnonzero(edge)
        if not len(bounds):
            continue
        size = bounds[1::2] - bounds[::2]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        h = cp[inside].astype(np.uint64) * places[place & 4095]
        found.append(_terms_of(np.add.reduceat(h, first), 0))
        for k in BEGINNINGS:
            longer = size > k
            if longer.any():
                heads = (first[longer, None] + np.arange(k)).ravel()
                found.append(_terms_of(h[heads].reshape(-1, k).sum(axis=1, dtype=np.uint64), k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.diff(every, prepend=-1))
    return every[first].astype(np.int64), np.diff(first, append=len(every))


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers from each ``lo`` on, ``n`` of each, one after another."""
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


@dataclass
class Index:
    """Inverted index of unit vectors: postings by term, in blocks of ``BLOCK`` rows, with block maxima.

    Terms that many rows have are also spread out, one value for each row, where the index is
    used: their share of the cosines is read first, for all rows, and makes the bounds exact
    but for the rarer terms, whose postings are read only in blocks that can hold one of the best.
    """

    rows: np.ndarray  # of each posting, ascending within a term
    values: np.ndarray
    starts: np.ndarray  # of each term: its first entry, an entry being a term's postings in one block
    block: np.ndarray  # of each entry
    top: np.ndarray  # of each entry: the largest value
    postings: np.ndarray  # of each entry: its first posting, and the end of all
    size: int  # rows
    spread: np.ndarray | None = None  # of each frequent term: a value for each row, rows filled up to whole blocks
    place: np.ndarray | None = None  # of each term: its position in ``spread``, or -1

    @staticmethod
    def of(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        """Of (ascending terms, values) by row."""
        sizes = [len(t) for t, _ in vectors]
        rows = np.repeat(np.arange(len(vectors)), sizes)
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        values = np.concatenate([np.zeros(0, np.float32), *(v for _, v in vectors)]).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        rows, terms, values = rows[order], terms[order], values[order]
        key = terms * (len(vectors) // BLOCK + 1) + rows // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        top = np.maximum.reduceat(values, first) if len(first) else np.zeros(0, np.float32)
        starts = np.searchsorted(terms[first], np.arange(TERMS + 1)).astype(np.int32)
        return Index(rows.astype(np.int32), values, starts, (rows[first] // BLOCK).astype(np.int32), top, np.append(first, len(rows)).astype(np.int64), len(vectors))

    def _spread_out(self) -> None:
        """At most ``FREQUENT`` x the mean number of terms of a row are frequent, which bounds the table."""
        ends = self.postings[self.starts]
        frequent = np.flatnonzero(np.diff(ends) * FREQUENT > self.size)
        self.place = np.full(TERMS, -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        self.spread = np.zeros((len(frequent), -(-self.size // BLOCK) * BLOCK), np.float32)
        for k, t in enumerate(frequent):
            at = slice(ends[t], ends[t + 1])
            self.spread[k, self.rows[at]] = self.values[at]

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest rows with a positive cosine, nearest first, then by row."""
        if self.spread is None:
            self._spread_out()
        rows, sims, least = np.zeros(0, int), np.zeros(0), 0.0
        if not self.size:
            return rows, sims
        place = self.place[terms]
        frequent = place >= 0
        base = q[frequent] @ self.spread[place[frequent]]
        terms, q = terms[~frequent], q[~frequent]
        lo = self.starts[terms].astype(np.int64)
        n = self.starts[terms + 1] - lo
        entries, weight = _ranges(lo, n), np.repeat(q, n)
        block = self.block[entries]
        bound = base.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, weights=self.top[entries] * weight, minlength=len(base) // BLOCK)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        for part in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            part = part[bound[part] + 1e-5 >= least]
            if not len(part):
                break
            chosen = np.zeros(len(bound), bool)
            chosen[part] = True
            own = chosen[block]
            e = entries[own]
            p = _ranges(self.postings[e], m := self.postings[e + 1] - self.postings[e])
            cosine = base + np.bincount(self.rows[p], weights=self.values[p] * np.repeat(weight[own], m), minlength=len(base))
            if skip is not None:
                cosine[skip] = 0
            hit = np.flatnonzero(np.repeat(chosen, BLOCK) & (cosine > 0) & (cosine >= least))
            rows, sims = np.concatenate([rows, hit]), np.concatenate([sims, cosine[hit]])
            best = np.lexsort((rows, -sims))[:k]
            rows, sims = rows[best], sims[best]
            least = float(sims[-1]) if len(rows) == k else 0.0
        return rows, sims


@dataclass
class Model:
    weight: np.ndarray  # of each term
    index: Index
    y: np.ndarray
    heft: np.ndarray  # labelled rows that an example stands for
    ids: np.ndarray
    empty: float  # score of a text without a neighbour
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # raw votes, ascending
    calibrated: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # share of label 1 at each knot, not decreasing

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.weight[terms]
        return (v / np.sqrt(v @ v)).astype(np.float32)

    def votes(self, text: str | None, own: int | None = None) -> tuple[float, np.ndarray, np.ndarray] | None:
        """(share of label 1 among the weighted votes, rows, cosines); examples of the id ``own`` have no vote."""
        terms, counts = term_counts(text)
        if not len(terms):
            return None
        skip = None if own is None else np.flatnonzero(self.ids == own)
        rows, sims = self.index.nearest(terms, self.vector(terms, counts), NEIGHBOURS, skip)
        if not len(rows):
            return None
        w = self.heft[rows] / (CLOSENESS - np.minimum(sims, 1.0))
        return float((w * self.y[rows]).sum() / w.sum()), rows, sims

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        got = self.votes(text)
        if got is None:
            return self.empty, [], []
        raw, rows, sims = got
        p = float(np.interp(raw, self.knots, self.calibrated))
        return p, [int(i) for i in self.ids[rows[:3]]], [round(float(s), 4) for s in sims[:3]]


def _isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators; knots and their non-decreasing shares."""
    order = np.lexsort((w, y, raw))
    pools: list[list[float]] = []
    for r, t, u in zip(raw[order], y[order], w[order]):
        pools.append([u, u * t, r, r])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2], b[3]]
    xs, ps = [], []
    for u, s, lo, hi in pools:
        p = (s + 0.05) / (u + 0.1)
        xs += [lo, hi] if hi > lo else [lo]
        ps += [p, p] if hi > lo else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


def label_weights(terms: list[np.ndarray], y: np.ndarray, gain: float) -> np.ndarray:
    """``BASE`` plus ``gain`` x phi, the correlation of having the term with label 1, where that is positive."""
    if not gain:
        return np.ones(TERMS)
    a, c = np.zeros(TERMS), np.zeros(TERMS)
    for t, one in zip(terms, y):
        (a if one else c)[t] += 1
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    some = a + c
    scale = np.sqrt(np.maximum(some * (n1 + n0 - some) * n1 * n0, 1e-9))
    return BASE + gain * np.maximum(0.0, (a * (n0 - c) - c * (n1 - a)) / scale)


def fit(labelled: DataFrame, docs: DataFrame, text_col: str = "text", per_label: int = SAMPLE_PER_LABEL, gain: float = LABEL_GAIN) -> Model:
    """A model of ``labelled`` (id, label; each id once) and the texts of ``docs`` (id, text).

    About ``per_label`` rows of each label are drawn by id, before the join, so that the side
    that is broadcast is bounded; of different texts under one id the first in order is
    taken.  The idf of the terms counts all of ``docs``.  The model depends on the rows
    alone, not on their order or partitions.
    """
    spark = docs.sparkSession
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    share = {k: min(1.0, per_label / n) for k, n in sizes.items()}
    draw = F.lit(False)
    for k, s in share.items():
        draw = draw | ((F.col("label") == k) & (sha_uniform(F.col("id"), "examples") < s))
    few = labelled.where(draw).select("id", F.col("label").cast("int").alias("label"))
    sample = docs.join(F.broadcast(few), "id").groupBy("id").agg(F.min("label").alias("label"), F.min(F.col(text_col)).alias("text"))
    sample = staged(sample, "examples")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [term_counts(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "t": [t.astype(np.int32).tobytes() for t, _ in got], "n": [n.astype(np.int32).tobytes() for _, n in got]})

    rows = sorted(sample.mapInPandas(pack, "id long, label int, t binary, n binary").collect(), key=lambda r: r["id"])
    terms = [np.frombuffer(r["t"], np.int32).astype(np.int64) for r in rows]
    counts = [np.frombuffer(r["n"], np.int32) for r in rows]
    y = np.array([r["label"] for r in rows], float)
    heft = np.array([1 / share[r["label"]] for r in rows], float)
    ids = np.array([r["id"] for r in rows], np.int64)

    def document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(TERMS, np.int64), 0
        for b in batches:
            n += len(b)
            for t in b[text_col]:
                df[term_counts(t)[0]] += 1
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(some, TERMS), "df": np.append(df[some], n)})

    # Each task sends at most one row for a term; the table has a fixed size.
    got = docs.select(text_col).mapInPandas(document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(TERMS + 1)
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    total = float(heft.sum())
    base = float((heft * y).sum()) / total if total else 0.0
    model = Model(idf * label_weights(terms, y, gain), Index.of([]), y, heft, ids, base)
    # Examples alike stand in the same blocks, which keeps the bounds of blocks tight.
    vectors = [model.vector(t, n) if len(t) else np.zeros(0, np.float32) for t, n in zip(terms, counts)]
    heads = np.array([t[np.argmax(v)] if len(t) else -1 for t, v in zip(terms, vectors)], np.int64)
    order = np.lexsort((ids, heads, y)) if len(ids) else np.zeros(0, int)
    model.index = Index.of([(terms[k], vectors[k]) for k in order])
    model.y, model.heft, model.ids = y[order], heft[order], ids[order]
    del terms, counts, vectors

    # Votes of the examples, each without itself.
    held = spark.sparkContext.broadcast(model)

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            votes = [m.votes(t, own=i) for i, t in zip(b["id"], b["text"])]
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "raw": [v[0] if v else None for v in votes]}, columns=["id", "label", "raw"])

    back = sorted(sample.mapInPandas(leave_out, "id long, label int, raw double").collect(), key=lambda r: r["id"])
    alone = [r for r in back if r["raw"] is None or r["raw"] != r["raw"]]
    voted = [r for r in back if not (r["raw"] is None or r["raw"] != r["raw"])]
    weights = lambda rs: np.array([1 / share[r["label"]] for r in rs], float)
    labels_of = lambda rs: np.array([r["label"] for r in rs], float)
    model.empty = float((weights(alone) * labels_of(alone)).sum() + base) / float(weights(alone).sum() + 1)
    if voted:
        model.knots, model.calibrated = _isotonic(np.array([r["raw"] for r in voted]), labels_of(voted), weights(voted))
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``evidence`` (ids of examples) and ``similarity``.

    One row for each input row; a null or empty text, and one that shares no term with an
    example, gets the share of label 1 among such examples, drawn towards that of all.  Of
    equally near examples the first in the index counts.  Input columns named like new ones
    are replaced.  No shuffle; the model, bounded by the sample, is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = held.value
        return lambda texts: [(s, int(s >= 0.5), e, z) for s, e, z in map(m.score, texts)]

    return map_rows(docs, [text_col], start, "score double, predicted int, evidence array<long>, similarity array<double>")


def fitted(docs: DataFrame, labels: DataFrame, gain: float = LABEL_GAIN) -> Model:
    """Learned from labelled rows that are not held out; of contradicting labels the larger holds."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    return fit(known, docs.select(F.col("doc_id").alias("id"), "text"), gain=gain)


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_texts(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", "similarity")
