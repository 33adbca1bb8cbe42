"""Language ID by nearest centroid.

Each text becomes a normalised TF-IDF vector of hashed character n-grams.  Every language
has several centroids, the clusters of its training texts; a text takes the language of
the centroid with the largest cosine.  It is rejected if all large clusters are farther
away than nearly all training texts of its length are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, map_rows, sha_uniform

BUCKETS = 8192
CLUSTERS = 4
#: Labelled rows of each language from which centroids are fitted; the idf counts all labelled rows.
SAMPLE_PER_LANGUAGE = 400
#: A text is rejected if its cosine is below this share of the low quantile of the training texts of its length.
REJECT_SHARE = 0.45
LOW_QUANTILE = 0.01
#: Training rows that a length class (doublings of the number of n-grams) needs; shorter classes join longer ones.
LENGTH_ROWS = 50
#: Clusters with a smaller share of their language's training rows are no measure of distance: their rows are their own centroid.
SOLID_SHARE = 0.05
TEMPERATURE = 0.05
PIECE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of letter 1-, 2- and 3-grams by bucket, over the whole text; None without a letter.

    Long texts are read piece by piece with two code points of overlap, so that memory does
    not grow with the text while every n-gram counts once.
    """
    total, any_letter, tail = np.zeros(buckets, np.int64), False, np.zeros(0, np.uint32)
    for at in range(0, len(text), PIECE):
        raw = text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass")
        cp = np.frombuffer(raw, np.uint32)
        alpha = _letters()[cp]
        any_letter |= bool(alpha.any())
        cp = np.concatenate([tail, np.where(alpha, cp, np.uint32(32))])
        new = len(tail)
        tail = cp[-2:]
        one = cp * np.uint32(2654435761)
        two = (one[:-1] ^ (cp[1:] * np.uint32(2246822519) + np.uint32(1))) * np.uint32(3266489917)
        three = (two[:-1] ^ (cp[2:] * np.uint32(668265263) + np.uint32(2))) * np.uint32(374761393)
        shift = np.uint32(32 - (buckets.bit_length() - 1))
        letter = cp != 32
        keep = [one[new:][letter[new:]], two[max(new - 1, 0) :][(letter[:-1] | letter[1:])[max(new - 1, 0) :]]]
        keep.append(three[max(new - 2, 0) :][letter[1:-1][max(new - 2, 0) :]])
        total += np.bincount(np.concatenate(keep) >> shift, minlength=buckets)
    return total if any_letter else None


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # of each centroid: position in languages
    solid: np.ndarray  # of each centroid: whether it measures distance
    edges: np.ndarray  # of each length class but the first: fewest n-grams
    least: np.ndarray  # of each length class: smallest accepted cosine

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, cosine, rejected)"""
        counts = ngram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, 0.0, True
        cos = self.centroids @ unit(counts, self.idf)
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.owner, cos)
        k = int(np.argmax(best))
        soft = np.exp((best - best[k]) / TEMPERATURE)
        bound = self.least[np.searchsorted(self.edges, counts.sum(), "right")]
        return self.languages[k], float(1 / soft.sum()), float(max(best[k], 0.0)), bool(cos[self.solid].max() < bound)


def length_bounds(lengths: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the length classes, and the smallest accepted cosine of each class."""
    level = np.floor(np.log2(np.maximum(lengths, 1))).astype(int)
    starts, rows = [0], 0
    for k in range(level.max() + 1):
        if rows >= LENGTH_ROWS and (level >= k).sum() >= LENGTH_ROWS:
            starts.append(k)
            rows = 0
        rows += int((level == k).sum())
    own = np.searchsorted(starts[1:], level, "right")
    least = [REJECT_SHARE * float(np.quantile(cosines[own == j], LOW_QUANTILE)) for j in range(len(starts))]
    return 2.0 ** np.array(starts[1:]), np.array(least)


def cluster(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with seeds far apart; returns unit centroids and each row's cosine to its own."""
    k = min(k, len(x))
    picks = [int(np.random.default_rng(seed).integers(len(x)))]
    while len(picks) < k:
        picks.append(int(np.argmin((x @ x[picks].T).max(axis=1))))
    c = x[picks].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (own == j).any():
                s = x[own == j].sum(axis=0)
                c[j] = s / max(np.linalg.norm(s), 1e-9)
    return c, (x @ c.T).max(axis=1)


def fit(labelled: DataFrame, text_col: str, lang_col: str, id_col: str | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the rows of ``labelled`` that have a language and a text with a letter.

    About ``per_language`` rows of each language are drawn, by text and id alone, so that the
    model depends on the rows and neither on their order nor on their partitions; rows equal
    in both count once among those drawn.
    """
    own = F.lit(None).cast("string") if id_col is None else F.col(id_col).cast("string")
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), own.alias("id")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0, bool), np.zeros(0), np.zeros(1))

    def document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in b["text"]:
                c = ngram_counts(t)
                if c is not None:
                    df[:-1] += c > 0
                    n += 1
        df[-1] = n
        yield pd.DataFrame({"bucket": np.arange(BUCKETS + 1), "df": df})

    found = rows.mapInPandas(document_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in found:
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(g, h, int(c.sum()), unit(c, idf).astype(np.float16).tobytes()) for g, h, t in zip(b["lang"], b["h"], b["text"]) if (c := ngram_counts(t)) is not None]
            yield pd.DataFrame(out, columns=["lang", "h", "n", "v"])

    draw = None
    for lang, n in sizes.items():
        one = (F.col("lang") == lang) & (sha_uniform(F.struct("text", "id"), "centroids") < per_language / n)
        draw = one if draw is None else draw | one
    drawn = rows.where(draw).withColumn("h", F.xxhash64("text", "id")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = drawn.mapInPandas(vectors, "lang string, h long, n long, v binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"], bytes(r["v"])))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return Model([], idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0, bool), np.zeros(0), np.zeros(1))
    centroids, owner, solid, vectors_of = [], [], [], []
    for k, lang in enumerate(languages):
        x = np.stack([np.frombuffer(r["v"], np.float16) for r in got if r["lang"] == lang]).astype(np.float32)
        c, _ = cluster(x, CLUSTERS)
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            centroids.append(c[j])
            owner.append(k)
            solid.append((own == j).sum() >= SOLID_SHARE * len(x))
        vectors_of.append(x)
    centroids, solid = np.array(centroids, np.float32), np.array(solid)
    cos = np.concatenate([(x @ centroids[solid].T).max(axis=1) for x in vectors_of])
    edges, least = length_bounds(np.array([r["n"] for r in got]), cos)
    return Model(languages, idf, centroids, np.array(owner, int), solid, edges, least)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cosine`` and ``rejected``; one row for each input row.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every
    text where no labelled row has a language and a text with a letter.  Equal
    cosines go to the language first in order.  Input columns named like new ones are
    replaced.  No shuffle; the model (fixed size) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = held.value
        return lambda texts: [m.predict(t) for t in texts]

    return map_rows(docs, [text_col], start, "lang_pred string, score double, cosine double, rejected boolean")


def fitted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """The model learned from the rows that are not held out."""
    bounded_batches(docs.sparkSession)
    return fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col, id_col)


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cosine", "rejected")
