"""Benchmark decontamination by greedy string tiling.

The longest matches between unmarked tokens of a document and a benchmark item are marked,
again and again, down to ``MIN_TILE`` tokens.  An item is leaked if its tiles cover
``MIN_COVERAGE`` of its tokens; since tiles may lie in any order, a passage whose parts have
been moved about is still caught.  Tiles lie in runs of ``MIN_TILE`` tokens that both sides
have, so an item is tiled only if such runs cover enough of it: this loses no leak.  An item
shorter than ``MIN_TILE`` tokens is leaked where it stands as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged

WORD = re.compile(r"\w+")
MIN_TILE = 3
MIN_COVERAGE = 0.7
#: Characters of benchmark text that are broadcast at most; the seeds of a larger benchmark are joined.
BROADCAST_CHARS = 4_000_000
#: Bits of the filter (of fixed size) that keeps runs which no item has out of that join.
FILTER_BITS = 24
_MUL = 0x9E3779B97F4A7C15
#: Modulus and base of the running hashes of the tiling.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores of the whole text."""
    return WORD.findall(text.lower())


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of ``width`` numbers, as differences of a running sum."""
    factor = np.full(len(ids) + 1, _MUL, np.uint64)
    factor[0] = 1
    power = np.cumprod(factor)
    inverse = np.full(len(ids), pow(_MUL, -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * np.cumprod(inverse), out=total[1:])
    return (total[width:] - total[:-width]) * power[: len(ids) - width + 1]


def _running(seq: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of all windows of ``size`` free tokens; the hash runs along from window to window."""
    gone = pow(_BASE, size, _PRIME)
    run = h = 0
    for j, x in enumerate(seq):
        if not free[j]:
            run = h = 0
            continue
        h = (h * _BASE + x + 2) % _PRIME
        run += 1
        if run > size:
            h = (h - (seq[j - size] + 2) * gone) % _PRIME
        if run >= size:
            yield j - size + 1, h


def tile(pattern: list, text: list, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (start in pattern, start in text, length), longest first.

    Equal lengths go by start in the pattern, then in the text.  Windows of the current
    length are met by their running hashes, compared, and extended.  Tokens that the pattern
    lacks split the text into stretches, of which those shorter than ``least`` are left out.
    """
    numbers: dict = {}
    pattern = [numbers.setdefault(x, len(numbers)) for x in pattern]
    text = [numbers.get(x, -1) for x in text]
    free_p, free_t = [True] * len(pattern), [x >= 0 for x in text]
    tiles: list[tuple[int, int, int]] = []
    size = len(pattern)
    while size >= least:
        seen: dict[int, list[int]] = {}
        for start, h in _running(text, free_t, size):
            seen.setdefault(h, []).append(start)
        matches = []
        for start, h in _running(pattern, free_p, size) if seen else ():
            for at in seen.get(h, ()):
                if text[at : at + size] == pattern[start : start + size]:
                    n = size
                    while start + n < len(pattern) and at + n < len(text) and free_p[start + n] and free_t[at + n] and pattern[start + n] == text[at + n]:
                        n += 1
                    matches.append((-n, start, at))
        matches.sort()
        for n, start, at in matches:
            n = -n
            if all(free_p[start : start + n]) and all(free_t[at : at + n]):
                free_p[start : start + n] = [False] * n
                free_t[at : at + n] = [False] * n
                tiles.append((start, at, n))
        longest_left = 0
        for n, start, at in matches:  # what a marked tile has cut off may still be long enough
            k = 0
            while k < -n:
                run = 0
                while k < -n and free_p[start + k] and free_t[at + k]:
                    run, k = run + 1, k + 1
                longest_left = max(longest_left, run)
                k += 1
        size = longest_left if longest_left >= size else (size // 2 if size // 2 >= least else (least if size > least else least - 1))
    return sorted(tiles, key=lambda t: (-t[2], t[0], t[1]))


@dataclass
class Grams:
    """Runs of ``width`` tokens in a block of the benchmark, by hash, with all their places."""

    width: int
    hashes: np.ndarray  # ascending, without repeats
    ends: np.ndarray  # of each hash: where its places start, and the end
    places: np.ndarray  # first tokens of the runs, counted through all items of the block

    @staticmethod
    def of(width: int, parts: list[tuple[int, list[int]]]) -> Grams:
        """``parts``: (place of the first token, tokens) of the items."""
        hs = [_rolling(np.array(ts), width) for _, ts in parts]
        h = np.concatenate([np.zeros(0, np.uint64), *hs])
        at = np.concatenate([np.zeros(0, np.int64), *(a + np.arange(len(x)) for (a, _), x in zip(parts, hs))])
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        return Grams(width, hashes, np.append(first, len(h)), at[order])

    def covered(self, ids: np.ndarray) -> np.ndarray:
        """Places of the benchmark's tokens that lie in runs that ``ids`` has too; -1 is no word of the benchmark."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes) or len(ids) < self.width:
            return none
        known = np.convolve(ids >= 0, np.ones(self.width, np.int64), "valid") == self.width
        if not known.any():
            return none
        h = _rolling(ids, self.width)[known]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.unique(at[self.hashes[at] == h])
        if not len(hit):
            return none
        starts = np.concatenate([self.places[self.ends[k] : self.ends[k + 1]] for k in hit.tolist()])
        return np.unique((starts[:, None] + np.arange(self.width)).ravel())


@dataclass
class Items:
    """A block of the benchmark: its words, token numbers and runs."""

    ids: list[int]
    tokens: list[list[int]]
    words: dict[str, int]
    owner: np.ndarray  # of each place: the item
    grams: list[Grams]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        words: dict[str, int] = {}
        toks = [[words.setdefault(w, len(words)) for w in tokens(t or "")] for _, t in rows]
        sizes = [len(ts) for ts in toks]
        starts = np.cumsum([0, *sizes]).tolist()
        grams = [Grams.of(w, [(a, ts) for a, ts in zip(starts, toks) if min(len(ts), MIN_TILE) == w]) for w in range(1, MIN_TILE + 1)]
        return Items([i for i, _ in rows], toks, words, np.repeat(np.arange(len(toks)), sizes), grams)

    def leaks(self, text: str | None, coverage: float) -> list[tuple[int, int, int, float]]:
        """(item, matched tokens, tokens, coverage) of the items that ``text`` leaks."""
        if not text or not len(self.owner):
            return []
        get = self.words.get
        toks = tokens(text)
        ids = np.fromiter((get(w, -1) for w in toks), np.int64, len(toks))
        places = np.concatenate([g.covered(ids) for g in self.grams])
        out = []
        listed = ids.tolist() if len(places) else []
        found, most = np.unique(self.owner[places], return_counts=True)
        for k, m in zip(found.tolist(), most.tolist()):
            size = len(self.tokens[k])
            if m / size < coverage:
                continue
            n = sum(t[2] for t in tile(self.tokens[k], listed, min(MIN_TILE, size)))
            c = n / size
            if c >= coverage:
                out.append((self.ids[k], n, size, round(c, 6)))
        return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Distinct (i, t) of the benchmark without null texts, and whether they may be broadcast."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    return rows, (rows.agg(F.sum(F.length("t"))).first()[0] or 0) <= BROADCAST_CHARS


def _in_order(rows) -> list[tuple[int, str]]:
    return sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


FOUND = "item_id long, n_matched long, n_tokens long, coverage double"


def _word_grams(text: str | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width up to ``MIN_TILE`` the distinct runs of so many tokens: signed hashes, and how often each occurs."""
    toks = tokens(text or "")
    ids = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in toks], np.uint64)
    out = {}
    for width in range(1, min(MIN_TILE, len(ids)) + 1):
        h, n = np.unique(_rolling(ids, width) * np.uint64(2 * width + 1), return_counts=True)
        out[width] = h.view(np.int64), n
    return out


def _joined_leaks(texts: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """(key, item_id, n_matched, n_tokens, coverage) of ``texts`` (key, text; each text once), by a join of seeds.

    Seeds are the runs of ``MIN_TILE`` tokens of an item (all its tokens, if it is shorter).
    A run of w tokens that occurs m times covers at most w x m tokens: only pairs whose
    shared runs could cover enough are tiled, which loses no leak.  Texts are listed by runs
    that a filter of 2^``FILTER_BITS`` bits of the items' runs lets through; Spark splits the
    runs that many texts share.  Nothing but the filter is collected.
    """
    spark = texts.sparkSession
    items = staged(items.withColumn("item", F.xxhash64("i", "t")), "items")

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, t in zip(b["item"], b["t"]):
                size = len(tokens(t))
                if size:
                    width = min(size, MIN_TILE)
                    out += [(g, item, size, width * n) for g, n in zip(*(x.tolist() for x in _word_grams(t)[width]))]
            yield pd.DataFrame(out, columns=["g", "item", "size", "most"])

    seeds = staged(items.select("item", "t").mapInPandas(of_items, "g long, item long, size int, most long"), "seeds")
    bit = F.pmod("g", F.lit(1 << FILTER_BITS))
    words = seeds.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(g, {1 << FILTER_BITS}) % 64 as int))")).alias("bits"))
    got = words.toPandas()
    mask = np.zeros(1 << FILTER_BITS - 6, np.int64)
    mask[got["w"].to_numpy()] = got["bits"].to_numpy()
    held = spark.sparkContext.broadcast(mask.view(np.uint64))

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for b in batches:
            keys, grams = [], []
            for key, t in zip(b["key"], b["text"]):
                for h, _ in _word_grams(t).values():
                    at = h.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                    h = h[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                    keys += [key] * len(h)
                    grams += h.tolist()
            yield pd.DataFrame({"key": keys, "g": grams}, columns=["key", "g"])

    shared = texts.mapInPandas(of_texts, "key binary, g long").join(seeds, "g")
    pairs = shared.groupBy("key", "item").agg(F.sum("most").alias("most"), F.first("size").alias("size"))
    pairs = staged(pairs.where(F.least(F.col("most"), F.col("size")) >= F.col("size") * F.lit(coverage - 1e-9)).select("key", "item"), "pairs")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, i, t in zip(b["key"], b["text"], b["i"], b["t"]):
                out += [(key, *r) for r in Items.of([(None if pd.isna(i) else int(i), t)]).leaks(text, coverage)]
            yield pd.DataFrame(out, columns=["key", "item_id", "n_matched", "n_tokens", "coverage"])

    both = pairs.join(texts, "key").join(items, "item").select("key", "text", "i", "t")
    return staged(both.mapInPandas(verify, f"key binary, {FOUND}"), "leaks")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("__key", F.unhex(F.sha2(F.col(text_col), 256)))


def _distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    texts = _keyed(docs.where(F.col(text_col).isNotNull()), text_col)
    return staged(texts.groupBy(F.col("__key").alias("key")).agg(F.first(text_col).alias("text")), "texts")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row (document id, item_id, n_matched, n_tokens, coverage) for each leaked item of each input row.

    Null texts and items without a token leak nothing.  A document row that stands twice is
    reported twice.  A benchmark of up to ``BROADCAST_CHARS`` goes to all tasks and documents
    are not shuffled; the seeds of a larger one are joined, with the same result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, small = _items(benchmark, item_col, "text")
    base = docs.select(id_col, text_col)
    if not small:
        found = _joined_leaks(_distinct_texts(base, text_col), rows, coverage).withColumnRenamed("key", "__key")
        return _keyed(base, text_col).select(id_col, "__key").join(found, "__key").drop("__key")
    schema = T.StructType([base.schema[id_col]] + T._parse_datatype_string(FOUND).fields)
    held = spark.sparkContext.broadcast(Items.of(_in_order(rows.collect())))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for r in held.value.leaks(t, coverage):
                    at.append(k)
                    rows.append(r)
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            made = [pa.array(list(c), x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *made], names=schema.names)

    return base.mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that leak no item; as in ``leaks``, a large benchmark is joined."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, small = _items(benchmark, item_col, "text")
    if not small:
        found = _joined_leaks(_distinct_texts(docs.select(text_col), text_col), rows, coverage).select(F.col("key").alias("__key"))
        return _keyed(docs, text_col).join(found, "__key", "left_anti").select(*docs.columns)
    at = docs.schema.names.index(text_col)
    held = spark.sparkContext.broadcast(Items.of(_in_order(rows.collect())))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([not held.value.leaks(t, coverage) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def leaks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
