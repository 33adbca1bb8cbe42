"""Suffix-array dedup: remove every byte covered by a ``LENGTH``-byte string that starts twice.

A window of ``LENGTH`` bytes is filed under the smallest hash of its ``GRAM``-byte
substrings, which depends on its bytes alone, so that equal windows are filed together.  A
region is a run of windows under one hash; regions are told apart by digests, and only
regions that share a hash with another one, or have it twice, can hold repeated windows.

* A region that occurs twice or more is repeated as a whole.
* The others go, one copy of each, to shards by their hash.  A shard's regions form one
  text, of which a suffix array (induced sorting) and permuted common prefixes give the
  repeated windows.
* Where one hash has more than ``HOT_BYTES`` of regions, for example a passage that very
  many documents share between different neighbours, its regions are split by where the
  128 bytes stand in the window: windows that have them in one half of the places share
  more bytes, by which they are filed anew.  Halves are halved until no group is too large;
  a half that occurs twice as a whole is repeated, and one copy of it goes on.

A passage of more than 50 words may have fewer than ``LENGTH`` bytes, so that nothing of it is
removed.  Beside the removal, ``n_shared_words`` counts the words of all runs of ``WORDS`` words that
another row has too.  Such runs are filed under the smallest hash of their ``WORD_GRAM``-word
substrings; those under a hash of two texts or more are compared by 64-bit hashes of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, bounded_batches, map_rows, staged
from .suffix_array import repeated_starts

LENGTH = 400
GRAM = 128
WORDS = 51
WORD_GRAM = 8
SHARD_BYTES = 1_000_000
HOT_BYTES = 200_000
CHUNK = 1 << 20
WORD_CHUNK = 1 << 16
_U = np.uint64
_SPACE = np.isin(np.arange(256), np.frombuffer(WS_CHARS.encode(), np.uint8))
_BYTE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """63-bit hashes of all substrings of ``GRAM`` bytes, a power of two, by doubling."""
    h, mul, k = _BYTE[b], 0x9E3779B97F4A7C15, 1
    while k < GRAM:
        h = h[:-k] * _U(mul) + h[k:]
        mul = mul * mul % (1 << 64)
        k *= 2
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(32))) >> _U(1)


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    m, k = h, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = width - k
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def regions(b: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, bool]]:
    """(first window, last window, hash, whether the hash occurs twice in the region) in order.

    Long texts are read in chunks; a chunk's last run is read again with the next chunk.
    """
    last, at, chunk = len(b) - length, 0, CHUNK
    while at <= last:
        stop = min(at + chunk, last + 1)
        h = _gram_hashes(b[at : stop - 1 + length])
        m = _window_minima(h, length - GRAM + 1)
        cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(m)]]) - 1
        if stop <= last:
            if len(starts) == 1:
                chunk *= 2
                continue
            starts, ends = starts[:-1], ends[:-1]
        for s, e in zip(starts.tolist(), ends.tolist()):
            twice = int(np.count_nonzero(h[s : e + length - GRAM + 1] == m[s])) > 1
            yield at + s, at + e, int(m[s]), twice
        at, chunk = at + int(ends[-1]) + 1, CHUNK


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2^64, and their inverses."""
    one = 0x9E3779B97F4A7C15
    base = np.array([[one], [pow(one, -1, 1 << 64)]], np.uint64).repeat(n, axis=1)
    base[:, 0] = 1
    return tuple(np.cumprod(base, axis=1, dtype=np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in order, and where they start; a text is read in chunks, a word longer than one by its digest."""
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = _SPACE[b]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        at = int(starts[lo])
        hi = int(np.searchsorted(ends, at + WORD_CHUNK, side="right"))
        if hi == lo:
            out[lo] = _digest(b[at : int(ends[lo])].tobytes()) % (1 << 64)
            lo += 1
            continue
        stop = int(ends[hi - 1])
        up, down = _powers(1 << (stop - at).bit_length())
        total = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(_BYTE[b[at:stop]] * up[: stop - at], out=total[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = _mixed((total[e] - total[s]) * down[s])
        lo = hi
    return out, starts


def _run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` symbols, by doubling and, for the rest, two runs that overlap."""
    mul, k = 0x9E3779B97F4A7C15, 1
    while 2 * k <= width:
        h = h[:-k] * _U(mul) + h[k:]
        mul = mul * mul % (1 << 64)
        k *= 2
    h, rest = _mixed(h), width - k
    return _mixed(h[:-rest] * _U(0x9E3779B97F4A7C15) + h[rest:]) if rest else h


def _filed(h: np.ndarray, words: int) -> np.ndarray:
    """For each run of ``words`` of the words ``h`` the hash under which it is filed."""
    gram = min(WORD_GRAM, words)
    return _window_minima(_run_hashes(h, gram), words - gram + 1).view(np.int64)


def _grams(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) for the hashes under which the texts' runs of words are filed; all texts at once."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    h, at = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    if len(h) < words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text, filed = np.searchsorted(ends, at, side="right"), _filed(h, words)
    first = text[: len(filed)]
    new = np.ones(len(filed), bool)
    new[1:] = (filed[1:] != filed[:-1]) | (first[1:] != first[:-1])
    new &= first == text[words - 1 :]
    return first[new], filed[new]


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _with_key(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts go by their digest: equal texts lose the same bytes, whatever their ids."""
    return docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))


def repeated_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """(key, found, shared): for each text digest the repeated windows as (hash, region, ranges), and
    the number of words in runs of ``words`` words that another text has too.

    ``ranges`` are pairs of offsets of first and last windows in the region; null is all.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = _with_key(docs, text_col).select(F.col("__key").alias("key"), F.col(text_col).alias("text"))

    def list_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t in zip(batch["key"], batch["text"]):
                data, seen = _bytes(t), {}
                for s, e, fp, twice in regions(np.frombuffer(data, np.uint8), length):
                    k = (fp, _digest(data[s : e + length]))
                    seen[k] = (seen[k][0] + 1 if k in seen else 1, e - s + length, twice)
                out += [(key, fp, rd, n, size, twice) for (fp, rd), (n, size, twice) in seen.items()]
            yield pd.DataFrame(out, columns=["key", "fp", "rd", "n", "size", "twice"])

    long_texts = texts.where(F.octet_length("text") >= min(length, 2 * words - 1))
    at = staged(long_texts.mapInPandas(list_regions, "key binary, fp long, rd long, n int, size int, twice boolean"), "regions")
    kinds = at.groupBy("fp", "rd").agg(
        F.sum("n").alias("n"), F.min("key").alias("key"), F.max("size").cast("long").alias("size"), F.max("twice").alias("twice")
    )
    kinds = staged(kinds, "kinds")
    per = kinds.groupBy("fp").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("bytes"), F.max(F.col("n") == 1).alias("open"), F.max("twice").alias("self")
    )
    per = per.where(F.col("open") & ((F.col("kinds") > 1) | F.col("self"))).select("fp", (F.col("bytes") > HOT_BYTES).alias("hot"))
    needed = staged(kinds.join(per, "fp").select("fp", "rd", "n", "key", "size", "hot"), "needed")

    def list_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, k, lo = [_bytes(t) for t in batch["text"]], batch["k"].to_numpy(), 0
            while lo < len(data):
                hi, size = lo, 0
                while hi < len(data) and size < CHUNK:
                    size, hi = size + len(data[hi]), hi + 1
                text, gram = _grams(data[lo:hi], words)
                yield pd.DataFrame({"k": k[lo:hi][text], "gram": gram})
                lo = hi

    def of_two(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy(by).agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select(by)

    k = F.xxhash64("key").alias("k")
    grams = staged(long_texts.select(k, "text").mapInPandas(list_grams, "k long, gram long"), "grams")
    asked = grams.join(of_two(grams, "gram"), "gram").groupBy("k").agg(F.collect_set("gram").alias("grams"))
    keys = long_texts.select("key", k).distinct()
    asked = asked.join(keys, "k").select("key", "grams")

    # The bytes of one copy of every region that has to be looked at; every run of words that has to be.
    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, runs = [], []
            for k, t, want, grams in zip(batch["k"], batch["text"], batch["want"], batch["grams"]):
                data, left = _bytes(t), {(w["fp"], w["rd"]): w for w in ([] if want is None else want)}
                if grams is not None:
                    h, _ = word_hashes(np.frombuffer(data, np.uint8))
                    at = np.flatnonzero(np.isin(_filed(h, words), grams))
                    runs.append((k, _run_hashes(h, words).view(np.int64)[at], at.astype(np.int32)))
                if not left:
                    continue
                for s, e, fp, _ in regions(np.frombuffer(data, np.uint8), length):
                    w = left.pop((fp, _digest(data[s : e + length])), None) if any_of(left, fp) else None
                    if w:
                        out.append((w["fp"], w["rd"], w["n"] == 1, w["hot"], data[s : e + length]))
                    if not left:
                        break
            regions_cut = pd.DataFrame(out, columns=["fp", "rd", "alone", "hot", "data"])
            yield regions_cut.assign(k=0, runs=None, at=None)
            yield pd.DataFrame(runs, columns=["k", "runs", "at"]).assign(fp=0, rd=0, alone=False, hot=False, data=None)[CUT_COLUMNS]

    def any_of(left: dict, fp: int) -> bool:
        return any(k[0] == fp for k in left) if len(left) < 8 else True

    wanted = needed.groupBy("key").agg(F.collect_list(F.struct("fp", "rd", "n", "hot")).alias("want"))
    # One copy of each text, found before anything is moved: a task sends a text once, however many copies it has.
    once = long_texts.groupBy("key").agg(F.first("text").alias("text"))
    found = once.join(wanted.join(asked, "key", "full"), "key").select(k, "text", "want", "grams")
    cut = staged(found.mapInPandas(cut_out, CUT), "cut")
    runs = cut.where("runs is not null").select("k", F.inline(F.arrays_zip(F.col("runs").alias("run"), F.col("at").alias("at"))).alias("run", "at"))
    cut = cut.where("runs is null").drop("k", "runs", "at")

    cold = cut.where(~F.col("hot")).select(F.col("fp").alias("g"), F.col("rd").alias("k"), "fp", "rd", F.lit(0).alias("lo"), "alone", "data")
    ready, repeated = [cold], []
    rows = staged(cut.where("hot").mapInPandas(_by_place(length), PIECE), "pieces")
    while rows.limit(1).count():
        rows = staged(rows.mapInPandas(_halves(length), PIECE), "pieces")
        n = F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("n")
        copies = rows.groupBy("g", "k").agg(n, F.min(F.struct("fp", "rd", "lo", "a", "b", "at", "data")).alias("x"))
        copies = staged(copies.select("g", "k", "x.*", (F.col("n") == 1).alias("alone")), "copies")
        twice = copies.where("not alone").select("g", "k")
        last = F.col("lo") + F.octet_length("data") - length
        repeated.append(rows.where("alone").join(twice, ["g", "k"], "left_semi").select("rd", "fp", F.array("lo", last).alias("ranges")))
        sizes = copies.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.max("alone").alias("open"), F.sum(F.octet_length("data")).alias("bytes"))
        sizes = sizes.where("open and kinds > 1").select("g", (F.col("bytes") > HOT_BYTES).alias("hot"))
        left = staged(copies.join(sizes, "g"), "left")
        ready.append(left.where("not hot").select(*cold.columns))
        rows = left.where("hot").select(*rows.columns)

    whole_text = reduce(DataFrame.unionByName, ready)
    total = whole_text.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def pairs(flag: np.ndarray, lo: int) -> list[int]:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
        edge[1::2] -= 1
        return (edge + lo).tolist()

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["g", "k"], kind="stable")
        flags = repeated_starts(list(group["data"]), length)
        out = [
            (rd, fp, pairs(f[: len(d) - length + 1], lo))
            for rd, fp, lo, alone, d, f in zip(group["rd"], group["fp"], group["lo"], group["alone"], group["data"], flags)
            if alone and f.any()
        ]
        return pd.DataFrame(out, columns=["rd", "fp", "ranges"])

    sharded = whole_text.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards))).groupBy("shard").applyInPandas(shard, "rd long, fp long, ranges array<int>")
    some = reduce(DataFrame.unionByName, repeated, sharded).groupBy("rd", "fp").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    whole = kinds.where("n > 1").select("rd", "fp", F.lit(None).cast("array<int>").alias("ranges"))
    marked = staged(some.unionByName(whole), "marked")
    places = at.select("key", "fp", "rd").distinct()
    found = places.join(marked, ["fp", "rd"]).groupBy("key").agg(F.collect_list(F.struct("fp", "rd", "ranges")).alias("found"))
    starts = runs.join(of_two(runs, "run"), "run").groupBy("k").agg(F.sort_array(F.collect_list("at")).alias("at"))
    fresh = F.transform("at", lambda x, i: F.least(F.lit(words), F.coalesce(F.get("at", i + 1) - x, F.lit(words))))
    shared = starts.select("k", F.aggregate(fresh, F.lit(0), lambda n, x: n + x).alias("shared"))
    return found.join(keys.join(shared, "k").select("key", "shared"), "key", "full")


#: Regions (fp, rd), and the runs of words of the text k with their places.
CUT = "fp long, rd long, alone boolean, hot boolean, data binary, k long, runs array<long>, at array<int>"
CUT_COLUMNS = [c.split()[0] for c in CUT.split(", ")]
#: A piece of the region (fp, rd): its windows from ``lo`` on, which have the 128 bytes, ``at`` bytes
#: after the piece's start, at a place from ``a`` to ``b``; group and digest; whether its region is alone.
PIECE = "g long, k long, fp long, rd long, lo int, a int, b int, at int, alone boolean, data binary"
_PIECE_COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


def _by_place(length: int):
    """Regions as pieces whose windows all have their smallest hash at one place of the text, the first if it is there twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fp, rd, alone, data in zip(batch["fp"], batch["rd"], batch["alone"], batch["data"]):
                places = np.flatnonzero(_gram_hashes(np.frombuffer(data, np.uint8)) == _U(fp))
                first = 0
                for p in places.tolist():
                    last = min(p, len(data) - length)
                    if first <= last:
                        out.append((fp, rd, fp, rd, first, 0, length - GRAM, p - first, alone, data[first : last + length]))
                    first = last + 1
            yield pd.DataFrame(out, columns=_PIECE_COLUMNS)

    return run


def _halves(length: int):
    """Each piece as up to two, by the halves of the places from ``a`` to ``b``; filed under the bytes that all windows of a half share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fp, rd, lo, a, b, at, alone, data in zip(*(batch[c] for c in ("fp", "rd", "lo", "a", "b", "at", "alone", "data"))):
                least = at - (len(data) - length)  # the place in the last window
                mid = (a + b) // 2
                for x, y in ((a, mid), (mid + 1, b)):
                    high, low = min(y, at), max(x, least)
                    if x > y or low > high:
                        continue
                    part = data[at - high : at - low + length]
                    g = _digest(b"%d %d %d " % (fp, x, y) + data[at - x : at - y + length])
                    out.append((g, _digest(b"%d " % high + part), fp, rd, lo + at - high, x, y, high, alone, part))
            yield pd.DataFrame(out, columns=_PIECE_COLUMNS)

    return run


def dedup(docs: DataFrame, text_col: str = "text", length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary), ``kept_sha256`` and ``n_shared_words``.

    Every row gives a row.  A null text is empty; a text shorter than ``length`` loses
    nothing.  A row that stands twice repeats itself: both lose their long strings.  What
    remains of UTF-8 may start or end inside a character, hence the binary column.
    ``n_shared_words`` removes nothing: it counts the words (by white space) in runs of ``words`` words
    that stand in another row too.
    """
    copied = _with_key(docs, text_col).groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key", F.lit(True).alias("copied"))
    found = repeated_ranges(docs, text_col, length, words).withColumnRenamed("key", "__key").join(copied, "__key", "full")
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_shared_words", "found", "shared", "copied")
    joined = _with_key(base, text_col).join(found, "__key", "left").drop("__key")

    def start():
        def one(text, found, shared, copied):
            data = _bytes(text)
            if copied:
                n = len(word_hashes(np.frombuffer(data, np.uint8))[0])
                shared = n if n >= words else 0
            if not found:
                return len(data), 0, 0, data, hashlib.sha256(data).hexdigest(), shared or 0
            ranges = {(f["fp"], f["rd"]): f["ranges"] for f in found}
            step = np.zeros(len(data) + 1, np.int32)
            for s, e, fp, _ in regions(np.frombuffer(data, np.uint8), length):
                k = (fp, _digest(data[s : e + length]))
                if k in ranges:
                    r = ranges[k]
                    for lo, hi in [(0, e - s)] if r is None else zip(r[::2], r[1::2]):
                        step[s + lo] += 1
                        step[s + hi + length] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            return len(data), int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest(), shared or 0

        return lambda *columns: [one(*row) for row in zip(*columns)]

    new = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, n_shared_words long"
    return map_rows(joined, [text_col, "found", "shared", "copied"], start, new, drop=("found", "shared", "copied"))


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")
