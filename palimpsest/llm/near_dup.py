"""Near-duplicates by improved consistent weighted sampling (ICWS).

A document is the weighted set of its five-word shingles, weight = count x idf.  The idf of
a shingle is that of its hash bucket: the number of documents with a shingle in the bucket,
counted over all documents.  ICWS draws ``BANDS * ROWS`` samples such that two documents
agree on one with the probability of their weighted Jaccard similarity; documents that
agree on a whole band are compared, first by a bound (the similarity of their weights summed
up by hash class, which is never less than that of the sets) and then exactly; links of ``MIN_SIMILARITY`` or more join
them into classes.

Documents with equal shingle sets are one representative from the start.  A group that
shares a band is not paired off: its open members (those not yet in the class of the
group's first member) are compared with a few pivots, sixteen times as many in each
round, until all are linked or have met the whole group.  The first pivots are the members
that share most bands with most documents: the text that the others are copies of.
No link within a group is lost to the classes: of two members that are not both in the first
member's class when the group is through, one was open and has met the other.  From the
second round on only pairs whose weights allow the similarity meet, by classes of weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, staged

SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 12, 4
IDF_BUCKETS = 1 << 16
#: Classes of shingle hashes for the bound below.
PARTS = 128
UNIT = 8  # sums are kept as whole eighths, rounded up
PIECE = 1 << 20
#: Bits of the filter of ids, at most.
MOST_BITS = 1 << 28
_U = np.uint64


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Random numbers, the same everywhere: drawn once from a fixed seed."""
    rng = np.random.default_rng(20240131)
    n = 1 << 16
    code = np.zeros(256, bool)
    code[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
    code[128:] = True
    return {
        "word": code,
        "byte": rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1),
        "place": rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * _U(2) + _U(1),
        "slot": rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1),
        "r": (-np.log(rng.random(n) * rng.random(n))).astype(np.float32),
        "lnc": np.log(-np.log(rng.random(n) * rng.random(n))).astype(np.float32),
        "beta": rng.random(n).astype(np.float32),
        "odd": rng.integers(1, 1 << 31, (2, BANDS * ROWS)).astype(np.uint32) * np.uint32(2) + np.uint32(1),
    }


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words: runs of ASCII letters, digits and all other bytes above 127."""
    t, out, at = _tables(), [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # cut long texts between words where that is possible
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        b = np.frombuffer(text[at:end].lower().encode("utf-8", "surrogatepass"), np.uint8)
        at = end
        inside = t["word"][b]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        size = ends - starts
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        out.append(_mix(np.add.reduceat(t["byte"][b[inside]] * t["place"][place & 4095], first)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit shingle hashes, ascending, and their counts.  A shorter text is one shingle."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = _tables()["slot"]
    n = max(len(w) - SHINGLE + 1, 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h += w[j : j + n] * k[j]
    return np.unique((_mix(h) >> _U(32)).astype(np.uint32), return_counts=True)


def weights(h: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return n * idf[h & np.uint32(IDF_BUCKETS - 1)]


def signature(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """ICWS samples as 32-bit codes of (shingle, level).

    The three random numbers of a shingle and a sample stand at three places of their tables,
    from two hashes of its own for each sample: shingles that meet in one place part in another.
    """
    t = _tables()
    k = BANDS * ROWS
    best, code = np.full(k, np.inf, np.float32), np.zeros(k, np.uint32)
    every = np.arange(k)
    logs = np.log(w).astype(np.float32)
    for at in range(0, len(h), 1024):
        x, lw = h[at : at + 1024], logs[at : at + 1024]
        one, two = ((x[None, :] * odd[:, None]) >> np.uint32(16) for odd in t["odd"])
        r, beta = t["r"][one], t["beta"][one ^ two]
        level = np.floor(lw[None, :] / r + beta)
        # ln a = ln c - ln y - r with ln y = r (t - beta)
        a = t["lnc"][two] - r * (level - beta) - r
        i = np.argmin(a, axis=1)
        low = a[every, i]
        won = low < best
        best[won] = low[won]
        code[won] = (x[i] * np.uint32(2654435761) ^ (level[every, i].astype(np.int64) & 0xFFFFFFFF).astype(np.uint32) * np.uint32(40503))[won]
    return code


def bands(code: np.ndarray) -> list[int]:
    h = np.arange(1, BANDS + 1).astype(np.uint64)
    for row in code.reshape(BANDS, ROWS).T:
        h = _mix(h * _U(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    return h.view(np.int64).tolist()


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each (ascending distinct keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - common
    return common / total if total > 0 else 0.0


def idf_table(docs: DataFrame) -> np.ndarray:
    """idf of every bucket over all rows of ``docs`` (column text): ln(1 + N / (1 + df)), more than 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(IDF_BUCKETS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                h, _ = shingles(t if isinstance(t, str) else None)
                df[np.unique(h & np.uint32(IDF_BUCKETS - 1))] += 1
                n += 1
        some = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(some, IDF_BUCKETS), "df": np.append(df[some], n)})

    # Each task sends at most one row for a bucket; the table has a fixed size.
    rows = docs.select("text").mapInPandas(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    got = rows.toPandas()
    table = np.zeros(IDF_BUCKETS + 1)
    table[got["bucket"].to_numpy()] = got["df"].to_numpy()
    return np.log1p(table[-1] / (1 + table[:-1])).astype(np.float32)


def _narrow(df: DataFrame, name: str) -> DataFrame:
    """A staged table of ids: few bytes a row, so an eighth of the usual number of files."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.coalesce(max(1, n // 8)), name)


def _place(n_bits: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n_bits))


def id_bits(ids: DataFrame) -> np.ndarray:
    """Words of 64 bits, with the bits at the places of ``ids`` (column id) set: an id whose bit is not set is none of them.

    About one bit in sixteen is set; above 2^24 ids more are, and more other ids pass.
    """
    n_bits = max(64, min(1 << (16 * ids.count()).bit_length(), MOST_BITS))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = ids.select(_place(n_bits).alias("place")).groupBy(F.expr("place >> 6").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(n_bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each end of ``edges`` (a, b) is connected with.

    Labels spread along the edges and then jump to the label of their label, until none
    changes.  Everything stays in tables.
    """
    both = _narrow(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = _narrow(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.least("comp", "m").alias("new"), F.col("comp").alias("old"))
        up = label.select(F.col("id").alias("new"), F.col("comp").alias("higher"))
        moved = step.join(up, "new").select("id", F.least("new", "higher").alias("comp"), (F.least("new", "higher") != F.col("old")).alias("moved"))
        label = _narrow(moved, "labels")
        if not label.where("moved").limit(1).count():
            return label.select("id", "comp")


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comp`` (id, comp) after new ``links`` (a, b): only the classes that the links touch are merged."""
    if comp is None:
        return components(links)
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    base = comp.unionByName(ends.join(comp, "id", "left_anti").withColumn("comp", F.col("id")))
    a = base.select(F.col("id").alias("a"), F.col("comp").alias("x"))
    b = base.select(F.col("id").alias("b"), F.col("comp").alias("y"))
    between = links.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(between).select(F.col("id").alias("comp"), F.col("comp").alias("new"))
    return _narrow(base.join(merged, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")), "classes")


def _bound(weight_a: Column, parts_a: Column, weight_b: Column, parts_b: Column) -> Column:
    """At least the weighted Jaccard similarity: what two sets share is no more than what their sums by class share."""
    shared = F.zip_with(parts_a, parts_b, lambda x, y: F.least(x, y))
    common = F.aggregate(shared, F.lit(0).cast("long"), lambda t, x: t + x) / F.lit(float(UNIT))
    common = F.least(common, weight_a, weight_b)
    return common / (weight_a + weight_b - common)


def _verified(pairs: DataFrame, vectors: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``least``."""

    def run(batches):
        table = idf.value

        def unpack(h, n):
            keys = np.frombuffer(h, np.uint32)
            return keys, weights(keys, np.frombuffer(n, np.uint32) if n else np.ones(len(keys), np.uint32), table)

        for p in batches:
            sim = [
                weighted_jaccard(unpack(h1, n1), unpack(h2, n2)) for h1, n1, h2, n2 in zip(p["h1"], p["n1"], p["h2"], p["n2"])
            ]
            out = p[["a", "b"]].assign(similarity=sim)
            yield out[out["similarity"] >= least]

    one = vectors.select(F.col("id").alias("a"), F.col("h").alias("h1"), F.col("n").alias("n1"))
    two = vectors.select(F.col("id").alias("b"), F.col("h").alias("h2"), F.col("n").alias("n2"))
    return pairs.join(two, "b").join(one, "a").mapInPandas(run, "a long, b long, similarity double")


def _weight_class(least: float) -> Column:
    """Of two sets with a similarity of ``least`` or more the classes are the same or neighbours."""
    return F.floor(F.log("weight") / F.lit(-np.log(least - 1e-3).item()))


def _slots(round_: int) -> int:
    return 16 ** round_


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, class_id): each distinct non-null id with the smallest id of its class.

    A text without a word (null and empty ones too) is a class of its own.  Rows that repeat
    an id are one document if their texts are equal; of different texts under one id, the one
    with the smallest shingle digest counts.  Empty input gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(rows))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                h, n = shingles(t if isinstance(t, str) else None)
                if not len(h):
                    out.append((i, None, None, None, None))
                    continue
                digest = hashlib.blake2b(h.tobytes() + n.tobytes(), digest_size=16).digest()
                w = weights(h, n, idf.value)
                sums = np.bincount(h >> np.uint32(25), weights=w, minlength=PARTS)
                parts = np.minimum(np.ceil(sums * UNIT), 2**31 - 1).astype(np.int32)
                out.append((i, digest, float(w.sum(dtype=np.float64)), parts, bands(signature(h, w))))
            yield pd.DataFrame(out, columns=["id", "digest", "weight", "parts", "bands"])

    signed = rows.mapInPandas(sign, "id long, digest binary, weight double, parts array<int>, bands array<long>")
    signed = staged(signed, "signatures")
    some = signed.where(F.col("digest").isNotNull())
    first = some.groupBy("digest").agg(F.min("id").alias("rep"))
    member = staged(some.select("id", "digest").join(first, "digest").groupBy("id").agg(F.min("rep").alias("rep")), "members")

    heads = some.join(first.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id"])
    # Only ids and keys are dealt out twelve times; weights follow for the ids that share a band.
    keyed = heads.select("id", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = staged(keyed.join(groups, "key"), "shared")
    wanted = _narrow(shared.select("id").distinct(), "wanted")
    measured = heads.select("id", "weight", "parts").join(wanted, "id", "left_semi")
    # Documents that meet the most others stand first.
    rank = shared.groupBy("id").agg((-F.sum("size")).alias("rank"))
    ranked = shared.join(rank, "id")
    first_of = ranked.groupBy("key").agg(F.min(F.struct("rank", "id")).alias("h")).select("key", F.col("h.id").alias("head"))
    bucket = staged(ranked.join(first_of, "key").join(measured, "id"), "buckets")

    # Texts stay where they are read: ids that cannot be wanted go before the shuffle, which has vectors only.
    bits = spark.sparkContext.broadcast(id_bits(wanted))
    n_bits = 64 * len(bits.value)

    def vectorise(batches):
        import pyarrow as pa

        for b in batches:
            place = b.column("place").to_numpy()
            b = b.filter(pa.array((bits.value[place >> 6] >> (place & 63)) & 1 == 1))
            found = [shingles(t) for t in b.column("text").to_pylist()]
            counts = [n.astype(np.uint32).tobytes() if (n > 1).any() else None for _, n in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array(counts, pa.binary())], names=["id", "h", "n"])

    passed = rows.withColumn("place", _place(n_bits)).mapInArrow(vectorise, "id long, h binary, n binary")
    vectors = staged(passed.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "vectors")

    comp: DataFrame | None = None
    level = 0
    while True:
        if comp is None:  # the first round: every member of a group against its head
            on = ["key"]
            state = bucket.where("id <> head").withColumn("own", F.col("id"))
            pivots = bucket.where("id = head").select("key", F.col("id").alias("b"), F.col("weight").alias("weight_b"), F.col("parts").alias("parts_b"), F.col("id").alias("own_b"))
        else:
            labelled = bucket.join(comp.withColumnRenamed("comp", "c"), "id", "left").withColumn("own", F.coalesce("c", "id")).drop("c")
            top = comp.select(F.col("id").alias("head"), F.col("comp").alias("c"))
            labelled = labelled.join(top, "head", "left").withColumn("main", F.coalesce("c", "head")).drop("c")
            # A group is through when its last pivots were all of its members.
            open_ = (F.col("own") != F.col("main")) & (F.col("size") > _slots(level - 1))
            live = labelled.where(open_).select("key").distinct()
            labelled = staged(labelled.join(live, "key", "left_semi").withColumn("open", open_), "state")
            state = labelled.where("open")
            if not state.limit(1).count():
                break
            m = _slots(level)
            # Few enough members: each is a pivot.  Else the first of each of m slots.
            slot = F.when(F.col("size") <= m, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(m)))
            pivots = labelled.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("rank", "id", "weight", "parts", "own")).alias("p"))
            around = F.explode(F.sequence(F.col("wc") - 1, F.col("wc") + 1)).alias("wc")
            pivots = pivots.select("key", "p.*").withColumn("wc", _weight_class(least)).select(
                "key", around, F.col("id").alias("b"), F.col("weight").alias("weight_b"), F.col("parts").alias("parts_b"), F.col("own").alias("own_b")
            )
            state, on = state.withColumn("wc", _weight_class(least)), ["key", "wc"]
        near = _bound(F.col("weight"), F.col("parts"), F.col("weight_b"), F.col("parts_b")) >= least - 1e-4
        met = state.join(pivots, on).where((F.col("own") != F.col("own_b")) & near)
        pairs = met.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
        found = staged(_verified(pairs, vectors, idf, least), f"links{level}")
        if comp is None or found.limit(1).count():
            comp = _joined(comp, found.select("a", "b"))
        level += 1
    joined = member.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("class_id"))
    everyone = signed.select("id").distinct()
    return everyone.join(joined, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each class, the one with the smallest id; rows with a null id stay."""
    found = classes(docs, id_col, text_col)
    keep = found.where("doc_id = class_id").select(F.col("doc_id").alias("__id"))
    kept = docs.join(keep, docs[id_col].cast("long") == F.col("__id"), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def near_dup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
