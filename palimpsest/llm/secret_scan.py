"""Secret scans: fixed patterns and character Markov models (DataFrame functions only).

Two first-order Markov models over ASCII characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples.  A long token whose mean log
likelihood ratio per character reaches ``min_llr`` is a secret of kind ``markov``, unless
it overlaps a span that a fixed pattern has found.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, prefix_sums, sha_uniform

# Kinds in the order in which spans that start together are listed, and their patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"  # with a digit in it
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Bounds of the labelled samples: random strings, numbers, and documents whose words are ordinary.
RANDOM_STRINGS = 1000
NUMBERS = 500
WORD_DOCUMENTS = 300
MIN_LLR = 0.4
SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def labelled_samples(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows (label, token): 1 for strings made at random, 0 for ordinary identifiers.

    Random ones are digests in hexadecimal, base 64 and letters with digits.  Ordinary
    ones are words, words joined by underscores, hyphens, slashes and capitals, and plain
    numbers, from the whole texts of about ``WORD_DOCUMENTS`` documents, without the tokens
    that follow a credential keyword.  Documents are drawn by id and text; rows equal in both
    count once among those drawn.  The bound is on labelled rows alone.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    made = spark.range(0, RANDOM_STRINGS, 1, 1).select(
        F.explode(F.array(digest, F.upper(F.substring(digest, 1, 40)), b64, F.translate(b64, "+/=", ""), F.upper(F.translate(b64, "+/=", ""))))
        .alias("token")
    )
    numbers = spark.range(0, NUMBERS, 1, 1).select(F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string").alias("token"))
    total = docs.agg(F.count(F.lit(1))).first()[0]
    share = WORD_DOCUMENTS / max(total, 1)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).cast("string").alias("i"))
    drawn = rows.where(sha_uniform(F.struct("t", "i"), "words") < share) if share < 1 else rows
    drawn = drawn.groupBy(F.xxhash64("t", "i").alias("h")).agg(F.min("t").alias("t"))
    text = F.regexp_replace("t", ASSIGN, " ")
    ws = drawn.select(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w) < 24)).alias("w"))

    def triple(sep: str, form) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size("w") - 3, F.lit(3)), lambda i: F.concat_ws(sep, *[form(F.get("w", i + k)) for k in range(3)])
        )

    plain = lambda c: c
    joined = ws.where(F.size("w") >= 3).select(
        F.explode(F.concat(F.col("w"), triple("_", F.lower), triple("-", F.lower), triple("/", plain), triple("", F.initcap), triple("", F.lower)))
        .alias("token")
    )
    ordinary = joined.unionByName(numbers).where(~F.col("token").rlike("[0-9a-f]{24}|AKIA[A-Z0-9]{16}"))
    return made.select(F.lit(1).alias("label"), "token").unionByName(ordinary.select(F.lit(0).alias("label"), "token"))


def train(samples: DataFrame) -> list[float]:
    """Log likelihood ratios, 128 x 128, of each character given the one before (0 at the start).

    At most 2 x 128 x 128 counts reach the driver, whatever the size of the samples.
    """
    ch = F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(
        F.when(i == 1, F.lit(0)).otherwise(F.ascii(F.substring(F.col("token"), i - 1, F.lit(1)))).alias("p"),
        F.ascii(F.substring(F.col("token"), i, F.lit(1))).alias("c"),
    )))
    counts = samples.where(F.length("token") > 0).select("label", ch.alias("x")).groupBy("label", "x.p", "x.c").count()
    n = {(r["label"], r["p"], r["c"]): r["count"] for r in counts.collect() if r["p"] < 128 and r["c"] < 128}
    # Characters that no sample has count as one, so that neither label gains from them.
    width, rows = 65, {}
    for (label, p, _), k in n.items():
        rows[label, p] = rows.get((label, p), 0) + k
    prob = lambda label, p, c: (n.get((label, p, c), 0) + 0.5) / (rows.get((label, p), 0) + 0.5 * width)
    return [round(math.log(prob(1, p, c) / prob(0, p, c)), 6) for p in range(128) for c in range(128)]


def _model(llr: list[float]) -> Column:
    """The table as one constant: folded once, looked up by position."""
    return F.split(F.lit(",".join(map(repr, llr))), ",").cast("array<double>")


def _score(token: Column, model: Column) -> Column:
    at = lambda i: F.ascii(F.substring(token, i, F.lit(1)))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(token)),
        F.lit(0.0),
        lambda acc, i: acc + F.get(model, F.when(i == 1, F.lit(0)).otherwise(at(i - 1) * 128) + at(i)),
    )
    return total / F.length(token)


def _spans(text: Column, pattern: str, kind: str, passes, needs: Column) -> Column:
    """Spans in code points of the matches that pass: lengths of what lies between, summed up.

    ``needs`` is a cheap condition that every text with a match fulfils.
    """

    def of(found: Column) -> Column:
        steps = F.zip_with(
            F.split(text, pattern, -1),
            found,
            lambda gap, m: F.struct(F.length(gap).cast("long").alias("g"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("m")),
        )

        def place(st: Column) -> Column:
            return let(
                prefix_sums(F.transform(st, lambda s: s["g"] + s["m"])),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.length(m)).cast("long").alias("start"),
                        F.lit(KINDS.index(kind)).alias("ord"),
                        F.get(ends, i).alias("end"),
                        F.lit(kind).alias("kind"),
                        passes(m).alias("ok"),
                    ),
                ),
            )

        return F.transform(
            F.filter(let(steps, place), lambda s: s["ok"]),
            lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")),
        )

    none = F.array().cast(SPAN)
    return F.when(needs & text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(none)


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, llr: list[float], text_col: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (arrays) of each whole text.

    A null text counts as empty and has no span.  Each input row gives one output row;
    input columns with the names of new ones are replaced.  Work is per row: no shuffle.
    """
    text, model = F.col("__t"), _model(llr)
    d = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    digit = text.rlike("[0-9]")
    keyword = let(F.lower(text), lambda low: reduce(lambda a, k: a | F.contains(low, F.lit(k)), KEYWORDS, F.lit(False)))
    # The least lengths of runs stand in the patterns: a maximal run that is long enough is the same match.
    d = d.withColumns({
        "__assign": _spans(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_ASSIGN, keyword),
        "__access": _spans(text, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", "access", lambda m: F.lit(True), F.contains(text, F.lit("AKIA"))),
        "__hex": _spans(text, f"[0-9a-f]{{{MIN_HEX},}}", "hex", lambda m: F.lit(True), F.lit(True)),
        "__markov": _spans(text, CANDIDATE, "markov", lambda m: m.rlike("[0-9]") & (_score(m, model) >= min_llr), digit),
    })
    d = d.withColumn("base_spans", F.sort_array(F.concat("__assign", "__access", "__hex")))
    apart = F.filter("__markov", lambda m: ~F.exists("base_spans", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    d = d.withColumn("all_spans", F.sort_array(F.concat("base_spans", apart)))
    return d.drop("__t", "__assign", "__access", "__hex", "__markov")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each span replaced; of overlapping spans the earlier ends where the later begins."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def cover(acc: Column, s: Column) -> Column:
        between = F.concat(acc["out"], F.substring(text, (acc["done"] + 1).cast("int"), (s["start"] - acc["done"]).cast("int")), F.lit(mask))
        out = F.when(s["start"] < acc["done"], acc["out"]).otherwise(between)
        return F.struct(out.alias("out"), F.greatest(acc["done"], s["end"]).alias("done"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["done"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, cover, rest))


def trained(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[float]:
    return train(labelled_samples(docs, text_col, id_col))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, trained(docs)).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
    )
