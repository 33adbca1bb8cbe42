"""Mixing sources to target weights by soft membership (DataFrame functions only).

A naive Bayes classifier over hashed words, fitted on a bounded sample of a labelled table,
gives every document without a known domain a posterior over domains.  Projected gradient descent then fits one
rate >= 0 per document such that the expected tokens of each domain, the sum over documents
of rate x tokens x posterior, match the targets in the sense of least squares.  A step needs
the domain totals only, one aggregate over all documents; rates stay in the table.

Where domains are known and the posterior is to count all the same (``both``), the totals by
label and the totals by posterior are brought to the targets together.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, sha_uniform, staged

BUCKETS = 4096
#: Labelled rows of each domain from which the classifier is fitted.
SAMPLE_PER_DOMAIN = 400
MAX_DOMAINS = 64
#: A text's evidence counts like that of at most this many words, which keeps membership soft.
EVIDENCE_WORDS = 25.0
#: Log likelihoods are whole numbers of this many to 1; two of their sums stand in one long.
UNITS = 100_000
HALF_BITS = 31
HALF = (1 << HALF_BITS) - 1
TOLERANCE = 1e-4
MAX_STEPS = 60
STEPS_PER_TABLE = 12


def _buckets(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _paired(spark: SparkSession, tables: list[list[float]]) -> tuple[Column, int]:
    """The tables in whole ``UNITS`` above each bucket's least entry, two to a long; how many entries add up without a carry.

    A value from a table of its own, as a literal of this size is written out in the plan again and again.
    """
    parts = np.rint(np.array(tables) * UNITS).astype(np.int64)
    parts -= parts.min(axis=0)
    pairs = [parts[j] + (parts[j + 1] << HALF_BITS) if j + 1 < len(parts) else parts[j] for j in range(0, len(parts), 2)]
    text = F.lit(";".join(",".join(map(str, pair.tolist())) for pair in pairs))
    rows = spark.range(1, numPartitions=1).select(F.transform(F.split(text, ";"), lambda t: F.split(t, ",").cast("array<bigint>")).alias("pairs"))
    return staged(rows, "tables").scalar(), HALF // max(1, int(parts.max()))


def _sums(buckets: Column, paired: Column, block: int, n: int) -> Column:
    """The sums of ``n`` tables over the buckets in whole ``UNITS``, all less by one number: an array of long.

    A word costs half as many steps as there are tables; ``block`` words are added at a time.
    """
    zero, low = F.lit(0).cast("long"), F.lit(HALF)

    def added(blocks: Column, table: Column) -> Column:
        return F.transform(blocks, lambda bs: F.aggregate(bs, zero, lambda acc, b: acc + F.get(table, b)))

    def half(sums: Column, j: int) -> Column:
        one = lambda v: F.shiftright(v, HALF_BITS) if j % 2 else v.bitwiseAND(low)
        return F.aggregate(F.get(sums, j // 2), zero, lambda acc, v: acc + one(v))

    last = F.floor(F.greatest(F.size(buckets) - 1, F.lit(0)) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(buckets, c * block + 1, F.lit(block)))
    pairs = let(blocks, lambda bs: F.transform(paired, lambda t: added(bs, t)))
    return let(pairs, lambda sums: F.array(*[half(sums, j) for j in range(n)]))


class Classifier:
    """Domains, their log shares and log likelihoods by bucket: a fixed number of constants."""

    def __init__(self, domains: list[str], prior: list[float], tables: list[list[float]]) -> None:
        self.domains, self.prior, self.tables = domains, prior, tables


def fit(labelled: DataFrame, text_col: str, domain_col: str, id_col: str | None = None, per_domain: int = SAMPLE_PER_DOMAIN) -> Classifier:
    """A classifier of the rows of ``labelled`` with a domain; shares count all of them.

    About ``per_domain`` rows of each domain are drawn, by text and id alone: the model does
    not depend on the order or the partitions of the rows.  Rows equal in both are drawn
    together and count once among those drawn.
    """
    own = F.lit(None).cast("string") if id_col is None else F.col(id_col).cast("string")
    rows = labelled.where(F.col(domain_col).isNotNull()).select(F.col(domain_col).cast("string").alias("d"), F.col(text_col).alias("t"), own.alias("r"))
    sizes = {r["d"]: r["count"] for r in rows.groupBy("d").count().limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(sizes)
    if not domains:
        return Classifier([], [], [])
    draw = F.lit(False)
    for d, n in sizes.items():
        draw = draw | ((F.col("d") == d) & (sha_uniform(F.struct("t", "r"), "mixing") < per_domain / n))
    drawn = rows.where(draw).groupBy("d", F.xxhash64("t", "r").alias("h")).agg(F.min("t").alias("t"))
    counts = drawn.select("d", F.explode(_buckets(F.col("t"))).alias("b")).groupBy("d", "b").count()
    # One text for each domain: a row for every count would take the driver's memory.
    lists = counts.groupBy("d").agg(F.array_join(F.collect_list(F.concat_ws(":", "b", "count")), ",").alias("n")).collect()
    n = {(r["d"], int(b)): int(c) for r in lists for b, c in (x.split(":") for x in r["n"].split(","))}
    tables = []
    for d in domains:
        total = sum(n.get((d, b), 0) for b in range(BUCKETS)) + 0.1 * BUCKETS
        tables.append([round(math.log((n.get((d, b), 0) + 0.1) / total), 5) for b in range(BUCKETS)])
    everything = sum(sizes.values())
    return Classifier(domains, [math.log(sizes[d] / everything) for d in domains], tables)


def memberships(docs: DataFrame, model: Classifier, text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``posterior`` (array in the order of the domains); no shuffle.

    A row whose ``label_col`` names a domain belongs to it alone; the classifier is for the others.
    A null text has no tokens, and its posterior is the domains' shares.
    """
    names = F.array(*[F.lit(d) for d in model.domains])
    place = F.lit(0) if label_col is None else F.coalesce(F.array_position(names, F.col(label_col).cast("string")), F.lit(0))
    prior, (paired, block) = F.array(*[F.lit(p) for p in model.prior]), _paired(docs.sparkSession, model.tables)

    def logits(bs: Column, pairs: Column) -> Column:
        scale = F.least(F.lit(1.0), F.lit(EVIDENCE_WORDS) / F.greatest(F.size(bs), F.lit(1)))
        z = F.zip_with(_sums(bs, pairs, block, len(model.domains)), prior, lambda s, p: s / F.lit(float(UNITS)) * scale + p)
        return F.struct(F.size(bs).cast("long").alias("n"), F.when(place == 0, z).alias("z"))

    def soft(z: Column) -> Column:
        return let(F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda t: F.transform(e, lambda v: v / t)))

    # Spark takes no subquery as an argument here; its optimizer puts the column in, which is named once, and copies no table into rows.
    d = docs.withColumn("__pairs", paired).withColumn("__m", let(F.col("__pairs"), lambda pairs: let(_buckets(F.col(text_col)), lambda bs: logits(bs, pairs))))
    known = F.transform(F.sequence(F.lit(1), F.lit(len(model.domains))), lambda j: (j == place).cast("double"))
    posterior = F.when(place > 0, known).otherwise(let(F.col("__m.z"), soft))
    return d.withColumn("n_tokens", F.col("__m.n")).withColumn("posterior", posterior).drop("__m", "__pairs")


@dataclass
class Rates:
    """Rows with ``rate``; the totals by domain that the rates reach and those wanted."""

    rows: DataFrame
    reached: list[float]
    wanted: list[float]
    steps: int

    @property
    def residual(self) -> float:
        """The largest miss of a domain, as a share of the largest total wanted."""
        return max((abs(r - w) for r, w in zip(self.reached, self.wanted)), default=0.0) / (max(self.wanted, default=0.0) or 1.0)

    @property
    def converged(self) -> bool:
        return self.residual <= TOLERANCE


def fit_rates(members: DataFrame, targets: list[float], budget: float | None = None) -> Rates:
    """``members`` (n_tokens, posterior, any others) with ``rate``; and the totals reached.

    ``targets`` are weights in the order of the domains; ``budget`` is the number of tokens
    wanted in all, by default that of the input.  Minimises the sum over domains of
    (total - target)^2 / initial total from rates of 1.  In the metric of tokens the largest
    eigenvalue is 1, so a step of 1 descends; steps are extrapolated, and anew from where the
    sum has grown.  A document without tokens keeps the rate its posterior gives it.  Nothing
    but domain totals leaves the table; they are summed in whole 1,024ths of a token, so that
    no order of the rows changes them.  ``converged`` tells whether the targets are met:
    where domains overlap they may be out of reach.
    """
    k = len(targets)
    weight = sum(targets)
    if k == 0 or weight <= 0 or min(targets) < 0:
        raise ValueError("targets must be weights, at least one of them positive")

    def totals(df: DataFrame, rate: Column) -> list[float]:
        part = lambda j: F.round(F.col("n_tokens") * rate * F.get("posterior", j) * 1024).cast("long")
        got = df.agg(*[F.sum(part(j)).alias(f"s{j}") for j in range(k)]).first()
        return [(got[j] or 0) / 1024 for j in range(k)]

    now = members.withColumn("rate", F.lit(1.0))
    start = totals(now, F.col("rate"))
    if sum(start) <= 0:
        return Rates(now, start, start, 0)
    want = [(budget or sum(start)) * t / weight for t in targets]
    if any(w > 0 and s <= 0 for w, s in zip(want, start)):
        raise ValueError("a domain with a positive target has no tokens")
    off = lambda at: sum((x - w) ** 2 / s for x, w, s in zip(at, want, start) if s > 0)
    rate, before, reached, earlier, speed, steps = F.col("rate"), F.col("rate"), start, start, 1.0, 0
    while steps < MAX_STEPS and max(abs(r - w) for r, w in zip(reached, want)) > TOLERANCE * max(want):
        after = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        push = (speed - 1) / after
        ahead = [r + push * (r - e) for r, e in zip(reached, earlier)]
        dot = F.lit(0.0)
        for j in range(k):
            dot = dot + F.get("posterior", j) * F.lit((ahead[j] - want[j]) / start[j] if start[j] > 0 else 0.0)
        rate, before = F.greatest(F.lit(0.0), rate + (rate - before) * push - dot), rate
        steps += 1
        now = now.select("*", rate.alias("__rate"), before.alias("__before")).drop("rate", "before").withColumnsRenamed({"__rate": "rate", "__before": "before"})
        if steps % STEPS_PER_TABLE == 0:
            now = staged(now, "rates")
        rate, before = F.col("rate"), F.col("before")
        earlier, reached, speed = reached, totals(now, rate), after
        if off(reached) > off(earlier):
            before, earlier, speed = rate, reached, 1.0
    return Rates(now.drop("before"), reached, want, steps)


#: Weights of the distance from rates of 1 beside a miss of a label's or a posterior's total, which bound
#: the steps where not all totals can be met; a label's is met first.
SLACK = 1e-8, 1e-7
#: Totals by label and posterior are summed in whole fractions of this many to a token.
PARTS = 1 << 20


def fit_both(members: DataFrame, targets: list[float]) -> Rates:
    """``members`` (n_tokens, posterior, __place, any others) with ``rate``; both kinds of totals reached.

    ``__place`` is the number of a row's known domain from 1, or 0: then its posterior counts in the
    totals by label too.  Sought are the rates >= 0 nearest to 1, squares weighted by tokens, with
    which the domains' totals by label and those by posterior both have the shares ``targets``.
    They are max(0, 1 - the row's memberships x the summed steps), so that a step is one aggregate:
    the totals, which give the gradient, and the products of memberships over the rows above 0,
    in whose metric it descends.  A step that does not lower the dual value is damped.
    """
    k, weight = len(targets), sum(targets)
    if k == 0 or weight <= 0 or min(targets) < 0:
        raise ValueError("targets must be weights, at least one of them positive")
    place = F.col("__place")
    # A row stands once for each weight, so that the sums are k + 1 columns and not one for every pair.
    weights = F.expr("concat(array(n_tokens * rate, free), transform(posterior, v -> free * v))")
    sums = [F.expr(f"sum(bigint(rint(w{x} * {PARTS})))").alias(f"s{n}") for n, x in enumerate(["", *[f" * get(posterior, {j})" for j in range(k)]])]

    def rate(pull: np.ndarray) -> Column:
        # As arrays, so that the code of a step is that of the last one and need not be compiled again.
        array = lambda v: F.split(F.lit(",".join(map(repr, v.tolist()))), ",").cast("array<double>")
        dot = lambda v: F.aggregate(F.zip_with("posterior", array(v), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
        known = F.get(array(pull[:k]), place - 1)
        return F.greatest(F.lit(0.0), F.lit(1.0) - F.when(place > 0, known + dot(pull[k:])).otherwise(dot(pull[:k] + pull[k:])))

    def at(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals by label and posterior, their derivatives, and the dual value without its targets."""
        df = members.select("n_tokens", "posterior", "__place", rate(pull).alias("rate"))
        df = df.withColumn("free", F.expr("if(rate > 0, double(n_tokens), 0)"))
        df = df.select("posterior", "__place", F.posexplode(weights).alias("m", "w"))
        total, slope, read = np.zeros(2 * k), np.zeros((2 * k, 2 * k)), 0.0
        for p, m, *got in df.groupBy("__place", "m").agg(*sums).collect():
            v = np.array([(g or 0) / PARTS for g in got])
            if m == 0:
                read += v[0]
                total[k:] += v[1:]
                total[p - 1 if p else slice(k)] += v[0] if p else v[1:]
            elif m == 1 and p:
                slope[p - 1, p - 1] += v[0]
                slope[p - 1, k:] += v[1:]
                slope[k:, p - 1] += v[1:]
            elif m > 1:
                slope[k + m - 2, k:] += v[1:]
                if not p:
                    slope[m - 2] += np.tile(v[1:], 2)
                    slope[k + m - 2, :k] += v[1:]
        # Tokens x rate^2, summed, is what is read less its part in the steps, as the rate is 1 less those or 0.
        return total, slope, (read - float(pull @ total)) / 2

    pull, steps, damp = np.zeros(2 * k), 0, 0.0
    total, slope, half = at(pull)
    start, tokens = total, float(total[k:].sum())
    if tokens <= 0:
        return Rates(members.withColumn("rate", F.lit(1.0)), [0.0] * 2 * k, [0.0] * 2 * k, 0)
    want = np.tile([tokens * t / weight for t in targets], 2)
    slack = np.repeat(SLACK, k) * tokens / k
    off = lambda t: float(np.abs(t - want).max())
    value = lambda v, h: h + float(want @ v) + float((slack * v * v).sum()) / 2
    best = off(total), pull, total
    while steps < MAX_STEPS and off(total) > TOLERANCE * want.max():
        down = total - want - slack * pull
        move = np.linalg.solve(slope + np.diag(slack + damp * np.maximum(start, tokens * 1e-6)), down)
        steps += 1
        there, slope_there, half_there = at(pull + move)
        if off(there) < best[0]:
            best = off(there), pull + move, there
        elif value(pull + move, half_there) > value(pull, half) - 1e-4 * float(down @ move):
            damp = max(4 * damp, 1e-5)
            continue
        pull, total, slope, half = pull + move, there, slope_there, half_there
        damp = damp / 10 if damp > 1e-7 else 0.0
    return Rates(members.withColumn("rate", rate(best[1])), best[2].tolist(), want.tolist(), steps)


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] | None = None,
    text_col: str = "text",
    domain_col: str = "lang",
    id_col: str = "doc_id",
    known: bool = True,
    keep: bool = False,
    both: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, domain, membership, rate, copies, residual.

    ``domain`` is the likeliest domain, of equally likely ones the first in order, and
    ``membership`` its posterior; ``copies`` rounds the rate up or down by a number drawn from
    the id, so that its mean is the rate.  ``residual`` is the same in all rows: the largest
    miss of a domain, as a share of the largest total wanted; above ``TOLERANCE`` the targets
    are not met, and a warning says so.  Rows of ``docs`` that have a ``domain_col`` belong to
    it, unless ``known`` is false.  ``targets`` default to equal weights of all domains that
    have tokens.  Without labelled rows, or on an empty table, every rate is 1.  With ``keep``
    all columns of ``docs`` stand before the new ones, but for those that clash with them.

    With ``both`` every row gets its posterior, whether its domain is known or not, and the rates
    bring the totals by known domain and the totals by posterior to the targets (``fit_both``).
    ``domain`` is then the known one, if there is one, ``membership`` its posterior, and
    ``residual`` the largest miss of either kind.  Domains have to have a word in ``labelled``.
    """
    if both:
        labelled = labelled.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    model = fit(labelled, text_col, domain_col, id_col if id_col in labelled.columns else None)
    new = ["n_tokens", "domain", "membership", "rate", "copies", "residual"]
    own = [c for c in docs.columns if c.lower() not in new] if keep else [id_col]
    labels = [F.col(domain_col).alias("__label")] if known and domain_col in docs.columns else []
    base = docs.select(*own, F.col(text_col).alias("__text"), F.col(id_col).alias("__id"), *labels)
    if not model.domains:
        tokens = F.size(_buckets(F.col("__text"))).cast("long")
        none = [F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("membership")]
        ones = [F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.lit(0.0).alias("residual")]
        return base.select(*own, tokens.alias("n_tokens"), *none, *ones)
    names = F.array(*[F.lit(d) for d in model.domains])
    if both:
        place = F.coalesce(F.array_position(names, F.col("__label").cast("string")), F.lit(0)) if labels else F.lit(0)
        found = memberships(base, model, "__text").withColumn("__place", place.cast("int")).drop("__text", "__label")
    else:
        found = memberships(base, model, "__text", "__label" if labels else None).drop("__text", "__label")
    members = staged(found, "members")
    if targets is None:
        in_it = lambda j: F.when(F.col("__place") > 0, F.col("__place") == j + 1).otherwise(F.get("posterior", j) > 0) if both else F.get("posterior", j) > 0
        sums = members.agg(*[F.max((F.col("n_tokens") > 0) & in_it(j)) for j in range(len(model.domains))]).first()
        want = [float(bool(x)) for x in sums]
        want = want if any(want) else [1.0] * len(want)
    else:
        want = [float(targets.get(d, 0.0)) for d in model.domains]
    fitted = (fit_both if both else fit_rates)(members, want)
    if not fitted.converged:
        warnings.warn(f"targets missed by up to {fitted.residual:.2g} of the largest after {fitted.steps} steps", stacklevel=2)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    if both:
        best = F.when(F.col("__place") > 0, F.col("__place") - 1).otherwise(best)
    return fitted.rows.select(
        *own,
        "n_tokens",
        F.get(names, best).alias("domain"),
        F.get("posterior", best).alias("membership"),
        "rate",
        F.floor(F.col("rate") + sha_uniform(F.col("__id"), "copies")).alias("copies"),
        F.lit(fitted.residual).alias("residual"),
    )


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, docs, domain_col="source", both=True)
