"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import release, shared_dir, staged  # noqa: F401  for the operators beside

#: White space of the word rules: space and the ASCII controls 0x09 to 0x0D.
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """True for one row in five: crc32 of the id as text is divisible by 5 (null id: text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sha_uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) drawn from the key alone, the same on every cluster and run."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """Running totals of an array of long, block by block.

    Appending to an array copies it, so one fold over n numbers costs n squared; with
    blocks the cost is n times the block size.
    """

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(
            xs,
            start,
            lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["a"], acc["t"] + x).alias("a")),
            lambda acc: acc["a"],
        )

    def of(ns: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / F.lit(block)).cast("int")),
            lambda c: fold(F.slice(ns, c * block + 1, block)),
        )
        return let(
            parts,
            lambda ps: let(
                fold(F.transform(ps, lambda p: F.element_at(p, -1))),
                lambda ends: F.flatten(
                    F.transform(
                        ps,
                        lambda p, i: let(
                            F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long")), lambda o: F.transform(p, lambda x: x + o)
                        ),
                    )
                ),
            ),
        )

    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(let(numbers, of))


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Let Arrow batches hold at most ``rows`` rows, so that very long texts fit a worker.

    The setting stays with the session: plans read it when they run, after the call has ended.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, inputs: list[str], fn: Callable, new: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of the DDL ``new``: ``fn()`` is called once per task and gives a
    function from lists of the input columns to a list of tuples.

    All other columns pass through as Arrow arrays, nulls and nested types included; input
    columns that clash with new ones, and those in ``drop``, go.  No shuffle.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T._parse_datatype_string(new)
    gone = {n.lower() for n in (*added.names, *drop)}
    kept = [k for k, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    at = [df.schema.names.index(c) for c in inputs]
    schema = T.StructType([df.schema.fields[k] for k in kept] + added.fields)

    def run(batches):
        import pyarrow as pa

        work, arrow = fn(), to_arrow_schema(added)
        for b in batches:
            rows = work(*[b.column(k).to_pylist() for k in at])
            columns = list(zip(*rows)) if rows else [()] * len(added.fields)
            made = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + made, names=schema.names)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
