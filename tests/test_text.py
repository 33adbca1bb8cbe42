"""Properties of the line diff and the text merge, and of the scalar text functions."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import myers, text
from palimpsest.model import InvalidInput
from palimpsest.operators import intervals, search

TEXT = st.lists(st.sampled_from("abcd"), max_size=12)


def flat(parts, decision):
    return [x for p in parts for x in (myers.decide(p, decision) if isinstance(p, myers.Hunk) else p)]


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, TEXT)
def test_diff_and_merge(a, b, c):
    ops = myers.diff(a, b)
    assert myers.patch(a, ops, b) == b
    rows = myers.rows(a, b)
    assert [r[4] for r in rows if r[1] != "insert"] == a and [r[4] for r in rows if r[1] != "delete"] == b
    assert flat(myers.merge_texts(a, b, a), "ours") == b
    assert flat(myers.merge_texts(a, a, b), "ours") == b
    assert flat(myers.merge_texts(a, b, b), "theirs") == b
    hunks = lambda x, y: [(h.start, h.end) for h in myers.merge_texts(a, x, y) if isinstance(h, myers.Hunk)]
    assert hunks(b, c) == hunks(c, b)


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_diffs_are_shortest(a, b):
    equal = [o for o in myers.diff(a, b) if o[0] == "equal"]
    assert sum(o[2] - o[1] for o in equal) == _longest(a, b)
    assert all(a[o[1] : o[2]] == b[o[3] : o[4]] for o in equal)


def test_memory_of_a_diff():
    """Lines that occur on both sides in another order: quadratic work, linear memory."""
    import tracemalloc

    a, b = [f"{k % 50}" for k in range(1500)], [f"{k * 7 % 53}" for k in range(1500)]
    tracemalloc.start()
    assert myers.patch(a, myers.diff(a, b), b) == b
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()
    assert myers.diff([f"a{k}" for k in range(20_000)], [f"b{k}" for k in range(20_000)]) == [("replace", 0, 20_000, 0, 20_000)]


def test_merge_cases():
    both = myers.merge_texts(["def f", "return"], ["def f", "x = 1", "return"], ["def f", "y = 2", "return"])
    assert flat(both, "ours") == ["def f", "x = 1", "return"] and flat(both, "both_ours") == ["def f", "x = 1", "y = 2", "return"]
    apart = myers.merge_texts(list("abcdefg"), list("Xbcdefg"), list("abcdefY"))
    assert apart and flat(apart, "ours") == list("XbcdefY")
    mixed = myers.merge_texts(list("abcdefg"), list("Xbcdeog"), list("Zbcdefg"))
    assert flat(mixed, "theirs") == list("Zbcdeog")


def test_hunks_of_a_large_text():
    a = [f"line {i}" for i in range(100)]
    b = [*a[:50], "changed", *a[51:]]
    assert {r[0] for r in myers.rows(a, b, 3)} == {0} and len(myers.rows(a, b, 3)) == 8


def test_scalar_functions(spark):
    data = [("a\r\nb\rc\n",), ("x\x00\r\n",), ("",), ("one",), ("﻿q\n\n",)]
    df = spark.createDataFrame(data, "t string")
    got = df.select(text.stored_text(F.col("t")), text.diff_text(F.col("t")), text.lines(F.col("t")), text.is_binary(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a\nbc\n", "x\x00\r\n", "", "one", "﻿q\n\n"]
    assert got[0][1] == "a\nb\nc\n" and got[4][1] == "q\n\n"
    assert [r[2] for r in got][2:] == [[], ["one"], ["﻿q", ""]]
    assert [r[3] for r in got] == [False, True, False, False, False]


def test_ignore_rules(spark):
    pattern = text.ignore_pattern(["# note", "*.log", "target/", "/only_top", "docs/**/tmp"])
    paths = ["a.log", "x/b.log", "x/target/y", "target", "only_top", "x/only_top", "docs/a/b/tmp", "docs/tmp", "a.logs"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.where(F.col("p").rlike(pattern)).collect()] == ["a.log", "x/b.log", "x/target/y", "only_top", "docs/a/b/tmp", "docs/tmp"]


def test_grep_context_and_errors(spark):
    df = spark.createDataFrame([("f", i, "hit" if i in (3, 5, 12) else "-") for i in range(1, 15)], "path string, line_no int, line string")
    got = search.grep_context(df, "hit", 2).orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14]
    assert [r["line_no"] for r in got if r["new_block"]] == [1, 10] and [r["line_no"] for r in got if r["is_match"]] == [3, 5, 12]
    for bad in ("(", "(?=x)", r"(a)\1", "(?P<name>x)"):
        with pytest.raises(InvalidInput):
            search.grep(df, bad)


def test_overlaps_across_bins(spark):
    import random

    r = random.Random(7)
    rows = [("p", r.choice(["ours", "theirs"]), s, s + r.choice([0, 1, 5, 300, 2000])) for s in (r.randrange(1500) for _ in range(60))]
    rows += [("p", "ours", 256, 256), ("p", "theirs", 0, 256), ("p", "theirs", 256, 256), ("p", "ours", 255, 257), ("q", "theirs", 0, 9)]

    def meet(a, b, c, d):
        if a == b or c == d:
            return a == c if a == b and c == d else c <= a <= d if a == b else a <= c <= b
        return a < d and c < b

    want = sorted((p, a, b, c, d) for p, s, a, b in rows for q, t, c, d in rows if p == q and s == "ours" and t == "theirs" and meet(a, b, c, d))
    df = spark.createDataFrame(rows, "path string, side string, start int, end int")
    assert sorted(map(tuple, intervals.overlaps(df).collect())) == want


def test_touching_ranges(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 2, 3), ("a", 5, 5), ("a", 6, 7)], "k string, start int, end int")
    assert sorted(map(tuple, intervals.coalesced(df, ["k"]).collect())) == [("a", 0, 3), ("a", 5, 5), ("a", 6, 7)]


def test_coalesced_ranges_with_nulls_and_ties(spark, tmp_path):
    """As in the SQL, which puts nulls last; with one thread it keeps ties in one order."""
    import duckdb

    from palimpsest.plans import catalog

    lines = [(1, 2, None), (1, 2, 3), (1, 9, 1), (1, 9, 1), (2, None, 1), (2, None, 1), (2, None, None), (2, 7, 2), (3, 4, None), (3, 4, None), (3, 5, 2), (None, 1, 1)]
    df = spark.createDataFrame([(k, p, s, 1) for k, p, s in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(map(repr, c.sql(catalog.ORACLE_SQL["interval_coalesce"]).fetchall()))
    got = catalog.QUERIES["interval_coalesce"](spark, str(tmp_path)).select("path", "side", "start", "end_").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
