"""Cases of the review: catalog queries that read a constant part of their tables."""

from __future__ import annotations

from collections import defaultdict

from palimpsest.functions import myers
from palimpsest.operators.textdiff import _lines
from palimpsest.plans import catalog
from palimpsest.sources.fixtures import Fixtures


def test_every_version_reaches_the_conflict_queries(spark, sf):
    texts = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        texts[r["source"]].append(r["text"])
    want = {}
    for path, ts in texts.items():
        for n, three in enumerate(zip(ts, ts[1:], ts[2:]), 1):
            want[f"{path}@{n}"] = sum(isinstance(h, myers.Hunk) for h in myers.merge_texts(*map(_lines, three)))
    taken = catalog.QUERIES["resolve_take"](spark, sf).collect()
    assert len(taken) == len(want) and {r["path"]: r["conflicts"] for r in taken} == want
    clashes = catalog.QUERIES["conflict_hunks"](spark, sf).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in clashes} == {p: n for p, n in want.items() if n}


def test_runs_of_versions_lose_no_triple(spark, sf):
    f = Fixtures(spark, sf)
    whole = sorted(map(tuple, catalog._triples(f).collect()))
    assert all(sorted(map(tuple, catalog._triples(f, span).collect())) == whole for span in (1, 2, 3, 4))
