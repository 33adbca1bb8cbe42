"""Every query of the catalog against its SQL in DuckDB; the others against brute force."""

from __future__ import annotations

import duckdb
import pytest

from palimpsest.functions import myers
from palimpsest.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def _versions(duck):
    out = {}
    for source, text in duck.sql("select source, text from documents order by doc_id").fetchall():
        out.setdefault(source, []).append([x for x in text.split("\n")][: -1 if text.endswith("\n") else None])
    return out


def test_blame_against_a_fold(spark, sf, duck):
    want = set()
    for path, versions in _versions(duck).items():
        origin = [1] * len(versions[0])
        for n, (a, b) in enumerate(zip(versions, versions[1:]), 2):
            new = [n] * len(b)
            for tag, i1, i2, j1, _ in myers.diff(a, b):
                if tag == "equal":
                    new[j1 : j1 + i2 - i1] = origin[i1:i2]
            origin = new
        want |= {(path, k + 1, line, v) for k, (line, v) in enumerate(zip(versions[-1], origin))}
    got = {tuple(r) for r in catalog.QUERIES["blame"](spark, sf).select("path", "line_no", "line", "version").collect()}
    assert got == want


def test_line_diff_rebuilds_both_sides(spark, sf, duck):
    from palimpsest.operators import textdiff
    from palimpsest.sources.fixtures import Fixtures

    d = textdiff.line_diff(textdiff.consecutive(Fixtures(spark, sf).doc_versions), None).orderBy("path", "version", "row").toPandas()
    versions = _versions(duck)
    for (path, v), g in d.groupby(["path", "version"]):
        assert list(g[g.tag != "delete"].line) == versions[path][v - 1]
        assert list(g[g.tag != "insert"].line) == (versions[path][v - 2] if v > 1 else [])


def test_other_texts_and_graph(spark, sf):
    hunks = catalog.QUERIES["diff_hunks"](spark, sf).collect()
    assert hunks and all(h["deleted"] + h["inserted"] > 0 for h in hunks)
    clashes = catalog.QUERIES["conflict_hunks"](spark, sf).groupBy("path").count().collect()
    taken = {r["path"]: r["conflicts"] for r in catalog.QUERIES["resolve_take"](spark, sf).collect()}
    assert {r["path"]: r["count"] for r in clashes} == {p: n for p, n in taken.items() if n}
    lanes = catalog.QUERIES["history_graph"](spark, sf).collect()
    assert [r["position"] for r in lanes] == list(range(1, len(lanes) + 1)) and all(0 <= r["lane"] < r["lanes"] for r in lanes)
