"""A repository after crashes and conflicts made on purpose, its guards, and trees read from folders."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.model import InvalidInput, NestedRepo
from palimpsest.repo import Repo
from palimpsest.sources.tree import ignore_rules, read_tree

NOW = datetime(2024, 1, 31)


@pytest.fixture
def repo(spark, tmp_path):
    return Repo.create(spark, str(tmp_path / "repo"))


def tree(spark, **files):
    rows = [(k, v.encode() if isinstance(v, str) else v) for k, v in files.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def content(df):
    return {r["path"]: bytes(r["content"]) for r in df.collect()}


class Crash(Exception):
    pass


@pytest.mark.parametrize("retry", ["same writer", "new writer", "other commit first"])
def test_a_crash_between_append_and_commit(spark, repo, monkeypatch, retry):
    repo.save(tree(spark, a="1"), "one", now=NOW)

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(Repo, "_commit", crash)
        with pytest.raises(Crash):
            repo.save(tree(spark, a="lost", b="lost"), "two", now=NOW)
    assert content(Repo(spark, repo.path).checkout()) == {"a": b"1"}
    if retry != "same writer":
        repo = Repo(spark, repo.path)
    if retry == "other commit first":
        repo.tag("t")
    repo.save(tree(spark, a="2"), "two", now=NOW)
    again = Repo(spark, repo.path)
    assert content(again.checkout()) == {"a": b"2"} and again.table("file_map").count() == 2
    again.verify()


def test_binary_files_in_conflict(spark, repo):
    odd = {side: bytes([0xFF, 0xFD, 0x00]) + side.encode() for side in ("base", "ours", "theirs")}
    repo.save(tree(spark, bin=odd["base"], text="1\n2\n3\n"), "base", now=NOW)
    repo.switch("dev")
    repo.save(tree(spark, bin=odd["theirs"], text="1\n2\nT\n"), "dev", now=NOW)
    repo.switch("main")
    repo.save(tree(spark, bin=odd["ours"], text="1\n2\nO\n"), "main", now=NOW)
    for take in ("both_ours", "ours", "theirs"):
        assert repo.merge("dev", now=NOW)["conflicts"] == 2
        assert [r["path"] for r in repo.conflict_hunks().collect()] == ["text"]
        if take == "both_ours":
            with pytest.raises(InvalidInput):
                repo.resolve(take, now=NOW)
            repo.abort()
            continue
        if take == "theirs":
            repo.decide("bin", 0, "ours")
        repo.resolve(take, now=NOW)
        got = content(repo.checkout())
        assert got["bin"] == odd["ours"] and got["text"].decode() == "1\n2\n" + take[0].upper() + "\n"
        repo.undo(NOW)


def test_guards(spark, repo, tmp_path):
    repo.save(tree(spark, a="1"), "one", now=NOW)
    repo.save(tree(spark, a="2"), "two", now=NOW)
    dirty, clean = tree(spark, a="changed"), tree(spark, a="2")
    for act in (repo.undo, repo.redo, lambda working: repo.switch("dev", working), lambda working: repo.merge("dev", working=working), lambda working: repo.rebase("dev", working=working), lambda working: repo.cherry_pick("dev", working=working)):
        with pytest.raises(InvalidInput, match="changes"):
            act(working=dirty)
    assert repo.switch("dev", clean) == repo.state.parent
    with pytest.raises(NestedRepo):
        Repo.create(spark, repo.path + "/in/side")


def test_collected_folders_are_deleted(spark, repo, tmp_path):
    for k in range(3):
        repo.save(tree(spark, a=f"{k}" * 5000), f"{k}", now=NOW)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "repo").rglob("*") if p.is_file())
    repo.squash(3, "all", now=NOW)
    before = size()
    out = repo.gc(0, datetime(2030, 1, 1))
    assert out["removed"] == 2 and out["freed"] == 10_000 and size() < before
    again = Repo(spark, repo.path)
    assert content(again.checkout()) == {"a": b"2" * 5000} and again.save(tree(spark, a="new"), "new", now=NOW)["modified"] == 1


def test_description_of_a_snapshot(spark, repo):
    repo.save(tree(spark, a="1", b="1"), "one", now=NOW)
    h = repo.save(tree(spark, a="2", c="1"), "two", now=NOW)["hash"]
    repo.tag("v1", h)
    row = repo.describe("v1").first()
    assert (row["message"], row["new"], row["modified"], row["deleted"], row["short"], row["date"]) == ("two", 1, 1, 1, h[:8], "2024-01-31 00:00")


def test_trees_of_folders(spark, repo, tmp_path):
    root = tmp_path / "work"
    for name, data in {"a.txt": b"a", ".hidden": b"h", "sub/b.log": b"l", "sub/c.txt": b"c", ".git/x": b"g", "target/y": b"t", "state/z": b"s", ".rules": b"# logs\n*.log\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rules = ignore_rules(spark, str(root / ".rules"))
    t = read_tree(spark, str(root), rules, "state")
    assert content(t) == {"a.txt": b"a", "sub/c.txt": b"c"}
    assert {r["path"]: r["size"] for r in t.select("path", "size").collect()}["sub/c.txt"] == 1
    assert repo.save(t, "tree", now=NOW)["new"] == 2 and repo.status(t).count() == 0


def test_tables_without_a_later_column(spark, repo, tmp_path):
    h = repo.save(tree(spark, a="1"), "one", now=NOW)["hash"]
    at = f"{repo.path}/tables/snapshots/{repo.state.tables['snapshots']}"
    old = spark.createDataFrame(repo.table("snapshots").drop("merge_parent").collect())
    old.write.mode("overwrite").parquet(at)
    again = Repo(spark, repo.path)
    assert again.table("snapshots").first()["merge_parent"] == ""
    again.save(tree(spark, a="2"), "two", now=NOW)
    assert [(r["parent_hash"], r["merge_parent"]) for r in again.table("snapshots").orderBy("seq").collect()] == [("", ""), (h, "")]


def test_short_forms(spark):
    df = spark.createDataFrame([("0123456789abcdef", NOW, 1536)], "h string, at timestamp, n long")
    got = df.select(text.short_id(F.col("h")), text.short_date(F.col("at")), text.kilobytes(F.col("n"))).first()
    assert tuple(got) == ("01234567", "2024-01-31 00:00", "1.5 KB")
