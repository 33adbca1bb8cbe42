"""Scenarios on a repository: what its users do, step by step."""

from __future__ import annotations

from datetime import datetime

import pytest

from palimpsest.model import AlreadyInitialized, InvalidInput, NotARepo
from palimpsest.repo import Repo

NOW = datetime(2024, 1, 31)


@pytest.fixture
def repo(spark, tmp_path):
    return Repo.create(spark, str(tmp_path / "repo"))


def tree(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in files.items()], "path string, content string")


def content(df):
    return {r["path"]: bytes(r["content"]).decode() for r in df.collect()}


def test_saving_and_looking_back(spark, repo, tmp_path):
    with pytest.raises(AlreadyInitialized):
        Repo.create(spark, repo.path)
    with pytest.raises(NotARepo):
        Repo(spark, str(tmp_path / "none"))
    one = tree(spark, a="A\n", b="B\n")
    with pytest.raises(InvalidInput):
        repo.save(one, "  ")
    s1 = repo.save(one, "first", now=NOW)
    assert (s1["new"], s1["modified"], s1["deleted"]) == (2, 0, 0)
    assert repo.save(one, "again") is None
    two = tree(spark, a="A2\n", c="C\r\n")
    assert {r["path"]: r["status"] for r in repo.status(two).collect()} == {"a": "Modified", "b": "Deleted", "c": "New"}
    s2 = repo.save(two, "second", now=NOW)
    assert content(repo.checkout()) == {"a": "A2\n", "c": "C\n"} and content(repo.checkout(s1["hash"])) == {"a": "A\n", "b": "B\n"}
    again = Repo(spark, repo.path)
    assert again.resolve_ref(s2["hash"][:6]) == s2["hash"] and [r["hash"] for r in again.history().collect()] == [s2["hash"], s1["hash"]]
    repo.tag("v1", s1["hash"])
    with pytest.raises(InvalidInput):
        repo.tag("v1", s2["hash"])
    repo.tag("v1", s2["hash"], force=True)
    assert repo.resolve_ref("v1") == s2["hash"]
    assert repo.undo(NOW) == s1["hash"] and repo.tags().count() == 0
    assert repo.redo() == s2["hash"] and content(repo.checkout()) == {"a": "A2\n", "c": "C\n"}
    amended = repo.save(two, "better", amend=True, now=NOW)
    assert content(repo.checkout()) == {"a": "A2\n", "c": "C\n"}
    assert [r["parent_hash"] for r in repo.history().collect()] == [s1["hash"], ""]
    lines = {(r["tag"], r["line"]) for r in repo.diff_range(s1["hash"], amended["hash"]).collect()}
    assert lines == {("delete", "A"), ("insert", "A2"), ("delete", "B"), ("insert", "C")}
    repo.verify()


def test_blame_and_grep(spark, repo):
    hashes = [repo.save(tree(spark, f=t), f"v{k}", now=NOW)["hash"] for k, t in enumerate(["a\n", "a\nb\n", "X\na\nb\n"])]
    assert [(r["line"], r["hash"]) for r in repo.blame("f").orderBy("line_no").collect()] == [("X", hashes[2]), ("a", hashes[0]), ("b", hashes[1])]
    assert [r["line"] for r in repo.grep("^b", context=0).collect()] == ["b"]
    assert repo.grep("X", hashes[0]).count() == 0
    squashed = repo.squash(3, "all", now=NOW)
    assert repo.history().count() == 1 and repo.state.parent == squashed and content(repo.checkout()) == {"f": "X\na\nb\n"}
    freed = repo.gc(0, datetime(2030, 1, 1))
    assert freed["removed"] == 2


def test_merging(spark, repo):
    base = repo.save(tree(spark, app="1\n2\n3\n", gone="g\n"), "base", now=NOW)["hash"]
    repo.switch("dev")
    repo.save(tree(spark, app="1\n2\nDEV\n", new="n\n"), "dev", now=NOW)
    repo.switch("main")
    out = repo.merge("dev", now=NOW)
    assert out["conflicts"] == 0 and content(repo.checkout()) == {"app": "1\n2\nDEV\n", "new": "n\n"}
    repo.switch("left")
    repo.save(tree(spark, app="L\n2\nDEV\n", new="n\n"), "left", now=NOW)
    repo.switch("main")
    repo.save(tree(spark, app="M\n2\nDEV\n", new="n\n", extra="e\n"), "main", now=NOW)
    assert repo.merge("left", now=NOW)["conflicts"] == 1
    with pytest.raises(InvalidInput):
        repo.merge("left")
    h = repo.conflict_hunks().collect()
    assert [(x["ours"], x["theirs"], x["base"]) for x in h] == [(["M"], ["L"], ["1"])]
    tip = repo.abort()
    assert repo.merge("left", now=NOW)["conflicts"] == 1 and repo.state.parent == tip
    repo.decide("app", 0, "both_ours")
    repo.resolve("theirs", now=NOW)
    assert content(repo.checkout()) == {"app": "M\nL\n2\nDEV\n", "new": "n\n", "extra": "e\n"}
    merged = [r for r in repo.table("snapshots").collect() if r["merge_parent"]]
    assert len(merged) == 2 and base
    with pytest.raises(InvalidInput):
        repo.merge("main")
    repo.delete_branch("left")
    assert "left" not in {r["branch"] for r in repo.branches().collect()}


def test_pick_rebase_and_shelves(spark, repo):
    repo.save(tree(spark, a="a\n"), "base", now=NOW)
    repo.switch("feature")
    f1 = repo.save(tree(spark, a="a\n", f="f\n"), "feature", now=NOW)["hash"]
    repo.switch("main")
    repo.save(tree(spark, a="a\n", m="m\n"), "main", now=NOW)
    assert repo.cherry_pick(f1, now=NOW)["conflicts"] == 0
    assert content(repo.checkout()) == {"a": "a\n", "f": "f\n", "m": "m\n"}
    repo.undo(NOW)
    repo.switch("feature")
    assert repo.rebase("main", now=NOW)["conflicts"] == 0
    assert content(repo.checkout()) == {"a": "a\n", "f": "f\n", "m": "m\n"}
    dirty = tree(spark, a="changed\n", m="m\n")
    name = repo.stash_push(dirty, "wip", now=NOW)
    assert repo.stashes().count() == 1 and {r["branch"] for r in repo.branches().collect()} == {"main", "feature"}
    got = {r["path"]: r["action"] for r in repo.stash_pop(name).collect()}
    assert got == {"a": "write", "f": "delete"} and repo.stashes().count() == 0
    with pytest.raises(InvalidInput):
        repo.stash_show()
