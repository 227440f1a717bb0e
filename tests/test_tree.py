"""Trees listed by level on the executors, against the standard library's walk."""

import hashlib
import os
import time

import pytest

from stratalens.sources import repo, tree


def walked(root, excludes=repo.EXCLUDES, suffixes=None):
    out = set()
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not any(x in f"{folder}/{d}/" for x in excludes)]
        out |= {os.path.realpath(f"{folder}/{n}") for n in names if not any(x in f"{folder}/{n}" for x in excludes) and (suffixes is None or n.endswith(suffixes))}
    return out


@pytest.fixture
def made(tmp_path):
    for i in range(3):
        for j in range(4):
            d = tmp_path / f"a{i}" / f"b{j}" / "c"
            d.mkdir(parents=True)
            for k in range(3):
                (d / f"f{k}.py").write_text(f"x = {i}{j}{k}\n" * (k + 1))
            (d.parent / "_private.md").write_text("")
    (tmp_path / "a0" / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "a0" / "node_modules" / "x" / "skipped.py").write_text("")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.py").write_text("é\n")
    os.symlink(tmp_path / "a1" / "b0" / "c" / "f0.py", tmp_path / "a2" / "link.py")
    os.symlink(tmp_path / "a1", tmp_path / "a2" / "folder_link")
    os.symlink(tmp_path / "nowhere", tmp_path / "a2" / "broken.py")
    return tmp_path


def listed(df):
    rows = [r["path"] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_listing_equals_a_walk(spark, made, monkeypatch):
    root = str(made)
    assert listed(repo.paths(spark, [root])) == walked(root)
    assert listed(repo.paths(spark, [root, f"{root}/a1", root + "/"])) == walked(root)
    assert listed(repo.paths(spark, [root], suffixes=(".md",))) == walked(root, suffixes=(".md",))
    assert listed(tree.files(spark, [f"{root}/none"], ())) == set() and listed(tree.files(spark, [], ())) == set()
    monkeypatch.setenv("MORE_EXCLUDES", " /b1/ : /b2/:")
    assert listed(repo.paths(spark, [root], "MORE_EXCLUDES")) == walked(root, (*repo.EXCLUDES, "/b1/", "/b2/"))


def test_digests_are_those_of_the_whole_files(spark, made, monkeypatch):
    big = made / "a0" / "big.bin"
    big.write_bytes(os.urandom(200_000) + b"\n" * 3)
    (made / "a0" / "empty").write_text("")
    got = {r["path"]: (r["sha256"], r["size"], r["line_count"]) for r in tree.digests(tree.files(spark, [str(made)], repo.EXCLUDES)).collect()}
    want = {p: open(p, "rb").read() for p in walked(str(made)) if os.path.exists(p)}
    assert got == {p: (hashlib.sha256(b).hexdigest(), len(b), b.count(b"\n") + 1) for p, b in want.items()}


def test_a_wide_tree(spark, tmp_path):
    """20,000 files in 2,000 folders: the driver sees counts only."""
    for i in range(2000):
        d = tmp_path / f"p{i % 40}" / f"d{i}"
        d.mkdir(parents=True)
        for k in range(10):
            (d / f"{k}.py").touch()
    start = time.time()
    assert tree.files(spark, [str(tmp_path)], repo.EXCLUDES).count() == 20_000 and time.time() - start < 60
