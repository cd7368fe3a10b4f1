import os
import shutil
import subprocess

import pytest

from sourcelake.operators.ignores import ignored, rules
from sourcelake.sources.git import inspect, packed, tracked_paths

needs_git = pytest.mark.skipif(shutil.which("git") is None, reason="no git program")
PATHS = ["a.log", "keep.log", "src/a.py", "src/build/x.o", "src/build/keep/y.o", "docs/a b.md", "docs/x/deep/t.tmp", "build/z", "src/gen/one.py", "src/gen/two.py", "lib/a1.c", "lib/a2.c", "#odd", "nested/only.txt", "t/.hidden"]
IGNORES = {
    ".gitignore": "# notes\n*.log\n!keep.log\nbuild/\n\\#odd\n/nested/*\n!/nested/only.txt\nlib/a[1].c\n",
    "src/.gitignore": "gen/*\n!gen/two.py\n!build/\n",
    "docs/.gitignore": "**/*.tmp\na*   \n",
}


def git(folder, *words):
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    names = ["-c", "user.name=x", "-c", "user.email=x@example.com"]
    return subprocess.run(["git", "-C", str(folder), *names, *words], capture_output=True, text=True, env=env)


@pytest.fixture
def tree(tmp_path):
    git(tmp_path, "init", "-q", "-b", "main")
    for path in PATHS:
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(path)
    for path, text in IGNORES.items():
        (tmp_path / path).write_text(text)
    return tmp_path


@needs_git
def test_ignored_paths_equal_those_of_git(spark, tree):
    paths = PATHS + list(IGNORES)
    shown = git(tree, "check-ignore", "--no-index", *paths).stdout.split("\n")
    want = {line.strip('"') for line in shown if line}
    row = lambda ps: spark.createDataFrame([("r", p) for p in ps], "repo_id string, relative_path string")
    files = spark.createDataFrame([("r", p, t) for p, t in IGNORES.items()], "repo_id string, relative_path string, content string")
    got = {r.relative_path for r in ignored(row(paths + paths[:3]), files, row([])).where("ignored").collect()}
    assert got == want and {"a.log", "build/z", "src/gen/one.py"} <= want
    tracked = {r.relative_path for r in ignored(row(paths), files, row(["build/z", "a.log"])).where("ignored").collect()}
    assert tracked == want - {"build/z", "a.log"}


def test_ignored_of_empty_tables(spark):
    none = spark.createDataFrame([], "repo_id string, relative_path string, content string")
    one = spark.createDataFrame([("r", "a", None), ("r", None, None)], "repo_id string, relative_path string, content string")
    assert ignored(none, none, none).count() == 0
    assert [tuple(r) for r in ignored(one, one, none).collect()] == [("r", "a", False)]
    assert rules(None) == [] and rules("x\n" * 9000) is None and rules("y" * 2000) is None


@needs_git
def test_head_and_index_equal_those_of_git(tree):
    git(tree, "add", "src/a.py", "docs", "keep.log")
    state = inspect(str(tree))
    assert state.commit_sha is None and state.reference == "refs/heads/main"
    git(tree, "commit", "-q", "-m", "x")
    head = git(tree, "rev-parse", "HEAD").stdout.strip()
    want = frozenset(p for p in git(tree, "ls-files", "-z").stdout.split("\0") if p)
    assert inspect(str(tree)) == (head, "refs/heads/main", want) and len(want) >= 3
    git(tree, "pack-refs", "--all")
    assert inspect(str(tree)).commit_sha == head
    git(tree, "checkout", "-q", "--detach")
    assert inspect(str(tree))[:2] == (head, None)
    git(tree, "update-index", "--index-version", "4")
    assert inspect(str(tree)).tracked is None


def test_damaged_git_files(tmp_path):
    assert inspect(str(tmp_path)) == (None, None, None)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/../../x\n")
    assert inspect(str(tmp_path)) == (None, None, frozenset())
    assert tracked_paths(b"") is None and tracked_paths(b"DIRC" + bytes(60)) is None
    assert packed("# pack\n" + "a" * 40 + " refs/heads/m\n", "refs/heads/m") == "a" * 40
    assert packed("0" * 40 + " refs/heads/m\n", "refs/heads/m") is None
