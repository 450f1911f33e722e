"""Walking source trees: ignore files, dotted names, guards before reading."""

import os
import subprocess

import pytest

from fathomline.sources import git, ignore, repo


def test_ignore_rules():
    rules = ignore.parse("# c\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/*.tmp\na/**\n[ab].x\n\\#odd\n")
    gone = lambda p, d=False: ignore.ignored(p, d, [("", rules)])
    assert gone("x.log") and gone("s/x.log") and not gone("s/keep.log") and gone("build", True) and not gone("build")
    assert gone("top.txt") and not gone("s/top.txt") and gone("docs/a/b/c.tmp") and gone("docs/c.tmp") and not gone("c.tmp")
    assert gone("a/b") and not gone("a", True) and gone("s/a.x") and not gone("c.x") and gone("#odd")
    assert not ignore.ignored("sub/x.log", False, [("", rules), ("sub/", ignore.parse("!*.log"))])


def test_scan_honours_ignores_and_keeps_dotted_names(spark, tmp_path):
    root = tmp_path / "c++ (x)"
    files = {".gitignore": "*.log\nout/\n", "a.log": "x", "out/b.py": "x", "sub/.gitignore": "!a.log\n", "sub/a.log": "kept", "pkg/__init__.py": "y = 1\n", ".github/workflows/ci.yml": "on: push\n", ".git/config": "z", "node_modules/m.js": "x", "bin.dat": "a\0b", "big.py": "#" * (repo.MAX_BYTES + 1), "run": "#!/bin/bash\necho\n"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {r.path: r.content for r in repo.scan(spark, str(root)).collect()}
    assert set(got) == {".gitignore", "sub/.gitignore", "sub/a.log", "pkg/__init__.py", ".github/workflows/ci.yml", "run"} and got["sub/a.log"] == "kept"
    assert {r.path: r.language for r in repo.with_language(repo.scan(spark, f"file://{os.fspath(root)}".replace(" ", "%20"))).collect()} == {"pkg/__init__.py": "python", "run": "bash"}
    assert "a.log" in {r.path for r in repo.listing(spark, str(root), honour_ignores=False).collect()}


def test_facts_of_version_control(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    assert tuple(git.log(spark, str(tmp_path)).first())[0] == 0
    run("init", "-q")
    run("config", "user.name", "Someone")
    run("config", "user.email", "s@example.org")
    (tmp_path / ".env").write_text("A=1")
    run("add", "-f", ".env")
    run("commit", "-qm", "one")
    row = git.log(spark, str(tmp_path)).first()
    assert (row.n_commits, row.contact, row.env_tracked) == (1, "Someone", True) and row.last_commit is not None


TREE = {
    ".gitignore": "*.log\n/skip/\n!keep.log\nout\n", ".git/info/exclude": "private/\n*.swp\n", ".git/config": "x",
    "a.log": "", "keep.log": "", "skip/x.py": "", "skip/.gitignore": "!x.py\n", "b/skip/x.py": "", "b/out/y.py": "", "b/out.py": "",
    "b/.gitignore": "!a.log\n/c/*.txt\n!/c/t.txt\nlogs/**\n", "b/a.log": "", "b/c/s.txt": "", "b/c/t.txt": "", "b/c/d/s.txt": "", "b/c/.gitignore": "t.txt\n!s.txt\nd/\n", "b/logs/deep/er/z.py": "",
    "private/p.py": "", "b/private/q.py": "", "b/e.swp": "", "d/é ü/.hidden/__init__.py": "", "d/.gitignore": "# only a comment\n\\#odd\n", "d/#odd": "", "empty/.keep": "",
}


def test_a_frontier_of_directories_finds_what_version_control_does(spark, tmp_path):
    """The same files as git itself lists, whatever the share of a task: all below one directory, or a directory each."""
    for name, text in TREE.items():
        if not name.startswith(".git/"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(text)
    git_ = lambda *a: subprocess.run(["git", "-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True).stdout
    git_("init", "-q")
    (tmp_path / ".git/info").mkdir(exist_ok=True)
    (tmp_path / ".git/info/exclude").write_text(TREE[".git/info/exclude"])
    want = set(git_("ls-files", "-z", "--others", "--exclude-standard").split("\0")) - {""}
    assert "b/a.log" in want and "b/c/s.txt" in want and "skip/x.py" not in want
    for share in (1, 7, 5_000):
        found = repo.listing(spark, str(tmp_path), share=share)
        assert {r.path for r in found.collect()} == want and found.count() == len(want)
    everything = {r.path for r in repo.listing(spark, str(tmp_path), honour_ignores=False, share=3).collect()}
    assert everything == {n for n in TREE if not n.startswith(".git/")}


def test_listing_reads_nothing_on_the_driver(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"d{i % 20}/e{i % 7}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 20}/e{i % 7}/f{i}.py").write_text("")
    monkeypatch.setattr(repo, "_below", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="(?s)Python worker.*ZeroDivisionError"):  # so it is a task that lists
        repo.listing(spark, str(tmp_path), share=10).count()
    monkeypatch.undo()
    assert repo.listing(spark, str(tmp_path), share=10).count() == 300 and repo.listing(spark, str(tmp_path / "none")).count() == 0


def test_deposited_files_are_scanned(spark, tmp_path):
    rows = [(f"p{i % 3}/f{i}.py", f"x = {i}\n") for i in range(40)] + [("n.py", None)]
    made = repo.deposit(spark.createDataFrame(rows, "path string, content string").repartition(3), f"file://{tmp_path}/tree")
    assert made.count() == 41
    assert {(r.path, r.content) for r in repo.scan(spark, f"file://{tmp_path}/tree").collect()} == {(p, c or "") for p, c in rows}
