from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from strandline.operators import changes
from strandline.plans.snapshot import Store, build, to_records
from strandline.sources import files, git
from strandline.streaming.live import LiveIndex, change_feed


def _git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@b.c", "-c", "init.defaultBranch=main", *args], check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {"a.md": "alpha\n\nbeta", "sub/b.py": "x = 1\r\ny = 2\r\n", "bin/c.md": "skipped", "d.exe": "no", "blank.txt": "\n \n", "E.MD": "upper"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    return root


def shown(df):
    return sorted((r["location"], r["title"], r["text"]) for r in df.collect())


TREE = [("E.MD:1-1", "E.MD", "upper"), ("a.md:1-3", "a.md", "alpha\n\nbeta"), ("sub/b.py:1-2", "b.py", "x = 1\ny = 2")]


def test_walk(spark, tree):
    assert shown(files.scan_directory(spark, str(tree))) == TREE


def test_spark_listing(spark, tree):
    assert shown(files.scan_directory(spark, f"file://{tree}")) == TREE


def test_git_listing_and_ignore(spark, tree):
    _git(tree, "init")
    (tree / ".gitignore").write_text("sub/\n")
    assert [r[0] for r in shown(files.scan_directory(spark, str(tree)))] == ["E.MD:1-1", "a.md:1-3"]
    assert shown(files.scan_paths(spark, str(tree), ["sub/b.py", "gone.md", "d.exe", "a.md"])) == [TREE[1]]
    assert [r[0] for r in shown(files.scan_paths(spark, str(tree), ["sub/b.py"], check_ignored=False))] == ["sub/b.py:1-2"]


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_directory(spark, str(tmp_path / "none"))


def test_commits(spark, tree):
    _git(tree, "init")
    _git(tree, "add", ".")
    _git(tree, "commit", "-m", "First one", "-m", "With a body\nof two lines")
    _git(tree, "commit", "--allow-empty", "-m", "Second")
    rows = git.scan_commits(spark, str(tree), 10).collect()
    assert [r["text"] for r in rows] == ["Second", "First one\n\nWith a body\nof two lines"]
    assert rows[0]["title"].startswith("Second  (Ann, 20")
    assert git.scan_commits(spark, str(tree), 1).count() == 1
    with pytest.raises(RuntimeError):
        git.scan_commits(spark, "/nonexistent")


def test_log_parse_drops_short_records(spark):
    raw = spark.createDataFrame([("\nabc\x1fAnn\x1f2024-01-01\x1fFix\x1f \n\x1e\nbad\x1frecord\x1e\n",)], "value string")
    assert [tuple(r) for r in git.parse_log(raw).collect()] == [("git", "abc", "Fix  (Ann, 2024-01-01)", "Fix")]


def test_filters(spark):
    paths = ["a.md", "A.CS", "x/bin/a.md", "x/BIN/a.md", "bin.md", "a.exe", "md", "x\\obj\\a.md", "target"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r["p"] for r in df.where(files.should_index(F.col("p"))).collect()] == ["a.md", "A.CS", "bin.md"]


def test_coalesce_and_subtrees(spark):
    feed = spark.createDataFrame([(1, "a", "Upsert"), (3, "a", "Delete"), (2, "a", "Upsert"), (4, "b", "Upsert")], "seq long, path string, kind string")
    assert {r["path"]: r["kind"] for r in changes.coalesce_changes(feed).collect()} == {"a": "Delete", "b": "Upsert"}
    base = spark.createDataFrame([(p,) for p in ("d", "d/x.md", "d/e/y.md", "dd/z.md", "D/q.md", "d/x.md")], "path string")
    gone = spark.createDataFrame([("d/",), ("none",)], "path string")
    assert sorted(r["path"] for r in changes.without_subtrees(base, gone).collect()) == ["D/q.md", "dd/z.md"]
    assert sorted(r["path"] for r in changes.without_subtrees(base, gone, ignore_case=True).collect()) == ["dd/z.md"]


def test_live_index(spark, tree, tmp_path):
    root = str(tree)
    store = Store(spark, f"file://{tmp_path}/index")
    store.save(build(to_records(files.scan_directory(spark, root))), 2)
    passages_of = lambda paths: files.scan_paths(spark, root, [r["path"] for r in paths.collect()])
    live = LiveIndex(store, passages_of)
    feed = tmp_path / "feed"
    feed.mkdir()
    query = live.start(change_feed(spark, str(feed)), str(tmp_path / "checkpoint"), 100)
    try:
        (tree / "a.md").write_text("gamma delta")
        (tree / "new.md").write_text("epsilon")
        lines = ['{"seq":1,"path":"a.md","kind":"Delete"}', '{"seq":2,"path":"a.md","kind":"Upsert"}', '{"seq":3,"path":"new.md","kind":"Upsert"}', '{"seq":4,"path":"sub","kind":"Delete"}', '{"seq":5,"path":"bin/c.md","kind":"Upsert"}']
        (tmp_path / "1.json").write_text("\n".join(lines))
        (tmp_path / "1.json").rename(feed / "1.json")
        query.processAllAvailable()
        now = sorted((r["location"], r["text"]) for r in live.index().records.collect())
        assert now == [("E.MD:1-1", "upper"), ("a.md:1-1", "gamma delta"), ("new.md:1-1", "epsilon")]
        assert live.file_count() == 3
        # the same as a build from what is there
        (tree / "sub" / "b.py").unlink()
        fresh = build(to_records(files.scan_directory(spark, root)))
        same = lambda i: sorted(map(tuple, i.body_postings.collect()))
        assert same(live.index()) == same(fresh)
    finally:
        query.stop()


def test_ignored_files_leave_with_the_next_burst(spark, tree, tmp_path):
    root = str(tree)
    store = Store(spark, f"file://{tmp_path}/index")
    store.save(build(to_records(files.scan_directory(spark, root))), 2)
    passages_of = lambda paths: files.scan_paths(spark, root, [r["path"] for r in paths.collect()], check_ignored=False)
    live = LiveIndex(store, passages_of, ignored=lambda paths: paths.where("path = 'skip.md'"))
    (tree / "skip.md").write_text("ignored text")
    change = lambda *rows: spark.createDataFrame(list(rows), "seq long, path string, kind string")
    live.apply(change((1, "skip.md", "Upsert")))
    assert live.file_count() == 4
    assert store.late() == ["skip.md"]
    live = LiveIndex(Store(spark, store.root), passages_of)  # a restart knows what is to go
    live.apply(change((2, "none.md", "Delete")))
    assert live.file_count() == 3 and store.late() == []


def test_folder_watcher(spark, tree, tmp_path):
    import os

    from strandline.schemas import CHANGE
    from strandline.streaming.watch import FolderWatcher

    feed, state = tmp_path / "feed", tmp_path / "listing"
    watcher = FolderWatcher(spark, str(tree), str(feed), str(state))
    watcher.baseline()
    assert watcher.poll() == 0
    (tree / "new.md").write_text("new")
    (tree / "bin").mkdir(exist_ok=True)
    (tree / "bin" / "skipped.md").write_text("not taken")
    os.utime(tree / "a.md", (1, 1))
    (tree / "sub" / "b.py").unlink()
    again = FolderWatcher(spark, str(tree), str(feed), str(state))  # a restart goes on
    assert again.poll() == 3 and again.poll() == 0
    (tree / "sub" / "b.py").write_text("back")
    assert again.poll() == 1
    rows = spark.read.schema(CHANGE).json(str(feed)).orderBy("seq", "path").collect()
    assert [(r["path"], r["kind"]) for r in rows] == [("a.md", "Upsert"), ("new.md", "Upsert"), ("sub/b.py", "Delete"), ("sub/b.py", "Upsert")]
    assert rows[2]["seq"] < rows[3]["seq"]
    # without an earlier listing all files are new, and Spark's own listing finds the same
    fresh = FolderWatcher(spark, f"file://{tree}", str(tmp_path / "feed2"), str(tmp_path / "listing2"))
    assert fresh.poll() == len(files.local_files(str(tree)))


def test_a_work_tree_where_all_is_ignored(spark, tmp_path):
    import subprocess

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".git" / "info").mkdir(exist_ok=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("*\n")
    (tmp_path / "a.md").write_text("secret words\n")
    from strandline.sources.files import scan_directory

    assert scan_directory(spark, str(tmp_path)).count() == 0
