import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from fernweave import cli
from fernweave.operators.store import GraphStore
from fernweave.plans import index
from fernweave.sources import git
from fernweave.streaming import flush


def write(root, tree):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build" / "tree"  # an excluded name above the root does not matter
    write(root, {"web/a.css": "body {\n}", "web/b.html": "<i id='x'>", "app/package.json": '{"dependencies": {"p": "1"}}', "app/pubspec.yaml": "dependencies:\n  q: 2\n", "node_modules/z.json": "{}", "d.xml": "<r/>", "bad.xml": "<r>"})
    return root


def lines(spark, *text):
    return spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "log string, ord int, line string")


def names(graph, table, column="key"):
    return sorted(r[0] for r in graph[table].select(column).collect())


def test_full_then_incremental_then_purge(spark, tree, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    log = lines(spark, "COMMIT|Ann <a>|2024-01-01T00:00:00Z|h1|tag: v1", "web/a.css", "d.xml")
    graph = index.index(spark, str(tree), store, "tree", index.Inputs(history=log), least="Public")
    assert names(graph, "file") == ["app/package.json", "app/pubspec.yaml", "bad.xml", "d.xml", "web/a.css", "web/b.html"]
    assert names(graph, "symbol") == ["d.xml:XmlElement:r:1", "pkg:p", "pkg:q", "web/a.css:CssSelector:body:1", "web/b.html:ElementId:x:1"]
    assert names(graph, "authored", "dst_key") == ["d.xml", "web/a.css"] and graph["has_file"].count() == 6
    assert graph.repeated_keys().count() == 0 and graph.loose_ends().count() == 0

    write(tree, {"web/a.css": "p {\n}", "d.xml": "<changed/>"})
    (tree / "web/b.html").unlink()
    changes = index.Inputs(diff=lines(spark, "M\tweb/a.css", "D\tweb/b.html"), commits=lines(spark, "COMMIT|h2|#|Ann|#|a@x|#|2024-01-03T00:00:00Z|#|m", "M\tweb/a.css"))
    graph = index.index(spark, str(tree), store, "tree", changes, least="Public")
    assert "web/a.css:CssSelector:p:1" in names(graph, "symbol") and "web/a.css:CssSelector:body:1" not in names(graph, "symbol")
    assert "d.xml:XmlElement:r:1" in names(graph, "symbol")  # not in the diff
    assert graph["symbol"].where("deleted").count() == 1 and names(graph, "commit", "hash") == ["h2"]

    assert index.purge(store, "tree", (".css",)) == 2
    assert index.purge(store, "tree") > 5
    assert store.load()["symbol"].count() == 0


def test_stream_of_symbols(spark, tmp_path):
    from test_store import files, symbols

    store = GraphStore(spark, str(tmp_path / "store"))
    store.commit(store.load().upsert_files(files(spark, ("f", None), ("g", None))).upsert_symbols(symbols(spark, ("f0", "f", "old", 0))))
    for i, rows in enumerate([[("f1", "f", "one", 0)], [("g1", "g", "one", 0), ("f2", "f", "two", 0)]]):
        symbols(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flush.open_stream(spark, str(tmp_path / "in"), 1)
    graph = flush.flush_symbols(stream, store, str(tmp_path / "work"))
    assert names(graph, "symbol") == ["f1", "f2", "g1"]  # what came in any batch stays, what no batch declares any more goes


def test_command_line(spark, tree, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli.main(["--supported-files"]) == 0 and "pubspec.yaml" in capsys.readouterr().out
    assert cli.main(["--input", str(tree), "--store", store, "--min-accessibility", "Public"]) == 0
    assert cli.key_of(str(tree)) == "tree"
    assert cli.main(["--input", str(tree), "--store", store, "--purge-data", "--yes"]) == 0
    for bad in (["--min-accessibility", "Public", "--purge-data", "--store", store], [], ["--store", store, "--debug", "--quiet"], ["--store", store, "--diff", "d", "--diff-base", "b"]):
        with pytest.raises(SystemExit):
            cli.checked(bad)


def test_git_feeds_full_and_incremental_runs(spark, tree, tmp_path):
    def run(*arguments):
        subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x", *arguments], cwd=tree, check=True, capture_output=True)

    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "first")
    run("tag", "v1")
    store = str(tmp_path / "store")
    assert cli.main(["--input", str(tree), "--store", store, "--min-accessibility", "Public", "--quiet"]) == 0
    graph = GraphStore(spark, store).load()
    row = graph["file"].where("key = 'web/a.css'").first()
    assert len(row.commits) == 1 and list(row.tags) == ["v1"] and names(graph, "author", "name") == ["Ann <a@x>"]

    write(tree, {"web/a.css": "p {\n}", "web/é.css": "i {\n}"})
    (tree / "web/b.html").unlink()
    run("add", "-A")
    run("commit", "-qm", "second | with bar")
    assert git.commit_count(str(tree), "v1") == 1 and git.commit_count(str(tree), "nothing") == 0
    assert cli.main(["--input", str(tree), "--store", store, "--min-accessibility", "Public", "--diff-base", "v1", "--batch-size", "3"]) == 0
    graph = GraphStore(spark, store).load()
    assert {"web/a.css:CssSelector:p:1", "web/é.css:CssSelector:i:1"} <= set(names(graph, "symbol")) and [r.message for r in graph["commit"].collect()] == ["second | with bar"]
    assert names(GraphStore(spark, store).load().put(file=graph["file"].where("deleted")), "file") == ["web/b.html"]
    assert git.file_log(spark, str(tree), "web/a.css").where("line <> ''").count() == 2
    assert git.commit_log(spark, str(tree), "nothing").count() == 0 and git.commit_range("a..b") == "a..b"
    with pytest.raises(RuntimeError):
        git.changed_files(spark, str(tree), "nothing")
    with pytest.raises(RuntimeError):
        git.repository_root(str(tmp_path))


def test_a_commit_that_fails_changes_nothing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    store.commit(store.load().upsert_project("a", "a"))
    with pytest.raises(Exception):
        store.commit(store.load().put(project=spark.range(1).selectExpr("raise_error('x') as key", "'x' as name")))
    assert names(store.load(), "project") == ["a"]
    store.commit(store.load().upsert_project("b", "b"))
    assert names(store.load(), "project") == ["a", "b"]


def test_rest_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "fernweave", tmp_path / "fernweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_selectors' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
