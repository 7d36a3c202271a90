from datetime import datetime

from fernweave.sources import history


def lines(spark, *text, log="l"):
    return spark.createDataFrame([(log, i, t) for i, t in enumerate(text)], "log string, ord int, line string")


HEAD = "COMMIT|{}|#|Ann|#|a@x|#|{}|#|{}"


def test_commits(spark):
    found = history.commits(lines(spark, HEAD.format("h1", "2024-01-02T00:00:00+02:00", "one|#|more"), "M\ta.cs", "D\tb.cs", "", HEAD.format("h2", "2024-01-01T00:00:00Z", "two"), "R100\told.cs\tnew.cs")).orderBy("ord").collect()
    assert [(r.hash, r.author_email, r.message, [(f.path, f.is_deleted) for f in r.changed_files]) for r in found] == [
        ("h1", "a@x", "one|#|more", [("a.cs", False), ("b.cs", True)]), ("h2", "a@x", "two", [("old.cs", False)]),
    ]
    assert found[0].date == datetime(2024, 1, 1, 22)


def test_commits_without_files_or_headers(spark):
    found = history.commits(lines(spark, HEAD.format("h1", "2024-01-01T00:00:00Z", "one"))).collect()
    assert [(r.hash, list(r.changed_files)) for r in found] == [("h1", [])]
    assert history.commits(lines(spark, "COMMIT|bad", "M\tx")).count() == 0
    assert history.commits(lines(spark, " ", "")).count() == 0


def test_malformed_header_repeats_the_commit(spark):
    found = history.commits(lines(spark, HEAD.format("h1", "2024-01-01T00:00:00Z", "one"), "M\ta", "COMMIT|bad", "M\tb")).orderBy("ord").collect()
    assert [(r.hash, [f.path for f in r.changed_files]) for r in found] == [("h1", ["a"]), ("h1", ["b"])]


def test_bulk_history(spark):
    rows = history.bulk_history(
        lines(spark, "COMMIT|Ann <a>|2024-01-02T00:00:00Z|h2|HEAD -> main, tag: v2", "", "src/A.cs", "b.txt", "COMMIT|Bob <b>|2024-01-01T00:00:00Z|h1|", "SRC/a.cs", "COMMIT|short", "src/a.cs"), (".cs",)
    )
    meta = {r.path_ci: r for r in history.file_metadata(rows).collect()}
    assert set(meta) == {"src/a.cs"}
    r = meta["src/a.cs"]
    assert (r.created, r.last_modified) == (datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert [(a.name, a.commit_count) for a in r.authors] == [("Ann <a>", 1), ("Bob <b>", 2)]
    assert list(r.commits) == ["h2", "h1", "h1"] and list(r.tags) == ["v2"]


def test_single_file_log(spark):
    rows = history.single_file_history(lines(spark, "Ann <a>|2024-02-01T00:00:00Z|h1|tag: v1.0, tag: V1.0", "bad", "Bob <b>|never|h2", "Bob <b>|2024-01-01T00:00:00Z"))
    r = history.file_metadata(rows).first()
    assert [a.name for a in r.authors] == ["Ann <a>", "Bob <b>"] and list(r.commits) == ["h1", ""] and list(r.tags) == ["v1.0"]


def test_file_without_history(spark):
    files = spark.createDataFrame([("x.cs",)], "relative_path string")
    meta = history.file_metadata(history.bulk_history(lines(spark, "COMMIT|Ann|2024-01-02T00:00:00Z|h|", "y.cs")))
    r = history.with_history(files, meta).first()
    assert r.created is None and list(r.authors) == list(r.commits) == list(r.tags) == []


def test_diff_and_pages(spark, tmp_path):
    found = history.diff(lines(spark, "M\ta", "D\tb", "R90\told\tnew", "junk")).collect()
    assert [(r.path, r.is_deleted) for r in found] == [("a", False), ("b", True), ("old", False)]
    assert [r.ord for r in history.page(lines(spark, *"abcde"), 2, 2).collect()] == [2, 3]
    (tmp_path / "log").write_text("one\r\ntwo\n\nfour")
    assert [r.line for r in history.read_log(spark, str(tmp_path / "log")).orderBy("ord").collect()] == ["one", "two", "", "four"]
