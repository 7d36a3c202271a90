import pytest
from pyspark.sql import functions as F

from fernweave import schemas
from fernweave.operators.store import Graph, GraphStore, last_wins, merge, resolve_edges, row_chunks, unresolved_edges


def symbols(spark, *rows):
    """(key, file, name, ordinal[, namespace]) as symbol rows."""
    full = [(k, n, "K", "c", k, "Public", f, f, 1, 1, "d" * 9000, None, (rest or [None])[0], None, "l", "t", o) for k, f, n, o, *rest in rows]
    return spark.createDataFrame(full, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schemas.SYMBOL) + ", ordinal int")


def files(spark, *rows, authors=()):
    """(key, repo) as file rows."""
    full = [(k, k, k, "hash", None, None, [(a, None, None, 1) for a in authors], [], [], repo, "", "l", "t", i) for i, (k, repo) in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schemas.FILE) + ", ordinal int")


def rels(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RELATIONSHIP)


def commits(spark, *rows):
    """(hash, author, {path: deleted}, ord)."""
    return spark.createDataFrame([(h, a, f"{a}@x", None, "m", list(fs.items()), o) for h, a, fs, o in rows], ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schemas.COMMIT) + ", ord int")


def keys(rows, *columns):
    return sorted(tuple(r) if len(columns) > 1 else r[0] for r in rows.select(*columns).collect())


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    g = Graph(spark).upsert_project("r1", "r1").upsert_project("r2", "r2")
    g = g.upsert_files(files(spark, ("a.cs", "r1"), ("b.css", "r2"), ("c.cs", None), authors=["Ann <a>"]))
    g = g.upsert_symbols(symbols(spark, ("s1", "a.cs", "one", 0, "My.AppX"), ("s2", "a.cs", "two", 1), ("s3", "b.css", "three", 0), ("s4", "c.cs", "four", 0)))
    g = g.link_symbols(rels(spark, ("s1", "s2", "CONTAINS"), ("s1", "s3", "INVOKES"), ("a.cs", "s1", "CONTAINS"), ("s1", "s2", "CONTAINS")))
    dep = "key string, name string, version string"
    g = g.upsert_dependencies(spark.createDataFrame([("d1", "d1", "1"), ("d2", "d2", "1")], dep), "r1").upsert_dependencies(spark.createDataFrame([("d2", "d2", "2")], dep), "r2")
    g = g.upsert_commits(commits(spark, ("h1", "Ann", {"a.cs": False}, 0)), "r1").upsert_commits(commits(spark, ("h2", "Bob", {"b.css": False}, 0), ("h3", "Ann", {"b.css": True}, 1)), "r2")
    g = g.upsert_commits(commits(spark, ("h4", "Cy", {"z": True}, 0)), None)
    return GraphStore(spark, str(tmp_path_factory.mktemp("graph") / "g")).commit(g)


def sound(g):
    assert g.repeated_keys().count() == 0 and g.loose_ends().count() == 0


def test_build(graph):
    sound(graph)
    assert keys(graph["link"], "src_key", "dst_key", "rel_type") == [("s1", "s2", "CONTAINS"), ("s1", "s3", "INVOKES")]
    assert keys(graph["has_file"], "src_key", "dst_key") == [("r1", "a.cs"), ("r2", "b.css")]
    assert keys(graph["has_tag"], "src_key", "dst_key") == [("s1", "App_X"), ("s1", "My")]
    assert keys(graph["author"], "name") == ["Ann", "Ann <a>", "Bob", "Cy"]
    assert keys(graph["depends_on"], "src_key", "dst_key") == [("r1", "d1"), ("r1", "d2"), ("r2", "d2")]
    assert graph["symbol"].where("length(documentation) <> 8000").count() == 0
    assert graph["file"].where("key = 'b.css'").first().deleted is False  # the newest commit counts
    assert graph["file"].where("key = 'z'").first().deleted is True


def test_upsert_is_idempotent(spark, graph):
    again = graph.upsert_files(files(spark, ("a.cs", "r1"), authors=["Ann <a>"])).upsert_symbols(symbols(spark, ("s1", "a.cs", "one", 0, "My.AppX")))
    for name in ("symbol", "declares", "has_file", "authored", "tag", "has_tag"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, graph[name].collect())), name


def test_last_row_wins_and_every_declarer_stays(spark, graph):
    g = graph.upsert_symbols(symbols(spark, ("n", "a.cs", "old", 0), ("n", "a.cs", "mid", 1), ("n", "b.css", "new", 0)))
    assert g["symbol"].where("key = 'n'").first().name == "new"
    assert keys(g["declares"].where("dst_key = 'n'"), "src_key") == ["a.cs", "b.css"]


def test_merge_keeps_other_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, n int, t string")
    new = spark.createDataFrame([("b", None), ("c", 5)], "key string, n int")
    assert sorted(map(tuple, merge(old, new, "key").collect())) == [("a", 1, "x"), ("b", None, "y"), ("c", 5, None)]
    assert sorted(map(tuple, merge(old, new, "key", keep=("n",)).collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 5, None)]


def test_last_wins_ties(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 0, "z")], "key string, o int, v string")
    assert last_wins(rows, "key", "o").collect()[0].v == "b"


def test_edges(spark):
    s = spark.createDataFrame([("a",), ("b",)], "key string")
    r = rels(spark, ("a", "b", "X"), ("a", "b", "X"), ("a", "f", "X"), (None, "b", "X"))
    assert keys(resolve_edges(r, s), "src_key", "dst_key") == [("a", "b")]
    assert unresolved_edges(r, s).count() == 2


def test_sweep(spark, graph):
    shared = graph.upsert_symbols(symbols(spark, ("s2", "b.css", "two", 5)))
    flushed = spark.createDataFrame([("a.cs",)], "file_key string")
    keep = spark.createDataFrame([("s1",)], "key string")
    g = shared.sweep(flushed, keep)
    assert keys(g["symbol"], "key") == ["s1", "s3", "s4"] and keys(g["link"], "dst_key") == ["s3"]
    sound(g)
    safe = shared.sweep(flushed, keep, safe=True)
    assert keys(safe["symbol"], "key") == ["s1", "s2", "s3", "s4"] and keys(safe["declares"].where("dst_key = 's2'"), "src_key") == ["b.css"]


def test_soft_delete(spark, graph):
    paths = spark.createDataFrame([("a.cs",), ("none",)], "path string")
    g = graph.soft_delete(paths, at=F.expr("timestamp'2024-01-01'"))
    assert keys(g["symbol"].where("deleted"), "key") == ["s1", "s2"] and "a.cs" in keys(g["file"].where("deleted"), "key")
    back = g.upsert_files(files(spark, ("a.cs", "r1"))).upsert_symbols(symbols(spark, ("s1", "a.cs", "one", 0)))
    assert not back["file"].where("key = 'a.cs'").first().deleted and back["symbol"].where("key = 's1'").first().deleted
    assert not g.upsert_symbols(symbols(spark, ("s1", "a.cs", "one", 0)), revive=True)["symbol"].where("key = 's1'").first().deleted


def purged(result):
    return {r.label: r.purged for r in result[1].collect()}


def test_purge_one_project(graph):
    g, counts = graph.purge("r1")
    # s4 and c.cs belong to no project, h4 to none; d2 is used by r2; Ann also committed to r2
    assert {r.label: r.purged for r in counts.collect()} == {"symbol": 3, "file": 3, "dependency": 1, "commit": 2, "author": 2, "project": 1}
    assert keys(g["symbol"], "key") == ["s3"] and keys(g["dependency"], "key") == ["d2"] and keys(g["author"], "name") == ["Ann", "Bob"]
    sound(g)
    assert sum(purged(g.purge("r1")).values()) == 0


def test_purge_everything_and_by_extension(graph):
    g, _ = graph.purge()
    assert all(g[name].count() == 0 for name in ("symbol", "file", "dependency", "commit", "author", "project", "declares", "link"))
    assert g["tag"].count() == 2  # tags and URLs are never purged
    assert purged(graph.purge(None, [".css"])) == {"symbol": 1, "file": 1}
    assert "dependency" not in purged(graph.purge("r1", dependencies=False))


def test_purge_spares_authors_of_others_if_asked(graph):
    g, _ = graph.purge("r1", scoped_authors=True)
    assert "Ann <a>" in keys(g["author"], "name")


def test_purge_passes_over_the_edges_once(spark, sf_dir, monkeypatch):
    from fernweave.operators import store
    from fernweave.plans.graph_queries import purge_plan

    plans, write = [], store.stored
    monkeypatch.setattr(store, "stored", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows))
    purge_plan(spark, sf_dir)
    reads = lambda plan, column: sum("Relation [" in line and column in line for line in plan.splitlines())
    symbols = next(p for p in plans if reads(p, "l_partkey"))
    assert reads(symbols, "l_partkey") == 1 and "FullOuter" not in symbols and sum(reads(p, "l_partkey") for p in plans) == 1
    commits = next(p for p in plans if reads(p, "o_orderkey") and p is not symbols)
    assert reads(commits, "o_orderkey") == 2  # as nodes and as edges


def test_purge_with_edges_at_commits_that_are_no_nodes(spark, graph):
    loose = graph.put(
        part_of_project=graph["part_of_project"].union(spark.createDataFrame([("gone", "r1"), (None, "r1"), ("h2", None)], "src_key string, dst_key string")),
        committed=graph["committed"].union(spark.createDataFrame([("Cy", "gone"), ("Bob", None)], "src_key string, dst_key string")),
    )
    g, counts = loose.purge("r1")
    assert {r.label: r.purged for r in counts.collect()} == {"symbol": 3, "file": 3, "dependency": 1, "commit": 2, "author": 2, "project": 1}
    assert keys(g["author"], "name") == ["Ann", "Bob"] and keys(g["commit"], "hash") == ["h2", "h3"]


def test_first_rows_of_a_table_are_joined_with_nothing(spark):
    rows = spark.createDataFrame([("a", "x", None), (None, "y", True)], "key string, path string, deleted boolean")
    first = Graph(spark).merged("file", rows)
    assert "Join" not in first._jdf.queryExecution().optimizedPlan().toString()
    want = merge(Graph(spark)["file"], rows, "key")
    assert first.dtypes == want.dtypes and sorted(map(repr, first.collect())) == sorted(map(repr, want.collect()))
    again = Graph(spark).put(file=first).merged("file", spark.createDataFrame([("a", "z")], "key string, path string"))
    assert sorted(map(str, (r.path for r in again.collect()))) == ["y", "z"]


def test_no_project_key(spark):
    g = Graph(spark).upsert_project(None, None).upsert_files(files(spark, ("a", "r1")))
    assert g["project"].count() == 0 and g["has_file"].count() == 0 and g["file"].count() == 1


def test_urls(spark, graph):
    g = graph.upsert_urls(spark.createDataFrame([("d1", "url:u", "u"), ("pkg:none", "url:v", "v")], schemas.URL))
    assert keys(g["url"], "key") == ["url:u", "url:v"] and keys(g["has_url"], "src_key") == ["d1"]


def test_chunks(spark):
    assert sorted(r["count"] for r in row_chunks(spark.range(251), "id").groupBy("chunk").count().collect()) == [1, 250]


def test_store_commits_and_reloads(spark, graph, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.load()["symbol"].count() == 0
    store.commit(graph)
    for _ in range(2):
        store.commit(store.load().upsert_symbols(symbols(spark, ("s9", "a.cs", "nine", 0))))
    assert keys(store.load()["symbol"], "key") == ["s1", "s2", "s3", "s4", "s9"]
    kept = sorted(p for p in (tmp_path / "g").iterdir() if p.name.startswith("g-"))
    assert [len([x for x in p.iterdir() if x.is_dir()]) for p in kept] == [18, 4, 4]  # the last two hold only what they touched
