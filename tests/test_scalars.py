import pytest
from pyspark.sql import functions as F

from fernweave.functions import accessibility as A
from fernweave.functions import scalars as S


def one(spark, column, **values):
    """The column's value on one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("namespace, tags", [
    ("Microsoft.DotNet.Cli", ["Microsoft", "DotNet", "Cli"]), ("MyApp.HTTPClient.Core", ["My_App", "HTTP_Client", "Core"]), ("MyApp.iOS.Views", ["My_App", "iOS", "Views"]),
    ("SomeApp.BDC", ["Some_App", "BDC"]), ("MyApp..Views", ["My_App", "Views"]), ("myapp.somefeature", ["myapp", "somefeature"]), ("ÄußereÜbung", ["Äußere_Übung"]), (None, []), ("  ", []),
])
def test_tags(spark, namespace, tags):
    assert one(spark, S.namespace_tags(F.col("n")), n=namespace) == tags


@pytest.mark.parametrize("path, namespace", [
    ("src/SolutionProcessor.cs", ""), ("source/Project/File.cs", "Project"), ("File.cs", ""), ("SRC/A/B.razor", "A"), ("srcs/A.cs", "srcs"), ("styles/main.css", "styles"), ("config.json", ""), ("src/x.css", "src"),
])
def test_namespace(spark, path, namespace):
    assert one(spark, S.infer_namespace(F.col("p")), p=path) == namespace


@pytest.mark.parametrize("url, plain", [
    ("github:ann/tool", "https://github.com/ann/tool"), ("GITHUB:ann/tool", "https://github.com/ann/tool"), ("git+ssh://git@github.com/ann/tool.git", "https://github.com/ann/tool"),
    ("ssh://git@dev.azure.com/o/p", "https://dev.azure.com/o/p"), ("git://github.com/ann/tool.GIT", "https://github.com/ann/tool"), ("git+https://tok:en@host/x.git", "https://host/x"),
    ("https://me@dev.azure.com/me/p", "https://dev.azure.com/me/p"), ("https://host/a@b", "https://host/a@b"), (None, None), ("", None),
])
def test_repository_url(spark, url, plain):
    assert one(spark, S.normalize_repository_url(F.col("u")), u=url) == plain


@pytest.mark.parametrize("value, path", [
    ("{Binding Phone, Mode=OneWay}", "Phone"), ("{Binding Path=Rows.Size}", "Rows.Size"), ("{Binding}", None), ("plain", None), ("{StaticResource X}", None),
])
def test_binding(spark, value, path):
    from fernweave.operators.tree_extract import binding

    assert one(spark, S.binding_path(F.col("v")), v=value) == path == binding(value)


@pytest.mark.parametrize("text, line", [("", 1), ("hello\n", 2), ("line1\nline2\n", 3)])
def test_line(spark, text, line):
    assert one(spark, S.line_of(F.col("t")), t=text) == line


def test_small_ones(spark):
    assert one(spark, S.content_hash(F.col("t")), t="hello").startswith("2cf24dba5fb0a30e26e83b2ac5b9e29e")
    assert one(spark, S.relative_path("/repo", F.col("p")), p="/repo/lib/a/b.ts") == "lib/a/b.ts"
    assert one(spark, S.relative_path("/repo/", F.col("p")), p="/other/b.ts") == "/other/b.ts"
    assert one(spark, S.target_framework(F.col("p")), p="Serilog(net9.0)") == "net9.0"
    assert one(spark, S.target_framework(F.col("p")), p="SimpleProject") is None
    assert one(spark, S.base_project(F.col("p")), p="Serilog(netstandard2.0)") == "Serilog"
    assert one(spark, S.truncate(F.col("p"), 3), p="abcd") == "abc"
    assert one(spark, S.truncate(F.col("p"), 3), p=None) is None
    assert one(spark, S.text_key(F.col("f"), "K", F.col("n"), F.lit(7)), f="f", n="n") == "f:K:n:7"
    assert one(spark, S.text_key(F.col("f"), "K", F.col("n")), f="f", n="n") == "f:K:n"
    assert one(spark, S.assembly_name(F.col("a")), a="Lib.Core, Version=1") == "Lib.Core"
    assert one(spark, S.repo_key(F.col("a")), a="/x/My.App.SLN") == "my.app"
    assert one(spark, S.stable_symbol_key(F.lit(None).cast("string"), F.col("a")), a="X") == ":X"
    assert one(spark, S.tags_of_refs(F.col("r")), r="HEAD -> main, tag: v1.0 , tag:x") == ["v1.0", "x"]
    assert one(spark, S.dart_accessibility(F.col("n"), F.lit(False)), n="_hidden") == "Private"
    assert one(spark, S.member_fqn(F.col("f"), F.col("c"), F.col("n")), f="a.ts", c="C", n="m") == "a.ts::C.m"


@pytest.mark.parametrize("origin, spec, path", [("src/a/b.ts", "./c", "src/a/c.ts"), ("src/a/b.ts", "../d.js", "src/d.js"), ("b.ts", "./x/y", "x/y.ts")])
def test_relative_import(spark, origin, spec, path):
    assert one(spark, S.relative_import(F.col("o"), F.col("s")), o=origin, s=spec) == path


def test_accessibility(spark):
    assert [A.text_symbols_visible(x) for x in ("Private", "Internal", "Public", "NotApplicable")] == [True, True, True, False]
    assert A.manifest_visible("NotApplicable") and A.manifest_visible("Public") and not A.manifest_visible("Public", "Private")
    for declared, least, seen in [("Public", "Public", True), ("Private", "Public", False), ("Internal", "Public", False), ("Private", "Private", True)]:
        assert one(spark, A.member_visible(F.col("d"), F.lit(False), least), d=declared) is seen
    assert one(spark, A.member_visible(F.col("d"), F.lit(True), "Public"), d="Private")
    assert one(spark, A.type_visible(F.col("d"), "Public"), d="NotApplicable")
    assert one(spark, A.fact_visible(F.col("d"), "Public"), d="odd")
    assert not one(spark, A.fact_visible(F.col("d"), "Public"), d="Protected")
