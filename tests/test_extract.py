import pytest

from fernweave.operators import text_extract, tree_extract
from fernweave.operators.tree_extract import json_paths, parse_pubspec
from fernweave.sources import analyzer, files


def file(spark, content, name="dir/f", namespace="dir"):
    return spark.createDataFrame([(name, name, namespace, "lang", "tech", content)], "file_key string, relative_path string, namespace string, language string, technology string, content string")


def got(rows, *columns):
    return sorted(tuple(r) for r in rows.select(*columns).collect())


def test_css(spark):
    symbols, links = text_extract.css(file(spark, "@import 'x';\n\nbody {\n}"), "Public")
    assert got(symbols, "name", "kind", "class") == []  # an @import carries on to the next brace
    symbols, links = text_extract.css(file(spark, "body {\n color: red }\n\n.a { }\n"), "Public")
    assert got(symbols, "name", "start_line") == [("body", 1), ("color: red }\n\n.a", 1)]
    assert {r.rel_type for r in links.collect()} == {"CONTAINS"}
    symbols, _ = text_extract.css(file(spark, "@media x {\n .foo {a:b} }"), "Public")
    assert got(symbols, "name", "start_line", "key") == [(".foo", 1, "dir/f:CssSelector:.foo:1")]
    symbols, _ = text_extract.css(file(spark, "a{x:1}\nb{y:2}"), "Public", clean_selectors=True)
    assert got(symbols, "name") == [("a",), ("b",)]
    assert text_extract.css(file(spark, "a{}"))[0].count() == 0  # nothing without a minimum
    assert text_extract.css(file(spark, None), "Public")[0].count() == 0


def test_html(spark):
    symbols, links = text_extract.html(file(spark, "<p>\n<SCRIPT async src='a.js'></script>\n<div id=\"main\" data-id='x'>"), "Public")
    assert got(symbols, "name", "kind", "start_line") == [("a.js", "HtmlScriptReference", 2), ("main", "HtmlElementId", 3), ("x", "HtmlElementId", 3)]
    assert got(links, "rel_type", "from_key") == [("CONTAINS", "dir/f"), ("CONTAINS", "dir/f"), ("DEPENDS_ON", "dir/f")]


def test_razor(spark):
    symbols, links = text_extract.razor(file(spark, "@namespace My.App\n@using System\n@inject IFoo Foo\r\n@model Bar\n@inherits Base\n text @using no"), "Public")
    assert got(symbols, "name", "kind", "start_line", "namespace") == [
        ("Bar", "ModelDirective", 4, "My.App"), ("Base", "InheritsDirective", 5, "My.App"), ("IFoo Foo", "InjectDirective", 3, "My.App"), ("System", "UsingDirective", 2, "My.App"),
    ]
    assert links.count() == 4


@pytest.mark.parametrize("text, paths", [
    ('{"foo": {"bar": 1}, "baz": [1, 2]}', ["foo", "foo.bar", "baz"]), ('[{"foo": 1}, {"bar": 2}]', ["[0].foo", "[1].bar"]), ('{"a": 1, "a": 2}', ["a", "a"]),
    ("{bad", []), ('{"a": NaN}', []), ("﻿{\"a\": {}}", ["a"]), ("[" * 100000, []), ("3", []),
])
def test_json_paths(text, paths):
    assert [p for _, p in json_paths(text)] == paths


def test_json(spark):
    symbols, links = tree_extract.extract(file(spark, '{"foo": {"bar": 1}}'), "json", "Public")
    assert got(symbols, "name", "fqn", "key", "start_line") == [("bar", "foo.bar", "dir/f:JsonProperty:foo.bar", -1), ("foo", "foo", "dir/f:JsonProperty:foo", -1)]
    assert got(links, "from_key", "rel_type") == [("dir/f", "CONTAINS")] * 2
    assert tree_extract.extract(file(spark, '{"foo": 1}'), "json")[0].count() == 0


def test_xml(spark):
    symbols, links = tree_extract.extract(file(spark, '<?xml version="1.0"?>\n<root>\n  <child name="v" xmlns:q="u"/>\n</root>'), "xml")
    assert got(symbols, "kind", "name", "start_line", "fqn") == [("XmlAttribute", "name", 3, "child.name=v"), ("XmlElement", "child", 3, "child"), ("XmlElement", "root", 2, "root")]
    assert ("dir/f:XmlElement:child:3", "HAS_ATTRIBUTE") in got(links, "from_key", "rel_type")
    assert tree_extract.extract(file(spark, "<a><b></a>"), "xml")[0].count() == 0


def test_xaml(spark):
    text = """<Window x:Class="My.App.Main" xmlns="MS/winfx/2006/xaml/presentation" xmlns:x="MS/winfx/2006/xaml">
<Grid x:Name="panel"><Button Click="OnClick" Text="{Binding Path=Label}" Width="5"/></Grid></Window>""".replace("MS/", "http://schemas.microsoft.com/")
    symbols, links = tree_extract.extract(file(spark, text), "xaml")
    rows = {(r.kind, r.name): r for r in symbols.collect()}
    assert set(rows) == {("XamlElement", "Window"), ("XamlElement", "panel"), ("XamlElement", "Button"), ("XamlEventHandler", "OnClick"), ("XamlAttribute", "Text"), ("XamlAttribute", "Width")}
    assert rows["XamlElement", "panel"].key == "dir/f:Grid:panel:2" and rows["XamlElement", "panel"].namespace == "My.App"
    assert rows["XamlAttribute", "Text"].comments == "Label" and rows["XamlAttribute", "Width"].comments is None
    assert rows["XamlEventHandler", "OnClick"].accessibility == "Private"
    assert ("dir/f:Button:2", "dir/f:EventHandler:OnClick", "BINDS_TO") in got(links, "from_key", "to_key", "rel_type")
    assert ("XamlEventHandler",) not in got(tree_extract.extract(file(spark, text), "xaml", "Public")[0], "kind")


def test_csproj(spark):
    text = """<Project><PropertyGroup><TargetFramework>net9.0</TargetFramework><Empty> </Empty></PropertyGroup>
<ItemGroup><PackageReference Include="A" Version="1"/><PackageReference Include="B"><Version>2</Version></PackageReference><PackageReference Include="C"/>
<ProjectReference Include="../x.csproj"/></ItemGroup></Project>"""
    symbols, links = tree_extract.extract(file(spark, text), "csproj")
    assert got(symbols.where("kind = 'Dependency'"), "key", "fqn") == [("pkg:A", "A (1)"), ("pkg:B", "B (2)"), ("pkg:C", "C")]
    assert got(symbols.where("kind <> 'Dependency'"), "kind", "name", "language", "start_line") == [("ProjectProperty", "TargetFramework", "unknown", 1), ("ProjectReference", "../x.csproj", "unknown", 3)]
    assert got(links, "rel_type") == [("DEPENDS_ON",)] * 4 + [("HAS_PROPERTY",)]


def test_nuspec_urls(spark):
    packages = spark.createDataFrame([("Lib", "1.0"), ("Other", "2")], "name string, version string")
    spec = "<package xmlns='http://n'><metadata><projectUrl> https://p </projectUrl><repository url='https://r'/></metadata></package>"
    nuspecs = spark.createDataFrame([("lib", "1.0", spec), ("other", "3", spec)], "id string, version string, content string")
    assert got(tree_extract.nuspec_urls(packages, nuspecs), "dep_key", "url_key", "name") == [("pkg:Lib", "url:https://p", "https://p"), ("pkg:Lib", "url:https://r", "https://r")]


def test_package_json(spark):
    symbols, links = tree_extract.extract(file(spark, '{"devDependencies": {"d": "3"}, "dependencies": {"a": "1", "b": 5}}'), "npm")
    assert got(symbols, "ordinal", "key", "version") == [(0, "pkg:a", "1"), (1, "pkg:b", None), (2, "pkg:d", "3")]
    assert links.count() == 3
    for text in ("[]", "{bad", '{"dependencies": []}', None):
        assert tree_extract.extract(file(spark, text), "npm")[0].count() == 0


def test_npm_urls(spark):
    packages = spark.createDataFrame([("a", "web"), ("@s/b", ""), ("c", "")], "name string, package_dir string")
    metadata = spark.createDataFrame([
        ("web/node_modules/a/package.json", '{"homepage": "https://h", "repository": "github:u/a"}'), ("node_modules/.pnpm/@s+b@2/node_modules/@s/b/package.json", '{"repository": {"url": "git://g/b.git"}}'),
        ("node_modules/.pnpm/@s+b@3/node_modules/@s/b/package.json", '{"homepage": "late"}'),
    ], "path string, content string")
    assert got(tree_extract.npm_urls(packages, metadata), "dep_key", "name") == [("pkg:@s/b", "https://g/b"), ("pkg:a", "https://github.com/u/a"), ("pkg:a", "https://h")]


def test_pubspec(spark):
    found = parse_pubspec("name: app\r\nenvironment:\n  sdk: '>=3.0.0'\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0\n\nother:\n  x: 1\ndev_dependencies:\n  lints: any\n")
    assert found == {"name": "app", "sdk": ">=3.0.0", "dependencies": [("flutter", None), ("sdk", "flutter"), ("http", "^1.0")], "dev_dependencies": [("lints", "any")]}
    symbols, _ = tree_extract.extract(file(spark, "dependencies:\n  http: ^1.0\n"), "pubspec")
    assert got(symbols, "key", "version", "documentation") == [("pkg:http", "^1.0", "^1.0")]


def test_facts(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"projectName": "p", "projectRoot": "/r", "files": {"SRC\\\\a.ts": {"symbols": [{"fqn": "a::C", "kind": "TypeScriptClass", "name": "C", "class": "class", "accessibility": "Public", "startLine": 3, "endLine": 9, "comments": "x"},'
        '{"name": "p", "kind": "TypeScriptField", "class": "C", "fqn": "a::C.p", "accessibility": "Private", "startLine": 4, "endLine": 4}],'
        '"relationships": [{"fromSymbol": "C", "fromKind": "class", "fromLine": 3, "toSymbol": "D", "toKind": "class", "toFile": "src/d.ts", "relType": "DEPENDS_ON"}]}}}'
    )
    rows = analyzer.read_analysis(spark, str(tmp_path))
    matched = analyzer.match_files(file(spark, "", "src/a.ts"), rows)
    assert got(analyzer.fact_symbols(matched, "Public"), "key", "start_line", "end_line", "namespace") == [("src/a.ts:TypeScriptClass:C:3", 3, 3, "dir")]
    assert analyzer.fact_symbols(matched).count() == 2
    assert got(analyzer.fact_relationships(matched), "from_key", "to_key") == [("src/a.ts:class:C:3", "src/d.ts:class:D")]
    assert got(analyzer.fact_relationships(matched, cross_file=False), "to_key") == [("src/a.ts:class:D",)]


def test_usings(spark):
    rows = analyzer.using_lines(file(spark, "global using A.B;\nusing static C.D;\n  using (var x = y) {}\nusing E;\r\n"))
    assert got(rows, "name", "is_global") == [("A.B", True), ("C.D", False), ("E", False)]


def test_discovery(spark):
    paths = ["src/a.cs", "SRC/A.cs", "obj/x.cs", "web/node_modules/m/i.js", "readme.md", "p/package.json", "p/pubspec.yaml", "build.css"]
    disk = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    assert got(files.discover(disk), "relative_path") == [("SRC/A.cs",), ("build.css",), ("p/package.json",)]
    assert ("p/pubspec.yaml",) in got(files.discover(disk, pubspec=True), "relative_path")
    catalog = spark.createDataFrame([("obj/x.cs",)], "relative_path string")
    assert ("obj/x.cs",) in got(files.discover(disk, catalog), "relative_path")
    chosen = {r.relative_path: r.handler for r in files.dispatch(disk).collect()}
    assert chosen["p/package.json"] == "npm" and chosen["src/a.cs"] == "csharp" and chosen["readme.md"] is None and chosen["p/pubspec.yaml"] == "pubspec"


def test_nearest_root(spark):
    rows = spark.createDataFrame([("a/b/c.ts",), ("x.ts",), ("z/y.ts",)], "relative_path string")
    roots = spark.createDataFrame([("a",), ("a/b",), ("",)], "root string")
    assert got(files.nearest_root(rows, roots), "relative_path", "root") == [("a/b/c.ts", "a/b"), ("x.ts", ""), ("z/y.ts", "")]


def test_resolve_input(tmp_path):
    assert files.resolve_input(None, str(tmp_path)) == str(tmp_path)
    (tmp_path / "a.csproj").write_text("")
    assert files.resolve_input(None, str(tmp_path)).endswith("a.csproj")
    (tmp_path / "a.sln").write_text("")
    assert files.resolve_input(None, str(tmp_path)).endswith("a.sln")
    (tmp_path / "b.sln").write_text("")
    with pytest.raises(ValueError):
        files.resolve_input(None, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        files.resolve_input(str(tmp_path / "none"))
