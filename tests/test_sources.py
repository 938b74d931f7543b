"""Corpora, language files, flattening, streams, settings, the catalogue, and the command line."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

import fixture
from lodestone import cli
from lodestone.operators import catalog, corpus
from lodestone.operators.paging import UsageError, limit_of, offset_of
from lodestone.plans.scope import ScopeError, parse
from lodestone.report import Kind, Notice, Report, cell, name_list, page_notice, width
from lodestone.sources import languages, settings
from lodestone.sources.flatten import flatten, patch_mentions
from lodestone.sources.jsonl import import_export
from lodestone.streaming.ingest import stream_triples

FILES = {
    "Core/A.cs": 'class A\n{\n  string s = "Known.Key".Translate();\n  string t = key.Translate();\n  void Run() { }\n}\n',
    "mod/B.cs": "class B : A\n{\n  void Run() { }\n}\n",
    "mod/deep/A.cs": "class A { }\n",
    "loose.cs": "class Loose { }\n",
    ".git/Sneaky.cs": "class Sneaky { }\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("src")
    for name, body in FILES.items():
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_text(body)
    return corpus.read_files(spark, str(home)).cache()


def test_corpus(spark, files):
    assert {r.tree: r.files for r in corpus.trees(files).collect()} == {"Core": 1, "mod": 2, "": 1}
    found = corpus.search(files, r"void \w+")
    assert corpus.match_counts(found).first() == (2, 2) and [r.file for r in corpus.shown(found).collect()] == ["Core/A.cs", "mod/B.cs"]
    assert corpus.search(files, "CLASS", True, "**/A.cs").count() == 2 and corpus.search(files, "class", glob="A.cs").count() == 2
    windows = corpus.context(found.where("tree = 'Core'").select("tree", "file", "line").union(spark.createDataFrame([("Core", "Core/A.cs", 1), ("Core", "Core/A.cs", 3)], "tree string, file string, line int")), 0)
    assert sorted((r.line, r.window) for r in windows.collect()) == [(1, 1), (3, 2), (5, 3)]
    assert len({r.window for r in corpus.context(found, 2).where("tree = 'Core'").collect()}) == 1
    keyed = spark.createDataFrame([("Known.Key", "text", "runtime")], "key string, translated string, origin string")
    lines = corpus.search(files, "Translate")
    assert corpus.resolve_keys(lines, keyed).first() == ("Known.Key", 1, "text") and corpus.assembled(lines).first().n == 1
    assert corpus.resolve_file(files, "a").count() == 2 and corpus.resolve_file(files, "core/a").count() == 1
    assert [r.line for r in corpus.read_lines(files, "Core/A.cs", "2+2").collect()] == [2, 3]
    assert {(r.kind, r.name, r.base) for r in corpus.outlines(files).where("tree = 'mod'").collect()} == {("class", "B", "A"), ("method", "Run", None), ("class", "A", None)}
    assert corpus.member(files, "Run", "B").count() == 1 and corpus.in_source(files, "b").first().file == "mod/B.cs"


def test_language_files(spark, tmp_path):
    mod = tmp_path / "mod"
    for name, body in {"About/About.xml": "<m><packageId>My.Mod</packageId></m>", "Languages/German/Keyed/a.xml": "<L><Hi>Hallo\\nWelt</Hi><Later>TODO</Later></L>", "1.6/Languages/German/DefInjected/ThingDef/b.xml": "<L><Gun.label>Waffe</Gun.label></L>", "Languages/German/Keyed/bad.xml": "<L><Hi>"}.items():
        (mod / name).parent.mkdir(parents=True, exist_ok=True)
        (mod / name).write_text(body)
    assert languages.package_id(str(mod)) == "My.Mod" and languages.package_id(str(tmp_path / "none")) == "none"
    found = languages.harvest(spark, {"My.Mod": str(mod)}, "German", {"my.mod"})
    assert {(r.key, r.translated, r.placeholder, r.origin) for r in found["keyed"].collect()} == {("Hi", "Hallo\nWelt", False, "harvested"), ("Later", "TODO", True, "harvested")}
    assert [(r.def_type, r.def_name, r.path, r.translated) for r in found["translations"].collect()] == [("ThingDef", "Gun", "label", "Waffe")]
    assert {r.origin for r in languages.harvest(spark, {"My.Mod": str(mod)}, "German", set())["keyed"].collect()} == {"harvested_outside"}
    s = import_export(spark, fixture.write(tmp_path / "e.jsonl", fixture.records()), str(tmp_path / "s"), found)
    assert s.keyed.count() == 7


def test_flatten(spark):
    df = spark.createDataFrame([("a", (1, "x" * 500), [{"k": 1}, {"k": None}], None), ("b", None, [], 2.5)], "name string, s struct<i:int,t:string>, l array<map<string,int>>, d double")
    defs, values = flatten(df, "T", "name", {"s.i": "1"})
    got = {(r.path, r.is_default) for r in values.where(F.col("def_id") == defs.where("def_name = 'a'").first().id).collect()}
    assert got == {("s.i", 1), ("s.t", 2), ("l[0][0].key", 2), ("l[0][0].value", 2), ("l[1][0].key", 2)}
    assert {r.def_name: r.fields_truncated for r in defs.collect()} == {"a": 1, "b": 0}
    nodes = spark.createDataFrame([("N", 0), ("M", 0)], "name string, patch_ops int")
    patches = spark.createDataFrame([('<x>/D[@Name="N"]/a | /D[@Name = "N"]</x>',)], "xml string")
    assert {r.name: r.patch_ops for r in patch_mentions(patches, nodes).collect()} == {"N": 2, "M": 0}


def test_stream(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(f"e{i}", i, 7)], "name string, v int, shortHash int").write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("name string, v int, shortHash int").parquet(str(tmp_path / "in"))
    stream_triples(rows, "T", "name", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out/field_values")).collect()) == ["0", "1"]
    stream_triples(rows, "T", "name", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/defs")).count() == 2


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('home = "x"\n[groups]\ng = ["m"]\n')
    (tmp_path / "b.toml").write_text('snapshot = "s"\n[groups]\nh = ["n"]\n')
    got = settings.load_settings(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"), str(tmp_path / "none.toml"))
    assert (got.home, got.snapshot, got.groups) == ("x", "s", {"g": ["m"], "h": ["n"]})
    settings.write_mod_list(str(tmp_path / "one.rml"), settings.ModList("one", ["a.b", "c"], ["A", None]))
    (tmp_path / "bad.rml").write_text("<x>")
    good, bad = settings.mod_lists(str(tmp_path))
    assert good[0].ids == ["a.b", "c"] and bad == ["bad.rml"] and settings.lists_with(good, "A.") == {"one": ["a.b"]}


def test_scopes():
    mods = ["base.game", "base.extra", "my.mod", "her.mod2"]
    assert parse("core", mods).ids == {"base.game", "base.extra"} and parse(None, mods).ids is None
    assert parse("-core", mods).complement().ids == {"base.game", "base.extra"} and parse("core,-extra", mods).complement() is None
    assert parse("g,mod2", mods, {"G": ["mod"]}).ids == {"my.mod", "her.mod2"} and parse("my.mod,-mod", mods).ids == frozenset()
    with pytest.raises(ScopeError) as e:
        parse("core,nope,-nada", mods)
    assert e.value.unknown == ["nope", "nada"]


def test_paging():
    assert limit_of("all") is None and limit_of("0") is None and limit_of("99999") == 2000 and limit_of(None) == 25 and offset_of(None) == 0
    for bad in (lambda: limit_of("x"), lambda: limit_of("-2"), lambda: offset_of("-1")):
        with pytest.raises(UsageError):
            bad()


def test_catalogue(tmp_path):
    assert catalog.fingerprint(["a"]) != catalog.fingerprint(["a", ""]) and len(catalog.environment_fingerprint("1", "en", [("a", "1")])) == 16
    known = {"a": "pa", "b": "pb"}
    assert catalog.choose(known, name="B") == ("pb", "name") and catalog.choose(known, pinned="a")[1] == "pinned"
    assert catalog.choose(known, fingerprints={"b": "f"}, current="f") == ("pb", "mod list") and catalog.choose({"a": "pa"})[1] == "only one"
    for bad in ({"name": "c"}, {"path": "/nowhere", "name": "a"}, {}):
        with pytest.raises(catalog.CatalogError):
            catalog.choose(known, **bad)
    drift = catalog.environment_drift([("A", "1"), ("b", "1"), ("c", "1")], [("b", "2"), ("a", "1"), ("d", "1")])
    assert (drift.added, drift.removed, drift.reordered, drift.versions) == (["d"], ["c"], True, [("b", "1", "2")]) and not catalog.environment_drift([("A", "1")], [("a", "1")])
    (tmp_path / "m/Defs").mkdir(parents=True)
    (tmp_path / "m/Defs/x.xml").write_text("<x/>")
    one = catalog.content_scan({"m": str(tmp_path / "m"), "none": str(tmp_path / "q")})
    (tmp_path / "m/Defs/x.xml").write_text("<xx/>")
    assert list(one) == ["m"] and catalog.content_drift(one | {"gone": "1"}, catalog.content_scan({"m": str(tmp_path / "m")})) == (["m"], ["gone"])
    assert catalog.normal_version("1.6.4630 rev1") == "1.6"
    entries = [{"version": "1.4", "folder": "old"}, {"version": "1.5", "folder": "x"}, {"version": "1.5", "folder": "y", "if_active": "a"}, {"version": "1.5", "folder": "z", "if_not": "a"}]
    assert catalog.load_folders("m", "1.6", entries, {"A"}) == ["y", "x"]
    assert catalog.reconcile({"a": "1", "b": "1", "c": "1"}, {"a": "1", "b": "0", "d": "1"}) == {"a": "current", "b": "stale", "c": "never built", "d": "outside"}
    assert catalog.with_dependencies(["x"], {"x": ["y"], "y": ["z"]}) == ["z", "y", "x"]


def test_report():
    r = Report(promised=["rows"])
    assert json.loads(r.json()) == {"rows": [], "notes": []}
    assert page_notice(2, 5, "row").text == "5 rows, showing the first 2" and page_notice(1, 1, "row").text == "1 row" and name_list(["a", "b", "c", "d"]) == "a, b, c and 1 more"
    assert width("护a") == 3 and cell("x" * 100).endswith("…") and cell(None) == ""
    r.defer(Notice(Kind.STALENESS, "old"), {"m"})
    r.touched = {"other"}
    r.note(Kind.COUNT, "1")
    assert r.text() == "1\nold"


def test_command_line(spark, tmp_path):
    home = tmp_path / "home"
    import_export(spark, fixture.write(tmp_path / "e.jsonl", fixture.records()), str(home / "main"))
    conf = settings.Settings(home=str(home))

    def run(*argv):
        out = io.StringIO()
        return cli.main(list(argv), spark, conf, out), out.getvalue()

    code, text = run("where", "driveClass", "CompTilt", "--json")
    assert code == 0 and len(json.loads(text)["matches"]) == 2
    code, text = run("list", "RigDef", "-n", "2", "--mods", f"-{fixture.GUEST}")
    assert code == 0 and "showing the first 2" in text and "in the excluded mods: 5 entities" in text
    assert run("where", "nothing", "x")[0] == 1 and run("wher", "x")[0] == 2 and run("list", "--bogus")[0] == 2
    assert run("search", "QuietDish")[0] == 0 and run("get", "Lantern", "--type", "RigDef")[0] == 0 and run("snapshot", "list")[0] == 0
    for argv in (["fields", "RigDef"], ["values", "driveClass"], ["mods"], ["inherit", "Slit_Echelle", "--path-contains", "maker"], ["keyed", "DomeShut"], ["snapshot", "status"], ["snapshot", "truncated"]):
        assert run(*argv)[0] == 0, argv
    with pytest.raises(UsageError, match="positional|without"):
        cli.parse_args(cli.COMMANDS["where"], ["--path", "x"])
    assert os.linesep and "search <query>" in cli.help_text()
