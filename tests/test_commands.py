"""Commands over a home with two snapshots, installed mods, a mod list, and sources."""

import io
import json
import os

import pytest

import fixture
from lodestone import cli
from lodestone.operators import catalog, corpus
from lodestone.sources import settings
from lodestone.sources.jsonl import import_export


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    files = {
        "mods/house/About/About.xml": f"<m><packageId>{fixture.HOUSE}</packageId></m>",
        "mods/house/Defs/a.xml": "<x/>",
        "mods/house/Source/Rig.cs": 'class RigDef\n{\n  // one\n  string s = "DomeShut".Translate();\n  string t = key.Translate();\n  // two\n}\n',
        "mods/house/Languages/ChineseSimplified/Keyed/k.xml": "<L><Extra>多</Extra></L>",
        "mods/loans/About/About.xml": f"<m><packageId>{fixture.GUEST}</packageId></m>",
        "mods/loans/Defs/b.xml": "<y/>",
        "mods/apart/Languages/ChineseSimplified/DefInjected/RigDef/d.xml": "<L><Lantern.label>灯</Lantern.label></L>",
    }
    for name, body in files.items():
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_text(body)
    (home / "sources").mkdir()
    settings.write_mod_list(str(home / "now.rml"), settings.ModList("now", [fixture.HOUSE, fixture.GUEST], ["House", "Loans"]))
    (home / "conf.toml").write_text('[groups]\nlent = ["guest.loans"]\nother = ["guest.loans"]\n')
    fixture.write(home / "export.jsonl", fixture.records())
    other = [fixture.META | {"mods": [fixture.META["mods"][0]]}, fixture.entity("RigDef", "OnlyElsewhere", "elsewhere", [("maker", "Optics.Elsewhere", 0)])]
    import_export(spark, fixture.write(home / "other.jsonl", [*other, {"kind": "end", "records": 3}]), str(home / "snapshots/other"))
    return home


@pytest.fixture(scope="module")
def run(spark, home):
    def main(*argv, **changed):
        conf = settings.load_settings(str(home / "conf.toml"))
        for key, value in ({"home": str(home / "snapshots"), "sources": str(home / "sources"), "mods": str(home / "mods"), "mod_list": str(home / "now.rml"), "version": "2.7.9"} | changed).items():
            setattr(conf, key, value)
        out = io.StringIO()
        code = cli.main([*argv, "--json"], spark, conf, out)
        return code, json.loads(out.getvalue()) if out.getvalue() else {}

    assert main("snapshot", "import", str(home / "export.jsonl"), str(home / "snapshots/main"))[0] == 0
    return main


def notes(answer, kind=None):
    return [n["text"] for n in answer[1]["notes"] if kind is None or n["kind"] == kind]


def test_import_harvests_and_measures(run, home):
    code, answer = run("snapshot", "import", str(home / "export.jsonl"), str(home / "snapshots/main"))
    assert code == 0 and any("1 text and 1 translation harvested from 3 mods" in n for n in notes((code, answer)))
    assert run("keyed", "Extra")[1]["keyed"][0]["origin"] == "harvested"
    assert any("aren't in the list" in n for n in notes(run("search", "lantern")))


def test_the_mod_list_chooses_the_snapshot(run, home):
    chosen = run("mods")
    assert any("mod list" in n for n in notes(chosen, "snapshot_choice")) and len(chosen[1]["mods"]) == 2
    assert run("mods", mod_list=None)[0] == 2  # two snapshots, and nothing to choose by
    assert run("snapshot", "use", "OTHER")[0] == 0 and 'snapshot = "OTHER"' in (home / "conf.toml").read_text()
    assert len(run("mods")[1]["mods"]) == 1 and run("snapshot", "use", "nothing")[0] == 2
    (home / "conf.toml").write_text('[groups]\nlent = ["guest.loans"]\nother = ["guest.loans"]\n')


def test_staleness(run, home):
    assert not notes(run("where", "maker", "Optics.Slit"), "staleness") and "nothing has changed" in notes(run("snapshot", "status"), "staleness")[0]
    file = home / "mods/loans/Defs/b.xml"
    before = file.stat()
    file.write_text("<yy/>")
    (home / "less.rml").write_text("<s><ids><li>guest.loans</li><li>new.mod</li></ids></s>")
    try:
        told = notes(run("where", "maker", "Optics.Slit", "--snapshot", "main", mod_list=str(home / "less.rml"), version="3.0"), "staleness")
    finally:
        file.write_text("<y/>")
        os.utime(file, ns=(before.st_atime_ns, before.st_mtime_ns))
    assert len(told) == 4 and "version 2.7" in told[0] and any("added" in t and "new.mod" in t for t in told) and any("removed" in t and "house.stock" in t for t in told)
    assert "guest.loans" in told[-1]  # a footnote: the result touches another mod


def test_scopes_are_told(run):
    answer = run("list", "RigDef", "--mods", "lent", "--class", "RigDef")
    assert any("the scope lent is guest.loans" in n for n in notes(answer, "filter")) and any("within --class RigDef --mods lent" in n for n in notes(answer))
    assert any("also a snapshot's name" in n for n in notes(run("list", "RigDef", "--snapshot", "main", "--mods", "other")))


def test_other_snapshots_are_probed(run):
    assert any("other snapshot" in n and "other" in n for n in notes(run("search", "OnlyElsewhere", "--snapshot", "main"), "next_step"))
    assert any("other snapshots have it: other" in n for n in notes(run("where", "maker", "Optics.Elsewhere", "--snapshot", "main"), "next_step"))


def test_advisories(run):
    told = notes(run("where", "unit", "ArcMinute", "--snapshot", "main"), "advisory")
    assert any("also have: span" in n for n in told) and any("share a label: lantern (2)" in n for n in told)
    assert any("search for it" in n for n in notes(run("where", "maker", "loaned", "--snapshot", "main"), "next_step"))
    assert any("class of entities" in n for n in notes(run("where", "plug", "Optics.TiltedFrame", "--snapshot", "main"), "next_step"))
    assert run("search", "**", "--snapshot", "main")[0] == 2


def test_sources(run, home):
    assert run("sources", "list")[1]["sources"] == [{"tree": "house.stock", "state": "never built"}]
    assert run("sources", "sync")[1]["sources"] == [{"tree": "house.stock", "state": "current"}] and run("sources", "sync")[0] == 1
    assert (home / "sources/house.stock/Rig.cs").is_file() and run("sources", "list")[1]["sources"][0]["state"] == "current"
    answer = run("code-search", "Translate", "--context", "1", "--texts", "--snapshot", "main")
    assert [(r["line"], r["hit"]) for r in answer[1]["lines"]] == [(3, False), (4, True), (5, True), (6, False)]
    assert answer[1]["texts"] == [{"key": "DomeShut", "n": 1, "translated": "圆顶已关"}] and any("1 line put the key together" in n for n in notes(answer))
    assert run("code-search", "class", "--source", "nowhere")[0] == 1
    assert any("HTML-escaped" in n for n in notes(run("code-search", "List&lt;int&gt;"))) and any("try List" in n for n in notes(run("code-search", "List<int>")))
    assert any("try *Rig*" in n for n in notes(run("code-search", "class", "--glob", "Rig")))
    assert any(n.startswith("at least") for n in notes(run("code-search", "class", "--max-files", "0"))) and corpus.pattern_hints("plain") == []
    (home / "sources/house.stock/RigDef.cs").write_text("class RigDef { }")
    assert any("declared in house.stock/RigDef.cs" in n for n in notes(run("get", "Lantern", "--type", "RigDef", "--snapshot", "main"), "advisory"))


def test_mod_lists_and_docs(run, home):
    assert [m["mod"] for m in run("modlist", "show", str(home / "now.rml"))[1]["mods"]] == [fixture.HOUSE, fixture.GUEST]
    saved = str(home / "saved.rml")
    assert run("modlist", "save", saved, "--snapshot", "main", "--needs", f"{fixture.GUEST}:a.frame")[0] == 0
    assert settings.read_mod_list(saved).ids == [fixture.HOUSE, "a.frame", fixture.GUEST]
    assert "## code-search" in cli.markdown() and run("docs")[1]["commands"][0]["command"] == "search <query>"


def test_get(run):
    answer = run("get", "Slit_Echelle", "--defaults", "--snapshot", "main")
    assert {f["path"]: f["default"] for f in answer[1]["fields"]} == {"alarm.cue": "no", "plug": "no", "slit.angle": "unknown", "slit.blades": "yes", "slit.width": "no", "maker": "no"}
    assert any("values are below it" in n for n in notes(run("get", "Lantern", "--type", "RigDef", "--path-contains", "slit", "--snapshot", "main"), "boundary"))


def test_parsed_lists_are_not_guessed(run, home):
    assert catalog.source_plan({}) == {} and catalog.source_manifest(str(home)) == {} and settings.installed(None) == {}
