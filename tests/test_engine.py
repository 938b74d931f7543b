"""The engine over the fixture, by way of a real import."""

import os

import pytest
from pyspark.sql import functions as F

import fixture
from lodestone.model import SnapshotError, open_snapshot
from lodestone.operators import graph, keyed, lookup, reverse, search, triage
from lodestone.plans.predicates import PathQuery, ValueMatch
from lodestone.plans.scope import Scope
from lodestone.sources.jsonl import import_export


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("snap")
    return import_export(spark, fixture.write(home / "export.jsonl.gz", fixture.records()), str(home / "snap"))


def names(df):
    return [r.def_name for r in df.collect()]


def test_import(s):
    assert s.defs.count() == 14
    sextant = lookup.named(s, "sextant_brass").first()
    assert s.facts.where(F.col("def_id") == sextant.id).count() == 10  # three are bookkeeping
    assert {(r.path, r.defs) for r in s.shared_values.collect()} == {(f[0], 10) for f in fixture.COMMON}
    assert s.keyed.count() == 5  # an empty key is dropped
    owners = {(r.def_name, r.path): r.def_id for r in s.translations.collect()}
    assert owners["Lantern", "note"] is None and owners["Lantern", "label"] == s.defs.where("def_name = 'Lantern' and def_type = 'RigDef'").first().id


@pytest.mark.parametrize(
    "lines",
    [
        fixture.records()[:-1],
        [*fixture.records()[:-1], {"kind": "end", "records": 3}],
        fixture.records(format_version=3),
        fixture.records(format_version=5),
        [fixture.DEFS[0], *fixture.records()],
        [],
    ],
)
def test_refused_imports_leave_nothing(spark, tmp_path, lines):
    with pytest.raises(SnapshotError):
        import_export(spark, fixture.write(tmp_path / "e.jsonl", lines), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") and not os.path.exists(tmp_path / "out.partial")


def test_unfinished_snapshots_are_refused(spark, tmp_path):
    with pytest.raises(SnapshotError):
        open_snapshot(spark, str(tmp_path))
    spark.createDataFrame([("schema_version", "0")], "key string, value string").write.parquet(str(tmp_path / "x/meta"))
    with pytest.raises(SnapshotError, match="version 0"):
        open_snapshot(spark, str(tmp_path / "x"))


def test_where(s):
    page, counts = reverse.find_by_field(s, PathQuery("driveClass"), "Optics.CompTilt")
    assert sorted(names(page.take())) == ["Probe_Loaned", "Sextant_Brass"] and counts.first() == (2, 2)
    assert reverse.path_shapes(s, PathQuery("unit"), "ArcMinute").total() == 2
    assert reverse.find_by_field(s, PathQuery("unit"))[1].first() == (4, 3)
    assert {r.value: r.matches for r in reverse.distinct_values(s, PathQuery("driveClass")).take().collect()} == {"Optics.CompTilt": 2, "Optics.SlideDrive": 1}
    _, types, n = reverse.value_coverage(s, PathQuery("driveClass"))
    assert {r.def_type: r.defs for r in types.take().collect()} == {"RigDef": 2, "KitDef": 1} and n.first().defs == 3
    assert reverse.generated_defs(s, PathQuery("fluid"))[0].first().def_name == "Plate_Cold"
    assert reverse.paths_with_value(s, "CompTilt", None, ValueMatch.IDENTIFIER)[1].first() == (1, 1)


def test_totals_do_not_move_with_limits(s):
    page = lookup.list_by_type(s, "RigDef")
    assert page.total() == 10 and page.take(3).count() == 3 and page.take(5, 8).count() == 2
    assert lookup.types(s).take().first() == ("RigDef", 10)
    assert names(lookup.by_names(s, ["QuietDish", "lantern", "QUIETDISH"]).take()) == ["QuietDish", "Lantern", "Lantern"]


def test_defaults_are_hidden_but_counted(s):
    slit = lookup.named(s, "Slit_Echelle").first()
    page, counts = lookup.fields(s, slit.id, ["slit"])
    assert [(r.path, r.is_default) for r in page.take().collect()] == [("slit.angle", 2), ("slit.width", 0)]
    assert counts.first() == (3, 6, 1)
    assert names(lookup.truncated(s).take()) == ["Slit_Echelle"]


def test_siblings_and_hidden_entries(s):
    sextant = lookup.named(s, "Sextant_Brass").first()
    shown = s.facts.where(F.col("def_id") == sextant.id).where("path = 'parts[0].tune.gain'")
    assert [r.leaf for r in reverse.authored_siblings(s, shown).take().collect()] == ["drift"]
    assert {r.prefix for r in reverse.hidden_indexes(s, sextant.id, shown).collect()} == {"gauges[0]", "gauges[1]"}


def test_search(s):
    stage, page, total = search.cascade(s, "QuietDish")
    assert (stage, total) == ("index", 3) and names(page)[0] == "QuietDish"
    assert names(search.cascade(s, "六分")[1]) == ["Sextant_Brass"]
    assert search.search_index(s, "无主").total() == 2  # a text without owner is found under every entity of its name
    assert search.cascade(s, "FoldedQuietDis")[0] == "index" and search.cascade(s, "Sextnt_Bras")[:1] == ("fuzzy",)
    assert search.search_index(s, '"*"') is None
    assert search.cascade(s, "class:QuietDish")[2] == 3
    found = search.matched_on(s, lookup.named(s, "QuietDish").select("id", "def_name", "label", "description"), "quiet").first()
    assert found.matched_on == "def_name+label"


def test_inheritance(s):
    assert graph.ancestors(s, "Slit_Echelle") == (["ThinGlass", "Glass"], "root")
    assert graph.ancestors(s, "Probe_Loaned") == (["GoneWithItsMod"], "broken")
    assert graph.ancestors(s, "RingEast")[1] == "cycle"
    assert {r.name_fold for r in graph.descendants(s, "RingEast").collect()} == {"ringeast", "ringwest"}
    below = s.defs.join(graph.kin(s, "Glass"), "id")
    # FrameTilted's type differs from its node's, but its name is unique; Lantern counts by its type only.
    assert sorted((r.def_type, r.def_name) for r in below.collect()) == [("FrameDef", "FrameTilted"), ("RigDef", "Lantern"), ("RigDef", "Slit_Echelle")]
    assert graph.witnesses(s, "Glass", "maker", "optics.slit").first() == (3, 2, 1, 1)
    assert graph.dominant_value(s, "Glass", "maker").first() == ("Optics.Lamp", 1, 2)
    assert [r["layer"] for r in graph.witness_table(s, "Slit_Echelle", "maker")] == ["ThinGlass", "Glass"]


def test_keyed(s):
    assert keyed.lookup(s, "domeshut")[0] == "key" and [r.key for r in keyed.prefix_siblings(s, "DomeShut").take().collect()] == ["DomeShutHint"]
    assert keyed.lookup(s, "no current")[1].total() == 1 and keyed.all_texts(s, True).total() == 1


def test_triage(s):
    where = lambda p, v=None, scope=None, exact=False: triage.where_triage(s, p, v, exact, scope).reason
    assert where(PathQuery("driveClass", exact=True)) == "exact path"
    assert where(PathQuery("fluid"), None, Scope(frozenset([fixture.GUEST]))) == "scope"
    assert where(PathQuery("slit")) == "deeper" and where(PathQuery("driveClas")) == "unknown field"
    assert where(PathQuery("maker"), "CompTilt") == "elsewhere" and where(PathQuery("maker"), "Optics.Sextnt") == "not in domain"
    assert where(PathQuery("driveClass"), "CompProperties_Tilt") == "identity"
    assert triage.list_triage(s, "RigDefs", None, None, None, 0).names == ("RigDef",)
    assert triage.list_triage(s, "RigDef", None, None, None, 50).reason == "past the end"
    assert {f.reason for f in triage.locate(s, "ThinGlass")} == {"node"} and "UI text" in {f.reason for f in triage.locate(s, "SkyTodo")}
    assert {f.reason for f in triage.advisories(s, PathQuery("unit"), "ArcMinute", False, None, 3)} == {"shapes", "truncated", "siblings", "same label"}


def test_ties_are_shown_together(spark, s):
    """value_elsewhere: 6, 4, and three shapes of 2 that tie at the border; two with a single entity are left out."""
    shapes = {"left": 6, "right": 4, "rows[0].top": 2, "mid": 2, "low": 2, "asked": 3, "odd": 1, "end": 1}
    rows = [(i, "TieDef", path, path.replace("[0]", "[]"), path.split(".")[-1], "0.5", "m") for path, n in shapes.items() for i in range(n)]
    facts = spark.createDataFrame(rows, "def_id long, def_type string, path string, shape string, leaf_fold string, value_fold string, source_mod string").withColumn("path_fold", F.col("path"))
    found = reverse.value_elsewhere(type("T", (), {"facts": facts})(), PathQuery("asked"), "0.5").collect()
    assert {r["shape"]: r.defs for r in found} == {"left": 6, "right": 4, "rows[].top": 2, "mid": 2, "low": 2} and found[0].others == 7


def test_empty_snapshot(spark, tmp_path):
    lines = [fixture.META, {"kind": "end", "records": 2}]
    empty = import_export(spark, fixture.write(tmp_path / "e.jsonl", lines), str(tmp_path / "out"))
    assert search.cascade(empty, "x")[2] == 0 and lookup.counts(empty).first() == (0, 0, 0, 0)
    assert reverse.find_by_field(empty, PathQuery("a"), "b")[1].first() == (0, 0) and graph.kin(empty, "x").count() == 0
