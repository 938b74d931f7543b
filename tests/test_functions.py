"""Expressions against plain Python and against SQLite's full-text ranking."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import outline, paths, text
from lodestone.operators.search import bm25
from lodestone.sources.build import postings


def rows(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*[c(F.col("x")) for c in columns]).collect()]


def test_paths(spark):
    got = rows(spark, ["comps[0].props.energyMax", "tags[3]", "x.a[0][1]", "plain", "a[].b[12].c"], paths.leaf, paths.shape, paths.container_prefix, paths.index_prefixes)
    assert got == [
        ("energyMax", "comps[].props.energyMax", "comps[0].", ["comps[0]"]),
        ("tags", "tags[]", "", ["tags[3]"]),
        ("a", "x.a[][]", "", ["x.a[0]", "x.a[0][1]"]),
        ("plain", "plain", "", []),
        ("c", "a[].b[].c", "a[].b[12].", ["a[]", "a[].b[12]"]),
    ]
    assert rows(spark, ["shortHash", "a.index", "modContentPack.x", "Index", "indexes"], paths.is_noise) == [(True,), (True,), (True,), (False,), (False,)]


def test_folding_is_ascii_only(spark):
    assert rows(spark, ["ÄbC"], paths.afold) == [("Äbc",)] and paths.fold("ÄbC") == "Äbc"
    assert paths.like_escape("5%_\\") == "5\\%\\_\\\\"


def test_segments(spark):
    got = rows(spark, ["a.stat", "stats.a", "x.Stat[0].b", "astat"], lambda c: paths.whole_segments(c, ["stat"]), lambda c: paths.inner_segment(c, "stat"))
    assert got == [(True, False), (False, False), (True, True), (False, False)]
    assert paths.is_whole_segment("a.stats[2].value", "stats.value") and not paths.is_whole_segment("a.stats[2].value", "stats[1]")
    assert paths.class_like("Optics.Lamp") and not paths.class_like("lamp") and not paths.class_like("Lamp")


def test_text_parts(spark):
    got = [r[0] for r in rows(spark, ["TiltDrive", "XMLNode", "a_b-Cd.e", "Plain", "ÉtéChaud"], text.identifier_words)]
    assert got == ["TiltDrive Tilt Drive", "XMLNode XMLNode", "a_b-Cd.e Cd", "Plain Plain", "ÉtéChaud Été Chaud"]
    assert [r[0] for r in rows(spark, ["护盾腰带", "a护盾", ""], text.with_cjk_pairs)] == ["护盾腰带 护盾 盾腰 腰带", "a护盾 护盾", ""]
    assert rows(spark, ["Café-crème x1"], text.tokens) == [(["cafe", "creme", "x1"],)]
    assert text.phrases('void* "护盾腰" a.b -') == [(["void"], True), (["护盾"], False), (["盾腰"], False), (["a", "b"], True)]
    assert text.is_compound("QuietDish") and not text.is_compound("quietdish") and text.without_kind("class:X") == "X" and text.without_kind("a:b") == "a:b"
    assert text.effective_terms('a "*" b') == ["a", "b"]


@pytest.mark.parametrize(
    ("name", "query", "score"),
    [("CompTickRare", "CompTickRare", 100), ("CompTickRare", "comptick", 90), ("CompTickRare", "CompTikRare", 93), ("CompTickRare", "ctr", 85), ("big_red_dog", "red", 80), ("abc", "xyz", 0), ("CompTickRare", "icer", 0), ("thing_CompTick", "ngcom", 0)],
)
def test_fuzzy(spark, name, query, score):
    got = rows(spark, [name], lambda c: text.fuzzy_score(c, query))[0][0]
    assert got == score or score == 0 and got < 60


def test_bm25_is_sqlite_s(spark):
    import random

    random.seed(5)
    words = ["ant", "antler", "bee", "cat", "cattle", "dog", "élan", "x1"]
    docs = [(i, *(" ".join(random.choices(words, k=random.randint(0, 6))) for _ in range(3))) for i in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(key, translated, original, tokenize='unicode61')")
    db.executemany("insert into t(rowid, key, translated, original) values (?, ?, ?, ?)", docs)
    df = spark.createDataFrame(docs, "id long, key string, translated string, original string")
    index = postings(df, "id", (("key", False), ("translated", False), ("original", False)))
    for query, match in (("cat bee", '"cat"* "bee"*'), ("ant", '"ant"*'), ("dog.cat", '"dog cat"*'), ("elan x", '"elan"* "x"*')):
        want = dict(db.execute("select rowid, bm25(t, 10, 3, 3) from t where t match ?", (match,)).fetchall())
        got = {r.doc_id: r.score for r in bm25(index, query, (10.0, 3.0, 3.0)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


SOURCE = '''
using System;
namespace A.B
{
    /* class Hidden { } */
    public abstract class Pair<T> : Base<T>, IThing where T : class
    {
        private int count = 3;
        public string Name { get; set; }
        string text = "class { not }";
        public Pair(int a) : base(a) { if (a > 0) { Run(); } }
        public static T Make<T>(string s, char c = '{') => default;
        void Run()
        {
            // } stray
            foreach (var x in xs) { Do(x); }
        }
        enum Mode { One, Two }
        private class Inner : IInner { void Deep() { } }
    }
    struct Point { public int X; }
}
'''


def test_outline():
    found = [(d.kind, d.name, d.owner, d.base) for d in outline.outline(SOURCE)]
    assert found == [
        ("namespace", "A.B", None, None),
        ("class", "Pair", None, "Base<T>"),
        ("field", "count", "Pair", None),
        ("property", "Name", "Pair", None),
        ("field", "text", "Pair", None),
        ("constructor", "Pair", "Pair", None),
        ("method", "Make", "Pair", None),
        ("method", "Run", "Pair", None),
        ("enum", "Mode", "Pair", None),
        ("class", "Inner", "Pair", None),
        ("method", "Deep", "Pair.Inner", None),
        ("struct", "Point", None, None),
        ("field", "X", "Point", None),
    ]
    run = next(d for d in outline.outline(SOURCE) if d.name == "Run")
    assert (run.first, run.last) == (13, 17)
