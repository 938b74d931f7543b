"""Corpus queries against their SQL, the pipeline against its parts, and that the library stands without them."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import decontaminate, near_duplicates, pii, quality, queries

SF = "/root/testdata/sf0.001"
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(map(tuple, want.fetchall()))


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_pipeline(spark):
    documents, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    docs, stages = documents, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    held = {}
    from lodestone.llm.common import written

    for name, stage in list(stages.items())[:-1]:
        docs = held[name] = written(stage(spark, docs, SF), "test")
        assert docs.columns == documents.columns
    texts = {name: {r.doc_id: r.text for r in df.collect()} for name, df in held.items()}
    good = {r["doc_id"] for r in quality.scores(documents, quality.train(documents, labels)).where("score >= 0.5").collect()}
    assert set(texts["quality"]) == good
    # One of each group of near copies is left, and nothing else is gone.
    sets = {i: set(near_duplicates.shingles(t, 5).tolist()) for i, t in texts["quality"].items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert set(texts["near_duplicates"]) == {i for i in sets if find(i) == i}
    automaton = decontaminate.Automaton([(r.item_id, decontaminate.words_of(r.text)) for r in bench.collect()])
    for i, t in texts["decontamination"].items():
        assert not automaton.hits(decontaminate.words_of(t))[1]
        if not automaton.hits(decontaminate.words_of(texts["near_duplicates"][i]))[1]:
            assert t == texts["near_duplicates"][i]
    for i, t in texts["pii"].items():
        assert not pii.base_spans(t) and (t == texts["decontamination"][i] or pii.tokens_of(texts["decontamination"][i]))
    assert all(r.n_chars == len(r.text) for r in held["pii"].collect())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(texts["pii"])


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, empty tables."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    odd = [(None, None, None, None, None), (None, "mail a@b.example.com now", None, None, None), (10**6, None, "en", None, None), (10**6, "", "en", "x", 0), (10**6 + 1, " \n ", None, "x", 3), *good[:2], *good[:2]]
    for name, rows in (("odd", good + odd), ("empty", [])):
        home = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(home / "documents.parquet"))
        for t, sub in (("labels", [(None, 1, 0), (good[0][0], None, None), (good[1][0], 1, 0), (good[2][0], 0, 1), (10**9, 1, 0)]), ("benchmark", [(None, None), (1, None), (2, "")])):
            spark.createDataFrame(sub if rows else [], spark.read.parquet(f"{SF}/{t}.parquet").schema).write.parquet(str(home / f"{t}.parquet"))
        packed = corpus_pipeline.run(spark, str(home)).collect()
        assert bool(packed) == bool(rows) and (not rows or {r.length for r in packed if r.doc_id == 10**6} <= {1})


def test_the_library_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the entry imports, and keeps the engine's queries."""
    subprocess.run(["cp", "-r", f"{HOME}/lodestone", f"{HOME}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lodestone/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'r1_find_rows' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""})
