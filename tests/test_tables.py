"""The test tables as a snapshot: views that read what a query needs, the same rows on odd tables, and bounded shuffles."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, TABLES, cells

from lodestone.operators import reverse
from lodestone.plans import queries
from lodestone.plans.predicates import PathQuery
from lodestone.sources import build
from lodestone.sources.tables import TableSnapshot, snapshot_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_is_imported(spark):
    """Before, the first query of a session wrote all tables."""
    home = spark.conf.get("spark.checkpoint.dir")
    have = set(os.listdir(home)) if os.path.isdir(home) else set()
    s = TableSnapshot(spark, SF)
    reverse.find_by_field(s, PathQuery("tax"), "0.0")[1].collect()
    s.translations.count()
    assert (set(os.listdir(home)) if os.path.isdir(home) else set()) == have


def test_sources_and_numbers_that_no_field_needs(spark):
    s = TableSnapshot(spark, SF)
    shapes = plan(reverse.path_shapes(s, PathQuery("value")).rows)
    assert "l_orderkey" not in shapes and "o_orderkey" not in shapes and "c_custkey" not in shapes and "event_id" in shapes
    counts = plan(reverse.find_by_field(s, PathQuery("tax"), "0.0")[1])
    assert "row_number" not in counts
    assert "row_number" in plan(s.facts)


@pytest.mark.parametrize("name", ["s4_facts", "r1_find_rows", "a1_shared_values", "l9_counts"])
def test_odd_tables(spark, tmp_path, name):
    """Lines without an order, rows that occur twice, null keys and values."""
    con = duckdb.connect()
    for t in TABLES:
        shutil.copyfile(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    odd = {
        "orders": f"select * from '{SF}/orders.parquet' where o_orderkey % 5 <> 1 union all (select * from '{SF}/orders.parquet' where o_orderkey % 5 = 2 limit 20) union all (select * replace (null as o_orderkey) from '{SF}/orders.parquet' limit 3)",
        "lineitem": f"select * replace (case when l_partkey % 7 = 0 then null else l_discount end as l_discount) from '{SF}/lineitem.parquet' union all (select * replace (null as l_orderkey) from '{SF}/lineitem.parquet' limit 3)",
        "customer": f"select * from '{SF}/customer.parquet' union all (select * replace (null as c_acctbal) from '{SF}/customer.parquet' limit 5)",
    }
    for t, sql in odd.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    order = sorted(columns)
    assert cells([[r[c] for c in order] for r in df.collect()]) == cells([[r[columns.index(c)] for c in order] for r in want.fetchall()])


def test_shared_values_shuffle_few_rows(spark):
    """Before, every different (type, path, value, entity) was shuffled."""
    rows = spark.range(40_000).select(F.col("id").alias("def_id"), F.lit("t").alias("def_type"), F.explode(F.array(*[F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in (("a", F.lit("x")), ("b", F.col("id").cast("string")), ("c", F.when(F.col("id") % 5 < 3, F.lit(None)).otherwise("y")))])).alias("c"))
    facts = rows.select("def_id", "def_type", "c.*", F.lit(0).alias("is_default"))
    defs = spark.range(40_000).select("id", F.lit("t").alias("def_type"))
    out = build.shared_values(facts, defs)
    assert {tuple(r) for r in out.collect()} == {("t", "a", "x", 40_000), ("t", "c", None, 24_000)}
    # A semi join with the few full buckets stands below the shuffle by value and entity.
    text = plan(out)
    assert "LeftSemi" in text and "bucket" in text


def test_one_snapshot_for_a_session(spark):
    assert snapshot_of(spark, SF) is snapshot_of(spark, SF)


def test_siblings_read_the_shown_types_only(spark):
    """Before, every set field of a list entry was multiplied by its prefixes and shuffled, whatever its type."""
    s = TableSnapshot(spark, SF)
    beside = reverse.authored_siblings(s, reverse.matching(s, PathQuery("stat"), "Price", exact=True)).rows
    text = plan(beside)
    assert "p_partkey" in text and "l_orderkey" not in text and "o_orderkey" not in text
    assert {r.leaf for r in beside.collect()} == {"value"}
    assert reverse.authored_siblings(s, reverse.matching(s, PathQuery("stat"), "no such value", exact=True)).rows.count() == 0


def test_value_elsewhere_reads_the_own_types_once(spark):
    """Before, lines stood several times in the plan."""
    s = TableSnapshot(spark, SF)
    found = reverse.value_elsewhere(s, PathQuery("quantity"), "5")
    text = plan(found)
    assert text.count("Relation [l_orderkey") == 1 and "p_partkey" not in text and "event_id" not in text
    assert found.count()
    assert reverse.value_elsewhere(s, PathQuery("quantity"), "no such value").count() == 0
