"""Hot groups of near copies: bands that share their greatest component meet once, and no pair is lost."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from lodestone.llm import near_duplicates as nd
from lodestone.llm import rows


def pairs_of(rows):
    by_band = {}
    for r in rows:
        by_band.setdefault(r.band, {})[r.node] = r.root
    return {(a, b) for held in by_band.values() for a, b in combinations(sorted(held), 2) if held[a] != held[b]}


def test_meetings_keep_every_pair_and_repeat_no_class(spark):
    """Before, a class travelled once for each of its bands."""
    rng = random.Random(5)
    still = [(node, 9, band, band, 0 if node < 60 else node, 0) for band in range(20) for node in range(70) if rng.random() < 0.9]
    still += [(node, 9, band, 3, node, 100) for band in (40, 41) for node in (100, 101 + band)]  # one band each: apart they make fewer comparisons or as many
    still = spark.createDataFrame(still, "node long, n long, band long, place int, root long, top long")
    split = still.groupBy("band", "top").agg(F.count("*").alias("members"))
    out = nd.meetings(still.join(split, ["band", "top"]), split, 10_000).collect()
    assert pairs_of(out) >= pairs_of(still.collect())
    hot = [r.node for r in out if r.node < 100]
    assert len(hot) == len(set(hot)) == 70
    assert all(r.place == -1 for r in out if r.band < 0)


def test_hot_group_of_near_copies(spark, monkeypatch):
    """Copies around a middle that isn't first, and texts near them that are linked with none."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def changed(n):
        words = list(base)
        for k in rng.sample(range(0, 300, 5), n):
            words[k] = f"x{rng.randrange(10**9)}"
        return " ".join(words)

    texts = [changed(8) for _ in range(60)] + [" ".join(base)] + [changed(15) for _ in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(nd.shingles(t, 3).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for a, b in combinations(range(len(texts)), 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    seen = {}
    written = nd.written

    def noted(df, name):
        out = written(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(nd, "written", noted)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 3, 85).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) > 1 and least[60] == 0
    assert 0 < seen["meetings"] <= 2 * len(texts) < seen["still"]


def test_tiles_find_every_link_once(spark, monkeypatch):
    """Before, full sets met in a join with one key for each band, which Spark split by its files on both sides: tasks grew with the square of a band."""
    rng = random.Random(3)
    monkeypatch.setattr(nd, "SETS_TOGETHER", 4)
    monkeypatch.setattr(nd, "COLUMNS_TOGETHER", 16)
    n_bands, size = nd.bands(85)
    base = sorted(rng.sample(range(10**9), 60))
    rows, sets = [], {}
    for node in range(30):
        s = nd.np.unique(nd.np.array(base[: 60 - rng.randrange(4)] + rng.sample(range(10**9), rng.randrange(8)), nd.np.uint64))
        band, odd = nd.sketch(s, n_bands, size)
        sets[node] = set(s.tolist())
        rows.append((node, len(s), node % 7, 5, -1, band, nd.np.frombuffer(odd, nd.np.int64).tolist(), 8, s.view(nd.np.int64).tolist()))
    df = spark.createDataFrame(rows, "node long, n long, root long, band long, place int, bands array<long>, sketch array<long>, parts int, shingles array<long>")
    got = [tuple(sorted((r.a, r.b))) for r in nd.linked_in_tiles(df, 85).collect()]
    want = {(a, b) for a, b in combinations(range(30), 2) if a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 30 * 29 / 2
    assert "SortMergeJoin" not in nd.linked_in_tiles(df, 85)._jdf.queryExecution().executedPlan().toString()


def test_few_links_take_one_step(spark, monkeypatch):
    """Before, a chain took as many rounds of jobs as its length needs."""
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(1000, 999), (5, 5), (7, 6)], "a long, b long")
    spark.sparkContext.setJobGroup("few", "few")
    few = {tuple(r) for r in rows.components(links).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("", "")
    assert few == {(k, 0) for k in range(41)} | {(999, 999), (1000, 999)} and jobs <= 6
    monkeypatch.setattr(rows, "FEW_LINKS", 0)
    assert {tuple(r) for r in rows.components(links).collect()} == few


def test_bands_and_sketches_stay_where_they_are(spark):
    """Before, five joins shuffled the bands or sketches of all rows, and one their entries in all bands: 20.1 MB here."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6_000)]
    texts += texts[:300] + [t + " more" for t in texts[:300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    try:
        before = shuffled()
        out = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 3, 85).collect()}
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert out == {i: i if i < 6_000 else (i - 6_000) % 300 for i in range(6_600)}
    assert moved < 7_000_000, moved


def test_without_members_is_exact(spark, monkeypatch):
    df = spark.range(3_000).selectExpr("id as row", "array(id, 7) as bands")
    members = spark.range(0, 3_000, 3).toDF("row")
    want = [k for k in range(3_000) if k % 3]
    for few in (1 << 18, 0):
        monkeypatch.setattr(rows, "FEW", few)
        monkeypatch.setattr(rows, "FILTER_BITS", 26 if few else 8)  # a filter that takes many others for members
        assert sorted(r.row for r in rows.without_members(df, members).collect()) == want
