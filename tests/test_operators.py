import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from assetlens.functions import text
from assetlens.operators import annotate, catalog, discover, escalate, link, search, timing
from assetlens.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_sequences_and_gaps(spark):
    names = ["a.1001.exr", "a.1002.exr", "a.1005.exr", "0001.HR.exr", "0002.HR.exr", "b-0001.exr", "name0001.exr", "a.1.png"]
    frames = discover.parse_frames(spark.createDataFrame([("d", n) for n in names], "dir string, name string"))
    keys = ["dir", "prefix", "separator", "suffix", "width"]
    got = {r["prefix"]: (r["n_frames"], r["missing"]) for r in discover.collapse_sequences(frames.filter("frame IS NOT NULL"), keys, "frame").collect()}
    assert got == {"a": (3, "1003,1004"), "": (2, "")}
    assert {r["prefix"] for r in discover.stills(frames.filter("frame IS NOT NULL"), keys, "frame").collect()} == {"b"}


def test_hamming_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    words = base + [w ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(8))) & (2**64 - 1) for w in base]
    rows = [(i, w >> 32, w & 0xFFFFFFFF) for i, w in enumerate(words)]
    got = {(r["a"], r["b"], r["distance"]) for r in link.hamming_pairs(spark.createDataFrame(rows, "id long, high long, low long"), 6).collect()}
    want = {(i, j, d) for i in range(60) for j in range(i + 1, 60) if (d := (words[i] ^ words[j]).bit_count()) <= 6}
    assert got == want


def test_components_of_random_edges(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(70, 90)]
    label = list(range(100))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    got = {r["node"]: r["component"] for r in link.components(spark.range(100).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in range(100)}


def test_components_of_a_shuffled_chain_take_few_rounds(spark):
    ids = list(range(150))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got = link.components(spark.range(160).withColumnRenamed("id", "node"), edges, rounds=12).collect()
    assert sorted(map(tuple, got)) == [(i, 0 if i < 150 else i) for i in range(160)]


def test_cut_leaves_the_estimated_size_of_its_lineage_behind(spark):
    frame, sizes = spark.range(50), []
    for _ in range(3):
        frame = link.cut(frame.join(frame.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
        sizes.append(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert frame.count() == 50 and len(set(sizes)) == 1


def test_islands_fill_short_gaps(spark):
    flags = [1, 0, 1, 0, 0, 1, 1, 0]
    rows = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(flags)], "clip string, t int, value double")
    got = [(r["start"], r["end"]) for r in timing.islands(rows, ["clip"], "t", F.col("value") > 0).orderBy("start").collect()]
    assert got == [(0, 2), (5, 6)]


@pytest.mark.parametrize("sentence, words", [
    ("fire without smoke", ["fire"]), ("smoke is absent, fire", ["fire"]), ("possibly sparks. dust", ["dust"]), ("no rain but snow", ["snow"]), ("", []),
])
def test_affirmed_words(spark, sentence, words):
    row = spark.createDataFrame([(sentence,)], "t string").select(text.affirmative_words(F.col("t")).alias("w")).first()
    assert row["w"] == words


def test_search_aliases_and_empty_queries(spark):
    rows = spark.createDataFrame([("e1", 0, "Wide blast, top_view"), ("e2", 1, "ground fire"), ("e3", 2, None)], "element_id string, sort_order int, text string")
    aliases = {"blast": "explosion"}
    said = text.concepts(F.col("text"), aliases)  # a family that the query names has to be the element's or be affirmed
    hit = lambda q, **more: [r["element_id"] for r in search.top(search.score(rows, q, {"summary": F.col("text")}, F.array(), aliases, **({"affirmed": said} | more)), 5).collect()]
    assert hit("explosion", affirmed=None) == [] == hit("fire ground", affirmed=None)
    assert hit("explosion") == ["e1"] and hit("fire ground") == ["e2"] and hit("123") == ["e1", "e2", "e3"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 0, "a", 0), (2, 1, "b", 0)], "id long, sort_order long, v string, version int")
    new = spark.createDataFrame([(2, None, "B", 1), (3, None, "c", 1), (3, None, "C", 2)], "id long, sort_order long, v string, version int")
    once = catalog.upsert(old, new, "id", "version", "sort_order").select("id", "sort_order", "v", "version")
    assert {tuple(r) for r in once.collect()} == {(1, 0, "a", 0), (2, 1, "B", 1), (3, 2, "C", 2)}
    assert catalog.equal(catalog.upsert(once, new, "id", "version", "sort_order").select("id", "sort_order", "v", "version"), once)


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/cat"
    assert catalog.write_snapshot(spark.range(3), root) == 0 and catalog.write_snapshot(spark.range(5), root) == 1
    assert catalog.read_snapshot(spark, root).count() == 5 and catalog.read_snapshot(spark, root, 0).count() == 3


def test_separation_follows_the_order_of_lists(spark):
    clusters = spark.createDataFrame([(n, 1) for n in (1, 2, 3, 4)] + [(9, 9)], "node long, component long")
    lists = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (1, 0, 1), (1, 1, 3), (2, 0, 3), (2, 1, 4), (2, 2, 77)], "list_no int, pos int, node long")
    got = {r["node"]: r["component"] for r in link.separate(clusters, lists).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 9: 9}


def test_diverse_subset_equals_greedy_choice(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice("abc"), rnd.choice("de"), rnd.choice("fghi")], rnd.randrange(3)) for i in range(30)]
    left, seen, want = list(rows), set(), []
    while len(want) < 12:
        best = max(left, key=lambda r: (len(set(r[1]) - seen), r[2], r[0]))
        want.append(best[0])
        seen |= set(best[1])
        left.remove(best)
    frame = spark.createDataFrame(rows, "id long, fs array<string>, w int")
    got = annotate.diverse_subset(frame, "id", F.col("fs"), [F.col("w")], 12).orderBy("rank").collect()
    assert [r["id"] for r in got] == want
    assert annotate.diverse_subset(frame.limit(0), "id", F.col("fs"), [F.col("w")], 12).count() == 0


def test_stages_get_only_what_is_undecided(spark):
    rows = spark.range(6).withColumnRenamed("id", "k")
    first = lambda d: d.select("k", (F.col("k") < 2).alias("accepted"), F.lit(0.5).alias("score"))
    second = lambda d: d.select("k", (F.col("k") < 4).alias("accepted"), F.lit(0.4).alias("score"))
    made = escalate.run_stages(rows, "k", [("primary", first), ("dense", second)])
    assert made.count() == 10
    best = {r["k"]: (r["attempt"], r["accepted"]) for r in escalate.best_candidate(made, "k", "attempt").collect()}
    assert best == {0: (0, True), 1: (0, True), 2: (1, True), 3: (1, True), 4: (0, False), 5: (0, False)}


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), db.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda d: sorted(str([None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v) for v in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_annotation_queue_reads_its_rows_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None)], "k long, print string, family string").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    queue = annotate.annotation_queue(rows, "k", ["print", "family"], F.col("print") == "z", seed=1, limit=9)
    assert {(r["k"], r["n_members"]) for r in queue.collect()} == {(1, 3), (4, 1)}
    assert rows.inputFiles() and not queue.inputFiles()


def test_annotation_queue_counts_a_repeated_row_once_each_time(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "b"), (3, "b")], "k long, print string")
    queue = annotate.annotation_queue(rows, "k", ["print"], F.lit(False), seed=1, limit=9)
    assert {(r["k"], r["n_members"]) for r in queue.collect()} == {(1, 3), (3, 3)}
