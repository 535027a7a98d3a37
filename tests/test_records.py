"""Record rules: names, phrases, filters, tiers, links, review values, smoothing."""

import random

import pytest
from pyspark.sql import functions as F

from assetlens.functions import media, text
from assetlens.operators import discover, gate, review, search, timing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path, root", [
    ("/a/fire_master.0001.exr", "fire_master"), ("/a/fire_master.exr", "fire"), ("fire1080p.mov", "fire"), ("Big-Smoke_4k_v012.mov", "big_smoke_4k"),
    ("big_smoke_v012_4k.mov", "big_smoke"), ("snow_1001.png", "snow"), ("take2.mov", "take2"), (".hidden", "hidden"), ("v1.mov", "v1"), ("1234.mov", "1234"), ("a/b/", "b"),
])
def test_normalized_root(spark, path, root):
    assert one(spark, text.normalized_root(F.lit(path))) == root


def test_frames_take_any_suffix(spark):
    names = [("d", n) for n in ("a.0001.my-layer.exr", "0007.HR.exr", "x-003.é", "a.0001", "a.0001.", "noframe.exr")]
    got = {r["name"]: (r["prefix"], r["frame"], r["suffix"]) for r in discover.parse_frames(spark.createDataFrame(names, "dir string, name string")).collect()}
    assert got["a.0001.my-layer.exr"] == ("a", 1, ".my-layer.exr") and got["0007.HR.exr"][1:] == (7, ".HR.exr") and got["x-003.é"][1:] == (3, ".é")
    assert got["a.0001"][1] is None and got["a.0001."][1] is None and got["noframe.exr"][1] is None


def test_missing_frames_come_from_neighbours(spark):
    rows = spark.createDataFrame([("k", f) for f in (3, 4, 7, 7, 12)] + [("one", 5)], "k string, frame long")
    assert [(r["n_frames"], r["n_missing"], r["missing"]) for r in discover.collapse_sequences(rows, ["k"], "frame").collect()] == [(4, 6, "5,6,8,9,10,11")]


def test_phrases_come_before_words(spark):
    phrases, aliases = [("green screen", "greenscreen"), ("top down", "top_down"), ("away from camera", "away_from_camera")], {"blast": "explosion"}
    got = lambda t: one(spark, text.phrase_concepts(F.lit(t), phrases, aliases))
    assert got("The green_screen green screen of a BLAST, 12 x down") == ["down", "explosion", "greenscreen"]
    assert got("walks away from-camera top down top") == ["away_from_camera", "top", "top_down", "walks"]
    assert got(None) == [] == got("the vfx 1 2")


def test_search_needs_the_families_of_the_query(spark):
    rows = spark.createDataFrame([(1, "fire on ground wide", ["fire"]), (2, "fire on ground wide", ["smoke"]), (3, "ground", ["fire"])], "element_id long, caption string, families array<string>")
    rows = rows.withColumn("sort_order", F.col("element_id"))
    ask = lambda **more: {r["element_id"]: r["score"] for r in search.score(rows, "vfx ground fire", {"caption": F.col("caption")}, F.col("families"), **more).collect()}
    assert ask() == {1: round(0.58 + 0.32 * 0.70 + 0.10, 6)}
    assert ask(affirmed=F.array(F.lit("fire"))) == {1: round(0.58 + 0.32 * 0.70 + 0.10, 6), 2: round(0.58 + 0.32 * 0.70, 6)}


def test_filters(spark):
    row = spark.sql("SELECT 'fire' AS category, 'explosion' AS primary_family, array('smoke') AS secondary_families, map('mood', 'dark') AS facets, '{\"motion\": {\"speed\": \"fast\"}, \"tags\": [\"a\", \"b\"]}' AS semantic")
    families = {c: F.col(c) for c in ("category", "primary_family", "secondary_families")}
    passes = lambda **f: row.select(search.passes({k.replace("__", "."): v for k, v in f.items()}, families, F.col("facets"), F.col("semantic"))).first()[0]
    assert passes(category="fire", primary_family="explosion", secondary_family="smoke", mood="dark", semantic__motion__speed="fast", semantic__tags="b") and passes(category="explosion") and passes(category="")
    assert not any((passes(category="smoke"), passes(primary_family="fire"), passes(mood="light"), passes(other="x"), passes(semantic__tags="c"), passes(semantic__none="x")))


def test_tiers_of_unknown_values(spark):
    assert [one(spark, media.resolution_tier(F.lit(w).cast("int"), F.lit(h).cast("int"))) for w, h in ((None, 720), (0, 0), (1920, 1080), (6144, 10))] == ["unknown", "unknown", "hd", "6k_plus"]
    assert [one(spark, media.frame_rate_tier(F.lit(f).cast("double"))) for f in (None, 0, 23.976, 24.5, 29.97, 119.5, 240)] == ["variable", "variable", "24", "24", "30", "120_plus", "variable"]
    assert one(spark, media.nearest_frame(F.lit(0.5), F.lit(1.0), F.lit(9))) == 0 and one(spark, media.nearest_frame(F.lit(1.5), F.lit(1.0), F.lit(9))) == 2


def test_overlay_tells_of_any_field(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "id int, x string, y string")
    over = spark.createDataFrame([(1, None, "z")], "id int, x string, y string")
    assert {r["id"]: (r["x"], r["y"], r["overridden"]) for r in gate.overlay(base, over, "id", ["x", "y"]).collect()} == {1: ("a", "z", True), 2: ("a", "b", False)}


def test_name_links_give_the_components_of_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, 0.0, 1.0, 1.2, 1.5, 9.0, 9.2]), rnd.choice([None, 640, 1280]), rnd.choice([360, 720])) for i in range(60)]

    def fits(a, b):
        if (a[2] or 0) > 0 and (b[2] or 0) > 0 and abs(a[2] - b[2]) > max(0.25, 0.03 * max(a[2], b[2])):
            return False
        return not (a[3] and a[4] and b[3] and b[4]) or abs(a[3] / a[4] - b[3] / b[4]) <= max(0.02, 0.02 * a[3] / a[4])

    def parts(edges):
        label = list(range(60))
        for _ in range(60):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    got = review.name_links(spark.createDataFrame(rows, "id long, root string, seconds double, width int, height int")).collect()
    assert all(rows[r["a"]][1] == rows[r["b"]][1] and fits(rows[r["a"]], rows[r["b"]]) for r in got)
    assert parts([(r["a"], r["b"]) for r in got]) == parts([(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and fits(a, b)])


def test_review_values(spark):
    assert one(spark, review.review_list(F.lit(" A b, ,a-B,c"))) == ["a_b", "c"] and one(spark, review.review_list(F.lit(None).cast("string"))) == ["none"]
    assert one(spark, review.display_family(F.lit("unknown"), F.lit("/x/Vapor_Blast.mov"), F.lit("c"))) == "smoke" and one(spark, review.display_family(F.lit(None), F.lit("q.mov"), F.lit(""))) == "unknown"
    assert one(spark, review.facet_value(F.lit('{"value": "x", "source": "y"}'))) == "x" and one(spark, review.facet_value(F.lit("plain"))) == "plain"
    assert one(spark, text.has_any(F.lit("Big Fire"), [" fire "])) and not one(spark, text.has_any(F.lit(None).cast("string"), ["x"]))


def test_smoothing_equals_slices(spark):
    rnd = random.Random(6)
    series = {k: [(i * step, rnd.random()) for i in range(n)] for k, (step, n) in enumerate([(0.01, 30), (0.05, 12), (0.5, 4), (1.0, 1)])}
    rows = spark.createDataFrame([(k, t, v) for k, s in series.items() for t, v in s], "k long, t double, v double")
    got = {(r["k"], r["t"]): r["smooth"] for r in timing.smoothed(rows, ["k"], "t", "v").collect()}
    for k, s in series.items():
        interval = max(1e-3, (s[-1][0] - s[0][0]) / max(1, len(s) - 1))
        radius = max(1, min(6, round(0.12 / interval)))
        for i, (t, _) in enumerate(s):
            near = [v for _, v in s[max(0, i - radius):i + radius + 1]]
            assert got[k, t] == pytest.approx(sum(near) / len(near))
