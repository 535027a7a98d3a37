"""Registered queries of record rules: names, links, tiers, sampling, review values, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.functions import media, text
from assetlens.operators import review, timing
from assetlens.plans.queries import query
from assetlens.sources.tables import table

_PATH = "'/lib/' || lower(replace(p_brand, '#', '_')) || '_' || lower(p_type) || '_v0' || (p_partkey % 4) || '_' || CASE p_partkey % 3 WHEN 0 THEN 'proxy' WHEN 1 THEN '1080p' ELSE 'master_4k' END || '.mov'"
_ROOT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({0}, '([^/]*)[.][^./]+$', 1)), '(^|[^a-z0-9])[0-9]{{2,8}}$', '\\1'), '[._-]?(master|proxy|preview|prores|h264|h265|exr|dpx)$', ''), '[._-]?(480p|720p|1080p|2k|4k|6k|8k|uhd|hd|sd)$', ''), '[._-]+v[0-9]{{1,4}}$', ''), '[^a-z0-9]+', '_', 'g'), '_')"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr(_PATH)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), (F.col("p_size") / 10.0).cast("double").alias("seconds"), (F.col("p_partkey") % 3 * 640).alias("width"), F.lit(720).cast("long").alias("height"))
    return parts.withColumn("root", text.normalized_root(F.col("path")))


@query(f"SELECT p_partkey AS id, {_PATH} AS path, {_ROOT.format(_PATH)} AS root FROM part")
def q48_name_roots(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("id", "path", "root")


@query(f"""WITH r AS (SELECT p_partkey AS id, {_ROOT.format(_PATH)} AS root, CAST(p_size / 10.0 AS DOUBLE) AS seconds, p_partkey % 3 * 640 AS width, 720 AS height FROM part),
  c AS (SELECT root, seconds, width, min(id) AS first FROM r GROUP BY root, seconds, width)
  SELECT c.first AS a, r.id AS b FROM r JOIN c ON r.root = c.root AND r.seconds = c.seconds AND r.width = c.width WHERE r.id <> c.first
  UNION ALL SELECT x.first, y.first FROM c x JOIN c y ON x.root = y.root AND x.first < y.first WHERE abs(x.seconds - y.seconds) <= greatest(0.25, 0.03 * greatest(x.seconds, y.seconds))
    AND (x.width = 0 OR y.width = 0 OR abs(x.width / 720.0::DOUBLE - y.width / 720.0::DOUBLE) <= greatest(0.02, 0.02 * x.width / 720.0::DOUBLE))""")
def q49_name_links(spark: SparkSession, sf: str) -> DataFrame:
    return review.name_links(_records(spark, sf))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 <= 1 THEN 1.0::DOUBLE ELSE least(1.0, greatest(0.25, CASE WHEN p_size % 2 = 0 THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.25::DOUBLE ELSE 0 END)) END AS confidence FROM part""")
def q50_link_confidence(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda n: F.col("p_size") % n == 0
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), review.link_confidence(flag(2), flag(3), flag(5), F.col("p_size") % 4).alias("confidence"))


@query("""WITH d AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 2 AS s FROM part),
  b AS (SELECT id, CASE WHEN s > 0 AND s <= 5 THEN 8.0::DOUBLE WHEN s > 0 AND s <= 15 THEN 4.0 ELSE 2.0 END AS base_fps, CASE WHEN s > 0 AND s <= 5 THEN 48 WHEN s > 0 AND s <= 15 THEN 64 ELSE 96 END AS base_frames FROM d),
  e AS (SELECT *, least(12.0, greatest(4.0, base_fps * 2)) AS dense_fps, least(160, greatest(base_frames + 24, base_frames * 2)) AS dense_frames FROM b)
  SELECT *, least(24.0, greatest(8.0, dense_fps * 2)) AS ultra_fps, least(256, greatest(dense_frames + 48, CAST(floor(dense_frames * 1.5) AS INTEGER))) AS ultra_frames FROM e""")
def q51_sampling_plans(spark: SparkSession, sf: str) -> DataFrame:
    plans = media.sampling_plan(F.col("p_size").cast("double") / 2)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[c.alias(f"{name}_{what}") for name, plan in plans.items() for what, c in zip(("fps", "frames"), plan)])


@query("""SELECT p_partkey AS id,
    CASE WHEN p_size % 7 * 1000 = 0 THEN 'unknown' WHEN p_size % 7 * 1000 >= 6000 THEN '6k_plus' WHEN p_size % 7 * 1000 >= 3840 THEN '4k' WHEN p_size % 7 * 1000 >= 2048 THEN '2k' WHEN p_size % 7 * 1000 >= 1280 THEN 'hd' ELSE 'sd' END AS resolution,
    CASE WHEN p_size * 2.5 = 0 THEN 'variable' WHEN abs(p_size * 2.5 - 120) <= 0.75 THEN '120_plus' WHEN abs(p_size * 2.5 - 24) <= 0.75 AND abs(p_size * 2.5 - 24) <= abs(p_size * 2.5 - 25) THEN '24' WHEN abs(p_size * 2.5 - 48) <= 0.75 THEN '48' WHEN abs(p_size * 2.5 - 25) <= 0.75 THEN '25' WHEN abs(p_size * 2.5 - 30) <= 0.75 THEN '30' WHEN abs(p_size * 2.5 - 50) <= 0.75 THEN '50' WHEN abs(p_size * 2.5 - 60) <= 0.75 THEN '60' ELSE 'variable' END AS rate,
    CASE p_partkey % 5 WHEN 0 THEN 'rec709' WHEN 1 THEN 'rec2020' WHEN 2 THEN 'srgb' WHEN 3 THEN 'unknown' ELSE 'acescg' END AS color_space,
    CASE WHEN (p_size / 50.0 >= 0.35) THEN 'green_screen' ELSE NULL END AS key_screen FROM part""")
def q52_technical_tiers(spark: SparkSession, sf: str) -> DataFrame:
    edge, zero = F.col("p_size") % 7 * 1000, F.lit(0.0)
    space = F.element_at(F.array(*map(F.lit, ("BT709", "bt2020nc", "sRGB IEC", "", "ACEScg"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), media.resolution_tier(edge, edge).alias("resolution"), media.frame_rate_tier(F.col("p_size") * 2.5).alias("rate"), media.color_space(space).alias("color_space"),
        media.key_screen(F.col("p_size") / 50.0, zero, zero, zero).alias("key_screen"),
    )


_CUES = " ".join(f"WHEN regexp_matches(split_part(text, ' ', 1) || source, '{cue}') THEN '{family}'" for cue, family in review.CUES)


@query(f"SELECT doc_id, CASE WHEN lang <> 'en' THEN lang {_CUES.replace('text', 'lower(text)').replace('|| source', '')} ELSE source END AS family FROM documents")
def q53_display_family(spark: SparkSession, sf: str) -> DataFrame:
    family = F.when(F.col("lang") == "en", "unknown").otherwise(F.col("lang"))
    path = F.concat(F.lit("/lib/"), F.translate(F.split("text", " ")[0], "/", "_"), F.lit(".mov"))
    return table(spark, sf, "documents").select("doc_id", review.display_family(family, path, F.col("source")).alias("family"))


@query("""SELECT conv_id, turn, array_to_string(CASE role WHEN 'user' THEN ['user', 'fire_smoke'] WHEN 'assistant' THEN ['none'] ELSE [role, 'fire_smoke', 'rain'] END, ',') AS tokens,
    array_to_string(list_filter(['fire', 'rain', 'smoke'], lambda f: f <> (CASE turn % 3 WHEN 0 THEN 'fire' WHEN 1 THEN 'rain' ELSE 'snow' END)), ',') AS families, 'made,kept ' || turn AS history,
    sha256('{"conv_id":' || conv_id || ',"turn":' || turn || '}') AS version FROM conversations""")
def q54_review_values(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("role") == "user", " User,Fire / Smoke,, user").when(F.col("role") == "assistant", " , ").otherwise(F.concat("role", F.lit(",fire-smoke,RAIN,fire smoke")))
    primary = F.element_at(F.array(*map(F.lit, ("fire", "rain", "snow"))), (F.col("turn") % 3 + 1).cast("int"))
    families = review.secondary_families(F.array(F.lit("fire"), F.lit("rain"), F.lit("fire")), F.array(F.lit("smoke"), F.lit("rain")), primary)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(review.review_list(raw), ",").alias("tokens"), F.array_join(families, ",").alias("families"),
        F.array_join(review.with_history(F.array(F.lit("made")), F.concat(F.lit("kept "), F.col("turn").cast("string"))), ",").alias("history"), review.version_token("conv_id", "turn").alias("version"),
    )


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0 OR toxic = 1) AS to_review FROM labels")
def q55_review_counters(spark: SparkSession, sf: str) -> DataFrame:
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return review.counters(table(spark, sf, "labels"), good=~bad, toxic=toxic, to_review=bad | toxic)


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def q56_unknown_ids(spark: SparkSession, sf: str) -> DataFrame:
    return review.unknown_ids(table(spark, sf, "labels"), table(spark, sf, "documents").filter("lang = 'en'"), "doc_id")


@query("SELECT * FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place, lang FROM documents) WHERE place > 120 AND place <= 240")
def q57_second_page(spark: SparkSession, sf: str) -> DataFrame:
    ranked = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("place"))
    return review.page(ranked, "place", 1)


@query("""WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * (0.02 * (1 + user_id % 4))::DOUBLE AS t FROM events),
  r AS (SELECT user_id, greatest(1, least(6, CAST(round_even(0.12 / greatest(0.001, (max(t) - min(t)) / greatest(1, count(*) - 1)), 0) AS INTEGER))) AS radius FROM s GROUP BY user_id),
  i AS (SELECT s.*, radius, row_number() OVER (PARTITION BY s.user_id ORDER BY t) AS n FROM s JOIN r USING (user_id))
  SELECT a.event_id, a.radius, round(avg(b.value), 6) AS smooth FROM i a JOIN i b ON a.user_id = b.user_id AND abs(a.n - b.n) <= a.radius GROUP BY a.event_id, a.radius""")
def q58_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * (F.lit(0.02) * (1 + F.col("user_id") % 4))
    series = table(spark, sf, "events").select("user_id", "event_id", "value", seconds.cast("double").alias("t"))
    return timing.smoothed(series, ["user_id"], "t", "value").select("event_id", "radius", F.round("smooth", 6).alias("smooth"))


@query("""WITH c AS (SELECT event_id, user_id, abs(value - lag(value) OVER w) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  n AS (SELECT *, lead(change) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM c)
  SELECT event_id, round(CASE WHEN change IS NOT NULL AND nxt IS NOT NULL THEN (change + nxt) / 2 ELSE coalesce(change, nxt) END, 6) AS signal FROM n""")
def q59_change_signal(spark: SparkSession, sf: str) -> DataFrame:
    change = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")))
    series = table(spark, sf, "events").select("event_id", "user_id", change.alias("change"))
    return timing.change_signal(series, ["user_id"], "event_id", "change").select("event_id", F.round("signal", 6).alias("signal"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS facet, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE '' END AS claimed_only, 'top' AS measured_only FROM events")
def q60_facets_and_edges(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"value": '), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.get_json_object("props", "$.k"))
    claimed = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("right")))
    lost, new = review.set_changes(claimed, F.array(F.lit("top"), F.lit("right")))
    return table(spark, sf, "events").select("event_id", review.facet_value(wrapped).alias("facet"), F.array_join(lost, ",").alias("claimed_only"), F.array_join(new, ",").alias("measured_only"))
