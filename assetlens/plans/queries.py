"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.functions import media, text
from assetlens.operators import annotate, catalog, discover, escalate, facets, gate, link, ratings, search, timing
from assetlens.sources.tables import table
from assetlens.streaming.votes import windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("element"), F.col("user_id").alias("rater"), (F.col("event_id") % 5 + 1).cast("int").alias("stars"), "ts", F.col("event_id").alias("vote_id"))


_VOTES = "WITH v AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS element, user_id AS rater, CAST(event_id % 5 + 1 AS INTEGER) AS stars, ts, event_id FROM events), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element, rater ORDER BY ts DESC, event_id DESC) AS rn FROM v) WHERE rn = 1), s AS (SELECT element, count(*) AS n_votes, round(avg(stars), 2) AS average, count(*) FILTER (stars = 1) AS stars_1, count(*) FILTER (stars = 2) AS stars_2, count(*) FILTER (stars = 3) AS stars_3, count(*) FILTER (stars = 4) AS stars_4, count(*) FILTER (stars = 5) AS stars_5, round((avg(stars) * count(*) + 15) / (count(*) + 5), 3) AS quality FROM latest GROUP BY element)"


@query(f"{_VOTES} SELECT * FROM s")
def q01_rating_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.rating_summary(votes(spark, sf))


@query(f"{_VOTES} SELECT * FROM (SELECT *, row_number() OVER (ORDER BY quality DESC, n_votes DESC, average DESC, element) AS rank FROM s) WHERE rank <= 25")
def q02_quality_sort(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.quality_ranks(q01_rating_summary(spark, sf), 25)


@query("SELECT coalesce(p_type, '(all)') AS family, coalesce(p_brand, '(all)') AS subtype, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand)")
def q03_facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").rollup("p_type", "p_brand").agg(F.count("*").alias("n")).select(F.coalesce("p_type", F.lit("(all)")).alias("family"), F.coalesce("p_brand", F.lit("(all)")).alias("subtype"), "n")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size >= 20 AND p_name LIKE '%ring%'")
def q04_technical_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter((F.col("p_type") == "ECONOMY") & (F.col("p_size") >= 20) & F.col("p_name").contains("ring")).select("p_partkey", "p_name", "p_size")


QUERY = "that this was onou tion en"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(translate({}, '_-', '  ')), '([a-z0-9_]+)', 1), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains(['a','an','and','asset','element','for','in','into','of','on','or','the','to','vfx','with'], w)))"
_SEARCH = f"""WITH q AS (SELECT ['en','onou','that','this','tion','was'] AS words), b AS (
    SELECT doc_id, lang, list_intersect(words, {_TOKENS.format("lang")}) AS identity, list_intersect(words, {_TOKENS.format("text")}) AS summary, list_intersect(words, {_TOKENS.format("source")}) AS filename, words FROM documents, q),
  m AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_concat(identity, summary), filename))) AS found,
    list_sum(list_transform(words, lambda w: greatest(CASE WHEN list_contains(identity, w) THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN list_contains(summary, w) THEN 0.92::DOUBLE ELSE 0 END, CASE WHEN list_contains(filename, w) THEN 0.74::DOUBLE ELSE 0 END))) / 6 AS weighted,
    CASE WHEN list_contains(words, lang) THEN 1.0::DOUBLE ELSE 0 END AS family, lang FROM b),
  hits AS (SELECT doc_id AS element_id, doc_id AS sort_order, CAST(len(found) AS BIGINT) AS n_matched, round(len(found) / 6::DOUBLE, 6) AS coverage, round(weighted, 6) AS weighted,
    round(least(1.0, 0.58 * (len(found) / 6::DOUBLE) + 0.32 * weighted + 0.10 * family), 6) AS score, array_to_string(found, ',') AS matched FROM m WHERE len(found) >= 4 AND lang = 'en'),
  ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, sort_order) AS rank FROM hits QUALIFY rank <= 50)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), F.col("doc_id").alias("sort_order"), "text", "lang", "source")
    return search.score(docs, QUERY, {"identity": F.col("lang"), "summary": F.col("text"), "filename": F.col("source")}, F.array("lang"), family_concepts=["de", "en", "es", "fr"])


@query(f"{_SEARCH} SELECT * FROM ranked")
def q05_concept_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(_hits(spark, sf), 50)


@query(f"{_SEARCH} SELECT n_matched, count(*) AS n, max(score) AS best, min(score) AS least FROM hits GROUP BY n_matched")
def q06_lexical_explain(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).groupBy("n_matched").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("least"))


@query(f"{_SEARCH}, e AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_sum(list_transform(list_zip(embedding, probe), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 9) DESC, vec_id) AS vr FROM e, p) SELECT element_id, rank, vr AS vector_rank, round(1.0 / (60 + rank) + 1.0 / (60 + vr), 9) AS rrf FROM ranked JOIN v ON vec_id = element_id")
def q07_rank_signals_rrf(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    probe = vectors.filter("vec_id = 0").select(F.col("embedding").alias("probe"))
    scored = vectors.crossJoin(F.broadcast(probe)).select("vec_id", F.round(media.cosine(F.col("embedding"), F.col("probe")), 9).alias("cos"))  # the probe is one vector
    hits = q05_concept_search(spark, sf)
    own = hits.select("element_id").join(scored, F.col("element_id") == F.col("vec_id")).select("element_id", F.col("cos").alias("own"))
    ahead = F.expr("cos > own OR cos = own AND vec_id < element_id").cast("long")  # each of the 50 hits is counted against all vectors
    by_vector = scored.crossJoin(F.broadcast(own)).groupBy("element_id").agg((F.sum(ahead) + 1).cast("int").alias("vector_rank"))
    return hits.join(by_vector, "element_id").select("element_id", "rank", "vector_rank", F.round(1 / (60 + F.col("rank")) + 1 / (60 + F.col("vector_rank")), 9).alias("rrf"))


@query(f"{_SEARCH}, g AS (SELECT r.*, md5(d.text) AS grp FROM ranked r JOIN documents d ON d.doc_id = r.element_id), s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) > 1 AS tail FROM g) SELECT element_id, rank, row_number() OVER (ORDER BY tail, rank) AS final_rank FROM s")
def q08_diversify(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("element_id"), F.md5("text").alias("grp"))
    return search.diversify(q05_concept_search(spark, sf).join(docs, "element_id"), "grp").select("element_id", "rank", "final_rank")


@query(f"{_VOTES}, {_SEARCH[5:]} SELECT element_id, rank, score, row_number() OVER (ORDER BY round(0.94 * score + 0.06 * coalesce(quality, 0) / 5, 6) DESC, rank) AS final_rank FROM ranked LEFT JOIN s ON s.element = element_id")
def q09_rating_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.rerank(q05_concept_search(spark, sf), q01_rating_summary(spark, sf)).select("element_id", "rank", "score", "final_rank")


@query("""WITH f AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem), g AS (SELECT l_orderkey, min(n) AS first_frame, max(n) AS last_frame, count(*) AS n_frames, list(n) AS seen FROM f GROUP BY l_orderkey HAVING count(*) >= 2)
    SELECT l_orderkey, first_frame, last_frame, n_frames, last_frame - first_frame + 1 - n_frames AS n_missing, array_to_string(list_filter(range(first_frame, last_frame + 1), lambda x: NOT list_contains(seen, x)), ',') AS missing FROM g""")
def q10_sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return discover.collapse_sequences(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("frame")), ["l_orderkey"], "frame")


@query("SELECT doc_id, n_members, first_member FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n_members, min(doc_id) OVER (PARTITION BY text) AS first_member FROM documents) WHERE n_members >= 2")
def q11_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return link.near_duplicate_groups(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fp")), "doc_id", "fp")


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    bits = lambda a, b: F.aggregate(F.slice("embedding", a, b), F.lit(0).cast("long"), lambda s, x: s * 2 + (x > 0).cast("long"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), bits(1, 32).alias("high"), bits(33, 32).alias("low"))


_HASHES = "WITH h AS (SELECT vec_id AS id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda x: CAST(x > 0 AS BIGINT))), lambda a, x: a * 2 + x) AS high, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[33:64], lambda x: CAST(x > 0 AS BIGINT))), lambda a, x: a * 2 + x) AS low FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id)"


@query(f"{_HASHES} SELECT * FROM p WHERE distance <= 18")
def q12_hash_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return link.hamming_pairs(hashes(spark, sf), 18)


@query("SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def q13_components(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("node"), F.sha2("text", 256).alias("fp"))
    return link.components(docs.select("node"), link.star_edges(docs, "node", "fp"))


@query("SELECT md5(text) AS fp, doc_id, n, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def q14_primary_pick(spark: SparkSession, sf: str) -> DataFrame:
    return link.primary_pick(table(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("fp")), "fp", ["n_chars"], "doc_id")


@query("WITH t AS (SELECT * FROM documents WHERE doc_id % 2 = 0), s AS (SELECT doc_id, md5(text) AS fp FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0), f AS (SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM t) AND fp NOT IN (SELECT md5(text) FROM t)) SELECT doc_id, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS rn FROM f) WHERE rn = 1")
def q15_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("fp"), F.col("doc_id").alias("pos"))
    return catalog.merge(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 OR doc_id % 10 = 0"), "doc_id", "fp", "pos").select("doc_id", "fp")


@query("WITH d AS (SELECT doc_id, md5(text) AS fp FROM documents) SELECT t.doc_id AS target, count(DISTINCT s.doc_id) AS n_sources, min(s.doc_id) AS source, CASE WHEN count(DISTINCT s.doc_id) = 1 THEN 'reused' ELSE 'ambiguous' END AS state FROM d t JOIN d s ON t.fp = s.fp AND s.doc_id % 2 = 0 WHERE t.doc_id % 2 = 1 GROUP BY t.doc_id")
def q16_reuse(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("fp"))
    return catalog.reuse(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), "doc_id", "fp")


@query("WITH c AS (SELECT p_partkey AS id, p_partkey AS sort_order, p_size AS size, 0 AS version FROM part WHERE p_partkey % 3 <> 0), ch AS (SELECT p_partkey AS id, p_size + 1 AS size, 1 AS version FROM part WHERE p_partkey % 2 = 0), top AS (SELECT max(sort_order) AS top FROM c) SELECT id, sort_order, size, version FROM c WHERE id NOT IN (SELECT id FROM ch) UNION ALL SELECT ch.id, c.sort_order, ch.size, ch.version FROM ch JOIN c USING (id) UNION ALL SELECT id, top + row_number() OVER (ORDER BY id), size, version FROM ch, top WHERE id NOT IN (SELECT id FROM c)")
def q17_upsert(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    current = parts.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("sort_order"), F.col("p_size").alias("size"), F.lit(0).alias("version"))
    changes = parts.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(None).cast("long").alias("sort_order"), (F.col("p_size") + 1).cast(parts.schema["p_size"].dataType).alias("size"), F.lit(1).alias("version"))
    return catalog.upsert(current, changes, "id", "version", "sort_order").select("id", "sort_order", "size", "version")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_size > 40 THEN 'deleted' ELSE 'kept' END AS action FROM part")
def q18_prune(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return catalog.full_save(parts.filter("p_partkey % 5 <> 0"), parts.filter("p_size <= 40 OR p_partkey % 5 = 0"), "p_partkey")


@query("SELECT doc_id, sha256(doc_id || chr(31) || lang || chr(31) || source || chr(31) || text) AS signature, doc_id % 7 = 0 AS stale FROM documents")
def q19_staleness(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    now = docs.select("doc_id", catalog.signature(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")).alias("signature"))
    before = docs.select("doc_id", catalog.signature(F.col("doc_id"), F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")), F.col("source"), F.col("text")).alias("was"))
    return now.join(before, "doc_id").select("doc_id", "signature", (F.col("signature") != F.col("was")).alias("stale"))


_DAILY = "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS value FROM events GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d), t AS (SELECT * FROM i WHERE value > 60), r AS (SELECT *, coalesce(i - lag(i) OVER w, 99) > 2 AS fresh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY day)), s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY day) AS segment FROM r), seg AS (SELECT user_id, segment, min(i) AS first_index, max(i) AS last_index, CAST(min(day) AS VARCHAR) AS start, CAST(max(day) AS VARCHAR) AS \"end\", max(value) AS peak FROM s GROUP BY user_id, segment)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("value"))


@query(f"{_DAILY} SELECT user_id, CAST(segment AS BIGINT) AS segment, first_index, last_index, start, \"end\", peak FROM seg")
def q20_action_timing(spark: SparkSession, sf: str) -> DataFrame:
    return timing.islands(_daily(spark, sf), ["user_id"], "day", F.col("value") > 60).withColumns({"start": F.col("start").cast("string"), "end": F.col("end").cast("string")})


@query("WITH m AS (SELECT event_type, count(value) AS n_samples, avg(value) AS mean, max(value) AS peak, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1), d AS (SELECT e.event_type, quantile_cont(abs(value - median), 0.5) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1) SELECT event_type, n_samples, round(mean, 6) AS mean, peak, round(median, 6) AS median, round(p90, 6) AS p90, round(mad, 6) AS mad, round(greatest(0.0015, median + greatest(0.0015, 3 * mad), p75 + 1.5 * (p75 - p25)), 6) AS threshold, round(least(1, greatest(0, (peak / greatest(mean, 0.002) - 1.4) / 4)), 6) AS transient FROM m JOIN d USING (event_type)")
def q21_profile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return timing.profile(table(spark, sf, "events"), "event_type", "value")


@query("SELECT event_id, CAST(greatest(0, least(floor(value * 24 + 1e-8), 2399)) AS BIGINT) AS first_frame, CAST(greatest(0, least(ceil((value + 1) * 24 - 1e-8) - 1, 2399)) AS BIGINT) AS last_frame FROM events")
def q22_frame_ranges(spark: SparkSession, sf: str) -> DataFrame:
    first, last = media.frame_range(F.col("value"), F.col("value") + 1, 24.0, F.lit(2399))
    return table(spark, sf, "events").select("event_id", first.alias("first_frame"), last.alias("last_frame"))


@query(f"{_DAILY}, n AS (SELECT user_id, count(*) AS n_samples FROM d GROUP BY 1), a AS (SELECT user_id, count(*) AS n_segments, sum(last_index - first_index + 1) AS active FROM seg GROUP BY 1) SELECT user_id, n_segments, round(active / n_samples, 6) AS coverage, CASE WHEN n_segments > 1 THEN 'multiple_events' WHEN active / n_samples >= 0.75 THEN 'continuous' WHEN active / n_samples <= 0.35 THEN 'burst' ELSE 'sustained' END AS pattern FROM a JOIN n USING (user_id)")
def q23_timing_audit(spark: SparkSession, sf: str) -> DataFrame:
    daily = _daily(spark, sf)
    return timing.action_pattern(timing.islands(daily, ["user_id"], "day", F.col("value") > 60), daily.groupBy("user_id").agg(F.count("*").alias("n_samples")), ["user_id"])


@query("SELECT p_partkey, CASE WHEN hits_metal >= hits_round AND hits_metal > 0 THEN 'metal' WHEN hits_round > 0 THEN 'round' ELSE 'unknown' END AS category, round(CASE WHEN greatest(hits_metal, hits_round) = 0 THEN 0.15 ELSE least(0.85, 0.35 + 0.15 * greatest(hits_metal, hits_round)) END, 6) AS confidence FROM (SELECT p_partkey, contains(p_name, 'bolt')::INT + contains(p_name, 'plate')::INT + contains(p_name, 'steel')::INT AS hits_metal, contains(p_name, 'ring')::INT + contains(p_name, 'wheel')::INT AS hits_round FROM part)")
def q24_classify(spark: SparkSession, sf: str) -> DataFrame:
    words = {"metal": ["bolt", "plate", "steel"], "round": ["ring", "wheel"]}
    hits = {k: sum((F.col("p_name").contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in words.items()}
    best = F.greatest(*hits.values())
    name = F.when(best == 0, "unknown").otherwise(F.coalesce(*[F.when(h == best, k) for k, h in hits.items()]))
    return table(spark, sf, "part").select("p_partkey", name.alias("category"), F.round(F.when(best == 0, 0.15).otherwise(F.least(F.lit(0.85), 0.35 + 0.15 * best)), 6).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN e >= 6000 THEN '6k_plus' WHEN e >= 3840 THEN '4k' WHEN e >= 2048 THEN '2k' WHEN e >= 1280 THEN 'hd' ELSE 'sd' END AS tier FROM (SELECT p_partkey, greatest(p_size * 150, p_size * 84) AS e FROM part)")
def q25_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", media.resolution_tier(F.col("p_size") * 150, F.col("p_size") * 84).alias("tier"))


@query()
def q26_affirmative_text(spark: SparkSession, sf: str) -> DataFrame:
    words = text.affirmative_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n_affirmed"), F.md5(F.array_join(words, " ")).alias("digest"))


@query("WITH r AS (SELECT d.doc_id, n_chars, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)), i AS (SELECT doc_id, list_filter([CASE WHEN quality IS NULL THEN 'missing:quality' END, CASE WHEN quality = 0 THEN 'low_confidence' END, CASE WHEN toxic = 1 THEN 'conflict:toxic' END, CASE WHEN n_chars < 200 THEN 'summary_too_vague' END, CASE WHEN lang = 'fr' THEN 'nonstandard_language' END], lambda x: x IS NOT NULL) AS issues, CASE WHEN quality = 1 THEN 0.9 ELSE 0.4 END AS conf, CASE WHEN quality IS NULL THEN 0.5 ELSE 1.0 END AS compl FROM r) SELECT doc_id, array_to_string(issues, ',') AS issues, NOT (list_contains(issues, 'low_confidence') OR list_contains(issues, 'conflict:toxic')) AS accepted, round(greatest(0, least(1, 0.5 * conf + 0.5 * compl - least(0.30, 0.035 * len(issues)))), 4) AS gate_score FROM i")
def q27_gate_issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    rules = [
        ("missing:quality", False, F.col("quality").isNull()), ("low_confidence", True, F.col("quality") == 0), ("conflict:toxic", True, F.col("toxic") == 1),
        ("summary_too_vague", False, F.col("n_chars") < 200), ("nonstandard_language", False, F.col("lang") == "fr"),
    ]
    out = gate.assess(rows, rules, F.when(F.col("quality") == 1, 0.9).otherwise(0.4), F.when(F.col("quality").isNull(), 0.5).otherwise(1.0))
    return out.select("doc_id", F.array_join("issues", ",").alias("issues"), "accepted", "gate_score")


@query("WITH a AS (SELECT conv_id, turn // 2 AS t, substr(text, 1, 1) AS initial, CAST(length(text) // 500 AS VARCHAR) AS size FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn // 2 AS t, substr(text, 1, 1) AS initial, CAST(length(text) // 500 AS VARCHAR) AS size FROM conversations WHERE role = 'assistant'), k AS (SELECT conv_id, min(t) AS t FROM a GROUP BY 1), x AS (SELECT a.conv_id, any_value(a.initial) AS initial, any_value(a.size) AS size FROM a JOIN k USING (conv_id, t) GROUP BY 1 HAVING count(*) = 1), l AS (SELECT conv_id, min(t) AS t FROM b GROUP BY 1), y AS (SELECT b.conv_id, any_value(b.initial) AS initial, any_value(b.size) AS size FROM b JOIN l USING (conv_id, t) GROUP BY 1 HAVING count(*) = 1), c AS (SELECT conv_id, list_filter([CASE WHEN x.initial <> y.initial AND x.initial <> '' AND y.initial <> '' THEN 'initial' END, CASE WHEN x.size <> y.size THEN 'size' END], lambda z: z IS NOT NULL) AS cl FROM x JOIN y USING (conv_id)) SELECT conv_id, array_to_string(cl, ',') AS clashes, len(cl) = 0 AS agree FROM c")
def q28_agreement(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", F.expr("turn div 2").alias("t"), "role", F.substring("text", 1, 1).alias("initial"), F.expr("cast(length(text) div 500 AS string)").alias("size"))

    def first(role: str) -> DataFrame:
        own = turns.filter(F.col("role") == role)
        at = own.groupBy("conv_id").agg(F.min("t").alias("t"))
        return own.join(at, ["conv_id", "t"]).groupBy("conv_id").agg(F.first("initial").alias("initial"), F.first("size").alias("size"), F.count("*").alias("n")).filter("n = 1")

    return gate.agreement(first("user"), first("assistant"), "conv_id", ["initial", "size"])


@query("SELECT d.doc_id, quality, toxic, n_chars FROM documents d JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1")
def q29_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").filter("quality = 0 OR toxic = 1"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 0 THEN 'xx' END, lang) AS lang, coalesce(CASE WHEN toxic = 1 THEN 'quarantine' END, source) AS source FROM documents d LEFT JOIN labels USING (doc_id)")
def q30_overrides(spark: SparkSession, sf: str) -> DataFrame:
    human = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "xx").alias("lang"), F.when(F.col("toxic") == 1, "quarantine").alias("source"))
    return gate.overlay(table(spark, sf, "documents").select("doc_id", "lang", "source"), human, "doc_id", ["lang", "source"]).drop("overridden")


@query("WITH c AS (SELECT unnest([{'field': 'length', 'ok': n_chars >= 500}, {'field': 'quality', 'ok': coalesce(quality = 1, false)}, {'field': 'clean', 'ok': coalesce(toxic = 0, false)}]) AS x FROM documents LEFT JOIN labels USING (doc_id)) SELECT coalesce(x.field, '(all)') AS field, count(*) FILTER (x.ok) AS passed, count(*) AS total, round(count(*) FILTER (x.ok) / count(*), 6) AS share FROM c GROUP BY ROLLUP (x.field)")
def q31_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    made = {"length": F.col("n_chars") >= 500, "quality": F.coalesce(F.col("quality") == 1, F.lit(False)), "clean": F.coalesce(F.col("toxic") == 0, F.lit(False))}
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("passed")) for k, v in made.items()])).alias("c")).select("c.*")
    return gate.checks(long)


@query("WITH v AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT vec_id AS probe_id, embedding AS probe FROM embeddings WHERE vec_id = 7) SELECT vec_id, cos, rank FROM (SELECT vec_id, cos, row_number() OVER (ORDER BY cos DESC, vec_id) AS rank FROM (SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, probe), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS cos FROM v, p)) WHERE rank <= 20")
def q34_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    probe = vectors.filter("vec_id = 7").select(F.col("embedding").alias("probe"))
    order = [F.desc("cos"), F.asc("vec_id")]
    scored = vectors.crossJoin(F.broadcast(probe)).select("vec_id", F.round(media.cosine(F.col("embedding"), F.col("probe")), 6).alias("cos"))  # the probe is one vector
    return scored.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 10 AND 20 GROUP BY event_type")
def q36_json_dotted_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter(F.get_json_object("props", "$.k").cast("int").between(10, 20)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value / 50 < 0.05 THEN 'still' WHEN value / 50 < 0.35 THEN 'slow' WHEN value / 50 < 1.5 THEN 'medium' ELSE 'fast' END AS speed FROM events")
def q37_motion_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", media.motion_speed(F.col("value") / 50).alias("speed"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(ltrim(t), '^[=+\\-@]') THEN '''' || t ELSE t END AS cell FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ' =' ELSE '' END || role AS t FROM conversations)")
def q38_votes_csv_escape(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, " =").otherwise(""), "role").alias("t"))
    return rows.select("conv_id", "turn", text.csv_cell(F.col("t")).alias("cell"))


@query("SELECT count(*) AS differences FROM ((SELECT p_partkey, p_size FROM part EXCEPT ALL SELECT p_partkey, p_size FROM part WHERE p_size < 49) UNION ALL (SELECT p_partkey, p_size FROM part WHERE p_size < 49 EXCEPT ALL SELECT p_partkey, p_size FROM part))")
def q39_equality(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select("p_partkey", "p_size")
    b = a.filter("p_size < 49")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("differences"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)(?:\\?|$)', 1) AS number, regexp_extract(url, '^[a-z]+://[^/]+(/[^?]*)?', 1) AS path FROM pages")
def q40_page_discovery(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", part(r"^[a-z]+://([^/]+)").alias("host"), part(r"([0-9]+)(?:\?|$)").alias("number"), part(r"^[a-z]+://[^/]+(/[^?]*)?").alias("path"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def q41_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_counts(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_QUEUE = """WITH RECURSIVE n AS (SELECT doc_id AS node, md5(text) AS print, source || ':' || n_chars AS family FROM documents),
  ids AS (SELECT node, 'p' || print AS i FROM n UNION ALL SELECT node, 'f' || family FROM n),
  e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM ids a JOIN ids b USING (i)),
  r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a),
  g AS (SELECT component, min(node) AS doc_id, count(*) AS n_members FROM c LEFT JOIN labels ON labels.doc_id = node GROUP BY component HAVING NOT bool_or(coalesce(toxic = 1, false)))
  SELECT doc_id, substr(sha256(component::VARCHAR), 1, 16) AS group_id, n_members, row_number() OVER (ORDER BY md5('42:' || component), component) AS rank FROM g QUALIFY rank <= 200"""


@query(_QUEUE)
def q32_annotation_queue(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("print"), F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("family"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return annotate.annotation_queue(rows, "doc_id", ["print", "family"], F.col("toxic") == 1, seed=42, limit=200)


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS k, p_size AS size, CAST(p_retailprice AS DOUBLE) AS price, list_sort(['brand:' || p_brand, 'type:' || p_type, 'size:' || CASE WHEN p_size <= 5 THEN 'short' WHEN p_size <= 15 THEN 'medium' ELSE 'long' END]) AS fs FROM part),
  g AS (SELECT 0 AS rank, -1::BIGINT AS k, 0 AS n_new, []::VARCHAR[] AS seen, []::BIGINT[] AS picked UNION ALL
    SELECT g.rank + 1, f.k::BIGINT, len(list_filter(fs, lambda x: NOT list_contains(seen, x)))::INTEGER, list_distinct(list_concat(seen, fs)), list_append(picked, f.k::BIGINT) FROM g, f WHERE g.rank < 40 AND NOT list_contains(picked, f.k)
    QUALIFY row_number() OVER (ORDER BY len(list_filter(fs, lambda x: NOT list_contains(seen, x))) DESC, size DESC, price DESC, f.k DESC) = 1)
  SELECT k AS p_partkey, rank, n_new FROM g WHERE rank > 0""")
def q33_diverse_subset(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    size = F.when(F.col("p_size") <= 5, "size:short").when(F.col("p_size") <= 15, "size:medium").otherwise("size:long")
    features = F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type"), size)
    return annotate.diverse_subset(part, "p_partkey", features, [F.col("p_size"), F.col("p_retailprice").cast("double")], 40)


@query("""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INTEGER)) AS spots FROM documents),
  b AS (SELECT doc_id, list_transform(range(64), lambda b: len(list_filter(spots, lambda x: x = b))) AS counts FROM t)
  SELECT doc_id, array_to_string(counts, ',') AS counts, round(coalesce(list_max(list_transform(counts, lambda c: c / nullif(sqrt(list_sum(list_transform(counts, lambda x: x * x))), 0))), 0), 6) AS peak FROM b""")
def q35_hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", text.bucket_counts(text.tokens(F.col("text"))).alias("counts"))
    return rows.select("doc_id", F.array_join("counts", ",").alias("counts"), F.round(F.array_max(text.unit_vector(rows["counts"])), 6).alias("peak"))


@query("""SELECT p_partkey, CASE WHEN n LIKE '%slow%' THEN 'slow' WHEN n LIKE '%fast%' OR n LIKE '%quick%' THEN 'fast' WHEN s >= 5 THEN 'slow' WHEN s > 0 AND s <= 1.5 THEN 'fast' ELSE 'medium' END AS speed,
  CASE WHEN n LIKE '%left%' THEN 'left' WHEN n LIKE '%right%' THEN 'right' WHEN n LIKE '%up%' THEN 'up' WHEN n LIKE '%down%' THEN 'down' WHEN n LIKE '%radial%' THEN 'radial' WHEN n LIKE '%expand%' THEN 'expanding' ELSE 'no_dominant' END AS direction,
  CASE WHEN n LIKE '%ring%' OR n LIKE '%wheel%' THEN 'turning' WHEN n LIKE '%bolt%' THEN 'fixed' ELSE 'unknown' END AS turn, CASE WHEN n LIKE '%ring%' OR n LIKE '%wheel%' OR n LIKE '%bolt%' THEN 0.25 ELSE 0.1 END::DOUBLE AS confidence
  FROM (SELECT p_partkey, lower(p_name) AS n, p_size / 5.0 AS s FROM part)""")
def q42_motion_facets(spark: SparkSession, sf: str) -> DataFrame:
    name, seconds = F.lower("p_name"), F.col("p_size") / 5.0
    turn = facets.keyword_facet(name, {"turning": ["ring", "wheel"], "fixed": ["bolt"]})
    return table(spark, sf, "part").select("p_partkey", facets.name_speed(name, seconds).alias("speed"), facets.name_direction(name).alias("direction"), turn["value"].alias("turn"), turn["confidence"].alias("confidence"))


@query("""SELECT p_partkey, translate(CASE WHEN p_type = 'ECONOMY' THEN 'element' ELSE lower(p_type) END, '_', ' ') || ' element inferred from ''' || p_name || ''', ' ||
  CASE WHEN p_partkey % 7 = 0 THEN 'unknown resolution' ELSE (p_size * 150) || 'x' || (p_size * 84) END || ', ' || format('{:.2f}s', p_size / 5.0::DOUBLE) || ', ' || CASE WHEN p_size > 25 THEN 'soft-alpha plate-ready' ELSE 'no verified alpha' END ||
  '. Fallback motion read: ' || CASE WHEN p_size % 2 = 0 THEN 'speed slow' ELSE 'motion not yet analysed' END || '.' AS caption FROM part""")
def q43_fallback_caption(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "ECONOMY", "unknown").otherwise(F.lower("p_type"))
    width = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 150)
    motion = F.create_map(F.lit("speed"), F.when(F.col("p_size") % 2 == 0, "slow").otherwise(""))
    caption = facets.fallback_caption(kind, F.col("p_name"), width, F.col("p_size") * 84, F.col("p_size") / F.lit(5.0), F.col("p_size") > 25, motion)
    return table(spark, sf, "part").select("p_partkey", caption.alias("caption"))


@query("SELECT conv_id, turn, accepted, score, n_candidates FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_candidates FROM (SELECT conv_id, turn, coalesce(role = 'assistant', false) AS accepted, CAST(length(coalesce(text, '')) AS BIGINT) AS score FROM conversations)) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY accepted DESC, score DESC, turn) = 1")
def q44_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("accepted"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("score"))
    return escalate.best_candidate(rows, "conv_id", "turn")


@query("""WITH r AS (SELECT p_partkey, p_size::DOUBLE AS d, coalesce(nullif((p_partkey % 20) / 100.0::DOUBLE, 0), 1.0) AS c, CAST(p_retailprice AS DOUBLE) / 1000 AS o, p_partkey % 5 AS n, p_partkey % 3 + 1 AS fps, (p_partkey % 10) / 10.0::DOUBLE AS conf FROM part)
  SELECT p_partkey, array_to_string(list_filter([CASE WHEN d >= 12 AND c <= 0.08 AND coalesce(nullif(o, 0), d) <= greatest(1.5, d * 0.12) THEN 'activity_focus:narrow_action_window' END, CASE WHEN d >= 12 AND n >= 3 AND fps <= 2 THEN 'activity_focus:multiple_brief_events' END], lambda x: x IS NOT NULL), ',') AS dense,
  CASE WHEN n = 0 THEN 'ultra_sampling:unparseable_dense_result' ELSE array_to_string(list_filter([CASE WHEN conf < 0.5 THEN 'ultra_sampling:very_low_dense_confidence' END, CASE WHEN conf + 0.2 < 0.6 THEN 'ultra_sampling:very_low_dense_completeness' END, CASE WHEN fps = 1 AND d >= 12 AND c <= 0.1 THEN 'ultra_sampling:short_action_missing_temporal_evidence' END], lambda x: x IS NOT NULL), ',') END AS ultra FROM r""")
def q45_escalation_reasons(spark: SparkSession, sf: str) -> DataFrame:
    key, seconds = F.col("p_partkey"), F.col("p_size").cast("double")
    covered, n, fps, sure = (key % 20) / F.lit(100.0), key % 5, key % 3 + 1, (key % 10) / F.lit(10.0)
    dense = escalate.sampling_reasons(seconds, covered, F.col("p_retailprice").cast("double") / 1000, n, fps)
    ultra = escalate.ultra_reasons(n != 0, sure, sure + 0.2, fps == 1, seconds, covered, threshold=0.7)
    return table(spark, sf, "part").select("p_partkey", F.array_join(dense, ",").alias("dense"), F.array_join(ultra, ",").alias("ultra"))


@query("WITH c AS (SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component, row_number() OVER (PARTITION BY text, doc_id % 2 ORDER BY doc_id) > 1 AS moved FROM documents) SELECT node, CASE WHEN moved THEN node ELSE min(node) FILTER (NOT moved) OVER (PARTITION BY component) END AS component FROM c")
def q46_separation(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("node"), F.md5("text").alias("print"))
    clusters = docs.join(docs.groupBy("print").agg(F.min("node").alias("component")), "print")
    return link.separate(clusters, docs.select((F.col("node") % 2).alias("list_no"), F.col("node").alias("pos"), "node"))


@query("""WITH s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
  f AS (SELECT user_id, count(value) AS pairs, quantile_cont(value, 0.5) / 50 AS magnitude, var_pop(value) AS variance, quantile_cont(step, 0.5) AS step, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM s GROUP BY user_id)
  SELECT user_id, pairs, round(magnitude, 6) AS magnitude, round(variance, 4) AS variance, round(step, 4) AS step, CASE WHEN b - a > 4 THEN 'building' WHEN b - a < -4 THEN 'dissipating' WHEN a IS NULL OR b IS NULL THEN 'steady' ELSE 'sustained' END AS arc,
  round(greatest(0.25, least(0.9, 0.25 + least(0.5, magnitude / 3) + least(0.15, pairs / 160))), 6) AS confidence FROM f""")
def q47_flow_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = facets.flow_summary(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", "value").withColumn("magnitude", F.col("magnitude") / 50)
    return f.select(
        "user_id", "pairs", F.round("magnitude", 6).alias("magnitude"), F.round("variance", 4).alias("variance"), F.round("step", 4).alias("step"),
        facets.brightness_arc(F.col("start"), F.col("end")).alias("arc"), F.round(facets.flow_confidence(F.col("magnitude"), F.col("pairs"), F.lit(0.0)), 6).alias("confidence"),
    )
