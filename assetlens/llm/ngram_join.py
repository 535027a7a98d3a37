"""N-gram Jaccard join by prefix filters under several global token orders.

Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z in lower case;
a document's set holds its distinct ``n``-word shingles (one for the whole sequence if it has fewer words). Two documents
link when 100 * intersection >= percent * union. Then, under any global order of the tokens, one of the first ``index``
tokens of the smaller set is among the first ``probe`` tokens of the larger, where these lengths leave too few tokens behind
them for the overlap that the threshold asks for.

Orders. A fixed share of the hash space is counted exactly over all documents; its tokens come before all others. A token
that only one set holds comes before all those, in every order, and is never sent on: most sets have so many that nothing
is left of their prefixes. Order 0 puts rare tokens first, the others put them by hashes of their own. A pair is a candidate
only if its prefixes meet under all ORDERS.

Groups. All members of a token's list under order 0 meet its hub, the member with the smallest share of tokens of its own; a
group of which many don't link to the hub gets a more central one and is measured again.
Let D be the symmetric difference of a set and its hub's. Two members of which D and D' have no more tokens together than
linked sets may differ in both link to the hub: if |D| + |D'| <= c (|x| + |y|) with c = (100 - percent) / (100 + percent) < 1,
then |y| <= |h| + |D'| gives |D| <= c (|x| + |h|). Any others that link must share tokens of D and D', so these are joined
by prefixes in their turn, those that are alone in the group first, and only where enough is left behind the token that
they meet in. Copies with edits of their own share few of them, so
neither the pairs of a group nor those of a list are ever emitted, and no link is lost. Candidates are verified on whole
sets, and only if they aren't in one component by then.

Whole sets are kept only for documents that have a prefix left, found in a second reading by a bitmap of BITMAP_A_KEY bits
for each, 2**MOST_BITS at most; when it fills up, more sets are built and dropped in the join behind it.

Edge cases: null text is empty; texts without words have an empty set, link with nothing and are their own component; rows
that share a doc_id are one document, whose links are those of all its rows, while n_shingles is each row's own; a null
doc_id links with nothing; repeated rows are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm.chunks import batches_of
from assetlens.llm.graph import components
from assetlens.llm.runtime import free_name, id_and_text, materialize, release, split_by_bitmap, tidy

ORDERS = 3
BATCH_BYTES = 8_000_000
BITMAP_A_KEY, MOST_BITS = 16, 28
CROWD = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xE7037ED1A0B428DB))


def mix(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * seed
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of its n-word shingles, sorted."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = split.flatten().dictionary_encode()
    own = pd.util.hash_array(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False), categorize=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes]  # white space at an end leaves an empty string
    counts = np.concatenate(([0], np.cumsum(real)))
    bounds = counts[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))]
    h = own[codes[real]]

    def rolled(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(max(0, len(x) - k + 1), k, np.uint64)
        for i in range(k):
            out = (out * _MUL) ^ (x[i:len(x) - k + 1 + i] + (out >> np.uint64(29)))
        return out * _MUL

    rows, out = rolled(h, n), []
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append(np.unique(rows[start:stop - n + 1]) if stop - start >= n else rolled(h[start:stop], stop - start) if stop > start else np.zeros(0, np.uint64))
    return out


def digest_of(tokens: np.ndarray) -> str:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def slots_of(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Slots by two rounds of mixing; after one, those of consecutive ids share slots far more often than by chance."""
    return mix(mix(keys.view(np.uint64), _SEEDS[1]), _SEEDS[0]) >> shift


class Bitmap:
    """Whether a 64-bit key may be among some; fixed bits for each key up to 2**MOST_BITS in all."""

    def __init__(self, keys: DataFrame):
        self.shift = shift = np.uint64(64 - min(MOST_BITS, max(16, int(keys.count() * BITMAP_A_KEY).bit_length())))

        def slots(frames):
            for frame in frames:
                slot = np.unique(slots_of(frame["key"].to_numpy(np.int64), shift))
                word, first = np.unique(slot >> np.uint64(6), return_index=True)
                yield pd.DataFrame({"word": word.astype(np.int64), "bits": np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first).view(np.int64) if len(word) else np.zeros(0, np.int64)})

        rows = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).filter("key IS NOT NULL").mapInPandas(tidy(slots), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
        self.words = np.zeros(1 << (58 - int(shift)), np.uint64)
        self.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = slots_of(keys.astype(np.int64), self.shift)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def sets_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, size, digest, tokens of the counted share, extra) of every document row.

    ``extra`` fills up the prefix of a set whose counted share is shorter: the other tokens that come first by their hash.
    """
    share = min(1.0, 2 * (100 - percent) / 100)
    edge = np.uint64(int(share * (1 << 63)) * 2 - (share == 1.0))

    def batches(frames):
        for frame in frames:
            for start, texts in batches_of(frame["text"], BATCH_BYTES):
                size, digest, tokens, extra = [], [], [], []
                for s in shingles(texts, n):
                    h = mix(s, _SEEDS[0])
                    counted, need = s[h <= edge], len(s) - -(-percent * len(s) // 100) + 1
                    rest = np.sort(h[h > edge])[:max(0, need - len(counted))] if len(s) else s  # the hash is one to one
                    size.append(len(s))
                    digest.append(digest_of(s) if len(s) else None)
                    tokens.append(counted.view(np.int64))
                    extra.append(rest.view(np.int64))
                yield pa.RecordBatch.from_arrays([frame["doc_id"].slice(start, len(texts)), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(tokens, pa.list_(pa.int64())), pa.array(extra, pa.list_(pa.int64()))], names=["doc_id", "size", "digest", "tokens", "extra"])

    return materialize(docs.mapInArrow(tidy(batches), "doc_id long, size long, digest string, tokens array<long>, extra array<long>"), "shingle-sets")


def only_tokens_of(wanted: Bitmap):
    """Rows of classes with no tokens but those that may be wanted, and the number of the others as ``alone``."""

    def batches(frames):
        for frame in frames:
            tokens = frame["tokens"]
            flat = tokens.flatten()
            ok = wanted.has(flat.to_numpy(zero_copy_only=False))
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(ok)))[np.concatenate(([0], np.cumsum(sizes)))]
            few = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.filter(pa.array(ok)))
            columns = [few if c == "tokens" else frame[c] for c in frame.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes - np.diff(bounds), pa.int64())], names=[*frame.schema.names, "alone"])

    return batches


def whole_sets(docs: DataFrame, open_nodes: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the open nodes, from a second reading of the texts."""
    wanted = Bitmap(open_nodes.select("doc_id"))

    def build(frames):
        for frame in frames:
            ids = frame["doc_id"]
            frame = frame.filter(pa.array(wanted.has(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)))
            for start, texts in batches_of(frame["text"], BATCH_BYTES):
                sets = shingles(texts, n)
                yield pa.RecordBatch.from_arrays([frame["doc_id"].slice(start, len(texts)), pa.array([digest_of(s) for s in sets], pa.string()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "digest", "tokens"])

    found = docs.mapInArrow(tidy(build), "doc_id long, digest string, tokens array<long>").join(open_nodes.select("doc_id", "digest", "node"), ["doc_id", "digest"])
    # A node has one doc_id and digest; grouped by these, the rows stay where the join has sent them.
    return materialize(found.groupBy("doc_id", "digest").agg(F.any_value("node").alias("node"), F.any_value("tokens").alias("tokens")).select("node", "tokens"), "whole-sets")


def _near(percent: int, a: str, b: str) -> str:
    """The sizes leave the threshold within reach."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def measured(pairs: DataFrame, sets: DataFrame, with_tokens: bool) -> DataFrame:
    """(a, b, differ, size_a, size_b, tokens) of pairs (a, b): the sizes of the symmetric difference of their sets and of these, and what is in it."""

    def measure(frames):
        for frame in frames:
            out = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(frame["x"], frame["y"])]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "differ": [len(d) for d in out], "size_a": [len(x) for x in frame["x"]], "size_b": [len(y) for y in frame["y"]], "tokens": out if with_tokens else None})

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(tidy(measure), "a long, b long, differ long, size_a long, size_b long, tokens array<long>")


def better_hubs(apart: DataFrame, linked: str) -> DataFrame:
    """(a, hub) of hubs a with over CROWD members that don't link to them: the member that has most in common with the group.

    What a hub differs in from most of its group stands in every difference and makes all members meet. It is told by
    some of the members, as any hub is right and a better one only makes fewer pairs: of the tokens in most differences
    a member's own difference has to hold as many, and few others.
    """
    crowd = apart.groupBy("a").agg(F.count_if(F.expr(f"NOT ({linked})")).alias("m")).filter(F.col("m") > CROWD)
    large = apart.join(crowd, "a").select("a", "b", "differ", "tokens", "m")
    asked = large.filter(f"pmod(xxhash64(b), cast(ceil(m / {2 * CROWD}) AS bigint)) = 0")
    votes = asked.select("a", F.explode("tokens").alias("token")).groupBy("a", "token").agg(F.count("*").alias("n"))
    common = votes.join(asked.groupBy("a").agg(F.count("*").alias("asked")), "a").filter("2 * n > asked").groupBy("a").agg(F.collect_list("token").alias("common"))
    best = large.join(common, "a").groupBy("a").agg(F.min(F.struct(F.expr("differ - 2 * size(array_intersect(tokens, common))").alias("score"), F.col("b").alias("hub"))).alias("best"))
    return best.filter("best.score < 0").select("a", "best.hub")  # the hub's own score is 0


def links_of(classes: DataFrame, body: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of nodes such that their components are those of all links between classes (node, doc_id, digest, size, tokens, extra).

    ``classes`` is a materialized table and is deleted.
    """
    probe = F.expr(f"size - cast(ceil({percent} * size / 100D) AS long) + 1")
    index = F.expr(f"size - cast(ceil(2 * {percent} * size / {100 + percent}D) AS long) + 1")

    # Tokens that one set holds are never stored nor sent to their node: a bitmap holds most of them back, the join the rest.
    twice = materialize(classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "token-counts")
    known = classes.mapInArrow(tidy(only_tokens_of(Bitmap(twice.select("token")))), classes.withColumn("alone", F.lit(0).cast("long")).schema)
    known = materialize(known.withColumn("most", probe - F.col("alone")).filter("most > 0").drop("most"), "open-classes")
    release(classes)
    shared = known.select("node", F.explode("tokens").alias("token")).join(twice, "token")
    by_hash = [F.expr(f"slice(transform(array_sort(transform(held, t -> struct(xxhash64(t.token, {r}) AS h, t.token AS token))), t -> t.token), 1, cast(probe AS int))") for r in range(1, ORDERS)]
    held = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("held"))  # one document's tokens at most
    orders = known.join(held, "node", "left").withColumn("held", F.coalesce("held", F.expr("cast(array() AS array<struct<n: bigint, token: bigint>>)")))
    orders = orders.withColumn("alone", F.expr("alone + size(tokens) - size(held)")).withColumn("probe", probe - F.col("alone")).filter("probe > 0")
    orders = orders.withColumn("index", index - F.col("alone")).withColumn("central", F.col("alone") / F.col("size"))
    first = [F.expr("slice(transform(held, t -> t.token), 1, cast(probe AS int))"), *by_hash]
    prefixes = orders.select("node", "doc_id", "digest", "size", "index", "central", *(F.concat(p, "extra").alias(f"t{r}") for r, p in enumerate(first)))
    prefixes = materialize(prefixes.filter("size(t0) > 0"), "prefixes")
    release(twice, known)

    lists = prefixes.select("node", "central", F.explode("t0").alias("token"))
    hubs = lists.groupBy("token").agg(F.min(F.struct("central", "node")).alias("hub"), F.count("*").alias("n")).filter("n > 1").select("token", F.col("hub.node").alias("hub"))
    stars = lists.join(hubs, "token").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(stars, "stars")
    touched = materialize(prefixes.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "touched")
    sets = whole_sets(body, touched, n)
    apart = materialize(measured(stars, sets, True), "differences")
    linked = f"{100 + percent} * differ <= {100 - percent} * (size_a + size_b)"
    star_links = apart.filter(linked)
    moved = materialize(better_hubs(apart, linked), "better-hubs")
    again = None
    if not moved.isEmpty():
        stays = apart.join(moved, "a", "left_anti")
        pairs = apart.select("a", "b").unionByName(moved.select("a", F.col("a").alias("b"))).join(moved, "a").filter("hub <> b").select(F.col("hub").alias("a"), "b").distinct()
        again = materialize(measured(pairs.join(stays.select("a", "b"), ["a", "b"], "left_anti"), sets, True), "differences-again")
        star_links = star_links.unionByName(again.filter(linked))
    groups = apart if again is None else stays.unionByName(again)
    star_links = materialize(star_links.select("a", "b"), "star-links")
    star_parts = components(star_links)

    # Members b of the groups of hubs a that lie in more than one component, and what they differ from the hub in.
    placed = groups.join(star_parts.select(F.col("node").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", -1 - F.col("b")))
    spread = placed.groupBy(F.col("a").alias("group")).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("group")
    members = materialize(placed.withColumnRenamed("a", "group").join(spread, "group").select("group", "b", "differ", "component", F.col("size_b").alias("size"), "tokens"), "members")
    most = f"cast(floor({100 - percent} * (size + floor(size * 100 / {percent}D)) / {100 + percent}D) AS long)"  # what a link may differ in
    placed = members.withColumn("most", F.expr(most))
    counted = placed.select("group", "b", "component", F.explode("tokens").alias("token")).groupBy("group", "token").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("b").alias("b"))
    counted = materialize(counted, "difference-counts")
    # Tokens whose holders lie in one component link nothing anew and come first; a member with enough of its own is done.
    alone = counted.filter("n = 1").groupBy("group", "b").agg(F.count("*").alias("alone"))
    busy = materialize(placed.join(alone, ["group", "b"], "left").filter("coalesce(alone, 0) <= most").drop("alone"), "busy-members")
    often = counted.filter("low < high").select("group", "token", "n")
    kept = busy.select("group", "b", F.explode("tokens").alias("token")).join(often, ["group", "token"]).groupBy("group", "b").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("kept"))
    kept = busy.drop("tokens").join(kept, ["group", "b"]).withColumn("before", F.expr("differ - size(kept)"))
    kept = kept.select("*", F.posexplode("kept").alias("at", "held")).filter("before + at <= most").select("group", "b", "differ", "component", "size", F.col("held.token").alias("token"), F.expr("before + at <= most div 2").alias("indexed"), F.expr("size(kept) - at").alias("left"))
    kept = materialize(kept, "difference-prefixes")
    x, y = kept.filter("indexed").alias("x"), kept.alias("y")
    # At the first token that two differences share, no more of them is shared than either has left there.
    reach = f"{100 + percent} * (x.differ + y.differ - 2 * least(x.left, y.left)) <= {100 - percent} * (x.size + y.size)"
    meets = x.join(y, F.expr("x.group = y.group AND x.token = y.token AND x.component <> y.component AND (x.differ < y.differ OR x.differ = y.differ AND x.b < y.b) AND " + _near(percent, "x.size", "y.size") + " AND " + reach))
    pairs = meets.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    # The other orders: the smaller set's index prefix has to meet the larger one's prefix.
    arrays = prefixes.select("node", "size", "index", *(f"t{r}" for r in range(1, ORDERS)))
    both = pairs.join(arrays.alias("p"), F.col("a") == F.col("p.node")).join(arrays.alias("q"), F.col("b") == F.col("q.node"))
    small, large = (f"CASE WHEN (p.size, p.node) {sign} (q.size, q.node) THEN p.%s ELSE q.%s END" for sign in ("<", ">"))
    meet = " AND ".join(f"arrays_overlap(slice({small % (t, t)}, 1, greatest(0, cast({small % ('index', 'index')} AS int))), {large % (t, t)})" for t in (f"t{r}" for r in range(1, ORDERS)))
    candidates = materialize(both.filter(F.expr(meet)).select("a", "b"), "candidates")
    more = measured(candidates, sets, False).filter(linked).select("a", "b")
    links = materialize(star_links.unionByName(more), "links")
    release(prefixes, stars, touched, sets, apart, moved, *([again] if again else []), star_links, members, counted, busy, kept, candidates)
    return links


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), one row for each document row."""
    if Fraction(percent) <= 0 or percent > 100:
        raise ValueError("percent must lie in (0, 100]")
    body = id_and_text(docs)
    sets = sets_table(body, n, percent)
    known = sets.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"), F.any_value("tokens").alias("tokens"), F.any_value("extra").alias("extra"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    names = materialize(classes.select("node", "doc_id", "digest"), "names")
    wide, sets = sets, materialize(sets.select("doc_id", "size", "digest"), "sizes")
    release(wide)
    links = links_of(classes, body, n, percent)
    # Documents of several rows with different sets join the classes of these.
    several = sets.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("one"), F.countDistinct(F.coalesce("digest", F.lit(""))).alias("n")).filter("n > 1").select("doc_id", "one")
    several = materialize(several.join(sets.select("doc_id", "digest"), "doc_id").filter("digest IS NOT NULL").distinct(), "several")
    node_of = names.select("digest", "node")
    joined = several.join(node_of, "digest").select("one", F.col("node").alias("a")).join(node_of.select(F.col("digest").alias("one"), F.col("node").alias("b")), "one").select("a", "b")
    parts = materialize(components(links.unionByName(joined)), "parts")
    least = names.join(parts, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    least = parts.join(least, "component").select("node", "component_id")
    named = materialize(names.join(least, "node", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    by_doc = several.join(named, "digest").groupBy("doc_id").agg(F.min("component_id").alias("by_doc"))
    out = sets.select("doc_id", "size", "digest").join(named, "digest", "left").join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("by_doc", "component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, but of each component only the one with the least doc_id.

    Of rows that share a doc_id the one with the least text stays; rows without a doc_id stay. Only rows that may be
    dropped are shuffled. Columns of any name are left alone.
    """
    found = materialize(near_duplicates(docs, n, percent), "components")
    own = F.col("doc_id") == F.col("component_id")
    touched = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(own).alias("stays")).filter("n > 1 OR NOT stays")
    id_name, stays, row = (free_name(x, docs.columns) for x in ("id", "stays", "row"))
    touched = materialize(touched.select(F.col("doc_id").alias(id_name), F.col("stays").alias(stays)), "dropped")
    some, rest = split_by_bitmap(docs, F.col("doc_id"), Bitmap(touched.select(id_name)).has)
    some = some.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    some = some.join(touched, F.col("doc_id") == F.col(id_name), "left").filter(f"`{id_name}` IS NULL OR (`{stays}` AND `{row}` = 1)")
    return rest.unionByName(some.select(*(f"`{c}`" for c in docs.columns)))
