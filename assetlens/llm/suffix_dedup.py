"""Exact removal of repeated byte strings by distributed difference-cover naming over a locally consistent parse.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.

1. Parse. Of every WINDOW neighbouring positions the one whose 8 bytes hash least (the last of equals) is an anchor, so
   equal strings of ``length`` bytes hold the same first anchor at the same place. Anchors cut a text into phrases.
   Only anchors whose next length - WINDOW + 1 bytes occur twice in the corpus can belong to a repeat; a Bloom filter of
   fixed size tells which, and a text's names of such anchors are a string to be sorted (the last phrase of a run is as long as a string, so nothing
   behind it matters). Equal texts are one string.
2. Difference cover. Positions 1 and 2 mod 3 of a string are sampled; their triples of phrase names are sorted, named in that
   order, and the names are the strings of the next level, until a name stands for ``length`` bytes. The suffixes at
   position 0 mod 3 are joined to classes by (name, class of the next sampled suffix) or (two names, class of the one after),
   whichever the other suffix shares.
3. Neighbours. Suffixes of one class that also agree on what stands before the anchor share all their strings, which are
   resolved at once; only for one of them, and for suffixes that stand alone, the strings that start before the anchor are
   told apart further. BLOCK distances to the anchor make a block. Strings of a block repeat at once if all bytes that they
   cover occur twice, and none does if the bytes that they share occur once; equal strings stand at equal distances. Only
   in blocks with equal shared and different covered bytes, one for each of these, are ``length``-byte prefixes hashed and
   grouped one by one. A prefix that occurs twice is a repeat. No suffix order is made.

Text is shuffled only for texts that hold a possible repeat. Hashes are 64 bits for classes and 128 for prefixes. What stands
in very many places is counted where it is read and joined by broadcast, so its places never meet in one task.

Edge cases: null text is empty; texts shorter than ``length`` keep all bytes; repeated rows are equal texts and lose every
byte if they are long enough; null and repeated doc_ids are kept as they are, since texts are told apart by content; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm.runtime import free_name, id_and_text, materialize, release, split_by_bitmap, tidy

LENGTH = 400
WINDOW = 128
BLOCK = 16
BLOCKS = "run long, low int, high int, core long, u1 long, u2 long"
HOT = 1000
BLOOM_BITS = 25
PROBES = 4
SLICE = 1 << 18
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_RANDOM = np.random.default_rng(20240917)
_BYTES1, _BYTES2 = (_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_SPACES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Powers:
    """Powers of the bases and of their inverses, extended as longer slices come."""

    def __init__(self):
        self.n, self.up, self.down = 0, [], []

    def get(self, n: int):
        if n > self.n:
            self.n = max(n, SLICE + 1024)
            self.up, self.down = [], []
            for b in (_B1, _B2):
                for into, base in ((self.up, b), (self.down, pow(b, -1, 1 << 64))):
                    p = np.full(self.n, base, np.uint64)
                    p[0] = 1
                    into.append(np.multiply.accumulate(p))
        return self.up, self.down


_POWERS = Powers()


class Text:
    """Bytes of one or several texts with hashes of any substring in constant time."""

    def __init__(self, data: bytes, second: bool = False):
        self.raw = np.frombuffer(data, np.uint8)
        n = len(self.raw)
        up, self.down = _POWERS.get(n + 1)
        self.sums = []
        for table, powers in ((_BYTES1, up[0]), (_BYTES2, up[1]))[:1 + second]:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(table.take(self.raw) * powers[:n], out=s[1:])
            self.sums.append(s)

    def hash(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        h = (s.take(end) - s.take(start)) * self.down[which].take(start)
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def anchors(self, starts: np.ndarray, ends: np.ndarray, length: int):
        """(anchor, first and last string start that it serves, text number) for string starts within texts."""
        n = len(self.raw)
        g = self.raw.astype(np.uint32) + np.uint32(1)
        for width in (1, 2, 4):
            g = g[:-width] * np.uint32(pow(0x9E3779B1, width, 1 << 32)) + g[width:]
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        m = (g.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(g), dtype=np.uint64))
        width = 1
        while width < WINDOW:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        at = (np.uint64(0xFFFFFFFF) - (m & np.uint64(0xFFFFFFFF))).astype(np.int64)
        counts = np.maximum(ends - starts - length + 1, 0)
        p = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        owner = np.repeat(np.arange(len(starts)), counts)
        a = at[p]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1 if len(a) else first
        return a[first], p[first], p[last], owner[first]


def slices(texts: list[bytes], length: int):
    """Numbers and joined bytes of texts that can hold a string, in slices of bounded size (a longer text is one)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= length:
            if group and size + len(t) > SLICE:
                yield group
                group, size = [], 0
            group.append(i)
            size += len(t)
    if group:
        yield group


def _joined(texts: list[bytes], group: list[int], second: bool = False):
    sizes = np.array([len(texts[i]) for i in group])
    ends = np.cumsum(sizes)
    return Text(b"".join(texts[i] for i in group), second), ends - sizes, ends


def _probes(h: np.ndarray) -> np.ndarray:
    """Slots of a hash in the Bloom filter, one row for each probe."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step * np.uint64(_B1)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for i in range(PROBES)])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end, parted by what Unicode calls white space."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACES.take(np.frombuffer(data, np.uint8))
    for m in () if data.isascii() else _WIDE_SPACES.finditer(data):
        space[m.start() + 1:m.end() + 1] = True
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def _utf8(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column]


def repeated_heads(body: DataFrame, length: int) -> np.ndarray:
    """Bloom filter of the hashes of anchor heads that occur twice; its words, fixed in number, come to the driver."""
    size = length - WINDOW + 1

    def heads(frames):
        for frame in frames:
            texts, out = _utf8(frame["text"]), []
            for group in slices(texts, length):
                t, starts, ends = _joined(texts, group)
                a, _, _, _ = t.anchors(starts, ends, length)
                out.append(t.hash(a, a + size).view(np.int64))
            yield pd.DataFrame({"head": np.concatenate(out) if out else np.zeros(0, np.int64)})

    def probe(frames):
        for frame in frames:
            slot = np.unique(_probes(frame["head"].to_numpy(np.int64).view(np.uint64)))
            yield pd.DataFrame({"slot": slot})

    twice = body.select("text").mapInPandas(tidy(heads), "head long").groupBy("head").count().filter("count > 1").select("head")
    words = twice.mapInPandas(tidy(probe), "slot long").groupBy(F.expr("slot >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toArrow()
    bloom = np.zeros((1 << BLOOM_BITS) // 64, np.int64)
    bloom[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bloom


def _among(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for slot in _probes(h):
        ok &= (bloom[slot >> 6] >> (slot & 63)) & 1 == 1
    return ok


PARSED = "tid string, raw binary, anchors array<int>, lows array<int>, highs array<int>, heads array<long>, lefts array<long>, names array<long>, covers array<int>"


def parse(body: DataFrame, bloom: np.ndarray, length: int) -> DataFrame:
    """A row for each document with candidate anchors: raw bytes and arrays over these anchors."""
    size = length - WINDOW + 1

    def batches(frames):
        for frame in frames:
            texts, rows = _utf8(frame["text"]), []
            for group in slices(texts, length):
                t, starts, ends = _joined(texts, group)
                a, low, high, owner = t.anchors(starts, ends, length)
                head = t.hash(a, a + size)
                ok = np.flatnonzero(_among(bloom, head))
                if not len(ok):
                    continue
                follows = np.zeros(len(ok), bool)  # the next anchor of the same text is a candidate too
                follows[:-1] = (ok[1:] == ok[:-1] + 1) & (owner[ok[1:]] == owner[ok[:-1]])
                a, low, high, owner, head = a[ok], low[ok], high[ok], owner[ok], head[ok]
                stop = np.minimum(a + length, ends[owner])
                stop[:-1] = np.where(follows[:-1], a[1:], stop[:-1])
                name = t.hash(a, stop) + (stop - a).astype(np.uint64)
                left = t.hash(low, a) + (a - low).astype(np.uint64) * np.uint64(_B2) + (high - low).astype(np.uint64)
                edge = np.searchsorted(owner, np.arange(len(group) + 1))
                for k, i in enumerate(group):
                    s = slice(edge[k], edge[k + 1])
                    if edge[k] < edge[k + 1]:
                        o = starts[k]
                        rows.append((hashlib.sha256(texts[i]).hexdigest(), texts[i], a[s] - o, low[s] - o, high[s] - o, head[s].view(np.int64), left[s].view(np.int64), name[s].view(np.int64), (stop - a)[s]))
            if rows:
                yield pd.DataFrame(rows, columns=PARSED.replace(",", "").split()[0::2])

    return materialize(body.select("text").mapInPandas(tidy(batches), PARSED), "parsed")


def sorted_names(triples: DataFrame) -> DataFrame:
    """Distinct triples with names that ascend in their order: a range sort and one number for each row."""
    names = triples.select("s0", "s1", "s2").distinct()
    ordered = names.repartitionByRange("s0", "s1", "s2").sortWithinPartitions("s0", "s1", "s2")
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def suffix_classes(strings: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(run, half, pos, cls): suffixes of one class agree on ``length`` covered bytes or to the end of their strings.

    ``strings`` is a materialized table (run, half, pos, sym, cover) and is deleted. A triple stops at the name with
    which it covers ``length`` bytes. A level recurses on two thirds of the positions, as two strings for each one
    (``half`` gets a bit for each level), and its names cover three of the level before.
    """
    at = Window.partitionBy("run", "half").orderBy("pos")
    rows = strings.select("run", "half", "pos", "cover", F.col("sym").alias("s0"), F.lead("sym", 1).over(at).alias("n1"), F.lead("sym", 2).over(at).alias("n2"), F.lead("cover", 1).over(at).alias("c1"), F.lead("cover", 2).over(at).alias("c2"))
    one, two = F.col("cover") < length, F.col("cover") + F.col("c1") < length
    rows = rows.select(
        "run", "half", "pos", "s0", "n1", F.when(one, F.col("n1")).alias("s1"), F.when(one & two, F.col("n2")).alias("s2"),
        (F.col("cover") + F.when(one, F.coalesce("c1", F.lit(0))).otherwise(0) + F.when(one & two, F.coalesce("c2", F.lit(0))).otherwise(0)).cast("int").alias("covers"), F.col("cover"),
    )
    rows = materialize(rows, "triples")
    release(strings)
    if rows.filter((F.col("cover") < length) & F.col("n1").isNotNull()).isEmpty():
        return rows.select("run", "half", "pos", F.col("s0").alias("cls"))
    sample = rows.filter("pos % 3 <> 0")
    names = sorted_names(sample)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = sample.alias("x").join(names.alias("n"), same("x.s0", "n.s0") & same("x.s1", "n.s1") & same("x.s2", "n.s2")).select(
        "x.run", F.expr("x.half * 2 + (x.pos % 3) - 1").cast("int").alias("half"), F.expr("cast(x.pos div 3 AS int)").alias("pos"), F.col("n.name").alias("sym"), F.col("x.covers").alias("cover"),
    )
    named = materialize(named, "strings")
    release(names)
    deep = suffix_classes(named, length, level + 1)
    found = deep.select("run", F.expr("cast(half div 2 AS int)").alias("half"), F.expr("cast(pos * 3 + half % 2 + 1 AS int)").alias("pos"), "cls")
    # The class of the next sampled suffix and of the one after it stand beside each suffix.
    none = F.lit(None)
    both = rows.select("run", "half", "pos", "s0", F.col("n1").alias("s1"), none.cast("long").alias("cls")).unionByName(found.select("run", "half", "pos", none.cast("long").alias("s0"), none.cast("long").alias("s1"), "cls"))
    both = both.groupBy("run", "half", "pos").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"), F.max("cls").alias("cls"))
    look = materialize(both.select("*", F.lead("cls", 1).over(at).alias("k1"), F.lead("cls", 2).over(at).alias("k2")), "ranks")
    release(rows)
    first = look.filter("pos % 3 = 1").groupBy("s0", "k1").agg(F.min("cls").alias("cls1"))
    second = look.filter("pos % 3 = 2").groupBy("s0", "s1", "k2").agg(F.min("cls").alias("cls2"))
    rest = look.filter("pos % 3 = 0").drop("cls").alias("r")
    rest = rest.join(first.alias("o"), same("r.s0", "o.s0") & same("r.k1", "o.k1"), "left").join(second.alias("t"), same("r.s0", "t.s0") & same("r.s1", "t.s1") & same("r.k2", "t.k2"), "left")
    # Names of different levels are numbers of different things, so the level is part of a class's own number.
    own = -F.abs(F.xxhash64(F.lit(level), "r.s0", F.coalesce("r.k1", F.lit(-(1 << 63))))) - 1
    rest = rest.select("r.run", "r.half", "r.pos", F.coalesce("cls1", "cls2", own).alias("cls"))
    out = materialize(look.filter("pos % 3 <> 0").select("run", "half", "pos", "cls").unionByName(rest), "classes")
    release(look)
    return out


def _ranges(frame_ranges) -> np.ndarray:
    return np.array([(r["low"], r["high"]) for r in frame_ranges], np.int64).reshape(-1, 2) if frame_ranges is not None else np.zeros((0, 2), np.int64)


def covered(n: int, starts: np.ndarray, ranges: np.ndarray, length: int) -> np.ndarray:
    """Which bytes the strings at single starts and at ranges of starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.concatenate((starts, ranges[:, 0])), 1)
    np.add.at(edge, np.concatenate((starts + length, ranges[:, 1] + length)), -1)
    return np.cumsum(edge[:-1]) > 0


def block_rows(frames, length: int):
    """Rows of BLOCKS for texts (run, raw, open): the starts low to high of a span whose distances to the anchor share a block.

    ``core`` is a hash of the bytes that all strings of a block have in common, wherever the span is cut off, u1 and u2
    are hashes of all bytes that the strings of the row cover.
    """
    for frame in frames:
        out = []
        for run, raw, open_ in zip(frame["run"], frame["raw"], frame["open"]):
            t = Text(raw, second=True)
            spans = np.array([(r["low"], r["high"], r["anchor"]) for r in open_], np.int64)
            k, last = (spans[:, 2] - spans[:, 1]) // BLOCK, (spans[:, 2] - spans[:, 0]) // BLOCK
            n = last - k + 1
            of = np.repeat(np.arange(len(n)), n)
            first = spans[of, 2] - BLOCK * (np.repeat(k - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            low, high = np.maximum(spans[of, 0], first - BLOCK + 1), np.minimum(spans[of, 1], first)
            core = t.hash(first, first + length - BLOCK + 1)
            out.append(pd.DataFrame({"run": run, "low": low.astype(np.int32), "high": high.astype(np.int32), "core": core.view(np.int64), "u1": t.hash(low, high + length).view(np.int64), "u2": t.hash(low, high + length, 1).view(np.int64)}))
        if out:
            yield pd.concat(out)


def prefix_rows(frames, length: int):
    """(run, start, h1, h2) of each string that starts in the open ranges of texts (run, raw, open)."""
    for frame in frames:
        out = []
        for run, raw, open_ in zip(frame["run"], frame["raw"], frame["open"]):
            t, spans = Text(raw, second=True), _ranges(open_)
            n = spans[:, 1] - spans[:, 0] + 1
            p = np.repeat(spans[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(pd.DataFrame({"run": run, "start": p.astype(np.int32), "h1": t.hash(p, p + length).view(np.int64), "h2": t.hash(p, p + length, 1).view(np.int64)}))
        if out:
            yield pd.concat(out)


def among(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """The rows whose key is one of ``groups`` (key, n rows of it). Rows of keys with over HOT of them stay where they are."""
    hot = F.broadcast(groups.filter(F.col("n") > HOT).select(key))
    few = rows.join(hot, key, "left_anti").join(groups.filter(F.col("n") <= HOT).select(key), key, "left_semi")
    return rows.join(hot, key, "left_semi").unionByName(few)


def spans_by_run(ranked: DataFrame) -> DataFrame:
    """(run, done, open) for suffixes (run, copies, anchors, lows, highs, heads, context): spans of starts that repeat, and those to be told apart.

    Repeated are those of contexts that occur twice. One suffix of each context stays open where its head has other contexts.
    """
    one = F.struct("run", "lows", "highs", "anchors", "heads")
    contexts = ranked.groupBy("context").agg(F.sum("copies").alias("twins"), F.count("*").alias("n"), F.min(one).alias("one"))
    contexts = materialize(contexts.select("context", "twins", "n", "one.run", F.col("one.lows").alias("low"), F.col("one.highs").alias("high"), F.col("one.anchors").alias("anchor"), "one.heads"), "contexts")
    mixed = materialize(contexts.groupBy("heads").agg(F.count("*").alias("n")).filter("n > 1"), "mixed")
    done = among(ranked.select("run", "context", F.col("lows").alias("low"), F.col("highs").alias("high")), "context", contexts.filter("twins > 1").select("context", "n"))
    open_ = among(contexts.drop("n"), "heads", mixed)
    both = done.select("run", "low", "high", F.lit(None).cast("int").alias("anchor")).unionByName(open_.select("run", "low", "high", "anchor"))
    return both.groupBy("run").agg(
        F.collect_list(F.when(F.col("anchor").isNull(), F.struct("low", "high"))).alias("done"),
        F.collect_list(F.when(F.col("anchor").isNotNull(), F.struct("low", "high", "anchor"))).alias("open"),
    )


def repeated_strings(docs: DataFrame, length: int = LENGTH, spans: bool = False) -> DataFrame:
    """For texts that lose bytes: the digest ``tid``, copies, n_removed, n_spans, kept_sha256 and the text that is kept.

    With ``spans``, tid and the removed bytes as (starts, ends) instead. A materialized table.
    """
    if length < 2 * WINDOW:
        raise ValueError(f"a string has {2 * WINDOW} bytes at least")
    body = id_and_text(docs)
    parsed = parse(body, repeated_heads(body, length), length)
    held = ("raw", "anchors", "lows", "highs", "heads", "lefts", "names", "covers")
    texts = parsed.groupBy("tid").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in held))
    texts = materialize(texts.withColumn("run", F.monotonically_increasing_id()), "texts")
    release(parsed)
    cells = texts.select("run", "copies", F.posexplode(F.arrays_zip("anchors", "lows", "highs", "heads", "lefts", "names", "covers")).alias("pos", "z"))
    cells = materialize(cells.select("run", "pos", "copies", "z.anchors", "z.lows", "z.highs", "z.heads", "z.lefts", "z.names", "z.covers"), "suffixes")
    strings = materialize(cells.select("run", F.lit(1).alias("half"), "pos", F.col("names").alias("sym"), F.col("covers").alias("cover")), "strings")
    classes = suffix_classes(strings, length)
    ranked = cells.drop("names", "covers").join(classes.drop("half"), ["run", "pos"])
    # The class and what stands before the anchor, as one number.
    ranked = materialize(ranked.select("run", "copies", "anchors", "lows", "highs", "heads", F.xxhash64("cls", "lefts", "heads").alias("context")), "ranked")
    release(cells)
    state = materialize(texts.select("run", "tid", "raw", "copies").join(spans_by_run(ranked), "run"), "states")
    release(texts, ranked)
    open_texts = state.filter("size(open) > 0").select("run", "raw", "open")
    blocks = materialize(open_texts.mapInPandas(tidy(lambda frames: block_rows(frames, length)), BLOCKS), "blocks")
    unions = blocks.groupBy("core", "u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct("run", "low", "high")).alias("one"))
    unions = materialize(unions, "unions")
    twice = blocks.join(unions.filter("n > 1").select("core", "u1", "u2"), ["core", "u1", "u2"])
    settled = twice.groupBy("run").agg(F.collect_list(F.struct("low", "high")).alias("settled"))
    differ = unions.groupBy("core").count().filter("count > 1").select("core")
    rest = unions.join(differ, "core").groupBy("one.run").agg(F.collect_list(F.struct("one.low", "one.high")).alias("open"))
    windows = state.select("run", "raw").join(rest, "run").mapInPandas(tidy(lambda frames: prefix_rows(frames, length)), "run long, start int, h1 long, h2 long")
    equal = Window.partitionBy("h1", "h2")
    hits = windows.withColumn("n", F.count("*").over(equal)).filter("n > 1").groupBy("run").agg(F.collect_list("start").alias("starts"))
    joined = state.drop("open").join(settled, "run", "left").join(hits, "run", "left")
    no_range = F.expr("cast(array() AS array<struct<low: int, high: int>>)")
    joined = joined.withColumn("done", F.concat(F.col("done").cast("array<struct<low: int, high: int>>"), F.coalesce("settled", no_range)))
    joined = joined.filter("copies > 1 OR size(done) > 0 OR starts IS NOT NULL")

    def cut(frames):
        for frame in frames:
            out = []
            for tid, raw, copies, done, starts in zip(frame["tid"], frame["raw"], frame["copies"], frame["done"], frame["starts"]):
                mask = np.ones(len(raw), bool) if copies > 1 else covered(len(raw), np.array(starts if starts is not None else [], np.int64), _ranges(done), length)
                if spans:
                    step = np.diff(mask.view(np.int8), prepend=0, append=0)
                    out.append((tid, np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
                    continue
                runs = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                out.append((tid, copies, int(mask.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=schema.replace(",", "").split()[0::2])

    schema = "tid string, starts array<long>, ends array<long>" if spans else "tid string, copies long, n_removed long, n_spans long, kept_sha256 string, kept string"
    lost = materialize(joined.select("tid", "raw", "copies", "done", "starts").mapInPandas(tidy(cut), schema), "lost")
    release(state, blocks, unions)
    return lost


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    The digest is that of the kept bytes. In ``text``, what is kept of the document, a character of which a byte is removed
    goes as a whole. Documents that surely lose nothing are not shuffled, nor are those of a text with over HOT copies.
    """
    from assetlens.llm.ngram_join import Bitmap

    lost = repeated_strings(docs, length)
    has = Bitmap(lost.select(F.xxhash64("tid"))).has

    @F.pandas_udf("boolean")
    def may_lose(keys: pd.Series) -> pd.Series:
        return pd.Series(has(keys.to_numpy(np.int64)))

    read = id_and_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("tid"), "text")
    every = read.join(F.broadcast(lost.filter(F.col("copies") > HOT)), "tid", "left")
    settled = F.col("copies").isNotNull() | ~may_lose(F.xxhash64("tid"))
    rest = every.filter(~settled).select(*read.columns).join(lost.filter(F.col("copies") <= HOT), "tid", "left")
    return every.filter(settled).unionByName(rest).select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "tid").alias("kept_sha256"), F.coalesce("kept", "text").alias("text"),
    )


def short_passages(docs: DataFrame, length: int, words: int) -> DataFrame:
    """(tid, starts, ends) of all runs of ``words`` whole words and under ``length`` bytes that occur twice, byte for byte.

    Longer runs that occur twice hold a repeated string of ``length`` bytes at each place. Words are parted by white space.
    """

    def runs(frames):
        for frame in frames:
            texts, out = _utf8(frame["text"]), []
            for group in slices(texts, 2 * words - 1):
                sizes = np.array([len(texts[i]) + 1 for i in group])
                data = b"\n".join(texts[i] for i in group)
                begins = np.cumsum(sizes) - sizes
                start, end = word_bounds(data)
                n = max(0, len(start) - words + 1)
                start, end = start[:n], end[words - 1:]
                short = end - start < length
                start, end = start[short], end[short]
                owner = np.searchsorted(begins, start, side="right") - 1
                inside = end <= begins[owner] + sizes[owner]
                start, end, owner = start[inside], end[inside], owner[inside]
                if len(start):
                    t = Text(data, second=True)
                    tids = {k: hashlib.sha256(texts[group[k]]).hexdigest() for k in np.unique(owner).tolist()}
                    out.append(pd.DataFrame({"tid": [tids[k] for k in owner.tolist()], "start": start - begins[owner], "end": end - begins[owner], "h1": t.hash(start, end).view(np.int64), "h2": t.hash(start, end, 1).view(np.int64)}))
            if out:
                yield pd.concat(out)

    found = materialize(id_and_text(docs).select("text").mapInPandas(tidy(runs), "tid string, start long, end long, h1 long, h2 long"), "short-passages")
    twice = found.groupBy("h1", "h2").count().filter("count > 1").drop("count")
    hits = found.join(twice, ["h1", "h2"]).select("tid", "start", "end").distinct()
    return hits.groupBy("tid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The documents with all their columns and without their repeated strings; n_chars, where there is one, follows the text.

    With ``words``, repeated runs of so many words go too where they have fewer than ``length`` bytes. A character of which
    a byte is removed goes as a whole. Documents that lose bytes and keep nothing but white space go. Only documents that
    may lose bytes are shuffled.
    """
    import pyarrow as pa

    from assetlens.llm.ngram_join import Bitmap

    found = lost = repeated_strings(docs, length, spans=True)
    if words:
        both = lost.unionByName(short_passages(docs, length, words))
        lost = both.groupBy("tid").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    key_name, tid_name, starts_name, ends_name = (free_name(x, docs.columns) for x in ("key", "tid", "starts", "ends"))
    lost = materialize(lost.withColumnsRenamed({"tid": tid_name, "starts": starts_name, "ends": ends_name}), "cut-spans")
    release(found)

    def cut(arrow):
        for batch in arrow:
            kept = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", starts_name, ends_name))):
                if starts is not None:
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    edge = np.bincount(starts, minlength=len(raw) + 1) - np.bincount(ends, minlength=len(raw) + 1)
                    text = raw[np.cumsum(edge[:-1]) == 0].tobytes().decode("utf-8", "ignore")
                kept.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(kept, pa.string())).drop_columns([starts_name, ends_name])

    tid = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    some, rest = split_by_bitmap(docs, F.xxhash64(tid), Bitmap(lost.select(F.xxhash64(tid_name))).has)
    some = some.withColumn(key_name, tid).join(lost, F.col(key_name) == F.col(tid_name), "left").drop(key_name)
    some = some.mapInArrow(tidy(cut), some.drop(starts_name, ends_name).schema).filter(F.col(tid_name).isNull() | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col(tid_name).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rest.unionByName(some.select(*docs.columns))
