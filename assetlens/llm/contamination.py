"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are lower-cased and their white space is collapsed. An item is covered by windows of at most
WINDOW characters, half overlapping, each with an edit budget k of ERRORS of its length, and if it is longer than SHORT
by windows of SHORT characters at each STRIDE characters, so a verbatim quotation of SHORT + STRIDE - 1 characters holds one
whole wherever it starts. By the q-gram lemma a text region
within k edits of a window of m characters shares at least m - q + 1 - k q of its q-grams, all within k neighbouring
diagonals (text position minus window position). So hits are counted in diagonal bands of twice BAND, each overlapping
half of the next (BAND > k): a region is retained where a band reaches the bound. Every retained region is verified by an
edit distance between the whole window and any substring of the region, computed inside the band.

The items go to the executors in blocks of at most BLOCK_CHARS characters, one narrow pass over the documents for each
block, so what is shipped has a fixed bound and no row is shuffled.

Items of fewer than MIN_CHARS characters after normalising, too short for the lemma, are searched as they are: exactly, and
not within words (letters of scripts without word spaces stand for themselves).

Edge cases: null text is empty and clean; null and blank item texts are ignored; equal items are all reported; an empty benchmark leaves every
document clean; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm.runtime import id_and_text, tidy

Q = 8
WINDOW = 96
SHORT = 64
STRIDE = 16
ERRORS = 0.1
BAND = 16
MIN_CHARS = 32
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 100_000
MIN_SHARED = 17
_BASE = 0x9E3779B1
_SLOTS = 22
_COUNTERS = 17
#: A letter or digit of a script that puts spaces between words.
_LETTER = re.compile(r"[^\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(c: np.ndarray) -> np.ndarray:
    """The slot of the Q = 8 characters from each position, by a polynomial hash. Two q-grams that share a slot can only
    add to a count, and every region is verified."""
    h = c.astype(np.uint32) + np.uint32(1)
    for width in (1, 2, 4):
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * np.uint32(pow(_BASE, width, 1 << 32)) + h[width:]
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _SLOTS)


def windows(item: str) -> list[tuple[int, str]]:
    n = len(item)
    wide = [0] if n <= WINDOW else [*range(0, n - WINDOW, WINDOW // 2), n - WINDOW]
    dense = [] if n <= SHORT else [*range(0, n - SHORT, STRIDE), n - SHORT]
    return [(s, item[s:s + WINDOW]) for s in wide] + [(s, item[s:s + SHORT]) for s in dense]


def budget(m: int) -> int:
    """Edits allowed in a window of m characters: ERRORS of it, but so that the lemma asks for MIN_SHARED q-grams."""
    return max(0, min(int(ERRORS * m), (m - Q + 1 - MIN_SHARED) // Q))


class Index:
    """Windows of a block of items by their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        plain = [(i, normalise(t)) for i, t in items]
        found = [(i, w) for i, n in plain if len(n) >= MIN_CHARS for _, w in windows(n)]
        self.item = np.array([i for i, _ in found], np.int64)
        self.codes = [codes(w) for _, w in found]
        self.k = np.array([budget(len(c)) for c in self.codes], np.int64)
        self.need = np.array([len(c) - Q + 1 - k * Q for c, k in zip(self.codes, self.k)], np.int64)
        grams = [qgrams(c) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.count = np.bincount(flat, minlength=1 << _SLOTS).astype(np.int32)
        self.first = np.cumsum(self.count, dtype=np.int32) - self.count
        self.gate = self.count > 0
        # Short items by the slot of their first q-gram, and those that have none.
        self.exact: dict[int, list[tuple[int, str]]] = {}
        self.tiny = [(i, n) for i, n in plain if 0 < len(n) < Q]
        for i, n in plain:
            if Q <= len(n) < MIN_CHARS:
                self.exact.setdefault(int(qgrams(codes(n))[0]), []).append((i, n))
        self.opens = np.zeros(1 << _SLOTS if self.exact else 0, bool)
        self.opens[list(self.exact)] = True

    def verbatim(self, text: str) -> set[tuple[int, int]]:
        """(place, item) of every short item that stands in the text, not within a word."""
        tried = []
        if self.exact:
            h = qgrams(codes(text))
            for p in np.flatnonzero(self.opens.take(h)).tolist():
                tried += [(p, i, n) for i, n in self.exact[int(h[p])] if text.startswith(n, p)]
        for i, n in self.tiny:
            p = text.find(n)
            while p >= 0:
                tried.append((p, i, n))
                p = text.find(n, p + 1)
        within = lambda a, b: 0 <= b < len(text) and _LETTER.match(text[a]) and _LETTER.match(text[b])
        return {(p, i) for p, i, n in tried if not within(p, p - 1) and not within(p + len(n) - 1, p + len(n))}

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """(window, first diagonal of its band) of every region that meets the lemma's bound."""
        h = qgrams(text)
        at = np.flatnonzero(self.gate.take(h))
        if not len(at):
            return np.zeros((0, 2), np.int64)
        n = self.count.take(h[at])
        entry = np.repeat(self.first.take(h[at]) - (np.cumsum(n, dtype=np.int32) - n), n)
        entry += np.arange(len(entry), dtype=np.int32)
        window = self.owner.take(entry)
        span = len(text) // BAND + WINDOW // BAND + 4
        kind = np.int32 if len(self.item) * span < 1 << 31 else np.int64
        keys = np.repeat(at.astype(np.int32) + WINDOW, n) - self.place.take(entry)
        keys //= BAND
        keys = window.astype(kind) * kind(span) + keys + kind(1)
        # A band is two neighbouring steps. Counters that several steps may share come first; only where the counters of
        # a step and a neighbour reach the bound are bands counted exactly.
        slot = keys & kind((1 << _COUNTERS) - 1)
        steps = np.bincount(slot, minlength=1 << _COUNTERS)
        pairs = steps + np.roll(steps, -1)
        best = np.maximum(pairs, np.roll(pairs, 1))
        keys = keys[best.take(slot) >= self.need.take(window)].astype(np.int64)
        keys = np.concatenate((keys, keys - 1))  # a hit's own step, and the band that starts a step before
        if not len(keys):
            return np.zeros((0, 2), np.int64)
        both, counts = np.unique(keys, return_counts=True)
        both = both[counts >= self.need[both // span]]
        return np.stack((both // span, (both % span - 1) * BAND - WINDOW), axis=1)

    def distance(self, text: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Least edits between each region's window and a substring of its band, one row of all matrices at a time."""
        out = np.full(len(region), 1 << 30)
        sizes = np.array([len(self.codes[w]) for w in region[:, 0]])
        for m in np.unique(sizes):
            rows = np.flatnonzero(sizes == m)
            for rows in np.array_split(rows, -(-len(rows) // 256)):
                width = 2 * BAND + 2 * int(budget(m)) + 1  # diagonals of the band and the edits to either side
                first = region[rows, 1] - int(budget(m))
                pattern = np.stack([self.codes[w] for w in region[rows, 0]])
                place = first[:, None] + np.arange(width + m)
                inside = (place >= 0) & (place < len(text))
                chars = np.where(inside, text[np.clip(place, 0, len(text) - 1)], 0xFFFFFFFF)
                step = np.arange(width, dtype=np.int16)
                d = np.zeros((len(rows), width), np.int16)  # cell j of row i: text up to first + i + j
                for i in range(m):
                    match = d + (chars[:, i:i + width] != pattern[:, i:i + 1]).view(np.int8)
                    gap = np.full_like(d, 1 << 12)
                    gap[:, :-1] = d[:, 1:] + 1
                    d = np.minimum(match, gap)
                    d = np.minimum.accumulate(d - step, axis=1) + step
                out[rows] = d.min(axis=1).astype(np.int64)
        return out

    def find(self, texts: list[str]) -> list[list[int]]:
        """Sorted items that each text holds."""
        out: list[list[int]] = [[] for _ in texts]
        if not len(self.item) and not self.exact and not self.tiny:
            return out
        start = 0
        while start < len(texts):
            parts, stop, size = [], start, 0
            while stop < len(texts) and (stop == start or size < SLICE_CHARS):
                parts.append(normalise(texts[stop] or ""))
                size += len(parts[-1]) + WINDOW
                stop += 1
            # Noncharacters between texts, more than a window of them, so no region spans two.
            joined = ("￿" * (WINDOW + 2 * BAND)).join(parts)
            text = codes(joined)
            begins = np.cumsum([0, *[len(p) + WINDOW + 2 * BAND for p in parts[:-1]]])
            for o, i in {(int(np.searchsorted(begins, p, side="right")) - 1, i) for p, i in self.verbatim(joined)}:
                out[start + o].append(i)
            region = self.candidates(text)
            if len(region):
                region = region[self.distance(text, region) <= self.k[region[:, 0]]]
                middle = region[:, 1] + BAND + np.array([len(self.codes[w]) for w in region[:, 0]], np.int64) // 2
                middle = np.clip(middle, 0, max(0, len(text) - 1))
                owner = np.searchsorted(begins, middle, side="right") - 1
                # A region near the end of a text belongs to that text, not to the filler behind it.
                for o, i in set(zip(owner.tolist(), self.item[region[:, 0]].tolist())):
                    out[start + o].append(i)
            start = stop
        return [sorted(x) for x in out]


def blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size; each block is read by a query of its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_CHARS
    return [[(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()] for b in range(n)]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items (array of the item ids found), one row for each document row."""
    out = id_and_text(docs).withColumn("items", F.array().cast("array<long>"))
    for block in blocks(benchmark):
        out = out.mapInPandas(tidy(_pass(block)), "doc_id long, text string, items array<long>")
    return out.select("doc_id", "items")


def _pass(block: list[tuple[int, str]]):
    def batches(frames):
        index = Index(block)
        for frame in frames:
            found = index.find(frame["text"].tolist())
            frame["items"] = [sorted({*have, *new}) for have, new in zip(frame["items"], found)]
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return batches


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, first_item, items (comma-joined)."""
    return find_items(docs, benchmark).select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"),
        F.array_min("items").alias("first_item"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    import pyarrow as pa

    found = blocks(benchmark)

    def batches(arrow):
        indexes = [Index(b) for b in found]
        for batch in arrow:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bad = [any(x) for x in zip(*(index.find(texts) for index in indexes))]
            yield batch.filter(pa.array([not b for b in bad], pa.bool_()))

    return docs.mapInArrow(tidy(batches), docs.schema)
