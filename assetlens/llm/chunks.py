"""Splitting texts where byte-level BPE pre-tokens can never cross, so that distinct pieces are encoded once.

Under the pattern of the rank files a blank followed by anything but white space always starts a pre-token: white space
before it gives its last blank to the next token, and no other alternative can end with one. A single line feed between
other signs than white space is a pre-token of its own. So a text splits there, and equal pieces have equal ids wherever
they stand. A batch becomes codes of its distinct pieces by Arrow, and all that follows is done once for a distinct piece
or by gathers over whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Where a text that has white space behind white space or at an end is split.
BREAK = regex.compile(r" (?=\S)")
#: White space in Arrow's expressions, which know only ASCII white space by name.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\pZ"
#: What such texts have.
LOOSE = f"[ \\n]([{SPACE}]|$)|[{SPACE}]\\n|^\\n"
#: Signs that form a pre-token of their own after letters.
TAIL = ".,;:!?"


class Coded(NamedTuple):
    order: np.ndarray  # places of the texts in the batch, in the order used below
    ends: np.ndarray  # per text: where its codes start, and at last where they end
    codes: np.ndarray  # codes of all texts in order
    pieces: pa.Array  # distinct pieces by code


def batches_of(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(start, texts) of about ``most`` bytes of neighbouring texts; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, texts.take(pa.array(np.arange(start, stop)))  # not a slice: Arrow's splitting at white space takes a slice's offset for 0
        start = stop


def coded(texts: pa.Array) -> Coded:
    """Pieces of every text as codes; joined, a text's pieces give the text. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    loose = pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False)
    order = np.concatenate((np.flatnonzero(~loose), np.flatnonzero(loose)))
    kind = pa.large_list(pa.large_string())
    split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~loose)), "\n", " \n "), " ").cast(kind)
    n_close = len(split.flatten())
    if loose.any():
        split = pa.concat_arrays([split, pa.array([BREAK.split(t) for t in objects(texts.filter(pa.array(loose)))], kind)])
    ends = np.zeros(len(split) + 1, np.int64)
    np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), out=ends[1:])
    dictionary = split.flatten().dictionary_encode()
    codes, names = dictionary.indices.to_numpy(zero_copy_only=False).astype(np.int32), dictionary.dictionary
    bare = np.zeros(len(codes) + 1, bool)  # parts with no blank before them
    bare[ends[:-1]] = True
    feed = np.flatnonzero(codes[:n_close] == pc.index(names, "\n").as_py())
    bare[feed] = bare[feed + 1] = True
    bare = bare[:-1]
    inner, heads = np.zeros(len(names), bool), np.zeros(len(names), bool)
    inner[codes[~bare]], heads[codes[bare]] = True, True
    n_inner = int(inner.sum())
    codes = np.where(bare, (np.cumsum(heads, dtype=np.int32) + np.int32(n_inner - 1))[codes], (np.cumsum(inner, dtype=np.int32) - 1)[codes])
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return Coded(order, ends, codes, pa.concat_arrays([pc.binary_join_element_wise(blank, names.filter(pa.array(inner)), nothing), names.filter(pa.array(heads))]))


def words(pieces: pa.Array, split: Callable[[str], list[str]]) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(order, words of pieces[order] one behind the other, where each piece's begin and the last's end).

    Letters, perhaps behind a blank, are one word; with signs of TAIL behind them they are two; ``split`` cuts other pieces.
    Arrow's table of letters is older than the pattern's, so that what it calls letters is one pre-token.
    """
    letters, tailed = (pc.match_substring_regex(pieces, f"^ ?\\pL+{tail}$").to_numpy(zero_copy_only=False) for tail in ("", f"[{TAIL}]+"))
    one, two, more = np.flatnonzero(letters), np.flatnonzero(tailed), np.flatnonzero(~(letters | tailed))
    pair = pc.extract_regex(pieces.take(pa.array(two)), f"^(?P<core> ?\\pL+)(?P<tail>[{TAIL}]+)$")
    both = pa.concat_arrays([pair.field("core"), pair.field("tail")]).take(pa.array(np.arange(2 * len(two)).reshape(2, -1).T.ravel()))
    rest = [split(p) for p in objects(pieces.take(pa.array(more)))]
    length = np.concatenate((np.ones(len(one), np.int64), np.full(len(two), 2), np.fromiter(map(len, rest), np.int64, len(rest))))
    ends = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    flat = pa.concat_arrays([pieces.take(pa.array(one)), both, pa.array(list(chain.from_iterable(rest)), pa.large_string())])
    return np.concatenate((one, two, more)), flat.dictionary_encode(), ends


def objects(strings: pa.Array) -> list:
    """The strings as Python objects, some ten times faster than ``to_pylist``."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of the bytes of ``data`` between neighbouring ends."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, ends) of strings."""
    _, ends, data = strings.buffers()
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(ends, np.int64)[strings.offset:strings.offset + len(strings) + 1]


class Held:
    """Words with columns of bytes, found by their 64-bit hashes and confirmed by their bytes; bounded by ``forget_over``."""

    def __init__(self, columns: int):
        self.n = columns
        self.forget()

    def forget(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and whose word they are
        self.words = pa.array([], pa.large_binary())
        self.columns = [self.words] * self.n

    def nbytes(self) -> int:
        return self.keys.nbytes + self.places.nbytes + self.words.nbytes + sum(c.nbytes for c in self.columns)

    def forget_over(self, most: int) -> None:
        if self.nbytes() > most:
            self.forget()

    def places_of(self, words: pa.Array, make: Callable[[pa.Array], list[pa.Array]]) -> np.ndarray:
        """Places of distinct words; ``make`` gives the columns of those that are new."""
        words = words.cast(pa.large_binary())
        hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
        out = np.full(len(words), -1)
        if len(self.keys) and len(words):
            slot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            same = np.flatnonzero(self.keys[slot] == hashes)
            place = self.places[slot[same]]
            right = pc.equal(self.words.take(pa.array(place)), words.take(pa.array(same))).to_numpy(zero_copy_only=False)
            out[same[right]] = place[right]
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            made = make(fresh)
            out[new] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, fresh])
            self.columns = [pa.concat_arrays(both) for both in zip(self.columns, made)]
            keys, places = np.concatenate((self.keys, hashes[new])), np.concatenate((self.places, out[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.places = keys[order], places[order]
        return out


class Pieces:
    """Columns of bytes for texts, through held pieces and held words; ``encode`` gives the columns of new words.

    Either store is dropped when it is larger than ``most`` bytes at the start of a batch.
    """

    def __init__(self, columns: int, split: Callable[[str], list[str]], encode: Callable[[pa.Array], list[pa.Array]], most: int):
        self.pieces, self.words, self.split, self.encode, self.most = Held(columns), Held(columns), split, encode, most

    def forget(self) -> None:
        self.pieces.forget()
        self.words.forget()

    def _make(self, fresh: pa.Array) -> list[pa.Array]:
        order, flat, ends = words(fresh.cast(pa.large_string()), self.split)
        at = self.words.places_of(flat.dictionary, self.encode)[flat.indices.to_numpy(zero_copy_only=False)]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        out = []
        for column in self.words.columns:
            data, stops = parts(column.take(pa.array(at)))
            out.append(binary(data, stops[ends]).take(pa.array(back)))
        return out

    def of(self, texts: pa.Array) -> list[list[memoryview]]:
        """For each column the bytes of every text."""
        self.pieces.forget_over(self.most)
        self.words.forget_over(self.most)
        batch = coded(texts)
        at = pa.array(self.pieces.places_of(batch.pieces, self._make)[batch.codes])
        out = []
        for column in self.pieces.columns:
            data, stops = parts(column.take(at))
            view, stops, texts_in_place = memoryview(data), stops[batch.ends].tolist(), [None] * len(texts)
            for k, i in enumerate(batch.order.tolist()):
                texts_in_place[i] = view[stops[k]:stops[k + 1]]
            out.append(texts_in_place)
        return out
