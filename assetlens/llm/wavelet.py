"""Token ids in wavelet-matrix files: one matrix and one file for each shard of documents in ascending doc_id order.

File: magic, header length, JSON header, the alphabet (the shard's distinct ids in order), then for each bit of the ids'
places in the alphabet, most significant first, a plane: a directory with the count of ones before each RANK bits, and the
bits of all ids in the order that stable partition by the planes above gave, in segments of SEGMENT bits, each compressed
by itself. ``Shard`` answers access, count and occurrence from a file by reading the directory entries and segments that
the answer needs, and decodes whole files plane by plane.

Texts are dealt by range of doc_id and sorted within shards; a task closes a file at SHARD_IDS ids or SHARD_DOCS documents
and begins another. Each task attempt writes files under names of its own; the manifest, written as a table, names those of
the attempts that counted, so a lost executor leaves no half file in use.

Edge cases: null text is empty and has only the end id; ids that repeat are ordered by text; null doc_id comes first; an
empty table writes no file; other columns are ignored. Memory: BATCH_BYTES of text (or one longer text), twice CACHE_BYTES
of pieces and words, which go when another operator takes the worker, and one shard's ids.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm.chunks import SPACE, Pieces, batches_of, binary, objects
from assetlens.llm.runtime import fresh_path, id_and_text, materialize, worker_state

MAGIC = b"ALWM0002"
SHARD_IDS, SHARD_DOCS, DOCS_PER_TASK = 1 << 22, 1 << 16, 4096
#: Bits of a directory entry and of a segment.
RANK, SEGMENT = 512, 1 << 18
BATCH_BYTES, CACHE_BYTES = 8_000_000, 48_000_000
#: Words in one call of the library.
GROUP = 2000
#: Segments that an open shard keeps.
OPEN = 64
MANIFEST = "path string, seq int, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def build(ids: np.ndarray) -> tuple[dict, list[bytes]]:
    """(header entries, sections) of the matrix of a shard's ids."""
    alphabet = np.flatnonzero(np.bincount(ids, minlength=1)).astype("<u2")
    place = np.zeros(int(alphabet[-1]) + 1, np.uint16)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint16)
    x, zeros, segments, out = place.take(ids), [], [], [alphabet.tobytes()]
    for bit in range(max(1, (len(alphabet) - 1).bit_length()) - 1, -1, -1):
        m = (x & np.uint16(1 << bit)) != 0
        packed = np.packbits(m, bitorder="little")
        words64 = np.concatenate((packed, np.zeros(-len(packed) % (RANK // 8), np.uint8))).view("<u8")
        ones = np.bitwise_count(words64).reshape(-1, RANK // 64).sum(1, dtype=np.uint32)
        out.append(np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4").tobytes())
        raw = packed.tobytes()
        squeezed = [zstandard.compress(raw[at:at + SEGMENT // 8], 1) for at in range(0, len(raw), SEGMENT // 8)]
        out += squeezed
        segments.append([len(s) for s in squeezed])
        zeros.append(len(x) - int(ones.sum()))
        x = np.concatenate((np.compress(~m, x), np.compress(m, x)))
    return {"n": len(ids), "letters": len(alphabet), "zeros": zeros, "segments": segments}, out


def pack(docs: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of a shard."""
    header, sections = build(ids)
    head = json.dumps({**header, "docs": docs, "lengths": lengths}, separators=(",", ":")).encode()
    return b"".join((MAGIC, struct.pack("<Q", len(head)), head, *sections))


class Shard:
    """Queries over one file, given as something with ``read_at(size, offset)``."""

    def __init__(self, source):
        self.source = source
        magic, size = struct.unpack("<8sQ", source.read_at(16, 0))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.header = json.loads(source.read_at(size, 16))
        self.n, self.zeros = self.header["n"], self.header["zeros"]
        self.bits, at = len(self.zeros), 16 + size
        self.alphabet = np.frombuffer(source.read_at(2 * self.header["letters"], at), "<u2")
        at += 2 * len(self.alphabet)
        self.directory, self.starts = [], []
        for sizes in self.header["segments"]:
            self.directory.append(at)
            ends = np.cumsum([at + 4 * -(-self.n // RANK), *sizes])
            self.starts.append(ends)
            at = int(ends[-1])
        self.open: OrderedDict = OrderedDict()

    def _segment(self, level: int, k: int) -> bytes:
        if (level, k) not in self.open:
            start, stop = self.starts[level][k:k + 2].tolist()
            self.open[level, k] = zstandard.decompress(self.source.read_at(stop - start, start))
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end((level, k))
        return self.open[level, k]

    def _bit(self, level: int, i: int) -> int:
        return self._segment(level, i // SEGMENT)[i % SEGMENT >> 3] >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i: the directory's entry and the rest of its block."""
        if i >= self.n:
            return self.n - self.zeros[level]
        before = struct.unpack("<I", self.source.read_at(4, self.directory[level] + 4 * (i // RANK)))[0]
        start, rest = i % SEGMENT // RANK * (RANK // 8), i % RANK
        block = int.from_bytes(self._segment(level, i // SEGMENT)[start:start + RANK // 8], "little")
        return before + (block & ((1 << rest) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _range(self, token: int, end: int) -> tuple[int, int, int]:
        """(letter, first, last + 1 place under the last plane) of an id's occurrences before a position."""
        letter = int(np.searchsorted(self.alphabet, token))
        if letter == len(self.alphabet) or self.alphabet[letter] != token:
            return -1, 0, 0
        start = 0
        for level in range(self.bits):
            a, b, zeros = self._ones(level, start), self._ones(level, end), self.zeros[level]
            start, end = (zeros + a, zeros + b) if letter >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return letter, start, end

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id before a position, or in the whole shard."""
        _, start, stop = self._range(token, self.n if end is None else end)
        return stop - start

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th bit of this value in a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            low, high = (low, mid) if (ones if bit else mid + 1 - ones) > k else (mid + 1, high)
        return low

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of an id, from 0."""
        letter, start, stop = self._range(token, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.bits - 1, -1, -1):
            bit = letter >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, undo each stable partition."""
        x = np.zeros(self.n, np.uint16)
        for level in range(self.bits - 1, -1, -1):
            ends = self.starts[level].tolist()
            data = self.source.read_at(ends[-1] - ends[0], ends[0])
            raw = b"".join(zstandard.decompress(data[a - ends[0]:b - ends[0]]) for a, b in zip(ends, ends[1:]))
            m = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[~m] = x[:self.zeros[level]]
            y[m] = x[self.zeros[level]:] | np.uint16(1 << (self.bits - 1 - level))
            x = y
        return self.alphabet.take(x)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order."""
        ids, at = self.decode(), 0
        for doc_id, n in zip(self.header["docs"], self.header["lengths"]):
            yield doc_id, ids[at:at + n]
            at += n


class Tokens:
    """Ids of texts by the tokenizers library, which gets each distinct word once, many in one text.

    A word that starts with a blank and something else follows its neighbour directly, one without white space after a line
    feed; pre-tokens can't cross either, so the ids' byte lengths tell where each word ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # a sign of the vocabulary stands for one byte
        self.width[list(vocab.values())] = list(map(len, vocab))
        self.pieces = Pieces(1, lambda piece: [piece] if piece else [], self.encode_words, CACHE_BYTES)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def joined(self, words: list[bytes], between: bytes) -> list[np.ndarray]:
        """Data and lengths of the ids of words that may stand in one text."""
        data, lengths = [], []
        for at in range(0, len(words), GROUP):
            group = words[at:at + GROUP]
            ids = self.ids(between.join(group).decode())
            stops, wanted = np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, group), np.int64, len(group))) + len(between) * np.arange(len(group))
            ends = np.searchsorted(stops, wanted) + 1
            if not np.array_equal(stops[ends - 1], wanted):
                raise ValueError("a pre-token crosses words")
            starts = np.concatenate(([0], ends[:-1] + len(between)))
            keep = np.ones(len(ids), bool)
            keep[starts[1:] - 1] &= not between
            data.append(ids[keep])
            lengths.append(ends - starts)
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (data, lengths)]

    def encode_words(self, fresh: pa.Array) -> list[pa.Array]:
        text = fresh.cast(pa.large_string())
        after_blank, unbroken = (pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False) for p in (f"^ [^{SPACE}]", f"^[^{SPACE}]+$"))
        kinds = np.where(after_blank, 0, np.where(unbroken, 1, 2))
        made = [self.joined(objects(fresh.filter(pa.array(kinds == k))), b) for k, b in ((0, b""), (1, b"\n"))]
        alone = [self.ids(w) for w in objects(text.filter(pa.array(kinds == 2)))]
        data = np.concatenate((made[0][0], made[1][0], *alone))
        ends = np.zeros(len(fresh) + 1, np.int64)
        np.cumsum(np.concatenate((made[0][1], made[1][1], np.fromiter(map(len, alone), np.int64, len(alone)))), out=ends[1:])
        return [binary(data.astype("<u2"), 2 * ends).take(pa.array(np.argsort(np.argsort(kinds, kind="stable"))))]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; texts with strings of special tokens go to the library whole."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(~whole).tolist(), self.pieces.of(texts.filter(pa.array(~whole)))[0]):
            out[i] = np.frombuffer(ids, "<u2")
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.ids(texts[i].as_py()).astype("<u2")
        return out


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write the files and return their manifest, one row for each file; (part, seq) is their order."""
    body = id_and_text(docs)
    parts = max(1, -(-body.count() // DOCS_PER_TASK))  # the count reads no column
    names = MANIFEST.replace(",", "").split()[0::2]

    def batches(frames):
        own = worker_state(("wavelet", tokenizer), lambda: Tokens(tokenizer))
        end, wait, docs, lengths, seq = np.array([end_id], "<u2"), [], [], [], 0

        def close():
            path, ids = f"{folder}/{uuid.uuid4().hex}.wm", np.concatenate(wait)
            fs, inner = pafs.FileSystem.from_uri(path)
            fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(inner) as f:
                f.write(pack(docs, lengths, ids))
            return pa.RecordBatch.from_pandas(pd.DataFrame([(path, seq, len(docs), len(ids))], columns=names).astype({"seq": "int32"}), preserve_index=False)

        for frame in frames:
            for start, texts in batches_of(frame["text"], BATCH_BYTES):
                size = sum(lengths)
                for i, ids in zip(frame["doc_id"].slice(start, len(texts)).to_pylist(), own.encode(texts)):
                    docs.append(i)
                    lengths.append(len(ids) + 1)
                    wait += [ids, end]
                    size += len(ids) + 1
                    if size >= SHARD_IDS or len(docs) >= SHARD_DOCS:
                        yield close()
                        wait, docs, lengths, size, seq = [], [], [], 0, seq + 1
                wait = [np.concatenate(wait)] if wait else []  # lets go of the batch
        if docs:
            yield close()

    files = body.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(batches, MANIFEST)
    return materialize(files.withColumn("part", F.spark_partition_id()), "wavelet-manifest")


def with_offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the number of ids in all files before.

    Sums of 4,096 tasks' files come first, so that the one window without a partition, and the side that is broadcast, have
    a row for some 16 million documents.
    """
    files = manifest.withColumn("block", F.expr("part div 4096"))
    in_order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.groupBy("block").agg(F.sum("n_ids").alias("n")).select("block", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    in_block = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("before") + F.coalesce(F.sum("n_ids").over(in_block), F.lit(0))
    return files.join(F.broadcast(blocks), "block").select("path", base.cast("long").alias("base"))


def read_shards(files: DataFrame, tasks: int) -> DataFrame:
    """Every document of every file (path, base), decoded from its bit-planes."""

    def batches(frames):
        for frame in frames:
            for path, start in zip(frame["path"], frame["base"].tolist()):
                fs, inner = pafs.FileSystem.from_uri(path)
                out = []
                with fs.open_input_file(inner) as f:
                    for doc_id, ids in Shard(f).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pd.DataFrame(out, columns=ROWS.replace(",", "").split()[0::2]).astype({"doc_id": "Int64"})

    return files.repartition(tasks, "path").mapInPandas(batches, ROWS)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    manifest = write_shards(docs, tokenizer, end_id, fresh_path(docs.sparkSession, "wavelet"))
    return read_shards(with_offsets(manifest), max(1, min(manifest.count(), 2000)))
