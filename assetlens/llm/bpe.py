"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per partition's worker.

The merge table holds, for every token and every way to cut it into two tokens, (left, right, rank). A batch's distinct
pre-tokens become token-position rows; a recursive query joins neighbours with the merge table and contracts each word's
leftmost minimum-rank pair, until no pair of the word is in the table. Words that have come to that leave the recursion.
Decoding joins ids with the vocabulary and aggregates the bytes in order.

Words over LONG bytes (runs of one sign, for example) contract all places of the minimum pair in one step, from the left
and without overlap, where the merge table proves that this is the same: no cut of a token of lower rank has the pair's
token as a part, so the merge can't bring forth a pair that would go before the other places. Otherwise they too go one
place at a time.

Edge cases: null text is empty and has no ids; repeated rows and ties are ordinary; a piece of any length is encoded whole;
an empty table gives no rows; other columns are ignored. Memory is bounded by BATCH_BYTES of text (or one longer text), the
database's limit and twice CACHE_BYTES of pieces and words, dropped when they are more and at a task's end.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from assetlens.llm.chunks import Pieces, batches_of, binary, objects
from assetlens.llm.runtime import id_and_text, leave, worker_state

CACHE_BYTES = 48_000_000
BATCH_BYTES = 8_000_000
#: Bytes of new words in one recursive query, and of a word that is contracted at several places in a step.
QUERY_BYTES, LONG = 500_000, 256
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"
WITH_IDS = SCHEMA + ", ids binary"

# Rows come in the order of pos, which windows without an order and the probe side of joins keep in a database of one thread.
_PAIRS = """
  WITH p AS (SELECT w, pos, tok, row_number() OVER () AS i, CASE WHEN lead(w) OVER () = w THEN tok * 65536::BIGINT + lead(tok) OVER () END AS pair FROM t WHERE live),
  r AS MATERIALIZED (SELECT p.w, p.pos, p.tok, p.i, m.rank, m.alone FROM p LEFT JOIN merges m ON m.pair = p.pair),
  b AS (SELECT w, min(rank * 4294967296 + pos) AS best FROM r WHERE rank IS NOT NULL GROUP BY w)"""
ENCODE = f"""
WITH RECURSIVE t(w, pos, tok, live) AS (
  SELECT w, pos, tok, true FROM seed
  UNION ALL ({_PAIRS.replace(", row_number() OVER () AS i", "").replace(" p.i,", "").replace(", m.alone", "")}
  SELECT w, pos, CASE WHEN here THEN best // 4294967296 ELSE tok END, best IS NOT NULL FROM (
    SELECT *, lag(here, 1, false) OVER () AS gone FROM (
      SELECT r.w, r.pos, r.tok, b.best, coalesce(b.best % 4294967296 = r.pos, false) AS here FROM r LEFT JOIN b ON b.w = r.w
    )
  ) WHERE NOT gone)
)
SELECT w, pos, tok FROM t WHERE NOT live ORDER BY pos
"""
ENCODE_LONG = f"""
WITH RECURSIVE t(w, pos, tok, live) USING KEY (pos) AS (
  SELECT w, pos, tok, true FROM seed
  UNION ({_PAIRS.replace("FROM t WHERE live", "FROM (SELECT * FROM recurring.t WHERE live ORDER BY pos)")}
  SELECT w, pos, CASE WHEN gone THEN NULL WHEN here THEN best // 4294967296 ELSE tok END, best IS NOT NULL AND NOT gone FROM (
    SELECT *, lag(here, 1, false) OVER () AS gone FROM (
      SELECT *, hit AND (best % 4294967296 = pos OR alone AND (i - max(CASE WHEN hit THEN 0 ELSE i END) OVER (ROWS UNBOUNDED PRECEDING)) % 2 = 1) AS here FROM (
        SELECT r.*, b.best, coalesce(r.rank = b.best // 4294967296, false) AS hit FROM r LEFT JOIN b ON b.w = r.w
      )
    )
  ))
)
SELECT w, pos, tok FROM t WHERE tok IS NOT NULL ORDER BY pos
"""
DECODE = "SELECT unhex(string_agg(v.hexed, '' ORDER BY i.pos)) AS raw FROM ids i JOIN vocab v ON v.id = i.tok GROUP BY i.w ORDER BY i.w"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """A rank file in an in-memory database, with encoded and decoded words."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        cuts = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int64)
        least = np.full(int(cuts.max()) + 1, np.iinfo(np.int64).max)  # of the tokens that are cut so that this one is a part
        np.minimum.at(least, cuts[:, 0], cuts[:, 2])
        np.minimum.at(least, cuts[:, 1], cuts[:, 2])
        merges = pa.table({"pair": cuts[:, 0] * 65536 + cuts[:, 1], "rank": cuts[:, 2], "alone": least[cuts[:, 2]] > cuts[:, 2]})
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hexed": [t.hex() for t in ranks]})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges").execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.pieces = Pieces(2, self.pattern.findall, self.encode_words, CACHE_BYTES)

    def encode_words(self, words: pa.Array) -> list[pa.Array]:
        """Ids of words as little-endian unsigned 32-bit integers, and the bytes that these ids decode to."""
        long = pc.binary_length(words).to_numpy() > LONG
        order = np.argsort(long, kind="stable")
        words, n_short = objects(words.take(pa.array(order))), int(len(long) - long.sum())
        ids, raw, at = [], [], 0
        while at < len(words):
            group, size, stop = [], 0, n_short if at < n_short else len(words)
            while at < stop and (not group or size + len(words[at]) <= QUERY_BYTES):
                group.append(words[at])
                size += len(group[-1])
                at += 1
            lengths = np.array([len(g) for g in group])
            seed = pa.table({
                "w": np.repeat(np.arange(len(group), dtype=np.int32), lengths),
                "pos": np.arange(lengths.sum(), dtype=np.int64),
                "tok": self.bytes[np.frombuffer(b"".join(group), np.uint8)].astype(np.int64),
            })
            self.db.register("seed", seed)
            got = self.db.execute(ENCODE if at <= n_short else ENCODE_LONG).fetchnumpy()
            self.db.unregister("seed")
            self.db.register("ids", pa.table({n: got[n] for n in ("w", "pos", "tok")}))
            raw.append(self.db.sql(DECODE).to_arrow_table()["raw"].combine_chunks().cast(pa.large_binary()))
            self.db.unregister("ids")
            ids.append(binary(got["tok"].astype("<u4"), np.searchsorted(got["w"], np.arange(len(group) + 1)) * 4))
        back = pa.array(np.argsort(order))
        return [pa.concat_arrays(ids).take(back), pa.concat_arrays(raw).take(back)]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Digests of ids and decoded bytes by document; with_ids adds the ids as little-endian unsigned 32-bit integers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = WITH_IDS if with_ids else SCHEMA
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(frames):
        own = worker_state(("bpe", ranks, pattern), lambda: Codec(ranks, pattern))
        try:
            for frame in frames:
                for start, texts in batches_of(frame["text"], BATCH_BYTES):
                    doc_ids = frame["doc_id"].slice(start, len(texts))
                    rows = [
                        (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw), raw == (text or "").encode(), *([bytes(ids)] if with_ids else []))
                        for (ids, raw), text in zip(zip(*own.pieces.of(texts)), objects(texts))
                    ]
                    yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:]))], schema=arrow)
        finally:  # the next task may be another operator's
            own.pieces.forget()
            leave()

    return id_and_text(docs).mapInArrow(batches, schema)
