"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are counts of character classes and shapes, and the same features
of the line before and after it. The field is trained by gradient ascent on labelled documents, whose lines all carry
the document's label; forward-backward gives each line's marginal, and a document's score is the mean marginal of
"good" weighted by line length. Features come from whole texts; doc_id, lang, source and labels are never features.

Training reads the whole texts of at most TRAIN_DOCS labelled documents (the least by a hash of their id, so a rerun picks
the same); scoring reads everything. Only rows whose crc32(doc_id as text) mod 3 is not 1 are
ever used for training.

Edge cases: null text is empty and is one empty line; null doc_id is not held out; without usable labels every score is
0.5; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm.runtime import id_and_text, tidy

TRAIN_DOCS = 3000
STEPS = 250
BATCH_BYTES = 4_000_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_chars double"

_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:", b"!?", b"|", b"#$%&*@~^_=+<>{}[]\\/"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 9
N_CLASSES = 10


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of each line, its length with the line end, lines of each text)."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = (ends - starts + 1).astype(np.float64)
    kinds = _CLASSES.take(raw)
    sums = lambda mask: np.add.reduceat(mask.view(np.int8), starts, dtype=np.int32)
    counts = np.stack([sums(kinds == k) for k in range(N_CLASSES)], axis=1).astype(np.float64)
    same = np.empty(len(raw), bool)
    same[-1] = False
    np.equal(raw[1:], raw[:-1], out=same[:-1])
    same &= raw != 10
    thrice = same.copy()
    thrice[:-1] &= same[1:]
    up = kinds == 2
    shout = np.zeros(len(raw), bool)
    shout[:-1] = up[1:] & up[:-1]
    words = counts[:, 4] + 1
    fresh = np.array([len(set(w)) / len(w) for t in texts for line in t.split("\n") if (w := line.split(" "))])
    share = counts / lengths[:, None]
    extra = np.stack([
        np.log1p(lengths), sums(same) / lengths, sums(thrice) / lengths * 4, sums(shout) / lengths,
        np.log1p(lengths / words), (lengths <= 2).astype(np.float64), np.minimum(words, 50) / 50,
        fresh, (1 - fresh) * np.log1p(words),
    ], axis=1)
    per_text = np.array([t.count("\n") + 1 for t in texts])
    return np.concatenate((share, extra), axis=1), lengths, per_text


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the ends of a text), and a constant."""
    n = len(own)
    first = np.cumsum(per_text) - per_text
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + per_text - 1] = 0
    return np.concatenate((own, before, after, np.ones((n, 1))), axis=1)


def marginals(unary: np.ndarray, per_text: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: (P(good) by line, pair marginals summed, log normaliser by chain).

    ``unary`` is the score of "good" over "bad" by line. Chains are sorted by length, so step t works on those that
    reach it; all messages are kept as probabilities that are normalised at each step.
    """
    order = np.argsort(-per_text, kind="stable")
    lengths, first = per_text[order], (np.cumsum(per_text) - per_text)[order]
    live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")  # chains longer than t
    m = np.exp(trans - trans.max())
    shift = np.maximum(unary, 0)
    emit = np.stack((np.exp(-shift), np.exp(unary - shift)), axis=1)
    alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty(len(unary))
    for t, k in enumerate(live):
        at = first[:k] + t
        a = emit[at] * (alpha[at - 1] @ m if t else 1.0)
        s = a.sum(axis=1)
        scale[at] = s
        alpha[at] = a / s[:, None]
    for t in range(len(live) - 2, -1, -1):
        at = first[:live[t + 1]] + t
        beta[at] = ((emit[at + 1] * beta[at + 1]) @ m.T) / scale[at + 1][:, None]
    gamma = alpha * beta
    good = gamma[:, 1] / gamma.sum(axis=1)
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(per_text) - 1] = False
    at = np.flatnonzero(inner)
    pairs = np.einsum("ni,ij,nj->nij", alpha[at], m, emit[at + 1] * beta[at + 1] / scale[at + 1][:, None]).sum(axis=0) if len(at) else np.zeros((2, 2))
    log_z = np.add.reduceat(np.log(scale) + shift, np.cumsum(per_text) - per_text) + (per_text - 1) * trans.max()
    return good, pairs, log_z


def train(texts: list[str], labels: np.ndarray) -> dict:
    """Weights by Adam on the mean log-likelihood with an L2 penalty."""
    own, _, per_text = line_features(texts)
    mean, dev = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - mean) / dev, per_text)
    y = np.repeat(labels, per_text)
    lines = np.repeat(1.0 / (len(labels) * per_text), per_text)  # every document counts alike, whatever its lines
    theta, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(trans), np.zeros_like(trans)]
    share = np.array([(labels == 0).sum(), (labels == 1).sum()])
    for step in range(1, STEPS + 1):
        good, pairs, _ = marginals(x @ theta, per_text, trans)
        g = x.T @ (lines * (y - good)) - 1e-3 * theta
        seen = np.diag([float((per_text[labels == k] - 1).sum()) for k in (0, 1)])
        h = (seen - pairs) / max(1.0, seen.sum() + 1) - 5e-2 * trans if share.all() else np.zeros((2, 2))
        for value, grad, m, v in ((theta, g, state[0], state[1]), (trans, h, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"mean": mean, "dev": dev, "theta": theta, "trans": trans}


def score_texts(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, lines, characters' share expected bad) of each text."""
    own, lengths, per_text = line_features(texts)
    x = with_neighbours((own - model["mean"]) / model["dev"], per_text)
    good, _, _ = marginals(x @ model["theta"], per_text, model["trans"])
    first = np.cumsum(per_text) - per_text
    score = np.add.reduceat(good * lengths, first) / np.add.reduceat(lengths, first)
    return np.clip(score, 0.0, 1.0), per_text, 1 - score


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, or None where there is no usable label. Brings at most TRAIN_DOCS texts to the driver."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    ids = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = id_and_text(docs).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(TRAIN_DOCS).collect()  # ids has at most TRAIN_DOCS rows
    if len({r["quality"] for r in rows}) < 2:
        return None
    return train([r["text"] for r in rows], np.array([r["quality"] for r in rows]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    names = SCHEMA.replace(",", "").split()[0::2]

    def batches(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            score, lines, bad = np.full(len(texts), 0.5), np.array([t.count("\n") + 1 for t in texts]), np.full(len(texts), 0.5)
            start = 0
            while model is not None and start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < BATCH_BYTES):
                    size += len(texts[stop])
                    stop += 1
                score[start:stop], lines[start:stop], bad[start:stop] = score_texts(texts[start:stop], model)
                start = stop
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32), "n_lines": lines, "bad_chars": bad}, columns=names)

    return id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInPandas(tidy(batches), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with all their columns."""
    import pyarrow as pa

    model = fit(docs, labels)

    def batches(arrow):
        for batch in arrow:
            texts, good, start = [t or "" for t in batch.column("text").to_pylist()], [], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < BATCH_BYTES):
                    size += len(texts[stop])
                    stop += 1
                good.append(score_texts(texts[start:stop], model)[0] >= 0.5)
                start = stop
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(tidy(batches), docs.schema) if model else docs
