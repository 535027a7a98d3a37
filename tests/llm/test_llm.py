"""Training-data operators against brute force, round trips, held-out accuracy and hard cases."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from assetlens.llm import bpe, chat, chunks, contamination, licenses, media, ngram_join, quality, queries, sharding, suffix_dedup, wavelet

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, head string, size int, node string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def hard():
    """Nulls, empty, long, repeated and odd texts, and columns whose names clash with work columns."""
    rnd = random.Random(11)
    long = words(rnd, 6000)
    shared = words(rnd, 120)
    texts = [None, "", " ", "a", "one two", "ONE  two", long, long, shared, words(rnd, 40) + " " + shared + " " + words(rnd, 40), "x" * 3000, "é漢🙂 " * 200, "line\n\n\nline\r\n\ttab", "<|im_end|> <|endoftext|> 's 'll", "under the MIT license, cc by nc"]
    near = shared.split()
    near[60] = "changed"
    texts += [" ".join(near), " ".join(near)]
    return [(i, t, "h", 1, "n") for i, t in enumerate(texts)] + [(None, shared, None, None, None), (3, "a", "h", 1, "n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_op1_round_trip_and_order(spark):
    rows = [(1, 1, "assistant", "x <|im_start|> <\\|im_end|>"), (1, 0, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "we\nird\\", "<|"), (3, None, None, "é")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(table)).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha([("user", ""), ("assistant", rows[0][3])]) and got[1]["valid_order"] and got[1]["loss_chars"] == len(rows[0][3])
    assert got[2]["n_turns"] == 2 and not got[2]["valid_order"]
    assert got[None]["turns_sha256"] == sha([("we\nird\\", "<|")]) and got[3]["turns_sha256"] == sha([("", "é")])
    assert chat.read_back(chat.format_chats(table.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.SQL[name]).df()
    plain = lambda d: sorted(map(str, d[sorted(d.columns)].astype(str).values.tolist()))
    assert plain(got) == plain(want)


def test_op2_finds_edited_passages_only(spark, hard):
    rnd = random.Random(4)
    items = [(i, words(rnd, 40)) for i in range(12)] + [(99, None), (98, "short"), (97, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, (k, t) in enumerate(items[:12]):
        s = list(t)
        for _ in range(len(s) // 20):
            p = rnd.randrange(len(s))
            s[p:p + 1] = rnd.choice([[], ["q"], [s[p], "z"]])
        rows.append((1000 + i, words(rnd, 60) + "\n" + "".join(s).upper() + " " + words(rnd, 30), "", 1, ""))
    got = {r["doc_id"]: r for r in contamination.flag(frame(spark, rows + hard), bench).collect()}
    assert all(got[1000 + i]["items"] == str(i) for i in range(12))
    assert not any(r["contaminated"] for k, r in got.items() if k is None or k < 1000)
    kept = contamination.drop_contaminated(frame(spark, rows + hard), bench)
    assert kept.count() == len(hard) and kept.columns == ["doc_id", "text", "head", "size", "node"]
    assert contamination.flag(frame(spark, hard), bench.limit(0)).filter("contaminated").count() == 0


def test_op2_finds_quotations_and_short_items(spark):
    rnd = random.Random(14)
    item = words(rnd, 90)
    items = [(1, item), (2, "What is the capital of France?"), (3, "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc"), (4, "zq"), (5, " "), (6, "Zq  zq zq?"), (7, "zq")]
    quotes = [item[s:s + n].strip() for n in (81, 100, 124) for s in range(0, 200, 7)]
    short = [("so what IS the\ncapital of france? ok", "2"), ("\u8bf7\u95ee\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\u5462", "3"), ("a zqa bzq", ""), ("zq.", "4,7"), ("a zq zq zq?", "4,6,7"), ("somewhat is the capital of france?", ""), ("what is the capital of francs?", ""), ("", "")]
    rows = [(i, words(rnd, 50) + " " + q + " " + words(rnd, 50), "", 1, "") for i, q in enumerate(quotes)]
    rows += [(1000 + i, words(rnd, 50), "", 1, "") for i in range(20)] + [(2000 + i, t, "", 1, "") for i, (t, _) in enumerate(short)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in contamination.flag(frame(spark, rows), bench).collect()}
    assert all(got[i] == "1" for i in range(len(quotes))) and not any(got[1000 + i] for i in range(20))
    assert [got[2000 + i] for i in range(len(short))] == [want for _, want in short]
    only = {r["doc_id"]: r["items"] for r in contamination.flag(frame(spark, rows), bench.filter("item_id > 1")).collect()}
    assert [only[2000 + i] for i in range(len(short))] == [want for _, want in short] and not any(only[i] for i in range(len(quotes)))
    kept = {r["doc_id"] for r in contamination.drop_contaminated(frame(spark, rows), bench).collect()}
    assert kept == {i for i, x in got.items() if not x}


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mask[i:i + length] = True
        spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
        out.append((len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def test_op3_equals_brute_force(spark, hard):
    rnd = random.Random(8)
    blocks = [words(rnd, 80) for _ in range(5)]
    rows = list(hard)
    for i in range(40):
        parts = [rnd.choice(blocks)[rnd.randrange(60):] if rnd.random() < 0.5 else words(rnd, 30) for _ in range(rnd.randint(1, 4))]
        rows.append((100 + i, "".join(parts), "", 1, ""))
    rows += [(300, "doution. e" * 90 + words(rnd, 9), "", 1, ""), (301, "ab" * 700, "", 1, "")]
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, rows), 256).collect())
    assert got == Counter(brute_repeats([r[1] for r in rows], 256))
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0), 256).count() == 0
    cut = suffix_dedup.cut_repeats(frame(spark, rows), 256)
    assert cut.columns == ["doc_id", "text", "head", "size", "node"] and cut.filter("doc_id = 4").first()["text"] == "one two"


@pytest.mark.parametrize("length", [256, 400])
def test_op3_passages_that_end_anywhere(spark, length):
    """Slices of shared passages whose ends and edits leave strings of one anchor that repeat in part."""
    rnd = random.Random(length)
    pool = [words(rnd, 260) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            source = rnd.choice(pool)
            start = rnd.randrange(len(source) - length)
            piece = source[start:start + rnd.randint(length - 40, length + 300)]
            if rnd.random() < 0.3:
                at = rnd.randrange(len(piece))
                piece = piece[:at] + "#" + piece[at + 1:]
            parts += [piece, words(rnd, rnd.randint(0, 25))]
        texts.append("".join(parts))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, [(i, t, "", 1, "") for i, t in enumerate(texts)]), length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_op3_returns_what_is_kept(spark, monkeypatch):
    """The kept text stands beside the digests, also of texts, contexts and heads that are common enough to be broadcast."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rnd = random.Random(31)
    shared, twin = words(rnd, 90), words(rnd, 80)
    wide = "".join(rnd.choice("éß漢🙂a ") for _ in range(300))
    texts = [f"{words(rnd, rnd.randint(1, 40))} {shared} {words(rnd, 20)}" for _ in range(12)] + [twin] * 6 + [words(rnd, 4) * 60] * 2 + ["abcdefghi" * 200, "x" + wide, "yz" + wide, words(rnd, 99), None, "", "é"]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, [(i, t, "", 1, "") for i, t in enumerate(texts)]), 256).collect()}
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == brute_repeats([t or "" for t in texts], 256)
    kept = [got[i]["text"] for i in range(len(texts))]
    assert all(hashlib.sha256(k.encode()).hexdigest() == got[i]["kept_sha256"] for i, k in enumerate(kept))
    assert all(shared not in k and k for k in kept[:12]) and kept[12:20] == [""] * 8 and kept[-6:] == ["x", "yz", *(t or "" for t in texts[-4:])]


def test_op3_common_keys_stay_apart(spark, monkeypatch):
    """Suffixes of one context or head that is very common don't meet in one task."""
    monkeypatch.setattr(suffix_dedup, "HOT", 50)
    rows = [(i, 1, 5, 1, 3, 7, 100 + i % 80 if i < 400 else 9) for i in range(2000)] + [(3000 + i, 1, 5, 1, 3, 8, 500 + i // 2) for i in range(30)] + [(4000, 1, 5, 1, 3, 10, 900), (4001, 2, 5, 1, 3, 11, 901)]
    ranked = spark.createDataFrame(rows, "run long, copies long, anchors int, lows int, highs int, heads long, context long").repartition(8)
    got = {r["run"]: (len(r["done"]), len(r["open"])) for r in suffix_dedup.spans_by_run(ranked).collect()}
    first = {*range(80), 400, *range(3000, 3030, 2)}
    assert got == {r[0]: (1, int(r[0] in first)) for r in rows if r[0] != 4000}
    counts = ranked.groupBy("context").count().withColumnRenamed("count", "n")
    tasks = suffix_dedup.among(ranked, "context", counts).filter("context = 9").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in tasks) == 1600 and max(r[1] for r in tasks) < 400


def test_pipeline_cuts_51_short_words(spark):
    """Repeated passages of over 50 words go whatever their bytes; 50 words in fewer than 256 bytes stay."""
    rnd = random.Random(12)
    short = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 4))) for _ in range(n))
    more, fewer, least = short(51), short(50), " ".join(rnd.choice("abcdefghijklmnop") for _ in range(51))
    wide = "\u2003".join(least.split()[::-1])
    assert len(least) == 101 and max(len(more), len(wide.encode())) < 256
    alone = [words(rnd, 60) for _ in range(9)]
    texts = [f"{alone[0]} {more} {alone[1]}", f"{alone[2]}\n{more}", more, f"{alone[3]} {fewer} {alone[4]}", f"{fewer} {alone[5]}", f"{alone[6]} {least}", f"{least} é", f"{wide} {alone[7]}", f"é {wide}", f"{alone[8]} {more.replace(' ', '  ')}", None]
    rows = [(i, t, "h", 1, "n") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, frame(spark, rows), SF).collect()}
    want = {0: f"{alone[0]}  {alone[1]}", 1: f"{alone[2]}\n", 5: f"{alone[6]} ", 6: " é", 7: f" {alone[7]}", 8: "é "}
    assert got == {i: want.get(i, t) for i, t in enumerate(texts) if i != 2}


def test_op4_payload_survives(spark, hard):
    for r in media.store_texts(frame(spark, hard)).collect():
        text = next(t for i, t, *_ in hard if i == r["doc_id"]) or ""
        raw = text.encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    seen = media.describe(media.pack(bytes(64 * 1000)))
    assert len(seen["ranges"]) == 1000 and seen["codec"] == "raw" and len(seen["keys"]) == 63 and seen["duration"] == 8.0
    with pytest.raises(ValueError):
        media.describe(media.pack(bytes(64))[:-100])


def brute_components(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split() if not t or t.isascii() else (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in sets if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(label)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_op5_equals_brute_force(spark, hard, n, percent):
    rnd = random.Random(n)
    rows = list(hard)
    for g in range(6):
        base = words(rnd, 90).split()
        for c in range(12):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = rnd.choice(["aa", "bb", "cc"])
            rows.append((100 + 20 * g + c, " ".join(w), "", 1, ""))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows), n, percent).collect() if r["doc_id"] is not None}
    assert got == brute_components(rows, n, percent)
    assert ngram_join.near_duplicates(frame(spark, rows).limit(0), n, percent).count() == 0
    odd = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string, id int, Row string, stays string")
    kept = [r["doc_id"] for r in ngram_join.keep_one(odd, n, percent).collect()]
    assert Counter(kept) == Counter([*{c for _, c in got.values()}, None])


def test_op5_near_copies_that_do_not_all_link(spark):
    """Copies with edits of their own link to their source but seldom to each other; some share a second edit."""
    rnd = random.Random(21)
    rows = []
    for g, (size, edits) in enumerate([(400, 6), (400, 14), (150, 3), (60, 1)]):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(500)) for _ in range(size)]
        for c in range(60):
            w = list(base)
            if c % 5 == 4:
                w[5:25] = [f"v{g}w{k}" for k in range(20)]
            for _ in range(rnd.randrange(edits + 1)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((1000 * g + c, " ".join(w), "", 1, ""))
    rnd.shuffle(rows)
    for n, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows), n, percent).collect()}
        assert got == brute_components(rows, n, percent)


def test_op5_near_copies_make_few_pairs(spark, monkeypatch):
    rnd = random.Random(31)
    base = words(rnd, 150).split()
    texts = []
    for _ in range(300):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.randint(1, 7)):
            copy[at] = words(rnd, 1) + "x"
        texts.append(" ".join(copy))
    made = {}

    def counted(df, name, materialize=ngram_join.materialize):
        out = materialize(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 3, 90).collect()}
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    label = list(range(300))
    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label)) and len(set(label)) > 20
    assert made["token-counts"] < 300 and made["candidates"] <= 300


def test_op5_rows_that_share_an_id(spark):
    x, y = "p q r s t u v", "k l m n o"
    rows = [(1, x, "", 1, ""), (2, x, "", 1, ""), (2, y, "", 1, ""), (0, y, "", 1, ""), (5, None, "", 1, ""), (5, "z z z z", "", 1, ""), (4, "z z z z", "", 1, ""), (None, x, "", 1, "")]
    got = sorted(map(tuple, ngram_join.near_duplicates(frame(spark, rows), 3, 90).collect()), key=str)
    assert got == sorted([(1, 5, 0), (2, 5, 0), (2, 3, 0), (0, 3, 0), (5, 0, 4), (5, 1, 4), (4, 1, 4), (None, 5, None)], key=str)


def test_op5_bitmap_tells_consecutive_ids_apart(spark):
    ids = spark.range(256_410)
    wanted = ids.filter("xxhash64(id) % 6 = 0").toPandas()["id"].to_numpy()
    found = np.flatnonzero(ngram_join.Bitmap(ids.filter("xxhash64(id) % 6 = 0")).has(np.arange(256_410)))
    assert set(wanted) <= set(found) and len(found) - len(wanted) < 256_410 / ngram_join.BITMAP_A_KEY


def test_op5_sends_whole_sets_once(spark, monkeypatch):
    """The join shuffles them, and nothing behind it does."""
    rows = [(i, f"a{i} b{i} c{i} d{i}", "", 1, "") for i in range(3000)]
    nodes = spark.createDataFrame([(9 - i, 7 * i, ngram_join.digest_of(ngram_join.shingles(pa.array([rows[7 * i][1]]), 3)[0])) for i in range(10)], "node long, doc_id long, digest string")
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = ngram_join.whole_sets(frame(spark, rows).select("doc_id", "text"), nodes, 3)
        plan = sets._jdf.queryExecution().executedPlan().toString()
        got = {r["node"]: sorted(r["tokens"]) for r in sets.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {9 - i: sorted(ngram_join.shingles(pa.array([rows[7 * i][1]]), 3)[0].view(np.int64).tolist()) for i in range(10)}
    assert plan.count("Exchange hashpartitioning") == 2  # either side of the join


def test_op6_held_out_accuracy(spark, hard):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 80 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    odd = quality.classify(frame(spark, hard), labels_of(spark, [(2, 1, 0), (6, 0, 0), (None, 1, 0), (4, None, 0)])).collect()
    assert len(odd) == len(hard) and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["score"] == 0.5 for r in quality.classify(frame(spark, hard), labels_of(spark, [])).collect())


def test_op6_learns_from_what_stands_late_in_a_text(spark):
    """Bad documents whose first 8,000 characters are as clean as those of the good ones."""
    rnd = random.Random(13)
    clean = lambda n: "\n".join(words(rnd, 12).capitalize() + "." for _ in range(n))
    junk = lambda n: "\n".join("#$% 0|1 || " * rnd.randint(2, 6) for _ in range(n))
    heads = [clean(180) for _ in range(40)]
    assert min(map(len, heads)) > 8000
    rows = [(i, t + "\n" + (junk if i % 2 else clean)(300), "", 1, "") for i, t in enumerate(heads)]
    probes = [(1000 + i, (junk if i % 2 else clean)(20), "", 1, "") for i in range(10)]
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(frame(spark, rows + probes), labels_of(spark, [(i, 1 - i % 2, 0) for i in range(40)])).collect()}
    assert [got[1000 + i] for i in range(10)] == [1 - i % 2 for i in range(10)]


def brute_marginals(unary, trans):
    n = len(unary)
    weight = {}
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        weight[state] = np.exp(sum(u for u, k in zip(unary, y) if k) + sum(trans[a][b] for a, b in zip(y, y[1:])))
    total = sum(weight.values())
    return [sum(w for s, w in weight.items() if s >> i & 1) / total for i in range(n)]


def test_op6_marginals_equal_enumeration():
    rnd = np.random.default_rng(1)
    per, trans = np.array([3, 1, 6]), rnd.normal(size=(2, 2))
    unary = rnd.normal(size=10)
    got, _, _ = quality.marginals(unary, per, trans)
    want = np.concatenate([brute_marginals(unary[a:b], trans) for a, b in ((0, 3), (3, 4), (4, 10))])
    assert np.allclose(got, want)


def test_op7_places_and_suppression(spark, hard):
    texts = ["Under the MIT License; under the mit license", "cc by nc cc by nc-sa 4.0", "Licensed under the Apache License, Version 2.0.", "in mit license", "spdx license identifier: MIT", None, "", "GPL-3.0 license é under the mit license"]
    got = licenses.scan_licenses(frame(spark, [(i, t, "", 1, "") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [
        (8, 2, 0, 4, "mit"), (9, 2, 0, 3, "cc-by-nc"), (8, 1, 3, 3, "apache-2"), (3, 0, None, None, ""), (4, 0, None, None, ""), (0, 0, None, None, ""), (0, 0, None, None, ""), (9, 1, 5, 5, "mit"),
    ]
    assert [r["labels"] for r in got] == ["mit", "cc-by-nc,cc-by-nc-sa", "apache-2", "mit", "mit", "", "", "gpl-3,mit"]
    assert licenses.scan_licenses(frame(spark, hard)).count() == len(hard) and len(licenses.rule_table()) > 200


def test_op7_notices_and_bodies(spark):
    cases = [
        ("under the terms of the GNU Lesser General Public License as published by\n# the Free Software Foundation; either version 2.1 of the License", "lgpl-2"),
        ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "agpl-3"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "epl-1"),
        ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.", "apache-2"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("https://creativecommons.org/licenses/by-nc-nd/3.0/", "cc-by-nc-nd"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause"),
        ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "zlib"),
        ("0. You just DO WHAT THE FUCK YOU WANT TO.", "wtfpl"),
        ("the rules of the eclipse and the gnu in the package", ""),
    ]
    got = licenses.scan_licenses(frame(spark, [(i, t, "", 1, "") for i, (t, _) in enumerate(cases)])).orderBy("doc_id").collect()
    assert [want in r["labels"].split(",") for r, (_, want) in zip(got, cases)] == [True] * len(cases)
    assert {r["n_base"] for r in got} == {0} and {f[0] for f in licenses.FAMILIES} <= {label for label, *_ in licenses.NOTICES + licenses.SENTENCES}


def test_op8_capacity_is_least_and_slots_are_gapless(spark, hard):
    rnd = random.Random(3)
    for _ in range(60):
        sizes, n = [rnd.randrange(1, 30) ** rnd.choice((1, 2)) for _ in range(rnd.randrange(1, 25))], rnd.randrange(1, 8)
        ends, capacity = sharding.minimax_cuts(sizes, n)
        sums = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
        best = [[10**9] * (len(sizes) + 1) for _ in range(n + 1)]
        best[0][0] = 0
        for k in range(1, n + 1):
            for j in range(len(sizes) + 1):
                best[k][j] = min(max(best[k - 1][i], sum(sizes[i:j])) for i in range(j + 1))
        assert max(sums) <= capacity == best[n][-1] and sum(sums) == sum(sizes)
    rows = sharding.assign_shards(frame(spark, hard * 3), 5).collect()
    assert len(rows) == 3 * len(hard)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert sharding.assign_shards(frame(spark, hard).limit(0), 5).count() == 0


def test_op9_equals_the_library(spark, hard):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rnd = random.Random(7)
    rows = hard + [(500 + i, "".join(rnd.choice("aabbt he'\n\t .1é漢🙂\x1c\x85") for _ in range(rnd.randint(0, 120))), "", 1, "") for i in range(200)]
    rows += [(800 + i, t, "", 1, "") for i, t in enumerate(["the" * 300, "x" * 50_000, "=" * 3000 + "a", "né" * 400, "".join(rnd.choice("etaoinshrdlu") for _ in range(900))])]
    got = Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for _, t, *_ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want[len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_op10_files_hold_the_ids(spark, hard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in hard if r[0] is not None]
    got = wavelet.token_table(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    start = 0
    for r, (i, text, *_) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.token_table(frame(spark, rows).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_op10_rank_select():
    x = np.random.default_rng(0).integers(0, 300, 300_000).astype(np.uint16)
    shard = wavelet.Shard(pa.BufferReader(wavelet.pack([1, None], [5, len(x) - 5], x)))
    assert [shard.access(i) for i in range(0, len(x), 5003)] == x[::5003].tolist() and shard.access(len(x) - 1) == x[-1]
    for token in (0, 7, 299, 60000):
        at = np.flatnonzero(x == token)
        assert shard.count(token) == len(at) and shard.count(token, 511) == (at < 511).sum()
        assert [shard.occurrence(token, k) for k in range(0, len(at), 97)] == at[::97].tolist()
        with pytest.raises(IndexError):
            shard.occurrence(token, len(at))
    assert [(i, ids.tolist()) for i, ids in shard.documents()] == [(1, x[:5].tolist()), (None, x[5:].tolist())]
    one = wavelet.Shard(pa.BufferReader(wavelet.pack([7], [1], np.array([2], np.uint16))))
    assert one.access(0) == 2 and one.count(2) == 1 and one.occurrence(2, 0) == 0 and one.decode().tolist() == [2]


def test_pieces_join_to_their_texts_and_words_are_pre_tokens():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rnd = random.Random(3)
    texts = [None, "", " ", " a", "a ", "a\n", "\na", "a\nb\nc d\ne", "a \nb", "a\n b", "a  b", "x\n\ny", "a \x1cb\x85c\u180e d\u3000e", "it's. 12.5 a.b, c:"]
    texts += ["".join(rnd.choice("ab \n\t.é1'\x1c") for _ in range(rnd.randrange(40))) for _ in range(2000)]
    batch = chunks.coded(pa.array(texts, pa.string()))
    names = batch.pieces.to_pylist()
    order, flat, ends = chunks.words(batch.pieces, pattern.findall)
    cut, flat = {}, flat.to_pylist()
    for k, i in enumerate(order.tolist()):
        cut[names[i]] = flat[ends[k]:ends[k + 1]]
    for k, i in enumerate(batch.order.tolist()):
        own = [names[c] for c in batch.codes[batch.ends[k]:batch.ends[k + 1]]]
        assert "".join(own) == (texts[i] or "")
        assert [w for p in own for w in cut[p]] == pattern.findall(texts[i] or "")


def test_shingles_do_not_depend_on_batches():
    rnd = random.Random(9)
    texts = pa.array([None if i % 9 == 4 else words(rnd, rnd.randrange(30)) for i in range(200)])
    alone = [ngram_join.shingles(pa.array([t], pa.string()), 3)[0].tolist() for t in texts.to_pylist()]
    for most in (1, 300, 1 << 30):
        got = [s.tolist() for _, part in chunks.batches_of(texts, most) for s in ngram_join.shingles(part, 3)]
        assert got == alone
    for _, part in chunks.batches_of(texts.slice(50, 100), 300):
        assert part.offset == 0


def test_letters_of_arrow_are_letters_of_the_pattern():
    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    found = pc.match_substring_regex(pa.array(signs), r"^\pL$").to_numpy(zero_copy_only=False)
    assert regex.fullmatch(r"\p{L}+", "".join(c for c, f in zip(signs, found) if f))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and last.filter("NOT round_trip").count() == 0 and last.filter(F.length("ids") != F.col("n_tokens") * 4).count() == 0


def plain_cut(texts, length, n_words):
    """Each text without the bytes of repeated strings and of repeated runs of words; None where nothing is left of a cut text."""
    raw = [t.encode() for t in texts]
    runs = [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    at = [np.cumsum([0, *(len(c.encode()) for c in t)]) for t in texts]
    spans = [[(int(o[w[k][0]]), int(o[w[k + n_words - 1][1]])) for k in range(len(w) - n_words + 1)] for w, o in zip(runs, at)]
    strings = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    passages = Counter(b[x:y] for b, s in zip(raw, spans) for x, y in s)
    out = []
    for t, b, s in zip(texts, raw, spans):
        mask = np.zeros(len(b), bool)
        for x, y in [(i, i + length) for i in range(len(b) - length + 1) if strings[b[i:i + length]] > 1] + [(x, y) for x, y in s if passages[b[x:y]] > 1]:
            mask[x:y] = True
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
        out.append(None if mask.any() and not kept.strip(" ") else kept)
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    """run() against the five stages in plain Python: ids and token ids. Good and bad texts differ plainly."""
    rnd = random.Random(15)
    prose = lambda n: "\n".join(words(rnd, 12).capitalize() + "." for _ in range(n))
    junk = lambda n: "\n".join("#$% 0|1 || " * rnd.randint(2, 6) for _ in range(n))
    item, long, short = words(rnd, 40), words(rnd, 80), " ".join(rnd.choice("abcdefghij") for _ in range(60))
    assert len(long) > 256 > len(short)
    texts = [(junk if i % 3 == 0 else prose)(rnd.randint(4, 9)) for i in range(60)]
    for i in (1, 4, 7):
        texts[i] += "\n" + long + "\n" + prose(3)
    for i in (2, 5):
        texts[i] += "\n" + short + " " + prose(3)
    for i in (8, 10):
        texts[i] += "\n" + prose(1) + (item if i == 8 else item[20:110])
    texts += [texts[11], texts[13] + " more", texts[14].replace(" ", "  ")]
    ids = [7 * i + 1 for i in range(len(texts))]
    labels = [(7 * i + 1, int(i % 3 > 0), 0) for i in range(60)]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [(i, t) for i, t in zip(ids, texts) if "#$%" not in t]
    groups = brute_components(good, 5, 80)
    unique = [(i, t) for i, t in good if groups[i][1] == i]
    cut = [(i, t) for (i, _), t in zip(unique, plain_cut([t for _, t in unique], 256, 51)) if t is not None]
    flat = lambda t: " ".join(t.lower().split())
    grams = {flat(item)[k:k + 79] for k in range(len(flat(item)) - 78)}
    clean = [(i, t) for i, t in cut if not any(flat(t)[k:k + 79] in grams for k in range(len(flat(t)) - 78))]
    assert len(texts) > len(good) > len(unique) >= len(cut) > len(clean) and dict(cut) != dict(unique)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = {i: np.array(enc.encode_ordinary(t), "<u4").tobytes() for i, t in clean}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r["doc_id"]: bytes(r["ids"]) for r in rows} == want
