import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendlens.llm import es_mixing as mix, vector_packing as vp, warc_chunks as wc

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t", "Hello, World! it's 2024's", "café CAFÉ é ẞ İstanbul ΣΑΣ", "a b c　d\x1ce\x85f",
       "<|endoftext|> and <|startoftext|>x", "don't we'll I'd 12ab34", "𝄞🎉 emoji‍zwj ﻿bom", "日本語 テキスト", "x" * 30_000, "tok en " * 20_000]


def pieces_by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["start"]) for k, v in out.items()}


def check_layout(rows, limits):
    seq = {}
    for r in rows:
        seq.setdefault(r["sequence_id"], []).append(r)
    for v in seq.values():
        v.sort(key=lambda r: r["offset"])
        at = 0
        for r in v:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens and len(v) <= limits.segments and sum(r["loss_tokens"] for r in v) <= limits.loss
    return {k: sum(r["length"] for r in v) for k, v in seq.items()}


def test_word_cache_matches_the_tokenizer():
    tok, cache = Tokenizer.from_file(BPE), vp.WordCache(BPE, most=5)
    rng = random.Random(1)
    alphabet = "aA' \n\t.,0É́ßşΣσ  𝄞<|>\x0b\x1c"
    for t in [x or "" for x in ODD] + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]:
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packed_texts_hold_every_id_once(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "lorem ipsum " * rng.choice([1, 5, 80, 900, 3000])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("mine")).repartition(3)
    got = vp.pack_texts(docs, BPE).collect()
    sizes = check_layout(got, vp.Limits())
    assert all(n & (n - 1) == 0 for n in sizes.values())
    tok, by = Tokenizer.from_file(BPE), pieces_by_doc(got)
    assert set(by) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for p in by[i]:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_examples_under_three_limits(spark):
    rng = random.Random(6)
    limits = vp.Limits(tokens=100, segments=4, loss=40)
    rows = []
    for i in range(300):
        n = rng.randint(1, 60)
        rows.append((i, list(range(n)), [rng.random() < 0.4 for _ in range(n)]))
    rows += [(900, list(range(350)), None), (901, None, None), (902, [], []), (None, [1, 2], [True, False]), (1, [5], [True])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>").repartition(2)
    for cut in (False, True):
        got = vp.pack_examples(df, limits, cut).collect()
        sizes = check_layout(got, limits)
        assert sum(sizes.values()) == sum(len(r[1] or []) for r in rows)
        if not cut:
            by = pieces_by_doc(got)
            assert all(len(by[i]) == 1 for i in range(2, 300) if sum(rows[i][2]) <= 40)
            # Far fewer sequences than one each, and not far over what the scarcest limit allows.
            need = max(sum(sizes.values()) / 100, len(got) / 4, sum(r["loss_tokens"] for r in got) / 40)
            assert len(sizes) <= 1.25 * need + 4
    assert vp.pack_examples(df.where("false"), limits).count() == 0
    assert vp.pack_texts(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_other_tokenizers_take_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert vp.by_words(vp._word_bpe()) and not vp.by_words(path)
    tok, texts = Tokenizer.from_file(path), ["Hello World", "", None, "  It's  2 tabs\t\n", "Ünïcode 你好 \U0001f600", "a" * 3000]
    got = vp.pack_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for i, t in enumerate(texts):
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4"), 0
        for p in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
            at += p["length"]
        assert at == len(ids)


def slow_targets(sizes, share=1.5, limit=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(limit * sizes[s] for s in full)
        t = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s for s in rest if t[s] > limit * sizes[s]}
        if not over:
            return t | {s: limit * sizes[s] for s in full}
        full |= over


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        s = rng.choice(["a"] * 6 + ["b", "c", "é", "Z", None])
        rows.append((i, rng.choice([None, "", "w# " * 3]) if i % 50 == 0 else "word " * rng.randint(1, 60), s))
    return rows + [(5, "word word", "a"), (5, "word word", "a"), (None, "no id here", "tiny"), (7000, None, "void")]


def test_mix_meets_targets(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine"))
    got = mix.takes(docs.repartition(4)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = slow_targets(size)
    taken = {}
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(0 <= want[s] - taken[s] < 1 + 1e-6 for s in want)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    again = mix.takes(docs.repartition(2)).collect()
    assert key(again) == key(got)
    # A complete epoch comes before any fraction: within a source takes differ by one epoch at most.
    for s in size:
        epochs = {r["taken"] / r["size"] for r in got if r["source"] == s and r["size"]}
        assert not epochs or max(epochs) - min(epochs) <= 1


def test_keys_of_null_ids_and_crowded_keys(spark):
    """Null ids draw by their text, and texts of one low quality, whose keys lie close, still fall apart evenly."""
    rows = [(None, f"12{i} 4 5", "s") for i in range(400)] + [(i, f"9{i}", "s") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.select("doc_id", mix.key(F.col("doc_id"), F.col("text"), mix.quality(F.col("text"))).alias("k"))
    assert keyed.where("doc_id IS NULL").select("k").distinct().count() == 400
    from spendlens.operators.ordering import range_buckets
    sizes = [r["count"] for r in range_buckets(keyed, ["k", "doc_id"], 16).groupBy("_bkt").count().collect()]
    assert max(sizes) <= 3 * sum(sizes) / 16
    got = mix.takes(docs, share=0.5).agg(F.sum("taken"), F.max("target")).first()
    assert 0 <= got[1] - got[0] < 1


def test_better_documents_come_first(spark):
    rows = [(i, "plain words only here", "s") for i in range(3000)] + [(3000 + i, "## $$ %% ##", "s") for i in range(3000)]
    got = mix.takes(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).groupBy(
        (F.col("doc_id") < 3000).alias("plain")).agg((F.sum("taken") / F.sum("size")).alias("share")).collect()
    share = {r["plain"]: r["share"] for r in got}
    assert share[True] > 2 * share[False] > 0


def test_mixed_rows_carry_the_words_taken(spark):
    rows = [(i, t, s, len(t or ""), "en") for i, t, s in corpus(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string")
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    size = {}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and r["text"].split()
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].split())
    taken = {r["source"]: r["t"] for r in mix.takes(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(size.get(s, 0) - t) <= 3 for s, t in taken.items())
    assert mix.mixed(docs.where("false")).count() == 0 and mix.takes(docs.where("false")).count() == 0


def test_a_long_document_is_cut_to_its_words(spark):
    rows = [(1, "\t" + " ".join(f"w{i}" for i in range(60_000)) + " ", "s"), (2, "x y z", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in mix.mixed(docs, share=0.4).collect()}
    taken = {r["doc_id"]: r["taken"] for r in mix.takes(docs, share=0.4).collect()}
    assert 0 < taken[1] < 60_000 and out[1].split() == [f"w{i}" for i in range(taken[1])]


def b32(x):
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


@pytest.mark.parametrize("min_bytes,chunk", [(0, 1 << 20), (6, 7)])
def test_archives_round_trip(spark, tmp_path, min_bytes, chunk):
    rows = [(1, "http://a/1", "same body é"), (2, None, "same body é"), (5, "http://a/5", "same body é"), (3, "u", None), (4, "u", ""),
            (6, "http://b", "x\r\n\r\nWARC/1.1\r\n" * 40), (7, "http://c", "tiny"), (8, "http://c", "tiny"), (9, "big", "0123456789" * 90_000),
            (None, "n", "no page id"), (5, "http://a/5", "same body é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).repartition(3)
    manifest = wc.write_archives(pages, f"file:{tmp_path}/w", min_bytes, chunk, archive_bytes=400)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    chunks = wc.read_archives(manifest.repartition(2), chunk).cache()
    got = wc.page_records(chunks).collect()
    groups = {}
    for i, _, h in rows:
        if i is not None:
            groups[h or ""] = max(groups.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        first = i is None or len(h.encode()) < min_bytes or groups[h] == i
        want.append((str(i), len(h.encode()), b32(h), "response" if first else "revisit", str(None if first else groups[h])))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    big = chunks.where("page_id = 9").orderBy("chunk_no").collect()
    assert b"".join(bytes(r["data"]) for r in big) == rows[8][2].encode()
    assert len(big) == -(-900_000 // chunk) and all(r["chunk_bytes"] <= chunk for r in big)
    half = b"".join(bytes(r["data"]) for r in big[:len(big) // 2 + 1])
    assert big[len(big) // 2]["sha1_so_far"] == base64.b32encode(hashlib.sha1(half).digest()).decode()
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
    assert len(re.findall(rb"WARC-Type: (?:response|revisit)\r\n", raw)) == len(rows)


def test_archives_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = wc.write_archives(pages, f"{tmp_path}/w")
    assert manifest.count() == 0 and wc.page_records(wc.read_archives(manifest)).count() == 0
