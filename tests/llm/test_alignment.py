import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendlens.llm import token_alignment as T

SF001 = "/root/testdata/sf0.001"
TRICKY = ["Hello  world ▁ x", "a", " ", "  lead and trail  ", "<|endoftext|> <s> </s> <unk>", "café naïve ångström 12345 67",
          "你好，世界 \U0001f600\U0001f601 emoji", "tab\tnew\nline\r\n\n  end", "x y  z \x00 \x1c q", "it's don't 'quoted' we'll",
          "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ไทยภาษา" * 40, "deadbeef0123" * 30, "שלום العربية",
          "é combining ​zero", "﻿bom", "a   b", "! ? . ,", "x " * 500]


def byte_chars():
    own = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, k = {}, 0
    for b in range(256):
        if b in own:
            table[chr(b)] = b
        else:
            table[chr(256 + k)] = b
            k += 1
    return table


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def slow_groups(text, a, b):
    """Groups by the set of common ends, from ids of whole texts."""
    if not text:
        return [], [], []
    chars, want = byte_chars(), (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False)
    ids_a, bytes_a = x.ids, [bytes(chars[c] for c in a.id_to_token(i)) for i in x.ids]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in common]
    for ids, ends, k in ((ids_a, ends_a, 0), (ids_b, ends_b, 1)):
        g = 0
        for i, e in zip(ids, ends):
            while e > common[g]:
                g += 1
            groups[g][k].append(i)
    return ids_a, ids_b, groups


def slow_statistics(texts, a, b):
    all_groups = [slow_groups(t, a, b) for t in texts]
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for _, _, groups in all_groups]
    count = Counter(p for link in links for p in link)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(len(ia), len(ib), len(groups), sum(link.values()), sum(m for p, m in link.items() if count[p] == best[p[0]]),
             sum(m * count[p] for p, m in link.items()),
             hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if ia else "")
            for (ia, ib, groups), link in zip(all_groups, links)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_whole_texts(spark, tokenizers):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = dict(zip((i for i, _ in docs), slow_statistics([t for _, t in docs], *tokenizers)))
    got = T.query(spark, SF001).collect()
    assert len(got) == len(docs) and {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want


@pytest.mark.parametrize("block", [T.BLOCK, 50])
def test_tricky_texts_nulls_repeats_and_other_columns(spark, tokenizers, block):
    texts = [*TRICKY, None, "", TRICKY[5], "the cat " * 3000, "ไทย" * 900]
    ids = [*range(len(texts) - 2), None, 3]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in zip(ids, texts)], "doc_id int, text string, block int, place string").repartition(3)
    got = sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in T.link_statistics(docs, block=block).collect()), key=repr)
    assert got == sorted(((i, *s) for i, s in zip(ids, slow_statistics(texts, *tokenizers))), key=repr)


def test_alignments_hold_the_groups(spark, tokenizers):
    docs = spark.createDataFrame(list(enumerate([*TRICKY, None])), "doc_id long, text string")
    for r in T.alignments(docs).collect():
        ia, ib, groups = slow_groups(dict(enumerate(TRICKY)).get(r["doc_id"]), *tokenizers)
        assert (r["a_ids"], r["b_ids"]) == (ia, ib)
        cut = lambda ids, ends: [ids[s:e] for s, e in zip([0, *ends], ends)]
        assert list(zip(cut(ia, r["a_ends"]), cut(ib, r["b_ends"]))) == [tuple(g) for g in groups]


def test_wide_groups_by_distinct_ids(tokenizers, monkeypatch):
    texts = [*TRICKY, "ไทยภาษา" * 300, "x\u200b\U0001f601" * 50]
    want = [Counter((x, y) for g, h in slow_groups(t, *tokenizers)[2] for x in g for y in h) for t in texts]
    for wide in (T.WIDE, 2, 0):
        monkeypatch.setattr(T, "WIDE", wide)
        got = T.Aligned(T.tokenizer_pair(*T._paths(None, None)), texts).pairs()
        assert [dict(zip([divmod(int(k), 1 << 32) for k in keys], n.tolist())) for keys, n in got] == [w for w in want if w]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.link_statistics(none).count() == 0 and T.alignments(none).count() == 0


def test_shared_cuts_of_random_ends():
    rng = np.random.default_rng(3)
    for density in (0.02, 0.3, 0.9):
        sizes = rng.integers(1, 400, 30)
        ends, at = [[], []], [[0], [0]]
        for n, base in zip(sizes, np.cumsum(sizes) - sizes):
            for k in (0, 1):
                some = np.nonzero(rng.random(n) < density)[0] + 1
                ends[k] += (base + np.union1d(some, [n])).tolist()
                at[k].append(len(ends[k]))
        a, b = map(np.array, ends)
        (p, q) = (np.array(x) for x in at)
        last_a, last_b = T.shared_cuts(a, b, p[:-1], p[1:], q[:-1], q[1:])
        assert a[last_a].tolist() == b[last_b].tolist() == np.intersect1d(a, b).tolist()


def test_parts_are_encoded_like_whole_texts(tokenizers, monkeypatch):
    pair = T.tokenizer_pair(*T._paths(None, None))
    assert pair.by_word and pair.plain is not None
    texts = [*TRICKY, "Ünïcode wörds, and-more: it's x2 ¼ ²³ ª º × ÷ ß ſ ƀ don't\tTab\r\n  end"]
    for part in (T.PART, 1):
        monkeypatch.setattr(T, "PART", part)
        for t, got in zip(texts, pair.encode(texts)):
            ia, ib, _ = slow_groups(t, *tokenizers)
            assert (got is None) == (not ia) and (got is None or (got[0].tolist(), got[1].tolist()) == (ia, ib))


def test_plain_characters_one_by_one(tokenizers):
    """Every character that takes the faster way, between letters, digits, signs and spaces."""
    pair = T.tokenizer_pair(*T._paths(None, None))
    texts = [f"a{c}b {c}c 1{c}2 .{c}! {c} {c}{c}  {c}'s" for c in map(chr, [9, 10, 13, *range(32, 127), *range(161, 592)])]
    assert all(T.PLAIN.fullmatch(t) for t in texts)
    assert [pair.plain.encode_ordinary(" " + t) for t in texts] == [tokenizers[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
