import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from spendlens.llm import source_audit as S, toxicity as T

SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


def slow_audit(rows, least=30, smooth=5, top=50):
    """rows: (text, lang, source).  The contract in plain Python integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    held, count, out = defaultdict(Counter), defaultdict(Counter), []
    for ts, (_, lang, source) in zip(terms, rows):
        held[lang].update(set(ts))
        count[lang, source].update(ts)
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted({s for _, l, s in rows if l == lang})

        def shares(c):
            total = sum(c[t] for t in kept) + smooth * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + smooth) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", own)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus():
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(120)] + ["Zażółć", "ÉCOLE", "日本語", "a", "aa"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=None)), ["en", "de", None, ""][i % 4], ["s1", "s2", None, "ß", "s10"][i % 5]) for i in range(400)]
    rows += [(900, None, "en", "s1"), (901, "", "xx", "only"), (902, "1234 -- !!", "yy", None), (903, "rare words", "yy", "b"), (None, "WA wa Wa\x00wb_wc`wd{we", "en", "hot")]
    return rows + [(i % 7, "wa wb " * 3000, "en", "hot") for i in range(40)]


def test_audit_against_plain_integers(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("shard", F.lit(9)).repartition(5)
    want = slow_audit([r[1:] for r in rows])
    assert audited(S.audit(docs)) == want and any(r[2] == "term" for r in want)
    assert audited(S.audit(docs, shard_rows=40)) == want
    assert audited(S.audit(docs, least_docs=3, top=4)) == slow_audit([r[1:] for r in rows], 3, 5, 4)


def test_audit_sql_against_plain_integers():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r for r in corpus() if not (r[1] and "\x00" in r[1])])
    cur = con.execute(S.SQL)
    at = [[c[0] for c in cur.description].index(c) for c in ("lang", "source", "part", "item", "value", "rank")]
    assert sorted(tuple(r[i] for i in at) for r in cur.fetchall()) == slow_audit([r[1:] for r in corpus() if not (r[1] and "\x00" in r[1])])


def test_audit_of_an_empty_table_and_counts(spark):
    none = spark.createDataFrame([], DOCS)
    assert S.audit(none).count() == 0 and S.term_counts(none).count() == 0
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in S.term_counts(
        spark.createDataFrame([("A a b", None, "s"), ("a", "", "s"), (None, "", "t")], "text string, lang string, source string")).collect()}
    assert got == {("", "s", ""): (0, 2), ("", "s", "a"): (3, 2), ("", "s", "b"): (1, 1), ("", "t", ""): (0, 1)}


def test_counts_in_small_slices_are_merged(monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": ["b a", "a", "", "c a"], "lang": ["x", "x", "y", "x"], "source": ["s"] * 4})
    one = S._counted(batch)
    two = S._merged([S._counted(batch.slice(0, 2)), S._counted(batch.slice(2, 2))])
    key = lambda t: sorted(map(tuple, (r.values() for r in t.select([*S.KEYS, "n", "docs"]).to_pylist())))
    assert key(one) == key(two)


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    total = rng.integers(1, 9 * 10 ** 15, 500)
    count = (total * rng.random(500)).astype(np.int64)
    assert S.share(count, total).tolist() == [1 + 10 ** 9 * c // t for c, t in zip(count.tolist(), total.tolist())]


def third(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in T.query(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 10_000 and all(r["held_out"] == third(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()]
    out = [(got[i]["score"], t) for i, t in labels if third(i) and t is not None]
    bad, fine = [s for s, t in out if t], [s for s, t in out if not t]
    auc = sum((b > f) + 0.5 * (b == f) for b in bad for f in fine) / (len(bad) * len(fine))
    assert auc >= 0.95 and sum(s >= 0.7 for s in bad) >= 0.8 * len(bad) and sum(s >= 0.7 for s in fine) <= 0.03 * len(fine)


def test_unseen_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("etaoinshrdlu"), 6)) for _ in range(200)]
    texts, label = [], []
    for i in range(200):
        text = [*rng.choice(words, 40)] + (["blockhead"] * 2 if i % 4 == 0 else [])
        texts.append(" ".join(rng.permutation(text)))
        label.append(int(i % 4 == 0))
    model = T.fit_bags(*zip(*map(T.bag, texts)), np.array(label))
    plain = " ".join(rng.choice(words, 40))
    scored = [T.margin(f"{plain} {w} {w}", *model.folded()) for w in ("blockhead", "BLOCKHEADD", "blokhead blockhed", "nothing")]
    assert min(scored[:3]) > 0 > scored[3]


def test_bags_by_plain_python():
    def slow(text):
        n = Counter()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode()):
            n[1, w] += 1
            for k in T.ORDERS:
                n.update((k, b" ".join([b"", w, b""])[i:i + k]) for i in range(len(w) + 3 - k))
        return n

    texts = ["", "a", "ab ab", "Stupid, stupid ßtrange x2!", "é" * 40, "word-" * 50 + "w" * 100, "\x00 q\x7fr"]
    for t in texts:
        rows, share = T.bag(t)
        want = sorted(slow(t).values())
        assert abs(share.sum() - bool(want)) < 1e-9 and len(T.subwords(T.prepared(t))) == sum(want)
    for size in (1, 7, 64):
        assert all(sorted(np.concatenate([T.subwords(p) for p in T.pieces(T.prepared(t), size)]).tolist()) == sorted(T.subwords(T.prepared(t)).tolist()) for t in texts)
    # Equal grams meet in one row, and scoring is the mean over rows.
    weights = np.random.default_rng(4).normal(size=1 << T.N_BITS)
    for t in texts:
        rows, share = T.bag(t)
        assert abs(T.margin(t, weights, 0.5) - 0.5 - (weights[rows] * share).sum()) < 1e-9


def test_folded_scores_equal_the_softmax():
    model = T.fit_bags(*zip(*map(T.bag, ["bad words here", "fine words there"] * 4)), np.array([1, 0] * 4), steps=5)
    rows, share = T.bag("bad words there")
    p = T.softmax((share @ model.table[rows] @ model.classes + model.bias)[None])[0, 1]
    assert abs(p - 1 / (1 + np.exp(-T.margin("bad words there", *model.folded())))) < 1e-9


def test_toxicity_edges(spark):
    rows = [(i, "you utter blockhead" if i % 2 else "good morning to all") for i in range(60)]
    rows += [(None, "you utter blockhead"), (100, None), (101, ""), (102, "12 !?"), (1, "another text of that id"), (103, "good morning " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit(5)).withColumn("label", F.lit("x")).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (100, None), (7, 0), (500, 1)], "doc_id int, toxic int")
    model = T.fit(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[None] > 0.5 > by[0] and by[103] < 0.5 and by[100] == by[101]
    assert T.fit(docs, labels.where("toxic = 1")) is None and T.fit(docs.where("false"), labels) is None
    assert {r["score"] for r in T.score(docs, None).collect()} == {0.5}
    assert T.score(docs.where("false"), model).count() == 0
