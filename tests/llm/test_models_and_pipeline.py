import math
import os
import re
import sys
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from spendlens.llm import langid, line_edit_dedup, pu_quality, quality_rules, queries, simhash_golay, textfeat, vector_packing

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages_of_held_out_documents(spark):
    got = langid.query(spark, SF01).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang) and all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"),
                                                  ("xyzzy words in another tongue", "zz")] * 20)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (903, "the dog " * 100_000, None), (None, "le chien", None), (1, "der Hund und die Katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine")).repartition(3)
    got = langid.identify(docs, langid.fit(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0
    assert [by[i]["lang_pred"] for i in (0, 1, 2, 3, 903, None)] == ["en", "de", "fr", "zz", "en", "fr"]
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.where("false"), none).count() == 0


def test_long_texts_score_like_short_pieces_of_them():
    import numpy as np
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    w = rng.normal(size=(1 << 8, 2))
    whole = textfeat.shares(data, 8)
    assert np.allclose(whole.sum(), 1) and np.allclose(whole @ w, textfeat.scores(data, w, 8))
    cut = np.zeros(1 << 8)
    for p in textfeat.pieces(data, 700):
        for g in textfeat.grams(p, 8):
            cut += np.bincount(g[:len(p) - 2], minlength=1 << 8)
    assert np.allclose(cut / cut.sum(), whole)


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in pu_quality.query(spark, SF01).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect() if r["quality"] is not None}
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    out = [(got[i]["score"], q) for i, q in labels.items() if i in got and held(i)]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum((s >= 0.3) == (q == 1) for s, q in out) / len(out)
    assert auc >= 0.95 and right >= 0.93, (auc, right)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 200_000), (None, "x"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    model = pu_quality.fit(docs, labels)
    got = pu_quality.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert pu_quality.fit(docs, labels.where("false")) is None
    assert {r["score"] for r in pu_quality.score(docs, None).collect()} == {0.5}
    assert pu_quality.score(docs.where("false"), None).count() == 0


def slow_grams(data, n_bits):
    """Buckets of the byte 2- and 3-grams at every place where a 3-gram begins, by plain integers."""
    out = []
    for order, spread in textfeat.SPREAD.items():
        for i in range(len(data) - 2):
            code = int.from_bytes(data[i:i + order], "big") % 2 ** 32
            out.append((code + 1) * spread % 2 ** 32 >> 32 - n_bits)
    return out


def slow_language(tree, text):
    """Margins gram by gram, then votes: most wins, then the largest sum of margins, then the later name."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    grams = slow_grams(text.lower().encode(), langid.N_BITS)
    margins = [sum(tree.weights[g][p] for g in grams) / max(1, len(grams)) + tree.bias[p] for p in range(len(tree.pairs))]

    def vote(node, names):
        if len(names) == 1:
            return names[0], 1.0
        rows = []
        for name in names:
            own = [(m if a == name else -m) for (n, a, b), m in zip(tree.pairs, margins) if n == node and name in (a, b)]
            first = [m >= 0 if a == name else m < 0 for (n, a, b), m in zip(tree.pairs, margins) if n == node and name in (a, b)]
            rows.append((sum(first), sum(own), name, min(1 / (1 + math.exp(-4 * max(-20, min(20, m)))) for m in own)))
        best = max(rows)
        return best[2], best[3]

    family, p = vote("", list(tree.groups))
    lang, q = vote(family, tree.groups[family])
    return lang, p * q


def test_languages_against_plain_counting(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    tree = langid.fit(docs)
    extra = spark.createDataFrame([(9001, None, None), (9002, "", None), (9003, "a", None), (9004, "Ab", None), (9005, "12 34", None)], docs.schema)
    rows = docs.limit(60).unionByName(extra)
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r for r in langid.identify(rows, tree).collect()}
    assert len(got) == len(text)
    for i, t in text.items():
        lang, score = slow_language(tree, t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6


def slow_quality(model, text):
    """Features by plain counting and the network by loops."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, distinct = max(1, len(words)), len(set(words))
    x = [math.log1p(len(words)), distinct / n, math.log1p(distinct) / math.log1p(n), sum(a == b for a, b in zip(words, words[1:])) / n,
         min(30.0, (len(data) - data.count(b" ")) / n), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, 20 / n)]
    x += [math.log1p(100 * sum(data.count(c.encode()) for c in chars) / max(1, len(data))) for chars in pu_quality.CLASSES]
    grams = slow_grams(data, pu_quality.N_BITS)
    x += [100 * grams.count(b) / max(1, len(grams)) for b in range(1 << pu_quality.N_BITS)]
    z = [max(-6.0, min(6.0, (v - m) * s)) for v, m, s in zip(x, model.mean, model.scale)]
    w, b, u, c = model.params
    hidden = [math.tanh(sum(v * w[i][j] for i, v in enumerate(z)) + b[j]) for j in range(len(b))]
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(h * k for h, k in zip(hidden, u)) + c[0]))))


def test_quality_against_plain_counting(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    model = pu_quality.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet").select("doc_id", "quality"))
    rows = docs.limit(40).unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "ab"), (9004, "x\n\nx |#|")], docs.schema))
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r["score"] for r in pu_quality.score(rows, model).collect()}
    assert len(got) == len(text) and all(abs(got[i] - slow_quality(model, t)) < 1e-6 for i, t in text.items())


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sql = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in sql.description]
    key = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    got = queries.QUERIES[name](spark, SF001)
    assert sorted(got.columns) == sorted(cols)
    assert key(tuple(r) for r in got.select(*cols).collect()) == key(sql.fetchall())


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    from test_near_duplicates import slow_dedup, slow_fingerprint, union_find
    from test_rules_and_secrets import measures
    from itertools import combinations
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "mixing", "packing"]
    src = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", None, 0), (902, "too short", None, "s", 9)], src.schema)
    docs = src.unionByName(extra).unionByName(src.limit(2).withColumn("doc_id", F.col("doc_id") + 2000))
    rows = {}
    step = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = step.collect()
        stage(spark, step, "").write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert step.columns == docs.columns
        rows[name] = (before, step.collect())
    before, after = rows["quality_rules"]

    def fine(t):
        n, chars, symbols, dup, repeat = measures(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n")) if t else 0
        return n >= 10 and 100 * repeat <= 20 * n and 10 * symbols <= n and 2 * dup <= lines and 2 * n <= chars <= 20 * n \
            and 10 * t.count("!") <= 3 * n

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["text"] and fine(r["text"]))
    before, after = rows["line_dedup"]
    want = [x for x, y in zip(slow_dedup([(r["doc_id"], r["text"]) for r in before], 2, 20),
                              sorted(((r["doc_id"], r["text"]) for r in before), key=str))]
    kept = {i: t for i, t in want if t}
    assert {r["doc_id"]: r["text"] for r in after} == kept
    before, after = rows["simhash_dedup"]
    fp = {r["doc_id"]: slow_fingerprint(r["text"]) for r in before}
    roots = union_find(sorted(fp), [(a, b) for a, b in combinations(sorted(fp), 2) if bin(fp[a] ^ fp[b]).count("1") <= 2])
    assert sorted(r["doc_id"] for r in after) == sorted(set(roots.values()))
    before, after = rows["mixing"]
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rs)
    assert abs(words(after) - 1.5 * words(before)) <= 1 + len({r["source"] for r in before})
    packed = rows["packing"][1]
    cache = vector_packing.WordCache(vector_packing._word_bpe())
    assert sum(r["length"] for r in packed) == sum(len(cache.ids(r["text"])) // 4 + 1 for r in rows["packing"][0])


#: Names that the operators use inside, or that need quoting.
CLASHING = ["_no", "n_lines", "n_dropped", "n_words", "_hash", "_id", "_kept", "_row", "row", "_d", "_rest", "_key", "_size", "size", "taken",
            "_copy", "fp", "root", "low", "id", "a.b", "odd `name", "failed_bits", "target"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_of_any_name(spark, name, stage):
    text = "the quick brown fox jumps over a lazy dog near the river bank {}"
    rows = [(i, text.format(i) + f"\nand a line of its own {i * 7919}", "en", "s", 9) for i in range(30)]
    rows += [(None, text.format("x"), "en", None, 9), (None, text.format("y"), "en", None, 9), (3, text.format("z"), None, "s", 9),
             (40, None, "en", "s", 0), (41, "", "en", "s", 0), (0, rows[0][1], "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    got, plain = stage(spark, wide, ""), stage(spark, docs, "")
    assert got.columns == wide.columns and plain.columns == docs.columns
    rows, want = got.collect(), plain.collect()
    cut = lambda rs: sorted(repr(tuple(r)[:5]) for r in rs)
    assert rows and cut(rows) == cut(want)
    assert all(tuple(r)[5:] == tuple(f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING) for r in rows)
    assert stage(spark, wide.where("false"), "").count() == 0


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF001).count() > 0
