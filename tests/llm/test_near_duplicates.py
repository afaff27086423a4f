import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from spendlens.llm import line_edit_dedup as led, pivot_index as pv, simhash_golay as sg
from spendlens.llm.graph import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(-5, i) for i in range(2000, 2200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {n: c for n, c in union_find(used, edges).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_lists_meet_within_two_bits():
    rem, table = sg.decoding_table()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    near = sg.near_codewords(words, rem, table)
    assert {len(set(r)) for r in near} <= {1, 6}
    for flips in [(i,) for i in range(23)] + list(combinations(range(23), 2)):
        other = sg.near_codewords(words[:200] ^ sum(1 << f for f in flips), rem, table)
        assert all(set(a) & set(b) for a, b in zip(near[:200], other))


def slow_fingerprint(t):
    w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    runs = [w[i:i + 3] for i in range(len(w) - 2)] or ([w] if w else [])
    h = [xxhash.xxh64(b" ".join(r), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed):
    rng = random.Random(seed)
    out = [None, "", "  \n", "one", "ONE", "one two", "É a b", "é a b", "x " * 20_000]
    for _ in range(12):
        w = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(99)}"
            out.append(" ".join(v))
    return out + out[:20]


@pytest.mark.parametrize("hot_key", [sg.HOT_KEY, 1])
def test_simhash_components_against_all_pairs(spark, hot_key):
    rows = [(i, t, "z") for i, t in enumerate(near_texts(5))] + [(3, "one", "z"), (None, "only here x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    got = sg.near_duplicates(docs, hot_key=hot_key).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    assert any(fps[i] != fps[j] for i, j in links)
    roots = union_find(range(len(rows)), links)
    low = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            low[r] = min(low.get(r, 10 ** 9), rows[i][0])
    want = sorted((str(rows[i][0]), fps[i], str(low.get(roots[i]))) for i in range(len(rows)))
    assert sorted((str(r["doc_id"]), r["fp"] % 2 ** 64, str(r["component_id"])) for r in got) == want


def test_links_at_any_two_bits_are_found(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b for b in base} | {b ^ (1 << i) ^ (1 << j) for b in base[:10] for i, j in [rng.sample(range(64), 2) for _ in range(60)]}
    signed = sorted(f - 2 ** 64 if f >> 63 else f for f in fps)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) % 2 ** 64).count("1") <= 2]
    want = union_find(signed, links)
    for hot_key in (sg.HOT_KEY, 3):
        got = {r["node"]: r["component"] for r in components(sg.links(frame, hot_key=hot_key)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_simhash_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(4, "a b c d", "s"), (2, "A b c d", "s"), (2, "A b c d", "s"), (9, None, "s"), (8, "", None)],
                                 "doc_id long, text string, source string")
    kept = sg.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 8]
    assert sg.stage(spark, docs.where("false"), "").count() == 0


def test_simhash_stage_keeps_one_row_of_each_group_whatever_its_id(spark):
    rows = [(None, "one text of some words"), (None, "quite another thing to read"), (None, "Quite another thing to read"),
            (5, "red green blue yellow white"), (5, "alpha beta gamma delta"), (3, "Red green blue yellow white"),
            (None, "alpha beta gamma Delta"), (6, "alone here"), (6, "alone here"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in sg.stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, "one text of some words"), (None, "quite another thing to read"), (3, "red green blue yellow white"),
                          (5, "alpha beta gamma delta"), (6, "alone here"), (None, "")], key=str)


def test_banded_edit_distance_against_builtin(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a = [rng.choice("abcé𝄞") for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = rng.choice(["", "a", "é"])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").select(F.levenshtein("a", "b").alias("want"), F.expr(
        led.codes("a")).alias("ca"), F.expr(led.codes("b")).alias("cb"), "a", "b")
    for edits in (1, 2, 3):
        got = df.select("want", "a", "b", F.expr(led.edit_distance("ca", "cb", edits)).alias("got")).collect()
        bad = [r for r in got if (r["want"] <= edits) != (r["got"] <= edits) or r["want"] <= edits and r["want"] != r["got"]]
        assert not bad, bad[:3]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_dedup(rows, edits, min_chars):
    """Texts by (id, text); rows that share an id stand at the same place."""
    place = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            at = (i is not None, i or 0, n)
            place[line] = min(place.get(line, at), at)
    long = [x for x in place if len(x) >= min_chars]
    gone = {b for a in long for b in long if a != b and place[a] < place[b] and abs(len(a) - len(b)) <= edits
            and levenshtein(a, b) <= edits}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        lines = t.split("\n")
        stay = [x for n, x in enumerate(lines) if len(x) < min_chars or x not in gone and place[x] == (i is not None, i or 0, n)]
        out.append((i, "\n".join(stay) if len(stay) < len(lines) else t))
    return sorted(out, key=str)


def lined(seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 40))) for _ in range(25)]
    rows = [(50, None), (51, ""), (52, "\n\n"), (None, stock[0] + "\nonly in the one without an id, a long line")]
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(stock))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(x) + 1)
                x[k:k + rng.randrange(2)] = rng.choice(["", "a", "é", "z"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    return rows + [rows[10]]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_dedup_against_all_pairs(spark, edits):
    rows = lined(edits)
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars long, drops string")
    got = led.deduplicated(docs.repartition(3), edits, min_chars=12).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == slow_dedup(rows, edits, 12)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    assert sum(r["n_dropped"] for r in got) > 20


def test_line_dedup_edges(spark):
    assert led.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    many = "\n".join(f"line number {i} of a rather long document {'x' * (i % 50)}{i * 7919}" for i in range(3000))
    rows = [(1, many), (2, many), (3, "short\nshort")]
    got = {r["doc_id"]: r for r in led.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["text"] == "" and got[2]["n_dropped"] == 3000 and got[3]["text"] == "short\nshort"
    kept = led.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text"]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(12)
    stock = ["".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(20)]
    low = -(2 ** 63)
    rows = [(i, "\n".join(rng.choice(stock) + rng.choice(["", "", "x"]) for _ in range(4)) + f"\nonly here {n} " + "".join(
        rng.choice("ijklmnop") for _ in range(30))) for n, i in enumerate([None] * 8 + [7] * 8 + [-3] * 4 + [low] * 2 + [2 ** 63 - 1] * 2 + [1, 2, 3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = {r["text"]: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"] % 2 ** 64 if r["doc_id"] is not None else r["h"])
          for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    place = {}
    for _, t in rows:
        for n, x in enumerate(t.split("\n")):
            place[x] = min(place.get(x, (at[t], n)), (at[t], n))
    gone = {b for a in place for b in place if place[a] < place[b] and abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2}
    want = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if x not in gone and place[x] == (at[t], n))) for i, t in rows]
    got = led.deduplicated(docs.repartition(3), min_chars=12).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all("only here" in r["text"] for r in got)


def test_query_compares_short_lines(spark, tmp_path):
    rows = [(1, "All rights reserved.\nfirst\nReleased under the MIT License."), (2, "All rights reserved.\nsecond\nreleased under the MIT License"),
            (3, "To.\nLicensed under CC BY-NC 4.0."), (4, "To.\nLicensed under CC BY-SA 4.0.\nLicensed under GNU GPL 3.0.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in led.query(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "second", 3: rows[2][1], 4: "To.\nLicensed under GNU GPL 3.0."}


def clustered(seed, cosine, groups=25, size=12, dim=64, noise=400):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(noise)]
    for _ in range(groups):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            r = rng.normal(size=dim)
            r -= (r @ c) * c
            angle = np.arccos(np.sqrt(cosine))          # members meet each other at about the cosine
            out.append(np.cos(angle) * c + np.sin(angle) * r / np.linalg.norm(r))
    return [v.astype(np.float32) for v in out]


def brute_links(vs, threshold=0.9):
    x = np.array(vs, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return [(i, j) for i, j in zip(*np.nonzero(np.triu(s >= threshold, 1)))]


@pytest.mark.parametrize("block", [1024, 5])
def test_vector_links_and_recall(spark, block):
    vs = clustered(1, 0.97) + clustered(2, 0.92, noise=0)
    vs += vs[-3:] + [v * np.float32(2) for v in vs[:3]]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vs)], "vec_id long, embedding array<float>, n long")
    got = {r["vec_id"]: r for r in pv.near_duplicates(df.repartition(4), block=block).collect()}
    links = brute_links(vs)
    want = np.bincount(np.array(links).ravel(), minlength=len(vs))
    have = np.array([got[i]["n_links"] for i in range(len(vs))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    clear = brute_links(vs, 0.96)
    roots = union_find(range(len(vs)), links)
    assert all(got[i]["component_id"] >= roots[i] for i in got)
    assert sum(got[int(i)]["component_id"] == got[int(j)]["component_id"] for i, j in clear) >= 0.99 * len(clear)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_links_in_dense_regions_are_found(spark):
    """A third in one cluster of distinct vectors, a third in a topic at 0.8 with linked pairs in it."""
    rng = np.random.default_rng(4)

    def away(x, base):                                  # unit vectors orthogonal to the unit rows of base
        r = rng.normal(size=x.shape)
        for b in base:
            r -= (r * b).sum(axis=1, keepdims=True) * b
        return r / np.linalg.norm(r, axis=1, keepdims=True)

    n, dim = 10_000, 64
    c, t = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    c, t = np.broadcast_to(c, (n, dim)), np.broadcast_to(t, (n // 2, dim))
    e = away(t, [t])
    f = 0.6 * e + 0.8 * away(t, [t, e])                 # cosine 0.8 + 0.2 * 0.6 in the topic
    x = np.concatenate([np.sqrt(0.92) * c + np.sqrt(0.08) * away(c, [c]), np.sqrt(0.8) * t + np.sqrt(0.2) * e,
                        np.sqrt(0.8) * t + np.sqrt(0.2) * f, rng.normal(size=(n, dim))]).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = np.concatenate([(u[s:s + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for s in range(0, len(u), 1000)])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<float>")
    got = pv.near_duplicates(df.repartition(8)).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert (got <= want).all() and want[:n].sum() > 10 ** 7 and want[n:2 * n].sum() >= n
    assert got[:n].sum() >= 0.98 * want[:n].sum() and got[n:2 * n].sum() >= 0.98 * want[n:2 * n].sum()


def test_prefixes_grow_with_the_pivots():
    rng = np.random.default_rng(6)
    x = pv._units(rng.normal(size=(20_000, 64)))
    few, many = pv.thinned(x[:100], 100, 0.7), pv.thinned(x, 8000, 0.7)
    assert len(few) == 100 and len(many) == 8000
    assert 7 <= pv.prefix_length(x[-512:], few, 0.9, 7) < pv.prefix_length(x[-512:], many, 0.9, 7)


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, one), (3, None), (4, [0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]),
            (8, [1.0, float("inf"), 3.0]), (9, [1.0, 2.0]), (10, []), (None, one), (2, one), (11, [1e-30, 2e-30, 3e-30]), (12, [-1.0, -2.0, -3.0])]
    got = pv.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    for r in got:
        same = r["vec_id"] in (1, 2, 11, None)
        assert (r["n_links"], r["component_id"]) == ((4, 1) if same else (0, r["vec_id"])), r
    assert pv.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_prefixes_grow_past_the_first_limit():
    """At a low threshold sixteen nearest pivots do not do; the length found gives the recall on links of its own."""
    import numpy as np
    from spendlens.llm import pivot_index as pv
    rng = np.random.default_rng(8)
    x, pivots = pv._units(rng.normal(size=(300, 48))), pv._units(rng.normal(size=(600, 48)))
    k = pv.prefix_length(x, pivots, 0.7, 7)
    assert k > 16
    side = rng.normal(size=x.shape)
    side = pv._units(side - (side * x).sum(axis=1, keepdims=True) * x)
    near = [np.argsort(-(v @ pivots.T), axis=1)[:, :k] for v in (x, 0.7 * x + np.sqrt(1 - 0.49) * side)]
    met = [len(set(a) & set(b)) >= 2 for a, b in zip(*near)]
    assert np.mean(met) >= 0.97
    assert pv.prefix_length(x, pivots[:5], 0.7, 7) == 5 and 7 <= pv.prefix_length(x, pivots[:9], 0.01, 7) <= 9
