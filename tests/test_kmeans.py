"""Relational k-means against a plain Lloyd run, and against its SQL."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import pytest

from spendlens.operators.kmeans import DIGITS, kmeans_sql, relational_kmeans


def uniform(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52


def slow_kmeans(vectors, rows, k, tries, iterations, seed):
    """One try after another with dictionaries: best try, cost, and cluster of each label."""
    x = {label: {t: w for lb, t, w in vectors if lb == label} for label in rows}

    def apart(a, b):
        return max(0.0, round(sum(v * v for v in a.values()) + sum(v * v for v in b.values()) - 2 * sum(v * b.get(t, 0.0) for t, v in a.items()), DIGITS))

    runs = []
    for t in range(tries):
        d, centres = dict.fromkeys(rows, 1.0), []
        for r in range(k):
            race = {lb: -math.log(uniform(seed, t, r, lb)) / (rows[lb] * d[lb]) for lb in rows if d[lb] > 0}
            if not race:
                break
            pick = min(race, key=race.get)
            centres.append(dict(x[pick]))
            d = {lb: min(d[lb], apart(x[lb], x[pick])) for lb in rows}
        assigned = None
        for _ in range(iterations + 1):
            far = {lb: [math.inf if c is None else apart(x[lb], c) for c in centres] for lb in rows}
            now = {lb: far[lb].index(min(far[lb])) for lb in rows}
            cost = sum(rows[lb] * min(far[lb]) for lb in rows)
            if now == assigned:
                break
            assigned = now
            sums, size = [defaultdict(float) for _ in centres], [0] * len(centres)
            for lb, c in now.items():
                size[c] += rows[lb]
                for term, w in x[lb].items():
                    sums[c][term] += rows[lb] * w
            centres = [{t: s / n for t, s in c.items()} if n else None for c, n in zip(sums, size)]
        runs.append((round(cost, 6), t, assigned))
    return min(runs, key=lambda r: r[:2])


def made(n, n_terms, seed):
    rnd = random.Random(seed)
    rows = {f"l{i:03d}": rnd.randint(1, 9) for i in range(n)}
    vectors = [(lb, f"t{t}", rnd.uniform(0.1, 1)) for lb in rows for t in rnd.sample(range(n_terms), rnd.randint(0, min(4, n_terms)))]
    return vectors, rows


@pytest.mark.parametrize("n, n_terms, k, seed", [(40, 12, 4, 1), (25, 200, 5, 2), (6, 3, 6, 3), (1, 2, 2, 4)])
def test_against_plain_lloyd(spark, n, n_terms, k, seed):
    vectors, rows = made(n, n_terms, seed)
    cost, best, want = slow_kmeans(vectors, rows, k, 3, 8, seed)
    v = spark.createDataFrame(vectors or [("none", "t", 1.0)], "label string, term string, weight double").where("label <> 'none'").repartition(3)
    got = relational_kmeans(v, spark.createDataFrame(list(rows.items()), "label string, rows long"), k, 3, 8, seed).collect()
    assert {r["label"]: r["cluster"] for r in got} == want
    assert {(round(r["cost"], 6), r["try"]) for r in got} == {(cost, best)} and {r["label"]: r["rows"] for r in got} == rows
    assert abs(sum(r["rows"] * r["d"] for r in got) - cost) < 1e-5


def test_sql_against_plain_lloyd():
    vectors, rows = made(30, 10, 7)
    con = duckdb.connect()
    con.execute("CREATE TABLE v (label VARCHAR, term VARCHAR, weight DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?, ?)", vectors)
    con.execute("CREATE TABLE l (label VARCHAR, rows BIGINT)")
    con.executemany("INSERT INTO l VALUES (?, ?)", list(rows.items()))
    got = con.execute("WITH " + kmeans_sql(4, 3, 8, 7) + " SELECT label, cluster, round(cost, 6), try FROM km").fetchall()
    cost, best, want = slow_kmeans(vectors, rows, 4, 3, 8, 7)
    assert {r[0]: r[1] for r in got} == want and {(r[2], r[3]) for r in got} == {(cost, best)}


def test_equal_vectors_and_no_labels(spark):
    v = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 1.0), ("c", "t", 1.0)], "label string, term string, weight double")
    labels = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "label string, rows long")
    got = relational_kmeans(v, labels, 3, 2).collect()
    assert {(r["cluster"], r["d"], r["cost"]) for r in got} == {(0, 0.0, 0.0)} and len(got) == 3
    assert relational_kmeans(v.where("false"), labels.where("false"), 2, 2).count() == 0


def test_no_terms_on_the_driver():
    """Neither fit collects rows: all that reaches the driver is a hash, and the collapse's counts."""
    import inspect
    from spendlens.operators import categories, kmeans
    text = inspect.getsource(kmeans) + inspect.getsource(categories)
    assert "collect()" not in text and "toPandas" not in text and "CountVectorizer" not in text
