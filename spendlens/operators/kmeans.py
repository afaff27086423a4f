"""Relational k-means: sparse vectors as rows, centres as a table by term.

Vectors are rows ``(label, term, weight)`` with a number of rows per label.  Assignment joins them to the
centres by term and adds up dot products per label; a centre update joins the assignments back by label and
averages per term.  Neither the vocabulary nor a centre is ever held by the driver or by one row, so both
may grow with the data.  All tries go together: they share every join.

Centres start by k-means++ (Arthur & Vassilvitskii 2007): a try draws its next centre with a probability
in proportion to rows times squared distance.  The draw is an exponential race with uniform numbers from
md5, so any engine repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Distances are compared after rounding, so that the order of summation decides no tie.
DIGITS = 9


def race_key(seed: int, draw: int, weight: Column, label: Column) -> Column:
    """Exponential of rate ``weight`` from the md5 of seed, try (column ``try``), draw and label; null for weight 0."""
    text = F.concat_ws(":", F.lit(seed), F.col("try"), F.lit(draw), label)
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)
    return F.when(weight > 0, -F.log(u) / weight)


def _seeds(by_term: DataFrame, labels: DataFrame, k: int, tries: int, seed: int) -> DataFrame:
    """``(try, cluster, label)``: the labels whose vectors are the first centres."""
    state = labels.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("d", F.lit(1.0))
    picked = None
    for r in range(k):
        key = race_key(seed, r, F.col("rows") * F.col("d"), F.col("label"))
        pick = state.groupBy("try").agg(F.min_by(F.struct("label", "norm"), key).alias("_p"), F.min(key).alias("_key"))
        pick = checkpointed(pick.where("_key IS NOT NULL").select("try", F.col("_p.label").alias("_label"), F.col("_p.norm").alias("_norm")))
        here = pick.select("try", F.lit(r).alias("cluster"), F.col("_label").alias("label"))
        picked = here if picked is None else picked.unionByName(here)
        if r == k - 1:
            break
        # A label has few terms, so the new centres are a small table that meets all vectors by term.
        centre = by_term.join(F.broadcast(pick), F.col("label") == F.col("_label")).select("try", "term", F.col("weight").alias("_c"))
        dots = by_term.join(centre, "term").groupBy("try", "label").agg(F.sum(F.col("weight") * F.col("_c")).alias("_dot"))
        state = state.join(F.broadcast(pick.select("try", "_norm")), "try", "left").join(dots, ["try", "label"], "left")
        d = F.round(F.col("norm") + F.col("_norm") - 2 * F.coalesce("_dot", F.lit(0.0)), DIGITS)
        state = checkpointed(state.select("try", "label", "rows", "norm", F.when(F.col("_norm").isNull(), F.col("d")).otherwise(
            F.least("d", F.greatest(F.lit(0.0), d))).alias("d")))
    return picked


def _centres(by_label: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """``(try, term, c0 ...)``: mean weight of each term in each cluster; a cluster without labels has no centre."""
    sizes = assigned.groupBy("try").agg(*[F.sum(F.when(F.col("cluster") == j, F.col("rows"))).alias(f"_n{j}") for j in range(k)])
    met = by_label.join(assigned.select("label", "try", "cluster", "rows"), "label")
    part = F.col("rows") * F.col("weight")
    sums = met.groupBy("try", "term").agg(*[F.sum(F.when(F.col("cluster") == j, part)).alias(f"_s{j}") for j in range(k)])
    return sums.join(F.broadcast(sizes), "try").select(         # a row per try
        "try", "term", *[F.when(F.col(f"_n{j}").isNotNull(), F.coalesce(f"_s{j}", F.lit(0.0)) / F.col(f"_n{j}")).alias(f"c{j}") for j in range(k)])


def _assigned(by_term: DataFrame, labels: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """``(label, try, cluster, rows, d)``: nearest centre, the lower number on ties, and squared distance."""
    norms = centres.groupBy("try").agg(*[F.sum(F.col(f"c{j}") * F.col(f"c{j}")).alias(f"_n{j}") for j in range(k)])
    dots = by_term.join(centres, "term").groupBy("label", "try").agg(*[F.sum(F.col("weight") * F.col(f"c{j}")).alias(f"_d{j}") for j in range(k)])
    met = labels.crossJoin(F.broadcast(norms)).join(dots, ["label", "try"], "left")       # a row per try
    far = F.array(*[F.round(F.col("norm") + F.col(f"_n{j}") - 2 * F.coalesce(f"_d{j}", F.lit(0.0)), DIGITS) for j in range(k)])
    met = met.withColumn("_far", far).withColumn("d", F.array_min("_far"))
    return met.select("label", "try", (F.array_position("_far", F.col("d")) - 1).cast("int").alias("cluster"), "rows",
                      F.greatest("d", F.lit(0.0)).alias("d"))


def relational_kmeans(vectors: DataFrame, labels: DataFrame, k: int, tries: int = 10, iterations: int = 20, seed: int = 42) -> DataFrame:
    """``(label, cluster, rows, d, try, cost)`` of the try with the least cost.

    ``vectors(label, term, weight)`` are the coordinates that are not zero, ``labels(label, rows)`` every distinct
    label; a label without a term is the zero vector.  Lloyd's steps go on until no label of any try moves, or for
    ``iterations``.  ``d`` is the squared distance to the centre and ``cost`` its sum over rows.  With fewer distinct
    vectors than ``k`` fewer clusters are made; a cluster that loses all labels stays empty.  No label gives no row.
    """
    vectors = vectors.select("label", "term", "weight")
    by_term, by_label = checkpointed(vectors.repartition("term")), checkpointed(vectors.repartition("label"))
    norm = by_label.groupBy("label").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    labels = checkpointed(labels.select("label", F.col("rows").cast("double").alias("rows")).join(norm, "label", "left")
                          .select("label", "rows", F.coalesce("norm", F.lit(0.0)).alias("norm")))
    first = _seeds(by_term, labels, k, tries, seed).withColumn("rows", F.lit(1.0))
    assigned = checkpointed(_assigned(by_term, labels, _centres(by_label, first, k), k))
    state = None
    for _ in range(iterations):
        now = assigned.agg(F.bit_xor(F.xxhash64("label", "try", "cluster"))).first()[0]
        if now == state:
            break
        state = now
        assigned = checkpointed(_assigned(by_term, labels, _centres(by_label, assigned, k), k))
    cost = assigned.groupBy("try").agg(F.sum(F.col("rows") * F.col("d")).alias("cost"))
    best = cost.orderBy(F.round("cost", 6), "try").limit(1).withColumnRenamed("try", "_try")
    return assigned.join(F.broadcast(best), F.col("try") == F.col("_try")).select(
        "label", "cluster", F.col("rows").cast("bigint").alias("rows"), "d", "try", "cost")


def kmeans_sql(k: int, tries: int = 10, iterations: int = 20, seed: int = 42) -> str:
    """The same in DuckDB: CTEs over ``v(label, term, weight)`` and ``l(label, rows)``, ending in ``km`` like the result above."""
    u = f"((('0x' || substr(md5('{seed}:' || try || ':{{r}}:' || label), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
    out = [f"""ln_ AS MATERIALIZED (SELECT label, rows::DOUBLE AS rows, coalesce(n, 0.0)::DOUBLE AS norm FROM l
      LEFT JOIN (SELECT label, sum(weight * weight) AS n FROM v GROUP BY 1) USING (label))""",
           f"d0 AS (SELECT t.try, label, rows, norm, 1.0::DOUBLE AS d FROM ln_, range({tries}) AS t(try))"]
    for r in range(k):
        out.append(f"""p{r} AS MATERIALIZED (SELECT try, arg_min(label, key) AS label, arg_min(norm, key) AS pn
      FROM (SELECT *, -ln({u.format(r=r)}) / (rows * d) AS key FROM d{r} WHERE d > 0) GROUP BY try)""")
        if r < k - 1:
            out.append(f"""d{r + 1} AS MATERIALIZED (SELECT d.try, d.label, rows, norm, CASE WHEN pn IS NULL THEN d ELSE
      least(d, greatest(0.0, round(norm + pn - 2 * coalesce(dot, 0.0), {DIGITS}))) END AS d
      FROM d{r} d LEFT JOIN (SELECT try, pn FROM p{r}) USING (try) LEFT JOIN (SELECT p.try, x.label, sum(x.weight * c.weight) AS dot
        FROM p{r} p JOIN v c ON c.label = p.label JOIN v x ON x.term = c.term GROUP BY ALL) o ON o.try = d.try AND o.label = d.label)""")
    first = " UNION ALL ".join(f"SELECT try, {r} AS cluster, label, 1.0::DOUBLE AS rows FROM p{r}" for r in range(k))
    out.append(f"a0 AS MATERIALIZED ({first})")
    for i in range(iterations + 1):
        out.append(f"""n{i} AS MATERIALIZED (SELECT try, cluster, sum(rows) AS n FROM a{i} GROUP BY ALL),
c{i} AS MATERIALIZED (SELECT try, cluster, term, sum(rows * weight) / any_value(n) AS c FROM a{i} JOIN n{i} USING (try, cluster) JOIN v USING (label) GROUP BY ALL),
m{i} AS MATERIALIZED (SELECT try, cluster, coalesce(m, 0.0) AS m FROM n{i} LEFT JOIN (SELECT try, cluster, sum(c * c) AS m FROM c{i} GROUP BY ALL) USING (try, cluster)),
a{i + 1} AS MATERIALIZED (SELECT try, label, any_value(rows) AS rows, arg_min(cluster, [far, cluster]) AS cluster, greatest(min(far), 0.0) AS d FROM (
      SELECT m.try, m.cluster, x.label, x.rows, round(x.norm + m.m - 2 * coalesce(dot, 0.0), {DIGITS}) AS far FROM m{i} m CROSS JOIN ln_ x
      LEFT JOIN (SELECT try, cluster, label, sum(weight * c) AS dot FROM c{i} JOIN v USING (term) GROUP BY ALL) o
      ON o.try = m.try AND o.cluster = m.cluster AND o.label = x.label) GROUP BY try, label)""")
    last = f"a{iterations + 1}"
    out.append(f"""cost AS MATERIALIZED (SELECT try, sum(rows * d) AS cost FROM {last} GROUP BY 1),
km AS (SELECT label, cluster, rows::BIGINT AS rows, d, try, cost FROM {last} JOIN (SELECT * FROM cost ORDER BY round(cost, 6), try LIMIT 1) USING (try))""")
    return ",\n".join(out)
