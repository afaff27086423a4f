"""Category collapse operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import collapse_manual
from ..session import checkpointed
from .kmeans import relational_kmeans


def collapse_categories(df: DataFrame, mode: str = "manual", top_n: int = 20, n_clusters: int = 15,
                        src: str = "raw_category", dst: str = "category") -> DataFrame:
    if mode == "manual":
        return df.withColumn(dst, collapse_manual(src))
    if mode == "top":
        return collapse_top_n(df, top_n, src, dst)
    if mode == "tfidf":
        return collapse_tfidf(df, n_clusters, src, dst)
    raise ValueError(f"unknown collapse mode {mode!r}")


def top_labels(df: DataFrame, col: str, n: int) -> DataFrame:
    """K1: the n most frequent labels, ties broken by label."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(n))


def collapse_top_n(df: DataFrame, n: int, src: str = "raw_category", dst: str = "category") -> DataFrame:
    """Keep the n most frequent labels, map the rest to ``other``.

    The kept set has at most ``n`` rows, so broadcasting it is size-bounded.
    """
    keep = top_labels(df, src, n).select(F.col(src).alias("_keep"))
    out = df.join(F.broadcast(keep), df[src] == keep["_keep"], "left")
    return out.withColumn(dst, F.when(F.col("_keep").isNotNull(), F.col(src)).otherwise(F.lit("other"))).drop("_keep")


def word_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words: each lower-cased word with a blank on either side gives its
    n-grams for n from ``low`` up to ``high`` or its own length, whichever is smaller."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_length(w, n):
        return F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))

    return F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(
        F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: of_length(w, n)))))


def label_terms(df: DataFrame, src: str = "raw_category", min_df: int = 2) -> DataFrame:
    """P10 terms of the distinct labels: ``(src, rows, term, tf, idf)``.

    Document frequency and ``min_df`` count rows, so a label counts as often as it occurs;
    idf = ln((1 + n) / (1 + df)) + 1 over the n rows with a label.  Every term is kept.
    """
    labels = df.where(F.col(src).isNotNull()).groupBy(src).agg(F.count(F.lit(1)).alias("rows"))
    terms = labels.select(src, "rows", F.explode(word_grams(F.col(src))).alias("term"))
    terms = terms.groupBy(src, "rows", "term").agg(F.count(F.lit(1)).alias("tf"))
    freq = terms.groupBy("term").agg(F.sum("rows").alias("df")).where(F.col("df") >= min_df)
    total = labels.agg(F.sum("rows").alias("n"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    return terms.join(freq, "term").crossJoin(F.broadcast(total)).select(src, "rows", "term", "tf", idf.alias("idf"))


def tfidf_weights(df: DataFrame, src: str = "raw_category") -> DataFrame:
    """P10 weights ``(src, term, weight)``: tf x idf scaled to unit length per label."""
    t = label_terms(df, src).withColumn("_x", F.col("tf") * F.col("idf"))
    norm = t.groupBy(src).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    return t.join(norm, src).select(src, "term", (F.col("_x") / F.col("_norm")).alias("weight"))


def tfidf_clusters(df: DataFrame, n_clusters: int = 15, src: str = "raw_category", seed: int = 42, tries: int = 10,
                   iterations: int = 20) -> DataFrame:
    """P10 clusters of the distinct labels: ``(label, cluster, rows, d, try, cost)`` (see ``relational_kmeans``).

    Fitted on distinct labels weighted by their rows, which is fitting on every row since equal labels
    have equal vectors.  Terms, vectors and centres stay tables; the number of distinct labels is all the driver learns.
    """
    labels = checkpointed(df.where(F.col(src).isNotNull()).groupBy(F.col(src).alias("label")).agg(F.count(F.lit(1)).alias("rows")))
    k = max(2, min(n_clusters, labels.count()))
    return relational_kmeans(tfidf_weights(df, src).withColumnRenamed(src, "label"), labels, k, tries, iterations, seed)


def collapse_tfidf(df: DataFrame, n_clusters: int = 15, src: str = "raw_category",
                   dst: str = "category", seed: int = 42, tries: int = 10) -> DataFrame:
    """P10: TF-IDF of character n-grams -> k-means -> ``cluster_XX``, the best of ``tries`` seeds by cost.

    Two or fewer distinct labels, or labels of which no n-gram occurs in two rows, are left unchanged; null labels
    get no cluster.
    """
    few = df.where(F.col(src).isNotNull()).select(src).distinct().limit(3).count() <= 2
    if few or label_terms(df, src).isEmpty():
        return df.withColumn(dst, F.col(src))
    mapping = tfidf_clusters(df, n_clusters, src, seed, tries).select(
        F.col("label").alias("_lbl"), F.format_string("cluster_%02d", F.col("cluster")).alias(dst))
    return df.join(mapping, F.col(src) == F.col("_lbl"), "left").drop("_lbl")
