"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / quality`` with ``u`` from a hash of its id, so better
documents come earlier and reruns agree.  A source first takes its complete epochs; the rest of its
target is a prefix of its documents in key order.  Prefix sums of the sizes come from range partitions
of (source, key) with offsets, so neither a source nor a crowded span of keys is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendlens.llm.shared import checkpointed, packed, words
from spendlens.operators.ordering import with_prefix_sums

WEIGHTS = (3, 1, 2)
NOISE = "#*$%&|<>!0123456789"


def quality(text: Column) -> Column:
    """Sampling weight in [0.1, 1]: the share of characters that are neither symbols nor digits."""
    t = F.coalesce(text, F.lit(""))
    clean = F.char_length(F.translate(t, NOISE, "")).cast("double")
    return F.greatest(F.lit(0.1), F.when(F.char_length(t) == 0, F.lit(1.0)).otherwise(clean / F.char_length(t)))


def key(doc_id: Column, text: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key: ``u`` is 52 bits of the md5 of seed and id; in place of a null id stands the md5 of the text, null as ''."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """Adds ``target`` to ``sizes(source, source_size, ...)``, one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    sizes; a target stops at ``limit`` times the source's size and the excess is shared again by
    weight until none is above.  That fixed point is a water level: in order of limit over weight,
    the sources whose limit lies under the level left to the rest are full.  The two global windows
    run over the table of sources, not of documents.  Sources of size 0 get target 0.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", pick).withColumn("_cap", F.lit(limit) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("_level", level).withColumn("_order", F.row_number().over(by_ratio))
    over = F.col("_cap") / F.col("_weight") > F.col("_level")
    first = F.min(F.when(over, F.struct("_order", "_level"))).over(everything)
    ranked = ranked.withColumn("_first", first)
    return (ranked.withColumn("target", F.when(F.col("_order") < F.coalesce(F.col("_first._order"), F.lit(2 ** 31 - 1)),
                                               F.col("_cap")).otherwise(F.col("_weight") * F.col("_first._level")))
            .drop("_rank", "_weight", "_cap", "_level", "_order", "_first"))


def takes(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per document: ``doc_id, _text, source, size, source_size, target, taken``.

    ``docs`` needs doc_id, text and source.  ``_text`` is a 64-bit hash of the text, which orders
    rows that share an id; rows alike in everything are interchangeable.  ``taken`` counts words:
    complete epochs times the size, plus what the fractional selection takes; the document in which
    the budget ends is taken in part, so a source misses its target by less than one word.  Null
    texts have size 0 and are taken 0 times.  An empty table gives no rows.
    """
    base = checkpointed(docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        key(F.col("doc_id"), F.col("text"), quality(F.col("text"))).alias("_key"),
        F.xxhash64("text").alias("_text")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (source_targets(sizes, share, limit, weights)
            .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(0).cast("long"))
            .withColumn("_budget", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
            .withColumnRenamed("source", "_source"))
    plan = checkpointed(plan)
    same = F.col("source").eqNullSafe(F.col("_source"))
    # In key order, ties by id, hash and size: the sizes before each row of its source.
    rows = with_prefix_sums(base, ["source"], ["_key", "doc_id", "_text", "size"], {"_before": F.col("size")}, per_group=True)
    rows = rows.join(plan, same).drop("_source")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_budget") - F.col("_before")))
    return rows.select("doc_id", "_text", "source", "size", "source_size", "target",
                       (F.col("_epochs") * F.col("size") + part).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return takes(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``docs`` as the mix reads them: one row per epoch, the last cut to the words it takes.

    Columns stay; ``n_chars`` follows a cut text.  Documents that the mix does not take go.
    """
    chosen = (takes(docs, share, limit, weights).where("taken > 0")
              .groupBy("doc_id", "_text").agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"),
                                              F.count("*").alias("_rows")))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "_size", "_taken", "_rows")
    rows = docs.select(packed(docs.columns).alias("_row"), F.col("doc_id"), F.xxhash64("text").alias("_text"))
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    # Rows alike in id and text share their words evenly, the first of a division's rest included.
    each = F.ceil(F.col("_taken") / F.col("_rows")).cast("long")
    rows = rows.withColumn("_each", each).withColumn("_copy", F.explode(F.expr(
        "transform(sequence(1, CAST(ceil(_each / _size) AS int)), i -> least(_size, _each - (i - 1) * _size))")))
    cut = F.expr(r"regexp_extract(_row.text, concat('^[\\x20\\x09-\\x0D]*(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+){', "
                 r"_copy, '}+'), 0)")
    text = F.when(F.col("_copy") == F.col("_size"), F.col("_row.text")).otherwise(cut)
    fields = {c: F.col("_row").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("_copy") == F.col("_size"), F.col("_row.n_chars")).otherwise(
            F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in fields.items()])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: sources repeated or thinned to their targets.

    ``text`` is cut where a budget ends, and ``n_chars`` with it; all other columns stay, whatever their names.
    """
    return mixed(docs)


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE,
          length(regexp_replace(text, '[#*$%&|<>!0-9]', '', 'g'))::DOUBLE / length(text)::DOUBLE) END AS q,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5)
          / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / q AS kk FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[1 + ((row_number() OVER (
        ORDER BY source NULLS LAST) - 1) % 3)] AS w FROM k GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS rn FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0)) AS lv FROM o),
f AS (SELECT min(rn) AS fr, arg_min(lv, rn) AS fl FROM l WHERE cap / w > lv),
t AS (SELECT source, source_size, CASE WHEN rn < coalesce(fr, 2147483647) THEN cap ELSE w * fl END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS ep FROM t),
x AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.ep, floor(e.target - e.ep * e.source_size)::BIGINT
        - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY kk, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS room FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (ep * size + greatest(0, least(size, room)))::BIGINT AS taken FROM x
"""
