"""Rule bitmask ledger: every quality rule is evaluated once, verdicts are bit arithmetic.

``ledger`` measures each text and stores one bit per failed rule.  A policy is a versioned set of
rules, so a verdict under any policy, an ablation or a policy comparison needs the ledger only and
never the texts.  Everything is DataFrame expressions inside one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spendlens.llm.shared import packed, words

SYMBOLS = "#*$%&|<>"

#: Rule name -> SQL condition over the ledger's measurements under which a text fails.  A rule's
#: bit is its position, so new rules go to the end and existing ledgers stay readable.
RULES = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "10 * n_exclaims > 3 * n_words",
}

#: Policy name -> version -> rules it applies.
POLICIES = {
    "base": {1: ["too_few_words", "repeated_windows"]},
    "prose": {
        1: ["too_few_words", "repeated_windows", "many_symbols", "repeated_lines"],
        2: list(RULES),
    },
}


def mask(policy: str, version: int) -> int:
    """The policy's rules as one bit mask."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy][version])


def _removed(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, window: int = 5) -> DataFrame:
    """``docs`` plus the measurements that the rules read.

    Null text counts as empty: all measurements 0.  Texts of any length are measured whole: the
    cost is linear but for one sort of a text's window hashes, which only texts with a repeated
    window need.  Existing columns keep their place; a measurement of the same name replaces one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(packed(docs.columns).alias("_row"), F.col("text"))
    d = d.withColumn("_words", words(F.col("text")))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    d = d.withColumn("_hashes", F.when(
        F.size("_words") >= window,
        F.expr(f"transform(sequence(1, size(_words) - {window - 1}), i -> xxhash64(slice(_words, i, {window})))")
    ).otherwise(F.expr("CAST(array() AS array<bigint>)")))
    # Sorting brings equal windows together; only texts with a repeated window need it.  Each position
    # with an equal neighbour then adds the words that the previous such window has not covered.
    d = d.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN "
        "CAST(array() AS array<struct<h:bigint,p:int>>) ELSE "
        "sort_array(transform(_hashes, (h, i) -> named_struct('h', h, 'p', i))) END"))
    d = d.withColumn("_repeats", F.expr(
        "array_sort(transform(filter(_sorted, (x, i) -> x.h <=> get(_sorted, i - 1).h OR "
        "x.h <=> get(_sorted, i + 1).h), x -> x.p))"))
    out = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": _removed(text, SYMBOLS),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(
            f"aggregate(_repeats, named_struct('n', 0L, 'last', {-window}), (s, p) -> named_struct("
            f"'n', s.n + least({window}, p - s.last), 'last', p), s -> s.n)"),
        "n_exclaims": _removed(text, "!"),
    }
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in out]
    return d.select(*kept, *[v.alias(k) for k, v in out.items()])


def ledger(docs: DataFrame, window: int = 5) -> DataFrame:
    """``docs`` with measurements and ``failed_bits``: bit k is set if rule k of RULES fails.

    The bits carry a zero that is not deterministic, which keeps filters on the ledger above it.
    Pushed below, the optimizer would write the window hashes into the lambdas that look at their
    neighbours and evaluate them for each element.
    """
    bits = " | ".join(f"CAST(IF({cond}, {1 << k}, 0) AS bigint)" for k, cond in enumerate(RULES.values()))
    above = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    return measure(docs, window).withColumn("failed_bits", F.expr(bits).bitwiseOR(above))


def verdict(policy: str, version: int, bits: str = "failed_bits") -> Column:
    """True if no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy, version))) == 0


def ablations(led: DataFrame) -> DataFrame:
    """Per policy, version and rule: documents kept, and kept had the rule not been applied.

    The ledger is reduced to one row per distinct bit pattern (at most two to the number of rules)
    before policies and rules meet it.  An empty ledger gives no rows.
    """
    patterns = led.groupBy("failed_bits").agg(F.count("*").alias("n"))
    names = list(RULES)
    arms = [(p, v, r, mask(p, v), 1 << names.index(r)) for p, vs in POLICIES.items() for v in vs
            for r in POLICIES[p][v]]
    arm = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"),
                                       F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"),
                                       F.lit(b).cast("long").alias("bit")) for p, v, r, m, b in arms]))
    hit = F.col("failed_bits").bitwiseAND(F.col("arm.mask"))
    return (patterns.withColumn("arm", arm)
            .groupBy("arm.policy", "arm.version", "arm.rule")
            .agg(F.sum("n").alias("n_docs"),
                 F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
                 F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("arm.bit"))) == 0, F.col("n")).otherwise(0))
                 .alias("n_kept_without_rule"),
                 F.sum(F.when(hit.bitwiseAND(F.col("arm.bit")) != 0, F.col("n")).otherwise(0))
                 .alias("n_failing_rule"),
                 F.bit_or(hit).alias("bits_seen")))


def query(spark, sf_dir: str) -> DataFrame:
    """Quality ledger of every document with the base and the production verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base", 1))) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), verdict("prose", 2).alias("kept"), "n_lines", "n_exclaims", "failed_bits")


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """What every rule of every policy costs: documents kept with it, without it, and failing it."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps; null texts go (no words).

    All columns come back unchanged, whatever their names.  An empty table gives no rows.
    """
    rows = docs.select(packed(docs.columns).alias("row"), F.col("text"))
    return ledger(rows).where(verdict("prose", 2)).select("row.*")


#: The rule set, the words and the windows again in DuckDB's dialect.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i+4])) AS win,
             unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, sum(least(5, p - coalesce(q, -5)))::BIGINT AS n FROM (
        SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM r) GROUP BY rid),
m AS (SELECT w.doc_id, w.t, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, coalesce(wc, 0) AS word_chars FROM m),
f AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
      + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
      + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
      + 64 * (10 * n_exclaims > 3 * n_words)::BIGINT)::BIGINT AS failed_bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, n_lines, n_exclaims, failed_bits FROM f
""".replace("{docs}", "documents")

#: Every rule of every policy against the ledger of the query above.
ABLATION_SQL = "WITH q AS (" + SQL + "),\na(policy, version, rule, mask, bit) AS (VALUES " + ", ".join(
    f"('{p}', {v}, '{r}', {mask(p, v)}, {1 << list(RULES).index(r)})" for p, vs in POLICIES.items() for v in vs for r in POLICIES[p][v]) + """)
SELECT policy, version, rule, count(*) AS n_docs, count(*) FILTER (failed_bits & mask = 0) AS n_kept,
       count(*) FILTER (failed_bits & mask & ~bit = 0) AS n_kept_without_rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failing_rule,
       bit_or(failed_bits & mask) AS bits_seen FROM q, a GROUP BY policy, version, rule
"""
