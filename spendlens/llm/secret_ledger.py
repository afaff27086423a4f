"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  The ledger holds the pairs of
blob and rule version already scanned; a run scans each unseen pair once, on one representative
path of the blob, and joins the findings of all blobs back to all paths.  A new rule version makes
only that rule run again, a new copy of a known text runs nothing.  DataFrame expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendlens.llm.shared import checkpointed


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; ``keep`` says which match strings count."""
    kind: str
    version: int
    pattern: str
    keep: str = "true"      # SQL over the match string m

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_VALUE = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"

#: In the order in which kinds are listed.  The first three are the digest contract's; failing
#: matches of assign consume text, runs under the length of access and hex never match at all.
RULES = (
    Rule("assign", 1, _ASSIGN + _VALUE,
         "char_length(regexp_extract(m, r'^" + _ASSIGN.replace('[\\"\']', "[\"\\x27]") + "(" + _VALUE + ")$', 1)) >= 12"),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def versions(docs: DataFrame) -> DataFrame:
    """``(doc_id, blob)`` for every row; a null text is the empty blob."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))


def unseen(paths: DataFrame, scanned: DataFrame | None, rules=RULES) -> DataFrame:
    """``(blob, doc_id, pending)``: blobs with rule versions not in ``scanned(blob, rule)``."""
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if scanned is None:
        return blobs.withColumn("pending", names)
    done = scanned.groupBy(F.col("blob").alias("_blob")).agg(F.collect_set("rule").alias("_done"))
    left = blobs.join(done, F.col("blob") == F.col("_blob"), "left")
    pending = F.array_except(names, F.coalesce("_done", F.expr("CAST(array() AS array<string>)")))
    return left.select("blob", "doc_id", pending.alias("pending")).where(F.size("pending") > 0)


def _matches(rule: Rule, k: int) -> Column:
    """Matches of one rule with the length of the text before each since the previous match.

    Splitting by the same pattern gives the texts between matches, which place the matches.  It
    only runs where some match counts.
    """
    found = F.col(f"_found{k}")
    none = F.expr("CAST(array() AS array<struct<kind:string,k:int,i:int,gap:int,len:int,ok:boolean>>)")
    kept = F.expr(f"exists(_found{k}, m -> {rule.keep})")
    between = F.expr(
        f"transform(_found{k}, (m, i) -> named_struct('kind', '{rule.kind}', 'k', {k}, 'i', i, "
        f"'gap', char_length(_gaps{k}[i]), 'len', char_length(m), 'ok', {rule.keep}))")
    return F.when((F.size(found) > 0) & kept, between).otherwise(none)


def findings(docs: DataFrame, pending: DataFrame, rules=RULES) -> DataFrame:
    """``(blob, kind, k, start, end)``: spans of the pending rules in the pending blobs.

    Positions are code points, ``end`` exclusive.  Repeated rows of a representative path are
    scanned alike and give one finding each.
    """
    todo = pending.select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_id"), "pending")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(todo, F.col("doc_id").eqNullSafe(F.col("_id"))).where(F.sha2("text", 256) == F.col("_blob"))
    rows = rows.select(F.col("_blob").alias("blob"), "text", "pending")
    nothing = F.expr("CAST(array() AS array<string>)")
    for k, r in enumerate(rules):
        hit = F.array_contains("pending", r.name)
        rows = rows.withColumn(f"_found{k}", F.when(hit, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))
                               .otherwise(nothing))
    for k, r in enumerate(rules):
        rows = rows.withColumn(f"_gaps{k}", F.when(F.expr(f"exists(_found{k}, m -> {r.keep})"),
                                                   F.split("text", r.pattern, -1)).otherwise(nothing))
    hits = rows.select("blob", F.explode(F.concat(*[_matches(r, k) for k, r in enumerate(rules)])).alias("h"))
    hits = hits.select("blob", "h.*").dropDuplicates(["blob", "k", "i"])
    upto = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return (hits.withColumn("end", end).where("ok")
            .select("blob", "kind", "k", (F.col("end") - F.col("len")).alias("start"), "end"))


def scan(docs: DataFrame, known: DataFrame | None = None, scanned: DataFrame | None = None,
         rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One increment: ``(paths, findings, scanned)`` including what was known before.

    ``known`` and ``scanned`` are the findings and the ledger of earlier runs, as returned here and
    stored by the caller; None means a first run.  An empty table gives three empty frames.
    """
    paths = checkpointed(versions(docs))
    pending = checkpointed(unseen(paths, scanned, rules))
    new = findings(docs, pending, rules)
    done = pending.select("blob", F.explode("pending").alias("rule"))
    return (paths, new if known is None else known.unionByName(new),
            done if scanned is None else scanned.unionByName(done))


def per_path(paths: DataFrame, found: DataFrame, base=("assign", "access", "hex")) -> DataFrame:
    """Counts and span lists of every path; paths without findings have counts 0 and empty lists."""
    is_base = F.col("kind").isin(*base)
    span = F.struct("start", "k", "kind", "end")
    per_blob = found.groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == b, 1)).alias(f"n_{b}") for b in base],
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("_base"),
        F.sort_array(F.collect_list(span)).alias("_all"))

    def text(c: str) -> Column:
        listed = F.expr(f"array_join(transform({c}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
        return F.coalesce(listed, F.lit(""))

    joined = paths.join(per_blob, "blob", "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{b}", F.lit(0)).cast("long").alias(f"n_{b}") for b in base],
                         F.sha2(text("_base"), 256).alias("base_sha256"), text("_all").alias("spans"),
                         F.col("blob").alias("blob_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned once per distinct text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    paths, found, _ = scan(docs)
    return per_path(paths, found)


def _sql() -> str:
    """The same rules in DuckDB's dialect, which folds case by classes to stay within ASCII."""
    names = ["password", "passwd", "secret", "token", "api_?key"]
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in names)
    assign = "(?:" + word + r")[\"'']?\x20*[:=]\x20*[\"'']?"
    parts = []
    for k, r in enumerate(RULES):
        rx = assign + _VALUE if r.kind == "assign" else r.pattern
        ok = f"length(regexp_extract(m, '^{assign}({_VALUE})$', 1)) >= 12" if r.kind == "assign" else "true"
        parts.append(f"SELECT rid, '{r.kind}' AS kind, {k} AS k, i, length(gaps[i]) AS gap, length(ms[i]) AS len, "
                     f"ms[i] AS m FROM (SELECT rid, regexp_extract_all(t, '{rx}') AS ms, "
                     f"string_split_regex(t, '{rx}') AS gaps FROM d), unnest(range(1, len(ms) + 1)) AS u(i)")
        parts[-1] = f"SELECT * EXCLUDE m, {ok} AS ok FROM ({parts[-1]})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, (sum(gap + len) OVER (PARTITION BY rid, k ORDER BY i))::BIGINT AS e FROM h),
s AS (SELECT rid, kind, k, e - len AS b, kind || ':' || (e - len) || ':' || e AS span FROM p WHERE ok),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc,
        count(*) FILTER (kind = 'hex') AS nh, string_agg(span, ',' ORDER BY b, k) FILTER (k < 3) AS base,
        string_agg(span, ',' ORDER BY b, k) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nc, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob_sha256
FROM d LEFT JOIN a USING (rid)
"""


SQL = _sql()
