"""Source divergence audit: how far the term shares of sources of one language lie apart.

Texts go through an Arrow compute pipeline inside ``mapInArrow``: ``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode`` and hash group-bys make partial counts of occurrences
and of documents, merged in the task before they are shuffled.  Counts of the kept terms then form
columnar shards by language and a hash of the term; each shard holds all sources of its terms, so it
adds up its share of every divergence and its own largest terms, and only these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from spendlens.llm.shared import checkpointed

#: What stands between terms: all of ASCII but its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
#: Characters of text that are split at once, and partial rows that a task merges before it sends them on.
SLICE, HELD = 1 << 24, 1 << 20
#: Cells (terms by sources) that a shard lays out at once.
CELLS = 1 << 21
KEYS = ["lang", "source", "term"]


def _counted(rows: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, docs`` of some documents; the empty term stands for the documents themselves."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(rows.column("text")), BETWEEN)
    term, row = pc.list_flatten(pieces).dictionary_encode(), pc.list_parent_indices(pieces)
    names = term.dictionary
    there = pc.greater(pc.binary_length(names), 0).take(term.indices)       # splitting leaves empty ends
    code, row = term.indices.filter(there), row.filter(there)
    by_row = pa.table({"row": row, "code": code}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    group = pa.table({"lang": rows.column("lang"), "source": rows.column("source"),
                      "row": pa.array(np.arange(rows.num_rows, dtype=np.int64))})
    groups = group.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list"), ([], "count_all")])
    owner = np.zeros(rows.num_rows, dtype=np.int64)
    owner[pc.list_flatten(groups["row_list"]).to_numpy()] = pc.list_parent_indices(groups["row_list"]).to_numpy()
    summed = (pa.table({"owner": pa.array(owner).take(by_row["row"]), "code": by_row["code"], "n": by_row["count_all"]})
              .group_by(["owner", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")]))
    parts = pa.table({"lang": groups["lang"].take(summed["owner"]), "source": groups["source"].take(summed["owner"]),
                      "term": names.take(summed["code"].combine_chunks()), "n": summed["n_sum"], "docs": summed["count_all"]})
    whole = pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.array([""] * len(groups), pa.string()),
                      "n": pa.array(np.zeros(len(groups), dtype=np.int64)), "docs": groups["count_all"]})
    return pa.concat_tables([parts, whole])


def _merged(parts: list[pa.Table]) -> pa.Table:
    if len(parts) == 1:
        return parts[0]
    out = pa.concat_tables(parts).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns([*KEYS, "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term.

    ``docs`` needs text, lang and source, null as ''; other columns are ignored.  Terms are runs of
    ASCII letters and of characters beyond ASCII, A to Z lower-cased.  The term '' has a row for each
    (lang, source) that occurs, with its number of documents.  An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            sizes, start = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), 0
            while start < b.num_rows:       # long texts go by few rows, so that no column of pieces outgrows its offsets
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE, side="right")))
                parts.append(_counted(b.slice(start, end - start)))
                held, start = held + len(parts[-1]), end
                if held > HELD and len(parts) > 1:
                    parts = [_merged(parts)]
                    held = len(parts[0])
                    if held > HELD // 2:
                        yield from parts[0].to_batches(max_chunksize=1 << 16)
                        parts, held = [], 0
        if parts:
            yield from _merged(parts).to_batches(max_chunksize=1 << 16)

    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counted = docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * count / total)`` in exact 64-bit steps, for totals up to nine quadrillion."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _shard(counts: pa.Table, groups: pa.Table, smooth: int, top: int) -> pa.Table:
    """Partial results of one shard: sums of differences by pair of sources, and each source's ``top`` terms."""
    names = groups["source"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names, n_src = [names[i] for i in order], len(names)
    total = groups["total"].to_numpy()[order].astype(np.int64)
    lang, whole = groups["lang"][0].as_py(), int(groups["lang_total"][0].as_py())
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    sums = np.zeros((n_src, n_src), dtype=np.int64)
    best: list[tuple[np.ndarray, list[str]]] = [(np.zeros(0, np.int64), []) for _ in names]
    if len(counts):
        terms = counts["term"].combine_chunks().dictionary_encode()
        words, code = terms.dictionary.to_pylist(), terms.indices.to_numpy()
        src = pc.index_in(counts["source"], pa.array(names, pa.string())).to_numpy()
        n = counts["n"].to_numpy()
        q_count = np.zeros(len(words), dtype=np.int64)
        np.add.at(q_count, code, n)
        q = share(q_count + smooth, np.int64(whole))
        by_term = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[by_term], np.arange(len(words) + 1))
        step = max(1, CELLS // n_src)
        for s in range(0, len(words), step):
            e = min(len(words), s + step)
            some = by_term[edges[s]:edges[e]]
            cell = np.zeros((n_src, e - s), dtype=np.int64)
            cell[src[some], code[some] - s] = n[some]
            p = share(cell + smooth, total[:, None])
            for i in range(n_src):
                sums[i] += np.abs(p - p[i]).sum(axis=1)
                f = p[i] - q[s:e]
                up = np.nonzero((cell[i] > 0) & (f > 0))[0]
                if len(up) > top:       # ties with the last one stay for the final order
                    up = up[f[up] >= np.partition(f[up], len(up) - top)[len(up) - top]]
                if len(up):
                    value, items = np.concatenate([best[i][0], f[up]]), best[i][1] + [words[s + k] for k in up]
                    rank = sorted(range(len(value)), key=lambda k: (-value[k], items[k].encode()))[:top]
                    best[i] = value[rank], [items[k] for k in rank]
    for i, name in enumerate(names):
        others = [k for k in range(n_src) if k != i]
        out["source"] += [name] * (len(others) + len(best[i][1]))
        out["part"] += ["pair"] * len(others) + ["term"] * len(best[i][1])
        out["item"] += [names[k] for k in others] + best[i][1]
        out["value"] += [int(sums[i, k]) for k in others] + [int(v) for v in best[i][0]]
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), "source": pa.array(out["source"], pa.string()),
                     "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.string()),
                     "value": pa.array(out["value"], pa.int64())})


def audit(docs: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50, shard_rows: int = 200_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every (lang, source) that occurs.

    A language keeps the terms that ``least_docs`` of its documents hold.  With ``p`` a group's smoothed
    share of a term in billionths and ``q`` its language's, part 'pair' has each other source of the
    language and the sum of the differences of ``p``, part 'term' the ``top`` kept terms whose ``p`` lies
    furthest above ``q``.  Ranks follow the value, then the item's bytes.  Null text, lang and source are
    ''; without kept terms pairs have 0.  Repeated rows count as often as they occur.

    Counts are dealt out by language and term, so neither a hot source nor a hot language meets in one
    task; a shard holds about ``shard_rows`` counts and the sources of its language, whose square the
    result has as rows.
    """
    merged = checkpointed(term_counts(docs))
    kept = merged.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("_df")).where(F.col("_df") >= least_docs).drop("_df")
    counts = checkpointed(merged.join(kept, ["lang", "term"]).select(*KEYS, "n"))
    sizes = counts.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("lang_n"),
                                       F.ceil(F.count("*") / F.lit(float(shard_rows))).cast("int").alias("shards"))
    groups = merged.where("term = ''").select("lang", "source").join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(sizes, "lang", "left")
    margin = F.lit(smooth) * F.coalesce("terms", F.lit(0))
    # New names: the two sides of a cogroup may not share columns of one origin.
    groups = groups.select(F.col("lang").alias("lang"), F.col("source").alias("source"), (F.coalesce("n", F.lit(0)) + margin).alias("total"),
                           (F.coalesce("lang_n", F.lit(0)) + margin).alias("lang_total"),
                           F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard"))
    counts = counts.join(sizes.select("lang", "shards"), "lang").select(
        *KEYS, "n", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    parts = counts.groupBy("lang", "shard").cogroup(groups.groupBy("lang", "shard")).applyInArrow(
        lambda left, right: _shard(left, right, smooth, top), "lang string, source string, part string, item string, value long")
    found = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    """Divergences of the sources of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT lang, source, rid, term, count(*) AS n FROM (SELECT lang, source, rid, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT lang, source, term, sum(w.n)::HUGEINT AS n FROM w JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(s.n, 0)::HUGEINT AS n, coalesce(l.v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT s.lang, s.source, o.source AS other, sum(abs(s.p - o.p)) AS value FROM p s JOIN p o
                 ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL) x
      ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value,
        row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
