"""Intensity ranges on the daily grid: 7-day targets, tuned thresholds, strict
buckets, transitions, rank correlation, user entropy and the model frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_strict, entropy_level
from ..functions.calendar import is_month_end, is_weekend
from ..functions.expr import share
from ..operators import bucketing as B
from ..operators import stats
from ..operators import windows as W
from ..operators.grid import daily_grid_with_user_sum, user_daily_grid
from ..operators.ordering import exact_quantiles
from .daily_signal import FOCUS, _GRID_SQL, tx_of
from . import shared
from .registry import register, rounded
from .sqlfmt import select_rounded

KEYS = ["user_id", "category"]


def with_target(grid: DataFrame, keys=KEYS) -> DataFrame:
    w = W.spec(keys, "event_date")
    return grid.withColumn("target_7d_sum", W.future_sum("amount", w, 7))


def target_grid(spark, sf_dir):
    return shared.frame(spark, "daily_target_grid", sf_dir, lambda: with_target(daily_grid_with_user_sum(tx_of(spark, sf_dir))))


def grid_thresholds(spark, sf_dir):
    return shared.value(spark, "daily_thresholds", sf_dir,
                        lambda: B.tune_thresholds(target_grid(spark, sf_dir), "target_7d_sum"))


def bucketed(spark, sf_dir):
    g = target_grid(spark, sf_dir)
    thr = grid_thresholds(spark, sf_dir)
    return g.withColumn("bucket", bucket_strict("target_7d_sum", thr["low"], thr["high"])), thr


def tune_sql(src: str, p: str) -> str:
    """CTEs ``{p}_best(lo, hi, mode, ql, qh)``: the B5 search over ``src(y)``."""
    probs = sorted(set([0.25, 0.75] + B.TUNE_LOW + B.TUNE_HIGH))
    plist = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in probs) + "]"
    combos = [(0.25, 0.75)] + [(lo, hi) for lo in B.TUNE_LOW for hi in B.TUNE_HIGH if lo < hi]
    vals = ", ".join(f"({i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for i, (lo, hi) in enumerate(combos))
    return f""",
{p}_t AS (SELECT y FROM {src} WHERE y IS NOT NULL),
{p}_qs AS (SELECT unnest({plist}) AS p, unnest(quantile_cont(y, {plist})) AS v FROM {p}_t WHERE y > 0),
{p}_combos AS (SELECT * FROM (VALUES {vals}) c(idx, ql, qh)),
{p}_cv AS (SELECT c.idx, c.ql, c.qh, a.v AS lo, b.v AS hi FROM {p}_combos c
           JOIN {p}_qs a ON a.p = c.ql JOIN {p}_qs b ON b.p = c.qh),
{p}_n AS (SELECT count(*) FILTER (WHERE y >= 0) AS n FROM {p}_t),
{p}_cnt AS (SELECT cv.idx, any_value(cv.ql) AS ql, any_value(cv.qh) AS qh, any_value(cv.lo) AS lo, any_value(cv.hi) AS hi,
              count(*) FILTER (WHERE t.y > 0 AND t.y <= cv.lo) AS c1,
              count(*) FILTER (WHERE t.y > cv.lo AND t.y <= cv.hi) AS c2,
              count(*) FILTER (WHERE t.y > cv.hi) AS c3
            FROM {p}_cv cv CROSS JOIN {p}_t t GROUP BY cv.idx),
{p}_sh AS (SELECT c.*, CAST(c1 AS DOUBLE) / n AS d1, CAST(c2 AS DOUBLE) / n AS d2, CAST(c3 AS DOUBLE) / n AS d3
           FROM {p}_cnt c, {p}_n),
{p}_base AS (SELECT * FROM {p}_sh WHERE idx = 0),
{p}_pick AS (SELECT * FROM {p}_sh WHERE idx > 0
             ORDER BY least(d1, d2, d3) DESC, (-abs(d1 - d2) - abs(d2 - d3)) DESC, idx ASC LIMIT 1),
{p}_best AS (SELECT CASE WHEN (SELECT least(d1, d2, d3) FROM {p}_base) >= {B.MIN_CLASS_SHARE} THEN b.lo ELSE k.lo END AS lo,
                   CASE WHEN (SELECT least(d1, d2, d3) FROM {p}_base) >= {B.MIN_CLASS_SHARE} THEN b.hi ELSE k.hi END AS hi,
                   CASE WHEN (SELECT least(d1, d2, d3) FROM {p}_base) >= {B.MIN_CLASS_SHARE} THEN 'default' ELSE 'tuned' END AS mode,
                   CASE WHEN (SELECT least(d1, d2, d3) FROM {p}_base) >= {B.MIN_CLASS_SHARE} THEN b.ql ELSE k.ql END AS ql,
                   CASE WHEN (SELECT least(d1, d2, d3) FROM {p}_base) >= {B.MIN_CLASS_SHARE} THEN b.qh ELSE k.qh END AS qh
             FROM {p}_base b, {p}_pick k)"""


_TGT_SQL = _GRID_SQL + """,
tgt AS (SELECT user_id, category, event_date, amount,
          CASE WHEN count(amount) OVER f7 = 7 THEN sum(amount) OVER f7 END AS y
        FROM grid WINDOW f7 AS (PARTITION BY user_id, category ORDER BY event_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))"""
_BK_SQL = _TGT_SQL + tune_sql("tgt", "g") + """,
bk AS (SELECT t.*, CAST(CASE WHEN y = 0 THEN 0 WHEN y > 0 AND y <= lo THEN 1 WHEN y > lo AND y <= hi THEN 2
                            WHEN y > hi THEN 3 END AS INT) AS bucket FROM tgt t, g_best)"""


@register("W1_future_sum_7", _TGT_SQL + "\n" + select_rounded("tgt", ["amount", "y"], ["user_id", "category", "event_date"])
          .replace("AS y", "AS target_7d_sum"))
def w1(spark, sf_dir):
    return rounded(target_grid(spark, sf_dir).select(
        "user_id", "category", "event_date", "amount", "target_7d_sum"))


@register("B5_tune_thresholds", _BK_SQL + """
SELECT round(lo, 4) AS threshold_low, round(hi, 4) AS threshold_high, mode, round(ql, 2) AS q_low, round(qh, 2) AS q_high FROM g_best""")
def b5(spark, sf_dir):
    thr = grid_thresholds(spark, sf_dir)
    row = [(thr["low"], thr["high"], thr["mode"], thr["q_low"], thr["q_high"])]
    df = spark.createDataFrame(row, "threshold_low double, threshold_high double, mode string, q_low double, q_high double")
    return rounded(df, 4, {"q_low": 2, "q_high": 2})


@register("B1_bucket_strict", _BK_SQL + """
SELECT user_id, category, event_date, round(y, 4) AS target_7d_sum, bucket FROM bk""")
def b1(spark, sf_dir):
    g, _ = bucketed(spark, sf_dir)
    return rounded(g.select("user_id", "category", "event_date", "target_7d_sum", "bucket"))


@register("A23_class_distribution", _BK_SQL + """,
cls AS (SELECT unnest([0, 1, 2, 3]) AS bucket)
SELECT c.bucket, round(coalesce(100.0 * (SELECT count(*) FROM bk WHERE bucket = c.bucket)
                               / nullif((SELECT count(bucket) FROM bk), 0), 0.0), 6) AS class_pct,
       round((SELECT avg(y) FROM bk WHERE bucket = c.bucket), 4) AS mean_value
FROM cls c""")
def a23(spark, sf_dir):
    g, _ = bucketed(spark, sf_dir)
    return rounded(B.class_distribution(g, "bucket", "target_7d_sum"), 4, {"class_pct": 6})


_TR_SQL = _BK_SQL + """,
tr AS (SELECT user_id, category, bucket, lead(bucket, 7) OVER (PARTITION BY user_id, category ORDER BY event_date) AS bucket_t_plus_7
       FROM bk),
trp AS (SELECT * FROM tr WHERE bucket IS NOT NULL AND bucket_t_plus_7 IS NOT NULL)"""


def transitions(spark, sf_dir):
    g, _ = bucketed(spark, sf_dir)
    w = W.spec(KEYS, "event_date")
    return g.withColumn("bucket_t_plus_7", W.lead_k("bucket", w, 7))


@register("A24_transition_matrix", _TR_SQL + """,
cells AS (SELECT a.i AS bucket_from, b.j AS bucket_to FROM (SELECT unnest([0,1,2,3]) AS i) a, (SELECT unnest([0,1,2,3]) AS j) b),
cnt AS (SELECT bucket AS i, bucket_t_plus_7 AS j, count(*) AS n FROM trp GROUP BY ALL),
rt AS (SELECT i, sum(n) AS tot FROM cnt GROUP BY i)
SELECT c.bucket_from, c.bucket_to, CAST(coalesce(x.n, 0) AS BIGINT) AS n,
       round(coalesce(CAST(x.n AS DOUBLE) / r.tot, 0.0), 6) AS share
FROM cells c LEFT JOIN cnt x ON x.i = c.bucket_from AND x.j = c.bucket_to LEFT JOIN rt r ON r.i = c.bucket_from""")
def a24(spark, sf_dir):
    return rounded(B.transition_matrix(transitions(spark, sf_dir), "bucket", "bucket_t_plus_7"), 6)


def _spearman_sql(filter_sql: str, scope: str) -> str:
    return f"""(SELECT '{scope}' AS scope, count(*) AS n_pairs,
    round(CASE WHEN count(*) >= 3 THEN {corr_rank} END, 6) AS spearman
  FROM (SELECT p.*, ra.r AS ra, rb.r AS rb FROM (SELECT * FROM trp WHERE {filter_sql}) p
        JOIN (SELECT bucket AS v, sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cb, n,
                     coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r
              FROM (SELECT bucket, count(*) AS n FROM trp WHERE {filter_sql} GROUP BY bucket)) ra ON ra.v = p.bucket
        JOIN (SELECT bucket_t_plus_7 AS v,
                     coalesce(sum(n) OVER (ORDER BY bucket_t_plus_7 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r
              FROM (SELECT bucket_t_plus_7, count(*) AS n FROM trp WHERE {filter_sql} GROUP BY bucket_t_plus_7)) rb ON rb.v = p.bucket_t_plus_7))"""


from .sqlfmt import corr_sql as _corr  # noqa: E402

corr_rank = _corr("ra", "rb", 0.0)


@register("Q6_spearman", _TR_SQL + "\n" + " UNION ALL ".join(
    [_spearman_sql("true", "global")] + [_spearman_sql(f"category = '{c}'", c) for c in FOCUS]))
def q6(spark, sf_dir):
    tr = transitions(spark, sf_dir)
    glob = stats.spearman(tr, "bucket", "bucket_t_plus_7").select(F.lit("global").alias("scope"), "n_pairs", "spearman")
    per = (stats.spearman(tr.where(F.col("category").isin(*FOCUS)), "bucket", "bucket_t_plus_7", by="category")
           .select(F.col("category").alias("scope"), "n_pairs", "spearman"))
    return rounded(glob.unionByName(per), 6)


def user_entropy(spark, sf_dir):
    ud = shared.frame(spark, "user_daily_target", sf_dir, lambda: with_target(user_daily_grid(tx_of(spark, sf_dir)), ["user_id"]))
    thr = shared.value(spark, "user_daily_thresholds", sf_dir, lambda: B.tune_thresholds(ud, "target_7d_sum"))
    ub = ud.withColumn("bucket", bucket_strict("target_7d_sum", thr["low"], thr["high"])).where(F.col("bucket").isNotNull())
    cnt = ub.groupBy("user_id", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ent = cnt.groupBy("user_id").agg(F.sum("n").alias("tot"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    ent = ent.select("user_id", (F.log2("tot") - F.col("s") / F.col("tot")).alias("entropy"))
    return ent.withColumn("entropy_level", entropy_level("entropy"))


_ENT_SQL = _GRID_SQL + """,
ud AS (SELECT user_id, event_date, sum(amount) AS amount FROM grid GROUP BY ALL),
uy AS (SELECT user_id, event_date, amount, CASE WHEN count(amount) OVER f7 = 7 THEN sum(amount) OVER f7 END AS y
       FROM ud WINDOW f7 AS (PARTITION BY user_id ORDER BY event_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))""" + tune_sql("uy", "u") + """,
ub AS (SELECT user_id, CASE WHEN y = 0 THEN 0 WHEN y > 0 AND y <= lo THEN 1 WHEN y > lo AND y <= hi THEN 2 WHEN y > hi THEN 3 END AS bucket
       FROM uy, u_best),
uc AS (SELECT user_id, bucket, CAST(count(*) AS DOUBLE) AS n FROM ub WHERE bucket IS NOT NULL GROUP BY ALL),
ue AS (SELECT user_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM uc GROUP BY user_id),
uel AS (SELECT user_id, entropy, CASE WHEN entropy < 0.8 THEN 'low' WHEN entropy < 1.4 THEN 'medium' ELSE 'high' END AS entropy_level FROM ue)"""


@register("Q7_user_entropy", _ENT_SQL + "\nSELECT user_id, round(entropy, 6) AS entropy, entropy_level FROM uel")
def q7(spark, sf_dir):
    return rounded(user_entropy(spark, sf_dir), 6)


@register("Q7_entropy_summary", _ENT_SQL + """
SELECT round(quantile_cont(entropy, 0.1), 6) AS p10, round(quantile_cont(entropy, 0.5), 6) AS p50,
       round(quantile_cont(entropy, 0.9), 6) AS p90,
       round(avg(CASE WHEN entropy_level = 'low' THEN 1.0 ELSE 0.0 END), 6) AS share_low,
       round(avg(CASE WHEN entropy_level = 'medium' THEN 1.0 ELSE 0.0 END), 6) AS share_medium,
       round(avg(CASE WHEN entropy_level = 'high' THEN 1.0 ELSE 0.0 END), 6) AS share_high FROM uel""")
def q7s(spark, sf_dir):
    e = user_entropy(spark, sf_dir)
    lv = F.col("entropy_level")
    probs = [0.1, 0.5, 0.9]
    found = exact_quantiles(e, "entropy", probs)
    return rounded(e.agg(*[F.lit(v).cast("double").alias(f"p{int(q * 100)}") for q, v in zip(probs, found)], share(lv == "low").alias("share_low"),
                         share(lv == "medium").alias("share_medium"), share(lv == "high").alias("share_high")), 6)


@register("A5_histogram_entropy", _ENT_SQL + """,
mm AS (SELECT min(entropy) AS lo, CASE WHEN max(entropy) > min(entropy) THEN max(entropy) - min(entropy) ELSE 1.0 END AS w FROM uel)
SELECT 'entropy' AS series, CAST(least(39, floor((entropy - lo) / w * 40)) AS INT) AS bin,
       round(lo + CAST(least(39, floor((entropy - lo) / w * 40)) AS INT) * (w / 40), 4) AS bin_lo, count(*) AS n
FROM uel, mm WHERE entropy IS NOT NULL GROUP BY ALL""")
def a5e(spark, sf_dir):
    return rounded(stats.histogram(user_entropy(spark, sf_dir), "entropy", 40))


MODEL_FEATURES = ["prev_bucket_1", "prev_bucket_2", "rolling_sum_7d", "rolling_sum_30d", "is_weekend",
                  "is_month_end", "cumulative_spend_30d"]


def model_frame(spark, sf_dir) -> DataFrame:
    """7 features from lags, trailing sums, calendar flags and the user's trailing
    30-row spend (J4); incomplete rows dropped; B9 date-quantile split."""
    g, _ = bucketed(spark, sf_dir)
    w = W.spec(KEYS, "event_date")
    f = g.select(
        *KEYS, "event_date", "amount", "bucket",
        W.lag_k("bucket", w, 1).alias("prev_bucket_1"), W.lag_k("bucket", w, 2).alias("prev_bucket_2"),
        W.trailing_sum("amount", w, 7).alias("rolling_sum_7d"), W.trailing_sum("amount", w, 30).alias("rolling_sum_30d"),
        is_weekend("event_date").alias("is_weekend"), is_month_end("event_date").alias("is_month_end"),
        F.col("user_trailing_sum_30").alias("cumulative_spend_30d"))
    f = f.dropna(subset=["bucket"] + MODEL_FEATURES)
    return B.split_by_date_quantile(f, "event_date", 0.8)


@register("L15_model_frame", _BK_SQL + """,
mf AS (SELECT user_id, category, event_date, amount, bucket,
         lag(bucket, 1) OVER w AS prev_bucket_1, lag(bucket, 2) OVER w AS prev_bucket_2,
         sum(amount) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_sum_7d,
         sum(amount) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS rolling_sum_30d,
         CAST(dayofweek(event_date) IN (0, 6) AS INT) AS is_weekend,
         CAST(event_date = last_day(event_date) AS INT) AS is_month_end
       FROM bk WINDOW w AS (PARTITION BY user_id, category ORDER BY event_date)),
udy AS (SELECT user_id, event_date, sum(amount) AS u FROM mf GROUP BY ALL),
udc AS (SELECT user_id, event_date, sum(u) OVER (PARTITION BY user_id ORDER BY event_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS cumulative_spend_30d FROM udy),
full_f AS (SELECT m.*, c.cumulative_spend_30d FROM mf m LEFT JOIN udc c ON m.user_id = c.user_id AND m.event_date = c.event_date
           WHERE bucket IS NOT NULL AND prev_bucket_1 IS NOT NULL AND prev_bucket_2 IS NOT NULL AND rolling_sum_7d IS NOT NULL
             AND rolling_sum_30d IS NOT NULL AND c.cumulative_spend_30d IS NOT NULL),
sq AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', event_date) AS DOUBLE), 0.8) AS q FROM full_f)
SELECT user_id, category, event_date, round(amount, 4) AS amount, bucket, prev_bucket_1, prev_bucket_2,
       round(rolling_sum_7d, 4) AS rolling_sum_7d, round(rolling_sum_30d, 4) AS rolling_sum_30d, is_weekend, is_month_end,
       round(cumulative_spend_30d, 4) AS cumulative_spend_30d,
       CAST(date_diff('day', DATE '1970-01-01', event_date) > q AS INT) AS is_test
FROM full_f, sq""")
def l15(spark, sf_dir):
    return rounded(model_frame(spark, sf_dir))
