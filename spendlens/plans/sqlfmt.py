"""Helpers for writing oracle SQL with the same rounding as :func:`registry.rounded`."""

from __future__ import annotations


def select_rounded(src: str, doubles: list[str], others: list[str], digits: int = 4,
                   casts: dict[str, str] | None = None, where: str | None = None,
                   digits_by: dict[str, int] | None = None) -> str:
    casts = casts or {}
    digits_by = digits_by or {}
    parts = [f"{c}" if c not in casts else f"CAST({c} AS {casts[c]}) AS {c}" for c in others]
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
    parts += [f"(round(CAST({c} AS DOUBLE), {digits_by.get(c, digits)}) + 0.0) AS {c}" for c in doubles]
    sql = f"SELECT {', '.join(parts)} FROM {src}"
    return sql + (f" WHERE {where}" if where else "")


def rolling_std_sql(c: str, k: int, win: str) -> str:
    """Same two-pass sample std over k lags as ``windows.rolling_std_prev``."""
    xs = [f"CAST(lag({c}, {i}) OVER {win} AS DOUBLE)" for i in range(1, k + 1)]
    n = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN 1.0 ELSE 0.0 END)" for x in xs)
    mean = f"(({' + '.join(f'coalesce({x}, 0.0)' for x in xs)}) / ({n}))"
    ss = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN ({x} - {mean}) * ({x} - {mean}) ELSE 0.0 END)" for x in xs)
    return f"(CASE WHEN ({n}) >= 2 THEN sqrt(({ss}) / (({n}) - 1)) END)"


def corr_sql(x: str, y: str, eps: float = 1e-8) -> str:
    """Guarded Pearson over non-null pairs, identical in meaning to ``expr.guarded_corr``."""
    xs = f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END)"
    ys = f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END)"
    return (f"(CASE WHEN count({xs}) >= 2 AND stddev_samp({xs}) > {eps} AND stddev_samp({ys}) > {eps} "
            f"THEN covar_samp({xs}, {ys}) / (stddev_samp({xs}) * stddev_samp({ys})) END)")


def summary_sql(src: str, y: str, p: str, labels, by: str | None = None) -> str:
    """SQL for ``metrics.classification_summary`` over ``src``."""
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    lab = ", ".join(str(x) for x in labels)
    return f"""(WITH _pl AS (
   SELECT {g}l.label, count(*) FILTER (WHERE {y} = l.label AND {p} = l.label) AS tp,
          count(*) FILTER (WHERE {y} = l.label) AS support, count(*) FILTER (WHERE {p} = l.label) AS predicted
   FROM {src} CROSS JOIN (SELECT unnest([{lab}]) AS label) l GROUP BY {g}l.label),
 _n AS (SELECT {g}count(*) AS n_rows FROM {src} {gb}),
 _f AS (SELECT *, coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0) AS f1, tp / nullif(support, 0) AS rec FROM _pl)
 SELECT {('_f.' + by + ', ') if by else ''}any_value(_n.n_rows) AS n_rows,
        round(avg(CASE WHEN support + predicted > 0 THEN f1 END), 6) AS f1_macro,
        round(avg(f1), 6) AS f1_macro_fixed,
        round(sum(f1 * support) / nullif(sum(support), 0), 6) AS f1_weighted,
        round(sum(tp) / any_value(_n.n_rows), 6) AS accuracy,
        round(avg(CASE WHEN support > 0 THEN rec END), 6) AS balanced_accuracy
 FROM _f {'JOIN _n ON _n.' + by + ' = _f.' + by if by else 'CROSS JOIN _n'} {('GROUP BY _f.' + by) if by else ''})"""
