"""Two-dimensional density, coverage and score maps."""

from pyspark.sql import functions as F

from assayloom.catalog.registry import query, rounded
from assayloom.catalog.views import BINS
from assayloom.operators import density as D


def edges(v):
    return D.edges_of([v.xy], BINS)


def ratio_pair(v):
    """Ratio maps of two pick sets: early and late rounds."""
    e, picks = edges(v), v.picks
    return (
        D.density_ratio(v.background, picks.where("al_round <= 2"), e),
        D.density_ratio(v.background, picks.where("al_round > 2"), e),
    )


@query("agg_shared_edges", "SELECT round(x0, 6) AS x0, round(wx, 6) AS wx, round(y0, 6) AS y0, round(wy, 6) AS wy FROM v_edges")
def _(v):
    return rounded(D.shared_edges([v.background, v.picks], BINS), "x0", "wx", "y0", "wy")


@query("agg_hist2d", "SELECT ix, iy, count(*) AS n FROM v_binned GROUP BY 1, 2")
def _(v):
    return D.hist2d(v.xy, edges(v))


@query("agg_density_ratio", "SELECT ix, iy, n_bg, n_pick, round(log2r, 6) AS log2r FROM v_ratio")
def _(v):
    return rounded(D.density_ratio(v.background, v.picks, edges(v)), "log2r")


@query("agg_coverage_fraction", """
    SELECT ix, iy, round(n_pick::DOUBLE / (n_pick + n_bg), 6) AS cover, round(pick_total::DOUBLE / (pick_total + bg_total), 6) AS expected
    FROM v_maps WHERE n_bg >= 3""")
def _(v):
    return rounded(D.coverage_fraction(v.background, v.picks, edges(v)), "cover", "expected")


@query("agg_log_density", "SELECT ix, iy, round(log10(n_bg + 1), 6) AS log_bg, round(log10(n_pick + 1), 6) AS log_pick FROM v_maps WHERE n_bg > 0")
def _(v):
    return rounded(D.log_density(v.background, v.picks, edges(v)), "log_bg", "log_pick")


@query("agg_ratio_summary", """
    SELECT count(*) AS bins, round(avg(log2r), 6) AS mean, round(median(log2r), 6) AS median, round(stddev_pop(log2r), 6) AS std,
           round(quantile_cont(log2r, 0.75) - quantile_cont(log2r, 0.25), 6) AS iqr,
           count(*) FILTER (log2r < -2) AS n_under2, count(*) FILTER (log2r >= -2 AND log2r < 0) AS n_below,
           count(*) FILTER (log2r >= 0 AND log2r < 2) AS n_above, count(*) FILTER (log2r >= 2) AS n_over2
    FROM v_ratio WHERE log2r IS NOT NULL""")
def _(v):
    return rounded(D.ratio_summary(D.density_ratio(v.background, v.picks, edges(v))), "mean", "median", "std", "iqr")


def _spread(c: str) -> str:
    return f"""stddev_pop({c}) AS std, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr,
               100.0::DOUBLE * count(*) FILTER ({c} < -2) / count(*) AS under, 100.0::DOUBLE * count(*) FILTER ({c} > 2) / count(*) AS over"""


@query("agg_ratio_compare", f"""
    WITH a AS (SELECT {_spread('log2r_a')} FROM v_ratio WHERE log2r_a IS NOT NULL),
    b AS (SELECT {_spread('log2r_b')} FROM v_ratio WHERE log2r_b IS NOT NULL)
    SELECT round(b.std - a.std, 6) AS d_std, round(b.iqr - a.iqr, 6) AS d_iqr, round(b.under - a.under, 6) AS d_under,
           round(b.over - a.over, 6) AS d_over FROM a, b""")
def _(v):
    return rounded(D.ratio_compare(*ratio_pair(v)), "d_std", "d_iqr", "d_under", "d_over")


@query("agg_density_by_round", """
    WITH t AS (SELECT al_round, count(*) AS total FROM v_binned WHERE is_pick GROUP BY 1),
    p AS (SELECT al_round, ix, iy, count(*) AS n FROM v_binned WHERE is_pick GROUP BY 1, 2, 3)
    SELECT t.al_round, m.ix, m.iy, round(log2((coalesce(p.n, 0) / t.total + 1e-9::DOUBLE) / (m.n_bg / m.bg_total + 1e-9::DOUBLE)), 6) AS log2r
    FROM v_maps m CROSS JOIN t LEFT JOIN p ON p.al_round = t.al_round AND p.ix = m.ix AND p.iy = m.iy WHERE m.n_bg >= 3""")
def _(v):
    return rounded(D.density_by_round(v.background, v.picks, edges(v)), "log2r")


@query("agg_bin_score_stats", "SELECT ix, iy, round(mean, 6) AS mean, best, n FROM v_slots WHERE slot = -1")
def _(v):
    return rounded(D.bin_score_stats(v.xy, edges(v)), "mean")


@query("agg_bin_stats_all_slot", "SELECT slot, ix, iy, round(mean, 6) AS mean, best, n FROM v_slots")
def _(v):
    return rounded(D.bin_stats_all_slot(v.xy, edges(v)), "mean")


@query("agg_colour_limits", """
    SELECT 'score_min' AS name, round(floor(min(score)), 6) AS value FROM v_xy
    UNION ALL SELECT 'score_max', round(quantile_cont(score, 0.95), 6) FROM v_xy
    UNION ALL SELECT 'count_max', floor(quantile_cont(n, 0.99)) FROM v_slots
    UNION ALL SELECT 'ratio_max', round(least(4.0::DOUBLE, quantile_cont(abs(log2r), 0.995)), 6) FROM v_ratio WHERE log2r IS NOT NULL
    UNION ALL SELECT 'diff_max', round(least(3.0::DOUBLE, max(abs(log2r_a - log2r_b))), 6) FROM v_ratio""")
def _(v):
    e = edges(v)
    early, late = ratio_pair(v)
    return rounded(D.colour_limits(
        v.xy, D.bin_stats_all_slot(v.xy, e), D.density_ratio(v.background, v.picks, e), D.bins_diff(early, late)
    ), "value")


@query("agg_contour_levels", """
    SELECT round(quantile_cont(n_bg, 0.5), 6) AS p50, round(quantile_cont(n_bg, 0.8), 6) AS p80, round(quantile_cont(n_bg, 0.95), 6) AS p95
    FROM v_maps WHERE n_bg > 0""")
def _(v):
    return rounded(D.contour_levels(D.hist2d(v.background, edges(v))), "p50", "p80", "p95")
