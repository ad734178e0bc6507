from panelkit.operators.clean import cols_like, drop_empty_columns, latest_column, recode, rename_like
from panelkit.operators.correlation import cor_matrix, cor_pvalues, cor_test, cor_with, spearman
from panelkit.operators.filters import at_date, at_latest, drop_in, keep_in, split_unallocated, split_outliers, without_outliers
from panelkit.operators.joins import full_join_all, group_join, natural_join
from panelkit.operators.models import anova, apply_linear, lasso, ols, step_aic
from panelkit.operators.ordering import ordered_levels, ranked_values, running_total, top_k
from panelkit.operators.rates import panel_rates, positivity, rolling_rate, snapshot_rates
from panelkit.operators.reshape import (
    melt_panel, menu, pack_dates, split_label, spread, unpack_dates, upper_triangle,
)
from panelkit.operators.series import daily_new, rolling_mean_strict, weekly_totals
from panelkit.operators.shares import (
    category_share, mean_above, share, subset_cells, subset_shares, subset_totals, two_level_share, with_total,
)
from panelkit.operators.summary import box_outliers, date_span, five_number, hinges, join_lines, quantiles

__all__ = [
    "anova", "apply_linear", "at_date", "at_latest", "box_outliers", "category_share", "cols_like", "cor_matrix",
    "cor_pvalues", "cor_test", "cor_with", "daily_new", "date_span", "drop_empty_columns", "drop_in",
    "five_number", "full_join_all", "group_join", "hinges", "join_lines", "keep_in", "lasso", "latest_column", "mean_above",
    "melt_panel", "menu", "natural_join", "ols", "ordered_levels", "pack_dates", "panel_rates", "positivity", "quantiles", "ranked_values",
    "recode", "rename_like", "rolling_mean_strict", "rolling_rate", "running_total", "share", "snapshot_rates",
    "spearman", "split_label", "split_unallocated", "spread", "step_aic", "subset_cells", "subset_shares",
    "subset_totals", "top_k", "two_level_share", "unpack_dates", "upper_triangle", "weekly_totals", "with_total",
    "split_outliers", "without_outliers",
]
