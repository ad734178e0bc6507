from panelkit.plans.census import acs_tidy, split_place, tidy_dictionary
from panelkit.plans.city import ancestry_shares, city_measure, city_report, city_study, city_table
from panelkit.plans.features import feature_block, feature_master, predict_case_rate
from panelkit.plans.panel import build_panel
from panelkit.plans.refresh import published, refresh_panel
from panelkit.plans.reports import (
    compare, daily_bulletin, last_published_week, map_layer, profile, publish_gate, stacked_shares,
    unallocated_table, weekly_bulletins,
)
from panelkit.plans.snapshot import build_snapshot

__all__ = [
    "acs_tidy", "ancestry_shares", "build_panel", "build_snapshot", "city_measure", "city_report", "city_study",
    "city_table", "compare", "daily_bulletin", "feature_block", "feature_master", "last_published_week",
    "map_layer", "predict_case_rate", "profile", "publish_gate", "published", "refresh_panel", "split_place", "stacked_shares",
    "tidy_dictionary", "unallocated_table", "weekly_bulletins",
]
