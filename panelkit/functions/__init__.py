from panelkit.functions.bands import band, code_list, flag, group_of
from panelkit.functions.dates import long_date, parse_us_date, short_date, sunday_week
from panelkit.functions.numbers import (
    clean_number, decensor, half_even, number_text, per_capita, range_midpoint, ratio, signif, sum_strict,
)
from panelkit.functions.tails import f_upper, t_two_sided
from panelkit.functions.text import canonical, extract_or_null, label_depth, last_part, title_name

__all__ = [
    "band", "canonical", "clean_number", "code_list", "decensor", "extract_or_null", "f_upper", "flag",
    "group_of", "half_even", "label_depth", "last_part", "long_date", "number_text", "parse_us_date",
    "per_capita", "range_midpoint", "ratio", "short_date", "signif", "sum_strict", "sunday_week",
    "t_two_sided", "title_name",
]
