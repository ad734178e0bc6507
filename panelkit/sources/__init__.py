from panelkit.sources.census import acs_table
from panelkit.sources.html import extract_links, first_links
from panelkit.sources.tables import lookup, read_table, read_wide, write_table
from panelkit.sources.wide import read_wide_panel

__all__ = [
    "acs_table", "extract_links", "first_links", "lookup", "read_table", "read_wide",
    "read_wide_panel", "write_table",
]
