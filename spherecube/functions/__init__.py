"""Column expressions."""

from .columns import (
    axis_of, clean, country_of, days_since, domain_of, ln_positive, quarter_label, quarter_name, quarter_number,
    quarter_start, recode, region_code,
    replace_zero, strict_max_abs, strict_mean, tidy, united, year_label,
)

__all__ = [
    "axis_of", "clean", "country_of", "days_since", "domain_of", "ln_positive", "quarter_label", "quarter_name",
    "quarter_number", "quarter_start",
    "recode", "region_code", "replace_zero", "strict_max_abs", "strict_mean", "tidy", "united", "year_label",
]
