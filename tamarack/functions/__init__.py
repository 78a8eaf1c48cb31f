"""Column functions. All build Catalyst expressions; none runs Python per row."""

from tamarack.functions.labels import banded, interpret, label_flag, time_window, verdict_tier
from tamarack.functions.numbers import (
    capped,
    clip,
    euclid,
    mean,
    mean_if,
    pct_change,
    pct_true,
    per_year,
    positive_count,
    ratio_pct,
    round_exact,
    safe_div,
    sd_or_null,
    sum_if,
    weighted_clip_score,
    zscore,
)
from tamarack.functions.text import contains_text, strip_pictographs, title_case
from tamarack.functions.times import days_between, hour_start, micros, plus_days, year_of

__all__ = [
    "banded", "capped", "clip", "contains_text", "days_between", "euclid", "hour_start", "interpret", "label_flag",
    "mean", "mean_if", "micros", "pct_change", "pct_true", "per_year", "plus_days", "positive_count",
    "ratio_pct", "round_exact", "safe_div", "sd_or_null", "strip_pictographs", "sum_if", "time_window",
    "title_case", "verdict_tier", "weighted_clip_score", "year_of", "zscore",
]
