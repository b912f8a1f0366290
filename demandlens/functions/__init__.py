"""Column expressions: pure ``Column -> Column`` helpers, all JVM-side."""

from demandlens.functions.bins import (
    calibration_bin, discount_bin, fine_discount_bin, report_bin, report_bin_ordinal,
)
from demandlens.functions.calendar import calendar_columns
from demandlens.functions.numeric import (
    clamp_non_negative, clean_feature, nan_to_null, percent_error, ratio_with_inf,
)

__all__ = [
    "calibration_bin", "discount_bin", "fine_discount_bin", "report_bin", "report_bin_ordinal",
    "calendar_columns", "clamp_non_negative", "clean_feature", "nan_to_null",
    "percent_error", "ratio_with_inf",
]
