"""Number formats: what kind of values they show, and values as they are shown."""

from __future__ import annotations

import math
import re
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Built-in number formats by id (fixed values).
BUILT_IN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: '"$"#,##0_);("$"#,##0)', 6: '"$"#,##0_);[Red]("$"#,##0)', 7: '"$"#,##0.00_);("$"#,##0.00)', 8: '"$"#,##0.00_);[Red]("$"#,##0.00)',
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 41: '_(* #,##0_);_(* \\(#,##0\\);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_)_("$"* \\(#,##0.00\\)_("$"* "-"??_)_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_CURRENCY = "$€£¥₹"


def bare(code: str) -> str:
    """The first section of a format without quoted text, escapes, padding and bracketed tags but elapsed times."""
    return re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hmsHMS]+\])[^\]]*\]', "", code.split(";")[0])


def is_date_format(code: str) -> bool:
    """Whether a number format shows dates or times."""
    text = bare(code).lower()
    return "general" not in text and bool(re.search(r"[dmyhs]", text))


def category(code: str | None) -> str:
    """general, integer, float, percentage, currency, date, time, datetime, scientific or text."""
    if not code or code.lower() == "general":
        return "general"
    if code.strip() == "@":
        return "text"
    plain, low = bare(code), bare(code).lower()
    if is_date_format(code):
        days, hours = bool(re.search(r"[dy]", low)), bool(re.search(r"[hs]", low))
        months = "m" in low and not hours
        return "datetime" if days and hours else "time" if hours else "date" if days or months else "time"
    if "%" in plain:
        return "percentage"
    if any(c in code.split(";")[0] for c in _CURRENCY) or re.search(r"\[\$[^\]-]", code):
        return "currency"
    if re.search(r"0[eE][+-]", plain):
        return "scientific"
    return "float" if "." in plain else "integer" if re.search(r"[0#]", plain) else "general"


def symbol(code: str) -> str:
    """The currency sign of a format."""
    tagged = re.search(r"\[\$([^\]-]+)", code)
    return tagged[1] if tagged else next((c for c in code if c in _CURRENCY), "$")


def plain_number(x: float) -> str:
    """A number without trailing zeros, at most ten places."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10f}".rstrip("0").rstrip(".")


def display(value, code: str | None = None) -> str:
    """A value as a sheet shows it: whole numbers grouped, currencies with two places, percentages with one, scientific
    numbers with four; other numbers without trailing zeros."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (datetime, date, time)):
        return value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    if not isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "inf" if value > 0 else "-inf"
    kind = category(code)
    if kind == "currency":
        return f"{'-' * (value < 0)}{symbol(code)}{abs(value):,.2f}"
    if kind == "percentage":
        return f"{value * 100:.1f}%"
    if kind == "scientific":
        return f"{value:.4e}"
    if kind == "integer" or isinstance(value, int) or value == int(value):
        return f"{round(value):,}"
    return plain_number(value)


def displayed(c: Column, code: str) -> Column:
    """display() of a column of numbers, for one format."""
    kind, x = category(code), c.cast("double")
    if kind == "currency":
        return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit(symbol(code)), F.format_number(F.abs(x), 2))
    if kind == "percentage":
        return F.concat(F.format_string("%.1f", x * 100), F.lit("%"))
    if kind == "scientific":
        return F.format_string("%.4e", x)
    whole = F.format_number(F.bround(x, 0), 0)
    short = F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", "")
    return whole if kind == "integer" else F.when(x == F.floor(x), whole).otherwise(short)


def from_excel(value: float | None, date1904: bool = False, timespan: bool = False):
    """A serial as a datetime, or a time below 1, rounded to milliseconds; timespan: as a timedelta."""
    if value is None:
        return None
    if timespan:
        return timedelta(milliseconds=round(value * 86_400_000))
    days, ms = divmod(round(value * 86_400_000), 86_400_000)
    if 0 <= value < 1 and not date1904 and days == 0:
        return (datetime(1900, 1, 1) + timedelta(milliseconds=ms)).time()
    base = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 31) if 0 < days < 60 else datetime(1899, 12, 30)
    return base + timedelta(days=days, milliseconds=ms)


def to_excel(moment: datetime | date | time | timedelta, date1904: bool = False) -> float:
    """The serial of a moment, a time or a span."""
    if isinstance(moment, timedelta):
        return moment.total_seconds() / 86400
    if isinstance(moment, time):
        return (moment.hour * 3600 + moment.minute * 60 + moment.second + moment.microsecond / 1e6) / 86400
    whole = moment if isinstance(moment, datetime) else datetime(moment.year, moment.month, moment.day)
    days = (whole.replace(tzinfo=None) - (datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 30))).total_seconds() / 86400
    return days - 1 if not date1904 and 0 < days < 61 else days
