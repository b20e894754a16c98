"""Numeric column helpers shared by every plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Half-up rounding on a decimal, so binary noise never decides a tie."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where the divisor is zero or missing."""
    return num / F.nullif(den, F.lit(0.0))


def pct_change(new: Column, old: Column) -> Column:
    return ratio(new - old, old) * 100


def bps_change(new: Column, old: Column) -> Column:
    return (new - old) * 100


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def direction(change: Column, invert: Column | bool = False) -> Column:
    """pos / neg by sign; a zero change counts as a fall, a missing one as neutral."""
    flip = invert if isinstance(invert, Column) else F.lit(invert)
    return (
        F.when(change.isNull(), "neu")
        .when((change > 0) != flip, "pos")
        .otherwise("neg")
    )


def ratio_direction(change: Column) -> Column:
    return F.when(change > 0, "pos").when(change < 0, "neg").otherwise("neu")


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the weights whose condition holds; a null condition adds nothing."""
    terms = [F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0)) for cond, w in rules]
    return reduce(lambda a, b: a + b, terms)


def blend(r1w: Column, r4w: Column, r13w: Column) -> Column:
    return r1w * 0.2 + r4w * 0.3 + r13w * 0.5


#: Trend label and score bonus.
RS_TRENDS = {"up": ("加速上升", 5), "hold": ("穩定維持", 2), "down": ("開始衰退", -5), "mixed": ("震盪", 0)}


def _by_rs_trend(r1w: Column, r4w: Column, r13w: Column, field: int) -> Column:
    return (
        F.when((r1w > r4w) & (r4w > r13w), RS_TRENDS["up"][field])
        .when((r1w >= r4w) & (r4w >= r13w), RS_TRENDS["hold"][field])
        .when((r1w < r4w) & (r4w < r13w), RS_TRENDS["down"][field])
        .otherwise(RS_TRENDS["mixed"][field])
    )


def rs_trend(r1w: Column, r4w: Column, r13w: Column) -> Column:
    return _by_rs_trend(r1w, r4w, r13w, 0)


def rs_total(r1w: Column, r4w: Column, r13w: Column) -> Column:
    """Weighted percentile mix plus trend bonus, at most 100, not yet rounded."""
    return F.least(F.lit(100.0), blend(r1w, r4w, r13w) + _by_rs_trend(r1w, r4w, r13w, 1))


def combined(rs: Column, contraction: Column) -> Column:
    return rs * 0.6 + contraction * 0.4


# ---- display strings -------------------------------------------------------

MISSING = "—"


def shown(value: Column, pattern: str) -> Column:
    """A number in a decimal-format pattern such as `#,##0.00`."""
    return F.call_function("format_number", value, F.lit(pattern))


def _arrow(change: Column) -> Column:
    return F.when(change > 0, "▲ ").otherwise("▼ ")


def fmt_change(change: Column, unit: Column) -> Column:
    """`▲ 1.23%` for unit pct, `▼ 4bps` for unit bps."""
    body = F.when(unit == "bps", F.concat(shown(rnd(F.abs(change), 0), "0"), F.lit("bps"))).otherwise(
        F.concat(shown(rnd(F.abs(change), 2), "0.00"), F.lit("%"))
    )
    return F.coalesce(F.concat(_arrow(change), body), F.lit(MISSING))


def fmt_signed(change: Column, digits: int) -> Column:
    """`+1.23%` style used by the weekly panels."""
    pattern = "0." + "0" * digits
    sign = F.when(change < 0, "-").otherwise("+")
    return F.coalesce(
        F.concat(sign, shown(rnd(F.abs(change), digits), pattern), F.lit("%")), F.lit(MISSING)
    )


def fmt_value(value: Column, prefix: Column | None = None) -> Column:
    text = shown(rnd(value, 2), "#,##0.00")
    return F.coalesce(F.concat(prefix, text) if prefix is not None else text, F.lit(MISSING))
