"""Row predicates and scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv


def starts_on_sunday_midnight(ts: Column) -> Column:
    """Calendar alignment; seconds are not looked at and a null start is kept."""
    return F.coalesce((F.dayofweek(ts) == 1) & (F.hour(ts) == 0) & (F.minute(ts) == 0), F.lit(True))


def not_before(ts: Column, cutoff: str = fv.SCORING_CUTOFF) -> Column:
    """Cut-off, inclusive; a null start is kept."""
    return F.coalesce(ts >= F.to_timestamp(F.lit(cutoff)), F.lit(True))


def passes_gate(ts: Column, cutoff: str = fv.SCORING_CUTOFF) -> Column:
    return starts_on_sunday_midnight(ts) & not_before(ts, cutoff)


def parse_time(text: Column) -> Column:
    """Time from ISO text or from the slashed form ``yyyy/MM/dd HH:mm:ss.SSS``; null if it is neither."""
    dashed = F.regexp_replace(F.trim(text), r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return dashed.try_cast("timestamp")


def passes_text_gate(start: Column, cutoff: str = fv.SCORING_CUTOFF) -> Column:
    """The same gate on a start given as text; text that is no time passes."""
    return passes_gate(parse_time(start), cutoff)


def in_range(ts: Column, first: str, last: str) -> Column:
    return ts.between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)))


def has_length(values: Column, length: int) -> Column:
    return F.coalesce(F.size(values) == length, F.lit(False))


def outcome(code: Column) -> Column:
    """Routing of a scoring reply: 200 scored, 204 skipped, anything else failed."""
    return F.when(code == 200, "scored").when(code == 204, "skipped").otherwise("failed")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where ``b`` is 0 or missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def draw(*parts: Column | str) -> Column:
    """Deterministic 32-bit draw from key parts, the same under any partitioning."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """Deterministic draw in [0, 1)."""
    return draw(*parts) / F.lit(float(2**32))


def list_text(text: Column) -> Column:
    """``"[a, b]"`` to numbers; an element that is no number becomes null."""
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]]", ""), ","), lambda x: F.trim(x).try_cast("double"))


def rolled(values: Column, shift: int, length: int) -> Column:
    """Circular shift to the right by ``shift``."""
    k = shift % length
    if k == 0:
        return values
    return F.concat(F.slice(values, length - k + 1, k), F.slice(values, 1, length - k))


def weekday_cycle(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of week with Monday = 0."""
    angle = 2 * F.lit(3.141592653589793) * F.weekday(ts) / 7
    return F.sin(angle), F.cos(angle)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
