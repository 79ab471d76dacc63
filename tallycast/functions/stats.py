"""Gated window statistics and small numeric helpers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b`` with a null result where ``b`` is 0 (ANSI mode would raise)."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def gated(stat: Column, count: Column, need: int) -> Column:
    return F.when(count >= need, stat)


def rolling(fn, value: Column, w: WindowSpec, size: int, need: int, end: int = 0) -> Column:
    """``fn`` over the ``size`` rows ending ``end`` rows from the current one.

    Null unless at least ``need`` values are known.
    """
    frame = w.rowsBetween(end - size + 1, end)
    return gated(fn(value).over(frame), F.count(value).over(frame), need)


class Running:
    """Rolling sums as differences of running sums.

    A sliding frame re-adds its rows for every row it moves to; a running sum is one
    addition per row whatever the window length. Counts are integers, so the differences
    are exact. Create the running columns in one projection, then read spans from them in
    the next (same window, so the sort is shared).
    """

    def __init__(self, w: WindowSpec, values: dict[str, Column]) -> None:
        self.w = w
        start = w.rowsBetween(Window.unboundedPreceding, 0)
        self.columns = {f"__s_{k}": F.coalesce(F.sum(v).over(start), F.lit(0)) for k, v in values.items()}
        self.columns |= {f"__c_{k}": F.count(v).over(start) for k, v in values.items()}

    def _at(self, name: str, row: int) -> Column:
        if row == 0:
            return F.col(name)
        if row > 0:  # past the end: unknown
            return F.lead(name, row).over(self.w)
        return F.coalesce(F.lag(name, -row).over(self.w), F.lit(0))

    def total(self, name: str, first: int, last: int) -> Column:
        """Sum over rows first..last relative to the current row."""
        return self._at(f"__s_{name}", last) - self._at(f"__s_{name}", first - 1)

    def known(self, name: str, first: int, last: int) -> Column:
        return self._at(f"__c_{name}", last) - self._at(f"__c_{name}", first - 1)

    def mean(self, name: str, size: int, need: int, end: int = 0) -> Column:
        c = self.known(name, end - size + 1, end)
        return F.when(c >= need, self.total(name, end - size + 1, end).cast("double") / F.nullif(c, F.lit(0)))

    def gated_total(self, name: str, size: int, need: int, end: int = 0) -> Column:
        return F.when(self.known(name, end - size + 1, end) >= need, self.total(name, end - size + 1, end))

    @staticmethod
    def squares(name: str, value: Column) -> dict[str, Column]:
        """Two values to sum up for :meth:`sample_sd`: the high and the low 32 bits of the square.

        Either sum stays within 64 bits for 2**31 rows, where squares themselves would not; |value| < 3.03e9.
        """
        square = value.cast("bigint") * value.cast("bigint")
        return {f"{name}_hi": F.shiftright(square, 32), f"{name}_lo": square.bitwiseAND(F.lit((1 << 32) - 1))}

    def sample_sd(self, name: str, square: str, size: int, need: int) -> Column:
        """ddof 1, from integer sums of values and squares: no rounding before the division."""
        c = self.known(name, 1 - size, 0)
        high, low = (self.total(f"{square}_{part}", 1 - size, 0).cast("decimal(19,0)") for part in ("hi", "lo"))
        s, q = self.total(name, 1 - size, 0).cast("decimal(19,0)"), high * F.lit(1 << 32).cast("decimal(11,0)") + low
        spread = (c.cast("decimal(7,0)") * q - s * s).cast("double")
        return F.when((c >= need) & (c > 1), F.sqrt(spread / F.nullif(c * (c - 1), F.lit(0))))


def strict_sum(cols: list[Column]) -> Column:
    """Row-wise sum, null when any column is null (plain ``+`` does exactly that)."""
    return reduce(add, cols)


def strict_mean(cols: list[Column]) -> Column:
    return strict_sum(cols) / F.lit(float(len(cols)))


def known_mean(cols: list[Column], need: int) -> Column:
    """Row-wise mean of the non-null columns, null when fewer than ``need`` are known."""
    known = reduce(add, (c.isNotNull().cast("int") for c in cols))
    total = reduce(add, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols))
    return F.when(known >= need, total / F.nullif(known, F.lit(0)))


def log_ratio(ratio: Column, floor: float) -> Column:
    """``ln(max(ratio, floor))`` with null -> 0. ``greatest`` skips nulls, so test first."""
    return F.when(ratio.isNull(), F.lit(0.0)).otherwise(F.log(F.greatest(ratio, F.lit(floor))))


def one_hot(column: Column, levels: list, prefix: str) -> dict[str, Column]:
    """Indicators of fixed levels; the reference level is the one left out of ``levels``."""
    return {f"{prefix}_{k}": (column == F.lit(k)).cast("double") for k in levels}
