"""Column builders over ordered series: rows of one symbol in date order. A missing value stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

YEAR = 252


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Series:
    """Windows of a keyed series."""

    def __init__(self, key: str | list[str] = "symbol", order: str | list[str] = "dt"):
        self.key, self.order = ([x] if isinstance(x, str) else x for x in (key, order))

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(self.w)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(x, n).over(self.w)

    def full(self, agg, x: Column | str, n: int) -> Column:
        """agg over the last n rows, NULL unless all of them have a value."""
        x = col(x)
        return F.when(F.count(x).over(self.last(n)) == n, agg(x).over(self.last(n)))

    def sma(self, x: Column | str, n: int) -> Column:
        return self.full(F.avg, x, n)

    def highest(self, x: Column | str, n: int) -> Column:
        return self.full(F.max, x, n)

    def lowest(self, x: Column | str, n: int) -> Column:
        return self.full(F.min, x, n)

    def stdev(self, x: Column | str, n: int) -> Column:
        return self.full(F.stddev_samp, x, n)

    def returns(self, x: Column | str) -> Column:
        return F.try_divide(col(x), self.lag(x)) - 1

    def log_returns(self, x: Column | str) -> Column:
        return F.ln(F.try_divide(col(x), self.lag(x)))

    def momentum(self, x: Column | str, n: int = 63) -> Column:
        return F.try_divide(col(x), self.lag(x, n)) - 1

    def drawdown(self, x: Column | str) -> Column:
        return F.try_divide(col(x), F.max(x).over(self.so_far)) - 1

    def bollinger(self, x: Column | str, n: int = 20, k: float = 2.0) -> dict[str, Column]:
        """Population deviation; %B is NULL where the band has no width."""
        middle, sd = self.sma(x, n), self.full(F.stddev_pop, x, n)
        upper, lower = middle + k * sd, middle - k * sd
        return {"middle": middle, "upper": upper, "lower": lower, "pct_b": F.try_divide(col(x) - lower, upper - lower)}

    def true_range(self) -> Column:
        """The first bar's is its own range, as greatest() skips NULL."""
        return self.range_from(self.lag("close"))

    @staticmethod
    def range_from(before: Column) -> Column:
        return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))

    def vwap(self) -> Column:
        typical = (F.col("high") + F.col("low") + F.col("close")) / 3
        return F.try_divide(F.sum(typical * F.col("volume")).over(self.so_far), F.sum("volume").over(self.so_far))

    def obv(self) -> Column:
        return F.sum(F.coalesce(F.signum(F.col("close") - self.lag("close")), F.lit(0.0)) * F.col("volume")).over(self.so_far)

    def stochastic_k(self, n: int = 14) -> Column:
        low, high = self.lowest("low", n), self.highest("high", n)
        return 100 * F.try_divide(F.col("close") - low, high - low)

    def williams_r(self, n: int = 14) -> Column:
        low, high = self.lowest("low", n), self.highest("high", n)
        return -100 * F.try_divide(high - F.col("close"), high - low)

    def cci(self, n: int = 20) -> Column:
        """Deviation of the typical price over 0.015 mean absolute deviations about the window's mean; call on a column typical."""
        mean = self.sma("typical", n)
        values = F.collect_list("typical").over(self.last(n))
        mad = F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / n
        return F.when(mean.isNotNull(), F.try_divide(F.col("typical") - mean, 0.015 * mad))

    def realized_vol(self, x: Column | str = "r", n: int = 21) -> Column:
        """Annualised deviation of a column of log returns."""
        return self.stdev(x, n) * YEAR**0.5

    def parkinson(self, n: int = 21) -> Column:
        squared = F.pow(F.ln(F.col("high") / F.col("low")), 2)
        return F.sqrt(self.full(F.avg, squared, n) / (4 * F.ln(F.lit(2.0))) * YEAR)

    def crossed(self, a: Column, b: Column, above: bool = True) -> Column:
        """True where a passes b between the last row and this one; NULL on either side is False."""
        now, before = (a > b, self.lag(a) <= self.lag(b)) if above else (a < b, self.lag(a) >= self.lag(b))
        return F.coalesce(now & before, F.lit(False))
