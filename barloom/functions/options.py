"""Option pricing as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 0.065
#: Fixed constants of the rational error-function approximation 7.1.26 of Abramowitz and Stegun.
A1, A2, A3, A4, A5, P = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911


def c(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = 1 / (1 + P * a)
    return F.signum(x) * (1 - t * (A1 + t * (A2 + t * (A3 + t * (A4 + t * A5)))) * F.exp(-a * a))


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def d1_d2(spot, strike, t, sigma, r=RATE, q=0.0) -> tuple[Column, Column]:
    spot, strike, t, sigma = map(c, (spot, strike, t, sigma))
    spread = sigma * F.sqrt(t)
    d1 = (F.ln(F.greatest(spot, F.lit(1e-12)) / F.greatest(strike, F.lit(1e-12))) + (r - q + 0.5 * sigma * sigma) * t) / spread
    return d1, d1 - spread


def floored(t, sigma) -> tuple[Column, Column]:
    return F.greatest(c(t), F.lit(1e-9)), F.greatest(c(sigma), F.lit(1e-9))


def price(spot, strike, t, sigma, call: Column, r: float = RATE, q: float = 0.0) -> Column:
    spot, strike, (t, sigma) = c(spot), c(strike), floored(t, sigma)
    d1, d2 = d1_d2(spot, strike, t, sigma, r, q)
    a, b = spot * F.exp(-q * t), strike * F.exp(-r * t)
    return F.when(call, a * norm_cdf(d1) - b * norm_cdf(d2)).otherwise(b * norm_cdf(-d2) - a * norm_cdf(-d1))


def greeks(spot, strike, t, sigma, call: Column, r: float = RATE, q: float = 0.0) -> dict[str, Column]:
    """delta, gamma, theta for a calendar day, vega for a vol point, rho for a percent."""
    spot, strike, (t, sigma) = c(spot), c(strike), floored(t, sigma)
    d1, d2 = d1_d2(spot, strike, t, sigma, r, q)
    b, a, pdf, root = F.exp(-r * t), F.exp(-q * t), norm_pdf(d1), F.sqrt(t)
    decay = -spot * a * pdf * sigma / (2 * root)
    return {
        "delta": F.when(call, a * norm_cdf(d1)).otherwise(a * norm_cdf(d1) - a),
        "gamma": a * pdf / (spot * sigma * root),
        "theta": F.when(call, decay - r * strike * b * norm_cdf(d2) + q * spot * a * norm_cdf(d1)).otherwise(decay + r * strike * b * norm_cdf(-d2) - q * spot * a * norm_cdf(-d1)) / 365,
        "vega": spot * a * pdf * root / 100,
        "rho": F.when(call, strike * t * b * norm_cdf(d2) / 100).otherwise(-strike * t * b * norm_cdf(-d2) / 100),
    }


def implied_vol(premium, spot, strike, t, call: Column, r: float = RATE, steps: int = 60) -> Column:
    """Bisection between 1e-4 and 5 over whole batches; NULL where the premium is not above the intrinsic value."""

    @F.pandas_udf("double")
    def solve(premium: pd.Series, spot: pd.Series, strike: pd.Series, t: pd.Series, call: pd.Series) -> pd.Series:
        p, s, k, t = (x.to_numpy(float) for x in (premium, spot, strike, t))
        up = call.to_numpy(bool)
        t = np.maximum(t, 1e-9)
        later = k * np.exp(-r * t)
        good = (p > np.maximum(np.where(up, s - later, later - s), 0) + 1e-10) & (t > 1e-9) & (p > 0) & (s > 0)
        lo, hi = np.full(len(p), 1e-4), np.full(len(p), 5.0)

        def cdf(x):
            a = np.abs(x) / math.sqrt(2)
            u = 1 / (1 + P * a)
            return 0.5 * (1 + np.sign(x) * (1 - u * (A1 + u * (A2 + u * (A3 + u * (A4 + u * A5)))) * np.exp(-a * a)))

        for _ in range(steps):
            mid = (lo + hi) / 2
            d1 = (np.log(np.maximum(s, 1e-12) / np.maximum(k, 1e-12)) + (r + 0.5 * mid * mid) * t) / (mid * np.sqrt(t))
            d2 = d1 - mid * np.sqrt(t)
            worth = np.where(up, s * cdf(d1) - later * cdf(d2), later * cdf(-d2) - s * cdf(-d1))
            hi, lo = np.where(worth > p, mid, hi), np.where(worth > p, lo, mid)
        return pd.Series(np.where(good, (lo + hi) / 2, np.nan)).astype(object).where(good, None).astype("Float64")

    return solve(*map(c, (premium, spot, strike, t)), call)


def sabr_vol(forward, strike, t, alpha, rho, nu, beta: float = 0.5) -> Column:
    """Lognormal volatility of the SABR model by Hagan's expansion; z / x(z) is 1 - rho z / 2 near 0."""
    f, k, t, alpha, rho, nu = map(c, (forward, strike, t, alpha, rho, nu))
    one = 1 - beta
    log = F.ln(f / k)
    mean = F.pow(f * k, F.lit(one / 2))
    z = nu / alpha * mean * log
    x = F.ln((F.sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho))
    ratio = F.when(F.abs(z) < 1e-6, 1 - rho * z / 2).otherwise(z / F.when(F.abs(z) < 1e-6, 1.0).otherwise(x))
    bottom = mean * (1 + one**2 / 24 * log * log + one**4 / 1920 * F.pow(log, 4))
    top = 1 + (one**2 / 24 * alpha * alpha / (mean * mean) + 0.25 * rho * beta * nu * alpha / mean + (2 - 3 * rho * rho) / 24 * nu * nu) * t
    return alpha / bottom * ratio * top
