"""Rule grammars of screener and alerts: text to a comparison, never to SQL text."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("price", "ret_1d", "ret_1w", "ret_1mo", "ret_3mo", "rsi", "vol_ann", "from_high", "vol_surge", "above_sma50", "above_sma200")
COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq}
_RULE = re.compile(r"\s*(?P<metric>[a-z_][a-z_0-9]*)\s*(?:(?P<op><=|>=|==|=|<|>)\s*(?P<value>-?\d+(?:\.\d*)?|-?\.\d+))?\s*")
_ALERT = re.compile(r"\s*(?P<symbol>[A-Z0-9^.&=-]+)\s+(?:(?P<metric>rsi|vol_surge)\s*)?(?P<op><=|>=|==|=|<|>)\s*(?P<value>-?\d+(?:\.\d*)?)\s*", re.IGNORECASE)


@dataclass(frozen=True)
class Rule:
    """metric op value. A bare metric stands for above one half."""

    metric: str
    op: str
    value: float
    symbol: str | None = None

    def column(self) -> Column:
        return COMPARE[self.op](F.col(self.metric), F.lit(self.value))


def parse_rule(text: str, metrics: tuple[str, ...] = METRICS) -> Rule:
    m = _RULE.fullmatch(text.lower())
    if not m:
        raise ValueError(f"not a rule: {text!r}; write metric op number, like rsi<30")
    if m["metric"] not in metrics:
        raise ValueError(f"no metric {m['metric']!r}; there are {', '.join(metrics)}")
    if m["op"] is None:
        return Rule(m["metric"], ">", 0.5)
    return Rule(m["metric"], "==" if m["op"] == "=" else m["op"], float(m["value"]))


def parse_alert(text: str) -> Rule:
    """SYMBOL [rsi|vol_surge] op number; without a metric the price."""
    m = _ALERT.fullmatch(text)
    if not m:
        raise ValueError(f"not an alert: {text!r}; write SYMBOL [rsi|vol_surge] op number")
    return Rule((m["metric"] or "price").lower(), "==" if m["op"] == "=" else m["op"], float(m["value"]), m["symbol"].upper())
