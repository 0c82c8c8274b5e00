"""Queries of rule specifications, simulated execution and the strategy language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import simulate as sim
from ..plans.rulespec import Operand, RuleSpec, compile_spec, resolve
from ..plans.script import flips, run_script
from ..sources.views import BARS, bars, table
from . import query, rounded, rounded_sql
from .indicators import LAG, MACD, RSI, W, ema_sql, full

SPEC = {
    "direction": "both",
    "long_entry": [{"left": {"indicator": "SMA", "period": 10}, "op": "cross_above", "right": {"indicator": "SMA", "period": 20}}, {"left": {"indicator": "WILLIAMS_R", "period": 14}, "op": ">", "value": -20, "join": "OR"}, {"left": {"indicator": "CLOSE"}, "op": ">", "right": {"indicator": "SMA", "period": 20}}],
    "long_exit": [{"left": {"indicator": "CLOSE"}, "op": "<", "right": {"indicator": "SMA", "period": 20}}],
    "short_entry": [{"left": {"indicator": "SMA", "period": 10}, "op": "cross_below", "right": {"indicator": "SMA", "period": 20}}],
    "short_exit": [{"left": {"indicator": "WILLIAMS_R", "period": 14}, "op": ">=", "value": -50}],
}
LW, HW = (f"CASE WHEN count({x}) OVER {W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) = 14 THEN {f}({x}) OVER {W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END" for f, x in (("min", "low"), ("max", "high")))
RULES = f"""{BARS}, xo AS (SELECT symbol, dt, open, high, low, close, row_number() OVER {W}) - 1 AS k, {full('avg', 'close', 10)} AS a, {full('avg', 'close', 20)} AS b, -100 * ({HW} - close) / nullif({HW} - {LW}, 0) AS wr FROM bars),
 xp AS (SELECT *, lag(a) OVER {W}) AS pa, lag(b) OVER {W}) AS pb FROM xo),
 sig AS (SELECT *, (coalesce(a > b AND pa <= pb, FALSE) OR coalesce(wr > -20, FALSE)) AND coalesce(close > b, FALSE) AS long_entry, coalesce(close < b, FALSE) AS long_exit, coalesce(a < b AND pa >= pb, FALSE) AS short_entry, coalesce(wr >= -50, FALSE) AS short_exit FROM xp)"""
SIDES = "long_entry, long_exit, short_entry, short_exit"


def compiled(spark, sf_dir: str) -> DataFrame:
    return compile_spec(bars(spark, sf_dir), RuleSpec.of(SPEC))


@query("compile_spec", f"WITH {RULES}\nSELECT symbol, dt, {SIDES} FROM sig")
def compile_rules(spark, sf_dir: str) -> DataFrame:
    return compiled(spark, sf_dir).select("symbol", "dt", *SIDES.split(", "))


@query("combine", f"WITH {RULES}\nSELECT symbol, CAST(count(CASE WHEN long_entry THEN 1 END) AS BIGINT) AS entries, CAST(count(CASE WHEN coalesce(a > b AND pa <= pb, FALSE) OR (coalesce(wr > -20, FALSE) AND coalesce(close > b, FALSE)) THEN 1 END) AS BIGINT) AS if_and_came_first FROM sig GROUP BY symbol")
def combine(spark, sf_dir: str) -> DataFrame:
    """Conditions are joined from left to right: another number than if AND came first."""
    from ..plans.rulespec import evaluated

    spec = RuleSpec.of(SPEC)
    rows = resolve(bars(spark, sf_dir), spec.operands)
    c = {f"c{i}": evaluated(x) for i, x in enumerate(spec.long_entry)}
    rows = rows.withColumns(c)
    return rows.groupBy("symbol").agg(F.count_if((F.col("c0") | F.col("c1")) & F.col("c2")).alias("entries"), F.count_if(F.col("c0") | F.col("c1") & F.col("c2")).alias("if_and_came_first"))


@query("eval_condition", f"WITH {RULES}\nSELECT symbol, dt, coalesce(a > b AND pa <= pb, FALSE) AS above, coalesce(a < b AND pa >= pb, FALSE) AS below FROM sig")
def eval_condition(spark, sf_dir: str) -> DataFrame:
    from ..plans.rulespec import Condition, evaluated

    cross = {op: Condition.of({"left": {"indicator": "SMA", "period": 10}, "op": op, "right": {"indicator": "SMA", "period": 20}}) for op in ("cross_above", "cross_below")}
    rows = resolve(bars(spark, sf_dir), [Operand("SMA", 10), Operand("SMA", 20)])
    return rows.select("symbol", "dt", evaluated(cross["cross_above"]).alias("above"), evaluated(cross["cross_below"]).alias("below"))


@query("resolve_operands", rounded_sql(f"WITH {RULES}, v AS (SELECT symbol, dt, sum((high + low + close) / 3 * volume) OVER {W} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER {W} ROWS UNBOUNDED PRECEDING) AS vwap FROM bars)\nSELECT symbol, dt, a AS sma, wr, open, vwap FROM sig JOIN v USING (symbol, dt)", "sma", "wr", "open", "vwap"))
def resolve_operands(spark, sf_dir: str) -> DataFrame:
    ops = [Operand("SMA", 10), Operand("WILLIAMS_R", 14), Operand("OPEN"), Operand("VWAP")]
    return rounded(resolve(bars(spark, sf_dir), ops).select("symbol", "dt", *(F.col(o.column).alias(n) for o, n in zip(ops, ("sma", "wr", "open", "vwap"), strict=True))))


RUN = sim.Execution(stop=("percent", 3.0), target=("percent", 5.0), trailing=True, cooldown=2)
C = RUN.cost
WAYS = {"gap_s": "dir * (open - stop) <= 0", "gap_t": "dir * (open - tp) >= 0", "hit_s": "dir * (CASE WHEN dir > 0 THEN low ELSE high END - stop) <= 0", "hit_t": "dir * (CASE WHEN dir > 0 THEN high ELSE low END - tp) >= 0"}
SIM = f"""{RULES}, sx AS (SELECT symbol, dt, k, open, high, low, close, lag(long_entry) OVER {W}) AS le, lag(short_entry) OVER {W}) AS se, lag(long_exit) OVER {W}) AS lx, lag(short_exit) OVER {W}) AS xx, max(k) OVER (PARTITION BY symbol) AS last FROM sig),
 st AS (SELECT symbol, k, 0 AS dir, CAST(0 AS DOUBLE) AS entry, k AS entry_k, CAST(0 AS DOUBLE) AS stop, CAST(0 AS DOUBLE) AS tp, CAST(0 AS DOUBLE) AS ext, CAST(0 AS DOUBLE) AS mark, CAST(-1000000 AS BIGINT) AS rested, 0 AS pos, CAST(0 AS DOUBLE) AS ret, CAST(NULL AS DOUBLE) AS xprice, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS xentry, CAST(NULL AS BIGINT) AS xk FROM sx WHERE k = 0
  UNION ALL
  SELECT symbol, k, CASE WHEN out IS NULL OR reason = 'end-of-data' THEN dir ELSE 0 END, entry, entry_k, stop, tp, ext, close, CASE WHEN out IS NOT NULL THEN k ELSE rested END, dir, CASE WHEN dir = 0 THEN 0 ELSE CASE WHEN fresh THEN -{C} ELSE 0 END + dir * (CASE WHEN reason IS NULL OR reason = 'end-of-data' THEN close ELSE out END / mark - 1) - CASE WHEN reason IS NULL OR reason = 'end-of-data' THEN 0 ELSE {C} END END, out, reason, CASE WHEN reason IS NOT NULL THEN entry END, CASE WHEN reason IS NOT NULL THEN entry_k END
  FROM (SELECT *, CASE WHEN reason = 'signal' OR {WAYS['gap_s']} OR {WAYS['gap_t']} THEN open WHEN reason = 'stop' THEN stop WHEN reason = 'target' THEN tp WHEN reason = 'end-of-data' THEN close END AS out0, CASE WHEN reason IS NULL THEN NULL WHEN reason = 'end-of-data' THEN close WHEN reason = 'signal' THEN open WHEN reason = 'stop' THEN CASE WHEN {WAYS['gap_s']} THEN open ELSE stop END ELSE CASE WHEN {WAYS['gap_t']} THEN open ELSE tp END END AS out
   FROM (SELECT *, CASE WHEN dir = 0 THEN NULL WHEN NOT fresh AND ((dir > 0 AND lx) OR (dir < 0 AND xx)) THEN 'signal' WHEN {WAYS['gap_s']} THEN 'stop' WHEN {WAYS['gap_t']} THEN 'target' WHEN {WAYS['hit_s']} THEN 'stop' WHEN {WAYS['hit_t']} THEN 'target' WHEN k = last THEN 'end-of-data' END AS reason
    FROM (SELECT * REPLACE (CASE WHEN dir > 0 THEN greatest(stop, ext - entry * 0.03) WHEN dir < 0 THEN least(stop, ext + entry * 0.03) ELSE stop END AS stop)
     FROM (SELECT * REPLACE (CASE WHEN dir > 0 THEN greatest(ext, high) WHEN dir < 0 THEN least(ext, low) ELSE ext END AS ext)
      FROM (SELECT * REPLACE (CASE WHEN fresh THEN open ELSE entry END AS entry, CASE WHEN fresh THEN k ELSE entry_k END AS entry_k, CASE WHEN fresh THEN open - dir * open * 0.03 ELSE stop END AS stop, CASE WHEN fresh THEN open + dir * open * 0.05 ELSE tp END AS tp, CASE WHEN fresh THEN open ELSE ext END AS ext, CASE WHEN fresh THEN open ELSE mark END AS mark)
       FROM (SELECT sx.symbol, sx.k, sx.open, sx.high, sx.low, sx.close, sx.lx, sx.xx, sx.last, st.entry, st.entry_k, st.stop, st.tp, st.ext, st.mark, st.rested, st.dir = 0 AND sx.k - st.rested > 2 AND (sx.le OR sx.se) AS fresh,
          CASE WHEN st.dir <> 0 THEN st.dir WHEN sx.k - st.rested > 2 AND sx.le THEN 1 WHEN sx.k - st.rested > 2 AND sx.se THEN -1 ELSE 0 END AS dir
        FROM st JOIN sx ON sx.symbol = st.symbol AND sx.k = st.k + 1) e) f) g) h) i) j)"""


def run(spark, sf_dir: str) -> DataFrame:
    return sim.simulate(compiled(spark, sf_dir), RUN)


@query("simulate", rounded_sql(f"WITH RECURSIVE {SIM}\nSELECT st.symbol, sx.dt, CAST(pos AS DOUBLE) AS pos, ret FROM st JOIN sx ON sx.symbol = st.symbol AND sx.k = st.k", "ret"))
def simulate(spark, sf_dir: str) -> DataFrame:
    return rounded(run(spark, sf_dir).select("symbol", "dt", "pos", "ret"))


TRADED = f"{SIM}, tr AS (SELECT st.symbol, sx.dt AS exit_dt, xk AS entry_k, xentry AS entry_price, xprice AS exit_price, CAST(pos AS BIGINT) AS direction, reason AS exit_reason, pos * (xprice / xentry - 1) - {2 * C} AS return_pct, st.k - xk AS bars_held FROM st JOIN sx ON sx.symbol = st.symbol AND sx.k = st.k WHERE reason IS NOT NULL)"


@query("simulate_trades", rounded_sql(f"WITH RECURSIVE {TRADED}\nSELECT * FROM tr", "entry_price", "exit_price", "return_pct"))
def simulate_trades(spark, sf_dir: str) -> DataFrame:
    return rounded(run(spark, sf_dir).where("exit_reason IS NOT NULL").select("symbol", F.col("dt").alias("exit_dt"), "entry_k", "entry_price", "exit_price", "direction", "exit_reason", "return_pct", "bars_held"))


@query("exit_breakdown", f"WITH RECURSIVE {TRADED}\nSELECT symbol, exit_reason AS reason, CAST(count(*) AS BIGINT) AS n, round(avg(return_pct), 6) + 0.0 AS mean_return FROM tr GROUP BY 1, 2")
def exit_breakdown(spark, sf_dir: str) -> DataFrame:
    """Trades by what closed them."""
    return rounded(run(spark, sf_dir).where("exit_reason IS NOT NULL").groupBy("symbol", F.col("exit_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.avg("return_pct").alias("mean_return")))


@query("simulate_levels", rounded_sql(f"WITH {BARS}\nSELECT symbol, dt, close - CASE WHEN close > open THEN 1 ELSE -1 END * close * 0.03 AS stop, close + CASE WHEN close > open THEN 1 ELSE -1 END * 12 * 0.5 AS target FROM bars", "stop", "target"))
def simulate_levels(spark, sf_dir: str) -> DataFrame:
    stop, target = sim.levels(F.col("close"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1), sim.Execution(stop=("percent", 3.0), target=("pips", 12.0), pip=0.5), F.lit(None))
    return rounded(bars(spark, sf_dir).select("symbol", "dt", stop.alias("stop"), target.alias("target")))


PREV = f"{BARS}, q AS (SELECT *, {LAG} AS pc, CASE WHEN dayofmonth(dt) % 2 = 0 THEN 1 ELSE -1 END AS dir FROM bars), q1 AS (SELECT *, pc - dir * pc * 0.01 AS stop, pc + dir * pc * 0.02 AS tp FROM q WHERE pc IS NOT NULL), q2 AS (SELECT *, CASE WHEN {WAYS['gap_s']} THEN 'stop' WHEN {WAYS['gap_t']} THEN 'target' WHEN {WAYS['hit_s']} THEN 'stop' WHEN {WAYS['hit_t']} THEN 'target' END AS reason FROM q1)"


@query("intrabar_exit", rounded_sql(f"WITH {PREV}\nSELECT symbol, dt, reason, CASE WHEN reason = 'stop' THEN CASE WHEN {WAYS['gap_s']} THEN open ELSE stop END WHEN reason = 'target' THEN CASE WHEN {WAYS['gap_t']} THEN open ELSE tp END END AS price FROM q2", "price"))
def intrabar_exit(spark, sf_dir: str) -> DataFrame:
    from ..functions.series import Series

    way = F.when(F.dayofmonth("dt") % 2 == 0, 1).otherwise(-1)
    rows = bars(spark, sf_dir).withColumn("pc", Series().lag("close")).where("pc IS NOT NULL").withColumn("way", way)
    at = sim.intrabar_exit(F.col("way"), F.col("pc") - F.col("way") * F.col("pc") * 0.01, F.col("pc") + F.col("way") * F.col("pc") * 0.02)
    return rounded(rows.select("symbol", "dt", at["reason"].alias("reason"), at["price"].alias("price")))


@query("session_mask", "SELECT event_id, hour(ts) * 60 + minute(ts) BETWEEN 555 AND 930 AS day, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) <= 90 AS night FROM events")
def session_mask(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sim.in_session(F.col("ts"), "09:15", "15:30").alias("day"), sim.in_session(F.col("ts"), "22:00", "01:30").alias("night"))


SCRIPT = """
fast = ema(close, 12)
slow = sma(close, 30)
width = (bb_upper() - bb_lower()) / slow
plot(width, title="width")
long_when(cross_above(fast, slow))
short_when(cross_below(fast, slow) and width > 0.01)
exit_when(rsi(close, 14) > 80)
exit_when(highest(high, 5) == lowest(low, 5) and not volume % 7 < 3)
"""
MIDDLE, DEV = full("avg", "close", 20), full("stddev_pop", "close", 20)
SCRIPTED = f"""{RSI}, se AS (SELECT n.symbol, n.dt, n.k, {ema_sql('close', 2 / 13, 12, 'n', 'fast', 12)}, {full('avg', 'close', 30)} AS slow, 4 * {DEV} AS bw, {full('max', 'high', 5)} AS h5, {full('min', 'low', 5)} AS l5, volume FROM n),
 sl AS (SELECT se.*, bw / slow AS width, lag(fast) OVER {W}) AS pf, lag(slow) OVER {W}) AS ps, rsi_14 FROM se JOIN (SELECT symbol, dt, rsi_14 FROM rsi) r USING (symbol, dt)),
 sm AS (SELECT *, CASE WHEN coalesce(rsi_14 > 80, FALSE) OR coalesce(h5 = l5 AND NOT volume - 7 * floor(volume / 7) < 3, FALSE) THEN 0.0 WHEN coalesce(fast < slow AND pf >= ps AND width > 0.01, FALSE) THEN -1.0 WHEN coalesce(fast > slow AND pf <= ps, FALSE) THEN 1.0 END AS mark FROM sl),
 sc AS (SELECT symbol, dt, width, CAST(coalesce(last_value(mark IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS signal FROM sm)"""


@query("run_script", rounded_sql(f"WITH {SCRIPTED}\nSELECT symbol, dt, width, signal FROM sc", "width"))
def scripted(spark, sf_dir: str) -> DataFrame:
    return rounded(run_script(SCRIPT, bars(spark, sf_dir)).select("symbol", "dt", "width", "signal"))


@query("script_flips", f"WITH {SCRIPTED}, fl AS (SELECT symbol, dt, signal, coalesce(lag(signal) OVER {W}), 0) AS before FROM sc)\nSELECT symbol, dt, signal FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM fl WHERE signal <> before) t WHERE rn <= 120")
def script_flips(spark, sf_dir: str) -> DataFrame:
    return flips(run_script(SCRIPT, bars(spark, sf_dir))).select("symbol", "dt", "signal")


SERIES = """
m = momentum(close, 21)
c = change(close, 3)
d = abs(shift(close, 1) - close) ** 0.5
s = stdev(close, 10)
plot(m, title="m")
plot(c, title="c")
plot(d, title="d")
plot(s, title="s")
plot(-close % 7, title="r")
"""


@query("script_series", rounded_sql(f"WITH {BARS}\nSELECT symbol, dt, close / lag(close, 21) OVER {W}) - 1 AS m, close / lag(close, 3) OVER {W}) - 1 AS c, sqrt(abs({LAG} - close)) AS d, {full('stddev_samp', 'close', 10)} AS s, -close - 7 * floor(-close / 7) AS r FROM bars", "m", "c", "d", "s", "r"))
def script_series(spark, sf_dir: str) -> DataFrame:
    return rounded(run_script(SERIES, bars(spark, sf_dir)).select("symbol", "dt", *"mcdsr"))


#: Chart indicators: default period, 0 for none.
CHARTS = {"SMA": 20, "EMA": 20, "VWAP": 0, "BB": 20, "RSI": 14, "MACD": 0, "ATR": 14, "ADX": 14, "STOCH": 14, "CCI": 20, "WILLR": 14, "OBV": 0}
PARTS = {"BB": ("BB_UPPER", "BB_MIDDLE", "BB_LOWER"), "MACD": ("MACD", "MACD_SIGNAL"), "STOCH": ("STOCH_K", "STOCH_D"), "WILLR": ("WILLIAMS_R",)}


def parse_specs(specs: str) -> list[tuple[str, int]]:
    """kind and period of 'sma:20,rsi:14,macd'; unknown kinds are passed over."""
    found = []
    for kind, _, n in (x.strip().partition(":") for x in specs.split(",")):
        kind = kind.strip().upper()
        if kind in CHARTS:
            found.append((kind, int(n) if CHARTS[kind] and n.strip().isdigit() else CHARTS[kind]))
    return found


def indicator_lines(rows: DataFrame, specs: str) -> DataFrame:
    """symbol, dt, line, value: the points of all lines of the indicators asked for, without those that are no number."""
    ops = [Operand(part, n) for kind, n in parse_specs(specs) for part in PARTS.get(kind, (kind,))]
    wide = resolve(rows, ops)
    lines = F.explode(F.array(*(F.struct(F.lit(o.column[2:]).alias("line"), F.col(o.column).alias("value")) for o in ops)))
    points = wide.select("symbol", "dt", lines.alias("p")).select("symbol", "dt", "p.*")
    return points.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


LINES = {"sma_20": full("avg", "close", 20), "bb_upper_20": f"{MIDDLE} + 2 * {DEV}", "bb_middle_20": MIDDLE, "bb_lower_20": f"{MIDDLE} - 2 * {DEV}"}


@query("compute_indicator", rounded_sql(f"WITH {BARS}, p AS ({' UNION ALL '.join(f'''SELECT symbol, dt, '{n}' AS line, {x} AS value FROM bars''' for n, x in LINES.items())})\nSELECT symbol, dt, line, value FROM p WHERE value IS NOT NULL", "value"))
def compute_indicator(spark, sf_dir: str) -> DataFrame:
    return rounded(indicator_lines(bars(spark, sf_dir), "sma:20,nothing:3,bb"))


@query("indicator_points", rounded_sql(f"WITH {MACD}\nSELECT symbol, dt, macd_26 AS value FROM macd WHERE macd_26 IS NOT NULL", "value"))
def indicator_points(spark, sf_dir: str) -> DataFrame:
    """A line without its warm-up."""
    return rounded(indicator_lines(bars(spark, sf_dir), "macd").where("line = 'macd_0'").drop("line"))


@query("clean_numbers", rounded_sql("WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE value END AS v FROM events)\nSELECT event_id, v FROM e", "v"))
def clean_numbers(spark, sf_dir: str) -> DataFrame:
    """What is no number becomes NULL."""
    v = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return rounded(rows.withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v"))))


@query("normalize_ohlc", f"WITH {BARS}\nSELECT symbol, dt, open, close FROM bars")
def normalize_ohlc(spark, sf_dir: str) -> DataFrame:
    """Columns by their lower-case names."""
    upper = bars(spark, sf_dir).withColumnsRenamed({"open": "Open", "close": "CLOSE"})
    return upper.toDF(*map(str.lower, upper.columns)).select("symbol", "dt", "open", "close")
