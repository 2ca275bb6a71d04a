"""Financial operators on prices. The trailing window of a row includes its left edge and of its own instant the rows up to it; see aggregates for slices of hot timelines.

Where a quotient has no divisor the result is null: Spark's ANSI arithmetic would stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.durations import hours
from chronoweave.model import by_time
from chronoweave.operators.aggregates import KEY, sliced, trailing
from chronoweave.shipping import ship

KEYS = ("timeline_id", "ts_ns", "seq")


def named(kind: str) -> Column:
    return F.lit(kind).alias("metric")


def twap(prices: DataFrame, window_ns: int, slice_ns: int | None = None) -> DataFrame:
    """Time-weighted average price by trapezoids; rows with one price in the window have none, and a window of no length takes the last price."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(KEY)
        frame = trailing(window_ns, *keys)
        dt = F.coalesce(F.col("ts_ns") - F.lag("ts_ns").over(order), F.lit(0))
        area = F.coalesce((F.col("value") + F.lag("value").over(order)) / 2 * dt, F.lit(0.0))
        steps = rows.withColumns({"_a": area, "_dt": dt})
        sums = steps.withColumns({"_n": F.count("*").over(frame), "_sa": F.sum("_a").over(frame) - F.first("_a").over(frame), "_st": F.sum("_dt").over(frame) - F.first("_dt").over(frame)})
        return sums.where("_n > 1").withColumn("twap", F.when(F.col("_st") == 0, F.col("value")).otherwise(F.try_divide("_sa", "_st")))

    return sliced(prices, window_ns, slice_ns, compute).select(*KEYS, named("TWAP"), F.col("twap").alias("value"))


def vwap(prices: DataFrame, window_ns: int, slice_ns: int | None = None) -> DataFrame:
    """Volume-weighted average price over rows with volume; the plain average if there is none."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        frame = trailing(window_ns, *keys)
        sold = F.col("volume") > 0
        paid = F.sum(F.when(sold, F.col("value") * F.col("volume"))).over(frame)
        return rows.withColumn("vwap", F.coalesce(F.try_divide(paid, F.sum(F.when(sold, F.col("volume"))).over(frame)), F.avg("value").over(frame)))

    return sliced(prices, window_ns, slice_ns, compute).select(*KEYS, named("VWAP"), F.col("vwap").alias("value"))


def bollinger(prices: DataFrame, window_ns: int, k: float = 2.0, slice_ns: int | None = None) -> DataFrame:
    """Three rows for each price: the average and it plus or minus k population deviations."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        frame = trailing(window_ns, *keys)
        return rows.withColumns({"middle": F.avg("value").over(frame), "stddev": F.stddev_pop("value").over(frame)})

    bands = sliced(prices, window_ns, slice_ns, compute).withColumns({"upper": F.col("middle") + k * F.col("stddev"), "lower": F.col("middle") - k * F.col("stddev")})
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(f"BollingerBands_{n}").alias("metric"), F.col(n.lower()).alias("value")) for i, n in enumerate(("Upper", "Middle", "Lower"))]))
    return bands.select(*KEYS, rows.alias("r"), "middle", "lower", "stddev").select(*KEYS, "r.metric", "r.value", "middle", "lower", "stddev", "r.band")


def gains(prices: DataFrame, order: Window) -> DataFrame:
    d = F.col("value") - F.lag("value").over(order)
    return prices.withColumn("_d", d).withColumns({"_up": F.when(F.col("_d") > 0, F.col("_d")), "_down": F.when(F.col("_d") < 0, -F.col("_d"))})


def strength(frame: Window) -> Column:
    return F.lit(100.0) - 100.0 / (1.0 + F.avg("_up").over(frame) / F.avg("_down").over(frame))


def rsi(prices: DataFrame, window_ns: int) -> DataFrame:
    """Relative strength as the reference semantics have it: all changes from the start of the timeline, while its second row is within the window."""
    order = by_time()
    second = F.nth_value("ts_ns", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    frame = order.rowsBetween(Window.unboundedPreceding, 0)
    out = gains(prices, order).withColumns({"_second": second, "_n": F.row_number().over(order), "rsi": strength(frame)})
    return out.where((F.col("_n") > 1) & (F.col("_second") > F.col("ts_ns") - window_ns) & F.col("rsi").isNotNull()).select(*KEYS, named("RSI"), F.col("rsi").alias("value"))


def rsi_windowed(prices: DataFrame, window_ns: int, slice_ns: int | None = None) -> DataFrame:
    """Relative strength over the changes within the trailing window."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return rows.withColumn("rsi", strength(trailing(window_ns, *keys)))

    out = sliced(gains(prices, by_time()), window_ns, slice_ns, compute)
    return out.where("rsi is not null").select(*KEYS, named("RSIWindowed"), F.col("rsi").alias("value"))


def alpha(period_ns: int) -> float:
    """The smoothing factor of a period in hours. It isn't limited: periods under an hour give more than one."""
    return 2.0 / (hours(period_ns) + 1.0)


def ema(prices: DataFrame, period_ns: int) -> DataFrame:
    """Exponential moving average from the first value on. A null value counts as 0, as in all recursions here."""
    return _recursive(prices, {"value": alpha(period_ns)}).select(*KEYS, named("EMA"), "value")


def macd(prices: DataFrame, fast_ns: int, slow_ns: int, signal_ns: int) -> DataFrame:
    """MACD line, its signal and the histogram, a row for each price."""
    out = _recursive(prices, {"fast": alpha(fast_ns), "slow": alpha(slow_ns), "signal": alpha(signal_ns)})
    return out.select(*KEYS, named("MACD_Line"), F.col("line").alias("value"), "signal", (F.col("line") - F.col("signal")).alias("histogram"), "fast", "slow")


def _recursive(prices: DataFrame, alphas: dict[str, float]) -> DataFrame:
    """First-order recursions in time order.

    The recursion is x_i = a v_i + (1 - a) x_{i-1}; with a over one its powers grow and alternate, so it has no stable
    closed form over windows, and this is the one operator of prices that runs in Python. Rows stream in order, an
    Arrow batch at a time, with one state for the current timeline: memory doesn't grow with a timeline.
    """
    import pyarrow as pa

    both = "signal" in alphas
    names = ["fast", "slow", "line", "signal"] if both else ["value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for b in batches:
            out: dict[str, list] = {n: [] for n in names}
            for tid, v in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                v = 0.0 if v is None else v
                fresh = tid != now
                now = tid
                if both:
                    for n in ("fast", "slow"):
                        state[n] = v if fresh else alphas[n] * v + (1 - alphas[n]) * state[n]
                    line = state["fast"] - state["slow"]
                    state["signal"] = line if fresh else alphas["signal"] * line + (1 - alphas["signal"]) * state["signal"]
                    for n, x in (("fast", state["fast"]), ("slow", state["slow"]), ("line", line), ("signal", state["signal"])):
                        out[n].append(x)
                else:
                    state["value"] = v if fresh else alphas["value"] * v + (1 - alphas["value"]) * state["value"]
                    out["value"].append(state["value"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(out[n], pa.float64()) for n in names]], names=["timeline_id", "ts_ns", "seq", *names])

    ship(prices.sparkSession)
    rows = prices.select(F.col("timeline_id"), F.col("ts_ns").cast("long"), F.col("seq").cast("long"), F.col("value").cast("double"))
    kind = rows.schema["timeline_id"].dataType.simpleString()
    return rows.repartition("timeline_id").sortWithinPartitions("timeline_id", "ts_ns", "seq").mapInArrow(run, f"timeline_id {kind}, ts_ns long, seq long, " + ", ".join(f"{n} double" for n in names))


def value_at_risk(returns: DataFrame, window_ns: int, confidence: float = 95.0, slice_ns: int | None = None) -> DataFrame:
    """Historical value at risk over windows of more than ten returns."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return rows.withColumn("_vs", F.sort_array(F.collect_list("value").over(trailing(window_ns, *keys))))

    n = F.size("_vs")
    at = F.least(((F.lit(1.0) - F.lit(float(confidence)) / 100) * n).cast("int"), n - 1)
    out = sliced(returns, window_ns, slice_ns, compute).where(n > 10)
    return out.select(*KEYS, named("VaR"), (-F.get("_vs", at)).alias("value"), F.lit(float(confidence)).alias("confidence"))


def drawdown(prices: DataFrame) -> DataFrame:
    """Percent below the highest price so far."""
    peak = F.max("value").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    out = prices.withColumn("peak", peak)
    return out.select(*KEYS, named("Drawdown"), F.try_divide(F.col("value") - F.col("peak"), F.col("peak")).alias("_r"), "peak", F.col("value").alias("current"), (F.col("value") - F.col("peak")).alias("absolute")).select(*KEYS, "metric", (F.col("_r") * 100).alias("value"), "peak", "current", "absolute")


def sharpe(returns: DataFrame, window_ns: int, risk_free: float = 0.02, slice_ns: int | None = None) -> DataFrame:
    """(average - risk-free rate) / population deviation, where there is a deviation."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        frame = trailing(window_ns, *keys)
        return rows.withColumns({"avg_return": F.avg("value").over(frame), "stddev": F.stddev_pop("value").over(frame)})

    out = sliced(returns, window_ns, slice_ns, compute).where("stddev > 0")
    return out.select(*KEYS, named("SharpeRatio"), ((F.col("avg_return") - risk_free) / F.col("stddev")).alias("value"), "avg_return", "stddev", F.lit(risk_free).alias("risk_free"))


def transaction_velocity(prices: DataFrame, window_ns: int, slice_ns: int | None = None) -> DataFrame:
    """Transactions an hour over the trailing window, with their count, total and average."""

    def compute(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        frame = trailing(window_ns, *keys)
        return rows.withColumns({"count": F.count("*").over(frame), "total": F.sum("value").over(frame)})

    out = sliced(prices, window_ns, slice_ns, compute)
    return out.select(*KEYS, named("TransactionVelocity"), (F.col("count") / hours(window_ns)).alias("value"), "count", "total", (F.col("total") / F.col("count")).alias("average"))


def position_exposure(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Position times the latest price at or before it, or else the first price: an as-of join as a union and one window, without a join."""
    own = positions.select(*KEYS, F.lit(1).alias("_side"), F.col("value").alias("position"), F.lit(None).cast("double").alias("px"))
    quotes = prices.select(*KEYS, F.lit(0).alias("_side"), F.lit(None).cast("double").alias("position"), F.col("value").alias("px"))
    order = Window.partitionBy("timeline_id").orderBy("ts_ns", "_side", "seq")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    latest = F.last("px", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("px", ignorenulls=True).over(every)
    out = own.unionByName(quotes).withColumn("price", F.coalesce(latest, first)).where("_side = 1 and price is not null")
    return out.select(*KEYS, named("PositionExposure"), (F.col("position") * F.col("price")).alias("value"), "position", "price")
