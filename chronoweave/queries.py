"""The query catalogue: one query per operator over the sample tables, with the same in SQL for DuckDB.

Timelines are users of `events` (value: the event's type, price: its value, volume: props.k), customers of `orders` or
parts of `lineitem`. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import json_events
from chronoweave.model import DAY, HOUR, ns
from chronoweave.operators import aggregates, badges, finance, fraud, intervals, reduce, states, windows
from chronoweave.plans.hcl import parse_query
from chronoweave.plans.planner import process
from chronoweave.plans.spec import query_from_json

Query = Callable[[SparkSession, str], DataFrame]

#: Day one of the sample events, and the end of their thirty days.
T0 = 1_704_067_200 * 10**9
T1 = T0 + 30 * DAY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").cast("string").alias("timeline_id"), ns("ts").alias("ts_ns"), F.col("event_id").alias("seq"), "event_type", F.col("value").alias("price"), k.alias("volume"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select("timeline_id", "ts_ns", "seq", F.lit("event").alias("type"), F.col("event_type").alias("value"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select("timeline_id", "ts_ns", "seq", F.col("price").alias("value"), "volume", F.lit("").alias("symbol"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day for fifty groups of customers: many are of the same instant."""
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).cast("string").alias("timeline_id"), ns("o_orderdate").alias("ts_ns"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 7).cast("double").alias("volume"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the JSON that an ingesting client would send."""
    r = raw_events(spark, sf_dir)
    stamp = F.date_format(F.timestamp_micros(F.expr("ts_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(F.col("event_type").alias("eventType"), stamp.alias("timestamp"), F.col("event_type").alias("value"), F.col("price"), F.col("volume"), F.col("timeline_id").alias("user_id")))
    return r.select("timeline_id", body.alias("json"), "seq")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_events.Classifier().classify(json_rows(spark, sf_dir), T0)


#: Doubles are cut to a grid whose steps lie beside the halves, where exact results often are and rounding would hang on the last bit.
BESIDE_HALF = 0.4877


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    scale = float(10**places)
    return df.select(*[(F.floor(F.col(c) * scale + BESIDE_HALF) / scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def steady(sql: str) -> str:
    """SQL with round(x, n) cut to the same grid."""
    while (at := sql.find("round(")) >= 0:
        depth, end, comma = 1, at + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if depth == 1 and sql[end] == "," else comma
            end += 1
        scale = f"1e{int(sql[comma + 1 : end - 1])}"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {scale} + {BESIDE_HALF}) / {scale}){sql[end:]}"
    return sql


def within(spark: SparkSession, sf_dir: str, value: str, window: int = 12 * HOUR) -> DataFrame:
    return states.has_existed_within(events(spark, sf_dir), value, window)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("timeline_id").distinct()


# --- SQL building blocks

E = """e AS (SELECT user_id::VARCHAR AS timeline_id, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, event_type AS value, value AS price, json_extract(props, '$.k')::DOUBLE AS volume FROM events)"""
USERS = "u AS (SELECT DISTINCT timeline_id FROM e)"
PER = "PARTITION BY timeline_id"
ORDER = f"{PER} ORDER BY ts_ns, seq"


def islands_sql(source: str, name: str) -> str:
    """CTEs that merge the intervals (timeline_id, s, t) of source into name."""
    return f"""{name}_n AS (SELECT *, CASE WHEN s <= max(t) OVER ({PER} ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {source}),
{name}_g AS (SELECT *, sum(n) OVER ({PER} ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM {name}_n),
{name} AS (SELECT timeline_id, min(s) AS s, max(t) AS t FROM {name}_g GROUP BY timeline_id, g)"""


def within_sql(value: str, name: str, window: int = 12 * HOUR) -> str:
    return f"{name}_w AS (SELECT timeline_id, ts_ns AS s, ts_ns + {window} AS t FROM e WHERE value = '{value}'), " + islands_sql(f"{name}_w", name)


CLICK_VIEW = f"{E}, {within_sql('click', 'a')}, {within_sql('view', 'b')}"
BOTH = f"{CLICK_VIEW}, p AS (SELECT a.timeline_id, greatest(a.s, b.s) AS s, least(a.t, b.t) AS t FROM a JOIN b USING (timeline_id) WHERE greatest(a.s, b.s) < least(a.t, b.t)), {islands_sql('p', 'm')}"
EITHER = f"{CLICK_VIEW}, p AS (SELECT * FROM a UNION ALL SELECT * FROM b), {islands_sql('p', 'm')}"
STATE = f"""{E}, c AS (SELECT *, lag(value) OVER ({ORDER}) AS before, max(ts_ns) OVER ({PER}) AS last FROM e),
r AS (SELECT timeline_id, value AS state, ts_ns AS start_ns, coalesce(lead(ts_ns) OVER ({ORDER}), last + 1) AS end_ns FROM c WHERE before IS NULL OR before <> value)"""
BOOL = "SELECT timeline_id, true AS value, s AS start_ns, t AS end_ns FROM"


def trailing_sql(window: int) -> str:
    return f"({PER} ORDER BY ts_ns RANGE BETWEEN {window} PRECEDING AND CURRENT ROW)"


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.and_([within(spark, sf_dir, "click"), within(spark, sf_dir, "view")])


def either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.or_([within(spark, sf_dir, "click"), within(spark, sf_dir, "view")])


CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def add(name: str, query: Query, sql: str | None) -> None:
    CATALOGUE[name] = (query, steady(sql) if sql else None)


# --- the algebra

add("latest_event_to_state", lambda s, d: states.latest_event_to_state(events(s, d), "view"), f"WITH {STATE} SELECT * FROM r WHERE state = 'view'")
add("duration_in_cur_state", lambda s, d: rounded(reduce.duration_in_current_state(states.latest_event_to_state(events(s, d), "view"))), f"WITH {STATE} SELECT timeline_id, round((end_ns - start_ns) / 1e9, 6) AS value, start_ns, end_ns FROM r WHERE state = 'view'")
add("state_with_duration", lambda s, d: states.longer_than(states.latest_event_to_state(events(s, d), "view"), 10 * HOUR), f"WITH {STATE} SELECT * FROM r WHERE state = 'view' AND end_ns - start_ns >= {10 * HOUR}")
add("has_existed", lambda s, d: states.has_existed(events(s, d), "purchase"), f"WITH {E} SELECT timeline_id, true AS value, min(ts_ns) FILTER (WHERE value = 'purchase') AS start_ns, max(ts_ns) + {HOUR} AS end_ns FROM e GROUP BY timeline_id HAVING count(*) FILTER (WHERE value = 'purchase') > 0")
add("has_existed_within", lambda s, d: within(s, d, "click"), f"WITH {E}, {within_sql('click', 'a')} {BOOL} a")
add("has_existed_within_sliced", lambda s, d: intervals.as_bool(intervals.sliced_islands(events(s, d).where("value = 'click'").select("timeline_id", F.col("ts_ns").alias("start_ns"), (F.col("ts_ns") + 12 * HOUR).alias("end_ns")), DAY)), f"WITH {E}, {within_sql('click', 'a')} {BOOL} a")
add("not_gaps", lambda s, d: intervals.not_(within(s, d, "click")), f"WITH {E}, {within_sql('click', 'a')}, g AS (SELECT timeline_id, lag(t) OVER ({PER} ORDER BY s) AS start_ns, s AS end_ns FROM a) SELECT timeline_id, false AS value, start_ns, end_ns FROM g WHERE start_ns < end_ns")
add("complement", lambda s, d: intervals.complement(within(s, d, "click"), T0, T1), f"""WITH {E}, {within_sql('click', 'a')}, w AS (SELECT DISTINCT timeline_id FROM a), x AS (SELECT timeline_id, s, t FROM a WHERE t > {T0} AND s < {T1} UNION ALL SELECT timeline_id, {T1}, {T1} FROM w),
g AS (SELECT timeline_id, greatest(coalesce(lag(t) OVER ({PER} ORDER BY s, t), {T0}), {T0}) AS start_ns, least(s, {T1}) AS end_ns FROM x) SELECT timeline_id, true AS value, start_ns, end_ns FROM g WHERE start_ns < end_ns""")
add("and_intervals", both, f"WITH {BOTH} {BOOL} m")
add("or_intervals", either, f"WITH {EITHER} {BOOL} m")
add("merge_intervals", lambda s, d: intervals.merge(within(s, d, "click").unionByName(within(s, d, "view"))), f"WITH {EITHER} {BOOL} m")
for _name, _query, _cte in (("all", both, BOTH), ("any", either, EITHER)):
    add(f"duration_where_{_name}", lambda s, d, q=_query: rounded(reduce.over(users(s, d), reduce.duration_where(q(s, d)))), f"WITH {_cte}, {USERS} SELECT timeline_id, round(coalesce(sum(t - s), 0) / 1e9, 6) AS value FROM u LEFT JOIN m USING (timeline_id) GROUP BY timeline_id")
add("longest_true", lambda s, d: rounded(reduce.over(users(s, d), reduce.longest_true(either(s, d), 30 * HOUR))), f"WITH {EITHER}, {USERS} SELECT timeline_id, round(coalesce(max(CASE WHEN t - s >= {30 * HOUR} THEN t - s END), 0) / 1e9, 6) AS value FROM u LEFT JOIN m USING (timeline_id) GROUP BY timeline_id")

# --- aggregates and windows

AGG_SQL = {
    "sum": "sum(price)", "avg": "avg(price)", "min": "min(price)", "max": "max(price)", "count": "count(price)::DOUBLE", "variance": "var_pop(price)", "stddev": "stddev_pop(price)",
    "percentile": "quantile_cont(price, 0.9)", "median": "quantile_cont(price, 0.5)",
}
for _kind, _sql in AGG_SQL.items():
    add(f"agg_{_kind}", lambda s, d, k=_kind: rounded(aggregates.aggregate(prices(s, d), k, 90.0), 7), f"WITH {E} SELECT timeline_id, '{_kind}' AS agg_type, round({_sql}, 7) AS value, count(*) AS count, max(ts_ns) AS ts_ns FROM e GROUP BY timeline_id")
    add(f"moving_{_kind}", lambda s, d, k=_kind: rounded(aggregates.moving(prices(s, d), k, 2 * DAY, 90.0), 7), f"WITH {E} SELECT timeline_id, ts_ns, seq, '{_kind}' AS agg_type, round({_sql.removesuffix('::DOUBLE')} OVER {trailing_sql(2 * DAY)}, 7)::DOUBLE AS value, count(*) OVER {trailing_sql(2 * DAY)} AS count FROM e")
for _kind, _way in (("first", "ASC"), ("last", "DESC")):
    add(f"agg_{_kind}", lambda s, d, k=_kind: aggregates.aggregate(prices(s, d), k), f"WITH {E} SELECT DISTINCT timeline_id, '{_kind}' AS agg_type, first_value(price) OVER ({PER} ORDER BY ts_ns {_way}, seq {_way}) AS value, count(*) OVER ({PER}) AS count, max(ts_ns) OVER ({PER}) AS ts_ns FROM e")
    add(f"moving_{_kind}", lambda s, d, k=_kind: aggregates.moving(prices(s, d), k, 2 * DAY), f"WITH {E} SELECT timeline_id, ts_ns, seq, '{_kind}' AS agg_type, {_kind}_value(price) OVER {trailing_sql(2 * DAY)} AS value, count(*) OVER {trailing_sql(2 * DAY)} AS count FROM e")
add("moving_avg_sliced", lambda s, d: rounded(aggregates.moving(prices(s, d), "avg", 2 * DAY, slice_ns=5 * DAY), 7), f"WITH {E} SELECT timeline_id, ts_ns, seq, 'avg' AS agg_type, round(avg(price) OVER {trailing_sql(2 * DAY)}, 7) AS value, count(*) OVER {trailing_sql(2 * DAY)} AS count FROM e")
add("windowed_sum", lambda s, d: rounded(aggregates.windowed(prices(s, d), windows.sliding_windows(s, T0, T1, 3 * DAY, 2 * DAY), "sum")), f"""WITH {E}, w AS (SELECT {T0} + i * {2 * DAY} AS start_ns, least({T0} + i * {2 * DAY} + {3 * DAY}, {T1}) AS end_ns FROM range(15) t(i))
SELECT timeline_id, 'sum' AS agg_type, round(sum(price), 6) AS value, count(*) AS count, start_ns, end_ns, end_ns AS ts_ns FROM e JOIN w ON ts_ns >= start_ns AND ts_ns < end_ns GROUP BY timeline_id, start_ns, end_ns""")
add("sliding_windows", lambda s, d: windows.sliding_windows(s, T0, T0 + 10 * HOUR, 5 * HOUR, 2 * HOUR), f"SELECT {T0} + i * {2 * HOUR} AS start_ns, least({T0} + i * {2 * HOUR} + {5 * HOUR}, {T0 + 10 * HOUR}) AS end_ns FROM range(5) t(i)")
add("tumbling_windows", lambda s, d: windows.tumbling_windows(s, T0, T0 + 10 * HOUR, 3 * HOUR), f"SELECT {T0} + i * {3 * HOUR} AS start_ns, least({T0} + (i + 1) * {3 * HOUR}, {T0 + 10 * HOUR}) AS end_ns FROM range(4) t(i)")
add("tumbling_sum", lambda s, d: rounded(windows.in_tumbling(prices(s, d), DAY, T0).groupBy("timeline_id", "start_ns", "end_ns").agg(F.sum("value").alias("value"))), f"WITH {E}, w AS (SELECT *, {T0} + (ts_ns - {T0}) // {DAY} * {DAY} AS start_ns FROM e) SELECT timeline_id, start_ns, start_ns + {DAY} AS end_ns, round(sum(price), 6) AS value FROM w GROUP BY timeline_id, start_ns")
add("sliding_avg", lambda s, d: rounded(windows.in_sliding(prices(s, d), 3 * DAY, DAY, T0).groupBy("timeline_id", "start_ns").agg(F.avg("value").alias("value")), 7), f"WITH {E}, w AS (SELECT {T0} + i * {DAY} AS start_ns FROM range(400) t(i)) SELECT timeline_id, start_ns, round(avg(price), 7) AS value FROM e JOIN w ON ts_ns >= start_ns AND ts_ns < start_ns + {3 * DAY} GROUP BY timeline_id, start_ns")
add("session_windows", lambda s, d: windows.sessions(events(s, d), 8 * HOUR).drop("session"), f"WITH {E}, g AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER ({PER} ORDER BY ts_ns) > {8 * HOUR} THEN 1 ELSE 0 END AS n FROM e), h AS (SELECT *, sum(n) OVER ({PER} ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT timeline_id, min(ts_ns) AS start_ns, max(ts_ns) + {8 * HOUR} AS end_ns, count(*) AS n_events FROM h GROUP BY timeline_id, k")
add("apply_window", lambda s, d: windows.within(prices(s, d), T0 + HOUR, T1).select("timeline_id", "ts_ns", "seq", "value"), f"WITH {E} SELECT timeline_id, ts_ns, seq, price AS value FROM e WHERE ts_ns >= {T0 + HOUR} AND ts_ns < {T1}")
add("ohlc", lambda s, d: rounded(windows.ohlc(prices(s, d), DAY, T0)), f"WITH {E}, w AS (SELECT *, {T0} + (ts_ns - {T0}) // {DAY} * {DAY} AS start_ns FROM e) SELECT timeline_id, start_ns AS ts_ns, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, round(sum(volume), 6) AS volume FROM w GROUP BY timeline_id, start_ns")
add("top_k", lambda s, d: windows.top_k(prices(s, d), "value", 3).select("timeline_id", "ts_ns", "value", F.col("rank").cast("long")), f"WITH {E}, r AS (SELECT timeline_id, ts_ns, price AS value, row_number() OVER ({PER} ORDER BY price DESC, ts_ns, seq) AS rank FROM e) SELECT * FROM r WHERE rank <= 3")
add("weekend_events", lambda s, d: windows.on_weekdays(events(s, d), 6, 7).groupBy("timeline_id").agg(F.count("*").alias("n")), f"WITH {E}, d AS (SELECT timeline_id FROM e WHERE isodow(make_timestamp(ts_ns // 1000)) IN (6, 7)) SELECT timeline_id, count(*) AS n FROM d GROUP BY timeline_id")

# --- finance

DELTA = f"{E}, d AS (SELECT *, price - lag(price) OVER ({ORDER}) AS dp, row_number() OVER ({ORDER}) AS i FROM e)"
add("twap", lambda s, d: rounded(finance.twap(prices(s, d), 2 * DAY)), f"""WITH {E}, x AS (SELECT a.timeline_id, a.ts_ns, a.seq, b.ts_ns AS bt, b.price AS bp, lag(b.ts_ns) OVER w AS pt, lag(b.price) OVER w AS pp FROM e a JOIN e b ON a.timeline_id = b.timeline_id AND b.ts_ns BETWEEN a.ts_ns - {2 * DAY} AND a.ts_ns WINDOW w AS (PARTITION BY a.timeline_id, a.seq ORDER BY b.ts_ns))
SELECT timeline_id, ts_ns, seq, 'TWAP' AS metric, round(sum((bp + pp) / 2 * (bt - pt)) / sum(bt - pt), 6) AS value FROM x GROUP BY timeline_id, ts_ns, seq HAVING count(*) > 1""")
add("vwap", lambda s, d: rounded(finance.vwap(prices(s, d), 2 * DAY), 7), f"WITH {E} SELECT a.timeline_id, a.ts_ns, a.seq, 'VWAP' AS metric, round(CASE WHEN sum(b.volume) > 0 THEN sum(b.price * b.volume) / sum(b.volume) ELSE avg(b.price) END, 7) AS value FROM e a JOIN e b ON a.timeline_id = b.timeline_id AND b.ts_ns BETWEEN a.ts_ns - {2 * DAY} AND a.ts_ns GROUP BY a.timeline_id, a.ts_ns, a.seq")
add("bollinger", lambda s, d: rounded(finance.bollinger(prices(s, d), 2 * DAY).drop("band")), f"""WITH {E}, m AS (SELECT timeline_id, ts_ns, seq, avg(price) OVER {trailing_sql(2 * DAY)} AS middle, stddev_pop(price) OVER {trailing_sql(2 * DAY)} AS stddev FROM e), b AS (SELECT * FROM (VALUES ('BollingerBands_Upper', 2), ('BollingerBands_Middle', 0), ('BollingerBands_Lower', -2)) t(metric, k))
SELECT timeline_id, ts_ns, seq, metric, round(middle + k * stddev, 6) AS value, round(middle, 6) AS middle, round(middle - 2 * stddev, 6) AS lower, round(stddev, 6) AS stddev FROM m, b""")
add("rsi", lambda s, d: rounded(finance.rsi(prices(s, d), 9 * DAY)), f"""WITH {DELTA}, f AS (SELECT timeline_id, ts_ns AS t2 FROM d WHERE i = 2), r AS (SELECT a.timeline_id, a.ts_ns, a.seq, avg(CASE WHEN b.dp > 0 THEN b.dp END) AS up, avg(CASE WHEN b.dp < 0 THEN -b.dp END) AS down FROM d a JOIN d b ON a.timeline_id = b.timeline_id AND b.i BETWEEN 2 AND a.i GROUP BY ALL)
SELECT r.timeline_id, ts_ns, seq, 'RSI' AS metric, round(100 - 100 / (1 + up / down), 6) AS value FROM r JOIN f ON f.timeline_id = r.timeline_id AND t2 > ts_ns - {9 * DAY} WHERE up IS NOT NULL AND down IS NOT NULL""")
add("rsi_windowed", lambda s, d: rounded(finance.rsi_windowed(prices(s, d), 5 * DAY)), f"""WITH {DELTA}, r AS (SELECT timeline_id, ts_ns, seq, avg(CASE WHEN dp > 0 THEN dp END) OVER {trailing_sql(5 * DAY)} AS up, avg(CASE WHEN dp < 0 THEN -dp END) OVER {trailing_sql(5 * DAY)} AS down FROM d)
SELECT timeline_id, ts_ns, seq, 'RSIWindowed' AS metric, round(100 - 100 / (1 + up / down), 6) AS value FROM r WHERE up IS NOT NULL AND down IS NOT NULL""")


def ema_sql(name: str, source: str, value: str, period: int) -> str:
    a = finance.alpha(period)
    return f"{name} AS (SELECT timeline_id, i, {value} AS x FROM {source} WHERE i = 1 UNION ALL SELECT s.timeline_id, s.i, {a!r} * s.{value} + (1 - {a!r}) * p.x FROM {name} p JOIN {source} s ON s.timeline_id = p.timeline_id AND s.i = p.i + 1)"


NUMBERED = f"{E}, d AS (SELECT *, row_number() OVER ({ORDER}) AS i FROM e)"
add("ema", lambda s, d: rounded(finance.ema(prices(s, d), 9 * HOUR)), f"WITH RECURSIVE {NUMBERED}, {ema_sql('m', 'd', 'price', 9 * HOUR)} SELECT timeline_id, ts_ns, seq, 'EMA' AS metric, round(x, 6) AS value FROM m JOIN d USING (timeline_id, i)")
add("macd", lambda s, d: rounded(finance.macd(prices(s, d), 12 * HOUR, 26 * HOUR, 9 * HOUR)), f"""WITH RECURSIVE {NUMBERED}, {ema_sql('f', 'd', 'price', 12 * HOUR)}, {ema_sql('w', 'd', 'price', 26 * HOUR)}, l AS (SELECT f.timeline_id, f.i, f.x AS fast, w.x AS slow, f.x - w.x AS line FROM f JOIN w USING (timeline_id, i)), {ema_sql('g', 'l', 'line', 9 * HOUR)}
SELECT timeline_id, ts_ns, seq, 'MACD_Line' AS metric, round(line, 6) AS value, round(g.x, 6) AS signal, round(line - g.x, 6) AS histogram, round(fast, 6) AS fast, round(slow, 6) AS slow FROM l JOIN g USING (timeline_id, i) JOIN d USING (timeline_id, i)""")
add("var_hist", lambda s, d: rounded(finance.value_at_risk(prices(s, d), 10 * DAY)), f"""WITH {E}, h AS (SELECT a.timeline_id, a.ts_ns, a.seq, list_sort(list(b.price)) AS vs FROM e a JOIN e b ON a.timeline_id = b.timeline_id AND b.ts_ns BETWEEN a.ts_ns - {10 * DAY} AND a.ts_ns GROUP BY ALL)
SELECT timeline_id, ts_ns, seq, 'VaR' AS metric, round(-vs[1 + least(trunc((1.0::DOUBLE - 95.0::DOUBLE / 100) * len(vs))::BIGINT, len(vs) - 1)], 6) AS value, 95.0::DOUBLE AS confidence FROM h WHERE len(vs) > 10""")
add("drawdown", lambda s, d: rounded(finance.drawdown(prices(s, d))), f"WITH {E}, p AS (SELECT *, max(price) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS peak FROM e) SELECT timeline_id, ts_ns, seq, 'Drawdown' AS metric, round(CASE WHEN peak <> 0 THEN (price - peak) / peak * 100 END, 6) AS value, peak, price AS current, round(price - peak, 6) AS absolute FROM p")
add("sharpe", lambda s, d: rounded(finance.sharpe(prices(s, d), 5 * DAY)), f"WITH {E}, m AS (SELECT timeline_id, ts_ns, seq, avg(price) OVER {trailing_sql(5 * DAY)} AS avg_return, stddev_pop(price) OVER {trailing_sql(5 * DAY)} AS stddev FROM e) SELECT timeline_id, ts_ns, seq, 'SharpeRatio' AS metric, round((avg_return - 0.02) / stddev, 6) AS value, round(avg_return, 6) AS avg_return, round(stddev, 6) AS stddev, 0.02::DOUBLE AS risk_free FROM m WHERE stddev > 0")
add("transaction_velocity", lambda s, d: rounded(finance.transaction_velocity(prices(s, d), DAY), 7), f"WITH {E}, m AS (SELECT timeline_id, ts_ns, seq, count(*) OVER {trailing_sql(DAY)} AS count, sum(price) OVER {trailing_sql(DAY)} AS total FROM e) SELECT timeline_id, ts_ns, seq, 'TransactionVelocity' AS metric, round(count / 24.0::DOUBLE, 7) AS value, count, round(total, 7) AS total, round(total / count, 7) AS average FROM m")


#: What the window up to each row holds where instants repeat, by a join: rows of the same instant up to the row's own.
TIED = f"""o AS (SELECT (o_custkey % 50)::VARCHAR AS timeline_id, epoch_us(o_orderdate) * 1000 AS ts_ns, o_orderkey AS seq, o_totalprice AS price, (o_orderkey % 7)::DOUBLE AS volume FROM orders),
x AS (SELECT a.timeline_id, a.ts_ns, a.seq, a.price AS own, b.ts_ns AS bt, b.seq AS bs, b.price AS bp, b.volume AS bv FROM o a JOIN o b ON a.timeline_id = b.timeline_id AND b.ts_ns >= a.ts_ns - {10 * DAY} AND (b.ts_ns < a.ts_ns OR (b.ts_ns = a.ts_ns AND b.seq <= a.seq)))"""
ROW = "timeline_id, ts_ns, seq"
TIED_SQL = {
    "sum": "sum(bp)", "avg": "avg(bp)", "min": "min(bp)", "max": "max(bp)", "count": "count(bp)::DOUBLE", "variance": "var_pop(bp)", "stddev": "stddev_pop(bp)",
    "percentile": "quantile_cont(bp, 0.9)", "median": "quantile_cont(bp, 0.5)", "first": "arg_min(bp, (bt, bs))", "last": "arg_max(bp, (bt, bs))",
}
for _kind, _sql in TIED_SQL.items():
    _places = 0 if _kind == "variance" else 2  # variances are large
    add(f"moving_{_kind}_ties", lambda s, d, k=_kind, p=_places: rounded(aggregates.moving(order_prices(s, d), k, 10 * DAY, 90.0), p), f"WITH {TIED} SELECT {ROW}, '{_kind}' AS agg_type, round({_sql}, {_places}) AS value, count(*) AS count FROM x GROUP BY {ROW}")
add("twap_ties", lambda s, d: rounded(finance.twap(order_prices(s, d), 10 * DAY), 2), f"""WITH {TIED}, y AS (SELECT *, lag(bt) OVER w AS pt, lag(bp) OVER w AS pp FROM x WINDOW w AS (PARTITION BY {ROW} ORDER BY bt, bs))
SELECT {ROW}, 'TWAP' AS metric, round(CASE WHEN sum(bt - pt) = 0 THEN any_value(own) ELSE sum((bp + pp) / 2 * (bt - pt)) / sum(bt - pt) END, 2) AS value FROM y GROUP BY {ROW} HAVING count(*) > 1""")
add("vwap_ties", lambda s, d: rounded(finance.vwap(order_prices(s, d), 10 * DAY), 4), f"WITH {TIED} SELECT {ROW}, 'VWAP' AS metric, round(CASE WHEN sum(bv) > 0 THEN sum(bp * bv) / sum(bv) ELSE avg(bp) END, 4) AS value FROM x GROUP BY {ROW}")
add("bollinger_ties", lambda s, d: rounded(finance.bollinger(order_prices(s, d), 10 * DAY).where("band = 0").drop("band"), 2), f"""WITH {TIED}, m AS (SELECT {ROW}, avg(bp) AS middle, stddev_pop(bp) AS stddev FROM x GROUP BY {ROW})
SELECT {ROW}, 'BollingerBands_Upper' AS metric, round(middle + 2 * stddev, 2) AS value, round(middle, 2) AS middle, round(middle - 2 * stddev, 2) AS lower, round(stddev, 2) AS stddev FROM m""")
add("var_hist_ties", lambda s, d: rounded(finance.value_at_risk(order_prices(s, d), 30 * DAY)), f"""WITH {TIED.replace(str(10 * DAY), str(30 * DAY))}, h AS (SELECT {ROW}, list_sort(list(bp)) AS vs FROM x GROUP BY {ROW})
SELECT {ROW}, 'VaR' AS metric, round(-vs[1 + least(trunc((1.0::DOUBLE - 95.0::DOUBLE / 100) * len(vs))::BIGINT, len(vs) - 1)], 6) AS value, 95.0::DOUBLE AS confidence FROM h WHERE len(vs) > 10""")
add("sharpe_ties", lambda s, d: rounded(finance.sharpe(order_prices(s, d), 10 * DAY), 2), f"WITH {TIED}, m AS (SELECT {ROW}, avg(bp) AS avg_return, stddev_pop(bp) AS stddev FROM x GROUP BY {ROW}) SELECT {ROW}, 'SharpeRatio' AS metric, round((avg_return - 0.02) / stddev, 2) AS value, round(avg_return, 2) AS avg_return, round(stddev, 2) AS stddev, 0.02::DOUBLE AS risk_free FROM m WHERE stddev > 0")
add("transaction_velocity_ties", lambda s, d: rounded(finance.transaction_velocity(order_prices(s, d), 10 * DAY), 2), f"WITH {TIED}, m AS (SELECT {ROW}, count(*) AS count, sum(bp) AS total FROM x GROUP BY {ROW}) SELECT {ROW}, 'TransactionVelocity' AS metric, round(count / 240.0::DOUBLE, 2) AS value, count, round(total, 2) AS total, round(total / count, 2) AS average FROM m")


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_events(spark, sf_dir).withColumn("value", F.col("price"))
    return rounded(finance.position_exposure(r.where("event_type = 'click'"), r.where("event_type = 'view'")))


add("position_exposure", exposure, f"""WITH {E}, q AS (SELECT timeline_id, ts_ns, price FROM e WHERE value = 'view'), f AS (SELECT timeline_id, arg_min(price, ts_ns) AS first FROM q GROUP BY timeline_id)
SELECT p.timeline_id, p.ts_ns, p.seq, 'PositionExposure' AS metric, round(p.price * coalesce(q.price, f.first), 6) AS value, p.price AS position, coalesce(q.price, f.first) AS price
FROM (SELECT * FROM e WHERE value = 'click') p ASOF LEFT JOIN q ON p.timeline_id = q.timeline_id AND p.ts_ns >= q.ts_ns JOIN f ON f.timeline_id = p.timeline_id""")

# --- programs

#: Places for the fraud query by props.k: a grid of cities, every fifth of them online.
PLACE_COLUMNS = {"city": "concat('city', k)", "lat": "25.0 + k % 5 * 5.0", "lng": "-120.0 + k % 7 * 8.0", "type": "CASE WHEN k % 5 = 0 THEN 'online' ELSE 'in-store' END"}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_events(spark, sf_dir).withColumn("k", (F.col("volume") % 25).cast("int"))
    body = F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in PLACE_COLUMNS.items()]))
    return r.select("timeline_id", "ts_ns", "seq", F.lit("transaction").alias("type"), body.alias("value"))


FRAUD = f"""{E}, k AS (SELECT timeline_id, ts_ns, (volume::INT) % 25 AS k FROM e),
t AS (SELECT timeline_id, ts_ns, lower('city' || k || ',,' || CASE WHEN k % 5 = 0 THEN 'online' ELSE 'in-store' END) AS p, k % 5 = 0 AS online, 25.0::DOUBLE + k % 5 * 5.0::DOUBLE AS lat, -120.0::DOUBLE + k % 7 * 8.0::DOUBLE AS lng FROM k),
j AS (SELECT a.timeline_id, a.p AS p1, b.p AS p2, a.online AS o1, b.online AS o2, abs(a.ts_ns - b.ts_ns) / 3600e9 AS h,
  2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) AS km
  FROM t a JOIN t b ON a.timeline_id = b.timeline_id AND a.p < b.p AND abs(a.ts_ns - b.ts_ns) <= {6 * HOUR}),
s AS (SELECT DISTINCT timeline_id, p1, p2 FROM j WHERE o1 <> o2 OR (NOT o1 AND km >= 500 AND CASE WHEN h = 0 THEN km >= 0.1 ELSE km / h > 950 * 1.1 END)),
v AS (SELECT s.timeline_id, p1, p2, greatest(a.ts_ns, b.ts_ns) AS s, least(a.ts_ns, b.ts_ns) + {6 * HOUR} AS t FROM s JOIN t a ON a.timeline_id = s.timeline_id AND a.p = p1 JOIN t b ON b.timeline_id = s.timeline_id AND b.p = p2 WHERE abs(a.ts_ns - b.ts_ns) < {6 * HOUR}),
n AS (SELECT timeline_id FROM v GROUP BY timeline_id HAVING count(DISTINCT (p1, p2)) >= 2), w AS (SELECT timeline_id, s, t FROM v SEMI JOIN n USING (timeline_id)), {islands_sql('w', 'm')}"""
add("fraud_intervals", lambda s, d: fraud.impossible_travel(transactions(s, d), 6 * HOUR), f"WITH {FRAUD} {BOOL} m")
add("fraud_detect", lambda s, d: fraud.detect(transactions(s, d), 6 * HOUR).select("timeline_id", "fraud_detected", F.coalesce(F.size("intervals"), F.lit(0)).cast("long").alias("n_intervals"), "processed_events"), f"WITH {FRAUD}, c AS (SELECT timeline_id, count(*) AS n FROM m GROUP BY timeline_id) SELECT timeline_id, c.n IS NOT NULL AS fraud_detected, coalesce(c.n, 0) AS n_intervals, count(*) AS processed_events FROM e LEFT JOIN c USING (timeline_id) GROUP BY timeline_id, c.n")

#: Which sample events stand for the badges' events.
BADGE_EVENTS = {"view": "app_open", "click": "content_view", "purchase": "payment_successful", "error": "payment_due", "signup": "new_feature_used"}


def badge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in BADGE_EVENTS.items()])
    out = raw_events(spark, sf_dir).select("timeline_id", "ts_ns", "seq", kind.alias("type"), F.lit("true").alias("value"))
    extra = out.where("type = 'content_view'").withColumn("type", F.lit("comment_liked")).unionByName(out.where("type = 'app_open'").withColumn("type", F.lit("weekend_activity")))
    return out.unionByName(extra)


def badge_sql(name: str, window: int, sources: tuple[str, ...], required: int) -> str:
    hits = f"WHERE value IN {sources}" if len(sources) > 1 else f"WHERE value = '{sources[0]}'"
    return f"""WITH {E}, {USERS}, p AS (SELECT timeline_id, ts_ns AS s, ts_ns + {window} AS t FROM e {hits}), {islands_sql('p', 'm')}, r AS (SELECT timeline_id, coalesce(max(t - s), 0) / 1e9 AS r FROM u LEFT JOIN m USING (timeline_id) GROUP BY timeline_id)
SELECT timeline_id AS user_id, '{name}' AS badge_type, r >= {required // 10**9} AS earned, round(least(1.0, r / {required // 10**9}), 6) AS progress, round(r, 6) AS result FROM r"""


BADGE_SQL = {
    "daily_engagement": badge_sql("daily_engagement", 24 * HOUR, ("view", "click"), 7 * DAY),
    "topic_dominator": badge_sql("topic_dominator", 24 * HOUR, ("click",), 3 * DAY),
    "feature_pioneer": badge_sql("feature_pioneer", 24 * HOUR, ("signup",), 3 * DAY),
    "weekend_warrior": badge_sql("weekend_warrior", 672 * HOUR, ("view",), 28 * DAY),
    "streak_maintainer": f"WITH {E}, {USERS} SELECT timeline_id AS user_id, 'streak_maintainer' AS badge_type, false AS earned, 0.0::DOUBLE AS progress, 0.0::DOUBLE AS result FROM u",
}
for _name, _sql in BADGE_SQL.items():
    add(f"badge_{_name}", lambda s, d, n=_name: rounded(badges.evaluate(badge_events(s, d), n)), _sql)

# --- JSON events, filters and whole queries

add("classify_json", lambda s, d: classified(s, d).select("timeline_id", "ts_ns", "seq", "type", "value", "has_ts"), f"WITH {E} SELECT timeline_id, ts_ns, seq, value AS type, value, true AS has_ts FROM e")
add("price_conversion", lambda s, d: json_events.prices(classified(s, d), "price").select("timeline_id", "ts_ns", "seq", "value", "volume"), f"WITH {E} SELECT timeline_id, ts_ns, seq, price AS value, volume FROM e")
add("numeric_conversion", lambda s, d: json_events.numeric_intervals(classified(s, d)), f"WITH {E} SELECT timeline_id, 1.0::DOUBLE AS value, ts_ns AS start_ns, ts_ns AS end_ns FROM e")

add("numeric_conversion_field", lambda s, d: json_events.numeric_intervals(classified(s, d), "price"), f"WITH {E} SELECT timeline_id, price AS value, ts_ns AS start_ns, ts_ns AS end_ns FROM e")


def odd_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as careless clients send them: other keys, keys of a wrong type before usable ones, Unix times, times out of range, and what is no object."""
    r = raw_events(spark, sf_dir)
    whole = F.timestamp_micros(F.expr("ts_ns div 1000"))
    zulu, east = F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.date_format(whole + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    forms = [
        '{"eventType": "%1$s", "timestamp": "%2$s", "value": "%1$s"}', '{"event_type": "%1$s", "ts": %4$d, "state": "%1$s"}',
        '{"eventType": 5, "type": "%1$s", "timestamp": "not a time", "time": %4$d.5, "value": 3, "status": "%1$s"}', '{"action": "%1$s", "timestamp": 1704067200000, "eventTime": "%3$s"}',
        ' {"event": "%1$s", "timestamp": "2500-01-01T00:00:00Z", "ts": true, "event_time": "%2$s"}', '{"messageType": "%1$s", "value": {"a": 1}}', '["%1$s"]', '{"timestamp": 1e300, "x": "%1$s"}',
    ]
    body = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        body = F.when(F.col("seq") % 8 == i, F.format_string(form, "event_type", zulu, east, F.unix_seconds(whole))).otherwise(body)
    return r.select("timeline_id", body.alias("json"), "seq")


add("classify_odd_json", lambda s, d: json_events.Classifier().classify(odd_json(s, d), T0).select("timeline_id", "ts_ns", "seq", "type", "value", "has_ts"), f"""WITH {E}, k AS (SELECT *, seq % 8 AS k FROM e)
SELECT timeline_id, CASE WHEN k IN (0, 3, 4) THEN ts_ns WHEN k IN (1, 2) THEN ts_ns // 1000000000 * 1000000000 ELSE {T0} END AS ts_ns, seq,
CASE WHEN k = 7 THEN 'unknown' ELSE value END AS type, CASE WHEN k = 7 THEN 'unknown' ELSE value END AS value, k < 5 AS has_ts FROM k WHERE k <> 6""")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    return c.where(json_events.matches(F.col("attrs"), {"eventType": "view", "volume": 7})).where(F.col("ts_ns").between(T0, T0 + 20 * DAY)).select("timeline_id", "ts_ns", "seq", "value")


add("filter_replay", replayed, f"WITH {E} SELECT timeline_id, ts_ns, seq, value FROM e WHERE value = 'view' AND volume = 7 AND ts_ns BETWEEN {T0} AND {T0 + 20 * DAY}")

JSON_QUERY = """{"timeline_id": "", "operations": [
  {"id": "viewed", "op": "HasExistedWithin", "source": "view", "equals": "view", "params": {"window": "12h"}},
  {"id": "clicked", "op": "HasExistedWithin", "source": "click", "equals": "click", "params": {"window": "12h"}},
  {"id": "result", "op": "DurationWhere", "conditionAll": ["clicked", "viewed"]}]}"""
HCL_QUERY = """
timeline_id = "all"
# either of two activities
operation "viewed" {
  id     = "viewed"
  type   = "HasExistedWithin"
  source = "view"
  equals = "view"
  params = { window = "12h" }
}
operation "clicked" {
  id     = "clicked"
  type   = "HasExistedWithin"
  source = "click"
  equals = "click"
  params = { window = "12h" }
}
operation "any" {
  id            = "either"
  type          = "OR"
  condition_any = ["clicked", "viewed"]
}
operation "longest" {
  id     = "result"
  type   = "LongestConsecutiveTrueDuration"
  params = { sourceOperationId = "either", duration = "30h" }
}
"""


def planned(spark: SparkSession, sf_dir: str, ops: str, hcl: bool = False) -> DataFrame:
    spec = parse_query(ops) if hcl else query_from_json(ops)
    return rounded(process(classified(spark, sf_dir), spec.operations).df)


add("query_json", lambda s, d: planned(s, d, JSON_QUERY), CATALOGUE["duration_where_all"][1])
add("query_hcl", lambda s, d: planned(s, d, HCL_QUERY, True), CATALOGUE["longest_true"][1])


def price_query(op: str, params: str) -> str:
    return f'{{"operations": [{{"id": "result", "op": "{op}", "params": {{"value_field": "price", {params}}}}}]}}'


add("query_moving_average", lambda s, d: rounded(process(classified(s, d), query_from_json(price_query("MovingAverage", '"window": "48h"')).operations).df, 7), CATALOGUE["moving_avg"][1])
add("query_percentile", lambda s, d: rounded(process(classified(s, d), query_from_json(price_query("Percentile", '"percentile": 90')).operations).df, 7), CATALOGUE["agg_percentile"][1])
add("query_vwap", lambda s, d: rounded(process(classified(s, d), query_from_json(price_query("VWAP", '"window": "48h"')).operations).df, 7), CATALOGUE["vwap"][1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in the state `view` by user: events turned into states and summed, as a query asks."""
    ops = '{"operations": [{"id": "viewing", "op": "LatestEventToState", "source": "event", "equals": "view"}, {"id": "result", "op": "DurationWhere", "conditionAll": ["viewing"]}]}'
    return rounded(process(events(spark, sf_dir), query_from_json(ops).operations).df)


add("view_duration", flagship, f"WITH {STATE}, {USERS}, v AS (SELECT * FROM r WHERE state = 'view') SELECT timeline_id, round(coalesce(sum(end_ns - start_ns), 0) / 1e9, 6) AS value FROM u LEFT JOIN v USING (timeline_id) GROUP BY timeline_id")


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}


