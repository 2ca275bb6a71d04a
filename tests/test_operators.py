"""Operators on small inputs with known answers, and against plain Python on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.model import DAY, HOUR, MINUTE, SECOND
from chronoweave.operators import aggregates, finance, fraud, intervals, reduce, states, windows

EVENTS = "timeline_id string, ts_ns long, seq long, type string, value string"
PRICES = "timeline_id string, ts_ns long, seq long, value double, volume double, symbol string"
BOOLS = "timeline_id string, value boolean, start_ns long, end_ns long"


def events(spark, *rows):
    return spark.createDataFrame([("t", int(at * SECOND), i, "e", v) for i, (at, v) in enumerate(rows)], EVENTS)


def prices(spark, *rows, step=60):
    data = [(r if isinstance(r, tuple) else (r, 0.0)) for r in rows]
    return spark.createDataFrame([("t", i * step * SECOND, i, float(v), float(w), "") for i, (v, w) in enumerate(data)], PRICES)


def bools(spark, *rows):
    return spark.createDataFrame([("t", v, s * SECOND, e * SECOND) for v, s, e in rows], BOOLS)


def spans(df):
    return sorted((r.start_ns / SECOND, r.end_ns / SECOND) for r in df.collect())


def values(df, column="value"):
    return [r[column] for r in df.orderBy("ts_ns").collect()]


@pytest.mark.parametrize(("rows", "equals", "want"), [
    ([(0, "buffer")], "buffer", [(0, 1e-9)]),
    ([(0, "play"), (60, "buffer"), (120, "play")], "buffer", [(60, 120)]),
    ([(0, "play"), (1, "pause")], "buffer", []),
    ([(0, "a"), (1, "a"), (2, "b"), (3, "a")], "a", [(0, 2), (3, 3 + 1e-9)]),
    ([], "a", []),
])
def test_latest_event_to_state(spark, rows, equals, want):
    assert spans(states.latest_event_to_state(events(spark, *rows), equals)) == want


def test_has_existed(spark):
    assert spans(states.has_existed(events(spark, (0, "buffer"), (60, "play")), "play")) == [(60, 3660)]
    assert spans(states.has_existed(events(spark, (0, "buffer")), "play")) == []
    assert spans(states.has_existed(events(spark, (0, "play"), (100, "x")), "play")) == [(0, 3700)]


def test_has_existed_within(spark):
    assert spans(states.has_existed_within(events(spark, (0, "seek"), (3, "seek"), (20, "seek"), (25, "seek")), "seek", 5 * SECOND)) == [(0, 8), (20, 30)]


def test_reductions(spark):
    b = bools(spark, (True, 0, 10), (False, 10, 20), (True, 20, 25))
    assert [r.value for r in reduce.duration_where(b).collect()] == [15.0]
    runs = bools(spark, (True, 0, 2 * 3600), (False, 2 * 3600, 3 * 3600), (True, 3 * 3600, 6 * 3600))
    assert [r.value for r in reduce.longest_true(runs).collect()] == [10800.0]
    assert [r.value for r in reduce.longest_true(runs, int(2.5 * HOUR)).collect()] == [10800.0]
    assert reduce.longest_true(runs, 5 * HOUR).collect() == []
    nobody = spark.createDataFrame([("t",), ("u",)], "timeline_id string")
    assert sorted(map(tuple, reduce.over(nobody, reduce.duration_where(b)).collect())) == [("t", 15.0), ("u", 0.0)]
    cur = reduce.duration_in_current_state(states.latest_event_to_state(events(spark, (0, "NYC"), (300, "NYC"), (480, "LA"), (900, "LA")), "NYC"))
    assert [r.value for r in cur.collect()] == [480.0]


def test_and_or_not(spark):
    a, b = bools(spark, (True, 0, 10)), bools(spark, (True, 5, 15))
    assert spans(intervals.and_([a, b])) == [(5, 10)]
    assert spans(intervals.or_([a, b])) == [(0, 15)]
    c, d = bools(spark, (True, 0, 5)), bools(spark, (True, 10, 15))
    assert spans(intervals.and_([c, d])) == []
    assert spans(intervals.or_([c, d])) == [(0, 5), (10, 15)]
    assert spans(intervals.and_([bools(spark, (True, 0, 5)), bools(spark, (True, 5, 9))])) == []
    one = bools(spark, (True, 0, 5), (False, 5, 6), (True, 3, 8))
    assert intervals.and_([one]) is one
    assert spans(intervals.not_(bools(spark, (True, 0, 5)))) == []
    out = intervals.not_(bools(spark, (False, 0, 2), (True, 2, 5), (True, 8, 9), (False, 9, 12)))
    assert spans(out) == [(0, 2), (5, 8), (9, 12)] and not any(r.value for r in out.collect())
    assert spans(intervals.not_(bools(spark, (False, 1, 3), (False, 2, 7)))) == [(1, 7)]
    assert spans(intervals.complement(bools(spark, (True, 2, 5), (True, 8, 9)), 0, 10 * SECOND)) == [(0, 2), (5, 8), (9, 10)]
    assert spans(intervals.complement(bools(spark, (True, -2, 5), (True, 8, 19)), 0, 10 * SECOND)) == [(5, 8)]


def brute_cover(lists, need):
    edges = sorted({x for iv in lists for p in iv for x in p})
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        if sum(any(s <= a and b <= e for s, e in iv) for iv in lists) >= need:
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sweep_against_brute_force(spark, seed):
    r = random.Random(seed)
    lists = [[(s, s + r.randint(1, 12)) for s in (r.randint(0, 60) for _ in range(r.randint(0, 8)))] for _ in range(3)]
    frames = [bools(spark, *[(True, s, e) for s, e in iv]) if iv else bools(spark, (False, 0, 1)) for iv in lists]
    assert spans(intervals.and_(frames)) == brute_cover(lists, 3)
    assert spans(intervals.or_(frames)) == brute_cover(lists, 1)
    flat = bools(spark, *[(True, s, e) for iv in lists for s, e in iv], (True, 100, 101))
    assert spans(intervals.sliced_islands(flat.drop("value"), 7 * SECOND)) == spans(intervals.islands(flat.drop("value")))


def test_aggregates(spark):
    p = prices(spark, 10, 20, 30, 40)
    for kind, want in {"sum": 100, "avg": 25, "min": 10, "max": 40, "count": 4, "median": 25, "first": 10, "last": 40}.items():
        row = aggregates.aggregate(p, kind).first()
        assert (row.value, row["count"], row.ts_ns) == (want, 4, 180 * SECOND)
    assert aggregates.aggregate(p, "percentile", 90).first().value == pytest.approx(37)
    assert aggregates.aggregate(prices(spark, 2, 4, 4, 4, 5, 5, 7, 9), "stddev").first().value == 2.0
    ten = prices(spark, *range(1, 11))
    assert [aggregates.aggregate(ten, "percentile", q).first().value for q in (0, 50, 90, 100, -5, 200)] == pytest.approx([1, 5.5, 9.1, 10, 1, 10])
    with pytest.raises(ValueError, match="unsupported"):
        aggregates.aggregate(p, "mode")
    assert aggregates.aggregate(p.where("false"), "sum").collect() == []


def test_moving(spark):
    p = prices(spark, 10, 20, 30, 40)
    assert values(aggregates.moving(p, "avg", 2 * MINUTE)) == [10, 15, 20, 30]
    assert values(aggregates.moving(p, "avg", 2 * MINUTE, slice_ns=3 * MINUTE)) == [10, 15, 20, 30]
    w = spark.createDataFrame([(0, 120 * SECOND), (120 * SECOND, 240 * SECOND), (900 * SECOND, 960 * SECOND)], "start_ns long, end_ns long")
    assert values(aggregates.windowed(p, w, "sum")) == [30, 70]


@pytest.mark.parametrize("kind", sorted(aggregates.AGGREGATES))
def test_ties_and_slices_against_brute_force(spark, kind):
    r = random.Random(kind)
    rows = [(tid, r.randint(0, 40) * SECOND, i, float(r.randint(0, 50)), 0.0, "") for i, tid in enumerate(r.choices("ab", k=60))]
    df = spark.createDataFrame(rows, PRICES)
    w = 7 * SECOND
    want = {}
    for t, ts, seq, *_ in rows:
        vs = [x[3] for x in sorted(rows, key=lambda x: (x[1], x[2])) if x[0] == t and ts - w <= x[1] and (x[1], x[2]) <= (ts, seq)]
        s, n = sorted(vs), len(vs)
        mean = sum(vs) / n
        var = sum((v - mean) ** 2 for v in vs) / n
        rank = lambda p: s[int(p * (n - 1))] + (s[min(int(p * (n - 1)) + 1, n - 1)] - s[int(p * (n - 1))]) * (p * (n - 1) % 1)  # noqa: B023, E731
        want[seq] = {"sum": sum(vs), "avg": mean, "min": s[0], "max": s[-1], "count": n, "variance": var, "stddev": var**0.5, "percentile": rank(0.5), "median": rank(0.5), "first": vs[0], "last": vs[-1]}[kind]
    for slice_ns in (None, 0, 11 * SECOND):
        got = {x.seq: x.value for x in aggregates.moving(df, kind, w, slice_ns=slice_ns).collect()}
        assert got == pytest.approx(want)


def test_windows(spark):
    got = windows.sliding_windows(spark, 0, 10 * MINUTE, 5 * MINUTE, 2 * MINUTE).orderBy("start_ns").collect()
    assert [(r.start_ns // MINUTE, r.end_ns // MINUTE) for r in got] == [(0, 5), (2, 7), (4, 9), (6, 10), (8, 10)]
    assert windows.tumbling_windows(spark, 0, 10 * MINUTE, 3 * MINUTE).count() == 4
    with pytest.raises(ValueError, match="positive"):
        windows.sliding_windows(spark, 0, 10, 5, 0)
    e = events(spark, *[(60 * m, "x") for m in (0, 1, 2, 10, 11)])
    assert spans(windows.sessions(e, 5 * MINUTE)) == [(0, 420), (600, 960)]
    assert windows.sessions(events(spark, (0, "x"), (300, "x")), 5 * MINUTE).count() == 1
    assert values(windows.within(prices(spark, 100, 101, 102, 103), MINUTE, 3 * MINUTE)) == [101, 102]
    assert windows.WindowSpec.parse("sliding", "5m", "1m") == windows.WindowSpec("sliding", 5 * MINUTE, MINUTE)
    with pytest.raises(ValueError, match="required"):
        windows.WindowSpec.parse("session", "", timeout="5m")
    bar = windows.ohlc(prices(spark, (3, 1), (9, 1), (1, 1), (4, 2)), 3 * MINUTE).orderBy("ts_ns").collect()
    assert [tuple(b)[2:] for b in bar] == [(3, 9, 1, 1, 3), (4, 4, 4, 4, 2)]
    assert windows.on_weekdays(events(spark, (0, "thu"), (2 * 86400, "sat")), 6, 7).first().value == "sat"


def test_slices_are_exact(spark):
    day, base = DAY, 1_704_067_200 * SECOND
    rows = spark.createDataFrame([("t", base + d, i, float(i), 0.0, "") for i, d in enumerate((-100, 0, day - 1, day, 2 * day - 1))], PRICES)
    w = spark.createDataFrame([(base, base + day), (base + day, base + 2 * day)], "start_ns long, end_ns long")
    assert [(r["count"], r.value) for r in aggregates.windowed(rows, w, "sum").orderBy("start_ns").collect()] == [(2, 3.0), (2, 7.0)]
    assert [r["count"] for r in aggregates.moving(rows, "sum", 100, slice_ns=day).orderBy("ts_ns").collect()] == [1, 2, 1, 2, 1]
    assert windows.in_sliding(rows, day, day, base).groupBy("start_ns").count().orderBy("start_ns").select("count").collect() == [(2,), (2,)]


def test_finance(spark):
    p = prices(spark, 100, 101, 102, 103)
    assert values(finance.twap(p, 2 * MINUTE)) == [100.5, 101, 102]
    assert values(finance.vwap(prices(spark, (100, 1000), (102, 2000), (101, 1500)), 2 * MINUTE)) == pytest.approx([100, 101.3333, 101.2222], abs=1e-3)
    assert values(finance.vwap(p, 2 * MINUTE)) == [100, 100.5, 101, 102]
    bands = finance.bollinger(prices(spark, 100, 102, 98, 104, 96), 3 * MINUTE)
    assert bands.count() == 15 and bands.where("metric = 'BollingerBands_Upper' and value < middle").count() == 0
    rsi = finance.rsi(prices(spark, 100, 102, 101, 103, 102, 104), 3 * MINUTE).orderBy("ts_ns").collect()
    assert [(r.ts_ns // MINUTE, round(r.value, 2)) for r in rsi] == [(2, 66.67), (3, 66.67)]
    down = finance.drawdown(prices(spark, 100, 110, 105, 95, 115)).orderBy("ts_ns").collect()
    assert [round(r.value, 4) for r in down] == [0, 0, -4.5455, -13.6364, 0] and down[2].peak == 110
    v = finance.transaction_velocity(prices(spark, 1000, 1500, 2000, 500, step=900), HOUR).orderBy("ts_ns").collect()[-1]
    assert (v.value, v["count"], v.total) == (4.0, 4, 5000)
    returns = prices(spark, *[x / 100 for x in (1, -2, 3, -1, 2, -3, 1, 2, -1, 3, -2, 1, 2, -1, 1)])
    var = finance.value_at_risk(returns, 20 * MINUTE).collect()
    assert len(var) == 5 and all(r.value >= 0 for r in var)
    sharpe = finance.sharpe(returns, 5 * MINUTE, 0.005).collect()
    assert len(sharpe) == 14 and {r.risk_free for r in sharpe} == {0.005}
    zero = finance.drawdown(prices(spark, 0, -1)).orderBy("ts_ns").collect()
    assert zero[1].value is None


def test_finance_where_instants_repeat(spark):
    rows = [(0, 1.0, 1.0), (10, 2.0, 1.0), (10, 4.0, 2.0), (10, 3.0, 0.0), (15, 8.0, 1.0), (21, 5.0, 1.0)]
    p = spark.createDataFrame([("t", at * SECOND, i, v, w, "") for i, (at, v, w) in enumerate(rows)], PRICES)
    w = 10 * SECOND

    def held(i):
        return [r for r in rows[: i + 1] if r[0] >= rows[i][0] - 10]

    for slice_ns in (None, 0):
        by_seq = lambda df: {r.seq: r for r in df.collect()}
        paid = by_seq(finance.vwap(p, w, slice_ns))
        counted = by_seq(finance.transaction_velocity(p, w, slice_ns))
        middle = by_seq(finance.bollinger(p, w, slice_ns=slice_ns).where("band = 1"))
        ratio = by_seq(finance.sharpe(p, w, 0.0, slice_ns))
        weighted = by_seq(finance.twap(p, w, slice_ns))
        for i in range(len(rows)):
            own = held(i)
            mean = sum(r[1] for r in own) / len(own)
            deviation = (sum((r[1] - mean) ** 2 for r in own) / len(own)) ** 0.5
            assert paid[i].value == pytest.approx(sum(r[1] * r[2] for r in own) / sum(r[2] for r in own))
            assert counted[i]["count"] == len(own) and middle[i].value == pytest.approx(mean)
            assert (i in ratio) == (deviation > 0) and (i not in ratio or ratio[i].value == pytest.approx(mean / deviation))
            area = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(own, own[1:], strict=False))
            time = own[-1][0] - own[0][0]
            assert (i in weighted) == (len(own) > 1) and (i not in weighted or weighted[i].value == pytest.approx(area / time if time else own[-1][1]))
    assert [r.value for r in finance.vwap(p, w).orderBy("seq").collect()][1] == 1.5


def test_instants_at_the_ends_of_the_range(spark):
    first, last = -(2**63) + 1, 2**63 - 1
    e = spark.createDataFrame([("t", first, 0, "e", "a"), ("t", 0, 1, "e", "b"), ("t", last, 2, "e", "a")], EVENTS)
    assert [(r.start_ns, r.end_ns) for r in states.latest_event_to_state(e, "a").orderBy("start_ns").collect()] == [(first, 0), (last, last)]
    assert [(r.start_ns, r.end_ns) for r in states.has_existed(e, "b").collect()] == [(0, last)]
    assert [(r.start_ns, r.end_ns) for r in states.has_existed_within(e, "a", HOUR).orderBy("start_ns").collect()] == [(first, first + HOUR), (last, last)]
    whole = spark.createDataFrame([("t", True, first, last), ("t", True, first, last)], BOOLS)
    assert reduce.duration_where(whole).first().value == pytest.approx(2 * 2**63 / SECOND)
    assert reduce.longest_true(whole, DAY).first().value == pytest.approx(2**63 / SECOND)
    assert windows.sessions(e, HOUR).count() == 3
    p = e.select("timeline_id", "ts_ns", "seq", F.lit(1.0).alias("value"), F.lit(1.0).alias("volume"), F.lit("").alias("symbol"))
    assert [r["count"] for r in aggregates.moving(p, "sum", HOUR).collect()] == [1, 1, 1]


def test_ema_and_macd(spark):
    vs = [100.0, 101.5, 99.0, 104.25, 103.0, 107.5, 90.0]
    p = prices(spark, *vs).unionByName(prices(spark, 5, 6).withColumn("timeline_id", F.lit("u")))

    def ema(xs, period):
        a, out = 2 / (period / HOUR + 1), [xs[0]]
        for x in xs[1:]:
            out.append(a * x + (1 - a) * out[-1])
        return out

    assert values(finance.ema(p, 12 * MINUTE).where("timeline_id = 't'")) == ema(vs, 12 * MINUTE)
    fast, slow = ema(vs, 5 * MINUTE), ema(vs, 10 * MINUTE)
    line = [a - b for a, b in zip(fast, slow, strict=True)]
    got = finance.macd(p, 5 * MINUTE, 10 * MINUTE, 3 * MINUTE).where("timeline_id = 't'").orderBy("ts_ns").collect()
    assert [r.value for r in got] == line and [r.signal for r in got] == ema(line, 3 * MINUTE)
    assert finance.macd(p, 5 * MINUTE, 10 * MINUTE, 3 * MINUTE).where("timeline_id = 'u'").count() == 2


def test_position_exposure(spark):
    position = prices(spark, 100, 150, 75)
    price = spark.createDataFrame([("t", 30 * SECOND, 9, 150.0, 0.0, ""), ("t", 60 * SECOND, 10, 155.0, 0.0, ""), ("t", 119 * SECOND, 11, 160.0, 0.0, "")], PRICES)
    assert values(finance.position_exposure(position, price)) == [15000, 23250, 12000]
    assert finance.position_exposure(position, price.where("false")).collect() == []


# --- fraud

CITY = {"SF": ("San Francisco", "CA", 37.7749, -122.4194), "LA": ("Los Angeles", "CA", 34.0522, -118.2437), "NY": ("New York", "NY", 40.7128, -74.0060), "SD": ("San Diego", "CA", 32.7157, -117.1611), "SJ": ("San Jose", "CA", 37.3382, -121.8863), "MI": ("Miami", "FL", 25.7617, -80.1918), "BO": ("Boston", "MA", 42.3601, -71.0589), "OR": ("Orlando", "FL", 28.5384, -81.3789)}


def purchase(spark, *rows):
    import json

    data = []
    for i, (minute, city, kind) in enumerate(rows):
        name, state, lat, lng = CITY[city]
        data.append(("c", minute * MINUTE, i, "transaction", json.dumps({"city": name, "state": state, "lat": lat, "lng": lng, "type": kind})))
    return spark.createDataFrame(data, EVENTS)


@pytest.mark.parametrize(("rows", "window", "want"), [
    ([(0, "SF", "in-store"), (120, "LA", "in-store")], 10, False),
    ([(0, "NY", "in-store"), (4, "SF", "in-store"), (8, "LA", "in-store")], 30, True),
    ([(0, "SF", "in-store"), (20, "SJ", "in-store")], 30, False),
    ([(0, "LA", "online"), (5, "LA", "in-store"), (10, "LA", "online")], 30, False),
    ([(0, "BO", "online"), (30, "MI", "in-store"), (60, "OR", "in-store")], 120, True),
    ([(0, "NY", "in-store")], 30, False),
])
def test_fraud(spark, rows, window, want):
    got = fraud.detect(purchase(spark, *rows), window * MINUTE).first()
    assert (got.fraud_detected, got.processed_events) == (want, len(rows))


def test_fraud_plain_text_places(spark):
    e = events(spark, (0, "Paris"), (1, "paris"), (2, "Rome"))
    rows = fraud.places(e).orderBy("ts_ns").collect()
    assert [r.place for r in rows] == ["paris,,in-store", "paris,,in-store", "rome,,in-store"]
    assert fraud.impossible_travel(e).collect() == []


def brute_fraud(rows, w):
    import math

    def possible(a, b):
        if "online" in (a[5], b[5]):
            return a[5] == b[5]
        p1, p2 = math.radians(a[3]), math.radians(b[3])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        km, gap = 2 * 6371 * math.asin(math.sqrt(h)), abs(a[0] - b[0]) / HOUR
        return km < 500 or (km < 0.1 if gap == 0 else km / gap <= 950 * 1.1)

    keys = {tuple(sorted((a[1], b[1]))) for a in rows for b in rows if a[1] != b[1] and abs(a[0] - b[0]) <= w and not possible(a, b)}
    pairs = [[(max(a[0], b[0]), min(a[0], b[0]) + w) for a in rows for b in rows if (a[1], b[1]) == k and abs(a[0] - b[0]) < w] for k in keys]
    pairs = [p for p in pairs if p]
    out = []
    for s, e in sorted(x for p in pairs for x in p) if len(pairs) >= 2 else []:
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fraud_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 600), r.choice(sorted(CITY)), r.choice(["online", "in-store", "in-store"])) for _ in range(25)]
    plain = []
    for m, c, kind in rows:
        name, state, lat, lng = CITY[c]
        plain.append((m * MINUTE, f"{name},{state},{kind}".lower(), c, lat, lng, kind))
    got = [(x.start_ns, x.end_ns) for x in fraud.impossible_travel(purchase(spark, *rows), 45 * MINUTE).orderBy("start_ns").collect()]
    assert got == brute_fraud(plain, 45 * MINUTE)


def test_simulated_customers(spark):
    """A seeded population: some travel as people do, a few make purchases in several far cities within minutes."""
    r = random.Random(12345)
    rows, guilty = [], set()
    for c in range(97):
        home = r.choice(sorted(CITY))
        for k in range(r.randint(5, 12)):
            rows.append((f"c{c}", home, "in-store", k * 2 * DAY // MINUTE + r.randint(0, 600)))
        if r.random() < 0.03 or c == 50:
            guilty.add(f"c{c}")
            at = r.randint(0, 20 * DAY // MINUTE)
            far = [x for x in ("NY", "LA", "MI", "SF") if x != home][:3]
            rows += [(f"c{c}", x, "in-store", at + 3 * i) for i, x in enumerate(far)]
    import json

    data = []
    for i, (c, city, kind, minute) in enumerate(rows):
        name, state, lat, lng = CITY[city]
        data.append((c, minute * MINUTE, i, "transaction", json.dumps({"city": name, "state": state, "lat": lat, "lng": lng, "type": kind})))
    got = fraud.detect(spark.createDataFrame(data, EVENTS)).collect()
    assert len(got) == 97 and {g.timeline_id for g in got if g.fraud_detected} == guilty
