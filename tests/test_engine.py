"""Classification, planning, the store, and the fronts."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from chronoweave import cli
from chronoweave.engine import Engine, as_json
from chronoweave.functions import json_events
from chronoweave.functions.durations import DurationError
from chronoweave.functions.json_events import Classifier
from chronoweave.model import DAY, HOUR, MINUTE, SECOND
from chronoweave.operators import badges
from chronoweave.plans.planner import PlanError, Planner, process
from chronoweave.plans.spec import Op, QuerySpec, ReplaySpec, query_from_json
from chronoweave.sources.http import respond, server
from chronoweave.streaming import ingest as streams
from chronoweave.streaming.batches import MicroBatcher

NOW = 1_700_000_000 * SECOND
T = 1_735_732_800 * SECOND  # 2025-01-01T12:00:00Z


def classify(spark, *objects):
    texts = [o if isinstance(o, str) else json.dumps(o) for o in objects]
    raw = spark.createDataFrame([("t", x, i) for i, x in enumerate(texts)], "timeline_id string, json string, seq long")
    return Classifier().classify(raw, NOW).orderBy("seq").collect()


def test_types(spark):
    rows = classify(spark, {"eventType": "customEvent"}, {"x": 1}, "{invalid json", {"type": "play"}, {"eventType": 123, "type": "t"}, "[1]", "null", {"eventType": 123}, {"messageType": "m"}, '"text"')
    assert [(r.seq, r.type) for r in rows] == [(0, "customEvent"), (1, "unknown"), (3, "play"), (4, "t"), (7, "unknown"), (8, "m")]


def test_times(spark):
    rows = classify(
        spark, {"timestamp": 1640995200}, {"timestamp": "bad", "ts": "2022-01-01T02:00:00+02:00"}, {"time": 1640995200.9}, {"event_time": "2022-01-01T00:00:00.123456789Z"},
        {"timestamp": "2022-01-01"}, {"timestamp": "2022-01-01T00:00:00"}, {}, {"timestamp": True, "eventTime": 1}, {"timestamp": "2022-02-30T00:00:00Z"},
    )
    base = 1640995200 * SECOND
    assert [r.ts_ns for r in rows] == [base, base, base, base + 123456789, NOW, NOW, NOW, SECOND, NOW]
    assert [r.has_ts for r in rows] == [True] * 4 + [False] * 3 + [True, False]


def test_times_out_of_range(spark):
    rows = classify(
        spark, {"type": "x", "timestamp": 1704067200000}, {"timestamp": "2500-01-01T00:00:00Z", "ts": 5}, {"timestamp": 1e300, "time": "1600-01-01T00:00:00Z", "event_time": 7}, {"ts": -1e300}, {"ts": 9223372036},
        {"timestamp": "2262-04-11T23:47:16.854775807Z"}, {"timestamp": "2262-04-11T23:47:16.854775808Z"},
    )
    assert [r.ts_ns for r in rows] == [NOW, 5 * SECOND, 7 * SECOND, NOW, 9223372036 * SECOND, 2**63 - 1, NOW]


def test_values_and_fields(spark):
    rows = classify(
        spark, {"type": "play", "video_id": "v", "cdn": 5, "device_type": "tv"}, {"type": "seek", "seek_from_time": 1.5, "seek_to_time": "2", "video_id": "w"}, {"type": "rebuffer", "buffer_duration": 3},
        {"type": "playerStateChange", "newState": "buffer"}, {"type": "playerStateChange", "state": 7, "newState": "x"}, {"type": "cdnChange", "cdn": "A"}, {"eventType": "userAction", "userAction": "click"},
        {"type": "other", "value": True}, {"type": "other", "value": "true"}, {"type": "other", "status": "ok"},
    )
    assert [r.value for r in rows] == ["play", "seek", "rebuffer", "buffer", "", "A", "click", "other", "true", "ok"]
    assert (rows[0].video_id, rows[0].cdn, rows[0].device_type) == ("v", None, "tv")
    assert (rows[1].seek_from_time, rows[1].seek_to_time, rows[1].video_id, rows[2].buffer_duration) == (1.5, None, "w", 3.0)


def test_registered_type(spark):
    c = Classifier().register("deal", value=lambda v, kind: F.coalesce(json_events.string_at(v, "stage"), F.lit("new")), fields={"amount": json_events.number_at})
    raw = spark.createDataFrame([("t", '{"type":"deal","stage":"won","amount":5}', 0), ("t", '{"type":"deal"}', 1)], "timeline_id string, json string, seq long")
    assert [(r.value, r.amount) for r in c.classify(raw, 0).orderBy("seq").collect()] == [("won", 5.0), ("new", None)]


@pytest.mark.parametrize(("filters", "want"), [({"a": "5"}, [0]), ({"a": 5}, [1, 2]), ({"b": True}, [1]), ({"b": "true"}, [2]), ({"a": 5, "b": True}, [1]), ({"zz": None}, []), ({"n": None}, [0]), ({"l": [1, 2]}, [2]), ({}, [0, 1, 2])])
def test_filters(spark, filters, want):
    objects = [{"a": "5", "n": None}, {"a": 5, "b": True}, {"a": 5.0, "b": "true", "l": [1, 2]}]
    raw = spark.createDataFrame([("t", json.dumps(o), i) for i, o in enumerate(objects)], "timeline_id string, json string, seq long")
    got = Classifier().classify(raw, 0).where(json_events.matches(F.col("attrs"), filters))
    assert sorted(r.seq for r in got.collect()) == want


def test_prices(spark):
    raw = spark.createDataFrame([("t", json.dumps(o), i) for i, o in enumerate([{"value": "x", "price": 3, "volume": 2}, {"value": "", "price": "3"}])], "timeline_id string, json string, seq long")
    e = Classifier().classify(raw, 0)
    assert [(r.value, r.volume) for r in json_events.prices(e, "price").orderBy("seq").collect()] == [(3.0, 2.0), (0.0, 0.0)]
    assert [r.value for r in json_events.prices(e).orderBy("seq").collect()] == [1.0, 0.0]


def frame(spark, *rows):
    data = [(tid, at, i, kind, value, json.dumps(attrs)) for i, (tid, at, kind, value, attrs) in enumerate(rows)]
    return spark.createDataFrame(data, "timeline_id string, ts_ns long, seq long, type string, value string, a string").withColumn("attrs", F.parse_json("a")).drop("a")


@pytest.fixture(scope="module")
def session(spark):
    return frame(spark, *[("t", T + m * MINUTE, "playerStateChange", v, {"p": m}) for m, v in enumerate(["play", "buffer", "play", "pause"])])


def one(result):
    return [r.value for r in result.df.collect()]


def test_buffering_minute(session):
    q = query_from_json('{"operations": [{"id": "b", "op": "LatestEventToState", "source": "playerStateChange", "equals": "buffer"}, {"id": "result", "op": "DurationWhere", "conditionAll": ["b"]}]}')
    r = process(session, q.operations)
    assert one(r) == [60.0] and r.unit == "seconds"


def test_result_and_units(session):
    state, seen = Op("s", "LatestEventToState", source="playerStateChange", equals="play"), Op("result", "HasExisted", source="playerStateChange", equals="buffer")
    assert process(session, [seen, state]).unit == "boolean_intervals"
    assert process(session, [state]).unit == "intervals"
    empty = process(session, [])
    assert one(empty) == [0] and empty.unit == ""
    price = Op("m", "MovingAverage", params={"value_field": "p", "window": "1m"})
    r = process(session, [price])
    assert r.unit == "" and [x.value for x in r.df.orderBy("ts_ns").collect()] == [0, 0.5, 1.5, 2.5]


def test_dispatch_errors(session):
    for op, match in [(Op("x", "count"), "unsupported"), (Op("x", "and"), "unsupported"), (Op("x", "Not"), "requires 'of'"), (Op("x", "HasExistedWithin"), "window"), (Op("x", "LongestConsecutiveTrueDuration", params={"sourceOperationId": "no"}), "sourceOperationId"), (Op("x", "DurationInCurState", of=Op("y", "HasExisted")), "state")]:
        with pytest.raises(PlanError, match=match):
            process(session, [op])
    with pytest.raises(DurationError):
        process(session, [Op("x", "VaR", params={"window": "30d"})])
    process(session, [Op("x", "VaR", params={"window": "30d"})], lenient_durations=True)


def test_references(session):
    a = Op("a", "HasExistedWithin", source="playerStateChange", equals="buffer", params={"window": "30s"})
    s = Op("s", "LatestEventToState", source="playerStateChange", equals="buffer")
    assert one(process(session, [a, Op("r", "DurationWhere", condition_all=("a", "nobody"))])) == [30.0]
    assert one(process(session, [a, s, Op("r", "DurationWhere", condition_all=("a", "s"), condition_any=("zz",))])) == [30.0]
    assert one(process(session, [a, s, Op("r", "DurationWhere", condition_any=("a", "s"))])) == [60.0]
    assert process(session, [s, Op("r", "AND", condition_all=("s",))]).df.count() == 0
    assert one(process(session, [Op("r", "DurationWhere")])) == [0.0]
    lenient = process(session, [Op("a", "HasExistedWithin", source="playerStateChange", equals="buffer", window="30s")])
    assert lenient.df.count() == 1 and lenient.metadata["notes"]
    p = Planner(session)
    p.run([a, Op("b", "HasExistedWithin", source="playerStateChange", equals="buffer", params={"window": "30s"})])
    assert p.tracks["a"] is p.tracks["b"]


ALL_PRICE_OPS = ["TWAP", "VWAP", "BollingerBands", "RSI", "MACD", "VaR", "Drawdown", "SharpeRatio", "TransactionVelocity", "MovingAverage", "MovingSum", "MovingMax", "MovingMin", "Percentile", "MovingCount", "MovingVariance", "MovingStdDev", "MovingPercentile", "MovingMedian", "MovingFirst", "MovingLast", "EMA", "PositionExposure"]


@pytest.mark.parametrize("name", ALL_PRICE_OPS)
def test_price_operations_run(session, name):
    process(session, [Op("r", name, params={"value_field": "p", "window": 5, "multiplier": "x"})]).df.collect()


def test_windowed_operation(session):
    op = Op("r", "WindowedAggregate", params={"value_field": "p", "window": "2m", "start": "2025-01-01T12:00:00Z", "end": "2025-01-01T12:05:00Z", "aggregation": "sum"})
    assert [r.value for r in process(session, [op]).df.orderBy("start_ns").collect()] == [1.0, 5.0]
    sliding = Op("r", "WindowedAggregate", params={"value_field": "p", "window": "2m", "slide": "1m", "start": "2025-01-01T12:00:00Z", "end": "2025-01-01T12:02:00Z", "aggregation": "count"})
    assert [r.value for r in process(session, [sliding]).df.orderBy("start_ns").collect()] == [2.0, 1.0]


def badge(spark, name, times, kind, user="u"):
    e = frame(spark, *[(user, t, kind, "true", {}) for t in times])
    return badges.evaluate(e, name).first()


def test_badges(spark):
    assert badge(spark, "daily_engagement", [T + d * DAY for d in range(8)], "app_open").earned
    assert not badge(spark, "daily_engagement", [T, T + 3 * DAY], "app_open").earned
    for name, kind in (("topic_dominator", "comment_liked"), ("feature_pioneer", "new_feature_used")):
        assert badge(spark, name, [T + d * DAY for d in range(4)], kind).earned
    r = badge(spark, "weekend_warrior", [T + d * 7 * DAY for d in range(5)], "weekend_activity")
    assert r.earned and r.progress == 1.0
    r = badge(spark, "streak_maintainer", [T, T + 15 * DAY], "payment_successful")
    assert not r.earned and r.result == 0.0
    with pytest.raises(badges.BadgeError):
        badge(spark, "nobody", [T], "x")
    for bad in (("", "b", 1, 2), ("u", "", 1, 2), ("u", "b", 0, 2), ("u", "b", 3, 2)):
        with pytest.raises(badges.BadgeError):
            badges.validate(*bad)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def said(minute, state, **more):
    return {"eventType": "playerStateChange", "timestamp": f"2025-01-01T12:{minute:02d}:00Z", "state": state, **more}


BUFFER = {"operations": [{"id": "b", "op": "LatestEventToState", "source": "playerStateChange", "equals": "buffer"}, {"id": "result", "op": "DurationWhere", "conditionAll": ["b"]}]}


def test_store(engine):
    assert engine.query(QuerySpec("nobody", QuerySpec.from_dict(BUFFER).operations)).df.first().value == 0.0
    engine.ingest("s1", [said(2, "play"), said(0, "play", cdn="A")])
    engine.ingest("s1", [said(1, "buffer"), "not json", {"eventType": "x"}])
    with pytest.raises(ValueError, match="no events"):
        engine.ingest("s1", [])
    r = engine.query(QuerySpec.from_dict({"timeline_id": "s1", **BUFFER}))
    said_so = as_json(r, "s1")
    assert said_so["result"] == 60.0 and said_so["metadata"]["eventCount"] == 4
    rows = as_json(engine.query(QuerySpec.from_dict({"timeline_id": "s1", "operations": [{"id": "r", "op": "MovingCount"}]})), "s1", limit=2)
    assert len(rows["result"]) == 2 and rows["metadata"]["truncated"]
    assert engine.store.load("s1").count() == 4
    assert engine.store.load("s1", (T, T + MINUTE)).count() == 2
    assert engine.store.load("s1", filters={"cdn": "A"}).count() == 1
    assert engine.store.load("s1", filters={"cdn": "none"}).count() == 0
    engine.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = engine.store.load("s1", (T, T + MINUTE)).where("type = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(timeline_id,s1)" in plan and "EqualTo(type,x)" in plan and "GreaterThanOrEqual(ts_ns," in plan
    ids = engine.store.timelines()
    assert [x.timeline_id for x in ids.collect()] == ["s1"] and "json" not in ids._jdf.queryExecution().executedPlan().toString()
    engine.ingest("s2", [{"timestamp": 1704067200000}, {"timestamp": "2500-01-01T00:00:00Z", "type": "y"}])  # nothing to file them under, and no reason to stop
    assert sorted((r.type, r.has_ts) for r in engine.store.load("s2").collect()) == [("unknown", False), ("y", False)]
    small = engine.store.compact_to(engine.store.path + "-small")
    assert sorted(map(str, small.raw().drop("batch").collect())) == sorted(map(str, engine.store.raw().drop("batch").collect()))
    replay = ReplaySpec.from_dict({"timeline_id": "s1", "query": {**BUFFER, "filters": {"cdn": "A"}, "time_range": {"start": "2025-01-01T00:00:00Z", "end": "2025-01-02T00:00:00Z"}}, "processing_mode": "odd"})
    out = engine.replay(replay)
    assert out.df.first().value == 0.0 and out.metadata["processingMode"] == "auto"
    badge = engine.badge("daily_engagement", "s1", T, T + DAY).first()
    assert badge.earned is False and badge.details["required_seconds"] == 7 * 86400 and badge.metadata["operations"] == "5"
    report = engine.fraud_of("s1", start_ns=T)
    assert (report["customer_id"], report["fraud_detected"], report["processed_events"], report["start_ns"]) == ("s1", False, 3, T) and report["execution_seconds"] > 0
    with pytest.raises(ValueError, match="no events"):
        engine.fraud_of("nobody")


def test_http(engine):
    post = lambda path, body, kind="application/json": respond(engine, "POST", path, body.encode(), kind)
    assert post("/timelines/v/events", json.dumps([said(0, "play"), said(1, "buffer"), said(2, "play")]))[0] == 202
    assert post("/timelines/v/events", "[]")[0] == 400
    assert post("/timelines/v/events", "{")[0] == 400
    status, body = post("/timelines/v/query", json.dumps(BUFFER))
    assert (status, body["result"], body["unit"]) == (200, 60.0, "seconds")
    hcl = 'timeline_id = "other"\noperation "x" {\n id = "result"\n type = "HasExisted"\n source = "playerStateChange"\n equals = "buffer"\n}\n'
    status, body = post("/timelines/v/query", hcl, "")
    assert status == 200 and body["unit"] == "boolean_intervals" and len(body["result"]) == 1
    assert post("/timelines/v/replay_query", json.dumps({"query": BUFFER}))[1]["result"] == 60.0
    assert post("/timelines/v/query", "{bad")[0] == 400
    assert post("/timelines/v/query", '{"operations": [{"id": "a", "op": "nope"}]}')[0] == 500
    assert respond(engine, "GET", "/health", b"")[1]["status"] == "healthy"
    assert respond(engine, "GET", "/timelines/v/query", b"")[0] == 405
    assert post("/elsewhere", "")[0] == 404


def test_server(engine):
    with server(engine, port=0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{s.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{base}/health"))["status"] == "healthy"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{base}/nothing")
        assert e.value.code == 404
        s.shutdown()


def test_cli(engine, spark, tmp_path, capsys):
    engine.ingest("c", [said(0, "play"), said(1, "buffer"), said(2, "play")])
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.hcl").write_text('timeline_id = "c"\n')
    (tmp_path / "q" / "b.hcl").write_text('operation "b" {\n id = "b"\n type = "LatestEventToState"\n source = "playerStateChange"\n equals = "buffer"\n}\noperation "r" {\n id = "result"\n type = "DurationWhere"\n condition_all = ["b"]\n}\n')
    args = ["--store", engine.store.path, "--path", str(tmp_path / "q"), "--json"]
    assert cli.main([*args, "--merge"], spark) == 0
    assert json.loads(capsys.readouterr().out)["result"] == 60.0
    assert cli.main(args, spark) == 1  # the second file alone has no timeline_id
    with pytest.raises(SystemExit):
        cli.main(["--store", "x"])


def test_stream_ingest(engine, spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"timeline_id": "s", "json": json.dumps(said(m, v))}) for m, v in enumerate(["play", "buffer", "play"])))
    raw = spark.readStream.schema("timeline_id string, json string").json(str(source))
    for _ in range(2):
        streams.ingest_stream(raw, engine.store, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert engine.store.load("s").count() == 3
    assert engine.query(QuerySpec.from_dict({"timeline_id": "s", **BUFFER})).df.first().value == 60.0


def test_a_batch_that_is_tried_again_is_stored_once(engine, spark):
    rows = spark.createDataFrame([("s", json.dumps(said(m, "play"))) for m in range(6)], "timeline_id string, json string").repartition(3)
    numbers = lambda: sorted(r.seq for r in engine.store.raw().collect())
    whole = streams.numbered(rows, 5 << streams.BATCH_BITS).select("timeline_id", "json", "seq")
    engine.store.append(whole.limit(2), "stream-5")  # half of it, as if the writer had been lost
    engine.store.append(whole, "stream-5")
    engine.store.append(whole, "stream-5")
    assert numbers() == [(5 << streams.BATCH_BITS) + i for i in range(6)]
    engine.store.append(streams.numbered(rows, 0).select("timeline_id", "json", "seq"), "other-5")
    engine.ingest("s", [said(9, "pause")])
    assert engine.store.load("s").count() == 13
    assert streams.numbered(rows.where("false"), 0).collect() == []


def test_micro_batches(engine):
    with MicroBatcher(engine.store, 3, 60) as batcher:
        assert batcher.add("m", [said(i, "play") for i in range(4)]) == 4
        assert engine.store.load("m").count() == 3
        with pytest.raises(ValueError, match="no events"):
            batcher.add("m", [])
    assert engine.store.load("m").count() == 4 and [(f.events, f.reason) for f in batcher.flushes] == [(3, "size"), (1, "final")]
    with MicroBatcher(engine.store, 3, 0.2) as soon:
        soon.add("m", [said(5, "pause")])
        for _ in range(200):
            if soon.flushes:
                break
            time.sleep(0.1)
    assert [(f.events, f.reason) for f in soon.flushes] == [(1, "timeout")]
    with MicroBatcher(engine.store, 100, 60) as web:
        assert respond(engine, "POST", "/timelines/w/events", json.dumps([said(0, "play")]).encode(), "", web)[0] == 202
        body = json.dumps({"operations": [{"id": "r", "op": "HasExisted", "source": "playerStateChange", "equals": "play"}]}).encode()
        assert len(respond(engine, "POST", "/timelines/w/query", body, "", web)[1]["result"]) == 1


def test_stream_aggregates(spark, tmp_path):
    data = spark.createDataFrame([("t", m * MINUTE, float(m), "x") for m in (0, 1, 2, 10, 11)], "timeline_id string, ts_ns long, value double, v string")
    data.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "p"))
    q = streams.stream_sessions(stream, "5 minutes", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_events for r in spark.sql("select * from sessions").collect()) == [2, 3]
    q = streams.stream_windows(stream, "10 minutes", "10 minutes", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["sum"] for r in spark.sql("select * from windows").collect()) == [3.0, 21.0]


def test_progress(session):
    told = []
    ops = [Op("a", "HasExisted", source="playerStateChange", equals="play"), Op("b", "nope")]
    with pytest.raises(PlanError):
        process(session, ops, on_progress=told.append)
    assert [(t["event_type"], t.get("operator_id")) for t in told] == [("operator_started", "a"), ("operator_completed", "a"), ("operator_started", "b"), ("operator_failed", "b")]
    told.clear()
    process(session, ops[:1], on_progress=told.append)
    assert told[-1]["event_type"] == "orchestrator_completed" and told[-1]["progress_percent"] == 100.0


def test_written_result(engine, spark, tmp_path, capsys):
    engine.ingest("c", [said(0, "play"), said(1, "buffer"), said(2, "play")])
    (tmp_path / "q.json").write_text(json.dumps({"timeline_id": "c", **BUFFER}))
    assert cli.main(["--store", engine.store.path, "--path", str(tmp_path / "q.json"), "--out", str(tmp_path / "out")], spark) == 0
    assert str(tmp_path / "out" / "q") in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out" / "q")).first().value == 60.0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plans_shuffle_once(session):
    from chronoweave.operators import aggregates, finance, intervals, states

    price = json_events.prices(session, "p")
    for df in (states.latest_event_to_state(session, "play"), states.has_existed_within(session, "play", HOUR), aggregates.moving(price, "avg", HOUR), finance.twap(price, HOUR), finance.rsi(price, HOUR), finance.drawdown(price), finance.position_exposure(price, price)):
        assert exchanges(df) == 1, df.columns
    a = states.has_existed_within(session, "play", HOUR)
    assert "Cartesian" not in intervals.and_([a, intervals.not_(a)])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in intervals.and_([a, a])._jdf.queryExecution().executedPlan().toString()
