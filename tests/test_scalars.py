"""Durations, instants, specifications and HCL."""

import json

import pytest

from chronoweave.functions.durations import DurationError, hours, parse_duration
from chronoweave.plans import hcl
from chronoweave.plans.spec import Op, QuerySpec, SpecError, instant_ns, query_from_json, replay_from_json

S = 10**9


@pytest.mark.parametrize(("text", "want"), [("5s", 5 * S), ("1h30m", 5400 * S), ("1.5h", 5400 * S), ("250ms", S // 4), ("2us", 2000), ("7ns", 7), ("-3m", -180 * S), ("0", 0), (".5s", S // 2), ("672h", 672 * 3600 * S)])
def test_durations(text, want):
    assert parse_duration(text) == want


@pytest.mark.parametrize("text", ["", "30d", "4w", "5", "s", "1h-2m", "abc", "1 h", "-", "99999999999999h"])
def test_bad_durations(text):
    with pytest.raises(DurationError):
        parse_duration(text)


def test_lenient_durations():
    assert parse_duration("30d", lenient=True) == 30 * 24 * 3600 * S
    assert parse_duration("4w", lenient=True) == 672 * 3600 * S
    assert hours(90 * 60 * S) == 1.5


def test_instants():
    assert instant_ns("2022-01-01T00:00:00Z") == 1640995200 * S
    assert instant_ns("2022-01-01T02:00:00.123456789+02:00") == 1640995200 * S + 123456789
    for bad in ("2022-01-01", "2022-01-01T00:00:00", "x", None, "2022-13-01T00:00:00Z"):
        with pytest.raises(SpecError):
            instant_ns(bad)


def test_json_round_trip():
    d = {"timeline_id": "u", "operations": [{"id": "a", "op": "Not", "of": {"id": "b", "op": "HasExisted", "source": "s", "equals": "x"}}, {"id": "c", "op": "AND", "conditionAll": ["a", "b"], "params": {"window": "5s"}}], "filters": {"k": 1}, "time_range": {"start": "2025-01-01T00:00:00Z", "end": "2025-06-01T23:59:59Z"}}
    assert QuerySpec.from_dict(d).to_dict() == d
    assert query_from_json(json.dumps(d)).to_dict() == d


@pytest.mark.parametrize("text", ["{", "[]", '{"operations": [{"id": 5, "op": "x"}]}', '{"time_range": {"start": "x", "end": "y"}}', '{"operations": [3]}'])
def test_bad_json(text):
    with pytest.raises(SpecError):
        query_from_json(text)


def test_replay_json():
    r = replay_from_json('{"timeline_id": "t", "chunk_size": 100, "query": {"operations": []}}')
    assert (r.timeline_id, r.chunk_size, r.query.operations) == ("t", 100, ())


HCL = '''
timeline_id = "pump 7" # which
filters = { plant = "north", "valve" : "open", bars = 3, hot = false, note = null, list = [1, "a",], }
/* when */
time_range {
  start = timestamp("2023-11-14T22:13:20Z")
  end   = "2023-12-24T18:30:00+01:00"
}
operation "any label" {
  id            = "a"
  type          = "HasExistedWithin"
  source        = "s"
  equals        = "say \\"x\\""
  window        = "5m"
  params        = {
    window = "5s"
    deep   = { a = 1 }
  }
  condition_all = ["x", "y"]
  condition_any = []
  of "nested" {
    id     = "b"
    type   = "HasExisted"
    source = "t"
  }
}
'''


def test_hcl_query():
    q = hcl.parse_query(HCL)
    assert q.timeline_id == "pump 7"
    assert q.filters == {"plant": "north", "valve": "open", "bars": 3.0, "hot": False, "note": None, "list": [1.0, "a"]}
    assert q.operations == (Op("a", "HasExistedWithin", "s", 'say "x"', "5m", Op("b", "HasExisted", "t"), ("x", "y"), (), {"window": "5s", "deep": {"a": 1.0}}),)
    assert q.time_range.bounds == (1700000000 * S, 1703439000 * S)


def test_hcl_replay():
    r = hcl.parse_replay('timeline_id = "t"\nchunk_size = 500\nquery {\n timeline_id = "t"\n operation "o" {\n id = "a"\n type = "HasExisted"\n }\n}\n')
    assert (r.timeline_id, r.chunk_size, r.query.operations[0].op) == ("t", 500, "HasExisted")


@pytest.mark.parametrize("text", ["", "timeline_id = 5", 'timeline_id = "a"\ntimeline_id = "b"', 'timeline_id = "a" x = 1', 'timeline_id = "a"\noperation "o" {\n id = "x"\n}', 'timeline_id = "a"\nwhat = 1', 'timeline_id = "a"\noperation "o" {', 'timeline_id = "a"\noperation "o" {\n id = "x"\n type = "Not"\n of "n" {\n id = "y"\n type = "z"\n equals = "q"\n }\n}', "timeline_id = @"])
def test_bad_hcl(text):
    with pytest.raises(SpecError):
        hcl.parse_query(text)


def test_replay_needs_inner_id():
    with pytest.raises(SpecError):
        hcl.parse_replay('timeline_id = "t"\nquery {\n}\n')


def test_heredoc():
    assert hcl.parse('a = <<-EOT\n    x\n      y\n    EOT\n').attributes["a"] == "x\n  y\n"


def test_directory(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.hcl").write_text('timeline_id = "t"')
    (tmp_path / "sub" / "b.tf").write_text('operation "o" {\n id = "a"\n type = "HasExisted"\n}')
    (tmp_path / "c.txt").write_text("not read")
    assert [f.name for f in hcl.files(tmp_path)] == ["a.hcl", "b.tf"]
    assert hcl.parse_query(hcl.merged(tmp_path)).operations[0].id == "a"
    (tmp_path / "d.hcl").write_text('timeline_id = "u"')
    with pytest.raises(SpecError):
        hcl.parse_query(hcl.merged(tmp_path))


@pytest.mark.parametrize(("text", "header", "want"), [("x", "application/vnd.hcl; charset=utf-8", "hcl"), ("x = 1", "application/json", "json"), (' {"a": 1}', "", "json"), ("[1]", "text/plain", "json"), ("a = 1\n", "", "hcl"), ("?", "", "json"), ("", "", "json")])
def test_content_kind(text, header, want):
    assert hcl.content_kind(text, header) == want
