import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import _common
from chronoweave.llm._common import LongTable, connected_components, pack, unpack


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([0, 20, 45]))]
    if seed == 3:
        edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)]  # a chain and a hub
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)


def test_hubs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", 10)  # read in the driver
    monkeypatch.setattr(_common, "HOT_KEYS", 50)
    edges = [(100, i) for i in range(200, 360)] + [(i, i + 1) for i in range(30)] + [(400, 359), (5, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: (0 if x <= 30 or x == 500 else 100) for e in edges for x in e}
    rows = spark.createDataFrame([(i % 3 if i % 4 else 9, i) for i in range(200)], "k long, x long")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    joined = _common.joined_by(rows, sizes, "k", 200)
    totals = {r.k: r.total for r in sizes.collect()}
    assert sorted((r.k, r.x, r.total) for r in joined.collect()) == sorted((r.k, r.x, totals[r.k]) for r in rows.collect())
    assert joined.columns == ["k", "x", "total"] and "_salt" in joined._jdf.queryExecution().toString()


def test_tables_are_written_and_deleted(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "a long, b string")
    for made in (_common.written(df), _common.checkpoint(df)):
        assert sorted(map(tuple, made.collect())) == [(1, "a"), (2, None)] and made.columns == df.columns
        folder = _common.shared_folder(spark)
        before = sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:")))
        _common.forget(made)
        assert sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:"))) < before


def test_pack():
    a, b = np.arange(5), np.arange(5).astype(np.uint8)
    (x, y), rest = unpack(pack([a, b], b"tail"), [np.int64, np.uint8])
    assert np.array_equal(a, x) and np.array_equal(b, y) and rest == b"tail"


def test_long_table():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 50, 3000))
    t = LongTable(keys.tolist(), (keys % 97).tolist(), -5)
    assert np.array_equal(t.get(keys), keys % 97)
    others = np.setdiff1d(r.integers(0, 1 << 50, 3000), keys)
    assert (t.get(others) == -5).all() and t.get(np.array([[-1, int(keys[0])]])).tolist() == [[-5, int(keys[0] % 97)]]
    assert LongTable([], [], 9).get(np.array([0, 1])).tolist() == [9, 9]
