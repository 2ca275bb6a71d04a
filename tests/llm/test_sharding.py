import hashlib
import random

import duckdb
import pytest

from chronoweave.llm import extendible_sharding
from tests.llm.conftest import clashing


def bits(key):
    return format(int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16), "060b")


def brute(rows, limit):
    out = []
    for key, size in rows:
        for d in range(61):
            own = [s for k, s in rows if bits(k)[:d] == bits(key)[:d]]
            if sum(own) <= limit or len(own) == 1:
                out.append((key, size, bits(key)[:d], d, sum(own), len(own)))
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1, 300, 1000, 5000, 10**9])
def test_against_brute_force(docs_of, limit, monkeypatch):
    monkeypatch.setattr(extendible_sharding, "LEVEL_BITS", 4)
    monkeypatch.setattr(extendible_sharding, "FINER_BITS", 3)
    monkeypatch.setattr(extendible_sharding, "SENT_ENTRIES", 12)
    r = random.Random(3)
    rows = [(i, "x" * r.choice([0, 10, 50, 700])) for i in range(120)]
    got = extendible_sharding.assign(clashing(docs_of(*rows)).drop("row_bytes", "h"), limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(k, len(t)) for k, t in rows], limit)


def test_against_sql(docs_of):
    documents = docs_of(*[(i, "é" * (i % 90)) for i in range(300)])
    c = duckdb.connect()
    c.register("documents", documents.toPandas())
    got = sorted(map(tuple, extendible_sharding.assign(documents, 2000).collect()))
    assert got == sorted(c.sql(extendible_sharding.oracle(2000)).fetchall())
    assert len({g[2] for g in got}) > 5


def test_equal_keys_make_pages(docs_of):
    rows = [(1, "x" * 40)] * 50 + [(None, "y" * 30)] * 3 + [(2, "z" * 500), (3, None)]
    got = extendible_sharding.assign(docs_of(*rows), 100).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.row_bytes)
    assert all(sum(v) <= 100 or len(v) == 1 for v in sizes.values())
    assert all(r.shard_bytes == sum(sizes[r.shard]) and r.shard_rows == len(sizes[r.shard]) for r in got)
    assert len([s for s in sizes if "+" in s]) >= 25
    huge = extendible_sharding.assign(docs_of(*[(1, "x" * 200)] * 4), 100).collect()
    assert sorted(r.shard_rows for r in huge) == [1] * 4


def test_empty_and_write(docs_of, spark, tmp_path):
    assert extendible_sharding.assign(docs_of((1, "x")).where("false"), 10).collect() == []
    documents = docs_of(*[(i, "w" * 20) for i in range(40)])
    extendible_sharding.write(documents, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.select("doc_id").collect()) == list(range(40))
    assert max(r["count"] for r in back.groupBy("shard").count().collect()) <= 5
