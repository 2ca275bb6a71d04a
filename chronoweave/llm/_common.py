"""Shared plumbing of the corpus operators: table access, checkpoints, packed blocks and connected components.

Tables are read through Spark only, so any path that Spark's readers can open will do.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.shipping import ship

#: Rows per batch, in Arrow and when Parquet is read: long texts must not pile up in one.
ROWS_A_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.parquet.columnarReaderBatchSize": 512}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and bound the batches that they get by rows; the session keeps smaller settings of its own."""
    ship(spark)
    for key, rows in ROWS_A_BATCH.items():
        if int(spark.conf.get(key, "10000")) > rows:
            spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of this machine only where all run on it."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(own)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same by a Parquet table: smaller than a checkpoint, and only the columns that are asked for are read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint or written table that nothing will read again."""
    sc = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution().analyzed()
    paths = [str(f).rsplit("/", 1)[0] for f in df.inputFiles()]
    if not paths and plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        paths = [file.get()] if file.isDefined() else []
    for path in set(paths):
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Give freed memory back to the system: idle Python workers stay, and would hold it while others work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving its memory back when it is done.

    The collector of reference cycles is off meanwhile: these functions make none, and its scans of their many small
    objects took a fifth of the time.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            trim()

    return whole


def partitions_for(total_bytes: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-int(total_bytes) // per_partition))


# --- packed blocks: several equally long columns and one run of bytes, compressed together


def pack(columns: list[np.ndarray], payload: bytes = b"") -> bytes:
    n = len(columns[0])
    return zstandard.ZstdCompressor(level=3).compress(np.array([n], np.int64).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns) + payload)


def unpack(blob: bytes, dtypes: list) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for d in map(np.dtype, dtypes):
        out.append(np.frombuffer(raw, d, n, at))
        at += n * d.itemsize
    return out, raw[at:]


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Blocks to partitions by their bucket's number, as many buckets to each."""
    return df.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int"))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def runs_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        own = [b.column(k).to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in own])) + 1).tolist(), len(b)] if len(b) else [0]
        for first, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[first] for c in own)
            if key != now and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(b.slice(first, end - first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# --- a hash table of longs for whole arrays


class LongTable:
    """An open hash table from keys (not negative) to values, looked up an array at a time."""

    def __init__(self, keys: list[int], values: list[int], missing: int):
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask, self.missing, self.probes = np.uint64(64 - bits), (1 << bits) - 1, missing, 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int64)
        for key, value, at in zip(keys, values, self.slot(np.array(keys, np.int64)).tolist(), strict=True):
            n = 1
            while self.key[at] >= 0:
                at, n = (at + 1) & self.mask, n + 1
            self.key[at], self.value[at] = key, value
            self.probes = max(self.probes, n)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The values; negative keys are missing."""
        at = self.slot(key)
        there = self.key[at]
        out = np.where(there == key, self.value[at], self.missing)
        rest = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        if len(rest):
            key, at, flat = key.ravel()[rest], at.ravel()[rest], out.ravel()
            for _ in range(self.probes):
                at = (at + 1) & self.mask
                there = self.key[at]
                hit = there == key
                flat[rest[hit]] = self.value[at[hit]]
                more = ~hit & (there >= 0)
                rest, key, at = rest[more], key[more], at[more]
                if not len(rest):
                    break
        return out


# --- joins by a key that may be hot

#: Keys that are told to every task as hot, at most: a key is hot if it has more than 1/HOT_KEYS of all rows, and over HOT_ROWS.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def joined_by(rows: DataFrame, sizes: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with sizes (key, n: how many of rows have it, more columns), the rows of hot keys dealt over many tasks.

    The hot keys are few by definition, so every task can know them; their rows get a salt and what `sizes` has on them
    is repeated for each salt.
    """
    salts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = [] if total <= limit else [r[key] for r in sizes.where(F.col("n") > limit).select(key).distinct().collect()]  # fewer than HOT_KEYS
    if not hot:
        return rows.join(sizes.drop("n"), key)
    known = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], f"{key} long").withColumn("_hot", F.lit(True)))
    salted = rows.join(known, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    many = F.explode(F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(sizes.withColumn("_salt", many).drop("n"), [key, "_salt"]).drop("_salt")


# --- connected components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node that can be reached.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until nothing changes. Both are a
    pre-aggregated minimum per node and a join back in which the rows of hubs are dealt over many tasks; every round is
    cut by a checkpoint, and the one before it deleted. Self loops are dropped; an empty input gives an empty result.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, keep: Column, joined: Column, total: int) -> DataFrame:
        least = e.groupBy("u").agg(F.count("*").alias("n"), F.least(F.min("v"), F.col("u")).alias("m"))
        return joined_by(e, least, "u", total).where(keep).select(joined.alias("u"), F.col("m").alias("v")).where("u <> v")

    def state(e: DataFrame) -> tuple[int, int]:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    cur = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = state(cur)
    while seen[0]:
        large = star(both(cur), F.col("v") > F.col("u"), F.col("v"), 2 * seen[0]).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # small star: the neighbours below u and u itself all point to the least of them
        small = star(down, F.lit(True), F.col("v"), 2 * seen[0]).union(down.groupBy("u").agg(F.min("v").alias("v")))
        before, cur = cur, checkpoint(small.where("u <> v").distinct())
        forget(before)
        now = state(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
