"""Sharding by extendible hashing.

Every row has a 60-bit hash of its key. A bucket is a prefix of hash bits; one that is over the byte limit, and only
that, is split on the next bit, until every bucket fits or holds one row. The directory is built from sums, not rows:
bytes per prefix of `bits` bits, rolled up to all shorter prefixes; a bucket is the shortest prefix that fits. Prefixes
that don't fit at full depth are refined by some more bits in another pass over their rows alone. Rows then find their
shard by looking the prefix up in the directory.

Rows whose hashes are equal in all bits can't be told apart by splitting. They share a bucket that is divided into
overflow pages by running size: per input partition first, then over the partitions' sums, so that no task gathers
one key's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm._common import checkpoint

HASH_BITS = 60
#: Bits of the first level of the directory, and of each further level below a prefix that doesn't fit there.
LEVEL_BITS, FINER_BITS = 15, 6
#: A level of at most so many entries is sent to every task; a larger one is joined.
SENT_ENTRIES = 1 << 16


def hash_bits(key: str):
    """60 bits of the key's MD5 as a long; a null key has the hash of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(h: str, bits: int):
    return F.shiftright(h, HASH_BITS - bits)


def leaves(cells: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """The directory (cell, depth, prefix, n_bytes, n_rows) of sums (cell, n_bytes, n_rows) per `depth` bits: an entry for each cell under a bucket.

    A bucket is a prefix that fits and whose parent doesn't; prefixes start at `top` bits.
    """
    at = F.explode(F.sequence(F.lit(top), F.lit(depth)))
    nodes = cells.select("cell", "n_bytes", "n_rows", at.alias("depth")).selectExpr("n_bytes", "n_rows", "depth", f"shiftright(cell, {depth} - depth) AS prefix")
    sums = nodes.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
    sums = checkpoint(sums.withColumn("fits", (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1)))
    split = sums.where("not fits").select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    roots = sums.where(F.col("fits") & (F.col("depth") == top))
    buckets = sums.where("fits").join(split, ["depth", "prefix"], "left_semi").unionByName(roots)
    under = F.expr(f"explode(sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1))")
    return buckets.select(under.alias("cell"), "depth", "prefix", "n_bytes", "n_rows")


def assign(docs: DataFrame, limit: int = 64 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard of each row of docs: key, row_bytes, shard (bits of its prefix, and `+page` for overflow pages), depth, shard_bytes, shard_rows.

    limit: bytes of text a shard may have; a single longer text is a shard of its own. A null text has no bytes. Rows
    with a null key share one hash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key), hash_bits(key).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("row_bytes"))
    out, rest, top = None, rows, 0
    while top < HASH_BITS:
        depth = min(top + (FINER_BITS if top else LEVEL_BITS), HASH_BITS)
        cells = checkpoint(rest.groupBy(prefix("h", depth).alias("cell")).agg(F.sum("row_bytes").alias("n_bytes"), F.count("*").alias("n_rows")))
        directory = checkpoint(leaves(cells, top, depth, limit))
        small = F.broadcast(directory) if directory.count() <= SENT_ENTRIES else directory
        found = rest.join(small, prefix("h", depth) == F.col("cell"))
        done = found.select(key, "row_bytes", F.lpad(F.bin("prefix"), 60, "0").alias("bits"), "depth", F.col("n_bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"))
        done = done.select(key, "row_bytes", F.expr("right(bits, depth)").alias("shard"), F.col("depth").cast("long"), "shard_bytes", "shard_rows")
        out = done if out is None else out.unionByName(done)
        full = cells.where((F.col("n_bytes") > limit) & (F.col("n_rows") > 1)).select(F.col("cell").alias("full"))
        if full.isEmpty():
            return out
        rest = rest.join(full, prefix("h", depth) == F.col("full"), "left_semi")
        top = depth
    return out.unionByName(overflow_pages(rest, limit, key))


def overflow_pages(rest: DataFrame, limit: int, key: str) -> DataFrame:
    rows = checkpoint(rest.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    sums = rows.groupBy("h", "part").agg(F.sum("row_bytes").alias("b"))
    before = sums.withColumn("before", F.sum("b").over(Window.partitionBy("h").orderBy("part")) - F.col("b")).select("h", "part", "before")
    own = Window.partitionBy("h", "part").orderBy("nth")
    placed = rows.withColumn("inside", F.sum("row_bytes").over(own) - F.col("row_bytes")).join(before, ["h", "part"])
    largest = rows.groupBy("h").agg(F.max("row_bytes").alias("largest"))
    # a page closes at the limit less the longest row, so that the row which crosses the line still fits
    page = F.floor((F.col("before") + F.col("inside")) / F.greatest(F.lit(limit) - F.col("largest") + 1, F.lit(1)))
    paged = checkpoint(placed.join(largest, "h").withColumn("page", F.when(F.col("largest") >= limit, F.col("nth")).otherwise(page)))
    total = paged.groupBy("h", "page").agg(F.sum("row_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    named = F.concat(F.lpad(F.bin("h"), HASH_BITS, "0"), F.lit("+"), F.col("page").cast("string"))
    return paged.join(total, ["h", "page"]).select(key, "row_bytes", named.alias("shard"), F.lit(HASH_BITS).cast("long").alias("depth"), "shard_bytes", "shard_rows")


def write(docs: DataFrame, path: str, limit: int = 64 << 20, key: str = "doc_id", text: str = "text") -> None:
    """Write docs to path as Parquet, a folder a shard (named b and its bits, so that none reads as a number); keys must tell rows apart.

    A shard has a bounded size, so it is one task's work.
    """
    shards = assign(docs, limit, key, text).select(F.col(key).alias("_key"), F.concat(F.lit("b"), "shard").alias("shard"))
    own = docs.join(shards, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    own.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int = 64 << 20) -> str:
    """The same assignment in DuckDB's SQL, by all prefixes of up to 60 bits."""
    return f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS row_bytes FROM documents),
d AS (SELECT unnest(generate_series(0, {HASH_BITS}))::BIGINT AS depth),
n AS (SELECT depth, h >> ({HASH_BITS} - depth)::INT AS prefix, sum(row_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM r, d GROUP BY ALL),
f AS (SELECT r.doc_id, r.h, r.row_bytes, n.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY n.depth) AS nth
      FROM r, n WHERE n.prefix = r.h >> ({HASH_BITS} - n.depth)::INT AND (n.shard_bytes <= {limit} OR n.shard_rows = 1))
SELECT doc_id, row_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), {HASH_BITS}, '0'), depth::INT) END AS shard, depth, shard_bytes, shard_rows FROM f WHERE nth = 1"""
